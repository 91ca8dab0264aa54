"""Documents cut into overlapping chunks for embedding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def split_document(text: str, most: int = 1200, overlap: int = 200) -> list[str]:
    """Paragraphs packed into chunks of at most ``most`` signs; a longer one is cut at its last blank, with ``overlap`` signs repeated."""
    overlap = max(0, min(overlap, most // 2))
    out: list[str] = []
    held = ""
    for p in (p for p in text.split("\n\n") if p.strip()):
        if held and len(held) + 2 + len(p) > most:
            out.append(held)
            held = ""
        if len(p) <= most:
            held = f"{held}\n\n{p}" if held else p
            continue
        while len(p) > most:
            cut = p.rfind(" ", 0, most)
            cut = cut if cut > overlap else most
            out.append(p[:cut])
            p = p[cut - overlap :].lstrip()
        held = p
    return out + [held] if held else out


def chunk_documents(docs: DataFrame, most: int = 1200, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_ix, chunk), in Arrow batches; null texts have no chunks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, c) for d, t in zip(pdf["doc_id"], pdf["text"]) if t for i, c in enumerate(split_document(t, most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_ix", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id long, chunk_ix int, chunk string")
