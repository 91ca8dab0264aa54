"""Pages and paged services: HTML to text, next links, records in JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose text is not content.
HIDDEN = {"script", "style", "noscript", "template", "svg"}


class _Text(HTMLParser):
    """Runs of visible text.  ``_open`` holds the hidden elements and the title that are open; what is innermost decides where a run goes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[tuple[str, str]] = []
        self._open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN or (tag == "title" and not self._open):
            self._open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        where = self._open[-1] if self._open else "body"
        if where not in HIDDEN and (run := " ".join(data.split())):
            self.runs.append((where, run))


def html_to_text(html: str) -> tuple[str, str]:
    """(title, text): a line for each run of visible text."""
    p = _Text()
    p.feed(html)
    p.close()
    return next((run for where, run in p.runs if where == "title"), ""), "\n".join(run for where, run in p.runs if where == "body")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, title, text), in Arrow batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [html_to_text(h or "") for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [g[0] for g in got], "text": [g[1] for g in got]})

    return pages.select("page_id", "html").mapInPandas(work, "page_id long, title string, text string")


def next_link(header: str | None) -> str | None:
    """The target of a Link header's entry with rel=next."""
    for target, params in re.findall(r"<([^>]*)>([^<]*)", header or ""):
        if re.search(r';\s*rel\s*=\s*"?[^";,]*\bnext\b', params, re.I):
            return target
    return None


def dig(record: Any, path: str) -> Any:
    """A value by its dotted path; numbers index lists; None where it ends early."""
    for part in path.split(".") if path else []:
        if isinstance(record, dict):
            record = record.get(part)
        elif isinstance(record, list) and part.isdigit() and int(part) < len(record):
            record = record[int(part)]
        else:
            return None
    return record


def json_records(raw: DataFrame, column: str, records: str, fields: dict[str, str]) -> DataFrame:
    """A row for each record of the JSON list at ``records``, with the named dotted paths as strings."""
    rows = raw.select(F.explode(F.from_json(F.get_json_object(column, f"$.{records}"), "array<string>")).alias("r"))
    return rows.select(*[F.get_json_object("r", f"$.{path}").alias(name) for name, path in fields.items()])


def page_infos(data: Any, most: int = 100_000) -> Iterator[dict]:
    """The pageInfo objects of a GraphQL answer, however deep, without recursion; an answer of more than ``most`` values is refused."""
    todo, seen = [data], 0
    while todo:
        seen += 1
        if seen > most:
            raise ValueError(f"an answer of more than {most} values")
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("pageInfo"), dict):
                yield x["pageInfo"]
            todo += [v for v in x.values() if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            todo += [v for v in x if isinstance(v, (dict, list))]


def has_next_page(data: Any) -> bool:
    """Whether a GraphQL answer holds a page with more after it, as its pageInfo says."""
    return any(info.get("hasNextPage") is True for info in page_infos(data))


def pages_of(fetch: Callable[[str], tuple[str, str | None]], first: str, cursor: str | None = None, most: int = 100) -> Iterator[str]:
    """The bodies of a paged service: ``fetch`` takes an address and gives a body and its Link header.  The next address is the Link header's, or the first with the
    ``cursor`` (a dotted path) of the body; a page that was met before, an empty cursor or ``most`` pages end it."""
    url, met = first, set()
    while url and url not in met and len(met) < most:
        met.add(url)
        body, header = fetch(url)
        yield body
        if cursor is None:
            url = next_link(header)
            continue
        try:
            mark = dig(json.loads(body), cursor)
        except ValueError:
            return
        url = f"{first}{'&' if '?' in first else '?'}cursor={quote(str(mark), safe='')}" if mark else None


def read_paged(spark: SparkSession, starts: list[str], fetch: Callable[[str], tuple[str, str | None]], cursor: str | None = None, most: int = 100) -> DataFrame:
    """(start, page, body) of several paged services, each walked by one task: pages of one service follow each other."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in pdf["start"]:
                for i, body in enumerate(pages_of(fetch, start, cursor, most)):
                    yield pd.DataFrame({"start": [start], "page": [i], "body": [body]})

    rows = spark.createDataFrame([(s,) for s in starts], "start string").repartition(max(1, len(starts)))
    return rows.mapInPandas(work, "start string, page int, body string")
