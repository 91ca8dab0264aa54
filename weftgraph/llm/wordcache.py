"""Whole texts through a public tokenizer, its parts called once for each distinct stretch between blanks.

Cutting is safe where both neighbours of a single blank are not white space: the pre-tokenizers of the two
vocabularies never match across such a place, so ids of the stretches, joined, are the ids of the text.  A
stretch that was not met before goes through the library's normalizer, pre-tokenizer and merge model.

``encode_many`` cuts a column of texts in Arrow, looks up each distinct stretch of the column once and gathers the ids
by the stretches' numbers, so Python touches distinct stretches only.  A text that holds an added token of the vocabulary
(such as '<|endoftext|>') goes whole through the library, which gives that token its own id.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import shared

#: A blank between two characters that are not white space; the blank goes with what follows.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: Blanks that are not such gaps, or white space beside one.
_UNEVEN = re.compile(r"\s | \s|^ | $")
#: The same for Arrow's expressions, with the white space that Python's ``\s`` means.
_UNEVEN_ARROW = r"[\x09-\x0d\x1c-\x20\x{85}\pZ] | [\x09-\x0d\x1c-\x20\x{85}\pZ]|^ | $"
#: Signs that are a piece of their own behind letters.
_SIGNS = frozenset(".,;:?!")
#: White space that every regular-expression dialect agrees on; longer-range kinds stay inside a stretch.
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


class _Ids(dict):
    """Stretch to ids; what is missing is encoded on the way and kept while there is room."""

    def __init__(self, encode, entries: int, longest: int):
        self._encode, self._entries, self._longest = encode, entries, longest

    def __missing__(self, stretch: str) -> bytes:
        # ASCII letters and one sign of punctuation are two pieces wherever they stand, so their ids come from the parts.
        body, sign = stretch[:-1], stretch[-1:]
        ids = self[body] + self[sign] if sign in _SIGNS and body.isascii() and body[1:].isalpha() and (body[0].isalpha() or body[0] == " ") else self._encode(stretch)
        if len(stretch) <= self._longest and len(self) < self._entries:
            self[stretch] = ids
        return ids


class CachedTokenizer:
    """Ids of whole texts as little-endian bytes of ``dtype``; memory is bounded by ``entries`` stretches.

    ``keeps_space``: the vocabulary encodes blanks with the word that follows (byte level); otherwise white
    space only separates words.  A first or last stretch with white space at its edge is encoded whole.
    """

    def __init__(self, path: str, keeps_space: bool, dtype: str = "<u4", entries: int = 900_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._model, self._pre, self._normal = self._tok.model, self._tok.pre_tokenizer, self._tok.normalizer
        self._keeps_space, self._dtype = keeps_space, dtype
        self._inner = _Ids(self._by_parts, entries, longest)
        self._edge = _Ids(self._whole, entries // 20, longest)

    def _whole(self, text: str) -> bytes:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, dtype=self._dtype).tobytes()

    def _by_parts(self, stretch: str) -> bytes:
        if len(stretch) > 2000:
            return self._whole(stretch)
        text = self._normal.normalize_str(stretch) if self._normal else stretch
        return np.array([t.id for piece, _ in self._pre.pre_tokenize_str(text) for t in self._model.tokenize(piece)], dtype=self._dtype).tobytes()

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a column without nulls."""
        by_hand = np.zeros(len(texts), bool)
        for content in self._added:
            by_hand |= np.asarray(pc.match_substring(texts, content))
        if self._keeps_space:
            by_hand |= np.asarray(pc.match_substring_regex(texts, _UNEVEN_ARROW))
            words = pc.split_pattern(texts, " ")
        else:
            words = pc.ascii_split_whitespace(texts)
        at, flat = words.offsets.to_numpy(), words.values
        coded = flat.dictionary_encode()
        known = coded.dictionary.to_pylist()
        ids = list(map(self._inner.__getitem__, [" " + x for x in known] if self._keeps_space else known))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        number = coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[number]))
        data = memoryview(pa.array(ids, pa.binary()).take(coded.indices).buffers()[2] or b"")
        if not self._keeps_space:
            cut = ends[at]
            out = [bytes(data[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        else:
            # The first stretch has no blank before it; the last may end in white space, which merges by another rule at a text's end.
            first, last = flat.take(pa.array(at[:-1])).to_pylist(), flat.take(pa.array(np.maximum(at[1:] - 1, 0))).to_pylist()
            several = at[1:] - at[:-1] > 1
            edge = several & np.fromiter((x[-1:].isspace() for x in last), bool, len(last))
            a, b = ends[np.minimum(at[:-1] + 1, at[1:])], ends[at[1:] - edge]
            out = [self._edge[x] + data[i:j] for x, i, j in zip(first, a.tolist(), b.tolist())]
            for k in np.flatnonzero(edge):
                out[k] += self._edge[" " + last[k]]
        for k in np.flatnonzero(by_hand):
            out[k] = self.encode(texts[k].as_py())
        return out

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self._added):
            return self._whole(text)
        if not self._keeps_space:
            return b"".join(map(self._inner.__getitem__, _ASCII_SPACE.split(text)))
        parts = _GAP.split(text) if _UNEVEN.search(text) else text.split(" ")
        first, last = parts[0], parts.pop() if len(parts) > 1 else None
        ids = self._edge[first] + b"".join(map(self._inner.__getitem__, [" " + x for x in parts[1:]]))
        if last is None:
            return ids
        return ids + (self._edge[" " + last] if last[-1:].isspace() else self._inner[" " + last])


def cached_tokenizer(path: str, keeps_space: bool, dtype: str) -> CachedTokenizer:
    """One for each worker process."""
    made, key = shared.kept("words"), (path, keeps_space, dtype)
    if key not in made:
        made[key] = CachedTokenizer(path, keeps_space, dtype)
    return made[key]
