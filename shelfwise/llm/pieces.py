"""Encoding by distinct pieces: a tokenizer is asked once per piece, a task keeps what it has seen.

Pieces are cut only where the tokenizer itself always cuts, so joining their ids gives
exactly the ids of the text. For a tokenizers file whose pre-tokens hold no white space
that is before and after an ASCII space or line feed, and between a letter and an ASCII
character that is none; texts that hold a special token's string are given to the
library whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .words import SLICE, Text, texts

#: Distinct pieces that a task keeps, and pieces per call.
KEEP, JOINED = 1_500_000, 512

_SPACE = np.zeros(256, bool)
_SPACE[[10, 32]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[97:123] = True
_OTHER = np.zeros(256, bool)  # ASCII that is no letter
_OTHER[:128] = True
_OTHER[65:91] = _OTHER[97:123] = False


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a piece begins at a byte (of lower-cased text), as a text's first one does not tell."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    before, here = data[:-1], data[1:]
    letter = _ALPHA[before]
    # two-byte letters from U+00C0 to U+00FF, but for the signs for times and divide
    latin = np.zeros(len(before), bool)
    latin[1:] = (data[:-2] == 0xC3) & (before[1:] >= 0x80) & (before[1:] < 0xC0) & (before[1:] != 0x97) & (before[1:] != 0xB7)
    out[1:] = _SPACE[before] | _SPACE[here] | ((letter | latin) & _OTHER[here])
    return out


class Pieces:
    """What a task knows of distinct pieces: their ids and some flags.

    ``encode`` takes pieces and tells for each its number of ids, all ids in order,
    and one row of flags.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.ask = encode
        self.clear()

    def clear(self) -> None:
        # sorted hashes and the number of each: 16 bytes a piece, where a dict takes ten times that
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts, self.flags = np.zeros(0, np.uint32), np.zeros(1, np.int64), None

    def find(self, hashes: np.ndarray, piece: Callable[[int], object]) -> np.ndarray:
        """Number of each piece by its hash; ``piece(i)`` gives what to encode for entry ``i``."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > KEEP:
            self.clear()
        place = np.searchsorted(self.known, distinct)
        held = np.zeros(len(distinct), bool)
        inside = place < len(self.known)
        held[inside] = self.known[place[inside]] == distinct[inside]
        new = np.flatnonzero(~held)
        if len(new):
            n, ids, flags = self.ask([piece(i) for i in first[new].tolist()])
            named = np.arange(len(self.known), len(self.known) + len(new))
            self.number = np.insert(self.number, place[new], named)
            self.known = np.insert(self.known, place[new], distinct[new])
            self.ids = np.concatenate((self.ids, ids))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(n)))
            self.flags = flags if self.flags is None else np.concatenate((self.flags, flags))
            place = np.searchsorted(self.known, distinct)
        return self.number[place][inverse]

    def joined(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids in order."""
        n = self.starts[place + 1] - self.starts[place]
        if not len(n):
            return n, self.ids[:0]
        skip = np.repeat(self.starts[place] - (np.cumsum(n) - n), n)
        return n, self.ids[skip + np.arange(int(n.sum()))]


class WordEncoder:
    """Holds a tokenizer file, checked to be one that this way of encoding is exact for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        spec = json.loads(self.json)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = split.get("pattern", {}).get("Regex", "")
        if split.get("behavior") != "Removed" or not split.get("invert") or r"[\p{L}]+" not in pattern or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("encoding by pieces is exact only for lower-casing tokenizers that drop white space")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._ready = None

    def share(self, spark: SparkSession):
        return spark.sparkContext.broadcast(self)

    def __getstate__(self):
        return {"json": self.json, "special": self.special, "_ready": None}

    def ready(self) -> Encoder:
        if self._ready is None:
            self._ready = Encoder(self.json, self.special)
        return self._ready


class Encoder:
    def __init__(self, spec: str, special: list[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [s.lower().encode() for s in special]
        self.separator = special[0]
        self.mark = self.tokenizer.token_to_id(self.separator)
        self.pieces = Pieces(self.learn)

    def whole(self, rows: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encodes new pieces, several per call with a special token between two of them."""
        lengths, ids = [], []
        for at in range(0, len(pieces), JOINED):
            (found,) = self.whole([self.separator.join(pieces[at : at + JOINED])])
            ends = np.append(np.flatnonzero(found == self.mark), len(found))
            lengths.append(np.diff(np.concatenate(([-1], ends))) - 1)
            ids.append(found[found != self.mark])
        return np.concatenate(lengths), np.concatenate(ids), np.zeros((len(pieces), 0), bool)

    def slice(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Tokens per row, and the ids of all rows in order."""
        data, offsets = text.data, text.offsets
        begin = cuts(data)
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))[: len(start)]
        full = ~(_SPACE[data[start]] & (end - start == 1))
        start, end = start[full], end[full]
        place = self.pieces.find(text.hashes(start, end), lambda i: text.string(start[i], end[i]))
        n, ids = self.pieces.joined(place)
        row = np.searchsorted(offsets, start, "right") - 1
        return np.bincount(row, n, text.rows).astype(np.int64), ids

    def encode(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, tokens per row (with the end id) and ids, for one slice of rows after the other."""
        column = column.fill_null("")
        for text in texts(column, lower=True, size=SLICE):
            low = text.data.tobytes()
            if any(s in low for s in self.special):
                rows = self.whole(column.slice(text.first, text.rows).to_pylist())
                n, ids = np.array([len(r) for r in rows], np.int64), np.concatenate(rows)
            else:
                n, ids = self.slice(text)
            ends = np.cumsum(n)
            yield text.first, n + 1, np.insert(ids, ends, end_id).astype(np.uint32)
