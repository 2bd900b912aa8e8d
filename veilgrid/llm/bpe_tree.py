"""Byte-level BPE by a monoid tree: encodings of neighbours are joined without encoding them again.

There are two trees of one kind. Within a match of the pattern (a piece), bytes are halved until at most BYTES are left;
those are merged by rank. Halves are joined at once if their border is stable, that is, if the last token of the one and the first of the
other, encoded together, stay those two; a row of tokens is what merging by rank gives exactly when each two neighbours
in it are stable. Else a window of tokens around the border is encoded anew, and grows until it ends at stable borders on
both sides, which proves all tokens outside it.

A whole text is halved until at most LEAF characters are left; a leaf's pieces are encoded one by one, a piece that the
ranks have as a whole being one token. Neighbours are joined by encoding a window of text around their border, which
grows until it ends at places where pieces break whatever stands around: before a space or line feed that follows a
letter or digit, since no alternative of the pattern matches white space after anything else, nor looks past such a
place. Without such a place a side grows to the end of its text. Decoding joins the bytes of the ids up the same tree.

Cases: null and empty texts have no ids; texts of any length and without white space are encoded whole; equal texts have
equal ids, repeated rows and ids one row each; null ids stay null; empty tables give no rows; other columns of the input
are ignored, whatever their names."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilgrid.llm.common import Known, remembering

#: Characters of a leaf of a text, and of a window's first half; bytes of a leaf of a piece.
LEAF, WINDOW, BYTES = 2048, 32, 32
#: Pieces, and borders, that a worker remembers. Beyond it the memory starts anew.
CACHE = 1_500_000
_STABLE = re.compile(r"(?<=[^\W_])(?=[ \n])")
_CODECS: dict[tuple[str, str], "TreeCodec"] = {}
_NEVER = 1 << 62


class TreeCodec:
    """Encodes and decodes by the ranks of a file, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, rank_file: str, pattern: str, leaf: int = LEAF, window: int = WINDOW, bytes_: int = BYTES):
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the ranks lack single bytes")
        # white space is that of the Unicode property, without the four separators that Python adds
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.leaf, self.window, self.bytes = leaf, window, bytes_
        self.known, self.borders = Known(self._piece), Known(self._border)

    # -- a piece --

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of some bytes: of all neighbours, those of the least rank are merged first, the leftmost of equals."""
        if len(data) < 2:
            return [data] if data else []
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [rank(data[i : i + 2], _NEVER) for i in range(len(data) - 1)]
        while costs and (least := min(costs)) < _NEVER:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], _NEVER)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], _NEVER)
        return parts

    def _border(self, two: tuple[bytes, bytes]) -> bool:
        return self.merged(two[0] + two[1]) == [*two]

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The tokens of two neighbours' bytes together."""
        stable = self.borders
        if not left or not right or stable[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            low, high = left[: len(left) - i], right[j:]
            window = self.merged(b"".join(left[len(left) - i :] + right[:j]))
            left_ok = not low or stable[low[-1], window[0]]
            right_ok = not high or stable[window[-1], high[0]]
            if left_ok and right_ok:
                return low + window + high
            i, j = i if left_ok else min(len(left), 2 * i), j if right_ok else min(len(right), 2 * j)

    def tokens(self, data: bytes) -> list[bytes]:
        """The tokens of a piece's bytes, by the tree."""
        if len(data) <= self.bytes:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self.tokens(data[:middle]), self.tokens(data[middle:]))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else [self.ranks[t] for t in self.tokens(data)]
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- a text --

    def _direct(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.pieces(text))), "<u4")

    def encode(self, text: str) -> np.ndarray:
        for held in (self.known, self.borders):
            if len(held) > CACHE:
                held.clear()
        parts = self._node(text, 0, len(text))
        return np.concatenate(parts) if len(parts) != 1 else parts[0]

    def _node(self, text: str, start: int, end: int) -> list[np.ndarray]:
        """The ids of text[start:end], as arrays in order."""
        if end - start <= self.leaf:
            return [self._direct(text[start:end])]
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._node(text, start, middle), self._node(text, middle, end))

    def _join(self, text: str, start: int, middle: int, end: int, left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
        grow, low, high = self.window, None, None
        while low is None or high is None:
            if low is None:
                # one character before the window, for the look behind
                cuts = [m.start() for m in _STABLE.finditer(text, max(start + 1, middle - grow), middle)]
                low = cuts[-1] if cuts else start if middle - grow <= start else None
            if high is None:
                cut = _STABLE.search(text, middle, min(end, middle + grow))
                high = cut.start() if cut else end if middle + grow >= end else None
            grow *= 2
        # what the window's halves have in either neighbour goes; the window's own ids take its place
        out = _drop_last(left, len(self._direct(text[low:middle])))
        out.append(self._direct(text[low:high]))
        return out + _drop_first(right, len(self._direct(text[middle:high])))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= 4 * self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _drop_last(parts: list[np.ndarray], n: int) -> list[np.ndarray]:
    parts = list(parts)
    while n:
        last = parts.pop()
        if len(last) > n:
            parts.append(last[: len(last) - n])
        n -= min(n, len(last))
    return parts


def _drop_first(parts: list[np.ndarray], n: int) -> list[np.ndarray]:
    return [x[::-1] for x in _drop_last([x[::-1] for x in reversed(parts)], n)][::-1]


def codec(rank_file: str, pattern: str) -> TreeCodec:
    """One codec per worker process."""
    remembering("bpe tree", _CODECS.clear)
    if (rank_file, pattern) not in _CODECS:
        _CODECS[rank_file, pattern] = TreeCodec(rank_file, pattern)
    return _CODECS[rank_file, pattern]


def round_trip(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            rows, ids = [], []
            for text in batch.column(1).to_pylist():
                found = c.encode(text or "")
                rows.append((len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(c.decode(found)).hexdigest()))
                if keep_ids:
                    ids.append(found.astype(np.int32))
            n, a, b = zip(*rows) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
