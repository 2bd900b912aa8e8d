"""Packing: sum-of-squares online packing of token pieces into windows.

A document of more than ``capacity`` tokens first gives whole windows of its own. What is left of it goes, without a look
ahead, to the fill level for which the sum over all levels of the squared number of partly filled windows becomes least;
those numbers are kept in a level array, and a window is closed when it is full.

Packing has two rounds of the same placing. In the first each task packs the documents of its own partition, so packing
moves no text and any lost task is simply run again. What its open windows hold at the end goes, with its ids, to the
second round, where a task goes on with what many tasks of the first left: one task for each ROUND_BYTES of it, so that
the level array decides on most short documents however finely the table is cut. What is open at the very end is joined
and cut at the capacity, and the last of it at powers of two, which need no padding.

A task holds at most ``held_bytes`` of ids in open windows, whatever the lengths: beyond it, windows of the level that has
most of them, which lowers the sum of squares most, move on as those open at the end do. Nothing is padded or dropped.

Cases: a null text counts as empty and gives its end id alone; empty tables give no rows; repeated rows and null ids are
packed each for itself; ties between levels go to the fullest window; very long texts give whole windows as they are
encoded; other columns of the input are ignored, whatever their names."""

from __future__ import annotations

import math
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.llm.chunks import encoder
from veilgrid.llm.common import written

CAPACITY = 1024
#: Bytes of ids in the open windows of a task; bytes that a task of the second round packs; bytes that move together.
HELD_BYTES, ROUND_BYTES, BUNDLE_BYTES = 64 << 20, 128 << 20, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
_LEFT = SCHEMA + ", ids binary, bundle long, place long"
_LEFT_ARROW = pa.schema([*ARROW, ("ids", pa.binary()), ("bundle", pa.int64()), ("place", pa.int64())])
#: A task's sequences are numbered from its partition's number times STRIDE, those of the second round from SECOND on.
STRIDE, SECOND = 1 << 33, 1 << 62

#: doc_id, start, ids, doc_tokens
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """Packs pieces and hands out ``rows`` of windows that are closed. ``moved`` takes the pieces of windows that are open
    at the end or beyond ``held_bytes``; without it they are joined and cut."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, held_bytes: int = HELD_BYTES, moved: Callable[[list[Piece]], None] | None = None):
        self.capacity, self.held_bytes, self.next = capacity, held_bytes, first_sequence
        self.moved = moved or self._joined
        self.level = np.zeros(capacity + 1, dtype=np.int64)  # how many windows are filled up to each level
        self.windows: list[deque[list[Piece]]] = [deque() for _ in range(capacity + 1)]
        self.held = 0  # bytes in open windows
        self.rows: list[tuple] = []
        self.joint: list[Piece] = []
        self.joint_size = 0

    def _emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def choose(self, size: int) -> int:
        """The level to place a piece of ``size`` tokens on; 0 is a new window."""
        top = self.capacity - size
        if top <= 0:
            return 0
        here, there = self.level[1 : top + 1], self.level[1 + size : top + 1 + size].copy()
        # moving a window from level h to h + size changes the sum by 2 (N[h + size] - N[h]) + 2; a full one leaves it
        change = 2 * (there - here) + 2
        change[-1] = 1 - 2 * here[-1]
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * int(self.level[size]) + 1 else 0

    def add_document(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.capacity
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._emit([(doc_id, at // 4, ids[at : at + step], total)])
        if whole < len(ids):
            self.add((doc_id, whole // 4, ids[whole:], total))

    def add(self, piece: Piece) -> None:
        """Places a piece that is shorter than a window."""
        size = len(piece[2]) // 4
        h = self.choose(size)
        window = self._taken(h) if h else []
        window.append(piece)
        if h + size == self.capacity:
            self._emit(window)
            return
        self.level[h + size] += 1
        self.windows[h + size].append(window)
        self.held += 4 * (h + size)
        while self.held > self.held_bytes:
            self.moved(self._taken(int(np.argmax(self.level)), oldest=True))

    def _taken(self, h: int, oldest: bool = False) -> list[Piece]:
        self.level[h] -= 1
        self.held -= 4 * h
        return self.windows[h].popleft() if oldest else self.windows[h].pop()

    def _joined(self, pieces: list[Piece]) -> None:
        """Joins pieces one after another and cuts them at the capacity."""
        for doc, start, ids, total in pieces:
            while ids:
                part = ids[: 4 * (self.capacity - self.joint_size)]
                n = len(part) // 4
                self.joint.append((doc, start, part, total))
                self.joint_size += n
                start, ids = start + n, ids[4 * n :]
                if self.joint_size == self.capacity:
                    self._emit(self.joint)
                    self.joint, self.joint_size = [], 0

    def close(self) -> None:
        """Lets all open windows move on, fullest first; what was joined and fills no window is cut at powers of two."""
        for h in range(self.capacity - 1, 0, -1):
            while self.level[h]:
                self.moved(self._taken(h))
        rest, left, capacity = self.joint, self.joint_size, self.capacity
        self.joint, self.joint_size = [], 0
        for k in reversed(range(left.bit_length())):
            if left >> k & 1:
                self.capacity, taken = 1 << k, 0
                while taken < 1 << k:
                    doc, start, ids, total = rest[0]
                    n = min(len(ids) // 4, (1 << k) - taken)
                    rest[:1] = [(doc, start + n, ids[4 * n :], total)] if 4 * n < len(ids) else []
                    taken += n
                    self._joined([(doc, start, ids[: 4 * n], total)])
        self.capacity = capacity


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        end = int(end_id).to_bytes(4, "little")
        task = TaskContext.get().partitionId()
        left: list[Piece] = []
        packer = SumOfSquares(task * STRIDE, capacity, held_bytes, left.extend)
        bundle, size, place = task << 32, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal bundle, size, place
            rows = [(*r, None, None, None) for r in packer.rows]
            for doc, start, ids, total in left:
                rows.append((doc, start, len(ids) // 4, None, total, None, None, ids, bundle, place))
                size, place = size + len(ids), place + 1
                if size >= BUNDLE_BYTES:
                    bundle, size = bundle + 1, 0
            packer.rows = []
            left.clear()
            columns = list(zip(*rows)) or [()] * len(_LEFT_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEFT_ARROW)], schema=_LEFT_ARROW)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                for i, found in zip(ids[at : at + 256], encode(batch.column(1).slice(at, 256).to_pylist())):
                    packer.add_document(i, found + end)
            yield out()
        packer.close()
        yield out()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(SECOND + TaskContext.get().partitionId() * STRIDE, capacity, held_bytes)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * len(ARROW)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW)

        for batch in batches:
            for piece in zip(*(batch.column(k).to_pylist() for k in range(4))):
                packer.add(piece)
            yield out()
        packer.close()
        yield out()

    done = written(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(first, _LEFT), "packed")
    left = done.where("ids is not null")
    size = left.agg(F.sum("length")).first()[0] or 0
    # bundles are dealt by their number and come in order, so that a task that is run again packs the same way
    dealt = left.select("doc_id", "start", "ids", "doc_tokens", "bundle", "place").repartition(max(1, math.ceil(4 * size / ROUND_BYTES)), "bundle")
    rest = dealt.sortWithinPartitions("bundle", "place").mapInArrow(second, SCHEMA)
    return done.where("ids is null").select(*ARROW.names).unionByName(rest)
