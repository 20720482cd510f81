"""Bounded-space online packing of tokenized documents into sequences.

A task packs the documents of its partition in one pass while it tokenizes them.  It
keeps ``WINDOWS`` open windows; a document that is longer than a window first fills
windows of its own.  What is left goes where it fits best (into the smallest gap that
takes it whole), else opens a window.  When all windows are open and none takes it, the
fullest one is filled up with the head of the document and emitted, and the rest is
placed again.  So a window is emitted full, and a task holds no more than its open ones,
however large its partition is.

What is open at the end is left over.  Leftovers of ``MERGED`` partitions are merged by
the same rule, the longest first, in tasks of their own; what a merge cannot fill (less
than one sequence) is cut into sequences whose lengths are powers of two, which need no
padding.  So no sequence is padded at all; documents are cut for it where no window takes
them whole.

Edge cases: null text is empty and yields its end token; repeated rows are packed
separately; an empty table gives no rows; other columns are not read; a document's pieces
keep its order of ids and none is empty.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm.bpe import ChunkMemo, _blocks, chunks
from depweave.session import written

#: Open windows of a task, and partitions whose leftovers are merged in one task.
WINDOWS, MERGED = 64, 64
#: doc_id, start, ids, doc_tokens: ids are little-endian unsigned 32-bit integers.
Piece = tuple[int | None, int, bytes, int]

_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part bigint, ids binary"
RESULT = _NAMES[:7]


class IdMemo(ChunkMemo):
    """``known``: chunk -> its ids as little-endian unsigned 32-bit integers."""

    def made(self, chunk: str) -> bytes:
        return np.array(self.ids_of(chunk), "<u4").tobytes()


class Windows:
    """The open windows: pieces of each and what is still free, in order of the gap."""

    def __init__(self, most: int, windows: int, emit: Callable[[list[Piece]], None]):
        self.most, self.windows, self.emit = most, windows, emit
        self.gaps: list[int] = []  # in rising order
        self.open: list[list[Piece]] = []  # of the same places

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        """Place ids that follow ``start`` others of a document of ``total`` tokens."""
        most = self.most
        while len(ids) > 4 * most:
            self.emit([(doc, start, ids[: 4 * most], total)])
            start, ids = start + most, ids[4 * most :]
        while True:
            n = len(ids) // 4
            at = bisect_left(self.gaps, n)
            if at == len(self.gaps) and n < most and len(self.gaps) >= self.windows:
                gap, pieces = self.gaps.pop(0), self.open.pop(0)
                pieces.append((doc, start, ids[: 4 * gap], total))
                self.emit(pieces)
                start, ids = start + gap, ids[4 * gap :]
                continue
            gap, pieces = (self.gaps.pop(at), self.open.pop(at)) if at < len(self.gaps) and n < most else (most, [])
            pieces.append((doc, start, ids, total))
            if gap == n:
                self.emit(pieces)
            else:
                at = bisect_left(self.gaps, gap - n)
                self.gaps.insert(at, gap - n)
                self.open.insert(at, pieces)
            return

    def close(self) -> list[list[Piece]]:
        """What is still open, the fullest first."""
        rest, self.gaps, self.open = self.open, [], []
        return rest


class _Rows:
    """Piece rows, gathered until they make a batch."""

    def __init__(self, first_id: int):
        self.columns: list[list] = [[] for _ in _NAMES]
        self.sequence, self.last = first_id, first_id

    def put(self, pieces: list[Piece], part: int | None = None) -> None:
        """One window's pieces; those of a ``part`` are left over, with their ids and without a place."""
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            place = (self.last, offset, None, None) if part is None else (None, None, part, ids)
            for column, value in zip(self.columns, (doc, start, n, zlib.crc32(ids), total, *place)):
                column.append(value)
            offset += n
        if part is None:
            self.last += 1

    def __len__(self) -> int:
        return len(self.columns[0])

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(_NAMES, self.columns)]
        self.columns = [[] for _ in _NAMES]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _pack_partition(path: str, most: int, windows: int) -> Callable:
    """mapInArrow over (doc_id, text): the pieces of emitted windows, then those left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = IdMemo.of(path), TaskContext.get().partitionId()
        rows = _Rows(part << 32)
        packer = Windows(most, windows, rows.put)
        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for block in _blocks(batch.column(1).to_pylist()):
                memo.trim()
                for text in block:
                    ids = b"".join(map(memo.known.__getitem__, chunks(text) if text else [])) + bytes(4)
                    packer.add(next(docs), 0, ids, len(ids) // 4)
                if len(rows) > 10_000:
                    yield rows.batch()
        for pieces in packer.close():
            rows.put(pieces, part)
        if len(rows):
            yield rows.batch()

    return run


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in sequences whose lengths are falling powers of two."""
    left = sum(len(p[2]) for p in pieces) // 4
    queue = pieces[::-1]
    while left:
        size = gap = 1 << (left.bit_length() - 1)
        row = []
        while gap:
            doc, start, ids, total = queue.pop()
            n = min(gap, len(ids) // 4)
            row.append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                queue.append((doc, start + n, ids[4 * n :], total))
            gap -= n
        yield row
        left -= size


def merge_leftovers(pieces: list[Piece], most: int, windows: int, emit: Callable[[list[Piece]], None]) -> None:
    """Pack leftovers, the longest first; windows that stay open are filled from the least full ones, the rest cut into powers of two."""
    packer = Windows(most, windows, emit)
    for p in sorted(pieces, key=lambda p: -len(p[2])):
        packer.add(*p)
    rest = Windows(most, 1, emit)  # one window: each piece fills it up
    for held in packer.close():
        for p in held:
            rest.add(*p)
    for held in rest.close():
        for row in powers_of_two(held):
            emit(row)


def _merge(most: int, windows: int) -> Callable:
    """applyInPandas over the leftovers of some partitions; sequence ids follow those that partitions can give."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "doc_id", "start", "ids_crc32"], kind="stable")
        rows = _Rows((1 << 62) + (int(pdf["merge"].iloc[0]) << 24))
        ids = lambda v: None if pd.isna(v) else int(v)
        pieces = [(ids(d), int(s), bytes(i), int(t)) for d, s, i, t in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"])]
        merge_leftovers(pieces, most, windows, rows.put)
        return rows.batch().select(RESULT).to_pandas(types_mapper=pd.ArrowDtype)

    return run


def pack_stream(docs: DataFrame, path: str, *, most: int = 1024, windows: int = WINDOWS, merged: int = MERGED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece, all documents."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pack_partition(path, most, windows), _SCHEMA)
    placed = written(rows)
    left = placed.filter("part is not null").withColumn("merge", F.floor(F.col("part") / merged).cast("bigint"))
    schema = ", ".join(f"{c} bigint" for c in RESULT)
    return placed.filter("part is null").select(RESULT).unionByName(left.groupBy("merge").applyInPandas(_merge(most, windows), schema))
