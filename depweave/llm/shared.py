"""A bitmap of the 64-bit hashes that occur in more than one document.

It only spares work: a wrong bit lets a hash through that has no partner.  It has a fixed
size, so it can be broadcast whatever the corpus; beyond some 10 million shared hashes it
lets more and more through and later joins do the work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap (16 MB).
BITMAP = 1 << 27


def range_bits(expected: int) -> int:
    """Bits of the hash that name a range, for ranges of about a million hashes."""
    return min(20, max(6, (expected >> 18).bit_length()))


class Gathered:
    """Hashes of many blocks with whether two documents had them, sent as one row per hash range."""

    NAMES = ["part", "ids", "many"]
    SCHEMA = "part bigint, ids binary, many binary"

    def __init__(self, bits: int):
        self.bits, self.found, self.size = bits, [], 0

    def add(self, hashes: np.ndarray, owner: np.ndarray) -> None:
        """``hashes`` (uint64) of one block; ``owner``: a number that tells its documents apart."""
        if not len(hashes):
            return
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        last = np.append(first[1:], len(hashes)) - 1
        self.found.append((hashes[first], owner[first] != owner[last]))
        self.size += len(first)

    def batch(self) -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in self.found])
        many = np.concatenate([x[1] for x in self.found])
        self.found, self.size = [], 0
        order = np.argsort(h)
        h, many = h[order], many[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        # in two blocks (of different documents) or in two documents of one block
        many = np.logical_or.reduceat(many, first) | (np.diff(np.append(first, len(h))) > 1)
        h = h[first]
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        end = np.append(cut[1:], len(h))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(part[cut], pa.int64()),
                pa.array([(h[a:b] >> np.uint64(16)).astype("<u4").tobytes() + h[a:b].astype("<u2").tobytes() for a, b in zip(cut, end)], pa.binary()),
                pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(cut, end)], pa.binary()),
            ],
            names=self.NAMES,
        )


def _slice(bits: int) -> Callable:
    """applyInPandas over one hash range: its slice of the bitmap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, many = [], []
        for blob, flags in zip(pdf["ids"], pdf["many"]):
            n = len(blob) // 6
            ids.append((np.frombuffer(blob, "<u4", n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64))
            many.append(np.unpackbits(np.frombuffer(flags, np.uint8))[:n].astype(bool))
        h, flag = np.concatenate(ids), np.concatenate(many)
        order = np.argsort(h)
        h, flag = h[order], flag[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        shared = h[first[np.logical_or.reduceat(flag, first) | (np.diff(np.append(first, len(h))) > 1)]]
        places = BITMAP >> bits
        where = np.zeros(places, bool)
        where[shared.astype(np.int64) & (places - 1)] = True
        return pd.DataFrame({"part": pdf["part"][:1], "slice": [np.packbits(where).tobytes()]})

    return run


def shared_bitmap(gathered: DataFrame, bits: int):
    """Broadcast of the bitmap; what reaches the driver is its ``BITMAP`` bits, never the hashes."""
    return _broadcast(gathered.groupBy("part").applyInPandas(_slice(bits), "part bigint, slice binary"), bits)


def _broadcast(slices: DataFrame, bits: int, whole: int = BITMAP):
    size = (whole >> bits) // 8
    bitmap = bytearray(whole // 8)
    for r in slices.collect():
        bitmap[r["part"] * size : (r["part"] + 1) * size] = r["slice"]
    return slices.sparkSession.sparkContext.broadcast(bytes(bitmap))


def marked(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Which ``hashes`` have their bit."""
    places = (8 * len(bitmap)) >> bits
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64) * places + (hashes.view(np.int64) & (places - 1))
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def scatter(ids: np.ndarray) -> np.ndarray:
    """Integers as hashes (one to one), since neighbouring ids would share a range."""
    h = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(scatter(batch.column(0).to_numpy(zero_copy_only=False)).view(np.int64))], names=["name"])


def rows_of(rows: DataFrame, ids: DataFrame, bits: int = 8) -> DataFrame:
    """The rows whose first column (an id, not null) is among ``ids`` (one column), and few others: a filter without a shuffle of ``rows``."""
    return parted(rows, ids, bits)[0]


def forget(*frames: DataFrame) -> None:
    """Destroy the bitmaps of frames that ``rows_of`` or ``parted`` made, once what was made of them is stored."""
    for f in frames:
        f.bitmap.destroy()


def _marks(bits: int, whole: int) -> Callable:
    """applyInPandas over the names of one range: its slice of the bitmap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        where = np.zeros(whole >> bits, bool)
        where[pdf["name"].to_numpy() & ((whole >> bits) - 1)] = True
        return pd.DataFrame({"part": pdf["part"][:1], "slice": [np.packbits(where).tobytes()]})

    return run


def bitmap_of(names: DataFrame, column: str, bits: int, many: int | None = None):
    """Broadcast bitmap of a column of 64-bit names, by the same places as above: some 64 bits a name, up to ``BITMAP``; ``many``: about how many there are, if that is known."""
    whole = min(BITMAP, 1 << max(bits + 10, (64 * (names.count() if many is None else many)).bit_length()))
    ranged = names.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("part"), F.col(column).alias("name"))
    return _broadcast(ranged.groupBy("part").applyInPandas(_marks(bits, whole), "part bigint, slice binary"), bits, whole)


def _has(marks, bits: int) -> Callable:
    """Whether an id has its bit; a column function, so that only ids pass through Python and the rest of a row does not."""

    @F.arrow_udf("boolean")
    def has(ids: pa.Array) -> pa.Array:
        return pa.array(marked(scatter(ids.to_numpy(zero_copy_only=False)), np.frombuffer(marks.value, np.uint8), bits))

    return has


def ids_bitmap(ids: DataFrame, bits: int):
    """Broadcast bitmap of the hashes of ids (one column)."""
    return bitmap_of(ids.mapInArrow(_scattered, "name bigint"), "name", bits)


def parted(rows: DataFrame, ids: DataFrame, bits: int = 8) -> tuple[DataFrame, DataFrame]:
    """(the rows whose first column, an id that is not null, is among ``ids``, and few others; the rest), without a shuffle of ``rows``."""
    bitmap = ids_bitmap(ids, bits)
    has = _has(bitmap, bits)(F.col(f"`{rows.columns[0]}`"))
    found = tuple(rows.filter(x) for x in (has, ~has))
    for f in found:
        f.bitmap = bitmap
    return found


def packed(columns: tuple[str, ...]):
    """Columns of any names as one struct, so that they meet no working column."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def unpacked(struct: str, columns: tuple[str, ...]) -> list:
    """The columns of ``packed`` under their own names."""
    return [F.col(struct)[f"c{i}"].alias(c) for i, c in enumerate(columns)]


def free(taken: list[str], *wanted: str) -> tuple[str, ...]:
    """``wanted`` names, with underscores in front until no name of ``taken`` (in any case) is met."""
    lower, out = {c.lower() for c in taken}, []
    for w in wanted:
        while w.lower() in lower:
            w = "_" + w
        lower.add(w.lower())
        out.append(w)
    return tuple(out)
