"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document of a
smaller id.  Strings are dealt to tasks by content: each takes the smallest hash of the
16-byte grams in it (its minimizer), so equal strings meet; neighbours with the same
minimizer form one segment.

1. Minimizers are gathered, equal ones of a batch once, into hash ranges; those seen in two
   documents set a bit of a bitmap of fixed size, which only spares work: a wrong bit
   costs a segment, never a result.
2. Segments whose minimizer has its bit are written with their places; equal ones of a
   batch carry their bytes once.
3. The distinct segments of a hash range are split into two shards, each sorted into its
   Burrows-Wheeler transform.  The two are merged by refining their interleave: a stable
   sort of the interleaved symbols per step orders all suffixes by one symbol more.
   Neighbours of the merged order whose common prefix reaches ``LENGTH`` are one
   repeated interval; its smallest document is kept.  (Strings whose hash is single in
   the task are left out beforehand.)
4. Places join those answers by segment (a skewed segment is split by the engine) and
   the removed ranges go back to their documents.

Edge cases: null text is empty; a null id is no document's elder and loses nothing; rows
that share an id do not remove each other's bytes; texts shorter than ``LENGTH`` bytes
stay; repeats inside one document stay; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm import shared
from depweave.session import cut, discard, release, small_batches, written

LENGTH = 50
GRAM = 16
#: Bytes hashed at once, and minimizers gathered before rows of them are sent.
BLOCK = 1 << 20
GATHER = 1_000_000
#: Windows of a segment at most, and segment bytes of a task.
LONGEST = 1024
BUCKET = 2 << 20
#: Rows of the list of whole copies up to which it is broadcast (16 bytes each).
COPIES = 2_000_000


def minimizers(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """The smallest 16-byte-gram hash of each ``length``-byte string of ``raw`` (uint64)."""
    grams = len(raw) - GRAM + 1
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    word = np.ndarray((grams + 8,), "<u8", raw, strides=(1,)) if grams + 8 <= len(raw) - 7 else None
    a = word[:grams] if word is not None else np.ndarray((grams,), "<u8", raw, strides=(1,))
    b = np.ndarray((grams,), "<u8", raw, 8, strides=(1,))
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15)
        h ^= (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    width, step = length - GRAM + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h if step == width else np.minimum(h[: len(h) - (width - step)], h[width - step :])


def segments(raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, text number, start in the joined bytes, windows, minimizer) of each segment."""
    joined = b"".join(raws)
    low = minimizers(joined)
    if not len(low):
        none = np.zeros(0, np.int64)
        return joined, none, none, none, low
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(raws)), sizes)[: len(low)]
    inside = np.arange(len(low)) + LENGTH <= ends[owner]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(low)))
    keep = inside[start]
    start, count = start[keep], count[keep]
    if len(count) and count.max() > LONGEST:
        times = -(-count // LONGEST)
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, count = np.repeat(start, times) + turn * LONGEST, np.repeat(count, times) - turn * LONGEST
        count = np.minimum(count, LONGEST)
    # smallest of many, so spread anew (one to one) before ranges are cut
    with np.errstate(over="ignore"):
        spread = (low[start] ^ (low[start] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return joined, owner[start], start, count, spread ^ (spread >> np.uint64(29))


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and UTF-8 bytes of about ``BLOCK`` bytes of rows at a time."""
    rows, raws, size = [], [], 0
    column = batch.column(text).cast(pa.binary())
    for i in range(batch.num_rows):
        raw = column[i].as_py()
        if raw is None or len(raw) < LENGTH:
            continue
        rows.append(i)
        raws.append(raw)
        size += len(raw)
        if size >= BLOCK:
            yield rows, raws
            rows, raws, size = [], [], 0
    if rows:
        yield rows, raws


def _gather(bits: int) -> Callable:
    """mapInArrow over (doc_id, tkey, text): the minimizers, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = shared.Gathered(bits)
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, raws in _blocks(batch, 2):
                _, owner, _, _, low = segments(raws)
                sent.add(low, docs[rows][owner])
                if sent.size >= GATHER:
                    yield sent.batch()
        if sent.size:
            yield sent.batch()

    return run


def _places(bitmap, bits: int) -> Callable:
    """mapInArrow over (doc_id, tkey, text): rows of places, and one row per distinct segment of some blocks with its bytes.

    ``place`` is the start in the text and 24 bits of the text's hash.
    """

    def send(out: list[tuple], least: dict[int, list]) -> pa.RecordBatch:
        doc, place, names = (np.concatenate(x) for x in zip(*out))
        n, k = len(doc), len(least)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([doc, np.array([x[0] for x in least.values()], np.int64)])),
                pa.concat_arrays([pa.array(place, pa.int64()), pa.nulls(k, pa.int64())]),
                pa.array(np.concatenate([names, np.array(list(least), np.int64)])),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([x[1] for x in least.values()], pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([x[2] for x in least.values()], pa.binary())]),
            ],
            names=["doc", "place", "segment", "low", "raw"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        marks = np.frombuffer(bitmap.value, np.uint8)
        least: dict[int, list] = {}
        out: list[tuple] = []
        for batch in batches:
            docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, raws in _blocks(batch, 2):
                joined, owner, start, count, low = segments(raws)
                chosen = np.flatnonzero(shared.marked(low, marks, bits))
                if not len(chosen):
                    continue
                begins = np.cumsum([0, *map(len, raws)])
                row = np.asarray(rows)[owner[chosen]]
                doc, s, c, h = docs[row], start[chosen], count[chosen], low[chosen].view(np.int64)
                names = np.empty(len(chosen), np.int64)
                for i, (a, n, d, m) in enumerate(zip(s.tolist(), c.tolist(), doc.tolist(), h.tolist())):
                    raw = joined[a : a + n + LENGTH - 1]
                    name = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                    names[i] = name
                    known = least.get(name)
                    if known is None:
                        least[name] = [d, m, raw]
                    elif d < known[0]:
                        known[0] = d
                out.append((doc, ((s - begins[owner[chosen]]) << 24) | (keys[row] & 0xFFFFFF), names))
                if len(least) > 200_000:
                    yield send(out, least)
                    out, least = [], {}
        if out:
            yield send(out, least)

    return run


class Transform:
    """The Burrows-Wheeler transform of sorted, distinct strings, with the suffixes' places."""

    def __init__(self, code: np.ndarray, strings: list[bytes]):
        joined = b"\0".join(strings) + b"\0"
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        symbol = code[np.frombuffer(joined, np.uint8)]
        symbol[ends] = 0
        self.symbol, self.order = symbol, self._sort(symbol, ends)
        self.last = np.append(np.uint8(0), symbol[:-1])[self.order]

    @staticmethod
    def _sort(symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffix order; a string's end ranks by the string's number."""
        n = len(symbol)
        padded = symbol.tobytes() + bytes(8)
        key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
        left = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)
        short = left < 8
        cut = ((8 - left[short]) * 8).astype(np.uint64)
        gone = cut == 64
        cut[gone] = 0
        key[short] = np.where(gone, 0, (key[short] >> cut) << cut)
        order = np.argsort(key, kind="stable")
        sorted_key, ended = key[order], short[order]
        new = np.append(True, (sorted_key[1:] != sorted_key[:-1]) | ended[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth = 8
        while True:
            tied = ~new
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                return order
            rows = order[at]
            pair = (rank[rows] << 32) | rank[rows + depth]
            by = np.argsort(pair, kind="stable")
            order[at] = rows[by]
            pair = pair[by]
            fresh = np.append(True, pair[1:] != pair[:-1])
            new[at] |= fresh
            rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
            depth *= 2


def interleave(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Which of the two transforms each row of the merged one comes from, refined until rows are in the
    order of their first ``depth`` symbols (or no step changes anything)."""
    source = np.repeat(np.array([False, True]), [len(a), len(b)])
    symbol = np.empty(len(source), np.uint8)
    for _ in range(depth):
        symbol[~source] = a
        symbol[source] = b
        after = source[np.argsort(symbol, kind="stable")]
        if np.array_equal(after, source):
            break
        source = after
    return source


def _words(raw: bytes, at: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The ``length`` bytes from each place of ``raw`` as 64-bit words (the last overlaps)."""
    for k in [*range(0, length - 7, 8), length - 8]:
        yield np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))[at + k]


def repeated_windows(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, maybe repeated) of every window; by hashes, so that only repeats need be sorted."""
    raw = b"".join(strings)
    sizes = np.array([len(x) for x in strings], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    number = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows)
    h = np.zeros(len(number), np.uint64)
    with np.errstate(over="ignore"):
        for w in _words(raw, (np.cumsum(sizes) - sizes)[number] + offset, length):
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h)
    equal = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    return number, offset, twice


def first_documents(strings: list[bytes], docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of distinct strings with one smallest document: (string, low, high, document)."""
    number, offset, twice = repeated_windows(strings, length)
    first = docs[number]
    # the runs of repeated windows, as strings of their own
    new = np.flatnonzero(twice & np.append(True, ~twice[:-1] | (number[1:] != number[:-1]))) if len(twice) else np.zeros(0, np.int64)
    if len(new):
        last = np.flatnonzero(twice & np.append(~twice[1:] | (number[1:] != number[:-1]), True))
        runs = [strings[n][a : b + length] for n, a, b in zip(number[new].tolist(), offset[new].tolist(), offset[last].tolist())]
        run, at, least = _merged_first(runs, docs[number[new]], length)
        first[new[run] + at] = least
    new = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (first[1:] != first[:-1])))[: len(number)]
    size = np.diff(np.append(new, len(number)))
    return number[new], offset[new], offset[new] + size, first[new]


def _merged_first(strings: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, smallest document) of every window, by merging the transforms of two shards."""
    # equal strings become one
    names, of = np.unique(np.array(strings, object), return_inverse=True)
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    distinct = names.tolist()  # sorted
    shards = [list(range(0, len(distinct), 2)), list(range(1, len(distinct), 2))]
    code = np.zeros(256, np.uint8)
    used = np.unique(np.frombuffer(b"".join(distinct), np.uint8))
    if len(used) > 255:
        raise ValueError("a text uses more than 255 byte values")  # UTF-8 uses 243 at most
    code[used] = np.arange(1, len(used) + 1)
    number, offset, left, tables = [], [], [], []
    for shard in shards:
        if not shard:
            tables.append(np.zeros(0, np.uint8))
            continue
        t = Transform(code, [distinct[i] for i in shard])
        sizes = np.array([len(distinct[i]) + 1 for i in shard])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(shard)), sizes)[t.order]
        number.append(np.asarray(shard)[owner])
        offset.append(t.order - begins[owner])
        left.append(sizes[owner] - 1 - offset[-1])
        tables.append(t.last)
    source = interleave(tables[0], tables[1], length)
    row = np.where(source, len(tables[0]) + np.cumsum(source) - 1, np.cumsum(~source) - 1)
    number, offset, left = (np.concatenate(x)[row] for x in (number, offset, left))
    full = left >= length
    number, offset = number[full], offset[full]
    # neighbours in the merged order whose common prefix reaches the length are one interval
    sizes = np.array([len(x) for x in distinct], np.int64)
    at = (np.cumsum(sizes) - sizes)[number] + offset
    new = np.zeros(len(at), bool)
    new[0] = True
    for w in _words(b"".join(distinct), at, length):
        new[1:] |= w[1:] != w[:-1]
    start = np.flatnonzero(new)
    smallest = np.repeat(np.minimum.reduceat(least[number], start), np.diff(np.append(start, len(number))))
    # back to the strings as given, window by window
    windows = sizes - length + 1
    base = np.cumsum(windows) - windows
    flat = np.empty(int(windows.sum()), np.int64)
    flat[base[number] + offset] = smallest
    many = windows[of]
    run = np.repeat(np.arange(len(strings)), many)
    at = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    return run, at, flat[base[of][run] + at]


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas over the segments of one bucket."""
    least = pdf.groupby("segment", sort=True).agg(doc=("doc", "min"), raw=("raw", "first"))
    number, low, high, first = first_documents(list(map(bytes, least["raw"])), least["doc"].to_numpy())
    return pd.DataFrame({"segment": least.index.to_numpy()[number], "low": low, "high": high, "first": first})


def _ranges(spans) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjoining (start, end) pairs."""
    out: list[list[int]] = []
    for a, b in sorted(spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def copies(rows: DataFrame) -> DataFrame:
    """(doc, tkey) of the rows whose whole text an elder document has, too."""
    named = rows.select("doc_id", "tkey", F.md5("text").alias("name"))
    elders = named.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("name", "first")
    return named.join(elders, "name").filter("doc_id > first").select(F.col("doc_id").alias("doc"), "tkey").distinct()


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc, tkey (24 bits), spans (array of (a, b) in bytes): what repeats an elder document, per document that has any.

    Whole copies go whole and take no part in the search.  Their list is broadcast only up to ``COPIES`` rows.
    """
    with small_batches(docs.sparkSession):
        return _repeated_ranges(docs)


def _repeated_ranges(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text").filter(
        F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)
    )
    same = cut(copies(rows))
    listed = F.broadcast(same) if same.count() <= COPIES else same
    unique = rows.join(listed, (F.col("doc_id") == F.col("doc")) & (rows["tkey"] == listed["tkey"]), "left_anti")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = shared.range_bits(total // 18)
    marks = shared.shared_bitmap(unique.mapInArrow(_gather(bits), shared.Gathered.SCHEMA), bits)
    found = written(unique.mapInArrow(_places(marks, bits), "doc bigint, place bigint, segment bigint, low bigint, raw binary"))
    marks.destroy()
    release(spark)
    several = found.filter("raw is not null")
    buckets = max(1, -(-(several.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // BUCKET))
    answers = written(
        several.select("segment", "doc", "raw", F.pmod(F.xxhash64("low"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket").applyInPandas(_merge, "segment bigint, low int, high int, first bigint")
    )
    release(spark)
    start = F.shiftright("place", 24)
    parts = (
        found.filter("raw is null").select("doc", "place", "segment").join(answers, "segment").filter("first < doc")
        .select("doc", F.col("place").bitwiseAND(0xFFFFFF).alias("tkey"), F.struct((start + F.col("low")).alias("a"), (start + F.col("high") + LENGTH - 1).alias("b")).alias("span"))
        .groupBy("doc", "tkey").agg(F.collect_list("span").alias("spans"))
    )
    whole = same.select("doc", F.col("tkey").bitwiseAND(0xFFFFFF).alias("tkey"), F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit((1 << 62)).alias("b"))).alias("spans"))
    spans = written(parts.unionByName(whole))
    discard(found)
    discard(answers)
    release(spark)
    return spans


def _apply(digest: bool) -> Callable:
    """mapInArrow over (kept columns, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 2
            n_bytes, removed, n_spans, kept = [], [], [], []
            for text, spans in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()):
                raw = (text or "").encode()
                found = _ranges([(s["a"], min(s["b"], len(raw))) for s in spans or ()])
                left, at = [], 0
                for a, b in found:
                    left.append(raw[at:a])
                    at = b
                rest = b"".join([*left, raw[at:]])
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(rest))
                n_spans.append(len(found))
                kept.append(hashlib.sha256(rest).hexdigest() if digest else None if text is None else rest.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())],
                names=[*batch.schema.names[:k], "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str, str] = ("n_bytes", "n_removed", "n_spans", "kept"), *, digest: bool = False) -> DataFrame:
    """``keep`` columns and, as ``names``, the bytes of the text, those removed, the removed runs, and the remaining text or its SHA-256.

    As text, characters of which only a part remains go whole.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash"), shared.packed(keep).alias("whole"), "text")
    spans = repeated_ranges(docs)
    joined = rows.join(spans, (F.col("id") == F.col("doc")) & (F.col("hash").bitwiseAND(0xFFFFFF) == F.col("tkey")), "left").select("whole", "text", "spans")
    found = joined.mapInArrow(_apply(digest), f"whole {joined.schema['whole'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept string")
    return found.select(*shared.unpacked("whole", keep), *[F.col(a).alias(b) for a, b in zip(("n_bytes", "n_removed", "n_spans", "kept"), names)])


def dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
