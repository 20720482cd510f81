"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct shingle sets (equal sets are one row, named by
a hash of the set), columns are shingles, ordered from rare to common.  With n shingles
and a threshold t, a linked pair shares one of each side's first n - ceil(t n) + 1
columns: that size-derived bound makes the first column block, which is multiplied
sparsely (grouped by column) and gives candidate pairs with the places of their common
column; pairs whose sizes, or whose columns left after those places, cannot reach the
needed overlap are dropped.  The second block, all other columns, is then accumulated
for the remaining pairs only, from their texts.

Only reachability is asked for, so a column with many rows is not squared: each row is
paired with the column's most central row, the one that shares most columns (an
original, among its near copies); links are contracted into components, and then the
columns whose rows still lie in different components are multiplied in full across
components.  Overlap counts of the first block are accumulated per pair, and pairs whose
count plus all columns after the last common one misses the needed overlap are dropped.  A large group of near copies thus costs one pair a row, and no link between
different components is missed.

Column commonness comes from counts of all shingles in a table of hashed counters, sized
with the corpus up to ``COUNTERS``; a wrong order costs work, never a result.

Edge cases: null or wordless texts have no shingle and stand alone; texts with fewer
words than a shingle are one shingle; a null id joins components but cannot name one;
rows of one id with different texts are joined through that id's row only if linked;
repeated rows, very long words and extra columns need no special care.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.llm import shared
from depweave.operators.components import connected_components
from depweave.session import cut, discard, release, small_batches, written

#: Bytes of text hashed at once: working arrays are some 50 times as large, and larger blocks are no faster.
BLOCK = 1 << 18
GATHER = 2_000_000
#: Counters of the commonness table at most (one byte each once it is sent).
COUNTERS = 1 << 24
#: 64-bit words of a set's sketch (parities of the shingles that fall on a bit): differing bits never outnumber differing shingles.
SKETCH = 8
_SKETCH = [f"k{i}" for i in range(SKETCH)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return lower, space


_LOWER, _SPACE = _tables()
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word, in order, ASCII letters in lower case."""
    buf = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    space = _SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.flatnonzero(~space[:-1] & space[1:]) + 1 - start
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        value = (_LOWER[buf[~space]].astype(np.uint64) + np.uint64(1)) * _powers(0x9E3779B97F4A7C15, int(size.max()))[place]
    begins = np.cumsum([1, *[len(r) + 1 for r in raws[:-1]]])
    return mix(np.add.reduceat(value, first)), np.searchsorted(begins, start, "right") - 1


def shingle_sets(raws: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text number), distinct, sorted by text and shingle."""
    word, owner = word_hashes(raws)
    if not len(word):
        return word, owner
    odd = _powers(0xC2B2AE3D27D4EB4F, n + 1)[1:]
    found, whose = [], []
    with np.errstate(over="ignore"):
        if len(word) >= n:
            full = owner[n - 1 :] == owner[: len(owner) - n + 1]
            s = np.zeros(len(word) - n + 1, np.uint64)
            for j in range(n):
                s += word[j : len(word) - n + 1 + j] * odd[j]
            found.append(s[full])
            whose.append(owner[: len(owner) - n + 1][full])
        # texts with fewer words: the whole sequence, told apart by its length
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        count = np.diff(np.append(first, len(owner)))
        for f, c in zip(first[count < n].tolist(), count[count < n].tolist()):
            found.append(np.array([(word[f : f + c] * odd[:c]).sum() + np.uint64(c)], np.uint64))
            whose.append(owner[f : f + 1])
    s, who = mix(np.concatenate(found)), np.concatenate(whose)
    order = np.lexsort((s, who))
    s, who = s[order], who[order]
    new = np.append(True, (s[1:] != s[:-1]) | (who[1:] != who[:-1]))
    return s[new], who[new]


def set_name(s: np.ndarray) -> int:
    """64-bit name of a sorted set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[list[int], list[bytes]]]:
    rows, raws, size = [], [], 0
    column = batch.column(text).cast(pa.binary())
    for i in range(batch.num_rows):
        raw = column[i].as_py() or b""
        rows.append(i)
        raws.append(raw)
        size += len(raw) + 64
        if size >= BLOCK:
            yield rows, raws
            rows, raws, size = [], [], 0
    if rows:
        yield rows, raws


def _per_text(raws: list[bytes], n: int) -> Iterator[np.ndarray]:
    s, who = shingle_sets(raws, n)
    bounds = np.searchsorted(who, np.arange(len(raws) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield s[a:b]


def _sets(n: int) -> Callable:
    """mapInArrow over (doc_id, text): doc_id, size of the set, its name (null if empty) and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, name, sketch = [], [], []
            for _, raws in _blocks(batch, 1):
                for s in _per_text(raws, n):
                    size.append(len(s))
                    name.append(set_name(s) if len(s) else None)
                    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
                    sketch.append(np.packbits(bits.astype(bool)).view(np.int64))
            words = np.array(sketch, np.int64).reshape(-1, SKETCH).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(name, pa.int64()), *[pa.array(w) for w in words]], names=["doc_id", "n_shingles", "name", *_SKETCH]
            )

    return run


def _count(hashes: Callable[[list[bytes]], np.ndarray], counters: int) -> Callable:
    """mapInArrow over (key, text): counts of hashes, by piece of the table."""
    piece = min(counters, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(counters, np.uint32)
        for batch in batches:
            for _, raws in _blocks(batch, 1):
                np.add.at(count, (hashes(raws) & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
        pieces = [k for k in range(counters // piece) if count[k * piece : (k + 1) * piece].any()]
        for i in range(0, len(pieces), 8):  # a few at a time, as the table is large
            some = pieces[i : i + 8]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([count[k * piece : (k + 1) * piece].tobytes() for k in some], pa.binary())], names=["piece", "counts"]
            )

    return run


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas over one piece: a byte per counter, rising by 8 when the count doubles."""
    total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in pdf["counts"])
    level = np.minimum(255, 8 * np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
    return pd.DataFrame({"piece": pdf["piece"][:1], "levels": [level.tobytes()]})


def counted_levels(rows: DataFrame, hashes: Callable[[list[bytes]], np.ndarray], counters: int):
    """Broadcast table of commonness by hash (``counters`` bytes, ``COUNTERS`` at most), from all of (key, text)."""
    found = rows.mapInArrow(_count(hashes, counters), "piece bigint, counts binary").groupBy("piece").applyInPandas(_sum_counts, "piece bigint, levels binary")
    piece = min(counters, 1 << 16)
    table = bytearray(counters)
    for r in found.collect():
        table[r["piece"] * piece : (r["piece"] + 1) * piece] = r["levels"]
    return rows.sparkSession.sparkContext.broadcast(bytes(table))


def _leading(s: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The first column block of one set: from rare to common, as many as the size bound asks for."""
    common = level[(s & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64)
    order = np.lexsort((s, common))
    return s[order[: len(s) - (len(s) * percent + 99) // 100 + 1]]


def _gather(n: int, percent: int, levels, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        sent = shared.Gathered(bits)
        for batch in batches:
            for _, raws in _blocks(batch, 1):
                lead = {set_name(s): _leading(s, level, percent) for s in _per_text(raws, n) if len(s)}
                if lead:
                    sent.add(np.concatenate(list(lead.values())), np.repeat(np.array(list(lead), np.int64), [len(x) for x in lead.values()]))
                if sent.size >= GATHER:
                    yield sent.batch()
        if sent.size:
            yield sent.batch()

    return run


def _columns(n: int, percent: int, levels, marks, bits: int) -> Callable:
    """mapInArrow over (doc_id, text): the first block's entries whose column may have two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, bitmap = np.frombuffer(levels.value, np.uint8), np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            seen: set[int] = set()
            out: list[tuple] = []
            for _, raws in _blocks(batch, 1):
                for s in _per_text(raws, n):
                    if not len(s) or (name := set_name(s)) in seen:
                        continue
                    seen.add(name)
                    lead = _leading(s, level, percent)
                    at = np.flatnonzero(shared.marked(lead, bitmap, bits))
                    if len(at):
                        out.append((lead[at].view(np.int64), np.full(len(at), name), np.full(len(at), len(s)), at))
            if out:
                h, name, size, at = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(name, pa.int64()), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))], names=["column", "name", "size", "at"]
                )

    return run


def _verify(n: int, percent: int) -> Callable:
    """mapInArrow over (a, b, text_a, text_b): the pairs whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}

            def of(name: int, text: str) -> np.ndarray | None:
                if name not in known:
                    if len(known) > 256:
                        known.clear()
                    s, _ = shingle_sets([text.encode()], n)
                    if not len(s) or set_name(s) != name:
                        return None  # another text of the same id; the right one comes in another row
                    known[name] = s
                return known[name]

            left, right = [], []
            for a, b, ta, tb in zip(*[c.to_pylist() for c in batch.columns]):
                x, y = of(a, ta), of(b, tb)
                if x is None or y is None:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _sizes_fit(percent: int):
    return 100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b")


def _places_fit(percent: int):
    """The positional bound of a product.  What it drops lies behind what it keeps, in both rows, so the sums' bound below still holds."""
    need = F.ceil(percent * (F.col("size") + F.col("size_b")) / (100 + percent) - 1e-9)
    return F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b")) >= need


def _sketches_fit(percent: int):
    need = F.ceil(percent * (F.col("size") + F.col("size_b")) / (100 + percent) - 1e-9)
    apart = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"{k}_b"))) for k in _SKETCH), F.lit(0))
    return apart <= F.col("size") + F.col("size_b") - 2 * need


def _accumulate(products: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the first block's products whose overlap can still reach the threshold."""
    sums = products.groupBy(F.col("name").alias("a"), F.col("name_b").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), F.max("at").alias("at"), F.max("at_b").alias("at_b"), F.min("size").alias("size"), F.min("size_b").alias("size_b")
    )
    most = F.col("common") + F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b")) - 1
    return sums.filter((100 + percent) * most >= percent * (F.col("size") + F.col("size_b"))).select("a", "b")


def link_components(docs: DataFrame, *, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text)."""
    with small_batches(docs.sparkSession):
        return _link_components(docs, words, percent)


def _link_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(COUNTERS, 1 << max(10, (total // 768).bit_length()))
    levels = counted_levels(rows, lambda raws: shingle_sets(raws, words)[0], counters)
    bits = shared.range_bits(total // 36)
    marks = shared.shared_bitmap(rows.mapInArrow(_gather(words, percent, levels, bits), shared.Gathered.SCHEMA), bits)
    sets = written(rows.mapInArrow(_sets(words), "doc_id bigint, n_shingles bigint, name bigint, " + ", ".join(f"{k} bigint" for k in _SKETCH)))
    entries = written(
        rows.mapInArrow(_columns(words, percent, levels, marks, bits), "column bigint, name bigint, size int, at int")
        .groupBy("column", "name").agg(F.min("size").alias("size"), F.min("at").alias("at"))
    )

    for sent in (levels, marks):
        sent.destroy()
    release(docs.sparkSession)
    # first pairs: each row with its column's most central one
    several = entries.groupBy("column").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("column")
    shared_entries = cut(entries.join(several, "column"))
    weights = shared_entries.groupBy("name").agg(F.count(F.lit(1)).alias("weight"))
    heads = (
        shared_entries.join(weights, "name").groupBy("column")
        .agg(F.max(F.struct(F.col("weight"), (-F.col("size")).alias("less"), F.col("name").alias("name_b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"))).alias("head"))
        .select("column", "head.name_b", "head.size_b", "head.at_b")
    )
    # (not every common column has the same head, so counts would be too low to drop pairs here)
    stars = (
        shared_entries.join(heads, "column").filter((F.col("name") != F.col("name_b")) & _sizes_fit(percent))
        .select(F.col("name").alias("a"), F.col("name_b").alias("b")).distinct()
    )
    # a row without an id is found by its text's hash
    addressed = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text").filter("text is not null")
    unnamed = rows.filter("doc_id is null and text is not null").select(F.xxhash64("text").alias("doc_id"), "text").mapInArrow(_sets(words), sets.schema)
    found = sets.filter("doc_id is not null").select("doc_id", "name").unionByName(unnamed.select("doc_id", "name"))
    least = found.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("least"))

    def verified(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(least, "name")
        # one text a name: rows that repeat an id would multiply pairs
        needed = cut(needed.withColumnRenamed("least", "doc_id"))
        holders = shared.rows_of(addressed, needed.select("doc_id"))
        texts = written(holders.join(needed, "doc_id").select("name", "text"))
        both = (
            pairs.join(texts.select(F.col("name").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("name").alias("a"), F.col("text").alias("text_a")), "a")
        )
        done = cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, percent), "a bigint, b bigint").distinct())
        shared.forget(holders)
        discard(texts)
        release(docs.sparkSession)
        return done

    stars = cut(stars)
    links = verified(stars)
    parts = cut(connected_components(links, "a", "b").select(F.col("node").alias("name"), "component"))

    # then, in full, the columns that still touch several components
    placed = shared_entries.join(parts, "name", "left").withColumn("component", F.coalesce("component", "name"))
    open_columns = placed.groupBy("column").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("column")
    sketches = sets.filter("name is not null").groupBy("name").agg(*[F.min(k).alias(k) for k in _SKETCH])
    rest = cut(placed.join(open_columns, "column").join(sketches, "name"))
    other = rest.select("column", *[F.col(c).alias(f"{c}_b") for c in ("name", "size", "at", "component", *_SKETCH)])
    crossing = _accumulate(rest.join(other, "column").filter((F.col("component") < F.col("component_b")) & _sizes_fit(percent) & _places_fit(percent) & _sketches_fit(percent)), percent)
    ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = crossing.select(*ordered).join(stars.select(*ordered), ["a", "b"], "left_anti")
    all_links = links.unionByName(verified(cut(crossing)))
    final = connected_components(all_links, "a", "b").select(F.col("node").alias("name"), "component")
    discard(entries)

    labelled = sets.select("doc_id", "n_shingles", "name").join(final, "name", "left").withColumn("component", F.coalesce("component", "name"))
    firsts = labelled.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("first"))
    return labelled.join(firsts, "component", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
