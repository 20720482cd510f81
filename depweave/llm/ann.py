"""Approximate nearest neighbours: one navigable small-world graph per shard.

Equal vectors are one node, which carries its smallest ids (as many as an answer can
use), so large groups of copies neither fill a shard nor tie up its graph.  Nodes are
dealt into shards of about ``ROWS`` by a hash; each shard's graph is built in one task
and kept as a row of flat arrays: vectors, and per layer the neighbour table.  Blocks of
queries meet every shard by its number, search its graph, and the shards' answers are
merged by score.  Scores are cosines in double precision of the original vectors.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, as queries or candidates; vectors of another length than the query's are no
candidates; a repeated (id, vector) row counts once; of different vectors under one
queried id the smallest, component by component, is the query; fewer candidates than asked for are
all returned; ties go to the smaller id; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import written

ROWS = 4096
#: Neighbours of a node above the ground layer (twice as many on it), and the widths of the searches.
DEGREE = 12
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
#: Queries that travel together.
BLOCK = 1024


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Vectors (not zero) with their largest component between 1/2 and 1: times a power of two, which changes no cosine and keeps squares in range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


class Graph:
    """Layers of neighbour tables over unit vectors; a layer is (int32 table, counts), -1 where empty."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        level = levelled(vectors)
        self.unit = (level / np.sqrt(np.einsum("ij,ij->i", level, level))[:, None]).astype(np.float32)
        self.layers, self.entry = layers or [], entry
        self.seen, self.turn = np.zeros(len(vectors), np.int32), 0

    def near(self, q: np.ndarray, start: list[int], width: int, table: np.ndarray) -> list[tuple[float, int]]:
        """The ``width`` best nodes found from ``start``, best first."""
        self.turn += 1
        seen, turn, unit = self.seen, self.turn, self.unit
        seen[start] = turn
        first = [(float(s), i) for s, i in zip(unit[start] @ q, start)]
        ahead = [(-s, i) for s, i in first]
        heapq.heapify(ahead)
        best = first[:]
        heapq.heapify(best)
        while ahead:
            s, i = heapq.heappop(ahead)
            if len(best) >= width and -s < best[0][0]:
                break
            near = table[i]
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            for v, j in zip((unit[near] @ q).tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (v, j))
                    heapq.heappush(ahead, (-v, j))
                elif v > best[0][0]:
                    heapq.heapreplace(best, (v, j))
                    heapq.heappush(ahead, (-v, j))
        return sorted(best, reverse=True)

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the new node than to each other; the nearest others fill up."""
        if len(found) <= most:
            return [i for _, i in found]
        at = np.array([i for _, i in found])
        between = (self.unit[at] @ self.unit[at].T).tolist()
        chosen: list[int] = []
        for k, (s, _) in enumerate(found):
            if all(between[k][c] < s for c in chosen):
                chosen.append(k)
                if len(chosen) == most:
                    break
        rest = (k for k in range(len(found)) if k not in set(chosen))
        while len(chosen) < most:
            chosen.append(next(rest))
        return at[chosen].tolist()

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH) -> "Graph":
        g = cls(vectors)
        n = len(vectors)
        draw = np.random.default_rng(n)
        height = np.minimum((-np.log(1 - draw.random(n)) / np.log(degree)).astype(int), 8)
        g.layers = [np.full((n, 2 * degree if k == 0 else degree), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)]
        top = int(height[0]) if n else 0
        for i in range(1, n):
            q, start, high = g.unit[i], [g.entry], int(height[i])
            for k in range(top, high, -1):
                start = [g.near(q, start, 1, g.layers[k])[0][1]]
            for k in range(min(top, high), -1, -1):
                table = g.layers[k]
                found = g.near(q, start, width, table)
                mine = g.spread(found, degree)
                table[i, : len(mine)] = mine
                for j in mine:
                    row = table[j]
                    free = np.flatnonzero(row < 0)
                    if len(free):
                        row[free[0]] = i
                    else:
                        others = np.append(row, i)
                        sims = g.unit[others] @ g.unit[j]
                        order = np.argsort(-sims, kind="stable")
                        kept = g.spread(list(zip(sims[order].tolist(), others[order].tolist())), len(row))
                        row[:] = kept
                start = [j for _, j in found]
            if high > top:
                top, g.entry = high, i
        return g

    def search(self, q: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> list[int]:
        """The ``k`` nodes nearest to ``q`` (a vector of any length), as found."""
        q = levelled(q)
        q = (q / np.sqrt(q @ q)).astype(np.float32)
        if len(self.unit) <= width:
            return np.argsort(-(self.unit @ q), kind="stable")[:k].tolist()
        start = [self.entry]
        for table in self.layers[:0:-1]:
            start = [self.near(q, start, 1, table)[0][1]]
        return [i for _, i in self.near(q, start, max(width, k), self.layers[0])[:k]]


_INDEX = "shard bigint, dim int, entry int, widths array<int>, vectors binary, neighbours binary, ids array<array<bigint>>"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas over the nodes of one shard: its index as one row."""
    pdf = pdf.sort_values("least")
    vectors = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    g = Graph.build(vectors)
    return pd.DataFrame({
        "shard": pdf["shard"][:1].to_numpy(), "dim": [vectors.shape[1]], "entry": [g.entry], "widths": [[t.shape[1] for t in g.layers]],
        "vectors": [vectors.tobytes()], "neighbours": [b"".join(t.tobytes() for t in g.layers)], "ids": [[list(map(int, x)) for x in pdf["ids"]]],
    })


def _search(k: int) -> Callable:
    """mapInArrow over (index row, query block): the best candidates of the shard for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, g, original, norms, ids = None, None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                shard, dim = row["shard"].as_py(), row["dim"].as_py()
                if shard != last:
                    last, ids = shard, row["ids"].as_py()
                    original = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim)
                    flat, layers, at = np.frombuffer(row["neighbours"].as_py(), np.int32), [], 0
                    for w in row["widths"].as_py():
                        layers.append(flat[at : at + len(original) * w].reshape(-1, w))
                        at += len(original) * w
                    g = Graph(original, layers, row["entry"].as_py())
                    original = levelled(original)
                    norms = np.sqrt((original * original).sum(1))
                out: list[tuple[int, int, float]] = []
                for q in row["queries"].as_py():
                    v = levelled(np.array(q["embedding"], np.float64))
                    nodes = g.search(v, k + 1)
                    scores = (original[nodes] * v).sum(1) / (norms[nodes] * np.sqrt((v * v).sum()))
                    found = sorted((-s, i) for s, n in zip(scores.tolist(), nodes) for i in ids[n] if i != q["vec_id"])
                    out += [(q["vec_id"], i, -s) for s, i in found[:k]]
                a, b, s = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    )


def build_index(rows: DataFrame, k: int, shard_rows: int = ROWS) -> DataFrame:
    """One row per shard, as ``_INDEX``; nodes keep their ``k + 1`` smallest ids."""
    rank = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = written(
        rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("least", F.col("ids")[0])
    )
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.size("embedding").cast("bigint") * (1 << 32) + F.pmod(F.xxhash64("embedding"), F.lit(shards)))
    return written(dealt.groupBy("shard").applyInPandas(_build, _INDEX))


def nearest(df: DataFrame, is_query, k: int = 5, *, shard_rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of each row that ``is_query`` holds for."""
    rows = usable(df)
    index = build_index(rows, k, shard_rows)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-queries.count() // BLOCK))
    packed = queries.groupBy(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "embedding")).alias("queries")
    )
    # the stated query set meets every shard: (shard, block) pairs by number, then the shard's row by its key
    asked = index.select("shard", "dim").join(packed, "dim").select("shard", "queries")
    found = index.join(asked, "shard").mapInArrow(_search(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
