"""Strongly connected sets of a directed graph, and edges accepted in order inside one set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.session import cut, few

#: Rounds of trimming before colours are passed on; what they leave is still right.
TRIMS = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    """The distinct edges (a, b) without those whose source nothing enters or whose target nothing leaves: such ends are sets of one.

    What both enters and leaves is mostly short and then broadcast, so the edges are not shuffled to it.
    """
    for _ in range(TRIMS):
        core = few(cut(edges.select(F.col("a").alias("node")).distinct().join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_semi")))
        both = edges.join(core.withColumnRenamed("node", "a"), "a", "left_semi").join(core.withColumnRenamed("node", "b"), "b", "left_semi")
        edges = cut(both.select("a", "b").distinct())
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node from which each node can be reached, itself included; only changed colours travel on."""
    colours = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("colour", F.col("node")))
    moved = colours
    while True:
        sent = moved.join(edges, moved["node"] == edges["a"]).groupBy(F.col("b").alias("node")).agg(F.min("colour").alias("sent"))
        both = cut(colours.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), F.coalesce(F.col("sent") < F.col("colour"), F.lit(False)).alias("moved")))
        colours, moved = both.select("node", "colour"), both.filter("moved").select("node", "colour")
        if moved.isEmpty():
            return colours


def strong_sets(edges: DataFrame, src: str = "from_id", dst: str = "to_id") -> DataFrame:
    """(node, part): the nodes of strongly connected sets of two nodes and more, with the smallest node of each set.

    Ends that lie on no cycle are trimmed; then every node takes the smallest node that reaches it
    as its colour, and what reaches a colour's own node inside the colour is one set.  Sets go and
    the rest is coloured anew.  No round holds more than one row per node or edge; there are as many
    rounds as the longest way between two nodes has edges, for each layer of sets behind one another.
    """
    live = _trimmed(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b"))
    found = None
    while not live.isEmpty():
        colours = _coloured(live)
        ends = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        inside = cut(live.join(ends("a"), "a").join(ends("b"), "b").filter("a_colour = b_colour").select("a", "b", F.col("a_colour").alias("part")))
        members = cut(inside.filter("a = part or b = part").select("part").distinct().select(F.col("part").alias("node"), "part"))
        newest = members
        while not newest.isEmpty():
            ahead = newest.select(F.col("node").alias("b"), "part").join(inside, ["b", "part"]).select(F.col("a").alias("node"), "part").distinct()
            newest = cut(ahead.join(members, ["node", "part"], "left_anti"))
            members = cut(members.unionByName(newest))
        found = members if found is None else found.unionByName(members)
        gone = lambda c: members.select(F.col("node").alias(c))
        live = _trimmed(inside.select("a", "b").join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti"))
    if found is None:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("part")).limit(0)
    large = found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part")
    return found.join(large, "part", "left_semi").select("node", "part")


class Ordered:
    """An acyclic graph that keeps a topological order, so that an edge along it needs no search.

    An edge against the order is searched between its ends' places only; where it closes no cycle,
    the nodes found there are put in order anew.
    """

    def __init__(self) -> None:
        self.out: dict[str, set[str]] = {}
        self.into: dict[str, set[str]] = {}
        self.place: dict[str, int] = {}

    def _near(self, start: str, links: dict[str, set[str]], allowed) -> set[str]:
        met, ahead = {start}, [start]
        while ahead:
            for n in links[ahead.pop()]:
                if n not in met and allowed(self.place[n]):
                    met.add(n)
                    ahead.append(n)
        return met

    def add(self, a: str, b: str) -> bool:
        """Whether the edge closes no cycle; it is added then."""
        for n in (a, b):
            if n not in self.place:
                self.place[n] = len(self.place)
                self.out[n], self.into[n] = set(), set()
        if a == b:
            return False
        low, high = self.place[b], self.place[a]
        if low < high:
            after = self._near(b, self.out, lambda p: p <= high)
            if a in after:
                return False
            before = self._near(a, self.into, lambda p: p >= low)
            moved = sorted(before, key=self.place.get) + sorted(after, key=self.place.get)
            for n, p in zip(moved, sorted(self.place[n] for n in moved)):
                self.place[n] = p
        self.out[a].add(b)
        self.into[b].add(a)
        return True


def accepted_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct edges of one strongly connected set in order: one that closes a cycle with those accepted before is refused."""
    graph = Ordered()
    pdf = pdf.sort_values("seq", kind="stable")
    outcomes = ["accepted" if graph.add(a, b) else "cycle" for a, b in zip(pdf["from_id"], pdf["to_id"])]
    return pdf.assign(outcome=outcomes)[["from_id", "to_id", "edge_type", "seq", "outcome"]]
