"""Registration of requirements and behaviours under ids that stay when it is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.exprs import cell_number, slug
from depweave.operators.components import numbered
from depweave.operators.graph import add_edges
from depweave.session import cut


def _allotted(wanted: DataFrame, nodes: DataFrame, bindings: DataFrame, kind: str, prefix: str) -> DataFrame:
    """(key, id, is_new, place) of each distinct key of ``wanted`` (key, place): its bound id, else the next free number in the order of first places.

    Numbers follow the largest in use and have no gaps; only new keys are ordered, by range.
    """
    keys = wanted.groupBy("key").agg(F.min("place").alias("place"))
    bound = bindings.select(F.col("binding").alias("b"), F.col("id").alias("old"))
    keys = cut(keys.join(bound, F.concat(F.lit(f"{kind}:"), "key") == F.col("b"), "left").select("key", "place", "old"))
    last = nodes.agg(F.coalesce(F.max(cell_number(F.col("id"), prefix)), F.lit(0)).alias("last"))
    fresh = keys.filter("old is null")
    order = numbered(fresh.select("place"), "place").crossJoin(F.broadcast(last))  # one row
    number = F.col("last") + F.col("number") + 1
    made = order.select("place", F.concat(F.lit(f"{prefix}-"), F.format_string("%04d", number.cast("bigint"))).alias("made"))
    return keys.join(made, "place", "left").select("key", F.coalesce("old", "made").alias("id"), F.col("old").isNull().alias("is_new"), "place")


def register(nodes: DataFrame, edges: DataFrame, bindings: DataFrame, requirements: DataFrame, behaviours: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, bindings, answer) after a payload has been registered.

    ``nodes`` (id, kind, name and more), ``edges`` (from_id, to_id, edge_type), ``bindings`` (binding, id);
    ``requirements`` (place, id, text, name), ``behaviours`` (place, criterion_id, given, when, then,
    parent_req, name, depends_on): ``place`` is a number of its own for each, in the payload's order.
    What is bound keeps its id and is not touched.  A new behaviour's parent is a requirement of the
    payload, else a node of that id, else a requirement bound earlier, else none (a bound id that is
    no node makes no edge); the parent gets a
    ``decomposes`` edge, and nodes that it depends on get ``depends_on`` edges, unless they close a
    cycle.  Of equal keys the first counts.  ``answer`` (kind, key, id) names the id of every key.
    """
    requested = _allotted(requirements.select(F.col("id").alias("key"), "place"), nodes, bindings, "req", "req")
    judged = _allotted(behaviours.select(F.col("criterion_id").alias("key"), "place"), nodes, bindings, "gwt", "gwt")
    requested, judged = cut(requested), cut(judged)
    short = lambda text: F.lower(F.replace(F.left(text, F.lit(40)), F.lit(" "), F.lit("_")))
    text = F.coalesce("text", F.col("r.id"))
    new_reqs = requested.alias("k").filter("is_new").join(requirements.alias("r"), F.col("k.place") == F.col("r.place")).select(
        F.col("k.id").alias("id"), F.lit("requirement").alias("kind"), F.coalesce("name", short(text)).alias("name"), text.alias("text")
    )
    fresh = judged.filter("is_new").select(F.col("id").alias("gwt_id"), "place").join(behaviours, "place")
    new_gwts = fresh.select(F.col("gwt_id").alias("id"), F.lit("behavior").alias("kind"), F.coalesce("name", slug(F.col("when"))).alias("name"), "given", "when", "then")
    after = cut(nodes.unionByName(new_reqs, allowMissingColumns=True).unionByName(new_gwts, allowMissingColumns=True))
    # three tiers of parents, each a join; the first that answers counts
    tiers = fresh.filter("parent_req <> ''").select("gwt_id", "place", F.col("parent_req").alias("asked"))
    payload = requested.select(F.col("key").alias("asked"), F.col("id").alias("one"))
    known = nodes.select(F.col("id").alias("asked"), F.col("id").alias("two")).unionByName(new_reqs.select(F.col("id").alias("asked"), F.col("id").alias("two"))).distinct()
    older = bindings.filter(F.col("binding").startswith("req:")).select(F.expr("substr(binding, 5)").alias("asked"), F.col("id").alias("three"))
    parents = tiers.join(payload, "asked", "left").join(known, "asked", "left").join(older, "asked", "left").select("gwt_id", "place", F.coalesce("one", "two", "three").alias("parent")).filter("parent is not null")
    wired = parents.select(F.col("parent").alias("from_id"), F.col("gwt_id").alias("to_id"), F.lit("decomposes").alias("edge_type"), F.struct("place", F.lit(-1).alias("at")).alias("turn"))
    needs = fresh.select("gwt_id", "place", F.posexplode("depends_on").alias("at", "need")).select(F.col("gwt_id").alias("from_id"), F.col("need").alias("to_id"), F.lit("depends_on").alias("edge_type"), F.struct("place", "at").alias("turn"))
    wanted = cut(wired.unionByName(needs))
    seq = numbered(wanted.select("turn"), "turn").select("turn", F.col("number").cast("bigint").alias("seq"))
    tried = add_edges(after, edges, wanted.join(seq, "turn").select("from_id", "to_id", "edge_type", "seq"))
    linked = edges.select("from_id", "to_id", "edge_type").unionByName(tried.filter("outcome = 'accepted'").select("from_id", "to_id", "edge_type"))
    answer = requested.select(F.lit("req").alias("kind"), "key", "id", "is_new").unionByName(judged.select(F.lit("gwt").alias("kind"), "key", "id", "is_new"))
    added = answer.filter("is_new").select(F.concat("kind", F.lit(":"), "key").alias("binding"), "id")
    return after, linked, bindings.select("binding", "id").unionByName(added), answer.select("kind", "key", "id")
