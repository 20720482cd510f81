"""Queries over a typed dependency graph: nodes(id, kind, ...), edges(from_id, to_id, edge_type).

Point queries walk from their seeds and never build the whole closure.  Walks are
semi-naive: each round joins only the newest pairs, and is checkpointed, so a cycle ends
and the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.operators.components import connected_components, numbered
from depweave.operators.strong import accepted_in_order, strong_sets
from depweave.session import FEW, cut, discard, few, release, written


def _walk(start: DataFrame, step: DataFrame) -> DataFrame:
    """All (root, node) reachable from ``start`` (root, node; distinct and stored) along ``step`` (node, next), the start included.

    Where the newest pairs' nodes have few steps, those are broadcast, and new pairs meet only the
    found ones of the nodes that they lead to; else both sides are shuffled.  A long walk stores
    its pairs compressed and lets go of each round's shuffles.
    """
    spark = start.sparkSession
    found = newest = start
    n = newest.count()
    large = n > FEW
    while n:
        nodes = cut(newest.select("node").distinct())
        ahead, seen = step, found
        if nodes.count() <= FEW:
            ahead = step.join(F.broadcast(nodes), "node", "left_semi")
            taken = ahead.count()
            if not taken:
                break
            if taken <= FEW:
                ahead = F.broadcast(cut(ahead))
                seen = found.join(F.broadcast(ahead.select(F.col("next").alias("node")).distinct()), "node", "left_semi")
        new = newest.join(ahead, "node").select("root", F.col("next").alias("node")).distinct().join(seen, ["root", "node"], "left_anti").select("root", "node")
        newest = written(new) if large else cut(new)
        n = newest.count()
        found = found.unionByName(newest)
        if large or n > FEW:
            large = True
            del new, ahead, seen, nodes
            release(spark)
    return found


def _steps(edges: DataFrame, reverse: bool = False) -> DataFrame:
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    return edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of every node and each node that it reaches by one edge or more."""
    step = written(_steps(edges))
    release(edges.sparkSession)
    reached = _walk(step.select(F.col("node").alias("root"), F.col("next").alias("node")), step)
    return reached.select(F.col("root").alias("src"), F.col("node").alias("dst"))


def reachable(edges: DataFrame, seeds: DataFrame, *, reverse: bool = False, with_seeds: bool = True) -> DataFrame:
    """(id): what the ``seeds`` (id) reach along the edges, or against them."""
    step = cut(_steps(edges, reverse))  # read by every round
    start = seeds.select(F.lit(0).alias("root"), F.col("id").alias("node"))
    if not with_seeds:
        start = start.join(step, "node").select("root", F.col("next").alias("node"))
    return _walk(cut(start.distinct()), step).select(F.col("node").alias("id"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component_id, node_id): undirected components, numbered in the order of their smallest members."""
    linked = connected_components(edges, "from_id", "to_id")
    least = nodes.select(F.col("id").alias("node")).join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("least"))
    return least.join(numbered(least, "least"), "least").select(F.concat(F.lit("component-"), F.col("number")).alias("component_id"), F.col("node").alias("node_id"))


def component_members(parts: DataFrame, node_id: str) -> DataFrame:
    """(node_id): the members of the component that holds ``node_id``."""
    return parts.join(parts.filter(F.col("node_id") == node_id).select("component_id"), "component_id", "left_semi").select("node_id")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose both ends are among ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(edges.columns)


def relevant(edges: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dependencies, direct edges, induced edges) of the ``root`` (id), which counts for the induced edges only."""
    below = cut(reachable(edges, root, with_seeds=False))
    direct = edges.join(root.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(edges.columns)
    return below, direct, induced(edges, below.unionByName(root.select("id")).distinct())


def subgraph(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id): ancestors, descendants and the root itself."""
    return reachable(edges, root).unionByName(reachable(edges, root, reverse=True)).distinct()


def impact(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id, is_direct): everything else that reaches the root, and whether by one edge."""
    above = reachable(edges, root, reverse=True, with_seeds=False).join(root.select("id"), "id", "left_anti")
    direct = edges.join(root.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct().withColumn("is_direct", F.lit(True))
    return above.join(direct, "id", "left").select("id", F.coalesce("is_direct", F.lit(False)).alias("is_direct"))


def affected_tests(edges: DataFrame, root: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(path): test files of the root and of everything that reaches it; artifacts(node_id, path)."""
    return artifacts.join(reachable(edges, root, reverse=True).select(F.col("id").alias("node_id")), "node_id", "left_semi").select("path").distinct()


def validate_edges(nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` (from_id, to_id, edge_type) with ``reason``: missing, cycle, duplicate, kind or valid.

    The first failing reason counts; kinds are looked at for ``depends_on`` alone; nothing is added.
    Only what can reach a candidate's source is walked, from the candidates' targets.
    """
    spark = edges.sparkSession
    candidates = written(candidates.select("from_id", "to_id", "edge_type"))
    step = written(_steps(edges))
    release(spark)
    # the ends alone are stored, not the pairs; targets whose source is no node are looked at for nothing
    ids = nodes.select(F.col("id").alias("node")).distinct()
    asked = candidates.filter("from_id <> to_id").join(ids.withColumnRenamed("node", "to_id"), "to_id", "left_semi")
    ends = cut(asked.select(F.inline(F.array(F.struct(F.lit("from").alias("side"), F.col("from_id").alias("node")), F.struct(F.lit("to").alias("side"), F.col("to_id").alias("node"))))).distinct().join(ids, "node", "left_semi"))
    of = lambda side: ends.filter(F.col("side") == side).select("node")
    above = cut(_walk(cut(of("from").select(F.lit(0).alias("root"), "node")), step.select(F.col("next").alias("node"), F.col("node").alias("next"))).select("node"))
    towards = written(step.join(above.withColumnRenamed("node", "next"), "next", "left_semi").select("node", "next"))
    discard(step)
    release(spark)
    roots = cut(of("to").join(above, "node", "left_semi").select(F.col("node").alias("root"), "node"))
    reach = _walk(roots, towards).select(F.col("root").alias("src"), F.col("node").alias("dst"))
    kinds = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("kind").alias(f"{side}_kind"))
    lost = F.col("from_kind").isNull() | F.col("to_kind").isNull()
    barred = (F.col("edge_type") == "depends_on") & F.col("from_kind").isin("behavior", "requirement") & (F.col("to_kind") == "test")
    marked = candidates.join(kinds("from"), "from_id", "left").join(kinds("to"), "to_id", "left")
    marked = written(marked.select("from_id", "to_id", "edge_type", lost.alias("lost"), barred.alias("barred")))  # each pair of joins lets go of its shuffles
    discard(candidates)
    release(spark)
    back = reach.select(F.col("src").alias("to_id"), F.col("dst").alias("from_id")).withColumn("back", F.lit(True))
    there = edges.select("from_id", "to_id", "edge_type").distinct().withColumn("there", F.lit(True))
    joined = marked.join(back, ["from_id", "to_id"], "left").join(there, ["from_id", "to_id", "edge_type"], "left")
    reason = (
        F.when(F.col("lost"), "missing").when((F.col("from_id") == F.col("to_id")) | F.col("back"), "cycle").when(F.col("there"), "duplicate").when(F.col("barred"), "kind").otherwise("valid")
    )
    return joined.select("from_id", "to_id", "edge_type", reason.alias("reason"))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type, seq, outcome): each new edge in order of ``seq``, accepted, duplicate, cycle or missing.

    An edge between two strongly connected sets of the candidate graph can close no cycle, so only
    edges inside one set depend on their order; each set is taken in order by itself.  Only the
    first of equal edges is: later ones are duplicates if it was accepted, else close the same cycle.
    """
    have = edges.select("from_id", "to_id", "edge_type", F.lit(-1).cast("bigint").alias("seq"))
    ids = nodes.select("id").distinct()
    known = new.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    lost = new.join(known.select("seq"), "seq", "left_anti").select("from_id", "to_id", "edge_type", "seq", F.lit("missing").alias("outcome"))
    every = cut(have.unionByName(known.select(have.columns)))
    sets = strong_sets(every)
    placed = (
        every.join(sets.select(F.col("node").alias("from_id"), F.col("part").alias("from_part")), "from_id", "left")
        .join(sets.select(F.col("node").alias("to_id"), F.col("part").alias("to_part")), "to_id", "left")
    )
    same = placed.filter("from_part = to_part")
    first = Window.partitionBy("from_id", "to_id", "edge_type").orderBy("seq")
    free = placed.filter("not coalesce(from_part = to_part, false)").withColumn("rank", F.row_number().over(first)).select(
        "from_id", "to_id", "edge_type", "seq", F.when(F.col("from_id") == F.col("to_id"), "cycle").when(F.col("rank") > 1, "duplicate").otherwise("accepted").alias("outcome")
    )
    schema = "from_id string, to_id string, edge_type string, seq bigint, outcome string"
    firsts = same.groupBy("from_part", "from_id", "to_id", "edge_type").agg(F.min("seq").alias("seq"))
    judged = firsts.groupBy("from_part").applyInPandas(accepted_in_order, schema).select(
        F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("edge_type").alias("kind"), "outcome"
    )
    equal = (F.col("from_id") == F.col("a")) & (F.col("to_id") == F.col("b")) & F.col("edge_type").eqNullSafe(F.col("kind"))
    turn = same.select("from_id", "to_id", "edge_type", "seq", F.row_number().over(first).alias("turn"))
    inside = turn.join(judged, equal).select(
        "from_id", "to_id", "edge_type", "seq", F.when((F.col("turn") > 1) & (F.col("outcome") == "accepted"), "duplicate").otherwise(F.col("outcome")).alias("outcome")
    )
    return free.unionByName(inside).filter("seq >= 0").unionByName(lost)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with ``new`` rows in place of those of the same id."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def remove_nodes(nodes: DataFrame, edges: DataFrame, artifacts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and test artifacts without the ``gone`` (id) ones."""
    ids = lambda c: gone.select(F.col("id").alias(c))
    return (
        nodes.join(ids("id"), "id", "left_anti"), edges.join(ids("from_id"), "from_id", "left_anti").join(ids("to_id"), "to_id", "left_anti").select(edges.columns),
        artifacts.join(ids("node_id"), "node_id", "left_anti"),
    )


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    """All edges at a node."""
    return edges.filter((F.col("from_id") == node_id) | (F.col("to_id") == node_id))


def orphans(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(id): resource nodes with a UUID-shaped id that is not among ``known`` (uuid)."""
    from depweave.functions.exprs import is_uuid_shaped

    return nodes.filter((F.col("kind") == "resource") & is_uuid_shaped(F.col("id"))).join(known.select(F.col("uuid").alias("id")), "id", "left_anti").select("id")


def next_ids(nodes: DataFrame, prefixes: tuple[str, ...] = ("gwt", "req")) -> DataFrame:
    """(prefix, next_id): one past the largest number in use, four digits at least."""
    from depweave.functions.exprs import cell_number

    numbers = nodes.agg(*[F.coalesce(F.max(cell_number(F.col("id"), p)), F.lit(0)).alias(p) for p in prefixes])
    rows = F.inline(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(p).alias("last")) for p in prefixes]))
    return numbers.select(rows).select("prefix", F.concat(F.col("prefix"), F.lit("-"), F.format_string("%04d", F.col("last") + 1)).alias("next_id"))


def require(nodes: DataFrame, ids: DataFrame) -> None:
    """Raise an error that names an id of ``ids`` (id) that is no node, if there is one."""
    lost = ids.join(nodes.select("id"), "id", "left_anti").head(1)
    if lost:
        raise ValueError(f"no node {lost[0]['id']!r}")


def component_of(parts: DataFrame, ids: DataFrame) -> DataFrame:
    """(component_id, node_id) of the given ids (id) among the ``components``."""
    return parts.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("component_id", "node_id")


def context(nodes: DataFrame, edges: DataFrame, cards: DataFrame, root: DataFrame) -> DataFrame:
    """(facet, id, value) of what the ``root`` (id) depends on; nodes have a ``path`` and a ``schema`` column.

    Facets: dependency (every one, its name), template (a spec's path), schema (a resource's), existing_spec
    (a resource's path that ends in .tla), card (the card (uuid, card) of the record of that id) and edge
    (every edge among the root and its dependencies, its type and target).
    """
    require(nodes, root)
    below = cut(nodes.join(reachable(edges, root, with_seeds=False), "id", "left_semi").select("id", "kind", "name", "path", "schema"))
    facet = lambda name, value, test=F.lit(True): below.filter(test & (value != "")).select(F.lit(name).alias("facet"), "id", value.alias("value"))
    kind, path = F.col("kind"), F.col("path")
    known = cards.join(below.select(F.col("id").alias("uuid")), "uuid", "left_semi").select(F.lit("card").alias("facet"), F.col("uuid").alias("id"), F.col("card").alias("value"))
    among = induced(edges, below.select("id").unionByName(root.select("id")).distinct()).select(F.lit("edge").alias("facet"), F.col("from_id").alias("id"), F.concat("edge_type", F.lit(" "), "to_id").alias("value"))
    return (
        below.select(F.lit("dependency").alias("facet"), "id", F.col("name").alias("value")).unionByName(facet("template", path, kind == "spec"))
        .unionByName(facet("schema", F.col("schema"), kind == "resource")).unionByName(facet("existing_spec", path, (kind == "resource") & path.endswith(".tla"))).unionByName(known).unionByName(among)
    )


def _crawled(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``nodes`` with a resource node for each internal record, its claim (if records have one) as the description."""
    claim = F.col("operational_claim") if "operational_claim" in records.columns else F.lit(None).cast("string")
    made = records.filter(~F.col("is_external")).select(
        F.col("uuid").alias("id"), F.lit("resource").alias("kind"),
        F.concat(F.when(F.coalesce("class_name", F.lit("")) != "", F.concat("class_name", F.lit("."))).otherwise(""), "function_name", F.lit(" @ "), "file_path").alias("name"),
        claim.alias("description"),
    )
    return upsert_nodes(nodes, made)


def bridge_nodes(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``nodes`` (id, kind, name, description) with a resource node for each internal record, without the resource nodes of UUID shape that no record (external ones count) has any more."""
    every = _crawled(nodes, records)
    return every.join(orphans(every, records), "id", "left_anti").select(every.columns)


def bridge_calls(nodes: DataFrame, edges: DataFrame, deps: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type, seq, outcome) of the records' dependencies as ``calls`` edges, tried in the order of their ids and dispatches; ends that are no nodes make none."""
    wanted = deps.select(F.array("dependent_uuid", "dependency_uuid", "dispatch").alias("row"))
    new = numbered(wanted, "row").select(F.col("row")[0].alias("from_id"), F.col("row")[1].alias("to_id"), F.lit("calls").alias("edge_type"), F.col("number").cast("bigint").alias("seq"))
    return add_edges(nodes, edges, new).filter("outcome <> 'missing'")


def _tried_pairs(nodes: DataFrame, edges: DataFrame, deps: DataFrame) -> DataFrame:
    """(from_id, to_id, n, outcome) of each pair of nodes that the dependencies name, in how many dispatches, tried as a ``calls`` edge in the order of the ids: accepted, duplicate (of a given edge) or cycle.

    Dispatches of a pair follow one another, so the pair is judged once; only pairs inside a strongly connected set have to wait for one another.
    """
    ids = nodes.select("id").distinct()
    named = deps.select(F.col("dependent_uuid").alias("from_id"), F.col("dependency_uuid").alias("to_id"), "dispatch").repartition("from_id")
    pairs = named.distinct().groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n")).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    pairs = written(pairs.select("from_id", "to_id", "n"))
    pairs = pairs.join(few(cut(pairs.select("to_id").distinct().join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))), "to_id", "left_semi")
    sets = few(strong_sets(pairs.select("from_id", "to_id").unionByName(edges.select("from_id", "to_id"))))
    side = lambda c: sets.select(F.col("node").alias(f"{c}_id"), F.col("part").alias(f"{c}_part"))
    placed = lambda rows: rows.join(side("from"), "from_id", "left").join(side("to"), "to_id", "left").withColumn("inside", F.coalesce(F.col("from_part") == F.col("to_part"), F.lit(False)))
    had = few(cut(edges.filter("edge_type = 'calls'").select("from_id", "to_id").distinct())).withColumn("had", F.lit(True))
    every = placed(pairs.join(had, ["from_id", "to_id"], "left"))
    done = lambda fine: F.when(fine, F.when(F.col("had"), "duplicate").otherwise("accepted")).otherwise("cycle").alias("outcome")
    free = every.filter("not inside").select("from_id", "to_id", "n", done(F.col("from_id") != F.col("to_id")))
    inside = cut(every.filter("inside").select("from_id", "to_id", "n", "had", "from_part"))
    turn = F.row_number().over(Window.partitionBy("from_part").orderBy("from_id", "to_id")).cast("bigint")
    new = inside.select("from_part", "from_id", "to_id", F.lit("calls").alias("edge_type"), turn.alias("seq"))
    old = placed(edges).filter("inside").select("from_part", "from_id", "to_id", "edge_type", F.lit(-1).cast("bigint").alias("seq"))
    firsts = old.unionByName(new).groupBy("from_part", "from_id", "to_id", "edge_type").agg(F.min("seq").alias("seq"))
    judged = firsts.groupBy("from_part").applyInPandas(accepted_in_order, "from_id string, to_id string, edge_type string, seq bigint, outcome string")
    fine = judged.filter("edge_type = 'calls'").select("from_id", "to_id", (F.col("outcome") == "accepted").alias("fine"))
    return free.unionByName(inside.join(fine, ["from_id", "to_id"]).select("from_id", "to_id", "n", done(F.col("fine"))))


def bridge(nodes: DataFrame, edges: DataFrame, records: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counters) after the records have been brought into the graph.

    Nodes are added first, then the ``calls`` edges between any two nodes, then orphans go with
    their edges.  The counters are one row: nodes_added, edges_added (silent duplicates count, as
    they are no errors) and orphans_removed.
    """
    every = cut(_crawled(nodes, records))
    tried = _tried_pairs(every, edges, deps)
    lost = few(cut(orphans(every, records)))
    made = tried.filter("outcome = 'accepted'").withColumn("edge_type", F.lit("calls"))
    left, kept, _ = remove_nodes(every, edges.unionByName(made.select(edges.columns)), every.select(F.col("id").alias("node_id")).limit(0), lost)
    added = F.coalesce(F.sum(F.when(F.col("outcome").isin("accepted", "duplicate"), F.col("n"))), F.lit(0)).cast("bigint")
    counters = (
        records.agg(F.count_if(~F.col("is_external")).alias("nodes_added"))
        .crossJoin(tried.agg(added.alias("edges_added"))).crossJoin(lost.agg(F.count(F.lit(1)).alias("orphans_removed")))
    )
    return left, kept, counters


def module_nodes(nodes: DataFrame, name: str, source_path: str | None = None) -> DataFrame:
    """The nodes (id, name, path) whose name holds a module's (in any case) or whose path holds its source's."""
    here = F.lower("name").contains(name.lower())
    return nodes.filter(here | F.coalesce(F.col("path").contains(source_path), F.lit(False)) if source_path else here)


def change(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(what, n, change): nodes and edges after an update, and the difference with its sign."""
    rows = None
    for what, old, new in zip(("nodes", "edges"), before, after):
        both = old.select(F.lit(0).alias("new")).unionByName(new.select(F.lit(1).alias("new")))
        one = both.agg(F.coalesce(F.sum("new"), F.lit(0)).alias("n"), F.count_if(F.col("new") == 0).alias("was")).select(F.lit(what).alias("what"), "n", (F.col("n") - F.col("was")).alias("d"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("what", "n", F.concat(F.when(F.col("d") > 0, "+").otherwise(""), F.col("d").cast("string")).alias("change"))


def cross_invariants(edges: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """(name) of each edge that leads from one of two node sets (id) into the other, either way; other characters than letters, digits and _ are _."""
    ends = lambda a, b: edges.join(a.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(b.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "edge_type")
    name = F.concat(F.lit("Cross_"), "from_id", F.lit("_"), "to_id", F.lit("_"), "edge_type")
    return ends(one, other).unionByName(ends(other, one)).select(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_").alias("name")).distinct()
