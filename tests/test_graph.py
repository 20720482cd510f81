import random

import pytest
from pyspark.sql import functions as F

from depweave.operators import graph

EDGE = "from_id string, to_id string, edge_type string"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "depends_on") for a, b in pairs], EDGE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def got(df):
    return {r[0] for r in df.collect()}


def reach_model(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        ahead, seen = list(out[a]), set()
        while ahead:
            n = ahead.pop()
            if n not in seen:
                seen.add(n)
                ahead += out.get(n, ())
        found |= {(a, n) for n in seen}
    return found


def test_chain_and_diamond(spark):
    chain = edges_of(spark, ["ab", "bc", "cd"])
    assert got(graph.impact(chain, ids(spark, "d"))) == {"a", "b", "c"} and got(graph.impact(chain, ids(spark, "a"))) == set()
    diamond = edges_of(spark, ["ab", "ac", "bd", "cd"])
    assert {tuple(r) for r in graph.closure(diamond).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    artifacts = spark.createDataFrame([("a", "test_a.py"), ("d", "test_d.py")], "node_id string, path string")
    assert got(graph.affected_tests(diamond, ids(spark, "d"), artifacts)) == {"test_a.py", "test_d.py"}
    below, direct, induced = graph.relevant(diamond, ids(spark, "b"))
    assert got(below) == {"d"} and direct.count() == 1 and induced.count() == 1


def test_cycles_end(spark):
    loop = edges_of(spark, ["ab", "bc", "ca", "cd"])
    assert {tuple(r) for r in graph.closure(loop).collect()} == reach_model(["ab", "bc", "ca", "cd"])


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    pairs = [rnd.choice("abcdefgh") + rnd.choice("abcdefgh") for _ in range(12)]
    edges = edges_of(spark, pairs)
    assert {tuple(r) for r in graph.closure(edges).collect()} == reach_model(pairs)
    parts = {r.node_id: r.component_id for r in graph.components(ids(spark, *"abcdefgh"), edges).collect()}
    undirected = reach_model(pairs + [p[::-1] for p in pairs])
    order = {}
    for n in "abcdefgh":
        least = min([n, *[b for a, b in undirected if a == n]])
        order.setdefault(least, f"component-{len(order)}")
        assert parts[n] == order[least]


@pytest.mark.parametrize("seed", range(2))
def test_greedy_acceptance(spark, seed):
    rnd = random.Random(seed)
    new = [(rnd.choice("abcdefz"), rnd.choice("abcdef"), "calls", i) for i in range(25)]
    have = [("a", "b", "calls")]
    out, accepted = {}, {("a", "b", "calls")}
    for a, b, t, i in new:
        if "z" in (a, b):
            out[i] = "missing"
        elif a == b or (b, a) in reach_model([(x, y) for x, y, _ in accepted]):
            out[i] = "cycle"
        elif (a, b, t) in accepted:
            out[i] = "duplicate"
        else:
            out[i] = "accepted"
            accepted.add((a, b, t))
    nodes = ids(spark, *"abcdef")
    result = graph.add_edges(nodes, spark.createDataFrame(have, EDGE), spark.createDataFrame(new, EDGE + ", seq bigint"))
    assert {r.seq: r.outcome for r in result.collect()} == out


def test_validation_reasons(spark):
    nodes = spark.createDataFrame([("b1", "behavior"), ("t1", "test"), ("a", "module"), ("b", "module"), ("c", "module"), ("d", "module")], "id string, kind string")
    edges = edges_of(spark, ["ab", "bc"])
    asked = spark.createDataFrame([("c", "a", "calls"), ("a", "b", "depends_on"), ("c", "d", "calls"), ("b1", "t1", "depends_on"), ("a", "q", "calls"), ("a", "a", "calls")], EDGE)
    found = {(r.from_id, r.to_id): r.reason for r in graph.validate_edges(nodes, edges, asked).collect()}
    assert found == {("c", "a"): "cycle", ("a", "b"): "duplicate", ("c", "d"): "valid", ("b1", "t1"): "kind", ("a", "q"): "missing", ("a", "a"): "cycle"}


@pytest.mark.parametrize("limit", [0, 3, 1 << 17])
def test_walks_of_any_size(spark, monkeypatch, limit):
    """Short lists and long ones give the same closure; what is stored of it is compressed tables, no raw checkpoints."""
    monkeypatch.setattr(graph, "FEW", limit)
    pairs = ["ab", "bc", "ca", "cd", "de", "xy", "yy", "pa", "qe", "zq"]
    found = graph.closure(edges_of(spark, pairs))
    assert sorted((r.src, r.dst) for r in found.collect()) == sorted(reach_model([tuple(p) for p in pairs]))
    if limit == 0:
        assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    above = graph.reachable(edges_of(spark, pairs), ids(spark, "d", "d", "z"), reverse=True)
    assert sorted(r.id for r in above.collect()) == ["a", "b", "c", "d", "p", "z"]


@pytest.mark.parametrize("limit", [0, 1 << 17])
def test_validation_stores_no_pairs(spark, monkeypatch, limit):
    """Every candidate keeps its row, repeated ones too; of the pairs only the ends are checkpointed, and the step table goes."""
    kept, tables, gone = [], [], []
    cut, written, discard = graph.cut, graph.written, graph.discard
    monkeypatch.setattr(graph, "FEW", limit)
    monkeypatch.setattr(graph, "cut", lambda df: kept.append(df.columns) or cut(df))
    monkeypatch.setattr(graph, "written", lambda df: tables.append(df.columns) or written(df))
    monkeypatch.setattr(graph, "discard", lambda df: gone.append(df.columns) or discard(df))
    nodes = spark.createDataFrame([(n, "module") for n in "abcdef"], "id string, kind string")
    asked = [("c", "a", "calls"), ("c", "a", "calls"), ("a", "b", None), ("f", "a", "calls"), ("a", "q", "calls"), ("q", "q", "calls"), (None, "a", "calls"), ("e", "e", "calls"), ("b", "c", "depends_on")]
    found = graph.validate_edges(nodes, edges_of(spark, ["ab", "bc", "cd", "fe"]), spark.createDataFrame(asked, EDGE)).collect()
    want = ["cycle", "cycle", "valid", "valid", "missing", "missing", "missing", "cycle", "duplicate"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, found)) == sorted(key((*a, w)) for a, w in zip(asked, want))
    assert not any("to_id" in c for c in kept) and ["node", "next"] in tables and ["node", "next"] in gone and ["from_id", "to_id", "edge_type"] in gone


def test_ids_of_five_digits(spark):
    """Four digits are the least an id has; a longer number is not cut."""
    nodes = spark.createDataFrame([("gwt-9999",), ("gwt-89999",), ("req-9999",)], "id string")
    assert {tuple(r) for r in graph.next_ids(nodes).collect()} == {("gwt", "gwt-90000"), ("req", "req-10000")}


def test_nodes_and_ids(spark):
    nodes = spark.createDataFrame([("gwt-0007", "behavior"), ("gwt-x", "behavior"), ("8f4a6990-ee8f-5e1a-bf24-0c12882f3127", "resource"), ("db-1", "resource")], "id string, kind string")
    assert {tuple(r) for r in graph.next_ids(nodes).collect()} == {("gwt", "gwt-0008"), ("req", "req-0001")}
    known = spark.createDataFrame([("other",)], "uuid string")
    assert got(graph.orphans(nodes, known)) == {"8f4a6990-ee8f-5e1a-bf24-0c12882f3127"}
    edges = edges_of(spark, [("gwt-0007", "db-1")])
    artifacts = spark.createDataFrame([("db-1", "t.py")], "node_id string, path string")
    n, e, a = graph.remove_nodes(nodes, edges, artifacts, ids(spark, "db-1"))
    assert (n.count(), e.count(), a.count()) == (3, 0, 0)
    new = spark.createDataFrame([("db-1", "module")], "id string, kind string")
    assert graph.upsert_nodes(nodes, new).filter(F.col("id") == "db-1").collect()[0].kind == "module"


def test_repeated_edges_are_judged_once(spark, tmp_path):
    """Copies of an edge share the first one's outcome; the search sees distinct edges alone."""
    import random

    rnd = random.Random(4)
    ids = [f"n{i}" for i in range(7)]
    new = [(rnd.choice(ids), rnd.choice(ids), rnd.choice(["calls", None]), i) for i in range(300)]
    schema = "from_id string, to_id string, edge_type string"
    have = [("n0", "n1", "calls"), ("n1", "n2", "calls")]
    out, seen, want = {a: {b} for a, b, _ in have}, set(have), {}
    for a, b, kind, seq in new:
        met, ahead = {b}, [b]
        while ahead:
            for n in out.get(ahead.pop(), set()) - met:
                met.add(n)
                ahead.append(n)
        want[seq] = "cycle" if a in met else "duplicate" if (a, b, kind) in seen else "accepted"
        if want[seq] == "accepted":
            seen.add((a, b, kind))
            out.setdefault(a, set()).add(b)
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    rows_in, greedy = tmp_path / "rows", graph.accepted_in_order

    def counted(pdf):
        with open(rows_in, "a") as f:
            f.write(f"{len(pdf)}\n")
        return greedy(pdf)

    graph.accepted_in_order = counted
    try:
        got = graph.add_edges(nodes, spark.createDataFrame(have, schema), spark.createDataFrame(new, schema + ", seq bigint")).collect()
    finally:
        graph.accepted_in_order = greedy
    assert {r.seq: r.outcome for r in got} == want and len(got) == len(new)
    distinct = {(a, b, k) for a, b, k, _ in new} | set(have)
    assert max(map(int, rows_in.read_text().split())) <= len(distinct) < len(new)
