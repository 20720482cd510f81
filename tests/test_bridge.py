import pytest
from pyspark.sql import functions as F

from depweave.functions import exprs, text
from depweave.operators import graph, store

A, B, C, X = (f"{c * 8}-{c * 4}-{c * 4}-{c * 4}-{c * 12}" for c in "abcd")
RECORD = "uuid string, function_name string, class_name string, file_path string, is_external boolean"


def test_bridge(spark):
    nodes = spark.createDataFrame([(X, "resource", "old"), ("req-1", "resource", "kept"), (C, "resource", "outside")], "id string, kind string, name string")
    records = spark.createDataFrame([(A, "f", "K", "a.py", False), (B, "g", None, "b.py", False), (C, "h", "", "c.py", True)], RECORD)
    after = graph.bridge_nodes(nodes, records)
    assert {r.id: r.name for r in after.collect()} == {A: "K.f @ a.py", B: "g @ b.py", C: "outside", "req-1": "kept"}
    deps = spark.createDataFrame([(A, B, "direct"), (A, B, "override"), (B, A, "direct"), (A, X, "direct")], "dependent_uuid string, dependency_uuid string, dispatch string")
    none = spark.createDataFrame([], "from_id string, to_id string, edge_type string")
    assert {(r.from_id, r.to_id): r.outcome for r in graph.bridge_calls(after, none, deps).collect()} == {(A, B): "accepted", (B, A): "cycle"}


def test_bridge_judges_pairs(spark, tmp_path):
    """The bridge numbers no dependency and judges a pair once, whatever its dispatches; its counters are those of the rows tried one by one."""
    import random

    rnd = random.Random(7)
    u = [f"{i:08x}-0000-0000-0000-{i:012x}" for i in range(9)]
    records = spark.createDataFrame([(x, "f", None, f"{i}.py", i == 8) for i, x in enumerate(u[:9])], RECORD)
    nodes = spark.createDataFrame([("n", "behavior", "kept")], "id string, kind string, name string")
    edges = spark.createDataFrame([(u[0], u[1], "calls"), (u[1], u[2], "contains"), ("n", u[3], None)], "from_id string, to_id string, edge_type string")
    rows = [(rnd.choice(u), rnd.choice(u), rnd.choice(["direct", "override", None])) for _ in range(60)] + [(u[0], u[1], "direct"), (u[3], None, "direct"), (u[5], u[6], None), (u[5], u[6], None)]
    deps = spark.createDataFrame(rows, "dependent_uuid string, dependency_uuid string, dispatch string")
    every = graph.bridge_nodes(nodes, records)
    one_by_one = [(r.from_id, r.to_id, r.outcome) for r in graph.bridge_calls(every, edges, deps).collect()]
    numbered, graph.numbered = graph.numbered, None
    try:
        _, linked, counters = graph.bridge(nodes, edges, records, deps)
        got, added = {(r.from_id, r.to_id) for r in linked.filter("edge_type = 'calls'").collect()}, counters.first().edges_added
    finally:
        graph.numbered = numbered
    assert added == sum(o in ("accepted", "duplicate") for *_, o in one_by_one)
    assert got == {(a, b) for a, b, o in one_by_one if o == "accepted"} | {(u[0], u[1])} and linked.count() == len(got) + 2


def test_unknown_root_and_component(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b")], "from_id string, to_id string")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    graph.require(nodes, one("a"))
    with pytest.raises(ValueError, match="'z'"):
        graph.require(nodes, one("z"))
    parts = graph.components(nodes, edges)
    assert graph.component_of(parts, one("b")).first().component_id == "component-0" and graph.component_of(parts, one("c")).first().component_id == "component-1"


def test_mentioned(spark):
    rows = [("1", "f", None, "src/DB/x.py", False), ("2", "g", None, "x.py", False), ("3", "h", None, "lib/ax.py", False), ("4", "f", None, "y.py", True), ("5", "k", None, "db.py", False)]
    records = spark.createDataFrame(rows, RECORD)
    asked = lambda column, *values: spark.createDataFrame([(v,) for v in values], f"{column} string")

    def found(functions=(), files=(), folders=()):
        return {r.uuid for r in store.mentioned(records, asked("function_name", *functions), asked("path", *files), asked("directory", *folders)).collect()}

    assert found(functions=["f"]) == {"1"} and found(files=["x.py"]) == {"1", "2"} and found(folders=["db/"]) == {"1"} and found(folders=["src"], functions=["h"]) == {"1", "3"} and found() == set()


def test_expressions(spark):
    df = spark.createDataFrame([("Load the file!", 0), ("--", 1536), ("a__b", 1 << 20), ("x", 3 << 40)], "name string, n bigint")
    got = df.select(exprs.module_name(F.col("name"), F.lit("gwt-7")).alias("m"), exprs.byte_size(F.col("n")).alias("s")).collect()
    assert [r.m for r in got] == ["LoadTheFile", "gwt_7", "AB", "X"] and [r.s for r in got] == ["0.0B", "1.5KB", "1.0MB", "3.0TB"]


@pytest.mark.parametrize("prose, want", [(None, None), ("", None), ("none }", None), ("a {\"x\": 1} b", '{"x": 1}'), ("{bad} {\"x\": \"}\"}", '{"x": "}"}'), ('{"x": "\\\\\\"}"}', '{"x": "\\\\\\"}"}'), ("{\"x\": ", None)])
def test_first_object(prose, want):
    assert text._object_in(prose) == want
