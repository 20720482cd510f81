"""Rule-table extraction, prefixes, traces, conditions and tolerant reading on small tables."""

import json
import time

import pytest
from pyspark.sql import functions as F

from depweave.functions import conditions, exprs, records
from depweave.operators import extract, status, store, traces
from depweave.streaming import progress

DOC, REG = "project string, schema string, body string", "project string, body string"


def registry(*types, conditional=()):
    entry = lambda t: (t[0], {"name": t[0], "source_schema": extract.SCHEMAS[t[1]], "source_key": t[2], "path": t[3]})
    return json.dumps({"resources": dict(map(entry, types)), "conditional_resources": dict(map(entry, conditional))})


TYPES = [
    ("db-b7r2", "backend", "processors.ProcessorName", "backend/processors/ProcessorName"), ("db-h2s4", "backend", "services.ServiceName", "backend/services/ServiceName"),
    ("db-d3w8", "backend", "data_access_objects", "backend/data_access_objects/Name"), ("api-m5g7", "backend", "endpoints.Name", "backend/endpoints/Name"), ("api-n8k2", "backend", "request_handlers.Name", "backend/request_handlers/Name"),
    ("api-p3e6", "backend", "filters", "backend/filters"), ("ui-y5t3", "frontend", "data_loaders", "frontend/data_loaders"), ("mq-s9b4", "middleware", "interceptors", "middleware/interceptors"),
    ("mq-c1g5", "shared", "interceptor_interfaces", "shared/interceptor_interfaces"), ("cfg-h5v9", "shared", "transformers", "shared/transformers"), ("cfg-f7s8", "shared", "data_types", "shared/data_types"),
]


def edges(spark, docs, *, types=TYPES, conditional=()):
    rows = [("p", extract.SCHEMAS[s], b if isinstance(b, str) else json.dumps(b)) for s, b in docs]
    found = extract.extract_edges(spark.createDataFrame(rows, DOC), spark.createDataFrame([("p", registry(*types, conditional=conditional))], REG))
    return {(r.from_id, r.to_id, r.edge_type) for r in found.collect()}


def test_rules(spark):
    backend = {
        "processors": {"p": {"imports": {"internal": [{"path": "backend/services/X"}, {"path": "shared/data_types"}, {"path": "none"}, {}], "external": [{"path": "backend/endpoints"}]}}, "q": "text"},
        "services": {"s": {"functions": {"f": {"calls": ["d", "e"]}, "g": "no object"}}, "t": {"functions": {}}},
        "endpoints": {"e": {"handler": None, "filters": ["x"]}, "f": {"filters": []}},
        "request_handlers": {"h": {"dependencies": ["s"], "functions": {"f": {"operation": {"deep": 1}}}}},
        "data_structures": {"a": {"relations": {"b": {}}}}, "logging": {"format": "see shared/logging"},
    }
    rest = [
        ("frontend", {"data_loaders": {"d": {"api_reference": "backend/endpoints/E"}, "e": {"api_reference": "x"}}}),
        ("middleware", {"interceptors": {"i": {"base_interface": "shared/interceptor_interfaces/I", "imports": {"shared": [{"path": "shared/transformers"}]}}}}),
        ("shared", {"transformers": {"t": {"input_type": "a", "output_type": None}}}), ("frontend", "{broken"), ("backend", "[]"),
    ]
    assert edges(spark, [("backend", backend), *rest]) == {
        ("db-b7r2", "db-h2s4", "imports"), ("db-b7r2", "cfg-f7s8", "imports"), ("db-h2s4", "db-d3w8", "calls"), ("api-m5g7", "api-n8k2", "handles"), ("api-m5g7", "api-p3e6", "filters"), ("api-n8k2", "db-h2s4", "depends_on"),
        ("api-n8k2", "db-b7r2", "calls"), ("ui-y5t3", "api-m5g7", "references"), ("mq-s9b4", "mq-c1g5", "implements_interface"), ("mq-s9b4", "cfg-h5v9", "imports"), ("cfg-h5v9", "cfg-f7s8", "transforms_from"), ("cfg-h5v9", "cfg-f7s8", "transforms_to"),
    }


def test_cycles_and_last_types(spark):
    """Of two edges that close a cycle the earlier rule's stays; the last resource of a type counts."""
    body = {"processors": {"p": {"imports": {"backend": [{"path": "backend/request_handlers"}]}}}, "request_handlers": {"h": {"functions": {"f": {"operation": 1}}, "dependencies": [1]}}}
    assert edges(spark, [("backend", body)], conditional=[("own", "backend", "services.Own", "backend/services/Own")]) == {("db-b7r2", "api-n8k2", "imports"), ("api-n8k2", "own", "depends_on")}


def test_longest_prefix(spark):
    paths = spark.createDataFrame([("p", x) for x in ("backend/services/S", "backend/service_x", "backend", "", "backend/services", "zz")] + [("q", "backend/services")], "project string, path string")
    prefixes = spark.createDataFrame([("p", "backend/services", "long"), ("p", "backend/service", "short"), ("q", "x", "x")], "project string, prefix string, uid string")
    got = {(r.project, r.path): r.uid for r in extract.resolve_paths(paths, prefixes).collect()}
    assert got == {("p", "backend/services/S"): "long", ("p", "backend/service_x"): "short", ("p", "backend"): None, ("p", ""): None, ("p", "backend/services"): "long", ("p", "zz"): None, ("q", "backend/services"): None}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_walked_in_one_pass(spark, small):
    """No level of the walk is stored, and the lines are read once for both documents of a customer."""
    from depweave.plans import extraction

    plan = plan_of(extraction.extract_edges(spark, small))
    assert "LogicalRDD" not in plan and plan.count("l_returnflag#") > 0 and sum("Relation [" in line and "l_orderkey#" in line for line in plan.splitlines()) == 1


def test_paths_that_go_on_and_order_by_project(spark):
    """A rule's path may begin another's; each project keeps its own earlier edge of a cycle."""
    rules = [("backend", "a.*", None, "has", "b"), ("backend", "a.*.to.[]", None, "leads", "c"), ("backend", "c.back", None, "leads", "a")]
    types = [("ra", "backend", "a", "backend/a"), ("rb", "backend", "b", "backend/b"), ("rc", "backend", "c", "backend/c")]
    bodies = {"p": {"a": {"*": {"to": [1]}, "[]": 2}, "c": {"back": 1}}, "q": {"a": {"x": {"to": []}}, "c": {"back": {}}}, "r": {"a": [{"to": [1]}], "c": {"back": None}}}
    docs = spark.createDataFrame([(p, extract.SCHEMAS["backend"], json.dumps(b)) for p, b in bodies.items()], DOC).repartition(3)
    found = extract.extract_edges(docs, spark.createDataFrame([(p, registry(*types)) for p in bodies], REG), rules)
    got = {}
    for r in found.collect():
        got.setdefault(r.project, set()).add((r.from_id, r.to_id, r.edge_type))
    assert got == {"p": {("ra", "rb", "has"), ("ra", "rc", "leads")}, "q": {("ra", "rb", "has"), ("rc", "ra", "leads")}, "r": {("rc", "ra", "leads")}}


def test_paths_stay_single_rows(spark):
    """A path meets its project's prefixes as one row: no row per beginning."""
    paths = spark.createDataFrame([("p", "ab/" + "x" * 500), ("r", "ab/c")], "project string, path string")
    prefixes = spark.createDataFrame([("p", "ab/" + "x" * n, f"u{n}") for n in range(1, 400)], "project string, prefix string, uid string")
    found = extract.resolve_paths(paths, prefixes)
    assert "Generate" not in plan_of(found) and {(r.project, r.uid) for r in found.collect()} == {("p", "u399"), ("r", None)}


def test_traces_begin_again_at_one(spark):
    logs = {"a": [1, 2, 3, 1, 2], "b": [1, 1, 2], "c": [1, 1, 1, 1, 1], "d": [5, 1, 1, 1, 2, 1, 1], "e": [4, 4, 1, 2], "f": [1], "g": [7, 1, 2, 1, 1, 1, 3, 1]}
    rows = [(k, -1, "noise") for k in logs] + [(k, 10 * i, f" State {n}: <Step {i}> ") for k, v in logs.items() for i, n in enumerate(v)] + [("z", 0, "/\\ x = 1")]
    got = {}
    for r in traces.traces(spark.createDataFrame(rows, "log_id string, line_no int, text string").repartition(3)).orderBy("log_id", "trace_no", "place").collect():
        got.setdefault(r.log_id, {}).setdefault(r.trace_no, []).append(r.state_num)
    want = {}
    for k, v in logs.items():
        out, trace, state = [], [], None
        for n in v:
            if n == 1 and trace:
                out.append([*trace, state])
                trace = []
            elif state is not None:
                trace = [*trace, state]
            state = n
        want[k] = [*out, [*trace, state]]
    assert {k: [v[n] for n in sorted(v)] for k, v in got.items()} == want and all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_values_and_ways_back(spark):
    text = ["Error: Invariant Safe is violated.", "State 1: <Init>", "/\\ x = 1", "/\\ y = <<1, 2>> ", "/\\ x = 2", "State 2: <Next line 3>", "junk", "Back to state 1", "/\\ x = 9", "Invariant Later is violated"]
    lines = spark.createDataFrame([("l", i, t) for i, t in enumerate(text)], "log_id string, line_no int, text string")
    assert [(r.state_num, r.label, [(v.var, v.value) for v in r.vars]) for r in traces.traces(lines).orderBy("place").collect()] == [(1, "Init", [("x", "2"), ("y", "<<1, 2>>")]), (2, "Next line 3", [])]
    assert tuple(traces.counterexamples(lines).first()) == ("l", "Safe", 2, 1)


def test_lassos(spark):
    def flat(trace, states):
        return [(trace, i, k, v) for i, s in enumerate(states) for k, v in s.items()]

    rows = flat("a", [{"x": "1", "y": "2"}, {"x": "2", "y": "2"}, {"y": "2", "x": "1"}, {"x": "2", "y": "2"}]) + flat("b", [{"x": "1"}, {"x": "1", "y": None}]) + flat("c", [{"x": "1"}] * 3)
    got = {tuple(r) for r in traces.lassos(spark.createDataFrame(rows, "trace_id string, state_num int, var string, value string")).collect()}
    assert got == {("a", 0, 2, 2), ("c", 0, 1, 1)}


@pytest.mark.parametrize("text, want", [
    ("x = 3", True), ("x # 3 \\/ x > 2", True), ("~(x = 3) => FALSE", True), ("x = 3 => s = \"b\"", False), ("\\A i \\in q : i < 4", True), ("\\E i \\in q : i = 9", False), ("x \\in {1, 3}", True), ("x \\notin 1..2", None),
    ("x \\in {1..2}", False), ("Len(q) + 1 = 4 /\\ Cardinality({1, 1}) = 1", True), ("m.k = \"v\" /\\ m[\"k\"] = \"v\"", True), ("\"k\" \\in DOMAIN m", True), ("n > 1", "null"), ("n > 1 /\\ x = 4", False), ("x % 2 * 2 - 1 = 1", True),
    ("\\A i \\in q : \\E j \\in q : i + j = 4", True), ("\\A i \\in {} : FALSE", True), ("x = 3 => x = 4 => x = 5", True), ("<<1, 2>>[0] = 1", True), ("-x < 0", True), ("\\A x \\in q : x < 4 /\\ \\E x \\in q : x = 3", True),
])
def test_conditions(spark, text, want):
    df = spark.sql("SELECT 3 AS x, 'a' AS s, array(1, 2, 3) AS q, map('k', 'v') AS m, CAST(NULL AS int) AS n")
    scope = {c: F.col(c) for c in df.columns}
    if want is None:
        with pytest.raises(conditions.ConditionError):
            conditions.compile_condition(text, scope)
    else:
        assert df.select(conditions.compile_condition(text, scope)[0]).first()[0] is (None if want == "null" else want)


@pytest.mark.parametrize("text", ["", "x =", "x = 3)", "(x = 3", "\\A x : x", "\\X", "y = 1", "x ~ 3", "\\A i \\in q i = 1", "x = 3 x", "\"open", "{1, 2"])
def test_malformed_conditions(text):
    with pytest.raises(conditions.ConditionError):
        conditions.compile_condition(text, {"x": "x", "q": "q"})


def test_answers(spark):
    texts = {
        1: '```json\n{"gwts": []}\n```', 2: 'x\n```\n {"gwts": [1]} \n```\n```json\n{}\n```', 3: '{"gwts": 5}', 4: "[1]", 5: "no", 6: None, 7: '{"other": 1}',
        8: '{"ins": [{"name": "a"}, {"name": "b", "source": "state", "type_str": "T", "source_file": "f"}], "outs": [{"name": "mutation"}, {}], "do_steps": ["x"], "operational_claim": "c"}', 9: '{"ins": [{"source": "state"}]}',
    }
    df = spark.createDataFrame(list(texts.items()), "id int, answer string")
    assert {r.id: (r.n_gwts, r.error) for r in records.parse_payloads(df).collect()} == {1: (0, None), 2: (1, None), 3: (None, None), 4: (None, "not an object"), 5: (None, "not JSON"), 6: (None, "not JSON"), 7: (None, "no gwts"), 8: (None, "no gwts"), 9: (None, "no gwts")}
    got = {r.id: r for r in records.parse_records(df).collect()}
    assert [tuple(i) for i in got[8].ins] == [("a", "Any", "parameter", None, None, ""), ("b", "T", "state", None, "f", "")] and [tuple(o) for o in got[8].outs] == [("mutation", "Any", ""), ("ok", "Any", "")]
    assert (got[8].do_steps, got[8].failure_modes, got[8].operational_claim, got[8].error) == (["x"], [], "c", None) and got[9].error == "an input without a name" and got[9].ins is None
    assert got[4].error == "not an object" and got[5].error == "not JSON" and got[7].ins == []


def test_elapsed_and_cards(spark):
    df = spark.createDataFrame([(5.2,), (59.96,), (64.5,), (3599.0,), (3725.0,), (0.0,)], "s double")
    assert [r[0] for r in df.select(exprs.elapsed(F.col("s"))).collect()] == ["5.2s", "60.0s", "1m04.5s", "59m59.0s", "1h02m", "0.0s"]
    record = "uuid string, function_name string, class_name string, file_path string, line_number int, do_description string, operational_claim string, do_steps array<string>, failure_modes array<string>"
    rows = spark.createDataFrame([("1", "f", "K", "a.py", 3, "does", "claim", ["one", "two"], ["late", "lost"]), ("2", "g", None, "b.py", None, "does", "claim", [], None)], record)
    ins = spark.createDataFrame([("1", 0, "x", "int", "parameter", "direct")], "record_uuid string, ordinal int, name string, type_str string, source string, dispatch string")
    outs = spark.createDataFrame([("1", 0, "ok", "str", "text")], "record_uuid string, ordinal int, name string, type_str string, description string")
    cards = {r.uuid: r.card for r in store.cards(rows, ins, outs).collect()}
    assert cards["1"] == "### f (K) @ a.py:3\n\n**Claim:** claim\n\n**IN:**\n- x: int (parameter)\n\n**DO:** does\n  1. one\n  2. two\n\n**OUT:**\n- ok: str -- text\n\n**FAILURE MODES:** late; lost\n"
    assert cards["2"] == "### g @ b.py:None\n\n**Claim:** claim\n\n\n**DO:** does\n"


def test_live_progress(spark):
    files = [("a_progress", '{"gwt_id": "gwt-1", "attempt": 2, "max_attempts": 8, "phase": "check", "pid": 7, "updated_at": 90.5}'), ("b_progress", '{"pid": 8}'), ("c_progress", "{bad"), ("d_progress", "[1]"), ("e_progress", '{"pid": 9, "updated_at": 99}')]
    read = status.parse_progress(spark.createDataFrame(files, "name string, text string"))
    live = status.live_progress(read, spark.createDataFrame([("e",)], "gwt_id string"), spark.createDataFrame([(7,)], "pid bigint"), F.lit(100.0))
    assert {tuple(r) for r in live.collect()} == {("gwt-1", "2/8", "check", 9, "running"), ("b", "0/0", "unknown", 0, "stale"), ("e", "0/0", "unknown", 1, "done")}
    assert tuple(status.progress_counts(live).first()) == (1, 1, 1)


def test_stream_goes_stale(spark, tmp_path):
    """An entry without updates turns stale by its timer; a finished one does not."""
    schema = "gwt_id string, attempt bigint, phase string, updated_at double, finished boolean"
    folder = str(tmp_path / "in")

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(folder)

    put(("a", 1, "draft", 1.0, False), ("b", 1, "draft", 1.0, False))
    stream = spark.readStream.schema(schema).json(folder)
    asked = progress.live_states(stream, quiet=1).writeStream.outputMode("update").format("memory").queryName("live").trigger(processingTime="200 milliseconds").start()
    def until(gwt_id, state):
        end = time.time() + 60
        while time.time() < end and not spark.table("live").filter(f"gwt_id = '{gwt_id}' and state = '{state}'").count():
            time.sleep(0.3)

    try:
        until("b", "running")
        put(("b", 2, "done", 2.0, True))
        until("b", "done")
        until("a", "stale")
        seen = {(r.gwt_id, r.attempt, r.state) for r in spark.table("live").collect()}
    finally:
        asked.stop()
    assert {("a", 1, "running"), ("a", 1, "stale"), ("b", 2, "done")} <= seen and ("b", 2, "stale") not in seen
