from depweave.operators import contracts, status, store

RECORD = "uuid string, function_name string, class_name string, file_path string, line_number int, is_external boolean, src_hash string, do_description string, operational_claim string"
IN = "record_uuid string, ordinal int, name string, type_str string, source string, source_uuid string, source_function string, dispatch string"
OUT = "record_uuid string, ordinal int, name string, type_str string, description string"


def record(u, name, path="src/a.py", external=False, described="does it"):
    return (u, name, None, path, 42, external, "hash", described, "claim")


def test_seam_report(spark):
    records = spark.createDataFrame([record("A", "get_name"), record("B", "b"), record("C", "c"), record("D", "d")], RECORD)
    ins = spark.createDataFrame([("B", 0, "name", "str", "internal_call", "A", "get_name", "direct"), ("C", 0, "count", "int", "internal_call", "A", "get_name", "direct"), ("D", 0, "data", "dict", "internal_call", None, "lost", "direct")], IN)
    outs = spark.createDataFrame([("A", 1, "ok", "int", ""), ("A", 0, "ok", "str", "")], OUT)
    assert contracts.seam_report(records, ins, outs).first().asDict() == {"mismatches": 1, "unresolved": 1, "satisfied": 1, "total_edges": 3}
    bad = contracts.seam_mismatches(records, ins, outs).first()
    assert (bad.callee_uuid, bad.expected_type, bad.provided_type, bad.severity) == ("C", "int", "str", "type_mismatch")
    none = contracts.seam_mismatches(records, ins, outs.filter("false"))
    assert {r.severity for r in none.collect()} == {"no_ok_output"}


def test_rules(spark):
    rules = spark.createDataFrame([(0, "database", ["audit_event"]), (1, "external_api", ["span_id", "trace_context"])], "rule_no int, resource_type string, required_outs array<string>")
    ins = spark.createDataFrame([("A", 0, "x", "str", "internal_call", "B", "b", "direct")], IN)

    def summary(path, external, outs):
        records = spark.createDataFrame([record("A", "a"), record("B", "b", path, external)], RECORD)
        r = contracts.contract_summary(records, ins, spark.createDataFrame(outs, OUT), rules).first()
        return r.violations, r.satisfied, r.total_checked

    assert summary("src/db/store.py", False, [("B", 0, "ok", "str", "")]) == (1, 0, 1)
    assert summary("src/db/store.py", False, [("B", 0, "side_effect", "audit_event", "")]) == (0, 1, 1)
    assert summary("src/utils.py", False, [("B", 0, "ok", "str", "")]) == (0, 0, 0)
    assert summary("redis", True, [("B", 0, "ok", "span_id", "trace_context")]) == (0, 1, 1)


def test_staleness_and_backfill(spark):
    records = spark.createDataFrame([record("a", "func_a"), record("b", "func_b", "src/b.py"), record("c", "func_b", "src/c.py")], RECORD)
    ins = spark.createDataFrame([("a", 0, "x", "str", "internal_call", None, "func_b", "direct")], IN)
    filled = store.backfill(records, ins)
    assert filled.first().source_uuid == "b"
    now = spark.createDataFrame([("src/b.py", "new"), ("src/a.py", "hash")], "file_path string, src_hash string")
    seeds = store.stale(records, now)
    assert {r.uuid for r in seeds.collect()} == {"b"}
    assert {r.uuid for r in store.transitively_stale(records, filled, seeds).collect()} == {"a", "b"}
    assert {r.uuid for r in store.neighbourhood(records, filled, "func_a", "forward").collect()} == {"a", "b"}
    assert store.unresolved(records, filled).count() == 0


def test_upsert_cuts_inbound(spark):
    records = spark.createDataFrame([record("a", "fa"), record("b", "fb")], RECORD)
    ins = spark.createDataFrame([("a", 0, "x", "str", "internal_call", "b", "fb", "direct"), ("b", 0, "y", "int", "parameter", None, None, "direct")], IN)
    outs = spark.createDataFrame([("b", 0, "ok", "str", "")], OUT)
    new = spark.createDataFrame([record("b", "fb2")], RECORD)
    for keep, want in ((False, None), (True, "b")):
        r, i, o = store.upsert_records(records, ins, outs, new, ins.filter("false"), outs.filter("false"), keep_inbound=keep)
        assert {(x.uuid, x.function_name) for x in r.collect()} == {("a", "fa"), ("b", "fb2")}
        assert [(x.record_uuid, x.source_uuid) for x in i.collect()] == [("a", want)] and o.count() == 0


def test_keep_last(spark):
    df = spark.createDataFrame([("f", 1, "old"), ("f", 2, "new")], "k string, n int, v string")
    assert [r.v for r in store.keep_last(df, ["k"], "n").collect()] == ["new"]


def test_scoreboard(spark):
    items = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "gwt_id string")
    results = spark.createDataFrame([("1", "pass", 1), ("2", "fail", 8)], "gwt_id string, result string, attempts int")
    attempts = spark.createDataFrame([("3", "x")], "gwt_id string, file string")
    bridged = spark.createDataFrame([("1",)], "gwt_id string")
    r = status.roll_up(status.item_status(items, results, attempts, bridged)).first().asDict()
    assert r == {"verified": 1, "failed": 1, "in_progress": 1, "pending": 1, "bridge_complete": 1, "total": 4}
