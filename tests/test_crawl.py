"""Crawls, registrations, strongly connected sets and the whole bridge on small tables, against step-by-step models."""

import random

import pytest

from depweave.operators import crawl, graph, register, status, store, strong

RECORD = "uuid string, function_name string, class_name string, file_path string, line_number int, is_external boolean, src_hash string, do_description string, operational_claim string"
CALL = "record_uuid string, ordinal int, source string, source_function string, source_file string"


def record(u, name, path="a.py", line=1, external=False, described="SKELETON_ONLY"):
    return (u, name, None, path, line, external, "h", described, f"claims {name}")


def names(spark, *ids, column="uuid"):
    return spark.createDataFrame([(i,) for i in ids], f"{column} string")


def entries(spark, *found):
    return spark.createDataFrame(list(enumerate(found)), "rank int, function_name string")


def come(df):
    return sorted((r.uuid, r.depth, r.parent, r.outcome) for r in df.collect())


def test_follows_internal_calls(spark):
    records = spark.createDataFrame([record("h", "handler", "main.py"), record("v", "validate", "validate.py")], RECORD)
    ins = spark.createDataFrame([("h", 0, "parameter", None, None), ("h", 1, "internal_call", "validate", "validate.py")], CALL)
    assert come(crawl.crawl(records, ins, entries(spark, "handler"))) == [("h", 0, None, "extracted"), ("v", 1, "h", "extracted")]


def test_cycle_is_visited_once(spark):
    records = spark.createDataFrame([record("a", "a"), record("b", "b")], RECORD)
    ins = spark.createDataFrame([("a", 0, "internal_call", "b", "a.py"), ("b", 0, "internal_call", "a", "a.py")], CALL)
    assert come(crawl.crawl(records, ins, entries(spark, "a"))) == [("a", 0, None, "extracted"), ("b", 1, "a", "extracted")]


def test_external_calls_and_budget(spark):
    records = spark.createDataFrame([record(f"f{i}", f"func_{i}", line=i) for i in range(10)], RECORD)
    ins = spark.createDataFrame([("f0", 0, "external", "redis.get", "redis"), ("f9", 0, "external", "lost", None)], CALL)
    done = crawl.crawl(records, ins, entries(spark, "func_0"), max_functions=3)
    assert come(done) == [("f0", 0, None, "extracted")] + [(f"f{i}", None, None, "extracted") for i in (1, 2)]
    assert crawl.crawl_counts(done, records, ins).first().asDict() == {"extracted": 3, "failed": 0, "skipped": 0, "ax_records": 1}
    assert come(crawl.crawl(records, ins, entries(spark, "nobody"), sweep=False)) == []


def test_failed_and_skipped_lead_nowhere(spark):
    records = spark.createDataFrame([record("a", "a"), record("b", "b", "b.py", described="done"), record("c", "c", described="done"), record("d", "d", "d.py", described="x")], RECORD)
    ins = spark.createDataFrame([("a", 0, "internal_call", "d", None), ("b", 0, "internal_call", "c", None)], CALL)
    now = spark.createDataFrame([("b.py", "h"), ("a.py", "new")], "file_path string, src_hash string")
    done = crawl.crawl(records, ins, entries(spark, "a", "b"), current=now, failing=names(spark, "a"))
    assert come(done) == [("a", 0, None, "failed"), ("b", 0, None, "skipped")]


@pytest.mark.parametrize("seed", range(2))
def test_budget_against_model(spark, seed):
    """Level by level in the order of parents and inputs, with a budget, a visited set and failures."""
    rnd = random.Random(seed)
    ids = [f"u{i:02}" for i in range(30)]
    rows = [record(u, f"n{i % 24}", f"f{i % 3}.py", line=rnd.randrange(9), external=rnd.random() < 0.1, described=rnd.choice(["SKELETON_ONLY", "EXTRACTION_FAILED", "done"])) for i, u in enumerate(ids)]
    calls = [(rnd.choice(ids), k, "internal_call", f"n{rnd.randrange(26)}", rnd.choice([None, "f0.py", "f1.py"])) for k in range(70)]
    visited, failing, most = set(rnd.sample(ids, 3)), set(rnd.sample(ids, 5)), rnd.randrange(6, 16)
    own = {r[0]: r for r in rows if not r[5]}

    def find(name, path):
        here = [u for u, r in own.items() if r[1] == name and r[3] == path]
        return min(here or [u for u, r in own.items() if r[1] == name], default=None)

    seen, want, left = set(visited), [], most
    level = []
    for name in ("n3", "n1", "n99", "n5"):
        u = find(name, None)
        if u and u not in [x for x, _ in level]:
            level.append((u, None))
    depth = 0
    while level and left > 0:
        done = []
        for u, parent in level:
            if u in seen or left <= 0:
                continue
            seen.add(u)
            outcome = "failed" if u in failing else "extracted"
            left -= outcome == "extracted"
            want.append((u, depth, parent, outcome))
            if outcome == "extracted":
                done.append(u)
        level = []
        for u in done:
            for _, _, _, name, path in sorted((c for c in calls if c[0] == u), key=lambda c: c[1]):
                found = find(name, path)
                if found and found not in [x for x, _ in level]:
                    level.append((found, u))
        depth += 1
    for u in sorted((u for u, r in own.items() if r[7] != "done" and u not in seen), key=lambda u: (own[u][3], own[u][4], u)):
        if left > 0:
            outcome = "failed" if u in failing else "extracted"
            left -= outcome == "extracted"
            want.append((u, None, None, outcome))
    records, ins = spark.createDataFrame(rows, RECORD), spark.createDataFrame(calls, CALL)
    got = crawl.crawl(records, ins, entries(spark, "n3", "n1", "n99", "n5"), visited=names(spark, *visited), max_functions=most, failing=names(spark, *failing))
    assert sorted(come(got), key=str) == sorted(want, key=str)


def test_run_counts_in_the_same_pass(spark, tmp_path):
    d = spark.createDataFrame([("a", "created"), ("b", "created"), ("c", "adopted"), ("d", "failed")], "uuid string, disposition string")
    run = crawl.record_run(d, str(tmp_path / "d"), {"target_path": "x"}).first()
    assert (run.records_created, run.records_updated, run.records_skipped, run.records_failed, run.records_adopted, run.target_path) == (2, 0, 0, 1, 1, "x")
    assert spark.read.parquet(str(tmp_path / "d")).count() == 4 and run.started_at <= run.completed_at


@pytest.mark.parametrize("seed", range(3))
def test_strong_sets(spark, seed):
    rnd = random.Random(seed)
    n = 14
    pairs = [(f"v{rnd.randrange(n):02}", f"v{rnd.randrange(n):02}") for _ in range((16, 24, 9)[seed])] + [(f"w{i}", f"w{i + 1}") for i in range(6)]
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(a):
        met, ahead = set(), [a]
        while ahead:
            for b in out.get(ahead.pop(), ()):
                if b not in met:
                    met.add(b)
                    ahead.append(b)
        return met

    want = {}
    for a in {x for p in pairs for x in p}:
        mine = {b for b in reach(a) if a in reach(b)} - {a}
        if mine:
            want[a] = min(mine | {a})
    edges = spark.createDataFrame(pairs, "from_id string, to_id string")
    assert {r.node: r.part for r in strong.strong_sets(edges).collect()} == want
    assert strong.strong_sets(edges.limit(0)).count() == 0


def test_order_is_kept():
    """Accepted edges never close a cycle, refused ones always would."""
    rnd = random.Random(5)
    g, out = strong.Ordered(), {}
    for _ in range(400):
        a, b = rnd.sample(range(25), 2)
        met, ahead = {b}, [b]
        while ahead:
            for x in out.get(ahead.pop(), ()):
                if x not in met:
                    met.add(x)
                    ahead.append(x)
        assert g.add(a, b) == (a not in met)
        if a not in met:
            out.setdefault(a, set()).add(b)


A, B, C, X = (f"{c * 8}-{c * 4}-{c * 4}-{c * 4}-{c * 12}" for c in "abcd")


def test_whole_bridge(spark):
    """Nodes with their claims, calls tried in order, duplicates counted, orphans gone with their edges."""
    nodes = spark.createDataFrame([(X, "resource", "old", "o"), ("gwt-0001", "behavior", "kept", None)], "id string, kind string, name string, description string")
    edges = spark.createDataFrame([("gwt-0001", X, "depends_on"), ("gwt-0001", A, "depends_on")], "from_id string, to_id string, edge_type string")
    records = spark.createDataFrame([record(A, "f"), record(B, "g", "b.py"), record(C, "redis", external=True)], RECORD)
    ins = [(A, B, "direct"), (A, B, "override"), (B, A, "direct"), (A, X, "direct"), (A, C, "direct")]
    deps = spark.createDataFrame(ins, "dependent_uuid string, dependency_uuid string, dispatch string")
    after, linked, counters = graph.bridge(nodes, edges, records, deps)
    assert {r.id: (r.name, r.description) for r in after.collect()} == {A: ("f @ a.py", "claims f"), B: ("g @ b.py", "claims g"), "gwt-0001": ("kept", None)}
    assert {tuple(r) for r in linked.collect()} == {("gwt-0001", A, "depends_on"), (A, B, "calls")}
    assert counters.first().asDict() == {"nodes_added": 2, "edges_added": 3, "orphans_removed": 1}


def test_registration_twice(spark):
    node = "id string, kind string, name string"
    nodes = spark.createDataFrame([("req-0007", "requirement", "old"), ("r1", "resource", "r"), ("gwt-0002", "behavior", "b")], node)
    edges = spark.createDataFrame([], "from_id string, to_id string, edge_type string")
    bound = spark.createDataFrame([("req:R9", "req-0007"), ("gwt:c0", "gwt-0002")], "binding string, id string")
    reqs = spark.createDataFrame([(0, "R1", "Users must be able to log in", None), (1, "R2", "two", "named"), (2, "R1", "again", None)], "place int, id string, text string, name string")
    gwts = spark.createDataFrame(
        [
            (0, "c1", "g", "It Runs!", "t", "R2", None, ["r1", "none"]), (1, "c0", "g", "w", "t", "R1", None, ["r1"]), (2, "c2", "g", "w", "t", "req-0007", "n", []),
            (3, "c3", "g", "w", "t", "R9", "n", None), (4, "c4", "g", "w", "t", "lost", "n", ["r1", "r1"]), (5, "c5", "g", "w", "t", None, "n", []),
        ],
        "place int, criterion_id string, given string, `when` string, then string, parent_req string, name string, depends_on array<string>",
    )
    after, linked, bindings, answer = register.register(nodes, edges, bound, reqs, gwts)
    ids = {(r.kind, r.key): r.id for r in answer.collect()}
    assert ids == {("req", "R1"): "req-0008", ("req", "R2"): "req-0009", ("gwt", "c0"): "gwt-0002", **{("gwt", f"c{i}"): f"gwt-000{i + 2}" for i in range(1, 6)}}
    assert {r.id: r.name for r in after.collect()} == {"req-0007": "old", "r1": "r", "gwt-0002": "b", "req-0008": "users_must_be_able_to_log_in", "req-0009": "named", "gwt-0003": "it_runs", **{f"gwt-000{i}": "n" for i in (4, 5, 6, 7)}}
    want = {("req-0009", "gwt-0003", "decomposes"), ("gwt-0003", "r1", "depends_on"), ("req-0007", "gwt-0004", "decomposes"), ("req-0007", "gwt-0005", "decomposes"), ("gwt-0006", "r1", "depends_on")}
    assert {tuple(r) for r in linked.collect()} == want and linked.count() == len(want)
    twice = register.register(after, linked, bindings, reqs, gwts)
    assert {(r.kind, r.key): r.id for r in twice[3].collect()} == ids and twice[0].count() == after.count() and twice[1].count() == len(want) and twice[2].count() == bindings.count()


def test_names_resolve_to_internal_records(spark):
    """A hint of a file comes before any file, external records never answer, visited ones are left out."""
    records = spark.createDataFrame([record("x", "f", external=True), record("y", "f", "b.py"), record("z", "f", "c.py"), record("s", "g")], RECORD)
    ins = spark.createDataFrame([("s", 0, "internal_call", "f", "c.py"), ("s", 1, "internal_call", "f", "none.py"), ("y", 0, "internal_call", "g", None), ("y", 1, "external", "f", None)], CALL)
    found = lambda *gone: {(r.record_uuid, r.next_uuid) for r in store.next_calls(records, ins, names(spark, *gone)).collect()}
    assert found() == {("s", "z"), ("s", "y"), ("y", "s")} and found("y") == {("s", "z"), ("y", "s")}
    assert {r.uuid for r in store.by_file(records, names(spark, "a.py", "b.py", column="file_path")).collect()} == {"y", "s"}


def test_dispositions(spark):
    """An existing record is updated although a donor describes it; only a new one is adopted."""
    schema = "uuid string, function_name string, class_name string, src_hash string"
    described = lambda u, n, h: (u, n, None, "a.py", 1, False, h, "done", "c")
    records = spark.createDataFrame([described("d", "f", "new"), described("e", "f", "old"), described("s", "g", "same")], RECORD)
    skeletons = spark.createDataFrame([("e", "f", None, "new"), ("n", "f", "", "new"), ("m", "f", None, "new"), ("s", "g", None, "same"), ("q", "h", None, "x")], schema)
    got = {r.uuid: (r.disposition, r.donor) for r in status.ingest_disposition(skeletons, records).collect()}
    assert got == {"e": ("updated", "d"), "n": ("adopted", "d"), "m": ("adopted", "d"), "s": ("skipped", None), "q": ("created", None)}
    assert {r.disposition for r in status.ingest_disposition(skeletons.filter("uuid = 's'"), records, incremental=False).collect()} == {"updated"}


def test_verdicts(spark):
    said = spark.createDataFrame([("a", "fine?"), ("b", "?"), ("b", "PASS"), ("c", "?"), ("c", "a warning"), ("d", "warning"), ("d", "critical")], "`group` string, text string")
    assert {r.group: (r.verdict, r.exit_code) for r in status.verdicts(said).collect()} == {"a": ("pass", 0), "b": ("pass", 0), "c": ("warning", 0), "d": ("fail", 1)}


def test_entry_point_tiers(spark):
    """Explicit names come first, then stored ones, then the project's skeletons."""
    rows = lambda *r: spark.createDataFrame(list(r), "project int, function_name string")
    records = spark.createDataFrame([(1, "a", "SKELETON_ONLY"), (2, "b", "SKELETON_ONLY"), (3, "c", "SKELETON_ONLY"), (3, "d", "done")], "project int, function_name string, do_description string")
    got = store.entry_names(rows((1, "x")), rows((1, "y"), (2, "z")), records)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "z"), (3, "c")]


def test_resource_types(spark):
    """Stored records carry no contract, so its branches count only when asked for."""
    from pyspark.sql import functions as F

    from depweave.operators import contracts

    rows = [("1", True, "x", None), ("2", False, "src/DB/x.py", None), ("3", False, "a_store.py", None), ("4", False, "x", "Reads a Database"), ("5", False, "x", "sends to the MQ"), ("6", False, "x", "a queue")]
    df = spark.createDataFrame(rows, "id string, is_external boolean, file_path string, boundary_contract string")
    met = lambda kind, **kw: {r.id for r in df.filter(contracts.matches_resource(F.lit(kind), **kw)).collect()}
    assert met("external_api") == {"1"} and met("database") == {"2", "3"} and met("message_queue") == set() and met("other") == set()
    assert met("database", use_contract=True) == {"2", "3", "4"} and met("message_queue", use_contract=True) == {"5", "6"}


def test_failures_and_crossings(spark):
    from pyspark.sql import functions as F

    from depweave.functions import exprs

    said = ["Deadlock reached; Unknown operator: x", "Invariant A  is violated and Deadlock reached", "12 states generated, 7 distinct states", "5 states generated\n3 distinct", ""]
    df = spark.createDataFrame([(t,) for t in said], "t string").select(exprs.failure_class(F.col("t"), F.lit(True)).alias("k"), exprs.failure_class(F.col("t"), F.lit(False)).alias("s"), exprs.state_counts(F.col("t")).alias("n"))
    got = df.collect()
    assert [r.k for r in got] == ["deadlock", "invariant_violation", "unknown", "unknown", "unknown"] and {r.s for r in got} == {"syntax_error"}
    assert [r.n and tuple(r.n) for r in got] == [None, None, (12, 7), None, None]
    edges = spark.createDataFrame([("a-1", "b-1", "calls"), ("b-1", "a-1", "calls"), ("a-1", "a-2", "calls"), ("a-1", "b-1", "calls")], "from_id string, to_id string, edge_type string")
    found = graph.cross_invariants(edges, names(spark, "a-1", "a-2", column="id"), names(spark, "b-1", column="id"))
    assert sorted(r.name for r in found.collect()) == ["Cross_a_1_b_1_calls", "Cross_b_1_a_1_calls"]
