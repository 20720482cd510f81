import uuid

import pytest
from pyspark.sql import functions as F

from depweave.functions import exprs, text

TYPES = [
    ("list[FnRecord]", "list[FnRecord]", True), ("Dict[str, Any]", "Config", False), ("dict[str, Any]", "Dict[str, Any]", True), ("List[int]", "list[int]", True),
    ("Optional[str]", "str | None", True), ("str", "str | None", True), ("Any", "Config", True), ("Config", "Any", True), ("int", "str", False),
    ("str | None", "str | int | None", False), ("None | str", "str | None", False), ("str | None", "str", False), ("Optional[str]", "None", False),
]


def test_type_compatibility(spark):
    df = spark.createDataFrame([(p, e) for p, e, _ in TYPES], "p string, e string")
    assert [r[0] for r in df.select(exprs.type_compatible(F.col("p"), F.col("e"))).collect()] == [x for *_, x in TYPES]
    wide = spark.createDataFrame([("str | None", "str | int | None")], "p string, e string")
    assert wide.select(exprs.type_compatible(F.col("p"), F.col("e"), wide_unions=True)).first()[0]


def test_uuid5(spark):
    names = [f"src/m{i}.py::{'C' * (i % 3)}::f{i}é" for i in range(200)] + ["src/main.py::::handler"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(exprs.uuid5(F.col("n"))).collect()]
    ns = uuid.UUID("f47ac10b-58cc-4372-a567-0e02b2c3d479")
    assert got == [str(uuid.uuid5(ns, n)) for n in names]
    assert got[-1] == "8f4a6990-ee8f-5e1a-bf24-0c12882f3127"


@pytest.mark.parametrize("given, want", [("Auth system", "auth_system"), ("  A--b!! ", "a_b"), ("x" * 39 + " y", "x" * 39), ("", "")])
def test_slug(spark, given, want):
    assert spark.range(1).select(exprs.slug(F.lit(given))).first()[0] == want


def test_verdicts_and_times(spark):
    row = spark.range(1).select(exprs.verdict(F.lit("0 failures")), exprs.verdict(F.lit("Warning, passed")), exprs.verdict(F.lit("pass")), exprs.verdict(F.lit("?")), exprs.elapsed(F.lit(3725.0)), exprs.elapsed(F.lit(64))).first()
    assert list(row) == ["fail", "warning", "pass", "unknown", "1h02m", "1m04.0s"]


def test_mentions(spark):
    t = "We need to modify get_user() and validate_input() in src/handlers/user.py, see get_user() and backend/services/ too"
    m = spark.range(1).select(text.mentions(F.lit(t)).alias("m")).first()["m"]
    assert m["functions"] == ["get_user", "validate_input"] and m["files"] == ["src/handlers/user.py"] and m["directories"] == ["backend/services/"]
    t = "Look at `src/handlers`, './models/user.rb', lib/a.java, but not notes/b.json; at pkg/x.tla too"
    m = spark.range(1).select(text.mentions(F.lit(t)).alias("m")).first()["m"]
    assert m["files"] == ["./models/user.rb", "lib/a.java"] and m["directories"] == ["src/handlers", "notes/b.json", "pkg/x.tla"]


@pytest.mark.parametrize("said, files, folders", [
    ("a.py.bak src/a.py.bak", ["a.py", "src/a.py"], ["src/a.py.bak"]), (".py src/.py ..py x/..py", ["..py", "x/..py"], []), ("/x /x/ x/ / //", [], ["/x/", "x/"]), ("../up/a.go: (lib/b.rs) lib/b.rs)", ["../up/a.go", "lib/b.rs"], []),
    ("a//b.py lib/core! lib/core.", [], ["lib/core."]), ("é/ü.py", ["é/ü.py"], []), ("", [], []), ("./m.tsx;`q/r.d/`", ["./m.tsx"], ["q/r.d/"]), ("a/b.py/c", [], ["a/b.py/c"]), ("b.py! c/d.js!", [], ["c/d"]),
])
def test_paths(spark, said, files, folders):
    m = spark.range(1).select(text.mentions(F.lit(said)).alias("m")).first()["m"]
    assert (m["files"], m["directories"]) == (files, folders)


def test_directories(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",), ("a/d.py",)], "file_path string")
    found = text.directories(files)
    assert {tuple(r) for r in found.collect()} == {("a", 2), ("a/b", 1)}
    assert [r[0] for r in text.collapse_directories(found).collect()] == ["a"]


def test_traces(spark):
    rows = [(1, 1, "Init", "x", "0"), (1, 2, "Step", "x", "1"), (1, 3, "Done", "x", "1")]
    df = spark.createDataFrame(rows, "trace_id int, state_num int, label string, var string, value string")
    assert {(r.state_num, r.before, r.value) for r in text.trace_diff(df).collect()} == {(1, None, "0"), (2, "0", "1")}
    s = text.trace_summary(df).first()
    assert (s.step_count, s.first_label, s.last_label, s.actions) == (3, "Init", "Done", "Step,Done")
