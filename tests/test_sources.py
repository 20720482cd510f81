import json

import pytest
from pyspark.sql import functions as F

from depweave.sources import documents
from depweave.streaming import progress

CODE = {
    "python": "def hello(name: str) -> str:\n    return f'Hello {name}'\n\nclass Box:\n    async def fetch(self, url: str = 'x') -> bytes:\n        pass\n\n    def _hide(self):\n        pass\n\ndef after(*args, flag=None):\n    pass\n",
    "go": "package x\nfunc Hello(name string) string {\n}\nfunc (s *Server) add(a, b int) int {\n}\n",
    "rust": "fn hello(name: &str) -> String {\n}\npub async fn run(&self, n: u32) {\n}\npub(crate) fn part() {}\n",
    "typescript": "export async function load(id: string, n?: number): Promise<User> {\n}\n",
}


@pytest.fixture()
def tree(tmp_path):
    ends = {"python": "py", "go": "go", "rust": "rs", "typescript": "ts"}
    for language, text in CODE.items():
        (tmp_path / f"m.{ends[language]}").write_text(text)
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "lib.go").write_text("func Lib() {\n}\n")
    (tmp_path / "m_test.go").write_text("func Test() {\n}\n")
    (tmp_path / "bad.py").write_bytes(b"def caf\xe9(): pass\n")
    return str(tmp_path)


def test_sources_by_language(spark, tree):
    found = {lang: sorted(r.path.rsplit("/", 1)[-1] for r in documents.read_sources(spark, tree, lang).collect()) for lang in CODE}
    assert found["go"] == ["m.go"] and found["rust"] == ["m.rs"] and found["typescript"] == ["m.ts"] and "m.py" in found["python"]


def test_graph_round_trip(spark, tmp_path):
    doc = {"nodes": {"b": {"id": "b", "kind": "module"}, "a": {"id": "a", "kind": "resource", "name": "A", "version": 3}}, "edges": [{"from": "a", "to": "b", "edge_type": "calls"}], "test_artifacts": {"a": "t.py"}}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(doc))
    parts = documents.read_graph(spark, str(path))
    again = json.loads(documents.graph_document(*parts).first().value)
    assert list(again["nodes"]) == ["a", "b"] and again["nodes"]["b"] == {"id": "b", "kind": "module", "name": "", "description": "", "version": 1}
    assert again["edges"] == doc["edges"] and again["test_artifacts"] == doc["test_artifacts"]
    path.write_text(json.dumps(again))
    assert [p.count() for p in documents.read_graph(spark, str(path))] == [2, 1, 1]


def test_rules_are_all_or_nothing(spark, tmp_path):
    path = tmp_path / "rules.json"
    rule = {"resource_type": "database", "required_outs": ["audit_event"], "position": "wrap"}
    path.write_text(json.dumps({"rules": [rule]}))
    assert documents.read_rules(spark, str(path)).count() == 1
    for bad in ({"rules": [rule | {"position": "off"}]}, {"rules": [{"resource_type": "x"}]}, {}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            documents.read_rules(spark, str(path))


def test_artefacts_and_bindings(spark, tmp_path):
    (tmp_path / "gwt-0001_result.json").write_text('{"result": "pass", "attempts": 2}')
    (tmp_path / "gwt-0002_attempt1.txt").write_text("x")
    assert [tuple(r) for r in documents.read_results(spark, str(tmp_path)).collect()] == [("gwt-0001", "pass", 2, None)]
    assert [r.gwt_id for r in documents.read_attempts(spark, str(tmp_path)).collect()] == ["gwt-0002"]
    (tmp_path / "b.json").write_text('{"k1": "gwt-0001"}')
    assert [tuple(r) for r in documents.read_bindings(spark, str(tmp_path / "b.json")).collect()] == [("k1", "gwt-0001")]


def test_streams(spark, small, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{small}/events.parquet", tmp_path / "in")
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = progress.latest_results(stream).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    batch = progress.latest_results(spark.read.parquet(f"{small}/events.parquet"))
    assert {tuple(r) for r in spark.table("latest").collect()} == {tuple(r) for r in batch.collect()}
    q = progress.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    closed = spark.table("hours").agg(F.sum("n")).first()[0]
    assert 0 < closed <= spark.read.parquet(f"{small}/events.parquet").count()
