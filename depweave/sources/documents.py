"""Readers and writers: graph documents, rule lists, bindings, source trees, session artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = (
    "struct<id:string,kind:string,name:string,description:string,schema:string,path:string,source_schema:string,source_key:string,"
    "version:int,given:string,`when`:string,`then`:string,text:string,metadata:map<string,string>>"
)
GRAPH = f"nodes map<string,{NODE}>, edges array<struct<`from`:string,`to`:string,edge_type:string>>, test_artifacts map<string,string>"

#: Path parts that a source scan leaves out, and file patterns by language (fixed values).
EXCLUDED = ["__pycache__", ".git", "node_modules", "target", "vendor", "dist", "build", ".venv", "venv"]
PATTERNS = {"python": "*.py", "javascript": "*.js", "typescript": "*.ts", "go": "*.go", "rust": "*.rs"}
SKIPPED = {"javascript": r"\.min\.js$", "typescript": r"\.d\.ts$", "go": r"_test\.go$"}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, test artifacts) of a graph document; closure and components are derived, never read."""
    doc = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    nodes = doc.select(F.explode_outer("nodes").alias("key", "n")).filter("key is not null").select(
        F.coalesce("n.id", "key").alias("id"), "n.kind", F.coalesce("n.name", F.lit("")).alias("name"), F.coalesce("n.description", F.lit("")).alias("description"),
        "n.schema", "n.path", "n.source_schema", "n.source_key", F.coalesce("n.version", F.lit(1)).alias("version"), "n.given", "n.when", "n.then", "n.text", "n.metadata",
    )
    edges = doc.select(F.posexplode("edges").alias("seq", "e")).select(F.col("seq").cast("bigint").alias("seq"), F.col("e.from").alias("from_id"), F.col("e.to").alias("to_id"), "e.edge_type")
    artifacts = doc.select(F.explode("test_artifacts").alias("node_id", "path"))
    return nodes, edges, artifacts


def graph_document(nodes: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The graph as one JSON text (``value``): an exchange form for graphs that fit a document; tables are the store."""
    by_id = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    whole_nodes = F.collect_list(F.struct(F.col("id").alias("key"), F.struct(*[F.col(c) for c in nodes.columns]).alias("node")))
    packed = nodes.agg(F.map_from_entries(F.array_sort(whole_nodes, by_id)).alias("m"))
    links = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "edge_type"))).alias("e"))
    tests = artifacts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_id", "path")))).alias("t"))
    whole = packed.crossJoin(links).crossJoin(tests)
    return whole.select(F.to_json(F.struct(F.col("m").alias("nodes"), F.col("e").alias("edges"), F.when(F.size("t") > 0, F.col("t")).alias("test_artifacts"))).alias("value"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_no, resource_type, required_outs, position): all or nothing; a malformed or partial file raises."""
    from depweave.operators.contracts import POSITIONS

    schema = "rules array<struct<resource_type:string,required_outs:array<string>,position:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rules = doc.select(F.posexplode("rules").alias("rule_no", "r")).select("rule_no", "r.*")
    whole = F.col("resource_type").isNotNull() & F.col("required_outs").isNotNull() & F.col("position").isin(*POSITIONS)
    if doc.filter("rules is null").limit(1).count() or rules.filter(~F.coalesce(whole, F.lit(False))).limit(1).count():
        raise ValueError(f"{path} is not a whole list of rules")
    return rules


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(external_key, internal_id) of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("external_key", "internal_id"))


def read_sources(spark: SparkSession, root: str, language: str) -> DataFrame:
    """(path, content, language, file_hash) of a source tree, read in parallel; bad bytes become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERNS[language]).load(root)
    kept = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED))))
    if language in SKIPPED:
        kept = kept.filter(~F.col("path").rlike(SKIPPED[language]))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select("path", text.alias("content"), F.lit(language).alias("language"), F.sha2(F.encode(text, "UTF-8"), 256).alias("file_hash"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(gwt_id, result, attempts, error) of ``*_result.json`` files, the id from the file's name."""
    rows = spark.read.schema("result string, attempts int, error string").option("multiLine", True).option("pathGlobFilter", "*_result.json").json(folder)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_result\.json$", 1).alias("gwt_id"), "result", "attempts", "error")


def read_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """(gwt_id, file) of the attempt files, by their names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_attempt*.txt").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)_attempt[^/]*\.txt$", 1).alias("gwt_id"), F.col("path").alias("file"))
