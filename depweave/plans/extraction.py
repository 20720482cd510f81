"""Queries of the rule-table extraction: schema documents are nested out of customers' orders and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.operators import extract
from depweave.plans.registry import QUERIES, SQL
from depweave.session import table

#: id, source_schema, source_key, path: what every customer's registry holds.
_TYPES = [
    ("r-proc", "backend", "processors.Name", "backend/processors/Name"), ("r-short", "backend", "", "backend/service"), ("r-svc", "backend", "services.Name", "backend/services/Name"),
    ("r-dao", "backend", "data_access_objects.Name", "backend/data_access_objects/Name"), ("r-ep", "backend", "endpoints.Name", "backend/endpoints/Name"),
    ("r-rh", "backend", "request_handlers", "backend/request_handlers/Name"), ("r-ds", "backend", "data_structures", "backend/data_structures"), ("r-log", "backend", "logging", "logging"),
    ("r-slog", "shared", "logging", "shared/logging"), ("r-dt", "shared", "data_types.Name", "shared/data_types/Name"), ("r-mod", "frontend", "modules.Name", "frontend/modules/Name"),
    ("r-comp", "frontend", "components", "frontend/components"), ("r-dl", "frontend", "data_loaders.Name", "frontend/data_loaders/Name"),
]


def _entry(id_: str, schema: str, key: str, path: str) -> str:
    return f'"{id_}": {{"name": "{id_}", "source_schema": "{extract.SCHEMAS[schema]}", "source_key": "{key}", "path": "{path}"}}'


def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, body): filters are no resource of the first five nations; furniture has services of its own, which come last."""
    customer = table(spark, sf_dir, "customer")
    filters = F.when(F.col("c_nationkey") >= 5, ", " + _entry("r-flt", "backend", "filters", "backend/filters")).otherwise("")
    own = F.when(F.col("c_mktsegment") == "FURNITURE", _entry("r-svc2", "backend", "services.Other", "backend/services/Other")).otherwise("")
    body = F.concat(F.lit('{"resources": {' + ", ".join(_entry(*t) for t in _TYPES)), filters, F.lit('}, "conditional_resources": {'), own, F.lit("}}"))
    return customer.select(F.concat(F.lit("cust-"), "c_custkey").alias("project"), body.alias("body"))


def _paths() -> Column:
    k = F.col("l_partkey") % 7
    return (
        F.when(k == 0, F.concat(F.lit("backend/services/S"), "l_suppkey")).when(k == 1, F.concat(F.lit("backend/service_"), "l_suppkey")).when(k == 2, "backend/data_access_objects")
        .when(k == 3, "shared/data_types/T").when(k == 4, F.concat(F.lit("nowhere/"), "l_suppkey")).when((k == 5) & (F.col("l_quantity") > 45), "backend/request_handlers/R").otherwise("")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, schema, body): one backend and one frontend document per customer with orders; machinery's frontends are cut off."""
    # dealt by order once: the lines of a number, those of an order and the order itself meet there
    dealt = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_returnflag") == "A").alias("calls"), _paths().alias("path")).repartition("o_orderkey")
    lines = dealt.groupBy("o_orderkey", "l_linenumber").agg(F.max("calls").alias("calls"), F.array_sort(F.collect_set("path")).alias("paths"))
    functions = F.concat(F.lit('"fn-'), "l_linenumber", F.lit('": '), F.when(F.col("calls"), '{"calls": ["dao"]}').otherwise('{"calls": [], "note": "calls"}'))
    imports = F.transform("paths", lambda p: F.concat(F.lit('{"path": "'), p, F.lit('"}')))
    per_order = lines.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list(functions)), ", ").alias("functions"), F.array_join(F.flatten(F.collect_list(imports)), ", ").alias("imports"))
    orders = table(spark, sf_dir, "orders").join(per_order, "o_orderkey", "left")
    name = lambda kind, text: F.concat(F.lit(f'"{kind}-'), "o_orderkey", F.lit('": '), text)
    listed = lambda kind, text: F.array_join(F.array_sort(F.collect_list(name(kind, text))), ", ")
    parts = {
        "services": listed("svc", F.concat(F.lit('{"functions": {'), F.coalesce("functions", F.lit("")), F.lit("}}"))),
        "processors": listed("proc", F.concat(F.lit('{"imports": {"internal": ['), F.coalesce("imports", F.lit("")), F.lit('], "external": [{"path": "backend/endpoints"}]}}'))),
        "endpoints": listed("ep", F.concat(F.lit("{"), F.when(F.col("o_orderstatus") == "O", '"handler": null, ').otherwise(""), F.when(F.col("o_orderpriority").startswith("1"), '"filters": ["f", "g"]').otherwise('"filters": []'), F.lit("}"))),
        "request_handlers": listed("rh", F.concat(F.lit("{"), F.when(F.col("o_orderstatus") == "F", '"dependencies": ["s"], ').otherwise(""), F.lit('"functions": {"f": '), F.when(F.col("o_totalprice") > 400000, '{"operation": "x"}').otherwise('"operation"'), F.lit("}}"))),
        "modules": listed("m", F.when(F.col("o_totalprice") > 200000, '{"components": ["c"], "navigation": {"home": {"data_loaders": ["d"], "access_controls": ["a"]}}}').otherwise('{"navigation": {"home": []}}')),
        "data_loaders": listed("dl", F.concat(F.lit('{"api_reference": "'), F.when(F.col("o_orderpriority").startswith("2"), "see backend/endpoints/E").otherwise("elsewhere"), F.lit('"}'))),
    }
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[v.alias(k) for k, v in parts.items()])
    found = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(per, "c_custkey").withColumn("project", F.concat(F.lit("cust-"), "c_custkey"))
    member = lambda k: F.concat(F.lit(f'"{k}": {{'), k, F.lit("}"))
    log = F.concat(F.lit('"logging": {"format": "'), F.when(F.col("c_mktsegment") == "BUILDING", "as shared/logging says").otherwise("plain"), F.lit('"}'))
    related = F.lit('"data_structures": {"a": {"relations": {"b": {"to": "a"}, "c": "no object"}}}')
    comma = F.lit(", ")
    backend = F.concat(F.lit("{"), member("services"), comma, member("processors"), comma, member("endpoints"), comma, member("request_handlers"), comma, related, comma, log, F.lit("}"))
    frontend = F.concat(F.lit("{"), member("modules"), comma, member("data_loaders"), F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise("}"))
    one = lambda schema, body: F.struct(F.lit(extract.SCHEMAS[schema]).alias("schema"), body.alias("body"))
    return found.select("project", F.inline(F.array(one("backend", backend), one("frontend", frontend))))


_FACTS = """WITH line AS (SELECT o_custkey, l_returnflag, CASE l_partkey % 7 WHEN 0 THEN 'backend/services/S' || l_suppkey WHEN 1 THEN 'backend/service_' || l_suppkey WHEN 2 THEN 'backend/data_access_objects' WHEN 3 THEN 'shared/data_types/T'
        WHEN 4 THEN 'nowhere/' || l_suppkey WHEN 5 THEN CASE WHEN l_quantity > 45 THEN 'backend/request_handlers/R' ELSE '' END ELSE '' END AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    own AS (SELECT c_custkey, 'cust-' || c_custkey AS project, c_nationkey, c_mktsegment, CASE c_mktsegment WHEN 'FURNITURE' THEN 'r-svc2' ELSE 'r-svc' END AS svc FROM customer),
    prefixes AS (SELECT c_custkey, prefix, CASE WHEN uid = 'r-svc' THEN svc ELSE uid END AS uid FROM own, (VALUES ('backend/services', 'r-svc'), ('backend/service', 'r-short'), ('backend/data_access_objects', 'r-dao'), ('backend/endpoints', 'r-ep'),
        ('backend/request_handlers', 'r-rh'), ('backend/data_structures', 'r-ds'), ('shared/logging', 'r-slog'), ('shared/data_types', 'r-dt'), ('backend/processors', 'r-proc')) v(prefix, uid)),
    paths AS (SELECT DISTINCT o_custkey AS c_custkey, path FROM line),
    resolved AS (SELECT p.c_custkey, p.path, arg_max(x.uid, length(x.prefix)) AS uid FROM paths p LEFT JOIN prefixes x ON x.c_custkey = p.c_custkey AND starts_with(p.path, x.prefix) GROUP BY ALL)"""


def extract_paths(spark, sf_dir):
    """The import paths that lines name, resolved by longest prefix."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    paths = line.select(F.concat(F.lit("cust-"), "o_custkey").alias("project"), _paths().alias("path")).repartition("project").distinct()
    return extract.resolve_paths(paths, extract.path_map(extract.resources(registries(spark, sf_dir))))


def extract_edges(spark, sf_dir):
    return extract.extract_edges(documents(spark, sf_dir), registries(spark, sf_dir))


def extract_resources(spark, sf_dir):
    return extract.resources(registries(spark, sf_dir)).select("project", "id", "kind", "source_key", "path")


QUERIES |= {"extract_paths": extract_paths, "extract_edges": extract_edges, "extract_resources": extract_resources}
SQL["extract_paths"] = _FACTS + " SELECT 'cust-' || c_custkey AS project, path, uid FROM resolved"
SQL["extract_resources"] = "SELECT 'cust-' || c_custkey AS project, id, 'resource' AS kind, source_key, path FROM customer, (VALUES " + ", ".join(f"('{i}', '{k}', '{p}', 'all')" for i, _, k, p in _TYPES) + """,
    ('r-flt', 'filters', 'backend/filters', 'far'), ('r-svc2', 'services.Other', 'backend/services/Other', 'own')) v(id, source_key, path, who)
    WHERE who = 'all' OR (who = 'far' AND c_nationkey >= 5) OR (who = 'own' AND c_mktsegment = 'FURNITURE')"""
SQL["extract_edges"] = _FACTS + """,
    o AS (SELECT o_custkey AS c_custkey, bool_or(o_orderstatus = 'O') AS handled, bool_or(o_orderpriority LIKE '1%') AS filtered, bool_or(o_orderstatus = 'F') AS depends, bool_or(o_totalprice > 400000) AS operates, bool_or(o_totalprice > 200000) AS shown,
        bool_or(o_orderpriority LIKE '2%') AS refers FROM orders GROUP BY 1),
    p AS (SELECT own.*, o.* EXCLUDE (c_custkey), EXISTS (SELECT 1 FROM line WHERE o_custkey = own.c_custkey AND l_returnflag = 'A') AS calls, EXISTS (SELECT 1 FROM resolved r WHERE r.c_custkey = own.c_custkey AND uid = 'r-rh') AS to_rh FROM own JOIN o USING (c_custkey))
    SELECT DISTINCT 'cust-' || c_custkey AS project, 'r-proc' AS from_id, uid AS to_id, 'imports' AS edge_type FROM resolved WHERE uid IS NOT NULL
    UNION ALL SELECT project, svc, 'r-dao', 'calls' FROM p WHERE calls
    UNION ALL SELECT project, 'r-ep', 'r-rh', 'handles' FROM p WHERE handled
    UNION ALL SELECT project, 'r-ep', 'r-flt', 'filters' FROM p WHERE filtered AND c_nationkey >= 5
    UNION ALL SELECT project, 'r-rh', svc, 'depends_on' FROM p WHERE depends
    UNION ALL SELECT project, 'r-rh', 'r-proc', 'calls' FROM p WHERE operates AND NOT to_rh
    UNION ALL SELECT project, 'r-log', 'r-slog', 'references' FROM p WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT project, 'r-mod', 'r-comp', 'contains' FROM p WHERE shown AND c_mktsegment <> 'MACHINERY'
    UNION ALL SELECT project, 'r-mod', 'r-dl', 'loads' FROM p WHERE shown AND c_mktsegment <> 'MACHINERY'
    UNION ALL SELECT project, 'r-dl', 'r-ep', 'references' FROM p WHERE refers AND c_mktsegment <> 'MACHINERY'"""
