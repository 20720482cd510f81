"""Edges out of schema documents, by one table of rules.

Documents are rows (project, schema, body): the body is JSON.  Registries are rows (project,
body): what a project's resources are.  A rule says at which path of which schema something
must stand, and which resource types an edge then links; documents are walked down the
rules' paths level by level as VARIANT values, so no rule has code of its own and nothing
that no rule asks for is unpacked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.operators.strong import Ordered

#: Schema files by their short names, import categories that count.
SCHEMAS = {"backend": "backend_schema.json", "frontend": "frontend_schema.json", "middleware": "middleware_schema.json", "shared": "shared_objects_schema.json"}
CATEGORIES = ("internal", "shared", "backend")
#: Schema, path (``*`` any member of an object, ``[]`` any item of an array), text that the value must hold, edge type, target type
#: (``section``, ``schema:section``, or ``path``: the value is a path to be resolved).  Edges leave the type of the path's first step.
RULES = [
    *[("backend", f"processors.*.imports.{c}.[].path", None, "imports", "path") for c in CATEGORIES],
    ("backend", "services.*.functions.*.calls.[]", None, "calls", "data_access_objects"),
    ("backend", "endpoints.*.handler", None, "handles", "request_handlers"),
    ("backend", "endpoints.*.filters.[]", None, "filters", "filters"),
    ("backend", "request_handlers.*.dependencies.[]", None, "depends_on", "services"),
    ("backend", "request_handlers.*.functions.*.operation", None, "calls", "processors"),
    ("backend", "process_chains.*.steps.[]", None, "chains", "processors"),
    ("backend", "data_structures.*.relations.*", None, "relates_to", "data_structures"),
    ("backend", "verifiers.*.applies_to.[]", None, "validates", "data_structures"),
    ("backend", "logging.format", "shared/logging", "references", "shared:logging"),
    *[("frontend", f"modules.*.imports.{c}.[].path", None, "imports", "path") for c in CATEGORIES],
    ("frontend", "modules.*.components.[]", None, "contains", "components"),
    ("frontend", "modules.*.navigation.*.data_loaders.[]", None, "loads", "data_loaders"),
    ("frontend", "modules.*.navigation.*.access_controls.[]", None, "guards", "access_controls"),
    ("frontend", "data_loaders.*.api_reference", "backend/endpoints", "references", "backend:endpoints"),
    ("frontend", "api_contracts.*.reference", "backend/endpoints", "references", "backend:endpoints"),
    ("frontend", "verifiers.*.rules.*.applies_to.[]", None, "validates", "components"),
    ("frontend", "verifiers.*.rules.*.applies_to.[]", None, "validates", "utility_modules"),
    ("frontend", "logging.format", "shared/logging", "references", "shared:logging"),
    ("middleware", "interceptors.*.base_interface", "shared/interceptor_interfaces", "implements_interface", "shared:interceptor_interfaces"),
    *[("middleware", f"interceptors.*.imports.{c}.[].path", None, "imports", "path") for c in CATEGORIES],
    ("middleware", "process_chains.*.interceptors.[]", None, "chains", "interceptors"),
    ("shared", "transformers.*.input_type", None, "transforms_from", "data_types"),
    ("shared", "transformers.*.output_type", None, "transforms_to", "data_types"),
    ("shared", "verifiers.*.rules.*.applies_to.[]", None, "validates", "common_structures"),
]


def rule_rows(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    """(rule_no, schema, path, holds, edge_type, from_section, to_schema, to_section) of the rules: a hand-written table."""
    rows = []
    for k, (schema, path, holds, edge_type, target) in enumerate(rules):
        to_schema, _, section = target.rpartition(":")
        values = {
            "rule_no": k, "schema": SCHEMAS[schema], "path": path, "holds": holds, "edge_type": edge_type, "from_section": path.split(".")[0],
            "to_schema": None if target == "path" else SCHEMAS[to_schema or schema], "to_section": None if target == "path" else section,
        }
        rows.append(F.struct(*[F.lit(v).cast("int" if c == "rule_no" else "string").alias(c) for c, v in values.items()]))
    return spark.range(1).select(F.inline(F.array(*rows)))


def resources(registries: DataFrame) -> DataFrame:
    """(project, id, kind, name, description, schema, path, source_schema, source_key, place): all resources, then the conditional ones, each section in its order."""
    one = "map<string, struct<kind: string, name: string, description: string, schema: string, path: string, source_schema: string, source_key: string>>"
    body = F.from_json("body", f"resources {one}, conditional_resources {one}")
    rows = None
    for k, section in enumerate(("resources", "conditional_resources")):
        part = registries.select("project", body.alias("b")).select("project", F.posexplode(F.col("b")[section]).alias("at", "id", "r"))
        part = part.select("project", "id", F.coalesce("r.kind", F.lit("resource")).alias("kind"), F.coalesce("r.name", F.lit("")).alias("name"), *[F.col(f"r.{c}") for c in ("description", "schema", "path", "source_schema", "source_key")], F.array(F.lit(k), "at").alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def type_map(found: DataFrame) -> DataFrame:
    """(project, source_schema, section, uid): the last resource of each schema file and section."""
    section = F.substring_index("source_key", ".", 1)
    return found.filter("source_schema <> '' and source_key <> ''").groupBy("project", "source_schema", section.alias("section")).agg(F.max_by("id", "place").alias("uid"))


def path_map(found: DataFrame) -> DataFrame:
    """(project, prefix, uid): the last resource below each two leading path segments."""
    prefix = F.substring_index("path", "/", 2)
    return found.filter(F.col("path").contains("/")).groupBy("project", prefix.alias("prefix")).agg(F.max_by("id", "place").alias("uid"))


def _of_longest(prefixes: Column, path: Column) -> Column:
    """The uid of the first of ``prefixes`` (prefix, uid; longest first) that begins the path."""
    return F.get(F.filter(prefixes, lambda x: path.startswith(x["prefix"])), F.lit(0))["uid"]


def resolve_paths(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``paths`` (project, path, distinct) with ``uid``: that of the longest prefix, in characters, that begins the path; null without one.

    A path meets the prefixes of its own project as one row, longest first, so no path becomes several rows.
    """
    entry = F.struct((-F.length("prefix")).alias("n"), "prefix", "uid")
    lists = prefixes.filter("prefix <> ''").groupBy("project").agg(F.array_sort(F.collect_list(entry)).alias("_prefixes"))
    return paths.join(lists, "project", "left").select("project", "path", _of_longest(F.col("_prefixes"), F.col("path")).alias("uid"))


def _steps(path: str) -> list[str]:
    return path.split(".")


def _step_rows(spark: SparkSession, rules: list[tuple]) -> list[DataFrame]:
    """Per level, (schema, prefix, step, ahead, ends): the steps that some rule's path takes from a prefix, once for a path that ends there and once for those that go on."""
    levels: dict[int, set[tuple[str, str, str, str, bool]]] = {}
    for schema, path, *_ in rules:
        steps = _steps(path)
        for k, s in enumerate(steps):
            levels.setdefault(k, set()).add((SCHEMAS[schema], ".".join(steps[:k]), s, ".".join(steps[: k + 1]), k + 1 == len(steps)))
    out = []
    for k in sorted(levels):
        rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("schema", "prefix", "step", "ahead", "ends"), row)]) for row in sorted(levels[k])]
        out.append(spark.range(1).select(F.inline(F.array(*rows))))
    return out


def flattened(documents: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(project, schema, path, keys, text, shape): what stands at the rules' paths; keys are the members and items passed on the way, text is the value as a string ('' if it has none), shape its schema.

    A body that is no JSON has nothing at any path.  The step tables are as small as the rules, so they are broadcast;
    what has come to its path's end is taken along, so a document is walked in one pass and no level is stored.
    """
    spark = documents.sparkSession
    none = F.lit(None).cast("string")
    at = documents.select(
        "project", "schema", F.lit("").alias("prefix"), F.array().cast("array<string>").alias("keys"), F.try_parse_json("body").alias("value"), F.lit(False).alias("done"), none.alias("text"), none.alias("shape")
    )
    for steps in _step_rows(spark, rules):
        inner = spark.sql(
            "SELECT d.project, d.schema, d.prefix, d.keys, d.done, d.text, d.shape, c.pos, c.key, c.value FROM {at} d, LATERAL variant_explode_outer(CASE WHEN NOT d.done THEN d.value END) c", at=at
        ).alias("i")
        stands = F.when(F.col("i.key").isNull(), F.col("s.step") == "[]").otherwise(F.col("s.step").isin("*") | (F.col("s.step") == F.col("i.key")))
        here = ~F.col("i.done") & F.col("i.pos").isNotNull() & stands & (F.col("i.schema") == F.col("s.schema")) & (F.col("i.prefix") == F.col("s.prefix"))
        one = inner.join(F.broadcast(steps.alias("s")), here, "left").filter("i.done or s.step is not null")
        key = F.coalesce("i.key", F.lpad(F.col("i.pos").cast("string"), 9, "0"))
        at = one.select(
            "i.project", "i.schema", F.coalesce("s.ahead", "i.prefix").alias("prefix"), F.when(F.col("i.done"), F.col("i.keys")).otherwise(F.concat("i.keys", F.array(key))).alias("keys"),
            F.when(~F.coalesce("s.ends", F.lit(True)), F.col("i.value")).alias("value"), F.coalesce("s.ends", F.lit(True)).alias("done"),
            F.when(F.col("s.ends"), _text(F.col("i.value"))).otherwise(F.col("i.text")).alias("text"), F.when(F.col("s.ends"), F.schema_of_variant("i.value")).otherwise(F.col("i.shape")).alias("shape"),
        )
    return at.filter("done").select("project", "schema", F.col("prefix").alias("path"), "keys", "text", "shape")


def _text(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))


def _lists(found: DataFrame) -> DataFrame:
    """(project, types, prefixes): a project's resources in one row: types (source_schema, section, uid), the last one first, and prefixes (prefix, uid), the longest first, of equal ones the last."""
    section = F.when((F.col("source_schema") != "") & (F.col("source_key") != ""), F.substring_index("source_key", ".", 1))
    prefix = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 2))
    rows = found.select("project", F.struct(F.transform("place", lambda x: -x).alias("place"), "source_schema", section.alias("section"), prefix.alias("prefix"), F.col("id").alias("uid")).alias("r"))
    every = F.array_sort("every")
    types = F.transform(F.filter(every, lambda r: r["section"].isNotNull()), lambda r: F.struct(r["source_schema"].alias("source_schema"), r["section"].alias("section"), r["uid"].alias("uid")))
    prefixes = F.transform(F.filter(every, lambda r: r["prefix"].isNotNull()), lambda r: F.struct((-F.length(r["prefix"])).alias("n"), r["place"].alias("place"), r["prefix"].alias("prefix"), r["uid"].alias("uid")))
    return rows.groupBy("project").agg(F.collect_list("r").alias("every")).select("project", types.alias("types"), F.array_sort(prefixes).alias("prefixes"))


def proposed_edges(documents: DataFrame, found: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(project, from_id, to_id, edge_type, rule_no, keys): each edge that a rule asks for, once, at its first place (rules in order, members by name)."""
    table = F.broadcast(rule_rows(documents.sparkSession, rules))
    met = flattened(documents, rules).join(table, ["schema", "path"]).filter("holds is null or contains(text, holds)")
    # a member that must be an object, as it is named and not listed
    met = met.filter(~F.col("path").endswith("relations.*") | F.col("shape").startswith("OBJECT"))
    # what one rule finds in a project is one edge, but for paths, which lead to several
    asked = F.when(F.col("to_section").isNull(), F.col("text"))
    firsts = met.groupBy("project", "rule_no", asked.alias("asked")).agg(F.min("keys").alias("keys"))
    of_type = lambda schema, section: F.get(F.filter("types", lambda t: (t["source_schema"] == F.col(schema)) & (t["section"] == F.col(section))), F.lit(0))["uid"]
    to_id = F.when(F.col("to_section").isNull(), _of_longest(F.col("prefixes"), F.col("asked"))).otherwise(of_type("to_schema", "to_section"))
    ends = firsts.join(_lists(found), "project").join(table, "rule_no").select("project", of_type("schema", "from_section").alias("from_id"), to_id.alias("to_id"), "edge_type", "rule_no", "keys")
    every = ends.filter("from_id is not null and to_id is not null")
    return every.groupBy("project", "from_id", "to_id", "edge_type").agg(F.min(F.struct("rule_no", "keys")).alias("first")).select("project", "from_id", "to_id", "edge_type", "first.*")


def _accepted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges, in the order of their projects, without those that close a cycle with the accepted ones before of the same project."""
    project = graph = None
    for pdf in batches:
        kept = []
        for p, a, b in zip(pdf["project"], pdf["from_id"], pdf["to_id"]):
            if graph is None or p != project:
                project, graph = p, Ordered()
            kept.append(graph.add(a, b))
        yield pdf[pd.Series(kept, index=pdf.index, dtype=bool)]


def extract_edges(documents: DataFrame, registries: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(project, from_id, to_id, edge_type): the proposed edges that are accepted in their order; ends that are no resource, self-loops and edges that close a cycle are passed over.

    No edge leaves its project, and a project has no more than its rules and its registry's row name, so each project is taken in order by itself.
    """
    rows = proposed_edges(documents, resources(registries), rules)
    ordered = rows.repartition("project").sortWithinPartitions("project", "rule_no", "keys", "from_id", "to_id", "edge_type")
    return ordered.select("project", "from_id", "to_id", "edge_type").mapInPandas(_accepted, "project string, from_id string, to_id string, edge_type string")
