"""Contract checks over dependency edges: input and output types, and cross-cutting rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.exprs import type_compatible
from depweave.operators.store import deps, unresolved

#: Positions that a rule may state.
POSITIONS = ("pre", "post", "wrap")


def seam_edges(records: DataFrame, ins: DataFrame, outs: DataFrame) -> DataFrame:
    """One row per dependency edge and linked input: severity null where nothing is wrong.

    An input is linked if it is an internal call whose source is the edge's dependency; it is compared
    with the dependency's first ok output alone.  An edge counts once per dispatch and its candidates.
    """
    known = records.select("uuid", "function_name")
    edges = (
        deps(ins).join(known.select(F.col("uuid").alias("dependency_uuid"), F.col("function_name").alias("caller_function")), "dependency_uuid")
        .join(known.select(F.col("uuid").alias("dependent_uuid"), F.col("function_name").alias("callee_function")), "dependent_uuid")
    )
    linked = ins.filter((F.col("source") == "internal_call") & F.col("source_uuid").isNotNull()).select(
        F.col("record_uuid").alias("dependent_uuid"), F.col("source_uuid").alias("dependency_uuid"), F.col("name").alias("input_name"),
        F.col("type_str").alias("expected_type"), F.col("dispatch").alias("input_dispatch"),
    )
    first_ok = outs.filter("name = 'ok'").groupBy(F.col("record_uuid").alias("dependency_uuid")).agg(F.min_by("type_str", "ordinal").alias("provided_type"), F.count(F.lit(1)).alias("oks"))
    joined = edges.join(linked, ["dependent_uuid", "dependency_uuid"], "left").join(first_ok, "dependency_uuid", "left")
    severity = F.when(F.col("input_name").isNull(), None).when(F.col("oks").isNull(), "no_ok_output").when(
        ~type_compatible(F.col("provided_type"), F.col("expected_type")), "type_mismatch"
    )
    return joined.withColumn("severity", severity)


def seam_mismatches(records: DataFrame, ins: DataFrame, outs: DataFrame) -> DataFrame:
    return seam_edges(records, ins, outs).filter("severity is not null").select(
        F.col("dependency_uuid").alias("caller_uuid"), F.col("dependent_uuid").alias("callee_uuid"), "caller_function", "callee_function",
        "input_name", "expected_type", F.coalesce("provided_type", F.lit("")).alias("provided_type"), F.col("input_dispatch").alias("dispatch"), "severity",
    )


def seam_report(records: DataFrame, ins: DataFrame, outs: DataFrame) -> DataFrame:
    """One row: mismatches (per input), unresolved, satisfied (per edge) and their total."""
    per_edge = seam_edges(records, ins, outs).groupBy("dependent_uuid", "dependency_uuid", "dispatch", "dispatch_candidates").agg(F.count("severity").alias("bad"))
    edges = per_edge.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("mismatches"), F.count_if(F.col("bad") == 0).alias("satisfied"))
    open_ = unresolved(records, ins).agg(F.count(F.lit(1)).alias("unresolved"))
    return edges.crossJoin(open_).select("mismatches", "unresolved", "satisfied", (F.col("mismatches") + F.col("unresolved") + F.col("satisfied")).alias("total_edges"))


def matches_resource(resource_type: Column, *, use_contract: bool = False) -> Column:
    """Whether a dependency (is_external, file_path, boundary_contract) is of a rule's resource type.

    Stored records carry no boundary contract, so its branches are off by default.
    """
    path = F.lower("file_path")
    contract = F.lower(F.coalesce(F.col("boundary_contract"), F.lit(""))) if use_contract else F.lit("")
    return (
        F.when(resource_type == "external_api", F.col("is_external"))
        .when(resource_type == "database", contract.contains("db") | contract.contains("database") | path.contains("/db/") | path.contains("_store."))
        .when(resource_type == "message_queue", contract.contains("queue") | contract.contains("mq")).otherwise(F.lit(False))
    )


def check_rules(rules: list[dict]) -> list[dict]:
    """The rules, if all are whole: all or nothing."""
    for r in rules:
        missing = {"resource_type", "required_outs", "position"} - set(r)
        if missing:
            raise ValueError(f"a rule lacks {sorted(missing)}")
        if r["position"] not in POSITIONS:
            raise ValueError(f"unknown position {r['position']!r}")
    return rules


def _rule_edges(records: DataFrame, ins: DataFrame, outs: DataFrame, rules: DataFrame) -> DataFrame:
    """Edge x matching rule x required output, with whether the dependency has it.

    Rules are a hand-written list (a few rows by nature; checked by ``check_rules``), so they are broadcast.
    """
    known = records.select("uuid", "function_name", "is_external", "file_path")
    edges = deps(ins).join(known.select(F.col("uuid").alias("dependent_uuid"), F.col("function_name").alias("caller_function")), "dependent_uuid").join(
        known.withColumnRenamed("uuid", "dependency_uuid").withColumnRenamed("function_name", "callee_function"), "dependency_uuid"
    )
    tokens = outs.select(F.col("record_uuid").alias("dependency_uuid"), F.explode(F.array("type_str", "description")).alias("required")).distinct().withColumn("has", F.lit(True))
    numbered = rules.select("rule_no", "resource_type", F.explode("required_outs").alias("required"))
    return edges.join(F.broadcast(numbered), matches_resource(F.col("resource_type"))).join(tokens, ["dependency_uuid", "required"], "left")


def contract_violations(records: DataFrame, ins: DataFrame, outs: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per edge, matching rule and missing output (rules of equal type repeat it)."""
    return _rule_edges(records, ins, outs, rules).filter("has is null").select(
        F.col("resource_type").alias("rule_resource_type"), F.col("dependency_uuid").alias("callee_uuid"), "callee_function",
        F.col("required").alias("missing_contract"), F.col("dependent_uuid").alias("caller_uuid"), "caller_function",
    )


def contract_summary(records: DataFrame, ins: DataFrame, outs: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: violations, satisfied edges (some rule matched, nothing missing), total_checked."""
    per_edge = _rule_edges(records, ins, outs, rules).groupBy("dependent_uuid", "dependency_uuid", "dispatch", "dispatch_candidates").agg(F.count_if(F.col("has").isNull()).alias("bad"))
    sums = per_edge.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"), F.count_if(F.col("bad") == 0).alias("satisfied"))
    return sums.select("violations", "satisfied", (F.col("violations") + F.col("satisfied")).alias("total_checked"))


def seam_lines(mismatches: DataFrame, open_calls: DataFrame) -> DataFrame:
    """(section, text, json): a report's entries as one row each, since their number grows with the records; the counts are ``seam_report``'s."""
    c = F.col
    bad = F.concat(F.lit("  "), "caller_function", F.lit("() -> "), "callee_function", F.lit("()."), "input_name", F.lit("\n    provides: "), "provided_type", F.lit(", expects: "), "expected_type")
    lost = F.concat(F.lit("  "), "function_name", F.lit("()."), "input_name", F.lit(": "), "type_str")
    return mismatches.select(F.lit("mismatch").alias("section"), bad.alias("text"), F.to_json(F.struct(*[c(x) for x in mismatches.columns]), {"ignoreNullFields": "false"}).alias("json")).unionByName(
        open_calls.select(F.lit("unresolved").alias("section"), lost.alias("text"), F.to_json(F.struct(*[c(x) for x in open_calls.columns]), {"ignoreNullFields": "false"}).alias("json"))
    )


def violation_lines(violations: DataFrame) -> DataFrame:
    """(text, json) of each contract violation."""
    text = F.concat(F.lit("  "), "caller_function", F.lit("() -> "), "callee_function", F.lit("(): missing "), "missing_contract", F.lit(" (rule: "), "rule_resource_type", F.lit(")"))
    return violations.select(text.alias("text"), F.to_json(F.struct(*violations.columns), {"ignoreNullFields": "false"}).alias("json"))
