"""Tolerant reading of JSON answers: payloads in fences, and records with defaults (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an input can come from and an output can be; anything else counts as the first.
SOURCES = ("parameter", "state", "literal", "internal_call", "external")
KINDS = ("ok", "err", "side_effect", "mutation")
#: Fixed value: a fenced block, with or without the language's name.
FENCE = r"(?s)```(?:json)?\s*\n(.*?)\n\s*```"


def unfenced(answer: Column) -> Column:
    """What stands in the first fenced block of an answer, else the answer, without white space around it."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(answer.rlike(FENCE), trimmed(F.regexp_extract(answer, FENCE, 1))).otherwise(trimmed(answer))


def _member(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def parse_payloads(answers: DataFrame) -> DataFrame:
    """(id, payload, n_gwts, error) of answers (id, answer): ``payload`` is the JSON object (VARIANT) with a ``gwts`` member; else it is null and ``error`` says why."""
    read = answers.select("id", F.try_parse_json(unfenced(F.col("answer"))).alias("v"))
    shape = F.schema_of_variant("v")
    error = (
        F.when(F.col("v").isNull(), "not JSON").when(~shape.startswith("OBJECT"), "not an object")
        .when(F.try_variant_get("v", "$.gwts", "variant").isNull(), "no gwts")
    )
    return read.select("id", F.when(error.isNull(), F.col("v")).alias("payload"), F.size(_member(F.col("v"), "gwts", "array<variant>")).alias("n"), error.alias("error")).select(
        "id", "payload", F.when(F.col("n") >= 0, F.col("n")).cast("bigint").alias("n_gwts"), "error"
    )


def _known(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(allowed[0])


def parse_records(answers: DataFrame) -> DataFrame:
    """(id, ins, outs, do_description, do_steps, failure_modes, operational_claim, error) of answers (id, answer).

    Unknown sources count as parameters, unknown outputs as ok, types that are not named as ``Any``,
    texts that are missing as empty; lists that are missing or no lists as empty.  An answer that is
    no JSON object, or has an input without a name, has an ``error`` and nothing else.
    """
    v = F.col("v")
    read = answers.select("id", F.try_parse_json(unfenced(F.col("answer"))).alias("v"))
    text = lambda x, name, default: F.coalesce(_member(x, name, "string"), F.lit(default))
    items = lambda name, kind: F.coalesce(_member(v, name, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    ins = F.transform(_list(v, "ins"), lambda i: F.struct(
        _member(i, "name", "string").alias("name"), text(i, "type_str", "Any").alias("type_str"), _known(_member(i, "source", "string"), SOURCES).alias("source"),
        _member(i, "source_function", "string").alias("source_function"), _member(i, "source_file", "string").alias("source_file"), text(i, "description", "").alias("description"),
    ))
    outs = F.transform(_list(v, "outs"), lambda o: F.struct(
        _known(_member(o, "name", "string"), KINDS).alias("name"), text(o, "type_str", "Any").alias("type_str"), text(o, "description", "").alias("description"),
    ))
    typed = read.select(
        "id", "v", ins.alias("ins"), outs.alias("outs"), text(v, "do_description", "").alias("do_description"), items("do_steps", "string").alias("do_steps"),
        items("failure_modes", "string").alias("failure_modes"), text(v, "operational_claim", "").alias("operational_claim"),
    )
    error = (
        F.when(v.isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object")
        .when(F.exists("ins", lambda i: i["name"].isNull()), "an input without a name")
    )
    whole = error.isNull()
    columns = ["ins", "outs", "do_description", "do_steps", "failure_modes", "operational_claim"]
    return typed.select("id", *[F.when(whole, F.col(c)).alias(c) for c in columns], error.alias("error"))


def _list(v: Column, name: str) -> Column:
    """The items of a member that is a list; none otherwise."""
    return F.coalesce(_member(v, name, "array<variant>"), F.try_variant_get(F.try_parse_json(F.lit("[]")), "$", "array<variant>"))
