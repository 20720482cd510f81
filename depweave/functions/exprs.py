"""Column expressions of the engine: identities, slugs, type compatibility, verdicts (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of record identities (a fixed value).
RECORD_NAMESPACE = "f47ac10b58cc4372a5670e02b2c3d479"


def uuid5(name: Column, namespace_hex: str = RECORD_NAMESPACE) -> Column:
    """Name-based UUID, version 5: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def record_uuid(file_path: Column, class_name: Column, function_name: Column) -> Column:
    """Identity of a function record: path, class (empty if none) and function."""
    return uuid5(F.concat(file_path, F.lit("::"), F.coalesce(class_name, F.lit("")), F.lit("::"), function_name))


def is_uuid_shaped(x: Column) -> Column:
    """8-4-4-4-12 lower-case hexadecimal digits."""
    return x.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def slug(text: Column, most: int = 40) -> Column:
    """Lower case, runs of other characters to one underscore, trimmed, cut, trimmed at the end again."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(most)), "_+$", "")


def normal_type(t: Column) -> Column:
    """Trimmed, lower case; ``optional[x]`` (and whatever follows it) becomes ``x | none``."""
    s = F.lower(F.trim(t))
    return F.when(s.rlike(r"^optional\[.+\]"), F.concat(F.regexp_extract(s, r"^optional\[(.+)\]", 1), F.lit(" | none"))).otherwise(s)


def type_compatible(provided: Column, expected: Column, *, wide_unions: bool = False) -> Column:
    """Whether a provided type string serves where another is expected.

    Equal as given or normalized, either side ``any``, or a member of the expected union.  As the
    contract has it, a union never serves a wider union; ``wide_unions`` compares members instead.
    """
    p, e = normal_type(provided), normal_type(expected)
    members = F.transform(F.split(e, r"\|"), lambda x: F.trim(x))
    union = e.contains("|") & F.array_contains(members, p)
    if wide_unions:
        union = union | (e.contains("|") & F.forall(F.split(p, r"\|"), lambda x: F.array_contains(members, F.trim(x))))
    return (provided == expected) | (p == e) | (p == "any") | (e == "any") | union


def verdict(text: Column) -> Column:
    """fail, warning, pass or unknown by the first word found, in that order ("0 failures" is a fail)."""
    t = F.upper(text)
    return (
        F.when(t.contains("FAIL") | t.contains("CRITICAL"), "fail").when(t.contains("WARNING"), "warning")
        .when(t.contains("PASS"), "pass").otherwise("unknown")
    )


def elapsed(seconds: Column) -> Column:
    """5.2s below a minute, 1m04.5s below an hour, 1h02m above."""
    whole = F.floor(seconds).cast("bigint")
    minutes = F.floor(whole / 60)
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(minutes < 60, F.format_string("%dm%04.1fs", minutes, (seconds - minutes * 60).cast("double")))
        .otherwise(F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60))
    )


def cell_number(id_: Column, prefix: str) -> Column:
    """The number after ``prefix-`` (null for ids of another shape)."""
    return F.when(id_.rlike(f"^{prefix}-[0-9]+(-|$)"), F.split_part(id_, F.lit("-"), F.lit(2)).cast("bigint"))


def byte_size(n: Column) -> Column:
    """512.0B, 1.5KB, up to TB, in steps of 1024."""
    text = F.format_string("%.1fTB", n / F.lit(1024.0**4))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        text = F.when(n < 1024 ** (k + 1), F.format_string(f"%.1f{unit}", n / F.lit(1024.0**k))).otherwise(text)
    return text


def module_name(name: Column, id_: Column) -> Column:
    """Lower case, other characters than letters, digits and _ to _, its words capitalized and joined; without any, the id with _ for -."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), F.lit("_")), "_")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), "")
    return F.when(joined != "", joined).otherwise(F.translate(id_, "-", "_"))


def flat_trace(states: Column, invariant: Column) -> Column:
    """The variables of each state (structs with ``vars``); null without states or a violated invariant."""
    return F.when((F.size(states) > 0) & (invariant != ""), F.transform(states, lambda s: s["vars"]))


#: What a model checker's output says and how such a failure is called, the first that applies.
FAILURES = (
    ("Parsing or semantic analysis failed", "parse_error"), ("Attempted to apply the operator", "type_error"), (r"Invariant\s+\w+\s+is\s+violated", "invariant_violation"),
    ("Deadlock reached", "deadlock"), (r"Unknown operator:\s*", "constant_mismatch"),
)


def failure_class(output: Column, translated: Column) -> Column:
    """The kind of a failure by the checker's output; what was not even ``translated`` is a syntax error."""
    found = F.when(~translated, "syntax_error")
    for said, kind in FAILURES:
        found = found.when(output.rlike(said), kind)
    return found.otherwise("unknown")


def state_counts(output: Column) -> Column:
    """(found, distinct) states of the first line of an output that counts both; null without one."""
    counted = r"(\d+)\s+states\s+generated[^\n]*?(\d+)\s+distinct"
    number = lambda k: F.regexp_extract(output, counted, k).cast("bigint")
    return F.when(output.rlike(counted), F.struct(number(1).alias("found"), number(2).alias("distinct")))
