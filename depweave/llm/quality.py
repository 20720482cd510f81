"""Quality rules with risk-controlled thresholds.

Each rule is a ratio of a document; a document fails a rule above the rule's cutoff.
Cutoffs come from labelled holdouts: among a stratum's good documents, the rule at a
candidate cutoff rejects k of n.  It is certified when the exact binomial test of
"its false-rejection risk is above ``alpha``" is rejected at level ``delta`` divided by
all tests made (rules x cutoffs x strata: Bonferroni), that is when
P(Bin(n, alpha) <= k) is small enough.  The lowest certified cutoff of each rule is used;
a stratum without a certified cutoff keeps its documents.  With ``alpha`` shared out
among the rules, the false rejection of a stratum is at most ``max_risk`` in all, with
probability ``1 - delta``.

With ``ordered``, a rule's cutoffs are tested in a fixed order, from lax to strict, up to
the first that is not certified.  Only the first error counts then, so the level is
``delta`` divided by rules x strata.  Strata with too few good documents for any cutoff,
even if none is rejected, are tested as one pooled stratum; which ones depends on their
sizes alone, and the risk is bounded for the pool, not for each of them.

Everything is DataFrame functions.  Null text counts as empty, a null language as an
empty one; very long texts are read whole; repeated labels of a document count once, and as good only if all
say so; an empty table gives no rows, and without labels nothing is rejected beyond
the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import cut

#: The words of the contract: runs of anything but ASCII white space.
SPACE = r" \t\n\x0B\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rows of the cutoffs table up to which it is broadcast.
STRATA = 10_000

#: Rule name -> candidate cutoffs, from strict to lax.
CUTOFFS = {
    "symbols": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "dup_lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.6],
    "repeats": [0.1, 0.15, 0.2, 0.3, 0.4],
    "long_words": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
}


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _words(text: Column) -> Column:
    """Array of words; the text is trimmed first, so only an empty text yields an empty word."""
    trimmed = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more.

    Windows are compared by 64-bit hashes: sorted with their places, equal neighbours mark
    repeats; the cover is the sum of steps to the next marked place, three at most.
    """
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def marked(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(
            F.array(ordered),  # bound once: the lambda's argument is not evaluated again
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(s, lambda e, j: F.struct(e["i"].alias("i"), ((F.get(s, j - 1)["h"] == e["h"]) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))).alias("twice"))),
                        lambda e: e["twice"],
                    ),
                    lambda e: e["i"],
                )
            ),
        )[0]

    def cover(places: Column) -> Column:
        return F.aggregate(
            places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
            lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
        )["sum"]

    found = F.transform(
        F.array(windows),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(cover(marked(h))),
    )[0]
    return F.when(n < 3, F.lit(0).cast("bigint")).otherwise(found)


def base_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of each whole text."""
    text = _text()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    worded = docs.select(*keep, _words(text).alias("_words"), text.alias("_text"), lines.alias("_lines"))
    n = F.size("_words")
    return worded.select(
        *keep,
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^" + SYMBOLS + "]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        _repeat_words(F.col("_words"), n).alias("n_repeat_words"),
    )


def rule_values() -> dict[str, Column]:
    """The ratio that each rule compares with its cutoff (0 where there is nothing to divide by)."""
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {
        "symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"), "long_words": ratio("word_chars", "n_words"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact up to rounding: the term at k by summed logs, the rest by ratios downward."""
    top = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0), lambda a, i: a + F.log((n - k + i).cast("double")) - F.log(i.cast("double")),
    ) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    tail = F.aggregate(
        F.when(k > 0, F.reverse(F.sequence(F.lit(1).cast("bigint"), k))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] * i / (n - i + 1) * ((1.0 - p) / p)).alias("term"),
            (a["sum"] + a["term"] * i / (n - i + 1) * ((1.0 - p) / p)).alias("sum"),
        ),
    )["sum"]
    return F.when(k >= n, F.lit(0.0)).otherwise(top + F.log(tail))


def certified_cutoffs(
    good: DataFrame, stratum: str, values: dict[str, Column], cutoffs: dict[str, list[float]], *, max_risk: float = 0.02, delta: float = 0.05, ordered: bool = False,
) -> DataFrame:
    """stratum, rule, cutoff: the lowest certified cutoff of each rule and stratum (no row where none is).

    ``good`` holds the labelled good documents.  Aggregates to strata x cutoffs rows before any test.
    With ``ordered``, pooled strata have the cutoffs of their pool, and a row with a null stratum gives those for strata without labels.
    """
    alpha = max_risk / len(values)
    tests = len(values) if ordered else sum(map(len, cutoffs.values()))
    names = [f"k_{r}_{i}" for r in values for i in range(len(cutoffs[r]))]
    counts = good.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(values[r] > c).alias(f"k_{r}_{i}") for r in values for i, c in enumerate(cutoffs[r])],
    )
    strata = counts.agg((F.count(F.lit(1)) + (1 if ordered else 0)).alias("strata"))
    sized = counts.crossJoin(F.broadcast(strata))
    level = F.log(F.lit(delta) / (F.lit(float(tests)) * F.col("strata")))
    if ordered:
        sized = sized.withColumn("pooled", F.col("n") * F.log(F.lit(1.0 - alpha)) > level)
        pool = sized.filter("pooled").groupBy("strata").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        shared = pool.withColumn(stratum, F.lit(None).cast(good.schema[stratum].dataType))
        members = sized.filter("pooled").select(stratum).join(F.broadcast(pool))
        sized = sized.filter("not pooled").drop("pooled").unionByName(members).unionByName(shared)
    each = sized.select(
        stratum, "n", "strata",
        F.inline(F.array(*[
            F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{r}_{i}").cast("bigint").alias("k"))
            for r in values for i, c in enumerate(cutoffs[r])
        ])),
    )
    certified = (F.col("k") <= F.col("n") * alpha) & (log_binomial_cdf(F.col("k"), F.col("n"), alpha) <= level)
    if not ordered:
        return each.filter(certified).groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))
    judged = each.select(stratum, "rule", "cutoff", certified.alias("certified"))
    refused = F.coalesce(F.max(F.when(~F.col("certified"), F.col("cutoff"))), F.lit(float("-inf")))
    run = judged.groupBy(stratum, "rule").agg(refused.alias("refused"), F.collect_list(F.when(F.col("certified"), F.col("cutoff"))).alias("passed"))
    return run.select(stratum, "rule", F.array_min(F.filter("passed", lambda c: c > F.col("refused"))).alias("cutoff")).filter("cutoff is not null")


def apply_quality_rules(docs: DataFrame, labels: DataFrame, *, max_risk: float = 0.02, delta: float = 0.05, ordered: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (and the cutoffs used).

    Strata are languages.  The features are checkpointed once (a few numbers a document)
    since both the labelled holdout and the verdict read them.
    """
    stratum = F.coalesce(F.col("lang"), F.lit("")).alias("stratum")
    features = cut(base_features(docs.select("doc_id", "text", stratum), ("doc_id", "stratum")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = features.withColumn("base_failed", failed)
    values = rule_values()
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    holdout = scored.filter(~F.col("base_failed")).join(good.select("doc_id"), "doc_id", "left_semi")
    cutoffs = certified_cutoffs(holdout, "stratum", values, CUTOFFS, max_risk=max_risk, delta=delta, ordered=ordered)
    used = cut(cutoffs.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in values]
    ))
    if ordered:
        # languages without a labelled good document have the pool's cutoffs
        others = scored.select("stratum").distinct().join(holdout.select("stratum").distinct(), "stratum", "left_anti")
        used = cut(used.filter("stratum is not null").unionByName(others.crossJoin(F.broadcast(used.filter("stratum is null").drop("stratum")))))
    # few strata are no shuffle of all documents by a handful of keys; more than ``STRATA`` are joined plainly
    joined = scored.join(F.broadcast(used) if used.count() <= STRATA else used, "stratum", "left")
    over = F.lit(False)
    for r, v in values.items():
        over = over | F.coalesce(v > F.col(f"cutoff_{r}"), F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~over).alias("kept"), *[f"cutoff_{r}" for r in values],
    )
