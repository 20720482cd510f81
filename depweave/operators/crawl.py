"""A budgeted crawl over the records' calls, level by level, and its bookkeeping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from depweave.operators.store import PENDING, external_records, internal, resolve_names
from depweave.session import cut

#: What a crawl can do with a record.
OUTCOMES = ("extracted", "skipped", "failed")


def running_before(rows: DataFrame, order: list[str], value: Column) -> DataFrame:
    """``rows`` (checkpointed) with ``before``: the sum of ``value`` over all rows in front of each one, in ``order`` (which tells rows apart).

    Rows are dealt by range; only the ranges' sums meet in one place.
    """
    dealt = cut(rows.withColumn("_v", value.cast("bigint")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum("_v").alias("_sum"))
    earlier = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    here = F.coalesce(F.sum("_v").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(earlier), "_range").withColumn("before", here + F.col("_earlier")).drop("_v", "_range", "_earlier")


def _outcomes(records: DataFrame, current: DataFrame | None, failing: DataFrame | None) -> DataFrame:
    """(uuid, outcome) of each internal record, should the crawl come to it: described ones of unchanged files are skipped."""
    rows = internal(records).select("uuid", "file_path", "src_hash", "do_description")
    skips = F.lit(False)
    if current is not None:
        rows = rows.join(current.select("file_path", F.col("src_hash").alias("now")), "file_path", "left")
        skips = ~F.col("do_description").isin(*PENDING) & F.coalesce(F.col("now") == F.col("src_hash"), F.lit(False))
    fails = F.lit(False)
    if failing is not None:
        rows = rows.join(failing.select("uuid").distinct().withColumn("bad", F.lit(True)), "uuid", "left")
        fails = F.coalesce("bad", F.lit(False))
    return rows.select("uuid", F.when(skips, "skipped").when(fails, "failed").otherwise("extracted").alias("outcome"))


def crawl(
    records: DataFrame, ins: DataFrame, entry_points: DataFrame, *, visited: DataFrame | None = None, max_functions: int | None = None,
    current: DataFrame | None = None, failing: DataFrame | None = None, sweep: bool = True,
) -> DataFrame:
    """(uuid, depth, parent, outcome): what a crawl from the ``entry_points`` (rank, function_name) comes to.

    Level 0 are the records of the entry points' names; the next level are the records that the
    extracted ones of a level call by name (with the input's file hint) and that no level had yet.
    A record's parent is the first one of the level before that calls it; a level's order is that
    of its parents and their inputs.  ``visited`` (uuid) are records of an earlier crawl, which are
    not come to again.  ``current`` (file_path, src_hash) makes it incremental: described records of
    unchanged files are skipped, and nothing is followed from them; nor from the ``failing`` (uuid).
    The crawl stops when ``max_functions`` have been extracted, inside a level in its order.  Then
    records still to be described that nothing led to are swept, by file, line and uuid (depth and
    parent are null), as long as the budget lasts.
    """
    fate = cut(_outcomes(records, current, failing))
    calls = ins.filter("source = 'internal_call'").select("record_uuid", "ordinal", F.col("source_function").alias("function_name"), F.col("source_file").alias("file_path"))
    links = cut(resolve_names(records, calls).filter("found_uuid is not null").groupBy("record_uuid", F.col("found_uuid").alias("next")).agg(F.min("ordinal").alias("ordinal")))
    seen = cut((visited if visited is not None else records.limit(0)).select("uuid").distinct())
    named = resolve_names(records, entry_points.select("rank", "function_name", F.lit(None).cast("string").alias("file_path"))).filter("found_uuid is not null")
    level = named.groupBy(F.col("found_uuid").alias("uuid")).agg(F.min(F.struct(F.lit(None).cast("string").alias("parent"), F.col("rank").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))).alias("first"))
    left, depth, found = max_functions, 0, None
    while left is None or left > 0:
        come = level.join(seen, "uuid", "left_anti").join(fate, "uuid").select("uuid", F.lit(depth).alias("depth"), "first.parent", "first.a", "first.b", "outcome")
        if left is None:
            come = cut(come)
        else:
            ranked = running_before(come, ["a", "b", "uuid"], F.col("outcome") == "extracted").filter(F.col("before") < left)
            come = cut(ranked)
            left -= come.filter("outcome = 'extracted'").count()
        if come.isEmpty():
            break
        found = come if found is None else found.unionByName(come, allowMissingColumns=True)
        seen = cut(seen.unionByName(come.select("uuid")))
        followed = come.filter("outcome = 'extracted'")
        if left is not None:
            # the place of each parent in its level, for the order of the next one
            followed = running_before(followed.drop("before"), ["a", "b", "uuid"], F.lit(1)).withColumn("place", F.col("before"))
        else:
            followed = followed.withColumn("place", F.lit(0).cast("bigint"))
        ahead = followed.select(F.col("uuid").alias("record_uuid"), "place").join(links, "record_uuid")
        level = ahead.groupBy(F.col("next").alias("uuid")).agg(F.min(F.struct("place", F.col("record_uuid").alias("parent"), F.col("ordinal").cast("bigint").alias("b"))).alias("m"))
        level = level.select("uuid", F.struct(F.col("m.parent").alias("parent"), F.col("m.place").alias("a"), F.col("m.b").alias("b")).alias("first"))
        depth += 1
    none = F.lit(None)
    out = records.select("uuid", none.cast("int").alias("depth"), none.cast("string").alias("parent"), none.cast("string").alias("outcome")).limit(0)
    if found is not None:
        out = out.unionByName(found.select("uuid", "depth", "parent", "outcome"))
    if sweep and (left is None or left > 0):
        open_ = internal(records).filter(F.col("do_description").isin(*PENDING)).select("uuid", "file_path", F.coalesce("line_number", F.lit(-1)).alias("line"))
        rest = open_.join(seen, "uuid", "left_anti").join(fate, "uuid")
        if left is not None:
            rest = running_before(rest, ["file_path", "line", "uuid"], F.col("outcome") == "extracted").filter(F.col("before") < left)
        out = out.unionByName(rest.select("uuid", none.cast("int").alias("depth"), none.cast("string").alias("parent"), "outcome"))
    return out


def crawl_counts(crawled: DataFrame, records: DataFrame, ins: DataFrame) -> DataFrame:
    """One row: extracted, failed and skipped records, and the new records of external calls that the extracted ones make."""
    made = ins.join(crawled.filter("outcome = 'extracted'").select(F.col("uuid").alias("record_uuid")), "record_uuid", "left_semi")
    return crawled.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("extracted", "failed", "skipped")]).crossJoin(external_records(made, records).agg(F.count(F.lit(1)).alias("ax_records")))


def record_run(disposition: DataFrame, path: str, run: dict, *, now: datetime | None = None) -> DataFrame:
    """Write ``disposition`` to ``path`` and return the run's row: what is known of it (``run``), its times, and counts taken while it is written.

    The counts are observed on the rows as they are written, so nothing is read twice.
    """
    began = now or datetime.now()
    kinds = ("created", "updated", "skipped", "failed", "adopted")
    seen = Observation()
    disposition.observe(seen, *[F.count_if(F.col("disposition") == k).alias(k) for k in kinds]).write.mode("overwrite").parquet(path)
    counts, spark = seen.get, disposition.sparkSession
    values = [F.lit(v).alias(k) for k, v in run.items()] + [F.lit(began).alias("started_at"), F.lit(now or datetime.now()).alias("completed_at")]
    return spark.range(1).select(*values, *[F.lit(counts[k]).cast("bigint").alias(f"records_{k}") for k in kinds])
