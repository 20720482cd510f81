"""Status and verdict roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.exprs import elapsed, verdict


def item_status(items: DataFrame, results: DataFrame, attempts: DataFrame, bridged: DataFrame) -> DataFrame:
    """Per item (gwt_id): the result if there is one (``fail`` where it says nothing), else in_progress with attempts, else pending."""
    tried = attempts.groupBy("gwt_id").agg(F.count(F.lit(1)).alias("tried"))
    done = results.select("gwt_id", F.coalesce("result", F.lit("fail")).alias("result"), F.col("attempts").alias("made"), F.lit(True).alias("has_result"))
    crossed = bridged.select("gwt_id").distinct().withColumn("bridge", F.lit(True))
    joined = items.join(done, "gwt_id", "left").join(tried, "gwt_id", "left").join(crossed, "gwt_id", "left")
    return joined.select(
        "gwt_id", F.when(F.col("has_result"), F.col("result")).when(F.col("tried") > 0, "in_progress").otherwise("pending").alias("status"),
        F.coalesce(F.when(F.col("has_result"), F.col("made")).otherwise(F.col("tried")), F.lit(0)).cast("bigint").alias("attempts"), F.coalesce("bridge", F.lit(False)).alias("bridged"),
    )


def roll_up(status: DataFrame) -> DataFrame:
    """Counts of verified, failed, in_progress and pending (anything else) items, bridged ones and the total."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return status.agg(
        is_("pass").alias("verified"), is_("fail").alias("failed"), is_("in_progress").alias("in_progress"),
        F.count_if(~F.col("status").isin("pass", "fail", "in_progress")).alias("pending"), F.count_if("bridged").alias("bridge_complete"), F.count(F.lit(1)).alias("total"),
    )


def parse_progress(files: DataFrame) -> DataFrame:
    """(gwt_id, attempt, max_attempts, phase, detail, pid, updated_at) of progress files (name, text); what is no JSON object is passed over, what is missing has a default."""
    v = files.select("name", F.try_parse_json("text").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda key, kind, default: F.coalesce(F.try_variant_get("v", f"$.{key}", kind), default if hasattr(default, "alias") else F.lit(default)).alias(key)
    return v.select(
        get("gwt_id", "string", F.regexp_replace("name", "_progress", "")), get("attempt", "bigint", 0), get("max_attempts", "bigint", 0), get("phase", "string", "unknown"),
        get("detail", "string", ""), get("pid", "bigint", 0), get("updated_at", "double", 0.0),
    )


def live_progress(progress: DataFrame, results: DataFrame, alive: DataFrame, now) -> DataFrame:
    """(gwt_id, attempt, phase, elapsed_seconds, state) of parsed progress: done if a result exists, running if its process (pid) is ``alive``, else stale.

    Seconds since the last update are cut to whole ones, 0 where it never came.
    """
    done = results.select("gwt_id").distinct().withColumn("done", F.lit(True))
    there = alive.select("pid").distinct().withColumn("there", F.lit(True))
    age = F.when(F.col("updated_at") != 0, (now - F.col("updated_at")).cast("bigint")).otherwise(0)
    return progress.join(done, "gwt_id", "left").join(there, "pid", "left").select(
        "gwt_id", F.concat(F.col("attempt").cast("string"), F.lit("/"), F.col("max_attempts").cast("string")).alias("attempt"), "phase", age.alias("elapsed_seconds"),
        F.when(F.col("done"), "done").when(F.col("there"), "running").otherwise("stale").alias("state"),
    )


def progress_counts(live: DataFrame) -> DataFrame:
    """One row: running, done and stale entries."""
    return live.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("running", "done", "stale")])


def verdicts(reviews: DataFrame) -> DataFrame:
    """One row per group: fail if a text says so, else warning, else pass (texts that say nothing change nothing), and whether it blocks."""
    graded = reviews.select("group", verdict(F.col("text")).alias("v"))
    fails, warns = F.max(F.col("v") == "fail"), F.max(F.col("v") == "warning")
    overall = F.when(fails, "fail").when(warns, "warning").otherwise("pass")
    return graded.groupBy("group").agg(overall.alias("verdict"), F.count(F.lit(1)).alias("reviews")).withColumn("exit_code", F.when(F.col("verdict") == "fail", 1).otherwise(0))


def ingest_disposition(skeletons: DataFrame, records: DataFrame, *, incremental: bool = True) -> DataFrame:
    """(uuid, disposition, donor): skipped (same hash), updated (the record exists), adopted (a described record of equal content elsewhere) or created.

    The donor is what an updated or adopted record takes its description from, null without one.
    Every skeleton is judged by the records as they were; the second of two with one donor takes
    what the first one took over.  Without ``incremental`` nothing is skipped.
    """
    from depweave.operators.store import content_donor

    have = records.select("uuid", F.col("src_hash").alias("old_hash"), F.lit(True).alias("had"))
    seen = content_donor(records, skeletons).join(have, "uuid", "left")
    same = F.lit(incremental) & F.coalesce(F.col("old_hash") == F.col("src_hash"), F.lit(False))
    donor = F.when(~same & (F.col("donor") != F.col("uuid")), F.col("donor"))
    return seen.select("uuid", F.when(same, "skipped").when(F.col("had"), "updated").when(donor.isNotNull(), "adopted").otherwise("created").alias("disposition"), donor.alias("donor"))


def ingest_counts(disposition: DataFrame) -> DataFrame:
    """One row: created, updated, skipped, failed and adopted of ``disposition``."""
    return disposition.agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("created", "updated", "skipped", "failed", "adopted")])


def crawl_summary(done: DataFrame) -> DataFrame:
    """One row over (outcome, seconds): extracted, failed, skipped, ax, retries, elapsed text and seconds for each extracted function (null if none)."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    sums = done.agg(*[is_(o).alias(o) for o in ("extracted", "failed", "skipped", "ax", "retries")], F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"))
    return sums.select("extracted", "failed", "skipped", "ax", "retries", elapsed(F.col("seconds")).alias("elapsed"), F.when(F.col("extracted") > 0, F.col("seconds") / F.col("extracted")).alias("average"))
