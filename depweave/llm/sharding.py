"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` places (stops) on a ring of ``RING`` slots.  A key
enters at the slot of its hash and walks clockwise; a stop whose shard is full
passes it on.  Keys queue in ring order, oldest first, so what each stop accepts
is one run of consecutive ring ranks and the whole outcome is a table of at most
``2 * shards * vnodes`` runs.  Only slot counts (at most ``RING`` rows, whatever
the input) decide that table; the rows then find their run by a join.

Edge cases: an empty table gives no rows; a null key takes the hash of its tie
columns; empty and very long texts are keys like others, as only their sizes and
checksums count; repeated rows are separate keys that share a slot; extra columns
pass through as one struct, so that no input name clashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.llm import shared

#: Slots of the ring: the bound of every broadcast below.
RING = 1 << 16


def ring_slot(key: Column) -> Column:
    """Slot of a key: the first 16 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int")


def _stops(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """stop (0.. in ring order), shard, place; ``shards * vnodes`` rows."""
    nodes = (
        spark.range(shards).withColumnRenamed("id", "shard")
        .join(spark.range(vnodes).withColumnRenamed("id", "copy"))
        .withColumn("place", ring_slot(F.concat_ws("/", F.lit("node"), "shard", "copy")))
    )
    order = Window.orderBy("place", "shard", "copy")
    return nodes.select(
        (F.row_number().over(order) - 1).alias("stop"), F.col("shard").cast("int").alias("shard"), "place"
    )


def _slots(spark: SparkSession, stops: DataFrame) -> DataFrame:
    """slot, stop: the first stop at or after each slot (the number of stops, past the last)."""
    marks = stops.groupBy(F.col("place").alias("slot")).agg(F.count(F.lit(1)).alias("here"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spark.range(RING).select(F.col("id").cast("int").alias("slot"))
        .join(marks, "slot", "left")
        .select("slot", F.coalesce(F.sum("here").over(before), F.lit(0)).cast("int").alias("stop"))
    )


def _runs(arrivals: DataFrame, stops: DataFrame, shards: int, slack: float) -> DataFrame:
    """Accepted runs of ring ranks: low, high (exclusive), shard, base (rank of ``low`` in its shard).

    One row in (the arrivals by stop as an array, bounded by the ring), folded clockwise
    over two laps: the first brings every key in, the second places what is still queued.
    """
    many = stops.select(F.max("stop")).first()[0] + 1
    by_stop = stops.join(arrivals, "stop", "left").select("stop", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    past = arrivals.filter(F.col("stop") >= many).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wrapped"))
    lap = by_stop.agg(F.array_sort(F.collect_list(F.struct("stop", "shard", "n"))).alias("lap"))
    one = lap.crossJoin(past).select("lap", "wrapped", (F.aggregate("lap", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]) + F.col("wrapped")).alias("total"))
    # capacities: floor or ceiling of (1 + slack) * total / shards, whose sum is never below the total
    room = F.ceil(F.col("total") * F.lit(1.0 + slack)).cast("bigint")
    caps = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.floor(room / shards).cast("bigint") + F.when(i < room % shards, 1).otherwise(0).cast("bigint"),
    )
    second = F.transform(
        "lap",
        lambda x: F.struct(
            x["stop"].alias("stop"), x["shard"].alias("shard"),
            F.when(x["stop"] == 0, F.col("wrapped")).otherwise(F.lit(0)).cast("bigint").alias("n"),
        ),
    )
    run_type = "array<struct<low:bigint,high:bigint,shard:int,base:bigint>>"
    start = F.struct(
        F.lit(0).cast("bigint").alias("head"), F.lit(0).cast("bigint").alias("tail"),
        F.col("left").alias("left"), F.array().cast(run_type).alias("runs"),
    )

    def accept(state: Column, x: Column) -> Column:
        tail = state["tail"] + x["n"]
        free = F.element_at(state["left"], x["shard"] + 1)
        taken = F.least(tail - state["head"], free)
        run = F.struct(
            state["head"].alias("low"), (state["head"] + taken).alias("high"),
            x["shard"].alias("shard"), (F.element_at(F.col("caps"), x["shard"] + 1) - free).alias("base"),
        )
        return F.struct(
            (state["head"] + taken).alias("head"), tail.alias("tail"),
            F.transform(state["left"], lambda v, i: F.when(i == x["shard"], v - taken).otherwise(v)).alias("left"),
            F.when(taken > 0, F.concat(state["runs"], F.array(run))).otherwise(state["runs"]).alias("runs"),
        )

    folded = (
        one.withColumn("caps", caps).withColumn("left", F.col("caps"))
        .select(F.aggregate(F.concat("lap", second.cast("array<struct<stop:int,shard:int,n:bigint>>")), start, accept)["runs"].alias("runs"))
    )
    return folded.select(F.inline("runs"))


def bounded_ring(
    df: DataFrame, key: str, shards: int, *, vnodes: int = 64, slack: float = 0.0, ties: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``shard`` (0..shards-1) and ``slot`` (gapless rank in the shard, from 0); where ``df`` has columns of these names, in any case, the new ones have underscores in front.

    A shard takes at most floor or ceiling of ``(1 + slack) * rows / shards`` rows; with
    ``slack=0`` the counts are at most one apart.  ``ties`` order rows of one slot after
    the key's hash (rows equal in all of them are interchangeable).
    """
    spark = df.sparkSession
    backup = F.concat_ws("/", F.lit("null"), *[F.col(f"`{t}`").cast("string") for t in ties])
    whole = F.coalesce(F.col(f"`{key}`").cast("string"), backup)
    columns, added = tuple(df.columns), shared.free(df.columns, "shard", "slot")
    order_by = [F.md5(whole.cast("binary")), F.col(f"`{key}`"), *[F.col(f"`{t}`") for t in ties]]
    rows = df.select(shared.packed(columns).alias("_ring_row"), ring_slot(whole).alias("_ring_slot"), *[c.alias(f"_ring_by{k}") for k, c in enumerate(order_by)])
    stops = _stops(spark, shards, vnodes)
    slots = _slots(spark, stops)
    counts = (
        rows.groupBy("_ring_slot").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_ring_slot").alias("slot"), "n").join(F.broadcast(slots), "slot")
    )
    arrivals = counts.groupBy("stop").agg(F.sum("n").alias("n"))
    runs = _runs(arrivals, stops, shards, slack)
    # ring rank at which each arc and each slot begins
    upto = Window.orderBy("stop").rowsBetween(Window.unboundedPreceding, -1)
    arcs = arrivals.select("stop", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("begins"))
    within = Window.partitionBy("stop").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        counts.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(F.broadcast(arcs.select("stop", "begins")), "stop")
        .select(F.col("slot").alias("_ring_slot"), F.col("stop").alias("_ring_stop"), (F.col("begins") + F.col("ahead")).alias("_ring_begin"))
    )
    pieces = (
        F.broadcast(arcs).join(runs, (F.col("low") < F.col("begins") + F.col("n")) & (F.col("high") > F.col("begins")))
        .select(
            F.col("stop").alias("_ring_stop"), F.col("low").alias("_ring_low"), F.col("high").alias("_ring_high"),
            F.col("shard").alias("_ring_shard"), F.col("base").alias("_ring_base"),
        )
    )
    order = Window.partitionBy("_ring_slot").orderBy(*[f"_ring_by{k}" for k in range(len(order_by))])
    placed = (
        rows.join(F.broadcast(begins), "_ring_slot")
        .withColumn("_ring_rank", F.col("_ring_begin") + F.row_number().over(order) - 1)
        .join(
            F.broadcast(pieces.withColumnRenamed("_ring_stop", "_ring_at")),
            (F.col("_ring_stop") == F.col("_ring_at")) & (F.col("_ring_rank") >= F.col("_ring_low")) & (F.col("_ring_rank") < F.col("_ring_high")),
        )
    )
    return placed.select(
        *shared.unpacked("_ring_row", columns), F.col("_ring_shard").alias(added[0]), (F.col("_ring_base") + F.col("_ring_rank") - F.col("_ring_low")).alias(added[1])
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The ``rows`` law over documents: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    Null text counts as empty: size 8, checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return bounded_ring(rows, "doc_id", shards, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
