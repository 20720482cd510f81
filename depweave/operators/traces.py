"""Logs of model-checker states: segmenting them into traces, and repeated states (lassos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.operators.crawl import running_before
from depweave.session import cut

#: How a log announces a state, a value, the way back and a violated invariant.
HEADER = r"^State\s+(\d+):\s*<(.+?)>"
VALUE = r"^/\\\s+(\w+)\s*=\s*(.+)"
BACK = r"^Back\s+to\s+state\s+(\d+)"
VIOLATED = r"Invariant\s+(\w+)\s+is\s+violated"


def states(lines: DataFrame) -> DataFrame:
    """(log_id, state, state_num, label, vars) of logs (log_id, line_no, text): ``state`` numbers all states of all logs in order of log and line.

    A state's lines follow its header; a way back ends it.  Of two values of one variable the last
    counts; lines before a log's first header belong to nothing.  Logs are dealt by ranges of lines,
    so a long log is spread over tasks.
    """
    said = lines.select("log_id", "line_no", F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("text"))
    head, back = F.col("text").rlike(HEADER), F.col("text").rlike(BACK)
    marked = running_before(said.withColumn("opens", (head | back).cast("int")), ["log_id", "line_no"], F.col("opens"))
    state = F.col("before") + F.col("opens")
    part = lambda pattern, k: F.regexp_extract("text", pattern, k)
    kept = cut(marked.filter((F.col("opens") == 1) | F.col("text").rlike(VALUE)).select("log_id", "line_no", "text", state.alias("state"), "opens", head.alias("head")))
    heads = kept.filter("head").select("log_id", "state", part(HEADER, 1).cast("bigint").alias("state_num"), part(HEADER, 2).alias("label"))
    values = kept.filter("opens = 0").groupBy("log_id", "state", part(VALUE, 1).alias("var")).agg(F.max_by(F.trim(part(VALUE, 2)), "line_no").alias("value"))
    held = values.groupBy("log_id", "state").agg(F.array_sort(F.collect_list(F.struct("var", "value"))).alias("vars"))
    return heads.join(held, ["log_id", "state"], "left").withColumn("vars", F.coalesce("vars", F.array()))


def traces(lines: DataFrame) -> DataFrame:
    """(log_id, trace_no, place, state_num, label, vars): each log's traces from 1, each trace's states from 1.

    A new trace begins at a state numbered 1 once the trace before has two states: of states
    numbered 1 that follow one another, every second one begins a trace.  Which one it is comes
    from counting, with islands of such states as groups, so no log is read in one task.
    """
    found = cut(states(lines).select("log_id", "state", "state_num", "label", "vars"))
    first = F.col("state_num") == 1
    counted = running_before(found.withColumn("other", (~first).cast("int")), ["log_id", "state"], F.col("other")).withColumnRenamed("before", "island")
    ranked = running_before(counted, ["log_id", "state"], F.lit(1)).withColumnRenamed("before", "rank")
    begins = ranked.groupBy("log_id").agg(F.min("rank").alias("log_rank"), F.min("island").alias("log_island"))
    islands = ranked.filter(first).groupBy("log_id", "island").agg(F.min("rank").alias("island_rank"))
    placed = ranked.join(begins, "log_id").join(islands, ["log_id", "island"], "left")
    in_log, in_island = F.col("rank") - F.col("log_rank"), F.col("rank") - F.col("island_rank")
    # a log's first trace has one state where an island follows a single other state
    late = (F.col("island_rank") - F.col("log_rank") == 1) & (F.col("island") - F.col("log_island") == 1)
    splits = first & (in_log > 0) & ((in_island + late.cast("int")) % 2 == 0)
    cuts = running_before(placed.select("log_id", "state", "state_num", "label", "vars", "rank", "log_rank", (splits | (in_log == 0)).cast("int").alias("cut")), ["log_id", "state"], F.col("cut"))
    traced = cut(cuts.withColumn("trace", F.col("before") + F.col("cut")).drop("before"))
    starts = traced.groupBy("log_id", "trace").agg(F.min("rank").alias("start"))
    bases = traced.groupBy("log_id").agg(F.min("trace").alias("base"))
    return traced.join(starts, ["log_id", "trace"]).join(bases, "log_id").select(
        "log_id", (F.col("trace") - F.col("base") + 1).alias("trace_no"), (F.col("rank") - F.col("start") + 1).alias("place"), "state_num", "label", "vars"
    )


def counterexamples(lines: DataFrame) -> DataFrame:
    """(log_id, violated_invariant, state_count, back_to): of each log the invariant named first, its states, and the state that its last way back leads to (null without one)."""
    named = F.regexp_extract("text", VIOLATED, 1)
    back = F.regexp_extract(F.trim("text"), BACK, 1)
    return lines.groupBy("log_id").agg(
        F.min_by(F.when(named != "", named), F.when(named != "", F.col("line_no"))).alias("violated_invariant"), F.count_if(F.trim("text").rlike(HEADER)).alias("state_count"),
        F.max_by(F.when(back != "", back).cast("bigint"), F.when(back != "", F.col("line_no"))).alias("back_to"),
    )


def lassos(flat: DataFrame) -> DataFrame:
    """(trace_id, loop_start, loop_end, loop_length) of flat traces (trace_id, state_num, var, value) that come back to a state.

    A state is the set of its variables and values, in no order.  The loop ends at the first state
    that equals an earlier one, and starts at the earliest equal one; traces without one have no row.
    """
    whole = flat.groupBy("trace_id", "state_num").agg(F.array_sort(F.collect_set(F.struct("var", F.coalesce("value", F.lit("\0")).alias("value")))).alias("state"))
    once = whole.groupBy("trace_id", "state").agg(F.min("state_num").alias("loop_start"))
    again = whole.join(once, ["trace_id", "state"]).filter("state_num > loop_start")
    return again.groupBy("trace_id").agg(F.min(F.struct(F.col("state_num").alias("loop_end"), "loop_start")).alias("m")).select(
        "trace_id", F.col("m.loop_start").alias("loop_start"), F.col("m.loop_end").alias("loop_end"), (F.col("m.loop_end") - F.col("m.loop_start")).alias("loop_length")
    )
