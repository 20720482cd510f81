"""Text operators: mentions, directory prefixes, traces (built-in functions only) and JSON objects in prose (Arrow batches)."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File endings that count as source paths (fixed values).
ENDINGS = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "rb")


def mentions(text: Column) -> Column:
    """Functions ``name()``, source files and directory paths that a text mentions, each once, in order.

    White space and quotes part the words.  A path is a word's head of letters, digits and ``._-/``,
    up to a dot or the head's end; a mark ``,;:)`` or nothing must follow that.  A source file is the
    longest such path that ends like one, a directory the longest one with a slash after a named
    segment, unless it ends like a source file.
    """
    called = F.split(text, r"\(\)")
    functions = F.transform(F.slice(called, 1, F.size(called) - 1), lambda x: F.regexp_extract(x, r"(?U)(\w+)$", 1))
    heads = F.transform(F.split(text, r"(?U)[\s\"'`]+"), lambda w: F.struct(F.regexp_extract(w, r"(?U)^[\w./-]+", 0).alias("head"), w.alias("word")))

    def paths(x: Column) -> Column:
        """The paths that a word can stand for, the longest first."""
        head, rest = x["head"], F.substring(x["word"], F.length(x["head"]) + 1, F.lit(1))
        parts = F.split(head, r"\.")
        upto = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("path")))
        return F.transform(F.filter(upto, lambda u: (u["n"] < F.size(parts)) | rest.isin("", ",", ";", ":", ")")), lambda u: u["path"])

    name = lambda p: F.substring_index(p, "/", -1)
    source = lambda p: (F.instr(name(p), ".") > 0) & F.substring_index(p, ".", -1).isin(*ENDINGS)
    segments = lambda p: F.split(F.when(p.startswith("/"), F.substring(p, 2, 1 << 30)).otherwise(p), "/")
    named = lambda p, last: F.forall(F.slice(segments(p), 1, F.size(segments(p)) - (0 if last else 1)), lambda g: g != "")
    is_file = lambda p: source(p) & named(p, True) & (F.length(name(p)) > F.length(F.substring_index(p, ".", -1)) + 1)
    is_folder = lambda p: (F.size(segments(p)) > 1) & named(p, False)
    longest = lambda test: F.filter(F.transform(heads, lambda x: F.get(F.filter(paths(x), test), 0)), lambda p: p.isNotNull())
    return F.struct(
        F.array_distinct(F.filter(functions, lambda f: f != "")).alias("functions"), F.array_distinct(longest(is_file)).alias("files"),
        F.array_distinct(F.filter(longest(is_folder), lambda p: ~source(p))).alias("directories"),
    )


def directories(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(directory, files): every directory above some file, with the number of distinct files below it."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return files.select(path).distinct().select(F.explode(above).alias("directory")).groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


def collapse_directories(found: DataFrame) -> DataFrame:
    """(directory): those that no shorter one of ``found`` (directory) covers; an ancestor is a join key, so no pairwise comparison."""
    parts = F.split("directory", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    ones = found.select("directory").distinct()
    covered = ones.select("directory", F.explode(above).alias("up")).join(ones.select(F.col("directory").alias("up")), "up", "left_semi").select("directory").distinct()
    return ones.join(covered, "directory", "left_anti")


def trace_diff(states: DataFrame) -> DataFrame:
    """Flat traces (trace_id, state_num, label, var, value): the values that differ from the state before (the first state whole)."""
    before = F.lag("value").over(Window.partitionBy("trace_id", "var").orderBy("state_num"))
    return states.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("value"))).select("trace_id", "state_num", "label", "var", "before", "value")


def trace_summary(states: DataFrame) -> DataFrame:
    """(trace_id, step_count, first_label, last_label, actions): actions are the labels after the first state."""
    one = states.select("trace_id", "state_num", "label").distinct().groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("state_num", "label"))).alias("s"))
    return one.select(
        "trace_id", F.size("s").cast("bigint").alias("step_count"), F.element_at("s", 1)["label"].alias("first_label"), F.element_at("s", -1)["label"].alias("last_label"),
        F.array_join(F.transform(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x: x["label"]), ",").alias("actions"),
    )


_MARKS = re.compile(r'["{}\\]')


def _object_in(text: str | None) -> str | None:
    begin = at = (text or "").find("{")
    depth, quoted = 0, False
    while at >= 0 and (mark := _MARKS.search(text, at)):
        at = mark.end()
        if mark[0] == "\\":
            at += quoted  # in a string the next character is no mark
        elif mark[0] == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif mark[0] == "{":
            begin, depth = (mark.start() if depth == 0 else begin), depth + 1
        else:
            depth -= 1
            if depth == 0:
                try:
                    json.loads(text[begin:at])
                    return text[begin:at]
                except ValueError:
                    pass  # the next outer brace may begin a whole object
    return None


def _objects(texts: pa.Array) -> pa.Array:
    return pa.array([_object_in(t) for t in texts.to_pylist()], pa.string())


def first_object(text: Column) -> Column:
    """The first outermost pair of braces in a text whose content is valid JSON, as it stands there; null if there is none."""
    return F.arrow_udf(_objects, "string")(text)
