"""Relational operators over the function-contract store.

Relations: records(uuid, function_name, class_name, file_path, line_number, src_hash, is_external,
do_description, operational_claim, ...), ins(record_uuid, ordinal, name, type_str, source, source_uuid,
source_function, dispatch, ...), outs(record_uuid, ordinal, name, type_str, description),
test_refs(target_uuid, covers_error_path, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.exprs import record_uuid
from depweave.operators.graph import reachable

PENDING = ("SKELETON_ONLY", "EXTRACTION_FAILED")


def deps(ins: DataFrame) -> DataFrame:
    """Distinct (dependent_uuid, dependency_uuid, dispatch, dispatch_candidates), where a source is known; inputs without a candidates column have none."""
    candidates = F.col("dispatch_candidates") if "dispatch_candidates" in ins.columns else F.lit(None).cast("string")
    return ins.filter("source_uuid is not null").select(
        F.col("record_uuid").alias("dependent_uuid"), F.col("source_uuid").alias("dependency_uuid"), "dispatch", candidates.alias("dispatch_candidates")
    ).distinct()


def internal(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("is_external"))


def stale_candidates(records: DataFrame) -> DataFrame:
    return internal(records).select("uuid", "function_name", "file_path", "src_hash")


def ambiguous_dispatch(records: DataFrame, ins: DataFrame) -> DataFrame:
    """Inputs that are not called directly, with their records."""
    found = ins.filter("dispatch <> 'direct'").select(F.col("record_uuid").alias("uuid"), F.col("name").alias("input_name"), "dispatch", "source_function")
    return records.select("uuid", "function_name", "file_path").join(found, "uuid")


def coverage(records: DataFrame, test_refs: DataFrame) -> DataFrame:
    """Tests and error-path tests per internal record, zeros included; counted before the join."""
    counts = test_refs.groupBy(F.col("target_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("n"), F.count_if("covers_error_path").alias("e"))
    return internal(records).select("uuid", "function_name", "file_path").join(counts, "uuid", "left").select(
        "uuid", "function_name", "file_path", F.coalesce("n", F.lit(0)).alias("test_count"), F.coalesce("e", F.lit(0)).alias("error_path_tests")
    )


def nested(records: DataFrame, ins: DataFrame, outs: DataFrame) -> DataFrame:
    """Records with ``ins`` and ``outs`` arrays in order of ordinal (one pass instead of a read per record)."""

    def gathered(children: DataFrame, name: str) -> DataFrame:
        rest = [c for c in children.columns if c not in ("record_uuid", "ordinal")]
        rows = children.groupBy(F.col("record_uuid").alias("uuid")).agg(F.array_sort(F.collect_list(F.struct("ordinal", *rest))).alias(name))
        return rows

    empty = lambda c: F.coalesce(c, F.array())
    return (
        records.join(gathered(ins, "ins"), "uuid", "left").join(gathered(outs, "outs"), "uuid", "left")
        .withColumns({"ins": empty("ins"), "outs": empty("outs")})
    )


def by_directory(records: DataFrame, prefix: str) -> DataFrame:
    """Internal records under a directory at any depth; case and the wildcards _ and % match as in LIKE."""
    p = prefix.rstrip("/")
    return internal(records).filter(F.col("file_path").ilike(f"{p}/%") | F.col("file_path").ilike(f"%/{p}/%"))


def pending(records: DataFrame) -> DataFrame:
    """Internal records still to be described, by file and line (unknown lines first)."""
    return internal(records).filter(F.col("do_description").isin(*PENDING)).orderBy("file_path", F.asc_nulls_first("line_number"))


def stale(records: DataFrame, current: DataFrame) -> DataFrame:
    """(uuid): internal records whose hash differs from ``current`` (file_path, src_hash); unlisted files are not stale."""
    now = current.select("file_path", F.col("src_hash").alias("now"))
    return stale_candidates(records).join(now, "file_path").filter(F.col("src_hash") != F.col("now")).select("uuid")


def _as_edges(ins: DataFrame) -> DataFrame:
    """Dependent to dependency, as graph edges."""
    return deps(ins).select(F.col("dependent_uuid").alias("from_id"), F.col("dependency_uuid").alias("to_id"))


def transitively_stale(records: DataFrame, ins: DataFrame, seeds: DataFrame) -> DataFrame:
    """(uuid): the stale ``seeds`` (uuid) that exist and everything that depends on them."""
    start = seeds.join(records.select("uuid"), "uuid", "left_semi").select(F.col("uuid").alias("id"))
    return reachable(_as_edges(ins), start, reverse=True).select(F.col("id").alias("uuid"))


def stale_report(records: DataFrame, ins: DataFrame, current: DataFrame) -> DataFrame:
    """(uuid, function_name, file_path, marker): every stale record, whether its file changed (direct) or something it needs did (transitive)."""
    direct = stale(records, current).select("uuid", F.lit("direct").alias("how")).distinct()
    every = transitively_stale(records, ins, direct.select("uuid")).distinct().join(direct, "uuid", "left")
    return records.select("uuid", "function_name", "file_path").join(every, "uuid").select("uuid", "function_name", "file_path", F.coalesce("how", F.lit("transitive")).alias("marker"))


def resolve_names(records: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (function_name, file_path and more) with ``found_uuid``: the internal record of that name in that file, else in any; the smallest uuid of several, null for none."""
    here = internal(records).groupBy("function_name", "file_path").agg(F.min("uuid").alias("_here"))
    any_file = internal(records).groupBy("function_name").agg(F.min("uuid").alias("_any"))
    return asked.join(here, ["function_name", "file_path"], "left").join(any_file, "function_name", "left").withColumn("found_uuid", F.coalesce("_here", "_any")).drop("_here", "_any")


def next_calls(records: DataFrame, ins: DataFrame, visited: DataFrame) -> DataFrame:
    """(record_uuid, next_uuid): the internal records that each one's internal calls lead to by name and the input's own file hint (source_file), those ``visited`` (uuid) left out."""
    calls = ins.filter("source = 'internal_call'").select("record_uuid", F.col("source_function").alias("function_name"), F.col("source_file").alias("file_path")).distinct()
    found = resolve_names(records, calls).filter("found_uuid is not null").select("record_uuid", F.col("found_uuid").alias("next_uuid")).distinct()
    return found.join(visited.select(F.col("uuid").alias("next_uuid")), "next_uuid", "left_anti").select("record_uuid", "next_uuid")


def all_uuids(records: DataFrame) -> DataFrame:
    return records.select("uuid").distinct()


def by_file(records: DataFrame, paths: DataFrame) -> DataFrame:
    """Internal records of the given files (file_path)."""
    return internal(records).join(paths, "file_path", "left_semi")


def validate_depends_on(records: DataFrame, depends: DataFrame) -> DataFrame:
    """``depends`` (gwt_id, uid) with ``warning``: null where the uid is a record's, else why it is removed."""
    known = all_uuids(records).select(F.col("uuid").alias("uid"), F.lit(True).alias("known"))
    lost = F.concat(F.lit("UUID "), F.col("uid"), F.lit(" not found in the store \u2014 removed from depends_on"))
    return depends.join(known, "uid", "left").select("gwt_id", "uid", F.when(F.col("known"), F.lit(None).cast("string")).otherwise(lost).alias("warning"))


def neighbourhood(records: DataFrame, ins: DataFrame, function_name: str, direction: str) -> DataFrame:
    """Records that those named ``function_name`` need (forward), that need them (reverse), or both (full)."""
    start = records.filter(F.col("function_name") == function_name).select(F.col("uuid").alias("id"))
    edges = _as_edges(ins)
    ways = {"forward": (False,), "reverse": (True,), "full": (False, True)}[direction]
    found = None
    for way in ways:
        ids = reachable(edges, start, reverse=way)
        found = ids if found is None else found.unionByName(ids)
    return records.join(found.distinct().select(F.col("id").alias("uuid")), "uuid", "left_semi")


def _open_calls() -> Column:
    return (F.col("source") == "internal_call") & F.col("source_uuid").isNull()


def backfill(records: DataFrame, ins: DataFrame) -> DataFrame:
    """``ins`` with the sources of open internal calls found by function name (smallest uuid among homonyms)."""
    first = records.groupBy(F.col("function_name").alias("source_function")).agg(F.min("uuid").alias("found"))
    return ins.join(first, "source_function", "left").withColumn("source_uuid", F.when(_open_calls(), F.col("found")).otherwise(F.col("source_uuid"))).select(ins.columns)


def unresolved(records: DataFrame, ins: DataFrame) -> DataFrame:
    """Internal calls without a source, with the function that makes them."""
    found = ins.filter(_open_calls()).select(F.col("record_uuid").alias("uuid"), F.col("name").alias("input_name"), "type_str", "source_function", "dispatch")
    return records.select("uuid", "function_name", "file_path").join(found, "uuid")


def completeness_warnings(records: DataFrame, ins: DataFrame) -> DataFrame:
    """(uuid, warning) of each internal call without a source."""
    text = F.concat(F.col("function_name"), F.lit(": input '"), F.col("input_name"), F.lit("' references '"), F.coalesce("source_function", F.lit("None")), F.lit("' but no matching record found"))
    return unresolved(records, ins).select("uuid", text.alias("warning"))


def content_donor(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (function_name, class_name, src_hash) with the smallest described internal record of equal content."""
    key = [F.col("function_name"), F.coalesce("class_name", F.lit("")).alias("class_name"), F.col("src_hash")]
    donors = internal(records).filter(~F.col("do_description").isin(*PENDING)).groupBy(*key).agg(F.min("uuid").alias("donor"))
    return wanted.withColumn("class_name", F.coalesce("class_name", F.lit(""))).join(donors, ["function_name", "class_name", "src_hash"], "left")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace: the row of the greatest ``order`` of each key (map-side combined, so that a key with very many rows is no task of its own)."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("_last"))
    return last.select("_last.*")


def entry_names(explicit: DataFrame, stored: DataFrame, records: DataFrame) -> DataFrame:
    """(project, function_name): a project's explicit entry points, else its stored ones, else its records that are skeletons; all three have these columns."""
    skeletons = records.filter(F.col("do_description") == PENDING[0])
    tiers = None
    for k, rows in enumerate((explicit, stored, skeletons)):
        tier = rows.select("project", "function_name", F.lit(k).alias("tier"))
        tiers = tier if tiers is None else tiers.unionByName(tier)
    return tiers.join(tiers.groupBy("project").agg(F.min("tier").alias("tier")), ["project", "tier"], "left_semi").select("project", "function_name")


def upsert_records(records: DataFrame, ins: DataFrame, outs: DataFrame, new: DataFrame, new_ins: DataFrame, new_outs: DataFrame, *, keep_inbound: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace records with their children; references to them are cut until the next back-fill unless ``keep_inbound``."""
    ids = new.select("uuid")
    child = ids.select(F.col("uuid").alias("record_uuid"))
    kept = ins.join(child, "record_uuid", "left_anti")
    if not keep_inbound:
        cut_ids = ids.select(F.col("uuid").alias("source_uuid"), F.lit(True).alias("_cut"))
        kept = kept.join(cut_ids, "source_uuid", "left").withColumn("source_uuid", F.when(F.col("_cut"), None).otherwise(F.col("source_uuid"))).select(ins.columns)
    return (
        records.join(ids, "uuid", "left_anti").unionByName(new, allowMissingColumns=True), kept.unionByName(new_ins, allowMissingColumns=True),
        outs.join(child, "record_uuid", "left_anti").unionByName(new_outs, allowMissingColumns=True),
    )


def exploded(records: DataFrame, column: str) -> DataFrame:
    """(record_uuid, ordinal, the fields of the array's structs): children of new records, numbered by their place in the array."""
    rows = records.select(F.col("uuid").alias("record_uuid"), F.posexplode(column).alias("ordinal", "child"))
    return rows.select("record_uuid", "ordinal", "child.*")


def adopt_donors(donors: DataFrame, records: DataFrame, ins: DataFrame, outs: DataFrame, test_refs: DataFrame, maps: DataFrame, entry_points: DataFrame) -> tuple[DataFrame, ...]:
    """The six tables without the ``donors`` (uuid): their rows go, references to them from inputs and entry points become null."""
    named = lambda c: donors.select(F.col("uuid").alias(c)).distinct()

    def unlinked(rows: DataFrame, column: str) -> DataFrame:
        gone = named(column).withColumn("_gone", F.lit(True))
        return rows.join(gone, column, "left").withColumn(column, F.when(F.col("_gone"), None).otherwise(F.col(column))).select(rows.columns)

    return (
        records.join(named("uuid"), "uuid", "left_anti"), unlinked(ins.join(named("record_uuid"), "record_uuid", "left_anti").select(ins.columns), "source_uuid"),
        outs.join(named("record_uuid"), "record_uuid", "left_anti"), test_refs.join(named("target_uuid"), "target_uuid", "left_anti"),
        maps.join(named("entry_uuid"), "entry_uuid", "left_anti"), unlinked(entry_points, "record_uuid"),
    )


def mentioned(records: DataFrame, functions: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """(uuid): internal records of the given functions (function_name), files (path, whole or the end of one after a slash) and folders (directory, at any depth, in any case).

    Ends of a path and runs of its folders are join keys, so nothing is compared pairwise.
    """
    rows = internal(records).select("uuid", "function_name", "file_path")
    parts = F.split("file_path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    depth = F.size(parts) - 1
    run_from = lambda a: F.transform(F.sequence(F.lit(1), depth - a + 1), lambda n: F.lower(F.array_join(F.slice(parts, a, n), "/")))
    runs = F.when(depth > 0, F.flatten(F.transform(F.sequence(F.lit(1), depth), run_from))).otherwise(F.array().cast("array<string>"))
    by_end = rows.select("uuid", F.explode(ends).alias("path")).join(files.select("path"), "path", "left_semi").select("uuid")
    wanted = folders.select(F.lower(F.rtrim(F.col("directory"), F.lit("/"))).alias("directory"))
    by_folder = rows.select("uuid", F.explode(runs).alias("directory")).join(wanted, "directory", "left_semi").select("uuid")
    return rows.join(functions.select("function_name"), "function_name", "left_semi").select("uuid").unionByName(by_end).unionByName(by_folder).distinct()


def relevant_records(records: DataFrame, ins: DataFrame, functions: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """The ``mentioned`` records and all that those of their names need."""
    found = mentioned(records, functions, files, folders)
    names = records.join(found, "uuid", "left_semi").select("function_name").distinct()
    start = records.join(names, "function_name", "left_semi").select(F.col("uuid").alias("id"))
    return records.join(reachable(_as_edges(ins), start).select(F.col("id").alias("uuid")), "uuid", "left_semi")


def external_records(ins: DataFrame, records: DataFrame) -> DataFrame:
    """(uuid, function_name, file_path, src_hash, source_crate, boundary_contract): one new record of each external call that names a function (source_file null: ``external``)."""
    path = F.coalesce(F.nullif("source_file", F.lit("")), F.lit("external"))
    calls = ins.filter("source = 'external' and source_function <> ''").select(F.col("source_function").alias("function_name"), path.alias("file_path"), (path == F.col("source_file")).alias("has_file")).distinct()
    crate = F.when(F.col("has_file"), F.substring_index("file_path", ".", 1)).otherwise(F.substring_index("function_name", ".", 1))
    made = calls.select(
        record_uuid(F.col("file_path"), F.lit(None).cast("string"), F.col("function_name")).alias("uuid"), "function_name", "file_path", F.lit("external").alias("src_hash"),
        crate.alias("source_crate"), F.concat(F.lit("External call to "), "function_name").alias("boundary_contract"),
    )
    return made.join(records.select("uuid"), "uuid", "left_anti").dropDuplicates(["uuid"])


def cards(records: DataFrame, ins: DataFrame, outs: DataFrame) -> DataFrame:
    """(uuid, card): one text per record with its inputs, what it does in which steps (do_steps), its outputs and how it fails (failure_modes)."""
    r = nested(records, ins, outs)
    line = lambda label, rows: F.when(F.size(rows) > 0, F.concat(F.lit(label), F.array_join(rows, "\n")))
    given = F.transform("ins", lambda i: F.concat(F.lit("- "), i["name"], F.lit(": "), i["type_str"], F.lit(" ("), i["source"], F.when(i["dispatch"] != "direct", F.concat(F.lit(" ["), i["dispatch"], F.lit("]"))).otherwise(""), F.lit(")")))
    steps = F.transform("do_steps", lambda x, k: F.concat(F.lit("  "), (k + 1).cast("string"), F.lit(". "), x))
    made = F.transform("outs", lambda o: F.concat(F.lit("- "), o["name"], F.lit(": "), o["type_str"], F.lit(" -- "), o["description"]))
    header = F.concat(
        F.lit("### "), "function_name", F.when(F.coalesce("class_name", F.lit("")) != "", F.concat(F.lit(" ("), F.col("class_name"), F.lit(")"))).otherwise(""),
        F.lit(" @ "), "file_path", F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("None")),
    )
    text = F.concat(
        F.concat_ws(
            "\n", header, F.concat(F.lit("\n**Claim:** "), F.col("operational_claim"), F.lit("\n")), line("**IN:**\n", given),
            F.concat(F.lit("\n**DO:** "), F.col("do_description")), line("", steps), line("\n**OUT:**\n", made),
            F.when(F.size("failure_modes") > 0, F.concat(F.lit("\n**FAILURE MODES:** "), F.array_join("failure_modes", "; "))),
        ),
        F.lit("\n"),
    )
    return r.select("uuid", text.alias("card"))
