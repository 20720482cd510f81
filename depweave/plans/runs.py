"""Queries of crawls, registrations, logs, conditions and read-back answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions import conditions, exprs, records
from depweave.operators import crawl, register, status, store, traces
from depweave.plans.registry import QUERIES, SQL, query
from depweave.plans.relations import relation, with_
from depweave.session import checkpoint_root, table

_CRAWL_RELATIONS = ("functions", "invocations", "entry_points", "function_files")
_CRAWLED = with_(*_CRAWL_RELATIONS, recursive=True) + """,
    own AS (SELECT * FROM functions WHERE NOT is_external),
    fate AS (SELECT uuid, CASE WHEN do_description NOT IN ('SKELETON_ONLY', 'EXTRACTION_FAILED') AND f.src_hash = own.src_hash THEN 'skipped' WHEN line_number = 7 THEN 'failed' ELSE 'extracted' END AS outcome FROM own LEFT JOIN function_files f USING (file_path)),
    visited AS (SELECT uuid FROM functions WHERE line_number = 9), by_name AS (SELECT function_name, min(uuid) AS u FROM own GROUP BY 1), by_file AS (SELECT function_name, file_path, min(uuid) AS u FROM own GROUP BY 1, 2),
    link AS (SELECT DISTINCT i.record_uuid AS a, coalesce(f.u, n.u) AS b FROM invocations i LEFT JOIN by_file f ON f.function_name = i.source_function AND f.file_path = i.source_file LEFT JOIN by_name n ON n.function_name = i.source_function
        WHERE i.source = 'internal_call' AND coalesce(f.u, n.u) IS NOT NULL),
    walk(uuid, depth) AS (SELECT u, 0 FROM entry_points JOIN by_name USING (function_name) WHERE u NOT IN (SELECT uuid FROM visited)
        UNION SELECT l.b, w.depth + 1 FROM walk w JOIN fate f ON f.uuid = w.uuid AND f.outcome = 'extracted' JOIN link l ON l.a = w.uuid WHERE w.depth < 60 AND l.b NOT IN (SELECT uuid FROM visited)),
    met AS (SELECT uuid, min(depth) AS depth FROM walk GROUP BY uuid),
    done AS (SELECT m.uuid, m.depth, (SELECT min(p.uuid) FROM met p JOIN fate f ON f.uuid = p.uuid AND f.outcome = 'extracted' JOIN link l ON l.a = p.uuid AND l.b = m.uuid WHERE p.depth = m.depth - 1) AS parent, fate.outcome FROM met m JOIN fate ON fate.uuid = m.uuid
        UNION ALL SELECT uuid, NULL, NULL, outcome FROM own JOIN fate USING (uuid) WHERE do_description IN ('SKELETON_ONLY', 'EXTRACTION_FAILED') AND uuid NOT IN (SELECT uuid FROM met) AND uuid NOT IN (SELECT uuid FROM visited))"""


def _crawl(functions: DataFrame, invocations: DataFrame, entry_points: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """A crawl from the nations' functions, resumed after those at line 9; those at line 7 fail."""
    return crawl.crawl(
        functions, invocations, entry_points, visited=functions.filter("line_number = 9"), max_functions=most, current=files, failing=functions.filter("line_number = 7").select("uuid")
    )


@query("crawl_levels", *_CRAWL_RELATIONS, sql=_CRAWLED + " SELECT uuid, coalesce(depth, -1) AS depth, parent, outcome FROM done")
def _levels(functions, invocations, entry_points, files):
    """Swept records stand at depth -1."""
    return _crawl(functions, invocations, entry_points, files).withColumn("depth", F.coalesce("depth", F.lit(-1)))


@query("crawl_budget", *_CRAWL_RELATIONS)
def _budget(functions, invocations, entry_points, files):
    """At most 150 extracted; no SQL, as the order inside a level decides who comes before the budget ends."""
    return _crawl(functions, invocations, entry_points, files, 150)


@query("crawl_counts", *_CRAWL_RELATIONS, sql=_CRAWLED + """
    , calls AS (SELECT DISTINCT i.source_function AS f, i.source_file AS file FROM invocations i JOIN done d ON d.uuid = i.record_uuid AND d.outcome = 'extracted' WHERE i.source = 'external')
    SELECT count(*) FILTER (outcome = 'extracted') AS extracted, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, (SELECT count(*) FROM calls) AS ax_records FROM done""")
def _crawl_counts(functions, invocations, entry_points, files):
    return crawl.crawl_counts(_crawl(functions, invocations, entry_points, files), functions, invocations)


def store_entry_points(spark, sf_dir):
    """Events as entry points that replace one another by file and function."""
    events = table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(".py")).alias("file_path"), F.concat(F.lit("fn_"), F.col("user_id") % 20).alias("function_name"), "event_type", "event_id", F.concat(F.lit("/"), "user_id").alias("route"),
        F.when(F.col("value") > 10, "GET").alias("method"),
    )
    return store.keep_last(events, ["file_path", "function_name"], "event_id").select("file_path", "function_name", F.col("event_type").alias("entry_type"), "route", "method")


def store_maps(spark, sf_dir):
    """Orders as maps that replace one another by workflow: their lines are the path, large ones are shared."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("part-"), "l_partkey").alias("u"), (F.col("l_quantity") > 40).alias("shared"))
    paths = line.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("u")).alias("path_uuids"), F.array_sort(F.collect_list(F.when(F.col("shared"), F.col("u")))).alias("shared_uuids"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("flow-"), "o_custkey").alias("workflow_name")).join(paths, "o_orderkey")
    last = store.keep_last(orders, ["workflow_name"], "o_orderkey")
    return last.select("workflow_name", F.col("path_uuids")[0].alias("entry_uuid"), F.array_join("path_uuids", ",").alias("path_uuids"), F.array_join("shared_uuids", ",").alias("shared_uuids"))


def crawl_entry_names(spark, sf_dir):
    """Nations are projects: some have explicit entry points (suppliers), some stored ones (customers), the rest their skeletons."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    explicit = supplier.filter("s_nationkey < 8").select(F.col("s_nationkey").alias("project"), F.col("s_name").alias("function_name"))
    stored = customer.filter("c_nationkey < 16").select(F.col("c_nationkey").alias("project"), F.col("c_name").alias("function_name"))
    own = relation(spark, sf_dir, "functions").select((F.col("line_number") % 25).alias("project"), "function_name", "do_description").join(nation.select(F.col("n_nationkey").alias("project")), "project", "left_semi")
    return store.entry_names(explicit, stored, own)


def log_failures(spark, sf_dir):
    """Every event's checker output: its kind and its counts."""
    kind, n = F.col("event_type"), F.col("event_id")
    said = (
        F.when(kind == "error", F.concat(F.lit("Error: Invariant  Safe is violated.\n"), n, F.lit(" states generated, "), F.col("user_id"), F.lit(" distinct states found"))).when(kind == "view", "Deadlock reached. Unknown operator: x")
        .when(kind == "click", F.concat(F.lit("Parsing or semantic analysis failed. Deadlock reached "), n)).when(kind == "purchase", "Unknown operator:y").otherwise(F.concat(n, F.lit(" states generated\n3 distinct")))
    )
    read = table(spark, sf_dir, "events").select("event_id", said.alias("t"), (F.col("value") > 3).alias("ok"))
    counts = exprs.state_counts(F.col("t"))
    return read.select("event_id", exprs.failure_class(F.col("t"), F.col("ok")).alias("failure"), F.coalesce(counts["found"], F.lit(-1)).alias("found"), F.coalesce(counts["distinct"], F.lit(-1)).alias("different"))


QUERIES |= {"store_entry_points": store_entry_points, "store_maps": store_maps, "crawl_entry_names": crawl_entry_names, "log_failures": log_failures}
SQL["store_entry_points"] = """SELECT event_type || '.py' AS file_path, 'fn_' || (user_id % 20) AS function_name, arg_max(event_type, event_id) AS entry_type, '/' || arg_max(user_id, event_id) AS route,
    arg_max(CASE WHEN value > 10 THEN 'GET' ELSE 'none' END, event_id) AS m, nullif(m, 'none') AS method FROM events GROUP BY 1, 2"""
SQL["store_entry_points"] = f"SELECT file_path, function_name, entry_type, route, method FROM ({SQL['store_entry_points']})"
SQL["store_maps"] = """WITH p AS (SELECT l_orderkey, string_agg('part-' || l_partkey, ',' ORDER BY 'part-' || l_partkey) AS path_uuids, coalesce(string_agg('part-' || l_partkey, ',' ORDER BY 'part-' || l_partkey) FILTER (l_quantity > 40), '') AS shared_uuids FROM lineitem GROUP BY 1),
    o AS (SELECT 'flow-' || o_custkey AS workflow_name, p.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders JOIN p ON l_orderkey = o_orderkey)
    SELECT workflow_name, split_part(path_uuids, ',', 1) AS entry_uuid, path_uuids, shared_uuids FROM o WHERE n = 1"""
SQL["crawl_entry_names"] = with_("functions") + """, t AS (SELECT s_nationkey AS project, s_name AS function_name, 0 AS tier FROM supplier WHERE s_nationkey < 8 UNION ALL SELECT c_nationkey, c_name, 1 FROM customer WHERE c_nationkey < 16
        UNION ALL SELECT line_number % 25, function_name, 2 FROM functions WHERE do_description = 'SKELETON_ONLY' AND line_number % 25 IN (SELECT n_nationkey FROM nation))
    SELECT project, function_name FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.project = t.project)"""
SQL["log_failures"] = """SELECT event_id, CASE WHEN NOT value > 3 THEN 'syntax_error' WHEN event_type = 'click' THEN 'parse_error' WHEN event_type = 'error' THEN 'invariant_violation' WHEN event_type = 'view' THEN 'deadlock' WHEN event_type = 'purchase' THEN 'constant_mismatch' ELSE 'unknown' END AS failure,
    CASE WHEN event_type = 'error' THEN event_id ELSE -1 END AS found, CASE WHEN event_type = 'error' THEN user_id ELSE -1 END AS different FROM events"""


def ingest_run(spark, sf_dir):
    """The run's counts, taken while the dispositions are written."""
    path = f"{checkpoint_root(spark)}/tables/{uuid.uuid4().hex}"
    run = crawl.record_run(QUERIES["ingest_disposition"](spark, sf_dir), path, {"target_path": "src", "language": "python", "is_incremental": True})
    return run.drop("started_at", "completed_at")


QUERIES["ingest_run"] = ingest_run
SQL["ingest_run"] = f"SELECT 'src' AS target_path, 'python' AS language, true AS is_incremental, created AS records_created, updated AS records_updated, skipped AS records_skipped, failed AS records_failed, adopted AS records_adopted FROM ({SQL['ingest_counts']})"


def _registered(spark, sf_dir):
    bound, behaviours, parts = relation(spark, sf_dir, "bound"), relation(spark, sf_dir, "behaviours"), relation(spark, sf_dir, "nodes").filter("id like 'part-%'")
    old = bound.select("id", F.when(F.col("binding").startswith("req:"), "requirement").otherwise("behavior").alias("kind"), F.col("id").alias("name"))
    customer = table(spark, sf_dir, "customer")
    asked = customer.select(F.col("c_custkey").alias("place"), F.concat(F.lit("REQ-"), "c_custkey").alias("id"), F.concat("c_name", F.lit(" needs "), "c_mktsegment").alias("text"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("name"))
    wanted = behaviours.withColumnsRenamed({"when_": "when", "then_": "then"}).withColumn("depends_on", F.array("need", F.lit("nowhere")))
    none = bound.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("").alias("edge_type")).limit(0)
    return register.register(old.unionByName(parts), none, bound, asked, wanted)


_REGISTERED = with_("bound", "behaviours", "nodes") + """,
    top AS (SELECT coalesce(max(CAST(split_part(id, '-', 2) AS bigint)) FILTER (id LIKE 'req-%'), 0) AS req, coalesce(max(CAST(split_part(id, '-', 2) AS bigint)) FILTER (id LIKE 'gwt-%'), 0) AS gwt FROM bound),
    req AS (SELECT 'REQ-' || c_custkey AS key, c_custkey AS place, b.id AS old, row_number() OVER (PARTITION BY b.id IS NULL ORDER BY c_custkey) AS k FROM customer LEFT JOIN bound b ON b.binding = 'req:REQ-' || c_custkey),
    reqs AS (SELECT key, coalesce(old, 'req-' || CASE WHEN top.req + k < 10000 THEN lpad(CAST(top.req + k AS varchar), 4, '0') ELSE CAST(top.req + k AS varchar) END) AS id FROM req, top),
    gwt AS (SELECT w.*, b.id AS old, row_number() OVER (PARTITION BY b.id IS NULL ORDER BY place) AS k FROM behaviours w LEFT JOIN bound b ON b.binding = 'gwt:' || criterion_id),
    gwts AS (SELECT *, coalesce(old, 'gwt-' || CASE WHEN top.gwt + k < 10000 THEN lpad(CAST(top.gwt + k AS varchar), 4, '0') ELSE CAST(top.gwt + k AS varchar) END) AS id FROM gwt, top)"""


def register_answer(spark, sf_dir):
    """Customers are requirements, orders are behaviours; some are bound already."""
    return _registered(spark, sf_dir)[3]


def register_edges(spark, sf_dir):
    return _registered(spark, sf_dir)[1]


def register_nodes(spark, sf_dir):
    return _registered(spark, sf_dir)[0].filter("kind <> 'resource'").select("id", "kind", "name", "text", "given", "when")


QUERIES |= {"register_answer": register_answer, "register_edges": register_edges, "register_nodes": register_nodes}
SQL["register_answer"] = _REGISTERED + " SELECT 'req' AS kind, key, id FROM reqs UNION ALL SELECT 'gwt', criterion_id, id FROM gwts"
SQL["register_edges"] = _REGISTERED + """, fresh AS (SELECT * FROM gwts WHERE old IS NULL),
    known AS (SELECT id FROM bound UNION SELECT id FROM reqs UNION SELECT id FROM nodes WHERE id LIKE 'part-%'),
    parent AS (SELECT f.id, coalesce(r.id, n.id, b.id) AS parent FROM fresh f LEFT JOIN reqs r ON r.key = f.parent_req LEFT JOIN known n ON n.id = f.parent_req LEFT JOIN bound b ON b.binding = 'req:' || f.parent_req WHERE f.parent_req <> '')
    SELECT parent AS from_id, id AS to_id, 'decomposes' AS edge_type FROM parent WHERE parent IS NOT NULL
    UNION ALL SELECT id, need, 'depends_on' FROM fresh WHERE need IN (SELECT id FROM nodes WHERE id LIKE 'part-%')"""
SQL["register_nodes"] = _REGISTERED + """, parts AS (SELECT * FROM nodes WHERE id LIKE 'part-%' AND kind <> 'resource')
    SELECT id, CASE WHEN binding LIKE 'req:%' THEN 'requirement' ELSE 'behavior' END AS kind, id AS name, NULL AS text, NULL AS given, NULL AS "when" FROM bound UNION ALL SELECT id, kind, name, NULL, NULL, NULL FROM parts
    UNION ALL SELECT reqs.id, 'requirement', CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE replace(lower(left(c_name || ' needs ' || c_mktsegment, 40)), ' ', '_') END, c_name || ' needs ' || c_mktsegment, NULL, NULL
        FROM reqs JOIN customer ON key = 'REQ-' || c_custkey WHERE reqs.id NOT IN (SELECT id FROM bound)
    UNION ALL SELECT id, 'behavior', coalesce(name, rtrim(left(trim(regexp_replace(lower(when_), '[^a-z0-9]+', '_', 'g'), '_'), 40), '_')), NULL, given, when_ FROM gwts WHERE old IS NULL"""


@query("trace_lassos", "traces", sql=with_("traces") + """, s AS (SELECT trace_id, state_num, string_agg(var || '=' || value, ',' ORDER BY var) AS v FROM traces GROUP BY ALL), r AS (SELECT *, min(state_num) OVER (PARTITION BY trace_id, v) AS start FROM s),
    e AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY state_num) AS n FROM r WHERE start < state_num)
    SELECT trace_id, start AS loop_start, state_num AS loop_end, state_num - start AS loop_length FROM e WHERE n = 1""")
def _lassos(flat):
    return traces.lassos(flat)


# A log per user: a state per event, numbered from 1 again after each error; three values and, now and then, one more of a name in use.
_LINES = """WITH e AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM {events}),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY n) AS k FROM e)
    SELECT user_id AS log_id, n * 10 AS line_no, '  State ' || k || ': <' || event_type || ' line ' || n || '>' AS text FROM s
    UNION ALL SELECT user_id, n * 10 + 1, '/' || chr(92) || ' kind = ' || event_type || ' ' FROM s
    UNION ALL SELECT user_id, n * 10 + 2, '/' || chr(92) || ' level = ' || CASE WHEN value < 10 THEN 'low' ELSE 'high' END FROM s
    UNION ALL SELECT user_id, n * 10 + 3, CASE event_type WHEN 'view' THEN '/' || chr(92) || ' kind = seen' WHEN 'click' THEN 'Back to state ' || k WHEN 'error' THEN 'Invariant Safe' || k || ' is violated.' ELSE 'nothing' END FROM s
    UNION ALL SELECT user_id, n * 10 + 4, '/' || chr(92) || ' late = yes' FROM s"""
_LINES_SQL = _LINES.replace("{events}", "events")
_STATES_SQL = f"""lines AS ({_LINES_SQL}), l AS (SELECT log_id, line_no, trim(text) AS t FROM lines),
    m AS (SELECT *, regexp_matches(t, '^State\\s+\\d+:\\s*<.+?>') AS head, regexp_matches(t, '^Back\\s+to\\s+state\\s+\\d+') AS back FROM l),
    g AS (SELECT *, count(*) FILTER (head OR back) OVER (PARTITION BY log_id ORDER BY line_no) AS st FROM m),
    heads AS (SELECT log_id, st, line_no, CAST(regexp_extract(t, '^State\\s+(\\d+)', 1) AS bigint) AS state_num, regexp_extract(t, '<(.+?)>', 1) AS label FROM g WHERE head),
    vals AS (SELECT log_id, st, regexp_extract(t, '^/.\\s+(\\w+)\\s*=', 1) AS var, arg_max(trim(regexp_extract(t, '=\\s*(.+)$', 1)), line_no) AS value FROM g WHERE NOT head AND NOT back AND regexp_matches(t, '^/.\\s+\\w+\\s*=\\s*.+') GROUP BY ALL),
    held AS (SELECT log_id, st, string_agg(var || '=' || value, ',' ORDER BY var) AS vars FROM vals GROUP BY ALL),
    o AS (SELECT h.*, coalesce(v.vars, '') AS vars, row_number() OVER (PARTITION BY h.log_id ORDER BY h.st) AS r, count(*) FILTER (state_num <> 1) OVER (PARTITION BY h.log_id ORDER BY h.st) AS others FROM heads h LEFT JOIN held v USING (log_id, st)),
    i AS (SELECT *, row_number() OVER (PARTITION BY log_id, others ORDER BY r) + CASE WHEN others = 0 THEN 1 ELSE 0 END - 2 AS k0, min(r) FILTER (state_num = 1) OVER (PARTITION BY log_id, others) AS ir FROM o),
    c AS (SELECT *, r = 1 OR (state_num = 1 AND ((r - ir) + CASE WHEN ir = 2 AND others = 1 THEN 1 ELSE 0 END) % 2 = 0) AS cut FROM i),
    n AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY log_id ORDER BY r) AS trace_no FROM c)"""


def log_traces(spark, sf_dir):
    """The events as logs, cut into traces where the numbering begins again."""
    lines = spark.sql(_LINES, events=table(spark, sf_dir, "events"))
    flat = F.array_join(F.transform("vars", lambda x: F.concat(x["var"], F.lit("="), x["value"])), ",")
    return traces.traces(lines).withColumn("vars", flat)


def log_counterexamples(spark, sf_dir):
    return traces.counterexamples(spark.sql(_LINES, events=table(spark, sf_dir, "events"))).withColumn("back_to", F.coalesce("back_to", F.lit(-1)))


QUERIES |= {"log_traces": log_traces, "log_counterexamples": log_counterexamples}
SQL["log_traces"] = f"WITH {_STATES_SQL} SELECT log_id, trace_no, row_number() OVER (PARTITION BY log_id, trace_no ORDER BY r) AS place, state_num, label, vars FROM n"
SQL["log_counterexamples"] = f"""WITH lines AS ({_LINES_SQL}) SELECT log_id, arg_min(regexp_extract(text, 'Invariant\\s+(\\w+)\\s+is\\s+violated', 1), line_no) FILTER (text LIKE 'Invariant %') AS violated_invariant,
    count(*) FILTER (trim(text) LIKE 'State %') AS state_count, coalesce(arg_max(TRY_CAST(regexp_extract(text, '(\\d+)$', 1) AS bigint), line_no) FILTER (text LIKE 'Back to state %'), -1) AS back_to FROM lines GROUP BY log_id"""

#: Conditions over lines' states: quantity and tax are numbers, flags is a set, steps a sequence.
CONDITIONS = {
    "bounded": r"quantity >= 1 /\ quantity <= 50", "typed": r"returnflag \in {\"A\", \"N\", \"R\"} /\ linestatus # \"X\"".replace('\\"', '"'), "implied": '(returnflag = "A" /\\ quantity > 40) => discount < 0.05',
    "every": r"\A s \in steps : s <= linenumber \/ s = 7", "some": r'\E f \in flags : f = returnflag /\ Len(steps) > 3', "nested": r"\A a \in steps : \E b \in steps : a + b > linenumber",
    "counted": r"Cardinality(flags) = 2 /\ ~(tax > 0.05)", "ranged": r"linenumber \notin {3..5}", "unknown": "quantity > missing \\/ quantity < 10",
}


def state_conditions(spark, sf_dir):
    """Each condition over every line."""
    line = table(spark, sf_dir, "lineitem")
    named = [F.col(f"l_{c}").alias(c) for c in ("orderkey", "linenumber", "partkey", "suppkey", "quantity", "discount", "tax", "returnflag", "linestatus")]
    states = line.select(*named, F.array("l_returnflag", "l_linestatus").alias("flags"), F.sequence(F.lit(1), F.col("l_linenumber").cast("int")).alias("steps"), F.when(F.col("l_linenumber") > 3, F.lit(20.0)).alias("missing"))
    return conditions.check_conditions(states, CONDITIONS, ["linenumber", "quantity", "discount", "tax", "returnflag", "linestatus", "flags", "steps", "missing"]).drop("flags", "steps", "missing")


QUERIES["state_conditions"] = state_conditions
SQL["state_conditions"] = """SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag AS returnflag, l_linestatus AS linestatus,
    l_quantity BETWEEN 1 AND 50 AS bounded, l_returnflag IN ('A', 'N', 'R') AND l_linestatus <> 'X' AS typed, NOT (l_returnflag = 'A' AND l_quantity > 40) OR l_discount < 0.05 AS implied, true AS every, l_linenumber > 3 AS some, true AS nested,
    l_returnflag <> l_linestatus AND NOT l_tax > 0.05 AS counted, l_linenumber NOT BETWEEN 3 AND 5 AS ranged, l_quantity > CASE WHEN l_linenumber > 3 THEN 20.0 END OR l_quantity < 10 AS unknown FROM lineitem"""


def _answers(spark, sf_dir) -> DataFrame:
    """(id, answer): an order's lines as a record, in a fence, bare, cut off, a list, or with an input that has no name."""
    line = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_tax") < 0.08, F.concat(F.lit('"name": "i'), "l_linenumber", F.lit('", '))).otherwise("")
    kind = F.when(F.col("l_returnflag") == "A", '"source": "internal_call", "type_str": "int"').when(F.col("l_returnflag") == "N", '"source": "magic"').otherwise('"description": "d"')
    ins = F.concat(F.lit("{"), name, kind, F.lit("}"))
    per = line.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(ins)), ", ").alias("ins"))
    orders = table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    outs = F.when(F.col("o_orderstatus") == "O", '[{"name": "err", "type_str": "E"}, {"name": "odd"}]').when(F.col("o_orderstatus") == "F", '"none"').otherwise("[]")
    body = F.concat(F.lit('{"ins": ['), F.coalesce("ins", F.lit("")), F.lit('], "outs": '), outs, F.lit(', "do_description": "'), "o_orderpriority", F.lit('", "gwts": [1, 2]}'))
    how = F.col("o_orderkey") % 5
    answer = (
        F.when(how == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(how == 1, F.concat(F.lit("\n"), body)).when(how == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(how == 3, F.concat(F.lit("Sure: "), body)).otherwise(F.regexp_replace(body, '"gwts"', '"others"'))
    )
    return orders.select(F.col("o_orderkey").alias("id"), answer.alias("answer"))


def parse_payloads(spark, sf_dir):
    return records.parse_payloads(_answers(spark, sf_dir)).select("id", F.coalesce("n_gwts", F.lit(-1)).alias("n_gwts"), "error")


def parse_records(spark, sf_dir):
    found = records.parse_records(_answers(spark, sf_dir))
    flat = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *[x[n] for n in names])), ",")
    return found.select("id", flat("ins", "name", "type_str", "source", "description").alias("ins"), flat("outs", "name", "type_str").alias("outs"), "do_description", F.coalesce(F.size("do_steps"), F.lit(-1)).cast("bigint").alias("n_steps"), "error")


QUERIES |= {"parse_payloads": parse_payloads, "parse_records": parse_records}
SQL["parse_payloads"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN 2 ELSE -1 END::BIGINT AS n_gwts, CASE o_orderkey % 5 WHEN 2 THEN 'not an object' WHEN 3 THEN 'not JSON' WHEN 4 THEN 'no gwts' END AS error FROM orders"
SQL["parse_records"] = """WITH i AS (SELECT l_orderkey, l_tax < 0.08 AS named, '{' || CASE WHEN l_tax < 0.08 THEN '"name": "i' || l_linenumber || '", ' ELSE '' END || CASE l_returnflag WHEN 'A' THEN '"source": "internal_call", "type_str": "int"' WHEN 'N' THEN '"source": "magic"' ELSE '"description": "d"' END || '}' AS raw,
        'i' || l_linenumber || '/' || CASE l_returnflag WHEN 'A' THEN 'int/internal_call/' WHEN 'N' THEN 'Any/parameter/' ELSE 'Any/parameter/d' END AS shown FROM lineitem),
    p AS (SELECT l_orderkey, bool_and(named) AS whole, string_agg(shown, ',' ORDER BY raw) AS ins FROM i GROUP BY 1),
    e AS (SELECT o.*, coalesce(ins, '') AS ins, CASE WHEN o_orderkey % 5 = 2 THEN 'not an object' WHEN o_orderkey % 5 = 3 THEN 'not JSON' WHEN NOT coalesce(whole, true) THEN 'an input without a name' END AS error FROM orders o LEFT JOIN p ON l_orderkey = o_orderkey)
    SELECT o_orderkey AS id, CASE WHEN error IS NULL THEN ins END AS ins, CASE WHEN error IS NULL THEN CASE WHEN o_orderstatus = 'O' THEN 'err/E,ok/Any' ELSE '' END END AS outs, CASE WHEN error IS NULL THEN o_orderpriority END AS do_description,
        CASE WHEN error IS NULL THEN 0 ELSE -1 END::BIGINT AS n_steps, error FROM e"""


def _progress(spark, sf_dir) -> DataFrame:
    """Progress files of users' newest events; some are cut off."""
    events = table(spark, sf_dir, "events")
    newest = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "event_id"), F.struct("ts", "event_id")).alias("e"), F.count(F.lit(1)).alias("n")).select("user_id", "e.*", "n")
    text = F.concat(
        F.lit('{"gwt_id": "gwt-'), "user_id", F.lit('", "attempt": '), "n", F.lit(', "phase": "'), "event_type", F.lit('", "pid": '), F.col("event_id") % 50,
        F.when(F.col("value") > 5, F.concat(F.lit(', "updated_at": '), F.lit(1000) + F.col("n"))).otherwise(""), F.when(F.col("event_type") == "view", "").otherwise("}"),
    )
    return newest.select(F.concat(F.lit("gwt-"), "user_id", F.lit("_progress")).alias("name"), text.alias("text"))


def _live(spark, sf_dir):
    alive = table(spark, sf_dir, "events").filter("event_type = 'click'").select((F.col("event_id") % 40).alias("pid")).distinct()
    done = relation(spark, sf_dir, "bridged")
    return status.live_progress(status.parse_progress(_progress(spark, sf_dir)), done.filter("gwt_id like '%3' or gwt_id like '%4'"), alive, F.lit(5000.5))


QUERIES |= {"status_live": _live, "status_live_counts": lambda spark, sf_dir: status.progress_counts(_live(spark, sf_dir))}
_LIVE = """WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), f AS (SELECT * FROM e WHERE n = 1 AND event_type <> 'view'),
    live AS (SELECT 'gwt-' || user_id AS gwt_id, k || '/0' AS attempt, event_type AS phase, CASE WHEN value > 5 THEN CAST(floor(5000.5 - 1000 - k) AS bigint) ELSE 0 END AS elapsed_seconds,
        CASE WHEN CAST(user_id AS varchar) SIMILAR TO '.*[34]' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 'done' WHEN event_id % 50 IN (SELECT event_id % 40 FROM events WHERE event_type = 'click') THEN 'running' ELSE 'stale' END AS state FROM f)"""
SQL["status_live"] = _LIVE + " SELECT * FROM live"
SQL["status_live_counts"] = _LIVE + " SELECT count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'stale') AS stale FROM live"
