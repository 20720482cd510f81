"""All registered queries of the engine over the driver tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import exprs, text
from depweave.operators import contracts, graph, status, store, strong
from depweave.plans.relations import relation, with_
from depweave.session import written

#: The rules of the contract checks (resource type, required outputs, position): fixed values.
RULES = [
    {"resource_type": "database", "required_outs": ["audit_event"], "position": "wrap"},
    {"resource_type": "external_api", "required_outs": ["span_id", "trace_context"], "position": "pre"},
    {"resource_type": "external_api", "required_outs": ["span_id", "trace_context"], "position": "post"},
    {"resource_type": "message_queue", "required_outs": ["trace_context"], "position": "pre"},
]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, *relations: str, sql: str | None = None):
    """Register a function of relations as query ``name``."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[relation(spark, sf_dir, r) for r in relations])
        if sql:
            SQL[name] = sql
        return f

    return register


def seeds(df: DataFrame, *ids: str) -> DataFrame:
    """(id) rows with the given ids, without a local relation made in Python."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i in ids])).alias("id"))


_CLOSED = "closed(src, dst) AS (SELECT from_id, to_id FROM edges UNION SELECT c.src, e.to_id FROM closed c JOIN edges e ON c.dst = e.from_id)"
_UP = "up(id) AS (SELECT 'nat-3' UNION SELECT e.from_id FROM up u JOIN edges e ON e.to_id = u.id)"
_DOWN = "down(id) AS (SELECT '{0}' UNION SELECT e.to_id FROM down d JOIN edges e ON e.from_id = d.id)"


@query("graph_closure", "edges", sql=with_("edges", recursive=True) + f", {_CLOSED} SELECT src, dst FROM closed")
def _closure(edges):
    return graph.closure(edges)


@query("graph_components", "nodes", "edges", sql=with_("nodes", "edges", recursive=True) + """,
    links AS (SELECT from_id AS a, to_id AS b FROM edges WHERE edge_type <> 'depends_on' UNION SELECT to_id, from_id FROM edges WHERE edge_type <> 'depends_on'),
    walk(a, b) AS (SELECT id, id FROM nodes UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a),
    least AS (SELECT a, min(b) AS m FROM walk GROUP BY a)
    SELECT 'component-' || (dense_rank() OVER (ORDER BY m) - 1) AS component_id, a AS node_id FROM least""")
def _components(nodes, edges):
    return graph.components(nodes, edges.filter("edge_type <> 'depends_on'"))


_LEAST = """links AS MATERIALIZED (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges),
    least(id, m) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT l.b, min(c.m) FROM least c JOIN links l ON l.a = c.id JOIN recurring.least r ON r.id = l.b WHERE c.m < r.m GROUP BY l.b)"""


@query("graph_components_all", "nodes", "edges", sql=with_("nodes", "edges", recursive=True) + f", {_LEAST} SELECT 'component-' || (dense_rank() OVER (ORDER BY m) - 1) AS component_id, id AS node_id FROM least")
def _all_components(nodes, edges):
    """Components over the edges of every type."""
    return graph.components(nodes, edges)


@query("graph_totals", "nodes", "edges", sql=with_("nodes", "edges", recursive=True) + f", {_LEAST} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, count(DISTINCT m) AS components FROM least")
def _totals(nodes, edges):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = graph.components(nodes, edges).agg(F.count_distinct("component_id").alias("components"))
    return count(nodes, "nodes").crossJoin(count(edges, "edges")).crossJoin(parts)  # one row each


@query("graph_component_of", "nodes", "edges", sql=with_("nodes", "edges", recursive=True) + f", {_LEAST} SELECT 'component-' || (SELECT count(DISTINCT y.m) FROM least y WHERE y.m < x.m) AS component_id, id AS node_id FROM least x WHERE id IN ('supp-3', 'reg-0')")
def _component_of(nodes, edges):
    """The components of two known nodes; an unknown one raises."""
    asked = seeds(nodes, "supp-3", "reg-0")
    graph.require(nodes, asked)
    return graph.component_of(graph.components(nodes, edges), asked)


@query("graph_cross_invariants", "edges", sql=with_("edges") + """ SELECT DISTINCT regexp_replace('Cross_' || from_id || '_' || to_id || '_' || edge_type, '[^a-zA-Z0-9_]', '_', 'g') AS name FROM edges
    WHERE (from_id LIKE 'supp-%' AND to_id LIKE 'nat-%') OR (from_id LIKE 'nat-%' AND to_id LIKE 'supp-%')""")
def _cross(edges):
    """Invariants between suppliers and nations."""
    ids = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return graph.cross_invariants(edges, ids.filter("id like 'supp-%'"), ids.filter("id like 'nat-%'"))


@query("graph_relevant", "edges", sql=with_("edges", recursive=True) + f""", {_DOWN.format('supp-3')}, below AS (SELECT id FROM down WHERE id <> 'supp-3')
    SELECT 'dependency' AS facet, id AS a, NULL AS b, NULL AS edge_type FROM below
    UNION ALL SELECT 'direct', from_id, to_id, edge_type FROM edges WHERE from_id = 'supp-3'
    UNION ALL SELECT 'induced', from_id, to_id, edge_type FROM edges WHERE from_id IN (SELECT id FROM down) AND to_id IN (SELECT id FROM down)""")
def _relevant(edges):
    below, direct, induced = graph.relevant(edges, seeds(edges, "supp-3"))
    flat = lambda df, facet: df.select(F.lit(facet).alias("facet"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), "edge_type")
    none = F.lit(None).cast("string")
    return below.select(F.lit("dependency").alias("facet"), F.col("id").alias("a"), none.alias("b"), none.alias("edge_type")).unionByName(flat(direct, "direct")).unionByName(flat(induced, "induced"))


@query("graph_subgraph", "edges", sql=with_("edges", recursive=True) + f""", {_UP}, {_DOWN.format('nat-3')}
    SELECT id FROM up UNION SELECT id FROM down""")
def _subgraph(edges):
    return graph.subgraph(edges, seeds(edges, "nat-3"))


@query("graph_impact", "nodes", "edges", sql=with_("nodes", "edges", recursive=True) + f""", {_UP}
    SELECT n.id, n.kind, EXISTS (SELECT 1 FROM edges e WHERE e.from_id = n.id AND e.to_id = 'nat-3') AS is_direct FROM nodes n JOIN up USING (id) WHERE n.id <> 'nat-3'""")
def _impact(nodes, edges):
    return nodes.select("id", "kind").join(graph.impact(edges, seeds(edges, "nat-3")), "id").select("id", "kind", "is_direct")


@query("graph_affected_tests", "edges", "artifacts", sql=with_("edges", "artifacts", recursive=True) + f", {_UP} SELECT DISTINCT path FROM artifacts WHERE node_id IN (SELECT id FROM up)")
def _affected(edges, artifacts):
    return graph.affected_tests(edges, seeds(edges, "nat-3"), artifacts)


@query("graph_counts", "nodes", "edges", sql=with_("nodes", "edges") + """
    SELECT 'node' AS what, kind AS type, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type""")
def _counts(nodes, edges):
    return nodes.groupBy(F.col("kind").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "type", "n").unionByName(
        edges.groupBy(F.col("edge_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "type", "n")
    )


@query("graph_incident", "edges", sql=with_("edges") + " SELECT from_id, to_id, edge_type FROM edges WHERE from_id = 'nat-3' OR to_id = 'nat-3'")
def _incident(edges):
    return graph.incident(edges, "nat-3")


_CANDIDATES = """candidates AS (
    SELECT to_id AS from_id, from_id AS to_id, 'calls' AS edge_type FROM edges WHERE edge_type = 'references'
    UNION SELECT from_id, to_id, edge_type FROM edges WHERE edge_type = 'depends_on'
    UNION SELECT n.id, e.to_id, 'depends_on' FROM nodes n JOIN edges e ON e.from_id = 'part-' || CAST(CAST(substr(n.id, 6) AS bigint) + 1 AS varchar) WHERE n.id LIKE 'part-%'
    UNION SELECT id, id || '-x', 'calls' FROM nodes)"""


@query("graph_validate_edges", "nodes", "edges", sql=with_("nodes", "edges", recursive=True) + f""", {_CLOSED}, {_CANDIDATES}
    SELECT c.from_id, c.to_id, c.edge_type, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN c.from_id = c.to_id OR r.src IS NOT NULL THEN 'cycle' WHEN e.from_id IS NOT NULL THEN 'duplicate'
        WHEN c.edge_type = 'depends_on' AND a.kind IN ('behavior', 'requirement') AND b.kind = 'test' THEN 'kind' ELSE 'valid' END AS reason
    FROM candidates c LEFT JOIN nodes a ON a.id = c.from_id LEFT JOIN nodes b ON b.id = c.to_id LEFT JOIN closed r ON r.src = c.to_id AND r.dst = c.from_id
    LEFT JOIN edges e ON e.from_id = c.from_id AND e.to_id = c.to_id AND e.edge_type = c.edge_type""")
def _validate(nodes, edges):
    edges = written(edges)  # read five times
    back = edges.filter("edge_type = 'references'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("calls").alias("edge_type"))
    next_part = nodes.filter("id like 'part-%'").select("id", F.concat(F.lit("part-"), (F.substring("id", 6, 20).cast("bigint") + 1).cast("string")).alias("from_id"))
    shifted = next_part.join(edges, "from_id").select(F.col("id").alias("from_id"), "to_id", F.lit("depends_on").alias("edge_type"))
    lost = nodes.select(F.col("id").alias("from_id"), F.concat("id", F.lit("-x")).alias("to_id"), F.lit("calls").alias("edge_type"))
    candidates = back.unionByName(edges.filter("edge_type = 'depends_on'")).unionByName(shifted).unionByName(lost).distinct()
    return graph.validate_edges(nodes, edges, candidates)


@query("graph_add_edges", "nodes", "edges")
def _add(nodes, edges):
    """Customers' edges propose links between nations in order of their ids; accepted ones must stay acyclic."""
    number = F.split_part("from_id", F.lit("-"), F.lit(2)).cast("bigint")
    new = edges.filter("from_id like 'cust-%'").select(
        F.col("to_id").alias("from_id"), F.concat(F.lit("nat-"), (number * 7 % 25).cast("string")).alias("to_id"), F.lit("calls").alias("edge_type"), number.alias("seq")
    )
    return graph.add_edges(nodes, edges.filter("edge_type = 'contains'"), new)


@query("store_deps", "ins", sql=with_("ins") + " SELECT DISTINCT record_uuid AS dependent_uuid, source_uuid AS dependency_uuid, dispatch, dispatch_candidates FROM ins WHERE source_uuid IS NOT NULL")
def _deps(ins):
    return store.deps(ins)


@query("store_ambiguous_dispatch", "records", "ins", sql=with_("records", "ins") + """
    SELECT r.uuid, r.function_name, r.file_path, i.name AS input_name, i.dispatch, i.source_function FROM ins i JOIN records r ON i.record_uuid = r.uuid WHERE i.dispatch <> 'direct'""")
def _ambiguous(records, ins):
    return store.ambiguous_dispatch(records, ins)


@query("store_test_coverage", "records", "test_refs", sql=with_("records", "test_refs") + """
    SELECT r.uuid, any_value(r.function_name) AS function_name, any_value(r.file_path) AS file_path, count(t.target_uuid) AS test_count, CAST(sum(CASE WHEN t.covers_error_path THEN 1 ELSE 0 END) AS bigint) AS error_path_tests
    FROM records r LEFT JOIN test_refs t ON t.target_uuid = r.uuid WHERE NOT r.is_external GROUP BY r.uuid""")
def _coverage(records, test_refs):
    return store.coverage(records, test_refs)


@query("store_nested_record", "records", "ins", "outs", sql=with_("records", "ins", "outs") + """
    SELECT r.uuid, (SELECT count(*) FROM ins i WHERE i.record_uuid = r.uuid) AS n_ins, (SELECT string_agg(name || ':' || type_str, ',' ORDER BY ordinal) FROM ins i WHERE i.record_uuid = r.uuid) AS ins,
        (SELECT string_agg(name || ':' || type_str, ',' ORDER BY ordinal) FROM outs o WHERE o.record_uuid = r.uuid) AS outs FROM records r""")
def _nested(records, ins, outs):
    flat = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["type_str"])), ","), F.lit(""))
    return store.nested(records.select("uuid"), ins.select("record_uuid", "ordinal", "name", "type_str"), outs).select("uuid", F.size("ins").cast("bigint").alias("n_ins"), flat("ins").alias("ins"), flat("outs").alias("outs"))


@query("store_by_directory", "records", sql=with_("records") + " SELECT uuid, file_path FROM records WHERE NOT is_external AND (file_path ILIKE 'db/%' OR file_path ILIKE '%/db/%')")
def _directory(records):
    return store.by_directory(records, "db/").select("uuid", "file_path")


@query("store_pending", "records", sql=with_("records") + " SELECT uuid, file_path, line_number FROM records WHERE NOT is_external AND do_description IN ('SKELETON_ONLY', 'EXTRACTION_FAILED')")
def _pending(records):
    return store.pending(records).select("uuid", "file_path", "line_number")


_STALE = "stale AS (SELECT r.uuid FROM records r JOIN current_hashes c USING (file_path) WHERE NOT r.is_external AND r.src_hash <> c.src_hash)"


@query("store_stale_direct", "records", "current_hashes", sql=with_("records", "current_hashes") + f", {_STALE} SELECT uuid FROM stale")
def _stale(records, current):
    return store.stale(records, current)


@query("store_stale_transitive", "records", "ins", "current_hashes", sql=with_("records", "ins", "current_hashes", recursive=True) + f""", {_STALE},
    walk(uuid) AS (SELECT uuid FROM stale UNION SELECT i.record_uuid FROM walk w JOIN ins i ON i.source_uuid = w.uuid) SELECT uuid FROM walk""")
def _stale_all(records, ins, current):
    return store.transitively_stale(records, ins, store.stale(records, current))


@query("store_stale_report", "records", "ins", "current_hashes", sql=with_("records", "ins", "current_hashes", recursive=True) + f""", {_STALE},
    walk(uuid) AS (SELECT uuid FROM stale UNION SELECT i.record_uuid FROM walk w JOIN ins i ON i.source_uuid = w.uuid)
    SELECT r.uuid, r.function_name, r.file_path, CASE WHEN r.uuid IN (SELECT uuid FROM stale) THEN 'direct' ELSE 'transitive' END AS marker FROM records r WHERE r.uuid IN (SELECT uuid FROM walk)""")
def _stale_report(records, ins, current):
    return store.stale_report(records, ins, current)


_RESOLVED = """calls AS (SELECT record_uuid, ordinal, source_function, source_file FROM called WHERE source = 'internal_call'), own AS (SELECT * FROM records WHERE NOT is_external),
    resolved AS (SELECT record_uuid, ordinal, coalesce((SELECT min(uuid) FROM own r WHERE r.function_name = c.source_function AND r.file_path = c.source_file), (SELECT min(uuid) FROM own r WHERE r.function_name = c.source_function)) AS found_uuid FROM calls c)"""


@query("store_resolve_names", "records", "called", sql=with_("records", "called") + f", {_RESOLVED} SELECT record_uuid, ordinal, found_uuid FROM resolved")
def _resolve(records, called):
    calls = called.filter("source = 'internal_call'").select("record_uuid", "ordinal", F.col("source_function").alias("function_name"), F.col("source_file").alias("file_path"))
    return store.resolve_names(records, calls).select("record_uuid", "ordinal", "found_uuid")


@query("store_next_calls", "records", "called", sql=with_("records", "called") + f", {_RESOLVED} SELECT DISTINCT record_uuid, found_uuid AS next_uuid FROM resolved WHERE found_uuid NOT IN (SELECT uuid FROM records WHERE do_description = 'SKELETON_ONLY')")
def _next_calls(records, called):
    """Skeletons stand for the visited records."""
    return store.next_calls(records, called, records.filter("do_description = 'SKELETON_ONLY'"))


@query("store_all_uuids", "records", sql=with_("records") + " SELECT DISTINCT uuid FROM records")
def _uuids(records):
    return store.all_uuids(records)


@query("store_by_file", "records", sql=with_("records") + " SELECT uuid, function_name, file_path FROM records WHERE NOT is_external AND file_path IN (SELECT min(file_path) FROM records GROUP BY function_name)")
def _by_file(records):
    firsts = records.groupBy("function_name").agg(F.min("file_path").alias("file_path")).select("file_path")
    return store.by_file(records, firsts).select("uuid", "function_name", "file_path")


@query("store_validate_depends_on", "records", "ins", sql=with_("records", "ins") + """, depends AS (SELECT record_uuid AS gwt_id, coalesce(source_uuid, 'fn-' || source_function) AS uid FROM ins WHERE source_uuid IS NOT NULL OR source_function IS NOT NULL)
    SELECT gwt_id, uid, CASE WHEN uid NOT IN (SELECT uuid FROM records) THEN 'UUID ' || uid || ' not found in the store \u2014 removed from depends_on' END AS warning FROM depends""")
def _depends_on(records, ins):
    uid = F.coalesce("source_uuid", F.concat(F.lit("fn-"), F.col("source_function")))
    return store.validate_depends_on(records, ins.select(F.col("record_uuid").alias("gwt_id"), uid.alias("uid")).filter("uid is not null"))


@query("graph_component_members", "nodes", "edges", sql=with_("nodes", "edges", recursive=True) + """,
    links AS (SELECT from_id AS a, to_id AS b FROM edges WHERE edge_type = 'contains' UNION SELECT to_id, from_id FROM edges WHERE edge_type = 'contains'),
    walk(id) AS (SELECT 'nat-3' UNION SELECT l.b FROM walk w JOIN links l ON w.id = l.a) SELECT id AS node_id FROM walk""")
def _members(nodes, edges):
    """The members of a nation's component along the containing edges."""
    return graph.component_members(graph.components(nodes, edges.filter("edge_type = 'contains'")), "nat-3")


for _direction, _parts in {"forward": ("f",), "reverse": ("b",), "full": ("f", "b")}.items():
    query(
        f"store_{_direction}", "records", "ins",
        sql=with_("records", "ins", recursive=True) + """,
        f(uuid) AS (SELECT uuid FROM records WHERE function_name = 'ECONOMY' UNION SELECT i.source_uuid FROM f JOIN ins i ON i.record_uuid = f.uuid WHERE i.source_uuid IS NOT NULL),
        b(uuid) AS (SELECT uuid FROM records WHERE function_name = 'ECONOMY' UNION SELECT i.record_uuid FROM b JOIN ins i ON i.source_uuid = b.uuid)
        SELECT uuid, function_name, is_external FROM records WHERE uuid IN (""" + " UNION ".join(f"SELECT uuid FROM {p}" for p in _parts) + ")",
    )(lambda records, ins, way=_direction: store.neighbourhood(records, ins, "ECONOMY", way).select("uuid", "function_name", "is_external"))


@query("store_backfill", "records", "ins", sql=with_("records", "ins") + """, first AS (SELECT function_name, min(uuid) AS found FROM records GROUP BY function_name)
    SELECT i.record_uuid, i.ordinal, CASE WHEN i.source = 'internal_call' AND i.source_uuid IS NULL THEN f.found ELSE i.source_uuid END AS source_uuid FROM ins i LEFT JOIN first f ON f.function_name = i.source_function""")
def _backfill(records, ins):
    return store.backfill(records, ins).select("record_uuid", F.col("ordinal").cast("bigint").alias("ordinal"), "source_uuid")


_OPEN = "i.source = 'internal_call' AND i.source_uuid IS NULL"


@query("store_unresolved", "records", "ins", sql=with_("records", "ins") + f"""
    SELECT r.uuid, r.function_name, r.file_path, i.name AS input_name, i.type_str, i.source_function, i.dispatch FROM ins i JOIN records r ON r.uuid = i.record_uuid WHERE {_OPEN}""")
def _unresolved(records, ins):
    return store.unresolved(records, ins)


@query("store_warnings", "records", "ins", sql=with_("records", "ins") + f"""
    SELECT r.uuid, r.function_name || ': input ''' || i.name || ''' references ''' || coalesce(i.source_function, 'None') || ''' but no matching record found' AS warning
    FROM ins i JOIN records r ON r.uuid = i.record_uuid WHERE {_OPEN}""")
def _warnings(records, ins):
    return store.completeness_warnings(records, ins)


@query("store_card", "records", "ins", "outs", sql=with_("records", "ins", "outs") + """,
    a AS (SELECT record_uuid, string_agg('- ' || name || ': ' || type_str || ' (' || source || CASE WHEN dispatch <> 'direct' THEN ' [' || dispatch || ']' ELSE '' END || ')', chr(10) ORDER BY ordinal) AS t FROM ins GROUP BY record_uuid),
    b AS (SELECT record_uuid, string_agg('- ' || name || ': ' || type_str || ' -- ' || description, chr(10) ORDER BY ordinal) AS t FROM outs GROUP BY record_uuid),
    st AS (SELECT uuid, string_agg('  ' || k || '. ' || do_steps[k], chr(10) ORDER BY k) AS t FROM (SELECT uuid, do_steps, unnest(range(1, len(do_steps) + 1)) AS k FROM records) GROUP BY uuid)
    SELECT r.uuid, '### ' || function_name || CASE WHEN coalesce(class_name, '') <> '' THEN ' (' || class_name || ')' ELSE '' END || ' @ ' || file_path || ':' || line_number || chr(10)
        || chr(10) || '**Claim:** ' || operational_claim || chr(10) || chr(10) || coalesce('**IN:**' || chr(10) || a.t || chr(10), '') || chr(10) || '**DO:** ' || do_description || coalesce(chr(10) || st.t, '')
        || coalesce(chr(10) || chr(10) || '**OUT:**' || chr(10) || b.t, '') || coalesce(chr(10) || chr(10) || '**FAILURE MODES:** ' || array_to_string(failure_modes, '; '), '') || chr(10) AS card
    FROM records r LEFT JOIN st ON st.uuid = r.uuid LEFT JOIN a ON a.record_uuid = r.uuid LEFT JOIN b ON b.record_uuid = r.uuid""")
def _cards(records, ins, outs):
    return store.cards(records, ins, outs)


@query("store_donors", "records", sql=with_("records") + """, d AS (SELECT function_name, coalesce(class_name, '') AS class_name, src_hash, min(uuid) AS donor FROM records
    WHERE NOT is_external AND do_description NOT IN ('SKELETON_ONLY', 'EXTRACTION_FAILED') GROUP BY ALL)
    SELECT r.uuid, d.donor FROM records r LEFT JOIN d ON d.function_name = r.function_name AND d.class_name = coalesce(r.class_name, '') AND d.src_hash = r.src_hash""")
def _donors(records):
    return store.content_donor(records, records.select("uuid", "function_name", "class_name", "src_hash")).select("uuid", "donor")


# The provided and expected types of the relations, normalized, compared as the type rules say.
_NORMAL = "CASE WHEN regexp_matches(lower(trim({0})), '^optional\\[.+\\]') THEN regexp_extract(lower(trim({0})), '^optional\\[(.+)\\]', 1) || ' | none' ELSE lower(trim({0})) END"
_SEAMS = f"""edge AS (SELECT DISTINCT record_uuid AS a, source_uuid AS b, dispatch AS d, dispatch_candidates AS dc FROM ins WHERE source_uuid IS NOT NULL AND source_uuid IN (SELECT uuid FROM records) AND record_uuid IN (SELECT uuid FROM records)),
    ok AS (SELECT record_uuid, arg_min(type_str, ordinal) AS t FROM outs WHERE name = 'ok' GROUP BY record_uuid),
    seam AS (SELECT e.a, e.b, e.d, e.dc, i.name, i.dispatch, i.type_str AS expected, ok.t AS provided, {_NORMAL.format('ok.t')} AS p, {_NORMAL.format('i.type_str')} AS x
        FROM edge e LEFT JOIN ins i ON i.record_uuid = e.a AND i.source_uuid = e.b AND i.source = 'internal_call' LEFT JOIN ok ON ok.record_uuid = e.b),
    judged AS (SELECT *, CASE WHEN name IS NULL THEN NULL WHEN provided IS NULL THEN 'no_ok_output'
        WHEN provided = expected OR p = x OR p = 'any' OR x = 'any' OR (contains(x, '|') AND list_contains(list_transform(string_split(x, '|'), lambda s: trim(s)), p)) THEN NULL ELSE 'type_mismatch' END AS severity FROM seam)"""


@query("seam_mismatches", "records", "ins", "outs", sql=with_("records", "ins", "outs") + f""", {_SEAMS}
    SELECT j.b AS caller_uuid, j.a AS callee_uuid, c.function_name AS caller_function, k.function_name AS callee_function, j.name AS input_name, j.expected AS expected_type, coalesce(j.provided, '') AS provided_type, j.dispatch, j.severity
    FROM judged j JOIN records c ON c.uuid = j.b JOIN records k ON k.uuid = j.a WHERE severity IS NOT NULL""")
def _mismatches(records, ins, outs):
    return contracts.seam_mismatches(records, ins, outs)


@query("seam_report", "records", "ins", "outs", sql=with_("records", "ins", "outs") + f""", {_SEAMS},
    per AS (SELECT a, b, d, dc, count(severity) AS bad FROM judged GROUP BY a, b, d, dc), o AS (SELECT count(*) AS unresolved FROM ins i JOIN records r ON r.uuid = i.record_uuid WHERE {_OPEN}),
    s AS (SELECT CAST(coalesce(sum(bad), 0) AS bigint) AS mismatches, count(*) FILTER (bad = 0) AS satisfied FROM per)
    SELECT mismatches, unresolved, satisfied, mismatches + unresolved + satisfied AS total_edges FROM s, o""")
def _report(records, ins, outs):
    return contracts.seam_report(records, ins, outs)


def _rules(df: DataFrame) -> DataFrame:
    contracts.check_rules(RULES)
    rows = [F.struct(F.lit(k).alias("rule_no"), F.lit(r["resource_type"]).alias("resource_type"), F.array(*map(F.lit, r["required_outs"])).alias("required_outs")) for k, r in enumerate(RULES)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


_REQUIRED = """need(rule_no, resource_type, required) AS (VALUES (0, 'database', 'audit_event'), (1, 'external_api', 'span_id'), (1, 'external_api', 'trace_context'),
        (2, 'external_api', 'span_id'), (2, 'external_api', 'trace_context'), (3, 'message_queue', 'trace_context')),
    edge AS (SELECT DISTINCT record_uuid AS a, source_uuid AS b, dispatch AS d, dispatch_candidates AS dc FROM ins WHERE source_uuid IS NOT NULL),
    met AS (SELECT e.*, r.function_name AS callee_function, q.function_name AS caller_function, n.resource_type, n.required,
            EXISTS (SELECT 1 FROM outs o WHERE o.record_uuid = e.b AND (o.type_str = n.required OR o.description = n.required)) AS has
        FROM edge e JOIN records r ON r.uuid = e.b JOIN records q ON q.uuid = e.a
        JOIN need n ON (n.resource_type = 'external_api' AND r.is_external) OR (n.resource_type = 'database' AND (contains(lower(r.file_path), '/db/') OR contains(lower(r.file_path), '_store.'))))"""


@query("contract_violations", "records", "ins", "outs", sql=with_("records", "ins", "outs") + f""", {_REQUIRED}
    SELECT resource_type AS rule_resource_type, b AS callee_uuid, callee_function, required AS missing_contract, a AS caller_uuid, caller_function FROM met WHERE NOT has""")
def _violations(records, ins, outs):
    return contracts.contract_violations(records, ins, outs, _rules(records))


@query("contract_summary", "records", "ins", "outs", sql=with_("records", "ins", "outs") + f""", {_REQUIRED}, per AS (SELECT a, b, d, dc, count(*) FILTER (NOT has) AS bad FROM met GROUP BY a, b, d, dc),
    s AS (SELECT CAST(coalesce(sum(bad), 0) AS bigint) AS violations, count(*) FILTER (bad = 0) AS satisfied FROM per) SELECT violations, satisfied, violations + satisfied AS total_checked FROM s""")
def _summary(records, ins, outs):
    return contracts.contract_summary(records, ins, outs, _rules(records))


_STATUS = """tried AS (SELECT gwt_id, count(*) AS n FROM attempts GROUP BY gwt_id),
    state AS (SELECT i.gwt_id, CASE WHEN r.gwt_id IS NOT NULL THEN coalesce(r.result, 'fail') WHEN t.n > 0 THEN 'in_progress' ELSE 'pending' END AS status,
        coalesce(CASE WHEN r.gwt_id IS NOT NULL THEN r.attempts ELSE t.n END, 0) AS attempts, b.gwt_id IS NOT NULL AS bridged
        FROM items i LEFT JOIN results r USING (gwt_id) LEFT JOIN tried t USING (gwt_id) LEFT JOIN bridged b USING (gwt_id))"""
_STATUS_RELATIONS = ("items", "results", "attempts", "bridged")


@query("status_per_item", *_STATUS_RELATIONS, sql=with_(*_STATUS_RELATIONS) + f", {_STATUS} SELECT * FROM state")
def _per_item(items, results, attempts, bridged):
    return status.item_status(items, results, attempts, bridged)


@query("status_rollup", *_STATUS_RELATIONS, sql=with_(*_STATUS_RELATIONS) + f""", {_STATUS} SELECT count(*) FILTER (status = 'pass') AS verified, count(*) FILTER (status = 'fail') AS failed,
    count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status NOT IN ('pass', 'fail', 'in_progress')) AS pending, count(*) FILTER (bridged) AS bridge_complete, count(*) AS total FROM state""")
def _rollup(items, results, attempts, bridged):
    return status.roll_up(status.item_status(items, results, attempts, bridged))


_VERDICTS = with_("traces") + """, said AS (SELECT trace_id, CASE label WHEN 'error' THEN CASE WHEN state_num % 3 = 0 THEN '1 failure' ELSE 'see above' END WHEN 'view' THEN CASE WHEN state_num % 7 = 0 THEN 'Warning: slow' ELSE 'nothing' END WHEN 'click' THEN 'all passed' ELSE label END AS t FROM traces WHERE var = 'kind'),
    v AS (SELECT trace_id AS g, contains(upper(t), 'FAIL') OR contains(upper(t), 'CRITICAL') AS f, contains(upper(t), 'WARNING') AS w FROM said)
    SELECT g AS "group", CASE WHEN bool_or(f) THEN 'fail' WHEN bool_or(w) THEN 'warning' ELSE 'pass' END AS verdict, count(*) AS reviews, CASE WHEN bool_or(f) THEN 1 ELSE 0 END AS exit_code FROM v GROUP BY g"""


@query("verdict_rollup", "traces", sql=_VERDICTS)
def _verdicts(traces):
    """Verdicts over the states of every number."""
    label, n = F.col("label"), F.col("state_num")
    said = (
        F.when(label == "error", F.when(n % 3 == 0, "1 failure").otherwise("see above")).when(label == "view", F.when(n % 7 == 0, "Warning: slow").otherwise("nothing"))
        .when(label == "click", "all passed").otherwise(label)
    )
    return status.verdicts(traces.filter("var = 'kind'").select(F.col("trace_id").alias("group"), said.alias("text")))


@query("verdict_rollup_all", "traces", sql=with_("traces") + """, said AS (SELECT trace_id, CASE label WHEN 'error' THEN '1 failure' WHEN 'view' THEN 'Warning: slow' WHEN 'click' THEN 'all passed' ELSE label END AS t FROM traces WHERE var = 'kind'),
    v AS (SELECT trace_id AS g, contains(upper(t), 'FAIL') OR contains(upper(t), 'CRITICAL') AS f, contains(upper(t), 'WARNING') AS w FROM said)
    SELECT g AS "group", CASE WHEN bool_or(f) THEN 'fail' WHEN bool_or(w) THEN 'warning' ELSE 'pass' END AS verdict, count(*) AS reviews, CASE WHEN bool_or(f) THEN 1 ELSE 0 END AS exit_code FROM v GROUP BY g""")
def _all_verdicts(traces):
    """Verdicts where the error and view states of every number say what they are."""
    label = F.col("label")
    said = F.when(label == "error", "1 failure").when(label == "view", "Warning: slow").when(label == "click", "all passed").otherwise(label)
    return status.verdicts(traces.filter("var = 'kind'").select(F.col("trace_id").alias("group"), said.alias("text")))


@query("ids_next", "items", sql=with_("items") + " SELECT 'gwt' AS prefix, 'gwt-' || lpad(CAST(max(CAST(split_part(gwt_id, '-', 2) AS bigint)) + 1 AS varchar), 4, '0') AS next_id FROM items UNION ALL SELECT 'req', 'req-0001'")
def _next(items):
    return graph.next_ids(items.withColumnRenamed("gwt_id", "id"))


@query("ids_uuid5", "records", sql=with_("records") + """, h AS (SELECT uuid, sha1(unhex('f47ac10b58cc4372a5670e02b2c3d479') || encode(file_path || '::' || coalesce(class_name, '') || '::' || function_name)) AS d FROM records)
    SELECT uuid, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || CASE WHEN substr(d, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(d, 17, 1) IN ('1', '5', '9', 'd') THEN '9'
        WHEN substr(d, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS record_id FROM h""")
def _uuid5(records):
    return records.select("uuid", exprs.record_uuid(F.col("file_path"), F.col("class_name"), F.col("function_name")).alias("record_id"))


@query("text_slug", "nodes", sql=with_("nodes") + " SELECT id, regexp_replace(left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40), '_+$', '') AS slug FROM nodes")
def _slug(nodes):
    return nodes.select("id", exprs.slug(F.col("name")).alias("slug"))


@query("text_directories", "records", sql=with_("records") + """, p AS (SELECT DISTINCT string_split(file_path, '/') AS s FROM records), a AS (SELECT array_to_string(s[1:n], '/') AS directory FROM (SELECT s, unnest(range(1, len(s))) AS n FROM p))
    SELECT directory, count(*) AS files FROM a GROUP BY directory""")
def _directories(records):
    return text.directories(records)


@query("text_mentions", "records", sql=with_("records") + """ SELECT uuid, CASE line_number % 4 WHEN 1 THEN '' WHEN 3 THEN NULL ELSE function_name END AS functions, CASE line_number % 4 WHEN 1 THEN '' WHEN 3 THEN NULL ELSE file_path END AS files,
    CASE line_number % 4 WHEN 0 THEN 'src/db/,lib/core' WHEN 1 THEN regexp_replace(file_path, '[.]py$', '') WHEN 2 THEN file_path || '.bak' END AS directories FROM records""")
def _mentions(records):
    """Prose with marks and quotes, with paths that go on, and without any."""
    how, f, p = F.col("line_number") % 4, F.col("function_name"), F.col("file_path")
    said = (
        F.when(how == 0, F.concat(F.lit("Call "), f, F.lit("() of "), p, F.lit(", in 'src/db/' or lib/core"))).when(how == 1, F.concat(F.lit("Nothing: "), f, F.lit(" () and "), p, F.lit("!")))
        .when(how == 2, F.concat(F.lit('"'), p, F.lit('" and '), p, F.lit(".bak; "), f, F.lit("()()")))
    )
    return records.select("uuid", text.mentions(said).alias("m")).select("uuid", *[F.array_join(F.col("m")[c], ",").alias(c) for c in ("functions", "files", "directories")])


@query("text_json", "nodes", sql=with_("nodes") + """ SELECT id, CASE kind WHEN 'resource' THEN '{"id": "' || id || '", "n": {"k": "}"}}' WHEN 'behavior' THEN '{"a": [1, {"b": "' || id || '"}]}' WHEN 'test' THEN '{}' END AS object FROM nodes""")
def _json(nodes):
    """Objects after broken ones, with lists, empty, unclosed, and none."""
    kind = F.col("kind")
    prose = (
        F.when(kind == "resource", F.concat(F.lit("Sure: {no json} then {\"id\": \""), "id", F.lit("\", \"n\": {\"k\": \"}\"}} and {\"x\": 2}")))
        .when(kind == "behavior", F.concat(F.lit("{'a': 1} {\"a\": [1, {\"b\": \""), "id", F.lit("\"}]} tail"))).when(kind == "test", F.concat(F.lit("so {} "), "id"))
        .when(kind == "requirement", F.concat(F.lit("only {"), "id", F.lit("} here"))).otherwise(F.when(F.col("id").startswith("supp"), F.lit('{"open": {"x": 1}')))
    )
    return nodes.select("id", text.first_object(prose).alias("object"))


@query("trace_diff", "traces", sql=with_("traces") + """ SELECT trace_id, state_num, label, var, before, value FROM (SELECT *, lag(value) OVER (PARTITION BY trace_id, var ORDER BY state_num) AS before FROM traces) WHERE before IS NULL OR before <> value""")
def _diff(traces):
    return text.trace_diff(traces).withColumn("state_num", F.col("state_num").cast("bigint"))


@query("trace_summary", "traces", sql=with_("traces") + """, s AS (SELECT DISTINCT trace_id, state_num, label FROM traces)
    SELECT trace_id, count(*) AS step_count, arg_min(label, state_num) AS first_label, arg_max(label, state_num) AS last_label, coalesce(string_agg(label, ',' ORDER BY state_num) FILTER (state_num > 1), '') AS actions FROM s GROUP BY trace_id""")
def _trace_summary(traces):
    return text.trace_summary(traces)


_SKELETONS = """skeletons AS (SELECT CASE WHEN line_number % 3 = 0 THEN uuid || '-new' ELSE uuid END AS uuid, function_name, class_name, CASE WHEN line_number % 5 = 0 THEN 'changed' ELSE src_hash END AS src_hash FROM records)"""


@query("ingest_disposition", "records", sql=with_("records") + f""", {_SKELETONS}, d AS (SELECT function_name, coalesce(class_name, '') AS class_name, src_hash, min(uuid) AS donor FROM records
    WHERE NOT is_external AND do_description NOT IN ('SKELETON_ONLY', 'EXTRACTION_FAILED') GROUP BY ALL),
    j AS (SELECT s.uuid, s.src_hash, r.uuid AS had, r.src_hash AS old, CASE WHEN d.donor <> s.uuid THEN d.donor END AS donor FROM skeletons s LEFT JOIN records r ON r.uuid = s.uuid
        LEFT JOIN d ON d.function_name = s.function_name AND d.class_name = coalesce(s.class_name, '') AND d.src_hash = s.src_hash)
    SELECT uuid, CASE WHEN old = src_hash THEN 'skipped' WHEN had IS NOT NULL THEN 'updated' WHEN donor IS NOT NULL THEN 'adopted' ELSE 'created' END AS disposition, CASE WHEN old = src_hash THEN NULL ELSE donor END AS donor FROM j""")
def _disposition(records):
    skeletons = records.select(
        F.when(F.col("line_number") % 3 == 0, F.concat("uuid", F.lit("-new"))).otherwise(F.col("uuid")).alias("uuid"), "function_name", "class_name",
        F.when(F.col("line_number") % 5 == 0, "changed").otherwise(F.col("src_hash")).alias("src_hash"),
    )
    return status.ingest_disposition(skeletons, records)


@query("ingest_counts", "records", sql=f"SELECT count(*) FILTER (disposition = 'created') AS created, count(*) FILTER (disposition = 'updated') AS updated, count(*) FILTER (disposition = 'skipped') AS skipped, count(*) FILTER (disposition = 'failed') AS failed, count(*) FILTER (disposition = 'adopted') AS adopted FROM ({SQL['ingest_disposition']})")
def _ingest_counts(records):
    return status.ingest_counts(_disposition(records))


@query("store_exploded", "records", "ins", sql=with_("records", "ins") + " SELECT record_uuid, ordinal, name, type_str FROM ins WHERE record_uuid IN (SELECT uuid FROM records)")
def _exploded(records, ins):
    """Nested records back to numbered children."""
    nested = store.nested(records.select("uuid"), ins.select("record_uuid", "ordinal", "name", "type_str"), ins.select("record_uuid", "ordinal"))
    return store.exploded(nested.withColumn("ins", F.transform("ins", lambda x: F.struct(x["name"].alias("name"), x["type_str"].alias("type_str")))), "ins")


_DONORS = "donors AS (SELECT min(uuid) AS uuid FROM records GROUP BY function_name)"


@query("store_adopt_donors", "records", "ins", "outs", "test_refs", sql=with_("records", "ins", "outs", "test_refs") + f""", {_DONORS}
    SELECT 'record' AS what, uuid AS a, NULL AS b FROM records WHERE uuid NOT IN (SELECT uuid FROM donors)
    UNION ALL SELECT 'in', record_uuid, CASE WHEN source_uuid IN (SELECT uuid FROM donors) THEN NULL ELSE source_uuid END FROM ins WHERE record_uuid NOT IN (SELECT uuid FROM donors)
    UNION ALL SELECT 'out', record_uuid, name FROM outs WHERE record_uuid NOT IN (SELECT uuid FROM donors)
    UNION ALL SELECT 'test', target_uuid, NULL FROM test_refs WHERE target_uuid NOT IN (SELECT uuid FROM donors)
    UNION ALL SELECT 'map', record_uuid, name FROM outs WHERE record_uuid NOT IN (SELECT uuid FROM donors)
    UNION ALL SELECT 'entry', name, CASE WHEN record_uuid IN (SELECT uuid FROM donors) THEN NULL ELSE record_uuid END FROM outs""")
def _adopt(records, ins, outs, test_refs):
    """The first record of each name is adopted away; outputs stand for maps and entry points, too."""
    donors = records.groupBy("function_name").agg(F.min("uuid").alias("uuid"))
    tables = store.adopt_donors(donors, records, ins, outs, test_refs, outs.withColumnRenamed("record_uuid", "entry_uuid"), outs)
    none, found = F.lit(None).cast("string"), None
    for df, what, a, b in zip(tables, ("record", "in", "out", "test", "map", "entry"), ("uuid", "record_uuid", "record_uuid", "target_uuid", "entry_uuid", "name"), (None, "source_uuid", "name", None, "name", "record_uuid")):
        rows = df.select(F.lit(what).alias("what"), F.col(a).alias("a"), (F.col(b) if b else none).alias("b"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("store_relevant", "records", "ins", sql=with_("records", "ins", recursive=True) + """,
    hit AS (SELECT uuid, function_name FROM records r WHERE NOT is_external AND (function_name = 'ECONOMY' OR file_path ILIKE 'db/%' OR file_path ILIKE '%/db/%'
        OR EXISTS (SELECT 1 FROM (SELECT min(file_path) AS p FROM records GROUP BY class_name) m WHERE r.file_path = substr(m.p, instr(m.p, '/') + 1) OR ends_with(r.file_path, '/' || substr(m.p, instr(m.p, '/') + 1))))),
    f(uuid) AS (SELECT uuid FROM records WHERE function_name IN (SELECT function_name FROM hit) UNION SELECT i.source_uuid FROM f JOIN ins i ON i.record_uuid = f.uuid WHERE i.source_uuid IS NOT NULL)
    SELECT uuid, function_name, file_path FROM records WHERE uuid IN (SELECT uuid FROM f)""")
def _relevant_records(records, ins):
    """Mentions of a function, of a folder, and of the ends of each class's first path."""
    files = records.groupBy("class_name").agg(F.min("file_path").alias("p")).select(F.expr("substr(p, instr(p, '/') + 1)").alias("path"))
    functions, folders = seeds(records, "ECONOMY").withColumnRenamed("id", "function_name"), seeds(records, "db/").withColumnRenamed("id", "directory")
    return store.relevant_records(records, ins, functions, files, folders).select("uuid", "function_name", "file_path")


_UUID5 = """substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || CASE WHEN substr(d, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(d, 17, 1) IN ('1', '5', '9', 'd') THEN '9'
        WHEN substr(d, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(d, 18, 3) || '-' || substr(d, 21, 12)"""


@query("store_external_records", "records", "ins", sql=with_("records", "ins") + f""", calls AS (SELECT DISTINCT source_function AS f, CASE WHEN ordinal % 2 = 0 THEN type_str || '.py' END AS file FROM ins WHERE source = 'parameter' AND source_function IS NOT NULL),
    h AS (SELECT *, sha1(unhex('f47ac10b58cc4372a5670e02b2c3d479') || encode(coalesce(file, 'external') || '::::' || f)) AS d FROM calls)
    SELECT {_UUID5} AS uuid, f AS function_name, coalesce(file, 'external') AS file_path, split_part(coalesce(file, f), '.', 1) AS source_crate, 'External call to ' || f AS boundary_contract FROM h""")
def _external(records, ins):
    """Inputs given as parameters stand for external ones; every other one names its file."""
    calls = ins.filter("source = 'parameter'").withColumns({"source": F.lit("external"), "source_file": F.when(F.col("ordinal") % 2 == 0, F.concat("type_str", F.lit(".py")))})
    return store.external_records(calls, records).drop("src_hash")


_BUNDLE = """shown AS (SELECT id, CASE kind WHEN 'module' THEN 'spec' ELSE kind END AS kind, name, CASE WHEN kind = 'module' THEN 'templates/' || id WHEN name LIKE '%widget%' THEN id || '.tla' ELSE id || '.json' END AS path, 'schema-' || name AS schema FROM nodes)"""


@query("graph_context", "nodes", "edges", "records", "ins", "outs", sql=with_("nodes", "edges", recursive=True) + f""", {_UP}, {_BUNDLE}, below AS (SELECT * FROM shown WHERE id IN (SELECT id FROM up) AND id <> 'nat-3')
    SELECT 'dependency' AS facet, id, name AS value FROM below UNION ALL SELECT 'template', id, path FROM below WHERE kind = 'spec' UNION ALL SELECT 'schema', id, schema FROM below WHERE kind = 'resource'
    UNION ALL SELECT 'existing_spec', id, path FROM below WHERE kind = 'resource' AND path LIKE '%.tla' UNION ALL SELECT 'card', uuid, card FROM ({SQL['store_card']}) WHERE uuid IN (SELECT id FROM below)
    UNION ALL SELECT 'edge', to_id, edge_type || ' ' || from_id FROM edges WHERE from_id IN (SELECT id FROM up) AND to_id IN (SELECT id FROM up)""")
def _context(nodes, edges, records, ins, outs):
    """What a nation needs when every edge is read the other way; modules stand for specs."""
    kind = F.col("kind")
    path = F.when(kind == "module", F.concat(F.lit("templates/"), "id")).when(F.col("name").contains("widget"), F.concat("id", F.lit(".tla"))).otherwise(F.concat("id", F.lit(".json")))
    shown = nodes.select("id", F.when(kind == "module", "spec").otherwise(kind).alias("kind"), "name", path.alias("path"), F.concat(F.lit("schema-"), "name").alias("schema"))
    back = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "edge_type")
    return graph.context(shown, back, store.cards(records, ins, outs), seeds(edges, "nat-3"))


_SHAPED = "regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@query("graph_bridge_nodes", "nodes", "records", sql=with_("nodes", "records") + f""", crawled AS (SELECT *, {_SHAPED.format('uuid')} AS u FROM records),
    had AS (SELECT CASE WHEN id LIKE 'part-%' OR id LIKE 'supp-%' THEN {_SHAPED.format('id')} ELSE id END AS id, CASE WHEN id LIKE 'part-%' OR id LIKE 'supp-%' THEN 'resource' ELSE kind END AS kind, name, id LIKE 'supp-%' AS lost FROM nodes)
    SELECT u AS id, 'resource' AS kind, CASE WHEN coalesce(class_name, '') <> '' THEN class_name || '.' ELSE '' END || function_name || ' @ ' || file_path AS name, operational_claim AS description FROM crawled WHERE NOT is_external
    UNION ALL SELECT id, kind, name, 'was ' || name FROM had WHERE NOT lost AND id NOT IN (SELECT u FROM crawled WHERE NOT is_external)""")
def _bridge(nodes, records):
    """Parts and suppliers stand for nodes of an earlier crawl; the suppliers' records are gone."""
    return graph.bridge_nodes(_earlier(nodes), records.withColumn("uuid", _shaped("uuid")))


def _shaped(c):
    h = F.md5(c)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def _earlier(nodes: DataFrame) -> DataFrame:
    crawled = F.col("id").like("part-%") | F.col("id").like("supp-%")
    return nodes.select(F.when(crawled, _shaped("id")).otherwise(F.col("id")).alias("id"), F.when(crawled, "resource").otherwise(F.col("kind")).alias("kind"), "name", F.concat(F.lit("was "), "name").alias("description"))


def _bridged(nodes, edges, records, ins):
    """The whole bridge over crawled ids; the graph's own edges but for those of lines stand for edges of an earlier crawl."""
    shape = lambda c: F.when(F.col(c).like("part-%") | F.col(c).like("supp-%"), _shaped(c)).otherwise(F.col(c)).alias(c)
    had = edges.filter("edge_type <> 'depends_on'").select(shape("from_id"), shape("to_id"), "edge_type")
    return graph.bridge(_earlier(nodes), had, records.withColumn("uuid", _shaped("uuid")), store.deps(ins).withColumns({"dependent_uuid": _shaped("dependent_uuid"), "dependency_uuid": _shaped("dependency_uuid")}))


@query("graph_bridge_edges", "nodes", "edges", "records", "ins")
def _bridge_edges(nodes, edges, records, ins):
    """The edges after the bridge; no SQL, as which edge of a cycle goes depends on their order."""
    return _bridged(nodes, edges, records, ins)[1]


@query("graph_bridge_counters", "nodes", "edges", "records", "ins")
def _bridge_counters(nodes, edges, records, ins):
    return _bridged(nodes, edges, records, ins)[2]


@query("graph_strong_sets", "ins", sql=with_("ins", recursive=True) + """, dep AS (SELECT DISTINCT record_uuid AS a, source_uuid AS b FROM ins WHERE source_uuid IS NOT NULL),
    closed(a, b) AS (SELECT a, b FROM dep UNION SELECT c.a, d.b FROM closed c JOIN dep d ON c.b = d.a)
    SELECT x.a AS node, min(x.b) AS part FROM closed x JOIN closed y ON x.a = y.b AND x.b = y.a WHERE x.a IN (SELECT p.a FROM closed p JOIN closed q ON p.a = q.b AND p.b = q.a WHERE p.a <> p.b) GROUP BY x.a""")
def _strong(ins):
    """Records that need one another."""
    return strong.strong_sets(store.deps(ins), "dependent_uuid", "dependency_uuid")


@query("graph_module_nodes", "nodes", sql=with_("nodes") + " SELECT id, name FROM nodes WHERE contains(lower(name), 'widget') OR contains(id, 'supp-1')")
def _module(nodes):
    return graph.module_nodes(nodes.withColumn("path", F.col("id")), "Widget", "supp-1").select("id", "name")


@query("graph_change", "nodes", "edges", sql=with_("nodes", "edges") + """, n AS (SELECT count(*) AS n, count(*) FILTER (kind = 'module') AS d FROM nodes), e AS (SELECT count(*) AS n, -count(*) AS d FROM edges)
    SELECT 'nodes' AS what, n, CASE WHEN d > 0 THEN '+' ELSE '' END || d AS change FROM n UNION ALL SELECT 'edges', n, CASE WHEN d > 0 THEN '+' ELSE '' END || d FROM e""")
def _change(nodes, edges):
    """Before: no modules, and every edge twice."""
    return graph.change((nodes.filter("kind <> 'module'"), edges.unionByName(edges)), (nodes, edges))


@query("seam_lines", "records", "ins", "outs", sql=with_("records", "ins", "outs") + f""", {_SEAMS}
    SELECT 'mismatch' AS section, '  ' || c.function_name || '() -> ' || k.function_name || '().' || j.name || chr(10) || '    provides: ' || coalesce(j.provided, '') || ', expects: ' || j.expected AS text
    FROM judged j JOIN records c ON c.uuid = j.b JOIN records k ON k.uuid = j.a WHERE severity IS NOT NULL
    UNION ALL SELECT 'unresolved', '  ' || r.function_name || '().' || i.name || ': ' || i.type_str FROM ins i JOIN records r ON r.uuid = i.record_uuid WHERE {_OPEN}""")
def _seam_lines(records, ins, outs):
    return contracts.seam_lines(contracts.seam_mismatches(records, ins, outs), store.unresolved(records, ins)).select("section", "text")


@query("violation_lines", "records", "ins", "outs", sql=with_("records", "ins", "outs") + f""", {_REQUIRED}
    SELECT '  ' || caller_function || '() -> ' || callee_function || '(): missing ' || required || ' (rule: ' || resource_type || ')' AS text,
        CAST(to_json({{'rule_resource_type': resource_type, 'callee_uuid': b, 'callee_function': callee_function, 'missing_contract': required, 'caller_uuid': a, 'caller_function': caller_function}}) AS varchar) AS json FROM met WHERE NOT has""")
def _violation_lines(records, ins, outs):
    return contracts.violation_lines(contracts.contract_violations(records, ins, outs, _rules(records)))


@query("crawl_summary", "traces", sql=with_("traces") + """, d AS (SELECT CASE label WHEN 'click' THEN 'extracted' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'ax' END AS outcome, state_num + 0.25 AS seconds FROM traces WHERE var = 'kind'),
    s AS (SELECT count(*) FILTER (outcome = 'extracted') AS extracted, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'ax') AS ax, CAST(0 AS bigint) AS retries, CAST(sum(seconds) AS double) AS t FROM d)
    SELECT extracted, failed, skipped, ax, retries, CASE WHEN t < 60 THEN printf('%.1fs', t) WHEN t < 3600 THEN printf('%dm%04.1fs', CAST(floor(t / 60) AS bigint), t - 60 * floor(t / 60)) ELSE printf('%dh%02dm', CAST(floor(t / 3600) AS bigint), CAST(floor(t / 60) AS bigint) % 60) END AS elapsed, CASE WHEN extracted > 0 THEN t / extracted END AS average FROM s""")
def _crawl_summary(traces):
    label = F.col("label")
    outcome = F.when(label == "click", "extracted").when(label == "error", "failed").when(label == "view", "skipped").otherwise("ax")
    return status.crawl_summary(traces.filter("var = 'kind'").select(outcome.alias("outcome"), (F.col("state_num") + 0.25).cast("double").alias("seconds")))


@query("text_module_name", "nodes", sql=with_("nodes") + """, w AS (SELECT id, string_split(trim(regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g'), '_'), '_') AS w FROM nodes),
    j AS (SELECT id, array_to_string(list_transform(w, lambda x: upper(x[1:1]) || x[2:]), '') AS m FROM w) SELECT id, CASE WHEN m <> '' THEN m ELSE replace(id, '-', '_') END AS module FROM j""")
def _module_name(nodes):
    return nodes.select("id", exprs.module_name(F.col("name"), F.col("id")).alias("module"))


@query("trace_flat", "traces", sql=with_("traces") + """, s AS (SELECT trace_id, state_num, string_agg(var || '=' || value, ',' ORDER BY var) AS v FROM traces GROUP BY trace_id, state_num), bad AS (SELECT DISTINCT trace_id FROM traces WHERE label = 'error')
    SELECT trace_id, CASE WHEN trace_id IN (SELECT trace_id FROM bad) THEN string_agg(v, ';' ORDER BY state_num) END AS states FROM s GROUP BY trace_id""")
def _flat(traces):
    """Traces with an error violate an invariant; the others give none."""
    states = traces.groupBy("trace_id", "state_num").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("var", "value")))).alias("vars"), F.max(F.col("label") == "error").alias("bad"))
    whole = states.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("state_num", F.map_entries("vars").alias("vars")))).alias("s"), F.when(F.max("bad"), "NoError").alias("invariant"))
    one = lambda v: F.array_join(F.transform(v, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return whole.select("trace_id", F.array_join(F.transform(exprs.flat_trace(F.col("s"), F.col("invariant")), one), ";").alias("states"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


from depweave.plans import extraction, runs  # noqa: E402, F401  (they register their queries here)
