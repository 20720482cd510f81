"""The engine's relations as projections of the driver tables (one SQL text each, valid in Spark and DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depweave.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

RELATIONS: dict[str, str] = {
    "edges": """
        SELECT DISTINCT 'part-' || l_partkey AS from_id, 'supp-' || l_suppkey AS to_id, 'depends_on' AS edge_type FROM lineitem
        UNION ALL SELECT 'supp-' || s_suppkey, 'nat-' || s_nationkey, 'references' FROM supplier
        UNION ALL SELECT 'cust-' || c_custkey, 'nat-' || c_nationkey, 'references' FROM customer
        UNION ALL SELECT 'nat-' || n_nationkey, 'reg-' || n_regionkey, 'contains' FROM nation""",
    "nodes": """
        SELECT 'part-' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'resource' WHEN 1 THEN 'behavior' ELSE 'requirement' END AS kind, p_name AS name FROM part
        UNION ALL SELECT 'supp-' || s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'test' ELSE 'module' END, s_name FROM supplier
        UNION ALL SELECT 'cust-' || c_custkey, 'behavior', c_name FROM customer
        UNION ALL SELECT 'nat-' || n_nationkey, 'module', n_name FROM nation
        UNION ALL SELECT 'reg-' || r_regionkey, 'module', r_name FROM region""",
    "artifacts": """
        SELECT 'part-' || p_partkey AS node_id, CASE p_partkey % 5 WHEN 0 THEN 'tests/test_part_' || (p_partkey % 97) ELSE 'tests/parts/test_' || (p_partkey % 997) END || '.py' AS path FROM part
        UNION ALL SELECT 'supp-' || s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'tests/test_supplier_' ELSE 'tests/suppliers/test_' END || s_suppkey || '.py' FROM supplier""",
    "records": """
        SELECT 'part-' || p_partkey AS uuid, p_type AS function_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS class_name,
            CASE p_partkey % 5 WHEN 0 THEN 'src/db/' WHEN 1 THEN 'src/api/' WHEN 2 THEN 'lib/core/' ELSE 'src/' END || replace(p_name, ' ', '/') || CASE p_partkey % 7 WHEN 0 THEN '_store.py' ELSE '.py' END AS file_path,
            p_size AS line_number, p_size > 40 AS is_external, md5(p_name) AS src_hash,
            CASE p_partkey % 6 WHEN 0 THEN 'SKELETON_ONLY' WHEN 1 THEN 'EXTRACTION_FAILED' ELSE 'makes ' || p_name END AS do_description, 'claims ' || p_type AS operational_claim,
            CASE p_partkey % 3 WHEN 0 THEN NULL ELSE split(p_name || ' of ' || p_brand, ' of ') END AS do_steps, CASE p_partkey % 4 WHEN 1 THEN split('no ' || p_type || ';late', ';') WHEN 2 THEN split('late', ';') END AS failure_modes
        FROM part""",
    "ins": """
        SELECT 'part-' || l_partkey AS record_uuid,
            row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS ordinal,
            'in' || l_linenumber AS name, CASE l_returnflag WHEN 'A' THEN 'Optional[str]' WHEN 'N' THEN 'str | None' ELSE 'int' END AS type_str,
            CASE l_linenumber % 3 WHEN 0 THEN 'parameter' ELSE 'internal_call' END AS source,
            CASE WHEN l_linenumber % 2 = 0 THEN 'part-' || l_suppkey ELSE NULL END AS source_uuid,
            CASE l_orderkey % 4 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'nowhere' ELSE NULL END AS source_function,
            CASE l_linenumber % 5 WHEN 0 THEN 'attribute' WHEN 1 THEN 'override' ELSE 'direct' END AS dispatch,
            CASE WHEN l_linenumber % 5 < 2 THEN 'impl' || (l_orderkey % 3) END AS dispatch_candidates
        FROM lineitem""",
    "called": """
        SELECT i.*, CASE WHEN i.ordinal % 3 = 0 THEN r.file_path WHEN i.ordinal % 3 = 1 THEN 'nowhere.py' END AS source_file FROM ({ins}) i LEFT JOIN ({records}) r ON r.uuid = i.source_uuid""",
    "outs": """
        SELECT 'part-' || p_partkey AS record_uuid, 0 AS ordinal, CASE p_partkey % 4 WHEN 0 THEN 'err' WHEN 1 THEN 'side_effect' ELSE 'ok' END AS name,
            CASE p_size % 4 WHEN 0 THEN 'str' WHEN 1 THEN 'int' WHEN 2 THEN 'Any' ELSE 'audit_event' END AS type_str,
            CASE p_partkey % 3 WHEN 0 THEN 'span_id' WHEN 1 THEN 'trace_context' ELSE 'value' END AS description FROM part
        UNION ALL SELECT 'part-' || p_partkey, 1, CASE p_partkey % 3 WHEN 0 THEN 'ok' ELSE 'mutation' END,
            CASE p_size % 3 WHEN 0 THEN 'None | str' WHEN 1 THEN 'INT' ELSE 'dict[str, Any]' END, CASE p_size % 2 WHEN 0 THEN 'audit_event' ELSE 'trace_context' END FROM part WHERE p_partkey % 2 = 0""",
    "test_refs": """
        SELECT CASE o_orderkey % 3 WHEN 0 THEN 'part-' || (o_orderkey % 1500) WHEN 1 THEN 'part-' || (o_custkey % 500) ELSE 'gone-' || o_custkey END AS target_uuid, o_orderstatus = 'F' AS covers_error_path FROM orders""",
    "current_hashes": """
        SELECT CASE WHEN min(line_number) % 7 = 0 THEN file_path || '.moved' ELSE file_path END AS file_path, CASE WHEN min(line_number) % 4 = 0 THEN 'changed' ELSE min(src_hash) END AS src_hash FROM ({records}) GROUP BY file_path""",
    "results": """
        SELECT CASE user_id % 2 WHEN 0 THEN 'gwt-' ELSE 'other-' END || user_id AS gwt_id, CASE event_type WHEN 'error' THEN 'fail' WHEN 'click' THEN 'pass' WHEN 'view' THEN NULL ELSE event_type END AS result, cast(floor(value) AS bigint) AS attempts
        FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
    "items": """SELECT DISTINCT 'gwt-' || user_id AS gwt_id FROM events""",
    "attempts": """SELECT CASE WHEN user_id % 3 <> 0 AND event_type = 'click' THEN 'gwt-' ELSE 'other-' END || user_id AS gwt_id, event_id FROM events""",
    "bridged": """SELECT DISTINCT 'gwt-' || user_id AS gwt_id FROM events WHERE event_type = 'purchase'""",
    "traces": """
        SELECT user_id AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS state_num, event_type AS label, 'kind' AS var, event_type AS value FROM events
        UNION ALL SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), event_type, 'level', CASE WHEN value < 10 THEN 'low' ELSE 'high' END FROM events""",
    "functions": """
        SELECT 'part-' || p_partkey AS uuid, 'fn_' || cast(floor(p_partkey / 2) AS bigint) AS function_name, cast(NULL AS varchar(10)) AS class_name, 'src/m' || (p_partkey % 50) || '.py' AS file_path, p_size AS line_number,
            p_size > 45 AS is_external, md5('m' || (p_partkey % 50)) AS src_hash, CASE p_partkey % 4 WHEN 0 THEN 'SKELETON_ONLY' WHEN 1 THEN 'EXTRACTION_FAILED' ELSE 'makes ' || p_name END AS do_description
        FROM part""",
    "invocations": """
        SELECT 'part-' || l_partkey AS record_uuid,
            row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS ordinal,
            CASE WHEN l_quantity < 6 THEN 'internal_call' WHEN l_quantity < 10 THEN 'external' ELSE 'parameter' END AS source, 'fn_' || ((l_orderkey * 7 + l_linenumber) % 1000) AS source_function,
            CASE WHEN l_quantity < 3 THEN 'src/m' || (l_suppkey % 50) || '.py' END AS source_file
        FROM lineitem""",
    "entry_points": """SELECT n_nationkey AS rank, 'fn_' || n_nationkey AS function_name FROM nation""",
    "function_files": """
        SELECT DISTINCT 'src/m' || (p_partkey % 50) || '.py' AS file_path, CASE p_partkey % 50 % 3 WHEN 0 THEN 'changed' ELSE md5('m' || (p_partkey % 50)) END AS src_hash FROM part""",
    "bound": """
        SELECT 'req:REQ-' || c_custkey AS binding, 'req-' || lpad(cast(c_custkey + 1 AS varchar(20)), 4, '0') AS id FROM customer WHERE c_nationkey < 8
        UNION ALL SELECT 'req:OLD-' || c_custkey, 'req-' || (c_custkey + 200001) FROM customer WHERE c_nationkey >= 20
        UNION ALL SELECT 'gwt:C-' || o_orderkey, 'gwt-' || lpad(cast(o_orderkey + 1 AS varchar(20)), 4, '0') FROM orders WHERE o_orderstatus = 'P'""",
    "behaviours": """
        SELECT o_orderkey AS place, 'C-' || o_orderkey AS criterion_id, 'an order' AS given, 'It is of ' || o_orderpriority AS when_, 'it ships' AS then_,
            CASE o_orderkey % 5 WHEN 0 THEN 'REQ-' || o_custkey WHEN 1 THEN 'req-' || lpad(cast(o_custkey + 1 AS varchar(20)), 4, '0') WHEN 2 THEN 'OLD-' || o_custkey WHEN 3 THEN '' END AS parent_req,
            CASE WHEN o_totalprice > 300000 THEN o_orderpriority END AS name, 'part-' || (o_orderkey % 300) AS need
        FROM orders""",
}


def sql(name: str) -> str:
    """The text of a relation, other relations in it written out."""
    text = RELATIONS[name]
    for other in RELATIONS:
        text = text.replace("({" + other + "})", f"({sql(other)})") if "{" + other + "}" in text else text
    return text


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation as a DataFrame over the driver tables."""
    text = sql(name)
    used = [t for t in TABLES if f" {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines relations for the SQL counterparts."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({sql(n)})" for n in names)
