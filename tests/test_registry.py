import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from depweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, small, duck, name):
    assert rows(registry.QUERIES[name](spark, small).toPandas()) == rows(duck.execute(registry.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_components_of_all_edges(spark, small):
    from depweave.plans.relations import relation

    nodes = [r.id for r in relation(spark, small, "nodes").select("id").collect()]
    root = {n: n for n in nodes}

    def find(n):
        while root.setdefault(n, n) != n:
            root[n] = n = root[root[n]]
        return n

    for r in relation(spark, small, "edges").select("from_id", "to_id").collect():
        a, b = sorted((find(r.from_id), find(r.to_id)))
        root[b] = a
    least = sorted({find(n) for n in nodes})
    got = {r.node_id: r.component_id for r in registry.QUERIES["graph_components_all"](spark, small).collect()}
    assert got == {n: f"component-{least.index(find(n))}" for n in nodes}


def test_verdicts_of_all_states(spark, tmp_path):
    """An error or a view counts whatever the number of its state; other states change nothing."""
    kinds = {1: ["click", "error"], 2: ["view", "purchase"], 3: ["purchase"], 4: ["view", "click", "error", "click"]}
    events = pd.DataFrame([(10 * u + k, u, kind, pd.Timestamp(2026, 1, 1 + k), 1.0) for u, x in kinds.items() for k, kind in enumerate(x)], columns=["event_id", "user_id", "event_type", "ts", "value"])
    spark.createDataFrame(events).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.group: (r.verdict, r.reviews, r.exit_code) for r in registry.QUERIES["verdict_rollup_all"](spark, str(tmp_path)).collect()}
    assert got == {1: ("fail", 2, 1), 2: ("warning", 2, 0), 3: ("pass", 1, 0), 4: ("fail", 4, 1)}
