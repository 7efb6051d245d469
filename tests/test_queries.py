"""Registered queries against their SQL on the smallest tables."""

import os
import sys
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402
from ledgerline.operators import revisions  # noqa: E402
from ledgerline.plans import catalog, views  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")

@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def test_every_query_has_sql_that_reads_the_given_tables(con):
    sql = entry.oracle_sql()
    assert set(sql) >= set(catalog.QUERIES)
    for text in sql.values():
        con.execute("EXPLAIN " + text)


@pytest.mark.parametrize("first", [0, 1, 2])
def test_every_query_equals_its_sql(spark, con, first):
    """All ledger queries, a few at a time: most of them are many small jobs."""
    def verdict(name):
        try:
            return name, compare(spark, con.cursor(), name, SF_DIR)[2]
        except Exception as problem:  # noqa: BLE001
            return name, f"ERROR {problem}"[:500]

    with ThreadPoolExecutor(4) as pool:
        told = dict(pool.map(verdict, sorted(catalog.QUERIES)[first::3]))
    assert {k: x for k, x in told.items() if not x.startswith("ok")} == {}


def test_every_rule_and_reason_occurs(con):
    rules = con.execute(entry.oracle_sql()["b23_b24_all_rules"]).fetchall()
    assert len(rules) > 45 and all(n > 0 for *_, n in rules)
    assert len({r for _, r in con.execute(entry.oracle_sql()["b01_b20_all_reasons"]).fetchall()}) == 15


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns == ["month", "agent", "total_tokens", "share"]


@pytest.mark.parametrize("name", ["c01_current_daily", "m06_links", "i14_checkpoint_rows", "w19_table_rows", "u13_rolling_range"])
def test_no_plan_forms_a_product(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_links_of_current_rows_leave_lines_out_before_their_orders(spark, tmp_path):
    """Only current rows' lines meet the orders, and their flags are those of all links."""
    lines = [(k // 2, k % 2 + 1, k, 10.0, 100.0 + k, 0.02 * (k % 3), 0.01, "AN"[k % 2], "O", f"2024-01-0{k % 3 + 1}") for k in range(60)]
    spark.createDataFrame([*lines, (None, *lines[0][1:])], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k, "O", 5.0, f"2024-01-{k // 2 + 1:02}", "1-URGENT") for k in range(30)], "o_orderkey long, o_custkey long, o_orderstatus string, "
                          "o_totalprice double, o_orderdate string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    folder = str(tmp_path)
    current = revisions.current_daily(views.observations(spark, folder).drop("model"), views.imports(spark, folder)).localCheckpoint()
    links = views.current_links(spark, folder, current)
    assert 0 < links.count() < views.links(spark, folder).count()
    told = [sorted((r.id, r.global_duplicate, r.canonical_machine_id) for r in revisions.with_mirror_flag(current, x).collect()) for x in (links, views.links(spark, folder))]
    assert told[0] == told[1] and any(flag for _, flag, _ in told[0])
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    orders, semi = plan.index("(l_orderkey"), plan.index("LeftSemi")
    assert orders < semi
