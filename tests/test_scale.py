import pytest

from graphmill.plans import building, standins

TABLES = {
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(i, f"C{i}", 1, 1.0, "M") for i in range(9)]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(i, f"Supplier#{i:09}", 1, 1.0) for i in range(9)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "LAND", 1)]),
    "region": ("r_regionkey int, r_name string", [(1, "WORLD")]),
    "part": ("p_partkey long, p_brand string", [(1, "B")]),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
        [(i, 1, 2, 1, float(i % 5), "NRA"[i % 3], "FO"[i % 2]) for i in range(20)],
    ),
}


@pytest.fixture
def sf(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_profile_rows_are_dealt(spark, sf):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (standins.profiles(spark, sf), standins.suppliers(spark, sf)):
        assert rows.count() == 9 and rows.rdd.getNumPartitions() == parts


def test_names_of_known_companies_are_read_once(spark, sf):
    found = building.known_company_edges(spark, sf)
    scans = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in line and "l_quantity#" in line for line in scans) == 1
    assert {r.dst_key for r in found.where("rel = 'PARTNER_WITH'").collect()} == {"S-0", "S-1", "S-3", "S-4"}
