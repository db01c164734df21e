"""The driver's entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from cachelens.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    con.execute(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLES[name]})")
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, con.fetchall()))


def test_fmt_mem_sizes_past_a_long(spark, tmp_path):
    t, odd = 1 << 40, (1 << 32) + 1
    pairs = [(8_999_999, 899_999), (2_097_152, 2_097_152), (2_097_151, 2_097_152), (5_000_000_000, 0), (5_000_000_000, -1), (1, (1 << 60) - 1), (odd, t - pow(odd * odd, -1, t)), (1 << 40, 1 << 40), (7, None), (None, 7)]

    def sizes(rows):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        return sorted(map(repr, map(tuple, catalogue.QUERIES["fmt_mem_sizes"](spark, str(tmp_path)).collect())))

    def text(size):
        return f"{size // t}TB {size % t >> 30}GB" if size >= t else f"{size}B"

    assert sizes(pairs) == sorted(repr((key, None if key is None or cust is None else text(key * key * cust))) for key, cust in pairs)
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        sizes([(1 << 62, 1 << 62)])
