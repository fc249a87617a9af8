import pytest
from compare import oracle, rows

from cohortmill.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, got = rows(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert got == oracle(SF, ORACLE_SQL[name], cols)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_valuation_band_of_sparse_names(spark, tmp_path):
    """Names that are stale, short, or without any covered month stand where the SQL has them."""
    import duckdb

    con = duckdb.connect()
    gone = "l_suppkey % 5 = 0 and l_shipdate > timestamp '2001-04-01' or l_suppkey % 5 = 1 and l_shipdate < timestamp '1999-06-01' or l_suppkey % 5 = 2 and l_shipdate not between timestamp '1996-07-01' and timestamp '1996-08-20'"
    con.execute(f"copy (select * from '{SF}/lineitem.parquet' where not ({gone})) to '{tmp_path}/lineitem.parquet' (format parquet)")
    cols, got = rows(QUERIES["valuation_band"](spark, str(tmp_path)))
    assert got == oracle(str(tmp_path), ORACLE_SQL["valuation_band"], cols)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_forward_return_reads_no_frame_anew(spark):
    import re

    plan = _plan(QUERIES["asof_forward_return"](spark, SF))
    assert not re.search(r"RowFrame, currentrow\$\(\), unboundedfollowing", plan) and plan.count("Relation [") == 2  # the names and their bars


def test_dates_meet_bars_in_one_reading(spark):
    assert _plan(QUERIES["range_join_upto"](spark, SF)).count("Relation [") == 1


def test_narratives_are_read_by_all_tasks(spark):
    from cohortmill.operators import narration

    n = spark.createDataFrame([("r", f"S{i}", "It is well. It is not.") for i in range(50)], "run string, ticker string, narrative string").coalesce(1)
    assert narration.sentences_of(n).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
