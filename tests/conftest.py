import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def compare():
    return same_rows


def same_rows(spark, sf_dir, query, sql):
    """Rows of a query and of its SQL on the same tables, as sorted lists, and both column lists."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    names = sorted(got.columns)
    at = {n: i for i, n in enumerate(want.columns)}
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted((tuple(near(r[n]) for n in names) for r in got.collect()), key=repr)
    b = sorted((tuple(near(r[at[n]]) for n in names) for r in want.fetchall()), key=repr)
    return a, b, names, sorted(at)
