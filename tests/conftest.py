import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(top / "warehouse")).config("spark.checkpoint.dir", f"file://{top}/checkpoints").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL over the tables of SF and compares it with a Spark result, in any row order."""
    import glob

    import duckdb

    duck = duckdb.connect()
    duck.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def same(df, sql):
        mine, theirs = df.toPandas(), duck.sql(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        order = sorted(mine.columns)
        mine, theirs = (x[order].astype(str).sort_values(order).reset_index(drop=True) for x in (mine, theirs))
        assert mine.equals(theirs), f"{len(mine)} and {len(theirs)} rows"

    return same
