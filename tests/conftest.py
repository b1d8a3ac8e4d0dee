import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Run a query in Spark and its SQL in DuckDB over one folder; assert equal rows."""
    import decimal

    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")

    def norm(v):
        if isinstance(v, decimal.Decimal):
            return int(v) if v == v.to_integral_value() else float(f"{float(v):.9g}")
        return float(f"{v:.9g}") if isinstance(v, float) else v

    def run(plan, sql):
        df = plan(spark, SMALL)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(names)
        order = [names.index(c) for c in sorted(names)]
        want = sorted(str(tuple(norm(r[i]) for i in order)) for r in cursor.fetchall())
        got = sorted(str(tuple(norm(r[c]) for c in sorted(names))) for r in df.collect())
        assert got == want

    return run
