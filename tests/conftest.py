import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1])]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Holds a query's rows against its SQL."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v if v is None or isinstance(v, (int, str)) else str(v)

    def check(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        mine = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
        out = duck.execute(sql)
        at = [d[0] for d in out.description]
        assert sorted(at) == names
        assert mine == sorted(([plain(r[at.index(n)]) for n in names] for r in out.fetchall()), key=repr)

    return check
