import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same_rows(a, b) -> None:
    """Two pandas frames hold the same rows, in any order."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def plain(x):
        x = x[cols].copy()
        for c in cols:
            if x[c].dtype.kind in "fiu":
                x[c] = x[c].astype(float).round(5)
            x[c] = x[c].map(lambda v: "" if v is None or v != v else str(v).removesuffix(" 00:00:00"))
        return sorted(map(tuple, x.to_numpy().tolist()))

    assert plain(a) == plain(b)
