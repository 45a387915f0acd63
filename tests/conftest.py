import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.executorEnv.PYTHONPATH", str(ROOT)).config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-wh-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.addPyFile(_zipped())
    yield s
    s.stop()


def _zipped() -> str:
    """The package for Python workers, wherever the tests are started."""
    import shutil

    folder = tempfile.mkdtemp(prefix="spark-py-")
    shutil.copytree(ROOT / "chronolith", f"{folder}/src/chronolith", ignore=shutil.ignore_patterns("__pycache__"))
    return shutil.make_archive(f"{folder}/chronolith", "zip", f"{folder}/src")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def same_rows(a, b):
    """Equal columns and rows of two pandas frames, whatever their order."""
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    left, right = rows(a), rows(b)
    assert len(left) == len(right)
    assert left == right
