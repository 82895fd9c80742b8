from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    tmp = tempfile.mkdtemp(prefix="spark-")
    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tmp).config("spark.sql.warehouse.dir", f"{tmp}/wh").config("spark.checkpoint.dir", f"file://{tmp}/shared")
    return b.getOrCreate()


@pytest.fixture(scope="session")
def agree(spark):
    """Whether a query's rows are those of its SQL, on the smallest data or on given tables."""

    def plain(x):
        return "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)

    def check(df, sql: str, tables: dict[str, str] | None = None) -> None:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{(tables or {}).get(t, f'{DATA}/{t}.parquet')}'")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(plain(x) for x in r) for r in found.fetchall())
        got = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
        assert got == want

    return check
