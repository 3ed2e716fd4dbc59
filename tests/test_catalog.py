"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.plans import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if v is None or isinstance(v, str | bool):
        return v
    return None if math.isnan(v) else round(float(v), 5)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["ridge", "mutual_information"])
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_feature_rows_keep_the_sign_of_zero(spark, tmp_path):
    """Means that round to zero from below are -0.0, as in the SQL."""
    x = np.random.default_rng(6).normal(size=(6, 64)).astype(np.float32) * np.float32(1e-9) ** (np.arange(6) % 2)[:, None]
    pq.write_table(pa.table({"vec_id": np.arange(6), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": np.arange(6, dtype=np.int32)}), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = {r["vec_id"]: r["feature_values"] for r in catalog.QUERIES["feature_rows"](spark, str(tmp_path)).collect()}
    want = dict(con.sql(f"SELECT vec_id, feature_values FROM ({catalog.ORACLE['feature_rows']})").fetchall())
    assert repr(sorted(got.items())) == repr(sorted(want.items())) and "-0.0," in repr(want)


def test_rounding_is_that_of_sql(spark):
    """Ties are those of the product, and zeros keep their sign."""
    values = [1.0000005, 0.0000015, -2.5e-7, -0.0, 0.0, 1.0000025, -8.0000005, 123456.1234565, 5e-7, -5e-7, 1e20, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    con = duckdb.connect()
    con.register("t", pa.table({"k": range(len(values)), "v": pa.array(values, pa.float64())}))
    want = [r[0] for r in con.sql("SELECT round(v, 6) FROM t ORDER BY k").fetchall()]
    assert repr([r[0] for r in df.orderBy("k").select(streams.rounded_as_sql(F.col("v"))).collect()]) == repr(want)


def test_lobo_rows_have_every_fold(spark):
    got = catalog.QUERIES["lobo_rows"](spark, SF).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "test").alias("tests")).collect()
    assert sorted(r["fold"] for r in got) == list(range(15)) and all(r["n"] == 1000 for r in got) and sum(r["tests"] for r in got) == 1000
