"""Tables to and from files: what a feature store's loaders and reports need beside plain reads and writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cadenza.operators.identity import canonical_json

#: Columns that say which row it is, not what it measured: fixed values.
METADATA = ("feature_id", "file", "file_name", "timestamp", "channel", "bearing", "bearing_id", "axis", "n_windows", "split", "failed", "censored", "rul_hours", "rul_seconds")


def numeric_columns(df: DataFrame, but: Sequence[str] = METADATA) -> list[str]:
    """The columns that hold numbers and aren't metadata, in order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def save(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """Write a table, replacing what is there. Columns that CSV can't hold are written as JSON texts."""
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == "csv":
        plain = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*plain).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"no format {kind}")
    return path


def read_list(spark: SparkSession, path: str, column: str = "feature") -> DataFrame:
    """One column of a CSV file with a header, without blank values; an error if it isn't there."""
    df = spark.read.option("header", True).csv(path)
    if column not in df.columns:
        raise ValueError(f"{path} has no column {column}")
    return df.select(F.btrim(column).alias(column)).where(F.col(column) != "")


def append_checked(df: DataFrame, path: str, required: Sequence[str], renamed: Mapping[str, str] | None = None) -> list[str]:
    """Append rows to a Parquet table. Required columns are looked for under their names before the
    rename; a table that is there gets its own columns, in its order, and no others."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    rows = df.withColumnsRenamed(dict(renamed or {}))
    try:
        there = df.sparkSession.read.parquet(path)
        rows = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema.fields))
    except AnalysisException:
        pass  # the first rows make the table
    rows.write.mode("append").parquet(path)
    return rows.columns


def ingest(spark: SparkSession, source: str, path: str, required: Sequence[str], renamed: Mapping[str, str] | None = None) -> list[str]:
    return append_checked(spark.read.parquet(source), path, required, renamed)


def json_lines(df: DataFrame, order: Sequence[str]) -> Iterator[str]:
    """Rows as JSON objects with sorted keys and null members, in order: a stream to write, one
    partition in the driver at a time."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    for row in df.orderBy(*order).select(line.alias("line")).toLocalIterator():
        yield row["line"] + "\n"


def canonical_lines(df: DataFrame, order: Sequence[str]) -> Iterator[str]:
    """Rows as canonical JSON lines (identity.canonical_json) in order, one partition in the driver at a time."""
    for row in df.orderBy(*order).select(canonical_json(*(F.col(c) for c in df.columns)).alias("line")).toLocalIterator():
        yield row["line"] + "\n"


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at a path; where it isn't there, or with force, it is built and written first. Spark marks a
    write that ended; what a broken one leaves is built again."""
    try:
        done = not force and spark.read.format("binaryFile").option("pathGlobFilter", "_SUCCESS").load(path).count() >= 0 and bool(spark.read.parquet(path).columns)
    except AnalysisException:
        done = False
    if not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_stats(df: DataFrame, path: str, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Replace the table of statistics: keys, time and the chosen columns in order, in ranges; the table."""
    df.select(*keys, ts, *columns).repartitionByRange(*keys, ts).sortWithinPartitions(*keys, ts).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_split_column(df: DataFrame, name: str = "split") -> DataFrame:
    """df with a null text column of that name, as it is where it has one."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast("string"))


def split_record(df: DataFrame, strategy: str, split: str = "split", ts: str = "ts") -> DataFrame:
    """One row to append to a log of splits: strategy, rows, rows of each side, and where train ends and
    test begins."""
    side = lambda s: F.col(split) == s
    return df.agg(
        F.lit(strategy).alias("strategy"), F.count(F.lit(1)).alias("n"), F.count_if(side("train")).alias("train"), F.count_if(side("test")).alias("test"),
        F.max(F.when(side("train"), F.col(ts))).alias("train_end"), F.min(F.when(side("test"), F.col(ts))).alias("test_begin"),
    )
