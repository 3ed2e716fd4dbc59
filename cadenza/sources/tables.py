"""Tables that change as a whole: published sets of tables, and tables in hash buckets of a key."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.identity import tables_differ, updated
from cadenza.sources.shared import written


def publish(df: DataFrame, path: str) -> bool:
    """Write a table once. The same rows again change nothing (False); other rows are an error. Spark
    moves the files of a write into place when all of them are there; what a broken one leaves holds
    other rows, and is an error too."""
    try:
        df.sparkSession.read.parquet(path)
    except AnalysisException:
        df.write.mode("error").parquet(path)
        return True
    if tables_differ(df.sparkSession.read.schema(df.schema).parquet(path), df).isEmpty():
        return False
    raise ValueError(f"{path} holds other rows")


def publish_all(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Publish several tables as members of a folder, and no others: a member that isn't among them is an
    error before anything is written. Returns the names that were written. Members become visible one by one;
    publish_set makes them visible together."""
    spark = next(iter(tables.values())).sparkSession
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("member")).distinct()
        others = sorted({r["member"] for r in files.collect()} - set(tables))
    except AnalysisException:
        others = []
    if others:
        raise ValueError(f"{folder} has other members: {others}")
    return [name for name, df in tables.items() if publish(df, f"{folder}/{name}")]


# ---- sets of tables ----


def table_digest(df: DataFrame, parts: int = 4096) -> tuple[int, str]:
    """Rows and a digest of a table as a multiset of rows, whatever their order and partitions: rows are hashed
    and counted, each part's digest covers its hashes in order, the whole covers the parts'."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    hashes = df.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    part = hashes.groupBy(F.pmod(F.xxhash64("h"), F.lit(parts)).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(" ", "h", "n")))), 256).alias("d"))
    total = part.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("p", "d"))), lambda x: x["d"])), 256).alias("d")).first()
    return total["n"] or 0, total["d"]


_MANIFEST = "version long, member string, path string, n long, digest string, members long"


def manifest_of(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The members of the last set whose manifest is complete, by name; none where there is no such set."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifests/*").collect()  # a row a member and version
    except AnalysisException:
        return {}
    sets: dict[int, dict[str, dict]] = {}
    for r in rows:
        sets.setdefault(r["version"], {})[r["member"]] = r.asDict()
    whole = [v for v, members in sets.items() if all(m["members"] == len(members) for m in members.values())]
    return sets[max(whole)] if whole else {}


def publish_set(tables: Mapping[str, DataFrame], folder: str) -> bool:
    """Replace a folder's set of tables by another as a whole. Members are written beside the old ones, under
    names of their own, read again and compared, and the manifest that names them is written last, in one file:
    readers see the old set until it is there. What a broken write leaves is never read; the next run
    writes its own members. The same set again changes nothing (False)."""
    if not tables:
        raise ValueError("a set has one member at least")
    spark = next(iter(tables.values())).sparkSession
    old = manifest_of(spark, folder)
    digests = {name: table_digest(df) for name, df in tables.items()}
    if old and {n: (m["n"], m["digest"]) for n, m in old.items()} == digests:
        return False
    version = 1 + max((m["version"] for m in old.values()), default=0)
    rows = []
    for name, df in tables.items():
        before = old.get(name)
        if before and (before["n"], before["digest"]) == digests[name]:
            path = before["path"]  # unchanged members stay where they are
        else:
            path = f"members/{name}-{uuid.uuid4().hex}"
            df.write.mode("error").parquet(f"{folder}/{path}")
            if table_digest(spark.read.schema(df.schema).parquet(f"{folder}/{path}")) != digests[name]:
                raise RuntimeError(f"{name} changed while it was written")
        rows.append((version, name, path, *digests[name], len(tables)))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{folder}/manifests/{version:08d}-{uuid.uuid4().hex}")
    return True


def read_member(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the set that the last complete manifest names."""
    members = manifest_of(spark, folder)
    if name not in members:
        raise ValueError(f"{folder} has no member {name}")
    return spark.read.parquet(f"{folder}/{members[name]['path']}")


# ---- tables in buckets ----

BUCKET = "_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 256) -> None:
    """A table in folders by hash of its key."""
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def update_bucketed(staging: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str], buckets: int = 256, order: Column | None = None, insert: bool = False) -> int:
    """updated() on a table of write_bucketed(): only the buckets that staging touches are read and written
    anew, files of the others stay. With `insert`, keys that the table lacks are added. Returns how many buckets
    were written. Spark puts the new buckets in place when all are written; a broken write leaves the table as
    it was. Null keys match nothing."""
    spark = staging.sparkSession
    rows = staging.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).withColumn(BUCKET, bucket_of(keys, buckets))
    touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # `buckets` numbers at most
    if not touched:
        return 0
    there = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    out = updated(there, rows.drop(BUCKET), keys, columns, order)
    if insert:
        value = F.struct(*columns)
        new = rows.groupBy(*keys).agg((F.max(value) if order is None else F.max_by(value, F.struct(order, value))).alias("_new"))
        new = new.join(there.select(*keys), list(keys), "left_anti")
        names = {**{k: F.col(k) for k in keys}, **{c: F.col("_new")[c] for c in columns}, BUCKET: bucket_of(keys, buckets)}
        out = out.unionByName(new.select(*(names[c].cast(there.schema[c].dataType).alias(c) if c in names else F.lit(None).cast(there.schema[c].dataType).alias(c) for c in there.columns)))
    # written before it replaces what it was read from
    written(out, "update").repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return len(touched)
