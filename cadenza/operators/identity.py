"""Content-hash identities and integrity gates; a gate returns its violations, none when it holds."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_id(tag: str, *parts: Column) -> Column:
    """'sha256:' and the hash of a JSON object of the tag and the named parts, in the order given; a
    caller that wants one id for one set of parts gives them in order of names, as sorted_id does."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*parts, F.lit(tag).alias("tag")), {"ignoreNullFields": "false"}), 256))


def sorted_id(tag: str, **parts: Column) -> Column:
    """content_id with the parts, and the tag among them, in order of names."""
    named = sorted({**parts, "tag": F.lit(tag)}.items())
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in named)), {"ignoreNullFields": "false"}), 256))


def _plain(value, kind: pa.DataType):
    """An Arrow value for JSON: a map is an object, whatever it is in."""
    if value is None or not pa.types.is_nested(kind):
        return value
    if pa.types.is_map(kind):
        return {k: _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind}
    return [_plain(v, kind.value_type) for v in value]


def canonical_json(*parts: Column) -> Column:
    """A JSON object of the named parts as the publisher's tool writes it: keys in order at any depth, no
    spaces, ASCII with escapes, numbers as Python writes them. Arrow brings rows as they are (whole numbers stay
    whole, nulls are null); Spark's own to_json has other number texts and escapes."""

    def written(rows: pa.Array) -> pa.Array:
        return pa.array([None if v is None else json.dumps(_plain(v, rows.type), sort_keys=True, separators=(",", ":"), ensure_ascii=True) for v in rows.to_pylist()], pa.string())

    return F.arrow_udf(written, "string")(F.struct(*parts))


#: What an id says about its own form: a fixed value.
ID_SCHEMA = "canonical_sha256_id_v1"


def tagged_id(tag: str, *parts: Column) -> Column:
    """'sha256:' and the hash of the canonical JSON line of the form, the payload of parts and the tag."""
    text = F.concat(F.lit(f'{{"id_schema_version":"{ID_SCHEMA}","payload":'), canonical_json(*parts), F.lit(f',"tag":{json.dumps(tag)}}}\n'))
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def names_sha256(df: DataFrame, name: str) -> str:
    """The digest of all names in order, a line each. Such a digest is made of one text from begin to end, so
    sorted partitions go through it one at a time; members_digest is the one that tasks share."""
    digest = hashlib.sha256()
    n = 0
    for row in df.select(F.col(name).cast("string")).orderBy(name).toLocalIterator():
        digest.update(f"{row[0]}\n".encode())
        n += 1
    if not n:
        digest.update(b"\n")
    return digest.hexdigest()


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(child_key) == F.col("_k"), "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cardinality_violations(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(~F.col("n").between(least, most))


def dependency_violations(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    return df.groupBy(determinant).agg(F.count_distinct(dependent).alias("n")).where("n > 1")


def expanded(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Each row once for each of a few literal values."""
    return df.select("*", F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def hash_ranked_sample(df: DataFrame, key: str, k: int, fixed: Sequence = (), seed: str = "") -> DataFrame:
    """Rows with fixed keys, and the k with the least SHA-256 of seed and key among the others."""
    chosen = F.col(key).isin(list(fixed))
    ranked = df.where(~chosen).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(k)
    return df.where(chosen).unionByName(ranked)


def members_digest(df: DataFrame, name: str, digits: int = 3) -> DataFrame:
    """n and one digest of a set of names: names are hashed into 16 ** digits parts, each part's digest
    covers its names in order, and the whole covers the parts', so no task sorts or joins all names."""
    by = df.select(F.sha2(F.col(name), 256).alias("h")).groupBy(F.substring("h", 1, digits).alias("part"))
    part = by.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("d"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda s: s["d"])), 256).alias("digest"))


def aligned(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Row k of a stream in a with row k of the stream in b."""
    number = lambda d, o: d.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*o)))
    return number(a, order_a).join(number(b, order_b), [*by, "_at"], "full").withColumnRenamed("_at", "place")


def updated(df: DataFrame, staging: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Column | None = None) -> DataFrame:
    """Values of staging where it has the key and a value, else df's. A key that staging repeats counts
    once: by its last row in `order`, or by its greatest values; `repeated_keys` tells which they are."""
    row = F.struct(*columns)
    last = staging.groupBy(*keys).agg((F.max(row) if order is None else F.max_by(row, F.struct(order, row))).alias("_new"))
    return df.join(last, list(keys), "left").select(*(F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def evolved(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.unionByName(other, allowMissingColumns=True)


def chunk_coverage(df: DataFrame, index: str, size: int = 128) -> DataFrame:
    """By chunk: rows, range, and whether its indices are contiguous and without repeats."""
    by = df.groupBy(F.floor(F.col(index) / size).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"), F.count_distinct(index).alias("_d"))
    return by.select("chunk", "n", "first", "last", ((F.col("last") - F.col("first") + 1 == F.col("n")) & (F.col("_d") == F.col("n"))).alias("complete"))


def tables_differ(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one table the other lacks, counting repeats; none when they are equal."""
    cols = expected.columns
    side = lambda d, s: d.select(*cols, F.lit(s).alias("_s"))
    both = side(expected, 1).unionByName(side(actual, -1)).groupBy(*cols).agg(F.sum("_s").alias("surplus"))
    return both.where("surplus != 0")
