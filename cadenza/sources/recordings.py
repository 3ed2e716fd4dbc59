"""Recordings as text matrices, manifests, archive listings and JSON lines. Readers return rows and
a status instead of failing on the first bad file; gates decide what a bad status means."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import blocks

#: Channel c belongs to asset 1 + c div 2, view x for even c and y for odd: fixed rule.
TIME_FORMAT = "yyyy.MM.dd.HH.mm.ss"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def file_time(name: Column) -> Column:
    """The time in a recording's whole name, seconds included; null where it isn't one."""
    ok = name.rlike(r"^\d{4}(\.\d{2}){5}$")
    return F.when(ok, F.try_to_timestamp(name, F.lit(TIME_FORMAT)).cast("timestamp_ntz"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, name, ts, bytes, sha256, recording_index of all files that are not empty, in order of time. The
    data source `files` reports those without a byte too, where pyarrow can list the store."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).withColumn("ts", file_time(F.col("name")))
    return blocks.numbered(rows, ["ts", "name", "path"], "recording_index")


def matrices(spark: SparkSession, path: str, columns: int = 8, rows: int | None = None, separator: str = r"\t", fs: float = 20_000.0, listing: DataFrame | None = None) -> DataFrame:
    """A row for each file: name, ts, samples (array of arrays of double), n_samples, duration_s, and
    status: ok, empty, blank row, rows, columns, or numbers. Lines stay in file order because each file is
    read whole. Cells stand between separators, a pattern: tabs, or any white space with r"\\s+". With
    `rows` so many are expected, none of them blank; otherwise blank ones are left out. Spark doesn't list
    files without a byte; a listing (name) of what should be there gives them a row, as empty."""
    text = spark.read.text(path, wholetext=True).select(file_name(F.col("_metadata.file_path")).alias("name"), "value")
    if listing is not None:
        names = listing.select("name").distinct()
        text = text.join(names.withColumnRenamed("name", "_listed"), F.col("name") == F.col("_listed"), "full").select(F.coalesce("name", "_listed").alias("name"), F.coalesce("value", F.lit("")).alias("value"))
    whole = F.filter(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n"), lambda x: F.lit(True))
    lines = F.filter(whole, lambda x: F.trim(x) != "")
    cells = F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^[ \r]+|[ \r]+$", ""), separator))
    numbers = F.transform("_cells", lambda r: F.transform(r, lambda c: F.btrim(c).try_cast("double")))
    read = text.select("name", cells.alias("_cells"), (F.size(whole) - F.size(lines)).alias("_blank")).withColumn("samples", numbers)
    bad = F.exists("samples", lambda r: F.exists(r, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    status = F.when(F.size("_cells") == 0, "empty")
    if rows is not None:
        status = status.when(F.col("_blank") > 0, "blank row").when(F.size("_cells") != rows, "rows")
    status = status.when(F.exists("_cells", lambda r: F.size(r) != columns), "columns").when(bad, "numbers").otherwise("ok")
    return read.select("name", file_time(F.col("name")).alias("ts"), "samples", F.size("samples").alias("n_samples"), (F.size("samples") / fs).alias("duration_s"), status.alias("status"))


def channels(recordings: DataFrame) -> DataFrame:
    """name, ts, channel, asset, view, signal of the recordings with status ok."""
    each = recordings.where("status = 'ok'").select("name", "ts", "samples", F.explode(F.sequence(F.lit(0), F.size(F.col("samples")[0]) - 1)).alias("channel"))
    return each.select("name", "ts", "channel", (1 + F.floor(F.col("channel") / 2)).alias("asset"), F.when(F.col("channel") % 2 == 0, "x").otherwise("y").alias("view"), F.transform("samples", lambda r: F.get(r, F.col("channel"))).alias("signal"))


def archive_members(listing: DataFrame, line: str = "value") -> DataFrame:
    """Members of a long archive listing (nine fields a line): mode, bytes, path and a verdict: link,
    unsafe, duplicate, case-collision or ok."""
    from pyspark.sql import Window

    f = F.split(F.btrim(F.col(line)), r"\s+", 9)
    rows = listing.where(F.size(f) == 9).select(F.get(f, F.lit(0)).alias("mode"), F.get(f, F.lit(4)).try_cast("long").alias("bytes"), F.get(f, F.lit(8)).alias("path"))
    same, folded = F.count(F.lit(1)).over(Window.partitionBy("path")), F.count(F.lit(1)).over(Window.partitionBy(F.lower("path")))
    unsafe = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").contains("\\")
    verdict = F.when(F.substring("mode", 1, 1).isin("l", "h"), "link").when(unsafe, "unsafe").when(same > 1, "duplicate").when(folded > 1, "case-collision").otherwise("ok")
    return rows.select("*", verdict.alias("verdict"))


def strict_json_lines(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """row (parsed, null if bad) and problem: blank, syntax, duplicate key, not an object, or null."""

    def problem(text: str | None) -> str | None:
        if text is None or not text.strip():
            return "blank"
        repeated = []

        def pairs(items: list) -> dict:
            if len({k for k, _ in items}) < len(items):
                repeated.append(1)
            return dict(items)

        try:
            value = json.loads(text, object_pairs_hook=pairs)
        except ValueError:
            return "syntax"
        return "duplicate key" if repeated else None if isinstance(value, dict) else "not an object"

    @F.pandas_udf("string")
    def problems(s: pd.Series) -> pd.Series:
        return s.map(lambda text: None if text is None else problem(text))

    # Spark's own parser takes no repeated key; only lines that it refuses go to Python
    parsed = lines.withColumn("_v", F.try_parse_json(line))
    doubtful = F.when(F.col("_v").isNull(), F.coalesce(line, F.lit("")))
    own = F.when(F.col("_v").isNotNull() & ~F.schema_of_variant("_v").startswith("OBJECT"), "not an object")
    checked = parsed.withColumn("_own", own).withColumn("problem", F.coalesce("_own", problems(doubtful))).drop("_v", "_own")
    return checked.withColumn("row", F.when(F.col("problem").isNull(), F.from_json(line, schema)))


def closed_keys(json_text: Column, expected: list[str]) -> tuple[Column, Column]:
    """Missing and unknown top-level keys of a JSON object."""
    keys, want = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>")), F.array(*map(F.lit, expected))
    return F.array_except(want, keys), F.array_except(keys, want)
