"""The data source of recordings, sets of tables, and updates of buckets."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from cadenza.sources import files, recordings, tables


@pytest.fixture
def folder(tmp_path):
    for k in range(9):
        (tmp_path / f"2004.02.12.10.{k:02d}.00").write_bytes(b"" if k == 4 else b"1.5\t2.5\n" * (k + 1))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "notes.txt").write_text("x")
    (tmp_path / "2004.13.12.10.00.00").write_text("no month")
    return tmp_path


def test_files_are_listed_with_empty_ones(spark, folder):
    for path in (str(folder), f"file://{folder}"):
        got = files.recording_files(spark, path).orderBy("recording_index").collect()
        assert [r["recording_index"] for r in got] == list(range(11)) and [r["status"] for r in got] == ["ok"] * 4 + ["empty"] + ["ok"] * 6
        assert got[4]["name"] == "2004.02.12.10.04.00" and got[4]["content"] == b"" and got[0]["ts"] == datetime.datetime(2004, 2, 12, 10)
        assert [r["ts"] for r in got[9:]] == [None, None] and [r["name"] for r in got[9:]] == ["2004.13.12.10.00.00", "notes.txt"]
    mine = {r["name"]: r["sha256"] for r in recordings.manifest(spark, f"file://{folder}").collect()}
    assert mine == {r["name"]: r["sha256"] for r in got if r["status"] == "ok" and "notes" not in r["name"]}
    assert [r["recording_index"] for r in recordings.manifest(spark, f"file://{folder}").orderBy("ts", "name").collect()] == list(range(9))


def test_filters_choose_files_and_partitions_are_bounded(spark, folder):
    df = files.recording_files(spark, str(folder), content=False)
    some = df.where((F.col("ts") >= F.lit(datetime.datetime(2004, 2, 12, 10, 6)).cast("timestamp_ntz")) & F.col("name").startswith("2004") & (F.col("status") == "ok"))
    assert [r["recording_index"] for r in some.orderBy("name").collect()] == [6, 7, 8] and some.first()["content"] is None
    assert df.where("recording_index IN (1, 4)").count() == 2 and df.where("bytes = 0").first()["status"] == "empty" and df.where("ts IS NULL").count() == 2
    parts = files.dealt(files.listed(str(folder)), 9000)
    assert [f.recording_index for p in parts for f in p.files] == list(range(11)) and max(len(p.files) for p in parts) <= 2
    reader = files.RecordingReader({"path": str(folder)})
    assert list(reader.pushFilters([files.EqualTo(("status",), "ok"), files.EqualTo(("name",), "x")])) == [files.EqualTo(("status",), "ok")] and reader.partitions() == [files.Dealt(())]


def test_files_that_change_are_told(folder):
    reader = files.RecordingReader({"path": str(folder)})
    parts = reader.partitions()
    (folder / "2004.02.12.10.01.00").write_bytes(b"more than before")
    (folder / "2004.02.12.10.02.00").unlink()
    assert [r[5] for r in reader.read(parts[0])][:4] == ["ok", "changed", "missing", "ok"]


def test_sets_change_as_a_whole(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/set"
    a, b = spark.range(5), spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert tables.publish_set({"a": a, "b": b}, folder) is True and tables.publish_set({"a": a.repartition(3), "b": b.orderBy("k")}, folder) is False
    first = tables.manifest_of(spark, folder)
    # a write that breaks after its first member
    real, calls = tables.table_digest, []

    def broken(df, *options):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(df, *options)

    monkeypatch.setattr(tables, "table_digest", broken)
    with pytest.raises(RuntimeError, match="lost"):
        tables.publish_set({"a": spark.range(6), "b": b.limit(1)}, folder)
    monkeypatch.setattr(tables, "table_digest", real)
    assert tables.manifest_of(spark, folder) == first and tables.read_member(spark, folder, "a").count() == 5
    assert tables.publish_set({"a": spark.range(6), "b": b}, folder) is True
    now = tables.manifest_of(spark, folder)
    assert tables.read_member(spark, folder, "a").count() == 6 and tables.read_member(spark, folder, "b").count() == 3 and now["b"]["path"] == first["b"]["path"] and now["a"]["version"] == 2
    # a manifest that isn't whole isn't read
    spark.createDataFrame([(3, "a", "members/none", 1, "x", 2)], tables._MANIFEST).write.parquet(f"{folder}/manifests/00000003-x")
    assert tables.manifest_of(spark, folder) == now
    with pytest.raises(ValueError, match="no member c"):
        tables.read_member(spark, folder, "c")


def test_updates_touch_their_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/table"
    tables.write_bucketed(spark.range(2000).select("id", (F.col("id") * 2).alias("x"), F.lit("n").alias("note")), path, ["id"], 16)
    listing = lambda: {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.startswith("part")) for d in os.listdir(path) if d.startswith("_bucket")}
    before = listing()
    staging = spark.createDataFrame([(3, -1, 1), (3, -2, 2), (5, None, 1), (None, 7, 1), (9000, 1, 1)], "id long, x long, at int")
    touched = tables.update_bucketed(staging, path, ["id"], ["x"], 16, F.col("at"), insert=True)
    after = listing()
    changed = {d for d in after if after[d] != before[d]}
    assert before.keys() == after.keys() and len(changed) == touched <= 3
    got = {r["id"]: (r["x"], r["note"]) for r in tables.read_bucketed(spark, path).collect()}
    assert len(got) == 2001 and got[3] == (-2, "n") and got[5] == (10, "n") and got[9000] == (1, None) and got[4] == (8, "n")
    assert tables.update_bucketed(staging.where("false"), path, ["id"], ["x"], 16) == 0


def test_canonical_json_is_python_s(spark):
    import hashlib
    import json

    from cadenza.operators import identity
    from cadenza.sources import sinks

    rows = [(1, 0.1, "é \x7f\"/\\\n😀", [1.0, None, 1e22], {"b": 1, "a": None}, True), (2**53 + 1, 1e-7, None, [], {}, None), (-3, float(10**16), "", None, None, False), (None, 123456789012345.6, "x", [2.5e-5], {"z": 2}, True)]
    df = spark.createDataFrame(rows, "n long, x double, s string, a array<double>, m map<string,long>, b boolean")
    want = [dict(zip("nxsamb", r, strict=True)) for r in rows]
    text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    got = df.select("x", identity.canonical_json(*(F.col(c) for c in df.columns)).alias("j"), identity.tagged_id("t", F.col("n"), F.col("s")).alias("id")).collect()
    assert [r["j"] for r in got] == [text(v) for v in want]
    of = lambda v: "sha256:" + hashlib.sha256((text({"id_schema_version": "canonical_sha256_id_v1", "payload": {"n": v["n"], "s": v["s"]}, "tag": "t"}) + "\n").encode()).hexdigest()
    assert [r["id"] for r in got] == [of(v) for v in want]
    names = ["b", "a", "é", "Z"]
    assert identity.names_sha256(spark.createDataFrame([(n,) for n in names], "name string"), "name") == hashlib.sha256(("\n".join(sorted(names)) + "\n").encode()).hexdigest()
    assert list(sinks.canonical_lines(df.select("n", "x").where("n > 0"), ["n"])) == ['{"n":1,"x":0.1}\n', '{"n":9007199254740993,"x":1e-07}\n']


def test_what_is_there_is_not_built_again(spark, tmp_path):
    from cadenza.sources import sinks

    path, built = f"{tmp_path}/t", []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert [sinks.cached(spark, path, build, force).count() for force in (False, False, True, False)] == [1, 1, 2, 2] and len(built) == 2
    df = spark.createDataFrame([(2, 1, 0.5), (1, 2, 1.5), (1, 1, 2.5)], "k int, t int, v double")
    assert [tuple(r) for r in sinks.write_stats(df, f"{tmp_path}/s", ["k"], "t", ["v"]).orderBy("k", "t").collect()] == [(1, 1, 2.5), (1, 2, 1.5), (2, 1, 0.5)]
