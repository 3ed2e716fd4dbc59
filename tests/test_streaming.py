"""The state machine on a stream, against the batch operator."""

import datetime

import numpy as np
import pytest

from cadenza.operators import monitor
from cadenza.streaming import states

SCHEMA = "stream string, ts timestamp, key long, score double, threshold double, reset double, in_baseline boolean"
BEGIN = datetime.datetime(2020, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def scored(gap_at=None):
    rng = np.random.default_rng(12)
    rows = []
    for s, n in (("hot", 240), ("b", 60)):
        level = np.repeat(rng.random(n // 4 + 1), 4)
        for k in range(n):
            minutes = k // 2 + (100_000 if gap_at is not None and k >= gap_at else 0)  # two rows a minute: a tie in time
            rows.append((s, BEGIN + datetime.timedelta(minutes=minutes), k, None if rng.random() < 0.04 else float(level[k]), 0.6, 0.4, k < 4))
    return rows


def replayed(spark, folder, batches, **options):
    """The stream's output for one micro-batch a file, in order, and a last one far behind that lets all go."""
    source = f"{folder}/in"
    for batch in [*batches, [("end", BEGIN + datetime.timedelta(days=4000), 0, 0.0, 0.6, 0.4, False)], [("end", BEGIN + datetime.timedelta(days=4001), 0, 0.0, 0.6, 0.4, False)]]:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = states.monitor_stream(spark.readStream.schema(SCHEMA).parquet(source), 3, 2, **options)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.schema(states.OUTPUT).parquet(f"{folder}/out").where("stream <> 'end'").collect()
    return sorted((r["stream"], r["key"], r["state"], r["consecutive"], r["released"]) for r in got)


def of_batch(spark, rows):
    out = monitor.monitor_states(spark.createDataFrame(rows, SCHEMA), "stream", ["ts", "key"], 3, 2).collect()
    return sorted((r["stream"], r["key"], r["state"], r["consecutive"], r["released"]) for r in out)


def test_shuffled_batches_give_the_batch_states(rocks, tmp_path):
    rows = scored()
    rng = np.random.default_rng(0)
    # rows come up to 20 minutes late; each restart of the query goes on from its checkpoint
    order = np.argsort([(r[1] - BEGIN).total_seconds() / 60 + rng.uniform(0, 20) for r in rows])
    batches = [[rows[k] for k in part] for part in np.array_split(order, 4)]
    assert replayed(rocks, tmp_path, batches, late="30 minutes") == of_batch(rocks, rows)


def test_idle_streams_begin_anew_and_late_rows_are_left_out(rocks, tmp_path):
    rows = scored(gap_at=21)
    late = [("hot", BEGIN, 999, 1.0, 0.6, 0.4, False)]
    got = replayed(rocks, tmp_path, [[r for r in rows if r[2] < 21], [r for r in rows if r[2] >= 21], late], late="30 minutes", idle_hours=24)
    want = of_batch(rocks, [r for r in rows if r[2] < 21]) + of_batch(rocks, [r for r in rows if r[2] >= 21])
    assert got == sorted(want)
