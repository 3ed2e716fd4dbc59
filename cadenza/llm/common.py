"""Shared pieces: the shared folder, materialised stages, words of a text, vectorised hashes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java pattern and as characters.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a
    session on one machine gets a new temporary folder, which is then set for the session; on a
    cluster that is an error, for executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again. The lineage ends there: a lost
    executor costs a re-read, never the work before. So the shuffle files of the work before are
    removed once it is written. The files share the folder's life time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES))


def n_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACES))).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else touched."""
    return F.translate(text, UPPER, LOWER)


def md5_int(*parts: Column) -> Column:
    """A 60-bit number from an MD5 over the parts (null as the text 'null'); any SQL engine has it."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


# ---- vectorised words of an Arrow batch (NumPy, inside tasks) ----

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = np.arange(256)
_LOWERED[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[name] = np.multiply.accumulate(out)
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row's begin (rows + 1 entries); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every word of the texts begins and ends in their bytes."""
    in_word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = in_word.copy()
    first[1:] &= ~in_word[:-1] | edge[1:-1]
    last = in_word.copy()
    last[:-1] &= ~in_word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: Words of more bytes are hashed by BLAKE2: a polynomial modulo 2 ** 64 takes long words that are built for
#: it (of about 1,024 bytes) for equal.
LONG_WORD = 32


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    table = _BYTE[_LOWERED] if lower else _BYTE
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power("up", _STEP, len(data)), out=run[1:])
    value = (run[end] - run[begin]) * _power("down", _STEP_INVERSE, len(data))[begin]
    out = mixed(value + (end - begin).astype(np.uint64))
    for k in np.flatnonzero(end - begin > LONG_WORD).tolist():
        word = data[begin[k] : end[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    return out


def hashed_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of a text column in order, and each row's first place in them
    (rows + 1 entries)."""
    data, at = text_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    begin, end = word_edges(data, at)
    return _word_hashes(data, begin, end, lower), np.searchsorted(begin, at)


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of values[begin:end] for every pair of places, end > begin: sums of all values, each
    scattered together with its place in the run."""
    n = end - begin
    if not len(n):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    place = (np.arange(int(n.sum())) - np.repeat(first, n) + 1).astype(np.uint64)
    value = values[stretches(begin, n)]
    return tuple(mixed(np.add.reduceat(mixed((value ^ np.uint64(salt)) + place * np.uint64(step)), first) + n.astype(np.uint64)) for salt, step in ((0, _STEP), (0x5851F42D4C957F2D, 0xD1342543DE82EF95)))


def stretches(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every stretch of n places, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + values[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def batches_of(rows: int, batches):
    """Arrow batches cut to so many rows at most, to bound what one step holds."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def slices_of(column: int, batches, most: int = 4 << 20):
    """Arrow batches cut to slices whose texts in `column` have about so many bytes, one row at least."""
    for batch in batches:
        size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
