"""Gates: each returns the violations of a rule set as rows, none when it holds. A caller that must fail
closed raises when the table isn't empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import blocks
from cadenza.operators.identity import members_digest


def pin_violations(expected: DataFrame, actual: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """name, problem: pinned members that are missing, members that no pin names, and members with
    another digest. A null digest matches none."""
    a = expected.select(F.col(name).alias("_a"), F.col(digest).alias("_want"), F.lit(True).alias("_pinned"))
    b = actual.select(F.col(name).alias("_b"), F.col(digest).alias("_have"), F.lit(True).alias("_found"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    problem = F.when(F.col("_found").isNull(), "missing").when(F.col("_pinned").isNull(), "not pinned").when(~F.coalesce(F.col("_want") == F.col("_have"), F.lit(False)), "digest")
    return both.select(F.coalesce("_a", "_b").alias(name), problem.alias("problem")).where("problem IS NOT NULL")


def discovery_violations(listing: DataFrame, path: str, name: str, time: Column, pattern: str, count: int | None = None, digest: str | None = None) -> DataFrame:
    """subject, problem of a listing: names that don't match the pattern or are no time, paths that are
    unsafe or repeated, times that are repeated, and a count or digest of all names (members_digest)
    that is another than the expected."""
    rows = listing.select(F.col(path).alias("path"), F.col(name).alias("name"), time.alias("_time"))
    unsafe = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    each = F.when(~F.col("name").rlike(pattern), "name").when(F.col("_time").isNull(), "time").when(unsafe, "unsafe path")
    out = rows.select(F.col("path").alias("subject"), each.alias("problem")).where("problem IS NOT NULL")
    repeated = lambda c, problem: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(c).cast("string").alias("subject"), F.lit(problem).alias("problem"))
    out = out.unionByName(repeated("path", "repeated path")).unionByName(repeated("_time", "repeated time"))
    if count is not None:
        out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") != count).select(F.col("_n").cast("string").alias("subject"), F.lit("count").alias("problem")))
    if digest is not None:
        out = out.unionByName(members_digest(rows, "name").where(~F.col("digest").eqNullSafe(F.lit(digest))).select(F.col("digest").alias("subject"), F.lit("digest").alias("problem")))
    return out


def row_violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """key, rule for every rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


def vector_rules(column: str, length: int) -> dict[str, Column]:
    """Rules for row_violations: an array of so many values, each finite or null."""
    finite = F.forall(column, lambda x: x.isNull() | (~F.isnan(x) & (F.abs(x) != float("inf"))))
    return {f"{column} length": F.size(column) == length, f"{column} finite": finite}


def stream_violations(df: DataFrame, stream: str, index: str, rows: int | None = None, streams: int | None = None) -> DataFrame:
    """stream, problem: streams with another number of rows, or whose indices aren't 0, 1, ... without
    gaps and repeats; and, with a null stream, another number of streams."""
    by = df.groupBy(F.col(stream).alias("stream")).agg(F.count(F.lit(1)).alias("_n"), F.min(index).alias("_low"), F.max(index).alias("_high"), F.count_distinct(index).alias("_d"))
    ordered = (F.col("_low") == 0) & (F.col("_high") == F.col("_n") - 1) & (F.col("_d") == F.col("_n"))
    rules = {"order": ordered} | ({"rows": F.col("_n") == rows} if rows is not None else {})
    out = row_violations(by, ["stream"], rules).select(F.col("stream").cast("string").alias("stream"), F.col("rule").alias("problem"))
    if streams is not None:
        out = out.unionByName(by.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") != streams).select(F.lit(None).cast("string").alias("stream"), F.lit("streams").alias("problem")))
    return out


#: A string token of a JSON text, with the colon that makes it a key.
_STRING = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def json_keys(text: Column) -> Column:
    """All keys of a JSON text at any depth, escapes resolved. Strings are read one after the other,
    so what stands inside a value is never taken for a key."""
    strings = F.regexp_extract_all(text, F.lit(_STRING), F.lit(0))
    keys = F.filter(strings, lambda s: s.endswith(":"))
    return F.transform(keys, lambda k: F.get(F.from_json(F.concat(F.lit("["), F.regexp_replace(k, r"\s*:$", ""), F.lit("]")), "array<string>"), F.lit(0)))


def forbidden_keys(df: DataFrame, key: Sequence[str], text: str, forbidden: Sequence[str]) -> DataFrame:
    """key, found: the JSON keys, at any depth, of which a part between underscores is forbidden,
    whatever the case."""
    words = F.array(*map(F.lit, forbidden))
    found = F.array_distinct(F.filter(json_keys(F.col(text)), lambda k: F.arrays_overlap(F.split(F.lower(k), "_"), words)))
    return df.select(*key, F.explode(found).alias("found"))


def true_keys(text: Column) -> Column:
    """All keys of a JSON text, at any depth, whose value is true. Strings are read one after the other, as
    json_keys does."""
    strings = F.regexp_extract_all(text, F.lit(_STRING + r"(?:(?<=:)\s*true\b)?"), F.lit(0))
    keys = F.filter(strings, lambda s: s.rlike(r":\s*true$"))
    return F.transform(keys, lambda k: F.get(F.from_json(F.concat(F.lit("["), F.regexp_replace(k, r"\s*:\s*true$", ""), F.lit("]")), "array<string>"), F.lit(0)))


def affirmative_claims(df: DataFrame, key: Sequence[str], text: str, claims: Sequence[str]) -> DataFrame:
    """key, found: the JSON keys, at any depth and whatever the case, that are among the claims and true."""
    names = [c.lower() for c in claims]
    found = F.array_distinct(F.filter(true_keys(F.col(text)), lambda k: F.lower(k).isin(names)))
    return df.select(*key, F.explode(found).alias("found"))


def rows_digest(hashes: Column) -> Column:
    """Digest of an array of (index, hash) in order."""
    return F.sha2(F.concat_ws("\n", F.transform(F.sort_array(hashes), lambda s: s["_h"])), 256)


def chunk_receipts(df: DataFrame, index: str, row: Sequence[str], size: int = 128) -> DataFrame:
    """What a build of each chunk states: chunk, first, last, n, digest of its rows in order of index.
    A chunk holds `size` indices, which bounds what a digest gathers while indices are unique."""
    return _chunks(df, index, row, size).drop("_distinct")


def _chunks(df: DataFrame, index: str, row: Sequence[str], size: int) -> DataFrame:
    line = F.to_json(F.struct(*row), {"ignoreNullFields": "false"})
    rows = df.select(F.col(index).alias("_i"), F.floor(F.col(index) / size).alias("chunk"), F.sha2(line, 256).alias("_h"))
    by = rows.groupBy("chunk").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("_i", "_h")).alias("_l"))
    return by.select("chunk", "first", "last", "n", rows_digest(F.col("_l")).alias("digest"), F.size(F.array_distinct(F.col("_l._i"))).alias("_distinct"))


def receipt_violations(rows: DataFrame, receipts: DataFrame, index: str, row: Sequence[str], size: int = 128) -> DataFrame:
    """chunk, problem of an assembly: chunks without a receipt, or with several; receipts of no chunk;
    another range, count or digest than the rows give; indices that are there more than once (which is what
    packages that overlap leave); a gap to the chunk before; a chunk that isn't full before the last."""
    have = _chunks(rows, index, row, size)
    stated = receipts.groupBy("chunk").agg(F.count(F.lit(1)).alias("_times"), *(F.min(c).alias(f"_{c}") for c in ("first", "last", "n", "digest")))
    ends = have.agg(F.min("chunk").alias("_least"), F.max("chunk").alias("_most"))  # one row
    before = have.select((F.col("chunk") + 1).alias("chunk"), F.col("last").alias("_before"))
    # a chunk that isn't there leaves a gap to the one behind it
    gap = (F.col("chunk") > F.col("_least")) & F.coalesce(F.col("first") > F.col("_before") + 1, F.lit(True))
    placed = have.crossJoin(F.broadcast(ends)).join(before, "chunk", "left").withColumns({"_gap": gap, "_short": (F.col("chunk") < F.col("_most")) & (F.col("n") < size)})
    both = placed.join(stated, "chunk", "full")
    rules = {
        "no receipt": F.col("_times").isNotNull(), "no rows": F.col("n").isNotNull(), "repeated receipt": F.coalesce(F.col("_times") == 1, F.lit(True)),
        "range": F.coalesce((F.col("first") == F.col("_first")) & (F.col("last") == F.col("_last")), F.lit(True)), "count": F.coalesce(F.col("n") == F.col("_n"), F.lit(True)),
        "digest": F.coalesce(F.col("digest") == F.col("_digest"), F.lit(True)), "gap": F.coalesce(~F.col("_gap"), F.lit(True)), "repeated index": F.coalesce(F.col("_distinct") == F.col("n"), F.lit(True)),
        "short": F.coalesce(~F.col("_short"), F.lit(True)),
    }
    return row_violations(both, ["chunk"], rules).withColumnRenamed("rule", "problem")


def assembly_violations(rows: DataFrame, packages: DataFrame, plan: DataFrame, index: str, row: Sequence[str], range_rows: int = blocks.ROWS) -> DataFrame:
    """dataset, package, problem of an assembly of packages that were published one by one.

    rows: package, dataset, an index and what a row says. packages: dataset, package, first, last, n, digest,
    as each states them. plan: dataset, package, first, last, as they should be; between the least first and the
    greatest last of a dataset's plan every index is wanted once. Problems of a package: missing, foreign,
    repeated, another range than the plan's, no rows, rows of another dataset, indices that are repeated, not
    there (holes), or outside its range, another count or digest than its rows give; rows of a package that is
    not stated. Problems between packages, from a sweep over the stated ranges: overlap with and gap to what
    lies before. A digest gathers a package's rows, which the plan bounds."""
    line = F.to_json(F.struct(*row), {"ignoreNullFields": "false"})
    each = rows.select(F.col("package").alias("_p"), F.col("dataset").alias("_d"), F.col(index).cast("long").alias("_i"), F.sha2(line, 256).alias("_h"))
    have = each.groupBy(F.col("_p").alias("package")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low"), F.max("_i").alias("_high"), F.size(F.collect_set("_i")).alias("_distinct"), F.min("_d").alias("_least"), F.max("_d").alias("_most"),
        rows_digest(F.collect_list(F.struct("_i", "_h"))).alias("_digest"), F.count_if(F.col("_d").isNull()).alias("_unnamed"),
    )
    stated = packages.groupBy("package").agg(F.count(F.lit(1)).alias("_times"), *(F.min(c).alias(c) for c in ("dataset", "first", "last", "n", "digest")))
    wanted = plan.select("package", F.col("dataset").alias("_dataset"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    all_of = stated.join(wanted, "package", "full").join(have, "package", "full")
    holds = lambda ok: F.coalesce(ok, F.lit(True))
    known, there = F.col("_times").isNotNull(), F.col("_n").isNotNull()
    rules = {
        "missing": known | F.col("_dataset").isNull(), "foreign": ~known | F.col("_dataset").isNotNull(), "not stated": known | ~there, "repeated": holds(F.col("_times") == 1),
        "plan": holds((F.col("dataset") == F.col("_dataset")) & (F.col("first") == F.col("_first")) & (F.col("last") == F.col("_last"))), "no rows": ~known | there,
        "dataset": holds((F.col("_least") == F.col("dataset")) & (F.col("_most") == F.col("dataset")) & (F.col("_unnamed") == 0)), "repeated index": holds(F.col("_distinct") == F.col("_n")),
        "holes": holds(F.col("_high") - F.col("_low") + 1 == F.col("_distinct")), "range": holds((F.col("_low") == F.col("first")) & (F.col("_high") == F.col("last"))),
        "count": holds(F.col("n") == F.col("_n")), "digest": holds(F.col("digest") == F.col("_digest")),
    }
    out = row_violations(all_of.withColumn("_of", F.coalesce("dataset", "_dataset", "_least")), ["_of", "package"], rules).select(F.col("_of").alias("dataset"), "package", F.col("rule").alias("problem"))
    swept = blocks.reached(packages.select("dataset", "package", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")), ["dataset"], ["first", "last", "package"], "last", "_reached", range_rows)
    ends = plan.groupBy(F.col("dataset").alias("_d")).agg(F.min("first").alias("_begin"), F.max("last").alias("_end"))
    met = swept.join(ends, F.col("dataset") == F.col("_d"), "left")
    gap = F.col("first") > F.coalesce(F.col("_reached"), F.col("_begin") - 1) + 1
    between = row_violations(met, ["dataset", "package"], {"overlap": holds(F.col("first") > F.col("_reached")), "gap": holds(~gap)})
    tail = packages.groupBy(F.col("dataset").alias("_of")).agg(F.max("last").alias("_last"))
    open_end = ends.join(tail, F.col("_d") == F.col("_of"), "left").where(F.coalesce(F.col("_last") < F.col("_end"), F.lit(True)))
    return out.unionByName(between.withColumnRenamed("rule", "problem")).unionByName(open_end.select(F.col("_d").alias("dataset"), F.lit(None).cast("string").alias("package"), F.lit("gap").alias("problem")))


def assembled(rows: DataFrame, packages: DataFrame, plan: DataFrame, index: str, row: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of all packages and the ledger (a row a package, in the plan's terms), or an error that
    names the first problems."""
    found = assembly_violations(rows, packages, plan, index, row).limit(5).collect()
    if found:
        raise ValueError("assembly refused: " + "; ".join(f"{r['dataset']}/{r['package']}: {r['problem']}" for r in found))
    ledger = packages.select("dataset", "package", "first", "last", "n", "digest", F.sha2(F.to_json(F.struct("dataset", "package", "first", "last", "n", "digest")), 256).alias("receipt_sha256"))
    return rows, ledger


def hypotheses(tables: Mapping[str, tuple[DataFrame, Column, float]]) -> DataFrame:
    """Evidence by hypothesis: hypothesis, measure, threshold, supported (the measure reaches the
    threshold; null without a measure). Each gives a table, an aggregate over it, and its threshold."""
    out = None
    for name, (df, measure, threshold) in tables.items():
        one = df.agg(measure.cast("double").alias("measure")).select(F.lit(name).alias("hypothesis"), "measure", F.lit(float(threshold)).alias("threshold"), (F.col("measure") >= threshold).alias("supported"))
        out = one if out is None else out.unionByName(one)
    return out


def decision(evidence: DataFrame, flag: str = "supported") -> DataFrame:
    """All of the flags, with a null counting as false: n, passed, failed, verdict."""
    ok = F.coalesce(F.col(flag), F.lit(False))
    return evidence.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("verdict"))


def order_violations(df: DataFrame, stream: str, index: str, value: str, rows: int = blocks.ROWS) -> DataFrame:
    """stream, index, problem: rows whose value is `repeated` from the row before, in order of the index, or
    `unordered`, below it or null. A stream of more than `rows` rows is looked at in parts."""

    def judged(d: DataFrame, by: Sequence[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(index)
        first = F.row_number().over(order) == 1
        before = F.lag(value).over(order)
        problem = F.when(F.col(value).isNull(), "unordered").when(first | before.isNull() | (F.col(value) > before), F.lit(None)).when(F.col(value) == before, "repeated").otherwise("unordered")
        return d.withColumn("problem", problem)

    calm, long = blocks.split(df.select(stream, index, value), [stream], rows)
    out = judged(calm, [stream])
    if long is not None:
        parts = blocks.with_halo(blocks.dealt(long, [stream], [index], rows), [stream], [index], 2)
        out = out.unionByName(judged(parts, [stream, "_part"]).where("NOT _halo").drop("_part", "_halo"))
    return out.where("problem IS NOT NULL").select(stream, index, "problem")


def composed(found: Mapping[str, DataFrame]) -> DataFrame:
    """gate, subject, problem of several gates: subject is the JSON of what a gate names a violation by, problem
    its last column (problem, rule or found)."""
    out = None
    for name, rows in found.items():
        *keys, problem = rows.columns
        subject = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")
        one = rows.select(F.lit(name).alias("gate"), subject.alias("subject"), F.col(problem).cast("string").alias("problem"))
        out = one if out is None else out.unionByName(one)
    return out


def acceptance(found: Mapping[str, DataFrame]) -> DataFrame:
    """gate, n, accepted: a row for each gate and one, gate null, for the package, which is accepted where no
    gate found anything."""
    rows = composed(found)
    names = rows.sparkSession.createDataFrame([(n,) for n in found], "gate string")
    by = names.join(rows.groupBy("gate").agg(F.count(F.lit(1)).alias("_n")), "gate", "left").select("gate", F.coalesce("_n", F.lit(0)).alias("n"))
    whole = by.agg(F.lit(None).cast("string").alias("gate"), F.sum("n").alias("n"))
    return by.unionByName(whole).select("gate", "n", (F.col("n") == 0).alias("accepted"))


def registration(packages: DataFrame, members: DataFrame) -> DataFrame:
    """packages: dataset, bytes, sha256, expected_bytes, expected_sha256. members: dataset, member_index, path,
    bytes. By dataset of either: members and their bytes, first and last path, and the problems: drift of size or
    hash, no members, a package that isn't registered, members whose paths don't rise in order of their index."""
    by = members.groupBy(F.col("dataset").alias("_d")).agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("bytes")).alias("member_bytes"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    odd = order_violations(members, "dataset", "member_index", "path").groupBy(F.col("dataset").alias("_o")).agg(F.count(F.lit(1)).alias("_odd"))
    both = packages.join(by, F.col("dataset") == F.col("_d"), "full").withColumn("dataset", F.coalesce("dataset", "_d")).join(odd, F.col("dataset") == F.col("_o"), "left")
    drift = ~(F.col("bytes").eqNullSafe(F.col("expected_bytes")) & F.col("sha256").eqNullSafe(F.col("expected_sha256")))
    known = F.col("expected_sha256").isNotNull()
    problems = F.array_compact(F.array(F.when(known & drift, "drift"), F.when(F.col("members").isNull(), "no members"), F.when(~known, "not registered"), F.when(F.col("_odd") > 0, "order")))
    return both.select("dataset", F.coalesce("members", F.lit(0)).alias("members"), "member_bytes", "first_path", "last_path", problems.alias("problems"))
