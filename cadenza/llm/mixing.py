"""Mixing sources to target weights by Sainte-Laguë apportionment.

Blocks of equal size are seats. A first apportionment gives each source its seats by the highest
quotients target / (2 s + 1); a second gives the seats of a source to its shards by their sizes, so
that each shard has an integer quota. A shard's documents stand in seeded order and form a stream
that is cut into blocks; a quota of more than one pass takes whole passes first, and then blocks in
seeded order until the quota is filled.

Everything after the words are counted is narrow: (document, source, size). A source that holds a
third of all rows is split into shards of bounded size; only per-source and per-shard totals meet: one
task ranks the sources, and one the shards of a source, of which there is one for about a million words
and rows.

Edge cases: null texts have size 0 and take 0; a null source is a source of its own, last in order;
repeated rows are separate documents; no document is taken more than `most_times` times its size; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import free_name, md5_int, n_words, stage, words


def capped_targets(sources: DataFrame, most_times: int = 3) -> DataFrame:
    """sources: source_no, source_size, weight. Adds target: all sizes shared by weight, none above
    most_times its size; what a cap frees goes to the others by weight.

    With sources in order of size / weight, the caps hold for a prefix of them, and the rest share
    what is left at one rate."""
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rated = sources.select(
        "*",
        ((F.sum("source_size").over(everything) - most_times * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)).alias("_rate"),
    )
    # the first place where the rate leaves the next source under its cap
    ruling = rated.withColumn("_ok", F.col("_rate") * F.col("weight") <= most_times * F.col("source_size"))
    rate = F.min_by(F.when(F.col("_ok"), F.col("_rate")), F.when(F.col("_ok"), F.struct(F.col("source_size") / F.col("weight"), F.col("source_no")))).over(everything)
    return ruling.withColumn("target", F.least(F.coalesce(rate * F.col("weight"), F.lit(float("inf"))), (most_times * F.col("source_size")).cast("double"))).drop("_rate", "_ok")


def sainte_lague(parties: DataFrame, by: Sequence[str], key: str, votes: Column, seats: Column) -> DataFrame:
    """Adds quota: `seats` (one number per group of `by`) given to the parties of a group by the
    highest quotients votes / (2 s + 1), ties to the lower key.

    Only quotients near the deciding one are ranked: with P parties, N seats and V votes, a divisor
    of V / (N - P/2) gives at most N seats and V / (N + P/2) at least N, so each party's quota lies
    between its rounded shares there; about four quotients a party remain."""
    group = Window.partitionBy(*by)
    shared = parties.withColumns({"_votes": votes.cast("double"), "_seats": seats.cast("long")}).withColumns({"_all": F.sum("_votes").over(group), "_n": F.count(F.lit(1)).over(group)})
    share = lambda side: F.col("_votes") * F.greatest(F.lit(0.0), F.col("_seats") + side * F.col("_n") / 2) / F.col("_all")
    bounded = shared.withColumns({
        "_low": F.when((F.col("_all") > 0) & (F.col("_seats") > 0), F.greatest(F.lit(0), F.floor(share(-1) + 0.5) - 1)).otherwise(0).cast("long"),
        "_high": F.when((F.col("_all") > 0) & (F.col("_seats") > 0), F.floor(share(1) + 0.5) + 1).otherwise(0).cast("long"),
    })
    spread = bounded.withColumn("_left", F.col("_seats") - F.sum("_low").over(group)).select(
        "*", F.explode_outer(F.when((F.col("_high") > F.col("_low")) & (F.col("_votes") > 0), F.sequence("_low", F.col("_high") - 1))).alias("_s")
    )
    ranked = spread.withColumn("_rank", F.when(F.col("_s").isNotNull(), F.row_number().over(group.orderBy((F.col("_votes") / (2 * F.col("_s") + 1)).desc_nulls_last(), key))))
    return ranked.groupBy(*parties.columns).agg((F.first("_low") + F.count_if(F.col("_rank") <= F.col("_left"))).alias("quota"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_times: int = 3, block: int = 256, least_blocks: int = 4096, shard_size: int = 1 << 20,
    seed: int = 7, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    weights go to the sources in code point order, null last, and repeat. A block has `block` words,
    or fewer in a corpus of under least_blocks such blocks. with_spans adds text_key (xxhash64 of the
    text), passes (how often the whole text is taken) and spans: (first word, words) of what one more
    pass takes."""
    # rows without an id are told apart by their texts
    key = F.xxhash64(F.col(text_col)) if with_spans else F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(0)
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("text_key")))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")).withColumn("source_no", no).withColumn("weight", weight)
    total = F.sum("source_size").over(Window.partitionBy())
    targets = capped_targets(totals, most_times).withColumns({"_total": total, "block": F.greatest(F.lit(1), F.least(F.lit(block), F.floor(total / least_blocks))).cast("long")})
    seated = sainte_lague(targets, [], "source_no", F.col("target"), F.round(F.col("_total") / F.col("block")))
    sources = stage(
        seated.select("source", "source_no", "source_size", "target", "block", F.col("quota").alias("_source_quota"), F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("source_rows")) / shard_size)).alias("_n_shards"))
    )

    known = sources.select(F.col("source").alias("_source"), "source_no", "_n_shards")
    placed = sized.join(known, sized["source"].eqNullSafe(known["_source"])).select("doc_id", "source", "size", "text_key", "source_no", md5_int(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("text_key").cast("string")))).alias("_order"), "_n_shards")
    placed = placed.withColumn("shard", F.col("_order") % F.col("_n_shards")).drop("_n_shards")
    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(shards.join(sources.drop("source"), "source_no"), ["source_no"], "shard", F.col("shard_size"), F.col("_source_quota"))
    cells = quotas.withColumn("_need", F.least(F.col("quota") * F.col("block"), most_times * F.col("shard_size"))).select(
        "source_no", "shard", "source_size", "target", "block",
        F.when(F.col("shard_size") > 0, F.floor(F.col("_need") / F.col("shard_size"))).otherwise(0).cast("long").alias("_passes"),
        F.when(F.col("shard_size") > 0, F.col("_need") % F.col("shard_size")).otherwise(0).cast("long").alias("_rest"),
    )

    stream = Window.partitionBy("source_no", "shard").orderBy("_order", "doc_id", "size", "text_key")
    laid = placed.join(cells, ["source_no", "shard"]).withColumns({"_end": F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(stream)})
    start = F.col("_end") - F.col("size")
    cut = laid.withColumn("_start", start).select("*", F.explode(F.expr("sequence(_start div block, greatest(_start div block, (_end - 1) div block))")).alias("_block"))
    over = F.greatest(F.lit(0), F.least(F.col("_end"), (F.col("_block") + 1) * F.col("block")) - F.greatest(F.col("_start"), F.col("_block") * F.col("block")))
    drawn = Window.partitionBy("source_no", "shard").orderBy(md5_int(F.lit(seed), F.col("source_no"), F.col("shard"), F.col("_block")), "_block", "_nth").rowsBetween(Window.unboundedPreceding, 0)
    taken = cut.withColumn("_over", over).withColumn("_before", F.sum("_over").over(drawn) - F.col("_over"))
    part = F.greatest(F.lit(0), F.least(F.col("_over"), F.col("_rest") - F.col("_before")))
    taken = taken.withColumn("_part", part)
    first = F.greatest(F.lit(0), F.col("_block") * F.col("block") - F.col("_start"))
    spans = [F.sort_array(F.collect_list(F.when(F.col("_part") > 0, F.struct(first.alias("first"), F.col("_part").alias("n"))))).alias("spans")] if with_spans else []
    summed = taken.groupBy("source_no", "shard", "_nth", "doc_id", "source", "size", "text_key", "source_size", "target", "_passes").agg(F.sum("_part").alias("_part"), *spans)
    out = ["doc_id", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", (F.col("_passes") * F.col("size") + F.col("_part")).cast("long").alias("taken")]
    return summed.select(*out, *(["text_key", F.col("_passes").alias("passes"), "spans"] if with_spans else []))


def _numbered(met: DataFrame, single: DataFrame, name: dict[str, str], order: Sequence[str]) -> DataFrame:
    """single, with the rows that repeat id, source and text numbered in order of the other columns."""
    nth = F.row_number().over(Window.partitionBy(name["doc"], name["source"], name["key"]).orderBy(*(F.to_json(F.struct(F.col(c))) for c in order), F.lit(0)))
    repeated = F.size(name["plans"]) > 1
    return single.where(~repeated).unionByName(met.where(repeated).withColumn(name["place"], nth))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows that mix() takes, with the columns of docs: a document once for each whole pass, and
    once more with the words of its spans where a pass takes a part. n_chars, where docs has it, is the
    new text's length. Of rows that repeat id, source and text, the first in order of all their columns
    takes the first plan, and so on."""
    name = {n: free_name(docs, n) for n in ("doc", "source", "key", "passes", "spans", "plans", "rows", "words", "cut", "new", "n", "place")}
    plan = mix(docs, with_spans=True, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    each = F.struct("passes", "spans")
    plan = plan.groupBy(F.col("doc_id").alias(name["doc"]), F.col("source").alias(name["source"]), F.col("text_key").alias(name["key"])).agg(F.sort_array(F.collect_list(each)).alias(name["plans"]), F.max("taken").alias(name["n"])).where(F.col(name["n"]) > 0).drop(name["n"])
    plan = stage(plan)
    same = F.col(id_col).eqNullSafe(F.col(name["doc"])) & F.col(source_col).eqNullSafe(F.col(name["source"])) & (F.xxhash64(F.col(text_col)) == F.col(name["key"]))
    # by a shuffle at every size: the plan has no bound
    met = docs.join(plan.hint("merge"), same)
    single = met.withColumn(name["place"], F.lit(1))
    if not plan.where(F.size(name["plans"]) > 1).isEmpty():
        single = _numbered(met, single, name, [c for c in docs.columns if c != text_col])
    own = F.element_at(name["plans"], F.col(name["place"]))
    met = single.withColumns({name["passes"]: own["passes"], name["spans"]: own["spans"]})
    spans, word = F.col(name["spans"]), F.col(name["words"])
    copies = F.concat(F.array_repeat(F.lit(False), F.col(name["passes"]).cast("int")), F.when(F.size(spans) > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    each = met.select("*", words(F.col(text_col)).alias(name["words"]), F.explode(copies).alias(name["cut"]))
    cut = F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(word, (s["first"] + 1).cast("int"), s["n"].cast("int")))), " ")
    whole = F.size(word) == F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    each = each.withColumn(name["new"], F.when(F.col(name["cut"]) & ~whole, cut).otherwise(F.col(text_col)))
    return each.select(*(F.col(name["new"]).alias(c) if c == text_col else F.char_length(name["new"]).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))
