"""Quality rules over whole texts, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed. For every host, the number
of distinct documents that hold a line is counted; copies of one text count as one document, so that
a much-copied page doesn't condemn its own lines (`count_copies` counts each of them). A line in more than
max(limit_docs, limit_share * distinct documents of the host) documents is removed, and a document
that keeps under least_share of its words or under least_words words after that is rejected.

All counting is by grouping with partial sums; a host with a third of all rows is no hot key there, for
the line hash or the text's digest is part of each key. Two joins can meet a hot one: a line that a third
of all texts hold, on the side of the texts' lines, and a text that a third of all rows hold, on the side
of the rows; the other side has one row for it, so adaptive execution can split them. Only narrow rows are
shuffled, never texts.

Edge cases: null and blank texts have no words and fail the base rules; a null host is a host of its
own; repeated rows are each judged; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SPACE_CHARS, SPACES, lower_ascii, stage, words

#: The characters that count as symbols: fixed values.
SYMBOLS = "#*$%&|<>"


def _count_of(text: Column, characters: str) -> Column:
    """Occurrences of some one-byte characters: what each one's removal shortens the text by."""
    out = F.lit(0)
    for c in characters:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out.cast("long")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, text_md5, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated 3-word windows are found by sorting one 64-bit number a window: the high bits of its hash,
    and its place in as many low bits as the text needs. Neighbours with equal high bits are compared
    word by word, then the covered words are counted from the sorted places."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("_text")).select("*", words(F.col("_text")).alias("_w"), F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("_lines"))
    # bit width of the places
    rows = rows.withColumn("_bits", F.ceil(F.log2(F.size("_w") + F.lit(2.0))).cast("int"))
    rows = rows.withColumn(
        "_codes",
        F.expr(
            "CASE WHEN size(_w) < 3 THEN array(CAST(0 AS BIGINT)) ELSE sort_array(transform(sequence(0, size(_w) - 3),"
            " i -> shiftleft(shiftrightunsigned(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _bits), _bits) | i)) END"
        ),
    )
    same = "(shiftrightunsigned(_codes[k], _bits) = shiftrightunsigned(_codes[k - 1], _bits) AND _same(k))"
    place = lambda k: f"CAST(_codes[{k}] & (shiftleft(1L, _bits) - 1) AS INT)"
    equal = " AND ".join(f"_w[{place('k')} + {j}] = _w[{place('k - 1')} + {j}]" for j in range(3))
    same = same.replace("_same(k)", f"({equal})")
    # places of windows equal to a neighbour: runs of equal windows stand together
    rows = rows.withColumn("_twins", F.expr(f"CASE WHEN size(_codes) < 2 THEN array() ELSE filter(sequence(1, size(_codes) - 1), k -> {same}) END"))
    rows = rows.withColumn("_spots", F.expr(f"CASE WHEN size(_twins) = 0 THEN array() ELSE sort_array(array_distinct(flatten(transform(_twins, k -> array({place('k')}, {place('k - 1')}))))) END"))
    covered = F.expr("CAST(CASE WHEN size(_spots) = 0 THEN 0 ELSE 3 + aggregate(sequence(1, size(_spots)), 0, (s, k) -> s + CASE WHEN k < size(_spots) THEN least(3, _spots[k] - _spots[k - 1]) ELSE 0 END) END AS BIGINT)")
    return rows.select(
        "doc_id", "host", F.md5(F.encode("_text", "UTF-8")).alias("text_md5"), F.size("_w").cast("long").alias("n_words"),
        (F.char_length("_text") - _count_of(F.col("_text"), SPACE_CHARS)).cast("long").alias("word_chars"), _count_of(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
    )


def _md5_of(text_col: str) -> Column:
    return F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))


def _normal(line: Column) -> Column:
    return F.regexp_replace(F.btrim(lower_ascii(line), F.lit(SPACE_CHARS)), SPACES, " ")


def _copies(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """_h, _m, _copies: how many documents of a host hold each text."""
    return docs.select(F.col(host_col).alias("_h"), _md5_of(text_col).alias("_m")).groupBy("_h", "_m").agg(F.count(F.lit(1)).alias("_copies"))


def _lines_of_texts(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """host, line, text_md5, _all_n: the words in a line of a distinct text, over all copies of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(host_col).alias("host"), _md5_of(text_col).alias("text_md5"), F.explode(F.split(text, "\n")).alias("_line"))
    lines = lines.select("host", "text_md5", _normal(F.col("_line")).alias("_line")).where("_line != ''")
    hashed = lines.select("host", "text_md5", F.xxhash64("_line").alias("line"), F.size(F.split("_line", " ")).alias("_n"))
    # one row for each line of each distinct text; copies of a text give the same rows with larger sums
    # (written once, for it is read twice)
    return stage(hashed.groupBy("host", "line", "text_md5").agg(F.sum("_n").alias("_all_n")))


def _frequent(per_text: DataFrame, docs: DataFrame, limit_docs: int, limit_share: float, text_col: str, host_col: str, count_copies: bool) -> DataFrame:
    if count_copies:
        copies = _copies(docs, text_col, host_col)
        per_text = per_text.join(copies, F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_md5") == F.col("_m")))
        sizes, each = copies.groupBy(F.col("_h").alias("_host")).agg(F.sum("_copies").alias("host_docs")), F.sum("_copies")
    else:
        texts = docs.select(F.col(host_col).alias("_host"), _md5_of(text_col).alias("_md5")).distinct()
        sizes, each = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs")), F.count(F.lit(1))
    frequent = per_text.groupBy("host", "line").agg(each.alias("n_docs")).where(F.col("n_docs") > limit_docs)
    above = frequent.join(sizes, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n_docs") > limit_share * F.col("host_docs"))
    return above.select("host", "line", "n_docs")


def _hits(docs: DataFrame, limit_docs: int, limit_share: float, text_col: str, host_col: str, count_copies: bool) -> DataFrame:
    """The rows of _lines_of_texts whose line is frequent."""
    per_text = _lines_of_texts(docs, text_col, host_col)
    above = _frequent(per_text, docs, limit_docs, limit_share, text_col, host_col, count_copies).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    return per_text.join(above, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")), "left_semi")


def frequent_lines(docs: DataFrame, limit_docs: int = 32, limit_share: float = 0.05, text_col: str = "text", host_col: str = "source", count_copies: bool = False) -> DataFrame:
    """host, line (hash of the normalised line), n_docs: the lines to remove."""
    return _frequent(_lines_of_texts(docs, text_col, host_col), docs, limit_docs, limit_share, text_col, host_col, count_copies)


def frequent_line_words(docs: DataFrame, limit_docs: int = 32, limit_share: float = 0.05, text_col: str = "text", host_col: str = "source", count_copies: bool = False) -> DataFrame:
    """host, text_md5, _removed: for each distinct text of a host, the words in removed lines, over all
    copies of the text."""
    return _hits(docs, limit_docs, limit_share, text_col, host_col, count_copies).groupBy("host", "text_md5").agg(F.sum("_all_n").alias("_removed"))


def without_frequent_lines(docs: DataFrame, limit_docs: int = 32, limit_share: float = 0.05, text_col: str = "text", host_col: str = "source", count_copies: bool = False) -> DataFrame:
    """docs with each text rebuilt from its lines in order, without the frequent ones; a text that has
    none is left as it is, and no row is dropped."""
    gone = _hits(docs, limit_docs, limit_share, text_col, host_col, count_copies).groupBy(F.col("host").alias("_cut_host"), F.col("text_md5").alias("_cut_md5")).agg(F.collect_list("line").alias("_cut_lines"))
    joined = docs.join(gone, F.col(host_col).eqNullSafe(F.col("_cut_host")) & (_md5_of(text_col) == F.col("_cut_md5")), "left")
    left = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains("_cut_lines", F.xxhash64(_normal(x))))
    text = F.when(F.col("_cut_lines").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def line_frequency_rules(
    docs: DataFrame, limit_docs: int = 32, limit_share: float = 0.05, least_share: float = 0.5, least_words: int = 50,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", count_copies: bool = False,
) -> DataFrame:
    """One row per document: doc_id, the base counts, removed_words, base_failed, kept."""
    base = base_counts(docs, id_col, text_col, host_col)
    removed = frequent_line_words(docs, limit_docs, limit_share, text_col, host_col, count_copies)
    removed = removed.join(_copies(docs, text_col, host_col), F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_md5") == F.col("_m")))
    removed = removed.select(F.col("host").alias("_host"), F.col("text_md5").alias("_md5"), (F.col("_removed") / F.col("_copies")).cast("long").alias("_removed"))
    joined = base.join(removed, F.col("host").eqNullSafe(F.col("_host")) & (F.col("text_md5") == F.col("_md5")), "left").withColumn("removed_words", F.coalesce("_removed", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
