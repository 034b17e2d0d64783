"""Rule bitmask ledger: every rule is evaluated once per document and stored as a bit beside its measurements.

A policy is a version name and a set of rules, so a mask. Applying a policy, comparing two and asking what each rule
adds are bitwise operations on the ledger; the texts are not read again. Only SQL functions are used, all of them
within the row, so the ledger itself needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, let, table, words_of

SYMBOLS = "#*$%&|<>"

#: Rule names in bit order, each with the condition under which it fails. Thresholds follow published web-corpus filters.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    "capitals": "10 * n_capitals > 3 * word_chars",
    "shouting": "10 * n_shouts > n_words",
}
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(RULES)}


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _hashes(words: Column) -> Column:
    """A 64-bit hash of each 3-word window."""
    windows = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _repeats(values: Column) -> Column:
    """The values found twice or more, sorted."""
    return let(F.sort_array(values), lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1)))


def _covered(hashes: Column) -> Column:
    """Words in windows found twice or more: windows sorted by hash, those equal to a neighbour, their distinct positions."""
    places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = let(places, lambda s: F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"])))
    return F.size(F.array_distinct(F.flatten(F.transform(same, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))


def _repeat_words(words: Column) -> Column:
    """Positions are sought only where a window comes back at all."""
    return let(words, lambda w: let(_hashes(w), lambda h: F.when(F.size(_repeats(h)) == 0, F.lit(0)).otherwise(_covered(h))))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id and the measurements, one row for each row of ``docs``; with the whole row as a struct under ``carry``.

    Null text measures as empty: every count is 0. Lines split at \\n; only lines with a word count. Windows are of
    three words, compared by a 64-bit hash within the document. Repeated ids are measured row by row. An empty table gives
    no rows.
    """
    kept = [] if carry is None else [carry]
    row = [] if carry is None else [F.struct("*").alias(carry)]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *row)
    d = d.select(
        "doc_id", *kept,
        words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
        (F.char_length("text") - _removed(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        _removed(F.col("text"), SYMBOLS).alias("n_symbols"),
        _removed(F.col("text"), UPPER).alias("n_capitals"),
        F.floor((F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_shouts"),
    )
    return d.select(
        "doc_id", *kept, F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_capitals", "n_shouts",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None, carry: str | None = None) -> DataFrame:
    """Measurements and ``failed``, a bigint whose bit k says that the k-th rule failed."""
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, cond in enumerate((rules or RULES).values())]
    return measure(docs, id_col, text_col, carry).withColumn("failed", sum(bits[1:], bits[0]))


def mask(names: tuple[str, ...], rules: dict[str, str] | None = None) -> int:
    order = list(rules or RULES)
    return sum(1 << order.index(n) for n in names)


def judge(book: DataFrame, policy: str = "v1", kept: str = "kept") -> DataFrame:
    """The ledger with a verdict: kept if no rule of the policy failed."""
    return book.withColumn(kept, F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that the policy without it would keep.

    The ledger is first counted by mask (at most 2 to the number of rules groups, combined before the shuffle).
    """
    m = mask(POLICIES[policy])
    by_mask = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]))
    rows = by_mask.select("m", "n", F.explode(rules).alias("r")).select("m", "n", "r.rule", "r.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    only = F.col("m") == F.col("bit")
    return rows.groupBy("rule").agg(
        F.sum("n").alias("n_documents"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(only, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = judge(judge(ledger(table(spark, sf_dir, "documents")), "v1"), "base", "base_kept")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the v1 policy keeps, each judged by its own text; nothing is shuffled.

    Null and empty texts have too few words and go; rows that repeat, and null ids, are judged like others; an empty table
    stays empty; other columns go through whatever their names.
    """
    return judge(ledger(docs, carry="__row")).where("kept").select("__row.*")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
v AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, g FROM v GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM v JOIN again USING (r, g)) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
    (length(text) - length(replace(text, '!!', ''))) // 2 AS n_shouts,
    list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
f AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines FROM m),
b AS (SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_capitals > 3 * word_chars THEN 32 ELSE 0 END + CASE WHEN 10 * n_shouts > n_words THEN 64 ELSE 0 END AS bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed FROM b
"""
