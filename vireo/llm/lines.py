"""Line deduplication: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Lines travel as two 64-bit hashes of their key, never as text; the texts are shuffled once, to meet the positions
that they lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, forget, let, lowered, renamed, settled, table


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without its repeated lines, one row for each row of ``docs``.

    With ``carry``, also the other columns as a struct of that name.

    A line's key is the line without blanks at both ends, A-Z lower-cased. A key of at least ``min_chars`` code points
    found under at least ``min_docs`` different ids loses all its lines except those of the largest id that holds it.
    Null or empty text is one empty line; a text that loses every line becomes empty. Lines of rows with a null id count
    for no document and are dropped like others. Rows that repeat an id are one document for the count. An empty table
    gives no rows.
    """
    kept = [] if carry is None else [carry]
    rest = [] if carry is None else [F.struct(F.lit(0).alias("__none"), *(F.col(c) for c in docs.columns if c not in (id_col, text_col))).alias(carry)]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest)
    d = d.withColumn("lines", F.split("text", "\n"))
    keys = F.transform("lines", lambda x: lowered(F.btrim(x, F.lit(BLANKS))))
    long_ones = F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("pos"), k.alias("k"))), lambda e: F.char_length(e["k"]) >= min_chars)
    hashed = F.transform(long_ones, lambda e: F.struct(e["pos"].alias("pos"), F.xxhash64(e["k"]).alias("a"), F.xxhash64(F.lit("2"), e["k"]).alias("b")))
    lines = settled(d.select("doc_id", F.xxhash64("text").alias("body"), F.explode(hashed).alias("e")).select("doc_id", "body", "e.pos", "e.a", "e.b"), "lines")
    # Spark first makes (key, id) distinct, dealt by both, so that a line of a third of all documents is no hot task.
    often = lines.groupBy("a", "b").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("a", "b", "last")
    gone = lines.join(often, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy("doc_id", "body").agg(F.collect_set("pos").alias("drop"))
    gone = settled(gone.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), "drop"), "gone")
    forget(lines)

    def rebuilt(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    # Texts meet their positions by (id, hash of the text): rows that repeat an id keep their own positions.
    out = d.drop("lines").withColumn("body", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__body")), "left")
    return out.select(
        "doc_id", *kept, F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rebuilt)).alias("text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its text deduplicated; n_chars, where there is one, follows the new text.

    A null text becomes an empty one; rows that repeat an id and null ids are as in ``dedup_lines``; an empty table stays
    empty; other columns go through whatever their names.
    """
    d, own_names = renamed(docs, "doc_id", "text", "n_chars")
    out = dedup_lines(d, carry="__rest")
    made = {"text": F.col("text"), "doc_id": F.col("doc_id"), "n_chars": F.char_length("text").cast(d.schema["n_chars"].dataType if "n_chars" in d.columns else "long")}
    return own_names(out.select(*(made.get(c, F.col(f"__rest.{c}")).alias(c) for c in d.columns)))


OP9_SQL = r"""
WITH l AS (SELECT r, doc_id, generate_subscripts(s, 1) AS p, unnest(s) AS line
           FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
often AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT r, doc_id, p, line, last IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
