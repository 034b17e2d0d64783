"""What the operators share: the shared scratch folder, rereadable tables and word splitting.

Every operator reads only the columns it is told to use and renames them at once, so extra columns of any
name do no harm. Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which driver and
executors share; a lost executor is then replaced by reading the table again.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.sources.tables import shuffles_removed

#: White space of the word definition: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a local session has none (tests), a temporary one, set once."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vireo-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/vireo/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and readers need no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    for made in getattr(_made, "paths", [])[-1:]:
        made.append(path)
    return out


_made = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``settled`` writes within go at the end, but for those given to the function that this gives."""
    open_ones = _made.__dict__.setdefault("paths", [])
    open_ones.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.settled_at)
        return df

    try:
        yield keep
    finally:
        for path in open_ones.pop():
            if path not in kept:
                discard(spark, path)
            elif open_ones:
                open_ones[-1].append(path)


def forget(*tables: DataFrame | None) -> None:
    """Remove tables of ``settled`` that nothing will read again."""
    for df in tables:
        if df is not None:
            discard(df.sparkSession, df.settled_at)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``scratch`` that nothing will read again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """What a worker process has freed goes back to the system: idle workers stand beside the JVM in an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text stays null."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def renamed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with id and text as doc_id and text and all other columns under numbers, and what gives rows their own names back.

    ``more``: columns that keep their names. By place, so names with dots, quotes or repeats do no harm.
    """
    known = {id_col: "doc_id", text_col: "text"} | {c: c for c in more}
    names, taken = [], set()
    for k, c in enumerate(docs.columns):
        new = known.get(c)
        names.append(f"__{k}" if new is None or new in taken else new)
        taken.add(new)
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id written in decimal leaves that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row: Catalyst may otherwise copy it into every use, inner lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
