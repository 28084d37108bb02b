"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, stage_table

#: ASCII white space: space, tab, newline, vertical tab, form feed, carriage return.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"

#: Explicit broadcasts are given only to staged tables of at most this many
#: (narrow) rows; larger ones are joined through a shuffle.
BROADCAST_ROWS = 200_000


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage)."""
    return stage_table(df, label)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    return shared_folder(spark, label)


def broadcast_if_small(staged: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a staged table whose counted rows stay within the
    bound; above it the table is returned as it is and Spark shuffles."""
    return F.broadcast(staged) if staged.count() <= max_rows else staged


_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps from task to task (a tokenizer and what it
    has learnt), one thing at a time.  Spark gives a worker to one operator
    after another: what the last one left would lie beside the next one's."""
    if key not in _HELD:
        drop_held()
        _HELD[key] = make()
    return _HELD[key]


def drop_held() -> None:
    """Free what an operator left in this worker, back to the system where
    the C library can."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.
    A column that a lambda merely refers to is evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def apart(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it: what an
    operator adds to a table must not meet the table's own columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column, separators: str) -> Column:
    """The maximal runs of characters outside the class ``separators``."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"[{separators}]+", -1), "")


def sha256_utf8(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def cut_spans(text: Column, spans: Column, fill: str = "") -> Column:
    """``text`` with every [start, end) of the sorted ``spans`` (code points)
    replaced by ``fill``; a span inside an earlier one adds nothing."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], between, F.lit(fill))).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, begin, step, lambda a: F.concat(
        a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
