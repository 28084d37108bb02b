"""Vector code compression by product quantisation with equal-average search
(operator 12).

Components become integers floor(scale * x); a vector is cut into ``parts``
equal consecutive parts, and every part position has a codebook of at most
``entries`` entries.  Training alternates assignment and update: one pass over
the vectors per round, in which each task adds up its parts per entry and
sends one partial sum per (position, entry, component); what comes back to the
driver is the codebooks, whose size is set by the parameters.

Equal-average search.  By Cauchy and Schwarz the squared distance of a part x
and an entry c of d components is at least (sum x - sum c)^2 / d.  The entries
are sorted by their sums, and the search starts where the part's own sum
belongs and goes outward on both sides; a side ends when (sum gap)^2 > d * best
distance.  It must be strictly greater, so that an entry at the same distance
with a lower index is still met.  Parts are taken in the order of their sums,
a tile at a time, and each step compares the still open parts of a tile with
the next block of entries on one side by one matrix product; the bound itself
is tested per part.

All arithmetic is on integers: exact in float64 while every intermediate value
stays below 2^53, else in 64-bit integers.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped, as the contract says; empty tables give an empty
result; repeated rows are coded each, and rows of equal id stand in the order
of their components when the first entries are chosen (null ids last).  The
dimension is that of the first row in that order whose length is a positive
multiple of ``parts``; a row of another length keeps null code and error, and
trains nothing.  Components so large that their squared distances may not fit
in a long are an error.  Other columns are dropped; names of
theirs cannot clash, as rows travel as (id, label, vector).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import BROADCAST_ROWS, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 31        # of a scaled component
TILE, BLOCK = 512, 16    # parts and entries compared at a time
SALT = 32                # pieces of a label's rows when the label sums are too many to broadcast


class Codebook:
    """Entries of one part position, ready for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries                              # index order
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")        # equal-average order
        self.sums, self.sorted = sums[self.order], entries[self.order]
        self.squares = (self.sorted ** 2).sum(axis=1)
        self.largest = int(np.abs(entries).max(initial=0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties to the lower one) and its squared
        distance, for every row of the integer array ``x``."""
        n, d = x.shape
        big = max(self.largest, int(np.abs(x).max(initial=0)))
        bound = 4 * d * d * big * big                       # of d times a squared distance
        if bound >= 2 ** 63:
            raise ValueError("components are too large for squared distances in a long")
        kind = np.float64 if bound < 2 ** 53 else np.int64
        entries, squares = self.sorted.astype(kind), self.squares.astype(kind)
        sums = x.sum(axis=1)
        by_sum = np.argsort(sums, kind="stable")
        index, best = np.full(n, len(entries), dtype=np.int64), np.full(n, -1, dtype=kind)
        for at in range(0, n, TILE):
            rows = by_sum[at:at + TILE]
            index[rows], best[rows] = self._tile(x[rows].astype(kind), sums[rows].astype(kind), entries, squares, d)
        return index, best.astype(np.int64)

    def _tile(self, x, sums, entries, squares, d):
        k, own = len(entries), (x * x).sum(axis=1)
        best = np.full(len(x), np.iinfo(np.int64).max // 2, dtype=x.dtype)
        index = np.full(len(x), k, dtype=np.int64)
        middle = int(np.searchsorted(self.sums, sums[len(sums) // 2]))
        lo, hi = max(0, middle - BLOCK // 2), min(k, middle + BLOCK // 2)
        self._compare(x, own, entries, squares, lo, hi, best, index, slice(None))
        while lo > 0 or hi < k:
            if hi < k:
                gap = self.sums[hi] - sums           # grows with every further entry once it is positive
                rows = np.flatnonzero((gap <= 0) | (gap * gap <= d * best))
                end = min(k, hi + BLOCK) if len(rows) else k
                if len(rows):
                    self._compare(x[rows], own[rows], entries, squares, hi, end, best, index, rows)
                hi = end
            if lo > 0:
                gap = sums - self.sums[lo - 1]
                rows = np.flatnonzero((gap <= 0) | (gap * gap <= d * best))
                end = max(0, lo - BLOCK) if len(rows) else 0
                if len(rows):
                    self._compare(x[rows], own[rows], entries, squares, end, lo, best, index, rows)
                lo = end
        return index, best

    def _compare(self, x, own, entries, squares, lo, hi, best, index, rows):
        if hi <= lo:
            return
        # entries in index order, so that the first minimum is the lowest index
        at = lo + np.argsort(self.order[lo:hi], kind="stable")
        dist = (own[:, None] + squares[at]) - 2 * (x @ entries[at].T)
        j = dist.argmin(axis=1)
        found, name = dist[np.arange(len(x)), j], self.order[at[j]]
        held, known = best[rows], index[rows]
        better = (found < held) | ((found == held) & (name < known))
        best[rows], index[rows] = np.where(better, found, held), np.where(better, name, known)


def _vectors(column: pa.Array, scale: int, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the column that have ``dim`` components, and their integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim or 0), dtype=np.int64)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ints = np.floor(flat * scale)
    if np.abs(ints).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return rows, ints.astype(np.int64).reshape(len(rows), dim)


def usable(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector) of the rows whose vector has only finite components."""
    rows = df.select(df[id_col].alias("id"), df[label].alias("label"), df[vector].cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> tuple[int, list[np.ndarray]]:
    """The dimension, and per position the parts of the ``entries`` smallest
    ids (a top-k by the rows' order, of a size set by the parameters)."""
    order = (F.col("id").asc_nulls_last(), F.col("vector"))
    fit = rows.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    dim = [len(r.vector) for r in fit.orderBy(*order).limit(1).collect()]
    if not dim:
        return 0, []
    first = fit.filter(F.size("vector") == dim[0]).orderBy(*order).limit(entries).select("vector").collect()
    _, v = _vectors(pa.array([r.vector for r in first], type=pa.list_(pa.float64())), scale, dim[0])
    return dim[0], np.split(v, parts, axis=1)


def _partial_sums(rows: DataFrame, books, dim: int, scale: int) -> DataFrame:
    """(part, entry, at, n, total) of every task: number of parts assigned to
    an entry and sums of their components."""
    schema = "part int, entry int, at int, n bigint, total bigint"

    def run(batches):
        code = [Codebook(b) for b in books.value]
        k, d = code[0].entries.shape
        total, n = np.zeros((len(code), k, d), dtype=np.int64), np.zeros((len(code), k), dtype=np.int64)
        for b in batches:
            _, v = _vectors(b.column(0), scale, dim)
            for p, c in enumerate(code):
                x = v[:, p * d:(p + 1) * d]
                to, _ = c.nearest(x)
                by = np.argsort(to, kind="stable")
                used, begin = np.unique(to[by], return_index=True)
                if len(used):
                    total[p][used] += np.add.reduceat(x[by], begin, axis=0)
                    n[p] += np.bincount(to, minlength=k)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(part, d).astype(np.int32)), pa.array(np.repeat(entry, d).astype(np.int32)),
            pa.array(np.tile(np.arange(d, dtype=np.int32), len(part))), pa.array(np.repeat(n[part, entry], d)),
            pa.array(total[part, entry].ravel())], names=["part", "entry", "at", "n", "total"])

    return rows.select("vector").mapInArrow(run, schema)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          scale: int = SCALE) -> tuple[int, list[np.ndarray]]:
    """The dimension and the final codebooks (integer arrays) of ``usable`` rows."""
    spark = rows.sparkSession
    dim, books = first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds if dim else 0):
        sent = spark.sparkContext.broadcast(books)
        sums = _partial_sums(rows, sent, dim, scale).groupBy("part", "entry", "at").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():       # parts * entries * components values at most
            books[r.part][r.entry, r.at] = int(r.total) // r.n
    return dim, books


def codebook_digest(books) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, dim: int, books, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error) of ``usable`` rows: two hexadecimal digits per
    part (more if the codebooks have more than 256 entries)."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}")) if books else 2
    schema = T.StructType([rows.schema["id"], rows.schema["label"],
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        code = [Codebook(b) for b in sent.value]
        hexes = [f"{i:0{digits}x}" for i in range(len(code[0].entries) if code else 0)]
        for b in batches:
            text, error = [None] * b.num_rows, [None] * b.num_rows
            if code:
                at, v = _vectors(b.column(2), scale, dim)
                d = dim // len(code)
                found = [c.nearest(v[:, p * d:(p + 1) * d]) for p, c in enumerate(code)]
                whole = sum(f[1] for f in found).tolist()
                for row, e, *i in zip(at.tolist(), whole, *(f[0].tolist() for f in found)):
                    text[row], error[row] = "".join([hexes[j] for j in i]), e
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, type=pa.string()), pa.array(error, type=pa.int64())],
                names=["id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the sum of ``error`` over equal labels (nulls together).  Few
    labels are broadcast after counting them; more are joined over salted
    labels, so that a label with a third of all rows is split."""
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"), "label-error")
    if sums.count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("same")), "left").drop("same")
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALT)).cast("int")
    many = sums.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return coded.withColumn("salt", salt).join(
        many, F.col("label").eqNullSafe(F.col("same")) & (F.col("salt") == F.col("salted")), "left").drop("same", "salt", "salted")


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error, label_error), staged, and the codebooks."""
    ship_package(df.sparkSession)
    rows = usable(df, id_col, vector, label)
    dim, books = train(rows, parts, entries, rounds, scale)
    return with_label_error(stage(encode(rows, dim, books, scale), "vector-codes")), books
