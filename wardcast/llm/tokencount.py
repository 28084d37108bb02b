"""Token counts with overlap resynchronisation (operator 13).

Texts of up to ``LONG`` code points are encoded whole.  A longer one is cut
into chunks that overlap their successors; the chunks are dealt over all
tasks and encoded with offsets, and each reports the ends of its pieces (what
the pre-tokenizer splits off, or an added token) inside its two overlaps with
the number of tokens up to there.

Proof of a splice.  The pieces of a text come from one scan from left to
right: where a piece begins, what follows depends on nothing before it.  A
chunk sees the text only up to its end, which can change a piece no more than
``margin`` = 2 + (the longest added token) code points before that end: a
contraction looks two characters ahead, a run of letters, digits, symbols or
white space one, an added token its own length.  So if chunk i is in step
with the whole text at some point, each of its later piece ends outside the
margin is one of the whole text's, and a chunk i+1 that has a piece end at the
same place is in step from there on.  Chunk 0 is in step at 0; hence by
induction every chunk whose overlaps all hold a common piece end is.  With p_i
the common end of seam i the whole text has

    tokens(last chunk) + sum_i (tokens of chunk i up to p_i - tokens of chunk i+1 up to p_i)

tokens: a sum over seams, taken by a partially aggregated group by, so that
the chunks of one document never have to meet in a task.  A document with a
seam without a common end (a word or a run of blanks longer than the overlap)
is cut again with overlaps and chunks ``WIDEN`` times as long, until none is
left; a chunk as long as the text has no seam, so this ends.

Defined results: null text is the empty text (0 bytes, 0 tokens); repeated
rows are counted each; an empty table gives an empty result; the columns named
in ``keep`` are passed through, all others are dropped; a kept column named
like an output is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .bytelevel import check_byte_level, encoder_for
from .common import broadcast_if_small, stage

LONG = 32_768      # code points; longer texts are cut
CHUNK = 16_384     # code points from one chunk's start to the next's
OVERLAP = 256      # code points a chunk reaches into the next
WIDEN = 4          # factor of both for documents with a seam that did not align
OUTPUTS = ("n_bytes", "n_tokens", "over_limit")


def piece_ends(encoding, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces (code points of the whole text) and the number of
    tokens up to each."""
    words = np.array(encoding.word_ids, dtype=np.int64)
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(np.append(words[1:] != words[:-1], True))
    offsets = encoding.offsets
    return np.array([offsets[i][1] for i in last.tolist()], dtype=np.int64) + start, last + 1


def chunk_summary(encoder, text: str, start: int, chunk: int, overlap: int, size: int, margin: int) -> dict:
    """What a chunk reports: its tokens, and the piece ends in its overlap
    with its predecessor and in that with its successor."""
    e = encoder.spans.encode(text, add_special_tokens=False)
    ends, upto = piece_ends(e, start)
    reach = start + len(text)
    sure = ends <= (reach if reach == size else reach - margin)
    left = sure & (ends <= start + overlap) if start else np.zeros(len(ends), dtype=bool)
    right = sure & (ends >= start + chunk) if start + chunk < size else np.zeros(len(ends), dtype=bool)
    return {"tokens": len(e), "left_end": ends[left], "left_upto": upto[left],
            "right_end": ends[right], "right_upto": upto[right]}


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(uid, no, size, part): the chunks of every text, dealt over all tasks."""
    schema = "uid bigint, no bigint, size bigint, part string"

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for no, start in enumerate(range(0, len(text), chunk)):
                    rows.append((uid, no, len(text), text[start:start + chunk + overlap]))
                    held += len(rows[-1][3])
                    if held >= 4_000_000:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.int64()) for c in cols[:3]),
                                           pa.array(cols[3], type=pa.string())], names=["uid", "no", "size", "part"])

    return texts.select("uid", "text").mapInArrow(run, schema).repartition("uid", "no")


def _summaries(chunks: DataFrame, source, chunk: int, overlap: int, margin: int) -> DataFrame:
    lists = ("left_end", "left_upto", "right_end", "right_upto")
    schema = "uid bigint, no bigint, size bigint, tokens bigint, " + ", ".join(f"{c} array<bigint>" for c in lists)
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 4

    def run(batches):
        encoder = encoder_for(source.value, True)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                cols = [[] for _ in types]
                for uid, no, size, part in zip(*(c.to_pylist() for c in b.slice(at, 64).columns)):
                    s = chunk_summary(encoder, part, no * chunk, chunk, overlap, size, margin)
                    for c, v in zip(cols, (uid, no, size, s["tokens"], *(s[x] for x in lists))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)],
                                                 names=["uid", "no", "size", "tokens", *lists])

    return chunks.mapInArrow(run, schema)


def splice(summaries: DataFrame, chunk: int) -> DataFrame:
    """(uid, n_tokens, aligned) from the staged summaries of all chunks."""
    a = summaries.select("uid", "no", "right_end", "right_upto")
    b = summaries.filter("no > 0").select("uid", (F.col("no") - 1).alias("no"), "left_end", "left_upto")
    p = F.array_min(F.array_intersect("right_end", "left_end"))
    seams = a.join(b, ["uid", "no"]).select("uid", p.alias("p"), "right_end", "right_upto", "left_end", "left_upto").select(
        "uid", F.col("p").isNotNull().alias("aligned"),
        (F.element_at("right_upto", F.array_position("right_end", F.col("p")).cast("int"))
         - F.element_at("left_upto", F.array_position("left_end", F.col("p")).cast("int"))).alias("n"))
    last = summaries.filter(F.col("size") <= (F.col("no") + 1) * chunk).select(
        "uid", F.lit(True).alias("aligned"), F.col("tokens").alias("n"))
    return seams.unionByName(last).groupBy("uid").agg(
        F.sum("n").alias("n_tokens"), F.bool_and("aligned").alias("aligned"))


def long_counts(texts: DataFrame, source, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(uid, n_tokens) of staged texts (uid, size, text)."""
    if overlap <= margin or chunk < 2 * overlap:
        raise ValueError("the overlap must exceed the margin, and a chunk two overlaps")
    done, todo = [], texts
    while True:
        found = stage(_summaries(_chunks(todo, chunk, overlap), source, chunk, overlap, margin), "chunk-tokens")
        spliced = stage(splice(found, chunk), "chunk-splices")
        done.append(spliced.filter("aligned").select("uid", "n_tokens"))
        left = stage(spliced.filter("not aligned").select("uid"), "chunk-unaligned")
        if left.isEmpty():
            break
        chunk, overlap = WIDEN * chunk, WIDEN * overlap
        todo = texts.join(broadcast_if_small(left), "uid", "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def count(docs: DataFrame, tokenizer_path: str, keep=("doc_id",), text: str = "text", limit: int = 1024,
          long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of
    every row.  The texts of up to ``long`` code points are encoded in one
    pass without a shuffle; the longer ones are written once and dealt in
    chunks."""
    keep = list(keep)
    if bad := sorted({k.lower() for k in keep} & set(OUTPUTS)):
        raise ValueError(f"kept column(s) {bad} collide with output columns; rename them")
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = f.read()
    spec = check_byte_level(content)
    margin = 2 + max((len(a["content"]) for a in spec.get("added_tokens", [])), default=0)
    source = spark.sparkContext.broadcast(content)
    # kept columns travel in a struct, so no name of theirs meets one of these
    rows = docs.select(F.struct(*(docs[k] for k in keep)).alias("kept"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint")).withColumn("size", F.length("text").cast("bigint"))
    short = rows.filter(F.col("size") <= long).select("kept", "n_bytes", "text")
    schema = T.StructType([short.schema["kept"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        encoder = encoder_for(source.value, True)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = [len(ids) for ids in encoder.ids(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, type=pa.int64())],
                                                 names=["kept", "n_bytes", "n_tokens"])

    counted = short.mapInArrow(run, schema)
    huge = stage(rows.filter(F.col("size") > long).withColumn("uid", F.monotonically_increasing_id()), "long-texts")
    if not huge.isEmpty():
        n = long_counts(huge.select("uid", "size", "text"), source, margin, chunk, overlap)
        counted = counted.unionByName(huge.select("uid", "kept", "n_bytes").join(n, "uid").drop("uid"))
    return counted.select("kept.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
