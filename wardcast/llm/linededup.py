"""Substring dedup: units of text that occur before are removed.

A unit is a line, or a sentence of a line; paragraphs can be asked for
instead; ``deduplicate_units`` also removes runs of short ones.  Units are normalised (lower case, white space collapsed) and
hashed.  Digests are counted over all documents, the repeated ones grouped,
and the earliest occurrence kept: least doc_id, then text hash, then offset.
All later ones are removed with their offsets (code points, end exclusive)
in the original text.

Counting shuffles one 64-bit number per different unit and task; only
repeated units come back with their place, so the second shuffle is as large
as the repetition.  Groups are aggregated map-side, and the keeper is joined
to the occurrences by a join that Spark can split.

Defined results: null or empty text has no units; units under ``MIN_WORDS``
words (and ``MIN_CHARS`` characters without spaces) are hashed in runs, see
``runs``; a short run at the end of a repeated passage, without a second unit
beside it, stays, as does a sentence that is glued to other text; rows equal in doc_id and text count as one document; null doc_id
ranks last; an empty table gives an empty result; ``deduplicate_units``
keeps all columns of the input.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import apart, broadcast_if_small, cut_spans, stage

MIN_WORDS = 5
#: narrow (one long) rows that may be broadcast after counting them
NARROW_ROWS = 2_000_000

#: where a unit ends
BREAKS = {"sentence": r"\n|(?<=[.!?])\s|(?<=[。！？])", "line": r"\n", "paragraph": r"\n[^\S\n]*\n"}

#: characters of scripts that put no spaces between words; so many make a unit
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
MIN_CHARS = 10


def pieces(text: str | None, breaks: re.Pattern, min_words: int = MIN_WORDS):
    """(start, end, normalised text, words, long enough) of every piece that is not blank."""
    at = 0
    text = text or ""
    for m in [*breaks.finditer(text), None]:
        end = m.start() if m else len(text)
        raw = text[at:end]
        if ws := raw.split():
            long = len(ws) >= min_words or (len(raw) >= MIN_CHARS and not raw.isascii()
                                            and len(UNSPACED.findall(raw)) >= MIN_CHARS)
            yield at + len(raw) - len(raw.lstrip()), at + len(raw.rstrip()), " ".join(ws).lower(), len(ws), long
        at = m.end() if m else end


def units(text: str | None, breaks: re.Pattern, min_words: int = MIN_WORDS):
    """(start, end, normalised bytes) of every unit that is long enough."""
    return ((s, e, normal.encode()) for s, e, normal, _, long in pieces(text, breaks, min_words) if long)


def runs(text: str | None, breaks: re.Pattern, min_words: int = MIN_WORDS):
    """The units, and the short pieces beside them as runs: the neighbours
    within a line, or else in the text, that have enough words together, and
    what stays short between two units, identified with both of them.  An
    earlier occurrence of such a triple holds both units, so where the short
    run is removed, its neighbours are as well."""
    text = text or ""

    def joined(found, same_line):
        out, group = [], []

        def close():
            if sum(p[3] for p in group) >= min_words or sum(len(UNSPACED.findall(p[2])) for p in group if not p[2].isascii()) >= MIN_CHARS:
                out.append((group[0][0], group[-1][1], "\n".join(p[2] for p in group), sum(p[3] for p in group), True))
            else:
                out.extend(group)
            group.clear()

        for p in found:
            if group and (p[4] or (same_line and "\n" in text[group[-1][1]:p[0]])):
                close()
            if p[4]:
                out.append(p)
            else:
                group.append(p)
        if group:
            close()
        return out

    found = joined(joined(pieces(text, breaks, min_words), True), False)
    left, between = None, []
    for p in found:
        if not p[4]:
            between.append(p)
            continue
        if left and between:
            yield (between[0][0], between[-1][1],
                   "\0".join((left[2], "\n".join(b[2] for b in between), p[2])).encode())
        left, between = p, []
        yield p[0], p[1], p[2].encode()


def unit_digest(normal: bytes) -> bytes:
    return hashlib.blake2b(normal, digest_size=16).digest()


def _counts(docs: DataFrame, pattern: str, cut) -> DataFrame:
    """(hi, n): first half of each unit's digest, counted per block of a task."""
    def run(batches):
        breaks = re.compile(pattern)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                raw = b"".join(unit_digest(u) for t in b.slice(at, 2000).column(0).to_pylist()
                               for _, _, u in cut(t, breaks))
                hi, n = np.unique(np.frombuffer(raw, dtype="<i8")[0::2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(n.astype(np.int32))], names=["hi", "n"])

    return docs.select("text").mapInArrow(run, "hi long, n int")


def _places(docs: DataFrame, pattern: str, cut) -> DataFrame:
    """(hi, lo, doc_id, text_key, start, end) of every unit."""
    names = ["hi", "lo", "doc_id", "text_key", "start", "end"]

    def run(batches):
        breaks = re.compile(pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, keys, texts = b.slice(at, 500).columns
                raw, of, start, end = [], [], [], []
                for i, t in enumerate(texts.to_pylist()):
                    for s, e, u in cut(t, breaks):
                        raw.append(unit_digest(u)), of.append(i), start.append(s), end.append(e)
                half = np.frombuffer(b"".join(raw), dtype="<i8").reshape(-1, 2)
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy()), ids.take(of), keys.take(of),
                     pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "hi long, lo long, doc_id long, text_key long, start int, end int")


def repeated_units(docs: DataFrame, unit: str = "sentence", cut=units) -> DataFrame:
    """One row per removed unit: doc_id, text_key, start, end, and the kept
    occurrence (keeper.doc_id, keeper.text_key, keeper.start)."""
    ship_package(docs.sparkSession)
    pattern = BREAKS[unit]
    often = stage(_counts(docs, pattern, cut).groupBy("hi").agg(F.sum("n").alias("n")).filter("n > 1").select("hi"),
                  "units-often")
    again = stage(_places(docs, pattern, cut).join(broadcast_if_small(often, NARROW_ROWS), "hi").distinct(), "units-again")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "start")
    keepers = stage(again.groupBy("hi", "lo").agg(F.min(rank).alias("keeper"), F.count("*").alias("n"))
                    .filter("n > 1").select("hi", "lo", "keeper"), "units-keepers")
    return (again.join(keepers, ["hi", "lo"])
            .filter(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))
                      & (F.col("text_key") == F.col("keeper.text_key")) & (F.col("start") == F.col("keeper.start"))))
            .select("doc_id", "text_key", "start", "end", "keeper"))


def deduplicate_units(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """All columns of the input, text without its repeated units, and
    removed (array of start, end, keeper_doc in the original text), which takes
    the place of an input column of that name."""
    i, t, cut = apart(docs, "units_id", "units_text", "units_removed")
    spans = (repeated_units(docs, unit, runs).groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                 F.col("keeper.doc_id").alias("keeper_doc")))).alias(cut))
             .select(F.col("doc_id").alias(i), F.col("text_key").alias(t), cut))
    none = F.array().cast("array<struct<start:bigint,end:bigint,keeper_doc:bigint>>")
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(F.col(i))
                       & (F.xxhash64(docs["text"]) == F.col(t)), "left")
    cleaned = F.when(F.col(cut).isNull(), F.col("text")).otherwise(cut_spans(F.col("text"), F.col(cut)))
    kept = [c for c in docs.columns if c not in ("text", "removed")]
    return joined.select(*kept, cleaned.alias("text"), F.coalesce(cut, none).alias("removed"))
