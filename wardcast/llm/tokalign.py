"""Alignment of the tokens of two tokenizers by galloping intersection
(operator 11).

Every text is encoded by a byte-level BPE file (A, on space + text) and a
sentencepiece model (B, which adds the space itself).  The byte offsets where
tokens end make two sorted lists per document.  The shorter list drives: each
of its offsets is looked for in the longer one from a place known to lie
before it, by steps of 1, 2, 4, ... until it is passed and a binary search in
the last step.  Coarse strides go first, so that the offsets between two of
them start where the coarser one was found; all offsets of a stride are moved
at once, over all documents of a batch (each document's offsets are shifted
behind the one's before).  Offsets in both lists are the common ends.

Common ends slice both lists into groups: between two of them the ranks in A
and in B run over ranges, and the differences of the ranks are the group's
numbers of tokens.  All A-B pairs of a group are links.

Two passes over the documents' links, not over their texts:

1. encode, align, write per document its digest and its distinct (A id, B id)
   pairs with their numbers of links (at most ``PAIR_ROW`` pairs a row);
2. count in how many documents each pair is linked (partial aggregates, one
   row per pair), take the highest count per A id, and bring both back to the
   documents.  Pairs of at least a threshold of documents are broadcast: the
   threshold is taken so that no more than ``BROADCAST_ROWS`` pairs reach it.
   The rest are joined through a shuffle, in which by that threshold no pair
   has more rows than its bound: a pair that a third of all documents hold
   does not end in one task.

Defined results: null and empty texts, and texts whose joined token bytes
differ from space + text, have no tokens (zeros and an empty string); repeated
rows are documents of their own, in the counts too; an empty table gives an
empty result; the columns named in ``keep`` are passed through, all others are
dropped; a kept column named like an output is an error.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .bpe import token_bytes
from .bytelevel import check_byte_level, encoder_for
from .common import BROADCAST_ROWS, stage

STRIDES = (512, 64, 8, 1)
PAIR_ROW = 65_536         # distinct pairs in a row
LINK_BLOCK = 4_000_000    # links listed at a time
BATCH_CHARS = 500_000     # characters of text encoded at a time
ID_BITS = 24              # of a token id inside a pair
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
OUTPUTS = (*FIGURES, "n_best", "count_sum", "groups_sha256")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Per element of ``short`` its place in ``long`` (both sorted): the
    first position whose value is not smaller."""
    n, end = len(short), len(long)
    found = np.zeros(n, dtype=np.int64)
    coarser = None
    for stride in STRIDES:
        at = np.arange(0, n, stride)
        if coarser is None:
            # the coarsest offsets start at the front of the list
            start = np.zeros(len(at), dtype=np.int64)
        else:
            start = found[at // coarser * coarser]
        coarser = stride
        value, step = short[at], np.ones(len(at), dtype=np.int64)
        low, high = start.copy(), start.copy()           # long[low - 1] < value, if there is one
        open_ = np.flatnonzero((high < end) & (long[np.minimum(high, end - 1)] < value)) if end else at[:0]
        while len(open_):                                 # exponential part
            low[open_] = high[open_] + 1
            high[open_] = np.minimum(high[open_] + step[open_], end)
            step[open_] *= 2
            open_ = open_[high[open_] < end]
            open_ = open_[long[high[open_]] < value[open_]]
        open_ = np.flatnonzero(low < high)
        while len(open_):                                 # binary part
            middle = (low[open_] + high[open_]) // 2
            less = long[middle] < value[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        found[at] = low
    return found


def common_ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and in b of the values that both sorted lists hold."""
    if len(a) > len(b):
        y, x = common_ranks(b, a)
        return x, y
    at = gallop(a, b)
    hit = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a)) if len(b) else np.zeros(0, dtype=np.int64)
    return hit, at[hit]


def distinct_pairs(a, b, ga, gb, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the links of all groups, distinct by
    document and pair; ``ga``/``gb`` are the groups' numbers of tokens,
    ``doc`` their documents (ascending).  Links are listed ``LINK_BLOCK`` at a time."""
    parts = []
    a0, b0 = np.cumsum(ga) - ga, np.cumsum(gb) - gb
    links = ga * gb
    upto = np.cumsum(links)
    at = 0
    while at < len(ga):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + LINK_BLOCK, side="right")))
        if links[at] > LINK_BLOCK:
            parts.append(_one_group(a[a0[at]:a0[at] + ga[at]], b[b0[at]:b0[at] + gb[at]], doc[at]))
            at += 1
            continue
        n = links[at:to]
        group = np.repeat(np.arange(at, to), n)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        wide = gb[group]
        pair = (a[a0[group] + inside // wide] << ID_BITS) | b[b0[group] + inside % wide]
        parts.append(_summed(doc[group], pair, np.ones(len(pair), dtype=np.int64)))
        at = to
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    return parts[0] if len(parts) == 1 else _summed(*(np.concatenate(c) for c in zip(*parts)))


def _one_group(a, b, doc):
    """A very large group by its distinct ids: their products are its links."""
    ia, na = np.unique(a, return_counts=True)
    ib, nb = np.unique(b, return_counts=True)
    pair = ((ia << ID_BITS)[:, None] | ib).ravel()
    return np.full(len(pair), doc, dtype=np.int64), pair, (na[:, None] * nb).ravel()


def _summed(doc, pair, links):
    order = np.lexsort((pair, doc))
    doc, pair, links = doc[order], pair[order], links[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
    return doc[first], pair[first], np.add.reduceat(links, first) if len(first) else links


class Aligner:
    """Both tokenizers and the tables of their tokens' bytes."""

    def __init__(self, source_a: str, spec_a: dict, model_b: bytes):
        import sentencepiece
        self.encoder = encoder_for(source_a, False)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        table = token_bytes(spec_a)
        self.bytes_a = [table.get(i, b"") for i in range(max(table) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.model.get_piece_size())]
        self.size_a = np.array([len(t) for t in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], dtype=np.int64)
        # a token's decimal id with what may follow it: next in its list, end of the list, end of the document
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.width = len(ids)
        self.written = [f"{i}{z}" for z in (",", "|", ";", "") for i in ids]

    def _piece(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[3:-1], 16)])
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, digest, pairs, links."""
        ids_a = self.encoder.ids([" " + t for t in texts])
        ids_b = self.model.encode(texts, num_threads=1)
        kept, none = [], np.zeros(0, dtype=np.int64)
        out = [(0, 0, 0, 0, "", none, none)] * len(texts)
        for i, (t, x, y) in enumerate(zip(texts, ids_a, ids_b)):
            whole = (" " + t).encode()
            if t and b"".join([self.bytes_a[j] for j in x]) == whole == b"".join([self.bytes_b[j] for j in y]):
                kept.append(i)
        if not kept:
            return out
        n_a = np.array([len(ids_a[i]) for i in kept])
        n_b = np.array([len(ids_b[i]) for i in kept])
        a = np.concatenate([np.array(ids_a[i], dtype=np.int64) for i in kept])
        b = np.concatenate([np.array(ids_b[i], dtype=np.int64) for i in kept])
        # tokens of documents follow one another without a gap, so one sum gives shifted ends
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        doc_a, doc_b = np.repeat(np.arange(len(kept)), n_a), np.repeat(np.arange(len(kept)), n_b)
        at_a, at_b = [], []
        for shorter_a in (True, False):       # each document's shorter list drives
            docs = (n_a <= n_b) == shorter_a
            ia, ib = np.flatnonzero(docs[doc_a]), np.flatnonzero(docs[doc_b])
            ra, rb = common_ranks(end_a[ia], end_b[ib]) if shorter_a else common_ranks(end_b[ib], end_a[ia])[::-1]
            at_a.append(ia[ra])
            at_b.append(ib[rb])
        at_a, at_b = np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))
        ga, gb = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        doc = doc_a[at_a]
        text = self._written(a, b, at_a, at_b, ga, gb, doc)
        n_groups = np.bincount(doc, minlength=len(kept))
        n_links = np.bincount(doc, weights=ga * gb, minlength=len(kept)).astype(np.int64)
        pd, pair, links = distinct_pairs(a, b, ga, gb, doc)
        cut = np.searchsorted(pd, np.arange(len(kept) + 1))
        for k, i in enumerate(kept):
            out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(text[k].encode()).hexdigest(),
                      pair[cut[k]:cut[k + 1]], links[cut[k]:cut[k + 1]])
        return out

    def _written(self, a, b, at_a, at_b, ga, gb, doc) -> list[str]:
        """The groups of every document as text: A ids | B ids ; ..."""
        end_of_doc = np.append(doc[1:] != doc[:-1], True)
        kind_a, kind_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        kind_a[at_a], kind_b[at_b] = 1, np.where(end_of_doc, 3, 2)
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(gb) - gb, ga)     # after the B tokens of all groups before
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(ga), gb)          # after the A tokens up to its own group
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[place_a], code[place_b] = kind_a * self.width + a, kind_b * self.width + b
        upto = (at_a + at_b + 2)[end_of_doc].tolist()
        words = [self.written[c] for c in code.tolist()]
        return ["".join(words[x:y]) for x, y in zip([0, *upto], upto)]


_ALIGNERS: dict[str, Aligner] = {}


def aligner_for(source_a: str, model_b: str) -> Aligner:
    """One aligner per worker process and pair of tokenizers."""
    key = hashlib.sha256((source_a + model_b).encode()).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(source_a, check_byte_level(source_a), base64.b64decode(model_b))
    return _ALIGNERS[key]


def groups(docs: DataFrame, path_a: str, path_b: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Staged rows (uid, kept, first, n_a, n_b, n_groups, n_links,
    groups_sha256, pairs, links): one per document, and more with ``first``
    false for documents of more than ``PAIR_ROW`` distinct pairs."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(path_a, encoding="utf-8") as f:
        source_a = f.read()
    check_byte_level(source_a)
    with open(path_b, "rb") as f:
        model_b = base64.b64encode(f.read()).decode()
    sent = spark.sparkContext.broadcast((source_a, model_b))
    # kept columns travel in a struct, so no name of theirs meets one of these;
    # ids count within a task's rows and are fixed by the write below
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(docs[k] for k in keep)).alias("kept"),
                       F.coalesce(docs[text], F.lit("")).alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["uid"], rows.schema["kept"], T.StructField("first", T.BooleanType())]
                          + [T.StructField(c, T.LongType()) for c in FIGURES]
                          + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", longs), T.StructField("links", longs)])
    types = [pa.bool_(), *[pa.int64()] * len(FIGURES), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def parts(batch):
        """Runs of at most 256 texts that end once they hold ``BATCH_CHARS`` characters."""
        texts, at, size = batch.column(2).to_pylist(), 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t)
            if size >= BATCH_CHARS or i - at == 256 or i == len(texts):
                yield at, texts[at:i]
                at, size = i, 0

    def run(batches):
        aligner = aligner_for(*sent.value)
        for b in batches:
            for at, texts in parts(b):
                cols, source = [[] for _ in types], []
                for i, (*figures, digest, pair, links) in enumerate(aligner.align(texts)):
                    for p in range(0, max(len(pair), 1), PAIR_ROW):
                        source.append(at + i)
                        for c, v in zip(cols, (p == 0, *figures, digest, pair[p:p + PAIR_ROW], links[p:p + PAIR_ROW])):
                            c.append(v)
                rows_at = pa.array(source)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows_at), b.column(1).take(rows_at),
                     *(pa.array(c, type=t) for c, t in zip(cols, types))], names=schema.fieldNames())

    return stage(rows.mapInArrow(run, schema), "token-groups")


def pair_counts(grouped: DataFrame) -> DataFrame:
    """Staged (pair, n, best): in how many documents a pair is linked, and
    whether that is the highest count of its A id."""
    n = stage(grouped.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    n = n.withColumn("a", F.shiftright("pair", ID_BITS))
    highest = n.groupBy("a").agg(F.max("n").alias("most"))
    return stage(n.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-figures")


def document_sums(grouped: DataFrame, counts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(uid, n_best, count_sum) of every document with links."""
    levels = counts.groupBy(F.length(F.bin("n")).alias("level")).count().collect()    # 64 at most
    least, held = 1 << 62, 0
    for r in sorted(levels, reverse=True):
        held += r["count"]
        if held > broadcast_rows:
            break
        least = 1 << (r["level"] - 1)
    often, seldom = F.broadcast(counts.filter(F.col("n") >= least)), counts.filter(F.col("n") < least).hint("merge")
    each = grouped.select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select(
        "uid", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))

    def sums(df):
        return df.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
                                     F.sum(F.col("links") * F.col("n")).alias("count_sum"))

    out = sums(each.join(often, "pair"))
    if held > broadcast_rows:
        rest = sums(each.join(often.select("pair"), "pair", "left_anti").join(seldom, "pair"))
        out = out.unionByName(rest).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def align(docs: DataFrame, path_a: str, path_b: str, keep=("doc_id",), text: str = "text",
          broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    of every row of ``docs``."""
    keep = list(keep)
    if bad := sorted({k.lower() for k in keep} & set(OUTPUTS)):
        raise ValueError(f"kept column(s) {bad} collide with output columns; rename them")
    grouped = groups(docs, path_a, path_b, keep, text)
    sums = document_sums(grouped, pair_counts(grouped), broadcast_rows)
    return grouped.filter("first").select("uid", "kept", *FIGURES, "groups_sha256").join(sums, "uid", "left").select(
        "kept.*", *FIGURES, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
