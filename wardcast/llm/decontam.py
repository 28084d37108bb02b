"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows (13 consecutive words, or the whole
item if it is shorter), a window a sequence of word shingles.  A window can
only occur where all its shingles do, so one necessary token, its rarest
shingle over all documents, serves as its prefix.  Document shingles are
matched with the dictionary of benchmark shingles (the only pass over the
texts); matches of a prefix shingle give candidate places, which must pass
the positional and length bounds (the window fits between the document's
first and last word) and are then verified exactly: the shingles around the
place must be the window's, position by position.

Everything is DataFrame work: texts are never shuffled, only matched
shingles are.  The dictionary and the prefix table are broadcast only up to
a counted number of rows and joined by a shuffle beyond it.

Defined results: null text has no words and is not contaminated; repeated
document rows each get the same result; items with the same words are one
class and are all listed; a null item_id marks words but is not listed;
items without words never match; empty tables give empty or clean results;
other columns are ignored by ``match`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, broadcast_if_small, let, lower_ascii, sha256_utf8, stage, words

#: characters that are no part of a word (fixed by the rule)
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WINDOW = 13
SHINGLE = 3


def word_array(text: Column) -> Column:
    return words(lower_ascii(text), SEPARATORS)


def _ngrams(ws: Column, k: int) -> Column:
    """Strings of k consecutive words; empty if there are fewer."""
    def at(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(ws, i + j) for j in range(k)])
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(0), F.size(ws) - k), at)) \
        .otherwise(F.array().cast("array<string>"))


def _windows(benchmark: DataFrame, window: int, shingle: int):
    """(classes, windows, members): items by equal words, their distinct
    windows with shingle strings, and which class has which window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("ws"))
    classes = stage(items.filter(F.size("ws") > 0).groupBy("ws")
                    .agg(F.collect_set("item").alias("items"))
                    .select(F.monotonically_increasing_id().alias("class"), "ws", "items"), "decontam-classes")
    n = F.least(F.size("ws"), F.lit(window))
    cut = classes.select("class", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("ws") - n), lambda i: F.slice("ws", i + 1, n))).alias("w"))
    windows = cut.select("w").distinct().select(
        F.monotonically_increasing_id().alias("wid"), "w", F.size("w").alias("len"),
        F.least(F.size("w"), F.lit(shingle)).alias("k"))
    grams = F.coalesce(*[F.when(F.col("k") == k, _ngrams(F.col("w"), k)) for k in range(1, shingle + 1)])
    windows = stage(windows.select("*", grams.alias("grams")), "decontam-windows")
    members = stage(cut.join(windows.select("wid", "w"), "w").select("wid", "class").distinct(), "decontam-members")
    return classes, windows, members


def _hits(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, n_words, k, pos, sid): places of benchmark shingles, and one row
    with k = 0 for every document row."""
    out = None
    for k in sorted({*sizes, SHINGLE}):
        lead = F.array(F.lit("")) if k == SHINGLE else F.array().cast("array<string>")
        ws = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_array(F.col("text")).alias("ws"))
        rows = ws.select("doc_id", "text_key", F.size("ws").cast("long").alias("n_words"),
                         F.posexplode(let(F.col("ws"), lambda w: F.concat(lead, _ngrams(w, k)))).alias("pos", "gram"))
        own = grams.filter(F.col("k").isin(k, 0)) if k == SHINGLE else grams.filter(F.col("k") == k)
        hit = rows.join(broadcast_if_small(own), "gram").select(
            "doc_id", "text_key", "n_words", F.col("k"),
            (F.col("pos") - (1 if k == SHINGLE else 0)).alias("pos"), "sid")
        out = hit if out is None else out.unionByName(hit)
    return stage(out.select(F.struct("doc_id", "text_key").alias("doc"), "n_words", "k", "pos", "sid"),
                 "decontam-hits")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE):
    """(rows, found, classes, members): found is (doc, n_words, start, end,
    wid) of every verified window; rows is (doc, n_words, copies)."""
    classes, windows, members = _windows(benchmark, window, shingle)
    sizes = [r.k for r in windows.select("k").distinct().collect()]  # at most ``shingle`` values
    grams = (windows.select("k", F.explode("grams").alias("gram")).distinct()
             .select("gram", "k", F.monotonically_increasing_id().alias("sid")))
    grams = stage(grams.unionByName(docs.sparkSession.range(1).select(
        F.lit("").alias("gram"), F.lit(0).alias("k"), F.lit(-1).cast("long").alias("sid"))), "decontam-grams")
    hits = _hits(docs, grams, sizes)
    rows = hits.filter("k = 0").groupBy("doc", "n_words").agg(F.count("*").alias("copies"))
    placed = hits.filter("k > 0")

    # prefix: the rarest shingle of each window, by occurrences over all documents
    rarity = placed.groupBy("sid").agg(F.count("*").alias("n"))
    tokens = (windows.select("wid", "len", F.posexplode("grams").alias("offset", "gram"))
              .join(grams.filter("k > 0").select("gram", "sid"), "gram")
              .join(rarity, "sid", "left").fillna(0, ["n"]))
    prefix = (tokens.groupBy("wid", "len")
              .agg(F.min(F.struct("n", "sid", "offset")).alias("p"),
                   F.array_sort(F.collect_list(F.struct("offset", "sid"))).alias("seq"))
              .filter("p.n > 0")
              .select("wid", "len", "p.sid", "p.offset", F.col("seq.sid").alias("seq")))
    prefix = broadcast_if_small(stage(prefix, "decontam-prefix"))

    # the neighbours of each place, for verification
    around = Window.partitionBy("doc", "k").orderBy("pos").rowsBetween(1 - window, window - 1)
    near = placed.distinct().select("doc", "n_words", "pos", "sid",
                                    F.collect_list(F.struct("pos", "sid")).over(around).alias("near"))
    start = F.col("pos") - F.col("offset")
    candidates = near.join(prefix, "sid").select("*", start.alias("start")).filter(
        (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
    at = F.transform(F.filter("near", lambda c: (c["pos"] >= F.col("start"))
                              & (c["pos"] < F.col("start") + F.size("seq"))), lambda c: c["sid"])
    found = candidates.filter(at == F.col("seq")).select(
        "doc", "n_words", "start", (F.col("start") + F.col("len")).alias("end"), "wid")
    return rows, stage(found, "decontam-found"), classes, members


def _covered(spans: Column) -> Column:
    """Length of the union of sorted [start, end) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")), lambda a: a["n"])


def match(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc (doc_id, text_key), n_words, n_hit,
    items (sorted strings), contaminated."""
    rows, found, classes, members = occurrences(docs, benchmark)
    spans = found.groupBy("doc").agg(
        _covered(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("n_hit"))
    listed = (found.select("doc", "wid").distinct().join(broadcast_if_small(members), "wid")
              .select("doc", "class").distinct()
              .join(broadcast_if_small(classes.select("class", "items")), "class")
              .groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    out = rows.join(spans, "doc", "left").join(listed, "doc", "left").select(
        "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select("doc", "n_words", "n_hit", "items",
                      ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def digest(matched: DataFrame) -> DataFrame:
    return matched.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                          sha256_utf8(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns
    (whatever their names)."""
    i, t = apart(docs, "bad_id", "bad_text")
    bad = stage(match(docs, benchmark).filter("contaminated").select(
        F.col("doc.doc_id").alias(i), F.col("doc.text_key").alias(t)).distinct(), "decontam-bad")
    return docs.join(broadcast_if_small(bad), docs["doc_id"].eqNullSafe(F.col(i))
                     & (F.xxhash64(docs["text"]) == F.col(t)), "left_anti")
