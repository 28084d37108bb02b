"""Quality rules with adaptive thresholds.

Every document is measured with array functions inside its own row.  The
measures of all documents are folded into mergeable quantile sketches, one
per (lang, source): counts of log-linear integer buckets (seven significant
bits, so a quantile is off by less than 1/64 of its value).  Two sketches
merge by adding counts, so a source holding a third of the rows is combined
map-side, and the sketches of a language and of the whole corpus are sums of
the smaller ones.  The fences read from the sketches are joined back to the
measured rows.

No constant decides where a fence lies.  The upper fence is the 90th
percentile plus ``FENCE`` times its distance from the median (mean word
length has a lower one alike, from the 10th).  A measure that is 0 in nine of
ten rows of a group has no such distance; there a row goes whose value
reaches the median of the group's non-zero rows.  So at most a tenth of a
group lies beyond a fence of its own.  A group whose sketch gives no fence
(under ``MIN_ROWS`` rows, no spread, under ``MIN_NONZERO`` non-zero rows)
takes its language's, then the corpus's; without any, the measure rejects
nothing.  Values are compared by their buckets.

Defined results: a null or empty text has no words and fails the base rule;
null lang or source is a group of its own; repeated rows are measured and
counted each; an empty table gives an empty result; other columns of the
input are ignored by ``measure`` and kept by ``quality_filter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, broadcast_if_small, let, stage, words

SYMBOLS = "#*$%&|<>"

#: Measures that the sketches hold, as integers: (name, numerator, scale,
#: denominator, whether low values are fenced as well).
MEASURES = (
    ("avg_word", "word_chars", 100, "n_words", True),
    ("symbols", "n_symbols", 10_000, "word_chars", False),
    ("dup_lines", "n_dup_lines", 1_000, "n_lines", False),
    ("repeats", "n_repeat_words", 1_000, "n_words", False),
)
FENCE = 3          # fences lie this many distances from the median beyond the outer tenths
MIN_ROWS = 100     # a smaller group takes its language's fences, then the corpus's
MIN_NONZERO = 5    # so many non-zero rows tell their median
WINDOW_WORDS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(ws: Column) -> Column:
    """Words inside windows of five words that occur twice or more."""
    k = WINDOW_WORDS

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.transform(s, lambda x, j: F.struct(
                x["i"].alias("i"),
                (F.when(j > 0, F.get(s, j - 1)["h"] == x["h"]).otherwise(False)
                 | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))).alias("twice")))
            return F.array_sort(F.transform(F.filter(same, lambda y: y["twice"]), lambda y: y["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            let(pairs, positions), start,
            lambda a, p: F.struct((p + k).alias("end"),
                                  (a["n"] + k - F.greatest(F.lit(0), a["end"] - p)).alias("n")),
            lambda a: a["n"])

    def from_words(w: Column) -> Column:
        windows = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - k),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
        return let(windows, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    return F.when(F.size(ws) > k, from_words(ws)).otherwise(F.lit(0)).cast("long")


def counts(text: Column) -> Column:
    """Struct of the counts in ``COUNTS`` of one text (null: all zero).
    Equal windows are recognised by 64-bit digests within one document."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, WS_CHARS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0)

    def of(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"))

    return let(words(text, WS_CLASS), lambda w: let(lines, lambda ls: of(w, ls)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure(docs: DataFrame, carry=()) -> DataFrame:
    """(doc_id, text_key, lang, source, ``carry``, counts, measures), one row
    per input row, staged: measuring is the only pass over the texts."""
    own = ("doc_id", "text_key", "lang", "source", *carry)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "lang", "source", *carry,
                       counts(F.col("text")).alias("c"))
    rows = rows.select(*own, *[f"c.{c}" for c in COUNTS])
    ratios = [F.when(F.col(den) > 0, F.floor(scale * F.col(num) / F.col(den))).otherwise(F.lit(0))
              .cast("long").alias(f"m_{name}") for name, num, scale, den, _ in MEASURES]
    return stage(rows.select("*", *ratios), "quality-measures")


def _bucket(v: Column) -> Column:
    """The value with all but its seven leading bits cleared."""
    low = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of every group."""
    long = measured.filter(F.col("n_words") > 0).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m[0]).alias("measure"), _bucket(F.col(f"m_{m[0]}")).alias("bucket"))
        for m in MEASURES])).alias("m"))
    return (long.select("lang", "source", "m.measure", "m.bucket")
            .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n")))


def _fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """One row per group: ``tag``_measure_lo and _hi of every measure, null
    where the group's sketch tells none.  A window holds the buckets of one
    sketch, a few hundred at most."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    cum = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("cum"), F.sum("n").over(w).alias("total"),
                        F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(w).alias("zeros"))
    bucket, cum_n, total, zeros = (F.col(c) for c in ("bucket", "cum", "total", "zeros"))
    per = cum.groupBy(*keys, "measure").agg(
        F.max(total).alias("total"), F.max(total - zeros).alias("nonzero"),
        *[F.min(F.when(10 * cum_n >= k * total, bucket)).alias(f"q{k}0") for k in (1, 5, 9)],
        F.min(F.when((bucket > 0) & (2 * (cum_n - zeros) >= total - zeros), bucket)).alias("half"))
    known = F.col("total") >= MIN_ROWS
    hi = (F.when(known & (F.col("q90") > F.col("q50")), F.col("q90") + FENCE * (F.col("q90") - F.col("q50")))
          .when(known & (F.col("q90") == 0) & (F.col("nonzero") >= MIN_NONZERO), F.col("half") - 1))
    lo = F.when(known & (F.col("q10") < F.col("q50")), F.col("q10") - FENCE * (F.col("q50") - F.col("q10")))
    per = per.select(*keys, "measure", hi.alias("hi"), lo.alias("lo"))
    return per.groupBy(*keys).agg(*[
        F.max(F.when(F.col("measure") == name, F.col(e))).alias(f"{tag}_{name}_{e}")
        for name, *_, both in MEASURES for e in (("lo", "hi") if both else ("hi",))])


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): lowest and highest value of each measure
    that passes, from the group's sketch, its language's merged sketch, or
    the corpus's, whichever tells it first (null: open)."""
    sketch = stage(sketches(measured), "quality-sketches")
    own, lang = _fences(sketch, ["lang", "source"], "g"), _fences(sketch, ["lang"], "l")
    corpus = _fences(sketch, [], "c")
    wide = [c for c in lang.columns if c != "lang"]
    rows = (own.alias("o").join(lang.alias("l"), F.expr("o.lang <=> l.lang"), "left")
            .select("o.*", *[F.col(f"l.{c}") for c in wide])
            .crossJoin(F.broadcast(corpus)))  # one row
    ends = [c[2:] for c in wide]
    return stage(rows.select("lang", "source", *[
        F.coalesce(*[F.col(f"{t}_{e}") for t in "glc"]).alias(e) for e in ends]), "quality-thresholds")


def judge(docs: DataFrame) -> DataFrame:
    """Measured rows with base_failed, the fences of their group, and kept."""
    return judged(measure(docs))


def judged(measured: DataFrame) -> DataFrame:
    fences = thresholds(measured)
    ends = [c for c in fences.columns if c not in ("lang", "source")]
    joined = (measured.alias("m").join(
        broadcast_if_small(fences).alias("t"), F.expr("m.lang <=> t.lang and m.source <=> t.source"), "left")
        .select("m.*", *[f"t.{e}" for e in ends]))
    inside = F.lit(True)
    for e in ends:
        name, side = e.rsplit("_", 1)
        v = _bucket(F.col(f"m_{name}"))
        inside = inside & F.coalesce(v <= F.col(e) if side == "hi" else v >= F.col(e), F.lit(True))
    return joined.select("*", base_failed().alias("base_failed"),
                         (~base_failed() & inside).alias("kept"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.  Rows and their
    measures are written together once, so that the filter meets nothing but
    the fences (one row per group): no text is shuffled, whatever share is
    rejected.  Columns of any name are kept: a row travels as one struct."""
    rows = measure(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), "doc_id", "text", "lang", "source"),
                   carry=("doc",))
    return judged(rows).filter("kept").select("doc.*")
