"""Secret scan with multipart credential linking.

Texts are searched with regular expressions for parts of credentials.  Base
parts (assignments, access identifiers, long hex runs) are always reported.
Weak parts (bare key material, account identifiers, endpoints) say little by
themselves; they are reported only when a complementary part stands within
``REACH`` code points in the same scope (a paragraph).  Complements are found
by an interval join: every part covers bins of ``REACH`` code points, parts
are pre-aggregated to the first start and last end per (document, scope,
role, bin), and a part's reach is joined to those bins.  So a scope with
thousands of parts gives rows in proportion to its length, never pairs.

Offsets are code points, end exclusive.  Defined results: null text is
empty; a document without parts has counts 0 and empty spans; repeated rows
each get the same result; null doc_id is a key like any other; an empty
table gives an empty result; other columns are ignored by ``find_parts`` and
kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut_spans, stage

REACH = 200
MASK = "[SECRET]"
HASHES = 2_000_000            # hashes of texts (single longs) that are broadcast at most

#: kind -> (pattern, group whose length counts, least length); fixed values of the base rule
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "id": (r"""(?<![A-Za-z0-9])((?i:user|username|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 2, 3),
    "endpoint": (r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?""", 0, 10),
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
#: roles that complete a weak part
COMPLEMENT = {"key": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}


def has_parts(text: Column) -> Column:
    """A document can only have spans if it has a base part or bare key
    material: the other weak parts need one of those beside them."""
    patterns = [BASE[k][0] for k in BASE] + [WEAK["key"][0]]
    found = text.rlike(patterns[0])
    for p in patterns[1:]:
        found = found | text.rlike(p)
    return F.coalesce(found, F.lit(False))


def _doc() -> Column:
    return F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc")


def _all_parts(docs: DataFrame) -> DataFrame:
    """(doc, scope, kind_no, kind, start, end): every match long enough.
    Offsets are running lengths of the pieces between the matches."""
    kinds = F.array(*[F.struct(
        F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), F.lit(least).alias("least"),
        F.arrays_zip(F.split("text", pattern, -1).alias("piece"),
                     F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"),
                     F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value")).alias("cut"))
        for no, (kind, (pattern, group, least)) in enumerate((BASE | WEAK).items())])
    rows = (docs.select(_doc(), F.explode(kinds).alias("k"))
            .select("doc", "k.kind_no", "k.kind", "k.least", F.posexplode("k.cut").alias("i", "c")))
    rows = rows.select(
        "doc", "kind_no", "kind", "i",
        (F.length("c.piece") + F.coalesce(F.length("c.hit"), F.lit(0))).cast("long").alias("step"),
        F.length("c.hit").cast("long").alias("n"),
        (F.size(F.split("c.piece", r"\n[\x20\t\r]*\n", -1)) - 1).cast("long").alias("breaks"),
        (F.length("c.value") >= F.col("least")).alias("ok")).distinct()
    w = Window.partitionBy("doc", "kind_no").orderBy("i")
    rows = rows.select("doc", "kind_no", "kind", "n", "ok",
                       F.sum("step").over(w).alias("end"), F.sum("breaks").over(w).alias("scope"))
    return rows.filter(F.col("n").isNotNull() & F.col("ok")).select(
        "doc", "scope", "kind_no", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def _role() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("kind"))


def find_parts(docs: DataFrame) -> DataFrame:
    """(doc, kind_no, kind, start, end): base parts, and the weak parts
    linked to a complement.  ``doc`` is struct(doc_id, text_key)."""
    parts = stage(_all_parts(docs.select("doc_id", "text").filter(has_parts(F.col("text")))), "secret-parts")
    reach = F.lit(REACH).cast("long")

    def bins(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / reach).cast("long"), F.floor(hi / reach).cast("long")))

    covered = (parts.select("doc", "scope", _role().alias("role"), "start", "end",
                            bins(F.col("start"), F.col("end")).alias("bin"))
               .groupBy("doc", "scope", "role", "bin")
               .agg(F.min("start").alias("first"), F.max("end").alias("last")))
    needs = F.create_map(*[x for k, roles in COMPLEMENT.items()
                           for x in (F.lit(k), F.array(*map(F.lit, roles)))])
    weak = (parts.filter(F.col("kind").isin(list(COMPLEMENT)))
            .select("*", F.explode(F.element_at(needs, F.col("kind"))).alias("role"))
            .select("*", bins(F.col("start") - reach, F.col("end") + reach).alias("bin")))
    linked = (weak.join(covered, ["doc", "scope", "role", "bin"])
              .filter((F.col("first") <= F.col("end") + reach) & (F.col("last") >= F.col("start") - reach))
              .select("doc", "kind_no", "kind", "start", "end").distinct())
    return parts.filter(F.col("kind").isin(list(BASE))).select(*linked.columns).unionByName(linked)


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind_no, kind, start,
    end by start, then kind)."""
    spans = (find_parts(docs).groupBy("doc")
             .agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind"))).alias("spans")))
    suspect = has_parts(F.col("text"))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    clean = docs.filter(~suspect).select("doc_id", none.alias("spans"))
    found = (docs.filter(suspect).select(_doc()).join(spans, "doc", "left")
             .select("doc.doc_id", F.coalesce("spans", none).alias("spans")))
    return clean.unionByName(found)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents with every reported span replaced by ``mask`` and
    n_chars set to the new length where anything was replaced.  Only
    documents that may have spans are shuffled: by the hashes of the texts
    that have, so that the patterns search each text once, or by the
    patterns where those are too many to broadcast."""
    key, found, hit = apart(docs, "secret_doc", "secret_spans", "secret_text")     # names the table does not have
    merged = stage(find_parts(docs).groupBy(F.col("doc").alias(key))
                   .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(found)), "secret-spans")
    if merged.count() <= HASHES:
        texts = F.broadcast(merged.select(F.col(key)["text_key"].alias(hit)).distinct())
        hot, clean = (docs.join(texts, F.xxhash64("text") == F.col(hit), how) for how in ("left_semi", "left_anti"))
    else:
        suspect = has_parts(F.col("text"))
        hot, clean = docs.filter(suspect), docs.filter(~suspect)
    hot = hot.withColumn(key, _doc()).join(merged, key, "left")
    masked = cut_spans(F.col("text"), F.col(found), mask)
    new = F.coalesce(masked, F.col("text"))
    cols = [new.alias("text") if c == "text"
            else F.when(F.col(found).isNotNull(), F.length(new).cast(t)).otherwise(F.col(c)).alias(c)
            if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return clean.unionByName(hot.select(*cols))
