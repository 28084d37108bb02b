"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes; their number is the level.
Consecutive lines of a level form a passage.  Passages are normalised (lower
case, white space collapsed) and hashed; unquoted passages of all messages
are the originals.  A quoted passage is joined to the original it repeats:
first within its conversation, before its own turn, else the earliest one
anywhere.  A quote that repeats no whole passage is split into lines and
sentences, and joined in the same order to the earliest message that holds
most of them.  A message answers the message whose passage it quotes outermost
and first; its reply path is that message's path and its own turn, so a
conversation sorted by path is in reply order, each reply after what it
answers.  Quotes are left out of the texts.

Originals are reduced to two rows per hash (and one per conversation and hash)
before the join, so a very common passage never meets all its copies.
Sorting is by ranges of (conversation, path), which splits a conversation
of any length; paths are built by pointer doubling over linked messages only.

Defined results: a null or empty text has no passages; a message repeated
with the same conv_id and turn is one node (its rows each stay); null conv_id
or turn cannot be linked to and has the path of its turn; a passage or piece
under ``MIN_WORDS`` words (and ``MIN_CHARS`` characters without spaces) links
nothing; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, sha256_utf8, stage

MIN_WORDS = 3
#: or so many characters of scripts that put no spaces between words
MIN_CHARS = 6
SPACED = (r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]")
SENTENCE = r"(?<=[.!?])\s+|(?<=[。！？])\s*"
QUOTE = r"^[\x20\t]*>"


def _lines(text: Column) -> Column:
    """Array of (level, body) per line."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^([\x20\t]*(?:>[\x20\t]?)*)", 1)
        level = F.length(F.translate(marks, " \t", ""))
        return F.struct(level.alias("level"),
                        F.when(level > 0, F.substring(x, F.length(marks) + 1, F.length(x))).otherwise(x).alias("body"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level; a blank line ends an unquoted run."""
    start = F.struct(F.lit(-1).alias("level"), F.lit("").alias("body"),
                     F.array().cast("array<struct<level:int,body:string>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        blank = F.trim(x["body"]) == ""
        same = (a["level"] == x["level"]) & ~blank
        closed = F.when((a["level"] >= 0) & (a["body"] != ""),
                        F.concat(a["done"], F.array(F.struct(a["level"].alias("level"), a["body"].alias("body")))))
        done = F.when(same, a["done"]).otherwise(F.coalesce(closed, a["done"]))
        return F.struct(F.when(blank, F.lit(-1)).otherwise(x["level"]).alias("level"),
                        F.when(same, F.concat_ws("\n", a["body"], x["body"])).when(blank, F.lit(""))
                        .otherwise(x["body"]).alias("body"), done.alias("done"))

    return F.aggregate(F.concat(lines, F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body")))),
                       start, step, lambda a: a["done"])


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _long(normal: Column) -> Column:
    return ((F.size(F.split(normal, " ")) >= MIN_WORDS)
            | (F.length(F.regexp_replace(normal, SPACED, "")) >= MIN_CHARS))


def _pieces(body: Column) -> Column:
    """Digests of the lines of a passage and of its sentences, within the
    lines and across them."""
    lines = F.split(body, "\n", -1)
    within = F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE, -1)))
    texts = F.transform(F.concat(lines, within, F.split(_normal(body), SENTENCE, -1)), _normal)
    return F.array_distinct(F.transform(F.filter(texts, _long), lambda x: F.sha2(x, 256)))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean text, passages (level, body) of every row."""
    lines = messages.select("conv_id", "turn", "role", "text", _lines(F.col("text")).alias("lines"))
    clean = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    return lines.select("conv_id", "turn", "role",
                        F.when(quoted, F.trim(F.regexp_replace(clean, r"\n{3,}", "\n\n")))
                        .otherwise(F.coalesce("text", F.lit(""))).alias("clean"),
                        quoted.alias("quoted"), _passages(F.col("lines")).alias("passages"))


def _two_least(originals: DataFrame) -> DataFrame:
    """(hash, o, o2): the two least originals of different conversations."""
    place = F.struct(F.col("conv_id").alias("conv"), F.col("o_turn").alias("turn"))
    first = stage(originals.groupBy("hash").agg(F.min(place).alias("o")), "chat-first")
    other = originals.join(broadcast_if_small(first), "hash").filter(F.col("conv_id") != F.col("o.conv"))
    return first.join(other.groupBy("hash").agg(F.min(place).alias("o2")), "hash", "left")


def _elsewhere() -> Column:
    """The first of the two least originals that is not in the quoter's conversation."""
    own = F.coalesce(F.col("o.conv") == F.col("conv_id"), F.lit(False))
    return F.when(own, F.col("o2")).otherwise(F.col("o"))


def _link_pieces(loose: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, part): the message that holds most of the pieces of a quote, the
    earliest of them; within the conversation before, else anywhere.

    Messages of a conversation that hold the same wanted pieces are one class,
    of which the earliest counts; across conversations likewise."""
    asked = stage(loose.select("q", "conv_id", "turn", F.explode("pieces").alias("piece")), "chat-asked")
    held = (rows.filter("level = 0 and conv_id is not null and turn is not null")
            .select("conv_id", "turn", F.explode(_pieces(F.col("body"))).alias("piece"))
            .join(asked.select("piece").distinct(), "piece", "left_semi"))
    classes = stage(held.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("piece")).alias("held"))
                    .groupBy("conv_id", "held").agg(F.min("turn").alias("o_turn"))
                    .withColumn("hash", F.sha2(F.array_join("held", ","), 256)), "chat-classes")
    near = classes.select(F.col("conv_id").alias("n_conv"), "o_turn", F.explode("held").alias("n_piece"))
    best = (asked.join(near, (F.col("conv_id") == F.col("n_conv")) & (F.col("piece") == F.col("n_piece"))
                       & (F.col("o_turn") < F.col("turn")))
            .groupBy("q", "conv_id", "o_turn").agg(F.count("*").alias("n"))
            .groupBy("q", "conv_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "o_turn")).alias("b")))
    here = stage(best.select("q", F.struct(F.col("conv_id").alias("conv"), F.col("b.o_turn").alias("turn")).alias("part")), "chat-near")
    sets = classes.groupBy("hash").agg(F.first("held").alias("held"))
    far = _two_least(classes).join(sets, "hash").select("hash", "o", "o2", F.explode("held").alias("piece"))
    there = (asked.join(here, "q", "left_anti").join(far, "piece").select("q", "hash", "piece", _elsewhere().alias("part"))
             .filter("part is not null").groupBy("q", "hash", "part").agg(F.count("*").alias("n"))
             .groupBy("q").agg(F.min(F.struct((-F.col("n")).alias("n"), "part")).alias("b")).select("q", "b.part"))
    return here.unionByName(there)


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n_quotes, n_linked, to_conv, to_turn) of messages with quotes."""
    parsed = parse(messages)
    rows = parsed.select("conv_id", "turn", F.posexplode("passages").alias("nth", "p")).select(
        "conv_id", "turn", "nth", "p.level", "p.body", _normal(F.col("p.body")).alias("normal")).filter(
        _long(F.col("normal"))).select("conv_id", "turn", "nth", "level", "body", F.sha2("normal", 256).alias("hash"))
    quotes = stage(rows.filter("level > 0").select("conv_id", "turn", "nth", "level", "hash", _pieces(F.col("body")).alias("pieces"))
                   .distinct().withColumn("q", F.monotonically_increasing_id()), "chat-quotes")
    wanted = quotes.select("hash").distinct()
    originals = stage(rows.filter("level = 0 and conv_id is not null and turn is not null").join(wanted, "hash", "left_semi")
                      .groupBy("conv_id", "hash").agg(F.min("turn").alias("o_turn")), "chat-originals")
    first = _two_least(originals)
    near = originals.select(F.col("conv_id").alias("n_conv"), F.col("hash").alias("n_hash"), "o_turn")
    found = (quotes.join(near, (F.col("conv_id") == F.col("n_conv")) & (F.col("hash") == F.col("n_hash"))
                         & (F.col("o_turn") < F.col("turn")), "left")
             .join(first, "hash", "left"))
    far = _elsewhere()
    found = stage(found.select("conv_id", "turn", "nth", "level", "q", "pieces", F.coalesce(
        F.when(F.col("o_turn").isNotNull(), F.struct(F.col("conv_id").alias("conv"), F.col("o_turn").alias("turn"))), far).alias("to")),
        "chat-found")
    loose = found.filter("to is null")
    if loose.take(1):
        found = found.join(_link_pieces(loose, rows), "q", "left").withColumn("to", F.coalesce("to", "part"))
    picked = F.min(F.when(F.col("to").isNotNull(), F.struct("level", "nth", "to")))
    return found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"), picked.alias("pick")).select(
        "conv_id", "turn", "n_quotes", "n_linked",
        F.col("pick.to.conv").alias("to_conv"), F.col("pick.to.turn").alias("to_turn"))


def _paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path) of messages that answer an earlier one of their
    own conversation.  ``head`` is the message a path so far starts from."""
    now = stage(links.filter("to_conv = conv_id and to_turn < turn").select(
        "conv_id", "turn", F.col("to_turn").alias("head"), F.array("turn").alias("path")), "chat-paths")
    while True:
        up = now.select(F.col("conv_id").alias("u_conv"), F.col("turn").alias("u_turn"),
                        F.col("head").alias("u_head"), F.col("path").alias("u_path"))
        joined = now.join(up, (F.col("conv_id") == F.col("u_conv")) & (F.col("head") == F.col("u_turn")), "left")
        now = stage(joined.select("conv_id", "turn", F.coalesce("u_head", "head").alias("head"),
                                  F.concat(F.coalesce("u_path", F.array().cast("array<bigint>")), "path").alias("path"),
                                  F.col("u_head").isNotNull().alias("moved")), "chat-paths")
        if not now.filter("moved").take(1):
            return now.select("conv_id", "turn", F.concat(F.array("head"), "path").alias("path"))


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message row in reply order: conv_id, turn, role, text
    (without quotes), n_quotes, n_linked, to_conv, to_turn, path."""
    messages = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    links = stage(link(messages), "chat-links")
    paths = _paths(links)
    left = links.select(F.col("conv_id").alias("l_conv"), F.col("turn").alias("l_turn"), "n_quotes", "n_linked",
                        "to_conv", "to_turn")
    path = paths.select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"), "path")
    quoted = F.coalesce(F.col("text").rlike(r"(?m)" + QUOTE), F.lit(False))
    zero, nobody = F.lit(0).cast("long"), F.lit(None)
    plain = messages.filter(~quoted).select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), zero.alias("n_quotes"),
        zero.alias("n_linked"), nobody.cast(messages.schema["conv_id"].dataType).alias("to_conv"),
        nobody.cast("long").alias("to_turn"), F.array("turn").alias("path"))
    answers = (parse(messages.filter(quoted))
               .join(left, F.col("conv_id").eqNullSafe(F.col("l_conv")) & F.col("turn").eqNullSafe(F.col("l_turn")), "left")
               .join(path, (F.col("conv_id") == F.col("p_conv")) & (F.col("turn") == F.col("p_turn")), "left")
               .select("conv_id", "turn", "role", F.col("clean").alias("text"),
                       F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
                       "to_conv", "to_turn", F.coalesce("path", F.array("turn")).alias("path")))
    return plain.unionByName(answers).orderBy("conv_id", "path", "role", "text")


def digest(ordered: DataFrame) -> DataFrame:
    return ordered.select("conv_id", "turn", "role", "n_quotes", "n_linked", "to_conv", "to_turn",
                          F.array_join(F.transform("path", lambda t: t.cast("string")), "/").alias("reply_path"),
                          sha256_utf8(F.col("text")).alias("text_sha256"))
