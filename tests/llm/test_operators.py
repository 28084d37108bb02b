"""The operators against plain Python on a table of awkward cases."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute as B
from tests.llm.fixtures import DOC_SCHEMA, ITEMS, documents
from wardcast.llm import bpe, decontam, idstore, ngramjoin, quality, queries, secrets


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def same(got, expected):
    assert Counter(got) == Counter(expected)


def test_quality(docs, rows):
    got = quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                     "n_repeat_words", "base_failed").collect()
    same(map(tuple, got), [(r[0], *B.quality_counts(r[1])) for r in rows])


def test_quality_filter_keeps_columns_and_rows(docs, rows):
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    verdict = Counter((r.doc_id, r.kept) for r in quality.judge(docs).select("doc_id", "kept").collect())
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter({i: n for (i, k), n in verdict.items() if k})
    assert not any(B.quality_counts(r.text)[-1] for r in kept.collect())


def test_quality_thresholds_follow_groups(spark):
    rows = [(i, " ".join(["abcde"] * 3 + [f"w{i}{k}" for k in range(20)]) + ("" if i % 50 else " #####" * 20),
             "en", "a", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
    assert kept == {i for i in range(300) if i % 50}


def _fence(values):
    """Upper fence of a group's values by the rule, None where it tells none."""
    b = sorted(v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0) for v in values)
    q50, q90 = (b[-(-k * len(b) // 10) - 1] for k in (5, 9))
    nonzero = [x for x in b if x]
    if len(b) < quality.MIN_ROWS:
        return None
    if q90 > q50:
        return q90 + 3 * (q90 - q50)
    return nonzero[(len(nonzero) + 1) // 2 - 1] - 1 if q90 == 0 and len(nonzero) >= 5 else None


def test_quality_fences_move_with_the_data(spark):
    """Each measure's fence is that of its group's values; other groups' rows do not move it."""
    rng = random.Random(5)
    schema = "lang string, source string, n_words long, m_avg_word long, m_symbols long, m_dup_lines long, m_repeats long"

    def rows(source, n, scale, share):
        return [("en", source, 50, rng.randrange(400, 400 + scale), rng.randrange(1, 9 * scale) if rng.random() < share else 0,
                 rng.randrange(1, scale) if rng.random() < share else 0, rng.randrange(scale)) for _ in range(n)]

    a, b, few = rows("a", 400, 100, 0.06), rows("b", 400, 300, 0.4), rows("few", 20, 50, 0.5)

    def fences(data):
        got = quality.thresholds(spark.createDataFrame(data, schema)).collect()
        return {r.source: r.asDict() for r in got}

    got = fences(a + b + few)
    for i, m in enumerate(("avg_word", "symbols", "dup_lines", "repeats")):
        for name, data in (("a", a), ("b", b), ("few", a + b + few)):
            assert got[name][f"{m}_hi"] == _fence([r[3 + i] for r in data])
        assert got["a"][f"{m}_hi"] != got["b"][f"{m}_hi"]
    wider = fences([(*r[:3], *(2 * v for v in r[3:])) for r in a] + b + few)
    assert wider["b"] == got["b"] and all(wider["a"][f"{m}_hi"] > got["a"][f"{m}_hi"] for m in ("symbols", "dup_lines", "repeats"))
    assert all(v is None for k, v in fences(few)["few"].items() if k not in ("lang", "source"))


def test_sketch_bucket_error(spark):
    v = spark.range(1, 5000).select(F.col("id").alias("v"), quality._bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.v and (r.v - r.b) * 64 <= r.v for r in v)


def test_secrets_base(docs, rows):
    found = secrets.scan(docs).select("doc_id", *[
        F.expr(f"cast(size(filter(spans, s -> s.kind = '{n}')) as bigint)").alias(n) for n in secrets.BASE],
        F.sha2(F.encode(secrets.span_text(F.expr("filter(spans, s -> s.kind in ('assign','access','hex'))")), "UTF-8"), 256)
        .alias("sha"))
    same(map(tuple, found.collect()), [(r[0], *B.secret_base(r[1])) for r in rows])


def test_weak_parts_need_a_complement(spark):
    far = "x" * 500
    rows = [(0, "login: root and https://host.example.com"),
            (1, "login: root password=hunter2hunter2"),
            (2, f"login: root {far} password=hunter2hunter2"),
            (3, "login: root\n\npassword=hunter2hunter2"),
            (4, "https://db.example.com:5432 key abcdefghij0123456789ABCDEFGHIJ0123456789 end"),
            (5, "key abcdefghij0123456789ABCDEFGHIJ0123456789 end"),
            (6, "login: root " * 300 + "token=abcdefgh1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: Counter(s.kind for s in r.spans) for r in secrets.scan(df).collect()}
    assert got[0] == {} and got[5] == {} and got[2] == {"assign": 1} and got[3] == {"assign": 1}
    assert got[1] == {"assign": 1, "id": 1}
    assert got[4] == {"endpoint": 1, "key": 1}
    near = sum(12 * i + 11 >= 3600 + 0 - secrets.REACH for i in range(300))
    assert got[6]["assign"] == 1 and got[6]["id"] == near


def test_redaction(docs, rows):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = [r.text for r in out.collect() if r.text]
    assert not any("hunter2" in t or "AKIAABCDEF" in t or "0123456789abcdef" * 2 in t for t in texts)
    assert sum(t.count(secrets.MASK) for t in texts) >= 30
    plain = {(r[0], r[1]) for r in rows if B.secret_base(r[1])[:3] == (0, 0, 0)}
    assert plain <= {(r.doc_id, r.text) for r in out.collect()}


def test_redaction_searches_the_texts_once(spark, docs, monkeypatch):
    """The patterns do not tell again which texts have spans; either way gives the same rows."""
    other = spark.createDataFrame([(None, "password = hunter2hunter2"), (None, "password = hunter2hunter2"),
                                   (7, "password = hunter2hunter2"), (7, None), (7, "plain"), (None, None)],
                                  "doc_id long, text string").repartition(3)
    for table in (docs, other):
        once = secrets.redact(table)
        assert "RLIKE" not in once._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(secrets, "HASHES", -1)
            again = secrets.redact(table)
        assert "RLIKE" in again._jdf.queryExecution().optimizedPlan().toString()
        same(map(tuple, once.collect()), map(tuple, again.collect()))
    got = [(r.doc_id, r.text) for r in secrets.redact(other).collect()]
    assert len(got) == 6 and sum(t is not None and secrets.MASK in t for _, t in got) == 3
    assert {t for _, t in got if t and secrets.MASK not in t} == {"plain"}


def test_decontamination(spark, docs, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.digest(decontam.match(docs, items)).collect()
    same(map(tuple, got), B.contamination([(r[0], r[1]) for r in rows], ITEMS))
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns
    bad = {e[0] for e in B.contamination([(r[0], r[1]) for r in rows], ITEMS) if e[-1]}
    assert bad and not bad & {r.doc_id for r in kept.collect()}
    nothing = items.limit(0)
    assert all(r.n_hit == 0 for r in decontam.match(docs, nothing).collect())


def test_decontamination_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontam, "broadcast_if_small", lambda df, *a: df)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.digest(decontam.match(docs, items)).collect()
    same(map(tuple, got), B.contamination([(r[0], r[1]) for r in rows], ITEMS))


def test_similarity_join(docs, rows):
    got = ngramjoin.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    expected = [(r[0], *e) for r, e in zip(rows, B.similarity_components([(r[0], r[1]) for r in rows]))]
    same(map(tuple, got), expected)


def test_similarity_join_frequent_classes(spark, docs, rows, monkeypatch):
    """Nearly every repeated shingle of the highest level: pairs of shingles carry the join."""
    monkeypatch.setattr(ngramjoin, "LEVELS", (2, 2, 2))
    got = ngramjoin.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    expected = [(r[0], *e) for r, e in zip(rows, B.similarity_components([(r[0], r[1]) for r in rows]))]
    same(map(tuple, got), expected)


def test_signatures_of_linked_sets_meet():
    import random

    import numpy as np
    rng = random.Random(2)
    for trial in range(400):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(10_000), n))
        b = set(a)
        while True:
            nxt = set(b)
            if rng.random() < 0.5 and len(nxt) > 1:
                nxt.remove(rng.choice(sorted(nxt)))
            else:
                nxt.add(rng.randrange(10_000))
            if not ngramjoin.linked(np.array(sorted(a), np.uint64), np.array(sorted(nxt), np.uint64)):
                break
            b = nxt
            if rng.random() < 0.05:
                break
        # found once only what one side has alone; the rest at any level, or all at the highest
        level = {x: rng.choice([1, 2, 3, 3]) if trial % 3 else 3 for x in a | b}
        level |= {x: 0 for x in a ^ b if rng.random() < 0.5}
        sa, sb = (set(ngramjoin.signatures(np.array(sorted(s), np.uint64),
                                           np.array([level[x] for x in sorted(s)], np.uint8))[0].tolist()) for s in (a, b))
        assert sa & sb, (sorted(a), sorted(b))


def kept_ids(rows):
    """How many rows of each doc_id stay: one of each component, all without words, and all of components without ids."""
    want = Counter()
    told = set()
    for r, (n, c, g) in zip(rows, B.similarity_groups([(r[0], r[1]) for r in rows])):
        if r[0] == c and (n == 0 or c is None or g not in told):
            want[r[0]] += 1
            told.add(g)
    return want


def test_join_table_grows_with_the_repeated_shingles(spark, monkeypatch):
    """Twice as many repeated shingles as the least table has places: texts of
    their own still have no signatures, and the table comes in pieces."""
    rnd = random.Random(5)
    alone, twice = ([" ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(120)) for _ in range(n)] for c, n in (("a", 60), ("b", 280)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(alone + twice + [t + " more" for t in twice])],
                                 "doc_id long, text string").repartition(5).cache()
    monkeypatch.setattr(ngramjoin, "ORDER_BITS", 14)
    monkeypatch.setattr(ngramjoin, "PIECE_BITS", 14, raising=False)
    levels = ngramjoin._level_table(ngramjoin._profile(docs))
    signed = ngramjoin._signature_rows(docs, levels).select("hi", "lo").collect()
    digests = {ngramjoin.digest(ngramjoin.word_list(t)) for t in twice + [t + " more" for t in twice]}
    assert {tuple(r) for r in signed} == digests
    assert levels[0] == 17 and len(levels[1]) == 8
    got = {r.doc_id: r.component_id for r in ngramjoin.join(docs).collect()}
    assert got == {i: i - 280 if i >= 340 else i for i in range(620)}


def test_deduplicate(docs, rows):
    kept = ngramjoin.deduplicate(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == kept_ids(rows)


def test_deduplicate_keeps_unrelated_texts_of_one_id(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (2, one), (3, two + " end"), (1, ""), (1, one), (4, "c d e f g h")]
    kept = ngramjoin.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, one), (1, two), (1, ""), (4, "c d e f g h")])


#: names that the operators themselves use for what they add to a table
OWN_NAMES = ("gone_id", "gone_text", "again_id", "rej_id", "bad_id", "bad_text", "secret_doc", "secret_spans", "units_id",
             "units_text", "units_removed", "langid_text", "doc", "c", "text_key", "component", "m_repeats", "uid", "kept", "first")


def test_columns_named_like_the_operators_own(spark, rows):
    """Every operator that keeps a table's columns keeps those, with their values."""
    from wardcast.llm import langid, linededup
    plain = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = plain.select("*", *[F.xxhash64("doc_id", F.lit(n)).alias(n) for n in OWN_NAMES]).repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for run in (quality.quality_filter, ngramjoin.deduplicate, lambda d: decontam.decontaminate(d, bench), secrets.redact,
                linededup.deduplicate_units):
        got, want = run(extra), run(plain)
        assert set(extra.columns) <= set(got.columns)
        cols = [c for c in want.columns if c != "removed"]
        same(map(tuple, got.select(*cols).collect()), map(tuple, want.select(*cols).collect()))
        assert got.filter(" or ".join(f"not ({n} <=> xxhash64(doc_id, '{n}'))" for n in OWN_NAMES)).count() == 0
    model = langid.train(plain.select("text", "lang"))
    assert langid.identify(extra, model, keep=("doc_id", "langid_text")).count() == len(rows)


def test_bpe_round_trip(docs, rows):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    out = bpe.encode(docs, path, outputs=("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"), keep=("doc_id", "spans"))
    expected = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        expected.append((r[0], r[6], len(ids), tuple(ids), B.sha(",".join(map(str, ids))), text, B.sha(text)))
    same([(r.doc_id, r.spans, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded, r.decoded_sha256) for r in out.collect()], expected)
    back = bpe.decode(out, path)
    same([(r.doc_id, r.text) for r in back.collect()], [(r[0], r[1] or "") for r in rows])


def test_bpe_forced_cuts():
    import json
    spec = json.load(open(queries.tokenizer_path("byte_bpe_50k.json")))
    tokens = bpe.token_bytes(spec)
    cut = bpe.forced_cuts(tokens)
    pairs = {(a, b) for t in tokens.values() for a, b in zip(t, t[1:])}
    assert all(cut[a, b] == ((a, b) not in pairs) for a in range(256) for b in range(256))


def test_bpe_small_cache_and_random_texts():
    import random

    from tokenizers import Tokenizer
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    codec = bpe.FragmentCodec(open(path, encoding="utf-8").read(), cache=50)
    rng = random.Random(4)
    alphabet = [*" \n\t\r 　àéAbz09'<|>.,!😀\x85\x1c", "<|endoftext|>", "'ll", "qzx" * 30, "  ", " à", "à "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for t, (ids, raw) in zip(texts, codec.encode(texts)):
        e = tok.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, e)) and raw.decode("utf-8", "replace") == tok.decode(e, skip_special_tokens=False)


def test_id_store(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    store = f"{tmp_path}/store"
    idstore.write_store(docs, store, path)
    got = idstore.read_store(spark, store)
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2])
    total, seen = 0, got.orderBy("start").collect()
    order = [r.doc_id for r in seen]
    assert order[0] is None and order[1:] == sorted(order[1:])
    for r in seen:
        assert r.start == total
        total += r.n_tokens
    assert total == sum(len(x) for v in ids.values() for x in v)
    keys = spark.createDataFrame([(3, 0), (3, 1), (3, 2), (3, 3), (4, 1), (None, 0), (10 ** 9, 0), (17, 0)], "doc_id long, nth long")
    hit = {(r.doc_id, r.nth): list(r.ids) for r in idstore.lookup(spark, store, keys).collect()}
    assert set(hit) == {(3, 0), (3, 1), (3, 2), (4, 1), (None, 0), (17, 0)}
    assert all(v in ids[d] for (d, _), v in hit.items())


def test_id_store_small_shards_and_unique_ids(spark, rows, tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    path = queries.tokenizer_path("word_bpe_49k.json")
    monkeypatch.setattr(idstore, "SHARD_DOCS", 4)
    unique = list({r[0]: (r[0], r[1]) for r in rows if r[0] is not None}.values())
    df = spark.createDataFrame(unique, "doc_id long, text string")
    idstore.write_store(df, f"{tmp_path}/s", path)
    got = idstore.read_store(spark, f"{tmp_path}/s").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    same(map(tuple, got), B.id_store(unique, Tokenizer.from_file(path)))


def test_minimal_perfect_hash():
    import numpy as np
    for n in (1, 2, 3, 10, 1000, 4096):
        keys = np.zeros(n, dtype=idstore.KEY)
        keys["doc"] = np.arange(n) * 7 - 3
        h = idstore.key_hash(keys)
        slots = idstore.slots_of(h, idstore.build_mph(h), n)
        assert sorted(slots.tolist()) == list(range(n))


def test_empty_tables(spark, empty, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert quality.judge(empty).count() == 0 and quality.quality_filter(empty).count() == 0
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0
    assert decontam.match(empty, items).count() == 0 and decontam.decontaminate(empty, items).count() == 0
    assert ngramjoin.join(empty).count() == 0 and ngramjoin.deduplicate(empty).count() == 0
    assert bpe.encode(empty, queries.tokenizer_path("byte_bpe_50k.json")).count() == 0
    idstore.write_store(empty, f"{tmp_path}/e", queries.tokenizer_path("word_bpe_49k.json"))
    assert idstore.read_store(spark, f"{tmp_path}/e").count() == 0


def test_id_store_numbers_occurrences_over_all_parts(spark, monkeypatch, tmp_path):
    """One doc_id over many parts and shards: every row has its own number, and each is found by it."""
    rows = [(7, f"word{i} and some more {i % 13}") for i in range(900)] + [(None, f"nothing {i}") for i in range(40)]
    rows += [(i, f"single {i}") for i in (1, 2, 6, 8, 9, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(idstore, "SHARD_DOCS", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        idstore.write_store(df, f"{tmp_path}/n", queries.tokenizer_path("word_bpe_49k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/n/parts").count() > 3
    got = {(r.doc_id, r.nth): r for r in idstore.read_store(spark, f"{tmp_path}/n").collect()}
    assert set(got) == {(7, i) for i in range(900)} | {(None, i) for i in range(40)} | {(i, 0) for i in (1, 2, 6, 8, 9, 300)}
    asked = [*got, (7, 900), (7, -1), (5, 0), (None, 40), (999, 0), (-1, 0)]
    keys = spark.createDataFrame(asked * 2, "doc_id long, nth long")
    hit = idstore.lookup(spark, f"{tmp_path}/n", keys)
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = hit.collect()
    assert len(rows) == len(got)
    for r in rows:
        assert got[r.doc_id, r.nth].start == r.start and got[r.doc_id, r.nth].n_tokens == len(r.ids)


def test_word_codec_encodes_each_piece_once():
    """Words that differ in case or punctuation only cost the tokenizer nothing more; ids are the library's."""
    from tokenizers import Tokenizer
    with open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    whole, codec = Tokenizer.from_str(source), idstore.WordCodec(source)
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return whole_pieces.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    whole_pieces, codec.pieces = codec.pieces, Counting()
    codec.encode(["Été Wort, wort. WORT", "wort (Wort) été"])
    assert sorted("\n".join(asked).split("\n")) == sorted([".", ",", "(", ")", "wort", "Ã©tÃ©"]) and not codec.known
    codec.pieces = whole_pieces

    odd = "".join(map(chr, range(1, 0x250))) + "́̇ 　KÅΣςﬁ\U0001f600漢"
    texts = [f"a{c}b {c} X{c}{c}'s" for c in odd]
    texts += ["", " ", "\n", "don't DON'T we'll 'S !'s 'still", "a <|endoftext|> b", "x<|startoftext|>y <|STARTOFTEXT|>", "İ Å"]
    small = idstore.WordCodec(source, cache=40)               # forgets all the time
    for c in (codec, small):
        for at in range(0, len(texts), 50):
            got = [np.frombuffer(b, "<u4").tolist() for b in c.encode(texts[at:at + 50])]
            assert got == [e.ids for e in whole.encode_batch_fast(texts[at:at + 50], add_special_tokens=False)]
    # a file whose pre-tokenizer is another one goes through the whole tokenizer
    other = json.loads(source)
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[\p{L}]+|[^\s\p{L}]+"}
    codec, whole = idstore.WordCodec(json.dumps(other)), Tokenizer.from_str(json.dumps(other))
    assert codec.pieces is None
    assert [np.frombuffer(b, "<u4").tolist() for b in codec.encode(texts)] == [
        e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_worker_holds_one_operators_state(monkeypatch):
    """Workers are used again: what an operator left there is dropped when another begins."""
    import weakref
    from wardcast.llm import common
    monkeypatch.setattr(common, "_HELD", {})
    with open(queries.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        source = f.read()
    codec = weakref.ref(bpe.codec_for(source))
    assert bpe.codec_for(source) is codec()
    with open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = weakref.ref(idstore.codec_for(f.read()))
    assert codec() is None and len(common._HELD) == 1
    common.drop_held()
    assert words() is None and not common._HELD
