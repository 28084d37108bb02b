"""Token alignment, vector codes and token counts against plain Python."""

import hashlib
import math
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import DOC_SCHEMA, documents, prose
from wardcast.llm import bytelevel, tokalign, tokencount, vectorcodes
from wardcast.llm.bpe import byte_alphabet
from wardcast.llm.queries import tokenizer_path

A_FILE, B_FILE = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")

HARD = ["a" * 5000, " " * 3000, "x" * 300 + " <|endoftext|> " * 200, "ab<|endoftext|>" * 300, "字" * 700 + "é ñ" * 300,
        "\n\n \t" * 900, "it's we'll they're " * 120, "'" * 1000 + "ll" * 300, None, "", "🙂" * 500 + "‍" * 100,
        "1234567890" * 300, "   " * 500, "ⅷ٣𝟘" * 300, "<s></s><unk><0x0A>", "▁ab", "\x00\x01a", "é  a  ", " lead", "a ",
        "<|endoftext|" * 40, "a" * 255 + " " + "b" * 1023 + "\n" + "c" * 63, "word " * 400, "\u0085 " * 200]


def library(special=True):
    t = Tokenizer.from_file(A_FILE)
    t.encode_special_tokens = not special
    return t


# ---- operator 13 ----

def test_settled_characters_encode_alike():
    """The encoder by ranks and the library agree on every character of the settled blocks, in context."""
    enc = bytelevel.ByteLevel(open(A_FILE, encoding="utf-8").read(), False)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bytelevel.UNSETTLED.search(chr(c))]
    assert len(chars) > 30_000
    texts = [f"a{c}1{c}!{c} {c}{c}\n{c} {c}'s" for c in chars]
    assert all(map(enc.settled, texts))
    for i in range(0, len(texts), 5000):
        part = texts[i:i + 5000]
        assert enc.ids(part) == [e.ids for e in enc.library.encode_batch_fast(part, add_special_tokens=False)]


@pytest.mark.parametrize("cuts", [{}, {"long": 100, "chunk": 64, "overlap": 20}, {"long": 1000, "chunk": 700, "overlap": 256}])
def test_token_counts(spark, cuts):
    rows = documents() + [(1000 + i, t, "en", "s", 1, 1, "x", 2, "y", 3) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)
    lib = library()
    got = tokencount.count(docs, A_FILE, limit=50, **cuts).collect()
    want = []
    for r in rows:
        t = r[1] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want.append((r[0], len(t.encode()), n, n > 50))
    assert Counter(map(tuple, got)) == Counter(want)


def test_token_counts_widen_and_keep_columns(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 8, 400]))) for _ in range(300))
    names = ("uid", "kept", "size", "text", "no")
    docs = spark.createDataFrame([(7, "k", 1, text, 2)] * 2, "uid long, kept string, size int, text string, no int")
    got = tokencount.count(docs, A_FILE, keep=names, long=100, chunk=64, overlap=20).collect()
    n = len(library().encode(text, add_special_tokens=False).ids)
    assert [tuple(r) for r in got] == [(7, "k", 1, text, 2, len(text), n, n > 1024)] * 2
    with pytest.raises(ValueError, match="collide"):
        tokencount.count(docs.withColumnRenamed("no", "n_tokens"), A_FILE, keep=("n_tokens",))


def test_token_counts_empty(spark):
    assert tokencount.count(spark.createDataFrame([], DOC_SCHEMA), A_FILE).collect() == []


def test_margin_is_needed_and_enough():
    """Cut at every place of awkward texts: all reported ends are ends of the whole text's pieces."""
    enc = bytelevel.ByteLevel(open(A_FILE, encoding="utf-8").read(), True)
    margin = 2 + len("<|endoftext|>")
    for text in ("we'll it's  \n x<|endoftext|>  y'll 12 34!! ", "ab   <|endoftext|> 'll 're", " a  b\t\t\n  c ''ll "):
        whole = set(tokencount.piece_ends(enc.spans.encode(text, add_special_tokens=False), 0)[0].tolist())
        for cut in range(margin + 1, len(text)):
            ends, _ = tokencount.piece_ends(enc.spans.encode(text[:cut], add_special_tokens=False), 0)
            assert {e for e in ends.tolist() if e <= cut - margin} <= whole


# ---- operator 11 ----

sorted_lists = st.lists(st.integers(0, 400), unique=True, max_size=120).map(sorted)


@settings(max_examples=200, deadline=None)
@given(sorted_lists, sorted_lists)
def test_gallop_finds_places(a, b):
    x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    assert tokalign.gallop(x, y).tolist() == [bisect_left(b, v) for v in a]
    i, j = tokalign.common_ranks(x, y)
    assert x[i].tolist() == y[j].tolist() == sorted(set(a) & set(b))


def aligned(rows):
    """Plain version: groups from set intersections, links by nested loops."""
    lib, model, alphabet = library(False), sentencepiece.SentencePieceProcessor(model_file=B_FILE), byte_alphabet()
    name = {i: t for t, i in lib.get_vocab().items()}
    docs, count = [], Counter()
    for key, t in rows:
        a, b = lib.encode(" " + (t or ""), add_special_tokens=False).ids, model.encode(t or "")
        ab = [bytes(alphabet[c] for c in name[i]) for i in a]
        bb = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i)
              else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + t).encode() if t else None
        if not t or b"".join(ab) != whole or b"".join(bb) != whole:
            docs.append((key, None))
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        count.update(links.keys())
        docs.append((key, (len(a), len(b), groups, links)))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for key, d in docs:
        if d is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = d
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((key, na, nb, len(groups), sum(links.values()),
                    sum(m for p, m in links.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in links.items()),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 40])
def test_alignment(spark, broadcast_rows):
    rows = documents() + [(1000 + i, t and t[:600], "en", "s", 1, 1, "x", 2, "y", 3) for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(4)
    got = tokalign.align(docs, A_FILE, B_FILE, broadcast_rows=broadcast_rows).collect()
    assert Counter(map(tuple, got)) == Counter(aligned([(r[0], r[1]) for r in rows]))


def test_alignment_in_small_pieces(monkeypatch):
    texts = [t or "" for t in HARD]
    aligner = tokalign.Aligner(open(A_FILE, encoding="utf-8").read(),
                               bytelevel.check_byte_level(open(A_FILE, encoding="utf-8").read()), open(B_FILE, "rb").read())
    whole = aligner.align(texts)
    monkeypatch.setattr(tokalign, "LINK_BLOCK", 7)
    for x, y in zip(whole, aligner.align(texts)):
        assert x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all() and x[6].sum() == x[3]


def test_alignment_splits_long_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(1, prose(random.Random(5), 900), 4), (2, None, 5)], "doc_id long, text string, first int")
    want = [tuple(r) for r in tokalign.align(docs, A_FILE, B_FILE, keep=("doc_id", "first")).collect()]
    monkeypatch.setattr(tokalign, "PAIR_ROW", 10)
    grouped = tokalign.groups(docs, A_FILE, B_FILE)
    assert grouped.count() > 10 and grouped.filter("first").count() == 2
    got = [tuple(r) for r in tokalign.align(docs, A_FILE, B_FILE, keep=("doc_id", "first")).collect()]
    assert sorted(got) == sorted(want)


def test_alignment_empty(spark):
    assert tokalign.align(spark.createDataFrame([], DOC_SCHEMA), A_FILE, B_FILE).collect() == []


def test_pair_counts_join_has_no_hot_key(spark):
    """Pairs that many documents hold are broadcast, the shuffled rest has a bound a pair."""
    docs = spark.createDataFrame([(i, f"the same words here and then w{i}") for i in range(300)], "doc_id long, text string")
    grouped = tokalign.groups(docs, A_FILE, B_FILE)
    counts = tokalign.pair_counts(grouped)
    plan = tokalign.document_sums(grouped, counts, 20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert "BroadcastHashJoin" in (p := tokalign.document_sums(grouped, counts)._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" not in p


# ---- operator 12 ----

def coded(rows, parts=4, entries=256, rounds=4):
    """Plain version: every part against every entry."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(np.array([r[1] for r in fine], dtype=np.float64) * 1024).astype(np.int64)
    cut = np.split(v, parts, axis=1)
    books = [p[:entries].copy() for p in cut]

    def near(p, b):
        d = ((p[:, None, :] - b[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p, b in zip(cut, books):
            to, _ = near(p, b)
            for e in np.unique(to):
                b[e] = p[to == e].sum(0) // (to == e).sum()
    found = [near(p, b) for p, b in zip(cut, books)]
    error = sum(f[1] for f in found)
    by_label = Counter()
    for r, e in zip(fine, error):
        by_label[r[2]] += int(e)
    return [(r[0], r[2], "".join("%02x" % f[0][i] for f in found), int(error[i]), by_label[r[2]])
            for i, r in enumerate(fine)], books


SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector int, code int"


def vectors(n=400, d=12, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, d)), 2).astype(np.float32)
    v[: n // 3] = v[0]                                       # a third are copies
    rows = [(i, [float(x) for x in v[i]], None if i % 5 == 0 else i % 3) for i in range(n)]
    bad = [(n, None, 1), (n + 1, [1.0, None] * (d // 2), 1), (n + 2, [float("nan")] * d, 2), (n + 3, [float("-inf")] * d, None)]
    return [(*r, "x", 1, 2) for r in rows + bad + [(7, rows[7][1], 9), (None, rows[9][1], 1)] + rows[20:23]]


@pytest.mark.parametrize("entries", [256, 16])
def test_vector_codes(spark, entries):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out, books = vectorcodes.compress(df, entries=entries)
    want, plain = coded([r[:3] for r in rows], entries=entries)
    assert all((a == b).all() for a, b in zip(books, plain))
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_vector_codes_small_and_empty(spark):
    rows = vectors(30)
    out, books = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA))
    want, plain = coded([r[:3] for r in rows])
    assert [len(b) for b in books] == [35] * 4 and all((a == b).all() for a, b in zip(books, plain))
    assert Counter(map(tuple, out.collect())) == Counter(want)
    out, books = vectorcodes.compress(spark.createDataFrame([], SCHEMA))
    assert books == [] and out.collect() == []


def test_vector_codes_other_lengths(spark):
    rows = vectors(20) + [(-1, [], 1, "x", 1, 2), (-2, [1.0, 2.0], 1, "x", 1, 2), (99, [0.5] * 16, 1, "x", 1, 2)]
    out, _ = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA))
    got = {r.id: r for r in out.collect()}
    assert got[-1].code is got[-2].code is got[99].code is None and got[99].error is None and got[3].code


def test_label_sums_joined_by_parts(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(vectorcodes, "BROADCAST_ROWS", 0)
    out, _ = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, out.collect())) == Counter(coded([r[:3] for r in rows])[0])


@pytest.mark.parametrize("scale", [3, 10 ** 6, 2 ** 24])
def test_equal_average_search(scale):
    """Ties go to the lower index, in float64 and in 64-bit arithmetic."""
    rng = np.random.default_rng(scale)
    for d in (1, 3, 16):
        book, x = rng.integers(-scale, scale, (100, d)), rng.integers(-scale, scale, (1500, d))
        book[50:60] = book[:10]
        book[70] = book[71] + 1
        i, e = vectorcodes.Codebook(book).nearest(x)
        dist = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (i == dist.argmin(1)).all() and (e == dist.min(1)).all()


def test_search_refuses_what_does_not_fit():
    with pytest.raises(ValueError, match="too large"):
        vectorcodes.Codebook(np.full((2, 16), 1 << 28)).nearest(np.zeros((1, 16), dtype=np.int64))
