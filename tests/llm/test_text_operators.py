"""Language spans, unit dedup, licences, quote linking, the pipeline."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute as B
from tests.llm.fixtures import DOC_SCHEMA, ITEMS, documents, prose
from wardcast.llm import chat, langid, licenses, linededup, queries


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# ------------------------------------------------------------ languages

@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(prose(rng, 80, lang), lang) for lang in ("en", "de", "ru") for _ in range(60)] + [("x", None), (None, "en")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_language_held_out(spark, model):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(5, 60), lang), lang) for i, lang in enumerate(["en", "de", "ru"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_spans_of_mixed_text(spark, model):
    rng = random.Random(3)
    a, b = prose(rng, 60, "en").replace("\n", " "), prose(rng, 60, "ru").replace("\n", " ")
    df = spark.createDataFrame([(0, a + " " + b)], "doc_id long, text string")
    r = langid.identify(df, model).first()
    assert [s.lang for s in r.spans] == ["en", "ru"]
    assert abs(r.spans[1].start - len(a) - 1) <= 2 and r.spans[-1].end <= len(a) + 1 + len(b)


def test_language_edges(spark, model, docs, rows, empty):
    out = langid.identify(docs, model).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    blank = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert all((r.lang_pred == "und") == (r.doc_id in blank) for r in out if r.doc_id is not None)
    assert langid.identify(empty, model).count() == 0
    untrained = langid.train(empty.select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(docs, untrained).collect()} == {"und"}


def test_viterbi_against_plain_recursion():
    import numpy as np
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 40, 3, 0, 17]
    of = np.repeat(np.arange(len(lengths)), lengths)
    scores = rng.normal(size=(sum(lengths), 3)).astype(np.float32) * 2
    path = langid.viterbi(scores, of, len(lengths), switch=1.5)

    def value(s, p):
        return sum(s[t][p[t]] for t in range(len(s))) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))

    import itertools
    for d, n in enumerate(lengths):
        s, p = scores[of == d], path[of == d]
        if 0 < n <= 6:
            best = max(value(s, q) for q in itertools.product(range(3), repeat=n))
            assert value(s, p) == pytest.approx(best, abs=1e-4)


# ------------------------------------------------------------ units

def units_brute(rows, breaks):
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    # the order of equal doc_ids is by text hash in the operator: compare sets of removals per unit instead
    places = {}
    for unnamed, doc, text in order:
        for s, e, u in linededup.units(text, re.compile(breaks)):
            places.setdefault(u, []).append((unnamed, doc, text, s, e))
    return {u: p for u, p in places.items() if len(p) > 1}


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_unit_dedup(docs, rows, unit):
    again = units_brute(rows, linededup.BREAKS[unit])
    removed = linededup.repeated_units(docs, unit).collect()
    assert len(removed) == sum(len(p) - 1 for p in again.values())
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1])
    for r in removed:
        assert any(t and " ".join(t[r.start:r.end].split()).lower().encode() in again for t in texts[r.doc_id])
        assert r.keeper.doc_id is not None or r.doc_id is None
        if r.doc_id is not None:
            assert (r.keeper.doc_id, r.keeper.start) <= (r.doc_id, r.start) or r.keeper.doc_id == r.doc_id


def test_unit_dedup_texts(docs, rows, empty):
    out = linededup.deduplicate_units(docs)
    assert sorted(c for c in out.columns if c != "removed") == sorted(docs.columns)
    got = out.collect()
    assert len(got) == len(rows)
    originals = Counter((r[0], r[1]) for r in rows)
    clean = Counter((r.doc_id, r.text) for r in got if not r.removed)
    assert all(n <= originals[k] for k, n in clean.items())
    kept = Counter()
    for text in {(r.doc_id, r.text) for r in got}:
        kept.update(u for _, _, u in linededup.units(text[1], re.compile(linededup.BREAKS["sentence"])))
    assert max(kept.values()) == 1
    assert linededup.deduplicate_units(empty).count() == 0


def test_unit_dedup_runs_of_short_units(spark):
    passage = "This is the first long sentence here. Oh yes. No! And here the second long sentence stands."
    menu = "Home\nAbout us\nContact\nSite map"
    chinese = "今天天气很好我们一起去公园散步吧。"
    rows = [(0, f"Zero goes before it all.\n{passage}\nYes. No. Why? Go on."), (1, f"{passage} Oh yes."),
            (2, menu), (3, f"{menu}\nA long sentence that nobody else has. Yes. No. Why? Go on."),
            (4, chinese), (5, f"前面。{chinese}"), (6, "Oh yes. No! And that is all that I say.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduplicate_units(df).collect()}
    assert got[1].text.split() == ["Oh", "yes."]                         # short, at the end, alone
    assert got[3].text.strip() == "A long sentence that nobody else has."
    assert got[5].text == "前面。" and got[6].text == rows[6][1] and got[0].text == rows[0][1]
    spans = [(s.start, s.end) for s in got[1].removed]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and len(spans) == 3


# ------------------------------------------------------------ licences

def test_license_scan(spark, empty):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(0, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
            (1, "a/x.py", "print(1)"), (2, "a/b/c/y.py", "print(2)"), (3, "b/z.py", "print(3)"),
            (4, "a/b/w.py", "# Released under the MIT License.\n" + "code line here\n" * 30),
            (5, "a/b/COPYING", gpl), (6, "a/b/c/d/v.py", None), (7, None, "no path"), (8, None, gpl),
            (9, "b/q.py", "The license plate of the car\nwas lost near the river bank"),
            (9, "b/q.py", "The license plate of the car\nwas lost near the river bank")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in licenses.scan(df).collect()}
    assert got[0] == ("Apache-2.0", "file", None) and got[1] == ("Apache-2.0", "inherited", "a")
    assert got[2] == ("GPL-3.0", "inherited", "a/b") and got[6] == ("GPL-3.0", "inherited", "a/b")
    assert got[3] == (None, "none", None) and got[4] == ("MIT", "notice", None)
    assert got[5][:2] == ("GPL-3.0", "file") and got[7][1] == "none" and got[8][0] == "GPL-3.0"
    assert got[9] == (None, "none", None) and licenses.scan(df).count() == len(rows)
    none = empty.select("doc_id", F.col("source").alias("path"), "text")
    assert licenses.scan(none).count() == 0


def test_license_cosine_against_plain(spark):
    import math
    texts = ["Released under the MIT License", "licensed under the apache license version 2.0 now", "mit mit license"]
    found = spark.createDataFrame([(t,) for t in texts] + [(texts[0],)], "block string")
    got = {r.block: (r.license, r.score) for r in licenses.score_blocks(found).collect()}

    def terms(t):
        return [x for x in re.split(licenses.TERM_BREAK, t.lower()) if x]

    df, n = Counter(), 4
    for t in texts:
        for w in set(terms(t)):
            df[w] += 2 if t == texts[0] else 1
    def vec(t):
        v = {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(terms(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}
    for t in texts:
        b = vec(t)
        best = min((-round(sum(b.get(w, 0) * x for w, x in vec(tt).items()), 6), lic) for lic, tt in licenses.TEMPLATES)
        if -best[0] >= licenses.LEAST_COSINE:
            assert got[t][0] == best[1] and got[t][1] == pytest.approx(-best[0], abs=1e-5)
        else:
            assert t not in got


def test_license_noncommercial_spdx_and_unknown(spark):
    rows = [(0, "a/LICENSE", "Released under the MIT License."),
            (1, "a/x", "Licensed under CC BY-NC 4.0.\n" + "code line here\n" * 30),
            (2, "a/y", "Licensed under CC BY-NC-ND 3.0.\n" + "code line here\n" * 30),
            (3, "a/z", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
                       "International License.\n" + "code line here\n" * 30),
            (4, "a/v", "// SPDX-License-Identifier: Zlib\n" + "code line here\n" * 30),
            (5, "a/w", "// SPDX-License-Identifier: MIT OR Apache-2.0\n" + "code line here\n" * 30),
            (6, "a/u", "Distributed under the Quux Shareware License; ask the author before any use.\n" + "code line here\n" * 30),
            (7, "a/t", "Sold as is in the shop."), (8, "a/s", "plain"),
            (9, "a/r", "Licensed under CC BY 4.0."), (10, "b/r", "Licensed under CC BY-NC.\n" + "code line here\n" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got[1] == ("CC-BY-NC-4.0", "notice") and got[2] == ("CC-BY-NC-ND-3.0", "notice")
    assert got[3] == ("CC-BY-NC-SA-4.0", "notice") and got[4] == ("Zlib", "notice")
    assert got[5] == ("MIT OR Apache-2.0", "notice") and got[6] == (None, "unknown")
    assert got[7] == got[8] and got[8][1] == "inherited"
    assert got[9] == ("CC-BY-4.0", "file") and got[10] == ("CC-BY-NC", "notice")


def test_license_whole_texts(spark):
    texts = dict(licenses.full_texts())
    mit = "Copyright (c) 2021 Jane Roe and others\n\n" + texts["MIT"]
    rows = [(0, "a/LICENSE", mit), (1, "a/x", "plain"), (2, "b/COPYING", texts["GPL-3.0"].replace("\n", "\n# ")),
            (3, "b/c/x", "plain"), (4, "d/LICENSE", texts["CC-BY-SA-4.0"]), (5, "d/x", "plain"),
            (6, "e/LICENSE", texts["BSD-3-Clause"].replace("copyright holder", "Example Institute")), (7, "e/x", None),
            (8, "f/x.c", mit.replace("\n", "\n * ") + "\nint add a b return sum of values here" * 200), (9, "f/y.c", "plain")]
    rows += [(100 + i, f"g{i}/LICENSE", t) for i, t in enumerate(texts.values())]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert got[0] == ("MIT", "file") and got[1] == ("MIT", "inherited")
    assert got[2] == ("GPL-3.0", "file") and got[3] == ("GPL-3.0", "inherited")
    assert got[4] == ("CC-BY-SA-4.0", "file") and got[5] == ("CC-BY-SA-4.0", "inherited")
    assert got[6] == ("BSD-3-Clause", "file") and got[7] == ("BSD-3-Clause", "inherited")
    assert got[8][1] == "notice" and got[9] == (None, "none")
    assert [got[100 + i] for i in range(len(texts))] == [(name, "file") for name in texts]


def test_whole_texts_of_licenses_that_are_not_here(spark):
    """A text that differs from a known one by its name is not that licence: unknown, and nothing inherits."""
    texts = dict(licenses.full_texts())
    assert not {"AGPL-3.0", "CC-BY-4.0", "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"} & set(texts)
    rows = [(0, "a/LICENSE", texts["GPL-3.0"].replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC", 1)), (1, "a/x", "plain")]
    for i, name in enumerate(("", "-NonCommercial", "-NoDerivatives", "-NonCommercial-ShareAlike", "-NonCommercial-NoDerivatives"), 1):
        rows += [(10 * i, f"b{i}/LICENSE", texts["CC-BY-SA-4.0"].replace("Attribution-ShareAlike", f"Attribution{name}", 1)),
                 (10 * i + 1, f"b{i}/x", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df).collect()}
    assert all(got[10 * i] == (None, "unknown") and got[10 * i + 1] == (None, "none") for i in range(6) if i)
    assert got[0] == (None, "unknown") and got[1] == (None, "none")


# ------------------------------------------------------------ conversations

def test_quote_linking(spark):
    rows = [(1, 0, "user", "How do I boil an egg properly?\n\nAnd what about toast in the morning?"),
            (1, 1, "assistant", "> And what about toast in the morning?\nUse a toaster."),
            (1, 2, "assistant", "> how do I   BOIL an egg properly?\nTen minutes."),
            (1, 3, "user", ">> how do I boil an egg properly?\n> Ten minutes.\nToo long."),
            (1, 4, "user", "Thanks a lot for that."),
            (2, 0, "user", "> Use a toaster.\nWhich toaster do you use?"),
            (2, 1, "user", "> never said by anybody at all\nHm."),
            (3, 0, None, None), (3, 1, "user", ""), (None, 2, "user", "> Thanks a lot for that.\nok"),
            (3, 1, "user", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")
    got = {(r.conv_id, r.turn): r for r in chat.conversations(df).collect()}
    assert got[1, 1].text == "Use a toaster." and list(got[1, 1].path) == [0, 1] and got[1, 1].n_linked == 1
    assert list(got[1, 2].path) == [0, 2]
    # level 1 (outermost) is "Ten minutes.", too short to link; the nested quote links to turn 0
    assert got[1, 3].to_turn == 0 and got[1, 3].text == "Too long."
    assert list(got[1, 4].path) == [4]
    assert (got[2, 0].to_conv, got[2, 0].to_turn) == (1, 1) and list(got[2, 0].path) == [0]
    assert got[2, 1].n_quotes == 1 and got[2, 1].n_linked == 0
    assert got[None, 2].to_conv == 1 and got[3, 0].text == ""
    order = [(r.conv_id, r.turn) for r in chat.conversations(df).filter("conv_id = 1").collect()]
    assert order == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4)]
    assert chat.conversations(df).count() == len(rows) and chat.conversations(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, t, "user", (f"> message number {t - 1} stands here\n" if t else "") + f"message number {t} stands here")
            for t in range(40)] + [(1, 40, "user", "> message number 2 stands here\nside branch of the talk")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: list(r.path) for r in chat.conversations(df).collect()}
    assert got[39] == list(range(40)) and got[40] == [0, 1, 2, 40]


def test_quote_of_a_passage_first_said_later_in_the_own_conversation(spark):
    said = "the very same passage stands here"
    rows = [(1, 0, "user", f"> {said}\nfirst"), (1, 1, "user", said), (2, 5, "user", said), (3, 0, "user", said),
            (4, 0, "user", f"> {said}\nsecond")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.to_conv, r.to_turn) for r in chat.conversations(df).collect()}
    assert got[1, 0] == (2, 5) and got[4, 0] == (1, 1)


def test_quotes_of_lines_and_sentences(spark):
    recipe = "Boil the water in a pot.\nPut the egg into it. Wait for ten whole minutes.\nTake the egg out again."
    rows = [(1, 0, "user", recipe), (1, 1, "user", "Take the egg out again."),
            (1, 2, "user", "> Put the egg into it. Wait for ten whole minutes.\nWhy?"),
            (1, 3, "user", "> Boil the water in a pot.\n> Take the egg out again.\nOk."),
            (1, 4, "user", "> Wait for ten\n> whole minutes.\nOk."), (1, 5, "user", "> Wait for eleven minutes.\nNo."),
            (2, 0, "user", "> Wait for ten whole minutes.\nAnd then?"), (2, 1, "user", "今日は天気がとてもいいです。散歩に行きましょう。"),
            (2, 2, "user", "> 散歩に行きましょう。\nはい"), (2, 3, "user", "> 今日は天気がとてもいいです。散歩に行きましょう。\nはい")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.to_conv, r.to_turn, r.n_quotes, r.n_linked) for r in chat.conversations(df).collect()}
    assert got[1, 2] == (1, 0, 1, 1) and got[1, 3] == (1, 0, 1, 1) and got[1, 4] == (1, 0, 1, 1)
    assert got[1, 5] == (None, None, 1, 0) and got[2, 0] == (1, 0, 1, 1)
    assert got[2, 2] == (2, 1, 1, 1) and got[2, 3] == (2, 1, 1, 1)


# ------------------------------------------------------------ pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from tokenizers import Tokenizer
    from wardcast.llm import quality, secrets
    # one text per doc_id: which of two texts under one id stays is settled by their hashes
    rows = [r[:5] for r in documents(11)[:-1] if r[0] is not None]
    for i in range(900, 903):
        text = prose(random.Random(i), 60) + ' password = "hunter2hunter2" ' + prose(random.Random(i + 5000), 60)
        rows.append((i, text, "en", "src0", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, P.run(spark, str(tmp_path)).collect()))

    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}   # thresholds; base rule is checked elsewhere
    assert not any(verdict[r[0]] for r in rows if B.quality_counts(r[1])[-1] and sum(x[0] == r[0] for x in rows) == 1)
    kept = [(r[0], r[1]) for r in rows if verdict[r[0]]]
    left, seen = [], set()
    for (i, t), (n, c) in zip(kept, B.similarity_components(kept)):
        if i == c and i not in seen:
            seen.add(i)
            left.append((i, t))
    bad = {e[0] for e in B.contamination(left, ITEMS) if e[-1]}
    tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    expected = {}
    for i, t in left:
        if i not in bad and B.secret_base(t)[:3] == (0, 0, 0):
            ids = tok.encode(t, add_special_tokens=False).ids
            expected[i] = (i, len(ids), B.sha(",".join(map(str, ids))), B.sha(t))
    out = {g[0]: g for g in got}
    assert len(out) == len(got) and set(out) == {i for i, _ in left if i not in bad}
    assert all(out[i] == e for i, e in expected.items())
    masked = set(out) - set(expected)
    texts, planted = dict(left), {900, 901, 902}
    spans = {r.doc_id: r.spans for r in secrets.scan(docs.filter(docs.doc_id.isin(sorted(masked)))).collect()}
    for i in masked:
        text, at = "", 0                    # union of the reported spans, each masked once
        for s in spans[i]:
            if s.start >= at:
                text += texts[i][at:s.start] + secrets.MASK
            at = max(at, s.end)
        assert out[i][3] == B.sha(text + texts[i][at:])
    assert planted <= masked and all(out[i][3] == B.sha(texts[i].replace('password = "hunter2hunter2', "[SECRET]")) for i in planted)


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline as P
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
