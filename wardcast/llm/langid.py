"""Language identification of words and spans.

Script ranges narrow the candidates: a word's script (from code point
ranges) leaves only the languages that use this script in the training
texts.  Each word is scored per candidate by the log-probabilities of its
character trigrams, word ends included, and a Viterbi path over the words of
a text, with a penalty for each switch of language, labels spans of mixed
texts.  The language with most letters in the path is the prediction, its
share of the letters the score.

Training counts every trigram of every labelled text, hashed to a table of
fixed size, per language: tasks count, Spark sums.  The model holds
TABLE x languages numbers whatever the corpus holds.

Defined results: null text, and text without a letter, is ``und`` with score
0 and no spans; rows with null language are not learned from; with no
labelled row at all every text is ``und``; ties between languages go to the
first in alphabetical order; repeated rows each get a row; an empty table
gives an empty result; other columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import apart

UNKNOWN = "und"
TABLE = 1 << 16
SWITCH = 6.0        # log-probability a change of language costs
SCRIPT_SHARE = 0.01  # a language uses a script that has this share of its letters
CHUNK_CHARS = 2_000_000    # characters whose trigrams are held at a time
GROUP_CHARS = 16_000_000   # characters whose words are labelled together
FLUSH_LANGS = 64    # a task sends its counts on when it holds this many languages

#: first code point and script of each range; ranges end where the next starts
SCRIPT_RANGES = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
                 (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
                 (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
                 (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
                 (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
                 (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"),
                 (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
                 (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
                 (0x20000, "han"), (0x32000, "other"))
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_STARTS = np.array([a for a, _ in SCRIPT_RANGES], dtype=np.int64)
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], dtype=np.int8)

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Letter or not, and the lower-case form, of every code point."""
    chars = [chr(c) for c in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in chars), dtype=bool, count=len(chars))
    lower = np.arange(len(chars), dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = chars[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letter, lower


class Words:
    """The words (runs of letters) of several texts, as arrays."""

    def __init__(self, texts: list[str | None]):
        letter, lower = _tables()
        code = np.frombuffer(("\n" + "\n".join([t or "" for t in texts]) + "\n")
                             .encode("utf-32-le", "surrogatepass"), dtype="<u4")
        text_at = np.cumsum([1] + [len(t or "") + 1 for t in texts])[:-1] if texts else np.zeros(0, np.int64)
        is_letter = letter[code]
        low = np.where(is_letter, lower[code], _SPACE).astype(np.uint64)
        edge = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1   # the first and last codes are no letters
        begin, end = edge[0::2], edge[1::2]
        self.n = len(begin)
        self.letters = end - begin
        self.of = np.searchsorted(text_at, begin, side="right") - 1  # text of each word
        self.start = begin - text_at[self.of]
        # trigrams around every letter; a word's neighbours on both sides are the mark
        at = np.flatnonzero(is_letter)
        h = (low[at - 1] * np.uint64(0x100000001B3) + low[at]) * np.uint64(0x100000001B3) + low[at + 1]
        h = (h ^ (h >> np.uint64(29))) * _MUL
        self.gram = (h >> np.uint64(48)).astype(np.int64)
        self.gram_word = np.repeat(np.arange(self.n), self.letters)
        # a word's script is its first letter's
        self.script = _SCRIPT[np.searchsorted(_STARTS, code[begin].astype(np.int64), side="right") - 1]


def chunks(texts: list, limit: int = CHUNK_CHARS):
    """Slices of a batch with about ``limit`` characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


# ---------------------------------------------------------------- training

def count_features(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, feature, n): trigram counts, and letters per script at
    TABLE + script."""
    ship_package(labelled.sparkSession)
    width = TABLE + len(SCRIPTS)

    def rows(held):
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(counts[at])], names=["lang", "feature", "n"])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                names, code = np.unique(np.array(langs[lo:hi], dtype=object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    counts = held.setdefault(str(name), np.zeros(width, dtype=np.int64))
                    own = code[w.of] == k
                    counts[:TABLE] += np.bincount(w.gram[own[w.gram_word]], minlength=TABLE)
                    counts[TABLE:] += np.bincount(w.script[own], weights=w.letters[own],
                                                  minlength=len(SCRIPTS)).astype(np.int64)
                if len(held) >= FLUSH_LANGS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return (known.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
            .mapInArrow(run, "lang string, feature int, n long")
            .groupBy("lang", "feature").agg(F.sum("n").alias("n")))


class Model:
    """Log-probabilities per language and trigram, and languages per script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams = counts[:, :TABLE] + 0.5
        self.score = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        letters = counts[:, TABLE:]
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= SCRIPT_SHARE).T                      # script x language
        self.uses[~self.uses.any(axis=1)] = True                   # a script nobody uses narrows nothing

    def scored(self, w: Words) -> Words:
        """Give the words their scores and drop the trigrams, which take most room."""
        w.scores = self.emissions(w)
        del w.gram, w.gram_word
        return w

    def emissions(self, w: Words) -> np.ndarray:
        """words x languages; languages that do not use a word's script are ruled out."""
        out = np.zeros((w.n, len(self.langs)), dtype=np.float32)
        if w.n:
            starts = np.flatnonzero(np.diff(w.gram_word, prepend=-1))
            out = np.add.reduceat(self.score[w.gram], starts, axis=0)
            out[~self.uses[w.script]] = -1e6
        return out


def train(labelled: DataFrame) -> Model:
    """Fit on every labelled row.  The driver receives at most TABLE rows per
    language: the model itself."""
    found = count_features(labelled).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), TABLE + len(SCRIPTS)))
    at = {name: i for i, name in enumerate(langs)}
    counts[found["lang"].map(at).to_numpy(dtype=np.int64), found["feature"].to_numpy(dtype=np.int64)] = found["n"]
    return Model(langs, counts)


# ---------------------------------------------------------------- decoding

def viterbi(scores: np.ndarray, of: np.ndarray, texts: int, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word.  All texts advance together, the longest
    first, so each step is one array operation over the texts that still
    have words."""
    n, k = scores.shape
    lengths = np.bincount(of, minlength=texts)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    lengths, first = lengths[order], first[order]
    longest = int(lengths[0]) if texts else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t words
    came = np.zeros((n, k), dtype=np.int16)
    best = np.zeros((texts, k), dtype=np.float32)
    same = np.arange(k, dtype=np.int16)
    path = np.zeros(n, dtype=np.int64)
    end = np.zeros(texts, dtype=np.int64)
    for t in range(longest):
        m = active[t]
        at = first[:m] + t
        prev = best[:m]
        top = prev.argmax(axis=1)
        jump = prev[np.arange(m), top] - switch
        stay = prev >= jump[:, None]
        if t:
            came[at] = np.where(stay, same, top[:, None])
            prev = np.where(stay, prev, jump[:, None])
        # scores are kept relative to the best: float32 stays exact enough on long texts
        now = prev + scores[at]
        best[:m] = now - now.max(axis=1, keepdims=True)
        done = active[t + 1] if t + 1 < longest else 0
        end[done:m] = best[done:m].argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        path[at] = end[:m]
        end[:m] = came[at, end[:m]]
    return path


def label(texts: list, model: Model):
    """Per text: (language, score, spans as (start, end, language))."""
    k = len(model.langs)
    for lo, hi in chunks(texts, GROUP_CHARS):
        part = texts[lo:hi]
        cut = [(a, model.scored(Words(part[a:z]))) for a, z in chunks(part)] if k else []
        if not sum(w.n for _, w in cut):
            yield from ((UNKNOWN, 0.0, []) for _ in part)
            continue
        of, start, length = (np.concatenate(x) for x in zip(*((w.of + a, w.start, w.letters) for a, w in cut)))
        path = viterbi(np.concatenate([w.scores for _, w in cut]), of, len(part))
        letters = np.zeros((len(part), k), dtype=np.int64)
        np.add.at(letters, (of, path), length)
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        turn = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
        last = np.append(turn[1:], len(of)) - 1
        spans: list[list] = [[] for _ in part]
        ends = start[last] + length[last]
        for d, a, z, g in zip(of[turn].tolist(), start[turn].tolist(), ends.tolist(), path[turn].tolist()):
            spans[d].append({"start": a, "end": z, "lang": model.langs[g]})
        for i in range(len(part)):
            yield ((model.langs[best[i]], float(letters[i, best[i]] / total[i]), spans[i])
                   if total[i] else (UNKNOWN, 0.0, []))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                  T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score, and spans of every row."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    if clash := sorted({k.lower() for k in keep} & {"lang_pred", "score", "spans"}):
        raise ValueError(f"kept column(s) {clash} collide with output columns; rename them")
    rows = docs.select(*keep, F.col(text).alias(*apart(docs, "langid_text")))
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("spans", SPANS)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            made = list(label(b.column(len(keep)).to_pylist(), sent.value))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], span)],
                names=[*keep, "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, schema)
