"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side inside no vocabulary token can
never be merged, so a text may be cut between them.  The cut table is read
from the vocabulary.  Texts are cut where such a pair goes from a
non-white-space byte to white space (the pre-tokenizer starts a new piece
there in any case, so look-ahead rules see the same context), and long
unbroken fragments also between letters and digits whose pair is in no token.
The fragments are encoded independently, each distinct one once per worker
as long as a bounded cache holds it, and the ids are concatenated.

Defined results: null text is the empty text (no ids); repeated rows are
encoded each; an empty table gives an empty result; the columns named in
``keep`` are passed through, all others are dropped.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import WS_CHARS, held

CACHE_FRAGMENTS = 400_000
BATCH_CHARS = 2_000_000   # characters of text cut at a time
LONG_FRAGMENT = 64

OUTPUTS = {"n_tokens": (T.LongType(), pa.int64()),
           "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
           "ids_sha256": (T.StringType(), pa.string()),
           "decoded": (T.StringType(), pa.string()),
           "decoded_sha256": (T.StringType(), pa.string())}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """Bytes of every id of a byte-level BPE file, added tokens included."""
    alphabet = byte_alphabet()
    out = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
           for t, i in spec["model"]["vocab"].items()}
    return out | {a["id"]: a["content"].encode() for a in spec.get("added_tokens", [])}


def forced_cuts(tokens: dict[int, bytes]) -> np.ndarray:
    """cut[a, b]: the byte pair (a, b) occurs inside no token."""
    cut = np.ones((256, 256), dtype=bool)
    joined = np.frombuffer(b"".join(tokens.values()), dtype=np.uint8)
    if len(joined) > 1:
        inside = np.ones(len(joined) - 1, dtype=bool)
        ends = np.cumsum([len(t) for t in tokens.values()])[:-1] - 1
        inside[ends] = False
        cut[joined[:-1][inside], joined[1:][inside]] = False
    return cut


#: pieces of the byte-level pre-tokenizer (fixed by the file format)
BYTE_LEVEL_PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def ranked_encoding(spec: dict):
    """The same vocabulary as an encoder by ranks, which is several times
    faster on many short fragments; None unless every merge makes the token
    with the next id, and the pre-tokenizer is the plain byte-level one."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    flags = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    if (model["type"] != "BPE" or any(model.get(f) for f in flags) or model.get("ignore_merges")
            or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True)):
        return None
    vocab, alphabet = model["vocab"], byte_alphabet()
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in alphabet):
        return None
    import tiktoken
    added = {a["content"] for a in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def fragment_pattern(cut: np.ndarray) -> re.Pattern:
    """Fragments: white space and what follows it up to the next white space
    before which the byte pair forces a cut.  Where some last byte of a
    character may stand beside a white-space byte inside a token, the
    fragment goes on (after any character beyond the BMP as well)."""
    space = [ord(c) for c in WS_CHARS]
    solid = [b for b in range(256) if b not in space]
    soft = [y for y in space if not cut[solid, y].all()]
    joined = {x for y in soft for x in solid if not cut[x, y]}
    w = re.escape(WS_CHARS)
    unit = f"[{w}]*[^{w}]+"
    if joined:
        tails = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000
                 and (c if c < 0x80 else 0x80 | (c & 0x3F)) in joined]
        before = "".join(re.escape(chr(c)) for c in tails)
        again = "".join(re.escape(chr(y)) for y in soft)
        unit += f"(?:(?<=[{before}]|[\U00010000-\U0010FFFF])[{again}][{w}]*[^{w}]*)*"
    return re.compile(f"{unit}|[{w}]+")


class FragmentCodec:
    """Encodes texts fragment by fragment with a tokenizers-library file."""

    def __init__(self, source: str, cache: int = CACHE_FRAGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = token_bytes(json.loads(source))
        self.cut = forced_cuts(self.tokens)
        self.split = fragment_pattern(self.cut).findall
        self.ranked = ranked_encoding(json.loads(source))
        self.added = [a["content"] for a in json.loads(source).get("added_tokens", [])]
        size = max(self.tokens) + 1
        self.decimal = [str(i) for i in range(size)]
        self.lengths = np.zeros(size, dtype=np.int64)
        for i, t in self.tokens.items():
            self.lengths[i] = len(t)
        self.limit = cache
        self.ids: dict[str, str] = {}
        self.text: dict[str, bytes] = {}

    def fragments(self, text: str) -> list[str]:
        out = self.split(text)
        if max(map(len, out), default=0) > LONG_FRAGMENT:
            out = [p for f in out for p in (self.pieces(f) if len(f) > LONG_FRAGMENT else (f,))]
        return out

    def pieces(self, fragment: str) -> list[str]:
        """Cut a long fragment between ASCII letters and digits as well."""
        if any(a in fragment for a in self.added):
            return [fragment]
        out, last = [], 0
        for i in range(1, len(fragment)):
            a, b = fragment[i - 1], fragment[i]
            if a.isascii() and b.isascii() and a.isalnum() and b.isalnum() and self.cut[ord(a), ord(b)]:
                out.append(fragment[last:i])
                last = i
        return [*out, fragment[last:]]

    def learn(self, wanted: set[str]) -> None:
        new = wanted.difference(self.ids)
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            self.text.clear()
            new = wanted
        plain, other = [], []
        for f in new:
            ok = self.ranked and f[0] in WS_CHARS and not f[-1].isspace() and not any(a in f for a in self.added)
            (plain if ok else other).append(f)
        for i in range(0, len(plain), 20_000):
            self._learn_joined(plain[i:i + 20_000])
        for i in range(0, len(other), 10_000):
            part = other[i:i + 10_000]
            for f, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self._keep(f, e.ids)

    def _keep(self, fragment: str, ids) -> None:
        self.ids[fragment] = ",".join([self.decimal[i] for i in ids])
        self.text[fragment] = b"".join([self.tokens[i] for i in ids])

    def _learn_joined(self, fragments: list[str]) -> None:
        """Encode fragments in one call: each starts with white space and
        ends without, so no piece spans two; ids are dealt back by their
        byte lengths."""
        ids = self.ranked.encode_ordinary("".join(fragments))
        ends = np.cumsum([len(f.encode("utf-8", "surrogatepass")) for f in fragments])
        upto = np.cumsum(self.lengths[ids])
        last = np.searchsorted(upto, ends)
        if (upto[last] != ends).any():
            raise ValueError("a token spans two fragments")
        at = 0
        for f, z in zip(fragments, (last + 1).tolist()):
            self._keep(f, ids[at:z])
            at = z

    def encode(self, texts: list[str]):
        """Per text: decimal ids joined by commas, and the bytes they decode to."""
        cut, size = [], 0
        for i, t in enumerate(texts):
            cut.append(self.fragments(t))
            size += len(t)
            if size >= BATCH_CHARS or i == len(texts) - 1:
                self.learn(set().union(*cut))
                ids, text = self.ids.__getitem__, self.text.__getitem__
                for fs in cut:
                    yield ",".join(map(ids, fs)), b"".join(map(text, fs))
                size, cut = 0, []


def codec_for(source: str) -> FragmentCodec:
    """One codec per worker process and tokenizer."""
    return held(("fragments", hashlib.sha256(source.encode()).hexdigest()), lambda: FragmentCodec(source))


def _arrays(texts: list[str], codec: FragmentCodec, outputs) -> list[pa.Array]:
    columns = {o: [] for o in outputs}
    for ids, raw in codec.encode(texts):
        for o, column in columns.items():
            if o == "n_tokens":
                column.append(ids.count(",") + 1 if ids else 0)
            elif o == "ids":
                column.append(np.array(ids.split(","), dtype=np.int32) if ids else [])
            elif o == "ids_sha256":
                column.append(hashlib.sha256(ids.encode()).hexdigest())
            elif o == "decoded":
                column.append(raw.decode("utf-8", "replace"))
            else:
                column.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
    return [pa.array(v, type=OUTPUTS[o][1]) for o, v in columns.items()]


def encode(docs: DataFrame, tokenizer_path: str, outputs=("n_tokens", "ids"), keep=("doc_id",),
           text: str = "text") -> DataFrame:
    """Encode ``text`` and, for the decoded outputs, decode the ids again.
    One pass, no shuffle; the tokenizer file is read on the driver and sent
    once to every worker (its size does not depend on the data)."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    keep, outputs = list(keep), list(outputs)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("bpe_text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep]
                          + [T.StructField(o, OUTPUTS[o][0]) for o in outputs])

    def run(batches):
        codec = codec_for(source.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = _arrays(part.column(len(keep)).to_pylist(), codec, outputs)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), *made], names=[*keep, *outputs])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "text", keep=("doc_id",)) -> DataFrame:
    """The text of every id list (special tokens are not skipped); a null list is the empty text."""
    spark = df.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    keep = list(keep)
    rows = df.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("bpe_ids"))
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep] + [T.StructField(out, T.StringType())])

    def run(batches):
        tokens = codec_for(source.value).tokens
        for b in batches:
            texts = [b"".join([tokens[i] for i in row]).decode("utf-8", "replace")
                     for row in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(texts, type=pa.string())], names=[*keep, out])

    return rows.mapInArrow(run, schema)
