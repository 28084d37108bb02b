"""Token-id store with a minimal perfect hash index.

Documents are dealt by ranges of (doc_id, text hash) and sorted, encoded word
by word, and written in shards.  A shard record holds the raw id payload
(little-endian unsigned 32-bit integers of its documents one after another),
the documents' keys in order, and an index: displacements of a minimal
perfect hash over the keys, and per slot a 32-bit fingerprint, the offset
and the number of ids.  A key is found by two hashes, one displacement and
one fingerprint comparison, whatever the shard holds.  Records are rows of a
Parquet table in a folder that all executors share, so a lost task rewrites
only its own file.  The ids that stand before a shard are its part's first
id (a running sum over one row per part) plus its start in the part.

Defined results: null text is empty and holds the end id only; null doc_id
sorts first; rows with the same doc_id follow each other by text hash and
are separate entries (doc_id, nth), numbered from 0 over all parts; an empty table gives an empty
store; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .bpe import byte_alphabet
from .common import broadcast_if_small, held

END_ID = 2
SHARD_DOCS = 4096
SHARD_IDS = 1_000_000
CACHE_WORDS = 600_000
BUCKET_KEYS = 4

BATCH_BYTES = 8_000_000       # of text encoded at a time
NO_ID = 0xFFFFFFFF            # no tokenizer gives it
WORD_END = struct.pack("<I", NO_ID)
_U64 = np.uint64

SHARD_FIELDS = [("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()),
                ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("first_text", pa.int64()),
                ("first_nth", pa.int64()), ("n_last", pa.int64()),
                ("keys", pa.binary()), ("seeds", pa.binary()), ("prints", pa.binary()),
                ("offsets", pa.binary()), ("counts", pa.binary()), ("payload", pa.binary())]
SHARD_DDL = ("part int, seq int, start bigint, n_docs int, n_ids bigint, first_doc bigint, last_doc bigint, "
             "first_text bigint, first_nth bigint, n_last bigint, keys binary, seeds binary, prints binary, offsets binary, counts binary, "
             "payload binary")
PARTS_DDL = "part int, part_start bigint, part_first bigint, base bigint"
#: one document in ``keys``: doc_id (0 if null), occurrence in the part, null flag
KEY = np.dtype([("doc", "<i8"), ("nth", "<u4"), ("null", "<u4")])


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser of x under a seed (both uint64, wrapping)."""
    with np.errstate(over="ignore"):
        x = (x ^ (_U64(seed) if np.isscalar(seed) else seed)) + _U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def key_hash(keys: np.ndarray) -> np.ndarray:
    nth = keys["nth"].astype(_U64) | (keys["null"].astype(_U64) << _U64(32))
    return mix(mix(keys["doc"].astype("<i8").view(_U64), 1), nth)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash over distinct 64-bit hashes:
    buckets are placed from the largest, each by the first displacement that
    sends its keys to free slots; a single key's slot is stored itself, as a
    negative number."""
    n = len(h)
    m = max(1, -(-n // BUCKET_KEYS))
    bucket = (mix(h, 11) % _U64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    ends = np.cumsum(sizes)
    seeds = np.zeros(m, dtype="<i4")
    free = np.ones(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = h[order[ends[b] - sizes[b]:ends[b]]]
        for d0 in range(0, 2**31 - 64, 64):
            slots = (mix(own[None, :], np.arange(d0 + 12, d0 + 76, dtype=_U64)[:, None]) % _U64(n)).astype(np.int64)
            ranked = np.sort(slots, axis=1)
            good = free[slots].all(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b] = d0 + k
                free[slots[k]] = False
                break
    spare = np.flatnonzero(free)
    seeds[np.flatnonzero(sizes == 1)] = -1 - spare
    return seeds


def slots_of(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    s = seeds[(mix(h, 11) % _U64(len(seeds))).astype(np.int64)].astype(np.int64)
    placed = (mix(h, np.maximum(s, 0).astype(_U64) + _U64(12)) % _U64(n)).astype(np.int64)
    return np.where(s < 0, -1 - s, placed)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h, 7) >> _U64(32)).astype("<u4")


# ---------------------------------------------------------------- encoding

#: normalizer and pre-tokenizer whose effect on plain words is known: each
#: word is lowered and cut by PIECES, each piece's bytes go to the model
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: letters and numbers of Latin 1; NFC leaves all its characters alone
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN_WORDS = re.compile("[\n\x21-\x7e\xa1-\xff]*")
PIECES = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\n{_L}{_N}]+")


class WordCodec:
    """Ids of a text as bytes.  The tokenizer drops white space, so words
    are encoded on their own; Arrow tells the words of many texts apart, so
    that Python sees distinct ones only.

    Words of Latin 1 are lowered and cut into pieces here, if the file's
    normalizer and pre-tokenizer are the known ones, and the library's model
    encodes each distinct piece once while the bounded cache holds it (its
    older half goes when the younger is full); all others go through the
    whole tokenizer, each distinct one once while their cache holds it."""

    def __init__(self, source: str, cache: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(source)
        special = [a for a in spec.get("added_tokens", [])]
        self.added = [a["content"] for a in special]
        exact = [a for a in special if not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"])]
        self.mark = exact[0] if exact else None
        self.pieces = None
        self.bytes = {b: c for c, b in byte_alphabet().items() if b != 10}
        model = spec["model"]
        end = model.get("end_of_word_suffix")
        if (spec.get("normalizer") == PLAIN_NORMALIZER and spec.get("pre_tokenizer") == PLAIN_SPLIT and len(exact) == len(special)
                and model["type"] == "BPE" and not any(model.get(f) for f in ("dropout", "unk_token", "continuing_subword_prefix"))
                and end and all(c in model["vocab"] and c + end in model["vocab"] for c in byte_alphabet())):
            self.pieces = Tokenizer(self.tokenizer.model)     # the model is shared
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            # the last token of a piece has the suffix, and no other
            self.last = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
            self.last[[i for t, i in model["vocab"].items() if t.endswith(end)]] = True
        self.limit = cache
        self.young, self.old = {"\n": WORD_END}, {}     # piece: its ids
        self.known: dict[str, bytes] = {}               # other word: its ids

    def _learn_joined(self, words: list[str]) -> None:
        """Encode words in one call, an added token between them: those are
        taken out before anything else, so each word is encoded on its own."""
        joined = self.tokenizer.encode_batch_fast([self.mark["content"].join(words)], add_special_tokens=False)
        ids = np.array(joined[0].ids, dtype="<u4")
        marks = np.flatnonzero(ids == self.mark["id"])
        if len(marks) != len(words) - 1:
            raise ValueError("words and marks do not match")
        raw = ids.tobytes()
        for w, a, z in zip(words, [0, *(4 * (marks + 1)).tolist()], [*(4 * marks).tolist(), len(raw)]):
            self.known[w] = raw[a:z]

    def _learn(self, wanted: list[str]) -> None:
        """Encode words that are not plain."""
        new = [w for w in wanted if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = wanted
        marked = [self.mark is None or any(a in w for a in self.added) for w in new]
        other, new = [w for w, m in zip(new, marked) if m], [w for w, m in zip(new, marked) if not m]
        for i in range(0, len(new), 20_000):
            self._learn_joined(new[i:i + 20_000])
        for i in range(0, len(other), 10_000):
            part = other[i:i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _learn_pieces(self, wanted: set[str]) -> None:
        """Encode pieces, all new ones in one call: each is a word of the
        model's, whose last token tells it from the next."""
        if len(self.young) + len(wanted) > self.limit // 2:
            self.young, self.old = {"\n": WORD_END}, self.young
        new = []
        for p in wanted.difference(self.young):
            if p in self.old:
                self.young[p] = self.old[p]
            else:
                new.append(p)
        if not new:
            return
        # the bytes of each piece as the model's characters; no piece has a new line
        text = "\n".join(new).encode().decode("latin-1").translate(self.bytes)
        ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("pieces and their ids do not match")
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        for p, a, z in zip(new, [0, *ends], ends):
            self.young[p] = raw[a:z]

    def _is_plain(self, text: str) -> bool:
        """The words of the text can be cut here."""
        return self.pieces is not None and PLAIN_WORDS.fullmatch(text) is not None and not any(a in text for a in self.added)

    def _words(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes): word i of the n words, each with a new line
        behind it, has ids[starts[i]:starts[i] + sizes[i]]."""
        rest, plain = [], np.ones(n, dtype=bool)
        if not self._is_plain(text):
            words = text.split("\n")[:-1]
            plain = np.fromiter(map(self._is_plain, words), bool, n)
            rest = [w for w, p in zip(words, plain.tolist()) if not p]
            text = "".join([f"{w}\n" for w, p in zip(words, plain.tolist()) if p])
        cut = PIECES.findall(text.lower())
        self._learn_pieces(set(cut))
        ids = np.frombuffer(b"".join(map(self.young.__getitem__, cut)), dtype="<u4")
        marks = np.flatnonzero(ids == NO_ID)
        starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        starts[plain] = np.concatenate([[0], marks + 1])[:len(marks)]
        sizes[plain] = marks - starts[plain]
        if rest:
            self._learn(rest)
            raws = [self.known[w] for w in rest]
            sizes[~plain] = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
            starts[~plain] = len(ids) + np.cumsum(sizes[~plain]) - sizes[~plain]
            ids = np.concatenate([ids, np.frombuffer(b"".join(raws), dtype="<u4")])
        return ids, starts, sizes

    def encode(self, texts) -> list[bytes]:
        """Texts: a list of strings or an Arrow column without nulls."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        cut = pc.ascii_split_whitespace(texts)      # at the six characters of ASCII white space
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py()
        ids, starts, sizes = self._words(lines + "\n" if len(words) else "", len(words))
        at = coded.indices.to_numpy()
        # word after word: where its ids stand, less where they go
        n = sizes[at]
        ends = np.cumsum(n)
        out = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(n.sum())].tobytes()
        upto = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        bounds = (4 * np.concatenate([[0], ends])[np.concatenate([[0], upto])]).astype(np.int64).tolist()
        return [out[a:z] for a, z in zip(bounds, bounds[1:])]


def codec_for(source: str) -> WordCodec:
    return held(("words", hashlib.sha256(source.encode()).hexdigest()), lambda: WordCodec(source))


# ---------------------------------------------------------------- shards

def make_shard(part: int, seq: int, start: int, docs: list, nths: list, hashes: list, payloads: list[bytes]) -> dict:
    keys = np.zeros(len(docs), dtype=KEY)
    keys["doc"] = [0 if d is None else d for d in docs]
    keys["null"] = [d is None for d in docs]
    keys["nth"] = nths
    lengths = np.array([len(p) // 4 for p in payloads], dtype="<u4")
    before = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)[:-1]]).astype("<u8")
    h = key_hash(keys)
    seeds = build_mph(h)
    at = slots_of(h, seeds, len(h))
    prints, offsets, counts = (np.zeros(len(h), dtype=t) for t in ("<u4", "<u8", "<u4"))
    prints[at], offsets[at], counts[at] = fingerprint(h), before, lengths
    return {"part": part, "seq": seq, "start": start, "n_docs": len(docs), "n_ids": int(lengths.sum()),
            "first_doc": docs[0], "last_doc": docs[-1], "first_text": hashes[0], "first_nth": nths[0],
            "n_last": docs.count(docs[-1]), "keys": keys.tobytes(),
            "seeds": seeds.tobytes(), "prints": prints.tobytes(), "offsets": offsets.tobytes(),
            "counts": counts.tobytes(), "payload": b"".join(payloads)}


class Shard:
    """A shard record as read back: keyed access to its payload."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], dtype=KEY)
        self.seeds = np.frombuffer(row["seeds"], dtype="<i4")
        self.prints = np.frombuffer(row["prints"], dtype="<u4")
        self.offsets = np.frombuffer(row["offsets"], dtype="<u8")
        self.counts = np.frombuffer(row["counts"], dtype="<u4")
        self.payload = memoryview(row["payload"])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, count) per key."""
        if not len(keys):
            return np.zeros(0, bool), np.zeros(0, "<u8"), np.zeros(0, "<u4")
        h = key_hash(keys)
        at = slots_of(h, self.seeds, len(self.prints))
        return self.prints[at] == fingerprint(h), self.offsets[at], self.counts[at]

    def ids(self, offset: int, count: int) -> memoryview:
        return self.payload[4 * int(offset):4 * (int(offset) + int(count))]


def _by_bytes(b: pa.RecordBatch):
    """The batch in slices of about BATCH_BYTES of text (its third column)."""
    sizes = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False)
    turns = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES)) + 1
    for a, z in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows]):
        if z > a:
            yield b.slice(a, z - a)


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write shards and parts under ``path``.  One shuffle, by key ranges."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    end = struct.pack("<I", end_id)
    schema = pa.schema(SHARD_FIELDS)

    def run(batches):
        part, seq, start, n_held = TaskContext.get().partitionId(), 0, 0, 0
        docs_, nths, hashes, payloads = [], [], [], []
        codec, last, nth = codec_for(source.value), object(), 0
        for b in batches:
            for some in _by_bytes(b):
                ids, keys = (some.column(i).to_pylist() for i in (0, 1))
                for d, k, p in zip(ids, keys, codec.encode(some.column(2))):
                    nth = nth + 1 if d == last else 0
                    last = d
                    docs_.append(d), nths.append(nth), hashes.append(k), payloads.append(p + end)
                    n_held += len(p) // 4 + 1
                    if n_held >= SHARD_IDS or len(docs_) >= SHARD_DOCS:
                        yield pa.RecordBatch.from_pylist(
                            [make_shard(part, seq, start, docs_, nths, hashes, payloads)], schema=schema)
                        seq, start, n_held = seq + 1, start + n_held, 0
                        docs_, nths, hashes, payloads = [], [], [], []
        if docs_:
            yield pa.RecordBatch.from_pylist(
                [make_shard(part, seq, start, docs_, nths, hashes, payloads)], schema=schema)

    (dealt.mapInArrow(run, SHARD_DDL).write.option("compression", "zstd").parquet(f"{path}/shards"))
    _parts(spark.read.schema(SHARD_DDL).parquet(f"{path}/shards")).write.parquet(f"{path}/parts")


def _parts(shards: DataFrame) -> DataFrame:
    """One row per part: its first id, its first doc_id, and ``base``, the
    number of rows of that doc_id in the parts before.  A part counts
    occurrences from 0; only its first doc_id can have begun earlier."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct("seq", "first_doc", "first_text")).alias("f"),
                                       F.max(F.struct("seq", "last_doc")).alias("l"))
    order = Window.orderBy(F.col("f.first_doc").asc_nulls_first(), F.col("f.first_text"), "part")   # one row a part
    parts = parts.select("part", F.col("f.first_doc").alias("part_first"), F.col("l.last_doc").alias("part_last"),
                         (F.sum("n").over(order) - F.col("n")).alias("part_start"), F.row_number().over(order).alias("place"))
    ends = shards.join(parts.select("part", "part_last"), "part").filter(F.col("last_doc").eqNullSafe(F.col("part_last"))).groupBy(
        "part").agg(F.sum("n_last").alias("tail"))
    # along the parts of one doc_id: what each asks for stands before what it adds
    asks = parts.select(F.col("part_first").alias("doc"), "part", "place", F.lit(0).alias("adds"), F.lit(0).cast("long").alias("tail"))
    adds = parts.join(ends, "part").select(F.col("part_last").alias("doc"), "part", "place", F.lit(1).alias("adds"), "tail")
    before = Window.partitionBy("doc").orderBy("place", "adds").rowsBetween(Window.unboundedPreceding, -1)
    base = asks.unionByName(adds).withColumn("base", F.coalesce(F.sum("tail").over(before), F.lit(0))).filter("adds = 0")
    return parts.join(base.select("part", "base"), "part").select("part", "part_start", "part_first", "base")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema(PARTS_DDL).parquet(f"{path}/parts")
    return spark.read.schema(SHARD_DDL).parquet(f"{path}/shards").join(broadcast_if_small(parts), "part")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, nth, start, n_tokens, ids_crc32) of every stored document,
    each looked up through the index of its shard."""
    ship_package(spark)
    fields = [("doc_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()),
              ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                s = Shard(row)
                found, offset, count = s.find(s.keys)
                if not found.all():
                    raise ValueError(f"shard {row['part']}/{row['seq']}: fingerprints do not match the keys")
                crc = [zlib.crc32(s.ids(o, n)) for o, n in zip(offset, count)]
                first = row["part_first"]
                went_on = (s.keys["null"] == 1) if first is None else (s.keys["null"] == 0) & (s.keys["doc"] == first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(s.keys["doc"], mask=s.keys["null"].astype(bool), type=pa.int64()),
                    pa.array(s.keys["nth"].astype(np.int64) + np.where(went_on, row["base"], 0)),
                    pa.array(offset.astype(np.int64) + row["part_start"] + row["start"]),
                    pa.array(count.astype(np.int64)), pa.array(crc, type=pa.int64())],
                    names=[n for n, _ in fields])

    return _shards(spark, path).mapInArrow(
        run, "doc_id bigint, nth bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _place(doc, nth) -> tuple:
    """Sort key of an entry: doc_id with null first, then its occurrence."""
    return (doc is not None, doc or 0, nth)


def _routed(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(part, seq, doc_id, nth, local): the one shard that can hold each key.

    Parts, and shards within a part, follow each other in the order of their
    first entries, so a key belongs to the last one that begins at or before
    it: a binary search over the parts' beginnings (one per part, sent to the
    tasks) and one over the beginnings of the part's shards, which come by a
    join on the part."""
    parts = spark.read.schema(PARTS_DDL).parquet(f"{path}/parts").collect()     # one row per part
    begins = sorted((_place(p.part_first, p.base), p.part, p.base) for p in parts)
    sent = spark.sparkContext.broadcast(([b[0] for b in begins], [b[1] for b in begins], [b[2] for b in begins]))
    names = ["part", "doc_id", "nth", "local"]

    def to_part(batches):
        first, part, base = sent.value
        for b in batches:
            out = []
            for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = bisect.bisect_right(first, _place(d, n)) - 1
                if n >= 0 and at >= 0:
                    out.append((part[at], d, n, n - (base[at] if first[at][:2] == _place(d, n)[:2] else 0)))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

    def to_shard(batches):
        for b in batches:
            seqs = []
            for d, n, shards in zip(*(b.column(i).to_pylist() for i in (1, 3, 4))):
                first = [_place(x["first_doc"], x["first_nth"]) for x in shards]
                seqs.append(shards[max(bisect.bisect_right(first, _place(d, n)) - 1, 0)]["seq"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seqs, pa.int32()), *b.columns[1:4]],
                                             names=["part", "seq", "doc_id", "nth", "local"])

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("nth").cast("long").alias("nth")).distinct()
    dealt = wanted.mapInArrow(to_part, "part int, doc_id bigint, nth bigint, local bigint")
    shards = spark.read.schema(SHARD_DDL).parquet(f"{path}/shards").groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "first_doc", "first_nth"))).alias("shards"))   # no payload is read
    return dealt.join(shards, "part").select(*names, "shards").mapInArrow(
        to_shard, "part int, seq int, doc_id bigint, nth bigint, local bigint")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Keyed access: (doc_id, nth, start, ids) for every (doc_id, nth) of
    ``keys`` that is stored.  Each key goes to the one shard that can hold it,
    by joins on part and shard, and is probed in its index."""
    ship_package(spark)
    shards = _shards(spark, path)
    asked = _routed(spark, path, keys).groupBy("part", "seq").agg(
        F.collect_list(F.struct("doc_id", "nth", "local")).alias("asked"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                pairs = [(q["doc_id"], q["nth"]) for q in row["asked"]]
                probe = np.zeros(len(pairs), dtype=KEY)
                probe["doc"] = [0 if d is None else d for d, _ in pairs]
                probe["null"] = [d is None for d, _ in pairs]
                probe["nth"] = [q["local"] for q in row["asked"]]
                s = Shard(row)
                found, offset, count = s.find(probe)
                out = [{"doc_id": d, "nth": n, "start": row["part_start"] + row["start"] + int(o),
                        "ids": np.frombuffer(s.ids(o, c), dtype="<u4").astype(np.int64)}
                       for (d, n), f, o, c in zip(pairs, found, offset, count) if f]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("doc_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return shards.join(asked, ["part", "seq"]).mapInArrow(
        run, "doc_id bigint, nth bigint, start bigint, ids array<bigint>")
