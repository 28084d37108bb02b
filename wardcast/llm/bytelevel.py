"""Ids of a byte-level BPE file for whole texts, shared by operators 11 and 13.

The tokenizers library gives the ids.  Where every character of a text lies in
blocks whose letters, digits and white space have been the same in all
Unicode versions in use, an encoder by ranks gives the same ids several times
faster (``tests/llm`` compares the two on every such character); all other
texts go through the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

from .bpe import ranked_encoding

#: characters outside these blocks go through the library
UNSETTLED = re.compile("[^\x00-ɏͰ-ӿ‐-‧、。ぁ-ゖァ-ヺ一-龥가-힣]")
PART_CHARS = 2_000_000   # characters handed to the library at a time


class ByteLevel:
    """Encoder of one file.  ``special``: strings of added tokens inside a
    text are those tokens (the library's default) or ordinary text."""

    def __init__(self, source: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, processors
        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        self.ranked = ranked_encoding(spec)
        added = [a["content"] for a in spec.get("added_tokens", [])] if special else []
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        # the same ids with the offsets of whole pieces
        self.spans = Tokenizer.from_str(source)
        self.spans.no_truncation()
        self.spans.no_padding()
        self.spans.encode_special_tokens = not special
        self.spans.post_processor = processors.ByteLevel(trim_offsets=False)

    def settled(self, text: str) -> bool:
        return self.ranked is not None and not UNSETTLED.search(text) and not (self.added and self.added.search(text))

    def _parts(self, texts: list[str]):
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= PART_CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part

    def ids(self, texts: list[str]) -> list[list[int]]:
        fast = [self.settled(t) for t in texts]
        out = [self.ranked.encode_ordinary(t) if f else None for t, f in zip(texts, fast)]
        rest = [i for i, f in enumerate(fast) if not f]
        slow = (e.ids for part in self._parts([texts[i] for i in rest])
                for e in self.library.encode_batch_fast(part, add_special_tokens=False))
        for i, ids in zip(rest, slow):
            out[i] = ids
        return out


def check_byte_level(source: str) -> dict:
    """The parsed file, or ValueError unless a piece depends on nothing but
    the characters in and next to it (byte-level BPE without normalizer,
    prefix space or added tokens that reach beyond themselves)."""
    spec = json.loads(source)
    pre = spec.get("pre_tokenizer") or {}
    if (spec["model"].get("type") != "BPE" or spec["model"].get("dropout") or spec.get("normalizer")
            or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or any(a.get(k) for a in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))):
        raise ValueError("the tokenizer file must be a plain byte-level BPE")
    return spec


_ENCODERS: dict[tuple, ByteLevel] = {}


def encoder_for(source: str, special: bool) -> ByteLevel:
    """One encoder per worker process, file and mode."""
    key = (hashlib.sha256(source.encode()).hexdigest(), special)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteLevel(source, special)
    return _ENCODERS[key]
