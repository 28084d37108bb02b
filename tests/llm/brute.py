"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def lower_az(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# ------------------------------------------------------------ quality

def quality_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    often = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


# ------------------------------------------------------------ secrets

SECRET = {
    "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])"""
                          r"""|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}


def secret_base(text):
    text = text or ""
    spans = []
    for no, (kind, (rx, group, least)) in enumerate(SECRET.items()):
        spans += [(m.start(), no, m.end(), kind) for m in rx.finditer(text) if len(m[group]) >= least]
    spans.sort()
    n = Counter(s[3] for s in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{z}" for a, _, z, k in spans))


# ------------------------------------------------------------ decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        ws = WORD.findall(lower_az(text or ""))
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            windows.setdefault(tuple(ws[i:i + n]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        ws = WORD.findall(lower_az(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                who = windows.get(tuple(ws[i:i + n]))
                if who is not None:
                    hit.update(range(i, i + n))
                    found |= who
        ids = sorted({str(i) for i in found if i is not None})
        out.append((doc, len(ws), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


# ------------------------------------------------------------ similarity join

def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4)))


def similarity_components(docs):
    """[(n_shingles, component_id)] for (doc_id, text) rows, all pairs compared."""
    return [r[:2] for r in similarity_groups(docs)]


def similarity_groups(docs):
    """[(n_shingles, component_id, number of the component)]."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holds: dict[tuple, list] = {}
    for i, s in enumerate(sets):
        for g in s:
            holds.setdefault(g, []).append(i)
    shared: Counter = Counter()
    for members in holds.values():
        for x in range(len(members)):
            for y in range(x + 1, len(members)):
                shared[members[x], members[y]] += 1
    for (i, j), both in shared.items():
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    least = {r: min((docs[i][0] for i in m if docs[i][0] is not None), default=None) for r, m in groups.items()}
    return [(len(sets[i]), least[find(i)] if sets[i] else docs[i][0], find(i)) for i in range(len(docs))]


# ------------------------------------------------------------ tokens

def id_store(docs, tokenizer):
    """(doc_id, start, n_tokens, crc32) in ascending doc_id order."""
    start, out = 0, []
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out
