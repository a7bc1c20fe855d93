"""Plain versions of the contracts, and small tables with awkward rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}
SPACES = r"[^\x20\x09-\x0D]+"
CLASHES = "row key id kept n_lines words hash h1 shard text_v canonical block doc gone gone_id copies a b runs"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHES.split()
)


def documents(spark, rows, extra=True):
    """(doc_id, text) pairs as a documents table, with extra columns whose names the operators use inside."""
    extras = [f"x-{c}" for c in CLASHES.split()] if extra else []
    schema = DOC_SCHEMA if extra else ", ".join(DOC_SCHEMA.split(", ")[:5])
    made = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, len(t or ""), *extras) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, schema)


def awkward(long: int = 60_000):
    """Nulls, empty and very long texts, ties, repeated rows and a row without id."""
    story = "The quick brown fox jumps over the lazy dog near the old river bank today and tomorrow.\n" * 2
    return [
        (1, None),
        (2, ""),
        (3, "   \n\t\n"),
        (4, story),
        (5, story),
        (5, story),
        (6, story + "one more line of this very text"),
        (7, " ".join(f"word{i % 977}" for i in range(long // 7))),
        (8, "é" * 500),
        (9, "z" * long),
        (None, story),
        (None, None),
        (10, "MIT License\nreleased under the MIT License\nCC BY and cc by cc by"),
        (11, "\x00\x0b weird \x0c controls \x1c\x85  here"),
    ]


def removed_bytes(rows, length):
    """(n_bytes, n_removed, n_spans, kept) per row: bytes of strings that start more than once."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def kept_lines(rows):
    """(n_lines, n_dropped, text) per row."""
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
    keys = [[strip.sub("", x).translate(LOWER) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for (doc, _), own in zip(rows, keys):
        for key in own:
            if doc is not None and len(key) >= 10:
                holders[key].add(doc)
    out = []
    for (doc, text), own in zip(rows, keys):
        lines = (text or "").split("\n")
        stay = [doc is None or len(holders[k]) < 2 or min(holders[k]) == doc for k in own]
        out.append((doc, len(lines), stay.count(False), "\n".join(x for x, s in zip(lines, stay) if s)))
    return out


def simhash(text):
    words = re.findall(SPACES, (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    """The smallest index reachable from each index."""
    own = list(range(n))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        own[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_groups(rows, bits=2):
    """doc_id -> (fingerprint, component id) for distinct ids without null."""
    rows = sorted(rows)
    prints = np.array([simhash(t) for _, t in rows], np.uint64)
    pairs = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= bits)]
    group = roots(len(rows), pairs)
    return {d: (f"{int(p):016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, group)}


def shingles(words, n=5):
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def letter_runs(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def contaminated(rows, items, similarity=0.8):
    """(doc_id, item_id) -> similarity of the best item-sized window."""
    held = {i: letter_runs(t) for i, t in items}
    held = {i: w for i, w in held.items() if w}
    out = {}
    for doc, text in rows:
        words = letter_runs(text)
        own = set(shingles(words)) if words else set()
        for item, wanted in held.items():
            if not own & set(shingles(wanted)) and len(wanted) >= 5:
                continue
            target = Counter(shingles(wanted))
            for start in range(-len(wanted), len(words)):
                window = words[max(start, 0) : max(0, start + len(wanted))]
                if window:
                    have = Counter(shingles(window))
                    value = (have & target).total() / (have | target).total()
                    if value >= similarity:
                        out[doc, item] = max(value, out.get((doc, item), 0))
    return out


def unigram(rows, fold=10, add=0.1):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base) per row."""
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    held = [d is None or zlib.crc32(str(d).encode()) % fold == 0 for d, _ in rows]
    counts = Counter(w for own, out in zip(tokens, held) if not out for w in own)
    total, distinct = counts.total(), len(counts)
    bottom = np.log10(total + add * (distinct + 1))
    return [
        (d, out, len(own), sum(w in counts for w in own), total, float(sum(np.log10(counts[w] + add) - bottom for w in own)))
        for (d, _), own, out in zip(rows, tokens, held)
    ]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
