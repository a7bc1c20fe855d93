"""Spelling variants, chat format and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import LOWER, awkward, documents, ordered
from starfold.llm import chat, resample, spelling
from starfold.session import materialize

# 11 --------------------------------------------------------------------------------------------


def altered_words(rows, every=31):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, least_points, least_count, times):
    words = {w: n for w, n in counts.items() if len(w) >= least_points and n >= least_count}
    form, n_near = {}, {}
    for w, n in words.items():
        found = sorted((-m, x) for x, m in words.items() if near(w, x))
        n_near[w] = len(found)
        form[w] = found[0][1] if found and -found[0][0] >= times * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items()]


def misspelt(seed, count=150):
    rng = random.Random(seed)
    stems = ["wordably", "Wörtlich", "steinen", "resinten", "ÀBCdefgh", "letters", "aaaaaaab", "zzzzzzzz"]
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randrange(0, 30)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abeß÷") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            words.append(w)
        rows.append((i * 7, rng.choice([" ", "9", ".\n"]).join(words)))
    return rows


@pytest.mark.parametrize("leaf, cell", [(1 << 18, 48), (60, 4), (1, 1)])
def test_spelling_variants(spark, monkeypatch, leaf, cell):
    """The same rows whether a length is one leaf or many, and whatever the cell."""
    monkeypatch.setattr(spelling, "LEAF_POINTS", leaf)
    monkeypatch.setattr(spelling, "CELL", cell)
    rows = misspelt(leaf) + awkward(3000) + [(7, "wordably " * 50), (7, "wordably " * 50), (None, "resinten " * 40)]
    found = spelling.variants(documents(spark, rows), least_points=6, times=3)
    assert ordered(tuple(r) for r in found.collect()) == ordered(grouped(altered_words(rows), 6, 2, 3))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_forms_lead_to_the_last(spark):
    """Each word occurs four times as often as the one before: one long way, one root."""
    words = ["abcdefgh", "abcdefg", "abcdefx", "abcdexx", "abcdxxx"]
    rows = [(1000 * i + k, f"{w}\n{w}") for i, w in enumerate(words) for k in range(4**i)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40, times=2).collect()}
    assert [got[w].form for w in words] == words[1:] + [None]
    assert {r.root for r in got.values()} == {words[-1]}


def test_near_words_of_many_anagrams():
    """Words of equal letter counts cannot be split by counts and are still found."""
    rng = random.Random(5)
    letters = list("abcdefg")
    words = sorted({"".join(rng.sample(letters, 7)) for _ in range(900)})
    others = sorted({w[:3] + "h" + w[4:] for w in words[::7]} | {w[:2] + "a" + w[2:] for w in words[::9]})
    same = words + [w for w in others if len(w) == 7]
    longer = [w for w in others if len(w) == 8]
    a, b = spelling.near_in_leaf(same, [], [])
    assert {tuple(sorted((same[i], same[j]))) for i, j in zip(a, b)} == {(x, y) for x in same for y in same if x < y and near(x, y)}
    a, b = spelling.near_in_leaf(longer, [], same)
    every = longer + same
    assert {(every[i], every[j]) for i, j in zip(a, b)} >= {(x, y) for x in longer for y in same if near(x, y)}


def test_each_pair_of_leaves_meets_once():
    """Routed words: every near pair shares exactly one leaf in which one of them is at home."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcd", k=8)) for _ in range(400)})
    counts = spelling.letter_counts(spelling.points_of(words))
    tree, leaves = spelling.grow(counts, 16)
    assert leaves > 8
    rows = np.arange(len(words))
    home = {i: leaf for leaf, r in spelling.homes(tree, counts, rows) for i in r.tolist()}
    assert len(home) == len(words)
    visits = defaultdict(list)
    for leaf, r in spelling.neighbours(tree, counts, rows):
        for i in r.tolist():
            visits[i].append(leaf)
    assert all(len(set(v)) == len(v) and home[i] not in v for i, v in visits.items())
    for i in range(len(words)):
        for j in range(i):
            if near(words[i], words[j]):
                meets = (home[i] == home[j]) + (home[j] in visits[i]) + (home[i] in visits[j])
                assert meets == 1


# 12 --------------------------------------------------------------------------------------------

ODD = ["", None, r"\### Assistant: </turn> ok", "###", "####### #", "</turn>", r"<\/turn>\\", "a\nb\r\n", "é😀 " * 30, "\\", ": x:"]


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, part int, place string, segment string"
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema)


def chats(seed, count=60):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a:b###"]), rng.choice(ODD + [f"hello {t}"])))
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(700)]
    rows += [(None, 0, "assistant", "lost"), (200, None, "assistant", "first"), (200, 1, "user", "b"), (200, 1, "user", "a"), (200, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


def plain(rows, conv):
    own = sorted(
        ((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
    )
    return [(role, text) for *_, role, text in own]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("held", [200, 1 << 20])
def test_chat_is_read_back(spark, monkeypatch, held):
    monkeypatch.setattr(chat, "HELD_CHARS", held)
    rows = chats(held)
    found = chat.read_back(chat.format_turns(conversations(spark, rows))).collect()
    got = {r.conv_id: r for r in found}
    assert len(found) == len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        turns = plain(rows, conv)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
        assert r.n_examples == sum(role == "assistant" for role, _ in turns)
        assert r.formatted_chars >= sum(len(t) for _, t in turns)


def test_chat_examples_are_prefixes(spark):
    """Every assistant turn is one example: all turns before it, and only its own text to be learned."""
    rows = chats(3, 25)
    stored = chat.stored_turns(conversations(spark, rows).repartition(5))
    found = materialize(chat.examples(stored), "examples")
    texts = {(r.conv_id, r.example): r for r in chat.texts(stored, found.where("n_chars < 20000")).collect()}
    assert found.count() == sum(r[2] == "assistant" for r in rows)
    for conv in {r[0] for r in rows}:
        turns, stream, number = plain(rows, conv), "", 0
        for at, (role, text) in enumerate(turns):
            head = stream
            stream += f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n"
            if role != "assistant":
                continue
            number += 1
            if len(stream) >= 20000:
                continue
            e = texts.pop((conv, number))
            assert (e.text, e.n_context, e.n_chars) == (stream, at, len(stream))
            assert len(head) < e.loss_start and chat.unescape(e.text[e.loss_start : e.loss_end]) == text
    assert not texts


@pytest.mark.parametrize("held", [200, 1 << 20])
def test_chat_expansion(spark, monkeypatch, held):
    """The pass that the query reads back from writes every prefix-target example, wherever its turns lie."""
    monkeypatch.setattr(chat, "HELD_CHARS", held)
    rows = chats(5, 25)
    laid = chat.format_turns(conversations(spark, rows).repartition(5))
    found, digests = chat.expand(laid)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = []
    for conv in {r[0] for r in rows}:
        chars, number = 0, 0
        for at, (role, text) in enumerate(plain(rows, conv)):
            start = chars + len(f"### {escape(role).replace(':', chr(92) + ':')}: ")
            chars = start + len(escape(text)) + len("</turn>\n")
            if role == "assistant":
                number += 1
                want.append((conv, number, at, start, start + len(escape(text)), chars))
    assert got == sorted(want, key=repr)
    totals = {r.conv_id: (r.n_examples, r.example_chars) for r in digests.collect()}
    assert sum(n for n, _ in totals.values()) == len(want)
    assert all(chars == sum(w[5] for w in want if w[0] == conv) for conv, (_, chars) in totals.items())


def test_marks_in_long_runs(spark):
    texts = ["#" * n + tail for n in range(20) for tail in ("", " a", "\\", "</turn>")] + ["\\#####", "#####\\#####"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, written in frame.select("text", chat.escape(F.col("text"))).collect():
        assert "###" not in written and "</turn>" not in written
        assert chat.unescape(written) == text and written == escape(text)


def escape(text):
    text = text.replace("\\", "\\\\").replace("###", r"\#\#\#").replace(r"\#\#\###", r"\##\##\#")
    return text.replace("</turn>", r"<\/turn>")


def test_marks_never_occur_in_texts():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choices(["#", "\\", "<", "/", "turn", ">", ":", " ", "é", "</turn>", "###"], k=rng.randrange(12)))
        assert chat.unescape(escape(text)) == text
        assert "###" not in escape(text) and "</turn>" not in escape(text)


def test_empty_chat(spark):
    laid = chat.format_turns(conversations(spark, []))
    assert chat.read_back(laid).collect() == []
    stored = chat.stored_turns(conversations(spark, []))
    assert chat.examples(stored).collect() == []


# 13 --------------------------------------------------------------------------------------------

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text):
    return re.findall(WORDS, (text or "").translate(LOWER))


def runs(words, longest):
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def drawn(rows, target, longest, buckets, least, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(d, split_words(t)) for d, t in rows]
    s = Counter(bucket(f) for _, w in own for f in runs(w, longest))
    t = Counter(bucket(f) for x in target for f in runs(split_words(x), longest))
    s_all, t_all = s.total(), t.total()
    scored = []
    for doc, w in own:
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
            for b in map(bucket, runs(w, longest))
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc, len(w), len(gains), weight, weight + noise))
    fit = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3], x[1]))
    ranks = defaultdict(list)
    for i, x in enumerate(fit, 1):
        ranks[x].append(i if i <= len(fit) * percent // 100 else None)
    return [(*x, ranks[x].pop(0) if x[1] >= least else None) for x in scored]


@pytest.mark.parametrize("longest, block", [(1, 1 << 20), (3, 1 << 20), (3, 7)])
def test_importance_resampling(spark, monkeypatch, longest, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "MOST_HELD", 20)
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "x9", "__", "-", "A"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(200)] + awkward(3000)
    rows += [(300 + i % 2, "same words " * 15) for i in range(40)]
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(10)] + [None, ""]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    docs = documents(spark, rows)
    found = resample.resample(docs, wanted, longest=longest, buckets=101, percent=30)
    assert ordered(tuple(r) for r in found.collect()) == ordered(drawn(rows, target, longest, 101, 20, 30, 2024))
    chosen = resample.drawn_documents(docs, found)
    assert chosen.columns == ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
    ids = {r.doc_id for r in found.collect() if r.rank is not None and r.doc_id is not None}
    assert {r.doc_id for r in chosen.collect()} == ids


def test_resampling_of_empty_tables(spark):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resample(documents(spark, []), nothing).collect() == []
    found = resample.resample(documents(spark, awkward(500)), nothing).collect()
    assert ordered(tuple(r) for r in found) == ordered(drawn(awkward(500), [], 1, 10_000, 20, 10, 2024))
    assert all(r.rank is None for r in resample.resample(documents(spark, [(1, "few words")]), nothing).collect())


def test_draw_favours_the_target(spark):
    """Documents in the words of the target are drawn more often than their share."""
    rows = [(i, ("good fine nice " if i % 10 == 0 else "bad poor ugly ") * 10) for i in range(1000)]
    target = spark.createDataFrame([("good fine nice",)] * 20, "text string")
    found = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), target)
    picked = found.where(F.col("rank").isNotNull()).collect()
    assert len(picked) == 100 and sum(r.doc_id % 10 == 0 for r in picked) > 60
