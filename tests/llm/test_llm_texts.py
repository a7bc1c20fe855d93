"""Text operators against plain versions."""

import hashlib
import math
import random
import re

import public_tokenizers
import pytest

from brute import LOWER, SPACES, awkward, contaminated, documents, kept_lines, ordered, removed_bytes, simhash_groups, unigram
from starfold.llm import bpe, decontam, hmm, induced, licenses, linehash, simhash, suffix

PATTERN = public_tokenizers.PATTERN
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def corpus(seed, count=120):
    """Texts of few words with shared phrases, so that pieces, lines and shingles repeat."""
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma é", "The", "of the", "x", "\n", "omega!"] + [f"w{i}" for i in range(40)]
    phrases = [" ".join(rng.choices(words, k=rng.randrange(4, 16))) for _ in range(8)]
    rows = []
    for i in range(count):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 50)))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(0, len(text) + 1)
            text = text[:at] + rng.choice(phrases) + text[at:]
        rows.append((i * 3, text))
    return rows + [(1000 + i, rows[rng.randrange(count)][1]) for i in range(15)]


# 1 ---------------------------------------------------------------------------------------------


def whole_text(text):
    ids = bpe.encoder(RANKS, PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_pieces_equal_whole_texts(spark):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\n\n ", "'s", "'ll", "12", "中文字", "é", "😀", "!?", "\t", "x" * 80, " " * 90, "\r\n", "word "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 400)))) for i in range(120)] + awkward(3000)
    rows += [(50, "z" * 3000), (51, " " * 3000 + "a"), (52, "<|endoftext|> hi " * 60)]
    pieces = bpe.encode(documents(spark, rows), RANKS, PATTERN, chunk=200, overlap=40)
    found = bpe.digests(bpe.decode(pieces, RANKS, PATTERN), 50256).collect()
    expected = [(d, *whole_text(t)) for d, t in rows]
    assert ordered(tuple(r) for r in found) == ordered(expected)
    assert max(r.n_pieces for r in pieces.collect()) > 3
    fused = bpe.document_digests(documents(spark, rows), RANKS, PATTERN, chunk=200, overlap=40).collect()
    assert ordered(tuple(r) for r in fused) == ordered(expected)


def test_bpe_of_long_runs(spark):
    bpe_ = bpe.encoder(RANKS, PATTERN)
    text = "a" + " " * 6000 + "b\n" + "\n" * 5500 + " it's 12!"
    assert bpe.encode_text(bpe_, PATTERN, text) == bpe_.encode_ordinary(text)
    rows = [(1, " " * 1_000_000), (2, "x" * 1_000_000 + "  y")]
    found = bpe.document_digests(documents(spark, rows), RANKS, PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in found} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in rows}


def test_bpe_chunks_overlap_and_cover():
    text = "".join(chr(97 + i % 26) for i in range(1000))
    parts = bpe.chunks(text, 100, 20)
    assert all(text[s : s + len(p)] == p for s, p in parts)
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == 1000 and len(parts[-1][1]) > 20


# 2 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("memory", [0, 300, 1 << 20])
def test_induced_sorting_finds_repeats(memory):
    rng = random.Random(memory)
    for _ in range(150):
        depth, letters = rng.choice([2, 3, 8, 20, 64]), rng.choice(["ab", "abcdefgh", "a", "aé"])
        pieces = ["".join(rng.choices(letters, k=rng.randrange(0, 120))).encode() for _ in range(rng.randrange(1, 6))]
        pieces.append(pieces[0][: rng.randrange(0, 90)] + b"a")
        flags, at = induced.Block(pieces, depth, memory).repeated(), 0
        whole = [p[i : i + depth] for p in pieces for i in range(len(p) - depth + 1)]
        for piece in pieces:
            windows = max(0, len(piece) - depth + 1)
            expected = [whole.count(piece[i : i + depth]) > 1 for i in range(windows)]
            assert flags[at : at + windows].tolist() == expected
            at += len(piece) + 1


@pytest.mark.parametrize("most", [2, 256])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_PIECES", most)
    rows = corpus(most) + awkward(2500) + [(2000, "ab" * 200), (2001, "q" * 39), (2002, "q" * 40)]
    found = suffix.remove_repeats(documents(spark, rows), length=40, gram=13).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in found]
    assert ordered(got) == ordered(removed_bytes(rows, 40))


def test_suffix_chunks_of_long_texts(monkeypatch):
    raw = bytes(random.Random(1).choices(b"abcd ", k=5000))
    monkeypatch.setattr(suffix, "CHUNK", 256)
    start, count, anchor, key = suffix.pieces_of(raw, 50, 16)
    covered = [i for s, c in zip(start.tolist(), count.tolist()) for i in range(s, s + c)]
    assert covered == list(range(len(raw) - 49))
    assert all(s + c - 1 <= a <= s + 34 for s, c, a in zip(start.tolist(), count.tolist(), anchor.tolist()))


# 4 ---------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rows = corpus(4) + awkward(2000) + [(-5, "  ALPHA beta gamma  \nshort"), (70, "alpha Beta gamma\nshort"), (71, "alpha beta gamma")]
    found = linehash.dedup_lines(documents(spark, rows))
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == ordered(kept_lines(rows))
    assert found.columns == [c for c in documents(spark, []).columns if c != "n_lines"] + ["n_lines", "n_dropped"]


def test_line_dedup_without_hot_arrays(spark, monkeypatch):
    monkeypatch.setattr(linehash, "HOT_SHARE", 1)
    rows = corpus(5)
    found = linehash.dedup_lines(documents(spark, rows))
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()) == ordered(kept_lines(rows))


def test_perfect_hash_is_minimal_and_rejects_strangers():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500, 20_000):
        h1, h2 = rng.integers(0, 1 << 62, (2, n)).astype(np.uint64)
        if n > 2:
            h1[1] = h1[0]
        arrays = linehash.Arrays.build(h1, h2, np.arange(n) + 2, np.arange(n) * 7)
        assert sorted(arrays._slots(h1, h2).tolist()) == list(range(n))
        known, first = arrays.first_of(h1, h2)
        assert known.all() and first.tolist() == (np.arange(n) * 7).tolist()
        strange = rng.integers(0, 1 << 62, (2, 1000)).astype(np.uint64)
        assert not arrays.first_of(*strange)[0].any()
        back = linehash.Arrays.of_row(*arrays.row()[1:])
        assert back.first_of(h1, h2)[1].tolist() == first.tolist()


# 6 ---------------------------------------------------------------------------------------------


def test_hmm_base_scores_and_proper_probabilities(spark):
    rows = corpus(6) + awkward(1500)
    found = hmm.score(documents(spark, rows), states=3, steps=2).collect()
    got = ordered((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == ordered((*x[:-1], round(x[-1], 6)) for x in unigram(rows))
    assert all(r.score < 0 for r in found)
    held = [r for r in found if not r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_forward_recursion_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    lengths = np.array([4, 1, 6])
    flat = rng.integers(0, 5, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    got = hmm.log_likelihoods(model, flat, starts, lengths)
    import itertools

    for s, n, value in zip(starts, lengths, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=n):
            p = model.start[path[0]]
            for t, state in enumerate(path):
                p *= (model.move[path[t - 1], state] if t else 1) * model.emit[flat[s + t], state]
            total += p
        assert np.isclose(value, np.log10(total))
    begin, moves, emits = hmm.expected_counts(model, flat, starts, lengths)
    assert np.isclose(begin.sum(), 3, atol=1e-4) and np.isclose(moves.sum(), (lengths - 1).sum(), atol=1e-4)
    assert np.isclose(emits.sum(), lengths.sum(), atol=1e-4)


def toy_hmm(rng, states=3, symbols=5):
    import numpy as np

    return hmm.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def test_hmm_baum_welch_step_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    model, lengths = toy_hmm(rng), np.array([5, 1, 7, 2])
    flat = rng.integers(0, 5, lengths.sum())
    expected = np.zeros((5 + 3 + 1, 3))
    for s, n in zip(np.cumsum(lengths) - lengths, lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weights = []
        for path in paths:
            steps = [model.emit[flat[s + t], k] * (model.move[path[t - 1], k] if t else model.start[k]) for t, k in enumerate(path)]
            weights.append(np.prod(steps))
        for path, weight in zip(paths, np.array(weights) / sum(weights)):
            expected[8, path[0]] += weight
            for t, k in enumerate(path):
                expected[flat[s + t], k] += weight
                if t:
                    expected[5 + path[t - 1], k] += weight
    assert np.allclose(hmm.text_counts(model, flat, lengths), expected, atol=1e-4)
    # texts of more than two symbols in runs of two: the cuts change nothing
    assert np.allclose(hmm.text_counts(model, flat, lengths, whole=2), expected, atol=1e-4)


def test_hmm_long_texts_are_not_cut():
    import numpy as np

    rng = np.random.default_rng(4)
    model, lengths = toy_hmm(rng, 4, 50), np.array([3, hmm.WHOLE, 5000, 1, hmm.SEGMENT * 3, hmm.WHOLE + 1])
    flat = rng.integers(0, 50, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    uncut = 1 << 30
    assert np.allclose(hmm.log_likelihoods(model, flat, starts, lengths), hmm.log_likelihoods(model, flat, starts, lengths, uncut), rtol=1e-12)
    by_runs, at_once = (hmm.text_counts(model, flat, lengths, w) for w in (hmm.WHOLE, uncut))
    assert np.allclose(by_runs, at_once, rtol=1e-3, atol=1e-3)
    assert np.isclose(by_runs[-1].sum(), len(lengths), atol=1e-3)


def test_hmm_symbols_grow_with_the_text(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]

    def symbols(n):
        rows = [(i, " ".join(rng.choices(words, weights, k=400))) for i in range(n)]
        lexicon = hmm.lexicon(hmm.word_counts(hmm.tokenized(documents(spark, rows))).cache(), n)
        own = int((lexicon.symbols > hmm.CLASSES).sum())
        assert len(lexicon.unigram) == 1 + hmm.CLASSES + own and own <= hmm.OWN * lexicon.tokens**0.5
        return own

    assert symbols(400) > 1.5 * symbols(20)


def test_hmm_scores_word_by_word(spark):
    import numpy as np

    rows = corpus(9)
    rows += [(901, " ".join(t or "" for _, t in rows) + " unseen")]
    docs = documents(spark, rows)
    found = {(r.doc_id, r.n_tokens): r.score for r in hmm.score(docs, states=2, steps=2).collect()}
    tokens = hmm.tokenized(docs)
    counts = hmm.word_counts(tokens).cache()
    ends = tokens.where("not held_out").count()
    words = hmm.lexicon(counts, ends)
    model = hmm.train(hmm.encoded(tokens, words), words, 2, 2)
    n = {bytes(r.word): r.n for r in counts.collect()}
    own = {w: int(words.symbols[i]) for w, i in words.index.items() if words.symbols[i] > hmm.CLASSES}
    in_class: dict[int, list[int]] = {}
    for w, count in n.items():
        if w not in own:
            in_class.setdefault(hmm.word_class(w), []).append(count)
    for doc_id, text in rows:
        alpha, total = None, 0.0
        pieces = (text or "").encode().lower().split()
        for w in [*pieces, None]:
            symbol = hmm.END_SYMBOL if w is None else own.get(w, hmm.word_class(w))
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[symbol]
            total += np.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w is not None and w not in own:
                mates = in_class.get(symbol, [])
                total += np.log10((n.get(w, 0) + hmm.ADD) / (sum(mates) + hmm.ADD * (len(mates) + 1)))
        assert abs(found[doc_id, len(pieces) + 1] - total) < 1e-6 * max(1, len(pieces))


# 7 ---------------------------------------------------------------------------------------------


def test_decontamination_against_all_windows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["of", "the", "a"] * 20
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(20)]
    items += [(30, None), (31, "... !"), (None, "w1 w2 w3 w4 w5 w6"), (0, items[0][1])]
    rows = []
    for i in range(80):
        words = rng.choice(items[:20])[1].split()
        for _ in range(rng.randrange(0, 3)):
            at = min(len(words) - 1, rng.choice([0, 1, 2, len(words) - 1, rng.randrange(len(words))]))
            words[at : at + 1] = rng.choice([["new"], [], [words[at], "new"]])
            words = words or ["lone"]
        before, after = (rng.choices(vocabulary, k=rng.randrange(0, 30)) for _ in range(2))
        rows.append((i, rng.choice(["", ". ", "— "]) + ", ".join([*before, *words, *after]) + rng.choice(["", "!"])))
    rows += [(100, "New. " + items[3][1].upper() + "!"), (101, None), (102, "")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    found = decontam.contaminated(documents(spark, rows + [(None, items[2][1])]), bench).collect()
    expected = contaminated(rows, [(i, t) for i, t in items if i is not None])
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in expected.items()}
    assert len(found) == len(expected) > 40


def test_items_shorter_than_a_shingle_match_whole(spark):
    rows = [(1, "aa www1 w2 w3 bb cc dd ee"), (2, "www1 w2 w3"), (3, "zz solo yy"), (4, "www1 w2 w4 w3"), (5, "www1 w2")]
    items = [(7, "WWW1 w2, w3"), (8, "solo")]
    found = decontam.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.first_word) for r in found} == {(1, 7, 1), (2, 7, 0), (3, 8, 1)}
    assert {k: 1.0 for k in contaminated(rows, items)} == {(r.doc_id, r.item_id): r.similarity for r in found}


# 8 ---------------------------------------------------------------------------------------------


def plain_blocks(words, template, threshold, span):
    """(first word, containment) of every window that contains a template, from each of its tokens on."""
    target = set(zip(template, template[1:]))
    width, need = math.ceil(span * len(template) - 1e-9), math.ceil(threshold * len(target) - 1e-9)
    out = []
    for i in range(len(words) - 1):
        if (words[i], words[i + 1]) in target:
            window = words[i : i + width]
            shared = target & set(zip(window, window[1:]))
            if len(shared) >= need:
                out.append((i, len(shared) / len(target)))
    return out


def split_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_license_scan(spark):
    gpl = dict(licenses.TEMPLATES)["lgpl"]
    rows = corpus(8, 40) + awkward(2000) + [
        (3000, "cc by cc by\nThis work is licensed under the GNU General Public License, version 3."),
        (3001, "gnu general public\nlicense MIT-License apache_license"),
        (3002, "Under the Apache License, version 2.0 licensed. released under the mit"),
        (3003, "émit license mit licenses mit license"),
        (3004, (" word" * 50 + " ").join([gpl] * 3)),
        (3005, gpl.replace("and/or", "and maybe or perhaps")),
        (3006, gpl + " word" * 50 + " " + gpl[: len(gpl) // 2]),
    ]
    found = {(r.doc_id, r.n_words): r for r in licenses.scan(documents(spark, rows)).collect()}
    for doc, text in rows:
        words, places, wanted = split_words(text), [], {}
        for phrase, label in licenses.PHRASES:
            own = phrase.split()
            places += [(label, i) for i in range(len(words)) if words[i : i + len(own)] == own]
        for label, template in licenses.TEMPLATES:
            for i, share in plain_blocks(words, split_words(template), licenses.THRESHOLD, licenses.SPAN):
                wanted.setdefault(label, {})[i] = share
        r = found[doc, len(words)]
        assert sorted(map(tuple, r.places)) == sorted(places)
        assert {b.label for b in r.blocks} == set(wanted)
        for b in r.blocks:
            assert wanted[b.label][b.first_word] == pytest.approx(b.containment) and b.first_word < b.last_word < len(words)
        assert max((b.containment for b in r.blocks), default=0) == pytest.approx(max((x for w in wanted.values() for x in w.values()), default=0))
    assert len([b for b in found[3004, len(split_words(rows[-3][1]))].blocks if b.label == "lgpl"]) == 3


@pytest.mark.parametrize("width", [20, 40, 79, 1000])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_found(spark, width, mark):
    import textwrap

    lines = [mark + x for _, t in licenses.TEMPLATES for x in [*textwrap.wrap(t, width), ""]]
    found = licenses.scan(documents(spark, [(1, "\n".join(lines))])).first()
    assert {b.label for b in found.blocks} == {label for label, _ in licenses.TEMPLATES}


def test_scattered_words_are_no_notice(spark):
    rng = random.Random(4)
    rows = [(0, "The band released an album under contract; a student at MIT lost the driving license he had")]
    for i, (_, text) in enumerate(licenses.TEMPLATES, 1):
        words = text.split()
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        rows.append((100 + i, " of ".join(text.split())))
    assert all(not r.blocks for r in licenses.scan(documents(spark, rows)).collect())


# 9 ---------------------------------------------------------------------------------------------


def test_simhash_groups(spark):
    rng = random.Random(9)
    rows = corpus(9, 60)
    for i in range(60):
        words = rng.choice(rows)[1].split() or ["a"]
        words[rng.randrange(len(words))] = "changed"
        rows.append((5000 + i, " ".join(words)))
    rows += [(6000, None), (6001, ""), (6002, "two words"), (6003, "Two  WORDS\n")]
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found}
    assert got == simhash_groups(rows) and len(found) == len(rows)


def test_simhash_links_are_complete(spark):
    """Chains of fingerprints: each step of 2 bits links, every step of 3 does not."""
    rng = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for step in range(6):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    from brute import roots
    from starfold.llm.common import components

    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r.id: r.root for r in components(simhash.links(frame)).collect()}
    near = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    group = roots(len(prints), near)
    assert {p: got.get(p, p) for p in prints} == {p: prints[g] for p, g in zip(prints, group)}


def test_spaces_pattern():
    """The library splits bytes at the same characters as the contracts' pattern."""
    text = "a\x0bb\x0cc\x1cd\x85e f\tg\rh\ni j\x1fk"
    assert [w.decode() for w in text.encode().split()] == re.findall(SPACES, text)
