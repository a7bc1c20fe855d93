"""Hidden Markov language model, trained by Baum-Welch over all training documents.

Latent states emit symbols. The end of a text is a symbol, and so is every word seen at least
sqrt(N) / ``OWN`` times in N training tokens; every other word falls into one of ``CLASSES`` symbols by the
hash of its last three bytes, and within the class it has its smoothed share of the class's training
count. So the model gives every word, known or not, a proper probability. Its own symbols grow with the
corpus, but there cannot be more than ``OWN`` * sqrt(N) of them.

Counts of words are one aggregation by word. Words with a symbol of their own, and those with a share of
at least 1 / ``FREQUENT`` of the training tokens (there cannot be more than ``FREQUENT`` of them), travel with
the tasks; the others are looked up by a join of (document, word) rows. In each Baum-Welch step every
partition adds up its expected counts, and an aggregation by symbol adds the partitions.

Every text is one sequence, whatever its length. A text of more than ``WHOLE`` symbols is worked on in runs
of ``SEGMENT``: the product of its step matrices takes a run from its first to its last symbol, so the
forward and backward vectors at all cuts follow exactly, and the runs need not wait for each other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import blank, bound_batches, cut

STATES = 8
STEPS = 4
OWN = 4
CLASSES = 1 << 10
FREQUENT = 1 << 17
FOLDS = 10
ADD = 0.1
WHOLE = 1024
SEGMENT = 512
RESCALE = 8
BLOCK_TOKENS = 1 << 20
FLUSH_WORDS = 400_000
SEED = 17
END_SYMBOL = 0


def word_class(word: bytes) -> int:
    """The class symbol of a word without a symbol of its own."""
    return 1 + zlib.crc32(word[-3:]) % CLASSES


def tokenized(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text). A row without doc_id is held out."""
    doc_id = F.col("doc_id").cast("long")
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return docs.select(doc_id.alias("doc_id"), (F.coalesce(fold, F.lit(0)) == 0).alias("held_out"), blank("text").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, cls): counts over the training documents; words as bytes, A-Z lower-cased."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.encode().lower().split())
                if len(counts) > FLUSH_WORDS:
                    yield _count_batch(counts)
                    counts.clear()
        if counts:
            yield _count_batch(counts)

    bound_batches(rows.sparkSession)
    partial = rows.where("not held_out").select("text").mapInArrow(run, "word binary, cls int, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"), F.min("cls").alias("cls"))


def _count_batch(counts: Counter) -> pa.RecordBatch:
    classes = pa.array([word_class(w) for w in counts], pa.int32())
    columns = [pa.array(list(counts), pa.binary()), classes, pa.array(list(counts.values()), pa.int64())]
    return pa.record_batch(columns, names=["word", "cls", "n"])


@dataclass
class Lexicon:
    """What a task needs to turn words into symbols and frequent words into counts."""

    index: dict[bytes, int]
    symbols: np.ndarray
    log_counts: np.ndarray
    class_log_totals: np.ndarray
    unigram: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @property
    def symbol_type(self) -> type:
        return np.uint16 if len(self.unigram) <= 1 << 16 else np.uint32

    @property
    def denominator(self) -> float:
        return self.tokens + ADD * (self.distinct + 1)


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    """From the materialised counts and the number of training documents."""
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = words + ends, distinct + (ends > 0)
    own_least = max(1.0, tokens**0.5 / OWN)
    least = max(1.0, min(tokens / FREQUENT, own_least))
    frequent = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    n = frequent["n"].to_numpy(np.int64)
    own = n >= own_least
    symbols = np.where(own, CLASSES + np.arange(1, len(n) + 1), frequent["cls"].to_numpy(np.int64))
    size = 1 + CLASSES + int(own.sum())
    totals, kinds = np.zeros(size), np.zeros(size)
    for r in counts.where(F.col("n") < F.lit(own_least)).groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        totals[r.cls], kinds[r.cls] = r.n, r.k
    unigram = totals.copy()
    unigram[END_SYMBOL] = ends
    np.add.at(unigram, symbols[own], n[own])
    unigram = (unigram + ADD) / (unigram + ADD).sum()
    index = {bytes(w): i for i, w in enumerate(frequent["word"])}
    log_totals = np.log10(totals + ADD * (kinds + 1))
    return Lexicon(index, symbols, np.log10(n + ADD), log_totals, unigram, tokens, distinct, ends)


ENCODED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, "
    "log_in_class double, symbols binary, rare array<struct<h:long,c:long,tf:int>>"
)


def encoded(rows: DataFrame, words: Lexicon) -> DataFrame:
    """One row per document: its symbols and sums over its frequent words; its rare words by two hashes.

    ``log_counts`` adds log10(count + 0.1) over frequent words and the end, ``log_in_class`` the log10
    share in the class over words without own symbol, still without the counts of rare words.
    """

    def run(batches):
        known_end, log_end = int(words.ends > 0), float(np.log10(words.ends + ADD))
        get = words.index.get
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                tokens = text.encode().lower().split()
                at = np.array([get(w, -1) for w in tokens], np.int64)
                rare = Counter(w for w, i in zip(tokens, at.tolist()) if i < 0)
                frequent = at[at >= 0]
                symbols = np.empty(len(at) + 1, words.symbol_type)
                symbols[-1] = END_SYMBOL
                body = symbols[:-1]
                body[at >= 0] = words.symbols[frequent]
                body[at < 0] = [word_class(w) for w, i in zip(tokens, at.tolist()) if i < 0]
                in_class = body <= CLASSES
                logs = words.log_counts[frequent]
                share = logs[in_class[at >= 0]].sum() - words.class_log_totals[body[in_class]].sum()
                hashes = [(xxhash.xxh64_intdigest(w, 42) + (1 << 63) & (1 << 64) - 1) - (1 << 63) for w in rare]
                out.append(
                    (
                        len(tokens) + 1,
                        len(frequent) + known_end,
                        float(logs.sum()) + log_end,
                        float(share),
                        symbols.tobytes(),
                        [{"h": h, "c": zlib.crc32(w), "tf": n} for h, (w, n) in zip(hashes, rare.items())],
                    )
                )
            rare_type = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("tf", pa.int32())]))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type)
            arrays = [pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            names = [c.split()[0] for c in ENCODED.split(", ")]
            yield pa.record_batch([batch.column(c) for c in ("rid", "doc_id", "held_out")] + arrays, names=names)

    bound_batches(rows.sparkSession)
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    return cut(numbered.mapInArrow(run, ENCODED), "hmm-documents")


@dataclass
class Hmm:
    """Initial, transition (from row to column) and emission (symbol, state) probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int = STATES) -> Hmm:
        noise = np.exp(np.random.default_rng(SEED).normal(size=(len(unigram), states)))
        emit = unigram[:, None] * noise
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by falling length, and how many sequences are longer than each step."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(lengths.max(initial=0))
    return order, np.searchsorted(-lengths[order], -steps, side="left")


def _forward(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion, symbol by symbol."""
    order, active = _by_length(lengths)
    first, total = starts[order], np.zeros(len(lengths))
    alpha = None
    for t, n in enumerate(active.tolist()):
        alpha = np.broadcast_to(model.start, (n, len(model.start))) if alpha is None else alpha[:n] @ model.move
        alpha = alpha * model.emit[flat[first[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def _runs(starts: np.ndarray, lengths: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of at most ``size`` symbols of each text, and the text they belong to."""
    parts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    return starts[text] + number * size, np.minimum(size, lengths[text] - number * size), text


def _products(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run the matrix from the state at its first symbol, not yet emitted, to that at its last one.

    The second result is the log10 of the factor taken out of each matrix.
    """
    states = len(model.start)
    order, active = _by_length(lengths)
    first, logs = starts[order], np.zeros(len(lengths))
    product = np.broadcast_to(np.eye(states), (len(lengths), states, states)).copy()
    for t, n in enumerate(active.tolist()):
        step = product[:n] if t == 0 else (product[:n].reshape(-1, states) @ model.move).reshape(n, states, states)
        step = step * model.emit[flat[first[:n] + t]][:, None]
        if t % RESCALE == RESCALE - 1:
            scale = step.sum(axis=(1, 2))
            step /= scale[:, None, None]
            logs[:n] += np.log10(scale)
        product[:n] = step
    scale = product.sum(axis=(1, 2))
    out, factors = np.empty_like(product), np.empty(len(lengths))
    out[order], factors[order] = product / scale[:, None, None], logs + np.log10(scale)
    return out, factors


def _ends(model: Hmm, products: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward vector at the last symbol of each run, and the factor taken out of it; runs in the order of texts."""
    ends, scales = np.empty(products.shape[:2]), np.empty(len(text))
    for i, product in enumerate(products):
        end = (ends[i - 1] @ model.move if i and text[i] == text[i - 1] else model.start) @ product
        scales[i] = end.sum()
        ends[i] = end / scales[i]
    return ends, scales


def log_likelihoods(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, whole: int = WHOLE) -> np.ndarray:
    """log10 likelihood of each text over its whole length; those of more than ``whole`` symbols by runs."""
    out, long = np.empty(len(lengths)), lengths > whole
    out[~long] = _forward(model, flat, starts[~long], lengths[~long])
    if long.any():
        begins, sizes, text = _runs(starts[long], lengths[long], min(SEGMENT, whole))
        products, factors = _products(model, flat, begins, sizes)
        out[long] = np.bincount(text, factors + np.log10(_ends(model, products, text)[1]))
    return out


def _borders(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray):
    """(before, after): the forward vector ahead of each run, the backward vector at its last symbol.

    ``before`` is 0 for the first run of a text and ``after`` 1 for the last one.
    """
    products, _ = _products(model, flat, starts, lengths)
    ends, _ = _ends(model, products, text)
    before, after = np.zeros_like(ends), np.ones_like(ends)
    inner = text[1:] == text[:-1]
    before[1:][inner] = ends[:-1][inner]
    for i in np.flatnonzero(inner)[::-1].tolist():
        back = model.move @ (products[i + 1] @ after[i + 1])
        after[i] = back / (back @ ends[i])
    return before, after


def expected_counts(model: Hmm, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before=None, after=None):
    """Expected starts, moves and emissions of a block of sequences (forward-backward).

    A sequence may be a run of a longer text: ``before`` and ``after`` (see ``_borders``) say what goes on
    beyond its ends. The move into a run counts with it; a start counts only where a text begins.
    """
    move, emit, begin = (x.astype(np.float32) for x in (model.move, model.emit, model.start))
    order, active = _by_length(lengths)
    first, shape = starts[order], (len(lengths), len(begin))
    before = np.zeros(shape, np.float32) if before is None else before[order].astype(np.float32)
    after = np.ones(shape, np.float32) if after is None else after[order].astype(np.float32)
    opens = ~before.any(axis=1)
    alphas, gives, scales, symbols = [], [], [], []
    for t, n in enumerate(active.tolist()):
        symbol = flat[first[:n] + t]
        give = emit[symbol]
        alpha = give * (alphas[-1][:n] @ move if t else np.where(opens[:, None], begin, before @ move))
        scale = alpha.sum(axis=1, keepdims=True)
        alphas.append(alpha / scale)
        gives.append(give)
        scales.append(scale)
        symbols.append(symbol)
    moves = np.zeros(move.shape)
    gammas, weight = [], None
    for t in range(len(alphas) - 1, -1, -1):
        beta = after[: len(alphas[t])].copy()
        if weight is not None:
            moves += alphas[t][: len(weight)].T @ weight
            beta[: len(weight)] = weight @ move.T
        gammas.append(alphas[t] * beta)
        weight = gives[t] * beta / scales[t]
    moves += before.T @ weight
    seen, gamma = np.concatenate(symbols[::-1]), np.concatenate(gammas)
    emits = np.stack([np.bincount(seen, gamma[:, k], len(emit)) for k in range(len(move))], axis=1)
    return gammas[-1][opens].sum(axis=0), moves * move, emits


def text_counts(model: Hmm, flat: np.ndarray, lengths: np.ndarray, whole: int = WHOLE) -> np.ndarray:
    """Expected counts of whole texts that lie one behind the other: rows of symbols, moves and starts."""
    starts, states = np.cumsum(lengths) - lengths, len(model.start)
    short, long = lengths <= whole, np.flatnonzero(lengths > whole)
    begins, sizes, text = _runs(starts[long], lengths[long], min(SEGMENT, whole))
    before, after = (np.zeros((0, states)), np.ones((0, states)))
    if len(long):
        before, after = _borders(model, flat, begins, sizes, text)
    begins, sizes = np.concatenate([starts[short], begins]), np.concatenate([lengths[short], sizes])
    before = np.concatenate([np.zeros((short.sum(), states)), before])
    after = np.concatenate([np.ones((short.sum(), states)), after])
    sums = np.zeros((len(model.emit) + states + 1, states))
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK_TOKENS)) + 1
    for part in np.split(np.arange(len(sizes)), edges):
        opened, moves, emits = expected_counts(model, flat, begins[part], sizes[part], before[part], after[part])
        sums += np.concatenate([emits, moves, opened[None]])
    return sums


def _blocks(batches, kind: type) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Batches up to about ``BLOCK_TOKENS`` tokens with all their symbols and the documents' lengths."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            held.append(part)
            size += sum(len(x) for x in part.column("symbols").to_pylist()) // np.dtype(kind).itemsize
            if size >= BLOCK_TOKENS:
                yield _joined(held, kind)
                held, size = [], 0
    if held:
        yield _joined(held, kind)


def _joined(held, kind):
    raw = [x for part in held for x in part.column("symbols").to_pylist()]
    lengths = np.array([len(x) for x in raw], np.int64) // np.dtype(kind).itemsize
    return held, np.frombuffer(b"".join(raw), kind).astype(np.int64), lengths


def train(documents: DataFrame, words: Lexicon, states: int = STATES, steps: int = STEPS) -> Hmm:
    """Baum-Welch over all training documents, each of them one sequence."""
    rows = documents.where("not held_out").select("symbols")
    unigram, kind = words.unigram, words.symbol_type
    model, size = Hmm.initial(unigram, states), len(unigram)
    names = [f"s{k}" for k in range(states)]
    schema = "row int, " + ", ".join(f"{n} float" for n in names)
    for _ in range(steps):

        def run(batches, model=model):
            sums = np.zeros((size + states + 1, states))
            for _, flat, lengths in _blocks(batches, kind):
                sums += text_counts(model, flat, lengths)
            used = np.flatnonzero(sums.any(axis=1))
            columns = [pa.array(used, pa.int32()), *[pa.array(sums[used, k], pa.float32()) for k in range(states)]]
            yield pa.record_batch(columns, names=["row", *names])

        added = rows.mapInArrow(run, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
        sums = np.zeros((size + states + 1, states))
        for r in added.collect():
            sums[r.row] = r[1:]
        emit = sums[:size] + unigram[:, None]
        move, start = sums[size:-1] + 1 / states, sums[-1] + 1 / states
        model = Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def score(docs: DataFrame, states: int = STATES, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end. The model and all
    counts come from documents whose crc32(doc_id as text) mod 10 is not 0. ``base_score`` is the
    smoothed unigram log10 probability, ``score`` that of the hidden Markov model for the whole text.
    Null and empty texts are the end alone. Rows without doc_id are held out and scored; repeated
    rows are learned and scored each. Other columns are ignored. An empty table gives no rows;
    without training documents all words are unknown.
    """
    rows = tokenized(docs)
    counts = cut(word_counts(rows), "hmm-words")
    words = lexicon(counts, rows.where("not held_out").count())
    documents = encoded(rows, words)
    model = train(documents, words, states, steps)

    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_in_class"]
    kind = words.symbol_type

    def run(batches):
        for held, flat, lengths in _blocks(batches, kind):
            found = log_likelihoods(model, flat, np.cumsum(lengths) - lengths, lengths)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield pa.record_batch([*[whole.column(n) for n in names], pa.array(found)], names=[*names, "log_symbols"])

    schema = documents.select(*names).schema.add("log_symbols", "double")
    scored = documents.select(*names, "symbols").mapInArrow(run, schema)
    rare = documents.select("rid", F.explode("rare").alias("w")).select("rid", "w.h", "w.c", "w.tf")
    listed = counts.select(F.xxhash64("word").alias("h"), F.crc32("word").alias("c"), "n")
    found = rare.join(listed, ["h", "c"], "left").groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_known"),
    )
    out = scored.join(found, "rid", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(words.tokens)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * float(np.log10(words.denominator))).alias("base_score"),
        (F.col("log_symbols") + F.col("log_in_class") + logs).alias("score"),
    )
