"""Importance resampling of documents towards a target text distribution.

Texts are turned into words by one 256-byte table over their UTF-8 bytes (A-Z become lower case, every
other ASCII byte that is no letter or digit becomes a space) and ``bytes.split``. A feature is a run of
1 to ``longest`` consecutive words joined by a space; its bucket is its crc32 modulo ``buckets``, and a
longer run extends the crc32 of the shorter one (the seed of ``zlib.crc32``), so no run is ever joined.
Counters add up the buckets within a task, one aggregation adds up the tasks.

A bucket's gain is the rounded log ratio of its smoothed shares in the target and in the documents. A
document's weight is its mean gain, its score adds Gumbel noise from a hash of its id, and the highest
scores are a draw without replacement in proportion to the exponential of the weights.

The rank of the drawn rows comes from a histogram of the scores, which are whole numbers within about
+-80,000 whatever the corpus, and an order within one score; rows are never sorted as a whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.common import blank, bound_batches, cut, map_batches, small_enough

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

_WORD = [chr(b).isalnum() if b < 128 else True for b in range(256)]
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if _WORD[b] else 32 for b in range(256))
BLOCK = 1 << 20
MOST_HELD = 1 << 18


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text, block by block; a block ends between two words."""
    raw = text.encode().translate(WORD_BYTES)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def features(text: str, longest: int) -> Iterator[tuple[int, list[int]]]:
    """(number of words, hashes of the runs that end in this block) for each block of the text."""
    before: list[bytes] = []
    for words in word_blocks(text):
        hashes = list(map(crc32, words))
        if longest > 1:
            joined = before + words
            spaced = [b" " + w for w in joined]
            runs = list(map(crc32, joined))
            for length in range(2, longest + 1):
                runs = list(map(crc32, spaced[length - 1 :], runs))
                # The first runs lie in the words of the block before and were counted there.
                hashes += runs[max(0, len(before) - length + 1) :]
            before = joined[-(longest - 1) :]
        yield len(words), hashes


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often each bucket occurs in a column ``text``; a null text has no words."""

    def count(batches):
        total, held = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, hashes in features(text, longest):
                    held.update(hashes)
                if len(held) > MOST_HELD:
                    _reduce(held, total, buckets)
        _reduce(held, total, buckets)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"]
            )

    bound_batches(texts.sparkSession)
    found = texts.select(blank("text").alias("text")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def _reduce(held: Counter, total: Counter, buckets: int) -> None:
    """Move counts by hash to counts by bucket."""
    for feature, n in held.items():
        total[feature % buckets] += n
    held.clear()


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; at most ``buckets`` counts of each side come to the driver."""
    sides = []
    for texts in (docs, target):
        counts = np.zeros(buckets)
        for bucket, n in bucket_counts(texts, longest, buckets).collect():
            counts[bucket] = n
        sides.append(counts)
    own, wanted = sides
    own_all, wanted_all = float(own.sum()) + buckets, float(wanted.sum()) + buckets
    return np.array(
        [math.floor(1000 * math.log((t + 1) * own_all / ((s + 1) * wanted_all))) for s, t in zip(own.tolist(), wanted.tolist())],
        np.int64,
    )


def noise(seed: int, doc_id) -> int:
    """Gumbel noise in thousandths from the id alone; a missing id reads as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row per row of ``docs``."""
    buckets = len(gains)

    def run(batch):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n_words = n_features = total = 0
            for words, hashes in features(text, longest):
                n_words += words
                n_features += len(hashes)
                total += int(gains[np.array(hashes, np.int64) % buckets].sum())
            weight = total // n_features if n_features else 0
            rows.append((doc, n_words, n_features, weight, weight + noise(seed, doc)))
        names = ["doc_id", "n_words", "n_features", "weight", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text"))
    return map_batches(narrow, run, "doc_id long, n_words long, n_features long, weight long, score long")


def rank_highest(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with the rank of the drawn rows, null for the others.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn by falling
    score; ties go to the smaller doc_id, a missing id last, then to fewer features. Equal rows are
    counted together and take consecutive ranks. ``scored`` is read several times and must be cheap.
    """
    fit = F.col("n_words") >= least_words
    scores = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    steps = cut(scores.select("score", "n", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above")), "scores")
    wanted = (steps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    steps = steps.where(F.col("above") < wanted).select("score", "above")
    last, distinct = steps.agg(F.min("score"), F.count("*")).first()
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))

    near = fit & (F.col("score") >= last)
    columns = scored.columns
    grouped = scored.where(near).groupBy(*columns).agg(F.count("*").alias("copies"))
    placed = grouped.join(small_enough(steps, distinct, 64), "score")
    order = [F.asc_nulls_last("doc_id"), "n_features", "weight", "n_words"]
    within = Window.partitionBy("score").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("above") + F.coalesce(F.sum("copies").over(within), F.lit(0)) + 1
    one_each = placed.withColumn("first", first).select(
        *columns, F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("rank")
    )
    drawn = one_each.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per row of ``docs``.

    ``docs`` has doc_id and text, ``target`` has text; other columns are ignored. A null or empty text
    has no words, no features and weight 0. Rows that repeat are rows of their own; rows of one id share
    its noise. A row without id is scored with the noise of an empty id and loses every tie. An empty
    target leaves the smoothed documents alone to set the gains; no documents give no rows.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    return rank_highest(cut(weigh(docs, gains, longest, seed), "weights"), least_words, percent)


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The documents that were drawn, whole, with all their columns; an id is drawn with all its rows."""
    ids = ranked.where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi")
