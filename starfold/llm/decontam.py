"""Benchmark decontamination in DataFrame operations only.

1. Prefix filter. A window as long as an item and similar enough shares all but a few of the item's
   word shingles, so one of any ``floor(m * (1 - t)) + 1`` of them is in the window. Of those the
   ones around long words are taken, and document words are matched with these words only.
2. Windows. Around each place where such a shingle stands, every window of the item's length.
   A window that shares no shingle has similarity 0 and need not be made.
3. SimHash. 126 bits per distinct window: two hashes per shingle, bits counted in packed lanes.
4. Multi-index Hamming blocks. 9 blocks of 14 bits; within radius 35 some block differs in 3 bits or
   fewer. Items are listed under all values of a block within 3 bits, windows look up their own.
   So every window within the radius meets its items, none is left to chance.
5. Verification. Weighted (multiset) Jaccard similarity of the shingles, exact.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import blank, cut, row_key, small_enough

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 35
BLOCKS = 9
BLOCK_BITS = 14
BLOCK_RADIUS = RADIUS // BLOCKS
LANES = 21
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased letter and digit runs."""
    return F.filter(_pieces(text), lambda w: w != "")


def _pieces(text: Column) -> Column:
    """Like ``words_of``, but with an empty first or last element beside leading or trailing punctuation."""
    return F.split(F.lower(text), NOT_WORD)


def shingles(words: Column, n: int = SHINGLE_WORDS) -> Column:
    """Hashes of the n-word shingles; of the whole sequence when it is shorter."""
    last = F.greatest(F.size(words) - n, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: _joined(F.slice(words, i + 1, n)))


def _joined(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def numbered(hashes: Column) -> Column:
    """Each hash with its occurrence number, so that set operations count repeats."""
    return F.transform(
        hashes, lambda x, i: F.struct(x.alias("h"), F.size(F.filter(F.slice(hashes, 1, i + 1), lambda y: y == x)).alias("k"))
    )


def _fingerprint(hash_column: Column, weight: Column) -> Column:
    """63 bits: bit b is 1 if set in more than half of the group's hashes.

    Lanes 21 bits wide count three bits of the hash in one sum; adding a bias moves "more than half"
    into the top bit of each lane. Right for fewer than 2^20 shingles.
    """
    lanes = 1 | 1 << LANES | 1 << 2 * LANES
    bias = F.lit((1 << LANES - 1) - 1) - F.floor(weight / 2).cast("long")
    bits = []
    for k in range(LANES):
        total = F.sum(F.shiftrightunsigned(hash_column, k).bitwiseAND(F.lit(lanes)))
        top = F.shiftrightunsigned(total + bias * F.lit(lanes), LANES - 1).bitwiseAND(F.lit(lanes))
        bits.append(F.shiftleft(top, k))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def with_fingerprints(rows: DataFrame, key: list[str], hashes: str) -> DataFrame:
    """(key, f1, f2): two SimHashes of 63 bits over the hashes in an array column."""
    long = rows.select(*key, F.explode(hashes).alias("h")).withColumn("g", F.xxhash64("h"))
    weight = F.count(F.lit(1))
    return long.groupBy(*key).agg(_fingerprint(F.col("h"), weight).alias("f1"), _fingerprint(F.col("g"), weight).alias("f2"))


def _block(i: int) -> Column:
    """Block i of the 126 bits f2:f1."""
    start = i * BLOCK_BITS
    mask = F.lit((1 << BLOCK_BITS) - 1)
    if start + BLOCK_BITS <= 63:
        return F.shiftright("f1", start).bitwiseAND(mask)
    if start >= 63:
        return F.shiftright("f2", start - 63).bitwiseAND(mask)
    return F.shiftright("f1", start).bitwiseOR(F.shiftleft("f2", 63 - start)).bitwiseAND(mask)


def _blocks() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(i).alias("value")) for i in range(BLOCKS)])


def _ball() -> list[int]:
    """All masks of at most ``BLOCK_RADIUS`` bits."""
    return [sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]


def _distance() -> Column:
    parts = [F.bit_count(F.col(f"w.{f}").bitwiseXOR(F.col(f"i.{f}"))) for f in ("f1", "f2")]
    return parts[0] + parts[1]


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, hashes): items with at least one word; repeated rows once."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), blank("text").alias("text"))
    items = items.distinct().select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return items.withColumn("hashes", shingles(F.col("words"))).distinct()


def anchors(items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(word, item_id, n_words, shingle, back, at, hash): the prefix shingles under their longest word.

    ``at`` is the shingle's place in the item, ``back`` the word's place in the shingle.
    """
    n = SHINGLE_WORDS
    best = F.transform(
        F.col("hashes"),
        lambda h, i: F.struct(
            F.array_max(
                F.transform(
                    F.slice("words", i + 1, n),
                    lambda w, k: F.struct(F.length(w).alias("length"), F.xxhash64(w).alias("word"), k.cast("int").alias("back")),
                )
            ).alias("best"),
            h.alias("hash"),
        ),
    )
    take = F.floor(F.size("hashes") * F.lit(1 - similarity) + F.lit(1e-9)).cast("int") + 1
    chosen = F.slice(F.sort_array(best, asc=False), 1, take)
    rows = items.select("item_id", F.size("words").alias("n_words"), F.explode(chosen).alias("c"))
    return rows.select("item_id", "n_words", "c.best.word", "c.best.back", "c.hash").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_windows): items found in documents.

    A document holds an item if a window of the item's number of words (cut at the ends of the
    document) has weighted Jaccard similarity ``similarity`` or more with it over 5-word shingles,
    counted with repeats, of lower-cased letter and digit runs. ``similarity`` and ``first_word``
    (its word index) are of the best window, the first one of ties. Items of fewer than five words are one
    shingle and must match whole; items and documents without words match nothing, like null texts.
    Rows without doc_id or item_id are left out; rows of one id with different texts count as one
    document. Empty tables give no rows; other columns are ignored.
    """
    n = SHINGLE_WORDS
    items = cut(item_table(benchmark), "benchmark-items")
    prefix = cut(anchors(items, similarity), "benchmark-anchors")
    n_prefix = prefix.count()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text"))

    # 1. places of the prefix words; the text itself does not travel
    split = rows.select("doc_id", _pieces(F.col("text")).alias("pieces"))
    split = split.select("doc_id", (F.col("pieces")[0] == "").cast("int").alias("lead"), "pieces")
    # outer, because a plain explode makes Spark split each text once more to test for emptiness
    word_rows = split.select("doc_id", "lead", F.posexplode_outer("pieces").alias("pos", "w"))
    placed = word_rows.select("doc_id", (F.col("pos") - F.col("lead")).alias("pos"), F.xxhash64("w").alias("word"))
    hits = placed.join(small_enough(prefix, n_prefix, 200), "word")
    hits = hits.select("doc_id", "item_id", "n_words", "hash", (F.col("pos") - F.col("back")).alias("at"))
    hits = cut(hits.where("at >= 0").distinct(), "benchmark-hits")
    hit_docs = cut(hits.select("doc_id").distinct(), "benchmark-hit-docs")

    # 2. only the documents with such words are read again; the shingles at their places are compared
    wanted = rows.join(small_enough(hit_docs, hit_docs.count(), 64), "doc_id", "left_semi")
    places = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "n_words", "hash", "at")).alias("places"))
    held = wanted.join(places, "doc_id").withColumn("words", words_of(F.col("text")))
    true = F.filter("places", lambda p: _joined(F.slice("words", p["at"] + 1, F.least(F.lit(n), p["n_words"]))) == p["hash"])
    held = held.select("doc_id", "words", true.alias("places")).where(F.size("places") > 0)
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "places",
                lambda p: F.transform(
                    F.sequence(p["at"] - F.greatest(p["n_words"] - n, F.lit(0)), p["at"]),
                    lambda s: F.struct(p["n_words"].alias("n_words"), s.alias("start")),
                ),
            )
        )
    )
    windows = held.select("doc_id", "words", F.explode(starts).alias("s")).select(
        "doc_id",
        "s.n_words",
        F.greatest("s.start", F.lit(0)).alias("start"),
        F.slice("words", F.greatest("s.start", F.lit(0)) + 1, F.col("s.n_words") + F.least("s.start", F.lit(0))).alias("words"),
    )
    windows = windows.withColumn("hashes", shingles(F.col("words")))
    windows = windows.select("doc_id", "start", "n_words", "hashes", F.xxhash64("hashes", F.size("hashes")).alias("content"))
    windows = cut(windows.distinct(), "benchmark-windows")

    # 3. and 4. each distinct window once, however many documents hold it
    texts = windows.groupBy("n_words", "content").agg(F.first("hashes").alias("hashes"))
    texts = cut(texts, "benchmark-window-texts")
    w_prints = with_fingerprints(texts, ["n_words", "content"], "hashes")
    i_prints = with_fingerprints(items, ["item_id"], "hashes").join(
        items.select("item_id", F.size("words").alias("n_words")).distinct(), "item_id"
    )
    ball = F.array(*[F.lit(m) for m in _ball()])
    listed = i_prints.select("item_id", "n_words", "f1", "f2", F.explode(_blocks()).alias("b"))
    listed = listed.select("item_id", "n_words", "f1", "f2", "b.block", "b.value", F.explode(ball).alias("mask"))
    listed = listed.withColumn("value", F.col("value").bitwiseXOR(F.col("mask").cast("long"))).drop("mask")
    asked = w_prints.select("n_words", "content", "f1", "f2", F.explode(_blocks()).alias("b"))
    asked = asked.select("n_words", "content", "f1", "f2", "b.block", "b.value")
    # merge: Spark takes the exploded list for as small as the items and would broadcast it
    pairs = asked.alias("w").join(listed.hint("merge").alias("i"), ["n_words", "block", "value"])
    pairs = pairs.where(_distance() <= RADIUS).select("n_words", "content", "item_id").distinct()

    # 5. exact similarity of the candidates
    both = pairs.join(texts, ["n_words", "content"]).join(
        items.select("item_id", F.col("hashes").alias("item_hashes")), "item_id"
    )
    shared = F.size(F.array_intersect(numbered(F.col("hashes")), numbered(F.col("item_hashes"))))
    union = F.size("hashes") + F.size("item_hashes") - shared
    scored = both.withColumn("similarity", shared / union).where(F.col("similarity") >= similarity)
    found = windows.drop("hashes").join(scored.select("n_words", "content", "item_id", "similarity"), ["n_words", "content"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    out = found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.countDistinct("start").alias("n_windows"))
    return out.select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("first_word"), "n_windows"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item, with their columns.

    Each row is judged by its own text, rows without doc_id and rows that share one too.
    """
    keyed = docs.select(row_key().alias("doc_id"), "text")
    gone = contaminated(keyed, benchmark, similarity).select(F.col("doc_id").alias("gone_key")).distinct()
    return docs.join(gone, row_key() == gone["gone_key"], "left_anti")
