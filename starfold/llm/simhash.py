"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of the perfect Hamming code of length 63: its covering radius is 1, so
every point has a code word within distance 1. Two fingerprints at distance 2 or less have a
midpoint within distance 1 of both; the code word nearest to the midpoint is then within
``1 + 1 = 2`` of both (covering radius plus half the threshold, the least radius that loses no
pair). Each distinct fingerprint is therefore copied to its 32 code words within distance 2 (one if
it is a code word itself), and fingerprints are compared per code word, all 64 bits of them. A
group holds at most 2 * (1 + 63 + 1953) distinct fingerprints, whatever the corpus, because equal
ones are merged first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import blank, components, cut, map_batches, row_key

MAX_BITS = 2
SHINGLE_WORDS = 3
HASH_SEED = 42
LENGTH = 63
SLICE = 1 << 16


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text, unsigned; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    tails = ends[min(shingle_words, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        spans = zip(starts[i : min(i + SLICE, n)].tolist(), tails[i : i + SLICE].tolist())
        raw = b"".join([digest(joined[a:b], HASH_SEED) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp): one row per document, the fingerprint as a signed long. Null text: empty."""

    def run(batch):
        values = [fingerprint(t, shingle_words) for t in batch.column(2).to_pylist()]
        fp = np.array(values, np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), blank("text").alias("text"))
    return map_batches(rows, run, "doc_id long, key long, fp long")


def anchors(fp: DataFrame) -> DataFrame:
    """(anchor, fp): every code word within distance 2 of the low 63 bits of ``fp``."""
    low = F.col("fp").bitwiseAND(F.lit((1 << LENGTH) - 1))
    masks = [sum(1 << (p - 1) for p in range(1, LENGTH + 1) if p >> i & 1) for i in range(6)]
    parities = [F.shiftleft(F.bit_count(low.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), i) for i, m in enumerate(masks)]
    syndrome = reduce(lambda a, b: a.bitwiseOR(b), parities)
    # Flipping positions p and q reaches a code word if p xor q is the syndrome; position 0 stands for no flip.
    flips = fp.select("fp", syndrome.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(LENGTH))).alias("p"))
    flips = flips.select("fp", "p", F.col("p").bitwiseXOR(F.col("s")).alias("q")).where("p < q or p = 0")
    anchor = low.bitwiseXOR(_bit("p")).bitwiseXOR(_bit("q"))
    return flips.select(anchor.alias("anchor"), "fp")


def _bit(position: str) -> Column:
    return F.shiftrightunsigned(F.expr(f"shiftleft(1L, {position})"), 1)


def links(fp: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect all fingerprints at ``max_bits`` or fewer.

    Inside a group each connected part is returned as a star around its smallest member, so a group
    of n fingerprints gives at most n - 1 pairs and no connection is lost.
    """
    if max_bits > 2:
        raise ValueError("the code words within distance 2 cover pairs of at most 2 differing bits")
    groups = anchors(fp).groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    groups = groups.where(F.size("fps") > 1).select(F.sort_array("fps").alias("fps"))

    def run(batch):
        left, right = [], []
        for fps in batch.column(0).to_pylist():
            for a, b in _stars(np.array(fps, np.int64), max_bits):
                left.append(a)
                right.append(b)
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return map_batches(groups, run, "a long, b long").distinct()


def _stars(fps: np.ndarray, max_bits: int):
    """Pairs (member, smallest) for each connected part of one group."""
    bits = fps.view(np.uint64)
    waiting = np.ones(len(fps), bool)
    for first in range(len(fps)):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue:
            near = np.flatnonzero(waiting & (np.bitwise_count(bits ^ bits[queue.pop()]) <= max_bits))
            waiting[near] = False
            queue.extend(near.tolist())
            for i in near.tolist():
                yield int(fps[i]), int(fps[first])


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fp, component_id): the group of each document under links of ``max_bits`` bits.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the document included.
    Documents without words share fingerprint 0 and are linked like any others. One row per input
    row; rows of one ``doc_id`` with different texts keep their own fingerprints. A row without
    ``doc_id`` takes part under its fingerprint, and its component_id is null only if no row of the
    component has an id. Other columns are ignored; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, shingle_words), "fingerprints")
    labels = _least(prints, F.col("doc_id"), max_bits)
    return prints.join(labels, "fp", "left").select("doc_id", "fp", F.col("least").alias("component_id"))


def _least(prints: DataFrame, value: Column, max_bits: int) -> DataFrame:
    """(fp, least): the least value of any row in the component of each fingerprint."""
    classes = cut(prints.groupBy("fp").agg(F.min(value).alias("first")), "fingerprint_classes")
    parts = components(links(classes.select("fp"), max_bits)).select(F.col("id").alias("fp"), "root")
    named = classes.join(parts, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("least"))
    return cut(named.join(smallest, "root", "left").select("fp", "least"), "fingerprint_labels")


def keep_first(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Pipeline stage: one document of each group, that of the smallest id, with its columns.

    Rows are judged one by one: of an id with several texts each counts for itself, and a row without
    ``doc_id`` stays only if no row of its group has one. Rows equal in id and text are one document.
    """
    prints = cut(fingerprints(docs, shingle_words), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    judged = prints.join(_least(prints, place, max_bits), "fp")
    gone = judged.where(F.col("key") != F.col("least.key")).select(F.col("key").alias("gone_key")).distinct()
    return docs.join(gone, row_key() == gone["gone_key"], "left_anti")
