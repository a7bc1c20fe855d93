"""Line dedup with a sharded minimal perfect hash.

Each line key is a 128-bit hash (two longs). Keys held by two or more documents are dealt to shards;
a shard becomes one row of arrays: a minimal perfect hash (levels of bits, a key sits on the first
level where no other key shares its bit) that numbers its keys 0..n-1, and by that number the
fingerprint, the number of documents and the smallest document. Documents send (key, doc_id) probes
to the shard and get back the keys they must drop; no line text is shuffled or joined. Keys held by
one document need no place in the arrays: their probes fail the fingerprint.

A key with more than 1/4096 of all probes would overload its shard. There are fewer than 4096 such
keys whatever the corpus, so they get arrays of their own that travel with the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import blank, bound_batches, cut, map_batches

MIN_POINTS = 10
SHARD_KEYS = 1 << 16
LEAST_SHARDS = 1024
HOT_SHARE = 4096
SPREAD = 2.0
ARRAYS = "n long, sizes array<int>, bits binary, fingerprints binary, counts binary, firsts binary"


def line_keys(text: str, min_points: int = MIN_POINTS) -> list[bytes | None]:
    """A 16-byte key for each line; None for a line whose stripped text is too short."""
    out = []
    for line in text.encode().lower().split(b"\n"):
        key = line.strip()
        long_enough = len(key) >= 4 * min_points or len(key) >= min_points and len(key.decode()) >= min_points
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(2 * level + 1)) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Arrays:
    """The minimal perfect hash of one shard and the arrays it indexes."""

    def __init__(self, sizes, bits, fingerprints, counts, firsts):
        self.sizes = [int(s) for s in sizes]
        self.bits = bits
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
        self.fingerprints, self.counts, self.firsts = fingerprints, counts, firsts

    @classmethod
    def build(cls, h1, h2, counts, firsts) -> Arrays:
        """From distinct keys; ``h1`` and ``h2`` are unsigned."""
        left = np.arange(len(h1))
        sizes, levels = [], []
        while len(left):
            size = max(64, int(SPREAD * len(left)) + 7 & ~7)
            at = (_mix(h1[left], h2[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        none = np.zeros(0, np.uint64)
        made = cls(sizes, bits, none, none, none)
        slots = made._slots(h1, h2)
        order = np.argsort(slots)
        made.fingerprints, made.counts, made.firsts = h2[order], counts[order], firsts[order]
        return made

    def _slots(self, h1, h2) -> np.ndarray:
        """The number of each key, -1 where no level has its bit."""
        slots = np.full(len(h1), -1, np.int64)
        left, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base * 8 + (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (7 - (at & 7)).astype(np.uint8)
            hit = (self.bits[byte] >> bit & 1).astype(bool)
            before = np.bitwise_count(self.bits[byte[hit]] >> (bit[hit] + 1).astype(np.uint16))
            slots[left[hit]] = self.rank[byte[hit]] + before
            left = left[~hit]
            base += size // 8
        return slots

    def first_of(self, h1, h2) -> tuple[np.ndarray, np.ndarray]:
        """(known, first): whether each probe is a key, and then its smallest document."""
        slots = self._slots(h1, h2)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == h2[known]
        first = np.zeros(len(h1), np.int64)
        first[known] = self.firsts[slots[known]]
        return known, first

    def row(self) -> tuple:
        parts = (self.bits, self.fingerprints, self.counts.astype(np.int64), self.firsts)
        return len(self.firsts), self.sizes, *[p.tobytes() for p in parts]

    @classmethod
    def of_row(cls, sizes, bits, fingerprints, counts, firsts) -> Arrays:
        return cls(
            sizes,
            np.frombuffer(bits, np.uint8),
            np.frombuffer(fingerprints, np.uint64),
            np.frombuffer(counts, np.int64),
            np.frombuffer(firsts, np.int64),
        )


def document_keys(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(h1, h2, doc_id): the distinct keys of each document. Rows without doc_id are left out."""

    def run(batch):
        ids, parts = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = {k for k in line_keys(text, min_points) if k}
            parts.extend(keys)
            ids.extend([doc] * len(keys))
        both = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
        columns = [pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)]
        yield pa.record_batch([*columns, pa.array(ids, pa.int64())], names=["h1", "h2", "doc_id"])

    rows = docs.where("doc_id is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text"))
    return map_batches(rows, run, "h1 long, h2 long, doc_id long")


def shard_arrays(keys: DataFrame) -> DataFrame:
    """One row of arrays per shard from (shard, h1, h2, n, first_doc)."""

    def build(part: pa.Table) -> pa.Table:
        h1, h2, counts, firsts = (part.column(c).to_numpy() for c in ("h1", "h2", "n", "first_doc"))
        row = Arrays.build(h1.view(np.uint64), h2.view(np.uint64), counts, firsts).row()
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        columns = [part.column("shard").slice(0, 1), *[pa.array([v], t) for v, t in zip(row, kinds)]]
        return pa.table(columns, names=["shard", *[c.split()[0] for c in ARRAYS.split(", ")]])

    return keys.groupBy("shard").applyInArrow(build, f"shard int, {ARRAYS}")


def _probe(batches):
    """Rows come sorted by shard, a shard's arrays before its probes."""
    arrays = None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        loads = np.flatnonzero(kind == 0)
        edges = np.unique(np.concatenate(([0], loads, [batch.num_rows])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if kind[a] == 0:
                names = ("sizes", "bits", "fingerprints", "counts", "firsts")
                arrays = Arrays.of_row(*[batch.column(n)[a].as_py() for n in names])
                shard = batch.column("shard")[a].as_py()
                a += 1
            if a == b or arrays is None:
                continue
            part = batch.slice(a, b - a)
            h1, h2 = (part.column(c).to_numpy() for c in ("h1", "h2"))
            doc = part.column("doc_id").to_numpy()
            known, first = arrays.first_of(h1.view(np.uint64), h2.view(np.uint64))
            gone = known & (first != doc) & (part.column("shard").to_numpy() == shard)
            if gone.any():
                yield pa.record_batch([pa.array(doc[gone]), pa.array(h1[gone])], names=["doc_id", "h1"])


def dedup_lines(docs: DataFrame, min_points: int = MIN_POINTS, counts: bool = True) -> DataFrame:
    """The documents with repeated lines dropped, plus ``n_lines`` (before) and ``n_dropped``.

    Without ``counts`` the result has the input's columns only.

    A line's key is its text stripped of ASCII white space at both ends, A-Z lower-cased. Keys of
    ``min_points`` code points or more that occur in two or more documents keep their lines only in
    the smallest ``doc_id`` holding them; all other lines stay, joined by line feeds. Null or empty
    text is one empty line and comes back as empty text. Rows of one doc_id count as one document.
    Rows without doc_id lose nothing and make no other row lose anything. Other columns, whatever
    their names, are handed on; ``n_lines`` and ``n_dropped`` of the input are replaced.
    """
    spark = docs.sparkSession
    probes = cut(document_keys(docs, min_points), "line-keys")
    total = probes.count()
    held = probes.groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
    held = cut(held.where("first_doc < last_doc").drop("last_doc"), "line-counts")
    is_hot = F.col("n") > F.lit(total / HOT_SHARE)
    hot_rows = held.where(is_hot).collect()
    hot = Arrays.build(
        np.array([r.h1 for r in hot_rows], np.int64).view(np.uint64),
        np.array([r.h2 for r in hot_rows], np.int64).view(np.uint64),
        np.array([r.n for r in hot_rows], np.int64),
        np.array([r.first_doc for r in hot_rows], np.int64),
    ).row()[1:]

    cold = held.where(~is_hot)
    shards = max(LEAST_SHARDS, -(-cold.count() // SHARD_KEYS))
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    arrays = shard_arrays(cold.select(shard, "h1", "h2", "n", "first_doc"))
    hot_keys = [(r.h1, r.h2) for r in hot_rows]
    asked = probes.select(shard, F.lit(1).alias("kind"), "h1", "h2", "doc_id")
    if hot_keys:
        known = F.broadcast(spark.createDataFrame(hot_keys, "h1 long, h2 long"))
        asked = asked.join(known, ["h1", "h2"], "left_anti")
    both = arrays.drop("n").withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    bound_batches(spark)
    routed = both.repartition("shard").sortWithinPartitions("shard", "kind")
    gone = routed.mapInArrow(_probe, "doc_id long, h1 long").groupBy("doc_id")
    gone = gone.agg(F.collect_list("h1").alias("gone")).withColumnRenamed("doc_id", "gone_id")

    added = ("n_lines", "n_dropped") if counts else ()
    wanted = [c for c in docs.columns if c not in added]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in wanted if c != "text"]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        blank("text").alias("text"),
    ).join(gone, F.col("id") == F.col("gone_id"), "left")

    def rebuild(batch):
        arrays = Arrays.of_row(*hot)
        texts, lines, dropped = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("id", "text", "gone")]
        for doc, text, lost in zip(*columns):
            keys = line_keys(text, min_points) if doc is not None and (lost or len(arrays.firsts)) else []
            out = _lines_out(keys, set(lost or ()), arrays, doc)
            whole = text.split("\n")
            texts.append("\n".join(x for i, x in enumerate(whole) if i not in out) if out else text)
            lines.append(len(whole))
            dropped.append(len(out))
        made = [batch.column("row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        yield pa.record_batch(made, names=["row", "text", "n_lines", "n_dropped"])

    schema = rows.select("row", "text").schema.add("n_lines", "long").add("n_dropped", "long")
    kept = map_batches(rows.select("row", "id", "text", "gone"), rebuild, schema)
    back = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in wanted]
    return kept.select(*back, *added)


def _lines_out(keys: list, lost: set, hot: Arrays, doc: int) -> set[int]:
    """Indices of the lines that go."""
    at = [i for i, k in enumerate(keys) if k]
    if not at:
        return set()
    both = np.frombuffer(b"".join(keys[i] for i in at), np.int64).reshape(-1, 2)
    h1, h2 = (np.ascontiguousarray(both[:, i]) for i in (0, 1))
    known, first = hot.first_of(h1.view(np.uint64), h2.view(np.uint64))
    gone = known & (first != doc)
    return {i for i, h, g in zip(at, h1.tolist(), gone.tolist()) if g or h in lost}
