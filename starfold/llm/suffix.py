"""Removal of byte strings that occur more than once, by externally sorted suffixes.

Sharding. Each window (string of ``LENGTH`` bytes) is assigned to an anchor: the ``GRAM``-byte string in it
with the smallest hash. Equal windows have equal anchors at equal offsets, so the anchor's hash is a
shard key: every window meets all its equals there, whatever the document. Consecutive windows with
one anchor form a piece; pieces are numbers until their text is needed.

Sorting. Equal pieces of one key are merged with their count. A piece alone under its key is sorted as
it stands: its windows repeat if it was met twice. All other pieces are read once and dealt by key;
a task sorts the suffixes of block after block of whole keys by induced sorting (``induced.py``),
and a window repeats if the common prefix with a neighbour in suffix order reaches ``LENGTH``, or
if its piece was met twice.

A key with more than ``MOST_PIECES`` different pieces (a short phrase with another surrounding in every
document) is split: its windows are dealt anew by the anchor's offset and the longer string that all
windows of such offsets share. At the finest step that string is the window itself, so equal pieces merge.
No task ever sorts an unbounded key, and no window is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import BROADCAST_BYTES, blank, bound_batches, cut, map_batches, small_enough
from starfold.llm.induced import Block

LENGTH = 200
GRAM = 64
MOST_PIECES = 256
FAN_OUT = 4
CHUNK = 1 << 20
BLOCK_BYTES = 1 << 20
SEED = 5

_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    bits %= 64
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits)) if bits else x


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit rolling hash of the ``width`` bytes from each position, by doubling."""
    power, size, out, done = _MIX[data], 1, None, 0
    while True:
        if width & size:
            out = power if out is None else _turned(out[: len(power) - done], size) ^ power[done:]
            done += size
        if size * 2 > width:
            break
        power = _turned(power[:-size], size) ^ power[size:]
        size *= 2
    x = out[: len(data) - width + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pieces_of(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """(start, count, anchor, key) arrays: runs of ``count`` windows from ``start`` with one anchor."""
    out = []
    for base in range(0, len(raw) - length + 1, CHUNK):
        data = np.frombuffer(raw, np.uint8, min(CHUNK + length - 1, len(raw) - base), base)
        hashes = gram_hashes(data, gram)
        position_bits = np.uint64((CHUNK << 1) - 1)
        low = (hashes & ~position_bits) | np.arange(len(hashes), dtype=np.uint64)
        width, size = length - gram + 1, 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if width > size:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        at = (low & position_bits).astype(np.int64)
        start = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        count = np.diff(start, append=len(at))
        out.append((start + base, count, at[start] + base, hashes[at[start]].view(np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, row, doc_id, text): d and row name the text; rows equal in id and text share the name."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), blank("text").alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def repeated_keys(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The keys met by two or more pieces."""

    def run(batch):
        parts = [pieces_of(t.encode(), length, gram)[3] for t in batch.column(0).to_pylist()]
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])

    seen = map_batches(rows.select("text"), run, "key long, n long")
    return cut(seen.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "suffix-keys")


PLACE = "d long, row long, start int, count int, offset int, key long, hash long"


def places(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Every piece: where it starts, its windows, its first window's distance to the anchor, its content hash."""

    def run(batch):
        columns = [[] for _ in range(7)]
        for d, row, text in zip(*[batch.column(c).to_pylist() for c in ("d", "row", "text")]):
            raw = text.encode()
            start, count, anchor, key = pieces_of(raw, length, gram)
            spans = zip(start.tolist(), (start + count + length - 1).tolist())
            hashes = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in spans], np.uint64).view(np.int64)
            made = (np.full(len(start), d), np.full(len(start), row), start, count, anchor - start, key, hashes)
            for held, values in zip(columns, made):
                held.append(values)
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
        arrays = [pa.array(np.concatenate(x).astype(k)) for x, k in zip(columns, kinds)]
        yield pa.record_batch(arrays, names=[c.split()[0] for c in PLACE.split(", ")])

    return map_batches(rows.select("d", "row", "text"), run, PLACE)


def _with_text(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, hash, offset, count, n, raw): the text of each wanted piece, read at one of its places."""
    by_text = wanted.groupBy("at.d", "at.row").agg(
        F.collect_list(F.struct("key", "hash", "offset", "count", "n", F.col("at.start").alias("start"))).alias("list")
    )
    by_text = cut(by_text, "suffix-readings")
    names = by_text.select("d", "row")
    held = rows.select("d", "row", "text").join(small_enough(names, names.count(), 96), ["d", "row"], "left_semi")
    held = held.dropDuplicates(["d", "row"]).join(by_text, ["d", "row"])

    def run(batch):
        for text, pieces in zip(batch.column("text").to_pylist(), batch.column("list").to_pylist()):
            raw = text.encode()
            parts = [raw[p["start"] : p["start"] + p["count"] + length - 1] for p in pieces]
            columns = [pa.array([p[c] for p in pieces], t) for c, t in _PIECE_TYPES]
            yield pa.record_batch([*columns, pa.array(parts, pa.binary())], names=[*[c for c, _ in _PIECE_TYPES], "raw"])

    return map_batches(held.select("text", "list"), run, "key long, hash long, offset int, count int, n long, raw binary")


_PIECE_TYPES = [("key", pa.int64()), ("hash", pa.int64()), ("offset", pa.int32()), ("count", pa.int32()), ("n", pa.int64())]
FOUND = "key long, hash long, runs array<struct<a:int,b:int>>"


def _runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": a, "b": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def sorted_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """(key, hash, runs) of the pieces with repeated windows, by sorting the suffixes of each key."""

    def solve(held):
        block = Block([raw for *_, raw in held], length)
        flags, at, out = block.repeated(), 0, []
        for key, digest, count, n, raw in held:
            windows = flags[at : at + count] | (n > 1)
            at += len(raw) + 1
            if windows.any():
                out.append((key, digest, _runs(windows)))
        run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        columns = list(zip(*out)) or [[], [], []]
        arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), run_type))]
        return pa.record_batch(arrays, names=["key", "hash", "runs"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in zip(*[batch.column(c).to_pylist() for c in ("key", "hash", "count", "n", "raw")]):
                if size >= BLOCK_BYTES and piece[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(piece)
                size += len(piece[-1])
        if held:
            yield solve(held)

    bound_batches(pieces.sparkSession)
    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def _split(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """Parts of pieces for the anchor offsets of one range of ``width``, keyed by what these windows share.

    A window at distance r from its anchor covers r bytes before it; windows with r in [low, high]
    share the bytes from low before the anchor to length - high after it.
    """

    def run(batch):
        out = []
        for key, digest, offset, count, n, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "hash", "offset", "count", "n", "raw")]):
            first = offset - count + 1
            for band in range(first // width, offset // width + 1):
                low, high = band * width, band * width + width - 1
                a, b = offset - min(offset, high), offset - max(first, low) + 1
                part = raw[a : b + length - 1]
                shared = raw[offset - low : offset - high + length]
                name = xxhash.xxh3_64(shared, seed=band + 1)
                name.update(key.to_bytes(8, "big", signed=True))
                names = [x - (1 << 64) if x >> 63 else x for x in (name.intdigest(), xxhash.xxh3_64_intdigest(part))]
                out.append((key, digest, a, *names, offset - a, b - a, n, part))
        columns = list(zip(*out)) or [[]] * 9
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        arrays = [pa.array(list(x), t) for x, t in zip(columns, kinds)]
        yield pa.record_batch(arrays, names=["own_key", "own_hash", "shift", "key", "hash", "offset", "count", "n", "raw"])

    schema = "own_key long, own_hash long, shift int, key long, hash long, offset int, count int, n long, raw binary"
    return map_batches(pieces.select("key", "hash", "offset", "count", "n", "raw"), run, schema)


def repeated_windows(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """(key, hash, runs): windows that repeat in pieces with text; a key may have any number of pieces."""
    pieces = cut(pieces, "suffix-pieces")
    sizes = pieces.groupBy("key").agg(F.count("*").alias("different"), F.sum("n").alias("met"))
    sizes = cut(sizes, "suffix-sizes")
    hot = sizes.where(F.col("different") > MOST_PIECES).select("key")
    n_hot = hot.count()
    if not n_hot:
        return sorted_repeats(pieces, length)
    few = sorted_repeats(pieces.join(small_enough(hot, n_hot, 64), "key", "left_anti"), length)
    many = pieces.join(small_enough(hot, n_hot, 64), "key", "left_semi")
    if width == 1:
        # the key is the window itself: whatever differs under it differs by a hash collision only
        whole = F.array(F.struct(F.lit(0).alias("a"), F.col("count").alias("b")))
        return few.unionByName(many.where("n > 1").select("key", "hash", whole.alias("runs")))
    parts = cut(_split(many, length, max(1, width // FAN_OUT)), "suffix-parts")
    merged = parts.groupBy("key", "hash", "offset", "count").agg(F.sum("n").alias("n"), F.max("raw").alias("raw"))
    below = repeated_windows(merged, length, max(1, width // FAN_OUT))
    found = parts.select("own_key", "own_hash", "shift", "key", "hash").join(below, ["key", "hash"])
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
    found = found.select(F.col("own_key").alias("key"), F.col("own_hash").alias("hash"), moved.alias("runs"))
    return few.unionByName(found.groupBy("key", "hash").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def spans_of(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Bytes covered by the windows that start in the runs, as maximal spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length - 1))
        else:
            out.append((a, b + length - 1))
    return out


REMOVED = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): one row per document without its repeated bytes.

    A byte goes if a ``length``-byte string that covers it also starts anywhere else, in the same
    document or another one, overlaps included; strings are judged on the input. ``spans`` are the
    maximal removed runs, ``kept`` the remaining bytes (which may cut a character). Null text is
    empty; texts shorter than ``length`` stay whole. Repeated rows are documents of their own, so
    their strings repeat; null ids are handled like others. Other columns are ignored.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must lie between 1 and length")
    rows = _keyed(docs)
    keys = repeated_keys(rows, length, gram)
    met = places(rows, length, gram).join(small_enough(keys, keys.count(), 64), "key", "left_semi")
    met = cut(met, "suffix-places")
    contents = met.groupBy("key", "hash", "offset", "count").agg(
        F.count("*").alias("n"), F.min(F.struct("d", "row", "start")).alias("at")
    )
    contents = cut(contents, "suffix-contents")
    # written, so that a key with very many pieces can be split in the join
    rivals = cut(contents.groupBy("key").agg(F.count("*").alias("different")), "suffix-rivals")
    classed = contents.join(rivals, "key")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("count").alias("b")))
    alone = classed.where("different = 1 and n > 1").select("key", "hash", whole.alias("runs"))
    pieces = _with_text(rows, classed.where("different > 1"), length)
    found = alone.unionByName(repeated_windows(pieces, length, length - gram + 1))

    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    marks = met.join(found, ["key", "hash"]).select("d", "row", "start", moved.alias("runs")).groupBy("d", "row")
    marks = cut(marks.agg(F.flatten(F.collect_set("runs")).alias("runs")), "suffix-marks")
    names = marks.select("d", "row")
    touched = names.count()

    def run(batch):
        out = []
        for doc, text, runs in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")]):
            raw = text.encode()
            spans = spans_of([(r["a"], r["b"]) for r in runs or ()], length)
            edges = [0, *[e for s in spans for e in s], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((doc, len(raw), [{"start": a, "end": b} for a, b in spans], kept))
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), span_type, pa.binary())
        arrays = [pa.array(x, t) for x, t in zip(zip(*out), kinds)]
        yield pa.record_batch(arrays, names=["doc_id", "n_bytes", "spans", "kept"])

    columns = ["doc_id", "text", "runs"]
    if touched * 96 > BROADCAST_BYTES:
        return map_batches(rows.join(marks, ["d", "row"], "left").select(columns), run, REMOVED)
    # few enough names to tell, without a shuffle, which texts stay as they are
    clean = rows.join(F.broadcast(names), ["d", "row"], "left_anti")
    clean = clean.withColumn("runs", F.lit(None).cast(marks.schema["runs"].dataType)).select(columns)
    marked = rows.join(F.broadcast(names), ["d", "row"], "left_semi").join(marks, ["d", "row"])
    return map_batches(clean, run, REMOVED).unionByName(map_batches(marked.select(columns), run, REMOVED))
