"""Byte-level BPE: overlapping chunks, stitched at pre-token boundaries, encoded piece by piece.

Texts up to ``CHUNK + OVERLAP`` code points are one piece and are encoded where they are read.
Longer ones are cut into chunks that overlap by ``OVERLAP``; chunks are pre-tokenised in parallel, and
two neighbours are stitched at a boundary that both lists hold inside the overlap: from a common
boundary on, the pattern sees the same text and gives the same matches. Only boundaries after a
visible character count, so that a piece that ends there splits as it does inside the whole text.
Where an overlap has no common boundary (a run of one class longer than the overlap), the rest of the
document from the last stitch on is one piece.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import blank, bound_batches, cut, map_batches, small_enough

CHUNK = 1 << 15
OVERLAP = 1 << 9
LONG_SPACE = regex.compile(r"\s{5000}")
PIECES = "doc_id long, piece int, n_pieces int, ids array<int>"


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read once on the driver; a vocabulary of fixed size travels with the tasks."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=4)
def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(bpe: tiktoken.Encoding, pattern: str, text: str) -> list[int]:
    """The ids of one text. The library's own splitter overflows on very long runs of white space."""
    if LONG_SPACE.search(text) is None:
        return bpe.encode_ordinary(text)
    return [i for match in regex.finditer(pattern, text) for i in bpe._encode_single_piece(match.group())]


@functools.lru_cache(maxsize=4)
def _decimals(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of the overlapping chunks; the last one is longer than the overlap."""
    starts = range(0, max(1, len(text) - overlap), chunk)
    return [(s, text[s : s + chunk + overlap]) for s in starts]


def boundaries(text: str, start: int, pattern: regex.Pattern, first: int, last: int) -> list[int]:
    """Ends of matches in (first, last) after a visible character, doubled; odd if no white space follows."""
    out = []
    for match in pattern.finditer(text):
        end = match.end()
        if first < start + end < last and end < len(text) and not text[end - 1].isspace():
            out.append(2 * (start + end) + (text[end] not in " \n"))
    return out


def _chunk_rows(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk of the long texts, with the boundaries in its two overlaps."""

    def deal(batches):
        for batch in batches:
            for doc, row, text in zip(*[c.to_pylist() for c in batch.columns]):
                parts = chunks(text, chunk, overlap)
                for k, (start, part) in enumerate(parts):
                    values = (doc, row, k, len(parts), start, part)
                    columns = zip(values, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()))
                    names = ["doc_id", "row", "k", "n", "start", "text"]
                    yield pa.record_batch([pa.array([v], t) for v, t in columns], names=names)

    def split(batch):
        compiled = regex.compile(pattern)
        heads, tails = [], []
        for k, n, start, text in zip(*[batch.column(c).to_pylist() for c in ("k", "n", "start", "text")]):
            found = boundaries(text, start, compiled, start, start + len(text))
            heads.append([b for b in found if k and b // 2 < start + overlap])
            tails.append([b for b in found if k < n - 1 and b // 2 > start + chunk])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
        yield pa.record_batch([*batch.columns, *lists], names=[*batch.schema.names, "head", "tail"])

    schema = "doc_id long, row long, k int, n int, start long, text string"
    bound_batches(docs.sparkSession)
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    dealt = numbered.mapInArrow(deal, schema).repartition("row", "k")
    return cut(map_batches(dealt, split, schema + ", head array<long>, tail array<long>"), "bpe-chunks")


def stitched(docs: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, row, piece, n_pieces, text): the long texts cut at stitched boundaries."""
    rows = _chunk_rows(docs, pattern, chunk, overlap)
    heads = rows.where("k > 0").select("row", F.col("k").alias("seam"), "head", F.lit(None).cast("array<long>").alias("tail"))
    tails = rows.where("k < n - 1").select("row", (F.col("k") + 1).alias("seam"), F.lit(None).cast("array<long>"), "tail")
    seams = heads.union(tails).groupBy("row", "seam").agg(F.first("head", True).alias("head"), F.first("tail", True).alias("tail"))
    common = F.array_intersect("head", "tail")
    before_space = F.array_min(F.filter(common, lambda b: b % 2 == 0))
    seams = seams.select("row", "seam", F.floor(F.coalesce(before_space, F.array_min(common)) / 2).alias("at"))
    plan = seams.groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("seam", "at")))).alias("cuts"),
        F.min(F.when(F.col("at").isNull(), F.col("seam"))).alias("open"),
        F.count("*").alias("seams"),
    )
    plan = cut(plan, "bpe-seams")
    size = plan.agg(F.coalesce(F.sum("seams"), F.lit(0))).first()[0]
    held = rows.drop("head", "tail").join(small_enough(plan.drop("seams"), size, 200), "row", "left")
    limit = F.least("n", F.coalesce("open", "n"))

    def edge(k):
        return F.when(k < limit, F.coalesce(F.col("cuts")[k], F.lit(0))).otherwise(k.cast("long") * chunk)

    end = F.when(F.col("k") + 1 < F.col("n"), edge(F.col("k") + 1)).otherwise(F.col("start") + F.length("text"))
    held = held.select("doc_id", "row", "k", "start", "text", limit.alias("n_pieces"), edge(F.col("k")).alias("a"), end.alias("b"))
    part = F.expr("substring(text, int(a - start) + 1, int(b - a))")
    parts = held.select("doc_id", "row", "n_pieces", F.least(F.col("k"), F.col("n_pieces") - 1).alias("piece"), "k", part.alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("doc_id", "row", "piece", "n_pieces").agg(whole.alias("text"))


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, piece, n_pieces, ids): the token ids of every text, in one or more pieces.

    Pieces of one document stand next to each other in order, in one partition. Null text is empty;
    an empty text is one piece without ids. Repeated rows and null ids are encoded like others. No
    special tokens: their strings are ordinary text. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text"))
    is_long = F.length("text") > chunk + overlap
    short = rows.where(~is_long).select("doc_id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "text")
    long = stitched(rows.where(is_long), pattern, chunk, overlap)

    def run(batch):
        bpe = encoder(ranks, pattern)
        ids = [encode_text(bpe, pattern, text) for text in batch.column("text").to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.fromiter((i for x in ids for i in x), np.int32, offsets[-1])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.record_batch([*[batch.column(n) for n in names], lists], names=[*names, "ids"])

    short = map_batches(short, run, PIECES)
    long = map_batches(long.select("row", "doc_id", "piece", "n_pieces", "text"), run, f"row long, {PIECES}")
    ordered = long.repartition("row").sortWithinPartitions("row", "piece")
    return short.unionByName(ordered.drop("row"))


def decode(pieces: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """The pieces with ``bytes``: their tokens' raw bytes concatenated. A token may end inside a character."""

    def run(batch):
        bpe = encoder(ranks, pattern)
        raw = [bpe.decode_bytes(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "bytes"])

    return map_batches(pieces, run, f"{PIECES}, bytes binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Digest:
    """Token count and running digests of one document."""

    def __init__(self):
        self.count, self.text, self.raw = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int], data: bytes, decimal: list[str]) -> None:
        if ids:
            self.text.update(((" " if self.count else "") + " ".join(map(decimal.__getitem__, ids))).encode())
        self.raw.update(data)
        self.count += len(ids)

    def row(self, doc) -> tuple:
        return doc, self.count, self.text.hexdigest(), self.raw.hexdigest()


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)


def digests(decoded: DataFrame, vocabulary: int) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document, from pieces in ``encode``'s order."""

    def run(batches):
        decimal, own = _decimals(vocabulary), _Digest()
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "piece", "n_pieces", "ids", "bytes")]
            for doc, piece, pieces, ids, data in zip(*columns):
                own.add(ids, data, decimal)
                if piece == pieces - 1:
                    out.append(own.row(doc))
                    own = _Digest()
            if out:
                yield _digest_batch(out)

    bound_batches(decoded.sparkSession)
    return decoded.mapInArrow(run, DIGESTS)


def document_digests(
    docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``digests(decode(encode(docs)))``, with one Python pass over the texts of one piece.

    Such a text is encoded, decoded and digested by the same worker, so its ids never leave it.
    """
    vocabulary = len(ranks.splitlines())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text"))
    is_long = F.length("text") > chunk + overlap

    def run(batch):
        bpe, decimal, out = encoder(ranks, pattern), _decimals(vocabulary), []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own, ids = _Digest(), encode_text(bpe, pattern, text)
            own.add(ids, bpe.decode_bytes(ids), decimal)
            out.append(own.row(doc))
        yield _digest_batch(out)

    short = map_batches(rows.where(~is_long), run, DIGESTS)
    long = decode(encode(rows.where(is_long), ranks, pattern, chunk, overlap), ranks, pattern)
    return short.unionByName(digests(long, vocabulary))
