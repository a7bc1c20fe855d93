"""Embedding near-duplicates with a pivot-permutation index.

Reference points (pivots) are a cover of a bounded sample of the vectors, taken by smallest hash: about
sqrt(n), at most ``MAX_PIVOTS``, none within cosine ``COVER`` of another, so that a dense cluster gets
few of them whatever its share of the rows. Every vector is described by the ids of its ``NEAREST``
nearest pivots in order; the nearest one is its home. Two vectors are candidates if they have the same
home or their descriptions share ``SHARED`` pivots or more; as that is at least two, the inverted lists
are kept per pair of pivots, which are short where lists of single pivots would be long. A pair of one
home is counted in the list of that home; another pair that meets in several lists is counted in the
list of its two smallest shared pivots only. Candidates are verified by their cosine.

Lists longer than ``BLOCK`` are split: every pair of blocks is a cell of its own, so no task gets an
unbounded list and no candidate is lost. In the list of a pair of pivots a home with more than ``BLOCK``
vectors has blocks of its own, which are not compared with each other. A cell returns sums and a
spanning star of its links, never its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import bound_batches, components, cut, map_batches, small_enough

SIMILARITY = 0.9
MAX_PIVOTS = 4096
LEAST_PIVOTS = 64
COVER = 0.75
CANDIDATES = 4
NEAREST = 8
SHARED = 2
BLOCK = 256
ONE_HOME = -NEAREST - 1
CELL = ["dim", "p", "q", "a", "b"]


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column as doubles."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    return np.split(flat, offsets[1:-1] - offsets[0])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest entry first, so that squares stay in range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def distinct_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): vec_id with a 128-bit hash of its vector, and one row per usable vector.

    A class goes by ``rep``, the first half of its hash; ``first_id`` is its smallest vec_id.
    """
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").distinct()
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    hashes = [F.when(usable, F.xxhash64("embedding", F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    x = x.select("vec_id", "embedding", *hashes)
    classes = x.where("h0 is not null").groupBy("h0", "h1")
    classes = classes.agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("vector"))
    return x.drop("embedding"), cut(classes.withColumn("rep", F.col("h0")), "vector-classes")


def cover(vectors: np.ndarray, count: int, within: float = COVER) -> np.ndarray:
    """At most ``count`` of the unit vectors, in their order, none within that cosine of another."""
    nearest, kept = np.full(len(vectors), -2.0), []
    for i in range(len(vectors)):
        if nearest[i] < within:
            kept.append(i)
            nearest = np.maximum(nearest, vectors @ vectors[i])
            if len(kept) == count:
                break
    return vectors[kept]


def pivot_sample(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit pivots by dimension: a cover of the ``CANDIDATES * count`` vectors with the smallest hash."""
    rows = classes.orderBy("h0", "h1").limit(CANDIDATES * count).select("vector").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.vector), []).append(r.vector)
    return {d: cover(_unit(np.array(v, float)), count) for d, v in by_dim.items()}


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray | None, nearest: int = NEAREST) -> np.ndarray:
    """The ids of the nearest pivots of each vector, nearest first; -1, -2, ... where pivots run out."""
    ids = np.repeat(-np.arange(1, nearest + 1)[None], len(vectors), axis=0)
    if pivots is not None:
        k = min(nearest, len(pivots))
        ids[:, :k] = np.argsort(-(_unit(vectors) @ pivots.T), axis=1, kind="stable")[:, :k]
    return ids


def permutations(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(rep, copies, vector, dim, ids): every vector with its ordered nearest pivots."""

    def run(batch):
        vectors = _rows(batch.column("vector"))
        sizes = np.array([len(v) for v in vectors])
        ids = np.zeros((len(vectors), NEAREST), np.int32)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            ids[at] = nearest_pivots(np.stack([vectors[i] for i in at]), pivots.get(dim))
        made = [pa.array(sizes, pa.int32()), pa.array(ids.tolist(), pa.list_(pa.int32()))]
        names = ["rep", "copies", "vector"]
        yield pa.record_batch([*[batch.column(n) for n in names], *made], names=[*names, "dim", "ids"])

    kind = classes.schema["vector"].dataType.simpleString()
    return map_batches(classes, run, f"rep long, copies long, vector {kind}, dim int, ids array<int>")


def _home_cells(described: DataFrame) -> DataFrame:
    """Every vector once for each cell of the list of its home; ``q`` is ``ONE_HOME`` there."""
    placed = described.withColumn("p", F.col("ids")[0])
    lengths = placed.groupBy("dim", "p").count().where("count > 1")
    lengths = cut(lengths.select("dim", "p", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "home-lengths")
    placed = placed.join(small_enough(lengths, lengths.count(), 120), ["dim", "p"])
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).alias("own")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    return _dealt(placed.select("*", F.lit(ONE_HOME).alias("q"), own, other))


def _pair_cells(described: DataFrame) -> DataFrame:
    """Every vector once for each list of a pair of pivots, and there once for each cell with another home."""
    pairs = F.array(
        *[
            F.struct(F.least(F.col("ids")[i], F.col("ids")[j]).alias("p"), F.greatest(F.col("ids")[i], F.col("ids")[j]).alias("q"))
            for i, j in combinations(range(NEAREST), 2)
        ]
    )
    home = F.col("ids")[0].alias("home")
    lists = described.select("dim", home, F.explode(pairs).alias("l")).select("dim", "home", "l.p", "l.q")
    sizes = lists.groupBy("dim", "p", "q", "home").count()
    # A part is one home with more than BLOCK vectors, or (null) all the others of the list.
    parts = sizes.withColumn("part", F.when(F.col("count") > BLOCK, F.col("home"))).groupBy("dim", "p", "q", "part")
    parts = parts.agg(F.sum("count").alias("size"), F.count("*").alias("homes"))
    parts = parts.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    lengths = parts.groupBy("dim", "p", "q").agg(F.sum("homes").alias("homes"), F.collect_list(F.struct("part", "blocks")).alias("parts"))
    lengths = cut(lengths.where("homes > 1").drop("homes"), "list-lengths")
    placed = described.select("*", home, F.explode(pairs).alias("l")).select("*", "l.p", "l.q").drop("l")
    placed = placed.join(small_enough(lengths, lengths.count(), 240), ["dim", "p", "q"])
    mine = F.filter("parts", lambda x: x["part"] == F.col("home"))
    mine = F.when(F.size(mine) > 0, mine[0]).otherwise(F.filter("parts", lambda x: x["part"].isNull())[0])
    placed = placed.withColumn("mine", mine)

    def block(part, number):
        return F.coalesce(part, F.lit(ONE_HOME)).cast("long") * (1 << 32) + number

    own = block(F.col("mine.part"), F.pmod(F.xxhash64("rep", F.lit(7)), F.col("mine.blocks"))).alias("own")
    across = F.filter("parts", lambda x: x["part"].isNull() | ~x["part"].eqNullSafe(F.col("mine.part")))
    numbers = F.transform(
        across, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"] - 1), lambda n: block(x["part"], n))
    )
    return _dealt(placed.select("*", own, F.explode(F.flatten(numbers)).alias("other")))


def _dealt(placed: DataFrame) -> DataFrame:
    return placed.select(
        "dim", "p", "q", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "copies", "vector", "ids"
    )


def _cells(described: DataFrame) -> DataFrame:
    """Every vector once for each cell in which it is compared."""
    return _home_cells(described).unionByName(_pair_cells(described))


def _groups(batches, keys: list[str]):
    """Runs of equal keys in sorted input, each as one batch."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        table = part if rest is None else pa.concat_tables([rest, part])
        columns = np.column_stack([table.column(k).to_numpy() for k in keys])
        edges = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
        edges = [0, *edges.tolist()]
        for a, b in zip(edges[:-1], edges[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def verify(vectors, ids, own, p: int, q: int, across: bool, similarity: float = SIMILARITY, shared: int = SHARED) -> np.ndarray:
    """Boolean matrix of the links that belong to this cell of the list (p, q); ``across``: of two blocks."""
    unit = _unit(vectors)
    links = unit @ unit.T >= similarity
    if across:
        links &= own[:, None] != own[None]
    np.fill_diagonal(links, False)
    if q == ONE_HOME:
        return links
    values, position = np.unique(ids, return_inverse=True)
    hot = np.zeros((len(ids), len(values)), np.float32)
    hot[np.arange(len(ids))[:, None], position.reshape(ids.shape)] = 1
    below = hot[:, (values < q) & (values != p)]
    links &= (hot @ hot.T >= shared) & (below @ below.T == 0)
    return links & (ids[:, :1] != ids[:, 0])


def _stars(links: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """For each row the smallest id of its connected part."""
    root = np.full(len(reps), -1)
    for first in np.argsort(reps, kind="stable").tolist():
        if root[first] >= 0:
            continue
        reached = np.zeros(len(reps), bool)
        fresh = np.zeros(len(reps), bool)
        reached[first] = fresh[first] = True
        while fresh.any():
            fresh = links[fresh].any(axis=0) & ~reached
            reached |= fresh
        root[reached] = first
    return reps[root]


def cell_links(cells: DataFrame, similarity: float = SIMILARITY, shared: int = SHARED) -> DataFrame:
    """(rep, links, root): per cell, the copies linked to each vector and a star of its links."""

    def run(batches):
        for group in _groups(batches, CELL):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks().to_batches()[0]
            vectors = np.stack(_rows(group.column("vector")))
            ids = np.stack(_rows(group.column("ids"))).astype(np.int64)
            reps, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
            p, q, a, b = (int(group.column(c)[0].as_py()) for c in ("p", "q", "a", "b"))
            links = verify(vectors, ids, own, p, q, a != b, similarity, shared)
            any_link = links.any(axis=1)
            if any_link.any():
                roots = _stars(links, reps)
                made = (reps[any_link], (links @ copies)[any_link], roots[any_link])
                yield pa.record_batch([pa.array(x.astype(np.int64)) for x in made], names=["rep", "links", "root"])

    bound_batches(cells.sparkSession)
    return cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "rep long, links long, root long")


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector.

    Vectors link at cosine ``similarity`` or more, computed in doubles; only vectors of the same
    number of dimensions are compared. Equal vectors are merged first and linked to each other.
    Null, empty and zero vectors and those with null or non-finite entries link with nothing and
    are kept. A row without vec_id links with nothing and has a null component and ``kept``.
    Repeated rows (same id, same vector) are one vector; an id with several vectors has a row for
    each. Other columns are ignored.
    """
    members, classes = distinct_vectors(embeddings)
    count = classes.count()
    size = min(MAX_PIVOTS, max(LEAST_PIVOTS, 1 << max(0, int(np.ceil(np.log2(max(count, 1)) / 2)))))
    described = cut(permutations(classes, pivot_sample(classes, size)), "permutations")
    found = cut(cell_links(_cells(described), similarity, shared), "cell-links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select("h0", "h1", "rep", "first_id", "copies").join(sums, "rep", "left")
    named = named.join(parts, F.col("rep") == F.col("id"), "left")
    named = named.select(
        "h0",
        "h1",
        "first_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "rep").alias("root"),
    )
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select("h0", "h1", "n_links", "component_id")
    out = members.where("h0 is not null").join(named, ["h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = members.where("h0 is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(alone).withColumn("n_links", F.col("n_links").cast("long"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
