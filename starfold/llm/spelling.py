"""Grouping of spelling variants with k-d trees over letter counts.

Two words are near if one edit (a code point inserted, deleted or replaced) turns one into the other.
A replaced letter lowers one letter count by one and raises another; an inserted letter raises one. So a
word's near words of its own length lie at L1 distance 2 and those one letter longer at distance 1, in
a box of at most one step up and one step down.

The words of one length form one k-d tree. Its upper levels are fitted on a bounded sample and split a
length whose words do not fit one task into leaves; every word goes to its own leaf and, as a query, to
each leaf that its box still reaches: crossing a split costs the step up or the step down, and a box
without the step is pruned. Within a leaf the tree goes on down to small cells, all queries of a node
moving together, and what is left within the L1 distance is verified letter by letter. A pair of one
length is met once (of two words parted by a split only the lower one travels), as is a pair of lengths
L and L + 1 (only the shorter one travels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import blank, bound_batches, cut

LEAST_POINTS = 7
LEAST_COUNT = 2
DROP_EVERY = 31
FORM_TIMES = 10
LEAF_POINTS = 1 << 18
MOST_LEAVES = 4096
SAMPLE_PER_LEAF = 64
CELL = 48
PAIRS_AT_ONCE = 1 << 14
MOST_HELD = 1 << 17

# a-z, then U+00C0 to U+00FF: only A-Z is lower-cased.
LETTERS = 26 + 64


def altered(doc_id, run: str, every: int = DROP_EVERY) -> str:
    """The lower-cased run; if ``every`` divides crc32(``<doc_id>:<run>``), without one of its letters."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, every: int = DROP_EVERY) -> DataFrame:
    """(word, n): the words of all texts with their number of occurrences, added up before the shuffle."""
    # Runs are maximal, as a match starts at the first letter and takes all; only A-Z is lower-cased in bytes.
    long_runs = re.compile(f"[a-z\u00c0-\u00ff]{{{least_points},}}")

    def count(batches):
        held = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = Counter(long_runs.findall(text.encode().lower().decode()))
                for run, n in runs.items():
                    word = altered(doc, run, every)
                    if len(word) >= least_points:
                        held[word] += n
                if len(held) > MOST_HELD:
                    yield _counted(held)
        if held:
            yield _counted(held)

    bound_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("string"), blank("text").alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(held: Counter) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
    held.clear()
    return batch


# letter counts ---------------------------------------------------------------------------------


def points_of(same_length: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    length = len(same_length[0])
    return np.array(same_length, f"<U{length}").view(np.uint32).reshape(len(same_length), length)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """How often each letter occurs, a row per word."""
    letter = np.where(points < 0xC0, points - 97, points - 0xC0 + 26).astype(np.int64)
    rows = np.arange(len(points))[:, None] * LETTERS
    return np.bincount((rows + letter).ravel(), minlength=len(points) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def split_of(counts: np.ndarray) -> tuple[int, int] | None:
    """(letter, count): words with at most that count of the letter go left; None if all are equal."""
    letter = int(counts.var(axis=0).argmax())
    column = counts[:, letter]
    low, high = int(column.min()), int(column.max())
    if low == high:
        return None
    at = int(np.median(column))
    # Of the two splits beside the median the more even one.
    tries = [t for t in (at - 1, at) if low <= t < high]
    return letter, min(tries, key=lambda t: abs(2 * int((column <= t).sum()) - len(column)))


@dataclass
class Node:
    """A split of the upper tree, or a leaf with its number."""

    letter: int = -1
    at: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = 0


def grow(counts: np.ndarray, leaves: int, first: int = 0) -> tuple[Node, int]:
    """(tree, next free leaf number) of about ``leaves`` leaves over a sample of letter counts."""
    split = split_of(counts) if leaves > 1 and len(counts) > 1 else None
    if split is None:
        return Node(leaf=first), first + 1
    letter, at = split
    side = counts[:, letter] <= at
    share = min(leaves - 1, max(1, round(leaves * float(side.mean()))))
    left, first = grow(counts[side], share, first)
    right, first = grow(counts[~side], leaves - share, first)
    return Node(letter, at, left, right), first


def homes(node: Node, counts: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the leaf each word lies in."""
    if not len(rows):
        return
    if node.left is None:
        yield node.leaf, rows
        return
    side = counts[rows, node.letter] <= node.at
    yield from homes(node.left, counts, rows[side])
    yield from homes(node.right, counts, rows[~side])


def reached(node: Node, counts: np.ndarray, rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the leaves within the box of each word; ``up`` and ``down`` say what steps are left."""
    if not len(rows):
        return
    if node.left is None:
        yield node.leaf, rows
        return
    for child, keep, up_, down_ in _sides(counts[rows, node.letter], node.at, up, down):
        yield from reached(node.left if child else node.right, counts, rows[keep], up_, down_)


def _sides(column, at, up, down):
    """(left?, which queries, steps up, steps down) for both sides of a split."""
    left = (column <= at) | ((column == at + 1) & down)
    right = (column > at) | ((column == at) & up)
    yield True, left, up[left], (down & (column <= at))[left]
    yield False, right, (up & (column > at))[right], down[right]


def neighbours(node: Node, counts: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows) of the other leaves that words of the tree's own length must visit.

    Of two words parted by a split only the lower one crosses it, so each pair meets once.
    """
    if node.left is None or not len(rows):
        return
    column = counts[rows, node.letter]
    crossing = rows[column == node.at]
    some = np.ones(len(crossing), bool)
    yield from reached(node.right, counts, crossing, ~some, some)
    yield from neighbours(node.left, counts, rows[column <= node.at])
    yield from neighbours(node.right, counts, rows[column > node.at])


# search within a leaf ----------------------------------------------------------------------------


def pairs_inside(counts: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at one step up and one step down, each pair once."""
    if len(rows) <= CELL:
        for a, b in _close(counts, counts, rows, rows):
            yield a[a < b], b[a < b]
        return
    split = split_of(counts[rows])
    if split is None:
        return  # equal counts: a replaced letter would change them
    letter, at = split
    column = counts[rows, letter]
    crossing = rows[column == at]
    some = np.ones(len(crossing), bool)
    yield from pairs_between(counts, counts, rows[column > at], crossing, ~some, some)
    yield from pairs_inside(counts, rows[column <= at])
    yield from pairs_inside(counts, rows[column > at])


def pairs_between(
    counts: np.ndarray, asked: np.ndarray, rows: np.ndarray, queries: np.ndarray, up: np.ndarray, down: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, query) pairs that share all letters but one of the row, searched in one k-d tree.

    ``up`` and ``down`` are the steps each query has left on its way down the tree.
    """
    if not len(rows) or not len(queries):
        return
    if len(rows) <= CELL:
        yield from _close(counts, asked, rows, queries)
        return
    split = split_of(counts[rows])
    if split is None:
        # Equal counts: the first row speaks for all.
        for _, some in _close(counts, asked, rows[:1], queries):
            for query in some:
                yield rows, np.full(len(rows), query)
        return
    letter, at = split
    side = counts[rows, letter] <= at
    for left, keep, up_, down_ in _sides(asked[queries, letter], at, up, down):
        yield from pairs_between(counts, asked, rows[side if left else ~side], queries[keep], up_, down_)


def _close(counts, asked, rows, queries):
    """(row, query) pairs that share all letters but one of the row; a cell against blocks of queries."""
    letters = np.flatnonzero(counts[rows].any(axis=0))
    own, own_sum = counts[rows][:, letters], counts[rows].sum(axis=1)
    wide = max(1, PAIRS_AT_ONCE // max(1, len(rows)))
    for first in range(0, len(queries), wide):
        part = queries[first : first + wide]
        common = np.minimum(own[:, None, :], asked[part][:, letters][None]).sum(axis=2)
        a, b = np.nonzero(common == own_sum[:, None] - 1)
        yield rows[a], part[b]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words in the rows of two code point tables differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether the longer word is the shorter one with one code point put in."""
    front = np.logical_and.accumulate(longer[:, :-1] == shorter, axis=1).sum(axis=1)
    back = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(axis=1)
    return front + back >= shorter.shape[1]


def near_in_leaf(own: list[str], visitors: list[str], shorter: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs as indices into ``own + visitors + shorter``; own and visitors are of one length."""
    pairs = []
    if own:
        points = points_of(own)
        counts, rows = letter_counts(points), np.arange(len(own))
        pairs += _verified(pairs_inside(counts, rows), points, points, one_replaced, 0)
        for other, offset, down, check in (
            (visitors, len(own), True, one_replaced),
            (shorter, len(own) + len(visitors), False, one_inserted),
        ):
            if other:
                asked = points_of(other)
                yes = np.ones(len(other), bool)
                found = pairs_between(counts, letter_counts(asked), rows, np.arange(len(other)), yes, yes & down)
                pairs += _verified(found, points, asked, check, offset)
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*pairs))


def _verified(found, points, asked, check, offset):
    most = max(1, (1 << 22) // points.shape[1])
    out = []
    for a, b in found:
        for i in range(0, len(a), most):
            x, y = a[i : i + most], b[i : i + most]
            ok = check(points[x], asked[y])
            if ok.any():
                out.append((x[ok], y[ok] + offset))
    return out


# over the cluster --------------------------------------------------------------------------------

OWN, VISITOR, SHORTER = 0, 1, 2


def upper_trees(counted: DataFrame) -> dict[int, Node]:
    """length -> upper tree, for lengths whose words do not fit one leaf.

    Fitted on a sample by word hash: SAMPLE_PER_LEAF words for each leaf, MOST_LEAVES leaves for all
    lengths together. A length without a tree is one leaf.
    """
    length = F.length("word")
    by_length = counted.groupBy(length.alias("length")).agg(F.count("*").alias("n"))
    wide = {r.length: r.n for r in by_length.where(F.col("length") * F.col("n") > LEAF_POINTS).collect()}
    if not wide:
        return {}
    points = sum(k * n for k, n in wide.items())
    unit = max(LEAF_POINTS, points // MOST_LEAVES + 1)
    leaves = {k: -(-k * n // unit) for k, n in wide.items()}
    share = F.create_map(*[F.lit(x) for k, n in wide.items() for x in (k, min(1.0, leaves[k] * SAMPLE_PER_LEAF / n))])
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.element_at(share, length) * (1 << 30)
    sample: dict[int, list[str]] = {k: [] for k in wide}
    for (word,) in counted.where(length.isin(*wide) & drawn).select("word").collect():
        sample[len(word)].append(word)
    return {k: grow(letter_counts(points_of(sorted(w))), leaves[k])[0] for k, w in sample.items() if w}


def routed(counted: DataFrame, trees: dict[int, Node]) -> DataFrame:
    """(length, leaf, part, word, n): every word in its own leaf and, as a query, where its box reaches."""

    def run(batches):
        for batch in batches:
            by_length: dict[int, list[int]] = {}
            own, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, word in enumerate(own):
                by_length.setdefault(len(word), []).append(i)
            for length, index in by_length.items():
                counts = None
                if length in trees or length + 1 in trees:
                    counts = letter_counts(points_of([own[i] for i in index]))
                rows = np.arange(len(index))
                yes = np.ones(len(index), bool)
                goals = []
                if length in trees:
                    goals += [(length, leaf, OWN, r) for leaf, r in homes(trees[length], counts, rows)]
                    goals += [(length, leaf, VISITOR, r) for leaf, r in neighbours(trees[length], counts, rows)]
                else:
                    goals.append((length, 0, OWN, rows))
                if length + 1 in trees:
                    found = reached(trees[length + 1], counts, rows, yes, ~yes)
                    goals += [(length + 1, leaf, SHORTER, r) for leaf, r in found]
                else:
                    goals.append((length + 1, 0, SHORTER, rows))
                for goal, leaf, part, r in goals:
                    at = [index[i] for i in r.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([goal] * len(at), pa.int32()),
                            pa.array([leaf] * len(at), pa.int32()),
                            pa.array([part] * len(at), pa.int32()),
                            pa.array([own[i] for i in at], pa.string()),
                            pa.array([n[i] for i in at], pa.int64()),
                        ],
                        ["length", "leaf", "part", "word", "n"],
                    )

    return counted.select("word", "n").mapInArrow(run, "length int, leaf int, part int, word string, n long")


def near_pairs(counted: DataFrame) -> DataFrame:
    """(word, near_n, near): for every word and leaf that holds near words, their number and the best one."""

    def leaf(rows: pa.Table) -> pa.Table:
        part = rows.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        names = rows.column("word").to_pylist()
        names = [names[i] for i in order.tolist()]
        n = rows.column("n").to_numpy()[order]
        sizes = np.bincount(part, minlength=3)
        a, b = near_in_leaf(names[: sizes[0]], names[sizes[0] : sizes[0] + sizes[1]], names[sizes[0] + sizes[1] :])
        near: dict[int, list] = {}
        for i, j in zip(np.concatenate((a, b)).tolist(), np.concatenate((b, a)).tolist()):
            best = near.setdefault(i, [0, 0, ""])
            best[0] += 1
            if n[j] > best[1] or n[j] == best[1] and names[j] < best[2]:
                best[1:] = int(n[j]), names[j]
        found = near.values()
        return pa.table(
            {
                "word": pa.array([names[i] for i in near], pa.string()),
                "n_near": pa.array([x[0] for x in found], pa.int64()),
                "near_n": pa.array([x[1] for x in found], pa.int64()),
                "near": pa.array([x[2] for x in found], pa.string()),
            }
        )

    found = routed(counted, upper_trees(counted)).groupBy("length", "leaf")
    return found.applyInArrow(leaf, "word string, n_near long, near_n long, near string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the forms followed to the last, by doubling the way.

    A form occurs ``FORM_TIMES`` times as often as its word, so a way has at most 18 steps.
    """
    way = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(
            way.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "forms"
        )
        if longer.where(F.col("further").isNotNull()).isEmpty():
            return longer.select("word", "root")
        way = longer.select("word", "root")


def variants(
    docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, every: int = DROP_EVERY, times: int = FORM_TIMES
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z, a-z and U+00C0 to U+00FF) with A-Z lower-cased, of at least
    ``least_points`` code points and ``least_count`` occurrences over all of ``docs`` (doc_id, text; other
    columns are ignored). A null or empty text has none, repeated rows count again, a row without id
    counts with an empty id, and no rows give no words. The form is the near word with the most
    occurrences (ties: first in code-point order) if it has ``times`` as many; root is where the forms end.
    """
    counted = cut(words(docs, least_points, least_count, every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(counted).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    strong = -F.col("best.less") >= F.col("n") * times
    judged = cut(
        counted.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "judged",
    )
    found = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
