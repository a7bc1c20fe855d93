r"""Chat formatting by prefix-target expansion.

A turn is written as ``### role: text</turn>`` and a line feed. Texts and roles are escaped so that
neither mark can occur inside them: a backslash is doubled, ``###`` becomes ``\#\#\#`` (the last five of a
longer run ``\##\##\#`` where two would be left over, so that no three stand together) and ``</turn>``
becomes ``<\/turn>`` (in roles also ``:`` becomes ``\:``); dropping every backslash but the second of a
pair gives the text back. All of this is expressions.

Every assistant turn is an example of its own: all turns before it are the context, its text is the only
trainable part. The examples of one conversation are prefixes of the same character stream, so the
stream is kept once, turn by turn, and an example is a row of offsets into it; ``texts`` writes them out.
A conversation with a third of all turns therefore costs no more than its text, where copies of every
prefix would grow with the square of its length.

Rows are dealt by ranges of (conversation, turn), so a long conversation is spread over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.common import blank, bound_batches, cut

TRAINED_ROLE = "assistant"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
HELD_CHARS = 1 << 20

_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(c: Column) -> Column:
    """No mark occurs in the result; ``unescape`` gives the text back."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("###"), F.lit(r"\#\#\#"))
    c = F.replace(c, F.lit(r"\#\#\###"), F.lit(r"\##\##\#"))
    return F.replace(c, F.lit("</turn>"), F.lit(r"<\/turn>"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per turn, laid out by (conv_id, turn) over the partitions and sorted within them.

    Columns conv_id, turn, segment (the written turn), loss_start and loss_end (code points of the
    trainable text within the segment; null unless the role is ``trained_role``). A null role or text
    reads as empty. A missing turn number comes first; turns of one number, repeated rows included,
    follow in the order of role and text. Rows without conv_id are one conversation. Other columns are
    ignored; no rows give no rows.
    """
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit(r"\:")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    trained = F.col("role") == trained_role
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        blank("role").alias("role"),
        blank("text").alias("text"),
    )
    laid = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return laid.select(
        "conv_id",
        "turn",
        F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.when(trained, F.length(head)).alias("loss_start"),
        F.when(trained, F.length(head) + F.length(body)).alias("loss_end"),
    )


def stored_turns(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """``format_turns`` written once, with part and place: the order of a conversation's rows."""
    placed = format_turns(conversations, trained_role).select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "*"
    )
    return cut(placed, "turns")


def examples(stored: DataFrame) -> DataFrame:
    """One row per trainable turn of ``stored_turns``.

    Columns conv_id, example (from 1), part and place of its turn, n_context (turns before it),
    loss_start and loss_end (code points in the conversation's stream: the context is everything before
    the turn, the example ends with the turn) and n_chars (length of the example). Only numbers move;
    running sums are taken within a part, and one row per conversation and part carries them on.
    """
    sized = stored.select("conv_id", "part", "place", F.length("segment").alias("chars"), "loss_start", "loss_end")
    parts = sized.groupBy("conv_id", "part").agg(
        F.sum("chars").alias("chars"), F.count("*").alias("turns"), F.count("loss_start").alias("targets")
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("chars", "turns", "targets")}
    parts = parts.select("conv_id", "part", *[v.alias(n) for n, v in sums.items()])
    here = Window.partitionBy("conv_id", "part").orderBy("place")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    running = sized.select(
        "*",
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("at"),
        (F.row_number().over(here) - 1).alias("turns_here"),
        F.count("loss_start").over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("targets_here"),
    ).where(F.col("loss_start").isNotNull())
    same = F.col("r.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("r.part") == F.col("p.part"))
    at = F.col("at") + F.col("chars_before")
    return running.alias("r").join(parts.alias("p"), same).select(
        "r.conv_id",
        (F.col("targets_before") + F.col("targets_here")).alias("example"),
        "r.part",
        "place",
        (F.col("turns_before") + F.col("turns_here")).alias("n_context"),
        (at + F.col("loss_start")).alias("loss_start"),
        (at + F.col("loss_end")).alias("loss_end"),
        (at + F.col("chars")).alias("n_chars"),
    )


def texts(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``examples`` with their whole text: the result has every prefix, so write it for chosen examples."""
    both = F.col("s.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("s.place") <= F.col("e.place"))
    joined = found.alias("e").join(stored.alias("s"), both)
    names = ["conv_id", "example", "n_context", "loss_start", "loss_end", "n_chars"]
    pieces = F.array_sort(F.collect_list(F.struct("s.place", "s.segment")))
    grouped = joined.groupBy(*[F.col(f"e.{n}") for n in names]).agg(pieces.alias("pieces"))
    return grouped.select(*names, F.array_join("pieces.segment", "").alias("text"))


class Expansion:
    """The examples of one conversation from its written turns, read in order."""

    def __init__(self):
        self.turns = self.chars = self.examples = 0

    def add(self, segment: str, start: int | None, end: int | None) -> tuple | None:
        """The example that ends with this turn, as ``EXAMPLE`` without its conversation; None if it is not trainable."""
        at, context = self.chars, self.turns
        self.chars += len(segment)
        self.turns += 1
        if start is None:
            return None
        self.examples += 1
        return self.examples, context, at + start, at + end, self.chars


class Reading:
    """What a conversation's stream and its examples say, read in order; holds digests, never the text."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = self.examples = self.example_chars = 0
        self.read, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, example: tuple | None) -> None:
        """The next turn of the stream, and the example that ends with it: its mask says what is trained on."""
        head = _HEAD.match(segment)
        role, text = unescape(head.group(1)), unescape(segment[head.end() : -len(CLOSE)])
        self.read.update(f"{role}\n{text}\n".encode())
        at = self.chars
        self.turns += 1
        self.chars += len(segment)
        if example is not None:
            _, _, start, end, chars = example
            trained = unescape(segment[start - at : end - at])
            self.loss.update(trained.encode())
            self.loss_chars += len(trained)
            self.examples += 1
            self.example_chars += chars

    def row(self) -> tuple:
        numbers = (self.turns, self.read.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)
        return *numbers, self.examples, self.example_chars


DIGESTS = (
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_examples long, example_chars long"
)
PIECES = "conv_id long, place long, segment string, turn_start int, turn_end int"
EXAMPLE = "example long, n_context long, loss_start long, loss_end long, n_chars long"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _conversations(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[2] or "")
        if size > HELD_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


def expand(laid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples, digests) of rows as ``format_turns`` lays them out.

    ``examples`` has one row (conv_id, EXAMPLE) per trainable turn: the context is the conversation's stream
    before the turn, the example ends with the turn, and only loss_start to loss_end of the stream is
    trained on. ``digests`` has one row (conv_id, DIGESTS) per conversation, read back from its stream and
    these examples. Both are written in one pass over the turns.

    A conversation that lies inside one partition is expanded there. The first and the last one of a
    partition, and any of more than ``HELD_CHARS`` characters, may go on elsewhere: their rows are
    sent on and expanded in one stream per conversation. Each digest is of one string, so its reading
    cannot be split; it holds no more than a digest in memory.
    """
    spark = laid.sparkSession
    bound_batches(spark)
    no_example, no_digest = (None,) * len(_names(EXAMPLE)), (None,) * len(_names(DIGESTS))
    no_piece = (None,) * (len(_names(PIECES)) - 1)
    every = f"{PIECES}, {EXAMPLE}, {DIGESTS}"

    def expanded(conv, turns):
        """Example rows of a conversation, its digest row last."""
        expansion, reading = Expansion(), Reading()
        for segment, start, end in turns:
            example = expansion.add(segment, start, end)
            reading.add(segment, example)
            if example is not None:
                yield (conv, *no_piece, *example, *no_digest)
        yield (conv, *no_piece, *no_example, *reading.row())

    def inside(batches):
        def rows():
            now, held, size, going_on = None, [], 0, True
            for conv, place, segment, start, end in _conversations(batches):
                if now is None or now[0] != conv:
                    if held:
                        yield from expanded(now[0], (row[2:5] for row in held))
                    going_on = now is None
                    now, held, size = (conv,), [], 0
                row = (conv, place, segment, start, end, *no_example, *no_digest)
                if going_on:
                    yield row
                    continue
                held.append(row)
                size += len(segment)
                if size > HELD_CHARS:
                    yield from held
                    held, going_on = [], True
            yield from held

        yield from _batches(rows(), _schema(every))

    def streams(batches):
        def rows():
            for conv, turns in groupby(_conversations(batches), itemgetter(0)):
                yield from expanded(conv, (turn[2:5] for turn in turns))

        yield from _batches(rows(), _schema(every))

    place = F.monotonically_increasing_id().alias("place")
    spans = [F.col("loss_start").alias("turn_start"), F.col("loss_end").alias("turn_end")]
    first = cut(laid.select("conv_id", place, "segment", *spans).mapInArrow(inside, every), "expanded")
    pieces = first.where(F.col("segment").isNotNull()).select(*_names(PIECES))
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    whole = first.where(F.col("segment").isNull()).unionByName(cut(ordered.mapInArrow(streams, every), "expanded"))
    examples = whole.where(F.col("example").isNotNull()).select("conv_id", *_names(EXAMPLE))
    return examples, whole.where(F.col("n_turns").isNotNull()).select("conv_id", *_names(DIGESTS))


def read_back(laid: DataFrame) -> DataFrame:
    """(conv_id, DIGESTS) of every conversation, read from its expanded examples."""
    return expand(laid)[1]
