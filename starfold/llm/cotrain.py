"""Quality classifier by co-training of two views.

The content view sees the words of a text, runs of symbols and coarse shares (capitals, symbols,
distinct words, the commonest word); the metadata view sees source, language, length and number of
lines. Each is a logistic regression over presence features, every token hashed to its place. They
start from labelled rows; in every round each view labels the unlabelled rows it is sure of, by its
calibrated probability, for the other one. At the end both views are calibrated together on held-out
labels and score every document.

The texts are read twice, once for the hashed tokens and once for the scores, and never shuffled.

Fitting uses at most ``SAMPLE_ROWS`` labelled documents, those with the smallest hash of their id, and
every unlabelled one. Everything else runs over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.llm.common import cut, for_now, map_batches, small_enough
from starfold.llm.views import DIMENSIONS, Model, View, Weights, content_tokens, flat_places, margins_of, metadata_tokens, places
SAMPLE_ROWS = 20_000
LEAST_DOCS = 5
SURE_GAIN = 8.0
LEAST_TOKENS = 64
HOLD_OUT = 5
ROUNDS = 3
SURE = 0.97
PENALTY = 0.3
REJECT_AT = 0.5
VIEWS = ("content", "metadata")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton steps for a logistic fit of a few columns; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def tokens(rows: DataFrame) -> DataFrame:
    """(doc_id, content, metadata): the places of the tokens of each document, in one pass over the texts."""

    def run(batch):
        ids, source, lang, text = [batch.column(c).to_pylist() for c in ("doc_id", "source", "lang", "text")]
        one = [places(content_tokens(t)) for t in text]
        two = [places(metadata_tokens(*x)) for x in zip(source, lang, text)]
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (one, two)]
        yield pa.record_batch([pa.array(ids, pa.int64()), *lists], names=["doc_id", *VIEWS])

    return map_batches(rows, run, "doc_id long, content array<int>, metadata array<int>")


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, content, metadata, y) of every document with an id, written once; no text is joined.

    y is 1 for a document to reject: quality 0 or toxic not 0; it is null without a label. Labels with null
    quality are not used; if a document has several, the worst counts.
    """
    bad = F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) != 0)).cast("int")).alias("y")
    marks = labels.where("doc_id is not null and quality is not null")
    marks = cut(marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(bad), "quality-marks")
    text = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string") for c in ("source", "lang", "text")]
    )
    # Only hashed tokens, a fraction of the text, meet the labels; a counted small side is sent to them.
    few = small_enough(marks, marks.count(), 32)
    return cut(tokens(text).join(few, "doc_id", "left"), "quality-rows")


def samples(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(labelled, pool): the rows of ``marked`` of the sampled labelled and of all unlabelled documents.

    Rows without doc_id are in neither.
    """
    every = marked(docs, labels)
    named = every.where("y is not null")
    ids = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return named.join(F.broadcast(cut(ids, "quality-sample")), "doc_id", "left_semi"), every.where("y is null")


def telling(rows: DataFrame, view: str) -> tuple[list[int], int]:
    """The places that tell about the label, and the number of rows.

    They are found by the log-likelihood ratio of presence against class: places below ``SURE_GAIN`` may
    differ by chance and are left out, but for the first ``LEAST_TOKENS``. All rows to be learned from
    count, the pseudo-labelled ones too, so a word that no labelled document has can be learned. There are
    at most ``DIMENSIONS`` places.
    """
    # Place -1 stands for the row itself, so one pass counts rows and places.
    every = F.concat(F.array(F.lit(-1)), F.col(view))
    counts = rows.select(F.explode(every).alias("place"), "label").groupBy("place")
    found = counts.agg(F.count("*").alias("df"), F.sum("label").alias("k")).where(F.col("df") >= LEAST_DOCS).toPandas()
    own = found[found.place >= 0]
    n, bad = (int(x) for x in found[found.place < 0][["df", "k"]].to_numpy()[0]) if len(found) > len(own) else (0, 0)
    if not n:
        return [], rows.count()
    df, k, rate = own["df"].to_numpy(float), own["k"].to_numpy(float), bad / n

    def term(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    gain = (
        term(k, df * rate)
        + term(df - k, df * (1 - rate))
        + term(bad - k, (n - df) * rate)
        + term(n - df - bad + k, (n - df) * (1 - rate))
    )
    order = np.lexsort((own["place"].to_numpy(), -gain))
    kept = [i for at, i in enumerate(order.tolist()) if at < LEAST_TOKENS or gain[i] >= SURE_GAIN]
    return sorted(own["place"].to_numpy()[kept].tolist()), n


VECTOR = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])


def _vectors(rows: DataFrame, view: str, found: list[int]) -> DataFrame:
    """(features, label): the given places of each row as a sparse vector, in the struct vectors are stored as."""
    index = np.full(DIMENSIONS, -1, np.int32)
    index[found] = np.arange(len(found))
    size = max(1, len(found))

    def run(batch):
        flat, row = flat_places(batch.column(view))
        at = index[flat]
        row, at = row[at >= 0], at[at >= 0]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
        parts = {
            "type": pa.array(np.zeros(batch.num_rows, np.int8)),
            "size": pa.array(np.full(batch.num_rows, size, np.int32)),
            "indices": pa.ListArray.from_arrays(ends, at),
            "values": pa.ListArray.from_arrays(ends, np.ones(len(at))),
        }
        vector = pa.StructArray.from_arrays(list(parts.values()), list(parts))
        yield pa.record_batch([vector, batch.column("label").cast(pa.float64())], names=["features", "label"])

    return map_batches(rows.select(view, "label"), run, VECTOR)


def _fit(rows: DataFrame, view: str) -> tuple[Weights, float]:
    """The weights of all tokens and the intercept of a view, learned from its telling places."""
    found, n = telling(rows, view)
    learner = LogisticRegression(featuresCol="features", labelCol="label", maxIter=30, regParam=PENALTY / max(1, n), standardization=False)
    # Written once: the passes of the fit read a few selected places, not the pool and its judges again.
    with for_now(_vectors(rows, view, found), "quality-vectors") as vectors:
        model = learner.fit(vectors)
    weights = np.zeros(DIMENSIONS)
    weights[found] = model.coefficients.toArray()[: len(found)]
    return Weights(weights), float(model.intercept)


def _held(rows: DataFrame, fitted: dict) -> tuple[np.ndarray, np.ndarray]:
    """(margins of both views, y) of the held-out rows, a bounded number of them."""

    def run(batch):
        both = [pa.array(margins_of(batch.column(v), *fitted[v])) for v in VIEWS]
        yield pa.record_batch([batch.column("y"), *both], names=["y", *VIEWS])

    found = map_batches(rows.select("y", *VIEWS), run, "y int, content double, metadata double").toPandas()
    return found[list(VIEWS)].to_numpy(), found["y"].to_numpy(float)


def _sure(pool: DataFrame, giver: str, taker: str, fitted: tuple, scale: np.ndarray) -> DataFrame:
    """(taker, label): the rows of the pool that the giver is sure of, as the taker sees them."""

    def run(batch):
        margin = margins_of(batch.column(giver), *fitted) * float(scale[0]) + float(scale[1])
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        keep = pa.array((p >= SURE) | (p <= 1 - SURE))
        label = pa.array((p >= SURE).astype(np.int32))
        yield pa.record_batch([batch.column(taker).filter(keep), label.filter(keep)], names=[taker, "label"])

    return map_batches(pool.select(giver, taker), run, f"{taker} array<int>, label int")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model | None:
    """The co-trained model; None when the labels do not hold both classes."""
    known, pool = samples(docs, labels, rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HOLD_OUT))
    known = cut(known.withColumn("held", fold == 0), "quality-sampled")
    if known.select("y", "held").distinct().count() < 4:
        return None
    train, held_out = known.where("not held"), known.where("held")
    pseudo = {v: None for v in VIEWS}
    for turn in range(rounds + 1):
        fitted = {}
        for v in VIEWS:
            own = train.select(v, F.col("y").alias("label"))
            fitted[v] = _fit(own if pseudo[v] is None else own.unionByName(pseudo[v]), v)
        margins, y = _held(held_out, fitted)
        scale = {v: _logistic(margins[:, [i]], y) for i, v in enumerate(VIEWS)}
        if turn == rounds:
            break
        for giver, taker in (VIEWS, VIEWS[::-1]):
            pseudo[taker] = _sure(pool, giver, taker, fitted[giver], scale[giver])
    views = [View(*fitted[v], *map(float, scale[v])) for v in VIEWS]
    both = _logistic(margins, y)
    return Model(*views, tuple(map(float, both)))


SCORES = ("content_p", "metadata_p", "reject_p")


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, content_p, metadata_p, reject_p) with the input's columns inside ``row``."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    if model is None:
        return rows.select("row", *[F.lit(None).cast("double").alias(n) for n in SCORES])

    def run(batch):
        columns = [batch.column(c).to_pylist() for c in ("source", "lang", "text")]
        found = [model.scores(*x) for x in zip(*columns)]
        arrays = [pa.array(x, pa.float64()) for x in zip(*found)]
        yield pa.record_batch([batch.column("row"), *arrays], names=["row", *SCORES])

    schema = rows.select("row").schema
    for n in SCORES:
        schema = schema.add(n, "double")
    return map_batches(rows, run, schema)


def _accepted(reject_at: float):
    return F.coalesce(F.col("reject_p") < reject_at, F.lit(True))


def score(docs: DataFrame, model: Model | None, reject_at: float = REJECT_AT) -> DataFrame:
    """The documents with content_p, metadata_p, reject_p (probabilities of rejection) and ``kept``.

    Every row is scored on its whole text, with null text as empty and null source or language as a
    value of its own. Without a model the probabilities are null and every row is kept. Columns of
    the input with these names are replaced; others are handed on whatever their names.
    """
    back = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (*SCORES, "kept")]
    return _scored(docs, model).select(*back, *SCORES, _accepted(reject_at).alias("kept"))


def keep_accepted(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """Pipeline stage: the documents that the fitted model does not reject, with their columns."""
    rows = _scored(docs, fit(docs, labels)).where(_accepted(reject_at))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``fit`` on the labelled documents, then ``score`` all of them."""
    return score(docs, fit(docs, labels))
