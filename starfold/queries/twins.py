"""Models small enough for SQL to train them too: every step of the model layer with checked values.

Two 0/1 features and trees of depth two: each tree is the mean of its target in the four cells, so a round is
one grouping. What the models say about the documents follows in SQL from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.models import (
    BoostedClassifier,
    BoostSettings,
    Stack,
    area_under_roc,
    feature_vector,
    gain_importance,
    metric_history,
    split_importance,
    submission,
    top_features,
)
from starfold.models.stack import fold_mean
from starfold.operators import exact_folds, stratified_holdout
from starfold.queries.registry import query, rounded
from starfold.session import materialize, scratch_path
from starfold.sources import read_csv, table, write_importance

NAMES = ["english", "long"]
RATE = 0.1
FOLDS = 4
THRESHOLD = 0.8
LONG = 1800
ASKED, PATIENCE = 1000, 5

CELLS = BoostSettings(rounds=2, depth=2, learning_rate=RATE)

DOCS = f"""d as (select doc_id as EID, (lang = 'en')::int as a, (n_chars > {LONG})::int as b, quality as q
        from documents left join labels using (doc_id)),
   t as (select *, 2.0 * q - 1 as y from d where q is not null)"""

SHARES = {1: 0.3, 0: 0.1}
# Of the rarer label more is held out than of the other: training then goes past what suits the held-out rows.
SKEWED = {1: 0.25, 0: 0.3}


def _split_sql(shares):
    """The held-out rows of the exact stratified split, seed 70."""
    return f"""{DOCS}, k as (
      select *, row_number() over (partition by q order by md5(EID::varchar || ':70')) as k, count(*) over (partition by q) as n from t),
   s as (select EID, a, b, q, y,
                (k <= round_even(case q when 1 then {shares[1]} when 0 then {shares[0]} end * n, 0))::int as is_valid from k)"""



def _rounds(source, rounds, name="f", by="a, b"):
    """Margins f1, f2, ... of every cell: the mean, then steps along the mean residual of the log loss."""
    ctes = [f"{name}1 as (select {by}, avg(y) as f from {source} group by all)"]
    for i in range(2, rounds + 1):
        ctes.append(
            f"{name}{i} as (select {by}, any_value(f) + {RATE} * avg(4 * y / (1 + exp(2 * y * f))) as f"
            f" from {source} join {name}{i - 1} using ({by}) group by all)"
        )
    return ", ".join(ctes)


def _frame(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("EID"),
        (F.col("lang") == "en").cast("int").alias(NAMES[0]),
        (F.col("n_chars") > LONG).cast("int").alias(NAMES[1]),
    )
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("EID"), F.col("quality").alias("TARGET"))
    rows = feature_vector(docs.join(labels, "EID", "left"), NAMES)
    return materialize(rows.select("EID", "TARGET", "features"), "cells")


def _labelled(frame):
    return frame.where("TARGET is not null")


def _unlabelled(frame):
    return frame.where("TARGET is null")


def _fitted(frame):
    return BoostedClassifier(CELLS).fit(_labelled(frame))


SCORES = f"with {DOCS}, {_rounds('t', 2)}, p as (select EID, 1 / (1 + exp(-2 * f)) as p from d join f2 using (a, b) where q is null)"


@query("gbt_cells", f"{SCORES} select EID, round(p, 9) as score from p")
def gbt_cells(spark, sf):
    """Two rounds of depth two."""
    frame = _frame(spark, sf)
    return rounded(_fitted(frame).predict(_unlabelled(frame)).select("EID", "score"), 9)


@query(
    "cells_submission",
    f"""{SCORES}, r as (select EID, round_even(p, 8) as p from p)
        select EID, (p > {THRESHOLD})::int as FORTARGET, p::varchar as PROB from r""",
)
def cells_submission(spark, sf):
    """Scores of a trained model, rounded, decided and written as text."""
    frame = _frame(spark, sf)
    return submission(_fitted(frame).predict(_unlabelled(frame)), THRESHOLD)


def _held_sql(rounds):
    """Margins of the held-out rows after each round, trained on the others."""
    held = " union all ".join(
        f"select {i}::int as round, y, q, f from s join f{i} using (a, b) where is_valid = 1" for i in range(1, rounds + 1)
    )
    return f"with {_split_sql(SHARES)}, u as (select * from s where is_valid = 0), {_rounds('u', rounds)}, h as ({held})"


# The area under the curve by pairs of scores; equal scores count half.
AREA = """c as (select round, f, sum(q) as p, sum(1 - q) as n from h group by all),
   area as (select x.round, sum(x.p * y.n * case when x.f > y.f then 1.0 when x.f = y.f then 0.5 else 0.0 end)
                   / (sum(x.p * y.n)) as value from c x join c y on x.round = y.round group by 1)"""
ROUNDS = 3


def _held_out(spark, sf, metric="logLoss", shares=SHARES, **changes):
    split = materialize(stratified_holdout(_labelled(_frame(spark, sf)), "EID", "TARGET", shares, seed=70), "split")
    settings = CELLS.with_(**{"rounds": ROUNDS, "patience": 50} | changes)
    train, held = split.where("is_valid = 0"), split.where("is_valid = 1")
    return BoostedClassifier(settings, metric=metric).fit(train, held), held


@query(
    "cells_history",
    f"""{_held_sql(ROUNDS)} select round, 'logLoss' as metric, round(avg(2 * ln(1 + exp(-2 * y * f))), 9) as value
        from h group by 1""",
)
def cells_history(spark, sf):
    """The loss of the held-out rows after each round."""
    return rounded(metric_history(spark, _held_out(spark, sf)[0].history), 9)


@query(
    "cells_history_auc",
    f"{_held_sql(ROUNDS)}, {AREA} select round, 'areaUnderROC' as metric, round(value, 9) as value from area",
)
def cells_history_auc(spark, sf):
    model, _ = _held_out(spark, sf, "areaUnderROC")
    return rounded(metric_history(spark, model.history, "areaUnderROC"), 9)


# What a patient watcher of the loss keeps: the earliest of the best rounds.
KEPT = """l as (select round, avg(2 * ln(1 + exp(-2 * y * f))) as value from h group by 1),
   kept as (select arg_min(round, (value, round)) as round from l)"""


@query(
    "cells_auc",
    f"""{_held_sql(ROUNDS)}, {AREA}, {KEPT}
        select 'areaUnderROC' as metric, round(value, 9) as value from area join kept using (round)""",
)
def cells_auc(spark, sf):
    """The area under the curve of the kept model on the held-out rows."""
    model, held = _held_out(spark, sf)
    auc = area_under_roc(model.predict(held), "TARGET", "score")
    return spark.createDataFrame([("areaUnderROC", round(auc, 9))], "metric string, value double")


def _patience_sql():
    """The margins of up to 64 rounds by recursion over the four cells, and where patience ends."""
    return f"""with recursive {_split_sql(SKEWED)}, u as (select * from s where is_valid = 0),
      m as (select a, b, avg(q) as share from u group by all),
      f(round, a, b, f) as (
        select 1, a, b, 2 * share - 1 from m
        union all
        select round + 1, f.a, f.b, f + {RATE} * (share * 4 / (1 + exp(2 * f)) - (1 - share) * 4 / (1 + exp(-2 * f)))
        from f join m on f.a = m.a and f.b = m.b where round < 64),
      h as (select round, avg(2 * ln(1 + exp(-2 * y * f))) as value
            from f join s on f.a = s.a and f.b = s.b where is_valid = 1 group by 1),
      w as (select *, min(value) over (order by round rows between unbounded preceding and 1 preceding) as before from h),
      x as (select *, max(case when before is null or value < before then round end) over (order by round) as best from w),
      e as (select min(round) filter (where round - best >= {PATIENCE}) as stopped from x)
    select {ASKED} as asked, 64 as trained, best::int as kept, round((select min(value) from h where round <= stopped), 9) as loss
    from x join e on round = stopped"""


@query("patience_stop", _patience_sql())
def patience_stop(spark, sf):
    """A fit that its own patience ends: rounds asked for, rounds trained, rounds kept and their loss."""
    model, _ = _held_out(spark, sf, shares=SKEWED, rounds=ASKED, patience=PATIENCE)
    kept = model.get_model().getNumTrees
    row = (ASKED, model.trained_rounds, kept, round(model.history[kept - 1], 9))
    return spark.createDataFrame([row], "asked int, trained int, kept int, loss double")


def _importance_sql():
    """Splits and gains of both trees: the root takes the feature of larger gain, its children the other one."""
    parts = [DOCS, _rounds("t", 2)]
    trees = []
    for i, value in ((1, "y"), (2, "4 * y / (1 + exp(2 * y * f))")):
        source = "t" if i == 1 else "t join f1 using (a, b)"
        parts.append(f"r{i} as (select a, b, {value} as v from {source})")
        # Sum of squares about the mean, by any grouping.
        loss = "sum(v * v) - sum(v) * sum(v) / count(*)"
        parts += [
            f"all{i} as (select {loss} as e from r{i})",
            f"a{i} as (select a, {loss} as e from r{i} group by 1)",
            f"b{i} as (select b, {loss} as e from r{i} group by 1)",
            f"ab{i} as (select a, b, {loss} as e from r{i} group by all)",
            f"root{i} as (select e - (select sum(e) from a{i}) as ga, e - (select sum(e) from b{i}) as gb from all{i})",
        ]
        trees.append(
            f"""select 0 as f, 1 as n, ga as g from root{i} where ga >= gb union all select 1, 1, gb from root{i} where ga < gb
            union all select 1, 1, x.e - sum(y.e) from root{i}, a{i} x join ab{i} y using (a) where ga >= gb
                      group by a, x.e having x.e - sum(y.e) > 1e-12
            union all select 0, 1, x.e - sum(y.e) from root{i}, b{i} x join ab{i} y using (b) where ga < gb
                      group by b, x.e having x.e - sum(y.e) > 1e-12"""
        )
    splits = " union all ".join(trees)
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES))
    return f"with {', '.join(parts)}, splits as ({splits}), names as (select * from (values {names}) v(f, feature))"


BY_SPLITS = f"""{_importance_sql()} select feature, round(sum(n)::double / (select sum(n) from splits), 9) as fscore
    from splits join names using (f) group by 1"""


@query("cells_importance", BY_SPLITS)
def cells_importance(spark, sf):
    """Splits by feature over all splits."""
    return rounded(split_importance(_fitted(_frame(spark, sf)).get_model(), NAMES), 9)


@query("write_cells_importance", BY_SPLITS)
def importance_file(spark, sf):
    path = scratch_path(spark, "importance")
    write_importance(cells_importance(spark, sf), path)
    return read_csv(spark, path, "feature string, fscore double")


@query(
    "cells_importance_gain",
    f"""{_importance_sql()} select feature, round(coalesce(sum(g), 0) / (select sum(g) from splits), 6) as fscore
        from names left join splits using (f) group by 1""",
)
def cells_gain(spark, sf):
    """Reduction of the squared error by feature over all splits."""
    return rounded(gain_importance(_fitted(_frame(spark, sf)).get_model(), NAMES), 6)


@query("cells_top_feature", f"{BY_SPLITS} order by fscore desc, feature limit 1")
def cells_top(spark, sf):
    return rounded(top_features(split_importance(_fitted(_frame(spark, sf)).get_model(), NAMES), 1), 9)


# Out of fold: fold i is scored by the means of the other folds.
FOLDED = f"""{DOCS}, k as (select *, count(*) over () as n, row_number() over (order by md5(EID::varchar || ':2017')) - 1 as k from t),
   z as (select *, n // {FOLDS} as base, n % {FOLDS} as extra from k),
   g as (select EID, a, b, q, y, (case when k < extra * (base + 1) then k // (base + 1)
                else extra + (k - extra * (base + 1)) // base end)::int as fold from z),
   o as (select i::int as i, a, b, y from g join range({FOLDS}) r(i) on fold <> i)"""
# A fold model keeps its second round only if that lowers the loss of the fold held out.
STACK = f"""with {FOLDED}, {_rounds('o', 2, by='i, a, b')},
   e as (select x.i, x.a, x.b, x.f as one, y.f as two from f1 x join f2 y on x.i = y.i and x.a = y.a and x.b = y.b),
   l as (select i, avg(ln(1 + exp(-2 * y * one))) as one, avg(ln(1 + exp(-2 * y * two))) as two
         from g join e on g.fold = e.i and g.a = e.a and g.b = e.b group by 1),
   v as (select e.i, e.a, e.b, 1 / (1 + exp(-2 * e.one)) as score_0,
                1 / (1 + exp(-2 * case when l.two < l.one then e.two else e.one end)) as score_1
         from e join l on e.i = l.i)"""
BASES = (CELLS.with_(rounds=1), CELLS)


def _folded(frame):
    return materialize(exact_folds(_labelled(frame), "EID", FOLDS), "folds", "fold")


@query(
    "cells_oof",
    f"""{STACK} select EID, q as TARGET, fold, round(score_0, 9) as score_0, round(score_1, 9) as score_1
        from g join v on g.fold = v.i and g.a = v.a and g.b = v.b""",
)
def cells_oof(spark, sf):
    """Every labelled row scored by models that did not see its fold."""
    stack = Stack(BASES, CELLS, FOLDS).fit(_folded(_frame(spark, sf)))
    return rounded(stack.oof.select("EID", "TARGET", "fold", "score_0", "score_1"), 9)


@query(
    "cells_fold_mean",
    f"""{STACK}, w as (select a, b, avg(score_0) as score_0, avg(score_1) as score_1 from v group by all)
        select EID, round(score_0, 9) as score_0, round(score_1, 9) as score_1 from d join w using (a, b) where q is null""",
)
def cells_fold_mean(spark, sf):
    """Unlabelled rows scored by each base model as the mean over its fold models."""
    frame = _frame(spark, sf)
    stack = Stack(BASES, CELLS, FOLDS).fit(_folded(frame))
    return rounded(fold_mean(_unlabelled(frame), stack.models).select("EID", "score_0", "score_1"), 9)


@query(
    "cells_blend",
    f"""{STACK}, oof as (
          select EID, q, y, score_0 as x, row_number() over (order by md5(EID::varchar || ':10000')) as k, count(*) over () as n
          from g join v on g.fold = v.i and g.a = v.a and g.b = v.b),
        tr as (select x, sum(y) as s, count(*) as c from oof where k > ceil(0.3 * n) group by 1),
        cum as (select x, lead(x) over w as above, sum(s) over w as ls, sum(c) over w as lc, sum(s) over () as ts, sum(c) over () as tc
                from tr window w as (order by x)),
        best as (select (x + above) / 2 as cut, ls / lc as low, (ts - ls) / (tc - lc) as high from cum where above is not null
                 order by ls * ls / lc + (ts - ls) * (ts - ls) / (tc - lc) desc limit 1),
        w as (select a, b, avg(score_0) as m from v group by all)
      select EID, round(1 / (1 + exp(-2 * case when m <= cut then low else high end)), 9) as score
      from d join w using (a, b), best where q is null""",
)
def cells_blend(spark, sf):
    """A blender of one split on the out-of-fold scores, applied to the means over the fold models."""
    frame = _frame(spark, sf)
    stack = Stack(BASES[:1], BoostSettings(rounds=1, depth=1), FOLDS).fit(_folded(frame))
    return rounded(stack.predict(_unlabelled(frame)).select("EID", "score"), 9)
