"""Classifier, URL filter, embeddings, pipeline; awkward tables and plans of all operators."""

import os
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import awkward, contaminated, documents, kept_lines, ordered, roots, simhash_groups
from oracle import connect, difference
from starfold.llm import bpe, cotrain, decontam, hmm, licenses, linehash, pivots, simhash, suffix, urls
from starfold.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("STARFOLD_TEST_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


# 3 ---------------------------------------------------------------------------------------------


def labelled(spark, folder=LARGER):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def test_classifier_held_out_accuracy(spark):
    """Fitted without a fifth of the labels, judged on that fifth."""
    docs, labels = labelled(spark)
    apart = F.pmod(F.hash("doc_id", F.lit("apart")), F.lit(5)) == 0
    scored = cotrain.score(docs, cotrain.fit(docs, labels.where(~apart)))
    judged = scored.join(labels.where(apart), "doc_id").select("kept", "quality", "toxic").collect()
    wrong_clean = [r for r in judged if r.quality == 1 and r.toxic == 0 and not r.kept]
    missed = [r for r in judged if (r.quality == 0 or r.toxic == 1) and r.kept]
    clean = sum(r.quality == 1 and r.toxic == 0 for r in judged)
    assert len(judged) > 50 and len(wrong_clean) <= 0.05 * clean
    assert len(missed) <= 0.3 * (len(judged) - clean)


def test_pseudo_labels_teach_the_other_view(spark):
    """The metadata view learns from what the content view is sure of."""
    rows = [(i, "fine words here " * 5 if i % 2 else "BAD!! %%% junk", "en", "good" if i % 2 else "evil", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, labels)
    assert model.metadata.weights["source evil"] > 0 > model.metadata.weights["source good"]
    kept = {r.doc_id: r.kept for r in cotrain.score(docs, model).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(400))


def test_whole_unlabelled_pool_teaches(spark):
    """The bound holds for labelled documents alone; all unlabelled ones are in the pool."""
    rows = [(i, "fine words here " * 5 if i % 2 else "BAD!! %%% junk", "en", "good" if i % 2 else "evil", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    known, pool = cotrain.samples(docs, labels, 40)
    assert known.count() == 40 and {r.doc_id for r in pool.collect()} == set(range(60, 400))
    assert all(r.doc_id < 60 and r.y == 1 - r.doc_id % 2 for r in known.collect())


def test_classifier_without_both_classes_keeps_all(spark):
    docs = documents(spark, awkward(2000))
    for rows in ([], [(1, 1, 0), (2, 1, None), (4, None, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        found = cotrain.classify(docs, labels).collect()
        assert len(found) == len(awkward(10)) and all(r.kept and r.reject_p is None for r in found)


# 5 ---------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None),
        "": ("", "", None),
        "no scheme.org/x": ("", "", None),
        "HTTP://WWW.Example.ORG": ("www.example.org", "", None),
        "http://www.example.org/": ("www.example.org", "/", "org/"),
        "http://a.example.org/es/1?x=/": ("a.example.org", "/es/1", "example.org/es/"),
        "http://example.org/es": ("example.org", "/es", "org/"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/"),
        "x://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1"),
        "http://example.com?q=/fr/": ("example.com", "", None),
        "http://a.com/fr/://b": ("a.com", "/fr/://b", "com/fr/"),
        "http://ÄX.com/de/": ("Äx.com", "/de/", "com/de/"),
        "http://x.net\n/y": ("x.net\n", "/y", None),
    }
    rows = [(i, u, "clash", "clash") for i, u in enumerate(cases)] + [(None, "http://x.net/q/", "c", "c")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, canonical string, block string")
    listed = spark.createDataFrame([("https://www.X.net/q//?z",), (None,), ("bad",)], "url string")
    found = urls.judge(pages, listed).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.page_id is None:
            assert (r.rule, r.verdict) == (None, "block")
        else:
            host, path, rule = list(cases.values())[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            allowed = dict((t, v) for v, t in urls.RULES).get(rule, "allow")
            assert r.verdict == allowed
    none = spark.createDataFrame([], "url string")
    assert {r.verdict for r in urls.judge(pages, none).where("rule is null").collect()} == {"allow"}


def test_bloom_filter_never_misses_and_join_removes_false_hits(spark):
    listed = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("listed"))
    asked = spark.range(30_000).select(F.concat(F.lit("u"), "id").alias("canonical"))
    for blocks in (1, 40, 188):
        tested = urls.possible(asked, urls.bloom_filter(listed, blocks), blocks)
        hits = {r.canonical for r in tested.where("maybe").collect()}
        assert {f"u{i}" for i in range(3000)} <= hits
        assert blocks == 1 or len(hits) < (30_000 if blocks < 188 else 3600)


# 10 --------------------------------------------------------------------------------------------


def plain_links(rows, similarity=0.9):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    pairs, n = [], len(rows)
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= similarity:
                    pairs.append((i, j))
    links = [sum(i in p for p in pairs) for i in range(n)]
    group = roots(n, pairs)
    return [(rows[i][0], links[i], rows[group[i]][0]) for i in range(n)]


@pytest.mark.parametrize("block", [4, 256])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.normal(size=(25, 16))
    rows = [(int(i), (base[i % 25] + rng.normal(size=16) * 0.25).astype(np.float32).tolist()) for i in range(250)]
    rows += [(1000 + i, rows[3][1]) for i in range(12)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] * 8), (2003, [float("nan")] * 16), (2004, [])]
    rows += [(2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [3e38] * 16), (2009, [1e-38] * 16)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies string")
    frame = frame.unionByName(frame.where("vec_id = 5"))
    found = pivots.near_duplicates(frame).collect()
    expected = plain_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    got = {r.vec_id: r for r in found}
    assert len(found) == len(rows)
    whole, seen = sum(n for _, n, _ in expected), sum(min(got[i].n_links, n) for i, n, _ in expected)
    assert seen >= 0.9 * whole and all(got[i].n_links <= n for i, n, _ in expected)
    assert all(got[i].kept == (got[i].component_id == i) for i, _, _ in expected)
    same = [got[i].component_id == c for i, _, c in expected]
    assert np.mean(same) >= 0.9
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(2000, 2006))


def test_embedding_rows_without_id(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, None), (1, [0.0, 1.0]), (3, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ordered((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(frame).collect())
    assert found == ordered(
        [(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 1, False), (None, 0, None, None), (None, 0, None, None)]
    )


@pytest.mark.parametrize("cosine", [0.9, 0.96])
def test_embedding_links_of_one_large_cluster(spark, monkeypatch, cosine):
    """A third of the rows lie around one centre; with blocks of 64 their lists are split too."""
    monkeypatch.setattr(pivots, "BLOCK", 64)
    rng = np.random.default_rng(3)
    centre, noise = rng.normal(size=32), rng.normal(size=(1000, 32))
    centre /= np.linalg.norm(centre)
    noise -= (noise @ centre)[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    vectors = np.concatenate([cosine**0.5 * centre + (1 - cosine) ** 0.5 * noise, rng.normal(size=(2000, 32))])
    vectors[2900:] = vectors[1500:1600] + 0.3 * rng.normal(size=(100, 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in pivots.near_duplicates(frame).collect()}
    found = np.array([got[i] for i in range(3000)])
    assert expected[:1000].sum() > 100_000 and (found <= expected).all()
    assert found[:1000].sum() >= 0.99 * expected[:1000].sum()
    assert found[1000:].sum() >= 0.95 * expected[1000:].sum()


# tables without rows, awkward rows ---------------------------------------------------------------


def operators(spark):
    bench = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    return {
        "bpe": lambda d: bpe.digests(bpe.decode(bpe.encode(d, RANKS, PATTERN), RANKS, PATTERN), 50256),
        "suffix": suffix.remove_repeats,
        "cotrain": lambda d: cotrain.classify(d, labels),
        "linehash": linehash.dedup_lines,
        "hmm": lambda d: hmm.score(d, states=2, steps=1),
        "licenses": licenses.scan,
        "simhash": simhash.near_duplicates,
        "decontam": lambda d: decontam.contaminated(d, bench),
    }


@pytest.mark.parametrize("name", "bpe suffix cotrain linehash hmm licenses simhash decontam".split())
def test_awkward_and_empty_tables(spark, name):
    run, rows = operators(spark)[name], awkward()
    found = run(documents(spark, rows)).collect()
    if name == "decontam":
        assert [(r.doc_id, r.item_id) for r in found] == [(7, 1)]
    else:
        assert ordered([(r.doc_id,) for r in found]) == ordered([(i,) for i, _ in rows])
    empty = run(documents(spark, [])).collect()
    assert empty == []


def test_empty_tables_beside_documents(spark):
    docs = documents(spark, awkward(500))
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string")).collect() == []


# pipeline --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A small lake with awkward rows beside the given ones."""
    out = tmp_path_factory.mktemp("lake")
    docs, labels = labelled(spark)
    more = spark.createDataFrame([(10_000 + (i or 0) if i is not None else None, t) for i, t in awkward(3000)], "doc_id long, text string")
    bench = spark.read.parquet(f"{LARGER}/benchmark.parquet")
    leak = bench.limit(1).select(F.lit(20_000).cast("long").alias("doc_id"), F.concat(F.lit("Before. "), "text", F.lit(" After that.")).alias("text"))
    docs = docs.unionByName(more.unionByName(leak), allowMissingColumns=True)
    docs = docs.withColumn("row", F.lit("clash")).withColumn("kept", F.lit("clash")).withColumn("gone_id", F.lit("clash"))
    docs.coalesce(1).write.parquet(f"{out}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{out}/labels.parquet")
    bench.coalesce(1).write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_pipeline_stages_against_plain_versions(spark, folder):
    from starfold.llm.common import cut

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(cut(stage(spark, steps[-1], folder), f"test-{name}"))
        if name != "byte_bpe":
            assert steps[-1].schema.simpleString() == docs.schema.simpleString()
    rows = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps[:-1]]

    model_kept = cotrain.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("kept").count()
    assert len(rows[1]) == model_kept < len(rows[0])
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = {d for d, x in labels.items() if x == (1, 0)}
    assert len(clean & {d for d, _ in rows[1]}) >= 0.9 * len(clean)

    assert ordered(rows[2]) == ordered((d, t) for d, _, _, t in kept_lines(rows[1]))
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())

    named = {d: t for d, t in rows[2] if d is not None}
    groups = simhash_groups([(d, t) for d, t in rows[2] if d is not None and list(x for x, _ in rows[2]).count(d) == 1])
    gone = {d for d, (_, c) in groups.items() if d != c}
    assert gone.isdisjoint(d for d, _ in rows[3]) and len(named) > len(groups) - len(gone)

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {d for d, _ in contaminated([x for x in rows[3] if x[0] is not None], bench)}
    assert ordered(rows[4]) == ordered(x for x in rows[3] if x[0] not in leaks) and 20_000 in leaks

    encoder = bpe.encoder(RANKS, PATTERN)
    expected = [(d, len(encoder.encode_ordinary(t or ""))) for d, t in rows[4]]
    assert ordered((r.doc_id, r.n_tokens) for r in steps[5].collect()) == ordered(expected)


def test_stages_judge_rows_not_ids(spark):
    """Two texts of one id are two documents; a row without id is judged by its text."""
    a, b = "the first text " * 9, "another story altogether " * 8
    rows = [(5, a), (9, a), (3, b), (5, b), (None, a), (None, "alone " * 7), (None, "alone " * 7 + " "), (4, None), (2, "")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(documents(spark, rows)).collect()]
    assert [x for x in kept if x[1] in (a, b)] == [(5, a), (3, b)] or sorted(x for x in kept if x[1] in (a, b)) == [(3, b), (5, a)]
    assert len([x for x in kept if x[0] is None]) == 1 and [x for x in kept if not x[1]] == [(2, "")]
    item = " ".join(f"question{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"before {item} after"), (7, f"here is {item}"), (7, "clean text of the same id"), (None, "clean")]
    left = decontam.keep_clean(documents(spark, rows), bench).collect()
    assert ordered((r.doc_id, r.text) for r in left) == ordered([(7, "clean text of the same id"), (None, "clean")])


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


# plans -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op5_url_filter", "op7_benchmark_decontamination"])
def test_native_queries_plan_no_python(spark, monkeypatch, name):
    """The plans of the result and of every table written on the way."""
    from starfold.llm import common

    plans = []

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, label)

    for module in (urls, decontam):
        monkeypatch.setattr(module, "cut", watched)
    df = QUERIES[name](spark, FOLDER)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    text = "\n".join(plans)
    assert len(plans) > 2 and not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", text)


def test_sources_use_no_local_checkpoint_or_temporary_folder():
    root = os.path.join(os.path.dirname(cotrain.__file__))
    text = "\n".join(open(os.path.join(root, f)).read() for f in os.listdir(root) if f.endswith(".py"))
    assert "localCheckpoint" not in text and "mkdtemp" not in text and "crossJoin" not in text
