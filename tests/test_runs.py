import random

import pytest

from starfold.plans.runs import RUNS, run_files
from starfold.sources import STAR_FILES


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    """A small company star as CSV, in which big claims mean a positive target."""
    random.seed(11)
    folder = tmp_path_factory.mktemp("csv")
    out = {n: [] for n in STAR_FILES}
    for e in range(1, 121):
        bad = random.random() < 0.4
        if e <= 90:
            out["train"].append(f"{e},{int(bad)}")
        else:
            out["test"].append(f"{e}")
        out["entbase"].append(f"{e},{random.randint(0, 500)},{random.choice(['1', '2', '4', ''])},{random.random():.2f},1,3")
        for _ in range(random.randint(0, 3)):
            out["alter"].append(f"{e},{random.choice(['01', '05', ''])},201{random.randint(0, 5)}-0{random.randint(1, 9)},{random.randint(1, 99)}万元,")
            out["branch"].append(f"{e},x,{random.randint(0, 1)},2010,{random.choice(['', '2012', '2010.0'])}")
            out["right"].append(f"{e},{random.choice(['11', '30', ''])},t,2012-0{random.randint(1, 9)},")
            out["project"].append(f"{e},2013-0{random.randint(1, 9)},0")
            out["breakfaith"].append(f"{e},2014/{random.randint(1, 9)}/1,")
        for _ in range(3):
            amount = 1000 if bad else random.randint(1, 50)
            out["lawsuit"].append(f"{e},2013-0{random.randint(1, 9)},{amount}")
            out["invest"].append(f"{e},0.{random.randint(1, 9)},1,2011,")
            out["recruit"].append(f"{e},{random.choice(['zp1', 'zp2'])},2015-01,{9 if bad else 1}")
    heads = {
        "train": "EID,TARGET", "test": "EID", "entbase": "EID,ZCZB,ETYPE,FINZB,TZINUM,HY",
        "alter": "EID,ALTERNO,ALTDATE,ALTBE,ALTAF", "branch": "EID,TYPECODE,IFHOME,B_REYEAR,B_ENDYEAR",
        "invest": "EID,BTBL,IFHOME,BTYEAR,BTENDYEAR", "right": "EID,RIGHTTYPE,TYPECODE,ASKDATE,FBDATE",
        "project": "EID,DJDATE,IFHOME", "lawsuit": "EID,LAWDATE,LAWAMOUNT",
        "breakfaith": "EID,FBDATE,SXENDDATE", "recruit": "EID,WZCODE,RECDATE,RECRNUM",
    }
    for name, file in STAR_FILES.items():
        (folder / file).write_text("\n".join([heads[name], *out[name]]) + "\n", encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("name", ["base", "wide", "stacked"])
def test_run_from_csv_to_csv(spark, inputs, tmp_path, name):
    run = RUNS[name].sized(rounds=3, depth=2, folds=2)
    outcome = run_files(spark, inputs, str(tmp_path), run)
    scored = spark.read.csv(str(tmp_path / "evaluation_public"), header=True)
    assert scored.columns == ["EID", "FORTARGET", "PROB"]
    got = {int(r.EID): (int(r.FORTARGET), float(r.PROB)) for r in scored.collect()}
    assert sorted(got) == list(range(91, 121))
    assert all(flag == int(p > run.threshold) for flag, p in got.values())
    assert len({p for _, p in got.values()}) > 1
    names = [line.split("\t") for p in (tmp_path / "feature_map").glob("part-*")
             for line in p.read_text().splitlines()]
    assert [int(n[0]) for n in names] == list(range(len(names))) and {n[2] for n in names} == {"q"}
    if name == "stacked":
        assert outcome.importance is None
    else:
        table = spark.read.csv(str(tmp_path / "feature_importance"), header=True).collect()
        assert sum(float(r.fscore) for r in table) == pytest.approx(1)
        assert {r.feature for r in table} <= {n[1] for n in names}
        assert 1 <= len(outcome.history) <= 3


def test_training_rows_without_target_are_not_scored(spark, inputs, tmp_path):
    import shutil

    folder = tmp_path / "in"
    shutil.copytree(inputs, folder)
    train = (folder / "train.csv").read_text().replace("\n5,0\n", "\n5,?\n").replace("\n5,1\n", "\n5,?\n")
    (folder / "train.csv").write_text(train)
    outcome = run_files(spark, str(folder), str(tmp_path / "out"), RUNS["base"].sized(rounds=2, depth=2))
    assert outcome.unreadable == 1
    assert sorted(r.EID for r in outcome.submission.collect()) == list(range(91, 121))


def test_presets():
    assert {n: r.threshold for n, r in RUNS.items()} == {
        "base": 0.222, "carry": 0.222, "wide": 0.271, "stacked": 0.34
    }
    assert RUNS["stacked"].folds * len(RUNS["stacked"].models) + 1 == 17
    assert RUNS["base"].sized(3).models[0].leaves == 128


def test_model_queries_survive_clearing(spark):
    """Fits that read deleted tables are forgotten with them."""
    from starfold.queries import QUERIES
    from starfold.session import clear_scratch

    first = QUERIES["top_features"](spark, "/root/testdata/sf0.001").count()
    clear_scratch(spark)
    assert QUERIES["top_features"](spark, "/root/testdata/sf0.001").count() == first > 0
