import math

import pytest
from pyspark.sql import functions as F

from starfold.models import feature_map
from starfold.plans.company import WIDE, alter_block
from starfold.sources import (
    STAR_FILES,
    STAR_SCHEMAS,
    read_csv,
    read_star,
    write_feature_map,
    write_importance,
    write_scored,
)


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_csv_is_matched_by_name(spark, tmp_path):
    path = put(tmp_path, "a.csv", "B_ENDYEAR,EID,extra,note\n2015.0,1,2.5,x\n,2,nan,y\nbad,3,1,z\n")
    df = read_csv(spark, path, "EID long, B_ENDYEAR int", other="double")
    assert df.dtypes == [("EID", "bigint"), ("B_ENDYEAR", "int"), ("extra", "double"), ("note", "double")]
    assert sorted(map(tuple, df.collect())) == [(1, 2015, 2.5, None), (2, None, None, None), (3, None, 1.0, None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, path, "EID long, B_ENDYEAR int", strict=True).collect()


def test_row_key_follows_the_file(spark, tmp_path):
    text = "EID,v\n" + "".join(f"{i % 3},{i}\n" for i in range(5000))
    path = put(tmp_path, "rows.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv(spark, path, "EID long, v int", row_key="row_id")
        assert df.rdd.getNumPartitions() > 3
        assert [r.v for r in df.repartition(7).orderBy("row_id").collect()] == list(range(5000))
        first = df.groupBy("EID").agg(F.min_by("v", "row_id").alias("v")).collect()
        assert sorted(map(tuple, first)) == [(0, 0), (1, 1), (2, 2)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_key_over_several_files(spark, tmp_path):
    for part in range(3):
        put(tmp_path, f"part-{part}.csv", "EID,v\n" + "".join(f"1,{part * 10 + i}\n" for i in range(10)))
    df = read_csv(spark, str(tmp_path), "EID long, v int", row_key="row_id")
    assert [r.v for r in df.repartition(5).orderBy("row_id").collect()] == list(range(30))


@pytest.mark.parametrize("files", [1, 3])
def test_row_key_keeps_hash_aggregation(spark, tmp_path, files):
    lines = ["1,a,2013-12,0,0\n", "1,a,2014-05,1,2\n", "1,b,2014-05,3,9\n"]
    for i in range(files):
        own = lines if files == 1 else lines[i : i + 1]
        put(tmp_path, f"part {i}.csv", "EID,ALTERNO,ALTDATE,ALTBE,ALTAF\n" + "".join(own))
    df = read_csv(spark, str(tmp_path), STAR_SCHEMAS["alter"], row_key="row_id")
    assert df.schema["row_id"].dataType.simpleString() == "decimal(28,0)"
    block = alter_block(df, WIDE)
    assert "SortAggregate" not in block._jdf.queryExecution().executedPlan().toString()
    assert block.first().ALTAF_ALTBE == pytest.approx(math.log1p(9 - 3))


def test_another_header_raises_instead_of_swapping(spark, tmp_path):
    put(tmp_path, "a.csv", "EID,X,Y\n1,10,20\n")
    put(tmp_path, "b.csv", "EID,Y,X\n2,20,10\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path), "EID long, X int, Y int").collect()


def test_star_reader_finds_all_tables(spark, tmp_path):
    heads = {
        "train": "EID,TARGET\n1,1\n", "test": "EID\n2\n", "entbase": "EID,ZCZB,ETYPE,FINZB,TZINUM,HY\n1,5,2,,1,9\n",
        "alter": "EID,ALTERNO,ALTDATE,ALTBE,ALTAF\n1,01,2014-05,10万元,\n",
        "branch": "EID,TYPECODE,IFHOME,B_REYEAR,B_ENDYEAR\n1,9,1,2010,\n",
        "invest": "EID,BTBL,IFHOME,BTYEAR,BTENDYEAR\n1,0.5,1,2010,\n",
        "right": "EID,RIGHTTYPE,TYPECODE,ASKDATE,FBDATE\n1,11,x,2012-01,\n",
        "project": "EID,DJDATE,IFHOME\n1,2013-04,0\n", "lawsuit": "EID,LAWDATE,LAWAMOUNT\n1,2013-04,100\n",
        "breakfaith": "EID,FBDATE,SXENDDATE\n1,2013/4/1,\n", "recruit": "EID,WZCODE,RECDATE,RECRNUM\n1,zp1,2015-06,\n",
    }
    for name, file in STAR_FILES.items():
        put(tmp_path, file, heads[name])
    star = read_star(spark, str(tmp_path))
    assert set(star) == set(STAR_FILES)
    assert star["entbase"].first().HY == 9.0
    row = star["alter"].first()
    assert (row.ALTERNO, row.ALTBE, row.ALTAF) == ("01", "10万元", None)


def test_sinks(spark, tmp_path):
    scored = spark.createDataFrame([(1, "1e-08", 0)], "EID long, PROB string, FORTARGET int")
    write_scored(scored.coalesce(1), str(tmp_path / "s"))
    lines = [p.read_text() for p in (tmp_path / "s").glob("part-*.csv")]
    assert "".join(lines) == "EID,FORTARGET,PROB\n1,0,1e-08\n"

    write_feature_map(feature_map(spark, ["a", "b"]), str(tmp_path / "m"))
    (only,) = (tmp_path / "m").glob("part-*.csv")
    assert only.read_text() == "0\ta\tq\n1\tb\tq\n"

    importance = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "feature string, fscore double")
    write_importance(importance, str(tmp_path / "i"))
    (only,) = (tmp_path / "i").glob("part-*.csv")
    assert only.read_text() == "feature,fscore\na,0.25\nb,0.75\n"
