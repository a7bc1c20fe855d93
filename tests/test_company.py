"""The recipes against values worked out by hand on a star of three companies."""

import math

import pytest

from starfold.plans import BASE, CARRY, STACKED, WIDE, company, company_matrix, feature_names, pin_values
from starfold.sources import STAR_SCHEMAS

ROWS = {
    "spine": [(1, 1), (2, 0), (3, None)],
    "entbase": [(1, 99.0, 2.0, 10.0, 5.0), (2, 9.0, 1.0, None, None), (3, None, None, 1.0, 1.0)],
    "alter": [
        (1, "05", "2013-02-01", "10万元", "20万元", 10),
        (1, None, "2014-12-01", "1", "3", 11),
        (1, "01", "2015-01-09", "7", "0", 12),
        (1, "05", "2015-01-20", None, None, 13),
        (2, "05", "2015-03-01", "0", "3000000", 14),
    ],
    "branch": [(1, "x", 1, 2010, None, 1), (1, None, 0, 2008, 2012, 2), (2, "x", None, 2011, 2010, 3)],
    "invest": [(1, 0.5, 1, 2011, None), (1, None, 0, 2013, 2014), (2, None, None, 2012, 2012)],
    "right": [(1, 11, "a", "2012-03-01", None), (1, None, "b", "2010-11-01", "2011-01-01"),
              (2, 30, "c", "2013-05-02", None)],
    "project": [(1, "2012-10-01", 1), (1, "2013-02-01", None)],
    "lawsuit": [(1, "2014-01-01", 100.5), (1, "2013-01-01", None), (2, "2012-06-01", None)],
    "breakfaith": [(1, "2014/3/1", None), (1, "2013/10/1", "2015/1/1")],
    "recruit": [(1, "zp1", "2015-01-01", 3.0), (1, "zp2", "2015-02-01", None), (1, None, "2015-02-01", 1.0)],
}


@pytest.fixture(scope="module")
def star(spark):
    schemas = {k: v for k, v in STAR_SCHEMAS.items() if k in ROWS}
    schemas["spine"] = STAR_SCHEMAS["train"]
    for name in ("alter", "branch"):
        schemas[name] += ", row_id long"
    return {k: spark.createDataFrame(ROWS[k], schemas[k]) for k in ROWS}


def rows(df):
    return {r.EID: r.asDict() for r in df.collect()}


def test_entbase_base(star):
    got = rows(company.entbase_block(star["entbase"], BASE))
    assert set(got) == {1, 2}
    assert got[1] == {"EID": 1, "ZCZB": 1.0, "FINZB": 10.0, "TZINUM": 5.0, "ETYPE_1": 0, "ZCZB_FINZB": -9.0}
    assert got[2]["ZCZB"] == pytest.approx(math.log(10) / math.log(100))
    assert (got[2]["FINZB"], got[2]["TZINUM"], got[2]["ETYPE_1"]) == (0.0, 0.0, 1)


def test_entbase_stacked_fills_capital_with_the_cut_mean(star):
    got = rows(company.entbase_block(star["entbase"], STACKED))
    mean = math.trunc((math.log(100) + math.log(10)) / 2)
    assert got[3]["ZCZB"] == pytest.approx(mean / math.log(100))
    assert (got[3]["ETYPE_0"], got[2]["ETYPE_1"]) == (1, 1)
    assert "ETYPE_2" not in got[3] and "ZCZB_FINZB" not in got[3]


def test_entbase_wide_drops_categories_and_columns(star):
    got = company.entbase_block(star["entbase"], WIDE)
    assert set(got.columns) == {"EID", "ZCZB", "FINZB"}


def test_alter_base(star):
    """Codes by first appearance: 05 -> 0, NULL -> 1, 01 -> 2. The 3,000,000 row is filtered out."""
    got = rows(company.alter_block(star["alter"], BASE))
    assert set(got) == {1}
    top_af, top_be = math.log(21), math.log(11)
    assert {k: got[1][k] for k in ("ALTERNO_0", "ALTERNO_1", "ALTERNO_2", "last_year", "last_month")} == {
        "ALTERNO_0": 2, "ALTERNO_1": 1, "ALTERNO_2": 1, "last_year": 2015, "last_month": 1
    }
    assert got[1]["ALTAF_ALTBE"] == 0.0  # latest month, later row: both amounts missing, hence 0
    carried = rows(company.alter_block(star["alter"].where("row_id < 13"), CARRY))[1]
    assert carried["ALTBE"] == pytest.approx(math.log(8) / top_be)
    assert carried["ALTAF"] == 0.0
    assert carried["ALTAF_ALTBE"] == pytest.approx(-math.log(8) / top_be)
    assert top_af > top_be


def test_alter_wide(star):
    got = rows(company.alter_block(star["alter"].where("row_id <> 13"), WIDE))
    assert got[1]["ALTAF_ALTBE"] == -1  # log1p(0 - 7) has no value; missing is -1 in this block
    assert got[2]["ALTAF_ALTBE"] == pytest.approx(math.log1p(3000000))
    assert (got[1]["first_year"], got[1]["first_month"]) == (2013, 2)
    pinned = WIDE.__class__(**{**WIDE.__dict__, "alter_without": (0, 1)})
    assert [c for c in company.alter_block(star["alter"], pinned).columns if c.startswith("ALTERNO")] == [
        "ALTERNO_2"
    ]


def test_branch(star):
    got = rows(company.branch_block(star["branch"], WIDE))
    assert got[1] == {"EID": 1, "IFHOME": 0.5, "branch_close_rate": 0.5, "bran_lastY": 2010,
                      "bran_firstY": 2008, "year_sub": 2, "branch_count": 1.0, "branch_count_bin": 0}
    assert got[2]["IFHOME"] is None and got[2]["branch_close_rate"] == 0.0
    stacked = rows(company.branch_block(star["branch"], STACKED))
    assert stacked == {1: {"EID": 1, "sub_life": -1, "IFHOME": 0.5, "B_REYEAR": 2009.0}}


def test_right(star):
    got = rows(company.right_block(star["right"], BASE))
    assert got[1] == {"EID": 1, "RIGHTTYPE_11": 1, "RIGHTTYPE_30": 0, "right_count": 2,
                      "right_get_rate": 0.5, "right_last_year": 2012, "right_last_month": 11}
    wide = rows(company.right_block(star["right"], WIDE))
    assert wide[2] == {"EID": 2, "RIGHTTYPE_11": 0, "right_count": 1, "right_get_rate": 0.0, "right": 0.5}


def test_invest(star):
    got = rows(company.invest_block(star["invest"], BASE))
    assert got[1] == {"EID": 1, "BTBL_SUM": 0.5, "BTBL_COUNT": 1, "BTBL_RATIO": 0.5,
                      "invest_home_prob": 0.5, "invest_life_ratio": 0.5, "BTYEAR": 2013}
    assert (got[2]["BTBL_SUM"], got[2]["BTBL_RATIO"], got[2]["invest_home_prob"]) == (0.0, None, None)


def test_project_breakfaith_recruit(star):
    assert rows(company.project_block(star["project"]))[1] == {
        "EID": 1, "DJDATE_Y": 2013, "DJDATE_M": 10, "project_home_prob": 1.0
    }
    assert rows(company.breakfaith_block(star["breakfaith"], WIDE))[1] == {
        "EID": 1, "breakfaith_is_count": 2, "breakfaith_is_sum": 1, "FBDATE_Y": 2013
    }
    assert rows(company.recruit_block(star["recruit"], BASE))[1] == {
        "EID": 1, "WZCODE_zp1": 1, "WZCODE_zp2": 1, "recruit_RECRNUM_sum": 4.0,
        "recruit_RECRNUM_count": 3, "recurt_info_ration": 4 / 3,
    }


def test_money(star):
    wide = rows(company_matrix(star, WIDE))
    assert wide[1]["money_BL"] == pytest.approx(math.log(101.5) / math.log(100))
    assert wide[2]["money_BL"] == 0.0  # all amounts missing: sum 0
    assert wide[3]["money_BL"] == -999
    stacked = rows(company_matrix(star, STACKED))
    assert stacked[1]["money_BL"] == pytest.approx(100.5 / 10000)


@pytest.mark.parametrize("recipe", [BASE, CARRY, WIDE, STACKED], ids=lambda r: r.name)
def test_matrix_has_one_filled_row_per_company(star, recipe):
    matrix = company_matrix(star, recipe)
    got = rows(matrix)
    assert matrix.count() == 3 and {k: v["TARGET"] for k, v in got.items()} == {1: 1, 2: 0, 3: None}
    names = feature_names(matrix)
    assert len(set(names)) == len(names)
    assert all(got[k][n] is not None for k in got for n in names)
    assert got[3]["recruit_RECRNUM_sum"] == -999


def test_pinned_values_fix_the_columns(star):
    pinned = pin_values(star, BASE)
    wanted = company_matrix(star, BASE).columns
    fewer = dict(star, recruit=star["recruit"].where("WZCODE = 'zp1'"), right=star["right"].where("EID = 1"))
    assert company_matrix(fewer, pinned).columns == wanted
    assert company_matrix(fewer, BASE).columns != wanted
