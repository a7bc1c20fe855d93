"""Declared types of the company star: two spines, one 1:1 table, eight 1:n tables."""

from __future__ import annotations

# File names and column types of the input data set.
STAR_FILES = {
    "train": "train.csv",
    "test": "evaluation_public.csv",
    "entbase": "1entbase.csv",
    "alter": "2alter.csv",
    "branch": "3branch.csv",
    "invest": "4invest.csv",
    "right": "5right.csv",
    "project": "6project.csv",
    "lawsuit": "7lawsuit.csv",
    "breakfaith": "8breakfaith.csv",
    "recruit": "9recruit.csv",
}
STAR_SCHEMAS = {
    "train": "EID long, TARGET int",
    "test": "EID long",
    "entbase": "EID long, ZCZB double, ETYPE double, FINZB double, TZINUM double",
    "alter": "EID long, ALTERNO string, ALTDATE string, ALTBE string, ALTAF string",
    "branch": "EID long, TYPECODE string, IFHOME int, B_REYEAR int, B_ENDYEAR int",
    "invest": "EID long, BTBL double, IFHOME int, BTYEAR int, BTENDYEAR int",
    "right": "EID long, RIGHTTYPE int, TYPECODE string, ASKDATE string, FBDATE string",
    "project": "EID long, DJDATE string, IFHOME int",
    "lawsuit": "EID long, LAWDATE string, LAWAMOUNT double",
    "breakfaith": "EID long, FBDATE string, SXENDDATE string",
    "recruit": "EID long, WZCODE string, RECDATE string, RECRNUM double",
}

# Columns of the test tables read here, so that no footer has to be opened to plan.
TABLE_SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}
