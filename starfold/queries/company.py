"""The company recipes, block by block and assembled, over the bound test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.operators.sparse import vector_entries
from starfold.plans import BASE, CARRY, STACKED, WIDE, bindings, company
from starfold.plans.fitted import CATEGORIES, FittedRecipe, fit_recipe
from starfold.plans.incremental import IncrementalStar
from starfold.plans.runs import spine_of
from starfold.queries.registry import query, rounded
from starfold.session import scratch_path
from starfold.sources import STAR_FILES, read_star, table, write_feature_map

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")

ROLES_SQL = """
spine as (
  select c_custkey as EID, case when c_nationkey < 18 then (c_acctbal > 5000)::int end as TARGET
  from customer),
entbase as (
  select c_custkey as EID, case when c_nationkey <> 7 then c_acctbal * 15 end as ZCZB,
         case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3
              when 'HOUSEHOLD' then 4 end as ETYPE,
         case when c_nationkey <> 3 then c_acctbal / 2 end as FINZB,
         c_nationkey::double as TZINUM, (c_nationkey % 5)::double as HY
  from customer),
alter_text as (
  select o_custkey as EID, o_orderkey as row_id, nullif(o_orderpriority, '5-LOW') as ALTERNO,
         strftime(o_orderdate, '%Y-%m-%d') as ALTDATE,
         case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2))::varchar || '万元'
              when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2))::varchar
              when o_orderpriority = '2-HIGH' then 'unknown' end as ALTBE,
         case when o_orderpriority <> '1-URGENT'
              then cast(o_totalprice * 8 as decimal(18,2))::varchar || '万元' end as ALTAF
  from orders),
codes as (
  select ALTERNO, row_number() over (order by min(row_id)) - 1 as code from alter_text group by 1),
change_rows as (
  select a.EID, row_id, code, split_part(ALTDATE, '-', 1)::int as y, split_part(ALTDATE, '-', 2)::int as m,
         try_cast(regexp_replace(coalesce(ALTAF, '0'), '万元$', '') as double) as af,
         try_cast(regexp_replace(coalesce(ALTBE, '0'), '万元$', '') as double) as be
  from alter_text a join codes c on a.ALTERNO is not distinct from c.ALTERNO),
branch as (
  select o_custkey as EID, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_id,
         nullif(l_returnflag, 'N') as TYPECODE,
         case when l_quantity > 5 then (l_linestatus = 'F')::int end as IFHOME,
         year(o_orderdate)::int as B_REYEAR,
         coalesce(case when l_returnflag <> 'R' then year(l_shipdate)::int end, year(o_orderdate)::int)
           - year(o_orderdate)::int as life
  from lineitem join orders on l_orderkey = o_orderkey),
invest as (
  select o_custkey as EID, case when o_orderstatus <> 'P' then o_totalprice end as BTBL,
         case when o_orderpriority <> '3-MEDIUM' then (o_orderstatus = 'F')::int end as IFHOME,
         year(o_orderdate)::int as BTYEAR,
         case o_orderpriority when '1-URGENT' then year(o_orderdate)::int + 1
              when '2-HIGH' then year(o_orderdate)::int end as BTENDYEAR
  from orders),
later as (
  select *, cast(ts as date) + cast(floor(value * 3) as int) as day from events),
rights as (
  select user_id as EID, event_type as TYPECODE, strftime(day, '%Y-%m-%d') as ASKDATE,
         case event_type when 'click' then 11 when 'view' then 12 when 'purchase' then 20
              when 'signup' then 30 end as RIGHTTYPE,
         case when value > 20 then strftime(ts, '%Y-%m-%d') end as FBDATE
  from later),
project as (
  select o_custkey as EID, strftime(o_orderdate, '%Y-%m-%d') as DJDATE, (o_orderstatus = 'O')::int as IFHOME
  from orders),
lawsuit as (
  select user_id as EID, strftime(day, '%Y-%m-%d') as LAWDATE,
         case when event_type <> 'view' then value end as LAWAMOUNT
  from later),
breakfaith as (
  select user_id as EID, strftime(day, '%Y/%m/%d') as FBDATE,
         case when event_type <> 'click' then strftime(ts, '%Y/%m/%d') end as SXENDDATE
  from later),
recruit as (
  select o_custkey as EID, nullif(o_orderpriority, '4-NOT SPECIFIED') as WZCODE,
         case when o_orderstatus <> 'F' then floor(o_totalprice / 10000) end as RECRNUM
  from orders)"""

DOUBLE, WHOLE = "double", "whole"


def _entbase(r, learn=None):
    where = f"where ZCZB < {r.capital_limit}" if r.capital_limit else ""
    learned = f"select ZCZB from entbase {where}" + (f"{' and' if where else ' where'} {learn}" if learn else "")
    null = "ETYPE" if r.etype_null is None else f"coalesce(ETYPE, {r.etype_null:g})"
    values = [v for v in ([1, 2, 3, 4] if r.etype_null is None else [0, 1, 2, 3, 4])
              if v not in r.etype_without]
    dummies = ", ".join(f"coalesce({null} = {v}, false)::int as ETYPE_{v}" for v in values)
    columns = {"ZCZB": DOUBLE, "FINZB": DOUBLE, "TZINUM": DOUBLE, "HY": DOUBLE}
    columns |= {f"ETYPE_{v}": WHOLE for v in values}
    for c in r.entbase_drop:
        del columns[c]
    gap = ""
    if r.capital_gap:
        gap, columns["ZCZB_FINZB"] = ", coalesce(v, m) / top - coalesce(FINZB, 0) as ZCZB_FINZB", DOUBLE
    sql = f"""
      select EID, coalesce(v, m) / top as ZCZB, v as capital_log, coalesce(FINZB, 0) as FINZB, TZINUM, HY,
             {dummies}{gap}
      from (select *, case when ZCZB > -1 then ln(1 + ZCZB) end as v from entbase {where}),
           (select max(ln(1 + ZCZB)) as top, trunc(avg(ln(1 + ZCZB))) as m from
             ({learned}) where ZCZB > -1)"""
    return sql, columns


def _alter(r, learn=None):
    where = f"where af < {r.amount_limit}" if r.amount_limit else ""
    learned = where + (f"{' and' if where else 'where'} {learn}" if learn else "")
    log = "case when {0} > -1 then ln(1 + {0}) end"
    if r.amount_raw:
        stats = f"(select trunc(avg(af)) as maf, trunc(avg(be)) as mbe from change_rows {learned})"
        change = log.format("(coalesce(af, maf) - coalesce(be, mbe))")
        values = f"{change} as ALTAF_ALTBE"
    else:
        pick = "avg" if r.amount_fill == "mean" else "min"
        parts = ", ".join(
            f"max({log.format(c)}) as top_{c}, trunc({pick}({log.format(c)})) as m_{c}" for c in ("af", "be")
        )
        stats = f"(select {parts} from change_rows {learned})"
        sides = {c: f"(coalesce({log.format(c)}, m_{c}) / top_{c})" for c in ("af", "be")}
        values = f"{sides['af']} as ALTAF, {sides['be']} as ALTBE, {sides['af']} - {sides['be']} as ALTAF_ALTBE"
    codes = [i for i in range(5) if i not in r.alter_without]
    columns = {f"ALTERNO_{i}": WHOLE for i in codes}
    columns |= {c: DOUBLE for c in r.alter_carry} | {"last_year": WHOLE, "last_month": WHOLE}
    if r.alter_first:
        columns |= {"first_year": WHOLE, "first_month": WHOLE}
    counts = ", ".join(f"count(*) filter (where code = {i}) as ALTERNO_{i}" for i in codes)
    carried = ", ".join(f"coalesce(arg_max_null({c}, row(y, m, row_id)), -1) as {c}" for c in r.alter_carry)
    sql = f"""
      select EID, {counts}, {carried}, max(y) as last_year, arg_max(m, row(y, m)) as last_month,
             min(y) as first_year, arg_min(m, row(y, m)) as first_month
      from (select *, {values} from change_rows, {stats} {where}) group by 1"""
    return sql, columns


def _largest(count, rows, learn):
    return f"(select max(n) from (select {count} as n from {rows} where {learn} group by EID))"


def _branch(r, learn=None):
    if r.branch_life:
        sql = """
          select EID, arg_min(case when life = 0 then -1 else life end, row_id) as sub_life,
                 avg(IFHOME) as IFHOME, avg(B_REYEAR) as B_REYEAR
          from branch where life >= 0 group by 1"""
        return sql, {"sub_life": WHOLE, "IFHOME": DOUBLE, "B_REYEAR": DOUBLE}
    columns = {"IFHOME": DOUBLE, "branch_close_rate": DOUBLE, "bran_lastY": WHOLE, "bran_firstY": WHOLE,
               "branch_count": DOUBLE, "branch_count_bin": WHOLE}
    if r.branch_span:
        columns["year_sub"] = WHOLE
    top = "max(n) over ()" if learn is None else _largest("count(TYPECODE)", "branch", learn)
    sql = f"""
      select *, n::double / {top} as branch_count, trunc(ln(1 + n))::int as branch_count_bin
      from (select EID, avg(IFHOME) as IFHOME, avg((life > 0)::int) as branch_close_rate,
                   max(B_REYEAR) as bran_lastY, min(B_REYEAR) as bran_firstY,
                   max(B_REYEAR) - min(B_REYEAR) as year_sub, count(TYPECODE) as n
            from branch group by 1)"""
    return sql, columns


def _right(r, learn=None):
    kinds = [k for k in (11, 12, 20, 30) if k not in r.right_without]
    counts = ", ".join(f"count(*) filter (where RIGHTTYPE = {k}) as RIGHTTYPE_{k}" for k in kinds)
    columns = {f"RIGHTTYPE_{k}": WHOLE for k in kinds} | {"right_count": WHOLE, "right_get_rate": DOUBLE}
    columns |= {"right_last_year": WHOLE, "right_last_month": WHOLE} if r.right_dates else {"right": DOUBLE}
    top = "max(right_count) over ()" if learn is None else _largest("count(*)", "rights", learn)
    sql = f"""
      select *, right_count::double / {top} as "right" from (
        select EID, {counts}, count(*) as right_count, count(FBDATE)::double / count(*) as right_get_rate,
               max(split_part(ASKDATE, '-', 1)::int) as right_last_year,
               max(split_part(ASKDATE, '-', 2)::int) as right_last_month
        from rights group by 1)"""
    return sql, columns


def _invest(r, learn=None):
    sql = f"""
      select EID, coalesce(sum(BTBL::decimal(28,10))::double, 0) as BTBL_SUM, count(BTBL) as BTBL_COUNT,
             sum(BTBL::decimal(28,10))::double / nullif(count(BTBL), 0) as BTBL_RATIO,
             avg(IFHOME) as invest_home_prob,
             avg((coalesce(BTENDYEAR, BTYEAR) > BTYEAR)::int) as {r.invest_life}, max(BTYEAR) as BTYEAR
      from invest group by 1"""
    columns = {"BTBL_SUM": DOUBLE, "BTBL_COUNT": WHOLE, "BTBL_RATIO": DOUBLE, "invest_home_prob": DOUBLE}
    return sql, columns | {r.invest_life: DOUBLE, "BTYEAR": WHOLE}


def _project(r, learn=None):
    sql = """
      select EID, max(split_part(DJDATE, '-', 1)::int) as DJDATE_Y,
             max(split_part(DJDATE, '-', 2)::int) as DJDATE_M, avg(IFHOME) as project_home_prob
      from project group by 1"""
    return sql, {"DJDATE_Y": WHOLE, "DJDATE_M": WHOLE, "project_home_prob": DOUBLE}


def _lawsuit(r, learn=None):
    sql = """
      select EID, count(LAWAMOUNT) as lawsuit_LAWAMOUNT_count,
             max(split_part(LAWDATE, '-', 1)::int) as LAWDATE_Y,
             coalesce(sum(LAWAMOUNT), 0) as claims
      from lawsuit group by 1"""
    return sql, {"lawsuit_LAWAMOUNT_count": WHOLE, "LAWDATE_Y": WHOLE}


def _breakfaith(r, learn=None):
    columns = {"breakfaith_is_count": WHOLE}
    if r.breakfaith_more:
        columns |= {"breakfaith_is_sum": WHOLE, "FBDATE_Y": WHOLE}
    sql = """
      select EID, count(*) as breakfaith_is_count, count(SXENDDATE) as breakfaith_is_sum,
             min(split_part(FBDATE, '/', 1)::int) as FBDATE_Y
      from breakfaith group by 1"""
    return sql, columns


def _recruit(r, learn=None):
    counts = ", ".join(f"count(*) filter (where WZCODE = '{p}') as \"WZCODE_{p}\"" for p in PRIORITIES)
    columns = {f"WZCODE_{p}": WHOLE for p in PRIORITIES}
    columns |= {"recruit_RECRNUM_sum": DOUBLE, "recruit_RECRNUM_count": WHOLE}
    if r.recruit_mean:
        columns["recurt_info_ration"] = DOUBLE
    total = "coalesce(sum(RECRNUM), 0)"
    sql = f"""
      select EID, {counts}, {total} as recruit_RECRNUM_sum, count(*) as recruit_RECRNUM_count,
             {total} / count(*) as recurt_info_ration
      from recruit group by 1"""
    return sql, columns


BLOCKS_SQL = {
    "entbase": _entbase,
    "alter": _alter,
    "branch": _branch,
    "right": _right,
    "invest": _invest,
    "project": _project,
    "lawsuit": _lawsuit,
    "breakfaith": _breakfaith,
    "recruit": _recruit,
}


def _shown(columns, fill=None, places=6):
    out = []
    for name, kind in columns.items():
        text = f'"{name}"' if fill is None else f'coalesce("{name}", {fill})'
        out.append((f"round({text}, {places})" if kind == DOUBLE else text) + f' as "{name}"')
    return ", ".join(out)


def block_sql(name, recipe):
    sql, columns = BLOCKS_SQL[name](recipe)
    return f"with {ROLES_SQL} select EID, {_shown(columns)} from ({sql})"


EVEN, ODD = "EID % 2 = 0", "EID % 2 = 1"


def roles_sql(learn=None):
    """The bound tables; with ``learn`` the codes of ALTERNO come from the rows it keeps."""
    if learn is None:
        return ROLES_SQL
    codes = ROLES_SQL.replace("from alter_text group by 1", f"from alter_text where {learn} group by 1")
    return codes.replace("from alter_text a join codes c", "from alter_text a left join codes c")


def matrix_sql(recipe, learn=None, apply=None):
    """Every feature of a recipe; ``learn`` and ``apply`` keep the companies learned from and shown."""
    parts, joins, columns = [roles_sql(learn)], [], {}
    for name, build in BLOCKS_SQL.items():
        sql, found = build(recipe, learn)
        parts.append(f"b_{name} as ({sql})")
        joins.append(f"left join b_{name} using (EID)")
        columns |= {f"{c}": k for c, k in found.items()}
    money = ""
    if recipe.money:
        columns["money_BL"] = DOUBLE
        top = "claims / nullif(ZCZB, 0) / 10000" if recipe.money == "scaled" else (
            "case when claims > -1 then ln(1 + claims) end / nullif(capital_log, 0)")
        money = f", {top} as money_BL"
    wide = f"select *{money} from spine {' '.join(joins)}" + (f" where {apply}" if apply else "")
    return f"with {', '.join(parts)} select EID, TARGET, {_shown(columns, -999)} from ({wide})"


def _block_query(block, recipe):
    build = getattr(company, f"{block}_block")

    def run(spark, sf):
        return rounded(build(bindings.company_table(spark, sf, block), recipe))

    run.__doc__ = build.__doc__
    return run


def _matrix_query(recipe):
    def run(spark, sf):
        return rounded(company.company_matrix(bindings.company_star(spark, sf), recipe))

    run.__doc__ = f"Every feature of the {recipe.name} recipe on the spine."
    return run


VARIANTS = {
    "entbase": (BASE, WIDE, STACKED),
    "alter": (BASE, CARRY, WIDE, STACKED),
    "branch": (BASE, WIDE, STACKED),
    "right": (BASE, WIDE),
    "invest": (BASE, WIDE),
    "project": (BASE,),
    "lawsuit": (BASE,),
    "breakfaith": (BASE, WIDE),
    "recruit": (BASE, WIDE),
}
for _block, _recipes in VARIANTS.items():
    for _recipe in _recipes:
        query(f"company_{_block}_{_recipe.name}", block_sql(_block, _recipe))(
            _block_query(_block, _recipe)
        )
for _recipe in (BASE, CARRY, WIDE, STACKED):
    query(f"company_matrix_{_recipe.name}", matrix_sql(_recipe))(_matrix_query(_recipe))


@query(
    "company_lawsuit_amounts",
    f"""with {ROLES_SQL}, s as (
        select EID, coalesce(sum(LAWAMOUNT), 0) as total,
               count(LAWAMOUNT) as n, max(split_part(LAWDATE, '-', 1)::int) as y,
               max(split_part(LAWDATE, '-', 2)::int) as m
        from lawsuit group by 1)
      select EID, n as lawsuit_LAWAMOUNT_count, round(total / nullif(n, 0), 6) as lawsuit_LAWAMOUNT_avg,
             y as LAWDATE_Y, m as LAWDATE_M, trunc(ln(1 + total))::int as lawsuit_LAWAMOUNT_sum,
             round(ln(1 + total), 6) as money_sum
      from s""",
)
def lawsuit_amounts(spark, sf):
    return rounded(company.lawsuit_amounts(bindings.company_table(spark, sf, "lawsuit")))


def _half(spark, sf, keep):
    return {name: rows.where(keep) for name, rows in bindings.company_star(spark, sf).items()}


def learned_sql(recipe):
    """What a recipe learns from the even companies, as the stored table shows it."""
    where = f"where {EVEN}" + (f" and ZCZB < {recipe.capital_limit}" if recipe.capital_limit else "")
    null = "ETYPE" if recipe.etype_null is None else f"coalesce(ETYPE, {recipe.etype_null:g})"
    amounts = f"change_rows where {EVEN}" + (f" and af < {recipe.amount_limit}" if recipe.amount_limit else "")
    parts = []

    def stats(name, source, value):
        logged = f"(select ln(1 + {value}) as v from {source} and {value} > -1)"
        parts.extend(
            f"select 'scalar {name}.{k}' as item, 0::bigint as position, (select {f}(v) from {logged}) as number, null as text"
            for k, f in (("top", "max"), ("mean", "avg"), ("low", "min"))
        )

    def one(name, value):
        parts.append(f"select 'scalar {name}', 0::bigint, ({value})::double, null")

    def codes(column, value, source, order):
        rank = f"row_number() over (order by {order}) - 1"
        parts.append(f"select 'code {column}', {rank}, null, {value}::varchar from {source} group by {value}")

    stats("ZCZB", f"entbase {where}", "ZCZB")
    for column, value in (("ALTAF", "af"), ("ALTBE", "be")):
        if recipe.amount_raw:
            one(f"{column}.mean", f"select avg({value}) from {amounts}")
        else:
            stats(column, amounts, value)
    if not recipe.branch_life:
        one("branch_count.top", f"select {_largest('count(TYPECODE)', 'branch', EVEN)}")
    if not recipe.right_dates:
        one("right.top", f"select {_largest('count(*)', 'rights', EVEN)}")
    codes("ETYPE", f"({null})::double", f"entbase {where} and {null} is not null", f"({null})::double")
    codes("ALTERNO", "ALTERNO", f"alter_text where {EVEN}", "min(row_id)")
    codes("RIGHTTYPE", "RIGHTTYPE", f"rights where {EVEN} and RIGHTTYPE is not null", "RIGHTTYPE")
    codes("WZCODE", "WZCODE", f"recruit where {EVEN} and WZCODE is not null", "WZCODE")
    rows = " union all ".join(parts)
    return f"with {ROLES_SQL} select item, position, round(number, 6) as number, text from ({rows})"


def _learn_query(recipe):
    def run(spark, sf):
        learned = fit_recipe(_half(spark, sf, EVEN), recipe).table()
        return rounded(learned.where(~F.col("item").startswith("option ")))

    run.__doc__ = f"What the {recipe.name} recipe learns from the even companies: scalars and codes."
    return run


def _apply_query(recipe):
    def run(spark, sf):
        path = scratch_path(spark, "recipe")
        fit_recipe(_half(spark, sf, EVEN), recipe).save(path)
        return rounded(FittedRecipe.load(spark, path).matrix(_half(spark, sf, ODD)))

    run.__doc__ = f"The {recipe.name} recipe learned from even companies, stored, and applied to odd ones."
    return run


for _recipe in (BASE, WIDE, STACKED):
    _suffix = "" if _recipe is BASE else f"_{_recipe.name}"
    query(f"recipe_fit{_suffix}", learned_sql(_recipe))(_learn_query(_recipe))
    query(f"recipe_apply{_suffix}", matrix_sql(_recipe, EVEN, ODD))(_apply_query(_recipe))


def _slice(rows):
    """0 or 1 from the content of a row; its place is not moved for this alone."""
    return F.pmod(F.xxhash64(*[c for c in rows.columns if c != "row_id"]), F.lit(2))


@query("company_matrix_merged", matrix_sql(BASE))
def company_matrix_merged(spark, sf):
    """The base recipe from the stored states of two slices of every child table."""
    star = bindings.company_star(spark, sf)
    held = IncrementalStar(spark, scratch_path(spark, "star-states"), fit_recipe(star, BASE), star)
    held.put_slices(["s0", "s1"], star, _slice)
    return rounded(held.matrix(star["spine"], star["entbase"]))


@query(
    "company_feature_names",
    f"""with {ROLES_SQL}, t as (
          select 1 as part, row_number() over (order by ETYPE) as k, 'ETYPE_' || ETYPE::int as feature
            from entbase where ZCZB < {BASE.capital_limit} and ETYPE <> 2 group by ETYPE
          union all select 2, code, 'ALTERNO_' || code from codes
          union all select 3, row_number() over (order by RIGHTTYPE), 'RIGHTTYPE_' || RIGHTTYPE
            from rights where RIGHTTYPE is not null group by RIGHTTYPE
          union all select 4, row_number() over (order by WZCODE), 'WZCODE_' || WZCODE
            from recruit where WZCODE is not null group by WZCODE)
        select (row_number() over (order by part, k) - 1)::int as place, feature, 'q' as kind from t""",
)
def category_feature_names(spark, sf):
    """The sparse end of the feature list of the base recipe, written and read as a feature map."""
    star = bindings.company_star(spark, sf)
    names = fit_recipe(star, BASE).vectors(star)[1]
    path = scratch_path(spark, "feature-map")
    write_feature_map(names.orderBy("index"), path)
    read = spark.read.schema("index int, feature string, kind string").csv(path, sep="\t")
    found = read.where(F.split("feature", "_")[0].isin(*CATEGORIES))
    first = found.agg(F.min("index")).scalar()
    return found.select((F.col("index") - first).alias("place"), "feature", "kind")


def entries_sql(recipe):
    """The matrix as rows (EID, feature, value); an absent category count has no row."""
    sql = matrix_sql(recipe)
    columns = {}
    for build in BLOCKS_SQL.values():
        columns |= build(recipe)[1]
    if recipe.money:
        columns["money_BL"] = DOUBLE
    parts = []
    for c in columns:
        keep = f' where "{c}" > 0' if c.startswith(("ETYPE_", "ALTERNO_", "RIGHTTYPE_", "WZCODE_")) else ""
        parts.append(f"select EID, '{c}' as feature, \"{c}\"::double as value from m{keep}")
    return f"with m as ({sql}) {' union all '.join(parts)}"


def _entries_query(recipe):
    def run(spark, sf):
        star = bindings.company_star(spark, sf)
        rows, names = fit_recipe(star, recipe).vectors(star)
        entries = vector_entries(rows, "EID", "features")
        return rounded(entries.join(names, "index").select("EID", "feature", "value"))

    run.__doc__ = f"The feature vectors of the {recipe.name} recipe, entry by entry; categories may be any width."
    return run


for _recipe in (BASE, CARRY, WIDE, STACKED):
    query(f"company_vectors_{_recipe.name}", entries_sql(_recipe))(_entries_query(_recipe))


def _lists(spark, sf):
    """The two company lists: the target of some training companies cannot be read."""
    spine = bindings.company_table(spark, sf, "spine")
    known = F.col("TARGET").isNotNull()
    train = spine.where(known).withColumn("TARGET", F.when(F.col("EID") % 50 != 0, F.col("TARGET")))
    return train, spine.where(~known)


@query(
    "spine_split",
    f"""with {ROLES_SQL}
        select EID, case when EID % 50 <> 0 then TARGET end as TARGET,
               case when TARGET is null then 'test' else 'train' end as split from spine""",
)
def spine_split(spark, sf):
    """Both lists as one spine; a training row without readable target stays a training row."""
    return spine_of(*_lists(spark, sf))


CSV_PARTS = 3
CSV_ROWS = 500_000


def _parts(spark, sf, role):
    """Files of a table: several, and more as its rows grow, so that no task sorts or writes a fixed share."""
    source = bindings.SOURCES.get(role, ("customer",))[0]
    return max(CSV_PARTS, -(-table(spark, sf, source).count() // CSV_ROWS))


def _write_star(spark, sf):
    """The bound tables as CSV folders of several files; ordered tables keep their row order."""
    folder = scratch_path(spark, "csv-star")
    star = bindings.company_star(spark, sf)
    spine = star.pop("spine")
    known = F.col("TARGET").isNotNull()
    star |= {"train": spine.where(known), "test": spine.where(~known).select("EID")}
    for name, rows in star.items():
        count = _parts(spark, sf, name)
        parts = rows.repartition(count)
        if "row_id" in rows.columns:
            parts = rows.repartitionByRange(count, "row_id").sortWithinPartitions("row_id").drop("row_id")
        parts.write.csv(f"{folder}/{STAR_FILES[name]}", header=True)
    return folder


@query("csv_star_run", matrix_sql(BASE))
def csv_star_run(spark, sf):
    """Every feature of the base recipe, from CSV files: eleven tables of several files each."""
    star = read_star(spark, _write_star(spark, sf))
    spine = spine_of(star["train"], star["test"])
    return rounded(company.company_matrix(star | {"spine": spine}).drop("split"))
