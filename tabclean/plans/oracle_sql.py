"""DuckDB SQL computing the same results as ``tabclean.plans.registry``.

The tables are DuckDB views over the same parquet files; dirty tables are
built by the same SQL as on the Spark side. Schema-level decisions that SQL
cannot make (which column is coerced, dropped as an id, one-hot values) are
written out for the given data; every statistic is computed by the SQL.
"""

from __future__ import annotations

from tabclean.functions.text import MISSING_MARKERS
from tabclean.plans.registry import FILE_ROWS, FILTER_RULES
from tabclean.plans.suggest import (FLAG_WORDS, REASON_DATE, REASON_DEFAULT, REASON_DUPLICATE, REASON_ENCODE,
                                    REASON_MISSING, REASON_OUTLIER, REASON_SCALE)
from tabclean.operators import profile as P
from tabclean.sources.csv import REASON_SUFFIX
from tabclean.sources.tables import (BIG_ORDERS_SQL, BOOLEAN_ORDERS_SQL, DOTTED_PART_SQL, EXACT_ORDERS_SQL, ODD_NAMES_SQL, INF_EVENTS_SQL, NAMED_ORDERS_SQL,
                                     ODD_ORDERS_SQL, SKEWED_ORDERS_SQL, WIDE_COLUMNS, WIDE_PART_SQL, duckdb_sql_of, duckdb_text)

DUCK_DATE_FORMATS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S",
                     "%Y-%m-%d %H:%M:%S.%f", "%m/%d/%Y", "%b %d, %Y", "%Y%m%d")
NUM_RE = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    s = strip(x)
    markers = ", ".join(lit(m) for m in MISSING_MARKERS)
    return f"(case when lower({s}) in ({markers}) then null else {s} end)"


def num(x: str) -> str:
    s = strip(x)
    return (f"(case when regexp_full_match({s}, '{NUM_RE}') and not isinf(try_cast({s} as double)) "
            f"then try_cast({s} as double) end)")


def date(x: str) -> str:
    s = strip(x)
    return "coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in DUCK_DATE_FORMATS) + ")"


def pyround(x: str, digits: int = 4) -> str:
    """Python's round() of a double in [0, 1]: half-even on the exact binary value.

    ``x * 2^93`` is an exact integer for any ratio >= 2^-40, so the decision
    is made in HUGEINT arithmetic (DuckDB's own round and its double to
    decimal cast both differ from Python on ties such as 2499 / 60000).
    """
    den = "power(2, 93)::hugeint"
    num = f"(({x}) * power(2, 93))::hugeint * {10 ** digits}"
    r0 = f"({num} // {den})"
    rem = f"({num} - {r0} * {den})"
    return (f"(({r0} + case when 2 * {rem} > {den} then 1 when 2 * {rem} = {den} then {r0} % 2 else 0 end)"
            f"::double / {10 ** digits})")


def sig(x: str) -> str:
    """A double to 9 decimals, then 10 significant digits (same text form as Spark's format_string)."""
    return f"cast(printf('%.9e', round({x}, 9) + 0.0) as double)"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


DIRTY_ORDERS = f"d as ({duckdb_sql_of('dirty_orders')})"
DN = f"dn as (select o_orderkey, price, {norm('prio')} as prio, odate, {num(norm('cust_txt'))} as cust_txt from d)"
DN_OUT = f"o_orderkey, {sig('price')} as price, prio, {ts('odate')} as odate, {sig('cust_txt')} as cust_txt"

ORDERS_COLS = [("o_orderkey", "int"), ("price", "double"), ("prio", "text"), ("odate", "datetime"),
               ("cust_txt", "text")]
LINEITEM_COLS = [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "text"), ("l_linestatus", "text"),
                 ("l_shipdate", "datetime")]
CUSTOMER_COLS = [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "text")]
DOCUMENTS_COLS = [("doc_id", "int"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "int")]
EVENTS_COLS = [("event_id", "int"), ("ts", "datetime"), ("user_id", "int"), ("event_type", "text"),
               ("value", "double"), ("props", "text")]


def _type_expr(kind: str) -> str:
    if kind == "text":
        return ("case when nn = 0 then 'unknown' when nd::double / nn > 0.8 then 'datetime' "
                "when nnum::double / nn > 0.9 then 'numeric' else 'text' end")
    base = {"int": "numeric", "double": "numeric", "datetime": "datetime", "bool": "boolean"}[kind]
    return f"case when nn = 0 then 'unknown' else '{base}' end"


def prof_cte(src: str, cols) -> str:
    """``prof``: one row per column with counts, exact ratios, type and number stats."""
    parts = []
    for i, (name, kind) in enumerate(cols):
        c = qi(name)
        x = num(c) if kind == "text" else (f"{c}::double" if kind in ("int", "double") else "null::double")
        nd = f"count({date(c)})" if kind == "text" else "0"
        nnum = f"count({num(c)})" if kind == "text" else "0"
        parts.append(
            f"select {i} as ordinal, {lit(name)} as name, *, {_type_expr(kind)} as t, "
            f"case when n = 0 then 0.0 else (n - nn)::double / n end as mr, d::double / greatest(n, 1) as ur "
            f"from (select count(*) as n, count({c}) as nn, count(distinct {c}) as d, {nd} as nd, "
            f"{nnum} as nnum, avg({x}) as mean, stddev_samp({x}) as std, min({x}) as mn, max({x}) as mx, "
            f"skewness({x}) as sk, count({x}) as xn from {src})")
    body = " union all ".join(parts)
    return (f"prof0 as ({body}), prof as (select *, (ur > 0.95 and mr < 0.05 and t in ('numeric', 'text')) "
            f"as possible_id from prof0)")


def _hint() -> str:
    return (f"case when t = 'numeric' then (case when xn = 0 then {lit(P.HINT_NO_NUMERIC)} "
            f"when coalesce(sk, 0) > 1 then {lit(P.HINT_RIGHT)} when coalesce(sk, 0) < -1 then {lit(P.HINT_LEFT)} "
            f"else {lit(P.HINT_BALANCED)} end) "
            f"when t = 'text' then (case when d <= 10 then {lit(P.HINT_LOW_CARD)} else {lit(P.HINT_HIGH_CARD)} end) "
            f"when t = 'datetime' then {lit(P.HINT_TEMPORAL)} else {lit(P.HINT_LIMITED)} end")


def profile_sql(prefix_ctes: str, src: str, cols) -> str:
    stat = lambda s: f"case when t = 'numeric' then {sig(s)} end"
    return (f"with {prefix_ctes}{prof_cte(src, cols)} "
            f"select ordinal, name, t as inferred_type, {pyround('mr')} as missing_ratio, {pyround('ur')} as unique_ratio, "
            f"(n - d - case when nn < n then 1 else 0 end)::bigint as duplicate_count, possible_id, "
            f"{stat('mean')} as mean, {stat('std')} as std, {stat('mn')} as min, {stat('mx')} as max, "
            f"{_hint()} as distribution_hint from prof")


def top_values_sql(prefix_ctes: str, src: str, cols) -> str:
    parts = []
    for name, kind in cols:
        c = qi(name)
        if kind in ("int", "double"):
            key, sk = f"cast({c} as varchar)", f"{c}::double"
        elif kind == "datetime":
            key = (f"case when epoch_us({c}) % 1000000 = 0 then strftime({c}, '%Y-%m-%d %H:%M:%S') "
                   f"else strftime({c}, '%Y-%m-%d %H:%M:%S.%f') end")
            sk = "null::double"
        else:
            key, sk = c, "null::double"
        parts.append(
            f"select {lit(name)} as name, rank::int as rank, v as value, cnt as count from ("
            f"select v, cnt, row_number() over (order by cnt desc, sk asc nulls last, v asc nulls last) as rank "
            f"from (select {key} as v, {sk} as sk, count(*) as cnt from {src} group by all) g) r where rank <= 5")
    return f"with {prefix_ctes.rstrip(', ')} " + " union all ".join(parts) if prefix_ctes else " union all ".join(parts)


def summary_sql(prefix_ctes: str, src: str, cols) -> str:
    return (f"with {prefix_ctes}{prof_cte(src, cols)} select "
            f"(select count(*) from {src})::bigint as rows, {len(cols)}::bigint as columns, "
            f"(select sum(n - nn) from prof)::bigint as missing_cells, "
            f"((select count(*) from {src}) - (select count(*) from (select distinct * from {src})))::bigint "
            f"as duplicate_rows, "
            f"(select count(*) from prof where t = 'numeric')::bigint as numeric_columns, "
            f"(select count(*) from prof where t = 'text')::bigint as categorical_columns, "
            f"(select count(*) from prof where t = 'datetime')::bigint as datetime_columns")


def infer_sql() -> str:
    parts = []
    for i, (name, kind) in enumerate(ORDERS_COLS):
        c = qi(name)
        nd = f"count({date(c)})" if kind == "text" else "0::bigint"
        nnum = f"count({num(c)})" if kind == "text" else "0::bigint"
        parts.append(f"select {i} as ordinal, {lit(name)} as name, nn as non_missing, nd as parsed_dates, "
                     f"nnum as parsed_numbers, {_type_expr(kind)} as inferred_type "
                     f"from (select count({c}) as nn, {nd} as nd, {nnum} as nnum from d)")
    return f"with {DIRTY_ORDERS} " + " union all ".join(parts)


def _mode(col: str, src: str) -> str:
    return f"(select {col} from {src} where {col} is not null group by {col} order by count(*) desc, {col} limit 1)"


def fill_sql(numeric: str, text: str) -> str:
    if numeric == "mean":
        nexpr = lambda c: f"coalesce({c}, (select avg({c}) from dn))"
    elif numeric == "median":
        nexpr = lambda c: f"coalesce({c}, (select median({c}) from dn))"
    elif numeric == "zero":
        nexpr = lambda c: f"coalesce({c}, 0.0)"
    else:
        nexpr = lambda c: c
    if text == "mode":
        prio = f"coalesce(prio, {_mode('prio', 'dn')})"
    elif text == "constant":
        prio = "coalesce(prio, 'unknown')"
    else:
        prio = "prio"
    return (f"with {DIRTY_ORDERS}, {DN} select o_orderkey, {sig(nexpr('price'))} as price, {prio} as prio, "
            f"{ts('coalesce(odate, ' + _mode('odate', 'dn') + ')')} as odate, "
            f"{sig(nexpr('cust_txt'))} as cust_txt from dn")


def filter_sql(name: str) -> str:
    text = lambda c: f"coalesce({c}, 'nan')"
    conds = {
        "filter_eq": f"{text('prio')} = '1-URGENT'",
        "filter_eq_num": "cust_txt = 605.0",
        "filter_ne": "cust_txt is distinct from 605.0",
        "filter_ne_text": f"{text('prio')} <> '2-HIGH'",
        "filter_gt": "price > 250000.0",
        "filter_lt": "cust_txt < 100.0",
        "filter_contains": f"regexp_matches({text('prio')}, 'URG|na')",
        "filter_contains_num": rf"regexp_matches({text('cast(price as varchar)')}, '\.5')",
        "filter_date": "coalesce(strftime(odate, '%Y-%m-%d'), 'NaT') = '1996-01-02'",
        "filter_date_gt": "odate > timestamp '1996-01-02' and odate < timestamp '1997-06-30'",
        "filter_empty_rules": "price < 300000.0",
        "filter_all": (f"regexp_matches({text('prio')}, 'HIGH|URG') and price > 1000.0 "
                       f"and cust_txt is distinct from 605.0"),
    }
    return f"with {DIRTY_ORDERS}, {DN} select {DN_OUT} from dn where {conds[name]}"


def auto_clean_ctes() -> str:
    return (f"{DIRTY_ORDERS}, {DN}, "
            # o_orderkey is an id (unique ratio 0.952), so it is dropped before the dedupe
            f"a1 as (select distinct price, prio, odate, cust_txt from dn), "
            f"a2 as (select distinct coalesce(price, (select median(price) from a1)) as price, "
            f"coalesce(prio, {_mode('prio', 'a1')}) as prio, coalesce(odate, {_mode('odate', 'a1')}) as odate, "
            f"coalesce(cust_txt, (select median(cust_txt) from a1)) as cust_txt from a1)")


def auto_clean_sql() -> str:
    return (f"with {auto_clean_ctes()} select {sig('price')} as price, prio, {ts('odate')} as odate, "
            f"{sig('cust_txt')} as cust_txt from a2")


PRIO_VALUES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "unknown")


def manual_clean_sql() -> str:
    def z(c, src):
        return (f"(select case when stddev_pop({c}) is null or stddev_pop({c}) = 0 then true else false end from {src}) "
                f"or {c} is null or abs(({c} - (select avg({c}) from {src})) / (select stddev_pop({c}) from {src})) <= 3.0")

    def sc(c, src):
        return sig(f"({c} - (select avg({c}) from {src})) / "
                   f"(select coalesce(nullif(stddev_pop({c}), 0), 1) from {src})")
    nn = " + ".join(f"({c} is not null)::int" for c in ("o_orderkey", "price", "prio", "odate", "cust_txt"))
    dummies = ", ".join(f"case when prio = {lit(v)} then 1 else 0 end as {qi('prio_' + v)}" for v in PRIO_VALUES)
    dummy_names = ", ".join(qi("prio_" + v) for v in PRIO_VALUES)
    return (
        f"with {DIRTY_ORDERS}, {DN}, "
        f"m1 as (select distinct * from dn), "
        f"m2 as (select * from m1 where {nn} >= 3), "
        f"m3 as (select o_orderkey::double as o_orderkey, coalesce(price, (select avg(price) from m2)) as price, "
        f"coalesce(prio, 'unknown') as prio, coalesce(odate, {_mode('odate', 'm2')}) as odate, "
        f"coalesce(cust_txt, (select avg(cust_txt) from m2)) as cust_txt from m2), "
        f"m5 as (select * from m3 where price > 1000.0), "
        f"m6 as (select * from m5 where ({z('o_orderkey', 'm5')}) and ({z('price', 'm5')}) and ({z('cust_txt', 'm5')})), "
        f"m7 as (select o_orderkey, price, odate, cust_txt, {dummies} from m6), "
        f"m8 as (select distinct {sc('o_orderkey', 'm7')} as o_orderkey, {sc('price', 'm7')} as price, "
        f"{ts('odate')} as odate, {sig('cust_txt')} as cust_txt, {dummy_names} from m7) "
        f"select * from m8")


def auto_keep_sql() -> str:
    """As auto_clean, but o_orderkey is kept, so copies are told by it too."""
    return (f"with {DIRTY_ORDERS}, {DN}, a1 as (select distinct o_orderkey, price, prio, odate, cust_txt from dn), "
            f"a2 as (select distinct o_orderkey, coalesce(price, (select median(price) from a1)) as price, "
            f"coalesce(prio, {_mode('prio', 'a1')}) as prio, coalesce(odate, {_mode('odate', 'a1')}) as odate, "
            f"coalesce(cust_txt, (select median(cust_txt) from a1)) as cust_txt from a1) "
            f"select o_orderkey, {sig('price')} as price, prio, {ts('odate')} as odate, {sig('cust_txt')} as cust_txt from a2")


def manual_label_sql() -> str:
    """Which columns are ids, one-hot or label-encoded is decided by the statistics, in SQL."""
    ids = "(select count(distinct price)::double / count(price) > 0.95 and count(price)::double / count(*) > 0.95 from d)"
    return (f"with d as ({duckdb_text(NAMED_ORDERS_SQL)}), m1 as (select distinct case when {ids} then null else price end as price, "
            f"cust, prio from d), "
            f"m2 as (select coalesce(price, (select median(price) from m1)) as price, coalesce(cust, {_mode('cust', 'm1')}) as cust, "
            f"coalesce(prio, {_mode('prio', 'm1')}) as prio from m1), "
            f"m3 as (select price, (dense_rank() over (order by cust) - 1)::int as cust, {_one_hot_cols('prio', PRIO_VALUES[:5])} from m2) "
            f"select distinct {sig('price')} as price, * exclude (price) from m3")


def files_of(table: str) -> str:
    return f"(select greatest(2, ceil(count(*) / {FILE_ROWS}.0))::bigint from {table})"


def files_sql(query: str) -> str:
    """The files of dirty_orders by o_orderkey, each cleaned by the manual recipe of FILE_OPTIONS on its own.

    A CSV file holds the dates as text, so a missing one first becomes the
    constant, which is no date, then the mode.
    """
    files = files_of("d")
    by = lambda c: f"(select mode_{c} from st where st.file_no = h1.file_no)"
    return (f"with {DIRTY_ORDERS}, {DN}, h1 as (select distinct o_orderkey % {files} as file_no, o_orderkey, price, prio, odate, cust_txt from dn), "
            f"md as (select file_no, odate as mode_odate from (select file_no, odate, row_number() over (partition by file_no order by count(*) desc, odate) as r "
            f"from h1 where odate is not null group by file_no, odate) where r = 1), "
            f"av as (select file_no, avg(price) as mode_price, avg(cust_txt) as mode_cust_txt from h1 group by file_no), "
            f"st as (select * from md join av using (file_no)), "
            f"h2 as (select file_no, o_orderkey, coalesce(price, {by('price')}) as price, coalesce(prio, 'unknown') as prio, "
            f"coalesce(odate, {by('odate')}) as odate, coalesce(cust_txt, {by('cust_txt')}) as cust_txt from h1), "
            f"h3 as (select distinct * from h2), "
            # steps: coercion (where a marker made the column text), copies, numeric fill (where there are
            # gaps), then text fill, date conversion and date fill
            f"n0 as (select o_orderkey % {files} as file_no, count(*) as n, (count(cust_txt) < count(*))::int as marked, "
            f"(count(price) < count(*) or count(cust_txt) < count(*))::int as gaps from dn group by 1), "
            f"n1 as (select file_no, count(*) as n from h1 group by 1), "
            f"steps as (select file_no, 3 + n0.marked + n0.gaps + (n0.n > n1.n)::int as steps from n0 join n1 using (file_no)) {query}")


def variant_sql() -> str:
    v = ("case o_orderkey % 5 when 0 then o_orderkey::varchar when 1 then o_orderpriority when 2 then 'true' "
         "when 4 then 'p' || o_totalprice::varchar end")
    ratio = lambda x: pyround(f"count(distinct {x})::double / count(*)")
    return (f"with o as (select {v} as v, o_custkey as n, o_orderstatus as s from orders) "
            f"select 'v' as name, 'mixed' as inferred_type, {pyround('(count(*) - count(v))::double / count(*)')} as missing_ratio, {ratio('v')} as unique_ratio, "
            f"{lit(P.SUGGEST_MIXED.format(name='v'))} as suggestion from o "
            f"union all select 'n', 'numeric', 0.0, {ratio('n')}, null from o union all select 's', 'text', 0.0, {ratio('s')}, null from o")


def compare_sql() -> str:
    cnt = "count(*) * 5 - count(o_orderkey) - count(price) - count(prio) - count(odate) - count(cust_txt)"
    return (f"with {auto_clean_ctes()} "
            f"select 'rows' as metric, (select count(*) from d)::bigint as before, (select count(*) from a2)::bigint as after "
            f"union all select 'columns', 5::bigint, 4::bigint "
            f"union all select 'steps', 0::bigint, (select count(*) from ({execution_log_sql()})) "
            f"union all select 'missing_cells', (select {cnt} from d)::bigint, "
            f"(select count(*) * 4 - count(price) - count(prio) - count(odate) - count(cust_txt) from a2)::bigint "
            f"union all select 'duplicate_rows', ((select count(*) from d) - (select count(*) from (select distinct * from d)))::bigint, "
            f"((select count(*) from a2) - (select count(*) from (select distinct * from a2)))::bigint")


AFTER_AUTO_COLS = [("price", "double"), ("prio", "text"), ("odate", "datetime"), ("cust_txt", "double")]


def compare_columns_sql() -> str:
    after = prof_cte("a2", AFTER_AUTO_COLS).replace("prof0 as", "after0 as").replace("prof as", "after as") \
        .replace("from prof0", "from after0")
    return (f"with {auto_clean_ctes()}, {prof_cte('d', ORDERS_COLS)}, {after} "
            f"select coalesce(b.name, a.name) as name, b.t as type_before, {pyround('b.mr')} as missing_before, "
            f"a.t as type_after, {pyround('a.mr')} as missing_after "
            f"from prof b full outer join after a on a.name = b.name")


def _auto_steps_cte() -> str:
    steps = [
        ("coerce_numeric_like_columns", "'Converted numeric-like text columns: cust_txt'", "true"),
        ("drop_columns", "'Dropped columns: o_orderkey'", "true"),
        ("remove_duplicates", "'Removed ' || ((select count(*) from d) - (select count(*) from a1)) || ' duplicate rows.'",
         "(select count(*) from d) > (select count(*) from a1)"),
        ("auto_numeric", "'Applied median strategy to numeric columns: ' || (select concat_ws(', ', "
         "case when count(price) < count(*) then 'price' end, case when count(cust_txt) < count(*) then 'cust_txt' end) "
         "from a1)", "(select count(price) < count(*) or count(cust_txt) < count(*) from a1)"),
        ("auto_datetime", "'Filled datetime missing values in: odate'", "(select count(odate) < count(*) from a1)"),
        ("auto_text", "'Applied mode strategy to text columns: prio'", "(select count(prio) < count(*) from a1)"),
        ("remove_duplicates_final", "'Removed ' || ((select count(*) from a1) - (select count(*) from a2)) || "
         "' duplicate rows.'", "(select count(*) from a1) > (select count(*) from a2)"),
    ]
    parts = " union all ".join(f"select {i} as k, {lit(n)} as name, {d} as details where {w}"
                               for i, (n, d, w) in enumerate(steps))
    return (f"steps0 as ({parts}), steps as (select (row_number() over (order by k))::int as step_no, "
            f"name, details from steps0)")


def execution_log_sql() -> str:
    return f"with {auto_clean_ctes()}, {_auto_steps_cte()} select step_no, name, details from steps"


def report_sql() -> str:
    after = prof_cte("a2", AFTER_AUTO_COLS).replace("prof0 as", "after0 as").replace("prof as", "after as") \
        .replace("from prof0", "from after0")
    miss_d = "count(*) * 5 - count(o_orderkey) - count(price) - count(prio) - count(odate) - count(cust_txt)"
    miss_a = "count(*) * 4 - count(price) - count(prio) - count(odate) - count(cust_txt)"
    id_text = lit(P.SUGGEST_ID.split("{name}")[0]) + " || name || " + lit(P.SUGGEST_ID.split("{name}")[1])
    miss_text = lit(P.SUGGEST_MISSING.split("{name}")[0]) + " || name || " + lit(P.SUGGEST_MISSING.split("{name}")[1])
    sugg = (f"sugg as (select row_number() over (order by ordinal, rule) as position, s from ("
            f"select ordinal, 1 as rule, {id_text} as s from after where possible_id union all "
            f"select ordinal, 2, {miss_text} from after where {pyround('mr')} > 0.6) t)")
    fixed = [("header", "'Data Cleaning Report'"), ("header", "'Dataset: dirty_orders'"), ("header", "''"),
             ("counts", "'Rows before: ' || (select count(*) from d)"),
             ("counts", "'Rows after: ' || (select count(*) from a2)"),
             ("counts", "'Columns before: 5'"), ("counts", "'Columns after: 4'"),
             ("counts", f"'Missing cells before: ' || (select {miss_d} from d)"),
             ("counts", f"'Missing cells after: ' || (select {miss_a} from a2)"),
             ("counts", "''"), ("steps", "'Applied steps:'")]
    lines = [f"select {i} as k, '{sec}' as section, {txt} as text" for i, (sec, txt) in enumerate(fixed)]
    lines.append("select 100 + step_no, 'steps', '- ' || name || ': ' || details from steps")
    lines.append("select 10000, 'steps', ''")
    lines.append("select 10001, 'suggestions', 'Smart suggestions after cleaning:'")
    lines.append("select 20000 + position, 'suggestions', '- ' || s from sugg where position <= 8")
    return (f"with {auto_clean_ctes()}, {_auto_steps_cte()}, {after}, {sugg}, lines as ({' union all '.join(lines)}) "
            f"select section, (row_number() over (order by k))::int as line_no, text from lines")


def _flags_sql(text: str) -> str:
    out = []
    for name, words in FLAG_WORDS.items():
        out.append("(" + " or ".join(f"contains(lower({text}), {lit(w)})" for w in words) + f") as {name}")
    return ", ".join(out)


def prompt_flags_sql() -> str:
    return f"select conv_id, turn, role, {_flags_sql('coalesce(text, ' + lit('') + ')')} from conversations"


def suggest_plan_sql() -> str:
    reasons = ", ".join([
        "case when flag_id and n_ids > 0 then 'Flagged likely identifier columns: ' || ids || '.' end",
        f"case when flag_missing then {lit(REASON_MISSING)} end",
        f"case when flag_duplicate then {lit(REASON_DUPLICATE)} end",
        f"case when flag_outlier then {lit(REASON_OUTLIER)} end",
        f"case when flag_encode then {lit(REASON_ENCODE)} end",
        f"case when flag_scale then {lit(REASON_SCALE)} end",
        f"case when flag_date then {lit(REASON_DATE)} end",
    ])
    return (
        f"with {DIRTY_ORDERS}, {prof_cte('d', ORDERS_COLS)}, "
        f"ids as (select coalesce(string_agg(name, ', ' order by ordinal), '') as ids, count(*) as n_ids "
        f"from prof where possible_id), "
        f"hm as (select string_agg(name, ', ' order by ordinal) as hm from prof where {pyround('mr')} >= 0.8), "
        f"fl as (select conv_id, turn, role, {_flags_sql('coalesce(text, ' + lit('') + ')')} from conversations), "
        f"r as (select fl.*, ids.*, concat_ws(' | ', {reasons}) as given from fl, ids) "
        f"select conv_id, turn, role, case when flag_id or given = '' then ids else '' end as drop_columns, "
        f"'median' as fill_numeric_strategy, 'mode' as fill_text_strategy, true as remove_duplicates, "
        f"flag_outlier as remove_outliers, flag_encode as encode_categoricals, flag_scale as scale_numeric, "
        f"true as convert_datetimes, case when given = '' then coalesce('Columns with very high missing values "
        f"were detected: ' || hm || '. | ', '') || {lit(REASON_DEFAULT)} else given end as reasons from r, hm")


def _one_hot_cols(col: str, values) -> str:
    return ", ".join(f"case when {qi(col)} = {lit(v)} then 1 else 0 end as {qi(col + '_' + v)}" for v in values)


def _scale(c: str, src: str, digits: int = 9) -> str:
    return sig(f"({qi(c)}::double - (select avg({qi(c)}::double) from {src})) / "
               f"(select coalesce(nullif(stddev_pop({qi(c)}::double), 0), 1) from {src})") + f" as {qi(c)}"


def oracle_queries() -> dict[str, str]:
    sparse = f"s as ({duckdb_sql_of('dirty_sparse')})"
    dates = f"d as ({duckdb_sql_of('dirty_dates')})"
    z = lambda c: (f"(s.s_{c} is null or s.s_{c} = 0 or {c} is null or "  # noqa: E731
                   f"abs(({c}::double - s.m_{c}) / s.s_{c}) <= 3.0)")
    ev_stats = ", ".join(f"avg({c}::double) as m_{c}, stddev_pop({c}::double) as s_{c}"
                         for c in ("event_id", "user_id", "value"))
    sources = [f"src{i}" for i in (0, 1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 2, 3, 4, 5, 6, 7, 8, 9)]
    out = {
        "normalize_text": (f"with {DIRTY_ORDERS} select o_orderkey, {sig('price')} as price, {norm('prio')} as prio, "
                           f"{ts('odate')} as odate, {norm('cust_txt')} as cust_txt from d"),
        "infer_ratio": infer_sql(),
        "coerce_numeric": f"with {DIRTY_ORDERS}, {DN} select {DN_OUT} from dn",
        "coerce_bigint": (f"select o_orderkey, big::bigint as big, u64, 'bigint,bigint,decimal(20,0)' as types "
                          f"from ({duckdb_text(BIG_ORDERS_SQL)})"),
        "inf_to_null": (f"select event_id, {sig('case when isfinite(value) then value end')} as value from ({INF_EVENTS_SQL})"),
        "bool_to_int": "select o_orderkey, (o_orderstatus = 'F')::int as done, (o_totalprice > 100000)::int as large from orders",
        "convert_dates_wide": (f"select o_orderkey, {ts('case when o_orderkey % 10 in (2, 3, 7) then date_trunc(' + lit('day') + ', o_orderdate) + interval 630 minute else date_trunc(' + lit('day') + ', o_orderdate) end')} as d_txt from orders"),
        "fill_median_odd": (f"with d as ({ODD_ORDERS_SQL}) select o_orderkey, "
                            f"{sig('coalesce(price, (select median(price) from d))')} as price from d"),
        "fill_boolean": (f"with d as (select o_orderkey, done::int::double as done from ({BOOLEAN_ORDERS_SQL})) select o_orderkey, "
                         f"coalesce(done, (select median(done) from d)) as done from d"),
        "one_hot_collision": (f"select o_orderkey, o_custkey, {sig('o_totalprice')} as {qi('o_orderstatus_F')}, {ts('o_orderdate')} as o_orderdate, "
                              f"o_orderpriority, case when o_orderstatus = 'F' then 1 else 0 end as {qi('o_orderstatus_F_2')}, "
                              f"{_one_hot_cols('o_orderstatus', ['O', 'P'])} from orders"),
        "label_encode_skewed": "select o_orderkey, " + ", ".join(
            f"(case when {c} is null then -1 else dense_rank() over (order by {c} nulls last) - 1 end)::int as {c}" for c in "abc")
            + f" from ({duckdb_text(SKEWED_ORDERS_SQL)})",
        "wide_clean": (f"with w as ({WIDE_PART_SQL}) select p_partkey, " + ", ".join(
            f"{sig(f'coalesce(c{i}::double, (select avg(c{i}) from w))')} as c{i}" for i in range(WIDE_COLUMNS)) + " from w"),
        "auto_keep": auto_keep_sql(),
        "manual_label": manual_label_sql(),
        "pages": " union all ".join(f"select '{t}' as name, greatest(1, ceil(count(*) / 100.0))::bigint as pages from {t}"
                                    for t in ("events", "documents", "orders")),
        "csv_exact": EXACT_ORDERS_SQL,
        "csv_headers": "select o_orderkey, o_orderpriority, o_custkey from orders",
        "trim_header": "select o_orderkey, o_orderpriority from orders",
        "dedupe_sources": ("with f as (select 'in/' || lpad(event_id::varchar, 12, '0') as path, event_type as name, user_id % 50 as length, "
                           "date_trunc('day', ts) as t from events) select min(path) as path, name, length, "
                           f"{ts('t')} as {qi('modificationTime')} from f group by name, length, t"),
        "manifest": (f"select '.csv' as suffix, true as accepted, null::varchar as reason, count(distinct (o_orderpriority, o_orderkey % {files_of('orders')})) as files from orders "
                     f"union all select '.txt', false, {lit(REASON_SUFFIX)}, count(distinct (o_orderstatus, o_orderkey % {files_of('orders')})) from orders"),
        "clean_each": files_sql("select true as accepted, null::varchar as reason, s.steps::int as steps, count(*) as rows "
                               "from h3 join steps s using (file_no) group by file_no, s.steps"),
        "replay": files_sql(f"select o_orderkey, {sig('price')} as price, prio, {ts('odate')} as odate, {sig('cust_txt')} as cust_txt from h3"),
        "convert_dates": (f"with {dates}, n as (select o_orderkey, {norm('d_txt')} as d_txt from d), "
                          f"r as (select count({date('d_txt')})::double / count(d_txt) as ratio from n) "
                          f"select o_orderkey, case when r.ratio > 0.8 then {ts(date('d_txt'))} else d_txt end as d_txt "
                          f"from n, r"),
        "profile_orders": profile_sql(f"{DIRTY_ORDERS}, ", "d", ORDERS_COLS),
        "profile_lineitem": profile_sql("", "lineitem", LINEITEM_COLS),
        "profile_documents": profile_sql("", "documents", DOCUMENTS_COLS),
        "top_values_orders": top_values_sql(f"{DIRTY_ORDERS}, ", "d", ORDERS_COLS),
        "top_values_documents": top_values_sql("", "documents", DOCUMENTS_COLS),
        "top_values_events": top_values_sql("", "events", EVENTS_COLS),
        "summary_orders": summary_sql(f"{DIRTY_ORDERS}, ", "d", ORDERS_COLS),
        "summary_customer": summary_sql("", "customer", CUSTOMER_COLS),
        "target_candidates": (f"with {DIRTY_ORDERS}, {prof_cte('d', ORDERS_COLS)} "
                              f"select (row_number() over (order by ordinal))::int as position, name from prof "
                              f"where not possible_id and t in ('numeric', 'text', 'boolean') and {pyround('mr')} < 0.4 "
                              f"order by ordinal limit 5"),
        "suggestions": (f"with {prof_cte('customer', CUSTOMER_COLS)}, s as ("
                        f"select ordinal, 1 as rule, 'Consider dropping ''' || name || ''' because it behaves like an ID column.' as s "
                        f"from prof where possible_id union all "
                        f"select ordinal, 2, '''' || name || ''' has a high missing ratio; dropping or imputing is recommended.' "
                        f"from prof where {pyround('mr')} > 0.6) "
                        f"select position::int as position, s as suggestion from ("
                        f"select row_number() over (order by ordinal, rule) as position, s from s) t where position <= 8"),
        "alerts": (f"with {DIRTY_ORDERS}, {prof_cte('d', ORDERS_COLS)} "
                   f"select name, {lit(P.ALERT_MISSING)} as alert from prof where mr >= 0.8 union all "
                   f"select name, {lit(P.ALERT_ID)} from prof where possible_id union all "
                   f"select name, {lit(P.ALERT_LOW_CARD)} from prof where ur <= 0.02 and t = 'text'"),
        "drop_sparse": (f"with {sparse} select a, b, c, {sig('d')} as d, e from s where "
                        f"((a is not null)::int + (b is not null)::int + (c is not null)::int + (d is not null)::int "
                        f"+ (e is not null)::int) >= 3"),
        "drop_empty": (f"with {sparse} select a, b, c, {sig('d')} as d from s "
                       f"where not (a is null and b is null and c is null and d is null and e is null)"),
        **{name: filter_sql(name) for name in FILTER_RULES},
        "dedupe": f"with {DIRTY_ORDERS}, {DN} select distinct {DN_OUT} from dn",
        "fill_mean": fill_sql("mean", "none"),
        "fill_median": fill_sql("median", "none"),
        "fill_zero": fill_sql("zero", "none"),
        "fill_mode": fill_sql("none", "mode"),
        "fill_constant": fill_sql("none", "constant"),
        "fill_datetime": fill_sql("none", "none"),
        "outliers": (f"with s as (select {ev_stats} from events) select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, user_id, event_type, {sig('value')} as value, props "
                     f"from events, s where {z('event_id')} and {z('user_id')} and {z('value')}"),
        "one_hot": (f"select o_orderkey, o_custkey, {sig('o_totalprice')} as o_totalprice, {ts('o_orderdate')} as o_orderdate, {_one_hot_cols('o_orderstatus', ['F', 'O', 'P'])}, "
                    f"{_one_hot_cols('o_orderpriority', PRIO_VALUES[:5])} from orders"),
        "one_hot_source": (f"select doc_id, text, n_chars, {_one_hot_cols('lang', ['de', 'en', 'es', 'fr'])}, "
                           f"{_one_hot_cols('source', sources)} from documents"),
        "label_encode": (f"select p_partkey, p_size, {sig('p_retailprice')} as p_retailprice, (dense_rank() over (order by p_name) - 1)::int as p_name, "
                         "(dense_rank() over (order by p_brand) - 1)::int as p_brand, "
                         f"{_one_hot_cols('p_type', ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])} "
                         "from part"),
        "filter_eq_big": (f"with b as ({duckdb_text(BIG_ORDERS_SQL)}), c as (select o_orderkey, big::bigint as big, u64 from b) "
                          "select * from c where big = 9007199254740994 union all "
                          "select * from c where big <> 9007199254740993 and u64::decimal(20,0) > 18446744073709000001"),
        "label_encode_names": (f"select o_orderkey, (dense_rank() over (order by _k) - 1)::int as _k, _code, (dense_rank() over (order by cust) - 1)::int as cust "
                               f"from ({duckdb_text(ODD_NAMES_SQL)})"),
        "dotted_names": (f"""select "p.key", coalesce("p.name", 'none') as "p.name", coalesce("a.b", 'none') as "a.b", coalesce("a b", 0)::double as "a b", 'none' as "none.at.all" """
                         f"""from ({duckdb_text(DOTTED_PART_SQL)}) where "p.name" is not null"""),
        "label_encode_text": "select doc_id, (dense_rank() over (order by text) - 1)::int as text, lang, source, n_chars from documents",
        "scale_part": f"select p_partkey, p_name, p_brand, p_type, {_scale('p_size', 'part')}, {_scale('p_retailprice', 'part')} from part",
        "scale_lineitem": (f"select l_orderkey, l_returnflag, l_linestatus, {ts('l_shipdate')} as l_shipdate, " + ", ".join(_scale(c, "lineitem") for c in (
            "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " from lineitem"),
        "auto_clean": auto_clean_sql(),
        "manual_clean": manual_clean_sql(),
        "compare": compare_sql(),
        "compare_columns": compare_columns_sql(),
        "execution_log": execution_log_sql(),
        "report": report_sql(),
        "preview": ("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, props "
                    "from events order by event_id limit 100 offset 100"),
        "preview_deep": ("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, props from events "
                         "order by ts, event_id limit 100 offset (select (greatest(1, ceil(count(*) / 100.0)) // 2 - 1) * 100 from events)::bigint"),
        "profile_variant": variant_sql(),
        "prompt_flags": prompt_flags_sql(),
        "suggest_plan": suggest_plan_sql(),
        "csv_roundtrip": (f"with {DIRTY_ORDERS} select o_orderkey, {sig('price')} as price, prio, "
                          f"{ts('odate')} as odate, cust_txt from d"),
        "encoding_latin1": "select doc_id, lang, source, n_chars, text, 'cp1252' as encoding from documents",
        "encoding_utf8": "select doc_id, lang, source, n_chars, text, 'utf-8' as encoding from documents",
    }
    return out
