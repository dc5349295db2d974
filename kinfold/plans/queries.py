"""Queries over the driver's tables for every group of operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon as L
from ..functions import similarity as M
from ..functions import text as T
from ..operators import evaluate, generate, quality, resolve, warehouse as W
from ..operators.names import parse_names
from ..sources.tables import person_records
from . import reports

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- analytic queries ----------------------------------------------------------------------------------------


@query(" union all ".join(f"select '{t}' as tbl, count(*) as cnt from {t}" for t in TABLES))
def row_counts(spark, sf):
    return reports.row_counts({t: table(spark, sf, t) for t in TABLES})


@query("""select src, id, raw_fio from (select 'customer' as src, c_custkey as id, c_name as raw_fio from customer union all
select 'supplier', s_suppkey, s_name from supplier) order by 1, 2 limit 20""")
def sample_names(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_name").alias("raw_fio"))
    return a.union(table(spark, sf, "supplier").select(F.lit("supplier"), "s_suppkey", "s_name")).orderBy("src", "id").limit(20)


@query("""with l as (select distinct l_partkey, l_suppkey from lineitem), b as (
select p_brand, s_name, max(case when p_size < 10 then 1 else 0 end) as is_core from l join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2)
select p_brand, string_agg(s_name, ', ' order by is_core desc, s_name) as stack from b group by 1""")
def ordered_lists(spark, sf):
    """Suppliers of each brand, those of small parts first: a three-way join and an ordered string aggregate."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    b = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(p, "l_partkey")
    b = b.groupBy(F.col("p_brand").alias("project_id"), F.col("l_suppkey").alias("tech_id")).agg(F.max((F.col("p_size") < 10).cast("int")).alias("is_core"))
    return W.tech_stack(b, s.select(F.col("l_suppkey").alias("tech_id"), F.col("s_name").alias("tech_name"))).select(F.col("project_id").alias("p_brand"), F.col("tech_stack").alias("stack"))


@query("""select c_mktsegment as position_title, round(sum(cast(round(o_totalprice * 100) as bigint)) / count(*) / 300.0) as avg_monthly_salary, round(sum(o_custkey) / count(*)) as avg_quarter_bonus
from customer join orders on c_custkey = o_custkey group by 1""")
def averages_by_group(spark, sf):
    """The report of pay by position, of customers' orders by segment; decimals, so the order of summation can't change it."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("position_title"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("salary"), F.col("o_custkey").cast("decimal(12,2)").alias("bonus"))
    return reports.pay_by_position(c, o).select("position_title", F.col("avg_monthly_salary").cast("double").alias("avg_monthly_salary"), F.col("avg_quarter_bonus").cast("double").alias("avg_quarter_bonus"))


@query("select p_type, count(*) as n from part group by 1 order by 2 desc, 1")
def most_common(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("""with s as (select l_partkey, l_suppkey, sum(l_quantity) as q from lineitem group by 1, 2),
r as (select l_partkey, l_suppkey, q, row_number() over w as k, lead(q) over w as runner_up from s window w as (partition by l_partkey order by q desc, l_suppkey))
select l_partkey, l_suppkey, q, coalesce(runner_up, 0) as runner_up, q - coalesce(runner_up, 0) as gap from r where k = 1""")
def best_and_runner_up(spark, sf):
    """Best candidate of each key, and its lead over the second."""
    s = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    top = s.groupBy("l_partkey").agg(F.max_by(F.struct("l_suppkey", "q"), F.struct("q", -F.col("l_suppkey"))).alias("b"))
    rest = s.join(top.select("l_partkey", F.col("b.l_suppkey").alias("best")), "l_partkey").where("l_suppkey <> best").groupBy("l_partkey").agg(F.max("q").alias("r"))
    j = top.join(rest, "l_partkey", "left").select("l_partkey", "b.l_suppkey", "b.q", F.coalesce("r", F.lit(0.0)).alias("runner_up"))
    return j.withColumn("gap", F.col("q") - F.col("runner_up"))


@query("""with a as (select o_custkey as person_sk, count(*) as assignments, sum(cast(l_quantity as bigint)) as allocation_pct from lineitem join orders on l_orderkey = o_orderkey group by 1),
b as (select o_custkey as person_sk, sum(cast(round(o_totalprice * 100) as bigint)) as cents, count(*) as n from orders group by 1)
select a.person_sk, assignments, cast(allocation_pct as bigint) as allocation_pct, cast(cents as bigint) as total_cents, round(cents / n / 100.0) as avg_quarter_pay from a join b on a.person_sk = b.person_sk""")
def facts_per_person(spark, sf):
    """Two facts brought to one grain before they meet: lines as assignments, orders as pay."""
    o = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("allocation_pct"))
    load = lines.join(o.select("o_orderkey", F.col("o_custkey").alias("person_sk")), "o_orderkey")
    j = W.pay_and_load(load, o.select(F.col("o_custkey").alias("person_sk"), F.col("o_totalprice").cast("decimal(13,2)").alias("total_pay")))
    return j.select("person_sk", "assignments", "allocation_pct", (F.col("total_pay") * 100).cast("long").alias("total_cents"), F.round("avg_quarter_pay").cast("double").alias("avg_quarter_pay"))


@query("""select l_orderkey * 10 + l_linenumber as src_assignment_id, s_suppkey + 100 as person_sk, p.sk as project_sk, cast(l_linenumber as integer) as role_sk,
cast(strftime(l_shipdate, '%Y%m%d') as bigint) as date_from_key, cast(strftime(l_shipdate + interval 30 day, '%Y%m%d') as bigint) as date_to_key, cast(l_quantity as integer) as allocation_pct from lineitem join supplier on s_suppkey = l_suppkey and s_nationkey < 20
join (select p_partkey, cast(row_number() over (order by p_partkey) as integer) as sk from part) p on p_partkey = l_partkey""")
def assignment_facts(spark, sf):
    """Lines as assignments of suppliers to parts; suppliers of some nations are persons in review, without a key.  (Line numbers
    repeat within an order here, so rows have no order of their own, and the number that they get is left out.)"""
    lines = table(spark, sf, "lineitem")
    t = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("assignment_id"), F.col("l_suppkey").alias("emp_id"), F.col("l_partkey").alias("project_id"), F.col("l_linenumber").alias("role_id"), F.col("l_quantity").cast("short").alias("allocation_pct"), F.col("l_shipdate").alias("date_from"), F.date_add("l_shipdate", 30).alias("date_to"))
    roles = lines.select(F.col("l_linenumber").alias("role_id")).distinct()
    d = {"dim_project": W.dimension(table(spark, sf, "part"), "p_partkey", "project_sk", {"p_partkey": "src_project_id"}), "dim_role": W.dimension(roles, "role_id", "role_sk", {"role_id": "src_role_id"})}
    return W.fact_assignment({"assignment": t}, d, _aliases(spark, sf)).drop("assignment_sk").withColumn("allocation_pct", F.col("allocation_pct").cast("int"))


@query("""select 'fact_assignment' as fact, count(*) as n_rows, count(distinct l_suppkey) as persons from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey >= 20)
union all select 'fact_compensation', count(*), count(distinct o_custkey) from orders where o_custkey % 5 = 0
union all select 'fact_person_competency', count(*), count(distinct o_custkey) from orders where o_custkey % 5 = 0
union all select 'dim_person_resume', count(*), count(distinct c_custkey) from customer where c_custkey % 5 = 0""")
def unresolved_facts(spark, sf):
    """Rows of all facts whose person is in review: suppliers of some nations, every fifth customer."""
    c = table(spark, sf, "customer").select(F.lit(2).alias("source_id"), F.col("c_custkey").alias("source_pk"), F.col("c_custkey").alias("person_sk")).where("source_pk % 5 <> 0")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"))
    t = {"assignment": table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("emp_id")), "compensation": o, "person_competency": o, "resume": table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"))}
    return W.unresolved(t, _aliases(spark, sf).unionByName(c))


def _aliases(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").where("s_nationkey < 20").select(F.lit(1).alias("source_id"), F.col("s_suppkey").alias("source_pk"), (F.col("s_suppkey") + 100).alias("person_sk"))


# ---- warehouse -----------------------------------------------------------------------------------------------


@query("""select cast(strftime(d, '%Y%m%d') as bigint) as date_key, strftime(d, '%Y-%m-%d') as full_date, cast(year(d) as integer) as year_num, cast(quarter(d) as smallint) as quarter_num,
cast(month(d) as smallint) as month_num, cast(day(d) as smallint) as day_num, cast(isodow(d) as smallint) as weekday_num, cast(isodow(d) >= 6 as integer) as is_weekend
from generate_series(timestamp '2020-01-01', timestamp '2030-12-31', interval 1 day) t(d)""")
def calendar(spark, sf):
    return W.calendar(spark).withColumn("full_date", F.col("full_date").cast("string"))


@query("""select o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') as bigint) as date_key, cast(year(o_orderdate) * 10000 + (quarter(o_orderdate) * 3 - 2) * 100 + 1 as bigint) as period_start_key from orders""")
def date_keys(spark, sf):
    """Smart keys of a fact: its day, and the first day of its quarter."""
    start = F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3 - 2, F.lit(1))
    return table(spark, sf, "orders").select("o_orderkey", W.date_key("o_orderdate").alias("date_key"), W.date_key(start).alias("period_start_key"))


@query("""select row_number() over (order by p_partkey) as part_sk, p_partkey as src_part_id, p_name, p_brand from part""")
def surrogate_keys(spark, sf):
    return W.dimension(table(spark, sf, "part"), "p_partkey", "part_sk", {"p_partkey": "src_part_id", "p_name": "p_name", "p_brand": "p_brand"}).withColumn("part_sk", F.col("part_sk").cast("long"))


@query("""select l_orderkey, l_linenumber, s.sk as supplier_sk, p.sk as part_sk from lineitem
join (select s_suppkey, row_number() over (order by s_suppkey) as sk from supplier) s on s_suppkey = l_suppkey
join (select p_partkey, row_number() over (order by p_partkey) as sk from part) p on p_partkey = l_partkey""")
def fact_keys(spark, sf):
    """A fact under the surrogate keys of its dimensions."""
    p = W.dimension(table(spark, sf, "part"), "p_partkey", "part_sk", {"p_partkey": "l_partkey"})
    s = W.dimension(table(spark, sf, "supplier"), "s_suppkey", "supplier_sk", {"s_suppkey": "l_suppkey"})
    f = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(p, "l_partkey").join(s, "l_suppkey")
    return f.select("l_orderkey", "l_linenumber", F.col("supplier_sk").cast("long").alias("supplier_sk"), F.col("part_sk").cast("long").alias("part_sk"))


def _persons(c: DataFrame, source: int) -> DataFrame:
    name = F.concat(F.lit("seg "), F.lower("c_mktsegment"))
    c = c.select(
        F.col("c_custkey").alias("gid"), F.concat_ws(" ", name, F.col("c_nationkey").cast("string")).alias("canonical_fio"), name.alias("last_name"), F.col("c_name").alias("first_name"),
        F.lit(None).cast("string").alias("middle_name"), F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("match_key"), F.lit(int(source == 1)).alias("in_src_projects"), F.lit(int(source == 2)).alias("in_src_hr"),
    )
    return c


@query("""with k as (select c_custkey as gid, 'seg ' || lower(c_mktsegment) as last_name, c_name as first_name, c_mktsegment || '|' || c_nationkey as match_key, 'seg ' || lower(c_mktsegment) || ' ' || c_nationkey as canonical_fio, c_custkey % 3 = 0 as late from customer),
o as (select match_key, arg_min(last_name, gid) as last_name, arg_min(first_name, gid) as first_name, arg_max(canonical_fio, gid) as canonical_fio from k where not late group by 1),
n as (select match_key, arg_min(last_name, gid) as last_name, arg_min(first_name, gid) as first_name, arg_max(canonical_fio, gid) as canonical_fio from k where late group by 1)
select coalesce(o.match_key, n.match_key) as match_key, coalesce(o.last_name, n.last_name) as last_name, coalesce(o.first_name, n.first_name) as first_name, coalesce(n.canonical_fio, o.canonical_fio) as canonical_fio,
cast(o.match_key is not null as integer) as in_src_projects, cast(n.match_key is not null as integer) as in_src_hr from o full join n on o.match_key = n.match_key""")
def upsert_persons(spark, sf):
    """A second run merged into the first by key: names stay, the canonical form and presence are renewed."""
    c = table(spark, sf, "customer")
    old = W.upsert_persons(None, _persons(c.where("c_custkey % 3 <> 0"), 1))
    return W.upsert_persons(old, _persons(c.where("c_custkey % 3 = 0"), 2)).select("match_key", "last_name", "first_name", "canonical_fio", "in_src_projects", "in_src_hr")


@query("""with o as (select s_nationkey as source_id, s_suppkey as source_pk, s_name as raw_fio, 'new' as match_method, s_suppkey as person_sk from supplier where s_suppkey % 3 <> 0),
n as (select s_nationkey as source_id, s_suppkey as source_pk, 'x' as raw_fio, 'exact' as match_method, s_suppkey + 1000 as person_sk from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0)
select coalesce(o.source_id, n.source_id) as source_id, coalesce(o.source_pk, n.source_pk) as source_pk, coalesce(o.raw_fio, n.raw_fio) as raw_fio, coalesce(o.person_sk, n.person_sk) as person_sk, coalesce(n.match_method, o.match_method) as match_method
from o full join n on o.source_id = n.source_id and o.source_pk = n.source_pk""")
def upsert_aliases(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("source_pk"), "s_name", F.col("s_suppkey").alias("seq"), F.lit(1.0).cast("decimal(5,4)").alias("match_score"))
    # Two batches that together hold all suppliers, and some of them twice.
    a = s.where("source_pk % 3 <> 0").withColumns({"raw_fio": F.col("s_name"), "match_method": F.lit("new"), "person_sk": F.col("source_pk")})
    b = s.where("source_pk % 2 = 0 or source_pk % 3 = 0").withColumns({"raw_fio": F.lit("x"), "match_method": F.lit("exact"), "person_sk": F.col("source_pk") + 1000})
    return W.upsert_aliases(W.upsert_aliases(None, a), b).select("source_id", "source_pk", "raw_fio", "person_sk", "match_method")


@query("""select 'lineitem in orders' as rule, count(*) as violations from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey)
union all select 'lineitem key', count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem
union all select 'quantity', count(*) from lineitem where not (l_quantity between 1 and 45)
union all select 'discount', count(*) from lineitem where not (l_discount >= 0 and l_discount <= 0.08)
union all select 'status', count(*) from orders where o_orderstatus not in ('F', 'O')""")
def data_quality(spark, sf):
    """Keys, domains and references, with some rules that the data do not meet."""
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")  # noqa: E741
    tag = lambda df, name: df.select(F.lit(name).alias("rule"), "violations")
    out = tag(quality.orphans(l, "l_orderkey", o, "o_orderkey"), "lineitem in orders").unionByName(tag(quality.duplicates(l, ("l_orderkey", "l_linenumber")), "lineitem key"))
    out = out.unionByName(quality.check_rows(l, {"quantity": "l_quantity between 1 and 45", "discount": "l_discount >= 0 and l_discount <= 0.08"}))
    return out.unionByName(quality.check_rows(o, {"status": "o_orderstatus in ('F', 'O')"}))


@query("""with r as (select c_custkey, c_nationkey as t, c_mktsegment || (c_nationkey % 7) as p from customer),
b as (select coalesce(sum(n * (n - 1) // 2), 0) as both from (select count(*) as n from r group by t, p)), l as (select sum(n * (n - 1) // 2) as linked from (select count(*) as n from r group by p)),
t as (select sum(n * (n - 1) // 2) as tru from (select count(*) as n from r group by t))
select cast("both" as bigint) as "both", cast(linked as bigint) as linked, cast(tru as bigint) as "true", "both" / linked as precision, "both" / tru as recall from b, l, t""")
def pair_metrics(spark, sf):
    """Precision and recall of one grouping against another, by pairs, without making the pairs."""
    c = table(spark, sf, "customer").select(F.lit(1).alias("source_id"), F.col("c_custkey").alias("source_pk"), F.col("c_nationkey").alias("true_id"), F.concat("c_mktsegment", (F.col("c_nationkey") % 7).cast("string")).alias("person_sk"))
    return evaluate.pairwise(c, c.select("source_id", "source_pk", "true_id")).select("both", "linked", "true", "precision", "recall")


# ---- text ----------------------------------------------------------------------------------------------------

_WORDS = "select distinct unnest(string_split_regex(text, '[^A-Za-zÀ-ÿ]+')) as w from documents"


def _words(spark, sf) -> DataFrame:
    """The distinct words of all texts."""
    return table(spark, sf, "documents").select(F.explode(F.split("text", "[^A-Za-zÀ-ÿ]+")).alias("w")).distinct().where("w <> ''")


@query(f"""select w, regexp_replace(translate(lower(w), 'ёэйы', 'ееии'), '[^а-яa-z]', '', 'g') as folded, replace(lower(w), 'ё', 'е') as normal, case w[1] when 'ß' then 'SS' else upper(w[1]) end || lower(w[2:]) as capped from ({_WORDS}) where w <> ''""")
def text_case(spark, sf):
    return _words(spark, sf).select("w", T.fold("w").alias("folded"), T.norm("w").alias("normal"), T.cap("w").alias("capped"))


_ROMAN_SQL = "regexp_extract_all(lower(w), '(?:" + "|".join(a for a, _ in L.ROMAN_RULES) + "|(?s:.))')"
_ROMAN_MAP = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in L.ROMAN_RULES) + "}"


@query(f"""select w, list_aggregate(list_transform({_ROMAN_SQL}, lambda t: coalesce({_ROMAN_MAP}[t], t)), 'string_agg', '') as cyrillic, translate(w, '{L.LOOKALIKE_LATIN}', '{L.LOOKALIKE_CYRILLIC}') as look from ({_WORDS}) where w <> ''""")
def transliteration(spark, sf):
    return _words(spark, sf).select("w", T.to_cyrillic("w").alias("cyrillic"), T.lookalikes_to_cyrillic("w").alias("look"))


@query(f"""with c as (select w, list_aggregate(list_transform({_ROMAN_SQL}, lambda t: coalesce({_ROMAN_MAP}[t], t)), 'string_agg', '') as c from ({_WORDS}) where w <> ''),
m as (select w, case when regexp_matches(c, '(ова|ева|ина|ына)$') then c[:-2] when regexp_matches(c, '(ская|цкая)$') then c[:-3] || 'ий' when c like '%ая' then c[:-3] || 'ый' else c end as male,
case when regexp_matches(c, '(ов|ев|ин|ын)$') then c || 'а' when regexp_matches(c, '(ский|цкий)$') then c[:-3] || 'ая' when regexp_matches(c, '(ый|ой)$') then c[:-3] || 'ая' else c end as female from c)
select w, male, female from m""".replace("c[:-2] when", "regexp_replace(c, 'а$', '') when").replace("c[:-3]", "left(c, length(c) - 2)"))
def surname_gender(spark, sf):
    d = _words(spark, sf).withColumn("c", T.to_cyrillic("w"))
    return d.select("w", T.male_form("c").alias("male"), T.female_form("c").alias("female"))


@query(f"""select w, case when regexp_matches(w, '^[a-zA-Z\\s\\-.,'';]+$') and regexp_matches(t, '(ов|ова|ев|ева|ин|ина|ский|ская)$') then t else w end as fixed
from (select w, translate(lower(w), '{L.KEYS_LATIN.replace("'", "''")}', '{L.KEYS_CYRILLIC}') as t from ({_WORDS}) where w <> '')""")
def keyboard_layout(spark, sf):
    return _words(spark, sf).select("w", T.fix_layout("w").alias("fixed"))


@query("""select doc_id, len(list_filter(string_split_regex(regexp_replace(translate(text, ',;()[]', '      '), '\\s-\\s', ' ', 'g'), '\\s+'), lambda t: t <> '' and t <> '-')) as n from documents""")
def token_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(T.tokens(T.soften_punctuation("text"))).cast("long").alias("n"))


#: Each part's name and the next one's within its brand: pairs from the whole table, without a join.
_PAIRS = "(select distinct a, b from (select p_name as a, lead(p_name) over (partition by p_brand order by p_partkey) as b from part) where b is not null)"

#: Optimal string alignment by diagonals of the table of distances: d1 is the last diagonal, d2 to d4 those before; entry i + 1 of
#: diagonal k is the distance of the first i letters of a and the first k - i of b.
_OSA = f"""with recursive r as (select a, b, 0 as k, list_transform(range(0, length(a) + 1), lambda i: case when i = 0 then 0 end) as d1, cast([] as bigint[]) as d2, cast([] as bigint[]) as d3, cast([] as bigint[]) as d4 from {_PAIRS}
union all select a, b, k + 1, list_transform(range(0, length(a) + 1), lambda i: case when i > k + 1 or k + 1 - i > length(b) then null when i = 0 or i = k + 1 then k + 1 else
least(d1[i] + 1, d1[i + 1] + 1, d2[i] + cast(a[i] <> b[k + 1 - i] as int), case when i > 1 and k + 1 - i > 1 and a[i] = b[k - i] and a[i - 1] = b[k + 1 - i] then d4[i - 1] + 1 end) end), d1, d2, d3
from r where k < length(a) + length(b)), d as (select a, b, d1[length(a) + 1] as osa from r where k = length(a) + length(b))"""


def _name_pairs(spark, sf) -> DataFrame:
    follow = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf, "part").select(F.col("p_name").alias("a"), follow.alias("b")).where("b is not null").distinct()


@query(_OSA + " select a, b, round(case when greatest(length(a), length(b)) = 0 then 1.0 else 1.0 - osa / greatest(length(a), length(b)) end, 6) as similarity from d")
def edit_similarity(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", F.round(M.osa_similarity("a", "b"), 6).alias("similarity"))


@query(_OSA + " select a, b, cast(osa as integer) as osa from d")
def osa_distance(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", M.osa_distance("a", "b").alias("osa"))


@query(f"""with recursive r as (select a, b, 0 as i, cast([] as bigint[]) as used, '' as lefts from {_PAIRS}
union all select a, b, i + 1, case when j is null then used else list_append(used, j) end, case when j is null then lefts else lefts || a[i + 1] end from (
select *, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda j: b[j] = a[i + 1] and not list_contains(used, j))[1] as j
from (select *, greatest(length(a), length(b)) // 2 - 1 as reach from r where i < length(a)))),
m as (select a, b, len(used) as m, lefts, list_aggregate(list_transform(list_sort(used), lambda j: b[j]), 'string_agg', '') as rights from r where i = length(a)),
j as (select *, case when m = 0 then 0.0 else (cast(m as double) / length(a) + cast(m as double) / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: lefts[k] <> rights[k])) / 2.0) / m) / 3.0 end as jaro,
case when a[1] <> b[1] then 0 when a[2] <> b[2] then 1 when a[3] <> b[3] then 2 when a[4] <> b[4] then 3 else 4 end as same from m)
select a, b, round(case when a = b then 1.0 when m = 0 then 0.0 else jaro + same * 0.1 * (1.0 - jaro) end, 4) as jw from j""")
def jaro_winkler(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", F.round(M.jaro_winkler_similarity("a", "b"), 4).alias("jw"))


# ---- persons -------------------------------------------------------------------------------------------------


def _registries(spark, sf):
    """Names for as many persons as there are customers."""
    return generate.registries(spark, table(spark, sf, "customer").count())


@query()
def generated_names(spark, sf):
    return _registries(spark, sf)[2]


@query("""select count(*) as employees, 0 as over_budget, 0 as outside, 0 as twice from customer""")
def generated_assignments(spark, sf):
    """Assignments drawn for every customer as an employee, to orders' days as projects: none over its budget of working time, outside its
    project's days, or twice in one project."""
    staff = table(spark, sf, "customer").select(F.col("c_custkey").alias("emp_id"), F.lower("c_mktsegment").alias("specialisation"))
    roles = staff.groupBy("specialisation").agg(F.array(F.lit(1), F.lit(2)).alias("role_ids"))
    end = F.when(F.col("s_suppkey") % 2 == 0, F.lit("2026-03-31").cast("date"))
    projects = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.lit("2025-01-01").cast("date").alias("start_date"), end.alias("end_date"))
    a = generate.assignments(staff, projects, roles).join(projects, "project_id")
    last = F.coalesce("end_date", F.lit("2026-07-01").cast("date"))
    bad = (F.col("date_from") < F.col("start_date")) | (F.col("date_to") > last) | (F.col("date_to") < F.col("date_from"))
    per = a.groupBy("emp_id").agg(F.sum("allocation_pct").alias("share"), F.count_if(bad).alias("outside"), (F.count("*") - F.count_distinct("project_id")).alias("twice"))
    return per.agg(F.count("*").alias("employees"), F.count_if(F.col("share") > 100).cast("int").alias("over_budget"), F.sum("outside").cast("int").alias("outside"), F.sum("twice").cast("int").alias("twice"))


@query()
def parsed_names(spark, sf):
    a, b, _ = _registries(spark, sf)
    return parse_names(person_records(a, b)).select("source_id", "source_pk", "fio", "parsed.*")


@query()
def resolved_persons(spark, sf):
    a, b, _ = _registries(spark, sf)
    return resolve.resolve_records(person_records(a, b))[0]


@query()
def resolution_quality(spark, sf):
    a, b, truth = _registries(spark, sf)
    _, aliases, _ = resolve.resolve_records(person_records(a, b))
    return evaluate.pairwise(aliases.withColumnRenamed("gid", "person_sk"), evaluate.truth_records(truth))


@query("""select 'x' as tag, c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '|' || lower(c_mktsegment) || '|' as match_key from customer""")
def match_keys(spark, sf):
    return table(spark, sf, "customer").select(F.lit("x").alias("tag"), "c_custkey", T.match_key("c_name", "c_mktsegment", F.lit("")).alias("match_key"))
