"""Queries on labels, contracts, sheets and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions import columns as C
from panelworks.operators import blend, contract, grid, labels, masks, windows
from panelworks.plans.base import query, read, rounded
from panelworks.plans.scores import ARMS_SQL, arms
from panelworks.sources.files import written

#: A lexicon for the test texts: finding, kind, pattern.
LEXICON = [
    *[("insult", labels.SURE, x) for x in ("idiot", "scum", "clown")],
    *[("mood", labels.MENTION, x) for x in ("pathetic", "disgusting", "worthless")],
    ("licence", labels.SURE, r"licen[cs]e"),
    *[("contact", labels.MENTION, x) for x in (r"mail\d", r"\bcall\b")],
    *[("contact", labels.CUE, x) for x in (r"\bthe\b", r"\bdie\b", r"\ble\b")],
    *[("article", labels.MENTION, x) for x in (r"\band the\b", r"\bde la\b", r"\bin der\b")],
    *[(None, labels.CUE, x) for x in (r"\bthe\b", r"\bla\b", r"\bder\b")],
    *[(None, labels.NEGATION, x) for x in (r"\bno\b", r"\bnot\b", r"\bwas\b", r"\bne\b", r"\bnicht\b")],
]


def _joined(kind: str, finding: str | None) -> str:
    return "|".join(p for f, k, p in LEXICON if (f, k) == (finding, kind))


NEGATION = _joined(labels.NEGATION, None)
_LEX_ROWS = [(f, k, _joined(k, f), _joined(labels.CUE, f) or _joined(labels.CUE, None)) for f, k in dict.fromkeys((f, k) for f, k, _ in LEXICON if k in (labels.MENTION, labels.SURE))]
LEX_SQL = "lex(finding, term, pathology, self_positive) as (values " + ", ".join(f"('{f}', '{t}', '{cue}', {str(k == labels.SURE).lower()})" for f, k, t, cue in _LEX_ROWS) + ")"
_NEGATED = "(regexp_matches(substr(c, greatest({s} - 80, 1), least({s} - 1, 80)), '" + NEGATION + "') or regexp_matches(substr(c, {e}, 45), '" + NEGATION + "'))"
#: The rule over each mention. Letters that decompose are plain, and no pattern holds a letter beside that a word's end depends on.
STATES_SQL = rf"""{LEX_SQL}
, cl as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(lower(strip_accents(coalesce(text, ''))), 'ß', 's'), '\s+', ' ', 'g'), '[.;:\n\r]+|\s-\s|\*|\|'), lambda c: trim(c)), lambda c: c <> '')) as c from documents)
, m as (select doc_id, finding, self_positive, pathology, c, regexp_extract_all(c, term) as hits, regexp_split_to_array(c, term) as parts from cl, lex where regexp_matches(c, term))
, n as (select *, unnest(range(1, len(hits) + 1)) as k from m)
, p as (select doc_id, finding, self_positive, pathology, c, 1 + list_sum(list_transform(parts[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:k - 1], lambda x: length(x))), 0) as s, length(hits[k]) as l from n)
, w as (select *, s + l as e, greatest(s - 80, 1) as lo from p)
, v as (select *, substr(c, lo::bigint, (e - lo + 80)::bigint) as near, regexp_extract(substr(c, lo::bigint, (e - lo + 80)::bigint), pathology) as found from w)
, f as (select *, lo + length(regexp_extract(near, '^(.*?)(?:' || pathology || ')', 1)) as fs from v)
, g as (select doc_id, finding, case when {_NEGATED.format(s='s::bigint', e='e::bigint')} then -1 when self_positive then 1 when found <> '' then case when {_NEGATED.format(s='fs::bigint', e='(fs + length(found))::bigint')} then -1 else 1 end when regexp_matches(near, '{NEGATION}') then -1 else 0 end as s from f)
, st as (select doc_id, finding, case when bool_or(s = 1) then 1 when bool_or(s = -1) then -1 else 0 end as state from g group by 1, 2)
, states as (select doc_id, finding as target, coalesce(state, 0) as state from documents cross join (select finding from lex) left join st using (doc_id, finding))"""


def _states(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """States of every document, or of those whose doc_id is in `of`: the others are not labelled."""
    lexicon = labels.read_lexicon(spark.createDataFrame(LEXICON, labels.LEXICON))
    documents = read(spark, sf_dir, "documents")
    if of is not None:
        documents = documents.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    return labels.label_texts(documents, "doc_id", "text", lexicon).withColumnRenamed("finding", "target")


@query(f"with {STATES_SQL} select doc_id, target, state from states")
def lexicon_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01, F02, F03, F04, F05."""
    return _states(spark, sf_dir)


@query(f"with {STATES_SQL} select target, count(*) filter (where state = 1) as n_pos, count(*) filter (where state = 0) as n_unknown, count(*) filter (where state = -1) as n_neg from states group by 1")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return labels.state_counts(_states(spark, sf_dir), "target")


#: Gold labels for the three findings by rule, a quarter of them hidden.
GOLD_SQL = """gold as (select doc_id, target, case when doc_id % 4 <> 3 then y end as y, doc_id % 3 as fold from (
  select doc_id, 'insult' as target, toxic as y from labels union all select doc_id, 'mood', toxic from labels union all select doc_id, 'licence', quality from labels))"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = read(spark, sf_dir, "labels").select("doc_id", F.expr("stack(3, 'insult', toxic, 'mood', toxic, 'licence', quality) as (target, y)"))
    return long.withColumns({"y": F.when(F.col("doc_id") % 4 != 3, F.col("y")), "fold": F.col("doc_id") % 3})


def _calibration_sql(folds: bool) -> str:
    f, on = ("fold, ", "and c.fold = p.fold") if folds else ("", "")
    cells = "select target, state, h.fold, sum((y > 0.5)::int) as s, count(*) as n from states join gold using (doc_id, target) join (select range::bigint as fold from range(3)) h on h.fold <> gold.fold where y is not null group by all" if folds else "select target, state, sum((y > 0.5)::int) as s, count(*) as n from states join gold using (doc_id, target) where y is not null group by all"
    keys = "select distinct target, fold from cells" if folds else "select distinct target from cells"
    same = "using (target, fold)" if folds else "using (target)"
    pool_on = "using (fold)" if folds else "on true"
    return f"""{STATES_SQL}, {GOLD_SQL}
, cells as ({cells})
, pool as (select {f}state, (sum(s) + 1.0) / (sum(n) + 2.0) as pool from cells group by all)
, pools as (select {f}coalesce(max(case when state = 1 then pool end), 0.5) as p1, coalesce(max(case when state = 0 then pool end), 0.5) as p0, coalesce(max(case when state = -1 then pool end), 0.5) as pm from pool {"group by fold" if folds else ""})
, k as ({keys})
, t as (select target, {f}coalesce(sum(case when state = 1 then s end), 0) as s1, coalesce(sum(case when state = 1 then n end), 0) as n1, coalesce(sum(case when state = 0 then s end), 0) as s0, coalesce(sum(case when state = 0 then n end), 0) as n0
, coalesce(sum(case when state = -1 then s end), 0) as sm, coalesce(sum(case when state = -1 then n end), 0) as nm from cells group by all)
, r as (select t.*, (s1 + 4 * p1) / (n1 + 4) as a, (s0 + 4 * p0) / (n0 + 4) as b, (sm + 4 * pm) / (nm + 4) as c from t join pools {pool_on})
, o as (select target, {f}a, least(b, a - 0.05) as b, least(c, least(b, a - 0.05) - 0.05) as c from r)
, cal as (select target, {f}least(greatest(a, 0.01), 0.99) as p_pos, least(greatest(b, 0.01), 0.99) as p_unknown, least(greatest(c, 0.01), 0.99) as p_neg from o)"""


@query(f"with {_calibration_sql(False)} select target, round(p_pos, 8) as p_pos, round(p_unknown, 8) as p_unknown, round(p_neg, 8) as p_neg from cal")
def tri_state_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, J06."""
    gold = _gold(spark, sf_dir).filter("y is not null")
    return rounded(labels.calibrate(_states(spark, sf_dir, gold), gold, "doc_id"), "p_pos", "p_unknown", "p_neg")


@query(f"""with {_calibration_sql(True)}
select doc_id, s.target, state, doc_id % 3 as fold, round(case when state = 1 then p_pos when state = 0 then p_unknown else p_neg end, 8) as soft, case when state = 0 then 0.25 else 1.0 end::double as w
from states s join cal on cal.target = s.target and cal.fold = doc_id % 3""")
def fold_safe_soft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's labels from the table fitted on the other folds."""
    states = written(_states(spark, sf_dir), "states")  # texts are labelled once
    table = labels.calibrate(states, _gold(spark, sf_dir), "doc_id", folds=3)
    return rounded(labels.soften(states.withColumn("fold", F.col("doc_id") % 3), table, ["target", "fold"]), "soft")


@query("""
with e as (select doc_id, case when doc_id % 2 = 0 then quality::double end as y from labels)
, a as (select doc_id, case when doc_id % 5 = 0 then 0.5 else round(1000.0 / (1000 + n_chars), 6) end as y, 0.5 + (doc_id % 4) / 8.0 as w from documents)
select e.doc_id, coalesce(e.y, case when abs(a.y - 0.5) > 1e-8 + 0.5e-5 then a.y end) as label, case when e.y is not null then 1.0 when abs(a.y - 0.5) > 1e-8 + 0.5e-5 then 0.4 * w end::double as weight from e left join a using (doc_id)""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J07, F15."""
    e = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality").cast("double")).alias("y"))
    a = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(F.round(1000.0 / (1000 + F.col("n_chars")), 6)).alias("y"), (0.5 + (F.col("doc_id") % 4) / 8.0).alias("w"))
    return labels.merge_labels(e, a, ["doc_id"], 0.5, 0.4)


@query(f"""with {STATES_SQL} select doc_id, target, case when target = 'mood' then coalesce(1 - 2 * toxic, state) else state end as state from states left join labels using (doc_id)""")
def teacher_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J08."""
    teacher = read(spark, sf_dir, "labels").select("doc_id", F.lit("mood").alias("target"), (1 - 2 * F.col("toxic")).alias("state"))
    return labels.override(_states(spark, sf_dir), teacher, ["doc_id", "target"])


@query(f"""with {ARMS_SQL}, l as (select doc_id % 5 as fold, target, y from long)
, a as (select fold, target, count(*) as n, count(*) filter (where y > 0.5) as n_pos, count(y) as n_labelled from l group by 1, 2)
select fold, target, n, n_pos, n_labelled, round(prior, 8) as prior from a join (select target, coalesce(avg(y), 0.5) as prior from l group by 1) using (target)""")
def fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A15."""
    long = arms(spark, sf_dir).filter("arm = 'a'").withColumn("fold", F.col("doc_id") % 5)
    return rounded(labels.fold_audit(long, "fold", "target", "y").join(labels.prior(long, "target", "y"), "target"), "prior")


@query("""
with g as (select l.doc_id // 5 as grp, sum(quality) as quality, sum(toxic) as toxic from labels l group by 1)
, t as (select sum(quality) as q, sum(toxic) as t from g)
, s as (select grp, case when quality > 0 and toxic > 0 then case when q < t or (q = t) then 'quality' else 'toxic' end when quality > 0 then 'quality' when toxic > 0 then 'toxic' else 'none' end as stratum from g, t)
, p as (select *, row_number() over (partition by stratum order by md5(grp::varchar), grp) - 1 as place from s)
select grp, stratum, case when (place // 4) % 2 = 0 then place % 4 else 3 - place % 4 end as fold from p""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M24."""
    l = read(spark, sf_dir, "labels").withColumn("grp", F.floor(F.col("doc_id") / 5))
    return labels.stratified_folds(l, "grp", ["quality", "toxic"], 4)


@query("""
with s as (select distinct source as g from documents)
, f as (select g, (row_number() over (order by md5(g), g) - 1) % 5 as fold from s)
select doc_id, source, fold from documents join f on g = source""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P05."""
    return grid.group_fold(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5)


# contracts and sheets


@query("""
with s as (select l_orderkey as k from lineitem where l_linenumber < 3 union all select l_orderkey + 5 from lineitem where l_linenumber = 3)
, own as (select k, count(*) as n from s group by 1)
, b as (select n, o_orderkey from own full join orders on k = o_orderkey)
select u.name, u.n, u.n = 0 as ok from (select count(*) filter (where n > 1) as d, count(*) filter (where n is null) as m, count(*) filter (where o_orderkey is null) as e from b), lateral (values ('duplicate', d), ('missing', m), ('extra', e)) u(name, n)""")
def key_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V02, J04, U03."""
    l = read(spark, sf_dir, "lineitem")
    sheet = l.filter("l_linenumber < 3").select(F.col("l_orderkey").alias("k")).unionByName(l.filter("l_linenumber = 3").select((F.col("l_orderkey") + 5).alias("k")))
    return contract.check_keys(sheet, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), ["k"])


@query("""
select l_returnflag, u.name, u.n as n_bad, u.n = 0 as ok from (
  select l_returnflag, count(*) filter (where not l_quantity between 1 and 50) as a, count(*) filter (where not (l_discount <= 0.09)) as b, count(*) filter (where not (isfinite(l_extendedprice) and l_extendedprice > 0)) as c
  , count(*) filter (where not (l_linestatus in ('F', 'O'))) as d from lineitem group by 1), lateral (values ('range', a), ('share', b), ('finite', c), ('binary', d)) u(name, n)""")
def value_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V03, V04, V05, V06."""
    price = F.col("l_extendedprice")
    checks = {"range": F.col("l_quantity").between(1, 50), "share": F.col("l_discount") <= 0.09, "finite": ~F.isnan(price) & (price > 0) & (price < float("inf")), "binary": F.col("l_linestatus").isin("F", "O")}
    return contract.check_values(read(spark, sf_dir, "lineitem"), ["l_returnflag"], checks)


@query("""
with a as (select l_orderkey, l_linenumber, l_suppkey, l_quantity from lineitem where l_suppkey % 2 = 0), b as (select l_orderkey, l_linenumber, l_suppkey, case when l_linenumber = 7 then l_quantity + 1 else l_quantity end as l_quantity from lineitem where l_suppkey % 2 = 0)
select (select count(*) from (select * from a except all select * from b)) as only_first, (select count(*) from (select * from b except all select * from a)) as only_second""")
def same_rows_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V07."""
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    b = a.withColumn("l_quantity", F.when(F.col("l_linenumber") == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return contract.check_same_rows(a, b, F.col("l_suppkey") % 2 == 0)


@query("""
with d as (select * from (select *, row_number() over (partition by p_type order by p_retailprice, p_partkey) as rn from part) where rn = 1)
select l_orderkey, l_linenumber, l_partkey, d.p_partkey as first_part, d.p_retailprice as first_price from (select l.*, case l_linenumber % 4 when 0 then 'ECONOMY' when 1 then 'SMALL' when 2 then 'PROMO' else 'NONE' end as t from lineitem l) l left join d on d.p_type = l.t""")
def dimension_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J01, U02."""
    l = read(spark, sf_dir, "lineitem").withColumn("p_type", F.expr("case l_linenumber % 4 when 0 then 'ECONOMY' when 1 then 'SMALL' when 2 then 'PROMO' else 'NONE' end"))
    out = contract.attach(l, read(spark, sf_dir, "part"), ["p_type"], [F.col("p_retailprice"), F.col("p_partkey")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_partkey").alias("first_part"), F.col("p_retailprice").alias("first_price"))


@query("""
with p as (select l_orderkey, round(sum(l_extendedprice), 2) as total from lineitem where l_orderkey % 7 <> 0 group by 1)
select o_orderkey as k, coalesce(total, 0.0) as total, total is null as missing from orders left join p on l_orderkey = o_orderkey""")
def template_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J02, J03."""
    p = read(spark, sf_dir, "lineitem").filter("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return contract.align(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), p, ["k"], "total", 0.0)


@query("""
with c as (select l_orderkey as k, avg(l_quantity) as v, count(l_quantity) as n from lineitem where l_linenumber > 2 group by 1)
select o_orderkey as k, round(coalesce(v, 25.5), 8) as v, coalesce(n, -1) as n from orders left join c on k = o_orderkey""")
def prior_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J28, S09."""
    children = read(spark, sf_dir, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return rounded(contract.fallback(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), children, "k", "v", 25.5), "v")


BASE_SHEET = "select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_returnflag) as flag, max(l_quantity) > 25 as q, max(l_discount) > 0.05 as d from lineitem group by 1, 2"


@query(f"""
with b as ({BASE_SHEET}), o as (select *, case when flag = 'A' then d else q end as out from b)
select l_suppkey, count(*) filter (where not q and out) as added, count(*) filter (where q and not out) as removed, round(case when count(*) filter (where q or out) = 0 then 1.0 else count(*) filter (where q and out)::double / count(*) filter (where q or out) end, 8) as agreement from o group by 1""")
def partial_overwrite_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J29."""
    b = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("flag"), (F.max("l_quantity") > 25).alias("q"), (F.max("l_discount") > 0.05).alias("d"))
    keys = ["l_orderkey", "l_linenumber"]
    _, audit = contract.overwrite(b.drop("d"), b.select(*keys, F.col("d").alias("q")), keys, "q", F.col("flag") == "A", ["l_suppkey"])
    return rounded(audit, "agreement")


@query(f"""
with b as ({BASE_SHEET}), x as (select l_orderkey, l_linenumber, flag, l_suppkey::double as v from b), y as (select l_orderkey, l_linenumber, flag, case when l_linenumber = 5 then v + 2 else v end as v from x where l_orderkey % 11 <> 0)
select coalesce(x.flag, y.flag) as flag, count(*) as n, count(*) filter (where abs(x.v - y.v) > 1e-6) as changed, count(*) filter (where x.v is null or y.v is null) as one_sided, round(avg(abs(x.v - y.v)), 8) as mean_difference
from x full join y using (l_orderkey, l_linenumber, flag) group by 1""".replace("coalesce(x.flag, y.flag) as flag", "flag"))
def sheet_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35, A44."""
    x = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_suppkey").cast("double").alias("v"))
    y = x.filter("l_orderkey % 11 <> 0").withColumn("v", F.when(F.col("l_linenumber") == 5, F.col("v") + 2).otherwise(F.col("v")))
    return rounded(contract.sheet_difference(x, y, ["l_orderkey", "l_linenumber"], ["flag"], "v"), "mean_difference")


@query("""
with x as (select p_partkey, p_brand, p_size::double as a, case when p_partkey % 9 = 0 then null else p_retailprice end as b from part)
, y as (select p_partkey, p_brand, case when p_partkey % 10 = 0 then a + 1 else a end as a, b from x)
, l as (select p_brand, 'a' as "column", x.a as x, y.a as y from x join y using (p_partkey, p_brand) union all select p_brand, 'b', x.b, y.b from x join y using (p_partkey, p_brand))
, g as (select "column", p_brand, count(*) filter (where coalesce(abs(x - y) <= 1e-9, x is null and y is null)) as s, count(*) as n from l group by 1, 2)
select "column", round(sum(s)::double / sum(n), 8) as share, round(min(s::double / n), 8) as worst from g group by 1""")
def equality_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A47."""
    x = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("a"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("b"))
    y = x.withColumn("a", F.when(F.col("p_partkey") % 10 == 0, F.col("a") + 1).otherwise(F.col("a")))
    return rounded(contract.equal_shares(x, y, ["p_partkey"], ["a", "b"], "p_brand", 1e-9), "share", "worst")


@query("""
with q as (select l_suppkey, quantile_cont(l_extendedprice, 0.05) as lo, quantile_cont(l_extendedprice, 0.95) as hi from lineitem group by 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((least(greatest(l_extendedprice, lo), hi) - lo) / (hi - lo), 7) as scaled from lineitem join q using (l_suppkey)""")
def percentile_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    out = contract.rescale(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.05, 0.95)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("scaled", 7).alias("scaled"))


@query("""
with s as (select l_suppkey, case when l_partkey % 40 = 0 then case when l_orderkey % 2 = 0 then 'R' else 'L' end end as tag, l_quantity - 25.5 as v, l_orderkey * 8 + l_linenumber as o, l_partkey from lineitem)
, m as (select l_suppkey, median(v) as m from s group by 1)
, t as (select l_suppkey, first(tag order by o, l_partkey) as told from s where tag is not null group by 1)
, g as (select l_suppkey, told, case when m > 0.4 then 'R' when m < -0.4 then 'L' end as guess from m left join t using (l_suppkey))
select l_suppkey, coalesce(told, guess) as side, coalesce(told <> guess, false) as disagrees from g""")
def attribute_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J30."""
    tag = F.when(F.col("l_partkey") % 40 == 0, F.when(F.col("l_orderkey") % 2 == 0, "R").otherwise("L"))
    s = read(spark, sf_dir, "lineitem").select("l_suppkey", tag.alias("tag"), (F.col("l_quantity") - 25.5).alias("v"), F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"), "l_partkey").alias("o"))
    return contract.resolve_attribute(s, "l_suppkey", "tag", "v", "o", 0.4)


@query("""
with s as (select l_suppkey, l_partkey, list(distinct l_linenumber order by l_linenumber) as l from lineitem group by 1, 2)
, t as (select array_to_string(l, ',') as cells, len(l) as size from s) select cells, size, count(*) as n from t group by 1, 2""")
def unique_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U05."""
    return contract.unique_sets(read(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], "l_linenumber")


@query("""
select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_suppkey, l_returnflag order by md5((l_orderkey * 100000 + l_partkey)::varchar || 's1'), l_orderkey * 100000 + l_partkey) as n from lineitem) where n <= 20)""")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator, its cap is the feature."""
    l = read(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 100000 + F.col("l_partkey"))
    return windows.capped_sample(l, ["l_suppkey", "l_returnflag"], "key", 20, "s1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
with p as (select *, case p_type when 'PROMO' then 0 when 'ECONOMY' then 1 when 'SMALL' then 2 else 3 end as prio from part)
select p_partkey, p_brand, row_number() over (partition by p_brand order by prio, p_size desc, p_partkey) as place, row_number() over (partition by p_brand order by prio, p_size desc, p_partkey) <= 3 as picked from p""")
def priority_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by priority; those past the third are the drop events."""
    prio = F.expr("case p_type when 'PROMO' then 0 when 'ECONOMY' then 1 when 'SMALL' then 2 else 3 end")
    return windows.top_by_priority(read(spark, sf_dir, "part"), ["p_brand"], [prio, F.col("p_size").desc(), F.col("p_partkey")], 3).select("p_partkey", "p_brand", "place", "picked")


@query("""
select min(doc_id) as doc_id, md5(coalesce(text, '')) as h, count(*) as n from documents group by 2""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are equal by their content's hash."""
    return read(spark, sf_dir, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""
select event_id, (props::json ->> 'k')::int as k, case when (props::json ->> 'k')::int % 3 = 0 then 1 when (props::json ->> 'k')::int % 3 = 1 then 0 else -1 end as state from events""")
def structured_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with a fixed schema, codes through a map."""
    k = F.from_json("props", "k int")["k"]
    codes = F.create_map(F.lit(0), F.lit(1), F.lit(1), F.lit(0), F.lit(2), F.lit(-1))
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.element_at(codes, k % 3).alias("state"))


@query("""
with r as (select l_orderkey, l_linenumber, l_quantity as q, l_extendedprice / 1000 as e, l_discount as d, l_tax as t from lineitem)
select l_orderkey, l_linenumber, e, round(1 / (1 + exp(-(ln(least(greatest(d, 1e-6), 1 - 1e-6) / (1 - least(greatest(d, 1e-6), 1 - 1e-6))) + 0.5))), 8) as shifted
, round(case when q > 0 and e > 0 then q * exp(0.25 * least(greatest(ln(e / q), -0.5), 0.5)) else q end, 7) as first, round(case when q > 0 and e > 0 then e * exp(-0.75 * least(greatest(ln(e / q), -0.5), 0.5)) else e end, 7) as second
, round(q * pow(1 + t, -0.3), 7) as applied, round(least(abs(q * 7 - e * 3) % 180, 180 - abs(q * 7 - e * 3) % 180), 6) as axial, round(case when sin(radians(q)) > 0 then e / sin(radians(q)) end, 6) as derived
, round(q + 0.3 * least(greatest(e - q, -5.0), 5.0), 7) as guarded, round(e / greatest(q, 1), 7) as density from r""")
def row_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P08, P13, P14, P15, P16, F09, F10, F11."""
    r = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("e"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    q, e = F.col("q"), F.col("e")
    first, second = C.reconcile(q, e, F.lit(1.0), 0.25, 0.5)
    return r.select(
        "l_orderkey", "l_linenumber", "e", F.round(C.logit_shift(F.col("d"), 0.5), 8).alias("shifted"), F.round(first, 7).alias("first"), F.round(second, 7).alias("second"),
        F.round(C.apply_ratio(q, e, 1 + F.col("t"), 0.3)[0], 7).alias("applied"), F.round(C.axial_difference(q * 7, e * 3), 6).alias("axial"), F.round(C.derived_length(e, q), 6).alias("derived"),
        F.round(C.guarded_blend(q, e, 0.3, 5.0), 7).alias("guarded"), F.round(C.diagram(q, e, F.lit(100.0), F.lit(2000.0), F.lit(120.0))["density"], 7).alias("density"),
    )


# masks


#: Instances as runs: image = one record of a supplier, scored for itself, row = line number, run = [day, day + quantity); predictions are moved by a few days.
MASKS_SQL = """runs as (select l_suppkey * 3 + l_partkey % 3 as image, l_linenumber as row, l_orderkey % 6 as inst, l_partkey % 3 as record, min(date_diff('day', timestamp '1995-01-01', l_shipdate))::bigint as x0, max(l_quantity)::bigint as n from lineitem group by 1, 2, 3, 4)
, truth as (select image, row, inst, record, x0, x0 + n * 20 as x1 from runs)
, pred as (select image, row, inst, record, x0 + inst * 30 as x0, x0 + n * 20 as x1 from runs where inst * 30 < n * 20 and image % 7 <> 0)
, scores as (select image, inst, (image * 13 + inst * 29) % 100 / 100.0 as score from pred group by 1, 2)"""


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    day = F.timestamp_diff("DAY", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate"))
    runs = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") * 3 + F.col("l_partkey") % 3).alias("image"), F.col("l_linenumber").alias("row"), (F.col("l_orderkey") % 6).alias("inst"), (F.col("l_partkey") % 3).alias("record")).agg(F.min(day).alias("x0"), F.max("l_quantity").cast("long").alias("n"))
    truth = runs.select("image", "row", "inst", "record", "x0", (F.col("x0") + F.col("n") * 20).alias("x1"))
    pred = runs.filter("inst * 30 < n * 20 and image % 7 <> 0").select("image", "row", "inst", "record", (F.col("x0") + F.col("inst") * 30).alias("x0"), (F.col("x0") + F.col("n") * 20).alias("x1"))
    scores = pred.select("image", "inst").distinct().withColumn("score", (F.col("image") * 13 + F.col("inst") * 29) % 100 / 100.0)
    return truth, pred, scores


OVERLAP_SQL = f"""{MASKS_SQL}
, ap as (select image, inst, sum(x1 - x0) as area from pred group by 1, 2), tru as (select image, inst, sum(x1 - x0) as area from truth group by 1, 2)
, ov as (select p.image, p.inst as a, t.inst as b, sum(least(p.x1, t.x1) - greatest(p.x0, t.x0)) as inter from pred p join truth t on p.image = t.image and p.row = t.row and least(p.x1, t.x1) > greatest(p.x0, t.x0) group by all)
, iou as (select ov.*, ap.area as area_a, tru.area as area_b, inter::double / (ap.area + tru.area - inter) as iou from ov join ap on ap.image = ov.image and ap.inst = a join tru on tru.image = ov.image and tru.inst = b)"""


@query(f"with {OVERLAP_SQL} select image, a, b, inter::bigint as inter, area_a::bigint as area_a, area_b::bigint as area_b, round(iou, 8) as iou from iou")
def mask_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19."""
    truth, pred, _ = _masks(spark, sf_dir)
    return rounded(masks.overlaps(pred, truth), "iou")


@query(f"""with {OVERLAP_SQL}, h as (select * from iou where iou > 0.5)
, s as (select coalesce((select sum(iou) from h), 0) as s, (select count(*) from h) as tp, (select count(*) from ap where (image, inst) not in (select (image, a) from h)) as fp, (select count(*) from tru where (image, inst) not in (select (image, b) from h)) as fn)
select round(s, 6) as s, tp, fp, fn, round(s / (tp + 0.5 * fp + 0.5 * fn), 8) as pq from s""")
def panoptic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A43."""
    truth, pred, _ = _masks(spark, sf_dir)
    out = masks.panoptic_quality(pred, truth)
    return out.withColumns({"s": F.round("s", 6), "pq": F.round("pq", 8)})


@query(f"""with {OVERLAP_SQL}, best as (select image, a, max(iou) as m from iou group by 1, 2)
select s.image, s.inst, s.score from scores s left join best on best.image = s.image and a = inst where score > 0.8 or (score > 0.3 and coalesce(m, 0) > 0.6)""")
def confirmed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    truth, pred, scores = _masks(spark, sf_dir)
    return masks.confirm(pred, truth, scores, 0.8, 0.3, 0.6)


@query(f"""with {OVERLAP_SQL}, best as (select image, a, max(iou) as m from iou group by 1, 2)
, kept as (select s.image, s.inst, s.score from scores s left join best on best.image = s.image and a = inst where score > 0.8 or (score > 0.3 and coalesce(m, 0) > 0.6))
, sb as (select image, inst, (image * 17 + inst * 31) % 100 / 100.0 as score from tru)
, cov as (select iou.image, b, max(inter::double / area_b) as c from iou join kept on kept.image = iou.image and kept.inst = a group by 1, 2)
select image, inst, score, 'a' as source from kept union all select sb.image, sb.inst, sb.score, 'b' from sb left join cov on cov.image = sb.image and b = inst where score >= 0.4 and coalesce(c, 0) < 0.2""")
def fused_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21."""
    truth, pred, scores = _masks(spark, sf_dir)
    other = truth.select("image", "inst").distinct().withColumn("score", (F.col("image") * 17 + F.col("inst") * 31) % 100 / 100.0)
    return masks.fuse(pred, truth, scores, other, 0.8, 0.3, 0.6, 0.4, 0.2)


@query(f"""with {OVERLAP_SQL}, g as (select unnest([0.0, 0.25, 0.5, 0.75]) as cut)
, k as (select cut, image, inst as a from scores, g where score >= cut)
, r as (select cut, k.image, k.a, sum(iou) as s, count(iou) as h from k left join (select * from iou where iou > 0.5) i on i.image = k.image and i.a = k.a group by 1, 2, 3)
, f as (select cut, count(distinct (i.image, i.b)) as found from k join iou i on i.image = k.image and i.a = k.a and iou > 0.5 group by 1)
, t as (select cut, coalesce(sum(s), 0) as s, sum(h)::bigint as tp, count(*) filter (where h = 0) as fp from r group by 1)
select cut::double as cut, round(s, 6) as s, tp, fp, (select count(*) from tru) - coalesce(found, 0) as fn, round(s / (tp + 0.5 * fp + 0.5 * ((select count(*) from tru) - coalesce(found, 0))), 8) as pq from t left join f using (cut)""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K20."""
    truth, pred, scores = _masks(spark, sf_dir)
    out = masks.threshold_grid(pred, truth, scores, [0.0, 0.25, 0.5, 0.75])
    return out.withColumns({"s": F.round("s", 6), "pq": F.round("pq", 8)})


@query("""
select l_orderkey, l_linenumber, case when l_linenumber = 7 then 0.5 when l_linenumber = 6 then 1.0 when l_linenumber = 5 then 0.0 else least(greatest((l_quantity - 5) / 40.0, 0), 1) end as p from lineitem""")
def sanitised_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, infinities and values outside [0, 1]."""
    n = F.col("l_linenumber")
    raw = F.when(n == 7, float("nan")).when(n == 6, float("inf")).when(n == 5, float("-inf")).otherwise((F.col("l_quantity") - 5) / 40.0)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.sanitise_probability(raw).alias("p"))


@query("""
with t as (select 'price' as task, l_orderkey as k, l_linenumber as n from lineitem union all select 'order', o_orderkey, 0 from orders union all select 'part', p_partkey, 0 from part)
, a as (select l_orderkey as k, l_linenumber as n, l_extendedprice as price from lineitem where l_linenumber <> 3), b as (select o_orderkey as k, o_totalprice as total from orders where o_orderstatus <> 'P'), c as (select p_partkey as k, p_retailprice as retail from part)
select task, t.k, t.n, coalesce(case when task = 'price' then price end, 0) as price, coalesce(case when task = 'order' then total end, 0) as total, coalesce(case when task = 'part' then retail end, 0) as retail
, case task when 'price' then price is null when 'order' then total is null else retail is null end as missing
from t left join a on task = 'price' and a.k = t.k and a.n = t.n left join b on task = 'order' and b.k = t.k left join c on task = 'part' and c.k = t.k""")
def tall_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keyed frames, two with gaps, as one sheet with zero defaults."""
    l, o, p = (read(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    a = l.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"))
    b = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"), "o_orderstatus")
    c = p.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("retail"))
    rows = lambda name, df, n: df.select(F.lit(name).alias("task"), "k", n.cast("long").alias("n"))
    template = rows("price", a, F.col("n")).unionByName(rows("order", b, F.lit(0))).unionByName(rows("part", c, F.lit(0)))
    frames = {"price": (a.filter("n <> 3"), ["k", "n"], "price"), "order": (b.filter("o_orderstatus <> 'P'"), ["k"], "total"), "part": (c, ["k"], "retail")}
    return contract.tall_sheet(template, frames, "task").select("task", "k", "n", "price", "total", "retail", "missing")


_PRINTED = ["orders", "part", "supplier"]


@query(" union all ".join(f"""select '{t}' as name, (select substr(sha256('[' || string_agg('"' || column_name || '"', ', ' order by column_index) || ']'), 1, 16) from duckdb_columns() where table_name = '{t}') as fingerprint, count(*) as n from {t}""" for t in _PRINTED))
def schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the fingerprint of each table's ordered columns, and its rows."""
    out = None
    for t in _PRINTED:
        df = read(spark, sf_dir, t)
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), F.lit(C.fingerprint(*df.columns)).alias("fingerprint"), "n")
        out = one if out is None else out.unionByName(one)
    return out
