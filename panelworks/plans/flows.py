"""Queries on flows, blocks and rule forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.operators import balance, runs
from panelworks.plans.base import HOURLY, LINK_CELLS, hourly, link_cells, query, read, rounded, slot_range
from panelworks.plans.space import BLOCKS

#: Paths from a customer's nation to the order's key mod 25, per priority; flow in millions.
FLOWS_SQL = """flows as (select o_orderpriority as panel, least(c_nationkey, o_orderkey % 25) * 100 + greatest(c_nationkey, o_orderkey % 25) as path, o_orderkey % 5 as dest, round(sum(o_totalprice) / 1e6, 8) as f
  from orders join customer on o_custkey = c_custkey where c_nationkey <> o_orderkey % 25 group by all)
, paths as (select distinct path, path // 100 as o, path % 100 as d from flows)
, edges as (select path, k as link from paths, range(0, 25) t(k) where k >= o and k < d)"""


def _flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    a, b = F.col("c_nationkey").cast("long"), F.col("o_orderkey") % 25
    flows = o.filter(a != b).groupBy(F.col("o_orderpriority").alias("panel"), (F.least(a, b) * 100 + F.greatest(a, b)).alias("path"), (F.col("o_orderkey") % 5).alias("dest")).agg(F.round(F.sum("o_totalprice") / 1e6, 8).alias("f"))
    paths = flows.select("path").distinct().select("path", F.floor(F.col("path") / 100).alias("o"), (F.col("path") % 100).alias("d"))
    return flows, balance.crossings(paths)


@query(f"with {FLOWS_SQL} select link, round(sum(f), 8) as total, count(*) as n_paths from edges join flows using (path) group by 1")
def link_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22, J23."""
    flows, edges = _flows(spark, sf_dir)
    counted = edges.join(flows, "path").groupBy("link").agg(F.count(F.lit(1)).alias("n_paths"))
    return rounded(balance.incidence_product(edges, flows).join(counted, "link"), "total")


@query(f"""with {FLOWS_SQL}
, e as (select panel, path, dest, case when path % 3 = 0 then f * 1.1 when path % 3 = 1 then f * 0.95 else f end as e, f as t from flows)
, l as (select panel, link, sum(e) as e, sum(t) as t from e join edges using (path) group by 1, 2), d as (select panel, dest, sum(e) as e, sum(t) as t from e group by 1, 2)
, s as (select panel, greatest(0, 1 - sum(abs(e - t)) / sum(t)) as s_path, exp(-abs(sum(e) / sum(t) - 1)) as s_total from e group by 1)
, sl as (select panel, greatest(0, 1 - sum(abs(e - t)) / sum(t)) as s_link from l group by 1), sd as (select panel, greatest(0, 1 - sum(abs(e - t)) / sum(t)) as s_dest from d group by 1)
select panel, round(s_path, 7) as s_path, round(s_link, 7) as s_link, round(s_total, 7) as s_total, round(s_dest, 7) as s_dest, round(0.35 * s_path + 0.35 * s_link + 0.15 * s_total + 0.15 * s_dest, 7) as score from s join sl using (panel) join sd using (panel)""")
def trip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, M23."""
    flows, edges = _flows(spark, sf_dir)
    e = flows.withColumn("f", F.when(F.col("path") % 3 == 0, F.col("f") * 1.1).when(F.col("path") % 3 == 1, F.col("f") * 0.95).otherwise(F.col("f")))
    return rounded(balance.trip_scores(e, flows, edges), "s_path", "s_link", "s_total", "s_dest", "score", digits=7)


def _projected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, incidence and totals: the totals are those of rows moved by up to 8 %."""
    flows, edges = _flows(spark, sf_dir)
    b = flows.groupBy("path").agg(F.round(F.sum("f"), 6).alias("b"))
    moved = b.withColumn("f", F.col("b") * (1 + (F.col("path") % 5) * 0.02))
    return b, edges, balance.incidence_product(edges, moved.select("path", "f")).withColumnRenamed("total", "c")


PROJECTED = f"""{FLOWS_SQL}, b as (select path, round(sum(f), 6) as b from flows group by 1)
, c as (select link, sum(b * (1 + (path % 5) * 0.02)) as c from edges join b using (path) group by 1)"""


def _solved(weight: str, ridge: float) -> str:
    """The same table by conjugate gradients on (A W A' + ridge) mu = c - A b, which is exact if no row is cut at 0."""
    plus = "list_transform(list_zip({a}, {b}), lambda z: z[1] + ({f}) * z[2])"
    return f"""with recursive {PROJECTED}
, l as (select link, row_number() over (order by link) as i from c)
, m as (select x.link as i, y.link as j, sum({weight}) as m from edges x join edges y using (path) join b using (path) group by all)
, mat as (select list(coalesce(m.m, 0) + case when a.link = z.link then {ridge} else 0 end order by z.link) as row, a.link from l a cross join l z left join m on m.i = a.link and m.j = z.link group by a.link)
, r0 as (select list(c.c - t.t order by link) as r from c join (select link, sum(b) as t from edges join b using (path) group by 1) t using (link))
, mm as (select list(row order by link) as mat from mat)
, cg as (select 0 as k, list_transform(r, lambda v: 0.0::double) as x, r, r as p, list_dot_product(r, r) as rs from r0
  union all
  select k + 1, {plus.format(a="x", b="p", f="al")}, r2, {plus.format(a="r2", b="p", f="list_dot_product(r2, r2) / rs")}, list_dot_product(r2, r2)
  from (select *, {plus.format(a="r", b="q", f="-al")} as r2 from (select *, rs / list_dot_product(p, q) as al from (select cg.*, list_transform(mat, lambda row: list_dot_product(row, p)) as q from cg, mm where k < 120 and rs > 1e-22))))
, mu as (select unnest(x) as mu, generate_subscripts(x, 1) as i from (select x from cg order by k desc limit 1))
, t as (select path, sum(mu) as t from edges join l using (link) join mu using (i) group by 1)
select path, b, round(greatest(0, b + {weight} * t), 5) as fitted from b join t using (path)"""


@query(f"""with {PROJECTED} select link, round(c, 4) as c, round(c, 4) as fitted from c""")
def kl_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of the fitted table, which are to be the given ones; tests hold the rows against the optimum's form."""
    b, edges, totals = _projected(spark, sf_dir)
    fitted = balance.incidence_product(edges, balance.project(b, edges, totals, "kl"))
    return rounded(fitted.join(totals, "link").select("link", "c", F.col("total").alias("fitted")), "c", "fitted", digits=4)


def _fitted(spark: SparkSession, sf_dir: str, kind: str, ridge: float = 0.0) -> DataFrame:
    b, edges, totals = _projected(spark, sf_dir)
    return rounded(b.join(balance.project(b, edges, totals, kind, ridge, tolerance=1e-11).withColumnRenamed("f", "fitted"), "path"), "fitted", digits=5)


@query(_solved("1.0", 0.0))
def l2_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares."""
    return _fitted(spark, sf_dir, "l2")


@query(_solved("b", 0.0))
def chi2_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares in proportion to the row."""
    return _fitted(spark, sf_dir, "chi2")


@query(_solved("1.0", 5.0))
def ridge_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals may be missed at a price."""
    return _fitted(spark, sf_dir, "l2", 5.0)


@query(f"""with {PROJECTED}, d as (select link, round(c / 1000, 8) as mu from c) select path, round(sum(mu), 8) as t from edges join d using (link) group by 1""")
def path_duals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J22, transposed: the links' values summed along each path."""
    _, edges, totals = _projected(spark, sf_dir)
    return rounded(balance.incidence_transpose(edges, totals.select("link", F.round(F.col("c") / 1000, 8).alias("mu"))), "t")


@query(f"""with {FLOWS_SQL}
, est as (select 'scaled' as estimator, 'factor' as family, panel, path, dest, f * 1.1 as e, f as t from flows
  union all select 'thirds', 'factor', panel, path, dest, case when path % 3 = 0 then f * 1.2 else f end, f from flows
  union all select 'mean', 'flat', panel, path, dest, avg(f) over (partition by panel), f from flows)
, l as (select estimator, panel, link, sum(e) as e, sum(t) as t from est join edges using (path) group by 1, 2, 3), d as (select estimator, panel, dest, sum(e) as e, sum(t) as t from est group by 1, 2, 3)
, s as (select estimator, any_value(family) as family, panel, greatest(0, 1 - sum(abs(e - t)) / sum(t)) as s_path, exp(-abs(sum(e) / sum(t) - 1)) as s_total from est group by 1, 3)
, sl as (select estimator, panel, greatest(0, 1 - sum(abs(e - t)) / sum(t)) as s_link from l group by 1, 2), sd as (select estimator, panel, greatest(0, 1 - sum(abs(e - t)) / sum(t)) as s_dest from d group by 1, 2)
, z as (select *, 0.35 * s_path + 0.35 * s_link + 0.15 * s_total + 0.15 * s_dest as score from s join sl using (estimator, panel) join sd using (estimator, panel))
select estimator, panel, round(score, 7) as score, round(avg(score) over (partition by estimator), 7) as estimator_mean, round(avg(score) over (partition by family), 7) as family_mean from z""")
def estimator_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several estimators on fixed truths, and the means of each and of its family."""
    flows, edges = _flows(spark, sf_dir)
    mean = F.avg("f").over(Window.partitionBy("panel"))
    made = F.array(*[F.struct(F.lit(n).alias("estimator"), e.alias("f")) for n, e in (("scaled", F.col("f") * 1.1), ("thirds", F.when(F.col("path") % 3 == 0, F.col("f") * 1.2).otherwise(F.col("f"))), ("mean", F.col("_m")))])
    est = flows.withColumn("_m", mean).select("panel", "path", "dest", F.col("f").alias("t"), F.explode(made).alias("x")).select(F.concat_ws("|", "x.estimator", "panel").alias("panel"), "path", "dest", "x.f", "t")
    scored = balance.trip_scores(est.drop("t"), est.drop("f").withColumnRenamed("t", "f"), edges)
    out = scored.select(F.split("panel", r"\|")[0].alias("estimator"), F.split("panel", r"\|")[1].alias("panel"), "score").withColumn("family", F.when(F.col("estimator") == "mean", "flat").otherwise("factor"))
    means = out.withColumns({f"{n}_mean": F.avg("score").over(Window.partitionBy(n)) for n in ("estimator", "family")})
    return rounded(means.drop("family"), "score", "estimator_mean", "family_mean", digits=7)


@query(f"""
with {BLOCKS}
, m as (select n.panel, n.slot, n.a, n.b, o.a as oa, o.b as ob, row_number() over (partition by n.panel, n.slot, n.a order by case when o.a is null then 0 else least(n.b, o.b) - greatest(n.a, o.a) + 1 end desc, o.a) as rn
  from blocks n left join blocks o on o.panel = n.panel and o.slot = n.slot - 2 and o.a <= n.b and o.b >= n.a)
, s as (select panel, slot, k as step, greatest(round_even(a + coalesce(least(greatest((a - oa) / 2.0, -1.0), 1.0), 0) * k, 0)::bigint, 0) as f, least(round_even(b + coalesce(least(greatest((b - ob) / 2.0, -1.0), 1.0), 0) * k, 0)::bigint, 9) as l
  from m cross join (select range::bigint as k from range(1, 4)) where rn = 1)
select distinct panel, slot, step, link from s cross join (select range::bigint as link from range(10)) where link between f and l""")
def block_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17."""
    b = runs.runs(link_cells(spark, sf_dir).withColumn("flag", F.col("p") >= 0.9), ["panel", "slot"], "link", "flag").select("panel", "slot", "run_start", "run_end")
    return balance.extrapolate_blocks(b, b.withColumn("slot", F.col("slot") + 2), ["panel", "slot"], 2, 3, 1.0, 10)


@query(f"""
with {LINK_CELLS}
, q as (select panel, slot, link, p >= 0.9 as flag, p as k, coalesce(v, 0) as q, link - row_number() over (partition by panel, slot, p >= 0.9 order by link) as isle from links)
, m as (select *, avg(q) over (partition by panel, slot order by link rows between current row and 2 following) as qi, avg(q) over (partition by panel, slot order by link rows between 3 preceding and 1 preceding) as qo
, avg(k) over (partition by panel, slot order by link rows between current row and 2 following) as ki, avg(k) over (partition by panel, slot order by link rows between 3 preceding and 1 preceding) as ko
, avg(q) over (partition by panel, slot order by link rows between 2 preceding and current row) as qe, avg(q) over (partition by panel, slot order by link rows between 1 following and 3 following) as qn
, avg(k) over (partition by panel, slot order by link rows between 2 preceding and current row) as ke, avg(k) over (partition by panel, slot order by link rows between 1 following and 3 following) as kn from q)
select panel, slot, min(link) as run_start, max(link) as run_end, round(first(case when abs(ki - ko) >= 0.02 then (qi - qo) / (ki - ko) end order by link), 5) as tail_speed, round(last(case when abs(kn - ke) >= 0.02 then (qn - qe) / (kn - ke) end order by link), 5) as head_speed
from m where flag group by panel, slot, isle""")
def shock_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18."""
    q = link_cells(spark, sf_dir).select("panel", "slot", "link", (F.col("p") >= 0.9).alias("flag"), F.col("p").alias("k"), F.coalesce("v", F.lit(0.0)).alias("q"))
    return rounded(balance.shock_speed(q, ["panel", "slot"], "link", "flag", "q", "k", 3, 0.02), "tail_speed", "head_speed", digits=5)


@query(f"""
with {LINK_CELLS}
, o as (select distinct panel, slot as origin from links where slot % 10 = 0 and slot > 0)
, h as (select o.panel, origin, link, last(v order by slot) as last, max(slot) - origin as age from o join links l on l.panel = o.panel and l.slot between origin - 4 and origin - 1 and v is not null group by 1, 2, 3)
select panel, origin, link, round(last, 8) as last, age, step, last <= 15 as active from h cross join (select range::bigint as step from range(1, 7))""")
def persistence_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M26, P17."""
    c = link_cells(spark, sf_dir).select("panel", "slot", "link", "v")
    origins = c.filter("slot % 10 = 0 and slot > 0").select("panel", F.col("slot").alias("origin")).distinct()
    return rounded(balance.persistence(c, origins, ["panel"], ["link"], "slot", "v", 15.0, 4, 6), "last")


@query(f"""
with {HOURLY}
, s as (select *, case when slot % 11 <> 0 then value end as v from hourly)
, n as (select *, last_value(v ignore nulls) over b as pv, last_value(case when v is not null then slot end ignore nulls) over b as ps, first_value(v ignore nulls) over a as nv, first_value(case when v is not null then slot end ignore nulls) over a as ns from s
  window b as (partition by panel order by slot rows between unbounded preceding and current row), a as (partition by panel order by slot rows between current row and unbounded following))
, f as (select panel, value <= 15 as y, coalesce(coalesce(case when ns = ps then v else pv + (nv - pv) * (slot - ps) / (ns - ps) end, pv, nv) <= 15, false) as p from n where slot % 11 = 0 and value is not null)
select panel, count(*) as n, round(avg((y = p)::int), 8) as accuracy, round(count(*) filter (where y and p)::double / nullif(count(*) filter (where y), 0), 8) as recall, round(count(*) filter (where not y and not p)::double / nullif(count(*) filter (where not y), 0), 8) as specificity from f group by 1""")
def masked_fill_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15."""
    return rounded(balance.masked_check(hourly(spark, sf_dir), ["panel"], "slot", "value", "slot % 11 = 0", 15.0), "accuracy", "recall", "specificity")


@query(f"""
with {LINK_CELLS}
, att as (select s_suppkey % 10 as link, s_suppkey as sensor from supplier where s_suppkey % 10 < 6)
, sens as (select slot, sensor, (slot * 7 + sensor * 3) % 4 = 0 as valid from (select distinct slot from links) cross join (select distinct sensor from att where sensor % 3 <> 0))
, a as (select slot, link, bool_or(valid) as v from sens join att using (sensor) group by 1, 2)
select g.slot, g.link, coalesce(a.v, g.link not in (select link from att)) as ok from (select distinct slot, link from links) g left join a using (slot, link)""")
def attachment_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J26."""
    g = link_cells(spark, sf_dir).select("slot", "link").distinct()
    att = read(spark, sf_dir, "supplier").filter("s_suppkey % 10 < 6").select((F.col("s_suppkey") % 10).alias("link"), F.col("s_suppkey").alias("sensor"))
    slots = F.explode(F.sequence(*[F.lit(k).cast("long") for k in slot_range(spark, sf_dir, 21600)])).alias("slot")
    sens = att.filter("sensor % 3 <> 0").select("sensor", slots).withColumn("valid", (F.col("slot") * 7 + F.col("sensor") * 3) % 4 == 0)
    return balance.attachment_validity(g, att, sens)
