"""Queries on what a forecast is made from and how members are put together: carried deviations, similar windows, rows of
steps, origins, ensembles over folds, members' means, areas, estimators held against one truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.operators import balance, blend, fill, masks, windows
from panelworks.plans.base import HOURLY, LINK_CELLS, hourly, link_cells, query, read, rounded
from panelworks.plans.flows import _flows
from panelworks.plans.keyed import OVERLAP_SQL, _masks
from panelworks.plans.scores import ARMS_SQL, arms


@query(f"""
with {HOURLY}
, e as (select *, avg(value) over (partition by panel, (slot % 24 + 24) % 24) as expected from hourly)
, s as (select *, case when value is not null then slot end as o, case when value is not null then coalesce(expected, 'nan') end as x from e)
, n as (select *, last_value(value ignore nulls) over b as pv, last_value(o ignore nulls) over b as po, last_value(x ignore nulls) over b as px
  , first_value(value ignore nulls) over a as nv, first_value(o ignore nulls) over a as no, first_value(x ignore nulls) over a as nx from s
  window b as (partition by panel order by slot rows between unbounded preceding and 1 preceding), a as (partition by panel order by slot rows between 1 following and unbounded following))
select panel, slot, round(coalesce(pv + (nv - pv) * (slot - po) / (no - po), pv, nv), 8) as line
, round(expected + coalesce((pv - px + nv - nx) / 2, pv - px, nv - nx), 8) as carried from n""")
def deviation_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour from the observations around it, as a line and as its hour of day's mean plus their deviation."""
    h = hourly(spark, sf_dir)
    of_day = Window.partitionBy("panel", F.pmod("slot", F.lit(24)))
    out = fill.deviation_carry(h.withColumn("expected", F.avg("value").over(of_day)), ["panel"], "slot", "value", "expected")
    return rounded(out.select("panel", "slot", "line", "carried"), "line", "carried")


WINDOWS_SQL = f"""{LINK_CELLS}
, o as (select panel, slot as origin, (slot % 4 + 4) % 4 as tod, floor(slot / 28.0)::bigint % 2 as fold, (floor(slot / 4.0)::bigint % 7 + 7) % 7 >= 5 as weekend from links where p >= 0.95 group by all)
, y as (select panel, slot as origin, link, (p >= 0.95)::int as y from links)
, pairs as (select a.panel, a.origin, b.origin as other, abs(a.tod - b.tod) <= 1 as near, a.weekend = b.weekend as alike from o a join o b on a.panel = b.panel and a.fold <> b.fold)"""


@query(f"""with {WINDOWS_SQL}
, s as (select p.panel, p.origin, y.link, count(*) as n_all, avg(y.y) as m_all, count(*) filter (where near) as n_near, avg(y.y) filter (where near) as m_near
  , count(*) filter (where near and alike) as n_alike, avg(y.y) filter (where near and alike) as m_alike from pairs p join y on y.panel = p.panel and y.origin = p.other group by all)
, r as (select panel, origin, link, case when n_all >= 3 then m_all end as everywhere, case when n_near >= 3 then m_near end as near, case when n_alike >= 3 then m_alike end as alike from s)
select panel, origin, link, round(everywhere, 8) as everywhere, round(near, 8) as near, round(alike, 8) as alike, round(coalesce(near, everywhere), 8) as prior
, round(max(near) over (partition by panel, origin order by link range between 1 preceding and 1 following), 8) as beside from r""")
def similar_window_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of other folds at a similar time of day, also of the same class of weekdays, or any; the largest beside."""
    links = link_cells(spark, sf_dir)
    week = F.pmod(F.floor(F.col("slot") / 4), F.lit(7))
    origins = links.filter("p >= 0.95").select(
        "panel", F.col("slot").alias("origin"), F.pmod("slot", F.lit(4)).alias("tod"), (F.floor(F.col("slot") / 28) % 2).alias("fold"), (week >= 5).alias("weekend")
    ).distinct()
    truth = links.select("panel", F.col("slot").alias("origin"), "link", (F.col("p") >= 0.95).cast("int").alias("y"))
    kinds = {"everywhere": (None, None), "near": (1, None), "alike": (1, ["weekend"])}
    found = [windows.similar_prior(origins, truth, ["panel"], "origin", "tod", "fold", reach, 3, same).select("panel", "origin", "link", F.col("prior").alias(n)) for n, (reach, same) in kinds.items()]
    told = found[0].join(found[1], ["panel", "origin", "link"], "left").join(found[2], ["panel", "origin", "link"], "left")
    told = windows.neighbour_max(told.withColumn("prior", F.coalesce("near", "everywhere")), ["panel", "origin"], "link", "near", "beside")
    return rounded(told, *kinds, "prior", "beside")


@query(f"""
with {LINK_CELLS}
, d as (select panel, slot, link, min(case when v > 20 then link end) over (partition by panel, slot order by link rows between current row and unbounded following) - link as ahead from links)
, f as (select *, lag(ahead, 3) over (partition by panel, link order by slot) - ahead as closing from d)
, p as (select panel, link, (slot % 28 + 28) % 28 as phase, avg(coalesce(v > 20, false)::int) as rate, max(v) as peak from links group by all)
select panel, slot, f.link, step, ahead, round(p.rate, 8) as rate, round(p.peak, 8) as peak, round(ahead - closing * step / 3.0, 8) as ahead_proj
from f cross join (select range::bigint as step from range(1, 7)) left join p using (panel) where slot % 10 = 0 and p.link = f.link and p.phase = ((slot + step) % 28 + 28) % 28""")
def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six steps of every tenth slot, with the weekly profile at each step and the distance to the next active link as it closes in."""
    links = link_cells(spark, sf_dir)
    phase = F.pmod("slot", F.lit(28)).alias("phase")
    active = F.coalesce(F.col("v") > 20, F.lit(False))
    profile = links.groupBy("panel", "link", phase).agg(F.avg(active.cast("int")).alias("rate"), F.max("v").alias("peak"))
    next_active = F.min(F.when(active, F.col("link"))).over(Window.partitionBy("panel", "slot").orderBy("link").rowsBetween(0, Window.unboundedFollowing))
    d = links.select("panel", "slot", "link", (next_active - F.col("link")).alias("ahead"))
    d = d.withColumn("closing", F.lag("ahead", 3).over(Window.partitionBy("panel", "link").orderBy("slot")) - F.col("ahead"))
    rows = windows.expand_steps(d.filter("slot % 10 = 0").withColumn("phase", phase), 6, profile, ["panel", "link"], "phase", 28, "ahead", "closing", 3.0)
    return rounded(rows.drop("phase", "closing"), "rate", "peak", "ahead_proj")


@query(f"""
with recursive {LINK_CELLS}
, f as (select panel, slot, link, coalesce(v > 60, false)::int as now from links)
, w as (select panel, slot, link, now, sum(now) over (partition by panel, link order by slot rows between 2 preceding and current row) as held
  , sum(now) over (partition by panel, link order by slot rows between 1 following and 3 following) as later, count(*) over (partition by panel, link order by slot rows between 2 preceding and 3 following) as n from f)
, c as (select panel, slot, max(held) >= 2 as ongoing, sum(now * later) as i, sum(later + now * (3 - later)) as u from w group by 1, 2 having sum(later) > 0 and min(n) = 6)
, cand as (select panel, slot, ongoing from c where not ongoing or i <= 0.2 * u)
, walk as (
    select panel, ongoing, min(slot) as slot from cand group by 1, 2
    union all
    select panel, ongoing, slot from (
      select c.panel, c.ongoing, c.slot, row_number() over (partition by c.panel, c.ongoing order by c.slot) as rn
      from walk w join cand c on c.panel = w.panel and c.ongoing = w.ongoing and c.slot >= w.slot + 5) where rn = 1)
select panel, ongoing, slot from walk""")
def forecast_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets and ongoing places of each panel, five slots apart, without those where nothing changes."""
    flagged = link_cells(spark, sf_dir).withColumn("flag", F.col("v") > 60)
    return windows.select_origins(flagged, ["panel"], "link", "slot", "flag", history=2, horizon=3, least=2, cap=0.2, spacing=5)


FOLD_WEIGHTS = [("one", "quality", 0.7), ("one", "toxic", 1.0), ("two", "quality", 0.3), ("two", "toxic", 1.0), ("three", "quality", 0.5)]
SHARES = [("quality", 0.25)]


@query(f"""
with {ARMS_SQL}
, w(fold, target, w) as (values {", ".join(f"('{f}', '{t}', {w})" for f, t, w in FOLD_WEIGHTS)})
, m as (select doc_id, target, 'one' as fold, p from arms where arm <> 'c' union all select doc_id, target, 'two', p * p from arms where arm = 'b' union all select doc_id, target, 'two', 1 - p from arms where arm = 'a'
  union all select doc_id, target, 'three', p from arms where arm = 'c')
, means as (select fold, doc_id, target, round(avg(p), 9) as p from m group by 1, 2, 3)
, r as (select doc_id, fold, target, (rank() over (partition by fold, target order by p) + (count(*) over (partition by fold, target, p) - 1) / 2.0) / count(*) over (partition by fold, target) as r from means)
, e as (select doc_id, target, sum(w * r) / sum(w) as ensemble from r join w using (fold, target) group by 1, 2)
select doc_id, target, round(case when target = 'quality' then 0.75 * ensemble + 0.25 * b.p else ensemble end, 7) as ensemble from e join (select doc_id, target, p from arms where arm = 'b') b using (doc_id, target)""")
def fold_rank_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means in folds of two, two and one member, ranked, weighted by target, one target drawn to another score.

    Means are equal or differ by more than rounding: they are rounded before they are ranked.
    """
    a = arms(spark, sf_dir).drop("y")
    made = F.array(
        *[
            F.when(when, F.struct(F.lit(fold).alias("fold"), F.lit(member).alias("member"), p.alias("p")))
            for fold, member, when, p in (
                ("one", "m1", F.col("arm") == "a", F.col("p")),
                ("one", "m2", F.col("arm") == "b", F.col("p")),
                ("two", "m3", F.col("arm") == "b", F.col("p") * F.col("p")),
                ("two", "m4", F.col("arm") == "a", 1 - F.col("p")),
                ("three", "m5", F.col("arm") == "c", F.col("p")),
            )
        ]
    )
    members = a.select("doc_id", "target", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("doc_id", "target", "x.*")
    weights = spark.createDataFrame(FOLD_WEIGHTS, "fold string, target string, w double")
    told = blend.fold_ensemble(members, "member", "fold", ["doc_id"], "target", "p", weights, digits=9)
    other = a.filter("arm = 'b'").select("doc_id", "target", F.col("p").alias("ensemble"))
    return rounded(blend.target_mix(told, other, ["doc_id"], "target", "ensemble", spark.createDataFrame(SHARES, "target string, w double")), "ensemble", digits=7)


@query("""
with m as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice::double / 100 as hundreds, case when (o_orderkey + k) % 50 <> 0 then o_totalprice::double * (1 + k * 0.01) end as price from orders, range(0, 3) t(k))
select o_orderkey, o_custkey, o_orderpriority, round(avg(hundreds), 5) as hundreds, round(case when count(price) = 3 then avg(price) end, 4) as price, count(*) - count(price) as n_missing from m group by 1, 2, 3""")
def member_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members' tables of all orders, their other columns held to be the same."""
    total = F.col("o_totalprice").cast("double")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (total / 100).alias("hundreds"), total.alias("price"))
    members = orders.withColumn("member", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    members = members.withColumn("price", F.when((F.col("o_orderkey") + F.col("member")) % 50 != 0, F.col("price") * (1 + F.col("member") * 0.01)))
    out = blend.member_mean(members, "member", ["o_orderkey"], ["hundreds", "price"], 3)
    return rounded(rounded(out, "hundreds", digits=5), "price", digits=4)


_SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(f"""with {OVERLAP_SQL}, h as (select * from iou where iou > 0.5)
, q as (select (select sum(iou) from h) / ((select count(*) from h) + 0.5 * (select count(*) from ap where (image, inst) not in (select (image, a) from h)) + 0.5 * (select count(*) from tru where (image, inst) not in (select (image, b) from h))) as pq)
select side, count(*) as n, {", ".join(f"round(quantile_cont(area, {s}), 4) as p{round(100 * s)}" for s in _SHARES)}, round(any_value(pq), 8) as pq
from (select 'pred' as side, area from ap union all select 'true', area from tru), q group by 1""")
def area_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the areas of two sets of masks and the quality of one against the other."""
    truth, pred, _ = _masks(spark, sf_dir)
    told = [masks.area_percentiles(m, _SHARES).withColumn("side", F.lit(n)) for n, m in (("pred", pred), ("true", truth))]
    out = told[0].unionByName(told[1]).crossJoin(masks.panoptic_quality(pred, truth).select("pq"))  # one row
    return rounded(rounded(out, *[f"p{round(100 * s)}" for s in _SHARES], digits=4), "pq")


@query()
def projected_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior, its projections onto the totals of the links, a scaled prior and blends, held against the true table.

    The projections are iterations, so there is no SQL; tests hold them against the optimum and the scores against brute force.
    """
    flows, edges = _flows(spark, sf_dir)
    name = lambda *c: F.concat_ws("|", *c)
    keyed = flows.select(name("panel", "path", "dest").alias("key"), "panel", "path", "dest", "f").withColumn("b", F.col("f") * (0.9 + (F.col("path") % 7 - 3) * 0.05))
    crossed = edges.join(keyed.select("path", "panel", "key", "f"), "path").select(name("panel", "link").alias("link"), F.col("key").alias("path"), "f")
    incidence = crossed.select("link", "path")
    totals = balance.incidence_product(incidence, keyed.select(F.col("key").alias("path"), "f")).withColumnRenamed("total", "c")
    rows = keyed.select(F.col("key").alias("path"), F.round("b", 8).alias("b"))
    fitted = keyed
    for kind in ("l2", "kl", "chi2"):
        fitted = fitted.join(balance.project(rows, incidence, totals, kind).select(F.col("path").alias("key"), F.col("f").alias(kind)), "key")
    level = F.sum("f").over(Window.partitionBy("panel")) / F.sum("b").over(Window.partitionBy("panel"))
    fitted = fitted.withColumns({"scaled": F.col("b") * level, "blend": 0.9 * F.col("l2") + 0.1 * F.col("kl")}).withColumnRenamed("b", "prior")
    names = ["prior", "scaled", "l2", "kl", "chi2", "blend"]
    estimates = fitted.select("panel", "path", "dest", F.explode(F.array(*[F.struct(F.lit(n).alias("estimator"), F.col(n).alias("f")) for n in names])).alias("x")).select("x.estimator", "panel", "path", "dest", "x.f")
    families = flows.select("panel", F.when(F.substring("panel", 1, 1) <= "2", "urgent").otherwise("other").alias("family")).distinct()
    out = balance.compare_estimates(estimates, flows, edges, families)
    return rounded(out, "s_path", "s_link", "s_total", "s_dest", "score", "overall", digits=5)
