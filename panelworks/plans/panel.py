"""Queries on hourly panels: slots, fills, climatology, runs, rolling statistics, window selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.functions import columns as C
from panelworks.operators import fill, grid, runs, windows
from panelworks.plans.base import HOURLY, LINK_CELLS, ORIGIN, hourly, link_cells, query, read, rounded, slot_range


@query(f"""
with e as (select event_id, floor((epoch(ts) - 1704067200) / 300)::bigint as slot from events)
select event_id, slot, (slot % 288 + 288) % 288 as slot_of_day, floor(slot / 288.0)::bigint as day, (floor(slot / 288.0)::bigint % 7 + 7) % 7 as weekday, (floor(slot / 288.0)::bigint % 7 + 7) % 7 >= 5 as weekend, (floor(slot / 2016.0)::bigint % 4 + 4) % 4 as fold
from e where slot // 288 between 3 and 26""")
def slot_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01, P02, P03, P04."""
    slot = C.slot_index(F.col("ts"), ORIGIN, 300)
    e = read(spark, sf_dir, "events").select("event_id", slot.alias("slot"))
    weekday = C.weekday_of(F.col("slot"), 288)
    out = e.select("event_id", "slot", C.slot_of_day(F.col("slot"), 288).alias("slot_of_day"), C.day_of(F.col("slot"), 288).alias("day"), weekday.alias("weekday"), (weekday >= 5).alias("weekend"), C.week_fold(F.col("slot"), 288, 4).alias("fold"))
    return out.filter(F.col("day").between(3, 26))


@query(f"""
with {HOURLY}
, near as (select *, last_value(value ignore nulls) over b as prev, last_value(case when value is not null then slot end ignore nulls) over b as ps
, first_value(value ignore nulls) over a as next, first_value(case when value is not null then slot end ignore nulls) over a as ns from hourly
  window b as (partition by panel order by slot rows between unbounded preceding and current row), a as (partition by panel order by slot rows between current row and unbounded following))
, i as (select *, case when ns = ps then value else prev + (next - prev) * (slot - ps) / (ns - ps) end as line from near)
select panel, slot, round(prev, 8) as prev, slot - ps as age, round(next, 8) as next, ns - slot as ahead
, round(coalesce(value, case when slot - ps <= 1 then line end), 8) as filled_first, round(coalesce(value, line, prev, next), 8) as filled_all from i""")
def fill_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01, W02, W03, W04, J11."""
    h = hourly(spark, sf_dir)
    first = fill.interpolate(h, ["panel"], "slot", "value", limit=1).withColumnRenamed("filled", "filled_first")
    line = F.col("prev") + (F.col("next") - F.col("prev")) * F.col("age") / (F.col("age") + F.col("ahead"))
    out = first.withColumn("filled_all", F.coalesce("value", line, "prev", "next")).drop("value")
    return rounded(out, "prev", "next", "filled_first", "filled_all")


@query(f"""
with {HOURLY}
, k as (select panel, (floor(slot / 24.0)::bigint % 7 + 7) % 7 as dow, (slot % 24 + 24) % 24 as hod, avg(value) as m from hourly group by all)
, d as (select distinct panel, dow from k)
select d.panel, d.dow, h.hod, round(coalesce(0.5 * coalesce(k.m, 0) + 0.25 * coalesce(a.m, 0) + 0.25 * coalesce(b.m, 0), 0), 8) as clim
from d cross join (select range::bigint as hod from range(24)) h
left join k on k.panel = d.panel and k.dow = d.dow and k.hod = h.hod
left join k a on a.panel = d.panel and a.dow = d.dow and a.hod = (h.hod + 1) % 24
left join k b on b.panel = d.panel and b.dow = d.dow and b.hod = (h.hod + 23) % 24""")
def weekly_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01, W05."""
    h = hourly(spark, sf_dir).withColumns({"dow": C.weekday_of(F.col("slot"), 24), "hod": C.slot_of_day(F.col("slot"), 24)})
    return rounded(fill.climatology(h, ["panel", "dow"], "hod", "value", 24), "clim")


@query(f"""
with {HOURLY}
, q as (select panel, (slot % 24 + 24) % 24 as hod, (floor(slot / 24.0)::bigint % 7 + 7) % 7 >= 5 as weekend, (floor(slot / 168.0)::bigint % 4 + 4) % 4 as fold, (value > 20)::int as y from hourly where value is not null)
, own as (select panel, hod, weekend, fold, sum(y) as s, count(y) as n from q group by all)
, o as (select *, sum(s) over (partition by panel, hod, weekend) - s as sc, sum(n) over (partition by panel, hod, weekend) - n as nc
, sum(s) over (partition by panel, hod) - sum(s) over (partition by panel, hod, fold) as sa, sum(n) over (partition by panel, hod) - sum(n) over (partition by panel, hod, fold) as na from own)
select panel, hod, weekend, fold, round((sc + 5.0 * case when na > 0 then sa / na else 0 end) / (nc + 5.0), 8) as rate from o""")
def shrunken_weekly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02."""
    h = hourly(spark, sf_dir).filter("value is not null").select("panel", C.slot_of_day(F.col("slot"), 24).alias("hod"), (C.weekday_of(F.col("slot"), 24) >= 5).alias("weekend"), C.week_fold(F.col("slot"), 24, 4).alias("fold"), (F.col("value") > 20).cast("int").alias("y"))
    return rounded(fill.shrunken_rate(h, ["panel", "hod"], "weekend", "fold", "y"), "rate")


ACTIVE = f"""{HOURLY}
, filled as (select panel, slot, value, last_value(value ignore nulls) over (partition by panel order by slot rows between 3 preceding and current row) as v from hourly)
, med as (select panel, median(value) as cut from hourly group by 1)
, act as (select panel, slot, v, cut from filled join med using (panel) where v <= cut)"""


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("panel").orderBy("slot").rowsBetween(-3, 0)
    h = hourly(spark, sf_dir).withColumn("v", F.last("value", ignorenulls=True).over(w))
    cut = h.groupBy("panel").agg(F.median("value").alias("cut"))  # a row for each panel
    return h.join(cut, "panel").withColumn("active", C.active(F.col("v"), F.col("cut"), F.lit(True)))


@query(f"""
with {ACTIVE}
, g as (select *, slot - row_number() over (partition by panel order by slot) as isle from act)
, r as (select panel, min(slot) as run_start, max(slot) as run_end, count(*) as n_flagged, min(v) as lowest from g group by panel, isle)
select panel, row_number() over (partition by panel order by run_start) as run, run_start, run_end, n_flagged, run_end - run_start + 1 as run_length, round(lowest, 8) as lowest from r""")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: S01, P01, W01, P06, W06. Hours at or under the panel's median, filled up to three hours, as runs."""
    out = runs.runs(_active(spark, sf_dir), ["panel"], "slot", "active", lowest=F.min("v"))
    return rounded(out, "lowest")


@query(f"""
with {ACTIVE}
, n as (select *, case when slot - lag(slot) over (partition by panel order by slot) <= 2 then 0 else 1 end as new from act)
, g as (select *, sum(new) over (partition by panel order by slot) as run from n)
select panel, slot, run::bigint as run, min(slot) over r as run_start, max(slot) over r as run_end, max(slot) over r - min(slot) over r + 1 as run_length
, slot - min(slot) over r + 1 as run_pos, max(slot) over r - slot + 1 as run_left from g window r as (partition by panel, run)""")
def run_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W07, W06 with a tolerated gap."""
    out = runs.mark_runs(_active(spark, sf_dir), ["panel"], "slot", "active", gap=1)
    return out.select("panel", "slot", F.col("run").cast("long").alias("run"), "run_start", "run_end", "run_length", "run_pos", "run_left")


@query(f"""
with {HOURLY}
, w as (select panel, slot, count(value) over h as n12, round(avg(value) over h, 8) as mean12, min(value) over h as min12_raw, max(value) over h as max12_raw
, count(*) filter (where value > 20) over h as high12, value - lag(value, 3) over o as d3, value - lag(value, 11) over o as d11
, (value + lag(value) over o + lag(value, 2) over o) / 3 as ma3
, regr_slope(value, slot) over (partition by panel order by slot rows between 5 preceding and current row) as slope6
, avg(value) over (partition by panel order by slot rows between 2 preceding and current row) as mean3 from hourly
  window h as (partition by panel order by slot rows between 12 preceding and 1 preceding), o as (partition by panel order by slot))
select panel, slot, n12, mean12, round(min12_raw, 8) as min12, round(max12_raw, 8) as max12, high12, round(d3, 8) as d3, round(d11, 8) as d11, round(mean3, 8) as mean3
, round(max(ma3) over (partition by panel order by slot rows between 9 preceding and current row), 8) as peak_ma3, round(slope6, 5) as slope6 from w""")
def rolling_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W08, W10, W11, W12, W13."""
    out = windows.rolling(hourly(spark, sf_dir), ["panel"], "slot", "value", 20.0)
    return rounded(out.drop("value"), "mean12", "min12", "max12", "d3", "d11", "mean3", "peak_ma3").withColumn("slope6", F.round("slope6", 5))


@query(f"""
with {LINK_CELLS}
, q as (select panel, slot, link, p >= 0.93 as active from links)
, f as (select *, coalesce(lead(active, 1) over o, false) as a1, coalesce(lead(active, 2) over o, false) as a2, coalesce(lead(active, 3) over o, false) as a3
, coalesce(lead(active, 4) over o, false) as a4, coalesce(lead(active, 5) over o, false) as a5, coalesce(lead(active, 6) over o, false) as a6 from q window o as (partition by panel, link order by slot))
select panel, slot, count(*) filter (where active) as now, count(*) filter (where a1 or a2 or a3 or a4 or a5 or a6) as later
, round((case when sum((active or a1)::int) = 0 then 1 else sum((active and a1)::int)::double / sum((active or a1)::int) end
 + case when sum((active or a2)::int) = 0 then 1 else sum((active and a2)::int)::double / sum((active or a2)::int) end
 + case when sum((active or a3)::int) = 0 then 1 else sum((active and a3)::int)::double / sum((active or a3)::int) end
 + case when sum((active or a4)::int) = 0 then 1 else sum((active and a4)::int)::double / sum((active or a4)::int) end
 + case when sum((active or a5)::int) = 0 then 1 else sum((active and a5)::int)::double / sum((active or a5)::int) end
 + case when sum((active or a6)::int) = 0 then 1 else sum((active and a6)::int)::double / sum((active or a6)::int) end) / 6, 8) as persistence_iou
from f group by panel, slot""")
def lookahead_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W09."""
    q = link_cells(spark, sf_dir).withColumn("active", F.col("p") >= 0.93)
    return rounded(windows.lookahead(q, ["panel"], "link", "slot", "active", 6), "persistence_iou")


CANDIDATES = f"""{LINK_CELLS}
, cand as (select panel, slot, count(*) filter (where p >= 0.95) >= 3 as ongoing from links group by 1, 2 having count(*) filter (where p >= 0.95) >= 1)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = link_cells(spark, sf_dir).groupBy("panel", "slot").agg(F.count_if(F.col("p") >= 0.95).alias("n"))
    return n.filter("n >= 1").select("panel", "slot", (F.col("n") >= 3).alias("ongoing"))


GREEDY = """, recursive_walk as (
  with recursive walk as (
    select panel, slot, ongoing, (not ongoing)::int as n0, ongoing::int as n1 from cand where (panel, slot) in (select (panel, min(slot)) from cand group by panel)
    union all
    select panel, slot, ongoing, n0, n1 from (
      select c.panel, c.slot, c.ongoing, w.n0 + (not c.ongoing)::int as n0, w.n1 + c.ongoing::int as n1
      , row_number() over (partition by c.panel order by c.slot) as rn
      from walk w join cand c on c.panel = w.panel and c.slot >= w.slot + 4 and ((c.ongoing and w.n1 < 5) or (not c.ongoing and w.n0 < 5))) where rn = 1)
  select * from walk)"""


@query(f"""
with {CANDIDATES} {GREEDY}
select panel, slot, ongoing from recursive_walk""")
def greedy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological, four slots apart, five of each condition."""
    return windows.greedy_spaced(_candidates(spark, sf_dir), ["panel"], "slot", "ongoing", spacing=4, quota=5)


@query(f"""
with recursive {CANDIDATES}
, walk as (
    select panel, ongoing, min(slot) as slot from cand group by panel, ongoing
    union all
    select panel, ongoing, slot from (
      select c.panel, c.ongoing, c.slot, row_number() over (partition by c.panel, c.ongoing order by c.slot) as rn
      from walk w join cand c on c.panel = w.panel and c.ongoing = w.ongoing and c.slot >= w.slot + 6) where rn = 1)
select panel, ongoing, slot from walk""")
def spaced_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing within each condition, no quota."""
    return windows.greedy_spaced(_candidates(spark, sf_dir), ["panel", "ongoing"], "slot", None, spacing=6, quota=None).select("panel", "ongoing", "slot")


@query(f"""
with recursive {CANDIDATES}
, starts as (select unnest(range((select least(0, floor(min(slot) / 4.0))::bigint from links), (select floor(max(slot) / 4.0)::bigint + 1 from links)))::bigint * 4 as s)
, sc as (select s, panel, slot, ongoing from cand, starts where slot >= s and slot < s + 40)
, walk as (
    select s, panel, slot, ongoing, (not ongoing)::int as n0, ongoing::int as n1 from sc where (s, panel, slot) in (select (s, panel, min(slot)) from sc group by s, panel)
    union all
    select s, panel, slot, ongoing, n0, n1 from (
      select c.s, c.panel, c.slot, c.ongoing, w.n0 + (not c.ongoing)::int as n0, w.n1 + c.ongoing::int as n1, row_number() over (partition by c.s, c.panel order by c.slot) as rn
      from walk w join sc c on c.s = w.s and c.panel = w.panel and c.slot >= w.slot + 4 and ((c.ongoing and w.n1 < 2) or (not c.ongoing and w.n0 < 2))) where rn = 1)
select panel, slot, ongoing, count(*) as draws from walk group by 1, 2, 3""")
def simulated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection from every start day, with how often each window is drawn."""
    first, _ = slot_range(spark, sf_dir, 21600)
    return windows.simulate(_candidates(spark, sf_dir), ["panel"], "slot", "ongoing", spacing=4, quota=2, first=first // 4 * 4, step=4, horizon=40)


@query(f"""
with {CANDIDATES}
, c as (select *, coalesce(slot - lag(slot) over (partition by panel, ongoing order by slot) > 1, true) as first_of_run, row_number() over (partition by panel order by slot) as rn from cand)
select panel, slot, ongoing, first_of_run, rn % 2 = 1 as every_second from c""")
def run_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W28."""
    c = _candidates(spark, sf_dir)
    gap = F.col("slot") - F.lag("slot").over(Window.partitionBy("panel", "ongoing").orderBy("slot"))
    every = F.row_number().over(Window.partitionBy("panel").orderBy("slot")) % 2 == 1
    return c.withColumn("first_of_run", F.coalesce(gap > 1, F.lit(True))).withColumn("every_second", every)


ORIGINS = f"""{CANDIDATES}
, origins as (select panel, slot as origin from cand )"""


@query(f"""
with {ORIGINS}
select o.panel, origin, slot - origin as step, link, round(v, 8) as v from origins o join links l on l.panel = o.panel and ((slot >= origin - 12 and slot < origin) or (slot > origin and slot <= origin + 6)) where v is not null""")
def window_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of 12 slots and horizon of 6 around each origin, by exploded slots and an equi-join."""
    origins = _candidates(spark, sf_dir).select("panel", F.col("slot").alias("origin"))
    cells = link_cells(spark, sf_dir).filter("v is not null").select("panel", "slot", "link", "v")
    return rounded(windows.around(origins, cells, ["panel"], "slot", [*range(-12, 0), *range(1, 7)]).select("panel", "origin", "step", "link", "v"), "v")


@query(f"""
with {ORIGINS}
, q as (select panel, slot, link, v is not null as ok, coalesce(v > 20, false) as q from links)
select o.panel, origin, link, round(sum((q and ok)::int)::double / nullif(sum(ok::int), 0), 8) as rate
from (select panel, origin, origin + f as slot from origins, (select distinct s - d * 4 as f from range(1, 8) d(d), range(-2, 3) s(s))) o join q using (panel, slot) group by all""")
def lookback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share active at the same slot, plus or minus two, of the seven days before."""
    origins = _candidates(spark, sf_dir).select("panel", F.col("slot").alias("origin"))
    cells = link_cells(spark, sf_dir).filter("v is not null").select("panel", "slot", "link", (F.col("v") > 20).cast("int").alias("q"))
    offsets = sorted({s - 4 * d for d in range(1, 8) for s in range(-2, 3)})
    seen = windows.around(origins, cells, ["panel"], "slot", offsets)
    base = origins.join(link_cells(spark, sf_dir).select("panel", "link").distinct(), "panel")
    in_reach = windows.around(origins, link_cells(spark, sf_dir).select("panel", "slot", "link"), ["panel"], "slot", offsets).select("panel", "origin", "link").distinct()
    rate = seen.groupBy("panel", "origin", "link").agg((F.sum("q") / F.count("q")).alias("rate"))
    return rounded(base.join(in_reach, ["panel", "origin", "link"], "left_semi").join(rate, ["panel", "origin", "link"], "left"), "rate")


@query(f"""
with {ORIGINS}
, s as (select panel, origin, origin % 4 as tod, (origin // 28) % 2 as fold from origins)
, y as (select panel, slot as origin, link, (p >= 0.95)::int as y from links)
, pairs as (select a.panel, a.origin, b.origin as other from s a join s b on a.panel = b.panel and abs(a.tod - b.tod) <= 1 and a.fold <> b.fold)
select p.panel, p.origin, y.link, count(*) as n_similar, case when count(*) >= 3 then round(avg(y.y), 8) end as prior
from pairs p join y on y.panel = p.panel and y.origin = p.other group by all""")
def similar_window_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of windows of other folds and similar time of day that hold the link, three windows at least."""
    origins = _candidates(spark, sf_dir).select("panel", F.col("slot").alias("origin"))
    s = origins.withColumn("tod", F.col("origin") % 4).withColumn("fold", F.floor(F.col("origin") / 28) % 2)
    y = link_cells(spark, sf_dir).select("panel", F.col("slot").alias("origin"), "link", (F.col("p") >= 0.95).cast("int").alias("y"))
    return rounded(windows.similar_prior(s, y, ["panel"], "origin", "tod", "fold", 1, 3), "prior")


@query(f"""
with {HOURLY}
, o as (select panel, slot as origin from hourly where value > 60 and slot % 5 = 0)
, dark as (select distinct panel, origin + d as slot from o, range(1, 7) t(d))
, hist as (select distinct panel, origin - d as slot from o, range(1, 4) t(d))
, truth as (select panel, slot, 100.0 + slot as truth from hourly)
select panel, slot, round(case when d.slot is not null then null when h.slot is not null then coalesce(value, truth) else value end, 8) as masked
from hourly join truth using (panel, slot) left join dark d using (panel, slot) left join hist h using (panel, slot)""")
def blackout_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18."""
    h = hourly(spark, sf_dir).withColumn("truth", 100.0 + F.col("slot"))
    origins = h.filter("value > 60 and slot % 5 = 0").select("panel", F.col("slot").alias("origin"))
    return rounded(grid.blackout(h, origins, "panel", "slot", "value", "truth", 6, 3).select("panel", "slot", "masked"), "masked")


@query(f"""
with {HOURLY}
, p as (select panel, slot, value, lead(value) over (partition by panel order by slot) as after from hourly)
select panel, slot, round(after - value, 8) as step_change from p where value is not null and after is not null""")
def valid_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive slots that are both observed."""
    return rounded(windows.transitions(hourly(spark, sf_dir).filter("value is not null"), ["panel"], "slot", "value"), "step_change")


@query(f"""
with m as (select min(ts) as t from events)
, a as (select event_id, user_id, ts, value from events where event_type = 'purchase')
, b as (select user_id, ts, max(value) as value from events where event_type = 'view' group by 1, 2)
select event_id, round(value_b, 8) as as_of, round(epoch(ts) - epoch(ts_b), 3) as as_of_age from (
  select a.event_id, a.ts, b.value as value_b, b.ts as ts_b, row_number() over (partition by a.event_id order by b.ts desc) as rn
  from a left join b on b.user_id = a.user_id and b.ts <= a.ts) where rn = 1""")
def sparse_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 without a spine: each purchase with the user's last view before it."""
    seconds = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    e = read(spark, sf_dir, "events").withColumn("t", seconds)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    out = fill.as_of(left, right, ["user_id"], "t", "value")
    return out.select("event_id", F.round("as_of", 8).alias("as_of"), F.round(F.col("as_of_age") / 1e6, 3).alias("as_of_age"))
