"""Queries along the space axis and set decoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.operators import decode, grid, runs, shapes, space
from panelworks.plans.base import LINK_AXIS, LINK_CELLS, link_axis, link_cells, query, rounded

KEYS = ["panel", "slot"]
PLACED = f"""{LINK_CELLS}, {LINK_AXIS}
, place as (select link, km, capacity, (round(coalesce(sum(km) over (order by link rows between unbounded preceding and 1 preceding), 0) * 1000))::bigint as metres from axis)
, cells as (select panel, slot, link, v, p, km, capacity, metres from links join place using (link))"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("link").rowsBetween(Window.unboundedPreceding, -1)  # ten rows
    place = link_axis(spark, sf_dir).withColumn("metres", F.round(F.coalesce(F.sum("km").over(w), F.lit(0.0)) * 1000).cast("long"))
    return link_cells(spark, sf_dir).join(F.broadcast(place), "link")


@query(f"""
with {LINK_CELLS}
select panel, slot, link, coalesce(lead(p, 1) over o, 0) as o_1, coalesce(lag(p, 1) over o, 0) as o_m1, coalesce(lead(p, 3) over o, 0) as o_3, coalesce(lag(p, 3) over o, 0) as o_m3
, coalesce(lead(p, 2) over o, last_value(p) over f) as h_2, coalesce(lag(p, 2) over o, first_value(p) over f) as h_m2 from links
window o as (partition by panel, slot order by link), f as (partition by panel, slot order by link rows between unbounded preceding and unbounded following)""")
def axis_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts along the axis, with zeros and with held ends."""
    c = space.offsets(link_cells(spark, sf_dir), KEYS, "link", "p", [1, -1, 3, -3])
    c = space.offsets(c, KEYS, "link", "p", [2, -2], hold=True).withColumnsRenamed({"o_2": "h_2", "o_m2": "h_m2"})
    return c.drop("v", "p")


@query(f"""
with {LINK_CELLS}
select c.panel, c.slot, c.link, round(a.v, 8) as c_m1_0, round(b.v, 8) as c_1_0, round(d.v, 8) as c_0_m1, round(e.v, 8) as c_0_1, round(f.v, 8) as c_m1_1 from links c
left join links a on a.panel = c.panel and a.slot = c.slot - 1 and a.link = c.link
left join links b on b.panel = c.panel and b.slot = c.slot + 1 and b.link = c.link
left join links d on d.panel = c.panel and d.slot = c.slot and d.link = c.link - 1
left join links e on e.panel = c.panel and e.slot = c.slot and e.link = c.link + 1
left join links f on f.panel = c.panel and f.slot = c.slot - 1 and f.link = c.link + 1""")
def neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J09."""
    out = space.neighbour_cells(link_cells(spark, sf_dir), ["panel"], "slot", "link", "v", [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, 1)]).drop("v", "p")
    return rounded(out, *[c for c in out.columns if c.startswith("c_")])


@query(f"""
with {PLACED}
, f as (select *, p >= 0.95 as flag from cells)
, b as (select panel, slot, link
, round(first_value(v ignore nulls) over (partition by panel, slot order by link rows between 1 following and 5 following), 8) as near_down
, round(last_value(v ignore nulls) over (partition by panel, slot order by link rows between 5 preceding and 1 preceding), 8) as near_up
, min(p) over (partition by panel, slot order by metres range between 1 following and 1000 following) as dn_1000
, min(p) over (partition by panel, slot order by metres range between 1000 preceding and 1 preceding) as up_1000
, min(p) over (partition by panel, slot order by metres range between 1001 following and 3000 following) as dn_3000
, min(p) over (partition by panel, slot order by metres range between 3000 preceding and 1001 preceding) as up_3000
, round(coalesce(sum(p) over (partition by panel, slot order by metres range between 1 following and 1000 following), 0), 8) as mass_dn_1000
, round(coalesce(sum(p) over (partition by panel, slot order by metres range between 1000 preceding and 1 preceding), 0), 8) as mass_up_1000
, round(coalesce(sum(p) over (partition by panel, slot order by metres range between 1 following and 2000 following), 0), 8) as mass_dn_2000
, round(coalesce(sum(p) over (partition by panel, slot order by metres range between 2000 preceding and 1 preceding), 0), 8) as mass_up_2000
, min(capacity) over (partition by panel, slot order by metres range between current row and 2000 following) as least_capacity
, least(coalesce(first_value(case when flag then metres end ignore nulls) over (partition by panel, slot order by metres rows between current row and unbounded following) - metres, 3000), 3000) as dist_down
, least(coalesce(metres - last_value(case when flag then metres end ignore nulls) over (partition by panel, slot order by metres rows between unbounded preceding and current row), 3000), 3000) as dist_up from f)
select * from b""")
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, J16, J17, W15, W16, W17."""
    c = _placed(spark, sf_dir).withColumn("flag", F.col("p") >= 0.95)
    c = space.nearest_observed(c, KEYS, "link", "v", 5)
    c = space.band_minimum(c, KEYS, "metres", "p", [(0, 1000), (1000, 3000)])
    c = space.band_mass(c, KEYS, "metres", "p", [1000, 2000], least="capacity")
    c = runs.nearest_flag(c, KEYS, "metres", "flag", 3000)
    out = c.withColumns({"dist_down": F.col("dist_down").cast("long"), "dist_up": F.col("dist_up").cast("long")}).drop("v", "p", "km", "capacity", "metres", "flag")
    return rounded(out, "near_down", "near_up", "mass_dn_1000", "mass_up_1000", "mass_dn_2000", "mass_up_2000")


@query(f"""
with {PLACED}
, b as (select *, max(p) over k as p_max, sum(p) over k as p_sum, row_number() over (partition by panel, slot order by p desc, link) - 1 as p_rank
, first_value(link) over (partition by panel, slot order by p desc, link) as bl, first_value(metres) over (partition by panel, slot order by p desc, link) as bm
, coalesce(lead(p) over o, 0) as pn, coalesce(lag(p) over o, 0) as pp from cells window k as (partition by panel, slot), o as (partition by panel, slot order by link))
select panel, slot, link, p_max, round(p_sum, 8) as p_sum, round(p / greatest(p_max, 1e-6), 8) as p_rel, p_rank, link - bl as off_best, metres - bm as m_best, round(p * (1 - pn), 8) as head, round(p * (1 - pp), 8) as tail from b""")
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18."""
    out = space.profile(_placed(spark, sf_dir).select("panel", "slot", "link", "metres", "p"), KEYS, "link", "metres", "p")
    return rounded(out.drop("p", "metres"), "p_sum", "p_rel", "head", "tail")


@query(f"""
with {LINK_CELLS}
, s as (select panel, slot, avg((p >= 0.9)::int) as share, min(p) as least from links group by 1, 2)
select panel, slot, round(share, 8) as share, least, round(share - lag(share, 1) over o, 8) as trend_1, round(share - lag(share, 4) over o, 8) as trend_4 from s window o as (partition by panel order by slot)""")
def axis_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W29."""
    c = link_cells(spark, sf_dir).withColumn("flag", F.col("p") >= 0.9)
    return rounded(space.axis_context(c, ["panel"], "slot", "p", "flag"), "share", "trend_1", "trend_4")


@query(f"""
with {PLACED}
select distinct link, 9 - link as pos_rev, metres as m, round((select sum(km) from axis) * 1000 - metres - km * 1000)::bigint as m_rev from cells""")
def reversed_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J25, W15."""
    out = grid.reverse_axis(link_axis(spark, sf_dir).withColumn("axis", F.lit(1)), ["axis"], "link", "km")
    return out.select("link", "pos_rev", F.round(F.col("before") * 1000).cast("long").alias("m"), F.round(F.col("before_rev") * 1000).cast("long").alias("m_rev"))


BLOCKS = f"""{LINK_CELLS}
, fl as (select *, p >= 0.9 as flag, link - row_number() over (partition by panel, slot, p >= 0.9 order by link) as isle from links)
, blocks as (select panel, slot, min(link) as a, max(link) as b, sum(p) as mass from fl where flag group by panel, slot, isle)"""


@query(f"""
with {BLOCKS}
, n as (select panel, slot, count(*) as n_blocks from blocks group by 1, 2)
, j as (select l.panel, l.slot, l.link, b.a, b.b, b.mass, row_number() over (partition by l.panel, l.slot, l.link order by b.a nulls last) as rn
  from links l left join blocks b on b.panel = l.panel and b.slot = l.slot and b.b >= l.link)
select j.panel, j.slot, j.link, a as tail, b as head, b - a + 1 as block_length, round(mass, 8) as block_mass, coalesce(n_blocks, 0) as n_blocks from j left join n using (panel, slot) where rn = 1""")
def block_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W19."""
    c = link_cells(spark, sf_dir).withColumn("flag", F.col("p") >= 0.9)
    return rounded(runs.block_geometry(c, KEYS, "link", "flag", "p").drop("v", "p", "flag"), "block_mass")


@query(f"""
with {BLOCKS}
, pairs as (select n.panel, n.slot, n.a as run_start, n.b as run_end, o.a as before_start, o.b as before_end, least(n.b, o.b) - greatest(n.a, o.a) + 1 as overlap
, row_number() over (partition by n.panel, n.slot, n.a order by case when o.a is null then 0 else least(n.b, o.b) - greatest(n.a, o.a) + 1 end desc, o.a) as rn
  from blocks n left join blocks o on o.panel = n.panel and o.slot = n.slot - 2 and o.a <= n.b and o.b >= n.a)
select panel, slot, run_start, run_end, before_start, before_end, case when before_start is null then 0 else overlap end as overlap, run_start - before_start as tail_moved, run_end - before_end as head_moved from pairs where rn = 1""")
def block_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block against the block of two slots before with the largest overlap."""
    b = runs.runs(link_cells(spark, sf_dir).withColumn("flag", F.col("p") >= 0.9), KEYS, "link", "flag").select("panel", "slot", "run_start", "run_end")
    out = runs.overlap_match(b, b.withColumn("slot", F.col("slot") + 2), KEYS)
    return out.withColumns({"tail_moved": F.col("run_start") - F.col("before_start"), "head_moved": F.col("run_end") - F.col("before_end")})


@query(f"""
with {LINK_CELLS}
, f as (select *, last_value(case when p >= 0.93 then link end ignore nulls) over (partition by panel, slot order by link rows between unbounded preceding and current row) as b
, first_value(case when p >= 0.93 then link end ignore nulls) over (partition by panel, slot order by link rows between current row and unbounded following) as a from links)
select panel, slot, link, coalesce(p >= 0.93 or a - b <= 3, false) as closed from f""")
def closed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W22."""
    c = link_cells(spark, sf_dir).withColumn("flag", F.col("p") >= 0.93)
    return runs.close_gaps(c, KEYS, "link", "flag", 2).select("panel", "slot", "link", "closed")


CLUSTERS = f"""{LINK_CELLS}
, hit as (select *, case when link - lag(link) over (partition by panel, slot order by link) <= 2 then 0 else 1 end as new from links where p >= 0.93)
, num as (select *, sum(new) over (partition by panel, slot order by link) as run from hit)
, span as (select panel, slot, run, min(link) as a, max(link) as b from num group by all)
, clus as (select s.panel, s.slot, s.run, s.a, s.b, round(sum(p), 9) as mass, max(p) as peak from span s join links l on l.panel = s.panel and l.slot = s.slot and l.link between s.a and s.b group by all)
, placed as (select *, row_number() over (partition by panel, slot order by mass desc, a) as place, count(*) over (partition by panel, slot) as n_clusters from clus)"""


@query(f"""
with {CLUSTERS}
select panel, slot, a as run_start, b as run_end, mass, peak, place = 1 as top, n_clusters from placed""")
def probability_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W21."""
    return decode.clusters(link_cells(spark, sf_dir), KEYS, "link", "p", 0.93).drop("run", "place")


TOP = """, rk as (select *, row_number() over (partition by panel, slot order by p desc, link) as rn, sum(p) over (partition by panel, slot order by p desc, link rows between unbounded preceding and current row) as cum
, sum(p) over (partition by panel, slot) as total from src)
, ex as (select *, round(cum / (rn + total - cum), 9) as expected from rk)
, mm as (select panel, slot, first(rn order by expected desc, rn) as m from ex group by 1, 2)"""


@query(f"""
with {LINK_CELLS}, src as (select panel, slot, link, p from links) {TOP}
select panel, slot, link, p, rn, expected from ex join mm using (panel, slot) where rn <= m""")
def expected_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K01."""
    return decode.expected_top(link_cells(spark, sf_dir).drop("v"), KEYS, "p", ["link"]).withColumn("rn", F.col("rn").cast("long"))


@query(f"""
with {LINK_CELLS}, src as (select panel, slot, link, least(power(p, 8.0), 1.0) as p from links) {TOP}
select panel, slot, link, rn from ex join (select panel, slot, first(rn order by expected desc, rn) as m from ex where rn <= 4 group by 1, 2) using (panel, slot) where rn <= m""")
def powered_capped_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-modified and capped."""
    return decode.expected_top(link_cells(spark, sf_dir).drop("v"), KEYS, "p", ["link"], cap=4, power=8.0).select("panel", "slot", "link", F.col("rn").cast("long").alias("rn"))


@query(f"""
with {LINK_CELLS}, t as (select *, row_number() over (partition by panel, slot order by p desc, link) as n from links)
select panel, slot, link, p from t where p >= 0.96 or n = 1""")
def threshold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K04."""
    return decode.threshold(link_cells(spark, sf_dir).drop("v"), KEYS, "p", 0.96)


RANGES = f"""{LINK_CELLS}
, pre as (select panel, slot, link, sum(p) over (partition by panel, slot order by link rows between unbounded preceding and current row) as c, p, sum(p) over (partition by panel, slot) as total from links)
, rng as (select a.panel, a.slot, a.link as a, b.link as b, b.link - a.link + 1 as size, b.c - a.c + a.p as s, a.total from pre a join pre b on a.panel = b.panel and a.slot = b.slot and b.link >= a.link)
, er as (select *, round(s / (size + total - s), 9) as e from rng)"""


@query(f"""
with {RANGES}
, w as (select *, row_number() over (partition by panel, slot order by e desc, size, a) as rn from er where size <= 6)
select panel, slot, a as first, b as last, e as expected from w where rn = 1""")
def expected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K02."""
    return decode.expected_range(link_cells(spark, sf_dir), KEYS, "link", "p", most=6)


@query(f"""
with {RANGES}
, best as (select panel, slot, first(link order by p desc, link) as top from links group by 1, 2)
, w as (select er.*, row_number() over (partition by er.panel, er.slot order by e desc, a) as rn from er join best on best.panel = er.panel and best.slot = er.slot and er.b = best.top)
select panel, slot, a as first, b as last, e as expected from w where rn = 1""")
def anchored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that end at the first maximum."""
    c = link_cells(spark, sf_dir)
    top = F.max_by("link", F.struct("p", (-F.col("link")).alias("o"))).over(Window.partitionBy(*KEYS))
    return decode.expected_range(c.withColumn("top", top), KEYS, "link", "p", most=40, end="top")


@query(f"""
with {CLUSTERS}
, chosen as (select p.* from placed p where place = 1 or (place = 2 and mass >= 0.8 * (select mass from placed q where q.panel = p.panel and q.slot = p.slot and q.place = 1)))
, src as (select l.panel, l.slot, l.link, l.p from links l join chosen c on c.panel = l.panel and c.slot = l.slot and l.link between c.a and c.b
  union all select panel, slot, link, p from (select *, row_number() over (partition by panel, slot order by p desc, link) as n from links where (panel, slot) not in (select (panel, slot) from clus)) where n = 1) {TOP}
select panel, slot, link, p, rn from ex join mm using (panel, slot) where rn <= m""")
def site_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K05."""
    return decode.site(link_cells(spark, sf_dir).drop("v"), KEYS, "link", "p", 0.93, ratio=0.8).select("panel", "slot", "link", "p", F.col("rn").cast("long").alias("rn"))


@query(f"""
with {LINK_CELLS}
, t as (select panel, slot, link from links where p >= 0.95)
, sets as (select panel, slot, list(link) as s, count(*) as n from t group by 1, 2)
, r as (select a.a, b.b from (select range::bigint as a from range(10)) a cross join (select range::bigint as b from range(10)) b where b >= a)
, m as (select panel, a, b, round(avg(len(list_filter(s, lambda x: x between a and b))::double / (b - a + 1 + n - len(list_filter(s, lambda x: x between a and b)))), 9) as m from sets cross join r group by all)
select panel, a as first, b as last, m as mean_iou from (select *, row_number() over (partition by panel order by m desc, a, b) as rn from m) where rn = 1""")
def best_range_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K03, M26 for onsets."""
    t = link_cells(spark, sf_dir).filter("p >= 0.95").select("panel", "slot", "link")
    return decode.best_range_of_sets(t, ["panel"], "slot", "link", 10)


@query(f"""
with {BLOCKS}
, h as (select panel, b as head, b - a + 1 as size from blocks)
, k as (select panel, head, k, round(avg(least(k, size)::double / greatest(k, size)), 9) as r, count(*) as n from h cross join (select range::bigint as k from range(1, 11)) group by all having count(*) >= 5)
select panel, head, k as extent, r as mean_ratio, n from (select *, row_number() over (partition by panel, head order by r desc, k) as rn from k) where rn = 1""")
def best_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32, K08."""
    b = runs.runs(link_cells(spark, sf_dir).withColumn("flag", F.col("p") >= 0.9), KEYS, "link", "flag")
    return decode.best_extent(b.select("panel", F.col("run_end").alias("head"), F.col("run_length").alias("size")), ["panel", "head"], 10, 5)


@query(f"""
with {LINK_CELLS}
, r as (select *, row_number() over (partition by panel, link order by p desc, slot) as n from links)
select panel, link, max(p) as pool_max, round(avg(p), 8) as pool_mean, round(avg(p) filter (where n <= 5), 8) as pool_top, round(sum(exp(4 * p) * p) / sum(exp(4 * p)), 8) as pool_soft from r group by 1, 2""")
def pooled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K21."""
    return rounded(decode.pool(link_cells(spark, sf_dir), ["panel", "link"], "p", ["slot"], 5, 4.0), "pool_mean", "pool_top", "pool_soft")


@query(f"""
with {LINK_CELLS}
select panel, slot, link, round(exp(p - max(p) over k) / sum(exp(p)) over k * exp(max(p) over k), 8) as softmax from links window k as (partition by panel, slot)""")
def segment_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A46."""
    return rounded(decode.segment_softmax(link_cells(spark, sf_dir), KEYS, "p").drop("v", "p"), "softmax")


@query("""
with e as (select l_suppkey as a, l_suppkey + 1 as b from lineitem where l_partkey % 2 = 0 union all select l_suppkey + 1, l_suppkey from lineitem where l_partkey % 5 = 0)
, pairs as (select link as a, lead(link) over (order by link) as b from (select s_suppkey as link from supplier))
select count(*) filter (where (a, b) in (select (a, b) from e)) as forward, count(*) filter (where (b, a) in (select (a, b) from e)) as backward from pairs where b is not null""")
def direction_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J24."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey")
    a, b = F.col("l_suppkey"), F.col("l_suppkey") + 1
    edges = l.filter("l_partkey % 2 = 0").select(a.alias("from_link"), b.alias("to_link")).unionByName(l.filter("l_partkey % 5 = 0").select(b.alias("from_link"), a.alias("to_link")))
    axis = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("link"))
    return space.direction_vote(axis, edges, "link", "link")


@query(f"""
with {LINK_CELLS}
, f as (select panel, slot, link, v, coalesce(avg(p) over (partition by panel, link), 0) as prior, min(v) over h as ratio_least
, coalesce(min(case when p >= 0.97 then link end) over (partition by panel, slot order by link rows between current row and unbounded following) - link, 99) as down_now
, coalesce(link - max(case when p >= 0.97 then link end) over (partition by panel, slot order by link rows between unbounded preceding and current row), 99) as up_now
from links window h as (partition by panel, link order by slot rows between 2 preceding and current row))
, g as (select *, lag(down_now, 2) over (partition by panel, link order by slot) as down_before from f)
select panel, slot, link, down_now, up_now, down_before from g
where down_now <= 2 or up_now <= 1 or coalesce(down_before <= 1, false) or coalesce(ratio_least <= 1.5, false) or coalesce(v <= 1.6, false) or prior >= 0.95""")
def near_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are near a true cell, low now or of late, or often true."""
    cells = link_cells(spark, sf_dir).withColumn("flag", F.col("p") >= 0.97)
    near = runs.nearest_flag(cells, KEYS, "link", "flag", 99.0).withColumnsRenamed({"dist_down": "down_now", "dist_up": "up_now"})
    by_link = Window.partitionBy("panel", "link").orderBy("slot")
    told = near.withColumns({
        "ratio_last": F.col("v"), "ratio_least": F.min("v").over(by_link.rowsBetween(-2, 0)), "prior": F.avg("p").over(Window.partitionBy("panel", "link")), "down_before": F.lag("down_now", 2).over(by_link),
    })
    limits = {"down_now": 2.0, "up_now": 1.0, "down_before": 1.0, "ratio_least": 1.5, "ratio_last": 1.6}
    out = told.filter(shapes.is_candidate(limits, {"prior": 0.95}))
    return out.select("panel", "slot", "link", *[F.col(c).cast("long").alias(c) for c in ("down_now", "up_now", "down_before")])


#: Extents of heads on the other folds, top sets and their clusters.
HEAD_EXTENT = f"""{BLOCKS}
, h as (select panel, slot % 4 as fold, b as head, b - a + 1 as size from blocks)
, er as (select panel, f.fold, head, k, round(avg(least(k, size)::double / greatest(k, size)), 9) as r from h join (select range::bigint as fold from range(4)) f on f.fold <> h.fold cross join (select range::bigint as k from range(1, 11)) group by all having count(*) >= 5)
, extents as (select panel, fold, head, first(k order by r desc, k) as extent from er group by 1, 2, 3)
, src as (select panel, slot, link, p from links) {TOP}
, tops as (select panel, slot, link, p, link - row_number() over (partition by panel, slot order by link) as isle from ex join mm using (panel, slot) where rn <= m)
, tc as (select panel, slot, isle, min(link) as a, max(link) as b, round(sum(p), 9) as mass from tops group by 1, 2, 3)
, best as (select panel, slot, first(a order by mass desc, a) as a, first(b order by mass desc, a) as head from tc group by 1, 2)
, told as (select best.*, extent, greatest(best.head - extent + 1, 0) as lo from best left join extents e on e.panel = best.panel and e.fold = best.slot % 4 and e.head = best.head)"""


def _heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = link_cells(spark, sf_dir).withColumn("fold", F.col("slot") % 4)
    blocks = runs.runs(cells.withColumn("flag", F.col("p") >= 0.9), [*KEYS, "fold"], "link", "flag")
    heads = blocks.select("panel", "fold", F.col("run_end").alias("head"), F.col("run_length").alias("size"))
    return cells.drop("v"), shapes.held_out_extents(heads, ["panel", "head"], "fold", 4, 10, 5)


@query(f"""
with {HEAD_EXTENT}
select panel, slot, link from tops join told using (panel, slot) where extent is null or link not between a and head
union select panel, slot, unnest(range(lo, head + 1)) as link from told where extent is not null""")
def head_extent_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K08, A32 fold-safe: the best block at the head of the heaviest cluster, and the other clusters."""
    cells, extents = _heads(spark, sf_dir)
    return shapes.head_extent(cells, KEYS, "link", "p", extents, ["panel", "fold"])


@query(f"""
with {HEAD_EXTENT}
, n as (select panel, slot, link, link between a and head as own, coalesce(link between lo - 1 and head + 1, false) as near from tops join told using (panel, slot))
, s as (select *, bool_or(near) over (partition by panel, slot) as any_near from n)
select panel, slot, link from s where not any_near or near or not own""")
def head_extent_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top set within a place of the best block, and the other clusters."""
    cells, extents = _heads(spark, sf_dir)
    return shapes.head_extent(cells, KEYS, "link", "p", extents, ["panel", "fold"], hybrid=True)


@query(f"""
with {LINK_CELLS}
, truth as (select panel, slot, slot % 4 as fold, list(link order by link) as s from links where p >= 0.97 group by all)
, mem as (select panel, array_to_string(s, ' ') as set, fold, count(*) as often from truth group by all)
, lib as (select distinct panel, array_to_string(s, ' ') as set, s from truth)
, win as (select panel, slot, slot % 4 as fold, sum(p) as total, list(struct_pack(link := link, p := p, o := ln(least(greatest(p, 1e-4), 1 - 1e-4)) - ln(1 - least(greatest(p, 1e-4), 1 - 1e-4)))) as c from links group by all)
, pr as (select w.panel, w.slot, w.total, m.set, sum(often) as prior from win w join mem m on m.panel = w.panel and m.fold <> w.fold group by all)
, lk as (select pr.*, lib.s, list_sum(list_transform(list_filter(w.c, lambda x: list_contains(lib.s, x.link)), lambda x: x.o)) as loglik, list_sum(list_transform(list_filter(w.c, lambda x: list_contains(lib.s, x.link)), lambda x: x.p)) as inside
  from pr join lib using (panel, set) join win w using (panel, slot))
, po as (select *, prior * exp(0.3 * (loglik - max(loglik) over (partition by panel, slot))) as w from lk)
, post as (select *, w / sum(w) over (partition by panel, slot) as post from po)
, src as (select panel, slot, link, p from links) {TOP}
, tops as (select panel, slot, list(link) as s, sum(p) as inside from ex join mm using (panel, slot) where rn <= m group by 1, 2)
, cand as (select panel, slot, set, s, inside, total, 0 as last from post union all select panel, slot, 'top', tops.s, tops.inside, win.total, 1 from tops join win using (panel, slot))
, sc as (select c.panel, c.slot, c.set, c.last, any_value(c.inside / (len(c.s) + c.total - c.inside)) as ind, coalesce(sum(q.post * len(list_intersect(c.s, q.s)) / (len(c.s) + len(q.s) - len(list_intersect(c.s, q.s)))), 0) as e
  from cand c left join post q using (panel, slot) group by all)
, r as (select *, round(0.7 * e + 0.3 * ind, 8) as score from sc)
select panel, slot, first(set order by score desc, last, set) as set, max(score) as score from r group by 1, 2""")
def library_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior over the sets that were true in other folds."""
    cells = link_cells(spark, sf_dir).drop("v").withColumn("fold", F.col("slot") % 4)
    sets, members = shapes.library(cells.filter("p >= 0.97"), ["panel"], "slot", "link", "fold")
    return shapes.library_decode(cells, ["panel", "slot", "fold"], ["panel"], "link", "p", "fold", sets, members).drop("fold")
