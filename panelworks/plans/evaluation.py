"""Queries of evaluation tables and the last row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions import columns as C
from panelworks.operators import contract, evals, learn, masks, score, space, windows
from panelworks.plans.base import LINK_CELLS, link_cells, query, read, rounded
from panelworks.plans.scores import ARMS_SQL, arms

SETS = f"""{LINK_CELLS}
, sets as (select panel, slot, link, p, v, p >= 0.95 as pred, coalesce(v > 25, false) as truth from links)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_cells(spark, sf_dir).withColumns({"pred": F.col("p") >= 0.95, "truth": F.coalesce(F.col("v") > 25, F.lit(False))})


@query(f"""
with {LINK_CELLS}
, w as (select panel, slot, c.cut as variant, case when count(*) filter (where p >= c.cut or v > 25) = 0 then 1.0 else count(*) filter (where p >= c.cut and v > 25)::double / count(*) filter (where p >= c.cut or v > 25) end as iou
  from links cross join (values (0.9), (0.93), (0.96)) c(cut) group by all)
, m as (select variant::varchar as variant, panel, avg(iou) as mean from w group by all)
, d as (select *, mean - max(case when variant = '0.90' then mean end) over (partition by panel) as delta from m)
select variant, panel, round(mean, 8) as mean, round(delta, 8) as delta, round(avg(delta) over (partition by variant), 8) as mean_delta, count(*) filter (where round(delta, 9) > 0) over (partition by variant) as n_up from d""")
def variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28, A36."""
    c = link_cells(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("0.90"), F.lit("0.93"), F.lit("0.96"))))
    c = c.withColumns({"a": F.col("p") >= F.col("variant").cast("double"), "t": F.coalesce(F.col("v") > 25, F.lit(False))})
    iou = score.set_iou(c, ["variant", "panel", "slot"], "a", "t")
    return rounded(evals.evaluation_table(iou, "variant", ["panel"], "iou", "0.90"), "mean", "delta", "mean_delta")


@query(f"""
with {SETS}
, clim as (select panel, link, avg(truth::int) as rate from sets group by 1, 2)
, r as (select panel, slot, coalesce(avg(case when pred then rate end), 0.0) as recurrence, count(*) filter (where pred) as n_pred from sets join clim using (panel, link) group by 1, 2)
select panel, cut, count(*) filter (where recurrence < cut) as n, round(avg(case when recurrence < cut then n_pred end), 8) as mean from r cross join (select unnest([0.2, 0.35, 0.5])::double as cut) group by 1, 2""")
def recurrence_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29, A30."""
    s = _sets(spark, sf_dir)
    clim = s.groupBy("panel", "link").agg(F.avg(F.col("truth").cast("double")).alias("rate"))
    j = s.join(clim, ["panel", "link"])
    r = evals.recurrence(j, ["panel", "slot"], "pred", "rate").join(s.groupBy("panel", "slot").agg(F.count_if("pred").alias("n_pred")), ["panel", "slot"])
    return rounded(evals.slices_below(r, ["panel"], "recurrence", "n_pred", [0.2, 0.35, 0.5]), "mean")


@query(f"""with {SETS} select panel, slot, link, round(case when slot % 3 = 0 then 0.6 * p + 0.4 * least(coalesce(v, 0) / 100, 1) else p end, 8) as blend from sets""")
def gated_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12."""
    s = _sets(spark, sf_dir).withColumn("q", F.least(F.coalesce("v", F.lit(0.0)) / 100, F.lit(1.0)))
    return rounded(evals.gated_blend(s, "p", "q", F.col("slot") % 3 == 0, 0.4).select("panel", "slot", "link", "blend"), "blend")


@query(f"""
with {SETS}
, w as (select panel, slot // 6 as win, slot % 6 as step, count(*) filter (where pred) as p, count(*) filter (where truth) as t, count(*) filter (where pred and truth) as h from sets group by all)
select panel, step, round(avg(p), 8) as predicted, round(avg(t), 8) as true, round(avg(h), 8) as hit, count(*) as n, grouping(panel) * 2 + grouping(step) as level from w group by cube (panel, step)""")
def growth_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By panel and step, and over each and all of them."""
    s = _sets(spark, sf_dir).withColumns({"win": F.floor(F.col("slot") / 6), "step": F.col("slot") % 6})
    return rounded(evals.growth(s, ["win"], "panel", "step", "pred", "truth"), "predicted", "true", "hit")


@query(f"""
with {SETS}
, pb as (select panel, slot, min(link) as a, max(link) as b from (select *, link - row_number() over (partition by panel, slot order by link) as g from sets where pred) group by panel, slot, g)
, tb as (select panel, slot, min(link) as c, max(link) as d from (select *, link - row_number() over (partition by panel, slot order by link) as g from sets where truth) group by panel, slot, g)
, m as (select *, least(b, d) - greatest(a, c) + 1 as o from pb join tb using (panel, slot) where a <= d and c <= b)
, best as (select panel, slot, first(a order by o desc, a, c) as a, first(b order by o desc, a, c) as b, first(c order by o desc, a, c) as c, first(d order by o desc, a, c) as d from m group by 1, 2)
select s.panel, s.slot, any_value(a) is not null as site_right, any_value(b) - any_value(d) as head_off, any_value(a) - any_value(c) as tail_off
, count(*) filter (where pred and not truth and link between least(a, c) and greatest(b, d)) as wrong_in, count(*) filter (where truth and not pred and link between least(a, c) and greatest(b, d)) as missed_in
, count(*) filter (where pred and not truth and (a is null or not link between least(a, c) and greatest(b, d))) as wrong_out, count(*) filter (where truth and not pred and (a is null or not link between least(a, c) and greatest(b, d))) as missed_out
from sets s left join best using (panel, slot) group by 1, 2""")
def block_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34."""
    return evals.diagnose(_sets(spark, sf_dir), ["panel", "slot"], "link", "pred", "truth")


@query(f"""
with {ARMS_SQL}
, j as (select a.doc_id, a.target, a.p as base, c.p as arm, c.p is not null as eligible from arms a left join arms c on c.doc_id = a.doc_id and c.target = a.target and c.arm = 'c' where a.arm = 'a')
, r as (select *, (rank() over (partition by target order by base) + (count(*) over (partition by target, base) - 1) / 2.0) / count(*) over (partition by target) as rb
, (rank() over (partition by target, eligible order by arm nulls first) + (count(*) over (partition by target, eligible, arm) - 1) / 2.0) / count(*) over (partition by target, eligible) as ra from j)
select doc_id, target, eligible, round(case when eligible then 0.6 * rb + 0.4 * ra else rb end, 8) as blend from r""")
def blend_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M04."""
    a = arms(spark, sf_dir)
    j = a.filter("arm = 'a'").select("doc_id", "target", F.col("p").alias("base")).join(a.filter("arm = 'c'").select("doc_id", "target", F.col("p").alias("x")), ["doc_id", "target"], "left").withColumn("eligible", F.col("x").isNotNull())
    return rounded(evals.blend_available(j, ["target"], "base", "x", "eligible", 0.4).select("doc_id", "target", "eligible", "blend"), "blend")


@query(f"""
with {LINK_CELLS}, e as (select panel, v, (slot + link) % 9 <> 0 as eligible from links)
select panel, count(*) filter (where not eligible and v is not null) as absent_filled, count(*) filter (where eligible and v is null) as acquired_missing from e group by 1""")
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V06."""
    return evals.applicability(link_cells(spark, sf_dir).withColumn("eligible", (F.col("slot") + F.col("link")) % 9 != 0), ["panel"], "v", "eligible")


@query("""
with a as (select l_suppkey, l_returnflag, sum(l_quantity) as q from lineitem group by 1, 2), b as (select l_suppkey, l_returnflag, sum(l_quantity * (1 - l_discount)) + sum(l_quantity * l_discount) as q from lineitem group by 1, 2)
select count(*) as n, round(max(abs(a.q - b.q)), 4) as largest, max(abs(a.q - b.q)) <= 1e-6 as ok from a join b using (l_suppkey, l_returnflag)""")
def parity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total against the sum of its parts."""
    l, keys = read(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"]
    q, d = F.col("l_quantity"), F.col("l_discount")
    return evals.parity(l.groupBy(*keys).agg(F.sum("l_quantity").alias("q")), l.groupBy(*keys).agg((F.sum(q * (1 - d)) + F.sum(q * d)).alias("q")), keys, "q")


@query("""
with n as (select l_suppkey, count(*) as n from lineitem group by 1)
, p as (select l_suppkey, n, unnest(case when n <= 8 then range(n) else list_transform(range(8), lambda i: round_even(i * (n - 1) / 7.0, 0)::bigint) end) as pick from n)
select l_suppkey, n, pick, pick < greatest(n // 5, 1) as tiled, n >= 5 and pick <= n - 5 as starts_window from p""")
def even_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks spread over each supplier's rows, and whether they are a number of a tile or the start of an overlapping window of five."""
    n = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    out = n.select("l_suppkey", "n", F.explode(evals.even_picks(F.col("n"), 8)).alias("pick"), evals.window_starts(F.col("n"), 5, False).alias("t"), evals.window_starts(F.col("n"), 5, True).alias("o"))
    return out.select("l_suppkey", "n", "pick", F.array_contains("t", F.col("pick") * 5).alias("tiled"), ((F.col("n") >= 5) & F.array_contains("o", F.col("pick"))).alias("starts_window"))


@query()
def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 picks of each supplier dealt to its line numbers, capped by the rows there."""
    c = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("share"))
    return evals.quotas(c, "l_suppkey", "l_linenumber", "rows", "share", 40)


@query("""
with p as (select p_brand, p_partkey, p_name || '_' || p_partkey as name, case when p_brand in ('Brand#1', 'Brand#2') then null else p_retailprice end as pos, case when p_brand = 'Brand#1' then p_size else p_partkey end as num from part)
, u as (select p_brand, count(pos) = count(*) and count(distinct pos) = count(*) as a, count(num) = count(*) and count(distinct num) = count(*) as b from p group by 1)
, k as (select p.*, case when a then 'position' when b then 'number' else 'name' end as how from p join u using (p_brand))
, o as (select *, row_number() over (partition by p_brand order by case how when 'position' then pos when 'number' then num::double end, lpad(p_partkey::varchar, 12, '0')) as place from k)
, d as (select *, case when how = 'position' then pos - lag(pos) over (partition by p_brand order by place) end as d from o)
select p_partkey, p_brand, how, place, round(median(d) over (partition by p_brand), 6) as spacing from d""")
def order_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K22, F06."""
    p = read(spark, sf_dir, "part").withColumns({"pos": F.when(~F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_retailprice")), "num": F.when(F.col("p_brand") == "Brand#1", F.col("p_size")).otherwise(F.col("p_partkey"))})
    out = evals.order_with_fallback(p, "p_brand", "pos", "num", C.natural_key(F.concat(F.lit("p"), F.col("p_partkey"))))
    return rounded(out.select("p_partkey", "p_brand", "how", "place", "spacing"), "spacing", digits=6)


@query("""
select p_partkey, case when regexp_matches(t, '^(large|medium)') then 'wide' when regexp_matches(t, 'bolt|gear') then 'metal' else 'other' end as family, list_contains(string_split(o, '|'), 'FS') as option
, regexp_replace(p_name || '_' || p_brand, '_[^_]*$', '') as stem from (select *, regexp_replace(lower(p_name || '-' || p_brand), '[_\\-./#]+', ' ', 'g') as t, case when p_size % 3 = 0 then 'A|FS' when p_size % 3 = 1 then 'FS2|B' else 'FS' end as o from part)""")
def name_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20, F06."""
    o = F.when(F.col("p_size") % 3 == 0, "A|FS").when(F.col("p_size") % 3 == 1, "FS2|B").otherwise("FS")
    cols = evals.classify_names(F.concat("p_name", F.lit("-"), "p_brand"), {"wide": "^(large|medium)", "metal": "bolt|gear"}, o)
    return read(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in cols.items()], C.stem(F.concat("p_name", F.lit("_"), "p_brand")).alias("stem"))


@query(f"""
with {LINK_CELLS}
, d as (select panel, slot, link, case when v is not null then v > 40 end as obs, p >= 0.9 or (slot + link) % 2 = 0 as guess from links)
select d.panel, d.slot, d.link, coalesce(obs, guess and exists (select 1 from d n where n.obs and n.panel = d.panel and abs(n.slot - d.slot) <= 1 and abs(n.link - d.link) <= 2)) as label from d""")
def hybrid_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule near observed positives."""
    d = link_cells(spark, sf_dir).withColumns({"obs": F.col("v") > 40, "guess": (F.col("p") >= 0.9) | ((F.col("slot") + F.col("link")) % 2 == 0)})
    return evals.hybrid_truth(d, ["panel"], "slot", "link", "obs", "guess").select("panel", "slot", "link", "label")


CELLS_SQL = """cells as (select l_suppkey as image, l_linenumber as x, (l_quantity::bigint // 5) as y, l_partkey % 4 as inst, l_orderkey % 3 as record, max(l_discount) * 10 as p from lineitem group by all)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("x"), F.floor(F.col("l_quantity") / 5).alias("y"), (F.col("l_partkey") % 4).alias("inst"), (F.col("l_orderkey") % 3).alias("record")).agg((F.max("l_discount") * 10).alias("p"))


@query(f"""with {CELLS_SQL.replace("cells as (", "all_cells as (")}
, cells as (select * replace (image * 3 + record as image) from all_cells)
, f as (select image, inst, count(*) as area, avg(p) as mean_p, max(p) as max_p, quantile_cont(p, 0.5) as p50, quantile_cont(p, 0.9) as p90, avg((p > 0.7)::int) as share_high, count(*)::double / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) as fill, avg(x) as cx, avg(y) as cy, (var_samp(x) + var_samp(y)) / 2 as mid, sqrt(pow((var_samp(x) - var_samp(y)) / 2, 2) + pow(covar_samp(x, y), 2)) as half from cells group by 1, 2)
, d as (select a.image, a.inst, min(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) as nearest, count(*) filter (where sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) < 0.5) as neighbours from f a join f b on a.image = b.image and a.inst <> b.inst group by 1, 2)
select image, inst, area, round(mean_p, 6) as mean_p, round(max_p, 6) as max_p, round(p50, 6) as p50, round(p90, 6) as p90, round(share_high, 6) as share_high, round(fill, 6) as fill, round(case when area >= 5 then sqrt(greatest(mid + half, 1e-3) / greatest(mid - half, 1e-3)) else 1 end, 5) as elongation, round(nearest, 6) as nearest, coalesce(neighbours, 0) as neighbours from f left join d using (image, inst)""")
def component_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of an image for itself."""
    out = masks.component_features(_cells(spark, sf_dir).withColumn("image", F.col("image") * 3 + F.col("record")), ["image"], "x", "y", "p", 0.5)
    return rounded(rounded(out.drop("cx", "cy"), "elongation", digits=5), "mean_p", "max_p", "p50", "p90", "share_high", "fill", "nearest", digits=6)


@query(f"""with {CELLS_SQL}
, v as (select image, x, y, count(distinct record) as v from cells group by 1, 2, 3), n as (select image, count(distinct record) as n from cells group by 1)
, o as (select image, x, y, first(inst order by p desc, inst) as inst from cells group by 1, 2, 3)
select image, x, y, round(v / n, 8) as vote, inst as owner from v join n using (image) join o using (image, x, y)""")
def cell_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote share of each cell and the instance that owns it."""
    c = _cells(spark, sf_dir)
    n = c.groupBy("image").agg(F.count_distinct("record").alias("n"))
    own = c.groupBy("image", "x", "y").agg(F.min_by("inst", F.struct((-F.col("p")).alias("p"), "inst")).alias("owner"))
    return rounded(masks.vote_shares(c, ["x", "y"], "record", n).join(own, ["image", "x", "y"]), "vote")


@query(f"""with {CELLS_SQL}
, o as (select image, x, y, first(inst order by p desc, inst) as inst from cells group by 1, 2, 3)
select image, inst, count(*) as cells from o group by 1, 2 having count(*) >= 8""")
def owner_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to their most confident instance, instances with few cells left go."""
    c = _cells(spark, sf_dir).groupBy("image", "x", "y", "inst").agg(F.max("p").alias("p"))
    return masks.owner_cells(c, ["image", "x", "y"], "p", 8)


@query("""
select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0.0 else case when o_custkey % 97 = 0 then 1.5 else o_totalprice end end as value, 'sheet' as source from orders
union all select o_orderkey + 10000000, 1.0, 'extra' from orders where o_custkey % 97 = 0""")
def sheet_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's values zeroed, keys pinned, sources put together."""
    o = read(spark, sf_dir, "orders")
    pins = o.filter("o_custkey % 97 = 0").select("o_orderkey", F.lit(1.5).alias("value"))
    sheet = contract.pin(o.select("o_orderkey", F.col("o_totalprice").alias("value"), "o_orderpriority"), pins, ["o_orderkey"], "value")
    zeroed = sheet.withColumn("value", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 0.0).otherwise(F.col("value"))).select("o_orderkey", "value", F.lit("sheet").alias("source"))
    return zeroed.unionByName(pins.select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit(1.0).alias("value"), F.lit("extra").alias("source")))


@query("""select doc_id, source from documents where ('0x' || substr(md5(doc_id::varchar || 'x'), 1, 7))::bigint < 80530636""")
def hash_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator, three tenths of the rows by hash."""
    return windows.hash_sample(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 0.3, "x")


@query("""
with r as (select case when event_id % 11 = 0 then '{"k": 1, "value": 2}' when event_id % 13 = 0 then '{"value": 2, "k": 1}' when event_id % 17 = 0 then 'none' else props end as record from events)
, c as (select case when json_valid(record) then array_to_string(json_keys(record), ',') else '' end as columns from r)
select columns, count(*) as n, columns = 'k' as ok from c group by 1""")
def column_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of every record of a sheet, in their order."""
    i = F.col("event_id")
    record = F.when(i % 11 == 0, '{"k": 1, "value": 2}').when(i % 13 == 0, '{"value": 2, "k": 1}').when(i % 17 == 0, "none").otherwise(F.col("props"))
    return contract.check_records(read(spark, sf_dir, "events").select(record.alias("record")), "record", ["k"])


@query("""
with s as (select l_suppkey, regr_slope(l_extendedprice, l_quantity) as m, regr_intercept(l_extendedprice, l_quantity) as c from lineitem group by 1)
, p as (select a.l_suppkey, a.m, a.c, b.m as m2, b.c as c2 from s a join s b on b.l_suppkey = a.l_suppkey + 1)
select l_suppkey, round(case when abs(m - m2) > 1e-12 then (c2 - c) / (m - m2) end, 3) as x, round(abs(m * 10 - 2000 + c) / sqrt(m * m + 1), 6) as distance from p where abs(m - m2) > 1""")
def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    s = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("m"), F.regr_intercept("l_extendedprice", "l_quantity").alias("c"))
    p = s.join(s.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("m").alias("m2"), F.col("c").alias("c2")), "l_suppkey").filter("abs(m - m2) > 1")
    return p.select("l_suppkey", F.round(C.line_meet(F.col("m"), F.col("c"), F.col("m2"), F.col("c2"))[0], 3).alias("x"), F.round(C.point_line_distance(F.lit(10.0), F.lit(2000.0), F.col("m"), F.col("c")), 6).alias("distance"))


@query(f"""
with {LINK_CELLS}
select panel, slot, link, round(p - lag(p) over w, 8) as d_step, round(p - first_value(p) over w, 8) as d_origin from links window w as (partition by panel, link, slot // 6 order by slot)""")
def step_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments within windows of six steps; the other features are dropped as a group."""
    c = link_cells(spark, sf_dir).withColumn("win", F.floor(F.col("slot") / 6))
    out = evals.without_groups(space.step_increments(c, ["panel", "link", "win"], "slot", "p"), {"raw": ["v", "p"], "keys": ["win"]}, ["raw", "keys"])
    return rounded(out, "d_step", "d_origin")


@query("""
with t as (select l_returnflag as variant, sum(l_quantity) as q from lineitem group by 1), a as (select sum(q) as total from t)
select variant, round((total - (total - q)) / (case variant when 'A' then 0.5 when 'N' then 0.3 else 0.2 end), 6) as task_score from t, a""")
def decomposed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals without each flag against the full total."""
    q = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant")).agg(F.sum("l_quantity").alias("q"))
    whole = q.agg(F.sum("q").alias("all"))  # one row
    totals = q.crossJoin(whole).select("variant", (F.col("all") - F.col("q")).alias("total")).unionByName(whole.select(F.lit("full").alias("variant"), F.col("all").alias("total")))
    weights = spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "variant string, w double")
    return rounded(evals.decompose_totals(totals, "full", weights), "task_score", digits=6)


@query()
def learned_mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks scored out of fold by their shape, folds by image; panoptic quality at each threshold."""
    from panelworks.plans.keyed import _masks

    truth, pred, scores = _masks(spark, sf_dir)
    shape = pred.groupBy("image", "inst").agg(F.sum(F.col("x1") - F.col("x0")).cast("double").alias("area"), F.count(F.lit(1)).cast("double").alias("rows"), (F.max("x1") - F.min("x0")).cast("double").alias("width"))
    good = masks.match_targets(pred, truth).select("image", "inst", (F.col("hit_share") > 0).cast("int").alias("y"))
    rows = shape.join(good, ["image", "inst"]).withColumn("fold", F.col("image") % 3)
    kept = learn.out_of_fold(rows, ["area", "rows", "width"], "y", "fold", 3, trees=3).select("image", "inst", F.col("p").alias("score"))
    out = masks.threshold_grid(pred, truth, kept, [0.0, 0.25, 0.5, 0.75])
    return out.withColumns({"s": F.round("s", 6), "pq": F.round("pq", 8)})


@query(f"""
with runs as (select l_suppkey as image, l_linenumber as row, l_orderkey % 6 as inst, l_partkey % 3 as record, min(date_diff('day', timestamp '1995-01-01', l_shipdate))::bigint as x0, max(l_quantity)::bigint as n from lineitem group by 1, 2, 3, 4)
, truth as (select image, row, inst, record, x0, x0 + n * 20 as x1 from runs), pred as (select image, row, inst, x0 + inst * 30 as x0, x0 + n * 20 as x1 from runs where record = 0 and inst * 30 < n * 20 and image % 7 <> 0)
, ap as (select image, inst, sum(x1 - x0) as area from pred group by 1, 2), tru as (select image, record, inst, sum(x1 - x0) as area from truth group by 1, 2, 3)
, ov as (select p.image, p.inst as a, t.record, t.inst as b, sum(least(p.x1, t.x1) - greatest(p.x0, t.x0)) as inter from pred p join truth t on p.image = t.image and p.row = t.row and least(p.x1, t.x1) > greatest(p.x0, t.x0) group by all)
, iou as (select ov.image, a, ov.record, inter::double / (ap.area + tru.area - inter) as iou from ov join ap on ap.image = ov.image and ap.inst = a join tru on tru.image = ov.image and tru.record = ov.record and tru.inst = b)
, best as (select image, a, record, max(iou) as m from iou group by 1, 2, 3 having max(iou) > 0.5), n as (select image, count(distinct record) as n from truth group by 1)
select ap.image, ap.inst, round(coalesce(count(m) / any_value(n)::double, 0), 8) as hit_share, round(coalesce(avg(m), 0), 8) as mean_iou from ap join n using (image) left join best on best.image = ap.image and best.a = ap.inst group by 1, 2""")
def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against three records of each image."""
    day = F.timestamp_diff("DAY", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), F.col("l_shipdate"))
    runs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("row"), (F.col("l_orderkey") % 6).alias("inst"), (F.col("l_partkey") % 3).alias("record")).agg(F.min(day).alias("x0"), F.max("l_quantity").cast("long").alias("n"))
    truth = runs.select("image", "row", "inst", "record", "x0", (F.col("x0") + F.col("n") * 20).alias("x1"))
    pred = runs.filter("record = 0 and inst * 30 < n * 20 and image % 7 <> 0").select("image", "row", "inst", (F.col("x0") + F.col("inst") * 30).alias("x0"), (F.col("x0") + F.col("n") * 20).alias("x1"))
    return rounded(masks.match_targets(pred, truth), "hit_share", "mean_iou")
