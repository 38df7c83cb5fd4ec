"""Queries that audit other tables: screenlines, two-way fits, rank correlations, decoded rows, pairs of files, imputed states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.operators import balance, fits, learn, setscores
from panelworks.plans.base import LINK_CELLS, link_cells, query, read, rounded
from panelworks.plans.flows import FLOWS_SQL, _flows
from panelworks.sources import files

#: Links over the paths of each priority: all that cross a segment (100 + k), those but every seventh (200 + k), those that
#: start there (300 + k), and those that cross or end there (400 + k).
INCIDENCE_SQL = f"""{FLOWS_SQL}, own as (select distinct panel, path, path // 100 as o, path % 100 as d from flows)
, hit as (select panel, path, o, d, k from own, range(0, 25) t(k) where k >= o and k <= d)
, inc as (select panel, path, 100 + k as link from hit where k < d union all select panel, path, 200 + k from hit where k < d and path % 7 <> 0
  union all select panel, path, 300 + k from hit where k = o union all select panel, path, 400 + k from hit)"""


@query(f"""with {INCIDENCE_SQL}
, l as (select panel, link, list(path order by path) as used, max(path // 100) as k from inc group by 1, 2)
, c as (select panel, k, list(path order by path) as crossing from hit where k < d group by 1, 2)
select panel, link, len(used) as n_paths, case when used = crossing then k end as segment from l left join c using (panel, k)""")
def screenline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which links stand for a segment; SQL compares the sorted lists of paths."""
    flows, _ = _flows(spark, sf_dir)
    paths = flows.select("panel", "path").distinct().select("panel", "path", F.floor(F.col("path") / 100).alias("o"), (F.col("path") % 100).alias("d"))
    hit = paths.withColumn("k", F.explode(F.sequence("o", "d")))
    kinds = [(100, F.col("k") < F.col("d")), (200, (F.col("k") < F.col("d")) & (F.col("path") % 7 != 0)), (300, F.col("k") == F.col("o")), (400, F.lit(True))]
    links = F.filter(F.array(*[F.when(when, F.lit(base) + F.col("k")) for base, when in kinds]), lambda x: x.isNotNull())
    return balance.screenlines(hit.select("panel", "path", F.explode(links).alias("link")), paths, ["panel"])


SPLITS_SQL = """split as (select o_orderpriority as panel, least(c_nationkey, o_orderkey % 25) as o, greatest(c_nationkey, o_orderkey % 25) as d, 's' || (o_custkey % 3) as split, sum(o_totalprice) / 1e5 as f
  from orders join customer on o_custkey = c_custkey where c_nationkey <> o_orderkey % 25 group by all)
, rows as (select panel, o, d, split, ln(f) as y, ln(d - o) as x from split)
, whole as (select * from rows union all select panel, o, d, 'mean', avg(y), any_value(x) from rows group by 1, 2, 3 having count(*) = 3)"""


@query(f"""with recursive {SPLITS_SQL}
, turn as (select 0 as k, panel, split, o, d, x::double as x, y::double as y from whole
  union all
  select k + 1, panel, split, o, d, x - avg(x) over (partition by panel, split, d), y - avg(y) over (partition by panel, split, d)
  from (select k, panel, split, o, d, x - avg(x) over (partition by panel, split, o) as x, y - avg(y) over (partition by panel, split, o) as y from turn where k < 150))
, fit as (select panel, split, count(*) as n, case when sum(x * x) > 1e-9 then sum(x * y) / sum(x * x) end as slope
  , sqrt(greatest(sum(y * y) - coalesce(case when sum(x * x) > 1e-9 then sum(x * y) * sum(x * y) / sum(x * x) end, 0), 0) / count(*)) as sd from turn where k = 150 group by 1, 2)
select panel, split, n, round(slope, 5) as slope, round(sd, 5) as residual_sd
, round(sqrt(greatest(avg(case when split <> 'mean' then sd end) over (partition by panel) ** 2 - max(case when split = 'mean' then sd end) over (partition by panel) ** 2, 0) * 1.5), 5) as noise from fit""")
def log_linear_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ln of flow by origin, destination and ln of distance, for three splits and their mean; what the splits' noise would be."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    a, b = F.col("c_nationkey").cast("long"), F.col("o_orderkey") % 25
    split = o.filter(a != b).groupBy(F.col("o_orderpriority").alias("panel"), F.least(a, b).alias("o"), F.greatest(a, b).alias("d"), F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("split")).agg((F.sum("o_totalprice") / 1e5).alias("f"))
    rows = split.select("panel", "o", "d", "split", F.log("f").alias("y"), F.log(F.col("d") - F.col("o")).alias("x"))
    mean = rows.groupBy("panel", "o", "d").agg(F.lit("mean").alias("split"), F.avg("y").alias("y"), F.first("x").alias("x"), F.count(F.lit(1)).alias("_n")).filter("_n = 3").drop("_n")
    fit = fits.two_way_fit(rows.unionByName(mean), ["panel", "split"], "o", "d", "x", "y")
    p = Window.partitionBy("panel")
    own, whole = F.avg(F.when(F.col("split") != "mean", F.col("residual_sd"))).over(p), F.max(F.when(F.col("split") == "mean", F.col("residual_sd"))).over(p)
    return rounded(fit.withColumn("noise", F.sqrt(F.greatest(own * own - whole * whole, F.lit(0.0)) * 1.5)), "slope", "residual_sd", "noise", digits=5)


_RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""
with r as (select {", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in _RANKED)} from lineitem)
{" union all ".join(f"select '{a}' as one, '{b}' as other, count(*) as n, round(corr({a}, {b}), 7) as rho from r" for i, a in enumerate(_RANKED) for b in _RANKED[i + 1 :])}""")
def rank_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A42."""
    lines = read(spark, sf_dir, "lineitem").withColumn("_row", F.monotonically_increasing_id())
    return rounded(fits.rank_correlations(lines, ["_row"], _RANKED), "rho", digits=7)


_DECODERS = {"expected": ("expected", 1.0, None), "sharp": ("expected", 2.0, 4), "cut": ("cut", 0.95), "top": ("top", 3)}
_RANKING = "partition by panel, slot order by p desc, link rows between unbounded preceding and current row"


@query(f"""
with {LINK_CELLS}
, t as (select *, coalesce(v > 40, false) as seen, coalesce(v > 60, false) as strict, coalesce(lag(v) over (partition by panel, link order by slot) > 40, false) as before from links)
, r as (select *, row_number() over (partition by panel, slot order by p desc, link) as rn, sum(p) over ({_RANKING}) as c, sum(p) over (partition by panel, slot) as s
, sum(p * p) over ({_RANKING}) as c2, sum(p * p) over (partition by panel, slot) as s2 from t where link <> 7)
, e as (select *, round(c / (rn + s - c), 9) as e, round(c2 / (rn + s2 - c2), 9) as e2 from r)
, d as (select panel, slot, 'expected' as decoder, arg_max(rn, e * 1000 - rn * 1e-9) as m from e group by 1, 2 union all select panel, slot, 'sharp', arg_max(rn, e2 * 1000 - rn * 1e-9) from e where rn <= 4 group by 1, 2
  union all select panel, slot, 'cut', greatest(count(*) filter (where p >= 0.95), 1) from e group by 1, 2 union all select panel, slot, 'top', least(count(*), 3) from e group by 1, 2)
, truth as (select panel, slot, link, unnest(['seen', 'strict', 'before']) as truth, unnest([seen, strict, before]) as y from t)
, w as (select truth.panel, truth.slot, decoder, truth, any_value(m) as size, max(case when rn = m then e end) as surrogate, count(*) filter (where y) as n_true, count(*) filter (where y and coalesce(rn <= m, false)) as h
  from truth join d using (panel, slot) left join e using (panel, slot, link) group by all)
select slot % 4 as condition, decoder, truth, count(*) as n, round(avg(case when size + n_true = 0 then 1 else h / (size + n_true - h) end), 8) as iou, round(avg(size), 8) as size, round(avg(surrogate), 8) as surrogate from w group by 1, 2, 3""")
def decoded_rows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder by truth by condition; link 7 has no prediction rows, but truths."""
    links = link_cells(spark, sf_dir)
    before = F.lag("v").over(Window.partitionBy("panel", "link").orderBy("slot"))
    held = F.array(*[F.when(when, F.lit(name)) for name, when in (("seen", F.col("v") > 40), ("strict", F.col("v") > 60), ("before", F.col("_b") > 40))])
    truths = links.withColumn("_b", before).select("panel", "slot", "link", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("truth"))
    told = setscores.score_rows(links.filter("link <> 7"), truths, ["panel", "slot"], ["link"], "p", _DECODERS, ["seen", "strict", "before"])
    out = told.groupBy((F.col("slot") % 4).alias("condition"), "decoder", "truth").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("iou", "size", "surrogate")])
    return rounded(out, "iou", "size", "surrogate")


#: Tasks that write one folder's files.
FILE_TASKS = 96


@query("""
with f as (select s_suppkey::varchar as key, md5('image ' || s_nationkey % 5 || chr(10)) as left_hash, md5('mask ' || floor(s_acctbal / 3000)::bigint || chr(10)) as right_hash, s_suppkey % 7 as k from supplier)
select left_hash, right_hash, min(key) as key, count(*) as n from f where k <> 0 group by 1, 2""")
def binary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image and a mask file for each supplier, but masks of some are missing; read back as bytes."""
    suppliers = read(spark, sf_dir, "supplier")
    folder = files.scratch(spark, "binary-pairs")
    bodies = {"image": F.concat(F.lit("image "), F.col("s_nationkey") % 5), "mask": F.concat(F.lit("mask "), F.floor(F.col("s_acctbal") / 3000))}
    for name, body in bodies.items():
        rows = suppliers if name == "image" else suppliers.filter("s_suppkey % 7 <> 0")
        # a file costs milliseconds whatever it holds, so they are dealt to tasks by number, not by bytes
        dealt = rows.select(F.col("s_suppkey").alias("key"), body.alias("value")).repartition(FILE_TASKS, "key")
        dealt.write.partitionBy("key").text(f"{folder}/{name}")
    return files.read_binary_pairs(spark, f"{folder}/image", f"{folder}/mask", "key=([^/]+)/").select("left_hash", "right_hash", "key", "n")


def _imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of links by their ratio to 40, with the carried state as the guess, in two folds of alternate days."""
    links = link_cells(spark, sf_dir).withColumn("ratio", F.col("v") / 40)
    carried = F.last("ratio", ignorenulls=True).over(Window.partitionBy("panel", "link").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    told = links.withColumns({"guess": F.coalesce(carried <= 1, F.lit(False)), "fold": F.pmod(F.floor(F.col("slot") / 4), F.lit(2)).cast("int")}).drop("p")
    return learn.impute_states(told, ["panel"], "slot", "link", "ratio", "guess", "fold", 2, trees=5)


@query()
def imputed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every cell, learned where none was observed."""
    return _imputed(spark, sf_dir).select("panel", "slot", "link", F.col("ratio").isNull().alias("imputed"), "learned", "hybrid")


@query()
def imputer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed cells judged without their own value: accuracy, recall and specificity of the model and of the two means."""
    y = F.col("ratio") <= 1
    seen = _imputed(spark, sf_dir).filter("ratio is not null and by_time is not null and by_space is not null")
    said = F.array(*[F.struct(F.lit(n).alias("method"), c.alias("p")) for n, c in (("learned", F.coalesce(F.col("p") >= 0.5, F.lit(False))), ("time", F.col("by_time")), ("space", F.col("by_space")))])
    told = seen.select("panel", y.alias("y"), F.explode(said).alias("s")).select("panel", "y", "s.method", "s.p")
    hit = F.col("y") == F.col("p")
    return told.groupBy("panel", "method").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.try_divide(F.count_if(hit & F.col("y")), F.count_if("y")).alias("recall"), F.try_divide(F.count_if(hit & ~F.col("y")), F.count_if(~F.col("y"))).alias("specificity"))
