"""Queries on predictions, labels and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import blend, score
from panelworks.plans.base import HOURLY, LINK_CELLS, hourly, link_cells, query, read, rounded

#: (doc_id, arm, target, y, p): three arms of scores by rule against the two label columns; toxic is masked for every third document.
ARMS_SQL = """base as (select l.doc_id, quality, case when l.doc_id % 3 <> 0 then toxic end as toxic, n_chars from labels l join documents d using (doc_id))
, long as (select doc_id, 'quality' as target, quality as y, n_chars from base union all select doc_id, 'toxic', toxic, n_chars from base)
, arms as (
  select doc_id, target, y, 'a' as arm, round(1000.0 / (1000.0 + n_chars), 3) as p from long
  union all select doc_id, target, y, 'b', round((doc_id * 7 % 101) / 101.0, 6) from long
  union all select doc_id, target, y, 'c', round((n_chars % 97) / 97.0 * 0.5 + (doc_id % 89) / 178.0, 6) from long where doc_id % 10 <> 0)"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    long = base.withColumn("toxic", F.when(F.col("doc_id") % 3 != 0, F.col("toxic"))).select("doc_id", "n_chars", F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (target, y)"))
    d, n = F.col("doc_id"), F.col("n_chars")
    made = F.array(
        F.struct(F.lit("a").alias("arm"), F.round(1000.0 / (1000.0 + n), 3).alias("p")),
        F.struct(F.lit("b").alias("arm"), F.round((d * 7 % 101) / 101.0, 6).alias("p")),
        F.struct(F.lit("c").alias("arm"), F.round((n % 97) / 97.0 * 0.5 + (d % 89) / 178.0, 6).alias("p")),
    )
    out = long.withColumn("x", F.explode(made)).select("doc_id", "target", "y", "x.arm", "x.p")
    return out.filter("arm <> 'c' or doc_id % 10 <> 0")


AUC_SQL = """sum(case when y = 1 then r end) as sr, count(*) filter (where y = 1) as n_pos, count(*) filter (where y = 0) as n_neg"""


@query(f"""
with {ARMS_SQL}
, r as (select arm, target, y, rank() over (partition by arm, target order by p) + (count(*) over (partition by arm, target, p) - 1) / 2.0 as r from arms where y is not null)
, s as (select arm, target, {AUC_SQL} from r group by 1, 2)
select arm, target, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 8) as auc from s""")
def masked_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09."""
    return rounded(score.auc(arms(spark, sf_dir), ["arm", "target"], "y", "p"), "auc")


@query(f"""
with {ARMS_SQL}
, r as (select arm, target, y, rank() over (partition by arm, target order by p) + (count(*) over (partition by arm, target, p) - 1) / 2.0 as r from arms where y is not null)
, s as (select arm, target, {AUC_SQL} from r group by 1, 2)
select round(avg((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)), 8) as macro_strict, round(avg((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)), 8) as macro_lenient from s""")
def macro_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return rounded(score.macro(score.auc(arms(spark, sf_dir), ["arm", "target"], "y", "p"), "auc"), "macro_strict", "macro_lenient")


@query(f"""
with {ARMS_SQL}
, r as (select doc_id, arm, target, rank() over (partition by arm, target order by p) + (count(*) over (partition by arm, target, p) - 1) / 2.0 as r, count(*) over (partition by arm, target) as n
, row_number() over (partition by arm, target order by p, doc_id) as o from arms)
select doc_id, arm, target, round(r / n, 8) as rank_pct, round((r - 1) / (n - 1), 8) as rank_01, round((o - 1) / (n - 1), 8) as rank_ordinal from r""")
def score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W23, W24, W25."""
    out = blend.score_ranks(arms(spark, sf_dir), ["arm", "target"], "p", "doc_id").drop("y", "p")
    return rounded(out, "rank_pct", "rank_01", "rank_ordinal")


WEIGHTS = [("a", "quality", 0.5), ("b", "quality", 0.3), ("c", "quality", 0.2), ("a", "toxic", 0.2), ("b", "toxic", 0.2), ("c", "toxic", 0.6)]
WEIGHTS_SQL = "w(arm, target, w) as (values " + ", ".join(f"('{a}', '{t}', {w})" for a, t, w in WEIGHTS) + ")"


@query(f"""
with {ARMS_SQL}, {WEIGHTS_SQL}
, r as (select *, (rank() over (partition by arm, target order by p) + (count(*) over (partition by arm, target, p) - 1) / 2.0) / count(*) over (partition by arm, target) as rp from arms)
select doc_id, target, round(sum(w * p) / sum(w), 8) as prob_blend, round(sum(w * rp) / sum(w), 8) as rank_blend, count(*) as n from r join w using (arm, target) group by 1, 2""")
def arm_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted probability and rank averages over the arms that a document has."""
    weights = spark.createDataFrame(WEIGHTS, "arm string, target string, w double")
    ranked = blend.score_ranks(arms(spark, sf_dir), ["arm", "target"], "p", "doc_id")
    out = ranked.join(weights, ["arm", "target"]).groupBy("doc_id", "target").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("prob_blend"), (F.sum(F.col("w") * F.col("rank_pct")) / F.sum("w")).alias("rank_blend"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "prob_blend", "rank_blend")


@query(f"""
with {ARMS_SQL}, {WEIGHTS_SQL}
select doc_id, target, round(sum(w * p) / sum(w), 8) as blend, count(*) as n from arms join w using (arm, target) group by 1, 2 having count(*) = 3""")
def complete_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only keys that all components have."""
    weights = spark.createDataFrame(WEIGHTS, "arm string, target string, w double")
    return rounded(blend.weighted_mean(blend.aligned(arms(spark, sf_dir), "arm", "doc_id", 3), weights, ["doc_id", "target"], ["arm", "target"], "p", 3), "blend")


@query(f"""
with {ARMS_SQL}
, m as (select doc_id, target, any_value(y) as y, mask, round(avg(p), 9) as p, count(*) as members from arms cross join (select range::int as mask from range(1, 8))
  where (mask & case arm when 'a' then 1 when 'b' then 2 else 4 end) <> 0 group by doc_id, target, mask)
, full_only as (select * from m where members = bit_count(mask) and y is not null)
, r as (select mask, target, y, rank() over (partition by mask, target order by p) + (count(*) over (partition by mask, target, p) - 1) / 2.0 as r from full_only)
, s as (select mask, target, {AUC_SQL} from r group by 1, 2)
select mask, target, n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 8) as auc from s""")
def arm_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of the mean of every subset of arms, leave-one-out among them, over documents that have all of its arms."""
    m = blend.subset_means(arms(spark, sf_dir), ["a", "b", "c"], "arm", ["doc_id", "target", "y"], "p").filter(F.col("members") == F.bit_count("mask"))
    return rounded(score.auc(m.withColumn("mean", F.round("mean", 9)), ["mask", "target"], "y", "mean"), "auc")


@query(f"""
with {ARMS_SQL}
, j as (select a.doc_id, a.target, (a.doc_id % 4) as fold, a.y, a.p as pa, b.p as pb from arms a join arms b on a.doc_id = b.doc_id and a.target = b.target and a.arm = 'a' and b.arm = 'b' where a.y is not null)
, g as (select target, fold, k / 10.0 as w, -avg(pow(y - ((k / 10.0) * pa + (1 - k / 10.0) * pb), 2)) as s, count(*) as n from j cross join (select range::bigint as k from range(11)) group by target, fold, k)
, o as (select target, f.fold, w, round(sum(s * n) / sum(n), 9) as s from g join (select distinct fold from j) f on f.fold <> g.fold group by all)
select target, fold, w as weight, s as score from (select *, row_number() over (partition by target, fold order by s desc, w) as rn from o) where rn = 1""")
def nested_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend weight of each fold that is best on the other folds; sums by fold and weight are made once."""
    a = arms(spark, sf_dir).filter("y is not null")
    j = a.filter("arm = 'a'").select("doc_id", "target", "y", F.col("p").alias("pa")).join(a.filter("arm = 'b'").select("doc_id", "target", F.col("p").alias("pb")), ["doc_id", "target"])
    grid = j.withColumn("fold", F.col("doc_id") % 4).withColumn("w", F.explode(F.array(*[F.lit(k / 10.0) for k in range(11)])))
    e = F.col("y") - (F.col("w") * F.col("pa") + (1 - F.col("w")) * F.col("pb"))
    own = grid.groupBy("target", "fold", "w").agg(F.sum(e * e).alias("s"), F.count(F.lit(1)).alias("n"))
    folds = own.select(F.col("fold").alias("held")).distinct()
    others = own.join(folds, F.col("fold") != F.col("held")).groupBy("target", "held", "w").agg(F.round(-F.sum("s") / F.sum("n"), 9).alias("score"))
    best = others.groupBy("target", "held").agg(F.max_by(F.struct("w", "score"), F.struct("score", (-F.col("w")).alias("o"))).alias("b"))
    return best.select("target", F.col("held").alias("fold"), F.col("b.w").alias("weight"), F.col("b.score").alias("score"))


@query(f"""
with {LINK_CELLS}
, w as (select panel, case when slot % 8 < 3 then 'onset' else 'ongoing' end as condition, slot, case when count(*) filter (where p >= 0.93 or v > 25) = 0 then 1.0
  else count(*) filter (where p >= 0.93 and v > 25)::double / count(*) filter (where p >= 0.93 or v > 25) end as iou from links group by panel, slot)
, fam as (select *, substr(panel, 1, 1) || 'x' as family from w)
, l3 as (select family, panel, condition, avg(iou) as mean from fam group by all)
, l2 as (select family, panel, avg(mean) as mean from l3 group by all)
, l1 as (select family, avg(mean) as mean from l2 group by all)
select 3 as depth, family, panel, condition, round(mean, 8) as mean from l3 union all select 2, family, panel, null, round(mean, 8) from l2
union all select 1, family, null, null, round(mean, 8) from l1 union all select 0, null, null, null, round(avg(mean), 8) from l1""")
def hierarchical_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03, A18, A49."""
    cells = link_cells(spark, sf_dir).withColumns({"pred": F.col("p") >= 0.93, "true": F.coalesce(F.col("v") > 25, F.lit(False))})
    w = score.set_iou(cells, ["panel", "slot"], "pred", "true").withColumn("condition", F.when(F.col("slot") % 8 < 3, "onset").otherwise("ongoing")).withColumn("family", F.concat(F.substring("panel", 1, 1), F.lit("x")))
    return rounded(score.hierarchical_mean(w, ["family", "panel", "condition"], "iou"), "mean")


PRED = f"""{HOURLY}
, pred as (select panel, slot, value, avg(value) over (partition by panel order by slot rows between 3 preceding and 1 preceding) as guess, slot % 24 < 6 as dark, (slot // 24) % 3 + 1 as regime from hourly)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("panel").orderBy("slot").rowsBetween(-3, -1)
    return hourly(spark, sf_dir).withColumns({"guess": F.avg("value").over(w), "dark": F.col("slot") % 24 < 6, "regime": F.floor(F.col("slot") / 24) % 3 + 1})


@query(f"""
with {PRED}
, s as (select panel, regime, sqrt(avg(pow(guess - value, 2))) as rs, sqrt(avg(pow((guess - value) * 3, 2))) as rf from pred where value is not null and guess is not null group by 1, 2)
, c as (select panel, slot, regime, value, guess, lead(slot) over o as nx, lead(guess) over o - guess as ds, lead(value) over o - value as dt from pred where value is not null and guess is not null window o as (partition by panel order by slot))
, k as (select panel, regime, 1 - least(1.0, sum(abs(ds - dt)) / sum(abs(dt))) as conservation from c where nx = slot + 1 group by 1, 2)
select panel, regime, round(rs, 7) as rmse_speed, round(rf, 7) as rmse_flow, round(0.54 * greatest(0, 1 - rs / 25) + 0.46 * greatest(0, 1 - rf / 600), 8) as score, round(conservation, 8) as conservation from s join k using (panel, regime)""")
def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A04, A05."""
    both = _predicted(spark, sf_dir).filter("value is not null and guess is not null")
    s = score.state_score(both, ["panel", "regime"], F.col("guess") - F.col("value"), (F.col("guess") - F.col("value")) * 3)
    k = score.conservation_score(both, ["panel", "regime"], ["panel"], "slot", "guess", "value").withColumnRenamed("score", "conservation")
    out = s.join(k, ["panel", "regime"])
    return rounded(rounded(out, "score", "conservation"), "rmse_speed", "rmse_flow", digits=7)


@query(f"""
with {PRED}
, e as (select *, guess - value as err from pred where value is not null and guess is not null)
, b as (select panel, dark, case when value <= 10 then 'low' when value <= 40 then 'mid' else 'high' end as bin, count(*) as n, avg(err * err) as mse, sum(err * err) as sse from e group by all)
, m as (select panel, avg(err * err) filter (where not dark) as r, avg(err * err) filter (where dark) as d from e group by 1)
, sh as (select panel, case when panel < 'm' then 0.2 else 0.4 end as share from (select distinct panel from e))
select panel, dark, bin, n, round(mse, 6) as mse, round(sse / sum(sse) over (partition by panel), 8) as share, round((1 - sh.share) * r + sh.share * d, 6) as mixed from b join m using (panel) join sh using (panel)""")
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06, A07, A08, P10."""
    from panelworks.functions.columns import bin_of

    e = _predicted(spark, sf_dir).filter("value is not null and guess is not null").withColumn("err", F.col("guess") - F.col("value"))
    e = e.withColumn("bin", bin_of(F.col("value"), [float("-inf"), 10.0, 40.0, float("inf")], ["low", "mid", "high"]))
    shares = e.select("panel").distinct().withColumn("share", F.when(F.col("panel") < "m", 0.2).otherwise(0.4))
    mixed = score.mixed_rate_score(e, ["panel"], "err", "dark", shares).select("panel", F.round("mixed", 6).alias("mixed"))
    out = score.error_budget(e, ["panel"], ["dark", "bin"], "err").join(mixed, "panel")
    return out.withColumns({"mse": F.round("mse", 6), "share": F.round("share", 8)})


@query("""
with s as (select l_suppkey, l_extendedprice, sum(l_quantity) as w from lineitem group by 1, 2)
, c as (select l_suppkey, l_extendedprice, sum(w) over (partition by l_suppkey order by l_extendedprice rows between unbounded preceding and current row) as c, sum(w) over (partition by l_suppkey) as t from s)
select l_suppkey, min(l_extendedprice) as weighted_median from c where c >= t / 2 group by 1""")
def weighted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return score.weighted_median(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("""
with x as (select l_suppkey, l_orderkey, l_linenumber, l_discount - 0.05 as v, l_quantity as w from lineitem)
, m as (select *, sign(sum(round(sign(round(v, 4)) * w, 2)) over (partition by l_suppkey)) as maj from x)
, k as (select *, row_number() over (partition by l_suppkey order by w desc, l_orderkey, l_linenumber) as n from m where sign(round(v, 4)) = maj)
select l_suppkey, round(median(round(v, 4)), 8) as median, round(sum(round(v, 4) * w) / sum(w), 8) as weighted_mean, round(median(case when n <= 5 then round(v, 4) end), 8) as top_median from k group by 1""")
def sign_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    x = read(spark, sf_dir, "lineitem").select("l_suppkey", F.round(F.col("l_discount") - 0.05, 4).alias("v"), F.col("l_quantity").alias("w"), F.struct("l_orderkey", "l_linenumber").alias("id"))
    return rounded(score.sign_majority(x, ["l_suppkey"], "v", "w", 5, "id"), "median", "weighted_mean", "top_median")


@query("""
with r as (select l_orderkey * 10 + l_linenumber as id, rater, v from lineitem, lateral (values ('r1', l_quantity), ('r2', l_quantity * (1 + l_discount * 4)), ('r3', l_quantity * (1 + l_tax * 8))) t(rater, v))
, o as (select id, rater, min(v) as v from r group by 1, 2)
, k as (select * from (select *, median(v) over (partition by id) as m from o) where abs(v - m) <= 0.2 * abs(m))
select id, rater, round(v, 6) as v, count(*) over p as n_raters, round(avg(v) over p, 8) as consensus, round(stddev_pop(v) over p, 6) as spread, round(case when count(*) over p > 1 then v - (sum(v) over p - v) / (count(*) over p - 1) end, 8) + 0.0 as loo_error
from k window p as (partition by id)""")
def rater_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, P12."""
    l = read(spark, sf_dir, "lineitem")
    wide = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("r1"), (F.col("l_quantity") * (1 + F.col("l_discount") * 4)).alias("r2"), (F.col("l_quantity") * (1 + F.col("l_tax") * 8)).alias("r3"))
    long = wide.unpivot("id", ["r1", "r2", "r3"], "rater", "v").groupBy("id", "rater").agg(F.min("v").alias("v"))
    out = score.rater_consensus(long, "id", "rater", "v", off=0.2)
    return out.withColumns({"v": F.round("v", 6), "consensus": F.round("consensus", 8), "spread": F.round("spread", 6), "loo_error": F.round("loo_error", 8) + 0.0})  # no negative zeros


@query("""
with d as (select l_returnflag, l_quantity * (1 + l_discount) as e, l_quantity as r from lineitem)
, b as (select *, avg(e - r) over (partition by l_returnflag) as bias from d)
select l_returnflag, count(*) as n, round(avg(e), 7) as mean, round(avg(e - r), 7) as bias, round(avg(abs(e - r)), 7) as mad, round(avg(abs(e - r - bias)), 7) as mad_debiased, round(corr(e, r), 7) as corr from b group by 1""")
def estimator_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, A26."""
    d = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("e"), F.col("l_quantity").alias("r"))
    return rounded(score.diagnostics(d, ["l_returnflag"], "e", "r"), "mean", "bias", "mad", "mad_debiased", "corr", digits=7)


@query("""
with p0 as (select l_suppkey as k, l_quantity as x, l_extendedprice / 1000 as y from lineitem)
, f1 as (select *, abs(y - regr_slope(y, x) over w * x - regr_intercept(y, x) over w) as r from p0 window w as (partition by k))
, p1 as (select k, x, y from (select *, quantile_cont(r, 0.9) over (partition by k) as c, count(*) over (partition by k) as n from f1) where n < 10 or r <= c + 1e-9)
, f2 as (select *, abs(y - regr_slope(y, x) over w * x - regr_intercept(y, x) over w) as r from p1 window w as (partition by k))
, p2 as (select k, x, y from (select *, quantile_cont(r, 0.9) over (partition by k) as c, count(*) over (partition by k) as n from f2) where n < 10 or r <= c + 1e-9)
select k as l_suppkey, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as n from p2 group by 1""")
def robust_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A40."""
    p = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(score.robust_line(p, ["l_suppkey"], "x", "y"), "slope", "intercept", digits=6)


@query("""
with b as (select l_suppkey, floor((l_extendedprice % 180) / 5)::bigint as bin, sum(l_quantity) as w from lineitem group by 1, 2)
, s as (select *, round(sum(w) over (partition by l_suppkey order by bin range between 2 preceding and 2 following) / 5, 6) as s from b)
select l_suppkey, bin, ((bin + 0.5) * 5)::double as mode, s as mass from (select *, row_number() over (partition by l_suppkey order by s desc, bin) as rn from s) where rn = 1""")
def angle_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A41."""
    p = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") % 180).alias("a"), "l_quantity")
    return score.angle_mode(p, ["l_suppkey"], "a", "l_quantity", 5.0)


@query("""
with s as (select l_suppkey, l_quantity as x, l_linenumber::double as y, 1 + l_discount as w from lineitem)
, m as (select l_suppkey, sum(w) as w, sum(w * x) / sum(w) as cx, sum(w * y) / sum(w) as cy, sum(w * x * x) / sum(w) as xx, sum(w * y * y) / sum(w) as yy, sum(w * x * y) / sum(w) as xy from s group by 1)
, c as (select l_suppkey, cx, cy, xx - cx * cx as a, yy - cy * cy as b, xy - cx * cy as c from m)
, e as (select *, sqrt((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)) as major, sqrt(greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0)) as minor from c)
select l_suppkey, round(cx, 6) as cx, round(cy, 6) as cy, round(major, 6) as major, round(minor, 6) as minor, round(major / greatest(minor, 1e-6), 6) as elongation, round(degrees(0.5 * atan2(2 * c, a - b)), 5) as angle from e""")
def point_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A38."""
    s = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (1 + F.col("l_discount")).alias("w"))
    out = rounded(score.axes_of_points(s, ["l_suppkey"], "x", "y", "w"), "cx", "cy", "major", "minor", "elongation", digits=6)
    return rounded(out, "angle", digits=5)


@query("""
with s as (select l_suppkey, l_quantity as x, l_extendedprice / 1500 as y from lineitem)
select l_suppkey, round(sum(x * y) / sum(x * x), 7) as slope, round(sum(x * y) * sum(x * y) / (sum(x * x) * sum(y * y)), 7) as r2, round(stddev_pop(case when x > 0 and y > 0 then ln(y / x) end), 7) as log_spread from s group by 1""")
def origin_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A48, A42."""
    s = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1500).alias("y"))
    return rounded(score.through_origin(s, ["l_suppkey"], "x", "y"), "slope", "r2", "log_spread", digits=7)


@query("""
with g as (select l_returnflag, l_suppkey, 1.0 / count(*) over (partition by l_returnflag, l_suppkey) as w from lineitem)
select l_returnflag, l_suppkey, count(*) as n, 1.0::double as raw, round(sum(w / m), 6) as weight from (select *, avg(w) over (partition by l_returnflag) as m from g) group by 1, 2""")
def group_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    out = score.group_weights(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey"), ["l_suppkey"], ["l_returnflag"])
    return out.groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("raw"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""
with {LINK_CELLS}
, h as (select panel, link, slot, v from links where slot % 4 = 2)
select panel, link, round(avg(v), 8) as mean, round(median(v), 8) as median, count(v) as n, round(avg(case when p >= 0.9 then v end), 8) as mean_high from h join links using (panel, link, slot, v) group by 1, 2""")
def hour_window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20, F08."""
    h = link_cells(spark, sf_dir).filter("slot % 4 = 2 and v is not null")
    return rounded(h.groupBy("panel", "link").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.count("v").alias("n"), F.avg(F.when(F.col("p") >= 0.9, F.col("v"))).alias("mean_high")), "mean", "median", "mean_high")


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of one threshold over another, window by window."""
    cells = link_cells(spark, sf_dir).withColumns({"a": F.col("p") >= 0.93, "b": F.col("p") >= 0.9, "true": F.coalesce(F.col("v") > 25, F.lit(False))})
    one = score.set_iou(cells, ["panel", "slot"], "a", "true").withColumnRenamed("iou", "ia").join(score.set_iou(cells, ["panel", "slot"], "b", "true").withColumnRenamed("iou", "ib"), ["panel", "slot"])
    d = one.withColumn("delta", F.col("ia") - F.col("ib")).withColumn("key", F.concat_ws("/", "panel", "slot")).withColumn("condition", F.col("slot") % 8 < 3)
    return score.poisson_bootstrap(d, "key", ["panel", "condition"], "delta", 200)


@query("""
with d as (select vec_id, label, embedding::double[] as e, lag(embedding::double[]) over (partition by vec_id // 100 order by vec_id) as b from embeddings)
, c as (select *, round(list_dot_product(e, b) / sqrt(list_dot_product(e, e) * list_dot_product(b, b)), 6) as cosine from d)
select vec_id, cosine, sum(case when cosine >= 0.0 then 0 else 1 end) over (partition by vec_id // 100 order by vec_id)::bigint as session from c""")
def vector_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W26."""
    e = read(spark, sf_dir, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 100))
    return blend.sessions(e, "vec_id", "embedding", 0.0, ["block"]).select("vec_id", "cosine", "session")


@query("""
select l_orderkey, l_linenumber, l_suppkey, round(0.7 * l_extendedprice + 0.3 * median(l_extendedprice) over (partition by l_suppkey, l_returnflag), 6) as smoothed from lineitem""")
def median_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W27."""
    l = read(spark, sf_dir, "lineitem")
    return rounded(blend.median_smooth(l, ["l_suppkey", "l_returnflag"], "l_extendedprice", 0.3).select("l_orderkey", "l_linenumber", "l_suppkey", "smoothed"), "smoothed", digits=6)


_PCT = "(rank() over (partition by target order by {v}) + (count(*) over (partition by target, {v}) - 1) / 2.0) / count(*) over (partition by target)"


@query(f"""
with {ARMS_SQL}
, u as (select doc_id, target, sum(w * p) / sum(w) as v from arms join (values ('a', 0.7), ('b', 0.3)) w(arm, w) using (arm) group by 1, 2)
, pu as (select doc_id, target, {_PCT.format(v="v")} as r from u)
, pr as (select doc_id, target, {_PCT.format(v="p")} as r from arms where arm = 'c')
, ba as (select doc_id, target, {_PCT.format(v="p")} as r from arms where arm = 'b')
, m as (select pu.doc_id, pu.target, round((1 - w) * ba.r + w * (0.6 * pu.r + 0.4 * pr.r), 10) as v from pu join pr using (doc_id, target) join ba using (doc_id, target) join (values ('quality', 0.25), ('toxic', 0.75)) o(target, w) using (target))
select doc_id, target, round({_PCT.format(v="v")}, 8) as final from m""")
def staged_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views, a private arm and a base arm, blended by ranks in stages."""
    a = arms(spark, sf_dir)
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "arm string, w double")
    outer = spark.createDataFrame([("quality", 0.25), ("toxic", 0.75)], "target string, w double")
    views = a.filter("arm in ('a', 'b')")
    return rounded(blend.staged_hybrid(views, weights, a.filter("arm = 'c'"), a.filter("arm = 'b'"), outer, "doc_id", "target", "arm", "p", 0.4), "final")
