"""Queries on files, streams, learned models and smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelworks.operators import contract, learn, masks, runs, score, smooth
from panelworks.plans.base import HOURLY, LINK_CELLS, hourly, link_cells, query, read, rounded
from panelworks.sources import files
from panelworks.streaming import streams


@query("select event_id, event_type, round(value, 2) as value from events where event_type in ('click', 'view')")
def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by event type, read back with pruned partitions and columns."""
    path = files.scratch(spark, "by-type")
    files.write_partitions(read(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type"), path, "event_type")
    out = files.read_partitions(spark, path, "event_id long, user_id long, value double, event_type string", "event_type in ('click', 'view')", ["event_id", "event_type", "value"])
    return rounded(out, "value", digits=2)


@query("""
with f as (select p_partkey::varchar as id, (p_partkey % 3)::bigint as fold, p_size, round(p_retailprice, 4) as price from part union all select p_partkey::varchar, 9, p_size + 1, 0 from part where p_partkey % 10 = 0)
select id, 'fold=' || fold as file, p_size as size, price from (select *, row_number() over (partition by id order by fold) as rn from f) where rn = 1""")
def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-precision CSV in a folder for each fold, read by a glob with text ids, first row of an id kept."""
    p = read(spark, sf_dir, "part")
    path = files.scratch(spark, "folds")
    one = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    for k in range(3):
        files.write_fixed_csv(one.filter(F.col("id").cast("long") % 3 == k), f"{path}/fold={k}", {"size": "%.3f", "price": "%.4f"})
    again = one.filter(F.col("id").cast("long") % 10 == 0).withColumns({"size": F.col("size") + 1, "price": F.lit(0.0)})
    files.write_fixed_csv(again, f"{path}/fold=9", {"size": "%.3f", "price": "%.4f"})
    rows = files.read_text_csv(spark, f"{path}/fold=*", "id string, size double, price double")
    return contract.first_per_key(rows, ["id"], [F.col("file")]).select("id", "file", F.col("size").cast("int").alias("size"), "price")


@query("""
select doc_id, max(state) as state, 2 as arrival from (select doc_id, toxic as state from labels) group by 1""")
def last_json_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, the last arrival of an id wins."""
    l = read(spark, sf_dir, "labels")
    path = files.scratch(spark, "json")
    l.select("doc_id", F.col("quality").alias("state"), F.lit(1).alias("arrival")).unionByName(l.select("doc_id", F.col("toxic").alias("state"), F.lit(2).alias("arrival"))).write.json(path)
    return files.read_last_json(spark, path, "doc_id long, state int, arrival int", "doc_id", "arrival")


@query("""
select l_suppkey as image_id, 'image_' || l_suppkey as file_name, l_linenumber::bigint as "row", l_partkey as x0, l_partkey + l_quantity::bigint as x1 from lineitem where l_returnflag <> 'A'""")
def nested_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and annotations as nested JSON, one document a supplier, exploded and joined."""
    l = read(spark, sf_dir, "lineitem")
    a = F.struct(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("row"), F.col("l_partkey").alias("x0"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("x1"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("iscrowd"))
    path = files.scratch(spark, "nested")
    docs = l.groupBy("l_suppkey").agg(F.collect_list(a).alias("annotations"))
    docs.select(F.array(F.struct(F.col("l_suppkey").alias("id"), F.concat(F.lit("image_"), "l_suppkey").alias("file_name"))).alias("images"), "annotations").write.json(path)
    return files.read_annotations(spark, path)


WM = "(select max(date_trunc('milliseconds', ts)) - interval 10 minute as w from events)"


@query(f"""
with e as (select to_timestamp(floor(epoch(ts) / 300) * 300)::timestamp as s, event_type, value from events)
select epoch(s)::bigint as start, event_type, count(*) as n, round(avg(value), 8) as mean from e where s + interval 5 minute <= (select w from {WM}) group by 1, 2""")
def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equals the batch result for all windows that the watermark has passed."""
    out = streams.replay(streams.slot_sums(streams.readings(spark, f"{sf_dir}/events.parquet"), "event_type"), "slots")
    return rounded(out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", "mean"), "mean")


@query(f"""
with e as (select epoch(ts) as t, user_id % 10 as link, value from events), s as (select (floor(t / 300) - k) * 300 as s, link, value from e cross join (select range as k from range(12)))
select s::bigint as start, link, count(*) as n, round(avg(value), 8) as mean from s where s + 3600 <= (select epoch(w) from {WM}) group by 1, 2""")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R02."""
    r = streams.readings(spark, f"{sf_dir}/events.parquet").withColumn("link", F.col("user_id") % 10)
    out = streams.replay(streams.slot_sums(r, "link", "60 minutes", "5 minutes"), "history")
    return rounded(out.select(F.unix_timestamp("start").alias("start"), "link", "n", "mean"), "mean")


@query(f"""
with e as (select user_id % 10 as link, ts, value, case when ts - lag(ts) over (partition by user_id % 10 order by ts) < interval 30 minute then 0 else 1 end as new from events)
, s as (select *, sum(new) over (partition by link order by ts rows between unbounded preceding and current row) as sid from e)
select floor(epoch(min(ts)))::bigint as start, link, count(*) as n, round(max(value), 8) as peak from s group by link, sid having max(ts) + interval 30 minute <= (select w from {WM})""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R03."""
    r = streams.readings(spark, f"{sf_dir}/events.parquet").withColumn("link", F.col("user_id") % 10)
    out = streams.replay(streams.activity(r, "link", "30 minutes"), "sessions")
    return rounded(out.select(F.unix_timestamp("start").alias("start"), "link", "n", "peak"), "peak")


@query("""
select a.event_id as origin_id, b.event_id, a.user_id, round(b.value, 8) as value from events a join events b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'view' and b.ts <= a.ts and b.ts >= a.ts - interval 6 hour""")
def stream_causal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream interval join."""
    path = f"{sf_dir}/events.parquet"
    a, b = streams.readings(spark, path).filter("event_type = 'purchase'"), streams.readings(spark, path).filter("event_type = 'view'")
    return rounded(streams.replay(streams.causal_join(a, b, "user_id", "6 hours"), "causal"), "value")


@query("select distinct event_id from events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading sent twice, kept once."""
    r = streams.readings(spark, f"{sf_dir}/events.parquet").withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.replay(streams.once(r, ["event_id"]).select("event_id"), "once")


#: Readings that the watermark has passed at the end of the replay.
PASSED = "epoch_ms(ts) < (select epoch_ms(max(ts)) - 600000 from events)"


@query(f"""
with e as (select *, last_value(case when value >= 20 then value end ignore nulls) over w as lv, last_value(case when value >= 20 then epoch_us(ts) end ignore nulls) over w as lt from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
select event_id, user_id, round(case when epoch_us(ts) - lt <= 43200000000 then lv end, 8) as last_value, round(case when epoch_us(ts) - lt <= 43200000000 then (epoch_us(ts) - lt) / 1e6 end, 6) as age from e where {PASSED}""")
def stream_last_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful, in event time, forgotten after twelve hours; equals the batch window over what the watermark has passed."""
    out = streams.replay(streams.last_valid(streams.readings(spark, f"{sf_dir}/events.parquet"), "user_id", 20.0, 43200.0), "last-valid")
    return out.select("event_id", "user_id", F.round("last_value", 8).alias("last_value"), F.round("age", 6).alias("age"))


@query(f"""
with recursive e as (select event_id, user_id % 10 as link, value, epoch(ts) as t from events where value >= 20 and {PASSED})
, r as (select link, min((t, event_id)) as m from e group by 1
  union all select r.link, min((e.t, e.event_id)) from r join e on e.link = r.link and e.t >= struct_extract_at(r.m, 1) + 21600 group by r.link)
select e.event_id, e.link, e.value from r join e on e.link = r.link and e.event_id = struct_extract_at(r.m, 2)""")
def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful, greedy, in event time."""
    r = streams.readings(spark, f"{sf_dir}/events.parquet").withColumn("link", F.col("user_id") % 10)
    return streams.replay(streams.spaced_triggers(r, "link", 20.0, 21600.0), "triggers")


def _run_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of observed hours, with the observed values before and after each."""
    h = hourly(spark, sf_dir)
    w = Window.partitionBy("panel").orderBy("slot")
    seen = h.filter("value is not null").withColumns({"left": F.lag("value").over(w), "right": F.lead("value").over(w), "f": F.lit(True)})
    r = Window.partitionBy("panel", "run_start").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return runs.mark_runs(seen, ["panel"], "slot", "f").withColumns({"left": F.first("left").over(r), "right": F.last("right").over(r)})


@query()
def tv_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn to the observed values beside each run."""
    return rounded(smooth.smooth_runs(_run_cells(spark, sf_dir), ["panel"], "slot", "value", "tv", 0.2, 0.1, "left", "right"), "smoothed")


@query(f"""
with recursive {HOURLY}
, o as (select *, lag(value) over w as l, lead(value) over w as r, slot - row_number() over w as isle from hourly where value is not null window w as (partition by panel order by slot))
, c as (select panel, slot, value, min(slot) over i as run_start, max(slot) over i as run_end, first(l) over (partition by panel, isle order by slot) as xl, last(r) over (partition by panel, isle order by slot rows between unbounded preceding and unbounded following) as xr
  from o window i as (partition by panel, isle))
, d as (select *, slot - run_start + 1 as k, run_end - run_start + 1 as n from c)
, e as (select panel, run_start, run_end, slot, value, k, n, 1 + 2.0 * ((k > 1)::int + (k < n)::int) + case when k = 1 and xl is not null then 0.5 else 0 end + case when k = n and xr is not null then 0.5 else 0 end as g
  , value + case when k = 1 then coalesce(0.5 * xl, 0) else 0 end + case when k = n then coalesce(0.5 * xr, 0) else 0 end as b from d)
, fw as (select panel, run_start, k, n, slot, value, run_end, -2.0 / g as c, b / g as d from e where k = 1
  union all select e.panel, e.run_start, e.k, e.n, e.slot, e.value, e.run_end, -2.0 / (e.g + 2.0 * fw.c), (e.b + 2.0 * fw.d) / (e.g + 2.0 * fw.c) from fw join e on e.panel = fw.panel and e.run_start = fw.run_start and e.k = fw.k + 1)
, bw as (select panel, run_start, k, d as x from fw where k = n
  union all select fw.panel, fw.run_start, fw.k, fw.d - fw.c * bw.x from bw join fw on fw.panel = bw.panel and fw.run_start = bw.run_start and fw.k = bw.k - 1)
select panel, run_start, run_end, slot, value, round(x, 6) as smoothed from bw join fw using (panel, run_start, k)""")
def whittaker_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the observed values beside each run as anchors."""
    return rounded(smooth.smooth_runs(_run_cells(spark, sf_dir), ["panel"], "slot", "value", "whittaker", 2.0, 0.5, "left", "right"), "smoothed", digits=6)


@query(f"""
with recursive {LINK_CELLS}
, c as (select panel, slot, link from links where p >= 0.965)
, reach as (
  select panel, slot, link, slot as ox, link as oy from c
  union
  select c.panel, c.slot, c.link, r.ox, r.oy from reach r join c on c.panel = r.panel and abs(c.slot - r.slot) <= 1 and abs(c.link - r.link) <= 1 and (r.ox, r.oy) < (c.slot, c.link))
, f as (select panel, slot, link, min((ox, oy)) as o from reach group by 1, 2, 3)
select panel, slot, link, o[1] as ox, o[2] as oy, count(*) over (partition by panel, o) as cells from f""".replace("o[1]", "struct_extract_at(o, 1)").replace("o[2]", "struct_extract_at(o, 2)"))
def connected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected blobs of high cells in the slot-by-link plane."""
    return masks.connected_cells(link_cells(spark, sf_dir).filter("p >= 0.965"), ["panel"], "slot", "link")


@query(f"""
with recursive {LINK_CELLS}
, c as (select panel, slot, link, p from links where p >= 0.975)
, reach as (
  select panel, slot, link, slot as ox, link as oy from c
  union
  select c.panel, c.slot, c.link, r.ox, r.oy from reach r join c on c.panel = r.panel and abs(c.slot - r.slot) <= 2 and abs(c.link - r.link) <= 2 and (r.ox, r.oy) < (c.slot, c.link))
, f as (select panel, slot, link, min((ox, oy)) as o from reach group by 1, 2, 3)
, g as (select f.*, count(*) over w as cells, avg(p) over w as mean from f join c using (panel, slot, link) window w as (partition by panel, o))
select panel, slot, link, struct_extract_at(o, 1) as ox, struct_extract_at(o, 2) as oy, cells from g where cells >= 2 and mean >= 0.978""")
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments up to two cells apart are one, small and weak ones go."""
    return masks.connected_cells(link_cells(spark, sf_dir).filter("p >= 0.975"), ["panel"], "slot", "link", least=2, reach=2, score="p", least_score=0.978)


def _learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = link_cells(spark, sf_dir).withColumns({"y": F.coalesce(F.col("v") > 25, F.lit(False)).cast("int"), "fold": F.floor(F.col("slot") / 28) % 3, "tod": F.col("slot") % 4})
    from panelworks.operators.space import offsets

    return offsets(c, ["panel", "slot"], "link", "p", [-1, 1]).withColumn("w", F.lit(1.0))


@query()
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of a boosted classifier, calibrated per time of day."""
    rows = learn.out_of_fold(_learning_rows(spark, sf_dir).withColumnRenamed("p", "s_p"), ["o_m1", "o_1", "tod", "link"], "y", "fold", 3, "w", trees=3)
    return learn.isotonic_oof(rows, "p", "y", "fold", "tod", 3).select("panel", "slot", "link", "y", "p", "calibrated")


@query()
def residual_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals on an interpolation baseline, two kinds of rows."""
    c = _learning_rows(spark, sf_dir).filter("v is not null").withColumns({"base": 100 * (F.col("o_m1") + F.col("o_1")) / 2, "dark": F.col("slot") % 4 == 0})
    return learn.residual_fit(c, ["o_m1", "o_1", "tod", "link"], "v", "base", "w", "dark", trees=3).select("panel", "slot", "link", "v", "base", "fitted")


@query("""
with b as (select count(*) filter (where n > 1) as d, count(*) filter (where o_orderkey is null) as e, count(*) filter (where n is null) as m from (select l_orderkey as k, count(*) as n from lineitem where l_linenumber = 1 group by 1) full join orders on k = o_orderkey)
select u.name, u.n, u.n = 0 as ok from b, lateral (values ('duplicate', d), ('missing', m), ('extra', e)) u(name, n)""")
def checks_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check rows written as JSON and read again."""
    path = files.scratch(spark, "checks")
    sheet = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    files.write_checks(contract.check_keys(sheet, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), ["k"]), path)
    return spark.read.schema("name string, n long, ok boolean").json(path)


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelworks.plans.space import _placed

    first = learn.out_of_fold(_learning_rows(spark, sf_dir).withColumnRenamed("p", "s_p"), ["o_m1", "o_1", "tod", "link"], "y", "fold", 3, "w", trees=3).select("panel", "slot", "link", "y", "fold", "w", F.round("p", 6).alias("p"))
    placed = first.join(_placed(spark, sf_dir).select("panel", "slot", "link", "metres"), ["panel", "slot", "link"])
    return learn.stack(placed, ["panel", "slot"], "link", "metres", "p", 0.5, "y", "fold", 3, "w", trees=3)


@query()
def stacked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second stage on the shape of the first stage's profile and its blocks."""
    return _stacked(spark, sf_dir).select("panel", "slot", "link", "y", "p", "stacked")


@query()
def stacked_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC of both stages by panel."""
    long = _stacked(spark, sf_dir).select("panel", "y", F.expr("stack(2, 'first', p, 'second', stacked) as (stage, s)"))
    return rounded(score.auc(long, ["panel", "stage"], "y", "s"), "auc")
