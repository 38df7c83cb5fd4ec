"""The registry of queries and the test tables in the shapes that the operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions import columns as C
from panelworks.operators import grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ORIGIN = "2024-01-01 00:00:00"
#: Users and suppliers stand for links by their number modulo this.
LINKS = 10


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def slot_range(spark: SparkSession, sf_dir: str, seconds: int) -> tuple[int, int]:
    """The first slot, 0 or that of an earlier event, and the slot of the last event: two numbers."""
    slot = C.slot_index(F.col("ts"), ORIGIN, seconds)
    first, last = read(spark, sf_dir, "events").agg(F.min(slot), F.max(slot)).first()
    return (0, -1) if last is None else (min(0, first), last)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hourly panel up to the last event: panel = event type, slot = hour, value = mean value or NULL."""
    cells = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("panel"), C.slot_index(F.col("ts"), ORIGIN, 3600).alias("slot")).agg(F.avg("value").alias("value"))
    return grid.densify(cells, ["panel"], "slot", *slot_range(spark, sf_dir, 3600))


#: CTEs of hourly(): panel, slot, value.
HOURLY = f"""hcells as (select event_type as panel, floor((epoch(ts) - 1704067200) / 3600)::bigint as slot, avg(value) as value from events group by all)
, hourly as (select panel, slot, value from (select distinct panel from hcells) cross join (select unnest(range((select least(0, min(slot)) from hcells), (select max(slot) + 1 from hcells)))::bigint as slot) left join hcells using (panel, slot))"""


def link_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense panel with a space axis: panel, slot (6 hours), link (user mod 10), v, and p = v / (1 + v) rounded, 0 where v misses."""
    cells = read(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("panel"), C.slot_index(F.col("ts"), ORIGIN, 21600).alias("slot"), (F.col("user_id") % LINKS).alias("link")
    ).agg(F.avg("value").alias("v"))
    dense = grid.spine(cells, ["panel", "link"], "slot", *slot_range(spark, sf_dir, 21600)).join(cells, ["panel", "link", "slot"], "left")
    return dense.select("panel", "slot", "link", "v", F.coalesce(F.round(F.col("v") / (1 + F.col("v")), 6), F.lit(0.0)).alias("p"))


#: CTEs of link_cells(): panel, slot, link, v, p.
LINK_CELLS = f"""lcells as (select event_type as panel, floor((epoch(ts) - 1704067200) / 21600)::bigint as slot, user_id % {LINKS} as link, avg(value) as v from events group by all)
, links as (select panel, slot, link, v, coalesce(round(v / (1 + v), 6), 0.0) as p
  from (select distinct panel, link from lcells) cross join (select unnest(range((select least(0, min(slot)) from lcells), (select max(slot) + 1 from lcells)))::bigint as slot) left join lcells using (panel, link, slot))"""


def link_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link dimension from all suppliers: link, length in km, capacity."""
    sums = read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % LINKS).alias("link")).agg(F.sum(F.abs(F.round("s_acctbal"))).cast("long").alias("_s"))
    return sums.select("link", F.round(0.3 + (F.col("_s") % 7) / 10, 1).alias("km"), (1000 + F.col("_s") % 900).cast("double").alias("capacity"))


LINK_AXIS = f"""axis as (select link, round(0.3 + (s % 7) / 10, 1) as km, (1000 + s % 900)::double as capacity from (select s_suppkey % {LINKS} as link, sum(abs(round(s_acctbal)))::bigint as s from supplier group by 1))"""
