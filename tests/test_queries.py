"""Every registered query outside llm against its SQL in DuckDB, on the smallest tables; the entry works without llm."""

import os
import shutil
import subprocess
import sys

import numpy as np
import pytest

import __spark_entry__ as entry
from panelworks.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(rows):
    def cell(x):
        if x is None or x != x:
            return "NULL"
        return f"{x:.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


def same(spark, duck, name, sf):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = canon(df.select(*columns).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    kinds = dict(zip(rel.columns, rel.types, strict=True))
    cast = ", ".join(f'"{c}"::double as "{c}"' if str(kinds[c]).startswith("DECIMAL") else f'"{c}"' for c in columns)
    assert got == canon(duck.sql(f"select {cast} from ({SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, name, SF)


@pytest.fixture(scope="module")
def longer(tmp_path_factory):
    """The tables with events of 40 more days and of ten days before the first slot."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("longer"))
    con = duckdb.connect()
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
        else:
            moved = " union all ".join(f"select * replace (ts + interval '{d} days' as ts) from '{SF}/events.parquet' where {w}" for d, w in ((0, "true"), (40, "event_id % 3 = 0"), (-10, "event_id % 5 = 0")))
            con.sql(f"copy ({moved}) to '{folder}/events.parquet'")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return folder, con


LONGER = ["active_runs", "fill_interpolate", "attachment_validity", "simulated_windows", "greedy_windows", "blackout_mask", "axis_offsets", "weekly_climatology", "masked_fill_check", "persistence_forecast", "slot_calendar"]


@pytest.mark.parametrize("name", LONGER)
def test_query_equals_sql_on_more_days(spark, longer, name):
    same(spark, longer[1], name, longer[0])


@pytest.mark.parametrize("files", [1, 3, 100])
def test_streams_do_not_depend_on_batches(spark, tmp_path, files):
    """Readings of six files, out of order in each and across neighbours, against one pass in order; the first file comes first."""
    import duckdb
    from pyspark.sql import functions as F

    from panelworks.streaming import streams

    con = duckdb.connect()
    con.sql(f"create table e as select * replace (event_id::bigint as event_id), ntile(6) over (order by epoch(ts) + hash(event_id) % 500) as f, hash(event_id * 7) as h from '{SF}/events.parquet'")
    for k in range(1, 7):
        path = f"{tmp_path}/part-{k}.parquet"
        con.sql(f"copy (select * exclude (f, h) from e where f = {k} order by h) to '{path}'")
        os.utime(path, (1_700_000_000 + 100 * k,) * 2)  # the source reads files by age
    stream = lambda: streams.readings(spark, f"{tmp_path}/part-*.parquet", files=files)
    got = streams.replay(streams.last_valid(stream(), "user_id", 20.0, 43200.0), "test-last").collect()
    fired = streams.replay(streams.spaced_triggers(stream().withColumn("user_id", F.col("user_id") % 10), "user_id", 20.0, 21600.0), "test-fired").collect()
    rows = con.execute("select event_id, user_id, value, epoch_us(ts) from e order by ts, event_id").fetchall()
    end = max(t for *_, t in rows) // 1000 - 600_000
    last, want, taken, due = {}, {}, set(), {}
    for i, user, value, t in rows:
        if t // 1000 >= end:
            break
        at = last.get(user)
        want[i] = (at[1], (t - at[0]) / 1e6) if at and t - at[0] <= 43200e6 else (None, None)
        if value >= 20:
            last[user] = (t, value)
            if t >= due.get(user % 10, 0):
                due[user % 10] = t + 21600e6
                taken.add(i)
    assert {r.event_id: (r.last_value, r.age) for r in got} == want and len(got) == len(want)
    assert {r.event_id for r in fired} == taken and len(fired) == len(taken)


def test_out_of_fold_scores_have_all_rows_and_rank_them(spark):
    rows = QUERIES["out_of_fold_scores"](spark, SF).toPandas()
    assert len(rows) == QUERIES["axis_offsets"](spark, SF).count() and rows["p"].between(0, 1).all() and rows["calibrated"].between(0, 1).all()
    for _, own in rows.assign(tod=rows["slot"] % 4, fold=rows["slot"] // 28 % 3).groupby(["tod", "fold"]):
        assert own.sort_values("p")["calibrated"].is_monotonic_increasing


def test_stacked_scores_rank_better_than_chance(spark):
    rows = QUERIES["stacked_scores"](spark, SF).toPandas()
    assert rows["stacked"].between(0, 1).all() and rows["stacked"].nunique() > 10 and not rows.duplicated(["panel", "slot", "link"]).any()
    auc = QUERIES["stacked_auc"](spark, SF).toPandas()
    assert (auc["auc"] > 0.5).mean() > 0.7
    for (panel, stage), own in auc.groupby(["panel", "stage"]):
        mine = rows[rows["panel"] == panel]
        s = mine["p" if stage == "first" else "stacked"].rank()
        pos = mine["y"] == 1
        want = (s[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
        assert abs(want - own["auc"].iloc[0]) < 1e-6


def test_residual_model_is_nearer_than_its_baseline(spark):
    rows = QUERIES["residual_model"](spark, SF).toPandas()
    known = rows.dropna(subset=["base"])
    assert len(known) > 100 and ((known["fitted"] - known["v"]) ** 2).mean() < ((known["base"] - known["v"]) ** 2).mean()


def test_learned_filter_grid(spark):
    rows = QUERIES["learned_mask_filter"](spark, SF).toPandas().sort_values("cut")
    kept = rows["tp"] + rows["fp"]
    assert rows["cut"].tolist() == [0.0, 0.25, 0.5, 0.75] and kept.is_monotonic_decreasing and rows["fn"].is_monotonic_increasing
    assert np.allclose(rows["pq"], rows["s"] / (rows["tp"] + 0.5 * rows["fp"] + 0.5 * rows["fn"]), atol=1e-6)


def test_quotas_of_every_supplier(spark):
    rows = QUERIES["quota_allocation"](spark, SF).toPandas()
    sums = rows.groupby("l_suppkey").agg(quota=("quota", "sum"), rows=("rows", "sum"))
    assert (rows["quota"] <= rows["rows"]).all() and (sums["quota"] == sums["rows"].clip(upper=40)).all()


def test_bootstrap_intervals_hold_the_mean(spark):
    rows = QUERIES["paired_bootstrap"](spark, SF).toPandas()
    assert len(rows) and rows.notna().all().all()


def test_tv_smoothing_lowers_its_cost(spark):
    rows = QUERIES["tv_smoothing"](spark, SF).toPandas()
    assert len(rows) == len(rows.dropna(subset=["smoothed"]))
    for _, own in rows.sort_values("slot").groupby(["panel", "run_start"]):
        y, x = own["value"].to_numpy(), own["smoothed"].to_numpy()
        if len(y) > 1:
            assert np.abs(np.diff(x)).sum() <= np.abs(np.diff(y)).sum() + 2 * np.ptp(rows["value"]) * 0.5


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_llm(tmp_path):
    root = os.path.dirname(entry.__file__)
    shutil.copytree(f"{root}/panelworks", tmp_path / "panelworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'active_runs' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
