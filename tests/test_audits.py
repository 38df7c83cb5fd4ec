"""Screenlines, two-way fits, rank correlations, decoded rows, pairs of files and imputed states against brute force."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from panelworks.operators import balance, blend, fits, learn, setscores, space
from panelworks.sources import files


def test_screenlines_are_the_equal_sets_of_paths(spark):
    rng = random.Random(3)
    paths = {p: (g, rng.randrange(6), rng.randrange(1, 7)) for p, g in enumerate(rng.choices("ab", k=60))}
    paths[60], paths[61] = ("a", None, 3), ("b", 4, 2)
    sets = {}
    for g, k in itertools.product("ab", range(7)):
        crossing = {p for p, (h, o, d) in paths.items() if h == g and o is not None and o <= k < d}
        if crossing:
            some = rng.choice(sorted(crossing))
            sets |= {(g, f"all{k}"): crossing, (g, f"less{k}"): crossing - {some}, (g, f"more{k}"): crossing | {60 if g == "a" else 61}, (g, f"lost{k}"): crossing | {99}}
    edges = [(g, link, p) for (g, link), own in sets.items() for p in own] * 2
    rows = spark.createDataFrame([(g, p, o, d) for p, (g, o, d) in paths.items()], "panel string, path long, o long, d long")
    got = balance.screenlines(spark.createDataFrame(edges, "panel string, link string, path long"), rows, ["panel"]).collect()
    ideal = {(g, k): {p for p, (h, o, d) in paths.items() if h == g and o is not None and o <= k < d} for g in "ab" for k in range(7)}
    assert len(got) == len([own for own in sets.values() if own])
    for r in got:
        own = sets[r.panel, r.link]
        origins = [paths[p][1] for p in own if p in paths and paths[p][1] is not None]
        k = max(origins, default=None)
        assert r.n_paths == len(own) and r.segment == (k if k is not None and ideal[r.panel, k] == own else None), r
    assert {r.link[:3] for r in got if r.segment is not None} >= {"all"}
    none = balance.screenlines(spark.createDataFrame([], "panel string, link string, path long"), rows, ["panel"])
    assert none.count() == 0


def test_two_way_fit_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key in ("dense", "sparse"):
        for _ in range(400 if key == "dense" else 45):
            o, d = sorted(rng.choice(12, 2, replace=False).tolist())
            rows.append((key, o, d, float(np.log(d - o) + 0.1 * rng.normal()), float(o - 0.5 * d + rng.normal())))
    rows += [("flat", o, d, float(o + 2 * d), float(o * d)) for o in range(4) for d in range(5)]
    odd = [("dense", None, 1, 1.0, 1.0), ("dense", 1, 2, None, 1.0), ("dense", 1, 2, 1.0, None), (None, 1, 2, 1.0, 1.0)]
    got = {r.key: r for r in fits.two_way_fit(spark.createDataFrame(rows + odd, "key string, o long, d long, x double, y double"), ["key"], "o", "d", "x", "y").collect()}
    assert set(got) == {"dense", "sparse", "flat"}
    for key, r in got.items():
        own = [t for t in rows if t[0] == key]
        design = np.zeros((len(own), 25))
        for k, (_, o, d, x, _) in enumerate(own):
            design[k, o] = design[k, 12 + d] = 1
            design[k, 24] = x
        y = np.array([t[4] for t in own])
        fit = np.linalg.lstsq(design, y, rcond=None)[0]
        assert r.n == len(own) and math.isclose(r.residual_sd, np.std(y - design @ fit), abs_tol=1e-7)
        assert r.slope is None if key == "flat" else math.isclose(r.slope, fit[-1], abs_tol=1e-7)
    assert fits.two_way_fit(spark.createDataFrame([], "key string, o long, d long, x double, y double"), ["key"], "o", "d", "x", "y").count() == 0


def test_rank_correlations_of_ties_and_nulls(spark):
    import pandas as pd

    rng = np.random.default_rng(6)
    table = pd.DataFrame({"id": range(300), "a": rng.integers(0, 6, 300).astype(float), "b": rng.normal(size=300)})
    table["c"] = table.a * 2 + rng.integers(0, 4, 300)
    rows = [(int(r.id), r.a, r.b, r.c) for r in table.itertuples()] + [(300, None, 1.0, 1.0), (301, 1.0, None, 2.0)]
    got = {(r.one, r.other): r for r in fits.rank_correlations(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["id"], ["a", "b", "c"]).collect()}
    ranks = table[["a", "b", "c"]].rank().corr()
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert all(r.n == 300 and abs(r.rho - ranks.loc[pair]) < 1e-9 for pair, r in got.items())


def test_rows_scored_by_every_decoder_and_truth(spark):
    rng = random.Random(8)
    rows = [(w, c, round(rng.random(), 2)) for w in range(15) for c in range(8) if rng.random() < 0.8] + [(20, 1, 0.0), (20, 2, 0.0), (21, 1, None)]
    truths = [(w, c, t) for w in (*range(14), 30) for c in range(9) for t in ("x", "y") if rng.random() < (0.4 if t == "x" else 0.15)] + [(0, 0, "unasked"), (30, 1, "x")]
    decoders = {"best": ("expected", 1.0, None), "sharp": ("expected", 3.0, 2), "cut": ("cut", 0.6), "top": ("top", 3)}
    got = setscores.score_rows(
        spark.createDataFrame(rows, "w long, c long, p double"), spark.createDataFrame(truths + truths[:5], "w long, c long, truth string"), ["w"], ["c"], "p", decoders, ["x", "y"]
    ).collect()
    windows = {r[0] for r in rows if r[2] is not None} | {t[0] for t in truths if t[2] != "unasked"}
    assert len(got) == len(windows) * 8 and {r.w for r in got} == windows
    for r in got:
        order = sorted(((c, p) for w, c, p in rows if w == r.w and p is not None), key=lambda t: (-t[1], t[0]))
        truth = {c for w, c, t in truths if w == r.w and t == r.truth}

        def overlap(m, power):
            q = [p**power for _, p in order]
            return round(sum(q[:m]) / (m + sum(q) - sum(q[:m])), 9)

        size = 0
        if order:
            if r.decoder == "best":
                size = max(range(1, len(order) + 1), key=lambda m: (overlap(m, 1), -m))
            elif r.decoder == "sharp":
                size = max(range(1, min(len(order), 2) + 1), key=lambda m: (overlap(m, 3), -m))
            elif r.decoder == "cut":
                size = max(1, sum(p >= 0.6 for _, p in order))
            else:
                size = min(3, len(order))
        taken = {c for c, _ in order[:size]}
        assert (r.size, r.n_true) == (size, len(truth))
        assert abs(r.iou - (len(taken & truth) / len(taken | truth) if taken | truth else 1.0)) < 1e-12
        assert r.surrogate is None if not order else abs(r.surrogate - overlap(size, 1)) < 1e-8
    with pytest.raises(ValueError):
        setscores.score_rows(spark.createDataFrame(rows, "w long, c long, p double"), spark.createDataFrame(truths, "w long, c long, truth string"), ["w"], ["c"], "p", {"z": ("no", 1)}, ["x"])


def test_binary_pairs_by_their_bytes(spark, tmp_path):
    rng = random.Random(9)
    bodies = [b"", b"\x00\xff\x80", bytes(rng.randrange(256) for _ in range(70_000)), b"\x00\xff\x81"]
    want = {}
    for k in range(24):
        key = f"{k:02d}"
        for side, body in (("imgs", bodies[k % 4]), ("masks", bodies[(k // 4) % 3])):
            if side == "masks" and k in (0, 7):
                continue
            os.makedirs(tmp_path / side / str(k % 2), exist_ok=True)
            (tmp_path / side / str(k % 2) / f"{key}.tif").write_bytes(body)
        if k not in (0, 7) and bodies[k % 4] and bodies[(k // 4) % 3]:
            want.setdefault((bodies[k % 4], bodies[(k // 4) % 3]), []).append(key)
    (tmp_path / "masks" / "0" / "alone.tif").write_bytes(b"x")
    got = files.read_binary_pairs(spark, f"{tmp_path}/imgs", f"{tmp_path}/masks", r"([^/]+)\.tif$").collect()
    assert sorted((r.key, r.n, r.n_bytes) for r in got) == sorted((min(v), len(v), len(a) + len(b)) for (a, b), v in want.items())
    assert all(r.left_path.endswith(f"{r.key}.tif") and "/masks/" in r.right_path for r in got)


@pytest.fixture(scope="module")
def queue():
    """Queues that begin at once over many positions and last some slots; a fifth of the cells are missing."""
    rng = np.random.default_rng(11)
    ratio = 1.6 + 0.15 * rng.normal(size=(240, 30))
    for _ in range(70):
        t, a = rng.integers(0, 236), rng.integers(0, 22)
        ratio[t : t + rng.integers(2, 5), a : a + rng.integers(5, 9)] = 0.6
    truth = ratio + 0.15 * rng.normal(size=ratio.shape)
    return truth, rng.random(ratio.shape) < 0.2


def test_imputer_beats_the_means_in_time_on_hidden_cells(spark, queue):
    truth, hidden = queue
    rows = [("q", t, k, None if hidden[t, k] else float(truth[t, k]), False, (t // 24) % 2) for t in range(240) for k in range(30)]
    df = spark.createDataFrame(rows, "panel string, slot long, link long, ratio double, guess boolean, fold int").withColumnRenamed("panel", "p_anel")
    got = learn.impute_states(df, ["p_anel"], "slot", "link", "ratio", "guess", "fold", 2, trees=10).collect()
    assert len(got) == 7200
    for r in got:
        if not hidden[r.slot, r.link]:
            assert r.learned == r.hybrid == (truth[r.slot, r.link] <= 1)
    gaps = [(r, bool(truth[r.slot, r.link] <= 1)) for r in got if hidden[r.slot, r.link]]
    near = [(r, y) for r, y in gaps if r.by_time is not None and r.by_space is not None]
    share = lambda name: np.mean([getattr(r, name) == y for r, y in near])
    recall = lambda name: np.mean([getattr(r, name) for r, y in near if y])
    assert share("learned") > share("by_time") and share("learned") > share("by_space") and recall("learned") > recall("by_time")
    for r, _ in gaps:
        around = [truth[t, k] for t in range(max(r.slot - 1, 0), min(r.slot + 2, 240)) for k in range(max(r.link - 2, 0), min(r.link + 3, 30)) if not hidden[t, k]]
        assert r.hybrid == (r.p >= 0.5 if any(v <= 1 for v in around) else False)


def test_medians_by_ranges(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.0, 0.0, round(rng.random(), 2)])) for _ in range(500)] + [("none", None), ("one", 4.0), ("two", 1.0), ("two", 2.0)]
    got = blend.median_smooth(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 0.25).collect()
    want = {k: [x for g, x in rows if g == k and x is not None] for k in {g for g, _ in rows}}
    for few in (0, 60, 10_000):
        medians = blend.exact_medians(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "m", few).select("_g.k", "m").collect()
        assert {r.k for r in medians} == {k for k, v in want.items() if v} and all(abs(r.m - np.median(want[r.k])) < 1e-12 for r in medians)
    assert len(got) == len(rows) and sorted(map(str, ((r.k, r.x) for r in got))) == sorted(map(str, rows))
    for r in got:
        assert r.smoothed is None if r.x is None else abs(r.smoothed - (0.75 * r.x + 0.25 * np.median(want[r.k]))) < 1e-12


def test_direction_of_consecutive_links(spark):
    rng = random.Random(13)
    axis = [(k, k // 2 * 10) for k in range(200)]  # two links at each position
    edges = [(k, k + rng.choice([-1, 1, 2])) for k in range(200)] * 2
    r = space.direction_vote(spark.createDataFrame(axis, "link long, pos long"), spark.createDataFrame(edges, "from_link long, to_link long"), "pos", "link").first()
    assert (r.forward, r.backward) == (len({e for e in edges if e[1] == e[0] + 1 and e[1] < 200}), len({e for e in edges if e[1] == e[0] - 1 and e[1] >= 0}))
    assert tuple(space.direction_vote(spark.createDataFrame([], "link long, pos long"), spark.createDataFrame(edges, "from_link long, to_link long"), "pos", "link").first()) == (0, 0)


def test_masked_check_without_a_truth_under_the_cut(spark):
    rows = [(k, s, 10.0 + 10 * k) for k in (0, 1) for s in range(9)]
    got = {r.k: r for r in balance.masked_check(spark.createDataFrame(rows, "k int, s long, v double"), ["k"], "s", "v", "s % 3 = 1", 15.0).collect()}
    assert (got[0].recall, got[0].specificity, got[1].recall, got[1].specificity) == (1.0, None, None, 1.0) and got[1].accuracy == 1.0


def test_imputer_check_without_a_cell_at_the_cut(spark, tmp_path):
    import duckdb

    from panelworks.plans import QUERIES

    duckdb.sql(f"copy (select * replace (value + 1000 as value) from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet'")
    rows = QUERIES["imputer_check"](spark, str(tmp_path)).collect()
    assert rows and all(r.recall is None and r.specificity == 1.0 and r.accuracy == 1.0 for r in rows)


def test_scores_without_labels_in_the_other_folds(spark):
    df = spark.createDataFrame([(k, k % 2, float(k), float(k % 4 > 1) if k % 2 else None) for k in range(40)], "id long, fold int, x double, y double")
    got = {r.id: r.p for r in learn.out_of_fold(df, ["x"], "y", "fold", 2, trees=2).collect()}
    assert len(got) == 40 and all((p is None) == (k % 2 == 1) for k, p in got.items())


def test_diagnostics_hold_no_key_in_a_task(spark):
    from panelworks.operators import score

    rng = np.random.default_rng(4)
    rows = [(None if k % 3 == 0 else "ab"[k % 2], float(rng.normal()), None if k % 10 == 0 else float(rng.normal())) for k in range(200)]
    out = score.diagnostics(spark.createDataFrame(rows, "k string, e double, r double"), ["k"], "e", "r")
    assert "Window" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        d = np.array([e - x for k, e, x in rows if k == r.k and x is not None])
        assert r.n == len(d) and abs(r.mad_debiased - np.abs(d - d.mean()).mean()) < 1e-9 and abs(r.mad - np.abs(d).mean()) < 1e-9


def test_rank_correlations_need_no_name_of_a_row(spark):
    rows = [(float(k % 7), float(k * k % 11)) for k in range(100)]
    (got,) = fits.rank_correlations(spark.createDataFrame(rows, "a double, b double"), [], ["a", "b"]).collect()
    rank = lambda own: [sum(x < v for x in own) + sum(x == v for x in own) / 2 for v in own]
    assert got.n == 100 and abs(got.rho - np.corrcoef(rank([a for a, _ in rows]), rank([b for _, b in rows]))[0, 1]) < 1e-9


def test_readings_under_the_cut_move_the_watermark(spark, tmp_path):
    import datetime as dt

    from panelworks.streaming import streams

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(1, at(0), 7, "a", 30.0, "{}"), (2, at(60), 7, "a", 1.0, "{}")], streams.READINGS).coalesce(1).write.parquet(f"{tmp_path}/e")
    got = streams.replay(streams.spaced_triggers(streams.readings(spark, f"{tmp_path}/e/part-*.parquet"), "user_id", 20.0, 60.0), "test-mark").collect()
    assert [r.event_id for r in got] == [1]


def test_letters_that_every_match_begins_with():
    from panelworks.operators.labels import _literal

    assert [_literal(p) for p in (r"\band the\b", "licen[cs]e", r"mail\d", "colou?r", "a|b", "(?:x)", r"\d", "ab*", "ab+")] == ["and the", "licen", "mail", "colo", "", "", "", "a", "ab"]


@pytest.mark.parametrize("band", [1, 3, 1024])
def test_polygons_in_bands_of_rows(spark, monkeypatch, band):
    from panelworks.operators import raster

    monkeypatch.setattr(raster, "BAND", band)
    rings = [[(0.2, -3.0), (9.0, 4.1), (3.3, 12.0), (-4.0, 5.5)], [(2.0, 3.0), (4.0, 3.0), (3.0, 6.0)]]
    df = spark.createDataFrame([(1, r) for r in rings], "k int, points array<struct<x:double,y:double>>")
    got = sorted((r.row, x) for r in raster.polygon_runs(df, ["k"], "points").collect() for x in range(r.x0, r.x1))
    inside = lambda px, py: sum((a[1] <= py) != (b[1] <= py) and a[0] + (py - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= px for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)) % 2
    assert got == [(y, x) for y in range(-6, 15) for x in range(-8, 14) if inside(x + 0.5, y + 0.5)]


@pytest.mark.parametrize("block", [1, 4, 64])
def test_contours_meet_values_in_blocks(spark, monkeypatch, block):
    from panelworks.operators import raster

    monkeypatch.setattr(raster, "BLOCK", block)
    runs = [("m", 1, 0, -3, 6), ("m", 1, 1, -2, 9), ("m", 1, 2, 0, 4), ("m", 2, 1, 11, 13)]
    values = [("m", r, x, float(10 * r + x * x)) for r in range(-1, 4) for x in range(-6, 16) if (r + x) % 3]
    got = raster.contour_features(spark.createDataFrame(runs, "image string, inst int, row long, x0 long, x1 long"), spark.createDataFrame(values, "image string, row long, x long, v double"), ["image"], "inst", "v").collect()
    held = {i: {(r, x) for _, k, r, a, b in runs if k == i for x in range(a, b)} for i in (1, 2)}
    known = {(r, x): v for _, r, x, v in values}
    assert len(got) == 2
    for g in got:
        own = held[g.inst]
        ring = {(r + a, x + b) for r, x in own for a in (-1, 0, 1) for b in (-1, 0, 1)} - held[1] - held[2]
        edge = {(r, x) for r, x in own if not {(r - 1, x), (r + 1, x), (r, x - 1), (r, x + 1)} <= own}
        mean = lambda c: np.mean([known[k] for k in c if k in known])
        assert (g.area, g.edge, g.ring) == (len(own), len(edge), len(ring))
        assert abs(g.inside - mean(own)) < 1e-9 and abs(g.around - mean(ring)) < 1e-9 and abs(g.contrast - g.around + g.inside) < 1e-12
