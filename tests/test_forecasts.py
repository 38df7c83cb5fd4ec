"""Carried deviations, similar windows, rows of steps, origins, ensembles, members' means, areas and estimators against brute force."""

import math
import random

import numpy as np
import pytest

from panelworks.operators import balance, blend, fill, masks, windows


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9))


def test_deviations_are_carried_from_both_sides(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, rng.uniform(0, 9)]), rng.choice([None, 1.0, rng.uniform(0, 9)])) for k in "ab" for t in rng.sample(range(60), 30)]
    rows += [("c", 0, None, 1.0), ("c", 5, None, None), ("d", 3, 4.0, 1.0), (None, 1, 2.0, 1.0), (None, 4, None, 3.0)]
    got = fill.deviation_carry(spark.createDataFrame(rows, "k string, t long, v double, e double"), ["k"], "t", "v", "e").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r.k and x[2] is not None]
        prev, nxt = max((x for x in own if x[1] < r.t), key=lambda x: x[1], default=None), min((x for x in own if x[1] > r.t), key=lambda x: x[1], default=None)
        sides = [x for x in (prev, nxt) if x]
        line = prev[2] + (nxt[2] - prev[2]) * (r.t - prev[1]) / (nxt[1] - prev[1]) if len(sides) == 2 else sides[0][2] if sides else None
        off = [x[2] - x[3] for x in sides if x[3] is not None]
        assert near(r.line, line) and near(r.carried, r.e + sum(off) / len(off) if off and r.e is not None else None)
    assert fill.deviation_carry(spark.createDataFrame([], "k string, t long, v double, e double"), ["k"], "t", "v", "e").count() == 0


@pytest.mark.parametrize("reach, same", [(1, None), (1, ["cls"]), (None, None), (None, ["cls"])])
def test_similar_windows_of_one_class(spark, reach, same):
    rng = random.Random(2)
    origins = [("p", o, o % 5, o // 8 % 3, o % 7 > 4) for o in range(40)]
    truth = [("p", o, link, rng.choice([0, 1, None])) for o in range(40) for link in range(4) if rng.random() < 0.8]
    args = spark.createDataFrame(origins, "panel string, origin long, tod long, fold long, cls boolean"), spark.createDataFrame(truth, "panel string, origin long, link long, y int")
    got = {(r.origin, r.link): r for r in windows.similar_prior(*args, ["panel"], "origin", "tod", "fold", reach, 3, same).collect()}
    by = {o: (tod, fold, cls) for _, o, tod, fold, cls in origins}
    for o, (tod, fold, cls) in by.items():
        for link in range(4):
            met = [y for _, b, m, y in truth if m == link and by[b][1] != fold and (reach is None or abs(by[b][0] - tod) <= reach) and (not same or by[b][2] == cls)]
            known = [y for y in met if y is not None]
            if not met:
                assert (o, link) not in got
            else:
                assert got[o, link].n_similar == len(known) and near(got[o, link].prior, sum(known) / len(known) if len(known) >= 3 else None)


def test_neighbour_max_passes_over_nulls_and_gaps(spark):
    rows = [("p", 0, 0.1), ("p", 1, None), ("p", 2, 0.5), ("p", 3, 0.2), ("p", 7, None), ("p", 9, 0.3)]
    got = {r.link: r.m for r in windows.neighbour_max(spark.createDataFrame(rows, "panel string, link long, x double"), ["panel"], "link", "x", "m").collect()}
    assert got == {0: 0.1, 1: 0.5, 2: 0.5, 3: 0.5, 7: None, 9: 0.3}


def test_steps_take_the_profile_of_their_own_phase(spark):
    rows = [("a", 5, 4.0, 1.5), ("a", 6, None, 1.0), ("b", 0, 2.0, None)]
    profile = {("a", p): p * 10 for p in range(7)} | {("b", 1): 3}
    got = windows.expand_steps(
        spark.createDataFrame(rows, "k string, phase long, d double, r double"), 4, spark.createDataFrame([(k, p, x) for (k, p), x in profile.items()], "k string, phase long, x long"), ["k"], "phase", 7, "d", "r", 3.0
    ).collect()
    assert len(got) == 12
    for r in got:
        d, rate = next((d, x) for k, p, d, x in rows if (k, p) == (r.k, r.phase))
        assert r.x == profile.get((r.k, (r.phase + r.step) % 7)) and near(r.d_proj, None if d is None or rate is None else d - rate * r.step / 3)


def test_origins_equal_a_walk_through_the_panel(spark):
    rng = random.Random(4)
    rows, grids = [], {}
    for panel, rate in (("a", 0.08), ("b", 0.5), ("c", 0.97), ("d", 0.0)):
        flags = {(t, link): rng.random() < rate for t in range(120) for link in range(4)}
        for t, link in list(flags):  # queues last
            flags[t, link] = flags[t, link] or (flags.get((t - 1, link), False) and rng.random() < 0.6)
        grids[panel] = flags
        rows += [(panel, t, link, None if not f and rng.random() < 0.3 else f) for (t, link), f in flags.items()]
    got = windows.select_origins(spark.createDataFrame(rows, "panel string, slot long, link long, q boolean").repartition(5), ["panel"], "link", "slot", "q", 4, 3, 2, 0.7, 6)
    want, passed = set(), 0
    for panel, q in grids.items():
        last = {True: -99, False: -99}
        for t in range(4, 117):
            later = [[q[t + k, link] for link in range(4)] for k in (1, 2, 3)]
            if not any(map(any, later)):
                continue
            ongoing = any(sum(q[t - k, link] for k in range(5)) >= 2 for link in range(4))
            if t - last[ongoing] < 6:
                continue
            inter = sum(x and q[t, link] for row in later for link, x in enumerate(row))
            union = sum(x or q[t, link] for row in later for link, x in enumerate(row))
            if ongoing and inter / union > 0.7:
                passed += 1
                continue
            want.add((panel, ongoing, t))
            last[ongoing] = t
    assert {tuple(r) for r in got.collect()} == want and {o for _, o, _ in want} == {True, False} and passed
    assert windows.select_origins(spark.createDataFrame([], "panel string, slot long, link long, q boolean"), ["panel"], "link", "slot", "q", 4, 3, 2, 0.7, 6).count() == 0


MEMBERS = "fold string, member string, id long, target string, p double"
WEIGHTS = "fold string, target string, w double"


def test_fold_ensemble_ranks_the_means_of_folds(spark):
    rng = random.Random(5)
    rows = [(f, m, i, t, rng.choice([0.25, 0.5, rng.random()])) for f, m in (("x", "1"), ("x", "2"), ("y", "3"), ("z", "4")) for i in range(40) for t in "uv"]
    weights = {("x", "u"): 1.0, ("y", "u"): 3.0, ("x", "v"): 1.0, ("y", "v"): 0.0, ("z", "v"): 0.5}
    w = spark.createDataFrame([(f, t, x) for (f, t), x in weights.items()], WEIGHTS)
    got = {(r.id, r.target): r.ensemble for r in blend.fold_ensemble(spark.createDataFrame(rows, MEMBERS), "member", "fold", ["id"], "target", "p", w).collect()}
    assert len(got) == 80
    for t in "uv":
        total = np.zeros(40)
        for f in "xyz":
            own = np.array([np.mean([r[4] for r in rows if (r[0], r[2], r[3]) == (f, i, t)]) for i in range(40)])
            rank = np.array([np.mean([1 + np.sum(own < x), np.sum(own <= x)]) for x in own]) / 40
            total += weights.get((f, t), 0.0) * rank
        total /= sum(x for (_, u), x in weights.items() if u == t)
        assert all(near(got[i, t], total[i]) for i in range(40))


@pytest.mark.parametrize("odd", [("x", "1", 7, "u", None), ("x", "1", 7, "u", float("nan"))])
def test_fold_ensemble_refuses_members_with_gaps(spark, odd):
    rows = [("x", m, i, "u", i / 10) for m in "12" for i in range(10) if (m, i) != ("1", 7)]
    w = spark.createDataFrame([("x", "u", 1.0)], WEIGHTS)
    for table in (rows, [*rows, odd]):
        with pytest.raises(Exception, match="not every member"):
            blend.fold_ensemble(spark.createDataFrame(table, MEMBERS), "member", "fold", ["id"], "target", "p", w).collect()
    assert blend.fold_ensemble(spark.createDataFrame([], MEMBERS), "member", "fold", ["id"], "target", "p", w).count() == 0


def test_targets_are_drawn_by_their_share(spark):
    one = spark.createDataFrame([(1, "u", 0.2), (2, "u", 0.4), (1, "v", 0.6)], "id long, target string, p double")
    other = spark.createDataFrame([(1, "u", 1.0), (1, "v", 0.0)], "id long, target string, p double")
    got = {(r.id, r.target): r.p for r in blend.target_mix(one, other, ["id"], "target", "p", spark.createDataFrame([("u", 0.25)], "target string, w double")).collect()}
    assert near(got[1, "u"], 0.4) and got[2, "u"] == 0.4 and got[1, "v"] == 0.6


def test_members_are_averaged_and_held_to_be_alike(spark):
    kinds = "member int, id long, n_missing_of string, x double, y double"
    rows = [(m, i, None if i == 3 else f"s{i}", m + i / 7, None if (m, i) == (1, 2) else float("nan") if (m, i) == (0, 4) else 1.0) for m in range(3) for i in range(6)]
    got = {r.id: r for r in blend.member_mean(spark.createDataFrame(rows, kinds), "member", ["id"], ["x", "y"], 3).collect()}
    assert sorted(got) == list(range(6)) and got[3].n_missing_of is None and got[5].n_missing_of == "s5"
    assert all(near(got[i].x, 1 + i / 7) and got[i].y == (None if i in (2, 4) else 1.0) and got[i].n_missing == (i in (2, 4)) for i in range(6))
    for odd in ([(0, 9, "s", 1.0, 1.0)], [(0, 0, "s0", 1.0, 1.0)], [(m, 9, "t" if m else None, 1.0, 1.0) for m in range(3)]):
        with pytest.raises(Exception, match="members differ"):
            blend.member_mean(spark.createDataFrame(rows + odd, kinds), "member", ["id"], ["x", "y"], 3).select("x").collect()


def test_area_percentiles(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 4), int(r), int(i), 3, 3 + int(n)) for i in range(30) for r, n in enumerate(rng.integers(1, 9, 3))]
    got = masks.area_percentiles(spark.createDataFrame(rows, "image long, row long, inst long, x0 long, x1 long"), [0.1, 0.5, 0.9]).first()
    areas = [sum(r[4] - r[3] for r in rows if r[2] == i) for i in range(30)]
    assert got.n == 30 and np.allclose([got.p10, got.p50, got.p90], np.percentile(areas, [10, 50, 90]))
    none = masks.area_percentiles(spark.createDataFrame([], "image long, row long, inst long, x0 long, x1 long"), [0.5]).first()
    assert none.n == 0 and none.p50 is None


def test_estimates_are_held_against_one_truth(spark):
    rng = random.Random(7)
    truth = [(g, p, p % 3, rng.uniform(1, 5)) for g in "abc" for p in range(8)]
    estimates = [(e, g, p, d, f * rng.uniform(0.5, 1.5)) for e in ("one", "two") for g, p, d, f in truth if (e, p) != ("two", 5)]
    edges = [(link, p) for p in range(8) for link in range(4) if (p + link) % 3]
    families = {"a": "f", "b": "f", "c": "g"}
    got = balance.compare_estimates(
        spark.createDataFrame(estimates, "estimator string, panel string, path long, dest long, f double"),
        spark.createDataFrame(truth, "panel string, path long, dest long, f double"),
        spark.createDataFrame(edges, "link long, path long"),
        spark.createDataFrame(list(families.items()), "panel string, family string"),
    ).collect()

    def agreement(e, t, group):
        keys = {g for k in t for g in group(k)}
        total = lambda x, key: sum(v for k, v in x.items() if key in group(k))
        return max(0, 1 - sum(abs(total(e, k) - total(t, k)) for k in keys) / sum(total(t, k) for k in keys))

    scores = {}
    for name in ("one", "two"):
        for g in "abc":
            t = {(p, d): f for q, p, d, f in truth if q == g}
            e = {(p, d): f for n, q, p, d, f in estimates if (n, q) == (name, g)}
            parts = [agreement(e, t, f) for f in (lambda k: [k], lambda k: [x for x, p in edges if p == k[0]], lambda k: [k[1]])]
            scores[name, g] = 0.35 * parts[0] + 0.35 * parts[1] + 0.15 * math.exp(-abs(sum(e.values()) / sum(t.values()) - 1)) + 0.15 * parts[2]
    assert len(got) == 4
    for r in got:
        mean = {f: np.mean([s for (n, g), s in scores.items() if n == r.estimator and families[g] == f]) for f in "fg"}
        assert r.n_panels == (2 if r.family == "f" else 1) and near(r.score, mean[r.family]) and near(r.overall, (mean["f"] + mean["g"]) / 2)


def test_projections_of_the_query_meet_the_totals(spark):
    from panelworks.plans import QUERIES

    rows = QUERIES["projected_estimators"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.estimator, r.family) for r in rows} == {(e, f) for e in ("prior", "scaled", "l2", "kl", "chi2", "blend") for f in ("urgent", "other")}
    for r in rows:
        assert (r.s_link == 1.0) == (r.estimator in {"l2", "kl", "chi2", "blend"}) and r.score <= 1
        assert r.estimator != "scaled" or r.s_total == 1.0
