"""Operators that SQL does not say, against closed forms and brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from panelworks.operators import balance, decode, evals, score, smooth


def test_total_variation_of_two_points():
    y = np.array([[0.0, 10.0], [0.0, 1.0], [3.0, -1.0]])
    got = smooth.total_variation(y, np.array([2.0, 2.0, 0.5]))
    assert np.allclose(got, [[2.0, 8.0], [0.5, 0.5], [2.5, -0.5]], atol=1e-6)


def test_total_variation_is_optimal():
    rng = np.random.default_rng(0)
    y, lam = rng.normal(size=(5, 9)), np.full(5, 0.4)
    cost = lambda x: 0.5 * ((x - y) ** 2).sum(1) + lam * np.abs(np.diff(x, axis=1)).sum(1)
    x = smooth.total_variation(y, lam)
    for _ in range(300):
        assert (cost(x) <= cost(x + rng.normal(size=x.shape) * rng.choice([1e-3, 1e-2, 0.1])) + 1e-7).all()


def test_whittaker_solves_its_system():
    y = np.random.default_rng(1).normal(size=(4, 7))
    d = np.diff(np.eye(7), axis=0)
    assert np.allclose(smooth.whittaker(y, np.full(4, 1.5)), np.linalg.solve(np.eye(7) + 1.5 * d.T @ d, y.T).T)


def test_expected_top_is_best_of_all_sets(spark):
    rng = random.Random(4)
    rows = [(w, k, round(rng.random(), 3)) for w in range(12) for k in range(7)]
    got = decode.expected_top(spark.createDataFrame(rows, "w long, link long, p double"), ["w"], "p", ["link"]).collect()
    for w in range(12):
        p = {k: x for a, k, x in rows if a == w}
        value = lambda s: sum(p[k] for k in s) / (len(s) + sum(p.values()) - sum(p[k] for k in s))  # noqa: B023, E731
        best = max(value(s) for n in range(1, 8) for s in itertools.combinations(p, n))
        assert abs(value([r.link for r in got if r.w == w]) - best) < 1e-9


def test_quotas_meet_target_and_capacity(spark):
    rows = [(g, u, (7 * g + 3 * u) % 11, 1.0 + u) for g in range(6) for u in range(5)]
    got = evals.quotas(spark.createDataFrame(rows, "g long, u long, c long, s double"), "g", "u", "c", "s", 20).collect()
    for g in range(6):
        caps = {u: c for a, u, c, _ in rows if a == g}
        own = {r.u: r.quota for r in got if r.g == g}
        assert sum(own.values()) == min(20, sum(caps.values())) and all(0 <= own[u] <= caps[u] for u in caps)


def test_kl_projection_is_multiplicative(spark):
    b = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 5.0)], "path long, b double")
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "link long, path long")
    totals = spark.createDataFrame([(0, 4.0), (1, 6.0)], "link long, c double")
    for kind in ("kl", "l2", "chi2"):
        f = {r.path: r.f for r in balance.project(b, edges, totals, kind).collect()}
        assert abs(f[0] + f[1] - 4) < 1e-6 and abs(f[1] + f[2] - 6) < 1e-6 and abs(f[3] - 5) < 1e-9
        if kind == "kl":
            assert abs(f[1] / 2 - f[0] * f[2] / 3) < 1e-6


def test_bootstrap_of_a_sure_gain(spark):
    rows = [(f"k{i}", "a" if i % 2 else "b", 0.1 + 0.01 * (i % 5)) for i in range(60)]
    r = score.poisson_bootstrap(spark.createDataFrame(rows, "key string, panel string, delta double"), "key", ["panel"], "delta", 50).first()
    assert abs(r.delta - 0.12) < 0.01 and r.p_not_better == 0 and r.better == 60 and r.worse == 0 and 0 < r.se < 0.01


def test_partition_count_does_not_matter(spark):
    from panelworks.plans import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES["active_runs"](spark, "/root/testdata/sf0.001")
        seen.append(sorted(map(tuple, df.select(*[F.col(c).cast("string") for c in df.columns]).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_smoothing_with_anchors():
    rng = np.random.default_rng(2)
    y, left, right, lam, anchor = rng.normal(size=(6, 5)), rng.normal(size=6), rng.normal(size=6), np.full(6, 0.3), np.full(6, 0.2)
    left[0], right[1] = np.nan, np.nan
    zero = lambda a, b: np.where(np.isfinite(a), np.nan_to_num(b - a), 0.0)
    tv = lambda x: 0.5 * ((x - y) ** 2).sum(1) + lam * np.abs(np.diff(x, axis=1)).sum(1) + anchor * (np.abs(zero(left, x[:, 0])) + np.abs(zero(right, x[:, -1])))
    sq = lambda x: ((x - y) ** 2).sum(1) + lam * (np.diff(x, axis=1) ** 2).sum(1) + anchor * (zero(left, x[:, 0]) ** 2 + zero(right, x[:, -1]) ** 2)
    for cost, x in ((tv, smooth.total_variation(y, lam, left, right, anchor)), (sq, smooth.whittaker(y, lam, left, right, anchor))):
        for _ in range(300):
            assert (cost(x) <= cost(x + rng.normal(size=x.shape) * rng.choice([1e-3, 1e-2, 0.1])) + 1e-7).all()


def test_kl_projection_has_the_form_of_the_optimum(spark):
    from panelworks.plans.flows import _projected

    b, edges, totals = _projected(spark, "/root/testdata/sf0.001")
    rows = {r.path: (r.b, r.f) for r in b.join(balance.project(b, edges, totals, "kl"), "path").collect()}
    own, links = {}, sorted({r.link for r in edges.collect()})
    for r in edges.collect():
        own.setdefault(r.path, set()).add(r.link)
    paths = sorted(rows)
    a = np.array([[float(k in own[p]) for k in links] for p in paths])
    t = np.log([rows[p][1] / rows[p][0] for p in paths])
    assert np.allclose(a @ np.linalg.lstsq(a, t, rcond=None)[0], t, atol=1e-6)  # a sum of the links' duals
    want = {r.link: r.c for r in totals.collect()}
    assert np.allclose(a.T @ [rows[p][1] for p in paths], [want[k] for k in links], rtol=1e-6)


def test_text_normalisation(spark):
    import re
    import unicodedata

    from panelworks.functions.columns import normalise_text

    texts = ["Ünï ﬁne ½ ǅ … ＡＢＣ", "Ναί Ελληνικά", "Йод съёмка", "İstanbul ğüşiöç", "e\u0301clair \t nä\nh", " ß ", "", "plain ASCII  text", "ﾊﾞ Ⅻ №"]
    got = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(normalise_text(F.col("t")).alias("n")).collect()]
    want = [re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()) for t in texts]
    assert got == want


HOUSE = [
    *[("roof", "mention", x) for x in (r"\broof\w*", r"\bdach\w*", r"\btejado\b", r"\btoit\w*")],
    *[("window", "mention", x) for x in (r"\bwindow\w*", r"\bfenster\w*", r"\bventana\w*", r"\bfenetre\w*")],
    *[("mould", "sure", x) for x in (r"\bmou?ld\w*", r"\bschimmel\w*", r"\bmoho\b", r"\bmoisissure\w*")],
    ("boiler", "mention", r"\bboiler\w*"), ("boiler", "cue", r"\bcold\b"), ("boiler", "sure", r"\bboiler explosion\b"),
    *[(None, "cue", x) for x in (r"\bleak\w*", r"\bbroken\b", r"\bundicht\w*", r"\broto\b", r"\bcassee?\b")],
    *[(None, "negation", x) for x in (r"\bno\b", r"\bnot\b", r"\bkein\w*", r"\bnicht\b", r"\bsin\b", r"\bsans\b")],
    (None, "cue", None),
]


def test_lexicon_tables_in_several_languages(spark):
    from panelworks.operators import labels

    texts = [
        "Tejado roto. Ventana sin moho",
        "Das Dach ist nicht undicht; Fenster undicht, kein Schimmel.",
        "The roof leaks badly.\nNo mold. Boiler is broken",
        "Fenêtre cassée - moisissures. Le toit est mentionné",
        "The boiler is cold. Not a boiler explosion",
        None,
    ]
    lexicon = labels.read_lexicon(spark.createDataFrame(HOUSE, labels.LEXICON))
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in labels.label_texts(docs, "k", "t", lexicon).collect():
        got.setdefault(r.k, {})[r.finding] = r.state
    assert got[0] == {"roof": 1, "window": -1, "mould": -1, "boiler": 0}
    assert got[1] == {"roof": -1, "window": -1, "mould": -1, "boiler": 0}
    assert got[2] == {"roof": 1, "window": 0, "mould": -1, "boiler": 0}  # the boiler has a cue of its own
    assert got[3] == {"roof": 0, "window": 1, "mould": 1, "boiler": 0}
    assert got[4]["boiler"] == 1 and set(got[5].values()) == {0}


def test_lexicons_that_are_refused(spark):
    import pytest

    from panelworks.operators import labels

    for rows in ([("a", "guess", "x"), (None, "negation", "y")], [("a", "sure", "x")], [("a", "sure", f"x{k}") for k in range(labels.MOST_PATTERNS + 1)]):
        with pytest.raises(ValueError):
            labels.read_lexicon(spark.createDataFrame(rows, labels.LEXICON))


def test_total_variation_of_long_and_odd_runs():
    """The subgradient condition, which only the minimiser meets; ties, no smoothing, one value, anchors on data."""
    rng = np.random.default_rng(9)
    for n, lam, anchor in itertools.product((1, 2, 50, 400), (0.0, 0.3, 5.0), (0.0, 0.7)):
        y = np.round(rng.normal(size=(4, n)), 1)
        left, right = np.array([0.5, np.nan, y[2, 0], -2.0]), np.array([np.nan, 0.1, y[2, -1], 3.0])
        x = smooth.total_variation(y, np.full(4, lam), left, right, np.full(4, anchor))
        for row in range(4):
            ends = [anchor if np.isfinite(e[row]) else 0.0 for e in (left, right)]
            v = np.concatenate([[np.nan_to_num(left[row])], x[row], [np.nan_to_num(right[row])]])
            bound = np.array([ends[0], *[lam] * (n - 1), ends[1]])
            low, high = np.where(np.diff(v) > 1e-9, bound, -bound), np.where(np.diff(v) < -1e-9, -bound, bound)
            # the dual z_{i+1} = z_i + x_i - y_i must stay within low and high: the range of z_0 for which it does
            passed = np.concatenate([[0.0], np.cumsum(x[row] - y[row])])
            assert np.max(low - passed) <= np.min(high - passed) + 1e-7


def test_negated_pathology_and_later_mentions(spark):
    from panelworks.operators import labels

    lexicon = labels.read_lexicon(spark.createDataFrame([("band", "mention", r"\bband\b"), (None, "negation", r"\bno\b"), (None, "cue", r"\btear\b")], labels.LEXICON))
    far = "x" * 90
    texts = [f"band {far[:50]} no tear", f"band {far} tear", f"band {far} band tear", "no band tear", f"band {far[:60]} no x", f"tear band {far[:40]} no"]
    got = [r.state for r in labels.label_texts(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", lexicon).orderBy("k").collect()]
    assert got == [-1, 0, 1, -1, -1, -1]


def test_polygons_against_a_raster(spark):
    """Every cell's centre by the even-odd rule: concave, crossing and nested rings, degenerate and null ones."""
    from panelworks.operators import raster

    rng = random.Random(3)
    rings = [(k, [(rng.randint(0, 24) / 2, rng.randint(0, 24) / 2) for _ in range(rng.randint(3, 9))]) for k in range(30)]
    rings += [(50, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]), (50, [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]), (60, [(1.0, 1.0), (5.0, 5.0)]), (61, None), (62, [(1.0, 3.0)] * 4)]
    df = spark.createDataFrame(rings, "k int, points array<struct<x:double,y:double>>")
    got = {(r.k, r.row, x) for r in raster.polygon_runs(df, ["k"], "points").collect() for x in range(r.x0, r.x1)}
    want = set()
    for key in {k for k, _ in rings}:
        edges = [(a, b) for k, p in rings if k == key and p and len(p) > 2 for a, b in zip(p, [*p[1:], p[0]])]
        for row, x in itertools.product(range(-1, 14), range(-1, 14)):
            cy, cx = row + 0.5, x + 0.5
            crossed = [a[0] + (cy - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges if min(a[1], b[1]) <= cy < max(a[1], b[1])]
            if sum(c <= cx for c in crossed) % 2:
                want.add((key, row, x))
    assert got == want and any(k == 50 for k, _, _ in got) and (50, 3, 3) not in got


def test_run_arithmetic_against_cells(spark):
    from panelworks.operators import raster

    rng = random.Random(5)
    make = lambda n: [(rng.randrange(3), rng.randrange(4), x, x + rng.randint(1, 6)) for x in (rng.randrange(20) for _ in range(n))]
    a, b = make(40), make(25)
    cells = lambda rows: {(i, r, x) for i, r, lo, hi in rows for x in range(lo, hi)}
    da, db = (spark.createDataFrame(x, "image int, row int, x0 int, x1 int") for x in (a, b))
    keys = ["image", "row"]
    out = lambda df: cells(tuple(r) for r in df.select(*keys, "x0", "x1").collect())
    merged = raster.merged_runs(da, keys)
    assert out(merged) == cells(a) and merged.count() == len({(i, r, x) for i, r, x in cells(a) if (i, r, x - 1) not in cells(a)})
    assert out(raster.runs_without(merged, db, keys)) == cells(a) - cells(b)
    assert out(raster.common_runs(merged, raster.merged_runs(db, keys), keys)) == cells(a) & cells(b)
    assert out(raster.runs_without(merged, db.limit(0), keys)) == cells(a) and raster.runs_without(merged.limit(0), db, keys).count() == 0
    edge = out(raster.edge_runs(da, ["image"]))
    assert edge == {(i, r, x) for i, r, x in cells(a) if not {(i, r - 1, x), (i, r + 1, x), (i, r, x - 1), (i, r, x + 1)} <= cells(a)}
