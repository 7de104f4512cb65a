"""Neighbours, quotas, lanes, resampling, policies and the live learner against brute force, with hot keys."""

import json
import logging
import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoledger.operators import calibration as C
from chronoledger.operators import history as H
from chronoledger.operators import models as M
from chronoledger.operators import neighbours as N
from chronoledger.operators import resampling as R
from chronoledger.operators import selection as S
from chronoledger.operators.quantiles import group_quantiles
from chronoledger.storage import partitions, scratch_path, shared_dir
from chronoledger.streaming import feedback as B
from chronoledger.streaming.learner import Learner

DIMS = [f"x{i}" for i in range(12)]


@pytest.fixture(scope="module")
def points():
    """One context that holds nearly all rows, in clusters that drift with time; ties, nulls and a small context."""
    rng = np.random.default_rng(4)
    n = 2600
    centres = rng.normal(0, 2, (9, 12))
    x = np.stack([centres[(i * 7 // n + rng.integers(3)) % 9] + rng.normal(0, 0.3, 12) for i in range(n)]).round(3)
    x[40:60] = x[39]
    rows = [("hot", i // 2, i, *map(float, x[i])) for i in range(n)] + [("few", i, n + i, *map(float, x[i])) for i in range(5)] + [("few", 9, n + 9, None, *map(float, x[9][1:]))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "c string, t long, id long, " + ", ".join(f"{d} double" for d in DIMS))


def brute(rows, k, may):
    out = {}
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    v = np.array([[0.0 if a is None else a for a in r[3:]] for r in order])
    for i, r in enumerate(order):
        js = [j for j, o in enumerate(order) if o[0] == r[0] and may(i, j, r, o)]
        total = np.zeros(len(js))
        for d in range(12):
            total += (v[js, d] - v[i, d]) ** 2
        gap = np.sqrt(total / 12).round(9)
        out[r[2]] = [(order[js[a]][2], gap[a]) for a in np.lexsort((js, gap))[:k]]
    return out


def as_lists(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.id, {})[r["rank"]] = (r.n_id, r.distance)
    return {i: [x[k] for k in sorted(x)] for i, x in out.items()}


def test_neighbours_of_a_hot_context(spark, points, caplog):
    caplog.set_level(logging.INFO, "chronoledger")
    got = as_lists(N.nearest_before(frame(spark, points), ["c"], ["t", "id"], DIMS, 7, ["id"], ["id"], block=64))
    want = {i: x for i, x in brute(points, 7, lambda i, j, r, o: j < i).items() if x}
    assert got == want
    met, every = map(int, re.search(r"(\d+) of (\d+) pairs", caplog.text).groups())
    assert met < 0.75 * every


def test_neighbours_of_other_folds_and_of_some(spark, points):
    rows = points[:700] + points[-6:]
    df = frame(spark, rows)
    got = as_lists(N.nearest_before(df, ["c"], ["t", "id"], DIMS, 5, ["id"], ["id"], block=64, apart=F.col("id") % 3))
    assert got == {i: x for i, x in brute(rows, 5, lambda i, j, r, o: r[2] % 3 != o[2] % 3).items() if x}
    got = as_lists(N.nearest_before(df, ["c"], ["t", "id"], DIMS, 5, ["id"], ["id"], block=64, asked=F.col("id") % 4 == 0, among=F.col("id") % 2 == 1))
    assert got == {i: x for i, x in brute(rows, 5, lambda i, j, r, o: j < i and o[2] % 2 == 1).items() if x and i % 4 == 0}


def test_nearest_outcomes_are_complete_before_the_decision(spark):
    rows = [("k", i, i + 3, i, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t long, done long, id long, v double")
    got = as_lists(N.nearest_asof(df, df, ["k"], "t", "done", "id", ["v"], 3, "id", ["id"]))
    for r in rows:
        want = sorted((round(abs(o[4] - r[4]), 9), o[2], o[3]) for o in rows if o[2] < r[1])[:3]
        assert got.get(r[3], []) == [(o, d) for d, _, o in want]


def test_quantiles_and_scales(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 10 else "b", float(v) if i % 7 else None) for i, v in enumerate(rng.normal(0, 5, 2000))] + [("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.a, r.b) for r in group_quantiles(df, ["k"], "v", a=0.5, b=0.95).collect()}
    for k in ("hot", "b", None):
        x = [v for key, v in rows if key == k and v is not None]
        assert got[k][0] == len(x) and np.allclose(got[k][1:], np.quantile(x, (0.5, 0.95)))
    assert "none" not in got
    s = [r.s for r in N.scaled(df.where("k <> 'none'"), {"s": F.col("v")}, F.col("k") == "hot").orderBy("k", "v").collect()]
    x = np.array([v for k, v in rows if k == "hot"], float)
    mid = np.nanmedian(x)
    lo, hi = np.quantile(np.where(np.isnan(x), mid, x), (0.25, 0.75))
    want = sorted(((k, -math.inf if v is None else v) for k, v in rows if k not in ("none", None)))
    assert np.allclose(s, [0 if v == -math.inf else np.clip((v - mid) / (hi - lo), -12, 12) for _, v in want], atol=1e-8)


def test_running_sums(spark):
    rows = [("hot" if i % 9 else "b", i % 50, i, i % 11) for i in range(3000)]
    got = {r.id: r.total for r in H.running_sums(spark.createDataFrame(rows, "k string, t long, id long, x long"), ["k"], ["t", "id"], total=F.col("x")).collect()}
    for key in ("hot", "b"):
        total = 0
        for _, _, i, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            total += x
            assert got[i] == total


def test_corrections_without_the_own_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w" if i % 8 else "v", f"p{i % 3}", float(x)) for i, x in enumerate(rng.normal(0, 1, 900))]
    df = spark.createDataFrame(rows, "id long, w string, p string, r double")
    scopes = [C.Scope("P", F.concat_ws("|", "w", "p"), 30, "W"), C.Scope("W", F.col("w"), 40, "A"), C.Scope("A", F.lit("all"), 1, "A")]
    got = {r.id: r for r in C.fold_external(df, scopes, F.col("r"), ["id"], F.col("id") % 4, 4, 0.9, "id", window=100).collect()}
    keys = {"P": lambda r: r[1:3], "W": lambda r: r[1], "A": lambda r: 0}
    for r in rows[::17]:
        def told(s):
            x = [o[3] for o in rows if o[0] % 4 != r[0] % 4 and keys[s](o) == keys[s](r)]
            last = sorted(x[-100:])
            n = len(last)
            if not n:
                return 0, None, 0.0
            high = last[math.ceil(min(1, math.ceil((n + 1) * 0.9) / n) * (n - 1))]
            trust = len(x) / (len(x) + 16) / (1 + max(np.quantile(last, 0.95) - np.quantile(last, 0.5), 0))
            return len(x), high, trust

        scope = next(s.name for s in scopes if told(s.name)[0] >= s.least)
        n, high, trust = told(scope)
        parent = told({"P": "W", "W": "A", "A": "A"}[scope])[1]
        me = got[r[0]]
        assert (me.scope, me.support) == (scope, n) and math.isclose(me.correction, max(trust * high + (1 - trust) * parent, 0), abs_tol=1e-9)


def quotas(sizes, count):
    """Dealt one by one, as one would by hand."""
    out = {k: 0 for k in sizes}
    if count >= len(sizes) and count:
        out = {k: int(n > 0) for k, n in sizes.items()}
    left, room = count - sum(out.values()), {k: n - out[k] for k, n in sizes.items()}
    total = sum(room.values())
    for k in sizes:
        out[k] += left * room[k] // max(total, 1)
    rest = count - sum(out.values())
    for k in sorted(sizes, key=lambda k: (-(left * room[k] % max(total, 1)), k))[:rest]:
        out[k] += 1
    return out


@pytest.mark.parametrize("count", [0, 1, 2, 7, 50, 333, 1011])
def test_quotas(spark, count):
    sizes = {"a": 900, "b": 0, "c": 1, "d": 10, "e": 100}
    df = spark.createDataFrame([(k, n, count) for k, n in sizes.items()], "k string, n long, c long")
    got = {r.k: r.quota for r in S.proportional_quotas(df, [], ["k"], "n", "c").collect()}
    assert got == quotas(sizes, count) and sum(got.values()) == count and all(got[k] <= sizes[k] for k in got)
    with pytest.raises(Exception, match="more is to be dealt"):
        S.proportional_quotas(df.withColumn("c", F.lit(2000).cast("long")), [], ["k"], "n", "c").collect()


def test_lanes_of_a_hot_workflow(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "hot" if i % 20 else "w", f"p{i % 5}", *map(float, rng.integers(0, 40, 3))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, w string, p string, a double, b double, c double")
    split = {"a": 0.5, "b": 0.2, "c": 0.3}
    got = {r.id: r for r in S.lanes(df, "id", "w", "p", {k: k for k in split}, split, F.lit(300)).collect()}
    assert len(got) == 1500 and sum(r.lane != "not_selected" for r in got.values()) == 300
    assert math.isclose(sum(r.inclusion for r in got.values()), 300) and all(r.inclusion > 0 for r in got.values())
    sizes = {w: sum(r[1] == w for r in rows) for w in ("hot", "w")}
    for w, q in quotas(sizes, 300).items():
        left = [r for r in rows if r[1] == w]
        for j, lane in enumerate(split, 3):
            n = math.floor(split[lane] * q) if lane != "c" else math.floor(0.5 * (q - math.floor(0.5 * q) - math.floor(0.2 * q)))
            best = sorted(left, key=lambda r: (-r[j], r[0]))[:n]
            assert {r[0] for r in best} == {i for i, r in got.items() if r.w == w and r.lane == lane}
            left = [r for r in left if r not in best]
    few = S.lanes(df, "id", "w", "p", {k: k for k in split}, split, F.lit(8)).where("w = 'hot' and lane in ('process_exploration', 'not_selected')")
    assert few.select("inclusion").distinct().count() == 1  # fewer draws than processes: one pool


def test_average_ranks(spark):
    rows = [("hot", i, float(i * 7 % 13)) for i in range(500)]
    got = {r.i: r.share for r in S.average_ranks(spark.createDataFrame(rows, "k string, i long, v double"), ["k"], "v", "i").collect()}
    for _, i, v in rows[::25]:
        assert math.isclose(got[i], (sum(r[2] < v for r in rows) + (sum(r[2] == v for r in rows) + 1) / 2) / 500)


@pytest.mark.parametrize("target, retry", [(0.9, 1.5), (0.5, 30.0), (0.2, 0.1)])
def test_every_factor_is_tried(spark, target, retry):
    rng = np.random.default_rng(7)
    rows = [("hot", i, 100, int(x)) for i, x in enumerate(rng.integers(1, 400, 800))]
    r = S.best_factors(spark.createDataFrame(rows, "k string, i long, b long, n long"), ["k"], "i", "b", "n", target, retry).first()
    tried = []
    for f in {x[3] / 100 for x in rows}:
        cover = sum(x[3] / 100 <= f for x in rows) / 800
        cost = f * 80000 + retry * sum(x[3] for x in rows if x[3] / 100 > f)
        tried.append((0 if cover >= target else 1, cost if cover >= target else -cover, f, cover, cost))
    best = min(tried)
    assert math.isclose(r.factor, best[2]) and math.isclose(r.coverage, best[3]) and math.isclose(r.cost, best[4])


def test_bootstrap(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 100)
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 6 else "b", f"u{i % 90}", float(x)) for i, x in enumerate(rng.normal(0, 9, 1200))]
    df = spark.createDataFrame(rows, "k string, u string, v double")
    import hashlib

    unit = {u: int(hashlib.sha256(u.encode()).hexdigest()[:8], 16) for u in {r[1] for r in rows}}
    names = sorted(unit)
    k = dict(zip(names, R.draws(np.array([unit[u] for u in names]), np.arange(200), 3)))
    all_draws = np.array(list(k.values()))
    assert abs(all_draws.mean() - 1) < 0.05 and abs(all_draws.var() - 1) < 0.1
    sums = {(r.k, r.rep): r.v for r in R.bootstrap_sums(df, ["k"], "u", ["v"], 200, 3).collect()}
    marks = {(r.k, r.rep): (r.a, r.b) for r in R.bootstrap_quantiles(df, ["k"], "u", "v", 200, 3, a=0.5, b=0.9).collect()}
    for key in ("hot", "b"):
        for rep in range(0, 200, 13):
            x = [v for g, u, v in rows if g == key for _ in range(k[u][rep])]
            assert math.isclose(sums[key, rep], sum(x), abs_tol=1e-6) and np.allclose(marks[key, rep], np.quantile(x, (0.5, 0.9)))


def outcomes(n):
    return [(i, "w" if i % 3 else "v", f"p{i % 2}", i * 10, 100 + (i * 37) % 50) for i in range(n)]


SCHEMA = "id long, w string, p string, done long, peak long"


def test_live_learner(spark, tmp_path):
    rows, root, source, at = outcomes(120), str(tmp_path / "root"), str(tmp_path / "in"), str(tmp_path / "at")
    views = {"A": lambda: M.GroupQuantiles(["w"], "peak", least=5), "F": lambda: M.QuantileForest(["done"], ["w"], "peak", (0.5, 0.995), trees=2, depth=2)}
    live = Learner(root, views, "id", "peak", ["peak"], ["done", "id"], ["q50", "q99_5"], first=20, every=30, window=10)
    for lo in range(0, 120, 30):
        spark.createDataFrame(rows[lo : lo + 30], SCHEMA).write.mode("append").parquet(source)
        live.learn(spark.readStream.schema(SCHEMA).parquet(source), at).awaitTermination()
    assert live.pointer(spark) == (4, 120)
    scored = {(r.id, r.view): (r.version, r.request) for r in spark.read.parquet(f"{root}/scored").collect()}
    assert len(scored) == 240 and all(v == i // 30 and (q is None) == (v == 0) for (i, _), (v, q) in scored.items())
    for version in range(1, 5):
        seen = rows[: 30 * version]
        held = {(r.id, r.view): r for r in live.calibration(spark, version).collect()}
        assert {i for i, _ in held} == {r[0] for r in seen[-10:]}
        for r in seen[-10:]:
            fit = [o[4] for o in seen[:-10] if o[1] == r[1]]
            fit = fit if len(fit) >= 5 else [o[4] for o in seen[:-10]]
            want = max(np.quantile(fit, 0.5), np.quantile(fit, 0.995))
            assert math.isclose(held[r[0], "A"].request, want) and math.isclose(held[r[0], "A"].residual, math.log(r[4] / want))
            assert held[r[0], "F"].request > 0
    # a batch that is run again changes nothing
    live.step(spark.createDataFrame(rows[90:], SCHEMA), 3)
    assert live.pointer(spark) == (4, 120) and {(r.id, r.view): (r.version, r.request) for r in spark.read.parquet(f"{root}/scored").collect()} == scored
    # a calibration of another version is not used
    live.calibration(spark, 3).write.mode("overwrite").parquet(f"{root}/versions/version=4/calibration")
    with pytest.raises(ValueError, match="belongs to another"):
        live.score(spark, spark.createDataFrame(rows[:3], SCHEMA), 4)


def test_changed_outcomes_can_stop_the_stream(spark, tmp_path):
    source, table, at = tmp_path / "in", scratch_path(spark, "applied"), str(tmp_path / "at")
    source.mkdir()

    def put(name, *rows):
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        B.ingest(spark, str(source), table, at, strict=True).awaitTermination()

    row = {"task_id": "a", "workflow": "w", "process": "p", "exit_status": 0, "completion_us": 5, "peak_bytes": 10, "consumed_bytes": 3}
    put("1.json", row)
    put("2.json", row, row | {"task_id": "b"})
    with pytest.raises(Exception, match="has changed"):
        put("3.json", row | {"task_id": "c"}, row | {"peak_bytes": 11})
    (source / "3.json").write_text(json.dumps(row | {"task_id": "c"}) + "\n")  # mended: the same batch is run again
    B.ingest(spark, str(source), table, at, strict=True).awaitTermination()
    assert {(r.task_id, r.seq, r.status) for r in B.applied(spark, table).collect()} == {("a", 1, "applied"), ("b", 2, "applied"), ("c", 3, "applied")}


def test_equal_vectors_do_not_meet_every_block(spark, caplog):
    """Of a value's copies only the first k are candidates, however many there are; runs of asking rows are cut anywhere."""
    caplog.set_level(logging.INFO, "chronoledger")
    n, k = 6000, 4
    rows = [("c", i, i, float(i * 7 % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "c string, t long, id long, v double")
    run, N.RUN = N.RUN, 900
    try:
        got = as_lists(N.nearest_before(df, ["c"], ["t", "id"], ["v"], k, ["id"], ["id"], block=64))
    finally:
        N.RUN = run
    for r in rows[:60] + rows[-60:]:
        want = sorted((abs(o[3] - r[3]), o[1], o[2]) for o in rows[: min(r[1], 40)])[:k]
        assert got.get(r[2], []) == [(o, d) for d, _, o in want]
    met, _ = map(int, re.search(r"(\d+) of (\d+) pairs", caplog.text).groups())
    assert met <= 10


def test_a_run_lets_go_of_rows_and_of_far_values(spark, points, monkeypatch):
    """Small runs, values beyond single precision, and lists row by row."""
    rows = [(c, t, i, *[None if v is None else v * (1e20 if c == "few" else 1.0) for v in x]) for c, t, i, *x in points[:300] + points[-6:]]
    want = {i: x for i, x in brute(rows, 5, lambda i, j, r, o: j < i).items() if x}
    for name, value in (("RUN", 100), ("ROWS", 16), ("COLUMNS", 32)):
        monkeypatch.setattr(N, name, value)
    lists = N.nearest_lists(frame(spark, rows), ["c"], ["t", "id"], DIMS, 5, ["id"], ["id"], block=64).collect()
    assert {r.id: [(x.n_id, x.distance) for x in r.near] for r in lists} == want


def test_quantiles_of_long_and_short_scopes(spark, monkeypatch):
    """The same quantiles whether a scope is one group, its asks lie in several, or it is cut into blocks; short ones take one group each."""
    rng = np.random.default_rng(6)
    rows = [("long" if i % 4 else f"s{i % 5}", int(rng.integers(400)), i, float(rng.integers(60)) if i % 6 else None, float(rng.normal())) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double, w double")
    asked = {"a": ("v", 0.5), "b": ("v", 0.95), "c": ("w", 0.5)}
    ask = df.select("k", (F.col("t") + 1).alias("at"), F.col("id").alias("ask"))
    told = {}
    for width in (64, 4096):
        monkeypatch.setattr(H, "WIDTH", width)
        told[width] = {r.ask: (r.support, r.a, r.b, r.c) for r in H.asof_quantiles(ask, df, ["k"], "at", "t", "id", ["ask"], **asked).collect()}
    assert told[64] == told[4096] and len(told[64]) == len(rows)
    for r in rows[::40]:
        seen = [o for o in rows if o[0] == r[0] and o[1] <= r[1] and o[3] is not None]
        rank = lambda j, q: sorted(o[j] for o in seen)[max(1, int(np.ceil(q * len(seen)))) - 1] if seen else None
        assert told[64][r[2]] == (len(seen), rank(3, 0.5), rank(3, 0.95), rank(4, 0.5))
    ranks = rng.permutation(5000)
    n = rng.integers(1, 5001, 300)
    k = rng.integers(1, n + 1)
    assert H.kth_of_first(ranks, n, k).tolist() == [int(np.sort(ranks[:a])[b - 1]) for a, b in zip(n, k)]


def test_earlier_quantiles_are_those_before_each(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if i % 5 else None, i // 2, i, float(rng.normal()) if i % 6 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double")
    asked = {"a": ("v", 0.5), "b": ("v", 0.95, "higher")}
    want = H.before_each(H.trailing_quantiles(df, ["k"], ["t", "id"], 32, **asked), ["k"], list(asked)).where("id % 3 = 0")
    got = H.earlier_quantiles(df, ["k"], ["t", "id"], 32, F.col("id") % 3 == 0, **asked)
    assert got.count() == 234 and {r.id: (r.support, r.a, r.b) for r in got.collect()} == {r.id: (r.support, r.a, r.b) for r in want.collect()}


def test_repeated_lowest_of_many_blocks(spark, monkeypatch):
    """Draws that end in every bin, in blocks of a few rows, are those of a sort of each repetition."""
    monkeypatch.setattr(R, "RANKS", 16)
    rows = [("a" if i % 9 else "b", i, i * 31 % 97, i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, v long, level int, rank long")
    asks = [(k, d, above, wanted) for k in "ab" for d, (above, wanted) in enumerate([(0, 0), (0, 7), (1, 60), (2, 500), (3, 5)])]
    got = {(r.k, r.rep, r.draw): (r.audited, r.total) for r in R.repeated_lowest(df, ["k"], "id", "v", "level", "rank", spark.createDataFrame(asks, "k string, draw int, above int, wanted long"), 6).collect()}
    assert len(got) == 6 * len(asks)
    for (k, rep, draw), found in got.items():
        above, wanted = next(a[2:] for a in asks if a[:2] == (k, draw))
        some = sorted((int(R.keyed_numbers(rep, [str(r[1]).encode()])[0]), r[1], r[2]) for r in rows if r[0] == k and r[3] >= above)[:wanted]
        assert found == (len(some), sum(x[2] for x in some))


def test_nearest_rows_leave_no_table_of_a_step_that_is_over(spark):
    """Only what the result reads stays in the shared folder, and a block of candidates is one row of it."""
    rng = np.random.default_rng(12)
    rows = [("a", i, i, *map(float, rng.integers(0, 50, len(DIMS)))) for i in range(3000)]
    before = set(Path(shared_dir(spark)).iterdir())
    got = N.nearest_lists(frame(spark, rows), ["c"], ["t", "id"], DIMS, 5, ["id"], ["id"], block=64).collect()
    made = [p for p in Path(shared_dir(spark)).iterdir() if p not in before and any(p.glob("*.parquet"))]
    assert {p.name.split("-")[0] for p in made} <= {"packed", "asks", "runs", "sent", "pairs"} and len(got) == 2999
    packed = spark.read.parquet(*[str(p) for p in made if p.name.startswith("packed")])
    assert packed.select(F.max(F.length("__pack"))).first()[0] > 0 and packed.groupBy("__epoch").agg(F.max("__block").alias("b"), F.count("*").alias("n")).where("n <> b + 1").count() == 0


def test_draws_are_spread_and_as_before(spark):
    """The numbers that a search among the bounds gives, and all cores at work on a table of one partition."""
    units, reps = np.random.default_rng(3).integers(0, 2**32, 500), np.arange(70)
    h = R.mix32(units.astype(np.uint32)[:, None] ^ R.mix32(reps.astype(np.uint32) + np.uint32(5))[None])
    want = np.searchsorted(np.array(R.POISSON, np.uint64), h.ravel().astype(np.uint64), "right").reshape(h.shape)
    assert (R.draws(units, reps, 5) == want).all() and want.max() > 4
    df = spark.range(4000, numPartitions=1).select("id", F.lit(1.0).alias("x"))
    sums = R.bootstrap_sums(df, [], "id", ["x"], 3)
    assert f"RoundRobinPartitioning({partitions(spark)})" in sums._jdf.queryExecution().executedPlan().toString()
    assert {r.rep for r in sums.collect()} == {0, 1, 2}


def test_asks_that_end_in_one_bucket_are_spread(spark, monkeypatch):
    """However many asks have their quantile in the same values, a task takes less than two blocks of them and a bucket of values."""
    monkeypatch.setattr(H, "WIDTH", 64)
    within, width = H._within_buckets, H.WIDTH

    def bounded(value, out):
        run = within(value, out)

        def checked(left, right):
            if left.num_rows >= 2 * width or right.num_rows > width:
                raise RuntimeError(f"{left.num_rows} asks and {right.num_rows} values in one task")
            return run(left, right)

        return checked

    monkeypatch.setattr(H, "_within_buckets", bounded)
    rows = [("k", 2 * i, i, float(i * 7919 % 1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double")
    ask = df.select("k", (F.col("t") + 1).alias("at"), F.col("id").alias("ask")).union(df.select("k", (F.col("t") + 1).alias("at"), F.col("id") + 1000))
    got = {r.ask: (r.support, r.a) for r in H.asof_quantiles(ask, df, ["k"], "at", "t", "id", ["ask"], a=("v", 0.5)).collect()}
    assert len(got) == 2000
    for i in range(1000):
        want = i + 1, sorted(r[3] for r in rows[: i + 1])[(i + 2) // 2 - 1]
        assert got[i] == got[i + 1000] == want


def test_a_summary_of_scopes_sorts_once_and_leaves_no_step(spark):
    """Counts, quantiles and the last outcome come from one sequence; only what the result reads stays in the shared folder."""
    from chronoledger.plans import catalog

    before = set(Path(shared_dir(spark)).iterdir())
    found = catalog.queries()["hs09_scope_summary"](spark, "/root/testdata/sf0.001")
    left = sorted(p.name.split("-")[0] for p in Path(shared_dir(spark)).iterdir() if p not in before and any(p.glob("*.parquet")))
    assert left == ["places", "told", "told"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0


def test_parts_of_outcomes(spark):
    """An outcome without a time never completed; each part counts its own."""
    rows = [(i, float(i) if i % 3 else None, float(-i), None if i == 5 else i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v double, w double, t long").withColumn("k", F.lit(None).cast("string"))
    ask = spark.range(45).select(F.col("id").alias("at"), F.lit(None).cast("string").alias("k"), F.col("id").alias("ask"))
    got = {r.ask: r for r in H.asof_parts(ask, df, ["k"], "at", "t", "id", ["ask"], {"all": {"low": ("w", 0.5)}, "some": {"mid": ("v", 0.5)}}, {"odd": F.col("id") % 2 == 1}, "latest").collect()}
    assert len(got) == 45
    for i, r in got.items():
        seen = [o for o in rows if o[3] is not None and o[3] < i]
        some, every = sorted(o[1] for o in seen if o[1] is not None), sorted(o[2] for o in seen)
        rank = lambda x: x[max(1, math.ceil(len(x) / 2)) - 1] if x else None
        assert (r["all"], r["some"], r.odd, r.latest, r.low, r.mid) == (len(every), len(some), sum(o[0] % 2 for o in seen), max((o[3] for o in seen), default=None), rank(every), rank(some))


@pytest.mark.parametrize("apart", [True, False])
def test_a_row_meets_only_leaves_that_lie_near(monkeypatch, apart):
    """Of values that are spread evenly a row is compared with few, though the boxes of whole blocks and runs touch; ties, far values, best k exact."""
    import pyarrow as pa

    for name, value in (("ROWS", 64), ("COLUMNS", 32), ("LEAVES", 3)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(13)
    n, k, dims = 6000, 5, 4
    x = rng.integers(0, 40, (n, dims)) / 8.0
    x[-3:] *= 1e20
    side = rng.permutation(n) % (3 if apart else n)
    ids = pa.array([{"n_id": i} for i in range(n)])
    run = N._Run(k, apart, pa.schema([("__a", ids.type), ("__near", pa.list_(ids.type)), ("__gaps", pa.list_(pa.float64()))]))
    asks = np.concatenate((rng.choice(n - 3, 400, replace=False), [n - 1]))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(asks) + 1) * dims, pa.int32()), pa.array(x[asks].ravel()))
    run.asks = [pa.RecordBatch.from_arrays([pa.array(side[asks]), pa.array(side[asks]), vectors, ids.take(pa.array(asks)), pa.array(np.full(len(asks), None), pa.float64())], ["place", "__side", "__v", "__a", "__reach"])]
    pairs, compare = [], run._compare
    monkeypatch.setattr(run, "_compare", lambda part, rows, right, *rest: (pairs.append(len(rows) * right.shape[1]), compare(part, rows, right, *rest)))
    place = np.arange(n) if apart else side
    packs = []
    for lo in range(0, n, 1500):
        cut = slice(lo, lo + 1500)
        table = pa.table({"place": pa.array(place[cut]), "__side": pa.array(side[cut]), N._ROW: ids[lo : lo + 1500], **{f"v{i}": pa.array(x[cut, i]) for i in range(dims)}}).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as to:
            to.write_table(table)
        packs.append(sink.getvalue().to_pybytes())
    for pack in packs:
        run.meet(pa.array([pack], pa.binary()))
    got = {a["n_id"]: ([z["n_id"] for z in near], gaps) for b in run.told() for a, near, gaps in zip(*(b[c].to_pylist() for c in ("__a", "__near", "__gaps")))}
    for i in asks.tolist():
        may = np.flatnonzero(side != side[i] if apart else side < side[i])
        gap = np.sqrt(((x[may] - x[i]) ** 2).sum(1) / dims).round(9)
        best = np.lexsort((place[may], gap))[:k]
        assert got.get(i, ([], [])) == (may[best].tolist(), gap[best].tolist())
    assert sum(pairs) < 0.35 * n * len(asks)


def test_runs_take_turns(spark, points, monkeypatch):
    """Where runs meet more blocks than are shuffled at once, each turn's lists are written, and only what is wanted of them."""
    for name, value in (("RUN", 20), ("TURN", 2)):
        monkeypatch.setattr(N, name, value)
    rows = points[:400] + points[-6:]
    before = set(Path(shared_dir(spark)).iterdir())
    found = N.nearest_lists(frame(spark, rows), ["c"], ["t", "id"], DIMS, 5, ["id"], ["id"], block=64, apart=F.col("id") % 3, finish=lambda lists: lists.select("id", F.transform("near", lambda r: r["n_id"]).alias("ids")))
    got = {r.id: r.ids for r in found.collect()}
    want = brute(rows, 5, lambda i, j, r, o: r[2] % 3 != o[2] % 3)
    assert got == {i: [a for a, _ in x] for i, x in want.items() if x}
    lists = [p for p in Path(shared_dir(spark)).iterdir() if p not in before and p.name.startswith("lists-")]
    assert len(lists) > 1 and all(spark.read.parquet(str(p)).columns == ["id", "ids"] for p in lists)


@pytest.mark.parametrize("missed", [False, True])
def test_scales_are_found_without_a_sort_of_all_rows(spark, monkeypatch, missed):
    """Quantiles of columns are those of a sort, also where the sketch says nothing; only distinct values near them are sorted."""
    from chronoledger.operators import quantiles as Q

    rng = np.random.default_rng(14)
    rows = [(float(a), float(i % 3) if i % 5 else None, None, math.nan if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(0, 9, (30000, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    sorted_rows = []

    def write(table, name):
        sorted_rows.append(table.cache().count())
        return table

    if missed:
        monkeypatch.setattr(Q, "STEPS", -3)
    got = Q.column_quantiles(df, list("abcd"), [0.25, 0.5, 0.999], write)
    assert set(got) == set("abd")
    for i, c in enumerate("abcd"):
        x = [r[i] for r in rows if r[i] is not None and not math.isnan(r[i])]
        assert not x or np.allclose(got[c], np.quantile(x, (0.25, 0.5, 0.999)), rtol=1e-12, atol=0)
    assert missed or sum(sorted_rows) < 400


@pytest.mark.parametrize("sigmas", [3.5, 0.01])
def test_few_rows_of_a_draw_are_shuffled(spark, monkeypatch, sigmas):
    """Only rows near where a draw should end leave their block; draws that end elsewhere are made again until all are whole."""
    monkeypatch.setattr(R, "RANKS", 1024)
    monkeypatch.setattr(R, "SIGMAS", sigmas)
    n, reps = 6000, 9
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").cast("string").alias("unit"), (F.col("id") * 31 % 97).alias("v"), (F.col("id") % 2).cast("int").alias("level"), F.col("id").alias("rank"))
    asks = [("a", 0, 0, 1500), ("a", 1, 1, 900), ("a", 2, 0, n), ("a", 3, 0, 0), ("a", 4, 5, 8)]
    before = set(Path(shared_dir(spark)).iterdir())
    got = {(r.rep, r.draw): (r.audited, r.total) for r in R.repeated_lowest(df, ["k"], "unit", "v", "level", "rank", spark.createDataFrame(asks, "k string, draw int, above int, wanted long"), reps).collect()}
    assert len(got) == reps * len(asks)
    for rep in range(reps):
        order = sorted(zip(R.keyed_numbers(rep, [str(i).encode() for i in range(n)]).tolist(), map(str, range(n)), range(n)))
        for _, draw, above, wanted in asks:
            some = [i for _, _, i in order if i % 2 >= above][:wanted]
            assert got[rep, draw] == (len(some), sum(i * 31 % 97 for i in some))
    passes = [p for p in Path(shared_dir(spark)).iterdir() if p not in before and p.name.startswith("ends-")]
    assert len(passes) > 1 if sigmas < 1 else len(passes) < 3
