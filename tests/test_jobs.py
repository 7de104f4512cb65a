"""Operators of several jobs, sources, sinks and streams against small fixtures."""

import gzip
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoledger.operators import history as H
from chronoledger.operators import models as M
from chronoledger.operators import neighbours as N
from chronoledger.operators.graph import components
from chronoledger.plans import catalog
from chronoledger.sources import tables as S
from chronoledger.storage import shared_dir
from chronoledger.streaming import feedback as B

SF = "/root/testdata/sf0.001"


def test_components_equal_union_find(spark):
    rows = [(i, f"a{i // 2}") for i in range(40)] + [(i, f"b{(i + 1) // 2}") for i in range(30)] + [(i, "hot") for i in range(100, 250)] + [(300, None)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for k, t in rows:
        if t is None or t == "hot":
            continue
        a, b = sorted((root(k), root(first.setdefault(t, k))))
        parent[b] = a
    assert found == {k: root(k) for k in parent}


def test_job_queries_cover_their_tables(spark):
    q = catalog.queries()
    assert q["jn16_component_join"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert q["snk04_fingerprint"](spark, SF).first()["n"] == n


@pytest.mark.parametrize("name", ["md03_quantile_forest", "md06_process_tails"])
def test_quantiles_cover(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    actual = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.floor(F.col("value") * 1000000) + 1).collect()}
    assert {r.task_id for r in rows} == set(actual) and len(rows) == len(actual) and all(0 <= r.q50 <= r.q95 <= r.q99 for r in rows)
    share = lambda q: sum(actual[r.task_id] <= r[q] for r in rows) / len(rows)
    assert abs(share("q50") - 0.5) < 0.1 and share("q95") > 0.85
    # Against plain quantiles: with features that tell nothing apart, a forest's quantiles are those of all rows.
    plain = spark.createDataFrame([(i, 1, float(i)) for i in range(2000)], "id long, x long, y double")
    got = M.QuantileForest(["x"], [], "y").fit(plain).predict(plain.limit(1), "id").first()
    assert all(abs(got[c] - q * 2000) < 40 for c, q in (("q50", 0.5), ("q95", 0.95), ("q99", 0.99)))


def test_forest_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 7, f"p{i % 3}", float(i % 50)) for i in range(600)], "id long, x long, p string, y double")
    forest = M.QuantileForest(["x"], ["p"], "y", by=["p"])
    want = sorted(map(tuple, forest.fit(rows).predict(rows, "id").collect()))
    forest.save(str(tmp_path / "f"))
    again = M.QuantileForest(["x"], ["p"], "y", by=["p"]).load(spark, str(tmp_path / "f"))
    assert sorted(map(tuple, again.predict(rows, "id").collect())) == want
    new = spark.createDataFrame([(1, 3, "never seen"), (2, None, None)], "id long, x long, p string")
    assert again.predict(new, "id").where("q95 is not null").count() == 2


def test_ensembles_and_modes(spark, tmp_path):
    """Pinball loss well below that of plain quantiles, missing categories as the most frequent, members kept."""
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 5), ("a", "b", "b")[i % 3], float(10 * (i % 5) + rng.exponential(4 if i % 3 else 9))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, x long, p string, y double")
    both = M.Ensemble(lambda s: M.QuantileForest(["x"], ["p"], "y", (0.5, 0.9), trees=8, depth=5, seed=s))
    got = {r.id: r for r in both.fit(df).predict(df, "id").collect()}
    both.save(str(tmp_path / "e"))
    again = M.Ensemble(both.make).load(spark, str(tmp_path / "e"))
    assert {r.id: (r.q50, r.q90) for r in again.predict(df, "id").collect()} == {i: (r.q50, r.q90) for i, r in got.items()}
    loss = lambda q, name, of: np.mean([max(q * (r[3] - of(r)), (q - 1) * (r[3] - of(r))) for r in rows])
    for q, name in ((0.5, "q50"), (0.9, "q90")):
        plain = np.quantile([r[3] for r in rows], q)
        assert loss(q, name, lambda r, name=name: got[r[0]][name]) < 0.85 * loss(q, name, lambda r, plain=plain: plain) and all(0 <= r.q50 <= r.q90 for r in got.values())
    lost = spark.createDataFrame([(1, 2, None), (2, 2, "b")], "id long, x long, p string")
    assert len({(r.q50, r.q90) for r in both.predict(lost, "id").collect()}) == 1


def test_feature_views():
    parts = {"A": ["size"], "P": ["p50"], "C": ["c50", "c_hat"]}
    assert M.feature_view("A+P+C", parts, ["peak"]) == ["size", "p50", "c50", "c_hat"]
    with pytest.raises(ValueError, match="unknown"):
        M.feature_view("A+X", parts, [])
    with pytest.raises(ValueError, match="peak"):
        M.feature_view("A", {"A": ["peak"]}, ["peak"])


def test_models_over_all_tasks(spark):
    q, n = catalog.queries(), spark.read.parquet(f"{SF}/events.parquet").count()
    derived = q["md07_derived_memory"](spark, SF)
    assert derived.count() == n and derived.where("c_hat < 0 or derived < 0 or derived is null").count() == 0
    cold = q["md17_cold_start"](spark, SF)
    assert cold.count() == n and cold.where("request < floor or request < q95").count() == 0
    gates = q["md20_gate_models"](spark, SF)
    assert gates.count() == n and gates.where("p_under not between 0 and 1 or severity is null").count() == 0
    views = q["md24_three_views"](spark, SF)
    assert views.columns == ["task_id", "c_hat", "A", "AP", "APC"] and views.count() == n // 2 and views.where("least(A, AP, APC) < 1 or c_hat is null").count() == 0
    done = q["st11_batched_replay"](spark, SF)
    assert done.select("batch").distinct().count() == 4 and done.where("request is null").count() == 0


def test_gates_of_one_label_are_constant(spark):
    rows = spark.createDataFrame([(i, i, 0, 1, 0.5) for i in range(20)], "id long, x long, never int, always int, s double")
    got = M.gate_scores(rows, rows, "id", ["x"], ["never", "always"], "s")
    assert {(r.p_never, r.p_always) for r in got.collect()} == {(0.0, 1.0)}


def test_replay_sees_no_label_before_it_decides(spark):
    rows = [(i, i // 100, 1.0, float(10 * (i // 100 + 1))) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, batch int, x double, peak double")
    got = {(r.batch, r.request) for r in M.replay(t, "id", "batch", 3, ["peak"], lambda: M.QuantileForest(["x"], [], "peak")).collect()}
    assert {b: r for b, r in got} == {1: 10, 2: 20} or all(r <= 10 * b + 1 for b, r in got)


def test_history_of_a_hot_key(spark):
    """One key for all rows: places, frames, states and neighbours as brute force finds them, from many blocks."""
    rng = np.random.default_rng(8)
    n = 3000
    rows = [("k", int(t), i, float(v) if i % 9 else None) for i, (t, v) in enumerate(zip(rng.integers(0, 1000, n), rng.uniform(0, 9, n)))]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double")
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert {r.id: r.place for r in H.positions(df, ["k"], ["t", "id"]).collect()} == {r[2]: i for i, r in enumerate(order)}
    seen = H.trailing_quantiles(df, ["k"], ["t", "id"], 64, a=("v", 0.5), b=("v", 0.95), c=("v", 0.9, "higher"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions are merged otherwise
    assert seen.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.id: r for r in seen.collect()}
    for i, r in enumerate(order):
        w = np.array([x[3] for x in order[max(0, i - 63) : i + 1] if x[3] is not None])
        g = got[r[2]]
        assert g.support == i + 1
        if not len(w):
            assert g.a is None
            continue
        level = min(1.0, np.ceil((len(w) + 1) * 0.9) / len(w))
        assert np.allclose([g.a, g.b, g.c], [np.quantile(w, 0.5), np.quantile(w, 0.95), np.quantile(w, level, method="higher")])
    assert {r.id: (r.support, r.a) for r in H.before_each(seen, ["k"], ["a"]).collect()} == {r[2]: (i, got[order[i - 1][2]].a if i else None) for i, r in enumerate(order)}
    most = {r.id: r.m for r in H.trailing(df, ["k"], ["t", "id"], 32, m=F.max("v")).collect()}
    assert most == {r[2]: max((x[3] for x in order[max(0, i - 31) : i + 1] if x[3] is not None), default=None) for i, r in enumerate(order)}
    # An outcome that completes at the decision's time is not seen.
    asked = H.asof(df.select("k", "t", F.col("id").alias("ask")), df, ["k"], "t", "t", ["id"], "id").collect()
    last = {t: max(((r[1], r[2]) for r in rows if r[1] < t), default=(None, None))[1] for t in {r[1] for r in rows}}
    assert all(r.last_id == last[r.t] for r in asked) and len(asked) == n
    # Quantiles of all that completed before, whatever its length.
    every = H.asof_quantiles(df.select("k", "t", F.col("id").alias("ask")), df, ["k"], "t", "t", "id", ["ask"], a=("v", 0.5), b=("v", 0.95)).collect()
    assert len(every) == n
    for r in every[:: n // 60]:
        seen_before = sorted(x[3] for x in rows if x[1] < rows[r.ask][1] and x[3] is not None)
        rank = lambda q: seen_before[max(1, int(np.ceil(q * len(seen_before)))) - 1] if seen_before else None
        assert r.support == len(seen_before) and (r.a, r.b) == (rank(0.5), rank(0.95))
    near = N.nearest_before(df, ["k"], ["t", "id"], ["v"], 3, ["id"], ["id"], block=256).collect()
    found = {}
    for r in near:
        found.setdefault(r.id, {})[r["rank"]] = (r.n_id, r.distance)
    value = lambda x: x[3] or 0.0
    for i in (0, 1, 2, 50, 1500, 2999):
        me = order[i]
        want = sorted((round(abs(value(x) - value(me)), 9), j, x[2]) for j, x in enumerate(order[:i]))[:3]
        assert [found.get(me[2], {})[k + 1] for k in range(len(want))] == [(x[2], x[0]) for x in want]


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write("b\ta\n2\t1\n")
    assert S.read_delimited(spark, str(tmp_path / "a.tsv.gz"), ["a", "b", "c"]).collect() == [("1", "2", None)]
    (tmp_path / "m1.tsv").write_text("id\treplay_position\nx\t1\n")
    (tmp_path / "m2.tsv").write_text("id\texperiment_position\ny\t2\n")
    m = S.read_manifests(spark, [str(tmp_path / "m1.tsv"), str(tmp_path / "m2.tsv")], ["id", "experiment_position"], {"replay_position": "experiment_position"})
    assert sorted(map(tuple, m.collect())) == [("x", "1"), ("y", "2")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/t7.json").write_text(json.dumps({"h": {"scope": "I3"}, "n": 4}))
    schema = T.StructType.fromDDL("h struct<scope: string>, n int")
    assert S.read_records(spark, str(tmp_path / "d"), schema, {"scope": "h.scope", "n": "n"}).collect() == [("t7", "I3", 4)]
    (tmp_path / "logs/P/t1").mkdir(parents=True)
    (tmp_path / "logs/P/t1/s.log").write_text("one\ntwo\n")
    assert {tuple(r) for r in S.read_log_lines(spark, str(tmp_path / "logs/*/*")).collect()} == {("P", "t1", "one"), ("P", "t1", "two")}
    (tmp_path / "kv.txt").write_text("a=1\nb = x=y\na=2\nnoise\n")
    assert S.read_key_values(spark, str(tmp_path / "kv.txt")).first()["fields"] == {"a": "1", "b": "x=y"}
    (tmp_path / "f.tsv").write_text("peak\t5\nother\t6\n")
    assert S.read_field_tables(spark, str(tmp_path / "f.tsv"), ["peak", "wall"]).select("peak", "wall").collect() == [("5", None)]
    (tmp_path / "p.csv").write_text("k,v\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="repeated"):
        S.read_plan(spark, str(tmp_path / "p.csv"), ["k"], ["k"])
    with pytest.raises(ValueError, match="missing"):
        S.read_plan(spark, str(tmp_path / "p.csv"), ["z"], ["k"])


def test_scratch_folders_go(spark, tmp_path, monkeypatch):
    from chronoledger import storage

    monkeypatch.setattr(storage, "_made", [])
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    with storage.Scratch(spark) as scratch:
        scratch.written(spark.range(3), "a")
        assert scratch.bucketed(spark.range(5).withColumn("p", F.col("id") % 2), "b", "p").groupBy("p").count().count() == 2
        kept = storage.written(spark.range(4), "c")
    assert len(list(tmp_path.iterdir())) == 1 and kept.count() == 4 and not [t for t in spark.catalog.listTables() if t.name.startswith("b_")]
    assert storage.sweep(spark) == 3 and not list(tmp_path.iterdir())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "b", -1)], "id int, w string, peak int")
    good, bad = S.split_valid(df, {"positive": F.col("peak") > 0})
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]
    S.write_by(df, str(tmp_path / "by"), "w")
    assert spark.read.parquet(str(tmp_path / "by")).where("w = 'b'").count() == 2
    S.write_projected(df, str(tmp_path / "pr"), ["w", "id"])
    assert spark.read.parquet(str(tmp_path / "pr")).columns == ["w", "id"]
    pre, out = S.decompose(df, "id", ["id", "w"], ["id", "peak"])
    assert pre.columns == ["id", "w"] and out.columns == ["id", "peak"]
    with pytest.raises(ValueError):
        S.decompose(df, "id", ["peak"], ["peak"])
    assert S.fingerprint(df).first() == S.fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert S.fingerprint(df).first() != S.fingerprint(df.union(df)).first()
    assert S.fingerprint(df.limit(0)).first()["n"] == 0


def test_outcomes_are_applied_once(spark, tmp_path):
    source, table, at = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "at")
    source.mkdir()

    def put(name, *rows):
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        B.ingest(spark, str(source), table, at).awaitTermination()

    row = {"task_id": "a", "workflow": "w", "process": "p", "exit_status": 0, "completion_us": 5, "peak_bytes": 10, "consumed_bytes": 3}
    put("1.json", row, row | {"task_id": "b", "completion_us": 4, "exit_status": 137, "consumed_bytes": None}, row | {"task_id": "c", "exit_status": 1})
    put("2.json", row, row | {"task_id": "b", "peak_bytes": 99}, row | {"task_id": "d", "completion_us": 1})
    got = {(r.task_id, r.status, r.seq, r.route) for r in spark.read.parquet(table).collect()}
    assert got == {("a", "applied", 2, "training"), ("b", "applied", 1, "history"), ("b", "conflict", None, "training"), ("d", "applied", 3, "training")}
    assert B.refresh_due(32, 0) and not B.refresh_due(90, 32) and B.refresh_due(96, 32)
    B.publish(spark.range(3), str(tmp_path / "m"), 1)
    B.publish(spark.range(5), str(tmp_path / "m"), 2)
    assert B.current(spark, str(tmp_path / "m")).count() == 5


def test_names_at_their_edges(spark):
    """Names that are empty, all punctuation or end in it."""
    from chronoledger.functions import rules
    from chronoledger.plans.sqltext import Engine

    e = Engine(True)
    names = spark.createDataFrame([(n,) for n in ("", ":", "x:__", "STAR INDEX)", " _index", "index", "A_A", "p:A_A_A")], "name string")
    family = rules.first("v", rules.FAMILIES, lambda r: f"'{r[1]}'", "'other'", e.like)
    got = names.selectExpr("name", f"{rules.terminal('name', e)} as t", f"{rules.underscored('name', e)} as v").selectExpr("name", "t", f"{family} as f")
    assert {r.name: (r.t, r.f) for r in got.collect()} == {
        "": ("UNKNOWN_OPERATION", "other"), ":": ("UNKNOWN_OPERATION", "other"), "x:__": ("UNKNOWN_OPERATION", "other"), "STAR INDEX)": ("STAR_INDEX", "index_build"),
        " _index": ("INDEX", "other"), "index": ("INDEX", "other"), "A_A": ("A", "other"), "p:A_A_A": ("A_A_A", "other"),
    }


def test_students_quantile(spark):
    from chronoledger.plans.statements import student

    want = {1: 12.7062, 9: 2.2622, 10: 2.2281, 11: 2.2010, 20: 2.0860, 30: 2.0423, 120: 1.9799}
    got = spark.createDataFrame([(k,) for k in want], "k int").selectExpr("k", f"{student('k')} as t").collect()
    assert all(abs(r.t - want[r.k]) < 1.1e-4 for r in got)


@pytest.mark.parametrize("name", ["src04_json_records", "src06_key_values", "src07_field_tables"])
def test_files_of_one_record_lie_in_one_folder(spark, name):
    """As many files as records, none in a folder of its own, which would be listed, made and moved one by one."""
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    before = set(Path(shared_dir(spark)).iterdir())
    assert catalog.queries()[name](spark, SF).distinct().count() == n
    (made,) = [p for p in Path(shared_dir(spark)).iterdir() if p not in before]
    inside = [p for p in made.iterdir() if p.name.startswith("part-")]
    assert len(inside) == n and all(p.is_file() for p in inside)


def test_leaves_hold_exact_quantiles_and_rows_are_told_where_they_are(spark, monkeypatch):
    """Nearest ranks of the rows that reach a leaf, however few ranges count them; a prediction shuffles nothing."""
    rng = np.random.default_rng(2)
    leaf, y = rng.integers(0, 5, (3000, 2)), np.concatenate((rng.exponential(3, 1500), rng.integers(0, 9, 1500)))
    df = spark.createDataFrame([(float(v), [int(a) for a in x]) for v, x in zip(y, leaf)], "__y double, __leaf array<long>")
    asked = (0.0, 0.5, 0.9, 0.99, 1.0)
    for ranges, at_once in ((4, 100), (64, 1 << 20)):
        monkeypatch.setattr(M, "RANGES", ranges)
        monkeypatch.setattr(M, "AT_ONCE", at_once)
        got = {(r.tree, r.leaf): (list(r.at), r.rows) for r in M._leaf_quantiles(df, 2, 5, asked).collect()}
        for t in range(2):
            for x in range(5):
                v = np.sort(y[leaf[:, t] == x])
                assert got[t, x] == ([v[max(int(np.ceil(len(v) * q)), 1) - 1] for q in asked], len(v))
    rows = spark.createDataFrame([(i, i % 7, float(i % 50)) for i in range(600)], "id long, x long, y double")
    both = M.Ensemble(lambda s: M.QuantileForest(["x"], [], "y", (0.5, 0.9), trees=4, depth=3, seed=s)).fit(rows)
    for model in (both, both.members[0]):
        assert "Exchange" not in model.predict(rows, "id")._jdf.queryExecution().executedPlan().toString()


def test_outcomes_are_told_apart_by_built_in_state(spark, tmp_path):
    """Batches of repeated, changed and null contents as brute force takes them in, no call of Python a task, also when the clock was set back."""
    source, table, at = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "at")
    source.mkdir()
    rng, names = np.random.default_rng(4), ("task_id", "workflow", "process", "exit_status", "completion_us", "peak_bytes", "consumed_bytes")
    known, seq, want = {}, {}, []
    for b in range(3):
        rows = [(None if k == 0 else f"t{k}", f"w{k % 3}", "p", 0, None if v == 0 else int(v), int(v), 1) for k, v in zip(rng.integers(0, 40, 60), rng.integers(0, 3, 60))]
        (source / f"{b}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))
        query = B.ingest(spark, str(source), table, at)
        query.awaitTermination()
        assert [s["operatorName"] for s in query.lastProgress["stateOperators"]] == ["stateStoreSave"]
        new = []
        for r in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0)):
            if known.setdefault(r[0], (r, b))[0] != r:
                want.append((r[0], r[5], "conflict", None))
            elif known[r[0]] == (r, b) and (r[0], b) not in new:
                new.append((r[0], b))
        for t, _ in sorted(new, key=lambda n: (known[n[0]][0][4] is not None, known[n[0]][0][4] or 0, n[0] is not None, n[0] or "")):
            w = known[t][0][1]
            seq[w] = seq.get(w, 0) + 1
            want.append((t, known[t][0][5], "applied", seq[w]))
        state = f"{table}-state/batch={b}"
        later = spark.createDataFrame(spark.read.parquet(state).withColumn("arrived", F.col("arrived") + 10**12).collect(), "workflow string, base long, arrived long")
        later.write.mode("overwrite").parquet(state)
    got = [(r.task_id, r.peak_bytes, r.status, r.seq) for r in B.applied(spark, table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    late = spark.createDataFrame([(5, None)], "arrived long, first struct<arrived: long, completion_us: long, digest: long>")
    with pytest.raises(ValueError, match="clock"):
        B._apply(late, 3, table, False)


def _grouped(spark):
    rng = np.random.default_rng(6)
    cells = zip(rng.integers(0, 40, 2000), rng.integers(0, 4, 2000), rng.integers(0, 3, 2000), rng.exponential(5, 2000))
    rows = [(i, None if x == 7 else int(x), (None, "a", "b", "c")[p], f"g{g}" if g else None, float(y * (1 + g) + x)) for i, (x, p, g, y) in enumerate(cells)]
    return spark.createDataFrame(rows, "id long, x long, p string, g string, y double")


def test_trees_are_walked_as_mllib_does(spark):
    """Leaves of rows as found by ``leafCol``, with missing and unseen values; and quantiles of a group's rows in them."""
    df = _grouped(spark)
    forest = M.QuantileForest(["x"], ["p"], "y", (0.5, 0.9), trees=5, depth=4, by=["g"]).fit(df)
    asked = df.select("id", "x", "p", "g", "y").unionByName(spark.createDataFrame([(-1, 3, "new", "g9", 1.0), (-2, None, None, None, 1.0)], df.schema))
    got = forest._ready(asked).select("id", forest._features(forest.model.stages).alias("f")).toPandas()
    import pyarrow as pa

    mine = dict(zip(got["id"], forest.walk.leaves(pa.array([list(f) for f in got["f"]])).tolist()))
    theirs = {r.id: [int(v) for v in r["__leaf"]] for r in forest.model.transform(forest._ready(asked)).select("id", "__leaf").collect()}
    assert mine == theirs and len({tuple(v) for v in mine.values()}) > 9
    rows, level = {r.id: r for r in asked.collect()}, np.log1p
    rank = lambda v, q: np.sort(v)[max(int(np.ceil(len(v) * q)), 1) - 1]
    told = {r.id: (r.q50, r.q90) for r in forest.predict(asked, "id").collect()}
    assert len(told) == len(rows)
    for i in [-1, -2, *range(0, 2000, 190)]:
        each = []
        for t in range(5):
            here = [rows[j] for j in range(2000) if mine[j][t] == mine[i][t]]
            own = [r.y for r in here if r.g == rows[i].g] if rows[i].g else []
            each.append([rank(level(own if len(own) >= 20 else [r.y for r in here]), q) for q in (0.5, 0.9)])
        assert np.allclose(told[i], np.expm1(np.median(each, axis=0)))


def test_groups_and_views_are_told_without_shuffles(spark, monkeypatch, tmp_path):
    """Few groups' leaves travel to the rows; of many groups the rows travel, with much the same quantiles. Views are columns, not joins."""
    df = _grouped(spark)
    make = lambda: M.QuantileForest(["x"], ["p"], "y", (0.5, 0.9), trees=3, depth=3, by=["g"])
    forest = make().fit(df)
    few = forest.predict(df, "id")
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    forest.save(str(tmp_path / "f"))
    monkeypatch.setattr(M, "AT_ONCE", 1)
    many = make().load(spark, str(tmp_path / "f")).predict(df, "id")
    assert {r.id: r.q90 for r in many.collect()} == pytest.approx({r.id: r.q90 for r in few.collect()})
    sketched = make()._by_group.__func__(forest, forest.model.transform(forest._ready(df)).select(F.log1p("y").alias("__y"), "g", M.vector_to_array("__leaf").cast("array<int>").alias("__leaf")), *forest.walk.shape, None)
    exact = {(r.g, r.tree, r.leaf): (r.rows, *r.at) for r in forest.local.collect()}
    assert {(r.g, r.tree, r.leaf): (r.rows, *r.at) for r in sketched.collect()} == {k: pytest.approx(v) for k, v in exact.items()}
    monkeypatch.undo()
    t = df.withColumn("c", F.when(F.col("id") % 7 != 0, F.col("y") / 2))
    out = M.score_views(t.where("id < 1000"), t.where("id >= 1000"), "id", {"A": ["x"], "AC": ["x", "c_hat"]}, ["p"], "c", "y", trees=3, depth=3)
    assert out.columns == ["id", "c_hat", "A", "AC"] and out.count() == 1000
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles_of_groups_from_outside_a_fold(spark, by):
    """Rows of every fold are told what the groups of all other folds tell, and of small groups what all of these rows do."""
    rng = np.random.default_rng(8)
    rows = [(i, ("a", "b", None)[i % 3] if i % 50 else "rare", float(x)) for i, x in enumerate(rng.normal(0, 1, 400))]
    df = spark.createDataFrame(rows, "id long, k string, y double")
    got = {r.id: (r.q50, r.q90) for r in M.out_of_fold(lambda: M.GroupQuantiles(by, "y", (0.5, 0.9)), df, "id", F.col("id") % 2, 2).collect()}
    assert len(got) == len(rows)
    for i, k, _ in rows:
        others = [r for r in rows if r[0] % 2 != i % 2]
        own = [r[2] for r in others if r[1] == k or not by]
        assert np.allclose(got[i], np.quantile(own if len(own) >= 20 else [r[2] for r in others], (0.5, 0.9)))
