"""The forms that were built for size, against plain brute force on small data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import classify, edges, generate, graphs, labels, memorization, nearest, ranking
from spanforge.sources import spans as source

NODES = "graph_id string, node_idx int, service_name string, operation_name string, duration double"
EDGES = "graph_id string, src int, dst int"


def corpus(spark, seed=4, sizes=(1, 2, 3, 6, 9, 14)):
    rng = random.Random(seed)
    nodes, links = [], []
    for g, n in enumerate(sizes):
        nodes += [(f"g{g}", i, rng.choice("abcd"), rng.choice("xyz"), float(rng.randint(0, 900))) for i in range(n)]
        links += [(f"g{g}", rng.randrange(n), rng.randrange(n)) for _ in range(2 * n - 2)]
    return nodes, links, spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, EDGES)


def scores(nodes, links):
    service = {(g, i): s for g, i, s, *_ in nodes}
    seen, total = {}, {}
    for g, a, b in links:
        pair = service[g, a], service[g, b]
        seen[pair] = seen.get(pair, 0) + 1
        total[pair[0]] = total.get(pair[0], 0) + 1
    k = len(set(service.values()))
    held = {}
    for g, i in service:
        held.setdefault(g, []).append(i)
    return {(g, a, b): (seen.get((service[g, a], service[g, b]), 0) + 1) / (total.get(service[g, a], 0) + k) for g, ids in held.items() for a in ids for b in ids if a != b}


def listed(df):
    return sorted((r["graph_id"], r["src"], r["dst"]) for r in df.collect())


def test_block_choices_equal_pair_choices(spark):
    nodes, links, n, e = corpus(spark)
    score, blocks = scores(nodes, links), edges.service_blocks(n, e)
    assert listed(edges.threshold_edges(n, blocks, 0.2)) == sorted(k for k, v in score.items() if v > 0.2 and k[1] < k[2])
    targets = {"g0": 3, "g2": 1, "g3": 4, "g4": 0, "g5": 1000}
    got = listed(edges.top_edges(n, blocks, spark.createDataFrame(list(targets.items()), "graph_id string, target int")))
    want = []
    for g, k in targets.items():
        want += sorted((p for p in score if p[0] == g and p[1] < p[2]), key=lambda p: (-score[p], p[1], p[2]))[:k]
    assert got == sorted(want)
    best = {(r["graph_id"], r["dst"]): (r["src"], r["score"]) for r in edges.best_parents(n, blocks).collect()}
    for g, d in best:
        assert best[g, d] == min(((a, v) for (h, a, b), v in score.items() if (h, b) == (g, d)), key=lambda x: (-x[1], x[0]))


def test_skip_sampling_takes_each_pair_with_its_chance(spark):
    sizes = {"p": 60, "q": 45}
    n = spark.createDataFrame([("g", i, "p" if i % 7 < 4 else "q", "o", 1.0) for i in range(105)], NODES)
    chance = {("p", "p"): 0.02, ("p", "q"): 0.3, ("q", "p"): 1.0, ("q", "q"): 0.1}
    blocks = spark.createDataFrame([("g", a, b, v, sizes[a], sizes[b]) for (a, b), v in chance.items()], "graph_id string, ps string, cs string, score double, n_src long, n_dst long")
    service = {r["node_idx"]: r["service_name"] for r in n.collect()}
    of = {k: [(i, j) for i in service for j in service if i < j and (service[i], service[j]) == k] for k in chance}
    taken = {k: 0 for k in chance}
    rounds = 6
    for seed in range(rounds):
        got = [(r["src"], r["dst"]) for r in edges.bernoulli_edges(n, blocks, seed).collect()]
        assert len(got) == len(set(got)) and all(a < b for a, b in got)
        for a, b in got:
            taken[service[a], service[b]] += 1
    for k, p in chance.items():
        m = rounds * len(of[k])
        assert abs(taken[k] - m * p) <= 4.5 * math.sqrt(m * p * (1 - p)) + 1e-9
    assert listed(edges.bernoulli_edges(n, blocks, 1)) == listed(edges.bernoulli_edges(n.repartition(3), blocks.repartition(2), 1))


def test_rows_of_skip_sampling_follow_the_edges_kept(spark, monkeypatch):
    rows = []
    plain = edges.materialize
    monkeypatch.setattr(edges, "materialize", lambda df, name: (lambda out: (rows.append(out.count()) if name == "edge-skips" else None, out)[1])(plain(df, name)))
    n = spark.range(4000).select(F.lit("g").alias("graph_id"), F.col("id").cast("int").alias("node_idx"), F.lit("s").alias("service_name"))
    blocks = spark.createDataFrame([("g", "s", "s", 0.0005, 4000, 4000)], "graph_id string, ps string, cs string, score double, n_src long, n_dst long")
    kept = edges.bernoulli_edges(n, blocks, 3).count()
    assert abs(kept - 4000) < 300 and sum(rows) < 3 * kept  # of 16 million ordered pairs


def test_forest_of_a_large_graph(spark):
    rng = random.Random(2)
    services = [f"s{k}" for k in range(40)]
    n = spark.createDataFrame([("big", i, rng.choice(services), "o", 1.0) for i in range(10_000)], NODES)
    blocks = spark.createDataFrame([("big", a, b, rng.random(), 1, 1) for a in services for b in services], "graph_id string, ps string, cs string, score double, n_src long, n_dst long")
    got = [(r["src"], r["dst"]) for r in edges.spanning_forest(n, blocks).collect()]
    assert len(got) == 9_999 == len({d for _, d in got})
    top = list(range(10_000))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in got:
        assert find(a) != find(b)
        top[find(b)] = find(a)


def test_adjoint_propagation_equals_the_matrix(spark):
    nodes, links, n, e = corpus(spark, 7)
    stats = spark.createDataFrame([(1.5, 2.0)], "log_mean double, log_sd double")
    for rounds in (1, 2, 3):
        got = {(r["graph_id"], r["feature"]): r["value"] for r in classify.graph_features(n, e, stats, rounds).collect()}
        for g in {x[0] for x in nodes}:
            mine = [x for x in nodes if x[0] == g]
            a = np.eye(len(mine))
            for h, i, j in links:
                if h == g and i != j:
                    a[i, j] = a[j, i] = 1
            d = a.sum(1)
            s = np.linalg.matrix_power(a / np.sqrt(np.outer(d, d)), rounds)
            columns = {f"s:{x}": [float(r[2] == x) for r in mine] for x in "abcd"} | {f"o:{x}": [float(r[3] == x) for r in mine] for x in "xyz"}
            columns["duration"] = [(math.log1p(r[4]) - 1.5) / 2.0 for r in mine]
            for name, x in columns.items():
                assert got.get((g, name), 0.0) == pytest.approx((s @ np.array(x)).mean(), abs=1e-12)


def test_features_never_travel_along_edges(spark):
    _, _, n, e = corpus(spark)
    stats = spark.createDataFrame([(1.5, 2.0)], "log_mean double, log_sd double")
    plan = classify.graph_features(n, e, stats)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("feature" in line for line in joins)


def test_running_sums_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 11)
    rng = random.Random(1)
    rows = [(k, float(v), rng.randint(1, 5), rng.randint(0, 3)) for k in "abc" for v in rng.sample(range(1000), 60 if k == "a" else 9)]
    got = {(r["k"], r["v"]): (r["x_upto"], r["y_upto"], r["next_value"]) for r in ranking.running(spark.createDataFrame(rows, "k string, v double, x long, y long"), ["k"], "v", ["x", "y"]).collect()}
    for k in "abc":
        mine = sorted(r[1:] for r in rows if r[0] == k)
        for i, (v, _, _) in enumerate(mine):
            assert got[k, v] == (sum(r[1] for r in mine[: i + 1]), sum(r[2] for r in mine[: i + 1]), mine[i + 1][0] if i + 1 < len(mine) else None)
    names = [f"n{k:03d}" for k in rng.sample(range(500), 80)]
    ids = graphs.vocabulary([spark.createDataFrame([(x,) for x in names], "s string"), spark.createDataFrame([(x,) for x in names[:9]], "s string")], "s")
    assert {r["name"]: r["id"] for r in ids.collect()} == {x: k for k, x in enumerate(sorted(names))}


def test_carried_values_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 5)
    rng = random.Random(3)
    rows = [(k, t, rng.choice([None, None, None, t * 10])) for k in "ab" for t in range(40 if k == "a" else 6)]
    got = {(r["k"], r["t"]): r["v_seen"] for r in ranking.carried(spark.createDataFrame(rows, "k string, t int, v int"), ["k"], ["t"], "v").collect()}
    for k in "ab":
        last = None
        for _, t, v in [r for r in rows if r[0] == k]:
            last = v if v is not None else last
            assert got[k, t] == last


ROOTS, WINDOWS = "source_run string, trace_id string, timestamp long, end_sec double", "source_run string, fault_idx long, w_start double, w_end double, fault string"
YEAR = 365.25 * 86400


def test_interval_sweep_equals_loops(spark, monkeypatch):
    rng = random.Random(11)
    windows = []
    for run in ("r", "s", "t"):
        for k in range(40 if run == "r" else 3):
            a = rng.choice([rng.randint(0, 300), rng.randint(0, 300) + 0.5])
            windows.append((run, k, float(a), float(a + rng.choice([0, 0, 1, 5, 60])), f"f{k}"))
    windows += [("t", 3, 100.0, 100.0 + 3 * YEAR, "years"), ("t", 4, 5e9, math.inf, "endless"), ("s", 9, 50.0, 40.0, "backward")]
    roots = []
    for k in range(300):
        s = rng.randint(-5, 320)
        d = rng.choice([0, 0.25, 1, 7, 50, 2 * YEAR, math.inf, math.nan, -30, -3, None])
        roots.append((rng.choice("rrrstu"), f"t{k}", s, None if d is None else float(s + d)))
    roots.append(("t", "late", int(6e9), 6e9 + 1))

    def overlap(s, e, a, b):
        return b >= a and not (e < a or s > b)  # an end that is not a number lies behind everything

    monkeypatch.setattr(ranking, "RANGE_ROWS", 37)
    got = {r["trace_id"]: (r["trace_label"], r["fault_type"]) for r in labels.label_roots(spark.createDataFrame(roots, ROOTS), spark.createDataFrame(windows, WINDOWS)).collect()}
    assert len(got) == len(roots)
    for run, t, s, e in roots:
        hit = [] if e is None else [(k, f) for r, k, a, b, f in windows if r == run and overlap(s, e, a, b)]
        assert got[t] == (("abnormal", min(hit)[1]) if hit else ("normal", "none")), (run, t, s, e)
    none = labels.label_roots(spark.createDataFrame(roots, ROOTS), spark.createDataFrame([], WINDOWS))
    assert none.filter("trace_label = 'normal' and fault_type = 'none'").count() == len(roots)
    assert labels.label_roots(spark.createDataFrame([], ROOTS), spark.createDataFrame(windows, WINDOWS)).count() == 0


def test_alias_draws_follow_the_weights_without_growing_rows(spark):
    counts = {"s": {"a": 1, "b": 50, "c": 7, "d": 300}, "t": {"only": 4}}
    nodes = spark.createDataFrame([(s, o) for s, ops in counts.items() for o, n in ops.items() for _ in range(n)], "service_name string, operation_name string")
    table = generate.alias_tables(nodes, 0.8).toPandas()
    for s, ops in counts.items():
        weight = {o: n ** (1 / 0.8) for o, n in ops.items()}
        mine = table[table["service_name"] == s]
        for o, w in weight.items():
            p = (mine["cut"] * (mine["operation_name"] == o) + (2**32 - mine["cut"]) * (mine["other"] == o)).sum() / 2**32 / len(mine)
            assert p == pytest.approx(w / sum(weight.values()), abs=1e-8)
    n = 20_000
    asked = spark.range(n).select(F.col("id").alias("gen_id"), F.lit(0).alias("node_idx"), F.when(F.col("id") % 10 == 0, "t").otherwise("s").alias("service_name"))
    got = {(r["service_name"], r["operation_name"]): r["count"] for r in generate.label_draws(asked, nodes, 0.8, 5).groupBy("service_name", "operation_name").count().collect()}
    assert sum(got.values()) == n and got["t", "only"] == n // 10
    weight = {o: c ** (1 / 0.8) for o, c in counts["s"].items()}
    expected = {o: 0.9 * n * w / sum(weight.values()) for o, w in weight.items()}
    chi = sum((got.get(("s", o), 0) - x) ** 2 / x for o, x in expected.items())
    assert chi < 16.3  # three degrees of freedom, one in a thousand


def test_names_may_hold_separators(spark):
    rows = {"g1": [("a|b", "c"), ("d", "e>f")], "g2": [("a", "b|c"), ("d", "e>f")], "g3": [("a|b", "c"), ("d", "e>f")], "g4": [("a", 'b","c'), (None, "x")], "g5": [('a","b', "c"), ("null", "x")]}
    n = spark.createDataFrame([(g, i, s, o, 1.0) for g, held in rows.items() for i, (s, o) in enumerate(held)], NODES)
    e = spark.createDataFrame([(g, 0, 1) for g in rows], EDGES)
    made = graphs.edge_labels(n, e)
    assert made.select("edge_label").distinct().count() == 4
    of = spark.createDataFrame([(g,) for g in rows], "graph_id string")
    at = n.select("graph_id", graphs.node_label().alias("label"))
    sig = {r["graph_id"]: r["sig"] for r in memorization.signatures(of, at, made).collect()}
    assert sig["g1"] == sig["g3"] and len(set(sig.values())) == 4
    near = memorization.nearest_jaccard(memorization.token_sets(of.filter("graph_id <> 'g1'"), made, "edge_label"), memorization.token_sets(of.filter("graph_id = 'g1'"), made, "edge_label"))
    assert {r["graph_id"]: r["nearest"] for r in near.filter("graph_id <> 'g1'").collect()} == {"g2": 0.0, "g3": 1.0, "g4": 0.0, "g5": 0.0}


@pytest.mark.parametrize("weights", [(1.0,), (0.7, 0.3), (0.2, 0.5, 0.3)])
def test_falling_bounds_lose_nothing(spark, weights):
    rng = random.Random(len(weights))
    words = [rng.getrandbits(62) for _ in range(120)]

    def side(n, base):
        made = {}
        for k in range(n):
            sets = tuple(frozenset(rng.choice(words[: 6 * 4 ** rng.randint(0, 2)]) for _ in range(rng.randint(1, 14))) for _ in weights)
            made[sets] = base + k
        return made

    probes, index = side(150, 0), side(200, 1000)
    # Near copies, so that every level has its share.
    for sets, k in list(index.items())[:60]:
        near = [set(s) for s in sets]
        near[0].add(rng.choice(words))
        if rng.random() < 0.5:
            near[-1].pop()
        if all(near):
            probes[tuple(frozenset(s) for s in near)] = 500 + k
    probes = {s: k for s, k in probes.items() if s not in index}
    schema = "kind long, " + ", ".join(f"set{k} array<long>" for k in range(len(weights)))
    a, b = (spark.createDataFrame([(k, *[sorted(x) for x in s]) for s, k in side_.items()], schema) for side_ in (probes, index))

    def sim(p, r):
        return sum(w * len(x & y) / len(x | y) for w, x, y in zip(weights, p, r))

    want = {k: max(sim(p, r) for r in index) for p, k in probes.items()}
    got = {r["kind"]: r["nearest"] for r in nearest.greatest_similarity(a, b, weights).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    for level in (0.3, 0.75):
        assert {r["kind"] for r in nearest.reaching(a, b, level, weights).collect()} == {k for k, v in want.items() if v >= level}


def test_tables_bucketed_by_graph_meet_without_exchange(spark, tmp_path):
    nodes, links, n, e = corpus(spark, 13)
    stats = {r["graph_id"]: r for r in graphs.graph_stats(n, e).collect()}
    saved = [source.save_by_graph(t, f"bucketed_{name}", 4, f"{tmp_path}/{name}") for name, t in (("nodes", n), ("edges", e))]
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    usual = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        for made in (graphs.graph_stats(*saved), graphs.edge_labels(*saved), graphs.degrees(*saved), saved[1].groupBy("graph_id").count()):
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        got = {r["graph_id"]: r for r in graphs.graph_stats(*saved).collect()}
        assert set(got) == set(stats) and all(list(got[g])[1:] == pytest.approx(list(stats[g])[1:]) for g in stats)
        pruned = saved[0].filter("graph_id = 'g3'").groupBy("graph_id").count()
        one = spark._jvm.PythonSQLUtils.explainString(pruned._jdf.queryExecution(), "formatted")
        assert "SelectedBucketsCount: 1 out of 4" in one
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
        for name in ("nodes", "edges"):
            spark.sql(f"drop table bucketed_{name}")


def dense_fit(x, y, reg):
    """Newton on the class-weighted log loss with an intercept that bears no penalty."""
    n = len(y)
    raw = np.array([n / (y == k).sum() for k in (0, 1)])
    much = (raw / raw.mean())[y.astype(int)]
    a = np.hstack([x, np.ones((n, 1))])
    ridge = reg * np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        slope = a.T @ (much * (p - y)) / much.sum() + ridge @ w
        w = w - np.linalg.solve((a * (much * p * (1 - p))[:, None]).T @ a / much.sum() + ridge + 1e-12 * np.eye(len(w)), slope)
    return w


def test_the_grid_equals_dense_fits(spark):
    rng = np.random.default_rng(5)
    n, d = 240, 6
    x = rng.standard_normal((n, d)) * (rng.random((n, d)) < 0.5)
    y = (x @ rng.standard_normal(d) + 0.7 * rng.standard_normal(n) > 0.4).astype(float)
    rows = spark.createDataFrame([(f"g{k}", [int(j) for j in np.flatnonzero(v)], [float(c) for c in v[v != 0]]) for k, v in enumerate(x)], "graph_id string, ids array<int>, vals array<double>").repartition(3)
    cell = {k: [c for c in range(3) if (k * 7 + c * 5) % 3 != 0] for k in range(n)}
    role = ["train", "train", "train", "val", "test"]
    uses = [(f"g{k}", c, role[(k + c) % 5], float(y[k])) for k in range(n) for c in cell[k]]
    work = rows.join(spark.createDataFrame(uses, "graph_id string, cell int, role string, label double"), "graph_id")
    train = {c: [k for k in range(n) if c in cell[k] and role[(k + c) % 5] == "train"] for c in range(3)}
    much = {c: {v: (1 / sum(y[k] == v for k in ks)) for v in (0.0, 1.0)} for c, ks in train.items()}
    much = {c: {v: 2 * m[v] / sum(m.values()) for v in m} for c, m in much.items()}
    weight = spark.createDataFrame([(c, v, float(w)) for c, m in much.items() for v, w in m.items()], "cell int, label double, weight double")
    packed = work.join(weight, ["cell", "label"]).groupBy("graph_id").agg(F.first("ids").alias("ids"), F.first("vals").alias("vals"), F.collect_list(F.struct("cell", "role", "label", "weight")).alias("uses"))
    got = classify.fit_grid(packed, d, [0, 1, 2], (0.01, 0.1))
    for c in range(3):
        for k, reg in enumerate((0.01, 0.1)):
            assert np.abs(got[2 * c + k] - dense_fit(x[train[c]], y[train[c]], reg)).max() < 1e-4
    scored = {(r["graph_id"], r["cell"]): r for r in classify.fit_and_score(rows, d, spark.createDataFrame(uses, "graph_id string, cell int, role string, label double"), (0.01, 0.1)).collect()}
    assert len(scored) == len(uses)
    for c in range(3):
        val = [k for k in range(n) if c in cell[k] and role[(k + c) % 5] == "val"]

        def loss(w):
            m = x[val] @ w[:-1] + w[-1]
            return np.logaddexp(0, np.where(y[val] > 0, -m, m)).mean()

        w = min((dense_fit(x[train[c]], y[train[c]], reg) for reg in (0.01, 0.1)), key=loss)
        for k in val:
            assert scored[f"g{k}", c]["score"] == pytest.approx(1 / (1 + np.exp(-(x[k] @ w[:-1] + w[-1]))), abs=1e-4)
    nothing = spark.createDataFrame([], "graph_id string, cell int, role string, label double")
    assert classify.fit_and_score(rows, d, nothing).count() == 0
    lone = classify.fit_and_score(rows, d, nothing.union(spark.createDataFrame([("g1", 4, "test", 1.0)], nothing.schema))).collect()
    assert [(r["cell"], r["score"]) for r in lone] == [(4, 0.5)]
