"""Hand-made cases, invariants and golden values of the trace operators."""

import json
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.functions.draws import draw
from spanforge.operators import classify, corpora, distributions, edges, fidelity, generate, graphs, labels, memorization, metrics, nearest, ranking, sampling
from spanforge.sources import shared
from spanforge.sources import spans as source

SPANS = "source_run string, trace_id string, span_id string, parent_id string, service_name string, operation_name string, timestamp long, duration double, span_seq long, system string"


def make(spark, *rows):
    return spark.createDataFrame([("r", *r, "TT") for r in rows], SPANS)


def test_edges_of_odd_traces(spark):
    s = make(
        spark,
        ("t", "t", "", "a", "x", 0, 1e6, 0), ("t", "b", "t", "b", "x", 1, 1.0, 1), ("t", "b", "t", "b2", "x", 2, 1.0, 2),  # repeated span id: the last counts
        ("t", "c", "b", "c", "x", 3, 1.0, 3), ("t", "d", "gone", "d", "x", 4, 1.0, 4), ("t", "e", "e", "e", "x", 5, 1.0, 5),  # orphan, own parent
        ("u", "u", "NaN", "a", "x", 0, 1.0, 0),
    )
    nodes = graphs.index_nodes(s)
    got = sorted((r.src, r.dst) for r in graphs.parent_edges(nodes).collect())
    assert got == [(0, 1), (0, 2), (2, 3), (5, 5)]
    stats = {r.graph_id: r for r in graphs.graph_stats(nodes, graphs.parent_edges(nodes)).collect()}
    assert stats["r::u"].edge_count == 0 and stats["r::u"].density == 0
    assert stats["r::t"].max_degree == 2 and stats["r::t"].node_count == 6


def test_fault_windows(spark):
    s = make(spark, ("t", "t", "", "a", "x", 100, 10e6, 0), ("u", "u", "", "a", "x", 111, 1e6, 1), ("v", "w", "", "a", "x", 100, 1e6, 2))
    w = spark.createDataFrame([("r", 1, 100.0, 200.0, "second"), ("r", 0, 110.0, 110.0, "first"), ("other", 0, 0.0, 999.0, "far")], "source_run string, fault_idx long, w_start double, w_end double, fault string")
    roots = labels.root_spans(s)
    got = {r.trace_id: (r.trace_label, r.fault_type) for r in labels.label_roots(roots, w).collect()}
    assert got == {"t": ("abnormal", "first"), "u": ("abnormal", "second")}
    spans = {r.trace_id: r.trace_label for r in labels.label_spans(s, labels.label_roots(roots, w)).collect()}
    assert spans["v"] is None  # no root row
    assert labels.label_roots(roots, w.filter("fault = 'far'")).filter("trace_label = 'abnormal'").count() == 0


def values(spark, a, b):
    return spark.createDataFrame([("m", "A", float(x)) for x in a] + [("m", "B", float(x)) for x in b], "metric string, side string, value double")


def test_distances(spark):
    def both(a, b):
        r = distributions.ecdf_distances(distributions.counts(values(spark, a, b), ["metric"]), ["metric"]).first()
        return r.ks_similarity, r.wasserstein_similarity

    assert both([1, 2, 3], [1, 2, 3]) == (1, 1)
    assert both([0, 0], [1, 1])[0] == 0
    ks, w = both([1, 2, 3, 4], [2, 3, 4, 5])
    assert ks == pytest.approx(0.75) and w == pytest.approx(1 - 1 / 3.5)
    assert both([5, 5], [5, 5, 5]) == (1, 1)
    assert both([1, 2], [])[0] == 0
    same = distributions.js_similarity(distributions.counts(values(spark, [1, 1, 2], [1, 1, 2]), ["metric"]), ["metric"]).first().js_similarity
    apart = distributions.js_similarity(distributions.counts(values(spark, [1], [2]), ["metric"]), ["metric"]).first().js_similarity
    assert same == pytest.approx(1, abs=1e-6) and apart == pytest.approx(0, abs=1e-5)


def test_running_sums_do_not_depend_on_partitions(spark):
    c = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 1000).cast("double").alias("v"), F.lit(1).alias("n"))
    for parts in (1, 4, 50):
        out = ranking.running(c.repartition(parts), ["k"], "v", ["n"])
        assert out.filter("n_upto <> v + 1 or (next_value <> v + 1)").count() == 0


def sets(spark, rows):
    return spark.createDataFrame(rows, "graph_id string, token string")


def test_nearest_jaccard_against_loops(spark):
    a = {"a0": {"x", "y"}, "a1": {"y", "z", "w"}, "a2": set()}
    b = {"b0": {"x", "y"}, "b1": {"y", "z"}, "b2": set(), "b3": {"q"}}
    ids = lambda d: spark.createDataFrame([(k,) for k in d], "graph_id string")
    toks = lambda d: spark.createDataFrame([(k, t) for k, v in d.items() for t in v], "graph_id string, t string")
    got = memorization.nearest_jaccard(memorization.token_sets(ids(b), toks(b), "t"), memorization.token_sets(ids(a), toks(a), "t"))

    def j(x, y):
        return 1.0 if not x and not y else len(x & y) / len(x | y)

    assert {r.graph_id: r.nearest for r in got.collect()} == pytest.approx({k: max(j(v, w) for w in a.values()) for k, v in b.items()})


def test_sampling_bounds_and_repeatability(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("graph_id"), (F.col("id") % 2).alias("corpus"))
    for k, n in ((0, 0), (-3, 0), (7, 14), (500, 100)):
        assert sampling.take_count(df, ["corpus"], k, 1, "p").count() == n
    first = sorted(r.graph_id for r in sampling.take_count(df, ["corpus"], 7, 1, "p").collect())
    assert first == sorted(r.graph_id for r in sampling.take_count(df.repartition(9), ["corpus"], 7, 1, "p").collect())
    kept = sampling.split(df, ["corpus"], 0.8, 1, "s")
    assert kept.filter("kept").count() == 80 and kept.count() == 100
    assert sampling.take_fraction(df, ["corpus"], 0.001, 1, "f").count() == 2


#: Published training totals: synthetic pool, real pool, percent, train synthetic, train real.
MIXES = [
    (5195, 4675, 10, 5195, 577), (9043, 8138, 10, 9042, 1005), (5195, 4675, 30, 5195, 2226), (9043, 8138, 30, 9043, 3875), (5158, 4675, 10, 5158, 573),
    (5158, 4675, 30, 5158, 2210), (5195, 4675, 50, 4675, 4675), (9043, 8138, 50, 8138, 8138), (5195, 4675, 70, 2003, 4675), (9043, 8138, 70, 3488, 8138),
]


def test_mix_targets_match_published_totals(spark):
    for s, r, p, ts, tr in MIXES:
        row = corpora.mix_targets(spark.createDataFrame([(s, r)], "synth_pool long, real_pool long"), [p]).first()
        assert (row.train_synth, row.train_real) == (ts, tr)
    ends = {x.percent: x for x in corpora.mix_targets(spark.createDataFrame([(10, 20)], "synth_pool long, real_pool long"), [0, 100]).collect()}
    assert (ends[0].train_synth, ends[0].train_real, ends[100].train_synth, ends[100].train_real) == (10, 0, 0, 20)


def test_published_confusion_row(spark):
    row = metrics.derived_metrics(spark.createDataFrame([(505, 255, 234, 306)], "tn long, fp long, fn long, tp long")).first()
    assert row.weighted_f1 == pytest.approx(0.624799, abs=1e-6) and row.false_alarm_rate == pytest.approx(0.335526, abs=1e-6)
    none = metrics.derived_metrics(spark.createDataFrame([(0, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert none.accuracy == 0 and none.weighted_f1 == 0


def test_seed_aggregate_of_one_run(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("b", None)], "k string, m double")
    got = {r.k: (r.runs, r.m_mean, r.m_sd) for r in metrics.aggregate_seeds(df, ["k"], ["m"]).collect()}
    assert got["a"] == (1, 1.0, 0.0) and got["b"] == (3, 2.0, pytest.approx(2**0.5))


def test_generated_graphs(spark):
    pool = spark.createDataFrame([("g1", 1), ("g2", 4), ("g3", 9)], "graph_id string, num_nodes long")
    made = generate.blank_graphs(pool, 200, 3)
    blank = generate.blank_nodes(made)
    assert made.count() == 200 and {r.num_nodes for r in made.collect()} <= {1, 4, 9}
    tree = generate.tree_edges(blank, 3)
    assert tree.filter("src >= dst or src < 0").isEmpty() and tree.count() == blank.filter("node_idx > 0").count()
    dag = generate.dag_edges(blank, 3)
    assert dag.filter("src >= dst").isEmpty() and dag.count() >= tree.count()
    rnd = generate.random_edges(made, made.select("gen_id", (F.col("num_nodes") * 100).alias("num_edges")), 3)
    per = rnd.groupBy("gen_id").count().join(made, "gen_id")
    assert per.filter("count <> num_nodes * (num_nodes - 1)").isEmpty() and rnd.filter("src = dst").isEmpty()


def walk_forest(services, score):
    """Kruskal over a sorted list of all pairs, then the best pairs left."""
    pairs = sorted((-score[a, b], i, j) for i, a in enumerate(services) for j, b in enumerate(services) if i != j)
    parent, top = {}, list(range(len(services)))

    def find(x):
        return x if top[x] == x else find(top[x])

    for acyclic in (True, False):
        for _, i, j in pairs:
            if len(parent) < len(services) - 1 and j not in parent and not (acyclic and find(i) == find(j)):
                parent[j] = i
                if acyclic:
                    top[find(j)] = find(i)
    return {(i, j) for j, i in parent.items()}


def test_spanning_forest_is_the_greedy_walk(spark):
    rng = random.Random(6)
    for _ in range(4):
        score = {(a, b): rng.choice([0.1, 0.2, 0.3, 0.5]) for a in "abc" for b in "abc"}
        graphs = {f"g{k}": [rng.choice("abc") for _ in range(n)] for k, n in enumerate((1, 2, 5, 9))}
        nodes = spark.createDataFrame([(g, i, s) for g, held in graphs.items() for i, s in enumerate(held)], "graph_id string, node_idx int, service_name string")
        blocks = spark.createDataFrame([(g, a, b, score[a, b], 1, 1) for g, held in graphs.items() for a in set(held) for b in set(held)], "graph_id string, ps string, cs string, score double, n_src int, n_dst int")
        got = {g: set() for g in graphs}
        for r in edges.spanning_forest(nodes, blocks).collect():
            got[r.graph_id].add((r.src, r.dst))
        assert got == {g: walk_forest(held, score) for g, held in graphs.items()}


def test_nearest_similarity_by_bounds(spark, monkeypatch):
    rng = random.Random(8)
    sides = [[({rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))}, {rng.choice("xyz") for _ in range(rng.randint(1, 3))}) for _ in range(60)] for _ in range(2)]

    def tables(rows):
        ids = spark.createDataFrame([(str(i),) for i in range(len(rows))], "graph_id string")
        return [memorization.token_sets(ids, spark.createDataFrame([(str(i), t) for i, r in enumerate(rows) for t in r[k]], "graph_id string, token string"), "token") for k in (0, 1)]

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    want = [max(0.7 * jaccard(e, f) + 0.3 * jaccard(n, m) for f, m in sides[1]) for e, n in sides[0]]
    synth, real = tables(sides[0]), tables(sides[1])
    # Every token is in many sets here: with small tiles each is cut into several.
    for tile in (nearest.TILE, 7):
        monkeypatch.setattr(nearest, "TILE", tile)
        got = {r.graph_id: r.nearest for r in memorization.combined_similarity(synth, real).collect()}
        assert all(got[str(i)] == pytest.approx(w) for i, w in enumerate(want))
    for level in (0.5, 0.8, 0.95):
        near = {r.graph_id for r in memorization.similar_graphs(synth, real, level).collect()}
        assert near == {str(i) for i, w in enumerate(want) if w >= level}
    none = [t.limit(0) for t in real]
    assert {r.nearest for r in memorization.combined_similarity(synth, none).collect()} == {0.0}


def test_nearest_keys_keep_frequent_tokens_apart():
    """Sets over few tokens, all frequent: at every level few probes and index rows meet in a key, and no pair at the level is lost."""
    rng = np.random.default_rng(3)
    sets = [[rng.permutation(40)[: rng.integers(1, 9)] for _ in range(400)] for _ in range(2)]
    pairs = [(p, r, len(np.intersect1d(a, b)) / len(np.union1d(a, b))) for p, a in enumerate(sets[0]) for r, b in enumerate(sets[1])]
    by_token = sum(len(np.intersect1d(sets[0][p], sets[1][r])) for p, r, _ in pairs)
    batches = [pa.record_batch([pa.array([0.0] * 400), pa.array([sorted(x.tolist()) for x in side]), pa.array([[True] * len(x) for x in side])], ["best", "set0", "live0"]) for side in sets]
    for level, share in ((0.8, 0.02), (0.5, 0.1)):
        of = nearest._Round(nearest.table_bounds((1.0,), level), level, {0: (False, False)}, 1, nearest.MANY, nearest.WIDE)
        probes, index = (of.keys(b, real) for b, real in zip(batches, (False, True)))
        rows = defaultdict(list)
        for many, token, row in zip(index["many"], index["token"], index["row"]):
            rows[many, token].append(row)
        met = [(p, r) for many, token, p in zip(probes["many"], probes["token"], probes["row"]) for r in rows[many, token]]
        assert len(met) < share * by_token
        assert {(p, r) for p, r, j in pairs if j >= level} <= set(met)


def test_nearest_by_every_lane_tile_and_sketch(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sides = []
    for start in (0, 1000):
        rows = [(f"g{start + i}", str(t), str(t % 7)) for i in range(60) for t in rng.permutation(30)[: rng.integers(1, 14)]]
        sides.append(spark.createDataFrame(rows, "graph_id string, edge_label string, label string"))
    synth, real = ((x.select("graph_id", F.col("edge_label").alias("token")).distinct(), x.select("graph_id", F.col("label").alias("token")).distinct()) for x in sides)
    held = [defaultdict(lambda: (set(), set())) for _ in sides]
    for at, side in zip(held, sides):
        for g, e, n in side.collect():
            at[g][0].add(e), at[g][1].add(n)

    def j(a, b):
        return len(a & b) / len(a | b)

    for wide, tile, sketch in ((16, 2048, 20_000), (5, 9, 0)):
        for name, value in (("WIDE", wide), ("TILE", tile), ("SKETCH_ROWS", sketch)):
            monkeypatch.setattr(nearest, name, value)
        for weights, got in (((1.0, 0.0), memorization.nearest_jaccard(synth[0], real[0])), (memorization.WEIGHTS, memorization.combined_similarity(synth, real))):
            want = {g: max(weights[0] * j(a[0], b[0]) + weights[1] * j(a[1], b[1]) for b in held[1].values()) for g, a in held[0].items()}
            assert {r.graph_id: r.nearest for r in got.collect()} == pytest.approx(want)


def test_published_aggregations(spark):
    import golden

    names = ["weighted_f1", "abnormal_f1", "abnormal_recall", "pr_auc", "false_alarm_rate"]
    runs = spark.createDataFrame([r[:8] for r in golden.SEED_RUNS], "system string, percent double, seed int, " + ", ".join(f"{m} double" for m in names))
    got = {(r.system, r.percent): r for r in metrics.aggregate_seeds(runs, ["system", "percent"], names).collect()}
    assert len(got) == len(golden.SEED_SUMMARY) == 8
    for system, percent, count, *values in golden.SEED_SUMMARY:
        r = got[system, percent]
        assert r.runs == count and [r[f"{m}_{x}"] for m in names for x in ("mean", "sd")] == pytest.approx(values, abs=1e-8)
    cells = spark.createDataFrame([(k, *r[8:]) for k, r in enumerate(golden.SEED_RUNS)], "k int, tn long, fp long, fn long, tp long")
    for r in metrics.derived_metrics(cells).collect():
        wf, af, ar, _, far = golden.SEED_RUNS[r.k][3:8]
        assert (r.weighted_f1, r.abnormal_f1, r.abnormal_recall, r.false_alarm_rate) == pytest.approx((wf, af, ar, far), abs=1.1e-6)
    parts = [*[f"{m}_ks_similarity" for m in fidelity.STRUCTURE], "graph_feature_mmd_similarity", *[f"{m}_ks_similarity" for m in fidelity.TIMING], *[f"{m}_js_similarity" for m in fidelity.LABELS], "service_operation_valid_mass"]
    rows = spark.createDataFrame([(k, *r[0]) for k, r in enumerate(golden.FIDELITY)], "k int, " + ", ".join(f"{p} double" for p in parts))
    for r in fidelity.roll_up(rows).collect():
        assert [r[m] for m in fidelity.MEANS] == pytest.approx(golden.FIDELITY[r.k][1], abs=2e-6)


def test_shared_tables_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    before = shared.mark()
    first, second = shared.materialize(spark.range(3), "t"), shared.materialize(spark.range(4), "t")
    shared.release(spark, before, keep=1)
    assert shared.mark() == before + 1 and second.count() == 4
    with pytest.raises(Exception):
        first.collect()


def test_classifier_tells_two_shapes_apart(spark):
    rows = [(f"g{i}", "train" if i % 5 < 3 else "val" if i % 5 == 3 else "test", i % 2) for i in range(60)]
    long = [(g, f"s:{'xy'[y]}", 1.0) for g, _, y in rows] + [(g, "duration", float(i % 7)) for i, (g, _, _) in enumerate(rows)] + [("g4", "s:unseen", 1.0)]
    features, roles = spark.createDataFrame(long, "graph_id string, feature string, value double"), spark.createDataFrame(rows, "graph_id string, role string, label int")
    x, n = classify.sparse_rows(features, roles.filter("role = 'train'").select("graph_id"))
    assert n == 3 and {max(r.ids) for r in x.collect()} <= {0, 1, 2}
    got = classify.fit_and_score(x, n, roles.withColumn("cell", F.lit(0))).collect()
    assert len(got) == 60 and all(r.pred == r.label and (r.score > 0.5) == (r.label == 1) for r in got)


def test_draws_are_32_bit_and_stable(spark):
    got = spark.range(3).select(draw(1, "p", F.col("id")).alias("d")).collect()
    import hashlib

    assert [r.d for r in got] == [int(hashlib.md5(f"1|p|{i}".encode()).hexdigest()[:8], 16) for i in range(3)]


def test_readers(spark, tmp_path):
    (tmp_path / "TT.a_trace.csv").write_text(
        " Timestamp,Service_Name,Span_ID,Parent_ID,Trace_ID,Duration,Status_Code,Operation_Name,Parent_Service_Name\n5,s,t,,t,1000,200,op,\n6,s2,b,t,t,bad,200,op,s\n"
    )
    got = sorted(source.read_span_csv(spark, f"{tmp_path}/*.csv", "TT").collect(), key=lambda r: r.timestamp)
    assert len(got) == 1 and got[0].source_run == "TT.a" and got[0].duration == 1000 and got[0].parent_id is None
    bad = source.refused_spans(spark, f"{tmp_path}/*.csv").collect()
    assert [(r.source_run, r.reason) for r in bad] == [("TT.a", "duration")] and '"bad"' in bad[0].record
    (tmp_path / "TT.b_trace.csv").write_text((tmp_path / "TT.a_trace.csv").read_text() + "7,s,x\n8,s,y,t,t,,,op,s,one too many\n9,s,z,t,t,,,op,s\n")
    counts = {r.source_run: (r.rows, r.refused) for r in source.csv_counts(spark, f"{tmp_path}/*.csv").collect()}
    assert counts == {"TT.a": (2, 1), "TT.b": (5, 3)}
    assert {r.reason for r in source.refused_spans(spark, f"{tmp_path}/TT.b*.csv").collect()} == {"fields", "duration"}
    (tmp_path / "bad_trace.csv2").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        source.normalise_header(spark.createDataFrame([(1,)], "a int"))
    trace = [{"traceID": "t", "processes": {"p": {"serviceName": "svc"}}, "spans": [
        {"spanID": "t", "processID": "p", "operationName": "o", "startTime": 5_999_999, "duration": 2.0, "references": [], "tags": [{"key": "http.status_code", "value": "404"}]},
        {"spanID": "b", "processID": "zz", "startTime": 7_000_000, "duration": 2.0, "references": [{"refType": "FOLLOWS_FROM", "spanID": "q"}, {"refType": "CHILD_OF", "spanID": "t"}], "tags": []}]}]
    (tmp_path / "SN.run.tar.json").write_text(json.dumps(trace))
    got = {r.span_id: r for r in source.read_trace_json(spark, f"{tmp_path}/*.tar.json", "SN").collect()}
    assert (got["t"].timestamp, got["t"].status_code, got["t"].parent_service_name, got["t"].source_run) == (5, 404, "no_parent", "SN.run")
    assert (got["b"].service_name, got["b"].operation_name, got["b"].parent_id, got["b"].parent_service_name) == ("unknown_service", "unknown_operation", "t", "svc")
    (tmp_path / "SN.torn.tar.json").write_text(json.dumps(trace)[:-7])
    assert {r.source_run for r in source.read_trace_json(spark, f"{tmp_path}/*.tar.json", "SN").collect()} == {"SN.run"}
    assert [r.source_run for r in source.refused_traces(spark, f"{tmp_path}/*.tar.json").collect()] == ["SN.torn"]
    (tmp_path / "TT.fault-b.json").write_text('{"faults": [{"start": "soon"}]}')
    assert [r.source_run for r in source.refused_faults(spark, f"{tmp_path}/TT.fault-*.json").collect()] == ["TT.fault-b"]
    (tmp_path / "TT.fault-a.json").write_text(json.dumps({"faults": [{"start": 1.0, "end": 2.0, "fault": "x"}]}))
    w = source.read_fault_windows(spark, f"{tmp_path}/TT.fault-a.json").first()
    assert (w.source_run, w.fault_idx, w.fault) == ("TT.a", 0, "x")


def test_corpus_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("g", "TT", "A", 1)], "graph_id string, system string, corpus string, label int")
    source.write_corpus(df, f"{tmp_path}/c")
    assert source.read_corpus(spark, f"{tmp_path}/c").count() == 1
    results = spark.createDataFrame([("TT", "g", 10, 1, 0.5), ("TT", "g", 20, 1, 0.6)], "system string, generator string, percent int, seed int, f1 double")
    for more in (0.0, 0.1):
        source.put_results(results.withColumn("f1", F.col("f1") + more), f"{tmp_path}/r")
    source.put_results(results.filter("percent = 20").withColumn("f1", F.lit(0.9)), f"{tmp_path}/r")
    got = source.read_results(spark, f"{tmp_path}/r", results.schema)
    assert got.schema == results.schema and {(r.percent, round(r.f1, 6)) for r in got.collect()} == {(10, 0.6), (20, 0.9)}


def test_zero_real_guard(spark):
    schema = "percent int, train_real_total long, val_source string, leaked long"
    for bad in ((0, 5, "synthetic", 0), (0, 0, "mixed", 0), (30, 5, "mixed", 1)):
        with pytest.raises(ValueError):
            corpora.check_zero_real(spark.createDataFrame([bad], schema))
    corpora.check_zero_real(spark.createDataFrame([(0, 0, "synthetic", 0), (30, 5, "mixed", 0)], schema))
    with pytest.raises(ValueError, match="percentages"):
        corpora.mix_targets(spark.createDataFrame([(1, 1)], "synth_pool long, real_pool long"), [101])


def test_many_edges_of_a_large_graph(spark):
    made = spark.createDataFrame([(0, 200), (1, 100), (2, 1)], "gen_id long, num_nodes long")
    wanted = spark.createDataFrame([(0, 300), (1, 9000), (2, 5)], "gen_id long, num_edges long")
    got = generate.random_edges(made, wanted, 1)
    assert {r.gen_id: r["count"] for r in got.groupBy("gen_id").count().collect()} == {0: 300, 1: 9000}
    assert got.distinct().count() == 9300 and got.filter("src = dst or src < 0 or dst < 0 or dst >= 200").isEmpty()


def test_sinks_of_small_tables(spark, tmp_path):
    rows = spark.createDataFrame([("TT", {"a": 0}, None), ("TT", {"a": 0}, "normal")], "system string, service_to_id map<string,int>, trace_label string")
    source.write_metadata(rows.drop("trace_label"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first().system == "TT"
    source.write_labelled(rows.drop("service_to_id").withColumn("x", F.lit(1)), f"{tmp_path}/l")
    assert {r.trace_label for r in spark.read.parquet(f"{tmp_path}/l").collect()} == {None, "normal"}
