"""Registered queries of the trace-corpus operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.draws import draw
from spanforge.operators import classify, corpora, distributions, edges, fidelity, generate, graphs, labels, memorization, metrics, sampling
from spanforge.plans.fixtures import FIXTURE_SQL, GENERATORS, SEED, Traces, draw_sql, traces
from spanforge.sources import spans
from spanforge.sources.shared import folder, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ["system"]
NODE_CAPS = [5, 8, 12]
PERCENTS = [0, 10, 30, 50, 70, 100]
BUCKETS = [(1, 3), (4, 8), (9, None)]
GENERATED = 2000


def query(sql: str | None = None):
    """Register a plan under its name, with the SQL that follows the fixture's tables."""

    def add(plan: Callable[[Traces], DataFrame]) -> Callable[[Traces], DataFrame]:
        name = plan.__name__
        QUERIES[name] = lambda spark, sf_dir: plan(traces(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = FIXTURE_SQL.rstrip() + sql
        return plan

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# Spans, labels, graphs


@query("\nSELECT graph_id, node_idx, span_id, service_name, operation_name, duration FROM spans")
def trace_nodes(t: Traces) -> DataFrame:
    return t.nodes.select("graph_id", "node_idx", "span_id", "service_name", "operation_name", "duration")


@query("\nSELECT graph_id, src, dst FROM edges")
def trace_edges(t: Traces) -> DataFrame:
    return t.edges


@query("\nSELECT source_run, trace_id, timestamp, round(end_sec, 6) AS end_sec FROM roots")
def root_spans(t: Traces) -> DataFrame:
    return rounded(labels.root_spans(t.spans), "end_sec")


@query("\nSELECT source_run, trace_id, timestamp, trace_label, fault_type FROM labels0")
def fault_labels(t: Traces) -> DataFrame:
    return t.labels


@query("""
SELECT system, coalesce(fault_type, 'unlabelled') AS fault_type, count(*) AS span_rows, count(DISTINCT source_run || trace_id) AS traces,
  count(*) FILTER (trace_label = 'normal') AS normal_spans, count(*) FILTER (trace_label = 'abnormal') AS abnormal_spans
FROM spans LEFT JOIN labels0 USING (source_run, trace_id) GROUP BY ALL""")
def ingest_summary(t: Traces) -> DataFrame:
    return labels.ingest_summary(labels.label_spans(t.spans, t.labels))


@query("""
, tr AS (SELECT DISTINCT system, source_run, trace_id, fault_type, source_kind FROM spans JOIN labels0 USING (source_run, trace_id))
SELECT system, 'fault_type' AS kind, fault_type AS value, count(*) AS traces FROM tr GROUP BY ALL
UNION ALL SELECT system, 'source_kind', source_kind, count(*) FROM tr GROUP BY ALL""")
def trace_value_counts(t: Traces) -> DataFrame:
    return labels.trace_value_counts(labels.label_spans(t.spans, t.labels))


@query("""
SELECT source_run, trace_id, span_id, trace_label FROM spans JOIN labels0 USING (source_run, trace_id) WHERE trace_label = 'abnormal'""")
def label_split(t: Traces) -> DataFrame:
    """The abnormal side of the split."""
    return labels.split_by_label(labels.label_spans(t.spans, t.labels))[1].select("source_run", "trace_id", "span_id", "trace_label")


@query("\nSELECT source_run, trace_id, span_id FROM spans WHERE source_run NOT IN (SELECT source_run FROM spans WHERE source_kind = 'no_fault_archive')")
def runs_anti_join(t: Traces) -> DataFrame:
    archived = t.spans.filter("source_kind = 'no_fault_archive'")
    return labels.without_archived_runs(t.spans, archived).select("source_run", "trace_id", "span_id")


@query("""
SELECT c.graph_id, c.node_idx, coalesce(p.service_name, 'no_parent') AS parent_service_name FROM spans c
LEFT JOIN spans p ON c.graph_id = p.graph_id AND c.parent_id = p.span_id""")
def parent_service(t: Traces) -> DataFrame:
    return graphs.parent_service(t.nodes)


@query("""
, sv AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT service_name AS name FROM spans)),
ov AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT operation_name AS name FROM spans))
SELECT graph_id, node_idx, sv.id AS service_id, ov.id AS op_id, duration FROM spans JOIN sv ON sv.name = service_name JOIN ov ON ov.name = operation_name""")
def vocab_ids(t: Traces) -> DataFrame:
    return graphs.encode(t.nodes, graphs.vocabulary([t.nodes], "service_name"), graphs.vocabulary([t.nodes], "operation_name"))


STATS_SQL = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in graphs.FEATURES)


@query(f"\nSELECT graph_id, {STATS_SQL} FROM stats")
def graph_stats(t: Traces) -> DataFrame:
    return rounded(graphs.graph_stats(t.nodes, t.edges), *graphs.FEATURES)


@query(f"""
SELECT system, corpus, threshold, count(*) AS total, count(*) FILTER (num_nodes <= threshold) AS kept, count(*) - count(*) FILTER (num_nodes <= threshold) AS filtered,
  round(100.0 * count(*) FILTER (num_nodes <= threshold) / count(*), 6) AS percent_kept
FROM graphs, (SELECT unnest({NODE_CAPS}) AS threshold) GROUP BY ALL""")
def node_cap_sensitivity(t: Traces) -> DataFrame:
    return graphs.size_sensitivity(t.graphs, NODE_CAPS)


@query("\nSELECT DISTINCT graph_id, src, dst FROM edges")
def distinct_edges(t: Traces) -> DataFrame:
    return graphs.distinct_edges(t.edges.union(t.edges))


@query("\nSELECT e.graph_id, src, dst FROM edges e JOIN graphs g USING (graph_id) WHERE src < (num_nodes + 1) // 2 AND dst < (num_nodes + 1) // 2")
def resized_edges(t: Traces) -> DataFrame:
    return graphs.resize(t.edges, t.graphs.select("graph_id", F.expr("(num_nodes + 1) div 2").alias("new_count")))


VOCAB_SQL = """, sv AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT service_name AS name FROM spans)),
ov AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT operation_name AS name FROM spans)),
enc AS (SELECT graph_id, node_idx, sv.id AS service_id, ov.id AS op_id, duration FROM spans JOIN sv ON sv.name = service_name JOIN ov ON ov.name = operation_name)
"""


@query(VOCAB_SQL + "SELECT max(service_id) + 1 AS num_services, max(op_id) + 1 AS num_operations FROM enc")
def vocab_sizes(t: Traces) -> DataFrame:
    return graphs.vocabulary_sizes(vocab_ids(t))


@query(VOCAB_SQL + "SELECT graph_id, node_idx, least(greatest(service_id, 0), 2) AS service_id, least(greatest(op_id, 0), 9) AS op_id, duration FROM enc")
def clipped_ids(t: Traces) -> DataFrame:
    return graphs.clip_ids(vocab_ids(t), 3, 10)


@query("\nSELECT e.graph_id, src, dst FROM edges e JOIN graphs g USING (graph_id) WHERE num_nodes BETWEEN 3 AND 8")
def size_filtered_edges(t: Traces) -> DataFrame:
    return graphs.keep_sizes(t.graphs, [t.edges], least=3, most=8)[0]


@query("\nSELECT graph_id, CASE WHEN corpus = 'A' THEN 0 ELSE 1 END AS label FROM graphs")
def label_override(t: Traces) -> DataFrame:
    real, synth = (t.graphs.filter(F.col("corpus") == c) for c in "AB")
    return corpora.label_by_corpus(real, 0).unionByName(corpora.label_by_corpus(synth, 1)).select("graph_id", "label")


@query("""
, v AS (SELECT system, count(DISTINCT service_name) AS num_services, count(DISTINCT operation_name) AS num_operations,
  string_agg(DISTINCT operation_name, ',' ORDER BY operation_name) AS operations FROM spans GROUP BY ALL),
c AS (SELECT system, count(*) FILTER (label = 0) AS normal_graphs, count(*) FILTER (label = 1) AS abnormal_graphs FROM graphs GROUP BY ALL)
SELECT system, normal_graphs, abnormal_graphs, num_services, num_operations, operations FROM c JOIN v USING (system)""")
def system_metadata(t: Traces) -> DataFrame:
    names = F.expr("transform(array_sort(map_entries(op_to_id), (a, b) -> a.value - b.value), e -> e.key)")
    return graphs.metadata(t.graphs, t.nodes).select("system", "normal_graphs", "abnormal_graphs", "num_services", "num_operations", F.array_join(names, ",").alias("operations"))


# Two-sample distances, cell by cell: system, generator, class and both classes together


CELL_SQL = """, gens AS (SELECT DISTINCT system, generator FROM graphs WHERE corpus = 'B'),
cells AS (SELECT graph_id, system, generator, unnest([CASE WHEN label = 1 THEN 'abnormal' ELSE 'normal' END, 'combined']) AS trace_class, side
  FROM (SELECT g.graph_id, g.system, x.generator, g.label, g.corpus AS side FROM graphs g JOIN gens x ON x.system = g.system AND (g.corpus = 'A' OR g.generator = x.generator)))
"""
CELL = "system, generator, trace_class"
_IN_CELL = "cells.system, cells.generator, cells.trace_class, cells.side"
LONG_SQL = (
    CELL_SQL + ", long AS ("
    + " UNION ALL ".join(f"SELECT {_IN_CELL}, '{c}' AS metric, round({c}::DOUBLE, 9) AS value FROM stats JOIN cells USING (graph_id)" for c in graphs.FEATURES)
    + f""" UNION ALL SELECT {_IN_CELL}, 'all_degrees', (indegree + outdegree)::DOUBLE FROM deg JOIN cells USING (graph_id)
  UNION ALL SELECT {_IN_CELL}, 'all_durations', duration FROM spans JOIN cells USING (graph_id)),
cnt AS (SELECT {CELL}, metric, value, count(*) FILTER (side = 'A') AS na, count(*) FILTER (side = 'B') AS nb FROM long GROUP BY ALL),
steps AS (SELECT *, sum(na) OVER w / sum(na) OVER m AS fa, sum(nb) OVER w / sum(nb) OVER m AS fb, coalesce(lead(value) OVER w, value) - value AS dx
  FROM cnt WINDOW w AS (PARTITION BY {CELL}, metric ORDER BY value), m AS (PARTITION BY {CELL}, metric)),
scales AS (SELECT {CELL}, metric, greatest(stddev_pop(value), abs(avg(value) FILTER (side = 'A')), abs(avg(value) FILTER (side = 'B')), 1e-9) AS scale FROM long GROUP BY ALL),
ecdf AS (SELECT {CELL}, metric, coalesce(1 - max(abs(fa - fb)), 0) AS ks, coalesce(greatest(1 - sum(abs(fa - fb) * dx) / any_value(scale), 0), 0) AS ws,
  coalesce(sum(abs(fa - fb) * dx), 0) AS wd FROM steps JOIN scales USING ({CELL}, metric) GROUP BY ALL)
"""
)


def _ecdf(t: Traces) -> DataFrame:
    counted = fidelity.value_counts(t.stats, t.grouped_nodes, t.edges)
    return distributions.ecdf_distances(fidelity.cell_counts(counted, fidelity.generators_of(t.graphs)), [*fidelity.CELL, "metric"])


@query(LONG_SQL + f"SELECT {CELL}, metric, round(ks, 6) AS ks_similarity FROM ecdf WHERE metric NOT LIKE 'all%'")
def ks_graph_metrics(t: Traces) -> DataFrame:
    return rounded(_ecdf(t).filter("metric not like 'all%'").drop("wasserstein_similarity", "wasserstein_distance"), "ks_similarity")


@query(LONG_SQL + f"SELECT {CELL}, metric, round(ks, 6) AS ks_similarity FROM ecdf WHERE metric LIKE 'all%'")
def ks_value_bags(t: Traces) -> DataFrame:
    return rounded(_ecdf(t).filter("metric like 'all%'").drop("wasserstein_similarity", "wasserstein_distance"), "ks_similarity")


@query(LONG_SQL + f"""SELECT {CELL}, metric, round(ws, 6) AS wasserstein_similarity, round(wd, 6) AS wasserstein_distance FROM ecdf
WHERE metric IN ('node_count', 'edge_count', 'density', 'mean_degree')""")
def wasserstein_metrics(t: Traces) -> DataFrame:
    rows = _ecdf(t).filter(F.col("metric").isin(*fidelity.WASSERSTEIN)).drop("ks_similarity")
    return rounded(rows, "wasserstein_similarity", "wasserstein_distance")


JS_SQL = f""", bags AS (
  SELECT {_IN_CELL}, unnest([('service', service_name), ('operation', operation_name), ('service_operation', to_json([service_name, operation_name])::VARCHAR)]) AS b FROM spans JOIN cells USING (graph_id)),
bc AS (SELECT {CELL}, b[1] AS metric, b[2] AS value, count(*) FILTER (side = 'A') AS na, count(*) FILTER (side = 'B') AS nb FROM bags GROUP BY ALL),
pq AS (SELECT {CELL}, metric, (coalesce(na / nullif(sum(na) OVER g, 0), 0) + 1e-12) / (CASE WHEN sum(na) OVER g > 0 THEN 1 ELSE 0 END + 1e-12 * count(*) OVER g) AS p,
  (coalesce(nb / nullif(sum(nb) OVER g, 0), 0) + 1e-12) / (CASE WHEN sum(nb) OVER g > 0 THEN 1 ELSE 0 END + 1e-12 * count(*) OVER g) AS q FROM bc WINDOW g AS (PARTITION BY {CELL}, metric)),
js AS (SELECT {CELL}, metric, 1 - sqrt(greatest(sum(p * log2(p / ((p + q) / 2)) / 2 + q * log2(q / ((p + q) / 2)) / 2), 0)) AS js FROM pq GROUP BY ALL),
vm AS (SELECT {CELL}, coalesce(sum(nb) FILTER (na > 0) / nullif(sum(nb), 0), 0) AS vm FROM bc WHERE metric = 'service_operation' GROUP BY ALL)
"""


@query(CELL_SQL + JS_SQL + f"SELECT {CELL}, metric, round(js, 6) AS js_similarity FROM js")
def js_labels(t: Traces) -> DataFrame:
    counted = fidelity.cell_counts(fidelity.label_counts(t.grouped_nodes), fidelity.generators_of(t.graphs))
    return rounded(distributions.js_similarity(counted, [*fidelity.CELL, "metric"]), "js_similarity")


@query("""
SELECT count(*) AS nodes, round(avg(CASE WHEN p.service_name IS NULL THEN 0.0 ELSE 1.0 END), 6) AS valid_mass FROM (SELECT * FROM spans WHERE corpus = 'B') s
LEFT JOIN (SELECT DISTINCT service_name, operation_name FROM spans WHERE corpus = 'A') p USING (service_name, operation_name)""")
def valid_mass(t: Traces) -> DataFrame:
    return rounded(memorization.valid_mass(t.nodes.filter("corpus = 'B'"), t.nodes.filter("corpus = 'A'")), "valid_mass")


def _mmd_sql() -> str:
    """The kernel statistic on eleven features, 800 graphs a side."""
    logged = ("node_count", "edge_count", "mean_duration", "std_duration")
    f = {f"f{k}": f"ln(1 + greatest({c}, 0))" if c in logged else f"{c}::DOUBLE" for k, c in enumerate(graphs.FEATURES)}
    return f""", mf AS (SELECT {_IN_CELL}, graph_id, {", ".join(f"{v} AS {k}" for k, v in f.items())} FROM stats JOIN cells USING (graph_id)),
mr AS (SELECT *, row_number() OVER (PARTITION BY {CELL}, side ORDER BY {draw_sql("mmd", "graph_id")}, graph_id) AS rk,
  {", ".join(f"({k} - avg({k}) OVER s) / (stddev_pop({k}) OVER s + 1e-9) AS z{k}" for k in f)} FROM mf WINDOW s AS (PARTITION BY {CELL})),
mc AS (SELECT * FROM mr WHERE rk <= 800),
mp AS (SELECT x.system, x.generator, x.trace_class, x.side AS sx, y.side AS sy, {" + ".join(f"(x.z{k} - y.z{k}) * (x.z{k} - y.z{k})" for k in f)} AS d2
  FROM mc x JOIN mc y ON x.system = y.system AND x.generator = y.generator AND x.trace_class = y.trace_class),
mw AS (SELECT {CELL}, quantile_cont(d2, 0.5) FILTER (d2 > 0) AS med FROM mp GROUP BY ALL),
mk AS (SELECT {CELL}, sx, sy, exp(-d2 / (2 * coalesce(med, 1))) AS k FROM mp JOIN mw USING ({CELL})),
ma AS (SELECT {CELL}, greatest(avg(k) FILTER (sx = 'A' AND sy = 'A') + avg(k) FILTER (sx = 'B' AND sy = 'B') - 2 * avg(k) FILTER (sx = 'A' AND sy = 'B'), 0) AS d,
  count(DISTINCT sx) AS sides FROM mk GROUP BY ALL),
mmd AS (SELECT {CELL}, CASE WHEN sides = 2 THEN d ELSE 0 END AS d, CASE WHEN sides = 2 THEN exp(-d) ELSE 0 END AS mmd FROM ma)
"""


MMD_SQL = _mmd_sql()


@query(CELL_SQL + MMD_SQL + f"SELECT {CELL}, round(mmd, 6) AS mmd_similarity, round(d, 6) AS mmd FROM mmd")
def mmd_features(t: Traces) -> DataFrame:
    return rounded(fidelity.kernel_similarity(t.stats, fidelity.generators_of(t.graphs), SEED), "mmd_similarity", "mmd")


def _compare_sql() -> str:
    bags = (*graphs.FEATURES, "all_degrees", "all_durations")

    def one(metric: str, column: str) -> str:
        return f"max({column}) FILTER (metric = '{metric}')"

    ks = {f"{m}_ks_similarity": one(m, "ks") for m in bags} | {f"{m}_ks_stat": f"1 - {one(m, 'ks')}" for m in bags}
    ws = {f"{m}_wasserstein_{n}": one(m, c) for m in ("node_count", "edge_count", "density", "mean_degree") for n, c in (("similarity", "ws"), ("distance", "wd"))}
    js = {f"{m}_js_similarity": one(m, "js") for m in ("service", "operation", "service_operation")}
    structure = [f"{m}_ks_similarity" for m in ("node_count", "edge_count", "density", "mean_degree", "max_degree", "all_degrees")]
    columns = [*ks, *ws, *js, "service_operation_valid_mass", "graph_feature_mmd_similarity", "graph_feature_mmd", "structure_mean", "timing_mean", "semantic_mean", "overall_fidelity"]
    return f""", e1 AS (SELECT {CELL}, {", ".join(f"{v} AS {k}" for k, v in (ks | ws).items())} FROM ecdf GROUP BY ALL),
j1 AS (SELECT {CELL}, {", ".join(f"{v} AS {k}" for k, v in js.items())} FROM js GROUP BY ALL),
n1 AS (SELECT {CELL}, count(*) FILTER (side = 'A') AS real_graphs, count(*) FILTER (side = 'B') AS synthetic_graphs FROM cells GROUP BY ALL),
row1 AS (SELECT *, vm AS service_operation_valid_mass, mmd AS graph_feature_mmd_similarity, d AS graph_feature_mmd, ({" + ".join(structure)} + mmd) / 7 AS structure_mean,
  (mean_duration_ks_similarity + all_durations_ks_similarity) / 2 AS timing_mean, ({" + ".join(js)} + vm) / 4 AS semantic_mean
  FROM n1 JOIN e1 USING ({CELL}) JOIN j1 USING ({CELL}) JOIN vm USING ({CELL}) JOIN mmd USING ({CELL})),
cmp AS (SELECT *, (structure_mean + timing_mean + semantic_mean) / 3 AS overall_fidelity FROM row1)
SELECT {CELL}, real_graphs, synthetic_graphs, {", ".join(f"round({c}, 6) AS {c}" for c in columns)} FROM cmp"""


COMPARE_SQL = LONG_SQL + JS_SQL + MMD_SQL + _compare_sql()


@query(COMPARE_SQL)
def fidelity_compare(t: Traces) -> DataFrame:
    rows = fidelity.compare(t.stats, t.grouped_nodes, t.edges, SEED)
    return rounded(rows, *[c for c in rows.columns if c not in (*fidelity.CELL, "real_graphs", "synthetic_graphs")])


@query(f"{COMPARE_SQL[: COMPARE_SQL.rindex('SELECT')]}SELECT {CELL}, " + ", ".join(f"round({c}, 6) AS {c}" for c in fidelity.MEANS) + " FROM cmp")
def fidelity_rollup(t: Traces) -> DataFrame:
    return rounded(fidelity.compare(t.stats, t.grouped_nodes, t.edges, SEED).select(*fidelity.CELL, *fidelity.MEANS), *fidelity.MEANS)


CAPPED_SQL = COMPARE_SQL.replace("FROM graphs g JOIN gens x", f"""FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, corpus, generator, label
  ORDER BY {draw_sql("max-graphs", "graph_id")}, graph_id) AS mx FROM graphs) WHERE mx <= 60) g JOIN gens x""")


@query(CAPPED_SQL)
def fidelity_capped(t: Traces) -> DataFrame:
    """At most 60 graphs of each side of a class."""
    rows = fidelity.compare(t.stats, t.grouped_nodes, t.edges, SEED, max_graphs=60)
    return rounded(rows, *[c for c in rows.columns if c not in (*fidelity.CELL, "real_graphs", "synthetic_graphs")])


# Memorization

SETS_SQL = """, es AS (SELECT g.graph_id, g.corpus, coalesce(l.edge_label, '<empty>') AS token FROM graphs g LEFT JOIN (SELECT DISTINCT graph_id, edge_label FROM elabels) l USING (graph_id)),
ns AS (SELECT DISTINCT graph_id, corpus, label AS token FROM nlabels),
ez AS (SELECT graph_id, count(*) AS z FROM es GROUP BY ALL), nz AS (SELECT graph_id, count(*) AS z FROM ns GROUP BY ALL),
ej AS (SELECT b.graph_id AS g, a.graph_id AS r, count(*) / (any_value(zb.z) + any_value(za.z) - count(*)) AS j FROM es b JOIN es a USING (token) JOIN ez zb ON zb.graph_id = b.graph_id JOIN ez za ON za.graph_id = a.graph_id
  WHERE b.corpus = 'B' AND a.corpus = 'A' GROUP BY ALL),
nj AS (SELECT b.graph_id AS g, a.graph_id AS r, count(*) / (any_value(zb.z) + any_value(za.z) - count(*)) AS j FROM ns b JOIN ns a USING (token) JOIN nz zb ON zb.graph_id = b.graph_id JOIN nz za ON za.graph_id = a.graph_id
  WHERE b.corpus = 'B' AND a.corpus = 'A' GROUP BY ALL),
near AS (SELECT graph_id, coalesce(max(j), 0.0) AS nearest FROM graphs LEFT JOIN ej ON ej.g = graph_id WHERE corpus = 'B' GROUP BY ALL),
sigs AS (SELECT g.graph_id, g.corpus, md5(coalesce(n.s, '') || '#' || coalesce(e.s, '')) AS sig FROM graphs g
  LEFT JOIN (SELECT graph_id, string_agg(label, ',' ORDER BY label) AS s FROM nlabels GROUP BY ALL) n USING (graph_id)
  LEFT JOIN (SELECT graph_id, string_agg(edge_label, ',' ORDER BY edge_label) AS s FROM elabels GROUP BY ALL) e USING (graph_id)),
dups AS (SELECT graph_id, sig, sig IN (SELECT sig FROM sigs WHERE corpus = 'A') AS exact FROM sigs WHERE corpus = 'B')
"""


def _duplicates(t: Traces) -> DataFrame:
    """Corpus B against A by signature; a plan, nothing is written."""
    return memorization.duplicates(memorization.signatures(*t.side("B")), memorization.signatures(*t.side("A")))


def _nearest(t: Traces) -> DataFrame:
    """Corpus B against A by edge labels."""
    (ga, _, ea), (gb, _, eb) = t.side("A"), t.side("B")
    return memorization.nearest_jaccard(memorization.token_sets(gb, eb, "edge_label"), memorization.token_sets(ga, ea, "edge_label"))


@query(SETS_SQL + "SELECT graph_id, exact FROM dups")
def signature_dups(t: Traces) -> DataFrame:
    return _duplicates(t).select("graph_id", "exact")


@query(SETS_SQL + "SELECT graph_id, round(nearest, 6) AS nearest FROM near")
def nearest_jaccard(t: Traces) -> DataFrame:
    return rounded(_nearest(t), "nearest")


COMBINED_SQL = """, both0 AS (SELECT coalesce(ej.g, nj.g) AS g, max(0.7 * coalesce(ej.j, 0) + 0.3 * coalesce(nj.j, 0)) AS nearest FROM ej FULL JOIN nj ON ej.g = nj.g AND ej.r = nj.r GROUP BY 1),
comb AS (SELECT graph_id, coalesce(nearest, 0.0) AS nearest FROM graphs LEFT JOIN both0 ON g = graph_id WHERE corpus = 'B')
"""


def _sets(t: Traces) -> list[tuple[DataFrame, DataFrame]]:
    """(edge sets, node sets) of corpus B and of corpus A."""
    return [(memorization.token_sets(g, e, "edge_label"), memorization.token_sets(g, n, "label")) for g, n, e in (t.side("B"), t.side("A"))]


def _combined(t: Traces) -> DataFrame:
    return memorization.combined_similarity(*_sets(t))


@query(SETS_SQL + COMBINED_SQL + "SELECT graph_id, round(nearest, 6) AS nearest FROM comb")
def combined_similarity(t: Traces) -> DataFrame:
    return rounded(_combined(t), "nearest")


@query(SETS_SQL + """SELECT count(*) AS graphs, round(count(DISTINCT sig) / count(*), 6) AS unique_rate, round(avg(exact::INT), 6) AS exact_rate, round(1 - avg(exact::INT), 6) AS novel_rate,
  round(avg((nearest >= 0.9)::INT), 6) AS near_rate, round(avg(nearest), 6) AS mean_nearest FROM dups JOIN near USING (graph_id)""")
def memorization_report(t: Traces) -> DataFrame:
    return rounded(memorization.report(_duplicates(t), _nearest(t), 0.9), "unique_rate", "exact_rate", "novel_rate", "near_rate", "mean_nearest")


@query(SETS_SQL + COMBINED_SQL + "SELECT graph_id, CASE WHEN exact THEN 'exact' WHEN nearest >= 0.95 THEN 'near' ELSE 'kept' END AS status FROM dups JOIN comb USING (graph_id)")
def filter_corpus(t: Traces) -> DataFrame:
    return memorization.filter_corpus(_duplicates(t), memorization.similar_graphs(*_sets(t), 0.95))


@query(SETS_SQL + "SELECT graph_id, CASE WHEN exact THEN 'exact' ELSE 'kept' END AS status FROM dups")
def filter_exact(t: Traces) -> DataFrame:
    return memorization.filter_corpus(_duplicates(t), None)


@query(SETS_SQL + COMBINED_SQL + """, fr AS (SELECT d.graph_id, sig, exact, nearest, nearest >= 0.95 AND NOT exact AS near FROM dups d JOIN comb USING (graph_id)),
ph AS (SELECT 'before' AS phase, * FROM fr UNION ALL SELECT 'after', * FROM fr WHERE NOT exact AND NOT near),
rk AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY nearest) - 1 AS i, count(*) OVER (PARTITION BY phase) AS n FROM ph)
SELECT phase, count(*) AS graphs, count(*) FILTER (exact) AS exact_graphs, count(*) FILTER (near) AS near_graphs, round(count(DISTINCT sig) / count(*), 6) AS unique_rate,
  round(avg(exact::INT), 6) AS exact_rate, round(avg((nearest >= 0.95)::INT), 6) AS near_rate, round(avg(nearest), 6) AS mean_nearest,
  round(max(nearest) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)), 6) AS p95_nearest FROM rk GROUP BY ALL""")
def filter_report(t: Traces) -> DataFrame:
    return rounded(memorization.filter_report(_duplicates(t), _combined(t), 0.95), "unique_rate", "exact_rate", "near_rate", "mean_nearest", "p95_nearest")


@query(SETS_SQL + "SELECT round(nearest, 6) AS percentile FROM (SELECT nearest, row_number() OVER (ORDER BY nearest) - 1 AS i, count(*) OVER () AS n FROM near) WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)")
def nearest_p95(t: Traces) -> DataFrame:
    return rounded(memorization.nearest_rank_percentile(_nearest(t), "nearest", 0.95), "percentile")


@query("""
SELECT count(*) AS real_items, round(avg((edge_label IN (SELECT edge_label FROM elabels WHERE corpus = 'B'))::INT), 6) AS coverage FROM (SELECT DISTINCT edge_label FROM elabels WHERE corpus = 'A')""")
def coverage(t: Traces) -> DataFrame:
    return rounded(memorization.coverage(t.side("B")[2], t.side("A")[2], "edge_label"), "coverage")


@query("""
SELECT count(*) AS real_items, round(avg((label IN (SELECT label FROM nlabels WHERE corpus = 'B'))::INT), 6) AS coverage FROM (SELECT DISTINCT label FROM nlabels WHERE corpus = 'A')""")
def node_coverage(t: Traces) -> DataFrame:
    return rounded(memorization.coverage(t.side("B")[1], t.side("A")[1], "label"), "coverage")


@query(SETS_SQL + """, gc AS (SELECT graph_id, corpus, system, label AS class FROM graphs), nc AS (
SELECT b.graph_id, any_value(b.system) AS system, any_value(b.class) AS class, coalesce(max(j) FILTER (a.system = b.system AND a.class = b.class), 0.0) AS nearest
  FROM gc b LEFT JOIN ej ON ej.g = b.graph_id LEFT JOIN gc a ON a.graph_id = ej.r WHERE b.corpus = 'B' GROUP BY b.graph_id),
sc AS (SELECT g.*, s.sig FROM gc g JOIN sigs s USING (graph_id)),
sd AS (SELECT *, EXISTS (SELECT 1 FROM sc a WHERE a.corpus = 'A' AND a.system = b.system AND a.class = b.class AND a.sig = b.sig) AS exact FROM sc b WHERE corpus = 'B'),
ms AS (SELECT d.system, d.class, count(*) AS synthetic_graphs, count(DISTINCT sig) / count(*) AS unique_rate, avg(exact::INT) AS exact_rate, avg((nearest >= 0.9)::INT) AS near_rate, avg(nearest) AS mean_nearest
  FROM sd d JOIN nc USING (graph_id) GROUP BY ALL),
mr AS (SELECT system, class, count(*) AS real_graphs FROM gc WHERE corpus = 'A' GROUP BY ALL),
cn AS (SELECT system, class, l.label AS item, bool_or(g.corpus = 'A') AS held, bool_or(g.corpus = 'B') AS made FROM nlabels l JOIN gc g USING (graph_id) GROUP BY ALL),
ce AS (SELECT system, class, edge_label AS item, bool_or(g.corpus = 'A') AS held, bool_or(g.corpus = 'B') AS made FROM elabels l JOIN gc g USING (graph_id) GROUP BY ALL),
vn AS (SELECT system, class, avg(made::INT) AS node_coverage FROM cn WHERE held GROUP BY ALL), ve AS (SELECT system, class, avg(made::INT) AS edge_coverage FROM ce WHERE held GROUP BY ALL)
SELECT system, class AS label, coalesce(real_graphs, 0) AS real_graphs, coalesce(synthetic_graphs, 0) AS synthetic_graphs, round(coalesce(unique_rate, 0), 6) AS unique_rate, round(coalesce(exact_rate, 0), 6) AS exact_rate,
  round(coalesce(1 - exact_rate, 0), 6) AS novel_rate, round(coalesce(near_rate, 0), 6) AS near_rate, round(coalesce(mean_nearest, 0), 6) AS mean_nearest,
  round(coalesce(node_coverage, 0), 6) AS node_coverage, round(coalesce(edge_coverage, 0), 6) AS edge_coverage
FROM ms FULL JOIN mr USING (system, class) LEFT JOIN vn USING (system, class) LEFT JOIN ve USING (system, class)""")
def memorization_by_class(t: Traces) -> DataFrame:
    """One row per system and class, with both coverages."""
    rows = memorization.report_by(t.graphs.select("graph_id", "corpus", "system", "label"), t.node_labels, t.edge_labels, ["system", "label"], 0.9)
    return rounded(rows, *[c for c in rows.columns if c.endswith(("_rate", "_nearest", "_coverage"))])


# Sampling, splitting, mixing


@query(f"\nSELECT graph_id, corpus FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY {draw_sql('sample', 'graph_id')}, graph_id) AS rk FROM graphs) WHERE rk <= 300")
def sample_exact_k(t: Traces) -> DataFrame:
    return sampling.take_count(t.graphs.select("graph_id", "corpus"), ["corpus"], 300, SEED, "sample")


@query(f"""
SELECT graph_id, corpus FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY {draw_sql('fraction', 'graph_id')}, graph_id) AS rk, count(*) OVER (PARTITION BY corpus) AS n FROM graphs)
WHERE rk <= greatest(1, CAST(floor(n * 0.25::DOUBLE) AS BIGINT))""")
def sample_fraction(t: Traces) -> DataFrame:
    return sampling.take_fraction(t.graphs.select("graph_id", "corpus"), ["corpus"], 0.25, SEED, "fraction")


RECIPE = corpora.Recipe(seed=SEED, min_nodes=2)


def _half(purpose: str, source: str, ratio: str, rest: str, seed: int = SEED) -> str:
    """A split per label in draw order: the first int(n * ratio) train, the others are ``rest``."""
    return f"""SELECT graph_id, corpus, label, num_nodes, CASE WHEN rk <= CAST(floor(n * {ratio}::DOUBLE) AS BIGINT) THEN 'train' ELSE '{rest}' END AS pool FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(purpose, "graph_id", seed=seed)}, graph_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM {source})"""


def _by_class(n: str, a: str, target: str) -> tuple[str, str]:
    """How many of each label make a target."""
    first = f"coalesce(least(CAST(round_even({target} * ({n} / nullif({n} + {a}, 0)::DOUBLE), 0) AS BIGINT), {n}), 0)"
    second = f"least({a}, {target} - {first})"
    more = f"least({n} - {first}, {target} - {first} - {second})"
    return f"{first} + {more}", f"{second} + least({a} - {second}, {target} - {first} - {second} - {more})"


def _prepared_sql() -> str:
    cells = [f"{c}{p}{k}" for c in "AB" for p in ("train", "val") for k in (0, 1)]
    counts = ", ".join(f"count(*) FILTER (corpus = '{x[0]}' AND pool = '{x[1:-1]}' AND label = {x[-1]}) AS {x}" for x in cells)
    takes = {}
    for part, target in (("Atrain", "train_real"), ("Btrain", "train_synth"), ("Aval", "val_real")):
        takes[f"{part}0"], takes[f"{part}1"] = _by_class(f"{part}0", f"{part}1", target)
    for k in (0, 1):
        takes[f"Bval{k}"] = f"CASE WHEN percent = 100 THEN 0 ELSE Bval{k} END"
    limit = " ".join(f"WHEN r.corpus = '{x[0]}' AND r.pool = '{x[1:-1]}' AND r.label = {x[-1]} THEN take_{x}" for x in cells)
    h = f"CASE WHEN pool = 'val' THEN {draw_sql('mix-val', 'graph_id', seed=SEED + 99)} ELSE {draw_sql('mix', 'graph_id')} END"
    return f""", sized AS (SELECT * FROM graphs WHERE num_nodes >= 2), synth AS (SELECT * FROM sized WHERE corpus = 'B'), held AS (SELECT * FROM sized WHERE corpus = 'A'),
hold AS ({_half("holdout", "held", "0.8", "test")}), seen AS (SELECT * FROM hold WHERE pool = 'train'),
pools AS ({_half("synth-val", "synth", "0.8", "val")} UNION ALL {_half("real-val", "seen", "0.9", "val", SEED + 1)} UNION ALL SELECT * FROM hold WHERE pool = 'test'),
sums AS (SELECT *, Btrain0 + Btrain1 AS sp, Atrain0 + Atrain1 AS rp FROM (SELECT {counts} FROM pools)),
tot AS (SELECT *, CASE WHEN percent = 0 THEN sp WHEN percent = 100 THEN rp
  ELSE CAST(floor(least(sp / ((100.0::DOUBLE - percent) / 100.0::DOUBLE), rp / (percent / 100.0::DOUBLE))) AS BIGINT) END AS total
  FROM (SELECT *, unnest({PERCENTS}) AS percent FROM sums)),
sides AS (SELECT *, CASE WHEN percent = 0 THEN 0 WHEN percent = 100 THEN rp ELSE least(CAST(round_even(total * percent::DOUBLE / 100.0::DOUBLE, 0) AS BIGINT), rp) END AS train_real,
  CASE WHEN percent = 100 THEN 0 WHEN percent = 0 THEN sp ELSE least(CAST(round_even(total * (100.0::DOUBLE - percent) / 100.0::DOUBLE, 0) AS BIGINT), sp) END AS train_synth,
  CASE WHEN percent = 0 THEN 0 WHEN percent = 100 THEN Aval0 + Aval1
  ELSE CAST(round_even((Bval0 + Bval1) * percent::DOUBLE / (100.0::DOUBLE - percent), 0) AS BIGINT) END AS val_real FROM tot),
takes AS (SELECT percent, {", ".join(f"{v} AS take_{k}" for k, v in takes.items())} FROM sides),
ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus, label, pool ORDER BY {h}, graph_id) AS rk FROM pools WHERE pool <> 'test'),
prepared AS (SELECT percent, graph_id, corpus, label, num_nodes, pool AS role FROM ranked r, takes WHERE rk <= CASE {limit} END
  UNION ALL SELECT percent, graph_id, corpus, label, num_nodes, pool FROM pools, takes WHERE pool = 'test')
"""


PREPARED_SQL = _prepared_sql()


def _prepared(t: Traces) -> DataFrame:
    return corpora.prepare(t.graphs.select("graph_id", "corpus", "label", "num_nodes"), PERCENTS, RECIPE)


@query(PREPARED_SQL + "SELECT graph_id, corpus, label, role FROM prepared WHERE percent = 30")
def split_roles(t: Traces) -> DataFrame:
    return corpora.prepare(t.graphs.select("graph_id", "corpus", "label", "num_nodes"), [30], RECIPE).select("graph_id", "corpus", "label", "role")


@query(PREPARED_SQL + "SELECT percent, graph_id, corpus, label, role FROM prepared")
def mix_sweep(t: Traces) -> DataFrame:
    return _prepared(t).select("percent", "graph_id", "corpus", "label", "role")


def _summary_sql() -> str:
    names = [(r, c, s) for r in ("train", "val", "test") for s in ("synth", "real") for c in ("normal", "abnormal") if (r, s) != ("test", "synth")]
    counts = [f"count(*) FILTER (role = '{r}' AND label = {int(c == 'abnormal')} AND corpus = '{'A' if s == 'real' else 'B'}') AS {r}_{c}_{s}" for r, c, s in names]
    counts += [f"count(*) FILTER (role = 'train' AND corpus = '{c}') AS train_{s}_total" for c, s in (("B", "synth"), ("A", "real"))]
    return f"""SELECT percent, {", ".join(counts)}, count(*) - count(DISTINCT graph_id) AS leaked,
  CASE WHEN percent = 0 THEN 'synthetic' WHEN percent = 100 THEN 'real' ELSE 'mixed' END AS val_source FROM prepared GROUP BY ALL"""


@query(PREPARED_SQL + _summary_sql())
def split_summary(t: Traces) -> DataFrame:
    return corpora.split_summary(_prepared(t))


@query(PREPARED_SQL + "SELECT percent, 4 AS min_nodes_filter, " + ", ".join(
    f"count(*) FILTER (role = '{r}' AND num_nodes >= 4{w}) AS {r}_{n}_after_filter" for r in ("train", "val", "test") for n, w in (("total", ""), ("normal", " AND label = 0"), ("abnormal", " AND label = 1"))
) + " FROM prepared GROUP BY ALL")
def filtered_summary(t: Traces) -> DataFrame:
    return corpora.filtered_summary(_prepared(t), 4)


@query(PREPARED_SQL + "SELECT DISTINCT e.graph_id, src, dst FROM edges e SEMI JOIN prepared USING (graph_id)")
def dense_edges(t: Traces) -> DataFrame:
    rows = t.graphs.select("graph_id", "corpus", "label", "num_nodes")
    return corpora.prepare_dense(rows, t.edges.union(t.edges), PERCENTS, RECIPE)[1]


@query(f""", s0 AS (SELECT * FROM graphs WHERE num_nodes >= 2), cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql("cap", "graph_id")}, graph_id) AS c FROM s0 WHERE corpus = 'B') WHERE c <= 150),
held AS (SELECT * FROM s0 WHERE corpus = 'A'), hold AS ({_half("holdout", "held", "0.1", "test")}),
tests AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql("test", "graph_id")}, graph_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM hold WHERE pool = 'test')
SELECT graph_id, corpus, label, pool AS role FROM ({_half("synth-val", "cap", "0.8", "val")}) UNION ALL SELECT graph_id, corpus, label, pool FROM hold WHERE pool = 'train'
UNION ALL SELECT graph_id, corpus, label, pool FROM tests WHERE rk <= greatest(1, CAST(floor(n * 0.5::DOUBLE) AS BIGINT))""")
def split_plain(t: Traces) -> DataFrame:
    """Without percentages: a plain training share of real graphs, a cap per synthetic class, half the test graphs."""
    recipe = corpora.Recipe(seed=SEED, min_nodes=2, max_synth_per_class=150, test_fraction=0.5)
    return corpora.prepare_plain(t.graphs.select("graph_id", "corpus", "label", "num_nodes"), recipe).select("graph_id", "corpus", "label", "role")


@query("""
SELECT system, 1000::BIGINT AS normal, greatest(1, CAST(round_even(1000 * coalesce(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label = 0), 0), 0)::DOUBLE, 0) AS BIGINT)) AS abnormal
FROM graphs GROUP BY ALL""")
def proportional_target(t: Traces) -> DataFrame:
    return sampling.proportional_target(t.graphs, 1000, ["system"])


@query(f"""
, c AS (SELECT system, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS abnormal FROM graphs GROUP BY ALL),
w AS (SELECT *, least(500, normal + abnormal) AS wanted FROM c)
SELECT system, normal, abnormal, {_by_class("normal", "abnormal", "wanted")[0]} AS take_normal, {_by_class("normal", "abnormal", "wanted")[1]} AS take_abnormal FROM w""")
def class_allocation(t: Traces) -> DataFrame:
    counts = t.graphs.groupBy("system").agg(F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("abnormal"))
    return sampling.allocate(counts, F.lit(500))


@query(f"""
, b AS (SELECT *, CASE WHEN num_nodes <= 3 THEN 0 WHEN num_nodes <= 8 THEN 1 ELSE 2 END AS bucket FROM graphs),
i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {draw_sql('index', 'graph_id')}, graph_id) - 1 AS idx, count(*) OVER (PARTITION BY bucket) AS pool FROM b),
s AS (SELECT bucket, pool, row_number() OVER (ORDER BY bucket) - 1 AS nth, count(*) OVER () AS ranges FROM (SELECT DISTINCT bucket, pool FROM i)),
d AS (SELECT bucket, pool, bucket || '-' || j AS draw_id FROM (SELECT *, unnest(range(1, {GENERATED} // ranges + CASE WHEN nth < {GENERATED} % ranges THEN 2 ELSE 1 END)) AS j FROM s))
SELECT draw_id, d.bucket, num_nodes FROM d JOIN i ON i.bucket = d.bucket AND i.idx = {draw_sql('size', 'draw_id')} % d.pool""")
def stratified_sizes(t: Traces) -> DataFrame:
    return sampling.stratified_sizes(t.graphs, BUCKETS, GENERATED, SEED)


@query("""
, wanted AS (SELECT DISTINCT num_nodes * 2 - 1 AS n FROM graphs WHERE corpus = 'B'), known AS (SELECT DISTINCT num_nodes AS k FROM graphs WHERE corpus = 'A')
SELECT n AS num_nodes, arg_min(k, abs(k - n) * 1000000 + k) AS nearest_nodes FROM wanted, known GROUP BY ALL""")
def nearest_edge_count(t: Traces) -> DataFrame:
    return sampling.nearest_key(t.graphs.filter("corpus = 'B'").select((F.col("num_nodes") * 2 - 1).alias("num_nodes")), t.graphs.filter("corpus = 'A'"))


# Generators

GEN_SQL = f""", sz AS (SELECT num_nodes, num_edges, row_number() OVER (ORDER BY {draw_sql('index', 'graph_id')}, graph_id) - 1 AS idx, count(*) OVER () AS pool FROM graphs WHERE corpus = 'A'),
gg AS (SELECT gen_id, num_nodes FROM (SELECT unnest(range({GENERATED})) AS gen_id) x JOIN sz ON sz.idx = {draw_sql('nodes', 'gen_id')} % sz.pool),
gn AS (SELECT gen_id, num_nodes, unnest(range(num_nodes)) AS node_idx FROM gg)
"""
POOL_SQL = f""", pool AS (SELECT service_name, operation_name, duration, graph_id || '#' || node_idx AS pool_id FROM spans WHERE corpus = 'A'),
pa AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('index', 'pool_id')}, pool_id) - 1 AS idx, count(*) OVER () AS pool FROM pool),
ps AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY {draw_sql('index', 'pool_id')}, pool_id) - 1 AS idx, count(*) OVER (PARTITION BY service_name) AS pool FROM pool)
"""


def _blank(t: Traces) -> tuple[DataFrame, DataFrame]:
    made = generate.blank_graphs(t.graphs.filter("corpus = 'A'").select("graph_id", "num_nodes"), GENERATED, SEED)
    return made, generate.blank_nodes(made)


@query(GEN_SQL + POOL_SQL + f""", b AS (SELECT min(sid) AS s0, max(sid) AS s1, min(oid) AS o0, max(oid) AS o1 FROM (SELECT dense_rank() OVER (ORDER BY service_name) - 1 AS sid, dense_rank() OVER (ORDER BY operation_name) - 1 AS oid FROM pool)),
u AS (SELECT quantile_cont(ln(1 + greatest(duration, 0)), 0.99) AS upper FROM pool),
m AS (SELECT any_value(pool) AS pool FROM pa)
SELECT gen_id, n.node_idx, s0 + {draw_sql('service', 'gen_id', 'n.node_idx')} % (s1 - s0 + 1) AS service_id, o0 + {draw_sql('op', 'gen_id', 'n.node_idx')} % (o1 - o0 + 1) AS op_id,
  round(exp(least(ln(1 + greatest(d.duration, 0)), upper)) - 1, 3) AS duration
FROM gn n, b, u, m JOIN pa d ON d.idx = {draw_sql('duration', 'gen_id', 'n.node_idx')} % m.pool""")
def gen_random_sampling(t: Traces) -> DataFrame:
    real = t.nodes.filter("corpus = 'A'")
    ids = graphs.encode(real, graphs.vocabulary([real], "service_name"), graphs.vocabulary([real], "operation_name"))
    bounds = ids.agg(F.min("service_id").alias("min_service"), F.max("service_id").alias("max_service"), F.min("op_id").alias("min_op"), F.max("op_id").alias("max_op"))
    return rounded(generate.random_nodes(_blank(t)[1], bounds, real, SEED), "duration", digits=3)


@query(f"""
, i AS (SELECT num_edges, row_number() OVER (ORDER BY {draw_sql('index', 'graph_id')}, graph_id) - 1 AS idx, count(*) OVER () AS pool FROM graphs WHERE corpus = 'A'),
w AS (SELECT unnest([('few', 100), ('many', 3000)]) AS w),
d AS (SELECT w[1] AS draws, unnest(range(w[2])) AS draw_id, w[2] AS target FROM w)
SELECT draws, draw_id, num_edges FROM d JOIN i ON idx = CASE WHEN target <= pool THEN draw_id ELSE {draw_sql('counts', 'draw_id')} % pool END""")
def edge_count_draws(t: Traces) -> DataFrame:
    """Edge counts of real graphs: fewer than there are, then more."""
    real = t.graphs.filter("corpus = 'A'")
    few, many = (sampling.draw_counts(real, "num_edges", n, SEED, "counts").withColumn("draws", F.lit(name)) for name, n in (("few", 100), ("many", 3000)))
    return few.unionByName(many).select("draws", "draw_id", "num_edges")


def _real_graphs(t: Traces) -> DataFrame:
    return t.graphs.filter("corpus = 'A'").select("graph_id", "num_nodes", "num_edges")


@query(GEN_SQL + f""", known AS (SELECT DISTINCT num_nodes AS k FROM graphs WHERE corpus = 'A' AND num_nodes % 3 = 0),
nr AS (SELECT n, arg_min(k, abs(k - n) * 1000000 + k) AS k FROM (SELECT DISTINCT num_nodes AS n FROM gg), known GROUP BY ALL),
ei AS (SELECT num_nodes, num_edges, row_number() OVER (PARTITION BY num_nodes ORDER BY {draw_sql('index', 'graph_id')}, graph_id) - 1 AS idx, count(*) OVER (PARTITION BY num_nodes) AS pool
  FROM graphs WHERE corpus = 'A' AND num_nodes % 3 = 0)
SELECT gen_id, num_edges FROM gg JOIN nr ON nr.n = gg.num_nodes JOIN ei ON ei.num_nodes = nr.k AND ei.idx = {draw_sql('edges', 'gen_id')} % ei.pool""")
def gen_edge_counts(t: Traces) -> DataFrame:
    """Edge counts for drawn node counts, from real graphs of every third size."""
    return sampling.edge_counts_for(_blank(t)[0], _real_graphs(t).filter("num_nodes % 3 = 0"), SEED)


@query(GEN_SQL + f""", ec AS (SELECT g.gen_id, g.num_nodes, least(greatest(s.num_edges, 0), g.num_nodes * (g.num_nodes - 1)) AS k
  FROM gg g, (SELECT any_value(pool) AS pool FROM sz) m JOIN sz s ON s.idx = {draw_sql('edge-count', 'g.gen_id')} % m.pool),
pr AS (SELECT gen_id, k, a AS src, b AS dst, row_number() OVER (PARTITION BY gen_id ORDER BY {draw_sql('edge', 'gen_id', 'a', 'b')}, a, b) AS rk
  FROM (SELECT gen_id, num_nodes, k, a, unnest(range(num_nodes)) AS b FROM (SELECT gen_id, num_nodes, k, unnest(range(num_nodes)) AS a FROM ec)) WHERE a <> b)
SELECT gen_id, src, dst FROM pr WHERE rk <= k""")
def gen_random_edges(t: Traces) -> DataFrame:
    made = _blank(t)[0]
    return generate.random_edges(made, generate.empirical_counts(made, _real_graphs(t), "num_edges", SEED), SEED)


@query(GEN_SQL + POOL_SQL + f""", m AS (SELECT any_value(pool) AS pool FROM pa), ms AS (SELECT DISTINCT service_name, pool FROM ps),
s AS (SELECT gen_id, n.node_idx, p.service_name FROM gn n, m JOIN pa p ON p.idx = {draw_sql('service', 'gen_id', 'n.node_idx')} % m.pool),
o AS (SELECT s.gen_id, s.node_idx, s.service_name, p.operation_name FROM s JOIN ms USING (service_name) JOIN ps p ON p.service_name = s.service_name AND p.idx = {draw_sql('op', 's.gen_id', 's.node_idx')} % ms.pool)
SELECT o.gen_id, o.node_idx, o.service_name, o.operation_name, d.duration FROM o, m JOIN pa d ON d.idx = {draw_sql('duration', 'o.gen_id', 'o.node_idx')} % m.pool""")
def gen_empirical_nodes(t: Traces) -> DataFrame:
    return generate.empirical_nodes(_blank(t)[1], t.nodes.filter("corpus = 'A'"), SEED)


@query(GEN_SQL + "SELECT gen_id, node_idx - 1 AS src, node_idx AS dst FROM gn WHERE node_idx > 0")
def gen_empirical_chain(t: Traces) -> DataFrame:
    return generate.chain_edges(_blank(t)[1])


@query(GEN_SQL + f"SELECT gen_id, {draw_sql('parent', 'gen_id', 'node_idx')} % node_idx AS src, node_idx AS dst FROM gn WHERE node_idx > 0")
def gen_empirical_tree(t: Traces) -> DataFrame:
    return generate.tree_edges(_blank(t)[1], SEED)


@query(GEN_SQL + f""", c AS (SELECT *, least(greatest(num_nodes - 1, 1), 4) AS width FROM gn WHERE node_idx > 0)
SELECT gen_id, {draw_sql('parent', 'gen_id', 'node_idx')} % least(node_idx, width) AS src, node_idx AS dst FROM c
UNION SELECT gen_id, {draw_sql('second', 'gen_id', 'node_idx')} % node_idx, node_idx FROM c WHERE node_idx > width AND {draw_sql('extra', 'gen_id', 'node_idx')} < 1073741824""")
def gen_empirical_dag(t: Traces) -> DataFrame:
    return generate.dag_edges(_blank(t)[1], SEED)


PATTERN_SQL = f""", nd AS (SELECT graph_id, max(greatest(src, dst)) + 1 AS need FROM edges GROUP BY ALL),
pt AS (SELECT graph_id, coalesce(need, 0) AS need FROM graphs LEFT JOIN nd USING (graph_id) WHERE corpus = 'A' AND num_nodes >= 3),
pi AS (SELECT *, row_number() OVER (ORDER BY need, {draw_sql('index', 'graph_id')}, graph_id) - 1 AS number, count(*) OVER () AS total FROM pt),
fits AS (SELECT n, total, count(*) FILTER (need <= n) AS fit FROM (SELECT DISTINCT num_nodes AS n FROM gg), pi GROUP BY ALL)
"""


@query(GEN_SQL + PATTERN_SQL + f"""SELECT g.gen_id, e.src, e.dst FROM gg g JOIN fits f ON f.n = g.num_nodes
JOIN pi ON pi.number = {draw_sql('pattern', 'g.gen_id')} % CASE WHEN f.fit > 0 THEN f.fit ELSE f.total END
JOIN edges e ON e.graph_id = pi.graph_id WHERE g.num_nodes > 1 AND e.src < g.num_nodes AND e.dst < g.num_nodes""")
def gen_empirical_reuse(t: Traces) -> DataFrame:
    """Edge patterns of real graphs of three nodes at least, so that small graphs get masked ones."""
    return generate.reuse_edges(_blank(t)[0], _real_graphs(t).filter("num_nodes >= 3"), t.edges, SEED)


TEMPLATE_SQL = f""", tp AS (SELECT graph_id, num_nodes, row_number() OVER (PARTITION BY num_nodes ORDER BY {draw_sql('index', 'graph_id')}, graph_id) - 1 AS idx, count(*) OVER (PARTITION BY num_nodes) AS pool
  FROM graphs WHERE corpus = 'A' AND num_nodes % 3 = 0),
nr AS (SELECT n, arg_min(k, abs(k - n) * 1000000 + k) AS k FROM (SELECT DISTINCT num_nodes AS n FROM gg), (SELECT DISTINCT num_nodes AS k FROM tp) GROUP BY ALL),
tg AS (SELECT gen_id, gg.num_nodes, tp.graph_id, tp.num_nodes AS template_nodes FROM gg JOIN nr ON nr.n = gg.num_nodes JOIN tp ON tp.num_nodes = nr.k AND tp.idx = {draw_sql('template', 'gen_id')} % tp.pool),
tn AS (SELECT *, CASE WHEN node_idx < template_nodes THEN node_idx ELSE {draw_sql('extra', 'gen_id', 'node_idx')} % template_nodes END AS origin
  FROM (SELECT *, unnest(range(num_nodes)) AS node_idx FROM tg))
"""


def _templates(t: Traces) -> DataFrame:
    """Templates of every third size, so that they are cut and filled up."""
    return generate.template_graphs(_blank(t)[0], _real_graphs(t).filter("num_nodes % 3 = 0"), SEED)


@query(GEN_SQL + TEMPLATE_SQL + """SELECT gen_id, tn.node_idx, service_name, operation_name, duration FROM tn JOIN spans s ON s.graph_id = tn.graph_id AND s.node_idx = tn.origin""")
def gen_template(t: Traces) -> DataFrame:
    return generate.template_nodes(_templates(t), t.nodes, SEED)


@query(GEN_SQL + TEMPLATE_SQL + "SELECT gen_id, src, dst FROM tg JOIN edges e USING (graph_id) WHERE src < num_nodes AND dst < num_nodes")
def gen_template_edges(t: Traces) -> DataFrame:
    return generate.template_edges(_templates(t), t.edges)


@query(VOCAB_SQL + """SELECT graph_id, node_idx, service_id, op_id FROM (SELECT graph_id, node_idx, (service_id + node_idx) % 5 AS service_id, op_id FROM enc)
SEMI JOIN (SELECT DISTINCT service_id, op_id FROM enc) USING (service_id, op_id)""")
def allowed_pairs(t: Traces) -> DataFrame:
    """Nodes with shifted services, masked by the pairs that occur."""
    ids = vocab_ids(t)
    shifted = ids.select("graph_id", "node_idx", ((F.col("service_id") + F.col("node_idx")) % 5).alias("service_id"), "op_id")
    return generate.allowed_pairs(shifted, ids, ("service_id", "op_id")).select("graph_id", "node_idx", "service_id", "op_id")


@query(GEN_SQL + "SELECT count(*) AS graphs, round(avg(num_nodes), 6) AS mean_nodes, max(num_nodes) AS max_nodes, round(avg(num_nodes - 1), 6) AS mean_edges FROM gg")
def gen_summary(t: Traces) -> DataFrame:
    made, blank = _blank(t)
    return rounded(generate.generation_summary(made, generate.chain_edges(blank)), "mean_nodes", "mean_edges")


@query(GEN_SQL + POOL_SQL + f""", m AS (SELECT any_value(pool) AS pool FROM pa),
sn AS (SELECT gen_id, n.node_idx, p.service_name FROM gn n, m JOIN pa p ON p.idx = {draw_sql('service', 'gen_id', 'n.node_idx')} % m.pool),
oc AS (SELECT service_name, operation_name, count(*) AS n FROM pool GROUP BY ALL),
ow AS (SELECT service_name, operation_name, greatest(1, CAST(round({generate.WEIGHT} * exp((ln(n) - ln(max(n) OVER (PARTITION BY service_name))) / 0.8::DOUBLE)) AS BIGINT))::HUGEINT AS w FROM oc),
a0 AS (SELECT service_name, list(operation_name ORDER BY operation_name) AS ops, count(*) AS m, sum(w)::HUGEINT AS total, list(w ORDER BY operation_name) AS ws FROM ow GROUP BY ALL),
a1 AS MATERIALIZED (SELECT service_name, ops, m, total, list_transform(ws, lambda x: x * m) AS q FROM a0),
al AS MATERIALIZED (SELECT * FROM (WITH RECURSIVE ar(service_name, q, small, large, slot, cut, other) AS (
  SELECT service_name, q, list_filter(range(1, m + 1), lambda i: q[i] < total), list_filter(range(1, m + 1), lambda i: q[i] >= total), 0::BIGINT, 0::HUGEINT, 0::BIGINT FROM a1
  UNION ALL SELECT r.service_name, CASE WHEN met THEN list_transform(r.q, lambda x, i: CASE WHEN i = rich THEN rest ELSE x END) ELSE r.q END,
    r.small[2:] || CASE WHEN met AND rest < total THEN [rich] ELSE [] END,
    CASE WHEN met AND rest >= total OR NOT met AND len(r.small) > 0 THEN r.large ELSE r.large[2:] END,
    poor, CASE WHEN met THEN r.q[poor] ELSE total END, CASE WHEN met THEN rich ELSE poor END
  FROM (SELECT ar.*, total, len(small) > 0 AND len(large) > 0 AS met, (small || large)[1] AS poor, large[1] AS rich, ar.q[large[1]] - (total - ar.q[(small || large)[1]]) AS rest
    FROM ar JOIN a1 USING (service_name) WHERE len(small) + len(large) > 0) r)
  SELECT * FROM ar) WHERE slot > 0),
gp AS (SELECT gen_id, node_idx, service_name, ops[CASE WHEN {draw_sql('op-cut', 'gen_id', 'node_idx')} < cut * 4294967296 // total THEN slot ELSE other END] AS operation_name
  FROM sn JOIN a1 USING (service_name) JOIN al USING (service_name) WHERE slot = {draw_sql('op-slot', 'gen_id', 'node_idx')} % m + 1),
st AS (SELECT avg(ln(1 + greatest(duration, 0))) AS mu, stddev_samp(ln(1 + greatest(duration, 0))) AS sd FROM pool),
dz AS (SELECT *, sqrt(-2 * ln(({draw_sql('u', 'gen_id', 'node_idx')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))
  * cos(2 * pi() * (({draw_sql('v', 'gen_id', 'node_idx')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS z FROM gp)
SELECT gen_id, node_idx, service_name, operation_name, round(greatest(exp(mu + sd * z) - 1, 0), 3) AS duration FROM dz, st""")
def gen_label_conditional(t: Traces) -> DataFrame:
    real = t.nodes.filter("corpus = 'A'")
    rows = generate.empirical_nodes(_blank(t)[1], real, SEED).select("gen_id", "node_idx", "service_name")
    return rounded(generate.noisy_durations(generate.label_draws(rows, real, 0.8, SEED), metrics.duration_stats(real), SEED), "duration", digits=3)


CORPUS_PLAN = generate.CorpusPlan(GENERATED, 1, SEED, 2, 12, tuple(BUCKETS), 0.8, "tree")


@query(f""", el AS (SELECT graph_id, num_nodes, CASE WHEN num_nodes <= 3 THEN 0 WHEN num_nodes <= 8 THEN 1 ELSE 2 END AS bucket FROM graphs WHERE corpus = 'A' AND num_nodes BETWEEN 2 AND 12),
xi AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {draw_sql('index', 'graph_id')}, graph_id) - 1 AS idx, count(*) OVER (PARTITION BY bucket) AS pool FROM el),
xs AS (SELECT bucket, pool, row_number() OVER (ORDER BY bucket) - 1 AS nth, count(*) OVER () AS ranges FROM (SELECT DISTINCT bucket, pool FROM xi)),
xd AS (SELECT bucket, pool, bucket || '-' || j AS gen_id FROM (SELECT *, unnest(range(1, {GENERATED} // ranges + CASE WHEN nth < {GENERATED} % ranges THEN 2 ELSE 1 END)) AS j FROM xs)),
gg AS (SELECT gen_id, num_nodes FROM xd JOIN xi ON xi.bucket = xd.bucket AND xi.idx = {draw_sql('size', 'gen_id')} % xd.pool),
gn AS (SELECT gen_id, num_nodes, unnest(range(num_nodes)) AS node_idx FROM gg),
pool AS (SELECT service_name, operation_name, duration, graph_id || '#' || node_idx AS pool_id FROM spans SEMI JOIN el USING (graph_id)),
pa AS (SELECT *, row_number() OVER (ORDER BY {draw_sql('index', 'pool_id')}, pool_id) - 1 AS idx, count(*) OVER () AS pool FROM pool), m AS (SELECT any_value(pool) AS pool FROM pa),
sn AS (SELECT gen_id, n.node_idx, p.service_name FROM gn n, m JOIN pa p ON p.idx = {draw_sql('service', 'gen_id', 'n.node_idx')} % m.pool),
st AS (SELECT avg(ln(1 + greatest(duration, 0))) AS mu, stddev_samp(ln(1 + greatest(duration, 0))) AS sd FROM pool),
dz AS (SELECT gen_id, node_idx, service_name, greatest(exp(mu + sd * sqrt(-2 * ln(({draw_sql('u', 'gen_id', 'node_idx')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))
  * cos(2 * pi() * (({draw_sql('v', 'gen_id', 'node_idx')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) - 1, 0) AS duration FROM sn, st),
ge AS (SELECT gen_id, sum({draw_sql('parent', 'gen_id', 'node_idx')} % node_idx)::BIGINT AS parents, count(*) AS num_edges FROM gn WHERE node_idx > 0 GROUP BY ALL)
SELECT gen_id, 1 AS label, num_nodes, num_edges, parents, count(DISTINCT service_name) AS services, round(sum(duration), 3) AS duration FROM gg JOIN ge USING (gen_id) JOIN dz USING (gen_id) GROUP BY ALL""")
def generated_corpus(t: Traces) -> DataFrame:
    """A whole corpus in one call: per graph its size, edges, services and time."""
    real = t.nodes.filter("corpus = 'A'")
    made, nodes, joined = generate.generate_corpus(_real_graphs(t), real, t.edges, CORPUS_PLAN)
    per = nodes.groupBy("gen_id").agg(F.count_distinct("service_name").alias("services"), F.round(F.sum("duration"), 3).alias("duration"), F.count("operation_name").alias("labelled"))
    wired = joined.groupBy("gen_id").agg(F.count(F.lit(1)).alias("num_edges"), F.sum("src").cast("long").alias("parents"))
    return made.join(per, "gen_id").join(wired, "gen_id").filter("labelled = num_nodes").select("gen_id", "label", "num_nodes", "num_edges", "parents", "services", "duration")


SCORE_SQL = """, en AS (SELECT p.service_name AS ps, c.service_name AS cs, count(*) AS n FROM edges e JOIN spans p ON p.graph_id = e.graph_id AND p.node_idx = e.src JOIN spans c ON c.graph_id = e.graph_id AND c.node_idx = e.dst GROUP BY ALL),
et AS (SELECT ps, sum(n) AS total FROM en GROUP BY ALL), k AS (SELECT count(DISTINCT service_name) AS k FROM spans),
sp AS (SELECT p.graph_id, p.node_idx AS src, c.node_idx AS dst, (coalesce(n, 0) + 1) / (coalesce(total, 0) + k) AS score FROM spans p JOIN spans c ON p.graph_id = c.graph_id AND p.node_idx <> c.node_idx
  LEFT JOIN en ON en.ps = p.service_name AND en.cs = c.service_name LEFT JOIN et ON et.ps = p.service_name, k)
"""


def _blocks(t: Traces) -> DataFrame:
    return edges.service_blocks(t.nodes, t.edges)


def _best(t: Traces) -> DataFrame:
    return edges.best_parents(t.nodes, _blocks(t))


@query(SCORE_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, src, dst) AS nth FROM sp WHERE src < dst)
SELECT graph_id, src, dst FROM r JOIN graphs USING (graph_id) WHERE nth <= num_nodes - 1""")
def edge_topk(t: Traces) -> DataFrame:
    return edges.top_edges(t.nodes, _blocks(t), t.graphs.select("graph_id", (F.col("num_nodes") - 1).alias("target")))


@query(SCORE_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, dst ORDER BY score DESC, src) AS nth FROM sp),
b AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, dst) AS rk FROM r WHERE nth = 1)
SELECT graph_id, src, dst FROM b JOIN graphs USING (graph_id) WHERE rk <= num_nodes - 1""")
def edge_parent_argmax(t: Traces) -> DataFrame:
    return edges.parent_argmax(_best(t), t.graphs.select("graph_id", (F.col("num_nodes") - 1).alias("k")))


@query(SCORE_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id, dst ORDER BY score DESC, src) AS nth FROM sp)
SELECT graph_id, src, dst FROM r WHERE nth = 1 AND score > 0.2""")
def edge_parent_or_root(t: Traces) -> DataFrame:
    return edges.parent_argmax(_best(t), root_score=0.2)


@query(SCORE_SQL + "SELECT graph_id, src, dst FROM sp WHERE score > 0.2 AND src < dst")
def edge_threshold(t: Traces) -> DataFrame:
    return edges.threshold_edges(t.nodes, _blocks(t), 0.2)


@query(SCORE_SQL + f""", zj AS (SELECT *, sqrt(-2 * ln(({draw_sql('jitter-u', 'graph_id')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE))
  * cos(2 * pi() * (({draw_sql('jitter-v', 'graph_id')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS z FROM sp WHERE src < dst)
SELECT graph_id, src, dst FROM zj WHERE score > least(greatest(0.2::DOUBLE + 0.1::DOUBLE * z, 0.05::DOUBLE), 0.95::DOUBLE)
AND {draw_sql('dropout', 'graph_id', 'src', 'dst')} / 4294967296 > 0.1::DOUBLE""")
def edge_jitter(t: Traces) -> DataFrame:
    return edges.threshold_edges(t.nodes, _blocks(t), 0.2, SEED, jitter=0.1, dropout=0.1)


@query("\nSELECT graph_id, node_idx, coalesce(parent, -1) AS parent FROM spans LEFT JOIN (SELECT graph_id, dst AS node_idx, min(src) AS parent FROM edges GROUP BY ALL) USING (graph_id, node_idx)")
def first_parent(t: Traces) -> DataFrame:
    return edges.first_parents(t.nodes, t.edges)


@query()
def spanning_forest(t: Traces) -> DataFrame:
    """Greedy and sequential: no SQL, compared with a brute-force walk in the tests."""
    return edges.spanning_forest(t.nodes, _blocks(t))


SKIP_SQL = f"""CASE WHEN score >= 1 THEN 0 ELSE CAST(floor(ln(({draw_sql('skip', 'b.graph_id', 'b.ps', 'b.cs', 'KTH')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / ln(1 - score)) AS BIGINT) END"""


@query(SCORE_SQL + f""", hl AS (SELECT graph_id, service_name AS s, list(node_idx ORDER BY node_idx) AS l FROM spans GROUP BY ALL),
bk AS MATERIALIZED (SELECT a.graph_id, a.s AS ps, c.s AS cs, a.l AS la, c.l AS lc, (coalesce(n, 0) + 1) / (coalesce(total, 0) + k) AS score FROM hl a JOIN hl c USING (graph_id)
  LEFT JOIN en ON en.ps = a.s AND en.cs = c.s LEFT JOIN et ON et.ps = a.s, k)
SELECT graph_id, la[place // len(lc) + 1] AS src, lc[place % len(lc) + 1] AS dst FROM (
  WITH RECURSIVE sk(graph_id, ps, cs, kth, place) AS (
    SELECT b.graph_id, b.ps, b.cs, 0::BIGINT, {SKIP_SQL.replace("KTH", "0")} FROM bk b
    UNION ALL SELECT b.graph_id, b.ps, b.cs, s.kth + 1, s.place + 1 + {SKIP_SQL.replace("KTH", "s.kth + 1")} FROM sk s JOIN bk b USING (graph_id, ps, cs) WHERE s.place < len(la) * len(lc))
  SELECT * FROM sk) JOIN bk USING (graph_id, ps, cs) WHERE place < len(la) * len(lc) AND src < dst""")
def edge_bernoulli(t: Traces) -> DataFrame:
    """Geometric gaps between hits, block by block."""
    return edges.bernoulli_edges(t.nodes, _blocks(t), SEED)


# Distributions, weights, metrics


@query("\nSELECT service_name, string_agg(DISTINCT operation_name, ',' ORDER BY operation_name) AS ops FROM spans GROUP BY ALL")
def valid_ops(t: Traces) -> DataFrame:
    return t.nodes.groupBy("service_name").agg(F.array_join(F.sort_array(F.collect_set("operation_name")), ",").alias("ops"))


@query("""
, c AS (SELECT service_name, operation_name, count(*) AS n FROM spans GROUP BY ALL)
SELECT service_name, operation_name, round(n / sum(n) OVER (), 9) AS p, round(n / sum(n) OVER (PARTITION BY service_name), 9) AS p_given_service FROM c""")
def label_distribution(t: Traces) -> DataFrame:
    c = t.nodes.groupBy("service_name", "operation_name").agg(F.count(F.lit(1)).alias("n"))
    of = c.groupBy("service_name").agg(F.sum("n").alias("s"))
    everything = c.agg(F.sum("n").alias("t"))
    rows = c.join(of, "service_name").crossJoin(F.broadcast(everything))
    return rows.select("service_name", "operation_name", F.round(F.col("n") / F.col("t"), 9).alias("p"), F.round(F.col("n") / F.col("s"), 9).alias("p_given_service"))


@query("\nSELECT system, round(quantile_cont(ln(1 + greatest(duration, 0)), 0.99), 6) AS log_clip, count(*) AS n FROM spans GROUP BY ALL")
def duration_clip(t: Traces) -> DataFrame:
    return rounded(metrics.duration_clip(t.nodes, ["system"]), "log_clip")


@query("\nSELECT round(avg(ln(1 + greatest(duration, 0))), 6) AS log_mean, round(stddev_samp(ln(1 + greatest(duration, 0))), 6) AS log_sd FROM spans")
def duration_stats(t: Traces) -> DataFrame:
    return rounded(metrics.duration_stats(t.nodes), "log_mean", "log_sd")


@query("""
SELECT corpus, min(node_count) AS min_nodes, max(node_count) AS max_nodes, min(edge_count) AS min_edges, max(edge_count) AS max_edges, min(lo) AS min_duration, max(hi) AS max_duration
FROM stats JOIN graphs USING (graph_id) JOIN (SELECT corpus, min(duration) AS lo, max(duration) AS hi FROM spans GROUP BY ALL) USING (corpus) GROUP BY ALL""")
def corpus_bounds(t: Traces) -> DataFrame:
    return metrics.corpus_bounds(t.stats, t.nodes, ["corpus"])


@query("\n, c AS (SELECT label, count(*) AS n FROM graphs GROUP BY ALL), r AS (SELECT *, sum(n) OVER () / n AS raw FROM c) SELECT label, n, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
def class_weights(t: Traces) -> DataFrame:
    return rounded(metrics.class_weights(t.graphs), "weight")


@query("""
, ids AS (SELECT id, count(*) AS n FROM (SELECT (dense_rank() OVER (ORDER BY operation_name) - 1) * 2 AS id FROM spans) GROUP BY ALL),
f AS (SELECT s.id AS op_id, coalesce(n, 0) AS n, coalesce(sum(n) OVER () / n, 1.0) AS raw FROM (SELECT unnest(range((SELECT max(id) + 1 FROM ids))) AS id) s LEFT JOIN ids USING (id)),
g AS (SELECT *, raw / avg(raw) OVER () AS scaled FROM f)
SELECT op_id, n, round(least(scaled, 5 * (SELECT quantile_disc(scaled, 0.5) FROM g)), 6) AS weight FROM g""")
def label_weights(t: Traces) -> DataFrame:
    ids = graphs.encode(t.nodes, graphs.vocabulary([t.nodes], "service_name"), graphs.vocabulary([t.nodes], "operation_name"))
    return rounded(metrics.label_weights(ids.withColumn("op_id", F.col("op_id") * 2), "op_id"), "weight")


def _predictions(t: Traces) -> DataFrame:
    score = draw(SEED, "score", F.col("doc_id")) / 4294967296
    rows = t.table("labels").join(t.table("documents").select("doc_id", "lang"), "doc_id").filter("toxic is not null")
    return rows.select("doc_id", "lang", F.col("toxic").alias("y"), F.round(score, 3).alias("score")).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


PRED_SQL = f""", pred AS (SELECT doc_id, lang, toxic AS y, round({draw_sql("score", "doc_id")} / 4294967296, 3) AS score FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL),
cm AS (SELECT lang, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp FROM pred GROUP BY ALL)
"""


def _prf_sql() -> str:
    cols = ["lang", "tn", "fp", "fn", "tp"]
    parts = {}
    for name, hit, wrong, missed in (("normal", "tn", "fn", "fp"), ("abnormal", "tp", "fp", "fn")):
        parts[f"{name}_precision"] = f"coalesce({hit} / nullif({hit} + {wrong}, 0), 0)"
        parts[f"{name}_recall"] = f"coalesce({hit} / nullif({hit} + {missed}, 0), 0)"
        p, r = parts[f"{name}_precision"], parts[f"{name}_recall"]
        parts[f"{name}_f1"] = f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"
    for m in ("precision", "recall", "f1"):
        parts[f"weighted_{m}"] = f"({parts[f'normal_{m}']} * (tn + fp) + {parts[f'abnormal_{m}']} * (tp + fn)) / (tn + fp + tp + fn)"
    parts["accuracy"] = "(tn + tp) / (tn + fp + tp + fn)"
    parts["false_alarm_rate"] = "coalesce(fp / nullif(tn + fp, 0), 0)"
    return ", ".join(cols + [f"round({v}, 6) AS {k}" for k, v in parts.items()])


@query(PRED_SQL + f"SELECT {_prf_sql()} FROM cm")
def confusion_prf(t: Traces) -> DataFrame:
    out = metrics.confusion_report(_predictions(t), ["lang"])
    return rounded(out, *[c for c in out.columns if c not in ("lang", "tn", "fp", "fn", "tp")])


@query(PRED_SQL + """, s AS (SELECT lang, score, sum(y) AS pos, count(*) AS n FROM pred GROUP BY ALL),
c AS (SELECT lang, pos, sum(pos) OVER w AS up, sum(n) OVER w AS un, sum(pos) OVER (PARTITION BY lang) AS tot FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(coalesce(pos / nullif(tot, 0), 0) * up / un), 6) AS average_precision FROM c GROUP BY ALL""")
def average_precision(t: Traces) -> DataFrame:
    return rounded(metrics.average_precision(_predictions(t), ["lang"]), "average_precision")


METRICS = ["weighted_f1", "abnormal_f1", "abnormal_recall", "pr_auc", "false_alarm_rate"]
_METRIC_TEXT = ["o_totalprice / 1000e0", "(o_orderkey % 101) / 101e0", "(o_custkey % 37) / 37e0", "o_totalprice / 7919e0", "(o_orderkey % 13) / 13e0"]


def _results(t: Traces) -> DataFrame:
    """Orders as a results table: one run per customer and priority, metrics from prices and keys, one of them blank at times."""
    values = [F.expr(f"cast({x} as double)").alias(m) for m, x in zip(METRICS, _METRIC_TEXT)]
    rows = t.table("orders").select(
        F.col("o_orderkey").alias("run_order"), F.col("o_orderstatus").alias("generator"), F.col("o_orderpriority").alias("setting"), (F.col("o_custkey") % 50).alias("seed"), *values
    )
    return rows.withColumn("pr_auc", F.when(F.col("run_order") % 10 != 0, F.col("pr_auc")))


RESULTS_SQL = f""", res0 AS (SELECT o_orderkey AS run_order, o_orderstatus AS generator, o_orderpriority AS setting, o_custkey % 50 AS seed,
  {", ".join(f"({x})::DOUBLE AS {m}" for m, x in zip(METRICS, _METRIC_TEXT))} FROM orders),
res AS (SELECT * REPLACE (CASE WHEN run_order % 10 <> 0 THEN pr_auc END AS pr_auc) FROM res0)
"""


@query(RESULTS_SQL + "SELECT generator, setting, seed, max(run_order) AS run_order, round(arg_max(weighted_f1, run_order), 6) AS weighted_f1 FROM res GROUP BY ALL")
def latest_result(t: Traces) -> DataFrame:
    rows = metrics.latest(_results(t), ["generator", "setting", "seed"], "run_order")
    return rounded(rows, "weighted_f1").select("generator", "setting", "seed", "run_order", "weighted_f1")


@query(RESULTS_SQL + "SELECT generator, setting, count(*) AS runs, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0), 6) AS {m}_sd" for m in METRICS) + " FROM res GROUP BY ALL")
def seed_aggregate(t: Traces) -> DataFrame:
    return rounded(metrics.aggregate_seeds(_results(t), ["generator", "setting"], METRICS), *[f"{m}_{x}" for m in METRICS for x in ("mean", "sd")])


PIVOTED = METRICS[:3]


@query(RESULTS_SQL + "SELECT setting, " + ", ".join(f"round(avg({m}) FILTER (generator = '{g}'), 6) AS {g}_{m}" for g in "FOP" for m in PIVOTED) + " FROM res GROUP BY ALL")
def metric_pivot(t: Traces) -> DataFrame:
    return rounded(metrics.pivot_metrics(_results(t), "setting", "generator", ["F", "O", "P"], PIVOTED), *[f"{g}_{m}" for g in "FOP" for m in PIVOTED])


RECONSTRUCTION_SQL = """
, tn AS (SELECT t.node_idx, count(*) AS x FROM spans t GROUP BY ALL),
pn AS (SELECT graph_id, node_idx, lag(service_name, 1, service_name) OVER w AS ps, lag(operation_name, 1, operation_name) OVER w AS po, duration + 1000 AS pd FROM spans WINDOW w AS (PARTITION BY graph_id ORDER BY node_idx)),
nm AS (SELECT avg((service_name = ps)::INT) AS sa, avg((operation_name = po)::INT) AS oa, avg(abs(ln(1 + greatest(duration, 0)) - ln(1 + greatest(pd, 0)))) AS mae FROM spans JOIN pn USING (graph_id, node_idx)),
pe AS (SELECT graph_id, node_idx - 1 AS src, node_idx AS dst FROM spans WHERE node_idx > 0),
c AS (SELECT count(*) FILTER (o.src IS NOT NULL AND q.src IS NOT NULL) AS tp, count(*) FILTER (o.src IS NULL) AS fp, count(*) FILTER (q.src IS NULL) AS fn FROM (SELECT DISTINCT * FROM edges) o FULL JOIN pe q ON o.graph_id = q.graph_id AND o.src = q.src AND o.dst = q.dst)
SELECT round(sa, 6) AS service_accuracy, round(oa, 6) AS op_accuracy, round(mae, 6) AS log_duration_mae, tp, fp, fn, round(tp / (tp + fp), 6) AS edge_precision, round(tp / (tp + fn), 6) AS edge_recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS edge_f1 FROM nm, c"""


@query(RECONSTRUCTION_SQL)
def reconstruction_metrics(t: Traces) -> DataFrame:
    return _reconstruction(t, True)


@query(RECONSTRUCTION_SQL.replace("(SELECT DISTINCT * FROM edges)", "(SELECT DISTINCT graph_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst)"))
def reconstruction_undirected(t: Traces) -> DataFrame:
    return _reconstruction(t, False)


def _reconstruction(t: Traces, directed: bool) -> DataFrame:
    """Nodes predicted by the one before, edges by a chain."""
    w = Window.partitionBy("graph_id").orderBy("node_idx")
    predicted = t.nodes.select(
        "graph_id", "node_idx", F.coalesce(F.lag("service_name").over(w), "service_name").alias("service_name"),
        F.coalesce(F.lag("operation_name").over(w), "operation_name").alias("operation_name"), (F.col("duration") + 1000).alias("duration"),
    )
    chain = t.nodes.filter("node_idx > 0").select("graph_id", (F.col("node_idx") - 1).alias("src"), F.col("node_idx").alias("dst"))
    return rounded(metrics.reconstruction(t.nodes, predicted, t.edges, chain, directed), "service_accuracy", "op_accuracy", "log_duration_mae", "edge_precision", "edge_recall", "edge_f1")


@query("""
SELECT source_run, trace_id, span_id, service_name, timestamp, CASE WHEN span_seq % 3 = 0 THEN 0 ELSE 200 + span_seq % 3 END AS status_code,
  coalesce(parent, 'no_parent') AS parent_service_name FROM spans s
LEFT JOIN (SELECT graph_id AS g, span_id AS pid, service_name AS parent FROM spans) p ON p.g = s.graph_id AND p.pid = s.parent_id""")
def json_trace_ingest(t: Traces) -> DataFrame:
    """Spans folded into nested traces, written to JSON text, parsed and exploded again."""
    parsed = _folded(t).select("source_run", F.from_json("j", spans.TRACE_SCHEMA).alias("t")).select("source_run", "t.traceID", "t.spans", "t.processes")
    return spans.spans_from_traces(parsed).select("source_run", "trace_id", "span_id", "service_name", "timestamp", "status_code", "parent_service_name")


def _folded(t: Traces) -> DataFrame:
    """(source_run, trace_id, j): every trace as one JSON text."""
    refs = F.when(F.col("parent_id") == "", F.expr("array()")).otherwise(F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("parent_id").alias("spanID"))))
    # Two spans in three have the tag, behind another one.
    tags = F.expr("""if(span_seq % 3 = 0, array(named_struct('key', 'other', 'value', '7')),
      array(named_struct('key', 'other', 'value', '7'), named_struct('key', 'http.status_code', 'value', cast(200 + span_seq % 3 as string))))""")
    span = F.struct(
        F.col("span_seq").alias("order"), F.col("span_id").alias("spanID"), F.concat(F.lit("p-"), "service_name").alias("processID"), F.col("operation_name").alias("operationName"),
        (F.col("timestamp") * 1000000).alias("startTime"), "duration", refs.alias("references"), tags.alias("tags"),
    )
    names = F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("p-"), "service_name"), F.struct(F.col("service_name").alias("serviceName")))))
    folded = t.spans.groupBy("source_run", F.col("trace_id").alias("traceID")).agg(F.sort_array(F.collect_list(span)).alias("spans"), names.alias("processes"))
    return folded.select("source_run", F.col("traceID").alias("trace_id"), F.to_json(F.struct("traceID", "spans", "processes")).alias("j"))


# Files: written from the driver's tables, read back by the readers of such files

RUN_DIR = r"run_dir=([^/]+)/"
#: Every so manieth row is spoiled on its way out.
SPOILED = 97


def _csv_files(t: Traces) -> str:
    """Span CSV below a folder per run; one duration in 97 is no number."""
    at = folder(t.spark, "span-csv")
    spoiled = F.when(F.col("span_seq") % SPOILED == 0, "n/a").otherwise(F.col("duration").cast("string"))
    rows = t.spans.select(
        F.col("source_run").alias("run_dir"), F.col("timestamp").alias(" Timestamp"), F.col("service_name").alias("Service_Name"), F.col("span_id").alias("Span_ID"), F.col("parent_id").alias("Parent_ID"),
        F.col("trace_id").alias("Trace_ID"), spoiled.alias("Duration"), F.lit(200).alias("Status_Code"), F.col("operation_name").alias("Operation_Name"),
    )
    rows.write.partitionBy("run_dir").option("header", True).csv(at)
    return f"{at}/*/*.csv"


@query(f"\nSELECT source_run, trace_id, span_id, parent_id, service_name, operation_name, timestamp, duration, 200 AS status_code FROM spans WHERE span_seq % {SPOILED} <> 0")
def csv_files(t: Traces) -> DataFrame:
    rows = spans.read_span_csv(t.spark, _csv_files(t), "TT", run=RUN_DIR)
    return rows.select("source_run", "trace_id", "span_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "service_name", "operation_name", "timestamp", "duration", "status_code")


@query(f"\nSELECT source_run, count(*) AS rows, count(*) FILTER (span_seq % {SPOILED} = 0) AS refused FROM spans GROUP BY ALL")
def csv_refusals(t: Traces) -> DataFrame:
    per_file = spans.csv_counts(t.spark, _csv_files(t), RUN_DIR)
    return per_file.groupBy("source_run").agg(F.sum("rows").alias("rows"), F.sum("refused").alias("refused"))


def _json_files(t: Traces) -> str:
    """A trace a line below a folder per run; one trace in twenty is torn off."""
    at = folder(t.spark, "trace-json")
    torn = draw(SEED, "torn", F.col("trace_id")) % 20 == 0
    rows = _folded(t).select(F.col("source_run").alias("run_dir"), F.when(torn, F.expr("left(j, length(j) - 9)")).otherwise(F.col("j")).alias("value"))
    rows.write.partitionBy("run_dir").text(at)
    return f"{at}/*/*.txt"


TORN = f"{draw_sql('torn', 'trace_id')} % 20 = 0"


@query(f"\nSELECT source_run, trace_id, span_id, service_name, operation_name, timestamp, duration FROM spans WHERE NOT {TORN}")
def json_files(t: Traces) -> DataFrame:
    rows = spans.read_trace_json(t.spark, _json_files(t), "TT", lines=True, run=RUN_DIR)
    return rows.select("source_run", "trace_id", "span_id", "service_name", "operation_name", "timestamp", "duration")


@query(f"\nSELECT source_run, count(DISTINCT trace_id) AS refused FROM spans WHERE {TORN} GROUP BY ALL")
def json_refusals(t: Traces) -> DataFrame:
    return spans.refused_traces(t.spark, _json_files(t), lines=True, run=RUN_DIR).groupBy("source_run").agg(F.count("record").alias("refused"))


@query("\nSELECT source_run, row_number() OVER (PARTITION BY source_run ORDER BY fault_idx) - 1 AS fault_idx, w_start, w_end, fault FROM windows")
def fault_files(t: Traces) -> DataFrame:
    at = folder(t.spark, "fault-json")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("fault_idx", F.col("w_start").alias("start"), F.col("w_end").alias("end"), "fault"))), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["fault"].alias("fault")))
    files = t.windows.groupBy(F.col("source_run").alias("run_dir")).agg(F.to_json(F.struct(listed.alias("faults"))).alias("value"))
    files.write.partitionBy("run_dir").text(at)
    return spans.read_fault_windows(t.spark, f"{at}/*/*.txt", RUN_DIR)


@query(RESULTS_SQL + """, kr AS (SELECT generator, setting, count(*) AS runs, avg(weighted_f1) AS f1 FROM res GROUP BY ALL)
SELECT generator, setting, runs, round(CASE WHEN generator = 'F' THEN f1 + 1 ELSE f1 END, 6) AS f1 FROM kr""")
def keyed_results(t: Traces) -> DataFrame:
    """Result rows put twice, some of them changed: each key is there once, with its last row."""
    at = folder(t.spark, "results")
    rows = rounded(_results(t).groupBy("generator", "setting").agg(F.count(F.lit(1)).alias("runs"), F.avg("weighted_f1").alias("f1")), "f1")
    spans.put_results(rows, at, ("generator", "setting"))
    spans.put_results(rounded(rows.filter("generator = 'F'").withColumn("f1", F.col("f1") + 1), "f1"), at, ("generator", "setting"))
    return spans.read_results(t.spark, at, rows.schema)


def by_graph(t: Traces, buckets: int = 8) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges saved bucketed by graph."""
    saved = []
    for name, table in (("nodes", t.nodes.select("graph_id", "node_idx", "service_name", "operation_name", "duration")), ("edges", t.edges)):
        at = folder(t.spark, f"bucketed-{name}")
        saved.append(spans.save_by_graph(table, f"{name}_{at.rpartition('-')[2]}", buckets, at))
    return saved[0], saved[1]


@query(f"\nSELECT graph_id, {STATS_SQL} FROM stats")
def bucketed_stats(t: Traces) -> DataFrame:
    """The statistics from tables bucketed by graph: no exchange between scan and result."""
    return rounded(graphs.graph_stats(*by_graph(t)), *graphs.FEATURES)


# Classification


FEATURE_SQL = """, ds AS (SELECT avg(ln(1 + greatest(duration, 0))) AS mu, stddev_samp(ln(1 + greatest(duration, 0))) AS sd FROM spans),
x0 AS (SELECT graph_id, node_idx, 's:' || service_name AS feature, 1.0::DOUBLE AS v FROM spans UNION ALL SELECT graph_id, node_idx, 'o:' || operation_name, 1.0 FROM spans
  UNION ALL SELECT graph_id, node_idx, 'duration', (ln(1 + greatest(duration, 0)) - mu) / sd FROM spans, ds),
ln AS (SELECT graph_id, src, dst FROM edges WHERE src <> dst UNION SELECT graph_id, dst, src FROM edges WHERE src <> dst UNION ALL SELECT graph_id, node_idx, node_idx FROM spans),
dg AS (SELECT graph_id, src, count(*) AS d FROM ln GROUP BY ALL),
wt AS (SELECT l.graph_id, l.src, l.dst, 1 / sqrt(a.d * b.d) AS w FROM ln l JOIN dg a ON a.graph_id = l.graph_id AND a.src = l.src JOIN dg b ON b.graph_id = l.graph_id AND b.src = l.dst),
x1 AS (SELECT wt.graph_id, dst AS node_idx, feature, sum(w * v) AS v FROM x0 JOIN wt ON wt.graph_id = x0.graph_id AND wt.src = x0.node_idx GROUP BY ALL),
x2 AS (SELECT wt.graph_id, dst AS node_idx, feature, sum(w * v) AS v FROM x1 JOIN wt ON wt.graph_id = x1.graph_id AND wt.src = x1.node_idx GROUP BY ALL)
"""


def _features(t: Traces, fit: DataFrame) -> DataFrame:
    """Propagated features of every graph; durations are normalised by the ``fit`` nodes."""
    return classify.graph_features(t.nodes, t.edges, metrics.duration_stats(fit))


@query(FEATURE_SQL + "SELECT graph_id, feature, round(sum(v) / any_value(num_nodes), 6) AS value FROM x2 JOIN graphs USING (graph_id) GROUP BY ALL")
def propagated_features(t: Traces) -> DataFrame:
    return rounded(_features(t, t.nodes), "value")


def _sparse(t: Traces, roles: DataFrame) -> tuple[DataFrame, int]:
    """Sparse rows of every graph's features, over the vocabulary of training graphs."""
    train = roles.filter("role = 'train'").select("graph_id").distinct()
    return classify.sparse_rows(_features(t, t.nodes.join(train, "graph_id", "left_semi")), train)


@query()
def classifier_scores(t: Traces) -> DataFrame:
    """Normal against abnormal on all service and operation features and duration; the tests hold the fit against a dense one."""
    roles = materialize(split_roles(t), "classifier-roles")
    return classify.fit_and_score(*_sparse(t, roles), roles.withColumn("cell", F.lit(0))).drop("cell")


@query()
def classifier_sweep(t: Traces) -> DataFrame:
    """One row of test metrics per system, generator and real percentage; every model reads the same rows, and all descend together."""
    prepared = None
    for system in ("SN", "TT"):
        for generator in GENERATORS:
            mine = t.graphs.filter((F.col("system") == system) & ((F.col("corpus") == "A") | (F.col("generator") == generator)))
            rows = corpora.prepare(mine.select("graph_id", "corpus", "label", "num_nodes"), PERCENTS, RECIPE).select(F.lit(system).alias("system"), F.lit(generator).alias("generator"), "percent", "graph_id", "corpus", "label", "role")
            prepared = rows if prepared is None else prepared.unionByName(rows)
    prepared = materialize(prepared, "sweep-prepared")
    return classify.sweep(*_sparse(t, prepared), prepared, ["system", "generator", "percent"], SEED)
