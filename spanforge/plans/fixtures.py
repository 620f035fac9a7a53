"""The driver's tables seen as span corpora.

``events`` become spans: a trace is a user's three-day stretch, a run a week of
stretches, corpus A or B a hash of the trace.  ``FIXTURE_SQL`` says the same in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.draws import draw
from spanforge.operators import graphs as G
from spanforge.operators import labels as L

SEED = 42
#: Every other day's greatest error opens a fault window of this length: a steady share of
#: the time at any number of events.
FAULT_SECONDS = 12 * 3600
DAY = 86400
GENERATORS = ("g0", "g1")


def event_spans(events: DataFrame) -> DataFrame:
    """Spans in the engine's schema plus ``corpus``; span_seq is the event id."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    base = events.withColumn("day", F.datediff("ts", F.lit("1970-01-01").cast("date"))).withColumn("stretch", F.expr("day div 3"))
    base = base.select(
        F.concat_ws(":", "user_id", "stretch").alias("trace_id"), F.concat(F.lit("w"), F.expr("cast((stretch * 3 + 3) div 7 as string)")).alias("source_run"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("timestamp"), F.col("event_id").alias("span_seq"),
        F.col("event_type").alias("service_name"), F.concat_ws("/", "event_type", (F.floor(k / 10)).cast("string")).alias("operation_name"),
        F.round(F.col("value") * 1000).alias("duration"), F.expr("if(user_id % 2 = 0, 'TT', 'SN')").alias("system"), "value",
    )
    nodes = G.index_nodes(base.withColumn("span_id", F.col("span_seq").cast("string")))
    parent = F.col("span_seq") % F.greatest("node_idx", F.lit(1))

    def span(idx):
        return F.when(idx == 0, F.col("trace_id")).otherwise(F.concat_ws("-", "trace_id", idx.cast("string")))

    return nodes.select(
        "source_run", "trace_id", "timestamp", "span_seq", "service_name", "operation_name", "duration", "system", "value",
        span(F.col("node_idx")).alias("span_id"), F.when(F.col("node_idx") == 0, F.lit("")).otherwise(span(parent)).alias("parent_id"),
        F.when(draw(SEED, "corpus", F.col("trace_id")) < 2147483648, "A").otherwise("B").alias("corpus"),
        F.when(F.substring("source_run", 2, 9).cast("int") % 2 == 0, "no_fault_archive").otherwise("fault_run").alias("source_kind"),
    )


_tables: dict[tuple[object, str], "Traces"] = {}


def traces(spark: SparkSession, sf_dir: str) -> "Traces":
    """The tables of one data folder.  Queries on it share what is persisted; asking for another folder lets it go."""
    key = (spark, sf_dir)
    if key not in _tables:
        release()
        _tables[key] = Traces(spark, sf_dir)
    return _tables[key]


def release() -> None:
    """Unpersist the tables of the last data folder."""
    while _tables:
        _tables.popitem()[1].unpersist()


@dataclass
class Traces:
    """Lazily built tables of one data folder; those that most plans read several times are persisted."""

    spark: SparkSession
    sf_dir: str
    held: list[DataFrame] = field(default_factory=list)

    def hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist())
        return df

    def unpersist(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def spans(self) -> DataFrame:
        return self.hold(event_spans(self.table("events")))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.hold(G.index_nodes(self.spans))

    @cached_property
    def edges(self) -> DataFrame:
        return self.hold(G.parent_edges(self.nodes))

    @cached_property
    def windows(self) -> DataFrame:
        """On every other day of a run a window from the error of highest value, named by its operation."""
        day = F.expr(f"timestamp div {DAY}")
        errors = self.spans.filter("service_name = 'error'").withColumn("day", day).filter("day % 2 = 0")
        first = F.struct(F.col("value"), (-F.col("span_seq")).alias("back"), "timestamp", "operation_name")
        top = errors.groupBy("source_run", "day").agg(F.max(first).alias("e")).select("source_run", "e.*")
        start = F.col("timestamp").cast("double")
        return top.select("source_run", (-F.col("back")).alias("fault_idx"), start.alias("w_start"), (start + FAULT_SECONDS).alias("w_end"), F.col("operation_name").alias("fault"))

    @cached_property
    def labels(self) -> DataFrame:
        return L.label_roots(L.root_spans(self.spans), self.windows)

    @cached_property
    def graphs(self) -> DataFrame:
        """graph_id, system, corpus, generator (of corpus B), label (1 abnormal), num_nodes, num_edges."""
        per = self.nodes.groupBy("graph_id", "source_run", "trace_id", "system", "corpus").agg(F.count(F.lit(1)).alias("num_nodes"))
        wired = self.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("num_edges"))
        made_by = F.when(F.col("corpus") == "B", F.element_at(F.array(*map(F.lit, GENERATORS)), (draw(SEED, "generator", F.col("graph_id")) % len(GENERATORS) + 1).cast("int")))
        rows = per.join(self.labels, ["source_run", "trace_id"]).join(wired, "graph_id", "left")
        return self.hold(
            rows.select("graph_id", "system", "corpus", made_by.alias("generator"), F.expr("if(trace_label = 'abnormal', 1, 0)").alias("label"), "num_nodes", F.coalesce("num_edges", F.lit(0)).alias("num_edges"))
        )

    @cached_property
    def stats(self) -> DataFrame:
        return self.hold(G.graph_stats(self.nodes, self.edges).join(self.graphs.select("graph_id", "system", "corpus", "generator", "label"), "graph_id"))

    @cached_property
    def grouped_nodes(self) -> DataFrame:
        """Nodes with the generator and label of their graph."""
        return self.nodes.select("graph_id", "node_idx", "service_name", "operation_name", "duration").join(
            self.graphs.select("graph_id", "system", "corpus", "generator", "label"), "graph_id"
        )

    @cached_property
    def node_labels(self) -> DataFrame:
        return self.nodes.select("graph_id", "corpus", G.node_label().alias("label"))

    @cached_property
    def edge_labels(self) -> DataFrame:
        return G.edge_labels(self.nodes, self.edges)

    def side(self, corpus: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(graphs, node labels, edge labels) of one corpus."""
        graphs = self.graphs.filter(F.col("corpus") == corpus)
        return graphs, self.node_labels.filter(F.col("corpus") == corpus), self.edge_labels.join(graphs.select("graph_id"), "graph_id", "left_semi")


def draw_sql(purpose: str, *ids: str, seed: int = SEED) -> str:
    text = " || '|' || ".join([f"'{seed}|{purpose}'", *(f"CAST({i} AS VARCHAR)" for i in ids)])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


FIXTURE_SQL = f"""
WITH ev AS (
  SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) // 3 AS stretch,
         coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) // 10 AS k10 FROM events),
base AS (
  SELECT user_id || ':' || stretch AS trace_id, 'w' || ((stretch * 3 + 3) // 7) AS source_run,
         CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id AS span_seq, event_type AS service_name,
         event_type || '/' || k10 AS operation_name, round(value * 1000) AS duration,
         CASE WHEN user_id % 2 = 0 THEN 'TT' ELSE 'SN' END AS system, value FROM ev),
nodes AS (
  SELECT *, source_run || '::' || trace_id AS graph_id,
         row_number() OVER (PARTITION BY source_run, trace_id ORDER BY timestamp, span_seq) - 1 AS node_idx FROM base),
spans AS (
  SELECT *, CASE WHEN node_idx = 0 THEN trace_id ELSE trace_id || '-' || node_idx END AS span_id,
         CASE WHEN node_idx = 0 THEN '' WHEN span_seq % node_idx = 0 THEN trace_id ELSE trace_id || '-' || (span_seq % node_idx) END AS parent_id,
         CASE WHEN {draw_sql("corpus", "trace_id")} < 2147483648 THEN 'A' ELSE 'B' END AS corpus,
         CASE WHEN CAST(substr(source_run, 2) AS INT) % 2 = 0 THEN 'no_fault_archive' ELSE 'fault_run' END AS source_kind FROM nodes),
edges AS (
  SELECT c.graph_id, p.node_idx AS src, c.node_idx AS dst FROM spans c JOIN spans p ON c.graph_id = p.graph_id AND c.parent_id = p.span_id
  WHERE c.parent_id <> ''),
windows AS (
  SELECT source_run, span_seq AS fault_idx, timestamp::DOUBLE AS w_start, (timestamp + {FAULT_SECONDS})::DOUBLE AS w_end, operation_name AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY source_run, timestamp // {DAY} ORDER BY value DESC, span_seq) AS nth FROM spans
        WHERE service_name = 'error' AND (timestamp // {DAY}) % 2 = 0) WHERE nth = 1),
roots AS (SELECT source_run, trace_id, timestamp, timestamp + duration / 1e6 AS end_sec FROM spans WHERE span_id = trace_id),
hits AS (
  SELECT r.source_run, r.trace_id, arg_min(w.fault, w.fault_idx) AS fault FROM roots r JOIN windows w
  ON r.source_run = w.source_run AND r.end_sec >= w.w_start AND r.timestamp <= w.w_end GROUP BY ALL),
labels0 AS (
  SELECT r.source_run, r.trace_id, r.timestamp, CASE WHEN h.fault IS NULL THEN 'normal' ELSE 'abnormal' END AS trace_label,
         coalesce(h.fault, 'none') AS fault_type FROM roots r LEFT JOIN hits h USING (source_run, trace_id)),
graphs AS (
  SELECT graph_id, system, corpus, CASE WHEN corpus = 'B' THEN 'g' || ({draw_sql("generator", "graph_id")} % {len(GENERATORS)}) END AS generator,
         CASE WHEN trace_label = 'abnormal' THEN 1 ELSE 0 END AS label, count(*) AS num_nodes, coalesce(any_value(ne), 0) AS num_edges
  FROM spans JOIN labels0 USING (source_run, trace_id) LEFT JOIN (SELECT graph_id, count(*) AS ne FROM edges GROUP BY ALL) USING (graph_id)
  GROUP BY graph_id, system, corpus, trace_label),
deg AS (
  SELECT graph_id, node_idx, sum(i) AS indegree, sum(o) AS outdegree FROM (
    SELECT graph_id, dst AS node_idx, 1 AS i, 0 AS o FROM edges UNION ALL SELECT graph_id, src, 0, 1 FROM edges UNION ALL SELECT graph_id, node_idx, 0, 0 FROM spans)
  GROUP BY ALL),
stats AS (
  SELECT s.graph_id, count(*) AS node_count, sum(indegree)::BIGINT AS edge_count, sum(indegree) / greatest(count(*) * (count(*) - 1), 1) AS density,
         avg(indegree + outdegree) AS mean_degree, max(indegree + outdegree) AS max_degree, avg(CASE WHEN indegree = 0 THEN 1.0 ELSE 0.0 END) AS root_share,
         avg(CASE WHEN outdegree = 0 THEN 1.0 ELSE 0.0 END) AS leaf_share, avg(duration) AS mean_duration, stddev_pop(duration) AS std_duration,
         count(DISTINCT service_name) AS n_services, count(DISTINCT operation_name) AS n_ops
  FROM spans s JOIN deg d USING (graph_id, node_idx) GROUP BY s.graph_id),
nlabels AS (SELECT graph_id, corpus, node_idx, to_json([service_name, operation_name])::VARCHAR AS label FROM spans),
elabels AS (
  SELECT e.graph_id, a.corpus, '[' || a.label || ',' || b.label || ']' AS edge_label FROM edges e
  JOIN nlabels a ON a.graph_id = e.graph_id AND a.node_idx = e.src JOIN nlabels b ON b.graph_id = e.graph_id AND b.node_idx = e.dst)
"""
