"""Span CSV, nested trace JSON, fault windows, corpora and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.sources.shared import materialize

SPAN_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()), T.StructField("service_name", T.StringType()), T.StructField("span_id", T.StringType()),
        T.StructField("parent_id", T.StringType()), T.StructField("trace_id", T.StringType()), T.StructField("duration", T.DoubleType()),
        T.StructField("status_code", T.IntegerType()), T.StructField("operation_name", T.StringType()), T.StructField("parent_service_name", T.StringType()),
    ]
)
REQUIRED = ("service_name", "span_id", "parent_id", "trace_id", "duration", "operation_name")
TRACE_SCHEMA = (
    "traceID string, spans array<struct<spanID:string, processID:string, operationName:string, startTime:bigint, duration:double, "
    "references:array<struct<refType:string, spanID:string>>, tags:array<struct<key:string, value:string>>>>, processes map<string, struct<serviceName:string>>"
)
#: What names a run of an experiment.
RESULT_KEYS = ("system", "generator", "percent", "seed")
FAULT_SCHEMA = "faults array<struct<start:double, end:double, fault:string>>"


def normalise_header(df: DataFrame) -> DataFrame:
    """Names stripped and lower-cased; missing required columns are named before any action."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    if missing := [c for c in REQUIRED if c not in out.columns]:
        raise ValueError(f"span table lacks {missing}")
    return out


#: Where a run's name stands in the address of its file.
CSV_RUN, JSON_RUN, FAULT_RUN = r"([^/]*?)(?:_trace)?\.csv$", r"([^/]*?)(?:\.tar)?\.json$", r"([^/]*)\.json$"
CORRUPT = "_corrupt_record"


def _run(pattern: str):
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def _checked_csv(spark: SparkSession, glob: str, run: str) -> DataFrame:
    """Typed spans plus file, record and reason: what a row is refused for, null if nothing.

    A row is refused for a number of fields other than the header's, or for a text that is
    not what its column holds; blanks are nulls, not errors.  All files of ``glob`` have one
    header, else the read ends.
    """
    header = spark.read.option("header", True).csv(glob).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in (*header, CORRUPT)])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(glob)
    raw = raw.select(*[F.col(f"`{c}`") for c in text.names], _run(run).alias("source_run"), F.col("_metadata.file_path").alias("file"))
    named = normalise_header(raw)
    values, wrong = [], [F.when(F.col(CORRUPT).isNotNull(), F.lit("fields"))]
    for f in SPAN_SCHEMA:
        if f.name not in named.columns:
            values.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        blank = F.trim(F.col(f.name)) == ""
        value = F.col(f.name).try_cast(f.dataType)
        values.append(value.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            wrong.append(F.when(F.col(f.name).isNotNull() & ~blank & value.isNull(), F.lit(f.name)))
    said = F.array_compact(F.array(*wrong))
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*[c for c in named.columns if c not in (CORRUPT, "source_run", "file")])))
    return named.select(*values, "source_run", "file", record.alias("record"), F.when(F.size(said) > 0, F.array_join(said, ",")).alias("reason"))


def read_span_csv(spark: SparkSession, glob: str, system: str, kind: str = "fault_run", run: str = CSV_RUN) -> DataFrame:
    """Spans of one file per run, without the rows ``refused_spans`` tells; the run is the file stem without ``_trace``."""
    good = _checked_csv(spark, glob, run).filter("reason is null").drop("file", "record", "reason")
    return good.select("*", F.lit(None).cast("long").alias("span_seq"), F.lit(system).alias("system"), F.lit(kind).alias("source_kind"))


def refused_spans(spark: SparkSession, glob: str, run: str = CSV_RUN) -> DataFrame:
    """(source_run, file, reason, record) of the rows that are no spans: the wrong columns' names, or ``fields``, and the row itself."""
    return _checked_csv(spark, glob, run).filter("reason is not null").select("source_run", "file", "reason", "record")


def csv_counts(spark: SparkSession, glob: str, run: str = CSV_RUN) -> DataFrame:
    """(source_run, file, rows, refused) of every file with rows."""
    rows = _checked_csv(spark, glob, run)
    return rows.groupBy("source_run", "file").agg(F.count(F.lit(1)).alias("rows"), F.count("reason").alias("refused"))


def spans_from_traces(traces: DataFrame) -> DataFrame:
    """(source_run, traceID, spans, processes) rows to spans, positions kept as span_seq."""
    s = traces.select("source_run", "traceID", "processes", F.posexplode("spans").alias("span_seq", "s"))
    parent = F.expr("get(filter(s.references, r -> r.refType = 'CHILD_OF'), 0).spanID")
    status = F.expr("get(filter(s.tags, t -> t.key = 'http.status_code'), 0).value").try_cast("int")
    service = F.coalesce(F.expr("try_element_at(processes, s.processID).serviceName"), F.lit("unknown_service"))
    spans = s.select(
        "source_run", F.col("traceID").alias("trace_id"), F.col("span_seq").cast("long").alias("span_seq"), F.col("s.spanID").alias("span_id"),
        F.coalesce(parent, F.lit("")).alias("parent_id"), service.alias("service_name"), F.coalesce("s.operationName", F.lit("unknown_operation")).alias("operation_name"),
        F.expr("s.startTime div 1000000").alias("timestamp"), F.col("s.duration").alias("duration"), F.coalesce(status, F.lit(0)).alias("status_code"),
    )
    up = spans.groupBy("source_run", "trace_id", F.col("span_id").alias("parent_id")).agg(F.max_by("service_name", "span_seq").alias("up"))
    return spans.join(up, ["source_run", "trace_id", "parent_id"], "left").withColumn("parent_service_name", F.coalesce("up", F.lit("no_parent"))).drop("up")


def _checked_json(spark: SparkSession, glob: str, schema: str, lines: bool, run: str) -> DataFrame:
    """The documents of ``glob``, with run, file, and the text of those that are not of ``schema``."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", not lines).json(glob)
    return raw.select("*", _run(run).alias("source_run"), F.col("_metadata.file_path").alias("file"))


def read_trace_json(spark: SparkSession, glob: str, system: str, lines: bool = False, run: str = JSON_RUN) -> DataFrame:
    """Nested trace files (a JSON array each, or with ``lines`` a trace a line), without what ``refused_traces`` tells; the run is the stem without ``.tar``."""
    traces = _checked_json(spark, glob, TRACE_SCHEMA, lines, run).filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "file")
    return spans_from_traces(traces).withColumn("system", F.lit(system)).withColumn("source_kind", F.lit("no_fault_archive"))


def refused_traces(spark: SparkSession, glob: str, lines: bool = False, run: str = JSON_RUN) -> DataFrame:
    """(source_run, file, trace_id, record) of the documents that are no traces; a file that is one array is one document."""
    bad = _checked_json(spark, glob, TRACE_SCHEMA, lines, run).filter(F.col(CORRUPT).isNotNull())
    # Saved: a plan that asks for nothing but the refused texts is not allowed.
    return materialize(bad.select("source_run", "file", F.col("traceID").alias("trace_id"), F.col(CORRUPT).alias("record")), "refused-traces")


def read_fault_windows(spark: SparkSession, glob: str, run: str = FAULT_RUN) -> DataFrame:
    """(source_run, fault_idx, w_start, w_end, fault); SYS.fault-x.json describes run SYS.x.  Files that are not of the format are told by ``refused_faults``."""
    raw = _checked_json(spark, glob, FAULT_SCHEMA, False, run).filter(F.col(CORRUPT).isNull())
    return raw.select(F.regexp_replace("source_run", r"\.fault-", ".").alias("source_run"), F.posexplode("faults").alias("fault_idx", "f")).select(
        "source_run", "fault_idx", F.col("f.start").alias("w_start"), F.col("f.end").alias("w_end"), F.col("f.fault").alias("fault")
    )


def refused_faults(spark: SparkSession, glob: str, run: str = FAULT_RUN) -> DataFrame:
    """(source_run, file, faults, record) of fault files that are not of the format."""
    bad = _checked_json(spark, glob, FAULT_SCHEMA, False, run).filter(F.col(CORRUPT).isNotNull())
    return materialize(bad.select("source_run", "file", F.size("faults").alias("faults"), F.col(CORRUPT).alias("record")), "refused-faults")


def write_labelled(spans: DataFrame, path: str) -> None:
    """One partition per system and label; unlabelled traces keep a partition of their own."""
    spans.write.partitionBy("system", "trace_label").mode("overwrite").parquet(path)


def write_corpus(table: DataFrame, path: str) -> None:
    table.write.partitionBy("system", "corpus", "label").mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def put_results(rows: DataFrame, path: str, keys: tuple[str, ...] = RESULT_KEYS) -> None:
    """Add result rows; rows that are there under the same keys are replaced, so a retry leaves each key once.

    Each key is a partition, and a write replaces the partitions it has rows for.
    """
    rows.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table ``put_results`` keeps; the schema gives the keys their kinds and the columns their order."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def save_by_graph(table: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Save ``table`` bucketed and sorted by graph_id; read back, joins and groups by graph need no exchange.

    Tables that meet must have the same number of buckets.  Joins by graph and more (a node,
    say) profit where ``spark.sql.requireAllClusterKeysForCoPartition`` is off.
    """
    writer = table.write.format("parquet").mode("overwrite").bucketBy(buckets, "graph_id").sortBy("graph_id")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return table.sparkSession.table(name)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Vocabularies and graph counts per system, one small JSON file."""
    metadata.coalesce(1).write.mode("overwrite").json(path)
