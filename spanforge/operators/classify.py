"""Graph classification on propagated features: sparse rows, a whole grid of experiments fitted together."""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.operators.graphs import vocabulary
from spanforge.operators.metrics import average_precision, confusion_report
from spanforge.sources.shared import materialize

#: Penalties a cell chooses from.
PENALTIES = (0.001, 0.01, 0.1)
#: A descent ends at this slope, or after so many steps; it remembers so many.
ENOUGH, STEPS, REMEMBERED = 1e-6, 60, 8
#: Rows handled at once inside a task.
CHUNK = 2048
#: A table of at most so many rows, counted, is broadcast.
BROADCAST_ROWS = 400_000


def node_features(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Sparse long rows (graph_id, node_idx, feature, value): service, op, normalised log duration; other columns of ``nodes`` stay."""
    base = nodes.crossJoin(F.broadcast(stats))  # one row
    z = (F.log1p(F.greatest("duration", F.lit(0.0))) - F.col("log_mean")) / F.col("log_sd")
    rows = F.array(
        F.struct(F.concat(F.lit("s:"), "service_name").alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.concat(F.lit("o:"), "operation_name").alias("feature"), F.lit(1.0).alias("value")),
        F.struct(F.lit("duration").alias("feature"), z.alias("value")),
    )
    return base.withColumn("f", F.explode(rows)).select(*nodes.columns, "f.feature", "f.value")


def node_weights(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(graph_id, node_idx, weight): S^rounds applied to ones, S = D^-1/2 (A + I) D^-1/2 of the undirected graph.

    S is symmetric, so the sum over nodes of S^rounds X is this vector times X: what
    travels along edges is one number a node, however many features there are.
    """
    apart = edges.filter("src <> dst")
    both = apart.select("graph_id", "src", "dst").union(apart.select("graph_id", "dst", "src"))
    links = both.distinct().union(nodes.select("graph_id", F.col("node_idx").alias("src"), F.col("node_idx").alias("dst")))
    degree = links.groupBy("graph_id", F.col("src").alias("node_idx")).agg(F.count(F.lit(1)).alias("d"))
    # u is what a node sends on: its value over the root of its degree.
    u = degree.select("graph_id", F.col("node_idx").alias("src"), (1 / F.sqrt("d")).alias("u"))
    for k in range(rounds):
        met = links.join(u, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_idx")).agg(F.sum("u").alias("u"))
        met = met.join(degree, ["graph_id", "node_idx"])
        last = k == rounds - 1
        u = met.select("graph_id", F.col("node_idx").alias("node_idx" if last else "src"), (F.col("u") / (F.sqrt("d") if last else F.col("d"))).alias("weight" if last else "u"))
    return u


def graph_features(nodes: DataFrame, edges: DataFrame, stats: DataFrame, rounds: int = 2) -> DataFrame:
    """(graph_id, feature, value): features propagated ``rounds`` times (at least once), mean over the graph's nodes."""
    weighted = nodes.select("graph_id", "node_idx", "service_name", "operation_name", "duration").join(node_weights(nodes, edges, rounds), ["graph_id", "node_idx"])
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    total = node_features(weighted, stats).groupBy("graph_id", "feature").agg(F.sum(F.col("value") * F.col("weight")).alias("total"))
    return total.join(sizes, "graph_id").select("graph_id", "feature", (F.col("total") / F.col("n")).alias("value"))


def sparse_rows(features: DataFrame, train: DataFrame) -> tuple[DataFrame, int]:
    """((graph_id, ids, vals), how many names) from long features; ids number the sorted feature names of ``train`` graphs, names they lack are dropped."""
    features = materialize(features, "classify-features")
    names = materialize(vocabulary([features.join(train, "graph_id", "left_semi")], "feature"), "classify-names")
    n = names.count()
    known = features.join(F.broadcast(names) if n <= BROADCAST_ROWS else names, F.col("feature") == F.col("name"), "left")
    entry = F.when(F.col("id").isNotNull(), F.struct(F.col("id").cast("int").alias("id"), "value"))
    rows = known.groupBy("graph_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return materialize(rows.select("graph_id", F.col("e.id").alias("ids"), F.col("e.value").alias("vals")), "classify-sparse"), n


def _descent(start: np.ndarray) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps of one model: gives the points it wants to know, takes (loss, slope), returns the last."""
    x = start
    loss, slope = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() <= ENOUGH:
            break
        way, shares = slope.copy(), []
        for move, turn in reversed(past):
            shares.append((move @ way) / (move @ turn))
            way -= shares[-1] * turn
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (move, turn), share in zip(past, reversed(shares)):
            way += (share - (turn @ way) / (move @ turn)) * move
        reach = 1.0
        while True:
            there = x - reach * way
            new_loss, new_slope = yield there
            if new_loss <= loss - 1e-4 * reach * float(slope @ way):
                break
            reach /= 2
            if reach < 1e-6:
                return x
        if (there - x) @ (new_slope - slope) > 1e-14:
            past = [*past, (there - x, new_slope - slope)][-REMEMBERED:]
        x, loss, slope = there, new_loss, new_slope
    return x


def _losses(work: DataFrame, weights: np.ndarray, cells: list[int], role: str, slopes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weighted loss, weight, slope) of every model (a row of ``weights``, the intercept last) over its cell's graphs of a role: one pass for all models.

    A task sends one row a model; they are added up by model before they reach the driver,
    which gets as many numbers as the models have.
    """
    width = weights.shape[1]
    shared = work.sparkSession.sparkContext.broadcast(weights)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        loss, mass, pull = np.zeros(len(w)), np.zeros(len(w)), np.zeros(w.shape if slopes else (len(w), 0))
        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                part = batch.slice(k, CHUNK)
                row, ids, vals = _flat(part)
                at, use = _uses(part)
                mine = use["role"] == role
                for m, cell in enumerate(cells):
                    held = mine & (use["cell"] == cell)
                    if not held.any():
                        continue
                    rows, y, much = at[held], use["label"][held], use["weight"][held]
                    margin = np.bincount(row, weights=w[m, ids] * vals, minlength=len(part))[rows] + w[m, -1]
                    loss[m] += (much * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum()
                    mass[m] += much.sum()
                    if slopes:
                        off = much * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y)
                        pull[m, -1] += off.sum()
                        pull[m, :-1] += np.bincount(ids, weights=np.bincount(rows, weights=off, minlength=len(part))[row] * vals, minlength=width - 1)
        yield _sums(loss, mass, pull, range(len(w)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                pull = np.frombuffer(r["pull"])
                old = total.get(r["m"], (0.0, 0.0, 0.0))
                total[r["m"]] = [old[0] + r["loss"], old[1] + r["mass"], old[2] + pull]
        if total:
            yield _sums([t[0] for t in total.values()], [t[1] for t in total.values()], [t[2] for t in total.values()], total)

    def _sums(loss, mass, pull, models) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"m": pa.array(list(models), pa.int32()), "loss": pa.array(list(loss), pa.float64()), "mass": pa.array(list(mass), pa.float64()), "pull": pa.array([np.asarray(p).tobytes() for p in pull], pa.binary())}
        )

    schema = "m int, loss double, mass double, pull binary"
    got = work.mapInArrow(local, schema).repartition("m").mapInArrow(merged, schema).toArrow().to_pylist()
    shared.destroy()
    loss, mass, pull = np.zeros(len(weights)), np.zeros(len(weights)), np.zeros(weights.shape if slopes else (len(weights), 0))
    for r in got:
        loss[r["m"]], mass[r["m"]], pull[r["m"]] = r["loss"], r["mass"], np.frombuffer(r["pull"])
    return loss, mass, pull


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, value) of the entries of sparse rows."""
    lengths = part.column("ids").value_lengths().to_numpy()
    return np.repeat(np.arange(len(part)), lengths), part.column("ids").flatten().to_numpy(), part.column("vals").flatten().to_numpy()


def _uses(part: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row, the fields) of what the graphs of these rows are used for."""
    uses = part.column("uses")
    flat = uses.flatten()
    return np.repeat(np.arange(len(part)), uses.value_lengths().to_numpy()), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def fit_grid(work: DataFrame, n_features: int, cells: list[int], regs: tuple[float, ...]) -> np.ndarray:
    """Weights (intercept last) of a model for each cell and penalty, cell by cell: class-weighted logistic regression.

    The mean weighted log loss plus half the penalty times the squared weights.  All models
    descend together: a pass over the rows answers what every one of them asks next, so the
    number of passes is that of the slowest.
    """
    wanted = [(c, r) for c in cells for r in regs]
    paths = {m: _descent(np.zeros(n_features + 1)) for m in range(len(wanted))}
    asked = {m: next(path) for m, path in paths.items()}
    done = np.zeros((len(wanted), n_features + 1))
    while asked:
        models = list(asked)
        loss, mass, pull = _losses(work, np.stack([asked[m] for m in models]), [wanted[m][0] for m in models], "train", True)
        for k, m in enumerate(models):
            x, reg, n = asked[m], wanted[m][1], max(mass[k], 1e-300)
            slope = pull[k] / n
            slope[:-1] += reg * x[:-1]
            try:
                asked[m] = paths[m].send((loss[k] / n + reg / 2 * float(x[:-1] @ x[:-1]), slope))
            except StopIteration as end:
                done[m] = end.value
                del asked[m]
    return done


def fit_and_score(x: DataFrame, n_features: int, uses: DataFrame, regs: tuple[float, ...] = PENALTIES) -> DataFrame:
    """(graph_id, cell, role, label, pred, score) of a classifier per cell, its penalty chosen by the log loss of the val role.

    ``x``: sparse rows; ``uses``: graph_id, cell (int), role (train, val, test), label (0 or
    1).  Class weights come from a cell's training labels.  Without training graphs every
    score is 0.5; without val graphs the first penalty is taken.  Graphs and cells fit
    alike, so a whole grid is one fit; what the driver holds is a number per cell, penalty
    and feature name.
    """
    uses = materialize(uses.select("graph_id", F.col("cell").cast("int").alias("cell"), "role", F.col("label").cast("double").alias("label")), "classify-uses")
    counts = uses.filter("role = 'train'").groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    of_cell = Window.partitionBy("cell")  # one row per class
    raw = counts.withColumn("raw", F.sum("n").over(of_cell) / F.col("n"))
    share = raw.select("cell", "label", (F.col("raw") / F.avg("raw").over(of_cell)).alias("share"))
    weight = F.when(F.col("role") == "train", F.coalesce("share", F.lit(0.0))).otherwise(1.0)
    weighted = uses.join(F.broadcast(share), ["cell", "label"], "left").withColumn("weight", weight)  # two rows per cell
    packed = weighted.groupBy("graph_id").agg(F.collect_list(F.struct("cell", "role", "label", "weight")).alias("uses"))
    work = materialize(x.join(packed, "graph_id"), "classify-work")
    cells = sorted(r["cell"] for r in uses.select("cell").distinct().collect())
    if not cells:
        return uses.select("graph_id", "cell", "role", F.col("label").cast("int").alias("label"), F.lit(0).alias("pred"), F.lit(0.5).alias("score"))
    weights = fit_grid(work, n_features, cells, regs)
    loss, mass, _ = _losses(work, weights, [c for c in cells for _ in regs], "val", False)
    mean = np.where(mass > 0, loss / np.maximum(mass, 1e-300), 0.0).reshape(len(cells), len(regs))
    best = {c: weights[k * len(regs) + int(mean[k].argmin())] for k, c in enumerate(cells)}
    shared = work.sparkSession.sparkContext.broadcast(best)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), CHUNK):
                part = batch.slice(k, CHUNK)
                row, ids, vals = _flat(part)
                at, use = _uses(part)
                margin = np.zeros(len(at))
                for cell, w in shared.value.items():
                    mine = use["cell"] == cell
                    margin[mine] = np.bincount(row, weights=w[ids] * vals, minlength=len(part))[at[mine]] + w[-1]
                p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("graph_id").take(pa.array(at)), pa.array(use["cell"], pa.int32()), pa.array(use["role"], pa.string()), pa.array(use["label"].astype(np.int32)), pa.array((margin > 0).astype(np.int32)), pa.array(np.round(p, 6))],
                    ["graph_id", "cell", "role", "label", "pred", "score"],
                )

    return work.mapInArrow(score, f"graph_id {x.schema['graph_id'].dataType.simpleString()}, cell int, role string, label int, pred int, score double")


def sweep(x: DataFrame, n_features: int, prepared: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One result row per ``keys`` (system, generator, percent): training counts, test metrics, average precision.

    ``prepared``: keys, graph_id, corpus, label, role.  The cells are the experiment's grid,
    a few dozen, and are numbered on the driver; one fit serves them all.
    """
    grid = [tuple(r) for r in prepared.select(*keys).distinct().orderBy(*keys).collect()]
    numbered = prepared.sparkSession.createDataFrame([(k, *g) for k, g in enumerate(grid)], T.StructType([T.StructField("cell", T.IntegerType()), *[prepared.schema[k] for k in keys]]))
    mine = prepared.join(F.broadcast(numbered), keys)  # one row per cell
    scored = materialize(fit_and_score(x, n_features, mine), "classify-scored")
    test = scored.filter("role = 'test'").select("cell", F.col("label").alias("y"), "pred", "score")
    trained = F.col("role") == "train"
    made = mine.groupBy("cell").agg(F.count_if(trained & (F.col("corpus") == "A")).alias("train_real_total"), F.count_if(trained & (F.col("corpus") == "B")).alias("train_synth_total"))
    rows = confusion_report(test, ["cell"]).join(average_precision(test, ["cell"]).withColumnRenamed("average_precision", "pr_auc"), "cell").join(made, "cell")
    return rows.join(F.broadcast(numbered), "cell").withColumn("run_order", F.col("cell") + 1).withColumn("seed", F.lit(seed)).drop("cell")
