"""Exact cosine join of embeddings by subspace pigeonhole.

Unit vectors with cosine >= c differ by at most 2 (1 - c) in squared length.  After a
fixed rotation the dimensions are split into blocks, and some block must differ by no
more than its share of that budget (in proportion to its dimensions).  Each block is a
range join: pivots partition its space, a vector lives in the cell of its nearest pivot
and also visits cells that a vector within the block's radius might live in.  Inside a
cell, block distances give candidates and the whole vectors decide, in double precision.

Cells never emit pairs.  They emit, per vector, how many links they found, and per
vector one edge to the smallest partner in its local component.  A pair that several
blocks would find is counted in the first of them alone.  Equal vectors are one node
with a multiplicity.  A crowded cell is split into tiles, each of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.components import components
from spanforge.llm.stage import hash32, materialize

COSINE = 0.95
BLOCKS = 2
#: Pivots per block: about PIVOT_SCALE * sqrt(vectors), between the bounds; the sample they
#: come from has as many rows and is all that reaches the driver.
PIVOT_SCALE, MIN_PIVOTS, MAX_PIVOTS = 1.0, 8, 4096
#: Most residents, and most visitors, compared in one tile.
TILE_ROWS = 2048
#: Slack on block distances (float rounding never loses a candidate).
SLACK = 1e-6


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, the same in every run."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def _distance2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of tiny or huge numbers stay numbers
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _link_tile(tile: pd.DataFrame, spin: np.ndarray, edges: list[tuple[int, int]], budget: float, cosine: float) -> pd.DataFrame:
    """Links between the residents and visitors of one tile of one block's cell."""
    block = int(tile["block"].iloc[0])
    home = tile["resident"].to_numpy()
    node, times, cell = tile["node"].to_numpy(), tile["times"].to_numpy(), tile["home"].to_numpy()
    unit = _unit(np.stack(tile["vector"].to_numpy()).astype(np.float64))
    spun = unit @ spin
    a, b = np.flatnonzero(home), np.flatnonzero(~home)
    n_links = np.zeros(len(tile), np.int64)
    ends: list[np.ndarray] = []
    share = [budget * (hi - lo) / spin.shape[1] + SLACK for lo, hi in edges]
    lo, hi = edges[block]
    for k in range(0, len(a), 64):
        rows = a[k : k + 64]
        i, j = np.nonzero(_distance2(spun[rows, lo:hi], spun[b, lo:hi]) <= share[block] + SLACK)
        i, j = rows[i], b[j]
        # A resident also visits its own cell; there each pair is taken once.
        once = (cell[j] < cell[i]) | ((cell[j] == cell[i]) & (node[j] < node[i]))
        i, j = i[once], j[once]
        for e in range(block + 1):
            within = ((spun[i, edges[e][0] : edges[e][1]] - spun[j, edges[e][0] : edges[e][1]]) ** 2).sum(1) <= share[e]
            taken = within if e == block else ~within
            i, j = i[taken], j[taken]
        linked = (unit[i] * unit[j]).sum(1) >= cosine
        i, j = i[linked], j[linked]
        n_links += np.bincount(i, weights=times[j], minlength=len(tile)).astype(np.int64)
        n_links += np.bincount(j, weights=times[i], minlength=len(tile)).astype(np.int64)
        ends.append(np.stack([i, j]))
    i, j = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    # Local components: everybody takes the smallest label around until nothing moves.
    names, label_of = np.unique(node, return_inverse=True)
    label = np.arange(len(names))
    i, j = label_of[i], label_of[j]
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    links = np.bincount(label_of, weights=n_links, minlength=len(names)).astype(np.int64)
    told = np.flatnonzero((links > 0) | (label != np.arange(len(names))))
    return pd.DataFrame({"node": names[told], "root": names[label[told]], "n_links": links[told]})


def _links(nodes: DataFrame, n: int, dim: int, kind: str, cosine: float, blocks: int) -> DataFrame:
    """(node, root, n_links) of the links among ``n`` distinct vectors (node, times, vector) of one length."""
    spin, edges = rotation(dim), block_edges(dim, blocks)
    budget = 2.0 * (1.0 - cosine)
    wanted = int(min(MAX_PIVOTS, max(MIN_PIVOTS, PIVOT_SCALE * n**0.5)))
    picked = nodes.orderBy(hash32(F.col("node").cast("string")), "node").limit(wanted).select("vector").toPandas()
    pivots = _unit(np.stack(picked["vector"].to_numpy()).astype(np.float64)) @ spin
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.iloc[k : k + 1024]
                spun = _unit(np.stack(part["vector"].to_numpy()).astype(np.float64)) @ spin
                for block, (lo, hi) in enumerate(edges):
                    radius = (budget * (hi - lo) / dim + SLACK) ** 0.5
                    points, sites = spun[:, lo:hi], centres[:, lo:hi]
                    d2 = _distance2(points, sites)
                    home = d2.argmin(1)
                    # A partner at home with pivot p lies on p's side of the plane between p and
                    # this vector's own pivot; the vector is within the radius of that plane.
                    between = _distance2(sites, sites) ** 0.5
                    gap = d2 - d2[np.arange(len(part)), home][:, None]
                    visit = gap <= 2 * radius * between[home] + SLACK
                    # Of two cells the pair is taken in the later one, so go only up.
                    visit &= np.arange(len(sites))[None, :] >= home[:, None]
                    who, where = np.nonzero(visit)
                    m, v = len(part), len(who)
                    at = np.concatenate([np.arange(m), who])
                    yield pd.DataFrame(
                        {
                            "block": np.full(m + v, block, np.int32),
                            "cell": np.concatenate([home, where]).astype(np.int32),
                            "home": home[at].astype(np.int32),
                            "resident": np.concatenate([np.ones(m, bool), np.zeros(v, bool)]),
                            "node": part["node"].to_numpy()[at],
                            "times": part["times"].to_numpy()[at],
                            "vector": part["vector"].to_numpy()[at],
                        }
                    )

    placed = nodes.select("node", "times", F.col("vector")).mapInPandas(
        place, "block int, cell int, home int, resident boolean, node long, times long, vector array<" + kind + ">"
    )
    placed = materialize(placed, "embed-cells")
    crowd = placed.groupBy("block", "cell").agg(
        F.expr(f"(count_if(resident) + {TILE_ROWS - 1}) div {TILE_ROWS}").alias("res_tiles"),
        F.expr(f"(count_if(not resident) + {TILE_ROWS - 1}) div {TILE_ROWS}").alias("vis_tiles"),
    )
    tile = F.expr("cast(pmod(xxhash64(node), if(resident, res_tiles, vis_tiles)) as int)")
    other = F.expr("sequence(0, cast(if(resident, vis_tiles, res_tiles) as int) - 1)")
    tiles = (
        placed.join(F.broadcast(crowd), ["block", "cell"])  # one row per block and pivot
        .filter("res_tiles > 0 and vis_tiles > 0")
        .withColumn("mine", tile).withColumn("other", F.explode(other))
        .withColumn("res_tile", F.expr("if(resident, mine, other)")).withColumn("vis_tile", F.expr("if(resident, other, mine)"))
        .drop("mine", "other", "res_tiles", "vis_tiles")
    )
    return materialize(
        tiles.groupBy("block", "cell", "res_tile", "vis_tile").applyInPandas(
            lambda group: _link_tile(group, spin, edges, budget, cosine), "node long, root long, n_links long"
        ),
        "embed-links",
    )


def link_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold a null or non-finite number link with
    nothing and are their own component; vectors of each length are compared among
    themselves, one join per length.  Repeated rows and equal vectors link with each other.  Null ids come out with a null component unless
    linked.  Other columns are ignored; an empty table gives an empty result.
    """
    x = F.col("vector")
    kind = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    finite = F.expr("forall(vector, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    usable = x.isNotNull() & finite & F.exists(x, lambda v: v != F.lit(0).cast(kind))
    # -0.0 is 0.0: equal vectors must be one key.
    rows = materialize(
        rows.withColumn("vector", F.when(usable, F.transform(x, lambda v: v + F.lit(0).cast(kind)))).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector", F.size("vector")))),
        "embed-rows",
    )
    nodes = materialize(
        rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"), F.first("vector").alias("vector")),
        "embed-nodes",
    )
    found = vectors.sparkSession.createDataFrame([], "node long, root long, n_links long")
    for size in nodes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("dim").collect():
        found = found.unionByName(_links(nodes.filter(F.size("vector") == size["dim"]), size["n"], size["dim"], kind, cosine, blocks))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    comps = components(found.filter("node <> root"), "node", "root")
    named = (
        nodes.select("node", "least", "times").join(comps, "node", "left").join(counts, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), "least", (F.col("times") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    )
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "root").select("node", "component_id", "n_links")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "node").join(labels, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
