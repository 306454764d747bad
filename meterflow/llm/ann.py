"""Approximate nearest neighbours on robustly pruned directed graphs.

Rows are dealt into shards by a hash of their id and vector. Each shard gets a graph: greedy
searches from its middle propose neighbours for every vector, and pruning keeps a proposal only
if no kept neighbour is nearer to it by the factor ``alpha``, so edges point in many
directions. A query is answered by a beam search in every shard; the best of all shards win.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component are
neither indexed nor answered; vectors of another length are never compared; equal vectors are
one node of the graph with all their ids, of which the smallest come first; rows with a null
id take no part; a repeated row counts once; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm.common import stored

NODE = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("node", T.IntegerType()),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("edges", T.ArrayType(T.IntegerType())), T.StructField("entry", T.BooleanType())])
FOUND = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.DoubleType())])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` to rows of ``b`` (the last two axes)."""
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2)), 0)


def beam_search(
    vectors: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int,
    marks: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that greedy searches of all ``queries`` meet, and their distances.

    All queries take a step at once: each opens its nearest unopened node. ``edges`` holds -1
    where a node has fewer neighbours; so does the result where a search meets fewer nodes.
    """
    count, lanes = len(queries), np.arange(len(queries))
    seen = np.zeros((count, len(vectors)), bool)
    nodes = np.full((count, beam), -1)
    far = np.full((count, beam), np.inf, np.float32)
    opened = np.ones((count, beam), bool)
    entry = entry[:beam]
    nodes[:, :len(entry)], opened[:, :len(entry)] = entry, False
    far[:, :len(entry)] = squared(queries, vectors[entry])
    seen[:, entry] = True
    while True:
        waiting = np.where(opened, np.inf, far)
        at = waiting.argmin(1)
        active = np.flatnonzero(np.isfinite(waiting[lanes, at]))
        if not len(active):
            return nodes, far
        opened[active, at[active]] = True
        near = edges[nodes[active, at[active]]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, nodes[active, at[active]][:, None])] = True
        away = ((vectors[near] - queries[active][:, None, :]) ** 2).sum(-1)
        away = np.where(fresh, away, np.inf)
        all_far = np.concatenate([far[active], away], 1)
        all_nodes = np.concatenate([nodes[active], near], 1)
        all_opened = np.concatenate([opened[active], ~fresh], 1)
        best = np.argsort(all_far, 1, kind="stable")[:, :beam]
        rows = np.arange(len(active))[:, None]
        far[active], nodes[active], opened[active] = all_far[rows, best], all_nodes[rows, best], all_opened[rows, best]
        nodes[active] = np.where(np.isfinite(far[active]), nodes[active], -1)


def robust_prune(vectors: np.ndarray, node: int, proposed: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """At most ``degree`` of the ``proposed`` neighbours, near ones first, diverse ones only."""
    proposed = np.unique(proposed[(proposed >= 0) & (proposed != node)])
    points = vectors[proposed]
    far = ((points - vectors[node]) ** 2).sum(1)
    order = np.argsort(far, kind="stable")
    proposed, far = proposed[order], far[order]
    between = squared(points[order], points[order])
    alive, kept = np.ones(len(proposed), bool), []
    for i in range(len(proposed)):
        if alive[i]:
            kept.append(proposed[i])
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[i] > far
    return np.array(kept, int)


def build_graph(vectors: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> tuple[np.ndarray, int]:
    """Edges (rows padded with -1) and the entry node of a shard's graph."""
    count, rng = len(vectors), np.random.default_rng(seed)
    middle = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((count, degree), -1)
    if count > 1:
        start = rng.integers(0, count - 1, (count, min(degree, count - 1)))
        edges[:, :start.shape[1]] = start + (start >= np.arange(count)[:, None])
    entry = np.array([middle])
    for factor in (1.0, alpha):
        order = rng.permutation(count)
        for at in range(0, count, 128):
            batch = order[at:at + 128]
            met, _ = beam_search(vectors, edges, entry, vectors[batch], beam)
            back: dict[int, list[int]] = {}
            for node, proposed in zip(batch, met):
                kept = robust_prune(vectors, node, np.concatenate([proposed, edges[node]]), factor, degree)
                edges[node] = -1
                edges[node, :len(kept)] = kept
                for other in kept:
                    back.setdefault(int(other), []).append(int(node))
            for node, sources in back.items():
                own = edges[node][edges[node] >= 0]
                both = np.concatenate([own, np.setdiff1d(sources, own)])
                if len(both) > degree:
                    both = robust_prune(vectors, node, both, factor, degree)
                edges[node] = -1
                edges[node, :len(both)] = both
    return edges, middle


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (id, vector) that take part, once each."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("id").cast("long").alias("id"), v.cast("array<float>").alias("vector")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)))


def build_index(
    vectors: DataFrame, shard_rows: int = 4096, degree: int = 32, beam: int = 64, alpha: float = 1.2,
) -> DataFrame:
    """Graph nodes of all shards, one row each, stored in the shared folder.

    Shards hold about ``shard_rows`` rows; their number follows from the table.
    """
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).withColumn(
        "shards", F.ceil(F.col("n") / shard_rows).cast("long"))
    dealt = rows.withColumn("width", F.size("vector")).join(F.broadcast(sizes.drop("n")), "width")  # a row per length
    # a frequent vector is spread over all shards by its ids, so no shard has to hold all of them
    part = F.xxhash64("id", "vector")
    dealt = dealt.select("id", "vector", (F.col("width").cast("long") * 1_000_000_007 + F.pmod(part, "shards")).alias("shard"))

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        matrix = np.array(frame["vector"].tolist(), np.float32)
        distinct, which = np.unique(matrix, axis=0, return_inverse=True)
        which = which.ravel()
        edges, entry = build_graph(distinct, degree, beam, alpha, shard)
        ids = frame["id"].to_numpy()
        order = np.lexsort((ids, which))
        bounds = np.searchsorted(which[order], np.arange(len(distinct) + 1))
        return pd.DataFrame({
            "shard": shard, "node": np.arange(len(distinct), dtype=np.int32), "vector": list(distinct),
            "ids": [np.unique(ids[order[a:b]]) for a, b in zip(bounds, bounds[1:])],
            "edges": [e[e >= 0].astype(np.int32) for e in edges], "entry": np.arange(len(distinct)) == entry})

    return stored(dealt.groupBy("shard").applyInPandas(graph, NODE))


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, beam: int = 100, block_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found.

    ``queries`` has id and vector. A row is never found as its own neighbour (by id). Queries
    go to every shard in blocks of about ``block_rows``, so that neither side of a task grows.
    """
    asked = usable(queries).distinct()
    blocks = max(1, -(-asked.count() // block_rows))
    width = F.size("vector").cast("long")
    shards = index.groupBy(F.col("shard").alias("to")).agg(F.first(F.size("vector")).cast("long").alias("width"))
    blocked = asked.withColumn("width", width).withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)))
    sent = blocked.join(shards, "width").select("to", F.col("block").alias("part"), "id", "vector")
    held = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def answer(nodes: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty or part.empty:
            return pd.DataFrame({f.name: [] for f in FOUND})
        nodes = nodes.sort_values("node")
        matrix = np.array(nodes["vector"].tolist(), np.float32)
        edges = np.full((len(nodes), max(1, nodes["edges"].map(len).max())), -1)
        for i, e in enumerate(nodes["edges"]):
            edges[i, :len(e)] = e
        entry, owned = np.flatnonzero(nodes["entry"]), nodes["ids"].tolist()
        asked_ids, wanted = part["id"].to_numpy(), np.array(part["vector"].tolist(), np.float32)
        out = []
        for at in range(0, len(part), 256):
            met, _ = beam_search(matrix, edges, entry, wanted[at:at + 256], max(beam, k + 1))
            for query, vector, found in zip(asked_ids[at:at + 256], wanted[at:at + 256], met):
                found = found[found >= 0]
                exact = np.sqrt(((matrix[found].astype(float) - vector.astype(float)) ** 2).sum(1))
                best, held_back = [], 0
                for place in np.argsort(exact, kind="stable"):
                    if held_back >= k and exact[place] > best[-1][1]:
                        break  # all nodes of equal distance are taken before the ids decide
                    ids = owned[found[place]]
                    ids = ids[ids != query][:k]
                    best += [(int(i), float(exact[place])) for i in ids]
                    held_back += len(ids)
                best = sorted(best, key=lambda x: (x[1], x[0]))[:k]
                out += [(int(query), i, d) for i, d in best]
        return pd.DataFrame(out, columns=FOUND.names)

    found = held.groupBy("shard", "block").cogroup(sent.groupBy("to", "part")).applyInPandas(answer, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
