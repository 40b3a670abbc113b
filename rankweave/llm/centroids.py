"""Operator 11: exact integer k-means by ball-tree filtering.

Vectors become integers once. Each task packs those it reads into metric trees of at most TREE_SIZE vectors, whose nodes
store radius, count and integer sum; the trees are written as rows and serve all rounds. A round carries the centroids into
the tasks: where the triangle inequality leaves one centroid for a ball, its count and sum go to that centroid whole, other
balls are opened down to their leaves, whose vectors are compared exactly. A task gives one row per cluster, so that a round
shuffles as many rows as tasks times clusters, and the driver gets one row per cluster.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones are left out, and
so are those with a component of more than 2^27 in its integer form, as their squared distances don't fit a long; of equally
near centroids the smaller number wins; seeds with equal hashes (repeated rows) come in the order of their components;
vectors without an id are clustered, but are seeds only if others don't suffice; repeated rows are vectors of their own;
with fewer vectors than centroids each is a seed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import dropped, written

#: Vectors of a tree and of a leaf.
TREE_SIZE, LEAF_SIZE = 4_096, 16
#: Largest component that keeps a squared distance of 64 components within a long, and within a double's exact integers.
LARGEST, EXACT_IN_DOUBLE = 1 << 27, 1 << 22


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id (as text, which pandas keeps exact beside nulls), q: floor(scale * component) of the vectors that take part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LARGEST // scale))
    return vectors.where((F.size(x) == dim) & fits).select(F.col("vec_id").cast("string").alias("vec_id"), whole.alias("q"))


def grow(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points in the tree, and its nodes: from, to, left (its right sibling follows; -1 for a leaf), radius, sum."""
    order, spans, left, radius, sums = np.arange(len(points)), [(0, len(points))], [], [], []
    for a, b in spans:  # grows while it is read
        own = points[order[a:b]].astype(np.float64)
        sums.append(points[order[a:b]].sum(axis=0))
        off = own - own.mean(axis=0)
        far = np.einsum("ij,ij->i", off, off)
        radius.append(np.sqrt(far.max()))
        if b - a <= LEAF_SIZE or not far.any():
            left.append(-1)
            continue
        # Halves along the line between two points that are far apart.
        one = off[far.argmax()]
        away = off - one
        two = off[np.einsum("ij,ij->i", away, away).argmax()]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(off @ (two - one), half)]
        left.append(len(spans))
        spans += [(a, a + half), (a + half, b)]
    return order, {"span": np.array(spans, np.int64), "left": np.array(left, np.int64), "radius": np.array(radius), "sum": np.array(sums, np.int64)}


def plant(vectors: DataFrame) -> DataFrame:
    """A row per tree: ids, points in tree order, nodes."""

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), TREE_SIZE):
                part = batch.iloc[a : a + TREE_SIZE]
                points = np.stack(part["q"].to_numpy()).astype(np.int64)
                order, nodes = grow(points)
                kind = next(t for t in (np.int8, np.int16, np.int32) if np.abs(points).max() <= np.iinfo(t).max)
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy()[order]], "width": [np.dtype(kind).itemsize], "points": [points[order].astype(kind).tobytes()], **{k: [v.tobytes()] for k, v in nodes.items()}})

    return vectors.mapInPandas(trees, "ids array<string>, width int, points binary, span binary, left binary, radius binary, sum binary")


class Tree:
    def __init__(self, row, dim: int):
        self.ids, self.points = row.ids, np.frombuffer(row.points, f"<i{row.width}").reshape(-1, dim).astype(np.int64)
        self.span, self.left, self.radius = np.frombuffer(row.span, np.int64).reshape(-1, 2), np.frombuffer(row.left, np.int64), np.frombuffer(row.radius)
        self.sum = np.frombuffer(row.sum, np.int64).reshape(-1, dim)
        self.count = self.span[:, 1] - self.span[:, 0]

    def exact(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared distances of these points from all centroids, without rounding."""
        own = self.points[rows]
        if max(np.abs(own).max(initial=0), np.abs(centroids).max()) <= EXACT_IN_DOUBLE:
            a, c = own.astype(np.float64), centroids.astype(np.float64)
            return ((a * a).sum(axis=1)[:, None] - 2 * a @ c.T + (c * c).sum(axis=1)).astype(np.int64)
        return np.stack([((own - c) ** 2).sum(axis=1) for c in centroids], axis=1)

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls that go whole to one centroid, with its number, and points of opened leaves, with theirs."""
        balls, owners, loose = [], [], []
        nodes, open_to = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            center = self.sum[nodes] / self.count[nodes, None]
            far = np.sqrt(np.maximum(((center[:, None, :] - centroids[None]) ** 2).sum(axis=2), 0))
            r = self.radius[nodes]
            nearest = np.where(open_to, far, np.inf).min(axis=1)
            # A point's distance differs from its ball's by the radius at most; the margin is for rounding, and keeps ties open.
            open_to = open_to & (far <= (nearest + 2 * r + 1e-6 * (1 + nearest + r))[:, None])
            single = open_to.sum(axis=1) == 1
            balls.append(nodes[single])
            owners.append(open_to[single].argmax(axis=1))
            leaf = ~single & (self.left[nodes] < 0)
            loose += [np.arange(a, b) for a, b in self.span[nodes[leaf]]]
            inner = ~single & ~leaf
            nodes = np.repeat(self.left[nodes[inner]], 2) + np.tile([0, 1], inner.sum())
            open_to = np.repeat(open_to[inner], 2, axis=0)
        points = np.concatenate(loose) if loose else np.zeros(0, np.int64)
        return np.concatenate(balls), np.concatenate(owners), points, self.exact(points, centroids).argmin(axis=1)


def update(trees: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The next centroids: floor(sum / count) of each component; a centroid without vectors stays."""
    now = np.array(centroids, np.int64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
        for batch in batches:
            for row in batch.itertuples():
                tree = Tree(row, dim)
                balls, owners, points, nearest = tree.assigned(now)
                np.add.at(total, owners, tree.sum[balls])
                np.add.at(count, owners, tree.count[balls])
                np.add.at(total, nearest, tree.points[points])
                np.add.at(count, nearest, 1)
        yield pd.DataFrame({"cluster": range(len(now)), "n": count, "total": list(total)})

    found = trees.mapInPandas(sums, "cluster int, n long, total array<long>").where("n > 0")
    added = F.array(*(F.sum(F.col("total")[i]) for i in range(dim)))
    out = [list(c) for c in centroids]
    for row in found.groupBy("cluster").agg(F.sum("n").alias("n"), added.alias("total")).collect():
        out[row.cluster] = [x // row.n for x in row.total]
    return out


def assign(trees: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """vec_id, cluster, distance (squared)."""
    now = np.array(centroids, np.int64).reshape(-1, dim)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                tree = Tree(row, dim)
                balls, owners, points, nearest = tree.assigned(now)
                cluster = np.zeros(len(tree.points), np.int64)
                for (a, b), owner in zip(tree.span[balls], owners, strict=True):
                    cluster[a:b] = owner
                cluster[points] = nearest
                distance = ((tree.points - now[cluster]) ** 2).sum(axis=1)
                yield pd.DataFrame({"vec_id": tree.ids, "cluster": cluster.astype(np.int32), "distance": distance})

    return trees.mapInPandas(each, "vec_id string, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of each vector (as a written table), and the centroids."""
    whole = integer_vectors(vectors, dim, scale)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), "vec_id").cast("binary"), 256)
    centroids = [list(r.q) for r in whole.orderBy(by_hash.asc_nulls_last(), "q").limit(k).collect()]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, cluster int, distance long"), []
    trees = written(plant(whole))
    for _ in range(rounds):
        centroids = update(trees, centroids, dim)
    out = written(assign(trees, centroids, dim).withColumn("vec_id", F.col("vec_id").cast(id_type)))
    dropped(trees)
    return out, centroids


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    own = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    about = [(i, own.get(i, 0), sum(own.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    rows = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    return f"""n{i} AS (
    SELECT vec_id, q, min(struct_pack(d := CAST(list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)]) AS BIGINT), k := k)) AS best FROM v, c{i} GROUP BY r, vec_id, q
)"""


def _next(i: int) -> str:
    return f"""s{i} AS (
    SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(range(1, 65)) AS i, unnest(q) AS x FROM n{i}) GROUP BY k, i
), u{i} AS (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY k
), c{i + 1} AS (
    SELECT k, coalesce(u{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN u{i} USING (k)
)"""


OP11_SQL = f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS k, q AS c FROM v ORDER BY k LIMIT 16
), {", ".join(x for i in range(3) for x in (_round(i), _next(i)))}, {_round(3)}, by_cluster AS (
    SELECT best.k AS k, sum(best.d) AS own FROM n3 GROUP BY 1
)
SELECT vec_id, CAST(k AS INTEGER) AS "cluster", best.d AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST((SELECT sum(best.d) FROM n3) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT vec_id, best, best.k AS k FROM n3) JOIN by_cluster USING (k) JOIN c3 USING (k)
"""
