"""Operator 3: near-duplicate embeddings by cover trees and dual traversal, exact at the threshold.

Equal vectors of a label are one class. A label's classes are dealt to cells around pivots, and large cells to blocks.
Two blocks meet only if the distance between their cells' pivots, less both covering radii, leaves room for a link. A task
builds a cover tree of each block, levels of nested centres whose radii halve, and walks both trees at once: a pair of
nodes is dropped when their centres are farther apart than the link distance and both covering radii allow. The children of
two large nodes are compared by one matrix product. What is left at the leaves is compared in double precision. A task
returns sums and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero, of another length than their block's, or hold null or non-finite
components, and rows without a label or id, link with nothing and are kept; a repeated row counts as another vector; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import components
from rankweave.llm.shared import dropped, written

#: Vectors in a block, and pivots of a label at most; each pivot is meant for half a block.
BLOCK, MAX_PIVOTS = 2048, 256
#: Pairs of nodes that are compared at once, pairs of children from which a matrix product pays, and points that may become centres at once.
AT_ONCE, PRODUCT, BATCH = 1 << 20, 512, 256
SLACK = 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all unit vectors of x and y."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def covered(x: np.ndarray, own: np.ndarray, bound: float) -> Iterator[tuple[np.ndarray, float]]:
    """Members, a centre first, and covering radius of nodes that cover the points `own`; the first point is the first centre."""
    left = own
    while len(left):
        some = left[:BATCH]
        between = distances(x[some], x[some])
        free, chosen = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                chosen.append(i)
                free &= between[i] > bound
        away = np.empty((len(left), len(chosen)))
        for k in range(0, len(left), AT_ONCE // BATCH):
            away[k : k + AT_ONCE // BATCH] = distances(x[left[k : k + AT_ONCE // BATCH]], x[some[chosen]])
        away[chosen, np.arange(len(chosen))] = 0
        near = away <= bound
        # A centre isn't given to another one, whatever rounding says.
        near[chosen] = np.eye(len(chosen), dtype=bool)
        taken, first = near.any(1), near.argmax(1)
        at = np.flatnonzero(taken)
        at = at[np.argsort(first[at], kind="stable")]
        ends = np.cumsum(np.bincount(first[at], minlength=len(chosen)))
        for k, rows in enumerate(np.split(at, ends[:-1])):
            rows = np.r_[chosen[k], rows[rows != chosen[k]]]
            yield left[rows], away[rows, k].max()
        left = left[~taken]


def cover_tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (centres, covering radii, first child, number of children) of unit vectors; the last has every point as a centre."""
    centres, reach = np.zeros(1, np.int64), np.array([distances(x, x[:1]).max()])
    members = {0: np.arange(len(x))}  # of the nodes that hold several points
    bound, levels = reach[0], []
    while len(members) and len(levels) < 40 and bound >= 1e-7:
        bound /= 2
        count, kids, kid_reach, kid_members, several = np.ones(len(centres), np.int64), {}, {}, {}, sorted(members)
        for k in several:
            nodes = list(covered(x, members[k], bound))
            count[k], kids[k], kid_reach[k] = len(nodes), [m[0] for m, _ in nodes], [r for _, r in nodes]
            kid_members[k] = [m for m, _ in nodes]
        first = np.cumsum(count) - count
        levels.append((centres, reach, first, count))
        next_centres, next_reach, members = np.repeat(centres, count), np.zeros(int(count.sum())), {}
        for k in several:
            next_centres[first[k] : first[k] + count[k]] = kids[k]
            next_reach[first[k] : first[k] + count[k]] = kid_reach[k]
            members |= {first[k] + i: m for i, m in enumerate(kid_members[k]) if len(m) > 1}
        centres, reach = next_centres, next_reach
    if members:
        # What is still together is equal up to rounding: every point becomes a centre.
        size = np.ones(len(centres), np.int64)
        for k, m in members.items():
            size[k] = len(m)
        levels.append((centres, reach, np.cumsum(size) - size, size))
        centres = np.concatenate([members.get(k, centres[k : k + 1]) for k in range(len(centres))])
        reach = np.zeros(len(centres))
    levels.append((centres, reach, np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return levels


def expand(a: np.ndarray, b: np.ndarray, ta, tb) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of each pair of nodes; a tree at its last level stays."""
    (fa, na), (fb, nb) = ((t[2], t[3]) if len(t[2]) else (np.arange(len(t[0])), np.ones(len(t[0]), np.int64)) for t in (ta, tb))
    n = na[a] * nb[b]
    pair = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return fa[a[pair]] + k // nb[b[pair]], fb[b[pair]] + k % nb[b[pair]]


def linked(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of rows with cosine >= least, part by part; each unordered pair once if both are the same rows."""
    if not len(x) or not len(y):
        return
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    ux, uy = x / nx[:, None], y / ny[:, None]
    tx = cover_tree(ux)
    ty = tx if same else cover_tree(uy)
    far = np.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    children = lambda t, a: t[3][a] if len(t[3]) else np.ones(len(a), np.int64)

    def near(la: int, lb: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of children of pairs of nodes that may hold links; la and lb are the children's levels."""
        pa, pb = tx[la if a_last else la - 1], ty[lb if b_last else lb - 1]
        na, nb = children(pa, a), children(pb, b)
        large = na * nb >= PRODUCT
        for i, j, n, m in zip(a[large], b[large], na[large], nb[large], strict=True):
            fa, fb = (pa[2][i] if len(pa[2]) else i), (pb[2][j] if len(pb[2]) else j)
            step = max(1, AT_ONCE // m)
            for k in range(fa, fa + n, step):
                rows, cols = np.arange(k, min(k + step, fa + n)), np.arange(fb, fb + m)
                d = distances(ux[tx[la][0][rows]], uy[ty[lb][0][cols]])
                p, q = np.nonzero(d <= far + tx[la][1][rows][:, None] + ty[lb][1][cols])
                yield rows[p], cols[q]
        a, b = a[~large], b[~large]
        step = AT_ONCE // PRODUCT
        for k in range(0, len(a), step):
            p, q = expand(a[k : k + step], b[k : k + step], pa, pb)
            for h in range(0, len(p), AT_ONCE // 4):
                i, j = p[h : h + AT_ONCE // 4], q[h : h + AT_ONCE // 4]
                d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", ux[tx[la][0][i]], uy[ty[lb][0][j]])))
                keep = d <= far + tx[la][1][i] + ty[lb][1][j]
                yield i[keep], j[keep]

    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, a, b = stack.pop()
        a_last, b_last = la == len(tx) - 1, lb == len(ty) - 1
        la, lb = min(la + 1, len(tx) - 1), min(lb + 1, len(ty) - 1)
        for p, q in near(la, lb, a, b):
            if same:
                keep = p <= q
                p, q = p[keep], q[keep]
            if la == len(tx) - 1 and lb == len(ty) - 1:
                ca, cb = tx[la][0][p], ty[lb][0][q]
                cosine = np.einsum("ij,ij->i", x[ca], y[cb]) / (nx[ca] * ny[cb])
                good = (cosine >= least) & ((ca != cb) if same else True)
                yield ca[good], cb[good]
            elif len(p):
                stack.append((la, lb, p, q))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that it reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def classes_of(vectors: DataFrame) -> DataFrame:
    """label, embedding, class (smallest id), n: distinct usable vectors."""
    size = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    plain = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & plain
    return vectors.where(usable & F.coalesce(size > 0, F.lit(False))).groupBy("label", "embedding").agg(F.min("vec_id").alias("class"), F.count("*").alias("n"))


def near_duplicates(vectors: DataFrame, least: float = 0.93, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vectors (vec_id, embedding, label) to vec_id, n_links, component_id, kept."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    classes = written(classes_of(vectors).withColumn("width", F.size("embedding")))
    # Pivots: the classes of smallest hash in a hash bucket of their own, as many as half blocks fit in the label.
    sizes = classes.groupBy("label", "width").agg(F.count("*").alias("size"))
    wanted = F.greatest(F.lit(1), F.least(F.lit(max_pivots), F.ceil(F.col("size") * 2 / block)))
    bucketed = classes.join(sizes.withColumn("wanted", wanted), ["label", "width"]).withColumn("cell", F.pmod(F.xxhash64("embedding"), F.col("wanted")))
    pivots = bucketed.groupBy("label", "width", "cell").agg(F.min(F.struct(F.xxhash64("embedding", F.lit(1)).alias("h"), F.col("embedding").alias("e"))).alias("p"))
    pivots = pivots.groupBy("label", "width").agg(F.sort_array(F.collect_list(F.struct("cell", F.col("p.e").alias("e")))).alias("pivots"))
    # Shares of a label, of about a block each, meet its pivots.
    shares = sizes.withColumn("shares", F.ceil(F.col("size") / block).cast("int"))
    shared = classes.join(shares, ["label", "width"]).withColumn("share", F.pmod(F.xxhash64("class", "embedding"), F.col("shares")).cast("int"))
    asked = pivots.join(shares, ["label", "width"]).select(F.col("label").alias("l"), F.col("width").alias("w"), "pivots", F.explode(F.expr("sequence(0, shares - 1)")).alias("s"))

    def nearest(d: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x = np.array(d["embedding"].tolist(), float)
        x /= np.sqrt((x * x).sum(1))[:, None]
        p = np.array([q["e"] for q in own["pivots"].iloc[0]], float)
        p /= np.sqrt((p * p).sum(1))[:, None]
        cosine = x @ p.T
        return d[["label", "width", "class", "n", "embedding"]].assign(cell=cosine.argmax(1), away=np.sqrt(np.maximum(0, 2 - 2 * cosine.max(1))))

    dealt = shared.groupBy("label", "width", "share").cogroup(asked.groupBy("l", "w", "s")).applyInPandas(nearest, f"label {dict(classes.dtypes)['label']}, width int, class long, n long, embedding array<double>, cell long, away double")
    dealt = written(dealt)
    cells = dealt.groupBy("label", "width", "cell").agg(F.count("*").alias("size"), F.max("away").alias("reach"))
    centre = pivots.select("label", "width", F.posexplode("pivots").alias("cell", "p")).select("label", "width", F.col("cell").cast("long").alias("cell"), F.col("p.e").alias("centre"))
    cells = cells.join(centre, ["label", "width", "cell"]).withColumn("subs", F.ceil(F.col("size") / block).cast("int"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    dot = F.aggregate(F.zip_with("centre", "centre2", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot / (norm(F.col("centre")) * norm(F.col("centre2")))))
    far = float(np.sqrt(2 - 2 * least)) + SLACK
    other = cells.select("label", "width", *(F.col(c).alias(c + "2") for c in ("cell", "reach", "centre", "subs")))
    met = cells.join(other, ["label", "width"]).where("cell <= cell2").where(apart <= far + F.col("reach") + F.col("reach2"))
    met = met.select("label", "width", "cell", "cell2", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "subs2").select("label", "width", "cell", "cell2", "sub", F.explode(F.expr("sequence(0, subs2 - 1)")).alias("sub2")).where("cell < cell2 OR sub <= sub2")
    met = met.withColumn("pair", F.concat_ws(":", "label", "width", "cell", "sub", "cell2", "sub2"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("cell").alias("cell"), F.col("sub").alias("sub")), F.struct(F.lit(1).alias("side"), F.col("cell2").alias("cell"), F.col("sub2").alias("sub")))
    tasks = met.select("label", "width", "pair", F.explode(F.when((F.col("cell") == F.col("cell2")) & (F.col("sub") == F.col("sub2")), F.slice(sides, 1, 1)).otherwise(sides)).alias("s")).select("label", "width", "pair", "s.*")
    placed = dealt.join(cells.select("label", "width", "cell", "subs"), ["label", "width", "cell"]).withColumn("sub", F.pmod(F.xxhash64("class"), F.col("subs")).cast("int"))
    sent = placed.join(tasks, ["label", "width", "cell", "sub"]).select("pair", "side", "class", "n", "embedding")

    def compare(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["side", "class"])
        left, right = (d[d["side"] == s] for s in (0, 1))
        same = not len(right)
        x = np.array(left["embedding"].tolist(), float)
        y = x if same else np.array(right["embedding"].tolist(), float)
        ids, n = d["class"].to_numpy(), d["n"].to_numpy()
        order = np.argsort(ids, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(d))
        links, root = np.zeros(len(d), np.int64), np.arange(len(d))
        for a, b in linked(x, y, least, same):
            b = b if same else b + len(left)
            links += (np.bincount(a, n[b], len(d)) + np.bincount(b, n[a], len(d))).astype(np.int64)
            root = forest(len(d), np.r_[np.arange(len(d)), rank[a]], np.r_[root, rank[b]])
        found = links > 0
        return pd.DataFrame({"class": ids[found], "links": links[found], "root": ids[order][root][rank][found]})

    found = written(sent.groupBy("pair").applyInPandas(compare, "class long, links long, root long"))
    reached = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    dropped(dealt)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "class", "left").join(reached.withColumnRenamed("node", "class"), "class", "left")
    per_class = per_class.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    out = vectors.where("vec_id IS NOT NULL").join(per_class, ["label", "embedding"], "left").unionByName(vectors.where("vec_id IS NULL"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
