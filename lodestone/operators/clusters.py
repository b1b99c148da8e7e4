"""Density clusters of embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MOST_VECTORS, MIN_SIZE = 1500, 3
LEAST_SURFACE, LEAST_CLUSTERS = 15, 4


def density_labels(vectors: np.ndarray, min_size: int = MIN_SIZE, counts: np.ndarray | None = None) -> np.ndarray:
    """Labels from 0, noise -1: the spanning tree of unit vectors is cut from its longest edge down, and
    of the groups of ``min_size`` or more those of most excess of mass stay. counts: how many copies a vector stands for."""
    n = len(vectors)
    counts = np.ones(n, int) if counts is None else counts
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    # Prim's tree on distances that are worked out row by row.
    best, origin, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.sqrt(np.maximum(2 - 2 * unit @ unit[at], 0))
        closer = ~inside & (d < best)
        best[closer], origin[closer] = d[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], origin[at], at))
    edges.sort(key=lambda e: e[0])
    # Single linkage, kept as a binary tree of merges.
    parent, node_of = list(range(n)), list(range(n))
    size, left, right, height = counts.tolist(), [-1] * n, [-1] * n, [0.0] * n

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for d, a, b in edges:
        ra, rb = root(a), root(b)
        na, nb = node_of[ra], node_of[rb]
        parent[rb] = ra
        node_of[ra] = len(size)
        size.append(size[na] + size[nb])
        left.append(na)
        right.append(nb)
        height.append(float(d))

    labels = np.full(n, -1)
    if counts.sum() < min_size:
        return labels

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if left[y] < 0:
                out.append(y)
            else:
                todo += [left[y], right[y]]
        return out

    # Walk down from the top: a split into two large halves begins two clusters, smaller parts fall off.
    lam = lambda d: 1 / max(d, 1e-9)
    found, todo = [], [(len(size) - 1, 0.0, -1)]  # (top, birth, parent cluster)
    while todo:
        top, birth, above = todo.pop()
        mine, mass, x = len(found), 0.0, top
        found.append([top, above, 0.0])
        while left[x] >= 0:
            a, b, level = left[x], right[x], lam(height[x])
            if size[a] >= min_size and size[b] >= min_size:
                mass += size[x] * (level - birth)
                todo += [(a, level, mine), (b, level, mine)]
                break
            big, small = (a, b) if size[a] >= size[b] else (b, a)
            if size[big] < min_size:
                mass += size[x] * (level - birth)
                break
            mass += size[small] * (level - birth)
            x = big
        if left[x] < 0 and size[x] > 1:  # copies: a tree whose edges are all 0 long
            mass += size[x] * (lam(0.0) - birth)
        found[mine][2] = mass
    children: dict[int, list[int]] = {}
    for k, (_, above, _) in enumerate(found):
        children.setdefault(above, []).append(k)
    value, chosen = {}, set()
    for k in reversed(range(len(found))):
        below = sum(value[c] for c in children.get(k, []))
        if found[k][1] >= 0 and (not children.get(k) or found[k][2] >= below):
            value[k] = found[k][2]
            chosen.add(k)
        else:
            value[k] = below
    label = 0
    todo_ = [c for c in children.get(-1, [])]
    while todo_:
        k = todo_.pop(0)
        if k in chosen:
            labels[leaves(found[k][0])] = label
            label += 1
        else:
            todo_ += children.get(k, [])
    return labels


def clustered(vectors: DataFrame, tenant: str, id: str, vector: str, importance: str | None = None, whole: bool = False) -> DataFrame:
    """(tenant, id, cluster) of every vector; noise is -1.

    Only the MOST_VECTORS most important of a tenant are clustered, as its product does; the others
    have a null cluster. Without importance the smallest ids count as most important. With ``whole`` all vectors are clustered. Vectors that point
    the same way are one, with their number, so a tenant's task holds the distinct directions and takes time with their square.
    """
    order = ([F.desc(importance)] if importance else []) + [F.col(id)]
    kept = vectors if whole else vectors.withColumn("_n", F.row_number().over(W.partitionBy(tenant).orderBy(*order))).where(F.col("_n") <= MOST_VECTORS)
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    points = kept.select(tenant, id, F.transform(v, lambda x: x / F.when(length == 0, 1.0).otherwise(length)).alias("_way"))
    ways = points.groupBy(tenant, "_way").agg(F.min(id).alias("_first"), F.count("*").alias("_copies"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_first")
        found = density_labels(np.stack(pdf["_way"].to_list()).astype(float), counts=pdf["_copies"].to_numpy())
        return pd.DataFrame({tenant: pdf[tenant], "_way": pdf["_way"], "cluster": found.astype("int64")})

    kind = dict(vectors.dtypes)
    labels = ways.groupBy(tenant).applyInPandas(label, f"{tenant} {kind[tenant]}, _way array<double>, cluster long")
    labels = points.join(labels, [tenant, "_way"]).select(tenant, id, "cluster")
    return labels if whole else vectors.select(tenant, id).join(labels, [tenant, id], "left")


def worth_showing(labels: DataFrame, tenants: DataFrame, tenant: str) -> DataFrame:
    """Labels of tenants(tenant, public_surface, generated) with a public surface of LEAST_SURFACE or generated code, and
    with LEAST_CLUSTERS clusters or more."""
    n = labels.where("cluster >= 0").groupBy(tenant).agg(F.count_distinct("cluster").alias("_n")).where(F.col("_n") >= LEAST_CLUSTERS)
    open_ = tenants.where((F.col("public_surface") >= LEAST_SURFACE) | F.col("generated"))
    return labels.join(n.select(tenant), tenant, "left_semi").join(open_.select(tenant), tenant, "left_semi")
