"""Near duplicates of embedding vectors: spherical k-means cells and blocked cosines.

Identical vectors are one vector with a count. Centroids are fitted on a bounded
sample (``SAMPLE`` vectors); every vector then goes to its nearest cell as a
member and, as a visitor, to every earlier cell that can hold a vector within the
threshold's angle. Such a cell's vectors lie beyond the plane between the two
centroids and within the cell's radius, so a vector visits unless its angle to
that plane is larger than the threshold's, or its angle to the centroid larger
than both together. A pair is compared once, in the earlier of its two cells, and
no link is missed. Where vectors spread evenly in many dimensions the bounds
exclude little, and the comparisons grow with the square of the vectors. Cells
are cut into blocks of ``BLOCK_ROWS``, so a task holds two blocks and one matrix
of cosines; pairs are counted there and never written. A block reports, for each
vector, how many vectors it links and the smallest one of its local group, so
links grow with the rows.

Cosines are in double precision: ``a . b / (|a| |b|)``, linked from the threshold
on. Vectors of different lengths are not compared.

Defined results: vectors that are null, empty or zero, or that hold nulls or
non-finite components, link with nothing and have no link and their own id as
component; repeated rows link with each other; a row with a null ``vec_id`` links
like any other but never names a component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lookalike.llm.common import components
from lookalike.sources.scratch import written

THRESHOLD = 0.9
#: Vectors to fit the centroids on, about; the documented bound.
SAMPLE = 20_000
#: Vectors of a cell, about, until there are MAX_CELLS cells.
CELL_ROWS = 2_000
MAX_CELLS = 2_048
#: Angles that rounding may add, in radians.
SLACK = 1e-6
BLOCK_ROWS = 1_000
ROUNDS = 12
#: Keys of vectors without an id start here.
NAMELESS = 1 << 62


def usable(vector: Column) -> Column:
    """Finite, not empty and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that the squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: centroids are the directions of their members' sums.

    Starts from evenly spaced rows of the sample; an empty cell keeps its place.
    """
    points = units(sample)
    cells = max(1, min(cells, len(points)))
    centroids = points[np.linspace(0, len(points) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(p @ centroids.T, axis=1) for p in np.array_split(points, -(-len(points) // 4096))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, points)
        size = np.linalg.norm(sums, axis=1)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), float)


def assign(vectors: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the nearest cell, ``home``, and the ``angle`` to its centroid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                near = units(_matrix(part["vector"])) @ centroids[dim].T
                home = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(part)), home], -1, 1))
                yield part.assign(home=home.astype(np.int32), angle=angle)

    return vectors.mapInPandas(run, "vec long, copies long, vector array<double>, dim int, home int, angle double")


def visited(
    points: np.ndarray, home: np.ndarray, centroids: np.ndarray, radii: np.ndarray, threshold: float
) -> np.ndarray:
    """``(points, cells)``: cells before a unit vector's own that can hold a vector it links.

    A cell without members has a negative radius and is not visited.
    """
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    near = points @ centroids.T
    angle = np.arccos(np.clip(near, -1, 1))
    apart = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0))[home]
    beyond = near[np.arange(len(points)), home][:, None] - near
    # Beyond the plane's normal nothing is farther than a right angle from the plane.
    plane = np.sin(min(reach, math.pi / 2)) * apart + SLACK
    fits = (beyond <= plane) & (angle <= reach + radii[None, :] + SLACK) & (radii >= 0)[None, :]
    return fits & (np.arange(len(centroids))[None, :] < home[:, None])


def spread_out(
    assigned: DataFrame, centroids: dict[int, np.ndarray], radii: dict[int, np.ndarray], threshold: float
) -> DataFrame:
    """``assigned`` with ``cells``: a vector's own cell and those it visits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, whole in frame.groupby("dim"):
                for lo in range(0, len(whole), BLOCK_ROWS):
                    part = whole.iloc[lo : lo + BLOCK_ROWS]
                    home = part["home"].to_numpy()
                    fits = visited(units(_matrix(part["vector"])), home, centroids[dim], radii[dim], threshold)
                    cells = [[int(h), *np.flatnonzero(row).tolist()] for h, row in zip(home, fits)]
                    yield part.drop(columns=["home", "angle"]).assign(cells=cells)

    return assigned.mapInPandas(run, "vec long, copies long, vector array<double>, dim int, cells array<int>")


def compare_blocks(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """``(vec, links, low)`` of the rows that link in one pair of blocks.

    ``right`` None compares a block with itself.
    """
    a = _matrix(left["vector"])
    b = a if right is None else _matrix(right["vector"])
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    linked = a @ b.T / norms >= threshold
    other = left if right is None else right
    if right is None:
        np.fill_diagonal(linked, False)
    rows, columns = linked.any(axis=1), linked.any(axis=0)
    linked = linked[np.ix_(rows, columns)]
    left, other = left[rows], other[columns]
    ids_a, ids_b = left["vec"].to_numpy(np.int64), other["vec"].to_numpy(np.int64)
    links_a = linked @ other["copies"].to_numpy(np.int64)
    links_b = left["copies"].to_numpy(np.int64) @ linked
    low_a, low_b = ids_a, ids_b
    top = np.iinfo(np.int64).max
    while len(ids_a):
        new_a = np.minimum(low_a, np.where(linked, low_b[None, :], top).min(axis=1))
        new_b = np.minimum(low_b, np.where(linked, new_a[:, None], top).min(axis=0))
        if np.array_equal(new_a, low_a) and np.array_equal(new_b, low_b):
            break
        low_a, low_b = new_a, new_b
    found = pd.DataFrame({"vec": ids_a, "links": links_a, "low": low_a})
    if right is None:
        return found
    return pd.concat([found, pd.DataFrame({"vec": ids_b, "links": links_b, "low": low_b})])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors (vec_id, embedding)``."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = rows.withColumn("embedding", F.when(usable(F.col("embedding")), F.col("embedding")))
    distinct = rows.where("embedding is not null").groupBy("embedding").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("named")
    )
    # A group without any id has a key beyond all ids, so that it names no component.
    key = F.coalesce("named", F.lit(NAMELESS) + F.pmod(F.xxhash64("embedding"), F.lit(NAMELESS)))
    distinct = written(
        distinct.select(key.alias("vec"), "copies", F.col("embedding").alias("vector"), F.size("embedding").alias("dim")),
        "embedding-distinct",
    )
    n = distinct.count()
    if not n:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    place = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) / float(1 << 30)
    sample = distinct.where((place < SAMPLE / n) | F.lit(n <= SAMPLE)).select("dim", "vector").toPandas()
    cells = min(MAX_CELLS, math.ceil(n / CELL_ROWS))
    dims = [r["dim"] for r in distinct.select("dim").distinct().collect()]
    centroids = {
        d: fit_centroids(_matrix(part["vector"]), cells) if len(part := sample[sample["dim"] == d]) else np.eye(1, d)
        for d in dims
    }

    assigned = written(assign(distinct, centroids), "embedding-cells")
    radii = {d: np.full(len(c), -1.0) for d, c in centroids.items()}
    for r in assigned.groupBy("dim", "home").agg(F.max("angle").alias("radius")).collect():
        radii[r["dim"]][r["home"]] = r["radius"]
    spread = spread_out(assigned, centroids, radii, threshold).select("*", F.posexplode("cells").alias("nth", "cell"))
    spread = spread.withColumn("member", F.col("nth") == 0).drop("nth", "cells")
    sizes = spread.groupBy("dim", "cell").agg(
        F.ceil(F.count_if("member") / BLOCK_ROWS).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("member")) / BLOCK_ROWS)).cast("int").alias("guests"),
    )
    dealt = spread.join(sizes, ["dim", "cell"]).where("blocks > 0")
    spot = F.xxhash64(F.lit("block"), "vec")
    dealt = dealt.withColumn(
        "block",
        F.when(F.col("member"), F.pmod(spot, "blocks")).otherwise(F.col("blocks") + F.pmod(spot, "guests")).cast("int"),
    )
    # A member block meets itself and all later blocks; a guest block meets all member blocks.
    own, last = F.col("block"), F.col("blocks") - 1
    met = F.sequence(F.lit(0), F.when(F.col("member"), last + F.col("guests")).otherwise(last))
    pair = F.transform(met, lambda other: F.struct(F.greatest(other, own).alias("i"), F.least(other, own).alias("j")))
    tasks = dealt.select("dim", "cell", "block", "vec", "copies", "vector", F.inline(pair))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key[2:]
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"vec": [], "links": [], "low": []}).astype("int64")
        return compare_blocks(left, None if i == j else right, threshold)

    found = tasks.groupBy("dim", "cell", "i", "j").applyInPandas(compare, "vec long, links long, low long")
    found = written(found, "embedding-links")
    roots = components(found.where("vec != low").select(F.col("vec").alias("a"), F.col("low").alias("b")), "embedding-components")
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    named = distinct.join(links, "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
    named = named.select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "vec").alias("root")
    )
    joined = rows.join(named, rows.embedding == named.vector, "left")
    component = F.coalesce(F.when(F.col("root") < NAMELESS, F.col("root")), "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
