"""Embedding links over hundreds of cells."""

import numpy as np

from lookalike.llm import embedding_dedup
from tests.llm.test_dedup import cosines, grouped


def partners(rng, vectors, cosine):
    """A vector at the given cosine to each."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    other = rng.normal(size=vectors.shape)
    other -= (other * unit).sum(axis=1, keepdims=True) * unit
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return cosine * unit + np.sqrt(1 - cosine**2) * other


def test_no_link_is_missed_between_hundreds_of_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 4)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(600, 16))
    vectors = np.concatenate([vectors, partners(rng, vectors, 0.9001)])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {r["vec_id"]: r for r in found.collect()}
    linked = cosines(vectors) >= 0.9
    np.fill_diagonal(linked, False)
    assert {i: r["n_links"] for i, r in found.items()} == dict(enumerate(linked.sum(axis=1)))
    pairs = list(zip(*(x.tolist() for x in np.nonzero(linked))))
    assert {i: r["component_id"] for i, r in found.items()} == grouped(range(len(rows)), pairs)


def test_visits_follow_from_the_bound():
    rng = np.random.default_rng(9)
    points = embedding_dedup.units(rng.normal(size=(400, 6)))
    centroids = embedding_dedup.fit_centroids(points, 60)
    near = points @ centroids.T
    home = near.argmax(axis=1)
    angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
    radii = np.array([angle[home == c].max(initial=-1.0) for c in range(len(centroids))])
    for threshold in (0.5, 0.9, 0.99):
        fits = embedding_dedup.visited(points, home, centroids, radii, threshold)
        a, b = np.nonzero(cosines(points) >= threshold)
        later = home[a] > home[b]
        assert fits[a[later], home[b[later]]].all()
    assert fits.mean() < 0.1
