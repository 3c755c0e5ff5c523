"""SimHash, exact substrings and embeddings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from lookalike.llm import embedding_dedup, simhash_dedup, suffix_dedup
from lookalike.llm.common import components


def grouped(nodes, linked):
    """Smallest member of each node's component."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    found = components(spark.createDataFrame(chain + hub + [(5, 5)], "a long, b long"), "t").collect()
    roots = {r["node"]: r["root"] for r in found}
    assert roots == grouped(roots, chain + hub)
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def plain_fingerprint(text):
    words = [w for w in text.lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_links_all_pairs_within_two_bits(spark, documents):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    texts += [t + " " + rng.choice(words) for t in texts for _ in range(2)]
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in simhash_dedup.simhash_components(documents(rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t, _, _ in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == prints
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in found.items()} == grouped(prints, links)


def test_links_in_posting_join_exactly_the_groups():
    rng = np.random.default_rng(3)
    for bits in (3, 6, 16):
        members = np.unique(rng.integers(0, 1 << bits, 40).astype(np.uint64) << np.uint64(24))
        a, b = simhash_dedup.links_in_posting(members)
        links = [(int(x), int(y)) for x in members for y in members if x < y and int(x ^ y).bit_count() <= 2]
        nodes = [int(m) for m in members]
        assert grouped(nodes, list(zip(a.tolist(), b.tolist()))) == grouped(nodes, links)


def test_simhash_of_awkward_rows(awkward, nothing):
    found = simhash_dedup.simhash_components(awkward).collect()
    assert len(found) == awkward.count()
    blank = {r["doc_id"]: r for r in found if r["fingerprint"] == "0" * 16}
    assert {1, 2, 3} <= set(blank) and {r["component_id"] for r in blank.values()} == {1}
    assert {r["component_id"] for r in found if r["doc_id"] in (4, None)} == {4}
    assert simhash_dedup.simhash_components(nothing).count() == 0
    kept = simhash_dedup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["component_id"] for r in found})
    assert simhash_dedup.drop_near_duplicates(nothing).count() == 0


def removed(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        mask = np.zeros(len(t) + 2, int)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                mask[p + 1 : p + 1 + length] = 1
        kept = bytes(np.frombuffer(t, np.uint8)[mask[1:-1] == 0])
        yield len(t), int(mask.sum()), int((np.diff(mask) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length", [40, 64, 200])
def test_repeated_strings_are_removed_to_the_byte(documents, length, monkeypatch):
    rng = random.Random(length)
    passages = ["".join(rng.choices("abcd é", k=rng.randint(length - 3, 3 * length))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append("".join(rng.choices("abcdef ", k=rng.randint(0, length))))
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts.append(p[cut : cut + rng.randint(length - 2, len(p))])
        texts.append("".join(parts))
    texts += ["a" * 500, "ab" * 300, "x" * (length - 1), "", texts[0], "q" * length]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    found = suffix_dedup.without_repeats(documents(rows), length).orderBy("doc_id").collect()
    expected = list(removed([t.encode() for t in texts], length))
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found] == expected


def test_long_texts_are_scanned_in_pieces(documents, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh", k=9_000))
    data = np.frombuffer((text + text[2_000:5_000]).encode(), np.uint8)
    whole = suffix_dedup.owned_runs(data, np.array([0, len(data)]), 200)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1_000)
    covered = []
    for piece, bounds, shift in suffix_dedup._pieces(data, np.array([0, len(data)]), 200):
        _, start, windows, at, owner, _ = suffix_dedup.owned_runs(piece, bounds, 200)
        covered += [(int(s + k) + shift, int(o)) for s, n, o in zip(start, windows, owner) for k in range(n)]
    _, start, windows, _, owner, _ = whole
    assert covered == [(int(s + k), int(o)) for s, n, o in zip(start, windows, owner) for k in range(n)]


def test_substrings_of_awkward_rows(awkward, nothing):
    found = suffix_dedup.without_repeats(awkward).collect()
    assert len(found) == awkward.count()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[4]["n_removed"] == 0 and by[5]["n_removed"] > 0.9 * by[5]["n_bytes"]
    assert suffix_dedup.without_repeats(nothing).count() == 0


def cosines(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ unit.T


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    vectors = np.concatenate([c + rng.normal(size=(40, 16)) * s for c, s in zip(centers, np.linspace(0.05, 0.6, 12))])
    vectors[7] = vectors[3] = vectors[11]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = found.orderBy("vec_id").collect()
    linked = cosines(vectors) >= 0.9
    np.fill_diagonal(linked, False)
    links = np.array([r["n_links"] for r in found])
    assert (links <= linked.sum(axis=1)).all()
    assert links.sum() >= 0.9 * linked.sum()
    if links.sum() == linked.sum():
        pairs = list(zip(*(x.tolist() for x in np.nonzero(linked))))
        assert {r["vec_id"]: r["component_id"] for r in found} == grouped(range(len(rows)), pairs)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_embeddings_that_link_with_nothing(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]),
    ]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame([(*r, 0) for r in rows], schema).selectExpr("*", "'x' as links", "'y' as vector")
    found = embedding_dedup.near_vectors(df).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    for i in (1, 2, 3, 4, 5, 6, 9):
        assert by[i] == [(0, i, True)]
    assert by[7] == [(3, 7, True)] * 2 and by[8] == [(3, 7, False)] and by[None] == [(3, 7, False)]
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
