"""Apportionment, the mix, and the pipeline."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lookalike.llm import language_id, mixture, simhash_dedup


def highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * won[j] + 1), -j))
        won[i] += 1
    return won


def test_seats_go_to_the_highest_quotients(spark):
    rng = random.Random(5)
    for _ in range(25):
        votes = [rng.choice([0, 1, 7, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 12))]
        divisor = rng.choice([1, 3, 20, 999])
        rows = spark.createDataFrame(list(enumerate(votes)), "i int, votes long").coalesce(1)
        won = [r["q"] for r in rows.select("i", mixture.quota(F.col("votes"), divisor).alias("q")).orderBy("i").collect()]
        expected = highest_quotients(votes, sum(won))
        # Ties may go either way; the quotients that won must be the same.
        quotients = lambda w: sorted(v / (2 * k + 1) for v, n in zip(votes, w) for k in range(n))
        assert quotients(won) == pytest.approx(quotients(expected))


def plain_targets(own, weights=(1, 2, 3), most=3):
    """Shares one full source at a time; ``own`` in the order of the sources."""
    target, full = [0.0] * len(own), set()
    while True:
        open_ = [i for i, n in enumerate(own) if n and i not in full]
        left = sum(own) - sum(most * own[i] for i in full)
        for i in open_:
            target[i] = left * weights[i % 3] / sum(weights[j % 3] for j in open_)
        above = [i for i in open_ if target[i] >= most * own[i]]
        if not above:
            return target
        for i in above:
            full.add(i)
            target[i] = most * own[i]


def targets(spark, own):
    rows = spark.createDataFrame([(f"s{i:04}", n, i) for i, n in enumerate(own)], "source string, words long, rank long")
    return [r["target"] for r in mixture.with_targets(rows).orderBy("rank").collect()]


def test_targets_stop_at_three_times_the_size(spark):
    assert targets(spark, [1_000, 10, 10, 0]) == pytest.approx([960, 30, 30, 0])
    assert targets(spark, []) == []
    assert targets(spark, [100, 100, 100]) == pytest.approx([50, 100, 150])
    rng = random.Random(8)
    for _ in range(4):
        own = [rng.choice([0, rng.randint(1, 9), rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 40))]
        assert targets(spark, own) == pytest.approx(plain_targets(own))


def test_sources_are_ranked_by_code_point(spark):
    names = ["b", "a", "", "Z", "é", "\uffee", "\U0001f600", None, "aa"]
    rows = spark.createDataFrame([(n, 1) for n in names], "source string, words long").repartition(5)
    found = [r["source"] for r in mixture.ranked_sources(rows).orderBy("rank").collect()]
    assert found == [*sorted(n for n in names if n is not None), None]


def test_small_sources_get_their_words(documents):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", f"small{i:03}") for i in range(300)]
    rows += [(1000 + i, " ".join(["w"] * 500), "en", "zlarge") for i in range(300)]
    found = {r["doc_id"]: r for r in mixture.mix(documents(rows)).collect()}
    assert all(abs(found[i]["taken"] - found[i]["target"]) <= 1 for i in range(300))
    assert all(found[i]["target"] > 0 for i in range(300))
    large = [found[1000 + i] for i in range(300)]
    assert abs(sum(r["taken"] for r in large) - large[0]["target"]) <= 2


def mixed_rows(n=600, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        source = rng.choice(["b", "b", "b", "b", "a", "é", "Z", None])
        yield i, " ".join(["word"] * int(rng.expovariate(1 / 150))) + "\x0b\ttail", "en", source


@pytest.mark.parametrize("shard_rows", [40, 20_000])
def test_mix_meets_its_targets(documents, shard_rows):
    rows = list(mixed_rows())
    found = {r["doc_id"]: r for r in mixture.mix(documents(rows), 50, shard_rows).collect()}
    assert {r["doc_id"]: r for r in mixture.mix(documents(rows), 50, shard_rows).collect()} == found
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _, _ in rows}
    by_source = defaultdict(list)
    for i, _, _, source in rows:
        by_source[source].append(i)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    targets = plain_targets([sum(sizes[i] for i in by_source[s]) for s in order])
    for source, target in zip(order, targets):
        own = [found[i] for i in by_source[source]]
        total = sum(sizes[i] for i in by_source[source])
        assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert all((r["source_size"], r["target"]) == (total, pytest.approx(target)) for r in own)
        shards = -(-len(own) // shard_rows)
        assert abs(sum(r["taken"] for r in own) - target) <= 0.02 * target + 50 * shards


def test_mix_of_awkward_rows(awkward, nothing):
    found = mixture.mix(awkward).collect()
    assert len(found) == awkward.count()
    assert all(r["taken"] == 0 for r in found if r["size"] == 0)
    assert mixture.mix(nothing).count() == 0
    kept = mixture.mixed_documents(awkward)
    assert kept.columns == awkward.columns and kept.count() > 0
    assert mixture.mixed_documents(nothing).count() == 0


def test_mixed_documents_repeat_whole_documents(documents):
    df = documents(list(mixed_rows()))
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixture.mix(df).collect() if r["size"]}
    times = {r["doc_id"]: r["count"] for r in mixture.mixed_documents(df).groupBy("doc_id").count().collect()}
    for i, share in taken.items():
        assert int(share) <= times.get(i, 0) <= min(3, int(share) + 1)
    assert sum(times.values()) == pytest.approx(sum(taken.values()), rel=0.1)


# --- pipeline -------------------------------------------------------------------------


@pytest.fixture
def tables(spark, documents, tmp_path):
    rng = random.Random(7)
    words = [f"wort{i}" for i in range(400)]
    item = " ".join(rng.choices(words, k=30))
    rows = [(i, " ".join(rng.choices(words, k=80)), "de", rng.choice("abc")) for i in range(120)]
    rows += [(200 + i, rows[i][1], "de", "a") for i in range(10)]
    rows += [(300, "start " + item + " end", "de", "b"), (301, None, "de", "b"), (302, "12 34", "de", None)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids, kept = docs.columns, [], docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, tables)
        ids.append({r["doc_id"] for r in kept.select("doc_id").collect()})
        if name != "tokens":
            assert kept.columns == columns and kept.dtypes == docs.dtypes
    language, near, clean, mixed, tokens = ids
    assert language == {r["doc_id"] for r in docs.collect()} - {301, 302}
    assert near == language - set(range(200, 210))
    assert clean == near - {300}
    assert mixed <= clean and len(mixed) > 0.4 * len(clean) and tokens == mixed


def test_run_writes_and_rereads_every_stage(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert corpus_pipeline.ORACLE_SQL is None and language_id.UNKNOWN == "und"


def test_stages_of_awkward_rows(spark, awkward, nothing, tables):
    expected = {
        "language": [None, 4, 4, 5, 6],
        "near_duplicates": [4, 5],
        "decontamination": [4, 5],
        "mixing": None,
        "tokens": None,
    }
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        ids = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=lambda i: (i is not None, i))
        if expected[name] is not None:
            assert ids == expected[name], name
        assert set(ids) <= {4, 5}  or name == "language"
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


def test_near_duplicates_equal_brute_force(spark, documents):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(50)]
    texts += [t + " " + rng.choice(words) for t in texts for _ in range(2)] + texts[:5] + ["", " ", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[i], "en", "s") for i in order] + [(None, texts[0], "en", "s"), (0, texts[0], "fr", "t")]
    prints = {i: simhash_dedup.fingerprint((t or "").encode()) for i, t in enumerate(texts)}
    group = {i: i for i in prints}
    for _ in texts:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = min(group[a], group[b])
    kept = corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(group.values()))
