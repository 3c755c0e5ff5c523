"""The mix of rows that ids do not tell apart."""

import random

from lookalike.llm import mixture


def test_rows_without_ids_are_taken_one_by_one(documents):
    rng = random.Random(6)
    rows = [
        (rng.choice([None, None, 7]), " ".join([f"w{i % 40}"] * rng.randint(50, 150)), "en", s)
        for i, s in enumerate(["a"] * 900 + ["b"] * 300)
    ]
    df = documents(rows)
    kept = {r["source"]: r["words"] for r in mixture.mixed_documents(df).groupBy("source").agg(
        {"text": "count"}
    ).withColumnRenamed("count(text)", "words").collect()}
    taken, size = {}, {}
    for r in mixture.mix(df).collect():
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        size[r["source_size"]] = r["target"]
    for source, n in (("a", 900), ("b", 300)):
        own = sum(len(t.split()) for _, t, _, s in rows if s == source)
        assert abs(taken[own] - size[own]) <= 0.03 * size[own] + 40
        assert abs(kept[source] / n - size[own] / own) <= 0.15 * size[own] / own
