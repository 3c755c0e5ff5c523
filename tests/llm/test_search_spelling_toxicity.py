"""Ranked search, spelling variants and toxicity against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lookalike.llm import lexical_search, spelling, toxicity


# --- ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain_search(docs, items, best=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    N, L = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 25 + 75 * sum(c.values()) * N // L
            total = 0
            for t in plain_terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                    total += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if total > 0:
                scored.append((-total, doc_id is None, doc_id or 0))
        for rank, (s, none, doc_id) in enumerate(sorted(scored)[:best], 1):
            out.append((item_id, rank, None if none else doc_id, -s))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_items", [2, 1000])
def test_search_equals_scoring_every_document(spark, documents, block_items):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Émile", "x-y", "a_b", "漢字"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(900 + i, "w3 w9 same text") for i in range(40)] + [(5, "W3 w9"), (None, "w3 w9 same text"), (1000, None)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for i in range(7)]
    items += [(50, "w3 w9 W9"), (51, None), (52, "..."), (53, "unknown"), (50, "same")]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int")
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = lexical_search.search(table.repartition(3), queries, block_items=block_items).collect()
    assert sorted(map(tuple, found), key=str) == plain_search(docs, items)


def test_search_of_awkward_and_empty_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one seven seven"), (None, "word1")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = sorted(map(tuple, lexical_search.search(awkward, items).collect()), key=str)
    assert found == plain_search(rows, [(1, "one seven seven"), (None, "word1")])
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(awkward, items.limit(0)).count() == 0


def test_masks_leave_low_maxima_unscored():
    counts = np.zeros((5_000, 3), np.int64)
    counts[:, 0] = 1
    counts[:20, 1:] = 1
    factor, ids = np.full(5_000, 100), np.arange(5_000)
    best = lexical_search._Best(10, 0)
    scored = lexical_search.search_masks(best, counts, factor, ids, np.array([1, 900, 900]), np.full(3, 10**9 // 1800))
    assert scored == 20 and best.doc_id.tolist() == list(range(10))


def test_length_factor_beyond_64_bits():
    corpus = lexical_search.Corpus(10**12, 10**14)
    assert corpus.length_factor(np.array([5, 10**9])).tolist() == [25 + 75 * 5 // 100, 25 + 75 * 10**7]


# --- spelling variants --------------------------------------------------------------------


def plain_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    near = defaultdict(set)
    letters = sorted({c for w in words for c in w})
    for w in words:
        for i in range(len(w) + 1):
            for v in [w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + k :] for c in letters for k in (0, 1)]:
                if v != w and v in words:
                    near[w].add(v)
                    near[v].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v))
        if words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("subtree_words", [5, 60, 10_000])
def test_variants_equal_all_edits(spark, subtree_words):
    rng = random.Random(5)
    base = ["".join(rng.choices("aabcdeéø", k=rng.randint(5, 8))) for _ in range(120)]
    base += ["a" * 70, "a" * 71, "a" * 40 + "b" + "a" * 30, "aaaaa", "aaaaaa"]
    # Many words of one vector, more than a subtree should hold.
    base += ["".join(rng.sample("abcde", 5)) for _ in range(60)]
    docs = []
    for i in range(150):
        words = [w.upper() if rng.random() < 0.2 else w for w in rng.choices(base, k=40)]
        docs.append((i, " ".join(w.replace("É", "é").replace("Ø", "ø") for w in words)))
    docs += [(None, "aaaaa aaaab aaaab aaaab"), (3, None), (4, ""), (7, docs[7][1]), (9, "straße " * 5 + "STRAßEN " * 3)]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string")
    found = spelling.spelling_variants(table.repartition(2), subtree_words).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == plain_variants(plain_words(docs))


def test_variants_of_awkward_and_empty_tables(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    found = spelling.spelling_variants(awkward).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == plain_variants(plain_words(rows))
    assert spelling.spelling_variants(nothing).count() == 0


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(60)]
    forms = spark.createDataFrame(chain, "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w60"}


@given(st.lists(st.text("abz", min_size=5, max_size=7), min_size=2, max_size=30, unique=True))
@settings(max_examples=60, deadline=None)
def test_one_subtree_finds_every_pair_once(words):
    group = np.arange(spelling.LETTERS) % spelling.GROUPS
    array = pa.array(words, pa.string())
    tree = spelling.Subtree(array, np.ones(len(words), np.int64), group)
    i, j = tree.near(array)
    found = sorted(tuple(sorted((words[a], tree.words[int(b)].as_py()))) for a, b in zip(i, j))
    wanted = {tuple(sorted((a, b))) for a in words for b in words if len(a) <= len(b) and spelling.plain_one_edit(a, b)}
    assert found == sorted(wanted)


# --- toxicity -----------------------------------------------------------------------------


def toxic_table(spark, documents, n=600):
    rng = random.Random(11)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "ru", "ne") for b in ("ra", "so", "ti", "ka")]
    rows, labels = [], []
    for i in range(n):
        parts = [" ".join(rng.choices(plain, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            at = rng.randrange(len(parts))
            parts[at] += " " + rng.choice(["vilewort", "Schimpf", "ärgernis"])
        rows.append((i, ". ".join(parts), "en", "a"))
        labels.append((i, toxic))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_sentences_are_found_from_document_labels(spark, documents):
    docs, labels = toxic_table(spark, documents)
    model = toxicity.learn(docs.where(~toxicity.held_out()), labels)
    rows = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).join(docs, "doc_id").join(labels, "doc_id")
    held = [r for r in rows.collect() if r.held_out]
    assert sum(r.toxic for r in held) > 10
    assert all(r.predicted == r.toxic == int(r.score >= 0.3) for r in held)
    for r in held:
        assert 0 <= r.score <= 1 and bool(r.offending) == bool(r.toxic)
        for span in r.offending:
            assert re.search("vilewort|Schimpf|ärgernis", r.text[span.start : span.end])


def test_gradient_is_the_slope_of_the_likelihood(spark):
    rows = [(1, 1.0, [2, 0, 1], [0, 1, 2]), (0, 2.0, [1, 1], [1, 2]), (1, 1.0, [], [])]
    table = spark.createDataFrame(rows, "toxic int, weight double, sizes array<int>, ids array<int>").coalesce(1)
    weights, bias = np.array([0.3, -0.2, 0.5]), -1.0

    def likelihood(w, b):
        total = 0.0
        for toxic, weight, sizes, ids in rows[:2]:
            ends = np.cumsum([0, *sizes])
            p = [1 / (1 + math.exp(-(b + sum(w[i] for i in ids[x:y])))) for x, y in zip(ends, ends[1:])]
            whole = 1 - math.prod(1 - x for x in p)
            total += weight * math.log(whole if toxic else 1 - whole)
        return total

    by_word, by_bias = toxicity._gradient(table, weights, bias)
    step = 1e-6
    for i in range(3):
        e = np.eye(3)[i] * step
        assert by_word[i] == pytest.approx((likelihood(weights + e, bias) - likelihood(weights - e, bias)) / 2 / step, abs=1e-5)
    assert by_bias == pytest.approx((likelihood(weights, bias + step) - likelihood(weights, bias - step)) / 2 / step, abs=1e-5)


def test_toxicity_of_awkward_tables(spark, documents, awkward, nothing):
    docs, labels = toxic_table(spark, documents, 200)
    extra = spark.createDataFrame([(0, None), (None, 1), (99_999, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.union(extra), steps=5)
    found = toxicity.score(awkward, model).collect()
    assert len(found) == awkward.count()
    assert all(r.score == 0 and r.predicted == 0 and not r.offending for r in found if r.doc_id in (1, 2, 3))
    assert len({(r.score, r.predicted) for r in found if r.doc_id == 4}) == 1
    assert toxicity.score(nothing, model).count() == 0
    empty = labels.limit(0)
    assert toxicity.learn(docs, empty).always == 0 and toxicity.learn(nothing, labels).always == 0
    ones = labels.selectExpr("doc_id", "1 as toxic")
    scored = toxicity.score(awkward, toxicity.learn(docs, ones)).collect()
    assert all(r.score == (0 if r.sentences == 0 else 1) for r in scored)


def test_sentences_are_cut_and_placed():
    found = list(toxicity.sentences("Ä b! c\n" + "x " * 100 + "... 12"))
    assert [len(s.words) for s in found] == [2, 1, 64, 36]
    assert (found[0].start, found[0].end, found[0].words) == (0, 3, ["ä", "b"])
