"""Language, licenses, benchmark passages, language model and token counts."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lookalike.llm import decontaminate, edit_counts, language_id, license_scan, maxent_lm, range_coder, token_files
from lookalike.llm.words import normalized, shingles_of

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


# --- language -------------------------------------------------------------------------

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then they went there with this thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann gingen sie auch nicht",
    "fr": "le renard brun saute par dessus le chien paresseux et puis ils sont allés là où être",
}


def language_rows(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(sorted(SAMPLES))
        yield i, " ".join(rng.choices(SAMPLES[lang].split(), k=40)), lang, "s"


def test_language_of_held_out_rows(documents):
    df = documents(list(language_rows(90, 1)))
    profiles = language_id.learn(df.where(~language_id.held_out()))
    found = language_id.identify(df.where(language_id.held_out()), profiles).collect()
    truth = {i: lang for i, _, lang, _ in language_rows(90, 1)}
    assert found and all(r["lang_pred"] == truth[r["doc_id"]] and 0 < r["score"] <= 1 for r in found)
    assert {r["doc_id"] for r in found} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}


def plain_profile(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return []
    line = " " + " ".join(words) + " "
    grams = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    del grams[" "]
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], key(x[0])))][: language_id.PROFILE_SIZE]


def test_out_of_place_distance_by_hand(documents):
    df = documents([(1, SAMPLES["en"], "en", "s"), (2, SAMPLES["de"], "de", "s")])
    profiles = language_id.learn(df)
    text = "the hund und dog"
    mine, size = plain_profile(text), language_id.PROFILE_SIZE
    distance = {}
    for lang in ("de", "en"):
        ranks = {g: i for i, g in enumerate(plain_profile(SAMPLES[lang]))}
        distance[lang] = sum(min(size, abs(i - ranks[g])) if g in ranks else size for i, g in enumerate(mine))
    best = min(sorted(distance), key=distance.get)
    assert profiles.predict(text) == (best, pytest.approx(1 - distance[best] / (size * len(mine))))


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(SAMPLES["fr"].split() * 30)
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    parts = language_id.gram_counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_language_of_awkward_rows(awkward, nothing):
    profiles = language_id.learn(awkward)
    found = language_id.identify(awkward, profiles).collect()
    assert len(found) == awkward.count()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found if r["doc_id"] in (1, 2, 3, 7)} == {
        i: ("und", 0.0) for i in (1, 2, 3, 7)
    }
    kept = language_id.keep_identified(awkward, profiles)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    empty = language_id.learn(nothing)
    assert language_id.identify(nothing, empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(awkward, empty).collect()} == {"und"}


# --- licenses -------------------------------------------------------------------------


def plain_licenses(text):
    """Best share of a template's shingles in any passage of its length."""
    words, out = normalized(text.encode()).split(), {}
    for name, template in license_scan.TEMPLATES.items():
        wanted = normalized(template.encode()).split()
        n = min(len(wanted), 5)
        shingles = Counter(shingles_of(wanted, n))
        runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        best = 0.0
        for i in range(max(0, len(runs) - (len(wanted) - n) or 1) if runs else 0):
            held = Counter(runs[i : i + len(wanted) - n + 1])
            best = max(best, sum(min(c, held[s]) for s, c in shingles.items()) / sum(shingles.values()))
        if best >= 0.8:
            out[name] = best
    return out


def test_no_language_is_lost_to_the_sample(documents):
    rows = []
    for lang, text in (("xx", "aba bab"), ("yy", "cdc dcd"), ("zz", "efe fef")):
        rows += [(7, text, lang, "s")] * 30
    rows += [(8, f"aba{i} bab", "xx", "s") for i in range(30)]
    for sample in (1, 10):
        assert language_id.learn(documents(rows), sample=sample).languages == ("xx", "yy", "zz")


def test_licenses_whole_and_edited(documents):
    rng = random.Random(4)
    noise = lambda k: " ".join(rng.choices("lorem ipsum dolor sit amet and the of software license".split(), k=k))
    texts = []
    for name, template in sorted(license_scan.TEMPLATES.items()):
        for gap in (0, 3, 50, 333):
            texts.append(noise(gap) + " " + template + " " + noise(gap))
        words = template.split()
        if len(words) > 30:
            texts.append(noise(40) + " " + " ".join(words[:-2]) + " " + noise(40))
            at = len(words) // 2
            texts.append(noise(7) + " " + " ".join(words[:at] + ["INSERTED"] + words[at:]) + " " + noise(9))
            texts.append(" ".join(words[: len(words) // 2]))
    texts += [noise(5_000), "MIT License", ""]
    found = defaultdict(dict)
    for r in license_scan.licenses(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        found[r["doc_id"]][r["license"]] = r["containment"]
    for i, text in enumerate(texts):
        assert found[i] == pytest.approx(plain_licenses(text)), text[:80]


def test_license_places_and_awkward_rows(documents, awkward, nothing):
    line = license_scan.TEMPLATES["MIT"]
    [row] = license_scan.licenses(documents([(8, f"a b c {line} d e {line}", "en", "s")])).collect()
    assert (row["license"], row["containment"], row["first_word"], row["passages"]) == ("MIT", 1.0, 3, 2)
    assert license_scan.licenses(awkward).count() == 0 and license_scan.licenses(nothing).count() == 0
    assert license_scan.licenses(awkward, {"none": " !", "null": None}).count() == 0
    repeated = license_scan.licenses(awkward, {"seven": "One two three four five six seven"}).collect()
    assert sorted(str(r["doc_id"]) for r in repeated) == ["4", "4", "None"]


# --- benchmark passages ---------------------------------------------------------------


def plain_matches(text, items):
    words, out = normalized((text or "").encode()).split(), {}
    for item_id, item in items:
        wanted = normalized((item or "").encode()).split()
        if not wanted:
            continue
        n = min(len(wanted), 5)
        shingles = Counter(shingles_of(wanted, n))
        total = sum(len(s) * c for s, c in shingles.items())
        runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        best = 0.0
        for i in range(len(runs)):
            held = Counter(runs[i : i + len(wanted) - n + 1])
            best = max(best, sum(len(s) * min(c, held[s]) for s, c in shingles.items()) / total)
        if best >= decontaminate.THRESHOLD:
            out[item_id] = best
    return out


def test_benchmark_passages_against_all_windows(spark, documents):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 60)))) for i in range(40)]
    texts = []
    for _, item in items:
        words = item.split()
        noise = lambda k: rng.choices(vocabulary, k=k)
        texts.append(" ".join(noise(30) + words + noise(30)))
        texts.append(" ".join(noise(3) + words).upper() + "!!")
        changed = words.copy()
        changed[rng.randrange(len(words))] = "other"
        texts.append(" ".join(noise(50) + changed + noise(1)))
        texts.append(" ".join(noise(80)))
        texts.append(" ".join(words[: len(words) // 2] + noise(20)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    found = defaultdict(dict)
    for r in decontaminate.matches(docs, benchmark).collect():
        found[r["doc_id"]][r["item_id"]] = r["similarity"]
    expected = {i: plain_matches(t, items) for i, t in enumerate(texts)}
    assert {i: m for i, m in found.items()} == {i: pytest.approx(m) for i, m in expected.items() if m}
    kept = decontaminate.keep_clean(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, m in expected.items() if not m}


def test_item_blocks_give_the_same(spark, documents, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha beta gamma delta number{i} omega") for i in range(30)], "item_id long, text string")
    docs = documents([(i, f"x alpha beta gamma delta number{i} omega y", "en", "s") for i in range(40)])
    whole = sorted(map(tuple, decontaminate.matches(docs, items).collect()))
    blocks = decontaminate.item_blocks(items, 7)
    assert sum(len(b.ids) for b in blocks) == 30
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (7,))
    assert sorted(map(tuple, decontaminate.matches(docs, items).collect())) == whole and len(whole) == 30


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(8)
    items = decontaminate.Items([(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}") for i in range(50)])
    own = items.prints[7]
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 40, 400)], np.uint64)
    prints = own[rng.integers(0, 50, 400)] ^ flips
    window, item = items.within(7, prints)
    expected = np.bitwise_count(prints[:, None] ^ own[None, :]) <= decontaminate.RADIUS
    assert set(zip(window.tolist(), item.tolist())) == {(int(w), int(i)) for w, i in zip(*np.nonzero(expected))}


def test_benchmark_of_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame(
        [(1, None), (2, " "), (3, "one two three four five six seven"), (None, "two three four five six")], "item_id long, text string"
    )
    found = decontaminate.matches(awkward, items).collect()
    expected = [(d, i) for d in ("4", "4", "None") for i in ("3", "None")]
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in found) == sorted(expected)
    kept = decontaminate.keep_clean(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    assert decontaminate.matches(nothing, items).count() == 0
    assert decontaminate.matches(awkward, items.where("item_id = 99")).count() == 0


# --- language model -------------------------------------------------------------------


def test_language_model_scores(documents):
    rows = [(i, t, g, s) for i, t, g, s in language_rows(300, 2)] + [(900, None, None, None), (901, "", "en", "s")]
    found = {r["doc_id"]: r for r in maxent_lm.log_likelihoods(documents(rows)).collect()}
    assert len(found) == len(rows)
    tokens = {i: (t or "").lower().split() + [None] for i, t, _, _ in rows}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, own in tokens.items() if i not in held for w in own)
    total = sum(counts.values())
    for i, own in tokens.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (i in held, len(own), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(base)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert sum(found[i]["score"] for i in held) > sum(found[i]["base_score"] for i in held)


def test_rare_words_are_looked_up_in_the_join(documents, monkeypatch):
    df = documents(list(language_rows(60, 5)))
    whole = {r["doc_id"]: r for r in maxent_lm.log_likelihoods(df).collect()}
    monkeypatch.setattr(maxent_lm, "FREQUENT", 5)
    monkeypatch.setattr(maxent_lm, "CENTROID_WORDS", 5)
    for r in maxent_lm.log_likelihoods(df).collect():
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"])


def test_class_shares_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(maxent_lm.FEATURES, 7)).astype(np.float32)
    at = rng.integers(0, maxent_lm.FEATURES, (6, 50))
    assert np.exp(maxent_lm.class_log_shares(weights, at)).sum(axis=1) == pytest.approx(np.ones(50), abs=1e-5)


def test_word_shares_sum_to_one_within_a_class():
    rng = np.random.default_rng(1)
    mass, kinds = rng.integers(1, 500, 60).astype(float), np.repeat([1, 2, 3, 0], [40, 18, 1, 1])
    trees = maxent_lm.word_trees(mass, kinds)
    contexts = np.repeat([[3], [123_456]], len(mass), axis=1)
    plain = np.zeros((maxent_lm.WORD_FEATURES, maxent_lm.BRANCHES), np.float32)
    shares = np.exp(maxent_lm.word_log_shares(plain, trees, np.arange(len(mass)), contexts))
    assert shares == pytest.approx(mass / np.bincount(kinds, mass)[kinds], rel=1e-4)
    weights = rng.normal(size=plain.shape).astype(np.float32)
    tilted = np.exp(maxent_lm.word_log_shares(weights, trees, np.arange(len(mass)), contexts))
    assert np.bincount(kinds, tilted) == pytest.approx(np.ones(4), abs=1e-4)
    assert not np.allclose(tilted, shares)


def test_words_of_a_class_depend_on_the_words_before(documents, monkeypatch):
    # Words of one class in pairs; half of the rows that were held out have the pairs crossed.
    monkeypatch.setattr(maxent_lm, "CLASSES", 2)
    monkeypatch.setattr(maxent_lm.fit_classes, "__defaults__", (1, 10))
    names = [a + b for a in "abcd" for b in "klmn"]
    rng = random.Random(5)
    rows = []
    for i in range(600):
        held = zlib.crc32(str(i).encode()) % 7 == 2
        turn = 3 if held and i % 2 else 0
        firsts = [rng.randrange(16) for _ in range(300)]
        rows.append((i, " ".join(f"{names[k]} {names[(k + turn) % 16] * 2}" for k in firsts), "en", "s"))
    found = [r for r in maxent_lm.log_likelihoods(documents(rows)).collect() if r["held_out"]]
    right, crossed = ([r["score"] for r in found if r["doc_id"] % 2 == k] for k in (0, 1))
    assert sum(right) / len(right) > sum(crossed) / len(crossed) + 100


def test_language_model_of_awkward_rows(awkward, nothing):
    found = maxent_lm.log_likelihoods(awkward).collect()
    assert len(found) == awkward.count() and all(math.isfinite(r["score"]) for r in found)
    assert maxent_lm.log_likelihoods(nothing).count() == 0


# --- token files and edits ------------------------------------------------------------


@pytest.mark.parametrize("top", [3, 300, 60_000])
def test_range_coder_round_trip(top):
    rng = np.random.default_rng(top)
    sizes = np.array([700, 700, 512, 20, 1])
    ids = np.zeros((5, 700), np.int64)
    for row, size in zip(ids, sizes):
        row[:size] = rng.zipf(1.3, size) % top
    blocks = range_coder.encode(ids, sizes)
    assert np.array_equal(range_coder.decode(blocks, sizes), ids)
    order = [2, 3, 4]
    alone = range_coder.decode([blocks[i] for i in order], sizes[order])
    assert np.array_equal(alone, ids[order][:, :512])


def test_a_task_codes_in_little_memory():
    ids = np.random.default_rng(3).integers(0, 50_000, (token_files.LANES, 48)).astype(np.uint16)
    sizes = np.full(len(ids), 48)
    tracemalloc.start()
    try:
        blocks = range_coder.encode(ids, sizes)
        assert np.array_equal(range_coder.decode(blocks, sizes), ids)
        assert tracemalloc.get_traced_memory()[1] < 50e6
    finally:
        tracemalloc.stop()


def test_repeating_ids_get_shorter():
    ids = np.tile(np.arange(50), 40)[None, :]
    [block] = range_coder.encode(ids, np.array([2000]))
    assert len(block) < 0.35 * 2 * 2000


TEXTS = [
    "plain words, here.\nAnd  two blanks\t tab \n\n end ",
    "don't <|endoftext|> stop | a | b  |",
    "naïve café über 12345 67 ½ ² x² 日本語 テキスト 🙂 ok",
    " leading", "trailing ", "", None, "a b   c d \x1c e", "x" * 5000, "- - -- 's 'll",
]


@pytest.mark.parametrize("block_ids, lanes", [(64, 5), (2048, 2048)])
def test_token_files_round_trip(documents, tokenizer, block_ids, lanes):
    rows = [(100 - i, t, "en", "s") for i, t in enumerate(TEXTS * 3)] + [(None, "no id", "en", "s")]
    found = token_files.token_files(documents(rows), BPE, block_ids, lanes).orderBy("start").collect()
    at = 0
    for r, (doc_id, text, _, _) in zip(found, sorted(rows, key=lambda r: -1 if r[0] is None else r[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), crc)
        at += len(ids)
    assert len(found) == len(rows)


def test_damaged_blocks_are_refused(spark, documents, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(documents([(1, "some text to write", "en", "s")]), BPE, path)
    blocks = spark.read.parquet(path)
    for change in ({"payload": F.concat("payload", F.lit(b"x"))}, {"ids_crc32": F.col("ids_crc32") + 1}):
        broken = str(tmp_path / next(iter(change)))
        blocks.withColumns(change).write.parquet(broken)
        with pytest.raises(Exception, match="damaged"):
            token_files.read_token_files(spark, broken).collect()


def test_crc32_of_joined_bytes():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"hello ", b"world" * 999)):
        assert token_files.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files_of_awkward_rows(awkward, nothing):
    found = token_files.token_files(awkward, BPE).collect()
    assert len(found) == awkward.count() and {r["n_tokens"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert token_files.token_files(nothing, BPE).count() == 0


def test_edits_count_as_if_encoded_anew(tokenizer):
    rng = random.Random(12)
    encoder = token_files.Encoder(BPE)
    for text in [t or "" for t in TEXTS] + [" ".join(rng.choices(SAMPLES["de"].split(), k=900)) for _ in range(8)]:
        tree = edit_counts.build(encoder, text)
        assert tree.tokens[1] == len(tokenizer.encode(text, add_special_tokens=False).ids)
        for _ in range(12):
            start = rng.randint(-2, len(text) + 3)
            end = start + rng.choice([-3, 0, 1, 7, 60, 900])
            new = rng.choice(["", " ", "x", " word", "\n\n", "'s", "  two  ", "y" * 700, " many words" * 90])
            low = min(max(start, 0), len(text))
            expected = text[:low] + new + text[min(max(end, low), len(text)) :]
            tree, text, encoded = edit_counts.edit(encoder, tree, text, start, end, new)
            assert text == expected and tree.chars[1] == len(text) and encoded <= len(text)
            assert tree.tokens[1] == len(tokenizer.encode(text, add_special_tokens=False).ids)
            assert all(tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1] for i in range(1, tree.width))


def test_small_edits_encode_little():
    encoder = token_files.Encoder(BPE)
    text = " ".join(SAMPLES["en"].split() * 2_000)
    tree = edit_counts.build(encoder, text)
    _, _, encoded = edit_counts.edit(encoder, tree, text, 50_000, 50_004, "news")
    assert encoded < 4 * edit_counts.LEAF_CHARS


def test_edits_of_awkward_rows(spark, awkward, nothing, tokenizer):
    edits = F.expr(
        "array(named_struct('start', 2L, 'end', 5L, 'text', 'new'), null, "
        "named_struct('start', null, 'end', null, 'text', null), named_struct('start', 99999999L, 'end', 1L, 'text', ' end'))"
    ).cast(edit_counts.EDITS)
    found = edit_counts.recounted(edit_counts.token_trees(awkward.withColumn("edits", edits), BPE), BPE).collect()
    assert len(found) == awkward.count()
    one = next(r for r in found if r["doc_id"] == 4)
    assert (one["n_edits"], one["edited_tokens"]) == (3, len(tokenizer.encode("onnewwo three four five six seven end").ids))
    none = edit_counts.token_trees(awkward.withColumn("edits", F.lit(None).cast(edit_counts.EDITS)), BPE)
    assert all(r["n_edits"] == 0 and r["n_tokens"] == r["edited_tokens"] for r in edit_counts.recounted(none, BPE).collect())
    empty = edit_counts.token_trees(nothing.withColumn("edits", F.lit(None).cast(edit_counts.EDITS)), BPE)
    assert edit_counts.recounted(empty, BPE).count() == 0
