"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is that of its class given the tokens before, times
its own within the class. Classes come from a word's letters (spherical k-means
over hashed character pairs of the most frequent words), so every word has one,
known or not; the end of a text is a class of its own. A class's probability is
a softmax over sums of weights of hashed features: n-grams of the preceding
words and classes, and skips over them. Within a class the frequent words and one
place for all others hang in a tree (Huffman's, of ``BRANCHES`` branches); every node
on a word's path is a softmax over its branches, by their smoothed training
frequencies times what the preceding word and class say. The others share their
place by smoothed frequency, with one part for all unknown words, so probabilities
of all words sum to one.

Training goes over all training tokens in ``ROUNDS`` rounds. In a round every
partition runs AdaGrad steps on mini-batches from the common weights and reports
what it changed; Spark sums the changes per feature, weighted by how often each
partition met it. What comes to the driver is the model, ``FEATURES`` and
``WORD_FEATURES`` rows, whatever the corpus. Word counts stay distributed: a table of the ``FREQUENT``
most frequent words goes to the tasks, all others are looked up in a join. Texts
are cut into words twice, to count them and to write them as packed numbers, which
all later passes read.

Defined results: null and blank texts are one end token; without training rows
nothing is known and all classes are equally likely; a null ``doc_id`` counts as
the empty text when rows are held out; repeated rows get equal rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lookalike.llm.common import id_digest, text_chunks
from lookalike.sources.scratch import written

#: Word classes, and the end's.
CLASSES = 24
END_CLASS = 0
FEATURES = 1 << 14
#: Words that carry the classes' centroids; the documented bound of that fit.
CENTROID_WORDS = 20_000
#: Words whose counts every task holds, at most; about 5 MB.
FREQUENT = 100_000
PAIR_BUCKETS = 256
#: Branches of a node of the word trees, and rows of their hashed weights.
BRANCHES = 16
WORD_FEATURES = 1 << 15
#: Logarithm of the share of a branch that a node has not.
NO_BRANCH = -50.0
ROUNDS = 2
BATCH_TOKENS = 16_384
RATE = 0.3
WORD_RATE, DAMPING = 0.5, 5.0
#: Tokens whose features are made at a time.
CHUNK_TOKENS = 1 << 18
#: Words a worker remembers; then it starts anew.
CACHE_WORDS = 400_000
_LOG10E = 1.0 / np.log(10.0)


def held_out() -> Column:
    """Rows that take no part in learning."""
    return id_digest("doc_id") % 7 == 2


def _pair_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character pairs of words, with marks for start and end, and where each word's begin."""
    joined = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8).astype(np.int64)
    bucket = ((joined[:-1] * 31_337 + joined[1:] * 7_919) >> 3) % PAIR_BUCKETS
    return bucket, np.flatnonzero(joined[:-1] == 10)


def letter_pairs(words: list[bytes]) -> np.ndarray:
    """Unit rows of the counts of hashed character pairs."""
    bucket, starts = _pair_buckets(words)
    n = len(words)
    owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(bucket))))
    rows = np.bincount(owner * PAIR_BUCKETS + bucket, minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_classes(words: list[bytes], classes: int = CLASSES, rounds: int = 10) -> np.ndarray:
    """Centroids of the word classes; may be fewer than asked for if words are few."""
    if not words:
        return np.ones((1, PAIR_BUCKETS)) / np.sqrt(PAIR_BUCKETS)
    points = letter_pairs(words)
    centroids = points[np.linspace(0, len(points) - 1, min(classes, len(points))).astype(int)].copy()
    for _ in range(rounds):
        home = np.argmax(points @ centroids.T, axis=1)
        for k in range(len(centroids)):
            total = points[home == k].sum(axis=0)
            if total.any():
                centroids[k] = total / np.linalg.norm(total)
    return centroids


@dataclass
class Lexicon:
    """Class, hash and rank of words; ranks count the frequent words from 1, 0 is any other."""

    centroids: np.ndarray
    frequent: dict[bytes, int] = field(default_factory=dict)
    known: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"centroids": self.centroids, "frequent": self.frequent, "known": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @property
    def classes(self) -> int:
        return len(self.centroids) + 1

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        """The nearest centroid; a word's length does not matter for that, and neither do its neighbours."""
        columns, found = np.ascontiguousarray(self.centroids.T), []
        for i in range(0, len(words), 8192):
            bucket, starts = _pair_buckets(words[i : i + 8192])
            near = np.add.reduceat(columns.take(bucket, axis=0, mode="clip"), starts, axis=0)
            found.append(np.argmax(near, axis=1) + 1)
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def learn(self, words: set[bytes]) -> None:
        """Remember words: rank in the low 24 bits, then 8 bits of class, then 24 of hash."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        missing = [word for word in words if word not in self.known]
        for word, k in zip(missing, self.classes_of(missing).tolist()):
            self.known[word] = self.frequent.get(word, 0) | k << 24 | (zlib.crc32(word) & 0xFFFFFF) << 32


PACKED_SCHEMA = "serial long, doc_id long, packed binary, rare array<struct<word:binary,kind:int,times:long>>"


def packed_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(serial, doc_id, packed, rare)`` of ``docs (doc_id, text)``.

    ``packed`` holds a 64-bit number per word, see ``Lexicon.learn``; ``rare`` counts the
    words that are not among the frequent ones. ``serial`` tells rows apart in the
    table once it is written.
    """
    piece = pa.struct([("word", pa.binary()), ("kind", pa.int32()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch):
                whole = data.tobytes()
                words = [whole[offsets[i] : offsets[i + 1]].lower().split() for i in range(hi - lo)]
                lexicon.learn(set().union(*words))
                ends = np.cumsum([0, *map(len, words)])
                packed = np.fromiter(map(lexicon.known.__getitem__, chain.from_iterable(words)), np.int64, ends[-1])
                rare: list[list] = [[] for _ in words]
                at = np.flatnonzero((packed & 0xFFFFFF) == 0)
                kinds = ((packed[at] >> 24) & 0xFF).tolist()
                owners = np.searchsorted(ends, at, side="right") - 1
                places = (at - ends[owners]).tolist()
                found = Counter((d, words[d][i], k) for d, i, k in zip(owners.tolist(), places, kinds))
                for (d, word, k), n in found.items():
                    rare[d].append({"word": word, "kind": k, "times": n})
                raw = pa.py_buffer((8 * ends).astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), len(words), [None, raw, pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(serial + np.arange(len(words))),
                        batch.column(0).slice(lo, hi - lo),
                        binary,
                        pa.array(rare, pa.list_(piece)),
                    ],
                    ["serial", "doc_id", "packed", "rare"],
                )
                serial += len(words)

    return docs.mapInArrow(run, PACKED_SCHEMA)


@dataclass
class Tokens:
    """Tokens of several documents, one after the other; every one ends with the end token."""

    row: int
    bounds: np.ndarray
    rank: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    contexts: np.ndarray


@dataclass
class WordTrees:
    """A tree of places for every class; a place is a frequent word or all other words of a class.

    The path of place ``i`` is ``nodes[starts[i] : starts[i + 1]]`` with the branches taken in ``slots``;
    ``priors (nodes, BRANCHES)`` are logarithms of the branches' shares of the node.
    """

    starts: np.ndarray
    nodes: np.ndarray
    slots: np.ndarray
    priors: np.ndarray

    def decisions(self, place: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(owner, node, slot, at)`` of all nodes on the paths; ``at (2, n)`` are their feature rows."""
        depth = self.starts[place + 1] - self.starts[place]
        owner = np.repeat(np.arange(len(place)), depth)
        step_ = np.arange(len(owner)) - np.repeat(np.cumsum(depth) - depth, depth) + np.repeat(self.starts[place], depth)
        node = self.nodes[step_]
        keys = contexts[:, owner] + (node.astype(np.int64) << 25) + (np.arange(1, 3) << 50)[:, None]
        return owner, node, self.slots[step_], hashed(keys, WORD_FEATURES)


def word_trees(mass: np.ndarray, kinds: np.ndarray) -> WordTrees:
    """Huffman trees of the places of each class by their ``mass``."""
    above, slot, priors = [-1] * len(mass), [0] * len(mass), []
    members: dict[int, list] = {}
    for i, (m, k) in enumerate(zip(mass.tolist(), kinds.tolist())):
        members.setdefault(k, []).append((m, i))
    for heap in members.values():
        heapify(heap)
        # The first node takes what makes all later ones full.
        take = (len(heap) - 2) % (BRANCHES - 1) + 2
        while len(heap) > 1:
            below = [heappop(heap) for _ in range(take)]
            own, total, take = len(above), sum(m for m, _ in below), BRANCHES
            above.append(-1)
            slot.append(0)
            priors.append([np.log(m / total) for m, _ in below] + [NO_BRANCH] * (BRANCHES - len(below)))
            for j, (_, i) in enumerate(below):
                above[i], slot[i] = own, j
            heappush(heap, (total, own))
    up, branch, at, leaf, paths = np.array(above), np.array(slot), np.arange(len(mass)), np.arange(len(mass)), []
    while len(at):
        leaf, at = leaf[up[at] >= 0], at[up[at] >= 0]
        paths.append((leaf, up[at] - len(mass), branch[at]))
        at = up[at]
    leaves, nodes, slots = (np.concatenate(x) for x in zip(*paths))
    order = np.argsort(leaves, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(leaves, minlength=len(mass)))])
    shares = np.array(priors, np.float32).reshape(-1, BRANCHES)
    return WordTrees(starts, nodes[order].astype(np.int32), slots[order].astype(np.int8), shares)


def token_chunks(batch: pa.RecordBatch, column: str = "packed") -> Iterator[Tokens]:
    """Whole documents, about ``CHUNK_TOKENS`` at a time."""
    values = batch.column(batch.schema.get_field_index(column))
    n = len(values)
    if not n:
        return
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64) // 8
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_TOKENS, side="right")) - 1)
        sizes = np.diff(offsets[lo : hi + 1]) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        packed = np.zeros(bounds[-1], np.int64)
        inner = np.ones(len(packed), bool)
        inner[bounds[1:] - 1] = False
        packed[inner] = data[8 * offsets[lo] : 8 * offsets[hi]].view(np.int64)
        kind = (packed >> 24) & 0xFF
        rows, contexts = features(packed >> 32, kind, bounds)
        yield Tokens(lo, bounds, packed & 0xFFFFFF, kind, rows, contexts)
        lo = hi


def hashed(keys: np.ndarray, rows: int) -> np.ndarray:
    """Places of ``keys`` among ``rows`` weights, a power of two."""
    keys = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        keys *= np.uint64(0x9E3779B97F4A7C15)
    return (keys >> np.uint64(65 - rows.bit_length())).astype(np.int32)


def features(hashes: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six feature rows per token, ``(6, n)`` places among the hashed weights, and the class and word before."""
    n = len(kind)
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))

    def before(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[k:] = x[: n - k] + 1 if n > k else 0
        out[place < k] = 0
        return out

    k1, k2, k3 = (before(kind, k) for k in (1, 2, 3))
    h1, h2 = (before(hashes, k) for k in (1, 2))
    keys = np.stack([k1, k1 * 257 + k2, k2 * 257 + k3, h1, h2, h1 * 7_368_787 + h2])
    return hashed(keys + (np.arange(1, 7) << 44)[:, None], FEATURES), np.stack([k1, h1])


def class_log_shares(weights: np.ndarray, at: np.ndarray, priors: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithms of the probabilities of classes or, with ``priors``, of branches: ``(n, classes)``."""
    total = weights.take(at[0], axis=0, mode="clip")
    for row in at[1:]:
        total += weights.take(row, axis=0, mode="clip")
    if priors is not None:
        total += priors
    # Far below where exponentials of single precision end.
    np.clip(total, -60, 60, out=total)
    total -= np.log(np.exp(total) @ np.ones(weights.shape[1], np.float32))[:, None]
    return total


def word_log_shares(
    weights: np.ndarray, trees: WordTrees, place: np.ndarray, contexts: np.ndarray
) -> np.ndarray:
    """Natural logarithms of the probabilities of places within their classes."""
    owner, node, slot, at = trees.decisions(place, contexts)
    shares = class_log_shares(weights, at, trees.priors.take(node, axis=0))
    return np.bincount(owner, shares[np.arange(len(owner)), slot], len(place))


def word_step(
    weights: np.ndarray, curves: np.ndarray, at: np.ndarray, slot: np.ndarray, priors: np.ndarray
) -> None:
    """One step of the trees' weights; the gradient and its slope are summed per feature and branch.

    The priors already fit the words' frequencies, so a weight moves by what its own
    observations say, damped while they are few.
    """
    shares = np.exp(class_log_shares(weights, at, priors))
    slopes = np.ascontiguousarray((shares * (1.0 - shares)).T, np.float64)
    shares[np.arange(len(slot)), slot] -= 1.0
    flat, each = at.ravel(), np.ascontiguousarray(shares.T, np.float64)
    for k, (own, slope) in enumerate(zip(each, slopes)):
        gradient = np.bincount(flat, np.tile(own, len(at)), len(weights)).astype(np.float32)
        curves[k] += np.bincount(flat, np.tile(slope, len(at)), len(weights)).astype(np.float32)
        weights[:, k] -= WORD_RATE * gradient / (curves[k] + DAMPING)


def step(weights: np.ndarray, squares: np.ndarray, at: np.ndarray, kind: np.ndarray) -> None:
    """One AdaGrad step on a mini-batch; the gradient is summed per feature and class."""
    error = np.exp(class_log_shares(weights, at))
    error[np.arange(len(kind)), kind] -= 1.0
    flat, each = at.ravel(), np.ascontiguousarray(error.T, np.float64)
    for k, own in enumerate(each):
        gradient = np.bincount(flat, np.tile(own, len(at)), FEATURES).astype(np.float32)
        squares[k] += gradient * gradient
        weights[:, k] -= RATE * gradient / np.sqrt(squares[k] + 1.0)


def train(
    docs: DataFrame, classes: int, trees: WordTrees, words: int, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes ``(FEATURES, classes)`` and of the trees ``(WORD_FEATURES, BRANCHES)``.

    They are learned from ``docs (packed)``; ``words`` are frequent. Both lie in one table,
    the classes' rows first.
    """
    width = max(classes, BRANCHES)
    weights = np.zeros((FEATURES + WORD_FEATURES, width), np.float32)
    columns = [f"w{k}" for k in range(width)]
    schema = "feature int, met double, " + ", ".join(f"{c} double" for c in columns)

    def parts(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return whole[:FEATURES, :classes].copy(), whole[FEATURES:, :BRANCHES].copy()

    for _ in range(rounds):
        start = weights

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            own, inner = parts(start)
            squares, curves = (np.zeros(w.T.shape, np.float32) for w in (own, inner))
            met = np.zeros(len(start), np.int64)
            for batch in batches:
                for tokens in token_chunks(batch):
                    met[:FEATURES] += np.bincount(tokens.features.ravel(), minlength=FEATURES)
                    place = places(tokens, words)
                    for i in range(0, len(tokens.kind), BATCH_TOKENS):
                        part = slice(i, i + BATCH_TOKENS)
                        step(own, squares, tokens.features[:, part], tokens.kind[part])
                        _, node, slot, at = trees.decisions(place[part], tokens.contexts[:, part])
                        met[FEATURES:] += np.bincount(at.ravel(), minlength=WORD_FEATURES)
                        word_step(inner, curves, at, slot, trees.priors.take(node, axis=0))
            moved = np.zeros(start.shape)
            before, inner_before = parts(start)
            moved[:FEATURES, :classes], moved[FEATURES:, :BRANCHES] = own - before, inner - inner_before
            rows = np.flatnonzero(met)
            moved = moved[rows] * met[rows, None]
            arrays = [pa.array(rows.astype(np.int32)), pa.array(met[rows].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *(pa.array(np.ascontiguousarray(moved[:, k])) for k in range(len(columns)))],
                ["feature", "met", *columns],
            )

        changes = docs.select("packed").mapInArrow(run, schema)
        summed = changes.groupBy("feature").agg(F.sum("met").alias("met"), *(F.sum(c).alias(c) for c in columns))
        # At most FEATURES + WORD_FEATURES rows: the model itself.
        found = summed.toPandas()
        weights = weights.copy()
        moved = found[columns].to_numpy() / found[["met"]].to_numpy()
        weights[found["feature"].to_numpy()] += moved.astype(np.float32)
    return parts(weights)


def places(tokens: Tokens, words: int) -> np.ndarray:
    """The place of each token in ``word_trees``: a frequent word's rank less 1, then the classes' others."""
    return np.where(tokens.rank > 0, tokens.rank - 1, words + tokens.kind)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the words of ``docs (text)``, without ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: Counter = Counter()
            for _, _, data, offsets in text_chunks(batch):
                whole = data.tobytes()
                for i in range(len(offsets) - 1):
                    counted.update(whole[offsets[i] : offsets[i + 1]].lower().split())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["word", "n"]
            )

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int | None = None) -> pd.DataFrame:
    """The most frequent words with their counts, most frequent first; all of a count or none.

    At most ``most`` rows come to the driver: a histogram over steps of the counts'
    logarithm, some hundreds of rows, tells from which count on.
    """
    most = FREQUENT if most is None else most
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    lowest, total = None, 0
    for value, size in sizes:
        total += size
        if total > most:
            break
        lowest = value
    chosen = counts.where(level >= lowest) if lowest is not None else counts.limit(0)
    found = chosen.toPandas()
    found["word"] = found["word"].map(bytes)
    return found.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def class_totals(counts: DataFrame, lexicon: Lexicon) -> dict[int, tuple[int, int]]:
    """Training tokens and distinct words of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = lexicon.classes_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), batch.column(1)], ["kind", "n"])

    totals = counts.mapInArrow(run, "kind int, n long").groupBy("kind")
    return {r["kind"]: (r["n"], r["words"]) for r in totals.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}


def log_likelihoods(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.where(~held_out())
    counts = written(word_counts(training), "lm-counts")
    ends = training.count()
    summary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words")).first()
    n, distinct = summary["n"] + ends, summary["words"] + (ends > 0)
    base_total = n + 1 * (distinct + 1)
    frequent = frequent_words(counts)
    lexicon = Lexicon(fit_classes(frequent["word"].iloc[:CENTROID_WORDS].to_list()))
    lexicon.frequent = {word: i + 1 for i, word in enumerate(frequent["word"])}
    times = np.array([0, *frequent["n"]], np.int64)
    totals = class_totals(counts, lexicon)
    class_total = np.array([sum(totals.get(k, (0, 0))) + 1 for k in range(lexicon.classes)], float)
    kinds, words = lexicon.classes_of(frequent["word"].to_list()), len(frequent)
    # What a class has besides its frequent words; one at least, for the unknown.
    others = class_total - np.bincount(kinds, times[1:] + 1.0, lexicon.classes)
    trees = word_trees(np.concatenate([times[1:] + 1.0, others]), np.concatenate([kinds, np.arange(lexicon.classes)]))
    texts = written(packed_texts(rows, lexicon), "lm-texts")
    weights, inner_weights = train(texts.where(~held_out()), lexicon.classes, trees, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_base = np.log10((ends + 1) / base_total)
        for batch in batches:
            for tokens in token_chunks(batch):
                first, docs = tokens.bounds[:-1], len(tokens.bounds) - 1
                share, place = np.empty(len(tokens.kind)), places(tokens, words)
                for i in range(0, len(share), BATCH_TOKENS):
                    part = slice(i, i + BATCH_TOKENS)
                    kind = tokens.kind[part]
                    share[part] = class_log_shares(weights, tokens.features[:, part])[np.arange(len(kind)), kind]
                    share[part] += word_log_shares(inner_weights, trees, place[part], tokens.contexts[:, part])
                c = times[tokens.rank]
                counted = tokens.rank > 0
                end = tokens.bounds[1:] - 1
                base = np.where(counted, np.log10((c + 1) / base_total), 0.0)
                base[end] = end_base
                known = (c > 0).astype(np.int64)
                known[end] = ends > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(tokens.row, docs),
                        batch.column(1).slice(tokens.row, docs),
                        pa.array(np.diff(tokens.bounds)),
                        pa.array(np.add.reduceat(known, first)),
                        pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(share * _LOG10E, first)),
                    ],
                    ["serial", "doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = texts.select("serial", "doc_id", "packed").mapInArrow(
        run, "serial long, doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    rare = texts.select("serial", F.inline("rare")).join(counts, "word", "left")
    among_others = F.element_at(F.array(*(F.lit(float(t)) for t in others)), F.col("kind") + 1)
    seen = F.coalesce("n", F.lit(0))
    late = rare.groupBy("serial").agg(
        F.sum(F.when(seen > 0, F.col("times")).otherwise(F.lit(0))).alias("known"),
        F.sum(F.col("times") * F.log10((seen + 1) / F.lit(float(base_total)))).alias("base"),
        F.sum(F.col("times") * F.log10((seen + 1) / among_others)).alias("inner"),
    )
    joined = scored.join(late, "serial", "left")
    return joined.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("inner", F.lit(0.0))).alias("score"),
    )
