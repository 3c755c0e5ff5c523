"""Toxicity by multiple-instance learning: labels mark documents, scores rate sentences.

A sentence has a probability ``p = 1 / (1 + exp(-(bias + its words' weights)))`` of being
toxic, and a document is toxic unless all of its sentences are not: ``1 - prod(1 - p)``
(noisy-or). Weights and bias are trained from document labels alone, by gradient steps
whose sums come from all tasks; what a sentence adds to a document's score then shows
where the offence is.

Learned from: a bounded sample of the labelled texts, at most about ``SAMPLE_PER_LABEL``
distinct texts of each label, drawn by a hash of the text and weighted back to the
label's share. Copies of a text with one label count once, so a large group of copies
does not decide the model. Features are the words that tell the labels apart (by the
likelihood ratio of documents that hold them, beyond what the best of as many words
would reach by chance), the best ``FEATURES`` of them. Every document is scored by its
whole text.

Sentences end at ``. ! ?`` or a line end, and after ``SENTENCE_WORDS`` words.

Defined results: a null text or one without words has no sentence and score 0; a document
with several labels is toxic if one of them is 1; null labels are not learned from, and
labels without a document say nothing; if the labelled texts are not of both kinds, no
word has a weight and all documents with words get the score 0 or 1 that all labels say
(0 without labels); repeated rows get equal rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lookalike.llm.common import id_digest, text_bytes
from lookalike.sources.scratch import written

THRESHOLD = 0.3
#: Distinct labelled texts of a label to learn from, about; the documented bound.
SAMPLE_PER_LABEL = 20_000
#: Words with a weight, and documents of the sample that must hold such a word.
FEATURES, RAREST = 1 << 13, 3
SENTENCE_WORDS = 64
STEPS, RATE, RIDGE = 60, 0.3, 1e-4
#: Tasks of a training step.
STEP_TASKS = 4

_END = re.compile(r"[.!?\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Sentence:
    start: int
    end: int
    words: list[str]


def sentences(text: str) -> Iterator[Sentence]:
    """Sentences with words, their place in code points, words in lower case."""
    start = 0
    for end in [*(m.start() for m in _END.finditer(text)), len(text)]:
        if end > start:
            found = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text, start, end)]
            for at in range(0, len(found), SENTENCE_WORDS):
                part = found[at : at + SENTENCE_WORDS]
                yield Sentence(part[0][0], part[-1][1], [w for _, _, w in part])
        start = end


@dataclass(frozen=True)
class Model:
    """Weights of words in sentences; ``always`` is the score if nothing could be learned."""

    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0
    always: float | None = 0.0

    def sentence_scores(self, found: list[Sentence]) -> np.ndarray:
        if self.always is not None:
            return np.full(len(found), self.always)
        sums = (sum(self.weights[i] for i in {self.words[w] for w in s.words if w in self.words}) for s in found)
        return _probability(self.bias + np.fromiter(sums, float, len(found)))


def _probability(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def noisy_or(p: np.ndarray) -> float:
    return 1.0 if np.any(p >= 1) else float(-np.expm1(np.log1p(-p).sum()))


# --- learning -----------------------------------------------------------------------------


def _digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, digest)`` of the documents that have a text."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.withColumn("digest", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(digest, toxic, doc_id)``: the distinct texts of ``docs (doc_id, text)`` by label, with one of their ids."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = _digests(docs).select("doc_id", "digest").join(known, "doc_id")
    return met.groupBy("digest", "toxic").agg(F.min("doc_id").alias("doc_id"))


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """``(text, toxic, weight)``: about ``most`` texts of each label, weighted back to all of them.

    Texts are drawn by their digests; only those drawn are moved. Their list has the
    bound of the sample, so it is broadcast.
    """
    texts = written(labelled(docs, labels), "toxicity-labelled")
    sizes = {toxic: n for toxic, n in texts.groupBy("toxic").count().collect()}
    share = F.lit(1.0)
    for toxic, n in sizes.items():
        if n > most:
            share = F.when(F.col("toxic") == toxic, F.lit(most / n)).otherwise(share)
    place = F.pmod("digest.a", F.lit(1 << 30)) / float(1 << 30)
    drawn = texts.where(place < share).withColumn("weight", 1.0 / share)
    found = _digests(docs).join(F.broadcast(drawn), ["doc_id", "digest"])
    return found.dropDuplicates(["digest", "toxic"]).select("text", "toxic", "weight"), sizes


def telling_words(sample: DataFrame, most: int) -> list[str]:
    """Words whose presence tells the labels apart, by likelihood ratio, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            toxic = batch.column(1).to_pylist()
            for row, text in text_bytes(batch):
                for word in {w.lower() for w in _WORD.findall(text.decode("utf-8", "replace"))}:
                    counts.setdefault(word, [0, 0])[toxic[row]] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string())]
                + [pa.array([c[label] for c in counts.values()], pa.int64()) for label in (0, 1)],
                ["word", "clean", "toxic"],
            )

    counted = sample.select("text", "toxic").mapInArrow(run, "word string, clean long, toxic long")
    totals = sample.agg(*(F.sum((F.col("toxic") == label).cast("int")) for label in (0, 1))).first()
    clean, toxic = (F.lit(float(n or 0)) for n in totals)
    words = counted.groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    words = words.where(F.col("c") + F.col("t") >= RAREST)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    held = (F.col("c") + F.col("t")) / (clean + toxic)
    ratio = (
        term(F.col("c"), clean * held)
        + term(F.col("t"), toxic * held)
        + term(clean - F.col("c"), clean * (1 - held))
        + term(toxic - F.col("t"), toxic * (1 - held))
    )
    rated = written(words.select("word", F.round(ratio, 9).alias("ratio")), "toxicity-words")
    # By chance alone a word passes with a probability of about exp(-ratio).
    chance = F.lit(float(np.log(max(rated.count(), 1))))
    best = rated.where(F.col("ratio") > chance).orderBy(F.desc("ratio"), "word").limit(most).select("word")
    return [row["word"] for row in best.collect()]


def _features(sample: DataFrame, words: dict[str, int]) -> DataFrame:
    """``(toxic, weight, sizes, ids)``: a text's sentences, each as its distinct telling words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = [], []
            for _, text in text_bytes(batch):
                own, flat = [], []
                for s in sentences(text.decode("utf-8", "replace")):
                    held = sorted({words[w] for w in s.words if w in words})
                    own.append(len(held))
                    flat += held
                sizes.append(own)
                ids.append(flat)
            columns = [pa.array(x, pa.list_(pa.int32())) for x in (sizes, ids)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), *columns], ["toxic", "weight", "sizes", "ids"]
            )

    return sample.select("text", "toxic", "weight").mapInArrow(
        run, "toxic int, weight double, sizes array<int>, ids array<int>"
    )


def _gradient(features: DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Gradient of the weighted log likelihood by words and bias, summed over all tasks."""
    n = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, total_bias = np.zeros(n), 0.0
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            weight = batch.column(1).to_numpy()
            per_text = batch.column(2).value_lengths().to_numpy()
            sizes = batch.column(2).flatten().to_numpy()
            ids = batch.column(3).flatten().to_numpy()
            text = np.repeat(np.arange(len(toxic)), per_text)
            sentence = np.repeat(np.arange(len(sizes)), sizes)
            z = bias + np.bincount(sentence, weights[ids], len(sizes))
            p = _probability(z)
            # The odds against a text are the product over its sentences.
            clean = np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), len(toxic)))
            slope = np.where(toxic == 1, clean / np.maximum(1 - clean, 1e-12), -1.0) * weight
            step = slope[text] * p
            total += np.bincount(ids, step[sentence], n)
            total_bias += float(step.sum())
        yield pa.RecordBatch.from_arrays([pa.array([[*total, total_bias]], pa.list_(pa.float64()))], ["g"])

    parts = features.mapInArrow(run, "g array<double>")
    total = np.zeros(n + 1)
    for row in parts.toLocalIterator():
        total += np.asarray(row["g"])
    return total[:-1], float(total[-1])


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_PER_LABEL, steps: int = STEPS) -> Model:
    """A model from documents ``(doc_id, text)`` and labels ``(doc_id, toxic)``."""
    sample, sizes = sampled(docs, labels, most)
    if len(sizes) < 2:
        return Model(always=float(next(iter(sizes), 0)))
    sample = written(sample, "toxicity-sample")
    words = telling_words(sample, FEATURES)
    number = {w: i for i, w in enumerate(words)}
    # Every step reads the features once more; they are small, so a few tasks do.
    features = written(_features(sample, number), "toxicity-features").coalesce(STEP_TASKS)
    scale, found = features.agg(F.sum("weight"), F.sum(F.col("weight") * F.size("sizes"))).first()
    # To begin with, sentences share the labels' rate evenly.
    rate = sizes[1] / (sizes[0] + sizes[1])
    bias = float(np.log(max(rate * scale / max(found, 1.0), 1e-9)))
    weights = np.zeros(len(words))
    # Steps of Adam (a public method): each weight's own scale of gradients sets its step.
    mean, square = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        by_word, by_bias = _gradient(features, weights, bias)
        gradient = np.append(by_word / scale - RIDGE * weights, by_bias / scale)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights + move[:-1], bias + float(move[-1])
    return Model(number, weights, bias, None)


# --- scoring ------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted, sentences, offending)`` of ``docs (doc_id, text)``.

    ``offending`` holds the sentences ``(start, end, score)`` that reach the threshold by
    themselves, or the one that scores highest if none does and the document is predicted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, spans = [], [], []
            for _, text in text_bytes(batch):
                found = list(sentences(text.decode("utf-8", "replace")))
                p = model.sentence_scores(found)
                whole = min(1.0, max(0.0, noisy_or(p)))
                at = np.flatnonzero(p >= threshold)
                if not len(at) and whole >= threshold:
                    at = [int(np.argmax(p))]
                scores.append(whole)
                counts.append(len(found))
                spans.append([{"start": found[i].start, "end": found[i].end, "score": float(p[i])} for i in at])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(spans, span)],
                ["doc_id", "score", "sentences", "offending"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_id = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, score double, sentences int, offending array<struct<start:int,end:int,score:double>>"
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    """Rows that take no part in learning."""
    return id_digest("doc_id") % 4 == 2
