"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

The letters are dealt into ``GROUPS`` groups, and a word is a vector: how many of its
letters lie in each group. One inserted letter raises one count, a deleted one lowers
one, a replaced one does both or neither. So a word's neighbours lie where the vectors
differ by a surplus of one and a deficit of one at most. The vectors form a trie, one
group per level, which is searched depth first with that budget; the words of the leaves
reached are verified letter by letter. Every pair is found once, from the side whose
vector is smaller: a deficit may be spent only after the surplus.

The top of the trie is cut where subtrees hold few words. Words are dealt to the subtree
they lie in and, as queries, to all subtrees within their budget; a task holds one
subtree at a time and streams the queries past it. The cut is measured: a node is opened
while it holds more words than a subtree should, so the list of opened nodes (all that
tasks are handed) has a bound whatever the vocabulary. A last level that is still too
full is dealt in pieces, and queries visit each piece.

Defined results: a null or empty text has no words; a null ``doc_id`` counts as an empty
one; repeated rows are counted as often as they come; a word without near words has
``n_near`` 0, no form, and is its own root; among near words of equal counts the first in
code-point order is the form; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lookalike.llm.common import text_bytes
from lookalike.sources.scratch import written

# Which runs are words, and where typing errors are put in.
SHORTEST, RAREST, ERROR_EVERY = 5, 3, 97
RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")

#: Letters: a-z and U+00C0 to U+00FF.
LETTERS = 26 + 64
GROUPS = 12
#: Counts above this one share a branch in the top of the trie.
HIGHEST = 15
#: Words of a subtree, about, and opened nodes on any level, at most.
SUBTREE_WORDS, OPENED = 1_000, 1 << 15
#: Vectors of a node that are compared at once instead of by level.
LEAF_VECTORS = 16
#: Candidate pairs verified at a time; longer words are compared one pair at a time.
CANDIDATES, LONG_WORD = 1 << 17, 64
#: Distinct words counted in a task before they are handed on.
HELD_WORDS = 1 << 18


def words_of(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """Words of at least five letters with their counts, typing errors put in."""
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # Lower-casing bytes leaves all but A-Z alone.
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), salt)
        if h % ERROR_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        yield run, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all words that occur at least three times."""

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, text in text_bytes(batch):
                for word, n in words_of(ids[row], text):
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= RAREST)


# --- words as letters and vectors ---------------------------------------------------------


@dataclass
class Letters:
    """Letters of several words, numbered from 0, one word after the other."""

    code: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Letters:
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        code = np.where(points < 128, points - ord("a"), points - 0xC0 + 26)
        return cls(code, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64))

    def vectors(self, group: np.ndarray) -> np.ndarray:
        n = len(self.size)
        cell = np.repeat(np.arange(n), self.size) * GROUPS + group[self.code]
        return np.bincount(cell, minlength=n * GROUPS).reshape(n, GROUPS)

    def padded(self) -> np.ndarray:
        """A row per word; the letters of longer words are cut at ``LONG_WORD``."""
        at = np.arange(len(self.code)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        row = np.repeat(np.arange(len(self.size)), self.size)
        out = np.zeros((len(self.size), LONG_WORD + 1), np.uint8)
        inside = at < LONG_WORD
        out[row[inside], at[inside]] = self.code[inside] + 1
        return out


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter; letters are dealt to and fro, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS, np.int64)
        for batch in batches:
            total += np.bincount(Letters.of(batch.column(0)).code, minlength=LETTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LETTERS)), pa.array(total)], ["letter", "n"])

    found = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    total = np.zeros(LETTERS, np.int64)
    for letter, n in found.collect():
        total[letter] = n
    place = np.empty(LETTERS, np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(LETTERS)
    turn, step = place // GROUPS, place % GROUPS
    return np.where(turn % 2 == 0, step, GROUPS - 1 - step)


def branch_names(vectors: np.ndarray) -> list[str]:
    """A digit per level: the path of each vector through the top of the trie."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[np.minimum(vectors, HIGHEST)]
    return np.ascontiguousarray(digits).view(f"S{GROUPS}").ravel().astype(str).tolist()


# --- the top of the trie ------------------------------------------------------------------


@dataclass(frozen=True)
class Top:
    """``opened`` nodes, and the subtrees below them with the pieces each is dealt in."""

    opened: frozenset[str]
    subtrees: dict[str, int]

    def home(self, path: str) -> str:
        depth = 0
        while path[:depth] in self.opened:
            depth += 1
        return path[:depth]

    def within_budget(self, path: str) -> list[str]:
        """All subtrees where words may be that a word on ``path`` finds."""
        found, stack = set(), [("", False, False)]
        while stack:
            node, surplus, deficit = stack.pop()
            if node not in self.opened:
                if node in self.subtrees:
                    found.add(node)
                continue
            own = int(path[len(node)], 16)
            steps = [(own, surplus, deficit)]
            if own == HIGHEST:
                # Both counts may be any from here on.
                steps += [(own, True, deficit), (own, surplus, surplus)]
            if not surplus and own < HIGHEST:
                steps.append((own + 1, True, deficit))
            if surplus and not deficit and own > 0:
                steps.append((own - 1, True, True))
            stack += [(f"{node}{count:x}", s, d) for count, s, d in steps]
        return sorted(found)


def top_of_trie(paths: DataFrame, subtree_words: int) -> Top:
    """Open every node above the last level that holds more words than a subtree should."""
    counted = paths.groupBy("path").agg(F.count(F.lit(1)).alias("words"))
    depths = F.explode(F.sequence(F.lit(0), F.lit(GROUPS))).alias("depth")
    by_node = counted.select("path", "words", depths).select(
        "depth", F.expr("substring(path, 1, depth)").alias("node"), "words"
    )
    nodes = written(by_node.groupBy("depth", "node").agg(F.sum("words").alias("words")), "spelling-nodes")
    total = nodes.where("depth = 0").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    most = max(subtree_words, -(-total // OPENED))
    heavy = nodes.where((F.col("words") > most) & (F.col("depth") < GROUPS))
    opened = frozenset(row["node"] for row in heavy.select("node").toLocalIterator())
    parents = heavy.select(F.col("node").alias("parent"))
    light = nodes.where((F.col("words") <= most) | (F.col("depth") == GROUPS))
    below = light.withColumn("parent", F.expr("substring(node, 1, depth - 1)"))
    if opened:
        below = below.where("depth > 0").join(parents, "parent", "left_semi")
    else:
        below = below.where("depth = 0")
    return Top(opened, {row["node"]: -(-row["words"] // most) for row in below.select("node", "words").toLocalIterator()})


# --- one subtree --------------------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i]`` to ``starts[i] + sizes[i]``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Subtree:
    """Words of one subtree, and the search for the near words of others among them."""

    def __init__(self, words: pa.Array, n: np.ndarray, group: np.ndarray):
        vectors = Letters.of(words).vectors(group)
        order = np.lexsort(vectors.T[::-1])
        self.words, self.n = words.take(pa.array(order)), n[order]
        self.letters = Letters.of(self.words)
        self.padded = self.letters.padded()
        self.vectors, self.first, self.size = np.unique(
            vectors[order], axis=0, return_index=True, return_counts=True
        )
        self.group = group

    def _search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a vector of ``wanted`` and one of the subtree that lies within its budget."""
        left, right = [], []
        everything = np.arange(len(wanted))
        used = np.zeros(len(wanted), bool)
        stack = [(0, len(self.vectors), 0, everything, used, used)]
        while stack:
            low, high, level, who, surplus, deficit = stack.pop()
            if high - low <= LEAF_VECTORS or level == GROUPS:
                for at in range(0, len(who), CANDIDATES // 256):
                    some = who[at : at + CANDIDATES // 256]
                    apart = self.vectors[None, low:high] - wanted[some, None]
                    above = np.maximum(apart, 0).sum(axis=2)
                    below = above - apart.sum(axis=2)
                    sign = np.take_along_axis(apart, np.argmax(apart != 0, axis=2)[..., None], axis=2)[..., 0]
                    i, j = np.nonzero((above <= 1) & (below <= 1) & (sign >= 0))
                    left.append(some[i])
                    right.append(low + j)
                continue
            column = self.vectors[low:high, level]
            counts, starts = np.unique(column, return_index=True)
            for count, a, b in zip(counts, starts, [*starts[1:], high - low]):
                apart = count - wanted[who, level]
                up, down = apart == 1, apart == -1
                goes = (apart == 0) | (up & ~surplus) | (down & surplus & ~deficit)
                if goes.any():
                    stack.append(
                        (low + a, low + b, level + 1, who[goes], (surplus | up)[goes], (deficit | down)[goes])
                    )
        empty = np.empty(0, np.int64)
        return (np.concatenate(x) if x else empty for x in (left, right))

    def near(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a word of ``words``, a word of the subtree) exactly one edit apart."""
        letters = Letters.of(words)
        vectors = letters.vectors(self.group)
        wanted, back = np.unique(vectors, axis=0, return_inverse=True)
        back = back.ravel()
        which, leaf = self._search(wanted)
        order = np.argsort(which, kind="stable")
        which, leaf = which[order], leaf[order]
        per_vector = np.bincount(which, minlength=len(wanted))
        starts = np.cumsum(per_vector) - per_vector
        word = np.repeat(np.arange(len(words)), per_vector[back])
        leaf = leaf[_ranges(starts[back], per_vector[back])]
        ends = np.cumsum(self.size[leaf])
        found, at, padded = [], 0, letters.padded()
        while at < len(leaf):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
            size = self.size[leaf[at:to]]
            i, j = np.repeat(word[at:to], size), _ranges(self.first[leaf[at:to]], size)
            ok = one_edit(padded[i], letters.size[i], self.padded[j], self.letters.size[j])
            long = np.flatnonzero((letters.size[i] > LONG_WORD) | (self.letters.size[j] > LONG_WORD))
            ok[long] = [plain_one_edit(words[x].as_py(), self.words[y].as_py()) for x, y in zip(i[long], j[long])]
            # Words of one vector meet from both sides; the smaller one keeps the pair.
            same = np.flatnonzero(ok & (letters.size[i] == self.letters.size[j]))
            same = same[(vectors[i[same]] == self.vectors[np.searchsorted(self.first, j[same], "right") - 1]).all(axis=1)]
            ok[same] = [words[x].as_py() < self.words[y].as_py() for x, y in zip(i[same].tolist(), j[same].tolist())]
            found.append((i[ok], j[ok]))
            at = to
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (empty, empty)


def one_edit(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Rows of padded letters that differ by one replaced letter, or one more in ``b``."""
    replaced = (a_size == b_size) & (np.count_nonzero(a != b, axis=1) == 1)
    longer = np.flatnonzero(b_size == a_size + 1)
    a, b = a[longer], b[longer]
    first_apart = np.argmax(a != b, axis=1)
    shifted = a[:, :-1] != b[:, 1:]
    after_last_shifted = np.where(shifted.any(axis=1), shifted.shape[1] - np.argmax(shifted[:, ::-1], axis=1), 0)
    replaced[longer] = after_last_shifted <= first_apart
    return replaced


def plain_one_edit(a: str, b: str) -> bool:
    """The same for two words of any length; ``b`` is not the shorter one."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return at < len(a) and a[at + 1 :] == b[at + 1 :]
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


# --- all words ----------------------------------------------------------------------------


def near_words(words: DataFrame, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """``(word, other, other_n)``, both ways, for all words of ``words (word, n)`` one edit apart."""
    group = letter_groups(words)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = branch_names(Letters.of(batch.column(0)).vectors(group))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.string())], ["word", "n", "path"])

    placed = written(words.select("word", "n").mapInArrow(name, "word string, n long, path string"), "spelling-paths")
    top = top_of_trie(placed, subtree_words)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, tuple] = {}
            rows, nodes, pieces, queries = [], [], [], []
            for row, (word, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if path not in known:
                    known[path] = top.home(path), top.within_budget(path)
                home, visits = known[path]
                rows.append(row)
                nodes.append(home)
                pieces.append(zlib.crc32(word.encode()) % top.subtrees[home])
                queries.append(0)
                for node in visits:
                    for piece in range(top.subtrees[node]):
                        rows.append(row)
                        nodes.append(node)
                        pieces.append(piece)
                        queries.append(1)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.string()), pa.array(pieces, pa.int32()), pa.array(queries, pa.int32())]
                + [batch.column(0).take(at), batch.column(1).take(at)],
                ["node", "piece", "query", "word", "n"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, subtree = None, [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                node, piece, query = keys[low]
                words, n = batch.column(3).slice(low, high - low), batch.column(4).slice(low, high - low)
                if (node, piece) != current:
                    current, parts, subtree = (node, piece), [], None
                if not query:
                    parts.append((words, n.to_numpy()))
                    continue
                if not parts and subtree is None:
                    continue
                if subtree is None:
                    subtree = Subtree(pa.concat_arrays([w for w, _ in parts]), np.concatenate([c for _, c in parts]), group)
                    parts = []
                i, j = subtree.near(words)
                a, b = words.take(pa.array(i)), subtree.words.take(pa.array(j))
                a_n, b_n = n.take(pa.array(i)), pa.array(subtree.n[j])
                for columns in ([a, b, b_n], [b, a, a_n]):
                    yield pa.RecordBatch.from_arrays(columns, ["word", "other", "other_n"])

    context = words.sparkSession.sparkContext
    tasks = max(2 * context.defaultParallelism, -(-len(top.subtrees) // 16))
    # Routing costs far more than moving a word, and few files hold the words.
    dealt = placed.repartition(tasks, "word").mapInArrow(route, "node string, piece int, query int, word string, n long")
    by_subtree = dealt.repartition(tasks, "node", "piece").sortWithinPartitions("node", "piece", "query")
    return by_subtree.mapInArrow(search, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms (word, form)``: where following the forms ends.

    Every round doubles the steps taken, and counts at least double with each form, so
    six rounds reach the end of any chain of 64-bit counts.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = written(reached.join(onward, "root", "left"), "spelling-roots")
        reached = joined.select("word", F.coalesce("_next", "root").alias("root"))
        if joined.where("_next is not null").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word in ``docs (doc_id, text)``."""
    words = written(vocabulary(docs), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    near = near_words(words, subtree_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("_largest", -F.col("best.less"))
    often = F.col("_largest") >= 2 * F.col("n")
    found = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, F.col("best.other")).alias("form"),
            F.when(often, F.col("_largest")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
