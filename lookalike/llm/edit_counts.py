"""Token counts that follow edits, from a segment tree of pre-tokens per document.

A document is cut into leaves of about ``LEAF_CHARS`` characters. Leaves end where
the tokenizer's own splitting always ends a pre-token: between a printable
character and one blank before another. So the tokens of a text are those of its
leaves, and a leaf can be encoded alone. Above the leaves stands a binary tree of
sums of characters and tokens, kept as two arrays: node 1 is the root, node ``i``
has the children ``2 i`` and ``2 i + 1``, the leaves fill the second half.

An edit descends to the leaves it touches by sums of characters. Their text is
edited; where the edit changed a boundary's context, the neighbouring leaf joins
in. Only this region is encoded again. It is cut into as many leaves as before,
some perhaps empty, and the sums above them are updated. A document whose leaves
have grown eightfold is cut anew.

Defined results: a null text is empty; edits are applied in order, each to the
text that the one before left; null edits and null replacements are none and
empty; places outside the text are moved to its nearest end, and an end before
its start is moved there; repeated rows get equal rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lookalike.llm.common import text_bytes
from lookalike.llm.token_files import _SOLID, Encoder, _encoder

LEAF_CHARS = 512
#: A leaf this many times larger makes the document be cut anew.
GROWTH = 8
_CUT = re.compile(f"(?<=[{_SOLID}])(?= [{_SOLID}])")
_OPENS = re.compile(f" [{_SOLID}]")
_CLOSES = re.compile(f"[{_SOLID}]")

EDITS = "array<struct<start:long,end:long,text:string>>"


def cut_leaves(text: str, leaves: int | None = None) -> list[str]:
    """Consecutive parts of about equal length, cut at safe places; exactly ``leaves`` if given."""
    wanted = leaves or max(1, round(len(text) / LEAF_CHARS))
    parts, at = [], 0
    for k in range(1, wanted):
        aim = max(at + 1, len(text) * k // wanted)
        found = _CUT.search(text, aim)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts + [""] * ((leaves or 0) - len(parts))


@dataclass
class TokenTree:
    """Sums of characters and tokens over the leaves of one text."""

    chars: list[int]
    tokens: list[int]

    @classmethod
    def of(cls, leaves: list[str], counts: list[int]) -> TokenTree:
        width = 1
        while width < len(leaves):
            width *= 2
        tree = cls([0] * (2 * width), [0] * (2 * width))
        tree.put(0, leaves, counts)
        return tree

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def put(self, first: int, leaves: list[str], counts: list[int]) -> None:
        """Set consecutive leaves and update the sums above them."""
        lo, hi = self.width + first, self.width + first + len(leaves) - 1
        for i, (leaf, n) in enumerate(zip(leaves, counts)):
            self.chars[lo + i], self.tokens[lo + i] = len(leaf), n
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            for i in range(lo, hi + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, and where it starts; the last real leaf beyond all."""
        node, start = 1, 0
        place = min(place, self.chars[1] - 1)
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def span(self, first: int, last: int) -> int:
        return sum(self.chars[self.width + first : self.width + last + 1])

    def neighbour(self, leaf: int, towards: int) -> int | None:
        """The next leaf that is not empty."""
        leaf += towards
        while 0 <= leaf < self.width:
            if self.chars[self.width + leaf]:
                return leaf
            leaf += towards
        return None


def counted(encoder: Encoder, leaves: list[str]) -> list[int]:
    return [len(ids) // 2 for ids in encoder.encode(leaves)]


def build(encoder: Encoder, text: str) -> TokenTree:
    leaves = cut_leaves(text)
    return TokenTree.of(leaves, counted(encoder, leaves))


def planned(tree: TokenTree, text: str, start: int, end: int, new: str) -> tuple[str, int | None, list[str]]:
    """The text after ``text[start:end] = new``, and the leaves to encode again with the place of the first.

    Without a place the leaves are the whole text's, for a new tree.
    """
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    after = text[:start] + new + text[end:]
    if not text:
        return after, None, cut_leaves(after)
    first, begin = tree.leaf_at(max(0, start - 1))
    last, last_begin = tree.leaf_at(min(end + 1, len(text) - 1))
    stop = last_begin + tree.chars[tree.width + last]
    while True:
        region = text[begin:start] + new + text[end:stop]
        left = tree.neighbour(first, -1) if begin > 0 else None
        right = tree.neighbour(last, 1) if stop < len(text) else None
        if left is not None and not _OPENS.match(region):
            first, begin = left, begin - tree.chars[tree.width + left]
        elif right is not None and not (region and _CLOSES.match(region[-1])):
            last, stop = right, stop + tree.chars[tree.width + right]
        else:
            break
    room = last - first + 1
    if len(region) > GROWTH * LEAF_CHARS * room:
        return after, None, cut_leaves(after)
    return after, first, cut_leaves(region, room)


def settled(tree: TokenTree, first: int | None, leaves: list[str], counts: list[int]) -> TokenTree:
    """The tree with the leaves of a plan."""
    if first is None:
        return TokenTree.of(leaves, counts)
    tree.put(first, leaves, counts)
    return tree


def edit(encoder: Encoder, tree: TokenTree, text: str, start: int, end: int, new: str) -> tuple[TokenTree, str, int]:
    """The tree and the text after ``text[start:end] = new``, and the characters encoded again."""
    after, first, leaves = planned(tree, text, start, end, new)
    return settled(tree, first, leaves, counted(encoder, leaves)), after, sum(map(len, leaves))


def token_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs (doc_id, text, edits)`` with the arrays ``chars`` and ``tokens`` of its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                leaves = [cut_leaves(text.decode("utf-8", "replace")) for _, text in text_bytes(part)]
                counts = iter(counted(encoder, [leaf for own in leaves for leaf in own]))
                trees = [TokenTree.of(own, [next(counts) for _ in own]) for own in leaves]
                arrays = [pa.array([getattr(t, name) for t in trees], pa.list_(pa.int32())) for name in ("chars", "tokens")]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], ["doc_id", "text", "edits", "chars", "tokens"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("edits").cast(EDITS).alias("edits")
    )
    return rows.mapInArrow(run, f"doc_id long, text string, edits {EDITS}, chars array<int>, tokens array<int>")


def recounted(trees: DataFrame, tokenizer: str) -> DataFrame:
    """Apply the edits to the trees; the new trees and counts of every document.

    ``(doc_id, n_tokens, n_edits, edited_chars, edited_tokens, encoded_chars, chars, tokens)``;
    ``encoded_chars`` is how much text the edits made be encoded again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [raw.decode("utf-8", "replace") for _, raw in text_bytes(part)]
                changes = [[c for c in edits or [] if c is not None] for edits in part.column(2).to_pylist()]
                trees = [TokenTree(*both) for both in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                before, encoded = [tree.tokens[1] for tree in trees], [0] * len(trees)
                # The next edit of every document at a time, so that many regions are encoded in one call.
                for k in range(max(map(len, changes), default=0)):
                    due = [i for i, own in enumerate(changes) if len(own) > k]
                    plans = []
                    for i in due:
                        change = changes[i][k]
                        start = change["start"] or 0
                        end = start if change["end"] is None else change["end"]
                        texts[i], *plan = planned(trees[i], texts[i], start, end, change["text"] or "")
                        plans.append(plan)
                    counts = iter(counted(encoder, [leaf for _, leaves in plans for leaf in leaves]))
                    for i, (first, leaves) in zip(due, plans):
                        trees[i] = settled(trees[i], first, leaves, [next(counts) for _ in leaves])
                        encoded[i] += sum(map(len, leaves))
                columns = [
                    before,
                    list(map(len, changes)),
                    list(map(len, texts)),
                    [tree.tokens[1] for tree in trees],
                    encoded,
                    [tree.chars for tree in trees],
                    [tree.tokens for tree in trees],
                ]
                types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["doc_id", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "encoded_chars", "chars", "tokens"],
                )

    return trees.select("doc_id", "text", "edits", "chars", "tokens").mapInArrow(
        run,
        "doc_id long, n_tokens long, n_edits long, edited_chars long, edited_tokens long, encoded_chars long, "
        "chars array<int>, tokens array<int>",
    )


def revision(text: Column, doc_id: Column) -> Column:
    """Edits that a cleaning run might make, the same at every run.

    Takes out up to 40 characters at one place, doubles up to 60 characters of the
    text at another, and puts a word with its blank at a third.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def place(k: int) -> Column:
        return F.pmod(F.xxhash64(doc_id, F.lit(k)), size + 1)

    copy = F.coalesce(F.substring(text, (place(2) + 1).cast("int"), F.lit(60)), F.lit(""))
    return F.array(
        F.struct(place(1).alias("start"), (place(1) + 40).alias("end"), F.lit("").alias("text")),
        F.struct(place(2).alias("start"), place(2).alias("end"), copy.alias("text")),
        F.struct(place(3).alias("start"), place(3).alias("end"), F.lit(" revised").alias("text")),
    )
