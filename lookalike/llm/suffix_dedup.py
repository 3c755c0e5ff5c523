"""Exact removal of long repeated byte strings, by sorting a sparse set of suffixes.

A string of ``length`` bytes is repeated if it starts at two places of the
corpus. Bytes covered by a repeated string are removed.

Suffixes are thinned out before they are sorted. Every window of ``length`` bytes
is owned by the place inside it where the next ``GRAM`` bytes hash lowest, so equal
windows are owned by equal places. Neighbouring windows with one owner are a run,
about ``(length - GRAM) / 2`` windows long. Then, from coarse to fine, each step
carries on only what is not settled:

1. owners are grouped by the name of their ``GRAM`` bytes; a name that occurs once
   settles all windows of its run as unique;
2. runs are named by all their bytes; a run whose name occurs twice is settled as
   repeated;
3. for names with several different runs, one of them a single one, one example
   of every different run is cut into stretches of ``STRETCH`` windows, on a grid
   that starts at the owner. A stretch is named by the core that all its windows
   share. A core that occurs once settles its windows as unique;
4. a stretch that occurs twice with the bytes around its core is settled as
   repeated;
5. where different stretches share a core, the windows of one example of each
   are named by core and own bytes around it, and single stretches keep the
   windows whose name occurs twice.

Groups are only counted, never listed, and counts are aggregated before the
shuffle, so a passage that a third of all documents share is one row per task.
Names are 64-bit hashes that are compared within the same 64-bit owner name,
which makes 128 bits.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing;
repeated rows repeat each other's text and lose what is long enough; rows may
share a ``doc_id`` or lack one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookalike.llm.common import RangeHash, mixed, text_bytes, text_chunks
from lookalike.sources.scratch import written

LENGTH = 200
GRAM = 32
STRETCH = 16
#: Windows of a long text that are handled at a time.
PIECE = 1 << 20

_GRAMS, _RUNS = RangeHash(seed=11), RangeHash(seed=12)
_NONE = np.uint64(2**64 - 1)


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every ``width`` neighbours, in constant time for each."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, x[-1])])
    blocks = padded.reshape(-1, width)
    up = op.accumulate(blocks, axis=1).ravel()
    down = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(down[:n], up[width - 1 : width - 1 + n])


def owned_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of the texts ``data[offsets[i]:offsets[i + 1]]``.

    Returns text, first window, number of windows, owner (places count from the
    text's start), the owner's name and the run's name.
    """
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sizes = np.diff(offsets)
    end = np.repeat(offsets[1:], sizes)
    place = np.arange(n)
    prefix = _GRAMS.prefix(data)
    names = np.full(n, _NONE)
    names[: n - GRAM + 1] = np.minimum(
        _GRAMS.ranges(prefix, place[: n - GRAM + 1], place[: n - GRAM + 1] + GRAM), _NONE - np.uint64(1)
    )
    names[place + GRAM > end] = _NONE
    width = length - GRAM + 1
    low = sliding(np.minimum, names, width)[: n - length + 1]
    fits = place[: n - length + 1] + length <= end[: n - length + 1]
    # An owner is the lowest name of some window that holds it.
    shown = np.concatenate([np.zeros(width - 1, np.uint64), np.where(fits, low, np.uint64(0)), np.zeros(GRAM - 1, np.uint64)])
    high = sliding(np.maximum, np.concatenate([shown, np.zeros(width, np.uint64)])[: n + width - 1], width)
    owners = np.flatnonzero((high == names) & (names != _NONE))
    # A run starts where the lowest name changes, and after an owner whose name comes again.
    change = np.zeros(len(low), bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | (fits[1:] != fits[:-1])
    again = owners[owners + 1 < len(low)]
    change[again[low[again + 1] == names[again]] + 1] = True
    boundaries = offsets[:-1][offsets[:-1] < len(low)]
    change[boundaries] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(low))
    real = fits[starts]
    starts, ends = starts[real], ends[real]
    at = np.searchsorted(owners, starts)
    wrong = np.flatnonzero(names[owners[at]] != low[starts])
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[names[owners[at[wrong]]] != low[starts[wrong]]]
    run = _RUNS.ranges(_RUNS.prefix(data), starts, ends - 1 + length)
    with np.errstate(over="ignore"):
        run = mixed(run + (owners[at] - starts).astype(np.uint64))
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, starts - offsets[text], ends - starts, owners[at] - offsets[text], low[starts], run


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A chunk as it is, or a long text in pieces that share ``length - 1`` bytes."""
    if len(offsets) > 2 or len(data) <= PIECE + length:
        yield data, offsets, 0
        return
    for at in range(0, len(data) - length + 1, PIECE):
        piece = data[at : at + PIECE + length - 1]
        yield piece, np.array([0, len(piece)]), at


def runs(docs: DataFrame, length: int) -> DataFrame:
    """``(doc_id, key, start, windows, at, owner, run)`` of all documents; ``at`` is the owner's place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_chunks(batch):
                for piece, bounds, shift in _pieces(data, offsets, length):
                    text, start, windows, at, owner, run = owned_runs(piece, bounds, length)
                    rows = pa.array(lo + text)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows),
                            batch.column(1).take(rows),
                            pa.array(start + shift),
                            pa.array(windows.astype(np.int32)),
                            pa.array(at + shift),
                            pa.array(owner.view(np.int64)),
                            pa.array(run.view(np.int64)),
                        ],
                        ["doc_id", "key", "start", "windows", "at", "owner", "run"],
                    )

    return docs.mapInArrow(scan, "doc_id long, key long, start long, windows int, at long, owner long, run long")


STRETCH_SCHEMA = "doc_id long, key long, owner long, nth int, core long, first long, least int, most int, left binary, right binary"


def stretches(docs: DataFrame, length: int) -> DataFrame:
    """Stretches of the listed runs of ``docs (doc_id, key, text, runs)``.

    Stretch ``nth`` of an owner at ``at`` has windows that start at ``first - i`` for
    ``i`` from ``least`` to ``most``, where ``first`` is ``at - nth * STRETCH``; a document's
    end may leave out some. Its core starts at ``first``; ``left`` and ``right`` are the
    bytes around it.
    """
    around = STRETCH - 1

    def fixed(rows: np.ndarray) -> pa.Array:
        ends = pa.py_buffer((np.arange(len(rows) + 1) * around).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.tobytes())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(3)
            for i, text in text_bytes(batch):
                start, windows, at, owner = (x.to_numpy() for x in listed[i].values.flatten())
                # Offsets from owner to window, and the stretches they lie in.
                low, high = (at - start - windows + 1) // STRETCH, (at - start) // STRETCH
                n = high - low + 1
                nth = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                places = np.stack([np.repeat(at, n), nth, np.repeat(owner, n)])
                # Two runs of one owner, cut apart in a long text, may share a stretch.
                places = np.unique(places, axis=1)
                order = np.argsort(places[0], kind="stable")
                yield from _cut(batch, i, text, places[:, order])

    def _cut(batch: pa.RecordBatch, i: int, text: bytes, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole, done = np.frombuffer(text, np.uint8), 0
        while done < places.shape[1]:
            upto = int(np.searchsorted(places[0], places[0, done] + PIECE, side="left"))
            at, nth, owner = places[:, done:upto]
            done, first = upto, at - nth * STRETCH
            base = max(0, int(first.min()) - around)
            data = whole[base : int(first.max()) + length + around]
            prefix = _RUNS.prefix(data)
            end = first + length - around
            core = _RUNS.ranges(prefix, first - base, end - base)
            padded = np.concatenate([np.zeros(around, np.uint8), data, np.zeros(around, np.uint8)])
            span = np.arange(around)
            left = padded[(first - base)[:, None] + span]
            right = padded[(end - base + around)[:, None] + span]
            size = len(first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0)[i].as_py()] * size, pa.int64()),
                    pa.array(np.full(size, batch.column(1)[i].as_py())),
                    pa.array(owner),
                    pa.array(nth.astype(np.int32)),
                    pa.array(core.view(np.int64)),
                    pa.array(first),
                    pa.array(np.maximum(0, around - (len(whole) - end)).astype(np.int32)),
                    pa.array(np.minimum(around, first).astype(np.int32)),
                    fixed(left),
                    fixed(right),
                ],
                ["doc_id", "key", "owner", "nth", "core", "first", "least", "most", "left", "right"],
            )

    return docs.mapInArrow(scan, STRETCH_SCHEMA)


def removed_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged spans; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` of every row.

    ``spans`` are the removed byte ranges.
    """
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    doc = ["doc_id", "key"]
    found = runs(keyed, length)
    shared = found.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("owner")
    found = written(found.join(shared, "owner", "left_semi"), "suffix-runs")

    example = F.min(F.struct("doc_id", "key", "start", "windows", "at")).alias("example")
    distinct = written(found.groupBy("owner", "run").agg(F.count(F.lit(1)).alias("n"), example), "suffix-names")
    mixed_owners = distinct.groupBy("owner").agg(F.count_if(F.col("n") == 1).alias("single")).where("single > 0")
    examples = distinct.join(mixed_owners, "owner", "left_semi").select("owner", "example.*")
    listed = examples.groupBy(*doc).agg(F.collect_list(F.struct("start", "windows", "at", "owner")).alias("runs"))
    unsettled = _with(keyed, listed, doc, "inner").select(*doc, "text", "runs")
    cut = written(stretches(unsettled, length), "suffix-stretches")

    core, around = ["owner", "nth", "core"], ["least", "most", "left", "right"]
    cores = cut.groupBy(*core).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*core)
    example = F.min(F.struct(*doc, "first")).alias("example")
    kinds = cut.join(cores, core, "left_semi").groupBy(*core, *around).agg(F.count(F.lit(1)).alias("n"), example)
    kinds = written(kinds, "suffix-kinds")
    alike = cut.join(kinds.where("n > 1").select(*core, *around), [*core, *around], "left_semi").where("least <= most")
    # Only where a single stretch and another one share a core can windows still be unsettled.
    open_cores = kinds.groupBy(*core).agg(F.count_if(F.col("n") == 1).alias("single"), F.count(F.lit(1)).alias("kinds"))
    open_cores = open_cores.where("single > 0 and kinds > 1").select(*core)
    examples = kinds.where("least <= most").join(open_cores, core, "left_semi").select("*", "example.*")
    i, full = F.col("i"), STRETCH - 1
    bytes_around = F.concat(F.substring("left", full + 1 - i, i), F.substring("right", F.lit(1), full - i))
    named = examples.select("*", F.explode(F.sequence("least", "most")).alias("i")).select(
        "core", F.xxhash64("owner", "nth", "i", bytes_around).alias("name"), "n", *doc, (F.col("first") - i).alias("start")
    )
    window = ["core", "name"]
    twice = named.groupBy(*window).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*window)
    single = named.where("n = 1").select(*window, *doc, "start").join(twice, window, "left_semi")
    whole = found.join(distinct.where("n > 1").select("owner", "run"), ["owner", "run"], "left_semi")

    spans = (
        whole.select(*doc, "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))
        .union(alike.select(*doc, F.expr("first - most"), F.expr(f"first - least + {length}")))
        .union(single.select(*doc, "start", F.col("start") + length))
    )
    spans = spans.groupBy(*doc).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return _with(keyed, spans, doc, "left").select("doc_id", "text", "starts", "ends").mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )


def _with(docs: DataFrame, lists: DataFrame, doc: list[str], how: str) -> DataFrame:
    """Bring lists to their documents; ids may be null."""
    lists = lists.withColumnsRenamed({c: f"_{c}" for c in doc})
    return docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")), how)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in text_bytes(batch, "text"):
            digest, kept, spans, at = hashlib.sha256(), 0, [], 0
            if batch.column(2)[i].is_valid:
                starts, ends = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                spans = list(zip(*(x.tolist() for x in removed_spans(starts, ends))))
            for start, end in spans:
                digest.update(text[at:start])
                kept += start - at
                at = end
            digest.update(text[at:])
            kept += len(text) - at
            rows.append((len(text), len(text) - kept, len(spans), digest.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )
