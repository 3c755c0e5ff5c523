"""Token ids of a corpus as compressed, checksummed blocks in document order.

Texts are range-partitioned by ``doc_id`` and encoded in that order; each task
writes one file, and files follow each other in document order. A file is cut
into blocks of ``BLOCK_IDS`` ids, coded by :mod:`range_coder`, which start afresh,
so any block can be read alone. The format is a Parquet row per block: ``file``,
``block``, ``first_id`` (ids of the file before it), ``n_ids``, the ``payload``, the crc32 of the payload and of its ids, and
an index of the documents in it (``row`` in the file, ``doc_id``, first id, number
of ids, whether the document ends here). A block that does not match its
checksums stops the reader.

Texts are encoded word by word: a boundary between a printable character and one
blank before another is always a boundary of the tokenizer's own splitting, so
the ids of such pieces, kept in a bounded cache, are those of the whole text.

Defined results: a null text is empty and has the end id only; documents with
the same id follow each other by a hash of their text, null ids come first; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lookalike.llm import range_coder
from lookalike.llm.common import text_bytes
from lookalike.sources.scratch import scratch_path

END_ID = 2
BLOCK_IDS = 2048
#: Blocks that a task codes in lockstep; a block takes some 40 kB of memory meanwhile.
LANES = 1024
#: Pieces whose ids a worker remembers; beyond, it forgets those that are not in use.
CACHE_PIECES = 300_000
#: New pieces that are encoded in one call.
PIECES_AT_ONCE = 50

# Characters that no tokenizer rule takes for white space: printable ASCII and
# the letters of Latin-1 and Latin Extended-A/B.
_SOLID = "!-~À-ɏ"
_SPLIT = re.compile(f" (?<=[{_SOLID}] )(?=[{_SOLID}])")
#: A blank that does not part a text.
_OTHER_BLANK = re.compile(f" (?:(?<![{_SOLID}] )|(?![{_SOLID}]))")
_CLOSING = frozenset(c for c in map(chr, range(0x250)) if re.match(f"[{_SOLID}]", c))

BLOCK_SCHEMA = (
    "file int, block int, first_id long, n_ids int, ids_crc32 long, payload_crc32 long, payload binary, "
    "docs array<struct<row:long,doc_id:long,first:int,n:int,ends:boolean>>"
)


class Encoder:
    """Ids of whole texts, little-endian 16-bit, without the end id."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the file format holds ids below 65,536")
        # A special token parts a text before anything else looks at it.
        marks = (t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special)
        self.mark_id, self.mark = next(((i, t.content) for i, t in marks if not (t.lstrip or t.rstrip)), (None, None))
        self.sizes = self._token_bytes()
        self.known: dict[str, bytes] = {}

    def _token_bytes(self) -> np.ndarray | None:
        """Bytes of text behind each id, if the tokenizer works on unchanged bytes with a character for each."""
        parts, added = json.loads(self.tokenizer.to_str()), self.tokenizer.get_added_tokens_decoder()
        cut = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space"):
            return None
        if any(t.lstrip or t.rstrip or _SPLIT.search(t.content) for t in added.values()):
            return None
        sizes = np.zeros(1 << 16, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            sizes[i] = len(added[i].content.encode()) if i in added else len(token)
        return sizes

    def learn(self, keys: Iterable[str]) -> None:
        """Encode new pieces, many in one text; a few calls are much faster than many.

        Where all pieces start with a blank and a text may be parted between them, the bytes
        behind the ids tell them apart, otherwise the special token between them.
        """
        parted, plain = [], []
        for key in keys:
            (plain if self.sizes is not None and key[0] != " " and key[-1] in _CLOSING else parted).append(key)
        for i in range(0, len(plain), 100 * PIECES_AT_ONCE):
            part = plain[i : i + 100 * PIECES_AT_ONCE]
            texts = [" " + " ".join(part[j : j + PIECES_AT_ONCE]) for j in range(0, len(part), PIECES_AT_ONCE)]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), "<u2")
            reached = np.cumsum(self.sizes[ids])
            ends = np.cumsum([len(key.encode()) + 1 for key in part])
            cuts = np.searchsorted(reached, ends) + 1
            if cuts[-1] != len(ids) or not np.array_equal(reached[cuts - 1], ends):
                parted += part
                continue
            raw, cuts = ids.tobytes(), (2 * cuts).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        if parted:
            self._learn_parted(parted)

    def _learn_parted(self, keys: list[str]) -> None:
        pieces = {key: key[1:] if key[0] == " " else " " + key for key in keys}
        alone = [key for key, p in pieces.items() if self.mark is None or self.mark in p]
        joined = [key for key, p in pieces.items() if self.mark is not None and self.mark not in p]
        for i in range(0, len(joined), PIECES_AT_ONCE):
            part = joined[i : i + PIECES_AT_ONCE]
            text = self.mark.join(pieces[key] for key in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) != len(part):
                alone += part
                continue
            raw = ids.tobytes()
            for key, start, end in zip(part, [0, *(ends[:-1] + 1).tolist()], ends.tolist()):
                self.known[key] = raw[2 * start : 2 * end]
        for key, found in zip(alone, self.tokenizer.encode_batch_fast([pieces[key] for key in alone], add_special_tokens=False)):
            self.known[key] = np.array(found.ids, "<u2").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            # Pieces after the first start with their blank, which is left out; a first one without
            # such a blank gets one here that tells it from the others.
            opens = text[:1] == " " and text[1:2] in _CLOSING
            if opens:
                text = text[1:]
            keys = _SPLIT.split(text) if _OTHER_BLANK.search(text) else text.split(" ")
            if not opens:
                keys[0] = " " + keys[0]
            split.append(keys)
        wanted = set().union(*split)
        if len(self.known) > CACHE_PIECES:
            self.known = {key: self.known[key] for key in wanted if key in self.known}
        self.learn(wanted.difference(self.known))
        return [b"".join(map(self.known.__getitem__, keys)) for keys in split]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _coded(file: int, block: int, held: list[np.ndarray], docs: list, block_ids: int) -> Iterator[pa.RecordBatch]:
    """The blocks of the ids ``held``, which are taken out of it; the last block may be short.

    ``docs``: (row, doc_id, first, n, ends) of pieces.
    """
    n_ids = sum(map(len, held))
    whole, rest = divmod(n_ids, block_ids)
    sizes = np.array([block_ids] * whole + [rest] * (rest > 0))
    padded = np.zeros((len(sizes), block_ids), np.uint16)
    np.concatenate(held, out=padded.ravel()[:n_ids])
    held.clear()
    payloads = range_coder.encode(padded, sizes)
    names = ["row", "doc_id", "first", "n", "ends"]
    by_block: list[list] = [[] for _ in sizes]
    for row, doc_id, first, n, ends in docs:
        while n:
            b, at = divmod(first, block_ids)
            here = min(n, block_ids - at)
            by_block[b].append(dict(zip(names, (row, doc_id, at, here, ends and here == n))))
            first, n = first + here, n - here
    crcs = [zlib.crc32(padded[i, :size].astype("<u4").tobytes()) for i, size in enumerate(sizes)]
    columns = [
        [file] * len(sizes),
        range(block, block + len(sizes)),
        range(block * block_ids, (block + len(sizes)) * block_ids, block_ids),
        sizes.tolist(),
        crcs,
        [zlib.crc32(p) for p in payloads],
        payloads,
        by_block,
    ]
    piece = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(piece)]
    fields = ["file", "block", "first_id", "n_ids", "ids_crc32", "payload_crc32", "payload", "docs"]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], fields)


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, block_ids: int = BLOCK_IDS, lanes: int = LANES
) -> None:
    """Encode ``docs (doc_id, text)`` and write the blocks to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, block, row = _encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        group = lanes * block_ids
        held: list[np.ndarray] = []
        pieces: list = []
        size = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts: list[tuple[int, str]] = []
            waiting = 0
            for i, text in [*text_bytes(batch), (None, None)]:
                if i is not None:
                    texts.append((i, text.decode("utf-8", "replace")))
                    waiting += len(text)
                if texts and (i is None or waiting >= 1 << 20):
                    for (j, _), ids in zip(texts, encoder.encode([t for _, t in texts])):
                        ids = np.append(np.frombuffer(ids, "<u2"), np.uint16(END_ID))
                        done = 0
                        while done < len(ids):
                            part = ids[done : done + group - size]
                            done += len(part)
                            held.append(part)
                            pieces.append((row, doc_ids[j], size, len(part), done == len(ids)))
                            size += len(part)
                            if size == group:
                                yield from _coded(file, block, held, pieces, block_ids)
                                block, pieces, size = block + lanes, [], 0
                        row += 1
                    texts, waiting = [], 0
        if size:
            yield from _coded(file, block, held, pieces, block_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode blocks; one row for each piece of a document with the crc32 of its ids."""
    for batch in batches:
        blocks = batch.to_pylist()
        for lo in range(0, len(blocks), LANES):
            part = sorted(blocks[lo : lo + LANES], key=lambda b: -b["n_ids"])
            for b in part:
                if zlib.crc32(b["payload"]) != b["payload_crc32"]:
                    raise ValueError(f"file {b['file']}, block {b['block']}: the payload is damaged")
            sizes = np.array([b["n_ids"] for b in part])
            ids = range_coder.decode([b["payload"] for b in part], sizes)
            columns: list[list] = [[] for _ in range(7)]
            for b, size, own in zip(part, sizes, ids):
                raw = own[:size].astype("<u4").tobytes()
                if zlib.crc32(raw) != b["ids_crc32"]:
                    raise ValueError(f"file {b['file']}, block {b['block']}: the ids are damaged")
                for d in b["docs"]:
                    crc = zlib.crc32(raw[4 * d["first"] : 4 * (d["first"] + d["n"])])
                    at = b["first_id"] + d["first"]
                    for column, value in zip(columns, (b["file"], d["row"], d["doc_id"], at, d["n"], d["ends"], crc)):
                        column.append(value)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            names = ["file", "row", "doc_id", "at", "n", "ends", "crc"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


# Fixed value: the reflected polynomial of crc32.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, highest powers in low bits."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return product


def crc32_joined(left: int, right: int, right_bytes: int) -> int:
    """The crc32 of two byte strings one after the other, from their own."""
    factor, square = 1 << 31, 1 << 23
    while right_bytes:
        if right_bytes & 1:
            factor = _times(factor, square)
        square = _times(square, square)
        right_bytes >>= 1
    return _times(left, factor) ^ right


def _joined(frames: pd.Series, sizes: pd.Series) -> pd.Series:
    out = []
    for crcs, ns in zip(frames, sizes):
        crc = int(crcs[0])
        for c, n in zip(crcs[1:], ns[1:]):
            crc = crc32_joined(crc, int(c), 4 * int(n))
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the blocks."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so one task can sum them up.
    files = blocks.groupBy("file").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("earlier"))
    pieces = blocks.mapInArrow(
        _pieces, "file int, row long, doc_id long, at long, n long, ends boolean, crc long"
    )
    grouped = pieces.groupBy("file", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("at").alias("at"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"),
    )
    join = F.pandas_udf(_joined, "long")
    # Only documents that reach over blocks need Python.
    whole = grouped.where(F.size("parts") == 1).withColumn("ids_crc32", F.col("parts")[0]["crc"])
    reaching = grouped.where(F.size("parts") > 1).withColumn("ids_crc32", join(F.col("parts.crc"), F.col("parts.n")))
    return whole.union(reaching).join(files, "file").select(
        "doc_id", (F.col("earlier") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(
    docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS, lanes: int = LANES
) -> DataFrame:
    """Write ``docs`` to a scratch folder and read the digest of every document back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, block_ids, lanes)
    return read_token_files(docs.sparkSession, path)
