"""A context-mixing range coder for ids below 65,536, many blocks in lockstep.

The id that last followed the two ids before (order 2) and the one that last
followed the id before (order 1) are predictions, each with a confidence. A
binary decision says whether the order-2 prediction holds; if both predictions
agree, its probability is a mix of what both orders' hit rates say, with weights
that follow which of them was right. A second decision tests the order-1
prediction. An id that neither foretells is coded by order 0: four nibbles, high
ones first, each with adaptive cumulative frequencies in the context of the
nibbles before. All decisions drive one carry-less range coder.

Every block starts from the same state, so blocks are coded independently.
Coding is sequential inside a block; numpy works on the same place of many
blocks at a time. All arithmetic is in integers, so decoding repeats encoding
exactly on any machine.
"""

from __future__ import annotations

import numpy as np

#: Probabilities and cumulative frequencies end at 2 ** SCALE.
SCALE = 14
ONE = 1 << SCALE
#: Slots of the order-1 and order-2 predictions of a block; contexts are hashed to them.
SLOTS = 1024
#: Rows of nibble frequencies of a block: 1 + 16 + 256 nodes, and hashed ones below.
NODES = 768
EXACT_NODES = 273
RATE = 4
HIT_RATE = 5
WEIGHT_ONE = 256

TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_U = np.uint64
_FLAGS = np.uint64(0x0101010101010101)
#: A row as one item, which numpy moves faster than 16.
_ROW = np.dtype("V32")

# Where a row moves to when a nibble is seen: all of the scale at that nibble,
# but one unit for each other one.
_AIM = np.array([[x if x <= seen else ONE - 16 + x for x in range(16)] for seen in range(16)], np.int16)


class _Range:
    """Interval of every lane."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _U(2**64 - 1))

    def narrow(self, at: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        part = self.range[at] >> _U(SCALE)
        low = self.low[at] + start.astype(np.uint64) * part
        range_ = part * width.astype(np.uint64)
        self.low[at], self.range[at] = low, range_
        due = np.flatnonzero(((low ^ (low + range_)) < TOP) | (range_ < BOTTOM))
        while len(due):
            lanes = at[due]
            low, range_ = self.low[lanes], self.range[lanes]
            # A range that straddles a word boundary and is too small is cut at the boundary.
            range_ = np.where((low ^ (low + range_)) >= TOP, (~low + _U(1)) & (BOTTOM - _U(1)), range_)
            self.move(lanes, low)
            low, range_ = low << _U(16), range_ << _U(16)
            self.low[lanes], self.range[lanes] = low, range_
            due = due[((low ^ (low + range_)) < TOP) | (range_ < BOTTOM)]


class _Writer(_Range):
    def __init__(self, ids: np.ndarray):
        super().__init__(len(ids))
        # An id takes 14 bits a nibble and a decision at most. Lanes fill rows at about the
        # same pace, so the rows that no lane reaches never take memory.
        self.words = np.zeros((6 * ids.shape[1] + 8, len(ids)), np.uint16)
        self.used = np.zeros(len(ids), np.int64)
        self.ids = np.ascontiguousarray(ids.T, np.uint16)

    def move(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.words[self.used[lanes], lanes] = (low >> _U(48)).astype(np.uint16)
        self.used[lanes] += 1

    def decide(self, at: np.ndarray, chance: np.ndarray, guess: np.ndarray, step: int) -> np.ndarray:
        held = self.ids[step][at] == guess
        self.narrow(at, np.where(held, 0, chance), np.where(held, chance, ONE - chance))
        return held

    def nibble(self, at: np.ndarray, rows: np.ndarray, shift: int, step: int) -> np.ndarray:
        seen = (self.ids[step][at] >> shift) & 15
        self.narrow(at, *_bounds(rows, seen))
        return seen

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for _ in range(4):
            self.move(lanes, self.low)
            self.low <<= _U(16)
        return [self.words[: self.used[i], i].astype("<u2").tobytes() for i in lanes]


class _Reader(_Range):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        # Words beyond a block's end are only read from damaged blocks.
        self.words = np.zeros((max(map(len, blocks), default=0) // 2 + 8, len(blocks)), np.uint16)
        for i, block in enumerate(blocks):
            self.words[: len(block) // 2, i] = np.frombuffer(block[: len(block) // 2 * 2], "<u2")
        w = self.words[:4].astype(np.uint64)
        self.code = (w[0] << _U(48)) | (w[1] << _U(32)) | (w[2] << _U(16)) | w[3]
        self.used = np.full(len(blocks), 4)

    def move(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = np.minimum(self.used[lanes], len(self.words) - 1)
        self.code[lanes] = (self.code[lanes] << _U(16)) | self.words[at, lanes]
        self.used[lanes] += 1

    def value(self, at: np.ndarray) -> np.ndarray:
        part = self.range[at] >> _U(SCALE)
        return np.minimum((self.code[at] - self.low[at]) // part, _U(ONE - 1)).astype(np.int32)

    def decide(self, at: np.ndarray, chance: np.ndarray, guess: np.ndarray, step: int) -> np.ndarray:
        held = self.value(at) < chance
        self.narrow(at, np.where(held, 0, chance), np.where(held, chance, ONE - chance))
        return held

    def nibble(self, at: np.ndarray, rows: np.ndarray, shift: int, step: int) -> np.ndarray:
        # Eight flags lie in a word; a product adds them up in its top byte.
        below = (rows <= self.value(at).astype(np.int16)[:, None]).view(np.uint64)
        seen = (((below[:, 0] + below[:, 1]) * _FLAGS) >> _U(56)).astype(np.int64) - 1
        self.narrow(at, *_bounds(rows, seen))
        return seen


def _bounds(rows: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat, at = rows.ravel(), np.arange(len(rows)) * 16 + seen
    low = flat[at].astype(np.int32)
    high = np.where(seen == 15, ONE, flat[np.minimum(at + 1, len(flat) - 1)])
    return low, high - low


def _run(coder: _Writer | _Reader, sizes: np.ndarray) -> np.ndarray:
    """Code ``sizes[i]`` ids of lane ``i``; sizes must not grow. Returns the ids by step."""
    lanes, longest = len(sizes), int(sizes.max(initial=0))
    all_lanes = np.arange(lanes)
    table1, table2 = (np.zeros(lanes * SLOTS, np.int32) for _ in range(2))
    nodes = np.tile((np.arange(16) << (SCALE - 4)).astype(np.int16), (lanes * NODES, 1))
    row_items = nodes.view(_ROW).ravel()
    rates1, rates2 = (np.full(lanes * 4, ONE // 8, np.int32) for _ in range(2))
    weight = np.full(lanes, WEIGHT_ONE // 2, np.int32)
    out = np.zeros((longest + 2, lanes), np.uint16)
    for step in range(longest):
        n = int(np.searchsorted(-sizes, -step, side="left"))
        at = all_lanes[:n]
        before2, before = out[step : step + 2, :n].astype(np.int32)
        slot1 = at * SLOTS + ((before * 40_503) >> 4) % SLOTS
        slot2 = at * SLOTS + ((before * 31_337 + before2 * 17_471) >> 3) % SLOTS
        known1, known2 = table1[slot1], table2[slot2]
        guess1, guess2 = known1 >> 2, known2 >> 2
        rate1_at, rate2_at = at * 4 + (known1 & 3), at * 4 + (known2 & 3)
        rate1, rate2, w = rates1[rate1_at], rates2[rate2_at], weight[:n]
        agree = guess1 == guess2
        chance = np.where(agree, (rate2 * w + rate1 * (WEIGHT_ONE - w)) >> 8, rate2)
        held = coder.decide(at, np.clip(chance, 32, ONE - 32), guess2, step)
        rates2[rate2_at] = rate2 + (((held.astype(np.int32) << SCALE) - rate2) >> HIT_RATE)
        better = np.where(held == (rate2 > rate1), 4, -4)
        weight[:n] = np.clip(w + np.where(agree, better, 0), 16, WEIGHT_ONE - 16)
        ids = np.where(held, guess2, 0)
        held1 = held & agree
        second = np.flatnonzero(~held & ~agree)
        if len(second):
            held1[second] = coder.decide(second, np.clip(rate1[second], 32, ONE - 32), guess1[second], step)
            ids[second] = np.where(held1[second], guess1[second], 0)
        tested = agree | ~held
        moved = rate1 + (((held1.astype(np.int32) << SCALE) - rate1) >> HIT_RATE)
        rates1[rate1_at] = np.where(tested, moved, rate1)
        rest = np.flatnonzero(~held & ~held1)
        if len(rest):
            so_far = np.ones(len(rest), np.int64)
            for shift in (12, 8, 4, 0):
                if shift:
                    # Nodes 0; 1 to 16; 17 to 272.
                    node = so_far - {12: 1, 8: 15, 4: 239}[shift]
                else:
                    node = EXACT_NODES + (so_far * 40_503 >> 4) % (NODES - EXACT_NODES)
                node = node + rest * NODES
                rows = nodes.take(node, axis=0, mode="clip")
                seen = coder.nibble(rest, rows, shift, step)
                row_items[node] = (rows + ((_AIM.take(seen, axis=0) - rows) >> RATE)).view(_ROW).ravel()
                so_far = so_far * 16 + seen
            ids[rest] = so_far & 0xFFFF
        for table, slot, known, guess in ((table1, slot1, known1, guess1), (table2, slot2, known2, guess2)):
            sure = known & 3
            right = guess == ids
            table[slot] = np.where(right, known + (sure < 3), np.where(sure > 0, known - 1, ids << 2))
        out[step + 2, :n] = ids
    return out[2:]


def encode(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Code the rows of ``ids (lanes, longest)``; ``sizes`` must not grow from row to row."""
    coder = _Writer(ids)
    with np.errstate(over="ignore"):
        _run(coder, sizes)
        return coder.finish()


def decode(blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The rows that ``encode`` got; ``sizes`` must not grow from row to row."""
    with np.errstate(over="ignore"):
        return _run(_Reader(blocks), sizes).T
