"""Token-id files by an adaptive context-mixing range coder.

A file record holds the ids of consecutive documents: a head (ids and lengths of the documents, how often each id
stands, and how often after which other), and blocks of equal length. Every block starts anew: its model and coder know
nothing of other blocks, and a checksum guards it. Three orders of context predict the next id together: order 2 by what
followed the last two ids in this block, order 1 by what follows the last one in the record, order 0 by how often ids stand
in the record. An id's part of the coding interval is the weighted sum of what all three give it. The weights start anew
in each block, and after each id they move towards the share that each order had in its part. Sums are of whole numbers
(quotients of such are rounded down), so a file decodes alike everywhere.

The ids of a block lie in strands, equal parts that are coded in step. They have weights and a coder each, and learn what
follows what together: where two write one cell at a step, that of the later strand stays. All blocks of a record are
coded in step as well, so each operation works on one id of every strand of every block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, each_row, stored
from .tokens import encoder

BLOCK_IDS = 4_096
#: Equal parts of a block that are coded in step.
STRANDS = 4
RECORD_IDS = 8_000_000
MAGIC = b"CTXMIX04"
SLOTS_BITS = 11
TOTAL_BITS = 28
CONFIDENT = 15
#: Pairs of ids that stand less often than this in a record are left to order 0.
LEAST_PAIRS = 2
#: Followers of one id that order 1 has parts for; the rarer ones beyond that are left to order 0.
MOST_FOLLOWERS = 50_000
#: A guess once sure keeps a share of at least so many of 65536, so that it can earn more again.
LEAST_SURE = 256
#: Last ids are told apart by how rarely an unknown one follows, in so many steps.
RARITIES = 8
#: Steps of all blocks that are looked up at a time.
STEPS = 32
#: Texts that are encoded together.
BATCH_BYTES = 8 << 20
#: Places for pairs by hash: so many for each.
HASHED = 16
#: Steps in which followers are looked up are by so many bits finer than there are followers.
FINER = 2
_TOP, _U16, _U48, _TOTAL = np.uint64(1 << 48), np.uint64(16), np.uint64(48), np.uint64(TOTAL_BITS)
#: Odd factors that scatter two ids over 64 bits, beyond which products wrap around.
_MIX = -7046029254386353131, -4417276706812531889
#: Numbers below 2 ** 21 that are held three in a row.
_LOW = (1 << 21) - 1


def share_bits(counts: np.ndarray) -> int:
    """Bits of the shares of order 0: 16, or 20 where a record holds more ids than 16 can tell apart well."""
    kinds = np.count_nonzero(counts)
    if kinds > 1_000_000:
        raise ValueError("more than 1,000,000 different ids in a record")
    return 16 if kinds <= 60_000 else 20


def shares(counts: np.ndarray, bits: int = 16) -> np.ndarray:
    """Counts of ids as running sums of their shares of 2 ** bits, from 0 on; each id that occurs has at least 1."""
    present, whole = np.flatnonzero(counts), 1 << bits
    out = np.zeros(len(counts), dtype=np.int64)
    rest = whole - len(present)
    out[present] = 1 + counts[present] * rest // max(1, counts.sum())
    out[present[np.argmax(counts[present])]] += whole - out.sum()
    return np.concatenate(([0], np.cumsum(out)))


def count_pairs(ids: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (last id * kinds + id) that stand often enough in a row of ids, in order, and how often."""
    kind = np.dtype(np.uint32 if kinds < 1 << 16 else np.int64)  # shorter numbers are sorted in half the time
    pairs, times = np.unique(ids[:-1].astype(kind) * kind.type(kinds) + ids[1:].astype(kind), return_counts=True)
    often = times >= LEAST_PAIRS
    pairs, times = pairs[often].astype(np.int64), times[often]
    last = pairs // kinds
    if len(pairs) and np.bincount(last).max() > MOST_FOLLOWERS:
        order = np.lexsort((-times, last))
        nth = np.arange(len(order)) - np.searchsorted(last, last)  # `last` is in order already, so it is as sorted
        few = np.sort(order[nth < MOST_FOLLOWERS])
        pairs, times = pairs[few], times[few]
    return pairs, times


class Orders:
    """Order 1 and order 0 of a record, as running sums of shares of 2 ** bits.

    The slots of a last id are its followers in order, and an end that no id has. `at` is the sum of order 1 before a
    slot, `base` that of order 0 before its id. A block's first id has the last id `kinds`, which nothing follows.
    """

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray):
        self.kinds, self.bits = len(counts), share_bits(counts)
        self.sums = shares(counts, self.bits) if counts.any() else np.zeros(self.kinds + 1, dtype=np.int64)
        self.id_of = np.repeat(np.arange(self.kinds), np.diff(self.sums))
        self.pairs = pairs
        last, whole = pairs // self.kinds, 1 << self.bits
        self.followers = np.bincount(last, minlength=self.kinds + 1)
        known = np.bincount(last, weights=times, minlength=self.kinds + 1).astype(np.int64)
        first = np.cumsum(self.followers) - self.followers
        before = np.cumsum(times) - times
        before -= before[first[last]]
        nth = np.arange(len(pairs)) - first[last]
        place = np.arange(len(pairs)) + last
        size = len(pairs) + self.kinds + 2  # the last one is never an id's
        self.at, self.id = np.full(size, whole, dtype=np.int64), np.full(size, self.kinds, dtype=np.int64)
        self.at[place] = nth + before * (whole - self.followers)[last] // known[last]
        self.id[place] = pairs % self.kinds
        self.base = self.sums[self.id]
        self.begin = first + np.arange(self.kinds + 1)
        # What is asked together is held together: of each slot its sums and id, of each id its sum and share.
        self.of_slot = (self.at << 42) | (self.base << 21) | self.id
        self.of_id = (self.sums << 21) | np.append(np.diff(self.sums), 0)
        # Pairs by hash, as most are found at once. Where two share a place, the later one has it.
        self.hash_bits = max(4, min(24, (HASHED * len(pairs)).bit_length()))
        self.hashed = np.zeros(1 << self.hash_bits, dtype=np.int32)
        self.hashed[self.places(pairs)] = np.arange(len(pairs))
        # Followers of each last id by their sums in equal steps, some more than followers: how many are below each step.
        steps = np.minimum(np.ceil(np.log2(self.followers + 1)).astype(np.int64) + (FINER if len(pairs) < 1 << 20 else 0), self.bits)
        self.step_bits, sizes = self.bits - steps, (1 << steps) + 1
        self.steps_at = np.cumsum(sizes) - sizes
        of_step = self.steps_at[last] + (self.at[place] >> self.step_bits[last]) + 1
        below = np.cumsum(np.bincount(of_step, minlength=int(sizes.sum())))
        self.below = (below + np.repeat(np.arange(self.kinds + 1), sizes)).astype(np.int32)
        rare = np.maximum(np.append(counts, 0) - known, 0) + 1 + self.followers // 50
        #: How rare ids are after each last id, by powers of two: 0 for a half and more; RARITIES where nothing follows.
        self.rarity = np.clip(16 - np.searchsorted(1 << np.arange(17), 65536 * rare // (known + rare), side="right"), 0, RARITIES - 1)
        self.rarity[self.followers == 0] = RARITIES
        self.of_last = (self.begin << 4) | self.rarity
        self.step_of_last = (self.steps_at << 5) | self.step_bits

    def places(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.hash_bits)).view(np.int64)

    def find(self, last: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each id: begin and size of its shares in order 1 (size 0 where it isn't known to follow) and in order 0."""
        ids = ids.astype(np.int64)
        pairs = last * np.int64(self.kinds) + ids
        slot = self.hashed[self.places(pairs)].astype(np.int64)
        others = np.flatnonzero(self.pairs[slot] != pairs) if len(self.pairs) else np.arange(len(pairs))
        slot[others] = np.searchsorted(self.pairs, pairs[others])
        slot += last
        of_slot, of_id = self.of_slot[slot], self.of_id[ids]
        begin = of_slot >> 42
        size = ((self.of_slot[slot + 1] >> 42) - begin) * (of_slot & _LOW == ids)
        return begin, size, of_id >> 21, of_id & _LOW

    def between(self, last: np.ndarray, weight1: np.ndarray, weight0: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots that the first one beyond each value lies between: what order 0 adds to a sum is at most all of it."""
        most, steps = (1 << self.bits) - 1, self.step_of_last[last]
        at, bits = steps >> 5, steps & 31
        # A last id without followers has no weight for order 1; its steps are empty. With a half more, no whole quotient can be missed.
        parts = 1.0 / np.maximum(weight1, 1)
        value = value + 0.5
        high = np.minimum((value * parts).astype(np.int64), most)
        value -= weight0 << self.bits
        low = np.minimum((np.maximum(value, 0) * parts).astype(np.int64), most)
        low >>= bits
        low += at
        high >>= bits
        high += at
        high += 1
        return self.below[low].astype(np.int64), self.below[high].astype(np.int64)


def quotient(part: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whole quotients of numbers below 2 ** 44; where these don't divide, the next whole number is too far off to be rounded to."""
    return (part / by).astype(np.int64)


class Mixer:
    """The predictions of all orders in each lane, and their weights, which start anew in each.

    A cell of order 2 holds the last id of its context (which tells most other contexts apart), what last followed that
    context in this lane and, in its lowest four bits, how sure that is; for decoding also the slot of the guess in order 1,
    counted from the first one of the last id. Weights are shares of 65536: that of order 2 at each level of sureness, and
    that of order 0 against order 1 at each rarity of the last id.
    """

    def __init__(self, lanes: int, orders: Orders, *, with_slots: bool = False, strands: int = 1):
        cells, levels, lane = 1 << SLOTS_BITS, CONFIDENT + 1, np.arange(lanes)
        self.orders, self.scale, self.with_slots = orders, TOTAL_BITS - orders.bits, with_slots
        self.last, self.before = np.full(lanes, orders.kinds, dtype=np.int64), np.full(lanes, orders.kinds, dtype=np.int64)
        self.cell = np.zeros(-(-lanes // strands) * cells, dtype=np.int64)
        self.first_cell, self.first_sure, self.first_rare = lane // strands * cells, lane * levels, lane * (RARITIES + 1)
        #: The most that order 2 can have: the others keep 2 parts.
        self.surest = 65536 - (2 << (16 - self.scale))
        at = np.arange(levels)
        # What was seen once follows again about once in ten times, what was seen again mostly does.
        start = np.where(at == 1, 65536 // 25, 65536 * 2 * np.maximum(at - 1, 0) // np.maximum(2 * at - 1, 1))
        self.sure = np.tile(start, lanes)
        self.least_sure = np.minimum(at * LEAST_SURE, LEAST_SURE)
        self.rare = np.tile(np.append(65536 * 3 >> (np.arange(RARITIES) + 2), 65536), lanes)
        # By level, and by 16 more where the guess was right: the next level. Below 2 the guess is given up.
        self.next_level = np.concatenate((np.maximum(at >> 1, 1), np.minimum(at + 1, CONFIDENT)))

    def predict(self, n: int) -> None:
        """The guesses of the first n lanes with their parts of the interval, and the weights of order 1 and order 0."""
        last = self.last[:n]
        self.place = ((last * _MIX[0] + self.before[:n] * _MIX[1]) >> 40) & ((1 << SLOTS_BITS) - 1)
        self.place += self.first_cell[:n]
        self.held = held = self.cell[self.place]
        self.level = (held & CONFIDENT) * (held >> 40 == last)
        self.guess = (held >> 4) & 0xFFFFF
        self.sure_at = self.first_sure[:n] + self.level
        self.now_sure = self.sure[self.sure_at]
        rest = (65536 - self.now_sure) >> (16 - self.scale)
        self.part = ((1 << self.scale) - rest) << self.orders.bits
        of_last = self.orders.of_last[last]
        self.begin = of_last >> 4
        self.rare_at = (of_last & 15) + self.first_rare[:n]
        self.now_rare = self.rare[self.rare_at]
        # At least 1 of the rest for each order; where nothing follows, `rare` stays 65536, and all of it is order 0's.
        self.weight0 = (((rest - 1) * self.now_rare) >> 16) + 1
        self.weight1 = rest - self.weight0

    def learn(self, ids: np.ndarray, size1: np.ndarray, size0: np.ndarray, slots: np.ndarray | None = None) -> None:
        """Moves each weight towards the part of these ids that its prediction gave; `size1` and `size0` are those of order 1 and order 0."""
        others = size1 + size0
        right = (self.guess == ids) & (self.level > 0)
        guessed = self.part * right
        self.rare[self.rare_at] = self.now_rare + ((quotient(size0 << 16, others) - self.now_rare) >> 5)
        moved = self.now_sure + ((quotient(guessed * self.surest, guessed + others) - self.now_sure) >> 4)
        self.sure[self.sure_at] = np.maximum(moved, self.least_sure[self.level])
        level = (self.held & CONFIDENT) + (right << 4)
        fresh = (self.last[: len(ids)] << 40) | (ids << 4)
        if slots is not None:
            fresh |= (slots - self.begin) << 24
        self.cell[self.place] = np.where(level > 1, self.held & ~CONFIDENT, fresh) | self.next_level[level]
        self.before[: len(ids)] = self.last[: len(ids)]
        self.last[: len(ids)] = ids


def split_lanes(ids: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of lanes, one for each strand of each block, and ids by step and lane (the last lane may be short)."""
    length = BLOCK_IDS // STRANDS
    lanes = -(-len(ids) // length)
    table = np.zeros(lanes * length, dtype=np.int32)
    table[: len(ids)] = ids
    return lanes, np.ascontiguousarray(table.reshape(lanes, length).T)


def steps_of(total: int, lanes: int) -> Iterator[tuple[int, int]]:
    """Each step with the number of lanes that still have an id there."""
    length = BLOCK_IDS // STRANDS
    tail = total - (lanes - 1) * length
    for t in range(length if lanes > 1 else tail):
        yield t, lanes if t < tail else lanes - 1


def carry(out: np.ndarray, at: np.ndarray) -> None:
    """Adds 1 to the words at these places, and to those before them where they are full."""
    while len(at):
        out[at] += 1
        at = at[out[at] == 0] - 1


def encode_blocks(ids: np.ndarray, orders: Orders) -> list[bytes]:
    """One independent string for each block of BLOCK_IDS ids: how many words each strand but the last has, and their range-coded words."""
    if not len(ids):
        return []
    lanes, table = split_lanes(ids)
    model = Mixer(lanes, orders, strands=STRANDS)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    room = 2 * BLOCK_IDS // STRANDS + 16
    out, first = np.zeros(lanes * room, dtype=np.uint16), np.arange(lanes) * room
    used = first.copy()
    none = np.full((1, lanes), orders.kinds)
    for t, n in steps_of(len(ids), lanes):
        if t % STEPS == 0:
            own = table[t : t + STEPS]
            last = np.concatenate((table[t - 1 : t] if t else none, own[:-1]))
            found = [x.reshape(own.shape) for x in orders.find(last.ravel(), own.ravel())]
        now = table[t, :n].astype(np.int64)
        begin1, size1, begin0, size0 = (x[t % STEPS, :n] for x in found)
        model.predict(n)
        size1, size0 = model.weight1 * size1, model.weight0 * size0
        start = model.weight1 * begin1 + model.weight0 * begin0 + model.part * (model.guess < now)
        size = size1 + size0 + model.part * (model.guess == now)
        own_low, own_width = low[:n], width[:n]
        unit = own_width >> _TOTAL
        added = unit * start.view(np.uint64)
        own_low += added
        np.multiply(unit, size.view(np.uint64), out=own_width)
        over = np.flatnonzero(own_low < added)
        if len(over):
            carry(out, used[over] - 1)
        go = np.flatnonzero(own_width < _TOP)
        while len(go):
            lows, widths, at = low[go], width[go] << _U16, used[go]
            out[at] = lows >> _U48
            used[go], low[go], width[go] = at + 1, lows << _U16, widths
            go = go[widths < _TOP]
        model.learn(now, size1, size0)
    # One more word is enough: the first that is within the interval whatever follows.
    least = low + (_TOP - np.uint64(1))
    carry(out, used[least < low] - 1)
    out[used] = least >> _U48
    sizes, out = (used + 1 - first).astype(">u2"), out.astype(">u2")
    texts = [out[a : a + n].tobytes() for a, n in zip(first.tolist(), sizes.tolist(), strict=True)]
    return [sizes[i : min(i + STRANDS, lanes) - 1].tobytes() + b"".join(texts[i : i + STRANDS]) for i in range(0, lanes, STRANDS)]


def first_beyond(orders: Orders, low: np.ndarray, high: np.ndarray, weight1: np.ndarray, weight0: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The first slots from `low` to `high` whose sums, as weighted, are beyond these values; those of `high` are."""
    out, at = low, np.flatnonzero(low < high)
    low, high, weight1, weight0, value = (x[at] for x in (low, high, weight1, weight0, value))
    while len(at):
        for _ in range(2):
            middle = (low + high) >> 1
            of_slot = orders.of_slot[middle]
            over = weight1 * (of_slot >> 42) + weight0 * ((of_slot >> 21) & _LOW) > value
            high = np.where(over, middle, high)
            middle += 1
            low = np.where(over, low, middle)
        # Where both had met, the slot of `high` is looked at again, which is beyond the value.
        out[at] = low
        left = np.flatnonzero(low < high)
        at, low, high, weight1, weight0, value = (x[left] for x in (at, low, high, weight1, weight0, value))
    return out


def find_ids(model: Mixer, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ids whose parts of the interval hold these values: id, begin and size of the part, its sizes in order 1 and order 0, slot."""
    orders, n = model.orders, len(value)
    weight1, weight0, begin = model.weight1, model.weight0, model.begin
    # The guesses of order 2; what they add is taken off the values beyond them.
    at = np.flatnonzero(model.level > 0)
    guess, own1, own0, part, values = model.guess[at], weight1[at], weight0[at], model.part[at], value[at]
    own_slots = begin[at] + ((model.held[at] >> 24) & 0xFFFF)
    of_slot, of_id = orders.of_slot[own_slots], orders.of_id[guess]
    before1 = of_slot >> 42
    guess1 = own1 * (((orders.of_slot[own_slots + 1] >> 42) - before1) * (of_slot & _LOW == guess))
    guess0 = own0 * (of_id & _LOW)
    own_start = own1 * before1 + own0 * (of_id >> 21)
    own_size = guess1 + guess0 + part
    beyond = values >= own_start + own_size
    added = np.zeros(n, dtype=np.int64)
    added[at] = part * beyond
    # The others: the first slot of their last id that begins beyond the value, and then the id before or between.
    left = value - added
    after = first_beyond(orders, *orders.between(model.last[:n], weight1, weight0, left), weight1, weight0, left)
    slots = np.maximum(after - 1, begin)
    of_slot = orders.of_slot[slots]
    ids, begin1, after1 = of_slot & _LOW, of_slot >> 42, orders.of_slot[after] >> 42
    of_id = orders.of_id[ids]
    size1, begin0, size0 = weight1 * (after1 - begin1), of_id >> 21, weight0 * (of_id & _LOW)
    start = weight1 * begin1 + weight0 * begin0
    other = np.flatnonzero((left >= start + size1 + size0) | (after == begin))
    if len(other):
        slot, one, zero = after[other], weight1[other] * after1[other], weight0[other]
        between = quotient(left[other] - one, zero)
        own = orders.id_of[np.minimum(np.maximum(between, 0), len(orders.id_of) - 1)]
        of_id = orders.of_id[own]
        ids[other], slots[other], size1[other], size0[other] = own, slot, 0, zero * (of_id & _LOW)
        start[other] = one + zero * (of_id >> 21)
    size = size1 + size0
    start += added
    hit = np.flatnonzero((values >= own_start) & ~beyond)
    if len(hit):
        at = at[hit]
        for x, own in ((ids, guess), (start, own_start), (size, own_size), (size1, guess1), (size0, guess0), (slots, own_slots)):
            x[at] = own[hit]
    return ids, start, size, size1, size0, slots


def decode_blocks(blocks: list[bytes], total: int, orders: Orders) -> np.ndarray:
    if not total:
        return np.zeros(0, dtype=np.int64)
    lanes = -(-total * STRANDS // BLOCK_IDS)
    model = Mixer(lanes, orders, with_slots=True, strands=STRANDS)
    texts = []
    for b in blocks:
        own = np.frombuffer(b, dtype=">u2")
        ends = min(STRANDS, lanes - len(texts)) - 1
        texts += np.split(own[ends:], np.cumsum(own[:ends], dtype=np.int64))
    room = max(map(len, texts)) + 8
    words = np.zeros((lanes, room), dtype=np.uint16)
    for row, text in zip(words, texts, strict=True):
        row[: len(text)] = text
    # `code` is what the string says beyond the begin of the interval.
    head = words[:, :4].astype(np.uint64)
    code = (head[:, 0] << _U48) | (head[:, 1] << np.uint64(32)) | (head[:, 2] << _U16) | head[:, 3]
    words, used, width = words.ravel(), np.arange(lanes) * room + 4, np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    table = np.zeros((BLOCK_IDS // STRANDS, lanes), dtype=np.int32)
    for t, n in steps_of(total, lanes):
        model.predict(n)
        own_code, own_width = code[:n], width[:n]
        unit = own_width >> _TOTAL
        value = np.minimum(own_code // unit, np.uint64((1 << TOTAL_BITS) - 1)).view(np.int64)
        now, start, size, size1, size0, slots = find_ids(model, value)
        own_code -= unit * start.view(np.uint64)
        np.multiply(unit, size.view(np.uint64), out=own_width)
        go = np.flatnonzero(own_width < _TOP)
        while len(go):
            widths, at = width[go] << _U16, used[go]
            code[go] = (code[go] << _U16) | words[at]
            used[go], width[go] = at + 1, widths
            go = go[widths < _TOP]
        table[t, :n] = now
        model.learn(now, size1, size0, slots)
    return table.T.ravel()[:total]


def write_record(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file record: head, then a table of the blocks' sizes and checksums, then the blocks."""
    counts = np.bincount(ids, minlength=1)
    pairs, times = count_pairs(ids, len(counts))
    times = np.minimum(times, 0xFFFFFFFF)
    blocks = encode_blocks(ids, Orders(counts if len(ids) else counts * 0, pairs, times))
    known = np.array([d is not None for d in docs], dtype=np.uint8)
    head = [
        np.array([d or 0 for d in docs], dtype="<i8").tobytes(), known.tobytes(), np.array(lengths, dtype="<u8").tobytes(), (counts if len(ids) else counts * 0).astype("<u4").tobytes(),
        planes(np.diff(pairs, prepend=0), "<u8"), planes(times, "<u4"), np.array([len(b) for b in blocks], dtype="<u4").tobytes(), np.array([zlib.crc32(b) for b in blocks], dtype="<u4").tobytes(),
    ]
    head = [zlib.compress(h, 6) for h in head]
    return MAGIC + struct.pack("<QQ8I", len(docs), len(ids), *map(len, head)) + b"".join(head) + b"".join(blocks)


def planes(numbers: np.ndarray, kind: str) -> bytes:
    """Whole numbers with equal bytes of all beside each other."""
    return numbers.astype(kind).view("u1").reshape(len(numbers), -1).T.tobytes() if len(numbers) else b""


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype="u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)


def read_record(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their lengths, and all ids; raises if a block is damaged."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file record")
    n_docs, total, *sizes = struct.unpack("<QQ8I", data[8:56])
    at, head = 56, []
    for size in sizes:
        head.append(zlib.decompress(data[at : at + size]))
        at += size
    docs, known, lengths, counts = (np.frombuffer(h, dtype=t) for h, t in zip(head, ("<i8", "u1", "<u8", "<u4"), strict=False))
    pairs, times = np.cumsum(from_planes(head[4], "<u8")), from_planes(head[5], "<u4")
    block_size, block_sum = (np.frombuffer(h, dtype="<u4") for h in head[6:])
    blocks = []
    for size, checksum in zip(block_size.tolist(), block_sum.tolist(), strict=True):
        blocks.append(data[at : at + size])
        if zlib.crc32(blocks[-1]) != checksum:
            raise ValueError(f"block {len(blocks) - 1} is damaged")
        at += size
    ids = decode_blocks(blocks, total, Orders(counts.astype(np.int64), pairs, times))
    return [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], lengths.astype(np.int64), ids


RECORD = "part int, number int, n_tokens long, data binary"
READ = "part int, number int, doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, record_ids: int = RECORD_IDS) -> DataFrame:
    """Writes all ids in ascending order of doc_id (nulls first) into the shared folder; the table of records.

    A record holds whole documents: as many as come to about `record_ids` ids, or one longer one.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode_many, int(end_id).to_bytes(4, "little")
        part, number, ids_of, raw, held = TaskContext.get().partitionId(), 0, [], [], 0

        def made():
            ids = np.concatenate(raw)
            record = write_record(ids_of, [len(x) for x in raw], ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([record], pa.binary())], names=["part", "number", "n_tokens", "data"])

        for batch in batches(found, limit=BATCH_BYTES):
            all_ids, lengths = encode([t or "" for t in batch.column("text").to_pylist()], end)
            for doc, own in zip(batch.column("doc_id").to_pylist(), np.split(all_ids, np.cumsum(lengths)[:-1]), strict=True):
                if held and held + len(own) > record_ids:
                    yield made()
                    number, ids_of, raw, held = number + 1, [], [], 0
                ids_of.append(doc), raw.append(own)
                held += len(own)
        if raw:
            yield made()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(run, RECORD), "tokens")


def read_token_files(records: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens (with the end id) and
    the checksum of its ids. Repeated rows give repeated rows; an empty table gives no rows."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for record in each_row(batch):
                part, number = record["part"], record["number"]
                docs, lengths, ids = read_record(record["data"])
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array([part] * len(docs), pa.int32()), pa.array([number] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in READ.split(", ")])

    # One short row per record is all that the running total needs.
    sizes = records.select("part", "number", "n_tokens")
    before = F.sum("n_tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("part", "number", F.coalesce(before, F.lit(0)).alias("base"))
    read = records.select("part", "number", "data").mapInArrow(run, READ)
    return read.join(base, ["part", "number"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
