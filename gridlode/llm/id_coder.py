"""Adaptive context-mixing range coder for blocks of token ids, for use inside tasks.

A block is coded by itself: all models start anew. Its head lists its distinct ids, which are numbered as they ascend,
and how often each occurs. Order 2 (the last two ids) and, where it knows nothing, order 1 (the last id) predict one of
them. The chance that the prediction holds is mixed, in the logistic domain and with weights that are learned as the
block goes, from the confidence of order 2, that of order 1 and the count of the predicted id (order 0); a range coder
takes the answer. Where it doesn't hold, the id is coded by order 0, the counts in the head.

Many blocks are coded in step, one id of each at a time, as numpy vectors; all arithmetic is in integers, or in floats
that hold them exactly, so that a block gives the same bytes whichever blocks stand beside it.

    block: length of the head (4), head by zlib, words of the range coder (2 each). Little-endian.
    head: kinds (1): 1 for each of six columns that isn't all 0; those columns, a byte per distinct id each: differences of
    ids (four columns, the lowest byte first), counts less one (two)
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, at most; numbers of ids and their confidence fit 16 bits.
BLOCK_IDS = 2048
GROUP = 32
GROUPS = BLOCK_IDS // GROUP  # ids of a block in groups: places of the table of order 1
CONTEXTS = 1024  # order-2 slots of a block
SURE = 15  # the highest confidence

#: Bits of the coder's interval, of a word, and the least interval between ids.
WIDTH, WORD = 48, 16
FULL, LEAST = 1 << WIDTH, 1 << (WIDTH - WORD)
SHARES = (1 << 12) - 1
PLACE = 12  # bits of a place in a block

#: p of ln(p / (1 - p)) in 256ths, as 65536ths.
SQUASH = np.clip(np.round(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 32, 65504).astype(np.int64)


def _stretched(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32)


_n = np.arange(16)
#: What confidences say: of order 2, without and with order 1 of the same mind; of order 1, also where order 2 knows another id.
TWO = _stretched(np.concatenate([(_n + 0.1) / (_n + 1.8), (_n + 0.4) / (_n + 1.5)]))
TWO[[0, 16]] = 0
ONE = _stretched(np.concatenate([(_n + 0.1) / (_n + 3.0), (_n + 0.4) / (_n + 1.6)]))
ONE[[0, 16]] = 0
#: What the logarithm of the predicted id's count says.
OFTEN = _stretched(np.clip(0.03 * 1.35**_n, 0, 0.9))
#: What is added to confidences of predictions that didn't hold, and of those that did.
CHANGE = np.concatenate([-((_n + 1) >> 1), _n < SURE]).astype(np.uint16)
WEIGHTS = np.array([[0.5], [0.35], [0.4]])
RATE = 12


class Words:
    """The range coders of all blocks, as they write."""

    def __init__(self, lanes: int, places: int):
        self.room = 3 * places // 2 + 8  # an id takes 22 bits and a fraction at most
        self.out = np.zeros(lanes * self.room, np.int32)
        self.begin = np.arange(lanes) * self.room
        self.at = self.begin.copy()

    def settle(self, n: int, low: np.ndarray, size: np.ndarray) -> None:
        """Intervals that are short get a word longer. Words hold their carries until close."""
        at = self.at[:n]
        word = low >> (WIDTH - WORD)
        self.out[at] = word  # stays only where the place moves on
        short = size < LEAST
        by = short * WORD
        at += short
        word *= short
        word <<= WIDTH - WORD
        low -= word
        low <<= by
        size <<= by
        if size.min() < LEAST:
            again = np.flatnonzero(size < LEAST)
            self.out[at[again]] = low[again] >> (WIDTH - WORD)
            at[again] += 1
            low[again] = (low[again] & (LEAST - 1)) << WORD
            size[again] <<= WORD

    def close(self, low: np.ndarray) -> list[bytes]:
        """The words of each block; one more, after which the interval holds zeros, ends them."""
        self.out[self.at] = (low + LEAST - 1) >> (WIDTH - WORD)
        used = self.at + 1 - self.begin
        out = self.out.reshape(len(low), -1)[:, : int(used.max())]
        out[np.arange(out.shape[1]) >= used[:, None]] = 0
        for k in range(out.shape[1] - 1, 0, -1):
            out[:, k - 1] += out[:, k] >> WORD
        rows = out.astype("<u2")
        return [r[:k].tobytes() for r, k in zip(rows, used.tolist())]


def _read(words, at, code, size) -> None:
    short = size < LEAST
    by = short * WORD
    code <<= by
    code |= words.take(at) * short
    size <<= by
    at += short
    if size.min() < LEAST:
        again = np.flatnonzero(size < LEAST)
        code[again] = code[again] << WORD | words[at[again]]
        size[again] <<= WORD
        at[again] += 1


def _code(sizes: np.ndarray, counts: np.ndarray, distinct: np.ndarray, numbers: np.ndarray | None, words) -> tuple[np.ndarray, list[bytes] | None]:
    """sizes: ids of each block, not rising. counts: of the distinct ids of all blocks, end to end.

    numbers (places x blocks) are written, or, if None, read from words: all words, and where each block's begin.
    """
    lanes, places = len(sizes), int(sizes[0])
    reads = numbers is None
    lane = np.arange(lanes)
    size, low = np.full(lanes, FULL - 1), np.zeros(lanes, np.int64)  # reading, low is the code's distance from it
    if reads:
        numbers = np.zeros((places, lanes), np.uint16)
        words, at = words
        for _ in range(WIDTH // WORD):
            low = low << WORD | words.take(at)
            at += 1
        offset = np.cumsum(sizes) - sizes
    else:
        coder = Words(lanes, places)
    # of the distinct ids of all blocks: bits of their counts, those before in their block, their counts
    head = np.cumsum(distinct) - distinct
    if reads:  # the number + 1 that has a share of order 0
        share_of = np.repeat((np.arange(len(counts)) - np.repeat(head - 1, distinct)).astype(np.uint16), counts)
    below = np.cumsum(counts) - counts
    below -= np.repeat(below[head], distinct)
    of0 = (np.frexp(counts)[1].astype(np.int64) << 24 | below << 12 | counts).astype(np.int32)
    # of order 1, then order 2: number + 1 of the predicted id, and its confidence in the last four bits
    known = np.zeros(len(counts) + lanes + lanes * CONTEXTS, np.uint16)
    base1, base2 = head + lane, len(counts) + lanes + lane * CONTEXTS
    slots, said = np.empty((2, lanes), np.int64), np.empty((3, lanes), np.int32)
    weight = np.repeat((WEIGHTS * 16384).astype(np.int32), lanes, axis=1)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    active = np.searchsorted(-sizes, -np.arange(places), side="left")
    head1 = head - 1
    for t in range(places):
        n = int(active[t])
        if n < len(last):
            last, before, base1, base2, head1 = last[:n], before[:n], base1[:n], base2[:n], head1[:n]
            size = size[:n]
            if reads:
                low, at, offset = low[:n], at[:n], offset[:n]
            weight = np.ascontiguousarray(weight[:, :n])
            slots, said = np.empty((2, n), np.int64), np.empty((3, n), np.int32)
        total = places if sizes[n - 1] == places else sizes[:n]
        slot1, slot2 = slots
        np.add(base1, last, out=slot1)
        np.multiply(before, 1031, out=slot2)
        slot2 += last
        slot2 &= CONTEXTS - 1
        slot2 += base2
        entry = known.take(slots)
        sure = entry & 15
        named = entry >> 4
        n1, n2 = sure
        c1, c2 = named
        guess = c1 * (n2 == 0)  # number + 1, 0 for none
        guess += c2
        agree = (c1 == guess).view(np.uint8) << 4
        TWO.take(n2 | agree, out=said[0], mode="clip")
        ONE.take(n1 | agree, out=said[1], mode="clip")
        OFTEN.take(of0.take(head1 + guess, mode="clip") >> 24, out=said[2], mode="clip")
        mixed, more, most = weight * said
        mixed += more
        mixed += most
        mixed >>= 14
        mixed += 2047
        chance = SQUASH.take(mixed, mode="clip")
        chance *= guess > 0
        cut = size >> 16
        cut *= chance
        if reads:
            hit = low < cut
        else:
            number = numbers[t, :n]
            hit = number == guess
        # order 0 where it doesn't hold
        rest = size - cut
        unit = rest // total
        if reads:
            rest = low - cut
            share = (rest / unit).astype(np.int64)
            share &= SHARES  # of those that hit, anything
            np.minimum(share, total - 1, out=share)
            share += offset
            number = share_of.take(share)
        which = head1 + number
        c = of0.take(which)
        own = unit * (c & 4095)
        c = unit * (c >> 12 & 4095)
        size = np.where(hit, cut, own)
        if reads:
            rest -= c
            low = np.where(hit, low, rest)
            np.copyto(number, guess, where=hit)
            _read(words, at, low, size)
            numbers[t, :n] = number
        else:
            c += cut
            c *= ~hit
            low[:n] += c
            coder.settle(n, low[:n], size)
        error = chance.astype(np.int32)
        error >>= 2
        said *= (hit.astype(np.int32) << 14) - error
        said >>= RATE
        weight += said
        # a prediction that held is surer, one that didn't half as sure, or gives way
        held = named == number
        entry += CHANGE.take(held.view(np.uint8) << 4 | sure)
        gone = sure <= 1
        gone &= ~held
        np.copyto(entry, number << 4 | 1, where=gone)
        known[slots] = entry
        before, last = last, number.astype(np.int64)
    return numbers, None if reads else coder.close(low)


def _numbered(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """numbered of a few blocks, the numbers as blocks x places."""
    blocks, places = ids.shape
    kind = np.uint32 if int(ids.max()) >> (32 - PLACE) == 0 else np.uint64
    keys = ids.astype(kind) << kind(PLACE) | np.arange(places, dtype=kind)
    inside = None
    if size[-1] < places:
        inside = np.arange(places) < size[:, None]
        keys[~inside] = ~kind(0)
    keys.sort(axis=1)
    at = (keys & kind((1 << PLACE) - 1)).astype(np.int64)
    keys >>= kind(PLACE)
    lead = np.ones(keys.shape, bool)
    np.not_equal(keys[:, 1:], keys[:, :-1], out=lead[:, 1:])
    at += (np.arange(blocks) * places)[:, None]
    out = np.zeros((blocks, places), np.uint16)
    if inside is None:
        out.reshape(-1)[at] = np.cumsum(lead, axis=1, dtype=np.uint16)
    else:
        lead &= inside
        out.reshape(-1)[at[inside]] = np.cumsum(lead, axis=1, dtype=np.uint16)[inside]
    firsts = np.flatnonzero(lead)
    row = firsts // places
    end = np.append(firsts[1:], 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = np.arange(blocks) * places + size
    return keys.reshape(-1)[firsts].astype(np.int64), end - firsts, np.bincount(row, minlength=blocks), out


def numbered(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (blocks x places) -> distinct ids of all blocks, ascending in each; their counts; how many each block has; numbers + 1 (places x blocks).

    So few blocks at a time that they stay in a processor's cache.
    """
    found = [_numbered(ids[i : i + 32], sizes[i : i + 32]) for i in range(0, len(ids), 32)]
    distinct, counts, many, numbers = map(np.concatenate, zip(*found))
    return distinct, counts, many, np.ascontiguousarray(numbers.T)


def _heads(ids: np.ndarray, counts: np.ndarray, distinct: np.ndarray) -> list[bytes]:
    """The head of each block."""
    ends = np.cumsum(distinct)
    begins = ends - distinct
    steps = np.diff(ids, prepend=ids[:1])
    steps[begins] = ids[begins]
    columns = np.concatenate([steps.astype("<u4").view(np.uint8).reshape(-1, 4), (counts - 1).astype("<u2").view(np.uint8).reshape(-1, 2)], axis=1)
    kinds = np.add.reduceat(columns > 0, begins, axis=0, dtype=np.int64) > 0
    columns = [c.tobytes() for c in columns.T]
    out = []
    for i, j, kind, own in zip(begins.tolist(), ends.tolist(), np.packbits(kinds, axis=1, bitorder="little").tobytes(), kinds.tolist()):
        out.append(zlib.compress(bytes([kind]) + b"".join([c[i:j] for c, used in zip(columns, own) if used]), 1))
    return out


def _of_heads(heads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of all blocks, their counts, and how many each block has."""
    heads = list(map(zlib.decompress, heads))
    used = np.unpackbits(np.array([h[0] for h in heads], np.uint8)[:, None], axis=1, bitorder="little")[:, :6].astype(np.int64)
    lengths = np.array(list(map(len, heads)), np.int64)
    distinct = np.maximum((lengths - 1) // np.maximum(used.sum(axis=1), 1), 1)
    data = np.frombuffer(b"".join(heads) + b"\0", np.uint8)
    begins = np.cumsum(distinct) - distinct
    # where each block's column begins, less where its distinct ids do
    at = (np.cumsum(lengths) - lengths + 1)[:, None] + (np.cumsum(used, axis=1) - used) * distinct[:, None] - begins[:, None]
    place = np.arange(int(distinct.sum()))
    values = [np.zeros(len(place), np.int64) for _ in range(2)]
    for k, (to, shift) in enumerate([(0, 0), (0, 8), (0, 16), (0, 24), (1, 0), (1, 8)]):
        if used[:, k].any():
            column = data.take(place + np.repeat(at[:, k], distinct), mode="clip").astype(np.int64)
            values[to] += (column if used[:, k].all() else column * np.repeat(used[:, k], distinct)) << shift
    ids = np.cumsum(values[0])
    before = ids[begins] - values[0][begins]
    return ids - np.repeat(before, distinct), values[1] + 1, distinct


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of each block of 1 to BLOCK_IDS ids (unsigned, 32 bits)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    if not len(order):
        return []
    ids = np.zeros((len(order), int(sizes[0])), np.uint32)
    for lane, i in enumerate(order):
        ids[lane, : sizes[lane]] = blocks[i]
    ids, counts, distinct, numbers = numbered(ids, sizes)
    words = _code(sizes, counts, distinct, numbers, None)[1]
    out = [b""] * len(blocks)
    for i, head, own in zip(order, _heads(ids, counts, distinct), words):
        out[i] = struct.pack("<I", len(head)) + head + own
    return out


def decode(packed: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block, from its bytes and its number of ids."""
    order = sorted(range(len(packed)), key=lambda i: -sizes[i])
    if not order:
        return []
    begins = [4 + struct.unpack_from("<I", packed[i])[0] for i in order]
    ids, counts, distinct = _of_heads([packed[i][4:k] for i, k in zip(order, begins)])
    words = [packed[i][k:] + bytes(6) for i, k in zip(order, begins)]
    at = np.cumsum([0, *map(len, words)])[:-1] // 2
    lengths = np.array([sizes[i] for i in order], np.int64)
    numbers = _code(lengths, counts, distinct, None, (np.frombuffer(b"".join(words), "<u2"), at))[0]
    head = (np.cumsum(distinct) - distinct - 1)[:, None]
    ids = ids.astype(np.uint32)
    out = [ids[:0]] * len(packed)
    for begin in range(0, len(order), 32):  # they stay in a processor's cache
        rows = ids.take(numbers[:, begin : begin + 32].T + head[begin : begin + 32], mode="clip")
        for row, i in zip(rows, order[begin : begin + 32]):
            out[i] = row[: sizes[i]]
    return out
