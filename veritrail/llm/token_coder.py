"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks that share nothing: each starts from an empty model and carries the
CRC-32 of its ids. In a block, the ids last seen after the last two ids (order 2), after the
last id (order 1) and the prevailing id (order 0) are predictions with confidences. What is
coded is which prediction holds, or that none does; its probabilities mix three adaptive
distributions, one for each order, with weights that follow how well each did. Of an id that
no prediction gave, the upper part is coded by an adaptive order-0 distribution and the lower
byte, whose distribution is flat, is written as it is. All arithmetic is on integers, so a
file decodes alike everywhere.

The model is refreshed at the ends of PERIODS. Many blocks are coded side by side, one numpy
lane each: a lane's bytes don't depend on the other lanes. A step is a row of numpy calls over
all lanes into arrays that are made once; what doesn't depend on the step before (an encoder's
distributions, the counts that the model learns from) is done for a period at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 2048
SLOTS = 1024
#: Where the model is refreshed: soon at first, when it knows little.
PERIODS = (32, 96, 192, 320, 512, 768, 1024, 1344, 1696)
TOTAL_BITS = 12
UPPER_BITS = 10
#: One id is one step of the coder: outcome and upper part share its range.
WHOLE_BITS = TOTAL_BITS + UPPER_BITS
LOWEST = 1 << 31  # a range below this takes in 32 more bits
MAGIC = b"VTTK3\n"


# numpy takes arrays of no dimension much faster than Python's integers
ONE, TWO, THREE, FOUR, TAKEN, UPPER, WHOLE, LEAST = (np.array(n) for n in (1, 2, 3, 4, 32, UPPER_BITS, WHOLE_BITS, LOWEST))
#: By id: its place among the slots, what it adds to that of the next id, and how it is kept with confidence 1.
_ID = np.arange(1 << 16, dtype=np.int64)
NOW, BEFORE, KNOWN = (_ID * 40503 >> 5) & (SLOTS - 1), (_ID * 30011 >> 3) & (SLOTS - 1), _ID << 2 | 1


def periods(length: int) -> list[tuple[int, int]]:
    cut = [0, *(p for p in PERIODS if p < length), length]
    return list(zip(cut, cut[1:]))


class Model:
    def __init__(self, lanes: int, vocabulary: int):
        self.lanes = lanes
        self.lane, self.wide = np.arange(lanes, dtype=np.int64), np.array(lanes)
        self.seen = np.zeros(lanes * 2 * SLOTS, np.int32)  # id << 2 | confidence: by the last two ids, then by the last one
        self.common, self.votes = np.zeros((1, lanes), np.int64), np.zeros((1, lanes), np.int64)
        self.base = self.lane * (2 * SLOTS) + np.array([[0], [SLOTS]])
        self.at = self.base.copy()
        self.hash, self.before, self.known = (np.zeros(lanes, np.int64) for _ in range(3))
        self.found32, self.new32 = np.zeros((2, lanes), np.int32), np.zeros((2, lanes), np.int32)
        self.found, self.sure = np.zeros((2, lanes), np.int64), np.zeros((2, lanes), np.int64)
        self.ids = np.zeros((4, lanes), np.int64)  # by outcome: given by order 2, order 1, order 0, and by none
        self.given = self.ids[:2]
        self.match = np.zeros((2, lanes), bool)
        self.count = np.zeros((lanes, 4, 4, 4), np.int64)  # by confidences of order 2 and 1, by outcome
        self.weight = np.full((lanes, 3), 21845, np.int64)
        self.parts: tuple | None = None
        self.uppers = -(-vocabulary // 256)
        prior = 512 // (np.arange(self.uppers) + 8)  # public vocabularies begin with the frequent ids
        self.upper_count = np.tile(prior.astype(np.int64), (lanes, 1))
        self._mix(None, 1)
        self._upper()

    def learn(self, places: np.ndarray, ids: np.ndarray) -> None:
        """Refresh the model by a period's outcomes, (steps, lanes) places of them in the counts, and its ids."""
        fresh = np.bincount(places.ravel(), minlength=self.lanes * 64).reshape(-1, 4, 4, 4)
        rest = np.flatnonzero((places & 3).ravel() == 3)
        cells = (self.lane * self.uppers + (ids >> 8)).ravel()[rest]
        self.upper_count += np.bincount(cells, minlength=self.lanes * self.uppers).reshape(self.lanes, -1)
        self._mix(fresh, len(ids))
        self._upper()
        self._prevail(ids)

    def _prevail(self, ids: np.ndarray) -> None:
        """The prevailing id, by votes: of two candidates the stronger one stays, with what it has more."""
        a, n = np.concatenate((self.common, ids)), np.concatenate((self.votes, np.ones_like(ids)))
        while len(a) > 1:
            half = len(a) // 2
            x, y, v, w = a[:half], a[half : 2 * half], n[:half], n[half : 2 * half]
            one, many = np.where(v >= w, x, y), np.where(x == y, v + w, np.abs(v - w))
            a, n = np.concatenate((one, a[2 * half :])), np.concatenate((many, n[2 * half :]))
        self.common, self.votes = a, n
        self.ids[2] = a[0]

    def _mix(self, fresh: np.ndarray | None, steps: int) -> None:
        """Refresh the distributions of the three orders, their weights and the mixture."""
        if fresh is not None:
            two, one, zero = self.parts
            did = np.stack([(fresh.sum(2) * two).sum((1, 2)), (fresh.sum(1) * one).sum((1, 2)), (fresh.sum((1, 2)) * zero).sum(1)], 1)
            weight = self.weight // 2 + did // steps + 512
            self.weight = weight * 65536 // weight.sum(1, keepdims=True)
            self.count += fresh
        parts = []
        for c in (self.count.sum(2), self.count.sum(1), self.count.sum((1, 2))):
            c = c * 4 + np.array([1, 1, 1, 5])
            parts.append((c << 16) // c.sum(-1, keepdims=True))
        self.parts = tuple(parts)
        w = self.weight[:, :, None, None, None]
        mixed = (w[:, 0] * parts[0][:, :, None] + w[:, 1] * parts[1][:, None] + w[:, 2] * parts[2][:, None, None]) >> 16
        size = 1 << TOTAL_BITS
        freq = 1 + ((mixed * (size - 4)) >> 16)
        freq[..., 3] += size - freq.sum(-1)
        low = np.cumsum(freq, -1) - freq
        self.part, self.begin = freq.reshape(-1), (low << UPPER_BITS).reshape(-1)
        self.edges = [np.ascontiguousarray(low[..., i]).reshape(-1) for i in (1, 2, 3)]

    def _upper(self) -> None:
        """Shares of the upper parts, and where they begin; in the last cell, for what was predicted, all is one share."""
        size = 1 << UPPER_BITS
        n = self.upper_count.sum(1, keepdims=True)
        freq = 1 + self.upper_count * (size - self.uppers) // n
        freq[:, -1] += size - freq.sum(1)
        self.upper_share = np.append(freq, size)
        self.upper_begin = np.append(np.cumsum(freq, 1) - freq, 0)

    def predict(self) -> None:
        """What orders 2 and 1 have seen: found, (2, lanes)."""
        self.seen.take(self.at, out=self.found32, mode="clip")
        self.found[:] = self.found32
        np.bitwise_and(self.found, THREE, out=self.sure)
        np.right_shift(self.found, TWO, out=self.given)

    def update(self, ids: np.ndarray) -> None:
        np.equal(self.given, ids, out=self.match)
        np.minimum(self.sure, TWO, out=self.found)
        np.multiply(self.found, self.match, out=self.found)
        KNOWN.take(ids, out=self.known, mode="clip")
        np.add(self.found, self.known, out=self.found)
        self.new32[:] = self.found
        self.seen[self.at] = self.new32
        NOW.take(ids, out=self.hash, mode="clip")
        np.bitwise_xor(self.hash, self.before, out=self.at[0])
        self.at[1] = self.hash
        np.add(self.at, self.base, out=self.at)
        BEFORE.take(ids, out=self.before, mode="clip")


def encode(ids: np.ndarray, vocabulary: int) -> list[tuple[bytes, bytes]]:
    """ids: (blocks, BLOCK). The payload of every block: digits of the range coder, and lower bytes."""
    lanes, length = ids.shape
    m = Model(lanes, vocabulary)
    columns = np.ascontiguousarray(ids.T)
    low = np.zeros(lanes, np.uint64)
    width = np.full(lanes, (1 << 63) - 1, np.uint64)
    unit, added = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    size = length * WHOLE_BITS // 32 + 4
    out = np.zeros((lanes, size), np.uint64)
    flat = out.reshape(-1)
    place = m.lane * size
    row = m.lane * m.uppers
    small = np.zeros(lanes, bool)
    bits, kept, taken, mask, lowest = (np.array(n, np.uint64) for n in (WHOLE_BITS, 31, 32, LOWEST - 1, LOWEST))
    is_rest = np.zeros((length, lanes), bool)
    for a, b in periods(length):
        now = columns[a:b].astype(np.int64)
        found = np.empty((b - a, 2, lanes), np.int64)
        for t in range(b - a):
            m.predict()
            found[t] = m.found
            m.update(now[t])
        two, one = found[:, 0], found[:, 1]
        outcome = np.where(now == two >> 2, 0, np.where(now == one >> 2, 1, np.where(now == m.common, 2, 3)))
        places = m.lane * 64 + ((two & 3) * 16 + (one & 3) * 4 + outcome)
        rest = np.equal(outcome, 3, out=is_rest[a:b])
        cell = np.where(rest, row + (now >> 8), lanes * m.uppers)
        part = m.part.take(places, mode="clip")
        begin = (m.begin.take(places, mode="clip") + part * m.upper_begin.take(cell, mode="clip")).view(np.uint64)
        share = (part * m.upper_share.take(cell, mode="clip")).view(np.uint64)
        for t in range(b - a):
            np.right_shift(width, bits, out=unit)
            np.multiply(begin[t], unit, out=added)
            np.add(low, added, out=low)
            np.multiply(unit, share[t], out=width)
            np.less(width, lowest, out=small)
            narrow = small.nonzero()[0]
            if len(narrow):
                x, y = low.take(narrow), place.take(narrow)
                flat[y] = x >> kept  # a carry stays in the digit until the end
                place[narrow] = y + 1
                low[narrow] = (x & mask) << taken
                width[narrow] = width.take(narrow) << taken
        m.learn(places, now)
    flat[place] = low >> kept
    flat[place + 1] = (low & mask) << np.uint64(1)
    used = place + 2 - m.lane * size
    while (carry := out >> taken).any():
        out &= np.uint64(0xFFFFFFFF)
        out[:, :-1] += carry[:, 1:]
    digits = out.astype(">u4")
    lower = columns.astype(np.uint8)
    return [(digits[i, :n].tobytes(), lower[is_rest[:, i], i].tobytes()) for i, n in enumerate(used.tolist())]


def decode(payloads: list[tuple[bytes, bytes]], vocabulary: int, length: int = BLOCK) -> np.ndarray:
    """(blocks, length) int32 of the payloads of encode."""
    lanes = len(payloads)
    m = Model(lanes, vocabulary)
    size = max(len(p) for p, _ in payloads) // 4 + 3
    data = np.zeros((lanes, size), np.int64)
    for i, (p, _) in enumerate(payloads):
        data[i, : len(p) // 4] = np.frombuffer(p, ">u4", len(p) // 4)
    code = data[:, 0] << 31 | data[:, 1] >> 1
    data = ((data[:, 1:-1] & 1) << 31 | data[:, 2:] >> 1).reshape(-1)  # the 32 bits that come after each digit's 63
    place = m.lane * (size - 2)
    lower = np.frombuffer(b"".join(r for _, r in payloads) + b"\0", np.uint8).astype(np.int64)
    byte = np.cumsum([0, *(len(r) for _, r in payloads[:-1])], dtype=np.int64)
    width = np.full(lanes, (1 << 63) - 1, np.int64)
    slot, lane16 = m.lane << UPPER_BITS, m.lane * 16
    cells = m.lane.repeat(m.uppers) * m.uppers + np.tile(np.arange(m.uppers), lanes)
    upper_id = np.append((cells % m.uppers) << 8, 0)
    upper = np.full((4, lanes), lanes * m.uppers)  # by outcome
    out = np.empty((length, lanes), np.int64)
    unit, value, top, edge, cell, part, begin, share, own, chosen, outcome = (np.zeros(lanes, np.int64) for _ in range(11))
    first, second, rest, small = (np.zeros(lanes, bool) for _ in range(4))
    which = np.zeros(lanes, np.int8)
    for a, b in periods(length):
        upper_of = np.repeat(cells, m.upper_share[:-1])  # the cell of each place in the range
        places = np.empty((b - a, lanes), np.int64)
        for t in range(a, b):
            m.predict()
            at, now = places[t - a], out[t]
            np.multiply(m.sure[0], FOUR, out=cell)
            np.add(cell, m.sure[1], out=cell)
            np.add(cell, lane16, out=cell)
            np.right_shift(width, WHOLE, out=unit)
            np.floor_divide(code, unit, out=value)
            np.right_shift(value, UPPER, out=top)
            for edges, over in zip(m.edges, (first, second, rest)):
                edges.take(cell, out=edge, mode="clip")
                np.greater_equal(top, edge, out=over)
            np.add(first.view(np.int8), second.view(np.int8), out=which)
            np.add(which, rest.view(np.int8), out=which)
            outcome[:] = which
            np.multiply(cell, FOUR, out=at)
            np.add(at, outcome, out=at)
            m.part.take(at, out=part, mode="clip")
            m.begin.take(at, out=begin, mode="clip")
            np.subtract(value, begin, out=value)
            np.floor_divide(value, part, out=value)
            np.add(value, slot, out=value)
            upper_of.take(value, out=upper[3], mode="clip")
            np.multiply(outcome, m.wide, out=chosen)
            np.add(chosen, m.lane, out=chosen)
            upper.take(chosen, out=cell, mode="clip")
            # the id
            lower.take(byte, out=own, mode="clip")
            np.add(byte, rest, out=byte)
            upper_id.take(cell, out=top, mode="clip")
            np.add(own, top, out=m.ids[3])
            m.ids.take(chosen, out=now, mode="clip")
            # the range
            m.upper_begin.take(cell, out=top, mode="clip")
            np.multiply(top, part, out=top)
            np.add(begin, top, out=begin)
            np.multiply(begin, unit, out=begin)
            np.subtract(code, begin, out=code)
            m.upper_share.take(cell, out=share, mode="clip")
            np.multiply(share, part, out=share)
            np.multiply(unit, share, out=width)
            np.less(width, LEAST, out=small)
            narrow = small.nonzero()[0]
            if len(narrow):
                y = place.take(narrow)
                code[narrow] = code.take(narrow) << TAKEN | data.take(y, mode="clip")
                place[narrow] = y + ONE
                width[narrow] = width.take(narrow) << TAKEN
            m.update(now)
        m.learn(places, out[a:b])
    return out.T.astype(np.int32, order="C")


def write_file(out, ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> None:
    """Magic, sizes, documents and their counts, then table of (ids, bytes of digits, lower bytes, CRC-32) by block and payloads."""
    ids = np.ascontiguousarray(ids, np.int32)
    blocks = -(-len(ids) // BLOCK)
    docs = zlib.compress(np.concatenate((np.diff(doc_ids, prepend=np.int64(0)), counts)).astype("<i8").tobytes(), 6)
    out.write(MAGIC + struct.pack("<IIQQI", vocabulary, blocks, len(doc_ids), len(docs), zlib.crc32(docs)))
    out.write(docs)
    for lo in range(0, blocks, LANES):
        own = ids[lo * BLOCK : (lo + LANES) * BLOCK]
        lanes = -(-len(own) // BLOCK)
        padded = np.zeros(lanes * BLOCK, np.int32)
        padded[: len(own)] = own
        payloads = encode(padded.reshape(lanes, BLOCK), vocabulary)
        table = [struct.pack("<IIII", len(b), len(p), len(r), zlib.crc32(b.astype("<u4").tobytes())) for i, (p, r) in enumerate(payloads) for b in [own[i * BLOCK : (i + 1) * BLOCK]]]
        out.write(b"".join(table) + b"".join(p + r for p, r in payloads))


def read_file(source) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, counts); raises if a checksum fails."""
    head = source.read(len(MAGIC) + 28)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    vocabulary, blocks, n_docs, size, crc = struct.unpack("<IIQQI", head[len(MAGIC) :])
    raw = source.read(size)
    if zlib.crc32(raw) != crc:
        raise ValueError("the document table is damaged")
    docs = np.frombuffer(zlib.decompress(raw), "<i8")
    parts = []
    for lo in range(0, blocks, LANES):
        lanes = min(LANES, blocks - lo)
        table = np.frombuffer(source.read(16 * lanes), "<u4").reshape(-1, 4)
        payloads = [(source.read(n), source.read(r)) for n, r in table[:, 1:3].tolist()]
        ids = decode(payloads, vocabulary)
        for i, (n, _, _, crc) in enumerate(table.tolist()):
            if zlib.crc32(ids[i, :n].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {lo + i} is damaged")
        parts.append(ids.reshape(-1)[: int(table[:, 0].sum())])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return ids, np.cumsum(docs[:n_docs]), docs[n_docs:]
