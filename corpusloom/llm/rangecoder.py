"""Adaptive context-mixing range coder for token ids.

A block is coded on its own: models start empty, the ids are cut into equal
lanes, and step t codes the t-th id of every lane at once with array operations.
All lanes of a block share the models, which learn after every step, so a
decoder that repeats the steps has the same state.

Order 2 and order 1 each name the id that last followed the last two ids and the
last id, with a confidence. Order 1 and order 0 are also adaptive distributions:
the frequencies of the ids that followed the last id, and of all ids. For each
pair of confidences, and for contexts with and without a distribution, the coder
learns how much to trust each of the four: that share of the range is theirs, and
an id is coded in the share of the first that holds it.

Block layout, little-endian: magic, ids, alphabet, lanes, steps, words,
CRC-32 of all other fields and what follows, CRC-32 of the ids, words of each
lane (u16), words (u16). Where the largest id is MAX_ALPHABET or more, the block
is preceded by a table of the ids that occur and codes their places in it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CLRC"
_HEAD = struct.Struct("<4sIIIIIII")
MAX_LANES = 4096
STEPS = 256
MAX_IDS = MAX_LANES * STEPS
#: Ids below it are coded as they are, others by their places in a table of the block.
MAX_ALPHABET = 1 << 18
TABLE_MAGIC = b"CLRT"
_TABLE = struct.Struct("<4sIII")
#: Steps after which the distributions of order 1 are counted anew.
_COUNTED = frozenset((8, 16, 32, 64, 96, 128, 192))
#: Pairs a decoder steps over from where its guide points; what lies farther on is searched for.
_PROBES = 4

_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 32)
_LOW_MASK, _S16, _S48 = _U((1 << 32) - 1), _U(16), _U(48)
#: Outcome shares are parts of 2**10, order-0 shares parts of 2**19: together they
#: stay below the least range of 2**32, so one division-free step codes an id.
_FLAG_BITS, _ZERO_BITS = 10, 19
_ORDER2_BITS = 18
_CONF = 4
#: Order 2's id, order 1's id, order 1's distribution, order 0's distribution.
_WAYS = 4
_UNIT = _U(_FLAG_BITS + _ZERO_BITS)
_SHARE_BITS = _ZERO_BITS + 1
_SHARE_MASK = (1 << _SHARE_BITS) - 1


class _Models:
    """Models of one block; encoder and decoder update them alike.

    Order 1 and order 2 keep one entry a context: the id that followed, times
    four, plus a confidence of 0 to 3. Order 1 has one more bit between them, set
    where the context has a distribution. Places and shares of the distributions
    stand in one number each, the share in the low 20 bits.
    """

    def __init__(self, alphabet: int, grid: np.ndarray | None = None):
        """grid: all ids, a row a step, as the encoder has them; a decoder has none."""
        self.alphabet = alphabet
        self.order1 = np.full(alphabet + 1, -2 * _CONF, np.int32)
        self.order2 = np.full(1 << _ORDER2_BITS, -_CONF, np.int32)
        # By confidences and whether order 1 has a distribution: order 2 right, order 1
        # right, in order 1's distribution, none of these.
        self.hits = np.ones((2 * _CONF * _CONF, _WAYS), np.int64)
        self.hits[:, 2:] = 2
        self.seen = np.zeros(alphabet, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.kind, self.shift = (np.uint64, 18) if alphabet > 1 << 16 else (np.uint32, 16)
        #: Pairs (last id, id) that were not counted yet; an encoder has their numbers.
        self.history: list = []
        self.decodes = grid is None
        if self.decodes:
            self.keys = np.zeros(0, self.kind)
        else:
            self._number_pairs(grid)
        self.refresh()

    def refresh(self) -> None:
        """Shares of ids and outcomes from all steps so far; no share is zero."""
        if self.pending:
            ids, flagged = (np.concatenate(p) for p in zip(*self.pending, strict=True))
            self.seen += np.bincount(ids, minlength=self.alphabet)
            self.hits += np.bincount(flagged, minlength=self.hits.size).reshape(-1, _WAYS)
            self.pending = []
        cum = np.concatenate([[0], np.cumsum(self.seen * 32 + 1)])
        cum = cum * ((1 << _ZERO_BITS) - self.alphabet) // cum[-1] + np.arange(self.alphabet + 1)
        width = np.diff(cum)
        self.zero = cum[:-1] << _SHARE_BITS | width
        total = self.hits.sum(1, keepdims=True)
        share = self.hits * ((1 << _FLAG_BITS) - _WAYS) // total + 1
        share[:, -1] = (1 << _FLAG_BITS) - share[:, :-1].sum(1)
        start = np.concatenate([np.zeros((len(share), 1), np.int64), np.cumsum(share, 1)], 1)
        self.flag_size = share.reshape(-1).copy()
        # A named id takes the whole share of its outcome.
        self.whole_start, self.whole_size = start[:, :_WAYS].reshape(-1) << _ZERO_BITS, self.flag_size << _ZERO_BITS
        if self.decodes:
            kind = np.uint16 if self.alphabet <= 1 << 16 else np.uint32
            self.symbol = np.repeat(np.arange(self.alphabet, dtype=kind), width)
            # The outcome that holds each part of a range.
            self.outcome = np.repeat(np.arange(self.hits.size, dtype=np.uint8), self.flag_size)

    def _number_pairs(self, grid: np.ndarray) -> None:
        """Number the pairs (last id, id) of the block, so that counting them sorts nothing."""
        keys = grid[:-1].reshape(-1).astype(_U)
        places = _U(max(1, (keys.size - 1).bit_length()))
        keys <<= _U(self.shift)
        keys |= grid[1:].reshape(-1).view(np.uint32)
        keys <<= places
        keys |= np.arange(keys.size, dtype=np.uint32)
        keys.sort()
        at = (keys & ((_U(1) << places) - _U(1))).view(np.int64)
        keys >>= places
        new = keys[1:] != keys[:-1]
        number = np.zeros(len(keys), np.int32)
        number[at[1:]] = np.cumsum(new, dtype=np.int32)
        #: By step; the first ids have none before them.
        self.number = np.concatenate([np.zeros((1, grid.shape[1]), np.int32), number.reshape(-1, grid.shape[1])])
        distinct = keys[np.concatenate([[True], new])] if len(keys) else keys
        self.pairs = self._parted(distinct)
        self.n_pairs = np.zeros(len(distinct), np.int64)
        #: Place and share by the number of the pair; 0 where it is left to order 0.
        self.pair = np.zeros(max(1, len(distinct)), np.int64)

    def _parted(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = keys.dtype.type
        return (keys >> kind(self.shift)).astype(np.int64), (keys & kind((1 << self.shift) - 1)).astype(np.int64)

    def count_pairs(self) -> None:
        """Distributions of order 1 from all steps so far: each context's ids in a row, their shares of 2 ** _ZERO_BITS.

        An id that followed only once is left to order 0.
        """
        if self.decodes:
            new = np.sort(np.concatenate([a.astype(self.kind) << self.kind(self.shift) | x.astype(self.kind) for a, x in self.history]))
            # Two sorted runs, which a stable sort merges.
            self.keys = np.concatenate([self.keys, new])
            self.keys.sort(kind="stable")
            first = np.flatnonzero(np.concatenate([[True], self.keys[1:] != self.keys[:-1]]))
            n = np.diff(np.append(first, len(self.keys)))
            often = np.flatnonzero(n > 1)
            a, x = self._parted(self.keys[first[often]])
            n = n[often]
        else:
            self.n_pairs += np.bincount(np.concatenate(self.history), minlength=len(self.n_pairs))
            often = np.flatnonzero(self.n_pairs > 1)
            a, x, n = self.pairs[0][often], self.pairs[1][often], self.n_pairs[often]
        self.history = []
        begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        m = np.diff(np.append(begin, len(a)))
        total = np.add.reduceat(n, begin) if len(a) else n
        size = n * np.repeat(((1 << _ZERO_BITS) - m), m) // np.repeat(total, m) + 1
        upto = np.cumsum(size)
        at = upto - size
        at -= np.repeat(at[begin], m)
        # What rounding left goes to the last id of a context.
        last = begin + m - 1
        size[last] = (1 << _ZERO_BITS) - at[last]
        self.order1 &= ~_CONF
        self.order1[a[begin]] |= _CONF
        pair = at << _SHARE_BITS | size
        if self.decodes:
            self._guide(a[begin], m, at, size)
            self.pair = pair | x << 2 * _SHARE_BITS
        else:
            self.pair[:] = 0
            self.pair[often] = pair

    def _guide(self, contexts: np.ndarray, m: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """For each context, equal buckets of its range, at least two a pair: the pair in which each bucket begins."""
        bits = np.minimum(np.ceil(np.log2(np.maximum(m, 1))).astype(np.int64) + 1, _ZERO_BITS)
        buckets = np.cumsum(1 << bits)
        first, shift = buckets - (1 << bits), _ZERO_BITS - bits
        each = np.repeat(shift, m)
        # The first bucket that begins at or behind a pair's place.
        bucket = np.repeat(first, m) + (at + (1 << each) - 1 >> each)
        n = int(buckets[-1]) if len(buckets) else 0
        self.guide = np.cumsum(np.bincount(bucket, minlength=n + 1)) - 1
        self.guide_first, self.guide_shift = np.zeros(self.alphabet + 1, np.int64), np.zeros(self.alphabet + 1, np.int64)
        self.guide_first[contexts], self.guide_shift[contexts] = first, shift
        self.pair_end = at + size
        self.slots = np.repeat(contexts, m) << _ZERO_BITS | at

    def find_pairs(self, a: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The pair of each context a that holds the place `rest` of its range."""
        out = self.guide[self.guide_first[a] + (rest >> self.guide_shift[a])]
        left = np.flatnonzero(self.pair_end[out] <= rest)
        for _ in range(_PROBES):
            if not len(left):
                return out
            out[left] += 1
            left = left[self.pair_end[out[left]] <= rest[left]]
        out[left] = np.searchsorted(self.slots, a[left].astype(np.int64) << _ZERO_BITS | rest[left], "right") - 1
        return out

    def predict(self, a: np.ndarray, b: np.ndarray):
        """a: the last id, b: the one before it (alphabet: none). h and g: places of their entries."""
        h = (a.view(np.uint32) * np.uint32(0x9E3779B1) ^ b.view(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(
            32 - _ORDER2_BITS
        )
        h, g = h.astype(np.intp), a.astype(np.intp)
        e2, e1 = self.order2[h], self.order1[g]
        return h, g, e2, e1, (e2 & (_CONF - 1)) * 2 * _CONF + (e1 & (2 * _CONF - 1))

    def learn(self, step: int, x, g, h, e2, e1, right2, right1, flagged) -> None:
        # Lanes that share a context write one after the other; the last one stays.
        # A right id gains confidence up to the most, a wrong one loses it or its place.
        self.order2[h] = np.where(right2, np.minimum(e2 + 1, e2 | (_CONF - 1)), np.where(e2 & (_CONF - 1), e2 - 1, x * _CONF))
        self.order1[g] = np.where(right1, np.minimum(e1 + 1, e1 | (_CONF - 1)), np.where(e1 & (_CONF - 1), e1 - 1, x * 2 * _CONF + (e1 & _CONF)))
        self.pending.append((x, flagged))
        if step:
            self.history.append((g, x) if self.decodes else self.number[step, : len(x)])
        if step + 1 in _COUNTED:
            self.count_pairs()
        if step & (step + 1) == 0 or step % 32 == 31:
            self.refresh()


def _shape(n: int) -> tuple[int, int]:
    lanes = min(MAX_LANES, max(1, -(-n // STEPS)))
    return lanes, -(-n // lanes)


def _active(n: int, steps: int, t: int) -> int:
    """Lanes that have an id at step t: the first ones."""
    return (n - 1 - t) // steps + 1 if t < n else 0


def _check(fields: tuple[int, ...], ids_crc: int, body: bytes) -> int:
    return zlib.crc32(body, zlib.crc32(struct.pack("<6I", *fields, ids_crc)))


def _unsettled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes whose leading word is settled or whose range is too small."""
    return np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))


def _renormalise(low: np.ndarray, rng: np.ndarray):
    """Lanes with a word to move and their words, until there is none."""
    i = _unsettled(low, rng)
    while len(i):
        lo, ra = low[i], rng[i]
        settled = (lo ^ (lo + ra)) < _TOP
        if not settled.all():
            # A small range that straddles a word is cut at the word's end.
            ra = np.where(settled, ra, (_U(0) - lo) & _LOW_MASK)
        yield i, (lo >> _S48)
        lo, ra = lo << _S16, ra << _S16
        low[i], rng[i] = lo, ra
        i = i[_unsettled(lo, ra)]


def encode_block(ids: np.ndarray) -> bytes:
    """One block of up to MAX_IDS ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    if n > MAX_IDS:
        raise ValueError(f"a block holds at most {MAX_IDS} ids")
    if n == 0:
        return _HEAD.pack(MAGIC, 0, 0, 0, 0, 0, _check((0,) * 5, 0, b""), 0)
    lanes, steps = _shape(n)
    alphabet = int(ids.max()) + 1
    if alphabet > MAX_ALPHABET:
        known, place = np.unique(ids, return_inverse=True)
        if len(known) > MAX_ALPHABET:
            raise ValueError(f"a block holds at most {MAX_ALPHABET} different ids; encode_ids cuts accordingly")
        table = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes())
        return _TABLE.pack(TABLE_MAGIC, len(known), len(table), zlib.crc32(table)) + table + encode_block(place)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    m = _Models(alphabet, grid)
    low_all, rng_all = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    room = 3 * steps + 8
    words = np.zeros(lanes * room, np.uint16)
    begin = room * np.arange(lanes)
    at = begin.copy()
    a = np.full(lanes, alphabet, np.int32)
    b = a.copy()
    for t in range(steps):
        k = _active(n, steps, t)
        x, a, b, low, rng = grid[t, :k], a[:k], b[:k], low_all[:k], rng_all[:k]
        h, g, e2, e1, conf = m.predict(a, b)
        right2, right1 = e2 >> 2 == x, e1 >> 3 == x
        # Where neither named id is right, the distributions give the place and the share.
        flagged = conf * _WAYS + ~right2
        miss = np.flatnonzero(~(right2 | right1))
        pair = m.pair[m.number[t, miss]]
        held = pair > 0
        flagged[miss] += 2 - held
        start, share = m.whole_start[flagged], m.whole_size[flagged]
        pair = np.where(held, pair, m.zero[x[miss]])
        size = m.flag_size[flagged[miss]]
        start[miss] += (pair >> _SHARE_BITS) * size
        share[miss] = (pair & _SHARE_MASK) * size
        rng >>= _UNIT
        low += rng * start.view(_U)
        rng *= share.view(_U)
        for i, word in _renormalise(low, rng):
            to = at[i]
            words[to] = word
            at[i] = to + 1
        m.learn(t, x, g, h, e2, e1, right2, right1, flagged)
        a, b = x, a
    for _ in range(4):
        words[at] = low_all >> _S48
        at += 1
        low_all <<= _S16
    count = at - begin
    flat = words.reshape(lanes, room)[np.arange(room) < count[:, None]].astype("<u2")
    body = count.astype("<u2").tobytes() + flat.tobytes()
    fields = (n, alphabet, lanes, steps, len(flat))
    ids_crc = zlib.crc32(ids.tobytes())
    return _HEAD.pack(MAGIC, *fields, _check(fields, ids_crc, body), ids_crc) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if block[:4] == TABLE_MAGIC and len(block) >= _TABLE.size:
        _, n, size, crc = _TABLE.unpack_from(block)
        table = block[_TABLE.size : _TABLE.size + size]
        if len(table) != size or zlib.crc32(table) != crc:
            raise ValueError("damaged block")
        known = np.cumsum(np.frombuffer(zlib.decompress(table), "<u4"), dtype=np.uint32)
        place = decode_block(block[_TABLE.size + size :])
        if len(known) != n or len(place) and int(place.max()) >= n:
            raise ValueError("damaged block")
        return known[place].astype("<u4")
    if len(block) < _HEAD.size:
        raise ValueError("truncated block")
    magic, n, alphabet, lanes, steps, n_words, body_crc, ids_crc = _HEAD.unpack_from(block)
    body = block[_HEAD.size :]
    if magic != MAGIC or len(body) != 2 * (lanes + n_words):
        raise ValueError("damaged block")
    if _check((n, alphabet, lanes, steps, n_words), ids_crc, body) != body_crc:
        raise ValueError("damaged block")
    if n == 0:
        return np.zeros(0, np.uint32)
    count = np.frombuffer(body, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", n_words, 2 * lanes).astype(_U), np.zeros(4, _U)])
    at_all = np.cumsum(count) - count
    low_all, rng_all, code_all = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U), np.zeros(lanes, _U)
    for _ in range(4):
        code_all = (code_all << _S16) | words[at_all]
        at_all += 1
    m = _Models(alphabet)
    grid = np.zeros((steps, lanes), np.int32)
    a = np.full(lanes, alphabet, np.int32)
    b = a.copy()
    for t in range(steps):
        k = _active(n, steps, t)
        a, b, low, rng, code, at = a[:k], b[:k], low_all[:k], rng_all[:k], code_all[:k], at_all[:k]
        h, g, e2, e1, conf = m.predict(a, b)
        rng >>= _UNIT
        v = ((code - low) // rng).view(np.int64)
        flagged = m.outcome[conf << _FLAG_BITS | v >> _ZERO_BITS].astype(np.intp)
        way = flagged & (_WAYS - 1)
        start, share = m.whole_start[flagged], m.whole_size[flagged]
        named2, named1 = e2 >> 2, e1 >> 3
        x = np.where(way == 0, named2, named1)
        miss = np.flatnonzero(way >= 2)
        size = m.flag_size[flagged[miss]]
        rest = (v[miss] - start[miss]) // size
        held = way[miss] == 2
        first, last = np.flatnonzero(held), np.flatnonzero(~held)
        pair, found = np.zeros(len(miss), np.int64), np.zeros(len(miss), np.int32)
        found[last] = m.symbol[rest[last]]
        pair[last] = m.zero[found[last]]
        if len(first):
            named = m.pair[m.find_pairs(g[miss[first]], rest[first])]
            found[first] = named >> 2 * _SHARE_BITS
            pair[first] = named
        x[miss] = found
        start[miss] += (pair >> _SHARE_BITS & _SHARE_MASK) * size
        share[miss] = (pair & _SHARE_MASK) * size
        low += rng * start.view(_U)
        rng *= share.view(_U)
        for i, _ in _renormalise(low, rng):
            of = at[i]
            code[i] = (code[i] << _S16) | words[of]
            at[i] = of + 1
        grid[t, :k] = x
        m.learn(t, x, g, h, e2, e1, named2 == x, named1 == x, flagged)
        a, b = x, a
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4", copy=False)
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("damaged block")
    return ids


def encode_ids(ids: np.ndarray) -> list[bytes]:
    """Blocks of nearly equal length that hold all ids in order."""
    most = MAX_IDS if not len(ids) or int(np.max(ids)) < MAX_ALPHABET else min(MAX_IDS, MAX_ALPHABET)
    n = max(1, -(-len(ids) // most))
    return [encode_block(part) for part in np.array_split(ids, n)]


def decode_ids(blocks: list[bytes]) -> np.ndarray:
    return np.concatenate([decode_block(x) for x in blocks]) if blocks else np.zeros(0, np.uint32)
