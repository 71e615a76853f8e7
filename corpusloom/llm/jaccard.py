"""Jaccard join over word shingles as a blocked sparse matrix product.

The matrix has a row for every distinct shingle set (equal texts share one) and a
column for every shingle. Three products of growing precision, each on fewer
rows, find the components of the link graph without ever listing the pairs of a
group:

1. Column blocks count in how many rows each shingle stands. A row can link only
   if 80 % of its shingles stand in another row too; the rest are discarded.
   Blocks travel as packed 5-byte hashes, and only counts travel back. A shingle
   that two rows of a chunk share is settled there and travels once a chunk, so
   a passage on a third of all rows is no hot column.
2. Column blocks of the rows that are left give exact frequencies; a chunk sends
   each of its shingles once, with a count. With shingles ordered by frequency,
   two linked rows share one of their first n - ceil(0.8 n) + 1 shingles; those
   that do form candidate clusters (a star for each shingle, its local part
   before the shuffle).
3. Row blocks: exact overlaps are accumulated over the shingles of one row at a
   time against all others of a unit of work. A row whose component is known and
   holds all others that are left need not be multiplied. A small cluster is one
   unit. The rows of a large one are dealt twice into blocks, each row to one
   block a deal, which joins a large group of near copies in time linear in the
   group. Only where several components are left, the rows outside the largest
   one meet each other and all rest, by pairs of blocks.

Only spanning edges leave step 3. Components of those edges are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.components import connected_components
from corpusloom.llm.hashing import join_texts, mix, span_hashes, spans_of
from corpusloom.llm.storage import bounded, materialize
from corpusloom.llm.worker import task

SHINGLE = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of the row filter of step 2: a fixed 8 MB, however many rows are left.
FILTER_BITS = 26
#: Entries of a column block; their number sets the number of blocks.
BLOCK_ENTRIES = 4_000_000
#: Rows of a block and blocks of a cluster in step 3; bytes of a block's hashes.
BLOCK_ROWS, MAX_BLOCKS, BLOCK_BYTES = 64, 16, 32 << 20
#: Text that is hashed at once.
CHUNK_CHARS = 1_000_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs of bytes other than white space (\\x20, \\x09-\\x0D), A-Z in
    lower case. Fewer than five words are one shingle, no words none.
    """
    if not texts:
        return []
    data, bounds = join_texts(texts)
    b = data.copy()
    b[(b >= 65) & (b <= 90)] += 32
    starts, ends = spans_of((b != 32) & ((b < 9) | (b > 13)))
    word = span_hashes(b, starts, ends)
    at = np.searchsorted(starts, bounds)
    n = len(word)
    five = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
    for k, odd in enumerate(_ODD):
        five += word[k : k + len(five)] * odd
    five = mix(five)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= SHINGLE:
            h = np.sort(five[i : j - SHINGLE + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif j > i:
            few = ((word[i:j] ^ _ODD[j - i]) * np.array(_ODD[: j - i], np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(few + np.uint64(j - i)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(h: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set, signed."""
    both = []
    for salt, odd in ((0x27D4EB2F165667C5, _ODD[4]), (0x94D049BB133111EB, _ODD[3])):
        total = mix(h ^ np.uint64(salt)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h) * int(odd) & (1 << 64) - 1)
        both.append(int(mix(total).view(np.int64)[0]))
    return both[0], both[1]


@dataclass(frozen=True)
class Naming:
    """A set's name is its first digest, or the second one where different sets share the first."""

    clashes: frozenset[int] = frozenset()
    #: Bits of the first digest (fewer in tests, to make sets clash).
    bits: int = 64

    def first(self, digest: int) -> int:
        return digest if self.bits == 64 else digest & ((1 << self.bits) - 1)

    def of(self, h: np.ndarray) -> int:
        first, second = set_digest(h)
        first = self.first(first)
        return second if first in self.clashes else first


def _needed(n):
    """Least overlap of a set of n shingles with any set it links to."""
    return -(-PERCENT * n // 100)


def _each(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Shingle sets of the texts, chunk by chunk: (batch, first row, sets)."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, texts in tokens.text_runs(batch, column, CHUNK_CHARS):
                yield batch, i, shingle_sets(texts)


def _name_sets(naming: Naming):
    """id, n, both digests and the key of every text."""

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, sets in _each(batches, 1):
            names = [set_digest(h) if len(h) else (None, None) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i : i + len(sets)].cast(pa.int64()),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([a if a is None else naming.first(a) for a, _ in names], pa.int64()),
                    pa.array([b for _, b in names], pa.int64()),
                    batch.column(2)[i : i + len(sets)],
                ],
                names=["id", "n", "digest", "other", "key"],
            )

    return run


def _new_sets(batches: Iterator[pa.RecordBatch], column: int, naming: Naming) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Sets and their names, each distinct set once a task."""
    seen: set[int] = set()
    for _, _, sets in _each(batches, column):
        names, kept = [], []
        for h in sets:
            if len(h):
                d = naming.of(h)
                if d not in seen:
                    seen.add(d)
                    names.append(d)
                    kept.append(h)
        if names:
            yield names, kept


def _pack(h: np.ndarray, width: int) -> bytes:
    """The low bytes of hashes in a row."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8")[:, 0]


_BLOCK = "block int, chunk long, counts binary, digests binary, hashes binary, several binary"


def _scatter(names: list[int], sets: list[np.ndarray], blocks: int, chunk: int) -> pa.RecordBatch:
    """A chunk's rows cut into column blocks.

    For each block: the hashes that one set of the chunk has (by set), and those that several have, once each.
    """
    m = len(sets)
    h = np.concatenate(sets)
    row = np.repeat(np.arange(m, dtype=np.int64), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    twice = h[first & ~alone]
    h, row = h[alone], row[alone]
    block = (h % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block * m + row, kind="stable")
    counts = np.bincount(block * m + row, minlength=blocks * m).reshape(blocks, m)
    h = h[order] // np.uint64(blocks)
    ends = np.cumsum(counts.sum(1))
    of_twice = (twice % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(of_twice, kind="stable")
    twice, many = twice[order] // np.uint64(blocks), np.bincount(of_twice, minlength=blocks)
    many_ends = np.cumsum(many)
    digests = np.array(names, "<i8")
    full = np.flatnonzero((counts.sum(1) > 0) | (many > 0))
    cols: list[list] = [[], [], [], []]
    for b in full.tolist():
        have = np.flatnonzero(counts[b])
        cols[0].append(np.stack([have, counts[b][have]]).astype("<u4").tobytes())
        cols[1].append(digests[have].tobytes())
        cols[2].append(_pack(h[(ends[b - 1] if b else 0) : ends[b]], 5))
        cols[3].append(_pack(twice[(many_ends[b - 1] if b else 0) : many_ends[b]], 5))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)), *(pa.array(c, pa.binary()) for c in cols)],
        names=["block", "chunk", "counts", "digests", "hashes", "several"],
    )


def _own_shared(names: list[int], sets: list[np.ndarray], blocks: int, chunk: int) -> pa.RecordBatch:
    """What a chunk knows of its sets: their sizes, and how many shingles of each another set of the chunk has. It passes through a block."""
    size = np.array([len(x) for x in sets], np.int64)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.add.reduceat((n[at] > 1).astype(np.int64), np.cumsum(size) - size)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk % blocks], pa.int32()),
            pa.array([chunk], pa.int64()),
            pa.array([np.stack([size, shared]).astype("<u4").tobytes()], pa.binary()),
            pa.array([np.array(names, "<i8").tobytes()], pa.binary()),
            pa.array([None], pa.binary()),
            pa.array([None], pa.binary()),
        ],
        names=["block", "chunk", "counts", "digests", "hashes", "several"],
    )


def _chunk_ids():
    first, n = TaskContext.get().partitionId() << 32, 0
    while True:
        yield first + n
        n += 1


def _text_blocks(blocks: int, naming: Naming):
    """Column blocks of each chunk, and what the chunk itself knows (without hashes)."""

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _chunk_ids()
        for names, sets in _new_sets(batches, 0, naming):
            number = next(chunk)
            yield _scatter(names, sets, blocks, number)
            yield _own_shared(names, sets, blocks, number)

    return run


@task("jaccard")
def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to the chunks: of each set the shingles that only it has in its chunk and that stand in another chunk's set.

    A task gets one block, so hashes of different blocks never mix.
    """
    chunk, where, digest, hashes, several = [], [], [], [], []
    for batch in batches:
        own = pc.is_null(batch.column("hashes"))
        yield batch.select(["chunk", "counts", "digests"]).filter(own)
        batch = batch.filter(pc.invert(own))
        for c, n, d, h, m in zip(*(batch.column(k).to_pylist() for k in ("chunk", "counts", "digests", "hashes", "several")), strict=True):
            chunk.append(c)
            where.append(np.frombuffer(n, "<u4").reshape(2, -1).astype(np.int64))
            digest.append(np.frombuffer(d, "<i8"))
            hashes.append(_unpacked(h, 5))
            several.append(_unpacked(m, 5))
    if not chunk:
        return
    d = np.concatenate(digest)
    count = np.concatenate([w[1] for w in where])
    owner = np.repeat(np.arange(len(d), dtype=np.int32), count)
    # A set that several tasks sent counts once; what several sets of one chunk have is shared anyhow.
    once = np.zeros(len(d), bool)
    once[np.unique(d, return_index=True)[1]] = True
    h = np.concatenate(hashes)
    twice = np.concatenate(several)
    known, n = np.unique(np.concatenate([h[once[owner]], twice, twice]), return_counts=True)
    found = np.bincount(owner[n[np.searchsorted(known, h)] > 1], minlength=len(d))
    parts = np.split(found, np.cumsum([len(x) for x in digest])[:-1])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(chunk, pa.int64()),
            pa.array([np.stack([w[0], s]).astype("<u4").tobytes() for w, s in zip(where, parts, strict=True)], pa.binary()),
            pa.array([None] * len(chunk), pa.binary()),
        ],
        names=["chunk", "counts", "digests"],
    )


@task("jaccard")
def _keep_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the sets that share enough of their shingles to link at all; a chunk's rows meet here."""
    own: dict[int, tuple] = {}
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for c, n, d in zip(*(batch.column(k).to_pylist() for k in ("chunk", "counts", "digests")), strict=True):
            pair = np.frombuffer(n, "<u4").reshape(2, -1).astype(np.int64)
            if d is None:
                found.setdefault(c, []).append(pair)
            else:
                own[c] = (pair[0], pair[1].copy(), np.frombuffer(d, "<i8"))
    for c, (size, shared, digest) in own.items():
        for place, n in found.pop(c, []):
            shared[place] += n
        yield pa.RecordBatch.from_arrays([pa.array(digest[shared >= _needed(size)])], names=["digest"])


def _row_filter(kept: DataFrame) -> np.ndarray:
    """Bitmap over the low bits of the kept digests: fixed in size, may let others pass."""
    slot = F.col("digest").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    maps = kept.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in maps.toLocalIterator():
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _kept_sets(shared, naming: Naming):
    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for names, sets in _new_sets(batches, 0, naming):
            d = np.array(names, np.int64)
            slot = d & ((1 << FILTER_BITS) - 1)
            keep = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d[keep]),
                        pa.array([len(sets[i]) for i in keep], pa.int64()),
                        pa.array([sets[i].astype("<u8").tobytes() for i in keep], pa.binary()),
                    ],
                    names=["digest", "n", "hashes"],
                )

    return run


_ENTRIES = "block int, chunk long, counts binary, digests binary, hashes binary"


def _by_block(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct sorted hashes by block, and where each block ends."""
    block = (h % np.uint64(blocks)).astype(np.int64)
    return np.argsort(block, kind="stable"), np.cumsum(np.bincount(block, minlength=blocks))


def _set_blocks(blocks: int):
    """Column blocks of the kept sets, a chunk's hashes once with their counts; block -1 holds the chunk's sets."""

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets, size = [], [], 0

        def rows() -> pa.RecordBatch:
            number = names[0]  # the table has every name once, so this one names the chunk
            flat = np.concatenate(sets)
            h, n = np.unique(flat, return_counts=True)
            order, ends = _by_block(h, blocks)
            h, n = h[order], n[order]
            starts = np.concatenate([[0], ends[:-1]])
            full = np.flatnonzero(ends > starts).tolist()
            cut = [slice(int(starts[b]), int(ends[b])) for b in full]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *full], pa.int32()),
                    pa.array([number] * (len(full) + 1), pa.int64()),
                    pa.array([np.array([len(x) for x in sets], "<u4").tobytes(), *(n[c].astype("<u4").tobytes() for c in cut)], pa.binary()),
                    pa.array([np.array(names, "<i8").tobytes(), *[None] * len(full)], pa.binary()),
                    pa.array([flat.astype("<u8").tobytes(), *(h[c].astype("<u8").tobytes() for c in cut)], pa.binary()),
                ],
                names=["block", "chunk", "counts", "digests", "hashes"],
            )

        for batch in batches:
            for d, h in zip(batch.column("digest").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                names.append(d)
                sets.append(np.frombuffer(h, "<u8"))
                size += len(sets[-1])
                if size >= CHUNK_CHARS // 4:
                    yield rows()
                    names, sets, size = [], [], 0
        if names:
            yield rows()

    return run


@task("jaccard")
def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to the chunks: in how many sets each hash of a block stands, in the order in which the chunk sent them."""
    block, chunk, count, hashes = [], [], [], []
    for batch in batches:
        for b, c, n, h in zip(*(batch.column(k).to_pylist() for k in ("block", "chunk", "counts", "hashes")), strict=True):
            block.append(b)
            chunk.append(c)
            count.append(np.frombuffer(n, "<u4"))
            hashes.append(np.frombuffer(h, "<u8"))
    if not chunk:
        return
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate(count).astype(np.float64)).astype(np.int64)[at]
    parts = np.split(total, np.cumsum([len(x) for x in hashes])[:-1])
    none = pa.array([None] * len(chunk), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int32()), pa.array(chunk, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary()), none, none],
        names=["block", "chunk", "counts", "digests", "hashes"],
    )


def _stars(hashes: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges from each shingle's smallest digest to its others, and that digest for each shingle."""
    order = np.lexsort((digest, hashes))
    h, d = hashes[order], digest[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    centre = d[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else d
    other = centre != d
    pairs = np.unique(np.stack([centre[other], d[other]], 1), axis=0)
    return pairs, h[first], d[first]


def _prefixes(blocks: int):
    """The prefix of each set, combined to one star a shingle: kind 0 edges, kind 1 what meets elsewhere."""

    @task("jaccard")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple] = {}
        ranks: dict[int, list] = {}
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("block", "chunk", "counts", "digests", "hashes")]
            for b, c, n, d, h in zip(*cols, strict=True):
                if b < 0:
                    own[c] = (np.frombuffer(n, "<u4").astype(np.int64), np.frombuffer(d, "<i8"), np.frombuffer(h, "<u8"))
                else:
                    ranks.setdefault(c, []).append((b, np.frombuffer(n, "<u4")))
        found_h, found_d = [], []
        for c, (n, names, h) in own.items():
            known, at = np.unique(h, return_inverse=True)
            order, _ = _by_block(known, blocks)
            freq = np.empty(len(known), np.int64)
            freq[order] = np.concatenate([x for _, x in sorted(ranks.pop(c), key=lambda r: r[0])])
            f, row = freq[at], np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, f, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            use = order[(place < np.repeat(n - _needed(n) + 1, n)) & (f[order] > 1)]
            found_h.append(h[use])
            found_d.append(names[row[use]])
        if not found_h:
            return
        pairs, h, d = _stars(np.concatenate(found_h), np.concatenate(found_d))
        kind = np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(h), np.int32)])
        a = np.concatenate([pairs[:, 0], h.view(np.int64)])
        b = np.concatenate([pairs[:, 1], d])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return run


@task("jaccard")
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h, d = [], []
    for batch in batches:
        h.append(batch.column("a").to_numpy(zero_copy_only=False))
        d.append(batch.column("b").to_numpy(zero_copy_only=False))
    if h:
        pairs, _, _ = _stars(np.concatenate(h), np.concatenate(d))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def link_components(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of a set of its component, by exact overlaps.

    known: numbers that are equal for sets of a component that is known already.
    """
    m = len(sets)
    label = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    size = np.array([len(h) for h in sets], np.int64)
    flat = np.concatenate(sets)
    _, column = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(column, kind="stable")
    by_column = owner[order]
    start = np.searchsorted(column[order], np.arange(int(column.max()) + 2))
    first = np.cumsum(size) - size
    todo = np.ones(m, bool)
    while True:
        left = np.flatnonzero(todo)
        if not len(left):
            return label
        groups, sizes = np.unique(label[left], return_counts=True)
        if len(groups) == 1:  # pairs that were not multiplied lie in one component
            return label
        # A row outside the largest group that is left.
        p = left[np.argmax(label[left] != groups[np.argmax(sizes)])]
        todo[p] = False
        mine = column[first[p] : first[p] + size[p]]
        a, n = start[mine], start[mine + 1] - start[mine]
        ends = np.cumsum(n)
        at = np.repeat(a - (ends - n), n) + np.arange(int(ends[-1]))
        overlap = np.bincount(by_column[at], minlength=m)
        # Size-derived bound first, then the exact test.
        near = np.flatnonzero((overlap >= _needed(size[p])) & (overlap >= _needed(size)))
        near = near[100 * overlap[near] >= PERCENT * (size[p] + size[near] - overlap[near])]
        joined = np.unique(label[near])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]


@task("jaccard")
def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each unit's rows; rows come sorted by unit."""

    def edges(names: list[int], known: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if len(sets) < 2 or len(set(known)) < 2:
            return []
        # Of each label the first row stands for it; rows that shared a label before need no edge.
        first: dict[int, int] = {}
        label = link_components(sets, np.array(known, np.int64)).tolist()
        return [(names[first[k]], names[i]) for i, k in enumerate(label) if known[first.setdefault(k, i)] != known[i]]

    unit, names, known, sets, out = None, [], [], [], []
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in ("cluster", "pair", "digest", "known", "hashes")]
        for c, p, d, k, h in zip(*cols, strict=True):
            if (c, p) != unit:
                out += edges(names, known, sets)
                unit, names, known, sets = (c, p), [], [], []
            names.append(d)
            known.append(k)
            sets.append(np.frombuffer(h, "<u8"))
    out += edges(names, known, sets)
    a, b = zip(*out) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(units: DataFrame, n: int) -> DataFrame:
    """Spanning edges (a, b) of units of work: cluster, pair, digest, known, hashes."""
    # Units of a cluster are numbered in a row, so that neighbours go to different tasks.
    dealt = units.withColumn("part", F.pmod(F.xxhash64("cluster") + F.col("pair"), F.lit(n)).cast("int"))
    return (
        dealt.repartitionById(n, F.col("part"))
        .sortWithinPartitions("cluster", "pair", "digest")
        .mapInArrow(_link, "a long, b long")
    )


def _blocks_of(rows, entries):
    """Blocks of rows: some for the sake of parallel work, more where their bytes demand it."""
    few = F.least(F.ceil(rows / BLOCK_ROWS), F.lit(MAX_BLOCKS))
    return F.greatest(few, F.ceil(entries * 8 / BLOCK_BYTES)).cast("int")


def _verified_edges(sets: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    """Links among the sets of each candidate cluster, as spanning edges."""
    placed = materialize(
        sets.select("digest", "n").join(bounded(clusters), F.col("digest") == F.col("node")).select(
            "digest", "n", F.col("component").alias("cluster")
        ),
        "clustered",
    )
    sizes = materialize(
        placed.groupBy("cluster")
        .agg(F.count("*").alias("rows"), F.sum("n").alias("entries"))
        .select("cluster", _blocks_of(F.col("rows"), F.col("entries")).alias("blocks")),
        "cluster-sizes",
    )

    def units_of(where: DataFrame) -> DataFrame:
        """The sets of rows (digest, cluster, known, pair)."""
        w = where.withColumnRenamed("digest", "d")
        return sets.join(bounded(w), F.col("digest") == F.col("d")).select("cluster", "pair", "digest", "known", "hashes")

    dealt = placed.join(bounded(sizes), "cluster").withColumn("known", F.col("digest"))
    zero = F.lit(0).cast("long")
    small = _linked(units_of(materialize(dealt.where("blocks = 1").select("digest", "cluster", "known", zero.alias("pair")), "units")), n)
    if not sizes.where("blocks > 1").limit(1).count():
        return small
    large = dealt.where("blocks > 1")
    deals = F.array(*(F.lit(i) * F.col("blocks") + F.pmod(F.xxhash64("digest", F.lit(i)), F.col("blocks")) for i in (0, 1)))
    first = materialize(
        _linked(units_of(materialize(large.select("digest", "cluster", "known", F.explode(deals.cast("array<bigint>")).alias("pair")), "units")), n),
        "dealt-edges",
    )
    labels = connected_components(first)
    labelled = materialize(
        large.drop("known")
        .join(bounded(labels), F.col("digest") == F.col("node"), "left")
        .select("digest", "n", "cluster", F.coalesce("component", "digest").alias("known")),
        "labelled",
    )
    parts = labelled.groupBy("cluster", "known").agg(F.count("*").alias("rows"))
    # The largest component of each cluster that has several.
    main = materialize(
        parts.groupBy("cluster")
        .agg(F.count("*").alias("labels"), F.max_by("known", F.struct("rows", "known")).alias("main"))
        .where("labels > 1")
        .select("cluster", "main"),
        "main-components",
    )
    if not main.limit(1).count():
        return small.unionByName(first)
    left = labelled.join(bounded(main), "cluster").withColumn("rest", (F.col("known") != F.col("main")).cast("int"))
    counted = materialize(
        left.groupBy("cluster")
        .agg(*(f(F.when(F.col("rest") == r, x)).alias(f"{name}{r}") for r in (0, 1) for name, f, x in (("rows", F.count, F.lit(1)), ("entries", F.sum, F.col("n")))))
        .select("cluster", *(_blocks_of(F.col(f"rows{r}"), F.coalesce(f"entries{r}", F.lit(0))).alias(f"k{r}") for r in (0, 1))),
        "pair-sizes",
    )
    k0, k1, i, j = F.col("k0").cast("long"), F.col("k1").cast("long"), F.col("i"), F.col("j")
    own = F.pmod(F.xxhash64("digest", F.lit(2)), F.when(F.col("rest") == 1, k1).otherwise(k0))
    # Blocks 0 to k1 - 1 are the rest, the others the main component; units are pairs of
    # which one at least is of the rest. A row of the main component meets every block of the rest.
    paired = (
        left.join(bounded(counted), "cluster")
        .withColumn("i", F.when(F.col("rest") == 1, own).otherwise(k1 + own))
        .withColumn("j", F.explode(F.when(F.col("rest") == 1, F.sequence(zero, k1 + k0 - 1)).otherwise(F.sequence(zero, k1 - 1))))
        .withColumn("pair", F.least(i, j) * (k0 + k1) + F.greatest(i, j))
        .select("digest", "cluster", "known", "pair")
    )
    return small.unionByName(first).unionByName(_linked(units_of(materialize(paired, "units")), n))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64, keep_key: bool = False) -> DataFrame:
    """Components of texts whose 5-word shingle sets have a Jaccard similarity of at least 0.8.

    Returns one row per input row: id, n_shingles, component_id (the smallest id
    of the row's component); with keep_key also key, a hash of the text, and
    component, a name of the component (null without words).

    Null text counts as empty; texts without words have no shingles and link with
    nothing; a null id stays null and names no component (it takes the smallest
    other id, if there is one); repeated rows are one set; an empty table gives
    an empty result. Other columns are ignored. Ids are longs. Shingles are told
    apart by 64-bit hashes, sets by two of them: name_bits of the first, and the
    second wherever sets share the first.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    naming = Naming(bits=name_bits)
    docs = materialize(rows.mapInArrow(_name_sets(naming), "id long, n long, digest long, other long, key long"), "sets")
    # Different sets with one first digest: about (sets ** 2) / 2 ** 65 of them.
    twins = docs.groupBy("digest").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("digest")
    if clashes := [r["digest"] for r in twins.collect()]:
        naming = Naming(frozenset(clashes), name_bits)
        docs = docs.withColumn("digest", F.when(F.col("digest").isin(clashes), F.col("other")).otherwise(F.col("digest")))
    blocks = max(n, -(-docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_ENTRIES))
    # Step 1: rows that can link.
    kept = materialize(
        rows.select("text")
        .mapInArrow(_text_blocks(blocks, naming), _BLOCK)
        .repartitionById(blocks, F.col("block"))
        .mapInArrow(_count_shared, "chunk long, counts binary, digests binary")
        .repartition(n, "chunk")
        .mapInArrow(_keep_rows, "digest long")
        .distinct(),
        "kept",
    )
    shared = spark.sparkContext.broadcast(_row_filter(kept))
    sets = materialize(
        rows.select("text")
        .mapInArrow(_kept_sets(shared, naming), "digest long, n long, hashes binary")
        .groupBy("digest")
        .agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")),
        "kept-sets",
    )
    # Step 2: candidate clusters.
    blocks = max(n, -(-sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_ENTRIES))
    entries = sets.mapInArrow(_set_blocks(blocks), _ENTRIES)
    ranked = entries.where("block >= 0").repartitionById(blocks, F.col("block")).mapInArrow(_rank, _ENTRIES)
    stars = materialize(
        entries.where("block < 0").unionByName(ranked).repartition(n, "chunk").mapInArrow(_prefixes(blocks), "kind int, a long, b long"), "stars"
    )
    meet = max(n, -(-stars.where("kind = 1").count() // BLOCK_ENTRIES))
    met = (
        stars.where("kind = 1")
        .select("a", "b", F.pmod("a", F.lit(meet)).cast("int").alias("part"))
        .repartitionById(meet, F.col("part"))
        .mapInArrow(_meet, "a long, b long")
    )
    clusters = connected_components(stars.where("kind = 0").select("a", "b").unionByName(met))
    # Step 3: exact overlaps within clusters.
    linked = connected_components(_verified_edges(sets, clusters, n))
    # The smallest id of each set, then of each component; single rows stand for themselves.
    least = docs.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    named = (
        least.join(bounded(linked), F.col("digest") == F.col("node"), "left")
        .where("copies > 1 or node is not null")
        .select("digest", "least", F.coalesce("component", "digest").alias("component"))
    )
    named = materialize(named, "named")
    smallest = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    names = materialize(
        named.join(bounded(smallest), "component").select(F.col("digest").alias("d"), "component", "component_id"), "component-names"
    )
    return docs.join(bounded(names), F.col("digest") == F.col("d"), "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        *(["key", F.coalesce("component", "digest").alias("component")] if keep_key else []),
    )
