"""Retrieval packing: windows filled with lexical neighbours.

Texts are encoded once into a scratch table. Document frequencies of all token
ids are counted over the whole corpus (at most one row per id of the vocabulary).

Seeds of the first kind are the documents whose id is divisible by QUERY_EVERY:
each is searched for in all shards of the BM25 index (see bm25), whatever their
number. A document that several seeds found goes to the one that scored it best,
unless it has copies of its own, and is put behind that seed.

All other documents are brought together by bands of weighted min-hashes; a
band's value that two documents share is a bucket, and buckets are counted over
the whole corpus. A document goes to the largest of its buckets that hash pairs
make, failing those to the largest that single hashes make. Documents are
ordered by bucket and cut into shards, each with its own BM25 index.

A seed opens a window with all it has left, and the unused neighbours that the
index returns fill it, best first, among them the documents that were put behind
it, which no other seed gets before. The one that does not fit is cut, and its
rest is the next seed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import bm25, tokens
from corpusloom.llm.bm25 import Corpus, ShardIndex, arrays, distinct, pair_keys, ranges
from corpusloom.llm.storage import bounded, materialize
from corpusloom.llm.worker import task

WINDOW = 1024
#: Documents and ids of a shard that is packed: they bound a task's memory, whatever the corpus.
SHARD_DOCS, SHARD_IDS = 1024, 4_000_000
#: Neighbours that a shard's index returns at a time; when they are used up the next ones follow.
NEIGHBOURS = 8
#: Share of a document's weight that a seed must have to take it out of a bucket.
CLAIM = 0.5
#: Min-hashes of a document; each two of them make a band, and so does the first of the two.
HASHES = 6


class Signer:
    """Bands of weighted min-hashes of documents' ids.

    Later ids of a merged vocabulary are rarer, so an id's weight grows with the
    logarithm of its number: two documents agree in a hash with about the share of
    weight that they have in common.
    """

    def __init__(self):
        self.rank = np.zeros((HASHES, 0), np.uint32)

    def _grow(self, size: int) -> None:
        ids = np.arange(size, dtype=np.uint64)
        weight = np.log(np.maximum(ids, 257) / 256.0)
        rows = []
        for h in range(HASHES):
            u = (_mixed(ids + np.uint64((h + 1) << 40)) >> np.uint64(11)).astype(np.float64)
            # Positive floats have the order of their bits; the last value is left for empty texts.
            rows.append((-np.log((u + 0.5) / 2.0**53) / weight).astype(np.float32).view(np.uint32))
        self.rank = np.stack(rows)

    def bands(self, flat: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A row per document: the bands of hash pairs, then those of single hashes. The last id of each document is its end id, which has no part."""
        if int(flat.max()) >= self.rank.shape[1]:
            self._grow(max(1 << 16, 2 * int(flat.max())))
        low = []
        for rank in self.rank:
            value = rank[flat]
            value[ends - 1] = np.uint32(0xFFFFFFFF)
            low.append(np.minimum.reduceat(value, ends - n).astype(np.uint64))
        pairs = [(a << np.uint64(32)) | b for a, b in zip(low[::2], low[1::2], strict=True)]
        found = [_mixed(_mixed(x) + np.uint64(i + 1)) for i, x in enumerate([*pairs, *low[::2]])]
        return np.stack(found, axis=1).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit mix of each value (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tokenize(path: str, keep_space: bool, end_id: int):
    @task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, keep_space).encode
        signer = Signer()
        for batch in batches:
            for i, texts in tokens.text_runs(batch, 1):
                flat, n = encode(texts)
                flat = np.insert(flat, np.cumsum(n), end_id).astype(np.uint32)
                n = n + 1
                ends = np.cumsum(n)
                small = flat.astype("<u2") if flat.max() < 1 << 16 else flat.astype("<u4")
                width = small.dtype.itemsize
                offsets = pa.array(np.concatenate([[0], ends * width]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i : i + len(texts)].cast(pa.int64()),
                        batch.column(2)[i : i + len(texts)],
                        pa.array(n),
                        pa.array(np.full(len(n), width, np.int32)),
                        pa.FixedSizeListArray.from_arrays(pa.array(signer.bands(flat, ends, n).ravel()), HASHES).cast(pa.list_(pa.int64())),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(small.tobytes())]),
                    ],
                    names=["id", "row", "n", "width", "bands", "ids"],
                )

    return run


@task("packing")
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each id, once a partition."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            flat, n = arrays(batch.slice(at, 512), "ids", "width")
            key, bits = pair_keys(flat, n)
            term = distinct(key) & key.dtype.type((1 << bits) - 1)
            count = np.bincount(term)
            if len(count) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(count) - len(seen), np.int64)])
            seen[: len(count)] += count
    term = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(seen[term])], names=["term", "n"])


def neighbours(score: np.ndarray, free: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Free documents by score, best first, ties by place; those that share nothing are left out."""
    score = np.where(free, score, 0)
    best = np.argpartition(-score, k)[:k] if len(score) > k else np.arange(len(score))
    best = best[np.lexsort((best, -score[best]))]
    return best[score[best] > 0]


def pack_shard(flat: np.ndarray, n: np.ndarray, corpus: Corpus, window: int, leader: np.ndarray | None = None):
    """Pieces (doc, start, length, window number, offset) that hold every id of the shard once.

    leader: for each document the one that it was put behind, or itself. Whole
    windows of a document stand alone; what is left of each document is dealt
    into shared windows, all of which are full but the last.
    """
    full = n // window
    doc = np.repeat(np.arange(len(n)), full)
    pieces = [(int(d), int(s) * window, window, w, 0) for w, (d, s) in enumerate(zip(doc, ranges(np.zeros(len(n), np.int64), full), strict=True))]
    number = len(pieces)
    at, left = (full * window).tolist(), (n - full * window).tolist()
    free = np.array([x > 0 for x in left], bool)
    if not free.any():
        return pieces
    scores = ShardIndex(flat, n, corpus).all_scores(corpus)
    behind: dict[int, list[int]] = {}
    # Those behind a seed are kept for it until it is used.
    open_to_all = np.ones(len(n), bool)
    if leader is not None:
        for d in np.flatnonzero((leader != np.arange(len(n))) & free & free[leader]).tolist():
            behind.setdefault(int(leader[d]), []).append(d)
            open_to_all[d] = False

    def used(d: int) -> None:
        free[d] = False
        open_to_all[behind.pop(d, [])] = True

    first = 0
    seed: int | None = None
    while True:
        if seed is None:
            while first < len(n) and not free[first]:
                first += 1
            if first == len(n):
                return pieces
            seed = first
        # The seed opens a window with all it has left.
        used(seed)
        pieces.append((seed, at[seed], left[seed], number, 0))
        size, last = left[seed], None
        queue: list[int] = []
        while size < window:
            if not queue:
                queue = neighbours(scores[seed], free & open_to_all).tolist()
                if not queue:  # nobody that is left shares an id with the seed: the next one in order
                    rest = np.flatnonzero(free)
                    if not len(rest):
                        break
                    queue = [int(rest[0])]
            d = queue.pop(0)
            if not free[d]:
                continue
            take = min(left[d], window - size)
            pieces.append((d, at[d], take, number, size))
            size += take
            at[d] += take
            left[d] -= take
            used(d)
            if left[d]:
                last = d
        number += 1
        seed = last


def buckets(coded: DataFrame) -> DataFrame:
    """(row, bucket) of the documents that share a band with another one, anywhere in the corpus.

    A bucket is a number whose highest bits tell hash pairs from single hashes,
    the next ones the documents of the bucket and the lowest ones the band's value,
    so that the largest number is the bucket to go to.
    """
    each = coded.select("row", F.posexplode("bands").alias("band", "key"))
    shared = materialize(each.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1"), "packing-shared")
    pair = F.shiftleft((F.col("band") < HASHES // 2).cast("long"), 62)
    size = F.shiftleft(F.least("docs", F.lit((1 << 22) - 1)), 40)
    value = F.col("key").bitwiseAND(F.lit((1 << 40) - 1))
    return each.join(bounded(shared), "key").groupBy("row").agg(F.max(pair + size + value).alias("bucket"))


def claims(found: DataFrame, coded: DataFrame, placed: DataFrame, every: int) -> DataFrame:
    """(row, bucket, sig, lead, leader, place): where a document that a seed found is put.

    It goes to the seed of the best score (ties: the smaller row). Seeds stay where
    they are, and so do documents whose bucket is made by hash pairs (they have
    copies) and others that have a bucket and less than CLAIM of their weight in
    common with the seed.
    """
    best = found.groupBy("row").agg(F.max(F.struct("score", -F.col("query"), -F.col("place"), "share")).alias("b")).select(
        "row", (-F.col("b.col2")).alias("leader"), (-F.col("b.col3")).alias("place"), F.col("b.share").alias("share")
    )
    own = coded.select("row", "id", F.col("bands")[0].alias("sig")).where(F.col("id") % every == 0)
    at = placed.withColumnRenamed("row", "r")
    seeds = own.join(at, F.col("row") == F.col("r"), "left").select(
        F.col("row").alias("leader"), F.coalesce("bucket", F.lit(0)).alias("bucket"), "sig", F.col("id").alias("lead")
    )
    here = placed.select("row", F.col("bucket").alias("mates"))
    moved = (
        best.join(own.select("row"), "row", "left_anti")
        .join(here, "row", "left")
        .where(F.col("mates").isNull() | ((F.col("mates") < 1 << 62) & (F.col("share") >= CLAIM)))
    )
    return moved.join(seeds, "leader").select("row", "bucket", "sig", "lead", "leader", "place")


def _families(batches: Iterator[pa.RecordBatch], docs: int, ids: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows that make a shard.

    A shard takes up to an eighth more than its documents to end with a bucket;
    a document is never parted from the seed before it.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    last = (None, None)
    for batch in batches:
        first = 0
        for i, (n, *place) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("n", "leader", "bucket")), strict=True)):
            due = rows >= docs and place[1] != last[1] or rows >= docs + docs // 8 or size + n > ids
            if rows and due and place[0] != last[0]:
                held.append(batch.slice(first, i - first))
                yield held
                held, rows, size, first = [], 0, 0, i
            rows, size, last = rows + 1, size + n, place
        held.append(batch.slice(first))
    if rows:
        yield held


def _packer(corpus: Corpus, window: int, shard_docs: int, shard_ids: int, with_ids: bool):
    @task("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for held in _families(batches, shard_docs, shard_ids):
            parts = [arrays(b, "ids", "width") for b in held]
            flat, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            table = pa.Table.from_batches([b.select(["id", "row", "leader"]) for b in held])
            row, leader = (table.column(k).to_numpy() for k in ("row", "leader"))
            order = np.argsort(row)
            at = order[np.minimum(np.searchsorted(row, leader, sorter=order), len(row) - 1)]
            at = np.where(row[at] == leader, at, np.arange(len(row)))
            pieces = np.array(pack_shard(flat, n, corpus, window, at), np.int64)
            doc, start, length, number, offset = pieces.T
            begin = (np.cumsum(n) - n)[doc] + start
            data = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            crc = [zlib.crc32(data[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            id_of = table.column("id").take(pa.array(doc)).combine_chunks()
            out = [id_of, *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], first + number, offset))]
            if with_ids:
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                ids = np.concatenate([flat[b : b + k] for b, k in zip(begin.tolist(), length.tolist(), strict=True)])
                out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view(np.int32))))
                names.append("ids")
            first += int(number.max()) + 1
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def pack(
    df: DataFrame,
    tokenizer_path: str,
    keep_space: bool = True,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard_docs: int = SHARD_DOCS,
    with_ids: bool = True,
    every: int = bm25.QUERY_EVERY,
) -> DataFrame:
    """Pack whole texts into sequences of at most `window` token ids.

    A document is its ids followed by end_id. Returns one row per piece: id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the
    piece's ids. Every id lies in exactly one piece; all sequences are full but
    the last of a shard.

    Null text counts as empty (a document of end_id only); null ids stay null;
    repeated rows are packed each; documents that tie in score are taken in
    bucket order; an empty table gives an empty result; a document longer
    than the window is cut. Other columns are ignored. The ids of one text may
    take 2 GiB. every: documents whose id it divides are searched for in all
    shards, which costs their number times the documents.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    coded = materialize(
        rows.mapInArrow(
            _tokenize(tokenizer_path, keep_space, end_id), "id long, row long, n long, width int, bands array<long>, ids binary"
        ),
        "packing-ids",
    )
    docs, total = coded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most one row per id of the vocabulary reaches the driver and the tasks.
    counted = (
        coded.select("width", "ids")
        .mapInArrow(_frequencies, "term long, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    df_of = np.zeros(int(counted["term"].max()) + 1 if len(counted) else 1, np.float64)
    df_of[counted["term"].to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
    corpus = Corpus.of(df_of, docs, total, end_id)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = materialize(buckets(coded), "packing-buckets")
    moved = claims(bm25.search(coded, corpus, every), coded, placed, every)
    both = materialize(
        placed.withColumnRenamed("bucket", "own").join(moved, "row", "full").select(
            "row", F.coalesce("bucket", "own").alias("bucket"), F.col("sig").alias("at_sig"), "lead", "leader", "place"
        ),
        "packing-places",
    )
    order = ["bucket", "sig", "lead", "leader", "place", "id", "n"]
    packed = (
        coded.join(bounded(both), "row", "left")
        .select(
            "id",
            "row",
            "n",
            "width",
            "ids",
            F.coalesce("bucket", F.lit(0)).alias("bucket"),
            F.coalesce("at_sig", F.col("bands")[0]).alias("sig"),
            F.when(F.col("leader").isNull(), F.col("id")).otherwise(F.col("lead")).alias("lead"),
            F.coalesce("leader", "row").alias("leader"),
            F.coalesce("place", F.lit(0)).alias("place"),
        )
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _packer(corpus, window, shard_docs, SHARD_IDS, with_ids), schema + (", ids array<int>" if with_ids else "")
        )
    )
    return packed.withColumnRenamed("id", id_col)
