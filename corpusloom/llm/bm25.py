"""Sharded BM25 inverted index over token ids, and exact search of a query set in it.

A shard's postings are kept in two layouts: those of common ids (in at least one of
COMMON documents of the corpus) as columns of a matrix with a row per document, all
others as lists. Scores of a block of queries against a shard are one matrix product
and the lists' contributions, over all ids of a query. Where each query knows a score
that its best reach, blocks of documents whose largest weights cannot add up to it are
left out, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.storage import materialize
from corpusloom.llm.worker import task

K1, B = 1.2, 0.75
#: Postings of ids that stand in one of so many documents are matrix columns.
COMMON = 64
#: Every row whose id is divisible by it is a query of the search over all shards.
QUERY_EVERY = 20
#: Neighbours of a query.
NEIGHBOURS = 8
#: Documents and ids of a shard that is searched.
SHARD_DOCS, SHARD_IDS = 4096, 4_000_000
#: Bytes of the query ids that go to the tasks at once; queries that are multiplied at once.
BLOCK_BYTES, QUERY_ROWS = 16 << 20, 512
#: Documents that are skipped together where none of them can be among the best.
BLOCK_DOCS = 64
#: An id that fewer queries of those have is added query by query; rounds that bring like queries together.
FEW, ROUNDS = 8, 8
#: The share of documents that tells each query which scores can be among the best.
FLOOR_SHARE = 8
#: The smallest score above 0.
POSITIVE = np.nextafter(np.float32(0), np.float32(1))


@dataclass(frozen=True)
class Corpus:
    """Statistics of the whole corpus: one value per id of the vocabulary."""

    idf: np.ndarray
    mean_length: float
    #: Matrix column of a common id, -1 for the others.
    column: np.ndarray
    columns: int

    @staticmethod
    def of(df_of: np.ndarray, docs: int, total: int, end_id: int | None = None) -> Corpus:
        """df_of: documents that hold each id; total: ids of all documents. The end id, which all documents have, weighs nothing."""
        idf = np.log1p((docs - df_of + 0.5) / (df_of + 0.5)).astype(np.float32)
        if end_id is not None and end_id < len(idf):
            idf[end_id] = 0
        common = np.flatnonzero(df_of * COMMON >= max(docs, 1))
        column = np.full(len(df_of), -1, np.int32)
        column[common] = np.arange(len(common))
        return Corpus(idf, total / docs if docs else 0.0, column, len(common))


def pair_keys(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """(document, id) pairs as sortable keys and the bits of the id; 32-bit keys where they suffice."""
    if len(n) < 1 << 16 and (not len(flat) or flat.max() < 1 << 16):
        return np.repeat(np.arange(len(n), dtype=np.uint32) << np.uint32(16), n) | flat.astype(np.uint32), 16
    return np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | flat.astype(np.uint64), 32


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique hashes integers where no counts are asked for, which takes several times as long."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, in a row."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)


def places(doc: np.ndarray, at: np.ndarray, m: int, columns: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(place of each of m queries, value of each common id): like ones lie near each other.

    doc, at: the pairs of a query and a common id. A query's place is the mean of its ids'
    values and an id's value the mean of its queries' places, again and again: languages
    and other groups with ids of their own part.
    """
    columns = max(columns, int(at.max()) + 1 if len(at) else 0)
    value = np.sin(np.arange(columns) * 12.9898)
    size, count = np.maximum(np.bincount(doc, minlength=m), 1), np.maximum(np.bincount(at, minlength=columns), 1)
    place = np.zeros(m)
    for _ in range(ROUNDS if len(at) else 0):
        place = np.bincount(doc, value[at], m) / size
        place -= np.average(place, weights=size)
        value = np.bincount(at, place[doc], columns) / count
        value /= max(np.abs(value).max(), 1e-300)
    return place, value


def alike(doc: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """An order of m queries in which those with like common ids (doc, at: their pairs) stand together."""
    return np.argsort(places(doc, at, m)[0], kind="stable")


class Queries:
    """Distinct ids of documents that are searched for, dealt to the two layouts."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, m: int, corpus: Corpus):
        """doc, term: distinct pairs in order of doc."""
        self.m = m
        at = corpus.column[term]
        common = at >= 0
        self.first = np.searchsorted(doc[common], np.arange(m + 1))
        self.doc, self.at = doc[common], at[common]
        self.columns = corpus.columns
        order = np.argsort(term[~common], kind="stable")
        self.rare_term, self.rare_doc = term[~common][order], doc[~common][order]

    def rows(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Common ids of the queries a to b: the columns that at least FEW of them have, 1 for each
        of their ids there, and the (query, column) pairs of all other columns."""
        i, j = self.first[a], self.first[b]
        doc, at = self.doc[i:j] - a, self.at[i:j]
        held = np.bincount(at, minlength=self.columns) >= FEW
        columns = np.flatnonzero(held)
        out = np.zeros((b - a, len(columns)), np.float32)
        many = held[at]
        out[doc[many], (np.cumsum(held) - 1)[at[many]]] = 1
        return columns, out, doc[~many], at[~many]


class ShardIndex:
    """BM25 inverted index of a shard's documents."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, corpus: Corpus, value: np.ndarray | None = None):
        """value: one for each column; documents are numbered by the mean of their columns' values, and order has their rows."""
        key, bits = pair_keys(flat, n)
        key, tf = np.unique(key, return_counts=True)
        self.docs = len(n)
        self.doc = (key >> key.dtype.type(bits)).astype(np.int64)
        self.term = (key & key.dtype.type((1 << bits) - 1)).astype(np.int64)
        norm = K1 * (1 - B + B * n[self.doc] / max(corpus.mean_length, 1e-9))
        weight = (corpus.idf[self.term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        at = corpus.column[self.term]
        common = at >= 0
        self.order = np.arange(self.docs)
        if value is not None:
            each = np.bincount(self.doc[common], minlength=self.docs)
            self.order = np.argsort(np.bincount(self.doc[common], value[at[common]], self.docs) / np.maximum(each, 1), kind="stable")
            place = np.empty(self.docs, np.int64)
            place[self.order] = np.arange(self.docs)
            self.doc = place[self.doc]
        #: A row per common id.
        self.matrix = np.zeros((corpus.columns, self.docs), np.float32)
        self.matrix[at[common], self.doc[common]] = weight[common]
        #: A document's score against itself.
        self.own = np.bincount(self.doc, weight, self.docs).astype(np.float32)
        self.rare_doc, self.rare_term, self.rare_weight = self.doc[~common], self.term[~common], weight[~common]

    def rare(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, weight) of every meeting in the lists, in order of the blocks of queries."""
        a = np.searchsorted(queries.rare_term, self.rare_term, "left")
        n = np.searchsorted(queries.rare_term, self.rare_term, "right") - a
        q = queries.rare_doc[ranges(a, n)]
        # Short keys are sorted by radix.
        block = q // QUERY_ROWS
        order = np.argsort(block.astype(np.uint16) if queries.m < QUERY_ROWS << 16 else block, kind="stable")
        return q[order], np.repeat(self.rare_doc, n)[order], np.repeat(self.rare_weight, n)[order]

    def scores(self, queries: Queries) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, scores of a block of queries by document)."""
        q, d, w = self.rare(queries)
        ends = np.cumsum(np.bincount(q // QUERY_ROWS, minlength=-(-queries.m // QUERY_ROWS)))
        for a in range(0, queries.m, QUERY_ROWS):
            b = min(a + QUERY_ROWS, queries.m)
            columns, ones, few, at = queries.rows(a, b)
            out = ones @ self.matrix[columns]
            for x, c in zip(few.tolist(), at.tolist(), strict=True):
                out[x] += self.matrix[c]
            j = int(ends[a // QUERY_ROWS])
            i = int(ends[a // QUERY_ROWS - 1]) if a else 0
            np.add.at(out.reshape(-1), (q[i:j] - a) * self.docs + d[i:j], w[i:j])
            yield a, out

    def hits(self, queries: Queries, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document, score) of all scores above 0 that reach the floor of their query.

        The largest weight of each id among BLOCK_DOCS documents bounds their scores: a
        query is multiplied only with the blocks whose bound reaches its floor.
        """
        q, d, w = self.rare(queries)
        ends = np.cumsum(np.bincount(q // QUERY_ROWS, minlength=-(-queries.m // QUERY_ROWS)))
        starts = np.arange(0, self.docs, BLOCK_DOCS)
        width = len(starts) * BLOCK_DOCS
        most = np.maximum.reduceat(self.matrix, starts, axis=1)
        for a in range(0, queries.m, QUERY_ROWS):
            b = min(a + QUERY_ROWS, queries.m)
            columns, ones, few, at = queries.rows(a, b)
            # What lists and ids of few queries add is summed first, and exact in the bound.
            rest = np.zeros((b - a, width), np.float32)
            for x, c in zip(few.tolist(), at.tolist(), strict=True):
                rest[x, : self.docs] += self.matrix[c]
            j = int(ends[a // QUERY_ROWS])
            i = int(ends[a // QUERY_ROWS - 1]) if a else 0
            np.add.at(rest.reshape(-1), (q[i:j] - a) * width + d[i:j], w[i:j])
            least = np.maximum(floor[a:b], POSITIVE)
            bound = ones @ most[columns] + rest.reshape(b - a, len(starts), BLOCK_DOCS).max(2)
            # Sums may be rounded otherwise.
            live = bound * np.float32(1 + 1e-4) >= least[:, None]
            for k in np.flatnonzero(live.any(0)).tolist():
                first, last = int(starts[k]), min(int(starts[k]) + BLOCK_DOCS, self.docs)
                rows = np.flatnonzero(live[:, k])
                out = ones[rows] @ self.matrix[columns, first:last] + rest[rows, first:last]
                # One comparison, and places in one row: those of a matrix are found much slower.
                found = np.flatnonzero(out >= least[rows][:, None])
                x, y = np.divmod(found, last - first)
                yield rows[x] + a, y + first, out.reshape(-1)[found]

    def all_scores(self, corpus: Corpus) -> np.ndarray:
        """Scores of the shard's documents against each other."""
        return np.concatenate([s for _, s in self.scores(Queries(self.doc, self.term, self.docs, corpus))])


class Best:
    """The k best documents of each query so far: by score, then by row."""

    def __init__(self, rows: np.ndarray, floor: np.ndarray, k: int):
        self.rows, self.k, self.floor = rows, k, floor.astype(np.float32)
        self.query, self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
        #: Score by the document's score against itself.
        self.share = np.zeros(0, np.float32)

    def add(self, index: ShardIndex, rows: np.ndarray, queries: Queries) -> None:
        """rows: of the index's documents."""
        parts = [(self.query, self.score, self.row, self.share)]
        whole = np.maximum(index.own, np.float32(1e-9))
        if index.docs > self.k and not self.floor.any():
            found = self._first(index, rows, queries)
        else:
            found = index.hits(queries, self.floor)
        for q, d, score in found:
            # A document is no neighbour of itself.
            other = self.rows[q] != rows[d]
            q, d, score = q[other], d[other], score[other]
            parts.append((q, score, rows[d], score / whole[d]))
        query, score, row, share = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.row, self.share = query[keep], score[order][keep], row[order][keep], share[order][keep]
        last = place[keep] == self.k - 1
        self.floor[self.query[last]] = np.maximum(self.floor[self.query[last]], self.score[last])

    def _first(self, index: ShardIndex, rows: np.ndarray, queries: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The hits while no query has a floor: from k + 1 scores on, since one may be the query's own."""
        k = min(self.k + 1, index.docs)
        for a, s in index.scores(queries):
            floor = np.partition(s, index.docs - k, 1)[:, index.docs - k]
            at = np.flatnonzero(s >= np.maximum(floor, POSITIVE)[:, None])
            q, d = np.divmod(at, index.docs)
            yield q + a, d, s.reshape(-1)[at]


def arrays(batch: pa.RecordBatch, ids: str, width: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch in a row, and how many each document has."""
    parts = [
        np.frombuffer(x.as_buffer(), "<u2" if w == 2 else "<u4")
        for x, w in zip(batch.column(ids), batch.column(width).to_pylist(), strict=True)
    ]
    return (np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)), np.array(list(map(len, parts)), np.int64)


def shards(batches: Iterator[pa.RecordBatch], docs: int = SHARD_DOCS, ids: int = SHARD_IDS) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many documents and ids (or one document); column n has each row's ids."""
    for batch in batches:
        sizes = batch.column("n").to_pylist()
        first = held = 0
        for i, n in enumerate(sizes):
            if i > first and (i - first == docs or held + n > ids):
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if len(sizes) > first:
            yield batch.slice(first)


@task("packing")
def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, distinct ids (u4) of each document."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            flat, n = arrays(part, "ids", "width")
            ends = np.cumsum(n)
            terms = [distinct(flat[e - k : e]).astype("<u4").tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(terms, pa.binary())], names=["row", "terms"])


_FOUND = "query long, row long, score float, share float"


def _searcher(shared, k: int):
    @task("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, value, rows, sizes, terms, floor = shared.value
        doc = np.repeat(np.arange(len(rows)), sizes)
        queries, best = Queries(doc, terms.astype(np.int64), len(rows), corpus), Best(rows, floor, k)
        for part in shards(batches):
            flat, n = arrays(part, "ids", "width")
            index = ShardIndex(flat, n, corpus, value)
            best.add(index, part.column("row").to_numpy(zero_copy_only=False)[index.order], queries)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[best.query]), pa.array(best.row), pa.array(best.score), pa.array(best.share)],
            names=["query", "row", "score", "share"],
        )

    return run


def search(coded: DataFrame, corpus: Corpus, every: int = QUERY_EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """The k best documents, out of all, for every document whose id is divisible by `every`.

    coded: id, row (unique), n, width, ids. Returns query, row (both rows of coded), score,
    share (of the score that row has against itself) and place (1 is the best; ties go to
    the smaller row). Documents that share no id with a
    query are not its neighbours.

    All shards are searched, in as many passes over `coded` as the queries' ids have
    blocks of BLOCK_BYTES: the work grows with queries times documents, what one task
    or the driver holds does not. A share of the documents is searched first; its k-th
    best score is a lower bound of the final one, so that a task that searches the rest returns few rows.
    """
    spark = coded.sparkSession
    queries = materialize(
        coded.where(F.col("id") % every == 0).select("row", "width", "ids").mapInArrow(_query_terms, "row long, terms binary"), "queries"
    )
    blocks = max(1, -(-queries.agg(F.coalesce(F.sum(F.octet_length("terms")), F.lit(0))).first()[0] // BLOCK_BYTES))
    docs = coded.select("row", "n", "width", "ids")
    # Written apart, so that it has as few partitions as rows, and each returns k rows a query.
    drawn = F.pmod(F.xxhash64("row"), F.lit(FLOOR_SHARE)) == 0
    share, rest = materialize(docs.where(drawn), "packing-share"), docs.where(~drawn)
    share = share.coalesce(max(1, -(-docs.rdd.getNumPartitions() // FLOOR_SHARE)))
    found = None
    for b in range(blocks):
        # One block of queries at a time reaches the driver, and from there the tasks.
        block = queries.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)) == b).toArrow()
        rows = block.column("row").to_numpy()
        terms = [np.frombuffer(x.as_buffer(), "<u4") for x in block.column("terms")]
        sizes = np.array([len(x) for x in terms], np.int32)
        flat = np.concatenate([np.zeros(0, "<u4"), *terms])
        at, doc = corpus.column[flat], np.repeat(np.arange(len(rows)), sizes)
        place, value = places(doc[at >= 0], at[at >= 0], len(rows), corpus.columns)
        order = np.argsort(place, kind="stable")
        rows, sizes, terms = rows[order], sizes[order], np.concatenate([np.zeros(0, "<u4"), *(terms[i] for i in order.tolist())])
        floor = np.zeros(len(rows), np.float32)
        if len(rows):
            shared = spark.sparkContext.broadcast((corpus, value, rows, sizes, terms, floor))
            first = materialize(share.mapInArrow(_searcher(shared, k), _FOUND), "packing-first")
            low = (
                first.groupBy("query")
                .agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
                .where(F.size("s") >= k)
                .select("query", F.col("s")[k - 1].alias("floor"))
                .toArrow()
            )
            order = np.argsort(rows)
            floor[order[np.searchsorted(rows, low.column("query").to_numpy(), sorter=order)]] = low.column("floor").to_numpy()
            floor *= np.float32(1 - 1e-5)  # sums of other shards may be rounded otherwise
            shared.unpersist()
        shared = spark.sparkContext.broadcast((corpus, value, rows, sizes, terms, floor))
        part = rest.mapInArrow(_searcher(shared, k), _FOUND).unionByName(first) if len(rows) else docs.where("false").select(
            F.col("row").alias("query"), "row", *(F.lit(0.0).cast("float").alias(c) for c in ("score", "share"))
        )
        ranked = part.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row")))
        part = materialize(ranked.where(F.col("place") <= k), "neighbours")
        found = part if found is None else found.unionByName(part)
    return found
