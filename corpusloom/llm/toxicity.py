"""Toxicity scores of whole texts by a bidirectional gated recurrent network.

The network (see gru) is trained on a bounded sample of labelled texts on the
driver; scoring is one pass over the texts that moves nothing but the scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import gru, tokens
from corpusloom.llm.worker import give_back, kept, task

THRESHOLD = 0.3


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample."""

    toxic: int = 600
    clean: int = 2000
    #: Texts longer than this are not trained on (all texts are scored whole).
    max_chars: int = 50_000
    #: So many times the sample is drawn, since copies are dropped from it.
    spare: float = 1.5


def held_out(id_col: Column) -> Column:
    """Rows whose label is never learned: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, sample: Sample, id_col: str, text_col: str, label_col: str
) -> tuple[list[str], np.ndarray]:
    """At most sample.toxic and sample.clean distinct texts, by a hash of their ids.

    Of an id with both labels the toxic one counts.
    """
    known = (
        labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .withColumn("rank", F.xxhash64("label_id", F.lit(13)))
    )
    drawn = None
    for value, n in ((1, sample.toxic), (0, sample.clean)):
        part = known.where(F.col("label") == value).orderBy("rank", "label_id").limit(int(n * sample.spare))
        drawn = part if drawn is None else drawn.unionByName(part)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The drawn ids are bounded by the sample: they go to the texts, not the texts to them.
    rows = (
        docs.select(F.col(id_col).alias("doc"), text.alias("text"))
        .where(F.length("text") <= sample.max_chars)
        .join(F.broadcast(drawn), F.col("doc") == F.col("label_id"))
        # Of an id with several texts the first one counts: no more rows come than were drawn.
        .groupBy("rank", "doc", "label")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    texts, found, seen = [], [], set()
    left = {1: sample.toxic, 0: sample.clean}
    for r in sorted(rows, key=lambda r: (r["rank"], r["doc"], r["text"])):
        if r["text"] not in seen and left[r["label"]]:
            seen.add(r["text"])
            left[r["label"]] -= 1
            texts.append(r["text"])
            found.append(r["label"])
    return texts, np.array(found, np.int64)


def _scorer(shared, name: str, score_col: str):
    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = kept("toxicity")
        if name not in ready:  # the model that this worker used last, with its look-up tables
            ready.clear()
            ready[name] = (shared.value, shared.value.tables())
        model, tables = ready[name]
        for batch in batches:
            runs = tokens.text_runs(batch, batch.num_columns - 1, 1_000_000)
            scores = [gru.score_texts(model, tables, texts) for _, texts in runs]
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], score_col])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: Sample = Sample(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> gru.Model:
    """Train the network on a bounded sample of the labelled texts that are not held out.

    Ids, languages and sources are no inputs. Null texts count as empty, null
    labels and labels other than 0 and 1 are ignored; without both labels the
    model stays untrained and its scores are low.
    """
    model = gru.train(*training_sample(docs, labels, sample, id_col, text_col, label_col))
    give_back()
    return model


def score(
    df: DataFrame, model: gru.Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), score_col: str = "score"
) -> DataFrame:
    """The columns `keep` and score_col, a score in 0 to 1 of each row's whole text.

    All overlapping windows of a text are scored and the highest counts. A null or
    empty text is one empty window; repeated rows get equal scores; an empty table
    gives an empty result. The text may be among the kept columns; a kept column
    named score_col gives way to the score.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept_columns = [F.col(f"`{c}`") for c in keep if c != score_col]
    schema = df.select(*kept_columns).schema.add(score_col, "double")
    used = {c.lower() for c in df.columns}
    whole = next(c for i in range(len(used) + 1) if (c := f"text{i}") not in used)
    rows = df.select(*kept_columns, text.alias(whole))
    shared = df.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scorer(shared, uuid.uuid4().hex, score_col), schema)
