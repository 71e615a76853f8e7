"""Long recordings cut into units at the pauses beside the borders of their text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.segment import plan_units
from corpusloom.functions.signal import find_pause

# Seconds of a unit, tokens of a planned and of a whole one, characters, tokens a character where they are not known.
MIN_SECONDS, MAX_SECONDS = 3.0, 11.0
PLAN_TOKENS, MERGE_TOKENS, WHOLE_TOKENS = 145, 170, 160
MIN_CHARS = 10
TOKENS_PER_CHAR = 0.75
#: How often a unit that is still too long is planned anew.
DEPTH = 2


@dataclass
class Split:
    """Units (text, first sample, sample behind the last one) and what was left out, with reasons."""

    units: list[tuple[str, int, int]] = field(default_factory=list)
    dropped: list[tuple[str, str]] = field(default_factory=list)


def _faults(text: str, seconds: float) -> list[str]:
    tests = (
        ("short", seconds < MIN_SECONDS),
        ("long", seconds > MAX_SECONDS),
        ("few letters", len(text) < MIN_CHARS),
        ("latin letters", any(c.isascii() and c.isalpha() for c in text)),
    )
    return [name for name, bad in tests if bad]


def _spans(plan: list[tuple[int, int]], cuts: list[int | None], fits, end: int) -> Iterator[tuple[int, int, int, int] | tuple[int, int]]:
    """(first unit, last unit, from, to) of what is emitted; (first, last) of what is left out.

    A unit ends at the first border behind it that has a pause. While there is none it
    takes in the next unit, as long as both fit; when they no longer do, all up to the
    next border with a pause goes.
    """
    begin = first = 0
    usable = lambda k: cuts[k] is not None and begin < cuts[k] < end - 1
    while first < len(plan):
        last = first
        while last < len(plan) - 1 and not usable(last) and fits(plan[first][0], plan[last + 1][1]):
            last += 1
        if last == len(plan) - 1:
            yield first, last, begin, end
            return
        if usable(last):
            yield first, last, begin, cuts[last]
            begin, first = cuts[last], last + 1
            continue
        later = next((k for k in range(last + 1, len(plan) - 1) if cuts[k] is not None and cuts[k] > begin), None)
        yield first, len(plan) - 1 if later is None else later
        if later is None:
            return
        begin, first = cuts[later], later + 1


def split_units(text: str, samples: np.ndarray, rate: int, tokens: int | None = None, depth: int = 0) -> Split:
    """A text and its recording as units of MIN_SECONDS to MAX_SECONDS.

    A recording that fits is one unit. Else units are planned from the text alone and
    cut at pauses near their borders; one that is still too long is planned anew, up
    to DEPTH times.
    """
    out = Split()
    text = (text or "").strip()
    seconds = len(samples) / rate
    if not text or seconds < MIN_SECONDS:
        out.dropped.append(("row", "short" if text else "no text"))
        return out
    if seconds <= MAX_SECONDS and tokens is not None and tokens <= WHOLE_TOKENS:
        faults = [f for f in _faults(text, seconds) if f not in ("short", "long")]
        if faults:
            out.dropped.append(("unit 0", ", ".join(faults)))
        else:
            out.units.append((text, 0, len(samples)))
        return out
    n = len(text)
    count = tokens or TOKENS_PER_CHAR * n
    plan = plan_units(text, seconds, count, MAX_SECONDS, PLAN_TOKENS)
    if not plan:
        out.dropped.append(("row", "no units"))
        return out

    def pause(at: int) -> int | None:
        near = seconds * at / n
        found = find_pause(samples, rate, near)
        return find_pause(samples, rate, near, 1.8, 0.03) if found is None else found

    fits = lambda a, b: seconds * (b - a) / n <= MAX_SECONDS and count * (b - a) / n <= MERGE_TOKENS
    for k, span in enumerate(_spans(plan, [pause(b) for _, b in plan[:-1]], fits, len(samples))):
        if len(span) == 2:
            out.dropped.append((f"units {span[0]} to {span[1]}", "no pause"))
            continue
        first, last, i, j = span
        part, length = text[plan[first][0] : plan[last][1]].strip(), (j - i) / rate
        if length > MAX_SECONDS and depth < DEPTH and len(part) >= 2 * MIN_CHARS:
            again = split_units(part, samples[i:j], rate, None, depth + 1)
            out.units += [(t, a + i, b + i) for t, a, b in again.units]
            out.dropped += [(f"again {where}", why) for where, why in again.dropped]
        elif faults := _faults(part, length):
            out.dropped.append((f"unit {k}", ", ".join(faults)))
        else:
            out.units.append((part, i, j))
    return out


def split_recordings(df: DataFrame, key: str, text: str, samples: str, rate: str) -> DataFrame:
    """key, unit, text, first and last of every unit of the recordings; a broken row gives none and fails no other."""
    schema = df.select(key).schema.add("unit", "integer").add("text", "string").add("first", "long").add("last", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, t, r = (batch.column(c)[i] for c in (0, 1, 3))
                x = np.array(batch.column(2)[i].as_py() or [], np.float64)
                units = split_units(t.as_py(), x, r.as_py()).units if r.as_py() else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * len(units), name.type),
                        pa.array(range(len(units)), pa.int32()),
                        pa.array([u[0] for u in units], pa.string()),
                        pa.array([u[1] for u in units], pa.int64()),
                        pa.array([u[2] for u in units], pa.int64()),
                    ],
                    names=[key, "unit", "text", "first", "last"],
                )

    return df.select(key, F.col(text), F.col(samples), F.col(rate)).mapInArrow(run, schema)
