"""Retry rounds around an outside service: batches first, then single calls, within a budget.

The client is a function from a list of prompts to a reply; it may raise. The
state between rounds is a DataFrame, so a run can stop and go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.repair import parse_numbered
from corpusloom.operators.joins import small

Client = Callable[[list[str]], str]


def with_backoff(call: Callable[[], str], tries: int = 5, first: float = 3.0, most: float = 60.0, sleep=time.sleep) -> str:
    """Call again after a rate limit (429): wait first * 2**k seconds, at most `most`, or what the server asks for."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            if "429" not in str(e) or k == tries - 1:
                raise
            sleep(min(most, getattr(e, "retry_after", None) or first * 2**k))
    raise AssertionError("not reached")


def scripted_client(replies: list[str]) -> Client:
    """A client that plays back replies; 'THROW:message' raises."""
    rest = iter(replies)

    def call(prompts: list[str]) -> str:
        reply = next(rest, "THROW:plan exhausted")
        if reply.startswith("THROW:"):
            raise RuntimeError(reply[6:])
        return reply

    return call


def retry_loop(
    units: list[tuple[str, str]],
    client: Client,
    valid: Callable[[str, str], str | None],
    first_batch: int = 7,
    batch: int = 5,
    batched_rounds: int = 3,
    budget: int = 4,
) -> list[dict]:
    """Records (id, raw, out, attempts, status, reason) of the units (id, text), in input order.

    First pass in batches; a failed call costs no attempt there. Then batched
    rounds until a unit has had `batched_rounds` attempts, then one single call as
    long as the budget lasts. valid returns the reason of a failure or None.
    """
    state = {u: {"id": u, "raw": t, "out": None, "attempts": 0, "status": "failed", "reason": None} for u, t in units}

    def ask(ids: list[str]) -> list[str | None] | Exception:
        try:
            reply = client([state[i]["raw"] for i in ids])
        except Exception as e:
            return e
        if len(ids) == 1 and (line := reply.strip()):
            mode, lines = parse_numbered(reply, 1)
            return [lines[0]] if mode == "numbered" else [line]
        return parse_numbered(reply, len(ids))[1] or [None] * len(ids)

    def settle(ids: list[str], counts: bool) -> list[str]:
        got = ask(ids)
        again = []
        for k, i in enumerate(ids):
            r = state[i]
            line = None if isinstance(got, Exception) else got[k]
            r["attempts"] += int(counts or line is not None)
            reason = f"API error: {got}" if isinstance(got, Exception) else "unparsed" if line is None else valid(line, r["raw"])
            r["out"] = line
            r["reason"] = reason
            if reason is None:
                r["status"] = "ok"
            else:
                again.append(i)
        return again

    ids = [u for u, _ in units]
    waiting: list[str] = []
    for at in range(0, len(ids), first_batch):
        waiting += settle(ids[at : at + first_batch], counts=False)
    single = []
    while waiting:
        now, waiting = waiting[:batch], waiting[batch:]
        for i in settle(now, counts=True):
            (waiting if state[i]["attempts"] < batched_rounds else single).append(i)
    for i in single:
        if state[i]["attempts"] < budget:
            settle([i], counts=True)
    return [state[i] for i in ids]


RECORD = "id string, raw string, out string, attempts int, status string, reason string"


def run_retries(df: DataFrame, make_client: Callable[[], Client], valid: Callable[[str, str], str | None], **limits) -> DataFrame:
    """retry_loop over each partition of df (id, raw): every partition makes its own client."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            yield pd.DataFrame(retry_loop(list(zip(b["id"], b["raw"], strict=True)), client, valid, **limits))

    return df.select(F.col("id").cast("string").alias("id"), F.col("raw").cast("string").alias("raw")).mapInPandas(run, RECORD)


def relay(df: DataFrame, passes: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Several services in turn: each later one gets only what is not settled yet."""
    done = None
    left = df
    for run in passes:
        records = run(left)
        ok = records.where("status = 'ok'")
        left = left.join(ok.select("id"), "id", "left_anti")
        done = ok if done is None else done.unionByName(ok)
    failed = records.where("status <> 'ok'")
    return done.unionByName(failed)


def resume(inputs: DataFrame, finished: DataFrame, key: str = "id") -> DataFrame:
    """Inputs that have no finished record."""
    return inputs.join(finished.select(key).distinct(), key, "left_anti")


def dead_letters(failures: DataFrame, successes: DataFrame, key: str, side: str, cap: int) -> DataFrame:
    """Failures without a later success, and whether their side is within its cap."""
    left = failures.join(successes.select(key).distinct(), key, "left_anti")
    counts = left.groupBy(side).agg(F.count("*").alias("dead"))
    return left.join(small(counts), side).withColumn("within_cap", F.col("dead") <= cap)
