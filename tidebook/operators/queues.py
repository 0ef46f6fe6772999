"""Bounded queues of an account as ordered folds: pending unlocks, first in, first out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from .folds import ordered_fold

UNLOCK_SLOTS = 8


def unlock_step(queue: list[tuple[int, int]], row: NamedTuple) -> tuple[list[tuple[int, int]], str, int]:
    """Queue, outcome and amount after one request: ``append`` an amount that matures at ``unlock_ts``, or ``pop`` the oldest matured."""
    if row.action == "append":
        if len(queue) >= UNLOCK_SLOTS:
            return queue, "full", 0
        return [*queue, (row.unlock_ts, row.amount)], "queued", row.amount
    if not queue or queue[0][0] > row.ts:
        return queue, "none", 0
    return queue[1:], "paid", queue[0][1]


def pending_unlocks(requests: DataFrame) -> DataFrame:
    """Outcomes of requests ``(account, ts, seq, action, amount, unlock_ts)`` by account, with the queue's length after each."""

    def step(queue, row):
        queue, outcome, amount = unlock_step(queue, row)
        return queue, [(row.account, row.seq, outcome, amount, len(queue))]

    return ordered_fold(requests, ["account"], ["ts", "seq"], lambda k: [], step, lambda k, q: [], "account long, seq long, outcome string, amount long, queued long")
