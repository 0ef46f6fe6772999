"""Positions, entry quotes and realised profit as state by account and market."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import change_position

OUT = "account long, market long, position long, entry_quote string, realised string, n long, late array<long>"
STATE = "account array<long>, market array<long>, position array<long>, entry_quote array<string>, realised array<string>, n array<long>, last array<long>"
SPAN_BITS = 6  # keys are kept together by 2^6 consecutive accounts and as many markets, so a group has a bounded number of keys
NONE = -(2**63)


def fold_positions(fills: DataFrame) -> DataFrame:
    """Update-mode stream of each key's position after a batch.

    ``fills`` has ``(account, market, seq, d, q)``. Within a batch rows are taken in order of ``seq``. A row not after the last one that its key took in
    an earlier batch comes too late: it changes nothing, and its ``seq`` is given in ``late``. Amounts are kept as
    text, exact at any width. A call into Python costs about as much for 64 accounts as for one, so keys go to the state store in groups.
    """

    def step(spans: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(a, m): rest for a, m, *rest in zip(*state.get)} if state.exists else {}
        rows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for b in batches:
            for account, market, *row in zip(*(b[c].tolist() for c in ("account", "market", "seq", "d", "q"))):
                rows.setdefault((account, market), []).append(tuple(row))
        out = []
        for key in rows:
            p, e, r, n, last = held.get(key, (0, "0", "0", 0, None))
            e, r, done, late = int(e), int(r), last, []
            for seq, d, q in sorted(rows[key]):
                if done is not None and seq <= done:
                    late.append(seq)
                    continue
                p, e, more = change_position(int(p), e, d, q)
                r, n, last = r + more, n + 1, seq
            held[key] = (p, str(e), str(r), n, last)
            out.append((*key, p, str(e), str(r), n, late))
        state.update(tuple(list(c) for c in zip(*((*key, *rest) for key, rest in held.items()))))
        yield pd.DataFrame(out, columns=["account", "market", "position", "entry_quote", "realised", "n", "late"])

    own = {c: F.coalesce(F.col(c), F.lit(NONE)) for c in ("account", "market")}  # pandas would make doubles of integers with nulls among them
    spans = {f"{c}_span": F.shiftright(c, SPAN_BITS) for c in own}
    grouped = fills.withColumns(own).withColumns(spans).groupBy(*spans)
    out = grouped.applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
    return out.withColumns({c: F.nullif(F.col(c), F.lit(NONE)) for c in own})


def late_rows(versions: DataFrame) -> DataFrame:
    """The side output ``(account, market, seq)`` of late rows over all batches of ``fold_positions``."""
    return versions.select("account", "market", F.explode("late").alias("seq"))
