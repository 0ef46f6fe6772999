"""Queues and isolated margin on hand-computed rows."""

from tidebook.functions.wide import isolated_change, isolated_margin_change
from tidebook.operators import queues


def test_unlocks(spark):
    rows = [(1, i, i, "append", 10 + i, 5 + i) for i in range(9)] + [(1, 4, 20, "pop", 0, 0), (1, 5, 21, "pop", 0, 0), (1, 12, 22, "pop", 0, 0), (2, 1, 1, "pop", 0, 0)]
    got = {(r["account"], r["seq"]): (r["outcome"], r["amount"], r["queued"]) for r in queues.pending_unlocks(spark.createDataFrame(rows, "account long, ts long, seq long, action string, amount long, unlock_ts long")).collect()}
    # at time 4 and 5 the queue holds what came before; the request of time 8 finds eight, less those paid
    assert got[1, 20] == ("none", 0, 5) and got[1, 21][:2] == ("paid", 10) and got[1, 22][:2] == ("paid", 11) and got[2, 1] == ("none", 0, 0)
    assert got[1, 8] == ("queued", 18, 8)
    full = [(3, 0, i, "append", 1, 9) for i in range(10)]
    out = queues.pending_unlocks(spark.createDataFrame(full, "account long, ts long, seq long, action string, amount long, unlock_ts long")).collect()
    assert [r["outcome"] for r in sorted(out, key=lambda r: r["seq"])] == ["queued"] * 8 + ["full"] * 2


def test_isolated():
    assert isolated_change(10, 0, 50, 60, 0, 0, 0, 0) == -50 and isolated_change(10, 0, -5, 0, 0, 0, 0, 0) == 0
    assert isolated_change(10, -5, 50, 60, 20, 35, 0, 0) == 15
    assert isolated_change(10, 15, 50, 60, 60, 90, 30, 12) == 18 and isolated_change(0, 5, 0, 0, 0, 30, 30, -2) == 32
    assert isolated_change(10, 3, 50, 61, 40, 10, 0, 0) == -21  # share: ceil(61 x 3 / 10) = 19
    assert isolated_change(10, 3, 15, 61, 40, 10, 0, 0) == -15


def test_isolated_column(spark):
    df = spark.createDataFrame([(10, 3, 50, 61, 40, 10, 0, 0), (10, None, 0, 0, 0, 0, 0, 0)], "a long, b long, c long, d long, e long, f long, g long, h long")
    assert [None if r[0] is None else int(r[0]) for r in df.select(isolated_margin_change(*"abcdefgh")).collect()] == [-21, None]
