"""Shares of pools against rows taken one by one."""

import random

from tidebook.operators import shares

ROWS = "pool long, seq long, ts long, holder long, kind string, shares long, is_operator boolean, available decimal(38,0), bound long"
POOLS = "pool long, total long, balance decimal(38,0), operator_shares long, min_rate long, frozen boolean, lockup long"


def one_by_one(rows, pools, unit, holdings):
    state = {p[0]: [p[1], int(p[2]), p[3]] for p in pools}
    rules = {p[0]: p[4:] for p in pools}
    held = {(p, h): [s, c] for p, h, s, c in holdings}
    out = {}
    for pool, seq, ts, holder, kind, n, op, available, bound in sorted(rows, key=lambda r: r[1]):
        own = held.setdefault((pool, holder), [0, 0])
        taken, amount = False, 0
        if pool in state and n is not None and 0 < n < 2**60 and kind in ("stake", "unstake"):
            total, balance, op_shares = state[pool]
            rate, frozen, lockup = rules[pool]
            worth = lambda s, t, b: s * 1000 if t == 0 else s * b // (t * unit)
            amount = worth(n, total, balance)
            if kind == "stake":
                taken = not frozen and total + n < 2**60 and amount < 2**60 and (available is None or amount * unit <= int(available))
                taken = taken and (op or ((total + n) * rate <= op_shares * 10_000 and own[1] + amount < 2**56))
                if taken:
                    state[pool] = [total + n, balance + amount * unit, op_shares + n * op]
                    if not op:
                        own[0], own[1] = own[0] + n, own[1] + amount
            else:
                have = op_shares if op else own[0]
                taken = n <= have and n <= total and amount < 2**60
                if taken and op and not frozen:
                    taken = (total - n) * rate <= (op_shares - n) * 10_000
                if taken and not op and bound is not None:
                    taken = bound * 100 <= 10 * worth(own[0] - n, total - n, balance - amount * unit)
                if taken:
                    state[pool] = [total - n, balance - amount * unit, op_shares - n * op]
                    if not op:
                        own[1] -= own[1] * n // own[0]
                        own[0] -= n
        wait = 0 if op else (rules[pool][2] if pool in rules else 0)
        out[seq] = (taken, amount if taken else 0, *((None, None) if op else own), *(state[pool][:2] if pool in state else (0, 0)), ts + wait if taken and kind == "unstake" else None)
    return out


def results(spark, rows, pools, unit, holdings):
    first = spark.createDataFrame(holdings, "pool long, holder long, shares long, principal long") if holdings else None
    got = shares.pool_shares(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(pools, POOLS), unit, first)
    return {r["seq"]: (r["taken"], r["amount"], r["held"], r["principal"], r["total"], int(r["balance"]), r["pays_at"]) for r in got.collect()}


def test_against_one_by_one(spark):
    from decimal import Decimal

    rng = random.Random(1)
    pools = [(0, 0, Decimal(0), 0, 500, False, 7), (1, 5_000, Decimal(9_999_999), 5_000, 3_000, False, 0), (2, 4_000, Decimal(7_000_003), 1_000, 100, True, 9)]
    holdings = [(1, 3, 0, 0), (2, 4, 3_000, 777)]
    rows = []
    for i in range(400):
        pool, holder = rng.choice([0, 0, 1, 1, 1, 2, 5]), rng.randrange(6)
        op = holder == 0
        kind = rng.choice(["stake", "unstake", "unstake" if i > 150 else "stake", "stake" if i % 40 else "other"])
        rows.append((pool, i, i * 10, holder, kind, rng.choice([None, 0, -4, *range(1, 2_500, 57)]), op, rng.choice([None, None, Decimal(3_000_000)]), rng.choice([None, None, 20, 90_000])))
    want = one_by_one(rows, pools, 3, holdings)
    got = results(spark, rows, pools, 3, holdings)
    assert got == want and 60 < sum(t[0] for t in got.values()) < 350
    kinds = {(r[4], r[0]) for r in rows if got[r[1]][0]}
    assert {("stake", 0), ("unstake", 0), ("stake", 1), ("unstake", 1), ("unstake", 2)} <= kinds and ("stake", 2) not in kinds


def test_chains_and_bounds(spark):
    """A refused stake lets a later unstake fail, whose shares then keep the price; huge numbers are refused, and no rows give no rows."""
    from decimal import Decimal

    pools = [(0, 0, Decimal(0), 0, 5_000, False, 0)]
    rows = [
        (0, 0, 0, 1, "stake", 10, False, None, None), (0, 1, 1, 1, "unstake", 10, False, None, None), (0, 2, 2, 0, "stake", 10, True, None, None), (0, 3, 3, 1, "stake", 10, False, None, None),
        (0, 4, 4, 2, "stake", 1, False, None, None), (0, 5, 5, 1, "unstake", 4, False, None, None), (0, 6, 6, 0, "unstake", 5, True, None, None), (0, 7, 7, 0, "unstake", 4, True, None, None),
        (0, 8, 8, 0, "stake", 2**60 - 1, True, None, None), (0, 9, 9, 0, "stake", 2**62, True, None, None), (None, 10, 10, 0, "stake", 1, True, None, None),
    ]
    got = results(spark, rows, pools, 1, [])
    assert [got[i][0] for i in range(11)] == [False, False, True, True, False, True, False, True, False, False, False]
    assert got[5] == (True, 4_000, 6, 6_000, 16, 16_000, 5) and got[7][4:6] == (12, 12_000)
    assert results(spark, [], pools, 1, []) == {}


def test_public_pools(spark):
    """Fees, cooldowns, marks, what is free and forced returns, computed by hand."""
    from decimal import Decimal

    schema = ROWS + ", free decimal(38,0)"
    pools = spark.createDataFrame([(0, 1_000, Decimal(1_000_000), 1_000, 0, False, 0, 200_000, 50)], POOLS + ", fee_rate long, cooldown long")
    row = lambda seq, holder, kind, n, available=None, free=None: (0, seq, seq * 10, holder, kind, n, holder == 0, available and Decimal(available), None, free and Decimal(free))
    rows = [
        row(0, 1, "mint", 100), row(1, 1, "burn", 10), row(2, 1, "force_burn", 10), row(3, None, "mark", None, 1_090_000), row(4, 0, "force_burn", 5), row(5, 1, "burn", 100, None, 150_000),
        row(6, 1, "burn", 40, None, 200_000), row(7, 0, "burn", 20), row(8, None, "mark", None, -9_000_000), row(9, 1, "burn", 1), row(10, 2, "mint", 1, 10), row(11, None, "mark", None),
    ]
    got = {r["seq"]: r for r in shares.pool_shares(spark.createDataFrame(rows, schema), pools).collect()}
    assert [got[i]["taken"] for i in range(12)] == [True, False, True, True, False, False, True, True, True, False, False, False]
    assert (got[0]["amount"], got[0]["principal"], got[2]["amount"], got[2]["fee_shares"], got[2]["held"], got[2]["principal"]) == (100_000, 100_000, 10_000, 0, 90, 90_000)
    # the value doubles from 1,090,000 to 2,180,000 for 1,090 shares: 40 shares are worth 80,000, the profit 40,000, the fee 8,000 or 4 shares
    assert (got[6]["fee_shares"], got[6]["amount"], got[6]["held"], got[6]["principal"], got[6]["total"], int(got[6]["balance"])) == (4, 72_000, 50, 50_000, 1_054, 2_108_000)
    assert (got[7]["amount"], got[7]["total"], int(got[8]["balance"])) == (40_000, 1_034, 2_068_000 - 9_000_000)


def test_quotients(spark):
    """Bigints and wide decimals give the same, also where a pool's total times the unit is beyond a bigint."""
    from tidebook.operators import risk

    rows = [(1, 1, 5 * 10**17, 9 * 10**17, 4 * 10**18), (1, 2, 7, 0, 10), (1, 3, 3, 10, -10), (2, 4, -9, 2, 10**15), (2, 5, None, 5, 5)]
    df = spark.createDataFrame([(*r[:2], r[2], r[3], r[4]) for r in rows], "pool long, holder long, shares long, total long, tav long")
    want = {1: 2222222222222, 2: 7000, 3: 0, 4: -4500000000, 5: None}
    for data in (df, df.withColumn("tav", df["tav"].cast("decimal(38,0)"))):
        got = {r["holder"]: r["value"] if r["value"] is None else int(r["value"]) for r in risk.share_values(data).collect()}
        assert got == want


def test_margin_moves(spark):
    """Only rows whose source has enough move anything, in collateral units; nulls refuse."""
    from tidebook.operators import handlers

    row = lambda account, value, direction, **f: (29, account, 3, value, direction, f.get("position", 5), f.get("isolated", True), f.get("status", 1), f.get("cross", 50_000_000), f.get("own", 20_000_000))
    rows = [row(1, 50, 1), row(1, 20, 0), row(2, 51, 1), row(3, 21, 0), row(4, 1, 1, position=0), row(5, 1, 1, isolated=False), row(6, 1, 1, status=0), row(7, 0, 1), row(8, 1, 2), row(9, 1, None), row(10, 1, 1, cross=None), row(11, 2**60, 1)]
    log = spark.createDataFrame(rows, "tx_type long, account long, market long, value long, direction long, position long, isolated boolean, market_status long, cross_available long, isolated_available long")
    assert {(r["account"], r["place"]): int(r["amount"]) for r in handlers.margin_moves(log).collect()} == {(1, -1): -30_000_000, (1, 3): 30_000_000}


def test_one_pass_and_blocks(spark, monkeypatch):
    """Rows are taken in one pass, not in rounds; blocks of them pass on what pools and holders have."""
    from decimal import Decimal

    rng = random.Random(5)
    pools = [(0, 9_000, Decimal(9_000_001), 4_000, 3_000, False, 5), (1, 5_000, Decimal(9_999_999), 5_000, 100, False, 0)]
    holdings = [(0, 3, 2_000, 900), (1, 4, 3_000, 777), (1, 99, 50, 5)]
    rows = [(rng.randrange(2), i, i * 3, rng.randrange(1, 7), rng.choice(["stake", "unstake"]), rng.randrange(1, 900), False, None, None) for i in range(300)]
    rows += [(p, 300 + p, 950, 0, "unstake", 10, True, None, None) for p in (0, 1)]
    writes = []
    cut = shares.written
    monkeypatch.setattr(shares, "written", lambda df, label: writes.append(label) or cut(df, label))
    want = one_by_one(rows, pools, 1, holdings)
    assert results(spark, rows, pools, 1, holdings) == want and not writes
    whole = shares.pool_shares
    monkeypatch.setattr(shares, "pool_shares", lambda *a: whole(*a, block=90))
    assert results(spark, rows, pools, 1, holdings) == want and len(writes) > 4
