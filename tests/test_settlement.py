"""Debits that need funds, funding at fills, risk by increments, runs, codecs and wide integers against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import binary, sparse
from tidebook.operators import asof, debits, handlers, increments, risk, runs

OPS = "seq long, kind string, account long, to long, asset long, amount long, fee long"


def one_by_one(ops, fee_account):
    """Rows in order; cash is asset 1."""
    balance, taken = {}, {}
    get = lambda k: balance.get(k, 0)
    for seq, kind, account, to, asset, amount, fee in sorted(ops):
        fee = fee or 0
        ok = amount > 0 and asset != 0 and (kind != "transfer" or account != to)
        if ok and kind == "transfer":
            ok = get((account, asset)) >= amount + (fee if asset == 1 else 0) and (asset == 1 or get((account, 1)) >= fee)
        elif ok and kind != "deposit":
            ok = get((account, asset)) >= amount
        taken[seq] = ok
        if ok:
            if kind == "deposit":
                balance[account, asset] = get((account, asset)) + amount
                continue
            balance[account, asset] = get((account, asset)) - amount
            if kind == "transfer":
                balance[to, asset] = get((to, asset)) + amount
                balance[account, 1] = get((account, 1)) - fee
                balance[fee_account, 1] = get((fee_account, 1)) + fee
    return taken, {k: v for k, v in balance.items() if v}


@pytest.mark.parametrize("blocks", [1, 3])
def test_debits_in_order(spark, blocks):
    rng = random.Random(blocks)
    kinds = ["deposit", "transfer", "transfer", "l1_withdraw", "l2_withdraw"]
    pick = lambda: 1 if rng.random() < 0.4 else rng.randrange(7)  # noqa: E731  account 1 is hot, 0 gets the fees and spends them
    ops = [(i, rng.choice(kinds), pick(), pick(), rng.choice([1, 1, 2, 0 if i % 9 == 0 else 2]), rng.randrange(0, 60), rng.choice([0, 3, None])) for i in range(400)]
    taken, balances = debits.ordered_debits(spark.createDataFrame(ops, OPS).repartition(3), blocks)
    want, left = one_by_one(ops, 0)
    assert {r["seq"]: r["taken"] for r in taken.collect()} == want and 50 < sum(want.values()) < 350
    assert {(r["account"], r["asset"]): int(r["balance"]) for r in balances.collect()} == left
    status = {r["seq"]: r["status"] for r in debits.statuses(spark.createDataFrame(ops, OPS), taken).collect()}
    assert all((status[s] == "applied") == ok for s, ok in want.items())
    assert {status[o[0]] for o in ops if o[1] == "l1_withdraw" and o[5] > 0 and not want[o[0]]} == {"noop"}


def test_a_chain_of_transfers(spark):
    """Each transfer can only be paid from the one before it; the first fails, so all do."""
    ops = [(0, "deposit", 9, None, 1, 5, 0)] + [(i, "transfer", i, i + 1, 1, 10, 0) for i in range(1, 12)]
    taken, _ = debits.ordered_debits(spark.createDataFrame(ops, OPS), 2)
    assert [r["taken"] for r in taken.orderBy("seq").collect()] == [True] + [False] * 11
    ops[0] = (0, "deposit", 1, None, 1, 10, 0)
    taken, balances = debits.ordered_debits(spark.createDataFrame(ops, OPS), 2)
    assert all(r["taken"] for r in taken.collect()) and [tuple(r)[:2] for r in balances.collect()] == [(12, 1)]
    assert debits.ordered_debits(spark.createDataFrame([], OPS))[0].count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of(spark, width):
    rng = random.Random(3)
    marks = [(rng.randrange(3), rng.randrange(-60, 60), rng.choice([None, *range(50)])) for _ in range(80)]
    rows = [(rng.randrange(4), rng.randrange(-80, 80), i) for i in range(200)] + [(None, 5, 900)]
    got = asof.as_of(spark.createDataFrame(rows, "k long, t long, i long"), spark.createDataFrame(marks, "k long, t long, v long"), ["k"], "t", "v", width)
    for r in got.collect():
        before = [(t, v) for k, t, v in marks if k == r["k"] and t <= r["t"] and v is not None]
        assert r["v"] == (max(before)[1] if before else None)
    assert got.count() == len(rows)


def test_funding_at_fills(spark):
    rng = random.Random(4)
    fills = [(rng.randrange(4), rng.randrange(3), rng.randrange(2), rng.choice([-1, 1]), rng.randrange(1, 9), t, i, 1) for i, t in enumerate(sorted(rng.choices(range(100), k=150)))]
    marks = [(m, t, rng.randrange(-500, 500)) for m in range(2) for t in range(5, 120, 9)]
    f = spark.createDataFrame(fills, "taker long, maker long, market long, side long, base long, ts long, ok long, ln long")
    k = spark.createDataFrame(marks, "market long, ts long, prefix long")
    state, want = {}, {}
    for taker, maker, market, side, base, ts, ok, ln in fills:
        prefix = max(((t, p) for m, t, p in marks if m == market and t <= ts), default=(0, 0))[1]
        for account, d in ((taker, side * base), (-maker - 2, -side * base)):
            p, last = state.get((account, market), (0, prefix))
            want[account, market, ok] = (p, p * (last - prefix))
            state[account, market] = (p + d, prefix)
    for width in (10, 1000):
        got = {(r["account"], r["market"], r["ok"]): (r["position"], int(r["funding"])) for r in asof.fill_funding(f, k, width).collect()}
        assert got == want
    for r in asof.funding_balance(f, k, 10).collect():
        assert r["total"] == 0 and r["received"] > 0 > r["paid"]


def test_risk_by_increments(spark):
    from tidebook.sources.tables import fills, held, margin_accounts, margin_positions, perps

    d = "/root/testdata/sf0.001"
    rows, now = fills(spark, d), perps(spark, d)
    then = now.withColumn("mark", F.col("mark") + (F.col("market") % 3 == 0).cast("long"))
    versions, before = increments.Versions(spark, held), then
    small = [rows.where("ok % 50 = 1"), rows.where("ok % 50 = 1 AND ok % 3 = 0"), rows.where("ok % 50 = 2")]
    for k, (batch, markets) in enumerate(zip(small, (then, now, now))):
        versions.update(k, batch, before, markets)
        before = markets
        so_far = small[0]
        for b in small[1 : k + 1]:
            so_far = so_far.unionByName(b)
        want = risk.cross_risk(margin_accounts(spark, d), risk.position_terms(margin_positions(so_far), markets))
        got = risk.risk_of_sums(margin_accounts(spark, d), versions.sums())
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # only accounts with changes have a version
    third = {r[0] for r in spark.read.parquet(f"{versions.path}/sums/2").select("account").collect()}
    assert third <= {r[0] for r in small[2].select("taker").distinct().collect()}


def test_runs(spark):
    rng = random.Random(5)
    rows, block = [], 0
    for i in range(300):
        n = rng.randrange(1, 4)
        block += rng.random() < 0.1
        rows.append((block, block + n - 1, 10 * i - (15 if rng.random() < 0.05 else 0), 10 * i + 5, str(i) if rng.random() > 0.05 else "x", str(i + 1), n))
        block += n
    df = spark.createDataFrame(rows, "first_block long, last_block long, first_ts long, last_ts long, old_root string, new_root string, n long").repartition(4)
    want = []
    for r in rows:
        last = want[-1] if want else None
        fault = "height" if last is None or last[1] + 1 != r[0] else "time" if last[2] > r[2] else "root" if last[3] != r[4] else None
        if fault:
            want.append([r[0], r[1], r[3], r[5], fault, 1, r[6]])
        else:
            last[1:4], last[5], last[6] = [r[1], r[3], r[5]], last[5] + 1, last[6] + r[6]
    got = [[r[c] for c in ("first_block", "last_block", "last_ts", "new_root", "fault", "n_batches", "n")] for r in runs.merged_runs(df, ["n"]).orderBy("first_block").collect()]
    assert got == want and len({f for *_, f, _, _ in want}) == 3


def test_account_modes(spark):
    #: the seven cases of a change of mode: kinds of accounts, locked balance, health, funding, the mode it has
    rows = [(1, 1, 1, 0, 50, 0, 9, 1, 9), (1, 2, 1, 0, 50, 0, 9, 1, 9), (1, 3, 0, 0, 50, 5, 9, 1, 9), (1, 4, 0, 0, 50, 0, 0, 1, 9), (1, 5, 0, 0, 50, 0, 9, 1, -1), (1, 6, 0, 0, 40, 0, 1, 1, 0), (1, 7, 0, 0, 40, 0, 9, 1, 9), (1, 8, 1, 0, 30, 5, -9, 1, -9), (2, 1, 1, 2, 50, 0, 9, 1, 9), (3, 1, 0, 1, 50, 0, 9, 1, 9), (3, 2, 1, 1, 20, 0, 9, 1, 9)]
    df = spark.createDataFrame(rows, "account long, seq long, mode long, account_type long, balance long, locked long, tav long, im long, funded long")
    got = {(r["account"], r["seq"]): (r["taken"], r["mode"], r["to_collateral"]) for r in handlers.account_modes(df).collect()}
    assert [got[1, k] for k in range(1, 9)] == [(True, 1, 50), (False, 1, 0), (False, 1, 0), (False, 1, 0), (False, 1, 0), (True, 0, 0), (False, 0, 0), (True, 1, 30)]
    assert got[2, 1] == (False, 0, 0) and got[3, 1] == (False, 0, 0) and got[3, 2] == (True, 1, 20)


def test_sparse_lists(spark):
    texts = ['{"0":5,"7":-1}', "{}", "", None, '{"3":0}', '{"x":1}', '{"9":1}', '{"1":2', '{"1":null}', '{"1":1,"01":2}', '{"-1":4}', "[1]", '{"2":99999999999}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", sparse.fault(F.col("t"), "bigint", 9).alias("fault"), sparse.dense(sparse.parsed(F.col("t"), "bigint"), 9, F.lit(0).cast("long")).alias("d")).orderBy("i").collect()
    assert [r["fault"] for r in rows] == [None, None, None, None, None, "key", "key", "json", "value", "key", "key", "json", None]
    assert rows[0]["d"] == [5, 0, 0, 0, 0, 0, 0, -1, 0] and rows[2]["d"] == [0] * 9 and rows[12]["d"][2] == 99999999999
    back = df.where("i IN (0, 4)").select(F.to_json(sparse.sparse(sparse.dense(sparse.parsed(F.col("t"), "bigint"), 9, F.lit(0).cast("long")), F.lit(0).cast("long"))).alias("b")).collect()
    assert [r["b"] for r in back] == ['{"0":5,"7":-1}', "{}"]


def test_wide_integers(spark):
    rng = random.Random(6)
    top = 2**256
    pairs = [(rng.getrandbits(rng.choice([1, 31, 32, 33, 64, 128, 255, 256])), rng.getrandbits(rng.choice([1, 32, 64, 200, 256]))) for _ in range(300)] + [(0, 0), (top - 1, 1), (top - 1, 0), (2**32 - 1, 1)]
    df = spark.createDataFrame([(i, f"0x{a:X}", f"{b:064x}") for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = binary.from_hex(F.col("a")), binary.from_hex(F.col("b"))
    rows = df.select("i", binary.to_hex(binary.add(a, b)).alias("s"), binary.to_hex(binary.subtract(a, b)).alias("d"), (a < b).alias("l"), binary.to_hex(binary.times(a, 1_000_003)).alias("t"), binary.to_hex(a).alias("h")).collect()
    for r in rows:
        x, y = pairs[r["i"]]
        text = lambda v: f"{v:x}" if 0 <= v < top else None
        assert (r["s"], r["d"], r["l"], r["t"], r["h"]) == (text(x + y), text(x - y), x < y, text(x * 1_000_003), text(x))
    odd = spark.createDataFrame([("",), ("0x",), ("12g",), ("1" * 65,), (None,), ("0" * 70 + "a",)], "t string").select(binary.to_hex(binary.from_hex(F.col("t"))).alias("h")).collect()
    assert [r["h"] for r in odd] == [None] * 5 + ["a"]
    assert spark.range(1).select(binary.to_hex(binary.from_long(F.lit(255))), binary.from_long(F.lit(-1))).first()[:] == ("ff", None)
