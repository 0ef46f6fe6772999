"""Shares of pools in order, at a price that moves with each row: staking pools and public pools.

``rows`` have ``(pool, seq, ts, holder, kind, shares, is_operator, available, bound, free)``. Kinds: ``stake`` or ``mint`` buys shares, ``unstake``, ``burn`` or ``force_burn`` gives them back,
``mark`` changes the pool's value by ``available``. ``available`` of a purchase is what the holder can pay (null: anything), ``bound`` the holder's principal in the main pool, which what
stays staked has to carry (null: none), ``free`` what of the pool's value can be paid out (null: all). ``seq`` is unique. ``pools`` have ``(pool, total, balance, operator_shares, min_rate,
frozen, lockup, fee_rate, cooldown)``, one row each; ``holdings`` ``(pool, holder, shares, principal)`` what others than operators hold at first. ``free``, ``fee_rate`` and ``cooldown`` may be absent.

A row that breaks a rule changes nothing. Rules: shares are from 1 to 2^60 - 1, as is the total after; nobody gives back more than they hold; a purchase costs at most ``available``, enters no
frozen pool, and leaves the operator the least share of the pool, unless it is the operator's; an operator's return leaves it too, unless the pool is frozen; shares come back only while
the pool's value is positive, for at most ``free``, after ``cooldown`` since the holder's last purchase (operators and forced returns don't wait), and leave enough for ``bound``; operators
can't be forced. Rows of unknown pools, of other kinds and with null shares are refused.

Of a holder's profit (what the shares are worth over their part of the principal) the operator gets ``fee_rate`` in 1e-6, in shares: these change hands, the others are burnt and paid.

A pool's rows go through one sorted stream, one after the other, with the pool's three numbers and those of the holders that have rows in it. Streams run over blocks of
``seq`` of about ``BLOCK`` rows, one after the other, which pass on pools and holders as tables, so what a stream holds is bounded by a block, whatever the number of holders.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model.units import EMPTY_VALUE, FEE_TICK, SHARE_TICK
from .debits import written
from .folds import ordered_fold
from .pools import PRINCIPAL_UNIT, STAKE_FACTOR

MOST, MOST_PRINCIPAL = 2**60, 2**56
OPEN, HOLDING, MARK, FORCED = "open", "holding", "mark", "force_burn"
BUYS, RETURNS = ("stake", "mint"), ("unstake", "burn", FORCED)
ROW = "pool long, seq long, ts long, holder long, kind string, shares long, is_operator boolean, available decimal(38,0), bound long, free decimal(38,0), min_rate long, frozen boolean, lockup long, fee_rate long, cooldown long"
CARRIED = "turn int, principal long, entered long"
OUT = "pool long, seq long, holder long, kind string, shares long, taken boolean, amount long, held long, principal long, fee_shares long, total long, balance decimal(38,0), pays_at long, entered long"
FIRST = -(2**63)
BLOCK = 2_000_000


def price(shares: int, total: int, balance: int, unit: int) -> int:
    """What shares are worth, rounded down, in amounts of ``unit`` parts of the balance."""
    return shares * EMPTY_VALUE if total == 0 else shares * abs(balance) // (total * unit)


def hold(state: tuple[int, int, int | None], row, amount: int) -> tuple[bool, tuple[int, int, int | None]]:
    """Whether a holder covers a row that costs ``amount``, and their shares, principal and time of purchase after it."""
    held, principal, entered = state
    if row.shares is None or not 0 < row.shares < MOST:
        return False, state
    if row.kind in BUYS:
        left, rest = held + row.shares, principal + amount
        return (True, (left, rest, row.ts)) if left < MOST and rest < MOST_PRINCIPAL else (False, state)
    if row.shares <= held and (row.kind == FORCED or row.cooldown == 0 or row.ts >= (entered or 0) + row.cooldown):
        return True, (held - row.shares, principal - principal * row.shares // held, entered)
    return False, state


def judge(state: tuple[int, int, int], row, unit: int, left: int, paid: int) -> tuple[bool, int, int, tuple[int, int, int]]:
    """Whether the pool takes a row that its holder covers, what it moves, the operator's fee in shares, and the pool's total, balance and operator's shares after it.

    After a return the holder has ``left`` shares and ``paid`` less principal.
    """
    total, balance, own = state
    n, refused = row.shares, (False, 0, 0, state)
    if row.min_rate is None:
        return refused
    if row.kind == MARK:
        return (True, 0, 0, (total, balance + int(row.available), own)) if row.available is not None else refused
    if row.kind not in BUYS + RETURNS or n is None or not 0 < n < MOST:
        return refused
    amount, fee, own_change = price(n, total, balance, unit), 0, n * bool(row.is_operator)
    if amount >= MOST:
        return refused
    if row.kind in BUYS:
        after = total + n, balance + amount * unit, own + own_change
        least = row.is_operator or after[0] * row.min_rate <= own * SHARE_TICK
        ok = not row.frozen and after[0] < MOST and (row.available is None or amount * unit <= int(row.available)) and least
        return (True, amount, 0, after) if ok else refused
    if n > total or balance <= 0 or own_change > own or (row.free is not None and n > int(row.free) * total // balance):
        return refused
    if row.is_operator:
        if not row.frozen and (total - n) * row.min_rate > (own - n) * SHARE_TICK:
            return refused
    elif row.fee_rate:
        fee = max(amount - paid, 0) * row.fee_rate * total * unit // (FEE_TICK * balance)
        amount = price(n - fee, total, balance, unit)
    after = total - n + fee, balance - amount * unit, own - own_change + fee
    if row.bound is not None and not row.is_operator and row.bound * PRINCIPAL_UNIT > STAKE_FACTOR * price(left, after[0], after[1], unit):
        return refused
    return True, amount, fee, after


def pool_step(unit: int):
    """The step of a pool's stream; its state is the pool's total, balance and operator's shares, and those of its holders by holder."""
    nobody = (0, 0, None)

    def step(state, row):
        pool, holders = state
        if row.kind == OPEN:
            return ((row.shares, int(row.available), row.principal), holders), []
        if row.kind == HOLDING:
            holders[row.holder] = (row.shares, row.principal, row.entered)
            return state, []
        own = after = None if row.is_operator or row.kind == MARK else holders.get(row.holder, nobody)
        if own is None:
            ok, amount, fee, changed = judge(pool, row, unit, 0, 0)
            taken = ok and row.kind != FORCED
        else:
            # a purchase's price doesn't depend on what its holder has, a return's cover not on the price
            buys = row.kind in BUYS
            ok, amount, fee, changed = judge(pool, row, unit, 0, 0) if buys else (True, 0, 0, pool)
            covered, after = hold(own, row, amount) if ok else (False, own)
            if covered and not buys:
                ok, amount, fee, changed = judge(pool, row, unit, after[0], own[1] - after[1])
            taken = ok and covered
            if taken:
                own = holders[row.holder] = after
        if taken:
            pool = changed
        pays_at = row.ts + (0 if row.is_operator else row.lockup) if taken and row.kind in RETURNS else None
        held, principal, entered = own or (None, None, None)
        return (pool, holders), [(row.pool, row.seq, row.holder, row.kind, row.shares, taken, amount if taken else 0, held, principal, fee if taken else 0, pool[0], Decimal(pool[1]), pays_at, entered)]

    def finish(key, state):
        (total, balance, own), holders = state
        rows = [(key[0], FIRST, h, HOLDING, s, None, None, None, p, None, None, None, None, e) for h, (s, p, e) in holders.items()]
        return [*rows, (key[0], FIRST, None, OPEN, total, None, None, None, own, None, None, Decimal(balance), None, None)]

    return step, finish


def cuts(rows: DataFrame, block: int) -> list[int]:
    """The numbers at which ``rows`` are cut into blocks of about ``block`` rows."""
    parts = -(-rows.count() // block)
    if parts < 2:
        return []
    return sorted(set(rows.agg(F.percentile_approx("seq", [k / parts for k in range(1, parts)])).first()[0]))


def pool_shares(rows: DataFrame, pools: DataFrame, unit: int = 1, holdings: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Every row with ``taken``, the ``amount`` that it moves, what its holder has after it (null for operators), the operator's fee in shares, the pool after it, and when a return pays.

    Holders wait the pool's lockup (0: paid at once), operators don't.
    """
    spark = rows.sparkSession
    names = [c.split()[0] for c in ROW.split(", ")]
    empty = spark.createDataFrame([], f"{ROW}, {CARRIED}")
    rows = rows if "free" in rows.columns else rows.withColumn("free", F.lit(None))
    pools = pools.withColumns({c: F.lit(0).cast("long") for c in ("fee_rate", "cooldown") if c not in pools.columns})
    known = rows.join(pools.select("pool", "min_rate", "frozen", "lockup", "fee_rate", "cooldown"), "pool", "left")
    known = known.withColumns({"available": F.col("available").cast("decimal(38,0)"), "free": F.col("free").cast("decimal(38,0)"), "is_operator": F.coalesce("is_operator", F.lit(False)), **{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("lockup", "fee_rate", "cooldown")}})
    known = empty.unionByName(known.select(*names).withColumn("turn", F.lit(1)), allowMissingColumns=True)
    opening = lambda df: empty.unionByName(df.withColumns({"seq": F.lit(FIRST), "turn": F.lit(0)}), allowMissingColumns=True)
    start = opening(pools.select("pool", F.lit(OPEN).alias("kind"), F.col("total").alias("shares"), F.col("balance").cast("decimal(38,0)").alias("available"), F.col("operator_shares").alias("principal")))
    if holdings is not None:
        start = start.unionByName(opening(holdings.select("pool", "holder", F.lit(HOLDING).alias("kind"), "shares", "principal")))
    edges, done = cuts(rows, block), []
    if edges:
        known, start = written(known, "shares"), written(start, "shares")
    step, finish = pool_step(unit)
    for low, high in zip([None, *edges], [*edges, None]):
        own = known if low is None else known.where(F.col("seq") > low)
        own = own if high is None else own.where(F.col("seq") <= high)
        # what holders without rows in this block have stays in the table
        active = own.select("pool", "holder").distinct().withColumn("active", F.lit(True)) if edges else None
        here = start if active is None else start.join(active, (start["pool"] == active["pool"]) & start["holder"].eqNullSafe(active["holder"]), "left").select(*(start[c] for c in start.columns), ((start["kind"] == OPEN) | F.col("active").isNotNull()).alias("here"))
        stream = own.unionByName(here if active is None else here.where("here").drop("here"))
        folded = ordered_fold(stream, ["pool"], ["seq", "turn"], lambda k: ((0, 0, 0), {}), step, finish if high is not None else lambda k, s: [], OUT)
        if edges:
            folded = written(folded, "shares")
        done.append(folded.where(F.col("taken").isNotNull()))
        if high is not None:
            ends = opening(folded.where(F.col("taken").isNull()).select("pool", "holder", "kind", "shares", F.col("balance").alias("available"), "principal", "entered"))
            quiet = here.where("NOT here").drop("here")
            start = written(ends.unionByName(quiet), "shares")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("entered")
