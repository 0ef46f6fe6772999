"""What only shows on larger tables: keys beyond those of the small ones, and ties."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebook import plans
from tidebook.functions.wide import zero_quote
from tidebook.operators import asof, debits, folds, ledger, positions, risk
from tidebook.sources import reports
from tidebook.streaming import positions as stream_positions
from tidebook.streaming import runs, timers

from .test_queries import DATA, TABLES, rows

FILL = "taker long, maker long, market long, side long, base long, quote long, fee_rate long, ts long, ok long, ln long"


def against_sql(spark, name, data):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = plans.queries()[name](spark, data).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def moved(spark, place, **shifts):
    """The tables of sf0.001 with some columns shifted."""
    duck = duckdb.connect()
    for t in TABLES:
        source = f"'/root/testdata/sf0.001/{t}.parquet'"
        names = [r[0] for r in duck.sql(f"DESCRIBE SELECT * FROM {source}").fetchall()]
        cols = ", ".join(f"{c} + {shifts[c]} AS {c}" if c in shifts else c for c in names)
        duck.sql(f"COPY (SELECT {cols} FROM {source}) TO '{place}/{t}.parquet'")
    return str(place)


def test_health_changes_of_funds(spark):
    against_sql(spark, "health_changes", "/root/testdata/sf0.01")


def test_wide_binary_of_large_keys(spark, tmp_path):
    against_sql(spark, "wide_binary", moved(spark, tmp_path, o_orderkey=9_000_000, l_orderkey=9_000_000))


@pytest.mark.parametrize("down", [False, True])
def test_fills_of_one_time_and_line_go_by_lots(spark, down):
    fills = [(1, 2, 0, 1, 5, 50, 0, 100, 1, 1), (1, 2, 0, 1, 7, 90, 0, 100, 1, 1), (1, 2, 0, -1, 4, 30, 0, 200, 2, 1)]
    both = spark.createDataFrame(sorted(fills, reverse=down), FILL).coalesce(1)
    marks = spark.createDataFrame([(0, 0, 3), (0, 150, 8)], "market long, ts long, prefix long")
    got = asof.fill_funding(both, marks, 1000).where("account = 1").orderBy("ts", "position").collect()
    assert [(r["position"], int(r["funding"])) for r in got] == [(0, 0), (5, 0), (12, -60)]
    grown = [(1, 2, 0, 1, 5, 52, 0, 100, 1, 1), (1, 2, 0, 1, 7, 90, 0, 100, 1, 1)]
    one = folds.entry_quotes(spark.createDataFrame(sorted(grown, reverse=down), FILL).coalesce(1)).where(F.col("account") == 1).first()
    assert (one["position"], int(one["entry_quote"]), int(one["realised"])) == (12, 50 + 90, 50 - 52)


def test_timers_are_kept_in_groups(spark, tmp_path):
    arms = [("unlock", 3, i, 1_000 + i, 900_000) for i in range(640)] + [("unlock", None, 7, 1_000, 1_005), ("unlock", None, 7, 1_010, 0)]
    spark.createDataFrame(arms, "kind string, account long, id long, ts long, due long").write.parquet(f"{tmp_path}/in")
    with runs.conf(spark, spark__sql__streaming__stateStore__providerClass=runs.ROCKSDB):
        stream = timers.timer_fires(runs.read_stream(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        stream.awaitTermination()
    held = max(o["numRowsTotal"] for p in stream.recentProgress for o in p["stateOperators"])
    assert 11 <= held < 100  # of 640 armed timers
    assert [tuple(r) for r in spark.read.schema(timers.FIRED).parquet(f"{tmp_path}/out").collect()] == [("unlock", None, 7, 1_005)]


def test_documents_packed(spark, tmp_path):
    """Packed documents give what single files do, from few files."""
    docs = [(f"b{i % 2}", "v0.0.1", "m 1", "20240101-000001", f'{{"code_release": "{i % 90}", "wall_seconds": 1.5}}') for i in range(120)]
    made = spark.createDataFrame(docs, "benchmark string, release string, machine string, run string, document string").coalesce(2)
    got = []
    for packed in (False, True):
        place = tmp_path / str(packed)
        reports.write_documents(made, str(place), packed)
        got.append(sorted(tuple(r)[:3] + tuple(r)[5:] for r in reports.read_documents(spark, str(place), packed).select("benchmark", "release", "machine", "run", "digest", "copies", "content").collect()))
        assert (len(list(place.rglob("part-*"))) > 50) != packed
    assert [(r[0], *r[3:]) for r in got[0]] and len(got[1]) == 90
    assert [r[:3] + r[3:4] for r in got[0]] == [r[:3] + r[3:4] for r in got[1]] and sum(r[3] for r in got[1]) == 120


def reads(df, column):
    """How often a plan reads the table that has ``column``."""
    return sum("Relation [" in line and f"{column}#" in line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


@pytest.mark.parametrize("name", ["delta_sequence", "asset_deltas", "account_deltas"])
def test_changes_between_states_are_one_pass(spark, name):
    assert reads(plans.queries()[name](spark, DATA), "l_orderkey") <= 1


def test_changes_between_states(spark):
    fills = spark.createDataFrame([(1, 2, 0, 1, 5, 50, 0, 100, 2, 1), (1, 2, 0, 1, 7, 90, 0, 100, 3, 1), (1, 3, 1, -1, 4, 30, 0, 100, 4, 1), (3, 2, 0, 1, 6, 60, 0, 100, 5, 1), (3, 2, 0, -1, 6, 60, 0, 100, 7, 1)], FILL)
    early, rows = F.col("ok") % 2 == 0, lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(positions.position_changes(fills, early)) == [(1, 0, 7)]
    assert rows(positions.spot_changes(fills, early)) == rows(ledger.state_deltas(positions.spot_deltas(fills.where(early)), positions.spot_deltas(fills), ["account", "asset"], "amount"))


def test_positions_are_kept_in_groups(spark, tmp_path):
    rows = [(i, i % 3, i, 1, 5) for i in range(640)] + [(None, 1, 700, 2, 9), (7, None, 701, 3, 8)]
    for part, some in enumerate((rows, [(5, 2, 4, 1, 5), (5, 2, 900, 1, 7), (None, 1, 699, 1, 1)])):
        spark.createDataFrame(some, "account long, market long, seq long, d long, q long").write.parquet(f"{tmp_path}/in/part={part}")
        sink, stream = runs.versions(f"{tmp_path}/out"), stream_positions.fold_positions(runs.read_stream(spark, f"{tmp_path}/in").drop("part"))
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
        held = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
        assert 10 <= held < 20  # of 642 keys
    assert sorted(map(tuple, stream_positions.late_rows(spark.read.parquet(f"{tmp_path}/out")).collect()), key=str) == [(5, 2, 4), (None, 1, 699)]
    found = {(r["account"], r["market"]): (r["position"], r["entry_quote"], r["n"]) for r in runs.latest(spark, f"{tmp_path}/out", ["account", "market"]).collect()}
    assert len(found) == 642 and found[5, 2] == (2, "12", 2) and found[None, 1] == (2, "8", 1) and found[7, None] == (3, "6", 1) and found[6, 0] == (1, "5", 1)


def test_rounds_fold_what_the_round_before_changed(spark, monkeypatch):
    """Account 0, which is paid fees by all, is folded by its own payments; accounts that nothing changed for aren't folded again."""
    ops = [(2 * i, "transfer", i % 50 + 1, 60 + i % 3, 1, 5, 1) for i in range(300)] + [(1 + 2 * i, "deposit", i + 1, None, 1, 3 + i * 2, 0) for i in range(40)] + [(999, "l2_withdraw", 0, None, 1, 7, 0), (1001, "transfer", 61, 62, 1, 9, 0)]
    rows, sizes, unpaid = spark.createDataFrame(ops, "seq long, kind string, account long, to long, asset long, amount long, fee long"), [], debits.unpaid

    def counted(payments, credits):
        sizes.append((payments.count(), credits.where("account = 0").count()))
        return unpaid(payments, credits)

    monkeypatch.setattr(debits, "unpaid", counted)
    taken = {r["seq"]: r["taken"] for r in debits.ordered_debits(rows, 1)[0].collect()}
    assert sizes[0] == (302, 1) and len(sizes) > 1 and max(n for n, _ in sizes[1:]) <= 2
    held, want = [0] * 70, {}
    for seq, kind, account, to, _, amount, fee in sorted(ops):
        want[seq] = kind == "deposit" or held[account] >= amount + fee
        if want[seq]:
            held[account] += amount if kind == "deposit" else -amount - fee
            if to is not None:
                held[to], held[0] = held[to] + amount, held[0] + fee
    assert taken == want and 0 < sum(want.values()) < len(want)


def test_deleverages_work_out_risk_once(spark):
    assert reads(plans.queries()["deleverage_pairs"](spark, DATA), "l_orderkey") == 0


def test_products_beyond_bigints(spark):
    values = [2**55, -(2**31), 3, 0, -7, 2**31]
    rows = spark.createDataFrame([(a, b, c) for a in values for b in values for c in (3, 0, -7, 2**14)] + [(None, 1, 2)], "a long, b long, c long")
    for a, b, c, p in rows.select("*", risk.product(*map(F.col, "abc"))).collect():
        assert p is None if a is None else int(p) == a * b * c


def test_funding_balance_deals_out_fills_once(spark):
    plan = plans.queries()["funding_balance"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(account" in line for line in plan.split("\n")) == 1


@pytest.mark.parametrize("width", [7, 1000])
def test_funding_balance(spark, width):
    """Against the fills one after the other; some before all marks, some in a market without marks, of which there is no row."""
    rng = random.Random(5)
    fills = [(rng.randrange(4), rng.randrange(3), rng.randrange(3), rng.choice([-1, 1]), rng.randrange(1, 9), rng.randrange(-20, 100), i, 1) for i in range(200)]
    marks = [(m, t, rng.randrange(-(10**9), 10**9)) for m in range(2) for t in range(-5, 90, 13)]
    state, want = {}, {m: [0, 0, 0] for m in range(2)}
    for taker, maker, market, side, base, ts, _, _ in sorted(fills, key=lambda f: f[5:]):
        prefix = max(((t, p) for m, t, p in marks if m == market and t <= ts), default=(0, 0))[1]
        for account, d in ((taker, side * base), (-maker - 2, -side * base)):
            p, last = state.get((account, market), (0, prefix))
            if market < 2:
                want[market][p * (last - prefix) < 0] += p * (last - prefix)
            state[account, market] = (p + d, prefix)
    for (_, market), (p, last) in state.items():
        if market < 2:
            want[market][2] += p * (last - max((t, x) for m, t, x in marks if m == market)[1])
    f = spark.createDataFrame(fills, "taker long, maker long, market long, side long, base long, ts long, ok long, ln long")
    got = asof.funding_balance(f, spark.createDataFrame(marks, "market long, ts long, prefix long"), width)
    assert {r["market"]: [int(r[c]) for c in ("received", "paid", "outstanding")] for r in got.collect()} == want
    assert all(r["total"] == 0 for r in got.collect())


def test_positions_are_not_dealt_out_by_strategy(spark):
    with runs.conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plans.queries()["zero_prices"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(account#" in plan and not re.search(r"hashpartitioning\(account#\w+, strategy#", plan)


def test_deleverages_of_hot_and_tied_positions(spark):
    """Against all pairs: two markets, sizes with ties within and across powers of two, funds with and without other funds."""
    rng = random.Random(6)
    rows = [(a, m, rng.choice([-1, 1]) * rng.randrange(1, 40), m, 1, rng.choice([0, 0, 3]), rng.randrange(2), rng.randrange(-9, 9), rng.randrange(1, 5)) for a in range(60) for m in range(2)]
    made = spark.createDataFrame(rows, "account long, market long, position long, strategy long, status long, account_type long, open_orders long, gain long, health int")
    wide = {c: F.lit(v).cast("decimal(38,0)") for c, v in (("notional", 1000), ("mm", 30_000))}
    made = made.withColumns(wide | {"gain": F.col("gain").cast("decimal(38,0)"), "tav": (F.col("gain") * 500_000).cast("decimal(38,0)"), "maintenance": F.lit(300).cast("long")})
    funds = [(a, s, rng.randrange(5)) for a, m, *rest in rows if m == 0 and rest[3] == 3 for s in (0, 1)]
    got = {(r["market"], r["account"]): r for r in risk.deleverages(made, spark.createDataFrame(funds, "account long, strategy long, tav long").withColumn("tav", F.col("tav").cast("decimal(38,0)"))).collect()}
    quotes = {(r["market"], r["account"]): int(r["q"]) for r in made.select("market", "account", zero_quote(F.col("notional"), F.col("mm"), F.col("tav"), F.signum("position").cast("long"), F.col("maintenance")).alias("q")).collect()}
    want = {}
    for a, m, p, s, _, kind, open_orders, _, health in rows:
        if health >= 3 and (open_orders == 0 or kind == 3):
            offers = [(-g, b) for b, n, x, _, _, k, _, g, _ in rows if n == m and k != 3 and x * p < 0 and abs(x) >= abs(p)]
            adl = quotes[m, a] > 0 and bool(offers)
            others = [(-t, b) for b, z, t in funds if z == s and b != a]
            want[m, a] = (p, quotes[m, a], min(offers)[1] if adl else min(others)[1], adl)
    assert {k: (r["position"], int(r["quote"]), r["counterparty"], r["adl"]) for k, r in got.items()} == want
    assert 0 < sum(w[3] for w in want.values()) < len(want)
