"""Streams against plain versions: timers over restarts, resumed folds, late rows, bounded batches."""

import random

from pyspark.sql import functions as F

from tidebook.operators.folds import change_position
from tidebook.streaming import positions, runs, timers

ARMS = "kind string, account long, id long, ts long, due long"


def plain_fires(rows, now):
    """Row after row in order of time, then the end."""
    armed, out = {}, []
    for kind, account, i, ts, due in sorted(rows, key=lambda r: (r[3], r[4])):
        key = (kind, account, i)
        if armed.get(key) and armed[key] <= ts:
            out.append((*key, armed[key]))
        armed[key] = due
    return sorted(out + [(*k, due) for k, due in armed.items() if due and due <= now])


def test_timers_survive_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [("switch", rng.randrange(6), 0, t, 0 if rng.random() < 0.2 else t + rng.randrange(1, 40)) for t in rng.sample(range(1, 400), 120)]
    rows += [("unlock", rng.randrange(6), i, t, t + rng.randrange(1, 300)) for i, t in enumerate(rng.sample(range(1, 400), 80))]
    arms = spark.createDataFrame(rows, ARMS)
    place = str(tmp_path)
    with runs.conf(spark, spark__sql__streaming__stateStore__providerClass=runs.ROCKSDB):
        for part, limits in enumerate(((0, 150), (150, 280), (280, 401))):  # each part is a run of its own, from the checkpoint of the one before
            arms.where(F.col("ts").between(limits[0], limits[1] - 1)).write.parquet(f"{place}/in/part={part}")
            runs.run_to_files(timers.timer_fires(runs.read_stream(spark, f"{place}/in").drop("part")), f"{place}/out", f"{place}/checkpoint")
            seen = [r for r in rows if r[3] < limits[1]]
            want = plain_fires(seen, max(r[3] for r in seen))
            assert sorted(tuple(r) for r in spark.read.schema(timers.FIRED).parquet(f"{place}/out").collect()) == want
    assert sorted(tuple(r) for r in timers.fired_by(arms, max(r[3] for r in rows)).collect()) == want
    assert len({r[:3] for r in want if r[0] == "unlock"}) == sum(r[0] == "unlock" for r in want)  # once each


def fold(rows):
    state = {}
    for account, market, _, d, q in sorted(rows, key=lambda r: r[2]):
        p, e, r, n = state.get((account, market), (0, 0, 0, 0))
        p, e, more = change_position(p, e, d, q)
        state[account, market] = (p, e, r + more, n + 1)
    return state


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(3), i, rng.randrange(-4, 5), rng.randrange(1, 900)) for i in range(300)]
    fills = spark.createDataFrame(rows, "account long, market long, seq long, d long, q long")
    place = str(tmp_path)
    run = lambda: runs.run_versions(positions.fold_positions(runs.read_stream(spark, f"{place}/in").drop("part")), f"{place}/out", f"{place}/checkpoint")
    latest = lambda: {(r["account"], r["market"]): (r["position"], int(r["entry_quote"]), int(r["realised"]), r["n"]) for r in runs.latest(spark, f"{place}/out", ["account", "market"]).collect()}
    fills.where("seq < 150").write.parquet(f"{place}/in/part=0")
    assert run() == [0]
    once = latest()
    assert once == fold(r for r in rows if r[2] < 150)
    assert runs.forget_commit(spark, f"{place}/checkpoint") == 0
    assert run() == [0] and latest() == once  # the same batch again
    fills.where("seq >= 150").write.parquet(f"{place}/in/part=1")
    assert run() == [1] and latest() == fold(rows)
    assert runs.run_versions(positions.fold_positions(runs.read_stream(spark, f"{place}/in").drop("part")), f"{place}/out", f"{place}/checkpoint") == []
    # two rows that come after later ones of their key change nothing and are named
    spark.createDataFrame([(0, 0, 3, 4, 5), (9, 9, 1, 2, 7)], fills.schema).write.parquet(f"{place}/in/part=2")
    run()
    late = positions.late_rows(spark.read.parquet(f"{place}/out")).collect()
    assert [tuple(r) for r in late] == [(0, 0, 3)] and latest() == fold([*rows, (9, 9, 1, 2, 7)])


def test_batches_stay_within_the_limit(spark, tmp_path):
    place = str(tmp_path)
    rows = spark.range(100).selectExpr("id % 3 AS account", "id % 2 AS market", "id AS seq", "1L AS d", "5L AS q").coalesce(1)
    rows.write.option("maxRecordsPerFile", 8).parquet(f"{place}/in")
    ran = runs.run_versions(positions.fold_positions(runs.read_stream(spark, f"{place}/in", 2)), f"{place}/out", f"{place}/checkpoint")
    sizes = []
    for k in ran:
        before = {} if not k else sizes_of(spark, place, ran[:k])
        now = sizes_of(spark, place, ran[: k + 1])
        sizes.append(sum(now.values()) - sum(before.values()))
    assert len(ran) == 7 and max(sizes) <= 16


def sizes_of(spark, place, batches):
    """Rows that each key took or refused up to a batch."""
    rows = spark.read.parquet(*(f"{place}/out/batch={k}" for k in batches)).groupBy("account", "market").agg(F.max("n").alias("n"), F.sum(F.size("late")).alias("late"))
    return {(r["account"], r["market"]): r["n"] + r["late"] for r in rows.collect()}
