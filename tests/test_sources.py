"""Block documents, telemetry and streams."""

import json

from pyspark.sql import functions as F

from tidebook.operators.folds import change_position
from tidebook.sources import blocks, telemetry
from tidebook.streaming.positions import fold_positions
from tidebook.streaming.windows import funding_hours, tumbling


def test_blocks(spark, tmp_path):
    for n, root in ((5, "b"), (6, "c"), (8, "d")):
        tx = [{"tx_type": 12, "account_index": 3, "api_key_index": 255, "transfer": {"from_account_index": 3, "to_account_index": 4, "asset_index": 1, "amount": 79228162514264337593543950335, "usdc_fee": 1}}, {"tx_type": 14, "account_index": 2**48 - 1, "create_order": {"market_index": 1, "price": 7}}]
        doc = {"block_number": n, "created_at": 100 - n, "old_state_root": "a", "new_state_root": root, "txs": tx, "accounts": [{"account_index": 3, "collateral": 5, "positions": {"1": {"position": 4}, "2": {"position": 0}}}]}
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=1))
    b = blocks.read_blocks(spark, str(tmp_path))
    t = blocks.transactions(b).where("block_number = 5").orderBy("position").collect()
    assert [r["kind"] for r in t] == ["l2_transfer", "l2_create_order"] and t[0]["transfer"]["amount"] == 2**96 - 1
    assert t[0]["api_key_index"] is None and t[1]["account_index"] is None
    assert [tuple(r) for r in blocks.positions(b).where("block_number = 5").select("account", "market", "position").collect()] == [(3, 1, 4)]
    assert {(r["block_number"], r["fault"]) for r in blocks.continuity(b).collect()} == {(6, "backwards"), (8, "missing")}


def test_telemetry(spark, tmp_path):
    for job, body in (("a", {"wall_seconds": 4.0}), ("b", {"wall_seconds": 0.0, "pipelined_seconds": 2.0}), ("c", {"wall_seconds": 4.0}), ("d", {"total_txs": 10, "tps": 5.0})):
        p = tmp_path / "bench" / "v1" / "m8" / "20260101-000000" / f"{job}.json"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(body))
    r = telemetry.grouped(telemetry.read_summaries(spark, f"{tmp_path}/*/*/*/*/*.json")).collect()
    assert [(x["benchmark"], x["release"], x["machine"], x["run"], x["least"], x["most"], x["n"]) for x in r] == [("bench", "v1", "m8", "20260101-000000", 2.0, 4.0, 3)]
    assert r[0]["mean"] == 2.66666667
    (tmp_path / "log.txt").write_text("prove: time: 6.39s\nchain: elapsed_ms=120\nnoise\n")
    assert {tuple(x) for x in telemetry.read_log(spark, str(tmp_path / "log.txt")).collect()} == {("prove", 6.39), ("chain", 0.12)}
    telemetry.write_report(telemetry.grouped(telemetry.read_summaries(spark, f"{tmp_path}/*/*/*/*/*.json")), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True).count() == 1
    rows = spark.createDataFrame([("a", None), ("b", 3)], "n string, cores int")
    got = telemetry.with_defaults(rows, spark.createDataFrame([(8,)], "cores int"))
    assert {tuple(x) for x in got.collect()} == {("a", 8), ("b", 3)}


def stream(spark, df, path, name, fn, mode):
    df.repartition(1).write.parquet(path)
    q = fn(spark.readStream.schema(df.schema).parquet(path)).writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows(spark, tmp_path):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("market"), F.timestamp_seconds(F.col("id") * 37).alias("ts"), (F.col("id") * 7919 % 1000 - 500).alias("value"))
    got = stream(spark, df, str(tmp_path / "in"), "w", lambda s: tumbling(s, "ts"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tumbling(df, "ts").collect()))
    for r in funding_hours(df, "ts").collect():
        total = next(t["total"] for t in got.collect() if (t["market"], t["start"]) == (r["market"], r["start"]))
        assert r["average"] == (abs(total) // 60) * (1 if total >= 0 else -1)


def test_positions(spark, tmp_path):
    df = spark.range(0, 300).select((F.col("id") % 4).alias("account"), (F.col("id") % 3).alias("market"), F.col("id").alias("seq"), (F.col("id") * 31 % 41 - 20).alias("d"), (F.col("id") * 53 % 997 + 1).alias("q"))
    got = {(r["account"], r["market"]): r for r in stream(spark, df, str(tmp_path / "in"), "p", fold_positions, "update").collect()}
    want = {}
    for r in df.orderBy("seq").collect():
        p, e, x = want.get((r["account"], r["market"]), (0, 0, 0))
        p, e, more = change_position(p, e, r["d"], r["q"])
        want[r["account"], r["market"]] = (p, e, x + more)
    assert {k: (r["position"], int(r["entry_quote"]), int(r["realised"])) for k, r in got.items()} == want
