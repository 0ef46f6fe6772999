"""Order helpers on hand-made rows."""

import hashlib

from pyspark.sql import functions as F

from tidebook.operators import orders


def test_lookup_and_shares(spark):
    df = spark.createDataFrame([([(1, "a"), (2, "b"), (1, "c")],)], "items array<struct<id: long, v: string>>")
    assert df.select(orders.last_match(F.col("items"), "id", F.lit(1))["v"], orders.last_match(F.col("items"), "id", F.lit(9))["v"]).first()[:] == ("c", None)


def test_chain(spark):
    df = spark.createDataFrame([(1, 2, 30), (1, 1, 20), (2, 1, 5)], "market long, seq long, value long")
    got = {r["market"]: (r["digest"], r["n"]) for r in orders.hash_chain(df).collect()}
    one = hashlib.sha256(b"|1|20").hexdigest()
    assert got == {1: (hashlib.sha256(f"{one}|2|30".encode()).hexdigest(), 2), 2: (hashlib.sha256(b"|1|5").hexdigest(), 1)}


def test_flags(spark):
    rows = [(5, 1), (-5, 1), (5, 0), (-5, 0), (0, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "p long, a int").select(orders.reduces(F.col("p"), F.col("a"))).collect()]
    assert got == [True, False, False, True, False]
