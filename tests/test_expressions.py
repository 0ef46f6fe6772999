"""Rounding, packing, wide integers and position changes against plain Python."""

from decimal import Decimal
from fractions import Fraction

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebook.functions import ceil_div, clamp, euclid_div, floor_div, median3, next_hour, order_index, order_market, order_nonce, path_bits, to_hour, trunc_div
from tidebook.functions.wide import mul_div, product_at_most, zero_price, zero_quote
from tidebook.operators.folds import change_position, sign

EDGES = [-(2**40), -3601, -60, -7, -1, 0, 1, 7, 59, 60, 3_600_000, 3_600_001, 2**40]


def test_divisions(spark):
    df = spark.createDataFrame([(x,) for x in EDGES], "x long")
    rows = df.select("x", trunc_div(F.col("x"), 60).alias("t"), floor_div(F.col("x"), 60).alias("f"), euclid_div(F.col("x"), 60).alias("e"), ceil_div(F.abs("x"), 60).alias("c"), clamp(F.col("x"), -50, 50).alias("k")).collect()
    for r in rows:
        x = r["x"]
        assert (r["t"], r["f"], r["e"], r["c"], r["k"]) == (sign(x) * (abs(x) // 60), x // 60, x // 60, -(-abs(x) // 60), max(-50, min(50, x)))


def test_times(spark):
    df = spark.createDataFrame([(x,) for x in EDGES if x >= 0], "x long")
    for r in df.select("x", to_hour(F.col("x")).alias("h"), next_hour(F.col("x")).alias("n")).collect():
        assert r["h"] == r["x"] // 3_600_000 * 3_600_000 and r["n"] == r["h"] + 3_600_000


def test_packing(spark):
    df = spark.createDataFrame([(0, 1), (254, 2**48 - 1), (4094, 5)], "m long, n long")
    i = order_index(F.col("m"), F.col("n"))
    for r in df.select("m", "n", i.alias("i"), order_market(i).alias("m2"), order_nonce(i).alias("n2"), path_bits(F.col("m"), 12).alias("b")).collect():
        assert r["i"] == r["m"] * 2**48 + r["n"] and (r["m2"], r["n2"]) == (r["m"], r["n"])
        assert sum(b << k for k, b in enumerate(r["b"])) == r["m"]


def test_median(spark):
    df = spark.createDataFrame([(1, 2, 3), (3, 1, 2), (2, 2, 1), (-5, 0, 5)], "a long, b long, c long")
    assert all(r["m"] == sorted([r["a"], r["b"], r["c"]])[1] for r in df.select("*", median3(F.col("a"), F.col("b"), F.col("c")).alias("m")).collect())


def test_wide(spark):
    big = [(2**96, 2**48, 10**15), (-(2**96), 3, 7), (10**37, 10**37, 1), (5, 5, 0), (None, 1, 1)]
    df = spark.createDataFrame([tuple(None if v is None else Decimal(v) for v in r) for r in big], "a decimal(38,0), b decimal(38,0), c decimal(38,0)")
    got = [r[0] for r in df.select(mul_div("a", "b", "c")).collect()]
    assert got[:2] == [Decimal(2**96 * 2**48 // 10**15), Decimal(-(2**96 * 3 // 7))] and got[2:] == [None, None, None]
    assert spark.range(1).select(product_at_most(F.lit(2), F.lit(3), F.lit(2), F.lit(3))).first()[0] is True


@given(st.integers(1, 2**32), st.integers(1, 2**60), st.integers(-(2**60), 2**60), st.sampled_from([1, -1]), st.integers(1, 10_000))
def test_zero_price(mark, mm, tav, side, fraction):
    import pandas as pd

    s = lambda x: pd.Series([x], dtype=object)
    got = int(zero_price.func(s(mark), s(mm), s(tav), s(side), s(fraction))[0])
    exact = Fraction(mark * mm * 10_000 - tav * side * mark * fraction, mm * 10_000)
    want = -(-exact.numerator // exact.denominator) if side > 0 else exact.numerator // exact.denominator
    assert got == min(max(want, 1), 2**32 - 1)
    quote = int(zero_quote.func(s(mark), s(mm), s(tav), s(side), s(fraction))[0])
    assert abs(quote - exact) < 1


@given(st.lists(st.tuples(st.integers(-50, 50).filter(bool), st.integers(1, 10_000)), max_size=30))
def test_change_position(trades):
    p = e = r = cash = 0
    for d, q in trades:
        p, e, more = change_position(p, e, d, q)
        r, cash = r + more, cash - sign(d) * q
    assert p == sum(d for d, _ in trades) and e >= 0 and (p != 0 or e == 0)
    assert r == sign(p) * e + cash  # profit is entry value plus net cash, whatever was rounded
