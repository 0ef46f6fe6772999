"""As-of merges and running state over buckets of time.

A window over all rows of a key makes a hot key one task. Here windows hold one bucket of a key; what a bucket starts from is carried by a
table of one row a key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .debits import written
from .risk import funding_owed, product, wide


def bucket(time: Column, width: int) -> Column:
    """The number of the bucket of ``width`` that a time falls into, also before 0."""
    return F.floor(F.call_function("div", time - F.pmod(time, F.lit(width).cast("long")), F.lit(width).cast("long")))


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], time: str, value: str, width: int) -> DataFrame:
    """``rows`` with the ``value`` of their key's last mark at or before their ``time`` (null: none); of marks of one time the greatest counts.

    Marks and rows are merged by a window on key and bucket of time, so there is no range join; buckets without a mark before a row take the last one of earlier buckets. Null
    values are no marks; rows with a null key or time have none.
    """
    marks = marks.where(F.col(value).isNotNull()).groupBy(*keys, time).agg(F.max(value).alias("__value"))
    b = bucket(F.col(time), width).alias("__b")
    both = rows.select("*", b, F.lit(1).alias("__row"), F.lit(None).cast(marks.schema["__value"].dataType).alias("__value")).unionByName(marks.select("*", b, F.lit(0).alias("__row")), allowMissingColumns=True)
    ends = both.groupBy(*keys, "__b").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(time))).alias("__last"))
    before = F.last("__last", True).over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*keys, "__b", before.alias("__edge"))
    inside = F.last("__value", True).over(W.partitionBy(*keys, "__b").orderBy(time, "__row").rowsBetween(W.unboundedPreceding, 0))
    merged = both.withColumn("__value", inside).where("__row = 1").join(ends, [*keys, "__b"], "left")
    return merged.withColumn(value, F.coalesce("__value", "__edge")).select(*rows.columns, value)


def running(rows: DataFrame, keys: list[str], order: list[str], width: int, total: str, held: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``total`` over earlier rows of their key, and ``last``, the ``held`` of the row before (null: first).

    Buckets are cut by the first column of ``order``.
    """
    rows = rows.withColumn("__b", bucket(F.col(order[0]), width)).repartition(*keys, "__b")  # dealt out once for sums, windows and the join
    ends = rows.groupBy(*keys, "__b").agg(F.sum(total).alias("__sum"), F.max_by(held, F.struct(*order)).alias("__held"))
    w = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "__b", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__start"), F.last("__held").over(w).alias("__edge"))
    w = W.partitionBy(*keys, "__b").orderBy(*order)
    inside = rows.withColumns({"__own": F.coalesce(F.sum(total).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "__lag": F.lag(held).over(w)})
    out = inside.join(ends, [*keys, "__b"])
    return out.withColumns({"before": F.col("__own") + F.col("__start"), "last": F.coalesce("__lag", "__edge")}).drop("__b", "__own", "__lag", "__start", "__edge")


def party_fills(fills: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """Two rows a fill, its taker's and its maker's (accounts from -2 down): signed lots, position before, and the market's funding prefix now and at the party's fill before. Fills of one time, order and line go by their lots."""
    d = F.col("side") * F.col("base")
    priced = as_of(fills, marks, ["market"], "ts", "prefix", width).withColumn("prefix", F.coalesce("prefix", F.lit(0)))
    rows = F.array(F.struct(F.col("taker").alias("account"), d.alias("d")), F.struct((-F.col("maker") - 2).alias("account"), (-d).alias("d")))
    both = priced.select("market", "ts", "ok", "ln", "prefix", F.inline(rows))
    return running(both, ["account", "market"], ["ts", "ok", "ln", "d"], width, "d", "prefix")


def fill_funding(fills: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """Funding that each party settles at each fill: ``(account, market, ts, ok, ln, position, funding)``, ``position`` being that before the fill (positive funding is received)."""
    owed = wide(funding_owed(wide(F.col("before")), F.coalesce("last", "prefix"), F.col("prefix")))
    return party_fills(fills, marks, width).select("account", "market", "ts", "ok", "ln", F.col("before").alias("position"), owed.alias("funding"))


def funding_balance(fills: DataFrame, marks: DataFrame, width: int, times: DataFrame | None = None) -> DataFrame:
    """By market the funding settled at fills by those who received and by those who paid, and what is owed at the last mark; these sum to 0, as every lot has two parties.

    Fills between two marks settle at the first of them, so a party's lots are summed by mark, and a key's window has a row a mark at most. Rows are dealt out once; what mark applies is looked up by
    market and time before that, in a table of the ``times`` ``(market, ts)`` of all fills (others may be among them). That table and the marks are written, so that their size is known and they are sent to all where small.
    """
    known = marks.where("prefix IS NOT NULL").groupBy("market", "ts").agg(F.max("prefix").alias("prefix"))
    known = written(known.withColumn("n", F.row_number().over(W.partitionBy("market").orderBy("ts"))), "marks")
    times = fills if times is None else times
    times = written(as_of(times.select("market", "ts").where("market IS NOT NULL AND ts IS NOT NULL").distinct(), known, ["market"], "ts", "n", width), "times")
    d, n = F.col("side") * F.col("base"), F.when(F.col("ts").isNotNull(), F.coalesce("n", F.lit(0)))  # 0: before all marks; null: no time, which is last
    rows = F.array(F.struct(F.col("taker").alias("account"), d.alias("d")), F.struct((-F.col("maker") - 2).alias("account"), (-d).alias("d")))
    both = fills.join(times, ["market", "ts"], "left").select("market", n.alias("n"), F.inline(rows)).repartition("account", "market")
    lots = both.groupBy("account", "market", "n").agg(F.sum("d").alias("d")).join(known.select("market", "n", "prefix"), ["market", "n"], "left").withColumn("prefix", F.coalesce("prefix", F.lit(0).cast("long")))
    w = W.partitionBy("account", "market").orderBy(F.asc_nulls_last("n"))
    end = w.rowsBetween(W.unboundedPreceding, 0)
    steps = lots.select("market", "prefix", "d", F.sum("d").over(end).alias("after"), F.coalesce(F.lag("prefix").over(w), "prefix").alias("last"), F.lead(F.lit(1)).over(w).isNull().alias("ends"))
    after = F.coalesce("after", F.lit(0))
    funding, zero = product(after - F.coalesce("d", F.lit(0)), F.col("last") - F.col("prefix")), wide(0)
    total = lambda x, name: wide(F.sum(x)).alias(name)
    sums = steps.select("market", "ends", after.alias("position"), "prefix", funding.alias("funding")).groupBy("market").agg(
        total(F.greatest("funding", zero), "received"), total(F.least("funding", zero), "paid"), total(F.when(F.col("ends"), product(F.col("position"), F.col("prefix"))), "settled"), total(F.when(F.col("ends"), F.col("position")), "lots")
    )
    now = marks.groupBy("market").agg(F.max_by("prefix", "ts").alias("now"))
    out = sums.join(now, "market").select("market", "received", "paid", wide(F.col("settled") - wide(F.col("lots") * F.col("now"))).alias("outstanding")).where("outstanding IS NOT NULL")
    return out.withColumn("total", wide(F.col("received") + F.col("paid") + F.col("outstanding")))
