"""Queries over order books, premiums and funding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book, funding, orders
from ..sources.tables import fills, markets, resting_orders, samples, sql

TARGET, INDEX = 20_000, 5_000
PRIORITY = "PARTITION BY market, is_ask ORDER BY CASE WHEN is_ask = 1 THEN price ELSE -price END, CASE WHEN is_ask = 1 THEN nonce ELSE -nonce END"
IMPACTS = f"""w AS (SELECT market, is_ask, price, base, coalesce(sum(base) OVER b, 0) AS b, coalesce(sum(base * price) OVER b, 0) AS q FROM book WINDOW b AS ({PRIORITY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hit AS (SELECT market, is_ask, b + ({TARGET} - q + price - 1) // price AS lots, q + ({TARGET} - q + price - 1) // price * price AS quote FROM w WHERE q < {TARGET} AND q + base * price >= {TARGET}),
impacts AS (SELECT s.market, s.is_ask, CAST(coalesce(CASE WHEN s.is_ask = 1 THEN (quote + lots - 1) // lots ELSE quote // lots END, 0) AS BIGINT) AS impact FROM (SELECT DISTINCT market, is_ask FROM book) s LEFT JOIN hit h ON s.market = h.market AND s.is_ask = h.is_ask)"""
MINUTES = f"""last AS (SELECT market, ts // 60000 * 60000 AS minute, coalesce(nullif(coalesce(last(value ORDER BY ts, event_id) FILTER (WHERE event_id % 2 = 0), 0), 0), {INDEX}) AS bid, coalesce(nullif(coalesce(last(value ORDER BY ts, event_id) FILTER (WHERE event_id % 2 = 1), 0), 0), {INDEX}) AS ask FROM samples GROUP BY 1, 2),
xs AS (SELECT market, minute, greatest(0, bid - {INDEX}) - greatest(0, {INDEX} - ask) AS x FROM last),
minutes AS (SELECT market, minute, CAST(sign(x) AS BIGINT) * (abs(x) * 1000000 // {INDEX}) AS premium FROM xs)"""


def _minutes(spark, d):
    return funding.minute_premiums(samples(spark, d), INDEX)


QUERIES = {
    "book_ranks": lambda s, d: book.ranked(resting_orders(s, d)),
    "book_best_orders": lambda s, d: book.best_orders(resting_orders(s, d)),
    "book_depth": lambda s, d: book.depth(resting_orders(s, d)),
    "impact_prices": lambda s, d: book.impact_prices(resting_orders(s, d), TARGET),
    "impact_mid": lambda s, d: book.impact_mid(book.impact_prices(resting_orders(s, d), TARGET)),
    "next_order_nonces": lambda s, d: book.next_nonces(resting_orders(s, d)),
    "order_indices": lambda s, d: book.packed_indices(resting_orders(s, d)),
    "locked_balances": lambda s, d: book.locked_balances(resting_orders(s, d)).drop("fits").withColumn("locked", F.col("locked").cast("long")),
    "book_crossings": lambda s, d: book.crossings(resting_orders(s, d)),
    "order_size_checks": lambda s, d: book.size_checks(resting_orders(s, d).withColumns({"twap": F.col("nonce") % 9 == 0, "immediate": F.col("nonce") % 7 == 0}), 2, 500, 40_000),
    "position_tied_sizes": lambda s, d: fills(s, d).groupBy(F.col("taker").alias("account"), "market").agg(F.sum(F.col("side") * F.col("base")).alias("position")).join(markets(s, d), "market").select("account", "market", book.tied_size(F.col("position"), 2_000_000, F.col("mark")).alias("size")),
    "order_flags": lambda s, d: resting_orders(s, d).select("nonce", orders.reduces(F.col("account") - 700, F.col("is_ask")).alias("reduces"), orders.triggered(F.lit(450), F.col("price") * (F.col("nonce") % 3), F.col("is_ask"), F.col("nonce") % 2 == 0).alias("triggered"), orders.switched_off(F.col("account") % 5 * F.col("ts"), F.col("ts") * 2).alias("off")),
    "order_counters": lambda s, d: orders.counters(resting_orders(s, d).select("account", "market", F.when(F.col("nonce") % 4 == 0, -1).otherwise(1).cast("long").alias("change"), (F.col("nonce") % 3 == 0).alias("tied"))),
    "order_families": lambda s, d: orders.families(resting_orders(s, d).select(F.col("nonce").alias("order_id"), F.when(F.col("nonce") % 4 != 0, F.col("nonce") - F.col("nonce") % 4).alias("parent_id"), "base")),
    "funding_settlements": lambda s, d: orders.settlements(fills(s, d).groupBy(F.col("taker").alias("account"), (F.col("market") % 10).alias("market")).agg(F.sum(F.col("side") * F.col("base")).alias("position")).withColumn("last_prefix", F.col("account") * 1000), funding.funding_prefix(_minutes(s, d), INDEX).groupBy("market").agg(F.max_by("prefix", "hour").alias("prefix"))),
    "position_usdc": lambda s, d: fills(s, d).select("ok", "ln", orders.position_usdc(F.col("quote") * 1000 - 2_000_000_000, F.col("side") * F.col("base"), F.col("quote")).alias("usdc")),
    "sample_hash_chain": lambda s, d: orders.hash_chain(samples(s, d).select("market", F.col("event_id").alias("seq"), "value")),
    "minute_premiums": _minutes,
    "premium_sums": lambda s, d: funding.premium_sums(_minutes(s, d)),
    "funding_prefix": lambda s, d: funding.funding_prefix(_minutes(s, d), INDEX),
    "due_flags": lambda s, d: funding.due_flags(samples(s, d)),
    "hourly_ohlc": lambda s, d: funding.hourly_ohlc(samples(s, d)),
    "oracle_updates": lambda s, d: samples(s, d).select("event_id", funding.oracle_rule(F.col("value"), F.abs("value") % 7 * 1_000_000_000, F.abs("value") % 100_000_000).alias("taken")),
}

SQL = {
    "book_ranks": sql("book", body=f"SELECT market, is_ask, price, nonce, base, CAST(row_number() OVER ({PRIORITY}) AS INTEGER) AS rank FROM book"),
    "book_best_orders": sql("book", body=f"SELECT market, is_ask, price, nonce, base FROM book QUALIFY row_number() OVER ({PRIORITY}) = 1"),
    "book_depth": sql("book", body=f"SELECT market, is_ask, price, nonce, CAST(coalesce(sum(base) OVER b, 0) AS BIGINT) AS better_base, CAST(coalesce(sum(base * price) OVER b, 0) AS BIGINT) AS better_quote FROM book WINDOW b AS ({PRIORITY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "impact_prices": sql("book", body=f", {IMPACTS} SELECT * FROM impacts"),
    "impact_mid": sql("book", body=f", {IMPACTS} SELECT market, ask, bid, CASE WHEN ask <> 0 AND bid <> 0 THEN (ask + bid) // 2 ELSE 0 END AS mid FROM (SELECT market, coalesce(max(impact) FILTER (WHERE is_ask = 1), 0) AS ask, coalesce(max(impact) FILTER (WHERE is_ask = 0), 0) AS bid FROM impacts GROUP BY market)"),
    "next_order_nonces": sql("book", body="SELECT market, is_ask, nonce AS order_id, CAST(CASE WHEN is_ask = 1 THEN n ELSE 281474976710656 - n END AS BIGINT) AS nonce FROM (SELECT *, row_number() OVER (PARTITION BY market, is_ask ORDER BY ts, nonce) AS n FROM book)"),
    "order_indices": sql("book", body="SELECT nonce, market * 281474976710656 + nonce AS order_index, market AS unpacked_market, nonce AS unpacked_nonce FROM book"),
    "locked_balances": sql("book", body="SELECT account, is_ask, CAST(sum(CASE WHEN is_ask = 1 THEN base * 10 ELSE base * price END) AS BIGINT) AS locked, count(*) AS n_orders FROM book GROUP BY 1, 2"),
    "book_crossings": sql("book", body="SELECT market, max(price) FILTER (WHERE is_ask = 0) AS bid, min(price) FILTER (WHERE is_ask = 1) AS ask, coalesce(max(price) FILTER (WHERE is_ask = 0) >= min(price) FILTER (WHERE is_ask = 1), false) AS crossed FROM book GROUP BY market"),
    "order_size_checks": sql("book", body="SELECT market, CASE WHEN base * price > 40000 THEN 'over_limit' WHEN (base < 2 OR base * price < 500) AND nonce % 9 <> 0 AND nonce % 7 <> 0 THEN 'too_small' ELSE 'ok' END AS rule, count(*) AS n FROM book GROUP BY 1, 2"),
    "position_tied_sizes": sql("fills", "markets", body="SELECT account, market, CAST(least(abs(position), 281474976710655, 2000000 // mark) AS BIGINT) AS size FROM (SELECT taker AS account, market, sum(side * base) AS position FROM fills GROUP BY 1, 2) JOIN markets USING (market)"),
    "order_flags": sql("book", body="SELECT nonce, CASE WHEN is_ask = 1 THEN account > 700 ELSE account < 700 END AS reduces, t = 0 OR CASE WHEN (is_ask = 1) = (nonce % 2 = 0) THEN 450 <= t ELSE 450 >= t END AS triggered, account % 5 * ts <> 0 AND account % 5 * ts <= ts * 2 AS off FROM (SELECT *, price * (nonce % 3) AS t FROM book)"),
    "order_counters": sql("book", body="SELECT account, market, CAST(sum(c) AS BIGINT) AS open_orders, CAST(sum(CASE WHEN nonce % 3 = 0 THEN c ELSE 0 END) AS BIGINT) AS tied_orders FROM (SELECT *, CASE WHEN nonce % 4 = 0 THEN -1 ELSE 1 END AS c FROM book) GROUP BY 1, 2"),
    "order_families": sql("book", body="SELECT c.nonce AS order_id, p.nonce AS parent_id, c.base, p.base AS parent_base, c.base > p.base AS larger FROM book c JOIN book p ON c.nonce % 4 <> 0 AND p.nonce = c.nonce - c.nonce % 4"),
    "funding_settlements": sql("fills", "samples", body=f""", {MINUTES}, hours AS (SELECT market, minute // 3600000 AS hour, CAST(sum(premium) AS BIGINT) AS s FROM minutes GROUP BY 1, 2),
a AS (SELECT *, CAST(sign(s) AS BIGINT) * (abs(s) // 60) AS avg FROM hours), f AS (SELECT *, greatest(least(avg + greatest(least(100 - avg, 500), -500), 40000), -40000) AS f FROM a),
p AS (SELECT market, CAST(sum(sign(f) * (abs(f) // 8) * {INDEX}) AS BIGINT) AS prefix FROM f GROUP BY market),
x AS (SELECT taker AS account, market % 10 AS market, sum(side * base) AS position FROM fills GROUP BY 1, 2)
SELECT account, CAST(sum(position * (account * 1000 - prefix)) AS BIGINT) AS funding FROM x JOIN p USING (market) GROUP BY account"""),
    "position_usdc": sql("fills", body="SELECT ok, ln, (v - ((v % 1000000) + 1000000) % 1000000) // 1000000 - side * quote AS usdc FROM (SELECT *, quote * 1000 - 2000000000 AS v FROM fills)"),
    "sample_hash_chain": sql("samples", body=""", s AS (SELECT market, event_id, value, row_number() OVER (PARTITION BY market ORDER BY event_id) AS k FROM samples),
c AS (SELECT market, k, sha256('|' || event_id || '|' || value) AS h FROM s WHERE k = 1 UNION ALL SELECT s.market, s.k, sha256(c.h || '|' || s.event_id || '|' || s.value) FROM c JOIN s ON s.market = c.market AND s.k = c.k + 1)
SELECT market, h AS digest, k AS n FROM c QUALIFY row_number() OVER (PARTITION BY market ORDER BY k DESC) = 1""").replace("WITH ", "WITH RECURSIVE ", 1),
    "minute_premiums": sql("samples", body=f", {MINUTES} SELECT * FROM minutes"),
    "premium_sums": sql("samples", body=f", {MINUTES} SELECT market, minute, CAST(sum(premium) OVER (PARTITION BY market, minute // 3600000 ORDER BY minute ROWS UNBOUNDED PRECEDING) AS BIGINT) AS premium_sum FROM minutes"),
    "funding_prefix": sql("samples", body=f""", {MINUTES}, hours AS (SELECT market, minute // 3600000 * 3600000 AS hour, CAST(sum(premium) AS BIGINT) AS s, count(*) AS n FROM minutes GROUP BY 1, 2),
a AS (SELECT *, CAST(sign(s) AS BIGINT) * (abs(s) // 60) AS avg FROM hours), f AS (SELECT *, greatest(least(avg + greatest(least(100 - avg, 500), -500), 40000), -40000) AS f FROM a),
r AS (SELECT market, hour, n, CAST(sign(f) * (abs(f) // 8) AS BIGINT) AS rate FROM f)
SELECT market, hour, n, rate, CAST(sum(rate * {INDEX}) OVER (PARTITION BY market ORDER BY hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix FROM r"""),
    "due_flags": sql("samples", body="SELECT market, event_id, ts >= last // 3600000 * 3600000 + 3600000 AS funding, ts // 60000 - last // 60000 >= 2 AS premium, ts // 60000 > last // 60000 AS permitted FROM (SELECT *, lag(ts) OVER (PARTITION BY market ORDER BY ts, event_id) AS last FROM samples) WHERE last IS NOT NULL"),
    "hourly_ohlc": sql("samples", body="SELECT market, hour, first(value ORDER BY ts, event_id) AS first, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS last, count(*) AS n FROM (SELECT *, ts // 3600000 * 3600000 AS hour FROM samples) GROUP BY 1, 2"),
    "oracle_updates": sql("samples", body="SELECT event_id, value <> 0 AND m <> 0 AND CASE WHEN oi > 0 THEN m <= least(4294967295, 72057594037927935 // oi) ELSE true END AS taken FROM (SELECT event_id, value, abs(value) % 7 * 1000000000 AS m, abs(value) % 100000000 AS oi FROM samples)"),
}
