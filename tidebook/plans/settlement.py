"""Queries over money in order: debits that need funds, and funding settled at fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, debits, shares
from ..sources.tables import fill_times, fills, funding_marks, operations, pool_requests, sql, stakes

MONTH = 30 * 86_400_000


def _pooled(spark, d):
    return fills(spark, d).withColumn("market", F.col("market") % 25)


def _debits(spark, d):
    ops = operations(spark, d)
    return debits.statuses(ops, debits.ordered_debits(ops, 2)[0]).select("seq", "kind", "status")


def _balances(spark, d):
    return debits.ordered_debits(operations(spark, d), 2)[1].withColumn("balance", F.col("balance").cast("string"))


def _funding(spark, d):
    return asof.fill_funding(_pooled(spark, d), funding_marks(spark, d), MONTH).withColumn("funding", F.col("funding").cast("string"))


def _balance(spark, d):
    out = asof.funding_balance(_pooled(spark, d), funding_marks(spark, d), MONTH, fill_times(spark, d).withColumn("market", F.col("market") % 25))
    return out.select("market", *(F.col(c).cast("string").alias(c) for c in ("received", "paid", "outstanding", "total")))


def _staking(spark, d):
    rows, pools, holdings = stakes(spark, d)
    return shares.pool_shares(rows, pools, 10, holdings).withColumn("balance", F.col("balance").cast("string"))


def _pools(spark, d):
    rows, pools, holdings = pool_requests(spark, d)
    return shares.pool_shares(rows, pools, 10, holdings).withColumn("balance", F.col("balance").cast("string"))


QUERIES = {"staking_ledger": _staking, "pool_share_ledger": _pools, "ordered_debits": _debits, "ordered_balances": _balances, "fill_funding": _funding, "funding_balance": _balance}

#: One row after the other, with all balances in a list: account x 2 + asset is an account's place, that of the fee account's cash is 1.
RUN = """, k AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, account * 2 + asset AS own, account * 2 + 1 AS cash, dest * 2 + asset AS other, amount > 0 AND (kind <> 'transfer' OR account <> dest) AS valid FROM operations),
run AS (
 SELECT CAST(0 AS BIGINT) AS i, list_transform(range(0, (SELECT max(account) * 2 + 2 FROM operations)), lambda x: CAST(0 AS BIGINT)) AS b, false AS ok
 UNION ALL
 SELECT i, CASE WHEN ok THEN list_transform(b, lambda x, j: x + CASE WHEN j <> own THEN 0 WHEN kind = 'deposit' THEN amount ELSE -amount END
   + CASE WHEN kind = 'transfer' THEN CASE WHEN j = other THEN amount ELSE 0 END + CASE WHEN j = cash THEN -fee ELSE 0 END + CASE WHEN j = 1 THEN fee ELSE 0 END ELSE 0 END) ELSE b END, ok
 FROM (SELECT k.*, r.b, valid AND CASE WHEN kind = 'deposit' THEN true WHEN kind = 'transfer' AND asset = 1 THEN r.b[own] >= amount + fee WHEN kind = 'transfer' THEN r.b[own] >= amount AND r.b[cash] >= fee ELSE r.b[own] >= amount END AS ok
  FROM run r JOIN k ON k.i = r.i + 1))"""
FUNDED = """, p AS (SELECT f.*, f.market % 25 AS m, coalesce(k.prefix, 0) AS prefix FROM fills f ASOF LEFT JOIN marks k ON f.market % 25 = k.market AND f.ts >= k.ts),
q AS (SELECT taker AS account, m AS market, ts, ok, ln, side * base AS d, prefix FROM p UNION ALL SELECT -maker - 2, m, ts, ok, ln, -side * base, prefix FROM p),
s AS (SELECT *, coalesce(sum(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, coalesce(lag(prefix) OVER w, prefix) AS last FROM q WINDOW w AS (PARTITION BY account, market ORDER BY ts, ok, ln)),
paid AS (SELECT *, CAST(held AS HUGEINT) * (last - prefix) AS funding FROM s)"""


#: One row of each pool after the other, with its holders' shares and principals in maps.
STAKING = """, x AS (SELECT account % 17 AS pool, event_id AS seq, ts, account AS holder, CASE WHEN event_id * 7 % 5 < 3 THEN 'stake' ELSE 'unstake' END AS kind, CASE WHEN event_id * 7 % 5 < 3 THEN 1 ELSE -1 END AS s,
 CAST(abs(value) AS HUGEINT) AS n, account < 17 AS op, CASE WHEN event_id % 13 = 0 THEN 100000000 END AS available, CASE WHEN event_id % 11 = 0 THEN abs(value) * 300 END AS bound, account % 17 % 8 = 7 AS frozen,
 row_number() OVER (PARTITION BY account % 17 ORDER BY event_id) AS i FROM samples),
h AS (SELECT pool, map(list(holder), list(CAST(holder * 100 AS HUGEINT))) AS hs, map(list(holder), list(CAST(holder * 1000 AS HUGEINT))) AS ps FROM (SELECT DISTINCT pool, holder FROM x WHERE NOT op AND holder % 5 = 0) GROUP BY pool),
run AS (SELECT pool, CAST(0 AS BIGINT) AS i, false AS taken, CAST(0 AS HUGEINT) AS amount, CAST(NULL AS HUGEINT) AS held, CAST(NULL AS HUGEINT) AS principal, CAST(pool + 1000000 AS HUGEINT) AS total, CAST((pool + 1000000) * 30007 AS HUGEINT) AS balance,
  CAST(400000 AS HUGEINT) AS own, coalesce(hs, MAP {CAST(-1 AS BIGINT): CAST(0 AS HUGEINT)}) AS hs, coalesce(ps, MAP {CAST(-1 AS BIGINT): CAST(0 AS HUGEINT)}) AS ps FROM (SELECT DISTINCT pool FROM x) LEFT JOIN h USING (pool)
 UNION ALL
 SELECT pool, i, ok, CASE WHEN ok THEN amt ELSE 0 END, CASE WHEN op THEN NULL WHEN ok THEN h1 ELSE h0 END, CASE WHEN op THEN NULL WHEN ok THEN p1 ELSE p0 END, CASE WHEN ok THEN t ELSE total END, CASE WHEN ok THEN b ELSE balance END,
  CASE WHEN ok THEN o ELSE own END, CASE WHEN ok AND NOT op THEN map_concat(hs, MAP {holder: h1}) ELSE hs END, CASE WHEN ok AND NOT op THEN map_concat(ps, MAP {holder: p1}) ELSE ps END
 FROM (SELECT *, CASE WHEN n <= 0 THEN false WHEN s = 1 THEN NOT frozen AND coalesce(amt * 10 <= available, true) AND (op OR t * 3000 <= own * 10000) WHEN n > total THEN false WHEN op THEN n <= own AND (frozen OR t * 3000 <= o * 10000)
   WHEN n > h0 THEN false ELSE coalesce(bound * 100 <= 10 * CASE WHEN t = 0 THEN h1 * 1000 ELSE h1 * b // (t * 10) END, true) END AS ok
  FROM (SELECT *, CAST(total + s * n AS HUGEINT) AS t, CAST(balance + s * amt * 10 AS HUGEINT) AS b, CAST(own + CASE WHEN op THEN s * n ELSE 0 END AS HUGEINT) AS o, CAST(h0 + s * n AS HUGEINT) AS h1,
    CAST(CASE WHEN s = 1 THEN p0 + amt WHEN h0 = 0 THEN 0 ELSE p0 - p0 * n // h0 END AS HUGEINT) AS p1
   FROM (SELECT x.*, total, balance, own, hs, ps, coalesce(map_extract(hs, holder)[1], 0) AS h0, coalesce(map_extract(ps, holder)[1], 0) AS p0, CASE WHEN total = 0 THEN n * 1000 ELSE n * balance // (total * 10) END AS amt
    FROM run JOIN x ON x.pool = run.pool AND x.i = run.i + 1))))
SELECT pool, seq, holder, kind, CAST(n AS BIGINT) AS shares, taken, CAST(amount AS BIGINT) AS amount, CAST(held AS BIGINT) AS held, CAST(principal AS BIGINT) AS principal, CAST(0 AS BIGINT) AS fee_shares, CAST(total AS BIGINT) AS total, CAST(balance AS VARCHAR) AS balance,
 CASE WHEN taken AND s = -1 THEN ts + CASE WHEN op THEN 0 ELSE pool % 3 * 86400000 END END AS pays_at FROM run JOIN x USING (pool, i)"""


#: The same for public pools: values that move by themselves (k 0), purchases (1 to 4), returns (5 to 8) and forced ones (9), fees, cooldowns and what is free.
POOLS = """, x AS (SELECT account % 17 AS pool, event_id AS seq, ts, account AS holder, event_id * 7 % 10 AS k, CAST(abs(value) AS HUGEINT) AS n, CAST(value AS HUGEINT) * 20000 AS gain, account < 17 AS op,
 CASE WHEN event_id % 13 = 0 THEN 100000000 END AS available, CASE WHEN event_id % 3 = 0 THEN CAST(abs(value) AS HUGEINT) * 40000 END AS free, account % 17 % 8 = 7 AS frozen, account % 17 % 2 * 40000000 AS cooldown,
 row_number() OVER (PARTITION BY account % 17 ORDER BY event_id) AS i FROM samples),
h AS (SELECT pool, map(list(holder), list(CAST(holder * 100 AS HUGEINT))) AS hs, map(list(holder), list(CAST(holder * 1000 AS HUGEINT))) AS ps FROM (SELECT DISTINCT pool, holder FROM x WHERE NOT op AND holder % 5 = 0) GROUP BY pool),
run AS (SELECT pool, CAST(0 AS BIGINT) AS i, false AS taken, CAST(0 AS HUGEINT) AS amount, CAST(NULL AS HUGEINT) AS held, CAST(NULL AS HUGEINT) AS principal, CAST(0 AS HUGEINT) AS fee, CAST(pool + 1000000 AS HUGEINT) AS total,
  CAST((pool + 1000000) * 30007 AS HUGEINT) AS balance, CAST(400000 AS HUGEINT) AS own, coalesce(hs, MAP {CAST(-1 AS BIGINT): CAST(0 AS HUGEINT)}) AS hs, coalesce(ps, MAP {CAST(-1 AS BIGINT): CAST(0 AS HUGEINT)}) AS ps, MAP {CAST(-1 AS BIGINT): CAST(0 AS BIGINT)} AS es
  FROM (SELECT DISTINCT pool FROM x) LEFT JOIN h USING (pool)
 UNION ALL
 SELECT pool, i, ok, CASE WHEN ok AND k > 0 THEN amt ELSE 0 END, CASE WHEN op OR k = 0 THEN NULL WHEN ok THEN h1 ELSE h0 END, CASE WHEN op OR k = 0 THEN NULL WHEN ok THEN p1 ELSE p0 END, CASE WHEN ok THEN fee ELSE 0 END,
  CASE WHEN ok THEN t ELSE total END, CASE WHEN ok THEN b ELSE balance END, CASE WHEN ok THEN o ELSE own END, CASE WHEN ok AND NOT op AND k > 0 THEN map_concat(hs, MAP {holder: h1}) ELSE hs END,
  CASE WHEN ok AND NOT op AND k > 0 THEN map_concat(ps, MAP {holder: p1}) ELSE ps END, CASE WHEN ok AND NOT op AND k BETWEEN 1 AND 4 THEN map_concat(es, MAP {holder: ts}) ELSE es END
 FROM (SELECT *, CASE WHEN k = 0 THEN true WHEN n <= 0 THEN false WHEN k < 5 THEN NOT frozen AND coalesce(amt * 10 <= available, true) AND (op OR t * 3000 <= own * 10000)
   WHEN n > total OR balance <= 0 OR coalesce(n > free * total // balance, false) THEN false WHEN op THEN k < 9 AND n <= own AND (frozen OR t * 3000 <= o * 10000) ELSE n <= h0 AND (k = 9 OR cooldown = 0 OR ts >= e0 + cooldown) END AS ok
  FROM (SELECT *, CAST(CASE WHEN k = 0 THEN total WHEN k < 5 THEN total + n ELSE total - n + fee END AS HUGEINT) AS t, CAST(CASE WHEN k = 0 THEN balance + gain WHEN k < 5 THEN balance + amt * 10 ELSE balance - amt * 10 END AS HUGEINT) AS b,
    CAST(own + CASE WHEN k = 0 THEN 0 WHEN op AND k < 5 THEN n WHEN op THEN -n ELSE fee END AS HUGEINT) AS o, CAST(CASE WHEN k < 5 THEN h0 + n ELSE h0 - n END AS HUGEINT) AS h1, CAST(CASE WHEN k < 5 THEN p0 + amt ELSE p0 - part END AS HUGEINT) AS p1
   FROM (SELECT *, CAST(CASE WHEN k >= 5 AND NOT op AND total > 0 THEN (n - fee) * abs(balance) // (total * 10) ELSE amt0 END AS HUGEINT) AS amt
    FROM (SELECT *, CAST(CASE WHEN k >= 5 AND NOT op AND balance > 0 THEN greatest(amt0 - part, 0) * 100000 * total * 10 // (1000000 * balance) ELSE 0 END AS HUGEINT) AS fee
     FROM (SELECT *, CASE WHEN k < 5 OR h0 = 0 THEN 0 ELSE p0 * n // h0 END AS part, CASE WHEN total = 0 THEN n * 1000 ELSE n * abs(balance) // (total * 10) END AS amt0
      FROM (SELECT x.*, total, balance, own, hs, ps, es, coalesce(map_extract(hs, holder)[1], 0) AS h0, coalesce(map_extract(ps, holder)[1], 0) AS p0, coalesce(map_extract(es, holder)[1], 0) AS e0
       FROM run JOIN x ON x.pool = run.pool AND x.i = run.i + 1)))))))
SELECT pool, seq, holder, CASE WHEN k = 0 THEN 'mark' WHEN k < 5 THEN 'mint' WHEN k < 9 THEN 'burn' ELSE 'force_burn' END AS kind, CAST(n AS BIGINT) AS shares, taken, CAST(amount AS BIGINT) AS amount, CAST(held AS BIGINT) AS held,
 CAST(principal AS BIGINT) AS principal, CAST(fee AS BIGINT) AS fee_shares, CAST(total AS BIGINT) AS total, CAST(balance AS VARCHAR) AS balance, CASE WHEN taken AND k >= 5 THEN ts END AS pays_at FROM run JOIN x USING (pool, i)"""


def _recursive(body: str) -> str:
    return sql("samples", "operations", body=RUN + body).replace("WITH ", "WITH RECURSIVE ", 1)


SQL = {
    "staking_ledger": sql("samples", body=STAKING).replace("WITH ", "WITH RECURSIVE ", 1),
    "pool_share_ledger": sql("samples", body=POOLS).replace("WITH ", "WITH RECURSIVE ", 1),
    "ordered_debits": _recursive("SELECT seq, kind, CASE WHEN ok THEN 'applied' WHEN kind = 'l1_withdraw' AND amount > 0 THEN 'noop' ELSE 'violation' END AS status FROM run JOIN k USING (i)"),
    "ordered_balances": _recursive(""", last AS (SELECT b FROM run ORDER BY i DESC LIMIT 1), u AS (SELECT unnest(b) AS balance, unnest(range(0, len(b))) AS j FROM last)
SELECT j // 2 AS account, j % 2 + 1 AS asset, CAST(balance AS VARCHAR) AS balance FROM u WHERE balance <> 0"""),
    "fill_funding": sql("fills", "marks", body=FUNDED + "SELECT account, market, ts, ok, ln, CAST(held AS BIGINT) AS position, CAST(funding AS VARCHAR) AS funding FROM paid"),
    "funding_balance": sql("fills", "marks", body=FUNDED + """, g AS (SELECT market, sum(greatest(funding, 0)) AS received, sum(least(funding, 0)) AS paid FROM paid GROUP BY market),
e AS (SELECT account, market, sum(d) AS position, arg_max(prefix, (ts, ok, ln)) AS last FROM q GROUP BY 1, 2), n AS (SELECT market, arg_max(prefix, ts) AS now FROM marks GROUP BY market),
o AS (SELECT market, sum(CAST(position AS HUGEINT) * (last - now)) AS outstanding FROM e JOIN n USING (market) GROUP BY market)
SELECT market, CAST(received AS VARCHAR) AS received, CAST(paid AS VARCHAR) AS paid, CAST(outstanding AS VARCHAR) AS outstanding, '0' AS total FROM g JOIN o USING (market)"""),
}
