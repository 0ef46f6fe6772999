"""Queries over scalar expressions: rounding rules, times, bits and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ceil_div, clamp, euclid_div, floor_div, le_bytes, median3, next_hour, nil_to_null, path_bits, split_base, to_hour, to_minute, to_second, trunc_div
from ..sources.tables import accounts, resting_orders, samples, sql

QUERIES = {
    "rounding_rules": lambda s, d: samples(s, d).select("event_id", trunc_div(F.col("value") - 5_000, 37).alias("t"), floor_div(F.col("value") - 5_000, 37).alias("f"), euclid_div(F.col("value") - 5_000, 1_000).alias("e"), ceil_div(F.abs("value"), 37).alias("c")),
    "time_rounding": lambda s, d: samples(s, d).select("event_id", to_second(F.col("ts")).alias("second"), to_minute(F.col("ts")).alias("minute"), to_hour(F.col("ts")).alias("hour"), next_hour(F.col("ts")).alias("following")),
    "scalar_selection": lambda s, d: accounts(s, d).select("account", median3(F.col("account"), F.col("nation").cast("long") * 60, F.lit(700).cast("long")).alias("median"), clamp(F.col("collateral"), -50_000, 500_000).alias("clamped"), F.coalesce(nil_to_null(F.col("nation"), 3), F.lit(-1)).alias("nation")),
    "path_bits": lambda s, d: accounts(s, d).select("account", F.array_join(path_bits(F.col("account"), 16), "").alias("bits")),
    "number_digits": lambda s, d: resting_orders(s, d).select("nonce", F.array_join(split_base(F.col("nonce"), 60, 4), ":").alias("base60"), F.array_join(le_bytes(F.col("nonce"), 3), " ").alias("bytes"), F.lpad(F.lower(F.hex("nonce")), 12, "0").alias("hex")),
    "word_bits": lambda s, d: resting_orders(s, d).select("nonce", F.col("nonce").bitwiseAND(F.col("price")).alias("both"), F.col("nonce").bitwiseOR(F.col("price")).alias("either"), F.col("nonce").bitwiseXOR(F.col("price")).alias("one"), F.shiftleft("price", 5).alias("left"), F.shiftright("nonce", 3).alias("right")),
}

SQL = {
    "rounding_rules": sql("samples", body="SELECT event_id, CAST(sign(x) AS BIGINT) * (abs(x) // 37) AS t, (x - ((x % 37) + 37) % 37) // 37 AS f, (x - ((x % 1000) + 1000) % 1000) // 1000 AS e, (abs(value) + 36) // 37 AS c FROM (SELECT *, value - 5000 AS x FROM samples)"),
    "time_rounding": sql("samples", body="SELECT event_id, ts // 1000 * 1000 AS second, ts // 60000 * 60000 AS minute, ts // 3600000 * 3600000 AS hour, ts // 3600000 * 3600000 + 3600000 AS following FROM samples"),
    "scalar_selection": sql("accounts", body="SELECT account, list_sort([account, CAST(nation AS BIGINT) * 60, 700])[2] AS median, least(greatest(collateral, -50000), 500000) AS clamped, coalesce(nullif(nation, 3), -1) AS nation FROM accounts"),
    "path_bits": sql("accounts", body="SELECT account, reverse(right(lpad(bin(account), 16, '0'), 16)) AS bits FROM accounts"),
    "number_digits": sql("book", body="SELECT nonce, concat_ws(':', nonce % 60, nonce // 60 % 60, nonce // 3600 % 60, nonce // 216000 % 60) AS base60, concat_ws(' ', nonce % 256, nonce // 256 % 256, nonce // 65536 % 256) AS bytes, lpad(lower(to_hex(nonce)), 12, '0') AS hex FROM book"),
    "word_bits": sql("book", body="SELECT nonce, nonce & price AS both, nonce | price AS either, xor(nonce, price) AS one, price << 5 AS \"left\", nonce >> 3 AS \"right\" FROM book"),
}
