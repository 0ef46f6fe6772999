"""Transaction rules and pools on hand-made rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from tidebook.model import schemas, units
from tidebook.operators import pools, rules
from tidebook.sources import blocks


def test_rules(spark):
    tx = lambda kind, **f: {"tx_type": units.TX_TYPES.get(kind, 99), "account_index": 1, "api_key_index": 0} | f
    order = {"market_index": 3, "price": 5, "base_amount": 1}
    txs = [
        tx("l2_create_order", nonce=1, create_order=order), tx("l2_create_order", nonce=2, create_order=order | {"market_index": 300}), tx("l1_create_order", nonce=4, create_order=order | {"market_index": 2048}),
        tx("l2_transfer", transfer={"from_account_index": 1, "to_account_index": 2, "asset_index": 1, "amount": Decimal(10)}), tx("l2_transfer", transfer={"from_account_index": 1, "to_account_index": 1, "asset_index": 1, "amount": Decimal(0)}),
        tx("l1_deposit", deposit={"account_index": 1, "asset_index": 1, "amount": Decimal(9), "accepted_amount": Decimal(7)}), tx("l1_deposit", deposit={"account_index": 1, "asset_index": 1, "amount": Decimal(9), "accepted_amount": Decimal(10)}),
        tx("l1_withdraw", withdraw={"account_index": 1, "asset_index": 1, "amount": Decimal(0)}), tx("l2_withdraw", withdraw={"account_index": 1, "asset_index": 1, "amount": Decimal(2)}), tx("nonsense"), tx("l2_create_sub_account", expired_at=1),
    ]
    block = spark.createDataFrame([{"block_number": 1, "created_at": 100, "txs": txs}], schemas.BLOCK)
    rows = rules.status(blocks.transactions(block), rules.basic_rules())
    got = [(r["status"], r["broken"]) for r in rows.orderBy("position").collect()]
    assert got == [("applied", []), ("violation", ["order_market"]), ("noop", ["order_market"]), ("applied", []), ("violation", ["transfer_parties", "transfer_amount"]), ("applied", []), ("violation", ["deposit_accepted"]), ("noop", ["withdraw_amount"]), ("applied", []), ("violation", ["known_kind"]), ("violation", ["not_expired"])]
    assert {(r["account"], r["asset"]): int(r["amount"]) for r in rules.balance_changes(rows).collect()} == {(1, 1): -10 + 7 - 2, (2, 1): 10}
    assert [(r["before"], r["nonce"]) for r in rules.nonce_faults(rows).collect()] == [(2, 4)]
    accounts = spark.createDataFrame([(1, units.PUBLIC_POOL)], "account_index long, account_type long")
    allowed = spark.createDataFrame([(units.PUBLIC_POOL, "l2_create_order")], "account_type long, kind string")
    assert rules.whitelist(rows, accounts, allowed).where("kind = 'l2_create_order'").count() == 0 and rules.whitelist(rows, accounts, allowed).where("kind = 'l2_transfer'").count() == 2


def test_pools(spark):
    df = spark.createDataFrame([(10, 7, 3, 100)], "a long, b long, c long, d long")
    r = df.select(pools.staking_value(F.col("a"), F.col("b"), F.col("c")).alias("v"), pools.redeemable(F.col("a"), F.col("c"), -F.col("b")).alias("r"), pools.operator_fee(F.col("d"), F.col("a"), F.lit(500_000), F.lit(1000), F.lit(45)).alias("f"), pools.holds_least(F.col("c"), F.col("d"), F.lit(300)).alias("h"), pools.cooled_down(F.col("d"), F.col("a"), 90, F.lit(False)).alias("k"), pools.may_mint(F.col("d"), F.col("a"), F.lit(10)).alias("m")).first()
    assert (int(r["v"]), int(r["r"]), int(r["f"]), r["h"], r["k"], r["m"]) == (23, 4, 1000, True, True, False)
    assert spark.range(1).select(pools.operator_fee(F.lit(5), F.lit(9), F.lit(1), F.lit(1), F.lit(0))).first()[0] == 0
