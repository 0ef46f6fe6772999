"""The transaction log against its rules: every row is ``applied``, a ``noop`` or a ``violation``.

Transactions that were accepted elsewhere first fail softly, as no-ops; the others' checks are hard. Rules are column
expressions over transactions ``(tx_type, kind, ...)`` of block documents; a rule set is one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import in_bits
from ..model import units

#: Kinds whose failed checks make them no-ops.
SOFT = ("l1_withdraw", "l1_burn_shares", "l1_create_order", "l2_cancel_order", "l2_modify_order")


def basic_rules() -> dict[str, Column]:
    """Rules that a transaction's own fields decide; each holds where it does not concern the kind."""
    kind = F.col("kind")

    def only(kinds: tuple[str, ...], rule: Column) -> Column:
        return ~F.coalesce(kind.isin(*kinds), F.lit(False)) | F.coalesce(rule, F.lit(False))

    o, t, d, w = (F.col(c) for c in ("create_order", "transfer", "deposit", "withdraw"))
    perps, spot = o["market_index"] <= units.LAST_PERPS_MARKET, o["market_index"].between(units.FIRST_SPOT_MARKET, units.LAST_SPOT_MARKET)
    return {
        "known_kind": kind.isNotNull(),
        "not_expired": F.col("expired_at").isNull() | (F.col("expired_at") >= F.col("created_at")),
        "order_market": only(("l1_create_order",), perps) & only(("l2_create_order",), perps | spot),
        "order_price": only(("l1_create_order", "l2_create_order"), in_bits(o["price"], 32) & (o["price"] > 0)),
        "order_size": only(("l1_create_order", "l2_create_order"), in_bits(o["base_amount"], 48)),
        "transfer_parties": only(("l2_transfer",), t["from_account_index"] != t["to_account_index"]),
        "transfer_amount": only(("l2_transfer",), t["amount"] > 0),
        "deposit_accepted": only(("l1_deposit",), (d["accepted_amount"] <= d["amount"]) & (d["accepted_amount"] >= 0)),
        "withdraw_amount": only(("l1_withdraw", "l2_withdraw"), w["amount"] > 0),
    }


def status(txs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Transactions with their status and the rules that they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    out = txs.withColumn("broken", broken)
    soft = F.coalesce(F.col("kind").isin(*SOFT), F.lit(False))
    return out.withColumn("status", F.when(F.size("broken") == 0, "applied").when(soft, "noop").otherwise("violation"))


def whitelist(txs: DataFrame, accounts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Transactions whose kind the account's kind may not send; ``allowed`` has ``(account_type, kind)``."""
    typed = txs.join(accounts.select("account_index", "account_type"), "account_index")
    return typed.join(allowed, ["account_type", "kind"], "left_anti")


def nonce_faults(txs: DataFrame) -> DataFrame:
    """Transactions whose number does not follow the one before of their account and key."""
    w = W.partitionBy("account_index", "api_key_index").orderBy("block_number", "position")
    rows = txs.where("nonce IS NOT NULL").withColumn("before", F.lag("nonce").over(w))
    return rows.where(F.col("nonce") != F.col("before") + 1).select("account_index", "api_key_index", "block_number", "position", "before", "nonce")


def balance_changes(txs: DataFrame) -> DataFrame:
    """Signed balance changes by account and asset of the deposits, withdrawals and transfers that were applied."""
    t, d, w = (F.col(c) for c in ("transfer", "deposit", "withdraw"))
    row = lambda account, asset, amount: F.struct(account.alias("account"), asset.alias("asset"), amount.cast("decimal(38,0)").alias("amount"))
    rows = F.array(
        row(d["account_index"], d["asset_index"], d["accepted_amount"]), row(w["account_index"], w["asset_index"], -w["amount"]),
        row(t["from_account_index"], t["asset_index"], -t["amount"]), row(t["to_account_index"], t["asset_index"], t["amount"]),
    )
    return txs.where("status = 'applied'").select(F.inline(rows)).where("account IS NOT NULL AND amount IS NOT NULL").groupBy("account", "asset").agg(F.sum("amount").cast("decimal(38,0)").alias("amount"))
