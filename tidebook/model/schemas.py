"""Schemas of block documents. Wide integers are decimals, addresses and hashes stay hexadecimal text."""

from pyspark.sql import types as T

_L, _S, _D, _B = T.LongType(), T.StringType(), T.DecimalType(38, 0), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ORDER = _struct(market_index=_L, client_order_index=_L, base_amount=_L, price=_L, is_ask=_B, type=_L, time_in_force=_L, reduce_only=_B, trigger_price=_L, order_expiry=_L)
TRANSFER = _struct(from_account_index=_L, to_account_index=_L, asset_index=_L, amount=_D, usdc_fee=_D)
DEPOSIT = _struct(account_index=_L, asset_index=_L, amount=_D, accepted_amount=_D)
WITHDRAW = _struct(account_index=_L, asset_index=_L, amount=_D)
SHARES = _struct(account_index=_L, public_pool_index=_L, share_amount=_L)
CANCEL = _struct(account_index=_L, market_index=_L, order_index=_L)

#: One transaction: its type and one payload; payloads that a transaction lacks are null.
TX = _struct(tx_type=_L, account_index=_L, api_key_index=_L, nonce=_L, expired_at=_L, create_order=ORDER, cancel_order=CANCEL, transfer=TRANSFER, deposit=DEPOSIT, withdraw=WITHDRAW, mint_shares=SHARES, burn_shares=SHARES)

POSITION = _struct(position=_L, entry_quote=_L, last_funding_rate_prefix_sum=_L, initial_margin_fraction=_L, margin_mode=_L, allocated_margin=_D)
ACCOUNT = _struct(account_index=_L, l1_address=_S, account_type=_L, collateral=_D, positions=T.MapType(_S, POSITION))
BLOCK = _struct(block_number=_L, created_at=_L, old_state_root=_S, new_state_root=_S, accounts=T.ArrayType(ACCOUNT), txs=T.ArrayType(TX))

SUMMARY = _struct(block_number=_L, total_txs=_L, chunk_size=_L, wall_seconds=T.DoubleType(), pipelined_seconds=T.DoubleType(), tx_seconds=T.DoubleType(), tps=T.DoubleType())
