"""Fixed values of the data model: units, sentinels, codes."""

# Units.
USDC_TICK = 1_000_000  # quote amounts are in 1e-6 USDC
COLLATERAL_SCALE = 1_000_000  # collateral is in 1e-6 of a quote unit
FEE_TICK = 1_000_000  # fee rates are in 1e-6
MARGIN_TICK = 10_000  # margin fractions are in 1e-4
MARGIN_SCALE = COLLATERAL_SCALE // MARGIN_TICK  # a requirement is notional x fraction x this
FUNDING_TICK = 1_000_000  # funding rates are in 1e-6
SHARE_TICK = 10_000  # pool share rates are in 1e-4
SECOND_MS, MINUTE_MS, HOUR_MS = 1_000, 60_000, 3_600_000
PREMIUM_SAMPLES = 60  # premium sums are divided by this, however many samples were taken
FUNDING_PERIODS = 8  # a funding rate is paid in this many hourly parts
EMPTY_VALUE = 1_000  # value of a share in an empty pool
IMPACT_NOTIONAL = 500_000_000  # quote units

# Sentinels, read as null.
NIL_ACCOUNT = 2**48 - 1
NIL_MARKET = 255
NIL_API_KEY = 255
NIL_STRATEGY = 8
NIL_ORDER = NIL_EXPIRY = NIL_TRIGGER_PRICE = NIL_ASSET = 0

# Ranges.
NONCE_BITS = 48
FIRST_ASK_NONCE, FIRST_BID_NONCE = 1, 2**48 - 1
MAX_BASE, MAX_PRICE, MAX_POSITION, MAX_TRANSFER = 2**48 - 1, 2**32 - 1, 2**56 - 1, 2**60 - 1
LAST_PERPS_MARKET, FIRST_SPOT_MARKET, LAST_SPOT_MARKET = 254, 2048, 4094
TREASURY_ACCOUNT, FIRST_SUB_ACCOUNT = 0, 2**47

# Account kinds, margin modes and health classes.
MASTER, SUB, PUBLIC_POOL, INSURANCE_FUND, STAKING_POOL = range(5)
CROSS, ISOLATED = 0, 1
SIMPLE, UNIFIED = 0, 1
HEALTHY, PRE_LIQUIDATION, PARTIAL_LIQUIDATION, FULL_LIQUIDATION, BANKRUPT = range(5)

# Transaction types.
TX_TYPES = {
    "l1_deposit": 1, "l1_change_pubkey": 2, "l1_create_market": 3, "l1_update_market": 4, "l1_cancel_all_orders": 5, "l1_withdraw": 6, "l1_create_order": 7,
    "l2_change_pubkey": 8, "l2_create_sub_account": 9, "l2_create_public_pool": 10, "l2_update_public_pool": 11, "l2_transfer": 12, "l2_withdraw": 13,
    "l2_create_order": 14, "l2_cancel_order": 15, "l2_cancel_all_orders": 16, "l2_modify_order": 17, "l2_mint_shares": 18, "l2_burn_shares": 19, "l2_update_leverage": 20,
    "internal_claim_order": 21, "internal_cancel_order": 22, "internal_deleverage": 23, "internal_exit_position": 24, "internal_cancel_all_orders": 25,
    "internal_liquidate_position": 26, "internal_create_order": 27, "l2_create_grouped_orders": 28, "l2_update_margin": 29, "l1_burn_shares": 30,
    "l1_register_asset": 31, "l1_update_asset": 32, "l2_create_staking_pool": 33, "l2_stake_assets": 35, "l2_unstake_assets": 36, "l1_set_system_config": 38,
    "internal_pending_unlock": 39, "l2_force_burn_shares": 40, "l2_update_account_config": 41, "l2_strategy_transfer": 43, "l2_update_market_config": 44,
}
