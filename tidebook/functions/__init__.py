"""Column expressions: exact integer division, times, packed keys and wide integers."""

from .integers import ceil_div, clamp, euclid_div, floor_div, in_bits, median3, sgn, trunc_div
from .keys import join_bytes, le_bytes, nil_to_null, order_index, order_market, order_nonce, packed_fields, path_bits, rotl32, split_base
from .times import millis, next_hour, to_hour, to_minute, to_second

__all__ = ["ceil_div", "clamp", "euclid_div", "floor_div", "in_bits", "median3", "sgn", "trunc_div", "join_bytes", "packed_fields", "rotl32", "le_bytes", "nil_to_null", "order_index", "order_market", "order_nonce", "path_bits", "split_base", "millis", "next_hour", "to_hour", "to_minute", "to_second"]
