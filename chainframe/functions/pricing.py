"""Fees and quotes of bonding-curve and constant-product markets, in exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import I128, ceildiv, floordiv

BPS = 10_000
PROTOCOL_BPS, CREATOR_BPS = 95, 30
#: A new curve's reserves, and what separates virtual from real ones.
VIRTUAL_TOKEN, VIRTUAL_QUOTE = 1_073_000_000_000_000, 30_000_000_000
REAL_TOKEN, SUPPLY = 793_100_000_000_000, 1_000_000_000_000_000
TOKEN_OFFSET, QUOTE_OFFSET = 279_900_000_000_000, 30_000_000_000


def wide(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(I128)


def times(a: Column, b: Column) -> Column:
    """A product that stays exact: factors of 19 digits give 38."""
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(I128)


def fee(amount: Column, bps: int) -> Column:
    """Rounded up, so that a non-zero rate never charges nothing."""
    return F.lit(0).cast(I128) if bps == 0 else ceildiv(wide(amount) * bps, wide(BPS))


def fee_breakdown(amount: Column) -> Column:
    """Protocol and creator fee, each rounded on its own."""
    return F.struct(fee(amount, PROTOCOL_BPS).alias("protocol"), fee(amount, CREATOR_BPS).alias("creator"))


def buy_quote(gross: Column, vt: Column, vq: Column, real_token: Column) -> Column:
    """struct(net, fees, out, ok): spend ``gross`` including fees.

    The net amount is what the fees leave; where rounding makes net plus fees
    exceed the budget, the excess comes off the net amount.
    """
    first = floordiv(wide(gross) * BPS, wide(BPS + PROTOCOL_BPS + CREATOR_BPS))
    fees = lambda n: fee(n, PROTOCOL_BPS) + fee(n, CREATOR_BPS)
    net = first - F.greatest(wide(0), first + fees(first) - wide(gross))
    used = F.greatest(wide(0), net - 1)
    out = floordiv(times(used, vt), wide(vq) + used)
    ok = (out > 0) & (out < wide(vt)) & (out <= wide(real_token))
    return F.struct(net.alias("net"), fees(net).alias("fees"), out.alias("out"), ok.alias("ok"))


def sell_quote(tokens: Column, vt: Column, vq: Column, real_quote: Column) -> Column:
    """struct(gross, shortfall, net, ok): what the curve owes, and what it really holds of it."""
    gross = floordiv(times(tokens, vq), wide(vt) + wide(tokens))
    net = gross - fee(gross, PROTOCOL_BPS) - fee(gross, CREATOR_BPS)
    return F.struct(gross.alias("gross"), F.greatest(wide(0), gross - wide(real_quote)).alias("shortfall"), net.alias("net"), ((gross <= wide(real_quote)) & (net > 0)).alias("ok"))


def minimum_output(reference: Column, slippage_bps: int) -> Column:
    return floordiv(wide(reference) * (BPS - slippage_bps), wide(BPS))


def slippage(reference: Column, landing: Column, slippage_bps: int) -> Column:
    return F.struct((wide(landing) - wide(reference)).alias("signed"), (wide(landing) >= minimum_output(reference, slippage_bps)).alias("limit_met"))


def constant_product(amount_in: Column, reserve_in: Column, reserve_out: Column, fee_bps: int) -> Column:
    """struct(fee, out, post_in, post_out); the fee is rounded down and stays in the pool."""
    charged = floordiv(wide(amount_in) * fee_bps, wide(BPS))
    effective = wide(amount_in) - charged
    out = floordiv(times(reserve_out, effective), wide(reserve_in) + effective)
    return F.struct(charged.alias("fee"), out.alias("out"), (wide(reserve_in) + wide(amount_in)).alias("post_in"), (wide(reserve_out) - out).alias("post_out"))


def curve_state(vt: Column, vq: Column) -> Column:
    real = wide(vt) - TOKEN_OFFSET
    return F.struct(real.alias("real_token"), (wide(vq) - QUOTE_OFFSET).alias("real_quote"), F.when(real == 0, "COMPLETED").otherwise("ACTIVE").alias("lifecycle"))


def market_cap(vt: Column, vq: Column, supply: Column) -> Column:
    return floordiv(times(vq, supply), wide(vt))


def price_reaches(num: Column, den: Column, ref_num: Column, ref_den: Column, bps: int, up: bool) -> Column:
    """Whether num/den is at least (or at most) (1 + bps/10000) times ref_num/ref_den, inclusive, without division."""
    side = BPS + bps if up else BPS - bps
    now, then = wide(num) * wide(ref_den) * BPS, wide(ref_num) * wide(den) * side
    return now >= then if up else now <= then


def network_fee(signatures: Column, per_signature: int, unit_limit: Column, micro_price: Column) -> Column:
    return wide(signatures) * per_signature + ceildiv(wide(unit_limit) * wide(micro_price), wide(1_000_000))


def ratio(num: Column, den: Column) -> Column:
    """A display ratio; null if an operand is or the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def pnl_sign(x: Column) -> Column:
    return F.when(x > 0, "PROFIT").when(x < 0, "LOSS").otherwise("FLAT")
