"""Exact nanodollar arithmetic on ``decimal(38,0)``; unknown amounts stay null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NANO = "decimal(38,0)"
MONEY_PATTERN = "^(0|[1-9][0-9]*)$"


def nano(c: Column) -> Column:
    """Decimal from the stored string; anything but a nonnegative integer raises."""
    return F.when(c.isNull(), F.lit(None).cast(NANO)).when(c.rlike(MONEY_PATTERN), c.cast(NANO)).otherwise(
        F.raise_error(F.concat(F.lit("Not a nonnegative nanodollar amount: "), c)))


def money_text(c: Column) -> Column:
    return c.cast(NANO).cast("string")


def ceil_div(numerator: Column, denominator: Column) -> Column:
    """Exact upward division: the remainder is taken off first, so the quotient is integral."""
    up = (numerator + denominator - F.lit(1).cast(NANO)).cast(NANO)
    return ((up - F.pmod(up, denominator)).cast(NANO) / denominator).cast(NANO)


def int_div(numerator: Column, denominator: Column) -> Column:
    return ((numerator - F.pmod(numerator, denominator)).cast(NANO) / denominator).cast(NANO)


def usd_to_nano(c: Column) -> Column:
    """Decimal dollars to nanodollars: 1-30 digits, up to nine decimals, above zero; blank is null, the rest raises."""
    value = F.trim(c)
    parts = F.split(value, r"\.")
    digits = F.concat(parts[0], F.rpad(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), 9, "0"))
    amount = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return (F.when(F.length(F.coalesce(value, F.lit(""))) == 0, F.lit(None).cast("string"))
            .when(value.rlike(r"^[0-9]{1,30}(?:\.[0-9]{1,9})?$") & (amount != "0"), amount)
            .otherwise(F.raise_error(F.concat(F.lit("Invalid spending amount: "), value))))


def format_nano(c: Column) -> Column:
    """``$whole.fraction`` with at least two decimals. Works on the digits, so no width limit applies."""
    padded = F.lpad(c, F.greatest(F.length(c), F.lit(10)), F.lit("0"))
    whole = F.substring(padded, F.lit(1), F.length(padded) - 9)
    fraction = F.regexp_replace(F.substring(padded, F.length(padded) - 8, F.lit(9)), "0+$", "")
    fraction = F.when(F.length(fraction) < 2, F.rpad(fraction, 2, "0")).otherwise(fraction)
    return F.concat(F.lit("$"), whole, F.lit("."), fraction)


def call_cost(input_tokens: Column, output_tokens: Column, rates: Column) -> Column:
    """Input and output are rounded up separately; a long-context rate applies strictly above its bound.

    ``rates``: struct of ``input_rate, output_rate, long_above, long_in_num, long_in_den, long_out_num,
    long_out_den`` (decimals; ``long_above`` null when there is no long-context rate).
    """
    long = F.coalesce(input_tokens > rates["long_above"], F.lit(False))
    one = F.lit(1).cast("decimal(12,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")

    def side(tokens: Column, rate: Column, num: Column, den: Column) -> Column:
        top = F.when(long, num.cast("decimal(12,0)")).otherwise(one)
        bottom = F.when(long, den.cast("decimal(12,0)")).otherwise(one)
        numerator = (tokens.cast("decimal(16,0)") * rate.cast("decimal(19,0)")).cast(NANO)
        return ceil_div((numerator * top).cast(NANO), (million * bottom).cast(NANO))

    return (side(input_tokens, rates["input_rate"], rates["long_in_num"], rates["long_in_den"])
            + side(output_tokens, rates["output_rate"], rates["long_out_num"], rates["long_out_den"])).cast(NANO)
