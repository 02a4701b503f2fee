"""Exact decimals and their text form."""

from pyspark.sql import Column, functions as F

DIFFICULTY = "decimal(25,10)"
COST = "decimal(30,20)"


def parse_decimal(text: Column, decimal_type: str) -> Column:
    """Decimal for a number in text; NULL when it is not one or does not fit."""
    return text.try_cast(decimal_type)


def decimal_text(amount: Column, trim_zeros: bool = False) -> Column:
    """Plain text at full scale, or without the zeros at the end."""
    text = amount.cast("string")
    if trim_zeros:
        text = F.regexp_replace(text, r"\.?0+$", "")
        return F.when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(text)
    return text
