"""Currencies and exact decimal totals with completeness flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The white space that may surround a currency.
CURRENCY_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
AMOUNT = "decimal(38,18)"


def normal_currency(currency: Column) -> Column:
    """Trimmed of the fixed white space; blank is unknown (null)."""
    return F.nullif(F.btrim(currency, F.lit(CURRENCY_SPACE)), F.lit(""))


def plain_amount(amount: Column) -> Column:
    """A decimal without trailing zeros or exponent; null stays null."""
    size = F.abs(amount.cast(AMOUNT))
    one, nine = F.lit(1).cast("decimal(1,0)"), F.lit(10**9).cast("decimal(10,0)")
    whole = F.floor(size).cast("decimal(38,0)")
    # Nine digits at a time: more would exceed a product's 38 digits.
    high = (size % one) * nine
    low = (high % one) * nine
    digits = F.concat(*(F.lpad(F.floor(x).cast("decimal(10,0)").cast("string"), 9, "0") for x in (high, low)))
    digits = F.rtrim(digits, F.lit("0"))
    text = F.concat(whole.cast("string"), F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits)))
    return F.when(amount < 0, F.concat(F.lit("-"), text)).otherwise(text)


def totals_by(rows: DataFrame, keys: list[str], labels: list[str] = ()) -> DataFrame:
    """GBP totals per ``keys`` of rows (declaration_id, entry_id, amount, currency), with the smallest of each label.

    A declaration without entries (entry_id null) counts as a declaration.  The
    total of no known amount is null, never 0, and other currencies are never
    converted.  ``incomplete`` says that a GBP amount or an entry's currency is
    unknown.  Two aggregations: by key and declaration, so that one popular key
    is spread, then by key; both combine map-side.
    """
    has, gbp = F.col("entry_id").isNotNull(), F.col("currency") == "GBP"
    one = rows.groupBy(*keys, "declaration_id").agg(
        F.sum(F.when(has & gbp, F.col("amount"))).alias("total"),
        F.sum((has & F.col("currency").isNull()).cast("long")).alias("unknown_currency"),
        F.sum((has & F.coalesce(gbp, F.lit(False)) & F.col("amount").isNull()).cast("long")).alias("unknown_amount"),
        F.count("entry_id").alias("entries"),
        *(F.min(c).alias(c) for c in labels),
    )
    return one.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        F.count("*").alias("declarations"),
        F.sum("entries").alias("entries"),
        ((F.sum("unknown_currency") > 0) | (F.sum("unknown_amount") > 0)).alias("incomplete"),
        *(F.min(c).alias(c) for c in labels),
    )


def breakdown_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and known currency: amount, entries and unknown amounts."""
    known = rows.filter(F.col("entry_id").isNotNull() & F.col("currency").isNotNull())
    return known.groupBy(*keys, "currency").agg(
        F.sum("amount").alias("amount"),
        F.count("*").alias("entries"),
        F.sum(F.col("amount").isNull().cast("long")).alias("unknown_amounts"),
    )
