"""Barcode (EAN) rules. Codes stay text: leading zeros matter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalogkit.functions.text import Col, _c, let

# Accepted lengths and the two rejection reasons.
VALID_LENGTHS = (8, 12, 13, 14)
REASON_LENGTH = "EAN deve ter 8, 12, 13 ou 14 digitos."
REASON_CHECK_DIGIT = "Digito verificador invalido."

# Lengths a catalogue code may have, and its two rejection reasons.
CATALOG_MIN, CATALOG_MAX = 8, 14
REASON_MISSING = "Todo produto precisa ter o campo ean."
REASON_RANGE = "O campo ean precisa ter entre 8 e 14 digitos."


def only_digits(value: Col, null_when_empty: bool = False) -> Column:
    digits = F.regexp_replace(F.coalesce(_c(value).cast("string"), F.lit("")), "[^0-9]+", "")
    return F.nullif(digits, F.lit("")) if null_when_empty else digits


def check_digit(body: Col, mode: str = "left") -> Column:
    """Check digit of a code body of up to 13 digits.

    ``left`` weighs 1,3,1,3… from the left, which is what the catalogue's data was checked
    with; it agrees with the GS1 rule (``gs1``: weight 3 on the last digit) for 13-digit
    codes only. The body is read as one number and its digits are summed in long arithmetic;
    the one-element array binds that number once, which keeps the expression small.
    """
    def weighted(code: Column) -> Column:
        def total(number: Column) -> Column:
            digit = [F.call_function("div", number, F.lit(10**j)) % 10 for j in range(13)]
            last, other = sum(digit[2::2], digit[0]), sum(digit[3::2], digit[1])
            if mode == "gs1":
                return 3 * last + other
            return F.when(F.length(code) % 2 == 1, last + 3 * other).otherwise(3 * last + other)

        return let(code.try_cast("bigint"), total)

    return let(let(_c(body), weighted), lambda total: ((10 - total % 10) % 10).cast("int"))


def validate_ean(value: Col, mode: str = "left") -> Column:
    """Struct ``(ean, is_valid, reason)`` with the code reduced to digits."""

    def judge(ean: Column) -> Column:
        good_length = F.length(ean).isin(*VALID_LENGTHS)
        body = F.substring(ean, F.lit(1), F.length(ean) - 1)
        matches = good_length & (F.right(ean, F.lit(1)) == check_digit(body, mode).cast("string"))
        return F.struct(ean.alias("ean"), good_length.alias("good"), F.coalesce(matches, F.lit(False)).alias("is_valid"))

    def explain(v: Column) -> Column:
        reason = F.when(~v["good"], REASON_LENGTH).when(~v["is_valid"], REASON_CHECK_DIGIT)
        return F.struct(v["ean"].alias("ean"), v["is_valid"].alias("is_valid"), reason.alias("reason"))

    return let(let(only_digits(value), judge), explain)


def normalize_ean(value: Col) -> Column:
    """Struct ``(ean, error)``: the catalogue rule, 8 to 14 digits and no check digit."""
    digits = only_digits(value)
    error = F.when(digits == "", REASON_MISSING).when(
        ~F.length(digits).between(CATALOG_MIN, CATALOG_MAX), REASON_RANGE
    )
    return F.struct(F.when(error.isNull(), digits).alias("ean"), error.alias("error"))


def exact_ean_from_query(query: Col, explicit: Col | None = None) -> Column:
    """The explicit code if given, else all digits of the query when there are 8 to 14 of them."""
    digits = only_digits(query)
    found = F.when(F.length(digits).between(CATALOG_MIN, CATALOG_MAX), digits)
    return found if explicit is None else F.coalesce(only_digits(explicit, null_when_empty=True), found)
