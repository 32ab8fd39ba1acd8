"""Fallback chains, numbers, prices and JSON-in-text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalogkit.functions.text import Col, _c, trim


def first_non_blank(*values: Col, null_token: str | None = None, trimmed: bool = True) -> Column:
    """First value that is neither null nor blank (nor ``null_token``, any case)."""
    picks = []
    for value in values:
        text = F.nullif(trim(value), F.lit(""))
        if null_token is not None:
            text = F.when(F.upper(text) != null_token.upper(), text)
        picks.append(text if trimmed else F.when(text.isNotNull(), _c(value).cast("string")))
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def first_text(*values: Col) -> Column:
    """:func:`first_non_blank` for costly values: each is computed once, at the price of no short cut."""
    texts = F.filter(F.transform(F.array(*[_c(v) for v in values]), trim), lambda x: x != "")
    return F.get(texts, F.lit(0))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns that many later expressions refer to.

    Catalyst merges neighbouring projections and would copy a long expression into each use of
    it; a one-element ``inline`` keeps it a column of its own, inside the same stage.
    """
    others = [c for c in df.columns if c not in columns]
    cells = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*others, F.inline_outer(cells).alias(*columns))


def optional_text(value: Col) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(trim(value), F.lit(""))


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    current: T.DataType = schema
    for name in path.split("."):
        if not isinstance(current, T.StructType) or name not in current.names:
            return None
        current = current[name].dataType
    return current


def field(df: DataFrame, path: str, dtype: str = "string") -> Column:
    """Column ``path`` if the schema has it, else a typed null: payload fields are all optional."""
    found = field_type(df.schema, path)
    return F.lit(None).cast(dtype) if found is None else F.col(path)


def fallback(df: DataFrame, names: Sequence[str], **options) -> Column:
    """:func:`first_non_blank` over the named fields that exist."""
    present = [n for n in names if field_type(df.schema, n) is not None]
    return first_non_blank(*present, **options)


def to_number(value: Col) -> Column:
    """Finite double, else null."""
    number = F.expr("double(null)") if value is None else _c(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def first_finite(*values: Col) -> Column:
    """First value that parses as a finite number; blanks are skipped."""
    return F.coalesce(*[to_number(F.nullif(trim(_c(v).cast("string")), F.lit(""))) for v in values])


def round_dp(value: Col, digits: int) -> Column:
    return F.round(_c(value), digits)


def effective_promo(price: Col, promo: Col) -> Column:
    """The promotional price, only where it is above zero and below the list price."""
    price, promo = _c(price), _c(promo)
    return F.when((promo > 0) & (promo < price), promo)


def discount_pct(price: Col, promo: Col) -> Column:
    """Discount in percent, two decimals, of an effective promotional price."""
    price, promo = _c(price), effective_promo(price, promo)
    return F.when(price > 0, F.round((price - promo) / price * 100, 2))


def price_block(price: Col, promo: Col, discount: Col) -> Column:
    """Struct of sale price, offer flag, list price, promo price and discount; null without any price."""
    price, promo, discount = _c(price), _c(promo), _c(discount)
    sale = F.coalesce(promo, price)
    block = F.struct(
        sale.alias("sale_price"),
        promo.isNotNull().alias("has_offer"),
        price.alias("list_price"),
        promo.alias("promo_price"),
        discount.alias("discount_pct"),
    )
    return F.when(sale.isNotNull(), block)


def format_stock(value: Col) -> Column:
    """Four-decimal text; anything not a finite number is ``0.0000``."""
    return F.format_string("%.4f", F.coalesce(to_number(value), F.lit(0.0)))


def parse_list_input(value: Col) -> Column:
    """Entries of a newline, comma or semicolon separated text, trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(_c(value), F.lit("")), "[\\n,;]+"), trim)
    return F.filter(parts, lambda x: x != "")


def array_pick(values: Col, position: int) -> Column:
    """First (1), last (-1) or n-th non-blank element, trimmed; null when there is none."""
    kept = F.filter(_c(values), lambda x: trim(x.cast("string")) != "")
    return trim(F.try_element_at(kept, F.lit(position)).cast("string"))


def json_text(value: Col) -> Column:
    """JSON text of a struct, map or array; null stays null and null fields are left out."""
    return F.to_json(_c(value))


def json_parse_or_keep(value: Col) -> Column:
    """Parsed variant; text that is not JSON is kept as a string value."""
    value = _c(value)
    wrapped = F.parse_json(F.to_json(F.struct(value.alias("v"))))
    kept = F.variant_get(wrapped, "$.v", "variant")
    return F.when(value.isNotNull(), F.coalesce(F.try_parse_json(value), kept))


def json_path(value: Col, *paths: str) -> Column:
    """First non-blank text among several JSON paths."""
    return first_text(*[F.get_json_object(_c(value), p) for p in paths])
