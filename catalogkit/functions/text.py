"""Text normalisation, tokens and list helpers, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

Col = Column | str


# Fixed value: characters outer trimming removes, besides the plain blank.
WHITESPACE = " \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# The blanks among them: line ends, tabs and marks are none.
SPACES = "".join(c for c in WHITESPACE if unicodedata.category(c) == "Zs")


def _c(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim(value: Col) -> Column:
    """Remove outer blanks of any kind."""
    return F.btrim(_c(value), F.lit(WHITESPACE))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once: inside a lambda a plain expression runs once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=2)
def _accent_table(ascii_only: bool) -> tuple[str, str]:
    """Characters whose canonical decomposition, less combining marks, is one other character.

    The marks themselves come last with no counterpart, so ``translate`` deletes them.
    ``ascii_only`` keeps the characters that become an ASCII one, for texts that lose the rest.
    """
    marks = [chr(c) for c in range(0x300, 0x370)]
    source, target = [], []
    for code in range(0xC0, 0xFFFF):
        if 0xD800 <= code < 0xE000 or 0x300 <= code < 0x370:
            continue
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", char) if x not in marks)
        if base != char and len(base) == 1 and (base.isascii() or not ascii_only):
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


def strip_accents(value: Col, ascii_only: bool = False) -> Column:
    """Drop diacritics: decompose, then remove U+0300 to U+036F."""
    source, target = _accent_table(ascii_only)
    return F.translate(_c(value), source, target)


def normalize_text(value: Col) -> Column:
    """Accent-free lower-case words separated by single spaces; null becomes an empty string."""
    words = F.regexp_replace(strip_accents(value, True), "[^a-zA-Z0-9]+", " ")
    return F.coalesce(F.lower(F.trim(words)), F.lit(""))


def normalize_search_text(value: Col) -> Column:
    """Like :func:`normalize_text`, and letter/digit borders are split (``250mg`` is ``250 mg``)."""
    lowered = F.lower(strip_accents(value, True))
    border = "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])"
    return F.coalesce(F.trim(F.regexp_replace(lowered, f"[^a-z0-9]+|{border}", " ")), F.lit(""))


def normalize_match_text(value: Col) -> Column:
    """Accent-free lower-case words; letter/digit borders are kept."""
    lowered = F.lower(strip_accents(value, True))
    return F.coalesce(F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " ")), F.lit(""))


def tokenize(value: Col, max_tokens: int | None = None) -> Column:
    """Search tokens of the whole text in order, repeats kept; ``max_tokens`` keeps the first so many.

    Because letter/digit borders split, a token is a maximal run of letters or of digits.
    """
    lowered = F.coalesce(F.lower(strip_accents(value, True)), F.lit(""))
    tokens = F.regexp_extract_all(lowered, F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.slice(tokens, 1, max_tokens) if max_tokens else tokens


def tokenize_unique(value: Col) -> Column:
    """Distinct words of :func:`normalize_text`, in first-seen order."""
    words = F.array_distinct(F.split(normalize_text(value), " "))
    return F.filter(words, lambda w: w != "")


def unique_in_order(values: Col, key=None) -> Column:
    """Keep the first spelling of each element; ``key`` maps an element to what makes it equal.

    The default key ignores case and outer blanks. Elements with a blank key are dropped.
    """
    key = key or (lambda x: F.lower(trim(x)))
    keyed = F.transform(
        _c(values), lambda x, i: F.struct(F.coalesce(key(x), F.lit("")).alias("key"), i.alias("at"), x.alias("value"))
    )
    # equal keys stand together in position order: the first of each run is kept, then order is restored
    ordered = F.array_sort(F.filter(keyed, lambda p: p["key"] != ""))
    firsts = let(ordered, lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["key"] != p["key"])))
    placed = F.array_sort(F.transform(firsts, lambda p: F.struct(p["at"].alias("at"), p["value"].alias("value"))))
    return F.transform(placed, lambda p: p["value"])


def split_ingredients(value: Col, blanks: str = WHITESPACE) -> Column:
    """Split on comma, semicolon, slash or the word ``e``; trimmed of ``blanks``, accent-insensitively unique."""
    parts = F.transform(F.split(F.coalesce(_c(value), F.lit("")), "[,;/]|(?i) e "), lambda p: F.btrim(p, F.lit(blanks)))
    return unique_in_order(parts, normalize_text)


def searchable_text(
    description: Col, ingredient: Col, *rest: Col
) -> Column:
    """Weighted search text: description and ingredient twice, then the other fields in order."""
    fields = [description, ingredient, description, ingredient, *rest]
    return F.concat_ws(" ", *[F.nullif(_c(f), F.lit("")) for f in fields])


def search_artifacts(parts: Col) -> Column:
    """Struct of the unique parts joined with `` | ``, its normal form, unique tokens and their count."""
    joined = F.array_join(F.transform(unique_in_order(parts), trim), " | ")
    tokens = tokenize_unique(joined)
    return F.struct(
        joined.alias("searchable_text"),
        normalize_text(joined).alias("normalized_text"),
        tokens.alias("tokens"),
        F.size(tokens).alias("token_count"),
    )


def slugify(value: Col) -> Column:
    return F.replace(normalize_text(value), F.lit(" "), F.lit("-"))


def summarize_text(value: Col, limit: int = 160) -> Column:
    """Collapse blanks; cut longer text to ``limit`` characters ending in three dots."""
    text = F.trim(F.regexp_replace(F.coalesce(_c(value), F.lit("")), r"\s+", " "))
    cut = F.concat(F.substring(text, 1, max(limit - 3, 0)), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def fuzzy_bound(token: Col) -> Column:
    """Edit distance allowed for a query token: 0 below 5 characters, 1 below 10, else 2."""
    length = F.length(_c(token))
    return F.when(length >= 10, 2).when(length >= 5, 1).otherwise(0)


def is_numeric_token(token: Col) -> Column:
    return _c(token).rlike("^[0-9]+$")


def bounded_levenshtein(left: Col, right: Col, bound: int) -> Column:
    """Edit distance, or null when it is above ``bound``."""
    distance = F.levenshtein(_c(left), _c(right), bound)
    return F.when(distance >= 0, distance)


def fuzzy_equal(query_token: Col, token: Col) -> Column:
    """True when ``token`` is within the distance the query token allows; numbers never match."""
    q, t = _c(query_token), _c(token)
    gap = F.abs(F.length(q) - F.length(t))
    near = F.when(F.length(q) >= 10, (gap <= 2) & bounded_levenshtein(q, t, 2).isNotNull()).when(
        F.length(q) >= 5, (gap <= 1) & bounded_levenshtein(q, t, 1).isNotNull()
    )
    return F.coalesce(near & ~is_numeric_token(q) & ~is_numeric_token(t), F.lit(False))


def contains_any(text: Col, keywords: list[str]) -> Column:
    """True when any keyword is a substring of ``text``."""
    pattern = "|".join(f"\\Q{k}\\E" for k in keywords)
    return F.coalesce(_c(text).rlike(pattern), F.lit(False))
