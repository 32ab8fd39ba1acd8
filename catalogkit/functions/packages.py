"""Dose, package size, unit and ingredient text rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalogkit.functions.text import Col, _c, let, normalize_text, slugify, trim, unique_in_order
from catalogkit.functions.values import optional_text

# Word borders look at ASCII letters only, as the patterns were written for.

# Fixed value: what a dose looks like, e.g. "500 mg/5 ml + 30 mg".
DOSE_PATTERN = (
    r"(?i)(?<!\w)\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|kg|ml|l|ui|mui|meq|%)(?:\s*/\s*\d+(?:[.,]\d+)?\s*(?:ml|g|l))?"
    r"(?:\s*\+\s*\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|kg|ml|l|ui|mui|meq|%)(?:\s*/\s*\d+(?:[.,]\d+)?\s*(?:ml|g|l))?)*"
)

# Fixed value: "<number> <unit>" of a package.
PACKAGE_PATTERN = (
    r"(?i)(?<!\w)(\d+)\s*(un|uni|unid|unidade|unidades|comp|comprimido|comprimidos"
    r"|caps|capsula|capsulas|cps|ml|l|g|kg)(?!\w)"
)

# Unit spellings and their canonical form.
UNIT_SYNONYMS = {
    "unidades": ["un", "uni", "unid", "unidade", "unidades"],
    "comprimidos": ["comp", "comprimido", "comprimidos"],
    "capsulas": ["caps", "capsula", "capsulas", "cps"],
}
PLAIN_UNITS = ["ml", "l", "g", "kg", "mg", "mcg"]

# Ingredients recognised in free text, in this order.
INGREDIENT_TERMS = {
    "Carbonato de Cálcio": r"(?i)carbonato de c[aáÁ]lcio",
    "Colecalciferol": r"(?i)colecalciferol",
    "Vitamina D3": r"(?i)vitamina\s*d3(?!\w)",
    "Vitamina D": r"(?i)vitamina\s*d(?!\w)",
    "Cálcio": r"(?i)(?<!\w)c[aáÁ]lcio(?!\w)",
    "Magnésio": r"(?i)magn[eéÉ]sio",
    "Zinco": r"(?i)(?<!\w)zinco(?!\w)",
    "Colágeno": r"(?i)col[aáÁ]geno",
    "Ferro": r"(?i)(?<!\w)ferro(?!\w)",
    "Ômega 3": r"(?i)(?:o|ô|Ô)mega\s*3",
    "Creatina": r"(?i)creatina",
    "Melatonina": r"(?i)melatonina",
    "Cafeína": r"(?i)cafe[iíÍ]na",
}


def extract_dose(value: Col, max_text: int | None = None) -> Column:
    """First dose in a text; null for texts of more than ``max_text`` characters, where given."""
    compact = trim(F.regexp_replace(_c(value), r"\s+", " "))
    dose = trim(F.regexp_extract(compact, DOSE_PATTERN, 0))
    found = F.nullif(dose, F.lit(""))
    return found if max_text is None else F.when(F.length(compact) <= max_text, found)


def normalize_unit(value: Col) -> Column:
    """Canonical unit name; unknown units are kept trimmed, blanks are null."""
    value = _c(value)

    def canonical(word: Column) -> Column:
        result = F.when(word == "", F.lit(None).cast("string"))
        for name, spellings in UNIT_SYNONYMS.items():
            result = result.when(word.isin(*spellings), name)
        return result.when(word.isin(*PLAIN_UNITS), word).otherwise(trim(value))

    return let(normalize_text(value), canonical)


def extract_package(*values: Col) -> Column:
    """Struct ``(quantity, unit)`` from the first text that holds ``<number> <unit>``."""
    found = F.filter(
        F.transform(F.array(*[_c(v) for v in values]), lambda v: F.regexp_extract(v, PACKAGE_PATTERN, 0)), lambda m: m != ""
    )
    part = lambda n: F.nullif(F.regexp_extract(F.get(found, F.lit(0)), PACKAGE_PATTERN, n), F.lit(""))
    unit = let(part(2), lambda u: F.when(u.isNotNull(), normalize_unit(u)))
    return F.struct(part(1).alias("quantity"), unit.alias("unit"))


def infer_terms(text: Col, terms: dict[str, str] | None = None) -> Column:
    """Labels whose pattern occurs in the text, in dictionary order, unique."""
    terms = INGREDIENT_TERMS if terms is None else terms
    text = F.coalesce(_c(text), F.lit(""))
    hits = F.array(*[F.when(text.rlike(pattern), F.lit(label)) for label, pattern in terms.items()])
    return unique_in_order(F.array_compact(hits), normalize_text)


def ingredient_records(names: Col, slugs: Col | None = None) -> Column:
    """``array<struct<name, normalized_name, slug>>`` of a name list, blanks dropped.

    ``slugs`` optionally gives ready-made slugs in parallel with ``names``.
    """
    names = _c(names)
    slugs = F.transform(names, lambda n: F.lit(None).cast("string")) if slugs is None else _c(slugs)
    paired = F.filter(F.arrays_zip(names.alias("n"), slugs.alias("s")), lambda p: optional_text(p["n"]).isNotNull())
    return F.transform(
        paired,
        lambda p: F.struct(
            trim(p["n"]).alias("name"),
            normalize_text(p["n"]).alias("normalized_name"),
            F.coalesce(optional_text(p["s"]), slugify(p["n"])).alias("slug"),
        ),
    )
