"""Source trust policy and product-type rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from catalogkit.functions.text import WHITESPACE, Col, _c, contains_any, normalize_text, trim

# Words that mark a product as personal care.
COMMERCIAL_KEYWORDS = [
    "polvilho",
    "talco",
    "shampoo",
    "condicionador",
    "sabonete",
    "sabonete liquido",
    "creme dental",
    "escova dental",
    "fio dental",
    "desodorante",
    "antitranspirante",
    "protetor solar",
    "hidratante",
    "oleo corporal",
    "lenco umedecido",
    "lencos umedecidos",
    "fralda",
    "absorvente",
    "cotonete",
    "cosmetico",
    "perfume",
    "camisinha",
    "preservativo",
    "preservativos",
    "lubrificante",
]
CONTEXT_KEYWORDS = ["perfum", "higiene", "cosmet", "dermocosmet", "cuidados pessoais"]
TYPE_CARE, TYPE_DRUG, TYPE_OTHER = "perfumaria", "medicamento", "outro"

# Wording of source names.
UNKNOWN_SOURCE = "fonte desconhecida"
NO_SOURCES = "fontes externas"


def source_key(value: Col) -> Column:
    """Trimmed lower-case source key; null becomes an empty string."""
    return F.lower(trim(F.coalesce(_c(value).cast("string"), F.lit(""))))


def source_list(values: Col) -> Column:
    """Distinct non-blank source keys in first-seen order."""
    return F.array_distinct(F.filter(F.transform(_c(values), source_key), lambda k: k != ""))


def source_keys(values: Sequence[str]) -> list[str]:
    """The same rule for a configured list."""
    return list(dict.fromkeys(k for k in (str(v or "").strip().lower() for v in values) if k))


@dataclass(frozen=True)
class SourcePolicy:
    """Which sources may name a product, which pass unmatched, and the order they are asked in."""

    trusted: Sequence[str] = ()
    pass_through: Sequence[str] = ()
    preferred_names: Sequence[str] = ()
    preferred_data: Sequence[str] = ()
    labels: dict[str, str] = field(default_factory=dict)

    def is_trusted(self, source: Col) -> Column:
        return self._among(source, self.trusted)

    def is_pass_through(self, source: Col) -> Column:
        return self._among(source, self.pass_through)

    def is_publishable(self, source: Col) -> Column:
        return self.is_trusted(source) | self.is_pass_through(source)

    @staticmethod
    def _among(source: Col, allowed: Sequence[str]) -> Column:
        keys = source_keys(allowed)
        return source_key(source).isin(*keys) if keys else F.lit(False)

    def name_order(self) -> list[str]:
        return source_keys([*self.preferred_names, *self.trusted])

    def data_order(self) -> list[str]:
        return source_keys([*self.preferred_data, *self.trusted])

    def ordered(self, active: Sequence[str]) -> list[str]:
        """Active sources, preferred ones first."""
        active = source_keys(active)
        return [k for k in source_keys([*self.name_order(), *self.data_order(), *active]) if k in active]

    def label(self, source: Col) -> Column:
        """Known label, else the key's words with a capital first letter."""
        key = source_key(source)
        words = F.filter(F.split(key, "[^a-z0-9]+"), lambda w: w != "")
        titled = F.array_join(
            F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))),
            " ",
        )
        result = F.when(key == "", UNKNOWN_SOURCE)
        for name, text in self.labels.items():
            result = result.when(key == name.lower(), text)
        return result.otherwise(titled)

    def list_text(self, sources: Col) -> Column:
        """Labels of distinct sources joined as ``A, B ou C``."""
        labels = F.transform(source_list(sources), self.label)
        size = F.size(labels)
        head = F.array_join(F.slice(labels, F.lit(1), F.greatest(size - 1, F.lit(0))), ", ")
        return (
            F.when(size == 0, NO_SOURCES)
            .when(size == 1, F.get(labels, F.lit(0)))
            .otherwise(F.concat(head, F.lit(" ou "), F.get(labels, size - 1)))
        )

    def fixed_label(self, source: str) -> str:
        """:meth:`label` of a configured source."""
        key = source.strip(WHITESPACE).lower()
        known = [text for name, text in self.labels.items() if name.lower() == key]
        words = [w for w in re.split("[^a-z0-9]+", key) if w]
        return UNKNOWN_SOURCE if key == "" else known[0] if known else " ".join(w[0].upper() + w[1:] for w in words)

    def fixed_list_text(self, sources: Sequence[str]) -> Column:
        """:meth:`list_text` of a configured list, as a constant: Spark would compute the lambdas anew for each row."""
        labels = [self.fixed_label(k) for k in dict.fromkeys(s.strip(WHITESPACE).lower() for s in sources) if k]
        return F.lit(" ou ".join([", ".join(labels[:-1]), labels[-1]] if labels[1:] else labels or [NO_SOURCES]))


def normalize_type(value: Col) -> Column:
    """Product type of a type or category text."""
    text = normalize_text(value)
    care = text.contains("perfum") | text.contains("higiene") | text.contains("cosmet")
    return F.when(text.contains("medic"), TYPE_DRUG).when(care, TYPE_CARE).otherwise(TYPE_OTHER)


def classify_type(
    texts: Sequence[Col],
    incoming_type: Col,
    fallback_type: Col,
    has_drug_id: Col | None = None,
    commercial: Sequence[str] = tuple(COMMERCIAL_KEYWORDS),
    context: Sequence[str] = tuple(CONTEXT_KEYWORDS),
) -> Column:
    """Product type from free text.

    Personal care if any keyword occurs in the joined ``texts``; else a drug if the incoming
    type says so or the detail carries a drug id; else :func:`normalize_type` of the fallback.
    """
    joined = normalize_text(F.concat_ws(" ", *[F.nullif(_c(t), F.lit("")) for t in texts]))
    drug = normalize_text(incoming_type).contains("medic")
    if has_drug_id is not None:
        drug = drug | F.coalesce(_c(has_drug_id), F.lit(False))
    return (
        F.when(contains_any(joined, [*commercial, *context]), TYPE_CARE)
        .when(drug, TYPE_DRUG)
        .otherwise(normalize_type(fallback_type))
    )
