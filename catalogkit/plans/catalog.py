"""The product catalogue: preparing, upserting, looking up and reprocessing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from catalogkit.functions.ean import normalize_ean
from catalogkit.functions.text import normalize_search_text, searchable_text, tokenize, trim
from catalogkit.functions.values import computed_once, field_type, json_path, optional_text
from catalogkit.functions.vectors import DEFAULT_DIMENSIONS, hash_vector
from catalogkit.operators.aggregates import distinct_values
from catalogkit.operators.dedupe import first_per_key
from catalogkit.operators.taxonomy import LEVELS

# Product fields and the input names they are read from, in order.
PRODUCT_FIELDS = {
    "description": ["descricaoProduto", "description"],
    "active_ingredient": ["principioAtivo", "ingredienteAtivo", "ingrediente_ativo", "activeIngredient"],
    "classification": ["classificacao", "classification"],
    "social_name": ["nomeSocial", "socialName"],
    "manufacturer": ["fabricante", "manufacturer"],
    "details": ["detalhes", "details"],
    "department": ["departamento", "department"],
    "category": ["categoria", "category"],
    "subcategory": ["subcategoria", "subcategory"],
    "segment": ["segmento", "segment"],
    "subsegment": ["subsegmento", "subsegment"],
}
TEXT_FIELDS = ["social_name", "classification", "manufacturer", *LEVELS]
DIMENSIONS = ["active_ingredient", *LEVELS]

# Rejection texts and the class that is never published.
NO_DESCRIPTION = "Todo produto precisa ter o campo descricaoProduto."
NO_TOKENS = "Nao foi possivel gerar tokens a partir dos dados do produto."
UNDEFINED_CLASS = "NAO DEFINIDO"


def validate_products(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed product columns with ``error``: a description, a code of 8 to 14 digits and a token are needed."""
    def pick(names: Sequence[str]) -> Column:
        texts = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if field_type(df.schema, n) is not None]
        return optional_text(F.coalesce(*texts)) if texts else F.lit(None).cast("string")

    code = normalize_ean("ean")
    typed = df.select(
        *keep, code.alias("_code"), *[pick(names).alias(target) for target, names in PRODUCT_FIELDS.items()]
    )
    tokens = tokenize(product_text())
    error = (
        F.when(F.col("description").isNull(), NO_DESCRIPTION)
        .when(F.col("_code.error").isNotNull(), F.col("_code.error"))
        .when(F.size(tokens) == 0, NO_TOKENS)
    )
    return typed.withColumn("ean", F.col("_code.ean")).withColumn("error", error).drop("_code")


def product_text() -> Column:
    return searchable_text("description", "active_ingredient", *TEXT_FIELDS)


def with_search_columns(
    products: DataFrame, dims: int = DEFAULT_DIMENSIONS, vectors: bool = True, max_tokens: int | None = None
) -> DataFrame:
    """Add search text, its normal form, tokens, their count and the hashed vector. No shuffle."""
    texted = products.withColumn("searchable_text", product_text())
    texted = texted.withColumn("normalized_searchable_text", normalize_search_text("searchable_text"))
    texted = texted.withColumn("tokens", tokenize("searchable_text", max_tokens))
    texted = texted.withColumn("token_count", F.size("tokens"))
    return texted.withColumn("embedding", hash_vector("tokens", dims)) if vectors else texted


def upsert_catalog(
    old: DataFrame, new: DataFrame, now: Column, key: str = "ean", position: str | None = None
) -> DataFrame:
    """Catalogue after writing ``new`` over ``old`` by code.

    Payload columns are replaced as a whole, ``created_at`` stays, ``updated_at`` becomes ``now``.
    If ``new`` repeats a code its last row by ``position`` counts; without a ``position`` a repeated
    code is an error when the job runs. Codes are unique on both sides of the join, so it does not skew.
    """
    if position:
        fresh = first_per_key(new, [key], [F.desc(position)])
    else:
        own = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("_row"))
        once = own.groupBy(key).agg(F.count("*").alias("_n"), F.first("_row").alias("_row"))
        repeated = F.raise_error(F.concat(F.lit("a position is needed for the repeated code "), F.col(key)))
        fresh = once.select(F.when(F.col("_n") > 1, repeated).otherwise(F.col(key)).alias(key), "_row.*")
    payload = [c for c in old.columns if c not in (key, "created_at", "updated_at")]
    right = fresh.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in payload], F.lit(True).alias("_new"))
    both = old.join(right, F.col(key) == F.col("_key"), "full_outer")
    is_new = F.col("_new").isNotNull()
    return both.select(
        F.coalesce(key, "_key").alias(key),
        *[F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        F.coalesce(F.col("created_at"), now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def lookup_eans(requests: DataFrame, catalog: DataFrame, order: str, ean: str = "ean") -> DataFrame:
    """Distinct requested codes in request order with ``found``, ``error`` and the product's columns.

    Codes that are not 8 to 14 digits keep their own row and ``error``.
    """
    checked = computed_once(requests, _c=normalize_ean(ean)).select(
        order, F.coalesce("_c.ean", ean).alias("ean"), F.col("_c.error").alias("error")
    )
    distinct = checked.groupBy("ean").agg(F.min(order).alias("first_position"), F.max("error").alias("error"))
    product = catalog.withColumn("_found", F.lit(True))
    joined = distinct.join(product, "ean", "left")
    return joined.withColumn("found", F.col("_found").isNotNull()).drop("_found")


def lookup_summary(answers: DataFrame) -> DataFrame:
    return answers.agg(
        F.count("*").alias("requested"),
        F.count(F.when(F.col("found"), 1)).alias("returned"),
        F.count(F.when(~F.col("found"), 1)).alias("missing"),
    )


def dimension_id(name: Column | str) -> Column:
    """Deterministic id of a dimension value, in UUID layout."""
    digest = F.sha2(F.col(name) if isinstance(name, str) else name, 256)
    cut = lambda start, size: F.substring(digest, start, size)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def extend_dimension(existing: DataFrame | None, facts: DataFrame, column: str) -> DataFrame:
    """Dimension ``(id, name)`` with the facts' new non-blank values added; known names keep their id."""
    values = distinct_values(facts, column)
    if existing is None:
        return values.select(dimension_id("name").alias("id"), "name")
    added = values.join(existing.select("name"), "name", "left_anti")
    return existing.select("id", "name").unionByName(added.select(dimension_id("name").alias("id"), "name"))


def assign_dimension_keys(
    facts: DataFrame, existing: dict[str, DataFrame] | None = None, columns: Sequence[str] = DIMENSIONS
) -> DataFrame:
    """Add ``<column>_id`` for each dimension column.

    Ids follow from the name, so no join is needed; only a dimension that already has ids of its
    own is joined, by name. The facts are read once whatever the number of dimensions.
    """
    out = facts
    for column in columns:
        own = F.when(trim(F.col(column)) != "", dimension_id(column))
        given = (existing or {}).get(column)
        if given is None:
            out = out.withColumn(f"{column}_id", own)
            continue
        known = given.select(F.col("name").alias("_name"), F.col("id").alias("_id"))
        out = out.join(known, F.col(column) == F.col("_name"), "left")
        out = out.withColumn(f"{column}_id", F.coalesce("_id", own)).drop("_name", "_id")
    return out


def eligible_for_publish(df: DataFrame, include_incomplete: bool = False) -> DataFrame:
    """Rows complete enough to publish; the relaxed form needs only a code and a description."""
    needed = ["ean", "description"]
    if not include_incomplete:
        needed += ["active_ingredient", "classification", "social_name", "manufacturer", "details"]
    for column in needed:
        df = df.filter(trim(F.col(column)) != "")
    return df if include_incomplete else df.filter(F.col("classification") != UNDEFINED_CLASS)


def read_details(df: DataFrame, details: str = "details") -> DataFrame:
    """Add the taxonomy levels stored in the details JSON: the final structure's, else the top level's."""
    labels = ["departamento", "categoria", "subcategoria", "segmento", "subsegmento"]
    return df.withColumns(
        {level: json_path(details, f"$.estrutura_final.{label}", f"$.{label}") for level, label in zip(LEVELS, labels)}
    )


# Catalogue columns and their names in an answer.
ANSWER_COLUMNS = {
    "ean": "ean",
    "description": "descricaoProduto",
    "classification": "classificacao",
    "social_name": "nomeSocial",
    "manufacturer": "fabricante",
    "details": "detalhes",
    "department": "departamento",
    "category": "categoria",
    "subcategory": "subcategoria",
    "segment": "segmento",
    "subsegment": "subsegmento",
    "token_count": "tokenCount",
    "created_at": "createdAt",
    "updated_at": "updatedAt",
}


def catalog_columns(df: DataFrame) -> DataFrame:
    """Catalogue rows under their answer names; the ingredient text is always a list, split on commas."""
    parts = F.filter(F.transform(F.split("active_ingredient", ","), trim), lambda x: x != "")
    one = F.array(F.col("active_ingredient"))
    listed = F.when(F.size(parts) > 1, parts).when(F.col("active_ingredient").isNotNull(), one)
    names = [F.col(c).alias(n) for c, n in ANSWER_COLUMNS.items() if c in df.columns]
    return df.select(*names, listed.alias("principioAtivo"))


def reprocess(catalog: DataFrame, now: Column, dims: int = DEFAULT_DIMENSIONS) -> DataFrame:
    """Recompute every product's search columns and stamp it: one pass over the table, no shuffle."""
    kept = catalog.drop("searchable_text", "normalized_searchable_text", "tokens", "token_count", "embedding")
    return with_search_columns(kept, dims).withColumn("updated_at", now)


def legacy_reconstruct(
    presentations: DataFrame, products: DataFrame, links: DataFrame, ingredients: DataFrame, trusted: Sequence[str]
) -> DataFrame:
    """Product rows of the older three-table layout, complete rows of trusted name sources only.

    ``presentations(ean, display_name, product_id, …)``, ``products(id, name, category, laboratory,
    name_source)``, ``links(product_id, ingredient_id)``, ``ingredients(id, name)``.
    """
    from catalogkit.operators.aggregates import distinct_concat

    named = ingredients.filter(trim("name") != "").select(F.col("id").alias("ingredient_id"), F.col("name").alias("ingredient"))
    listed = distinct_concat(links.join(named, "ingredient_id"), ["product_id"], "ingredient", ", ", "active_ingredient")
    text = lambda c: trim(F.col(c)) != ""
    good = products.filter(text("name") & text("category") & text("laboratory") & (F.col("category") != UNDEFINED_CLASS))
    good = good.filter(F.col("name_source").isin(*trusted))
    renamed = good.select(
        F.col("id").alias("product_id"), F.col("name").alias("social_name"), F.col("category").alias("classification"),
        F.col("laboratory").alias("manufacturer"), "name_source",
    )
    shown = presentations.filter(text("ean") & text("display_name")).withColumnRenamed("display_name", "description")
    return shown.join(renamed.join(listed, "product_id"), "product_id")


# Buckets of a name comparison and their lowest score.
MATCH_BUCKETS = [("exact", 1.0), ("strong", 0.75), ("likely", 0.5), ("weak", 0.25), ("mismatch", 0.0)]


def compare_sources(left: DataFrame, right: DataFrame, key: str = "ean", name: str = "name") -> DataFrame:
    """Same code in two sources: word-set similarity of the names and its bucket.

    A code only one side has, or a missing name, is an ``error``.
    """
    from catalogkit.functions.text import tokenize_unique

    a = left.select(key, F.col(name).alias("left_name"))
    b = right.select(key, F.col(name).alias("right_name"))
    both = a.join(b, key, "full_outer")
    l, r = tokenize_unique("left_name"), tokenize_unique("right_name")
    missing = F.col("left_name").isNull() | F.col("right_name").isNull()
    score = F.try_divide(F.size(F.array_intersect(l, r)), F.size(F.array_union(l, r)))
    scored = both.withColumn("score", F.when(~missing, F.coalesce(score, F.lit(0.0))))
    bucket = F.when(missing, "error")
    for label, low in MATCH_BUCKETS:
        bucket = bucket.when(F.col("score") >= low, label)
    return scored.withColumn("bucket", bucket)


