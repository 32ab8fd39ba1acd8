"""Enriching items from lookups, and building the final product record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalogkit.functions.ean import validate_ean
from catalogkit.functions.packages import extract_dose, ingredient_records
from catalogkit.functions.text import normalize_text, search_artifacts, split_ingredients, trim, unique_in_order
from catalogkit.functions.values import computed_once, field, field_type, first_non_blank
from catalogkit.operators.policy import SourcePolicy, classify_type, source_key
from catalogkit.operators.taxonomy import LEVELS, classify_taxonomy
from catalogkit.operators.waterfall import (
    approval_reason,
    display_name,
    lookup_struct_type,
    lookup_waterfall,
    primary_name,
    resolve_sources,
)

# Fallback source tag and the sentences around untrusted names.
IMPORT_SOURCE = "importacao"
UNTRUSTED_NAME = "Nome nao resolvido por "
NAME_REJECTED = "Nome do produto nao foi validado por "

RAW_TEXT_FIELDS = [
    "name", "product_name", "display_name", "description", "original_description", "normalized_description",
    "dose", "unit", "form", "route", "quantity", "volume", "registration", "control_label", "laboratory",
    "manufacturer", "brand", *LEVELS, "group", "active_ingredient", "type",
    "name_source", "data_source", "feed_name", "feed_display_name",
]

#: Fields of a product that are computed in one step.
FIELDS_AT_ONCE = 6


def _raw(df: DataFrame, name: str) -> Column:
    return field(df, f"raw.{name}").cast("string")


def enrich_items(items: DataFrame, waterfall: DataFrame, sources: Sequence[str], policy: SourcePolicy) -> DataFrame:
    """Items ``(ean, received_name, source[, raw struct])`` joined to their code's answers.

    Adds ``found``, ``requires_approval``, ``approval_reason``, ``pass_through_source`` and
    ``product``, a struct of the merged fields. Unmatched items of a pass-through source with a
    name are accepted as they are; other unmatched items, and matches without a trusted name,
    go to review. ``waterfall`` has one row per distinct code, so each code is looked up once.
    """
    answers = resolve_sources(waterfall, sources, policy)
    dtype = lookup_struct_type(waterfall)
    raw = {name: _raw(items, name) for name in RAW_TEXT_FIELDS}
    name_lookup, data_lookup = F.col("name_lookup"), F.col("data_lookup")

    def result(name: str) -> Column:
        present = field_type(dtype, f"result.{name}") is not None
        return data_lookup["result"][name] if present else F.lit(None).cast("string")

    def info(name: str) -> Column:
        present = field_type(dtype, f"detail.info.{name}") is not None
        return data_lookup["detail"]["info"][name] if present else F.lit(None).cast("string")

    # what the answers alone decide is computed per code, before the join
    answers = computed_once(
        answers,
        _c_name=first_non_blank(primary_name(name_lookup, dtype), info("produto"), primary_name(data_lookup, dtype)),
        _c_shown=first_non_blank(
            display_name(name_lookup, dtype),
            trim(F.concat_ws(" ", F.nullif(info("produto"), F.lit("")), F.nullif(info("apresentacao"), F.lit("")))),
            display_name(data_lookup, dtype),
        ),
        _c_given=first_non_blank(info("descricao_original"), result("descricao_original")),
        _records=ingredient_records(*_drug_names(dtype, data_lookup)),
    )
    answers = computed_once(answers, _c_original=F.coalesce("_c_given", "_c_shown", "_c_name"))
    # per field the answers' values that come before the item's own, and those after it
    pieces = {
        "description": ([info("descricao"), info("apresentacao"), result("descricao"), result("apresentacao")], []),
        "normalized_description": ([info("descricao_normalizada"), result("descricao_normalizada")], [normalize_text("_c_original")]),
        "dose": ([info("dose"), result("dose")], [extract_dose(info("apresentacao")), extract_dose(result("apresentacao"))]),
        "unit": ([info("unidade")], []),
        "form": ([info("forma_farmaceutica")], []),
        "route": ([info("via_adm")], []),
        "quantity": ([info("qtde_fs"), result("quantidade")], []),
        "volume": ([], []),
        "registration": ([info("registro")], []),
        "control_label": ([info("tarja"), result("tarja")], []),
        "laboratory": ([info("laboratorio"), result("laboratorio")], []),
        "manufacturer": ([info("fabricante"), result("fabricante")], [info("laboratorio"), result("laboratorio")]),
        "department": ([info("departamento"), result("departamento")], []),
        "category": ([info("classe"), info("categoria")], []),
        "subcategory": ([info("subcategoria"), result("subcategoria")], []),
        "segment": ([info("segmento"), result("segmento")], []),
        "subsegment": ([info("subsegmento"), result("subsegmento")], []),
        "active_ingredient": (
            [info("ingrediente_ativo"), result("ingrediente_ativo")], [F.array_join(F.transform("_records", lambda r: r["name"]), ", ")],
        ),
    }
    answer_texts = [
        *[result(n) for n in ("produto", "apresentacao", "laboratorio")],
        *[info(n) for n in ("produto", "apresentacao", "classe", "categoria", "subcategoria", "segmento", "subsegmento",
                            "forma_farmaceutica", "tarja", "tipo_receita", "receita")],
    ]
    has_drug_id = F.coalesce(info("medicamentoid") != "", F.lit(False))
    none = F.lit(None).cast("string")
    answers = computed_once(
        answers,
        _before=F.struct(*[first_non_blank(*before).alias(n) for n, (before, _) in pieces.items()]),
        _after=F.struct(*[first_non_blank(*after).alias(n) for n, (_, after) in pieces.items()]),
        _c_type=classify_type(answer_texts, none, none, has_drug_id),
    )
    joined = items.join(answers.withColumnRenamed("ean", "_ean"), F.col("ean") == F.col("_ean"), "left").drop("_ean")

    found = data_lookup.isNotNull()
    trusted_raw = F.when(
        policy.is_trusted(raw["name_source"]),
        first_non_blank(raw["name"], raw["product_name"], raw["display_name"], "received_name"),
    )
    fallback_name = first_non_blank(raw["display_name"], raw["product_name"], raw["name"], "received_name")
    tagged = F.coalesce(*[F.nullif(c, F.lit("")) for c in (raw["name_source"], raw["data_source"], F.col("source"))])
    passes = ~found & policy.is_pass_through(tagged) & fallback_name.isNotNull()
    named = computed_once(joined, _trusted_raw=trusted_raw, _fallback=fallback_name, _passes=passes)
    fallback_name, passes, records = F.col("_fallback"), F.col("_passes"), F.col("_records")
    name = F.coalesce("_c_name", "_trusted_raw")
    shown = F.coalesce("_c_shown", "_trusted_raw", "_c_name")
    original = F.coalesce("_c_given", first_non_blank(raw["original_description"]), shown)
    raw_type_names = ("type", "category", "subcategory", "department", "segment", "subsegment", "group",
                      "name", "product_name", "display_name", "feed_name", "feed_display_name")
    incoming = F.coalesce(*[F.nullif(raw[n], F.lit("")) for n in ("type", "category", "subcategory", "department", "segment", "subsegment")])
    type_fallback = F.coalesce(*[F.nullif(raw[n], F.lit("")) for n in ("type", "category", "department")])
    typed = classify_type([*[raw[n] for n in raw_type_names], *answer_texts], incoming, type_fallback, has_drug_id)
    own_normal = F.when(original.eqNullSafe(F.col("_c_original")), F.col("_after.normalized_description")).when(
        original.isNotNull(), first_non_blank(normalize_text(original))
    )
    merged = {
        n: F.coalesce(F.col(f"_before.{n}"), first_non_blank(raw[n]), own_normal if n == "normalized_description" else F.col(f"_after.{n}"))
        for n in pieces
    }
    merged |= {
        "name": name,
        "product_name": name,
        "display_name": shown,
        "original_description": original,
        "brand": raw["brand"],
        "group": raw["group"],
        "type": F.when(F.concat_ws("", *[raw[n] for n in raw_type_names]) == "", F.col("_c_type")).otherwise(typed),
        "name_source": F.coalesce(name_lookup["key"], data_lookup["key"], F.nullif(raw["name_source"], F.lit(""))),
        "data_source": F.coalesce(data_lookup["key"], name_lookup["key"], raw["data_source"]),
    }
    as_given = dict(raw)
    as_given |= {
        "name": F.when(passes, first_non_blank(raw["name"], fallback_name)).otherwise(raw["name"]),
        "product_name": F.when(passes, first_non_blank(raw["product_name"], fallback_name)).otherwise(raw["product_name"]),
        "display_name": F.when(passes, first_non_blank(raw["display_name"], fallback_name)).otherwise(raw["display_name"]),
        "name_source": F.when(passes, source_key(tagged)),
        "data_source": F.when(passes, F.coalesce(F.nullif(raw["data_source"], F.lit("")), source_key(tagged))).otherwise(
            F.coalesce(F.nullif(raw["data_source"], F.lit("")), F.nullif(F.col("source"), F.lit("")), F.lit(IMPORT_SOURCE))
        ),
    }
    # few fields at a time: methods of many are too large for the JVM to compile
    for low in range(0, len(RAW_TEXT_FIELDS), FIELDS_AT_ONCE):
        some = RAW_TEXT_FIELDS[low : low + FIELDS_AT_ONCE]
        named = computed_once(named, **{f"_p_{n}": F.when(found, merged[n] if n in merged else raw[n]).otherwise(as_given[n]) for n in some})
    product = F.struct(*[F.col(f"_p_{n}").alias(n) for n in RAW_TEXT_FIELDS], F.when(found, records).alias("ingredients"))
    built = named.withColumn("product", product)
    trusted = policy.is_trusted("product.name_source")
    reason = (
        F.when(found & ~trusted, F.concat(F.lit(UNTRUSTED_NAME), policy.fixed_list_text(policy.trusted), F.lit(".")))
        .when(~found & ~passes, approval_reason("lookups", sources, policy))
    )
    keep = [c for c in items.columns if c not in ("received_name", "raw")]
    return built.select(
        *keep,
        F.when(found, shown).when(passes, fallback_name).otherwise(F.col("received_name")).alias("received_name"),
        found.alias("matched"),
        (found | passes).alias("found"),
        F.when(passes, source_key(tagged)).alias("pass_through_source"),
        ((found & ~trusted) | (~found & ~passes)).alias("requires_approval"),
        reason.alias("approval_reason"),
        "resolved_by",
        "lookups",
        "product",
    )


def _drug_names(dtype: T.StructType, lookup: Column) -> tuple[Column, Column]:
    """Names and ready slugs of the detail's active ingredients."""
    empty = F.array().cast("array<string>")
    kind = field_type(dtype, "detail.info.farmacos")
    if not isinstance(kind, T.ArrayType):
        return empty, empty
    drugs = lookup["detail"]["info"]["farmacos"]
    names = F.transform(drugs, lambda d: d["farmaco"])
    slugs = F.transform(drugs, lambda d: d["slug"] if "slug" in kind.elementType.names else F.lit(None).cast("string"))
    return F.coalesce(names, empty), F.coalesce(slugs, empty)


def product_ingredients(product: Column) -> Column:
    """Unique ingredient names: the records if any, else the split ingredient text."""
    listed = F.transform(product["ingredients"], lambda r: r["name"])
    return F.when(F.size(listed) > 0, unique_in_order(listed)).otherwise(split_ingredients(product["active_ingredient"]))


def taxonomy_text(product: Column) -> Column:
    """Text a product is matched to the taxonomy with."""
    names = ["display_name", "product_name", "name", "original_description", "description", *LEVELS,
             "brand", "manufacturer", "laboratory"]
    return F.concat_ws(" ", *[F.nullif(product[n], F.lit("")) for n in names], F.array_join(product_ingredients(product), " "))


def classify_enriched(
    enriched: DataFrame, entries: DataFrame, limit: int = 10, choices: DataFrame | None = None
) -> DataFrame:
    """Place enriched items in the taxonomy and write the levels back into ``product``."""
    flat = enriched.select("*", *[F.col(f"product.{level}").alias(level) for level in LEVELS])
    flat = computed_once(flat, _words=taxonomy_text(F.col("product")))
    placed = classify_taxonomy(flat, entries, "_words", limit, choices).drop("_words")
    product = F.col("product")
    for level in LEVELS:
        product = product.withField(level, F.col(level))
    maker = first_non_blank(F.col("product.manufacturer"), F.col("product.laboratory"), F.col("product.brand"))
    product = product.withField("manufacturer", maker)
    return computed_once(placed, product=product).drop(*LEVELS)


def product_snapshot(enriched: DataFrame, policy: SourcePolicy) -> DataFrame:
    """Final product record of each item, with ``reject_reason`` where its name is not trusted."""
    p = F.col("product")
    enriched = computed_once(enriched, _trusted=policy.is_publishable(p["name_source"]))
    given = lambda column: F.when(F.col("_trusted"), column)
    social = first_non_blank(given(p["product_name"]), given(p["name"]), given(F.col("received_name")))
    enriched = computed_once(enriched, _social=social)
    enriched = computed_once(enriched, _description=first_non_blank(given(p["display_name"]), given(F.col("received_name")), F.col("_social")))
    social, description = F.col("_social"), F.col("_description")
    names = F.col("_drugs")
    ingredient = F.when(F.size(names) > 0, F.array_join(names, ", "))
    texts = [p[n] for n in ("type", "category", "subcategory", "department", "segment", "subsegment", "group",
                            "name", "product_name", "display_name", "feed_name", "feed_display_name")]
    incoming = F.coalesce(*[F.nullif(p[n], F.lit("")) for n in ("type", "category", "subcategory", "department", "segment", "subsegment")])
    fallback = F.coalesce(*[F.nullif(p[n], F.lit("")) for n in ("type", "category", "department")])
    classification = first_non_blank(
        p["subcategory"], p["category"], p["department"], p["segment"], p["subsegment"], p["group"],
        classify_type(texts, incoming, fallback),
    )
    manufacturer = first_non_blank(p["laboratory"], p["manufacturer"], p["brand"])
    enriched = computed_once(enriched, _class=classification, _maker=manufacturer)
    # a plain column: it has several uses, so Spark keeps it, and leaves it out where none of them is read
    enriched = enriched.withColumn("_drugs", product_ingredients(p))
    classification, manufacturer = F.col("_class"), F.col("_maker")
    details = details_json(p, F.col("ean"), F.col("source"), names, manufacturer)
    parts = F.array(
        description, social, ingredient, classification, manufacturer,
        *[first_non_blank(p[n]) for n in ("dose", "unit", "form", "route", "quantity", "volume", "department",
                                          "subcategory", "segment", "subsegment", "active_ingredient",
                                          "registration", "control_label")],
    )
    refused = F.concat(
        F.lit(NAME_REJECTED), policy.fixed_list_text([*policy.trusted, *policy.pass_through]), F.lit(".")
    )
    hidden = ("product", "lookups", "candidates", "_trusted", "_drugs", "_social", "_description", "_class", "_maker")
    keep = [c for c in enriched.columns if c not in hidden]
    return enriched.select(
        *keep,
        description.alias("description"),
        ingredient.alias("active_ingredient"),
        classification.alias("classification"),
        social.alias("social_name"),
        manufacturer.alias("manufacturer"),
        *[first_non_blank(p[level]).alias(level) for level in LEVELS],
        details.alias("details"),
        search_artifacts(parts).alias("search"),
        F.when(social.isNull(), refused).alias("reject_reason"),
    )


def details_json(p: Column, ean: Column, source: Column, ingredients: Column, manufacturer: Column) -> Column:
    """The product's attributes as nested JSON text, in the format readers of the catalogue expect."""
    v = lambda name: first_non_blank(p[name])
    levels = dict(zip(LEVELS, ["departamento", "categoria", "subcategoria", "segmento", "subsegmento"]))
    final = F.struct(
        ean.alias("ean"),
        v("original_description").alias("descricao_original"),
        v("normalized_description").alias("descricao_normalizada"),
        v("brand").alias("marca"),
        manufacturer.alias("fabricante"),
        *[v(level).alias(label) for level, label in levels.items()],
        ingredients.alias("principio_ativo"),
    )
    return F.to_json(
        F.struct(
            ean.alias("ean"),
            v("dose").alias("dose"),
            v("unit").alias("unidade"),
            v("form").alias("forma_farmaceutica"),
            v("route").alias("via_administracao"),
            v("quantity").alias("quantidade"),
            v("volume").alias("volume"),
            v("registration").alias("registro_ms"),
            v("control_label").alias("tarja"),
            F.coalesce(first_non_blank(p["name_source"], source), F.lit(IMPORT_SOURCE)).alias("origem_nome"),
            F.coalesce(first_non_blank(p["data_source"], source), F.lit(IMPORT_SOURCE)).alias("origem_dados"),
            v("original_description").alias("descricao_original"),
            v("normalized_description").alias("descricao_normalizada"),
            *[v(level).alias(label) for level, label in levels.items()],
            v("active_ingredient").alias("ingrediente_ativo"),
            F.when(F.size(ingredients) > 0, ingredients).alias("farmacos"),
            final.alias("estrutura_final"),
        )
    )


# Fallback codes of an unanswered lookup, and what to do next.
FALLBACKS = {
    "invalid_ean": ("INVALID_EAN", "corrigir_ean_e_tentar_novamente"),
    "not_found": ("LOOKUP_NOT_FOUND", "validar_ean_ou_cadastrar_manual"),
    "error": ("LOOKUP_ERROR", "tentar_novamente"),
}
_PRODUCT = ["description", "active_ingredient", "classification", "social_name", "manufacturer", *LEVELS, "details", "search"]


def lookup_batch(
    requests: DataFrame, lookups: DataFrame, sources: Sequence[str], policy: SourcePolicy, entries: DataFrame,
    limit: int = 10,
) -> DataFrame:
    """Answer each requested code: ``status`` is invalid_ean, error, not_found, review or enriched.

    ``requests`` has ``request_id`` and ``input_ean``; every request is answered, and each
    distinct valid code is looked up and classified once. Invalid codes take no part in any join. A code that
    every asked source answered with an error has the status error. ``item`` is the enriched item as found;
    the product's columns are filled for ``enriched`` only. ``attempted_sources`` are those asked in turn.
    """
    checked = computed_once(requests, _c=validate_ean("input_ean")).select(
        "request_id", trim("input_ean").alias("input_ean"), F.col("_c.ean").alias("ean"),
        F.col("_c.is_valid").alias("_ok"), F.col("_c.reason").alias("_reason"),
    )
    valid = checked.filter("_ok").drop("_ok", "_reason")
    codes = valid.select("ean").distinct()
    waterfall = lookup_waterfall(codes, lookups, sources)
    items = codes.select("ean", F.lit(None).cast("string").alias("received_name"), F.lit("lookup_api").alias("source"))
    enriched = enrich_items(items, waterfall, sources, policy)
    asked = F.filter("lookups", lambda x: ~x["skipped"])
    enriched = computed_once(
        enriched,
        attempted_sources=F.transform(asked, lambda x: x["key"]),
        _failed=(F.size(asked) > 0) & F.forall(asked, lambda x: x["error"].isNotNull()),
        error=F.array_join(F.array_compact(F.transform(asked, lambda x: x["error"])), "; "),
    )
    classified = classify_enriched(enriched, entries, limit)
    classified = classified.withColumn("item", F.when(F.col("found"), F.col("product")))
    answers = product_snapshot(classified, policy).drop("received_name", "source")
    status = (
        F.when(~F.col("found") & F.col("_failed"), "error").when(~F.col("found"), "not_found")
        .when(F.col("requires_approval"), "review").otherwise("enriched")
    )
    answers = computed_once(answers, status=status)
    done = F.col("status") == "enriched"
    answers = answers.withColumns({c: F.when(done, F.col(c)) for c in _PRODUCT} | {"error": F.when(F.col("status") == "error", F.col("error"))})
    answered = valid.join(answers.drop("_failed"), "ean")
    refused = checked.filter(~F.coalesce(F.col("_ok"), F.lit(False))).select(
        "request_id", "input_ean", "ean", F.lit("invalid_ean").alias("status"), F.col("_reason").alias("approval_reason"),
        F.col("_reason").alias("error"), F.lit(False).alias("found"), F.lit(False).alias("requires_approval"),
        F.array().cast("array<string>").alias("attempted_sources"),
    )
    every = answered.unionByName(refused, allowMissingColumns=True)

    def fallback(part: int) -> Column:
        picked = F.lit(None).cast("string")
        for name, texts in FALLBACKS.items():
            picked = F.when(F.col("status") == name, texts[part]).otherwise(picked)
        return picked

    return every.withColumns({"fallback_code": fallback(0), "next_action": fallback(1)})
