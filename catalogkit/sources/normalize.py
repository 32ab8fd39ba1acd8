"""Mapping feeds of any shape to canonical items and stock rows, by declared field lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalogkit.functions.ean import only_digits
from catalogkit.functions.text import Col, _c, trim
from catalogkit.functions.values import (
    array_pick,
    computed_once,
    discount_pct,
    effective_promo,
    fallback,
    field,
    field_type,
    first_finite,
    first_non_blank,
    optional_text,
    to_number,
)
from catalogkit.operators.dedupe import distinct_on
from catalogkit.operators.ordering import export_slice

# Field names a canonical item is read from.
EAN_FIELDS = ["ean", "codigo_barras", "codigobarras", "codigo"]
NAME_FIELDS = ["nome_recebido", "nome", "description", "descricao"]
NULL_TOKEN = "NULL"

# Fields of ERP feed A, per target, in order.
ERP_A_FIELDS = {
    "barcode": ["codigoBarras", "ean", "gtin"],
    "feed_name": ["nomeProduto", "nome"],
    "feed_display_name": ["nomeEcommerce", "nomeProduto", "nome"],
    "description": ["descricaoEcommerce", "apresentacao", "nomeApresentacao"],
    "category": ["nomeCategoria", "categoria"],
    "department": ["nomeDepartamento", "departamento"],
    "group": ["nomeGrupo", "grupo"],
    "laboratory": ["nomeFabricante", "fabricante", "marca"],
    "type": ["tipoProduto", "tipo"],
    "form": ["formaFarmaceutica", "forma"],
    "quantity": ["quantidade", "qtde", "estoque"],
    "volume": ["volume"],
    "registration": ["registroMs", "registro"],
    "control_label": ["tarja"],
}

# Fields of ERP feed B, per target, in order.
ERP_B_FIELDS = {
    "barcode": ["codigoBarras"],
    "feed_name": ["descricaoUsual", "descricao"],
    "feed_display_name": ["descricaoUsual", "descricao"],
    "description": ["descricao", "descricaoUsual"],
    "category": ["nomeCategoria"],
    "department": ["nomeDepartamento"],
    "group": ["nomeLinha"],
    "laboratory": ["nomeFabricante", "nomeMarca"],
    "control_label": ["tipoReceita", "corReceita"],
}

# Default columns of ERP feed B.
ERP_B_COLUMNS = [
    "cdFilial",
    "cdProduto",
    "descricao",
    "descricaoUsual",
    "codigoBarras",
    "inativo",
    "cdMarca",
    "nomeMarca",
    "cdFabricante",
    "nomeFabricante",
    "cdLinha",
    "nomeLinha",
    "cdCategoria",
    "nomeCategoria",
    "qtdEstoque",
    "vlrTabela",
    "percDesconto",
    "vlrOferta",
    "dtCadastro",
    "dtUltimaAlteracao",
    "nsuRegistro",
    "controleSngpc",
    "cdDepartamento",
    "nomeDepartamento",
    "controlado",
    "antimicrobiano",
    "etico",
    "generico",
    "similar",
    "tipoReceituario",
    "tipoReceita",
    "corReceita",
]

# Specification names of the e-commerce feed.
SPEC_REGISTRATION = ["Código MS", "Codigo MS", "RMS"]
SPEC_INGREDIENT = ["Princípio Ativo", "Principio Ativo"]


def canonical_item(
    df: DataFrame, source: str, ean_fields: Sequence[str] = EAN_FIELDS, name_fields: Sequence[str] = NAME_FIELDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(ean, received_name, raw, source)`` from whichever of the fields exist; ``NULL`` text is missing."""
    return df.select(
        *keep,
        fallback(df, ean_fields, null_token=NULL_TOKEN).alias("ean"),
        fallback(df, name_fields, null_token=NULL_TOKEN).alias("received_name"),
        F.to_json(F.struct(*df.columns)).alias("raw"),
        F.lit(source).alias("source"),
    )


def read_packages(
    df: DataFrame, code: str = "codigobarras", description: str = "descricao", row_id: str = "id",
    top: int | None = None, skip: int = 0,
) -> DataFrame:
    """One row per non-blank code with its lowest description: ``(ean, name)``, in code order when paged."""
    present = _present_packages(df, code, description)
    rows = distinct_on(present, [code], [description, row_id])
    rows = rows.select(F.col(code).alias("ean"), F.col(description).alias("name"))
    if top is None and not skip:
        return rows
    return export_slice(rows, "ean", top, skip)


def count_packages(df: DataFrame, code: str = "codigobarras", description: str = "descricao") -> DataFrame:
    codes = _present_packages(df, code, description).select(code).distinct()
    return codes.agg(F.count("*").alias("total"))


def _present_packages(df: DataFrame, code: str, description: str) -> DataFrame:
    return df.filter((trim(F.col(code)) != "") & (trim(F.col(description)) != ""))


def normalize_packages(rows: DataFrame, source: str = "client_table") -> DataFrame:
    """Package rows as items; rows without a code or name are dropped."""
    return rows.select(
        optional_text("ean").alias("ean"),
        optional_text("name").alias("received_name"),
        F.struct(
            optional_text("name").alias("name"),
            optional_text("name").alias("product_name"),
            optional_text("name").alias("display_name"),
            F.lit(source).alias("name_source"),
            F.lit(source).alias("data_source"),
        ).alias("raw"),
        F.lit(source).alias("source"),
    ).filter(F.col("ean").isNotNull() & F.col("received_name").isNotNull())


def _normalize_erp(df: DataFrame, fields: dict[str, list[str]], source: str, code: Column, extra: list[Column]) -> DataFrame:
    raw = [fallback(df, names, trimmed=False).alias(target) for target, names in fields.items()]
    return df.select(
        fallback(df, fields["barcode"], trimmed=False).alias("ean"),
        fallback(df, fields["feed_display_name"], trimmed=False).alias("received_name"),
        F.struct(
            code.cast("string").alias("code"),
            *raw,
            *extra,
            F.lit(source).alias("name_source"),
            F.lit(source).alias("data_source"),
            F.to_json(F.struct(*df.columns)).alias("payload"),
        ).alias("raw"),
        F.lit(source).alias("source"),
    )


def normalize_erp_a(df: DataFrame, source: str = "erp_a") -> DataFrame:
    """ERP feed A as items. Values keep their outer blanks; no row is dropped."""
    return _normalize_erp(df, ERP_A_FIELDS, source, field(df, "codigo"), [])


def normalize_erp_b(df: DataFrame, source: str = "erp_b") -> DataFrame:
    """ERP feed B as items; rows without a barcode are dropped."""
    quantity = field(df, "qtdEstoque").cast("string").alias("quantity")
    items = _normalize_erp(df, ERP_B_FIELDS, source, field(df, "cdProduto"), [quantity])
    return items.filter(F.col("ean").isNotNull())


def feed_predicate(
    df: DataFrame, user_filter: str | None = None, branch: int | None = None,
    inactive: str = "inativo", barcode: str = "codigoBarras", branch_col: str = "cdFilial",
) -> DataFrame:
    """Active rows with a barcode, of one branch if given, that also pass the user's SQL condition."""
    chosen = df.filter(F.expr(user_filter)) if user_filter and user_filter.strip() else df
    chosen = chosen.filter(~F.col(inactive) & F.col(barcode).isNotNull() & (F.col(barcode) != ""))
    return chosen.filter(F.col(branch_col) == branch) if branch and branch > 0 else chosen


def select_feed_columns(df: DataFrame, columns: Sequence[str] = ERP_B_COLUMNS) -> DataFrame:
    """The chosen columns that exist, so the scan reads no others."""
    return df.select(*[c for c in columns if c in df.columns])


def explode_product_skus(df: DataFrame, mapping: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(product_id, sku_id)`` pairs of a map from product id to sku ids; empty ids are dropped."""
    pairs = df.select(*keep, F.explode(mapping).alias("product_id", "_skus"))
    pairs = pairs.select(*keep, "product_id", F.explode("_skus").alias("sku_id"))
    sku = F.col("sku_id")
    numeric = isinstance(pairs.schema["sku_id"].dataType, T.NumericType)
    return pairs.filter(sku != 0 if numeric else sku != "")


def spec_value(specs: Col, names: Sequence[str]) -> Column:
    """First non-blank value among the specifications with one of the names, in order."""
    wanted = [n.strip().lower() for n in names]
    named = F.filter(_c(specs), lambda s: F.lower(trim(s["FieldName"])).isin(*wanted))
    return array_pick(F.flatten(F.transform(named, lambda s: F.coalesce(s["FieldValues"], F.array().cast("array<string>")))), 1)


def normalize_ecommerce(df: DataFrame, source: str = "ecommerce") -> DataFrame:
    """Nested SKU payload as items; rows without a code are dropped."""
    def pick(*columns: Column) -> Column:
        return first_non_blank(*columns, null_token=NULL_TOKEN)

    def item_at(name: str, position: int) -> Column:
        if field_type(df.schema, name) is None:
            return F.lit(None).cast("string")
        values = F.map_values(name) if isinstance(field_type(df.schema, name), T.MapType) else F.col(name)
        return F.try_element_at(values, F.lit(position)).cast("string")

    def spec(names: list[str]) -> Column:
        present = field_type(df.schema, "ProductSpecifications") is not None
        return spec_value("ProductSpecifications", names) if present else F.lit(None).cast("string")

    f = lambda name: field(df, name).cast("string")
    name = pick(f("NameComplete"), f("ProductName"), f("SkuName"), f("ProductDescription"))
    ean = pick(f("AlternateIds.Ean"), item_at("AlternateIdValues", 1))
    raw = F.struct(
        F.coalesce(f("Id"), f("_metadata.skuId")).alias("sku_id"),
        F.coalesce(f("ProductId"), f("_metadata.productId")).alias("product_id"),
        pick(f("AlternateIds.RefId"), f("ProductRefId")).alias("ref_id"),
        name.alias("name"),
        pick(f("ProductName"), name).alias("product_name"),
        pick(f("NameComplete"), name).alias("display_name"),
        pick(f("ProductDescription"), name).alias("description"),
        pick(item_at("ProductCategories", -1), item_at("Categories", -1)).alias("category"),
        pick(f("BrandName")).alias("laboratory"),
        pick(f("BrandName")).alias("brand"),
        pick(spec(SPEC_REGISTRATION)).alias("registration"),
        pick(spec(SPEC_INGREDIENT)).alias("stated_ingredient"),
        pick(f("ImageUrl")).alias("image_url"),
        F.lit(source).alias("name_source"),
        F.lit(source).alias("data_source"),
        F.to_json(F.struct(*df.columns)).alias("payload"),
    )
    items = df.select(ean.alias("ean"), name.alias("received_name"), raw.alias("raw"), F.lit(source).alias("source"))
    return items.filter(F.col("ean").isNotNull())


# Fields of the three stock and price feeds, per target, in order.
STOCK_A = {
    "stock": ["quantidadeEstoqueEcommerce", "quantidadeEstoque", "qtdEstoque", "estoque", "saldo_estoque"],
    "price": ["valorVendaEcommerce", "valorVenda", "preco", "vlrTabela"],
    "promo_price": ["valorVendaPromocional", "vlrOferta", "precoPromocional", "preco_promocional"],
    "discount_pct": ["percentualDescontoMax", "percentualDesconto", "descontoPercentual", "percDesconto"],
    "ean": ["codigoBarras", "ean", "codigo_barras", "codigobarras"],
    "description": ["nome", "descricao", "descricaoProduto"],
    "branch": ["cdFilial", "cdfilial"],
    "id": ["codigo", "id"],
    "code": ["codigo"],
}
STOCK_B = {
    "stock": ["qtdEstoque", "estoque", "saldo_estoque"],
    "price": ["vlrTabela", "preco"],
    "promo_price": ["vlrOferta", "precoPromocional", "preco_promocional"],
    "discount_pct": ["percDesconto", "descontoPercentual"],
    "ean": ["codigoBarras", "ean", "codigo_barras", "codigobarras"],
    "description": ["descricao", "descricaoUsual", "nome", "descricaoProduto"],
    "branch": ["cdFilial", "cdfilial"],
    "id": ["id", "cdProduto", "produtoid"],
    "code": ["cdProduto", "codigo"],
}
STOCK_C = {
    "stock": ["estoque", "qtdEstoque", "saldo_estoque"],
    "price": ["valorVenda", "preco", "vlrTabela"],
    "promo_price": ["melhorDesconto", "precoPromocional", "vlrOferta"],
    "ean": ["ean", "codigoBarras", "codigo_barras"],
    "description": ["descricao", "descricaoProduto", "nome"],
    "id": ["id", "codigo"],
    "code": ["codigo"],
}


def _first_given(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null field, blanks included."""
    present = [F.col(n).cast("string") for n in names if field_type(df.schema, n) is not None]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _number_given(df: DataFrame, names: Sequence[str]) -> Column:
    """Number of the first non-null field; a blank counts as zero, other text as null."""
    given = _first_given(df, names)
    return F.when(trim(given) == "", F.lit(0.0)).otherwise(to_number(given))


def _first_set(df: DataFrame, names: Sequence[str]) -> Column:
    """First field that is neither null, empty nor zero."""
    picks = [F.nullif(F.nullif(F.col(n).cast("string"), F.lit("")), F.lit("0")) for n in names if field_type(df.schema, n) is not None]
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def _stock_rows(df: DataFrame, source: str, keep: Sequence[str], **columns: Column) -> DataFrame:
    return df.select(
        *keep,
        F.lit(source).alias("source"),
        *[c.alias(n) for n, c in columns.items()],
        F.coalesce(columns["stock"] > 0, F.lit(False)).alias("available"),
    )


def normalize_stock_a(df: DataFrame, source: str = "erp_a", keep: Sequence[str] = ()) -> DataFrame:
    """Stock feed A: the first field that holds a finite number counts."""
    numbers = {
        n: F.coalesce(*[first_finite(c) for c in STOCK_A[n] if field_type(df.schema, c) is not None], F.lit(None).cast("double"))
        for n in ("stock", "price", "promo_price", "discount_pct")
    }
    numbers["stock"] = F.coalesce(numbers["stock"], F.lit(0.0))
    return _stock_rows(
        df, source, keep,
        id=_first_given(df, STOCK_A["id"]), code=_first_given(df, STOCK_A["code"]),
        branch=_first_given(df, STOCK_A["branch"]), ean=_first_set(df, STOCK_A["ean"]),
        description=_first_set(df, STOCK_A["description"]), **numbers,
    )


def normalize_stock_b(df: DataFrame, source: str = "erp_b", keep: Sequence[str] = ()) -> DataFrame:
    """Stock feed B: the first non-null field counts, whatever it holds."""
    numbers = {n: _number_given(df, STOCK_B[n]) for n in ("stock", "price", "promo_price", "discount_pct")}
    numbers["stock"] = F.when(_first_given(df, STOCK_B["stock"]).isNull(), F.lit(0.0)).otherwise(numbers["stock"])
    return _stock_rows(
        df, source, keep,
        id=_first_set(df, STOCK_B["id"]), code=_first_set(df, STOCK_B["code"]),
        branch=_first_given(df, STOCK_B["branch"]), ean=_first_set(df, STOCK_B["ean"]),
        description=_first_set(df, STOCK_B["description"]), **numbers,
    )


def normalize_stock_c(df: DataFrame, source: str = "erp_c", keep: Sequence[str] = ()) -> DataFrame:
    """Stock feed C: the promotional price and discount are derived from the best price."""
    df = computed_once(
        df,
        _price=_number_given(df, STOCK_C["price"]),
        _best=_number_given(df, STOCK_C["promo_price"]),
        _stock=F.coalesce(_number_given(df, STOCK_C["stock"]), F.lit(0.0)),
        _ean=only_digits(_first_given(df, STOCK_C["ean"]), null_when_empty=True),
    )
    return _stock_rows(
        df, source, keep,
        id=F.coalesce(_first_set(df, STOCK_C["id"]), F.col("_ean")), code=_first_given(df, STOCK_C["code"]),
        branch=F.lit(None).cast("string"), ean=F.col("_ean"), description=_first_set(df, STOCK_C["description"]),
        stock=F.col("_stock"), price=F.col("_price"),
        promo_price=effective_promo("_price", "_best"), discount_pct=discount_pct("_price", "_best"),
    )


class SourceRegistry:
    """Import sources by name; each turns a landed feed into canonical items."""

    def __init__(self):
        self._sources: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register_source(self, name: str, normalizer: Callable[[DataFrame], DataFrame]) -> "SourceRegistry":
        self._sources[name.strip().lower()] = normalizer
        return self

    def names(self) -> list[str]:
        return list(self._sources)

    def normalize(self, name: str, df: DataFrame) -> DataFrame:
        key = name.strip().lower()
        if key not in self._sources:
            raise KeyError(f"unknown import source: {name}")
        return self._sources[key](df)


def default_sources() -> SourceRegistry:
    registry = SourceRegistry()
    registry.register_source("erp_a", normalize_erp_a).register_source("erp_b", normalize_erp_b)
    registry.register_source("ecommerce", normalize_ecommerce).register_source("client_table", normalize_packages)
    return registry
