"""Turning landed lookup answers and retail pages into lookup records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalogkit.functions.html import absolute_url, extract_fields, html_to_text, strip_query, url_template
from catalogkit.functions.packages import extract_package, infer_terms
from catalogkit.functions.text import Col, _c, let, normalize_text, split_ingredients, trim
from catalogkit.functions.values import first_non_blank, first_text, json_path

# Collections an answer may hold its records in.
COLLECTIONS = ["data", "results", "items", "skus", "rows"]

# Fields of an answer's record, per target, in order.
RECORD_FIELDS = {
    "marca": ["brand", "brand_name", "marca", "manufacturer"],
    "fabricante": ["manufacturer", "brand_name", "brand", "marca"],
    "categoria": ["category", "category_name", "departamento", "department"],
    "departamento": ["department", "department_name"],
    "unidade": ["measurement_unit", "unit"],
    "quantidade": ["quantity", "package_quantity"],
    "volume": ["volume"],
    "descricao": ["description", "short_description"],
}
TITLE_FIELDS = ["title", "nome", "name", "product_name", "description"]


def lookup_record(payload: Col) -> Column:
    """Struct of the first usable record of an answer; null without a title.

    The answer is an array, an object holding one under a known name, or one record.
    """
    payload = _c(payload)
    found = [F.get_json_object(payload, f"$.{name}[0]") for name in COLLECTIONS]
    inside = F.coalesce(*found, payload)
    record = F.when(F.ltrim(payload).startswith("["), F.get_json_object(payload, "$[0]")).otherwise(inside)
    fields = {"title": TITLE_FIELDS, "sku_id": ["id", "sku_id"], "product_id": ["product_id", "produto_id"], **RECORD_FIELDS}

    def values(parsed: Column) -> Column:
        texts = [json_path(parsed, *[f"$.{n}" for n in names]).alias(target) for target, names in fields.items()]
        return F.struct(texts[0].alias("nome"), *texts)

    found_record = let(record, values)
    return let(found_record, lambda r: F.when(r["title"].isNotNull(), r))


_ATTRIBUTE = "struct<attribute_code:string,value_string:array<string>,value:array<struct<label:string>>>"
_PRODUCT = (
    "struct<name:string,sku:string,productEan:string,breadcrumb:array<struct<name:string>>,"
    f"custom_attributes:array<{_ATTRIBUTE}>>"
)
_NODE = "struct<`@type`:string,name:string,description:string,gtin13:string,brand:struct<name:string>>"
_HIT = (
    "struct<url:string,name:string,brand:string,sku:string,objectID:string,productGroup:string,"
    "categories:array<struct<name:string>>>"
)
_PROPS = (
    f"results:struct<products:array<{_HIT}>>,productData:{_PRODUCT},pdpSeoSchemaResult:struct<nodes:array<{_NODE}>>"
)
_PAGE = f"struct<props:struct<pageProps:struct<{_PROPS},pageProps:struct<{_PROPS}>>>>"


def page_props(page_json: Col) -> Column:
    """Typed page properties of a retail page's data, with the nested variant under ``pageProps``."""
    return F.from_json(_c(page_json), _PAGE)["props"]["pageProps"]


def search_hit(page_json: Col, base_url: str, ean: Col | None = None) -> Column:
    """First product of a search page as a lookup result; null without a URL and a name."""
    def hit_of(props: Column) -> Column:
        return F.get(F.coalesce(props["results"]["products"], props["pageProps"]["results"]["products"]), F.lit(0))

    def result_of(hit: Column) -> Column:
        names = F.filter(F.transform(hit["categories"], lambda c: trim(c["name"])), lambda n: n != "")
        return F.struct(first_text(hit["name"]).alias("name"), first_text(hit["brand"]).alias("brand"),
                        names.alias("categories"), strip_query(hit["url"]).alias("href"), hit.alias("hit"))

    def record(r: Column) -> Column:
        hit, level = r["hit"], lambda i: F.get(r["categories"], F.lit(i))
        result = F.struct(
            (F.lit(None).cast("string") if ean is None else _c(ean)).alias("ean"),
            first_text(hit["sku"], hit["objectID"]).alias("sku"),
            *[r["name"].alias(n) for n in ("nome", "nome_produto", "nome_exibicao", "produto")],
            *[r["brand"].alias(n) for n in ("marca", "laboratorio")],
            *[level(i).alias(n) for i, n in enumerate(("departamento", "categoria", "subcategoria"))],
            first_text(hit["productGroup"]).alias("segmento"),
            r["href"].alias("href"),
            absolute_url(r["href"], base_url).alias("url"),
        )
        return F.when((hit["url"] != "") & (hit["name"] != ""), result)

    return let(let(let(page_props(page_json), hit_of), result_of), record)


def product_detail(page_json: Col, result: Col | None = None) -> Column:
    """Detail ``struct<info>`` of a product page, falling back to the search ``result``'s fields."""
    prior = lambda name: F.lit(None).cast("string") if result is None else _c(result)[name]
    first_of = lambda values: F.get(F.filter(F.transform(values, trim), lambda v: v != ""), F.lit(0))

    def parts(props: Column) -> Column:
        nested = props["productData"].isNull() & props["pageProps"]["productData"].isNotNull()
        pick = lambda name: F.when(nested, props["pageProps"][name]).otherwise(props[name])
        schema = F.filter(pick("pdpSeoSchemaResult")["nodes"], lambda n: n["@type"] == "Product")
        return F.struct(pick("productData").alias("product"), F.get(schema, F.lit(0)).alias("schema"))

    def facts(p: Column) -> Column:
        product, schema = p["product"], p["schema"]
        attribute = lambda code: F.get(F.filter(product["custom_attributes"], lambda a: a["attribute_code"] == code), F.lit(0))
        text = lambda code: first_of(attribute(code)["value_string"])
        label = lambda code: first_of(F.transform(attribute(code)["value"], lambda v: v["label"]))
        crumbs = F.filter(F.transform(product["breadcrumb"], lambda b: trim(b["name"])), lambda n: n != "")
        return F.struct(
            (product.isNotNull() | schema.isNotNull()).alias("known"),
            first_text(product["productEan"], text("ean"), schema["gtin13"], prior("ean")).alias("gtin"),
            first_text(product["name"], schema["name"]).alias("original"),
            first_text(text("description"), text("short_description"), schema["description"]).alias("html"),
            first_text(label("marca"), schema["brand"]["name"], prior("marca")).alias("brand"),
            label("fabricante").alias("maker"),
            crumbs.alias("crumbs"),
            *[text(code).alias(code) for code in ("quantidade", "descricaodetalhada", "grupo", "subgruponome", "dosagem",
                                                  "descricaotarja", "principioativonovo")],
        )

    def texts(f: Column) -> Column:
        return F.struct(
            f.alias("f"),
            html_to_text(f["html"]).alias("description"),
            extract_package(f["quantidade"], f["original"], f["descricaodetalhada"]).alias("package"),
        )

    def ingredients(t: Column) -> Column:
        inferred = F.array_join(infer_terms(F.concat_ws(" ", t["f"]["original"], t["description"])), ", ")
        return F.struct(t.alias("t"), first_text(t["f"]["principioativonovo"], inferred).alias("ingredient"))

    def detail(i: Column) -> Column:
        t, f = i["t"], i["t"]["f"]
        level = lambda n: F.get(f["crumbs"], F.lit(n))
        none = F.lit(None).cast("string")
        info = F.struct(
            f["gtin"].alias("gtin"),
            f["original"].alias("produto"),
            t["description"].alias("apresentacao"),
            t["description"].alias("descricao"),
            F.coalesce(f["maker"], f["brand"]).alias("laboratorio"),
            first_text(level(1), prior("categoria")).alias("categoria"),
            none.alias("classe"),
            first_text(level(0), prior("departamento")).alias("departamento"),
            first_text(level(2), prior("subcategoria")).alias("subcategoria"),
            first_text(f["grupo"], prior("segmento")).alias("segmento"),
            f["subgruponome"].alias("subsegmento"),
            f["dosagem"].alias("dose"),
            t["package"]["unit"].alias("unidade"),
            t["package"]["quantity"].alias("qtde_fs"),
            f["descricaotarja"].alias("tarja"),
            f["original"].alias("descricao_original"),
            F.when(f["original"].isNotNull(), normalize_text(f["original"])).alias("descricao_normalizada"),
            i["ingredient"].alias("ingrediente_ativo"),
            F.transform(
                split_ingredients(i["ingredient"]), lambda n: F.struct(n.alias("farmaco"), none.alias("slug"))
            ).alias("farmacos"),
        )
        return F.when(f["known"], F.struct(info.alias("info")))

    step = page_props(page_json)
    for body in (parts, facts, texts, ingredients, detail):
        step = let(step, body)
    return step


# Fields of a scrape configuration and what they fill.
SCRAPE_RESULT = {
    "resultName": "nome",
    "resultDisplayName": "nome_exibicao",
    "resultPresentation": "apresentacao",
    "resultBrand": "laboratorio",
    "resultCategory": "categoria",
    "resultTarja": "tarja",
    "resultLink": "href",
}
SCRAPE_DETAIL = {
    "detailName": "produto",
    "detailPresentation": "apresentacao",
    "detailBrand": "laboratorio",
    "detailClass": "classe",
    "detailCategory": "categoria",
    "detailRegistration": "registro",
    "detailTarja": "tarja",
    "detailForm": "forma_farmaceutica",
    "detailRoute": "via_adm",
    "detailQuantity": "qtde_fs",
}


def _scraped(pages: DataFrame, rules: dict, wanted: dict, key: str, html: str, keep: dict, scope: str | None = None):
    """Fields of a configuration by target, with the columns ``keep``; the page is parsed once."""
    fields = {target: rules[name] for name, target in wanted.items() if rules.get(name)}
    found = pages.select(key, *[c.alias(n) for n, c in keep.items()], *extract_fields(html, fields, scope))
    return found, lambda n: F.col(n) if n in fields else F.lit(None).cast("string")


def scrape_results(pages: DataFrame, config: dict, key: str = "ean", html: str = "html", code: str | None = None) -> DataFrame:
    """Lookup results of landed search pages, by a declarative scrape configuration.

    ``resultItem`` limits the fields to the first element that matches it; a page without one has no result.
    ``detail.urlTemplate`` builds the result's URL from ``{{href}}``, ``{{ean}}`` (the column ``code``) and
    ``{{baseUrl}}``. A page gives a result when a name, link or presentation is found.
    """
    rules = config.get("selectors") or {}
    base = config.get("baseUrl") or (config.get("search") or {}).get("baseUrl") or ""
    keep = {"_code": F.col(code or key).cast("string")}
    found, column = _scraped(pages, rules, SCRAPE_RESULT, key, html, keep, rules.get("resultItem"))
    name = first_non_blank(column("nome"), column("nome_exibicao"))
    joined = F.concat_ws(" ", name, column("apresentacao"))
    href = column("href")
    template = (config.get("detail") or {}).get("urlTemplate")
    target = url_template(template, href=href, ean=F.col("_code"), baseUrl=F.lit(base)) if template else href
    result = F.struct(
        name.alias("nome"),
        name.alias("nome_produto"),
        first_non_blank(column("nome_exibicao"), joined, name).alias("nome_exibicao"),
        name.alias("produto"),
        *[column(n).alias(n) for n in ("apresentacao", "laboratorio", "categoria", "tarja", "href")],
        F.when(href.isNotNull(), absolute_url(target, base)).alias("url"),
    )
    usable = name.isNotNull() | href.isNotNull() | column("apresentacao").isNotNull()
    return found.select(key, F.when(usable, result).alias("result"))


def scrape_details(pages: DataFrame, config: dict, key: str = "ean", html: str = "html") -> DataFrame:
    """Lookup details of landed product pages; the name falls back to the search page's rule."""
    rules = config.get("selectors") or {}
    many = rules.get("detailActiveIngredients")
    listed = isinstance(many, dict) and many.get("multiple")
    wanted = SCRAPE_DETAIL | {"resultName": "_name"} | ({"detailActiveIngredients": "_drugs"} if listed else {})
    found, column = _scraped(pages, rules, wanted, key, html, {})
    drugs = F.coalesce(column("_drugs"), F.array().cast("array<string>")) if listed else F.array().cast("array<string>")
    values = {n: column(n) for n in SCRAPE_DETAIL.values()}
    values["produto"] = first_non_blank(values["produto"], column("_name"))
    info = F.struct(
        *[value.alias(n) for n, value in values.items()],
        F.transform(drugs, lambda d: F.struct(d.alias("farmaco"), F.lit(None).cast("string").alias("slug"))).alias("farmacos"),
    )
    return found.select(key, F.struct(info.alias("info")).alias("detail"))
