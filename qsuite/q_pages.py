"""Reading pages, lookup answers and embedded JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.functions.html import (
    absolute_url,
    embedded_json,
    extract_field,
    extract_fields,
    finish_field,
    html_to_text,
    parse_fields,
    script_bodies,
    strip_query,
    unescape,
    url_template,
)
from catalogkit.sources.lookups import lookup_record, product_detail, scrape_details, scrape_results, search_hit
from catalogkit.sources.normalize import normalize_ecommerce, normalize_erp_a, normalize_erp_b
from qsuite import views as v
from qsuite.registry import query


def pages(spark, d):
    return v.table(spark, d, "pages")


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]


def _plain(expr: str) -> str:
    """Text of a fragment: tags dropped, entities decoded, blanks collapsed."""
    text = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    for entity, char in _ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    return f"nullif(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '')"


_BODY = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"


@query(
    "html_to_text",
    r"""select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</li>', chr(10), 'g'),
      '(?i)<li[^>]*>', '- ', 'g'), '(?i)<[^>]+>|&nbsp;', ' ', 'g'), '\s+', ' ', 'g'))) as text_md5 from pages""",
)
def html_to_text_q(spark, d):
    return pages(spark, d).select("page_id", F.md5(html_to_text("html").cast("binary")).alias("text_md5"))


@query(
    "script_bodies",
    """select page_id, cast(len(b) as integer) as scripts, b[1] as first_script from (
      select page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) as b from pages)""",
)
def script_bodies_q(spark, d):
    b = script_bodies("html")
    return pages(spark, d).select("page_id", F.size(b).alias("scripts"), F.get(b, F.lit(0)).alias("first_script"))


@query(
    "embedded_json",
    """select page_id, case when page_id % 3 = 0 then '{"page":' || page_id || '}' end as data,
      case when page_id % 3 = 0 then cast(page_id as varchar) end as page from pages""",
)
def embedded_json_q(spark, d):
    data = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json"> {"page":'), F.col("page_id").cast("string"), F.lit("} </script></body>"))
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", data)).otherwise(F.col("html"))
    made = pages(spark, d).select("page_id", embedded_json(html).alias("data"))
    return made.withColumn("page", F.get_json_object("data", "$.page"))


@query(
    "extract_fields",
    f"""select page_id, {_plain(f"regexp_extract({_BODY}, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
      {_plain(f"regexp_extract({_BODY}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as heading,
      nullif(regexp_extract({_BODY}, '(?is)<a [^>]*href="([^"]*)"', 1), '') as first_link,
      {_plain(f"regexp_extract({_BODY}, '(?is)<div class=.ad.>(.*?)</div>', 1)")} as ad from pages""",
)
def extract_fields_q(spark, d):
    rules = {"title": "title", "heading": "h1", "first_link": {"selector": "a", "attr": "href"}, "ad": "div.ad"}
    return pages(spark, d).select("page_id", *extract_fields("html", rules))


@query(
    "extract_links",
    f"""select page_id, cast(len(l) as integer) as links, array_to_string(list_sort(l), ' ') as joined from (
      select page_id, list_distinct(list_transform(regexp_extract_all({_BODY}, '<a [^>]*href="([^"]*)"', 1), lambda x: 'https://x' || x)) as l from pages)""",
)
def extract_links_q(spark, d):
    links = extract_field("html", {"selector": "a", "attr": "href", "multiple": True, "prefix": "https://x"})
    return pages(spark, d).select("page_id", F.size(links).alias("links"), F.array_join(F.array_sort(links), " ").alias("joined"))


@query(
    "parse_fields",
    f"""select page_id, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
      cast(len(list_distinct(regexp_extract_all({_BODY}, '<li><a href="([^"]*)"', 1))) as integer) as nav_links from pages""",
)
def parse_fields_q(spark, d):
    rules = {"title": "head title", "nav": {"selector": "nav ul a", "attr": "href", "multiple": True}}
    made = pages(spark, d).select("page_id", parse_fields("html", rules).alias("m"))
    return made.select("page_id", finish_field(F.col("m")["title"], rules["title"]).alias("title"),
                       F.size(finish_field(F.col("m")["nav"], rules["nav"])).alias("nav_links"))


@query(
    "url_clean",
    """select page_id, string_split(url, '?')[1] as clean, 'https://www.shop.example' || regexp_replace(string_split(url, '?')[1], '^https?://[^/]*', '') as absolute,
      url as kept, 'https://shop.example/find/' || page_id || '?q=' || coalesce(case when page_id % 2 = 0 then 'x' || page_id end, '') as filled from pages""",
)
def url_clean_q(spark, d):
    path = F.regexp_replace(strip_query("url"), "^https?://[^/]*", "")
    code = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string")))
    return pages(spark, d).select(
        "page_id", strip_query("url").alias("clean"), absolute_url(path, "https://www.shop.example").alias("absolute"),
        absolute_url("url", "https://www.shop.example").alias("kept"),
        url_template("https://shop.example/find/{{page}}?q={{ code }}", page="page_id", code=code).alias("filled"))


@query(
    "lookup_record",
    """select p_partkey, case when p_partkey % 7 = 0 then null else p_name end as title, case when p_partkey % 7 = 0 then null else p_brand end as brand,
      case when p_partkey % 7 = 0 then null else p_type end as category from part""",
)
def lookup_record_q(spark, d):
    key = F.col("p_partkey")
    record = F.to_json(F.struct(
        F.when(key % 7 != 0, F.col("p_name")).alias("name"), F.lit(" ").alias("brand"), F.col("p_brand").alias("brand_name"), F.col("p_type").alias("department")))
    shape = (
        F.when(key % 5 == 0, F.concat(F.lit("["), record, F.lit("]")))
        .when(key % 5 == 1, F.concat(F.lit('{"data":['), record, F.lit(',{"name":"other"}]}')))
        .when(key % 5 == 2, F.concat(F.lit('{"data":[],"items":['), record, F.lit("]}")))
        .when(key % 5 == 3, F.concat(F.lit('{"rows":['), record, F.lit("]}")))
        .otherwise(record)
    )
    made = v.table(spark, d, "part").select("p_partkey", lookup_record(shape).alias("r"))
    return made.select("p_partkey", F.col("r.title").alias("title"), F.col("r.marca").alias("brand"), F.col("r.categoria").alias("category"))


@query(
    "search_hit",
    """select page_id, case when page_id % 4 <> 0 then 'Page ' || page_id end as name, case when page_id % 4 <> 0 then string_split(url, '?')[1] end as url,
      case when page_id % 4 <> 0 then 'Health' end as department, case when page_id % 4 <> 0 then 'Pain' end as category,
      case when page_id % 4 <> 0 then case when page_id % 2 = 0 then 'Gel' end end as subcategory from pages""",
)
def search_hit_q(spark, d):
    key = F.col("page_id")
    name = lambda n: F.struct(n.alias("name"))
    product = F.struct(
        F.when(key % 4 != 0, F.concat(F.lit(" Page "), key.cast("string"))).alias("name"), F.col("url").alias("url"),
        F.array(name(F.lit("Health")), name(F.lit(" ")), name(F.lit("Pain")), name(F.when(key % 2 == 0, "Gel"))).alias("categories"))
    props = F.struct(F.struct(F.array(product).alias("products")).alias("results"))
    flat = F.to_json(F.struct(F.struct(props.alias("pageProps")).alias("props")))
    nested = F.to_json(F.struct(F.struct(F.struct(props.alias("pageProps")).alias("pageProps")).alias("props")))
    page = F.when(key % 3 == 0, nested).otherwise(flat)
    made = pages(spark, d).select("page_id", search_hit(page, "https://www.shop.example").alias("r"))
    return made.select("page_id", F.col("r.nome").alias("name"), "r.url", F.col("r.departamento").alias("department"),
                       F.col("r.categoria").alias("category"), F.col("r.subcategoria").alias("subcategory"))


@query(
    "product_detail",
    """select p_partkey, p_name || ' 20 comp' as produto, '20' as qtde_fs, 'comprimidos' as unidade, p_brand as laboratorio,
      'Health' as departamento, p_type as categoria, case when p_partkey % 2 = 0 then 'Zinco' else 'Ferro, Creatina' end as ingrediente_ativo,
      cast(case when p_partkey % 2 = 0 then 1 else 2 end as integer) as drugs, p_size || ' mg' as dose from part""",
)
def product_detail_q(spark, d):
    key = F.col("p_partkey")
    value = lambda code, text: F.struct(F.lit(code).alias("attribute_code"), F.array(F.lit(" "), text).alias("value_string"),
                                        F.array(F.struct(text.alias("label"))).alias("value"))
    product = F.struct(
        F.concat("p_name", F.lit(" 20 comp")).alias("name"),
        F.array(F.struct(F.lit("Health").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("breadcrumb"),
        F.array(
            value("marca", F.col("p_brand")), value("dosagem", F.concat(F.col("p_size").cast("string"), F.lit(" mg"))),
            value("principioativonovo", F.when(key % 2 == 0, "Zinco").otherwise(" ")),
            value("description", F.lit("<p>com ferro<br>e creatina</p>")),
        ).alias("custom_attributes"))
    page = F.to_json(F.struct(F.struct(F.struct(product.alias("productData")).alias("pageProps")).alias("props")))
    made = v.table(spark, d, "part").select("p_partkey", product_detail(page)["info"].alias("i"))
    names = ["produto", "qtde_fs", "unidade", "laboratorio", "departamento", "categoria", "ingrediente_ativo", "dose"]
    return made.select("p_partkey", *[f"i.{n}" for n in names], F.size("i.farmacos").alias("drugs"))


SCRAPE = {
    "key": "pages", "baseUrl": "https://www.shop.example",
    "selectors": {
        "resultName": "h1", "resultLink": {"selector": "a", "attr": "href"},
        "detailName": "title", "detailClass": {"selector": "title", "regex": "^(\\S+)"},
        "detailActiveIngredients": {"selector": "li", "multiple": True},
    },
}


@query(
    "scrape_config",
    f"""select page_id, {_plain(f"regexp_extract({_BODY}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as name,
      'https://www.shop.example' || nullif(regexp_extract({_BODY}, '(?is)<a [^>]*href="([^"]*)"', 1), '') as url,
      {_plain(f"regexp_extract({_BODY}, '(?is)<title[^>]*>(.*?)</title>', 1)")} as product,
      string_split({_plain(f"regexp_extract({_BODY}, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ' ')[1] as class,
      cast(len(list_distinct(regexp_extract_all({_BODY}, '(?is)<li[^>]*>(.*?)</li>', 1))) as integer) as drugs from pages""",
)
def scrape_config_q(spark, d):
    p = pages(spark, d)
    found = scrape_results(p, SCRAPE, "page_id").join(scrape_details(p, SCRAPE, "page_id"), "page_id")
    return found.select(
        "page_id", F.col("result.nome").alias("name"), F.col("result.url").alias("url"), F.col("detail.info.produto").alias("product"),
        F.col("detail.info.classe").alias("class"), F.size("detail.info.farmacos").alias("drugs"))


SCOPED = {
    "key": "cards", "baseUrl": "https://www.shop.example", "detail": {"urlTemplate": "{{baseUrl}}/d?to={{href}}"},
    "selectors": {
        "resultItem": ".product-card", "resultLink": {"selector": "a", "attr": "href"}, "resultName": ".product-title",
        "resultPresentation": ".facts > li:last-child",
    },
}


@query(
    "scrape_scope",
    """select page_id, case when page_id % 5 <> 0 then 'T ' || page_id || ' café & co' end as name,
      case when page_id % 5 <> 0 then 'b' || page_id end as presentation,
      case when page_id % 5 <> 0 then 'https://www.shop.example/d?to=/p/' || page_id || '?x=1' end as url from pages""",
)
def scrape_scope_q(spark, d):
    number = F.col("page_id").cast("string")
    # every fifth page has no card; the others have a like-named heading before it, nested text and entities in it
    box = F.when(F.col("page_id") % 5 == 0, '<div class="other">').otherwise('<div class="x product-card">')
    card = F.concat(
        F.lit('<h1 class="product-title">head</h1>'), box, F.lit('<a href="/p/'), number,
        F.lit('?x=1">Ver</a><div class="product-title">T<div> '), number,
        F.lit('</div> caf&eacute; &#38; co</div><ul class="facts"><li>a<li>b'), number, F.lit("</ul></div>"), F.col("html"))
    found = scrape_results(pages(spark, d).select("page_id", card.alias("html")), SCOPED, "page_id")
    return found.select("page_id", F.col("result.nome").alias("name"), F.col("result.apresentacao").alias("presentation"),
                        F.col("result.url").alias("url"))


# -- nested feeds built from the tables ----------------------------------------------------


@query(
    "normalize_erp_a",
    """select cast(p_partkey as varchar) as ean, p_name as received_name, p_type as category, p_brand as laboratory, cast(p_size as varchar) as quantity,
      'erp_a' as source from part""",
)
def normalize_erp_a_q(spark, d):
    p = v.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("gtin"), F.lit(" ").alias("codigoBarras"), F.col("p_name").alias("nomeProduto"), F.lit("").alias("nomeEcommerce"),
        F.col("p_type").alias("categoria"), F.col("p_brand").alias("marca"), F.col("p_size").alias("estoque"))
    return normalize_erp_a(p).select("ean", "received_name", "raw.category", "raw.laboratory", "raw.quantity", "source")


@query(
    "normalize_erp_b",
    """select cast(p_partkey as varchar) as ean, p_name as received_name, p_type as grp, p_brand as laboratory, cast(p_size as varchar) as quantity
      from part where p_partkey % 3 <> 0""",
)
def normalize_erp_b_q(spark, d):
    p = v.table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey").cast("string")).otherwise("").alias("codigoBarras"), F.col("p_name").alias("descricao"),
        F.lit(None).cast("string").alias("descricaoUsual"), F.col("p_type").alias("nomeLinha"), F.col("p_brand").alias("nomeMarca"), F.col("p_size").alias("qtdEstoque"))
    return normalize_erp_b(p).select("ean", "received_name", F.col("raw.group").alias("grp"), "raw.laboratory", "raw.quantity")


@query(
    "normalize_ecommerce",
    """select cast(p_partkey as varchar) as ean, p_name as received_name, p_type as category, p_brand as brand, 'R' || p_size as registration,
      case when p_partkey % 2 = 0 then 'drug' end as stated_ingredient from part where p_partkey % 5 <> 0""",
)
def normalize_ecommerce_q(spark, d):
    key = F.col("p_partkey")
    spec = lambda name, value: F.struct(F.lit(name).alias("FieldName"), F.array(F.lit(""), value).alias("FieldValues"))
    p = v.table(spark, d, "part").select(
        F.struct(F.when(key % 3 == 0, key.cast("string")).otherwise("null").alias("Ean")).alias("AlternateIds"),
        F.when(key % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(key.cast("string"))).alias("AlternateIdValues"),
        F.col("p_name").alias("ProductName"), F.lit("").alias("NameComplete"),
        F.create_map(F.lit("1"), F.lit("first"), F.lit("2"), F.col("p_type")).alias("ProductCategories"), F.col("p_brand").alias("BrandName"),
        F.array(spec("RMS", F.concat(F.lit("R"), F.col("p_size").cast("string"))), spec(" Principio Ativo", F.when(key % 2 == 0, "drug"))).alias("ProductSpecifications"),
        key.alias("k"),
    ).filter((key % 3 != 0) | (key % 5 != 0)).drop("k")
    return normalize_ecommerce(p).select("ean", "received_name", "raw.category", "raw.brand", "raw.registration", "raw.stated_ingredient")


# all references in the pages; the tests hold others
_REFERENCES = [("&middot;", "·"), ("&copy;", "©"), *_ENTITIES]


@query("unescape", "select page_id, md5(" + "".join("replace(" for _ in _REFERENCES) + "html" + "".join(f", '{e}', '{c}')" for e, c in _REFERENCES) + ") as plain from pages")
def unescape_q(spark, d):
    return pages(spark, d).select("page_id", F.md5(unescape("html").cast("binary")).alias("plain"))
