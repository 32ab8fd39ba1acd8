"""Small fixed cases of the functions."""

import pytest
from pyspark.sql import functions as F

from catalogkit.functions import ean, html, packages, text, values, vectors
from catalogkit.operators import policy
from catalogkit.sources import lookups


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else list(row)


def test_ean_rules(spark):
    codes = ["7891058009458", "123", "78938878", "036000291452", "07891010503024", "789-1058 009458"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string")
    left = [r[0] for r in rows.select(ean.validate_ean("code")["is_valid"]).collect()]
    gs1 = [r[0] for r in rows.select(ean.validate_ean("code", "gs1")["is_valid"]).collect()]
    assert left == [True, False, False, False, False, True]
    assert gs1 == [True, False, True, True, True, True]
    assert one(spark, ean.validate_ean(F.lit("123"))["reason"]) == ean.REASON_LENGTH
    assert one(spark, ean.validate_ean(F.lit(None).cast("string"))["ean"]) == ""
    assert one(spark, ean.normalize_ean(F.lit("7891-2345"))["ean"]) == "78912345"
    assert one(spark, ean.exact_ean_from_query(F.lit("tylenol 789 12345"))) == "78912345"


def test_text_rules(spark):
    assert one(spark, text.normalize_text(F.lit(" Paracetamol + Códigoína! "))) == "paracetamol codigoina"
    assert one(spark, text.normalize_text(F.lit("été"))) == "ete"
    assert one(spark, text.strip_accents(F.lit("Ελλάδα ação"))) == "Ελλαδα acao"
    assert one(spark, text.tokenize(F.lit("um dois tres"), 2)) == ["um", "dois"]
    product = "Neutrofer 250mg/ml Suspensao Gotas 30ml"
    assert one(spark, text.tokenize(F.lit(product))) == "neutrofer 250 mg ml suspensao gotas 30 ml".split()
    assert one(spark, text.normalize_search_text(F.lit("1a2B3"))) == "1 a 2 b 3"
    assert one(spark, text.split_ingredients(F.lit("Dipirona, cafeína; Cafeina / zinco e ferro"))) == ["Dipirona", "cafeína", "zinco", "ferro"]
    lines = F.lit("\tzinco\u00a0;\n ferro ,Zinco")
    assert one(spark, text.split_ingredients(lines)) == ["zinco", "ferro"]
    assert one(spark, text.split_ingredients(lines, text.SPACES)) == ["\tzinco", "\n ferro"]
    assert one(spark, text.unique_in_order(F.lit(["b", "A", "a ", "B", " ", "c"]))) == ["b", "A", "c"]
    assert one(spark, text.slugify(F.lit("Ácido Fólico 5mg"))) == "acido-folico-5mg"
    assert one(spark, text.summarize_text(F.lit("a  b " * 60), 20)) == "a b a b a b a b a..."
    assert one(spark, text.searchable_text(F.lit("d"), F.lit("i"), F.lit(""), F.lit("c"))) == "d i d i c"


def test_fuzzy_rules(spark):
    pairs = [("dirpirona", "dipirona", True), ("cerveja", "cafe", False), ("paracetamoll", "paracetmol", True), ("12345", "12346", False), ("abc", "abd", False)]
    rows = spark.createDataFrame(pairs, "q string, t string, want boolean")
    got = rows.select(text.fuzzy_equal("q", "t").alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


def test_value_rules(spark):
    assert one(spark, values.first_non_blank(F.lit(" null "), F.lit(" "), F.lit(" x "), null_token="NULL")) == "x"
    assert one(spark, values.first_non_blank(F.lit(" "), F.lit(" x "), trimmed=False)) == " x "
    assert one(spark, values.first_text(F.lit("\t\n"), F.lit(" x "))) == "x"
    assert one(spark, values.first_finite(F.lit("abc"), F.lit(""), F.lit("NaN"), F.lit("4.5"))) == 4.5
    assert one(spark, values.effective_promo(F.lit(10.0), F.lit(12.0))) is None
    assert one(spark, values.discount_pct(F.lit(10.0), F.lit(7.5))) == 25.0
    assert one(spark, values.format_stock(F.lit("x"))) == "0.0000"
    assert one(spark, values.parse_list_input(F.lit("1, 2;;3\n 4 "))) == ["1", "2", "3", "4"]
    assert one(spark, F.to_json(F.struct(values.json_parse_or_keep(F.lit('a "b"\n')).alias("v")))) == '{"v":"a \\"b\\"\\n"}'


def test_package_rules(spark):
    assert one(spark, packages.extract_dose(F.lit("Xarope 500mg/5ml  + 30 mg frasco"))) == "500mg/5ml + 30 mg"
    assert one(spark, packages.extract_dose(F.lit("a" * 150 + " 500mg       tab"))) is not None
    assert one(spark, packages.extract_dose(F.lit("a" * 160 + " 500mg"), 160)) is None
    assert one(spark, packages.extract_dose(F.lit("a" * 160 + " 500mg"))) == "500mg"
    got = one(spark, packages.extract_package(F.lit("sem"), F.lit("Caixa 30 Comp 500mg")))
    assert (got["quantity"], got["unit"]) == ("30", "comprimidos")
    assert one(spark, packages.infer_terms(F.lit("Vitamina D3 com CÁLCIO e zinco"))) == ["Vitamina D3", "Cálcio", "Zinco"]
    records = one(spark, packages.ingredient_records(F.lit(["Ácido Fólico", " ", "Ferro"])))
    assert [r["slug"] for r in records] == ["acido-folico", "ferro"]


def test_vectors(spark):
    hashed = one(spark, vectors.hash_vector(F.lit(["dipirona", "500", "mg", "mg"]), 8))
    assert len(hashed) == 8 and abs(sum(x * x for x in hashed) - 1) < 1e-9
    assert one(spark, vectors.hash_vector(F.array().cast("array<string>"), 8)) == [0.0] * 8
    value = 2166136261
    for char in "dipirona":
        value = ((value ^ ord(char)) * 16777619) % 2**32
    assert one(spark, vectors.fnv1a32(F.lit("dipirona"))) == value
    assert round(one(spark, vectors.cosine_similarity(F.lit([1.0, 2.0]), F.lit([1.0, 3.0]))), 6) == 0.989949


def test_policy(spark):
    rules = policy.SourcePolicy(trusted=["a", "b-site"], pass_through=["feed"], labels={"a": "Alpha"})
    assert one(spark, rules.fixed_list_text(["a", "b-site", "zz"])) == "Alpha, B Site ou Zz"
    assert one(spark, rules.fixed_list_text([])) == policy.NO_SOURCES
    assert one(spark, rules.list_text(F.lit(["a", "b-site", "A", "zz"]))) == "Alpha, B Site ou Zz"
    assert one(spark, rules.label(F.lit(""))) == policy.UNKNOWN_SOURCE
    name = F.lit("Preservativo Lubrificado 3 un")
    none = F.lit(None).cast("string")
    assert one(spark, policy.classify_type([name], F.lit("medicamento"), none)) == "perfumaria"
    assert one(spark, policy.classify_type([F.lit("Dipirona")], F.lit("Medicamentos"), none)) == "medicamento"
    assert one(spark, policy.normalize_type(F.lit("Dermocosméticos"))) == "perfumaria"


def test_html(spark):
    page = '<html><head><title> A &amp; B </title></head><body><div id="m" class="x main">t<b>u</b></div><!-- <h1>no</h1> --><a class="k" href="/p?q=1">go</a></body></html>'
    assert one(spark, html.extract_field(F.lit(page), "title")) == "A & B"
    assert one(spark, html.extract_field(F.lit(page), ".main")) == "tu"
    assert one(spark, html.extract_field(F.lit(page), "#m")) == "tu"
    assert one(spark, html.extract_field(F.lit(page), "h1")) is None
    assert one(spark, html.extract_field(F.lit(page), {"selector": "a.k", "attr": "href", "regex": "q=(\\d)", "prefix": "n"})) == "n1"
    assert one(spark, html.absolute_url(F.lit("p/1"), "https://shop.example/a/b")) == "https://shop.example/a/p/1"
    assert one(spark, html.html_to_text(F.lit("<ul><li>a</li><li>b<br>c&nbsp;</li></ul>"))) == "- a - b c"
    assert one(spark, html.embedded_json(F.lit('<script id="__NEXT_DATA__" type="application/json">{"a":1}</script>'))) == '{"a":1}'
    assert one(spark, html.embedded_json(F.lit("<p>"))) is None


def test_references_without_a_semicolon_stay(spark):
    page = ('<title>les&amp;&amp</title><h1>R&D &copy2 &notit; &amp;lt; &#38; &eacute;</h1><a href="/p?a=1&copy=2&amp;b=3">go&</a>'
            "<script>if (a && b) '&amp'</script><p>\ufdd0&lt</p>")
    fields = {"title": "title", "heading": "h1", "link": {"selector": "a", "attr": "href"}, "text": "a", "script": "script", "mark": "p"}
    assert one(spark, *html.extract_fields(F.lit(page), fields)) == [
        "les&&amp", "R&D &copy2 &notit; &lt; & é", "/p?a=1&copy=2&b=3", "go&", "if (a && b) '&amp'", "\ufdd0&lt"]


PAGE = """<div class="ad">a<div>b</div>c</div><ul id=u><li>one<li class="x y" data-k='v-1'>two &eacute;&#33;</li><li>three</ul>
<p>p1<p>p2 <br> more<table><tr><td>1<td>2<tr><td>3</table><script>var a = "<b>";</script>"""


@pytest.mark.parametrize("selector,want", [
    ("div.ad", ["abc"]), ("div > div", ["b"]), ("ul li", ["one", "two é!", "three"]), ("#u > li:first-child", ["one"]),
    ("li:last-child", ["three"]), ("li:nth-child(2)", ["two é!"]), ("li:nth-child(odd)", ["one", "three"]), ("li:nth-child(-n+2)", ["one", "two é!"]),
    ("li.x.y", ["two é!"]), ("[data-k]", ["two é!"]), ("li[data-k=v-1]", ["two é!"]), ("[data-k^='v']", ["two é!"]), ('[data-k$="2"]', []),
    ("[data-k|=v]", ["two é!"]), ("p", ["p1", "p2 more"]), ("tr:nth-child(1) td", ["1", "2"]), ("div div, #u .x", ["b", "two é!"]), ("h1", []), ("ul > td", []),
    ("* > li:only-child", []),
])
def test_selectors(spark, selector, want):
    assert one(spark, html.extract_field(F.lit(PAGE), {"selector": selector, "multiple": True})) == want
    assert one(spark, html.extract_field(F.lit(PAGE), selector)) == (want[0] if want else None)


def test_selector_rules(spark):
    for bad in ("", "a,", "a:hover", "a >", "~ b", "li:nth-child(x)"):
        with pytest.raises(ValueError):
            html.parse_selector(bad)
    rule = {"selector": "li", "regex": "^O(.)", "regexFlags": "gi", "suffix": "!"}
    assert one(spark, html.extract_field(F.lit(PAGE), rule)) == "n!"
    assert one(spark, html.extract_field(F.lit(PAGE), "li", ".none")) is None
    assert one(spark, html.extract_field(F.lit(PAGE), "li", "#u")) == "one"
    assert one(spark, html.extract_field(F.lit(None).cast("string"), "li")) is None


def test_scrape_configuration(spark):
    """A search page with its card and a product page, read by one configuration."""
    config = {
        "key": "site", "baseUrl": "https://site.example", "detail": {"urlTemplate": "{{href}}"},
        "selectors": {
            "resultItem": ".product-card", "resultLink": {"selector": "a", "attr": "href"}, "resultName": ".product-title",
            "resultPresentation": ".product-presentation", "resultBrand": ".product-brand", "detailName": "h1",
            "detailPresentation": ".presentation", "detailBrand": ".brand", "detailCategory": ".category",
            "detailRegistration": {"selector": ".registro", "regex": "([0-9]{6,})"},
            "detailActiveIngredients": {"selector": ".ingredientes li", "multiple": True},
        },
    }
    search = """<h1 class="product-title">head</h1><div class="product-card"><a href="https://site.example/produto/123">Ver</a>
      <div class="product-title">Dorflex</div><div class="product-presentation">36 comprimidos</div><div class="product-brand">Opella</div></div>"""
    product = """<h1>Dorflex</h1><div class="presentation">36 comprimidos</div><div class="brand">Opella</div><div class="category">Analgesico</div>
      <div class="registro">Registro MS 1862000080116</div><ul class="ingredientes"><li>Dipirona Monoidratada</li><li>Cafeina</li></ul>"""
    pages = spark.createDataFrame([("1", search, product), ("2", "<p>nothing</p>", "")], "ean string, search string, product string")
    found = {r.ean: r.result for r in lookups.scrape_results(pages, config, html="search").collect()}
    assert found["2"] is None and (found["1"].nome, found["1"].apresentacao, found["1"].laboratorio, found["1"].url) == (
        "Dorflex", "36 comprimidos", "Opella", "https://site.example/produto/123")
    info = lookups.scrape_details(pages, config, html="product").filter("ean = '1'").first().detail.info
    assert (info.produto, info.apresentacao, info.categoria, info.registro) == ("Dorflex", "36 comprimidos", "Analgesico", "1862000080116")
    assert [f.farmaco for f in info.farmacos] == ["Dipirona Monoidratada", "Cafeina"]


def test_character_references(spark):
    from catalogkit.functions.html import unescape

    texts = ["caf&eacute; &#233;&#xE9;", "a&nbsp;b &lt;i&gt; &amp;lt;", "R&D &unknown; ?a=1&copy=2", "", None, "&#39;&quot;&Alpha;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", unescape("text").alias("plain"))
    assert [r.plain for r in rows.orderBy("n").collect()] == ["café éé", "a b <i> &lt;", "R&D &unknown; ?a=1&copy=2", "", None, "'\"Α"]


def test_token_overlap_of_long_lists_takes_time_in_proportion(spark):
    import time

    rows = spark.createDataFrame([(1, ["a", "b", "a", None], ["a", None]), (2, None, ["a"]), (3, ["a"], None), (4, [], ["a"])],
                                 "id int, t array<string>, q array<string>")
    assert [r.n for r in rows.select("id", vectors.token_overlap("t", "q").alias("n")).orderBy("id").collect()] == [2, None, 0, 0]
    words = lambda tail: F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda n: F.concat(F.lit("w"), n.cast("string"), F.lit(tail)))
    long = spark.range(4, numPartitions=1).select(words("x").alias("t"), words("y").alias("q"))
    began = time.time()
    assert [r.n for r in long.select(vectors.token_overlap("t", "q").alias("n")).collect()] == [0] * 4
    assert time.time() - began < 10
