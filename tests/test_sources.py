"""Files, feeds, sinks and registries."""

import json

import pytest
from pyspark.sql import functions as F

from catalogkit.operators.taxonomy import classify_taxonomy
from catalogkit.plans.catalog import lookup_eans, lookup_summary, upsert_catalog
from catalogkit.plans.enrich import enrich_items, product_snapshot
from catalogkit.operators.policy import SourcePolicy
from catalogkit.operators.dedupe import newest_snapshot_wins
from catalogkit.operators.waterfall import ask_in_turn, lookup_waterfall, register_lookups, staged_waterfall
from catalogkit.sinks.files import export_csv, write_snapshot
from catalogkit.sinks.publish import batch_body, publish, publish_payload, replay
from catalogkit.sources.files import read_items_csv, read_items_json, read_products_payload, read_taxonomy
from catalogkit.sources.normalize import default_sources, normalize_ecommerce, normalize_erp_a, normalize_erp_b


def test_items_csv(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('﻿id,codigobarras,descricao\n81261, 7893736007527 ,"ACETICIL 100MG, ENV"\n\n81281,NULL,OUTRO\n', encoding="utf-8")
    rows = read_items_csv(spark, str(path)).orderBy("received_name").collect()
    assert [(r.ean, r.received_name, r.source) for r in rows] == [("7893736007527", "ACETICIL 100MG, ENV", "csv"), (None, "OUTRO", "csv")]
    assert json.loads(rows[0].raw)["id"] == "81261"


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"items": x}])
def test_items_json(spark, tmp_path, wrap):
    path = tmp_path / "items.json"
    path.write_text(json.dumps(wrap([{"ean": "1", "nome": "A"}, {"ean": "2", "nome_recebido": "B", "nome": "C"}])))
    rows = read_items_json(spark, str(path)).orderBy("ean").collect()
    assert [(r.ean, r.received_name) for r in rows] == [("1", "A"), ("2", "B")]


@pytest.mark.parametrize("payload,count", [
    ([{"ean": "1", "descricaoProduto": "A"}], 1), ({"products": [{"ean": "1", "description": "A"}, {"ean": "2", "description": "B"}]}, 2),
    ({"produtos": [{"ean": "1", "descricaoProduto": "A"}], "options": {"x": 1}}, 1), ({"ean": "1", "descricaoProduto": "A"}, 1)])
def test_products_payload(spark, tmp_path, payload, count):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(payload))
    assert read_products_payload(spark, str(path)).filter("ean is not null").count() == count


def test_products_payload_rejects(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"other": 1}')
    with pytest.raises(ValueError):
        read_products_payload(spark, str(path))


def test_taxonomy_file(spark, tmp_path):
    path = tmp_path / "tree.csv"
    path.write_text(
        "Departamento;Categoria;Subcategoria;Segmento;Subsegmento;Qtd_Codigos_Barras\n"
        "Medicamentos;Dor e Febre;Analgésicos;Analgésicos;Dipirona;30\n"
        "Higiene;Banho;;;;abc\n", encoding="utf-8")
    tree = read_taxonomy(spark, str(path))
    rows = tree.orderBy("entry_no").collect()
    assert [(r.taxonomy_id, r.path, r.item_count) for r in rows] == [
        ("taxonomy_1", "Medicamentos > Dor e Febre > Analgésicos > Analgésicos > Dipirona", 30), ("taxonomy_2", "Higiene > Banho", 0)]
    items = spark.createDataFrame(
        [("1", "MEDICAMENTOS", "dor e febre", "analgesicos", "Analgésicos", "dipirona", ""), ("2", None, None, None, None, None, "sabonete de banho")],
        "ean string, department string, category string, subcategory string, segment string, subsegment string, words string")
    placed = {r.ean: r for r in classify_taxonomy(items, tree, "words").collect()}
    assert placed["1"].taxonomy.source == "existing_exact_match" and placed["1"].taxonomy.confidence == 1.0
    assert placed["2"].taxonomy.source == "heuristic" and placed["2"].selected_id == "taxonomy_2" and placed["2"].taxonomy.confidence == 0.35


def test_erp_feeds(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text("\n".join(json.dumps(x) for x in [
        {"codigo": 7, "codigoBarras": "", "ean": "789", "nomeProduto": "Prod", "nomeEcommerce": " Prod web ", "tarja": "V"}, {"codigo": 8, "nome": "Sem codigo"}]))
    a = normalize_erp_a(spark.read.json(str(path))).orderBy("raw.code").collect()
    assert [(r.ean, r.received_name, r.raw.code) for r in a] == [("789", " Prod web ", "7"), (None, "Sem codigo", "8")]
    path.write_text("\n".join(json.dumps(x) for x in [
        {"cdProduto": "1", "codigoBarras": "789", "descricao": "D", "descricaoUsual": "U", "corReceita": "azul", "qtdEstoque": 3.0}, {"cdProduto": "2", "descricao": "X"}]))
    b = normalize_erp_b(spark.read.json(str(path))).collect()
    assert [(r.ean, r.received_name, r.raw.description, r.raw.control_label) for r in b] == [("789", "U", "D", "azul")]


def test_ecommerce_feed(spark, tmp_path):
    path = tmp_path / "sku.json"
    path.write_text(json.dumps({
        "Id": 1, "ProductId": 2, "NameComplete": "Nome completo", "ProductName": "Nome", "BrandName": "Marca", "AlternateIds": {"Ean": "789", "RefId": "R"},
        "AlternateIdValues": ["999"], "Categories": ["/a/", "/b/"], "ProductSpecifications": [{"FieldName": "Princípio Ativo", "FieldValues": [" ", "Dipirona"]}]}))
    row = normalize_ecommerce(spark.read.json(str(path))).first()
    assert (row.ean, row.received_name, row.raw.category, row.raw.stated_ingredient, row.raw.ref_id) == ("789", "Nome completo", "/b/", "Dipirona", "R")
    assert default_sources().names() == ["erp_a", "erp_b", "ecommerce", "client_table"]
    with pytest.raises(KeyError):
        default_sources().normalize("nothing", spark.range(1))


LOOKUP = "ean string, source_key string, result struct<nome:string>, detail struct<info:struct<produto:string,farmacos:array<struct<farmaco:string,slug:string>>>>, error string"


def test_waterfall_and_enrichment(spark):
    rules = SourcePolicy(trusted=["one", "two"], pass_through=["shop"])
    lookups = spark.createDataFrame([
        ("a", "one", None, None, "boom"), ("a", "two", ("Nome A",), (("Prod A", [("Dipirona", None), (" ", None)]),), None),
        ("b", "three", ("Nome B",), None, None)], LOOKUP)
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "ean string")
    order = ["one", "two", "three"]
    water = lookup_waterfall(keys, lookups, order)
    rows = {r.ean: r for r in water.collect()}
    assert len(rows) == 4 and rows["a"].resolved_by == "two" and rows["b"].resolved_by == "three" and rows["c"].resolved_by is None
    assert [(x.skipped, x.skip_reason) for x in rows["a"].lookups] == [(False, None), (False, None), (True, "resolved_by_two")]
    items = spark.createDataFrame([("a", "x", "csv"), ("b", "y", "csv"), ("c", "Pass", "SHOP"), ("d", None, "shop")], "ean string, received_name string, source string")
    done = {r.ean: r for r in enrich_items(items, water, order, rules).collect()}
    assert not done["a"].requires_approval and done["a"].product.name == "Nome A" and done["a"].product.ingredients[0].slug == "dipirona"
    assert done["b"].requires_approval and done["b"].approval_reason == "Nome nao resolvido por One ou Two."
    assert not done["c"].requires_approval and done["c"].pass_through_source == "shop"
    assert done["d"].requires_approval and done["d"].approval_reason == "One sem resultado. Two sem resultado. Three sem resultado."
    final = {r.ean: r for r in product_snapshot(enrich_items(items, water, order, rules), rules).collect()}
    assert final["a"].active_ingredient == "Dipirona" and final["a"].reject_reason is None
    assert final["b"].social_name is None and final["b"].reject_reason.startswith("Nome do produto nao foi validado por")
    assert final["c"].social_name == "Pass"
    assert json.loads(final["a"].details)["estrutura_final"]["principio_ativo"] == ["Dipirona"]


def test_sources_asked_in_turn(spark):
    order = ["one", "two", "three"]
    hit = lambda n: (f"Nome {n}",)
    rows = [(str(n), "one", hit(n) if n < 60 else None, None, None if n < 60 else "boom") for n in range(100)]
    rows += [(str(n), "one", None, None, "late") for n in range(30)]  # a second answer without a hit
    rows += [(str(n), "two", hit(n), None, None) for n in range(90)]
    rows += [(str(n), "three", None, (("Prod", None),), None) for n in range(0, 200, 2)] + [(None, "two", ("x",), None, None)]
    lookups = spark.createDataFrame(rows, LOOKUP)
    keys = spark.createDataFrame([(str(n),) for n in range(100)] * 2 + [(None,), ("missing",)], "ean string")
    tables = {s: lookups.filter(F.col("source_key") == s) for s in order}
    want = lookup_waterfall(keys, lookups, order)
    got = staged_waterfall(keys, tables, order)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # each source is asked only for what is left: 100 keys, a null and an unknown one, then 42, then 12
    asked = ask_in_turn(keys, tables, order)
    assert [r["count"] for r in asked.groupBy("priority").count().orderBy("priority").collect()] == [102, 42, 12]
    # nothing left, nothing asked; and empty tables
    known = keys.filter("try_cast(ean as int) < 50")
    assert ask_in_turn(known, tables, order).select("priority").distinct().count() == 1
    assert staged_waterfall(keys.limit(0), tables, order).count() == 0
    empty = {s: lookups.limit(0) for s in order}
    assert {r.resolved_by for r in staged_waterfall(keys, empty, order).collect()} == {None}
    with pytest.raises(ValueError):
        ask_in_turn(keys, {"one": lookups}, order)


def test_lookup_eans_order(spark):
    asked = spark.createDataFrame([(0, "78912345"), (1, "78912346"), (2, "78912345"), (3, "78912347")], "n int, ean string")
    catalog = spark.createDataFrame([("78912345", "A"), ("78912346", "B")], "ean string, description string")
    answers = lookup_eans(asked, catalog, "n")
    assert [r.ean for r in answers.filter("found").orderBy("first_position").collect()] == ["78912345", "78912346"]
    assert tuple(lookup_summary(answers).first()) == (3, 2, 1)


def test_export_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("2", 'say "hi", ok', None), ("1", "line\nbreak", "x")], "ean string, description string, note string")
    export_csv(df, str(tmp_path / "out"), "ean", single_file=True)
    body = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert body == '﻿ean,description,note\n1,"line\nbreak",x\n2,"say ""hi"", ok",\n'
    write_snapshot(df, str(tmp_path / "catalog"))
    assert spark.read.parquet(str(tmp_path / "catalog")).count() == 2
    with pytest.raises(Exception, match="exists"):
        write_snapshot(df, str(tmp_path / "catalog"))


def test_registered_priorities_decide(spark):
    kind = "ean string, result struct<name:string>, detail struct<info:string>, error string"
    answer = lambda name: spark.createDataFrame([("1", (name,), None, None), ("1", None, None, "late"), ("2", None, None, "down")], kind)
    merged, order = register_lookups({"a": (answer("from a"), 5), "b": (answer("from b"), 0)})
    assert order == ["b", "a"]
    rows = {r.ean: r for r in lookup_waterfall(spark.createDataFrame([("1",), ("2",)], "ean string"), merged, order).collect()}
    assert rows["1"].resolved_by == "b" and rows["1"].lookups[0].result.name == "from b"
    assert rows["2"].resolved_by is None and rows["2"].lookups[1].error == "down"


def test_repeated_codes_need_a_position(spark):
    old = spark.createDataFrame([("1", "x", 0, 0)], "ean string, name string, created_at int, updated_at int")
    new = spark.createDataFrame([("1", "y", 0), ("1", "z", 1)], "ean string, name string, at int")
    got = upsert_catalog(old, new, F.lit(9), position="at").collect()
    assert [tuple(r) for r in got] == [("1", "z", 0, 9)]
    with pytest.raises(Exception, match="position is needed"):
        upsert_catalog(old, new, F.lit(9)).collect()


def test_newest_snapshot_ties(spark):
    rows = spark.createDataFrame([("1", "s2", 5), ("1", "s2", 3), ("1", "s1", 1)], "ean string, snapshot string, n int")
    assert newest_snapshot_wins(rows, "ean", "snapshot", tie=["n"]).first().n == 3


def test_publish_and_replay(spark, tmp_path):
    # local functions travel to the workers by value
    def refuse_two(body: str) -> None:
        if '"ean":"2"' in body:
            raise RuntimeError("down")

    def accept(body: str) -> None:
        pass

    assert batch_body(["{}"]) == "{}" and batch_body(["{}", "{}"]) == '{"products":[{},{}]}'
    rows = spark.createDataFrame([(i, str(i), f"d{i}", "") for i in range(25)], "item_id long, ean string, description string, manufacturer string").coalesce(1)
    payloads = publish_payload(rows)
    assert "fabricante" not in payloads.first().payload
    sent, dead = str(tmp_path / "sent"), str(tmp_path / "dead")
    publish(payloads, refuse_two, sent, dead, "item_id", size=10)
    failed = spark.read.parquet(dead)
    assert failed.count() + spark.read.parquet(sent).count() == 25
    assert 1 <= failed.count() <= 10 and {r.status for r in failed.collect()} == {"pending_replay"}
    after = replay(spark, dead, accept, sent, "item_id")
    assert {r.status for r in after.collect()} == {"replayed"}
    assert spark.read.parquet(sent).select("item_id").distinct().count() == 25
