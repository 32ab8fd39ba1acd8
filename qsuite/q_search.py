"""Vector and word search over documents, embeddings and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogkit.functions.text import normalize_match_text, tokenize
from catalogkit.functions.vectors import cosine_similarity, hash_vector, ranking_score, token_overlap
from catalogkit.operators.aggregates import quality_by_category
from catalogkit.operators.fuzzy import match_token_pairs
from catalogkit.operators.ivf import build_ivf, vector_topk_ivf
from catalogkit.operators.postings import build_postings
from catalogkit.operators.topk import vector_topk
from catalogkit.plans.search import (
    apply_relevance,
    benchmark_match,
    hybrid_search,
    prepare_queries,
    reliable_filter,
)
from catalogkit.session import stored
from qsuite import views as v
from qsuite.q_text import COUNTS_SQL, HASH_DIMS
from qsuite.registry import query

# -- vectors over embeddings: every row asks for its neighbours ---------------------------------------------------------------


def embeddings(spark, d):
    return v.table(spark, d, "embeddings")


@query(
    "cosine_similarity",
    """select a.label, round(avg(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[]))), 6) as mean_similarity, count(*) as pairs
    from embeddings a join embeddings b on b.label = a.label and b.vec_id = a.vec_id + 10 group by a.label""",
)
def cosine_similarity_q(spark, d):
    a = embeddings(spark, d)
    b = a.select((F.col("vec_id") - 10).alias("vec_id"), "label", F.col("embedding").alias("other"))
    made = a.join(b, ["vec_id", "label"]).select("label", cosine_similarity("embedding", "other").alias("s"))
    return made.groupBy("label").agg(F.round(F.avg("s"), 6).alias("mean_similarity"), F.count("*").alias("pairs"))


TOPK_SQL = """sims as (select q.vec_id as query_id, c.vec_id as doc_id,
    round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 9) as s
  from embeddings q, embeddings c),
top as (select *, row_number() over (partition by query_id order by s desc, doc_id) as rk from sims)"""


def topk(spark, d, **options):
    e = embeddings(spark, d)
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return vector_topk(queries, corpus, 10, **options).withColumn("similarity", F.round("similarity", 6))


_TOP = "select query_id, doc_id, round(s, 6) as similarity, cast(rk as integer) as rank from top where rk <= 10"


@query("vector_topk", v.ctes(TOPK_SQL) + _TOP)
def vector_topk_q(spark, d):
    return topk(spark, d)


@query("vector_topk_blocks", v.ctes(TOPK_SQL) + _TOP)
def vector_topk_blocks_q(spark, d):
    return topk(spark, d, query_rows=150, corpus_rows=250)


@query("vector_topk_min_score", v.ctes(TOPK_SQL) + _TOP + " and s >= 0.5")
def vector_topk_min_q(spark, d):
    return topk(spark, d, min_score=0.5)


def ivf(spark, d, exact):
    """Every fiftieth row asks an index of all rows. The given vectors point nearly anywhere, so three lists in four are asked."""
    e = embeddings(spark, d)
    corpus = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    lists = max(8, round(corpus.count() ** 0.5))
    found = vector_topk_ivf(queries, build_ivf(corpus, lists), 10, probes=max(1, lists // 8) if exact else lists * 3 // 4, exact=exact)
    return found.withColumn("similarity", F.round("similarity", 6))


# an index is approximate, so SQL has no equal; tests/test_ivf.py holds it against the exact result
@query("vector_topk_ivf")
def vector_topk_ivf_q(spark, d):
    return ivf(spark, d, exact=False)


@query("vector_topk_ivf_exact", v.ctes(TOPK_SQL) + _TOP + " and query_id % 50 = 0")
def vector_topk_ivf_exact_q(spark, d):
    return ivf(spark, d, exact=True)


# -- hybrid search over documents ----------------------------------------------------------

# queries: every third one is a whole benchmark item; the others ask for its third word or the two from there, since short
# queries rank otherwise
CASE_FROM = "case item_id % 3 when 2 then 1 else 3 end"
CASE_TO = "case item_id % 3 when 0 then 3 when 1 then 4 else 100000000 end"
QUERIES_SQL = f"""queries as (select item_id as query_id, array_to_string(list_slice({v.sql_tokens('text')}, {CASE_FROM}, {CASE_TO}), ' ') as query,
    list_slice({v.sql_tokens('text')}, {CASE_FROM}, {CASE_TO}) as query_tokens from benchmark),
qtoks as (select query_id, unnest(query_tokens) as token from queries),
qcounts as (select query_id, token, count(*) as n from qtoks group by all),
qslots as (select query_id, h % {HASH_DIMS} as slot, sum(case when h % 2 = 0 then 1 else -1 end * (1 + ln(n))) as w
  from (select *, {v.sql_fnv('token')} as h from qcounts) group by all),
qvectors as (select query_id, slot, w / sqrt(sum(w * w) over (partition by query_id)) as weight from qslots),
corpus as (select doc_id, {v.sql_tokens('text')} as tokens from documents),
dots as (select q.query_id, x.doc_id, sum(q.weight * x.weight) as s from qvectors q join vectors x on x.slot = q.slot group by all),
scored as (select q.query_id, c.doc_id, round(coalesce(s, 0), 9) + 0.0 as similarity, len(q.query_tokens) <= 2 as is_short,
    len(list_filter(c.tokens, lambda t: list_contains(q.query_tokens, t))) as overlap, c.doc_id % 7 as recency
  from queries q cross join corpus c left join dots using (query_id, doc_id)),
ranked as (select *, row_number() over (partition by query_id order by case when is_short then overlap else 0 end desc, similarity desc,
    case when is_short then 0 else overlap end desc, recency desc, doc_id) as rk from scored)"""


def case_queries(spark, d):
    tokens = tokenize("text")
    words = F.when(F.col("item_id") % 3 == 0, F.slice(tokens, 3, 1)).when(F.col("item_id") % 3 == 1, F.slice(tokens, 3, 2))
    text = F.array_join(F.coalesce(words, tokens), " ")
    rows = v.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))
    return prepare_queries(rows, dims=HASH_DIMS)


def doc_corpus(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", "text", tokenize("text").alias("tokens"))
    return rows.select(
        "doc_id", "tokens", hash_vector("tokens", HASH_DIMS).alias("vector"), F.lit(None).cast("string").alias("ean"),
        (F.col("doc_id") % 7).alias("recency"))


_SEARCH_SQL = v.ctes(COUNTS_SQL, QUERIES_SQL)


@query(
    "hybrid_search",
    _SEARCH_SQL + """select query_id, doc_id, round(similarity, 6) as similarity, overlap, is_short, cast(rk - 5 as integer) as position, true as has_more
    from ranked where rk between 6 and 15""",
)
def hybrid_search_q(spark, d):
    made = hybrid_search(case_queries(spark, d), doc_corpus(spark, d), limit=10, offset=5)
    return made.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "overlap", "is_short", "position", "has_more")


@query(
    "hybrid_search_min_score",
    _SEARCH_SQL + """, kept as (select *, row_number() over (partition by query_id order by rk) as r2 from ranked
      where similarity >= 0.3 or (is_short and overlap > 0))
    select query_id, doc_id, round(similarity, 6) as similarity, overlap, cast(r2 as integer) as rank from kept where r2 <= 20""",
)
def hybrid_search_min_q(spark, d):
    made = hybrid_search(case_queries(spark, d), doc_corpus(spark, d), limit=20, min_score=0.3)
    return made.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "overlap", "rank")


@query(
    "hybrid_search_postings",
    _SEARCH_SQL + """select query_id, doc_id, round(similarity, 6) as similarity, overlap, is_short, cast(rk as integer) as position, true as has_more
    from ranked where rk <= 10""",
)
def hybrid_search_postings_q(spark, d):
    corpus = stored(doc_corpus(spark, d), "corpus")
    made = hybrid_search(case_queries(spark, d), corpus, limit=10, postings=build_postings(corpus))
    return made.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "overlap", "is_short", "position", "has_more")


@query(
    "token_overlap",
    v.ctes(f"toks as materialized (select doc_id, {v.sql_tokens('text')} as t from documents)")
    + """select d.doc_id, cast(len(list_filter(d.t, lambda x: list_contains(e.t, x))) as integer) as overlap
    from toks d join toks e on e.doc_id = d.doc_id + 1""",
)
def token_overlap_q(spark, d):
    a = v.table(spark, d, "documents").select("doc_id", tokenize("text").alias("t"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return a.join(b, "doc_id").select("doc_id", token_overlap("t", "u").alias("overlap"))


@query(
    "token_intersection",
    f"""select d.doc_id, cast(len(list_intersect(list_distinct({v.sql_tokens('d.text')}), list_distinct({v.sql_tokens('e.text')}))) as integer) as shared
    from documents d join documents e on e.doc_id = d.doc_id + 1""",
)
def token_intersection_q(spark, d):
    a = v.table(spark, d, "documents").select("doc_id", tokenize("text").alias("t"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return a.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("t", "u")).alias("shared"))


PAIRS_SQL = f"""vocab as (select distinct unnest({v.sql_tokens('text', None)}) as token from documents),
asked as (select distinct unnest({v.sql_tokens('text', None)}) as query_token from benchmark),
bounds as (select query_token, case when length(query_token) >= 10 then 2 else 1 end as b from asked
  where length(query_token) >= 5 and not regexp_matches(query_token, '^[0-9]+$'))"""


@query(
    "match_token_pairs",
    v.ctes(PAIRS_SQL)
    + """select query_token, token, cast(levenshtein(query_token, token) as integer) as distance from bounds join vocab
      on abs(length(token) - length(query_token)) <= b where not regexp_matches(token, '^[0-9]+$') and levenshtein(query_token, token) <= b""",
)
def match_token_pairs_q(spark, d):
    split = lambda t, c: v.table(spark, d, t).select(F.explode(tokenize("text", None)).alias(c))
    return match_token_pairs(split("benchmark", "q"), split("documents", "t"), "q", "t")


# -- short queries with typos over products ------------------------------------------------
# every word of every name, with one letter too many, asks for the products with such a word, with the word itself or one near
TYPO_SQL = """names as (select distinct unnest(string_split(p_name, ' ')) as w from part),
near as (select a.w || 'e' as query, b.w as t from names a, names b where a.w = b.w or
    levenshtein(a.w || 'e', b.w) <= case when length(a.w) >= 9 then 2 when length(a.w) >= 4 then 1 else 0 end),
toks as (select p_partkey, p_name, unnest(list_distinct(string_split(p_name, ' '))) as t from part),
hits as (select distinct query, p_partkey, p_name, case when p_partkey % 3 = 0 then 0.6::double else 0.3::double end as similarity,
    case when p_partkey % 5 = 0 then 1 else 0 end as overlap, p_partkey % 4 = 0 as is_short from near join toks using (t))"""


@query(
    "reliable_filter",
    v.ctes(TYPO_SQL)
    + """select query, p_partkey from hits where not is_short or overlap > 0 or (similarity >= 0.45 and exists (
      select 1 from (select unnest(string_split(p_name, ' ')) as t) where length(query) >= 5
        and levenshtein(query, t) <= case when length(query) >= 10 then 2 else 1 end))""",
)
def reliable_filter_q(spark, d):
    p = v.table(spark, d, "part")
    words = p.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("t"))
    queries = words.select("t", F.concat("t", F.lit("e")).alias("query")).distinct()
    near = match_token_pairs(queries, words, "query", "t").select(F.col("query_token").alias("query"), F.col("token").alias("t"))
    found = near.unionByName(queries.select("query", "t")).distinct().join(words, "t").select("query", "p_partkey").distinct()
    hits = found.join(p, "p_partkey").select(
        "query", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, 0.6).otherwise(0.3).alias("similarity"),
        F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0).alias("overlap"), (F.col("p_partkey") % 4 == 0).alias("is_short"),
        F.lit(0).alias("exact"), tokenize("query").alias("query_tokens"), tokenize("p_name").alias("result_tokens"))
    return reliable_filter(hits).select("query", "p_partkey")


@query(
    "ranking_score",
    v.ctes(v.FEED_SQL)
    + """select id, l_partkey, round(coalesce(case when l_orderkey % 3 <> 0 then l_discount * 4 end, 0) * 10 + l_linenumber + case when l_partkey % 2 = 0 then 1 else 0 end, 3) as score from feed""",
)
def ranking_score_q(spark, d):
    f = v.feed(spark, d)
    similarity = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount") * 4)
    return f.select("id", "l_partkey", ranking_score(similarity, F.col("l_linenumber"), F.col("l_partkey") % 2 == 0).alias("score"))


# a case looks for three words in a row of its benchmark item inside the best documents
CASES_SQL = f"""cases as (select item_id as query_id, case when item_id % 2 = 0 then 'even' else 'odd' end as category, 1 + item_id % 5 as expected_top_k,
    list_slice({v.sql_tokens('text')}, 3, 4) as every, list_slice({v.sql_tokens('text')}, 5, 6) as anyof from benchmark),
hay as (select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) as h from documents),
first_hits as (select r.query_id, min(rk) as hit_rank from ranked r join cases c using (query_id) join hay using (doc_id)
  where rk <= expected_top_k and len(list_filter(every, lambda t: not contains(h, t))) = 0 and len(list_filter(anyof, lambda t: contains(h, t))) > 0
  group by 1),
outcomes as (select query_id, category, cast(expected_top_k as bigint) as expected_top_k, cast(hit_rank as integer) as hit_rank, hit_rank is not null as passed
  from cases left join first_hits using (query_id))"""


def outcomes(spark, d):
    ranked = hybrid_search(case_queries(spark, d), doc_corpus(spark, d), limit=10)
    docs = v.table(spark, d, "documents").select("doc_id", normalize_match_text("text").alias("haystack"))
    results = ranked.join(docs, "doc_id").withColumn("ean", F.lit(None).cast("string"))
    tokens = tokenize("text")
    matcher = F.struct(F.lit(None).cast("string").alias("ean"), F.slice(tokens, 3, 2).alias("all_of"), F.slice(tokens, 5, 2).alias("any_of"))
    cases = v.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"),
        (1 + F.col("item_id") % 5).alias("expected_top_k"), F.array(matcher).alias("matchers"))
    return benchmark_match(cases, results)


@query("benchmark_match", _SEARCH_SQL + ", " + CASES_SQL + " select * from outcomes")
def benchmark_match_q(spark, d):
    return outcomes(spark, d)


@query(
    "search_quality",
    _SEARCH_SQL + ", " + CASES_SQL + """ select category, count(*) as total, count(*) filter (passed) as passed, cast(0 as bigint) as errors,
      count(*) filter (not passed) as missed, round(count(*) filter (passed) / count(*) * 100, 2) as pass_pct from outcomes group by rollup (category)""",
)
def search_quality_q(spark, d):
    return quality_by_category(outcomes(spark, d), "category", "passed")


@query(
    "relevance_notes",
    _SEARCH_SQL + """select query_id, doc_id, case when doc_id % 3 = 0 then cast(doc_id % 5 + 1 as integer) end as relevance_score,
      case when doc_id % 3 <> 2 then 'note' end as relevance_reason from ranked where rk <= 10""",
)
def relevance_notes_q(spark, d):
    ranked = hybrid_search(case_queries(spark, d), doc_corpus(spark, d), limit=10).select("query_id", "doc_id")
    score = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 5 + 1).cast("string")).otherwise("2.5")
    notes = ranked.filter("doc_id % 3 <> 2").select("query_id", "doc_id", score.alias("score"), F.lit("note").alias("reason"))
    return apply_relevance(ranked, notes)
