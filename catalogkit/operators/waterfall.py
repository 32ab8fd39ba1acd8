"""Asking lookup sources in priority order and choosing what to trust."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from catalogkit.functions.text import _c, trim
from catalogkit.functions.values import computed_once, field_type, first_non_blank
from catalogkit.operators.dedupe import top_per_key
from catalogkit.operators.policy import SourcePolicy, source_keys
from catalogkit.session import new_work_path

# Name fields of a lookup record, in the order they are tried.
PRIMARY_NAME_FIELDS = ["nome", "nome_produto", "produto", "title", "name"]
DISPLAY_NAME_FIELDS = ["nome_exibicao", "display_name", "nome"]

# Sentences of an approval reason.
REASON_FOUND = " encontrou resultado."
REASON_SKIPPED = " nao foi consultada porque uma fonte anterior resolveu o EAN."
REASON_FAILED = " falhou: "
REASON_EMPTY = " sem resultado."
REASON_NO_SOURCE = "Nenhuma fonte externa configurada."


def source_order(api: Sequence[str], scrapers: Sequence[str], mode: str = "api_first") -> list[str]:
    """Sources to ask, in order, for one of the four modes; unknown modes mean ``api_first``."""
    if mode == "api_only":
        return list(api)
    if mode == "scraping_only":
        return list(scrapers)
    return [*scrapers, *api] if mode == "scraping_first" else [*api, *scrapers]


def _answer_order() -> Column:
    """Which of several answers of one source counts: one with a hit, then one without error, then by content."""
    content = F.to_json(F.struct("result", "detail", "error"))
    return F.struct(
        (F.col("result").isNull() & F.col("detail").isNull()).alias("empty"),
        F.col("error").isNotNull().alias("failed"),
        F.sha2(content, 256).alias("content"),
    )


def lookup_waterfall(
    keys: DataFrame, lookups: DataFrame, sources: Sequence[str], key: str = "ean", source: str = "source_key"
) -> DataFrame:
    """Per distinct key, what each source answered when asked in order.

    ``lookups`` has ``(key, source, result struct, detail struct, error)``. Of several rows per key and source,
    one with a hit counts, else one without error; content decides the rest, so the choice is repeatable. The answer has ``resolved_by`` and ``lookups``, an array with one struct per source
    in order: the first source with a result or detail wins, later ones are marked skipped, and
    an error counts as no hit. Sources are gathered with one partial aggregation by key.
    """
    sources = source_keys(sources)
    asked = keys.select(key).distinct()
    answers = lookups.filter(F.col(source).isin(*sources)).groupBy(key).agg(
        *[
            F.min_by(
                F.struct("result", "detail", "error"), F.when(F.col(source) == s, _answer_order())
            ).alias(f"_s{i}")
            for i, s in enumerate(sources)
        ]
    )
    return _in_order(asked.join(answers, key, "left"), sources, key)


def ask_in_turn(
    keys: DataFrame, answers: Mapping[str, DataFrame], sources: Sequence[str], key: str = "ean"
) -> DataFrame:
    """Ask each source only for the keys that no earlier source resolved: ``key, priority, answer, hit``, one row per question.

    ``answers`` has one table ``(key, result, detail, error)`` per source, all with the same types; it may be a feed, a partition or a service's
    landed payloads. Each round is stored under the shared folder, so the keys left over are read back narrow, the next table is
    thinned to them by a semi-join before its wide answers are gathered, and a lost task repeats one round only. Spark
    broadcasts the keys left where their stored size is small. No further table is read once every key is resolved. Null keys match
    nothing; of several answers for a key one is chosen as in :func:`lookup_waterfall`; a source without a table is an error.
    """
    spark = keys.sparkSession
    names = dict(zip(source_keys(list(answers)), answers))
    order = source_keys(sources)
    if missing := set(order) - set(names):
        raise ValueError(f"no answers of {sorted(missing)}")
    path = new_work_path(spark, "waterfall")
    left, rounds = keys.select(key).distinct(), []
    for i, s in enumerate(order):
        table = answers[names[s]].select(key, "result", "detail", "error").join(left, key, "left_semi")
        best = table.groupBy(key).agg(F.min_by(F.struct("result", "detail", "error"), _answer_order()).alias("answer"))
        turn = left.join(best, key, "left").withColumn("priority", F.lit(i))
        turn = turn.withColumn("hit", F.coalesce(matched(F.col("answer")), F.lit(False)))
        turn.write.parquet(f"{path}/{i}")
        rounds.append(spark.read.schema(turn.schema).parquet(f"{path}/{i}"))
        left = rounds[-1].filter(~F.col("hit")).select(key)
        if left.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), rounds).select(key, "priority", "answer", "hit")


def staged_waterfall(
    keys: DataFrame, answers: Mapping[str, DataFrame], sources: Sequence[str], key: str = "ean"
) -> DataFrame:
    """The rows of :func:`lookup_waterfall`, from sources asked in turn by :func:`ask_in_turn`.

    For sources that are large or dear to read and seldom needed; with all answers in one small table, one aggregation is quicker.
    """
    sources = source_keys(sources)
    asked = ask_in_turn(keys, answers, sources, key)
    turns = [F.max_by("answer", F.when(F.col("priority") == i, i)).alias(f"_s{i}") for i in range(len(sources))]
    return _in_order(asked.groupBy(key).agg(*turns), sources, key)


def _in_order(wide: DataFrame, sources: Sequence[str], key: str) -> DataFrame:
    """``key, resolved_by, lookups`` from one answer column ``_s<i>`` per source."""
    hits = [matched(F.col(f"_s{i}")) for i in range(len(sources))]
    resolved = F.coalesce(*[F.when(hit, F.lit(s)) for s, hit in zip(sources, hits)])
    entries = []
    for i, s in enumerate(sources):
        answer = F.col(f"_s{i}")
        earlier = reduce(lambda a, b: a | b, hits[:i], F.lit(False))
        entries.append(
            F.struct(
                F.lit(s).alias("key"),
                F.lit(i).alias("priority"),
                F.when(~earlier, answer["result"]).alias("result"),
                F.when(~earlier, answer["detail"]).alias("detail"),
                F.when(~earlier, answer["error"]).alias("error"),
                earlier.alias("skipped"),
                F.when(earlier, F.concat(F.lit("resolved_by_"), resolved)).alias("skip_reason"),
            )
        )
    known = wide.withColumn("resolved_by", resolved)
    return computed_once(known, lookups=F.array(*entries)).select(key, "resolved_by", "lookups")


def matched(lookup: Column) -> Column:
    return lookup["result"].isNotNull() | lookup["detail"].isNotNull()


def _names(lookup: Column, dtype: T.StructType, names: Sequence[str]) -> list[Column]:
    return [lookup["result"][n] for n in names if field_type(dtype, f"result.{n}") is not None]


def _info(lookup: Column, dtype: T.StructType, name: str) -> Column:
    if field_type(dtype, f"detail.info.{name}") is None:
        return F.lit(None).cast("string")
    return lookup["detail"]["info"][name]


def _joined(*parts: Column) -> Column:
    return trim(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def primary_name(lookup: Column, dtype: T.StructType) -> Column:
    """Product name of a lookup: the result's name fields, else the detail's product."""
    return first_non_blank(*_names(lookup, dtype, PRIMARY_NAME_FIELDS), _info(lookup, dtype, "produto"))


def display_name(lookup: Column, dtype: T.StructType) -> Column:
    """Display name: own field, else name plus presentation from the result, then from the detail."""
    result = [lookup["result"][n] for n in ("produto", "apresentacao") if field_type(dtype, f"result.{n}") is not None]
    return first_non_blank(
        *_names(lookup, dtype, DISPLAY_NAME_FIELDS),
        _joined(*result),
        _joined(_info(lookup, dtype, "produto"), _info(lookup, dtype, "apresentacao")),
    )


def lookup_struct_type(df: DataFrame, lookups: str = "lookups") -> T.StructType:
    return df.schema[lookups].dataType.elementType


def resolve_sources(waterfall: DataFrame, sources: Sequence[str], policy: SourcePolicy) -> DataFrame:
    """Add ``name_lookup`` and ``data_lookup``: whose name to use and whose data to use.

    Names come from the preferred sources that have one, else from the first that has. Data come
    from the first with a detail, then from the first with any match, then from the name's source.
    """
    dtype = lookup_struct_type(waterfall)
    sources = source_keys(sources)
    entry = {s: F.get("lookups", F.lit(i)) for i, s in enumerate(sources)}

    def pick(order: Sequence[str], test) -> Column:
        choices = [F.when(test(entry[s]), entry[s]) for s in order if s in entry]
        return F.coalesce(*choices)

    active = policy.ordered(sources)
    names = [*policy.name_order(), *active]
    data = [*policy.data_order(), *active]
    name = pick(names, lambda e: primary_name(e, dtype).isNotNull())
    detail = pick(data, lambda e: e["detail"].isNotNull())
    any_match = pick(data, matched)
    data_lookup = F.coalesce(detail, any_match, name)
    return computed_once(waterfall, data_lookup=data_lookup, name_lookup=F.coalesce(name, data_lookup))


def lookup_status_wide(waterfall: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One set of ``<source>_search / _detail / _error / _skipped / _skip_reason`` columns per source."""
    columns = []
    for i, s in enumerate(source_keys(sources)):
        entry, name = F.get("lookups", F.lit(i)), metric_key(s)
        columns += [
            entry["result"].isNotNull().alias(f"{name}_search"),
            entry["detail"].isNotNull().alias(f"{name}_detail"),
            entry["error"].alias(f"{name}_error"),
            entry["skipped"].alias(f"{name}_skipped"),
            entry["skip_reason"].alias(f"{name}_skip_reason"),
        ]
    keep = [c for c in waterfall.columns if c not in ("lookups", "name_lookup", "data_lookup")]
    return waterfall.select(*keep, *columns)


def metric_key(source: str) -> str:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in source.strip().lower())
    return "_".join(words.split()) or "_"


def lookup_status_long(wide: DataFrame, sources: Sequence[str], key: str = "ean") -> DataFrame:
    """Back to one row per key and source."""
    rows = []
    for s in source_keys(sources):
        name = metric_key(s)
        rows.append(
            F.struct(
                F.lit(s).alias("source_key"),
                F.col(f"{name}_search").alias("search"),
                F.col(f"{name}_detail").alias("detail"),
                F.col(f"{name}_error").alias("error"),
                F.col(f"{name}_skipped").alias("skipped"),
                F.col(f"{name}_skip_reason").alias("skip_reason"),
            )
        )
    return wide.select(key, F.inline(F.array(*rows)))


def approval_reason(lookups: Column | str, sources: Sequence[str], policy: SourcePolicy) -> Column:
    """One sentence per source, in preference order, on what it answered."""
    lookups = _c(lookups)
    order = source_keys(sources)
    sentences = []
    for s in policy.ordered(order):
        entry, label = F.get(lookups, F.lit(order.index(s))), F.lit(policy.fixed_label(s))
        tail = (
            F.when(matched(entry), F.lit(REASON_FOUND))
            .when(entry["skipped"], F.lit(REASON_SKIPPED))
            .when(entry["error"].isNotNull(), F.concat(F.lit(REASON_FAILED), entry["error"]))
            .otherwise(REASON_EMPTY)
        )
        sentences.append(F.concat(label, tail))
    return F.concat_ws(" ", *sentences) if sentences else F.lit(REASON_NO_SOURCE)


def register_lookup(key: str, df: DataFrame, priority: int) -> DataFrame:
    """A lookup source given as ``(ean, result, detail, error)``: tag it with its key and priority."""
    missing = {"ean", "result", "detail", "error"} - set(df.columns)
    if missing:
        raise ValueError(f"lookup source {key} lacks {sorted(missing)}")
    order = _answer_order()
    one = top_per_key(df, ["ean"], [order], 1)
    return one.select("ean", F.lit(source_keys([key])[0]).alias("source_key"), F.lit(priority).alias("priority"),
                      "result", "detail", "error")


def register_lookups(sources: Mapping[str, tuple[DataFrame, int]]) -> tuple[DataFrame, list[str]]:
    """All lookup sources ``key -> (answers, priority)`` as one table, and the order in which to ask them.

    The lowest priority is asked first; equal priorities go by key.
    """
    if not sources:
        raise ValueError("at least one lookup source is needed")
    tables = [register_lookup(key, df, priority) for key, (df, priority) in sources.items()]
    order = sorted(sources, key=lambda key: (sources[key][1], key))
    return reduce(lambda a, b: a.unionByName(b), tables), source_keys(order)
