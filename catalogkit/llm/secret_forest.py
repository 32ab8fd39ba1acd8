"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame and SQL functions only. Candidates are long runs of key-like characters with a digit, and shorter ones that a secret's name
or a URL's user announces; an equals sign belongs to one only as padding at its end, so ``NAME=value`` is a name and a candidate. Each is
described by its length, its changes of character kind, how much of it is words of the corpus, where it stands, and the words
beside it; a forest trained on labelled findings tells secrets from the rest. Where no finding is labelled it learns from controls: secrets
and harmless values of known kinds, made at random and planted into lines of corpus words, so that a label says what was planted and
not what the figures are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogkit.llm.sampling import MAX_LABELS
from catalogkit.session import cut_lineage

MIN_LENGTH, SHORT_LENGTH = 16, 8
_KEY, _PADDING = "[A-Za-z0-9+/_-]", "(?![A-Za-z0-9+/_=-])"
#: Characters beside a candidate that are looked at.
_NEAR = 64
#: A corpus word stands in at least so many documents.
MIN_DOCUMENTS = 5
TREES, DEPTH = 20, 8
#: Planted findings that teach where none is labelled, and corpus words that stand beside them.
CONTROLS, CONTROL_WORDS = 8_000, 500
#: The forest is fitted on at most so many labelled findings per label.
FIT_ROWS = 20_000

#: Shapes by which vendors mark their keys; such a key needs no name beside it.
KNOWN_KEYS = (
    r"(?:^|[^A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|[rs]k_live_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-[a-z0-9]+-)?[A-Za-z0-9_]{32,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"
)
# Names that announce a secret, and words that mark samples.
SECRET_NAMES = "token|secret|password|passwd|pwd|passphrase|apikey|api_key|api-key|access_key|private_key|auth|bearer|credential"
SAMPLE_WORDS = "example|sample|dummy|placeholder|test|fake|mock|xxxx|changeme|your"

FEATURES = [
    "length", "digit_share", "upper_share", "digit_turns", "case_turns", "distinct_share", "hex_only", "digits_only",
    "longest_letters", "word_coverage", "slashes", "in_path", "sample_path", "named", "assigned", "quoted", "sample_near",
    "known_key", "hash_near", "url_password", "data_uri", "uuid", "word_parts",
]
#: What comes before a value of fewer than ``MIN_LENGTH`` characters: a secret's name with a sign, or a URL's user.
_ANNOUNCED = rf"(?<=(?:{SECRET_NAMES})[A-Za-z0-9_.-]{{0,24}}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"'`]?|://[A-Za-z0-9_.%-]{{1,40}}:)"
# Words beside values that only identify content.
HASH_WORDS = "commit|revision|sha|md5|digest|checksum|etag|blob|uuid|guid|build|order|invoice"


def _count(pattern: str, of: Column) -> Column:
    return F.regexp_count(of, F.lit(pattern))


def _run(length: int) -> str:
    """Runs of at least ``length`` key-like characters, with up to two equals signs where nothing key-like follows; shorter ones if announced."""
    short = [rf"{_KEY}{{{length - n}}}={{{n}}}{_PADDING}" for n in (1, 2) if length > n]
    least = min(SHORT_LENGTH, length)
    # the digit is looked for first: most words have none, and need no look at what stands before them
    named = rf"(?=[A-Za-z+/_-]{{0,{length - 1}}}[0-9])(?=(?:{_KEY}){{{least}}})(?i:{_ANNOUNCED}){_KEY}{{{least},{max(length - 1, least)}}}+(?!{_KEY})"
    return rf"(?<!{_KEY})(?:" + "|".join([rf"{_KEY}{{{length},}}+(?:={{1,2}}{_PADDING})?+", *short, named]) + ")"


def candidates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, min_length: int = MIN_LENGTH
) -> DataFrame:
    """``key, at, candidate, before, after, path``: every run of key-like characters with a digit in it.

    ``at`` counts characters from 0; up to 64 characters on each side come along, before it also those of an
    earlier run, which may be its name. The text is split at the
    runs once, and the pieces' lengths are summed up over the rows of a document.
    """
    run = _run(min_length)
    rows = docs.select(
        F.col(key).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).alias("text"),
        (F.col(path) if path else F.lit(None)).cast("string").alias("path"),
        F.regexp_extract_all(text, F.lit(run), F.lit(0)).alias("runs"),
    ).filter(F.exists("runs", lambda r: r.rlike("[0-9]")))
    pieces = rows.withColumn("pieces", F.split("text", run, -1))
    last = lambda of, n: F.coalesce(F.substring(F.get(of, n), -_NEAR, _NEAR), F.lit(""))
    placed = pieces.select(
        "key", "row", "path",
        F.posexplode(
            F.transform(
                "runs",
                lambda run, n: F.struct(
                    run.alias("candidate"),
                    F.length(F.get("pieces", n)).alias("gap"),
                    F.substring(
                        F.concat(last("pieces", n - 1), last("runs", n - 1), last("pieces", n)), -_NEAR, _NEAR
                    ).alias("before"),
                    F.substring(F.get("pieces", n + 1), 1, _NEAR).alias("after"),
                ),
            )
        ).alias("n", "r"),
    )
    upto = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("r.gap") + F.length("r.candidate")).over(upto)
    found = placed.select(
        "key", "row", "n", (end - F.length("r.candidate")).alias("at"), "r.candidate", "r.before", "r.after", "path"
    )
    return found.filter(F.col("candidate").rlike("[0-9]"))


def corpus_words(docs: DataFrame, text: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Lower-case words of four letters or more that stand in at least ``min_documents`` documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_documents).select("word")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``."""
    parts = found.select(
        "row", "n", F.explode(F.regexp_extract_all(F.lower(F.col("candidate")), F.lit(r"[\p{L}]{4,}"), F.lit(0))).alias("word")
    )
    covered = parts.join(words, "word").groupBy("row", "n").agg(F.sum(F.length("word")).alias("covered"))
    c, length = F.col("candidate"), F.length("candidate")
    near_words = F.lower(F.concat_ws(" ", "before", "after"))
    runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    figures = {
        "length": length,
        "digit_share": _count("[0-9]", c) / length,
        "upper_share": _count("[A-Z]", c) / length,
        "digit_turns": _count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", c) / length,
        "case_turns": _count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])", c) / length,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / length,
        "hex_only": c.rlike("^[0-9A-Fa-f]+$"),
        "digits_only": c.rlike("^[0-9]+$"),
        "longest_letters": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) / length,
        "word_coverage": F.coalesce("covered", F.lit(0)) / length,
        "slashes": _count("/", c),
        "in_path": F.col("before").rlike(r"(://\S*|[./\\])$"),
        "sample_path": F.lower(F.coalesce("path", F.lit(""))).rlike(SAMPLE_WORDS + "|docs?/"),
        "named": F.lower("before").rlike(rf"(?:{SECRET_NAMES})[\w.-]*\W{{0,6}}$"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"'`]?$"),
        "quoted": F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]"),
        "sample_near": near_words.rlike(SAMPLE_WORDS),
        "known_key": c.rlike(KNOWN_KEYS) & ~F.lower(c).rlike("example|xxxx"),
        "hash_near": F.lower("before").rlike(rf"(?:{HASH_WORDS})[^A-Za-z0-9]{{0,4}}(?:[a-z0-9]{{1,8}}[^A-Za-z0-9]{{1,3}})?$"),
        "url_password": F.col("before").rlike(r"://[^\s:@/]+:$") & F.col("after").startswith("@"),
        "data_uri": F.col("before").rlike(r"base64,$"),
        "uuid": c.rlike("^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
        "word_parts": _count(r"(?<![A-Za-z0-9])[a-z]{3,}(?![A-Za-z0-9])", F.regexp_replace(c, "_", "-")),
    }
    joined = found.join(covered, ["row", "n"], "left")
    return joined.select("*", *[figures[name].cast("double").alias(name) for name in FEATURES]).drop("covered")


def controls(words: DataFrame, rows: int = CONTROLS) -> DataFrame:
    """``key, text, path, at, label``: lines of corpus words, each with one planted value; 1 is a secret.

    Values follow from the line's number, so they are the same in every run. The path and the words beside a value do not depend on
    its kind. The driver sees ``CONTROL_WORDS`` words.
    """
    some = [r["word"] for r in words.orderBy(F.xxhash64("word"), "word").limit(CONTROL_WORDS).collect()] or ["alpha", "river", "stone"]
    listed = F.array(*[F.lit(w) for w in some])
    spark, key = words.sparkSession, F.col("key")
    pick = lambda n, size: F.pmod(F.xxhash64(key, F.lit(n)), F.lit(size)).cast("int")
    word = lambda n: F.element_at(listed, pick(n, len(some)) + 1)
    hexes = lambda n: F.sha2(F.concat(F.lit(f"{n}:"), key.cast("string")), 256)
    base = F.base64(F.unhex(F.concat(hexes(1), hexes(2))))
    mixed = F.regexp_replace(base, "[+/=\r\n]", "")
    digits = F.translate(hexes(3), "abcdef", "012345")
    cut = lambda of, n: F.substring(of, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    some_of = lambda low, high: pick(9, high - low + 1) + low
    one_of = lambda n, values: F.element_at(F.array(*[F.lit(x) for x in values]), pick(n, len(values)) + 1)
    name = one_of(11, ["password", "passwd", "secret", "token", "api_key", "API_KEY", "client_secret", "AUTH_TOKEN", "access_key", "credential"])
    vendor = F.when(pick(12, 5) == 0, F.concat(F.lit("AKIA"), F.upper(cut(mixed, 16)))).when(
        pick(12, 5) == 1, F.concat(F.lit("ghp_"), cut(mixed, 36))
    ).when(pick(12, 5) == 2, F.concat(F.lit("sk_live_"), cut(hexes(5), some_of(16, 32)))).when(pick(12, 5) == 3, F.concat(F.lit("sk_live_"), cut(mixed, some_of(16, 32)))).otherwise(F.concat(F.lit("glpat-"), cut(mixed, 20)))
    uuid = F.concat_ws("-", *[F.substring(hexes(4), at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    slug = F.concat_ws("-", word(21), word(22), word(23), word(24), cut(digits, some_of(1, 4)))
    year = (pick(13, 30) + 1995).cast("string")
    text = F.lit
    kinds: list[tuple[int, Column, Column, Column]] = [
        (1, F.concat(name, text("=")), cut(mixed, some_of(8, 40)), text("")),
        (1, F.concat(name, text("=")), cut(mixed, some_of(8, 15)), text("")),
        (1, F.concat(name, text(": \"")), cut(mixed, some_of(12, 48)), text("\"")),
        (1, F.concat(name, text(" = \"")), cut(hexes(5), one_of(14, [32, 40, 64])), text("\"")),
        (1, F.concat(text("export "), F.upper(name), text("=")), cut(hexes(5), one_of(14, [32, 40])), text("")),
        (1, text("Authorization: Bearer "), cut(mixed, some_of(24, 60)), text("")),
        (1, F.concat(name, text("='")), F.concat(cut(base, 43), text("=")), text("'")),
        (1, F.concat(text("postgres://"), word(25), text(":")), cut(mixed, some_of(8, 24)), F.concat(text("@"), word(26), text(".local/db"))),
        (1, text("https://api.local/v1?token="), cut(mixed, some_of(16, 40)), text("&page=2")),
        *[(1, one_of(19 + n, ["", "key ", "uses ", "build ", "with \""]), vendor, text("")) for n in range(3)],
        (1, F.concat(name, text("=")), vendor, text("")),
        (0, one_of(15, ["commit ", "revision ", "merge ", "index ", "blob "]), cut(hexes(5), 40), text("")),
        (0, one_of(15, ["sha256:", "md5 ", "checksum: ", "etag \"", "digest "]), cut(hexes(5), one_of(14, [32, 64])), text("")),
        (0, one_of(16, ["", "uuid ", "id=", "request_id: "]), uuid, text("")),
        (0, one_of(16, ["", "https://site.local/", "see "]), F.concat(word(27), text("/"), year, text("/"), word(28), text("/"), slug), text("")),
        (0, one_of(16, ["", "https://site.local/", "title "]), slug, text("")),
        (0, one_of(17, ["data:image/png;base64,", "src=data:image/gif;base64,"]), F.concat(base, base), text("")),
        (0, one_of(16, ["order ", "phone +", "", "id=", "invoice: "]), cut(digits, some_of(16, 24)), text("")),
        (0, one_of(16, ["", "build ", "ref ", "object "]), cut(mixed, some_of(16, 48)), text("")),
        (0, one_of(16, ["", "object ", "cache/"]), cut(hexes(5), one_of(14, [32, 40, 64])), text("")),
        (0, F.concat(name, text("=")), F.concat(text("your_"), word(29), text("_here_"), cut(digits, 4)), text("")),
        (0, F.concat(text("example "), name, text("=")), cut(mixed, some_of(16, 32)), text("")),
        (0, text("key "), F.concat(text("AKIA"), F.upper(cut(mixed, 9)), text("EXAMPLE")), text("")),
        (0, text("file "), F.concat(word(30), text("_"), year, cut(digits, 4), text("_"), cut(F.reverse(digits), 6)), text(".png")),
        (0, text("version="), F.concat(text("v"), cut(digits, 2), text("-build-"), year, cut(F.reverse(digits), 6)), text("")),
    ]
    own = F.pmod(key, F.lit(len(kinds))).cast("int")
    choose = lambda at: F.coalesce(*[F.when(own == n, kind[at]) for n, kind in enumerate(kinds)])
    planted = spark.range(rows).select(F.col("id").alias("key")).select(
        "key", choose(0).alias("label"), F.concat(word(31), F.lit(" "), word(32), F.lit(" "), choose(1)).alias("lead"),
        choose(2).alias("value"), F.concat(choose(3), F.lit(" "), word(33), F.lit(" "), word(34), F.lit(".")).alias("tail"),
        one_of(18, ["src/app.py", "docs/guide.md", "web", "tests/run.py", "notes"]).alias("path"),
    )
    return planted.select("key", F.concat("lead", "value", "tail").alias("text"), "path", F.length("lead").alias("at"), "label")


def control_findings(words: DataFrame, rows: int = CONTROLS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Planted values described like any candidate, with their ``label``. Values that are no candidate (no digit) teach nothing."""
    planted = cut_lineage(controls(words, rows))
    found = cut_lineage(candidates(planted, "key", "text", "path", min_length))
    labels = planted.select("key", "at", "label")
    return described(found, words).join(labels, ["key", "at"])


@dataclass
class Forest:
    """A fitted forest, or the one label that all findings had."""

    model: RandomForestClassificationModel | None
    only: float


def low_findings(findings: DataFrame, label: str, rows: int) -> DataFrame:
    """``label, place`` and figures of the findings that can be among the first ``rows`` of their label, and few more."""
    known = findings.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), F.xxhash64("candidate", "key", "at").alias("place"), *FEATURES
    )
    counted = known.groupBy("label").agg(F.approx_count_distinct("place").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(counted) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    below = [(r["label"], min(2**63 - 1, -(2**63) + (4 * rows + 1000) * 2**64 // max(r["n"], 1))) for r in counted]
    bounds = findings.sparkSession.createDataFrame(below, "label double, _below long")
    low = known.join(F.broadcast(bounds), "label").filter(F.col("place") <= F.col("_below"))
    return low.groupBy("label", "place").agg(*[F.max(name).alias(name) for name in FEATURES])


def sampled(findings: DataFrame, label: str, rows: int) -> DataFrame:
    """The first ``rows`` findings of each label in hash order: ``label, place`` and figures."""
    order = Window.partitionBy("label").orderBy("place")
    ranked = low_findings(findings, label, rows).withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= rows).drop("_rank")


def fit_forest(findings: DataFrame, label: str = "label", rows: int = FIT_ROWS, seed: int = 1) -> Forest:
    """Train on at most ``rows`` labelled findings of each label, in hash order of their text and place.

    Labels are counted first, and only findings whose hash is low enough to be among the first are ranked, with their
    figures alone. A finding in repeated rows teaches once. Findings without a label teach nothing. With one label alone, or none, there is no forest to grow: scores are that label, or 0.
    """
    sample = cut_lineage(sampled(findings, label, rows).select("label", *FEATURES))
    kinds = sorted(r[0] for r in sample.select("label").distinct().limit(3).collect())
    if len(kinds) < 2:
        return Forest(None, kinds[0] if kinds else 0.0)
    packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    forest = RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, maxMemoryInMB=64, featureSubsetStrategy="onethird")
    return Forest(forest.fit(packed.select("label", "features")), 0.0)


def judged(findings: DataFrame, forest: Forest) -> DataFrame:
    """``findings`` with the forest's ``score`` (0 to 1) and ``is_secret`` (from one half)."""
    if forest.model is None:
        scored = findings.withColumn("score", F.lit(forest.only))
    else:
        packed = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings)
        scored = forest.model.transform(packed).withColumn("score", vector_to_array("probability")[1])
        scored = scored.drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def find_candidates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, min_length: int = MIN_LENGTH,
    words: DataFrame | None = None,
) -> DataFrame:
    """Described candidates, stored once: fitting and judging read them several times."""
    found = cut_lineage(candidates(docs, key, text, path, min_length))
    return cut_lineage(described(found, corpus_words(docs, text) if words is None else words))


def scan_secrets(
    docs: DataFrame, labelled: DataFrame | None = None, teach: Column | None = None, key: str = "doc_id",
    text: str = "text", path: str | None = None, min_length: int = MIN_LENGTH,
) -> DataFrame:
    """One row per candidate: ``key, at, length, sha256, score, is_secret``.

    ``labelled`` holds judged findings (``key, at, label``) by which the forest learns, and ``teach`` limits who may teach, in terms of
    the column ``key``. Without it the forest learns from ``controls``, and from no document. Null and
    empty texts have no candidates; repeated rows have theirs each; long texts are scanned whole; an empty table
    gives no rows. The secret itself is not returned. Only the named columns are read.
    """
    words = cut_lineage(corpus_words(docs, text))
    found = find_candidates(docs, key, text, path, min_length, words)
    if labelled is None:
        forest = fit_forest(control_findings(words, min_length=min_length))
    else:
        known = found.join(labelled.select(F.col(key).alias("key"), "at", "label").distinct(), ["key", "at"])
        forest = fit_forest(known if teach is None else known.filter(teach))
    verdicts = judged(found, forest)
    return verdicts.select(
        F.col("key").alias(key), F.col("at").cast("long").alias("at"), F.col("length").cast("int").alias("length"),
        F.sha2(F.col("candidate"), 256).alias("sha256"), "score", "is_secret",
    )
