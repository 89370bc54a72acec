"""URL filter: allow and block rules, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import sample_rows
from linkloom.session import materialized

ALLOW, BLOCK = "allow", "block"
#: Training sample: URLs per verdict.
ROWS_PER_VERDICT = 5000
TREES, DEPTH = 20, 4
LEAST_LEAF = 5  # training URLs in a leaf, so that trees do not learn single ones
TRAINING_PARTITIONS = 6

# Verdict, host and path of each rule.
RULES = [
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
]

_LEXICAL = {
    "f_length": "length(u)",
    "f_host_length": "length(host)",
    "f_depth": "length(path) - length(replace(path, '/', ''))",
    "f_labels": "length(host) - length(replace(host, '.', ''))",
    "f_digit_ratio": "length(regexp_replace(u, '[^0-9]', '')) / greatest(length(u), 1)",
    "f_path_digits": "length(regexp_replace(path, '[^0-9]', ''))",
    "f_hyphens": "length(host) - length(replace(host, '-', ''))",
    "f_parameters": "size(regexp_extract_all(u, '[?&][^=&#]+', 0))",
    "f_fragment": "CAST(contains(u, '#') AS INT)",
    "f_secure": "CAST(startswith(u, 'https:') AS INT)",
    "f_entropy": (
        "aggregate(array_distinct(split(u, '')), 0D, (s, c) -> CASE WHEN c = '' THEN s ELSE s - "
        "(length(u) - length(replace(u, c, ''))) / length(u) * log2((length(u) - length(replace(u, c, ''))) / length(u)) END)"
    ),
}
_SUFFIX = ["f_suffix_pages", "f_suffix_blocked", "f_section_blocked"]
FEATURES = [*_LEXICAL, *_SUFFIX]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Text between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased, and the path after it."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> tuple[Column, Column]:
    """Longest fitting rule as text and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own_host, own_path in sorted(RULES if rules is None else rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        rule = F.when(fits, own_host + own_path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, url: str, page_id: str, rules=None) -> DataFrame:
    """``page_id, u, host, path, rule, rule_verdict, suffix, section`` of every page."""
    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("u"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({
        "rule": rule, "rule_verdict": verdict, "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
        "section": F.regexp_extract("path", r"^/([^/]*)/", 1),
    })


def _teaches() -> Column:
    """Half of the URLs, by hash: those that the trees are fitted on. What they read of suffixes and sections is the other half's."""
    return F.pmod(F.xxhash64("u", F.lit("half")), F.lit(2)) == 0


def _rule_statistics(rows: DataFrame, key: str) -> DataFrame:
    """Pages of each suffix or section, and the smoothed share that rules block: of all, and of those that do not teach.

    A training URL whose own verdict were in its features would give the answer away.
    """
    known = F.when(F.col("rule_verdict") == BLOCK, 1.0).when(F.col("rule_verdict") == ALLOW, 0.0)
    aside = F.when(~_teaches(), known)
    share = lambda verdict: (F.coalesce(F.sum(verdict), F.lit(0.0)) + 0.5) / (F.count(verdict) + 1.0) - 0.5
    return rows.groupBy(key).agg(
        F.log1p(F.count(F.lit(1))).alias(f"{key}_pages"), share(known).alias(f"{key}_blocked"), share(aside).alias(f"{key}_aside")
    )


def _described(rows: DataFrame, suffix: DataFrame, section: DataFrame, training: bool) -> DataFrame:
    """Lexical features and the statistics of suffix and first path section; smoothed, so unknown ones are neutral."""
    out = rows.join(suffix, "suffix", "left").join(section, "section", "left")
    lexical = {name: F.expr(text).cast("double") for name, text in _LEXICAL.items()}
    blocked = "aside" if training else "blocked"
    names = dict(zip(_SUFFIX, ("suffix_pages", f"suffix_{blocked}", f"section_{blocked}"), strict=True))
    return out.withColumns(lexical | {name: F.coalesce(column, F.lit(0.0)) for name, column in names.items()})


def classify(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None,
    rows_per_verdict: int = ROWS_PER_VERDICT,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every page.

    A fitting rule decides; the trees, trained on URLs that rules decide, judge
    the others, ``score`` being their probability of ``block`` (null where a
    rule decides). Suffix and section statistics count all pages, for a training URL
    those of the half of all URLs that it is not in; the trees are fitted on at
    most ``rows_per_verdict`` distinct URLs per verdict of the other half, those with the least hashes, which
    weigh as much as all distinct URLs of their verdict there. A null or malformed URL has an empty host and path and is judged by its features.
    Repeated rows repeat; other columns are ignored. If the half to
    fit on lacks a verdict, that which more distinct URLs have stands for the
    trees; without any decided page they allow.
    """
    rows = judged(pages, url, page_id, rules)
    known = F.when(F.col("rule_verdict") == BLOCK, 1.0).when(F.col("rule_verdict") == ALLOW, 0.0)
    suffix, section = materialized(_rule_statistics(rows, "suffix")), materialized(_rule_statistics(rows, "section"))
    decided = rows.filter("rule_verdict IS NOT NULL").dropDuplicates(["u"])
    sample = sample_rows(decided.filter(_teaches()), "u", "rule_verdict", rows_per_verdict)
    full = decided.groupBy("rule_verdict").agg(F.count(F.lit(1)).alias("all"), F.count_if(_teaches()).alias("count")).collect()
    weight = F.lit(1.0)
    for r in full:
        if not r["count"]:
            continue
        weight = F.when(F.col("rule_verdict") == r["rule_verdict"], r["count"] / min(r["count"], rows_per_verdict)).otherwise(weight)
    # A bounded sample in a few partitions: every level of every tree is a pass over them.
    training = materialized(
        _described(sample, suffix, section, True).withColumns({"label": known, "weight": weight})
        .select("label", "weight", *FEATURES).coalesce(TRAINING_PARTITIONS)
    )
    classes = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    base = ["page_id", "host", "path", "rule"]
    if len(classes) < 2:
        more = {r["rule_verdict"]: r["all"] for r in full}
        otherwise = F.lit(BLOCK if more.get(BLOCK, 0) > more.get(ALLOW, 0) else ALLOW)
        return rows.select(*base, F.coalesce("rule_verdict", otherwise).alias("verdict"), F.lit(None).cast("double").alias("score"))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
        minInstancesPerNode=LEAST_LEAF, seed=1,
    ).fit(vectors.transform(training))
    open_ = _described(rows.filter("rule_verdict IS NULL"), suffix, section, False)
    scored = trees.transform(vectors.transform(open_)).withColumn("score", vector_to_array("probability")[1])
    scored = scored.select(*base, F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW).alias("verdict"), "score")
    ruled = rows.filter("rule_verdict IS NOT NULL").select(*base, F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(scored)
