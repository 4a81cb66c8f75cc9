"""URL filtering: rules by host and path, and boosted trees on lexical features for the urls no rule decides."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portage.functions.columns import let
from portage.llm.common import staged, table

#: What each rule says, by host and path.
RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
}

#: Labelled urls the trees are fitted on at most: those with the smallest hashes.
SAMPLE = 20_000

#: Labelled urls that a suffix must have for its share of blocked ones to weigh as much as the share of all.
PRIOR = 20

TREES, DEPTH = 10, 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"

FEATURES = ["n_chars", "depth", "digits", "entropy", "parameters", "n_labels", "host_chars", "suffix_share", "domain_share"]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules that fit, or null. A rule fits its host and the subdomains, and paths that start alike."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")

    none = F.lit(None).cast("string")
    return reduce(lambda rest, rule: F.when(fits(rule), F.lit(rule)).otherwise(rest), sorted(rules, key=len), none)


def _entropy(text: Column) -> Column:
    """Bits per character of the distribution of the text's characters."""
    size = F.length(text)

    def of(letters: Column) -> Column:
        return F.aggregate(letters, F.lit(0.0), lambda sum_, c: let(
            (size - F.length(F.replace(text, c, F.lit("")))) / size, lambda p: sum_ - p * F.log2(p)
        ))

    return F.coalesce(let(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), of), F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (``url``, ``host``, ``path``) with its lexical features and the suffixes that statistics are kept for."""
    url = F.coalesce("url", F.lit(""))
    labels = F.split("host", r"\.")
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "n_chars": F.length(url).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "digits": F.coalesce(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.nullif(F.length(url), F.lit(0)), F.lit(0.0)),
        "entropy": _entropy(url),
        "parameters": F.when(asked == "", 0.0).otherwise(F.size(F.split(asked, "&")).cast("double")),
        "n_labels": F.size(labels).cast("double"),
        "host_chars": F.length("host").cast("double"),
        "suffix": F.element_at(labels, -1),
        "domain": F.substring_index("host", ".", -2),
    })


def _shares(labelled: DataFrame, name: str) -> DataFrame:
    """The share of blocked urls by suffix, over all labelled urls, drawn towards one half where there are few."""
    return labelled.groupBy(name).agg(
        ((F.sum("label") + PRIOR * 0.5) / (F.count(F.lit(1)) + PRIOR)).alias(f"{name}_share")
    )


def judge(pages: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    The verdict is that of the longest rule that fits. For urls that no rule fits it is that of boosted trees, which
    learn from the urls that rules decide: fitted on at most ``sample`` of them, with suffix statistics over all. If
    those urls are all alike, their verdict holds for the rest; without any, everything is allowed. A null url, or one
    without ``://``, has an empty host and path; repeated rows get equal results.
    """
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    ruled = split.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    said = reduce(lambda rest, rule: F.when(F.col("rule") == rule, F.lit(rules[rule])).otherwise(rest), rules, F.lit(None).cast("string"))
    known = staged(lexical(ruled).withColumn("label", F.when(said == "block", 1.0).when(said == "allow", 0.0)), "urls")

    labelled = known.where("label is not null")
    shared = known
    for name in ("suffix", "domain"):
        shared = shared.join(staged(_shares(labelled, name), "shares"), name, "left")
    shared = shared.fillna(0.5, ["suffix_share", "domain_share"])
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(shared)

    chosen = staged(
        ready.where("label is not null").orderBy(F.xxhash64("url"), "page_id").limit(sample).select("label", *FEATURES), "sample"
    )
    classes = sorted(r["label"] for r in chosen.select("label").distinct().collect())
    if len(classes) == 2:
        train = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(chosen)
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(train.select("label", "features"))
        score = F.get(vector_to_array("probability"), F.lit(1))
        ready = trees.transform(ready)
    else:
        score = F.lit(classes[0] if classes else 0.0)
    found = F.when(score > 0.5, "block").otherwise("allow")
    return ready.select(
        "page_id", "host", "path", "rule", F.coalesce(said, found).alias("verdict"), score.cast("double").alias("block_score")
    )


def op2_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))
