"""URL filter: an explicit rule list first, and gradient-boosted trees on lexical features for all other URLs.

Features are built-in column expressions: lengths of the URL, host and path, depth, numbers of labels, hyphens, digits and parameters, share
of digits, character entropy, scheme and fragment, and statistics of the suffix (the host's last label): the
frequency of the suffix among all URLs and the smoothed share of blocked ones among the labelled sample. The trees are MLlib's, fitted on
the executors; scoring is a projection.

Rules are written ``host/path``. A rule fits its host and all subdomains of it if the URL's path starts with the rule's path; the longest
fitting rule wins. The rules are compiled into the projection, so their number is a parameter of the plan (``MAX_RULES``).

Scale: URLs are read once for the counts by suffix (partial aggregates: a suffix that a third of all rows share is one row per task), once for the
sample, once for the scores. The sample is bounded: at most ``TRAIN_ROWS`` rows, of each verdict the half with the smallest hashes among distinct URLs, so a URL that most rows repeat is one row
and a rare verdict is learned. In training a suffix's share of blocked URLs comes from the other folds.
The suffix table joins by Spark's own choice; adaptive execution splits a hot suffix.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is scored by its features; repeated rows are judged
each on its own; a URL labelled with both verdicts teaches both; null labelled URLs teach nothing; without labelled URLs of both verdicts the method's verdict is the only labelled one, or allow; an empty table gives no rows.
Columns of the input named host, path, rule, verdict or score are replaced, all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

TRAIN_ROWS = 10_000
TREES, DEPTH = 20, 4
MAX_RULES = 1000
FOLDS = 5  # of training rows, for the share of blocked ones of a suffix
PRIOR_ROWS = 20.0  # rows of the overall share that a suffix's share is smoothed with
ADDED = ("host", "path", "rule", "verdict", "score")


@dataclass(frozen=True)
class Rule:
    text: str  # host/path
    verdict: str  # allow or block

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


RULES = (Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"),
         Rule("com/fr/", "allow"), Rule("com/de/", "block"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The fitting rule's text and verdict, null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: join them as a table")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    host, path = F.col("host"), F.col("path")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later ones, the longer, cover earlier ones
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def count_of(c: Column, pattern: str) -> Column:
    """Characters of a class in a text."""
    return (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))).cast("double")


def entropy(c: Column) -> Column:
    """Bits per character."""
    n = F.length(c).cast("double")
    share = F.transform(F.array_distinct(F.split(c, "")),
                        lambda x: (n - F.length(F.replace(c, x))) / n)
    return F.when(n > 0, -F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(F.lit(0.0))


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digits", "digit_share", "entropy",
            "parameters", "query_length", "secure", "fragment", "extension", "suffix_share", "suffix_blocked")


def features(df: DataFrame, url_col: str) -> DataFrame:
    """Add the lexical features (all but the suffix statistics) and ``__suffix``; host and path must be there."""
    url, host, path = F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.col("host"), F.col("path")
    asked = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    length = F.length(url).cast("double")
    digits = count_of(url, "[0-9]")
    return df.withColumns({
        "url_length": length, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "labels": count_of(host, "[.]"), "hyphens": count_of(host, "[-]"), "digits": digits,
        "digit_share": F.when(length > 0, digits / length).otherwise(F.lit(0.0)), "entropy": entropy(url),
        "parameters": F.when(asked != "", count_of(asked, "&") + 1).otherwise(F.lit(0.0)),
        "query_length": F.length(asked).cast("double"),
        "secure": F.when(F.lower(F.substring(url, 1, 6)) == "https:", 1.0).otherwise(0.0),
        "fragment": F.when(F.instr(url, "#") > 0, 1.0).otherwise(0.0),
        "extension": F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), 1.0).otherwise(0.0),
        "__suffix": F.element_at(F.split(host, "[.]"), -1),
    })


def training_sample(known: DataFrame, seed: int) -> DataFrame:
    """Of each verdict the ``TRAIN_ROWS`` / 2 distinct URLs of smallest hash (all, if there are fewer).

    A sketch counts the distinct URLs of each verdict; URLs whose hash is far beyond what the quota can reach go before any shuffle.
    """
    quota = TRAIN_ROWS // 2
    size = {r["verdict"]: r["n"] for r in known.groupBy("verdict").agg(F.approx_count_distinct("url", 0.02).alias("n")).collect()}
    place = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 40)) / (1 << 40)
    parts = []
    for verdict in ("allow", "block"):
        share = min(1.0, 2 * quota / max(1, size.get(verdict, 0)) + 1e-9)
        own = known.where((F.col("verdict") == verdict) & (place < share)).withColumn("__place", place)
        parts.append(own.dropDuplicates(["url"]).orderBy("__place", "url").limit(quota).drop("__place"))
    return parts[0].unionByName(parts[1])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None, url_col: str = "url",
          seed: int = 10) -> DataFrame:
    """All rows with host, path, rule, verdict and score (the trees' probability of block).

    ``labelled``: (url, verdict) to learn from; None takes the URLs that the rules decide.
    """
    spark = pages.sparkSession
    shared_dir(spark)  # MLlib's checkpoints go there
    pages = pages.drop(*ADDED)
    url = F.col(url_col).cast("string")
    rule, decided = ruled(rules)
    parsed = pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumns({"rule": rule, "__ruled": decided})
    if labelled is None:
        known = parsed.where(F.col("__ruled").isNotNull()).select(url.alias("url"), "host", "path", F.col("__ruled").alias("verdict"))
    else:
        known = labelled.where(F.col("url").isNotNull()).select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
    train = features(training_sample(known, seed), "url").withColumns({
        "label": F.when(F.col("verdict") == "block", 1.0).otherwise(0.0),
        "__fold": F.pmod(F.xxhash64("url", F.lit(seed + 1)), F.lit(FOLDS))}).checkpoint()
    counts = {r["verdict"]: r["n"] for r in train.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (counts.get("allow") and counts.get("block")):
        only = "block" if counts.get("block") else "allow"
        return parsed.select(*pages.columns, "host", "path", "rule", F.coalesce("__ruled", F.lit(only)).alias("verdict"),
                             F.lit(1.0 if only == "block" else 0.0).alias("score"))
    prior = counts["block"] / sum(counts.values())
    by_fold = train.groupBy("__suffix", "__fold").agg(F.count(F.lit(1)).alias("__in"), F.sum("label").alias("__ib"))
    learned = by_fold.groupBy("__suffix").agg(F.sum("__in").alias("__n"), F.sum("__ib").alias("__b"))
    seen = features(parsed, url_col).groupBy("__suffix").agg(F.count(F.lit(1)).alias("__all")).checkpoint()
    total = seen.agg(F.sum("__all")).scalar()

    def blocked(n, b):
        return (F.coalesce(b, F.lit(0.0)) + prior * PRIOR_ROWS) / (F.coalesce(n, F.lit(0)) + PRIOR_ROWS)

    suffixes = (seen.join(learned, "__suffix", "left")
                .select("__suffix", (F.col("__all") / total).alias("suffix_share"),
                        blocked(F.col("__n"), F.col("__b")).alias("suffix_blocked"))).checkpoint()
    # a training row's suffix is judged by the other folds: its own label must not speak through it
    others = by_fold.join(learned, "__suffix").select(
        "__suffix", "__fold", blocked(F.col("__n") - F.col("__in"), F.col("__b") - F.col("__ib")).alias("suffix_blocked"))

    def complete(df):
        return df.join(suffixes, "__suffix", "left").fillna(0.0, ["suffix_share"]).fillna(prior, ["suffix_blocked"])

    train = (train.join(suffixes.drop("suffix_blocked"), "__suffix", "left").fillna(0.0, ["suffix_share"])
             .join(others, ["__suffix", "__fold"], "left"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
    sample = assembler.transform(train).select("__features", "label").coalesce(4).cache()
    model = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed,
                          predictionCol="__prediction").fit(sample)
    model.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    sample.unpersist()
    out = model.transform(assembler.transform(complete(features(parsed, url_col))))
    score = vector_to_array("__probability")[1]
    return out.select(*pages.columns, "host", "path", "rule",
                      F.coalesce("__ruled", F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                      score.alias("score"))


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
