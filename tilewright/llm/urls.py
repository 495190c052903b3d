"""Operator 8: URL verdicts by host rules and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the query: verdict, host and path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
GRAM = 4
FEATURES = 1 << 12
#: Labelled URLs that the regression learns from, at most so many of each verdict (lowest seeded hash first).
LABELLED_EACH = 1_000
REGULARISATION = 0.001
DEFAULT = "allow"


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): see the contract; both empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of columns host and path; the longest fitting rule wins, then the first by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, marked by where they are from; ends are marked by ^ and $."""

    def of(text: Column, tag: str) -> Column:
        full = F.concat(F.lit("^"), text, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(full) - GRAM + 1)),
                           lambda i: F.concat(F.lit(tag), F.substring(full, i, F.lit(GRAM))))

    return F.concat(of(host, "h:"), of(path, "p:"))


def fit(labelled: DataFrame, features: int = FEATURES):
    """Regression on a small table (host, path, blocked 0/1); None if it lacks one of the two labels."""
    rows = labelled.select(grams(F.col("host"), F.col("path")).alias("grams"), F.col("blocked").cast("double").alias("label"))
    rows = HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features").transform(rows).cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(maxIter=50, regParam=REGULARISATION, standardization=False).fit(rows)
    finally:
        rows.unpersist()


def url_verdicts(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, labelled_each: int = LABELLED_EACH) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every url.

    A fitting rule decides; other urls go to the regression (block from probability 0.5). ``labelled`` (url, blocked)
    is its small training table; without it, urls of ``pages`` that rules label are, at most ``labelled_each`` of each
    verdict. With fewer than two labels there is no regression and the verdict is "allow". A null url or one without
    "://" has empty host and path and is judged like any other. Repeated rows and null ids keep their rows; an empty
    table gives no rows; other columns are ignored.
    """
    host, path = parsed(F.col("url").cast("string"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(rules)
    judged = own.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        seeded = F.md5(F.concat_ws("|", "host", "path"))
        ruled = judged.where("ruled is not null").select("host", "path", "ruled", seeded.alias("place"))
        train = None
        for what in ("block", "allow"):
            part = ruled.where(F.col("ruled") == what).distinct().orderBy("place").limit(labelled_each)
            part = part.select("host", "path", F.lit(int(what == "block")).alias("blocked"))
            train = part if train is None else train.union(part)
    else:
        lhost, lpath = parsed(F.col("url").cast("string"))
        train = labelled.where("blocked is not null").select(lhost.alias("host"), lpath.alias("path"), "blocked")
    model = fit(train)
    if model is None:
        p = judged.withColumn("p_block", F.lit(None).cast("double"))
    else:
        hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(
            judged.withColumn("grams", grams(F.col("host"), F.col("path"))))
        p = model.transform(hashed).withColumn("p_block", vector_to_array("probability")[1])
    method = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit(DEFAULT))
    return p.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "p_block")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
