"""URL filters: rules first, then logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table, by default LABELLED below. n-grams of
host and path are built by SQL functions, hashed and weighed by Spark's own ML library in
the JVM; judging a table is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
FEATURES = 1 << 16
GRAMS = (3, 4, 5)
MOST_LABELLED = 100_000

UNWANTED = (
    "casino win free bets spam farm cheap pills ads track adult poker slots jackpot viagra loan cash prize lottery porn xxx "
    "escort betting pharmacy replica click banner popup tracker adserver sex cams dating weightloss payday"
).split()
WANTED = (
    "news library weather museum garden recipes travel history music science books school city university journal health "
    "sports photo maps forum docs wiki shop film theatre nation there other then than thing station lesson reader under "
    "notion mention thread third theory winter father letter answer region section estate island table marble noble stable "
    "cable bible tension ration reason season person written listen hidden seven eleven sister master water matter fish "
    "wash british english flash spring string king morning evening building reading teaching tradition edition action "
    "question portion youth north south health width tooth earth worth another either whether where threshold shell "
    "finish polish land stand hand brand friend trend blend london berlin paris madrid anthem ethanol enter render tender "
    "order border herald heron hero here areas react read ready great treat sweat beat atlas atom station athens "
    "fashionable reasonable questionable notable tolerable terrible possible flexible visible response onion union opinion"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url and label (1: unwanted): one or two words of a kind make a host; only unwanted ones are joined by hyphens."""
    frames = [("", "com", "/en/1234"), ("www.", "net", "/de/77.html"), ("m.", "org", "/"), ("blog.", "example.net", "/fr/9/"), ("www.", "example.org", "/es/200")]
    rows = []
    for label, names in ((1, UNWANTED), (0, WANTED)):
        mark = "-" if label else ""
        hosts = [f"{name}{mark}{names[(i + step) % len(names)]}" for i, name in enumerate(names) for step in ((1, 2, 3, 4) if label else (1,))]
        rows += [(f"https://{front}{host}.{top}{path}", label) for host in names + hosts for front, top, path in frames]
    return spark.createDataFrame(sorted(set(rows)), "url string, label int")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    found = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(found, F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _with_features(urls: DataFrame) -> DataFrame:
    """Add host, path and grams: n-grams of both; digits and punctuation are a mark between words."""
    urls = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    whole = F.regexp_replace(F.concat(F.lit("/"), "host", F.lower("path"), F.lit("/")), r"[\x00-\x60\x7b-\x7f]+", "_")
    urls = urls.withColumn("whole", whole)
    grams = [
        F.transform(F.sequence(F.lit(1), F.greatest(F.length("whole") - n + 1, F.lit(1))), lambda i, n=n: F.substring("whole", i, F.lit(n)))
        for n in GRAMS
    ]
    return urls.withColumn("grams", F.array_distinct(F.concat(*grams)))


def train(labelled: DataFrame):
    """The model of labelled(url, label); a table larger than MOST_LABELLED rows is refused."""
    labelled = _with_features(labelled.select("url", F.col("label").cast("double").alias("label"))).coalesce(1)
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if sum(counts.values()) > MOST_LABELLED:
        raise ValueError("the labelled table is meant to be small")
    weight = F.when(F.col("label") == 1, 1 / max(1, counts.get(1.0, 0))).otherwise(1 / max(1, counts.get(0.0, 0)))
    labelled = labelled.withColumn("weight", weight)  # both labels weigh alike
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
        LogisticRegression(weightCol="weight", regParam=0.003, maxIter=100, standardization=False),
    ]
    return Pipeline(stages=stages).fit(labelled)


def rule_of(rules: tuple[tuple[str, str], ...], value: str) -> Column:
    """The longest rule that fits (`rule`) or its verdict (`verdict`); null without one.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    choices = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit(slash + rest))
        out = F.lit(rule if value == "rule" else verdict)
        choices = F.when(fits, out) if choices is None else choices.when(fits, out)
    return F.lit(None).cast("string") if choices is None else choices


def judge(pages: DataFrame, key: str = "page_id", labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """key, host, path, rule, verdict and score (chance of being unwanted) of every row of pages(key, url, ...).

    A null url, or one without ://, has an empty host and path, fits no rule and gets the
    model's verdict on nothing but the bias. Repeated rows are judged alike.
    """
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    rows = _with_features(pages.select(F.col(key).alias("key"), "url"))
    scored = model.transform(rows).withColumn("score", F.round(F.element_at(vector_to_array("probability"), 2), 6))
    verdict = F.coalesce(rule_of(rules, "verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("key").alias(key), "host", "path", rule_of(rules, "rule").alias("rule"), verdict.alias("verdict"), "score")

