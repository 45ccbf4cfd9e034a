"""URL filters: rules by host and path, and a logistic regression for what no rule decides.

DataFrame and SQL functions throughout. Features are character n-grams of host and path,
hashed into a fixed number of buckets; the weights are learned from a small labelled
table of URLs by gradient steps that are aggregations over its rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules, (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# Names of the labelled table's sites, 1 for unwanted: what such sites are commonly called, none taken from a corpus.
UNWANTED = ["royal-casino", "casinoroom", "poker-night", "jackpot-spins", "roulette-live", "slots-bonus", "sports-bets", "betting-odds", "bet-bonus", "lotto-cash",
            "adult-dates", "adultvideo", "porn-tube", "sex-chat", "xxx-films", "nude-cams", "diet-pills", "pills-online", "cheap-meds", "viagra-deal",
            "spam-mailer", "bulk-spam", "link-farm", "backlinks-buy", "popup-ads", "ads-server", "adclick", "click-track", "tracker-pixel", "warez-cracks",
            "keygen-serials", "payday-loans", "fast-money", "win-prizes", "free-iphone", "crypto-doubler"]
WANTED = ["school", "museum", "recipes", "history", "garden", "science", "travel", "music", "market", "health", "books", "river-news", "daily-post", "university",
          "city-council", "open-data", "bird-watching", "orchestra", "bakery", "cycling-club", "theatre", "northern-times", "photo-archive", "weather-station",
          "mountain-huts", "linux-notes", "chess-league", "railways", "astronomy", "painters", "language-lab", "harbour", "farm-journal", "tracking-birds",
          "advent-calendar", "winter-sports"]
SEED_SITES = ["http://{}.com/{}", "https://www.{}.org/articles/{}.html", "https://{}.co.uk/index.php?id={}", "http://shop.{}.info/{}/"]

PAGES_EACH = 6        # pages of each labelled site, so that no number marks a site
BUCKETS = 1 << 14
SIZES = (3, 4, 5)
CUTOFF = 0.5


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none fits. Ties: the rule listed first.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: -len(r[1]))[::-1]:
        own, slash, below = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def ngrams(s: Column, tag: str, sizes=SIZES) -> Column:
    """All runs of characters of a text between two marks, told apart by tag."""
    marked = F.concat(F.lit("^"), s, F.lit("$"))

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
        grams = F.transform(places, lambda i: F.concat(F.lit(tag), F.substring(marked, i, F.lit(n))))
        return F.when(F.length(marked) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes))


def with_features(urls: DataFrame) -> DataFrame:
    """Adds `features`: which n-grams of `host` and `path` occur."""
    grams = urls.withColumn("grams", F.concat(ngrams(F.col("host"), "h"), ngrams(F.col("path"), "p")))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True).transform(grams).drop("grams")


def labelled_urls(spark: SparkSession, path: str | None = None, names: list[tuple[str, int]] | None = None) -> DataFrame:
    """(url, label): the small labelled table, read from `path` (Parquet) or made of `names`, by default the fixed values above."""
    if path is not None:
        return spark.read.parquet(path).select("url", F.col("label").cast("double").alias("label"))
    names = [(n, y) for y, ns in ((1, UNWANTED), (0, WANTED)) for n in ns] if names is None else names
    sites = F.array(*map(F.lit, SEED_SITES))
    rows = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(y)).alias("label")) for n, y in names))).alias("n")).select("n.*", F.explode(sites).alias("site")) \
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(PAGES_EACH))).alias("page"))
    number = F.pmod(F.hash("name", "site", "page"), F.lit(1000)).cast("string")
    return rows.select(F.replace(F.regexp_replace("site", r"(.*)\{\}", "$1#"), F.lit("{}"), F.col("name")).alias("url"), number.alias("number"), "label") \
        .select(F.replace("url", F.lit("#"), F.col("number")).alias("url"), "label")


def train(labelled: DataFrame, regularised: float = 0.01):
    """Weights from (url, label); rows with null labels are left out. The table is small, whatever the pages."""
    rows = labelled.where("label is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=60, regParam=regularised, elasticNetParam=0.0, standardization=False).fit(with_features(rows.coalesce(1)))


def judge(pages: DataFrame, model, rules=RULES, cutoff: float = CUTOFF) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every url.

    score is the method's probability that a URL is unwanted; a rule that fits decides over it.
    A null url, or one without ://, has an empty host and path and is judged by the method.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(with_features(urls)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= cutoff, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled_urls(spark)))
