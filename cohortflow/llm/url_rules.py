"""Operator 7, URL filters: association rules.

Fixed rules (host and path prefix) judge first, the longest one that fits.
All other URLs are judged by mined rules: the URLs of labelled pages are cut
into tokens (parts of the host, of the path and of the query), Spark's FP-growth
finds the token combinations that are frequent together with the label
"bad", and combinations of enough support and confidence become block rules.
Rules match by an inverted index: a rule is filed under its rarest token, a
URL looks up the rules of its own tokens and holds a rule if it has all its
tokens.  A page is bad if ``labels`` marks the document of its number as toxic
or of low quality.

Nulls and edge cases: a null URL or one without ``://`` has an empty host and
path, no rule and no tokens, and is allowed.  Rows that repeat a page_id are
judged each for itself.  Without labelled pages, or without a frequent
combination, nothing is mined.  An empty table gives an empty result.  Columns
other than page_id and url are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.common import BROADCAST_ROWS, query, staged, table

#: FIXED VALUES: rule, verdict.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Share of labelled URLs that hold a combination and the label, and share of the combination's URLs with the label.
SUPPORT, CONFIDENCE = 0.002, 0.6
#: URLs that hold a combination and the label, at least, whatever their share.
LEAST_URLS = 20
BAD = "label=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a ``://``."""
    after = F.when(F.locate("://", url) > 0, F.substring_index(F.substring(url, F.locate("://", url) + 3, F.length(url)), "#", 1)).otherwise("")
    after = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    host = F.substring_index(after, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.substring(after, F.length(host) + 1, F.length(after))


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits: the host or a domain above it, and a prefix of the path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens; numbers count by their length, so that pages of a site share them."""
    number = lambda t: F.regexp_replace(t, "[0-9]+", "0")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    steps = F.filter(F.split(F.lower(path), r"[/.]"), lambda x: x != "")
    ask = F.filter(F.split(F.lower(F.substring_index(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?(.*)", 1), "#", 1)), "&"), lambda x: x != "")
    parts = (("d=", labels), ("w=", words), ("p=", steps), ("q=", ask))

    def marked(prefix: str, words: Column) -> Column:
        return F.transform(words, lambda x: number(F.concat(F.lit(prefix), x)))

    return F.array_distinct(F.concat(*[marked(p, a) for p, a in parts]))


def prepared(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, tokens."""
    out = pages.select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    out = out.withColumn("host", host).withColumn("path", path)
    return out.select("page_id", "host", "path", fixed_rule(F.col("host"), F.col("path")).alias("rule"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def mine(urls: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Block rules: rule_no, tokens (array), support, confidence; staged."""
    bad = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), 1 - F.coalesce(F.col("quality"), F.lit(1)))).alias("bad"))
    items = urls.join(bad, urls["page_id"] == bad["labelled"]).select(F.when(F.col("bad") > 0, F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    items = staged(items.filter(F.size("items") > 0), "url-items")
    none = "rule_no long, tokens array<string>, support double, confidence double"
    n = items.count()
    support = max(support, LEAST_URLS / max(n, 1))
    if support > 1:
        return staged(urls.sparkSession.createDataFrame([], none), "url-rules")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    return staged(found.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_no"), F.col("antecedent").alias("tokens"), "support", "confidence"), "url-rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """page numbers ``at`` of ``urls`` (columns at, tokens) that hold a rule.
    The index files each rule under the token that the fewest URLs have."""
    own = rules.select("rule_no", "tokens", F.explode("tokens").alias("token"))
    wanted = own.select("token").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    looked = urls.select("at", "tokens", F.explode("tokens").alias("token")).join(wanted, "token")
    often = looked.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = own.join(often, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"), F.first("tokens").alias("all_of"))
    index = staged(filed.groupBy(F.col("least.token").alias("token")).agg(F.collect_list("all_of").alias("rules")), "url-index")
    small = F.broadcast(index) if rules.count() <= BROADCAST_ROWS else index
    held = looked.join(small, "token").filter(F.exists("rules", lambda r: F.size(F.array_except(r, F.col("tokens"))) == 0))
    return held.select("at").distinct()


def judge(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    urls = staged(prepared(pages).withColumn("at", F.monotonically_increasing_id()), "urls")
    rules = mine(urls.select("page_id", "tokens"), labels, support, confidence)
    open_ = urls.filter("rule is null").select("at", "tokens")
    bad = staged(matches(open_, rules).withColumn("mined", F.lit(True)), "url-bad")
    fixed = F.create_map(*[F.lit(x) for r in RULES for x in r])
    verdict = F.when(F.col("rule").isNotNull(), fixed[F.col("rule")]).when(F.col("mined"), "block").otherwise("allow")
    return urls.join(bad, "at", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


@query()
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
