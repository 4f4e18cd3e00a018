"""URL filtering by association rules, under explicit rules for hosts and paths.

FP-growth mines combinations of URL tokens together with the label of a page; rules whose
consequent is the label and that reach the support and confidence become block rules. Only tokens
that reach the support on bad pages can be part of one, and tokens that stand on the very same
labelled pages count as one (a rule with any of them says what a rule with all of them says), so
that long stretches that a family of URLs shares do not multiply. Pages find the rules through an
inverted index: each rule stands under that of its tokens which the fewest pages have, the page's
tokens are joined with that index, and a rule fires if the page has all its tokens.

A null URL, or one without `://`, has an empty host and path; its tokens are still matched (null
has none). Labels: repeated rows of a page count once, as bad if any is bad; null label values
are not bad. With no labels there are no mined rules. Every page row gives one row; repeated
page ids each get their own. Empty tables give an empty result, or no mined rules. Other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BAD = "\x00bad"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct alphanumeric runs in lower case; numbers count as one token."""
    found = F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x)))


def merged(pages: DataFrame, labels: DataFrame, min_support: float) -> DataFrame:
    """token, stands_for: the tokens that may be part of a rule, and for each the least token of those on the same labelled pages.

    At most (tokens of a URL) / min_support rows, whatever the number of pages.
    """
    known = _known(pages, labels).select("page_id", "bad", F.explode(tokens(F.col("url"))).alias("token"))
    least = min_support * _known(pages, labels).count()
    each = known.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("page_id").cast("decimal(38,0)")).alias("of"), F.count_if("bad").alias("bad")).where((F.col("bad") >= least) & (F.col("bad") > 0))
    return each.select("token", F.min("token").over(Window.partitionBy("of", "n")).alias("stands_for"))


def _known(pages: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    return pages.select("page_id", "url").join(known, F.col("page_id") == F.col("doc_id"))


def mapped(found: Column, same: dict[str, str]) -> Column:
    """Tokens by what they stand for; others fall out."""
    if not same:
        return F.array().cast("array<string>")
    names = F.create_map(*(F.lit(x) for pair in sorted(same.items()) for x in pair))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.try_element_at(names, t)), lambda t: t.isNotNull()))


def mined(pages: DataFrame, labels: DataFrame, min_support: float, min_confidence: float, same: dict[str, str]) -> DataFrame:
    """rule_id, tokens, confidence and support of the rules tokens -> bad.

    pages: page_id, url. labels: doc_id, bad. same: what tokens stand for, see merged().
    """
    seen = _known(pages, labels).select(F.array_union(mapped(tokens(F.col("url")), same), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(seen).associationRules
    rules = rules.where(F.col("consequent")[0] == BAD).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    return rules.withColumn("rule_id", F.xxhash64("tokens"))


def pruned(rules: DataFrame) -> DataFrame:
    """Without the rules that only add tokens to another that is at least as sure."""
    wide = rules.where(F.size("tokens") > 1).select(F.col("rule_id").alias("wide"), F.col("tokens").alias("all"), F.col("confidence").alias("own"), F.explode("tokens").alias("token"))
    small = rules.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("need"), F.col("confidence").alias("sure"))
    drop = wide.join(small, "token").where((F.size("need") < F.size("all")) & (F.col("sure") >= F.col("own")) & (F.size(F.array_except("need", "all")) == 0))
    return rules.join(drop.select(F.col("wide").alias("rule_id")).distinct(), "rule_id", "left_anti")


def matched(pages: DataFrame, rules: DataFrame, key: str, same: dict[str, str]) -> DataFrame:
    """key, confidence, n_rules: the best of the rules whose tokens a page has all."""
    has = pages.select(key, mapped(tokens(F.col("url")), same).alias("tokens")).withColumn("token", F.explode("tokens"))
    share = has.groupBy("token").count()
    each = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    rarest = each.join(share, "token", "left").withColumn("k", F.row_number().over(Window.partitionBy("rule_id").orderBy("count", "token"))).where("k = 1").select("token", F.col("tokens").alias("need"), "confidence")
    hits = has.join(rarest, "token").where(F.size(F.array_except("need", "tokens")) == 0)
    return hits.groupBy(key).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_rules"))


def explicit(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, rest = text.partition("/")
        fits = ((h == site) | h.endswith("." + site)) & p.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_filter(spark: SparkSession, pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, confidence, n_rules: explicit rules first, else block where a mined rule fires.

    pages: page_id, url. labels: doc_id, bad (boolean).
    """
    urls = pages.select("page_id", "url")
    same = {r["token"]: r["stands_for"] for r in merged(urls, labels, min_support).collect()}
    found = written(spark, pruned(mined(urls, labels, min_support, min_confidence, same)), "rules")
    # equal urls are matched once
    hits = matched(urls.select("url").distinct(), found, "url", same)
    out = urls.join(hits, "url", "left")
    rule, verdict = explicit(host(F.col("url")), path(F.col("url")), rules)
    return out.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence", F.coalesce("n_rules", F.lit(0)).alias("n_rules"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad pages: labelled toxic or of low quality."""
    bad = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_filter(spark, table(spark, sf_dir, "pages"), bad).select("page_id", "host", "path", "rule", "verdict", "confidence", "n_rules")
