"""URL filtering by mined association rules, with DataFrame functions alone.

A URL becomes a set of tokens (host labels and suffixes, path words, file ending, query names, fragment). FP-growth over
the URLs that have labels finds token combinations that go with a bad label; rules of enough confidence and support
stay, unless a smaller rule does as well. Rules match through an inverted index: each rule is listed under its rarest
token, a URL's tokens join those, and a rule holds when the URL has all its tokens. The index is broadcast while it has
few rows; a longer one is joined with salt, so that tokens of very many URLs spread. Allow and block rules given by the
caller come first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sparkio import materialise, partitions

BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_COUNT = 25  # labelled URLs that a rule needs, at every size of the table
MIN_CONFIDENCE = 0.6
LIFT = 1.5
MAX_DEPTH = 3  # host labels that give suffix tokens
SMALL_INDEX = 50_000  # rules; an index of at most as many rows is broadcast
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The URL's distinct tokens; none for a null URL or one without ://. Numbers count as one token."""
    host, path = host_of(url), path_of(url)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1), F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), lambda n: F.when(F.size(labels) >= n, F.concat(F.lit("domain="), F.array_join(F.slice(F.reverse(labels), 1, n), "."))))
    words = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[/._-]+"), lambda x: x != "")
    named = F.transform(words, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("path=#")).otherwise(F.concat(F.lit("path="), x)))
    names = F.transform(F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    fragment = F.array(F.when(rest.contains("#"), F.lit("fragment")))
    ending = F.array(F.when(path.rlike("/$"), F.lit("slash")))
    parts = F.concat(F.transform(labels, lambda x: F.concat(F.lit("host="), x)), suffixes, named, names, fragment, ending)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(parts)))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) from URLs with a boolean label.

    At least min_count labelled URLs hold the tokens and the bad label together; a rule's confidence must reach
    min_confidence and lift times the share of bad ones. A rule falls away if one on fewer of its tokens is as
    confident. Rows with a null label are passed over; without any labelled row there is no rule.
    """
    rows = labelled.where(F.col(bad_col).isNotNull()).select(F.col(bad_col).cast("boolean").alias("bad"), tokens_of(F.col(url_col)).alias("found"))
    rows = rows.select("bad", F.when(F.col("bad"), F.array_append("found", BAD)).otherwise(F.col("found")).alias("items"))
    rows = materialise(rows, "url-items")
    empty = rows.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    total, bad = rows.agg(F.count("*"), F.count_if("bad")).head()
    if not bad:
        return empty
    if bad < min_count:
        return empty
    need = max(min_confidence, lift * bad / total)
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / total, minConfidence=min(need, 1.0), numPartitions=partitions(rows.sparkSession)).fit(rows)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & (F.col("confidence") >= need))
    found = materialise(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-rules")
    smaller = found.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("as_good"))
    # Subsets share their first token in some position, so rules meet by token, not each with each.
    a = found.select("*", F.explode("tokens").alias("token"))
    b = smaller.select("*", F.element_at("fewer", 1).alias("token"))
    redundant = a.join(b, "token").where((F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("as_good") >= F.col("confidence"))).select("tokens").distinct()
    kept = found.join(redundant, "tokens", "left_anti")
    return materialise(kept.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support"), "url-rules")


def match(urls: DataFrame, rules: DataFrame, url_col: str = "url", small: int = SMALL_INDEX) -> DataFrame:
    """Each distinct URL that some rule holds for, with the most confident rule's tokens (ties: the first in order)."""
    found = urls.select(F.col(url_col).alias("url")).distinct().select("url", tokens_of(F.col("url")).alias("found"))
    # A rule's rarest token among the rules stands for it; tokens that few rules have tend to be rare in URLs, too.
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule_id", "confidence", "tokens", F.explode("tokens").alias("token")).join(often, "token")
    index = materialise(each.groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("confidence").alias("confidence"), F.first("tokens").alias("tokens")), "url-index")
    rows = found.select("url", "found", F.explode("found").alias("token"))
    if index.count() <= small:
        met = rows.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    held = met.where(F.size(F.array_except("tokens", "found")) == 0)
    return held.groupBy("url").agg(F.min_by("tokens", F.struct(-F.col("confidence"), "rule_id")).alias("mined"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, given: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the tokens of the rule that blocks) of every row.

    given: (verdict, host, path) rules; one fits its host and all subdomains where the path starts with its path, and
    the longest decides. Elsewhere a mined rule blocks and the rest is allowed. A null URL or one without :// has an
    empty host and path, no tokens, and is allowed. Repeated rows give equal rows; null ids stay; an empty table gives
    an empty result; other columns are ignored. A very long URL has as many tokens as it has parts.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    blocked = match(rows, rules)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, host, path in sorted(given, key=lambda r: len(r[1] + r[2])):  # longer ones later, so outermost
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    out = rows.join(blocked, "url", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")
