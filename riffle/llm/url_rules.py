"""URL filters: explicit rules, and rules mined from labelled URLs.

FP-growth finds the token combinations that are frequent among bad URLs; those that are bad often
enough among all labelled URLs become rules. A rule is looked up by its rarest token.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.llm import shared

#: The ending of a token that tells where in the URL it stands.
_HOST, _PATH = "host:", "path:"


def host(url: Column) -> Column:
    """After the first ``://`` up to the path, query or fragment, A-Z in lower case; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to the query or fragment; empty without a host's ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host_name: Column, path_name: Column) -> Column:
    """Distinct tokens of a URL: labels of its host and segments of its path, marked with their place."""
    labels = F.filter(F.split(host_name, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path_name, "/"), lambda x: x != "")
    marked = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit(_HOST), x)), F.transform(segments, lambda x: F.concat(F.lit(_PATH), x))
    )
    return F.array_distinct(marked)


def explicit(host_name: Column, path_name: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest of the (verdict, host, path) rules that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The list is a parameter; the longest is tried first, at equal length the earlier.
    for decision, domain, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        below = (host_name == domain) | host_name.endswith("." + domain)
        fits = below & path_name.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def sure_share(hits: Column, total: Column, z: float) -> Column:
    """Lower bound of a share that ``hits`` of ``total`` show, by Wilson's interval of ``z`` standard errors."""
    share = hits / total
    spread = F.sqrt(share * (1 - share) / total + z * z / (4 * total * total))
    return (share + z * z / (2 * total) - z * spread) / (1 + z * z / total)


def mine(
    labelled: DataFrame,
    min_support: float,
    min_confidence: float,
    z: float = 2.58,
    bad: str = "bad",
    items: str = "tokens",
) -> DataFrame:
    """``rule, tokens, support, confidence``: token combinations that tell bad URLs.

    ``labelled`` has an array of distinct tokens and a boolean. Support is the share of the bad URLs that hold the
    combination; confidence is the share of bad ones among all labelled URLs that hold it. What guards against chance
    is a lower bound of that share, ``z`` standard errors below, which has to reach ``min_confidence``; both
    limits are the same for tables of any size. A rule of which a part is a rule at least as confident is
    pruned. Rows with a null label or null tokens are left out; no bad URL gives no rule.
    """
    spark = labelled.sparkSession
    usable = labelled.filter(F.col(bad).isNotNull() & F.col(items).isNotNull()).select(
        F.col(bad).alias("bad"), F.col(items).alias("tokens")
    )
    usable = shared.stored(usable, "labelled")
    baskets = usable.filter("bad").select("tokens")
    n = baskets.count()
    schema = "rule string, tokens array<string>, support double, confidence double"
    if not n:
        return spark.createDataFrame([], schema)
    # h hits of h show a share of h / (h + z * z), so no rarer combination can reach the bound.
    fewest = min_confidence * z * z / (1 - min_confidence) if min_confidence < 1 else n
    frequent = FPGrowth(itemsCol="tokens", minSupport=min(1.0, max(min_support, fewest / n))).fit(baskets).freqItemsets
    found = frequent.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits"))
    found = shared.stored(found.withColumn("rule", F.array_join("tokens", " ")), "itemsets")
    held = matches(usable.filter("NOT bad").withColumn("row", F.monotonically_increasing_id()), "row", found)
    fair = held.groupBy("rule").agg(F.count("*").alias("fair"))
    rules = found.join(fair, "rule", "left").withColumn("all", F.col("hits") + F.coalesce("fair", F.lit(0)))
    rules = rules.filter(sure_share(F.col("hits"), F.col("all"), z) >= min_confidence).withColumn("confidence", F.col("hits") / F.col("all"))
    rules = shared.stored(rules.select("rule", "tokens", (F.col("hits") / n).alias("support"), "confidence"), "rules")
    parts = rules.select(F.col("rule").alias("part"), F.col("tokens").alias("fewer"), F.col("confidence").alias("as_sure"))
    longer = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
    pivot = parts.withColumn("token", F.col("fewer")[0])
    pruned = longer.join(pivot, "token").filter(
        "size(fewer) < size(tokens) AND size(array_except(fewer, tokens)) = 0 AND as_sure >= confidence"
    )
    return rules.join(pruned.select("rule").distinct(), "rule", "left_anti")


def matches(urls: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """``key, rule`` for every rule whose tokens a URL all holds, through an index from each rule's rarest token.

    How rare a token is follows from the rules: the one that fewest rules hold, then by name.
    """
    held = rules.select("rule", "tokens", F.explode("tokens").alias("token"))
    often = held.groupBy("token").agg(F.count("*").alias("often"))
    index = held.join(often, "token").groupBy("rule", "tokens").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    index = index.select("rule", F.col("tokens").alias("needed"), "token")
    asked = urls.select(key, "tokens", F.explode("tokens").alias("token"))
    return asked.join(index, "token").filter("size(array_except(needed, tokens)) = 0").select(key, "rule")


def judge(
    pages: DataFrame,
    mined: DataFrame,
    rules: list[tuple[str, str, str]],
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule`` of every page.

    An explicit rule decides; else a page that a mined rule matches is blocked, and any other gets ``default``.
    ``mined_rule`` is the most confident one that matches, of equally confident ones the last by name. A null URL, or one without ``://``, has an empty host and
    path and no tokens. Repeated rows each get a row; a null id stays null. Further columns are ignored.
    """
    read = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    ruled = read.select("*", rule.alias("rule"), verdict.alias("verdict"))
    # URLs that share host and path share their tokens, so each is looked up once.
    asked = ruled.filter("verdict IS NULL").select("host", "path").distinct()
    asked = asked.withColumn("tokens", tokens(F.col("host"), F.col("path"))).withColumn("key", F.struct("host", "path"))
    hits = matches(asked, "key", mined).join(mined.select("rule", "confidence"), "rule")
    best = hits.groupBy("key").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("mined_rule"))
    best = best.select("key.host", "key.path", "mined_rule")
    judged = ruled.join(best, ["host", "path"], "left")
    fallback = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit(default))
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", fallback).alias("verdict"), "mined_rule"
    )
