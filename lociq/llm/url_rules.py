"""URL filters: listed rules, and association rules mined from labelled pages.

A URL is a set of tokens: its host and parent domains, its path segments and the names of its query
fields, however many.  FP-growth counts token combinations among labelled URLs; a combination whose
URLs are bad with enough confidence, and often enough, is a rule, unless a smaller combination is
at least as confident.  Tokens that the same labelled URLs have are counted as one, so a long URL
that many share does not multiply combinations.  Rules match by an inverted index: each is filed under its rarest token, a
URL looks up its own tokens and then checks the whole combination.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from lociq.llm.common import UPPER, LOWER, Stages, plain

#: ``(action, rule)``; a rule is host and path prefix.
LISTED = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Copies of each index entry, so that a token of a third of all URLs meets them in many tasks.
SLICES = 32
BAD = "!bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null urls and those without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its action; null where none does.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    rule = action = None
    for act, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        action = F.when(fits, F.lit(act)) if action is None else action.when(fits, F.lit(act))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, action)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens ``h:domain``, ``p:segment`` (numbers as ``#``) and ``q:field``."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), size),
        lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, size - k + 1, k), ".")),
    )
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    numbers = F.transform(segments, lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, r"\d+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    fields = F.filter(F.split(query, "&"), lambda f: f != "")
    names = F.transform(fields, lambda f: F.concat(F.lit("q:"), F.substring_index(f, "=", 1)))
    return F.when(host != "", F.array_distinct(F.concat(domains, numbers, names))).otherwise(F.array().cast("array<string>"))


def token_classes(urls: DataFrame, min_support: float) -> DataFrame:
    """``(first, members)``: tokens that at least ``min_support`` of the URLs have, by the URLs they occur in.

    A class goes by its first token.  Sets of URLs are compared by their size and two 64-bit hashes.
    There are at most (tokens a URL) / ``min_support`` tokens, whatever the input.
    """
    least = math.ceil(min_support * urls.count())
    rows = urls.withColumn("url", F.monotonically_increasing_id()).select("url", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("url", F.lit(k))).alias(f"sign{k}") for k in range(2)]
    )
    classes = held.where(F.col("n") >= least).groupBy("n", "sign0", "sign1").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return classes.select(F.element_at("members", 1).alias("first"), "members")


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """``(rule_id, items, choices, confidence, support)`` from ``(tokens, bad)``.

    A rule has at least ``min_support`` of the labelled URLs behind it and ``min_confidence`` of
    them bad, and no part of it is as confident.  No labelled rows give no rules.

    A rule with two tokens of one class has a part as confident, so only first tokens are mined
    (``items``); the rules found hold for any member of each class (``choices``).
    """
    stages = Stages(labelled.sparkSession, "mined")
    urls = labelled.where(F.size("tokens") > 0)
    classes = stages.keep(token_classes(urls, min_support), "classes")
    # The empty token keeps URLs without frequent ones, which count towards the support.
    marks = F.when(F.col("bad"), F.array(F.lit(""), F.lit(BAD))).otherwise(F.array(F.lit("")))
    rows = urls.withColumn("url", F.monotonically_increasing_id()).select("url", F.explode(F.concat("tokens", marks)).alias("token"))
    firsts = classes.select(F.col("first").alias("token"))
    marked = firsts.unionByName(firsts.sparkSession.createDataFrame([("",), (BAD,)], "token string"))
    rows = rows.join(F.broadcast(marked), "token", "left_semi").groupBy("url").agg(F.collect_list("token").alias("items"))
    items = stages.keep(rows.select(F.array_remove("items", "").alias("items")), "items")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    found = found.select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    part = found.select(F.col("items").alias("part"), F.col("confidence").alias("part_confidence"))
    # A rule's parts are looked up through their first item, not against every other rule.
    longer = found.withColumn("key", F.explode("items")).join(
        part.withColumn("key", F.element_at("part", 1)), "key"
    ).where(
        (F.size("part") < F.size("items"))
        & (F.col("part_confidence") >= F.col("confidence"))
        & (F.size(F.array_except("part", "items")) == 0)
    )
    rules = found.join(longer.select("items").distinct(), "items", "left_anti").withColumn("first", F.explode("items"))
    # A rule stays one rule on classes: each of its choices is a list of tokens of which one is enough.
    choices = rules.join(classes, "first").groupBy("items", "confidence", "support").agg(
        F.array_sort(F.collect_list("members")).alias("choices")
    )
    return choices.withColumn("rule_id", F.array_join(F.transform("choices", lambda m: F.array_join(m, "|")), " "))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under every token of the choice that fewest of the labelled URLs have, once per slice."""
    often = tokens.select(F.explode("tokens").alias("token")).groupBy("token").count()
    filed = rules.select("rule_id", F.explode("choices").alias("choice"))
    # Tokens of a choice are held by the same labelled URLs, so its first one shows how often.
    filed = filed.withColumn("token", F.element_at("choice", 1)).join(often, "token", "left")
    rarest = filed.groupBy("rule_id").agg(F.min_by("choice", F.struct(F.coalesce("count", F.lit(0)), "choice")).alias("choice"))
    indexed = rules.join(rarest, "rule_id").withColumn("token", F.explode("choice")).drop("choice")
    return indexed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    listed: Sequence[tuple[str, str]] = LISTED,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule``, one row per page.

    A page is bad when the document of its id is labelled toxic or of no quality; several labels
    of an id count as one, bad if any is.  A listed rule decides where one fits, otherwise a mined
    rule blocks and no rule allows.  Pages without a host have no tokens and are allowed.  Rows
    that repeat an id are judged one by one.
    """
    stages = Stages(pages.sparkSession, "url")
    host, path = host_and_path(F.col("url"))
    rule, action = listed_rule(F.col("host"), F.col("path"), listed)
    urls = (
        plain(pages, "page_id", "url")
        .withColumns({"host": host, "path": path})
        .withColumns({"rule": rule, "action": action, "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))})
    )
    urls = stages.keep(urls.drop("url").withColumn("row", F.monotonically_increasing_id()), "urls")
    # The URL side grows with the pages and its written size understates it: merge, do not broadcast.
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    known = plain(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    labelled = stages.keep(urls.join(known.hint("merge"), F.col("page_id") == F.col("doc_id")).select("tokens", "bad"), "labelled")
    rules = stages.keep(mine_rules(labelled, min_support, min_confidence), "rules")
    index = rule_index(rules, labelled)

    probes = urls.where(F.col("rule").isNull()).select(
        "row", "tokens", F.explode("tokens").alias("token"), F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int").alias("slice")
    )
    hits = probes.join(index.hint("merge"), ["token", "slice"]).where(F.forall("choices", lambda c: F.arrays_overlap(c, F.col("tokens"))))
    best = hits.groupBy("row").agg(F.max_by("rule_id", F.struct("confidence", "support", "rule_id")).alias("mined_rule"))
    judged = urls.join(best.hint("merge"), "row", "left")
    verdict = F.coalesce("action", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule")
