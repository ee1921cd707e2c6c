"""URL filter: given rules first, then association rules mined from what those rules label."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from slopeweave.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_SUPPORT = 0.01
LEAST_CONFIDENCE = 0.7
BROADCAST_RULES = 50_000
DEFAULT = "allow"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host_name: Column, url_path: Column) -> Column:
    """Whether a rule such as ``example.com/en/`` fits: its host or a subdomain, and a path that starts with the rule's."""
    name, _, rest = rule.partition("/")
    return ((host_name == name) | host_name.endswith("." + name)) & url_path.startswith("/" + rest)


def by_rules(rules: dict[str, str], host_name: Column, url_path: Column) -> tuple[Column, Column]:
    """The longest fitting rule (ties: the first by name) and its verdict; null where none fits."""
    rule = verdict = F
    for i, name in enumerate(sorted(rules, key=lambda r: (-len(r), r))):
        fit = fits(name, host_name, url_path)
        rule = F.when(fit, name) if i == 0 else rule.when(fit, name)
        verdict = F.when(fit, rules[name]) if i == 0 else verdict.when(fit, rules[name])
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column, host_name: Column, url_path: Column) -> Column:
    """Distinct tokens of a url: labels of its host, segments of its path, names of its query's
    parameters, and the scheme. Digits count as ``0``."""
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), F.regexp_replace(p, r"\d+", "0")))
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        tag("scheme:", F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        tag("host:", F.split(host_name, r"\.")),
        tag("path:", F.split(url_path, "/")),
        tag("query:", F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, r"(?s)^([^=]*)", 1)))))


def mine(labelled: DataFrame, least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rules ``antecedent, size, key, verdict, confidence, support`` from ``labelled (tokens, verdict)``.

    FP-growth finds the frequent combinations of tokens and verdict. Tokens below the support cannot be in
    one and are left out before. A rule stays with enough support and confidence, unless leaving out one
    token of its antecedent leaves a rule of the same verdict with at least its confidence. ``key`` is its rarest token.
    """
    rows = cut(labelled.filter("tokens IS NOT NULL AND verdict IS NOT NULL").select("tokens", "verdict"), "labelled")
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "antecedent array<string>, size int, key string, verdict string, confidence double, support double")
    # No more than tokens-per-url / support tokens can be frequent; rarest first.
    frequent = [r["token"] for r in rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
                .filter(F.col("n") >= F.lit(least_support * total)).orderBy("n", "token").collect()]
    often = F.lit(frequent) if frequent else F.array().cast("array<string>")
    items = rows.select(F.concat(F.array_intersect("tokens", often), F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least_support, minConfidence=least_confidence).fit(items)
    rules = cut(model.associationRules.filter(F.col("consequent")[0].startswith("verdict:"))
                .filter(~F.exists("antecedent", lambda t: t.startswith("verdict:")))
                .select(F.array_sort("antecedent").alias("antecedent"), F.size("antecedent").alias("size"),
                        F.substring(F.col("consequent")[0], len("verdict:") + 1, 1 << 20).alias("verdict"), "confidence", "support"), "rules")
    parts = rules.select("verdict", F.col("antecedent").alias("all"), "confidence",
                         F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("antecedent"))
    beaten = (parts.join(rules.select("antecedent", "verdict", F.col("confidence").alias("had")), ["antecedent", "verdict"])
              .filter("had >= confidence").select(F.col("all").alias("antecedent"), "verdict").distinct())
    return (rules.join(beaten, ["antecedent", "verdict"], "left_anti")
            .select("antecedent", "size", F.array_intersect(often, "antecedent")[0].alias("key"), "verdict", "confidence", "support"))


def judge(pages: DataFrame, rules: dict[str, str], least_support: float = LEAST_SUPPORT,
          least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` of every row of ``pages (page_id, url)``.

    A given rule decides where one fits. All urls so decided are the labels from which ``mine`` learns; the mined rule with the highest confidence
    (then support, then antecedent) whose tokens a url holds decides the others, and the commonest label where none does
    (``allow`` on ties or without labels). Null urls have an empty host and path and no token. Repeated rows are judged alike.

    Matching is by an inverted index: each mined rule is listed under its rarest token only, and the
    rest of it is looked up in the url's own tokens.
    """
    spark = pages.sparkSession
    named = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = by_rules(rules, F.col("host"), F.col("path"))
    known = cut(named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"),
                             tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    labelled = known.filter("rule IS NOT NULL").select("tokens", F.col("given").alias("verdict"))
    shares = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    common = max(sorted(shares), key=lambda v: (shares[v], v == DEFAULT)) if shares else DEFAULT
    mined = cut(mine(labelled, least_support, least_confidence), "mined")
    index = mined.select("key", F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "antecedent", "verdict").alias("mined"))
    if mined.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    # Judged once per combination of tokens; the urls then look their combination up.
    open_urls = known.filter("rule IS NULL")
    combinations = open_urls.select("tokens").distinct()
    matched = (combinations.select("tokens", F.explode("tokens").alias("key")).join(index, "key")
               .filter(F.size(F.array_except("mined.antecedent", "tokens")) == 0)
               .groupBy("tokens").agg(F.min("mined").alias("mined")))
    rest = (open_urls.join(matched, "tokens", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("mined.verdict", F.lit(common)).alias("verdict"), (-F.col("mined.c")).alias("confidence")))
    given = known.filter("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("given").alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    return given.unionByName(rest)
