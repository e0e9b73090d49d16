"""URL filters: allow and block rules, and a character language-model ratio for the rest.

Two variable-order Markov models with Witten-Bell smoothing (orders 0 to
``ORDER``) are counted from the host and path of the urls that the rules accept
and reject.  A url without a rule is judged by the mean over its characters of
log P(accepted) - log P(rejected), against a threshold calibrated on held-out
judged urls: half way between what 95 % of either class keep to.

Only DataFrame operations: contexts are counted as strings, probabilities are
worked out once for each distinct n-gram, and urls join them by n-gram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

ORDER = 4
HELD, FOLDS = 0, 5  # urls whose hash falls in the held-out fold set the threshold and are not counted
ALPHABET = 256  # symbols of the order below 0
BROADCAST_ROWS = 200_000
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with its path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(urls: DataFrame) -> DataFrame:
    """Each url's n-grams of ORDER + 1 characters, one for each character of host and path and one for the end."""
    padded = F.concat(F.lit("\x02" * ORDER), "host", "path", F.lit("\x03"))
    return urls.withColumn("p", padded).withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - ORDER), lambda i: F.substring(F.col("p"), i, F.lit(ORDER + 1))))).drop("p")


def ratios(judged: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, r): log P(accepted) - log P(rejected) of the last character after the others, for the n-grams ``wanted`` (g).

    judged: (g, allow) with one row for each character seen in training.
    """
    yes, no = F.sum(F.col("allow").cast("long")), F.sum((~F.col("allow")).cast("long"))
    level = judged.groupBy("g").agg(yes.alias("a"), no.alias("b"))
    counts, contexts = {}, {}
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            level = level.groupBy(F.substring("g", 2, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = stored(level, "grams")
        counts[k] = level
        seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
        contexts[k] = level.groupBy(F.expr(f"substring(g, 1, {k})").alias("x")).agg(F.sum("a").alias("na"), seen("a").alias("ta"), F.sum("b").alias("nb"), seen("b").alias("tb"))
    out = wanted.withColumns({"pa": F.lit(1.0 / ALPHABET), "pb": F.lit(1.0 / ALPHABET)})
    for k in range(ORDER + 1):
        small = F.expr(f"substring(g, {ORDER + 1 - k}, {k + 1})")
        out = out.withColumn("s", small).withColumn("x", F.expr(f"substring(s, 1, {k})"))
        out = out.join(counts[k].withColumnRenamed("g", "s"), "s", "left").join(contexts[k], "x", "left")
        step = lambda n, t, c, p: F.when(F.col(n) > 0, (F.coalesce(F.col(c), F.lit(0)) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))).otherwise(F.col(p))
        out = out.select("g", step("na", "ta", "a", "pa").alias("pa"), step("nb", "tb", "b", "pb").alias("pb"))
    return out.select("g", (F.log("pa") - F.log("pb")).alias("r"))


def ruled(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(key, host, path, rule, ruled) for every row; rule and ruled are null where no rule fits."""
    rows = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("f", rule_of(F.col("host"), F.col("path"), rules)).select("_key", "host", "path", "f.rule", F.col("f.verdict").alias("ruled"))
    return rows if key in rows.columns else rows.withColumnRenamed("_key", key)


def threshold(scores: DataFrame) -> float | None:
    """Half way between the ratio that 95 % of the accepted reach and the one that 95 % of the rejected do not exceed; None without both classes.  scores: (ruled, ratio)."""
    rows = scores.where("ruled is not null").groupBy("ruled").agg(F.percentile_approx("ratio", [0.05, 0.95], 10_000).alias("q")).collect()
    fit = {r["ruled"]: r["q"] for r in rows}
    return (fit["allow"][0] + fit["block"][1]) / 2 if len(fit) == 2 else None


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(key, host, path, rule, verdict, ratio, held_out) for every row; ratio is the mean log ratio of the method.

    A fifth of the urls with a rule, by hash, is held out of the counts and sets
    the threshold (all of them, if either class has none held out).  Without urls
    judged both ways there is nothing to learn: the rest is allowed.  A null url
    or one without a scheme has empty host and path, no rule, and the verdict of
    the empty url; repeated rows are counted once and judged alike; an empty
    table gives an empty one.  The key may have any name.
    """
    rows = ruled(pages, key, url, rules)
    name = "_key" if "_key" in rows.columns else key
    # equal urls are one url: counted together, judged once
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == HELD
    urls = stored(rows.groupBy("host", "path", "ruled").agg(F.count("*").alias("n")).withColumn("held_out", fold), "urls")
    grams = _grams(urls)
    judged = grams.where("ruled is not null and not held_out").select("g", (F.col("ruled") == "allow").alias("allow"))
    # each n-gram of a url once, with how often it has it
    mine = grams.groupBy("host", "path", "g").agg(F.count("*").alias("f"))
    table = stored(ratios(judged, grams.select("g").distinct()), "ratios")
    small = table.count() <= BROADCAST_ROWS
    scores = mine.join(F.broadcast(table) if small else table, "g").groupBy("host", "path").agg((F.sum(F.col("r") * F.col("f")) / F.sum("f")).alias("ratio"))
    scores = stored(urls.join(scores, ["host", "path"]), "scores")
    line = threshold(scores.where("held_out"))
    line = threshold(scores) if line is None else line
    verdict = F.lit("allow") if line is None else F.when(F.col("ratio") >= line, "allow").otherwise("block")
    known = scores.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "ratio", "held_out", verdict.alias("_v"))
    both = rows.join(known, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")))
    return both.select(F.col(name).alias(key), *(F.col(c) for c in ("host", "path", "rule")), F.coalesce("ruled", "_v").alias("verdict"), "ratio", "held_out")


#: The rules; the verdict of the method cannot be said in SQL.
ORACLE_RULES = r"""
WITH u AS (SELECT page_id, coalesce(strpos(url, '://'), 0) AS place, url FROM pages),
p AS (SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r(name, start, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (SELECT page_id, arg_max(name || start, length(name || start)) AS rule, arg_max(verdict, length(name || start)) AS ruled
      FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT h.page_id, host, path, rule, ruled FROM h LEFT JOIN b USING (page_id)
"""
