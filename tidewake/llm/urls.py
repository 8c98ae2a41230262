"""URL filter: prefix rules first, then an empirical-Bayes reputation of the host, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import lower_ascii, salted_left_join
from tidewake.scratch import saved

# Fixed values: (verdict, host, path) of the rules; the longest rule that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A host is blocked if the lower bound of its bad-page rate (mean - Z posterior deviations) is above LIFT times the rate of
#: all pages: if it is worse than the rest, and not by chance.
Z, LIFT = 1.645, 1.0
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (itself or a subdomain) and path prefix; NULLs without one."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> tuple[float, float]:
    """(m, p): the prior strength by moments of a level's group rates, and the pooled rate.

    The spread of group rates around the pooled rate, less what sampling alone gives, is the variance of a beta
    distribution; its strength is p(1-p)/variance - 1.  One row of sums reaches the driver.
    """
    n, bad, g, sq = groups.where("n > 0").agg(F.sum("n").cast("double"), F.sum("bad"), F.count("*").cast("double"), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
    if not n:
        return MOST_STRENGTH, 0.0
    p = bad / n
    between = (sq - bad * bad / n) / n - p * (1 - p) * g / n
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, p * (1 - p) / between - 1)) if between > 0 else MOST_STRENGTH, p


def reputations(outcomes: DataFrame) -> DataFrame:
    """``outcomes(host, bad)`` (bad NULL: unlabelled) → one row per host: ``(host, n, bad, rate, bound, pooled)``.

    Every host gets a posterior: its own outcomes shrunk to its registered domain (last two labels), that to the public
    suffix (last label), and that to the pooled rate.  ``bound`` is the posterior mean less Z deviations.
    Where rates of hosts differ no more than by chance, priors are strong and no bound passes the pooled rate.
    """
    host = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    host = saved(host.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)}), "hosts")
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (hm, p), (dm, _), (sm, _) = map(_strength, (host, domain, suffix))
    s = suffix.select("suffix", ((F.col("bad") + sm * p) / (F.col("n") + sm)).alias("sp"))
    d = domain.join(s, "suffix").select("domain", ((F.col("bad") + dm * F.col("sp")) / (F.col("n") + dm)).alias("dp"))
    rate = (F.col("bad") + hm * F.col("dp")) / (F.col("n") + hm)
    out = host.join(d, "domain").select("host", "n", "bad", rate.alias("rate"), (F.col("n") + hm + 1).alias("k"))
    return out.select("host", "n", "bad", "rate", (F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("k"))).alias("bound"), F.lit(p).cast("double").alias("pooled"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bound)`` per row of ``pages``.

    A page's outcome is bad if a row of ``labels`` for its id has quality 0 or toxic 1 (of repeated labels, if any does).
    A rule's verdict stands; otherwise the host's posterior decides.  NULL url or no ``://``: host and path are empty,
    and the empty host has a reputation like any other.  NULL or repeated page_id: a row each.  Empty ``pages``: no rows.
    Urls are whole, however long.  Without labels nothing is blocked by reputation.
    """
    label = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputations(at.select("page_id", "host").join(label, "page_id", "left").select("host", "bad"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = salted_left_join(at, known.select("host", "bound", "pooled"), ["host"], F.struct("page_id", "path"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") > LIFT * F.col("pooled"), "block").otherwise("allow")).alias("verdict"), F.round("bound", 6).alias("bound"))


_CASES = "\n".join(f"    WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))


def _level(name: str) -> str:
    p, k = "bad / n", f"(sq - bad * bad / n) / n - (bad / n) * (1 - bad / n) * g / n"
    return f"(SELECT coalesce(CASE WHEN {k} > 0 THEN least({MOST_STRENGTH}::DOUBLE, greatest({LEAST_STRENGTH}::DOUBLE, ({p}) * (1 - {p}) / ({k}) - 1)) ELSE {MOST_STRENGTH}::DOUBLE END, {MOST_STRENGTH}::DOUBLE) m, coalesce({p}, 0) p FROM (SELECT sum(n)::DOUBLE n, sum(bad)::DOUBLE bad, count(*)::DOUBLE g, sum(bad * bad / n) sq FROM {name} WHERE n > 0))"


ORACLE = f"""
WITH label AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) bad FROM labels GROUP BY doc_id),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, coalesce(regexp_extract(url, '{_URL}', 2), '') path FROM pages),
host0 AS (SELECT host, count(bad) n, coalesce(sum(bad), 0)::DOUBLE bad FROM parts LEFT JOIN label ON doc_id = page_id GROUP BY host),
hosts AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') dom, string_split(host, '.')[-1] suf FROM host0),
doms AS (SELECT dom, suf, sum(n)::DOUBLE n, sum(bad) bad FROM hosts GROUP BY dom, suf),
sufs AS (SELECT suf, sum(n)::DOUBLE n, sum(bad) bad FROM doms GROUP BY suf),
ms AS (SELECT h.m hm, h.p p, d.m dm, s.m sm FROM {_level("hosts")} h, {_level("doms")} d, {_level("sufs")} s),
sp AS (SELECT suf, hm, dm, (bad + sm * p) / (n + sm) sp FROM sufs, ms),
dp AS (SELECT dom, hm, (bad + dm * sp) / (n + dm) dp FROM doms JOIN sp USING (suf)),
rates AS (SELECT host, (bad + hm * dp) / (n + hm) rate, n + hm + 1 k FROM hosts JOIN dp USING (dom)),
bounds AS (SELECT host, rate - {Z}::DOUBLE * sqrt(rate * (1 - rate) / k) bound, p FROM rates, ms)
SELECT page_id, host, path, CASE
{_CASES.format(*[f"'{h}{p}'" for _, h, p in RULES])}
END AS rule, CASE
{_CASES.format(*[f"'{v}'" for v, _, _ in RULES])}
    WHEN bound > {LIFT}::DOUBLE * p THEN 'block' ELSE 'allow' END AS verdict, round(bound, 6) AS bound
FROM parts JOIN bounds USING (host)
"""
