"""URL filter: listed rules first, then the reputation of the host.

Labelled outcomes are counted per host and shrunk down a tree: every suffix has a beta prior around the overall share
of good pages, every registered domain one around its suffix, every host one around its domain. The strength of a
level's prior comes from the data (moments of the beta-binomial over that level's groups). A host is blocked when even
the upper posterior bound of its good share lies below ``floor``; hosts without evidence inherit and are kept.

Counts are aggregated map-side, so a hot host is a row per task; the verdicts are one row per host. Defined results: a
null url, or one without ``://``, has an empty host and path; outcomes that are null do not count; pages of one id each
take its label; an empty label table blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import lower_ascii, packed, unpacked
from marquee.operators.settle import settle

# Suffixes of two labels under which names are registered.
LONG_SUFFIXES = (
    "ac.uk co.uk gov.uk org.uk com.au net.au org.au com.br com.cn com.mx co.in co.jp co.kr co.nz co.za"
).split()
WEAKEST, STRONGEST = 1.0, 1e4  # bounds of a prior's strength, in pages


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where names are registered below two."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(LONG_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix; an address is its own."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    named = F.when(two.isin(LONG_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).otherwise(named)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: int) -> Column:
    """Of the longest fitting rule the name (``what`` 0) or the verdict (1). Rules: host, path, verdict."""
    out = F.lit(None).cast("string")
    for of, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, F.lit((of + start, verdict)[what])).otherwise(out)
    return out


def _shrunk(groups: DataFrame, name: str, parent: str) -> DataFrame:
    """Counts of a level with the parent's mean in ``prior`` -> ``mean`` after shrinking, and its beta's ``a``, ``b``."""
    n, good, prior = F.col("n"), F.col("good"), F.col("prior")
    spread = prior * (1 - prior)
    moments = groups.where(n > 0).agg(
        F.sum(n * F.pow(good / n - prior, F.lit(2))).alias("seen"),
        F.sum(spread).alias("binomial"),
        F.sum(spread * (n - 1)).alias("room"),
    )
    rho = F.when(F.col("room") > 0, (F.col("seen") - F.col("binomial")) / F.col("room"))
    strength = F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(STRONGEST))))
    row = moments.select(F.coalesce(strength, F.lit(STRONGEST))).first()  # one row of sums
    a, b = good + row[0] * prior, n - good + row[0] * (1 - prior)
    return groups.select(name, parent, "n", "good", a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Per ``host`` of ``pages`` (page_id, host): ``bound``, the upper posterior bound of its share of good pages.

    ``outcomes`` has page_id and good (0, 1 or null). The bound is the posterior's mean plus ``z`` deviations.
    """
    found = outcomes.where(F.col("good").isNotNull()).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")
    )
    hosts = pages.join(found, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")
    )
    hosts = settle(
        hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "url-hosts"
    )
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    mean = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)

    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    suffixes = settle(
        _shrunk(suffixes.withColumn("prior", F.lit(mean)).withColumn("top", F.lit("")), "suffix", "top"), "url-suffixes"
    )
    above = suffixes.select("suffix", F.col("mean").alias("prior"))
    domains = settle(_shrunk(settle(domains.join(above, "suffix"), "url-d"), "domain", "suffix"), "url-domains")
    above = domains.select("domain", "suffix", F.col("mean").alias("prior"))
    hosts = _shrunk(settle(hosts.join(above, ["domain", "suffix"]), "url-h"), "host", "domain")
    a, b = F.col("a"), F.col("b")
    deviation = F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))
    return hosts.select("host", "n", "good", "mean", (F.col("mean") + z * deviation).alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    floor: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """``pages`` (page_id, url, more) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` is a list in the program, compiled to one expression; it is meant for up to some hundred entries.
    """
    known = settle(
        reputations(pages.select("page_id", host_of(F.col("url")).alias("host")), outcomes, z), "url-reputations"
    )
    known = known.select(F.col("host").alias("of"), "bound")
    rows = packed(pages, host=host_of(F.col("url")), path=path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    joined = rows.join(known, host == F.col("of"), "left").select(
        "row",
        "host",
        "path",
        rule_of(host, path, rules, 0).alias("rule"),
        F.coalesce(
            rule_of(host, path, rules, 1), F.when(F.col("bound") < floor, "block").otherwise("allow")
        ).alias("verdict"),
    )
    return unpacked(joined, pages, "host", "path", "rule", "verdict")
