"""URL filtering by rules and by an empirical-Bayes reputation of hosts, in DataFrame functions only.

Labelled page outcomes are counted per host.  At each level (public suffix, registered domain, host) a
beta-binomial prior is centred on the posterior mean of the level above (suffixes: on the global
rate); its strength is M = (1 - rho) / rho with the analysis-of-variance estimate of the
intraclass correlation rho over that level's groups.  A host is blocked if the lower bound
``mean - z * sd`` of its posterior rate of bad pages (the normal approximation of the beta posterior) is above ``max_bad``.
A rule that fits overrides the reputation.

The registered domain is the public suffix and one more label: the suffix is the last label, or the last two where these are
one of ``SECOND_LEVEL`` or the last is one of ``WILDCARD`` (but for ``EXCEPTIONS``).  User and port don't count; an
address is a domain of its own under the suffix ``address``; a host that is a suffix itself is its own domain.

The hosts of a large part of the pages are few, and are joined by a broadcast of at most ``4 * shuffle partitions`` rows; the
others are joined by host.

Defined results: a null url or one without ``://`` has empty host and path; its reputation is that
of the empty host; pages without outcome count nowhere; null or repeated page ids are rows like any
other (an outcome counts for each row of its id); of rules of equal length the one given first holds; without any outcome
nothing is blocked; urls of any length are worked on whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, parallelism

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Common public suffixes of two labels, countries all of whose second labels are suffixes, and exceptions to these.
SECOND_LEVEL = (
    "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl",
    "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.ve", "com.vn", "edu.au", "edu.cn", "edu.hk", "edu.sg", "edu.tr", "edu.tw", "go.jp",
    "go.kr", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "gov.za", "govt.nz", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn",
    "net.in", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.ar", "org.au", "org.br", "org.cn", "org.hk", "org.il", "org.in", "org.mx", "org.nz",
    "org.tw", "org.uk", "org.za", "plc.uk", "sch.uk",
)
WILDCARD = ("bd", "ck", "er", "fk", "jm", "kh", "mm", "np", "pg")
EXCEPTIONS = ("www.ck",)


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    url = F.col(url_col)
    at = F.locate("://", url_col)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def matching_rule(rules: list[Rule], attribute: str) -> Column:
    """``name`` or ``verdict`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        found = F.when(fits, F.lit(getattr(rule, attribute))).otherwise(found)
    return found


def registered(df: DataFrame) -> DataFrame:
    """Adds ``suffix`` and ``domain`` of ``host``."""
    name = F.regexp_extract(F.regexp_replace("host", "^.*@", ""), r"^(\[[^\]]*\]?|[^:]*)", 1)
    df = df.withColumn("__name", F.regexp_replace(name, r"\.+$", ""))
    last = lambda k: F.substring_index("__name", ".", -k)
    address = F.col("__name").rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    two = last(2).isin(*SECOND_LEVEL) | (last(1).isin(*WILDCARD) & ~last(2).isin(*EXCEPTIONS))
    suffix = F.when(address, F.lit("address")).when(two, last(2)).otherwise(last(1))
    domain = F.when(address, F.col("__name")).when(two, last(3)).otherwise(last(2))
    return df.withColumns({"suffix": suffix, "domain": domain}).drop("__name")


def _strength(groups: DataFrame) -> float:
    """Prior strength M of a level from its groups' counts ``n, bad`` (one row of sums is fetched)."""
    rate = F.col("bad") / F.col("n")
    row = (
        groups.filter("n > 0")
        .agg(
            F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"),
            F.sum(F.col("n") * rate * rate).alias("npp"),
        )
        .first()
    )
    k, n, bad = row["k"], row["n"] or 0, row["bad"] or 0
    if k < 2 or n <= k or bad in (0, n):
        return 1e4
    p = bad / n
    between = (row["npp"] - n * p * p) / (k - 1)
    within = (bad - row["npp"]) / (n - k)
    typical = (n - row["nn"] / n) / (k - 1)
    spread = between + (typical - 1) * within
    rho = (between - within) / spread if spread > 0 else 1.0
    rho = min(max(rho, 1e-4), 0.999)
    return (1 - rho) / rho


def host_reputation(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """``host, n, bad, mean, lower`` from per-host counts ``host, n, bad``."""
    hosts = registered(counts.select("host", "n", "bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    everywhere = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    m_suffix, m_domain, m_host = _strength(suffixes), _strength(domains), _strength(hosts)
    suffixes = suffixes.select("suffix", ((F.col("bad") + F.lit(m_suffix * everywhere)) / (F.col("n") + F.lit(m_suffix))).alias("above"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", ((F.col("bad") + F.lit(m_domain) * F.col("above")) / (F.col("n") + F.lit(m_domain))).alias("above")
    )
    a = F.col("bad") + F.lit(m_host) * F.col("above")
    b = F.col("n") - F.col("bad") + F.lit(m_host) * (F.lit(1.0) - F.col("above"))
    scored = hosts.join(domains, "domain").select("host", "n", "bad", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return scored.select("host", "n", "bad", mean.alias("mean"), (mean - F.lit(z) * sd).alias("lower"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    max_bad: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, bad_rate, bad_lower``.

    ``outcomes`` has ``page_id, bad`` (boolean; null: no outcome).
    """
    split = split_url(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    known = outcomes.filter("bad IS NOT NULL").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")
    )
    seen = split.select("page_id", "host").join(known, "page_id", "left")
    counts = cut(  # read by each level's sums
        seen.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    )
    known_hosts = host_reputation(counts, z)
    most = counts.agg(F.sum("pages")).first()[0] or 0
    hot = counts.filter(F.col("pages") * 4 * parallelism(pages.sparkSession) > most).select("host")  # so few that they can be sent out
    common = F.broadcast(known_hosts.join(F.broadcast(hot), "host", "left_semi"))
    rare = split.join(F.broadcast(hot), "host", "left_anti").join(known_hosts, "host")
    judged = split.join(common, "host").union(rare)
    method = F.when(F.col("lower") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", matching_rule(rules, "name").alias("rule"),
        F.coalesce(matching_rule(rules, "verdict"), method).alias("verdict"),
        F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_lower"),
    )
