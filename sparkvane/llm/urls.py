"""URL filters from host reputation, all in DataFrame expressions.

Method: labelled page outcomes are shrunk through a chain of beta-binomial
priors. Every level (public suffix, registered domain, host) has a prior
Beta(m * s, (1 - m) * s): the mean m is the posterior mean of the level above
and the strength s comes from the level's own counts by the method of moments.
A host without outcomes has the prior that its domain gives to hosts, else the one
that its suffix gives to domains, else the one of all suffixes. A url is blocked when the lower bound of its host's posterior
bad rate lies above `max_bad_rate`. Explicit rules come first: the longest that fits wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.llm._store import cut_native

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: action, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_BAD_RATE = 0.5
Z = 1.645
#: Public suffixes of two labels that are common; no more than a part of the public
#: suffix list, which is not at hand here. Others are taken to be the last label.
_UNDER = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi kiwi maori net org school",
    "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "br": "adv art blog com edu eng gov ind jus leg mil net org", "in": "ac co edu firm gen gov ind net nic org res",
    "za": "ac co gov net org web", "cn": "ac com edu gov mil net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per",
    "my": "com edu gov mil name net org", "th": "ac co go in mi net or", "id": "ac co desa go mil my net or sch web", "ph": "com edu gov net ngo org", "vn": "com edu gov name net org",
    "tr": "av bel com edu gen gov k12 name net org web", "il": "ac co gov k12 muni net org", "mx": "com edu gob net org", "ar": "com edu gob gov int mil net org tur", "co": "com edu gov mil net nom org",
    "pe": "com edu gob net nom org", "ve": "co com edu gob info net org web", "ua": "com edu gov in net org", "pl": "com edu gov net org", "ke": "ac co go me ne or sc", "ng": "com edu gov name net org",
    "eg": "com edu gov net org sci", "sa": "com edu gov med net org sch", "pk": "com edu gov net org", "bd": "ac com edu gov net org",
}
PUBLIC_SUFFIXES = tuple(f"{a}.{b}" for b, own in _UNDER.items() for a in own.split())
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def _after_scheme(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    return at, F.substring(url, at + 3, F.length(url))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased;
    null or no `://`: empty."""
    at, rest = _after_scheme(url)
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: empty."""
    at, rest = _after_scheme(url)
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """The public suffix: the longest of `suffixes` (two labels or more) that
    ends the host, else its last label."""
    out = F.element_at(F.split(host, r"\."), -1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        tail = F.substring_index(host, ".", -n)
        out = F.when(tail.isin([s for s in suffixes if s.count(".") + 1 == n]), tail).otherwise(out)
    return out


def domain_of(host: Column, suffix: Column) -> Column:
    """One label more than the suffix, or the host where it has no more."""
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) <= F.length(suffix) + 1, host).otherwise(
        F.concat(F.element_at(F.split(before, r"\."), -1), F.lit("."), suffix))


def parse(pages: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, domain, suffix; other columns are left out, so clashing names do no harm."""
    d = pages.select("page_id", F.col("url").alias("__url"))
    d = d.select("page_id", host_of(F.col("__url")).alias("__host"), path_of(F.col("__url")).alias("path"))
    d = d.withColumn("__suffix", suffix_of(F.col("__host"), suffixes))
    return d.select("page_id", F.col("__host").alias("host"), "path", domain_of(F.col("__host"), F.col("__suffix")).alias("domain"), F.col("__suffix").alias("suffix"))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule text and action of the longest rule that fits; null where none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return text, action


def _strength(groups: DataFrame, mean: str) -> Column:
    """Method of moments over groups (n, bad, prior mean): the between-group
    variance that is left after binomial noise gives the prior's strength."""
    p = F.col("bad") / F.col("n")
    m = F.col(mean)
    between = F.sum(F.col("n") * (p - m) * (p - m))
    base = F.sum(m * (1 - m))  # expected n * (p - m)^2 under pure noise
    spread = F.sum((F.col("n") - 1) * m * (1 - m))
    rho = (between - base) / spread
    return F.when((spread > 0) & (rho > 0), F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), 1 / rho - 1))).otherwise(F.lit(MOST_STRENGTH))


def _bound(mean: Column, strength: Column, n: Column, bad: Column) -> tuple[Column, Column]:
    """Posterior mean and lower bound after `bad` of `n` outcomes."""
    a, b = bad + mean * strength, n - bad + (1 - mean) * strength
    rate = a / (a + b)
    return rate, rate - Z * F.sqrt(rate * (1 - rate) / (a + b + 1))


def host_reputation(outcomes: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """host, domain, suffix, n, bad -> keys and table of each level, the host
    first: (suffix, domain, host), (suffix, domain), (suffix) and () with posterior
    mean `rate` and `lower` bound of a labelled host, else of a host without
    outcomes: the prior that its domain gives to hosts, else its suffix to domains,
    else all outcomes to suffixes. `outcomes` has one row for each labelled host;
    small aggregates over it, no row of pages is touched again. Levels and the three
    strengths (one row each) are written once computed, so no level is computed twice."""
    total = outcomes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("m0"))
    suf = outcomes.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(F.broadcast(total))
    s1 = cut_native(suf.agg(_strength(suf, "m0").alias("s1")), "strength")
    suf = suf.join(F.broadcast(s1))
    suf = cut_native(suf.select("suffix", ((F.col("bad") + F.col("m0") * F.col("s1")) / (F.col("n") + F.col("s1"))).alias("m1")), "suffixes")
    dom = outcomes.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suf, "suffix")
    s2 = cut_native(dom.agg(_strength(dom, "m1").alias("s2")), "strength")
    dom = dom.join(F.broadcast(s2))
    dom = cut_native(dom.select("suffix", "domain", ((F.col("bad") + F.col("m1") * F.col("s2")) / (F.col("n") + F.col("s2"))).alias("m2")), "domains")
    hst = outcomes.join(dom, ["suffix", "domain"])
    s3 = cut_native(hst.agg(_strength(hst, "m2").alias("s3")), "strength")
    out = []
    for keys, level, mean, s, n, bad in ((["suffix", "domain", "host"], hst, "m2", s3, F.col("n"), F.col("bad")), (["suffix", "domain"], dom, "m2", s3, 0.0, 0.0), (["suffix"], suf, "m1", s2, 0.0, 0.0), ([], total, "m0", s1, 0.0, 0.0)):
        rate, lower = _bound(F.col(mean), F.col(s.columns[0]), F.lit(n), F.lit(bad))
        out.append((keys, level.join(F.broadcast(s)).select(*keys, rate.alias("rate"), lower.alias("lower"))))
    return out


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          max_bad_rate: float = MAX_BAD_RATE, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, host_rate, host_lower for every page.

    labels: page_id, bad (0/1); null labels and labels of unknown pages count
    for nothing, repeated rows count each. A host without labelled pages has the
    prior of its domain, else of its suffix, else the global one, with the same
    bound. Null and malformed urls have the empty host, which is judged as any other. No labels at all: every page without a rule is
    allowed. Empty pages: no rows."""
    d = parse(pages, suffixes)
    seen = d.join(labels.select(F.col("page_id"), F.col("bad").cast("long").alias("bad")).where("page_id is not null and bad is not null"), "page_id")
    outcomes = cut_native(seen.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "outcomes")
    # The salted keys split a host, domain or suffix that holds a third of all pages.
    salts = 16
    d = d.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    rates, lowers = [], []
    for i, (keys, rep) in enumerate(host_reputation(outcomes)):
        rep = rep.withColumnsRenamed({"rate": f"__rate{i}", "lower": f"__lower{i}"})
        if keys:
            rep = rep.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
            d = d.join(rep, [*keys, "__salt"], "left")
        else:
            d = d.join(F.broadcast(rep))  # one row always
        rates.append(F.col(f"__rate{i}"))
        lowers.append(F.col(f"__lower{i}"))
    d = d.withColumns({"host_rate": F.coalesce(*rates), "host_lower": F.coalesce(*lowers)})
    text, action = best_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("host_lower") > F.lit(max_bad_rate), F.lit("block")).otherwise(F.lit("allow"))
    return d.select("page_id", "host", "path", text.alias("rule"), F.coalesce(action, learned).alias("verdict"), "host_rate", "host_lower")
