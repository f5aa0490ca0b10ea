"""URL filter: host rules plus pattern rules indexed by their rarest literal token.

Everything is a column expression over one scan; there is no shuffle and no Python on
the executors. Rules sit in hash tables made of array literals: a key's bucket is
crc32(key) mod the number of buckets, so that a look-up costs the same for ten rules
as for ten thousand, and only rules that share a token with a url run their regular
expression. The tables grow with the rule list, never with the data.

Defined results: a null url, or one without `://`, has an empty host and an empty
path, so no host rule fits it; patterns see the url as it is (null: no pattern fits);
repeated rows stay; a null page_id stays null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Blocks urls that `regex` finds in lower case. Each of `tokens` must stand as a
    whole run of letters and digits in every url that the expression matches."""

    name: str
    regex: str
    tokens: tuple[str, ...]


#: The patterns of the registered query.
PATTERNS = (
    PatternRule("tracked", r"[?&]utm_source=[^&#]+", ("utm", "source")),
    PatternRule("paged_referral", r"[?&]page=[0-9]+&ref=", ("page", "ref")),
    PatternRule("session", r"[?&]sessionid=[0-9a-f]{8,}", ("sessionid",)),
    PatternRule("admin", r"/wp-admin(/|$)", ("wp", "admin")),
    PatternRule("checkout", r"/cart/checkout(/|$|[?#])", ("cart", "checkout")),
    PatternRule("mobile_html", r"^https?://m[.][^/?#]*/[^?#]*[.]html($|[?#])", ("m", "html")),
    PatternRule("feed", r"/rss[.]xml($|[?#])", ("rss", "xml")),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class HashIndex:
    """Positions of entries by key, as array literals of a bucket table."""

    def __init__(self, keys: Sequence[str]):
        self.buckets = 1 << max(1, (2 * len(keys)).bit_length())
        rows: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            rows[crc32(k.encode()) % self.buckets].append(i)
        heads = [0]
        for r in rows:
            heads.append(heads[-1] + len(r))
        self.heads, self.entries, self.keys = F.lit(heads), F.lit([i for r in rows for i in r]), F.lit(list(keys))

    def find(self, key: Column) -> Column:
        """Positions (from 0) of the entries with this key."""
        b = F.pmod(F.crc32(key.cast("binary")), F.lit(self.buckets)).cast("int")
        lo, hi = F.get(self.heads, b), F.get(self.heads, b + 1)
        return F.filter(F.slice(self.entries, lo + 1, hi - lo), lambda i: F.get(self.keys, i) == key)


def tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, patterns: Iterable[PatternRule]) -> dict[str, str]:
    """For each pattern its literal token that the fewest urls have (ties: the first
    in order). Only tokens that a rule names are counted, so the result that reaches
    the driver has at most as many rows as there are literals."""
    patterns = list(patterns)
    literals = sorted({t for p in patterns for t in p.tokens})
    if not literals:
        return {}
    index = HashIndex(literals)
    hits = urls.select(F.explode(F.filter(tokens(F.col("url")), lambda t: F.size(index.find(t)) > 0)).alias("token"))
    count = {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {p.name: min(p.tokens, key=lambda t: (count.get(t, 0), t)) for p in patterns}


def judge(pages: DataFrame, host_rules: Sequence[HostRule], patterns: Sequence[PatternRule] = PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (the first that blocks).

    The longest fitting host rule decides; where none fits, a url is blocked if a
    pattern matches it and allowed otherwise.
    """
    urls = pages.select("page_id", "url")
    host, path = split_url(F.col("url"))
    urls = urls.select("page_id", F.translate("url", UPPER, LOWER).alias("low"), host.alias("host"), path.alias("path"))
    out = urls.withColumn("rule", F.lit(None).cast("string")).withColumn("decided", F.lit(None).cast("string"))
    if host_rules:
        by_length = sorted(host_rules, key=lambda r: (-len(r.text), r.text))
        index = HashIndex([r.host for r in by_length])
        paths, texts, verdicts = F.lit([r.path for r in by_length]), F.lit([r.text for r in by_length]), F.lit([r.verdict for r in by_length])
        labels = F.split("host", r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        fitting = F.filter(F.flatten(F.transform(suffixes, index.find)), lambda i: F.startswith(F.col("path"), F.get(paths, i)))
        out = urls.withColumn("best", F.array_min(fitting)).select("*", F.get(texts, F.col("best")).alias("rule"), F.get(verdicts, F.col("best")).alias("decided"))
    pattern = F.lit(None).cast("string")
    if patterns:
        chosen = rarest_tokens(pages.select("url"), patterns)
        index = HashIndex([chosen[p.name] for p in patterns])
        regexes, names = F.lit([p.regex for p in patterns]), F.lit([p.name for p in patterns])
        candidates = F.array_distinct(F.flatten(F.transform(tokens(F.col("low")), index.find)))
        pattern = F.get(names, F.array_min(F.filter(candidates, lambda i: F.rlike(F.col("low"), F.get(regexes, i)))))
    out = out.withColumn("pattern", F.when(F.col("rule").isNull(), pattern))
    verdict = F.coalesce("decided", F.when(F.col("pattern").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "pattern")


def judge_sql(host_rules: Sequence[HostRule], patterns: Sequence[PatternRule] = PATTERNS) -> str:
    """The same by trying every rule on every url, as DuckDB SQL over `pages`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    by_length = sorted(host_rules, key=lambda r: (-len(r.text), r.text))
    fits = [f"WHEN (host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}) THEN {{}}" for r in by_length]
    rule = "CASE " + " ".join(f.format(q(r.text)) for f, r in zip(fits, by_length, strict=True)) + " END" if fits else "NULL"
    decided = "CASE " + " ".join(f.format(q(r.verdict)) for f, r in zip(fits, by_length, strict=True)) + " END" if fits else "NULL"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches(low, {q(p.regex)}) THEN {q(p.name)}" for p in patterns) + " END" if patterns else "NULL"
    return f"""
    WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
                        translate(url, '{UPPER}', '{LOWER}') AS low FROM pages),
    parts AS (SELECT page_id, low, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    ruled AS (SELECT page_id, low, host, path, CAST({rule} AS VARCHAR) AS rule, CAST({decided} AS VARCHAR) AS decided FROM parts),
    tried AS (SELECT *, CASE WHEN rule IS NULL THEN CAST({pattern} AS VARCHAR) END AS pattern FROM ruled)
    SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern FROM tried
    """
