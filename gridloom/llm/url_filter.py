"""URL filters: host and path rules, then a blocked Bloom filter before an exact hash join. SQL functions only.

Rules come first: one fits its host and all subdomains if the url's path starts with the rule's path; the longest
wins. A url that no rule fits is looked up, in canonical form, in a list: a blocked Bloom filter (each url sets its
bits within one block of 256) passes the possible hits, and an exact join with the list drops false positives.

The filter has MAX_BLOCKS blocks at most (40 bytes each), however long the list is, so its broadcast is bounded;
a fuller filter passes more false positives to the join and never changes the result.

Defined cases: a null url, or one without `://`, has an empty host and path, and is allowed; a url listed twice
counts once; null urls in the list are ignored; an empty list blocks nothing; rows that repeat are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_az

MAX_BLOCKS = 1 << 18
URLS_PER_BLOCK = 16
PROBES = 6


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the task.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Without scheme, `www.`, default ports, fragment, `utm_` and `ref` parameters and trailing slashes; host in lower case; query parameters sorted. Null or no `://`: null."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null: none. The rules are a stated, short list: one CASE."""
    name, verdict = None, None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def _bits(url: Column) -> list[Column]:
    """Four longs with the PROBES bits that a url sets in its block."""
    h = F.xxhash64(url, F.lit("bits"))
    at = [F.pmod(F.shiftrightunsigned(h, 9 * i), F.lit(256)).cast("int") for i in range(PROBES)]
    out = []
    for word in range(4):
        bits = F.lit(0).cast("long")
        for a in at:
            bits = bits.bitwiseOR(F.when(F.shiftright(a, 6) == word, _shl(a)).otherwise(F.lit(0).cast("long")))
        out.append(bits)
    return out


def _shl(a: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(a, F.lit(64)))


def bloom(listed: DataFrame, url: str = "canonical", n_blocks: int = MAX_BLOCKS) -> DataFrame:
    """A row for each block that has bits: block and b0 to b3. One shuffle of at most n_blocks rows a task."""
    c = F.col(url)
    rows = listed.filter(c.isNotNull()).select(_block(c, n_blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(c))])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)])


def blocks_for(n: int) -> int:
    """Blocks of a filter of n keys: a power of two, MAX_BLOCKS at most."""
    return min(MAX_BLOCKS, 1 << max(0, n // URLS_PER_BLOCK).bit_length())


def marked(rows: DataFrame, filt: DataFrame, url: str = "canonical", n_blocks: int = MAX_BLOCKS, flag: str = "__gl_may") -> DataFrame:
    """The rows with a boolean column: whether all bits of the key are set in their block."""
    c = F.col(url)
    probe = rows.withColumns({"__gl_block": _block(c, n_blocks), **{f"__gl_b{i}": b for i, b in enumerate(_bits(c))}})
    hit = probe.join(F.broadcast(filt.withColumnsRenamed({"block": "__gl_at", **{f"b{i}": f"__gl_f{i}" for i in range(4)}})), F.col("__gl_block") == F.col("__gl_at"), "left")
    every = F.lit(True)
    for i in range(4):
        every = every & (F.col(f"__gl_f{i}").bitwiseAND(F.col(f"__gl_b{i}")) == F.col(f"__gl_b{i}"))
    return hit.withColumn(flag, F.coalesce(every, F.lit(False))).select(*rows.columns, flag)


def possible(urls: DataFrame, filt: DataFrame, url: str = "canonical", n_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows of `urls` whose bits are all set in their block: every listed one, and some others."""
    return marked(urls, filt, url, n_blocks).filter("__gl_may").select(*urls.columns)


def ruled(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, canonical, rule and its verdict of every row, as a table of its own: the urls are a small part of the pages, and their canonical form, worked out here only, is dear."""
    u = F.col(url)
    base = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("canonical"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return cut(base.withColumns({"rule": name, "__gl_v": verdict}), "urls")


def looked_up(decided: DataFrame, listed: DataFrame) -> DataFrame:
    """The verdicts of rows of `ruled`. Only rows that no rule decides and that the filter passes are shuffled, to meet the list; all others keep to their tasks."""
    listed = cut(listed.select("canonical").filter(F.col("canonical").isNotNull()).distinct(), "listed")
    n_blocks = blocks_for(listed.count())
    may = marked(decided, bloom(listed, n_blocks=n_blocks), n_blocks=n_blocks).withColumn("__gl_may", F.col("__gl_may") & F.col("__gl_v").isNull() & F.col("canonical").isNotNull())
    # a url that very many pages carry is a large partition of this join, which Spark splits: the list has it once
    met = may.filter("__gl_may").join(listed.withColumn("__gl_hit", F.lit(True)), "canonical", "left").select(*decided.columns, "__gl_hit")
    out = met.union(may.filter(~F.col("__gl_may")).select(*decided.columns, F.lit(False)))
    on = F.coalesce(F.col("__gl_hit"), F.lit(False))
    return out.select("page_id", "host", "path", "rule", on.alias("listed"), F.coalesce("__gl_v", F.when(on, "block").otherwise("allow")).alias("verdict"))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """A row for each row of `pages`: page_id, host, path, rule, listed (boolean) and verdict. `listed`: a column `canonical`."""
    return looked_up(ruled(pages, rules, url, page_id), listed)


def repeated(decided: DataFrame) -> DataFrame:
    """Of rows of `ruled`: canonical urls carried by two pages or more."""
    return decided.filter("canonical IS NOT NULL").groupBy("canonical").count().filter("count > 1").select("canonical")


def repeated_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical urls carried by two pages or more, as a list for `judge`."""
    return repeated(pages.select(canonical(F.col(url)).alias("canonical")))
