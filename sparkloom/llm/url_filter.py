"""URL filters: host and path rules, then a blocked Bloom filter before an exact join with a list of canonical URLs.

The filter is a table of 256-bit blocks: a URL sets eight bits of the one block that its hash names. A URL whose bits
are not all set is surely not listed and skips the join; possible hits are joined exactly, so false positives go.
Distinct possible hits are joined, and the blocks are broadcast only if they are few, by count; else they are joined by name.

Nulls and edges: a null URL, or one without ``://``, has empty host and path, fits no rule and is not listed; rows
that repeat are all kept; an empty list lets all pass; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WORDS, BITS = 4, 8  # of 64 bits in a block; set by a URL
#: Blocks broadcast at most: 48 bytes each, 24 MB.
BROADCAST_BLOCKS = 500_000
#: The rules, longest match wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without ``.html`` and the slashes that end it; scheme, query and fragment are gone."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits a host, its subdomains and the start of a path; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        name, slash, rest = rule.partition("/")
        out = F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest), rule).otherwise(out)
    return out


def _bits(key: str) -> str:
    """SQL for the array of bits that a key sets in its block."""
    return f"transform(sequence(1, {BITS}), i -> cast(pmod(xxhash64({key}, i), {WORDS * 64}) as int))"


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0 .. w3 for the distinct ``key`` column of ``keys``: partial ors are combined before the shuffle."""
    bits = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.expr(f"explode({_bits('key')}) as bit"))
    word = lambda w: F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}")
    return bits.groupBy("block").agg(*[word(w) for w in range(WORDS)])


def listed(urls: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``urls`` with a column ``hit`` (in place of any of that name): whether ``key`` is in ``wanted(key)``."""
    wanted = materialize(wanted.where("key is not null").distinct())
    n = wanted.count()
    blocks = max(1, n // 16)  # 16 bits a key
    table = bloom(wanted, blocks).withColumnRenamed("block", "held")
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    rows = urls.select(F.struct(*[c for c in urls.columns if c != "hit"]).alias("row"), F.col(key).alias("key"))
    # rows without a key look for no block; they are spread out, as they may be many
    at = F.when(F.col("key").isNull(), -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1009))).otherwise(F.pmod(F.xxhash64("key"), F.lit(blocks)))
    met = rows.withColumn("at", at).join(table, F.col("at") == F.col("held"), "left")
    mask = lambda w: F.expr(f"aggregate({_bits('key')}, 0L, (a, b) -> a | if(b div 64 = {w}, shiftleft(1L, b % 64), 0L))")
    maybe = F.col("held").isNotNull() & F.col("key").isNotNull()
    for w in range(WORDS):
        maybe = maybe & (F.col(f"w{w}").bitwiseAND(mask(w)) == mask(w))
    met = materialize(met.select("row", "key", F.coalesce(maybe, F.lit(False)).alias("maybe")))
    true = materialize(met.where("maybe").select("key").distinct().join(wanted, "key", "left_semi").withColumn("hit", F.lit(True)))
    true = F.broadcast(true) if true.count() <= BROADCAST_BLOCKS else true
    hits = met.where("maybe").join(true, "key", "left").select("row.*", F.coalesce("hit", F.lit(False)).alias("hit"))
    return hits.unionByName(met.where("not maybe").select("row.*", F.lit(False).alias("hit")))


def judge(pages: DataFrame, wanted: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule's verdict, else block if the canonical URL is listed in ``wanted(key)``."""
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), F.nullif(canonical(F.col("host"), F.col("path")), F.lit("")).alias("canonical"))
    verdicts = F.create_map(*[F.lit(x) for pair in rules for x in pair])
    verdict = F.coalesce(F.try_element_at(verdicts, F.col("rule")), F.when(F.col("hit"), "block").otherwise("allow"))
    return listed(parts, "canonical", wanted).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages; listed are the canonical URLs of campaign captures: pages whose query carries ``utm_`` or ``ref=`` tracking."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    tracked = pages.where(F.col("url").rlike("[?&](utm_[a-z]+|ref)="))
    wanted = tracked.select(F.nullif(canonical(host_of(F.col("url")), path_of(F.col("url"))), F.lit("")).alias("key"))
    return judge(pages, wanted)


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
named AS (
  SELECT *, nullif(regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', ''), '') AS c,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN c IN (SELECT c FROM named WHERE regexp_matches(url, '[?&](utm_[a-z]+|ref)=') AND c IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM named"""
