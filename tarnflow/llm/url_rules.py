"""URL rules behind a blocked Bloom filter, in SQL functions alone.

A rule lists a canonical url: a host with all its subdomains, and a path prefix. Each page url gives its
candidates, every suffix of its host at a dot with every prefix of its path as long as some listed path;
a blocked Bloom filter of the listed urls (one 256-bit block a url, eight bits in it) passes the possible
hits, an exact hash join on (host, path) removes the false positives, and the longest rule decides. What no
rule fits is allowed, as the listed urls alone are judged.

The filter has 32 bits a listed url. Up to FILTER_URLS it is one array of words, built by Spark and read as a
scalar subquery's value, so the plan's size doesn't depend on the list; a longer list is joined by block instead.
Pages without a possible hit are answered where they are: only hits are exploded, joined and brought back together.
Candidates of one url are bounded by its own dots and the list's distinct path lengths, so a hot host is no hot
key: rows carry their own number until the decision.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; an empty path
fits no rule with a path; ports and user names count as part of the host; a url is read whole however long it is;
repeated rows are judged each; a rule listed twice counts once if its verdicts agree, else the greater verdict by
name wins the tie; an empty table gives no rows and an empty list lets all pages through. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fixed by the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
WORDS, BITS = 4, 8
#: Listed urls up to which the filter (4 bytes a url) is one value and the list is broadcast.
FILTER_URLS = 1_000_000
_HALF = (1 << 56) - 1


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 24), F.lit(blocks)).cast("int")


def _bit(hashed: Column, k: int) -> Column:
    """The k-th bit of a url within its block of 64*WORDS, by double hashing."""
    step = F.shiftrightunsigned(hashed, 8).bitwiseOR(F.lit(1))
    return (hashed + step * F.lit(k)).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int")


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, words) of the listed urls (url string)."""
    hashed = listed.select(F.xxhash64("url").bitwiseAND(F.lit(_HALF)).alias("h"))
    bits = hashed.select(_block(F.col("h"), blocks).alias("block"), F.explode(F.array(*[_bit(F.col("h"), k) for k in range(BITS)])).alias("bit"))
    mask = lambda w: F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long")))
    return bits.groupBy("block").agg(F.array(*[mask(w) for w in range(WORDS)]).alias("words"))


def _filter_words(made: DataFrame, blocks: int) -> Column:
    """All words of the filter in one array, for up to FILTER_URLS urls."""
    every = made.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")).join(made, "block", "left")
    none = F.array(*[F.lit(0).cast("long")] * WORDS)
    rows = F.sort_array(F.collect_list(F.struct("block", F.coalesce("words", none).alias("words"))))
    return every.agg(F.flatten(F.transform(rows, lambda r: r["words"])).alias("w")).scalar()


def _passes(hashed: Column, words: Column, at: Column) -> Column:
    """All bits of a url are set in its block's words, which begin behind place `at`."""
    out = F.lit(True)
    for k in range(BITS):
        bit = _bit(hashed, k)
        out = out & (F.getbit(F.element_at(words, at + F.shiftright(bit, 6) + 1), bit.bitwiseAND(F.lit(63))) == 1)
    return out


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, which a plain column needn't be where plans are merged."""
    return F.element_at(F.transform(F.array(value), body), 1)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every suffix of the host at a dot with every prefix of the path of a listed length: host, newline, path."""
    fit = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.length(path))
    starts = _let(path, lambda p: F.transform(fit, lambda x: F.concat(F.lit("\n"), F.substring(p, F.lit(1), x))))
    suffixes = _let(host, lambda h: F.transform(F.sequence(F.lit(1), F.length(h) - F.length(F.replace(h, F.lit("."))) + 1), lambda i: F.call_function("substring_index", h, F.lit("."), -i)))
    return _let(F.struct(suffixes.alias("hosts"), starts.alias("paths")), lambda r: F.flatten(F.transform(r["hosts"], lambda h: F.transform(r["paths"], lambda p: F.concat(h, p)))))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages (page_id, url, ...) and rules (verdict, host, path) -> page_id, host, path, rule, verdict."""
    rules = rules.select(F.col("verdict").alias("rule_verdict"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    key = F.concat("rule_host", F.lit("\n"), "rule_path")
    listed = rules.groupBy(key.alias("key")).agg(F.first(F.concat("rule_host", "rule_path")).alias("rule"), F.max("rule_verdict").alias("rule_verdict"), F.first(F.length("rule_path")).alias("path_length"))
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path_length")).alias("lengths")).first()  # distinct lengths of listed paths
    n, lengths = max(1, size["n"]), size["lengths"]
    listed = listed.drop("path_length")
    blocks = max(1, n * 32 // (64 * WORDS))
    made = bloom_blocks(listed.select(F.col("key").alias("url")), blocks)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = candidates(F.col("host"), F.col("path"), lengths)
    if n <= FILTER_URLS:
        found = F.transform(keys, lambda k: F.struct(k.alias("key"), F.xxhash64(k).bitwiseAND(F.lit(_HALF)).alias("h")))
        # the filter's one value is a column, as a lambda can't hold a subquery
        hits = _let(F.col("words"), lambda w: F.transform(F.filter(found, lambda x: _passes(x["h"], w, _block(x["h"], blocks) * WORDS)), lambda x: x["key"]))
        judged = rows.withColumn("words", _filter_words(made, blocks)).withColumn("hits", hits).drop("words")
        missed = judged.where(F.size("hits") == 0).select("page_id", "host", "path")
        # exploded with the empty ones and cut behind that, as a cut before would compute the hits again
        probed = judged.withColumn("row", F.monotonically_increasing_id()).select("row", "page_id", "host", "path", F.explode_outer("hits").alias("key")).where("key is not null")
    else:
        every = rows.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode_outer(keys).alias("key")).withColumn("h", F.xxhash64("key").bitwiseAND(F.lit(_HALF))).withColumn("block", _block(F.col("h"), blocks))
        probed = every.join(made, "block", "left").withColumn("key", F.when(_passes(F.col("h"), F.col("words"), F.lit(0)), F.col("key"))).drop("block", "words", "h")
        missed = None
    joined = probed.join(F.broadcast(listed) if n <= FILTER_URLS else listed, "key", "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", F.col("rule_verdict").alias("verdict"))))
    won = joined.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    out = won.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return out if missed is None else out.unionByName(missed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default)))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), j AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""
