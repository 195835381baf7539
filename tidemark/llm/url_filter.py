"""URL filter: a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import materialize, table

WORDS = 8  # 64-bit words of a Bloom block; each URL sets a bit in every one
BITS_PER_URL = 16
FILTER_LIMIT = 64 << 20  # bytes of Bloom blocks that are broadcast
#: Sites whose pages make up the list of the query over the driver's tables.
LISTED_SITES = ("casino-win", "free-bets", "cheap-pills", "ads-track")

_URL = r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\s*$"
_HOST_NOISE = r"^www\.|:(80|443)$"
_TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical(url: F.Column) -> F.Column:
    """A URL without what doesn't tell pages apart: scheme, fragment, "www.", default ports,
    tracking parameters, letter case of the host, slashes at the end of the path. Strings that
    aren't URLs come back trimmed and in lower case; null stays null."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), _HOST_NOISE, ""), _HOST_NOISE, "")
    path = F.regexp_replace(part(3), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(part(4), r"^\?", ""), _TRACKING, ""), "^&", "")
    full = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(2) == "", F.lower(F.trim(url))).otherwise(full)


def _mask(i: int, url: F.Column) -> F.Column:
    place = F.xxhash64(url, F.lit(i + 1)).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(listed: DataFrame, n_urls: int) -> DataFrame:
    """(block, w0..w7): the blocks of a Bloom filter over the column url of listed."""
    block = F.pmod(F.xxhash64("url"), F.lit(_block_count(n_urls)))
    return listed.groupBy(block.alias("block")).agg(*(F.bit_or(_mask(i, F.col("url"))).alias(f"w{i}") for i in range(WORDS)))


def _block_count(n_urls: int) -> int:
    return max(1, -(-n_urls * BITS_PER_URL // (WORDS * 64)))


def flag_listed(pages: DataFrame, listed: DataFrame, filter_limit: int = FILTER_LIMIT) -> DataFrame:
    """(page_id, canonical_url, listed) for every page: whether its canonical URL is among those of
    `listed` (column url).

    The list's canonical URLs go into a blocked Bloom filter: one block of 512 bits holds all bits
    of a URL. Pages whose block has all their bits are possible hits; only those take part in
    the exact join with the list, which removes false positives. Blocks are built by a grouped
    bit_or; up to filter_limit bytes they are broadcast, beyond it they are joined by a shuffle on
    the block number. So is the list itself, by its own size: broadcast, the pages are read once; else
    pages that the filter clears take no part in the shuffle.

    Null URLs are never listed and keep a null canonical_url; repeated pages each give their row,
    repeated entries of the list count once; URLs of any length are read whole. Other columns are
    ignored; an empty list flags nothing, an empty table of pages gives no rows.
    """
    urls = pages.select("page_id", canonical(F.col("url").cast("string")).alias("canonical_url"))
    listing = materialize(listed.select(canonical(F.col("url").cast("string")).alias("url")).filter("url is not null").distinct(), "listed_urls")
    facts = listing.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("url")), F.lit(0)).alias("size")).first()
    n = facts["n"]
    blocks = bloom_blocks(listing, n)
    if _block_count(n) * WORDS * 8 <= filter_limit:
        blocks = F.broadcast(blocks)
    probe = urls.withColumn("block", F.pmod(F.xxhash64("canonical_url"), F.lit(_block_count(n)))).join(blocks, "block", "left")
    sure = F.lit(True)
    for i in range(WORDS):
        m = _mask(i, F.col("canonical_url"))
        sure = sure & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    probed = probe.withColumn("probe_key", F.when(sure & F.col("canonical_url").isNotNull(), F.col("canonical_url")))
    hits = listing.select(F.col("url").alias("probe_key"), F.lit(True).alias("listed"))
    found = F.coalesce("listed", F.lit(False)).alias("listed")
    if facts["size"] + 64 * n <= filter_limit:
        return probed.join(F.broadcast(hits), "probe_key", "left").select("page_id", "canonical_url", found)
    # pages that the filter clears have a null key, which no join partner matches or moves
    cleared = probed.filter("probe_key is null").select("page_id", "canonical_url", F.lit(False).alias("listed"))
    checked = probed.filter("probe_key is not null").join(hits, "probe_key", "left").select("page_id", "canonical_url", found)
    return cleared.unionByName(checked)


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list for the driver's tables: URLs of pages on LISTED_SITES, whose other spellings
    (scheme, "www.", tracking parameters, fragments) must be found by their canonical form."""
    return pages.filter(F.col("url").rlike("//([a-z]+\\.)?(" + "|".join(LISTED_SITES) + ")\\.")).select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return flag_listed(pages, listed_urls(pages))


_SQL_URL = _URL.replace("'", "''")
SQL = f"""
WITH parts AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '{_SQL_URL}', 2)), '{_HOST_NOISE}', ''), '{_HOST_NOISE}', '') AS host,
         regexp_replace(regexp_extract(url, '{_SQL_URL}', 3), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '{_SQL_URL}', 4), '^\\?', ''), '{_TRACKING}', '', 'g'), '^&', '') AS params
  FROM pages
), forms AS (
  SELECT page_id, url, CASE WHEN host = '' THEN lower(trim(url)) ELSE host || path || CASE WHEN params = '' THEN '' ELSE '?' || params END END AS canonical_url FROM parts
), listed AS (
  SELECT DISTINCT canonical_url FROM forms WHERE regexp_matches(url, '//([a-z]+\\.)?({"|".join(LISTED_SITES)})\\.')
)
SELECT f.page_id, f.canonical_url, l.canonical_url IS NOT NULL AS listed FROM forms f LEFT JOIN listed l USING (canonical_url)
"""
