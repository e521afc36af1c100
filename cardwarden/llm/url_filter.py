"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Built from columns and joins alone. One block is 512 bits kept as eight 64-bit words; a URL sets
one bit in each word of the one block that its hash names, so a probe reads a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwarden.session import materialize

WORDS, WORD_BITS = 8, 64
BITS_PER_KEY = 16
#: The filter's blocks and the listed URLs are broadcast up to these sizes, else joined by shuffle.
BROADCAST_BLOCKS, BROADCAST_BYTES = 200_000, 16 << 20
#: Spread of rows that the Bloom filter rules out, where the exact join is shuffled.
SALTS = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def _tail(url: Column) -> Column:
    """What follows the first '://'; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_tail(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_tail(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without closing slashes, the query without tracking
    parameters and in order; no scheme, no fragment. Null if there is no host."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    parts = F.split(F.regexp_extract(_tail(url), r"^[^?#]*\?([^#]*)", 1), "&")
    parts = F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref=")))
    query = F.array_join(parts, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_column(host: Column, path: Column, rules: Sequence[Rule], verdict: bool) -> Column:
    """The longest rule that fits, or its verdict; null if none does. ``rules`` is a short list."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = out.when(fits, F.lit(kind if verdict else rule_host + rule_path))
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit for each word: six bits of a second hash name it."""
    h = F.xxhash64(key, F.lit("bloom"))
    bits = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]


def build_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """``listed`` (column ``canonical``) as one row for each block in use."""
    masks = [m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("canonical")))]
    words = [F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]
    return listed.select(_block(F.col("canonical"), n_blocks).alias("block"), *masks).groupBy("block").agg(*words)


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    broadcast_blocks: int = BROADCAST_BLOCKS,
    broadcast_bytes: int = BROADCAST_BYTES,
    n_blocks: int | None = None,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, canonical, maybe_listed, listed.

    A rule decides where one fits; else a page is blocked if its canonical URL is listed. Null
    URLs and URLs without ``://`` have empty host and path, no canonical form, and are allowed;
    repeated pages and null ids get a row each, repeated list entries count once, an empty list
    blocks nothing. Only the id and URL columns are read.
    """
    canon = listed.select(canonical_url(listed[listed_col]).alias("canonical")).dropna().distinct()
    canon = materialize(canon, "listed-urls")
    size = canon.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("canonical") + 32), F.lit(0)).alias("b")).first()
    n_blocks = n_blocks or max(1, -(-size["n"] * BITS_PER_KEY // (WORDS * WORD_BITS)))

    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("_url"))
    rows = rows.select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"), canonical_url(F.col("_url")).alias("canonical"))
    # Rows without a canonical form probe some block, so they don't meet in one task.
    block = _block(F.coalesce(F.col("canonical"), F.col("page_id").cast("string"), F.lit("")), n_blocks)
    rows = rows.withColumn("block", block)
    blocks = build_filter(canon, n_blocks)
    probed = rows.join(F.broadcast(blocks) if n_blocks <= broadcast_blocks else blocks, "block", "left")
    held = [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("canonical")))]
    maybe = held[0]
    for h in held[1:]:
        maybe = maybe & h
    probed = probed.withColumn("maybe_listed", F.coalesce(F.col("canonical").isNotNull() & maybe, F.lit(False)))
    # Possible hits look their URL up; all others carry a salt that no list entry has, so they match
    # nothing, and rows of one common URL or of none don't meet in one task of a shuffled join.
    salt = F.pmod(F.xxhash64("page_id", "canonical"), F.lit(SALTS)) + 1
    probed = probed.withColumn("salt", F.when(F.col("maybe_listed"), F.lit(0).cast("long")).otherwise(salt))
    exact = canon.select("canonical", F.lit(0).cast("long").alias("salt"), F.lit(True).alias("hit"))
    exact = F.broadcast(exact) if size["b"] <= broadcast_bytes else exact
    judged = probed.join(exact, ["canonical", "salt"], "left").withColumn("listed", F.coalesce("hit", F.lit(False)))
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule_column(host, path, rules, False).alias("rule"),
        F.coalesce(rule_column(host, path, rules, True), own).alias("verdict"),
        "canonical", "maybe_listed", "listed",
    )
