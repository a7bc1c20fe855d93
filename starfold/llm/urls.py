"""URL filter: host and path rules, then a blocked Bloom filter of listed URLs before an exact join.

The filter is a table of 256-bit blocks (four longs each). A URL has one block and two bits in each
of its words, so one lookup of one block answers "possibly listed". Only possible hits go to the
exact hash join with the list, which removes the false ones; a URL that fails the filter is not
listed and is never shuffled. The block table is broadcast while its counted size is small and joined
by block beyond that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import cut, small_enough

BITS_PER_URL = 16
WORDS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_NAMES = [f"w{i}" for i in range(WORDS)]

#: (verdict, rule): a rule is a host, subdomains included, and the beginning of a path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.``, and path without slashes at its end."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.rtrim(path, F.lit("/")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for answer, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(answer)).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block")


def _masks(url: Column) -> list[Column]:
    """Two bits for each word, from another hash of the URL."""
    spread = F.xxhash64(url, F.lit(1))
    masks = []
    for i in range(WORDS):
        bits = [F.shiftright(spread, 12 * i + 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in (0, 1)]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]))
    return masks


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) from distinct URLs in a column ``listed``; blocks without a URL have no row."""
    marked = listed.select(_block(F.col("listed"), blocks), *[m.alias(n) for m, n in zip(_masks(F.col("listed")), WORD_NAMES)])
    return marked.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in WORD_NAMES])


def possible(urls: DataFrame, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """``urls`` (column ``canonical``) with ``maybe``: false for none of the listed ones."""
    probe = urls.withColumn("block", _block(F.col("canonical"), blocks))
    words = small_enough(filter_rows, blocks, 120)
    found = probe.join(words, "block", "left")
    hits = [F.col(n).bitwiseAND(m) == m for n, m in zip(WORD_NAMES, _masks(F.col("canonical")))]
    maybe = F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))
    return found.withColumn("maybe", maybe).drop("block", *WORD_NAMES)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per page.

    The longest rule that fits decides; without one, a page is blocked if its canonical URL is in
    ``listed`` (one column, ``url``: full URLs, made canonical here) and else allowed. A null url or
    one without ``://`` has empty host and path, fits no rule, is never listed and is allowed. Null
    page ids, repeated rows and other columns are fine; an empty list blocks nothing.
    """
    entry = canonical(host_of(F.col("url")), path_of(F.col("url")))
    entries = cut(listed.select(entry.alias("listed")).where("listed != ''").distinct(), "listed-urls")
    blocks = max(1, -(-entries.count() * BITS_PER_URL // (64 * WORDS)))
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    ruled = parts.where("rule is not null")
    rest = parts.where("rule is null").withColumn("canonical", canonical(F.col("host"), F.col("path")))
    tested = cut(possible(rest, bloom_filter(entries, blocks), blocks), "bloom-tested")
    clear = tested.where("not maybe").withColumn("verdict", F.lit("allow"))
    hits = tested.where("maybe").join(entries.hint("shuffle_hash"), F.col("canonical") == F.col("listed"), "left")
    hits = hits.withColumn("verdict", F.when(F.col("listed").isNotNull(), "block").otherwise("allow"))
    names = ["page_id", "host", "path", "rule", "verdict"]
    return ruled.select(names).unionByName(clear.select(names)).unionByName(hits.select(names))
