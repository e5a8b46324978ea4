"""URL filter: longest-match rules, then a Bloom filter cascade over listed domains.

The listed domains cover their subdomains. The corpus's key universe is every
domain suffix of its hosts that has as many labels as some listed domain.
Level 1 encodes the listed keys, level 2 the unlisted keys of the universe that
pass level 1, level 3 the listed keys that pass level 2, and so on until a
level lets nothing wrong through; the parity of the first level that rejects a
key is then its exact membership for every key of this universe. Levels are
bit arrays in the plan, in segments, sized by the cascade's theory: a list of n
domains in a universe of u needs about n (1.44 log2(u / n) + 5) bits. Urls are
judged without a join, and no Python runs on the executors. A list whose levels
exceed MAX_WORDS words (some 2 million domains in a universe of 10^9) has no
place in a plan; its hosts are found by a join of distinct keys, as exactly.

Edge cases: a null url or one without ``://`` has empty host and path, no rule
and is allowed; an empty list blocks nothing; null or empty listed keys are
ignored; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import drop_materialized, materialize, table

#: (host and path prefix, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets") for top in ("com", "net", "org"))
#: Words of one literal in the plan (512 KB), and of all levels of a cascade together (8 MB).
SEGMENT_WORDS, MAX_WORDS = 1 << 16, 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    domain, slash, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)


def suffix(host: Column, labels: int) -> Column:
    """The last labels of a host; null if it has fewer."""
    return F.when(F.length(host) - F.length(F.replace(host, F.lit("."))) >= labels - 1, F.substring_index(host, ".", -labels))


def _bit(key: Column, j: int, level: int, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(j), F.lit(level)), F.lit(words * 64))


def plan_level(n: int, others: int, level: int) -> tuple[int, int]:
    """Words and hash functions of a level that holds n keys and is asked for others.

    The first level lets about n / sqrt(2) of the others through, each further
    one half of its own, so all levels together need some 1.44 log2(others / n)
    + 5 bits a listed key: the corpus's size counts by its logarithm only.
    """
    bits = max(1.0, math.log2(math.sqrt(2) * max(others, 1) / n)) if level == 1 else 1.0
    return max(1, math.ceil(n * bits / math.log(2) / 64)), max(1, round(bits))


class Cascade:
    """Exact membership of the universe's keys in the listed keys.

    ``fits`` is false if the levels would need more than max_words words; the
    caller then has to join (see :func:`judge_urls`).
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, max_words: int = MAX_WORDS, segment_words: int = SEGMENT_WORDS, bits_a_key: int | None = None):
        """universe and listed have a column key."""
        self.levels: list[tuple[int, int, list[list[int]]]] = []
        self.segment_words = segment_words
        n, total = listed.count(), universe.count()
        held: list[DataFrame] = []
        self.fits, left = True, max_words
        # a list that fits is small, so its size is proven before it is broadcast
        small = plan_level(n, total, 1)[0] <= max_words if n else True
        inside, outside = listed, universe.join(F.broadcast(listed) if small else listed, "key", "left_anti")
        others = total
        while n:
            level = len(self.levels) + 1
            words, hashes = plan_level(n, others, level)
            if bits_a_key:
                words, hashes = max(1, -(-n * bits_a_key // 64)), max(1, round(bits_a_key * math.log(2)))
            left -= words
            if left < 0:
                self.fits = False
                break
            bits = inside.select(F.explode(F.array(*[_bit(F.col("key"), j, level, words) for j in range(hashes)])).alias("bit"))
            # at most as many rows as words, and their number was checked above
            filled = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
            array = [0] * words
            for w, b in zip(filled.column("word").to_pylist(), filled.column("bits").to_pylist()):
                array[w] = b
            self.levels.append((words, hashes, [array[k : k + segment_words] for k in range(0, words, segment_words)]))
            wrong = materialize(outside.filter(self.passes(F.col("key"), level)).select("key"), "cascade", total)
            held.append(wrong)
            inside, outside, others = wrong, inside, n
            n = wrong.count()
        for x in held:
            drop_materialized(x)

    def passes(self, key: Column, level: int) -> Column:
        words, hashes, segments = self.levels[level - 1]
        parts = [F.lit(x).cast("array<bigint>") if len(x) < 64 else F.from_json(F.lit(str(x)), "array<bigint>") for x in segments]
        hit = F.lit(True)
        for j in range(hashes):
            bit = _bit(key, j, level, words)
            at = F.shiftright(bit, 6).cast("int")
            part = parts[0] if len(parts) == 1 else F.get(F.array(*parts), F.floor(at / self.segment_words).cast("int"))
            word = F.get(part, at % self.segment_words)
            hit = hit & (F.expr("1L").bitwiseAND(F.call_function("shiftright", word, (bit % 64).cast("int"))) == 1)
        return hit

    def member(self, key: Column) -> Column:
        """True for listed keys; decided by the first level that rejects the key."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            out = F.when(~self.passes(key, level), F.lit(level % 2 == 0)).otherwise(out)
        return F.when(key.isNull(), F.lit(False)).otherwise(out)


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_words: int = MAX_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``listed`` has a column key of lower-case domains."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = listed.select(F.translate("key", _UPPER, _LOWER).alias("key")).filter("key <> ''").distinct()
    keys = materialize(keys, "listed", narrow=True)
    depths = sorted(r[0] for r in keys.select(F.size(F.split("key", r"\."))).distinct().collect())  # a host has at most 127 labels
    sufs = [suffix(F.col("host"), d) for d in depths]
    block = F.lit(False)
    if sufs:
        hosts = rows.select("host").distinct()
        universe = materialize(hosts.select(F.explode(F.array(*sufs)).alias("key")).filter("key is not null").distinct(), "universe")
        cascade = Cascade(universe, keys, max_words)
        if cascade.fits:
            for s in sufs:
                block = block | cascade.member(s)
        else:  # a list too long for the plan: listed hosts are found by a join of distinct keys, and meet the pages by host
            found = hosts.select("host", F.explode(F.array(*sufs)).alias("key")).join(keys, "key", "left_semi").select(F.col("host").alias("__listed")).distinct()
            rows = rows.join(found, rows["host"] == found["__listed"], "left")
            block = F.col("__listed").isNotNull()
    rule, verdict = F.lit(None).cast("string"), F.when(block, "block").otherwise("allow")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        fits = _fits(text, F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op6_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in LISTED])).alias("key"))
    return judge_urls(table(spark, sf_dir, "pages"), listed)


def _oracle() -> str:
    host = f"translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}')"
    path = f"coalesce(regexp_extract(url, '{_URL}', 2), '')"
    rule, verdict = [], []
    for text, says in sorted(RULES, key=lambda r: -len(r[0])):
        domain, slash, rest = text.partition("/")
        when = f"when (host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '{slash}{rest}') then"
        rule.append(f"{when} '{text}'")
        verdict.append(f"{when} '{says}'")
    listed = "|".join(re.escape(x).replace(r"\-", "-") for x in LISTED)
    return f"""select page_id, host, path, case {' '.join(rule)} end as rule,
 case {' '.join(verdict)} when regexp_matches(host, '(^|\\.)({listed})$') then 'block' else 'allow' end as verdict
from (select page_id, {host} as host, {path} as path from pages)"""


QUERIES = {"op6_url": op6_url}
ORACLES = {"op6_url": _oracle()}
