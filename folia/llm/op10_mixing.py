"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is a stream of words in a fixed pseudo-random order of its documents,
read up to twice. Its target is cut into blocks; the exact number of blocks of
each source is its quota. A binary tree splits the vector of quotas between the
two halves of the output shards by multivariate hypergeometric draws until each
shard has its own counts; a shard then draws the next blocks of each source, so
blocks are disjoint and none is left. Within a shard, blocks go by a hash. A
block has BLOCK_WORDS words, doubled until all quotas together are below 10**9,
where the draws are exact at any size of the corpus. Only one row a source
reaches the driver, and the shards are so many that their counts by source fit
MAX_CUTS longs. Positions in the stream are two-level sums (hash buckets of a
source, then rows of a bucket), so a source with a third of all rows is spread
over thousands of windows; rows go by a digest of doc_id and text, so a doc_id
that many rows share, or none, is spread as well.

Edge cases: a null text has size 0 and is never taken; a null source is a
source, last in order; sources of size 0 have target 0; repeated rows are rows
of their own; null doc_ids stay; an empty table gives no rows; more than
MAX_SOURCES sources are refused. Extra columns are ignored (``mix`` keeps the
columns of documents).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.llm.common import WORD, materialize, table

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS, MIN_SHARDS, MAX_SHARDS = 2048, 16384, 8, 4096
#: Sources are one row each on the driver; more than this is refused.
MAX_SOURCES = 1_000_000
#: Counts of blocks by shard and source that the driver holds (128 MB): with more sources there are fewer shards.
MAX_CUTS = 1 << 24
#: Blocks of all sources together from which they are larger: the limit of exact draws.
MAX_BLOCKS = 10**9
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> list[float]:
    """Targets of sources in order: shares by weight, none above ``most`` times its size."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total = min(share, most) * sum(sizes)
    full: set[int] = set()
    while True:
        rest, free = total - most * sum(sizes[i] for i in full), sum(x for i, x in enumerate(w) if i not in full)
        over = {i for i in range(len(w)) if i not in full and w[i] * rest / free > most * sizes[i]}
        if not over:
            return [float(most * sizes[i]) if i in full else w[i] * rest / free for i in range(len(w))]
        full |= over


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Block counts by shard (row) and source (column); columns sum to the quotas, rows are as equal as can be."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    slots = np.diff(np.arange(shards + 1) * int(quotas.sum()) // shards)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        a, z, have = todo.pop()
        if z - a == 1:
            out[a] = have
            continue
        mid = (a + z) // 2
        n = int(slots[a:mid].sum())
        left = draw(rng, have, n)
        todo += [(a, mid, left), (mid, z, have - left)]
    return out


def draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw of n, exact; all of have must be below MAX_BLOCKS."""
    return rng.multivariate_hypergeometric(have, n, method="marginals")


def plan_blocks(take: list[int], block_words: int = BLOCK_WORDS, max_blocks: int = MAX_BLOCKS) -> tuple[int, np.ndarray]:
    """Words of a block, and the number of blocks (quota) of each source."""
    while sum(-(-t // block_words) for t in take) >= max_blocks and block_words < max(take):
        block_words *= 2
    return block_words, np.array([-(-t // block_words) for t in take], np.int64)


def fits(sources: DataFrame, longs: int) -> bool:
    """Whether a row of so many longs for each source makes a small table (8 MB)."""
    return sources.count() * longs <= 1 << 20


def plan_shards(blocks: int, sources: int) -> int:
    wanted = min(MAX_SHARDS, max(MIN_SHARDS, -(-blocks // SHARD_BLOCKS)))
    return max(MIN_SHARDS, min(wanted, MAX_CUTS // max(1, sources) - 1))


def _source_plan(sized: DataFrame, weights, share, most, seed, block_words) -> tuple[DataFrame, int, int]:
    """Table of sources with their cuts (first block of each shard), number of shards, words of a block."""
    spark = sized.sparkSession
    stats = sized.groupBy("source").agg(F.sum("size").alias("n"))
    if (many := stats.count()) > MAX_SOURCES:
        raise ValueError(f"{many} sources; the limit is {MAX_SOURCES}")
    rows = sorted(stats.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    goal = targets([r["n"] for r in rows], weights, share, most) if rows else []
    take = [math.floor(t + 0.5) for t in goal]
    block_words, quotas = plan_blocks(take, block_words) if rows else (block_words, np.zeros(0, np.int64))
    shards = plan_shards(int(quotas.sum()), len(rows))
    cuts = np.zeros((len(rows), shards + 1), np.int64)
    if len(rows):
        cuts[:, 1:] = np.cumsum(split(quotas, shards, seed), axis=0).T
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cuts.size + 1, shards + 1, dtype=np.int32)), pa.array(cuts.ravel()))
    cols = [pa.array([r["source"] for r in rows], pa.string()), pa.array([int(r["n"]) for r in rows], pa.int64()), pa.array(goal, pa.float64()), pa.array(take, pa.int64()), lists]
    return spark.createDataFrame(pa.Table.from_arrays(cols, names=["source", "source_size", "target", "take", "cuts"])), shards, block_words


def _shard(cuts: Column, block: Column, shards: int) -> Column:
    """Index of the last cut at or below a block, by bisection."""

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        low = F.get(cuts, mid) <= block
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    steps = max(1, math.ceil(math.log2(shards)) + 1)
    init = F.struct(F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


def _pieces(base: Column, which: int, shards: int, seed: int, block_words: int) -> Column:
    """Pieces of a row whose words begin at ``base`` of the words drawn in a pass."""
    stop = F.least(base + F.col("size"), F.col("take"))
    blocks = F.sequence(F.floor(base / block_words), F.floor((stop - 1) / block_words))

    def piece(b: Column) -> Column:
        return F.struct(
            _shard(F.col("cuts"), b, shards).alias("shard"), F.xxhash64(F.lit(seed), "source", b).alias("rank"), F.lit(which).alias("pass"), b.alias("block"),
            (F.greatest(base, b * block_words) - base).cast("int").alias("start"), (F.least(stop, (b + 1) * block_words) - base).cast("int").alias("stop"),
        )

    return F.when(stop > base, F.transform(blocks, piece)).otherwise(F.array())


def _row_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Place of a row in its source: equal for equal rows only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of docs with source_size, target and pieces: array of (shard, rank, pass, block, start, stop), words of the text."""
    key = _row_key(F.col("doc_id"), F.col("text"), seed)
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("k"))
    sized = materialize(sized.withColumn("b", F.substring("k", 1, 3)), "sizes", narrow=True)
    sources, shards, block_words = _source_plan(sized, weights, share, most, seed, block_words)
    ahead = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = sized.groupBy("source", "b").agg(F.sum("size").alias("n")).withColumn("off", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    sums = sums.select(F.col("source").alias("s2"), F.col("b").alias("b2"), "off")
    within = W.partitionBy("source", "b").orderBy("k", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, 0)
    rows = sized.withColumn("upto", F.sum("size").over(within))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))).drop("s2", "b2")
    small = fits(sources, shards + 1)
    sources = sources.withColumnRenamed("source", "s3")
    rows = rows.join(F.broadcast(sources) if small else sources, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    begin = F.col("off") + F.col("upto") - F.col("size")
    made = [_pieces(begin + F.lit(p) * F.col("source_size"), p, shards, seed, block_words) for p in range(most)]
    # a shard draws the blocks from its own cut to the next one's
    pieces = F.filter(F.concat(*made), lambda p: (F.get("cuts", p["shard"]) <= p["block"]) & (p["block"] < F.get("cuts", p["shard"] + 1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "k", pieces.alias("pieces"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed pieces with the columns of docs (text cut to the piece) and mix_shard, mix_rank, mix_pass, mix_block, mix_start, mix_stop; sorted within shards."""
    # rows meet their plan by content, as doc_id may repeat or be null; the table's
    # own columns travel in a struct, so that none can clash
    tag = lambda k, source: F.concat_ws("|", k, F.coalesce(source.cast("string"), F.lit("\x00")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), docs["text"].alias("__text"), tag(_row_key(docs["doc_id"], docs["text"], seed), docs["source"]).alias("__id"), word_count(docs["text"]).alias("__n"))
    rows = rows.withColumn("__i", F.row_number().over(W.partitionBy("__id").orderBy("__n")))
    plan = plan_mix(docs, weights, share, most, seed).withColumn("__id", tag(F.col("k"), F.col("source")))
    plan = plan.withColumn("__i", F.row_number().over(W.partitionBy("__id").orderBy("size")))
    pieces = plan.filter(F.size("pieces") > 0).select("__id", "__i", F.explode("pieces").alias("__p"))
    out = rows.join(pieces, ["__id", "__i"])
    p = F.col("__p")
    words = F.slice(F.regexp_extract_all("__text", F.lit(f"({WORD})"), F.lit(0)), p["start"] + 1, p["stop"] - p["start"])
    text = F.when((p["start"] == 0) & (p["stop"] == F.col("__n")), F.col("__text")).otherwise(F.array_join(words, " "))
    own = [(text if c == "text" else F.col("__doc").getField(c)).alias(c) for c in docs.columns]
    made = out.select(*own, *[p[c].alias(f"mix_{c}") for c in ("shard", "rank", "pass", "block", "start", "stop")])
    return made.repartitionByRange("mix_shard", "mix_rank").sortWithinPartitions("mix_shard", "mix_rank", "mix_start")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digest: n_pieces, the pieces in which shards draw a document, and shard_words, the words that all shards draw of its source."""
    docs = table(spark, sf_dir, "documents")
    plan = plan_mix(docs)
    words = lambda: F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + (p["stop"] - p["start"]))
    rows = plan.select("doc_id", "source", "size", "source_size", "target", words().alias("taken"), F.size("pieces").cast("long").alias("n_pieces"), "pieces")
    rows = materialize(rows, "pieces", docs.count(), wide=True)
    drawn = rows.select("source", F.explode("pieces").alias("p")).groupBy("source", "p.shard").agg(F.sum(F.col("p.stop") - F.col("p.start")).alias("n"))
    drawn = drawn.groupBy(F.col("source").alias("s2")).agg(F.sum("n").cast("long").alias("shard_words"))
    # a source's words meet its rows where these are: no row moves to the task of its source
    drawn = materialize(drawn, "drawn", MAX_SOURCES)
    out = rows.join(F.broadcast(drawn) if fits(drawn, 2) else drawn, F.col("source").eqNullSafe(F.col("s2")), "left")
    return out.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", F.coalesce("shard_words", F.lit(0)).alias("shard_words"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {
    "op10_mixing": f"""
with d as (select doc_id, source, md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as k, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size from documents),
s as (select source, sum(size)::bigint as n, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end)::double as w from d group by source),
r as (select *, coalesce(sum(n) over o, 0) as before, coalesce(sum(w) over o, 0) as w_before, sum(n) over () as all_n, sum(w) over () as all_w from s
 window o as (order by n / w, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, 1.5 * all_n - 2 * before as rest, all_w - w_before as free from r),
f as (select *, w * rest / free > 2 * n as is_full from c),
e as (select 1.5 * all_n - 2 * coalesce((select sum(n) from f where is_full), 0) as rest, all_w - coalesce((select sum(w) from f where is_full), 0) as free from (select any_value(all_n) as all_n, any_value(all_w) as all_w from f) x),
t as (select source, n, case when is_full then 2.0 * n else w * e.rest / e.free end::double as target from f, e),
p as (select d.*, t.n, t.target, floor(t.target + 0.5)::bigint as take, (sum(size) over (partition by d.source order by k, doc_id nulls first, size rows unbounded preceding) - size)::bigint as a
 from d join t on d.source is not distinct from t.source)
select doc_id, size, n as source_size, target, cast(greatest(0, least(a + size, take) - a) + greatest(0, least(n + a + size, take) - (n + a)) as bigint) as taken,
 cast(case when least(a + size, take) > a then (least(a + size, take) - 1) // {BLOCK_WORDS} - a // {BLOCK_WORDS} + 1 else 0 end
 + case when least(n + a + size, take) > n + a then (least(n + a + size, take) - 1) // {BLOCK_WORDS} - (n + a) // {BLOCK_WORDS} + 1 else 0 end as bigint) as n_pieces, take as shard_words from p"""
}
