"""Chat formatting: collapse cumulative snapshots, then render the conversations that remain.

A logged conversation that is a turn prefix of a longer one is a snapshot of
it. Each turn's position and content are hashed; the running sum over the turns
gives 128 bits that identify a prefix. Only these hashes are shuffled. Prefix
hashes are reduced to distinct ones before the anti-join, equal conversations
to the smallest id with a count, so a first turn or a conversation that a third
of the log shares is one row on either side. Texts move only for conversations
that stay.

Edge cases: turns go by number (nulls first), then role and text digest, so
repeated turn numbers and repeated rows keep their place and all are rendered;
null roles and texts count as empty; rows with a null conv_id form one
conversation; extra columns are ignored. A conversation is one output value and
so the unit that a task renders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.llm.common import materialize, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
KEY = ["h0", "h1", "h2", "h3"]


def _turns(chats: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("digest"), text.alias("text"))


def _quarters(pos: Column, role: Column, digest: Column) -> list[Column]:
    """Four unsigned 32-bit parts of two hashes, as longs: sums of them can't overflow."""
    out = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), pos, role, digest)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))]
    return out


def prefixes(chats: DataFrame) -> DataFrame:
    """conv_id, pos, n_turns and the hash h0..h3 of the first pos turns, for every turn."""
    w = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    rows = _turns(chats).drop("text").withColumn("pos", F.row_number().over(w))
    rows = rows.select("conv_id", "turn", "role", "digest", "pos", *[q.alias(k) for q, k in zip(_quarters(F.col("pos"), F.col("role"), F.col("digest")), KEY)])
    run = w.rowsBetween(W.unboundedPreceding, 0)
    last = F.lead("pos").over(w).isNull()
    return rows.select("conv_id", "pos", last.alias("last"), *[F.sum(k).over(run).alias(k) for k in KEY])


def maximal(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (equal conversations) of those that no longer one contains as a prefix."""
    rows = materialize(prefixes(chats), "prefixes")
    whole = rows.filter("last").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.max("pos").alias("n_turns"), F.count("*").alias("n_copies"))
    inner = rows.filter("not last").select(*KEY).distinct()
    return whole.join(inner, KEY, "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies")


def render(chats: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations with their turns in chat mark-up."""
    turns = _turns(chats).join(kept.select(F.col("conv_id").alias("k")), F.col("conv_id").eqNullSafe(F.col("k")), "left_semi")
    body = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    cells = F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("turn"), "role", "digest", body.alias("body"))
    chat = F.concat_ws("", F.transform(F.sort_array(F.collect_list(cells)), lambda c: c["body"]))
    made = turns.groupBy(F.col("conv_id").alias("id")).agg(chat.alias("chat"))
    return kept.join(made, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    return render(chats, materialize(maximal(chats), "maximal"))


QUERIES = {"op1_chat": op1_chat}
ORACLES = {
    "op1_chat": f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, md5(coalesce(text, '')) as digest from conversations),
c as (select conv_id, count(*) as n_turns, list(md5(role || chr(1) || digest) order by turn nulls first, role, digest) as k,
 string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' order by turn nulls first, role, digest) as chat from t group by conv_id),
w as (select k, min(conv_id) as conv_id, count(*) as n_copies from c group by k),
p as (select distinct list_slice(k, 1, i) as k from (select k, unnest(range(1, n_turns)) as i from c))
select w.conv_id, c.n_turns, w.n_copies, c.chat from w join c using (conv_id) where not exists (select 1 from p where p.k = w.k)"""
}
