"""SimHash near-dedup over a Gray-ordered hierarchical index.

Fingerprints are XXH64 SimHashes of four-word shingles. Distinct fingerprints
are compared, never documents: copies share one. Any two fingerprints that
differ in at most ``max_diff`` bits agree on at least ``agree`` of ``blocks``
bit blocks, so the rows of each such block pattern are a complete search
space. Within one, fingerprints are sorted by Gray rank; runs of neighbours
form a tree whose nodes hold the bits that all members share. A search adds up
differences on the newly shared bits while it goes down and drops a whole
group once the sum exceeds the limit.

Edge cases: a null text counts as empty; no words give fingerprint zero, which
links like any other; fewer than four words are one shingle; repeated rows
keep their rows; a null doc_id has a fingerprint and takes the component of its
fingerprint, but never names one while a non-null id is there. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import by_cell, cells, connected_components, materialize, packed, runs, star, table

SHINGLE = 4
MAX_DIFF = 4
#: Rows of a bucket that one task takes; larger buckets are cut into pairs of chunks.
CELL_ROWS = 1024
LEAF, FANOUT = 8, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set if over half the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):  # bounded memory on very long texts
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(ones * 2 > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        fps = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names=[*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, the further columns and fp (the 64 bits as a long) of every row."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in more.items()])
    schema = ", ".join(f"{k} {t}" for k, t in rows.dtypes[1:])
    return rows.mapInArrow(_fingerprints, f"{schema}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a code in the reflected Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchy over Gray-sorted codes; levels go from the root's children to single codes."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        codes = fps[self.order]
        full = np.full(len(codes), ~np.uint64(0))
        levels = [(codes, full, np.arange(len(codes)))]
        size = LEAF
        while len(levels[-1][0]) > 16:
            pat, mask, last = levels[-1]
            cut = np.arange(0, len(pat), size)
            ones = np.bitwise_and.reduceat(pat & mask, cut)
            zeros = np.bitwise_and.reduceat(~pat & mask, cut)
            ends = np.append(cut[1:], len(pat)) - 1
            levels.append((ones, ones | zeros, last[ends]))
            size = FANOUT
        self.levels = levels[::-1]

    def pairs(self, max_diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of positions at most max_diff bits apart, in bounded portions."""
        codes = self.levels[-1][0]
        top = np.arange(len(self.levels[0][0]))
        for q0 in range(0, len(codes), 512):
            q = np.arange(q0, min(q0 + 512, len(codes)))
            qi, node = np.repeat(q, len(top)), np.tile(top, len(q))
            acc = np.zeros(len(qi), np.int16)
            above = np.zeros(len(qi), np.uint64)
            for depth, (pat, mask, last) in enumerate(self.levels):
                rest = mask[node] & ~above
                acc = acc + np.bitwise_count((codes[qi] ^ pat[node]) & rest)
                keep = (acc <= max_diff) & (last[node] > qi)
                qi, node, acc = qi[keep], node[keep], acc[keep]
                if depth + 1 == len(self.levels):
                    break
                width = LEAF if depth + 2 == len(self.levels) else FANOUT
                below = len(self.levels[depth + 1][0])
                above = np.repeat(mask[node], width)
                qi, acc = np.repeat(qi, width), np.repeat(acc, width)
                node = (node[:, None] * width + np.arange(width)).ravel()
                real = node < below
                qi, acc, above, node = qi[real], acc[real], above[real], node[real]
            yield self.order[qi], self.order[node]


def hamming_star(fps: np.ndarray, max_diff: int) -> np.ndarray:
    """For each code the smallest position it reaches over links within this array."""
    labels = np.arange(len(fps))
    for i, j in GrayIndex(fps).pairs(max_diff):
        labels = star(len(fps), i, j, labels)
    return labels


def plan_blocks(n: int, max_diff: int) -> tuple[int, int]:
    """Blocks and agreeing blocks: the keys' width follows the number of codes, so buckets stay small."""
    agree = 1
    while agree < 4 and n >> (64 * agree // (max_diff + agree)) > 256:
        agree += 1
    return max_diff + agree, agree


def _links(max_diff: int):
    def links(batches):
        for cell in runs(batches, ["pattern", "value", "ci", "cj"]):
            ids = cell.column("fp").to_numpy()
            labels = hamming_star(ids.view(np.uint64), max_diff)
            moved = np.flatnonzero(labels != np.arange(len(ids)))
            if len(moved):
                yield ids[moved], ids[labels[moved]]

    return lambda batches: packed(links(batches), ["a", "b"])


def link_fingerprints(fps: DataFrame, max_diff: int = MAX_DIFF, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links a-b that connect distinct codes (column fp) exactly as all pairs within max_diff bits do."""
    blocks, agree = plan_blocks(fps.count(), max_diff)
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    patterns = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        patterns.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in patterns]))
    rows = fps.select("fp", keys.alias("pattern", "value"))
    dealt = by_cell(cells(rows, ["pattern", "value"], "fp", cell_rows), ["pattern", "value"])
    dealt = dealt.select("pattern", "value", "ci", "cj", "fp")
    return dealt.mapInArrow(_links(max_diff), "a long, b long").distinct()


def simhash_roots(docs: DataFrame, max_diff: int = MAX_DIFF, **more: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of doc_id, further columns and fp; and of each fp its smallest doc_id (low) and the root of its group."""
    rows = materialize(fingerprints(docs, **more), "fingerprints")
    n = rows.count()
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_same")), "codes", n)
    comp = connected_components(link_fingerprints(distinct.select("fp"), max_diff))
    of = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
    return rows, materialize(of.select("fp", "low", F.coalesce("component", "fp").alias("root")), "roots", n)


def simhash_groups(docs: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    rows, of = simhash_roots(docs, max_diff)
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(docs: DataFrame) -> Column:
    """Digest of doc_id and text: equal for rows that agree in both, nulls included."""
    return F.md5(F.concat_ws("|", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.coalesce(F.md5(docs["text"].cast("string")), F.lit("null"))))


def one_of_each(docs: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """One row of each group, with all columns of docs: that of the smallest doc_id (none last), then of the smallest digest.

    Rows are told apart by doc_id and text, so a repeated or missing doc_id
    neither keeps a copy nor drops another text; of equal rows one stays.
    """
    rows, of = simhash_roots(docs, max_diff, k=row_key(docs))
    first = rows.join(of.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("one"))
    # the table's own columns travel in a struct, so that none can clash
    own = docs.select(row_key(docs).alias("__k"), F.struct(*[docs[c] for c in docs.columns]).alias("__doc"))
    kept = own.join(first.select(F.col("one.k").alias("__k")), "__k", "left_semi").dropDuplicates(["__k"])
    return kept.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
