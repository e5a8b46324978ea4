"""Embedding near-dedup by Euclidean p-stable hashing.

A table's key is a tuple of floor((a.x + b) / width) over Gaussian directions
a, for normalised vectors x. Vectors sharing a key in any table are compared by
cosine in double precision. The number of projections follows the number of
vectors so that an unrelated vector rarely shares a key, and the number of
tables follows from the share RECALL of pairs wanted at exactly ``min_cosine``;
closer pairs are found more often. Keys alone are shuffled to find those that
two vectors have; a vector travels only to the cells of these.

A pair is counted only in the first table that brings it together (the linked
vectors' keys are made again from the vectors), so link counts need no list of
pairs: a cell of a bucket gives each vector its number of links there and one
edge to its group.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors are scaled by
their largest component before their norm is taken, so that no norm overflows;
equal vectors are compared once and counted by their number; vectors of
different length never link; rows with a null vec_id are kept and may link,
though a component takes its id from the others while it has any. Repeated rows
stay rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import by_cell, cells, connected_components, materialize, packed, star, table, whole

MIN_COSINE = 0.9
WIDTH = 2.0
#: Wanted share of found links at exactly the least cosine; closer pairs are found more often.
RECALL = 0.96
#: Unrelated vectors that share a vector's key in a table, on average and at most.
MATES = 0.05
CELL_ROWS = 1024
#: Rows of cells that a task compares together; larger ones are compared each by itself.
SMALL = 48
SEED = 20_240_501


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points of this distance in one slot."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table and number of tables for n vectors."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(2 - 2 * min_cosine))
    k = max(2, math.ceil(math.log(max(n, 2) / MATES, 1 / far)))
    return k, max(4, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Slots:
    """Keys of vectors: one long for each table, of the slots of its projections and the vector's length."""

    def __init__(self, k: int, n_tables: int):
        self.k, self.n_tables = k, n_tables
        self.made: dict[int, tuple] = {}

    def __call__(self, x: np.ndarray, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Of rows of one length, scaled to length 1: keys of tables first..stop-1."""
        dim, stop = x.shape[1], self.n_tables if stop is None else min(stop, self.n_tables)
        if dim not in self.made:
            rng = np.random.default_rng([SEED, dim])
            mix = rng.integers(1, 2**62, size=(self.n_tables, self.k), dtype=np.int64) | 1
            self.made[dim] = rng.standard_normal((dim, self.n_tables * self.k)), rng.uniform(0, WIDTH, self.n_tables * self.k), mix
        a, b, mix = self.made[dim]
        part = slice(first * self.k, stop * self.k)
        a, b, mix = np.ascontiguousarray(a[:, part]), b[part], mix[first:stop]
        out = np.empty((len(x), stop - first), np.int64)
        for r in range(0, len(x), 256):
            slot = np.floor((x[r : r + 256] @ a + b) / WIDTH).astype(np.int64).reshape(-1, stop - first, self.k)
            out[r : r + 256] = (slot * mix).sum(axis=2) + dim
        return out


def _of_length(flat: np.ndarray, ends: np.ndarray, at: np.ndarray, dim: int) -> np.ndarray:
    return unit(flat[(ends[at] - dim)[:, None] + np.arange(dim)])


def _hasher(k: int, n_tables: int):
    """vid, table and key of each vector."""

    def run(batches):
        slots = Slots(k, n_tables)
        for batch in batches:
            for r in range(0, batch.num_rows, 1024):
                vid, vectors = batch.column(0)[r : r + 1024].to_numpy(), batch.column(1)[r : r + 1024]
                sizes = np.asarray(vectors.value_lengths())
                flat, ends = vectors.flatten().to_numpy(), np.cumsum(sizes)
                keys = np.zeros((len(vid), n_tables), np.int64)
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    keys[at] = slots(_of_length(flat, ends, at, dim))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(n_tables, dtype=np.int32), len(vid))), pa.array(np.repeat(vid, n_tables))], names=["bucket", "tab", "vid"])

    return run


def _met(batches):
    """Of rows sorted by bucket and table: those whose key has another vector."""
    held: tuple | None = None  # the last row, undecided
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(batch.column(k).to_numpy() for k in range(3))
        if held is not None:
            cols = tuple(np.concatenate(p) for p in zip(held, cols))
        bucket, tab, _ = cols
        same = np.concatenate(([last is not None and last == (bucket[0], tab[0])], (bucket[1:] == bucket[:-1]) & (tab[1:] == tab[:-1])))
        good = same.copy()
        good[:-1] |= same[1:]
        last, held = ((bucket[-1], tab[-1]), None) if good[-1] else (None, tuple(c[-1:] for c in cols))
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in cols], names=["bucket", "tab", "vid"])


def _pairs(x: np.ndarray, cell: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one cell whose product is at least ``least``: small cells together, large ones each."""
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(first, len(cell)))
    for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        for r in range(0, n, 512):
            i, j = np.nonzero(x[a + r : a + min(r + 512, n)] @ x[a : a + n].T >= least)
            i += r
            yield a + i[i < j], a + j[i < j]
    small = np.repeat(size <= SMALL, size)
    for d in range(1, SMALL):
        at = np.flatnonzero((cell[:-d] == cell[d:]) & small[d:])
        if not len(at):
            break
        for p in range(0, len(at), 16384):
            i = at[p : p + 16384]
            good = np.einsum("ij,ij->i", x[i], x[i + d]) >= least
            yield i[good], i[good] + d


def _met_before(x: np.ndarray, i: np.ndarray, j: np.ndarray, tab: np.ndarray, slots: Slots, step: int = 6) -> np.ndarray:
    """Whether a pair has equal keys in a table before its own. Close pairs have them early, so tables are tried a few at a time."""
    met = np.zeros(len(i), bool)
    todo = np.flatnonzero(tab > 0)
    first = 0
    while len(todo):
        rows, where = np.unique(np.concatenate((i[todo], j[todo])), return_inverse=True)
        keys = slots(x[rows], first, first + step)
        a, b = where[: len(todo)], where[len(todo) :]
        for p in range(0, len(todo), 1 << 16):
            part = slice(p, p + (1 << 16))
            earlier = first + np.arange(keys.shape[1]) < tab[todo[part], None]
            met[todo[part]] = ((keys[a[part]] == keys[b[part]]) & earlier).any(axis=1)
        first += step
        todo = todo[~met[todo] & (tab[todo] > first)]
        step *= 2
    return met


def _linker(min_cosine: float, k: int, n_tables: int):
    """For each row of a cell: vid, its links met here first, and the first vid of its group in the cell."""

    def links(batches):
        slots = Slots(k, n_tables)
        for rows in whole(batches, ["tab", "bucket", "ci", "cj"]):
            vid, size, tab, bucket, ci, cj, chunk = (rows.column(c).to_numpy() for c in ("vid", "n_same", "tab", "bucket", "ci", "cj", "chunk"))
            cell = np.cumsum(np.concatenate(([False], (tab[1:] != tab[:-1]) | (bucket[1:] != bucket[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1]))))
            vecs = rows.column("vec").combine_chunks()
            lens = np.asarray(vecs.value_lengths())
            flat, ends = vecs.flatten().to_numpy(), np.cumsum(lens)
            count, labels = np.zeros(len(vid), np.int64), np.arange(len(vid))
            # keys of different lengths may meet by chance; such vectors don't link
            for dim in np.unique(lens).tolist():
                g = np.flatnonzero(lens == dim)
                x = _of_length(flat, ends, g, dim)
                for i, j in _pairs(x, cell[g], min_cosine - 1e-9):
                    once = (ci[g[i]] == cj[g[i]]) | (chunk[g[i]] != chunk[g[j]])
                    i, j = i[once], j[once]
                    # the stated cosine decides, of the vectors as they are
                    stay = np.concatenate([np.zeros(0, bool), *(cosines(flat, ends, g, dim, i[p : p + 16384], j[p : p + 16384]) >= min_cosine for p in range(0, len(i), 16384))])
                    i, j = i[stay], j[stay]
                    met = _met_before(x, i, j, tab[g[i]], slots)
                    i, j = g[i[~met]], g[j[~met]]
                    np.add.at(count, i, size[j])
                    np.add.at(count, j, size[i])
                    labels = star(len(vid), i, j, labels)
            at = np.flatnonzero(count)
            if len(at):
                yield vid[at], count[at], vid[labels[at]]

    return lambda batches: packed(links(batches), ["vid", "links", "root"])


def cosines(flat: np.ndarray, ends: np.ndarray, g: np.ndarray, dim: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of vectors, by their dot product over the product of their norms."""
    a, b = (flat[(ends[g[k]] - dim)[:, None] + np.arange(dim)] for k in (i, j))
    a, b = (v / np.exp2(np.floor(np.log2(np.abs(v).max(axis=1, keepdims=True)))) for v in (a, b))  # by powers of two, which is exact
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def embedding_groups(vectors: DataFrame, min_cosine: float = MIN_COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0.0)
    usable = F.coalesce(v.isNotNull() & ~bad & some, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("vec"))
    good = rows.filter("vec is not null")
    # an id of the vector's own, as vec_id may be null or repeat
    mark = (F.xxhash64(F.lit(1), "vec").alias("m0"), F.xxhash64(F.lit(2), "vec").alias("m1"))
    once = good.groupBy("vec").agg(F.count("*").alias("n_same"), F.min("vec_id").alias("low"))
    once = materialize(once.select(F.monotonically_increasing_id().alias("vid"), "vec", "n_same", "low", *mark), "vectors", vectors.count())
    n = once.count()
    k, n_tables = plan_tables(n, min_cosine)
    slots = once.select("vid", "vec").mapInArrow(_hasher(k, n_tables), "bucket long, tab int, vid long")
    slots = slots.repartition("bucket").sortWithinPartitions("bucket", "tab").mapInArrow(_met, "bucket long, tab int, vid long")
    met = cells(materialize(slots, "slots"), ["tab", "bucket"], "vid", cell_rows)
    # only vectors that meet another travel, once for each such cell
    met = met.join(once.select("vid", "vec", "n_same"), "vid").select("tab", "bucket", "ci", "cj", "chunk", "vid", "n_same", "vec")
    found = by_cell(met, ["tab", "bucket"]).mapInArrow(_linker(min_cosine, k, n_tables), "vid long, links long, root long")
    found = materialize(found, "links")
    links = found.groupBy("vid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("vid").alias("a"), F.col("root").alias("b")))
    named = once.select("vid", "n_same", "low").join(comp.withColumnRenamed("node", "vid"), "vid", "left").join(links, "vid", "left")
    named = materialize(named.select("vid", "low", F.coalesce("component", "vid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n_same") - 1).alias("n_links")), "named", n)
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # rows find their vector by 128 bits of hashes, so no vector is shuffled here
    named = once.select("vid", "m0", "m1").join(named, "vid").join(least, "root").select("m0", "m1", "n_links", "component_id")
    out = good.select("vec_id", *mark).join(named, ["m0", "m1"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


_OK = "embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
QUERIES = {"op2_embedding": op2_embedding}
ORACLES = {
    "op2_embedding": f"""
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where {_OK}),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {MIN_COSINE}),
reach as (select vec_id as node, vec_id as root from embeddings union select l.b, r.root from reach r join links l on l.a = r.node),
comp as (select node, min(root) as component_id from reach group by node),
n as (select a, count(*) as n_links from links group by a)
select e.vec_id, cast(coalesce(n.n_links, 0) as bigint) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join comp c on c.node = e.vec_id left join n on n.a = e.vec_id"""
}
