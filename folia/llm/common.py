"""What the training-data operators share: tables, cells, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.plans.scratch import drop_materialized, materialize, scratch_path, settle

__all__ = ["WORD", "by_cell", "cells", "connected_components", "drop_materialized", "materialize", "packed", "runs", "scratch_path", "settle", "star", "table", "whole"]

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Edges that one task unites (some 200 MB); more of them are brought down by rounds first.
ONE_TASK = 1 << 21


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Component of every node that has an edge: columns ``node`` and ``component`` (long).

    ``edges`` has long columns ``a`` and ``b``; rows with a null end or equal
    ends are no links. The component id is its smallest node. Alternating
    large-star and small-star steps run until the star forest is stable; each
    step is a minimum by node (combined before the shuffle) and a join back,
    which the adaptive planner can split where a node is hot. Once no more than
    ``one_task`` edges are left, one task unites them. Nothing is collected but
    two check sums a round.
    """
    spark = edges.sparkSession
    links = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    )
    now = materialize(links.distinct(), "edges")
    seen = _edge_sum(now)  # rounds never add edges, so their number bounds the next table's rows
    while seen[0]:
        if seen[0] <= one_task:
            after = materialize(now.coalesce(1).mapInArrow(_united, "u long, v long"), "edges", seen[0])
            drop_materialized(now)
            now = after
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest node around
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        after = materialize(small.filter("u <> v").distinct(), "edges", seen[0])
        got = _edge_sum(after)
        drop_materialized(now)
        now = after
        if got == seen:
            break
        seen = got
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a table: every node with the smallest one of its component, but that itself."""
    ends = [np.concatenate(c) for c in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches))]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    low = star(len(nodes), at[: len(ends[0])], at[len(ends[0]) :])
    for k in np.split(np.flatnonzero(low != np.arange(len(nodes))), range(1 << 16, len(nodes), 1 << 16)):
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(nodes[low[k]])], names=["u", "v"])


def _edge_sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def cells(rows: DataFrame, key: list[str], id_col: str, max_rows: int) -> DataFrame:
    """Deal rows of equal ``key`` into cells of at most about twice ``max_rows``.

    Keys with one row go. A key of more than ``max_rows`` rows is cut into
    chunks by a hash of ``id_col`` and each pair of chunks makes a cell, so all
    pairs of the key still meet in some cell while no task has to hold the
    key. Adds ``ci`` and ``cj`` (the chunks of the cell) and ``chunk`` (the
    row's own).
    """
    n = rows.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1")
    dealt = rows.join(n, key).withColumn("__k", F.ceil(F.col("__n") / F.lit(max_rows)).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.col("__k")).cast("int"))
    dealt = dealt.withColumn("__x", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return dealt.withColumn("ci", F.least("chunk", "__x")).withColumn("cj", F.greatest("chunk", "__x")).drop("__n", "__k", "__x")


def by_cell(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a cell next to each other in one partition."""
    return rows.repartition(*key, "ci", "cj").sortWithinPartitions(*key, "ci", "cj")


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of adjacent rows with equal key; memory is bounded by the longest run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        starts = np.flatnonzero(change)
        at = 0
        for s in starts:
            if s > at:
                held.append(batch.slice(at, s - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], int(s)
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def whole(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of many whole runs of adjacent rows with equal key; memory is bounded by a batch and the longest run."""
    held: list[pa.RecordBatch] = []

    def change(batch: pa.RecordBatch, after: pa.RecordBatch | None) -> np.ndarray:
        """Whether a row's key differs from that of the row before it."""
        out = np.zeros(batch.num_rows, bool)
        for k in key:
            c = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            out[1:] |= c[1:] != c[:-1]
            if after is not None:
                out[0] |= after.column(after.schema.get_field_index(k))[-1].as_py() != c[0]
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(change(batch, held[-1] if held else None))
        if len(cuts):
            last = int(cuts[-1])
            done = [*held, batch.slice(0, last)] if last else held
            if done:
                yield pa.Table.from_batches(done)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def packed(parts: Iterator[tuple[np.ndarray, ...]], names: list[str], rows: int = 16384) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows from many small tuples of columns."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def star(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of n items reaches over links i-j, on top of earlier labels."""
    labels = np.arange(n) if labels is None else labels
    while len(i):
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        np.minimum.at(labels, before, labels)
        labels = labels[labels]
        if (labels == before).all():
            break
    return labels
