"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``rate`` edits a character. Cut into one piece
more than that budget, some piece must occur unchanged; one Aho-Corasick pass
over a document finds all piece hits, and from each the rest of the item is
compared on both sides with Myers' bit-parallel distance (whole integers as bit
vectors). Items are a stated query set: they go to the executors in blocks of
bounded size, however many there are, and a document is read once a block; with
several blocks, each one's result is stored and the block released before the
next is collected, so driver and executors hold one block at a time.

Both sides are compared lower-cased with runs of anything but letters and
digits as one blank. Edge cases: null and empty texts and items match nothing;
items below ``min_chars`` must occur as whole words; repeated items and rows
give their own pairs; null ids stay null; of equally near places the first found
counts (pieces from left to right, each by its occurrences in the text), and a
block holds at least one item, however long. Extra columns are ignored
(``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import drop_materialized, materialize, table

RATE = 0.08
#: Shorter items have no budget and must stand between blanks.
MIN_CHARS = 24
#: Characters of items in one automaton.
BLOCK_CHARS = 4 << 20
PAIR = "doc_id long, item_id long, distance int, budget int, norm_start int, norm_stop int"

_OTHER = re.compile(r"[\W_]+")


def normalize(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def anchored(pattern: str, text: str, table_: dict[str, int]) -> tuple[int, int]:
    """Least edit distance of pattern to a prefix of text, and that prefix's length (Myers; table_: positions by character)."""
    m = len(pattern)
    if not m:
        return 0, 0
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, at = full, 0, m, m, 0
    get = table_.get
    for j, ch in enumerate(text, 1):
        eq = get(ch, 0) & full
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
            if score < best:
                best, at = score, j
        hp = (hp << 1) | 1
        vp = ((hn << 1) | ~(d0 | hp)) & full
        vn = hp & d0 & full
    return best, at


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        out[ch] |= 1 << i
    return dict(out)


class Matcher:
    """Finds items in texts within their budgets."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE, min_chars: int = MIN_CHARS):
        self.items = []
        self.pieces: list[list[tuple[int, int, int]]] = []
        self.auto = ahocorasick.Automaton()
        self.sides: dict[tuple[int, int, int], tuple] = {}
        for item_id, text in items:
            norm = normalize(text)
            if not norm:
                continue
            short = len(norm) < min_chars
            k = 0 if short else int(len(norm) * rate)
            n = len(self.items)
            self.items.append((item_id, norm, k, short))
            cut = [len(norm) * j // (k + 1) for j in range(k + 2)]
            for a, z in zip(cut, cut[1:]):
                word = norm[a:z]
                at = self.auto.get(word, None)
                if at is None:
                    at = len(self.pieces)
                    self.pieces.append([])
                    self.auto.add_word(word, at)
                self.pieces[at].append((n, a, z))
        self.auto.make_automaton()

    def _side(self, n: int, a: int, z: int) -> tuple:
        if (got := self.sides.get((n, a, z))) is None:
            left, right = self.items[n][1][:a][::-1], self.items[n][1][z:]
            got = self.sides[n, a, z] = left, bits(left), right, bits(right)
        return got

    def find(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """Best (distance, start, stop) of each item (by index) that occurs, as offsets in the normalised text."""
        norm = normalize(text)
        best: dict[int, tuple[int, int, int]] = {}
        if not self.pieces or not norm:
            return best
        for end, at in self.auto.iter(norm):
            for n, a, z in self.pieces[at]:
                have = best.get(n)
                if have and have[0] == 0:
                    continue
                _, item, k, short = self.items[n]
                start, stop = end + 1 - (z - a), end + 1
                whole = start - a, start - a + len(item)
                if whole[0] >= 0 and norm.startswith(item, whole[0]):
                    if not short or ((whole[0] == 0 or norm[whole[0] - 1] == " ") and norm[whole[1] : whole[1] + 1] in ("", " ")):
                        best[n] = (0, *whole)
                    continue
                if not k:
                    continue
                left, lbits, right, rbits = self._side(n, a, z)
                limit = min(k, have[0] - 1) if have else k
                # the first 64 characters of the longer side decide most chance hits
                if len(right) >= len(left):
                    if anchored(right[:64], norm[stop : stop + 64 + k], rbits)[0] > limit:
                        continue
                elif anchored(left[:64], norm[max(0, start - 64 - k) : start][::-1], lbits)[0] > limit:
                    continue
                dr, r = anchored(right, norm[stop : stop + len(right) + k], rbits)
                if dr > limit:
                    continue
                dl, lft = anchored(left, norm[max(0, start - len(left) - k) : start][::-1], lbits)
                if dr + dl <= limit:
                    best[n] = (dr + dl, start - lft, stop + r)
        return best


_made: dict[str, Matcher] = {}


def _matcher(name: str, shared, rate: float, min_chars: int) -> Matcher:
    """The automaton of the block at hand, which a worker keeps."""
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(shared.value, rate, min_chars)
    return _made[name]


def _finder(shared, rate: float, min_chars: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, shared, rate, min_chars)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                for n, (distance, start, stop) in matcher.find(texts[i].as_py()).items():
                    row = (ids[i].as_py(), matcher.items[n][0], distance, matcher.items[n][2], start, stop)
                    for col, v in zip(out, row):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in PAIR.split(", ")])

    return run


def _cleaner(shared, rate: float, min_chars: int, at: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, shared, rate, min_chars)
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array([not matcher.find(texts[i].as_py()) for i in range(batch.num_rows)], pa.bool_()))

    return run


def count_blocks(items: DataFrame, block_chars: int) -> int:
    """Blocks of about block_chars characters each that the items make."""
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-int(total) // block_chars))


def item_block(items: DataFrame, k: int, n: int) -> list[tuple[int | None, str]]:
    """Block k of n of the items (item_id, text); a longer single item is a block."""
    mine = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return [(r["item_id"], r["text"]) for r in mine.collect()]


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item that occurs in it, with the best occurrence."""
    spark, items = docs.sparkSession, _items(items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, out = count_blocks(items, block_chars), None
    for k in range(n):
        shared = spark.sparkContext.broadcast(item_block(items, k, n))
        got = rows.mapInArrow(_finder(shared, rate, min_chars), PAIR)
        if n > 1:
            got = materialize(got, "found")
            shared.destroy()
        out = got if out is None else out.unionByName(got)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no item occurs; each row is judged by its own text, whatever its id."""
    spark, items = docs.sparkSession, _items(items)
    n, out = count_blocks(items, block_chars), docs
    for k in range(n):
        shared = spark.sparkContext.broadcast(item_block(items, k, n))
        got = out.mapInArrow(_cleaner(shared, rate, min_chars, docs.columns.index("text")), docs.schema)
        if n > 1:
            got = materialize(got, "clean")
            shared.destroy()
            if k:
                drop_materialized(out)
        out = got
    return out


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {}
