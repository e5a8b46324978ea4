"""Passages that repeat across documents, by compact windows of token min-hashes.

Tokens are hashed five-word shingles. For each hash function, the Cartesian
tree of a text's token hashes gives compact windows (l, c, r): the token at c is
the minimum of every subsequence within l..r that holds c. Only subsequences of
the T tokens of ``min_words`` words count, so a window is a run of their starts.

1. Windows meet by function and minimum. Those whose minimum no other text has
   as one go; an interval join of a text's other windows leaves the ranges where
   at least two functions share theirs.
2. Tokens in such a range that only one text has there can't match anything and
   are masked; subsequences with too few others are dead. Both are exact.
3. Live subsequences are grouped by pairs of functions: an interval join of two
   functions' windows gives runs of starts that share both minima, whose hash is
   the key. Runs with the same masked tokens (one context) repeat each other and
   are linked with the first of them. Different contexts of a key meet in all
   pairs; those of keys with more than ALL_PAIRS are first masked again within
   the key, and then meet by token in cells of chunk pairs, so that no group is
   held in memory.
4. Pairs of different contexts are verified, window against window: of a
   passage's window, at least the tokens that make a Jaccard similarity of
   ``similarity`` (sets of T tokens each) stand in one T-token window of the
   other text, and the same holds the other way round.

A pair of T-token windows with similarity s is a candidate if two of FUNCTIONS
minima agree: with chance 0.993 at s = 0.8 and five functions.

Texts go by a 64-bit hash, so equal texts are one; their copies repeat the whole
text. The result has one row for each document with a repeated passage: its class
(smallest doc_id over verified links) and its passages as word ranges. Words are
runs between ASCII white space, A-Z lower-cased, with marks deleted; words of
marks only are no words and aren't counted by the ranges.

Edge cases: null and short texts have no passage; a passage that repeats only
within one document isn't reported; rows with a null doc_id take part in the
search, but have no row of their own; of a repeated doc_id with several texts
each text is searched on its own, the document has the passages of all and the
smallest of their classes, and doesn't join these; a text that only one document
has in repeated rows is no repeat; extra columns are ignored; empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import by_cell, cells, connected_components, drop_materialized, materialize, packed, runs, settle, table, whole

MIN_WORDS, SHINGLE, SIMILARITY = 50, 5, 0.8
#: Windows at similarity 0.8 share a minimum with chance 0.8, and two of five with 0.993.
FUNCTIONS = 5
#: Groups of up to so many contexts are linked in all pairs; the pairs of larger ones are compared first.
ALL_PAIRS = 16
#: Contexts of a larger group that one task takes; further ones are cut into pairs of chunks.
CELL_ROWS = 256
#: Regions of one document that a row brings to its text.
REGIONS_A_ROW = 256
#: Bytes of text that are hashed at once.
SLAB = 1 << 18
#: Numbers of a bucket's rows go together (2^13 buckets: 7 MB of windows each for 30 GB of text); rows that a task deals at once.
BUCKET_BITS, DEALT_ROWS = 13, 1 << 18
SEEDS = np.random.default_rng(20_230_801).integers(1, 2**63, FUNCTIONS, dtype=np.uint64)
_DROP = b".,;:!?\"'()[]|"
_WHITE = b"\t\n\x0b\x0c\r "
#: A word from its first letter on, for patterns: marks alone make none.
_WORD = r"""[^\x20\x09-\x0D.,;:!?"'()\[\]|][^\x20\x09-\x0D]*+"""
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))
_NO = np.uint64(0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, as the ranges count them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _DROP).split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return np.cumprod(np.concatenate((one, np.full(n, _M))), dtype=np.uint64), np.cumprod(np.concatenate((one, np.full(n, _M_INVERSE))), dtype=np.uint64)


class RangeHash:
    """Hashes of ranges of a sequence, wherever they stand; grows its tables of powers as needed."""

    def __init__(self):
        self.up, self.down = _powers(SLAB)

    def __call__(self, x: np.ndarray, lo: np.ndarray, stop: np.ndarray) -> np.ndarray:
        n = len(x)
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * self.down[:n], dtype=np.uint64)))
        return _mix((total[stop] - total[lo]) * self.up[lo] + (stop - lo).astype(np.uint64))


class Tokens:
    """Token hashes of many texts at once."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.hashed = shingle, RangeHash()
        lower = np.arange(256)
        lower[ord("A") : ord("Z") + 1] += 32
        self.value = (np.random.default_rng(20_230_802).integers(1, 2**63, 256, dtype=np.uint64))[lower]
        self.letter, self.white = np.ones(256, bool), np.zeros(256, bool)
        self.white[list(_WHITE)] = True
        self.letter[list(_WHITE + _DROP)] = False

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first letter's place of each word."""
        at = np.flatnonzero(self.letter[data])
        if not len(at):
            return np.zeros(0, np.uint64), at
        gaps = np.cumsum(self.white[data], dtype=np.int64)[at]
        first = np.concatenate(([0], np.flatnonzero(gaps[1:] != gaps[:-1]) + 1))
        stop = np.concatenate((first[1:], [len(at)]))
        return self.hashed(self.value[data[at]], first, stop), at[first]

    def _cut(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Parts of about SLAB bytes that end before white space, with their places."""
        a = 0
        while a < len(data):
            z = min(a + SLAB, len(data))
            while z < len(data) and not self.white[data[z]]:
                z += 1
            yield data[a:z], a
            a = z

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after another, and how many each has."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        got = [(h, at + a) for part, a in self._cut(data) for h, at in (self.words(part),)]
        h = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.uint64)
        owner = np.searchsorted(ends, np.concatenate([x for _, x in got]), "right") if got else np.zeros(0, np.int64)
        n = len(h) - self.shingle + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        out = np.zeros(n, np.uint64)
        for j in range(self.shingle):
            out = out * _M + h[j : j + n]
        whole = owner[:n] == owner[self.shingle - 1 :]
        return _mix(out)[whole] | np.uint64(1), np.bincount(owner[:n][whole], minlength=len(texts))


def slabs(texts: list[bytes]) -> Iterator[list[int]]:
    """Indices of texts in parts of about SLAB bytes."""
    part, held = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        held += len(t)
        if held >= SLAB:
            yield part
            part, held = [], 0
    if part:
        yield part


def _slide(x: np.ndarray, t: int, op) -> np.ndarray:
    """op over every t adjacent values, by doubling."""
    width, now = 1, x
    while 2 * width <= t:
        now = op(now[:-width], now[width:])
        width *= 2
    n = len(x) - t + 1
    return now if width == t else op(now[:n], now[t - width : t - width + n])


def tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Cartesian tree's bounds of each value: the nearest one before it that isn't larger, and behind it that is smaller.

    Bounds jump to their bounds until all are in place, which takes about log(n) rounds.
    """
    n = len(v)
    padded = np.append(v, _NO)  # at n, and at -1 from the left
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    for at, larger in ((before, np.greater), (after, np.greater_equal)):
        todo = np.arange(n)
        while len(todo):
            todo = todo[larger(padded[at[todo]], v[todo])]
            at[todo] = at[at[todo]]
    return before, after


def compact_windows(h: np.ndarray, t: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the compact windows of at least t tokens, by c; of equal hashes the first is the smaller.

    With ``live``, only the tokens that are the minimum of t tokens from a live start on are in the tree.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < t:
        return none, none, none
    low = _slide(h, t, np.minimum)
    if live is not None:
        low = np.where(live, low, _NO)
    # a token can be a minimum only where some window of t tokens around it has it as its minimum
    edge = np.zeros(t - 1, h.dtype)
    reach = _slide(np.concatenate((edge, low, edge)), t, np.maximum)
    c = np.flatnonzero(reach == h)
    before, after = tree(h[c])
    edges = np.concatenate(([-1], c, [n]))
    l, r = edges[before + 1] + 1, edges[after + 1] - 1
    ok = r - l + 1 >= t
    return l[ok], c[ok], r[ok]


def overlaps(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Interval join of two sorted lists of disjoint ranges: lo, hi and the two indices of each overlap."""
    first, stop = np.searchsorted(b_hi, a_lo, "left"), np.searchsorted(b_lo, a_hi, "right")
    n = np.maximum(stop - first, 0)
    i = np.repeat(np.arange(len(a_lo)), n)
    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.maximum(a_lo[i], b_lo[j]), np.minimum(a_hi[i], b_hi[j]), i, j


def true_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], x, [False])).astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def inside(lens: np.ndarray, t: int) -> np.ndarray:
    """Of sequences one after another: whether t values from a place on belong to one of them."""
    n = int(lens.sum())
    ok = np.ones(max(n - t + 1, 0), bool)
    for e in np.cumsum(lens)[:-1].tolist():
        ok[max(0, e - t + 1) : e] = False
    return ok


def start_runs(tok: np.ndarray, live: np.ndarray, t: int, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last of the live starts, and place of the minimum, of each window of function f."""
    h = _mix(tok ^ SEEDS[f]) | np.uint64(1)
    l, c, r = compact_windows(h, t, live)
    lo, hi, i, _ = overlaps(np.maximum(l, c - t + 1), np.minimum(c, r - t + 1), *true_runs(live))
    return lo, hi, c[i]


_AT = 29  # bits of a place in a text
_SPAN = (1 << _AT) - 1
_KNOWN = np.int64(1) << np.int64(62)
_COUNT = np.int64(FUNCTIONS)  # in the place of a function: the row holds a text's number of words


def _dealt(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Rows of whole numbers as (bucket, rows): a row of Spark holds those of many parts whose first column falls in one bucket.

    So many rows are dealt and sorted as a few arrays, not one by one.
    """
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        rows = np.stack([np.concatenate(c) for c in zip(*held)], axis=1)
        bucket = (_mix(rows[:, 0].astype(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(_changes(bucket))
        ends = (np.append(first, len(rows)) * rows.shape[1] * 8).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows[order]))])
        return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), values], names=["bucket", "rows"])

    for part in parts:
        held.append(tuple(c.astype(np.int64, copy=False) for c in part))
        if sum(len(h[0]) for h in held) >= DEALT_ROWS:
            yield out()
            held = []
    if held and sum(len(h[0]) for h in held):
        yield out()


def _gathered(batches, n_cols: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of the rows of whole buckets."""
    for part in whole(batches, ["bucket"]):
        made = []
        for chunk in part.column("rows").chunks:
            _, ends, data = chunk.buffers()
            at = np.frombuffer(ends, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            made.append(np.frombuffer(data, np.int64, (int(at[-1]) - int(at[0])) // 8, int(at[0])))
        yield tuple(np.concatenate(made).reshape(-1, n_cols).T.copy())


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _windows(t: int):
    """Dealt rows of (route, id, span): each text's windows of each function, routed by function and minimum.

    span holds the function, the first and the last start. Of a minimum that two
    texts of a batch have, one row goes on by it, and the others, which are
    known to be shared, go by their text, so that no minimum is hot. A further row
    brings a text's number of words, if it has t tokens.
    """

    def made_of(batches):
        made = Tokens()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ids, first = np.unique(ids, return_index=True)
            texts = [batch.column(1)[int(i)].as_py().encode("utf-8", "surrogatepass") for i in first]
            keys, owners, spans, counts = [], [], [], np.zeros(len(texts), np.int64)
            for part in slabs(texts):
                tok, lens = made.of([texts[i] for i in part])
                counts[part] = lens
                if len(tok) < t:
                    continue
                live = inside(lens, t)
                starts, ends, own = np.cumsum(lens) - lens, np.cumsum(lens), np.array(part)
                for f in range(FUNCTIONS):
                    lo, hi, c = start_runs(tok, live, t, f)
                    k = np.searchsorted(ends, lo, "right")
                    keys.append(_mix(tok[c] ^ SEEDS[f]))
                    owners.append(own[k])
                    spans.append((np.int64(f) << (2 * _AT)) | ((lo - starts[k]) << _AT) | (hi - starts[k]))
            long = np.flatnonzero(counts >= t)
            if not len(long):
                continue
            own = ids[long]
            yield own, own, _KNOWN | (_COUNT << (2 * _AT)) | (counts[long] + SHINGLE - 1)
            key, owner, span = np.concatenate(keys), np.concatenate(owners), np.concatenate(spans)
            order = np.argsort(key, kind="stable")
            key, owner, span = key[order], owner[order], span[order]
            group = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(group, len(key)))
            known = np.repeat(np.minimum.reduceat(owner, group) != np.maximum.reduceat(owner, group), size)
            on = known.copy()
            on[group] = False
            own = ids[owner]
            route = np.where(on, own, key.view(np.int64))
            span = np.where(known, span | _KNOWN, span)
            yield route, own, span

    return lambda batches: _dealt(made_of(batches))


def _shared(batches):
    """Of rows by route: dealt rows of (id, span) of those whose route has two texts or a known row."""

    def kept():
        for route, own, span in _gathered(batches, 3):
            order = np.argsort(route)
            route, own, span = route[order], own[order], span[order]
            group = np.flatnonzero(_changes(route))
            good = (np.maximum.reduceat(span, group) >= _KNOWN) | (np.minimum.reduceat(own, group) != np.maximum.reduceat(own, group))
            keep = np.repeat(good, np.diff(np.append(group, len(route))))
            if keep.any():
                yield own[keep], span[keep] & ~_KNOWN

    return _dealt(kept())


def _whole_runs(batches, n_cols: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches, as arrays, that end where the first column changes; memory is bounded by a batch and the longest run."""
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = tuple(batch.column(k).to_numpy() for k in range(n_cols))
        change = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield tuple(np.concatenate(p) for p in zip(*held, tuple(c[:cut] for c in cols)))
            held = [tuple(c[cut:] for c in cols)]
        elif held and cols[0][0] != held[-1][0][-1]:
            yield tuple(np.concatenate(p) for p in zip(*held))
            held = [cols]
        else:
            held.append(cols)
    if held:
        yield tuple(np.concatenate(p) for p in zip(*held))


def _ranges(t: int):
    """Of each text's shared windows: its number of words, and the token ranges of starts that two functions share, as arrays."""

    def run(batches):
        for own, span in _gathered(batches, 2):
            order = np.lexsort((span, own))
            own, span = own[order], span[order]
            new = np.concatenate(([True], (own[1:] != own[:-1]) | (span[1:] != span[:-1])))
            own, span = own[new], span[new]
            count = span >> (2 * _AT) == _COUNT
            texts, n_words = own[count], span[count] & _SPAN
            own, span = own[~count], span[~count]
            none = pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int32()))
            ids, *lists = ranges(own, span) if len(own) else (own, none, none)
            at = np.full(len(texts), -1)
            at[np.searchsorted(texts, ids)] = np.arange(len(ids))  # every text has its number of words
            at = pa.array(at, mask=at < 0)
            yield pa.RecordBatch.from_arrays([pa.array(texts), *(x.take(at) for x in lists), pa.array(n_words)], names=["id", "starts", "stops", "n_words"])

    def ranges(own, span):
        text = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
        base = text.astype(np.int64) << (_AT + 1)
        # a function's windows are disjoint, so the number of open ones is that of functions
        at = np.concatenate((base + ((span >> _AT) & _SPAN), base + (span & _SPAN) + 1))
        step = np.repeat(np.array([1, -1]), len(own))
        at, where = np.unique(at, return_inverse=True)
        depth = np.cumsum(np.bincount(where, step, len(at)).astype(np.int64))
        lo, hi = true_runs(depth[:-1] >= 2)
        a, z = at[lo], at[hi + 1] + t - 1
        first = np.ones(len(a), bool)
        first[1:] = a[1:] > z[:-1]
        a, z = a[first], z[np.append(first[1:], True)[: len(z)]]
        of, low = a >> (_AT + 1), a & ((1 << (_AT + 1)) - 1)
        cut = np.flatnonzero(_changes(of))
        ends = pa.array(np.append(cut, len(of)).astype(np.int32))
        ids = own[np.concatenate(([True], own[1:] != own[:-1]))]
        lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))) for c in (low, low + z - a)]
        return ids[of[cut]], *lists

    return run


def _list_of(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def _tokens(batches):
    """The token hashes of each text's ranges, one range after another."""
    made = Tokens()
    for batch in batches:
        texts = [batch.column(3)[i].as_py().encode("utf-8", "surrogatepass") for i in range(batch.num_rows)]
        starts, stops = batch.column(1), batch.column(2)
        for part in slabs(texts):
            tok, lens = made.of([texts[i] for i in part])
            ends = np.cumsum(lens)
            rows = []
            for k, i in enumerate(part):
                own = tok[ends[k] - lens[k] : ends[k]].view(np.int64)
                rows.append(np.concatenate([own[a:z] for a, z in zip(starts[i].as_py(), stops[i].as_py())]))
            at = pa.array(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), starts.take(at), stops.take(at), _list_of(rows, pa.int64())], names=["id", "starts", "stops", "tok"])


def needed(t: int, similarity: float) -> int:
    """Common tokens of two windows of t different tokens with that Jaccard similarity."""
    return int(np.ceil(2 * similarity / (1 + similarity) * t - 1e-9))


def _joined(own: np.ndarray, other: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts by own and other, those that overlap or follow each other as one."""
    if not len(own):
        return own, other, lo, hi
    order = np.lexsort((lo, other, own))
    own, other, lo, hi = (c[order] for c in (own, other, lo, hi))
    part = np.cumsum(_changes(own, other)).astype(np.int64) << 32
    ends = np.maximum.accumulate(part + hi)
    first = np.flatnonzero(np.concatenate(([True], part[1:] + lo[1:] > ends[:-1] + 1)))
    return own[first], other[first], lo[first], ends[np.append(first[1:], len(own)) - 1] & 0xFFFFFFFF


def _contexts(t: int, need: int):
    """Dealt rows of (route, fp, id, place, first), place with both ends of a run: the live runs of each text by pair of functions.

    Own tokens (column own) are masked. Of a batch's equal contexts the first of
    two texts go on by their key; the others are linked with the first and go by
    their text, merged where they overlap or follow each other.
    """

    def made_of(batches):
        hashed = RangeHash()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_numpy()
            starts, stops, toks, own = (batch.column(k) for k in range(1, 5))
            tok = toks.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            if len(tok) < t:
                continue
            low, high = starts.flatten().to_numpy(), stops.flatten().to_numpy()
            lens = (high - low).astype(np.int64)
            piece = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(n), np.asarray(starts.value_lengths()))
            public = ~np.isin(tok, own.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            run_ = np.concatenate(([0], np.cumsum(public)))
            live = inside(lens, t) & (run_[t:] - run_[:-t] >= need)
            masked = np.where(public, tok, _NO)
            made = []
            for f in range(FUNCTIONS):
                lo, hi, c = start_runs(tok, live, t, f)
                ok = public[c]  # no other text has a private minimum
                made.append((lo[ok], hi[ok], _mix(tok[c[ok]] ^ SEEDS[f])))
            cols = []
            for f in range(FUNCTIONS):
                for g in range(f + 1, FUNCTIONS):
                    lo, hi, i, j = overlaps(made[f][0], made[f][1], made[g][0], made[g][1])
                    cols.append((_mix(made[f][2][i] + np.uint64(g)) ^ made[g][2][j], lo, hi))
            key, lo, hi = (np.concatenate(c) for c in zip(*cols))
            if not len(key):
                continue
            fp = hashed(masked, lo, hi + t)
            at = np.searchsorted(piece, lo, "right") - 1
            shift = (low[at] - piece[at]).astype(np.int64)
            text = owner[at]
            order = np.lexsort((text, fp, key))
            key, fp, text, lo, hi = key[order], fp[order], text[order], (lo + shift)[order], (hi + shift)[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])))
            group = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            fresh = np.concatenate(([True], new[1:] | (text[1:] != text[:-1])))
            # number of texts of the context up to a row: rows of the first two go on
            seen = np.cumsum(fresh)
            seen = seen - seen[group][which] + 1
            on = seen <= 2
            # the others: their runs, merged by text and first text
            mine, at_lead, low_, high_ = (c[~on] for c in (text, text[group][which], lo, hi))
            mine, at_lead, low_, high_ = _joined(mine, at_lead, low_, high_)
            own_id, more = ids[text[on]], ids[mine]
            place = (lo[on].astype(np.int64) << 31) | hi[on]
            yield key.view(np.int64)[on], fp.view(np.int64)[on], own_id, place, own_id
            yield more, np.zeros(len(more), np.int64), more, _DIRECT | (low_.astype(np.int64) << 31) | high_, ids[at_lead]

    return lambda batches: _dealt(made_of(batches))


_DIRECT = np.int64(1) << np.int64(62)  # the run is linked with the text first already
_DEALT = "bucket int, rows binary"
#: kind: a matched run of text a (0), two texts with one context (1), runs to compare (2), a context of a large group (3), a text with equal contexts (4), runs to compare first (5)
_LINKS = "kind int, key long, fp long, a long, b long, a_lo int, a_hi int, b_lo int, b_hi int"


def _emit(kind: int, a, b=None, key=None, fp=None, a_lo=None, a_hi=None, b_lo=None, b_hi=None) -> pa.RecordBatch:
    """Rows of _LINKS of one kind; of runs to compare, the smaller text is a."""
    n = len(a)
    none = lambda kind_: pa.nulls(n, kind_)
    if kind in (2, 5):
        swap = a > b
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        a_lo, b_lo = np.where(swap, b_lo, a_lo), np.where(swap, a_lo, b_lo)
        a_hi, b_hi = np.where(swap, b_hi, a_hi), np.where(swap, a_hi, b_hi)
    cols = [pa.array(np.full(n, kind, np.int32)), none(pa.int64()) if key is None else pa.array(key), none(pa.int64()) if fp is None else pa.array(fp), pa.array(a)]
    cols.append(none(pa.int64()) if b is None else b if isinstance(b, pa.Array) else pa.array(b))
    cols += [none(pa.int32()) if c is None else pa.array(c.astype(np.int32)) for c in (a_lo, a_hi, b_lo, b_hi)]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "key", "fp", "a", "b", "a_lo", "a_hi", "b_lo", "b_hi"])


def _changes(*cols: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _link_keys(key, fp, x, x_lo, x_hi, y, y_lo, y_hi) -> Iterator[pa.RecordBatch]:
    """Links between the contexts of whole keys: a run of the first text of each (x) and of its second one (y, or -1 and none)."""
    first = np.flatnonzero(_changes(key))
    size = np.diff(np.append(first, len(key)))
    small = np.repeat(size <= ALL_PAIRS, size)
    for d in range(1, ALL_PAIRS):
        i = np.flatnonzero((key[:-d] == key[d:]) & small[d:])
        if not len(i):
            break
        j = i + d
        # one text's contexts meet by the second texts
        other = x[i] != x[j]
        later = ~other & (y_lo[j] >= 0)
        early = ~other & ~later & (y_lo[i] >= 0)
        pick = lambda at, second, one, two: np.where(second, two[at], one[at])
        a, a_lo, a_hi = (pick(i, early, *c) for c in ((x, y), (x_lo, y_lo), (x_hi, y_hi)))
        b, b_lo, b_hi = (pick(j, later, *c) for c in ((x, y), (x_lo, y_lo), (x_hi, y_hi)))
        ok = other | later | early
        yield _emit(2, a[ok], b[ok], a_lo=a_lo[ok], a_hi=a_hi[ok], b_lo=b_lo[ok], b_hi=b_hi[ok])
    big = ~small
    if big.any():
        # one context of each large key, of two texts if there is one, meets all others at once
        hub = first.copy()
        two = np.flatnonzero(y_lo >= 0)[::-1]
        where = np.searchsorted(first, two, "right") - 1
        hub[where] = two
        i = np.repeat(hub, size)
        j = np.flatnonzero(big)
        i = i[j]
        other = x[i] != x[j]
        later = ~other & (y_lo[j] >= 0)
        ok = (other | later) & (i != j)
        i, j, later = i[ok], j[ok], later[ok]
        yield _emit(5, x[i], np.where(later, y[j], x[j]), a_lo=x_lo[i], a_hi=x_hi[i], b_lo=np.where(later, y_lo[j], x_lo[j]), b_hi=np.where(later, y_hi[j], x_hi[j]))
        yield _emit(3, x[big], pa.array(y[big], mask=y_lo[big] < 0), key[big], fp[big], x_lo[big], x_hi[big], y_lo[big], y_hi[big])


class _Pool:
    """Spans and edges on their way out: those of many batches are merged before they go."""

    def __init__(self, rows: int = 1 << 18):
        self.rows, self.spans, self.edges = rows, [], []

    def add(self, spans: tuple, edges: tuple) -> Iterator[pa.RecordBatch]:
        self.spans.append(spans)
        self.edges.append(edges)
        if sum(len(c[0]) for c in self.spans) + sum(len(c[0]) for c in self.edges) > self.rows:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        own, lo, hi = (np.concatenate(c) for c in zip(*self.spans)) if self.spans else (np.zeros(0, np.int64),) * 3
        a, b = (np.concatenate(c) for c in zip(*self.edges)) if self.edges else (np.zeros(0, np.int64),) * 2
        self.spans, self.edges = [], []
        if len(own):
            order = np.lexsort((lo, own))
            own, lo, hi = own[order], lo[order], hi[order]
            part = np.cumsum(_changes(own)).astype(np.int64) << 32
            ends = np.maximum.accumulate(part + hi)
            # runs of starts that overlap or follow each other
            first = np.flatnonzero(np.concatenate(([True], part[1:] + lo[1:] > ends[:-1] + 1)))
            yield _emit(0, own[first], a_lo=lo[first], a_hi=ends[np.append(first[1:], len(own)) - 1] & 0xFFFFFFFF)
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = _changes(a, b)
            yield _emit(1, a[new], b[new])


def _link_groups(batches):
    """Links of each key's rows.

    Memory: the rows of a bucket, the runs of a context's first text while it is the only one,
    and two runs of each context of a key.
    """
    pool = _Pool()
    held: tuple | None = None  # rows of the last context; the last column tells which are out already
    reps: tuple | None = None  # contexts of the last key

    def contexts(cols: tuple, end: bool):
        """Emits rows of contexts; what goes on: rows of the last one, and the contexts that ended."""
        key, fp, own, lo, hi, done = cols
        new = _changes(key, fp)
        group = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        first = own[group][which]
        fresh = _changes(key, fp, own)
        several = np.maximum.reduceat(own != first, group)
        out = several[which] & ~done
        link = fresh & (own != first) & ~done
        made = [*pool.add((own[out], lo[out], hi[out]), (own[link], first[link]))]
        # the first run of a context's second text
        second = np.full(len(group), -1)
        at = np.flatnonzero(fresh & (own != first))[::-1]
        second[which[at]] = at
        n = len(group) if end else len(group) - 1
        size = np.diff(np.append(group, len(key)))
        again = np.flatnonzero(~several[:n] & (size[:n] > 1))
        made.append(_emit(4, own[group[again]]))
        has = second[:n] >= 0
        at, two = group[:n], np.maximum(second[:n], 0)
        ended = (key[at], fp[at], own[at], lo[at], hi[at], np.where(has, own[two], -1), np.where(has, lo[two], -1), np.where(has, hi[two], -1))
        rest = None
        if not end:
            last = group[-1]
            if several[-1]:
                keep = np.array([last, second[-1]])
                rest = (key[keep], fp[keep], own[keep], lo[keep], hi[keep], np.ones(2, bool))
            else:
                rest = tuple(c[last:] for c in cols)
        return [m for m in made if m.num_rows], ended, rest

    def grouped(ended: tuple, end: bool):
        nonlocal reps
        if reps is not None:
            ended = tuple(np.concatenate(p) for p in zip(reps, ended))
        key, n = ended[0], len(ended[0])
        cut = n if end or not n else int(np.flatnonzero(_changes(key))[-1])
        reps = None if end or not n else tuple(c[cut:] for c in ended)
        if cut:
            yield from _link_keys(*(c[:cut] for c in ended))

    for route, context, text, place, lead in _gathered(batches, 5):
        order = np.lexsort((text, context, route))
        route, context, text, place, lead = (c[order] for c in (route, context, text, place, lead))
        direct = place >= _DIRECT
        cols = [route, context, text, (place & ~_DIRECT) >> 31, place & ((1 << 31) - 1)]
        if direct.any():
            own, lo, hi = (c[direct] for c in cols[2:])
            lead = lead[direct]
            other = own != lead
            yield from pool.add((own, lo, hi), (own[other], lead[other]))
        rows = (*(c[~direct] for c in cols), np.zeros(int((~direct).sum()), bool))
        if not len(rows[0]):
            continue
        if held is not None:
            rows = tuple(np.concatenate(p) for p in zip(held, rows))
        made, ended, held = contexts(rows, False)
        yield from made
        yield from grouped(ended, False)
    if held is not None:
        made, ended, _ = contexts(held, True)
        yield from made
        yield from grouped(ended, True)
    yield from pool.out()


def _cut(row, p0: int, p1: int) -> np.ndarray:
    """Tokens p0..p1-1 of a text's row (starts, stops, tok); 0 where it has none."""
    starts, stops, tok = row
    out = np.zeros(p1 - p0, np.int64)
    at = 0
    for a, z in zip(starts, stops):
        lo, hi = max(a, p0), min(z, p1)
        if lo < hi:
            out[lo - p0 : hi - p0] = tok[at + lo - a : at + hi - a]
        at += z - a
    return out


def _gather(tok: np.ndarray, piece: tuple, owner: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the token ranges p0..p1-1 of texts (owner); 0 where a text has none. piece: text, start, stop, place in tok."""
    text, start, stop, place = piece
    n = (p1 - p0).astype(np.int64)
    at = np.repeat((owner.astype(np.int64) << 32) + p0 - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    k = np.searchsorted((text << 32) + start, at, "right") - 1
    ok = (k >= 0) & (at < ((text << 32) + stop)[k])
    return np.where(ok, tok[np.where(ok, place[k] + at - ((text << 32) + start)[k], 0)], 0), n


def _pieces(starts: pa.ListArray, stops: pa.ListArray) -> tuple:
    text = np.repeat(np.arange(len(starts), dtype=np.int64), np.asarray(starts.value_lengths()))
    a, z = starts.flatten().to_numpy().astype(np.int64), stops.flatten().to_numpy().astype(np.int64)
    return text, a, z, np.cumsum(z - a) - (z - a)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values))


def _slices(batches):
    """The token hashes of the regions that a row brings to its text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        piece, tok = _pieces(batch.column(0), batch.column(1)), batch.column(2).flatten().to_numpy(zero_copy_only=False)
        parts = batch.column(3)
        owner = np.repeat(np.arange(batch.num_rows), np.asarray(parts.value_lengths()))
        rid, side, p0, p1 = (parts.flatten().field(k).to_numpy() for k in ("rid", "side", "p0", "p1"))
        share = np.cumsum(p1.astype(np.int64) - p0) >> 20  # portions of a million tokens
        for k in np.unique(share).tolist():
            mine = share == k
            values, n = _gather(tok, piece, owner[mine], p0[mine], p1[mine])
            yield pa.RecordBatch.from_arrays([pa.array(rid[mine]), pa.array(side[mine]), pa.array(p0[mine]), _lists(values, n)], names=["rid", "side", "start", "tok"])


_NARROW = "key long, fp2 long, id long, start int, settled long, tok array<long>"


def _narrow(t: int, need: int):
    """Contexts of large groups without the tokens (own) that no other context of the group has: their live parts, for both texts."""

    def run(batches):
        hashed = RangeHash()
        for batch in batches:
            key, a, a_lo, b_lo = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
            b = batch.column(2)
            lens = np.asarray(batch.column(5).value_lengths()).astype(np.int64)
            tok = batch.column(5).flatten().to_numpy(zero_copy_only=False)
            if len(tok) < t:
                continue
            own = batch.column(6)
            # tokens of different rows are told apart by the row
            row = lambda n: _mix(np.repeat(np.arange(batch.num_rows, dtype=np.uint64), n))
            n_own = np.nan_to_num(np.asarray(own.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            private = np.isin(tok.view(np.uint64) ^ row(lens), own.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ row(n_own))
            tok = np.where(private, 0, tok)
            count = np.concatenate(([0], np.cumsum(tok != 0)))
            lo, hi = true_runs(inside(lens, t) & (count[t:] - count[:-t] >= need))
            if not len(lo):
                continue
            mark = hashed(tok.view(np.uint64), lo, hi + t).view(np.int64)
            begin = np.cumsum(lens) - lens
            of = np.searchsorted(begin, lo, "right") - 1
            # rows without tokens begin where their successor does
            n = hi + t - lo
            values = tok[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            for ids, low, ok in ((a, a_lo, np.ones(len(of), bool)), (b.fill_null(0).to_numpy(), b_lo, np.asarray(b.is_valid())[of])):
                at = of[ok]
                kept = values[np.repeat(ok, n)]
                cols = [pa.array(key[at]), pa.array(mark[ok]), pa.array(ids[at]), pa.array((low[at] + lo[ok] - begin[at]).astype(np.int32)), batch.column(7).take(pa.array(at)), _lists(kept, n[ok])]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "fp2", "id", "start", "settled", "tok"])

    return run


def _compare(t: int, need: int):
    """Links within cells of a large group's contexts: enough for all matched windows and all connections.

    Every pair of the cell is compared, but for two contexts that are matched and of
    one component already (column settled). Of the pairs that match, a context keeps
    those that add to its matched windows and those that join two components.
    """

    def linked(batches):
        for cell in runs(batches, ["key", "ci", "cj"]):
            ids, start, chunk = (cell.column(c).to_numpy() for c in ("id", "start", "chunk"))
            toks = [np.asarray(v.values) for v in cell.column("tok")]
            ends = np.cumsum([len(x) for x in toks])
            values, at = np.unique(np.concatenate(toks), return_inverse=True)
            masked = int(np.searchsorted(values, 0)) if 0 in values else -1
            at = np.split(at, ends[:-1])
            n = len(ids)
            holds = np.zeros((n, len(values)), bool)
            for k, x in enumerate(at):
                holds[k, x] = True
            if masked >= 0:
                holds[:, masked] = False
            one = cell.column("ci")[0].as_py() == cell.column("cj")[0].as_py()
            length = np.array([len(x) for x in at])
            padded = np.full((n, length.max()), len(values))
            padded[np.arange(length.max()) < length[:, None]] = np.concatenate(at)
            holds = np.column_stack((holds, np.zeros(n, bool)))
            settled = cell.column("settled").fill_null(-1).to_numpy()
            same = (settled[:, None] == settled) & (settled >= 0)
            apart = (ids[:, None] != ids) & (one | (chunk[:, None] != chunk)) & ~same
            match, windows = np.zeros((n, n), bool), []
            # how many tokens of a context the other one has at all: most pairs have too few for any window
            times = np.zeros((n, len(values) + 1), np.float32)
            np.add.at(times, (np.repeat(np.arange(n), length), np.concatenate(at)), 1)
            first, second = np.nonzero((times @ holds.T.astype(np.float32) >= need) & apart)
            step = max(1, (1 << 21) // padded.shape[1])
            for p in range(0, len(first), step):
                k, y = first[p : p + step], second[p : p + step]
                # by pair and place: whether the other one holds the token
                count = np.zeros((len(k), padded.shape[1] + 1), np.int32)
                np.cumsum(holds[y[:, None], padded[k]], axis=1, out=count[:, 1:])
                good = count[:, t:] - count[:, :-t] >= need
                some = good.any(axis=1)
                match[k[some], y[some]] = True
                for c in np.unique(k[some]).tolist():
                    mine = np.flatnonzero(some & (k == c))
                    windows.append((c, y[mine], good[mine, : length[c] - t + 1]))
            match &= match.T
            chosen = set()
            root = list(range(n))

            def find(v):
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for k, others, good in windows:
                both = match[k, others]
                others, good = others[both], good[both].copy()
                for y in others.tolist():
                    if (u := find(k)) != (v := find(y)):
                        root[u] = v
                        chosen.add((min(k, y), max(k, y)))
                while good.any():
                    best = int(good.sum(axis=1).argmax())
                    y = int(others[best])
                    chosen.add((min(k, y), max(k, y)))
                    good &= ~good[best].copy()
            if chosen:
                x, y = np.array(sorted(chosen)).T
                swap = ids[x] > ids[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                side = lambda v: (start[v].astype(np.int32), (start[v] + length[v] - t).astype(np.int32))
                yield ids[x], ids[y], *side(x), *side(y)

    return lambda batches: packed(linked(batches), ["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"])


def _regions(t: int):
    """Of the links of two texts a < b: token ranges on both sides, merged where links overlap on either."""

    def merged(batches):
        for a, b, a_lo, a_hi, b_lo, b_hi, soon in _whole_runs(batches, 7):
            order = np.lexsort((a_lo, b, a))
            a, b, a_lo, a_hi, b_lo, b_hi, soon = (c[order] for c in (a, b, a_lo, a_hi + t, b_lo, b_hi + t, soon))
            # runs that overlap in a, and within these runs that overlap in b
            part = np.cumsum(_changes(a, b)).astype(np.int64) << 32
            for side_lo, side_hi in ((a_lo, a_hi), (b_lo, b_hi)):
                order = np.lexsort((side_lo, part))
                a, b, a_lo, a_hi, b_lo, b_hi, soon, part = (c[order] for c in (a, b, a_lo, a_hi, b_lo, b_hi, soon, part))
                side_lo, side_hi = side_lo[order], side_hi[order]
                ends = np.maximum.accumulate(part + side_hi)
                new = np.concatenate(([True], part[1:] + side_lo[1:] > ends[:-1]))
                part = np.cumsum(new).astype(np.int64) << 32
            first = np.flatnonzero(new)
            yield a[first], b[first], np.minimum.reduceat(a_lo, first), np.maximum.reduceat(a_hi, first), np.minimum.reduceat(b_lo, first), np.maximum.reduceat(b_hi, first), np.maximum.reduceat(soon, first)

    return lambda batches: packed(merged(batches), ["a", "b", "a0", "a1", "b0", "b1", "soon"])


def _most_in_a_window(x: list[int], places: dict[int, list[int]], t: int) -> int:
    """Most values of x that stand in one window of t values of the other side."""
    at, step = [], []
    for v in x:
        stop = None
        for p in places.get(v, ()):  # the windows that hold some place of v: one range, or several
            if stop is None or p - t + 1 > stop:
                if stop is not None:
                    at.append(stop + 1)
                    step.append(-1)
                at.append(p - t + 1)
                step.append(1)
            stop = p
        if stop is not None:
            at.append(stop + 1)
            step.append(-1)
    if not at:
        return 0
    order = np.lexsort((step, at))  # at one place, ranges end before others begin
    return int(np.cumsum(np.array(step)[order]).max())


def matching(x: np.ndarray, y: np.ndarray, t: int, need: int, x_lens: np.ndarray | None = None) -> np.ndarray:
    """Of every t-token window of x: whether at least need of its tokens stand in one t-token window of y; 0 is no token.

    x may hold several sequences of lengths x_lens, and y their counterparts, if
    no token is in two pairs of them.
    """
    good = np.zeros(max(len(x) - t + 1, 0), bool)
    if min(len(x), len(y)) < t:
        return good
    order, x_order = np.argsort(y), np.argsort(x)
    sorted_, x_sorted = y[order], x[x_order]
    lo, hi = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    lo[x_order], hi[x_order] = np.searchsorted(sorted_, x_sorted, "left"), np.searchsorted(sorted_, x_sorted, "right")
    n = np.where(x == 0, 0, hi - lo)
    run = np.concatenate(([0], np.cumsum(n > 0)))
    at = np.flatnonzero((run[t:] - run[:-t] >= need) & (True if x_lens is None else inside(x_lens, t)))
    far = np.int64(1) << np.int64(40)
    place = np.where(n > 0, order[np.minimum(lo, len(y) - 1)], far)
    # all of a window's tokens have places within t of each other
    near = _slide(np.where(n > 0, place, -far), t, np.maximum) - _slide(place, t, np.minimum) < t
    good[at[near[at]]] = True
    at = at[~near[at]]
    many = np.concatenate(([0], np.cumsum(n > 1)))
    # tokens that stand once: need of their places must be within t of each other
    once = at[many[at + t] == many[at]]
    for p in range(0, len(once), 8192):
        part = once[p : p + 8192]
        q = np.sort(place[part[:, None] + np.arange(t)], axis=1)
        good[part] = (q[:, need - 1 :] - q[:, : t - need + 1] < t).any(axis=1)
    rest = at[many[at + t] != many[at]]
    if len(rest):
        hashed = RangeHash()
        window = lambda v, w: hashed(v.view(np.uint64), w, w + t)
        mine = window(x, rest)
        whole_ = run[rest + t] - run[rest] == t
        equal = whole_ & np.isin(mine, window(y, np.arange(len(y) - t + 1)))
        good[rest[equal]] = True
        rest, mine = rest[~equal], mine[~equal]
        _, first, which = np.unique(mine, return_index=True, return_inverse=True)

        def places(s: int) -> dict[int, list[int]]:
            return {int(x[k]): sorted(order[lo[k] : hi[k]].tolist()) for k in range(s, s + t) if n[k]}

        say = np.array([_most_in_a_window(x[s : s + t].tolist(), places(s), t) >= need for s in rest[first].tolist()], bool)
        if len(rest):
            good[rest] = say[which]
    return good


def _verify(t: int, need: int):
    """Of pairs of regions: the matched spans of both sides, if both have some."""

    def verified(batches):
        for rows in whole(batches, ["rid"]):
            rid, side, own, start = (rows.column(k).to_numpy() for k in ("rid", "side", "id", "start"))
            tok = rows.column("tok").combine_chunks()
            lens = np.asarray(tok.value_lengths()).astype(np.int64)
            place = np.cumsum(lens) - lens
            flat = tok.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            pair = np.cumsum(_changes(rid)) - 1
            # of a repeated row one slice counts
            i, j = np.full(pair[-1] + 1, -1), np.full(pair[-1] + 1, -1)
            for at, which in ((i, 0), (j, 1)):
                mine = np.flatnonzero(side == which)[::-1]
                at[pair[mine]] = mine
            both = (i >= 0) & (j >= 0)
            i, j = i[both], j[both]
            for k in _portions(lens[i] + lens[j]):
                mark = _mix(np.arange(len(i[k]), dtype=np.uint64) + np.uint64(1))

                def side_of(at, mark=mark):
                    """Tokens of one side, told apart by pair."""
                    n = lens[at]
                    values = flat[np.repeat(place[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                    return np.where(values == 0, _NO, values ^ np.repeat(mark, n)).view(np.int64), n

                (x, nx), (y, ny) = side_of(i[k]), side_of(j[k])
                found = []
                for u, nu, v, at in ((x, nx, y, i[k]), (y, ny, x, j[k])):
                    lo, hi = true_runs(matching(u, v, t, need, nu))
                    begin = np.cumsum(nu) - nu
                    of = np.searchsorted(np.cumsum(nu), lo, "right")
                    found.append((at[of], of, lo - begin[of], hi - begin[of] + t))
                good = np.intersect1d(found[0][1], found[1][1])
                for at, of, lo, hi in found:
                    ok = np.isin(of, good)
                    at, of = at[ok], of[ok]
                    yield own[at], own[i[k][of]], own[j[k][of]], start[at] + lo[ok], start[at] + hi[ok]

    return lambda batches: packed(verified(batches), ["id", "a", "b", "start", "stop"])


def _portions(n: np.ndarray, total: int = 1 << 15) -> Iterator[np.ndarray]:
    """Indices of items in portions of about so many tokens."""
    share = np.cumsum(n) // total
    for k in np.unique(share).tolist():
        yield np.flatnonzero(share == k)


def _merged(batches):
    """Spans sorted by text: overlapping ones together."""

    def merged():
        for own, start, stop in _whole_runs(batches, 3):
            order = np.lexsort((start, own))
            own, start, stop = own[order], start[order], stop[order]
            text = np.cumsum(np.concatenate(([0], own[1:] != own[:-1]))).astype(np.int64) << 32
            ends = np.maximum.accumulate(text + stop)
            first = np.flatnonzero(np.concatenate(([True], text[1:] + start[1:] > ends[:-1])))
            yield own[first], start[first], ends[np.append(first[1:], len(own)) - 1] & 0xFFFFFFFF

    return packed(merged(), ["id", "start", "stop"])


def _spread(t: int):
    """The further places of a text's matched windows: rows of (id, start, stop)."""

    def spread(batches):
        hashed = RangeHash()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), np.asarray(batch.column(3)[i].values)
                tok = _cut(row, 0, row[1][-1]).view(np.uint64)
                lo = np.arange(len(tok) - t + 1)
                h = hashed(tok, lo, lo + t)
                known = np.zeros(len(lo), bool)
                for p in batch.column(4)[i].as_py():
                    known[p["start"] : p["stop"] - t + 1] = True
                gaps = np.concatenate(([0], np.cumsum(tok == 0)))
                a, z = true_runs(np.isin(h, h[known]) & ~known & (gaps[t:] == gaps[:-t]))
                if len(a):
                    yield np.full(len(a), batch.column(0)[i].as_py(), np.int64), a.astype(np.int64), z.astype(np.int64) + t

    return lambda batches: packed(spread(batches), ["id", "start", "stop"])


_SPANS = "id long, start long, stop long"


def _search(rows: DataFrame, twins: DataFrame, t: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of the texts that may have repeats (id, h), their spans in tokens (id, start, stop), the links (a, b), and the words of texts of t tokens or more (h, n_words).

    rows has doc_id, h and text, twins has h and low, the doc_id whose row stands for the text.
    """
    need = needed(t, similarity)
    seen = _by_bucket(rows.select("h", "text").mapInArrow(_windows(t), _DEALT))
    shared = _by_bucket(seen.mapInArrow(_shared, _DEALT))
    shares = materialize(shared.mapInArrow(_ranges(t), "id long, starts array<int>, stops array<int>, n_words long"), "ranges")
    settle(rows.sparkSession)
    ranges = shares.filter("starts is not null")
    of = ranges.join(twins, ranges["id"] == twins["h"]).select("id", "low", "starts", "stops")
    texts = rows.join(of, rows["doc_id"].eqNullSafe(of["low"]) & (rows["h"] == of["id"])).select("id", "starts", "stops", "text")
    tok = texts.mapInArrow(_tokens, "h long, starts array<int>, stops array<int>, tok array<long>")
    tok = materialize(tok.withColumn("id", F.monotonically_increasing_id()), "tokens")
    settle(rows.sparkSession)
    alone = tok.select("id", F.explode("tok").alias("v")).groupBy("v").agg(F.min("id").alias("id"), F.max("id").alias("high")).filter("id = high")
    # each of the large shuffles ends with a table, so that no two of them are on disk at once
    alone = materialize(alone.groupBy("id").agg(F.collect_list("v").alias("own")), "alone")
    settle(rows.sparkSession)
    masked = materialize(tok.join(alone, "id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>"))), "masked")
    drop_materialized(tok)
    drop_materialized(alone)
    settle(rows.sparkSession)
    tok = masked.drop("own")
    routed = _by_bucket(masked.select("id", "starts", "stops", "tok", "own").mapInArrow(_contexts(t, need), _DEALT))
    made = materialize(routed.mapInArrow(_link_groups, _LINKS), "links")
    settle(rows.sparkSession)

    def brought(sides: DataFrame) -> DataFrame:
        """rid, side, start, tok of parts (struct of rid, side, p0, p1) of texts (id)."""
        many = sides.groupBy("id").agg(F.ceil(F.count("*") / REGIONS_A_ROW).alias("k"))
        parts = sides.join(many, "id").groupBy("id", F.pmod(F.xxhash64("part.rid"), F.col("k")).alias("s")).agg(F.collect_list("part").alias("parts"))
        return tok.join(parts, "id").select("starts", "stops", "tok", "parts").mapInArrow(_slices, "rid long, side int, start int, tok array<long>")

    spans = made.filter("kind = 0").select(F.col("a").alias("id"), F.col("a_lo").cast("long").alias("start"), (F.col("a_hi") + t).cast("long").alias("stop"))
    spans = materialize(spans.repartition("id").sortWithinPartitions("id").mapInArrow(_merged, _SPANS), "spans")
    edges = made.filter("kind = 1").select("a", "b")

    def knowledge() -> DataFrame:
        """The matched spans of each text so far, and its component; they stand for all spans and edges so far."""
        nonlocal spans, edges
        comp = connected_components(edges).withColumnRenamed("node", "id")
        once = spans.repartition("id").sortWithinPartitions("id").mapInArrow(_merged, _SPANS)
        known = once.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).join(comp, "id", "left")
        known = materialize(known.select("id", "spans", "component"), "known")
        spans = known.select("id", F.inline("spans"))
        edges = comp.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        return known

    def judged(df: DataFrame, known: DataFrame, side: str, lo: str, hi: str) -> DataFrame:
        """df with the component of a text, and whether its tokens lo..hi-1 are in a matched span."""
        mine = known.select(F.col("id").alias(f"{side}_id"), F.col("component").alias(f"{side}_comp"), F.col("spans").alias(f"{side}_spans"))
        out = df.join(mine, F.col(side) == F.col(f"{side}_id"), "left")
        full = F.coalesce(F.exists(f"{side}_spans", lambda x: (x["start"] <= F.expr(lo)) & (x["stop"] >= F.expr(hi))), F.lit(False))
        return out.withColumn(f"{side}_full", full).drop(f"{side}_id", f"{side}_spans")

    part = lambda side, lo, hi, more=0: F.struct("rid", F.lit(side).alias("side"), F.col(lo).alias("p0"), (F.col(hi) + more).alias("p1")).alias("part")
    def open_regions(regions: DataFrame, known: DataFrame) -> DataFrame:
        """Those that may add a matched span or join two components."""
        out = judged(judged(regions, known, "a", "a0", "a1"), known, "b", "b0", "b1")
        return out.filter("not (a_full and b_full and a_comp <=> b_comp)").select(*regions.columns)

    def found_in(regions: DataFrame) -> DataFrame:
        """Matched spans (id, start, stop) of pairs of regions, with the pair (a, b)."""
        sides = regions.select(F.col("a").alias("id"), part(0, "a0", "a1")).unionByName(regions.select(F.col("b").alias("id"), part(1, "b0", "b1")))
        owner = regions.select("rid", F.posexplode(F.array("a", "b")).alias("side", "id"))
        both = brought(sides).join(owner, ["rid", "side"]).select("rid", "side", "id", "start", "tok").repartition("rid").sortWithinPartitions("rid")
        return materialize(both.mapInArrow(_verify(t, need), "id long, a long, b long, start long, stop long"), "found")

    def regions_of(links: DataFrame) -> DataFrame:
        made_ = links.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_regions(t), "a long, b long, a0 int, a1 int, b0 int, b1 int, soon int")
        return materialize(made_.withColumn("rid", F.monotonically_increasing_id()), "regions")

    # first each text with its smallest partner, and the contexts of large groups with one of them
    regions = regions_of(made.filter("kind in (2, 5)").select("a", "b", "a_lo", "a_hi", "b_lo", "b_hi", (F.col("kind") == 5).cast("int").alias("soon")))
    regions = open_regions(regions, knowledge())
    regions = materialize(regions.join(regions.groupBy("b").agg(F.min("a").alias("least")), "b").withColumn("soon", (F.col("soon") == 1) | (F.col("a") == F.col("least"))), "first")
    for rest in (False, True):
        part_ = regions.filter("not soon") if rest else regions.filter("soon")
        found = found_in(materialize(open_regions(part_, knowledge()), "rest") if rest else part_)
        edges, spans = edges.unionByName(found.select("a", "b").distinct()), spans.unionByName(found.select("id", "start", "stop"))
    # a key whose contexts are all matched and of one component has nothing to add
    large = judged(made.filter("kind = 3").drop("kind"), knowledge(), "a", "a_lo", f"a_hi + {t}")
    large = materialize(large.withColumn("rid", F.monotonically_increasing_id()), "large")
    open_ = large.groupBy("key").agg(F.min("a_comp").alias("low"), F.max("a_comp").alias("high"), F.bool_and("a_full").alias("full"), F.bool_or(F.col("a_comp").isNull()).alias("none"))
    large = materialize(large.join(open_.filter("none or not full or low <> high").select("key"), "key", "left_semi"), "open")
    if not large.isEmpty():
        slices = brought(large.select(F.col("a").alias("id"), part(0, "a_lo", "a_hi", t))).select("rid", "tok")
        slices = materialize(large.join(slices, "rid").select("key", "a", "b", "a_lo", "b_lo", "tok", "rid", F.when(F.col("a_full"), F.col("a_comp")).alias("settled")), "slices")
        # tokens that one context of a group has: counts are combined before they are shuffled
        alone = slices.select("key", "rid", F.explode(F.array_distinct("tok")).alias("v")).groupBy("key", "v").agg(F.min("rid").alias("rid"), F.max("rid").alias("high"))
        alone = alone.filter("rid = high").groupBy("rid").agg(F.collect_list("v").alias("own"))
        narrow = slices.join(alone, "rid", "left").select("key", "a", "b", "a_lo", "b_lo", "tok", "own", "settled")
        narrow = materialize(narrow.mapInArrow(_narrow(t, need), _NARROW), "narrow")
        least = narrow.groupBy("key", "fp2").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        same = narrow.select("key", "fp2", "id", "start", F.size("tok").alias("n")).join(least.filter("low < high"), ["key", "fp2"])
        same = materialize(same.select("id", "low", "start", "n"), "same")
        spans = spans.unionByName(same.select("id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("stop")))
        edges = edges.unionByName(same.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
        # one row of a context for the first and one for the last of its texts
        reps = narrow.join(least, ["key", "fp2"]).filter("id = low or id = high").groupBy("key", "fp2", "id").agg(F.min(F.struct("start", "settled", "tok")).alias("one"))
        dealt = by_cell(cells(reps.select("key", "id", "one.start", "one.settled", "one.tok", F.xxhash64("fp2", "id").alias("rid")), ["key"], "rid", CELL_ROWS), ["key"])
        compared = dealt.select("key", "ci", "cj", "chunk", "id", "start", "settled", "tok").mapInArrow(_compare(t, need), "a long, b long, a_lo int, a_hi int, b_lo int, b_hi int")
        regions = materialize(open_regions(regions_of(compared.withColumn("soon", F.lit(0))), knowledge()), "compared")
        found = found_in(regions)
        edges, spans = edges.unionByName(found.select("a", "b").distinct()), spans.unionByName(found.select("id", "start", "stop"))
    # a text's equal contexts went on as one: its other places
    again = made.filter("kind = 4").select(F.col("a").alias("id")).distinct()
    again = spans.join(again, "id", "left_semi").groupBy("id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spread = tok.join(again, "id").select("id", "starts", "stops", "tok", "spans").mapInArrow(_spread(t), _SPANS)
    spans = spans.unionByName(spread).repartition("id").sortWithinPartitions("id").mapInArrow(_merged, _SPANS)
    return tok.select("id", "h"), spans, edges.distinct(), shares.select(F.col("id").alias("h"), "n_words")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_passages, passages (array of start and stop, in words) of documents with repeated passages."""
    t = min_words - SHINGLE + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # rows without an id can't be told apart: one of each text
    rows = rows.filter("doc_id is not null").unionByName(rows.filter("doc_id is null").groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", "h"))
    base = materialize(rows.select("doc_id", "h"), "texts", narrow=True)
    n = base.count()
    nameless = F.max(F.col("doc_id").isNull().cast("long"))
    twins = base.groupBy("h").agg(F.min("doc_id").alias("low"), (F.countDistinct("doc_id") + nameless).alias("n_docs"))
    texts, spans, edges, words = _search(rows, twins.select("h", "low"), t, similarity)
    comp = materialize(connected_components(edges), "classes", n)
    merged = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    merged = merged.join(comp.withColumnRenamed("node", "id"), "id").join(texts, "id").select(F.col("h").alias("t"), "component", "spans")
    # copies: every row of a text shared by documents repeats the whole text
    twins = twins.filter("n_docs > 1").join(words, "h").select("h", "n_words")  # of texts with min_words words
    of = base.filter("doc_id is not null").distinct().join(twins, "h", "left").join(merged, F.col("h") == F.col("t"), "left")
    twin = F.col("n_words").isNotNull()
    of = of.filter(twin | F.col("spans").isNotNull())
    # component ids and hashes of texts without one are kept apart
    group = F.when(F.col("component").isNull(), F.struct(F.lit(1).alias("kind"), F.col("h").alias("of"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("component").alias("of")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").cast("long").alias("stop")))
    words_of = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (s["stop"] + SHINGLE - 1).alias("stop")))
    of = materialize(of.select("doc_id", group.alias("group"), F.when(twin, whole).otherwise(words_of).alias("passages")), "members", n)
    least = of.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    out = of.join(least, "group").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.flatten(F.collect_list("passages")).alias("passages"))
    return out.select("doc_id", "class_id", F.size("passages").alias("n_passages"), F.array_sort("passages").alias("passages"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op5_passages": op5_passages}
ORACLES: dict[str, str] = {}
