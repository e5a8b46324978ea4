"""Operators without SQL against brute force over a whole table."""

from __future__ import annotations

from collections import defaultdict

from folia.llm import op4_decontaminate, op5_passages, op8_simhash
from folia.llm.common import table
from tests.llm.test_operators import brute_fingerprint, union_find


def texts(spark, sf):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_every_exact_repeat_is_found(spark, sf):
    found = {r["doc_id"]: r for r in op5_passages.op5_passages(spark, sf).collect()}
    words = {d: op5_passages.split_words(t) for d, t in texts(spark, sf)}
    at = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].add((d, i))
    repeated = [s for s in at.values() if len({d for d, _ in s}) > 1]
    assert repeated
    for s in repeated:
        assert len({found[d]["class_id"] for d, _ in s}) == 1
        for d, i in s:
            assert any(p["start"] <= i and i + 50 <= p["stop"] for p in found[d]["passages"])


def test_reported_passages_are_repeats(spark, sf):
    """The first and last 50 words of a reported passage are similar to words of other documents of its class."""
    found = op5_passages.op5_passages(spark, sf).collect()
    words = {d: op5_passages.split_words(t) for d, t in texts(spark, sf)}
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in words.items()}
    members = defaultdict(set)
    for r in found:
        members[r["class_id"]].add(r["doc_id"])
    for r in found:
        others = set().union(*[grams[d] for d in members[r["class_id"]] if d != r["doc_id"]])
        for p in r["passages"]:
            own = [tuple(words[r["doc_id"]][i : i + 5]) for i in range(p["start"], p["stop"] - 4)]
            for window in (own[:46], own[-46:]):
                assert len(window) == 46 and sum(g in others for g in window) >= 40


def test_simhash_on_the_table(spark, sf):
    got = {r["doc_id"]: r for r in op8_simhash.op8_simhash(spark, sf).collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts(spark, sf)}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fps[d]:016x}", c) for d, c in union_find(list(fps), links).items()}


def test_exact_leaks_are_found(spark, sf):
    norm = op4_decontaminate.normalize
    items = [(r["item_id"], norm(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    want = {(d, i) for d, t in texts(spark, sf) for i, n in items if n and n in norm(t)}
    rows = op4_decontaminate.op4_decontaminate(spark, sf).collect()
    assert want and {(r["doc_id"], r["item_id"]) for r in rows if r["distance"] == 0} == want


def similar_windows(x, y, t, need):
    """Starts of x's windows of which at least need tokens stand in one window of y, by counting all pairs of windows."""
    places = defaultdict(list)
    for q, v in enumerate(y):
        places[v].append(q)
    out = set()
    for s in range(len(x) - t + 1):
        held = [places[v] for v in x[s : s + t] if v in places]
        if len(held) >= need:
            at = {q - k for qs in held for q in qs for k in range(t)}
            if any(sum(any(b <= q < b + t for q in qs) for qs in held) >= need for b in at if 0 <= b <= len(y) - t):
                out.add(s)
    return out


def test_near_repeats_against_all_pairs_of_windows(spark, sf):
    """Links and passages against brute force over the table's shorter texts: recall of links and of windows, and no false ones."""
    docs = table(spark, sf, "documents").filter("length(text) < 3000")
    found = {r["doc_id"]: r for r in op5_passages.repeated_passages(docs).collect()}
    toks = {r["doc_id"]: op5_passages.Tokens().of([r["text"].encode()])[0].tolist() for r in docs.collect()}
    links, windows = [], defaultdict(set)
    ids = sorted(toks)
    sets = {d: set(toks[d]) for d in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 41:
                mine, theirs = similar_windows(toks[a], toks[b], 46, 41), similar_windows(toks[b], toks[a], 46, 41)
                if mine and theirs:
                    links.append((a, b))
                    windows[a] |= mine
                    windows[b] |= theirs
    comp = union_find(ids, links)
    got = {d: found[d]["class_id"] if d in found else d for d in ids}
    # nothing false: classes are within components, and passages are covered by similar windows
    assert all(comp[d] == comp[got[d]] for d in ids)
    hit = total = 0
    for d in ids:
        said = {s for p in (found[d]["passages"] if d in found else []) for s in range(p["start"], p["stop"] - 49)}
        covered = {w for s in windows[d] for w in range(s, s + 50)}
        assert {w for p in (found[d]["passages"] if d in found else []) for w in range(p["start"], p["stop"])} <= covered
        hit, total = hit + len(said & windows[d]), total + len(windows[d])
    joined = sum(got[a] == got[b] for a, b in links)
    print("links found:", joined, "of", len(links), "windows found:", hit, "of", total)
    assert joined >= 0.98 * len(links) > 0 and hit >= 0.98 * total
