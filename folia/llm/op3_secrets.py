"""Secret scan: fixed patterns, plus sliding-window entropy of candidate strings.

Everything is DataFrame functions. Matches and the gaps between them come from
one pattern, so positions are running sums of their lengths. A candidate is a
maximal run of key characters with a letter and a digit. A window slides over
it and carries the count of every character of its class: each step takes one
from the count of the character that leaves and adds one to that of the one that
enters, and these two counts update the sum of c*log2(c), from which the window's
Shannon entropy follows. Hex runs and mixed runs have their own alphabet, window
and threshold. Candidates that the allow-list knows or that touch a base span
add nothing, whole.

Edge cases: a null text counts as empty; offsets are code points, end
exclusive; repeated rows stay; null doc_ids stay; extra columns are ignored.
A very long candidate takes time in proportion to its length; of a text with n
hits of a kind, the list of spans is copied at each hit (n = 16,000 takes
seconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
# runs of the minimum length at least: shorter runs would be dropped, and a run is always matched whole
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_HEX, _KEY = "0123456789ABCDEFabcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: class: (pattern of the whole candidate, window, least entropy in bits, alphabet)
CLASSES = {"hex": (r"^[0-9A-Fa-f]+$", 20, 2.95, _HEX), "mixed": (r"[g-zG-Z+/_=-]", 24, 3.95, _KEY)}
#: Strings that look random but are known: counting sequences, alphabets, fillers, identifiers of nothing.
ALLOW = r"(?i)(0123456789|abcdefghij|qwertyuiop|example|sample|dummy|placeholder|changeme|xxxxx|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"

_SPAN = "struct<start:int,kind:int,stop:int>"


def _empty() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int | None = None) -> Column:
    """Spans of all matches that keep() accepts; it gets the match and its group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), part.alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["0"])
        stop = start + F.length(x["1"])
        new = F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")).cast(_SPAN)))
        ok = x["1"].isNotNull()
        if keep:
            ok = ok & keep(x["1"], x["2"])
        return F.struct(F.coalesce(stop, acc["pos"]).alias("pos"), F.when(ok, new).otherwise(acc["out"]).alias("out"))

    zipped = zipped.cast("array<struct<`0`:string,`1`:string,`2`:string>>")
    out = F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), _empty().alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), out).otherwise(_empty())


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(0.0)


def window_entropy(chars: Column, window: int, alphabet: str = _KEY) -> Column:
    """Largest entropy of any window of an array of characters of the alphabet (fewer characters: of all of them)."""
    codes = F.transform(chars, lambda ch: F.call_function("instr", F.lit(alphabet), ch))

    def slide(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= window, F.get(codes, i - window)).otherwise(0)
            more, less = F.get(acc["counts"], enters - 1), F.when(leaves > 0, F.get(acc["counts"], leaves - 1)).otherwise(0)
            change = F.when(enters == leaves, 0.0).otherwise(_clog(more + 1) - _clog(more) + _clog(less - 1) - _clog(less))
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == enters - 1, 1).otherwise(0) - F.when(k == leaves - 1, 1).otherwise(0))
            s, n = acc["s"] + change, F.least(i + 1, F.lit(window))
            h = F.log2(n) - s / n
            full = (i + 1 >= window) | (i + 1 == F.size(codes))
            return F.struct(counts.alias("counts"), s.alias("s"), F.when(full, F.greatest(acc["best"], h)).otherwise(acc["best"]).alias("best"))

        init = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), init, step, lambda acc: acc["best"])

    # the codes are made once, not at every step
    return F.get(F.transform(F.array(codes), slide), 0)


def _random_looking(hit: Column, _: Column) -> Column:
    high = F.lit(False)
    for pattern, window, least, alphabet in CLASSES.values():
        high = high | F.when(hit.rlike(pattern), window_entropy(F.split(hit, ""), window, alphabet) >= least).otherwise(F.lit(False))
    mixed = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.when(mixed & ~hit.rlike(ALLOW), high).otherwise(F.lit(False))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with base and found: arrays of (start, kind, stop), sorted; base holds the fixed patterns' spans."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.withColumn("__text", F.col("text").cast("string"))
    rows = rows.withColumn("__assign", _spans(text, ASSIGN, 0, lambda hit, part: F.length(part) >= ASSIGN_MIN, 2))
    rows = rows.withColumn("__access", _spans(text, ACCESS, 1)).withColumn("__hex", _spans(text, HEX, 2))
    rows = rows.withColumn("__more", _spans(text, CANDIDATE, 3, _random_looking))
    rows = rows.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    extra = F.filter("__more", lambda m: ~F.exists(F.col("__base"), lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    return rows.withColumn("__found", F.array_sort(F.concat("__base", extra)))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row."""
    rows = scan(docs.select("doc_id", "text"))
    n = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    more = (F.size("__found") - F.size("__base")).cast("long").alias("n_entropy")
    return rows.select("doc_id", *n, F.sha2(_text(F.col("__base")), 256).alias("base_sha256"), _text(F.col("__found")).alias("spans"), more)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each found span (overlapping ones together) replaced by a mark, and n_chars where it is a column."""
    # the table's own columns travel in a struct, so that none can clash
    rows = scan(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__doc"), docs["text"]))
    own = {c: F.col("__doc").getField(c) for c in docs.columns}

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("__text"), acc["pos"] + 1, s["start"] - acc["pos"])
        fresh = s["start"] >= acc["pos"]
        out = F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), out.alias("out"))

    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("__found", init, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("__text"), acc["pos"] + 1, F.length("__text"))))
    some = F.size("__found") > 0
    rows = rows.withColumn("__new", F.when(some, whole).otherwise(F.col("text")))
    own["text"] = F.col("__new")
    if "n_chars" in own:
        own["n_chars"] = F.when(some, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[c.alias(name) for name, c in own.items()])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def hits(kind: int, pattern: str, group: int = 0) -> str:
        p = pattern.replace("'", "''")
        return f"""select doc_id, {kind} as kind, generate_subscripts(h, 1) as i, unnest(h) as hit, unnest(p) as part, unnest(list_slice(g, 1, len(h))) as gap
 from (select doc_id, regexp_extract_all(t, '{p}') as h, regexp_extract_all(t, '{p}', {group}) as p, string_split_regex(t, '{p}') as g from d) x"""

    high = []
    for pattern, window, least, _ in CLASSES.values():
        high.append(f"""(regexp_matches(hit, '{pattern}') and list_max(list_transform(range(1, greatest(1, length(hit) - {window - 1}) + 1), lambda i:
 log2(least({window}, length(hit))) - list_sum(list_transform(list_distinct(string_split(substr(hit, cast(i as int), {window}), '')), lambda c:
 (length(substr(hit, cast(i as int), {window})) - length(replace(substr(hit, cast(i as int), {window}), c, '')))
 * log2(length(substr(hit, cast(i as int), {window})) - length(replace(substr(hit, cast(i as int), {window}), c, ''))))) / least({window}, length(hit)))) >= {least})""")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
h as ({hits(0, ASSIGN, 2)} union all {hits(1, ACCESS)} union all {hits(2, HEX)} union all {hits(3, CANDIDATE)}),
s as (select doc_id, kind, hit, part, sum(length(gap) + length(hit)) over (partition by doc_id, kind order by i) as stop from h),
k as (select doc_id, kind, cast(stop - length(hit) as bigint) as start, cast(stop as bigint) as stop from s where
 case kind when 0 then length(part) >= {ASSIGN_MIN} when 3 then regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]') and not regexp_matches(hit, '{ALLOW}') and ({' or '.join(high)}) else true end),
f as (select * from k where kind < 3 or not exists (select 1 from k b where b.kind < 3 and b.doc_id = k.doc_id and b.start < k.stop and k.start < b.stop)),
j as (select doc_id, sum((kind = 0)::int)::bigint as n_assign, sum((kind = 1)::int)::bigint as n_access, sum((kind = 2)::int)::bigint as n_hex, sum((kind = 3)::int)::bigint as n_entropy,
 string_agg(n, ',' order by start, kind) filter (where kind < 3) as base, string_agg(n, ',' order by start, kind) as spans
 from (select *, case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'entropy' end || ':' || start || ':' || stop as n from f) x group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_entropy, 0) as n_entropy,
 sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join j using (doc_id)"""


QUERIES = {"op3_secrets": op3_secrets}
ORACLES = {"op3_secrets": _oracle()}
