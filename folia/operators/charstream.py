"""Single characters to words, lines, blocks and Markdown: the stack below spans; characters as arrays, lines as window plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folia.functions import predicates as p
from folia.operators.sequence import islands, lagged
from folia.operators.spans import CHAR, LEFT, PITCH, SQL_LINES, TOP, documents, page_md

PAGE = ["doc_id", "page"]
LINE = [*PAGE, "line_no"]
WORD_GAP, WORD_MIN, BASELINE = 0.2, 1.5, 0.25
SPACING, MARGIN = 1.8, 24
#: Code points of ``predicates.WS``.
BLANKS = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


#: Characters that are clustered at a time; a page is never cut.
MANY = 250_000

WORDS = "doc_id long, page int, line_no int, word_no int, text string, x0 double, x1 double, y double, size double, bold boolean"
LINES = "doc_id long, page int, line_no int, text string, x0 double, x1 double, y double, size double, bold boolean"


def cluster_lines(page: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Line of each character, numbered on its page from the top: baselines within a quarter em of a line's first; the em is the page's largest."""
    em = np.ones(int(page.max(initial=-1)) + 1)
    np.maximum.at(em, page, size)
    baseline = y / em[page]
    order = np.lexsort((-baseline, page))
    p, v = page[order], baseline[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    numbers, last, anchor, n = [], None, 0.0, 0
    for k, x in zip(p[new].tolist(), v[new].tolist()):
        if k != last:
            last, anchor, n = k, x, 0
        elif abs(x - anchor) > BASELINE:
            anchor, n = x, n + 1
        numbers.append(n)
    line = np.empty(len(p), np.int32)
    line[order] = np.array(numbers, np.int32)[np.cumsum(new) - 1]
    return line


def _heads(*keys: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def cluster_words(chars: dict[str, np.ndarray]) -> dict[str, list | np.ndarray]:
    """Words of characters (page, seq, ch as code points, x0, x1, y, size, bold): a blank or a gap of 0.2 em and 1.5 points ends a word."""
    inked = ~np.isin(chars["ch"], BLANKS)
    line = cluster_lines(chars["page"], chars["y"], chars["size"])[inked]
    c = {k: v[inked] for k, v in chars.items()}
    order = np.lexsort((c["seq"], c["x0"], line, c["page"]))
    line, c = line[order], {k: v[order] for k, v in c.items()}
    if not len(line):
        return {"line_no": line, "word_no": line, "text": []} | {k: c[k] for k in ("page", "x0", "x1", "y", "size", "bold")}
    starts = np.zeros(len(line), bool)
    starts[_heads(c["page"], line)] = True
    first = np.flatnonzero(starts)  # of a line
    starts[1:] |= c["x0"][1:] - c["x1"][:-1] >= np.maximum(WORD_GAP * np.minimum(c["size"][1:], c["size"][:-1]), WORD_MIN)
    at = np.flatnonzero(starts)
    text = c["ch"].astype("<u4").tobytes().decode("utf-32-le")
    begin = np.searchsorted(at, first)  # a line's first word
    number = np.arange(len(at)) - np.repeat(begin, np.diff([*begin, len(at)]))
    return {
        "page": c["page"][at], "line_no": line[at], "word_no": number.astype(np.int32), "text": [text[a:z] for a, z in zip(at.tolist(), [*at[1:].tolist(), len(line)])], "x0": np.minimum.reduceat(c["x0"], at), "x1": np.maximum.reduceat(c["x1"], at),
        "y": np.maximum.reduceat(c["y"], at), "size": np.maximum.reduceat(c["size"], at), "bold": np.logical_and.reduceat(c["bold"], at),
    }


def join_words(w: dict) -> dict[str, list | np.ndarray]:
    """Lines of the words of :func:`cluster_words`; bold where most of the words are."""
    if not w["text"]:
        return {k: v for k, v in w.items() if k != "word_no"}
    at = _heads(w["page"], w["line_no"])
    stops = [*at[1:].tolist(), len(w["text"])]
    bold = 2 * np.add.reduceat(w["bold"].astype(np.int64), at) > np.diff([*at, len(w["text"])])
    text = [" ".join(w["text"][a:z]) for a, z in zip(at.tolist(), stops)]
    return {"page": w["page"][at], "line_no": w["line_no"][at], "text": text, "x0": np.minimum.reduceat(w["x0"], at), "x1": np.maximum.reduceat(w["x1"], at), "y": np.maximum.reduceat(w["y"], at), "size": np.maximum.reduceat(w["size"], at), "bold": bold}


def clustered(pages: DataFrame, draw: Callable[[int, str], dict[str, np.ndarray]], lines_only: bool = False) -> DataFrame:
    """Words, or lines, of pages (doc_id, page, chunk): ``draw`` makes a page's characters (all of :func:`cluster_words` but the page).

    A page's characters stay in the worker that made them: as rows they would be
    some fifty times their text, in each shuffle and sort.
    """
    schema = to_arrow_schema(T.StructType.fromDDL(LINES if lines_only else WORDS))

    def made(rows: list[tuple], drawn: list[dict]) -> pa.RecordBatch:
        chars = {k: np.concatenate([d[k] for d in drawn]) for k in drawn[0]}
        chars["page"] = np.repeat(np.arange(len(rows)), [len(d["ch"]) for d in drawn])
        out = cluster_words(chars)
        out = join_words(out) if lines_only else out
        at = out["page"]
        out |= {"doc_id": np.array([r[0] for r in rows], np.int64)[at], "page": np.array([r[1] for r in rows], np.int32)[at]}
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, drawn, n = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                doc, page, chunk = (batch.column(i)[k].as_py() for i in range(3))
                rows.append((doc, page))
                drawn.append(draw(page, chunk))
                n += len(drawn[-1]["ch"])
                if n >= MANY or len(rows) >= 10_000:
                    yield made(rows, drawn)
                    rows, drawn, n = [], [], 0
        if rows:
            yield made(rows, drawn)

    return pages.select("doc_id", "page", "chunk").mapInArrow(run, LINES if lines_only else WORDS)


def list_item(text: Column) -> Column:
    """struct(ordered, body) of a list line, or null."""
    bullet, number = r"^(?:[-*•●◦▪+]|\[[ xX]\])\s+(.*)$", r"^(?:[0-9]{1,3}[.)]|\([0-9]{1,3}\)|\[[0-9]{1,3}\])\s+(.*)$"
    return F.when(text.rlike(bullet), F.struct(F.lit(False).alias("ordered"), F.regexp_extract(text, bullet, 1).alias("body"))).when(
        text.rlike(number), F.struct(F.lit(True).alias("ordered"), F.regexp_extract(text, number, 1).alias("body"))
    )


def text_blocks(rows: DataFrame, body: float = 12) -> DataFrame:
    """Blocks of lines: headings and list items alone, paragraphs of lines that follow each other closely under one another."""
    rows = rows.withColumn("level", p.heading_level(F.col("text"), F.col("size"), F.lit(body), F.col("bold"))).withColumn("item", list_item(F.col("text")))
    rows = rows.withColumn("plain", F.col("level").isNull() & F.col("item").isNull())
    order = [F.col("line_no")]
    over = lambda c: lagged(c, PAGE, order)
    apart = (over("y") - F.col("y") > SPACING * F.greatest("size", over("size"))) | (F.col("x0") > over("x1") + MARGIN) | (F.col("x1") + MARGIN < over("x0"))
    starts = ~F.col("plain") | ~over("plain") | apart
    rows = islands(rows, PAGE, order, starts, "block_no")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(*PAGE, "block_no").agg(text.alias("text"), F.max("level").alias("level"), F.max("item.body").alias("body"), F.bool_or("item.ordered").alias("ordered"), F.min("x0").alias("x0"), F.max("y").alias("top"))


def markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, page, chunk: blocks from the top, a blank line apart but for items of one list."""
    item = F.col("body").isNotNull()
    w = W.partitionBy(*PAGE).orderBy("block_no")
    number = F.row_number().over(W.partitionBy(*PAGE, "run").orderBy("block_no"))
    rows = islands(blocks, PAGE, [F.col("block_no")], ~(item & F.coalesce(F.lag("body").over(w).isNotNull(), F.lit(False))), "run")
    said = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(
        item, F.concat(F.when(F.col("ordered"), F.concat(number.cast("string"), F.lit(". "))).otherwise("- "), "body")
    )
    rows = rows.withColumn("said", F.coalesce(said, "text")).withColumn("gap", F.when(F.col("block_no") == 0, "").when(F.lag("run").over(w) == F.col("run"), "\n").otherwise("\n\n"))
    chunk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.concat("gap", "said").alias("said")))), lambda b: b["said"]), "")
    return rows.groupBy(*PAGE).agg(chunk.alias("chunk"))


def analyze(pages: DataFrame, draw: Callable[[int, str], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """Markdown of pages of single characters."""
    return markdown(text_blocks(clustered(pages, draw or canonical, lines_only=True)))


def canonical(page: int, chunk: str) -> dict[str, np.ndarray]:
    """A page's characters at their canonical place; blank lines have none."""
    ch = np.frombuffer(chunk.encode("utf-32-le"), "<u4")
    ends = np.flatnonzero(ch == 10)
    row = np.zeros(len(ch), np.int64)
    row[ends[ends + 1 < len(ch)] + 1] = 1
    row = np.cumsum(row)
    k = np.arange(len(ch)) - np.concatenate([[0], ends + 1])[row] if len(ch) else row
    keep = ch != 10
    ch, row, k = ch[keep], row[keep], k[keep]
    x0 = (LEFT + CHAR * k).astype(float)
    first = (row == 0) & (page == 1)
    return {"seq": (row << 32) + k, "ch": ch, "x0": x0, "x1": x0 + CHAR, "y": (TOP - PITCH * row).astype(float), "size": np.where(first, 18.0, 12.0), "bold": first}


def char_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, words and characters that the clustering finds on each page."""
    ws = clustered(page_md(documents(spark, sf_dir)), canonical)
    return ws.groupBy(*PAGE).agg(F.countDistinct("line_no").alias("n_lines"), F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"), F.max("x1").alias("right"))


def char_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analyze(page_md(documents(spark, sf_dir)))
    return out.select("doc_id", "page", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


_LVL = "case when not (length(t) > 180 or (ends_with(t, '.') and not regexp_matches(t, '[A-Za-z]')) or len(string_split(t, '. ')) > 2 or (ends_with(t, '.') and length(t) > 50)) and line_no = 0 then 1 end"
_ITEM = r"regexp_extract(t, '^(?:[-*•●◦▪+]|\[[ xX]\]|[0-9]{1,3}[.)]|\([0-9]{1,3}\)|\[[0-9]{1,3}\])\s+(.*)$', 1)"
QUERIES = {f.__name__: f for f in (char_words, char_markdown)}
ORACLES = {
    "char_words": f"with {SQL_LINES}, w as (select doc_id, page, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') as ws, length(regexp_extract(line, '^.*\\S')) as n from ln where regexp_matches(line, '\\S')) select doc_id, page, count(*) as n_lines, cast(sum(len(ws)) as bigint) as n_words, cast(sum(length(array_to_string(ws, ''))) as bigint) as n_chars, max(72 + 6 * n)::double as \"right\" from w group by doc_id, page",
    "char_markdown": f"""with {SQL_LINES}, a as (select doc_id, page, line_no, y, size, array_to_string(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''), ' ') as t from ln where regexp_matches(line, '\\S')),
b as (select *, {_LVL} as level, {_ITEM} as item from a), c as (select *, level is null and item = '' as plain from b),
d as (select *, sum(case when not plain or not coalesce(lag_plain, false) or lag_y - y > 1.8 * greatest(size, lag_size) then 1 else 0 end) over (partition by doc_id, page order by line_no) - 1 as block from (select *, lag(plain) over w as lag_plain, lag(y) over w as lag_y, lag(size) over w as lag_size from c window w as (partition by doc_id, page order by line_no)) x),
e as (select doc_id, page, block, case when max(level) = 1 then '# ' || string_agg(t, ' ' order by line_no) else string_agg(t, ' ' order by line_no) end as said, max(item) as item from d group by doc_id, page, block),
f as (select doc_id, page, string_agg(said, chr(10) || chr(10) order by block) as chunk from e group by doc_id, page) select doc_id, page, length(chunk) as n_chars, md5(chunk) as digest from f""",
}
