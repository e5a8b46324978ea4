from __future__ import annotations

import json

import pytest

from folia.plans import api
from folia.sources import pdf_writer as w


@pytest.fixture()
def pdf():
    return w.document([w.text_at(72, 720, "Hello there, this page has words")])


def test_sql_functions(spark, pdf):
    api.register(spark)
    spark.createDataFrame([(1, bytearray(pdf)), (2, bytearray(b"junk")), (3, None)], "id int, content binary").createOrReplaceTempView("files")
    got = {r["id"]: (r["d"], r["p"]) for r in spark.sql("select id, pdf_is_digital(content) as d, pdf_password_required(content) as p from files").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (None, None)}
    rows = spark.sql("select id, s.text, s.x from files, lateral pdf_spans(content) s").collect()
    assert [tuple(r) for r in rows] == [(1, "Hello there, this page has words", 72.0)]
    assert spark.sql("select markdown_reflow('a\nb') as t, markdown_collapse('a   b') as c").first()[:] == ("a b", "a b")


def test_tables_from_json(spark):
    def span(text, x, y):
        return {"text": text, "bbox": {"x0": x, "y0": y, "x1": x + 50, "y1": y + 10}, "font_size": 10, "is_bold": False, "page_number": 1}

    grid = json.dumps([span("C", 0, 80), span("A", 0, 100), span("B", 100, 101), span("D", 100, 80)])
    rows = spark.createDataFrame([(1, grid), (2, "[]"), (3, None), (4, json.dumps([span("x", 0, 0)]))], "id long, spans_json string")
    got = {r["id"]: r["markdown"] for r in api.tables_from_json(rows).collect()}
    assert got == {1: "| B | A |\n| --- | --- |\n| C | D |\n", 2: "", 3: None, 4: ""}


def test_command_line(spark, pdf, tmp_path, capsys):
    src, out = tmp_path / "a.pdf", tmp_path / "a.md"
    src.write_bytes(pdf)
    assert api.main([str(src), "-o", str(out), "-q"]) == 0 and out.read_text().startswith("Hello there")
    assert api.main([str(src), "--json"]) == 0 and json.loads(capsys.readouterr().out)["words"] == 6
    assert api.main([str(tmp_path / "none.pdf"), "-q"]) == 1
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    assert api.main([str(tmp_path / "b.pdf"), "-q"]) == 2
