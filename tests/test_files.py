"""Sources and sinks on small files; all values are invented."""

import io
import json
import zipfile

import pytest

from tesela.sources import files


def test_admission_and_readable_pages(spark):
    rows = [("a/x.PDF", 10), ("a/x.pdf.exe", 10), ("b.docx", files.MOST_BYTES), ("b.png", files.MOST_BYTES + 1), ("none", 1), ("x.d/none", 1)]
    got = [r.refused for r in files.admission(spark.createDataFrame(rows, "path string, length long")).collect()]
    assert got == [None, "wrong_type", None, "too_large", "wrong_type", "wrong_type"]
    pages = [("a", "1 2 3"), ("a", "ñandú " * 4), ("b", "x" * 19), ("b", None), ("c", None)]
    assert {r.doc: r.readable for r in files.readable(spark.createDataFrame(pages, "doc string, text string")).collect()} == {"a": True, "b": False, "c": False}


def test_lookup_reaches_the_files(spark, tmp_path):
    spark.createDataFrame([(1, "Ana"), (2, "LUZ"), (3, None)], "id int, name string").write.parquet(str(tmp_path / "t"))
    table = files.read_table(spark, str(tmp_path / "t"))
    assert [r.name for r in files.lookup(table, "id", 2).collect()] == ["LUZ"] and [r.id for r in files.lookup(table, "name", "lUz", fold=True).collect()] == [2] and files.lookup(table, "id", 9).count() == 0
    assert "EqualTo(id,2)" in files.lookup(table, "id", 2)._jdf.queryExecution().executedPlan().toString()


def test_a_list_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/list"
    assert files.read_whole(spark, path) is None
    files.replace_whole(spark.range(3), path, 1)
    files.replace_whole(spark.range(5, 6), path, 12)
    assert [r.id for r in files.read_whole(spark, path).collect()] == [5]
    (tmp_path / "list" / "v000000000012" / "_SUCCESS").unlink()
    assert files.read_whole(spark, path).count() == 3
    files.replace_whole(files.read_whole(spark, path).limit(0), path, 13)
    assert files.read_whole(spark, path).count() == 0


def test_json_with_a_schema(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"a": 1, "b": {"c": "x"}, "odd": 1}, {"a": None}]))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "f.json"), "a int, b struct<c:string>").collect()] == [(1, ("x",)), (None, None)]


def test_a_packed_file_that_is_too_large(monkeypatch):
    monkeypatch.setattr(files, "MOST_UNPACKED", 100)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "x" * 1000)
    with pytest.raises(OverflowError):
        files.office_text("a.docx", data.getvalue())


def test_rows_that_no_document_gave(spark):
    rows = spark.createDataFrame([(1, '{"document_id": "d"}'), (2, None), (3, "{"), (4, '{"document_id": "e"}')], "id int, ref string")
    assert [r.id for r in files.without_document(rows, "ref", "d").orderBy("id").collect()] == [2, 3, 4]
