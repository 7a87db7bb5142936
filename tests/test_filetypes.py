"""Every allowed type on a generated file, and contradictions."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ragframe import constants as K
from ragframe.operators import filetypes as FT


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("CT", "[Content_Types].xml"), data)
    return out.getvalue()


def compound(stream):
    return bytes.fromhex("D0CF11E0A1B11AE1") + bytes(600) + "Root Entry".encode("utf-16-le") + bytes(40) + stream.encode("utf-16-le") + bytes(500)


def odf(kind):
    return zipped(mimetype=f"application/vnd.oasis.opendocument.{kind}", content="x")


GENERATED = {
    "application/pdf": b"\xef\xbb\xbf%PDF-1.7\n\x00\xff", "text/plain": "Grüße {x} <y>".encode(), "text/html": b"<!-- c -->\n<!DOCTYPE html><p>x",
    "text/csv": b"a,b\n1,2\n", "text/xml": b"<?xml version='1.0'?><a/>", "application/rtf": b"{\\rtf1 x}", "application/json": b' {"a": [1, null]}',
    "application/xml": b"\xef\xbb\xbf<?xml version='1.0'?>\n<!-- c --><root/>",
    "application/xhtml+xml": b"<?xml version='1.0'?><!DOCTYPE html><html xmlns='http://www.w3.org/1999/xhtml'></html>",
    "application/vnd.ms-excel": compound("Workbook"), "application/msword": compound("WordDocument"), "application/vnd.ms-powerpoint": compound("PowerPoint Document"),
    FT.FOLDERS[0][1]: zipped(CT="x", word__document="x"), FT.FOLDERS[1][1]: zipped(CT="x", xl__workbook="x"), FT.FOLDERS[2][1]: zipped(CT="x", ppt__presentation="x"),
    "application/x-vnd.oasis.opendocument.spreadsheet": odf("spreadsheet"), "application/vnd.oasis.opendocument.spreadsheet": odf("spreadsheet"),
    "application/vnd.oasis.opendocument.presentation": odf("presentation"), "application/vnd.oasis.opendocument.text": odf("text"),
    "application/x-abiword": b"<?xml version='1.0'?>\n<!DOCTYPE abw PUBLIC 'x'>\n<abiword template='false'/>",
    "application/epub+zip": zipped(mimetype="application/epub+zip", META="x"), "application/x-mobipocket-ebook": bytes(60) + b"BOOKMOBI" + bytes(100),
}


def checked(spark, rows):
    df = spark.createDataFrame([(i, m, b) for i, (m, b) in enumerate(rows)], "i int, mime string, content binary")
    return [(r["detected"], r["type_error"]) for r in FT.check_types(df).orderBy("i").collect()]


def test_each_allowed_type(spark):
    assert set(GENERATED) == set(K.ALLOWED_MIME_TYPES)
    got = checked(spark, list(GENERATED.items()))
    want = {**FT.SAME, "text/csv": "text/plain"}
    assert got == [(want.get(m, m), None) for m in GENERATED]
    assert [g[0] for g in checked(spark, [(None, b) for b in GENERATED.values()])] == [g[0] for g in got]


@pytest.mark.parametrize("mime", sorted(GENERATED))
def test_contradictions(spark, mime):
    """No file passes as a type of another family."""
    binary = [m for m in GENERATED if GENERATED[m][:4] in (b"PK\x03\x04", bytes.fromhex("D0CF11E0")) or m in ("application/pdf", "application/x-mobipocket-ebook")]
    rows = [(other, GENERATED[mime]) for other in GENERATED]
    for (other, _), (found, error) in zip(rows, checked(spark, rows)):
        if (mime in binary or other in binary) and FT.SAME.get(other, other) != FT.SAME.get(mime, mime):
            assert error == f"content is {found}, not {other}"


def test_odd_content(spark):
    rows = [("text/plain", None), ("text/plain", b""), (None, b"\x00\x01\xff"), ("text/plain", b"\xff\xfeab"), ("application/json", b"{broken"), ("", b"x"),
            ("image/png", bytes.fromhex("89504E470D0A1A0A") + b"x"), ("application/epub+zip", b"PK\x03\x04 not a zip"), ("text/plain", b"MZ\x90\x00")]
    assert checked(spark, rows) == [
        (None, None), ("text/plain", None), ("application/octet-stream", None), ("application/octet-stream", "content is application/octet-stream, not text/plain"),
        ("text/plain", "content is text/plain, not application/json"), ("text/plain", None), ("image/png", None),
        ("application/zip", "content is application/zip, not application/epub+zip"), ("application/x-msdownload", "content is application/x-msdownload, not text/plain")]
    df = spark.createDataFrame([], "mime string, content binary")
    assert FT.check_types(df).count() == 0


def test_only_zip_files_reach_python(spark):
    df = spark.createDataFrame([(None, b"x")], "mime string, content binary").select(FT.detected_type(F.col("content")).alias("t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 and "504B" in plan


def test_parsing_verifies_types(spark):
    from ragframe.operators import ingest as IG
    df = spark.createDataFrame([(1, "text/html", b"<p>a"), (2, "text/plain", b"%PDF-1.4"), (3, None, b"t"), (4, "text/plain", None)], "i int, mime string, content binary")
    got = [(r["text"], r["parse_error"]) for r in IG.parse_documents(df, verify_types=True).orderBy("i").collect()]
    assert got == [("a", None), (None, "content is application/pdf, not text/plain"), ("t", None), (None, "no content")]
