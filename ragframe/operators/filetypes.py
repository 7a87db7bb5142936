"""File types by content.

Signatures are matched by native expressions over the first bytes (and, for the older
office formats, by the names of their streams). Formats that are zip files are told apart
by their members, which a pandas UDF reads; only rows that are zip files reach it. A
declared type that the content contradicts is a reject."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = 4096
#: Leading bytes (hex) of types that have them.
SIGNATURES = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("1F8B", "application/gzip"),
              ("4D5A", "application/x-msdownload"), ("7F454C46", "application/x-elf")]
#: Streams of compound files, whose names are in UTF-16.
STREAMS = [("WordDocument", "application/msword"), ("Workbook", "application/vnd.ms-excel"), ("Book", "application/vnd.ms-excel"),
           ("PowerPoint Document", "application/vnd.ms-powerpoint")]
#: Folders of the office formats that are zip files.
FOLDERS = [("word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
           ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
           ("ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation")]
#: Other names of a type.
SAME = {"application/x-vnd.oasis.opendocument.spreadsheet": "application/vnd.oasis.opendocument.spreadsheet", "text/xml": "application/xml"}
#: Types that any text may have, those that any XML may have, and those that say what the text is.
ANY_TEXT = ["text/plain", "text/csv", "text/html"]
TEXTS = ["text/plain", "text/html", "application/json", "application/xml", "application/xhtml+xml", "application/x-abiword", "application/rtf"]
XMLS = ["application/xml", "application/xhtml+xml", "application/x-abiword"]
UNKNOWN = "application/octet-stream"


def zip_type(content: bytes) -> str:
    """The type of a zip file by its members."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "mimetype" in names and z.getinfo("mimetype").file_size <= 200:
                return z.read("mimetype").decode("ascii", "replace").strip()
            if "[Content_Types].xml" in names:
                for folder, kind in FOLDERS:
                    if any(n.startswith(folder) for n in names):
                        return kind
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError, RuntimeError):
        pass
    return "application/zip"


def _zip_types(content: Column) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else zip_type(bytes(b)) for b in batch], dtype=object)
    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(content)


def detected_type(content: Column) -> Column:
    """The type of a file by its bytes; text without marks is ``text/plain``, empty content
    too, anything else unknown ``application/octet-stream``. NULL content: NULL."""
    head = F.substring(content, 1, HEAD)
    text = head.cast("string")
    lead = F.hex(F.substring(content, 1, 16))
    mark = F.regexp_replace(text, r"(?is)^(\x{FEFF}|\s|<!--.*?-->|<\?.*?\?>|<!doctype\s+[^>]*>)+", "")
    root = F.lower(F.regexp_extract(mark, r"^<([A-Za-z][\w:.-]*)", 1))
    opened = F.ltrim(F.regexp_replace(text, r"^[\x{FEFF}\s]+", ""))
    kind = F.when(content.isNull(), F.lit(None).cast("string"))
    kind = kind.when(F.instr(F.substring(content, 1, 1024).cast("string"), "%PDF-") > 0, "application/pdf")
    kind = kind.when(lead.startswith("504B0304") | lead.startswith("504B0506"), _zip_types(F.when(lead.startswith("504B"), content)))
    whole = content.cast("string")
    for name, found in STREAMS:
        kind = kind.when(lead.startswith("D0CF11E0A1B11AE1") & (F.instr(whole, "\0".join(name) + "\0") > 0), found)
    kind = kind.when(F.hex(F.substring(content, 61, 8)) == "424F4F4B4D4F4249", "application/x-mobipocket-ebook")
    for sign, found in SIGNATURES:
        kind = kind.when(lead.startswith(sign), found)
    kind = kind.when(F.startswith(opened, F.lit("{\\rtf")), "application/rtf")
    textual = F.is_valid_utf8(whole) & (F.instr(whole, "\0") == 0)
    kind = kind.when(~textual, UNKNOWN)
    kind = kind.when(root == "abiword", "application/x-abiword")
    kind = kind.when((root == "html") & F.startswith(opened, F.lit("<?xml")), "application/xhtml+xml")
    kind = kind.when(root.isin("html", "head", "body") | F.regexp_like(opened, F.lit(r"(?i)^(<!--.*?-->\s*)*<!doctype\s+html")), "text/html")
    kind = kind.when(F.startswith(opened, F.lit("<?xml")), "application/xml")
    kind = kind.when(opened.rlike(r"^[\[{]") & F.try_parse_json(F.regexp_replace(whole, r"^\x{FEFF}", "")).isNotNull(), "application/json")
    return kind.otherwise("text/plain")


def check_types(files: DataFrame, content_col: str = "content", mime_col: str = "mime", out_col: str = "detected",
                error_col: str = "type_error") -> DataFrame:
    """Adds the type by content and, where the declared one (NULL or '': none) contradicts
    it, the reason. Text of any kind may be declared plain, CSV or HTML text, any XML as XML; other
    types must be what the content is. A NULL content contradicts nothing."""
    out = files.withColumn(out_col, detected_type(F.col(content_col)))
    said = F.coalesce(F.col(mime_col), F.lit(""))
    for name, other in SAME.items():
        said = F.when(F.col(mime_col) == name, F.lit(other)).otherwise(said)
    found = F.col(out_col)
    for name, other in SAME.items():
        found = F.when(F.col(out_col) == name, F.lit(other)).otherwise(found)
    fits = (said == "") | found.isNull() | (said == found) | (said.isin(ANY_TEXT) & found.isin(TEXTS)) | ((said == "application/xml") & found.isin(XMLS))
    return out.withColumn(error_col, F.when(~fits, F.concat(F.lit("content is "), F.col(out_col), F.lit(", not "), F.col(mime_col))))
