"""Column expressions over text. All are built-in Spark functions, so they stay
inside whole-stage code generation (no Python on the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragframe import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text) -> Column:
    """Full-text analyzer: lower-case, runs of letters/digits, drop tokens longer
    than 255 characters. Returns array<string> (order kept, duplicates kept)."""
    raw = F.regexp_extract_all(F.lower(_c(text)), F.lit(K.TOKEN_PATTERN), 0)
    return F.filter(raw, lambda t: F.length(t) <= K.MAX_TOKEN_CHARS)


# One character class built from the 18 escaped characters; each match is
# prefixed with a backslash.
_ESCAPE_CLASS = "[" + "".join("\\" + ch for ch in K.ESCAPED_QUERY_CHARS) + "]"


def escape_query(text) -> Column:
    """Backslash-escape the query-language special characters."""
    return F.regexp_replace(_c(text), F.lit("(" + _ESCAPE_CLASS + ")"), F.lit("\\\\$1"))


def escape_html(text) -> Column:
    """HTML-escape a chunk for display; '&' first, newline becomes <br />."""
    out = _c(text)
    for src, dst in K.HTML_ESCAPES:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def java_trim(text) -> Column:
    """Strip every character <= U+0020 at both ends (JVM String.trim semantics;
    Spark's trim only strips spaces)."""
    left = F.regexp_replace(_c(text), F.lit(r"^[\x00-\x20]+"), F.lit(""))
    return F.regexp_replace(left, F.lit(r"[\x00-\x20]+$"), F.lit(""))


def embedding_input(metadata, text) -> Column:
    """``k: v`` lines of the metadata (sorted by key), then newline, then text.
    With empty metadata the result starts with a newline (B4, S13)."""
    m = _c(metadata)
    lines = F.array_join(
        F.transform(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))),
                    lambda e: F.concat(e["key"], F.lit(": "), e["value"])),
        "\n")
    return F.concat(lines, F.lit("\n"), _c(text))


def format_file_size(nbytes) -> Column:
    """Human-readable size, base 1024, at most two decimals without trailing
    zeros: 0 -> '0 Bytes', 1536 -> '1.5 KB' (F4)."""
    b = _c(nbytes).cast("double")
    units = F.array(*[F.lit(u) for u in K.FILE_SIZE_UNITS])
    i = F.floor(F.log(b) / F.log(F.lit(1024.0)))
    value = F.round(b / F.pow(F.lit(1024.0), i), 2)
    text = F.regexp_replace(value.cast("string"), r"\.0$", "")
    unit = F.coalesce(F.element_at(units, (i + 1).cast("int")), F.lit("undefined"))
    return F.when(b == 0, F.lit("0 Bytes")).otherwise(F.concat(text, F.lit(" "), unit))
