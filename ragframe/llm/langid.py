"""Language identification by compression.

A language is a zstandard raw-content dictionary: lower-cased letters of a bounded
sample of its labelled texts. A text is reduced to letters and single spaces, cut into
blocks of ``BLOCK`` bytes, and every block is compressed with every dictionary; the
language with the fewest bytes over all blocks wins. Blocks keep the dictionaries at
work over a whole long text (otherwise its own beginning would replace them).

The margin 1 - best / second best is the score; a text whose margin is below
``min_margin`` is marked rejected."""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.llm.common import broadcast_up_to, fresh, shared_table, text_batches

UNKNOWN = "und"
BLOCK = 1024
LEVEL = 6
#: Texts of at most so many bytes are compressed at the level that also finds short
#: matches, behind a run of one byte (zstandard stores blocks raw that it can't shorten).
SHORT, SHORT_LEVEL, RUN = 160, 19, bytes(64)
#: Most labelled texts of a language, and most bytes of them (whole texts, the last one
#: may exceed it), that its dictionary is made of.
SAMPLE_TEXTS = 256
SAMPLE_BYTES = 100_000
#: Most bytes of all dictionaries together: with very many languages each has less.
SAMPLE_TOTAL = 64 << 20
#: A narrower margin between the best two languages rejects a text.
MIN_MARGIN = 0.01

_OTHER = regex.compile(r"\P{L}+")


def letters(text: str | None) -> bytes:
    """Lower-case letters of ``text``, runs of anything else as one space."""
    return _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionary content by language, from at most ``SAMPLE_TEXTS`` whole texts and about
    ``SAMPLE_BYTES`` bytes of each (those first by a hash of their id; any number of
    languages, which share ``SAMPLE_TOTAL`` bytes). Rows with a null language, a null text
    or a text without letters teach nothing; no usable row gives no language."""
    rows = (labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("size", F.octet_length("text")))
    # chosen without their texts, which are read afterwards; rows of one id share its place
    light = rows.select("lang", "id", "size")
    languages = light.agg(F.countDistinct("lang")).first()[0]
    most = min(SAMPLE_BYTES, SAMPLE_TOTAL // max(1, languages))

    def first(df, *ties):
        order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), *ties)
        df = df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_TEXTS)
        before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < most) | (F.col("n") == 1)).drop("before")

    chosen = shared_table(first(light, "size").select("lang", F.xxhash64("id").alias("key")).distinct(), "sample")
    texts = rows.withColumn("key", F.xxhash64("id")).join(broadcast_up_to(chosen, 1_000_000), ["lang", "key"], "left_semi")
    found = first(texts, "size", "text").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("texts")).collect()
    return {r.lang: b" ".join(letters(t.text) for t in r.texts)[-2 * most:] for r in found}


class Model:
    """Compressors of the fitted languages; made in the task from the fitted bytes."""

    def __init__(self, content: dict[str, bytes]):
        self.names = sorted(content)
        self.coders = {level: [self._coder(content[n], level) for n in self.names] for level in (LEVEL, SHORT_LEVEL)}

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin). No letter, or no language fitted: ``und`` and 0. Of
        equal sizes the first language by name wins, with margin 0."""
        data = letters(text)
        if not data or not self.names:
            return UNKNOWN, 0.0
        data = b" " + data + b" "
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        coders = self.coders[LEVEL]
        if len(data) <= SHORT:
            coders, blocks = self.coders[SHORT_LEVEL], [RUN + data]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), n) for c, n in zip(coders, self.names))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN,
             names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the language, the score (0 to 1) and whether it is rejected added as
    ``names``; columns of these names in ``docs`` are replaced. Only the text is read
    for the prediction.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Every
    row gives one row; an empty table gives none."""
    new = list(zip(names, ("string", "double", "boolean")))
    docs = docs.drop(*[n for n, _ in new])
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(" ".join(x) for x in new)).fields])

    def run(batches):
        model = Model(content)
        for batch in text_batches(batches, at):
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            extra = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                     pa.array([f[0] == UNKNOWN or f[1] < min_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def drop_rejected(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns only."""
    names = fresh(docs.columns, "_lang"), fresh(docs.columns, "_margin"), fresh(docs.columns, "_rejected")
    return identify(docs, content, text_col, min_margin, names).where(~F.col(names[2])).drop(*names)
