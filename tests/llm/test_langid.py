"""Language identification: held-out accuracy, whole texts, odd rows."""

import zlib

from pyspark.sql import functions as F

from ragframe.llm import langid as LI
from ragframe.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    kept = [r for r in got if not r.rejected]
    assert len(kept) / len(got) > 0.98 and sum(r.lang_pred == r.lang for r in kept) / len(kept) > 0.98


def test_learns_nothing_from_the_held_out_fifth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    spoiled = docs.withColumn("lang", F.when(LI.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert LI.fit(known) == LI.fit(spoiled.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


def test_whole_text_decides():
    import duckdb
    rows = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet' WHERE lang IN ('de', 'es') AND length(text) > 3000 ORDER BY doc_id").fetchall()
    by = {lang: [t for x, t in rows if x == lang] for lang in ("de", "es")}
    model = LI.Model({k: LI.letters(" ".join(t[:400] for t in v[:20])) for k, v in by.items()})
    assert model.predict(by["de"][-1][:2000] + " " + by["es"][-1] * 4)[0] == "es"
    assert model.predict(by["es"][-1][:2000] + " " + by["de"][-1] * 4)[0] == "de"


def test_odd_rows(spark):
    rows = [(1, None, "z"), (2, "", None), (3, "12 !!", "z"), (4, "haus und garten " * 40_000, "z"), (None, "haus", "z"), (4, "haus", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = LI.identify(docs, {"de": b"das haus und der garten", "en": b"the house and the garden"}).collect()
    assert len(got) == 6 and got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und"
    assert all(r.rejected and r.score == 0.0 for r in got[:3]) and got[3].lang_pred == "de"
    assert LI.identify(docs.limit(0), {"de": b"x"}).count() == 0
    assert {r.lang_pred for r in LI.identify(docs, {}).collect()} == {"und"}
    assert LI.fit(spark.createDataFrame([(1, "a", None), (2, None, "de"), (3, "7", "de")], "doc_id long, text string, lang string")) == {}


def test_number_signs_are_no_letters():
    model = LI.Model({"de": b"das haus und der garten", "en": b"the house and the garden"})
    for text in ("½ ²", "Ⅷ", "①②", "٣ _ 7", "§ €"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("the house and the garden Ⅷ")[0] == "en"


def test_any_number_of_languages(spark, monkeypatch):
    """300 languages, whose dictionaries share a bound in bytes; whole texts are learned from."""
    rows = [(i, "kalt " * 500 + f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", f"l{i % 300}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = LI.fit(docs)
    assert len(got) == 300 and all(v.count(b"word") == 2 for v in got.values())
    monkeypatch.setattr(LI, "SAMPLE_TOTAL", 300 * 100)
    assert sum(map(len, LI.fit(docs).values())) <= 2 * 300 * 100
