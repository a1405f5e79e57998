"""Every operator and pipeline stage on odd rows: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigraph.llm import decontaminate, html_extract, langid, linededup, minhash, packing, prefix_free, quality, sharding, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"word{i % 977} number {i}" for i in range(120_000))  # beyond one slice
SOME = "The quick brown fox jumps over the lazy dog near the river bank. It was a calm day.\nNobody saw the fox again that day, they said."
CLASH = ("kept", "score", "pos", "n", "key", "h1", "rank", "task", "shard", "size", "group", "end", "bands", "component", "id", "chunk",
         "held_out", "share", "h", "slots", "spans", "quality", "__x")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, SOME, "en", "a", 1), (2, SOME, None, None, None), (2, SOME, None, None, None), (3, None, "en", "a", None), (4, "", "en", "a", 0),
            (5, " \n\t ", "en", None, 3), (None, SOME, "en", "a", 5), (6, LONG, "en", "a", len(LONG)), (7, LONG, "en", "b", len(LONG)),
            (8, "x", None, "a", 1), (9, "日本語 текст ελληνικά", "en", "a", 9), (10, "<|endoftext|> a b", "en", "a", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, SOME), (2, None), (None, SOME), (3, ""), (4, "fox")], "item_id long, text string")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_toxicity(odd, none, labels):
    stems = toxicity.learn(odd, labels)
    got = by_id(toxicity.score(odd, stems))
    assert sum(map(len, got.values())) == 12
    assert got[3][0]["score"] == got[4][0]["score"] == 0.0 and got[4][0]["predicted"] == 0
    assert toxicity.score(none, stems).count() == 0
    assert toxicity.learn(none, labels.limit(0)) == {}


def test_language(odd, none):
    model = langid.learn(odd)
    got = by_id(langid.identify(odd, model))
    assert [got[k][0]["lang_pred"] for k in (3, 4, 5)] == ["und"] * 3 and got[3][0]["score"] == 0.0
    assert got[1][0]["lang_pred"] == "en" and len(got[2]) == 2
    assert langid.identify(none, model).count() == 0 and langid.spans(none, model).count() == 0
    empty = langid.learn(none)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.spans(odd.filter("doc_id = 1"), model).agg(F.sum("n_words")).first()[0] == len(SOME.split())


def test_repeats(odd, none):
    got = by_id(prefix_free.remove_repeats(odd))
    size = len(SOME.encode())
    assert got[1][0]["n_removed"] == 0 and [r["n_removed"] for r in got[2]] == [size, size]
    assert got[None][0]["n_removed"] == 0  # no place in the order
    assert got[7][0]["n_removed"] == len(LONG) and got[7][0]["n_spans"] == 1 and got[6][0]["n_removed"] == 0
    assert got[3][0]["n_bytes"] == 0 and got[4][0]["n_bytes"] == 0
    assert prefix_free.remove_repeats(none).count() == 0


def test_decontamination(odd, none, items):
    got = by_id(decontaminate.flag(odd, items))
    assert got[1][0]["item_ids"] == [1] and got[2][1]["contaminated"] and not got[6][0]["contaminated"]
    assert not got[None][0]["contaminated"] and got[3][0]["share"] == 0.0
    assert decontaminate.flag(none, items).count() == 0
    assert decontaminate.flag(odd, items.limit(0)).filter("contaminated").count() == 0


def test_line_dedup(odd, none):
    got = by_id(linededup.report(odd))
    assert got[1][0]["n_removed"] == 0 and got[None][0]["n_removed"] == 0 and got[3][0]["n_lines"] == 0
    kept = linededup.shortened(odd)
    assert kept.columns == odd.columns and kept.count() == 12
    assert kept.filter("doc_id = 3").first()["text"] is None and kept.filter("doc_id = 4").first()["text"] == ""
    assert linededup.report(none).count() == 0


def test_sharding(odd, none):
    got = sharding.shard(odd).collect()
    assert len(got) == 12 and {r["law"] for r in got} == {"bytes"}
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and all(0 <= s < 16 for s in places)
    assert {r["size"] for r in got if r["doc_id"] in (3, 4)} == {1} and [r["text_crc32"] for r in got if r["doc_id"] == 3] == [0]
    assert len({r["shard"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert sharding.shard(none).count() == 0


def test_near_duplicates(odd, none):
    got = by_id(minhash.near_duplicates(odd))
    assert got[2][0]["component_id"] == 1 and len(got[2]) == 2 and not got[2][0]["kept"]
    assert got[None][0]["component_id"] is None and got[None][0]["kept"]
    assert (got[3][0]["n_shingles"], got[3][0]["component_id"], got[4][0]["kept"]) == (0, 3, True)
    assert got[7][0]["component_id"] == 6 and got[8][0]["n_shingles"] == 1
    assert minhash.near_duplicates(none).count() == 0


def test_packing(odd, none):
    got = packing.pack(odd, RANKS).collect()
    assert {r["length"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert max(r["length"] + r["offset"] for r in got) <= 1024 and len({r["doc_id"] for r in got}) == 11
    assert packing.pack(none, RANKS).count() == 0


def test_quality(odd, none):
    got = by_id(quality.judge(odd))
    assert got[3][0]["base_failed"] and not got[4][0]["kept"] and got[1][0]["n_words"] == len(SOME.split())
    assert got[9][0]["word_chars"] == len("日本語текстελληνικά")
    assert quality.judge(none).count() == 0 and quality.keep(odd).columns == odd.columns


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (3, "u", "<p>" + "b, " * 200_000), (3, "u", "<p>x")],
                                  "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit(1)})
    got = {(r["page_id"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got == {(1, 0), (2, 0), (None, 1), (3, 599_999), (3, 1)}
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, none, name, stage):
    folder = "/root/testdata/sf0.001"
    out = stage(spark, odd, folder)
    if name != "best_fit_packing":
        assert out.columns == odd.columns
    assert out.count() > 0
    assert stage(spark, none, folder).count() == 0


def test_quality_keeps_columns_of_any_name(spark):
    names = ["__q", "__good", "__text", "__pattern", "__kept", "__failed", "__row", "n_words"]
    text = "The committee met on Tuesday to talk about the plan, and nobody objected to it at the time. " * 4
    df = spark.createDataFrame([(k, f"{k} {text}", *[f"{n}{k}" for n in names]) for k in range(3)], ["doc_id", "text", *names])
    got = {r["doc_id"]: r for r in quality.keep(df).collect()}
    kept = {r["doc_id"] for r in quality.judge(df).collect() if r["kept"]}
    assert set(got) == kept and all(got[k][n] == f"{n}{k}" for k in got for n in names) and list(quality.keep(df).columns) == df.columns


def test_letters_beyond_the_first_planes(spark):
    """Ideographs from U+20000 on are letters: their text has a language."""
    docs = spark.createDataFrame([(k, "これは 日本語 の 文章 です" if k % 2 else "this is some english text", "ja" if k % 2 else "en") for k in range(60)], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, "\U00020000\U00020001\U0002A6D6", None), (2, "123 !?", None)], docs.schema)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(ask, langid.learn(docs)).collect()}
    assert got[1] in ("ja", "en") and got[2] == "und"
