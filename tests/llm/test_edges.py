"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, exact_dedup, language_id, ngram_join, pii, sentencepiece_codec, sharding, substring_dedup, url_filter, wavelet

DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, size string, hash string, group string, shard string, id string, set string"
EN = "the quick brown fox jumps over the lazy dog and then the old cat sleeps in the warm sun while it rains on the other side of the hill "
DE = "der schnelle braune Fuchs springt über den faulen Hund und dann schläft die alte Katze in der warmen Sonne während es regnet "
LONG = EN * 3000


def rows():
    clash = ("a", "b", "c", "d", "e", "f", "g", "h")
    return [
        (1, EN, "en", "s", len(EN), *clash),
        (2, EN, "en", None, None, *clash),
        (2, EN, "en", None, None, *clash),
        (None, DE, "de", "s", 3, *clash),
        (None, None, None, None, None, *(None,) * 8),
        (4, "", "en", "s", 0, *clash),
        (5, "   \n ", None, "s", 5, *clash),
        (6, LONG, "en", "s", len(LONG), *clash),
        (7, "12345 !!", "de", "s", 8, *clash),
        (8, DE + "Ende.", "de", "s", 8, *clash),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, EN), (2, None), (3, "too short"), (None, DE), (5, EN)], "item_id long, text string")


def test_encode(docs, empty):
    out = {(r["doc_id"], r["n_tokens"]): r for r in sentencepiece_codec.encode(docs).collect()}
    assert len(out) == 9 and sentencepiece_codec.encode(docs).count() == 10
    assert sentencepiece_codec.encode(docs).where("ids IS NULL").count() == 1
    assert out[4, 0]["ids"] == [] and all(r["exact"] for r in out.values() if r["exact"] is not None)
    assert sentencepiece_codec.encode(empty).count() == 0
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs))
    assert sorted((r["text"] or "") for r in back.collect()) == sorted((r[1] or "") for r in rows())
    assert back.where("text IS NULL").count() == 1


def test_pii(docs, empty, spark):
    out = pii.sanitise(docs)
    assert out.count() == 10 and out.where("text IS NULL").count() == 1
    assert sorted(r["text"] or "" for r in out.collect()) == sorted(r[1] or "" for r in rows())
    assert pii.sanitise(empty).count() == 0
    long = spark.createDataFrame([(1, LONG + "write to a.b@c.org now")], "doc_id long, text string")
    assert pii.sanitise(long).first()["text"].endswith("write to [EMAIL] now")


def test_language(docs, empty):
    model = language_id.fit(docs)
    out = language_id.identify(docs, model).collect()
    assert len(out) == 10
    assert {(r["doc_id"], r["accepted"]) for r in out if r["doc_id"] in (4, 5, 7)} == {(4, False), (5, False), (7, False)}
    assert all(r["lang"] == "en" and r["accepted"] for r in out if r["doc_id"] in (1, 2, 6))
    assert language_id.fit(empty) is None and language_id.identify(empty, None).count() == 0
    assert not any(r["accepted"] for r in language_id.identify(docs, None).collect())
    kept = language_id.keep_accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 6
    assert language_id.keep_accepted(docs, None).count() == 6


def test_sharding(docs, empty):
    out = sharding.shard(docs, min_shards=3).collect()
    assert len(out) == 10 and sharding.shard(empty).count() == 0
    assert len({r["shard"] for r in out if r["group"] == next(x["group"] for x in out if x["doc_id"] == 1)}) == 1
    assert sharding.shard(docs, group=F.col("source"), min_shards=2).count() == 10


def test_urls(spark):
    html = "<p>cheap pills for sale, casino and games</p>"
    ddl = "page_id long, url string, html string, words string, host string"
    pages = spark.createDataFrame(
        [(1, "http://cheap-pills.example.org/a", html, "x", "y"), (None, None, None, None, None), (3, "", html, "x", "y"), (3, "not a url", html, "x", "y"), (3, "not a url", html, "x", "y"), (5, "https://u:p@Host.example.org:80/" + "long/" * 3000, html, "x", "y")],
        ddl,
    )
    out = {(r["page_id"], r["host"]): r for r in url_filter.filter_pages(pages).collect()}
    assert url_filter.filter_pages(pages).count() == 6
    assert out[1, "cheap-pills.example.org"]["category"] == "pharmacy" and out[1, "cheap-pills.example.org"]["blocked"]
    assert out[None, None]["category"] == "clean" and out[3, None]["words"] == "" and (5, "host.example.org") in out
    assert url_filter.filter_pages(spark.createDataFrame([], ddl)).count() == 0


def test_exact(docs, empty):
    out = exact_dedup.copies(docs, block_bytes=64).collect()
    assert len(out) == 10 and sum(r["is_kept"] for r in out) == 8
    assert {r["n_copies"] for r in out if r["id"] in (1, 2)} == {3} and {r["keep_id"] for r in out if r["id"] == 2} == {1}
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == 8 and kept.where("doc_id = 2").count() == 0
    assert exact_dedup.keep_first(empty).count() == 0 and exact_dedup.copies(empty).count() == 0


def test_substrings(docs, empty):
    out = substring_dedup.duplicate_spans(docs, min_words=20).collect()
    assert {r["doc_id"] for r in out} == {2, 6, None} and substring_dedup.duplicate_spans(empty).count() == 0
    assert {r["ref_doc_id"] for r in out if r["doc_id"] is None} == {8} and all(r["end_word"] - r["start_word"] <= len(EN.split()) for r in out if r["doc_id"] == 6)


def test_near(docs, empty):
    out = ngram_join.similar_documents(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out), key=str) == sorted([(1, 1, 3), (2, 1, 3), (2, 1, 3), (6, 1, 3), (8, 8, 1), (None, 8, 1), (None, None, 0), (4, 4, 0), (5, 5, 0), (7, 7, 0)], key=str)
    assert ngram_join.similar_documents(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 2
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0 and kept.where("lang = 'de' AND doc_id = 8").count() == 1
    assert ngram_join.keep_one(empty).count() == 0


def test_wavelet(docs, empty):
    out = wavelet.write_shards(docs, shard_tokens=60).collect()
    files = [wavelet.WaveletFile(bytes(r["file"])) for r in out]
    tokenizer = wavelet.tokenizer(wavelet.read_ranks())
    texts = [tokenizer.decode(f.tokens()[(f.ends[k - 1] if k else 0) : f.ends[k]].tolist()) for f in files for k in range(len(f.ends))]
    assert sorted(texts) == sorted(r[1] or "" for r in rows())
    assert sum(len(r["doc_ids"]) for r in out) == 10 and wavelet.write_shards(empty).count() == 0


def test_contamination(docs, empty, benchmark, spark):
    out = decontaminate.contaminated_spans(docs, benchmark).collect()
    assert {r["item_id"] for r in out if r["doc_id"] == 1} == {1, 5} and {r["doc_id"] for r in out} == {1, 2, 6}
    assert sum(r["doc_id"] == 2 for r in out) == 4
    one = decontaminate.contaminated_spans(docs, benchmark, max_pattern_words=200).collect()
    assert sorted(map(str, one)) == sorted(map(str, out))
    nothing = spark.createDataFrame([], benchmark.schema)
    assert decontaminate.contaminated_spans(docs, nothing).count() == 0 and decontaminate.contaminated_spans(empty, benchmark).count() == 0
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 6 and decontaminate.drop_contaminated(docs, nothing).count() == 10


def test_stages(docs, empty, benchmark, tmp_path, spark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, empty):
        frame.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        current = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, current, str(tmp_path))
            assert out.columns == docs.columns, name
            out.count()
        final = corpus_pipeline.run(spark, str(tmp_path))
        assert final.columns == ["doc_id", "n_tokens", "ids", "exact"]
        # Of what is left, EN is in the benchmark and its copies with it; one of the German pair stays.
        assert [r["doc_id"] for r in final.collect()] == ([8] if frame is docs else [])
