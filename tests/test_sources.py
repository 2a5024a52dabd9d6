import json

import pytest

from tessera import config, schemas
from tessera.operators.joins import by_provider
from tessera.plans.sync import sync_tables
from tessera.sources import pages, responses, sinks


def body(spark, obj):
    return spark.createDataFrame([("p", obj if isinstance(obj, str) else json.dumps(obj))], "page_id string, json string")


def test_recognisers(spark):
    h, w = responses.plain_words(body(spark, {"duration": 2.5, "text": "a b", "words": [{"word": " a ", "start": 0, "end": 1}, {"word": "b", "start": 1, "end": 2}]}))
    assert h.first().duration == 2.5 and [(r.word, r.confidence) for r in w.orderBy("word_idx").collect()] == [("a", 1.0), ("b", 1.0)]
    h, w = responses.segmented_words(body(spark, {"segments": [{"end": 3.0, "words": [{"text": "a", "start": 0, "end": 1, "confidence": 0.5}, {"text": "b", "start": 1, "end": 2}]}]}))
    assert h.first().duration == 3.0 and [r.confidence for r in w.orderBy("word_idx").collect()] == [0.5, 1.0]
    h, w = responses.scored_words(body(spark, {"segments": [{"text": " oi ", "end": 9, "words": [{"word": "a", "start": 0, "end": 1}, {"word": " ", "start": 1, "end": 2}, {"word": "c", "start": None, "end": 3}]}]}))
    assert (h.first().duration, h.first().full_text) == (1.0, "oi") and [(r.word, r.confidence) for r in w.collect()] == [("a", 0.9)]
    assert responses.plain_words(body(spark, "{}"))[0].first().word_count == 0
    assert responses.provider(None, None, True) == "local" and responses.provider("x", "y") == "x"


def test_annotations(spark, words):
    events, gaps = responses.prosody(body(spark, 'Sure: {"events": [{"type": "odd", "time": 1}], "gap_analyses": [{"gap_start": 1.0}]} done'))
    assert (events.first().event_type, events.first().confidence) == ("phrase_boundary", 0.8)
    assert (gaps.first().recommendation, gaps.first().has_breath) == ("analyze", False)
    c = responses.corrections(body(spark, {"corrections": [{"word_index": 1, "word": "x", "corrected_start": 1, "corrected_end": 2}]})).first()
    assert (c.confidence, c.reason) == (0.8, "")
    df = words({"p": [("a", 0, 1), ("b", 2, 3)]})
    p = responses.post_pause_corrections(body(spark, {"words": [{"index": 1, "start": 1.9}, {"index": None}, {"index": 7}]}), df).collect()
    assert [(r.word_index, r.corrected_start, r.corrected_end, r.confidence) for r in p] == [(1, 1.9, 3.0, 0.85)]
    assert responses.title_checks(body(spark, {"start_time": 0.5})).first().confidence == 0.8
    asked = spark.createDataFrame([("p", 0, "Sol"), ("p", 1, "lua")], "page_id string, ref_idx int, word string")
    m = {r.word: r for r in responses.missing_checks(body(spark, {"verifications": [{"word": "SOL", "start_time": 1.0}, {"word": "sol", "start_time": 2.0}]}), asked).collect()}
    assert (m["Sol"].start_time, m["Sol"].confidence, m["lua"].confidence) == (1.0, 0.8, 0.0)
    assert responses.second_timing(body(spark, {"words": [{"word": "a", "start": 1, "end": 2}]})).first().start == 1.0


def test_providers(spark):
    t = {k: spark.createDataFrame([(p, k) for p in ps], "page_id string, x string") for k, ps in {"one": ["a"], "two": ["a", "b"]}.items()}
    assert {(r.page_id, r.provider) for r in by_provider(t).collect()} == {("a", "one"), ("b", "two")}


def test_pages_on_disk(spark, tmp_path):
    for name, files in {"p-1": ["content/a.wav", "content/z.mp3", "content/texto.txt"], "p-2": ["text.txt"], "p-3": ["x.ogg"]}.items():
        for f in files:
            (tmp_path / name / f).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / f).write_text("\n Título  bom \n\nUm verso\n\nOutro verso aqui ")
    got = {r.page_id: r for r in pages.discover(pages.files(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["p-1", "p-3"] and got["p-1"].audio.endswith("z.mp3") and got["p-1"].text.endswith("texto.txt") and got["p-1"].title == "P 1"
    texts = pages.read_texts(spark, got["p-1"].text).withColumnRenamed("path", "page_id")
    lines = pages.lines_of(texts)
    t = pages.title_lines(lines).first()
    assert (t.title, t.body_start) == ("Título  bom", 2)
    tok = pages.ref_tokens(lines).orderBy("ref_idx").collect()
    assert [r.token for r in tok] == "Título bom Um verso Outro verso aqui".split()
    assert [r.ref_idx for r in tok if r.is_section_start] == [2, 4] and [r.ref_idx for r in tok if r.is_line_end] == [1, 3, 6] and [r.is_title for r in tok].count(True) == 2
    (tmp_path / "c.csv").write_text("﻿Livro;Page ID;Titulo;a;b;c;d;e;f;g;Palavras;KB;Status\n3;p-1;T;x;x;x;x;x;x;x;12;1.5;ok\n", encoding="utf-8")
    assert pages.checklist(spark, str(tmp_path / "c.csv")).first().word_count == 12


def test_result_round_trip(spark, words, tmp_path):
    from pyspark.sql import functions as F

    df = words({"p": [("a", 0, 1.23456), ("b", 2, 3)]}, 0.9).withColumn("line_break_after", F.col("word_idx") == 1)
    docs = sinks.documents(df, spark.createDataFrame([("p", 3.0)], "page_id string, duration double"))
    assert "line_break_after" not in docs.first().json.split("}")[0]
    sinks.write_documents(docs, str(tmp_path / "out"))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "timestamps.json").write_text(docs.first().json)
    back = pages.words_of(pages.results(spark, str(tmp_path / "p" / "timestamps.json"))).orderBy("word_idx").collect()
    assert [(r.page_id, r.word, r.end, r.line_break_after, r.is_title) for r in back] == [("p", "a", 1.235, False, False), ("p", "b", 3.0, True, False)]
    head = spark.createDataFrame([("p", "T<", "t\nx", "livro4.mp3", 65.0, None)], "page_id string, title string, full_text string, audio_file string, duration double, citation string")
    page = sinks.html_pages(sinks.page_context(df, head)).first().html
    assert "T&lt;" in page and "book-4" in page and "1:05" in page and 'data-end="1.235">a </span>' in page and "b </span><br></div>" in page
    uri = spark.range(1).select(sinks.data_uri(F.lit("audio/wav"), F.lit(b"abc")).alias("u")).first().u
    assert uri == "data:audio/wav;base64,YWJj"


def test_settings():
    s = config.settings(config.flattened({"project": {"language": "en"}, "gap_classification": {"micro_max": 40, "unknown": 1}}), {"gaps": {"short_max": 99}})
    assert (s.language, s.gaps.micro_max, s.gaps.short_max, s.gaps.medium_max) == ("en", 40, 99, 400)


def test_sync(spark):
    ref = spark.createDataFrame([("p", i, w, i == 4, i < 2) for i, w in enumerate("Um dois três quatro cinco.".split())], "page_id string, ref_idx int, token string, is_line_end boolean, is_title boolean")
    heard = spark.createDataFrame([("p", k, w, k * 0.5, k * 0.5 + 0.4, 0.9) for k, w in enumerate("um dois quatro cinco".split())], "page_id string, word_idx int, word string, start double, end double, confidence double")
    out = sync_tables(ref, heard, spark.createDataFrame([("p", 2.0)], "page_id string, duration double"))
    w = out["words"].orderBy("word_idx").collect()
    assert [r.word for r in w] == "Um dois três quatro cinco.".split() and w[2].confidence == 0.3 and 0.8 < w[2].start < 1.05
    assert w[4].line_break_after and w[1].is_title and out["quality"].first().word_count == 5
    assert schemas.RESULT
    assert pytest
