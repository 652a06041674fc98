"""Sources and sinks."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from parlance.plans import registry
from parlance.sources import files as S
from parlance.sources.tables import scratch


def test_texts(spark, tmp_path):
    for name, text in (("b.txt", "two"), ("a.txt", "one\nline")):
        (tmp_path / name).write_text(text)
    got = S.read_texts(spark, str(tmp_path)).orderBy("base").collect()
    assert [(r["base"], r["text"]) for r in got] == [("a", "one\nline"), ("b", "two")]
    assert S.read_texts(spark, str(tmp_path), merge=True).first()["text"] == "one\nline\n\ntwo"


def test_nlp_and_dictionary(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('token_id\tword\n0\t"\n1\tHi\nx\tyo\n')
    assert [tuple(r) for r in S.read_nlp(spark, str(tmp_path / "t.tsv"), ("token_id",)).collect()] == [(0, '"'), (1, "Hi"), (None, "yo")]
    (tmp_path / "d.json").write_text('{"Wind": [["a", "b", "winned"], ["c", "d", "wined"]]}')
    assert [tuple(r) for r in S.heteronyms(spark, str(tmp_path / "d.json")).collect()] == [("wind", 1, "a", "b", "winned"), ("wind", 2, "c", "d", "wined")]
    assert S.heteronyms(spark).count() == 44


def test_words_keep_all_their_characters(spark, tmp_path):
    texts = ["", " ", "\n", "a\rb c\r", "\x0bq \x1fz\x1c", "\x00x\x00", '"" "a', "\\a\\ #b", "doc_id token_id word", "end ", "wa\xdf\u2028x\x85", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["src_nlp_tsv"](spark, str(tmp_path)).collect()
    want = [(k, i, w) for k, t in enumerate(texts) if t is not None for i, w in enumerate(re.split("[ \n\t]+", t))]
    assert sorted(tuple(r) for r in got) == want
    (tmp_path / "two").mkdir()
    for name, rows in (("a", "0\t\tx"), ("b", "1\t\x85"), ("c", "")):
        (tmp_path / "two" / name).write_bytes(f"k\tw\tv\r\n{rows}\r\n".encode())
    got = S.read_nlp(spark, str(tmp_path / "two"), ("k",)).where("k is not null")
    assert got.columns == ["k", "w", "v"] and sorted(tuple(r) for r in got.collect()) == [(0, "", "x"), (1, "\x85", None)]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = registry.queries()["src_nlp_tsv"](spark, f"{tmp_path}/none")
    assert got.columns == ["doc_id", "token_id", "word"] and got.count() == 0


def test_settings(spark):
    df = spark.createDataFrame([('{"temperature": "0.9", "candidates": "many"}',), ("{bad",), (None,)], "s string").select(S.load_settings(F.col("s")).alias("m"))
    got = [tuple(r) for r in df.select(*S.coerce_settings(F.col("m"))).collect()]
    assert got == [(0.5, 0.5, 0.9, 3), (0.5, 0.5, 0.75, 3), (0.5, 0.5, 0.75, 3)]


def test_datasets(spark, tmp_path):
    rows = spark.createDataFrame([("v", "v_0001", " a|b "), ("w", "w_0001", "c")], "voice string, utt_id string, text string")
    S.write_dataset(rows, str(tmp_path / "out"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out" / "voice=v")).collect())
    assert lines == ["v_0001|a b|a b"]
    clips = spark.createDataFrame([("u1",)], "utt_id string")
    assert [tuple(r) for r in S.read_dataset(spark.createDataFrame([("u1|x|x",), ("u1",), ("u2|y|y",)], "row string"), clips).collect()] == [("u1", "x")]


def test_manifests(spark, tmp_path):
    runs = spark.createDataFrame([(1, "secret text", ["a.wav", "b.wav"], 0.5, None), (2, None, [], None, "x,y")], "run_id long, prompt string, files array<string>, temperature double, note string")
    S.write_manifest(runs, str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out" / "csv")).orderBy("run_id").collect()
    assert [(r["run_id"], r["prompt"], r["files"], r["temperature"], r["note"]) for r in rows] == [("1", None, "a.wav|b.wav", "0.5", None), ("2", None, None, None, "x,y")]
    lines = {r["run_id"]: r.asDict() for r in spark.read.json(str(tmp_path / "out" / "json")).collect()}
    assert lines[1] == {"run_id": 1, "prompt": "", "files": "a.wav|b.wav", "temperature": 0.5, "note": None}


def test_cut_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(session, "cut")


def test_texts_that_cannot_be_read_are_passed_over(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.txt").write_text("eins über", encoding="utf-8")
    (tmp_path / "one" / "broken.txt").write_bytes(b"\xff\xfe\x00 no text")
    (tmp_path / "one" / "empty.txt").write_text("")
    paths = [str(tmp_path / "one"), str(tmp_path / "nowhere"), str(tmp_path / "gone.txt")]
    got = {r["base"]: r["text"] for r in S.read_texts(spark, paths).collect()}
    assert got == {"a": "eins über"}
    marked = {r["base"]: (r["text"], r["readable"]) for r in S.read_texts(spark, paths, marked=True).collect()}
    assert marked == {"a": ("eins über", True), "broken": (None, False)}
    assert S.read_texts(spark, paths[1:]).count() == 0 and S.read_texts(spark, paths[1:], merge=True).count() == 0


def test_dictionary_falls_back(spark, tmp_path):
    (tmp_path / "broken.json").write_text("{no json")
    (tmp_path / "list.json").write_text("[1, 2]")
    built_in = S.heteronyms(spark).count()
    assert [S.heteronyms(spark, str(tmp_path / n)).count() for n in ("broken.json", "absent.json")] == [built_in] * 2


def test_analysis_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "stored")
    units = spark.createDataFrame([("k1", 0, "a"), ("k1", 1, "b"), ("k2", 0, "c")], "book_key string, id long, text string")
    assert S.stored_analysis(spark, path) is None and S.not_stored(units, path).count() == 3
    S.write_analysis(units.where("book_key = 'k1'"), path)
    files = sorted(p.name for p in (tmp_path / "stored").rglob("*.parquet"))
    S.write_analysis(units.where("book_key = 'k1'"), path)
    assert sorted(p.name for p in (tmp_path / "stored").rglob("*.parquet")) == files
    assert [r["book_key"] for r in S.not_stored(units, path).collect()] == ["k2"]
    S.write_analysis(units, path)
    assert sorted((r["book_key"], r["id"], r["text"]) for r in S.stored_analysis(spark, path).collect()) == [("k1", 0, "a"), ("k1", 1, "b"), ("k2", 0, "c")]


def test_progress_ends_with_the_book(spark):
    log = spark.createDataFrame([("a", 1, 1, 0, 5, False), ("a", 2, 2, 0, 9, True), ("b", 1, 3, 3, 0, True), ("b", 2, 4, 0, 0, None), ("c", 1, 5, 7, 2, False)], "book string, ts long, event_id long, start long, at long, over boolean")
    assert {(r["book"], r["unit"]) for r in S.progress(log, F.col("over")).collect()} == {("b", 0), ("c", 8)}
