"""Each corpus operator on small tables with every odd case, against brute force where there is one."""

from __future__ import annotations

import hashlib
import random
import sys
import time
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from parlance.llm import common, components, language, licences, media, minhash, packing, pieces, quality, sharding, suffixes, toxicity  # noqa: E402


def test_avi_gives_the_bytes_back(spark):
    rows = H.cases()
    got = media.digests(media.to_avi(H.table(spark, rows))).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(b := (t or "").encode()), hashlib.sha256(p := b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))).hexdigest(), zlib.crc32(p[-64:]), len(p)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) for r in got) == want


def test_avi_general_decoder_agrees_with_the_fast_one(monkeypatch):
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (32, media.COLS), dtype=np.uint8)
    frames = media.jpeg_frames(rows)
    head = media.jpeg_header(frames[0])
    fast = media.decode_dc(frames, head)
    monkeypatch.setattr(media, "_flat_lanes", lambda *a: None)
    assert (media.decode_dc(frames, head) == fast).all() and (fast.reshape(-1, media.COLS) == rows).all()


def test_avi_shots_and_clips(spark):
    dark, bright = np.zeros((10, 8, 64), np.uint8), np.full((10, 8, 64), 200, np.uint8)
    begins = media.shots(np.concatenate([dark, bright]), np.zeros(20, int))
    assert np.flatnonzero(begins).tolist() == [0, 10]
    film = media.avi(media.jpeg_frames(np.concatenate([dark, bright]).reshape(-1, 64)), 20 * 512)
    out = media.clips(spark.createDataFrame([(1, bytearray(film))], "doc_id long, media binary")).collect()
    assert [(r["first_frame"], r["end_frame"], r["start_s"]) for r in out] == [(0, 10, 0.0), (10, 20, 0.4)]
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF....WAVE")


def test_broken_media_lose_nothing_else(spark):
    film = media.to_avi(H.table(spark, [(1, "text of a film"), (2, None)])).collect()
    rows = [(1, 14, film[0]["media"]), (2, 0, None), (3, 5, bytearray(b"RIFF....")), (4, 5, bytearray(film[0]["media"][:300])), (5, 0, film[1]["media"]), (6, 0, bytearray(b""))]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r["doc_id"]: r for r in media.digests(df).collect()}
    assert got[1]["payload_sha256"] == hashlib.sha256(b"text of a film" + bytes(50)).hexdigest() and got[5]["payload_bytes"] == 64
    assert all(got[k]["payload_sha256"] is None and got[k]["feature"] is None for k in (2, 3, 4, 6)) and got[2]["media_bytes"] is None and got[3]["media_bytes"] == 8
    assert {r["doc_id"] for r in media.clips(df).collect()} == {1, 5}
    assert media.digests(media.to_avi(H.table(spark, []))).count() == media.clips(media.to_avi(H.table(spark, []))).count() == 0


def test_shots_equal_the_plain_rule():
    r = np.random.default_rng(3)
    images, owner = [], []
    for film in range(6):
        level = 60
        for _ in range(r.integers(1, 40)):
            level = int(r.integers(0, 200)) if r.random() < 0.15 else level
            images.append(np.clip(r.normal(level, 12, (8, 16)), 0, 255).astype(np.uint8))
            owner.append(film)
    want = []
    for k, image in enumerate(images):
        own = [j for j in range(k + 1) if owner[j] == owner[k]]
        bins = [[int((images[j] >> 4 == b).sum()) / 128 for b in range(media.BINS)] for j in own]
        diff = [round(sum(abs(x - y) for x, y in zip(bins[j], bins[j - 1])) / 2, 9) for j in range(1, len(own))]
        back = diff[:-1][-media.BACK :] if diff else []
        mean = sum(back) / len(back) if back else 0.0
        spread = max(sum(d * d for d in back) / len(back) - mean * mean, 0) ** 0.5 if back else 0.0
        want.append(not diff or bool(back) and diff[-1] >= media.FLOOR and diff[-1] > mean + media.SIGMAS * spread)
    assert media.shots(np.stack(images), np.array(owner)).tolist() == want


def test_near_duplicates(spark):
    rows = H.cases()
    got = minhash.near_duplicates(H.table(spark, rows)).collect()
    want = H.near_groups(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(H.table(spark, rows).limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(H.table(spark, rows))
    assert kept.columns == H.table(spark, rows).columns and kept.where("doc_id = 2").count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates_chain_of_edits(spark, monkeypatch, block):
    """Each text is near the next; far ends are not near each other, and no pivot is near all."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = H.words(200, 9).split()
    rows = []
    for k in range(60):
        w = list(base)
        for e in range(k, k + 6):
            w[(e * 3) % 200] = f"edit{e}"
        rows.append((1000 - k, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(H.table(spark, rows)).collect()}
    assert got == H.near_groups(rows)


def test_near_duplicates_of_one_base_by_many_edits(spark, monkeypatch):
    """Copies are near their base, whose id is in the middle, and mostly not near each other."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    r, base = random.Random(6), H.words(200, 21).split()
    rows = [(500, " ".join(base))]
    for k in range(150):
        w = list(base)
        for at in r.sample(range(40), 5):
            w[at * 5] = f"edit{k}x{at}"
        rows.append((k if k % 2 else 1000 + k, " ".join(w)))
    rows += [(2000 + k, H.words(60, 300 + k)) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(H.table(spark, rows)).collect()}
    assert got == H.near_groups(rows)


def test_near_duplicates_recall_of_planted_pairs(spark):
    """2,000 pairs from 0.75 to 0.80, and 500 just below 0.75: every one is told right."""
    rows, linked = [], {}
    for k in range(2500):
        n = 204 + k % 60
        apart = int((n - 4) * 0.25 / 1.75) - k % 6 if k < 2000 else int((n - 4) * 0.25 / 1.75) + 1  # shingles that differ on each side
        w = [f"w{k}x{i}" for i in range(n)]
        other = w[: n - apart] + [f"v{k}x{i}" for i in range(apart)]
        linked[k] = 100 * (n - 4 - apart) >= 75 * (n - 4 + apart)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    assert sum(linked.values()) == 2000
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(H.table(spark, rows)).collect()}
    assert [k for k in linked if (got[2 * k + 1] == 2 * k) != linked[k]] == []


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and all(got[k] == 100 for k in range(101, 140)) and 500 not in got


def test_quality(spark):
    rows = H.cases() + [(20, "the of and " * 5), (21, "# * $ " * 20), (22, "a b c d e f g h i j k l m n o p")]
    got = {r["doc_id"]: r["quality"] for r in quality.score_quality(H.table(spark, rows)).collect()}
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and got[7]["n_words"] == 2
    assert got[12]["n_dup_lines"] == 1 and got[20]["n_repeat_words"] == 15 and got[22]["n_repeat_words"] == 0
    assert got[21]["n_symbols"] == 60 and not got[21]["kept"] and got[11]["n_repeat_words"] == 400
    assert quality.score_quality(H.table(spark, []).select("doc_id", "text")).count() == 0


def test_quality_repeats_against_brute_force(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for k in range(60)]
    for row in quality.score_quality(H.table(spark, rows)).collect():
        w = row["text"].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        assert row["quality"]["n_repeat_words"] == len(covered)


def test_language(spark):
    made = [(k, {"en": "the house and the tree ", "de": "das haus und der baum ", "es": "la casa y el árbol "}[x] * 20, x, "s", 1, "", "", "", 1, 0.5, "", "") for k, x in enumerate(["en", "de", "es"] * 60)]
    docs = spark.createDataFrame(made + [(900, None, "en", "s", 1, "", "", "", 1, 0.5, "", ""), (901, "12 34", None, "s", 1, "", "", "", 1, 0.5, "", ""), (None, "das haus und", "de", "s", 1, "", "", "", 1, 0.5, "", "")], H.SCHEMA)
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [k for k, *_ in made if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k]["lang_pred"] == made[k][2] for k in held) >= 0.95 * len(held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[None]["lang_pred"] == "de"
    assert language.train(docs.limit(0)) is None and language.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_language_of_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "das haus", "de")] * 50 + [(2, "the house", "en"), (3, "la casa", "es"), (4, "x" * 70_000, "zz"), (6, None, "de")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert set(model["names"]) == {x for i, x in ((1, "de"), (2, "en"), (3, "es"), (4, "zz")) if not zlib.crc32(str(i).encode()) % 5 == 0}
    assert language.identify(docs, model).count() == 54 and language.identify(docs.limit(0), model).count() == 0


def test_language_learns_from_long_texts_only(spark):
    """A language whose texts are all longer than the sample's windows is learnt; windows are spread over the whole text."""
    docs = [(i, H.words(40, i), "en") for i in range(60)] + [(100 + i, "qvxj kyzw " * 9000, "qq") for i in range(8)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(table, language.train(table)).collect()}
    assert got == {i: lang for i, _, lang in docs}
    some = language._spread(np.arange(100_000) % 251)
    assert len(some) <= 256 * language.WINDOW * 8 and language._spread(np.zeros(500, np.uint8)) == bytes(500)


def test_language_gradients():
    """One training step moves every weight as the numeric gradient of the loss says."""
    net = language.Network(3, 1)
    r = np.random.default_rng(2)
    x, y = r.integers(1, 256, (4, language.WINDOW)), np.array([0, 1, 2, 1])
    p0 = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss(p):
        pooled = []
        for k in language.WIDTHS:
            z = np.stack([p["e"][x][:, i : i + k].reshape(4, -1) @ p[f"w{k}"] + p[f"b{k}"] for i in range(language.WINDOW - k + 1)], 1)
            pooled.append(np.maximum(z.max(1), 0))
        logits = np.concatenate(pooled, 1) @ p["v"] + p["c"]
        return float(np.mean(np.log(np.exp(logits).sum(1)) - logits[np.arange(4), y]))

    net.step(x, y)
    for name in ("v", "c", "w2", "b3", "w4", "e"):
        slope = net.m[name][0].ravel() / 0.1  # Adam's first moment after one step
        for at in np.argsort(-np.abs(slope))[:3]:
            up, down = ({k: v.copy() for k, v in p0.items()} for _ in range(2))
            up[name].ravel()[at] += 1e-5
            down[name].ravel()[at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - slope[at]) < 1e-3 * max(1, abs(slope[at]))


def test_language_tables_equal_the_convolution():
    net = language.Network(3)
    x = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    byte = net.p["e"][x]
    pooled = []
    for k in language.WIDTHS:
        z = np.stack([byte[:, i : i + k].reshape(5, -1) @ net.p[f"w{k}"] + net.p[f"b{k}"] for i in range(language.WINDOW - k + 1)], 1)
        pooled.append(np.maximum(z.max(1), 0))
    logits = np.concatenate(pooled, 1) @ net.p["v"] + net.p["c"]
    q = np.exp(logits)
    assert np.allclose(language.probabilities(x, net.tables(), net.p), q / q.sum(1, keepdims=True), atol=1e-4)


@pytest.mark.parametrize("hot", [0, 900])
def test_sharding(spark, hot):
    r = random.Random(2)
    rows = [(k, "x" * r.randint(0, 400) + str(k)) for k in range(2000 - hot)] + [(5000 + k, "copy " * 30) for k in range(hot)] + [(None, None), (7, None)]
    docs = H.table(spark, rows).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    got = sharding.histogram_shards(docs, F.col("text"), F.col("size"), 8, 0.02).collect()
    assert len(got) == len(rows)
    total = [sum(x["size"] for x in got if x["shard"] == s) for s in range(8)]
    assert max(total) - min(total) <= 0.05 * sum(total) / 8 + 800
    for s in range(8):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    assert sharding.histogram_shards(docs.limit(0), F.col("text"), F.col("size")).count() == 0


def test_sharding_keeps_small_groups_together(spark):
    rows = [(k, f"text {k // 3}") for k in range(3000)]
    docs = H.table(spark, rows).select("doc_id", "text", F.lit(10).alias("size"))
    got = sharding.histogram_shards(docs, F.col("text"), F.col("size"), 8).groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert got.where("n > 1").count() == 0


def test_licences(spark):
    rows = H.cases() + [
        (30, "Released under the MIT License. mit-license"), (31, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files"),
        (32, "apache LICENSE\nGENERAL public license"), (33, "redistribution and use"),
    ]
    got = {r["doc_id"]: r for r in licences.scan_licences(H.table(spark, rows)).collect()}
    assert (got[30]["n_base"], got[30]["first_word"], got[30]["last_word"], got[30]["labels"]) == (2, 3, 5, "mit")
    assert got[31]["n_base"] == 0 and got[31]["labels"] == "mit" and 0.8 <= got[31]["score"] < 1
    assert got[32]["base_labels"] == "apache,gpl" and got[33]["labels"] == "" and got[4]["n_words"] == 0
    assert licences.scan_licences(H.table(spark, rows)).count() == len(rows)
    assert licences.scan_licences(H.table(spark, [])).count() == 0


def test_licences_find_wrapped_notices(spark):
    texts = dict(licences.TEMPLATES)
    wrap = lambda t, n, lead="": "\n".join(lead + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    rows = [
        (1, wrap(texts["mit"], 13)), (2, "Code here.\n" + wrap(texts["bsd"], 11) + "\nmore"), (3, wrap(texts["mpl"], 10)),
        (4, wrap(texts["bsd"], 3, " * ") + "\n\nend"), (5, wrap(texts["bsd"], 11).replace("\n", "\n\n")), (6, "a\nb\n\nc"), (7, "\n"), (8, None),
        (9, "It was released under the\nsame roof where his license hung."), (10, "It was Released\nunder the MIT License here"),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan_licences(H.table(spark, rows)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("bsd", 1.0), 3: ("mpl", 1.0), 4: ("bsd", 1.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("", 0.0), 8: ("", 0.0), 9: ("", 0.0), 10: ("mit", 1.0)}


def test_pieces_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rows = H.cases() + [(40, "  Hello   world\nx é\t "), (41, "     "), (42, "don't stop-me now!!  1234 \x01"), (43, "a▁b ▁ c"), (44, H.words(20_000, 5)), (45, "x" * 20_000), (46, " the" + " " * 40 + "▁the")]
    rows += [(100 + n, "the" + " " * n + "é" + " " * n + "\n" + " " * n) for n in range(70)]
    coded = pieces.encode_pieces(H.table(spark, rows))
    got = {(r["doc_id"], tuple(r["ids"])) for r in coded.collect()}
    assert got == {(i, tuple(sp.encode(t or ""))) for i, t in rows}
    assert sorted(str((r["doc_id"], r["text"])) for r in pieces.decode_pieces(coded).collect()) == sorted(str((i, (t or "").replace("▁", " "))) for i, t in rows)
    digests = sorted(map(str, pieces.piece_digests(coded).collect()))
    assert digests == sorted(map(str, pieces.encode_digests(H.table(spark, rows)).collect()))
    for r in pieces.encode_digests(H.table(spark, rows)).collect():
        assert r["text_sha256"] in {hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest() for i, t in rows if i == r["doc_id"]}
    assert pieces.encode_digests(H.table(spark, [])).count() == pieces.encode_pieces(H.table(spark, [])).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["text_sha256"] for r in pieces.piece_digests(nothing).collect()} == {hashlib.sha256(b"").hexdigest()}


def test_pieces_of_long_blank_runs_take_little_time():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    text = ("a" + " " * 100_000 + "b").encode()
    began = time.perf_counter()
    ids, _ = pieces.Pieces().encode(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert ids.tolist() == sp.encode(text.decode()) and time.perf_counter() - began < 5


def test_pieces_states_equal_the_merges():
    """The forward states give what the merge rule gives, word by word."""
    r, p = random.Random(8), pieces.Pieces()
    words = sorted({"▁" * r.randint(0, 1) + "".join(r.choice("abehinorst'é.") for _ in range(r.randint(1, 14))) for _ in range(3000)})
    assert [parts for _, parts in p.walk(words)] == [p.merged(w) for w in words]


def test_packing_is_optimal():
    r = random.Random(3)
    for _ in range(40):
        x = sorted(r.sample(range(1, 60), 8))
        n, k = [r.randint(1, 9) for _ in x], r.randint(1, 5)
        waste = lambda edges: sum(c * (min(e for e in edges if e >= v) - v) for v, c in zip(x, n))
        got = packing.best_edges(x, n, k)
        assert len(got) <= k and waste(got) == min(waste({*e, x[-1]}) for m in range(k) for e in combinations(x[:-1], m))
    assert packing.best_edges([], []) == []


def test_packing(spark):
    rows = H.cases() + [(100 + k, "w " * (k % 7 + 1)) for k in range(700)]
    got = packing.pack(H.table(spark, rows), buckets=4, budget=64).collect()
    assert len(got) == len(rows)
    batches: dict = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        assert r["padding"] == (r["bucket_len"] - r["n_tokens"] if r["n_tokens"] else 0) and r["padding"] >= 0
    for (bucket, _), rs in batches.items():
        assert sorted(r["place"] for r in rs) == list(range(len(rs)))
        assert bucket < 0 or len(rs) == 1 or len(rs) * rs[0]["bucket_len"] <= 64
    for b in {k[0] for k in batches}:
        assert sorted(k[1] for k in batches if k[0] == b) == list(range(sum(k[0] == b for k in batches)))
    assert packing.pack(H.table(spark, [])).count() == 0


def test_packing_keeps_lengths_exact_beside_a_very_long_document(spark):
    rows = [(k, "w " * (k % 7 + 1)) for k in range(70)] + [(1000, "w " * 400_000)]
    got = packing.pack(H.table(spark, rows), buckets=8).collect()
    assert sorted({r["bucket_len"] for r in got}) == [*range(1, 8), 400_000]
    assert len(got) == len(rows) and all(r["padding"] == 0 for r in got)


def test_toxicity(spark):
    rows = [(k, H.words(40, k) + (" vile brute" if k % 3 == 0 else "")) for k in range(400)] + [(990, None), (991, ""), (None, "vile")]
    docs = H.table(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(995, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((got[k] >= toxicity.TOXIC) == (k % 3 == 0) for k in held) and got[990] == got[991]
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id = 3").count() == 0 and left.where("doc_id = 4").count() == 1
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def test_ftrl_equals_the_plain_update():
    """Weight by weight, in the order of the passes."""
    r = random.Random(4)
    data = [(np.unique(np.array([r.randint(0, 40) for _ in range(12)], np.int32)), r.randint(0, 1)) for _ in range(120)]
    often = {f: sum(f in x for x, _ in data) for f in range(41)}
    z, n = {}, {}

    def weight(f):
        shrunk = max(abs(z.get(f, 0.0)) - toxicity.L1, 0.0) * (1 if z.get(f, 0.0) > 0 else -1)
        return -shrunk / ((toxicity.BETA + n.get(f, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.PASSES):
        for k in order.permutation(len(data)):
            x, label = data[k]
            x = [f for f in x.tolist() if often[f] >= toxicity.LEAST_DOCS] + ["bias"]
            w = {f: weight(f) for f in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for f in x:
                old = n.get(f, 0.0)
                n[f] = old + g * g
                z[f] = z.get(f, 0.0) + g - (n[f] ** 0.5 - old**0.5) / toxicity.ALPHA * w[f]
    some, values, bias = toxicity.fit(list(data))
    assert abs(bias - weight("bias")) < 1e-9 and some.tolist() == [f for f in range(41) if weight(f) != 0]
    assert np.allclose(values, [weight(f) for f in some.tolist()], atol=1e-6)


def test_toxicity_of_repeated_rows_and_other_ids(spark):
    rows = [(f"d{k % 200}", H.words(40, k % 200) + (" vile brute" if k % 2 else "")) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(200)], "doc_id string, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 600 and sum((r["toxic_score"] >= toxicity.TOXIC) == ("vile" in r["text"]) for r in got) >= 590
    assert toxicity.score_toxicity(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_quality_and_shards_keep_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "own", "q")], "doc_id long, text string, __m long, shard string, quality string")
    row = quality.score_quality(docs).first()
    assert row["__m"] == 5 and row["shard"] == "own" and row["quality"]["n_words"] == 3
    placed = sharding.histogram_shards(docs, F.col("text"), F.lit(3))
    assert sorted(placed.columns) == ["__m", "doc_id", "quality", "shard", "slot", "text"] and placed.first()["slot"] == 0 and placed.first()["__m"] == 5


@pytest.mark.parametrize("common", [50_000, 2])
def test_suffix_dedup(spark, monkeypatch, common):
    monkeypatch.setattr(suffixes, "LEAST_BATCH", 4096)
    monkeypatch.setattr(suffixes, "COMMON", common)
    rows = H.cases() + [(50, "a" * 300), (51, "a" * 60), (52, "xy" * 100 + "b"), (53, "ĩ" + "é" * 60), (54, "xy" * 90)]
    got = suffixes.repeated_spans(H.table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == H.spans(rows)
    left = suffixes.drop_repeated_spans(H.table(spark, rows))
    assert left.columns == H.table(spark, rows).columns and left.count() == len(rows)
    assert suffixes.repeated_spans(H.table(spark, [])).count() == 0


def test_suffix_keys_fill_all_parts_alike():
    data = np.frombuffer(H.words(20_000, 3).encode(), np.uint8)
    keys = np.unique(suffixes._spread(suffixes.smallest_hashes(data)))
    load = np.bincount((keys >> np.uint64(suffixes.KEY_BITS - 4)).astype(int), minlength=16)
    assert load.max() < 1.3 * load.mean() and len(keys) == len(np.unique(suffixes.smallest_hashes(data)))


def test_deep_shallow_sorts_suffixes():
    r = random.Random(1)
    data = bytes(r.choice(b"ab") for _ in range(400)) * 2
    starts = np.arange(len(data) - 60)
    order, group = suffixes.deep_shallow(np.frombuffer(data, np.uint8), starts)
    keys = [data[s : s + 50] for s in starts[order].tolist()]
    assert keys == sorted(keys) and all((keys[k] == keys[k + 1]) == (group[k] == group[k + 1]) for k in range(len(keys) - 1))


def test_cut_uses_the_checkpoint_folder(spark):
    df = common.cut(spark.range(5))
    assert sorted(r["id"] for r in df.collect()) == list(range(5))
    assert str(spark.sparkContext.getCheckpointDir()).removeprefix("file:") in df.inputFiles()[0]
