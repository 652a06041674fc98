"""Who speaks: each rule on hand-made rows, and whole runs against a plain version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import attribution as A
from parlance.operators import cast as C
from parlance.operators import evidence as E
from parlance.operators import units as U

MARKED = "book string, run long, id long, para long, tag string, beat string, pfinal string, bare boolean, vocs array<string>, addressee string"
UNITS = "book string, id long, para long, kind string, text string, speaker string"


def plain_run(rows):
    """One run by the rules: tags and beats, vocatives of the line before, final mentions, the two-apart pattern, turn taking."""
    speaker = [r["tag"] or (r["beat"] if r["beat"] not in r["vocs"] else None) for r in rows]
    for k in range(1, len(rows)):
        called = rows[k - 1]["vocs"]
        if speaker[k] is None and called and rows[k]["para"] - rows[k - 1]["para"] in (0, 1, 2) and called[-1] not in rows[k]["vocs"]:
            speaker[k] = called[-1]
    for k, r in enumerate(rows):
        if speaker[k] is None and r["pfinal"] not in r["vocs"]:
            speaker[k] = r["pfinal"]
    sieved = list(speaker)
    head = {}
    for k, r in enumerate(rows):
        head.setdefault(r["para"], k)
    before = None
    while before != speaker:
        before = list(speaker)
        for k, r in enumerate(rows):
            if speaker[k] is not None or not r["bare"]:
                continue
            near = [speaker[head[p]] for p, mid in ((r["para"] - 2, r["para"] - 1), (r["para"] + 2, r["para"] + 1)) if p in head and mid in head]
            speaker[k] = next((s for s in near if s and s not in r["vocs"]), None)
    paired = list(speaker)
    lines: dict = {}
    for s in speaker:
        if s:
            lines[s] = lines.get(s, 0) + 1
    for r in rows:
        for v in [*r["vocs"], *([r["addressee"]] if r["addressee"] else [])]:
            lines.setdefault(v, 0)
    parts, last, out = sorted(lines, key=lambda n: -lines[n]), None, []
    for s, r in zip(speaker, rows):
        to = {*r["vocs"], r["addressee"]}
        if len(parts) > 1 and (s is None or s in to):
            order = [p for p in parts if p not in to] or parts
            s = order[0] if order[0] != last or len(order) == 1 else order[1]
        elif len(parts) < 2 and s is None and last is None and not r["vocs"] and parts:
            s = parts[0]
        out.append(s)
        last = s
    return sieved, paired, out


def test_runs_against_the_plain_version(spark):
    r = random.Random(5)
    rows, want = [], {}
    for run in range(120):
        para, own = r.randint(0, 3), []
        for k in range(r.randint(1, 25)):
            para += r.choice([0, 1, 1, 1, 2])
            name = lambda p: r.choice("ABC") if r.random() < p else None
            vocs = sorted(r.sample("ABCD", r.choice([0, 0, 0, 1, 2])))
            own.append({"book": "b", "run": run, "id": run * 1000 + 3 * k, "para": run * 5000 + para, "tag": name(0.12), "beat": name(0.05), "pfinal": name(0.05), "vocs": vocs, "addressee": r.choice([None, vocs[-1]]) if vocs else None})
        bare = {p: r.random() < 0.8 for p in {q["para"] for q in own}}
        own = [{**q, "bare": bare[q["para"]]} for q in own]
        rows += own
        for q, *s in zip(own, *plain_run(own)):
            want[q["id"]] = tuple(s)
    df = spark.createDataFrame([tuple(q[c.split()[0]] for c in MARKED.split(", ")) for q in rows], MARKED)
    sieved = A.sieves(df)
    paired = A.two_apart(sieved)
    got = [{x["id"]: x["speaker"] for x in t.collect()} for t in (sieved, paired, A.resolve_runs(df))]
    for stage in range(3):
        assert got[stage] == {k: v[stage] for k, v in want.items()}


def test_two_apart_goes_on_to_the_end(spark):
    rows = [("b", 0, k, k, "Ann" if k == 0 else None, True, []) for k in range(40)] + [("c", 0, k, k, None, True, []) for k in range(5)]
    df = spark.createDataFrame(rows, "book string, run long, id long, para long, speaker string, bare boolean, vocs array<string>")
    got = {(x["book"], x["id"]): x["speaker"] for x in A.two_apart(df).collect()}
    assert all(got["b", k] == ("Ann" if k % 2 == 0 else None) for k in range(40)) and all(got["c", k] is None for k in range(5))


def test_vocatives(spark):
    text = {1: "“Ann, come here.”", 2: "I saw Ann Lee yesterday.", 3: "ANN LEE!", 4: "Come, my dear Bo; Ann, too.", 5: "", 6: None, 7: "“Bo?”", 8: "Well—Ann"}
    got = A.vocatives(spark.createDataFrame([("b", k, t) for k, t in text.items()], "book string, id long, text string"), spark.createDataFrame([("b", "Ann Lee"), ("b", "Bo"), ("c", "Cy")], "book string, name string"))
    assert {x["id"]: (x["vocs"], x["addressee"]) for x in got.collect()} == {1: (["Ann Lee"], None), 3: (["Ann Lee"], "Ann Lee"), 4: (["Ann Lee", "Bo"], None), 7: (["Bo"], "Bo"), 8: (["Ann Lee"], None)}


def test_quotes_are_classified(spark):
    tokens = spark.createDataFrame([(1, 10, "PROPN", "NNP"), (1, 11, "PRON", "PRP"), (1, 12, "PROPN", "NNPS"), (1, 7, "NOUN", "NNPS")], "doc_id long, token_id long, pos string, fine_pos string")
    cases = [(1, 10, 10, "Ann", 7), (2, 11, 11, "he", 7), (3, 40, 41, "Ann", 7), (4, None, 10, "Ann", 7), (5, 9, 10, "x", 7), (6, 8, 9, "Bea", 7), (7, 8, 9, "They", 7), (8, 12, 12, "x", None), (9, 7, 7, "Lees", 7)]
    quotes = spark.createDataFrame([(1, q, 1, 8, a, b, p, c) for q, a, b, p, c in cases], "doc_id long, q long, quote_start long, quote_end long, mention_start long, mention_end long, mention_phrase string, char_id long")
    got = {x["q"]: (x["kind"], x["coref"]) for x in A.classify_quotes(quotes, tokens).collect()}
    assert got == {1: ("explicit", 7), 2: ("anaphoric", 7), 3: ("implicit", None), 4: ("implicit", None), 5: ("explicit", 7), 6: ("explicit", 7), 7: ("anaphoric", 7), 8: ("explicit", None), 9: ("anaphoric", 7)}


def test_paragraph_context(spark):
    # paragraph 0: Ann " q q " .   paragraph 1: " q q "   paragraph 2: Ann Bo " q " ran
    token = [(0, k, p) for k, p in enumerate(["PROPN", "NOUN", "NOUN", "PUNCT"])] + [(1, 4 + k, "NOUN") for k in range(2)] + [(1, 6, "PUNCT")] + [(2, 7 + k, "NOUN") for k in range(4)]
    tokens = spark.createDataFrame([(1, p, k, x) for p, k, x in token], "doc_id long, para long, token_id long, pos string")
    quotes = spark.createDataFrame([(1, 1, 0, 1, 2), (1, 2, 1, 4, 5), (1, 3, 2, 9, 9), (1, 4, 9, 90, 91)], "doc_id long, q long, para long, quote_start long, quote_end long")
    mentions = spark.createDataFrame([(1, 0, 0, 0, 1, "PER"), (1, 0, 1, 1, 2, "PER"), (1, 2, 7, 7, 1, "PER"), (1, 2, 8, 8, 2, "PER"), (1, 2, 10, 10, 5, "LOC")], "doc_id long, para long, start_token long, end_token long, coref long, cat string")
    names = spark.createDataFrame([(1, 1, "Ann"), (1, 2, "Bo")], "doc_id long, coref long, name string")
    got = {x["q"]: (x["beat"], x["pfinal"], x["bare"]) for x in A.paragraph_context(tokens, quotes, mentions, names).collect()}
    assert got == {1: ("Ann", "Ann", False), 2: (None, None, True), 3: (None, None, False), 4: (None, None, False)}


def test_reveals_follow_one_another(spark):
    lines = spark.createDataFrame([("b", k, p, s) for k, (p, s) in enumerate([(1, "Cap"), (5, "Cap"), (9, "Cap"), (9, "Tam"), (4, "Tam"), (9, "X")])], "book string, id long, para long, speaker string")
    reveals = spark.createDataFrame([("b", "Cap", "Tam", 5, 1), ("b", "Tam", "Vale", 8, 2)], "book string, alias string, real string, at long, seq long")
    assert [x["who"] for x in U.resolve_at(lines, reveals).orderBy("id").collect()] == ["Cap", "Tam", "Vale", "Vale", "Tam", "X"]
    known = spark.createDataFrame([("b", "X", "Cap"), ("b", "Cap", "Cap")], "book string, name string, display string")
    assert U.resolve_at(lines, reveals, known).where("id = 5").first()["who"] == "Vale"
    assert {(x["a"], x["b"]) for x in C.reveal_pairs(reveals).collect()} == {("Cap", "Vale"), ("Tam", "Vale")}


def test_scene_by_speech_and_by_mention(spark):
    rows = [("b", k, k, "dialogue", "text", "Bo") for k in range(100)]
    rows[10], rows[60] = ("b", 10, 10, "dialogue", "text", "Captain Vale"), ("b", 60, 60, "narration", "Then old Vale’s men came.", "Narrator")
    units = spark.createDataFrame(rows, UNITS)
    moves = units.select("book", "id", F.lit("Captain Vale").alias("name"))
    assert {x["id"] for x in U.in_scene(moves, units, 5).collect()} == {*range(5, 16), *range(55, 66)}
    cast = spark.createDataFrame([("b", "Captain Vale", 1), ("b", "Bo", 9)], "book string, name string, lines long")
    verdicts = spark.createDataFrame([("b", 8, "Captain Vale"), ("b", 90, "Captain Vale"), ("b", 41, "Unknown"), ("b", 9, "keep"), ("b", 11, "Stranger"), ("b", 12, "bo")], "book string, id long, name string")
    got = {x["id"]: x["speaker"] for x in C.reassign(units, verdicts, cast).where("id in (8, 9, 11, 12, 41, 90)").collect()}
    assert got == {8: "Captain Vale", 9: "Bo", 11: "Bo", 12: "Bo", 90: "Bo", 41: "Unknown"}


def test_selections_are_found(spark):
    text = ["The first line of all", "a b", "Second “line” is here now", "short", "x" * 90]
    units = spark.createDataFrame([("b", k, k // 2, "narration", t, "Narrator") for k, t in enumerate(text)], UNITS)
    asked = [
        ("head", 1, "line is here"), ("other page", 0, "line is here"), ("any page", None, "cond line is"), ("short part", None, "hor"), ("two words", None, "t line"), ("one mark", None, "b"),
        ("holds a unit", 2, "so short a thing"), ("holds it anywhere", None, "zz a b zz"), ("nothing", 1, "qqq"), ("nowhere", None, "qqq"), ("blank", 1, " ” "), ("null", None, None), ("long", None, "x" * 80 + "yes"),
    ]
    got = {x["sel_id"]: (x["unit_id"], x["rule"]) for x in U.locate(spark.createDataFrame([(s, "b", p, t) for s, p, t in asked], "sel_id string, book string, para long, sel string"), units).collect()}
    assert got == {
        "head": (2, 1), "other page": (0, 3), "any page": (2, 1), "short part": (3, 1), "two words": (0, 1), "one mark": (1, 1), "holds a unit": (3, 2), "holds it anywhere": (1, 2),
        "nothing": (2, 3), "nowhere": (None, None), "blank": (None, None), "null": (None, None), "long": (4, 1),
    }


@pytest.mark.parametrize("spread", [False, True])
def test_evidence_lines(spark, spread):
    rows = [("b", k, k, "dialogue" if k % 2 else "narration", "text", "Tam" if k % 2 else "Narrator") for k in range(120)]
    put = lambda k, **new: rows.__setitem__(k, tuple(new.get(c.split()[0], v) for c, v in zip(UNITS.split(", "), rows[k])))
    put(60, text="So Tamsin went.")
    put(81, text="Where is Tamsin?")
    put(5, speaker="Tamsin")
    units = spark.createDataFrame(rows, UNITS)
    pairs = spark.createDataFrame([("b", "Tam", "Tamsin"), ("b", "Tam", "Nobody")], "book string, name string, other string")
    got: dict = {}
    for x in E.evidence_lines(units, pairs, 4, spread).collect():
        got.setdefault(x["other"], []).append(x["id"])
    own = [k for k in range(120) if k % 2 and k != 5]
    far = [k for k in own if k > 25]
    want = [59, far[0], far[len(far) // 3], far[2 * len(far) // 3]] if spread else [59, 61, 81, own[0]]
    assert sorted(got["Tamsin"]) == sorted(want) and sorted(got["Nobody"]) == [own[0], own[len(own) // 3], own[2 * len(own) // 3], own[-1]]


def test_pairs_worth_asking(spark):
    cast = spark.createDataFrame([("b", "Ann", 200), ("b", "Annie", 150), ("b", "Bo", 50), ("b", "Bo Lee", 3), ("b", "Cy", 4), ("b", "Cyrus", 40)], "book string, name string, lines long")
    pairs = spark.createDataFrame([("b", "Ann", "Annie", ["nick"]), ("b", "Bo", "Bo Lee", ["narration"]), ("b", "Cy", "Cyrus", ["nick"]), ("b", "Ann", "Bo", ["narration"]), ("b", "Annie", "Bo", ["narration"])], "book string, a string, b string, rules array<string>")
    gone = lambda a, b: spark.createDataFrame([("b", a, b)], "book string, a string, b string")
    got = C.askable_pairs(pairs, cast, gone("Bo", "Ann"), gone("Bo", "Annie"))
    assert [(x["a"], x["b"]) for x in got.collect()] == [("Cy", "Cyrus")]


def test_anchors(spark):
    seen = spark.createDataFrame([("b", "Big", "Pal", 90), ("b", "Big", "Small", 5), ("b", "Big", "Else", 2), ("b", "Small", "Other", 4), ("b", "Small", "Big", 1), ("b", "Near", "Pal", 1), ("b", "Near", "Other", 5), ("b", "Rare", "Other", 2)], "book string, name string, other string, n long")
    pairs = spark.createDataFrame([("b", "Big", n) for n in ("Small", "Near", "Rare")], "book string, a string, b string")
    assert [(x["b"], x["who"]) for x in U.anchor_veto(pairs, seen).collect()] == [("Small", "Pal")]
