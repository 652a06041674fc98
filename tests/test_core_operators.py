"""Unit, voice, attribution, cast and validation operators on small tables."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as X
from parlance.functions.matching import ratios
from parlance.operators import attribution as A
from parlance.operators import cast as C
from parlance.operators import heteronyms as H
from parlance.operators import layout as Y
from parlance.operators import units as U
from parlance.operators import validate as D
from parlance.operators import voice as O
from parlance.operators.ordered import running_total, total_in_order, with_neighbours
from parlance.plans import registry


def test_running_total_and_neighbours(spark):
    r = random.Random(1)
    rows = [(b, k, r.randint(0, 9)) for b in "xy" for k in range(300)]
    df = spark.createDataFrame(rows, "book string, id long, v long")
    got = {(x["book"], x["id"]): x["t"] for x in running_total(df.withColumn("para", F.floor(F.col("id") / 3)), ["book"], "para", "id", F.col("v"), "t", block=7).collect()}
    for b in "xy":
        total = 0
        for _, k, v in [q for q in rows if q[0] == b]:
            assert got[b, k] == total
            total += v
    from pyspark.sql import Window

    near = with_neighbours(df, ["book"], "id", 2, lambda d, p: d.withColumn("s", F.sum("v").over(Window.partitionBy(*p).orderBy("id").rangeBetween(-2, 2))), block=5)
    value = {(b, k): v for b, k, v in rows}
    for x in near.collect():
        assert x["s"] == sum(value.get((x["book"], x["id"] + j), 0) for j in range(-2, 3))


def test_totals_in_any_order(spark):
    r = random.Random(9)
    rows = [(r.choice("xxxxy"), k, r.choice([None, 1, 2, 3]), r.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, v long, k long").repartition(7)
    got = {x["id"]: x["t"] for x in total_in_order(df, ["g"], [F.desc("k"), F.asc("id")], F.col("v"), "t").collect()}
    total: dict = {}
    for g, k, v, _ in sorted(rows, key=lambda x: (-x[3], x[1])):
        assert got[k] == total.get(g, 0)
        total[g] = total.get(g, 0) + (v or 0)


def utterances_plain(spans):
    utts = []
    for s, e in spans:
        if utts and e - utts[-1][0] <= 14000 and s - utts[-1][1] <= 600:
            utts[-1] = (utts[-1][0], e)
        else:
            utts.append((s, e))
    merged = []
    for s, e in utts:
        if merged and e - s < 1000 and e - merged[-1][0] <= 14000:
            merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    return [(max(0, s - 150), e + 250) for s, e in merged if e - s >= 1000]


def test_utterances(spark):
    r = random.Random(3)
    rows, want = [], set()
    for clip in range(6):
        at, spans = 0, []
        for seq in range(120):
            s = at + r.choice([0, 100, 600, 601, 1500])
            at = s + r.choice([200, 300, 900, 1000, 4000, 9000])
            spans.append((s, at))
            rows.append((clip, seq + 1, s, at))
        want |= {(clip, *u) for u in utterances_plain(spans)}
    got = O.utterances(spark.createDataFrame(rows, "clip long, seq long, s_ms long, e_ms long"))
    assert {tuple(x) for x in got.collect()} == want


def test_levels(spark):
    f = spark.createDataFrame([(1, 0, 0.0)] * 4 + [(2, 0, 0.5)] * 2 + [(3, k, v) for k, v in enumerate([0.5, 0.5, 0.001, 0.5])], "clip long, frame long, rms double")
    got = {x["clip"]: x["dbfs"] for x in O.speech_level(f).collect()}
    assert got[1] is None and got[2] is None and abs(got[3] + 6.0206) < 1e-3
    g = O.smooth_gain(spark.createDataFrame([(1, 1, None), (1, 2, -20.0), (1, 3, -26.0), (1, 4, None)], "clip long, seq long, dbfs double"), -20.0)
    assert [x["gain"] for x in g.orderBy("seq").collect()] == [None, 1.0, round(0.7 + 0.3 * 10 ** (6 / 20), 5), round(0.7 + 0.3 * 10 ** (6 / 20), 5)]


def test_segments(spark):
    rows = [("c", 1, 0, 1000, "a", 0.9, "sdh"), ("c", 1, 1500, 3000, "b", 0.5, "voice"), ("c", 1, 4000, 5000, "", 0.7, "sdh"), ("c", 2, 5000, 6000, "d", 0.7, "sdh")]
    got = O.merge_segments(spark.createDataFrame(rows, "character string, episode long, s_ms long, e_ms long, text string, score double, source string")).orderBy("episode", "s_ms").collect()
    assert [(x["s_ms"], x["e_ms"], x["text"], x["score"], x["source"]) for x in got] == [(0, 3000, "a b", 0.5, "voice"), (4000, 5000, "", 0.7, "sdh"), (5000, 6000, "d", 0.7, "sdh")]
    same = spark.createDataFrame([([1.0, 0.0], [0.1, 0.2], 100.0, 2.0, 0.1, 1.0, 1.0, [1.0, 0.0], [0.1, 0.2], 100.0, 2.0, 0.1, 1.0, 1.0), ([1.0, 0.0], [0.0, 0.0], None, 2.0, 0.1, 1.0, 1.0, [0.0, 1.0], [0.0, 0.0], 100.0, 2.0, 0.1, 1.0, 1.0)],
        ", ".join(f"{p}_{c}" for p in "rc" for c in ("embed array<double>", "ltas array<double>", "f0_med double", "f0_iqr double", "pause double", "rate double", "burst double")))
    assert [x["score"] for x in O.match_scores(same).collect()] == [1.0, 0.4]


def test_dominant_cluster(spark):
    rows = [(1, k, [1.0, 0.02 * k]) for k in range(5)] + [(1, 9, [0.0, 1.0]), (2, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])]
    unit = [(w, k, [x / sum(y * y for y in v) ** 0.5 for x in v]) for w, k, v in rows]
    got = {(x["who"], x["vec_id"]) for x in O.dominant_cluster(spark.createDataFrame(unit, "who long, vec_id long, embedding array<double>"), "who").collect()}
    assert got == {(1, k) for k in range(5)} | {(2, 1), (2, 2)}


def alternate_plain(quotes):
    pair, last, out = [], None, []
    for tag, hint in quotes:
        if tag:
            if tag not in pair:
                pair = [last, tag] if last and last != tag else [tag]
            who = tag
        else:
            other = (pair[0] if pair[1] == last else pair[1]) if len(pair) == 2 and last in pair else None
            who = other or ((hint if hint and hint != last else last) if last else hint)
            if who and who not in pair:
                pair = (pair + [who])[-2:]
        last = who
        out.append(who)
    return out


def test_alternate(spark):
    r = random.Random(2)
    rows, want = [], {}
    for run in range(40):
        q = [(r.choice([None, None, "A", "B", "C"]), r.choice([None, "A", "D"])) for _ in range(12)]
        for k, (who, (tag, hint)) in enumerate(zip(alternate_plain(q), q)):
            rows.append(("b", run, run * 100 + k, tag, hint))
            want[run * 100 + k] = who
    got = A.alternate(spark.createDataFrame(rows, "book string, run long, id long, tag string, hint string")).collect()
    assert {x["id"]: x["speaker"] for x in got} == want


def test_tags(spark):
    rows = [("b", 1, "", " said Tamsin, softly"), ("b", 2, "then Orrin asked, ", ""), ("b", 3, "", ", Orrin Vale replied."), ("b", 4, "", "said Nobody"), ("b", 5, None, None)]
    got = A.tag_speakers(spark.createDataFrame(rows, "book string, id long, before string, after string"), spark.createDataFrame([("b", "Tamsin Vale"), ("b", "Orrin")], "book string, name string"))
    assert {x["id"]: x["tag"] for x in got.collect()} == {1: "Tamsin", 2: "Orrin", 3: "Orrin Vale", 4: None, 5: None}


def test_layout_units(spark):
    words = ["“Run!”", "said", "Mr.", "Vale.", "He", "ran.", "\"", "Odd", "one\"", "“unclosed", "speech"]
    df = spark.createDataFrame([(words,)], "w array<string>").select(Y.units_of(F.col("w")).alias("u"))
    assert [tuple(x) for x in df.first()["u"]] == [("dialogue", "Run!"), ("narration", "said Mr. Vale."), ("narration", "He ran."), ("dialogue", "Odd one"), ("dialogue", "unclosed speech")]
    rows = [("b", 1, 0, l, 0, x, y, x + 9.0, y + 10.0, "w") for l, (x, y) in enumerate([(50.0, 0.0), (50.0, 12.0), (70.0, 24.0), (50.0, 36.0), (50.0, 80.0)])] + [("b", 1, 1, 0, 0, 50.0, 92.0, 59.0, 102.0, "w"), ("b", 1, 1, 0, 1, 60.0, 92.0, 69.0, 102.0, " ")]
    got = Y.paragraphs(spark.createDataFrame(rows, "book string, page long, block long, line long, wno long, x0 double, y0 double, x1 double, y1 double, word string"))
    assert [x["para"] for x in got.orderBy("block", "line").collect()] == [0, 0, 1, 1, 2, 3]


def test_units_of_words_equal_the_fold(spark):
    r = random.Random(12)
    pick = lambda: r.choice(["a", "Mr.", "end.", "\"", "“", "”", "“so", "so”", "\"so", "so\"", "\"so\"", "“so”", "no.”", "«x»", "'tis", "e.g.", "why?)", "\"\""])
    rows = [("b", page, 0, line, wno, 50.0 + wno, line * 12.0, 51.0 + wno, line * 12.0 + 10, pick()) for page in range(150) for line in range(r.randint(1, 4)) for wno in range(r.randint(1, 9))]
    df = spark.createDataFrame(rows, "book string, page long, block long, line long, wno long, x0 double, y0 double, x1 double, y1 double, word string")
    got: dict = {}
    for x in Y.units(df).orderBy("page", "para", "n").collect():
        assert x["n"] == len(got.setdefault((x["page"], x["para"]), []))
        got[x["page"], x["para"]].append((x["kind"], x["text"]))
    placed = Y.layout_words(df).join(Y.paragraphs(df), ["book", "page", "block", "line"])
    words = placed.groupBy("page", "para").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "wno", "word"))), lambda w: w["word"]).alias("w"))
    want = {(x["page"], x["para"]): [tuple(u) for u in x["u"]] for x in words.select("page", "para", Y.units_of(F.col("w")).alias("u")).collect()}
    assert {k: v for k, v in want.items() if v} == got


def test_cast_resolution(spark):
    cast = spark.createDataFrame([("b", "Tamsin", 120), ("b", "Tam", 20), ("b", "Captain Vale", 40), ("b", "Tamsin Vale", 5), ("b", "Orrin", 50), ("b", "Old Orrin", 3)], "book string, name string, lines long")
    grams = spark.createDataFrame([("b", "tamsin", "vale", 6, "Tamsin Vale")], "book string, first string, last string, n long, surface string")
    pairs = {(x["a"], x["b"]): x["rule"] for x in C.name_pairs(cast, grams).collect()}
    assert pairs == {("Tam", "Tamsin"): "nick", ("Captain Vale", "Tamsin Vale"): "surname", ("Captain Vale", "Tamsin"): "bigram", ("Tamsin", "Tamsin Vale"): "bigram", ("Old Orrin", "Orrin"): "title"}
    same = spark.createDataFrame([("b", "Tam", "Tamsin", 1), ("b", "Tamsin", "Orrin", 2), ("b", "Old Orrin", "Orrin", 3), ("b", "Tam", "Tamsin Vale", 4)], "book string, a string, b string, seq long")
    apart = spark.createDataFrame([("b", "Tamsin Vale", "Tamsin")], "book string, a string, b string")
    got = {x["name"]: x["group"] for x in C.components(cast, same, apart).collect()}
    assert got["Tam"] == got["Tamsin"] == "Tamsin" and got["Old Orrin"] == "Orrin" and got["Tamsin Vale"] == "Tamsin Vale"
    links = spark.createDataFrame([("b", "a", "b"), ("b", "b", "c"), ("b", "c", "d"), ("b", "x", "y"), ("b", "y", "x"), ("b", "q", "he")], "book string, alias string, name string")
    chain = {x["alias"]: x["final"] for x in C.resolve_aliases(links).collect()}
    assert (chain["a"], chain["b"], chain["c"]) == ("d", "d", "d") and "q" not in chain and chain["x"] == "y"


def test_long_chains_and_cycles_of_aliases(spark):
    links = [("b", f"N{k}", f"N{k + 1}") for k in range(100)] + [("c", "A", "B"), ("c", "B", "C"), ("c", "C", "A"), ("c", "T", "A"), ("c", "S", "T")]
    got = {(x["book"], x["alias"]): x["final"] for x in C.resolve_aliases(spark.createDataFrame(links, "book string, alias string, name string")).collect()}
    assert all(got["b", f"N{k}"] == "N100" for k in range(100))
    assert {n: got["c", n] for n in "ABCST"} == {"A": "C", "B": "A", "C": "B", "T": "C", "S": "C"}


def test_identities_keep_every_link(spark):
    links = [("b", "A", "B", 1), ("b", "A", "C", 2), ("c", "A", "C", 1), ("c", "A", "B", 2), ("d", "A", "B", 1), ("d", "B", "A", 2)] + [("e", f"N{k}", f"N{k + 1}", k) for k in range(100)]
    got: dict = {}
    for x in C.identities(spark.createDataFrame(links, "book string, a string, b string, seq long")).collect():
        got.setdefault((x["book"], x["display"]), set()).add(x["name"])
    assert got == {("b", "C"): set("ABC"), ("c", "B"): set("ABC"), ("d", "B"): set("AB"), ("e", "N100"): {f"N{k}" for k in range(101)}}


def test_casting_falls_back(spark):
    units = spark.createDataFrame([("b", 0, 1, "narration", "t", "Narrator"), ("b", 1, 1, "dialogue", "t", "Tam"), ("b", 2, 1, "dialogue", "t", "Orrin"), ("b", 3, 1, "dialogue", "t", "Unknown")], "book string, id long, para long, kind string, text string, speaker string")
    casting = spark.createDataFrame([("b", "narrator", "n", 0.4), ("b", "Tam", "t", None), ("b", "Orrin", None, 0.9), ("b", "Unknown", None, None)], "book string, role string, voice string, exaggeration double")
    got = {x["id"]: (x["voice"], x["exaggeration"], x["cfg_weight"], x["temperature"], x["seed"]) for x in U.cast_lines(units, casting).collect()}
    assert got == {0: ("n", 0.4, 0.5, 0.8, None), 1: ("t", 0.5, 0.5, 0.8, None), 2: (None,) * 5, 3: ("n", 0.4, 0.5, 0.8, None)}


def test_ratios_equal_the_plain_ones():
    r, pairs = random.Random(1), []
    for _ in range(400):
        a = "".join(r.choice("abcde fghi"[: r.randint(1, 10)]) for _ in range(r.choice([0, 1, 5, 30, 100, 250, 400])))
        b = list(a)
        for _ in range(r.randint(0, 8)):
            b[r.randint(0, len(b)) : r.randint(0, len(b))] = r.choice(["x", "zz", "é", "\U0001f600", ""])
        pairs.append((a, "".join(b)))
    for frequent in (True, False):
        want = [difflib.SequenceMatcher(None, a, b, frequent).ratio() for a, b in pairs]
        assert ratios([a for a, _ in pairs], [b for _, b in pairs], frequent).tolist() == want
    assert ratios([], []).tolist() == []


def test_speaking_again_until_it_passes(spark):
    good = {"one two": 0, "three four five six seven.": 2}
    chunks = spark.createDataFrame([(1, 0, "one two"), (1, 1, "three four five six seven."), (1, 2, "left side of all; the right side of it"), (1, 3, "tiny"), (1, 4, "unsplittable" * 3)], "doc_id long, chunk_idx long, text string")

    def attempt(todo):
        rows = [(*x, k, 0.5 + 0.1 * (k == 1), good.get(x["text"], 9) <= k) for x in todo.select("doc_id", "chunk_idx", "path", "text").collect() for k in range(4)]
        return spark.createDataFrame(rows, "doc_id long, chunk_idx long, path string, text string, attempt int, score double, ok boolean")

    got = {(x["chunk_idx"], x["path"]): (x["text"], x["attempt"], x["ok"]) for x in D.speak(chunks, attempt).collect()}
    assert got == {
        (0, ""): ("one two", 0, True), (1, ""): ("three four five six seven.", 2, True), (2, "0"): ("left side of all;", 1, False), (2, "1"): ("the right side of it", 1, False),
        (3, ""): ("tiny", 1, False), (4, ""): ("unsplittable" * 3, 1, False),
    }


def test_respelling(spark):
    docs = spark.createDataFrame([(1, "Read the LEAD; lead, read. Unread."), (2, None), (3, "nothing here"), (4, "wind")], "doc_id long, text string")
    hits = {(x["doc_id"], x["hit_no"]): (x["start"], x["end"], x["word"]) for x in H.heteronym_hits(docs).collect()}
    assert hits == {(1, 0): (0, 4, "read"), (1, 1): (9, 13, "lead"), (1, 2): (15, 19, "lead"), (1, 3): (21, 25, "read"), (4, 0): (0, 4, "wind")}
    choices = spark.createDataFrame([(1, 0, "red"), (1, 1, "led"), (1, 3, "reed"), (1, 9, "x"), (4, 0, "wined"), (4, 0, "winned"), (5, 0, "x")], "doc_id long, hit_no int, say string")
    assert {x["doc_id"]: x["text"] for x in H.respell(docs, choices).collect()} == {1: "Red the LED; lead, reed. Unread.", 2: None, 3: "nothing here", 4: "wined"}


def test_dataset_rows_are_numbered(spark):
    rows = [("v", k, 0, d, t, p) for k, (d, t, p) in enumerate([(2000, "a|b ", 0.5), (900, "short", 0.5), (2000, " ", 0.5), (2000, "silent", 0.0), (14500, "last", 0.5)])]
    got = O.dataset_rows(spark.createDataFrame(rows, "voice string, seq long, s_ms long, e_ms long, text string, peak double"), block=2)
    assert [(x["utt_id"], x["text"]) for x in got.orderBy("utt_id").collect()] == [("v_0001", "a b"), ("v_0002", "last")]
    levels = spark.createDataFrame([("v", "reference", -20.0, True), ("v", "a", -30.0, False), ("w", "a", -30.0, False), ("w", "b", -10.0, False), ("x", "reference", None, True), ("x", "a", -5.0, False)], "voice string, clip string, dbfs double, is_reference boolean")
    assert {x["voice"]: x["dbfs"] for x in O.voice_level(levels).collect()} == {"v": -20.0, "w": -20.0, "x": -5.0}


def test_resuming(spark):
    units = spark.createDataFrame([("b", k, k // 2, "dialogue" if k % 3 else "narration", "t", "S") for k in range(10)], "book string, id long, para long, kind string, text string, speaker string")
    before = spark.createDataFrame([("b", 1, "Ann", True), ("b", 2, None, True), ("b", 4, "Bo", False)], "book string, id long, speaker string, attr boolean")
    now = U.carry_over(units, before)
    assert {x["id"]: x["speaker"] for x in now.where("attr").collect()} == {1: "Ann", 2: "Unknown"}
    chunks = units.select("book", "para", F.floor(F.col("para") / 2).alias("chunk")).distinct()
    assert sorted(x["id"] for x in U.pending(now, chunks, 50).collect()) == [4, 5, 7] and sorted(x["id"] for x in U.pending(now, chunks, 1).collect()) == []


def test_scores_are_of_comparison_forms(spark):
    rows = [("Hello, there!", "hello there"), ("In 1984.", "in one thousand nine hundred eighty four"), ("…", ""), (None, "x"), ("winned it", "wind it")]
    df = spark.createDataFrame(rows, "w string, h string")
    score = [x["score"] for x in D.similarity(df, "w", "h").collect()]
    assert score[0] == 1.0 and score[3] is None and score[4] == 1.0
    plain = [x["score"] for x in D.similarity(df, "w", "h", form=None).collect()]
    assert plain[0] == difflib.SequenceMatcher(None, *rows[0]).ratio()
    told = [(x["ok"], x["score"]) for x in D.faithful(df, "w", "h").collect()]
    assert told[1] == (True, 1.0) and told[0] == (True, 1.0) and told[2] == (True, 1.0) and told[3] == (None, None)


def test_letters_bound_the_ratio(spark):
    r = random.Random(4)
    rows = [("".join(r.choice("etaoinxyzé ") for _ in range(r.randint(0, 60))), "".join(r.choice("etaoinxyzé ") for _ in range(r.randint(0, 60)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    for x in df.withColumn("c", D.letter_ceiling(F.col("a"), F.col("b"))).withColumn("l", D.ceiling(F.col("a"), F.col("b"))).collect():
        assert difflib.SequenceMatcher(None, x["a"], x["b"], False).ratio() <= x["c"] + 1e-12 and x["c"] <= x["l"] + 1e-12
    scored = D.similarity(df, "a", "b", 0.6, None).collect()
    for x in scored:
        exact = difflib.SequenceMatcher(None, x["a"], x["b"]).ratio()
        assert (x["score"] >= 0.6) == (exact >= 0.6) and (x["score"] < 0.6 or abs(x["score"] - exact) < 1e-12)


def test_units_deal_words_by_page_once(spark):
    rows = [(b, p, k // 4, k // 2, k % 2, 50.0 + k % 2, 14.0 * k, 85.0, 14.0 * k + 10, w) for b in ("x", None) for p in (1, 2) for k, w in enumerate('He said, "Go on." And "now"? Then he went off.'.split())]
    df = spark.createDataFrame(rows, "book string, page long, block long, line long, wno long, x0 double, y0 double, x1 double, y1 double, word string")
    for got, most in ((Y.units(df), 1), (Y.paragraphs(df), 2)):
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= most
        assert {x["book"] for x in got.collect()} == {"x"}


def test_given_forms_and_letters_give_the_same_scores(spark):
    r = random.Random(9)
    text = lambda: "".join(r.choice("etaoinsrhlmé,' A") for _ in range(r.choice((5, 40, 190, 420))))
    rows = [(t, t if k % 4 == 0 else t.replace("en", "an").replace("t", "x", k % 3) if k % 4 < 3 else text()) for k, t in enumerate(text() for _ in range(120))] + [(None, "a"), ("a", None), ("", "")]
    df = spark.createDataFrame(rows, "w string, h string").withColumns({"f": X.compare_form(F.col("w")), "n": X.norm_words(F.col("w"))})
    got = {(x["w"], x["h"]): x["score"] for x in D.similarity(df, "h", "w", 0.85, formed={"w": "f"}).collect()}
    forms = {(x["w"], x["h"]): (x["hf"], x["f"]) for x in df.withColumn("hf", X.compare_form(F.col("h"))).collect()}
    for key, (a, b) in forms.items():
        exact = None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()
        assert got[key] == exact if exact is None or exact >= 0.85 else exact <= got[key] < 0.85 or got[key] == exact
    plain, given = (sorted(map(str, D.faithful(df, "w", "h", formed=f).select("w", "h", "score", "ok").collect())) for f in (None, {"w": "n"}))
    assert plain == given


def test_respelled_rows_are_the_sql_ones(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "lİve İ WİND wİnd"), (None, "Lead wind LEAD"), (5, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["text"] for x in registry.queries()["txt_respell"](spark, str(tmp_path)).collect()}
    assert got == {3: "liv İ WİND wined", None: "Leed wind LED", 5: "none"}
    hits = {(x["doc_id"], x["word"], x["says"] is None) for x in registry.queries()["seg_heteronym"](spark, str(tmp_path)).collect()}
    assert hits == {(3, "live", False), (3, "wind", False), (None, "lead", False), (None, "wind", False)}


def test_scores_under_a_floor_are_exact(spark, tmp_path):
    r = random.Random(11)
    text = lambda n: "".join(r.choice("etaoinsrhlm ") for _ in range(n))
    long = [text(n) for n in (1, 12, 150, 199, 200, 260, 900)] + ["ab" * 300, "a" * 250]
    rows = [(t, t[: k * len(t) // 4]) for t in long for k in range(5)] + [(text(30), text(n)) for n in (0, 5, 30, 90, 400)] + [("abcdefgh", "hgfedcba")]
    rows += [(b, a) for a, b in rows]
    df = spark.createDataFrame(rows, "w string, h string")
    for x in D.similarity(df, "w", "h", 0.85, None).collect():
        assert x["score"] == difflib.SequenceMatcher(None, x["w"], x["h"]).ratio()
    for x in D.faithful(df, "w", "h").withColumns({"a": X.norm_words(F.col("w")), "b": X.norm_words(F.col("h"))}).where("a <> ''").collect():
        assert x["score"] == difflib.SequenceMatcher(None, x["a"], x["b"]).ratio()
    spark.createDataFrame([(1, "s", "enen en,en")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {x["cand_idx"]: x["score"] for x in registry.queries()["val_similarity"](spark, str(tmp_path)).collect()}
    assert score == {k: round(difflib.SequenceMatcher(None, h, "enen enen").ratio(), 5) for k, h in enumerate(("enen enen", "anan anan", "enen"))}


def test_targets_of_takes_are_formed_once(spark, tmp_path):
    spark.createDataFrame([(1, "s", "It has 12 dezzurts.\nGone")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("val_similarity", "val_faithful"):
        got = registry.queries()[name](spark, str(tmp_path))
        takes = got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode", 1)
        assert "regexp_replace" in takes[1] and takes[0].count("regexp_replace(") < 2 * takes[1].count("regexp_replace(")
        assert got.count() == 6


def test_books_and_references(spark):
    units = spark.createDataFrame([(b, i, i, "dialogue", "t", n) for b in "abcd" for i, n in enumerate(("Zoe", "Al", "Zoe", "narrator", "Bo", "Al", "Al"))], "book string, id long, para long, kind string, text string, speaker string")
    runs = spark.createDataFrame([("a", False, 100, 0), ("b", True, 100, 0), ("c", False, 60, 0)], "book string, stopped boolean, percent int, failed int")
    assert {(x["book"], x["complete"]) for x in U.coverage(units, F.lit(True), runs).collect()} == {("a", True), ("b", False), ("c", False), ("d", False)}
    casting = spark.createDataFrame([("a", "Al", "v")], "book string, role string, voice string")
    names = lambda order: [x["name"] for x in U.cast_sheet(units, casting, order).where("book = 'a'").orderBy("place").collect()]
    assert [names(o) for o in U.SHEET_ORDERS] == [["Al", "Zoe", "Bo"], ["Bo", "Zoe", "Al"], ["Zoe", "Al", "Bo"], ["Al", "Bo", "Zoe"], ["Al", "Bo", "Zoe"], ["Zoe", "Bo", "Al"]]
    clips = spark.createDataFrame([("v", 1, 20_000, "b", 24), ("v", 2, 30_000, "a", 24), ("v", 3, 50_000, "c", 16), ("v", 4, 9_000, "aa", None), ("v", 5, 9_000, "d", 24)], "clip string, seq long, dur_ms long, name string, rate int")
    got = [(x["seq"], x["before_ms"], x["take_ms"]) for x in O.reference_plan(clips, 45_000, 45_000, "name").orderBy("before_ms").collect()]
    assert got == [(2, 0, 30_000), (1, 30_000, 15_000)]
    texts = spark.createDataFrame([(1, 1, "x" * 100), (1, 2, ""), (1, 3, "y" * 130), (1, 4, "z" * 140), (2, 1, ""), (3, 1, "w" * 500)], "k long, n long, text string")
    assert {x["k"]: x["passage"] for x in O.passages(texts, "k", "n").collect()} == {1: "y" * 130 + " " + "x" * 100, 2: "", 3: "w" * 400}


def test_validation(spark):
    rows = [("a" * 10, "a" * 10), ("abcd", "abxd"), ("ab" * 150, "c" + "ab" * 150), ("x", "y" * 50)]
    got = D.similarity(spark.createDataFrame(rows, "t string, w string"), "t", "w").collect()
    assert [round(x["score"], 6) for x in got] == [round(difflib.SequenceMatcher(None, a, b).ratio(), 6) for a, b in rows]
    cands = spark.createDataFrame(
        [(1, 1, 0, 1, 2000, 5.0, 0.9, 1, "t"), (1, 1, 1, 1, 2000, 4.0, 0.86, 1, "t"), (1, 2, 0, 1, 2000, 4.0, 0.9, 2, "longest"), (1, 2, 1, 1, 10, 1.0, 1.0, 2, "t")],
        "doc_id long, chunk_idx long, cand_idx long, attempt long, bytes long, duration double, score double, round int, transcript string",
    )
    gated = D.gate(cands)
    best = {x["chunk_idx"]: (x["cand_idx"], x["passed"]) for x in D.select_best(gated).collect()}
    assert best == {1: (1, True), 2: (0, False)}
    assert [x["chunk_idx"] for x in D.retry_queue(gated, 3).collect()] == [2]
    ok = D.faithful(spark.createDataFrame([("", "x"), ("hello there", "hello there"), ("hello", "completely other")], "w string, h string"), "w", "h").collect()
    assert [x["ok"] for x in ok] == [True, True, False]


def test_centroids_keep_the_sign_of_small_values(spark):
    rows = [(1, [1.0, -1e-6, 1e-6, 0.0])]
    got = O.centroids(spark.createDataFrame(rows, "k long, embedding array<float>"), "k").first()["embedding"]
    assert [str(x) for x in got] == ["1.0", "-0.0", "0.0", "0.0"]


def test_excerpts_without_a_join(spark):
    units = spark.createDataFrame([("b", k, "X", f"t{k}" + "." * 200) for k in (0, 1, 5)], "book string, id long, speaker string, text string")
    df = U.excerpts(units, spark.createDataFrame([("b", 1), ("b", 3), ("b", 9), ("c", 0)], "book string, id long"), 2)
    line = lambda k: f"X: t{k}" + "." * 98
    assert {r["centre"]: r["excerpt"] for r in df.collect()} == {1: f"   {line(0)}\n>> {line(1)}", 3: f"   {line(1)}\n   {line(5)}"}
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()  # seven rows for each unit met in one


def test_transcripts_join_chunks_where_they_are(spark):
    there = lambda rows, schema: spark.createDataFrame(rows, schema).repartition("doc_id", "chunk_idx")
    takes = there([(1, 0, 0, "a"), (1, 0, 1, "a"), (1, 1, 0, "b"), (None, 0, 0, "c")], "doc_id long, chunk_idx long, cand_idx long, target string")
    heard = there([(1, 0, 0, "x"), (1, 0, 0, "y"), (1, 0, 1, None), (None, 0, 0, "z"), (7, 0, 0, "w")], "doc_id long, chunk_idx long, cand_idx long, transcript string")
    df = D.with_transcripts(takes, heard)
    assert df.columns == ["doc_id", "chunk_idx", "cand_idx", "target", "transcript"]
    got = sorted((r[0] or 0, *r[1:]) for r in df.collect())
    assert got == [(0, 0, 0, "c", ""), (1, 0, 0, "a", "x"), (1, 0, 0, "a", "y"), (1, 0, 1, "a", ""), (1, 1, 0, "b", "")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "cand_idx" in x.split("ENSURE")[0].split("[plan_id")[0]]
