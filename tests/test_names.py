"""Names that are one character: constrained components and identities, against rules followed link by link."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from parlance.operators import attribution as A
from parlance.operators import cast as C
from parlance.operators import units as U


def plain_groups(lines, same, apart, established=30):
    part = {n: {n} for n in lines}
    for a, b in same:
        both = part[a] | part[b]
        if part[a] is not part[b] and (sum(lines[n] >= established for n in both) > 1 or any(x in both and y in both for x, y in apart)):
            continue
        for n in both:
            part[n] = both
    return {n: max(part[n], key=lambda x: (lines[x], x)) for n in lines}


def grouped(spark, lines, same, apart):
    cast = spark.createDataFrame([("b", n, k) for n, k in lines.items()], "book string, name string, lines long")
    pairs = spark.createDataFrame([("b", a, b, i) for i, (a, b) in enumerate(same)], "book string, a string, b string, seq long")
    differ = spark.createDataFrame([("b", a, b) for a, b in apart], "book string, a string, b string")
    return {x["name"]: x["group"] for x in C.components(cast, pairs, differ).collect()}


def test_a_thousand_names_in_conflict(spark):
    r = random.Random(7)
    names = [f"N{k:04d}" for k in range(1000)]
    lines = {n: r.choice([1, 2, 5, 10, 29, 40]) for n in names}
    same = [tuple(r.sample(names, 2)) for _ in range(1500)]
    apart = [tuple(r.sample(names, 2)) for _ in range(300)]
    assert grouped(spark, lines, same, apart) == plain_groups(lines, same, apart)


def test_the_fold_of_one_part_is_about_linear():
    import pyarrow as pa

    def took(n):
        r = random.Random(1)
        rows = [{"book": "b", "part": "p", "kind": "n", "a": f"N{k}", "b": None, "w": 1, "established": k % 1000 == 0} for k in range(n)]
        rows += [{"book": "b", "part": "p", "kind": "s", "a": f"N{r.randrange(n)}", "b": f"N{r.randrange(n)}", "w": k, "established": False} for k in range(2 * n)]
        rows += [{"book": "b", "part": "p", "kind": "d", "a": f"N{k}", "b": f"N{(k * 7 + 1) % n}", "w": 0, "established": False} for k in range(1, n, 10) if k != (k * 7 + 1) % n]
        t = pa.Table.from_pylist([x for x in rows if x["a"] != x["b"]])
        began = time.perf_counter()
        C._fold_joins(t)
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 30 * took(5_000) + 1


def test_parts_without_conflict_are_not_folded(spark, monkeypatch):
    """A chain of 300 names is one part without any task of its own."""
    lines = {f"N{k:03d}": k % 7 for k in range(300)}
    same = [(f"N{k:03d}", f"N{k + 1:03d}") for k in range(299)]

    def refused(table):
        raise AssertionError("folded")

    monkeypatch.setattr(C, "_fold_joins", refused)
    assert set(grouped(spark, lines, same, []).values()) == {"N293"}
    cast = spark.createDataFrame([("b", "A", 40), ("b", "B", 1), ("c", "A", 1)], "book string, name string, lines long")
    pairs = spark.createDataFrame([("b", "B", "A", 1), ("b", "B", "Nobody", 1), ("b", "A", "A", 1), ("c", "A", "B", 1)], "book string, a string, b string, seq long")
    differ = spark.createDataFrame([("b", "A", "A"), ("b", "A", "Nobody")], "book string, a string, b string")
    assert {(x["book"], x["name"], x["group"]) for x in C.components(cast, pairs, differ).collect()} == {("b", "A", "A"), ("b", "B", "A"), ("c", "A", "A")}
    assert C.components(cast.limit(0), pairs, differ).count() == 0


def test_identities_compare_keys(spark):
    links = [("b", "Marie-Jahns", "Bernard", 1), ("b", "MARIEJAHNS", "Marie Bernard", 2), ("b", "bernard!", "Old Bernard", 3), ("c", "Tam", "TAM", 1), ("c", "…", "Tam", 2), ("c", None, "Vale", 3), ("d", "Ä", "b", 1)]
    got = {(x["book"], x["name"]): x["display"] for x in C.identities(spark.createDataFrame(links, "book string, a string, b string, seq long")).collect()}
    one = ("Marie-Jahns", "MARIEJAHNS", "Marie Bernard", "Bernard", "bernard!", "Old Bernard")
    assert got == {**{("b", n): "Old Bernard" for n in one}, ("c", "Tam"): "Tam", ("c", "TAM"): "Tam", ("c", "Vale"): "Vale", ("d", "b"): "b"}


def test_reveals_compare_keys(spark):
    lines = spark.createDataFrame([("b", k, p, s) for k, (p, s) in enumerate([(1, "the STRANGER"), (9, "The Stranger."), (9, "Tam"), (1, None), (9, "…")])], "book string, id long, para long, speaker string")
    reveals = spark.createDataFrame([("b", "The stranger", "VALE", 5, 1)], "book string, alias string, real string, at long, seq long")
    assert [x["who"] for x in U.resolve_at(lines, reveals).orderBy("id").collect()] == ["The stranger", "VALE", "Tam", None, "…"]
    known = spark.createDataFrame([("b", "vale", "Captain Vale"), ("b", "Captain Vale", "Captain Vale"), ("b", "tam", "Tamsin")], "book string, name string, display string")
    assert [x["who"] for x in U.resolve_at(lines, reveals, known).orderBy("id").collect()] == ["The stranger", "Captain Vale", "Tamsin", None, "…"]


def scene(spark):
    said = [("Tam", "I am here."), ("Tamsin Vale", "And so am I."), ("Orrin", "Who is there?"), ("Tam", "Only me.")]
    rows = [("b", 2 * k, k, "dialogue", t, n) for k, (n, t) in enumerate(said)] + [("b", 2 * k + 1, k, "narration", f"Then Tamsin Vale looked up ({k}).", "Narrator") for k in range(4)]
    units = spark.createDataFrame(rows, "book string, id long, para long, kind string, text string, speaker string")
    return units, U.cast_counts(units)


def test_briefings_hold_what_a_judge_needs(spark):
    units, cast = scene(spark)
    pairs = spark.createDataFrame([("b", "Tam", "Tamsin Vale", ["nick", "narration"])], "book string, a string, b string, rules array<string>")
    (row,) = C.briefings(pairs, units, cast).collect()
    text = row["briefing"].split("\n")
    assert (row["book"], row["a"], row["b"]) == ("b", "Tam", "Tamsin Vale")
    assert text[0].startswith("Cast: ") and all(n in text[0] for n in ("Tam", "Orrin", "Tamsin Vale"))
    assert text[1].startswith("Entry A: Tam (2 lines); shares scenes with ") and text[2].startswith("Entry B: Tamsin Vale (1 lines); shares scenes with ")
    assert text[3] == "Flagged by: nick; narration" and "Excerpts of A:" in text and "Excerpts of B:" in text
    assert any(x.startswith("--- around line 2:") for x in text) and any("And so am I." in x for x in text)
    assert C.briefings(pairs.limit(0), units, cast).count() == 0


def test_line_briefings_show_every_line(spark):
    units, cast = scene(spark)
    suspects = spark.createDataFrame([("b", "Tam", 2), ("b", "Tamsin Vale", 1)], "book string, name string, lines long")
    got = {x["name"]: x["briefing"] for x in C.line_briefings(suspects, units, cast).collect()}
    assert set(got) == {"Tam", "Tamsin Vale"}
    assert [x for x in got["Tam"].split("\n") if x.startswith("--- line")] == ["--- line 0:", "--- line 6:"] and "Suspect entry: Tam (2 lines)" in got["Tam"]
    assert "Only me." in got["Tam"] and [x for x in got["Tamsin Vale"].split("\n") if x.startswith("--- line")] == ["--- line 2:"]


def exploded(df):
    """Columns of the rows that each explode of a plan makes."""
    out, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Generate":
            out.append({node.output().apply(k).name() for k in range(node.output().size())})
    return out


def test_words_find_vocatives_without_the_text(spark):
    quotes = spark.createDataFrame([("b", 1, "Tam, come here now. Tam!"), ("b", 2, "Nobody here."), ("c", 1, "Tam?")], "book string, id long, text string")
    df = A.vocatives(quotes, spark.createDataFrame([("b", "Tam"), ("c", "Orrin")], "book string, name string"))
    assert [tuple(r) for r in df.collect()] == [("b", 1, ["Tam"], None)]
    assert exploded(df) and not any("text" in columns for columns in exploded(df))


def test_words_find_mentions_without_the_text(spark):
    units = spark.createDataFrame([("b", 1, "Then Vale came, Vale of all."), ("b", 2, "No Valen."), ("c", 1, "Vale.")], "book string, id long, text string")
    df = U.mentioned(units, spark.createDataFrame([("b", "Captain Vale"), ("b", "Vale")], "book string, name string"))
    assert sorted(tuple(r) for r in df.collect()) == [("b", "Captain Vale", 1), ("b", "Vale", 1)]
    assert exploded(df) and not any("text" in columns for columns in exploded(df))


def test_keys_of_selections_travel_without_the_text(spark):
    units = spark.createDataFrame([("b", 1, 0, "It was late. Nobody came."), ("b", 1, 1, "Go"), ("b", 2, 2, "Go")], "book string, para long, id long, text string")
    asked = [("s1", "b", None, "was late."), ("s2", "b", None, "Go away now"), ("s3", "b", 2, "not there"), ("s4", "b", None, "nowhere at all"), ("s5", "b", None, "was late.")]
    df = U.locate(spark.createDataFrame(asked, "sel_id string, book string, para long, sel string"), units)
    assert sorted(tuple(r) for r in df.collect()) == [("s1", 0, 1), ("s2", 1, 2), ("s3", 2, 3), ("s4", None, None), ("s5", 0, 1)]
    assert exploded(df) and not any({"__u", "__s", "__text"} & columns for columns in exploded(df))


def test_selections_meet_few_units_and_all_that_hold_them(spark, monkeypatch):
    r = random.Random(5)
    line = lambda n: " ".join("".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = [(b, line(r.choice((1, 2, 3, 9)))) for b in "xy" for _ in range(60)]
    units = spark.createDataFrame([(b, k, k, t) for k, (b, t) in enumerate(texts)], "book string, para long, id long, text string")
    asked = [(f"s{k}", r.choice("xy"), r.choice((None, 3)), r.choice((line(1), line(4), t[r.randrange(len(t)) :][:30], t + " ab"))) for k, (_, t) in enumerate(texts)]

    def plain(book, para, sel):
        sel, own = sel.strip(), [(k, t) for k, (b, t) in enumerate(texts) if b == book]
        rules = [(1, k) for k, t in own if para in (None, k) and sel[:60] in t] + [(2, k) for k, t in own if t in sel] + [(3, k) for k, _ in own if k == para]
        return min(rules)[::-1] if sel and rules else (None, None)

    for few in (64, 0):
        monkeypatch.setattr(U, "_FEW", few)
        got = U.locate(spark.createDataFrame(asked, "sel_id string, book string, para long, sel string"), units).collect()
        assert {x["sel_id"]: (x["unit_id"], x["rule"]) for x in got} == {s: plain(*q) for s, *q in asked}
    same = spark.createDataFrame([("x", f"x{k:03} everywhere y{k:03} z{k:03} w") for k in range(300)], "book string, __part string")
    met = same.select(U._needle(F.col("__part")).alias("n")).groupBy("n").count().agg(F.max("count")).first()[0]
    assert met < 12  # 300 where the longest inner word was the key: parts times texts met


def test_evidence_looks_for_pairs_once(spark, monkeypatch):
    from parlance.plans import cast_plans

    seen, find = [], C.name_pairs
    monkeypatch.setattr(C, "name_pairs", lambda *a: seen.append(a) or find(*a))
    units = [("x", i, i, "dialogue", "Hello.", n) for i, n in enumerate(("Tam", "Tamsin", "Tamsin"))]
    df = spark.createDataFrame(units, "book string, id long, para long, kind string, text string, speaker string")
    cast_plans.evidence(df).collect()
    assert len(seen) == 1
