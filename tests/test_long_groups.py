"""Rules that follow rows in turn, over groups of many blocks, against the plain rules row by row."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import attribution as A
from parlance.operators import ordered
from parlance.operators import units as U
from parlance.operators import voice as O
from parlance.operators.ordered import carried_in_order


def plain_chunks(sizes, most):
    chunk = size = 0
    out = []
    for n in sizes:
        if size >= most:
            chunk, size = chunk + 1, 0
        size += n
        out.append(chunk)
    return out


def test_context_chunks_of_many_blocks(spark):
    r = random.Random(1)
    books = {b: [r.choice([0, 1, 5, 40, 300]) for _ in range(n)] for b, n in (("a", 1500), ("b", 7), ("c", 400))}
    rows = [(b, p, "x" * n) for b, sizes in books.items() for p, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "book string, para long, text string")
    for most in (1, 120, 2000):
        for block in (16, 64, 1 << 16):
            got = {(x["book"], x["para"]): x["chunk"] for x in U.context_chunks(df, most, block).collect()}
            assert got == {(b, p): c for b, sizes in books.items() for p, c in enumerate(plain_chunks(sizes, most))}


def plain_islands(spans, apart, most):
    n, first, end, out = 0, None, None, []
    for s, e in spans:
        if first is None or apart(end, s, e) or e - first > most:
            n, first = n + 1, s
        end = e
        out.append(n)
    return out


RULES = [lambda end, s, e: s - end > 600, lambda end, s, e: e - s >= 900, lambda end, s, e: (s < end) | (s - end > 600), lambda end, s, e: s < s]


@pytest.mark.parametrize("overlap", [False, True])
def test_joined_spans_of_many_blocks(spark, overlap):
    r = random.Random(5)
    clips = {}
    for clip, n in (("a", 900), ("b", 5), ("c", 130)):
        at, spans = 0, []
        for _ in range(n):
            at += r.choice([0, 100, 590, 601, 2000]) if not overlap else r.choice([0, 50, 400])
            dur = r.choice([10, 300, 950, 3000, 15_000]) if r.random() < 0.5 else 200
            spans.append((at, at + dur))
            at += 0 if overlap else dur
        clips[clip] = sorted(set(spans))
    rows = [(c, s, e) for c, spans in clips.items() for s, e in spans]
    df = spark.createDataFrame(rows, "clip string, s_ms long, e_ms long")
    for rule in RULES:
        want = {(c, s, e): i for c, spans in clips.items() for (s, e), i in zip(spans, plain_islands(spans, rule, 14_000))}
        for block in (8, 1 << 16):
            assert {(x["clip"], x["s_ms"], x["e_ms"]): x["island"] for x in O.joined_spans(df, ["clip"], rule, 14_000, block=block).collect()} == want


def plain_turns(rows):
    """The rule with a pair of up to two names and the last speaker."""
    pair, last, out = [], None, []
    for tag, hint in rows:
        if tag is not None:
            if tag not in pair:
                pair = [tag] if last in (None, tag) else [last, tag]
            last = tag
        else:
            if len(pair) == 2 and last in pair:
                who = pair[1] if last == pair[0] else pair[0]
            elif last is None or (hint is not None and hint != last):
                who = hint
            else:
                who = last
            if who is not None and who not in pair:
                pair = [*pair, who][-2:]
            last = who
        out.append(last)
    return out


@pytest.mark.parametrize("names", [2, 3, 9])
def test_turns_of_many_blocks(spark, names):
    r = random.Random(names)
    pick = lambda p: f"N{r.randrange(names)}" if r.random() < p else None
    runs = {1: [(pick(0.15), pick(0.3)) for _ in range(700)], 2: [(None, pick(0.1)) for _ in range(300)], 3: [(pick(0.02), None) for _ in range(300)], 4: [(None, None)] * 40}
    df = spark.createDataFrame([("b", k, i, t, h) for k, rows in runs.items() for i, (t, h) in enumerate(rows)], "book string, run long, id long, tag string, hint string")
    want = {(k * 10_000 + i): w for k, rows in runs.items() for i, w in enumerate(plain_turns(rows))}
    for block in (4, 32, 1 << 16):
        got = A.alternate(df.withColumn("id", F.col("run") * 10_000 + F.col("id")), block).collect()
        assert {x["id"]: x["speaker"] for x in got} == want


def test_run_alternation_of_many_blocks(spark):
    """Blocks of four rows and one block give the same speakers."""
    r = random.Random(3)
    pick = lambda p, n: f"N{r.randrange(n)}" if r.random() < p else None
    rows = []
    for run, n in ((1, 5), (2, 2), (3, 1), (4, 30)):
        for i in range(200):
            rows.append(("b", run, i, pick(0.3, n), [v for v in [pick(0.2, n)] if v], pick(0.15, n)))
    df = spark.createDataFrame(rows, "book string, run long, id long, speaker string, vocs array<string>, addressee string")
    got = [sorted((x["run"], x["id"], x["speaker"] or "") for x in A.alternate_run(df, block).collect()) for block in (4, 1 << 16)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_affine_scan_equals_the_fold(spark):
    r = random.Random(8)
    clips = {"a": 1000, "b": 3, "c": 128, "d": 129}
    levels = {c: [None if r.random() < 0.2 else r.uniform(-60, 0) for _ in range(n)] for c, n in clips.items()}
    levels["d"][:5] = [None] * 5
    levels["e"] = [None] * 4
    want = {}
    for c, row in levels.items():
        g = None
        for i, level in enumerate(row):
            if level is not None:
                new = 10 ** (max(-12.0, min(12.0, -20.0 - level)) / 20)
                g = new if g is None else 0.7 * g + 0.3 * new
            want[c, i] = g
    df = spark.createDataFrame([(c, i, v) for c, row in levels.items() for i, v in enumerate(row)], "clip string, seq long, dbfs double")
    got = {(x["clip"], x["seq"]): x["gain"] for x in O.smooth_gain(df, -20.0).collect()}
    assert got.keys() == want.keys() and all(got[k] is None if w is None else abs(got[k] - w) < 1e-5 for k, w in want.items())
    steps = df.withColumn("b", F.coalesce("dbfs", F.lit(0.0)))
    scanned = {(x["clip"], x["seq"]): x["x"] for x in O.affine_scan(steps, ["clip"], "seq", F.lit(0.5), F.col("b"), F.col("b"), "x", width=4).collect()}
    for c, row in levels.items():
        x = None
        for i, level in enumerate(row):
            x = (level or 0.0) if x is None else 0.5 * x + (level or 0.0)
            assert abs(scanned[c, i] - x) < 1e-9


def test_carried_values_and_overlaps(spark):
    r = random.Random(2)
    rows = [("a" if i % 3 else "b", s := r.randrange(3000), s + r.randrange(60)) for i in range(400)] + [(None, 1, 5), (None, 4, 9)]
    df = spark.createDataFrame(rows, "clip string, s_ms long, e_ms long").repartition(7)
    got = carried_in_order(df, ["clip"], [F.col("s_ms"), F.col("e_ms")], {"top": (F.max, F.col("e_ms")), "low": (F.min, F.col("e_ms")), "n": (F.sum, F.lit(1))}).collect()
    for clip in ("a", "b", None):
        own = sorted((s, e) for c, s, e in rows if c == clip)
        back = sorted((x["s_ms"], x["e_ms"], x["n"] or 0, x["top"], x["low"]) for x in got if x["clip"] == clip)
        assert [x[2] for x in back] == list(range(len(own)))
        for k, x in enumerate(back):
            before = [e for _, e in own[:k]]
            assert (x[3], x[4]) == (max(before), min(before)) if before else (x[3], x[4]) == (None, None)
    want = []
    for clip in ("a", "b", None):
        for s, e in sorted((s, e) for c, s, e in rows if c == clip):
            if want and want[-1][0] == clip and s <= want[-1][2]:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([clip, s, e])
    assert sorted(map(str, (list(x) for x in O.fix_overlaps(df).collect()))) == sorted(map(str, want))


def test_a_long_group_is_many_tasks(spark, monkeypatch):
    """No task of a rule sees more rows than a block holds."""
    df = spark.range(20_000).select(F.lit("b").alias("book"), F.col("id").alias("para"), F.lit("word " * 20).alias("text"))
    seen = []
    real = ordered.in_blocks

    def watched(rows, group, order, fields, replay, effect, follow, block=None):
        def counted(table, state):
            assert table.num_rows <= 512
            return replay(table, state)

        seen.append(1)
        return real(rows, group, order, fields, counted, effect, follow, 512)

    monkeypatch.setattr(U, "in_blocks", watched)
    got = U.context_chunks(df)
    assert seen and got.groupBy("chunk").count().where("chunk < 571 and count <> 35").count() == 0 and got.agg(F.max("chunk")).first()[0] == 20_000 // 35


def test_gains_take_their_order_along(spark):
    df = spark.createDataFrame([(c, s, -30.0 + s) for c in (1, 2) for s in range(5, 50, 3)], "clip long, seq long, dbfs double")
    got = O.smooth_gain(df, -20.0)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x["clip"], x["seq"]) for x in got.collect()) == sorted((x["clip"], x["seq"]) for x in df.collect())


def plain_dominant(m, ids, similarity=0.55):
    """Join the two nearest clusters again and again."""
    if len(m) < 4:
        return set(ids)
    groups = [[k] for k in range(len(m))]
    near = m @ m.T
    while len(groups) > 1:
        mean = {(i, j): near[np.ix_(groups[i], groups[j])].mean() for i in range(len(groups)) for j in range(i)}
        i, j = max(mean, key=mean.get)
        if mean[i, j] < similarity:
            break
        groups[j] += groups.pop(i)
    return {ids[k] for k in max(groups, key=lambda g: (np.linalg.norm(m[g].sum(0)), -min(ids[k] for k in g)))}


def voices(n, dim, seed, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    x = centres[r.integers(0, 5, n)] + r.normal(size=(n, dim)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dominant_clusters_equal_the_plain_rule(spark):
    rows, want = [], set()
    for who, (n, spread) in enumerate(((60, 0.6), (60, 1.0), (40, 0.9), (3, 2.0), (1, 1.0), (50, 0.1))):
        m = voices(n, 12, who, spread)
        ids = [who * 1000 + (k * 37) % 997 for k in range(n)]
        rows += [(who, i, v.tolist()) for i, v in zip(ids, m)]
        want |= {(who, i) for i in plain_dominant(m, ids)}
    df = spark.createDataFrame(rows, "who long, vec_id long, embedding array<double>")
    for block in (8, 4096):
        assert {(x["who"], x["vec_id"]) for x in O.dominant_cluster(df, "who", block=block).collect()} == want
    assert O.dominant_cluster(df.limit(0), "who").count() == 0


def test_linkage_of_five_thousand_vectors():
    m = voices(5000, 64, 1, 0.8)
    began = time.perf_counter()
    label = O.average_linkage(m, 0.55)
    assert time.perf_counter() - began < 10 and len(np.unique(label)) < 5000


def test_running_total_deals_rows_once(spark):
    from parlance.operators.ordered import running_total

    df = spark.createDataFrame([("a", m, k, "x") for m in range(9) for k in range(3)], "g string, major long, minor long, text string")
    got = running_total(df, ["g"], "major", "minor", F.lit(1), "n", block=4)
    assert sorted((r["major"], r["minor"], r["n"]) for r in got.collect()) == [(m, k, 3 * m + k) for m in range(9) for k in range(3)]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 4
