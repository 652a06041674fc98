"""Manifest, nearest vectors and spelling variants against plain versions, with every odd case."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from parlance.llm import merkle, neighbours, queries, spelling  # noqa: E402


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows of the five fields."""

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // 3 * 3
            out.append((level[a:i], level[i + 1 : a + 3]))
            i //= 3
        return out

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, sha(*map(framed, r)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (*_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            whole = path(trees[s], i) + path(top, k)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = sha(*map(framed, (*r[:4], r[4] and r[4].replace("\n", ""))))
            for before, after in whole:
                node = sha(*before, node, *after)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(*[x for b, a in whole for x in b + a]), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows():
    r = random.Random(4)
    texts = [t for _, t in H.cases()]
    rows = [(i, "big", "en", 3, r.choice(texts)) for i in range(1, 400)]
    rows += [(i, None, None, None, "a\nb") for i in range(500, 504)]
    rows += [(7, "one", "de", 1, "x"), (8, "", "de", 1, None), (9, "Ä", "de", 1, "\n"), (10, "Z", "de", 1, "line\nline")]
    return rows + [(601, "rep", "en", 1, "same\n")] * 5 + [(602, "rep", "en", 1, "other"), (602, "rep", "en", 1, "same"), (None, "rep", "en", 1, "no\nid"), (None, "rep", None, 1, None)]


def test_manifest(spark, tmp_path):
    rows = manifest_rows()
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, rank int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_little(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    empty = merkle.verified_manifest(spark.createDataFrame([], schema), F.lit(True), F.lit("x"))
    assert empty.count() == 0 and empty.columns[-1] == "verified"
    one = merkle.verified_manifest(spark.createDataFrame([(1, None, None, None, "x" * 300_000)], schema), F.lit(False), F.col("text")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == sha("1:1", "-", "-", "-", "300000:" + "x" * 300_000) and one["proof_sha256"] == sha() and one["verified"]


def test_node_labels(spark):
    """Every node covers the leaves below it: parents are unions of their children, levels cover all ranks."""
    n = 700
    leaves = spark.createDataFrame([("t", i, sha(str(i))) for i in range(n)] + [("u", 0, sha("u"))], "tree string, rank long, digest string")
    forest = merkle.grow(leaves)
    nodes = collections.defaultdict(dict)
    for r in forest.nodes().collect():
        assert (r["lo"], r["hi"]) not in nodes[r["tree"], r["level"]]
        nodes[r["tree"], r["level"]][r["lo"], r["hi"]] = r["digest"]
    assert {k for k in nodes if k[0] == "u"} == {("u", 0)}
    for level in range(7):
        spans = sorted(nodes["t", level])
        assert spans == [(i, min(i + 3**level, n)) for i in range(0, n, 3**level)]
        if level:
            for lo, hi in spans:
                assert nodes["t", level][lo, hi] == sha(*[d for (a, b), d in sorted(nodes["t", level - 1].items()) if lo <= a and b <= hi])
    assert len(nodes["t", 6]) == 1 and ("t", 7) not in nodes


# ---------------------------------------------------------------- nearest vectors


def plain_nearest(rows, k=10):
    """{query id: sorted [(distance, vec_id)] of all other rows}, for rows of usable vectors."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = collections.defaultdict(list)
    for at in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        out[int(ids[at])].append(sorted((float(a), int(b)) for j, (a, b) in enumerate(zip(d, ids)) if j != at)[:k])
    return out


def vectors(n, seed, dim=24):
    r = np.random.default_rng(seed)
    crowd = r.normal(size=dim)
    near = crowd + r.normal(size=(n // 3, dim)) * 0.02
    rest = r.normal(size=(n - n // 3, dim))
    x = np.concatenate([near, rest])
    return [(i, [float(np.float32(v)) for v in row]) for i, row in zip(r.permutation(n).tolist(), x)]


SCHEMA = "vec_id long, embedding array<float>, label int, cid int, least int, axis int"


def as_table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def recall(got, want):
    mine = collections.defaultdict(dict)
    for r in got:
        mine[r["query_id"]][r["rank"]] = (r["score"], r["vec_id"])
    assert set(mine) == set(want)
    hits = total = 0
    for q, lists in want.items():
        ranks = mine[q]
        assert sorted(ranks) == list(range(1, len(lists[0]) + 1)) and [ranks[i] for i in sorted(ranks)] == sorted(ranks.values())
        hits += len({v for _, v in ranks.values()} & {v for _, v in lists[0]})
        total += len(lists[0])
    return hits / total


@pytest.mark.parametrize("points", [16_384, 150])
def test_nearest_reaches_most_neighbours(spark, monkeypatch, points):
    """With small groups the crowd is cut again around its mean."""
    monkeypatch.setattr(neighbours, "POINTS", points)
    monkeypatch.setattr(neighbours, "PROBES", points)
    rows = vectors(3000, 3)
    got = neighbours.nearest(as_table(spark, rows)).collect()
    assert recall(got, plain_nearest(rows)) >= 0.9
    x = {i: np.array(v) for i, v in rows}
    assert all(r["score"] == pytest.approx(np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum()), abs=1e-12) for r in got[:200])


def test_nearest_blocks_when_cutting_ends(spark, monkeypatch):
    """Groups that stay crowded are dealt into blocks and lose nothing."""
    monkeypatch.setattr(neighbours, "POINTS", 40)
    monkeypatch.setattr(neighbours, "PROBES", 2)
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    rows = vectors(1200, 8)
    assert recall(neighbours.nearest(as_table(spark, rows), keep=1.0).collect(), plain_nearest(rows)) >= 0.97


def test_nearest_odd_rows(spark):
    base = vectors(60, 5, dim=5)
    same = [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(1000, 1400, 20)]  # 20 equal vectors, 4 of them ask
    twice = [(2000, [9.0, 0.0, 0.0, 0.0, 0.0])] * 2 + [(2001, [9.0, 0.0, 0.0, 1.0, 0.0]), (2002, [9.0, 0.0, 1.0, 0.0, 0.0])]
    good = base + same + twice
    bad = [(100, None), (200, []), (300, [0.0] * 5), (400, [1.0, None, 1.0, 1.0, 1.0]), (500, [float("nan")] * 5), (600, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (700, [1.0, 2.0]), (None, [1.0] * 5)]
    got = neighbours.nearest(as_table(spark, good + bad)).collect()
    want = plain_nearest(good)
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(want) and not {100, 200, 300, 400, 500, 600, 700} & set(by)
    for q, lists in want.items():
        assert sorted((s, v) for _, v, s in by[q]) == [pytest.approx(x) for each in [lists[0]] for x in sorted(each * len(lists))]
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0])]
    assert [(r["rank"], r["vec_id"]) for r in sorted(neighbours.nearest(as_table(spark, few)).collect())] == [(1, 1), (2, 2)]
    assert neighbours.nearest(as_table(spark, [])).count() == neighbours.nearest(as_table(spark, [(0, [1.0])])).count() == 0


def test_rotation_keeps_lengths_and_uses_all_axes():
    x = np.random.default_rng(1).normal(size=(4000, 48))
    scores = neighbours.axis_scores(x, 2, 1)
    assert scores.shape == (4000, neighbours.n_axes(48)) and np.allclose((scores[:, :64] ** 2).sum(1), (x * x).sum(1))
    assert len(np.unique(scores.argmax(1))) == neighbours.n_axes(48)
    tall = neighbours.hadamard(np.eye(8))
    assert np.allclose(tall @ tall.T, np.eye(8)) and np.allclose(np.abs(tall), 8**-0.5)


# ---------------------------------------------------------------- spelling variants

FOLD = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows, every=199):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_apart(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def variants_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_variants(spark):
    r = random.Random(2)
    stems = ["".join(r.choice("abéÿz") for _ in range(r.randint(5, 8))) for _ in range(40)]

    def slip(w):
        at, kind = r.randrange(len(w)), r.randrange(3)
        return w[:at] + (r.choice("abéÿz×") if kind else "") + w[at + (kind < 2) :]

    rows = []
    for k in range(300):
        words = [slip(w) if r.random() < 0.1 else w.upper() if r.random() < 0.1 else w for w in r.choices(stems, [3 ** (j % 9) for j in range(40)], k=60)]
        rows.append((k if k % 50 else None, r.choice([" ", ", ", "\n", "1"]).join(words)))
    rows += [(1, None), (2, ""), (3, "1 2 3"), (4, "short"), *[(5, "a" * 30_000 + " " + "a" * 29_999 + "b " + "a" * 29_999)] * 6]
    want = plain_words(rows)
    assert len(want) > 100
    got = variants_of(spelling.variant_groups(H.table(spark, rows), slip_every=199))
    assert got == plain_variants(want) and got["a" * 29_999][3] == 2
    assert spelling.variant_groups(H.table(spark, [])).count() == 0
    assert variants_of(spelling.variant_groups(H.table(spark, rows[:100]))) == plain_variants(plain_words(rows[:100], None))


def test_forms_are_followed_to_the_last(spark):
    """A chain of eight words, each five times as frequent as the one before."""
    words = ["aaaaaaaa", *["b" * k + "a" * (8 - k) for k in range(1, 9)]]
    n = {w: 5 * 5**k for k, w in enumerate(words)}
    df = spark.createDataFrame([(k, w, n[w]) for k, w in enumerate(words)], "id long, word string, n long")
    got = variants_of(spelling.spelling_variants(df))
    assert got == plain_variants(n) and got["aaaaaaaa"][1] == "bbbbbbbb"


def test_trie_numbers_are_those_of_prefixes():
    words = ["abc", "abd", "", "abcab", "b"]
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    nodes = spelling.trie_nodes(letters, starts)
    prefixes = [w[:k] for w in words for k in range(len(w) + 1)]
    number = dict(zip(prefixes, nodes.tolist()))
    assert [number[p] for p in prefixes] == nodes.tolist() and len(set(number.values())) == len(number)
