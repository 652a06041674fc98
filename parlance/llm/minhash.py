"""Near-duplicate detection: b-bit MinHash signatures, band candidates, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut, portions, utf8
from parlance.llm.components import components

#: Bands, minima in a band, low bits kept of each minimum.
BANDS, IN_BAND, LOW_BITS = 32, 4, 2
MINIMA = BANDS * IN_BAND
#: Similarity asked for, in hundredths, and words in a shingle.
SIMILAR, SHINGLE = 75, 5
#: Candidates under this estimate are not confirmed: 4.8 standard errors of 128 two-bit minima below 0.75.
ESTIMATE = 0.53
#: The same bound as a count of minima whose low bits differ.
MOST_APART = int(MINIMA * (1 - 2.0**-LOW_BITS) * (1 - ESTIMATE))
#: Ids up to this many are sent to all executors to pick the candidates' texts; more are joined.
BROADCAST_IDS = 1_000_000
#: Words whose hash a task remembers.
REMEMBERED = 250_000
#: Documents in a block that is compared with another, and shingles in it, about.
BLOCK, IN_BLOCK = 512, 1 << 20

_random = np.random.default_rng(20240229)
_TIMES = _random.integers(1 << 62, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
_FLIPS = _random.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, known: _Words) -> np.ndarray:
    """Hashes of a text's distinct shingles, in order; with fewer words, of the one short sequence."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ _mix(w[i : n - k + 1 + i])
    return np.unique(_mix(h))


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands, low): set hashes, band keys and packed low bits of minima.

    Text without words has no set: its keys are null. A task holds one portion of texts at
    a time.
    """

    def work(batches):
        known = _Words()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in portions(offsets, 1 << 20):
                sets = [shingles(data[offsets[r] : offsets[r + 1]].tobytes(), known) for r in range(i, j)]
                size = np.array([len(s) for s in sets])
                some = np.flatnonzero(size)
                n = j - i
                keys, bands, low = np.zeros((2, n), np.uint64), np.zeros((n, BANDS), np.uint64), np.zeros((n, 4), np.uint64)
                if len(some):
                    x = np.concatenate(sets)
                    starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                    keys[0, some] = np.add.reduceat(x, starts)
                    keys[1, some] = np.add.reduceat(_mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                    minima = np.empty((MINIMA, len(some)), np.uint64)
                    for k in range(MINIMA):
                        minima[k] = np.minimum.reduceat((x ^ _FLIPS[k]) * _TIMES[k], starts)
                    minima >>= np.uint64(32)
                    for b in range(BANDS):
                        h = np.full(len(some), b + 1, np.uint64)
                        for m in minima[b * IN_BAND : (b + 1) * IN_BAND]:
                            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + m)
                        bands[some, b] = h
                    for plane in range(LOW_BITS):
                        bit = (minima >> np.uint64(plane)) & np.uint64(1)
                        for half in range(2):
                            own = bit[64 * half : 64 * half + 64] << np.arange(64, dtype=np.uint64)[:, None]
                            low[some, 2 * plane + half] = np.bitwise_or.reduce(own, axis=0)
                none = size == 0
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(size), pa.array(keys[0].view(np.int64), mask=none), pa.array(keys[1].view(np.int64), mask=none), lists(bands), lists(low)],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "low"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, n_shingles long, k1 long, k2 long, bands array<long>, low array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two packed signatures, corrected for chance matches of the low bits."""
    apart = F.lit(0)
    for half in range(2):
        differ = F.get(x, half).bitwiseXOR(F.get(y, half)).bitwiseOR(F.get(x, 2 + half).bitwiseXOR(F.get(y, 2 + half)))
        apart = apart + F.bit_count(differ)
    chance = 2.0**-LOW_BITS
    return (1 - apart / MINIMA - chance) / (1 - chance)


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text) of some documents, one row each."""
    ids = cut(ids)
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return cut(texts.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    pairs = cut(pairs)
    own = _texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), texts)
    rows = pairs.join(own.toDF("a", "ta"), "a").join(own.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def work(batches):
        known, sets = _Words(), {}

        def of(key, text):
            if key not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[key] = shingles(text.encode(), known)
            return sets[key]

        for batch in batches:
            a, b, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for r in range(len(a)):
                x, y = of(a[r], batch.column(2)[r].as_py()), of(b[r], batch.column(3)[r].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    kind = pairs.schema["a"].dataType.simpleString()
    return cut(rows.mapInArrow(work, f"a {kind}, b {kind}"))


def _placed(reps: DataFrame, shares: DataFrame) -> DataFrame:
    """reps (rep, c, g) dealt into pairs of blocks (g, i, j), i <= j, with `low_side` and `high_side`.

    A cluster g has `others` blocks of its smaller components and then `inside` blocks of
    its largest one, whose members hang together already: those meet the others only.
    """
    dealt = reps.join(shares, "g")
    pick = lambda n: F.pmod(F.xxhash64("rep"), n)
    own = F.when(F.col("c") == F.col("top"), F.col("others") + pick(F.col("inside"))).otherwise(pick(F.greatest("others", F.lit(1).cast("long"))))
    dealt = dealt.withColumn("own", own)
    last = F.when(F.col("own") < F.col("others"), F.col("others") + F.col("inside")).otherwise(F.col("others"))
    dealt = dealt.where(last > 0).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select("g", i.alias("i"), j.alias("j"), "rep", "c", (F.col("own") == i).alias("low_side"), (F.col("own") == j).alias("high_side"))


def _compared(rows: pa.Table) -> pa.Table:
    """Links (a, b) that join components of a pair of blocks: estimates first, then full sets.

    A link joins its two components here too, so at most one link for each component
    leaves, however many pairs there are.
    """
    kind = rows.schema.field("rep").type
    rep, comp = rows.column("rep"), np.unique(rows.column("c").to_numpy(), return_inverse=True)[1]
    low_side, high_side = np.asarray(rows.column("low_side")), np.asarray(rows.column("high_side"))
    low = np.array(rows.column("low").to_pylist(), np.int64).view(np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(code.max()) + 1, bool)
    ys = np.flatnonzero(high_side)
    a, b = [], []
    for k in np.flatnonzero(low_side).tolist():
        meets = ys[comp[ys] != comp[k]]
        differ = (low[meets, :2] ^ low[k, :2]) | (low[meets, 2:] ^ low[k, 2:])
        meets = meets[np.bitwise_count(differ).sum(1) <= MOST_APART]
        if not len(meets):
            continue
        at = code[ends[k] - size[k] : ends[k]]
        mark[at] = True
        both = np.array([np.count_nonzero(mark[code[ends[y] - size[y] : ends[y]]]) for y in meets.tolist()])
        mark[at] = False
        for y in meets[100 * both >= SIMILAR * (size[k] + size[meets] - both)].tolist():
            if comp[y] != comp[k]:
                a.append(k)
                b.append(y)
                comp[comp == comp[y]] = comp[k]
    return pa.table({"a": rep.take(pa.array(a, pa.int64())), "b": rep.take(pa.array(b, pa.int64()))}, schema=pa.schema([("a", kind), ("b", kind)]))


def _across(open_: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a band, found in pairs of blocks; no pair becomes a row.

    open_ holds (key, rep, c, low_c): the classes of bands with several components. Components
    that hang together by such bands form a cluster, and only its classes in these bands
    are compared, with a signature first and on full sets where that is close enough.
    """
    reps = open_.select("rep", "c").distinct()
    clusters = components(open_.where("c <> low_c").select(F.col("c").alias("a"), F.col("low_c").alias("b")).distinct())
    reps = cut(reps.join(clusters.toDF("c", "g"), "c").join(classes.select("rep", "n_shingles", "low"), "rep"))
    sizes = reps.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    top = sizes.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "c", "s")).alias("t"))
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / IN_BLOCK))
    shares = top.select("g", "top", blocks(F.col("t.n"), F.col("t.s")).alias("inside"), blocks(F.col("n") - F.col("t.n"), F.col("s") - F.col("t.s")).alias("others"))
    own = _texts_of(reps.select(F.col("rep").alias("doc_id")), texts)

    def hashed(batches):
        known = _Words()
        for batch in batches:
            sets = [shingles(t.as_py().encode(), known).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    sets = own.select("doc_id", "text").mapInArrow(hashed, f"rep {kind}, shingles binary").join(reps.select("rep", "low"), "rep")
    rows = _placed(reps.select("rep", "c", "g"), shares).join(sets, "rep")
    return cut(rows.groupBy("g", "i", "j").applyInArrow(_compared, f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate groups over all documents.

    Texts with equal shingle sets form a class, known by its smallest id. Classes that
    share a band are candidates. First each is paired with the smallest class of each of
    its bands, so a group of m copies costs m pairs a band, not m squared; pairs whose
    packed signatures estimate ESTIMATE or more are confirmed on full sets. Then bands that
    still hold several components are looked at again in pairs of blocks, with the same
    estimate and the same confirmation inside a task. No candidate is capped: skipped pairs
    join classes that are linked already.

    Null and blank texts have no shingles and stand alone; a null id stays null and is
    kept. A doc_id names one document: rows that repeat it get the same component. Empty
    tables give empty results, and other columns are not read.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = cut(sketches(texts))
    keyed = made.where("k1 is not null and doc_id is not null")
    classes = cut(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands", "low"), "doc_id").alias("s")).select("k1", "k2", "rep", "s.n_shingles", "s.bands", "s.low"))
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = cut(banded.join(shared, "key"))
    low = classes.select("rep", "low")
    stars = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stars.join(low.toDF("a", "la"), "a").join(low.toDF("b", "lb"), "b")
    links = _confirmed(stars.where(estimate(F.col("la"), F.col("lb")) >= ESTIMATE).select("a", "b"), texts)
    comp = components(links)

    mine = cut(members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c")))
    mixed = mine.groupBy("key").agg(F.min("c").alias("low_c"), F.max("c").alias("high_c")).where("low_c <> high_c").select("key", "low_c")
    more = _across(cut(mine.join(mixed, "key")), classes, texts)
    merged = components(
        more.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    )
    first = classes.select("k1", "k2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    final = cut(first.join(merged.toDF("c", "cc"), "c", "left").select("k1", "k2", F.coalesce("cc", "c").alias("component_id")))
    alone = made.where("k1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = keyed.select("doc_id", "n_shingles", "k1", "k2").join(final, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    return grouped.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are not the first of their group; all columns stay."""
    gone = near_duplicates(docs, doc_id, text).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(docs.columns)
