"""Voice corpora: bursts, utterances, loudness, pace and vectors. Times are whole milliseconds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.graph import connected
from parlance.operators.ordered import carried_in_order, in_blocks, running_total, total_in_order, with_neighbours
from parlance.sources.tables import cut


def _next_breaks(e: np.ndarray, stops: np.ndarray, first: int, at: int, most: int) -> int:
    """The row that begins the next span: behind `at`, the first at a stop or that ends more than `most` after `first`."""
    stop = int(stops[np.searchsorted(stops, at, "right")])
    width = 16
    while at + 1 < stop:
        far = np.flatnonzero(e[at + 1 : min(at + 1 + width, stop)] - first > most)
        if len(far):
            return at + 1 + int(far[0])
        at, width = min(at + width, stop - 1), width * 2
    return stop


def joined_spans(spans: DataFrame, keys: list[str], apart: Callable, most: int, order: Sequence[str] = ("s_ms", "e_ms"), block: int | None = None) -> DataFrame:
    """spans with `island`: spans of a key that go on one another have the same number.

    A span begins anew where apart(end before, start, end) holds, or where it would end more
    than `most` after the start of its island. Where the next break stands after any row
    doesn't depend on what went before, so a block tells for each row at which an entering
    island can end what the block does from there; few rows can.
    """

    def arrays(table):
        s, e = table.column("s_ms").to_numpy(), table.column("e_ms").to_numpy()
        stops = np.append(np.flatnonzero(apart(e[:-1], s[1:], e[1:])) + 1, len(s))
        return s, e, stops

    def effect(table):
        s, e, stops = arrays(table)
        # an entering island ends at the first stop, or where the spans reach further than before
        last = int(stops[0])
        reach = np.maximum.accumulate(e[:last])
        ends = np.flatnonzero(np.append(True, reach[1:] > reach[:-1])).tolist() + [last] * (last < len(s))
        known: dict[int, tuple[int, int]] = {}  # from a break here: how many islands begin, where the last does

        def run(at):
            way = []
            while at not in known:
                way.append(at)
                after = _next_breaks(e, stops, int(s[at]), at, most)
                if after >= len(s):
                    known[at] = (1, int(s[at]))
                    way.pop()
                    break
                at = after
            n, first = known[at]
            for back in reversed(way):
                n += 1
                known[back] = (n, first)

        for at in ends:
            run(at)
        return {"s": int(s[0]), "e": int(e[0]), "reach": [int(reach[at]) if at < last else None for at in ends], "then": [known[at] for at in ends], "from0": known[0], "end": int(e[-1])}

    def follow(does, state):
        if state is None:
            n, first = does["from0"]
            return [n, first, does["end"]]
        n, first, end = state
        if apart(np.array([end]), np.array([does["s"]]), np.array([does["e"]]))[0]:
            then = does["from0"]
        else:
            then = next((t for r, t in zip(does["reach"], does["then"]) if r is None or r - first > most), None)
        return [n, first, does["end"]] if then is None else [n + then[0], then[1], does["end"]]

    def replay(table, state):
        s, e, stops = arrays(table)
        marks = np.zeros(len(s), np.int64)
        n, at = (0, 0) if state is None else (state[0], None)
        if at is None:
            if apart(np.array([state[2]]), s[:1], e[:1])[0] or e[0] - state[1] > most:
                at = 0
            else:
                at = _next_breaks(e, stops, state[1], 0, most)
        while at < len(s):
            marks[at] = 1
            at = _next_breaks(e, stops, int(s[at]), at, most)
        return {"island": pa.array(n + np.cumsum(marks), pa.int64())}

    return in_blocks(spans, keys, list(order), "island long", replay, effect, follow, block)


def _islands(spans: DataFrame, keys: list[str], apart: Callable, most: int) -> DataFrame:
    """Spans of each key joined by the rule of joined_spans: first start, last end."""
    numbered = joined_spans(spans.select(*keys, "s_ms", "e_ms"), keys, apart, most)
    return numbered.groupBy(*keys, "island").agg(F.min("s_ms").alias("s_ms"), F.max_by("e_ms", F.struct("s_ms", "e_ms")).alias("e_ms")).drop("island")


def fix_overlaps(spans: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """Spans that begin at or before the end so far are one (gaps and islands; the end is the greatest).

    The end so far and the number of islands are carried from range to range of a clip, so
    that no clip is one window.
    """
    order = [F.col("s_ms"), F.col("e_ms")]
    flagged = carried_in_order(spans, list(keys), order, {"__reach": (F.max, F.col("e_ms"))}, "__range").withColumn("__new", F.when(F.col("s_ms") <= F.col("__reach"), 0).otherwise(1))
    islands = total_in_order(flagged, list(keys), order, F.col("__new"), "__i", "__range").withColumn("__i", F.col("__i") + F.col("__new"))
    return islands.groupBy(*keys, "__i").agg(F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms")).drop("__i")


def utterances(spans: DataFrame, most: int = 14_000, gap: int = 600, least: int = 1_000, before: int = 150, after: int = 250) -> DataFrame:
    """Bursts (clip, seq, s_ms, e_ms) to padded utterances.

    A burst joins while the pause is at most `gap` and the whole at most `most`; a short
    utterance then joins the one before it if the two fit.
    """
    utts = _islands(spans, ["clip"], lambda end, s, e: s - end > gap, most)
    merged = _islands(utts, ["clip"], lambda end, s, e: e - s >= least, most)
    kept = merged.where(F.col("e_ms") - F.col("s_ms") >= least)
    return kept.select("clip", F.greatest(F.lit(0).cast("long"), F.col("s_ms") - before).alias("s_ms"), (F.col("e_ms") + after).alias("e_ms"))


def pause_profile(spans: DataFrame) -> DataFrame:
    """Speech, inner pauses and bursts of each clip."""
    islands = fix_overlaps(spans)
    return islands.groupBy("clip").agg(
        F.sum(F.col("e_ms") - F.col("s_ms")).alias("speech_ms"), (F.max("e_ms") - F.min("s_ms") - F.sum(F.col("e_ms") - F.col("s_ms"))).alias("gap_ms"), F.count(F.lit(1)).alias("bursts")
    )


def rhythm(profile: DataFrame) -> DataFrame:
    """Pause to speech, bursts a second and seconds a burst; null under two seconds of speech."""
    ok = F.col("speech_ms") >= 2000
    return profile.select(
        "clip", F.when(ok, F.round(F.col("gap_ms") / F.col("speech_ms"), 6)).alias("pause_ratio"), F.when(ok, F.round(F.col("bursts") * 1000 / F.col("speech_ms"), 6)).alias("burst_rate"),
        F.when(ok, F.round(F.col("speech_ms") / 1000 / F.col("bursts"), 6)).alias("burst_sec"),
    )


def pace_plan(voice: DataFrame, style: DataFrame) -> DataFrame:
    """(voice, rate, pause_scale, little_change) from words, speech_ms and gap_ms of voices and one style."""
    total = lambda df: df.agg(F.sum("words").alias("w"), F.sum("speech_ms").alias("s"), F.sum("gap_ms").alias("g"))
    st = total(style).select((F.col("w") * 1000 / F.col("s")).alias("st_art"), (F.col("g") / F.col("s")).alias("st_pause"))
    own = voice.groupBy("voice").agg(F.sum("words").alias("w"), F.sum("speech_ms").alias("s"), F.sum("gap_ms").alias("g"))
    rate = F.greatest(F.lit(0.87), F.least(F.lit(1.15), F.col("st_art") / (F.col("w") * 1000 / F.col("s"))))
    scale = F.col("st_pause") / F.greatest(F.col("g") / F.col("s"), F.lit(0.02)) * 1.6
    out = own.crossJoin(F.broadcast(st)).withColumn("rate", F.round(rate, 6)).withColumn("pause_scale", F.round(scale, 6))  # one style row
    return out.select("voice", "rate", "pause_scale", ((F.abs(F.col("rate") - 1) < 0.03) & (F.abs(F.col("pause_scale") - 1) < 0.15)).alias("little_change"))


def retime_plan(spans: DataFrame, rate: float, pause_scale: float, cap_ms: int = 1500, stretch_ms: int = 250, most_ms: int = 14_500) -> DataFrame:
    """Length of each clip after stretching speech and scaling pauses; clips that get too long are dropped."""

    def add(rows, part):
        return rows.withColumn("__then", F.lead("s_ms").over(Window.partitionBy(*part).orderBy("seq")))

    rows = with_neighbours(spans, ["clip"], "seq", 1, add)
    dur, gap = F.col("e_ms") - F.col("s_ms"), F.col("__then") - F.col("e_ms")
    spoken = F.when((F.lit(abs(1 - rate)) > 0.03) & (dur > stretch_ms), dur / rate).otherwise(dur)
    want = F.least(F.lit(float(cap_ms)), gap * pause_scale)
    paused = F.when(F.abs(want - gap) <= 10, gap).otherwise(F.when(want < gap, F.greatest(want, F.lit(40.0))).otherwise(want))
    out = rows.groupBy("clip").agg(F.round(F.sum(spoken + F.coalesce(paused, F.lit(0))), 3).alias("new_ms"))
    return out.withColumn("kept", F.col("new_ms") <= most_ms)


def speech_level(frames: DataFrame) -> DataFrame:
    """Loudness of each clip's speech in dB: frames more than 40 dB under the loudest don't count; under three frames: null."""
    most = frames.groupBy("clip").agg(F.max("rms").alias("__m"), F.count(F.lit(1)).alias("__n"))
    speech = F.when((F.col("rms") > 0) & (F.col("rms") > F.col("__m") * 0.01), F.col("rms"))
    return frames.join(most, "clip").groupBy("clip").agg(F.when(F.first("__n") >= 3, F.round(20 * F.log10(F.avg(speech) + 1e-12), 4)).alias("dbfs"))


def voice_level(levels: DataFrame, first: int = 10) -> DataFrame:
    """(voice, dbfs): the level of a voice's reference clip where it has one, else the mean over its first clips by name.

    levels: (voice, clip, dbfs) and, if there are references, is_reference. Clips without a
    level count among the first ones but not in the mean.
    """
    if "is_reference" not in levels.columns:
        levels = levels.withColumn("is_reference", F.lit(False))
    plain = levels.where("not is_reference")
    r = F.row_number().over(Window.partitionBy("voice").orderBy("clip"))
    mean = plain.withColumn("r", r).where(F.col("r") <= first).groupBy("voice").agg(F.avg("dbfs").alias("__mean"))
    alone = levels.where("is_reference").groupBy("voice").agg(F.min_by("dbfs", "clip").alias("__alone"))
    return mean.join(alone, "voice", "full").select("voice", F.round(F.coalesce("__alone", "__mean"), 6).alias("dbfs"))


def gain_db(level: Column, target: float, peak: Column) -> Column:
    """Gain towards a target level, at most 12 dB either way, that leaves peaks under 0.985."""
    g = F.pow(F.lit(10.0), F.greatest(F.lit(-12.0), F.least(F.lit(12.0), target - level)) / 20)
    return F.when(peak * g > 0.985, 0.985 / peak).otherwise(g)


def affine_scan(rows: DataFrame, group: list[str], position: str, a: Column, b: Column, alone: Column, out: str, width: int = 128, keep: str | None = None) -> DataFrame:
    """rows with `out`: x = a * x + b along the positions (0, 1, ..) of each group, and x = alone where there is no x yet; a null alone leaves it so.

    Steps of one kind make a step of the same kind, so runs of `width` rows become one row,
    and these are followed in the same way; then each run starts from what it is given. All
    of it is native, linear, and deals a group of any size over all tasks. A column named by
    `keep` goes along with its row.
    """
    more = [F.col(keep).alias("k")] if keep else []
    run = F.floor(F.col(position) / width)
    step = F.struct(F.col(position).cast("long").alias("p"), a.cast("double").alias("a"), b.cast("double").alias("b"), alone.cast("double").alias("n"), *more)
    runs = cut(rows.groupBy(*group, run.alias("__run")).agg(F.sort_array(F.collect_list(step)).alias("__steps")))
    moved = lambda x, s: F.when(x.isNull(), s["n"]).otherwise(s["a"] * x + s["b"])
    if not runs.where("__run > 0").isEmpty():
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("n"))
        whole = F.aggregate("__steps", one, lambda f, s: F.struct((s["a"] * f["a"]).alias("a"), (s["a"] * f["b"] + s["b"]).alias("b"), moved(f["n"], s).alias("n")))
        over = affine_scan(runs.select(*group, "__run", whole.alias("__w")), group, "__run", F.col("__w.a"), F.col("__w.b"), F.col("__w.n"), "__x", width)
        entries = over.select(*group, (F.col("__run") + 1).alias("__run"), "__x")
        runs = runs.join(entries, [*group, "__run"], "left")
    else:
        runs = runs.withColumn("__x", F.lit(None).cast("double"))
    start = F.struct(F.col("__x").alias("x"), F.array().cast("array<double>").alias("all"))

    def go_on(s, t):
        x = moved(s["x"], t)
        return F.struct(x.alias("x"), F.concat(s["all"], F.array(x)).alias("all"))

    trail = F.arrays_zip(F.col("__steps").alias("s"), F.aggregate("__steps", start, go_on, lambda s: s["all"]).alias("x"))
    each = runs.select(*group, F.explode(trail).alias("__e"))
    return each.select(*group, F.col("__e.s.p").alias(position), *([F.col("__e.s.k").alias(keep)] if keep else []), F.col("__e.x").alias(out))


def smooth_gain(levels: DataFrame, target: float, key: str = "clip", order: str = "seq") -> DataFrame:
    """Smoothed gain of each chunk in order: 0.7 of the last and 0.3 of the new; without a level the last one stays (null at first).

    A chunk changes the gain by g -> a g + b, so gains are an affine scan, which takes the
    order along.
    """
    placed = total_in_order(levels.select(key, order, "dbfs"), [key], [F.col(order)], F.lit(1), "__p")
    new = F.when(F.col("dbfs").isNotNull(), F.pow(F.lit(10.0), F.greatest(F.lit(-12.0), F.least(F.lit(12.0), target - F.col("dbfs"))) / 20))
    placed = placed.select(key, order, F.col("__p").cast("long").alias("__p"), new.alias("__new"))
    there = F.col("__new").isNotNull()
    gains = affine_scan(placed, [key], "__p", F.when(there, 0.7).otherwise(1.0), F.when(there, 0.3 * F.col("__new")).otherwise(0.0), F.col("__new"), "gain", keep=order)
    return gains.select(key, order, F.round("gain", 5).alias("gain"))


def pitch_stats(frames: DataFrame) -> DataFrame:
    """Median pitch and its spread in semitones over voiced frames; null under ten."""
    most = frames.groupBy("clip").agg(F.max("rms").alias("__m"))
    voiced = frames.join(most, "clip").where("rms > 0.1 * __m and f0 > 60 and f0 < 400").withColumn("__st", 12 * F.log2(F.col("f0") / 55.0))
    at = voiced.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.percentile("f0", 0.5).alias("med"), (F.percentile("__st", 0.75) - F.percentile("__st", 0.25)).alias("iqr"))
    ok = F.col("n") >= 10
    return at.select("clip", F.when(ok, F.round("med", 4)).alias("f0_med"), F.when(ok, F.round("iqr", 4)).alias("f0_iqr"))


def wave_trace(samples: DataFrame, points: int = 700) -> DataFrame:
    """Least and greatest sample of equal steps, the remainder dropped (clip, i, v)."""
    n = samples.groupBy("clip").agg(F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    rows = samples.join(n, "clip").withColumn("step", F.floor(F.col("i") / step)).where(F.col("step") < F.floor(F.col("n") / step))
    return rows.groupBy("clip", "step").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def decimate(samples: DataFrame, channels: int = 2, factor: int = 3) -> DataFrame:
    """Mean of all channels over `factor` frames; an incomplete last one is dropped."""
    k = channels * factor
    return samples.groupBy("clip", F.floor(F.col("i") / k).alias("i")).agg(F.round(F.avg("v"), 6).alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")


def crossfade(samples: DataFrame, overlap: int) -> DataFrame:
    """Overlap-add of chunks (clip, chunk, i, n, last, v): linear fades where two chunks meet."""
    fade_in = F.when((F.col("chunk") > 0) & (F.col("i") < overlap), F.col("i") / F.lit(overlap)).otherwise(1.0)
    fade_out = F.when(~F.col("last") & (F.col("i") >= F.col("n") - overlap), (F.col("n") - F.col("i")) / F.lit(overlap)).otherwise(1.0)
    at = F.col("chunk") * (F.col("n") - overlap) + F.col("i")
    return samples.groupBy("clip", at.alias("at")).agg(F.round(F.sum(F.col("v") * fade_in * fade_out), 5).alias("v"))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean of unit vectors, of unit length again; means are per dimension, so a large key spreads over tasks.

    A value that rounds to zero keeps its sign, as rounding by IEEE 754 has it.
    """
    dims = vectors.select(key, F.posexplode("embedding").alias("d", "x")).groupBy(key, "d").agg(F.avg("x").alias("x"))
    v = dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rounded = lambda x: F.when(F.round(x, 5) == 0, x * 0.0).otherwise(F.round(x, 5))
    return v.withColumn("norm", norm).select(key, F.transform("v", lambda x: rounded(x / F.col("norm"))).alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def stat_pool(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation of each dimension over the rows of a key."""
    return vectors.select(*keys, F.posexplode("embedding").alias("d", "x")).withColumn("d", F.col("d").cast("long")).groupBy(*keys, "d").agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_samp("x"), 5).alias("std"))


def average_linkage(m: np.ndarray, similarity: float) -> np.ndarray:
    """A cluster number for each row of unit vectors: average linkage by cosine, while the nearest clusters have `similarity` or more.

    Nearest-neighbour chains: from any cluster go on to its nearest until two are each
    other's nearest, which may be joined at once. A cluster whose nearest is too far is done,
    as joins among the others bring none nearer. Time and memory are the square of the rows.
    """
    n = len(m)
    near = m @ m.T
    np.fill_diagonal(near, -np.inf)
    size, label, open_ = np.ones(n), np.arange(n), np.ones(n, bool)
    chain: list[int] = []
    while True:
        if not chain:
            left = np.flatnonzero(open_)
            if not len(left):
                return label
            chain = [int(left[0])]
        at = chain[-1]
        to = int(near[at].argmax())
        if near[at, to] < similarity:
            open_[at] = False
            near[at] = near[:, at] = -np.inf
            chain.pop()
            continue
        if len(chain) > 1 and near[at, chain[-2]] >= near[at, to]:
            to = chain[-2]
            row = (size[at] * near[at] + size[to] * near[to]) / (size[at] + size[to])
            keep, gone = min(at, to), max(at, to)
            near[keep] = near[:, keep] = row
            near[keep, keep] = near[keep, gone] = near[gone, keep] = -np.inf
            near[gone] = near[:, gone] = -np.inf
            size[keep] += size[gone]
            open_[gone] = False
            label[label == gone] = keep
            del chain[-2:]
        else:
            chain.append(to)


def _matrix(rows: pa.Table) -> np.ndarray:
    col = rows.column("embedding").combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


def _forest(near: np.ndarray, similarity: float) -> np.ndarray:
    """Row pairs that connect what pairs of `similarity` or more connect; fewer than there are rows."""
    n, links = len(near), []
    unseen = np.ones(n, bool)
    for first in range(n):
        if not unseen[first]:
            continue
        unseen[first] = False
        todo = [first]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(unseen & (near[at] >= similarity))
            unseen[new] = False
            links += [(at, x) for x in new.tolist()]
            todo += new.tolist()
    return np.array(links, np.int64).reshape(-1, 2)


def _parts(rows: DataFrame, key: str, similarity: float, block: int) -> DataFrame:
    """rows (key, vec_id, embedding) with `part`: what pairs of `similarity` or more connect within a key, by blocks.

    Vectors of a key are dealt into blocks, and every two blocks are compared in one task,
    which gives only links that connect as much: no more than it has rows. A key of one
    block is one part.
    """
    sizes = cut(rows.groupBy(key).count())
    whole = rows.join(sizes.where(F.col("count") <= block).select(key), key, "left_semi").withColumn("part", F.lit(0).cast("long"))
    large = sizes.where(F.col("count") > block)
    if large.isEmpty():
        return whole
    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.join(large, key).withColumn("__of", F.ceil(2 * F.col("count") / block)).withColumn("__b", F.pmod(F.xxhash64("vec_id"), F.col("__of")))
    dealt = cut(dealt.drop("count"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1), lambda o: F.struct(F.least(o, F.col("__b")).alias("i"), F.greatest(o, F.col("__b")).alias("j")))
    met = dealt.select(key, "vec_id", "embedding", F.explode(pair).alias("__p")).select(key, "vec_id", "embedding", "__p.i", "__p.j")

    def work(t: pa.Table) -> pa.Table:
        m, ids = _matrix(t), t.column("vec_id").to_numpy()
        at = _forest(m @ m.T, similarity)
        return pa.table({key: t.column(key).take(pa.array(np.zeros(len(at), np.int64))), "a": pa.array(ids[at[:, 0]]), "b": pa.array(ids[at[:, 1]])})

    links = cut(met.groupBy(key, "i", "j").applyInArrow(work, f"{key} {kind}, a long, b long"))
    labels = connected(links, [key]).withColumnRenamed("node", "vec_id")
    split = dealt.select(key, "vec_id", "embedding").join(labels, [key, "vec_id"], "left")
    return whole.unionByName(split.withColumn("part", F.coalesce("part", "vec_id")))


def dominant_cluster(vectors: DataFrame, key: str, similarity: float = 0.55, block: int = 4096) -> DataFrame:
    """(key, vec_id): members of the largest tight cluster of each key (average linkage), all if under four; of equals the one with the smallest id.

    Clusters that average linkage joins are connected by single pairs that near, so a large
    key is first split into what such pairs connect; linkage runs inside each part. A part
    is one task, with the square of its vectors in memory.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = cut(vectors.select(key, F.col("vec_id").cast("long").alias("vec_id"), "embedding"))

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        m, ids = _matrix(t), t.column("vec_id").to_numpy()
        label = average_linkage(m, similarity)
        names, of = np.unique(label, return_inverse=True)
        sums = np.zeros((len(names), m.shape[1]))
        np.add.at(sums, of, m)
        score = np.linalg.norm(sums, axis=1)  # members times mean cosine to their centroid
        return pa.table({key: t.column(key), "vec_id": pa.array(ids), "cluster": pa.array(ids[names][of]), "score": pa.array(score[of])})

    linked = cut(_parts(rows, key, similarity, block).groupBy(key, "part").applyInArrow(work, f"{key} {kind}, vec_id long, cluster long, score double"))
    best = linked.groupBy(key).agg(F.max(F.struct("score", (-F.col("cluster")).alias("c"))).alias("b"), F.count("*").alias("n"))
    return linked.join(best, key).where((F.col("n") < 4) | (F.col("cluster") == -F.col("b.c"))).select(key, "vec_id")


def rank_order() -> list:
    """Subtitle segments first, then score and length, longest first."""
    return [F.when(F.col("source") == "sdh", 0).otherwise(1), F.desc("score"), F.desc(F.col("e_ms") - F.col("s_ms")), "s_ms"]


def rank_segments(segments: DataFrame) -> DataFrame:
    """Segments with `rank` inside their character, the best first."""
    ranked = total_in_order(segments, ["character"], rank_order(), F.lit(1), "__before")
    return ranked.withColumn("rank", (F.col("__before") + 1).cast("long")).drop("__before")


def pick_reference(segments: DataFrame, target_ms: int, gap_ms: int = 100, least_ms: int = 600) -> DataFrame:
    """Best segments until their sum with gaps reaches the target, with `before_ms`, the sum before each."""
    fit = segments.where(F.col("e_ms") - F.col("s_ms") >= least_ms)
    summed = total_in_order(fit, ["character"], rank_order(), F.col("e_ms") - F.col("s_ms") + gap_ms, "before_ms")
    return summed.where(F.col("before_ms") < target_ms)


def longest(clips: DataFrame, k: int) -> DataFrame:
    """(clip, seq, dur_ms): the k longest utterances of each clip, the first of equals."""
    rank = F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("dur_ms"), "seq"))
    return clips.withColumn("__r", rank).where(F.col("__r") <= k).select("clip", "seq", "dur_ms")


def reference_plan(clips: DataFrame, target_ms: int = 45_000, cap_ms: int = 60_000, by: str = "longest") -> DataFrame:
    """(clip, seq, before_ms, take_ms): utterances until the target is reached; the last is cut at the cap.

    by "longest": the longest first, the first of equals. by "name": in the order of `name`;
    the first one's `rate` is the sample rate, and others at other rates, or without one, are skipped.
    """
    if by == "name":
        rate = clips.where("rate is not null").groupBy("clip").agg(F.min_by("rate", F.struct("name", "seq")).alias("__rate"))
        clips, order = clips.join(rate, "clip").where("rate = __rate").drop("__rate"), [F.asc("name"), F.asc("seq")]
    else:
        order = [F.desc("dur_ms"), F.asc("seq")]
    summed = total_in_order(clips, ["clip"], order, F.col("dur_ms"), "before_ms").where(F.col("before_ms") < target_ms)
    return summed.select("clip", "seq", "before_ms", F.least(F.col("dur_ms"), cap_ms - F.col("before_ms")).alias("take_ms"))


def passages(transcripts: DataFrame, key: str, order: str, k: int = 2, near: int = 120, most: int = 400) -> DataFrame:
    """(key, passage): the k transcripts (key, order, text) of each key that are nearest to `near` characters, the first of equals, joined and cut at `most`.

    Texts without characters count as none; a key without any has an empty passage.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.length("text") - near), order))
    spoken = transcripts.where("text <> ''").withColumn("__r", rank).where(F.col("__r") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "text"))), lambda x: x["text"]), " ")
    best = spoken.groupBy(key).agg(F.substring(joined, 1, most).alias("passage"))
    return transcripts.select(key).distinct().join(best, key, "left").select(key, F.coalesce("passage", F.lit("")).alias("passage"))


def concat_spans(clips: DataFrame, gap_ms: int = 100) -> DataFrame:
    """(clip, seq, s_ms, e_ms): where utterances stand after they are joined with gaps, in the order of seq."""
    at = running_total(clips, ["clip"], "seq", "seq", F.col("dur_ms") + gap_ms, "s_ms")
    return at.select("clip", "seq", F.col("s_ms").cast("long").alias("s_ms"), (F.col("s_ms") + F.col("dur_ms")).cast("long").alias("e_ms"))


def training_segments(segments: DataFrame, least_ms: int = 1000, most_ms: int = 14_000) -> DataFrame:
    return rank_segments(segments.where((F.col("e_ms") - F.col("s_ms")).between(least_ms, most_ms) & F.col("text").rlike("\\S")))


def merge_segments(segments: DataFrame, gap: int = 600, most: int = 14_000) -> DataFrame:
    """Neighbouring segments of an episode joined while pause and length allow; text joined, least score, `voice` unless all are `sdh`."""
    keys = ["character", "episode"]
    rows = joined_spans(segments.select(*keys, "s_ms", "e_ms", "text", "score", "source"), keys, lambda end, s, e: (s < end) | (s - end > gap), most, ["s_ms", "e_ms", "text"])
    rows = rows.withColumnRenamed("island", "__i")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("s_ms", "e_ms", "text"))), lambda x: F.rtrim(x["text"]))
    text = F.when(F.count(F.lit(1)) == 1, F.min("text")).otherwise(F.ltrim(F.array_join(F.filter(texts, lambda t: t != ""), " ")))
    joined = rows.groupBy(*keys, "__i").agg(
        F.min("s_ms").alias("s_ms"), F.max_by("e_ms", F.struct("s_ms", "e_ms")).alias("e_ms"), text.alias("text"), F.min("score").alias("score"),
        F.when(F.every(F.col("source") == "sdh"), "sdh").otherwise("voice").alias("source"),
    )
    return joined.drop("__i")


def gender_filter(spans: DataFrame, low: float, high: float) -> DataFrame:
    """Spans whose pitch lies in the band; a clip that would lose all keeps all."""
    inside = F.coalesce(F.col("f0").between(low, high), F.lit(False))
    some = spans.groupBy("clip").agg(F.max(inside).alias("__some"))
    return spans.join(some, "clip").where(inside | ~F.col("__some")).drop("__some")


def param_grid(spark, values: dict[str, Sequence]) -> DataFrame:
    """One row for each combination of parameter values (small lists by nature)."""
    out = None
    for name, options in values.items():
        one = spark.createDataFrame([(o,) for o in options], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def match_scores(pairs: DataFrame) -> DataFrame:
    """Score of a candidate's features (c_*) against a reference's (r_*)."""
    dist = F.sqrt(F.aggregate(F.zip_with("r_ltas", "c_ltas", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) / F.sqrt(F.size("r_ltas"))
    speaker = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("r_embed"), F.col("c_embed"))))
    pitch = F.exp(-(F.abs(12 * F.log2(F.col("c_f0_med") / F.col("r_f0_med"))) / 2 + F.abs(F.col("c_f0_iqr") - F.col("r_f0_iqr")) / 4))
    beat = F.exp(-(F.abs(F.col("c_pause") - F.col("r_pause")) / 0.4 + F.abs(F.col("c_rate") - F.col("r_rate")) / 1.5 + F.abs(F.col("c_burst") - F.col("r_burst")) / 3))
    half = lambda c: F.coalesce(c, F.lit(0.5))
    return pairs.withColumn("score", F.round(0.55 * speaker + 0.15 * F.exp(-dist) + 0.10 * half(pitch) + 0.20 * half(beat), 5))


def partial_windows(n_frames: Column, width: int = 160, step: int = 77, least: float = 0.8) -> Column:
    """Starts of analysis windows; a last one is added where enough of it is covered."""
    whole = F.floor((F.greatest(n_frames - width + step, F.lit(0))) / step)
    rest = (n_frames - (whole * step)) / F.lit(float(width))
    count = whole + F.when((rest >= least) | (whole == 0), 1).otherwise(0)
    return F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda k: k * step)


def dataset_rows(spans: DataFrame, least_ms: int = 1000, most_ms: int = 14_500, quiet: float = 1e-4, block: int = 4096) -> DataFrame:
    """(voice, utt_id, text, dur_ms): spans (voice, seq, s_ms, e_ms, text, peak) that are fit for training, numbered in the order of seq.

    Text is kept without `|` and outer blanks and must not be empty; too short, too long and
    silent spans go. Numbers come from blocked totals, so a voice is not gathered.
    """
    text = F.trim(F.replace("text", F.lit("|"), F.lit(" ")))
    dur = F.col("e_ms") - F.col("s_ms")
    kept = spans.withColumn("text", text).where((F.col("text") != "") & dur.between(least_ms, most_ms) & (F.col("peak") > quiet))
    numbered = running_total(kept, ["voice"], "seq", "seq", F.lit(1), "__before", block)
    return numbered.select("voice", F.format_string("%s_%04d", F.col("voice"), (F.col("__before") + 1).cast("long")).alias("utt_id"), "text", dur.alias("dur_ms"))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Rows, minutes and a warning under one minute for each voice (voice, dur_ms)."""
    return rows.groupBy("voice").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dur_ms") / 60000, 4).alias("minutes"), (F.sum("dur_ms") < 60000).alias("thin"))


def latency_report(chunks: DataFrame) -> DataFrame:
    """(run, first_ms, rtf): time from the request to the first output, and time spent for a second of audio.

    chunks: (run, asked_ms, began_ms, ended_ms, audio_ms); failed ones have no ended_ms and don't count.
    """
    done = chunks.where("ended_ms is not null")
    return done.groupBy("run").agg((F.min("ended_ms") - F.min("asked_ms")).alias("first_ms"), F.round(F.sum(F.col("ended_ms") - F.col("began_ms")) / F.sum("audio_ms"), 6).alias("rtf"))


def cast_plan_summary(plan: DataFrame) -> DataFrame:
    """Characters and seconds of audio by status (character, status, seconds)."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))
