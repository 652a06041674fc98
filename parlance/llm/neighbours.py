"""Nearest neighbours by cross-polytope hashing, with multiprobe and exact reranking.

A unit vector is turned by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and falls to the signed axis it is nearest to. A query goes to the
groups of its nearest axes, in several tables. A group that holds more vectors than a task
should is cut again: its vectors, less the group's mean, are hashed anew, so that tight
crowds come apart too. Vectors of the groups reached are compared in full precision.
How many axes a query probes is fitted: neighbours of a bounded sample of queries are found
by scanning all vectors, and the fewest probes that reach the wanted share of them are taken.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut

NEAREST, TABLES, SEED = 10, 4, 12
#: Share of the sample's neighbours that each round of probes must keep.
KEEP = 0.97
#: Queries whose exact neighbours the probes are fitted on (the bound of the fit).
SAMPLE = 64
#: Vectors and queries of a group in one task; rounds of cutting, after which groups are dealt into blocks.
POINTS, PROBES, ROUNDS = 16_384, 4_096, 6
#: Queries in one exact scan.
SCANNED = 1_024
#: Doubles that one comparison holds.
CELLS = 1 << 22


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, not zero, every component there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def axis_scores(x: np.ndarray, table: int, depth: int) -> np.ndarray:
    """How far each row reaches along each signed axis (first all plus, then all minus) after the rotation of a table and depth."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for signs in np.random.default_rng([SEED, table, depth]).choice([-1.0, 1.0], (3, d)):
        x = hadamard(x * signs)
    return np.concatenate([x, -x], 1)


def n_axes(dim: int) -> int:
    return 2 << max(0, dim - 1).bit_length()


def directions(x: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """Rows as unit vectors, less the centre of their group and at unit length again; a zero stays zero."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    if centre is not None:
        x = x - centre
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    return x


def probe_order(scores: np.ndarray) -> np.ndarray:
    """Axes of each row, nearest first."""
    return np.argsort(-scores, 1, kind="stable")


def vectors_of(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def closest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, point rows, distances): the k nearest points of each query, ties to the smaller id.

    Products only choose who is measured: what they place within their error of the k-th is
    measured by differences, and those distances decide.
    """
    points = points.astype(np.float64)
    norms = (points * points).sum(1)
    step = max(1, CELLS // max(1, len(points)))
    for i in range(0, len(queries), step):
        q = queries[i : i + step].astype(np.float64)
        near = norms[None] + (q * q).sum(1)[:, None] - 2 * (q @ points.T)
        slack = 1e-9 * (norms.max(initial=0) + (q * q).sum(1))[:, None]
        kth = np.partition(near, k - 1, 1)[:, k - 1 : k] if len(points) > k else np.full((len(q), 1), np.inf)
        rows, cols = np.nonzero(near <= kth + slack)
        dist = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 16):
            diff = q[rows[a : a + (1 << 16)]] - points[cols[a : a + (1 << 16)]]
            dist[a : a + (1 << 16)] = np.sqrt((diff * diff).sum(1))
        order = np.lexsort((ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        keep = place < k
        yield rows[keep] + i, cols[keep], dist[keep]


def _found(qcid, cid, least, dist) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qcid), pa.array(cid), pa.array(least), pa.array(dist)], ["qcid", "cid", "least", "dist"])


FOUND = "qcid long, cid long, least long, dist double"


def best(found: DataFrame, k: int, tables: int) -> DataFrame:
    """The k nearest of each query; a vector met in several tables counts once. Tasks cut their rows before the shuffle."""
    order = Window.partitionBy("qcid").orderBy("dist", "least", "cid")
    few = found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k * tables).drop("__r")
    return few.groupBy("qcid", "cid").agg(F.min("least").alias("least"), F.min("dist").alias("dist")).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def scan(classes: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """Exact neighbours of at most SCANNED queries (rows of cid, vector), which travel to every task, among all classes."""
    own = np.array([r["cid"] for r in queries], np.int64)
    q = np.array([r["vector"] for r in queries], np.float64).reshape(-1, dim)

    def work(batches):
        for b in batches:
            ids, least = b.column("cid").to_numpy(), b.column("least").to_numpy()
            # one more, as the query itself is among the classes
            for rows, cols, dist in closest(q, vectors_of(b.column("vector"), dim), least, k + 1):
                other = own[rows] != ids[cols]
                yield _found(own[rows][other], ids[cols][other], least[cols][other], dist[other])

    return best(classes.select("cid", "least", "vector").mapInArrow(work, FOUND), k, 1)


def classes_of(vectors: DataFrame, vec_id: str, vector: str, k: int) -> tuple[DataFrame, int]:
    """(cid, vector, least, members): one row for each distinct usable vector, and the number of components.

    members are its smallest ids with how many rows have each, k + 1 at most: no result needs
    more of one vector.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # the most common length, the smallest of equals
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return None, 0
    dim = most["dim"]
    rows = rows.where(F.size("vector") == dim).groupBy("vector", "vec_id").agg(F.count("*").alias("n"))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("__r") <= k + 1)
    out = rows.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("members"))
    return cut(out.select(F.monotonically_increasing_id().alias("cid"), "vector", F.col("members")[0]["vec_id"].alias("least"), "members")), dim


def _hash(rows: DataFrame, dim: int, depth: int, pick: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """rows (space, cid, least, vector, centre) with `axis`: pick(scores) gives the axes of each row, one row for each."""
    axes = n_axes(dim)

    def work(batches):
        for b in batches:
            space = b.column("space").to_numpy()
            x, centre = vectors_of(b.column("vector"), dim), vectors_of(b.column("centre"), dim) if depth else None
            step = max(1, CELLS // (4 * axes))
            for i in range(0, len(space), step):
                part = directions(x[i : i + step], None if centre is None else centre[i : i + step])
                table = space[i : i + step] // axes**depth
                for t in np.unique(table):
                    at = np.flatnonzero(table == t)
                    axis = pick(axis_scores(part[at], int(t), depth))
                    rows_ = np.repeat(at, axis.shape[1]) + i
                    taken = b.select(["space", "cid", "least", "vector"]).take(pa.array(rows_))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(axis.ravel().astype(np.int64))], ["space", "cid", "least", "vector", "axis"])

    return rows.mapInArrow(work, f"space long, cid long, least long, vector array<{kind}>, axis long")


class _Fit:
    """The sample's pairs (query, neighbour) on their way through the groups: which are found, which still to be met."""

    def __init__(self, queries: dict[int, np.ndarray], pairs: list[tuple[int, np.ndarray]], tables: int):
        self.queries, self.pairs = queries, pairs
        self.found = np.zeros(len(pairs), bool)
        self.alive = [(p, t) for p in range(len(pairs)) for t in range(tables)]

    def spaces(self) -> list[int]:
        return sorted({s for _, s in self.alive})

    def probes(self, depth: int, axes: int, centres: dict[int, np.ndarray] | None, keep: float) -> int:
        """The fewest axes each query must probe at this depth; remembers which pairs they reach."""
        self.reached = []
        for p, s in self.alive:
            cid, x = self.pairs[p]
            both = directions(np.stack([self.queries[cid], x]), None if centres is None else centres[s])
            scores = axis_scores(both, s // axes**depth, depth)
            axis = int(scores[1].argmax())
            self.reached.append((p, s * axes + axis, int(np.flatnonzero(probe_order(scores[:1])[0] == axis)[0])))
        need = np.full(len(self.pairs), axes)
        for p, _, r in self.reached:
            need[p] = min(need[p], r)
        open_ = np.unique([p for p, *_ in self.reached])
        open_ = open_[~self.found[open_]] if len(open_) else open_
        if not len(open_):
            return 1
        return int(np.sort(need[open_])[math.ceil(keep * len(open_)) - 1]) + 1

    def follow(self, probes: int, crowded: set[int]) -> None:
        self.alive = [(p, s) for p, s, r in self.reached if r < probes and s in crowded]
        for p, s, r in self.reached:
            if r < probes and s not in crowded:
                self.found[p] = True


def _compare(points: DataFrame, probes: DataFrame, dim: int, k: int, kind: str) -> DataFrame:
    """Neighbours of each probe among the points of its group; both have space, axis, block.

    Rows come sorted by group, points first: a task holds the points of one group and
    streams the probes past them.
    """
    both = points.withColumn("asks", F.lit(0)).unionByName(probes.withColumn("asks", F.lit(1)))
    key = ["space", "axis", "block"]

    def work(batches):
        held_key, parts, held = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in key] + [b.column("asks").to_numpy().astype(np.int64)], 1)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for i, j in zip(starts, np.r_[starts[1:], len(keys)]):
                at, asks = tuple(keys[i, :3]), keys[i, 3]
                part = (b.column("cid").to_numpy()[i:j], b.column("least").to_numpy()[i:j], vectors_of(b.column("vector").slice(i, j - i), dim))
                if at != held_key:
                    held_key, parts, held = at, [], None
                if not asks:
                    parts.append(part)
                elif parts:
                    if held is None:
                        held = [np.concatenate(x) for x in zip(*parts)]
                    cid, least, x = held
                    # the query's own vector is in the group, or not: one more is asked for
                    for rows, cols, dist in closest(part[2], x, least, k + 1):
                        other = part[0][rows] != cid[cols]
                        yield _found(part[0][rows][other], cid[cols][other], least[cols][other], dist[other])

    columns = [*key, "asks", "cid", "least", "vector"]
    return both.select(*columns).repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(work, FOUND)


def search(classes: DataFrame, queries: DataFrame, dim: int, k: int = NEAREST, tables: int = TABLES, keep: float = KEEP) -> DataFrame:
    """(qcid, cid, least, dist): the k nearest classes found for each query, which is a class itself.

    Only the sample of queries, its neighbours and the centres of their groups reach the driver.
    """
    kind = classes.schema["vector"].dataType.elementType.simpleString()
    axes = n_axes(dim)
    drawn = queries.select("cid", "vector").orderBy(F.xxhash64("cid")).limit(SAMPLE).collect()
    exact = scan(classes, drawn, dim, k).join(classes.select("cid", "vector"), "cid").select("qcid", "vector").collect()
    fit = _Fit({r["cid"]: np.array(r["vector"], np.float64) for r in drawn}, [(r["qcid"], np.array(r["vector"], np.float64)) for r in exact], tables)
    all_tables = F.explode(F.array(*[F.lit(t).cast("long") for t in range(tables)])).alias("space")
    none = F.lit(None).cast("array<double>").alias("centre")
    points, asked = (x.select(all_tables, "cid", "least", "vector", none) for x in (classes, queries))
    centres = found = None
    for depth in range(ROUNDS):
        m = fit.probes(depth, axes, centres, keep)
        hashed = cut(_hash(points, dim, depth, lambda s: s.argmax(1)[:, None], kind))
        probes = cut(_hash(asked, dim, depth, lambda s, m=m: probe_order(s)[:, :m], kind))
        sizes = hashed.groupBy("space", "axis").agg(F.count("*").alias("points")).join(probes.groupBy("space", "axis").agg(F.count("*").alias("probes")), ["space", "axis"])
        sizes = cut(sizes)
        last = depth == ROUNDS - 1
        crowded = F.lit(False) if last else F.col("points") > POINTS
        p, q = hashed.join(sizes, ["space", "axis"]), probes.join(sizes, ["space", "axis"])
        cuts, deals = F.ceil(F.col("points") / POINTS), F.ceil(F.col("probes") / PROBES)
        of = lambda parts: F.pmod(F.xxhash64("cid"), parts)
        every = lambda parts, own: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), own)).alias("block")
        columns = ["space", "axis", "cid", "least", "vector"]
        p_dealt = p.where(~crowded).select(*columns, every(deals, lambda d: of(cuts) * deals + d))
        q_dealt = q.where(~crowded).select(*columns, every(cuts, lambda c: c * deals + of(deals)))
        near = cut(best(_compare(p_dealt, q_dealt, dim, k, kind), k, tables))
        found = near if found is None else found.unionByName(near)
        full = sizes.where(crowded)
        if full.isEmpty():
            break
        where = fit.reached
        touched = queries.sparkSession.createDataFrame([(int(s // axes), int(s % axes)) for s in {s for _, s, _ in where}] or [(-1, -1)], "space long, axis long")
        fit.follow(m, {r["space"] * axes + r["axis"] for r in full.join(F.broadcast(touched), ["space", "axis"]).collect()})
        inner = (F.col("space") * axes + F.col("axis")).alias("space")
        p, q = (x.where(crowded).select(inner, "cid", "least", "vector") for x in (p, q))
        means = cut(_means(p, dim))
        centres = {r["space"]: np.array(r["centre"]) for r in means.where(F.col("space").isin(fit.spaces())).collect()}
        # a group's mean goes to each of its parts, so that no large group is one task
        spread = means.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        with_centre = lambda x: x.withColumn("__salt", F.pmod(F.xxhash64("cid"), F.lit(64)).cast("int")).join(spread, ["space", "__salt"]).drop("__salt")
        points, asked = with_centre(p), with_centre(q)
    return best(found, k, ROUNDS * tables)


def _means(points: DataFrame, dim: int) -> DataFrame:
    """(space, centre): the mean direction of each group, summed in batches first."""

    def work(batches):
        for b in batches:
            space, x = b.column("space").to_numpy(), directions(vectors_of(b.column("vector"), dim))
            names, at = np.unique(space, return_inverse=True)
            sums = np.zeros((len(names), dim + 1))
            np.add.at(sums, at, np.concatenate([x, np.ones((len(x), 1))], 1))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(sums))], ["space", "sums"])

    parts = points.select("space", "vector").mapInArrow(work, "space long, sums array<double>")
    summed = parts.select("space", F.posexplode("sums")).groupBy("space", "pos").agg(F.sum("col").alias("v"))
    whole = summed.groupBy("space").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    return whole.select("space", F.transform(F.slice("s", 1, dim), lambda x: x["v"] / F.element_at("s", -1)["v"]).alias("centre"))


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, keep: float = KEEP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row whose id `every` divides.

    score is the Euclidean distance in double precision, ties go to the smaller id. Vectors
    that are null, empty, zero or hold a null or non-finite component take no part, nor do
    rows without an id or with another number of components than most. Equal vectors are
    searched as one: their rows are at distance 0 of each other, and a query's own row is
    left out once. Repeated query rows each get their result. A query that reaches fewer than
    k rows, while there are more, is searched by a scan of all vectors. An empty table gives
    no rows; other columns play no part.
    """
    spark = vectors.sparkSession
    classes, dim = classes_of(vectors, vec_id, vector, k)
    if classes is None:
        return spark.createDataFrame([], RESULT)
    asking = vectors.where((F.col(vec_id) % every == 0) & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).alias("vector"))
    asking = asking.groupBy("vector", "query_id").agg(F.count("*").alias("times"))
    asking = cut(asking.join(classes.select("cid", "vector", "least", "members"), "vector").select("query_id", "times", "cid", "least", "members", "vector"))
    rows = F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + m["n"])
    # a class whose own rows fill every result needs no search
    queries = cut(asking.where(rows <= k).select("cid", "least", "vector").dropDuplicates(["cid"]))
    found = cut(search(classes, queries, dim, k, keep=keep))
    n = classes.count()
    short = cut(queries.join(found.groupBy(F.col("qcid").alias("cid")).agg(F.count("*").alias("met")), "cid", "left").where(F.coalesce("met", F.lit(0)) < min(k, n - 1)).select("cid", "vector"))
    if not short.isEmpty():
        lacking = short.withColumn("__part", F.pmod(F.xxhash64("cid"), F.lit(max(1, -(-short.count() // (SCANNED // 2))))))
        found = found.join(short.select(F.col("cid").alias("qcid")), "qcid", "left_anti")
        for part in sorted(r[0] for r in lacking.select("__part").distinct().collect()):
            found = found.unionByName(cut(scan(classes, lacking.where(F.col("__part") == part).collect(), dim, k)))
    lists = found.join(classes.select("cid", "members"), "cid").groupBy("qcid").agg(F.collect_list(F.struct("dist", "members")).alias("near"))
    own = F.struct(F.lit(0.0).alias("dist"), F.filter(F.transform("members", lambda m: F.struct(m["vec_id"].alias("vec_id"), F.when(m["vec_id"] == F.col("query_id"), m["n"] - 1).otherwise(m["n"]).alias("n"))), lambda m: m["n"] > 0).alias("members"))
    full = asking.join(lists, F.col("cid") == F.col("qcid"), "left")
    whole = F.concat(F.array(own), F.coalesce("near", F.array().cast("array<struct<dist:double,members:array<struct<vec_id:bigint,n:bigint>>>>")))
    each = lambda c: F.flatten(F.transform(c["members"], lambda m: F.array_repeat(F.struct(c["dist"].alias("score"), m["vec_id"].alias("vec_id")), F.least(m["n"], F.lit(k)).cast("int"))))
    ten = F.slice(F.array_sort(F.flatten(F.transform(whole, each))), 1, k)
    out = full.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", F.posexplode(ten).alias("__at", "__x"))
    return out.select("query_id", (F.col("__at") + 1).cast("int").alias("rank"), F.col("__x.vec_id").alias("vec_id"), F.col("__x.score").alias("score"))
