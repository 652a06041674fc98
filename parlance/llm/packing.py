"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each."""

from __future__ import annotations

from array import array
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut

#: Buckets at most, and tokens in a batch.
BUCKETS, BUDGET = 16, 16_384
#: Rows that one ranking task gets, about.
RANKED = 20_000


def word_count(text: Column) -> Column:
    """White-space words of a text (null: none)."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def best_edges(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Padded lengths, at most `buckets`, that waste the fewest tokens on a histogram.

    lengths rise and are above 0. cost[k][j]: least padding of the first j lengths in k
    buckets; a bucket pads all its rows to its largest length. That cost is a line in the
    largest length for each cut before it, slopes fall and lengths rise, so a hull of lines
    finds every minimum in O(buckets * lengths), in whole numbers.
    """
    n = len(lengths)
    if not n:
        return []
    many, tokens = [0, *accumulate(counts)], [0, *accumulate(x * c for x, c in zip(lengths, counts))]
    cost: list[int | None] = [0] + [None] * n
    back = []
    for _ in range(min(buckets, n)):
        new, cut_at = [0] * (n + 1), array("q", bytes(8 * (n + 1)))
        hull: list[tuple[int, int, int]] = []  # (slope, height, i): lines of the cuts i that are least somewhere
        head = 0
        for j in range(1, n + 1):
            if cost[j - 1] is not None:
                m, h = -many[j - 1], cost[j - 1] + tokens[j - 1]
                while len(hull) - head > 1:
                    (m1, h1, _), (m2, h2, _) = hull[-2:]
                    if (h - h1) * (m1 - m2) > (h2 - h1) * (m1 - m):
                        break
                    hull.pop()
                hull.append((m, h, j - 1))
            x = lengths[j - 1]
            while len(hull) - head > 1 and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            m, h, cut_at[j] = hull[head]
            new[j] = m * x + h + x * many[j] - tokens[j]
        back.append(cut_at)
        cost = new
    edges, j = [], n
    for cut_at in reversed(back):
        if j == 0:
            break
        edges.append(lengths[j - 1])
        j = int(cut_at[j])
    return sorted(edges)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, place, padding) for every document.

    Lengths are counted exactly over all documents. The histogram that reaches the driver
    has at most about sqrt(2 * tokens of the corpus) distinct lengths. A batch holds documents of one bucket, bucket_len * rows <= budget; a longer
    document is a batch by itself. Batches are numbered from 0 in each bucket, rows from 0
    in each batch. Documents without words have length 0, bucket -1, one batch and no
    padding. Ranks come from windows over small hashed shares plus offsets, so a bucket with
    most of the rows is not gathered. Null ids and repeated rows are packed like others;
    an empty table packs nothing.
    """
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("n_tokens")).withColumn("__row", F.monotonically_increasing_id()))
    total = rows.count()
    counted = rows.where("n_tokens > 0").groupBy(F.col("n_tokens").alias("len")).agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = sorted((r["len"], r["n"]) for r in counted)
    edges = best_edges([x for x, _ in histogram], [n for _, n in histogram], buckets)
    bucket, length = F.lit(-1), F.lit(0).cast("long")
    for k, edge in reversed(list(enumerate(edges))):
        inside = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= edge)
        bucket, length = F.when(inside, k).otherwise(bucket), F.when(inside, F.lit(edge).cast("long")).otherwise(length)
    shares = max(1, min(4096, -(-total // RANKED)), min(64, total // 256))
    placed = rows.withColumns({"bucket": bucket.cast("int"), "bucket_len": length, "__share": F.pmod(F.xxhash64("__row"), F.lit(shares)).cast("int")})
    sizes = placed.groupBy("bucket", "__share").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("bucket").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = placed.join(F.broadcast(starts), ["bucket", "__share"])  # at most (buckets + 1) * 4,096 rows
    rank = F.row_number().over(Window.partitionBy("bucket", "__share").orderBy("doc_id", "__row")) - 1 + F.col("__start")
    fits = F.when(F.col("bucket_len") > 0, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len"))))
    ranked = ranked.withColumn("__rank", rank).withColumn("__fits", fits)
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.coalesce(F.floor(F.col("__rank") / F.col("__fits")), F.lit(0)).cast("long").alias("batch"),
        F.coalesce(F.col("__rank") % F.col("__fits"), F.col("__rank")).cast("long").alias("place"),
        F.when(F.col("n_tokens") > 0, F.col("bucket_len") - F.col("n_tokens")).otherwise(0).cast("long").alias("padding"),
    )
