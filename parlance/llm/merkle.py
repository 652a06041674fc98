"""Merkle manifest of a dataset: nodes labelled by the leaf ranks they cover, paths by containment.

Leaves of a tree (a source) stand in order; runs of ARITY nodes become their digest until
one is left. Levels are built and searched in bands of SPAN levels: a bucket holds the nodes
over ARITY ** SPAN entities, the bands above it get one entity from each bucket. So a band
costs one shuffle of its entities, the next band is smaller by ARITY ** SPAN, and no tree,
however large, is one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut
from parlance.operators.ordered import total_in_order

ARITY, SPAN = 3, 4
WIDE = ARITY**SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value as UTF-8 byte count, colon, value; a null as one hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves with `rank`, the place of each in its `tree`, from 0, nulls first; equal rows in any order."""
    kept = cut(leaves.withColumn("__tie", F.monotonically_increasing_id()))
    by = [F.col(c).asc_nulls_first() for c in order] + [F.col("__tie")]
    return cut(total_in_order(kept, ["tree"], by, F.lit(1), "rank").drop("__tie"))


@dataclass
class Forest:
    """bands[b] has a row for each bucket: tree, bucket, n (entities of the tree in this band) and levels,
    arrays of nodes (lo, hi, digest) where lo and hi are the leaf ranks covered, hi excluded.
    tops has the last node of each tree."""

    bands: list[DataFrame]
    tops: DataFrame

    def nodes(self) -> DataFrame:
        """(tree, level, lo, hi, digest): every node once, leaves are level 0."""
        out = None
        for b, band in enumerate(self.bands):
            # the last level of a bucket is the first of the band above, unless the tree ends here
            own = F.when(F.col("n") > WIDE, F.slice("levels", 1, SPAN)).otherwise(F.col("levels"))
            level = band.select("tree", F.posexplode(own).alias("__j", "__nodes")).select("tree", (F.col("__j") + b * SPAN).alias("level"), F.explode("__nodes").alias("__x"))
            level = level.select("tree", "level", "__x.*")
            out = level if out is None else out.unionByName(level)
        return out


def grow(leaves: DataFrame) -> Forest:
    """The trees over leaves (tree, rank, digest); only the size of the largest tree reaches the driver."""
    sizes = cut(leaves.groupBy("tree").agg(F.count("*").alias("leaves")))
    most = sizes.agg(F.max("leaves")).first()[0] or 0
    entities, bands, tops, scale = leaves.select("tree", "rank", "digest"), [], None, 1
    while not bands or most > 1:
        bucket = F.floor(F.col("rank") / WIDE).alias("bucket")
        # no group holds more than WIDE digests
        rows = entities.groupBy("tree", bucket).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("__e")).join(sizes, "tree")
        n = F.ceil(F.col("leaves") / scale)
        first = F.transform("__e", lambda e: F.struct((e["rank"] * scale).alias("lo"), F.least((e["rank"] + 1) * scale, F.col("leaves")).alias("hi"), e["digest"].alias("digest")))
        height = F.when(n > WIDE, SPAN).otherwise(sum((n > ARITY**j).cast("int") for j in range(SPAN)))

        def above(levels, _):
            last = F.element_at(levels, -1)

            def parent(i):
                run = F.slice(last, i * ARITY + 1, ARITY)
                text = F.array_join(F.transform(run, lambda x: x["digest"]), "")
                return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(text, 256).alias("digest"))

            count = F.ceil(F.size(last) / ARITY).cast("int")
            return F.concat(levels, F.array(F.transform(F.sequence(F.lit(0), count - 1), parent)))

        steps = F.filter(F.array(*[F.lit(j) for j in range(1, SPAN + 1)]), lambda j: j <= height)
        band = cut(rows.select("tree", "bucket", n.alias("n"), F.aggregate(steps, F.array(first), above).alias("levels")))
        bands.append(band)
        last = band.select("tree", F.col("bucket").alias("rank"), F.element_at("levels", -1)[0]["digest"].alias("digest"), "n")
        ended = last.where(F.col("n") <= WIDE).select("tree", "digest")
        tops = ended if tops is None else tops.unionByName(ended)
        entities = last.where(F.col("n") > WIDE).drop("n")
        scale *= WIDE
        most = -(-most // WIDE)
    return Forest(bands, tops)


def _path(scale: int) -> Column:
    """Siblings of an entity on its way through the levels of its bucket, then those above.

    At each level the bucket of width ARITY ** (j + 1) that holds the entity lists the nodes
    of one parent; the node whose interval contains the entity is its ancestor, and the rest
    of the parent's interval is covered by the siblings.
    """
    at = F.col("rank") * scale
    local = F.col("rank") - F.col("bucket") * WIDE

    def step(j):
        run = F.slice(F.col("levels")[j], (F.floor(local / F.pow(F.lit(float(ARITY)), j + 1)) * ARITY + 1).cast("int"), ARITY)
        side = lambda keep: F.array_join(F.transform(F.filter(run, keep), lambda x: x["digest"]), "")
        return F.struct(side(lambda x: x["hi"] <= at).alias("before"), side(lambda x: x["lo"] > at).alias("after"))

    within = F.filter(F.array(*[F.lit(j) for j in range(SPAN)]), lambda j: j < F.size("levels") - 1)
    return F.concat(F.transform(within, step), F.col("above"))


def with_paths(forest: Forest, entities: DataFrame, above: DataFrame) -> DataFrame:
    """entities (tree, rank, ..) with `path`, an array of (before, after), and the columns of `above`.

    `above` has a row for each tree: its path over the top of the tree (`above`) and what
    else its leaves shall carry.
    """
    extra = [c for c in above.columns if c not in ("tree", "above")]
    lower = None
    for b in range(len(forest.bands) - 1, -1, -1):
        band = forest.bands[b]
        buckets = band.where(F.col("n") <= WIDE).join(above, "tree")
        if lower is not None:
            buckets = buckets.unionByName(band.where(F.col("n") > WIDE).join(lower, ["tree", "bucket"]))
        buckets = buckets.drop("n")
        rows = entities if b == 0 else forest.bands[b - 1].where(F.col("n") > WIDE).select("tree", F.col("bucket").alias("rank"))
        joined = rows.withColumn("bucket", F.floor(F.col("rank") / WIDE)).join(buckets, ["tree", "bucket"]).withColumn("path", _path(WIDE**b)).drop("levels", "above", "bucket")
        lower = joined.select("tree", F.col("rank").alias("bucket"), F.col("path").alias("above"), *extra) if b else joined
    return lower


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", order: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: `order`, leaf, subroot, root, rank and path, with the columns of `also` (name: expression over docs).

    Rows with equal fields are leaves of their own, next to each other. Rows with an equal
    or null order column stand by their digest, nulls first; a null tree is the first tree.
    Empty and null texts are leaves as all others, texts of any length are digested whole,
    other columns play no part. An empty table has no rows and no root.
    """
    also = also or {}
    leaf = digest(*[framed(F.col(c)) for c in fields])
    narrow = docs.select(tree_key(F.col(tree)).alias("tree"), F.col(order).alias("__order"), leaf.alias("digest"), *[e.alias(f"__also_{k}") for k, e in also.items()])
    leaves = ranked(narrow, ["__order", "digest"])
    forest = grow(leaves)
    tops = ranked(forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"])
    over = grow(tops)
    root = over.tops.select("tree", F.array().cast(_PATH).alias("above"), F.col("digest").alias("root"))
    top = cut(with_paths(over, tops, root).select(F.col("of").alias("tree"), F.col("path").alias("above"), F.col("digest").alias("subroot"), "root"))
    out = with_paths(forest, leaves, top)
    return out.select(F.col("__order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "rank", "path", *[F.col(f"__also_{k}").alias(k) for k in also])


def proof(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def verified_manifest(docs: DataFrame, tampered: Column, tampered_text: Column, text: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The manifest with proofs, folded again from what the rows are after tampering.

    tampered tells which rows are changed, tampered_text what their text is then; a change
    that leaves the text as it was folds to the root.
    """
    changed = digest(*[framed(tampered_text if c == text else F.col(c)) for c in fields])
    out = manifest(docs, fields=fields, also={"__now": F.when(tampered, changed)})
    folded = fold(F.coalesce(F.col("__now"), F.col("leaf")), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
