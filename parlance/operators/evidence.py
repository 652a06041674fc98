"""Lines that tell two names apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators.ordered import running_total
from parlance.operators.units import _beside, dialogue, near_narration
from parlance.sources.tables import cut

#: Units from another entry's lines within which a line is not far from them.
FAR = 20


def evidence_lines(units: DataFrame, pairs: DataFrame, k: int, spread: bool = False) -> DataFrame:
    """(book, name, other, id): up to k lines of a name that bear on whether it is `other`.

    First lines beside narration that mentions the other, then lines that mention it
    themselves, each in order; what is left of k is filled with the name's first line, those
    at one and two thirds, and its last. With spread, only lines over FAR units from all of
    the other's count, if there are any, and at least three places are left for the latter.
    """
    key = ["book", "name", "other"]
    pairs = pairs.select(*key).distinct()
    lines = dialogue(units).select("book", F.col("speaker").alias("name"), "id", "text")
    own = lines.join(pairs, ["book", "name"])
    if spread:
        close = _beside(own.select(*key, "id"), lines.select("book", F.col("name").alias("other"), F.col("id").alias("at")), ["book", "other"], FAR)
        marked = own.join(close.withColumn("__close", F.lit(True)), [*key, "id"], "left").withColumn("__close", F.coalesce("__close", F.lit(False)))
        some = marked.where("not __close").select(*key).distinct().withColumn("__some", F.lit(True))
        own = cut(marked.join(some, key, "left").where("not __close or __some is null").drop("__close", "__some"))
    strong = near_narration(units, pairs.select("book", F.col("name").alias("alias"), F.col("other").alias("name"))).select("book", F.col("alias").alias("name"), F.col("name").alias("other"), "id").withColumn("__strong", F.lit(True))
    placed = running_total(own, key, "id", "id", F.lit(1), "__pos").join(own.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")), key).join(strong, [*key, "id"], "left")
    prio = F.when(F.col("__strong"), 0).when(X.mentions(F.col("text"), X.mention_token(F.col("other"))), 1)
    turn = F.lit(None).cast("int")
    for at, place in reversed(list(enumerate((F.lit(0), F.floor(F.col("__n") / 3), F.floor(2 * F.col("__n") / 3), F.col("__n") - 1)))):
        turn = F.when(F.col("__pos") == place, at).otherwise(turn)
    rows = placed.withColumns({"__prio": prio, "__turn": turn}).where("__prio is not null or __turn is not null").select(*key, "id", "__prio", "__turn")
    most = max(1, k - 3) if spread else k
    named = rows.where("__prio is not null").withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("__prio", "id"))).where(F.col("__r") <= most).select(*key, "id")
    count = named.groupBy(*key).agg(F.count(F.lit(1)).alias("__p"))
    rest = rows.where("__turn is not null").join(named, [*key, "id"], "left_anti").join(count, key, "left")
    rest = rest.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("__turn"))).where(F.col("__r") <= k - F.coalesce("__p", F.lit(0)))
    return named.unionByName(rest.select(*key, "id"))
