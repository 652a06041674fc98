"""Words that are spelt alike and spoken differently: their places, and respelling them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X


def _pattern(words) -> str:
    """The words in any case; a capital with a dot (İ) is a capital i."""
    either = "|".join(sorted(words, key=len, reverse=True)).replace("i", "[iİ]")
    return f"(?i)(?<!{X.C})({either})(?!{X.C})"


def _lower(word: Column) -> Column:
    return F.lower(F.replace(word, F.lit("İ"), F.lit("I")))


def _parted(text: Column, words) -> tuple[Column, Column]:
    """What stands between the hits of a text (one more than hits), and the hits."""
    return F.split(text, _pattern(words), -1), F.regexp_extract_all(text, F.lit(_pattern(words)), F.lit(1))


def heteronym_hits(docs: DataFrame, dictionary: dict = L.HETERONYMS, around: int = 40) -> DataFrame:
    """(doc_id, hit_no, start, end, word, context, says): every ambiguous word with its place, `around` characters on each side and its respellings.

    Offsets and hit numbers count from 0. Texts without a hit and null texts have no rows.
    """
    between, hits = _parted(F.col("text"), dictionary)
    rows = docs.where(F.col("text").rlike(_pattern(dictionary))).select("doc_id", "text", between.alias("__b"), hits.alias("__h"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def put(a, i):
        start = a["at"] + F.length(F.get("__b", i))
        return F.struct((start + F.length(F.get("__h", i))).alias("at"), F.concat(a["starts"], F.array(start)).alias("starts"))

    starts = F.aggregate(F.sequence(F.lit(0), F.size("__h") - 1), zero, put, lambda a: a["starts"])
    each = rows.select("doc_id", "text", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("__h").alias("word"))).alias("hit_no", "h"))
    start, word = F.col("h.start"), F.col("h.word")
    says = F.create_map(*[x for w, readings in dictionary.items() for x in (F.lit(w), F.array(*[F.lit(r[2]) for r in readings]))])
    begin = F.greatest(start - around, F.lit(0))
    end = start + F.length(word)
    return each.select("doc_id", "hit_no", start.alias("start"), end.alias("end"), _lower(word).alias("word"), F.substring("text", begin + 1, end + around - begin).alias("context"), F.element_at(says, _lower(word)).alias("says"))


def respell(docs: DataFrame, choices: DataFrame, dictionary: dict = L.HETERONYMS) -> DataFrame:
    """docs with the chosen respelling (doc_id, hit_no, say) in place of each chosen hit, in the hit's case.

    Hits without a choice stay as they are; of several choices for a hit the first by
    spelling counts; choices for hits that are not there do nothing.
    """
    one = choices.groupBy(F.col("doc_id").alias("__id"), "hit_no").agg(F.min("say").alias("say"))
    chosen = one.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("hit_no", "say"))).alias("__c"))
    between, hits = _parted(F.col("text"), dictionary)
    rows = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumns({"__b": between, "__h": hits})
    new = lambda i: F.element_at("__c", i)
    word = lambda i: F.get("__h", i)
    parts = F.transform("__b", lambda b, i: F.concat(b, F.coalesce(F.when(new(i).isNotNull(), X.keep_case(word(i), new(i))), word(i), F.lit(""))))
    changed = F.when(F.col("__c").isNull() | (F.size("__h") == 0), F.col("text")).otherwise(F.array_join(parts, ""))
    return rows.withColumn("text", changed).select(docs.columns)
