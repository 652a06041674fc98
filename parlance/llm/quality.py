"""Quality rules: a table of thresholds compiled into one projection of Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on was with be as by this are at from or an not have "
    "der die das und ist von zu den mit des im ein eine nicht auf für sich dem als auch "
    "le la les de et un une des en du que est pour dans qui par sur au plus pas "
    "el los las y que una por con para su del se lo como al es"
).split()

#: (metric, least, most); None: no bound. A document is kept if every metric lies within its bounds.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_ratio", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _repeats(words: Column) -> Column:
    """Words that stand in a five-word window found twice or more.

    Window hashes are sorted as plain longs first; only a text with an equal pair pays
    for the sort that carries positions.
    """
    last = F.size(words) - 5
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])))

    def counted(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = let(
            paired,
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, i + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"])),
        )
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, 5).otherwise(F.least(F.lit(5), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x))

    def checked(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.exists(F.transform(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))), lambda b: b))
        return F.when(F.coalesce(twice, F.lit(False)), counted(h)).otherwise(F.lit(0))

    return F.coalesce(let(hashes, checked), F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """All measured values of a text (null: no words) as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeats(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(_words(text), of)


def score_quality(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS, out: str = "quality") -> DataFrame:
    """docs with a struct column `out`: the counts, base_failed and kept.

    One narrow projection, no shuffle and no user function. Null or blank text has no
    words and fails the base rule. Repeated rows are measured alike, other columns pass
    through; a column of that name is replaced.
    """

    def of(m: Column) -> Column:
        n = F.greatest(m["n_words"], F.lit(1))
        ratio = {
            "mean_word_chars": m["word_chars"] / n,
            "symbol_ratio": m["n_symbols"] / n,
            "stop_word_ratio": (m["n_stop_words"] + 1) / n,  # a word more, so that a short text without one passes
            "dup_line_ratio": m["lines"]["dup"] / F.greatest(m["lines"]["all"], F.lit(1)),
        }
        good = F.lit(True)
        for name, least, most in thresholds:
            good = good & (ratio[name] >= least if least is not None else F.lit(True)) & (ratio[name] <= most if most is not None else F.lit(True))
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(
            m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
            m["lines"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"), m["n_stop_words"].alias("n_stop_words"),
            *[v.alias(k) for k, v in ratio.items()], failed.alias("base_failed"), (~failed & good).alias("kept"),
        )

    return docs.withColumn(out, let(measures(F.col(text)), of))
