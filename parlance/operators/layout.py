"""From layout words to paragraphs and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import lexicon as L

_QUOTES = L.OPENING + L.CLOSING + '"'


def layout_words(words: DataFrame) -> DataFrame:
    """Words in reading order keys, blank ones dropped."""
    return words.where(F.trim("word") != "")


def _lines(words: DataFrame, *more: Column) -> DataFrame:
    """(book, page, block, line, x0, top, bottom, ..) of words that have a book and a page."""
    there = layout_words(words).where("book is not null and page is not null")
    return there.groupBy("book", "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), *more)


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their paragraph's number on the page (para). Where they are dealt by page they are not dealt again."""
    page = Window.partitionBy("book", "page")
    order, alike = page.orderBy("block", "line"), Window.partitionBy("book", "page", "__x")
    rows = lines.withColumns({"__pos": F.row_number().over(order), "__below": F.lag("bottom").over(order), "__other": F.lag("block").over(order), "__h": F.col("bottom") - F.col("top"), "__x": F.round("x0")})
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(alike), "__first": F.min("__pos").over(alike)})
    rows = rows.withColumns({"__r": F.row_number().over(page.orderBy("__h")), "__c": F.count(F.lit(1)).over(page)})
    often, middle = F.struct("__n", -F.col("__first"), "__x"), F.col("__r") == F.floor(F.col("__c") / 2) + 1
    rows = rows.withColumns({"__margin": F.max(often).over(page), "__line_h": F.max(F.when(middle, F.col("__h"))).over(page)})
    new = (
        (F.col("x0") > F.col("__margin.__x") + F.greatest(F.lit(4.0), F.col("__line_h") * 0.6))
        | (F.col("top") - F.col("__below") > F.col("__line_h") * 1.6)
        | (F.col("block") != F.col("__other"))
    )
    flag = F.when((F.col("__pos") > 1) & F.coalesce(new, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("__begins", flag).withColumn("para", F.sum("__begins").over(order))


def paragraphs(words: DataFrame) -> DataFrame:
    """(book, page, block, line, para): lines with their paragraph's number on the page.

    A paragraph begins at an indented line, after a wide gap, or in a new block. The margin
    is the most frequent rounded start (the first seen of equals), the height the upper median.
    Lines are dealt by page once.
    """
    return _numbered(_lines(words).repartition("book", "page")).select("book", "page", "block", "line", "para")


def _sentence_end(word: Column) -> Column:
    bare = F.regexp_replace(word, "[”’»\"')]+$", "")
    return bare.rlike("[.!?]$") & ~bare.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{L.ABBREVIATIONS})\.$")


def units_of(words: Column) -> Column:
    """Units (kind, text) of a paragraph's words: quotes are dialogue, narration is cut at sentence ends."""
    kind = "array<struct<kind:string,text:string>>"

    def flush(done, buf, what):
        text = F.trim(buf)
        text = F.trim(F.regexp_replace(text, f"^[{_QUOTES}]+|[{_QUOTES}]+$", "")) if what == "dialogue" else text
        return F.when(text != "", F.concat(done, F.array(F.struct(F.lit(what).alias("kind"), text.alias("text"))))).otherwise(done)

    def state(done, buf, quoted):
        return F.struct(done.alias("done"), buf.alias("buf"), quoted.alias("quoted"))

    def put(s, w):
        opens = ~s["quoted"] & w.rlike(f"^[{L.OPENING}\"]")
        done = F.when(opens, flush(s["done"], s["buf"], "narration")).otherwise(s["done"])
        buf = F.concat(F.when(opens, "").otherwise(s["buf"]), F.lit(" "), w)
        quoted = s["quoted"] | opens
        closes = quoted & (w.rlike(f"[{L.CLOSING}]\\s*$") | (w.rlike("\"\\s*$") & ~(opens & (F.length(w) == 1))))
        ends = ~quoted & _sentence_end(w)
        return F.when(closes, state(flush(done, buf, "dialogue"), F.lit(""), F.lit(False))).when(ends, state(flush(done, buf, "narration"), F.lit(""), F.lit(False))).otherwise(state(done, buf, quoted))

    zero = state(F.array().cast(kind), F.lit(""), F.lit(False))
    return F.aggregate(words, zero, put, lambda s: F.when(s["quoted"], flush(s["done"], s["buf"], "dialogue")).otherwise(flush(s["done"], s["buf"], "narration")))


def units(words: DataFrame) -> DataFrame:
    """(book, page, para, n, kind, text): units of every paragraph, in order, by the rule of units_of.

    What a word does to being inside a quote is one of four things: leave it, open, close,
    or turn it (a lone straight mark). So the state before a word is what the last opening
    or closing word left, turned as often as words since then turn it: two running values
    of a paragraph's words, and no fold. Words are dealt by page once, and stay with their
    line until it has its paragraph.
    """
    w = F.col("word")
    # one pattern tells for most words that no other fits
    asked = lambda c: F.when(w.rlike(f"[.!?{_QUOTES}]"), c).otherwise(False)
    closing, straight = asked(w.rlike(f"[{L.CLOSING}]\\s*$")), asked(w.rlike('"\\s*$'))
    opens = asked(w.rlike(f'^[{L.OPENING}"]'))
    # what is left by a word outside of a quote, and inside of one
    flags = {"__out": opens & ~closing & ~(straight & (F.length(w) > 1)), "__in": ~closing & ~straight, "__opens": opens, "__closes": closing | straight, "__lone": straight & ~closing & (F.length(w) == 1), "__ends": asked(_sentence_end(w))}
    lines = _lines(words.repartition("book", "page"), F.collect_list(F.struct("wno", "word")).alias("__words")).where("block is not null and line is not null")
    placed = _numbered(lines).select("book", "page", "block", "line", "para", F.inline("__words")).withColumns(flags)
    by = Window.partitionBy("page", "book", "para").orderBy("block", "line", "wno")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    turns, sets = (F.col("__out") & ~F.col("__in")).cast("int"), F.col("__out") == F.col("__in")
    rows = placed.withColumn("__turned", F.sum(turns).over(by))
    last = F.last(F.when(sets, F.struct(F.col("__in").alias("v"), F.col("__turned").alias("t"))), ignorenulls=True).over(before)
    rows = rows.withColumns({"__last": last, "__so_far": F.coalesce(F.lag("__turned").over(by), F.lit(0))})
    odd = (F.col("__so_far") - F.coalesce(F.col("__last.t"), F.lit(0))) % 2 == 1
    rows = rows.withColumn("__was", F.coalesce(F.col("__last.v"), F.lit(False)) != odd)
    opened = ~F.col("__was") & F.col("__opens")
    quoted = F.col("__was") | opened
    done = F.when(quoted, F.col("__closes") & ~(opened & F.col("__lone"))).otherwise(F.col("__ends"))
    rows = rows.withColumns({"__q": quoted, "__done": done, "__opened": opened})
    begins = F.col("__opened") | F.coalesce(F.lag("__done").over(by), F.lit(True))
    rows = rows.withColumn("__unit", F.sum(begins.cast("int")).over(by))
    listed = F.array_join(F.sort_array(F.collect_list(F.struct("block", "line", "wno", "word")))["word"], " ")
    each = rows.groupBy("page", "book", "para", "__unit").agg(F.trim(listed).alias("text"), F.first("__q").alias("__q"))
    bare = F.trim(F.regexp_replace("text", f"^[{_QUOTES}]+|[{_QUOTES}]+$", ""))
    each = each.withColumn("text", F.when(F.col("__q"), bare).otherwise(F.col("text"))).where("text <> ''")
    n = F.row_number().over(Window.partitionBy("page", "book", "para").orderBy("__unit")) - 1
    return each.select("book", "page", "para", n.alias("n"), F.when(F.col("__q"), "dialogue").otherwise("narration").alias("kind"), "text")
