"""Ordered folds that cut and pack text; one document is one row, nothing is collected."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import W, let, split_sentences, strip


def _state(done: Column, cur: Column) -> Column:
    return F.struct(done.cast("array<string>").alias("done"), cur.cast("string").alias("cur"))


def _empty() -> Column:
    return _state(F.array(), F.lit(""))


def _all(s: Column) -> Column:
    return F.when(s["cur"] != "", F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"])


#: Items that one fold of a part follows, and parts of them that the next one follows.
WIDTHS = (64, 64)


def _parts(items: Column, width: int) -> Column:
    """An array cut into arrays of `width` items, the last one shorter."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * width + 1, F.lit(width)))


def _in_parts(items: Column, put, widths=WIDTHS) -> Column:
    """The state after a fold by put(state, item), which reads `cur` and only adds to `done`.

    A fold copies its state at each step, all that is done with it. So parts are folded from
    an empty `done`, and what they give is added once, so that the copies stay small however long the array is.
    """

    def one(part: Column, cur: Column, widths) -> Column:
        if not widths:
            return F.aggregate(part, _state(F.array(), cur), put)

        def put_part(s, p):
            return let(one(p, s["cur"], widths[1:]), lambda r: _state(F.concat(s["done"], r["done"]), r["cur"]))

        return let(part, lambda p: F.aggregate(_parts(p, math.prod(widths)), _state(F.array(), cur), put_part))

    return one(items, F.lit(""), widths)


def pack(sentences: Column, most: int) -> Column:
    """Greedy packing: a sentence joins the chunk with a blank while the sum stays within `most`."""

    def put(s, x):
        return F.when((s["cur"] != "") & (F.length(s["cur"]) + F.length(x) + 1 > most), _state(F.concat(s["done"], F.array(s["cur"])), x)).otherwise(
            _state(s["done"], F.trim(F.concat(s["cur"], F.lit(" "), x)))
        )

    return let(_in_parts(sentences, put), _all)


def pack_250(c: Column, most: int = 250) -> Column:
    """Sentences of a text packed for one synthesis call; never empty."""
    return let(pack(split_sentences(c), most), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(c))))


def packed_lines(lines: Iterable[tuple[Sequence[str], bool, bool]], most: int = 250) -> Iterator[str]:
    """The chunks that pack_250 gives for a normalized text, of its lines in order; only the chunk at hand is held.

    A line is its sentences and whether white space begins and ends it. A sentence that a
    line leaves open goes on in the next line with text, behind the line feed, or behind a
    blank where that stood in longer white space.
    """
    chunk, open_, joint, any_ = "", None, "\n", False

    def put(x: str) -> Iterator[str]:
        nonlocal chunk
        if chunk and len(chunk) + len(x) + 1 > most:
            yield chunk
            chunk = x
        else:
            chunk = f"{chunk} {x}" if chunk else x

    for sentences, before, after in lines:
        if not any(sentences):
            joint = " "
            continue
        first, any_ = sentences[0], True
        if open_ is not None:
            first = f"{open_}{' ' if before else joint}{first}"
        for x in (first, *sentences[1:])[:-1]:
            yield from put(x)
        open_ = sentences[-1] if len(sentences) > 1 else first
        if open_[-1] in ".!?":
            yield from put(open_)
            open_ = None
        joint = " " if after else "\n"
    if open_ is not None:
        yield from put(open_)
    if chunk or not any_:
        yield chunk


def _cut_long(sep: str, most: int):
    """For one piece: itself if short enough, else its parts at `sep`, rejoined while they fit."""

    def put(s, x):
        joined = strip(F.concat(s["cur"], F.lit(sep), x))
        return (
            F.when(s["cur"].isNull(), _state(s["done"], strip(x)))
            .when(F.length(joined) > most, _state(F.concat(s["done"], F.array(s["cur"])), strip(x)))
            .otherwise(_state(s["done"], joined))
        )

    def of(p):
        parts = F.aggregate(F.split(p, sep), _state(F.array(), F.lit(None)), put, lambda s: F.concat(s["done"], F.array(s["cur"])))
        return F.when(F.length(p) <= most, F.array(p)).otherwise(parts)

    return of


def split_long(c: Column, most: int = 300) -> Column:
    """Pieces of at most `most` characters: cut at ; : - , and blanks in turn, rejoined greedily, then by width."""
    pieces = F.array(strip(c))
    for sep in (";", ":", "-", ",", " "):
        pieces = F.flatten(F.transform(pieces, _cut_long(sep, most)))
    width = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: strip(F.substring(p, i * most + 1, F.lit(most))))
    return F.filter(F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(width(p)))), lambda p: p != "")


def group_sentences(sentences: Column, most: int = 300) -> Column:
    """Greedy packing where a sentence over `most` is cut by split_long and stands by itself."""
    trimmed = F.filter(F.transform(sentences, strip), lambda x: x != "")

    def put(s, x):
        closed = _all(s)
        return (
            F.when(F.length(x) > most, _state(F.concat(closed, split_long(x, most)), F.lit("")))
            .when(s["cur"] == "", _state(s["done"], x))
            .when(F.length(s["cur"]) + 1 + F.length(x) <= most, _state(s["done"], F.concat(s["cur"], F.lit(" "), x)))
            .otherwise(_state(closed, x))
        )

    return F.aggregate(trimmed, _empty(), put, _all)


def append_short(sentences: Column, least: int = 20, most: int = 300) -> Column:
    """A sentence under `least` characters joins the next one if that fits, else the one before."""
    return let(sentences, lambda v: _append_short(v, least, most))


def _append_short(sentences: Column, least: int, most: int) -> Column:
    many = F.size(sentences)

    def put(s, i):
        x, then = strip(F.get(sentences, i)), strip(F.get(sentences, i + 1))
        joined = F.concat(x, F.lit(" "), then)
        last = F.element_at(s["done"], -1)
        back = F.concat(last, F.lit(" "), x)
        head = F.when(F.size(s["done"]) > 1, F.slice(s["done"], F.lit(1), F.size(s["done"]) - 1)).otherwise(F.array().cast("array<string>"))
        out = (
            F.when(F.length(x) >= least, _state(F.concat(s["done"], F.array(x)), F.lit("")))
            .when((i + 1 < many) & (F.length(joined) <= most), _state(F.concat(s["done"], F.array(joined)), F.lit("skip")))
            .when((F.size(s["done"]) > 0) & (F.length(back) <= most), _state(F.concat(head, F.array(back)), F.lit("")))
            .otherwise(_state(F.concat(s["done"], F.array(x)), F.lit("")))
        )
        return F.when(s["cur"] == "skip", _state(s["done"], F.lit(""))).otherwise(out)

    each = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, _empty(), put, lambda s: s["done"])


def enforce_min(chunks: Column, least: int = 20) -> Column:
    """A chunk under `least` characters is merged once with the next; the last stays as it is."""
    return let(chunks, lambda v: _enforce_min(v, least))


def _enforce_min(chunks: Column, least: int) -> Column:
    many = F.size(chunks)

    def put(s, i):
        x = F.get(chunks, i)
        short = (F.length(x) < least) & (i + 1 < many)
        out = F.when(short, _state(F.concat(s["done"], F.array(F.concat(x, F.lit(" "), F.get(chunks, i + 1)))), F.lit("skip"))).otherwise(_state(F.concat(s["done"], F.array(x)), F.lit("")))
        return F.when(s["cur"] == "skip", _state(s["done"], F.lit(""))).otherwise(out)

    each = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(each, _empty(), put, lambda s: s["done"])


def halve(c: Column) -> Column:
    """Two halves of a text: at sentences, else at clauses, else at words; null for one word."""
    text = strip(c)

    def at(pattern):
        parts = F.filter(F.split(text, pattern), lambda p: p != "")
        return let(
            parts,
            lambda p: F.when(F.size(p) > 1, F.array(F.array_join(F.slice(p, F.lit(1), F.floor(F.size(p) / 2).cast("int")), " "), F.array_join(F.slice(p, F.floor(F.size(p) / 2).cast("int") + 1, F.size(p)), " "))),
        )

    return F.coalesce(at(f"(?<=[.!?]){W}+"), at(f"(?<=[;:,]){W}+"), at(f"{W}+"))


def overlap_plan(length: Column, chunk: int, overlap: int) -> Column:
    """(start, size) of overlapping chunks over `length` samples; the last is short."""
    starts = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length.cast("long") - 1, F.lit(chunk - overlap).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(chunk).cast("long"), length - s).alias("size")))
