"""Operators over units: (book, id, para, kind, text, speaker)."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators.ordered import in_blocks, running_total, with_neighbours
from parlance.sources.tables import cut

#: Settings of a voice where its casting row has none (fixed values).
VOICE_DEFAULTS = {"exaggeration": 0.5, "cfg_weight": 0.5, "temperature": 0.8, "seed": None}
#: What is spoken for a character without lines (fixed value).
SAMPLE = "The quick brown fox jumps over the lazy dog."


def dialogue(units: DataFrame) -> DataFrame:
    return units.where("kind = 'dialogue'")


def cast_counts(units: DataFrame) -> DataFrame:
    """Lines of each speaker."""
    return dialogue(units).groupBy("book", F.col("speaker").alias("name")).agg(F.count(F.lit(1)).alias("lines"))


def first_seen(units: DataFrame) -> DataFrame:
    """(book, name, first): where each speaker's first line stands."""
    return dialogue(units).groupBy("book", F.col("speaker").alias("name")).agg(F.min("id").alias("first"))


def coverage(units: DataFrame, read: Column, runs: DataFrame | None = None) -> DataFrame:
    """Lines read, lines in all, and whether the book is complete.

    It is if its run (book, stopped, percent, failed) was not stopped, asked for the whole
    book and has no failed chunk; a book without a run is not. Without runs it is complete
    where all lines are read.
    """
    lines = dialogue(units).groupBy("book").agg(F.count_if(read).alias("lines_read"), F.count(F.lit(1)).alias("lines_total"), F.every(read).alias("complete"))
    if runs is None:
        return lines
    whole = ~F.coalesce("stopped", F.lit(False)) & (F.coalesce("percent", F.lit(100)) >= 100) & (F.coalesce("failed", F.lit(0)) == 0)
    done = runs.groupBy("book").agg(F.every(whole).alias("__whole"))
    return lines.join(done, "book", "left").select("book", "lines_read", "lines_total", F.coalesce("__whole", F.lit(False)).alias("complete"))


#: Orders of a cast sheet; equals go by their first line.
SHEET_ORDERS = {
    "most": [F.desc, "lines"], "fewest": [F.asc, "lines"], "first": [F.asc, "first_unit"], "last": [F.desc, "last_unit"], "name": [F.asc, "name"], "name_desc": [F.desc, "name"],
}


def cast_sheet(units: DataFrame, casting: DataFrame, order: str = "most") -> DataFrame:
    """Lines, first and last unit, voice and place of each character in an order of SHEET_ORDERS; Unknown and Narrator are hidden."""
    named = units.where(~F.col("speaker").isin("Unknown", "Narrator") & (F.lower("speaker") != "narrator") & (F.col("speaker") != ""))
    sheet = named.groupBy("book", F.col("speaker").alias("name")).agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first_unit"), F.max("id").alias("last_unit"))
    by, column = SHEET_ORDERS[order]
    sheet = sheet.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy(by(column), "first_unit", "name")))
    return sheet.join(casting.select("book", F.col("role").alias("name"), "voice"), ["book", "name"], "left")


def role_counts(units: DataFrame) -> DataFrame:
    """Narration units as the narrator's row, dialogue by speaker."""
    return units.groupBy("book", F.when(F.col("kind") == "narration", "narrator").otherwise(F.col("speaker")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def name_bigrams(units: DataFrame) -> DataFrame:
    """Capitalised word pairs that may be names: counts and the first spelling."""
    part = r"[A-Z][a-zA-Z'’-]+"
    hit = F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?U)\b({part} {part})\b"), F.lit(1)))
    rows = units.select("book", "id", hit.alias("at", "surface"))
    word = lambda k: X.name_key(F.substring_index(F.col("surface"), " ", 1 if k == 0 else -1), True)
    rows = rows.select("book", "id", "at", "surface", word(0).alias("first"), word(1).alias("last"))
    rows = rows.where((F.col("first") != "") & (F.col("last") != "") & ~F.col("first").isin(L.TITLES) & ~F.col("last").isin(L.TITLES))
    return rows.groupBy("book", "first", "last").agg(F.count(F.lit(1)).alias("n"), F.min_by("surface", F.struct("id", "at")).alias("surface"))


def companions(units: DataFrame, radius: int = 5) -> DataFrame:
    """How often another speaker has a line within `radius` units of one's own; Unknown and Narrator are nobody."""

    def add(rows, part):
        near = Window.partitionBy(*part).orderBy("id").rangeBetween(-radius, radius)
        return rows.withColumn("__near", F.collect_list("speaker").over(near))

    lines = dialogue(units).where("speaker not in ('Narrator', 'Unknown')").select("book", "id", "speaker")
    seen = with_neighbours(lines, ["book"], "id", radius, add)
    pairs = seen.select("book", F.col("speaker").alias("name"), F.explode("__near").alias("other")).where("other <> name")
    return pairs.groupBy("book", "name", "other").agg(F.count(F.lit(1)).alias("n"))


def partner_text(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent companions as one text."""
    rank = F.row_number().over(Window.partitionBy("book", "name").orderBy(F.desc("n"), "other"))
    top = pairs.withColumn("r", rank).where(F.col("r") <= k)
    item = F.transform(F.array_sort(F.collect_list(F.struct("r", "other", "n"))), lambda x: F.concat(x["other"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return top.groupBy("book", "name").agg(F.array_join(item, ", ").alias("partners"))


def anchor_veto(pairs: DataFrame, seen: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """Pairs (a, b) that differ: a's main companion `who` has `share` of its meetings, and b, with `least` meetings, never meets them.

    Meetings of a and b with each other don't count. Of companions met equally often the
    last by name is the main one.
    """
    met = lambda side, other: pairs.join(seen.select("book", F.col("name").alias(side), F.col("other").alias("who"), "n"), ["book", side]).where(F.col("who") != F.col(other))
    top = met("a", "b").groupBy("book", "a", "b").agg(F.max_by("who", F.struct("n", "who")).alias("who"), F.max("n").alias("__most"), F.sum("n").alias("__all")).where(F.col("__most") >= share * F.col("__all"))
    enough = met("b", "a").groupBy("book", "a", "b").agg(F.sum("n").alias("__n")).where(F.col("__n") >= least)
    asked = top.join(enough, ["book", "a", "b"])
    return asked.join(seen.select("book", F.col("name").alias("b"), F.col("other").alias("who")), ["book", "b", "who"], "left_anti").select("book", "a", "b", "who")


def cast_lines(units: DataFrame, casting: DataFrame) -> DataFrame:
    """Each unit with its voice and settings: its speaker's casting row, else the narrator's.

    casting: (book, role, voice) and any of VOICE_DEFAULTS. A row without any value counts
    as missing; a row without a voice gives nulls; settings that a row lacks get defaults.
    """
    kinds = {"exaggeration": "double", "cfg_weight": "double", "temperature": "double", "seed": "long"}
    settings = [F.coalesce(F.col(c).cast(k) if c in casting.columns else F.lit(None).cast(k), F.lit(VOICE_DEFAULTS[c]).cast(k)).alias(c) for c, k in kinds.items()]
    given = F.lit(False)
    for c in ("voice", *kinds):
        given = given | F.col(c).isNotNull() if c in casting.columns else given
    row = F.when(F.col("voice").isNotNull(), F.struct("voice", *settings))
    rows = casting.where(given).select("book", F.col("role").alias("speaker"), row.alias("__own"), F.lit(True).alias("__is"))
    main = rows.where("speaker = 'narrator'").select("book", F.col("__own").alias("__main"))
    key = units.withColumn("speaker", F.when(F.col("kind") == "narration", "narrator").otherwise(F.col("speaker")))
    out = key.join(rows, ["book", "speaker"], "left").join(main, "book", "left")
    return out.withColumn("__v", F.when(F.col("__is"), F.col("__own")).otherwise(F.col("__main"))).select("book", "id", "speaker", *[F.col(f"__v.{c}") for c in ("voice", *kinds)])


def voice_usage(lines: DataFrame) -> DataFrame:
    return lines.groupBy("book", "voice").agg(F.count(F.lit(1)).alias("n"))


def valid_voices(plan: DataFrame, voices: DataFrame) -> DataFrame:
    """Rows of a plan (book, voice, ..) whose voice is available."""
    return plan.join(voices.select("voice").distinct(), "voice", "left_semi").select(plan.columns)


def runs(quotes: DataFrame, max_gap: int = 3) -> DataFrame:
    """Quotes with `run`: a new run begins where the next quote is more than max_gap paragraphs on."""

    def add(rows, part):
        before = F.lag("para").over(Window.partitionBy(*part).orderBy("id"))
        return rows.withColumn("__new", (F.coalesce(F.col("para") - before, F.lit(0)) > max_gap).cast("int"))

    # ids are gapless over all units, quotes leave gaps, so quotes are numbered first
    numbered = running_total(quotes, ["book"], "para", "id", F.lit(1), "__q")
    flagged = with_neighbours(numbered, ["book"], "__q", 1, add)
    total = running_total(flagged, ["book"], "para", "id", F.col("__new"), "__before")
    return total.withColumn("run", (F.col("__before") + F.col("__new")).cast("long")).drop("__q", "__new", "__before")


def breaks_where(units: DataFrame, is_break: Column) -> DataFrame:
    """(book, para): paragraphs with a unit that the caller's predicate calls a break."""
    return units.where(is_break).select("book", "para").distinct()


def exchanges(quotes: DataFrame, breaks: DataFrame) -> DataFrame:
    """Quotes with `exchange`: breaks (book, para) at or before the quote's paragraph."""
    marks = quotes.select("book", "para", "id", F.lit(0).alias("w")).unionByName(breaks.select("book", "para", F.lit(-1).cast("long").alias("id"), F.lit(1).alias("w")))
    counted = running_total(marks, ["book"], "para", "id", F.col("w"), "exchange").where("w = 0").select("book", "id", F.col("exchange").cast("long").alias("exchange"))
    return quotes.join(counted, ["book", "id"])


def timeline(units: DataFrame, duration_ms: Column, gap_ms: int = 180, para_gap_ms: int = 450) -> DataFrame:
    """Start of each unit in milliseconds: all before it, with a gap after each and a longer one at a new paragraph."""

    def add(rows, part):
        then = F.lead("para").over(Window.partitionBy(*part).orderBy("id"))
        return rows.withColumn("__step", F.col("__d") + F.when(then.isNull() | (then == F.col("para")), gap_ms).otherwise(para_gap_ms))

    stepped = with_neighbours(units.withColumn("__d", duration_ms), ["book"], "id", 1, add)
    return running_total(stepped, ["book"], "para", "id", F.col("__step"), "start_ms").select("book", "id", F.col("start_ms").cast("long").alias("start_ms"), F.col("__d").cast("long").alias("dur_ms"))


def warm_ahead(lines: DataFrame, k: int = 3) -> DataFrame:
    """The voice needed k units later, and whether a unit is the first of its voice."""

    def add(rows, part):
        return rows.withColumn("ahead", F.lead("voice", k).over(Window.partitionBy(*part).orderBy("id")))

    first = lines.groupBy("book", "voice").agg(F.min("id").alias("id")).withColumn("first_use", F.lit(True))
    out = with_neighbours(lines.select("book", "id", "voice"), ["book"], "id", k, add)
    return out.join(first, ["book", "voice", "id"], "left").select("book", "id", "voice", "ahead", F.coalesce("first_use", F.lit(False)).alias("first_use"))


def auto_cast(cast: DataFrame, voices: list[str], saved: DataFrame) -> DataFrame:
    """Characters without a saved voice get the voices in turn, most lines first."""
    fresh = cast.join(saved.select("book", "name"), ["book", "name"], "left_anti")
    slot = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("lines"), "name")) - 1
    pool = F.array(*[F.lit(v) for v in voices])
    given = fresh.select("book", "name", F.get(pool, F.pmod(slot, F.lit(len(voices)))).alias("voice"))
    return given.unionByName(saved.select("book", "name", "voice"))


def near_narration(units: DataFrame, pairs: DataFrame, reach: int = 2) -> DataFrame:
    """(book, alias, name, id): lines of the alias beside narration that mentions the other by its token."""

    def add(rows, part):
        w = Window.partitionBy(*part).orderBy("id").rangeBetween(-reach, reach)
        return rows.withColumn("__around", F.array_join(F.collect_list(F.when(F.col("kind") == "narration", F.col("text"))).over(w), " \n "))

    told = with_neighbours(units, ["book"], "id", reach, add).where("kind = 'dialogue'").select("book", "id", F.col("speaker").alias("alias"), "__around")
    asked = pairs.select("book", "alias", "name", X.mention_token(F.col("name")).alias("__token"))
    return told.join(asked, ["book", "alias"]).where(X.mentions(F.col("__around"), F.col("__token"))).select("book", "alias", "name", "id")


def narration_support(near: DataFrame, cast: DataFrame, least: int = 2, share: float = 0.15, small: int = 30) -> DataFrame:
    """Aliases whose lines stand near narration naming a bigger character, often enough."""
    n = near.groupBy("book", "alias", "name").agg(F.count_distinct("id").alias("n"))
    own = cast.select("book", F.col("name").alias("alias"), F.col("lines").alias("alias_lines"))
    other = cast.select("book", "name", "lines")
    rows = n.join(own, ["book", "alias"]).join(other, ["book", "name"])
    good = (F.col("n") >= least) & (F.col("n") >= share * F.col("alias_lines")) & (F.col("alias_lines") <= small) & (F.col("lines") > F.col("alias_lines")) & (F.lower(F.substring("alias", 1, 1)) == F.lower(F.substring("name", 1, 1)))
    return rows.where(good).select("book", "alias", "name", "n")


def _beside(rows: DataFrame, events: DataFrame, keys: list[str], radius: int, block: int = 64) -> DataFrame:
    """rows (.., id) with an event (keys, at) within `radius` positions, once each."""
    near = rows.withColumn("__b", F.explode(F.sequence(F.floor((F.col("id") - radius) / block), F.floor((F.col("id") + radius) / block))))
    seen = events.select(*keys, F.col("at").alias("__at"), F.floor(F.col("at") / block).alias("__b"))
    return near.join(seen, [*keys, "__b"]).where(F.abs(F.col("__at") - F.col("id")) <= radius).select(*rows.columns).distinct()


def mentioned(units: DataFrame, names: DataFrame) -> DataFrame:
    """(book, name, at): units whose text mentions a name (book, name) by its token, found by the token's first letters.

    Words find their tokens without the text, which then joins only what they found.
    """
    first = lambda c: F.regexp_extract(c, "(\\p{L}+)", 1)
    asked = names.select("book", "name", X.mention_token(F.col("name")).alias("__token")).where("__token is not null").withColumn("__k", first(F.col("__token")))
    asked = cut(asked.distinct())  # names are few, and joined by their real size
    runs = units.select("book", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(\\p{L}+)"), F.lit(1)))).alias("__k"))
    found = runs.join(asked, ["book", "__k"]).select("book", "id", "name", "__token").join(units.select("book", "id", "text"), ["book", "id"])
    return found.where(X.mentions(F.col("text"), F.col("__token"))).select("book", "name", F.col("id").alias("at")).distinct()


def in_scene(moves: DataFrame, units: DataFrame, radius: int = 25) -> DataFrame:
    """Moves (book, id, name) whose name speaks or is mentioned within `radius` units."""
    spoken = units.select("book", F.col("speaker").alias("name"), F.col("id").alias("at"))
    told = mentioned(units, moves.select("book", "name").distinct())
    return _beside(moves, spoken.unionByName(told), ["book", "name"], radius)


#: Lengths of the keys that start behind a blank, and the most characters of other keys on each side of it.
_LENGTHS, _SIDE = (16, 8), 3
#: Length of the key of a long single word.
_WORD = 6
#: Short parts of a book that its texts are searched for as they are, and keys that are sent to every task.
_FEW, _SENT = 64, 1 << 20


def _shapes() -> dict[str, str]:
    """Patterns whose first groups are all keys of a shape in a text, by shape."""
    out = {str(n): f"(?s) (?=(.{{{n}}}))" for n in _LENGTHS}
    out |= {f"p{i}{j}": f"(?s)(?=([^ ]{{{i}}} .{{{j}}}))" for i in range(1, _SIDE + 1) for j in range(_SIDE + 1)}
    return out | {f"g{n}": f"(?=([^ ]{{{n}}}))" for n in (*range(1, _SIDE + 1), _WORD)}


def _needle(c: Column) -> Column:
    """(shape, key) that every text with this part has: the longest key behind the part's first blank, else letters on both sides of it, else of a single word."""
    words = F.split(c, " ", 2)
    head, rest = F.get(words, 0), F.coalesce(F.get(words, 1), F.lit(""))
    i, j, n = F.least(F.length(head), F.lit(_SIDE)), F.least(F.length(rest), F.lit(_SIDE)), F.length(c)
    word = F.when(n >= _WORD, _WORD).otherwise(F.least(n, F.lit(_SIDE)))
    of = lambda shape, key: F.struct(shape.alias("shape"), key.alias("key"))
    out = F.when(F.size(words) == 1, of(F.concat(F.lit("g"), word.cast("string")), F.substring(c, F.lit(1), word)))
    for k in _LENGTHS:
        out = out.when(F.length(rest) >= k, of(F.lit(str(k)), F.substring(rest, 1, k)))
    return out.otherwise(of(F.concat(F.lit("p"), i.cast("string"), j.cast("string")), F.concat(F.right(head, i), F.lit(" "), F.substring(rest, F.lit(1), j))))


def _keys(c: Column, few: Column, asked: Column, shapes: list[str]) -> Column:
    """The keys of the few parts that this text holds, and all keys of the asked shapes that a part of it can have; shapes are all that any text is asked for."""
    none, patterns = F.array().cast("array<string>"), _shapes()
    found = [F.when(F.array_contains(asked, s), F.regexp_extract_all(c, F.lit(patterns[s]), F.lit(1))).otherwise(none) for s in shapes]
    held = F.transform(F.filter(few, lambda x: F.contains(c, x["part"])), lambda x: x["key"])
    return F.concat(F.coalesce(held, none), *found)


def locate(selections: DataFrame, units: DataFrame, head: int = 60) -> DataFrame:
    """(sel_id, unit_id, rule) of selections (sel_id, book, para, sel): the first unit that holds the selection's start (1),
    else the first of the book that the selection holds (2), else the paragraph's first (3).

    The first rule looks in the selection's paragraph, or in the whole book if that is
    null. Blank selections and those without any match have null. Whole-book matches are
    found by an equal key: the characters behind the part's first blank, as many as it has
    of a few lengths, or some letters of a part of few; a text gives only keys of the shapes
    that its book asks for. Equal starts, selections and units are searched for once, keys
    travel as hashes, without the texts that they are of, short parts that are few in a book
    are looked for themselves, and only selections that the first rule leaves open go on to the second.
    """
    form = cut(units.select("book", "para", "id", X.selection_form(F.col("text")).alias("__u")))
    asked = selections.select("sel_id", "book", "para", X.selection_form(F.col("sel")).alias("__s")).withColumn("__h", F.substring("__s", 1, head))
    some = cut(asked.where("__s <> ''"))
    near = F.when(F.contains("__u", F.col("__h")), 1).otherwise(3)
    here = some.join(form, ["book", "para"]).groupBy("sel_id").agg(F.min(F.struct(near.alias("rule"), "id")).alias("m"))
    texts = form.where("__u <> ''").groupBy("book", "__u").agg(F.min("id").alias("__at"))
    texts = cut(_keyed(texts, "__u").withColumn("__no", F.monotonically_increasing_id()))
    loose = some.where("para is null")
    heads = cut(_keyed(loose.select("book", F.col("__h").alias("__part")).distinct(), "__part"))
    far = _first_holders(heads, texts.select("book", "__no", F.col("__u").alias("__text"), "__at"))
    far = far.groupBy("book", "__part").agg(F.min("__at").alias("__at")).withColumnRenamed("__part", "__h")
    first = loose.join(far, ["book", "__h"]).select("sel_id", F.struct(F.lit(1).alias("rule"), F.col("__at").alias("id")).alias("m"))
    found = cut(here.unionByName(first))
    rest = some.join(found.where("m.rule = 1"), "sel_id", "left_anti")
    parts = texts.select("book", "__key", "__shape", "__short", F.col("__u").alias("__part"), "__at")
    open_ = rest.select("book", F.col("__s").alias("__text")).distinct()
    held = _first_holders(parts, cut(open_.withColumn("__no", F.monotonically_increasing_id())))
    held = held.groupBy("book", "__text").agg(F.min("__at").alias("__at")).withColumnRenamed("__text", "__s")
    inside = rest.join(held, ["book", "__s"]).select("sel_id", F.struct(F.lit(2).alias("rule"), F.col("__at").alias("id")).alias("m"))
    best = found.unionByName(inside).groupBy("sel_id").agg(F.min("m").alias("m"))
    return selections.select("sel_id").join(best, "sel_id", "left").select("sel_id", F.col("m.id").alias("unit_id"), F.col("m.rule").alias("rule"))


def _keyed(parts: DataFrame, part: str) -> DataFrame:
    """parts with the shape of their key, the key as a hash, and a short one itself."""
    rows = parts.withColumn("__n", _needle(F.col(part)))
    short = F.when(F.col("__n.shape") != str(_LENGTHS[0]), F.col("__n.key"))
    return rows.withColumns({"__shape": F.col("__n.shape"), "__key": F.xxhash64("book", "__n.key"), "__short": short}).drop("__n")


def _first_holders(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(book, __part, __text, __at): pairs of a part and a text of the book that holds it.

    One of the two has `__at`; parts (with their keys) and texts (with a number `__no`) are written tables and distinct.
    """
    short = parts.where("__short is not null")
    some = cut(short.groupBy("book").count().where(F.col("count") <= _FEW).select("book"))
    few = short.join(some, "book", "left_semi").groupBy("book").agg(F.collect_list(F.struct(F.col("__part").alias("part"), F.col("__short").alias("key"))).alias("__few"))
    shaped = parts.where("__short is null").select("book", "__shape").unionByName(short.join(some, "book", "left_anti").select("book", "__shape"))
    asked = cut(shaped.groupBy("book").agg(F.collect_set("__shape").alias("__shapes")).join(few, "book", "full_outer"))
    shapes = sorted(r[0] for r in asked.select(F.explode("__shapes")).distinct().collect())  # names of shapes
    wanted = cut(parts.select("__key").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= _SENT else wanted
    keys = texts.join(asked, "book").select("book", "__no", F.explode(_keys(F.col("__text"), F.col("__few"), F.col("__shapes"), shapes)).alias("__k"))
    met = keys.select("book", "__no", F.xxhash64("book", "__k").alias("__key")).join(wanted, "__key", "left_semi")
    both = met.join(parts.drop("__shape", "__short"), ["book", "__key"]).drop("__key")
    return both.join(texts, ["book", "__no"]).where(F.contains("__text", F.col("__part"))).select("book", "__part", "__text", "__at")


def resolve_at(lines: DataFrame, reveals: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """Lines with `who`: the speaker's identity after every reveal reached at the line's paragraph, in the order of seq.

    reveals: (book, alias, real, at, seq); a reveal may lead to another one further on.
    identity: (book, name, display) of names that are known to be one. Names are compared by
    their key (case and marks don't count); a name that links or reveals know is shown as
    they first spell it, another as the line has it. A book's reveals are few and travel as one list.
    """
    key = lambda c: X.name_key(F.col(c), True)
    told = reveals.select("book", "seq", "at", "alias", "real", key("alias").alias("__a"), key("real").alias("__b"))
    spelled = [told.select("book", F.col(f"__{k}").alias("__k"), F.col(n).alias("__name"), F.struct(F.lit(1).alias("level"), "seq", F.lit(k).alias("side"), F.col(n).alias("n")).alias("__at")) for k, n in (("a", "alias"), ("b", "real"))]
    shown = spelled[0].unionByName(spelled[1])
    known = None
    if identity is not None:
        known = identity.select("book", key("name").alias("__k"), key("display").alias("__to")).where("__k <> ''").groupBy("book", "__k").agg(F.min("__to").alias("__to"))
        shown = shown.unionByName(identity.select("book", key("display").alias("__k"), F.col("display").alias("__name"), F.struct(F.lit(0).alias("level"), F.lit(0).cast(reveals.schema["seq"].dataType).alias("seq"), F.lit("").alias("side"), F.col("display").alias("n")).alias("__at")))
    shown = cut(shown.where("__k <> ''").groupBy("book", "__k").agg(F.min_by("__name", "__at").alias("__name")))

    def person(df, c):
        return df if known is None else df.join(known.withColumnRenamed("__k", c), ["book", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")

    told = person(person(told, "__a"), "__b").where("__a <> ''")
    steps = told.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("seq", "__a", "__b", "at"))).alias("__r"))
    names = lines.select("book", "speaker").distinct().withColumn("__who", key("speaker"))
    told = lines.select("book", "id", "para", "speaker").join(person(names, "__who"), ["book", "speaker"], "left").join(steps, "book", "left")
    who = F.aggregate("__r", F.col("__who"), lambda w, r: F.when((w == r["__a"]) & (F.col("para") >= r["at"]), r["__b"]).otherwise(w))
    told = told.withColumn("__k", F.coalesce(who, "__who")).join(shown, ["book", "__k"], "left")
    return told.select("book", "id", "para", "speaker", F.coalesce("__name", "speaker").alias("who"))


def excerpts(units: DataFrame, centres: DataFrame, radius: int = 3, chars: int = 100) -> DataFrame:
    """Units around a centre (book, id; each once) as text, the centre marked.

    Only what is shown of a unit travels, and once: a centre sees its neighbours in a window.
    """
    line = F.concat("speaker", F.lit(": "), F.substring("text", 1, chars))
    lines = units.select("book", "id", F.struct("id", line.alias("line")).alias("__unit"))
    marks = centres.select("book", "id", F.lit(None).cast(lines.schema["__unit"].dataType).alias("__unit"))

    def add(rows, part):
        near = Window.partitionBy(*part).orderBy("id").rangeBetween(-radius, radius)
        return rows.withColumn("__near", F.collect_list("__unit").over(near)).where("__unit is null")

    seen = with_neighbours(lines.unionByName(marks), ["book"], "id", radius, add).where(F.size("__near") > 0)
    shown = F.transform(F.array_sort("__near"), lambda x: F.concat(F.when(x["id"] == F.col("id"), ">> ").otherwise("   "), x["line"]))
    return seen.select("book", F.col("id").alias("centre"), F.array_join(shown, "\n").alias("excerpt"))


def sample_lines(units: DataFrame, cast: DataFrame | None = None, chars: int = 220) -> DataFrame:
    """(book, speaker, sample): each speaker's first unit; names of cast (book, name) without any get a fixed line."""
    first = units.groupBy("book", F.when(F.coalesce("speaker", F.lit("")) == "", "Narrator").otherwise(F.col("speaker")).alias("speaker")).agg(F.min_by("text", "id").alias("text"))
    if cast is not None:
        first = cast.select("book", F.col("name").alias("speaker")).join(first, ["book", "speaker"], "left")
    return first.select("book", "speaker", F.substring(F.coalesce("text", F.lit(SAMPLE)), 1, chars).alias("sample"))


def near_lines(units: DataFrame, k: int = 2, near: int = 110) -> DataFrame:
    """(book, speaker, r, text): the k lines of a speaker whose length is nearest to `near`; Unknown's count as the Narrator's."""
    who = F.when(F.col("speaker") == "Unknown", "Narrator").otherwise(F.col("speaker"))
    rank = F.row_number().over(Window.partitionBy("book", "speaker").orderBy(F.abs(F.length("text") - near), "id"))
    return units.withColumn("speaker", who).withColumn("r", rank).where(F.col("r") <= k).select("book", "speaker", F.col("r").cast("long").alias("r"), "text")


def cast_line(cast: DataFrame, k: int = 80) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("lines"), "name"))
    item = F.transform(F.array_sort(F.collect_list(F.struct("r", "name", "lines"))), lambda x: F.concat(x["name"], F.lit(" "), x["lines"].cast("string")))
    return cast.withColumn("r", rank).where(F.col("r") <= k).groupBy("book").agg(F.array_join(item, ", ").alias("cast_line"))


def voice_plan(usage: DataFrame, narrator: str, capacity: int) -> DataFrame:
    """The narrator's voice and the most used others, up to capacity."""
    order = F.row_number().over(Window.partitionBy("book").orderBy(F.desc(F.col("voice") == narrator), F.desc("n"), "voice"))
    return usage.where("voice is not null").withColumn("rank", order).where(F.col("rank") <= capacity).select("book", "voice", "n", F.col("rank").cast("long").alias("rank"))


def roster(units: DataFrame, reported: DataFrame) -> DataFrame:
    """Distinct names seen or reported, pronouns excluded, in the order of their first place."""
    names = dialogue(units).select("book", F.col("speaker").alias("name"), "id").unionByName(reported.select("book", "name", "id"))
    return names.where(X.is_name(F.col("name"))).groupBy("book", "name").agg(F.min("id").alias("first_at"))


def default_speakers(units: DataFrame) -> DataFrame:
    """Narration to Narrator; dialogue without a name to Unknown."""
    who = F.when(F.col("kind") == "narration", "Narrator").when(X.is_name(F.col("speaker")), F.col("speaker")).otherwise("Unknown")
    return units.withColumn("speaker", who)


def carry_over(units: DataFrame, previous: DataFrame) -> DataFrame:
    """Units with `attr`, and the speaker that an earlier run (book, id, speaker, attr) gave to those it read (null: Unknown)."""
    seen = previous.where("attr").select("book", "id", F.coalesce("speaker", F.lit("Unknown")).alias("__was"), F.lit(True).alias("__attr"))
    rows = units.join(seen, ["book", "id"], "left")
    return rows.withColumns({"speaker": F.coalesce("__was", "speaker"), "attr": F.coalesce("__attr", F.lit(False))}).drop("__was", "__attr")


def pending(units: DataFrame, chunks: DataFrame, percent: int = 100) -> DataFrame:
    """(book, chunk, id): unread lines of the chunks (book, para, chunk) that begin within the first `percent` of the book's units.

    units: as carry_over gives them. The percentage is a whole number from 1 to 100; at
    least one unit is in range.
    """
    percent = max(1, min(int(percent or 100), 100))
    most = units.groupBy("book").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count(F.lit(1)) * percent / 100)).alias("__most"))
    rows = units.join(chunks, ["book", "para"])
    begun = rows.groupBy("book", "chunk").agg(F.min("id").alias("__first")).join(most, "book").where("__first < __most")
    return rows.where("kind = 'dialogue' and not attr").join(begun, ["book", "chunk"], "left_semi").select("book", "chunk", "id")


def apply_replies(units: DataFrame, replies: DataFrame) -> DataFrame:
    """Speakers from replies (book, id, name); missing or no name: Unknown; attr tells that it was read."""
    got = dialogue(units).join(replies.select("book", "id", "name"), ["book", "id"], "left")
    return got.select("book", "id", F.when(X.is_name(F.col("name")), F.col("name")).otherwise("Unknown").alias("speaker"), F.col("name").isNotNull().alias("attr"))


def build_document(units: DataFrame) -> DataFrame:
    """Character span of each unit in the rebuilt text: blank line between paragraphs, a blank inside; dialogue is quoted again."""

    def add(rows, part):
        before = F.lag("para").over(Window.partitionBy(*part).orderBy("id"))
        return rows.withColumn("__sep", F.when(before.isNull(), 0).when(before == F.col("para"), 1).otherwise(2))

    quoted = F.length("text") + F.when(F.col("kind") == "dialogue", 2).otherwise(0)
    sized = with_neighbours(units.withColumn("__len", quoted), ["book"], "id", 1, add)
    total = running_total(sized, ["book"], "para", "id", F.col("__len") + F.col("__sep"), "__at")
    start = F.col("__at") + F.col("__sep")
    return total.select("book", "id", start.cast("long").alias("start"), (start + F.col("__len")).cast("long").alias("end"))


def context_chunks(units: DataFrame, chunk_chars: int = 3500, block: int | None = None) -> DataFrame:
    """(book, para, chunk): a chunk ends at a paragraph once it holds chunk_chars characters (at least 1).

    Where the chunk that begins at a paragraph ends is a look-up in the sums before each
    paragraph; chunks are the way along these pointers. A block of paragraphs tells for each
    place where an entering chunk can end, which are those in its first chunk_chars
    characters, how many chunks follow and how full the last one is.
    """
    sizes = units.groupBy("book", "para").agg(F.sum(F.length("text")).alias("__n"))

    def sums(table):
        return np.concatenate([[0], np.cumsum(table.column("__n").fill_null(0).to_numpy())])

    def ends_after(total, at):
        """The paragraph that begins the chunk after the one that begins at `at`."""
        return max(at + 1, int(np.searchsorted(total, total[at] + chunk_chars)))

    def effect(table):
        total, known = sums(table), {}
        n = len(total) - 1
        candidates = range(min(n, int(np.searchsorted(total, chunk_chars)) + 1))
        for at in candidates:
            way = []
            while at not in known and (after := ends_after(total, at)) < n:
                way.append(at)
                at = after
            chunks, size = known.setdefault(at, (1, int(total[n] - total[at])))
            for back in reversed(way):
                chunks += 1
                known[back] = (chunks, size)
        return {"sums": total[: len(candidates)].tolist(), "then": [known[at] for at in candidates], "all": int(total[n])}

    def follow(does, state):
        chunk, size = state or (0, 0)
        at = bisect.bisect_left(does["sums"], chunk_chars - size)
        if at == len(does["sums"]):
            return [chunk, size + does["all"]]
        return [chunk + does["then"][at][0], does["then"][at][1]]

    def replay(table, state):
        total = sums(table)
        chunk, size = state or (0, 0)
        marks = np.zeros(len(total) - 1, np.int64)
        at = int(np.searchsorted(total, chunk_chars - size))
        while at < len(marks):
            marks[at] = 1
            at = ends_after(total, at)
        return {"chunk": pa.array(chunk + np.cumsum(marks), pa.int64())}

    return in_blocks(sizes, ["book"], ["para"], "chunk long", replay, effect, follow, block).drop("__n")


def render(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages for a reader: dialogue as `[line n] "..."`, a blank line between paragraphs."""
    line = F.when(F.col("kind") == "dialogue", F.concat(F.lit("[line "), F.col("id").cast("string"), F.lit('] "'), F.col("text"), F.lit('"'))).otherwise(F.col("text"))
    rows = units.join(chunks, ["book", "para"]).groupBy("book", "chunk", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return rows.groupBy("book", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "t"))), lambda x: x["t"]), "\n\n").alias("passage"))


def context_tail(units: DataFrame, chunks: DataFrame, most: int = 900) -> DataFrame:
    """Whole units before each chunk's end, at least one, as many as fit in `most` characters."""
    rows = units.join(chunks, ["book", "para"])
    w = Window.partitionBy("book", "chunk").orderBy(F.desc("id"))
    kept = rows.withColumn("__r", F.row_number().over(w)).withColumn("__c", F.sum(F.length("text")).over(w)).where(f"__r = 1 or __c <= {most}")
    return kept.groupBy("book", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ").alias("tail"))
