"""Who speaks a quote: tags in the narration, turn taking, mentions and vocatives."""

from __future__ import annotations

import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators.ordered import Unknown, after_symbolic, in_blocks, running_total, symbolic_effect, with_neighbours
from parlance.sources.tables import cut

#: Fixed value: what a name in a speech tag looks like.
NAME = r"[A-Z][a-zA-Z'’.-]+(?:\s+[A-Z][a-zA-Z'’.-]+)?"


def known_names(names: DataFrame, roster: DataFrame, column: str = "tag") -> DataFrame:
    """Rows whose name begins with the first word of a roster name of the book."""
    first = roster.select("book", F.substring_index("name", " ", 1).alias("__first")).distinct()
    return names.withColumn("__first", F.substring_index(F.col(column), " ", 1)).join(first, ["book", "__first"], "left_semi").drop("__first")


def tag_of(before: Column, after: Column) -> Column:
    """Candidates for a tag in order of trust: `said X` and `X said` after the quote, `X said` before it."""
    trim = lambda c: F.nullif(F.regexp_replace(c, "^[ ,.'’-]+|[ ,.'’-]+$", ""), F.lit(""))
    return F.array(
        trim(F.regexp_extract(after, rf"^[\s,]*(?:{L.SAY})\s+({NAME})(?![\p{{L}}\p{{N}}_])", 1)),
        trim(F.regexp_extract(after, rf"^[\s,]*({NAME})\s+(?:{L.SAY})(?![\p{{L}}\p{{N}}_])", 1)),
        trim(F.regexp_extract(before, rf"(?<![\p{{L}}\p{{N}}_])({NAME})\s+(?:{L.SAY})\s*[.,!?]?\s*$", 1)),
    )


def tag_speakers(quotes: DataFrame, roster: DataFrame) -> DataFrame:
    """(book, id, tag): the first candidate whose first word the roster knows; null without one."""
    asked = quotes.select("book", "id", F.posexplode(tag_of(F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))).alias("p", "tag")).where("tag is not null")
    best = known_names(asked, roster).groupBy("book", "id").agg(F.min_by("tag", "p").alias("tag"))
    return quotes.select("book", "id").join(best, ["book", "id"], "left")


def _turn(state: tuple, row: tuple, same) -> tuple:
    """Two people taking turns: (last speaker, the other of the pair) after a row (tag, hint).

    A tag is trusted and takes its place before the last speaker; without one the other of
    the pair speaks, or, before there is a pair, whom the hint names.
    """
    (last, other), (tag, hint) = state, row
    if tag is not None:
        return (last, other) if last is not None and same(last, tag) else (tag, last)
    if other is not None:
        return (other, last)
    if last is None or hint is None:
        return (hint if last is None else last, None)
    return (last, None) if same(last, hint) else (hint, last)


def _in_turn(rows: DataFrame, group: list[str], inputs: list[str], starts: list[tuple], step, block: int | None) -> DataFrame:
    """rows with `speaker`, the first of the state after each row; step and starts as in symbolic_effect, the group starts in starts[0]."""

    def start_of(state):
        """Which of the starts a state is one of, and the names it has there."""
        for k, s in enumerate(starts):
            if all((x is None) == (y is None) for x, y in zip(s, state)):
                return k, {x.name: y for x, y in zip(s, state) if x is not None}
        raise ValueError(state)

    def values(table):
        return list(zip(*(table.column(c).to_pylist() for c in inputs)))

    def follow(does, state):
        k, names = start_of(starts[0] if state is None else tuple(state))
        return after_symbolic(does, k, names)

    def replay(table, state):
        state, said = starts[0] if state is None else tuple(state), []
        for row in values(table):
            state = step(state, row, operator.eq)
            said.append(state[0])
        return {"speaker": pa.array(said, pa.string())}

    return in_blocks(rows, group, ["id"], "speaker string", replay, lambda t: symbolic_effect(values(t), starts, step), follow, block)


_LAST, _OTHER = Unknown("last"), Unknown("other")


def alternate(quotes: DataFrame, block: int | None = None) -> DataFrame:
    """Speakers of quotes (book, run, id, tag, hint): tags first, two people taking turns between them.

    A run is a stretch without a scene break. What a block of a long run does to any pair
    that may enter it is told by a few states, so the run is followed in many tasks.
    """
    rows = quotes.select("book", "run", "id", "tag", "hint")
    return _in_turn(rows, ["book", "run"], ["tag", "hint"], [(None, None), (_LAST, None), (_LAST, _OTHER)], _turn, block).select("book", "id", "speaker")


def token_coref(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, token_id, coref): the last entity that covers a token."""
    cover = entities.select("doc_id", "coref", F.col("ent"), F.explode(F.sequence("start_token", "end_token")).alias("token_id"))
    return tokens.select("doc_id", "token_id").join(cover, ["doc_id", "token_id"]).groupBy("doc_id", "token_id").agg(F.max_by("coref", "ent").alias("coref"))


def coref_names(entities: DataFrame) -> DataFrame:
    """The most frequent proper mention of each coref id; the first seen wins ties."""
    n = entities.where("prop = 'PROP' and cat = 'PER'").groupBy("doc_id", "coref", "text").agg(F.count(F.lit(1)).alias("n"), F.min("start_token").alias("first"))
    return n.groupBy("doc_id", "coref").agg(F.max_by("text", F.struct(F.col("n"), -F.col("first"))).alias("name"))


def classify_quotes(quotes: DataFrame, tokens: DataFrame, reach: int = 4) -> DataFrame:
    """(doc_id, q, kind, coref): explicit, anaphoric or implicit by the distance and kind of the mention.

    quotes: (doc_id, q, quote_start, quote_end, mention_start, mention_end, mention_phrase, char_id),
    tokens: (doc_id, token_id, pos, fine_pos). A mention over `reach` tokens away, or none, is
    implicit and has no coref. The mention's first token, or else its last, tells whether
    it is a proper name; if neither is there, the phrase does.
    """
    kinds = tokens.select("doc_id", "token_id", ((F.col("pos") == "PROPN") | (F.col("fine_pos") == "NNP")).alias("__proper"))
    head, tail = kinds.toDF("doc_id", "mention_start", "__head"), kinds.toDF("doc_id", "mention_end", "__tail")
    near = F.least(F.abs(F.col("mention_start") - F.col("quote_end")), F.abs(F.col("quote_start") - F.col("mention_end")))
    far = F.col("mention_start").isNull() | F.col("mention_end").isNull() | F.coalesce(near > reach, F.lit(True))
    phrase = F.trim(F.coalesce("mention_phrase", F.lit("")))
    shaped = phrase.rlike("^\\p{Lu}") & ~F.lower(phrase).isin(L.PRONOUNS)
    named = F.coalesce("__head", "__tail", shaped)
    rows = quotes.join(head, ["doc_id", "mention_start"], "left").join(tail, ["doc_id", "mention_end"], "left")
    return rows.select("doc_id", "q", F.when(far, "implicit").when(named, "explicit").otherwise("anaphoric").alias("kind"), F.when(~far, F.col("char_id")).alias("coref"))


def vocatives(quotes: DataFrame, roster: DataFrame) -> DataFrame:
    """(book, id, vocs, addressee): roster names (book, name) that a quote addresses.

    A name, or its first word, counts after the start, a comma, semicolon, dash, question or
    exclamation mark or `my dear`, and before punctuation or the end. A quote that is
    nothing but a name addresses its bearer and lists the name last. Names are in
    alphabetical order; quotes that address nobody have no row. Words find their names
    without the text, which then joins only what they found.
    """
    first_run = lambda c: F.lower(F.regexp_extract(c, "(\\p{L}+)", 1))
    names = roster.select("book", "name", F.substring_index("name", " ", 1).alias("__first"), first_run(F.col("name")).alias("__k")).where("__k <> ''").distinct()
    names = cut(names)  # a roster is small, and joined by its real size
    text = F.trim(F.regexp_replace("text", "[“”]", ""))
    runs = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("(\\p{L}+)"), F.lit(1)), F.lower))
    found = quotes.select("book", "id", F.explode(runs).alias("__k")).join(names, ["book", "__k"]).select("book", "id", "name", "__first")
    rows = found.join(quotes.select("book", "id", text.alias("text")), ["book", "id"])
    either = F.concat(F.lit("(?:\\Q"), F.col("name"), F.lit("\\E|\\Q"), F.col("__first"), F.lit("\\E)"))
    called = F.regexp_like("text", F.concat(F.lit("(?:^|[,;!?—–-]\\s*|\\b[Mm]y dear\\s+)"), either, F.lit("\\s*(?:[,.!?;:—–-]|$)")))
    bare = F.lower(F.regexp_replace("text", "^[\\s.,!?—–\"'“”‘’-]+|[\\s.,!?—–\"'“”‘’-]+$", ""))
    alone = (bare == F.lower("name")) | (bare == F.lower("__first"))
    got = rows.groupBy("book", "id").agg(F.array_sort(F.collect_set(F.when(called, F.col("name")))).alias("vocs"), F.min(F.when(alone, F.col("name"))).alias("addressee"))
    listed = F.when(F.col("addressee").isNull() | F.array_contains("vocs", F.col("addressee")), F.col("vocs")).otherwise(F.concat("vocs", F.array("addressee")))
    return got.select("book", "id", listed.alias("vocs"), "addressee").where(F.size("vocs") > 0)


def _in_quotes(at: str, df: DataFrame, quotes: DataFrame, how: str) -> DataFrame:
    """Rows of df (doc_id, para, `at`) that a quote of their paragraph covers (left_semi) or none does (left_anti)."""
    q = quotes.select(F.col("doc_id").alias("__d"), F.col("para").alias("__p"), F.col("quote_start").alias("__s"), F.col("quote_end").alias("__e"))
    return df.join(q, (F.col("doc_id") == F.col("__d")) & (F.col("para") == F.col("__p")) & F.col(at).between(F.col("__s"), F.col("__e")), how)


def outside_mentions(entities: DataFrame, quotes: DataFrame) -> DataFrame:
    """Person mentions that begin in no quote of their paragraph."""
    return _in_quotes("start_token", entities.where("cat = 'PER'"), quotes, "left_anti")


def paragraph_context(tokens: DataFrame, quotes: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, q, beat, pfinal, bare) of quotes (doc_id, q, para, quote_start, quote_end).

    beat: the named person of the paragraph's one mention outside its quotes. pfinal: the
    last named mention before a quote that ends its paragraph, closing marks aside. bare: a
    paragraph without a word outside its quotes. tokens: (doc_id, para, token_id, pos),
    names: (doc_id, coref, name).
    """
    key = ["doc_id", "para"]
    told = outside_mentions(entities, quotes).join(names.select("doc_id", "coref", "name"), ["doc_id", "coref"], "left")
    told = told.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_token", "name"))).alias("__m"))
    words = tokens.where("pos <> 'PUNCT'")
    last = tokens.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("pos") != "PUNCT", F.col("token_id"))), F.max("token_id")).alias("__last"))
    spoken = _in_quotes("token_id", words, quotes, "left_anti").select(*key, F.lit(False).alias("__bare")).distinct()
    rows = quotes.join(told, key, "left").join(last, key, "left").join(spoken, key, "left")
    before = F.filter("__m", lambda m: (m["start_token"] < F.col("quote_start")) & m["name"].isNotNull())
    ends = F.col("quote_end") >= F.coalesce("__last", F.lit(-1))
    return rows.select(
        "doc_id", "q", F.when(F.size("__m") == 1, F.get("__m", 0)["name"]).alias("beat"),
        F.when(ends, F.try_element_at(before, F.lit(-1))["name"]).alias("pfinal"), (F.col("__last").isNotNull() & F.coalesce("__bare", F.lit(True))).alias("bare"),
    )


def span_overlap(unit_spans: DataFrame, quote_spans: DataFrame, block: int = 512) -> DataFrame:
    """(book, q, unit_id): the unit that overlaps a quote most; the first of equals."""
    cover = lambda df, s, e: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(s) / block), F.floor(F.col(e) / block))))
    u, q = cover(unit_spans, "start", "end"), cover(quote_spans, "qs", "qe")
    both = F.least("end", "qe") - F.greatest("start", "qs")
    rows = q.join(u, ["book", "__b"]).where(both > 0)
    return rows.groupBy("book", "q").agg(F.min_by("id", F.struct(-both, F.col("id"))).alias("unit_id"))


def text_speakers(docs: DataFrame) -> DataFrame:
    """First names in `Name said` and `said Name`."""
    name = r"[A-Z][a-zA-Z'’.\-]+"
    subject = F.regexp_extract_all("text", F.lit(rf"({name})(?:\s+{name})?\s+(?:{'|'.join(L.SAYS_AFTER)})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    inverted = F.regexp_extract_all("text", F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(L.SAYS_BEFORE)})\s+({name})"), F.lit(1))
    return docs.select("book", F.explode(F.concat(subject, inverted)).alias("n")).select("book", F.lower("n").alias("first_name")).distinct()


def learn_aliases(quotes: DataFrame, reach: int = 2) -> DataFrame:
    """(book, alias, name): a vocative answered by one tag only, at least twice, within `reach` paragraphs, and never a tag itself.

    quotes: (book, id, para, vocs, tag).
    """

    def add(rows, part):
        w = Window.partitionBy(*part).orderBy("__q")
        return rows.withColumn("__tag", F.lead("tag").over(w)).withColumn("__para", F.lead("para").over(w))

    rows = with_neighbours(running_total(quotes, ["book"], "para", "id", F.lit(1), "__q"), ["book"], "__q", 1, add).where(f"__tag is not null and __para - para <= {reach}")
    at = rows.select("book", F.explode("vocs").alias("alias"), "__tag").groupBy("book", "alias").agg(F.count(F.lit(1)).alias("n"), F.min("__tag").alias("name"), F.max("__tag").alias("__other"))
    tags = quotes.where("tag is not null").select("book", F.col("tag").alias("alias")).distinct()
    return at.where("n >= 2 and name = __other").select("book", "alias", "name").join(tags, ["book", "alias"], "left_anti")


def _not_addressed(name: Column) -> Column:
    return F.when(~F.array_contains(F.coalesce("vocs", F.array().cast("array<string>")), name), name)


def sieves(quotes: DataFrame) -> DataFrame:
    """quotes with `speaker`: the tag, else the paragraph's beat, the last vocative of the quote before in the run, the final mention.

    quotes: (book, run, id, para, tag, beat, pfinal, vocs). Nobody whom the quote itself
    addresses speaks it; tags stand.
    """

    def add(rows, part):
        w = Window.partitionBy(*part).orderBy("__q")
        near = (F.lag("run").over(w) == F.col("run")) & (F.col("para") - F.lag("para").over(w)).between(0, 2)
        return rows.withColumn("__voc", F.when(near, F.try_element_at(F.lag("vocs").over(w), F.lit(-1))))

    rows = with_neighbours(running_total(quotes, ["book"], "para", "id", F.lit(1), "__q"), ["book"], "__q", 1, add)
    return rows.withColumn("speaker", F.coalesce("tag", *[_not_addressed(F.col(c)) for c in ("beat", "__voc", "pfinal")])).drop("__voc", "__q")


def two_apart(quotes: DataFrame) -> DataFrame:
    """quotes with `speaker` filled in bare paragraphs from two paragraphs away, to the fixpoint.

    quotes: (book, run, id, para, speaker, bare, vocs). A paragraph with quotes must lie
    between; the earlier neighbour is asked first; nobody takes a line that addresses them.
    A stretch of open paragraphs, every second one, has one speaker before it and one
    after it, so it is settled at once: the former holds up to the first line that
    addresses them, the latter from behind the last line that addresses them, and where
    both could, the former does.
    """
    key = ["book", "run"]
    paras = quotes.groupBy(*key, "para").agg(F.min_by(F.struct("id", "speaker", "bare", "vocs"), "id").alias("q")).select(*key, "para", "q.*")
    paras = paras.withColumn("__free", F.col("speaker").isNull() & F.col("bare")).withColumn("__odd", F.pmod("para", F.lit(2)))

    def exactly(part, k, value):
        return F.max(value).over(Window.partitionBy(*part).orderBy("para").rangeBetween(k, k))

    def ends(rows, part):
        there = lambda k: exactly(part, k, F.lit(True)).isNotNull()
        beside = lambda k, c: F.when(there(k // 2), exactly(part, k, F.col(c)))
        return rows.withColumns({"__on": F.coalesce(beside(-2, "__free"), F.lit(False)), "__goes_on": F.coalesce(beside(2, "__free"), F.lit(False)), "__left": beside(-2, "speaker"), "__right": beside(2, "speaker")})

    paras = with_neighbours(paras, key, "para", 2, ends)
    stretch = [*key, "__odd", "__stretch"]
    free = running_total(paras.where("__free"), [*key, "__odd"], "para", "para", F.when(F.col("__on"), 0).otherwise(1), "__before")
    free = free.withColumn("__stretch", F.col("__before") + F.when(F.col("__on"), 0).otherwise(1)).select(*stretch, "para", "vocs", "__on", "__goes_on", "__left", "__right")
    sides = free.groupBy(*stretch).agg(F.max(F.when(~F.col("__on"), F.col("__left"))).alias("__l"), F.max(F.when(~F.col("__goes_on"), F.col("__right"))).alias("__r"))
    rows = free.join(sides, stretch)
    at = lambda side: F.when(F.array_contains("vocs", F.col(side)), F.col("para"))
    stops = rows.groupBy(*stretch).agg(F.min(at("__l")).alias("__l_stop"), F.max(at("__r")).alias("__r_stop"))
    filled = F.when(F.coalesce(F.col("para") < F.col("__l_stop"), F.lit(True)), F.col("__l")), F.when(F.coalesce(F.col("para") > F.col("__r_stop"), F.lit(True)), F.col("__r"))
    settled = rows.join(stops, stretch).select(*key, "para", F.coalesce(*filled).alias("__fill"))
    paras = paras.select(*key, "para", F.col("id").alias("__first"), "speaker").join(settled, [*key, "para"], "left").withColumn("__now", F.coalesce("speaker", "__fill"))

    def beside(rows, part):
        there = lambda k: exactly(part, k, F.lit(True)).isNotNull()
        return rows.withColumns({"__back": F.when(there(-1), exactly(part, -2, F.col("__now"))), "__then": F.when(there(1), exactly(part, 2, F.col("__now")))})

    around = with_neighbours(paras, key, "para", 2, beside).drop("speaker", "__now")
    rows = quotes.join(around, [*key, "para"], "left")
    later = F.coalesce(_not_addressed(F.col("__back")), _not_addressed(F.col("__then")))  # another quote of the same paragraph
    guess = F.when(F.col("bare"), F.when(F.col("id") == F.col("__first"), F.col("__fill")).otherwise(later))
    return rows.withColumn("speaker", F.coalesce("speaker", guess)).select(*quotes.columns)


def _run_turn(state: tuple, row: tuple, same) -> tuple:
    """The speaker after a row (speaker, vocs, addressee, parts): an untagged line goes to the most
    frequent participant who did not speak last, never to somebody whom the line addresses."""
    (last,), (speaker, vocs, addressee, parts) = state, row
    addressed = {*(vocs or ()), addressee}
    if len(parts) < 2:  # one known voice and an unnamed other
        return (parts[0] if parts else None,) if speaker is None and not vocs and last is None else (speaker,)
    if speaker is not None and speaker not in addressed:
        return (speaker,)
    may = [p for p in parts if p not in addressed] or parts
    return (may[1] if len(may) > 1 and last is not None and same(last, may[0]) else may[0],)


def alternate_run(quotes: DataFrame, block: int | None = None) -> DataFrame:
    """(book, run, id, speaker): what the other sieves leave open alternates among the run's participants.

    quotes: (book, run, id, speaker, vocs, addressee). Participants are all speakers of the
    run by their number of lines, then those who are only addressed, the first seen first.
    A speaker whom the own line addresses is taken back. With fewer than two participants
    the known one alternates with an unnamed other (null).
    """
    key = ["book", "run"]
    spoke = quotes.where("speaker is not null").select(*key, F.col("speaker").alias("name"), F.lit(1).alias("n"), "id", F.lit(-1).alias("at"))
    called = F.array_compact(F.concat(F.coalesce("vocs", F.array().cast("array<string>")), F.array("addressee")))
    heard = quotes.select(*key, "id", F.posexplode(called).alias("at", "name")).select(*key, "name", F.lit(0).alias("n"), "id", "at")
    rank = spoke.unionByName(heard).groupBy(*key, "name").agg((-F.sum("n")).alias("m"), F.min(F.struct(F.when(F.col("n") == 0, F.lit(1)).otherwise(0).alias("k"), F.col("id"), F.col("at"))).alias("first"))
    parts = rank.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "first", "name"))), lambda p: p["name"]).alias("parts"))
    rows = quotes.select(*key, "id", F.col("speaker").alias("__s"), "vocs", "addressee").join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    return _in_turn(rows, key, ["__s", "vocs", "addressee", "parts"], [(None,), (_LAST,)], _run_turn, block).select(*key, "id", "speaker")


def resolve_runs(quotes: DataFrame) -> DataFrame:
    """(book, run, id, speaker) of marked quotes: tags, sieves, the two-apart pattern, then alternation."""
    return alternate_run(two_apart(sieves(quotes)))


def speaking_names(names: DataFrame, agents: DataFrame) -> DataFrame:
    """Names shaped like a person's that speak; a document without any signal keeps all."""
    rows = names.where(X.name_shaped(F.col("name"))).join(agents.select("doc_id", "coref", F.lit(True).alias("__a")), ["doc_id", "coref"], "left")
    some = agents.select("doc_id", F.lit(True).alias("__some")).distinct()
    return rows.join(some, "doc_id", "left").where("__a or __some is null").select("doc_id", "coref", "name")
