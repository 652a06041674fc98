"""Which names are one character: evidence, verdicts, components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators.evidence import evidence_lines
from parlance.operators.graph import connected
from parlance.operators.units import cast_line, companions, excerpts, in_scene, partner_text, resolve_at
from parlance.sources.tables import cut

#: Evidence rules in the order in which they are tried.
RULES = ("title", "nick", "surname", "bigram", "narration")


def name_pairs(cast: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(book, a, b, rule) with a < b: names that may be one person, by equal keys only; the first rule that fires."""
    p = X.name_parts(F.col("name"))
    n = cast.select("book", "name", p["bare"].alias("bare"), p["single"].alias("single"), p["last"].alias("last")).where("bare is not null")
    n = cut(n)  # a cast is small and joined several times
    l, r = n.toDF(*["book", *[f"l_{c}" for c in n.columns[1:]]]), n.toDF(*["book", *[f"r_{c}" for c in n.columns[1:]]])

    def found(pairs: DataFrame, rule: str) -> DataFrame:
        return pairs.where("l_name <> r_name").select("book", F.least("l_name", "r_name").alias("a"), F.greatest("l_name", "r_name").alias("b"), F.lit(RULES.index(rule)).alias("rule"))

    title = found(l.withColumn("k", F.col("l_bare")).join(r.withColumn("k", F.col("r_bare")), ["book", "k"]), "title")
    one = lambda side: ~F.contains(f"{side}_bare", F.lit(" "))
    head = lambda side: F.substring(f"{side}_bare", 1, 3)
    nick = found(l.where(one("l")).withColumn("k", head("l")).join(r.where(one("r")).withColumn("k", head("r")), ["book", "k"]).where(X.is_nick(F.col("l_bare"), F.col("r_bare"))), "nick")
    surname = found(l.withColumn("k", F.col("l_last")).join(r.withColumn("k", F.explode(F.array_compact(F.array("r_last", "r_single")))), ["book", "k"]), "surname")
    often = bigrams.where("n >= 2").select("book", F.col("first").alias("l_single"), F.col("last").alias("r_last"))
    bigram = found(l.join(often, ["book", "l_single"]).join(r, ["book", "r_last"]), "bigram")
    every = title.union(nick).union(surname).union(bigram)
    return every.groupBy("book", "a", "b").agg(F.min("rule").alias("rule")).withColumn("rule", F.get(F.array(*[F.lit(x) for x in RULES]), "rule"))


def evidence(*tables: DataFrame) -> DataFrame:
    """All rules that speak for each unordered pair."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("book", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def reveal_pairs(reveals: DataFrame) -> DataFrame:
    """(book, a, b): names that a reveal (book, alias, real, at, seq) turns into one another in the end."""
    names = reveals.select("book", F.col("alias").alias("speaker")).union(reveals.select("book", "real")).distinct()
    ends = resolve_at(names.withColumns({"id": F.lit(0).cast("long"), "para": F.lit(2**62)}), reveals)
    other = X.name_key(F.col("who"), True) != X.name_key(F.col("speaker"), True)
    return ends.where(other).select("book", F.least("speaker", "who").alias("a"), F.greatest("speaker", "who").alias("b")).distinct()


def askable_pairs(pairs: DataFrame, cast: DataFrame, veto: DataFrame, revealed: DataFrame | None = None, main: int = 100, few: int = 5) -> DataFrame:
    """Pairs worth deciding: not two main characters, no tiny entry with a surname but without a bigram, none that is revealed later or vetoed.

    The smaller entry is the one with fewer lines, of equals the later by name. veto and
    revealed (book, a, b) count in either order.
    """
    lines = cast.select("book", "name", "lines")
    rows = pairs.join(lines.toDF("book", "a", "a_lines"), ["book", "a"]).join(lines.toDF("book", "b", "b_lines"), ["book", "b"])
    big, small = F.greatest("a_lines", "b_lines"), F.least("a_lines", "b_lines")
    tiny = F.when(F.col("a_lines") < F.col("b_lines"), F.col("a")).otherwise(F.col("b"))
    has_surname = F.coalesce(X.name_parts(tiny)["last"].isNotNull(), F.lit(False))
    rows = rows.where(~((big >= main) & (small >= main)) & ~((small <= few) & has_surname & ~F.array_contains("rules", "bigram")))
    for gone in (veto, revealed):
        if gone is not None:
            rows = rows.join(gone.select("book", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["book", "a", "b"], "left_anti")
    return rows


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A missing verdict is `different`."""
    return pairs.join(verdicts.select("book", "a", "b", "verdict"), ["book", "a", "b"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("different")))


def nickname_merges(cast: DataFrame, support: DataFrame, veto: DataFrame, revealed: DataFrame | None = None, small: int = 30) -> DataFrame:
    """(book, alias, name) without verdicts: small single names that are short forms of a bigger single one which narration supports.

    cast: (book, name, lines, first); of several names the one seen first is taken.
    """
    one = cast.select("book", "name", "lines", "first", X.name_parts(F.col("name"))["single"].alias("single")).where("single is not null")
    short = one.select("book", F.col("name").alias("alias"), F.col("lines").alias("al"), F.col("single").alias("short"))
    rows = support.where("n >= 2").select("book", "alias", "name").join(short, ["book", "alias"]).join(one, ["book", "name"])
    good = rows.where((F.col("al") <= small) & (F.col("lines") > F.col("al")) & X.is_nick(F.col("short"), F.col("single")))
    for gone in (veto, revealed):
        if gone is not None:
            both = gone.select("book", F.col("a").alias("alias"), F.col("b").alias("name")).union(gone.select("book", "b", "a")).distinct()
            good = good.join(both, ["book", "alias", "name"], "left_anti")
    return good.groupBy("book", "alias").agg(F.min_by("name", F.struct("first", "name")).alias("name"))


def _loop_ends(t: pa.Table) -> pa.Table:
    """Where names that lead into a cycle end: before the walk would meet a name again."""
    after = {r["alias"]: r["final"] for r in t.to_pylist()}
    end: dict[str, str] = {}
    for start in after:
        path, place, at = [], {}, start
        while at not in end and at not in place:
            place[at] = len(path)
            path.append(at)
            at = after[at]
        if at in place:  # a new cycle: each of its names ends at the one before it
            loop = path[place[at] :]
            end |= {n: loop[k - 1] for k, n in enumerate(loop)}
            path, last = path[: place[at]], loop[-1]
        else:
            last = end[at]
        end |= {n: last for n in path}
    names = sorted(after)
    return pa.table({"book": pa.array([t["book"][0].as_py()] * len(names), pa.string()), "alias": pa.array(names, pa.string()), "final": pa.array([end[n] for n in names], pa.string())})


def resolve_aliases(links: DataFrame) -> DataFrame:
    """(book, alias, final): chains of alias -> name followed to their end; a cycle ends before it meets a name again.

    An alias has one name, the smallest. Pointer jumping: each round doubles the distance
    followed, until a round settles no more chains; what is open then leads into a cycle
    and is walked book by book.
    """
    first = cut(links.where((F.col("alias") != F.col("name")) & X.is_name(F.col("name"))).groupBy("book", "alias").agg(F.min("name").alias("final")))
    now, before, still = first.withColumn("__open", F.lit(True)), None, -1
    while still != before and still != 0:
        step = now.select("book", F.col("alias").alias("final"), F.col("final").alias("__next"))
        far = now.join(step, ["book", "final"], "left")
        now = cut(far.select("book", "alias", F.coalesce("__next", "final").alias("final"), F.col("__next").isNotNull().alias("__open")))
        before, still = still, now.where("__open").count()
    ended = now.where("not __open").select("book", "alias", "final")
    if not still:
        return ended
    loops = first.join(now.where("__open").select("book", "alias"), ["book", "alias"], "left_semi").select("book", "alias", "final")
    return ended.unionByName(loops.groupBy("book").applyInArrow(_loop_ends, "book string, alias string, final string"))


def _linked(links: DataFrame) -> DataFrame:
    """(book, name, part): the smallest name that links (book, a, b, ..) reach from each name."""
    return connected(links, ["book"]).withColumnRenamed("node", "name")


def _fold_links(t: pa.Table) -> pa.Table:
    """Links of one part in their order: all of a's names go over to b and take b's display."""
    group: dict[str, dict] = {}
    for r in sorted(t.to_pylist(), key=lambda r: tuple(r["seq"].values())):
        x, y = (group.setdefault(n, {"names": [n], "display": n}) for n in (r["a"], r["b"]))
        if x is y:
            continue
        small, big = sorted((x, y), key=lambda g: len(g["names"]))
        big["display"] = y["display"]
        big["names"] += small["names"]
        for n in small["names"]:
            group[n] = big
    names = sorted(group)
    return pa.table({"book": pa.array([t["book"][0].as_py()] * len(names), pa.string()), "name": pa.array(names, pa.string()), "display": pa.array([group[n]["display"] for n in names], pa.string())})


def identities(links: DataFrame) -> DataFrame:
    """(book, name, key, display, char_id): names that links (book, a, b, seq) make one person; b is the better known one.

    Names are told apart by their key (lower case, letters a-z, digits and blanks), so that
    spellings in other cases or with marks are one name; it is shown as it is first spelled,
    in the order of seq, then a, b. Names without a key link nothing. char_id is a hash of
    the book and the key shown. Where each key is at most once an `a` and there is no cycle,
    the key that is never an `a` is shown; only other parts are folded in the order of seq.
    """
    key = lambda c: X.name_key(F.col(c), True)
    asked = cut(links.select("book", "a", "b", F.col("seq").cast("long").alias("seq"), key("a").alias("ka"), key("b").alias("kb")))
    seen = [asked.select("book", F.col(f"k{x}").alias("key"), F.col(x).alias("name"), F.struct("seq", "a", "b", F.lit(x).alias("side")).alias("at")) for x in "ab"]
    spelled = cut(seen[0].unionByName(seen[1]).where("key <> ''").groupBy("book", "key", "name").agg(F.min("at").alias("at")))
    first = spelled.groupBy("book", "key").agg(F.min_by("name", "at").alias("shown"))
    links = cut(asked.where("ka <> '' and kb <> '' and ka <> kb").groupBy("book", F.col("ka").alias("a"), F.col("kb").alias("b")).agg(F.min(F.struct("seq", F.col("a").alias("x"), F.col("b").alias("y"))).alias("seq")))
    names = cut(_linked(links).join(links.groupBy("book", F.col("a").alias("name")).agg(F.count(F.lit(1)).alias("__n")), ["book", "name"], "left"))
    parts = cut(names.groupBy("book", "part").agg(F.max("__n").alias("__most"), F.min(F.when(F.col("__n").isNull(), F.col("name"))).alias("display")))
    plain = "__most = 1 and display is not null"
    chains = names.join(parts.where(plain), ["book", "part"]).select("book", "name", "display")
    folded = links.join(names.select("book", F.col("name").alias("a"), "part"), ["book", "a"]).join(parts.where(f"not ({plain})").select("book", "part"), ["book", "part"])
    folded = folded.select("book", "part", "a", "b", F.struct("seq.seq", "seq.x", "seq.y").alias("seq")).groupBy("book", "part").applyInArrow(_fold_links, "book string, name string, display string")
    ends = chains.unionByName(folded).withColumnRenamed("name", "key").withColumnRenamed("display", "end")
    known = spelled.select("book", "key", "name").join(ends, ["book", "key"], "left").withColumn("end", F.coalesce("end", "key"))
    shown = known.join(first.select("book", F.col("key").alias("end"), F.col("shown").alias("display")), ["book", "end"])
    return shown.select("book", "name", "key", "display", F.xxhash64("book", "end").alias("char_id"))


def _fold_joins(t: pa.Table) -> pa.Table:
    """One part's names joined by its accepted pairs in their order; a pair is passed over if it would bring
    two established names or names of a `different` pair together. Sets of the smaller side move, so that
    the work is about linear in names, pairs and `different` pairs."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["kind"], r["w"], r["a"], r["b"] or ""))
    lines = {r["a"]: r["w"] for r in rows if r["kind"] == "n"}
    known = {r["a"]: r["established"] for r in rows if r["kind"] == "n"}
    of = {n: n for n in lines}
    members = {n: [n] for n in lines}
    apart: dict[str, set] = {n: set() for n in lines}
    for r in (r for r in rows if r["kind"] == "d"):
        apart[r["a"]].add(r["b"])
        apart[r["b"]].add(r["a"])
    for r in (r for r in rows if r["kind"] == "s"):
        x, y = of[r["a"]], of[r["b"]]
        if x == y or (known[x] and known[y]) or y in apart[x]:
            continue
        if len(members[x]) + len(apart[x]) > len(members[y]) + len(apart[y]):
            x, y = y, x
        for n in members[x]:
            of[n] = y
        members[y] += members.pop(x)
        known[y] = known[y] or known[x]
        for z in apart.pop(x):
            apart[z].discard(x)
            apart[z].add(y)
            apart[y].add(z)
    best = {y: max(ns, key=lambda n: (lines[n], n)) for y, ns in members.items()}
    names = sorted(lines)
    return pa.table({"book": pa.array([t["book"][0].as_py()] * len(names), pa.string()), "name": pa.array(names, pa.string()), "group": pa.array([best[of[n]] for n in names], pa.string())})


def components(cast: DataFrame, same: DataFrame, different: DataFrame, established: int = 30) -> DataFrame:
    """(book, name, group): accepted pairs (book, a, b, seq) joined in the order of seq, a, b; a group is named by its name of most lines.

    A join is undone if it would bring two established characters or a `different` pair
    together. Groups only grow, so where a whole part that the pairs connect holds neither
    two established names nor both names of a `different` pair, nothing in it can have been
    undone: such parts, over all books, are found by rounds of joins. Only the other parts
    are folded in order, each on its own. Pairs with a name outside the cast count nothing.
    """
    names = cut(cast.select("book", "name", "lines"))
    inside = lambda df, *more: df.select("book", "a", "b", *more).where("a <> b").join(names.select("book", F.col("name").alias("a")), ["book", "a"], "left_semi").join(names.select("book", F.col("name").alias("b")), ["book", "b"], "left_semi")
    links = cut(inside(same, F.col("seq").cast("long").alias("seq")))
    parts = cut(names.join(_linked(links), ["book", "name"], "left").withColumn("part", F.coalesce("part", "name")))
    at = lambda c: parts.select("book", F.col("name").alias(c), F.col("part").alias(f"p_{c}"))
    apart = cut(inside(different).join(at("a"), ["book", "a"]).join(at("b"), ["book", "b"]).where("p_a = p_b").select("book", "a", "b", F.col("p_a").alias("part")).distinct())
    crowded = parts.groupBy("book", "part").agg(F.count_if(F.col("lines") >= established).alias("n")).where("n > 1").select("book", "part")
    torn = cut(crowded.unionByName(apart.select("book", "part")).distinct())
    whole = parts.join(torn, ["book", "part"], "left_anti")
    big = whole.groupBy("book", "part").agg(F.max_by("name", F.struct("lines", "name")).alias("group"))
    free = whole.join(big, ["book", "part"]).select("book", "name", "group")
    none = F.lit(None).cast("string").alias("b")
    rows = parts.join(torn, ["book", "part"], "left_semi").select("book", "part", F.lit("n").alias("kind"), F.col("name").alias("a"), none, F.col("lines").alias("w"), (F.col("lines") >= established).alias("established"))
    rows = rows.unionByName(links.join(at("a"), ["book", "a"]).select("book", F.col("p_a").alias("part"), F.lit("s").alias("kind"), "a", "b", F.col("seq").alias("w"), F.lit(False).alias("established")).join(torn, ["book", "part"], "left_semi"))
    rows = rows.unionByName(apart.select("book", "part", F.lit("d").alias("kind"), "a", "b", F.lit(0).cast("long").alias("w"), F.lit(False).alias("established")))
    return free.unionByName(rows.groupBy("book", "part").applyInArrow(_fold_joins, "book string, name string, group string"))


def canonical_names(groups: DataFrame, cast: DataFrame, bigrams: DataFrame, main: int = 100, least: int = 5) -> DataFrame:
    """Each group's name: its biggest if that is a main character, else the most used full name, else the biggest."""
    rows = groups.join(cast.select("book", "name", "lines"), ["book", "name"])
    big = rows.groupBy("book", "group").agg(F.max_by("name", F.struct("lines", "name")).alias("big"), F.max("lines").alias("most"))
    single = rows.select("book", "group", X.name_parts(F.col("name"))["single"].alias("first")).where("first is not null")
    full = single.join(bigrams.where(F.col("n") >= least), ["book", "first"]).groupBy("book", "group").agg(F.max_by("surface", F.struct("n", "surface")).alias("full"))
    return big.join(full, ["book", "group"], "left").select("book", "group", F.when(F.col("most") >= main, F.col("big")).otherwise(F.coalesce("full", "big")).alias("name"))


def reassign(units: DataFrame, moves: DataFrame, cast: DataFrame, radius: int = 25) -> DataFrame:
    """(book, id, speaker): units with line verdicts (book, id, name) applied.

    `keep`, the same name, names outside the cast and names that are not in the scene
    change nothing; a line may always go to Unknown. Of several verdicts for a line the
    first by name counts.
    """
    asked = moves.where(F.lower("name") != "keep")
    known = in_scene(asked.join(cast.select("book", "name"), ["book", "name"], "left_semi"), units, radius)
    ok = known.unionByName(asked.where("name = 'Unknown'")).groupBy("book", "id").agg(F.min("name").alias("__to"))
    rows = units.join(ok, ["book", "id"], "left")
    same = X.name_key(F.col("__to"), True) == X.name_key(F.col("speaker"), True)
    return rows.select("book", "id", F.when(same, F.col("speaker")).otherwise(F.coalesce("__to", "speaker")).alias("speaker"))


def suspects(cast: DataFrame, pairs: DataFrame, merged: DataFrame, few: int = 5) -> DataFrame:
    """Flagged names with few lines and a surname that were not merged."""
    flagged = pairs.select("book", F.explode(F.array("a", "b")).alias("name")).distinct()
    rows = cast.join(flagged, ["book", "name"], "left_semi").join(merged.select("book", "name"), ["book", "name"], "left_anti")
    return rows.where((F.col("lines") <= few) & X.name_parts(F.col("name"))["last"].isNotNull()).select("book", "name", "lines")


def briefings(pairs: DataFrame, units: DataFrame, cast: DataFrame) -> DataFrame:
    """(book, a, b, briefing): what an external judge reads about a pair (book, a, b, rules).

    The cast, then for each entry its lines, its companions and excerpts around its evidence
    lines (four each; a's lie far from b's where they can), and why the pair was flagged.
    """
    sides = lambda x, y, spread: evidence_lines(units, pairs.select("book", F.col(x).alias("name"), F.col(y).alias("other")), 4, spread).withColumn("side", F.lit(x))
    lines = cut(sides("a", "b", True).unionByName(sides("b", "a", False)))
    cuts = lines.join(excerpts(units, lines.select("book", "id").distinct()).withColumnRenamed("centre", "id"), ["book", "id"])
    shown = cuts.groupBy("book", "side", "name", "other").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "excerpt"))), lambda x: F.concat(F.lit("--- around line "), x["id"].cast("string"), F.lit(":\n"), x["excerpt"])), "\n").alias("t"))
    near = partner_text(companions(units))
    out = pairs.join(cast_line(cast), "book")
    for side, other in (("a", "b"), ("b", "a")):
        own = shown.where(F.col("side") == side).select("book", F.col("name").alias(side), F.col("other").alias(other), F.col("t").alias(f"t_{side}"))
        met = near.select("book", F.col("name").alias(side), F.col("partners").alias(f"p_{side}"))
        out = out.join(cast.select("book", F.col("name").alias(side), F.col("lines").alias(f"n_{side}")), ["book", side], "left").join(met, ["book", side], "left").join(own, ["book", "a", "b"], "left")
    entry = lambda x: F.concat(F.lit(f"Entry {x.upper()}: "), F.col(x), F.lit(" ("), F.coalesce(F.col(f"n_{x}"), F.lit(0)).cast("string"), F.lit(" lines); shares scenes with "), F.coalesce(F.col(f"p_{x}"), F.lit("nobody")))
    told = lambda x: F.concat(F.lit(f"Excerpts of {x.upper()}:\n"), F.coalesce(F.col(f"t_{x}"), F.lit("")))
    text = F.concat_ws("\n", F.concat(F.lit("Cast: "), F.col("cast_line")), entry("a"), entry("b"), F.concat(F.lit("Flagged by: "), F.array_join("rules", "; ")), told("a"), told("b"))
    return out.select("book", "a", "b", text.alias("briefing"))


def line_briefings(suspects: DataFrame, units: DataFrame, cast: DataFrame) -> DataFrame:
    """(book, name, briefing): every line of a suspect entry (book, name, lines) with what stands around it."""
    own = units.where("kind = 'dialogue'").join(suspects.select("book", F.col("name").alias("speaker")), ["book", "speaker"], "left_semi").select("book", "id", F.col("speaker").alias("name"))
    cuts = own.join(excerpts(units, own.select("book", "id"), 4).withColumnRenamed("centre", "id"), ["book", "id"])
    shown = cuts.groupBy("book", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "excerpt"))), lambda x: F.concat(F.lit("--- line "), x["id"].cast("string"), F.lit(":\n"), x["excerpt"])), "\n").alias("t"))
    rows = suspects.join(cast_line(cast), "book").join(shown, ["book", "name"])
    text = F.concat_ws("\n", F.concat(F.lit("Cast: "), F.col("cast_line")), F.concat(F.lit("Suspect entry: "), F.col("name"), F.lit(" ("), F.col("lines").cast("string"), F.lit(" lines)")), F.col("t"))
    return rows.select("book", "name", text.alias("briefing"))
