"""Queries on layout, attribution, cast resolution and candidate validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.functions import text as X
from parlance.operators import attribution as A
from parlance.operators import cast as C
from parlance.operators import layout as Y
from parlance.operators import units as U
from parlance.operators import validate as D
from parlance.plans import views as V
from parlance.sources.tables import cut

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


units = V.book_units


def layout(s, d):
    """Documents as pages: a line is a block, twelve words a printed line, some of them indented or far apart."""
    w = V.doc_lines(s, d).where("length(line) > 0").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.col("line_no").alias("block"), F.posexplode(F.split("line", " ")).alias("p", "word"))
    line, wno = F.floor(F.col("p") / 12), F.col("p") % 12
    x0 = wno * 40 + F.when((wno == 0) & (line % 5 == 3), 15).otherwise(0) + 50
    y0 = F.col("block") * 1000 + line * 14 + F.when(line > 6, 30).otherwise(0)
    return w.select("book", "page", "block", line.alias("line"), wno.cast("long").alias("wno"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 35).cast("double").alias("x1"), (y0 + 10).cast("double").alias("y1"), "word")


_LAYOUT = V.LINES + """, w0 as (select source as book, doc_id as page, line_no as block, unnest(range(len(string_split(line, ' ')))) as p,
  unnest(string_split(line, ' ')) as word from doc_lines where length(line) > 0),
w as (select book, page, block, p // 12 as line, p % 12 as wno, (p % 12 * 40 + case when p % 12 = 0 and p // 12 % 5 = 3 then 15 else 0 end + 50)::double as x0,
  (block * 1000 + p // 12 * 14 + case when p // 12 > 6 then 30 else 0 end)::double as y0, word from w0)"""
add("src_layout", lambda s, d: Y.layout_words(layout(s, d)).select("book", "page", "block", "line", "wno", "word"), f"with {_LAYOUT} select book, page, block, line, wno, word from w where trim(word) <> ''")
add(
    "seg_para", lambda s, d: Y.paragraphs(layout(s, d)).select("book", "page", "block", "line", "para"),
    f"""with {_LAYOUT}, l as (select book, page, block, line, min(x0) as x0, min(y0) as top, max(y0 + 10) as bottom from w where trim(word) <> '' group by all),
o as (select *, row_number() over pg as pos, lag(bottom) over pg as pb, lag(block) over pg as pblock from l window pg as (partition by book, page order by block, line)),
m as (select book, page, x as margin from (select book, page, round(x0) as x, row_number() over (partition by book, page order by count(*) desc, min(pos)) as r
  from o group by book, page, round(x0)) where r = 1)
select book, page, block, line, cast(sum(case when pos > 1 and (x0 > margin + 6.0 or top - pb > 16.0 or block <> pblock) then 1 else 0 end) over (partition by book, page order by block, line) as bigint) as para from o join m using (book, page)""",
)
_END = "regexp_matches(b, '[.!?]$') and not regexp_matches(b, '(?i)(^|[^\\p{L}\\p{N}_])(?:" + L.ABBREVIATIONS + ")\\.$')"
add(
    "seg_units", lambda s, d: Y.units(layout(s, d)),
    f"""with recursive para as ({ORACLES['seg_para']}), v as (select * from ({f"with {_LAYOUT} select * from w"})),
k as (select v.book, v.page, para, word, row_number() over (partition by v.book, v.page, para order by v.block, v.line, wno) as i, regexp_replace(word, '[”’»"'')]+$', '') as b
  from v join para on para.book = v.book and para.page = v.page and para.block = v.block and para.line = v.line where trim(word) <> ''),
c as (select *, regexp_matches(word, '^[{L.OPENING}"]') as opens, regexp_matches(word, '[{L.CLOSING}]\\s*$') as closing, regexp_matches(word, '"\\s*$') as straight, {_END} as ends from k),
l as (select book, page, para, list({{'w': word, 'o': opens, 'c': closing, 's': straight, 'e': ends}} order by i) as ws from c group by all),
r as (select book, page, para, ws, 0 as i, false as q, 0 as unit, true as done, false as said from l
  union all
  select book, page, para, ws, i + 1, case when q or x.o then not (x.c or x.s and (q or length(x.w) > 1)) else false end,
    unit + case when done or (not q and x.o) then 1 else 0 end,
    case when q or x.o then x.c or x.s and (q or length(x.w) > 1) else x.e end, q or x.o
  from (select *, ws[i + 1] as x from r where i < len(ws))),
u as (select book, page, para, unit, any_value(said) as q, trim(string_agg(ws[i].w, ' ' order by i)) as t from r where i > 0 group by 1, 2, 3, 4),
f as (select *, case when q then trim(regexp_replace(t, '^[{L.OPENING}{L.CLOSING}"]+|[{L.OPENING}{L.CLOSING}"]+$', '', 'g')) else t end as text from u)
select book, page, para, (row_number() over (partition by book, page, para order by unit) - 1)::int as n, case when q then 'dialogue' else 'narration' end as kind, text from f where text <> ''""",
)


def _quote_spans(s, d):
    return U.build_document(units(s, d)).select("book", F.col("id").alias("q"), (F.col("start") - 10).alias("qs"), (F.col("end") - 5).alias("qe"))


add(
    "join_span_overlap", lambda s, d: A.span_overlap(U.build_document(units(s, d)), _quote_spans(s, d)),
    f"""with {V.UNITS}, n as (select *, length(text) + case when kind = 'dialogue' then 2 else 0 end as len, lag(para) over (partition by book
  order by id) as pp from units), e as (select *, case when pp is null then 0 when pp = para then 1 else 2 end as sep from n),
sp as (select book, id, sum(len + sep) over w - len as s, sum(len + sep) over w as e from e window w as (partition by book order by id)),
o as (select q.book, q.id as q, u.id, least(u.e, q.e - 5) - greatest(u.s, q.s - 10) as ov from sp q join sp u on u.book = q.book and u.id between q.id - 20 and q.id + 20)
select book, q, id as unit_id from (select *, row_number() over (partition by book, q order by ov desc, id) as r from o where ov > 0) where r = 1""",
)

def over(name: str, fn, sql: str | None = None) -> None:
    """A query over the units, which are written once and read by all of its parts."""
    add(name, lambda s, d: fn(cut(units(s, d))), sql)


def cast(u):
    return U.cast_counts(u)


def _grams(u):
    """Two-word names where every speaker is said to speak, and where the Vales are told of."""
    told = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" Tam Vale "), F.col("text"))).otherwise(F.col("text"))
    return U.name_bigrams(u.withColumn("text", F.concat(F.col("speaker"), F.lit(" said."), told)))


def pairs(u):
    return C.name_pairs(cast(u), _grams(u))


def told(u):
    """Units with narration that names Tamsin here and there."""
    text = F.when((F.col("kind") == "narration") & (F.col("id") % 5 == 0), F.concat(F.lit("Then Tamsin spoke. "), F.col("text"))).otherwise(F.col("text"))
    return u.withColumn("text", text)


def _short(pairs):
    """(book, alias, name): short forms among pairs and what they may stand for."""
    return pairs.where("rule = 'nick'").select("book", F.when(F.length("a") < F.length("b"), F.col("a")).otherwise(F.col("b")).alias("alias"), F.when(F.length("a") < F.length("b"), F.col("b")).otherwise(F.col("a")).alias("name"))


def support(u, found=None):
    """Aliases that narration supports, of the pairs found (by default searched for)."""
    return U.narration_support(U.near_narration(told(u), _short(pairs(u) if found is None else found)), cast(u), small=10**6)


_TITLES = "[" + ", ".join(f"'{t}'" for t in L.TITLES) + "]"


def _nick(short: str, long: str) -> str:
    ends = " or ".join(f"({short} like '%{e}' and length({short}) - {len(e)} >= 3 and starts_with({long}, left({short}, length({short}) - {len(e)})))" for e in L.NICK_ENDINGS)
    return f"(length({short}) < length({long}) and ({ends}))"


CAST = f"""{V.UNITS}, c as (select book, speaker as name, count(*) as lines, min(id) as first from units where kind = 'dialogue' group by 1, 2),
g as (select book, id, unnest(range(len(m))) as place, unnest(m) as surface from (select book, id, regexp_extract_all(speaker || ' said.' || case
  when id % 3 = 0 then ' Tam Vale ' || text else text end, '\\b([A-Z][a-zA-Z''’-]+ [A-Z][a-zA-Z''’-]*[a-zA-Z])(?:$|[^\\p{{L}}\\p{{N}}_])', 1) as m from units)),
g2 as (select *, regexp_replace(lower(string_split(surface, ' ')[1]), '[^a-z0-9 ]', '', 'g') as first, regexp_replace(lower(string_split(surface, ' ')[2]),
  '[^a-z0-9 ]', '', 'g') as last from g),
grams as (select book, first, last, count(*) as n, arg_min(surface, (id, place)) as surface from g2 where first <> '' and last <> ''
  and not list_contains({_TITLES}, first) and not list_contains({_TITLES}, last) group by 1, 2, 3),
w as (select *, list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')), ' '), lambda x: x <> '') as t from c),
l as (select *, coalesce(list_min(list_filter(range(1, len(t) + 1), lambda i: not list_contains({_TITLES}, t[i]))), len(t) + 1) as k from w),
parts as (select book, name, lines, first, array_to_string(t[k:], ' ') as bare, case when len(t[k:]) = 1 and k = 1 then t[k] end as single, case
  when len(t[k:]) > 1 or k > 1 then t[-1] end as last from l where len(t[k:]) between 1 and 3),
rules as (select a.book, a.name as a, b.name as b, case when a.bare = b.bare then 'title'
    when not contains(a.bare, ' ') and not contains(b.bare, ' ') and ({_nick('a.bare', 'b.bare')} or {_nick('b.bare', 'a.bare')}) then 'nick'
    when a.last = b.last or a.last = b.single or b.last = a.single then 'surname'
    when exists (select 1 from grams g where g.book = a.book and g.n >= 2 and ((g.first = a.single and g.last = b.last) or (g.first = b.single
  and g.last = a.last))) then 'bigram' end as rule
  from parts a join parts b on a.book = b.book and a.name < b.name),
pairs as (select * from rules where rule is not null),
short as (select book, case when length(a) < length(b) then a else b end as alias, case when length(a) < length(b) then b else a end as name from pairs where rule = 'nick'),
told as (select book, id, kind, speaker, case when kind = 'narration' and id % 5 = 0 then 'Then Tamsin spoke. ' || text else text end as text from units),
near as (select distinct s.book, s.alias, s.name, a.id from short s join told a on a.book = s.book and a.speaker = s.alias and a.kind = 'dialogue'
  join told b on b.book = a.book and b.kind = 'narration' and b.id between a.id - 2 and a.id + 2
  where list_contains(string_split_regex(b.text, '[^\\p{{L}}\\p{{N}}_]+'), s.name)),
support as (select n.book, n.alias, n.name, count(*) as n from near n join c x on x.book = n.book and x.name = n.alias join c y on y.book = n.book and y.name = n.name
  where y.lines > x.lines and lower(left(n.alias, 1)) = lower(left(n.name, 1)) group by n.book, n.alias, n.name, x.lines having count(*) >= 2 and count(*) >= 0.15 * x.lines),
ev as (select book, a, b, list_sort(list_distinct(list(rule))) as rules from (select book, a, b, rule from pairs union all select book, least(alias, name),
  greatest(alias, name), 'narration' from support) group by 1, 2, 3)"""
over("join_blocked_pairs", pairs, f"with {CAST} select * from pairs")


def evidence(u):
    found = cut(pairs(u))
    told_of = support(u, found).select("book", F.col("alias").alias("a"), F.col("name").alias("b"), F.lit("narration").alias("rule"))
    return C.evidence(found, told_of)


over("set_evidence", evidence, f"with {CAST} select * from ev")


def _apart(u):
    """Pairs that are known to differ."""
    return pairs(u).where("a = 'Old Orrin' or b = 'Old Orrin'").select("book", "a", "b")


def _told_later(u):
    """Reveals: Captain Vale turns out to be Tamsin Vale."""
    first = u.groupBy("book").agg(F.min("para").alias("at"))
    return first.select("book", F.lit("Captain Vale").alias("alias"), F.lit("Tamsin Vale").alias("real"), "at", F.lit(1).alias("seq"))


over(
    "cast_pair_filter", lambda u: C.askable_pairs(evidence(u), cast(u), _apart(u), C.reveal_pairs(_told_later(u)), main=40, few=20).select("book", "a", "b", "rules"),
    f"""with {CAST}, n as (select ev.*, x.lines as al, y.lines as bl, p.last as al_last, q.last as bl_last from ev join c x on x.book = ev.book and x.name = a
  join c y on y.book = ev.book and y.name = b
  left join parts p on p.book = ev.book and p.name = a left join parts q on q.book = ev.book and q.name = b)
select book, a, b, rules from n where not (al >= 40 and bl >= 40) and not (least(al, bl) <= 20 and case when al < bl then al_last else bl_last end is not null
  and not list_contains(rules, 'bigram'))
  and 'Old Orrin' not in (a, b) and not (a = 'Captain Vale' and b = 'Tamsin Vale')""",
)
_said = lambda u: pairs(u).where("rule = 'nick'").select("book", "a", "b", F.lit("same").alias("verdict"))
over(
    "cast_verdict", lambda u: C.apply_verdicts(pairs(u).select("book", "a", "b"), _said(u)),
    f"with {CAST} select book, a, b, case when rule = 'nick' then 'same' else 'different' end as verdict from pairs",
)
over(
    "cast_fallback", lambda u: C.nickname_merges(cast(u).join(U.first_seen(u), ["book", "name"]), support(u), _apart(u), small=10**6),
    f"""with {CAST} select s.book, s.alias, arg_min(s.name, (y.first, s.name)) as name from support s join parts x on x.book = s.book and x.name = s.alias
  join parts y on y.book = s.book and y.name = s.name
where x.single is not null and y.single is not null and y.lines > x.lines and {_nick('x.single', 'y.single')} and 'Old Orrin' not in (s.alias, s.name) group by 1, 2""",
)


def _joined(u):
    same = pairs(u).where("rule in ('nick', 'bigram')").select("book", "a", "b", F.lit(1).alias("seq"))
    return C.components(cast(u), same, _apart(u), established=10**6)


def _torn(u):
    """Pairs in the order of their rules, with main characters and one `different` pair in their way."""
    ruled = pairs(u).select("book", "a", "b", F.array_position(F.array(*[F.lit(x) for x in C.RULES]), F.col("rule")).alias("seq"))
    return C.components(cast(u), ruled, ruled.where("b = 'Tamsin Vale'").select("book", F.col("b").alias("a"), F.lit("Tam").alias("b")).distinct(), established=60)


over("cast_components", _joined)
_GROUPS = """ways as (select book, a, b from pairs where rule in ('nick', 'bigram') and 'Old Orrin' not in (a, b)),
e as (select book, a, b from ways union select book, b, a from ways union select book, name, name from c),
reach(book, a, b) as (select book, a, b from e union select r.book, r.a, e.b from reach r join e on e.book = r.book and e.a = r.b),
grp as (select r.book, r.a as name, arg_max(r.b, (c.lines, r.b)) as grp from reach r join c on c.book = r.book and c.name = r.b group by 1, 2)"""
ORACLES["cast_components"] = f'with recursive {CAST}, {_GROUPS} select book, name, grp as "group" from grp'
over(
    "cast_components_torn", _torn,
    f"""with recursive {CAST}, same as (select book, a, b, row_number() over (partition by book order by list_position({list(C.RULES)}, rule), a, b) as n from pairs),
r(book, n, names) as (
  select book, 0, list({{'name': name, 'lines': lines, 'part': name}} order by name) from c group by book
  union all
  select book, n, case when x = y or len(list_filter(names, lambda e: e.lines >= 60 and e.part in (x, y))) > 1
      or list_contains(meet, 'Tam') and list_contains(meet, 'Tamsin Vale') and has then names
    else list_transform(names, lambda e: {{'name': e.name, 'lines': e.lines, 'part': case when e.part = x then y else e.part end}}) end
  from (select s.book, s.n, r.names, list_filter(names, lambda e: e.name = s.a)[1].part as x, list_filter(names, lambda e: e.name = s.b)[1].part as y,
          list_transform(list_filter(names, lambda e: e.part in (list_filter(r.names, lambda f: f.name = s.a)[1].part, list_filter(r.names, lambda f: f.name = s.b)[1].part)), lambda e: e.name) as meet,
          exists (select 1 from pairs p where p.book = s.book and p.b = 'Tamsin Vale') as has
        from r join same s on s.book = r.book and s.n = r.n + 1)),
ended as (select book, unnest(arg_max(names, n)) as e from r group by book)
select book, e.name as name, arg_max(e.name, (e.lines, e.name)) over (partition by book, e.part) as "group" from ended""",
)
over(
    "cast_canonical", lambda u: C.canonical_names(_joined(u), cast(u), _grams(u), main=10**6),
    f"""with recursive {CAST}, {_GROUPS}, m as (select g.book, g.grp, p.name, p.lines, p.single from grp g join c using (book, name) left
  join parts p on p.book = g.book and p.name = g.name),
big as (select g.book, g.grp, arg_max(c.name, (c.lines, c.name)) as big from grp g join c using (book, name) group by 1, 2),
full_ as (select m.book, m.grp, arg_max(surface, (n, surface)) as f from m join grams on grams.book = m.book and grams.first = m.single where n >= 5 group by 1, 2)
select big.book, big.grp as "group", coalesce(f, big) as name from big left join full_ using (book, grp)""",
)
_next = lambda u: u.where("id % 210 < 203").select("book", F.concat(F.lit("N"), F.col("id").cast("string")).alias("alias"), F.concat(F.lit("N"), (F.col("id") + 7).cast("string")).alias("name"))
over(
    "cast_merge_chain", lambda u: C.resolve_aliases(_next(u)),
    f"""with recursive {V.UNITS}, l as (select book, id, id + 7 as nxt from units where id % 210 < 203),
r as (select book, id, nxt from l union all select r.book, r.id, l.nxt from r join l on l.book = r.book and l.id = r.nxt)
select book, 'N' || id as alias, 'N' || max(nxt) as final from r group by book, id""",
)
def _links(u):
    """All pairs, some of them in capitals or with marks, and a title that the other one has not."""
    loud = F.when(F.length("b") % 2 == 0, F.upper("a")).when(F.length("a") % 3 == 0, F.concat(F.col("a"), F.lit("."))).otherwise(F.col("a"))
    return pairs(u).select("book", loud.alias("a"), "b", F.length("a").cast("long").alias("seq"))


_KEY = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"
over(
    "cast_identity", lambda u: C.identities(_links(u)).select("book", "name", "display"),
    f"""with recursive {CAST}, loud as (select book, case when length(b) % 2 = 0 then upper(a) when length(a) % 3 = 0 then a || '.' else a end as a, b, length(a) as seq from pairs),
links as (select *, {_KEY('a')} as ka, {_KEY('b')} as kb, row_number() over (partition by book order by seq, a, b) as n from loud),
seen as (select book, ka as key, a as name, n, 0 as side from links union all select book, kb, b, n, 1 from links),
first as (select book, key, arg_min(name, (n, side)) as shown from seen group by 1, 2),
fold_(book, n, keys) as (
  select book, 0, list({{'key': key, 'to': key}}) from first group by book
  union all
  select book, n, list_transform(keys, lambda e: {{'key': e.key, 'to': case when e.to = x then y else e.to end}})
  from (select l.book, l.n, q.keys, list_filter(keys, lambda e: e.key = l.ka)[1].to as x, list_filter(keys, lambda e: e.key = l.kb)[1].to as y from fold_ q join links l on l.book = q.book and l.n = q.n + 1)),
ends as (select book, unnest(arg_max(keys, n)) as e from fold_ group by book)
select distinct s.book, s.name, f.shown as display from seen s join ends on ends.book = s.book and ends.e.key = s.key join first f on f.book = s.book and f.key = ends.e.to""",
)


def _moves(u):
    name = F.when(F.col("id") % 3 == 0, "Orrin").when(F.col("id") % 3 == 1, "Nobody Known").when(F.col("id") % 2 == 0, "Unknown").otherwise("keep")
    return U.dialogue(u).select("book", "id", name.alias("name"))


over(
    "cast_reassign", lambda u: C.reassign(u, _moves(u), cast(u), radius=3),
    f"""with {V.UNITS}, o as (select distinct m.book, m.id from units m join units u on u.book = m.book and u.id between m.id - 3 and m.id + 3
  and (u.speaker = 'Orrin' or list_contains(string_split_regex(u.text, '[^\\p{{L}}\\p{{N}}_]+'), 'Orrin')))
select u.book, u.id, case when kind = 'dialogue' and u.id % 3 = 0 and o.id is not null then 'Orrin' when kind = 'dialogue'
  and u.id % 6 = 2 then 'Unknown' else speaker end as speaker from units u left join o on o.book = u.book and o.id = u.id""",
)
over(
    "set_suspects", lambda u: C.suspects(cast(u), pairs(u), cast(u).where("name = 'Tamsin'"), few=10**6),
    f"with {CAST} select c.book, c.name, c.lines from c join parts p using (book, name) where p.last is not null and c.name <> 'Tamsin' and exists (select 1 from pairs x where x.book = c.book and c.name in (x.a, x.b))",
)
over("cast_prompts", lambda u: C.briefings(cut(evidence(u)), cut(told(u)), cut(cast(u))))



def _line_prompts(u):
    """What a judge reads about small entries that a pair has flagged."""
    c, p = cut(cast(u)), cut(pairs(u))
    return C.line_briefings(C.suspects(c, p, c.where("name = 'Tamsin'"), few=400), cut(told(u)), c)


over("cast_line_prompts", _line_prompts)

candidates = V.candidates
add(
    "val_expand", lambda s, d: D.attempt_plan(V.doc_lines(s, d).where("length(line) > 0").select("doc_id", F.col("line_no").alias("chunk_idx")), 2, 2, 2, 12345),
    f"with {V.LINES} select doc_id, line_no as chunk_idx, gen, cand_idx, attempt, ((12345 + gen) * 1000003 + line_no * 10007 + cand_idx * 10009 + attempt * 101) % 4294967296 as seed from doc_lines, (select unnest([0, 1])::bigint as gen), (select unnest([0, 1])::bigint as cand_idx), (select unnest([0, 1])::bigint as attempt) where length(line) > 0",
)
scored = lambda s, d: D.similarity(candidates(s, d, form=X.compare_form), "transcript", "target", formed={"target": "form"})
add("val_similarity", lambda s, d: scored(s, d).select("doc_id", "chunk_idx", "cand_idx", F.round("score", 5).alias("score")))
cheap = lambda s, d: candidates(s, d).withColumn("score", F.round(D.ceiling(F.col("transcript"), F.col("target")) - F.col("cand_idx") % 2 * 0.1, 6)).withColumn("round", F.lit(1) + F.col("chunk_idx") % 2).withColumn("attempt", F.lit(1))
_SC = f"with {V.CANDIDATES}, s as (select *, round(2.0::double * least(length(target), length(transcript)) / (length(target) + length(transcript)) - cand_idx % 2 * 0.1, 6) as raw, 1 + chunk_idx % 2 as round from candidates), g as (select *, case when bytes < 1024 then 0.0 else raw end as score from s), p as (select *, score >= case when round = 1 then 0.85 else 0.95 end as passed from g)"
add("val_gate", lambda s, d: D.gate(cheap(s, d)).select("doc_id", "chunk_idx", "cand_idx", "score", "passed"), f"{_SC} select doc_id, chunk_idx, cand_idx, score::double as score, passed from p")
add(
    "val_select", lambda s, d: D.select_best(D.gate(cheap(s, d))).select("doc_id", "chunk_idx", "cand_idx", "passed"),
    f"{_SC} select doc_id, chunk_idx, cand_idx, passed from (select *, row_number() over (partition by doc_id, chunk_idx order by passed desc, case when passed then duration end, score desc, cand_idx) as r from p) where r = 1",
)
add("val_select_bypass", lambda s, d: D.select_first(cheap(s, d)).select("doc_id", "chunk_idx", "cand_idx"), f"with {V.CANDIDATES} select doc_id, chunk_idx, min(cand_idx) as cand_idx from candidates where bytes > 1024 group by 1, 2")
add("val_retry_queue", lambda s, d: D.retry_queue(D.gate(cheap(s, d)), 3), f"{_SC} select doc_id, chunk_idx, 1 as attempts from p group by 1, 2 having not bool_or(passed)")
add("val_faithful", lambda s, d: D.faithful(candidates(s, d, form=X.norm_words), "target", "transcript", formed={"target": "form"}).select("doc_id", "chunk_idx", "cand_idx", "ok"))


def _lines(s, d):
    return V.doc_lines(s, d).where("length(line) > 0").select("doc_id", F.col("line_no").alias("chunk_idx"), F.col("line").alias("text"))


def _tried(todo):
    """Three attempts at each chunk; how well they go hangs on the text and the attempt alone."""
    rows = todo.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    score = F.pmod(F.crc32(F.concat("text", F.col("attempt").cast("string")).cast("binary")), F.lit(101)) / 100.0
    return rows.withColumn("score", score).withColumn("ok", F.col("score") >= 0.8)


add("val_resplit", lambda s, d: D.speak(_lines(s, d), _tried))
_heard = lambda s, d: candidates(s, d).where("cand_idx < 2").select("doc_id", "chunk_idx", "cand_idx", "transcript")
add(
    "udf_transcribe", lambda s, d: D.with_transcripts(candidates(s, d).select("doc_id", "chunk_idx", "cand_idx", "target"), _heard(s, d)),
    f"with {V.CANDIDATES} select doc_id, chunk_idx, cand_idx, target, case when cand_idx < 2 then transcript else '' end as transcript from candidates",
)
_judged = lambda u: pairs(u).where("rule <> 'surname'").select("book", "a", "b", F.when(F.col("rule") == "bigram", "different").otherwise("same").alias("verdict"))
over(
    "udf_adjudicate", lambda u: C.apply_verdicts(pairs(u).select("book", "a", "b"), _judged(u)),
    f"with {CAST} select book, a, b, case when rule in ('title', 'nick') then 'same' else 'different' end as verdict from pairs",
)
