"""Queries over the unit view: a source is a book, a document a paragraph, a line a unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.operators import units as U
from parlance.plans import views as V
from parlance.sources.tables import cut

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = f"with recursive {V.UNITS}{',' if sql.lstrip()[:6].lower() != 'select' else ''} {sql}"


units = V.book_units


def casting(spark, sf):
    """A narrator's row for each book and a row for some speakers; Orrin's row has settings but no voice, Hello's has nothing."""
    rows = units(spark, sf).select("book", F.col("speaker").alias("role")).distinct().where(F.col("role").isin("Tamsin", "Orrin", "Captain Vale", "Narrator", "Hello"))
    role = F.when(F.col("role") == "Narrator", "narrator").otherwise(F.col("role"))
    voice = F.when(~F.col("role").isin("Orrin", "Hello"), F.concat(F.lit("v_"), F.lower(F.substring("role", 1, 3))))
    return rows.select(
        "book", role.alias("role"), voice.alias("voice"), F.when(F.col("role").isin("Tamsin", "Orrin"), 0.7).alias("exaggeration"),
        F.when(F.col("role") == "Narrator", 0.6).alias("temperature"), F.when(F.col("role") == "Tamsin", F.lit(7).cast("long")).alias("seed"),
    )


CASTING = """casting as (select book, case when role = 'Narrator' then 'narrator' else role end as role, case when role not in ('Orrin',
  'Hello') then 'v_' || lower(left(role, 3)) end as voice,
  case when role in ('Tamsin', 'Orrin') then 0.7::double end as exaggeration, case when role = 'Narrator' then 0.6::double end as temperature, case
  when role = 'Tamsin' then 7::bigint end as seed
  from (select distinct book, speaker as role from units where speaker in ('Tamsin', 'Orrin', 'Captain Vale', 'Narrator', 'Hello')))"""
CAST = "c as (select book, speaker as name, count(*) as lines from units where kind = 'dialogue' group by 1, 2)"

add("agg_cast", lambda s, d: U.cast_counts(units(s, d)), "select book, speaker as name, count(*) as lines from units where kind = 'dialogue' group by 1, 2")
_read = lambda: F.col("id") % 50 != 7


def _finished(s, d):
    """Runs of all books but one kind: stopped, in part, with failed chunks, or whole."""
    n = F.substring("book", -1, 1).try_cast("int")
    return units(s, d).select("book").distinct().where(F.coalesce(n, F.lit(0)) != 9).select(
        "book", (n == 1).alias("stopped"), F.when(n == 2, 60).otherwise(100).alias("percent"), F.when(n == 3, 2).otherwise(0).alias("failed")
    )


add(
    "agg_coverage", lambda s, d: U.coverage(units(s, d), _read(), _finished(s, d)),
    """n as (select book, count(*) filter (where id % 50 <> 7) as lines_read, count(*) as lines_total, coalesce(try_cast(right(book, 1) as int), 0) as n from units where kind = 'dialogue' group by 1)
select book, lines_read, lines_total, n not in (1, 2, 3, 9) as complete from n""",
)
_SHEET = "s as (select u.book, u.speaker as name, count(*) as lines, min(id) as first_unit, max(id) as last_unit, any_value(c.voice) as voice from units u left join casting c on c.book = u.book and c.role = u.speaker where u.speaker not in ('Unknown', 'Narrator') group by 1, 2)"
add(
    "agg_cast_sheet", lambda s, d: U.cast_sheet(units(s, d), casting(s, d)),
    f"{CASTING}, {_SHEET} select *, row_number() over (partition by book order by lines desc, first_unit)::int as place from s",
)


def _all_orders(s, d):
    u, c = cut(units(s, d)), cut(casting(s, d))
    out = None
    for name in U.SHEET_ORDERS:
        one = U.cast_sheet(u, c, name).select(F.lit(name).alias("by"), "book", "name", "place")
        out = one if out is None else out.unionByName(one)
    return out


_BY = {"most": "lines desc", "fewest": "lines", "first": "first_unit", "last": "last_unit desc", "name": "name", "name_desc": "name desc"}
add("agg_cast_orders", _all_orders, f"{CASTING}, {_SHEET} " + " union all ".join(f"select '{n}' as by, book, name, row_number() over (partition by book order by {o}, first_unit)::int as place from s" for n, o in _BY.items()))
add("agg_narr_count", lambda s, d: U.role_counts(units(s, d)), "select book, case when kind = 'narration' then 'narrator' else speaker end as role, count(*) as n from units group by 1, 2")
_T = ", ".join(f"'{t}'" for t in L.TITLES)
_W = lambda k: f"regexp_replace(lower(string_split(surface, ' ')[{k}]), '[^a-z0-9 ]', '', 'g')"
add(
    "agg_bigrams", lambda s, d: U.name_bigrams(units(s, d).withColumn("text", F.concat("speaker", F.lit(" said. "), F.col("text")))),
    f"""m as (select book, id, regexp_extract_all(speaker || ' said. ' || text, '\\b([A-Z][a-zA-Z''’-]+ [A-Z][a-zA-Z''’-]*[a-zA-Z])(?:$|[^\\p{{L}}\\p{{N}}_])', 1) as m from units),
g as (select book, id, unnest(range(len(m))) as place, unnest(m) as surface from m), w as (select *, {_W(1)} as first, {_W(2)} as last from g)
select book, first, last, count(*) as n, arg_min(surface, (id, place)) as surface from w where first <> '' and last <> '' and first not in ({_T})
  and last not in ({_T}) group by 1, 2, 3""",
)
_SEEN = "seen as (select a.book, a.speaker as name, b.speaker as other, count(*) as n from units a join units b on a.book = b.book and b.id between a.id - 5 and a.id + 5 where a.kind = 'dialogue' and b.kind = 'dialogue' and a.speaker <> b.speaker group by 1, 2, 3)"
add("agg_profile", lambda s, d: U.companions(units(s, d)), f"{_SEEN} select * from seen")
add(
    "agg_partners", lambda s, d: U.partner_text(U.companions(units(s, d))),
    f"{_SEEN} select book, name, string_agg(other || ' (' || n || ')', ', ' order by r) as partners from (select *, row_number() over (partition by book, name order by n desc, other) as r from seen) where r <= 5 group by 1, 2",
)


def _veto(s, d):
    u = units(s, d).withColumn("speaker", F.when(F.col("id") % 37 < 30, F.col("speaker")).otherwise("Solo"))
    near = U.companions(u, 1)
    names = near.select("book", "name").distinct()
    return U.anchor_veto(names.select("book", F.col("name").alias("a")).join(names.select("book", F.col("name").alias("b")), "book").where("a <> b"), near, share=0.3)


add(
    "agg_anchor_veto", _veto,
    """v as (select book, id, case when id % 37 < 30 then speaker else 'Solo' end as speaker from units where kind = 'dialogue'),
seen as (select a.book, a.speaker as name, b.speaker as other, count(*) as n from v a join v b on a.book = b.book and b.id between a.id - 1 and a.id + 1
  where a.speaker <> b.speaker group by 1, 2, 3),
nm as (select distinct book, name from seen), p as (select x.book, x.name as a, y.name as b from nm x join nm y on x.book = y.book and x.name <> y.name),
top as (select p.book, p.a, p.b, arg_max(s.other, (s.n, s.other)) as who, max(s.n) as most, sum(s.n) as met from p join seen s on s.book = p.book
  and s.name = p.a and s.other <> p.b group by 1, 2, 3),
few as (select p.book, p.a, p.b, sum(s.n) as met from p join seen s on s.book = p.book and s.name = p.b and s.other <> p.a group by 1, 2, 3)
select t.book, t.a, t.b, t.who from top t join few using (book, a, b) where t.most >= 0.3 * t.met and few.met >= 3 and not exists (select 1 from seen s
  where s.book = t.book and s.name = t.b and s.other = t.who)""",
)
LINES = """given as (select * from casting where voice is not null or exaggeration is not null or temperature is not null or seed is not null),
lines as (select book, id, speaker, voice, case when voice is not null then coalesce(exaggeration, 0.5) end as exaggeration, case
  when voice is not null then 0.5::double end as cfg_weight,
  case when voice is not null then coalesce(temperature, 0.8) end as temperature, case when voice is not null then seed end as seed
  from (select x.book, x.id, x.role as speaker, g.voice, g.exaggeration, g.temperature, g.seed from (select u.*, case
  when kind = 'narration' then 'narrator' else speaker end as role from units u) x
    left join given g on g.book = x.book and g.role = case when exists (select 1 from given h where h.book = x.book and h.role = x.role) then x.role else 'narrator' end))"""
lines = lambda s, d: U.cast_lines(units(s, d), casting(s, d))
add("join_cast_voice", lines, f"{CASTING}, {LINES} select * from lines")
add("agg_voice_use", lambda s, d: U.voice_usage(lines(s, d)), f"{CASTING}, {LINES} select book, voice, count(*) as n from lines group by 1, 2")
add(
    "top_voice_plan", lambda s, d: U.voice_plan(U.voice_usage(lines(s, d)), "v_cap", 2),
    f"{CASTING}, {LINES}, u as (select book, voice, count(*) as n from lines where voice is not null group by 1, 2), r as (select *, row_number() over (partition by book order by voice = 'v_cap' desc, n desc, voice) as rank from u) select book, voice, n, rank from r where rank <= 2",
)
quotes = lambda s, d: U.dialogue(units(s, d)).withColumn("para", F.col("para") + F.floor(F.col("para") / 60) * 5)
_Q = "q as (select book, id, para + para // 60 * 5 as para, kind, text, speaker from units where kind = 'dialogue')"
add(
    "win_runs", lambda s, d: U.runs(quotes(s, d), 20).select("book", "id", "run"),
    f"{_Q} select book, id, cast(sum(new) over (partition by book order by id) as bigint) as run from (select *, case when para - lag(para) over (partition by book order by id) > 20 then 1 else 0 end as new from q)",
)
breaks = lambda s, d: units(s, d).where("para % 7 = 0").select("book", "para").distinct()
add(
    "win_breaks", lambda s, d: U.exchanges(quotes(s, d), breaks(s, d)).select("book", "id", "exchange"),
    f"{_Q}, b as (select distinct book, para from units where para % 7 = 0) select q.book, q.id, count(b.para) as exchange from q left join b on b.book = q.book and b.para <= q.para group by 1, 2",
)
add(
    "win_timeline", lambda s, d: U.timeline(units(s, d), F.length("text") * 60),
    "select book, id, cast(coalesce(sum(d + case when nxt is null or nxt = para then 180 else 450 end) over (partition by book order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms, d as dur_ms from (select *, length(text) * 60 as d, lead(para) over (partition by book order by id) as nxt from units)",
)
add(
    "win_warm_ahead", lambda s, d: U.warm_ahead(lines(s, d)),
    f"{CASTING}, {LINES} select book, id, voice, lead(voice, 3) over (partition by book order by id) as ahead, voice is not null and id = min(id) over (partition by book, voice) as first_use from lines",
)
saved = lambda s, d: U.cast_counts(units(s, d)).where("name = 'Tamsin'").select("book", "name", F.lit("kept").alias("voice"))
add(
    "win_round_robin", lambda s, d: U.auto_cast(U.cast_counts(units(s, d)), ["a", "b", "c"], saved(s, d)),
    f"{CAST} select book, name, case when name = 'Tamsin' then 'kept' else ['a', 'b', 'c'][(row_number() over (partition by book, name = 'Tamsin' order by lines desc, name) - 1) % 3 + 1] end as voice from c",
)


def _told(s, d):
    """Units whose narration names a speaker here and there."""
    return units(s, d).withColumn("text", F.when((F.col("kind") == "narration") & (F.col("id") % 5 == 0), F.concat(F.lit("Then Tamsin spoke. "), F.col("text"))).otherwise(F.col("text")))


_TOLD = "t as (select book, id, kind, speaker, case when kind = 'narration' and id % 5 = 0 then 'Then Tamsin spoke. ' || text else text end as text from units)"
_pairs = lambda s, d: units(s, d).where("speaker = 'Tam'").select("book", F.col("speaker").alias("alias"), F.lit("Tamsin").alias("name")).distinct()
_NEAR = f"{_TOLD}, near as (select distinct a.book, a.speaker as alias, 'Tamsin' as name, a.id from t a join t b on a.book = b.book and b.id between a.id - 2 and a.id + 2 and b.kind = 'narration' where a.speaker = 'Tam' and a.kind = 'dialogue' and list_contains(string_split_regex(b.text, '[^\\p{{L}}\\p{{N}}_]+'), 'Tamsin'))"
add("join_near_narr", lambda s, d: U.near_narration(_told(s, d), _pairs(s, d)), f"{_NEAR} select * from near")
add(
    "agg_support", lambda s, d: U.narration_support(U.near_narration(_told(s, d), _pairs(s, d)), U.cast_counts(units(s, d)), small=100000),
    f"{_NEAR}, {CAST} select n.book, n.alias, n.name, count(distinct id) as n from near n join c a on a.book = n.book and a.name = n.alias join c o on o.book = n.book and o.name = n.name where o.lines > a.lines group by 1, 2, 3, a.lines having count(distinct id) >= 2 and count(distinct id) >= 0.15 * a.lines",
)
_moves = lambda s, d: U.dialogue(units(s, d)).select("book", "id", F.lit("Captain Vale").alias("name"))


def _vale(s, d):
    """Units that speak of Vale here and there."""
    return units(s, d).withColumn("text", F.when(F.col("id") % 40 == 0, F.concat(F.lit("Then Vale spoke. "), F.col("text"))).otherwise(F.col("text")))


add(
    "join_in_scene", lambda s, d: U.in_scene(_moves(s, d), _vale(s, d), 5),
    """e as (select book, id as at from units where speaker = 'Captain Vale' or id % 40 = 0 or list_contains(string_split_regex(text, '[^\\p{L}\\p{N}_]+'), 'Vale'))
select distinct m.book, m.id, 'Captain Vale' as name from units m join e on e.book = m.book and e.at between m.id - 5 and m.id + 5 where m.kind = 'dialogue'""",
)


def _selections(u):
    """The queries are a thirteenth of the units: parts of a line, a line and more, or nothing that is there; some without a paragraph."""
    k = F.col("id") % 3
    sel = F.when(k == 0, F.substring("text", 4, 40)).when(k == 1, F.concat(F.col("text"), F.lit(" and more"))).otherwise("nowhere to be found")
    para = F.when(F.col("id") % 4 != 1, F.col("para"))
    return u.where("id % 13 = 0").select(F.concat_ws("-", "book", F.col("id").cast("string")).alias("sel_id"), "book", para.alias("para"), sel.alias("sel"))


def _selected(s, d):
    u = cut(units(s, d).select("book", "para", "id", "text"))
    return U.locate(_selections(u), u)


_SF = lambda x: f"lower(trim(regexp_replace(regexp_replace({x}, '[\"''“”‘’«»\\\\]', '', 'g'), '[\\t-\\r\\x1c-\\x20\\x85\\xa0\\p{{Z}}]+', ' ', 'g')))"
_SEL = "case when id % 3 = 0 then substr(text, 4, 40) when id % 3 = 1 then text || ' and more' else 'nowhere to be found' end"
add(
    "join_selection", _selected,
    f"""sel as (select book || '-' || id as sel_id, book, case when id % 4 <> 1 then para end as para, {_SF(_SEL)} as s from units where id % 13 = 0),
  u as (select book, para, id, {_SF('text')} as u from units),
r as (select sel_id, id, case when (sel.para is null or sel.para = u.para) and contains(u, left(s, 60)) then 1 when u <> '' and contains(s, u) then 2
  when sel.para = u.para then 3 end as p from sel join u using (book) where s <> ''),
k as (select *, row_number() over (partition by sel_id order by p, id) as k from r where p is not null)
select sel.sel_id, k.id as unit_id, k.p as rule from sel left join k on k.sel_id = sel.sel_id and k.k = 1""",
)


def _reveals(s, d):
    """Old Orrin turns out to be Orrin, and later on Orrin to be Vale."""
    first = units(s, d).where("speaker = 'Old Orrin'").groupBy("book").agg(F.min("para").alias("at"))
    step = lambda alias, real, after, seq: F.struct(F.lit(alias).alias("alias"), F.lit(real).alias("real"), (F.col("at") + after).alias("at"), F.lit(seq).alias("seq"))
    return first.select("book", F.explode(F.array(step("OLD ORRIN.", "Orrin", 40, 1), step("orrin", "Vale", 200, 2))).alias("r")).select("book", "r.*")


def _same_people(s, d):
    """Tam is Tamsin, and Vale has a title."""
    books = units(s, d).select("book").distinct()
    return books.select("book", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("display")) for n, t in (("TAM", "Tamsin"), ("Tamsin", "Tamsin"), ("Vale", "Captain Vale"))])).alias("k")).select("book", "k.*")


add(
    "join_reveal", lambda s, d: U.resolve_at(U.dialogue(units(s, d)), _reveals(s, d), _same_people(s, d)),
    """f as (select book, min(para) as at0 from units where speaker = 'Old Orrin' group by 1)
select u.book, id, para, speaker, case when speaker in ('Old Orrin', 'Orrin') and para >= at0 + 200 then 'Captain Vale' when speaker = 'Old Orrin'
  and para >= at0 + 40 then 'Orrin' when speaker = 'Old Orrin' and at0 is not null then 'OLD ORRIN.' when speaker = 'Tam' then 'Tamsin' else speaker end as who
from units u left join f on f.book = u.book where kind = 'dialogue'""",
)


def _resumed(s, d):
    before = units(s, d).select("book", "id", F.when(F.col("id") % 8 != 0, F.concat(F.lit("was "), F.col("speaker"))).alias("speaker"), (F.col("id") % 4 == 0).alias("attr"))
    return U.carry_over(units(s, d), before)


add(
    "join_resume", lambda s, d: U.pending(_resumed(s, d), _parts(s, d), 60),
    """p as (select book, para // 40 as chunk, min(id) as first from units group by 1, 2), m as (select book, greatest(1, count(*) * 60 // 100) as most from units group by 1)
select u.book, p.chunk, u.id from units u join p on p.book = u.book and p.chunk = u.para // 40 join m on m.book = u.book where p.first < m.most
  and u.kind = 'dialogue' and u.id % 4 <> 0""",
)
add(
    "join_resume_units", lambda s, d: _resumed(s, d).select("book", "id", "speaker", "attr"),
    "select book, id, case when id % 8 = 0 then 'Unknown' when id % 4 = 0 then 'was ' || speaker else speaker end as speaker, id % 4 = 0 as attr from units",
)
add(
    "att_reply_apply", lambda s, d: U.apply_replies(units(s, d), units(s, d).where("id % 3 <> 0").select("book", "id", F.when(F.col("id") % 5 == 0, "He").otherwise(F.col("speaker")).alias("name"))),
    "select book, id, case when id % 3 = 0 or id % 5 = 0 or speaker = 'He' then 'Unknown' else speaker end as speaker, id % 3 <> 0 as attr from units where kind = 'dialogue'",
)
add("att_defaults", lambda s, d: U.default_speakers(units(s, d)).select("book", "id", "speaker"), "select book, id, case when kind = 'narration' then 'Narrator' when speaker = 'He' then 'Unknown' else speaker end as speaker from units")
_DOC = "n as (select *, length(text) + case when kind = 'dialogue' then 2 else 0 end as len, lag(para) over (partition by book order by id) as pp from units), e as (select *, case when pp is null then 0 when pp = para then 1 else 2 end as sep from n)"
add("seg_docbuild", lambda s, d: U.build_document(units(s, d)), f"{_DOC} select book, id, cast(sum(len + sep) over w - len as bigint) as start, cast(sum(len + sep) over w as bigint) as \"end\" from e window w as (partition by book order by id)")
add(
    "seg_ctx_chunks", lambda s, d: U.context_chunks(units(s, d)),
    """p as (select book, para, sum(length(text))::bigint as n, row_number() over (partition by book order by para) as rn from units group by 1, 2),
r as (select book, rn, para, 0::bigint as chunk, n as size from p where rn = 1 union all
  select p.book, p.rn, p.para, r.chunk + case when r.size >= 3500 then 1 else 0 end, p.n + case when r.size >= 3500 then 0 else r.size end from r
  join p on p.book = r.book and p.rn = r.rn + 1)
select book, para, chunk from r""",
)
_parts = lambda s, d: units(s, d).select("book", "para", (F.floor(F.col("para") / 40)).alias("chunk")).distinct()
_RUN = "case when kind = 'dialogue' then '[line ' || id || '] \"' || text || '\"' else text end"
add(
    "seg_render", lambda s, d: U.render(units(s, d), _parts(s, d)),
    f"p as (select book, para // 40 as chunk, para, string_agg({_RUN}, chr(10) order by id) as t from units group by 1, 2, 3) select book, chunk, string_agg(t, chr(10) || chr(10) order by para) as passage from p group by 1, 2",
)
add(
    "seg_ctx_tail", lambda s, d: U.context_tail(units(s, d), _parts(s, d)),
    "r as (select book, para // 40 as chunk, id, text, row_number() over w as r, sum(length(text)) over w as c from units window w as (partition by book, para // 40 order by id desc)) select book, chunk, string_agg(text, ' ' order by id) as tail from r where r = 1 or c <= 900 group by 1, 2",
)
add(
    "top_excerpt", lambda s, d: U.excerpts(units(s, d), units(s, d).select("book", "id")),
    "select c.book, c.id as centre, string_agg(case when u.id = c.id then '>> ' else '   ' end || u.speaker || ': ' || left(u.text, 100), chr(10) order by u.id) as excerpt from units c join units u on u.book = c.book and u.id between c.id - 3 and c.id + 3 group by 1, 2",
)


def _known(s, d):
    """All speakers and Brindle, who never speaks."""
    names = units(s, d).select("book", F.col("speaker").alias("name"))
    return names.union(names.select("book", F.lit("Brindle"))).distinct()


add(
    "top_sample_line", lambda s, d: U.sample_lines(units(s, d), _known(s, d)),
    """k as (select book, speaker from units union select book, 'Brindle' from units), f as (select book, speaker, arg_min(text, id) as text from units group by 1, 2)
select k.book, k.speaker, left(coalesce(f.text, 'The quick brown fox jumps over the lazy dog.'), 220) as sample from k left join f on f.book = k.book and f.speaker = k.speaker""",
)
add(
    "top_near_lines", lambda s, d: U.near_lines(units(s, d)),
    "select book, speaker, r, text from (select book, speaker, text, row_number() over (partition by book, speaker order by abs(length(text) - 110), id) as r from units) where r <= 2",
)
add("top_cast_line", lambda s, d: U.cast_line(U.cast_counts(units(s, d)), 5), f"{CAST} select book, string_agg(name || ' ' || lines, ', ' order by r) as cast_line from (select *, row_number() over (partition by book order by lines desc, name) as r from c) where r <= 5 group by 1")
add(
    "set_roster", lambda s, d: U.roster(units(s, d), units(s, d).where("id % 10 = 0").select("book", F.lit("Brindle").alias("name"), "id")),
    "select book, name, min(id) as first_at from (select book, speaker as name, id from units where kind = 'dialogue' union all select book, 'Brindle', id from units where id % 10 = 0) where name <> 'He' group by 1, 2",
)
add(
    "udf_break", lambda s, d: U.exchanges(U.dialogue(units(s, d)), U.breaks_where(units(s, d), F.col("text").rlike("^[A-D]"))).select("book", "id", "exchange"),
    "b as (select distinct book, para from units where regexp_matches(text, '^[A-D]')) select q.book, q.id, count(b.para) as exchange from units q left join b on b.book = q.book and b.para <= q.para where q.kind = 'dialogue' group by 1, 2",
)
