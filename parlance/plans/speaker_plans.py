"""Queries on who speaks a quote: tags, mentions, vocatives, sieves, turn taking."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import lexicon as L
from parlance.operators import attribution as A
from parlance.operators import units as U
from parlance.plans import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


units = V.book_units
NAMES = "('Tamsin', 'Orrin', 'Captain Vale')"


def names(s, d):
    return units(s, d).where(f"speaker in {NAMES}").select("book", F.col("speaker").alias("name")).distinct()


def quotes(s, d):
    """Lines with narration before or after them that tells who spoke."""
    u = U.dialogue(units(s, d))
    said = F.concat(F.lit(" said "), F.col("speaker"), F.lit(" at once."))
    replied = F.concat(F.lit(", "), F.col("speaker"), F.lit(" replied."))
    asked = F.concat(F.lit("then "), F.col("speaker"), F.lit(" asked, "))
    k = F.col("id")
    return u.withColumn("after", F.when(k % 3 == 0, said).when(k % 3 == 1, replied).otherwise("")).withColumn("before", F.when(k % 6 == 5, asked).otherwise(""))


QUOTES = f"""{V.UNITS}, quotes as (select *, case when id % 3 = 0 then ' said ' || speaker || ' at once.' when id % 3 = 1 then ', ' || speaker || ' replied.' else '' end as after,
  case when id % 6 = 5 then 'then ' || speaker || ' asked, ' else '' end as before from units where kind = 'dialogue'),
roster as (select distinct book, speaker as name from units where speaker in {NAMES})"""
_SQ = chr(39) * 2
_N = A.NAME.replace("'", _SQ)
_TRIM = lambda x: f"nullif(regexp_replace({x}, '^[ ,.{_SQ}’-]+|[ ,.{_SQ}’-]+$', '', 'g'), '')"
_TAGS = ", ".join(
    f"({k}, {_TRIM(x)})"
    for k, x in enumerate((
        f"regexp_extract(after, '^[\\s,]*(?:{L.SAY})\\s+({_N})', 1)", f"regexp_extract(after, '^[\\s,]*({_N})\\s+(?:{L.SAY})\\b', 1)",
        f"regexp_extract(before, '\\b({_N})\\s+(?:{L.SAY})\\s*[.,!?]?\\s*$', 1)",
    ))
)
add(
    "att_tag", lambda s, d: A.tag_speakers(quotes(s, d), names(s, d)),
    f"""with {QUOTES}, c as (select book, id, p, tag from quotes, lateral (values {_TAGS}) as t(p, tag)),
k as (select book, id, arg_min(tag, p) as tag from c where string_split(tag, ' ')[1] in (select string_split(name, ' ')[1] from roster r where r.book = c.book) group by 1, 2)
select q.book, q.id, k.tag from quotes q left join k using (book, id)""",
)
add(
    "join_roster", lambda s, d: A.known_names(units(s, d).select("book", "id", F.col("speaker").alias("tag")), names(s, d)),
    f"with {V.UNITS} select book, id, speaker as tag from units where string_split(speaker, ' ')[1] in ('Tamsin', 'Orrin', 'Captain')",
)


def turns(s, d):
    q = units(s, d).where("kind = 'dialogue'")
    return q.select(
        "book", F.floor(F.col("para") / 7).alias("run"), "id", F.when(F.col("id") % 4 == 0, F.col("speaker")).alias("tag"), F.when(F.col("id") % 5 == 0, F.col("speaker")).alias("hint")
    )


add(
    "att_alternate", lambda s, d: A.alternate(turns(s, d)),
    f"""with recursive {V.UNITS}, q as (select book, para // 7 as run, id, case when id % 4 = 0 then speaker end as tag, case when id % 5 = 0 then speaker end as hint,
  row_number() over (partition by book, para // 7 order by id) as rn from units where kind = 'dialogue'),
r(book, run, rn, id, speaker, pair) as (
  select distinct book, run, 0::bigint, null::bigint, null::varchar, []::varchar[] from q
  union all
  select book, run, rn, id, who, case when who is null or list_contains(pair, who) then pair when tag is null then list_append(pair, who)[-2:]
    when last is not null and last <> tag then [last, tag] else [tag] end
  from (select q.book, q.run, q.rn, q.id, q.tag, r.pair, r.speaker as last, coalesce(q.tag,
      case when len(r.pair) = 2 and list_contains(r.pair, r.speaker) then case when r.pair[1] = r.speaker then r.pair[2] else r.pair[1] end
        when r.speaker is null or (q.hint is not null and q.hint <> r.speaker) then q.hint else r.speaker end) as who
    from r join q on q.book = r.book and q.run = r.run and q.rn = r.rn + 1))
select book, id, speaker from r where rn > 0""",
)


def tokens(s, d):
    """Words as tokens: twenty make a paragraph, its last one is a mark."""
    w = V.documents(s, d).select("doc_id", F.posexplode(F.split("text", "[ \\n]+")).alias("p", "word"))
    fine = F.when(F.col("word").rlike("^[A-Z]"), "NNP").otherwise("NN")
    pos = F.when(F.col("p") % 20 == 19, "PUNCT").when(fine == "NNP", "PROPN").otherwise("NOUN")
    return w.select("doc_id", F.col("p").cast("long").alias("token_id"), F.floor(F.col("p") / 20).alias("para"), "word", fine.alias("fine_pos"), pos.alias("pos"))


def entities(s, d):
    """Capitalised words as mentions, some of them two or three tokens long."""
    t = tokens(s, d).where("fine_pos = 'NNP'")
    return t.select(
        "doc_id", F.col("token_id").alias("ent"), "para", F.col("token_id").alias("start_token"), (F.col("token_id") + F.col("token_id") % 3).alias("end_token"),
        (F.length("word") % 5).cast("long").alias("coref"), F.lit("PROP").alias("prop"), F.when(F.col("token_id") % 4 != 0, "PER").otherwise("LOC").alias("cat"), F.col("word").alias("text"),
    )


def nlp_quotes(s, d):
    """Quotes of seven tokens; some paragraphs are nothing but a quote."""
    t = F.col("token_id")
    whole = F.col("para") % 4 == 1
    rows = tokens(s, d).where((whole & (t % 20 == 0)) | (~whole & (t % 20).isin(2, 12)))
    rows = rows.select("doc_id", t.alias("q"), "para", t.alias("quote_start"), F.when(whole, t + 18).otherwise(t + 6).alias("quote_end"), "word")
    mention = F.when(F.col("q") % 7 != 3, F.col("quote_end") + 1 + F.col("q") % 8)
    phrase = F.when(F.col("q") % 3 == 0, "He").when(F.col("q") % 3 == 1, "Anna").otherwise("the man")
    return rows.select(
        "doc_id", "q", "para", "quote_start", "quote_end", mention.alias("mention_start"), (mention + F.col("q") % 2).alias("mention_end"),
        phrase.alias("mention_phrase"), (F.length("word") % 5).cast("long").alias("char_id"),
    )


TOKENS = """t as materialized (select doc_id, unnest(range(len(ws))) as token_id, unnest(ws) as word from (select doc_id, string_split_regex(text,
  '[ \\n]+') as ws from documents)),
tokens as materialized (select doc_id, token_id, token_id // 20 as para, word, case when regexp_matches(word, '^[A-Z]') then 'NNP' else 'NN' end as fine_pos,
  case when token_id % 20 = 19 then 'PUNCT' when regexp_matches(word, '^[A-Z]') then 'PROPN' else 'NOUN' end as pos from t),
entities as materialized (select doc_id, token_id as ent, para, token_id as start_token, token_id + token_id % 3 as end_token, length(word) % 5 as coref,
  case when token_id % 4 <> 0 then 'PER' else 'LOC' end as cat, word as text from tokens where fine_pos = 'NNP'),
quotes0 as (select doc_id, token_id as q, para, token_id as quote_start, case when para % 4 = 1 then token_id + 18 else token_id + 6 end as quote_end, word from tokens
  where case when para % 4 = 1 then token_id % 20 = 0 else token_id % 20 in (2, 12) end),
quotes as materialized (select doc_id, q, para, quote_start, quote_end, case when q % 7 <> 3 then quote_end + 1 + q % 8 end as mention_start,
  case when q % 7 <> 3 then quote_end + 1 + q % 8 + q % 2 end as mention_end, case q % 3 when 0 then 'He'
  when 1 then 'Anna' else 'the man' end as mention_phrase, length(word) % 5 as char_id from quotes0),
names as (select doc_id, coref, text as name from (select *, row_number() over (partition by doc_id, coref order by n desc, f) as r
  from (select doc_id, coref, text, count(*) as n, min(start_token) as f from entities where cat = 'PER' group by 1, 2, 3)) where r = 1),
outside as materialized (select e.* from entities e left join quotes q on q.doc_id = e.doc_id and q.para = e.para and e.start_token between q.quote_start
  and q.quote_end where e.cat = 'PER' and q.q is null)"""
add(
    "join_coref", lambda s, d: A.token_coref(tokens(s, d), entities(s, d)),
    f"""with {TOKENS}, c as (select doc_id, coref, ent, unnest(range(start_token, end_token + 1)) as token_id from entities)
select t.doc_id, t.token_id, arg_max(c.coref, c.ent) as coref from tokens t join c using (doc_id, token_id) group by 1, 2""",
)
add("agg_coref_name", lambda s, d: A.coref_names(entities(s, d)), f"with {TOKENS} select doc_id, coref, name from names")
_PRONOUNS = ", ".join(f"'{w}'" for w in L.PRONOUNS)
add(
    "att_classify", lambda s, d: A.classify_quotes(nlp_quotes(s, d), tokens(s, d)),
    f"""with d as (select doc_id, string_split_regex(text, '[ \\n]+') as ws from documents), t as (select doc_id, unnest(range(len(ws))) as token_id, unnest(ws) as word from d),
q0 as (select doc_id, token_id as q, token_id as quote_start, case when token_id // 20 % 4 = 1 then token_id + 18 else token_id + 6 end as quote_end, length(word) % 5 as char_id
  from t where case when token_id // 20 % 4 = 1 then token_id % 20 = 0 else token_id % 20 in (2, 12) end),
q as (select *, case when q % 7 <> 3 then quote_end + 1 + q % 8 end as mention_start, case when q % 7 <> 3 then quote_end + 1 + q % 8 + q % 2 end as mention_end,
  case q % 3 when 0 then 'He' when 1 then 'Anna' else 'the man' end as phrase from q0),
j as (select q.*, coalesce(regexp_matches(ws[mention_start + 1], '^[A-Z]'), regexp_matches(ws[mention_end + 1], '^[A-Z]'), regexp_matches(phrase, '^\\p{{Lu}}') and lower(phrase) not in ({_PRONOUNS})) as named,
  coalesce(least(abs(mention_start - quote_end), abs(quote_start - mention_end)) > 4, true) as far from q join d on d.doc_id = q.doc_id)
select doc_id, q, case when far then 'implicit' when named then 'explicit' else 'anaphoric' end as kind, case when not far then char_id end as coref from j""",
)
add("join_mention_outside", lambda s, d: A.outside_mentions(entities(s, d), nlp_quotes(s, d)).select("doc_id", "ent", "text"), f"with {TOKENS} select doc_id, ent, text from outside")
add(
    "att_para_ctx", lambda s, d: A.paragraph_context(tokens(s, d), nlp_quotes(s, d), entities(s, d), A.coref_names(entities(s, d)).where("coref <> 3")),
    f"""with {TOKENS}, m as (select o.doc_id, o.para, o.start_token, n.name from outside o left join names n on n.doc_id = o.doc_id and n.coref = o.coref and n.coref <> 3),
w as (select doc_id, para, coalesce(max(token_id) filter (where pos <> 'PUNCT'), max(token_id)) as last from tokens group by 1, 2),
s as (select distinct t.doc_id, t.para from tokens t left join quotes q on q.doc_id = t.doc_id and q.para = t.para and t.token_id between q.quote_start
  and q.quote_end where t.pos <> 'PUNCT' and q.q is null),
b as (select q.doc_id, q.q, case when count(m.start_token) = 1 then max(m.name) end as beat, arg_max(m.name, m.start_token) filter (where m.name is not null
  and m.start_token < q.quote_start) as final
  from quotes q left join m using (doc_id, para) group by 1, 2)
select q.doc_id, q.q, b.beat, case when q.quote_end >= coalesce(w.last, -1) then b.final end as pfinal, s.para is null and w.para is not null as bare
from quotes q join b using (doc_id, q) left join w using (doc_id, para) left join s on s.doc_id = q.doc_id and s.para = q.para""",
)


def agents(s, d):
    """Coref ids with a mention that stands before a long word."""
    return entities(s, d).where("length(text) % 3 = 0").select("doc_id", "coref").distinct()


def _shaped(x: str) -> str:
    """SQL of name_shaped."""
    few = ", ".join(f"'{w}'" for w in L.NUMBER_WORDS + L.INTERJECTIONS)
    ranks = ", ".join(f"'{w}'" for w in L.HONORIFICS)
    t = f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
    core = "rtrim(rtrim(w, '.'), 's')"
    bad = f"not regexp_matches(w, '^[A-Z][A-Za-z{_SQ}’-]*\\.?$') or (length({core}) >= 2 and {core} = upper({core}) and regexp_matches({core}, '[A-Z]'))"
    return f"(coalesce(len({t}) between 1 and 3 and len(list_filter({t}, lambda w: {bad})) = 0 and not (len({t}) = 1 and rtrim(lower({t}[1]), '.') in ({ranks})) and lower({x}) not in ({few}), false))"


add(
    "att_speaker_names", lambda s, d: A.speaking_names(A.coref_names(entities(s, d)), agents(s, d)),
    f"""with {TOKENS}, a as (select distinct doc_id, coref from entities where length(text) % 3 = 0)
select doc_id, coref, name from names n where {_shaped('name')} and (exists (select 1 from a where a.doc_id = n.doc_id
  and a.coref = n.coref) or not exists (select 1 from a where a.doc_id = n.doc_id))""",
)


def pairs_of_words(s, d):
    """Every two neighbouring words of a text, once a document."""
    w = F.col("w")
    two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))
    rows = V.documents(s, d).select("doc_id", F.split("text", "[ \\n]+").alias("w")).where(F.size("w") > 1)
    return rows.select("doc_id", F.explode(F.array_distinct(two)).alias("name"))


def _name_shaped(s, d):
    from parlance.functions import text as X

    return pairs_of_words(s, d).select("doc_id", "name", X.name_shaped(F.col("name")).alias("out"))


add(
    "prd_name_shaped", _name_shaped,
    f"""with w as (select doc_id, string_split_regex(text, '[ \\n]+') as w from documents),
n as (select distinct doc_id, name from (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as name from w
  where len(w) > 1)) select doc_id, name, {_shaped('name')} as out from n""",
)


def _spoken(s, d):
    voc = F.when(F.col("id") % 5 == 0, F.array(F.lit("Mayor"))).when(F.col("id") % 6 == 2, F.array(F.lit("Sheriff"), F.col("speaker"))).otherwise(F.array().cast("array<string>"))
    tag = F.when(F.col("id") % 5 == 1, "Jahns").when(F.col("id") % 7 == 3, F.col("speaker"))
    return units(s, d).withColumn("vocs", voc).withColumn("tag", tag)


add(
    "agg_alias_learn", lambda s, d: A.learn_aliases(_spoken(s, d)),
    f"""with {V.UNITS}, q as (select book, id, para, case when id % 5 = 0 then ['Mayor'] when id % 6 = 2 then ['Sheriff', speaker] else []::varchar[] end as vocs,
  case when id % 5 = 1 then 'Jahns' when id % 7 = 3 then speaker end as tag from units),
n as (select *, lead(tag) over w as t2, lead(para) over w as p2 from q window w as (partition by book order by id)),
v as (select book, unnest(vocs) as alias, t2 from n where t2 is not null and p2 - para <= 2)
select book, alias, min(t2) as name from v where not exists (select 1 from q where q.book = v.book and q.tag = v.alias) group by 1, 2 having count(*) >= 2 and min(t2) = max(t2)""",
)


def _called(s, d):
    """Lines that begin with a name, hold one in the middle, or are nothing else."""
    k = F.col("id") % 4
    text = F.when(k == 0, F.concat("speaker", F.lit(", "), F.col("text"))).when(k == 1, F.concat(F.lit("“Well, my dear "), F.col("speaker"), F.lit("! "), F.col("text"))).when(k == 2, F.concat(F.lit("“"), F.lower("speaker"), F.lit("?”"))).otherwise(F.col("text"))
    return U.dialogue(units(s, d)).withColumn("text", text)


add(
    "att_vocative", lambda s, d: A.vocatives(_called(s, d), names(s, d)),
    f"""with {QUOTES}, c as (select book, id, trim(regexp_replace(case id % 4 when 0 then speaker || ', ' || text
  when 1 then '“Well, my dear ' || speaker || '! ' || text when 2 then '“' || lower(speaker) || '?”' else text end, '[“”]', '', 'g')) as text from quotes),
h as (select c.book, c.id, r.name, regexp_matches(c.text, '(?:^|[,;!?—–-]\\s*|\\b[Mm]y dear\\s+)(?:' || r.name || '|' || string_split(r.name,
  ' ')[1] || ')\\s*(?:[,.!?;:—–-]|$)') as called,
  regexp_replace(lower(c.text), '^[\\s.,!?—–"{_SQ}“”‘’-]+|[\\s.,!?—–"{_SQ}“”‘’-]+$', '', 'g') in (lower(r.name), lower(string_split(r.name, ' ')[1])) as alone
  from c join roster r on r.book = c.book),
g as (select book, id, coalesce(list(name order by name) filter (where called), []) as vocs, min(name) filter (where alone) as addressee from h group by 1, 2)
select book, id, case when addressee is null or list_contains(vocs, addressee) then vocs else list_append(vocs, addressee) end as vocs, addressee from g
  where len(vocs) > 0 or addressee is not null""",
)


def marked(s, d):
    """Lines with what the sieves need: some tagged, some with a beat or a final mention, some that address people."""
    q = U.dialogue(units(s, d))
    k = lambda m, r: F.when(F.col("id") % m == r, F.col("speaker"))
    vocs = F.when(F.col("id") % 4 == 1, F.array(F.col("speaker"), F.lit("Mayor"))).when(F.col("id") % 6 == 0, F.array(F.lit("Orrin"))).otherwise(F.array().cast("array<string>"))
    return q.select(
        "book", F.floor(F.col("para") / 50).alias("run"), "id", "para", k(9, 0).alias("tag"), k(8, 5).alias("beat"), k(10, 2).alias("pfinal"),
        vocs.alias("vocs"), F.when(F.col("id") % 6 == 0, "Orrin").alias("addressee"), (F.col("para") % 5 != 0).alias("bare"),
    )


add(
    "att_sieves", lambda s, d: A.sieves(marked(s, d)).select("book", "id", "speaker"),
    f"""with {V.UNITS}, q as (select book, para // 50 as run, id, para, case when id % 9 = 0 then speaker end as tag, case
  when id % 8 = 5 then speaker end as beat, case when id % 10 = 2 then speaker end as pf,
  case when id % 4 = 1 then [speaker, 'Mayor'] when id % 6 = 0 then ['Orrin'] else []::varchar[] end as vocs from units where kind = 'dialogue'),
l as (select *, case when para - lag(para) over w between 0 and 2 then lag(vocs) over w end as pv from q window w as (partition by book, run order by id))
select book, id, coalesce(tag, case when not list_contains(vocs, beat) then beat end, case when not list_contains(vocs, pv[-1]) then pv[-1] end, case
  when not list_contains(vocs, pf) then pf end) as speaker from l""",
)
add("att_two_apart", lambda s, d: A.two_apart(A.sieves(marked(s, d))).select("book", "id", "speaker"))
add("att_run_alternate", lambda s, d: A.resolve_runs(marked(s, d)).select("book", "id", "speaker"))
_AFTER, _BEFORE, _PART = "|".join(L.SAYS_AFTER), "|".join(L.SAYS_BEFORE), f"[A-Z][a-zA-Z{_SQ}’.\\-]+"
add(
    "agg_text_speakers", lambda s, d: A.text_speakers(quotes(s, d).select("book", F.concat("before", "text", "after").alias("text"))),
    f"""with {QUOTES}, x as (select book, before || text || after as text from quotes)
select distinct book, lower(n) as first_name from (select book, unnest(list_concat(regexp_extract_all(text, '({_PART})(?:\\s+{_PART})?\\s+(?:{_AFTER})\\b', 1),
  regexp_extract_all(text, '\\b(?:{_BEFORE})\\s+({_PART})', 1))) as n from x)""",
)
