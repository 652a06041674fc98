"""Batch twins of the streams, and queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.operators import units as U
from parlance.operators import voice as O
from parlance.plans import views as V
from parlance.plans.units_plans import CASTING, LINES, casting
from parlance.sources import files as S
from parlance.sources.tables import scratch
from parlance.streaming import chat as C

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def packets(s, d):
    return V.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 1000 * 400).alias("n_bytes"))


_us = lambda c: F.unix_micros(c)
_SESS = """p as (select user_id, ts, event_id % 1000 * 400 as b from events), f as (select *, case when ts - lag(ts) over (partition by user_id
  order by ts) <= interval 30 minutes then 0 else 1 end as new from p),
g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as i from f), u as (select user_id, epoch_us(min(ts)) as start_us,
  epoch_us(max(ts)) as end_us, count(*) as n, cast(sum(b) as bigint) as n_bytes from g group by user_id, i)"""


def _utter(s, d):
    return C.utterance_stream(packets(s, d), "30 minutes").select("user_id", _us("start").alias("start_us"), _us("end").alias("end_us"), "n", "n_bytes")


add("str_utter", _utter, f"with {_SESS} select * from u")
add("str_minlen", lambda s, d: C.min_audio(_utter(s, d), 1.0), f"with {_SESS} select * from u where n_bytes / 192000 >= 1.0")
humans = lambda c: c % 4
add(
    "str_trigger", lambda s, d: V.messages(s, d).select("channel", "turn", C.addressed(F.col("content"), F.col("channel") % 4, ["the", "erin"]).alias("reply")),
    f"with {V.MESSAGES} select channel, turn, channel % 4 <= 1 or regexp_matches(regexp_replace(lower(content), '[^a-z0-9'' ]', ' ', 'g'), '(^|[^a-z0-9_])(the|erin)($|[^a-z0-9_])') as reply from messages",
)
add(
    "win_history", lambda s, d: C.history(V.messages(s, d)).select("channel", "turn", "context"),
    f"with {V.MESSAGES} select channel, turn, list(speaker || ': ' || content) over (partition by channel order by turn rows between 23 preceding and current row) as context from messages",
)
add("str_reply_sent", lambda s, d: C.reply_sentences(V.messages(s, d)).select("channel", "turn", "n", "sentence"))
add(
    "str_latency", lambda s, d: C.latency_stream(V.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 97 / 1000.0).alias("wait_s"))).select(_us(F.col("w.start")).alias("start_us"), "starved", "mean_wait", "n"),
    "select epoch_us(date_trunc('hour', ts)) as start_us, count(*) filter (where event_id % 97 / 1000.0 > 0.05) as starved, round(avg(event_id % 97 / 1000.0::double), 4) as mean_wait, count(*) as n from events group by 1",
)
add(
    "top_passages", lambda s, d: O.passages(V.doc_lines(s, d).select("doc_id", "line_no", F.col("line").alias("text")), "doc_id", "line_no"),
    f"""with {V.LINES}, r as (select doc_id, line, row_number() over (partition by doc_id order by abs(length(line) - 120), line_no) as r from doc_lines where line <> ''),
p as (select doc_id, left(string_agg(line, ' ' order by r), 400) as passage from r where r <= 2 group by 1)
select d.doc_id, coalesce(passage, '') as passage from (select distinct doc_id from doc_lines) d left join p on p.doc_id = d.doc_id""",
)


def settings(s, d):
    raw = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct((F.col("event_id") % 10 / 10.0).cast("string").alias("temperature"), F.when(F.col("event_id") % 3 == 0, "many").otherwise("4").alias("candidates"))))
    return V.table(s, d, "events").select("event_id", S.load_settings(raw).alias("settings"))


_ST = "e as (select event_id, case when event_id % 7 = 0 then 0.75 else event_id % 10 / 10.0 end::double as temperature, case when event_id % 7 = 0 or event_id % 3 = 0 then 3 else 4 end as candidates from events)"
add("src_settings", lambda s, d: settings(s, d).select("event_id", F.element_at("settings", "temperature").try_cast("double").alias("temperature"), F.element_at("settings", "cfg_weight").alias("cfg_weight")), f"with {_ST} select event_id, temperature, '0.5' as cfg_weight from e")
add("src_settings_coerce", lambda s, d: settings(s, d).select("event_id", *S.coerce_settings(F.col("settings"))), f"with {_ST} select event_id, 0.5::double as exaggeration, 0.5::double as cfg_weight, temperature, candidates from e")
add(
    "src_text", lambda s, d: S.merge_texts(V.documents(s, d).select(F.col("source").alias("folder"), F.floor(F.col("doc_id") / 10).alias("part"), "doc_id", "text"), ["folder", "part"], "doc_id"),
    "select source as folder, doc_id // 10 as part, string_agg(text, chr(10) || chr(10) order by doc_id) as text from documents group by 1, 2",
)


def _rows(s, d):
    return V.documents(s, d).select(F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("|"), F.replace("text", F.lit("|"), F.lit(" "))))).alias("row"))


add(
    "src_metadata", lambda s, d: S.read_dataset(_rows(s, d), V.documents(s, d).where("lang <> 'de'").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("utt_id"))),
    "select 'u' || doc_id as utt_id, replace(text, '|', ' ') as text from documents where lang <> 'de' and doc_id % 9 <> 0",
)


def _characters(s, d):
    """A character file for each event, some of them broken; a few verbs are verbs of speech."""
    verb = F.element_at(F.array(*[F.lit(v) for v in ("Said", "ran", "Warned", "slept", "began")]), (F.col("event_id") % 5 + 1).cast("int"))
    good = F.concat(F.lit('{"characters":[{"id":"7","agent":[{"w":"'), verb, F.lit('"}]}]}'))
    return V.table(s, d, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(good).alias("json"))


add("src_nlp_chars", lambda s, d: S.speech_agents(_characters(s, d)), "select event_id as doc_id, '7' as coref from events where event_id % 7 <> 0 and event_id % 5 in (0, 2, 4)")


def _runs(s, d):
    return V.documents(s, d).select(F.col("doc_id").alias("run_id"), F.col("text").alias("prompt"), F.array("source", "lang").alias("files"), (F.col("doc_id") % 10 / 10.0).alias("temperature"))


add(
    "snk_manifest", lambda s, d: S.manifest_json(_runs(s, d), "run_id"),
    """select doc_id as run_id, '{"run_id":' || doc_id || ',"prompt":"","files":"' || source || '|' || lang || '","temperature":' || (doc_id % 10 / 10.0::double)::varchar || '}' as manifest from documents""",
)


def _stored(s, d):
    path = scratch(s, "manifest")
    S.write_manifest(_runs(s, d), path)
    rows = s.read.option("header", True).csv(f"{path}/csv")
    return rows.select(F.col("run_id").cast("long").alias("run_id"), F.coalesce("prompt", F.lit("")).alias("prompt"), "files", F.col("temperature").cast("double").alias("temperature"))


add("snk_manifest_csv", _stored, "select doc_id as run_id, '' as prompt, source || '|' || lang as files, doc_id % 10 / 10.0::double as temperature from documents")


def _cached(s, d):
    """Documents as books: the even ones are stored in two runs, then all are looked up."""
    path = scratch(s, "analysis")
    books = V.documents(s, d).select("doc_id", S.book_key(F.col("text").cast("binary")).alias("book_key"))
    S.write_analysis(books.where("doc_id % 4 = 0").dropDuplicates(["book_key"]), path)
    S.write_analysis(books.where("doc_id % 2 = 0").dropDuplicates(["book_key"]), path)
    left = S.not_stored(books, path).select("doc_id", F.lit(False).alias("cached"))
    return books.join(left, "doc_id", "left").select("doc_id", "book_key", F.coalesce("cached", F.lit(True)).alias("cached"))


add("snk_analysis", _cached, "select doc_id, left(sha1(text), 16) as book_key, bool_or(doc_id % 2 = 0) over (partition by sha1(text)) as cached from documents")
add(
    "snk_progress", lambda s, d: S.progress(V.table(s, d, "events").select(F.col("user_id").alias("book"), "ts", "event_id", (F.col("event_id") % 50 - 5).alias("start"), (F.col("event_id") % 3).alias("at")), F.col("event_id") % 4 == 1),
    "select user_id as book, arg_max(greatest(0, event_id % 50 - 5 + event_id % 3 - 1), (ts, event_id)) as unit from events group by 1 having arg_max(event_id, (ts, event_id)) % 4 <> 1",
)
add(
    "set_voices", lambda s, d: S.available_voices(casting(s, d).where("voice is not null"), V.documents(s, d).select(F.upper("source").alias("voice")), V.documents(s, d).select(F.col("source").alias("voice"))),
    f"with {V.UNITS}, {CASTING} select lower(voice) as key, min(voice) as voice from (select voice from casting where voice is not null union all select upper(source) from documents union all select source from documents) group by 1",
)
add(
    "join_valid_voice", lambda s, d: U.valid_voices(U.voice_usage(U.cast_lines(V.book_units(s, d), casting(s, d))), casting(s, d).where("role <> 'Tamsin'")),
    f"with {V.UNITS}, {CASTING}, {LINES} select book, voice, count(*) as n from lines where voice in (select voice from casting where role <> 'Tamsin') group by 1, 2",
)


def _reply_sql() -> str:
    from parlance.plans import text_plans as T

    clean = T.squeeze(T.rep(T.rep("content", "(?s)<think>.*?</think>", ""), r"[*_#`]|\[[^\n]*?\]|\(laughs?\)", " "))
    return f"""with {V.MESSAGES}, c as (select channel, turn, speaker, {clean} as text from messages),
s as (select channel, turn, speaker, case when len({T.SENTENCES}) > 0 then {T.SENTENCES} else [{T.strip('text')}] end as parts from c)
select channel, turn, unnest(range(len(parts)))::integer as n, unnest(parts) as sentence from s"""


ORACLES["str_reply_sent"] = _reply_sql()
