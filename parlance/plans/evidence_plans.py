"""Evidence lines, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import evidence as E
from parlance.plans import views as V
from parlance.plans.voice_plans import GAINS
from parlance.sources import files as S
from parlance.sources.tables import cut, scratch
from parlance.streaming import chat as C

QUERIES: dict = {}
ORACLES: dict = {}


def finished(stream: DataFrame) -> DataFrame:
    """What a stream over the files that are there now gives, written below the checkpoint folder."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _events(spark, sf_dir) -> DataFrame:
    """The events as a stream of files."""
    batch = V.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch(spark, "events")
    batch.write.parquet(path)
    return spark.readStream.schema(batch.schema).parquet(path)


def str_maxlen(spark, sf_dir):
    packets = _events(spark, sf_dir).select("user_id", "ts", (F.col("event_id") % 1000 * 400).alias("n_bytes"))
    return finished(C.utterance_stream_max(packets, 1_800_000, 3_600_000, "0 seconds"))


def str_gain(spark, sf_dir):
    levels = _events(spark, sf_dir).select(F.col("user_id").alias("clip"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 != 0, -30.0 + F.col("event_id") % 15).alias("dbfs"))
    return finished(C.gain_stream(levels, -20.0))


def str_history(spark, sf_dir):
    path = scratch(spark, "messages")
    batch = V.messages(spark, sf_dir).withColumn("turn", F.col("turn").cast("long"))
    batch.write.parquet(path)
    return finished(C.history_stream(spark.readStream.schema(batch.schema).parquet(path)))


def str_files(spark, sf_dir):
    path = scratch(spark, "texts")
    # compressed files are read as they are written, each by one task
    V.documents(spark, sf_dir).select(F.regexp_replace("text", "\n", " ").alias("value")).write.text(path, compression="gzip")
    return finished(C.chunk_stream(spark, path)).select("chunk_idx", "chunk")


def src_nlp_tsv(spark, sf_dir):
    path = scratch(spark, "tokens")
    words = V.documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "[ \\n\\t]+")).alias("token_id", "word"))
    S.write_nlp(words, path)
    return S.read_nlp(spark, path, ("doc_id", "token_id"), tuple(words.columns))


QUERIES["str_maxlen"] = str_maxlen
#: An utterance ends before a packet that comes over half an hour after the last one or an hour after the first; the last one of a user ends once the watermark has passed it.
ORACLES["str_maxlen"] = """
with recursive p as (select user_id, epoch_us(ts) as t, event_id % 1000 * 400 as b, row_number() over (partition by user_id order by epoch_us(ts),
  event_id % 1000 * 400) as rn, count(*) over (partition by user_id) as many from events),
r as (select user_id, rn, t, b, many, t as first, 0::bigint as i from p where rn = 1 union all
  select p.user_id, p.rn, p.t, p.b, p.many, case when p.t - r.t > 1800000000 or p.t - r.first >= 3600000000 then p.t else r.first end, r.i + case
  when p.t - r.t > 1800000000 or p.t - r.first >= 3600000000 then 1 else 0 end
  from r join p on p.user_id = r.user_id and p.rn = r.rn + 1)
select user_id, min(t) as start_us, max(t) as end_us, count(*) as n, cast(sum(b) as bigint) as n_bytes from r group by user_id, i
having max(rn) < max(many) or max(t) // 1000 + 1800000 < (select epoch_ms(max(ts)) from events)"""
QUERIES["str_gain"] = str_gain
ORACLES["str_gain"] = f"""
with recursive l as (select user_id as clip, event_id as seq, case when event_id % 7 <> 0 then -30.0::double + event_id % 15 end as dbfs,
  row_number() over (partition by user_id order by event_id) as rn from events),
{GAINS} select clip, seq, round(g, 5) as gain from r where rn > 0"""
QUERIES["str_files"] = str_files
QUERIES["str_history"] = str_history
QUERIES["src_nlp_tsv"] = src_nlp_tsv
ORACLES["str_history"] = f"with {V.MESSAGES} select channel, turn, list(speaker || ': ' || content) over (partition by channel order by turn rows between 23 preceding and current row) as context from messages"
ORACLES["src_nlp_tsv"] = "select doc_id, unnest(range(len(w))) as token_id, unnest(w) as word from (select doc_id, string_split_regex(text, '[ \\n\\t]+') as w from documents)"


#: For each speaker the one it is asked about, and the word by which that one is mentioned.
_ASKED = {
    "Tam": ("Tamsin", "Tamsin"), "Tamsin": ("Tamsin Vale", "Vale"), "Tamsin Vale": ("Captain Vale", "Vale"), "Captain Vale": ("Tamsin", "Tamsin"),
    "Orrin": ("Old Orrin", "Orrin"), "Old Orrin": ("Orrin", "Orrin"), "Hello": ("He", None), "He": ("Hello", "Hello"),
}


def _asked(spark, sf_dir):
    """Every speaker with one it may be."""
    other = F.create_map(*[F.lit(x) for name, (to, _) in _ASKED.items() for x in (name, to)])
    return V.book_units(spark, sf_dir).where("kind = 'dialogue'").select("book", F.col("speaker").alias("name")).distinct().withColumn("other", F.element_at(other, F.col("name")))


def _named(spark, sf_dir):
    """Units that name Tamsin here and there, in narration and in speech."""
    at = ((F.col("kind") == "narration") & (F.col("id") % 50 == 0)) | ((F.col("kind") == "dialogue") & (F.col("id") % 30 == 1))
    return V.book_units(spark, sf_dir).withColumn("text", F.when(at, F.concat(F.lit("Then Tamsin spoke. "), F.col("text"))).otherwise(F.col("text")))


def _evidence_sql(most: int, k: int, spread: bool) -> str:
    far = "exists (select 1 from units o where o.book = p.book and o.kind = 'dialogue' and o.speaker = p.other and o.id between u.id - 20 and u.id + 20)" if spread else "false"
    word = lambda t: f"list_contains(string_split_regex({t}, '[^\\p{{L}}\\p{{N}}_]+'), token)"
    return f"""
with {V.UNITS}, x as (select book, id, kind, speaker, case when (kind = 'narration' and id % 50 = 0) or (kind = 'dialogue'
  and id % 30 = 1) then 'Then Tamsin spoke. ' || text else text end as text from units),
a(name, other, token) as (values {', '.join(f"('{n}', '{o}', {'null' if t is None else repr(t)})" for n, (o, t) in _ASKED.items())}),
p as (select distinct u.book, a.name, a.other, a.token from units u join a on a.name = u.speaker where u.kind = 'dialogue'),
o0 as (select p.*, u.id, u.text, {far} as close from p join x u on u.book = p.book and u.speaker = p.name and u.kind = 'dialogue'),
own as (select * from (select *, bool_and(close) over (partition by book, name) as none from o0) where none or not close),
st as (select distinct o.book, o.name, o.id from own o join x n on n.book = o.book and n.kind = 'narration' and n.id between o.id - 2 and o.id + 2 and {word('n.text')}),
f as (select o.*, row_number() over (partition by o.book, o.name order by o.id) - 1 as pos, count(*) over (partition by o.book, o.name) as n, case
  when st.id is not null then 0 when {word('o.text')} then 1 end as prio
  from own o left join st on st.book = o.book and st.name = o.name and st.id = o.id),
named as (select book, name, other, id from (select *, row_number() over (partition by book, name order by prio, id) as r from f where prio is not null) where r <= {most}),
rest as (select f.*, case when pos = 0 then 0 when pos = n // 3 then 1 when pos = 2 * n // 3 then 2 when pos = n - 1 then 3 end as turn from f where pos in (0,
  n // 3, 2 * n // 3, n - 1) and not exists (select 1 from named m where m.book = f.book and m.name = f.name and m.id = f.id)),
ranked as (select *, row_number() over (partition by book, name order by turn) as r from rest)
select * from named union all select book, name, other, id from ranked where r <= {k} - (select count(*) from named m where m.book = ranked.book and m.name = ranked.name)"""


QUERIES["top_excerpt_ids"] = lambda s, d: E.evidence_lines(cut(_named(s, d)), _asked(s, d), 4)
ORACLES["top_excerpt_ids"] = _evidence_sql(4, 4, False)
QUERIES["top_excerpt_far"] = lambda s, d: E.evidence_lines(cut(_named(s, d)), _asked(s, d), 4, spread=True)
ORACLES["top_excerpt_far"] = _evidence_sql(1, 4, True)
