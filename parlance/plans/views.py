"""Tables that Spark derives from the given ones, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.ordered import carried_in_order, running_total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, line_no, line): the lines of every document."""
    return documents(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


LINES = """doc_lines as (select doc_id, source, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from documents)"""

_SPEAKERS = ((6, "Tamsin"), (9, "Orrin"), (11, "Tam"), (12, "Captain Vale"), (13, "Old Orrin"), (14, "Hello"), (15, "He"))


def book_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, id, para, kind, text, speaker): a source is a book, a document a paragraph, a line a unit.

    The running id is a running total in blocks, so a large book is not gathered in one task.
    """
    lines = running_total(doc_lines(spark, sf_dir).where("length(line) > 0"), ["source"], "doc_id", "line_no", F.lit(1), "id")
    k = F.pmod(F.col("doc_id") * 31 + F.col("line_no") * 17, F.lit(16))
    narration = (F.col("doc_id") + F.col("line_no")) % 3 == 0
    speaker = F.lit("Tamsin Vale")
    for most, name in reversed(_SPEAKERS):
        speaker = F.when(k < most, name).otherwise(speaker)
    return lines.select(
        F.col("source").alias("book"), F.col("id").cast("long").alias("id"), F.col("doc_id").alias("para"),
        F.when(narration, "narration").otherwise("dialogue").alias("kind"), F.col("line").alias("text"), F.when(narration, "Narrator").otherwise(speaker).alias("speaker"),
    )


UNITS = (
    LINES
    + """, units as (select source as book, row_number() over (partition by source order by doc_id, line_no) - 1 as id, doc_id as para,
  case when (doc_id + line_no) % 3 = 0 then 'narration' else 'dialogue' end as kind, line as text,
  case when (doc_id + line_no) % 3 = 0 then 'Narrator' """
    + " ".join(f"when k < {m} then '{n}'" for m, n in _SPEAKERS)
    + """ else 'Tamsin Vale' end as speaker
  from (select *, (doc_id * 31 + line_no * 17) % 16 as k from doc_lines where length(line) > 0))"""
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, seq, gap_ms, dur_ms, s_ms, e_ms): speech bursts of each clip, from the events of a user."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip"), "ts", "event_id", (F.col("event_id") * 37 % 20 * 100).alias("gap_ms"), (200 + F.col("event_id") * 53 % 60 * 100).alias("dur_ms")
    )
    sums = {"__n": (F.sum, F.lit(1)), "__at": (F.sum, F.col("gap_ms") + F.col("dur_ms"))}
    e = carried_in_order(e, ["clip"], [F.col("ts"), F.col("event_id")], sums)
    s_ms = (F.coalesce("__at", F.lit(0)) + F.col("gap_ms")).cast("long")
    return e.select("clip", (F.coalesce("__n", F.lit(0)) + 1).cast("long").alias("seq"), "gap_ms", "dur_ms", s_ms.alias("s_ms"), (s_ms + F.col("dur_ms")).alias("e_ms"))


SPANS = """spans as (select clip, seq, gap_ms, dur_ms, cast(sum(gap_ms + dur_ms) over (partition by clip order by seq) - dur_ms as bigint) as s_ms,
  cast(sum(gap_ms + dur_ms) over (partition by clip order by seq) as bigint) as e_ms
  from (select user_id as clip, row_number() over (partition by user_id order by ts, event_id) as seq, (event_id * 37) % 20 * 100 as gap_ms,
  200 + (event_id * 53) % 60 * 100 as dur_ms from events))"""


def spoken_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_idx, target): every line that has text, dealt by chunk."""
    lines = doc_lines(spark, sf_dir).where("length(line) > 0").select("doc_id", F.col("line_no").alias("chunk_idx"), F.col("line").alias("target"))
    # takes of a chunk stand together, as choosing among them needs
    return lines.repartition("doc_id", "chunk_idx")


def candidates(spark: SparkSession, sf_dir: str, **of_target: Callable[[Column], Column]) -> DataFrame:
    """Three takes of every line: exact, altered and cut to half (doc_id, chunk_idx, cand_idx, target, transcript, duration, bytes).

    A name given with a function is one more column, made of the target once for all takes.
    """
    chunks = spoken_chunks(spark, sf_dir).withColumns({name: make(F.col("target")) for name, make in of_target.items()})
    takes = chunks.withColumn("cand_idx", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    heard = F.when(F.col("cand_idx") == 0, F.col("target")).when(F.col("cand_idx") == 1, F.replace("target", F.lit("en"), F.lit("an"))).otherwise(F.substring("target", F.lit(1), F.floor(F.length("target") / 2).cast("int")))
    duration, size = F.length("target") / 15.0 + F.col("cand_idx"), F.length("target") * 40 + F.col("cand_idx") * 100
    return takes.select("doc_id", "chunk_idx", "cand_idx", "target", heard.alias("transcript"), duration.alias("duration"), size.cast("long").alias("bytes"), *of_target)


CANDIDATES = (
    LINES
    + """, candidates as (select doc_id, line_no as chunk_idx, cand_idx, line as target,
  case when cand_idx = 0 then line when cand_idx = 1 then replace(line, 'en', 'an') else left(line, length(line) // 2) end as transcript,
  length(line) / 15.0::double + cand_idx as duration, cast(length(line) * 40 + cand_idx * 100 as bigint) as bytes
  from doc_lines, (select unnest([0, 1, 2])::bigint as cand_idx) where length(line) > 0)"""
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel"), "turn", F.col("role").alias("speaker"), F.col("text").alias("content"))


MESSAGES = "messages as (select conv_id as channel, turn, role as speaker, text as content from conversations)"
