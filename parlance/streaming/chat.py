"""Live channels: utterances from packets, triggers, history, gain and latency.

Each function takes a batch or a streaming DataFrame unless it says otherwise. Event time
with a watermark is our choice; later rows are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as X
from parlance.functions.segments import packed_lines

#: Bytes of a second of stereo 16-bit audio at 48 kHz.
BYTES_A_SECOND = 48_000 * 4


def utterance_stream(packets: DataFrame, gap: str = "700 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(user_id, start, end, n, n_bytes): packets (user_id, ts, n_bytes) parted by silences over `gap`."""
    rows = packets.withWatermark("ts", late) if packets.isStreaming else packets
    w = F.session_window("ts", gap)
    return rows.groupBy("user_id", w).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes")).drop("session_window")


def utterance_stream_max(packets: DataFrame, gap_ms: int = 700, max_ms: int = 30_000, late: str = "10 seconds") -> DataFrame:
    """Like utterance_stream, streaming only, but an open utterance is also closed after max_ms."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        start, last, n, size = state.get if state.exists else (0, 0, 0, 0)
        if not state.hasTimedOut:
            rows = sorted((int(t.value // 1000) if hasattr(t, "value") else int(t), int(b)) for f in frames for t, b in zip(f["ts"], f["n_bytes"]))
            for t, b in rows:
                if n and (t - last > gap_ms * 1000 or t - start >= max_ms * 1000):
                    out.append((key[0], start, last, n, size))
                    n = size = 0
                start, last, n, size = (start if n else t), t, n + 1, size + b
            state.update((start, last, n, size))
            state.setTimeoutTimestamp(max(last // 1000 + gap_ms, state.getCurrentWatermarkMs() + 1))
        else:
            if n:
                out.append((key[0], start, last, n, size))
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "start_us", "end_us", "n", "n_bytes"])

    rows = packets.withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(work, "user_id long, start_us long, end_us long, n long, n_bytes long", "start long, last long, n long, size long", "append", "EventTimeTimeout")


def min_audio(utterances: DataFrame, seconds: float = 0.4) -> DataFrame:
    return utterances.where(F.col("n_bytes") / BYTES_A_SECOND >= seconds)


def addressed(text: Column, humans: Column, names: list[str]) -> Column:
    """Whether to reply: alone with one human, or a name is heard as a word."""
    low = F.regexp_replace(F.lower(text), "[^a-z0-9' ]", " ")
    heard = F.lit(False)
    for n in names:
        heard = heard | low.rlike(rf"(?<![a-z0-9_]){n.lower()}(?![a-z0-9_])")
    return (humans <= 1) | heard


def history(messages: DataFrame, k: int = 24) -> DataFrame:
    """Batch: each message with the last k of its channel, itself included."""
    w = Window.partitionBy("channel").orderBy("turn").rowsBetween(-(k - 1), 0)
    return messages.withColumn("context", F.collect_list(F.concat("speaker", F.lit(": "), "content")).over(w))


def in_event_order(rows: DataFrame, key: str, inputs: list[str], fields: str, step: Callable, ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Streaming: a rule that follows each key's rows in the order of their time, however batches deal them.

    A row is held back until the watermark has passed its time; then no row before it can
    come any more, and step(carry, row) gives what is carried on (None at first, as JSON
    can hold it) and the columns of `fields`. rows of a key with equal times go by their
    inputs. State holds the rows of the last `late` only. Rows later than that are dropped.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v

    def work(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, carry = (list(state.get[0]), json.loads(state.get[1])) if state.exists else ([], None)
        if not state.hasTimedOut:
            for f in frames:
                at = f["__us"].tolist()
                held += [json.dumps([t, [plain(v) for v in row]]) for t, row in zip(at, f[inputs].itertuples(index=False))]
        now = state.getCurrentWatermarkMs()
        waiting = sorted((json.loads(x) for x in held), key=lambda x: (x[0], [(v is not None, v) for v in x[1]]))
        ready = [x for x in waiting if x[0] < now * 1000]
        out = []
        for _, row in ready:
            carry, said = step(carry, row)
            out.append((group[0], *said))
        waiting = waiting[len(ready) :]
        state.update(([json.dumps(x) for x in waiting], json.dumps(carry)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, now + 1))
        yield pd.DataFrame(out, columns=[key, *names])

    timed = rows.withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("__us"), *inputs)
    kind = rows.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(work, f"{key} {kind}, {fields}", "held array<string>, carry string", "append", "EventTimeTimeout")


def history_stream(messages: DataFrame, k: int = 24, ts: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Streaming: each message (channel, turn, speaker, content) with the last k of its channel, itself included.

    In the order in which they came, or, if `ts` names their time, in that order (in_event_order).
    """
    if ts is not None:

        def follow(kept, row):
            turn, speaker, content = row
            kept = [*(kept or []), f"{speaker}: {content}"][-k:]
            return kept, (turn, kept)

        return in_event_order(messages, "channel", ["turn", "speaker", "content"], "turn long, context array<string>", follow, ts, late)

    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        out = []
        for turn, line in sorted((int(t), f"{s}: {c}") for f in frames for t, s, c in zip(f["turn"], f["speaker"], f["content"])):
            kept = [*kept, line][-k:]
            out.append((key[0], turn, kept))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["channel", "turn", "context"])

    return messages.groupBy("channel").applyInPandasWithState(work, "channel long, turn long, context array<string>", "lines array<string>", "append", "NoTimeout")


def reply_sentences(replies: DataFrame, text: str = "content") -> DataFrame:
    """Cleaned replies as one row a sentence."""
    keep = [c for c in replies.columns if c != text]
    return replies.select(*keep, F.posexplode(X.split_sentences(X.speakable(F.col(text)))).alias("n", "sentence"))


def gain_stream(levels: DataFrame, target: float, ts: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Streaming: smoothed gain of each clip's chunks (clip, seq, dbfs), as they came, or in the order of their time `ts` (in_event_order)."""
    if ts is not None:

        def follow(g, row):
            seq, db = row
            if db is not None:
                new = 10 ** (max(-12.0, min(12.0, target - db)) / 20)
                g = new if g is None else 0.7 * g + 0.3 * new
            return g, (seq, None if g is None else round(g, 5))

        return in_event_order(levels, "clip", ["seq", "dbfs"], "seq long, gain double", follow, ts, late)

    def work(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        g = state.get[0] if state.exists else None
        out = []
        for seq, db in sorted((int(s), d) for f in frames for s, d in zip(f["seq"], f["dbfs"])):
            if db is not None and db == db:
                new = 10 ** (max(-12.0, min(12.0, target - db)) / 20)
                g = new if g is None else 0.7 * g + 0.3 * new
            out.append((key[0], seq, None if g is None else round(g, 5)))
        state.update((g,))
        yield pd.DataFrame(out, columns=["clip", "seq", "gain"])

    return levels.groupBy("clip").applyInPandasWithState(work, "clip long, seq long, gain double", "g double", "append", "NoTimeout")


def latency_stream(events: DataFrame, window: str = "1 hour", late: str = "10 seconds", starved_s: float = 0.05) -> DataFrame:
    """Waits above `starved_s` and the mean wait in windows of event time (ts, wait_s)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w")).agg(F.count_if(F.col("wait_s") > starved_s).alias("starved"), F.round(F.avg("wait_s"), 4).alias("mean_wait"), F.count(F.lit(1)).alias("n"))


#: Chunks that leave Python at once.
CHUNKS = 10_000


def _chunks_of(lines: Iterable[tuple[tuple, tuple]]) -> Iterator[tuple[str, int, str]]:
    """(file, chunk_idx, chunk) of ((path, file), line) in the order of the files."""
    for (_, file), own in groupby(lines, key=itemgetter(0)):
        yield from ((file, k, chunk) for k, chunk in enumerate(packed_lines(line for _, line in own)))


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streaming: new text files to speakable chunks as they land.

    Lines are cleaned and parted where they are read, and a file's lines are followed in
    order, so that a task holds some lines and never a file. A file that Spark parts into
    several splits (plain text, large) is gathered by one task for its order; compressed
    files are never parted.
    """
    columns, schema = ["path", "file", "sentences", "before", "after"], "file string, chunk_idx int, chunk string"
    meta = {"path": "file_path", "file": "file_name", "at": "file_block_start", "length": "file_block_length", "size": "file_size"}

    def lines(whole: bool) -> DataFrame:
        rows = spark.readStream.text(path, lineSep="\n").select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()])
        rows = rows.where((F.col("length") == F.col("size")) == whole)
        white = lambda at: F.col("value").rlike(at)
        clean = X.strip_ref_numbers(X.normalize_ws(F.col("value")))
        return rows.select("path", "file", "at", X.split_sentences(clean).alias("sentences"), white(f"^{X.W}").alias("before"), white(f"{X.W}\\z").alias("after"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns)))
        chunks = _chunks_of(((p, file), line) for p, file, *line in rows)
        while some := list(islice(chunks, CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some), (pa.string(), pa.int32(), pa.string()))], names=["file", "chunk_idx", "chunk"])

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = sorted((r for f in frames for r in zip(f["at"], f["n"], f["file"], *(f[c] for c in columns[2:]))), key=itemgetter(0, 1))
        chunks = _chunks_of(((key[0], file), (list(sentences), before, after)) for _, _, file, sentences, before, after in rows)
        while some := list(islice(chunks, CHUNKS)):
            yield pd.DataFrame(some, columns=["file", "chunk_idx", "chunk"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield b.append_column("n", pa.array(range(n, n + b.num_rows), pa.int64()))
            n += b.num_rows

    parted = lines(False)
    parted = parted.mapInArrow(number, T.StructType([*parted.schema.fields, T.StructField("n", T.LongType())]))
    gathered = parted.groupBy("path").applyInPandasWithState(gather, schema, "none int", "append", "NoTimeout")
    return lines(True).select(*columns).mapInArrow(follow, schema).unionByName(gathered)
