"""Streams give what their batch twins give."""

from __future__ import annotations

import gzip
import random

from pyspark.sql import functions as F

from parlance.functions import text as X
from parlance.functions.segments import pack_250, packed_lines
from parlance.plans import registry
from parlance.streaming import chat as C

FAR = "2024-01-02 00:00:00"


def played(spark, df, folder, fn, mode="append"):
    """Writes df as files, streams them in two batches and returns what came out."""
    df.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = fn(stream).writeStream.outputMode(mode).format("memory").queryName("played").option("checkpointLocation", f"{folder}/cp").start()
    q.processAllAvailable()
    q.stop()
    return spark.table("played").collect()


def packets(spark):
    at = [0, 699, 1400, 2200, 33000] + [40000 + 500 * k for k in range(70)]
    rows = [(1, t, 100000) for t in at] + [(2, 5000, 10)]
    df = spark.createDataFrame(rows, "user_id long, ms long, n_bytes long").select("user_id", F.timestamp_micros(F.col("ms") * 1000 + F.lit(1704067200000000)).alias("ts"), "n_bytes")
    return df.union(spark.createDataFrame([(9, 0)], "user_id long, n_bytes long").select("user_id", F.to_timestamp(F.lit(FAR)).alias("ts"), F.col("n_bytes")))


def test_utterances(spark, tmp_path):
    df = packets(spark)
    batch = {tuple(r) for r in C.utterance_stream(df).where("user_id < 9").collect()}
    stream = {tuple(r) for r in played(spark, df, tmp_path, C.utterance_stream)}
    assert stream == batch and sorted(n for u, _, _, n, _ in batch if u == 1) == [1, 1, 1, 2, 70]
    assert {r["user_id"] for r in C.min_audio(C.utterance_stream(df)).collect()} == {1}


def test_long_utterances_are_closed(spark, tmp_path):
    got = played(spark, packets(spark), tmp_path, C.utterance_stream_max)
    ours = sorted((r["start_us"] - 1704067200000000, r["n"]) for r in got if r["user_id"] == 1)
    assert ours[0] == (0, 2) and all(r["end_us"] - r["start_us"] < 30_000_000 for r in got)


def test_trigger(spark):
    rows = [(3, "hey N what do you think", True), (3, "nice weather today", False), (1, "nice weather today", True), (2, "isn't that right N", True), (2, "Nothing", False)]
    df = spark.createDataFrame(rows, "humans long, text string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", C.addressed(F.col("text"), F.col("humans"), ["N"])).collect())


def test_history_and_gain(spark, tmp_path):
    df = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(30)], "channel long, turn long, speaker string, content string")
    got = {r["turn"]: r["context"] for r in played(spark, df, tmp_path / "h", lambda s: C.history_stream(s, 24))}
    assert got == {r["turn"]: r["context"] for r in C.history(df, 24).collect()} and len(got[29]) == 24
    from parlance.operators.voice import smooth_gain

    levels = spark.createDataFrame([(1, k, None if k % 5 == 0 else -30.0 + k) for k in range(12)], "clip long, seq long, dbfs double")
    got = {(r["seq"], r["gain"]) for r in played(spark, levels, tmp_path / "g", lambda s: C.gain_stream(s, -20.0))}
    assert got == {(r["seq"], r["gain"]) for r in smooth_gain(levels, -20.0).collect()}


def test_files_become_chunks(spark, tmp_path):
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_text("One. Two.\n\nThree.12 Four " + "word " * 80)
    q = C.chunk_stream(spark, str(tmp_path / "txt")).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("chunks").collect()
    assert rows[0]["file"] == "a.txt" and rows[0]["chunk"].startswith("One. Two. Three.")


def test_chunks_of_lines_are_those_of_whole_files(spark, tmp_path):
    r = random.Random(8)
    glue = [" ", " ", " ", "  ", "\n", " \n", "\n\n", "\r\n", "\t", "\u2003", "\n\u00a0\n"]
    for k in range(40):
        words = [r.choice(["so", "Then", "end.", "End!12", 'said."3', "3.5", "why?", "x" * 90, "...", "gr\xfc\xdfe", "\u201chm.\u201d4"]) for _ in range(r.choice([0, 1, 30, 900]))]
        text = "".join(w + r.choice(glue) for w in words)
        with (gzip.open if k % 4 == 3 else open)(tmp_path / f"{k}.txt{'.gz' if k % 4 == 3 else ''}", "wt", newline="") as f:
            f.write(r.choice(glue) + text)
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(pack_250(X.strip_ref_numbers(X.normalize_ws(F.col("value"))))).alias("k", "chunk"))
    want = sorted(map(tuple, whole.collect()))
    conf = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for name, set_ in (("whole", {}), ("parted", conf)):
        for k, v in set_.items():
            spark.conf.set(k, v)
        try:
            q = C.chunk_stream(spark, str(tmp_path)).writeStream.format("memory").queryName(f"chunks_{name}").option("checkpointLocation", f"{tmp_path}-{name}").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            for k in set_:
                spark.conf.unset(k)
        assert sorted(map(tuple, spark.table(f"chunks_{name}").collect())) == want


def test_large_files_are_followed_by_lines(spark, tmp_path):
    """Chunks leave while later lines are still to come."""
    lines = [((f"Line {k} ends.", "and it goes on"), False, k % 2 == 0) for k in range(200_000)]
    given, got = iter(lines), 0
    for chunk in packed_lines(given):
        got += 1
        assert len(chunk) < 300
        if got == 10:
            assert next(given)[0][0] != lines[-1][0][0]  # the first chunks come long before the last line is read
    spark.createDataFrame([(k, f"Text {k}. It has\nlines. " * 9) for k in range(30)], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["str_files"](spark, str(tmp_path))
    assert got.columns == ["chunk_idx", "chunk"] and got.where("chunk_idx = 0").count() in (1, 2)


def dealt(spark, df, folder, batches, fn, name):
    """Streams df in batches told by the column `batch`, one after the other."""
    import os

    for k in batches:
        df.where(F.col("batch") == k).drop("batch").coalesce(1).write.parquet(f"{folder}/part{k}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        for f in os.listdir(f"{folder}/part{k}"):
            if f.endswith(".parquet"):
                os.rename(f"{folder}/part{k}/{f}", f"{folder}/in/{k}.parquet")
        stream = spark.readStream.schema(df.drop("batch").schema).parquet(f"{folder}/in")
        q = fn(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").option("path", f"{folder}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(map(str, spark.read.parquet(f"{folder}/out").collect()))


def test_batches_out_of_order_change_nothing(spark, tmp_path):
    """Two batches that overlap in time, in both orders, and one batch of all give the same rows."""
    at = lambda k: F.timestamp_micros(F.lit(1704067200000000) + k * 1_000_000)
    rows = spark.range(40).select((F.col("id") % 2).alias("channel"), F.col("id").alias("turn"), F.lit("user").alias("speaker"), F.concat(F.lit("m"), F.col("id")).alias("content"), at(F.col("id")).alias("ts"), (F.col("id") * 7 % 3 == 0).cast("int").alias("batch"))
    end = spark.createDataFrame([(9, 0, "user", "end", 2)], "channel long, turn long, speaker string, content string, batch int").withColumn("ts", F.to_timestamp(F.lit(FAR)))
    df = rows.unionByName(end)
    read = lambda s: C.history_stream(s, 3, "ts", "1 minute")
    one = dealt(spark, df.withColumn("batch", F.when(F.col("batch") < 2, 0).otherwise(2)), tmp_path / "one", [0, 2], read, "one")
    assert len(one) == 40
    assert dealt(spark, df, tmp_path / "two", [0, 1, 2], read, "two") == one == dealt(spark, df, tmp_path / "three", [1, 0, 2], read, "three")
    want = {r["turn"]: r["context"] for r in C.history(rows, 3).collect()}
    assert {r["turn"]: r["context"] for r in spark.read.parquet(str(tmp_path / "one" / "out")).collect()} == want
    levels = df.select(F.col("channel").alias("clip"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 > 0, -30.0 + F.col("turn")).alias("dbfs"), "ts", "batch")
    gain = lambda s: C.gain_stream(s, -20.0, "ts", "1 minute")
    from parlance.operators.voice import smooth_gain

    got = dealt(spark, levels, tmp_path / "gain", [1, 0, 2], gain, "gain")
    assert got == sorted(map(str, smooth_gain(levels.where("clip < 9"), -20.0).collect()))
