"""Reading and writing texts, NLP tables, dictionaries, settings, datasets and manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import lexicon as L

#: Voice settings and their defaults.
DEFAULTS = {"exaggeration": 0.5, "cfg_weight": 0.5, "temperature": 0.75, "candidates": 3}


def merge_texts(rows: DataFrame, group: list[str], order: str, text: str = "text") -> DataFrame:
    """One text for each group: its texts in order, blank lines between them."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias(text))


def _there(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """A source, or None if nothing is at the path."""
    try:
        return spark.read.format(kind).options(ignoreMissingFiles=True, ignoreCorruptFiles=True).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_texts(spark: SparkSession, paths: str | list[str], merge: bool = False, marked: bool = False) -> DataFrame:
    """(path, base, text) of whole UTF-8 text files; merged: (path, text), one text for each folder, in the order of the paths.

    Paths where nothing is, files that go away or can't be read, empty ones, and files that
    aren't UTF-8 are passed over; `marked` keeps the last kind as rows without text and adds `readable`.
    Merging gathers a folder's texts in one row, as it is asked for; keep folders to what a book is.
    """
    found = [p for p in ([paths] if isinstance(paths, str) else paths) if _there(spark, p, "binaryFile") is not None]
    schema = "path string, base string, text string, readable boolean"
    if found:
        files = spark.read.format("binaryFile").options(ignoreMissingFiles=True, ignoreCorruptFiles=True).load(found)
        base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
        text = F.try_validate_utf8(F.col("content").cast("string"))
        rows = files.select("path", base.alias("base"), text.alias("text"), text.isNotNull().alias("readable"))
    else:
        rows = spark.createDataFrame([], schema)
    if marked and not merge:
        return rows
    rows = rows.where("readable").drop("readable")
    if not merge:
        return rows
    return merge_texts(rows.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")), ["folder"], "path").withColumnRenamed("folder", "path")


def read_nlp(spark: SparkSession, path: str, ints: tuple[str, ...], columns: tuple[str, ...] = ()) -> DataFrame:
    """A tab-separated table without quoting; columns in `ints` become whole numbers, what isn't one null.

    Each file begins with the same header; without any, the table has no rows and `columns`.
    Only a line feed ends a line (after a return, if the header ends so), so fields keep all
    other characters; an empty field is empty text, a missing one null.
    """
    lines = spark.read.text(path, lineSep="\n")
    head = lines.where("_metadata.file_block_start = 0 and value <> ''").first()
    head = "\t".join(columns) if head is None else head["value"]
    rows = lines.where((F.col("value") != head) & (F.col("value") != ""))
    if head.endswith("\r"):
        rows = rows.select(F.regexp_replace("value", "\r$", "").alias("value"))
    fields = F.split("value", "\t", -1)
    names = [n for n in head.rstrip("\r").split("\t") if n]
    return rows.select(*[(F.get(fields, k).try_cast("long") if n in ints else F.get(fields, k)).alias(n) for k, n in enumerate(names)])


def write_nlp(rows: DataFrame, path: str) -> None:
    """Rows as read_nlp reads them, a header in each file; texts hold neither tabs nor line feeds."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("\t", *map(text, rows.columns))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a partition, so of a file
    headed = F.when(first, F.concat_ws("\n", F.lit("\t".join(rows.columns)), line)).otherwise(line)
    rows.select(headed.alias("value")).write.text(path, lineSep="\n")


def speech_agents(chars: DataFrame, verbs=tuple(L.SPEAK_VERBS)) -> DataFrame:
    """Ids of characters one of whose agent verbs is a verb of speech; a broken file gives none (doc_id, json)."""
    parsed = F.from_json("json", "characters array<struct<id:string,agent:array<struct<w:string>>>>")
    each = chars.select("doc_id", F.explode(parsed["characters"]).alias("c"))
    spoken = F.arrays_overlap(F.transform("c.agent", lambda a: F.lower(a["w"])), F.array(*[F.lit(v) for v in verbs]))
    return each.where(spoken).select("doc_id", F.col("c.id").alias("coref"))


def read_dataset(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """Rows `id|text|text` with at least two fields whose clip exists."""
    parts = F.split("row", r"\|")
    return rows.where(F.size(parts) >= 2).select(F.get(parts, 0).alias("utt_id"), F.get(parts, 1).alias("text")).join(clips.select("utt_id"), "utt_id", "left_semi")


def heteronyms(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(word, opt, ipa, hint, say) from an editable JSON dictionary; the built-in one where none is, or where it can't be read."""
    parsed = F.from_json("text", "map<string,array<array<string>>>")
    table = None if path is None else read_texts(spark, path).select(parsed.alias("m")).where("m is not null")
    if table is None or table.isEmpty():
        rows = [(w, k + 1, *r) for w, readings in L.HETERONYMS.items() for k, r in enumerate(readings)]
        return spark.createDataFrame(rows, "word string, opt int, ipa string, hint string, say string")
    each = table.select(F.explode("m").alias("word", "readings")).select(F.lower("word").alias("word"), F.posexplode("readings").alias("k", "r"))
    return each.select("word", (F.col("k") + 1).alias("opt"), F.get("r", 0).alias("ipa"), F.get("r", 1).alias("hint"), F.get("r", 2).alias("say"))


def load_settings(stored: Column, defaults: dict = DEFAULTS) -> Column:
    """Stored JSON settings over the defaults; what can't be read gives the defaults."""
    base = F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (k, str(v))])
    got = F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, v: ~F.map_contains_key(got, k))), F.map_entries(got)))


def coerce_settings(settings: Column, defaults: dict = DEFAULTS) -> list[Column]:
    """A typed column for each setting; a value that is no number falls back."""
    return [F.coalesce(F.element_at(settings, k).try_cast("int" if isinstance(v, int) else "double"), F.lit(v)).alias(k) for k, v in defaults.items()]


def manifest(runs: DataFrame, blank: tuple[str, ...] = ("prompt",)) -> DataFrame:
    """Settings of runs, one row each, as they are stored: lists joined by |, prompt text left out, the rest as it is."""
    joined = lambda f: F.array_join(F.transform(f.name, lambda x: x.cast("string")), "|") if f.dataType.typeName() == "array" else F.col(f.name)
    return runs.select(*[(F.lit("") if f.name in blank else joined(f)).alias(f.name) for f in runs.schema.fields])


def manifest_json(runs: DataFrame, key: str) -> DataFrame:
    """(key, manifest): the stored settings of each run as one JSON text."""
    return manifest(runs).select(F.col(key), F.to_json(F.struct("*")).alias("manifest"))


def write_manifest(runs: DataFrame, path: str) -> None:
    """One JSON line and one CSV row, with a header, for each run, below path/json and path/csv."""
    rows = manifest(runs)
    rows.write.json(f"{path}/json")
    rows.write.option("header", True).option("emptyValue", "").csv(f"{path}/csv")


def book_key(content: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of a book's bytes."""
    return F.substring(F.sha1(content), 1, 16)


def progress(log: DataFrame, ended: Column | None = None) -> DataFrame:
    """The last place in each book from an append-only log (book, ts, event_id, start, at).

    A book whose last event is one where `ended` holds has been read to its end and has no place.
    """
    place = F.greatest(F.lit(0).cast("long"), F.col("start") + F.col("at") - 1)
    over = F.lit(False) if ended is None else F.coalesce(ended, F.lit(False))
    last = log.groupBy("book").agg(F.max_by(F.struct(place.alias("unit"), over.alias("over")), F.struct("ts", "event_id")).alias("l"))
    return last.where("not l.over").select("book", F.col("l.unit").alias("unit"))


def write_dataset(rows: DataFrame, path: str) -> None:
    """Text lines `id|clean|clean`, one folder a voice."""
    clean = F.trim(F.replace("text", F.lit("|"), F.lit(" ")))
    rows.select("voice", F.concat_ws("|", "utt_id", clean, clean).alias("value")).write.partitionBy("voice").text(path)


def stored_analysis(spark: SparkSession, path: str) -> DataFrame | None:
    """The units stored below a path, with their book_key; None where nothing is stored."""
    return _there(spark, path, "parquet")


def not_stored(books: DataFrame, path: str) -> DataFrame:
    """Books (book_key, ..) whose analysis isn't stored below the path: the work that is left.

    Keys lie in folders by their first two digits; only key columns are read.
    """
    stored = stored_analysis(books.sparkSession, path)
    return books if stored is None else books.join(stored.select("book_key").distinct(), "book_key", "left_anti")


def write_analysis(units: DataFrame, path: str) -> None:
    """Adds the units (book_key, ..) of books that aren't stored yet; what is stored stays as it is.

    A key is made of a book's bytes, so a changed book is another one. Writing the same
    units again writes nothing.
    """
    left = not_stored(units, path).withColumn("head", F.substring("book_key", 1, 2))
    if not left.isEmpty():
        left.repartition("head").write.mode("append").partitionBy("head").parquet(path)


def available_voices(*tables: DataFrame) -> DataFrame:
    """Distinct voices of all tables, the same name in any case counted once."""
    rows = tables[0].select("voice")
    for t in tables[1:]:
        rows = rows.union(t.select("voice"))
    return rows.groupBy(F.lower("voice").alias("key")).agg(F.min("voice").alias("voice"))
