"""Choosing among synthesized candidates by what a transcriber heard."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import text as X
from parlance.functions.matching import ratios
from parlance.functions.segments import halve
from parlance.sources.tables import cut


#: Fixed value: the letters that are counted one by one.
LETTERS = "etaoinsr"


def attempt_plan(chunks: DataFrame, generations: int, candidates: int, tries: int, seed: int) -> DataFrame:
    """Every generation, candidate and attempt of each chunk with its seed."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = chunks.withColumn("gen", each(generations)).withColumn("cand_idx", each(candidates)).withColumn("attempt", each(tries))
    return rows.withColumn("seed", X.derive_seed(F.lit(seed).cast("long") + F.col("gen"), F.col("chunk_idx"), F.col("cand_idx"), F.col("attempt")))


def ceiling(a: Column, b: Column) -> Column:
    """The greatest ratio that two texts of these lengths can have."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)


def letter_ceiling(a: Column, b: Column, letters: str = LETTERS) -> Column:
    """The greatest ratio that two texts with these letters can have.

    Matching blocks can hold no letter more often than the text that has it more rarely.
    The given letters are counted one by one, all others together.
    """
    both = F.length(a) + F.length(b)
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    rest = lambda t: F.length(F.translate(t, letters, ""))
    shared = sum((F.least(count(a, c), count(b, c)) for c in letters), F.least(rest(a), rest(b)))
    return F.when(both == 0, 1.0).otherwise(2.0 * shared / both)


@F.pandas_udf(T.DoubleType())
def _ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Ratios of the pairs that have both texts; null for the others."""
    asked = (first.notna() & second.notna()).to_numpy()
    out = pd.Series(float("nan"), index=first.index)
    out[asked] = ratios(first[asked].tolist(), second[asked].tolist())
    return out.astype(object).where(asked, None)


def similarity(pairs: DataFrame, first: str, second: str, floor: float = 0.0, form: Callable[[Column], Column] | None = X.compare_form, formed: dict[str, str] | None = None) -> DataFrame:
    """pairs with `score`: matching-block ratio of the forms of two text columns (null if one is null).

    form makes what is compared of a text, by default words without case, punctuation and
    respellings; None compares texts as they are. `formed` names columns that hold the form of
    a text column already, as where many pairs share a text. Equal texts are formed once.
    Every score is the exact one, whatever `floor` a caller goes by. Where one form begins with
    all of the other, that one is the first matching block and nothing is left beside it, so
    lengths tell the ratio; all other pairs leave the JVM and are compared, by numpy in batches.
    """
    make, have = form or (lambda c: c), formed or {}
    of = lambda name: F.col(have[name]) if name in have else make(F.col(name))
    given, other, known, new = (first, second, "__a", "__b") if first in have else (second, first, "__b", "__a")
    forms = pairs.withColumn(known, of(given)).withColumn(new, F.when(F.col(given) == F.col(other), F.col(known)).otherwise(of(other)))
    a, b = F.col("__a"), F.col("__b")
    asked = forms.withColumn("__ask", ~(F.startswith(a, b) | F.startswith(b, a)))
    told = F.when(~F.col("__ask"), ceiling(a, b))
    return asked.withColumn("score", F.coalesce(_ratio(F.when(F.col("__ask"), a), F.when(F.col("__ask"), b)), told)).drop("__a", "__b", "__ask")


def gate(scored: DataFrame, first: float = 0.85, retry: float = 0.95, least_bytes: int = 1024) -> DataFrame:
    """Score 0 for files that are too small; passed by the round's threshold."""
    score = F.when(F.col("bytes") < least_bytes, 0.0).otherwise(F.col("score"))
    return scored.withColumn("score", score).withColumn("passed", F.col("score") >= F.when(F.col("round") == 1, first).otherwise(retry))


def select_best(gated: DataFrame, on_fail: str = "score") -> DataFrame:
    """One candidate a chunk: the shortest that passed, else the best score or the longest transcript."""
    worst = F.desc("score") if on_fail == "score" else F.desc(F.length("transcript"))
    w = Window.partitionBy("doc_id", "chunk_idx").orderBy(F.desc("passed"), F.when(F.col("passed"), F.col("duration")).asc(), worst, "cand_idx")
    return gated.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def select_first(candidates: DataFrame, least_bytes: int = 1024) -> DataFrame:
    w = Window.partitionBy("doc_id", "chunk_idx").orderBy("cand_idx", "attempt")
    return candidates.where(F.col("bytes") > least_bytes).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def retry_queue(gated: DataFrame, most: int) -> DataFrame:
    """Chunks that no candidate passed and that have attempts left."""
    at = gated.groupBy("doc_id", "chunk_idx").agg(F.max("passed").alias("ok"), F.max("attempt").alias("attempts"))
    return at.where(~F.col("ok") & (F.col("attempts") < most)).select("doc_id", "chunk_idx", "attempts")


def faithful(pairs: DataFrame, want: str, heard: str, least: float = 0.80, formed: dict[str, str] | None = None) -> DataFrame:
    """pairs with `score` and `ok`: close enough, and not much longer or shorter, as spoken words with numbers spelt out.

    A target without any spoken word passes with score 1; a null text gives null. `formed`
    names columns that hold X.norm_words of want, or of heard, already.
    """
    have = formed or {}
    of = lambda name: F.col(have[name]) if name in have else X.norm_words(F.col(name))
    same = F.col(want) == F.col(heard)
    if heard in have:
        forms = pairs.withColumn("__heard", of(heard)).withColumn("__want", F.when(same, F.col("__heard")).otherwise(of(want)))
    else:
        forms = pairs.withColumn("__want", of(want)).withColumn("__heard", F.when(same, F.col("__want")).otherwise(of(heard)))
    scored = similarity(forms, "__want", "__heard", form=None)
    slack = F.greatest(F.lit(10), F.floor(F.length("__want") * 0.2).cast("int"))
    ok = (F.col("score") >= least) & (F.abs(F.length("__heard") - F.length("__want")) <= slack)
    empty = F.col("__want") == ""
    return scored.withColumn("score", F.when(empty, 1.0).otherwise(F.col("score"))).withColumn("ok", F.when(empty, True).otherwise(ok)).drop("__want", "__heard")


def resplit(failed: DataFrame, text: str = "target", least: int = 25) -> DataFrame:
    """Chunks that failed, cut in halves where they are long enough and have two words."""
    two = F.when(F.length(text) >= least, halve(F.col(text)))
    return failed.withColumn("__two", two).where("__two is not null").select(*[c for c in failed.columns if c != text], F.posexplode("__two").alias("half", text))


def with_transcripts(candidates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Candidates with what a transcriber heard (doc_id, chunk_idx, cand_idx, transcript); nothing heard is empty text.

    Chunks are joined, and a candidate then takes its own, so takes that stand together stay where they are.
    """
    chunk = ["doc_id", "chunk_idx"]
    heard = transcripts.groupBy(*chunk).agg(F.collect_list(F.struct("cand_idx", "transcript")).alias("__heard"))
    own = F.filter("__heard", lambda h: F.coalesce(h["cand_idx"] == F.col("cand_idx"), F.lit(False)))
    rows = candidates.join(heard, chunk, "left").select(*candidates.columns, F.explode_outer(own).alias("__own"))
    return rows.select(*candidates.columns, F.coalesce("__own.transcript", F.lit("")).alias("transcript"))


def speak(chunks: DataFrame, attempt: Callable[[DataFrame], DataFrame], tries: int = 3, least: int = 25) -> DataFrame:
    """(doc_id, chunk_idx, path, text, attempt, score, ok): the attempt that is kept of every chunk, or of its parts.

    attempt() takes (doc_id, chunk_idx, path, text) and gives rows of these with attempt
    (from 0), score and ok. The first one that is ok counts; a chunk that fails `tries`
    times and has `least` characters and two words is cut in halves, path 0 and 1, which
    are tried anew, until nothing is left to cut; of a chunk that can't be cut the best
    attempt stays, the first of equals.
    """
    key = ["doc_id", "chunk_idx", "path", "text"]
    todo, done = chunks.select("doc_id", "chunk_idx", F.lit("").alias("path"), "text"), None
    while True:
        made = attempt(todo).where(F.col("attempt") < tries)
        row = F.struct("attempt", "score", "ok")
        best = F.coalesce(F.min_by(row, F.when(F.col("ok"), F.col("attempt"))), F.max_by(row, F.struct(F.col("score"), -F.col("attempt"))))
        tried = cut(made.groupBy(*key).agg(best.alias("b")).select(*key, "b.*"))
        two = F.when(~F.col("ok") & (F.length("text") >= least), halve(F.col("text")))
        kept = tried.where(two.isNull())
        done = kept if done is None else done.unionByName(kept)
        todo = tried.select("doc_id", "chunk_idx", F.col("path").alias("__p"), F.posexplode(two).alias("half", "text"))
        todo = todo.select("doc_id", "chunk_idx", F.concat("__p", F.col("half").cast("string")).alias("path"), "text")
        if todo.isEmpty():
            return done
