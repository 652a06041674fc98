"""Spelling variants: words that differ by one letter, found by pairs of trie nodes.

A word is a path in a forward trie and, read from its end, in a reversed one. Cutting it in
two gives a pair (node of the first part, node of the rest). Skipping a letter gives the pair
around it. Two words that differ in one letter share the pair around that letter; a word with
a letter more has a pair around that letter which is a cut of the other. So equal pairs find
every neighbour. A group of equal skipping pairs holds words that differ in one place only,
at most one for each letter of the alphabet, and a cut belongs to one word: no group is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut

#: Words have at least this many code points and occur at least so often; a form is so much more frequent.
MIN_CHARS, MIN_COUNT, TIMES = 6, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points whose pairs are held at once in a task.
POINTS = 1 << 18


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def runs(docs: DataFrame, keys: list[str], text: str, at_least: int) -> DataFrame:
    """(keys, run): the lower-cased letter runs of whole texts with at least so many code points, one row each."""
    return docs.select(*keys, F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"[a-z\\u00C0-\\u00FF]{{{at_least},}}"), F.lit(0))).alias("run"))


def with_slips(run: Column, doc_id: Column, every: int) -> Column:
    """The run, less one code point where `every` divides the CRC-32 of doc_id:run (a null id counts as empty)."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def _mix(node: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The number of a node's child by a letter."""
    x = node * np.uint64(0x9E3779B97F4A7C15) + letter.astype(np.uint64) + np.uint64(1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def trie_nodes(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the trie nodes on each word's path, roots included: n + 1 for a word of n letters.

    A node's number is made of its parent's and its letter, so that every task gives a node
    the same number and no dictionary travels. Words go down together, a letter at a time.
    """
    size = np.diff(starts)
    out = np.zeros(len(letters) + len(size), np.uint64)
    begin = starts[:-1] + np.arange(len(size))
    order = np.argsort(-size, kind="stable")
    sizes, node = -np.sort(-size), np.ones(len(size), np.uint64)
    out[begin] = 1
    for k in range(int(sizes[0]) if len(sizes) else 0):
        live = order[: np.searchsorted(-sizes, -k, "left")]  # words longer than k
        node[live] = _mix(node[live], letters[starts[live] + k])
        out[begin[live] + k + 1] = node[live]
    return out


def _reversed(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Letters of each word from its end."""
    word = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return letters[starts[word] + starts[word + 1] - 1 - np.arange(len(letters))] if len(letters) else letters


def node_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) to (id, skips, head, tail): the pair of every cut (skips 0) and of every skipped letter (skips 1)."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes = np.array([len(w) for w in words.to_pylist()], np.int64)
        i = 0
        while i < len(words):
            j = max(i + 1, i + int(np.searchsorted(np.cumsum(sizes[i:]), POINTS, "right")))
            letters = np.frombuffer("".join(words.slice(i, j - i).to_pylist()).encode("utf-32-le"), np.uint32)
            size = sizes[i:j]
            starts = np.concatenate([[0], np.cumsum(size)])
            head = trie_nodes(letters, starts)
            tail = trie_nodes(_reversed(letters, starts), starts)
            begin = starts[:-1] + np.arange(len(size))
            word = np.repeat(np.arange(len(size)), size + 1)
            k = np.arange(len(head)) - begin[word]
            back = begin[word] + size[word] - k  # the node of the rest after k letters
            skip = k < size[word]
            for skips, rows, rest in ((0, slice(None), back), (1, skip, back[skip] - 1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][word[rows]]), pa.array(np.full(len(rest), skips, np.int8)), pa.array(head[rows].view(np.int64)), pa.array(tail[rest].view(np.int64))], ["id", "skips", "head", "tail"]
                )
            i = j


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): the ids of words that differ by one inserted, deleted or replaced code point, each pair both ways.

    words: id, word, n; distinct words. Equal numbers of different nodes can only add pairs,
    and each pair is compared letter by letter in the end, so the result is exact.
    """
    pairs = cut(words.select("id", "word").mapInArrow(node_pairs, "id long, skips tinyint, head long, tail long"))
    skipped = pairs.where("skips = 1").select(F.col("id").alias("a"), "head", "tail")
    cuts = pairs.where("skips = 0").select(F.col("id").alias("b"), "head", "tail")
    same = skipped.join(skipped.withColumnRenamed("a", "b"), ["head", "tail"]).where("a < b").select("a", "b")
    shorter = skipped.join(cuts, ["head", "tail"]).where("a <> b").select("a", "b")
    met = same.unionByName(shorter).distinct()
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"__{x}"))
    sure = cut(met.join(side("a"), "a").join(side("b"), "b").where(F.levenshtein("__a", "__b", 1) == 1).select("a", "b"))
    return sure.unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip_every: int | None = None) -> DataFrame:
    """(id, word, n): frequent words of whole texts; slips are planted where slip_every is given."""
    found = runs(docs, [doc_id], text, MIN_CHARS)
    word = F.col("run") if slip_every is None else with_slips(F.col("run"), F.col(doc_id), slip_every)
    counted = found.select(word.alias("word")).where(F.char_length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)
    return cut(counted.withColumn("id", F.monotonically_increasing_id()))


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (id, word, n).

    form is the near word of largest n, the smallest of equals, if it is at least `times` as
    frequent; root follows forms to the last. n rises along a chain, so chains end, after at
    most log(largest n) / log(times) steps; each round doubles the steps taken.
    """
    near = near_words(words)
    other = words.select(F.col("id").alias("b"), F.col("word").alias("__w"), F.col("n").alias("__n"))
    best = F.min_by(F.struct("__w", "__n", "b"), F.struct(-F.col("__n"), F.col("__w")))
    of = near.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best.alias("__best"))
    follows = F.col("__best.__n") >= times * F.col("n")
    full = words.join(of, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("__best.__w")).alias("form"),
        F.when(follows, F.col("__best.__n")).alias("form_n"), F.when(follows, F.col("__best.b")).alias("__to"),
    )
    full = cut(full)
    # links: id to the word a number of steps on, of words with a form only
    links = cut(full.where("__to is not null").select("id", "__to", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("id").alias("__to"), F.col("__to").alias("__next"), F.col("root").alias("__root"))
        moved = cut(links.join(on, "__to", "left").select("id", F.coalesce("__next", "__to").alias("__to"), F.coalesce("__root", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        links = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            break
    return full.drop("__to").join(links.select("id", "root"), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip_every: int | None = None) -> DataFrame:
    """The spelling variants of the frequent words of docs.

    Null, empty and wordless texts add nothing, repeated rows count again, other columns
    play no part, an empty table gives no rows. Runs of any length are whole words: their
    pairs are made in numbers, in time linear in their letters.
    """
    return spelling_variants(count_words(docs, doc_id, text, slip_every))
