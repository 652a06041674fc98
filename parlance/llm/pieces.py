"""SentencePiece encoding and decoding: shared-prefix Viterbi over a trie of distinct words.

The vocabulary at hand is a merge (BPE) model: it has no unigram lattice whose scores add up,
but its result is found by the same forward pass. The best path of each prefix has one last
piece (its forward state), and a longer prefix extends a shorter one's path exactly if the
two pieces that meet would not be merged otherwise. The state of a prefix depends on that
prefix alone, so the distinct marked words are sorted, which makes them a trie in depth-first
order, and the states of a common prefix are computed once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from parlance.llm.common import portions, utf8

BLANK = "▁"
#: Where the tokenizer model lies, by default; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of words, and pairs of pieces, that a worker remembers.
REMEMBERED, PAIRS = 8_000_000, 300_000
#: Bytes of text encoded at once (a longer text stands alone), and ids whose text is built at once.
PORTION, IDS = 1 << 21, 1 << 20


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `length` places, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pieces:
    """A SentencePiece model as tables: piece -> id, score, and the byte pieces."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        proc = sentencepiece.SentencePieceProcessor(model_file=model)
        n = proc.get_piece_size()
        self.text = [proc.id_to_piece(i) for i in range(n)]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if proc.is_byte(i)}
        plain = [i for i in range(n) if not (proc.is_byte(i) or proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: proc.get_score(i) for i in plain}
        self.tails = {t[k:] for t in self.id for k in range(len(t))}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        # the model's own normalization: blanks are marked, and one is put in front
        self.front = proc.normalize("a").startswith(BLANK)
        # whether blanks are merged with blanks only after all else is
        runs = {t for t in self.id if len(t) > 1 and not t.strip(BLANK)}
        others = [s for t, s in self.score.items() if t not in runs and len(t) > 1]
        self.blanks_last = not any(BLANK in t[1:] for t in self.id if t not in runs) and all(self.score[t] < min(others) for t in runs)
        surface = [bytes([self.of_byte[i]]) if i in self.of_byte else t.replace(BLANK, " ").encode() for i, t in enumerate(self.text)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.length = np.array([len(s) for s in surface])
        self.start = np.cumsum(self.length) - self.length
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.of_byte)] = True

    def merged(self, word: str) -> list[str]:
        """What the merges leave of a word, by the rule itself: best score first, leftmost of equals."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        score, heap = self.score.get, []

        def offer(k: int) -> None:
            j = after[k]
            if j < len(word) and (v := score(parts[k] + parts[j])) is not None:
                heapq.heappush(heap, (-v, k, parts[k], parts[j]))

        for k in range(len(word)):
            offer(k)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if parts[k] != left or j >= len(word) or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, None
            after[k] = after[j]
            if after[k] < len(word):
                before[after[k]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [p for p in parts if p is not None]

    def meet(self, left: str, right: str) -> bool:
        """Whether the merges leave the two pieces as they are, side by side."""
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            got = self.fits[left, right] = self.merged(left + right) == [left, right]
        return got

    def ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return np.array(out, np.int32).tobytes()

    def walk(self, words: list[str]):
        """(word, pieces) of words in sorted order: depth first in their trie, a state for each prefix on the path."""
        states: list[str | None] = [None]  # of each prefix of `path`, the last piece of its best path
        path = ""
        pieces, tails, fits = self.id, self.tails, self.fits
        for word in words:
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                piece, found = word[end - 1], None
                start = end - 1
                while True:
                    if start == end - 1 or piece in pieces:
                        left = states[start]
                        ok = left is None or fits.get((left, piece))
                        if ok is None:
                            ok = self.meet(left, piece)
                        if ok:
                            found = piece
                            break
                    start -= 1
                    if start < 0:
                        break
                    piece = word[start] + piece
                    if piece not in tails:
                        break
                if found is None:  # no admissible last piece: the merges decide this word
                    break
                states.append(found)
            path = word[: len(states) - 1]
            if len(path) < len(word):
                yield word, self.merged(word)
                continue
            parts, end = [], len(word)
            while end:
                parts.append(states[end])
                end -= len(states[end])
            yield word, parts[::-1]

    def learn(self, words: list[bytes]) -> None:
        """Remembers the ids of words that are not known yet."""
        new = [w for w in words if w not in self.known]
        if self.held > REMEMBERED:
            self.known.clear()
            self.held, new = 0, words
        cores: dict[str, list[tuple[bytes, int]]] = {}
        for w in new:
            marked = w.decode().replace(" ", BLANK)
            more = max(0, len(marked) - len(marked.lstrip(BLANK)) - 1) if self.blanks_last else 0
            cores.setdefault(marked[more:], []).append((w, more))
        for core, parts in self.walk(sorted(cores)):
            own = self.ids(parts)
            for w, more in cores[core]:
                self.held += len(w)
                if more == 0:
                    self.known[w] = own
                elif parts[0] == BLANK:  # a blank that is left over joins the run before it
                    self.known[w] = self.ids(self.merged(BLANK * (more + 1))) + own[4:]
                else:
                    self.known[w] = self.ids(self.merged(BLANK * more)) + own

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets of the rows in them) of texts as UTF-8 bytes.

        A word is a run of blanks and what follows up to the next one. Words are numbered by
        their bytes, and only the distinct ones are looked up.
        """
        if BLANK.encode() in data.tobytes():  # the mark itself counts as a blank
            rows = [data[a:b].tobytes().replace(BLANK.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:])]
            data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        some = np.diff(offsets) > 0
        if self.front:
            data = np.insert(data, offsets[:-1][some], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(some)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin = data == 32
        begin[1:] &= ~begin[:-1]
        begin[offsets[:-1][some]] = True
        starts = np.flatnonzero(begin)
        edges = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        each = [self.known[w] for w in words]
        table = np.frombuffer(b"".join(each), np.int32)
        n = np.array([len(x) for x in each]) // 4
        code = coded.indices.to_numpy()
        ids = table[spread((np.cumsum(n) - n)[code], n[code])]
        ends = np.concatenate([[0], np.cumsum(n[code])])
        return ids, ends[np.searchsorted(starts, offsets)]

    def text_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces, end to end, the mark as a blank."""
        return self.surface[spread(self.start[ids], self.length[ids])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; runs of byte pieces become UTF-8, what is not valid becomes U+FFFD."""
        text = self.text_bytes(ids).tobytes().decode("utf-8", "replace")
        return text[1:] if self.front and text.startswith(" ") else text

    def text_digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the bytes that ids stand for."""
        sha = hashlib.sha256()
        for a in range(0, len(ids), IDS):
            part = self.text_bytes(ids[a : a + IDS])
            sha.update(part[1:] if a == 0 and self.front and part[:1] == 32 else part)
        return sha.hexdigest()


@functools.lru_cache(maxsize=1)
def _pieces(model: str) -> Pieces:
    """One set of tables for each Python worker; its memory of words is bounded and outlives a task."""
    return Pieces(model)


def _digests(pieces: Pieces, key: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    pairs = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
    ids = np.ascontiguousarray(ids, "<i4")
    total = np.concatenate([[0], np.cumsum(pieces.is_byte[ids])])
    return pa.RecordBatch.from_arrays(
        [
            key, pa.array(np.diff(ends), pa.int64()), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()),
            pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in pairs], pa.string()), pa.array([pieces.text_digest(ids[a:b]) for a, b in pairs], pa.string()),
        ],
        ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "text_sha256"],
    )


def _encoded(batches, model: str):
    """(keys, ids, ends) of portions of (key, text) batches."""
    pieces = _pieces(model)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in portions(offsets, PORTION):
            yield pieces, batch.column(0).slice(i, j - i), *pieces.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids): each whole text as piece ids. Null and empty texts have none.

    Row by row, without a shuffle; each task keeps a bounded memory of words. Repeated
    rows give repeated rows; other columns are not read; empty tables give empty results.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        for _, key, ids, ends in _encoded(batches, model):
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decode_pieces(encoded: DataFrame, doc_id: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, text): the text of piece ids (null: empty). Bytes that are no UTF-8 become U+FFFD.

    Repeated rows give repeated rows; other columns are not read.
    """
    kind = encoded.schema[doc_id].dataType.simpleString()

    def work(batches):
        pieces = _pieces(model)
        for batch in batches:
            texts = [pieces.decode(np.asarray(x.values if x.is_valid else [], np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(doc_id, "ids").mapInArrow(work, f"doc_id {kind}, text string")


def piece_digests(encoded: DataFrame, doc_id: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_sha256, text_sha256): counts, and digests of ids and of the decoded text (null ids: none)."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def work(batches):
        for batch in batches:
            ids = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type)) if batch.column(1).null_count else batch.column(1)
            ends = np.asarray(ids.offsets).astype(np.int64)
            yield _digests(_pieces(model), batch.column(0), np.asarray(ids.values)[ends[0] : ends[-1]], ends - ends[0])

    return encoded.select(doc_id, "ids").mapInArrow(work, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, text_sha256 string")


def encode_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """piece_digests(encode_pieces(docs)) in one pass: each text is encoded, decoded again, and only digests leave the task."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches):
        for pieces, key, ids, ends in _encoded(batches, model):
            yield _digests(pieces, key, ids, ends)

    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, text_sha256 string")
