"""Suffix-array dedup: bytes that a long enough string of an earlier document also holds go.

Every 50-byte string is filed under the smallest hash of the 16-byte strings in it, so equal
strings meet wherever they stand. Neighbouring strings with the same smallest hash travel
as one run. Texts are dealt into batches; only hashes that two documents share bring
runs together, and there the suffixes of the runs are sorted (multikey passes to a shallow
depth, blind tries below) to find equal strings and the smallest document of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import utf8

#: Length of a string that counts, bytes that are hashed, and hashes in a string.
GRAM, KEY = 50, 16
SPAN = GRAM - KEY + 1
#: Bits kept of a hash: an unlucky equality only brings more runs together.
KEY_BITS = 48
#: Most starts in a run (its duplicates are told by the bits of a long).
STARTS = 48
#: Depth of the multikey passes, in bytes.
SHALLOW = 16
#: Documents (about) from which a shared hash is common: its strings are dealt one by one, by their own
#: hash. That costs more bytes a string, but no task sorts more than the runs of so many documents.
COMMON = 50_000
#: Suffixes sorted at once, about.
SORTED = 200_000
#: Bytes of text hashed at once, and the least and most bytes in a batch.
PIECE, LEAST_BATCH, MOST_BATCH = 1 << 19, 1 << 20, 1 << 25


def smallest_hashes(data: np.ndarray) -> np.ndarray:
    """For each start of a GRAM-byte string in data, the smallest hash of its KEY-byte strings."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = (word[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ (word[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    wide = 1
    while 2 * wide <= SPAN:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    return np.minimum(h[:n], h[SPAN - wide : SPAN - wide + n])


def _spread(h: np.ndarray) -> np.ndarray:
    """Smallest hashes as keys of KEY_BITS bits. They crowd near 0; an odd factor deals them evenly, so that no part of the keys is heavy."""
    return ((h >> np.uint64(64 - KEY_BITS)) * np.uint64(0x9E3779B97F4B)) & np.uint64((1 << KEY_BITS) - 1)


class Batch:
    """The rows of one batch, ordered by document, as bytes end to end."""

    def __init__(self, rows: pa.Table, doc_id: str, text: str):
        rows = rows.take(pc.sort_indices(rows, [(doc_id, "ascending"), (text, "ascending")])) if rows.num_rows else rows
        self.rows = rows.combine_chunks()
        one = lambda name: self.rows.column(name).combine_chunks() if self.rows.num_rows else pa.array([], self.rows.schema.field(name).type)
        ids, column = one(doc_id), one(text)
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        self.data, self.offsets = utf8(column)
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)

    def runs(self):
        """Pieces of (hash, first start, number of starts, row) of the runs, in order."""
        good_end = np.where(self.known, self.offsets[1:] - GRAM, -1)  # last start of each row
        for at in range(0, len(self.data), PIECE):
            h = smallest_hashes(self.data[at : at + PIECE + GRAM - 1])
            if not len(h):
                continue
            start = np.arange(at, at + len(h))
            row = np.searchsorted(self.offsets, start, "right") - 1
            good = start <= good_end[row]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (good[1:] != good[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(h)))
            keep = good[first]
            first, size = first[keep], size[keep]
            if len(size) and size.max() > STARTS:  # the same hash again and again
                parts = -(-size // STARTS)
                base = np.repeat(first, parts)
                turn = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
                size = np.minimum(STARTS, np.repeat(size, parts) - turn * STARTS)
                first = base + turn * STARTS
            yield _spread(h[first]), first + at, size, row[first]


def _out(a: np.ndarray | bytes) -> bytes:
    """Bytes of an array as they are shuffled: compressed, since Spark's codec gains little on them."""
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _in(b: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if kind is None else np.frombuffer(raw, kind)


def _packed(**columns) -> pa.Table:
    return pa.table(columns)


def _six(keys: np.ndarray) -> bytes:
    """Keys as six planes of bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unsix(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, n).T
    return out.view("<u8").ravel()


def _by_part(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted keys; the part is the top bits."""
    part = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(part)))]


KEYS_OF = "part int, batch int, keys binary, many binary"
SHARED_OF = "batch int, keys binary, common binary"
RUNS_OF = "part int, batch int, kind int, keys binary, docs binary, sizes binary, text binary, counts binary, places binary, masks binary"
COVERS_OF = "batch int, places binary, masks binary"


def _batch_keys(doc_id: str, text: str, bits: int):
    def work(rows: pa.Table) -> pa.Table:
        got = Batch(rows, doc_id, text)
        batch = rows.column("__batch")[0].as_py()
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for h, _, _, row in got.runs():
            keys.append(h)
            ids.append(got.ids[row])
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
        fresh = np.ones(len(ids), np.int64)
        fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        many = np.log2(np.add.reduceat(fresh, first)).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
        keys = keys[first]
        parts = _by_part(keys, bits)
        return _packed(
            part=pa.array([p for p, *_ in parts], pa.int32()), batch=pa.array([batch] * len(parts), pa.int32()),
            keys=pa.array([_out(_six(keys[a:b])) for _, a, b in parts], pa.binary()), many=pa.array([_out(many[a:b]) for _, a, b in parts], pa.binary()),
        )

    return work


def _shared(rows: pa.Table) -> pa.Table:
    """Of each batch of a part, the keys that two documents have."""
    lists = [_unsix(_in(x)) for x in rows.column("keys").to_pylist()]
    many = np.concatenate([_in(x, np.uint8) for x in rows.column("many").to_pylist()]).astype(np.int64)
    keys, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = sorted_[1:] == sorted_[:-1]
    both = same.copy()
    both[:-1] |= same[1:]
    begin = np.flatnonzero(~same)
    wanted, common = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    wanted[order] = both
    common[order] = np.repeat(np.add.reduceat(1 << many[order], begin) >= COMMON, np.diff(np.append(begin, len(keys))))
    # a batch has a key once, so an equal neighbour is another batch
    wanted |= many > 0
    cuts = np.cumsum(np.bincount(of[wanted], minlength=len(lists)))[:-1]
    out, often = np.split(keys[wanted], cuts), np.split(common[wanted], cuts)
    some = [k for k in range(len(lists)) if len(out[k])]
    batches = rows.column("batch").to_pylist()
    return _packed(batch=pa.array([batches[k] for k in some], pa.int32()), keys=pa.array([_out(_six(out[k])) for k in some], pa.binary()), common=pa.array([np.packbits(often[k]).tobytes() for k in some], pa.binary()))


def _full(size: np.ndarray) -> np.ndarray:
    """Masks with the lowest `size` bits set."""
    return ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)).view(np.int64) if len(size) else np.zeros(0, np.int64)


def _batch_runs(doc_id: str, text: str, bits: int):
    """Distinct runs under shared keys, one for each text and batch; what lies in the batch itself is settled at once."""

    def work(rows: pa.Table, replies: pa.Table) -> pa.Table:
        empty = _packed(**{name: pa.array([], kind) for name, kind in zip([x.split()[0] for x in RUNS_OF.split(", ")], [pa.int32()] * 3 + [pa.binary()] * 7)})
        if not rows.num_rows or not replies.num_rows:
            return empty
        got = Batch(rows, doc_id, text)
        batch = rows.column("__batch")[0].as_py()
        lists = [_unsix(_in(x)) for x in replies.column("keys").to_pylist()]
        often = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(replies.column("common").to_pylist(), lists)]).astype(bool)
        shared = np.concatenate(lists)
        order = np.argsort(shared)
        shared, often = shared[order], often[order]
        blob = got.data.tobytes()
        seen: dict[bytes, list] = {}
        whole: dict[bytes, int] = {}
        own_at, own_size = [], []

        def put(key: int | None, c: bytes, p: int, n: int, d: int) -> None:
            e = seen.get(c)
            if e is None:
                seen[c] = [xxhash.xxh3_64_intdigest(c) >> (64 - KEY_BITS) if key is None else key, d, [p]]
            elif e[1] == d:
                e[2].append(p)
            else:  # rows are in the order of their documents
                own_at.append(p)
                own_size.append(n)

        for h, first, size, row in got.runs():
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            hit = shared[at] == h
            for key, p, n, d, many in zip(h[hit].tolist(), first[hit].tolist(), size[hit].tolist(), got.ids[row[hit]].tolist(), often[at[hit]].tolist()):
                c = blob[p : p + n + GRAM - 1]
                if not many:
                    put(key, c, p, n, d)
                elif whole.setdefault(c, d) != d:
                    own_at.append(p)
                    own_size.append(n)
                else:
                    for j in range(n):
                        put(None, c[j : j + GRAM], p + j, 1, d)
        texts = list(seen)
        keys = np.array([seen[c][0] for c in texts], np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        entries = [(texts[k], *seen[texts[k]][1:]) for k in order.tolist()]
        out: list[tuple] = []
        for part, a, b in _by_part(keys, bits):
            some = entries[a:b]
            out.append((
                part, batch, 0, _out(_six(keys[a:b])), _out(np.array([e[1] for e in some], np.int64)), _out(np.array([len(e[0]) for e in some], np.uint8)),
                _out(b"".join(e[0] for e in some)), _out(np.array([len(e[2]) for e in some], np.int32)), _out(np.array([p for e in some for p in e[2]], np.int64)), b"",
            ))
        if own_at:
            none = b""
            out.append((batch % (1 << bits), batch, 1, none, none, none, none, none, _out(np.array(own_at, np.int64)), _out(_full(np.array(own_size)))))
        if not out:
            return empty
        return _packed(**{name: pa.array(column, kind) for name, column, kind in zip(empty.schema.names, zip(*out), empty.schema.types)})

    return work


def blind_trie(keys: list[int]) -> list[list[int]]:
    """Indices of equal keys together, the groups in the order of the keys.

    A node tests one bit; a new key goes down blindly, is compared once with the leaf it
    meets, and is put in where the first differing bit belongs.
    """
    root: list = [-1, keys[0], [0]]
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while node[0] >= 0:
            node = node[2] if key >> node[0] & 1 else node[1]
        differ = key ^ node[1]
        if not differ:
            node[2].append(i)
            continue
        bit = differ.bit_length() - 1
        node = root
        while node[0] > bit:
            node = node[2] if key >> node[0] & 1 else node[1]
        old, new = list(node), [-1, key, [i]]
        node[:] = [bit, old, new] if key >> bit & 1 else [bit, new, old]
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[0] < 0:
            out.append(node[2])
        else:
            todo += [node[2], node[1]]
    return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, depth: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at `starts` to `depth` bytes, number of each one's class of equal prefixes).

    Multikey passes take 8 bytes at a time of all groups at once, down to SHALLOW bytes.
    Groups that are still equal there are sorted by blind tries; a group whose members
    agree to the full depth needs none.
    """
    n = len(starts)
    word = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), 0, (1,))
    order, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(0, SHALLOW, 8):
        w = word[starts[order] + d].astype(np.uint64)
        step = np.lexsort((w, group))
        order, w, group = order[step], w[step], group[step]
        new = np.ones(n, bool)
        new[1:] = (group[1:] != group[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(new) - 1
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, n))
    head = np.repeat(first, size)
    rest = np.ones(n, bool)
    for d in [*range(SHALLOW, depth - 7, 8), depth - 8]:
        at = starts[order] + d
        rest &= word[at] == word[starts[order[head]] + d]
    mixed = np.flatnonzero(~np.logical_and.reduceat(rest, first)) if n else first
    raw, fine = data.tobytes(), np.zeros(n, np.int64)
    for g in mixed.tolist():
        a, b = int(first[g]), int(first[g] + size[g])
        own = order[a:b].copy()
        keys = [int.from_bytes(raw[s + SHALLOW : s + depth], "big") for s in starts[own].tolist()]
        at = a
        for k, same in enumerate(blind_trie(keys)):
            order[at : at + len(same)] = own[same]
            fine[at : at + len(same)] = k
            at += len(same)
    new = np.ones(n, bool)
    new[1:] = (group[1:] != group[:-1]) | (fine[1:] != fine[:-1])
    return order, np.cumsum(new) - 1


def _covers(rows: pa.Table) -> pa.Table:
    """Of the runs of a part, the starts whose string also starts in a smaller document."""
    out: list[tuple] = []
    lists = []
    for r in rows.to_pylist():
        if r["kind"] == 1:
            out.append((r["batch"], r["places"], r["masks"]))
        else:
            lists.append(r)
    if lists:
        read = lambda name, kind: np.concatenate([_in(r[name], kind) for r in lists])
        keys, docs, sizes, counts, places = np.concatenate([_unsix(_in(r["keys"])) for r in lists]), read("docs", np.int64), read("sizes", np.uint8).astype(np.int64), read("counts", np.int32), read("places", np.int64)
        blob = b"".join(_in(r["text"]) for r in lists)
        ends = np.cumsum(sizes)
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(blob[e - s : e], len(number)) for s, e in zip(sizes.tolist(), ends.tolist())), np.int64, len(sizes))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, of, docs)
        mask = np.zeros(len(docs), np.int64)
        later = docs > least[of]
        mask[later] = _full(sizes[later] - GRAM + 1)
        # keys under which several texts stand: their suffixes are sorted
        seen, first_of = np.unique(of, return_index=True)
        key_of = keys[first_of]
        by = np.argsort(key_of, kind="stable")
        k = key_of[by]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:].copy()
        several = seen[by][same]
        bits = np.zeros(len(number), np.uint64)
        grams_of = np.cumsum(sizes[first_of[several]] - GRAM + 1)
        turns = np.flatnonzero(np.diff(key_of[several], prepend=key_of[several[:1]] + np.uint64(1))) if len(several) else np.zeros(0, np.int64)
        at = 0
        while at < len(several):  # whole keys at a time, about SORTED suffixes
            after = turns[np.searchsorted(grams_of[np.minimum(turns, len(several) - 1)], (grams_of[at - 1] if at else 0) + SORTED) :]
            after = after[after > at]
            end = int(after[0]) if len(after) else len(several)
            own = several[at:end]
            at = end
            entry = first_of[own]
            n = sizes[entry]
            text = np.frombuffer(b"".join(blob[e - s : e] for s, e in zip(n.tolist(), ends[entry].tolist())) + b"\0" * 8, np.uint8)
            base = np.cumsum(n) - n
            grams = n - GRAM + 1
            owner = np.repeat(np.arange(len(entry)), grams)
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
            order, group = deep_shallow(text, base[owner] + turn)
            doc = least[own][owner[order]]
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            smallest = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(group))))
            hit = order[smallest < doc]
            np.bitwise_or.at(bits, own[owner[hit]], np.uint64(1) << turn[hit].astype(np.uint64))
        mask[~later] = bits.view(np.int64)[of[~later]]
        batches = np.repeat([r["batch"] for r in lists], [len(_in(r["sizes"])) for r in lists])
        at, masks, batch = places, np.repeat(mask, counts), np.repeat(batches, counts)
        at, masks, batch = at[masks != 0], masks[masks != 0], batch[masks != 0]
        order = np.argsort(batch, kind="stable")
        at, masks, batch = at[order], masks[order], batch[order]
        cuts = np.flatnonzero(np.diff(batch, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)]):
            out.append((int(batch[a]), _out(at[a:b]), _out(masks[a:b])))
    columns = list(zip(*out)) or [(), (), ()]
    return _packed(batch=pa.array(columns[0], pa.int32()), places=pa.array(columns[1], pa.binary()), masks=pa.array(columns[2], pa.binary()))


def _finish(doc_id: str, text: str, columns: list[str], digest: bool):
    def work(rows: pa.Table, covers: pa.Table) -> pa.Table:
        got = Batch(rows, doc_id, text)
        edge = np.zeros(len(got.data) + 1, np.int32)
        for places, masks in zip(covers.column("places").to_pylist(), covers.column("masks").to_pylist()):
            at, mask = _in(places, np.int64), _in(masks, np.int64)
            for a in range(0, len(at), 1 << 14):
                which, bit = np.nonzero((mask[a : a + (1 << 14), None] >> np.arange(STARTS)) & 1)
                start = at[a : a + (1 << 14)][which] + bit
                np.add.at(edge, start, 1)
                np.subtract.at(edge, start + GRAM, 1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, spans, kept = [], [], []
        for a, b in zip(got.offsets[:-1].tolist(), got.offsets[1:].tolist()):
            g = gone[a:b]
            n = int(np.count_nonzero(g))
            removed.append(n)
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if n else 0)
            left = (got.data[a:b][~g] if n else got.data[a:b]).tobytes()
            kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "ignore"))
        extra = {"n_bytes": pa.array(np.diff(got.offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256" if digest else "kept_text": pa.array(kept, pa.string())}
        extra = extra if digest else {f"__{k}": v for k, v in extra.items()}
        return pa.table([*(got.rows.column(c) for c in columns), *extra.values()], names=[*columns, *extra])

    return work


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = True) -> DataFrame:
    """docs without bytes covered by a GRAM-byte string that starts in a smaller document too.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256, or without digest all columns
    of docs and the same as __n_bytes and so on, with __kept_text for the digest (cut
    characters are left out there), so that names don't clash. Exact: strings are
    judged on the input, overlaps count, matches stay inside documents.

    Texts are dealt into batches of bounded size by a hash, once; the same shuffle serves
    all passes. What a batch sends is combined first: each hash once, each run of text
    once, so copies by the thousand cost one row a batch. The strings under a hash that
    about COMMON documents share are dealt one by one by their own hash, so the many surroundings of
    one common passage spread over all tasks.

    Null texts are empty; rows with a null id lose nothing and cost nobody anything; rows
    that share an id count as one document. Empty tables give empty results.
    """
    columns = [doc_id] if digest else list(docs.columns)
    own = docs.select(doc_id, text) if digest else docs
    total = own.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spark = docs.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = min(MOST_BATCH, max(LEAST_BATCH, total // (4 * ways)))
    batches = max(1, -(-total // size))
    bits = max(0, (4 * batches - 1).bit_length()) if batches > 1 else 0
    dealt = own.withColumn("__batch", F.pmod(F.xxhash64(doc_id, text), F.lit(batches)).cast("int"))
    shared = dealt.groupBy("__batch").applyInArrow(_batch_keys(doc_id, text, bits), KEYS_OF).groupBy("part").applyInArrow(_shared, SHARED_OF)
    runs = dealt.groupBy("__batch").cogroup(shared.groupBy("batch")).applyInArrow(_batch_runs(doc_id, text, bits), RUNS_OF)
    covers = runs.groupBy("part").applyInArrow(_covers, COVERS_OF)
    fields = [own.schema[c] for c in columns]
    more = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256" if digest else "kept_text", T.StringType())]
    more = more if digest else [(f"__{n}", t) for n, t in more]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in more)])
    return dealt.groupBy("__batch").cogroup(covers.groupBy("batch")).applyInArrow(_finish(doc_id, text, columns, digest), schema)


def drop_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that is left; documents stay even where nothing is left, n_chars follows the text."""
    cut = repeated_spans(docs, doc_id, text, digest=False)
    new = {text: F.when(F.col(text).isNotNull(), F.col("__kept_text")).alias(text), "n_chars": F.length("__kept_text").cast("long").alias("n_chars")}
    return cut.select(*[new.get(c, F.col(c)) for c in docs.columns])
