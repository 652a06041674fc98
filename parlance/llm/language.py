"""Language ID: a byte convolutional network trained in numpy, applied to fixed-length windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import portions, utf8

#: Bytes in a window, filter widths, filters of each width, dimensions of a byte.
WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
#: The bound of the fitted sample: at most so many labelled documents, and of each at most so many windows, spread evenly over the whole text.
FIT_ROWS, FIT_WINDOWS = 2_000, 256
PASSES, BATCH, RATE = 3, 64, 0.004
#: Windows handled at once inside a task.
AT_ONCE = 1024


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Network:
    """Byte embedding, filters of several widths, ReLU, max pooling, softmax; trained by Adam."""

    def __init__(self, n_classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (256, DIM))}
        self.p["e"][0] = 0
        for k in WIDTHS:
            self.p[f"w{k}"] = rng.normal(0, (2 / (k * DIM)) ** 0.5, (k * DIM, FILTERS))
            self.p[f"b{k}"] = np.zeros(FILTERS)
        self.p["v"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_classes))
        self.p["c"] = np.zeros(n_classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.t = 0

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        p, n = self.p, len(x)
        byte = p["e"][x]
        pooled, at, rows = [], {}, np.arange(n)[:, None]
        for k in WIDTHS:
            patch = np.lib.stride_tricks.sliding_window_view(byte, k, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - k + 1, k * DIM)
            z = patch @ p[f"w{k}"] + p[f"b{k}"]
            best = z.argmax(1)
            at[k] = (best, patch[rows, best])
            pooled.append(np.maximum(z[rows, best, np.arange(FILTERS)], 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["v"] + p["c"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"v": h.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        dh = (q @ p["v"].T) * (h > 0)
        for i, k in enumerate(WIDTHS):
            best, patch = at[k]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"w{k}"] = np.einsum("nfp,nf->pf", patch, d)
            g[f"b{k}"] = d.sum(0)
            back = (d[:, :, None] * p[f"w{k}"].T[None]).reshape(n, FILTERS, k, DIM)
            np.add.at(g["e"], x[rows[:, :, None], best[:, :, None] + np.arange(k)], back)
        g["e"][0] = 0
        self.t += 1
        for k, v in g.items():
            a, b = self.m[k]
            a += 0.1 * (v - a)
            b += 0.001 * (v * v - b)
            self.p[k] -= (RATE * a / (1 - 0.9**self.t) / (np.sqrt(b / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What each byte or byte pair adds to the filters of a width: convolution by table look-up."""
        out = {}
        for k in WIDTHS:
            one = [(self.p["e"] @ self.p[f"w{k}"][j * DIM : (j + 1) * DIM]) for j in range(k)]
            pairs = [(one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS) for j in range(0, k - 1, 2)]
            out[k] = [np.ascontiguousarray(t, np.float32) for t in pairs + ([one[-1]] if k % 2 else [])]
        return out


def probabilities(windows: np.ndarray, tables: dict, p: dict) -> np.ndarray:
    """Class probabilities of windows (n, WINDOW) of bytes."""
    pair = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
    pooled = []
    for k in WIDTHS:
        n = WINDOW - k + 1
        z = None
        for j, t in enumerate(tables[k]):
            part = t.take(pair[:, 2 * j : 2 * j + n] if len(t) > 256 else windows[:, k - 1 : k - 1 + n], axis=0)
            z = part if z is None else np.add(z, part, out=z)
        pooled.append(np.maximum(z.max(1) + p[f"b{k}"], 0))
    logits = np.concatenate(pooled, 1) @ p["v"] + p["c"]
    q = np.exp(logits - logits.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts, the last of each filled with zeros, and how many each text has."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(starts[-1]) * WINDOW, np.uint8)
    out[np.repeat(starts[:-1] * WINDOW - offsets[:-1], size) + np.arange(len(data))] = data
    return out.reshape(-1, WINDOW), count


def _spread(data: np.ndarray) -> bytes:
    """A text's bytes, or those of FIT_WINDOWS of its windows if it has more; the last window, which may be short, is among them."""
    count = -(-len(data) // WINDOW)
    if count <= FIT_WINDOWS:
        return data.tobytes()
    return b"".join(data[k * WINDOW : (k + 1) * WINDOW].tobytes() for k in np.linspace(0, count - 1, FIT_WINDOWS).astype(int))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> dict | None:
    """A network learnt from a bounded sample of labelled documents that aren't held out.

    At most `rows` documents (smallest id hashes) teach, whatever their length. All windows
    of a text reach the driver, or FIT_WINDOWS of them, evenly spread, if it has more. Null
    and empty texts teach nothing; an id that repeats counts once, with its first text and
    label in order. None where there is nothing to learn from.
    """
    own = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)) & (F.octet_length(text) > 0))
    own = own.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    drawn = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = own.join(F.broadcast(drawn), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.*")
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def spread(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            some = [_spread(data[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(some, pa.binary()), batch.column(2)], ["doc_id", "some", "lang"])

    found = chosen.select("doc_id", "text", F.col("lang").cast("string")).mapInArrow(spread, f"doc_id {kind}, some binary, lang string")
    got = sorted((r["doc_id"], r["lang"], bytes(r["some"])) for r in found.collect())
    if not got:
        return None
    names = sorted({lang for _, lang, _ in got})
    x, many = _windows(np.frombuffer(b"".join(t for *_, t in got), np.uint8), np.concatenate([[0], np.cumsum([len(t) for *_, t in got])]))
    y = np.repeat([names.index(lang) for _, lang, _ in got], many)
    net, rng = Network(len(names)), np.random.default_rng(11)
    for _ in range(max(PASSES, -(-300 * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for k in range(0, len(order), BATCH):
            net.step(x[order[k : k + BATCH]].astype(np.int64), y[order[k : k + BATCH]])
    return {"names": names, "tables": net.tables(), "p": net.p}


def identify(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of each whole text.

    Probabilities of a text's windows are averaged by their bytes. Null text and text
    without a letter are `und` with score 0, and so is everything without a model. The
    model has a fixed size of about 21 MB and is sent once to each executor. Repeated
    rows give repeated rows; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("letters"))

    def work(batches):
        net = sent.value
        for batch in batches:
            n = batch.num_rows
            names, score = np.full(n, "und", object), np.zeros(n)
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for i, j in portions(offsets, AT_ONCE * WINDOW) if net else ():
                at = offsets[i : j + 1]
                windows, count = _windows(data[at[0] : at[-1]], at - at[0])
                if not len(windows):
                    continue
                q = np.concatenate([probabilities(windows[k : k + AT_ONCE], net["tables"], net["p"]) for k in range(0, len(windows), AT_ONCE)])
                some = np.flatnonzero(count)
                last = np.cumsum(count)[some] - 1
                weight = np.full(len(windows), WINDOW, np.float64)
                weight[last] = (np.diff(at)[some] - 1) % WINDOW + 1
                mean = np.add.reduceat(q * weight[:, None], last - count[some] + 1) / np.diff(at)[some][:, None]
                best = mean.argmax(1)
                names[i + some] = np.array(net["names"], object)[best]
                score[i + some] = np.clip(mean[np.arange(len(some)), best], 0, 1)
            names[~letters], score[~letters] = "und", 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return own.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
