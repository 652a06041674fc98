"""AVI motion-JPEG columns: writing, RIFF index parsing, intra-frame decoding and shot detection.

A payload is stored one byte to an 8 x 8 block: the block's DC level is the byte, and all
other coefficients are 0, so a frame is a plain baseline JPEG that any decoder shows, and
decoding it at one-eighth scale gives the bytes back exactly. Restart markers after each
row of blocks let numpy decode all rows of a batch of frames in step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import portions, utf8

#: Blocks in a row, rows in a frame, frames in a second.
COLS, ROWS, FPS = 64, 8, 25
#: Payload bytes handled at once inside a task.
PORTION = 1 << 20
#: Shot rule: bins of the histogram, frames looked back, deviations, and the least difference.
BINS, BACK, SIGMAS, FLOOR = 16, 8, 3.0, 0.10

#: Huffman code lengths: DC categories, and end-of-block as the only AC symbol.
DC_BITS = {3: (2, 3, 4, 7), 4: (0, 1, 5, 6, 8)}
AC_BITS = {1: (0,)}


def _codes(bits: dict[int, tuple[int, ...]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes given out in order of length."""
    out, code = {}, 0
    for length in range(1, 17):
        for symbol in bits.get(length, ()):
            out[symbol] = (code, length)
            code += 1
        code <<= 1
    return out


def _dht(kind: int, bits: dict[int, tuple[int, ...]]) -> bytes:
    body = bytes([kind, *(len(bits.get(n, ())) for n in range(1, 17))]) + bytes(s for n in range(1, 17) for s in bits.get(n, ()))
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


def _header() -> bytes:
    quant = b"\xff\xdb" + struct.pack(">H", 67) + bytes([0] + [8] * 64)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, ROWS * 8, COLS * 8, 1) + bytes([1, 0x11, 0])
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])
    return b"\xff\xd8" + quant + frame + _dht(0, DC_BITS) + _dht(0x10, AC_BITS) + b"\xff\xdd" + struct.pack(">HH", 4, COLS) + scan


HEADER = _header()


def jpeg_frames(rows: np.ndarray) -> list[bytes]:
    """Baseline JPEG frames of ROWS rows of COLS bytes each (rows: a multiple of ROWS)."""
    n = len(rows)
    level = rows.astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=np.zeros((n, 1), np.int32))
    size = np.zeros(512, np.int64)
    for v in range(512):
        size[v] = v.bit_length()
    cat = size[np.abs(diff)]
    table, eob = _codes(DC_BITS), _codes(AC_BITS)[0]
    code = np.array([table[c][0] for c in range(9)], np.int64)
    length = np.array([table[c][1] for c in range(9)], np.int64)
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff)
    value = (((code[cat] << cat) | extra) << eob[1] | eob[0]).astype(np.uint64)
    bits = length[cat] + cat + eob[1]
    for _ in range(2):  # four blocks make one piece of 52 bits at most
        value = (value[:, 0::2] << bits[:, 1::2].astype(np.uint64)) | value[:, 1::2]
        bits = bits[:, 0::2] + bits[:, 1::2]
    total = bits.sum(1)
    pad = -total % 8
    words = np.zeros((n, 15), np.uint64)
    at, lane = np.zeros(n, np.int64), np.arange(n)
    for k in range(bits.shape[1] + 1):
        v, b = (value[:, k], bits[:, k]) if k < bits.shape[1] else (((1 << pad) - 1).astype(np.uint64), pad)
        top = (v << (63 - b).clip(0).astype(np.uint64)) << np.uint64(1)
        shift, word = (at & 63).astype(np.uint64), at >> 6
        words[lane, word] |= top >> shift
        words[lane, word + 1] |= (top << (np.uint64(63) - shift)) << np.uint64(1)
        at += b
    count = (total + pad) >> 3
    out = np.zeros((n, 122), np.uint8)
    out[:, :120] = words.byteswap().view(np.uint8)
    turn = lane % ROWS
    out[lane, count] = 0xFF
    out[lane, count + 1] = np.where(turn == ROWS - 1, 0xD9, 0xD0 + turn)
    col = np.arange(122)
    used = col < (count + 2)[:, None]
    stuffed = (out == 0xFF) & (col < count[:, None])
    flat, stuff = out[used], stuffed[used]
    ends = np.cumsum(count + 2 + stuffed.sum(1))
    wide = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    wide[np.arange(len(flat)) + np.cumsum(stuff) - stuff] = flat
    data = wide.tobytes()
    cuts = [0, *ends[ROWS - 1 :: ROWS].tolist()]
    return [HEADER + data[a:b] for a, b in zip(cuts, cuts[1:])]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], payload: int) -> bytes:
    """An AVI file of MJPG frames with an idx1 index; `payload` stands in the stream's strd chunk."""
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, COLS * 8, ROWS * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0, 0, 0, 0, COLS * 8, ROWS * 8)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, COLS * 8, ROWS * 8, 1, 24, b"MJPG", COLS * ROWS * 192, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap) + _chunk(b"strd", struct.pack("<Q", payload))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", strl))
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of the body, its length); a list's name is its type."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise ValueError(f"chunk {name!r} is longer than what holds it")
        yield (data[at + 8 : at + 12], at + 12, size - 4) if name in (b"LIST", b"RIFF") else (name, at + 8, size)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> dict:
    """Frame rate, payload length and frames of an AVI file, found by its index.

    Without an idx1 chunk the movi list is walked. A file that isn't an AVI of motion
    JPEG raises ValueError.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"payload": None, "frames": []}
    movi = index = None
    for name, at, size in _chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"hdrl":
            for inner, a, n in _chunks(data, at, at + size):
                if inner != b"strl":
                    continue
                for kind, b, m in _chunks(data, a, a + n):
                    if kind == b"strh":
                        if data[b : b + 8] != b"vidsMJPG":
                            raise ValueError("not motion JPEG")
                        scale, rate = struct.unpack("<II", data[b + 20 : b + 28])
                        out["fps"] = rate / scale
                    elif kind == b"strd":
                        out["payload"] = int.from_bytes(data[b : b + 8], "little")
        elif name == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None or "fps" not in out:
        raise ValueError("an AVI file without frames")
    if index:
        entries = np.frombuffer(data, "<u4", index[1] // 16 * 4, index[0]).reshape(-1, 4)
        base = movi[0] - 4 if len(entries) and data[movi[0] - 4 + int(entries[0, 2]) :][:4] == entries[0, :1].tobytes() else 0
        out["frames"] = [data[base + o + 8 : base + o + 8 + n] for o, n in entries[:, 2:].tolist()]
    else:
        out["frames"] = [data[a : a + n] for name, a, n in _chunks(data, movi[0], movi[0] + movi[1]) if name[2:] == b"dc"]
    return out


def _lookup(bits: bytes, symbols: bytes) -> np.ndarray:
    """65,536 entries: code length << 8 | symbol."""
    out, at, k = np.zeros(65536, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(bits[length - 1]):
            span = 1 << (16 - length)
            out[at : at + span] = length << 8 | symbols[k]
            at, k = at + span, k + 1
    return out


def jpeg_header(frame: bytes) -> dict:
    """Tables and layout of a baseline JPEG frame; `end` is where its scan begins."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a broken JPEG header")
        kind, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC0:
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif kind == 0xDD:
            out["restart"] = int.from_bytes(body[:2], "big")
        elif kind == 0xDA:
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            out["end"] = at
            return out
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG frames are read")
    raise ValueError("a JPEG frame without a scan")


def _whole_blocks(dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """For 16 bits ahead: bits of a whole block << 16 | DC difference + 32768; 0 if it isn't a DC code and end-of-block."""
    w = np.arange(65536)
    length, size = dc >> 8, dc & 15
    used = length + size
    v = (w >> (16 - used).clip(0)) & ((1 << size) - 1)
    v = np.where((size > 0) & (v < (1 << (size - 1).clip(0))), v - (1 << size) + 1, v)
    then = ac[(w << used.clip(0, 16)) & 0xFFFF]
    sure = (length > 0) & (then > 0) & (then & 255 == 0) & (used + (then >> 8) <= 16)
    return np.where(sure, (used + (then >> 8)) << 16 | (v + 32768), 0).astype(np.int32)


def _flat_lanes(clean: np.ndarray, pos: np.ndarray, todo: int, table: np.ndarray) -> np.ndarray | None:
    """DC levels (lanes, todo) of frames whose blocks are all flat; None where one is not."""
    window = clean[:-4].astype(np.uint32)
    window = (window << 8 | clean[1:-3]) << 8 | clean[2:-2]
    diff = np.zeros((todo, len(pos)), np.int32)
    p = pos.copy()
    for k in range(todo):
        entry = table[(window[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF]
        if not entry.all():
            return None
        p += entry >> 16
        diff[k] = entry & 0xFFFF
    return np.cumsum(diff - 32768, axis=0).T


def decode_dc(frames: list[bytes], head: dict) -> np.ndarray:
    """DC images of the first component: (frames, block rows, block columns), 8-bit levels.

    All frames share the header `head`. Every restart interval is a lane; one step reads
    one Huffman symbol in all lanes at once.
    """
    if "parts" not in head:
        raise ValueError("only baseline JPEG frames are read")
    one = len(head["parts"]) == 1
    up = max(p[1] for p in head["parts"]), max(p[2] for p in head["parts"])
    layout = [i for i, p in enumerate(head["parts"]) for _ in range(1 if one else p[1] * p[2])]
    unit = (8, 8) if one else (8 * up[0], 8 * up[1])
    across, down = -(-head["width"] // unit[0]), -(-head["height"] // unit[1])
    per_frame = across * down
    step = head["restart"] or per_frame
    lanes_per = -(-per_frame // step)
    raw = np.frombuffer(b"".join(f[head["end"] :] for f in frames) + b"\0" * 16, np.uint8)
    ends = np.cumsum([len(f) - head["end"] for f in frames])
    after = np.append(raw[1:], np.uint8(0))
    marker = (raw == 0xFF) & (after >= 0xD0) & (after <= 0xD9)
    drop = marker.copy()
    drop[1:] |= marker[:-1] | ((raw[:-1] == 0xFF) & (raw[1:] == 0))
    kept_before = np.cumsum(~drop) - ~drop
    restarts = np.flatnonzero(marker & (after <= 0xD7)) + 2
    begins = np.sort(np.concatenate([[0], ends[:-1], restarts])) if lanes_per > 1 else np.concatenate([[0], ends[:-1]])
    if len(begins) != len(frames) * lanes_per:
        raise ValueError("restart markers are missing")
    clean = raw[~drop]
    clean = np.concatenate([clean, np.zeros(16, np.uint8)])
    pos = kept_before[begins].astype(np.int64) * 8
    n = len(pos)
    lane = np.arange(n)
    todo = np.minimum(step, per_frame - (lane % lanes_per) * step) * len(layout)
    lut = np.stack([head["huff"][k] for p in head["parts"] for k in (head["scan"][p[0]][0], 0x10 | head["scan"][p[0]][1])])
    order = np.array(layout)
    level = _flat_lanes(clean, pos, int(todo[0]), _whole_blocks(lut[0], lut[1])) if one and (todo == todo[0]).all() else None
    todo = np.zeros(n, np.int64) if level is not None else todo
    level = np.zeros((n, int(todo.max())), np.int32) if level is None else level
    block, coef = np.zeros(n, np.int64), np.zeros(n, np.int64)
    last = np.zeros((n, len(head["parts"])), np.int64)
    live = lane[todo > 0]
    window = np.zeros(len(clean) - 8 if len(live) else 0, np.uint64)
    for k in range(8 if len(live) else 0):
        window = (window << np.uint64(8)) | clean[k : len(clean) - 8 + k]
    while len(live):
        part = order[block[live] % len(layout)]
        k, p = coef[live], pos[live]
        x = window[np.minimum(p >> 3, len(window) - 1)] << (p & 7).astype(np.uint64)
        entry = lut[2 * part + (k > 0), (x >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("a code that no table holds")
        size = symbol & 15
        v = ((x << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        v = np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)
        pos[live] = p + length + size
        dc = k == 0
        if dc.any():
            a = live[dc]
            last[a, part[dc]] += v[dc]
            level[a, block[a]] = last[a, part[dc]]
        k = np.where(dc, 1, np.where(symbol == 0, 64, np.where(symbol == 0xF0, k + 16, k + (symbol >> 4) + 1)))
        over = k >= 64
        coef[live] = np.where(over, 0, k)
        block[live] += over
        if over.any():
            live = live[block[live] < todo[live]]
    flat = np.zeros((len(frames), lanes_per * level.shape[1]), np.int32)
    flat[:] = level.reshape(len(frames), -1)
    flat = flat[:, : per_frame * len(layout)] if lanes_per * level.shape[1] >= per_frame * len(layout) else flat
    own = flat[:, [i for i in range(flat.shape[1]) if order[i % len(layout)] == 0]] if not one else flat
    quant = int(head["quant"][head["parts"][0][3]][0])
    image = np.clip(np.rint(own * quant / 8).astype(np.int64) + 128, 0, 255).astype(np.uint8)
    if one:
        return image.reshape(len(frames), down, across)
    h, w = head["parts"][0][2], head["parts"][0][1]
    return image.reshape(len(frames), down, across, h, w).transpose(0, 1, 3, 2, 4).reshape(len(frames), down * h, across * w)


def shots(images: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each frame begins a shot. `owner` numbers the films, in order.

    The difference of two frames is half the L1 distance of their histograms. A cut is a
    difference of at least FLOOR that stands SIGMAS deviations above the mean of the BACK
    differences before it in the same film.
    """
    n = len(images)
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    if n < 2:
        return first
    flat = images.reshape(n, -1)
    hist = np.bincount((np.repeat(np.arange(n), flat.shape[1]) * BINS + (flat.ravel() >> 4)), minlength=n * BINS).reshape(n, BINS) / flat.shape[1]
    diff = np.zeros(n)
    diff[1:] = np.abs(hist[1:] - hist[:-1]).sum(1) / 2
    diff = np.round(diff, 9)
    diff[first] = 0
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    low = np.maximum(begin + 1, np.arange(n) - BACK)
    count = np.maximum(np.arange(n) - low, 0)
    # sums over a few frames by shifts, so that a film gives the same values in any batch
    total, square = np.zeros(n), np.zeros(n)
    for k in range(1, BACK + 1):
        d = np.zeros(n)
        d[k:] = diff[:-k]
        d[count < k] = 0
        total, square = total + d, square + d * d
    mean = total / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(count, 1) - mean * mean, 0))
    return first | ((count > 0) & (diff >= FLOOR) & (diff > mean + SIGMAS * spread))


def _store(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One AVI file for each text."""
    size = np.diff(offsets)
    payload = np.maximum(-(-size // 64), 1) * 64
    rows = -(-payload // (COLS * ROWS)) * ROWS
    starts = np.concatenate([[0], np.cumsum(rows)])
    canvas = np.zeros(int(starts[-1]) * COLS, np.uint8)
    canvas[np.repeat(starts[:-1] * COLS - offsets[:-1], size) + np.arange(len(data))] = data
    frames = jpeg_frames(canvas.reshape(-1, COLS))
    cuts = (starts // ROWS).tolist()
    return [avi(frames[a:b], int(p)) for a, b, p in zip(cuts, cuts[1:], payload)]


def to_avi(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an AVI motion-JPEG file.

    Null and empty texts become one frame of zeros. Texts of any length are handled; a
    task holds PORTION bytes of texts, or one longer text, at a time. Repeated rows give
    repeated rows, and other columns are not read.
    """

    def work(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in portions(offsets, PORTION):
                own = offsets[i : j + 1]
                media = _store(data[own[0] : own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(own)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, n_bytes long, media binary")


def _read(files: list[bytes | None]) -> list[tuple[bytes, list[tuple[int, int]], int, float] | None]:
    """(payload, shots as (first frame, end frame), frames, frames a second) of each file; None for a null or broken one."""
    some = [f for f in files if f is not None]
    try:
        got = iter(_read_all(some) if some else [])
    except (ValueError, IndexError, KeyError, OverflowError, struct.error):
        if len(files) == 1:
            return [None]
        return [x for f in files for x in _read([f])]  # only the broken ones are lost
    return [None if f is None else next(got) for f in files]


def _read_all(files: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]], int, float]]:
    known: dict[bytes, dict] = {}
    films = [parse_avi(f) for f in files]
    groups: dict[bytes, list[tuple[int, int]]] = {}
    lengths: list[int] = []
    for i, film in enumerate(films):
        for k, frame in enumerate(film["frames"]):
            key = next((frame[:n] for n in lengths if frame[:n] in known), None)
            if key is None:
                head = jpeg_header(frame)
                key = frame[: head["end"]]
                known[key] = head
                lengths = sorted({*lengths, head["end"]})
            groups.setdefault(key, []).append((i, k))
    images: list[list] = [[None] * len(f["frames"]) for f in films]
    begins: list[list] = [[True] * len(f["frames"]) for f in films]
    for key, where in groups.items():
        got = decode_dc([films[i]["frames"][k] for i, k in where], known[key])
        starts = shots(got, np.array([i for i, _ in where]))
        for (i, k), image, start in zip(where, got, starts.tolist()):
            images[i][k], begins[i][k] = image, start
    out = []
    for film, image, start in zip(films, images, begins):
        payload = b"".join(x.tobytes() for x in image)[: film["payload"]]
        edges = [k for k, s in enumerate(start) if s] + [len(start)]
        out.append((payload, list(zip(edges, edges[1:])), len(start), film["fps"]))
    return out


def _each(media: DataFrame, made, schema: str, carried: list[str]) -> DataFrame:
    def work(batches):
        for batch in batches:
            files = batch.column(len(carried)).to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(f or b"") for f in files])])
            for i, j in portions(offsets, 2 * PORTION):
                yield from made([batch.column(c).slice(i, j - i) for c in range(len(carried))], files[i:j])

    return media.select(*carried, "media").mapInArrow(work, schema)


def clips(media: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Timed clip rows of AVI files: (doc_id, clip, first_frame, end_frame, start_s, end_s).

    Null and broken files have no rows; repeated files repeat theirs; other columns than
    doc_id and media are not read.
    """
    kind = media.schema[doc_id].dataType.simpleString()

    def made(carried, files):
        got = _read(files)
        of = np.repeat(np.arange(len(files)), [len(x[1]) if x else 0 for x in got])
        rows = [(k, a, b, a / fps, b / fps) for _, cut, _, fps in filter(None, got) for k, (a, b) in enumerate(cut)]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [carried[0].take(pa.array(of)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())))],
            ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"],
        )

    return _each(media, made, f"doc_id {kind}, clip int, first_frame int, end_frame int, start_s double, end_s double", [doc_id])


def digests(media: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What is read back from AVI files (doc_id, n_bytes, media): payload and file digests, and the clips as text.

    A null or broken file gives nulls, but for the size and digest of the file itself if it
    is there. Repeated rows give repeated rows.
    """
    kind = media.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def made(carried, files):
        got = _read(files)
        feature = [f"frames={x[2]};clips=" + ",".join(f"{a / x[3]:.2f}-{b / x[3]:.2f}" for a, b in x[1]) if x else None for x in got]
        payload = [x[0] if x else None for x in got]
        of = lambda f, values, kind: pa.array([None if v is None else f(v) for v in values], kind)
        sha = lambda v: hashlib.sha256(v).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [
                *carried, of(len, payload, pa.int64()), of(sha, payload, pa.string()), of(lambda v: zlib.crc32(v[-64:]), payload, pa.int64()),
                of(len, files, pa.int64()), of(sha, files, pa.string()), pa.array(feature, pa.string()),
            ],
            names,
        )

    return _each(media, made, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", [doc_id, "n_bytes"])
