"""Media columns in FLAC: texts as 8-bit mono sound, stored losslessly, read back and verified.

Encoding: 4,096 samples a frame; a frame is constant, plain, or what linear prediction leaves, in Rice
codes.  The linear predictor comes from exact integer autocorrelations by the Levinson recursion, so equal
bytes give equal frames on any machine.  Decoding: the frames of many streams are decoded side by
side, one residual of every frame at a time; header and frame checksums, sample counts and the MD5 of
the samples are verified, and PCM comes out in blocks with their sample offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, scratch_path, slices, table, text_or_empty

BLOCK = 4096
SAMPLE_RATE = 8000
LPC_ORDER = 8
PRECISION = 12
SHIFT = 9
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
PAD_TO = 64
BATCH_BYTES = 8_000_000
GROUP = 128  # frames of about the same length whose predictors are fitted together


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top = [], 1 << (bits - 1)
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1) ^ poly if crc & top else crc << 1
        out.append(crc & ((1 << bits) - 1))
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc = _CRC8[crc ^ byte]
    return crc


def crc16(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of bytes side by side."""
    order = np.argsort(start - end, kind="stable")
    first, size = start[order], (end - start)[order]
    crc = np.zeros(len(order), np.uint16)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for t, m in enumerate(active):
        head = crc[:m]
        crc[:m] = (head << np.uint16(8)) ^ _CRC16[(head >> np.uint16(8)) ^ buffer[first[:m] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 coding of frame headers."""
    if n < 0x80:
        return bytes([n])
    parts = []
    lead = 0x3F
    while n > lead:
        parts.append(0x80 | (n & 0x3F))
        n >>= 6
        lead >>= 1
    return bytes([((0xFE << (6 - len(parts))) & 0xFF) | n, *reversed(parts)])


def _levinson(x: np.ndarray, order: int) -> np.ndarray:
    """Quantised predictor coefficients (frames x order) of each row of samples."""
    r = [(x[:, : x.shape[1] - i].astype(np.int64) * x[:, i:]).sum(axis=1).astype(np.float64) for i in range(order + 1)]
    error = r[0] * 1.0001 + 1e-9
    a = np.zeros((len(x), order))
    for i in range(order):
        k = r[i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[i - j]
        k /= error
        old = a[:, :i].copy()
        a[:, :i] = old - k[:, None] * old[:, ::-1]
        a[:, i] = k
        error *= np.maximum(1 - k * k, 1e-6)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most).astype(np.int32)


def _rice(z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter and bits of each row of folded residuals (zero beyond its *n*)."""
    mean = z.sum(axis=1, dtype=np.int64) / np.maximum(n, 1)
    guess = np.floor(np.log2(np.maximum(mean * 0.7, 1))).astype(np.int64)
    least = np.maximum(0, np.frexp(z.max(axis=1).astype(np.float64))[1] - 5)  # no more than 31 zeros before a stop bit
    best_k, best = None, None
    for d in (0, 1):
        k = np.clip(np.maximum(guess + d, least), 0, 14)
        bits = (z >> k[:, None].astype(z.dtype)).sum(axis=1, dtype=np.int64) + n * (1 + k)
        if best is None:
            best_k, best = k, bits
        else:
            better = bits < best
            best_k, best = np.where(better, k, best_k), np.where(better, bits, best)
    return best_k, best


def _pack(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bytes of consecutive codes of at most 48 bits each."""
    keep = bits > 0
    values, bits = values[keep].astype(np.uint64), bits[keep]
    ends = np.cumsum(bits)
    begin = ends - bits
    word = begin >> 6
    end = (begin & 63) + bits
    out = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
    over = end > 64
    high = np.where(over, values >> np.where(over, end - 64, 0).astype(np.uint64), values << np.where(over, 0, 64 - end).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    out[word[over] + 1] |= values[over] << (128 - end[over]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8)[: int(ends[-1] + 7 >> 3)]


def _encoded_group(x: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Subframe bytes of frames of similar length; *x* (int32) is zero beyond each row's *n*."""
    rows, width = x.shape
    inside = np.arange(width) < n[:, None]
    order = LPC_ORDER if width > 2 * LPC_ORDER else 0
    candidates = []
    for kind in ("fixed", "lpc") if order else ("fixed",):
        coef = _levinson(x, order) if kind == "lpc" else None
        if kind == "lpc":
            predicted = np.zeros((rows, width - order), np.int32)
            for i in range(order):
                predicted += coef[:, i, None] * x[:, order - 1 - i : width - 1 - i]
            residual = x[:, order:] - (predicted >> SHIFT)
        else:
            residual = x
        z = np.where(inside[:, width - residual.shape[1] :], (residual << 1) ^ (residual >> 31), 0).astype(np.uint32)
        k, bits = _rice(z, np.maximum(n - (width - residual.shape[1]), 0))
        if kind == "lpc":  # frames too short for it take the other, in any group
            bits = np.where(n > 2 * LPC_ORDER, bits + order * (8 + PRECISION) + 9, 1 << 40)
        candidates.append((kind, coef, z, k, bits))
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    choice = np.argmin([c[4] for c in candidates], axis=0)
    plain = np.minimum.reduce([c[4] for c in candidates]) >= 8 * n
    out: list[bytes] = [b""] * rows
    for i in np.flatnonzero(constant | plain):
        out[i] = bytes([0x00, x[i, 0] & 0xFF]) if constant[i] else b"\x02" + x[i, : n[i]].astype(np.int8).tobytes()
    for number, (kind, coef, z, k, _) in enumerate(candidates):
        rows_ = np.flatnonzero((choice == number) & ~constant & ~plain)
        if not len(rows_):
            continue
        k, z, m = k[rows_], z[rows_], n[rows_]
        if kind == "lpc":
            head = np.full((len(rows_), 1), (32 + order - 1) << 1)
            coded = coef[rows_] & ((1 << PRECISION) - 1)
            lead = np.concatenate([head, x[rows_, :order] & 0xFF, np.full((len(rows_), 1), ((PRECISION - 1) << 5) | SHIFT), coded, k[:, None]], axis=1)
            lead_bits = [8] + [8] * order + [9] + [PRECISION] * order + [10]
        else:
            lead, lead_bits = np.stack([np.full(len(rows_), 8 << 1), k], axis=1), [8, 10]
        kz = k[:, None].astype(np.uint32)
        code = (z & ((np.uint32(1) << kz) - np.uint32(1))) | (np.uint32(1) << kz)
        live = np.arange(z.shape[1]) < (m - (width - z.shape[1]))[:, None]
        bits = np.where(live, (z >> kz).astype(np.int64) + 1 + k[:, None], 0)
        total = sum(lead_bits) + bits.sum(axis=1)
        fill = -total % 8
        values = np.concatenate([lead.astype(np.uint64), code.astype(np.uint64), np.zeros((len(rows_), 1), np.uint64)], axis=1)
        bits = np.concatenate([np.broadcast_to(np.array(lead_bits), (len(rows_), len(lead_bits))), bits, fill[:, None]], axis=1)
        raw = _pack(values.ravel(), bits.ravel()).tobytes()
        at = 0
        for i, size in zip(rows_, ((total + fill) >> 3).tolist()):
            out[i] = raw[at : at + size]
            at += size
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; a byte is the sample byte - 128."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    frames: list[bytes] = [b""] * len(owner)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), GROUP):
        rows = order[at : at + GROUP]
        width = int(length[rows].max())
        columns = np.arange(width)
        inside = columns < length[rows][:, None]
        x = np.where(inside, samples[np.minimum(start[rows][:, None] + columns, len(samples) - 1)], 0)
        for i, sub in zip(rows, _encoded_group(x, length[rows])):
            n = int(length[i])
            head = b"\xff\xf8" + (b"\xc0\x02" if n == BLOCK else b"\x70\x02") + _utf8_number(int(number[i])) + (b"" if n == BLOCK else (n - 1).to_bytes(2, "big"))
            frames[i] = head + bytes([crc8(head)]) + sub
    raw = np.frombuffer(b"".join(frames), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, frames), np.int64, len(frames)))
    checks = crc16(raw, np.r_[0, ends[:-1]].astype(np.int64), ends) if len(frames) else []
    frames = [f + int(c).to_bytes(2, "big") for f, c in zip(frames, checks)]
    out, at = [], 0
    for payload, k in zip(payloads, blocks.tolist()):
        own = frames[at : at + k]
        at += k
        md5 = hashlib.md5(payload.translate(_FLIP)).digest()
        smallest, largest = (min(map(len, own)), max(map(len, own))) if own else (0, 0)
        info = BLOCK.to_bytes(2, "big") * 2 + smallest.to_bytes(3, "big") + largest.to_bytes(3, "big") + ((SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big") + md5
        points, place = [], 0
        for i, f in enumerate(own if k > 1 else []):
            points.append((i * BLOCK).to_bytes(8, "big") + place.to_bytes(8, "big") + min(BLOCK, len(payload) - i * BLOCK).to_bytes(2, "big"))
            place += len(f)
        table_ = b"".join(points)
        meta = (b"\x00" if table_ else b"\x80") + len(info).to_bytes(3, "big") + info
        if table_:
            meta += b"\x83" + len(table_).to_bytes(3, "big") + table_
        out.append(b"fLaC" + meta + b"".join(own))
    return out


_FLIP = bytes((b - 128) & 0xFF for b in range(256))


class _Bits:
    """A reader of a few bits at a time, for the starts of frames."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def read(self, n: int) -> int:
        begin, end = self.at >> 3, (self.at + n + 7) >> 3
        value = int.from_bytes(self.data[begin:end], "big") >> (8 * end - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value


def _frame_start(data: bytes, at: int) -> dict:
    """Header and subframe header of the frame at a byte offset."""
    if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise ValueError("no frame where one should begin")
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] >> 4 or (data[at + 3] >> 1) & 7 not in (0, 1):
        raise ValueError("only one channel of 8 bits is stored")
    place = at + 4
    lead = data[place]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if lead < 0x80 else lead & ((1 << (6 - more)) - 1)
    for byte in data[place + 1 : place + 1 + more]:
        number = number << 6 | byte & 0x3F
    place += 1 + more
    if size_code in (6, 7):
        n = int.from_bytes(data[place : place + size_code - 5], "big") + 1
        place += size_code - 5
    else:
        n = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    place += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[at:place]) != data[place]:
        raise ValueError("a frame header's checksum is wrong")
    bits = _Bits(data, place + 1)
    kind, wasted = bits.read(8), 0
    if kind & 1:
        wasted = 1
        while not bits.read(1):
            wasted += 1
    kind, width = (kind >> 1) & 63, 8 - wasted
    found = {"at": at, "n": n, "number": number, "wasted": wasted, "variable": data[at + 1] & 1, "kind": "rice", "order": 0, "coef": [], "shift": 0, "warm": []}
    if kind == 0:
        found |= {"kind": "flat", "samples": np.full(n, bits.signed(width), np.int64), "bit": bits.at}
        return found
    if kind == 1:
        size = n * width
        raw = np.unpackbits(np.frombuffer(data[bits.at >> 3 : (bits.at + size + 7) >> 3], np.uint8))[bits.at & 7 :][:size].reshape(n, width).astype(np.int64)
        weights = 1 << np.arange(width - 1, -1, -1)
        weights[0] = -weights[0]
        found |= {"kind": "flat", "samples": raw @ weights, "bit": bits.at + size}
        return found
    order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if order < 0 or order > n:
        raise ValueError("a reserved kind of subframe")
    found |= {"order": order, "warm": [bits.signed(width) for _ in range(order)]}
    if kind >= 32:
        precision = bits.read(4) + 1
        found["shift"] = bits.signed(5)
        found["coef"] = [bits.signed(precision) for _ in range(order)]
    else:
        found["coef"] = FIXED[order]
    found["method"] = bits.read(2)
    found["parts"] = bits.read(4)
    found["bit"] = bits.at
    return found


def _decode_frames(buffer: np.ndarray, data: bytes, frames: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of each frame, and the byte behind each frame."""
    out: list = [f.get("samples") for f in frames]
    end_bit = np.array([f["bit"] for f in frames], np.int64)
    rice = sorted((i for i, f in enumerate(frames) if f["kind"] == "rice"), key=lambda i: frames[i]["order"] - frames[i]["n"])
    if rice:
        own = [frames[i] for i in rice]
        order = np.array([f["order"] for f in own])
        count = np.array([f["n"] for f in own]) - order
        most = max(1, int(order.max()))
        words = np.concatenate([buffer, np.zeros(24 - len(buffer) % 8, np.uint8)]).view(">u8").astype(np.uint64)
        pos = end_bit[rice].copy()
        coef = np.zeros((most, len(own)), np.int64)
        past = np.zeros((most + int(count[0]), len(own)), np.int32)
        for c, f in enumerate(own):
            coef[: f["order"], c] = f["coef"]
            past[most - f["order"] : most, c] = f["warm"]
        coef = coef[::-1].copy()
        shift = np.array([f["shift"] for f in own])
        method = np.array([f["method"] for f in own])
        part = np.array([f["n"] >> f["parts"] for f in own])
        k, raw_bits, escaped = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        next_part = np.zeros(len(own), np.int64)

        def window(at: np.ndarray) -> np.ndarray:
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            return (words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))

        active = np.searchsorted(-count, -np.arange(int(count[0])), side="left")
        due = 0
        for t, m in enumerate(active):
            if t == due:
                at = np.flatnonzero(next_part[:m] == t)
                wide = 4 + (method[at] == 1)
                param = (window(pos[at]) >> (64 - wide).astype(np.uint64)).astype(np.int64)
                pos[at] += wide
                escape = param == (1 << wide) - 1
                escaped[at], k[at] = escape, param
                plain = at[escape]
                raw_bits[plain] = (window(pos[plain]) >> np.uint64(59)).astype(np.int64)
                pos[plain] += 5
                next_part[at] = np.where(t == 0, part[at] - order[at], t + part[at])
                due = int(next_part[:m].min())
                kk = k.astype(np.uint64)
                some_escaped = escaped.any()
            seen = window(pos[:m])
            top = seen >> np.uint64(11)
            zeros = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
            if (short := top == 0).any():  # a long run of zeros: go on word by word
                for i in np.flatnonzero(short & ~escaped[:m]):
                    zeros[i] = _zeros(words, int(pos[i]))
            behind = pos[:m] + zeros + 1
            low = kk[:m]
            if (zeros > 38).any():
                tail = window(behind)
            else:
                tail = seen << (zeros + 1).astype(np.uint64)
            folded = (zeros << k[:m]) | ((tail >> np.uint64(1)) >> (np.uint64(63) - low)).astype(np.int64)
            residual = (folded >> 1) ^ -(folded & 1)
            after = behind + k[:m]
            if some_escaped:
                e = np.flatnonzero(escaped[:m])
                width = raw_bits[e]
                value = ((window(pos[e]) >> np.uint64(1)) >> (63 - width).astype(np.uint64)).astype(np.int64)
                residual[e] = np.where((width > 0) & (value >> np.maximum(width - 1, 0) == 1), value - (1 << width), value)
                after[e] = pos[e] + width
            pos[:m] = after
            predicted = (coef[:, :m] * past[t : t + most, :m]).sum(axis=0) >> shift[:m]
            past[most + t, :m] = residual + predicted
        end_bit[rice] = pos
        for c, i in enumerate(rice):
            out[i] = past[most - order[c] : most + count[c], c]
    for i, f in enumerate(frames):
        if f["wasted"]:
            out[i] = out[i] << f["wasted"]
    return out, (end_bit + 7) >> 3


def _zeros(words: np.ndarray, at: int) -> int:
    n = 0
    while not int(words[(at + n) >> 6]) >> (63 - ((at + n) & 63)) & 1:
        n += 1
        if (at + n) >> 6 >= len(words):
            raise ValueError("a residual has no end")
    return n


def _metadata(data: bytes) -> dict:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found = 4, False, {"points": []}
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            found |= {"block": int.from_bytes(body[:2], "big"), "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            found["points"] = [tuple(int.from_bytes(body[i + a : i + b], "big") for a, b in ((0, 8), (8, 16), (16, 18))) for i in range(0, size, 18)]
        at += 4 + size
    return found | {"first": at}


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (sample offset, unsigned 8-bit samples) of each stream; all checksums are verified."""
    data = b"".join(streams)
    buffer = np.frombuffer(data, np.uint8)
    base = np.cumsum([0, *map(len, streams)]).tolist()
    metas = [_metadata(s) for s in streams]
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    # every frame of the seek table at once; streams without one go on frame by frame
    todo = []
    for i, meta in enumerate(metas):
        if meta["samples"]:
            points = [p for p in meta["points"] if p[0] < 1 << 63] or [(0, 0, 0)]
            todo += [(i, first, base[i] + meta["first"] + offset) for first, offset, _ in points]
    while todo:
        starts = [_frame_start(data, at) for _, _, at in todo]
        samples, ends = _decode_frames(buffer, data, starts)
        checks = crc16(buffer, np.array([at for _, _, at in todo]), ends + 2)
        if checks.any() or (ends + 2 > np.array([base[i + 1] for i, _, _ in todo])).any():
            raise ValueError("a frame's checksum is wrong")
        later = []
        for (i, first, _), start, x, end in zip(todo, starts, samples, ends.tolist()):
            if start["number"] * (1 if start["variable"] else metas[i]["block"]) != first:
                raise ValueError("a frame isn't where the seek table says")
            blocks[i].append((first, (x + 128).astype(np.uint8).tobytes()))
            done = first + len(x)
            if done < metas[i]["samples"] and len(metas[i]["points"]) < 2:
                later.append((i, done, end + 2))
        todo = later
    for meta, own in zip(metas, blocks):
        own.sort()
        place = 0
        for first, pcm in own:
            if first != place:
                raise ValueError("samples are missing")
            place += len(pcm)
        pcm = b"".join(p for _, p in own)
        if place != meta["samples"] or any(meta["md5"]) and hashlib.md5(pcm.translate(_FLIP)).digest() != meta["md5"]:
            raise ValueError("the samples aren't those that were stored")
    return blocks


def padded(text: str) -> tuple[int, bytes]:
    """A text's bytes with zeros up to a positive multiple of 64, and their number without."""
    raw = text.encode("utf-8", "replace")
    return len(raw), raw + bytes(max(PAD_TO, -(-len(raw) // PAD_TO) * PAD_TO) - len(raw))


def encode_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media``: each text as a FLAC stream.

    A null text counts as empty: 64 zeros.  Very long texts are coded whole, in frames.  Of predictors that
    code a frame equally short the lowest order is taken, so equal texts give equal streams.  Repeated rows
    and null ids give rows of their own; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads = [padded(x) for x in batch["text"]]
            for start, end in slices([len(p) for _, p in payloads], BATCH_BYTES):
                part = payloads[start:end]
                ids = batch["doc_id"].iloc[start:end].reset_index(drop=True)
                yield pd.DataFrame({"doc_id": ids, "n_bytes": [n for n, _ in part], "media": encode([p for _, p in part])})

    return bounded_batches(docs).select("doc_id", text_or_empty().alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(store: DataFrame) -> DataFrame:
    """``doc_id``, ``first_sample``, ``n_samples``, ``pcm`` (unsigned bytes) of every block of a store.

    A stream that is null or fails a checksum is an error; repeated rows give repeated blocks; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            media = batch["media"].tolist()
            for start, end in slices([len(x) for x in media], BATCH_BYTES):
                rows = [(i, first, len(pcm), pcm) for i, own in zip(batch["doc_id"].iloc[start:end].tolist(), decode(media[start:end])) for first, pcm in own]
                yield pd.DataFrame(rows, columns=["doc_id", "first_sample", "n_samples", "pcm"]).astype({"doc_id": "Int64"})

    return bounded_batches(store).select("doc_id", "media").mapInPandas(run, "doc_id long, first_sample long, n_samples long, pcm binary")


def feature(pcm: bytes) -> str:
    """Integers that describe the sound: sum, energy, sign changes, extremes of the samples."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    signs = x >= 0
    return f"sum={x.sum(dtype=np.int64)} energy={int((x * x).sum(dtype=np.int64))} crossings={int((signs[1:] != signs[:-1]).sum())} min={x.min()} max={x.max()}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(store: DataFrame) -> DataFrame:
    """Digests and features of each row of a store, from the bytes read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            media = batch["media"].tolist()
            for start, end in slices([len(x) for x in media], BATCH_BYTES):
                rows = []
                for doc_id, n, raw, blocks in zip(batch["doc_id"].iloc[start:end].tolist(), batch["n_bytes"].iloc[start:end].tolist(), media[start:end], decode(media[start:end])):
                    pcm = b"".join(p for _, p in blocks)
                    rows.append((doc_id, n, len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-PAD_TO:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(pcm)))
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return bounded_batches(store).select("doc_id", "n_bytes", "media").mapInPandas(run, FEATURES)


def write_store(docs: DataFrame, path: str) -> None:
    encode_texts(docs).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").parquet(path)


def op3_flac(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "flac-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return media_features(spark.read.parquet(path))
