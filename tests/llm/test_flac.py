import hashlib
import random
import zlib

import numpy as np
import pytest

from quillspark.llm import flac


def pcm(blocks):
    return b"".join(p for _, p in blocks)


RNG = random.Random(5)
PAYLOADS = [
    b"", bytes(64), b"z" * 4096, bytes(RNG.randrange(256) for _ in range(2 * 4096 + 64)), b"It was the best of times, " * 700, bytes([0, 255] * 2500), bytes([128] * 4095 + [0]) + b"spike" * 13, bytes(range(256)) * 33, b"abc",
]


def test_round_trip_and_offsets():
    back = flac.decode(flac.encode(PAYLOADS))
    assert [pcm(b) for b in back] == PAYLOADS
    assert [first for first, _ in back[3]] == [0, 4096, 8192]


def test_equal_bytes_give_equal_streams_in_any_company():
    alone = [flac.encode([p])[0] for p in PAYLOADS]
    assert alone == flac.encode(PAYLOADS) and alone[::-1] == flac.encode(PAYLOADS[::-1])


def test_damage_is_found():
    stream = flac.encode([PAYLOADS[4]])[0]
    for at in (12, len(stream) // 3, len(stream) // 2, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises((ValueError, IndexError, KeyError)):
            if pcm(flac.decode([bytes(bad)])[0]) == PAYLOADS[4]:
                raise ValueError("only the metadata was touched")


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, value, k):
        z = 2 * value if value >= 0 else -2 * value - 1
        self.bits += [0] * (z >> k) + [1]
        self.put(z, k)

    def data(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes()


def handmade(samples, subframe, number=0):
    """A stream of one frame (16-bit block size in the header, no seek table) around a subframe."""
    head = b"\xff\xf8\x70\x02" + bytes([number]) + (len(samples) - 1).to_bytes(2, "big")
    frame = head + bytes([flac.crc8(head)]) + subframe
    raw = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(raw, np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
    size = len(samples).to_bytes(2, "big")
    info = size * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | len(samples)).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame


@pytest.mark.parametrize("order", range(5))
def test_fixed_predictors_partitions_and_escapes(order):
    rng = random.Random(order)
    samples = [int(40 * np.sin(i / 9)) + rng.randrange(-3, 4) for i in range(64)]
    samples[40] = 127
    residual = np.diff(samples, n=order).tolist() if order else samples
    w = Writer()
    w.put((8 + order) << 1, 8)
    for s in samples[:order]:
        w.put(s & 255, 8)
    w.put(0, 2)
    w.put(2, 4)  # four partitions
    at = 0
    for part, k in enumerate((2, 15, 0, 5)):
        n = 16 - (order if part == 0 else 0)
        w.put(k, 4)
        if k == 15:
            w.put(13, 5)
        for r in residual[at : at + n]:
            w.put(r & 8191, 13) if k == 15 else w.rice(r, k)
        at += n
    assert pcm(flac.decode([handmade(samples, w.data())])[0]) == bytes(s + 128 for s in samples)


def test_wasted_bits_and_five_bit_parameters():
    samples = [4 * ((i * 7) % 16 - 8) for i in range(48)]
    w = Writer()
    w.put((8 << 1) | 1, 8)
    w.put(1, 2)  # two wasted bits: 0 then 1
    w.put(1, 2)
    w.put(0, 4)
    w.put(3, 5)
    for s in samples:
        w.rice(s >> 2, 3)
    assert pcm(flac.decode([handmade(samples, w.data())])[0]) == bytes(s + 128 for s in samples)


def test_texts(spark):
    texts = [None, "", "a", "é" * 100, "word " * 30_000, "a"]
    docs = spark.createDataFrame([(i if i else None, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in flac.media_features(flac.encode_texts(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i or None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[2].media_sha256 == got[5].media_sha256 and got[2].feature == got[5].feature
    blocks = flac.pcm_blocks(flac.encode_texts(docs)).filter("doc_id = 4").orderBy("first_sample").collect()
    assert b"".join(r.pcm for r in blocks).rstrip(b"\0").decode() == texts[4] and [r.first_sample for r in blocks] == [4096 * k for k in range(len(blocks))]
    assert flac.media_features(flac.encode_texts(docs.limit(0))).count() == 0
