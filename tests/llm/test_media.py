import hashlib
import os
import zlib

import numpy as np
import pytest

from lexweave.llm import media


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def bytes(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


DC = ((0, 1, 5, 1, 1, 1, 1, 1, 1), tuple(range(12)))
AC_SYMBOLS = (0x00, 0x01, 0x02, 0x11, 0xF0, 0x31, 0x04)
AC = ((0, 2, 1, 1, 1, 1, 1), AC_SYMBOLS)


def size_bits(v):
    n = abs(v).bit_length()
    return n, (v if v >= 0 else v + (1 << n) - 1)


def coded(blocks_by_component, layout, restart, rng):
    """Entropy-coded data of blocks with random AC coefficients, one MCU after another."""
    dc, ac = media._codes(*DC), media._codes(*AC)
    out, bits, last = [], Bits(), {}
    mcus = len(blocks_by_component[0]) // layout[0]
    for m in range(mcus):
        if restart and m and m % restart == 0:
            out.append(bits.bytes())
            bits, last = Bits(), {}
        for c, times in enumerate(layout):
            for k in range(times):
                v = int(blocks_by_component[c][m * times + k])
                n, extra = size_bits(v - last.get(c, 0))
                last[c] = v
                bits.put(*dc[n])
                bits.put(extra, n)
                at = 1
                while at < 64 and rng.random() < 0.7:
                    symbol = AC_SYMBOLS[int(rng.integers(1, len(AC_SYMBOLS)))]
                    step = (symbol >> 4) + 1
                    if at + step > 63 and symbol != 0xF0 or at + 16 > 63:
                        break
                    bits.put(*ac[symbol])
                    bits.put(int(rng.integers(1 << (symbol & 15))) if symbol & 15 else 0, symbol & 15)
                    at += step
                bits.put(*ac[0])
    return b"".join(x + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(out) + 1 else b"") for i, x in enumerate(out)) + bits.bytes()


def jpeg(width, height, samplings, values, restart, rng, quant=3):
    body = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + media._segment(0xFE, b"\xff\xd9 a comment") + media._segment(0xDB, bytes([0] + [quant] * 64))
    body += media._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(samplings)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(samplings)))
    body += media._segment(0xC4, media._table(0, *DC)) + media._segment(0xC4, media._table(0x10, *AC))
    body += media._segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    body += media._segment(0xDA, bytes([len(samplings)]) + b"".join(bytes([i + 1, 0]) for i in range(len(samplings))) + bytes([0, 63, 0]))
    return body + coded(values, [h * v if len(samplings) > 1 else 1 for h, v in samplings], restart, rng) + b"\xff\xd9"


@pytest.mark.parametrize("samplings", [[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_general_files(samplings, restart):
    rng = np.random.default_rng(len(samplings) * 10 + restart)
    width, height = 61, 43
    h, v = samplings[0] if len(samplings) > 1 else (1, 1)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    values = [rng.integers(-340, 340, across * down * (a * b if len(samplings) > 1 else 1)) for a, b in samplings]
    files = [jpeg(width, height, samplings, values, restart, rng), media.encode_samples([bytes(range(64)) * 3])[0]]
    got = media.thumbnails(files)
    luma = values[0].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    want = np.clip(np.floor(luma * 3 / 8 + 128.5), 0, 255)[: -(-height // 8), : -(-width // 8)]
    assert (got[0][0] == want).all() and got[1][0].tobytes() == bytes(range(64)) * 3


def test_lossless_storage():
    payloads = [bytes(64), b"\xff" * 640, b"\x00\xff" * 320, os.urandom(64 * 33), os.urandom(64 * 8300), bytes(range(256)) * 4]
    assert [b"".join(t.tobytes() for t in x) for x in media.thumbnails(media.encode_samples(payloads))] == payloads


def test_several_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 128)
    for n in (64, 64 * 128, 64 * 129, 128 * 128, 128 * 128 + 64, 3 * 128 * 128 + 640):
        p = os.urandom(n)
        assert sum(a * b for a, b in media.shape_of(n)) == n
        assert b"".join(t.tobytes() for t in media.thumbnails(media.encode_samples([p]))[0]) == p


def test_refuses():
    good = media.encode_samples([bytes(64)])[0]
    for bad in (b"no", good[:-2], good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-6] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            media.thumbnails([bad])


def test_mutated_files_raise_value_errors_only():
    rng = np.random.default_rng(8)
    good = bytearray(media.encode_samples([os.urandom(64 * 5)])[0])
    for _ in range(600):
        bad = bytearray(good)
        for _ in range(int(rng.integers(1, 4))):
            bad[int(rng.integers(len(bad)))] = int(rng.integers(256))
        try:
            media.thumbnails([bytes(bad[: len(bad) - int(rng.integers(3))])])
        except ValueError:
            pass


def test_bands_change_nothing(monkeypatch):
    payloads = [os.urandom(64 * n) for n in (1, 7, 40, 3)] + [os.urandom(64 * 9000)]
    want = media.encode_samples(payloads)
    features = [media.feature(x) for x in media.thumbnails(want)]
    monkeypatch.setattr(media, "BAND_BYTES", 640)
    monkeypatch.setattr(media, "LANES", 5)
    assert media.encode_samples(payloads[:4]) == want[:4]
    got = media.thumbnails(want[:4])
    assert [b"".join(t.tobytes() for t in x) for x in got] == payloads[:4] and [media.feature(x) for x in got] == features[:4]


def test_a_very_long_payload_takes_a_bounded_multiple_of_memory():
    import tracemalloc

    payload = os.urandom(64) * 100_000
    tracemalloc.start()
    stored = media.encode_samples([payload])
    thumbs = media.thumbnails(stored)
    media.feature(thumbs[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(t.tobytes() for t in thumbs[0]) == payload and peak < 20 * len(payload) + (64 << 20), peak / len(payload)


def test_features_see_every_image_of_a_file(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 128)
    a = os.urandom(128 * 128)
    one, two = (media.feature(media.thumbnails(media.encode_samples([a + bytes([x]) * 32 + bytes(32)]))[0]) for x in (0, 255))
    assert one != two and one.count("+") == 1


def test_columns(spark):
    texts = ["", None, "a", "é" * 100, "x" * 64, "x" * 64, "long " * 50_000]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id int, text string, feature double")
    got = {r.doc_id: r for r in media.media_columns(docs, store=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert got[0].feature == got[1].feature and got[4].feature == got[5].feature and got[0].feature.startswith("512x8:")
    assert media.media_columns(docs.limit(0)).count() == 0
