"""Baseline JPEG, in numpy: parse markers, Huffman-decode scans, rebuild DC-only luminance thumbnails; and a writer to match.

Decoding. A thumbnail has one sample a block: the block's mean, from its DC coefficient. Scans are decoded in lockstep: every restart
interval of every image in a batch is a lane, and one numpy step decodes the next block of all lanes, so Python runs once for a
block position, not once for a block. Files without restart intervals are one lane each. Grey and colour files, any sampling, restart
intervals, 8-bit baseline and extended sequential Huffman scans in one pass are read; other kinds raise ValueError.

Writing. `encode_samples` stores bytes losslessly: each byte is the level of one flat 8 x 8 block, quantised so that the DC coefficient is
the byte less 128. Rows of blocks are restart intervals. Images hold at most ROWS x ROWS blocks; longer payloads become several images one after another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_columns

#: Blocks in a row, unless an image would be too tall; JPEG has at most 65,535 samples a side.
WIDTH, ROWS = 64, 65535 // 8
#: Payload bytes encoded or decoded at once in a worker.
BATCH_BYTES = 1 << 21
#: Payload bytes whose Huffman codes are made at once, and restart intervals decoded at once: bound what a very long text takes.
BAND_BYTES, LANES = 1 << 19, 1 << 13
#: DC categories 0 to 8 in order of code: seven codes of three bits, one of four, one of five.
DC_SYMBOLS, DC_BITS = (2, 3, 4, 5, 6, 7, 0, 1, 8), (0, 0, 7, 1, 1)


def _codes(bits: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes dealt in canonical order."""
    got, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            got[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return got


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, bits: tuple[int, ...], symbols: tuple[int, ...]) -> bytes:
    return bytes([kind, *bits, *[0] * (16 - len(bits)), *symbols])


def _head(wide: int, high: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0] + [8] * 64)),
        _segment(0xC0, bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, _table(0x00, DC_BITS, DC_SYMBOLS) + _table(0x10, (1,), (0,))),
        _segment(0xDD, wide.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


_CODE, _LENGTH = (np.array([_codes(DC_BITS, DC_SYMBOLS)[c][i] for c in range(9)], np.uint32) for i in (0, 1))
_CATEGORY = np.array([int(x).bit_length() for x in range(256)])


def _scans(values: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of every row of `wide` blocks, stuffed, and where each row begins; values: rows x wide, 0 to 255."""
    level = values.astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = np.abs(diff)
    category = _CATEGORY[size]
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff).astype(np.uint32)
    # The block's code: its DC symbol, the difference, and a 0 for the end of the block.
    code = ((_CODE[category] << category.astype(np.uint32) | extra) << np.uint32(1)).ravel()
    length = (_LENGTH[category] + category + 1).astype(np.int64)
    pad = -length.sum(axis=1) % 8
    length[:, -1] += pad
    length = length.ravel()
    last = np.arange(wide - 1, len(code), wide)
    code[last] = code[last] << pad.astype(np.uint32) | ((1 << pad) - 1).astype(np.uint32)
    bits = np.unpackbits((code << (32 - length).astype(np.uint32)).astype(">u4").view(np.uint8)).reshape(-1, 32)
    packed = np.packbits(bits[np.arange(32) < length[:, None]])
    ends = np.cumsum(length.reshape(-1, wide).sum(axis=1)) // 8
    full = packed == 0xFF
    before = np.r_[0, np.cumsum(full)]
    out = np.zeros(len(packed) + int(before[-1]), np.uint8)
    out[np.arange(len(packed)) + before[:-1]] = packed
    return out, np.r_[0, ends + before[ends]]


def shape_of(n: int) -> list[tuple[int, int]]:
    """(blocks wide, blocks high) of the images that hold n bytes, a multiple of WIDTH."""
    got = []
    while n:
        wide = min(ROWS // WIDTH * WIDTH, -(-n // (WIDTH * ROWS)) * WIDTH)
        high = min(ROWS, n // wide) or 1
        wide = wide if n >= wide else n
        got.append((wide, high))
        n -= wide * high
    return got


def encode_samples(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of WIDTH bytes, as JPEG images whose thumbnails' samples, in order, are its bytes."""
    jobs: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    parts: list[list[bytes]] = []
    for i, p in enumerate(payloads):
        data, at = np.frombuffer(p, np.uint8), 0
        parts.append([b""] * len(shapes := shape_of(len(p))))
        for k, (wide, high) in enumerate(shapes):
            jobs.setdefault(wide, []).append((i, k, data[at : at + wide * high].reshape(high, wide)))
            at += wide * high
    for wide, work in jobs.items():
        scans = [bytearray() for _ in work]
        for band in _bands([len(x) for *_, x in work], max(1, BAND_BYTES // wide)):
            coded, begins = _scans(np.concatenate([work[w][2][a:b] for w, a, b in band]), wide)
            raw, row = coded.tobytes(), 0
            for w, a, b in band:
                for r in range(a, b):
                    if r:
                        scans[w] += bytes([0xFF, 0xD0 + (r - 1) % 8])
                    scans[w] += raw[begins[row] : begins[row + 1]]
                    row += 1
        for (i, k, x), scan in zip(work, scans):
            parts[i][k] = b"".join((_head(wide, len(x)), scan, b"\xff\xd9"))
    return [b"".join(x) for x in parts]


def _bands(sizes: list[int], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (item, from, to) through items of these sizes, in bands of at most `most` in all."""
    band, room = [], most
    for i, n in enumerate(sizes):
        at = 0
        while at < n:
            to = min(n, at + room)
            band.append((i, at, to))
            room -= to - at
            at = to
            if not room:
                yield band
                band, room = [], most
    if band:
        yield band


class Frame(NamedTuple):
    width: int
    height: int
    #: id, horizontal and vertical sampling, quantiser of the DC coefficient, DC table, AC table, by component
    components: list[tuple[int, int, int, int, np.ndarray, np.ndarray]]
    restart: int
    scan: tuple[int, int]


def lookup(bits: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit window: code length * 256 + symbol; zero where no code begins."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length * 256 + s
            code += 1
        at += n
        code <<= 1
    return table


_tables: dict[bytes, np.ndarray] = {}


def images(data: bytes) -> Iterator[Frame]:
    """The frames of one or more JPEG files that follow one another."""
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no image begins at {at}")
        at += 2
        quant: dict[int, int] = {}
        huff: dict[int, np.ndarray] = {}
        frame, restart = None, 0
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 2 > end or data[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            marker = data[at + 1]
            if marker == 0xD9:
                at += 2
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("not 8 bits a sample")
                frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])])
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"frame type {marker:#x} is not baseline")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    key = body[1 : 17 + n]
                    if key not in _tables:
                        if len(_tables) > 64:
                            _tables.clear()
                        _tables[key] = lookup(body[1:17], body[17 : 17 + n])
                    huff[body[0]] = _tables[key]
                    body = body[17 + n :]
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                if frame is None or body[0] != len(frame[2]):
                    raise ValueError("scans of single components are not read")
                of = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                stop = at
                while True:  # the scan ends at a marker that is neither a stuffed byte nor a restart
                    stop = data.find(b"\xff", stop)
                    if stop < 0 or stop + 1 >= end:
                        raise ValueError("scan without end")
                    if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                        stop += 2
                        continue
                    break
                parts = [(c, hv >> 4, hv & 15, quant[q], huff[of[c] >> 4], huff[16 + (of[c] & 15)]) for c, hv, q in frame[2]]
                yield Frame(frame[0], frame[1], parts, restart, (at, stop))
                at = stop


class _Lanes(NamedTuple):
    frame: Frame
    mcus: int
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def _unstuffed(data: bytes, frame: Frame, base: int) -> tuple[np.ndarray, _Lanes]:
    """The scan without stuffed bytes and restart markers, and where in it (from base) each interval begins."""
    raw = np.frombuffer(data, np.uint8, frame.scan[1] - frame.scan[0], frame.scan[0])
    mark = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, int)
    after = raw[mark + 1]
    restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
    gone = np.sort(np.concatenate([mark[after == 0] + 1, restarts, restarts + 1]))
    kept = lambda at: at - np.searchsorted(gone, at)
    hs, vs = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    if len(frame.components) == 1:
        hs = vs = 1
    mcus = -(-frame.width // (8 * hs)) * -(-frame.height // (8 * vs))
    each = frame.restart or mcus
    counts = np.full(-(-mcus // each), each)
    counts[-1] -= counts.sum() - mcus
    starts = base + np.r_[0, kept(restarts + 2)]
    if len(starts) != len(counts):
        raise ValueError("restart markers don't fit the frame")
    return np.delete(raw, gone), _Lanes(frame, mcus, starts, np.r_[base + kept(restarts), base + len(raw) - len(gone)], counts)


def _decode(stream: np.ndarray, lanes: list[_Lanes]) -> list[np.ndarray]:
    """Levels, 0 to 255, of the first component's blocks, in scan order, for frames that share components' tables and sampling."""
    parts = lanes[0].frame.components
    each = parts[0][1] * parts[0][2] if len(parts) > 1 else 1
    got = [np.zeros(x.mcus * each, np.uint8) for x in lanes]
    for band in _bands([len(x.counts) for x in lanes], LANES):
        start, end, count = (np.concatenate([getattr(lanes[i], n)[a:b] for i, a, b in band]) for n in ("starts", "ends", "counts"))
        dc, row = _decode_band(stream, parts, start, end, count), 0
        for i, a, b in band:
            rows, n = dc[row : row + b - a], lanes[i].counts[a:b]
            row += b - a
            level = np.clip(np.floor(rows * lanes[i].frame.components[0][3] / 8 + 128.5), 0, 255).astype(np.uint8)
            # All intervals but an image's last are of one length.
            at, width = a * int(lanes[i].counts[0]) * each, int(n[0]) * each
            whole = level[:-1, :width].ravel()
            got[i][at : at + len(whole)] = whole
            got[i][at + len(whole) : at + len(whole) + int(n[-1]) * each] = level[-1, : int(n[-1]) * each]
    return got


def _decode_band(stream: np.ndarray, parts: list[tuple], start: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
    """DC coefficients of the first component's blocks, a row an interval; intervals in lockstep."""
    layout = [(i, 1) if len(parts) == 1 else (i, c[1] * c[2]) for i, c in enumerate(parts)]
    order = np.argsort(-count, kind="stable")
    bit, left = (start[order] - start.min()) * 8, count[order]
    last = end[order] - start.min()
    of_first = layout[0][1]
    out = np.zeros((len(order), int(left[0]) * of_first), np.int32)
    previous = np.zeros((len(parts), len(order)), np.int64)
    padded = np.r_[stream[start.min() : end.max()], np.zeros(16, np.uint8)]
    # Eight bytes from each byte on, as one big-endian number.
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def window(position: np.ndarray) -> np.ndarray:
        """The 57 bits or more that begin at a bit position, at the top of 64."""
        got = words[position >> 3].copy().view(">u8").ravel().astype(np.uint64)
        return got << (position & 7).astype(np.uint64)

    for mcu in range(int(left[0])):
        n = int(np.searchsorted(-left, -mcu, side="left"))  # lanes that still have a block
        at = np.minimum(bit[:n], 8 * (len(padded) - 8))
        for c, times in layout:
            dc, ac = parts[c][4], parts[c][5]
            for k in range(times):
                seen = window(at)
                entry = dc[(seen >> np.uint64(48)).astype(np.int64)]
                if not entry.all():
                    raise ValueError("no such Huffman code")
                length, size = entry >> 8, entry & 255
                rest = seen << length.astype(np.uint64)
                extra = np.where(size > 0, rest >> (np.uint64(64) - np.maximum(size, 1).astype(np.uint64)), 0).astype(np.int64)
                extra = np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)
                previous[c, :n] += np.where(size > 0, extra, 0)
                if c == 0:
                    out[:n, mcu * times + k] = previous[0, :n]
                # The first AC symbol lies in the same window (at most 16 + 11 bits on); blocks that end there are done.
                entry = ac[(rest << size.astype(np.uint64) >> np.uint64(48)).astype(np.int64)]
                at = at + length + size + np.where(entry & 255 == 0, entry >> 8, 0)
                open_ = np.flatnonzero(entry & 255)
                done = np.ones(len(open_), np.int64)
                while len(open_):
                    entry = ac[(window(at[open_]) >> np.uint64(48)).astype(np.int64)]
                    if not entry.all():
                        raise ValueError("no such Huffman code")
                    symbol = entry & 255
                    at[open_] += (entry >> 8) + (symbol & 15)
                    done += np.where(symbol == 0, 64, (symbol >> 4) + 1)
                    more = done < 64
                    open_, done = open_[more], done[more]
        bit[:n] = at
    if (bit > 8 * last).any():
        raise ValueError("scan ends early")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnail (rows x columns, uint8) of each image in each file, files decoded together. A file that isn't what is read raises ValueError."""
    try:
        return _thumbnails(files)
    except (IndexError, KeyError, ZeroDivisionError, OverflowError) as e:
        raise ValueError(f"malformed image: {e!r}") from e


def _thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    groups: dict[tuple, list[tuple[int, int, _Lanes]]] = {}
    streams: list[np.ndarray] = []
    base, found = 0, []
    for f, data in enumerate(files):
        found.append([])
        for frame in images(data):
            stream, lanes = _unstuffed(data, frame, base)
            streams += [stream, np.zeros(8, np.uint8)]
            base += len(stream) + 8
            key = tuple((c[1], c[2], id(c[4]), id(c[5])) for c in frame.components)
            groups.setdefault(key, []).append((f, len(found[f]), lanes))
            found[f].append(None)
    stream = np.concatenate(streams) if streams else np.zeros(0, np.uint8)
    for work in groups.values():
        for (f, k, lanes), level in zip(work, _decode(stream, [x for *_, x in work])):
            frame = lanes.frame
            _, h, v, *_ = frame.components[0]
            hs, vs = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
            if len(frame.components) == 1:
                h = v = hs = vs = 1
            across = -(-frame.width // (8 * hs))
            grid = level.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
            wide, high = -(-(-(-frame.width * h // hs)) // 8), -(-(-(-frame.height * v // vs)) // 8)
            found[f][k] = grid[:high, :wide]
    return found


def feature(thumbs: list[np.ndarray]) -> str:
    """Dimensions and hashes of a file's thumbnails, each `WxH:average hash:difference hash`, joined by plus signs."""
    return "+".join(map(_feature, thumbs))


def _feature(t: np.ndarray) -> str:
    rows, cols = (np.linspace(0, n, k + 1).astype(int) for n, k in ((t.shape[0], 8), (t.shape[1], 9)))
    (low_r, high_r), (low_c, high_c) = ((np.minimum(at[:-1], n - 1), np.maximum(at[1:], np.minimum(at[:-1], n - 1) + 1)) for at, n in ((rows, t.shape[0]), (cols, t.shape[1])))
    # Rows of cells first: no copy of the whole thumbnail.
    sums = np.zeros((8, t.shape[1] + 1))
    for i in range(8):
        t[low_r[i] : high_r[i]].sum(axis=0, dtype=np.float64, out=sums[i, 1:])
    sums = sums.cumsum(axis=1)
    small = (sums[:, high_c] - sums[:, low_c]) / ((high_r - low_r)[:, None] * (high_c - low_c))
    average = np.packbits(small[:, :8] > small[:, :8].mean()).tobytes().hex()
    difference = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    return f"{8 * t.shape[1]}x{8 * t.shape[0]}:{average}:{difference}"


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _batches(payloads: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for p in payloads:
        held.append(p)
        size += len(p)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def media_columns(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, store: bool = False) -> DataFrame:
    """docs (the columns in keep, all by default) with the stored form's digests and features; with `media binary` itself if store.

    A text is stored as UTF-8 with zero bytes up to a positive multiple of WIDTH; null is empty. payload_sha256 and tail_crc32 (of the last
    WIDTH bytes) are of the payload as decoded from the stored bytes. Rows pass through one by one, repeats included; input columns of
    these names are replaced.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["media"] * store
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def add(part: pa.RecordBatch) -> dict[str, pa.Array]:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(text_col).to_pylist()]
        rows = []
        sizes = iter([len(x) for x in raw])
        for held in _batches([x + bytes(-len(x) % WIDTH or (0 if x else WIDTH)) for x in raw]):
            stored = encode_samples(held)
            for media, thumbs in zip(stored, thumbnails(stored)):
                payload = b"".join(t.tobytes() for t in thumbs)
                rows.append((next(sizes), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(thumbs), media)[: len(names)])
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}

    keep = docs.columns if keep is None else keep
    return with_columns(docs.select(*dict.fromkeys([*keep, text_col])), add, FIELDS + ", media binary" * store, keep)


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return media_columns(table(spark, sf_dir, "documents"), keep=["doc_id"])
