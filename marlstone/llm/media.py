"""Media columns: bytes kept losslessly in baseline JPEG, and what can be read off the stored image.

A baseline JPEG stores 8x8 blocks of 64 quantised coefficients, so one block
holds 64 payload bytes, each as the signed value of one coefficient, with all
quantisers 1.  The encoder writes every block as its own restart interval; the
decoder below reads any baseline file, one lane for each restart interval,
all lanes of many images at once.

From the decoded coefficients come the payload, the image's size, a luminance
thumbnail of one pixel for each block (its DC value only, no inverse DCT), and
hashes of the thumbnail.

Defined cases: a null or empty text is one block of zero bytes; equal texts
give equal images; broken files raise ValueError in ``decode``; null ids and
repeated rows keep a row each; an empty table gives no rows; other columns play no
part; a very long text is one image, whose arrays take a small multiple of its
bytes, of at most ``SIDE`` squared blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
#: Blocks a side that 16-bit sizes allow.
SIDE = 8191
#: Blocks coded or decoded together, which bounds the working memory.
TOGETHER = 1 << 15
#: Coefficient order of a scan; the payload's byte k stands at place k of that order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: ((s := i // 8 + i % 8), i // 8 if s % 2 else i % 8)))

# The encoder's Huffman tables: how many codes of each length, and their symbols. A symbol of an AC table is
# 16 * (zeros before) + bits of the value; letters take 7 bits, digits and spaces 6.
_AC_FIRST = [0x07, 0x06, 0x08, 0x05, 0x00, 0x04]
_AC = _AC_FIRST + [s for s in [0xF0] + [16 * r + n for r in range(16) for n in range(1, 11)] if s not in _AC_FIRST]
_AC_COUNTS = [0, 2, 2, 2, 0, 0, 0, 0, 0, 0, len(_AC) - 6, 0, 0, 0, 0, 0]
_DC = [7, 6, 8, 0, 5, 4, 3, 2, 1, 9, 10, 11]
_DC_COUNTS = [0, 2, 2, 2, 2, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]


def _codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol (length 0: none), numbered as the standard says."""
    code, at = 0, 0
    out, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[symbols[at]], length[symbols[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return out, length


_AC_CODE, _AC_LENGTH = _codes(_AC_COUNTS, _AC)
_DC_CODE, _DC_LENGTH = _codes(_DC_COUNTS, _DC)
#: Of AC symbols, then of DC symbols from 256 on.
_CODE, _LENGTH = np.concatenate([_AC_CODE, _DC_CODE]), np.concatenate([_AC_LENGTH, _DC_LENGTH])
_BITS = np.array([int(v).bit_length() for v in range(2049)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC4, bytes([0x00, *_DC_COUNTS, *_DC]) + bytes([0x10, *_AC_COUNTS, *_AC]))
    + _segment(0xDD, (1).to_bytes(2, "big"))
)


def _put(words: np.ndarray, begins: np.ndarray, code: np.ndarray, length: np.ndarray) -> None:
    """Codes of up to 27 bits into 32-bit words, at ascending bit positions; each lies in one or two words."""
    word = begins >> 5
    wide = code << (64 - (begins & 31) - length).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words[word[starts]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), starts)
    words[word[starts] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), starts)


def _scan_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n, 64), each a restart interval of its own; and where each one's bytes end."""
    n = len(values)
    some = values != 0
    some[:, 0] = True
    at = np.flatnonzero(some.ravel())
    value = values.ravel()[at].astype(np.int32)
    place = (at & 63).astype(np.int32)
    run = np.zeros(len(at), np.int32)
    run[1:] = place[1:] - place[:-1] - 1
    dc = place == 0
    run[dc] = 0
    size = _BITS[np.abs(value)]
    low = np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    symbol = np.where(dc, 256 + size, 16 * (run & 15) + size)
    code = (_CODE[symbol] << size.astype(np.uint64)) | low
    length = _LENGTH[symbol] + size
    of = (at >> 6).astype(np.int64)
    # Runs of 16 zeros go before a code, ends of blocks after the last.
    longer = np.flatnonzero(run >= 16)
    before = np.repeat(longer, run[longer] >> 4)
    last = np.append(np.flatnonzero(dc)[1:] - 1, len(at) - 1)
    after = last[place[last] < 63] + 1
    if len(before) or len(after):
        where = np.concatenate([after, before])  # at one position an end of block comes first: it ends the block before
        kind = np.concatenate([np.zeros(len(after), np.int64), np.full(len(before), 0xF0)])
        block = np.concatenate([of[after - 1], of[before]])
        order = np.argsort(where, kind="stable")
        where, kind, block = where[order], kind[order], block[order]
        code, length, of = np.insert(code, where, _CODE[kind]), np.insert(length, where, _LENGTH[kind]), np.insert(of, where, block)
    # Bits of each block, filled up with ones to whole bytes.
    sums = np.concatenate([[0], np.cumsum(length)])
    edges = np.searchsorted(of, np.arange(n + 1))
    bits = np.diff(sums[edges])
    first = np.concatenate([[0], np.cumsum((bits + 7) >> 3)])
    words = np.zeros(first[-1] // 4 + 2, np.uint64)
    _put(words, sums[:-1] + (first[:-1] * 8 - sums[edges[:-1]])[of], code, length)
    fill = first[1:] * 8 - (first[:-1] * 8 + bits)
    pad = np.flatnonzero(fill)
    if len(pad):
        _put(words, first[:-1][pad] * 8 + bits[pad], (np.uint64(1) << fill[pad].astype(np.uint64)) - np.uint64(1), fill[pad])
    raw = words.astype(">u4").view(np.uint8)[: first[-1]]
    # A byte 0xFF is followed by a stuffed zero.
    stuffed = np.flatnonzero(raw == 0xFF)
    return np.insert(raw, stuffed + 1, 0), first[1:] + np.searchsorted(stuffed, first[1:])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of UNIT."""
    blocks = [len(p) // UNIT for p in payloads]
    wide = [max(int(np.ceil(np.sqrt(n))), -(-n // SIDE)) for n in blocks]
    high = [-(-n // w) for n, w in zip(blocks, wide, strict=True)]
    whole = [w * h for w, h in zip(wide, high, strict=True)]
    raw = b"".join(p + bytes(UNIT * (t - n)) for p, n, t in zip(payloads, blocks, whole, strict=True))
    values = np.frombuffer(raw, np.int8).reshape(-1, UNIT)
    coded, ends = [], []
    for at in range(0, len(values), TOGETHER):
        data, to = _scan_bytes(values[at : at + TOGETHER])
        ends.append(to + sum(map(len, coded)))
        coded.append(data)
    data, ends = np.concatenate(coded), np.concatenate(ends)
    # Restart markers go between the blocks of an image, numbered modulo 8.
    first = np.concatenate([[0], np.cumsum(whole)])
    number = np.arange(len(ends)) - np.repeat(first[:-1], whole)
    marked = np.insert(data, np.repeat(ends, 2), np.stack([np.full(len(ends), 0xFF), 0xD0 + number % 8], 1).ravel().astype(np.uint8))
    stops = ends + 2 * np.arange(1, len(ends) + 1)
    text = marked.tobytes()
    out, begin = [], 0
    for p, w, h, last in zip(payloads, wide, high, first[1:], strict=True):
        size = b"\x08" + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + b"\x01\x01\x11\x00"
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + _TABLES + _segment(0xC0, size) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        out.append(head + text[begin : stops[last - 1] - 2] + b"\xff\xd9")
        begin = stops[last - 1]
    return out


class _Image:
    """The markers of one baseline file, and its restart intervals."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.restart, self.comment, self.parts = 0, b"", []
        at = 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + length]
            if len(body) < length - 2:
                raise ValueError("a segment is cut short")
            at += 2 + length
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = 1 + (body[k] >> 4)
                    self.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                    k += 1 + 64 * wide
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = tuple(body[k + 1 : k + 17])
                    self.tables[body[k]] = counts, tuple(body[k + 17 : k + 17 + sum(counts)])
                    k += 17 + sum(counts)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC0 < marker < 0xD0:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        if len(chosen) != len(self.frame):
            raise ValueError("a scan of each component is not baseline interleaving")
        hs, vs = max(c[1] for c in self.frame), max(c[2] for c in self.frame)
        if len(self.frame) == 1:
            self.frame = [(self.frame[0][0], 1, 1, self.frame[0][3])]
            hs = vs = 1
        self.across, self.down = -(-self.width // (8 * hs)), -(-self.height // (8 * vs))
        #: For each block of a unit: component, and keys of its tables.
        self.cycle = [(i, chosen[c[0]] >> 4, 0x10 | chosen[c[0]] & 15) for i, c in enumerate(self.frame) for _ in range(c[1] * c[2])]
        units = self.across * self.down
        each = self.restart or units
        scan = np.frombuffer(data, np.uint8)[at:]
        marks = np.flatnonzero(scan[:-1] == 0xFF)
        after = scan[marks + 1]
        end = marks[after == 0xD9]
        stop = int(end[0]) if len(end) else len(scan)
        cuts = marks[(after & 0xF8) == 0xD0]
        self.edges = np.concatenate([[at], cuts[cuts < stop] + at + 2]), np.concatenate([cuts[cuts < stop] + at, [at + stop]])
        self.units = np.minimum(each, units - each * np.arange(len(self.edges[0])))
        if len(self.units) != -(-units // each):
            raise ValueError("restart intervals are missing")


#: Parts of an entry of a lookup table: bits it takes, places it moves on (64: end of block), whether it sets a
#: coefficient, whether its value bits reach beyond the 16 looked at; above these the value, or then code length and size.
_TAKES, _MOVES, _SETS, _WIDE, _VALUE = 31, 5, 1 << 12, 1 << 13, 16


def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...], dc: bool) -> np.ndarray:
    """What to do for each 16 bits that may come next; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, at = 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            run, size = (0, symbols[at]) if dc else (symbols[at] >> 4, symbols[at] & 15)
            sets = dc or size > 0
            moves = run + 1 if sets or run == 15 else 64
            common = (n + size) | moves << _MOVES | (_SETS if sets else 0)
            span = slice(code << (16 - n), (code + 1) << (16 - n))
            if n + size > 16:
                out[span] = common | _WIDE | (n * 16 + size) << _VALUE
            else:
                v = (np.arange(1 << (16 - n)) >> (16 - n - size)) & ((1 << size) - 1)
                v = np.where(v < (1 << size) >> 1, v - (1 << size) + 1, v)
                out[span] = common | v << _VALUE
            code, at = code + 1, at + 1
        code <<= 1
    return out


_lookups: dict[tuple, np.ndarray] = {}


def _coefficients(images: list[_Image], files: list[bytes]) -> list[np.ndarray]:
    """Quantised coefficients (blocks, 64) of images with the same tables and cycle, in scan order."""
    shape = images[0]
    blocks_in_unit = len(shape.cycle)
    keys = sorted({k for _, d, a in shape.cycle for k in (d, a)})
    tables = []
    for k in keys:
        what = (*shape.tables[k], k < 16)
        if what not in _lookups:
            _lookups[what] = _lookup(*what)
        tables.append(_lookups[what])
    tables = np.concatenate(tables)
    dc_base = np.array([keys.index(d) << 16 for _, d, _ in shape.cycle])
    ac_base = np.array([keys.index(a) << 16 for _, _, a in shape.cycle])
    component = np.array([c for c, _, _ in shape.cycle])
    joined = np.frombuffer(b"".join(files) + bytes(16), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(f) for f in files])])[:-1]
    begin = np.concatenate([i.edges[0] + b for i, b in zip(images, base, strict=True)])
    stop = np.concatenate([i.edges[1] + b for i, b in zip(images, base, strict=True)])
    units = np.concatenate([i.units for i in images])
    # Drop stuffed zeros.
    stuffed = np.flatnonzero((joined[:-1] == 0xFF) & (joined[1:] == 0)) + 1
    stuffed = stuffed[stuffed < len(joined) - 16]
    clean = np.delete(joined, stuffed)
    begin, stop = begin - np.searchsorted(stuffed, begin), stop - np.searchsorted(stuffed, stop)
    ahead = clean.astype(np.uint64)
    width = len(clean) - 8
    window = np.zeros(width, np.uint64)
    for k in range(5):
        window |= ahead[k : k + width] << np.uint64(32 - 8 * k)
    total = units * blocks_in_unit
    first = np.concatenate([[0], np.cumsum(total)])
    out = np.zeros((first[-1], 64), np.int16)
    flat = out.reshape(-1)
    prior = np.zeros((len(units), len(shape.frame)), np.int32)
    bit, done = begin * 8, np.zeros(len(units), np.int64)
    limit = stop * 8
    lane, place = np.arange(len(units)), np.zeros(len(units), np.int64)
    cyclic = blocks_in_unit > 1
    at, now, left = bit[lane], first[lane], total[lane]
    while len(lane):
        which = done[lane] % blocks_in_unit if cyclic else 0
        dc = place == 0
        some_dc = bool(dc.any())
        ahead = window[np.minimum(at >> 3, width - 1)] >> (24 - (at & 7)).astype(np.uint64)
        base = np.where(dc, dc_base[which], ac_base[which]) if some_dc else ac_base[which]
        found = tables[base + (ahead & np.uint64(0xFFFF)).astype(np.int64)]
        if not found.all():
            raise ValueError("a code is in no table")
        value = found >> _VALUE
        wide = np.flatnonzero(found & _WIDE)
        if len(wide):
            n, size = value[wide] >> 4, value[wide] & 15
            near = window[np.minimum(at[wide] >> 3, width - 1)]
            v = ((near >> (40 - (at[wide] & 7) - n - size).astype(np.uint64)).astype(np.int64) & ((1 << size) - 1)).astype(np.int32)
            value[wide] = np.where(v < (1 << size) >> 1, v - (1 << size) + 1, v)
        at = at + (found & _TAKES)
        place = place + ((found >> _MOVES) & 127)
        keep = (found & _SETS) != 0
        if (place[keep] > 64).any():
            raise ValueError("a block has too many coefficients")
        if some_dc:
            who, c = lane[dc], component[which[dc]] if cyclic else 0
            value[dc] += prior[who, c]
            prior[who, c] = value[dc]
        to = now * 64 + place - 1
        if keep.all():
            flat[to] = value
        else:
            flat[to[keep]] = value[keep]
        over = place >= 64
        if over.any():
            place[over] = 0
            now = now + over
            done[lane[over]] += 1
            going = done[lane] < left
            if not going.all():
                if (at[~going] > limit[lane[~going]]).any():
                    raise ValueError("a scan is too short")
                lane, at, now, left, place = lane[going], at[going], now[going], left[going], place[going]
    counts = [int((i.units * blocks_in_unit).sum()) for i in images]
    return np.split(out, np.cumsum(counts)[:-1])


def _thumbnail(image: _Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance of one pixel a block: a DC value is 8 times the block's mean above 128."""
    first = [k for k, c in enumerate(image.cycle) if c[0] == 0]
    h, v = image.frame[0][1], image.frame[0][2]
    dc = blocks[:, 0].astype(np.int64).reshape(-1, len(image.cycle))[:, first] * image.quant[image.frame[0][3]][0]
    grid = dc.reshape(image.down, image.across, v, h).transpose(0, 2, 1, 3).reshape(image.down * v, image.across * h)
    grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip(np.floor(grid / 8 + 128.5), 0, 255).astype(np.uint8)


def _hashes(thumb: np.ndarray) -> tuple[str, str]:
    """A 64-bit average hash of the thumbnail at 8x8, and the first half of a digest of all its pixels."""
    rows, cols = (np.arange(9) * n // 8 for n in thumb.shape)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    sums[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    r0, c0 = rows[:-1], cols[:-1]
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    small = (sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]) / area
    bits = np.packbits(small >= small.mean())
    return bits.tobytes().hex(), hashlib.sha256(thumb.tobytes()).hexdigest()[:32]


def decode(files: list[bytes]) -> list[dict]:
    """Of each file: width, height, quantised coefficients in scan order, DC thumbnail, hashes, comment."""
    images = [_Image(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault((tuple(image.cycle), tuple(sorted(image.tables.items())), tuple(c[1:3] for c in image.frame)), []).append(i)
    blocks: list = [None] * len(files)
    for members in groups.values():
        at = 0
        while at < len(members):
            to, many = at, 0
            while to < len(members) and (to == at or many < TOGETHER):
                many += len(images[members[to]].units)
                to += 1
            for i, b in zip(members[at:to], _coefficients([images[i] for i in members[at:to]], [files[i] for i in members[at:to]]), strict=True):
                blocks[i] = b
            at = to
    out = []
    for image, found in zip(images, blocks, strict=True):
        thumb = _thumbnail(image, found)
        out.append({"width": image.width, "height": image.height, "coefficients": found, "thumbnail": thumb, "hashes": _hashes(thumb), "comment": image.comment})
    return out


def payload_of(found: dict) -> bytes:
    """The payload that ``encode`` stored."""
    length = int(found["comment"].split()[1])
    return found["coefficients"].astype(np.int8).tobytes()[:length]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        to, many = at, 0
        while to < len(sizes) and (to == at or many + sizes[to] <= most):
            many += sizes[to]
            to += 1
        yield at, to
        at = to


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text, padded with zero bytes, as a JPEG in a binary column."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("__text").cast(pa.binary())]
            for at, to in _runs([len(t) for t in texts], TOGETHER * UNIT):
                some = [t + bytes((-len(t)) % UNIT or (0 if t else UNIT)) for t in texts[at:to]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array([len(t) for t in texts[at:to]], pa.int64()), pa.array(encode(some), pa.binary())], [id_col, "n_bytes", "media"]
                )

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def described(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, digests of payload and file, size, thumbnail, feature), all read from the stored files."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumbnail"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [x.as_buffer().to_pybytes() for x in batch.column("media")]
            for at, to in _runs([len(f) for f in files], 2 * TOGETHER * UNIT):
                some, rows = decode(files[at:to]), []
                for f, x in zip(files[at:to], some, strict=True):
                    p = payload_of(x)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), f"{x['width']}x{x['height']}:{':'.join(x['hashes'])}", x["width"], x["height"], x["thumbnail"].tobytes()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, thumbnail binary"
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
