"""Media columns as progressive JPEG, written and read in numpy.

The reader takes baseline-sampled progressive files: scans select a spectral band of one or all components
and approximate coefficients successively; each scan adds its bits to the coefficient arrays, which are then
dequantised, inverse-transformed (one matrix product), the chroma upsampled and turned into full-resolution
RGB tensors. Any Huffman tables, sampling factors, restart intervals and scan scripts are read; scans whose
codes all have one length, as those this writer makes, are read as arrays, others bit by bit.

The writer stores bytes losslessly in the format's unit, the quantised coefficients of a 4:2:0 image with
unit quantisers: a block holds 64 bytes, the first as its DC value less 128, the others as the AC values
whose magnitude category is 8 (128 to 255, and -255 to -128), so a byte's eight bits are the coefficient's
eight extra bits. The number of bytes stands in a comment segment.

Defined results: null and empty texts are a payload of padding alone; repeated rows give repeated results;
an empty table gives an empty result; a file that is not a progressive JPEG, or breaks off, raises
ValueError; other columns are not read; texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows

UNIT = 576
WIDEST = 4095  # MCUs in a row: 65,520 pixels


def _zigzag() -> np.ndarray:
    """Position in the block (8 * row + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


@lru_cache(maxsize=1)
def inverse_dct() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 pixels): pixels = coefficients @ inverse_dct()."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.kron(basis, basis)[ZIGZAG]


# ---------------------------------------------------------------- writer

#: Symbols by code length. DC: category c has 12 - c bits, so a code and its extra bits are always 12 bits.
DC_LENGTH = 12
DC_TABLE = {DC_LENGTH - c: [c] for c in range(9)}
WHOLE, COARSE = {1: [0x08]}, {1: [0x07]}  # each coefficient: no zeros before it, category 8 or 7
RUNS = {4: [n << 4 for n in range(15)]}  # ends of band over 2**n blocks and more
ALL_BLOCKS = 32767


def codes_of(table: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """symbol: (code, bits), canonical."""
    out, code, last = {}, 0, 0
    for bits in sorted(table):
        code <<= bits - last
        last = bits
        for symbol in table[bits]:
            out[symbol] = (code, bits)
            code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(slot: int, table: dict[int, list[int]]) -> bytes:
    counts = bytes(len(table.get(n, ())) for n in range(1, 17))
    return _segment(0xC4, bytes([slot]) + counts + bytes(s for n in sorted(table) for s in table[n]))


def _scan(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes(c) for c in components) + bytes([ss, se, ah << 4 | al])
    pad = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(pad, dtype=np.uint8)]) if pad else bits).tobytes()
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


@lru_cache(maxsize=1)
def _dc_words() -> np.ndarray:
    """The 12 bits of each difference from -255 to 255, as a row of bits."""
    codes, rows = codes_of(DC_TABLE), []
    for d in range(-255, 256):
        c = abs(d).bit_length()
        word = codes[c][0] << c | (d if d >= 0 else d + (1 << c) - 1)
        rows.append([word >> k & 1 for k in range(DC_LENGTH - 1, -1, -1)])
    return np.array(rows, dtype=np.uint8)


@lru_cache(maxsize=1)
def _tables() -> bytes:
    return b"".join(
        [_segment(0xDB, bytes([0]) + bytes([1] * 64)), _dht(0x00, DC_TABLE), _dht(0x10, WHOLE), _dht(0x11, COARSE), _dht(0x12, RUNS)]
    )


def _interleaved(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """(mcu, 6) of per-block values: four of y, one of each chroma."""
    rows, w = cb.shape
    four = y.reshape(rows, 2, w, 2).transpose(0, 2, 1, 3).reshape(rows * w, 4)
    return np.concatenate([four, cb.reshape(-1, 1), cr.reshape(-1, 1)], axis=1)


def _led(flag_bits: np.ndarray) -> np.ndarray:
    """Rows of bits with a 0 before each."""
    out = np.zeros((len(flag_bits), flag_bits.shape[1] + 1), dtype=np.uint8)
    out[:, 1:] = flag_bits
    return out.ravel()


def write(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the bytes of ``payload``, a multiple of 64."""
    n = -(-len(payload) // 384)
    rows = -(-n // WIDEST)
    w = -(-n // rows)
    a = np.full(rows * w * 384, 255, dtype=np.uint8)
    a[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    a = a.reshape(rows, w, 6, 64)
    y = a[:, :, :4].reshape(rows, w, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * rows, 2 * w, 64)
    cb, cr = a[:, :, 4], a[:, :, 5]

    dc = _interleaved(*(c[..., 0].astype(np.int16) - 128 for c in (y, cb, cr)))
    high = dc >> 1
    diff = np.empty_like(high)
    four = high[:, :4].ravel()
    diff[:, :4] = np.diff(four, prepend=np.int16(0)).reshape(-1, 4)
    diff[:, 4] = np.diff(high[:, 4], prepend=np.int16(0))
    diff[:, 5] = np.diff(high[:, 5], prepend=np.int16(0))
    everything = [(1, 0x00), (2, 0x00), (3, 0x00)]
    eight = lambda x: np.unpackbits(np.ascontiguousarray(x).reshape(-1, 1), axis=1)
    tail = np.ascontiguousarray(y[..., 6:]).ravel()
    size = struct.pack(">BHHB", 8, 16 * rows, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])

    low = (tail & 1 ^ (tail < 128)).reshape(-1, 58)  # the last bit of the magnitude
    runs, codes = [], codes_of(RUNS)
    for at in range(0, len(low), ALL_BLOCKS):
        part = low[at : at + ALL_BLOCKS]
        k = len(part).bit_length() - 1
        word = codes[k << 4][0] << k | (len(part) - (1 << k))
        runs += [np.array([word >> b & 1 for b in range(3 + k, -1, -1)], dtype=np.uint8), part.ravel()]
    return b"".join(
        [
            b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xC2, size), _tables(),
            _scan(everything, 0, 0, 0, 1, _dc_words()[diff.ravel() + 255].ravel()),
            _scan([(1, 0x00)], 1, 5, 0, 0, _led(eight(y[..., 1:6]))),
            _scan([(2, 0x00)], 1, 63, 0, 0, _led(eight(cb[..., 1:]))),
            _scan([(3, 0x00)], 1, 63, 0, 0, _led(eight(cr[..., 1:]))),
            _scan([(1, 0x01)], 6, 63, 0, 1, _led(eight(tail)[:, :7])),
            _scan(everything, 0, 0, 1, 0, (dc & 1).astype(np.uint8).ravel()),
            _scan([(1, 0x02)], 6, 63, 1, 0, np.concatenate(runs)),
            b"\xff\xd9",
        ]
    )


# ---------------------------------------------------------------- reader


@dataclass
class Component:
    h: int
    v: int
    quantiser: int
    shape: tuple[int, int] = (0, 0)  # blocks that hold pixels
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # zigzag; padded to whole MCUs


@dataclass
class Image:
    height: int
    width: int
    components: dict[int, Component]
    quantisers: dict[int, np.ndarray]
    comment: bytes = b""


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.by_code: dict[tuple[int, int], int] = {}
        code = at = 0
        for bits, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.by_code[bits, code] = s
                code += 1
            at += n
            code <<= 1
        totals = {bits + (s & 15) for (bits, _), s in self.by_code.items()}
        #: Bits of every code with its extra bits, if they are all the same and few.
        self.fixed = totals.pop() if len(totals) == 1 and max(totals) <= 16 else 0
        first = [s for (bits, code), s in self.by_code.items() if bits == 1 and code == 0]
        #: The symbol of the code 0, if that has one bit.
        self.zero = first[0] if first else None

    @property
    def differences(self) -> np.ndarray:
        """For fixed tables: the DC difference of every word of ``fixed`` bits, a large number where none is."""
        out = np.full(1 << self.fixed, 1 << 20, dtype=np.int32)
        for (bits, code), c in self.by_code.items():
            v = np.arange(1 << c)
            out[code << c | v] = np.where(v < (1 << c >> 1), v - (1 << c) + 1, v)
        return out


@lru_cache(maxsize=32)
def huffman(counts: bytes, symbols: bytes, dc: bool) -> tuple[Huffman, np.ndarray | None]:
    table = Huffman(counts, symbols)
    return table, table.differences if dc and table.fixed else None


class Bits:
    def __init__(self, data: bytes):
        self.a, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.a[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        if self.at > len(self.a):
            raise ValueError("a scan breaks off")
        return value

    def symbol(self, table: Huffman) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | self.take(1)
            found = table.by_code.get((bits, code))
            if found is not None:
                return found
        raise ValueError("no such code")


def extend(v: int, bits: int) -> int:
    return v - (1 << bits) + 1 if bits and v < 1 << (bits - 1) else v


class Reader:
    def __init__(self, data: bytes):
        self.data, self.tables, self.restart = data, {}, 0
        self.image: Image | None = None

    def read(self) -> Image:
        d, at = self.data, 2
        if d[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        comment, quantisers = b"", {}
        while True:
            if at + 4 > len(d) and d[at : at + 2] != b"\xff\xd9":
                raise ValueError("the file breaks off")
            if d[at] != 0xFF:
                raise ValueError("no marker")
            marker = d[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                if self.image is None:
                    raise ValueError("no frame")
                self.image.comment, self.image.quantisers = comment, quantisers
                return self.image
            size = struct.unpack_from(">H", d, at + 2)[0]
            body = d[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                comment = body
            elif marker == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    quantisers[n] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], dtype=">u2" if wide else "u1").astype(np.float64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    n = sum(counts)
                    self.tables[body[0]] = huffman(counts, body[17 : 17 + n], body[0] < 16)
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF:
                raise ValueError("not a progressive JPEG")
            elif marker == 0xDA:
                end = _AFTER_SCAN.search(d, at)
                if end is None:
                    raise ValueError("the file breaks off")
                self._scan(body, d[at : end.start()])
                at = end.start()

    def _frame(self, body: bytes) -> None:
        depth, height, width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or not height or not width:
            raise ValueError("unsupported frame")
        found = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        hm, vm = max(c.h for c in found.values()), max(c.v for c in found.values())
        across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
        for c in found.values():
            c.shape = (-(-height * c.v // (8 * vm)), -(-width * c.h // (8 * hm)))
            c.blocks = np.zeros((down * c.v, across * c.h, 64), dtype=np.int32)
        self.image = Image(height, width, found, {})
        self.mcus = (down, across)

    def _order(self, chosen: list[Component]) -> list[np.ndarray]:
        """For each component the flat numbers of its blocks, MCU by MCU: (mcu, blocks in it)."""
        if len(chosen) == 1:
            c = chosen[0]
            return [(np.arange(c.shape[0])[:, None] * c.blocks.shape[1] + np.arange(c.shape[1])).reshape(-1, 1)]
        down, across = self.mcus
        out = []
        for c in chosen:
            n = np.arange(c.blocks.shape[0] * c.blocks.shape[1]).reshape(down, c.v, across, c.h)
            out.append(n.transpose(0, 2, 1, 3).reshape(down * across, c.v * c.h))
        return out

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        picked = [(self.image.components[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(n)]
        ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        orders = self._order([c for c, _ in picked])
        flats = [c.blocks.reshape(-1, 64) for c, _ in picked]
        parts = _RESTARTS.split(data) if self.restart else [data]
        step = self.restart or len(orders[0])
        for k, part in enumerate(parts):
            some = [o[k * step : (k + 1) * step] for o in orders]
            bits = Bits(part.replace(b"\xff\x00", b"\xff"))
            if ss == 0:
                (self._dc_more if ah else self._dc)(bits, picked, flats, some, al)
            else:
                (self._ac_more if ah else self._ac)(bits, self.tables[0x10 | picked[0][1] & 15][0], flats[0], some[0].ravel(), ss, se, al)

    def _dc(self, bits: Bits, picked, flats, orders, al: int) -> None:
        tables = [self.tables[t >> 4] for _, t in picked]
        widths = [o.shape[1] for o in orders]
        n, each = len(orders[0]), sum(widths)
        length = tables[0][0].fixed
        if length and all(t[0].fixed == length for t in tables) and len(bits.a) >= n * each * length:
            words = bits.a[: n * each * length].reshape(n * each, length)
            wide = np.zeros((n * each, 16), dtype=np.uint8)
            wide[:, 16 - length :] = words
            value = np.packbits(wide, axis=1).view(">u2").reshape(n, each)
            at = 0
            for flat, order, table, width in zip(flats, orders, tables, widths, strict=True):
                diff = table[1][value[:, at : at + width]]
                if diff.max(initial=0) > 1 << 16:
                    raise ValueError("no such code")
                flat[order.ravel(), 0] = np.cumsum(diff.ravel()) << al
                at += width
            return
        last = [0] * len(orders)
        for m in range(n):
            for j, (flat, order, table) in enumerate(zip(flats, orders, tables, strict=True)):
                for b in order[m]:
                    c = bits.symbol(table[0])
                    last[j] += extend(bits.take(c), c)
                    flat[b, 0] = last[j] << al

    def _dc_more(self, bits: Bits, picked, flats, orders, al: int) -> None:
        each = np.concatenate(orders, axis=1).shape[1]
        n = len(orders[0])
        if len(bits.a) < n * each:
            raise ValueError("a scan breaks off")
        value, at = bits.a[: n * each].reshape(n, each).astype(np.int32), 0
        for flat, order in zip(flats, orders, strict=True):
            flat[order.ravel(), 0] |= value[:, at : at + order.shape[1]].ravel() << al
            at += order.shape[1]

    def _ac(self, bits: Bits, table: Huffman, flat, blocks, ss: int, se: int, al: int) -> None:
        n, band = len(blocks), se - ss + 1
        if table.zero is not None and table.zero >> 4 == 0 and 0 < table.zero & 15 <= 8:
            s = table.zero & 15
            need = n * band * (s + 1)
            if need <= len(bits.a) < need + 8:
                rows = bits.a[:need].reshape(-1, s + 1)
                if not rows[:, 0].any():
                    v = np.packbits(rows[:, 1:], axis=1)[:, 0].astype(np.int32) >> (8 - s)
                    v[v < 1 << (s - 1)] -= (1 << s) - 1
                    flat[blocks, ss : se + 1] = (v << al).reshape(n, band)
                    return
        run = 0
        for b in blocks:
            if run:
                run -= 1
                continue
            k = ss
            while k <= se:
                symbol = bits.symbol(table)
                r, s = symbol >> 4, symbol & 15
                if s:
                    k += r
                    flat[b, k] = extend(bits.take(s), s) * (1 << al)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.take(r) - 1
                    break

    def _ac_more(self, bits: Bits, table: Huffman, flat, blocks, ss: int, se: int, al: int) -> None:
        step, at = 1 << al, 0

        def correct(where) -> None:
            """One more bit for each nonzero coefficient of ``flat[where]``, in order."""
            part = flat[where]
            known = part != 0
            n = int(known.sum())
            if bits.at + n > len(bits.a):
                raise ValueError("a scan breaks off")
            more = bits.a[bits.at : bits.at + n].astype(np.int32) * step
            bits.at += n
            old = part[known]
            # A bit is added once: a magnitude that has it already stays.
            part[known] = np.where(np.abs(old) & step, old, old + np.sign(old) * more)
            flat[where] = part

        while at < len(blocks):
            k = ss
            b = blocks[at]
            while k <= se:
                symbol = bits.symbol(table)
                r, s = symbol >> 4, symbol & 15
                if s == 0 and r < 15:
                    run = (1 << r) + bits.take(r)
                    correct((b, slice(k, se + 1)))
                    at += 1
                    rest = blocks[at : at + run - 1]
                    if len(rest):
                        correct((rest, slice(ss, se + 1)))
                    at += len(rest)
                    break
                new = 0
                if s:
                    new = step if bits.take(1) else -step
                while k <= se:
                    if flat[b, k]:
                        if bits.take(1) and not abs(int(flat[b, k])) & step:
                            flat[b, k] += step if flat[b, k] > 0 else -step
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if new and k <= se:
                    flat[b, k] = new
                k += 1
            else:
                at += 1


_AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]", re.S)


def read(data: bytes) -> Image:
    return Reader(data).read()


#: Blocks that are transformed at once, so that floating-point memory is bounded for images of any size.
STRIP_BLOCKS = 65_536


def _plane(blocks: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The samples of a component, by strips of block rows."""
    rows, cols, _ = blocks.shape
    out = np.empty((8 * rows, 8 * cols), dtype=np.uint8)
    step = max(1, STRIP_BLOCKS // max(1, cols))
    for r in range(0, rows, step):
        x = blocks[r : r + step].reshape(-1, 64).astype(np.float64) @ matrix
        x = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8).reshape(-1, cols, 8, 8)
        out[8 * r : 8 * (r + len(x))] = x.transpose(0, 2, 1, 3).reshape(8 * len(x), 8 * cols)
    return out


def tensor(image: Image) -> np.ndarray:
    """(height, width, 3) uint8, RGB at full resolution; one component is grey."""
    hm, vm = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    planes = []
    for c in image.components.values():
        x = _plane(c.blocks, inverse_dct() * image.quantisers[c.quantiser][:, None])
        if (vm // c.v, hm // c.h) != (1, 1):
            x = x.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(x[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2)
    out = np.empty((*planes[0].shape, 3), dtype=np.uint8)
    step = max(1, 64 * STRIP_BLOCKS // max(1, image.width))
    for r in range(0, len(out), step):
        y, cb, cr = (p[r : r + step].astype(np.float32) for p in planes[:3])
        cb -= 128
        cr -= 128
        for k, x in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            np.rint(x, out=x)
            np.clip(x, 0, 255, out=x)
            out[r : r + step, :, k] = x
    return out


def payload_of(image: Image) -> bytes:
    """The bytes that ``write`` stored."""
    size = int(image.comment.removeprefix(b"payload "))
    y, cb, cr = (image.components[k].blocks for k in (1, 2, 3))
    rows, w, _ = cb.shape
    a = np.empty((rows, w, 6, 64), dtype=np.int32)
    a[:, :, :4] = y.reshape(rows, 2, w, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, w, 4, 64)
    a[:, :, 4], a[:, :, 5] = cb, cr
    dc = a[..., 0] + 128
    a += np.where(a < 0, 255, 0).astype(np.int32)
    a[..., 0] = dc
    return a.astype(np.uint8).tobytes()[:size]


def feature_of(rgb: np.ndarray) -> str:
    """Size, and of each channel the mean and the mean square, and a histogram of 8 bins, in whole numbers."""
    flat = rgb.reshape(-1, 3)
    parts = [f"{rgb.shape[0]}x{rgb.shape[1]}"]
    level = np.arange(256, dtype=np.int64)
    for k, name in enumerate("rgb"):
        counts = np.bincount(flat[:, k], minlength=256)
        n = len(flat)
        coarse = counts.reshape(8, 32).sum(axis=1) * 10_000 // n
        parts.append(f"{name}:{int(counts @ level) * 1000 // n}:{int(counts @ level**2) * 10 // n}:{'/'.join(map(str, coarse.tolist()))}")
    return ";".join(parts)


# ---------------------------------------------------------------- columns


def payload_for(text: bytes) -> bytes:
    n = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (n - len(text))


def _stored():
    def work(ids: list, texts: list):
        for i, text in zip(ids, texts, strict=True):
            text = text or b""
            media = write(payload_for(text))
            yield i, len(text), media

    return work


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): every text as a progressive JPEG."""
    return map_rows(
        df.select(id_col, F.col(text_col).cast("binary").alias("text")), _stored, f"{id_col} {dict(df.dtypes)[id_col]}, n_bytes bigint, media binary"
    )


def _decoded():
    def work(*columns: list):
        *rest, media = columns
        for row, data in zip(zip(*rest, strict=True), media, strict=True):
            rgb = tensor(read(data)) if data is not None else None
            yield (*row, *((rgb.shape[0], rgb.shape[1], rgb.tobytes()) if rgb is not None else (None, None, None)))

    return work


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` without its media column, and height, width, rgb (bytes of the tensor, row by row)."""
    names = [c for c in df.columns if c not in (media_col, "height", "width", "rgb")]
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in names)
    return map_rows(df.select(*names, media_col), _decoded, f"{schema}, height int, width int, rgb binary")


def _featured():
    def work(ids: list, sizes: list, media: list):
        for i, n, data in zip(ids, sizes, media, strict=True):
            image = read(data)
            payload = payload_of(image)
            yield (
                i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
                hashlib.sha256(data).hexdigest(), feature_of(tensor(image)),
            )

    return work


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``store_texts`` stored, read back: payload, sizes, digests and the feature of the RGB tensor."""
    return map_rows(
        stored.select(id_col, "n_bytes", "media"),
        _featured,
        f"{id_col} {dict(stored.dtypes)[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string",
    )
