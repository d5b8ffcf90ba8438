import hashlib
import struct
import zlib

import numpy as np
import pytest

from corpusloom.llm import progressive_jpeg as J

EVERY = {8: list(range(0, 254)), 12: [254, 255]}  # a code for each symbol; none is all ones


class Pen:
    """A plain progressive encoder, coefficient by coefficient."""

    def __init__(self):
        self.bits, self.codes = [], J.codes_of(EVERY)

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(*self.codes[s])

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)


def cut(v, al):
    return (abs(v) >> al) * (1 if v > 0 else -1)


def ac_first(pen, blocks, ss, se, al):
    run = 0

    def end():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            pen.symbol(n << 4)
            pen.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(ss, se + 1):
            v = cut(int(b[k]), al)
            if v == 0:
                zeros += 1
                continue
            end()
            while zeros > 15:
                pen.symbol(0xF0)
                zeros -= 16
            pen.symbol(zeros << 4 | abs(v).bit_length())
            pen.signed(v)
            zeros = 0
        run += zeros > 0
    end()


def ac_more(pen, blocks, ss, se, al):
    run, waiting = 0, []

    def end():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            pen.symbol(n << 4)
            pen.put(run - (1 << n), n)
            pen.bits += waiting
            waiting.clear()
            run = 0

    for b in blocks:
        v = [abs(int(x)) >> al for x in b]
        last_new = max((k for k in range(ss, se + 1) if v[k] == 1), default=-1)
        zeros, known = 0, []
        for k in range(ss, se + 1):
            if v[k] == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= last_new:
                end()
                pen.symbol(0xF0)
                pen.bits += known
                known = []
                zeros -= 16
            if v[k] > 1:
                known.append(v[k] & 1)
                continue
            end()
            pen.symbol(zeros << 4 | 1)
            pen.put(int(b[k] > 0), 1)
            pen.bits += known
            known, zeros = [], 0
        if zeros or known:
            run += 1
            waiting += known
    end()


def picture(rng, height, width, factors):
    """(file, coefficients by component) of random sparse coefficients."""
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    planes = []
    for h, v in factors:
        c = rng.integers(-300, 300, (down * v, across * h, 64)) >> rng.integers(0, 9, (down * v, across * h, 64))
        c[rng.random(c.shape) < 0.7] = 0
        rows, cols = -(-height * v // (8 * vm)), -(-width * h // (8 * hm))
        c[rows:, :, 1:] = 0
        c[:, cols:, 1:] = 0
        planes.append((c, rows, cols))
    out = [b"\xff\xd8", J._segment(0xDB, b"\0" + bytes(range(1, 65)))]
    out.append(J._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(factors)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors))))
    out += [J._dht(0x00, EVERY), J._dht(0x10, EVERY)]
    ids = [(k + 1, 0) for k in range(len(factors))]

    def mcus():
        if len(factors) == 1:
            c, rows, cols = planes[0]
            yield from ((0, c[r, x]) for r in range(rows) for x in range(cols))
            return
        for r in range(down):
            for x in range(across):
                for k, (h, v) in enumerate(factors):
                    for i in range(v):
                        for j in range(h):
                            yield k, planes[k][0][r * v + i, x * h + j]

    def scan(components, ss, se, ah, al, pen):
        out.append(J._scan(components, ss, se, ah, al, np.array(pen.bits, dtype=np.uint8)))

    pen, last = Pen(), [0] * len(factors)
    for k, b in mcus():
        v = int(b[0]) >> 1
        d = v - last[k]
        last[k] = v
        pen.symbol(abs(d).bit_length())
        if d:
            pen.signed(d)
    scan(ids, 0, 0, 0, 1, pen)
    for k, (c, rows, cols) in enumerate(planes):
        blocks = c[:rows, :cols].reshape(-1, 64)
        for ss, se in ((1, 5), (6, 63)):
            ac_first(pen := Pen(), blocks, ss, se, 2)
            scan([ids[k]], ss, se, 0, 2, pen)
    pen = Pen()
    for _, b in mcus():
        pen.put(int(b[0]) & 1, 1)
    scan(ids, 0, 0, 1, 0, pen)
    for al in (1, 0):
        for k, (c, rows, cols) in enumerate(planes):
            ac_more(pen := Pen(), c[:rows, :cols].reshape(-1, 64), 1, 63, al)
            scan([ids[k]], 1, 63, al + 1, al, pen)
    return b"".join([*out, b"\xff\xd9"]), [c for c, _, _ in planes]


@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("size", [(8, 8), (21, 35), (48, 40)])
def test_reads_what_a_plain_encoder_wrote(factors, size):
    data, planes = picture(np.random.default_rng(size[0]), *size, factors)
    image = J.read(data)
    for c, want in zip(image.components.values(), planes, strict=True):
        assert (c.blocks == want).all()
    rgb = J.tensor(image)
    assert rgb.shape == (*size, 3) and rgb.dtype == np.uint8


def test_transform_and_colour():
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k, 0.5, np.sqrt(0.125))[:, None]
    rng = np.random.default_rng(1)
    block = rng.integers(-50, 50, 64)
    square = np.zeros(64)
    square[J.ZIGZAG] = block
    assert np.allclose(block @ J.inverse_dct(), (basis.T @ square.reshape(8, 8) @ basis).ravel())
    image = J.read(J.write(b"\x80" * 576))
    for c in image.components.values():
        c.blocks[...] = 0
        c.blocks[..., 0] = 8 * 20
    assert J.tensor(image)[0, 0].tolist() == [176, 127, 183]


def test_round_trips_and_both_ways_of_reading(monkeypatch):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50):
        p = rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
        data = J.write(p)
        fast = J.read(data)
        assert J.payload_of(fast) == p
        if n < 4:
            with monkeypatch.context() as m:
                J.huffman.cache_clear()
                m.setattr(J, "huffman", lambda c, s, dc: (_slow(J.Huffman(c, s)), None))
                slow = J.read(data)
            assert all((a.blocks == b.blocks).all() for a, b in zip(fast.components.values(), slow.components.values()))
    big = rng.integers(0, 256, 576 * 3000, dtype=np.uint8).tobytes()
    assert J.payload_of(J.read(J.write(big))) == big
    for bad in (b"", b"xx", data[:500], data[:-2]):
        with pytest.raises(ValueError):
            J.read(bad)


def _slow(table):
    table.fixed, table.zero = 0, None
    return table


def test_columns(spark):
    texts = {1: "héllo", 2: None, 3: "", 4: "x" * 576, 5: "x" * 577, 6: "héllo", 7: "é" * 400_000}
    df = spark.createDataFrame([(i, t, "q") for i, t in texts.items()], "doc_id long, text string, media string")
    stored = J.store_texts(df)
    got = {r.doc_id: r for r in J.media_features(stored).collect()}
    for i, t in texts.items():
        p = J.payload_for((t or "").encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(p)) and len(p) % 576 == 0 and len(p) > 0
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-32:])
    assert got[1][1:] == got[6][1:]
    rgb = J.decode_media(stored.where("doc_id = 1")).first()
    assert len(rgb.rgb) == rgb.height * rgb.width * 3
    assert J.media_features(J.store_texts(df.limit(0))).count() == 0
