import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from placemill.llm import media, progressive
from placemill.llm.progressive import ZIGZAG, Decoder, huffman, stored, write
from tests.llm.helpers import documents, empty, odd


@pytest.mark.parametrize("n", [64, 128, 384, 448, 6400, 64 * 700])
def test_lossless(n):
    payload = random.Random(n).randbytes(n)
    d = Decoder(write(payload, b"hello"))
    assert stored(d, n) == payload and d.comment == b"hello" and d.scans == 9
    assert d.rgb().shape == (d.height, d.width, 3)


def test_many_ended_blocks():
    """More luma blocks than one run of ended blocks holds."""
    payload = bytes(range(256)) * (64 * 50_000 // 256)
    assert stored(Decoder(write(payload)), len(payload)) == payload


class Writer:
    """A plain encoder of any coefficients by any scans, symbol by symbol: the format's rules, for tests."""

    def __init__(self):
        counts, symbols = bytes([0] * 7 + [255] + [1] + [0] * 7), bytes(range(256))
        self.counts, self.symbols = counts, symbols
        self.codes = huffman(counts, symbols).codes
        self.bits = ""

    def symbol(self, s):
        code, n = self.codes[s]
        self.bits += format(code, f"0{n}b")

    def put(self, v, n):
        self.bits += format(v, f"0{n}b") if n else ""

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    def run_of_ended(self, n, corrections):
        if n:
            size = n.bit_length() - 1
            self.symbol(size << 4)
            self.put(n - (1 << size), size)
            self.bits += corrections

    def ac_first(self, blocks, first, last, low):
        ended = 0
        for b in blocks:
            values = [int(np.sign(b[k])) * (abs(int(b[k])) >> low) for k in range(first, last + 1)]
            at = [k for k, v in enumerate(values) if v]
            before = -1
            if at:
                self.run_of_ended(ended, "")
                ended = 0
            for k in at:
                run = k - before - 1
                while run > 15:
                    self.symbol(0xF0)
                    run -= 16
                self.symbol(run << 4 | abs(values[k]).bit_length())
                self.signed(values[k])
                before = k
            if before != len(values) - 1:
                ended += 1
                if ended == 32767:
                    self.run_of_ended(ended, "")
                    ended = 0
        self.run_of_ended(ended, "")

    def ac_refine(self, blocks, first, last, low):
        ended, kept = 0, ""
        for b in blocks:
            full = [abs(int(b[k])) >> low for k in range(first, last + 1)]
            new = [k for k, v in enumerate(full) if v == 1]
            stop = new[-1] if new else -1
            pending, run = "", 0
            for k in range(stop + 1):
                if full[k] == 0:
                    run += 1
                    continue
                # zeros before this coefficient beyond 15 need their own symbols, with the corrections met so far
                while run > 15:
                    self.run_of_ended(ended, kept)
                    ended, kept = 0, ""
                    self.symbol(0xF0)
                    taken, seen, j = 0, "", self.start
                    while taken < 16:
                        if full[j] == 0:
                            taken += 1
                        elif full[j] > 1:
                            seen += str(full[j] & 1)
                        j += 1
                    self.bits += seen
                    pending = pending[len(seen) :]
                    self.start = j
                    run -= 16
                if full[k] > 1:
                    pending += str(full[k] & 1)
                else:
                    self.run_of_ended(ended, kept)
                    ended, kept = 0, ""
                    self.symbol(run << 4 | 1)
                    self.put(int(b[first + k] > 0), 1)
                    self.bits += pending
                    pending, run = "", 0
                    self.start = k + 1
            rest = "".join(str(v & 1) for v in full[stop + 1 :] if v > 1)
            if stop + 1 < len(full):
                ended += 1
                kept += rest
            self.start = 0
        self.run_of_ended(ended, kept)

    start = 0


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(coefficients, width, height, factors, script, restart=0):
    """A file of the coefficient arrays (blocks in raster order, padded to whole MCUs)."""
    w = Writer()
    n = len(coefficients)
    frame = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    out = b"\xff\xd8" + segment(0xDB, b"\x00" + bytes(range(1, 65))) + segment(0xC2, frame)
    out += segment(0xC4, b"\x00" + w.counts + w.symbols) + segment(0xC4, b"\x10" + w.counts + w.symbols)
    if restart:
        out += segment(0xDD, struct.pack(">H", restart))
    probe = Decoder.__new__(Decoder)
    probe.components = []
    probe._frame(frame)
    for comps, first, last, high, low in script:
        body = bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([first, last, high << 4 | low])
        out += segment(0xDA, body)
        if len(comps) > 1:
            of, blocks = progressive._interleaved(-(-width // (8 * probe.hmax)), -(-height // (8 * probe.vmax)), tuple(factors[c] for c in comps))
            unit = sum(h * v for h, v in (factors[c] for c in comps))
        else:
            blocks = probe.components[comps[0]].raster()
            of, unit = np.zeros(len(blocks), int), 1
        step = restart * unit or len(blocks)
        for k, at in enumerate(range(0, len(blocks), step)):
            if k:
                out += bytes([0xFF, 0xD0 + (k - 1) % 8])
            some = list(zip(of[at : at + step], blocks[at : at + step], strict=True))
            if first == 0:
                before = [0] * n
                for c, b in some:
                    value = int(coefficients[comps[c]][b, 0]) >> low
                    if high:
                        w.put(value & 1, 1)
                    else:
                        diff = value - before[c]
                        before[c] = value
                        w.symbol(abs(diff).bit_length())
                        if diff:
                            w.signed(diff)
            else:
                own = [coefficients[comps[0]][b] for _, b in some]
                (w.ac_refine if high else w.ac_first)(own, first, last, low)
            out += w.data()
    return out + b"\xff\xd9"


def sparse(rng, blocks, density):
    out = np.zeros((blocks, 64), np.int64)
    mask = rng.random((blocks, 64)) < density
    out[mask] = rng.integers(-60, 61, mask.sum())
    out[:, 0] = rng.integers(-200, 200, blocks)
    return out


SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 2), ((0,), 1, 5, 0, 2), ((2,), 1, 63, 0, 1), ((1,), 1, 63, 0, 1), ((0,), 6, 63, 0, 2), ((0, 1, 2), 0, 0, 2, 1),
    ((0,), 1, 63, 2, 1), ((0, 1, 2), 0, 0, 1, 0), ((2,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0),
]


@pytest.mark.parametrize("density", [0.0, 0.03, 0.3, 0.9])
@pytest.mark.parametrize("restart", [0, 2])
@pytest.mark.parametrize("factors", [[(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
def test_any_scans(density, restart, factors):
    rng = np.random.default_rng(int(density * 100) + restart)
    width, height = 41, 27
    hmax, vmax = factors[0]
    mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    coefficients = [sparse(rng, mx * h * my * v, density) for h, v in factors]
    d = Decoder(jpeg(coefficients, width, height, factors, SCRIPT, restart))
    for c, want in zip(d.components, coefficients, strict=True):
        shown = c.raster()
        assert (c.coefficients[:, 0] == want[:, 0]).all()
        assert (c.coefficients[shown] == want[shown]).all()
    assert d.rgb().shape == (height, width, 3)


def test_inverse_transform_and_colour():
    rng = np.random.default_rng(3)
    coefficients = [sparse(rng, 4, 0.2), sparse(rng, 1, 0.2), sparse(rng, 1, 0.2)]
    d = Decoder(jpeg(coefficients, 16, 16, [(2, 2), (1, 1), (1, 1)], SCRIPT))
    basis = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    quantiser = np.arange(1, 65)

    def block(z):
        square = np.zeros(64)
        square[ZIGZAG] = z * quantiser
        return basis.T @ square.reshape(8, 8) @ basis + 128

    y = np.block([[block(coefficients[0][0]), block(coefficients[0][1])], [block(coefficients[0][2]), block(coefficients[0][3])]])
    cb, cr = (np.kron(block(c[0]), np.ones((2, 2))) - 128 for c in coefficients[1:])
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    assert np.abs(d.rgb().astype(float) - np.clip(want, 0, 255)).max() <= 0.51


def test_zigzag():
    assert ZIGZAG[:12].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25] and sorted(ZIGZAG) == list(range(64))


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x10\x00\x10\x01\x01\x11\x00\xff\xd9", write(bytes(640))[:700] + b"\xff\xd9"])
def test_broken_files_raise(data):
    with pytest.raises((ValueError, KeyError)):
        Decoder(data)


def test_query_rows(spark):
    df = odd(spark)
    coded = media.encode(df)
    found = media.decode(coded).collect()
    assert len(found) == df.count()
    files = {}
    for r in coded.collect():
        files.setdefault(r.doc_id, bytes(r.media))
    by_text = {}
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(files[r.doc_id]).hexdigest() and r.media_bytes == len(files[r.doc_id])
        assert by_text.setdefault(raw, r[1:]) == r[1:]


def test_tensors(spark):
    df = documents(spark, [(1, "hello " * 300)])
    r = media.decode(media.encode(df), tensors=True).first()
    assert len(r.rgb) == 3 * r.height * r.width and r.feature == media.feature_of(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3))


def test_empty_table(spark):
    assert media.decode(media.encode(empty(spark))).count() == 0
