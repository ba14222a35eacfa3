"""Progressive JPEG in numpy: scans accumulate into coefficient arrays, which become full-resolution RGB.

The decoder reads any 8-bit Huffman-coded progressive file: spectral selection and successive approximation in any order,
interleaved DC scans, runs of ended blocks, restart markers, any sampling factors. Symbols are read one at a time, but what is
regular is taken at once: correction bits of runs of ended blocks, bits of DC refinements, and stretches of whole blocks coded
by one symbol without zero runs.

The writer stores bytes losslessly as quantised coefficients, one byte each, 64 a block. All of them lie in 256..511, so each is
non-zero in the first scans, and the later ones need no symbols but the ends of blocks.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: Fixed by the format: position in an 8 x 8 block (row times 8 plus column) of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_MARKER = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
#: Values are split between first scans and one refinement of the lowest bit.
LOW = 1
BASE = 256


@lru_cache(maxsize=1)
def inverse_matrix() -> np.ndarray:
    """Pixels of a block (64) from its coefficients in zigzag order: one product does the two-dimensional inverse DCT."""
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


class _Huffman:
    """Symbol and code length of every 16-bit window; and codes for writing."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        self.codes: dict[int, tuple[int, int]] = {}
        code, k = 0, 0
        for bits, n in enumerate(counts, 1):
            for _ in range(n):
                low, span = code << (16 - bits), 1 << (16 - bits)
                self.symbol[low : low + span], self.length[low : low + span] = symbols[k], bits
                self.codes[symbols[k]] = (code, bits)
                code, k = code + 1, k + 1
            code <<= 1
        self.table = list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))


@lru_cache(maxsize=256)
def huffman(counts: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(counts, symbols)


class Bits:
    """Entropy-coded data of one restart interval."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\x00", b"\xff")
        self.size = 8 * len(raw)
        self.raw = raw + b"\xff" * 8
        self.at = 0
        self._bits: np.ndarray | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.raw, np.uint8))
        return self._bits

    def symbol(self, table: _Huffman) -> int:
        byte = self.at >> 3
        window = int.from_bytes(self.raw[byte : byte + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF
        symbol, length = table.table[window]
        self.at += length
        if not length or self.at > self.size + 7:
            raise ValueError("bad code in a scan")
        return symbol

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte = self.at >> 3
        value = int.from_bytes(self.raw[byte : byte + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return value

    def many(self, n: int) -> np.ndarray:
        if self.at + n > self.size:
            raise ValueError("a scan is cut short")
        out = self.bits[self.at : self.at + n]
        self.at += n
        return out


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table

    def shape(self, width: int, height: int, hmax: int, vmax: int) -> None:
        mcus_x, mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.across, self.down = mcus_x * self.h, mcus_y * self.v
        self.own_across, self.own_down = -(-(-(-width * self.h // hmax)) // 8), -(-(-(-height * self.v // vmax)) // 8)
        self.coefficients = np.zeros((self.across * self.down, 64), np.int32)

    def raster(self) -> np.ndarray:
        """Blocks in the order of a scan of this component alone."""
        return _raster(self.across, self.own_across, self.own_down)


@lru_cache(maxsize=512)
def _raster(across: int, own_across: int, own_down: int) -> np.ndarray:
    return (np.arange(own_down)[:, None] * across + np.arange(own_across)).ravel()


@lru_cache(maxsize=512)
def _interleaved(mcus_x: int, mcus_y: int, factors: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Component and block of each step of an interleaved scan."""
    y, x = (a.ravel() for a in np.mgrid[:mcus_y, :mcus_x])
    comps, blocks = [], []
    for c, (h, v) in enumerate(factors):
        for j in range(v):
            for i in range(h):
                comps.append(np.full(len(y), c))
                blocks.append((y * v + j) * (mcus_x * h) + x * h + i)
    return np.stack(comps, axis=1).ravel(), np.stack(blocks, axis=1).ravel()


class Decoder:
    def __init__(self, data: bytes):
        self.quantisers: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], _Huffman] = {}
        self.components: list[Component] = []
        self.comment, self.restart, self.scans = b"", 0, 0
        self.width = self.height = 0
        self._read(data)

    def _read(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            m = _MARKER.search(data, at)
            if m is None:
                raise ValueError("the file has no end")
            marker, at = data[m.end() - 1], m.end()
            if marker == 0xD9:
                return
            size = struct.unpack(">H", data[at : at + 2])[0]
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = huffman(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                end = _MARKER.search(data, at)
                stop = end.start() if end else len(data)
                self._scan(body, data[at:stop])
                at = stop
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError(f"frame type {marker:#x} is not Huffman-coded progressive")

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 129 if wide else 65
            self.quantisers[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.float32)
            body = body[n:]

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or n not in (1, 3):
            raise ValueError("only 8-bit grey and YCbCr files are read")
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        for c in self.components:
            c.shape(self.width, self.height, self.hmax, self.vmax)

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = [(next(c for c in self.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        comps = [c for c, _ in chosen]
        if n > 1:
            if first:
                raise ValueError("an AC scan has one component")
            of, blocks = _interleaved(-(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax)), tuple((c.h, c.v) for c in comps))
            unit = sum(c.h * c.v for c in comps)
        else:
            blocks = comps[0].raster()
            of, unit = np.zeros(len(blocks), np.int64), 1
        step = self.restart * unit or len(blocks) or 1
        parts = _RESTART.split(data) if self.restart else [data]
        for k, part in enumerate(parts[: -(-len(blocks) // step)]):
            bits, some = Bits(part), slice(k * step, (k + 1) * step)
            if first == 0:
                if high:
                    self._dc_refine(comps, of[some], blocks[some], bits, low)
                else:
                    self._dc_first(comps, [self.tables[0, t >> 4] for _, t in chosen], of[some], blocks[some], bits, low)
            elif high:
                self._ac_refine(comps[0].coefficients, blocks[some], first, last, low, bits, self.tables[1, chosen[0][1] & 15])
            else:
                self._ac_first(comps[0].coefficients, blocks[some], first, last, low, bits, self.tables[1, chosen[0][1] & 15])
        self.scans += 1

    @staticmethod
    def _dc_first(comps: list[Component], tables: list[_Huffman], of: np.ndarray, blocks: np.ndarray, bits: Bits, low: int) -> None:
        values, before = [], [0] * len(comps)
        for c in of.tolist():
            size = bits.symbol(tables[c])
            before[c] += _signed(bits.take(size), size)
            values.append(before[c])
        got = np.array(values, np.int64) << low
        for c, comp in enumerate(comps):
            comp.coefficients[blocks[of == c], 0] = got[of == c]

    @staticmethod
    def _dc_refine(comps: list[Component], of: np.ndarray, blocks: np.ndarray, bits: Bits, low: int) -> None:
        got = bits.many(len(blocks)).astype(np.int32) << low
        for c, comp in enumerate(comps):
            comp.coefficients[blocks[of == c], 0] |= got[of == c]

    @staticmethod
    def _ac_first(out: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, bits: Bits, table: _Huffman) -> None:
        band, i, ended = last - first + 1, 0, 0
        while i < len(blocks):
            if ended:
                skip = min(ended, len(blocks) - i)
                i, ended = i + skip, ended - skip
                continue
            taken = _whole_blocks(out, blocks[i:], first, band, low, bits, table)
            if taken:
                i += taken
                continue
            k = first
            while k <= last:
                symbol = bits.symbol(table)
                run, size = symbol >> 4, symbol & 15
                if size:
                    k += run
                    if k > last:
                        raise ValueError("a run leaves its band")
                    out[blocks[i], k] = _signed(bits.take(size), size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    ended = (1 << run) - 1 + bits.take(run)
                    break
            i += 1

    @staticmethod
    def _ac_refine(out: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, bits: Bits, table: _Huffman) -> None:
        one, i, ended = 1 << low, 0, 0

        def correct(rows: np.ndarray | slice, columns: np.ndarray | slice) -> None:
            """One bit for each coefficient of known sign, in order; it adds to the magnitude."""
            part = out[rows, columns]
            known = part != 0
            n = int(known.sum())
            if n:
                got = bits.many(n).astype(np.int32) * one
                part[known] += np.where(part[known] > 0, got, -got)
                out[rows, columns] = part

        while i < len(blocks):
            if ended:
                skip = min(ended, len(blocks) - i)
                correct(blocks[i : i + skip], slice(first, last + 1))
                i, ended = i + skip, ended - skip
                continue
            b, k = blocks[i], first
            while k <= last:
                symbol = bits.symbol(table)
                run, size = symbol >> 4, symbol & 15
                if not size and run < 15:
                    ended = (1 << run) - 1 + bits.take(run)
                    correct(np.array([b]), slice(k, last + 1))
                    break
                value = (one if bits.take(1) else -one) if size else 0
                while k <= last:
                    if out[b, k]:
                        if bits.take(1):
                            out[b, k] += one if out[b, k] > 0 else -one
                    elif run:
                        run -= 1
                    else:
                        out[b, k] = value
                        k += 1
                        break
                    k += 1
            i += 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution, level-shifted, as floats."""
        out = []
        for c in self.components:
            pixels = (c.coefficients.astype(np.float32) * self.quantisers[c.table]) @ inverse_matrix() + np.float32(128)
            out.append(pixels.reshape(c.down, c.across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.down, 8 * c.across))
        return out

    def rgb(self) -> np.ndarray:
        """Height x width x 3 bytes; chroma is repeated up to full resolution."""
        y, *chroma = [np.repeat(np.repeat(p, self.vmax // c.v, axis=0), self.hmax // c.h, axis=1)[: self.height, : self.width] for p, c in zip(self.planes(), self.components, strict=True)]
        out = np.empty((self.height, self.width, 3), np.uint8)
        cb, cr = (p - np.float32(128) for p in chroma) if chroma else (np.float32(0), np.float32(0))
        for i, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[..., i] = np.clip(np.rint(channel), 0, 255)
        return out


def _whole_blocks(out: np.ndarray, blocks: np.ndarray, first: int, band: int, low: int, bits: Bits, table: _Huffman) -> int:
    """Blocks taken at once because one symbol without a zero run codes all their coefficients; 0 if the next block isn't such."""
    if band * len(blocks) < 16:
        return 0
    start = bits.at
    symbol = bits.symbol(table)
    length, size = bits.at - start, symbol & 15
    bits.at = start
    if symbol >> 4 or not size:
        return 0
    stride = length + size
    n = min(len(blocks) * band, (bits.size - start) // stride)
    rows = bits.bits[start : start + n * stride].reshape(n, stride)
    same = (rows[:, :length] == rows[0, :length]).all(axis=1)
    n = (n if same.all() else int(np.argmin(same))) // band * band
    if not n:
        return 0
    if size == 8:
        value = np.packbits(rows[:n, length:], axis=1).ravel().astype(np.int32)
    else:
        value = rows[:n, length:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
    value = np.where(value >> (size - 1), value, value - (1 << size) + 1) * (1 << low)
    out[blocks[: n // band], first : first + band] = value.reshape(-1, band)
    bits.at += n * stride
    return n // band


# Writing

_DC = huffman(bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
_AC_SYMBOLS = bytes([8, *(n << 4 for n in range(15))])
_AC = huffman(bytes([1, 0, 0, 0, 15] + [0] * 11), _AC_SYMBOLS)
_MAX_ENDED = (1 << 15) - 1


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    + _segment(0xC4, b"\x10" + bytes([1, 0, 0, 0, 15] + [0] * 11) + _AC_SYMBOLS)
)


def _packed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    if pad:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def put(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lowest ``lengths`` bits of each value, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    left = np.repeat(ends, lengths) - np.arange(total) - 1
    return (np.repeat(values, lengths) >> left & 1).astype(np.uint8)


def _scan(comps: bytes, first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    body = bytes([len(comps)]) + b"".join(bytes([c, 0]) for c in comps) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, body) + _packed(bits)


def _dc_first(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    diff = np.empty_like(values)
    for c in range(3):
        own = values[of == c]
        diff[of == c] = np.diff(own, prepend=0)
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(np.int64) + 1)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return put(size << size | extra, 4 + size)  # four-bit codes are the sizes themselves


def _refined(bits: np.ndarray) -> np.ndarray:
    """Correction bits of blocks (rows) in runs of ended blocks."""
    out = []
    for at in range(0, len(bits), _MAX_ENDED):
        n = min(_MAX_ENDED, len(bits) - at)
        size = n.bit_length() - 1
        code, length = _AC.codes[size << 4]
        out += [put(np.array([code << size | n - (1 << size)]), np.array([length + size])), bits[at : at + n].ravel()]
    return np.concatenate(out)


def write(payload: bytes, comment: bytes = b"") -> bytes:
    """A progressive 4:2:0 file whose quantised coefficients, in block order Y, Cb, Cr, are the payload's bytes plus BASE."""
    if len(payload) % 64 or not payload:
        raise ValueError("the payload is a positive multiple of 64 bytes")
    mcus = -(-len(payload) // 384)
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    if across > 4095:
        raise ValueError("the payload is larger than one image holds")
    n = across * down
    values = np.zeros(384 * n, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values.reshape(6 * n, 64)
    planes = [values[: 4 * n], values[4 * n : 5 * n], values[5 * n :]]
    of, blocks = _interleaved(across, down, ((2, 2), (1, 1), (1, 1)))
    dc = np.empty(len(of), np.int64)
    for c, p in enumerate(planes):
        dc[of == c] = p[blocks[of == c], 0].astype(np.int64) + BASE
    # the top eight bits of each nine go into the first scans: 128 + value / 2, always eight bits long
    top = [np.unpackbits((p >> LOW) + np.uint8(128), axis=1).reshape(len(p), 64, 8) for p in planes]

    def first_bits(c: int, first: int, last: int) -> np.ndarray:
        rows = np.zeros((len(planes[c]), last - first + 1, 9), np.uint8)  # the one-bit code of size 8 is 0
        rows[:, :, 1:] = top[c][:, first : last + 1]
        return rows.ravel()

    out = [b"\xff\xd8", _segment(0xFE, comment) if comment else b"", _TABLES, _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")]
    out.append(_scan(b"\x01\x02\x03", 0, 0, 0, LOW, _dc_first(dc >> LOW, of)))
    out += [_scan(bytes([c + 1]), a, b, 0, LOW, first_bits(c, a, b)) for c, a, b in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63))]
    out.append(_scan(b"\x01\x02\x03", 0, 0, LOW, 0, (dc & 1).astype(np.uint8)))
    out += [_scan(bytes([c + 1]), 1, 63, LOW, 0, _refined(planes[c][:, 1:] & 1)) for c in (1, 2, 0)]
    return b"".join([*out, b"\xff\xd9"])


def stored(decoder: Decoder, size: int) -> bytes:
    """The payload that ``write`` stored."""
    values = np.concatenate([c.coefficients for c in decoder.components]) - BASE
    return values.astype(np.uint8).tobytes()[:size]
