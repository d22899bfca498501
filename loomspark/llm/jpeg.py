"""Progressive JPEG as a media column: scans accumulate into coefficient arrays, numpy inverts the transform, chroma is upsampled.

`decode` reads baseline and progressive Huffman files with 8-bit samples and one or three components: each scan adds its band
of coefficients (spectral selection) or one more bit of them (successive approximation) to whole coefficient arrays; after the
last scan all blocks of a component are dequantised and inverse-transformed by one matrix product, chroma is repeated to full
resolution, and the result is an RGB tensor of uint8. Sums are of whole numbers in doubles, so results do not depend on the
batch or the machine.

A scan whose Huffman table has a single code has a fixed layout; such scans are decoded for all blocks at once instead of
symbol by symbol. `store` writes such files: every 64 bytes become one 8x8 block's quantised coefficients, lossless by
construction, in a three-component 4:2:0 frame of seventeen progressive scans:

* a byte b is the coefficient b - 255 (b < 128) or b: all in one magnitude category, so that its code needs no look-ahead;
* DC: values first without their last bit, then that bit; a restart after every block keeps the prediction at zero;
* AC: two spectral bands without their last bits, then one refinement of the whole band.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Place of the k-th coefficient in its block, row by row: along the anti-diagonals, turning at each end.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
SHIFT = 1 << 13


def _cosines() -> np.ndarray:
    """The 64 x 64 inverse transform, coefficient by sample, in whole numbers."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.round(np.kron(one, one) * SHIFT)


INVERSE = _cosines()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks that hold samples
    high: int = 0
    stride: int = 0  # blocks with those that fill up the last unit
    rows: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))
    dc: int = 0


@dataclass
class Huffman:
    """Symbols by (length, code); `single` is the only symbol where there is but one."""

    codes: dict[tuple[int, int], int]
    single: tuple[int, int] | None


def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    codes, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    only = next(iter(codes)) if len(codes) == 1 else None
    return Huffman(codes, (only[0], codes[only]) if only else None)


class _Bits:
    """Bits of one entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = int.from_bytes(data), 8 * len(data), 0

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        self.at -= n
        if self.at < 0:
            raise ValueError("a scan ends early")
        return self.data >> self.at & ((1 << n) - 1)

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.codes.get((length, code))) is not None:
                return found
        raise ValueError("no such code")


def _signed(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    comment: bytes
    quantum: dict[int, np.ndarray]

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution, uint8."""
        out = []
        for c in self.components:
            scaled = (c.coefficients * self.quantum[c.table]).astype(np.float64)
            samples = np.floor(scaled @ INVERSE / SHIFT + 128.5)
            blocks = np.clip(samples, 0, 255).astype(np.uint8).reshape(c.rows, c.stride, 8, 8)
            out.append(blocks.transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8))
        return out

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor, height x width x 3."""
        most_h, most_v = max(c.h for c in self.components), max(c.v for c in self.components)
        full = []
        for c, p in zip(self.components, self.planes(), strict=True):
            full.append(p.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)[: self.height, : self.width].astype(np.int32))
        if len(full) == 1:
            return np.repeat(full[0][:, :, None], 3, 2).astype(np.uint8)
        y, cb, cr = full[0] << 16, full[1] - 128, full[2] - 128
        half = 1 << 15
        rgb = np.stack([y + 91881 * cr + half, y - 22554 * cb - 46802 * cr + half, y + 116130 * cb + half], 2) >> 16
        return np.clip(rgb, 0, 255).astype(np.uint8)


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded data from `at`, cut at restart markers and unstuffed, and where the next marker stands."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the file ends in a scan")
        kind = data[at + 1]
        if kind == 0:
            at += 2
        elif 0xD0 <= kind <= 0xD7:
            parts.append(data[start:at])
            at = start = at + 2
        else:
            parts.append(data[start:at])
            return [p.replace(b"\xff\x00", b"\xff") for p in parts], at


def decode(data: bytes) -> Image:
    """Reads a file; raises ValueError for what it cannot read."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quantum, dc, ac, restart, image, progressive, comment = 2, {}, {}, {}, 0, None, False, b""
    while True:
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9":
            raise ValueError("the file ends early")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                q = np.zeros(64, np.int64)
                q[ZIGZAG] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                quantum[body[0] & 15], body = q, body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body)
        elif kind == 0xFE:
            comment = body
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            image = Image(int.from_bytes(body[3:5]), int.from_bytes(body[1:3]), [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)], b"", quantum)
            most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
            units_x, units_y = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            for c in image.components:
                c.wide, c.high = -(-(-(-image.width * c.h // most_h)) // 8), -(-(-(-image.height * c.v // most_v)) // 8)
                c.stride, c.rows = units_x * c.h, units_y * c.v
                c.coefficients = np.zeros((c.stride * c.rows, 64), np.int32)
        elif kind == 0xDA and image:
            chosen = [(next(c for c in image.components if c.ident == body[k]), body[k + 1]) for k in range(1, 1 + 2 * body[0], 2)]
            first, last, approx = body[1 + 2 * body[0] :][:3]
            parts, at = _segments(data, at)
            scan = [(c, dc.get(t >> 4), ac.get(t & 15)) for c, t in chosen]
            if not (len(scan) == 1 and progressive and _fixed_scan(parts, *scan[0], first, last, approx >> 4, approx & 15, restart)):
                _any_scan(image, parts, scan, first, last if progressive else 63, approx >> 4, approx & 15, restart)
        elif not (0xE0 <= kind <= 0xEF):
            raise ValueError(f"marker {kind:#x} is not supported")
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _fixed_scan(parts: list[bytes], c: Component, dc: Huffman | None, ac: Huffman | None, first: int, last: int, high: int, low: int, restart: int) -> bool:
    """Decodes a one-component scan of fixed layout for all blocks at once; False if this is none."""
    if c.wide != c.stride:
        return False
    n = c.wide * c.high
    target = c.coefficients[:n]
    if first == 0 and last == 0 and high and not restart:
        target[:, 0] |= np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n).astype(np.int32) << low
        return True
    if first == 0 and last == 0 and not high and restart == 1 and dc and dc.single and len(parts) == n and dc.single[0] + dc.single[1] == 8:
        size = dc.single[1]
        bits = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
        if len(bits) != n or (bits >> size).any():
            return False
        target[:, 0] = np.where(bits >> (size - 1), bits, bits - (1 << size) + 1) << low
        return True
    if first and ac and ac.single and not restart and not high and ac.single[0] + ac.single[1] == 8 and 0 < ac.single[1] < 16:
        size, band = ac.single[1], last - first + 1
        bits = np.frombuffer(parts[0], np.uint8).astype(np.int32)
        if len(bits) != n * band or (bits >> size).any():
            return False
        target[:, ZIGZAG[first : last + 1]] = np.where(bits >> (size - 1), bits, bits - (1 << size) + 1).reshape(n, band) << low
        return True
    if first == 1 and last == 63 and ac and ac.single == (1, 0) and high and not restart:
        flat = np.frombuffer(parts[0], np.uint8)
        if len(flat) != 8 * n or not (target[:, ZIGZAG[1:]] != 0).all():
            return False
        more = np.unpackbits(flat).reshape(n, 64)
        if more[:, 0].any():
            return False
        old = target[:, ZIGZAG[1:]]
        target[:, ZIGZAG[1:]] = old + np.sign(old) * (more[:, 1:].astype(np.int32) << low)
        return True
    return False


def _any_scan(image: Image, parts: list[bytes], scan: list, first: int, last: int, high: int, low: int, restart: int) -> None:
    """Decodes any scan symbol by symbol."""
    if len(scan) == 1:
        c = scan[0][0]
        units = [[(0, y * c.stride + x)] for y in range(c.high) for x in range(c.wide)]
    else:
        c = scan[0][0]
        across, down = c.stride // c.h, c.rows // c.v
        units = [[(k, (uy * c.v + y) * c.stride + ux * c.h + x) for k, (c, _, _) in enumerate(scan) for y in range(c.v) for x in range(c.h)] for uy in range(down) for ux in range(across)]
    bits, run = None, 0
    for n, unit in enumerate(units):
        if n == 0 or restart and n % restart == 0:
            bits, run = _Bits(parts[n // restart if restart else 0]), 0
            for c, _, _ in scan:
                c.dc = 0
        for k, block in unit:
            c, dc, ac = scan[k]
            out, at = c.coefficients[block], first
            if at == 0:
                if high:
                    out[0] |= bits.take(1) << low
                else:
                    size = bits.symbol(dc)
                    c.dc += _signed(bits.take(size), size)
                    out[0] = c.dc << low
                at = 1
            if last == 0:
                continue
            if high:
                run = _refine(out, bits, ac, at, last, 1 << low, run)
                continue
            if run:
                run -= 1
                continue
            while at <= last:
                skip, size = divmod(bits.symbol(ac), 16)
                if size == 0 and skip < 15:
                    run = (1 << skip) + bits.take(skip) - 1
                    break
                at += skip
                if size:
                    out[ZIGZAG[at]] = _signed(bits.take(size), size) << low if size else 0
                at += 1


def _refine(out: np.ndarray, bits: _Bits, ac: Huffman, at: int, last: int, unit: int, run: int) -> int:
    """One more bit of the coefficients at..last of a block; returns how many further blocks bring no new coefficient."""

    def correct(p: int) -> None:
        if bits.take(1) and not abs(int(out[p])) & unit:
            out[p] += unit if out[p] > 0 else -unit

    if not run:
        while at <= last:
            skip, size = divmod(bits.symbol(ac), 16)
            if size == 0 and skip < 15:
                run = (1 << skip) + bits.take(skip)
                break
            value = (unit if bits.take(1) else -unit) if size else 0
            while at <= last:
                p = ZIGZAG[at]
                at += 1
                if out[p]:
                    correct(p)
                elif skip:
                    skip -= 1
                else:
                    out[p] = value
                    break
        if not run:
            return 0
    for k in range(at, last + 1):
        if out[ZIGZAG[k]]:
            correct(ZIGZAG[k])
    return run - 1


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2) + body


def _stuffed(x: np.ndarray) -> bytes:
    return x.tobytes().replace(b"\xff", b"\xff\x00")


def _one_code(kind: int, length: int, symbol: int) -> bytes:
    return _marker(0xC4, bytes([kind]) + bytes(1 if k == length else 0 for k in range(1, 17)) + bytes([symbol]))


_RESTARTS = np.array([[0xFF, 0xD0 + k] for k in range(8)], np.uint8)
UNIT_BLOCKS = 6  # four of luminance and one each of two chroma components


def store(payload: bytes) -> bytes:
    """A progressive 4:2:0 file whose coefficients are the payload, which is a positive multiple of 64 bytes long."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    n = len(payload) // 64
    units = -(-n // UNIT_BLOCKS)
    across = -(-units // 4000)
    down = -(-units // across)
    blocks = np.zeros((across * down * UNIT_BLOCKS, 64), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    sizes = [(1, 2, 2, 4 * across * down), (2, 1, 1, across * down), (3, 1, 1, across * down)]
    out = [b"\xff\xd8", _marker(0xFE, len(payload).to_bytes(8)), _marker(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_marker(0xC2, b"\x08" + (16 * down).to_bytes(2) + (16 * across).to_bytes(2) + b"\x03" + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v, _ in sizes)))
    scan = lambda i, first, last, approx: _marker(0xDA, bytes([1, i, 0, first, last, approx]))
    scans: list[bytes] = []
    at = 0
    own = []
    for i, _, _, k in sizes:
        own.append((i, blocks[at : at + k]))
        at += k
    # Values in one category need their upper seven bits (a one-bit code before them) and then their last bit.
    scans += [_one_code(0x00, 1, 7), _one_code(0x10, 1, 7), _marker(0xDD, b"\x00\x01")]
    for i, b in own:
        with_marks = np.hstack([b[:, :1] >> 1, _RESTARTS[np.arange(len(b)) % 8]]).tobytes()
        scans += [scan(i, 0, 0, 0x01), with_marks[:-2]]
    scans.append(_marker(0xDD, b"\x00\x00"))
    for i, b in own:
        scans += [scan(i, 0, 0, 0x10), _stuffed(np.packbits(b[:, 0] & 1))]
        scans += [scan(i, 1, 5, 0x01), (b[:, 1:6] >> 1).tobytes(), scan(i, 6, 63, 0x01), (b[:, 6:] >> 1).tobytes()]
    scans.append(_one_code(0x10, 1, 0))
    for i, b in own:
        last = (b & 1) ^ (b < 128)
        last[:, 0] = 0
        scans += [scan(i, 1, 63, 0x10), _stuffed(np.packbits(last, axis=1))]
    return b"".join([*out, *scans, b"\xff\xd9"])


def load(image: Image) -> bytes:
    """The payload of a stored file, from its decoded coefficients."""
    c = np.concatenate([x.coefficients[:, ZIGZAG] for x in image.components])
    out = np.where(c > 0, c, c + 255).astype(np.uint8)
    # The DC value is twice its upper part plus the last bit, so that its refinement is that bit itself.
    high = c[:, 0] >> 1
    out[:, 0] = (np.where(high > 0, high, high + 127) << 1 | c[:, 0] & 1).astype(np.uint8)
    return out.tobytes()[: int.from_bytes(image.comment)]


def describe(rgb: np.ndarray) -> str:
    """Size, means and standard deviations of the channels, and the mean step between neighbouring luminances."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    n, s, q = len(flat), flat.sum(0), (flat * flat).sum(0)
    mean = s / n
    deviation = np.sqrt(np.maximum(q / n - mean * mean, 0))
    g = rgb[:, :, 1].astype(np.int32)
    steps = [np.abs(np.diff(g, axis=k)).sum() / max(g.size, 1) for k in (0, 1)]
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ";".join(f"{v:.4f}" for v in (*mean, *deviation, *steps))
