"""Media columns: bytes kept as lossless WebP images (VP8L), and a decoder of the lossless format.

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes, and undoes the
predictor, cross-colour, subtract-green and palette transforms, of files that have one VP8L chunk (the extended container is
no lossless format of its own and is refused). Images of a column whose pixels are one prefix code and back-references are
decoded side by side: step k decodes the k-th symbol of each of them. The encoder writes grey images with prefix codes of up to
LONGEST bits, back-references where they pay, and palettes for few values.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Samples in a row of a stored payload, and rows of an image (the format allows 16384): longer payloads are several files.
WIDTH, ROWS = 64, 256
#: Bits of a code that the encoder writes; samples worked on at once; images that are worth being decoded side by
#: side, and symbols after which their ends are looked at.
LONGEST, SAMPLES_AT_ONCE, ABREAST, CHECKED = 11, 2 << 20, 12, 64
#: A back-reference copies so many samples at least and at most; one place in ANCHORS is looked up.
MATCH, MOST, ANCHORS = 24, 4096, 16
_ALPHABETS = (256 + 24, 256, 256, 256, 40)  # green and lengths, red, blue, alpha, distances
# Fixed by the format: the order in which lengths of the code length code are written.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_PREDICTOR, _CROSS, _GREEN, _PALETTE = range(4)
_U = np.uint64


@lru_cache(1)
def _near() -> list[tuple[int, int]]:
    """Places (left, up) of the 120 short distance codes: by distance, then by columns, left before right."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self) -> int:
        """56 bits at least from here on; zeros beyond the end."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the image ends early")
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value


@lru_cache(16)
def _mirror(n: int) -> np.ndarray:
    """The numbers below 2 ** n with their n bits in reverse order."""
    i, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
    for k in range(n):
        out |= (i >> k & 1) << (n - 1 - k)
    return out


class _Code:
    """A prefix code from the lengths of its symbols: a table from the next `longest` bits to symbol << 4 | length."""

    def __init__(self, lengths: tuple[int, ...]):
        sizes = np.array(lengths, np.int64)
        used = np.flatnonzero(sizes)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        self.longest = int(sizes.max()) if self.only is None else 0
        used = used[np.argsort(sizes[used], kind="stable")]
        size = sizes[used] if self.only is None else np.zeros(1, np.int64)
        share = 1 << (self.longest - size)
        if share.sum() != 1 << self.longest:
            raise ValueError("a prefix code is not complete")
        self.array = np.repeat(used << 4 | size, share)[_mirror(self.longest)]
        self.table = None

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = self.array.tolist()
        entry = self.table[bits.peek() & ((1 << self.longest) - 1)]
        bits.at += entry & 15
        if bits.at > bits.size:
            raise ValueError("the image ends early")
        return entry >> 4


@lru_cache(512)
def _code(lengths: tuple[int, ...]) -> _Code:
    return _Code(lengths)


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    lengths = [0] * alphabet
    if bits.read(1):  # one or two symbols, plainly
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= alphabet:
                raise ValueError("a symbol beyond the alphabet")
            lengths[s] = 1
        return _code(tuple(lengths))
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[_LENGTH_ORDER[k]] = bits.read(3)
    code = _code(tuple(own))
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and tokens:
        tokens -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
            continue
        n, value = {16: (3, 2), 17: (3, 3), 18: (11, 7)}[s]
        n += bits.read(value)
        if at + n > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        lengths[at : at + n] = [before if s == 16 else 0] * n
        at += n
    return _code(tuple(lengths))


def _prefixed(symbol: int, bits: _Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _parts(size: int, shift: int) -> int:
    return -(-size // (1 << shift))


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values, a row of the image after another, as uint32."""
    return _read_pixels(bits, width, height, *_read_codes(bits, width, height, main))


def _read_codes(bits: _Bits, width: int, height: int, main: bool) -> tuple[list[list[_Code]], int, list[int] | None, int]:
    """Groups of codes, bits of the colour cache, the group of each block (None: there is one), and the size of blocks."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("a colour cache of a size that is not allowed")
    groups, shift, of = 1, 0, None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        of = (_read_image(bits, _parts(width, shift), _parts(height, shift), False) >> 8) & 0xFFFF
        groups, of = int(of.max()) + 1, of.tolist()
    sizes = (_ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), *_ALPHABETS[1:])
    return [[_read_code(bits, n) for n in sizes] for _ in range(groups)], cache_bits, of, shift


def _read_pixels(
    bits: _Bits, width: int, height: int, codes: list[list[_Code]], cache_bits: int, of: list[int] | None, shift: int
) -> np.ndarray:
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    cached, at, across = 0, 0, _parts(width, shift)
    while at < total:
        if of is None:
            green, red, blue, alpha, far = codes[0]
        else:
            green, red, blue, alpha, far = codes[of[(at // width >> shift) * across + (at % width >> shift)]]
        s = green.read(bits)
        if s < 256:
            out[at] = red.read(bits) << 16 | s << 8 | blue.read(bits) | alpha.read(bits) << 24
            at += 1
        elif s < 280:
            n = _prefixed(s - 256, bits)
            d = _prefixed(far.read(bits), bits)
            if d > 120:
                d -= 120
            else:
                x, y = _near()[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
            at += n
        else:
            while cached < at:
                cache[0x1E35A7BD * out[cached] % 2**32 >> 32 - cache_bits] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
        if cache is not None and s < 280:
            while cached < at:
                cache[0x1E35A7BD * out[cached] % 2**32 >> 32 - cache_bits] = out[cached]
                cached += 1
    return np.array(out, np.uint32)


#: An image whose pixels come next: the data, the bit at which they begin, its width, how many they are, and its codes.
Stream = tuple[bytes, int, int, int, list[_Code]]


def _abreast(streams: list[Stream]) -> list[np.ndarray]:
    """The green values of images without colour cache, whose codes for red, blue and alpha have one symbol. All images go on
    by a symbol at a time; those without back-references, in which all symbols are pixels, apart from the others."""
    out: list[np.ndarray] = [None] * len(streams)
    copies = [bool((x[4][0].array >> 4 >= 256).any()) for x in streams]
    for decode, kind in ((_literals, False), (_with_copies, True)):
        which = sorted((i for i, c in enumerate(copies) if c == kind), key=lambda i: -streams[i][3])
        if which:
            for i, values in zip(which, decode([streams[i] for i in which]), strict=True):
                out[i] = values
    return out


def _words(streams: list[Stream]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All data: the 64 bits from each byte on, and for each image the bit at which its pixels begin and its end."""
    sizes = np.array([len(x[0]) for x in streams], np.int64)
    begin = np.cumsum(sizes) - sizes
    # Ends are looked at every CHECKED symbols, none of which takes more than 64 bits.
    data = np.frombuffer(b"".join([*(x[0] for x in streams), b"\0" * 8 * (CHECKED + 2)]), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<i8").ravel()
    return words, 8 * begin + np.array([x[1] for x in streams]), 8 * (begin + sizes)


def _tables(streams: list[Stream], which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tables of that code of all images, where each begins, and the masks of their indices."""
    tables = [x[4][which].array for x in streams]
    sizes = np.array([len(t) for t in tables])
    return np.concatenate(tables), np.cumsum(sizes) - sizes, sizes - 1


def _in_time(at: np.ndarray, ends: np.ndarray) -> None:
    if (at > ends).any():
        raise ValueError("the image ends early")


def _literals(streams: list[Stream]) -> list[np.ndarray]:
    words, at, ends = _words(streams)
    table, first, mask = _tables(streams, 0)
    total = np.array([x[3] for x in streams])
    out = np.empty((int(total[0]), len(streams)), np.uint8)
    live = (len(streams) - np.searchsorted(total[::-1], np.arange(int(total[0])), "right")).tolist()
    n = len(streams)
    for k, now in enumerate(live):
        if now != n or k % CHECKED == 0:
            _in_time(at, ends)
            n, at, ends, first, mask = now, at[:now], ends[:now], first[:now], mask[:now]
        entry = table[first + (words[at >> 3] >> (at & 7) & mask)]
        out[k, :n] = entry >> 4
        at = at + (entry & 15)
    _in_time(at, ends)
    return [out[:m, i] for i, m in enumerate(total.tolist())]


def _values(symbol: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_prefixed() of many: the numbers, and how many bits they took."""
    extra = np.maximum(symbol - 2, 0) >> 1
    more = words[at >> 3] >> (at & 7) & ((1 << extra) - 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + more + 1), extra


def _with_copies(streams: list[Stream]) -> list[np.ndarray]:
    words, at, ends = _words(streams)
    (table, first, mask), (far, far_first, far_mask) = _tables(streams, 0), _tables(streams, 4)
    total, width = (np.array([x[k] for x in streams]) for k in (3, 2))
    near = np.array([(0, 0), *_near()])
    starts = np.cumsum(total) - total
    out, place, begin, stop = np.empty(int(total.sum()), np.uint8), starts.copy(), starts, starts + total
    step = 0
    while len(at):
        entry = table[first + (words[at >> 3] >> (at & 7) & mask)]
        at = at + (entry & 15)
        symbol = entry >> 4
        out[place] = symbol
        place = place + 1
        c = np.flatnonzero(symbol >= 256)
        if len(c):
            n, bits = _values(symbol[c] - 256, words, at[c])
            own = at[c] + bits
            entry = far[far_first[c] + (words[own >> 3] >> (own & 7) & far_mask[c])]
            own += entry & 15
            d, bits = _values(entry >> 4, words, own)
            at[c] = own + bits
            x, y = near[np.where(d > 120, 0, d)].T
            d = np.where(d > 120, d - 120, np.maximum(1, x + y * width[c]))
            to = place[c] - 1
            if (d > to - begin[c]).any() or (to + n > stop[c]).any():
                raise ValueError("a back-reference leaves the image")
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to, n) + k] = out[np.repeat(to - d, n) + k % np.repeat(d, n)]
            place[c] = to + n
        step += 1
        going = place < stop
        if step % CHECKED == 0 or not going.all():
            _in_time(at, ends)
            at, ends, place, begin, stop, width, first, mask, far_first, far_mask = (
                v[going] for v in (at, ends, place, begin, stop, width, first, mask, far_first, far_mask)
            )
    return [out[a : a + n] for a, n in zip(starts, total.tolist(), strict=True)]


def _channels(argb: np.ndarray) -> np.ndarray:
    """uint8 of shape (..., 4): alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(k)).astype(np.uint8) for k in (24, 16, 8, 0)], -1)


def _argb(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _mean(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _predicted(mode: int, l, t, tl, tr) -> list[int]:  # noqa: E741
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode <= 4:
        return [l, t, tr, tl][mode - 1]
    if mode == 5:
        return _mean(_mean(l, tr), t)
    if mode <= 9:
        return _mean(*((l, tl), (l, t), (tl, t), (t, tr))[mode - 6])
    if mode == 10:
        return _mean(_mean(l, tl), _mean(t, tr))
    if mode == 11:
        to_left = sum(abs(b - c) for b, c in zip(t, tl))  # how far the gradient's guess is from the left
        to_top = sum(abs(a - c) for a, c in zip(l, tl))
        return list(l) if to_left < to_top else list(t)
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(l, t, tl)]
    half = _mean(l, t)
    return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(half, tl)]


def _predict(image: np.ndarray, modes: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    """Adds (undo) or subtracts predictions. image: (height, width, 4) uint8; modes: of each block."""
    height, width = image.shape[:2]
    src = image.astype(int).tolist()
    out = [[None] * width for _ in range(height)]
    known = out if undo else src
    sign = 1 if undo else -1
    for y in range(height):
        for x in range(width):
            if y == 0:
                p = [255, 0, 0, 0] if x == 0 else known[0][x - 1]
            elif x == 0:
                p = known[y - 1][0]
            else:
                right = known[y - 1][x + 1] if x + 1 < width else known[y][0]
                p = _predicted(int(modes[y >> shift, x >> shift]), known[y][x - 1], known[y - 1][x], known[y - 1][x - 1], right)
            out[y][x] = [(v + sign * q) & 255 for v, q in zip(src[y][x], p)]
    return np.array(out, np.uint8).reshape(image.shape)


def _cross(image: np.ndarray, factors: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    """Adds or subtracts what red and blue share with green, and blue with red, by blocks."""
    height, width = image.shape[:2]
    f = np.repeat(np.repeat(factors, 1 << shift, 0), 1 << shift, 1)[:height, :width].astype(np.int8).astype(np.int32)
    red_to_blue, green_to_blue, green_to_red = f[..., 1], f[..., 2], f[..., 3]
    out = image.astype(np.int32)
    signed = lambda c: (c & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    sign = 1 if undo else -1
    green, red = signed(out[..., 2]), out[..., 1].copy()
    out[..., 1] += sign * (green_to_red * green >> 5)
    whole_red = out[..., 1] if undo else red
    out[..., 3] += sign * ((green_to_blue * green >> 5) + (red_to_blue * signed(whole_red) >> 5))
    return (out & 255).astype(np.uint8)


def _palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unfold(index: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Indices (rows of them), several to a pixel's green for small palettes, as colours; beyond the palette: transparent
    black."""
    shift = _palette_bits(len(palette))
    index = index.astype(np.int64)
    if shift:
        each, wide = 1 << shift, 8 >> shift
        index = (index[..., None] >> (np.arange(each) * wide)) & ((1 << wide) - 1)
        index = index.reshape(index.shape[0], -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(palette)] = palette
    return full[index]


def _read_head(data: bytes) -> tuple[_Bits, int, int, bool, list[tuple]]:
    """The bits behind the transforms, width (of the stored pixels) and height, whether alpha is used, and the transforms:
    kind, size of blocks, what belongs to it, and the width before it."""
    if len(data) < 26 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    body = data[20 : 20 + size]
    if body[:1] != b"\x2f" or len(body) < size:
        raise ValueError("not a lossless WebP image")
    bits = _Bits(body)
    bits.read(8)
    own, height, used = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    steps, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (_PREDICTOR, _CROSS):
            shift = bits.read(3) + 2
            across, down = _parts(own, shift), _parts(height, shift)
            steps.append((kind, shift, _channels(_read_image(bits, across, down, False).reshape(down, across)), own))
        elif kind == _GREEN:
            steps.append((kind, 0, None, own))
        else:
            n = bits.read(8) + 1
            deltas = _channels(_read_image(bits, n, 1, False))
            palette = np.cumsum(deltas, 0, dtype=np.uint64).astype(np.uint8)
            steps.append((kind, 0, palette, own))
            own = _parts(own, _palette_bits(n))
    return bits, own, height, bool(used), steps


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: uint8 (height, width, 4), alpha, red, green, blue.

    ValueError for what is not such a file, ends early or breaks the format's rules.
    """
    bits, width, height, used, steps = _read_head(data)
    image = _channels(_read_image(bits, width, height, True).reshape(height, width))
    for kind, shift, more, was in reversed(steps):
        if kind == _PREDICTOR:
            image = _predict(image, more[..., 2] & 15, shift, True)
        elif kind == _CROSS:
            image = _cross(image, more, shift, True)
        elif kind == _GREEN:
            image[..., 1] += image[..., 2]
            image[..., 3] += image[..., 2]
        else:
            image = _unfold(image[..., 2], more, was)
    if not used:
        image[..., 0] = 255
    return image


def greens(images: list[bytes]) -> list[bytes]:
    """The green channel of each of the files, as decode() gives it, row after row. Images whose transforms leave green alone
    or look it up in a palette, and that have one group of codes, no colour cache and one value of red, blue and alpha, are
    decoded side by side, if there are some."""
    out: list[bytes] = [b""] * len(images)
    streams, which = [], []
    for i, data in enumerate(images):
        bits, width, height, _, steps = _read_head(data)
        plain = len(images) >= ABREAST and all(x[0] in (_GREEN, _PALETTE) for x in steps)
        if plain:
            codes, cache_bits, of, _ = _read_codes(bits, width, height, True)
            plain = of is None and not cache_bits and None not in [c.only for c in codes[0][1:4]]
        if plain:
            streams.append((bits.data, bits.at, width, width * height, codes[0]))
            which.append((i, height, next((x for x in steps if x[0] == _PALETTE), None)))
        else:
            out[i] = decode(data)[..., 2].tobytes()
    for (i, height, palette), green in zip(which, _abreast(streams), strict=True):
        if palette is not None:
            green = _unfold(green.reshape(height, -1), palette[2], palette[3])[..., 2]
        out[i] = green.tobytes()
    return out


class _Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def _riff(body: bytes) -> bytes:
    pad = b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def _lengths(counts: list[int]) -> list[int]:
    """Lengths of an optimal prefix code of at least two symbols; counts are evened out until none is over LONGEST."""
    n = len(counts)
    while True:
        order = sorted(range(n), key=counts.__getitem__)
        leaves, joined, parent = [counts[i] for i in order], [], [0] * (2 * n - 1)
        i = j = 0
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if j == len(joined) or (i < n and leaves[i] <= joined[j]):
                    total += leaves[i]
                    parent[i] = k
                    i += 1
                else:
                    total += joined[j]
                    parent[n + j] = k
                    j += 1
            joined.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= LONGEST:
            out = [0] * n
            for place, i in enumerate(order):
                out[i] = depth[place]
            return out
        counts = [c + 1 >> 1 for c in counts]


#: The code in which code lengths are written: symbols 0 to 13, 17 and 18 have 4 bits each.
_LENGTH_CODE = {s: int(_mirror(4)[i]) for i, s in enumerate((*range(14), 17, 18))}


def _put_code(w: _Writer, symbols: list[int], lengths: list[int]) -> None:
    """Symbols in ascending order and their lengths (one symbol has none)."""
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1 | (len(symbols) - 1) << 1 | 1 << 2 | symbols[0] << 3, 11)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
        return
    w.put(0, 1)
    w.put(17 - 4, 4)
    for s in _LENGTH_ORDER[:17]:
        w.put(4 if s in _LENGTH_CODE else 0, 3)
    every = bytearray(symbols[-1] + 1)
    for s, n in zip(symbols, lengths, strict=True):
        every[s] = n
    tokens, value, bits = 0, 0, 0
    for m in re.finditer(rb"\0+|[^\0]", every):
        run = len(m[0]) if not m[0][0] else 0
        if not run:
            value |= _LENGTH_CODE[m[0][0]] << bits
            tokens, bits = tokens + 1, bits + 4
        while run:
            take, code, more, least = (min(run, 138), 18, 7, 11) if run >= 11 else (run, 17, 3, 3) if run >= 3 else (1, 0, 0, 1)
            value |= (_LENGTH_CODE[code] | take - least << 4) << bits
            tokens, bits, run = tokens + 1, bits + 4 + more, run - take
    w.put(1 | 4 << 1 | tokens - 2 << 4, 14)
    w.put(value, bits)


def _put_single(w: _Writer, *symbols: int) -> None:
    for s in symbols:
        _put_code(w, [s], [0])


def _put_palette(w: _Writer, values: list[int]) -> None:
    """The transform and its image: a grey colour for each value, as a difference to the one before."""
    steps = [b - a for a, b in zip([0, *values], values)]
    w.put(1 | _PALETTE << 1 | len(values) - 1 << 3 | 0 << 11, 12)
    symbols = sorted(set(steps))
    n = max(1, (len(symbols) - 1).bit_length()) if len(symbols) > 1 else 0
    # Codes of n or n - 1 bits; the first symbols have the shorter ones.
    lengths = [n - (k < (1 << n) - len(symbols)) for k in range(len(symbols))] if n else [0]
    code = _codes(symbols, lengths)
    for _ in range(3):
        _put_code(w, symbols, lengths)
    alpha = [0, 255] if len(values) > 1 else [255]
    _put_code(w, alpha, [1] * len(alpha) if len(alpha) > 1 else [0])
    _put_single(w, 0)
    for k, s in enumerate(steps):
        for _ in range(3):
            w.put(*code[s])
        if len(alpha) > 1:
            w.put(int(k == 0), 1)


def _codes(symbols: list[int], lengths: list[int]) -> dict[int, tuple[int, int]]:
    """(code as it is written, its bits) of each symbol."""
    out, code, last = {}, 0, 0
    for n, s in sorted(zip(lengths, symbols, strict=True)):
        code <<= n - last
        out[s] = int(_mirror(n)[code]) if n else 0, n
        code, last = code + 1, n
    return out


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_values() undone: symbols, further bits, and their number."""
    v = value - 1
    high = np.maximum(np.frexp(v.astype(np.float64))[1] - 1, 0)
    symbol = np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1))
    extra = np.where(v < 4, 0, high - 1)
    return symbol, v & ((1 << extra) - 1), extra


_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=_U)
_ODD = np.random.default_rng(12).integers(0, 2**63, 32, dtype=_U) * _U(2) + _U(1)


def _copies(px: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(image, place, length, distance) of back-references that pay, in order. Places whose 16 bytes have a hash of one in
    ANCHORS are looked up; what was there before is compared from there on, and then backwards."""
    h = [_BYTES[px]]
    for k in (1, 2, 4, 8):
        h.append(h[-1][:-k] * _ODD[k] + h[-1][k:] if len(h[-1]) > k else h[-1][:0])
    at = np.flatnonzero((h[4] * _U(0x9E3779B97F4A7C15) >> _U(40)) % _U(ANCHORS) == 0)
    image = np.searchsorted(begin, at, "right") - 1
    inside = at + 16 <= end[image]
    at, image = at[inside], image[inside]
    order = np.lexsort((at, h[4][at], image))
    at, image = at[order], image[order]
    same = np.flatnonzero((image[1:] == image[:-1]) & (h[4][at[1:]] == h[4][at[:-1]])) + 1
    p, q, image = at[same], at[same - 1], image[same]
    n, most = np.full(len(p), 16), np.minimum(end[image] - p, MOST)
    for k in (4, 3, 2, 1, 0):
        go = np.arange(len(p))
        while len(go):
            go = go[n[go] + (1 << k) <= most[go]]
            go = go[h[k][p[go] + n[go]] == h[k][q[go] + n[go]]]
            n[go] += 1 << k
            go = go if k == 4 else go[:0]
    order = np.argsort(p)
    raw, out, reach, first = px.tobytes(), [], 0, begin.tolist()
    for i, a, b, size in zip(*(x[order].tolist() for x in (image, p, q, n)), strict=True):
        if a + size < reach + MATCH:
            continue
        if a < reach:
            a, b, size = reach, b + reach - a, size - (reach - a)
        least = max(reach, first[i])
        while a > least and b > first[i] and raw[a - 1] == raw[b - 1] and size < MOST:
            a, b, size = a - 1, b - 1, size + 1
        if size >= MATCH and raw[a : a + size] == raw[b : b + size]:
            out.append((i, a, size, a - b))
            reach = a + size
    return out


def _encoded(parts: list[bytes]) -> list[bytes]:
    """A file for each part, of whole rows of samples."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    present = np.bincount(np.repeat(np.arange(len(parts)) * 256, sizes) + data, minlength=256 * len(parts)).reshape(-1, 256) > 0
    colours = present.sum(1)
    few = colours <= 16  # several samples are then one pixel
    writers, pixels = [], []
    for i, part in enumerate(parts):
        w = _Writer()
        w.put(0x2F | WIDTH - 1 << 8 | len(part) // WIDTH - 1 << 22, 40)  # no alpha, version 0
        own = data[starts[i] : starts[i] + sizes[i]]
        if few[i]:
            values = np.flatnonzero(present[i])
            _put_palette(w, values.tolist())
            shift = _palette_bits(len(values))
            own = np.searchsorted(values, own).reshape(-1, 1 << shift)
            own = (own << (np.arange(1 << shift) * (8 >> shift))).sum(1).astype(np.uint8)
            w.put(0, 1)
        else:
            w.put(1 | _GREEN << 1, 4)  # red and blue are as green; no more transforms
        w.put(0, 2)  # no colour cache, one group of codes
        writers.append(w)
        pixels.append(own)
    px, size = np.concatenate(pixels), np.array([len(x) for x in pixels], np.int64)
    end = np.cumsum(size)
    begin = end - size
    found = _copies(px, begin, end)
    symbol, image = px.astype(np.int64), np.repeat(np.arange(len(parts)), size)
    kept = np.ones(len(px), bool)
    copied: dict[int, list] = {}
    for one in found:
        copied.setdefault(one[0], []).append(one)
    # Lengths and distances cost a longer header.
    found = [x for i, own in copied.items() if 4 * sum(x[2] for x in own) - 40 * len(own) > 900 for x in own]
    _, place, length, distance = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
    change = np.zeros(len(px) + 1, np.int64)
    np.add.at(change, place + 1, 1)
    np.add.at(change, place + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    long, long_bits, long_n = _prefix(length)
    far, far_bits, far_n = _prefix(distance + 120)
    symbol[place] = 256 + long
    items = np.flatnonzero(kept)
    symbol, image = symbol[items], image[items]
    counts = np.bincount(image * 280 + symbol, minlength=280 * len(parts)).reshape(-1, 280)
    owner = np.searchsorted(begin, place, "right") - 1
    far_counts = np.bincount(owner * 40 + far, minlength=40 * len(parts)).reshape(-1, 40)
    value, bits = np.zeros(280 * len(parts), np.int64), np.zeros(280 * len(parts), np.int64)
    far_value, far_size = np.zeros(40 * len(parts), np.int64), np.zeros(40 * len(parts), np.int64)
    for i, w in enumerate(writers):
        for k, (table, out, n) in enumerate(((counts, value, bits), (far_counts, far_value, far_size))):
            used = np.flatnonzero(table[i]).tolist() or [0]
            lengths = _lengths(table[i][used].tolist()) if len(used) > 1 else [0]
            if len(used) == 1 and used[0] > 255:
                raise AssertionError("an image begins with a sample")
            if k:
                _put_single(w, 0, 0, 255)
            _put_code(w, used, lengths)
            for s, (code, size_) in _codes(used, lengths).items():
                out[i * table.shape[1] + s], n[i * table.shape[1] + s] = code, size_
    at = image * 280 + symbol
    v, n = value[at].astype(_U), bits[at]
    if len(place):
        c, f = np.searchsorted(items, place), owner * 40 + far
        for more, wide in ((long_bits, long_n), (far_value[f], far_size[f]), (far_bits, far_n)):
            v[c] |= more.astype(_U) << n[c].astype(_U)
            n[c] += wide
    # Every image begins at a new word.
    total = np.bincount(image, n, len(parts)).astype(np.int64)
    head = np.array([w.n for w in writers], np.int64)
    room = (head + total + 63) // 64 + 1
    first = np.cumsum(room) - room
    upto = np.cumsum(n) - n
    bit = upto - (np.cumsum(total) - total)[image] + (64 * first + head)[image]
    out = np.zeros(int(room.sum()), _U)
    word, off = bit >> 6, (bit & 63).astype(_U)
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[new]] = np.bitwise_or.reduceat(v << off, new)
    over = np.flatnonzero((bit & 63) + n > 64)
    out[word[over] + 1] |= v[over] >> (_U(64) - off[over])
    raw = out.tobytes()
    files_ = []
    for w, a, t in zip(writers, (8 * first).tolist(), total.tolist(), strict=True):
        size_ = -(-(w.n + t) // 8)
        lead = -(-w.n // 8)
        start = int.from_bytes(raw[a : a + lead], "little") | w.value
        files_.append(_riff(start.to_bytes(lead, "little") + raw[a + lead : a + size_]))
    return files_


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of WIDTH of samples) as grey images, WIDTH wide and of ROWS rows at most, one file
    after another."""
    for x in payloads:
        if not x or len(x) % WIDTH:
            raise ValueError(f"samples must be a positive multiple of {WIDTH}")
    parts = [(i, x[at : at + WIDTH * ROWS]) for i, x in enumerate(payloads) for at in range(0, len(x), WIDTH * ROWS)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for some in _portions([p for _, p in parts]):
        for (i, _), file in zip(parts[some], _encoded([p for _, p in parts[some]]), strict=True):
            out[i].append(file)
    return [b"".join(x) for x in out]


def _portions(parts: list[bytes], size: int = SAMPLES_AT_ONCE) -> Iterator[slice]:
    at, held = 0, 0
    for i, x in enumerate(parts):
        if held and held + len(x) > size:
            yield slice(at, i)
            at, held = i, 0
        held += len(x)
    if held:
        yield slice(at, len(parts))


def encode_grey(samples: bytes) -> bytes:
    return encode_all([samples])[0]


def files(data: bytes) -> list[bytes]:
    """The files that stand one after another in data."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or at + 8 > len(data):
            raise ValueError("not a RIFF file")
        size = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.append(data[at : at + size])
        at += size
    return out


def decode_all(media: list[bytes]) -> list[bytes]:
    """What encode_all() was given."""
    parts = [(i, f) for i, data in enumerate(media) for f in files(data)]
    out: list[list[bytes]] = [[] for _ in media]
    for some in _portions([f for _, f in parts]):
        for (i, _), samples in zip(parts[some], greens([f for _, f in parts[some]]), strict=True):
            out[i].append(samples)
    return [b"".join(x) for x in out]


def decode_grey(data: bytes) -> bytes:
    return decode_all([data])[0]


def features(samples: bytes) -> str:
    """Mean, spread and entropy of the samples, and how many values occur, from their histogram."""
    n = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    total, values = int(n.sum()), np.arange(256)
    mean = int(n @ values) / total
    spread = max(0.0, int(n @ values**2) / total - mean**2) ** 0.5
    p = n[n > 0] / total
    return f"mean={mean:.4f};std={spread:.4f};entropy={-float(np.sum(p * np.log2(p))):.4f};values={int((n > 0).sum())}"


def payload(text: str | None) -> bytes:
    """UTF-8, with zeros up to a positive multiple of WIDTH."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (WIDTH - len(data) % WIDTH if len(data) % WIDTH or not data else 0)


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with their texts in a media column: doc_id, n_bytes (without the zeros), media
    (lossless WebP files). Null text counts as empty. One row per row, repeated or not; other columns are
    ignored; a text needs a few times its size of memory, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                media = encode_all([payload(t) for t in texts])
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
            T.StructField("media", T.BinaryType()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def read_media(stored: DataFrame) -> DataFrame:
    """stored (media, any more columns): adds samples (what the media column holds, decoded) and feature.
    Null media: null samples and feature."""
    schema = T.StructType(
        [*stored.schema.fields, T.StructField("samples", T.BinaryType()), T.StructField("feature", T.StringType())]
    )
    at = stored.columns.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                there = pa.compute.is_valid(part.column(at)).to_pylist()
                found = iter(decode_all(part.column(at).drop_null().to_pylist()))
                samples = [next(found) if x else None for x in there]
                feature = [None if s is None else features(s) for s in samples]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(samples, pa.binary()), pa.array(feature, pa.string())],
                    names=schema.names,
                )

    return stored.mapInArrow(run, schema)
