"""Lossless WebP (VP8L) in numpy: prefix codes, back-references, colour cache and the four transforms.

decode() reads any VP8L still image. encode() writes ARGB images with chosen transforms and a colour cache;
encode_bytes() is the quick writer for byte samples: a palette and codes of their own for data of any size, and
back-references to lines that came before. Images of one channel, without cache, take a vectorised reader: all bit positions are
looked up at once, and only the chain of symbol starts is followed one by one.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 1 << 14
MAX_COPY = 4096
MAX_CACHE_BITS = 11
#: Near pixels by plane code: nearest first, on equal distance by |x|, right before left.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)


class Bits:
    """Reads and writes little-endian bit strings."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.value, self.n = data + bytes(8), 0, 0, 0
        self.end = 8 * len(data)

    def check(self) -> None:
        """Zeros follow the data; whoever reads on and on has to ask whether they are being read."""
        if self.at > self.end:
            raise ValueError("the image ends early")

    def read(self, n: int) -> int:
        p = self.at
        self.at = p + n
        return int.from_bytes(self.data[p >> 3 : (p >> 3) + 5], "little") >> (p & 7) & ((1 << n) - 1)

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


class Code:
    """A canonical prefix code: a table from the next ``width`` bits to symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.single, self.width = int(used[0]) if len(used) else 0, 0
            return
        self.single, self.width = None, int(lengths.max())
        size = 1 << self.width
        self.symbols, self.lengths = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for symbol, length, code in canonical(lengths):
            self.symbols[code :: 1 << length] = symbol
            self.lengths[code :: 1 << length] = length

    @staticmethod
    def lone(symbol: int) -> Code:
        code = Code.__new__(Code)
        code.single, code.width = symbol, 0
        return code

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        p = bits.at
        w = int.from_bytes(bits.data[p >> 3 : (p >> 3) + 3], "little") >> (p & 7) & ((1 << self.width) - 1)
        bits.at = p + int(self.lengths[w])
        return int(self.symbols[w])


def canonical(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of the used symbols."""
    out, code, before = [], 0, 0
    for length, symbol in sorted((int(lengths[s]), int(s)) for s in np.flatnonzero(lengths)):
        code <<= length - before
        before = length
        out.append((symbol, length, int(f"{code:0{length}b}"[::-1], 2)))
        code += 1
    if code != 1 << before and len(out) > 1:
        raise ValueError("a prefix code that is not complete")
    return out


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths up to ``most``; a lone symbol has length 1."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights, floor = counts[used].tolist(), 1
    while True:
        n = len(used)
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * n)
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = node
            heapq.heappush(heap, (a + b, node))
        level = [0] * (2 * n)
        for node in range(2 * n - 3, -1, -1):
            level[node] = level[parent[node]] + 1
        depth = level[:n]
        if max(depth) <= most:
            lengths[used] = depth
            return lengths
        floor = 2 * floor if floor > 1 else max(2, sum(weights) >> most)


# ---- reading -------------------------------------------------------------------------------------------------


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, dtype=np.uint8)
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        symbol = bits.read(8 if wide else 1)
        if not two:
            return Code.lone(symbol)
        lengths[[symbol, bits.read(8)]] = 1
        return Code(lengths)
    own = np.zeros(19, dtype=np.uint8)
    for i in range(bits.read(4) + 4):
        own[LENGTH_ORDER[i]] = bits.read(3)
    of_lengths = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = of_lengths.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > size:
                raise ValueError("more code lengths than symbols")
            if s == 16:
                lengths[at : at + n] = before
            at += n
    bits.check()
    return Code(lengths)


def read_prefixed(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance_of(plane: int, width: int) -> int:
    if plane > 120:
        return plane - 120
    x, y = NEAR[plane - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels, as a flat array of ARGB numbers."""
    return read_pixels(bits, width, height, *read_image_head(bits, width, height, main))


def read_image_head(bits: Bits, width: int, height: int, main: bool) -> tuple:
    """All that comes before the pixels: cache size, groups of codes, and where they hold."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= MAX_CACHE_BITS:
            raise ValueError("a colour cache of unknown size")
    groups_at, block, across, n_groups = None, 0, 0, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        meta = read_image(bits, across, (height + (1 << block) - 1) >> block, False)
        groups_at = (meta >> 8) & 0xFFFF
        n_groups = int(groups_at.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = []
    for _ in range(n_groups):
        groups.append([read_code(bits, s) for s in sizes])
        bits.check()
    return cache_bits, groups, groups_at, block, across


def read_pixels(bits: Bits, width: int, height: int, cache_bits: int, groups: list, groups_at, block: int, across: int) -> np.ndarray:
    first = groups[0]
    if not cache_bits and groups_at is None and all(c.single is not None for c in first[1:4]) and first[0].single is None:
        return read_one_channel(bits, width, width * height, first)
    if groups_at is None and all(c.single is not None for c in first[:4]) and first[0].single < 256:  # one colour, without a bit for any pixel
        alpha, red, blue = (first[i].single for i in (3, 1, 2))
        return np.full(width * height, alpha << 24 | red << 16 | first[0].single << 8 | blue, dtype=np.uint32)
    out: list[int] = []
    total, cache = width * height, [0] * (1 << cache_bits)
    hashed = 0  # pixels that the cache has seen

    def catch_up(hashed: int) -> int:
        for v in out[hashed:]:
            cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        return len(out)

    while len(out) < total:
        bits.check()
        codes = first
        if groups_at is not None:
            y, x = divmod(len(out), width)
            codes = groups[int(groups_at[(y >> block) * across + (x >> block)])]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = (codes[i].read(bits) for i in (1, 2, 3))
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = read_prefixed(bits, s - 256)
            back = distance_of(read_prefixed(bits, codes[4].read(bits)), width)
            if back > len(out):
                raise ValueError("a copy from before the image")
            for _ in range(n):
                out.append(out[-back])
        else:
            hashed = catch_up(hashed)
            out.append(cache[s - 280])
    return np.array(out[:total], dtype=np.uint32)


BLOCK = 4096  # bytes whose bit positions are looked up at once
_at = np.arange(8 * BLOCK)
_window, _moves, _steps = np.empty((BLOCK, 8), dtype=np.intp), np.empty_like(_at), [np.empty_like(_at) for _ in range(4)]


def read_one_channel(bits: Bits, width: int, total: int, codes: list[Code]) -> np.ndarray:
    """Pixels of which green alone differs.

    In a block, every bit position gets the position after the symbol that would begin there; from these, the
    ones two, four and eight symbols on. The chain of symbols is followed in steps of eight and filled in.
    """
    green, distances = codes[0], codes[4]
    rest = codes[3].single << 24 | codes[1].single << 16 | codes[2].single
    raw = np.frombuffer(bits.data, dtype=np.uint8)
    move_of = np.where(green.symbols > 255, 0, green.lengths).astype(np.intp)  # a chain rests where a copy begins
    mask, out = (1 << green.width) - 1, np.zeros(total, dtype=np.uint8)
    at, begin, n = 0, 0, 0
    while at < total:
        p = bits.at - 8 * begin
        if not n or p >= 8 * n - 15:
            begin, p = bits.at >> 3, bits.at & 7
            n = min(BLOCK, len(raw) - begin - 2)
            if n < 3:
                raise ValueError("the image ends early")
            part = raw[begin : begin + n + 2].astype(np.intp)
            w = part[:-2] | part[1:-1] << 8 | part[2:] << 16
            window = _window[:n]
            np.right_shift(w[:, None], _at[:8], out=window)
            window &= mask
            window = window.ravel()
            m = 8 * n
            moves = move_of.take(window, out=_moves[:m], mode="clip")
            moves[-15:] = 0  # and at the end of the block
            steps = [np.add(_at[:m], moves, out=_steps[0][:m])]
            for i in range(1, 4):
                steps.append(steps[-1].take(steps[-1], out=_steps[i][:m], mode="clip"))
            far_step = steps[3].item
        far = [p]
        while (q := far_step(far[-1])) != far[-1]:
            far.append(q)
        run = np.array(far)
        for step in steps[2::-1]:
            run = np.stack([run, step.take(run)], axis=1).ravel()
        k = int(np.argmin(moves.take(run)))  # literals before the chain rests
        last = int(run[k])
        k = min(k, total - at)
        out[at : at + k] = green.symbols.take(window.take(run[:k]))
        at += k
        if at >= total:
            bits.at = 8 * begin + int(run[k - 1]) + int(moves[run[k - 1]])
            break
        bits.at = 8 * begin + last
        copy = int(green.symbols[window[last]])
        if copy < 256:  # the end of the block
            if last < m - 15:
                raise ValueError("bits without a symbol")
            continue
        bits.at += int(green.lengths[window[last]])
        k = min(read_prefixed(bits, copy - 256), total - at)
        back = distance_of(read_prefixed(bits, distances.read(bits)), width)
        bits.check()
        if back > at:
            raise ValueError("a copy from before the image")
        out[at : at + k] = out[at - back : at - back + k] if back >= k else np.resize(out[at - back : at], k)
        at += k
    return out.astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def channels(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as an array of its own axis."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left, top, top_left, top_right):
    """The prediction of a pixel from its neighbours (each of four channels)."""
    mean = lambda a, b: (a + b) >> 1
    clip = lambda a: np.clip(a, 0, 255)
    if mode == 0:
        return np.array([255, 0, 0, 0])
    if mode == 11:  # the neighbour that the gradient is nearer to
        estimate = left + top - top_left
        return left if np.abs(estimate - left).sum() < np.abs(estimate - top).sum() else top
    if mode == 13:
        middle = mean(left, top)
        off = middle - top_left
        return clip(middle + np.where(off < 0, -(-off // 2), off // 2))
    simple = {
        1: lambda: left,
        2: lambda: top,
        3: lambda: top_right,
        4: lambda: top_left,
        5: lambda: mean(mean(left, top_right), top),
        6: lambda: mean(left, top_left),
        7: lambda: mean(left, top),
        8: lambda: mean(top_left, top),
        9: lambda: mean(top, top_right),
        10: lambda: mean(mean(left, top_left), mean(top, top_right)),
        12: lambda: clip(left + top - top_left),
    }
    return simple[mode]() if mode in simple else np.array([255, 0, 0, 0])


def neighbours(c: np.ndarray, y: int, x: int, mode: int) -> np.ndarray:
    """The prediction of pixel (y, x) of the channels c, with the fixed rules at the borders."""
    if y == 0:
        return c[0, x - 1] if x else np.array([255, 0, 0, 0])
    if x == 0:
        return c[y - 1, 0]
    # on the right border, the leftmost pixel of the same row stands for the one above to the right
    top_right = c[y - 1, x + 1] if x + 1 < c.shape[1] else c[y, 0]
    return predicted(mode, c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], top_right)


def cross_terms(m: np.ndarray, green, red) -> tuple:
    """What cross-colour adds to red, and to blue, for multipliers m (alpha, red, green, blue of its image)."""
    signed = lambda v: np.where(v > 127, v - 256, v)
    g = signed(green)
    return (signed(m[..., 3]) * g) >> 5, ((signed(m[..., 2]) * g) >> 5) + ((signed(m[..., 1]) * signed(red)) >> 5)


def spread(blocks: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    """A block image stretched to pixels."""
    return blocks.repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width]


def inverted(kind: int, extra, pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    if kind == PALETTE:
        colours, packed = extra
        index = (pixels >> np.uint32(8)) & np.uint32(255)
        if packed:
            each = 1 << packed
            size = 8 >> packed
            parts = (index[:, :, None] >> (np.arange(each, dtype=np.uint32) * np.uint32(size))) & np.uint32((1 << size) - 1)
            index = parts.reshape(height, -1)[:, :width]
        table = np.zeros(256, dtype=np.uint32)
        table[: len(colours)] = colours
        return table[index]
    c = channels(pixels)
    if kind == SUBTRACT_GREEN:
        c[..., 1] += c[..., 2]
        c[..., 3] += c[..., 2]
    elif kind == CROSS_COLOUR:
        block, image = extra
        m = spread(channels(image), block, height, width)
        red_add, _ = cross_terms(m, c[..., 2], c[..., 1])
        c[..., 1] = (c[..., 1] + red_add) & 255
        _, blue_add = cross_terms(m, c[..., 2], c[..., 1])
        c[..., 3] += blue_add
    else:
        block, image = extra
        modes = spread((image >> np.uint32(8)) & np.uint32(15), block, height, width)
        for y in range(height):
            for x in range(width):
                c[y, x] = (c[y, x] + neighbours(c, y, x, int(modes[y, x]))) & 255
    return joined(c)


_heads: dict[bytes, tuple[int, int, tuple]] = {}


def read_transforms(bits: Bits, width: int, height: int) -> tuple[list, int]:
    """The transforms as (kind, extra, width), and the width of the coded image."""
    todo = []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (k for k, _, _ in todo):
            raise ValueError("a transform that comes twice")
        extra: object = None
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            w, h = ((n + (1 << block) - 1) >> block for n in (width, height))
            extra = block, read_image(bits, w, h, False).reshape(h, w)
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = joined(np.cumsum(channels(read_image(bits, n, 1, False)), axis=0))
            extra = colours, 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        todo.append((kind, extra, width))
        if kind == PALETTE:
            width = (width + (1 << extra[1]) - 1) >> extra[1]
    return todo, width


def decode(data: bytes, most: int = 1 << 25) -> np.ndarray:
    """The pixels of a lossless WebP file: a (height, width) array of ARGB numbers.

    Heads that many images share, bit for bit, are parsed once. A damaged file, and one of over ``most`` pixels (which bounds the
    memory of a reader), is a ValueError or an IndexError; no file keeps the reader for ever.
    """
    if len(data) < 26 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    if width * height > most:
        raise ValueError("more pixels than the reader takes")
    begin = bits.data[4:20]
    n, value, parsed = _heads.get(begin, (0, 0, ()))
    if n and int.from_bytes(bits.data[4 : 4 + (n + 7) // 8], "little") & ((1 << n) - 1) == value and parsed[0] == width:
        _, todo, now, head = parsed
        bits.at = 32 + n
    else:
        todo, now = read_transforms(bits, width, height)
        head = read_image_head(bits, now, height, True)
        if head[2] is None and all(kind in (PALETTE, SUBTRACT_GREEN) for kind, _, _ in todo) and len(_heads) < 64:
            n = bits.at - 32
            value = int.from_bytes(bits.data[4 : 4 + (n + 7) // 8], "little") & ((1 << n) - 1)
            _heads.setdefault(begin, (n, value, (width, todo, now, head)))
    pixels = read_pixels(bits, now, height, *head).reshape(height, now)
    for kind, extra, w in reversed(todo):
        pixels = inverted(kind, extra, pixels, w, height)
    return pixels


# ---- writing -------------------------------------------------------------------------------------------------


def write_code(bits: Bits, lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """Write a code; symbol -> (code, length), length 0 for a lone symbol."""
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        symbol = int(used[0]) if len(used) else 0
        bits.write(1, 2)  # one symbol
        bits.write(int(symbol > 1), 1)
        bits.write(symbol, 8 if symbol > 1 else 1)
        return {symbol: (0, 0)}
    items, at, every = [], 0, lengths[: int(used[-1]) + 1].tolist()
    while at < len(every):
        run = 1
        if every[at] == 0:
            while at + run < len(every) and every[at + run] == 0 and run < 138:
                run += 1
        items.append((every[at], 0, 0) if run < 3 else (17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        at += 1 if run < 3 else run
    counts = np.bincount([s for s, _, _ in items], minlength=19)
    own = code_lengths(counts, 7)
    sent = max(i for i, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    bits.write(0, 1)
    bits.write(max(sent, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(sent, 4)]:
        bits.write(int(own[s]), 3)
    table = {s: (c, n) for s, n, c in canonical(own)}
    if len(table) == 1:
        table = dict.fromkeys(table, (0, 0))
    bits.write(1, 1)  # how many items follow
    n_bits = max(2, (len(items) - 2).bit_length() + (len(items) - 2).bit_length() % 2)
    bits.write((n_bits - 2) // 2, 3)
    bits.write(len(items) - 2, n_bits)
    for s, extra, n in items:
        bits.write(*table[s])
        bits.write(extra, n)
    if len(used) == 1:
        return {int(used[0]): (0, 0)}
    return {s: (c, n) for s, n, c in canonical(lengths)}


def prefixed(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


def riff(bits: bytes) -> bytes:
    body = b"\x2f" + bits
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def write_image(bits: Bits, pixels: np.ndarray, main: bool, cache_bits: int = 0) -> None:
    """Pixels as literals and, with a cache, cache hits."""
    flat = pixels.ravel().tolist()
    bits.write(int(cache_bits > 0), 1)
    if cache_bits:
        bits.write(cache_bits, 4)
    if main:
        bits.write(0, 1)
    cache, symbols = [0] * (1 << cache_bits), []
    for v in flat:
        at = (CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        symbols.append((280 + at,) if cache_bits and cache[at] == v else (v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
        cache[at] = v
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256)
    tables = []
    for i, size in enumerate(sizes):
        counts = np.bincount([s[i] for s in symbols if len(s) > i], minlength=size)
        tables.append(write_code(bits, code_lengths(counts, 15)))
    write_code(bits, np.zeros(40, dtype=np.uint8))
    for s in symbols:
        for i, v in enumerate(s):
            bits.write(*tables[i][v])


def encode(
    pixels: np.ndarray, transforms: Sequence[tuple] = (), cache_bits: int = 0
) -> bytes:
    """A lossless WebP file of (height, width) ARGB numbers.

    transforms, in the order that they are applied: (PREDICTOR, block, modes), (CROSS_COLOUR, block, multipliers),
    (SUBTRACT_GREEN,) or (PALETTE,); modes and multipliers are block images of ARGB numbers.
    """
    height, width = pixels.shape
    bits = Bits()
    bits.write(width - 1, 14)
    bits.write(height - 1, 14)
    bits.write(1, 1)
    bits.write(0, 3)
    now = pixels.astype(np.uint32)
    for kind, *extra in transforms:
        bits.write(1 | kind << 1, 3)
        c = channels(now)
        if kind == SUBTRACT_GREEN:
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            now = joined(c)
        elif kind == PALETTE:
            colours, index = np.unique(now, return_inverse=True)
            deltas = channels(colours)
            deltas[1:] -= channels(colours)[:-1]
            bits.write(len(colours) - 1, 8)
            write_image(bits, joined(deltas), False)
            now = packed_rows(index.reshape(now.shape), len(colours)) << np.uint32(8) | np.uint32(255 << 24)
        else:
            block, image = extra
            bits.write(block - 2, 3)
            write_image(bits, image, False)
            if kind == CROSS_COLOUR:
                red_add, blue_add = cross_terms(spread(channels(image), block, *now.shape), c[..., 2], c[..., 1])
                c[..., 1] -= red_add
                c[..., 3] -= blue_add
                now = joined(c)
            else:
                modes = spread((image >> np.uint32(8)) & np.uint32(15), block, *now.shape)
                coded = c.copy()
                for y in range(now.shape[0]):
                    for x in range(now.shape[1]):
                        coded[y, x] = c[y, x] - neighbours(c, y, x, int(modes[y, x]))
                now = joined(coded)
    bits.write(0, 1)
    write_image(bits, now, True, cache_bits)
    return riff(bits.value.to_bytes((bits.n + 7) // 8, "little"))


def packed_rows(index: np.ndarray, colours: int) -> np.ndarray:
    """Palette indices, several in a number where the palette is small."""
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    index = index.astype(np.uint32)
    if not packed:
        return index
    each = 1 << packed
    wide = np.pad(index, ((0, 0), (0, -index.shape[1] % each)))
    parts = wide.reshape(index.shape[0], -1, each) << (np.arange(each, dtype=np.uint32) * np.uint32(8 >> packed))
    return parts.sum(axis=2).astype(np.uint32)


def repeats(data: bytes, least: int) -> list[tuple[int, int, int]]:
    """(start, length, source) of lines of ``least`` bytes or more that came before; neighbours are joined."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return []
    seen: dict[bytes, int] = {}
    out: list[tuple[int, int, int]] = []
    at = 0
    for line in lines:
        n = min(len(line) + 1, len(data) - at)
        if n >= least:
            source = seen.setdefault(line, at)
            if source < at:
                if out and sum(out[-1][:2]) == at and out[-1][2] + out[-1][1] == source:
                    out[-1] = (out[-1][0], out[-1][1] + n, out[-1][2])
                else:
                    out.append((at, n, source))
        at += n
    return out


class Profile:
    """A palette and codes for byte samples, and the bits that hold them between the image's size and its pixels.

    Samples are green alone. Codes come from the counts of what the image holds.
    """

    def __init__(self, counts: np.ndarray, order: np.ndarray, lengths: np.ndarray, distances: np.ndarray):
        """counts: of palette entries; order: the bytes by palette entry; lengths, distances: counts of symbols."""
        bits = Bits()
        bits.write(1 | PALETTE << 1, 3)
        bits.write(len(order) - 1, 8)
        bits.write(0, 1)
        steps = np.diff(order.astype(np.int64), prepend=0) & 255
        step_code = write_code(bits, code_lengths(np.bincount(steps, minlength=280), 15))
        for _ in range(3):
            bits.write(1, 4)  # red, blue and alpha are 0 throughout
        bits.write(1, 4)
        for s in steps.tolist():
            bits.write(*step_code[s])
        bits.write(0, 3)  # no more transforms, no cache, one group of codes
        self.green = write_code(bits, code_lengths(np.concatenate([counts, lengths]), 15))
        for _ in range(3):
            bits.write(1, 4)
        self.far = write_code(bits, code_lengths(distances, 15))
        self.head, self.head_bits = bits.value, bits.n
        self.code, self.size = np.zeros(280, dtype=np.uint64), np.zeros(280, dtype=np.int64)
        for s, (c, n) in self.green.items():
            self.code[s], self.size[s] = c, n


def encode_bytes(data: bytes, width: int = 64, least: int = 12) -> bytes:
    """A lossless WebP file whose green samples are the bytes, in rows of ``width``, with a palette and codes of its own."""
    raw = np.frombuffer(data, dtype=np.uint8)
    height = len(raw) // width
    if len(raw) % width or not 0 < height <= MAX_SIDE:
        raise ValueError(f"{len(raw)} bytes are no rows of {width}, or too many")
    order = np.flatnonzero(np.bincount(raw, minlength=256))
    copies = [] if len(order) <= 16 else repeats(data, least)
    parts, at = [], 0  # each: where literals begin and end, then the copy that follows
    for start, n, source in copies:
        for low in range(0, n, MAX_COPY):
            size = min(MAX_COPY, n - low)
            parts.append((at, start + low, size, start - source))
            at = start + low + size
    tokens = [(prefixed(n), prefixed(back + 120)) for _, _, n, back in parts]
    kept = np.concatenate([raw[a:b] for a, b, _, _ in [*parts, (at, len(raw), 0, 0)]]) if parts else raw
    index = np.zeros(256, dtype=np.uint8)
    index[order] = np.arange(len(order))
    literals = index[kept]
    if len(order) <= 16:
        literals = packed_rows(literals.reshape(height, width), len(order)).ravel()
    lengths = np.bincount([n for (n, *_), _ in tokens], minlength=24) if tokens else np.zeros(24, dtype=np.int64)
    distances = np.bincount([d for _, (d, *_) in tokens], minlength=40) if tokens else np.zeros(40, dtype=np.int64)
    profile = Profile(np.bincount(literals, minlength=256), order, lengths, distances)
    values, sizes = profile.code[literals], profile.size[literals]
    if tokens:
        places = np.cumsum([b - a for a, b, _, _ in parts])
        extra_values, extra_sizes = [], []
        for (n, nx, nb), (d, dx, db) in tokens:
            c, m = profile.green[256 + n]
            f, k = profile.far[d]
            extra_values += [c | nx << m, f | dx << k]
            extra_sizes += [m + nb, k + db]
        values = np.insert(values, places.repeat(2), np.array(extra_values, dtype=np.uint64))
        sizes = np.insert(sizes, places.repeat(2), extra_sizes)
    bits = Bits()
    bits.write(width - 1 | (height - 1) << 14 | 1 << 28, 32)
    bits.write(profile.head, profile.head_bits)
    return riff(packed_bits(bits, values, sizes))


def packed_bits(head: Bits, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The bits of head, then those of the values; each value has less than 64 bits."""
    whole, start = divmod(head.n, 64)
    front = (head.value & ((1 << (64 * whole)) - 1)).to_bytes(8 * whole, "little")
    ends = np.cumsum(sizes) + start
    begins = ends - sizes
    total = int(ends[-1])
    words = np.zeros(total // 64 + 2, dtype=np.uint64)
    word, shift = begins >> 6, (begins & 63).astype(np.uint64)
    low = values << shift
    high = np.where(shift > 0, values >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    firsts = np.flatnonzero(np.diff(word, prepend=-1))  # where the bits of a word begin; bits don't overlap
    words[word[firsts]] += np.add.reduceat(low, firsts)
    words[word[firsts] + 1] += np.add.reduceat(high, firsts)
    words[0] += np.uint64(head.value >> (64 * whole))
    return (front + words.astype("<u8").tobytes())[: 8 * whole + (total + 7) // 8]
