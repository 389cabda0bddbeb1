"""Lossless WebP (VP8L): a complete decoder, and an encoder for pixel arrays."""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

MAX_SIDE = 16384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The order in which lengths of the code for code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 near distances (x to the left, y up), nearest first; of equals the lesser |x|, then the left one.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
OPAQUE = 0xFF000000


# Prefix codes


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Huffman lengths of at most `limit` bits; a lone symbol gets 1."""
    used = [i for i, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0]] = 1
    least = 1
    while len(used) > 1:
        heap = sorted((max(counts[i], least), k) for k, i in enumerate(used))
        above, made = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            n, a = heapq.heappop(heap)
            m, b = heap[0]
            above[a] = above[b] = made
            heapq.heapreplace(heap, (n + m, made))
            made += 1
        depth = [0] * made
        for k in range(made - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= limit:
            for k, i in enumerate(used):
                lengths[i] = depth[k]
            break
        least = max(2 * least, sum(counts) >> limit)
    return lengths


@functools.lru_cache(maxsize=64)
def _codes(lengths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, length, bits in the order of the stream) of a canonical code."""
    code, last, found = 0, 0, []
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        found.append((symbol, n, int(f"{code:0{n}b}"[::-1], 2)))
        code += 1
    return found


class _Code:
    """symbol << 4 | length for every value of the next bits, and their mask; a lone symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]):
        found = _codes(lengths)
        if not found:
            raise ValueError("a prefix code without symbols is not allowed")
        self.literal = not any(lengths[256:])
        if len(found) == 1:
            self.table, self.mask = np.array([found[0][0] << 4], np.uint16), 0
            return
        if sum(1 << (15 - n) for _, n, _ in found) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        width = max(n for _, n, _ in found)
        self.table, self.mask = np.zeros(1 << width, np.uint16), (1 << width) - 1
        for symbol, n, bits in found:
            self.table[bits :: 1 << n] = symbol << 4 | n

    @functools.cached_property
    def listed(self) -> list[int]:
        return self.table.tolist()


_code_of = functools.lru_cache(maxsize=64)(_Code)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.n = data, 0, 0, 0

    def fill(self) -> None:
        if self.at > len(self.data) + 64:
            raise ValueError("the data ends early")
        self.bits |= int.from_bytes(self.data[self.at : self.at + 32], "little") << self.n
        self.at += 32
        self.n += 256

    def read(self, n: int) -> int:
        if self.n < n:
            self.fill()
        value = self.bits & ((1 << n) - 1)
        self.bits >>= n
        self.n -= n
        return value

    def symbol(self, code: _Code) -> int:
        if self.n < 15:
            self.fill()
        entry = code.listed[self.bits & code.mask]
        self.bits >>= entry & 15
        self.n -= entry & 15
        return entry >> 4


def _read_code(r: _Reader, size: int) -> _Code:
    lengths = [0] * size
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return _code_of(tuple(lengths))
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + r.read(4)]:
        own[k] = r.read(3)
    code = _code_of(tuple(own))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            n = 3 + r.read(2) if s == 16 else 3 + r.read(3) if s == 17 else 11 + r.read(7)
            if at + n > size:
                raise ValueError("code lengths beyond the alphabet")
            lengths[at : at + n] = [last if s == 16 else 0] * n
            at += n
    return _code_of(tuple(lengths))


# Decoding


def _value(r: _Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _read_plain(r: _Reader, code: _Code, n: int) -> np.ndarray:
    """n symbols of one code that end the stream, the entries of all bit positions looked up at once."""
    if not code.mask:
        return np.full(n, code.table[0] >> 4, np.uint8)
    left = r.data[max(0, r.at - -(-r.n // 8)) :]
    symbols, at, mask = [], -r.n % 8, np.uint64(code.mask)
    for begin in range(0, len(left), 1 << 16):  # blocks, to bound the memory
        block = np.frombuffer(left[begin : begin + (1 << 16) + 8].ljust(min(1 << 16, len(left) - begin) + 8, b"\0"), np.uint8).astype(np.uint64)
        three = block[:-8] | block[1:-7] << np.uint64(8) | block[2:-6] << np.uint64(16)
        found = code.table[((three[:, None] >> np.arange(8, dtype=np.uint64)) & mask).ravel()]
        step, places = (found & 15).astype(np.uint8).tobytes(), []
        put, end = places.append, len(step)
        while at < end:
            put(at)
            at += step[at]
        at -= end
        symbols.append((found[places] >> 4).astype(np.uint8))
        if sum(map(len, symbols)) >= n:
            break
    out = np.concatenate(symbols or [np.empty(0, np.uint8)])
    if len(out) < n:
        raise ValueError("the data ends early")
    return out[:n]


def _read_image(r: _Reader, width: int, height: int, top: bool) -> list[int] | np.ndarray:
    """Entropy-coded pixels: literals, back-references and colour cache, by one group of codes or several."""
    cache_bits = r.read(4) if r.read(1) else 0
    if not 0 <= cache_bits <= 11:
        raise ValueError("colour cache too large")
    block, group_of, across = 0, None, 0
    if top and r.read(1):
        block = r.read(3) + 2
        across = -(-width >> block)
        group_of = [int(p) >> 8 & 0xFFFF for p in _read_image(r, across, -(-height >> block), False)]
    groups = []
    for _ in range(max(group_of) + 1 if group_of else 1):
        groups.append([_read_code(r, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)])
    if top and not group_of and groups[0][0].literal and not any(c.mask for c in groups[0][1:4]):  # green alone varies
        red, blue, alpha = (int(c.table[0]) >> 4 for c in groups[0][1:4])
        return _read_plain(r, groups[0][0], width * height).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
    opened = [(*((c.listed, c.mask) for c in g[:4]), g[4]) for g in groups]
    (green, gm), (red, rm), (blue, bm), (alpha, am), distance = opened[0]
    cache, shift = [0] * (1 << cache_bits) if cache_bits else [], 32 - cache_bits
    total, out = width * height, []
    put = out.append
    cached, done = 0, 0
    bits, n = r.bits, r.n
    while done < total:
        if group_of:
            (green, gm), (red, rm), (blue, bm), (alpha, am), distance = opened[group_of[(done // width >> block) * across + (done % width >> block)]]
        if n < 60:
            r.bits, r.n = bits, n
            r.fill()
            bits, n = r.bits, r.n
        entry = green[bits & gm]
        size = entry & 15
        bits >>= size
        s = entry >> 4
        if s < 256:
            e = red[bits & rm]
            bits >>= e & 15
            f = blue[bits & bm]
            bits >>= f & 15
            g = alpha[bits & am]
            bits >>= g & 15
            n -= size + (e & 15) + (f & 15) + (g & 15)
            put((g >> 4) << 24 | (e >> 4) << 16 | s << 8 | f >> 4)
            done += 1
        elif s < 280:
            r.bits, r.n = bits, n - size
            length = _value(r, s - 256)
            code = _value(r, r.symbol(distance))
            if code > 120:
                back = code - 120
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            bits, n = r.bits, r.n
            if back > done or done + length > total:
                raise ValueError("a back-reference beyond the image")
            if length <= back:
                out += out[done - back : done - back + length]
            else:
                for k in range(done - back, done - back + length):
                    put(out[k])
            done += length
        else:
            n -= size
            while cached < done:
                p = out[cached]
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
                cached += 1
            put(cache[s - 280])
            done += 1
    r.bits, r.n = bits, n
    return out


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    """The fourteen predictions of a pixel from its neighbours."""
    if mode < 5:
        return (OPAQUE, left, top, top_right, top_left)[mode]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode < 10:
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    l, t, tl = _parts(left), _parts(top), _parts(top_left)
    if mode == 11:
        to_left = sum(abs(b - c) for b, c in zip(t, tl, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(l, tl, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return _join(_clamp(a + b - c) for a, b, c in zip(l, t, tl, strict=True))
    mean = _parts(_average(left, top))
    return _join(_clamp(m + int((m - c) / 2)) for m, c in zip(mean, tl, strict=True))


def _prediction(done: list[int], x: int, at: int, width: int, mode: int) -> int:
    if at < width:
        return done[at - 1] if at else OPAQUE
    if not x:
        return done[at - width]
    return predict(mode, done[at - 1], done[at - width], done[at - width + 1], done[at - width - 1])


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    return _join((x - y) & 255 for x, y in zip(_parts(a), _parts(b), strict=True))


def _unpredict(pixels: list[int], width: int, bits: int, modes: list[int]) -> list[int]:
    across, out = -(-width >> bits), []
    for at, residual in enumerate(pixels):
        y, x = divmod(at, width)
        out.append(_add(residual, _prediction(out, x, at, width, modes[(y >> bits) * across + (x >> bits)] >> 8 & 15)))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(pixels: np.ndarray, width: int, bits: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """Cross-colour: adds (1) or takes off (-1) what red and blue owe to green, and blue to red."""
    at = np.arange(len(pixels))
    own = elements[(at // width >> bits) * (-(-width >> bits)) + (at % width >> bits)]
    red, green, blue = _signed(pixels >> 16), _signed(pixels >> 8), _signed(pixels)
    to_red, green_blue, red_blue = _signed(own), _signed(own >> 8), _signed(own >> 16)
    new_red = red + sign * (to_red * green >> 5)
    true_red = _signed(new_red) if sign > 0 else red
    new_blue = blue + sign * ((green_blue * green >> 5) + (red_blue * true_red >> 5))
    return (pixels & 0xFF00FF00) | (new_red & 255).astype(np.uint32) << np.uint32(16) | (new_blue & 255).astype(np.uint32)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    red, blue = (pixels >> np.uint32(16) & np.uint32(255)).astype(np.int64) + sign * green, (pixels & np.uint32(255)).astype(np.int64) + sign * green
    return (pixels & np.uint32(0xFF00FF00)) | ((red & 255) << 16 | blue & 255).astype(np.uint32)


def _index_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """The pixels (height x width, ARGB as unsigned 32-bit) of the file at the start of the data, and its length."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    end = 8 + struct.unpack("<I", data[4:8])[0]
    size = struct.unpack("<I", data[16:20])[0]
    r = _Reader(data[20 : 20 + size])
    if r.read(8) != 0x2F:
        raise ValueError("not a lossless bitstream")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("unknown version")
    transforms, across = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (t[0] for t in transforms):
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            transforms.append((kind, across, bits, _read_image(r, -(-across >> bits), -(-height >> bits), False)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            colours = [0]
            for step in _read_image(r, n, 1, False):
                colours.append(_add(colours[-1], step))
            transforms.append((kind, across, _index_bits(n), colours[1:]))
            across = -(-across >> _index_bits(n))
        else:
            transforms.append((kind, across, 0, []))
    pixels = np.array(_read_image(r, across, height, True), np.uint32)
    for kind, wide, bits, own in reversed(transforms):
        if kind == PREDICTOR:
            pixels = np.array(_unpredict(pixels.tolist(), wide, bits, own), np.uint32)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, wide, bits, np.array(own, np.uint32), 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            index = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
            each = 8 >> bits
            split = np.stack([index >> (each * k) & ((1 << each) - 1) for k in range(1 << bits)], axis=2).reshape(height, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(own)] = own
            pixels = table[split].ravel()
    return pixels.reshape(height, width), end + (end & 1)


# Encoding


class _Writer:
    def __init__(self):
        self.bits, self.n = 0, 0

    def write(self, value: int, n: int) -> None:
        self.bits |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.bits.to_bytes(-(-self.n // 8), "little")


def _write_code(w: _Writer, lengths: list[int]) -> None:
    w.write(*_code_bits(tuple(lengths)))


@functools.lru_cache(maxsize=16)
def _code_bits(lengths: tuple[int, ...]) -> tuple[int, int]:
    """The bits that store a prefix code, and their number."""
    w = _Writer()
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        w.write(0b101, 3)  # simple, one symbol, of 8 bits
        w.write(used[0] if used else 0, 8)
        return w.bits, w.n
    runs, at = [], 0
    while at < len(lengths):
        if lengths[at]:
            runs.append((lengths[at], 0, 0))
            at += 1
            continue
        end = at
        while end < len(lengths) and not lengths[end] and end - at < 138:
            end += 1
        zeros = end - at
        runs += [(18, zeros - 11, 7)] if zeros > 10 else [(17, zeros - 3, 3)] if zeros > 2 else [(0, 0, 0)] * zeros
        at = end
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = code_lengths(counts, 7)
    bits = {s: (code, n) for s, n, code in _codes(tuple(own))}
    if len(bits) == 1:
        bits = {s: (0, 0) for s in bits}
    stored = max(i + 1 for i, k in enumerate(LENGTH_ORDER) if own[k] or i < 4)
    w.write(0, 1)
    w.write(stored - 4, 4)
    for k in LENGTH_ORDER[:stored]:
        w.write(own[k], 3)
    w.write(0, 1)
    for s, extra, n in runs:
        w.write(*bits[s])
        w.write(extra, n)
    return w.bits, w.n


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def _back_references(pixels: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, distance) of greedy matches with the last place of the same two pixels."""
    found, last, at, n = [], {}, 0, len(pixels)
    while at < n - 1:
        pair = (pixels[at], pixels[at + 1])
        before, length = last.get(pair), 0
        last[pair] = at
        if before is not None:
            length = 2
            while length < 4096 and at + length < n and pixels[before + length] == pixels[at + length]:
                length += 1
        if length >= 3:
            found.append((at, length, at - before))
            at += length
        else:
            at += 1
    return found


def _write_literals(w: _Writer, pixels: np.ndarray) -> bytes:
    """Codes and pixels without references, whole arrays at a time; ends the stream."""
    channels = pixels.astype("<u4").view(np.uint8).reshape(-1, 4)
    value, width = np.zeros(len(pixels), np.uint64), np.zeros(len(pixels), np.uint64)
    for k in (1, 2, 0, 3):  # green, red, blue, alpha
        own = channels[:, k]
        lengths = code_lengths(np.bincount(own, minlength=256).tolist(), 12)
        _write_code(w, lengths + [0] * (24 if k == 1 else 0))
        if sum(map(bool, lengths)) > 1:
            code, size = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
            for s, n, bits in _codes(tuple(lengths)):
                code[s], size[s] = bits, n
            value |= code[own] << width
            width += size[own]
    _write_code(w, [])
    begin = np.uint64(w.n) + np.cumsum(width) - width
    word, shift = (begin >> np.uint64(6)).astype(np.int64), begin & np.uint64(63)
    out = np.zeros(int(begin[-1] + width[-1]) // 64 + 2, np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
    over = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    out[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
    head = w.bits.to_bytes(-(-w.n // 64) * 8, "little")
    out[: len(head) // 8] |= np.frombuffer(head, "<u8")
    return out.tobytes()[: -(-int(begin[-1] + width[-1]) // 8)]


def _write_image(w: _Writer, pixels: list[int], top: bool, cache_bits: int = 0, references: bool = False) -> None:
    """Pixels with optional back-references and colour cache."""
    w.write(1 | cache_bits << 1, 5) if cache_bits else w.write(0, 1)
    if top:
        w.write(0, 1)
    at, symbols, cache = 0, [], {}
    matches = {s: (n, d) for s, n, d in _back_references(pixels)} if references else {}
    while at < len(pixels):
        if at in matches:
            length, distance = matches[at]
            symbols.append((None, _prefix(length), _prefix(distance + 120)))
            step = length
        else:
            p = pixels[at]
            slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            symbols.append((280 + slot,) if cache_bits and cache.get(slot, 0) == p else _parts(p))
            step = 1
        if cache_bits:
            for p in pixels[at : at + step]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += step
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[0] * n for n in sizes]
    for s in symbols:
        if len(s) == 4:
            for k, v in zip((3, 1, 0, 2), s, strict=True):
                counts[k][v] += 1
        elif len(s) == 3:
            counts[0][256 + s[1][0]] += 1
            counts[4][s[2][0]] += 1
        else:
            counts[0][s[0]] += 1
    codes = []
    for own in counts:
        lengths = code_lengths(own, 15)
        _write_code(w, lengths)
        made = {s: (bits, n) for s, n, bits in _codes(tuple(lengths))}
        codes.append(made if len(made) > 1 else dict.fromkeys(made, (0, 0)))
    written = []
    for begin in range(0, len(symbols), 256):
        own = _Writer()
        for s in symbols[begin : begin + 256]:
            if len(s) == 4:
                a, r, g, b = s
                for k, v in ((0, g), (1, r), (2, b), (3, a)):
                    own.write(*codes[k][v])
            elif len(s) == 3:
                own.write(*codes[0][256 + s[1][0]])
                own.write(*s[1][1:])
                own.write(*codes[4][s[2][0]])
                own.write(*s[2][1:])
            else:
                own.write(*codes[0][s[0]])
        written.append((own.bits, own.n))
    while len(written) > 1:  # neighbours in pairs, so that long numbers are copied seldom
        written = [(x[0][0] | x[1][0] << x[0][1], x[0][1] + x[1][1]) if len(x) == 2 else x[0] for x in (written[i : i + 2] for i in range(0, len(written), 2))]
    w.write(*written[0])


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, block_bits: int = 2, mode=lambda x, y: (x + y) % 14) -> bytes:
    """A lossless file of a height x width ARGB array.

    transforms: applied in this order. mode: the predictor of a block. Without cache or
    references the pixels are written whole arrays at a time.
    """
    height, width = pixels.shape
    if not 1 <= width <= MAX_SIDE or not 1 <= height <= MAX_SIDE:
        raise ValueError("too large for one image")
    w = _Writer()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 4)  # alpha used, version 0
    flat, across = pixels.ravel().astype(np.uint32), width
    for kind in transforms:
        w.write(1 | kind << 1, 3)
        wide, high = -(-across >> block_bits), -(-height >> block_bits)
        if kind == PREDICTOR:
            modes = [OPAQUE | mode(x, y) << 8 for y in range(high) for x in range(wide)]
            true = flat.tolist()
            flat = np.array([_subtract(p, _prediction(true, i % across, i, across, modes[(i // across >> block_bits) * wide + (i % across >> block_bits)] >> 8 & 15)) for i, p in enumerate(true)], np.uint32)
            w.write(block_bits - 2, 3)
            _write_image(w, modes, False)
        elif kind == CROSS_COLOUR:
            elements = np.array([OPAQUE | (17 * x + 5 * y & 255) << 16 | (29 * y + 200 & 255) << 8 | (x + 240 & 255) for y in range(high) for x in range(wide)], np.uint32)
            flat = _cross(flat, across, block_bits, elements, -1)
            w.write(block_bits - 2, 3)
            _write_image(w, elements.tolist(), False)
        elif kind == SUBTRACT_GREEN:
            flat = _green(flat, -1)
        else:
            colours, index = np.unique(flat, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.write(len(colours) - 1, 8)
            listed = colours.tolist()
            _write_image(w, [_subtract(b, a) for a, b in zip([0, *listed], listed, strict=False)], False)
            bits = _index_bits(len(colours))
            rows = np.pad(index.reshape(height, across), ((0, 0), (0, -across % (1 << bits))))
            across = rows.shape[1] >> bits
            packed = sum(rows[:, k :: 1 << bits] << ((8 >> bits) * k) for k in range(1 << bits))
            flat = (np.uint32(OPAQUE) | packed.ravel().astype(np.uint32) << np.uint32(8)).astype(np.uint32)
    w.write(0, 1)
    if cache_bits or references:
        _write_image(w, flat.tolist(), True, cache_bits, references)
        data = w.bytes()
    else:
        w.write(0, 2)  # no cache, one group of codes
        data = _write_literals(w, flat)
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
