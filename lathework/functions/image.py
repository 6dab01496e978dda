"""JPEG headers and average-luma grids of binary columns, by small pandas UDFs."""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The blocks of luma of an image that has a grid, and the bytes of an image that goes into a request, at most.
MAX_BLOCKS, MAX_BYTES = 1_000_000, 8 << 20
# Start-of-frame markers; markers without a length.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
ALONE = {0x01, 0xD9, *range(0xD0, 0xD8)}


def readable(content: Column) -> Column:
    """Content up to the size limit; null beyond it."""
    return F.when(F.octet_length(content) <= MAX_BYTES, content)


def inline(data: Column, file: Column) -> Column:
    """The bytes of an image: its own if it has any, else those of its file up to the size limit; null where there are none."""
    return F.coalesce(F.when(F.octet_length(data) > 0, data), F.when(F.octet_length(file) > 0, readable(file)))


def _segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start and end of its payload), up to the scan; errors come as ValueError."""
    if len(data) < 4:
        raise ValueError("not-a-jpeg")
    if data[:2] != b"\xff\xd8":
        raise ValueError("no-soi")
    at, n = 2, len(data)
    while at < n - 1:
        if data[at] != 0xFF:
            raise ValueError("bad-marker")
        while at < n and data[at] == 0xFF:
            at += 1
        if at >= n:
            raise ValueError("truncated")
        marker, at = data[at], at + 1
        if marker in ALONE:
            continue
        if marker == 0xDA and at + 2 > n:
            yield marker, at, at
            return
        if at + 2 > n:
            raise ValueError("truncated-len")
        size = int.from_bytes(data[at : at + 2])
        if size < 2 and marker != 0xDA:
            raise ValueError("bad-segment-length")
        if marker in FRAMES and size < 8:
            raise ValueError("bad-sof-length")
        if at + size > n and marker != 0xDA:
            raise ValueError("truncated")
        yield marker, at + 2, at + size
        at += size


def dims(data: bytes | None) -> tuple[int | None, int | None, str | None]:
    """Width, height and error of the outer frame; embedded pictures are skipped with their segment."""
    try:
        for marker, a, _ in _segments(data or b""):
            if marker == 0xDA:
                return None, None, "sos-before-sof"
            if marker in FRAMES:
                return int.from_bytes(data[a + 3 : a + 5]), int.from_bytes(data[a + 1 : a + 3]), None
        return None, None, "no-sof"
    except ValueError as e:
        return None, None, str(e)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For any 16 bits: the length of the code that they begin with, and its symbol in the low byte; 0 if there is none."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at, code = at + n, 2 * code
    return table


def _strides(table: np.ndarray) -> np.ndarray:
    """For any 16 bits: as many whole AC steps as they begin with: bits to go on, places to go on (from bit 8), block ended (bit 16)."""
    bits = np.arange(1 << 16)
    went, places, ended = np.zeros_like(bits), np.zeros_like(bits), np.zeros(len(bits), bool)
    while True:
        step = table[(bits << np.minimum(went, 16)) & 0xFFFF]
        length, symbol = step >> 8, step & 0xFF
        go = ~ended & (length > 0) & (went + length <= 16)
        if not go.any():
            return went | places << 8 | ended << 16
        size = symbol & 15
        last = go & (size == 0) & (symbol != 0xF0)
        on = go & ~last
        went += np.where(go, length + size, 0)
        places += np.where(on, (symbol >> 4) + 1, 0)
        ended |= last


def _tables(data: bytes, a: int, b: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(kind, lookup, strides) of the code tables in a segment."""
    while a < b:
        n = sum(data[a + 1 : a + 17])
        table = _lookup(data[a + 1 : a + 17], data[a + 17 : a + 17 + n])
        yield data[a], table.tolist(), _strides(table).tolist() if data[a] >= 16 else []
        a += 17 + n


#: A restart marker, and a marker of any other kind, inside a scan.
RESTART, MARKER = re.compile(rb"\xff+[\xd0-\xd7]"), re.compile(rb"\xff(?!\x00)", re.S)


def _stretches(data: bytes, at: int) -> list[bytes]:
    """The scan between restart markers, without stuffed zeros; it ends at any other marker."""
    out = []
    while True:
        end, restart = MARKER.search(data, at), RESTART.search(data, at)
        on = restart is not None and restart.start() == end.start()
        out.append(data[at : end.start() if end else len(data)].replace(b"\xff\x00", b"\xff"))
        if not on:
            return out
        at = restart.end()


def grid(data: bytes | None) -> list[float] | None:
    """Means of the blocks' DC luma over 8 by 8 rectangles; null for all but whole baseline JPEGs."""
    frame, huffman, interval = None, {}, 0
    try:
        for marker, a, b in _segments(data or b""):
            if marker == 0xC0:
                frame = data[a:b]
            elif marker == 0xC4:
                huffman.update((kind, both) for kind, *both in _tables(data, a, b))
            elif marker == 0xDD:
                interval = int.from_bytes(data[a : a + 2])
            elif marker == 0xDA:
                return box_means(_luma(data, frame, huffman, interval, a, b)).ravel().tolist()
    except (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError):
        pass
    return None


def _luma(data: bytes, frame: bytes, huffman: dict, interval: int, a: int, b: int) -> np.ndarray:
    height, width = int.from_bytes(frame[1:3]), int.from_bytes(frame[3:5])
    parts = [(frame[i], frame[i + 1] >> 4, frame[i + 1] & 15) for i in range(6, 6 + 3 * frame[5], 3)]
    chosen = {data[i]: data[i + 1] for i in range(a + 1, a + 1 + 2 * data[a], 2)}
    if tuple(data[b - 3 : b]) != (0, 63, 0):
        raise ValueError("progressive")
    h, v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    lh, lv = parts[0][1:]
    if not 1 <= across * lh * down * lv <= MAX_BLOCKS:
        raise ValueError("size")
    stretches = _stretches(data, b)
    total, values = across * down, []  # luma levels in the order of the scan
    codes = [(*huffman[chosen[name] >> 4][:1], *huffman[16 + (chosen[name] & 15)], ch * cv) for name, ch, cv in parts]
    each = min(interval or total, total)
    for k, first in enumerate(range(0, total, each)):
        data, last = stretches[k], first + each >= total
        pad = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
        ahead = memoryview(pad[:-2] << 16 | pad[1:-1] << 8 | pad[2:])  # 24 bits from each byte on
        at, end, before = 0, 8 * len(data), [0] * len(parts)
        for _ in range(min(each, total - first)):
            for c, (dc, ac, strides, blocks) in enumerate(codes):
                for _ in range(blocks):
                    code = dc[ahead[at >> 3] >> 8 - (at & 7) & 0xFFFF]
                    if not code:
                        raise IndexError
                    at += code >> 8
                    size = code & 0xFF
                    if size:
                        raw = (ahead[at >> 3] >> 8 - (at & 7) & 0xFFFF) >> 16 - size
                        at += size
                        before[c] += raw if raw >> size - 1 else raw - (1 << size) + 1
                    if c == 0:
                        values.append(before[0])
                    n = 1
                    while n < 64:
                        bits = ahead[at >> 3] >> 8 - (at & 7) & 0xFFFF
                        stride = strides[bits]
                        if n + (stride >> 8 & 0xFF) < 64 and stride:
                            at += stride & 0xFF
                            if stride >> 16:
                                break
                            n += stride >> 8
                            continue
                        code = ac[bits]  # the block ends within the stride: one step at a time
                        if not code:
                            raise IndexError
                        at += (code >> 8) + (code & 15)
                        if not code & 15 and code & 0xFF != 0xF0:
                            break
                        n += (code >> 4 & 15) + 1
                    if at > end:
                        raise IndexError
        if not last and (at + 7) // 8 != len(data):
            raise IndexError
    field = np.array(values, np.float64).reshape(down, across, lv, lh)
    return field.transpose(0, 2, 1, 3).reshape(down * lv, across * lh)


def box_means(field: np.ndarray, rows: int = 8, cols: int = 8) -> np.ndarray:
    """Means over rows by cols rectangles with whole edges, rounded down; a field of fewer cells is repeated. Sums come from a summed-area table."""
    table = np.zeros((field.shape[0] + 1, field.shape[1] + 1))
    table[1:, 1:] = field.cumsum(axis=0).cumsum(axis=1)

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(parts) * n // parts
        return low, np.maximum((np.arange(parts) + 1) * n // parts, low + 1)

    (y0, y1), (x0, x1) = edges(field.shape[0], rows), edges(field.shape[1], cols)
    sums = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return sums / np.outer(y1 - y0, x1 - x0)


def _dims_of(content: pd.Series) -> pd.DataFrame:
    rows = [dims(x) for x in content]
    return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=t) for i, (k, t) in enumerate((("width", "Int32"), ("height", "Int32"), ("err", object)))})


def _grids_of(content: pd.Series) -> pd.Series:
    return pd.Series([grid(x) for x in content])


def jpeg_dims(content: Column) -> Column:
    """(width, height, err) of each image."""
    return F.pandas_udf(_dims_of, "width int, height int, err string")(content)


def luma_grid(content: Column) -> Column:
    """The 64 cells of each image's grid, or null."""
    return F.pandas_udf(_grids_of, "array<double>")(content)


def _flat_scan(level: int) -> str:
    """The scan of one block of a level from 0 to 7, in hexadecimal digits."""
    size = level.bit_length()
    code = ("00", "01", "10", "110")[size] + (format(level, "b") if size else "") + "0"
    return format(int(code.ljust(8, "1"), 2), "02X")


def flat_jpeg(level: Column) -> Column:
    """A grey picture of one block at a level from 0 to 7."""
    dc = "FFC4" + "0017" + "00" + "00030100" + "00" * 12 + "00010203"
    ac = "FFC4" + "0014" + "10" + "01" + "00" * 15 + "00"
    head = "FFD8" + "FFC0" + "000B08" + "00080008" + "01" + "011100" + dc + ac + "FFDA" + "0008" + "01" + "0100" + "003F00"
    scans = F.array(*(F.lit(_flat_scan(i)) for i in range(8)))
    return F.unhex(F.concat(F.lit(head), F.element_at(scans, (level + 1).cast("int")), F.lit("FFD9")))
