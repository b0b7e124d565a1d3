"""GIF as a media column: LZW code streams, palettes, interlace, disposal, transparency, timed frames.

``write_gif`` stores 8-bit samples, ``read_gif`` decodes any GIF87a/89a stream, ``composite`` applies disposal
and transparency to give each frame as shown, and ``histogram`` counts its colours. Bytes of any kind become
samples of an identity grey palette, 64 to a row, in frames of at most ``ROWS`` rows, so they come back exactly.

Defined results: a null text is stored as the empty one, which is 64 zero samples; equal texts give equal
streams. A damaged stream raises ValueError. A table without rows gives one without rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftcorpus.llm.shared import text_bytes

WIDTH, ROWS, DELAY_CS, MAX_CODES = 64, 1024, 4, 4096
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # height x width indices
    palette: np.ndarray  # n x 3
    delay_cs: int = 0
    disposal: int = 0  # 0, 1: leave; 2: clear to background; 3: restore what was before
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int = 0
    frames: list[Frame] = field(default_factory=list)


# ---------------------------------------------------------------------------------------------- code streams
def widths(count: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, bits): how wide the codes after a clear code are, the first of them being number 1.

    After m codes a decoder's table is filled up to 2**size + m, so code m takes as many bits as that has.
    """
    first, base = 1, 1 << size
    bits = size + 1
    while first <= count:
        last = count if bits == 12 else min(count, (1 << bits) - base - 1)
        if last >= first:
            yield first, last, bits
        first, bits = last + 1, bits + 1


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples below 2**size, starting with a clear code and ending with an end code."""
    clear, end = 1 << size, (1 << size) + 1
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    get, emit = table.get, codes.append
    free = end + 1
    if data:
        prefix = data[0]
        for sample in memoryview(data)[1:]:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            prefix = sample
            if free < MAX_CODES:
                table[key] = free
                free += 1
            else:
                emit(clear)
                segments.append(codes)
                codes, free = [], end + 1
                table.clear()
                emit = codes.append
        emit(prefix)
    emit(end)
    segments.append(codes)
    bits = [np.unpackbits(np.array([clear], "<u2").view(np.uint8), bitorder="little")[: size + 1]]
    for segment in segments:
        values = np.array(segment, "<u2")
        for first, last, wide in widths(len(values), size):
            part = values[first - 1 : last]
            bits.append(np.unpackbits(part.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :wide].ravel())
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def code_segments(stream: bytes, size: int) -> Iterator[np.ndarray]:
    """The codes between clear codes, up to the end code."""
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    clear, end, at = 1 << size, (1 << size) + 1, 0
    while True:
        parts, stop = [], None
        for first, last, wide in widths(1 << 62, size):
            left = (len(bits) - at) // wide
            take = min(last - first + 1, left, 1 << 14 if wide == 12 else 1 << 62)
            while take > 0:
                grid = np.zeros((take, 16), np.uint8)
                grid[:, :wide] = bits[at : at + take * wide].reshape(take, wide)
                codes = np.packbits(grid, axis=1, bitorder="little").view("<u2").ravel()
                marks = np.flatnonzero((codes == clear) | (codes == end))
                if len(marks):
                    stop = codes[marks[0]]
                    parts.append(codes[: marks[0]])
                    at += (int(marks[0]) + 1) * wide
                    break
                parts.append(codes)
                at += take * wide
                left -= take
                take = min(left, 1 << 14) if wide == 12 else 0
            if stop is not None:
                break
            if left <= 0 or wide == 12:
                raise ValueError("the code stream ends without an end code")
        yield np.concatenate(parts)
        if stop == end:
            return


def lzw_decode(stream: bytes, size: int) -> bytes:
    """The samples of a code stream."""
    single = [bytes([i]) if i < 1 << size else b"" for i in range((1 << size) + 2)]
    out: list[bytes] = []
    put = out.append
    for codes in code_segments(stream, size):
        if not len(codes):
            continue
        table = single.copy()
        add = table.append
        listed = codes.tolist()
        if listed[0] >= 1 << size:
            raise ValueError("a code stream starts with a code that is not defined")
        known = listed[0]
        before = table[known]
        put(before)
        free = len(table)
        for code in listed[1:]:
            if code < free:
                entry = table[code]
            elif code == free and free < MAX_CODES:
                entry = before + before[:1]
            else:
                raise ValueError("a code is not defined yet")
            put(entry)
            if free < MAX_CODES:
                add(before + entry[:1])
                free += 1
            before = entry
    return b"".join(out)


# ------------------------------------------------------------------------------------------------ containers
def blocks(data: bytes) -> bytes:
    parts = []
    for at in range(0, len(data), 255):
        part = data[at : at + 255]
        parts += [bytes([len(part)]), part]
    return b"".join([*parts, b"\0"])


def palette_bits(palette: np.ndarray) -> int:
    return max(1, int(len(palette) - 1).bit_length())


def padded(palette: np.ndarray) -> bytes:
    full = np.zeros((1 << palette_bits(palette), 3), np.uint8)
    full[: len(palette)] = palette
    return full.tobytes()


def write_gif(gif: Gif, shared: np.ndarray | None = None) -> bytes:
    """GIF89a; frames whose palette is ``shared`` use the global table."""
    flags = 0x80 | 0x70 | (palette_bits(shared) - 1) if shared is not None else 0x70
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, flags, gif.background, 0)]
    if shared is not None:
        out.append(padded(shared))
    for f in gif.frames:
        see_through = f.transparent is not None
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | see_through, f.delay_cs, f.transparent or 0, 0))
        own = f.palette is not shared
        high, wide = f.samples.shape
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, wide, high, (0x80 | (palette_bits(f.palette) - 1)) if own else 0))
        if own:
            out.append(padded(f.palette))
        size = max(2, palette_bits(f.palette))
        out += [bytes([size]), blocks(lzw_encode(f.samples.tobytes(), size))]
    return b"".join([*out, b";"])


def row_order(height: int) -> np.ndarray:
    """Where the rows of an interlaced frame go."""
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes) -> Gif:
    """Frames with their indices, palettes, delays, disposal and transparency; comments and the like are skipped."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def table(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    if flags & 0x80:
        shared, at = table(at, flags)
    gif, delay, disposal, transparent = Gif(width, height, background), 0, 0, None
    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                if data[at + 1] == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
                _, at = joined(at + 2)
            elif data[at] == 0x2C:
                left, top, wide, high, flags = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                palette = shared
                if flags & 0x80:
                    palette, at = table(at, flags)
                if palette is None:
                    raise ValueError("a frame has no palette")
                size = data[at]
                stream, at = joined(at + 1)
                samples = np.frombuffer(lzw_decode(stream, size), np.uint8)
                if len(samples) < wide * high:
                    raise ValueError("a frame has too few samples")
                samples = samples[: wide * high].reshape(high, wide)
                if flags & 0x40:
                    placed = np.empty_like(samples)
                    placed[row_order(high)] = samples
                    samples = placed
                gif.frames.append(Frame(left, top, samples, palette, delay, disposal, transparent))
                delay, disposal, transparent = 0, 0, None
            else:
                raise ValueError("an unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("the stream breaks off") from e
    return gif


def composite(gif: Gif) -> Iterator[np.ndarray]:
    """Each frame as shown: height x width x 4 (red, green, blue, 255 where anything has been drawn)."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        high, wide = f.samples.shape
        box = (slice(f.top, min(f.top + high, gif.height)), slice(f.left, min(f.left + wide, gif.width)))
        before = canvas[box].copy() if f.disposal == 3 else None
        view = canvas[box]
        samples = f.samples[: view.shape[0], : view.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3] = f.palette
        colours[: len(f.palette), 3] = 255
        drawn = colours[samples]
        if f.transparent is None:
            view[...] = drawn
        else:
            seen = samples != f.transparent
            view[seen] = drawn[seen]
        yield canvas
        if f.disposal == 2:
            canvas[box] = 0
        elif before is not None:
            canvas[box] = before


def histogram(shown: np.ndarray, bins: int = 4) -> np.ndarray:
    """Pixels by colour: bins a channel; those nothing was drawn on count for none."""
    step = 256 // bins
    q = (shown[..., :3] // step).astype(np.int64)
    cell = (q[..., 0] * bins + q[..., 1]) * bins + q[..., 2]
    return np.bincount(cell[shown[..., 3] > 0], minlength=bins**3)


# --------------------------------------------------------------------------------------------- media columns
def payload(text: str | None) -> bytes:
    """The text's UTF-8, with zero bytes up to a positive multiple of WIDTH."""
    raw = text_bytes(text)
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def store(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, rows[at : at + ROWS], GREY, DELAY_CS, 1) for at in range(0, len(rows), ROWS)]
    return write_gif(Gif(WIDTH, min(ROWS, len(rows)), 0, frames), GREY)


def restore(data: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """The bytes that store() has stored, the histogram of all shown frames, frames, duration in 1/100 s."""
    gif = read_gif(data)
    parts, total = [], np.zeros(64, np.int64)
    for f, shown in zip(gif.frames, composite(gif), strict=True):
        high = f.samples.shape[0]
        part = shown[:high]
        parts.append(part[..., 0].tobytes())
        total += histogram(part)
    return b"".join(parts), total, len(gif.frames), sum(f.delay_cs for f in gif.frames)


def to_gif(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """text -> GIF stream."""
    for batch in batches:
        yield pa.array([store(payload(t.as_py())) for t in batch], pa.binary())


READ_BACK = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,n_frames:int,duration_cs:int,grey_histogram:array<bigint>,feature:string>"


def from_gif(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """GIF stream of to_gif -> what it holds: digests of the samples, and features of the frames as shown."""
    for batch in batches:
        rows = []
        for cell in batch:
            media = cell.as_py()
            data, cells, frames, duration = restore(media)
            grey = cells[[0, 21, 42, 63]]
            used = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            share = used[used > 0] / len(data)
            entropy = float(-(share * np.log2(share)).sum())
            feature = f"frames={frames};cs={duration};grey={','.join(map(str, grey))};levels={len(share)};bits={entropy:.4f}"
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), frames, duration, grey.tolist(), feature))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_cs", "grey_histogram", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()]
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df and a column of GIF streams; a column of that name is replaced."""
    return df.withColumn(media, arrow_udf(to_gif, "binary")(F.coalesce(F.col(text), F.lit(""))))


def timed_frames(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each frame of any GIF: key, frame, start_cs, delay_cs, disposal, width, height, histogram (4x4x4)."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, cell in zip(batch.column(0), batch.column(1), strict=True):
                if not cell.is_valid:
                    continue
                gif, start, rows = read_gif(cell.as_py()), 0, []
                for i, (f, shown) in enumerate(zip(gif.frames, composite(gif), strict=True)):
                    rows.append((i, start, f.delay_cs, f.disposal, gif.width, gif.height, histogram(shown).tolist()))
                    start += f.delay_cs
                if rows:
                    columns = [list(c) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(rows), batch.schema.field(0).type), *(pa.array(c, pa.int32()) for c in columns[:6]), pa.array(columns[6], pa.list_(pa.int64()))],
                        ["key", "frame", "start_cs", "delay_cs", "disposal", "width", "height", "histogram"],
                    )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, media).mapInArrow(frames, f"key {kind}, frame int, start_cs int, delay_cs int, disposal int, width int, height int, histogram array<bigint>")


def media_features(text: Column) -> Column:
    """Stores each text as a GIF and reads it back: READ_BACK's struct."""
    return arrow_udf(from_gif, READ_BACK)(arrow_udf(to_gif, "binary")(F.coalesce(text, F.lit(""))))
