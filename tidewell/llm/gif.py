"""Media columns: GIF files with LZW code streams, palettes, disposal, transparency and timed frames.

decode() reads any GIF87a or GIF89a: logical screen, global and local palettes, interlaced frames, graphic
control (delay, disposal, transparent index), and gives composed RGBA frames with their times. encode() stores
8-bit samples losslessly as palette indices under a grey palette, in frames of WIDTH x HEIGHT at most.

Defined results: payload of a null text is empty, padded like any other; equal texts give equal files. A stream
that ends early, or codes beyond the table, raise ValueError; frames() gives the frames before it and then a row
with `error` set. Null media has neither. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, documents, flat, once, released, stored

UNIT, WIDTH, HEIGHT, DELAY = 192, 192, 4096, 4
#: Colours per channel of a histogram column.
BINS = 4
_GREY = bytes(c for i in range(256) for c in (i, i, i))


def pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths, least bits first. Codes are 3 bits at least, so bytes are joined in three turns."""
    ends = np.cumsum(widths)
    at = ends - widths
    out = np.zeros(int(ends[-1]) // 8 + 4, np.uint8)
    value, place = codes << (at & 7), at >> 3
    for turn in range(3):  # of each three codes one, so that no two of a turn share a byte
        own, byte = value[turn::3], place[turn::3]
        for k in range(3):
            out[byte + k] |= (own >> 8 * k & 255).astype(np.uint8)
    return out[: (int(ends[-1]) + 7) // 8].tobytes()


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """GIF's LZW: a clear code first and when the table is full, an end code last."""
    clear = 1 << size
    table, next_code, out = {}, clear + 2, [clear]
    add, get = out.append, table.get
    if data:
        prefix = data[0]
        for c in memoryview(data)[1:]:
            key = prefix << 8 | c
            code = get(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            if next_code < 4096:
                table[key] = next_code
                next_code += 1
            else:
                add(clear)
                table.clear()
                next_code = clear + 2
            prefix = c
        add(prefix)
    add(clear + 1)
    codes = np.array(out, np.int64)
    # A code's width follows from how many codes stand between it and the clear code before it.
    starts = np.flatnonzero(codes == clear)
    since = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) - 1
    known = clear + 2 + np.maximum(since - 1, 0)  # entries that a reader has then
    width = np.clip(np.ceil(np.log2(known + 0.5)).astype(np.int64), size + 1, 12)
    width[starts[1:]] = 12
    width[0] = size + 1
    return pack(codes, width)


def code_widths(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bits before each."""
    known = (1 << size) + 2 + np.maximum(np.arange(1 << 12) - 1, 0)
    grow = np.clip(np.ceil(np.log2(known + 0.5)).astype(np.int64), size + 1, 12)
    return grow, np.concatenate([[0], np.cumsum(grow)])


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """The samples of a code stream, at most `most` of them."""
    clear = 1 << size
    raw = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    wide, length = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16, 8 * len(stream)
    grow, after = once(("lzw", size), lambda: code_widths(size))
    letters = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, held, at = [], 0, 0
    while True:
        # All codes up to the next clear or end code, read at once: their widths are known beforehand.
        room = int(np.searchsorted(after, length - at, side="right")) - 1
        run: list[int] = []
        ended = None
        base = at
        k = 0
        while ended is None:
            step = 4096 if k >= 4096 else 4096 - k if k else 512
            if k < 4096:
                idx = np.arange(k, min(k + step, room))
                pos, wid = base + after[idx], grow[idx]
            else:  # a full table without a clear code: all further codes have 12 bits
                pos = base + after[4096] + 12 * np.arange(k - 4096, k - 4096 + step)
                pos = pos[pos + 12 <= length]
                wid = np.full(len(pos), 12)
            if not len(pos):
                raise ValueError("the code stream ends early")
            codes = wide[pos >> 3] >> (pos & 7) & (1 << wid) - 1
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop):
                s = int(stop[0])
                run += codes[:s].tolist()
                at = int(pos[s] + wid[s])
                ended = codes[s] == clear + 1
            else:
                run += codes.tolist()
                k += len(codes)
        table = letters.copy()
        known, last = len(table), b""
        for c in run:
            # An entry is the string of the code before it and the first sample of the next.
            if c < known:
                entry = table[c]
                if not entry:
                    raise ValueError(f"code {c} isn't a sample")
            elif c == known < 4096 and last:
                entry = last + last[:1]
            else:
                raise ValueError(f"code {c} isn't in the table")
            if last and known < 4096:
                table.append(last + entry[:1])
                known += 1
            out.append(entry)
            last = entry
        held += sum(map(len, out[len(out) - len(run) :]))
        if held > most:
            raise ValueError("more samples than the frame holds")
        if ended:
            return b"".join(out)


def blocks(data: bytes) -> bytes:
    """Data in sub-blocks of 255 bytes, closed by an empty one."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes, width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """A GIF89a whose frames hold the samples, a multiple of width, as palette indices."""
    rows = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), _GREY]
    for at in range(0, rows, height):
        part = samples[at * width : (at + height) * width]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0), b"\x08", blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)


def images(data: bytes) -> Iterator[dict]:
    """Each frame as stored: place, size, samples, palette, transparent index, disposal, delay."""
    r = Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    screen = r.unpack("<HHBBB")
    common = r.take(3 << ((screen[2] & 7) + 1)) if screen[2] & 0x80 else b""
    delay, disposal, clear = 0, 0, None
    while (kind := r.take(1)[0]) != 0x3B:
        if kind == 0x21:
            label, body = r.take(1)[0], r.blocks()
            if label == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = flags >> 2 & 7, index if flags & 1 else None
        elif kind == 0x2C:
            x, y, w, h, flags = r.unpack("<HHHHB")
            palette = r.take(3 << ((flags & 7) + 1)) if flags & 0x80 else common
            size = r.take(1)[0]
            if not 1 <= size <= 8:
                raise ValueError("a code size out of range")
            samples = lzw_decode(r.blocks(), size, w * h)
            if len(samples) < w * h:
                raise ValueError("fewer samples than the frame holds")
            if flags & 0x40:
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                grid = np.frombuffer(samples, np.uint8).reshape(h, w)
                back = np.empty_like(grid)
                back[order] = grid
                samples = back.tobytes()
            yield {"screen": screen[:2], "box": (x, y, w, h), "samples": samples, "palette": palette, "clear": clear, "disposal": disposal, "delay": delay}
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError(f"block {kind} is unknown")


def composed(found: Iterator[dict]) -> Iterator[tuple[dict, int, np.ndarray]]:
    """Each stored frame with its start in hundredths of a second and the RGBA canvas that it leaves; the canvas is the next frame's too."""
    canvas, time = None, 0
    for f in found:
        (w, h), (x, y, fw, fh) = f["screen"], f["box"]
        if canvas is None:
            canvas = np.zeros((max(h, y + fh), max(w, x + fw), 4), np.uint8)
        grown = max(canvas.shape[0], y + fh), max(canvas.shape[1], x + fw)
        if grown != canvas.shape[:2]:
            canvas = np.pad(canvas, ((0, grown[0] - canvas.shape[0]), (0, grown[1] - canvas.shape[1]), (0, 0)))
        before = canvas.copy() if f["disposal"] == 3 else None
        index = np.frombuffer(f["samples"], np.uint8).reshape(fh, fw)
        palette = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(f["palette"], np.uint8).reshape(-1, 3)
        palette[: len(colours), :3], palette[:, 3] = colours, 255
        if f["clear"] is None:
            canvas[y : y + fh, x : x + fw] = palette[index]
        else:
            drawn = index != f["clear"]
            canvas[y : y + fh, x : x + fw][drawn] = palette[index][drawn]
        yield f, time, canvas
        time += f["delay"]
        if f["disposal"] == 2:
            canvas[y : y + fh, x : x + fw] = 0
        elif f["disposal"] == 3:
            canvas = before


def decode(data: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start and length in hundredths of a second, and the composed RGBA canvas of each frame."""
    for f, start, canvas in composed(images(data)):
        yield start, f["delay"], canvas.copy()


def colours(rgba: np.ndarray) -> np.ndarray:
    """The number of pixels, those that are transparent left out, of each of BINS^3 colours."""
    flat = rgba.reshape(-1, 4)
    if not flat[:, 3].all():
        flat = flat[flat[:, 3] > 0]
    bins = flat[:, 0].astype(np.int32) * BINS // 256
    for k in (1, 2):
        bins = bins * BINS + flat[:, k].astype(np.int32) * BINS // 256
    return np.bincount(bins, minlength=BINS**3)


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Share of each of BINS^3 colours among the pixels that aren't transparent."""
    n = colours(rgba)
    return n / max(1, n.sum())


def frames(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each frame: key, frame, start_cs, delay_cs, width, height, rgba, histogram, error."""
    kind = media.schema[key].dataType.simpleString()

    names = ["key", "frame", "start_cs", "delay_cs", "width", "height", "rgba", "histogram", "error"]
    types = [*[pa.int64()] * 5, pa.binary(), pa.list_(pa.float64()), pa.string()]

    def row(own: pa.Array, *values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own, *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.column("key").slice(k, 1)
                data = b.column("media")[k].as_py()
                if data is None:
                    continue
                try:  # frame by frame, as each holds a whole canvas
                    for i, (start, delay, rgba) in enumerate(decode(data)):
                        yield row(own, i, start, delay, rgba.shape[1], rgba.shape[0], rgba.tobytes(), histogram(rgba).tolist(), None)
                except ValueError as e:
                    yield row(own, *[None] * 7, str(e))

    out = media.select(F.col(key).alias("key"), F.col(column).alias("media")).mapInArrow(released(run), f"key {kind}, frame long, start_cs long, delay_cs long, width long, height long, rgba binary, histogram array<double>, error string")
    return out.withColumnRenamed("key", key)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's padded bytes as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column("text"))
            raw, size = data.tobytes(), np.diff(offsets)
            media = []
            for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                media.append(encode(raw[a:z] + b" " * (max(UNIT, -(-(z - a) // UNIT) * UNIT) - (z - a))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """What the stored files give when they're read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column("media").to_pylist():
                payload, delays, seen = hashlib.sha256(), [], np.zeros(BINS**3, np.int64)
                total, tail = 0, b""
                for f, _, canvas in composed(images(m)):
                    payload.update(f["samples"])
                    total += len(f["samples"])
                    tail = (tail + f["samples"][-16:])[-16:]
                    delays.append(f["delay"])
                    seen += colours(canvas[: f["box"][3]])
                # Colours that occur, by number of their bin, summed over the frames as they are composed.
                shown = ",".join(f"{i}:{seen[i]}" for i in np.flatnonzero(seen).tolist())
                feature = f"gif:frames={len(delays)}:cs={sum(delays)}:colours={shown}"
                rows.append((total, payload.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(released(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(store(documents(spark, sf_dir, "doc_id", "text")), "media"))
