"""Motion-JPEG in AVI: bytes stored as grey frames and read back, and clips by adaptive histogram differences.

A frame holds 576 samples as 32 x 18 blocks of 8 x 8 pixels. A block is flat: its DC coefficient, quantised by 8, is
the sample, so any decoder of baseline JPEG shows the sample's value in all of its pixels and nothing is lost. The
Huffman table gives a difference of s bits a code of 15 - s bits and the end of a block one bit, so each block takes
16 bits; such scans are encoded and decoded by table over whole arrays. Other baseline frames, grey or with colour
planes of any sampling, of any size, are decoded symbol by symbol; shots are found on their luma. The reader follows
the RIFF chunks and the index.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACROSS, DOWN, UNIT, FPS = 32, 18, 576, 25
BINS = 16

#: Fixed value: the zigzag order of an 8 x 8 block, by its rule (diagonals in turns).
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Codes (value, bits) of symbols given as (bits, symbol) in order of growing length."""
    out, code, last = {}, 0, 0
    for n, symbol in lengths:
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


DC = [(15 - s, s) for s in range(8, -1, -1)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The 16 bits of each difference from -255 to 255, and back."""
    words, codes = [], canonical(DC)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, _ = codes[s]
        words.append((code << s | (d if d > 0 else d + (1 << s) - 1)) << 1)
    back = np.full(1 << 16, 1 << 14, np.int16)
    back[words] = np.arange(-255, 256)
    return np.array(words, ">u2"), back


WORDS, DIFFERENCES = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    return bytes([kind]) + bytes(sum(n == k for n, _ in lengths) for k in range(1, 17)) + bytes(s for _, s in lengths)


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _table(0x00, DC) + _table(0x10, [(1, 0)]))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def padded(text: str | None) -> tuple[int, bytes]:
    """The number of the text's bytes and these with bytes 255 up to a positive multiple of a frame."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (UNIT if not data else -len(data) % UNIT)


def write(payload: bytes) -> bytes:
    """An AVI file of the payload, a multiple of 576 bytes."""
    v = np.frombuffer(payload, np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
    n = len(v)
    d = np.diff(v, axis=1, prepend=np.int16(0))
    scan = WORDS[d + 255].view(np.uint8).reshape(n, -1)
    frame = np.frombuffer(struct.pack("<4sI", b"00dc", len(HEAD) + 2 * UNIT + 2) + HEAD, np.uint8)
    size = len(frame) + 2 * UNIT + 2
    movi = np.empty((n, size), np.uint8)
    movi[:, : len(frame)] = frame
    movi[:, len(frame) : -2] = scan
    movi[:, -2:] = (0xFF, 0xD9)
    index = np.empty((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # each frame stands alone
    index[:, 2] = 4 + size * np.arange(n)
    index[:, 3] = size - 8
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body
    main = struct.pack("<14I", 1_000_000 // FPS, size * FPS, 0, 0x10, n, 0, 1, size, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, size, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    picture = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 24, b"MJPG", ACROSS * DOWN * 64 * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    body = b"AVI " + header + struct.pack("<4sI4s", b"LIST", 4 + movi.size, b"movi") + movi.tobytes() + chunk(b"idx1", index.tobytes())
    return chunk(b"RIFF", body)


def frames(media: bytes) -> tuple[list[memoryview], float]:
    """The frames of a file by its index, and how many there are in a second. ValueError if it is no such file."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, rate = None, None, None
    todo = [(12, min(len(view), 8 + struct.unpack_from("<I", view, 4)[0]))]
    while todo:
        at, end = todo.pop(0)
        while at + 8 <= min(end, len(view)):
            name, size = struct.unpack_from("<4sI", view, at)
            if name == b"LIST":
                if view[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                rate = 1e6 / max(struct.unpack_from("<I", view, at + 8)[0], 1)
            elif name == b"idx1":
                index = np.frombuffer(view[at + 8 : at + 8 + size // 16 * 16], "<u4").reshape(-1, 4)
            at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    first = movi if len(index) and bytes(view[movi + int(index[0, 2]) :][:4]) == index[0, :1].tobytes() else 0
    video = np.array([bytes(x)[2:] in (b"dc", b"db") for x in np.unique(index[:, 0]).astype("<u4").view("V4")], bool)
    keep = video[np.searchsorted(np.unique(index[:, 0]), index[:, 0])]
    return [view[first + o + 8 : first + o + 8 + n] for o, n in index[keep, 2:].tolist()], rate or float(FPS)


def parse(frame: bytes) -> tuple[dict, int]:
    """Tables, size and planes of a baseline JPEG, and where its scan begins. ValueError if it is something else."""
    out: dict = {"quant": {}, "huffman": {}, "restart": 0, "planes": {}}
    if bytes(frame[:2]) != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = bytes(frame[at + 4 : at + 2 + size])
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols = body[17 : 17 + sum(counts)]
                lengths = [n for n, c in enumerate(counts, 1) for _ in range(c)]
                out["huffman"][body[0]] = list(zip(lengths, symbols))
                body = body[17 + len(symbols) :]
        elif marker == 0xC0:
            out["height"], out["width"], parts = struct.unpack(">HHB", body[:6][1:])
            if body[0] != 8:
                raise ValueError("only samples of 8 bits are read")
            for k in range(parts):
                name, sampling, table = body[6 + 3 * k : 9 + 3 * k]
                out["planes"][name] = {"across": sampling >> 4, "down": sampling & 15, "q": table}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if not out["planes"] or body[0] != len(out["planes"]):
                raise ValueError("only frames of one scan are read")
            for k in range(body[0]):
                name, tables = body[1 + 2 * k : 3 + 2 * k]
                out["planes"][name] |= {"dc": tables >> 4, "ac": 0x10 | tables & 15}
            if len(out["planes"]) == 1:  # a plane alone is not interleaved, whatever its sampling
                out["planes"] = {k: v | {"across": 1, "down": 1} for k, v in out["planes"].items()}
            return out, at + 2 + size
        at += 2 + size
    raise ValueError("no scan")


def coefficients(scan: bytes, spec: dict) -> list[np.ndarray]:
    """Quantised coefficients (block rows, blocks, 64 in zigzag order) of each plane of a baseline scan, symbol by symbol."""
    planes = list(spec["planes"].values())
    most_across, most_down = max(p["across"] for p in planes), max(p["down"] for p in planes)
    units_across, units_down = -(-spec["width"] // (8 * most_across)), -(-spec["height"] // (8 * most_down))
    trees = [[{v: s for s, v in canonical(spec["huffman"][t]).items()} for t in (p["dc"], p["ac"])] for p in planes]
    out = [np.zeros((units_down * p["down"], units_across * p["across"], 64), np.int64) for p in planes]
    parts = []
    at = 0
    for k in range(len(scan) - 1):  # restart marks part the scan
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            parts.append(scan[at:k])
            at = k + 2
    parts.append(scan[at:])
    units, done = units_across * units_down, 0
    for part in parts:
        raw = part.replace(b"\xff\x00", b"\xff")
        pos, size = 0, 8 * len(raw)

        def take(n: int) -> int:
            nonlocal pos
            if pos + n > size:
                raise ValueError("the scan ends early")
            first, last = pos >> 3, (pos + n + 7) >> 3
            pos += n
            return int.from_bytes(raw[first:last], "big") >> (8 * last - pos) & ((1 << n) - 1) if n else 0

        def symbol(tree: dict) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (code, n) in tree:
                    return tree[code, n]
            raise ValueError("no such code")

        def value(s: int) -> int:
            v = take(s)
            return v if not s or v >> (s - 1) else v - (1 << s) + 1

        last = [0] * len(planes)
        for unit in range(done, min(done + (spec["restart"] or units), units)):
            row, col = divmod(unit, units_across)
            for i, (p, (dc, ac)) in enumerate(zip(planes, trees)):
                for y in range(p["down"]):
                    for x in range(p["across"]):
                        block = out[i][row * p["down"] + y, col * p["across"] + x]
                        last[i] += value(symbol(dc))
                        block[0] = last[i]
                        k = 1
                        while k < 64:
                            rs = symbol(ac)
                            if rs == 0:
                                break
                            k += rs >> 4
                            if rs & 15:
                                if k > 63:
                                    raise ValueError("too many coefficients")
                                block[k] = value(rs & 15)
                            k += 1
            done += 1
    if done < units:
        raise ValueError("the scan ends early")
    return out


def planes(frame: bytes) -> list[np.ndarray]:
    """The planes of any baseline JPEG at their own sampling, cut to the picture: grey alone, or luma and two of colour."""
    frame = bytes(frame)
    spec, at = parse(frame)
    end = frame.rfind(b"\xff\xd9")
    named = list(spec["planes"].values())
    if any(p["q"] not in spec["quant"] or p["dc"] not in spec["huffman"] or p["ac"] not in spec["huffman"] for p in named):
        raise ValueError("a table is missing")
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    out = []
    for p, found in zip(named, coefficients(frame[at : end if end >= at else len(frame)], spec)):
        down, across, _ = found.shape
        blocks = np.zeros((down * across, 64), np.int64)
        blocks[:, ZIGZAG] = found.reshape(-1, 64) * spec["quant"][p["q"]]
        flat = np.clip(np.rint(basis.T @ blocks.reshape(-1, 8, 8) @ basis) + 128, 0, 255).astype(np.uint8)
        whole = flat.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        height = -(-spec["height"] * p["down"] // max(x["down"] for x in named))
        width = -(-spec["width"] * p["across"] // max(x["across"] for x in named))
        out.append(whole[:height, :width])
    return out


def pixels(frame: bytes) -> np.ndarray:
    """The luma of any baseline JPEG, which is the picture itself of a grey one."""
    return planes(frame)[0]


def picture(frame: bytes) -> np.ndarray:
    """The picture in red, green and blue (height, width, 3); colour planes are repeated to the size of the luma."""
    y, *colour = planes(frame)
    if len(colour) != 2:
        return np.repeat(y[:, :, None], 3, axis=2)
    rows, cols = np.arange(y.shape[0]), np.arange(y.shape[1])
    cb, cr = (c[np.ix_(rows * c.shape[0] // y.shape[0], cols * c.shape[1] // y.shape[1])] - 128.0 for c in colour)
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def own_samples(found: list[memoryview]) -> np.ndarray | None:
    """(frames, 576) samples of frames that this module has written, decoded together; None of others."""
    if all(len(f) == len(HEAD) + 2 * UNIT + 2 and f[: len(HEAD)] == HEAD for f in found):
        scan = np.frombuffer(b"".join(f[len(HEAD) : -2] for f in found), ">u2").reshape(len(found), UNIT)
        d = DIFFERENCES[scan]
        if (d < 1 << 14).all():
            return (np.cumsum(d, axis=1, dtype=np.int16) + 128).astype(np.uint8)
    return None


def samples(found: list[memoryview]) -> np.ndarray:
    """(frames, 576) samples of frames of this module's size: the means of their blocks. ValueError for another size."""
    values = own_samples(found)
    if values is not None:
        return values
    pictures = [pixels(f) for f in found]
    if any(x.shape != (DOWN * 8, ACROSS * 8) for x in pictures):
        raise ValueError("the frames hold no samples")
    return np.array([np.rint(x.reshape(DOWN, 8, ACROSS, 8).mean(axis=(1, 3))).reshape(-1) for x in pictures]).astype(np.uint8).reshape(-1, UNIT)


def histograms(values: np.ndarray) -> np.ndarray:
    """How many of each row's samples fall in each bin."""
    n = len(values)
    return np.bincount((np.arange(n)[:, None] * BINS + (values >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)


def frame_histograms(found: list[memoryview]) -> np.ndarray:
    """The luma histogram of each frame of any size, as if it had 576 samples."""
    values = own_samples(found)
    if values is not None:
        return histograms(values)
    return np.array([np.bincount(x.ravel() >> 4, minlength=BINS) * UNIT / x.size for x in map(pixels, found)]).reshape(-1, BINS)


def shots(hist: np.ndarray, window: int = 8, factor: int = 3, least: int = 200) -> list[int]:
    """The first frame of each shot, of the frames' histograms.

    A cut is where the histogram differs from the last frame's by more than ``least`` counts and by more than the mean
    plus ``factor`` standard deviations of the last ``window`` differences within the shot.
    """
    if not len(hist):
        return []
    jump = np.abs(np.diff(hist, axis=0)).sum(axis=1).tolist()
    first, recent = [0], []
    for k, j in enumerate(jump, 1):
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if j > least and j > mean + factor * spread:
            first.append(k)
            recent = []
        else:
            recent = [*recent[1 - window :], j]
    return first


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text of (doc_id, text) as a file.

    Null text counts as empty: one frame of padding. A null doc_id stays null, repeated rows are stored each on their
    own, an empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, made, held = [], [], [], 0
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, payload = padded(x.as_py())
                ids.append(doc)
                sizes.append(n)
                made.append(write(payload))
                held += len(made[-1])
                if held > 1 << 26:  # files are passed on by their bytes, not by their number
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])
                    ids, sizes, made, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def file_clips(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(clip, start_ms, end_ms, first_frame, n_frames) of the shots of a file. ValueError if it cannot be read."""
    try:
        found, rate = frames(data)
        first = shots(frame_histograms(found))
    except (struct.error, IndexError, KeyError) as e:  # cut short in the middle of a field
        raise ValueError("the file is cut short or damaged") from e
    return [(k, round(1000 * a / rate), round(1000 * b / rate), a, b - a) for k, (a, b) in enumerate(zip(first, [*first[1:], len(found)]))]


CLIPS = "doc_id bigint, clip bigint, start_ms bigint, end_ms bigint, first_frame bigint, n_frames bigint, error string"


def clips(files: DataFrame) -> DataFrame:
    """(doc_id, clip, start_ms, end_ms, first_frame, n_frames, error) for each shot of the files (doc_id, media).

    A null file and one without frames give no rows. Bytes that are no such file, or one that is damaged, give one row
    with the error and nulls. Repeated rows give their clips each; a null doc_id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = x.as_py()
                if data is None:
                    continue
                try:
                    rows += [(doc, *c, None) for c in file_clips(data)]
                except ValueError as e:
                    rows.append((doc, None, None, None, None, None, str(e)))
            types = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [f.split()[0] for f in CLIPS.split(", ")])

    return files.select(F.col("doc_id").cast("bigint"), "media").mapInArrow(run, CLIPS)


STORED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """For each row of (doc_id, text): the file's and the payload's digests, as read back, and its clips as a string.

    Null text counts as empty. Repeated rows are stored each on their own; a null doc_id stays null; an empty table
    gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, payload = padded(x.as_py())
                data = write(payload)
                found, rate = frames(data)
                values = samples(found)
                back = values.tobytes()
                first = shots(histograms(values))
                times = [f"{round(1000 * a / rate)}-{round(1000 * b / rate)}" for a, b in zip(first, [*first[1:], len(found)])]
                feature = f"frames={len(found)};shots={len(first)};mean={int(values.sum(dtype=np.int64)) * 1000 // values.size};clips={','.join(times)}"
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in STORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, STORED)
