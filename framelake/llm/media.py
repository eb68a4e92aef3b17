"""Media columns: Netpbm and BMP to numpy arrays, thumbnails, NPY tiles and difference hashes.

* ``decode`` reads binary and plain Netpbm (P1 to P6, up to 16 bits a sample) and uncompressed BMP
  (1, 4, 8, 24 and 32 bits) into (height, width, channels) arrays.
* ``area_resize`` means over exact fractional areas by an integral image.
* ``to_tiles`` / ``from_tiles`` store an array as a run of NPY files, one a tile, without loss.
* ``dhash`` is the 64-bit difference hash of the 9 x 8 thumbnail.

``media_columns`` takes a text column as payload: its UTF-8 bytes, padded with zero bytes to a
positive multiple of 64, are the grey samples of an image 64 wide. The image goes through a PGM or
BMP file (by the payload's checksum) and the decoder, and is stored as NPY tiles; all that is
returned about the payload is computed from the stored tiles read back.

Defined results: null is an empty text, whose payload is one row of 64 zero bytes; equal texts give
equal values, whatever their id; repeated rows and extra columns do no harm; an empty table gives an
empty result; a text of any length is taken whole. A file that is cut short, or of an unknown kind,
raises ``ValueError`` in ``decode``; ``decode_column`` gives null columns and the reason instead.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import common, tokens

WIDTH = 64
TILE_ROWS = 4096


def _tokens_pnm(raw: bytes, count: int) -> tuple[list[int], int]:
    """``count`` header numbers after the magic, comments skipped; and where the data begins."""
    at, out = 2, []
    while len(out) < count:
        while at < len(raw) and (raw[at : at + 1].isspace() or raw[at] == 35):
            if raw[at] == 35:
                at = raw.find(b"\n", at)
                if at < 0:
                    raise ValueError("netpbm: header cut short")
            at += 1
        to = at
        while to < len(raw) and 48 <= raw[to] <= 57:
            to += 1
        if to == at:
            raise ValueError("netpbm: header cut short")
        out.append(int(raw[at:to]))
        at = to
    return out, at + 1


def _plain_samples(body: bytes, n: int, top: int, bitmap: bool) -> np.ndarray:
    """The first ``n`` samples of a plain body, in which a # starts a comment up to the line's end."""
    body = b"\n".join(line.split(b"#", 1)[0] for line in body.replace(b"\r", b"\n").split(b"\n"))
    words = [bytes([x]) for x in b"".join(body.split())[:n]] if bitmap else body.split(None, n)[:n]
    if not all(w.isdigit() and len(w) < 19 for w in words):
        raise ValueError("netpbm: a sample isn't a number")
    flat = np.array([int(w) for w in words], np.int64)
    if (flat > top).any():
        raise ValueError("netpbm: a sample above the maximum")
    return flat.astype(np.uint8 if top < 256 else np.uint16)


def _decode_pnm(raw: bytes) -> np.ndarray:
    kind = raw[1] - 48
    bitmap, plain, channels = kind in (1, 4), kind < 4, 3 if kind in (3, 6) else 1
    head, at = _tokens_pnm(raw, 2 if bitmap else 3)
    width, height, top = head[0], head[1], 1 if bitmap else head[2]
    if not 1 <= top <= 65535:
        raise ValueError("netpbm: bad maximum")
    if not plain and not raw[at - 1 : at].isspace():
        raise ValueError("netpbm: no space after the header")
    row = (width + 7) // 8 if bitmap else width * channels
    n, unit = (width * height * channels, 1) if plain else (row * height, 2 if top > 255 else 1)
    if len(raw) - at < (n * unit if not plain else min(n, 1)):
        raise ValueError("netpbm: data cut short")
    if plain:
        flat = _plain_samples(raw[at - 1 :], n, top, bitmap)
    elif bitmap:
        flat = np.unpackbits(np.frombuffer(raw, np.uint8, n, at).reshape(height, row), axis=1)[:, :width].reshape(-1) if n else np.zeros(0, np.uint8)
    else:
        flat = np.frombuffer(raw, np.uint8 if unit == 1 else ">u2", n, at) if n else np.zeros(0, np.uint8)
        if len(flat) and int(flat.max()) > top:
            raise ValueError("netpbm: a sample above the maximum")
    if len(flat) < width * height * channels:
        raise ValueError("netpbm: data cut short")
    return flat.reshape(height, width, channels)


def _masked(rows: np.ndarray, masks: list[int]) -> np.ndarray:
    """Channels of 8 bits, picked by bit masks from pixels of 16 or 32 bits."""
    out = []
    for m in masks:
        if not m:
            raise ValueError("bmp: an empty channel mask")
        shift = (m & -m).bit_length() - 1
        top = m >> shift
        if top & (top + 1):
            raise ValueError("bmp: a channel mask with gaps")
        out.append((((rows.astype(np.int64) & m) >> shift) * 255 + top // 2) // top)
    return np.stack(out, axis=2).astype(np.uint8)


def _decode_bmp(raw: bytes) -> np.ndarray:
    if len(raw) < 54:
        raise ValueError("bmp: header cut short")
    at, header = (int.from_bytes(raw[i : i + 4], "little") for i in (10, 14))
    width, height = (int.from_bytes(raw[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed = int.from_bytes(raw[28:30], "little"), int.from_bytes(raw[30:34], "little")
    if (bits, packed) not in ((1, 0), (4, 0), (8, 0), (24, 0), (32, 0), (16, 0), (16, 3), (32, 3)) or width < 0 or header < 40:
        raise ValueError("bmp: unsupported kind")
    down, height = height < 0, abs(height)
    row = (width * bits + 31) // 32 * 4
    if len(raw) < at + row * height:
        raise ValueError("bmp: data cut short")
    if not row * height:
        return np.zeros((height, width, 3), np.uint8)
    rows = np.frombuffer(raw, np.uint8, row * height, at).reshape(height, row)
    if bits <= 8:
        colours = int.from_bytes(raw[46:50], "little") or 1 << bits
        if not 0 < colours <= 1 << bits or len(raw) < 14 + header + colours * 4:
            raise ValueError("bmp: palette cut short")
        lut = np.frombuffer(raw, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        if bits < 8:
            rows = np.unpackbits(rows, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
        index = rows[:, :width]
        if int(index.max()) >= colours:
            raise ValueError("bmp: a pixel beyond the palette")
        pixel = lut[index]
        if (lut[:, 0] == lut[:, 1]).all() and (lut[:, 1] == lut[:, 2]).all():
            pixel = pixel[:, :, :1]
    elif bits == 16 or packed == 3:
        if packed == 3 and len(raw) < 66:
            raise ValueError("bmp: masks cut short")
        masks = [int.from_bytes(raw[i : i + 4], "little") for i in (54, 58, 62)] if packed == 3 else [0x7C00, 0x03E0, 0x001F]
        pixel = _masked(np.ascontiguousarray(rows).view("<u2" if bits == 16 else "<u4")[:, :width], masks)
    else:
        pixel = rows[:, : width * (bits // 8)].reshape(height, width, bits // 8)[:, :, 2::-1]
    return pixel if down else pixel[::-1]


def decode(raw: bytes) -> np.ndarray:
    """(height, width, channels) samples of a Netpbm or BMP file."""
    if len(raw) >= 2 and raw[0] == 80 and 49 <= raw[1] <= 54:
        return _decode_pnm(raw)
    if raw[:2] == b"BM":
        return _decode_bmp(raw)
    raise ValueError("neither netpbm nor bmp")


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.tobytes()


def encode_bmp(grey: np.ndarray) -> bytes:
    height, width = grey.shape
    row = (width + 3) // 4 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, :width] = grey[::-1]
    at = 54 + 1024
    put = lambda n, size: int(n).to_bytes(size, "little", signed=n < 0)
    head = b"BM" + put(at + body.size, 4) + bytes(4) + put(at, 4) + put(40, 4) + put(width, 4) + put(height, 4) + put(1, 2) + put(8, 2) + put(0, 4) + put(body.size, 4) + put(2835, 4) + put(2835, 4) + put(256, 4) + put(0, 4)
    level = np.arange(256, dtype=np.uint8)
    return head + np.stack([level, level, level, np.zeros(256, np.uint8)], 1).tobytes() + body.tobytes()


def grey_of(pixel: np.ndarray) -> np.ndarray:
    """Luminance as float64 (601 weights) of 1 or 3 channels."""
    return pixel[:, :, 0].astype(np.float64) if pixel.shape[2] == 1 else pixel[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(grey: np.ndarray, height: int, width: int, band: int = 4096) -> np.ndarray:
    """Means over equal areas: the integral image, interpolated at the fractional cell borders.

    The integral image is made ``band`` rows at a time, with the last row carried on, so that a tall
    image takes no more memory than that beside itself.
    """
    h, w = grey.shape
    if h == 0 or w == 0:
        return np.zeros((height, width))

    def borders(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(cells + 1) * (size / cells)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    y, fy = borders(h, height)
    x, fx = borders(w, width)
    rows = np.zeros((height + 1, w + 1))
    above = np.zeros(w + 1)
    for lo in range(0, h, band):
        part = np.zeros((min(band, h - lo) + 1, w + 1))
        np.cumsum(np.cumsum(grey[lo : lo + band], 0, dtype=np.float64), 1, out=part[1:, 1:])
        part += above
        here = (y >= lo) & (y < lo + band)
        rows[here] = part[y[here] - lo] * (1 - fy[here])[:, None] + part[y[here] - lo + 1] * fy[here][:, None]
        above = part[-1]
    cell = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(cell, axis=0), axis=1) * (height * width / (h * w))


def dhash(grey: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 thumbnail cells is darker than its right neighbour."""
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_tiles(array: np.ndarray, tile_rows: int = TILE_ROWS, tile_cols: int | None = None) -> bytes:
    """NPY files in a run: the tiles of ``array`` in row-major order; the first, of int64, has the shape and the tile size."""
    cols = tile_cols or max(1, array.shape[1])
    out = io.BytesIO()
    np.save(out, np.array([*array.shape, tile_rows, cols], np.int64))
    for y in range(0, array.shape[0], tile_rows):
        for x in range(0, array.shape[1], cols):
            np.save(out, np.ascontiguousarray(array[y : y + tile_rows, x : x + cols]))
    return out.getvalue()


def from_tiles(raw: bytes) -> np.ndarray:
    """The array of ``to_tiles``, bit for bit."""
    src = io.BytesIO(raw)
    *shape, tile_rows, cols = np.load(src).tolist()
    out = None
    for y in range(0, shape[0], tile_rows):
        for x in range(0, shape[1], cols):
            tile = np.load(src, allow_pickle=False)
            if out is None:
                out = np.empty(shape, tile.dtype)
            out[y : y + tile_rows, x : x + cols] = tile
    return out if out is not None else np.zeros(shape, np.uint8)


def store(payload: bytes) -> bytes:
    """The stored form of a payload (a multiple of 64 bytes): image file, decoder, NPY tiles."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    file = encode_bmp(grey) if zlib.crc32(payload) & 1 else encode_pgm(grey)
    return to_tiles(decode(file)[:, :, 0])


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_kind string, n_tiles int"


def _describe(raw: bytes) -> tuple:
    payload = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
    media = store(payload)
    back = from_tiles(media)
    read = back.tobytes()
    kind = "bmp" if zlib.crc32(payload) & 1 else "pgm"
    return (len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), dhash(back), kind, -(-back.shape[0] // TILE_ROWS))


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """(id, payload and media columns) of every row; with ``keep_media`` the stored tiles too, as binary."""
    common.prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, {SCHEMA}" + ", media binary" * keep_media
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for at, part in tokens.slices(batch.column(1), 4 << 20):
                data, off = tokens.buffers(part)
                raws = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
                cols = [pa.array(list(x)) for x in zip(*map(_describe, raws), strict=True)]
                cols[-1] = cols[-1].cast(pa.int32())
                if keep_media:
                    cols.append(pa.array([store(x + bytes(-len(x) % WIDTH or (0 if x else WIDTH))) for x in raws], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *cols], names)

    return src.mapInArrow(run, schema)


def decode_column(df: DataFrame, *, id_col: str, media_col: str, thumb: int = 16) -> DataFrame:
    """(id, height, width, channels, dhash, thumb, error) of a column of Netpbm or BMP files.

    ``thumb`` is an NPY file of the grey ``thumb x thumb`` area mean. A null or bad file has only ``error``.
    """
    common.prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def one(raw: bytes | None) -> tuple:
        try:
            pixel = decode(raw or b"")
        except ValueError as e:
            return None, None, None, None, None, str(e)
        grey, out = grey_of(pixel), io.BytesIO()
        np.save(out, area_resize(grey, thumb, thumb).astype(np.float32))
        return (*pixel.shape, dhash(grey), out.getvalue(), None)

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
    names = ["id", "height", "width", "channels", "dhash", "thumb", "error"]

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(one, batch.column(1).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True))], names)

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, height int, width int, channels int, dhash string, thumb binary, error string")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole of ``documents``."""
    return media_columns(common.read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
