"""Netpbm and BMP images in binary columns: decoded, resized by area, hashed, stored as NPY tiles."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows

#: Rows and columns of a tile, and the samples in a row of stored payloads (64 pixels of three).
TILE, ROW = 32, 192

#: One field of a Netpbm header: white space and comments, then digits.
FIELD = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|#[^\r\n]*)*([0-9]+)")


def decode(data: bytes) -> np.ndarray:
    """Samples as (rows, columns, channels): uint8, or uint16 for Netpbm above 255.

    Netpbm P1 to P6 keep their samples as stored; bitmaps have 1 for black.  BMP
    with 1, 4 or 8 bits (through its palette), 24 or 32 bits (the fourth sample
    is left out) gives red, green, blue.  Anything else raises ValueError.
    """
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return netpbm(data)
    if data[:2] == b"BM":
        return bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        if (m := FIELD.match(data, at)) is None:
            raise ValueError("broken header")
        fields.append(int(m[1]))
        at = m.end()
    (width, height), most = fields[:2], fields[2] if len(fields) > 2 else 1
    if not 0 < most < 65536 or not width or not height:
        raise ValueError("broken header")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\r\n]*|[^01]", b"", data[at:])[:n], np.uint8) - 48
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype=np.uint16 if most > 255 else np.uint8)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, min(len(data) - at - 1, height * -(-width // 8)), at + 1)
        if len(rows) == height * -(-width // 8):
            flat = np.unpackbits(rows.reshape(height, -1), axis=1)[:, :width].reshape(-1)
        else:
            flat = rows[:0]
    else:
        size = 2 if most > 255 else 1
        flat = np.frombuffer(data, ">u2" if size == 2 else np.uint8, max(0, min((len(data) - at - 1) // size, n)), at + 1)
        flat = flat.astype(np.uint16) if size == 2 else flat
    if len(flat) < n:
        raise ValueError("samples are missing")
    return flat.reshape(height, width, channels)


def bmp(data: bytes) -> np.ndarray:
    if len(data) < 26:
        raise ValueError("broken header")
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        packed = used = 0
    elif head >= 40 and len(data) >= 54:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        used = struct.unpack_from("<I", data, 46)[0]
    else:
        raise ValueError("broken header")
    if packed or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP is not read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if start + rows * stride > len(data):
        raise ValueError("samples are missing")
    lines = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits <= 8:
        each = 3 if head == 12 else 4
        colours = min(used or 1 << bits, 1 << bits)
        if 14 + head + colours * each > len(data):
            raise ValueError("the palette is missing")
        palette = np.zeros((1 << bits, 3), np.uint8)
        palette[:colours] = np.frombuffer(data, np.uint8, colours * each, 14 + head).reshape(colours, each)[:, 2::-1]
        if bits < 8:
            places = np.unpackbits(lines, axis=1).reshape(rows, -1, bits)
            lines = places @ (1 << np.arange(bits - 1, -1, -1))
        out = palette[lines[:, :width]]
    else:
        out = lines[:, :width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def encode_netpbm(samples: np.ndarray) -> bytes:
    """Binary Netpbm of one or three channels of uint8."""
    height, width, channels = samples.shape
    return b"P%d\n%d %d\n255\n" % ({1: 5, 3: 6}[channels], width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """BMP of 24 bits, the last row first."""
    height, width, _ = samples.shape
    stride = (width * 3 + 3) // 4 * 4
    lines = np.zeros((height, stride), np.uint8)
    lines[:, :width * 3] = samples[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + lines.size, 0, 0, 54, 40, width, height, 1, 24, 0,
                       lines.size, 2835, 2835, 0, 0) + lines.tobytes()


def area_resize(samples: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the samples under each cell, parts of samples counted by their area.

    Sums come from the integral image: its value between grid points is linear in
    either direction, so a cell takes four look-ups whatever its size.
    """
    out = np.asarray(samples, np.float64)
    for axis, size in ((0, rows), (1, columns)):
        have = out.shape[axis]
        total = np.zeros((*out.shape[:axis], have + 1, *out.shape[axis + 1:]))
        np.cumsum(out, axis, out=total[(slice(None),) * axis + (slice(1, None),)])
        edges = np.arange(size + 1) * have / size
        left = np.minimum(edges.astype(int), have - 1)
        share = (edges - left).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        at = np.take(total, left, axis)
        at += share * (np.take(total, left + 1, axis) - at)
        out = np.diff(at, axis=axis) * (size / have)
    return out


def grey(samples: np.ndarray) -> np.ndarray:
    """Brightness as (rows, columns)."""
    if samples.shape[2] == 1:
        return samples[:, :, 0].astype(np.float64)
    return samples[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def difference_hash(samples: np.ndarray) -> str:
    """64 bits: whether a cell of an 8 x 9 reduction is darker than the one to its right."""
    small = area_resize(grey(samples), 8, 9).round(6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(samples: np.ndarray, size: int = TILE) -> bytes:
    """The image reduced to a square of uint8, as the bytes of an NPY file."""
    most = 1 if samples.max(initial=0) <= 1 else 255 if samples.dtype == np.uint8 else 65535
    small = area_resize(samples, size, size) * (255 / most)
    file = io.BytesIO()
    np.save(file, np.clip(np.rint(small), 0, 255).astype(np.uint8), allow_pickle=False)
    return file.getvalue()


def read_media(df: DataFrame, id_col: str, media_col: str, size: int = TILE) -> DataFrame:
    """id, rows, columns, channels, tile (an NPY file), feature, error of every row's image.

    A null or unreadable image has nulls and says why in ``error``.
    """
    def row(data):
        try:
            samples = decode(bytes(data or b""))
            return (*samples.shape, npy_tile(samples, size), difference_hash(samples), None)
        except ValueError as why:
            return None, None, None, None, None, str(why)

    return map_rows(df, lambda: row, [media_col], [id_col], [
        T.StructField("rows", T.IntegerType()), T.StructField("columns", T.IntegerType()),
        T.StructField("channels", T.IntegerType()), T.StructField("tile", T.BinaryType()),
        T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())])


def as_image(payload: bytes) -> np.ndarray:
    """The bytes, filled up with blanks to whole rows, as rows of 64 pixels; one row at least."""
    payload += b" " * ((-len(payload)) % ROW or (0 if payload else ROW))
    return np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_files: bool = False) -> DataFrame:
    """Texts as stored images and what is read back from them.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, tile_sha256.  A text's UTF-8 bytes (null: none) become
    the samples of a Netpbm image, filled up with blanks to whole rows, one at
    least.  The digest and checksum of the payload, the tile and the difference
    hash come from the decoded file.  Repeated rows give repeated rows; other
    columns are left out.  ``with_files`` adds the file and the tile.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
              T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
              T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
              T.StructField("feature", T.StringType()), T.StructField("tile_sha256", T.StringType())]
    if with_files:
        fields += [T.StructField("media", T.BinaryType()), T.StructField("tile", T.BinaryType())]

    def row(text):
        data = (text or "").encode()
        media = encode_netpbm(as_image(data))
        samples = decode(media)
        payload, tile = samples.tobytes(), npy_tile(samples)
        out = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
               len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples),
               hashlib.sha256(tile).hexdigest())
        return (*out, media, tile) if with_files else out

    return map_rows(df, lambda: row, [text_col], [id_col], fields)
