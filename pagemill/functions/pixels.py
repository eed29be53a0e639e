"""Pixels of one page as arrays: PNG in and out, whole-file checks, hashes, warps, filters and boxes.

Helpers of the stages in operators/images.py, which run them in Arrow batches. An image is an array (height, width, channels)
of bytes, with one channel (grey) or three.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from math import cos, pi

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed by the format: channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes):
    """Type and body of each chunk of a PNG file up to its end; whatever is cut off or altered is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(data):
            raise ValueError("cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise ValueError("cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def _png_rows(data: bytes):
    """Header, palette and the filtered rows (height, 1 + bytes of a row) of a PNG file without interlacing."""
    header, palette, packed = None, None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None or header[3] not in CHANNELS or not header[0] or not header[1]:
        raise ValueError("no usable header")
    width, height, depth, colour, _, _, interlace = header
    line = (width * depth * CHANNELS[colour] + 7) // 8
    expander = zlib.decompressobj()
    raw = expander.decompress(b"".join(packed), (1 + line) * height + 1 if not interlace else 0)
    if interlace:
        raw += expander.flush()
    if not expander.eof and not interlace and len(raw) < (1 + line) * height:
        raise ValueError("pixels are cut off")
    if not interlace and len(raw) != (1 + line) * height:
        raise ValueError("wrong number of pixels")
    if interlace:
        if not expander.eof:
            raise ValueError("pixels are cut off")
        return header, palette, None
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + line)
    if rows[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return header, palette, rows


def decode_png(data: bytes) -> np.ndarray:
    """The image of a PNG file of 8 bits a channel without interlacing; transparency is left out."""
    (width, height, depth, colour, _, _, interlace), palette, rows = _png_rows(data)
    if depth != 8 or interlace:
        raise ValueError("only 8 bits a channel without interlacing")
    n = CHANNELS[colour]
    out = np.zeros((height + 1, width + 1, n), np.uint8)  # a row and a column of zeros before the first
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].reshape(width, n)
        up = out[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1, 1:] = line + up
        else:
            own, above = out[y + 1].astype(int), out[y].astype(int)
            for x in range(1, width + 1):
                left, top, corner = own[x - 1], above[x], above[x - 1]
                if kind == 3:
                    guess = (left + top) // 2
                else:
                    base = left + top - corner
                    far = np.abs(np.stack([base - left, base - top, base - corner]))
                    guess = np.choose(np.argmin(far, axis=0), [left, top, corner])
                own[x] = (line[x - 1] + guess) & 255
            out[y + 1] = own
    image = out[1:, 1:]
    if colour == 3:
        return palette[np.minimum(image[..., 0], len(palette) - 1)]
    return image[..., :3] if n == 4 else image[..., :1] if n == 2 else image


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of an image of one or three channels."""
    height, width, n = image.shape
    lines = np.zeros((height, 1 + width * n), np.uint8)
    lines[:, 1:] = image.reshape(height, width * n)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    header = struct.pack(">IIBBBBB", width, height, 8, 2 if n == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def _check_jpeg(data: bytes) -> None:
    """Walks the segments and the coded data up to the end marker; restart markers come in turn."""
    at, frame, scans = 2, False, 0
    while True:
        if at + 4 > len(data):
            raise ValueError("end" if data[at : at + 2] != b"\xff\xd9" else "")
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        kind = data[at + 1]
        if kind == 0xFF:  # fill byte
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("cut off")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            depth, height, width, n = struct.unpack_from(">BHHB", data, at + 4)
            if size != 8 + 3 * n or not width or depth not in (8, 12, 16):
                raise ValueError("frame header")
            frame = True
        at += 2 + size
        if kind != 0xDA:
            continue
        if not frame:
            raise ValueError("scan without frame")
        scans += 1
        due = 0
        while True:  # coded data: a byte of ones is followed by a zero, or it is a marker
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("cut off")
            after = data[at + 1]
            if after == 0:
                at += 2
            elif 0xD0 <= after <= 0xD7:
                if after != 0xD0 + due:
                    raise ValueError("restart marker out of turn")
                due, at = (due + 1) % 8, at + 2
            elif after == 0xFF:
                at += 1
            else:
                break
        if data[at + 1] == 0xD9:
            return


def image_fault(data: bytes | None) -> str | None:
    """Why an image file can't be whole, None if nothing speaks against it.

    Of a PNG file every checksum and all pixels are checked. A JPEG file has no checksums: its segments and the markers in
    its coded data are walked to the end, so cut-off files are found, but not every changed bit. Of GIF and WebP files only
    the length or the last mark is.
    """
    try:
        if data is None:
            raise ValueError("no file")
        if data[:2] == b"\xff\xd8":
            _check_jpeg(data)
        elif data[:4] == b"GIF8":
            if data[-1:] != b";":
                raise ValueError("cut off")
        elif data[:4] == b"RIFF":
            if struct.unpack_from("<I", data, 4)[0] + 8 > len(data):
                raise ValueError("cut off")
        else:
            _png_rows(data)
    except (ValueError, zlib.error, struct.error) as e:
        return f"{type(e).__name__}: {e}"
    return None


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness, 0 to 255, as doubles."""
    return image[..., 0].astype(float) if image.shape[2] == 1 else image[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


@lru_cache(maxsize=256)
def _reducer(size: int, to: int) -> np.ndarray:
    """Matrix (to, size) that averages a line of pixels over `to` equal stretches."""
    edges = np.linspace(0, size, to + 1)
    at = np.arange(size)
    cover = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.maximum(cover, 0) / (size / to)


def reduced(image: np.ndarray, to: int = 32) -> np.ndarray:
    """Brightness averaged over to x to equal fields; smaller pictures stay as they are."""
    x = grey(image)
    return x if max(x.shape) <= to else _reducer(x.shape[0], to) @ x @ _reducer(x.shape[1], to).T


@lru_cache(maxsize=4)
def cosines(rows: int, size: int) -> np.ndarray:
    """The first rows of the discrete cosine transform (type II, not scaled) of so many numbers."""
    return np.array([[2 * cos(pi * u * (2 * i + 1) / (2 * size)) for i in range(size)] for u in range(rows)])


@lru_cache(maxsize=256)
def _weights(rows: int, size: int, to: int) -> np.ndarray:
    """Matrix (rows, size): what each pixel of a line gives the first frequencies of the line averaged to `to` stretches."""
    return np.array([[sum((line * part).tolist()) for part in _reducer(size, to).T] for line in cosines(rows, to)])


def perceptual_hashes(fields: np.ndarray, size: int = 8, to: int = 32) -> np.ndarray:
    """64-bit hashes of many images (n, height, width) of brightness, averaged over to x to equal fields: which of the lowest
    size x size frequencies exceed their median.

    A frequency is a sum over the pixels by row, added one by one: frequencies that would be equal (those of a picture of one
    colour) are told apart by rounding alone, so the order is fixed, whatever the batch and the library.
    """
    down, across = _weights(size, fields.shape[1], to), _weights(size, fields.shape[2], to)
    low = np.zeros((len(fields), size, size))
    for y in range(fields.shape[1]):
        for x in range(fields.shape[2]):
            low += (down[:, y] * fields[:, y, x, None])[:, :, None] * across[:, x]
    low = low.reshape(len(fields), size * size)
    bits = low > np.median(low, axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def warped(image: np.ndarray, matrix: list[float]) -> np.ndarray:
    """The page under a homography of the unit square (9 numbers by row), on white: each pixel looks up where it came from and
    mixes its four neighbours."""
    height, width, _ = image.shape
    back = np.linalg.inv(np.array(matrix, float).reshape(3, 3))
    v, u = np.mgrid[0:height, 0:width]
    points = back @ np.stack([(u.ravel() + 0.5) / width, (v.ravel() + 0.5) / height, np.ones(width * height)])
    x, y = points[0] / points[2] * width - 0.5, points[1] / points[2] * height - 0.5
    inside = (x > -1) & (y > -1) & (x < width) & (y < height) & (points[2] > 0)
    x, y = np.where(inside, x, 0), np.where(inside, y, 0)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None]
    framed = np.pad(image.astype(float), ((1, 1), (1, 1), (0, 0)), constant_values=255.0)
    take = lambda j, i: framed[np.clip(j + 1, 0, height + 1), np.clip(i + 1, 0, width + 1)]
    mixed = (take(y0, x0) * (1 - fx) + take(y0, x0 + 1) * fx) * (1 - fy) + (take(y0 + 1, x0) * (1 - fx) + take(y0 + 1, x0 + 1) * fx) * fy
    return np.rint(np.where(inside[:, None], mixed, 255.0)).astype(np.uint8).reshape(image.shape)


def blurred(image: np.ndarray, radius: float) -> np.ndarray:
    """A bell-shaped blur, along rows and then along columns; the edges repeat."""
    if radius <= 0:
        return image.astype(float)
    reach = max(1, int(3 * radius + 0.5))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    weights /= weights.sum()
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (reach, reach)
        framed = np.pad(out, pad, mode="edge")
        out = sum(w * np.take(framed, range(k, k + out.shape[axis]), axis=axis) for k, w in enumerate(weights))
    return out


def aged(image: np.ndarray, profile: str, quality: float, seed: str) -> np.ndarray:
    """A page as a scanner, a phone, an old photocopier or a fax gives it; by the seed alone, milder with quality (0 to 1).

    Ink bleeds (blur), paper and light change tone (curves and a gradient), the device adds noise, bands or two tones.
    """
    worst = 1 - min(1.0, max(0.0, quality))
    rng = np.random.default_rng(zlib.crc32(seed.encode()) + (len(seed) << 32))
    height, width, _ = image.shape
    bleed = {"clean_scan": 0.5, "phone_photo": 0.7, "old_photocopy": 0.9, "fax": 0.8}
    if profile not in bleed:
        raise ValueError(f"unknown profile {profile!r}")
    out = blurred(image, bleed[profile] * worst)
    if profile == "phone_photo":  # light falls off from a point
        y, x = np.mgrid[0:height, 0:width]
        far = np.hypot(y / height - rng.uniform(0.1, 0.9), x / width - rng.uniform(0.1, 0.9))
        out = out * (1 - 0.5 * worst * np.minimum(1.0, far))[..., None]
    elif profile == "old_photocopy":  # bands along the drum, greyer ink
        bands = 1 - 0.25 * worst * (rng.random(height) < 0.04)
        out = 255 - (255 - out * bands[:, None, None]) * (1 - 0.3 * worst)
    if profile in ("clean_scan", "old_photocopy") and image.shape[2] == 3:
        out = out * (1 - np.array([0.0, 0.03, 0.08]) * worst * rng.random())
    out = out + rng.normal(0, {"clean_scan": 4, "phone_photo": 8, "old_photocopy": 12, "fax": 18}[profile] * worst + 1, (height, width, 1))
    if profile == "fax":
        out = np.where(out.mean(axis=2, keepdims=True) > 128, 255.0, 0.0) * np.ones(image.shape[2])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def with_boxes(image: np.ndarray, rects: list[tuple[float, float, float, float]], colours: list[tuple[int, int, int]], thick: int = 2) -> np.ndarray:
    """The image, in colours, with outlines drawn inwards from pixel corners (x0, y0, x1, y1); parts outside are cut."""
    out = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image.copy()
    height, width, _ = out.shape
    for (x0, y0, x1, y1), colour in zip(rects, colours):
        x0, y0, x1, y1 = (int(v) for v in (x0, y0, x1, y1))
        inner = np.zeros((height, width), bool)
        box = np.zeros((height, width), bool)
        box[max(0, y0) : max(0, y1 + 1), max(0, x0) : max(0, x1 + 1)] = True
        inner[max(0, y0 + thick) : max(0, y1 + 1 - thick), max(0, x0 + thick) : max(0, x1 + 1 - thick)] = True
        out[box & ~inner] = colour
    return out
