"""PNG and BMP files as BGRA bytes, in numpy: all PNG colour types, bit depths, filters and interlacing; BMP with 1 to 32 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the PNG format: samples a pixel by colour type, and the seven interlace passes (left, top, across, down).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Pixels that an image has at most, so that a damaged header can't ask for all memory.
MOST_PIXELS = 1 << 28


class ImageError(ValueError):
    """A file that is damaged or of a kind that isn't read."""


def decoded(data: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    """[height, width, 4] bytes in the order BGRA, turned upright where the file says how it lies; ImageError if it can't be read."""
    try:
        if data.startswith(PNG):
            return _png(data, most)
        if data.startswith(b"BM"):
            return _bmp(data, most)
    except (struct.error, zlib.error, IndexError, ValueError, KeyError) as e:
        raise e if isinstance(e, ImageError) else ImageError(f"damaged: {e}") from e
    raise ImageError("no decoder for this kind of file")


def _chunks(data: bytes):
    at = len(PNG)
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise ImageError("cut short")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ImageError(f"checksum of {kind.decode('latin-1')}")
        yield kind, body
        at += 12 + n


def _unfiltered(raw: np.ndarray, height: int, row: int, step: int) -> np.ndarray:
    """Rows [height, row] of bytes without their filters; step: bytes of a pixel, one at least."""
    if raw.size < height * (row + 1):
        raise ImageError("cut short")
    lines = raw[: height * (row + 1)].reshape(height, row + 1)
    out = np.zeros((height + 1, row), np.uint8)
    for i in range(height):
        kind, x, up, to = int(lines[i, 0]), lines[i, 1:], out[i], out[i + 1]
        if kind == 0:
            to[:] = x
        elif kind == 1:
            padded = np.zeros(-(-row // step) * step, np.uint8)
            padded[:row] = x
            to[:] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:row]
        elif kind == 2:
            np.add(x, up, out=to)
        elif kind in (3, 4):
            to[:] = np.frombuffer(_sequential(kind, x.tobytes(), up.tobytes(), step), np.uint8)
        else:
            raise ImageError(f"filter {kind}")
    return out[1:]


def _sequential(kind: int, x: bytes, up: bytes, step: int) -> bytes:
    """A row filtered by the mean of, or the best of, its left and upper neighbours, each of which needs the one before."""
    out = bytearray(len(x) + step)
    above = bytes(step) + up
    for i, v in enumerate(x):
        left, top = out[i], above[i + step]
        if kind == 3:
            guess = (left + top) >> 1
        else:
            corner = above[i]
            a, b, c = abs(top - corner), abs(left - corner), abs(left + top - 2 * corner)
            guess = left if a <= b and a <= c else top if b <= c else corner
        out[i + step] = (v + guess) & 255
    return bytes(out[step:])


def _samples(raw: np.ndarray, width: int, height: int, depth: int, n: int) -> tuple[np.ndarray, int]:
    """[height, width, n] samples of 1 to 8 bits, 16 of them kept whole, and the bytes used."""
    row = -(-width * n * depth // 8)
    lines = _unfiltered(raw, height, row, max(1, n * depth // 8))
    if depth == 8:
        found = lines.reshape(height, width, n)
    elif depth == 16:
        found = lines.reshape(height, width, n, 2).astype(np.uint16)
        found = (found[..., 0] << 8) | found[..., 1]
    else:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        found = bits.dot(1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)[:, :width, None]
    return found, height * (row + 1)


def _png(data: bytes, most: int) -> np.ndarray:
    head, palette, clear, turned, body = None, None, None, 1, []
    for kind, part in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"eXIf":
            turned = orientation(part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
    else:
        raise ImageError("cut short")
    if head is None or not body:
        raise ImageError("no image in it")
    width, height, depth, colour, _, _, interlaced = head
    if not 0 < width * height <= most:
        raise ImageError(f"{width} by {height} pixels")
    n = SAMPLES[colour]
    if depth not in (1, 2, 4, 8, 16) or (depth < 8 and n > 1) or (depth == 16 and colour == 3):
        raise ImageError(f"{depth} bits of colour type {colour}")
    inflate = zlib.decompressobj()
    raw = np.frombuffer(inflate.decompress(b"".join(body), (width * n * depth // 8 + 2) * (height + 8) * 2 + 64), np.uint8)
    if not interlaced:
        pixels, _ = _samples(raw, width, height, depth, n)
    else:
        pixels = np.zeros((height, width, n), np.uint16 if depth == 16 else np.uint8)
        for left, top, across, down in PASSES:
            w, h = -(-(width - left) // across), -(-(height - top) // down)
            if w > 0 and h > 0:
                pixels[top::down, left::across], used = _samples(raw, w, h, depth, n)
                raw = raw[used:]
    return upright(_coloured(pixels, depth, colour, palette, clear), turned)


def _coloured(pixels: np.ndarray, depth: int, colour: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    out = np.full((*pixels.shape[:2], 4), 255, np.uint8)
    byte = (lambda x: (x >> 8).astype(np.uint8)) if depth == 16 else (lambda x: x * (255 // ((1 << depth) - 1))) if depth < 8 else (lambda x: x)
    if colour == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise ImageError("a colour that the palette lacks")
        out[..., :3] = palette[pixels[..., 0]][..., ::-1]
        if clear:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear[:256], np.uint8)
            out[..., 3] = alpha[pixels[..., 0]]
        return out
    n = pixels.shape[2]
    out[..., :3] = byte(pixels[..., :1]) if n < 3 else byte(pixels[..., 2::-1])
    if n in (2, 4):
        out[..., 3] = byte(pixels[..., -1])
    elif clear:
        key = np.frombuffer(clear, ">u2")[:n]
        out[..., 3] = np.where((pixels == key).all(2), 0, 255)
    return out


def orientation(exif: bytes) -> int:
    """How an image lies, 1 to 8, from its EXIF data; 1 if it doesn't say."""
    try:
        order = {b"II": "<", b"MM": ">"}[exif[:2]]
        (at,) = struct.unpack_from(order + "I", exif, 4)
        (n,) = struct.unpack_from(order + "H", exif, at)
        for i in range(n):
            tag, kind, _, value = struct.unpack_from(order + "HHIH", exif, at + 2 + 12 * i)
            if tag == 0x0112 and kind == 3 and 1 <= value <= 8:
                return value
    except (KeyError, struct.error):
        pass
    return 1


def upright(pixels: np.ndarray, turned: int) -> np.ndarray:
    """An image that lies in one of the eight ways of EXIF, put upright."""
    if turned in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    if turned in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turned in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def _bmp(data: bytes, most: int) -> np.ndarray:
    start, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if size < 40 or packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32):
        raise ImageError(f"{bits} bits, compression {packing}")
    down, height = height < 0, abs(height)
    if not 0 < width * height <= most:
        raise ImageError(f"{width} by {height} pixels")
    row = -(-width * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
    raw = raw if down else raw[::-1]
    out = np.full((height, width, 4), 255, np.uint8)
    if bits <= 8:
        (used,) = struct.unpack_from("<I", data, 46)
        colours = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)
        at = np.unpackbits(raw, axis=1).reshape(height, -1, bits).dot(1 << np.arange(bits - 1, -1, -1))[:, :width]
        if at.max() >= len(colours):
            raise ImageError("a colour that the palette lacks")
        out[..., :3] = colours[at][..., :3]
    elif bits == 24:
        out[..., :3] = raw[:, : 3 * width].reshape(height, width, 3)
    else:
        values = np.ascontiguousarray(raw[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.uint32)
        masks = [0x1F, 0x3E0, 0x7C00, 0] if bits == 16 else [0xFF, 0xFF00, 0xFF0000, 0]
        if packing == 3:
            red, green, blue = struct.unpack_from("<III", data, 54)
            masks = [blue, green, red, struct.unpack_from("<I", data, 66)[0] if size >= 56 else 0]
        for i, mask in enumerate(masks):
            if mask:
                shift = (mask & -mask).bit_length() - 1
                top = mask >> shift
                out[..., i] = (((values & np.uint32(mask)) >> np.uint32(shift)).astype(np.uint64) * 255 + top // 2) // top
    return out
