"""Image decoding: bit-equal on files that this test writes itself, with a plain encoder of every filter, depth and colour type."""

import random
import struct
import zlib

import numpy as np
import pytest

from pagemill.sources.decode import PASSES, PNG, ImageError, decoded, upright
from pagemill.sources.images import read_images

SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def packed(rows, depth):
    """Rows of samples as bytes, written bit by bit."""
    out = []
    for row in rows:
        bits = "".join(f"{v:0{depth}b}" for px in row for v in px)
        bits += "0" * (-len(bits) % 8)
        out.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
    return out


def filtered(lines, step, kinds):
    out, before = bytearray(), None
    for i, line in enumerate(lines):
        kind = kinds[i % len(kinds)]
        out.append(kind)
        before = before if before else [0] * len(line)
        for k, v in enumerate(line):
            a, b, c = line[k - step] if k >= step else 0, before[k], before[k - step] if k >= step else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - [0, a, b, (a + b) // 2, best][kind]) % 256)
        before = line
    return bytes(out)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(rows, depth, colour, kinds=(0, 1, 2, 3, 4), interlaced=False, extra=()):
    step = max(1, SAMPLES[colour] * depth // 8)
    height, width = len(rows), len(rows[0])
    body = b""
    for left, top, across, down in PASSES if interlaced else [(0, 0, 1, 1)]:
        part = [row[left::across] for row in rows[top::down]]
        if part and part[0]:
            body += filtered(packed(part, depth), step, kinds)
    data = zlib.compress(body)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    return PNG + chunk(b"IHDR", head) + b"".join(chunk(k, b) for k, b in extra) + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


def drawn(rng, width, height, depth, colour):
    return [[tuple(rng.randrange(1 << depth) for _ in range(SAMPLES[colour])) for _ in range(width)] for _ in range(height)]


def byte(v, depth):
    return v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1)


def shown(rows, depth, colour, palette=None, alpha=(), key=None):
    out = []
    for row in rows:
        for px in row:
            if colour == 3:
                r, g, b = palette[px[0]]
                a = alpha[px[0]] if px[0] < len(alpha) else 255
            else:
                v = [byte(x, depth) for x in px]
                r, g, b = v[:3] if len(v) >= 3 else v[:1] * 3
                a = v[-1] if len(v) in (2, 4) else 0 if key is not None and px == key else 255
            out.append((b, g, r, a))
    return np.array(out, np.uint8).reshape(len(rows), len(rows[0]), 4)


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("depth,colour", [(d, 0) for d in (1, 2, 4, 8, 16)] + [(d, 3) for d in (1, 2, 4, 8)] + [(d, c) for c in (2, 4, 6) for d in (8, 16)])
def test_png_is_bit_equal(depth, colour, interlaced):
    rng = random.Random(depth * 10 + colour)
    palette = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(256)]
    alpha = [rng.randrange(256) for _ in range(min(3, 1 << depth))]
    for width, height in ((1, 1), (7, 5), (13, 11), (3, 17)):
        rows = drawn(rng, width, height, depth, colour)
        key = rows[0][0] if colour in (0, 2) else None
        extra = [(b"PLTE", bytes(sum(palette[: 1 << depth], ()))), (b"tRNS", bytes(alpha))] if colour == 3 else [(b"tRNS", struct.pack(f">{len(key)}H", *key))] if key else []
        got = decoded(png(rows, depth, colour, interlaced=interlaced, extra=extra))
        assert np.array_equal(got, shown(rows, depth, colour, palette, alpha, key))
    for kind in range(5):
        rows = drawn(rng, 9, 4, depth, colour)
        assert np.array_equal(decoded(png(rows, depth, colour, (kind,), extra=[(b"PLTE", bytes(sum(palette, ())))] if colour == 3 else [])), shown(rows, depth, colour, palette))


def bmp(rows, bits, down=False, palette=b"", masks=None):
    body = b""
    for row in rows if down else rows[::-1]:
        line = "".join(f"{v:0{bits}b}" for v in row) if bits <= 8 else b"".join(v.to_bytes(bits // 8, "little") for v in row)
        line = bytes(int(line[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(line), 8)) if bits <= 8 else line
        body += line + bytes(-len(line) % 4)
    more = struct.pack("<III", *masks) if masks else b""
    head = struct.pack("<IiiHHIIiiII", 40, len(rows[0]), -len(rows) if down else len(rows), 1, bits, 3 if masks else 0, len(body), 0, 0, 0, 0) + more + palette
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body


@pytest.mark.parametrize("bits", [1, 4, 8, 16, 24, 32])
@pytest.mark.parametrize("down", [False, True])
def test_bmp_is_bit_equal(bits, down):
    rng = random.Random(bits)
    rows = [[rng.randrange(1 << min(bits, 24)) & (0x7FFF if bits == 16 else -1) for _ in range(7)] for _ in range(5)]
    palette = bytes(rng.randrange(256) for _ in range(4 << bits)) if bits <= 8 else b""
    five = lambda v: (v * 255 + 15) // 31
    pixel = lambda v: (*palette[4 * v : 4 * v + 3], 255) if bits <= 8 else (five(v & 31), five(v >> 5 & 31), five(v >> 10), 255) if bits == 16 else (v & 255, v >> 8 & 255, v >> 16 & 255, 255)
    assert decoded(bmp(rows, bits, down, palette)).tolist() == [[list(pixel(v)) for v in row] for row in rows]
    if bits == 32:
        assert decoded(bmp(rows, bits, down, masks=(0xFF, 0xFF00, 0xFF0000))).tolist() == [[[v >> 16 & 255, v >> 8 & 255, v & 255, 255] for v in row] for row in rows]


def test_exif_turns_images_upright():
    rows = drawn(random.Random(1), 3, 2, 8, 2)
    flat = shown(rows, 8, 2)
    want = {1: flat, 2: flat[:, ::-1], 3: flat[::-1, ::-1], 4: flat[::-1], 5: flat.transpose(1, 0, 2), 6: np.rot90(flat, -1), 7: np.rot90(flat, -1)[::-1][:, :][::1], 8: np.rot90(flat, 1)}
    want[7] = flat[::-1, ::-1].transpose(1, 0, 2)
    for turned, image in want.items():
        exif = b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, turned, 0)
        assert np.array_equal(decoded(png(rows, 8, 2, extra=[(b"eXIf", exif)])), image) and np.array_equal(upright(flat, turned), image)


def test_damaged_files_say_so():
    good = png(drawn(random.Random(2), 4, 4, 8, 6), 8, 6)
    for data in (b"", b"junk", good[:-20], good[:40], good.replace(b"IDAT", b"IDAX", 1), good[:60] + bytes([good[60] ^ 1]) + good[61:], bmp([[0]], 24)[:30], png([[(9,)]], 8, 3), bmp([[1] * 4], 24)[:-3]):
        with pytest.raises(ImageError):
            decoded(data)
    with pytest.raises(ImageError, match="pixels"):
        decoded(good, most=15)


def test_source_reads_folders(spark, tmp_path):
    rng, want = random.Random(3), {}
    for i in range(9):
        rows = drawn(rng, 5 + i, 4, 8, 2)
        at = tmp_path / f"f{i % 2}" / f"i{i}.{'PNG' if i % 3 else 'png'}"
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(png(rows, 8, 2))
        want[str(at)] = shown(rows, 8, 2)
    (tmp_path / "bad.bmp").write_bytes(b"BMno")
    (tmp_path / "photo.jpeg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "note.txt").write_text("no image")
    df = read_images(spark, str(tmp_path), group=1500)
    rows = {r.path: r for r in df.collect()}
    assert len(rows) == 11 and {p for p, r in rows.items() if r.error} == {str(tmp_path / "bad.bmp"), str(tmp_path / "photo.jpeg")}
    for p, image in want.items():
        r = rows[p]
        assert (r.height, r.width, r.stride) == (*image.shape[:2], 4 * image.shape[1]) and bytes(r.pixels) == image.tobytes()
    assert 1 < df.rdd.getNumPartitions() < 11
    (tmp_path / "none").mkdir()
    assert read_images(spark, str(tmp_path / "none")).count() == 0
    from pagemill.operators.images import image_stats

    assert image_stats(df.where("error IS NULL").withColumnRenamed("path", "doc_id")).count() == 9
