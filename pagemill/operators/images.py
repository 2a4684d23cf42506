"""Statistics, tone and segmentation of decoded images: rows (doc_id, width, height, stride, pixels), pixels as BGRA bytes.

Pixels stay in their row; numpy works on one image at a time inside an Arrow batch, and only numbers come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Longest side that statistics look at.
SIDE = 512


def pixels_of(width: int, height: int, stride: int, data: bytes) -> np.ndarray:
    """[height, width, 4] bytes; rows may be padded to the stride."""
    return np.frombuffer(data, np.uint8)[: height * stride].reshape(height, stride)[:, : 4 * width].reshape(height, width, 4)


def luminance(bgra: np.ndarray) -> np.ndarray:
    """Rec. 601 luminance, rounded half to even."""
    b, g, r = (bgra[..., i].astype(np.float64) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.int64)


def sampled(y: np.ndarray, side: int = SIDE) -> np.ndarray:
    step = max(1, -(-max(y.shape) // side))
    return y[::step, ::step]


def statistics(y: np.ndarray) -> tuple[float, int, float]:
    """(mean, range, edge density): steps between neighbours to the right and below, over 255."""
    y = sampled(y)
    if not y.size:
        return 0.0, 0, 0.0
    steps = [np.abs(np.diff(y, axis=a)) for a in (0, 1)]
    n = sum(s.size for s in steps)
    return float(y.mean()), int(y.max() - y.min()), float(sum(s.sum() for s in steps) / (255 * n)) if n else 0.0


def foreground_threshold(y: np.ndarray) -> float:
    """Halfway between mean and darkest tone, nearer to the mean."""
    return float(y.mean() - 0.35 * (y.mean() - y.min())) if y.size else 0.0


def ink_rows(y: np.ndarray) -> np.ndarray:
    """Dark pixels of each row."""
    return (y < foreground_threshold(y)).sum(1)


def stretched(y: np.ndarray, low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """Tones spread so that the given quantiles become black and white."""
    a, b = np.quantile(y, [low, high]) if y.size else (0, 255)
    return np.clip(np.rint((y - a) * 255.0 / max(b - a, 1.0)), 0, 255).astype(np.uint8)


def cropped(bgra: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    h, w = bgra.shape[:2]
    return bgra[max(top, 0) : min(bottom, h), max(left, 0) : min(right, w)]


def image_stats(images: DataFrame) -> DataFrame:
    """(doc_id, pixel_w, pixel_h, avg_luminance, contrast_range, edge_density)."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.doc_id, r.width, r.height, *statistics(luminance(pixels_of(r.width, r.height, r.stride, r.pixels)))) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["doc_id", "pixel_w", "pixel_h", "avg_luminance", "contrast_range", "edge_density"])

    return images.mapInPandas(stats, f"doc_id {images.schema['doc_id'].dataType.simpleString()}, pixel_w int, pixel_h int, avg_luminance double, contrast_range int, edge_density double")


def ink_histogram(images: DataFrame) -> DataFrame:
    """(doc_id, y, ink): dark pixels per row, the input of row-run segmentation."""

    def ink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                n = ink_rows(luminance(pixels_of(r.width, r.height, r.stride, r.pixels)))
                yield pd.DataFrame({"doc_id": [r.doc_id] * len(n), "y": np.arange(len(n)), "ink": n})

    return images.mapInPandas(ink, f"doc_id {images.schema['doc_id'].dataType.simpleString()}, y int, ink int")


def enhanced(images: DataFrame, invert: bool = False) -> DataFrame:
    """Images as stretched grey of the same size, inverted for dark backgrounds if asked."""

    def tone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                y = stretched(luminance(pixels_of(r.width, r.height, r.stride, r.pixels)))
                y = 255 - y if invert else y
                grey = np.stack([y, y, y, np.full_like(y, 255)], axis=2)
                out.append((r.doc_id, r.width, r.height, 4 * r.width, grey.tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "width", "height", "stride", "pixels"])

    return images.mapInPandas(tone, f"doc_id {images.schema['doc_id'].dataType.simpleString()}, width int, height int, stride int, pixels binary")


@dataclass(frozen=True)
class Segmentation:
    """How lines of text are found in an image.

    Rows with ``row_ink`` dark pixels, bridging ``gap`` rows with fewer, are runs; those under ``shortest`` rows go. A run
    that is still open at the last row reaches to it. Inside a run, columns whose dark share is ``column_share`` (and one
    pixel) end it left and right; one without such columns goes. Regions grow by ``pad`` within the image, and those nearer
    than ``close`` of its height are one. Only where nothing is found, bands of ``band`` rows that share ``shared`` are taken.
    """

    row_ink: int = 1
    gap: int = 2
    shortest: int = 3
    column_share: float = 0.02
    pad: int = 2
    close: float = 0.005
    band: int = 160
    shared: int = 24

    def regions(self, y: np.ndarray) -> list[tuple[int, int, int, int, str]]:
        """(left, top, right, bottom, kind) of a grey image, ends exclusive, from top to bottom."""
        height, width = y.shape
        if not y.size:
            return []
        ink = y < foreground_threshold(y)
        rows = np.flatnonzero(ink.sum(1) >= self.row_ink)
        found = self._lines(ink, rows) if len(rows) else []
        if found:
            return found
        step = max(self.band - self.shared, 1)
        return [(0, top, width, min(top + self.band, height), "band") for top in range(0, max(height - self.shared, 1), step)]

    def _lines(self, ink: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, str]]:
        """Regions of the runs that ``rows``, those with enough ink, make; all runs of the image at once."""
        height, width = ink.shape
        cuts = np.flatnonzero(np.diff(rows) > self.gap + 1)
        tops, bottoms = rows[np.r_[0, cuts + 1]], rows[np.r_[cuts, len(rows) - 1]]
        ends = np.where(height - 1 - bottoms <= self.gap, height, bottoms + 1)
        long = ends - tops >= self.shortest
        tops, ends = tops[long], ends[long]
        if not len(tops):
            return []
        # Runs lie apart, so their rows and those between them alternate; nothing may begin behind the last row.
        bounds = np.stack([tops, ends], axis=1).ravel()
        dark = np.add.reduceat(ink, bounds[bounds < height], axis=0, dtype=np.int32)[::2]
        columns = dark >= np.maximum(1.0, self.column_share * (ends - tops))[:, None]
        some = columns.any(1)
        if not some.any():
            return []
        tops, ends, columns = tops[some], ends[some], columns[some]
        lefts, rights = columns.argmax(1), width - columns[:, ::-1].argmax(1)
        lefts, tops, rights, ends = np.maximum(lefts - self.pad, 0), np.maximum(tops - self.pad, 0), np.minimum(rights + self.pad, width), np.minimum(ends + self.pad, height)
        # Bottoms come in order, so the lowest one so far is that of the run before.
        begins = np.flatnonzero(np.r_[True, tops[1:] - ends[:-1] > self.close * height])
        boxes = zip(np.minimum.reduceat(lefts, begins).tolist(), tops[begins].tolist(), np.maximum.reduceat(rights, begins).tolist(), np.maximum.reduceat(ends, begins).tolist(), strict=True)
        return [(*box, "line") for box in boxes]


#: Rows, and bytes of pixels, that a task gathers before it hands them on.
ROWS, PIXELS = 10_000, 8 << 20


def text_regions(images: DataFrame, how: Segmentation = Segmentation(), crops: bool = False) -> DataFrame:  # noqa: B008
    """(doc_id, region, x, y, w, h, kind) of the lines of text in each image, with ``crops`` their pixels (BGRA, stride) as well.

    One pass over an image: threshold, row runs, columns of each run, merging, bands where nothing is found, and the crops
    are made while its pixels are at hand. An image without pixels has no regions.
    """

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A frame for many images, as making one costs more than finding an image's regions.
        rows, n_bytes = [], 0
        for pdf in batches:
            for r in pdf.itertuples():
                bgra = pixels_of(r.width, r.height, r.stride, r.pixels)
                for k, (left, top, right, bottom, kind) in enumerate(how.regions(luminance(bgra))):
                    cut = (4 * (right - left), np.ascontiguousarray(cropped(bgra, left, top, right, bottom)).tobytes()) if crops else ()
                    rows.append((r.doc_id, k, left, top, right - left, bottom - top, kind, *cut))
                    n_bytes += len(cut[1]) if crops else 0
                if len(rows) >= ROWS or n_bytes >= PIXELS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, n_bytes = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "region", "x", "y", "w", "h", "kind", *(["stride", "pixels"] if crops else [])]
    schema = f"doc_id {images.schema['doc_id'].dataType.simpleString()}, region int, x int, y int, w int, h int, kind string" + (", stride int, pixels binary" if crops else "")
    return images.select("doc_id", "width", "height", "stride", "pixels").mapInPandas(segment, schema)
