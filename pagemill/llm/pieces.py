"""SentencePiece encoding and decoding with source offsets.

Normalisation is done here, not in the library: at every position the longest prefix found in the model's compiled
character map (a double-array trie followed by its replacement strings) is replaced, and each byte put out remembers
the source byte it came from. The library then segments the normalised text with a copy of the model whose own
normaliser is switched off, and every piece is projected through that alignment to a span of the original UTF-8 bytes.
Decoding is the library's.

Scale. One pass over the scan, no shuffle; memory is that of a slice of texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import text_column

SPACE = "▁"
SPACE_BYTES = np.frombuffer(SPACE.encode(), np.uint8)
SLICE = 64


class CharacterMap:
    """A compiled character map: uint32 trie size in bytes, the trie's units, the null-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest key that ``data`` has at ``at``, and what replaces it."""
        units, found = self.units, None
        node, here = self._child(0, units[0]), at
        while here < len(data):
            node ^= data[here]
            unit = units[node]
            if unit & 0x800000FF != data[here]:
                break
            here += 1
            node = self._child(node, unit)
            if unit & 0x100:  # a key ends here; its value stands in the child with label 0
                found = here - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class Pieces:
    """A SentencePiece model with its normaliser taken out, so that alignment is known."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        self.spec = pb.NormalizerSpec()
        self.spec.CopyFrom(model.normalizer_spec)
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.whole = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        model.normalizer_spec.Clear()
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        model.normalizer_spec.escape_whitespaces = False
        self.segments = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        byte, self.unknown = pb.ModelProto.SentencePiece.BYTE, self.segments.unk_id()
        self.width = np.array([1 if p.type == byte else len(p.piece.encode()) for p in model.pieces], np.int64)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 bytes, and for each of them and the end the source byte it stands for."""
        data = text.encode("utf-8", "replace")
        source = np.frombuffer(data, np.uint8)
        if self.map:
            out, origin, at = bytearray(), [], 0
            while at < len(data):
                hit = self.map.longest(data, at)
                if hit:
                    width, put = hit
                else:
                    first = data[at]
                    width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                    put = data[at : at + width]
                out += put
                origin += [at] * len(put)
                at += width
            norm, origin = np.frombuffer(bytes(out), np.uint8), np.array(origin, np.int64)
        else:
            norm, origin = source, np.arange(len(source))
        blank = norm == 0x20
        if self.spec.remove_extra_whitespaces and blank.any():
            kept = ~(blank & np.r_[True, blank[:-1]])  # of a run its first; at the start none
            last = np.flatnonzero(~blank)
            kept[(last[-1] + 1 if len(last) else 0) :] = False
            norm, origin, blank = norm[kept], origin[kept], blank[kept]
        if self.spec.escape_whitespaces and blank.any():
            widths = np.where(blank, 3, 1)
            starts = np.cumsum(widths) - widths
            wide = np.repeat(norm, widths)
            for k in range(3):
                wide[starts[blank] + k] = SPACE_BYTES[k]
            norm, origin = wide, np.repeat(origin, widths)
        end = origin[-1:] if not len(origin) else np.array([len(data)])
        if self.spec.add_dummy_prefix and len(norm):
            mark = SPACE_BYTES if self.spec.escape_whitespaces else np.frombuffer(b" ", np.uint8)
            parts = (norm, mark) if self.suffix else (mark, norm)
            norm = np.concatenate(parts)
            pad = np.full(len(mark), len(data) if self.suffix else origin[0])
            origin = np.concatenate((origin, pad) if self.suffix else (pad, origin))
        return norm.tobytes(), np.r_[origin, end if len(end) else [0]]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, str]]:
        """Of each text its ids, the source spans of its pieces as starts and ends in bytes, and the decoded text."""
        ready = [self.normalise(x) for x in texts]
        for ids, (norm, origin) in zip(self.segments.encode([n.decode("utf-8", "replace") for n, _ in ready], num_threads=1), ready, strict=True):
            widths = self.width[ids] if ids else np.zeros(0, np.int64)
            if self.unknown in ids and widths.sum() != len(norm):  # an unknown piece is as wide as what it stands for
                found = self.segments.encode(norm.decode("utf-8", "replace"), out_type="immutable_proto")
                widths = np.array([len(p.surface.encode()) for p in found.pieces], np.int64)
            ends = np.cumsum(widths)
            yield ids, origin[ends - widths], origin[ends], self.whole.decode(ids)


@cache
def piece_model(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``. digest=False: (id, ids array<int>, starts and ends array<long>, decoded), the spans
    being bytes of the original text; digest=True: (id, n_tokens, ids_sha256, decoded_sha256, spans_crc32).

    Null and empty texts have no pieces and decode to the empty text. Null and repeated ids are carried along, other
    columns are not read; texts of any length are encoded whole. spans_crc32 is of all starts, then all ends, as
    little-endian 64-bit numbers. model: path of a SentencePiece model file.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = pieces.encode(part.column(1).to_pylist())
                if digest:
                    columns = zip(*((len(ids), sha(",".join(map(str, ids))), sha(text), zlib.crc32(np.r_[a, b].astype("<i8").tobytes())) for ids, a, b, text in found), strict=True)
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
                else:
                    columns = zip(*((ids, a, b, text) for ids, a, b, text in found), strict=True)
                    kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["_id", *(("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32") if digest else ("ids", "starts", "ends", "decoded"))]
    types = ("long", "string", "string", "long") if digest else ("array<int>", "array<long>", "array<long>", "string")
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, (rows.schema["_id"].dataType.simpleString(), *types), strict=True))
    return rows.mapInArrow(encoded, schema).withColumnRenamed("_id", id_col)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
