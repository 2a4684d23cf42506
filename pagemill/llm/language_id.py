"""Language ID with a byte convolutional network, trained in numpy and applied to batched fixed-length windows.

Filters of several widths slide over bytes; each filter's greatest response in a window goes to a softmax layer. A
text's prediction is the mean of its windows' log-probabilities. Windows overlap by the widest filter less one byte,
so every run of bytes that a filter can see lies in some window, and texts of any length are read to the end.

A filter's response is a sum of per-byte terms (byte embedding times filter), so trained filters are folded into
tables over pairs of bytes; applying one is a few table lookups per byte.

Scale. Training reads one bounded sample of labelled windows (``sample`` documents a language, chosen by a hash of
the id, windows from anywhere in the text). The weights are a few megabytes at any corpus size. Prediction is one pass
over the scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import text_column

WINDOW = 256
#: Windows that go through the filters at once: their responses stay in the processor's cache.
BATCH = 256


@dataclass
class ByteCnn:
    """Embedding [256, d], filters {width: [width, d, f]} with bias [f], softmax weights [F, languages] with bias."""

    langs: list[str]
    embedding: np.ndarray
    filters: dict[int, tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, dict]:
        """Max-pooled responses of training windows, and what the gradient needs."""
        x = self.embedding[windows]
        pooled, kept = [], {}
        for width, (k, b) in self.filters.items():
            n = x.shape[1] - width + 1
            patches = np.concatenate([x[:, j : j + n] for j in range(width)], axis=2)
            h = patches @ k.reshape(-1, k.shape[2]) + b
            at = h.argmax(axis=1)
            top = np.take_along_axis(h, at[:, None], 1)[:, 0]
            kept[width] = (patches, at, top)
            pooled.append(np.maximum(top, 0))
        return np.concatenate(pooled, axis=1), kept

    @classmethod
    def trained(cls, windows: np.ndarray, labels: np.ndarray, langs: list[str], widths: Sequence[int], filters: int, dim: int, epochs: int, seed: int) -> ByteCnn:
        """Fitted by Adam on cross-entropy. windows: [n, WINDOW] bytes; labels: indexes into ``langs``."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        net = cls(langs, normal(256, dim) * 0.5, {w: (normal(w, dim, filters) / np.sqrt(np.float32(w * dim)), np.zeros(filters, np.float32)) for w in widths}, normal(filters * len(widths), len(langs)) * 0.05, np.zeros(len(langs), np.float32))
        params = [net.embedding, net.out, net.out_bias, *(a for kb in net.filters.values() for a in kb)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 64)):
                w, y = windows[rows], labels[rows]
                h, kept = net.responses(w)
                z = h @ net.out + net.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                dh = p @ net.out.T
                grads, d_embedding = [None, h.T @ p, p.sum(0)], np.zeros_like(net.embedding)
                for i, (width, (k, _)) in enumerate(net.filters.items()):
                    patches, at, top = kept[width]
                    d = dh[:, i * filters : (i + 1) * filters] * (top > 0)
                    picked = patches[np.arange(len(w))[:, None], at]  # [n, f, width*dim]
                    grads += [np.einsum("nfp,nf->pf", picked, d).reshape(k.shape), d.sum(0)]
                    for j in range(width):
                        np.add.at(d_embedding, w[np.arange(len(w))[:, None], at + j], d[:, :, None] * k[j].T[None])
                grads[0] = d_embedding
                step += 1
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for q, g, (m, v) in zip(params, grads, moments, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    q -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
        return net

    def tables(self) -> list[tuple[int, list[np.ndarray], np.ndarray]]:
        """Each width's filters as tables over byte pairs, and over one byte where the width is odd."""
        out = []
        for width, (k, b) in self.filters.items():
            single = [self.embedding @ k[j] for j in range(width)]
            pairs = [(single[j][:, None] + single[j + 1][None]).reshape(65536, -1) for j in range(0, width - 1, 2)]
            out.append((width, pairs + ([single[-1]] if width % 2 else []), b))
        return out


def scorer(net: ByteCnn):
    """A function from a list of texts to (n, languages) mean log-probabilities; rows without a byte are uniform."""
    tables, widest = net.tables(), max(net.filters)

    def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        step = WINDOW - widest + 1
        owners, parts = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            data = np.frombuffer(t, np.uint8)
            n = max(1, -(-(len(data) - widest + 1) // step))
            padded = np.full((n - 1) * step + WINDOW, 0x20, np.uint8)
            padded[: len(data)] = data[: len(padded)]
            parts.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step])
            owners += [i] * n
        return (np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.uint8)), np.array(owners, np.int64)

    def log_probabilities(windows: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(windows.T)
        pairs = columns[:-1].astype(np.int32) * 256 + columns[1:]
        pooled = []
        for width, parts, bias in tables:
            top = None
            for t in range(WINDOW - width + 1):
                h = None
                for j, part in enumerate(parts):
                    term = part.take(pairs[t + 2 * j] if len(part) > 256 else columns[t + 2 * j], axis=0)
                    h = term if h is None else np.add(h, term, out=h)
                top = h if top is None else np.maximum(top, h, out=top)
            pooled.append(np.maximum(top + bias, 0))
        z = np.concatenate(pooled, axis=1) @ net.out + net.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def score(texts: list[str]) -> np.ndarray:
        total, count = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
        windows, owners = windows_of([x.encode("utf-8", "replace") for x in texts])
        for at in range(0, len(windows), BATCH):
            lp, own = log_probabilities(windows[at : at + BATCH]), owners[at : at + BATCH]
            np.add.at(total, own, lp)
            np.add.at(count, own, 1)
        total[count == 0] = -np.log(len(net.langs))
        return total / np.maximum(count, 1)[:, None]

    return score


def train_language_id(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 300, windows: int = 4, most_langs: int = 1000, epochs: int = 6, seed: int = 7) -> ByteCnn | None:
    """A network for the non-null languages of the rows where ``learn`` holds; None if there are none.

    Bounded sample: about ``sample`` documents of each language by a hash of their id, at most twice that, and
    ``windows`` windows of each at places chosen by the hash over the whole text. Rarer languages keep all rows. Of
    more than ``most_langs`` languages, as a dirty column may have, the most frequent are learned.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(most_langs).collect()}
    if not counts:
        return None
    rates = rows.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in counts.items()], "_lang string, _rate double")
    draw = F.xxhash64("_id", F.lit("sample"))
    picked = rows.join(F.broadcast(rates), "_lang").where((F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))) < F.col("_rate"))
    at = lambda k: F.pmod(F.xxhash64("_id", F.lit(k)), F.greatest(F.length("_text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    picked = picked.select("_lang", draw.alias("_draw"), F.array(*[F.substring("_text", at(k), F.lit(WINDOW)) for k in range(windows)]).alias("_windows"))
    found = picked.orderBy("_draw", "_lang", "_windows").limit(2 * sample * len(counts)).collect()
    langs = sorted(counts)
    data = [(np.frombuffer(w.encode()[:WINDOW].ljust(WINDOW), np.uint8), langs.index(r["_lang"])) for r in found for w in r["_windows"]]
    return ByteCnn.trained(np.stack([d for d, _ in data]), np.array([y for _, y in data]), langs, widths=(2, 3, 4), filters=16, dim=8, epochs=epochs, seed=seed)


def language_id(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """One row per row of ``docs``: (id, lang_pred, score).

    Learns from rows where ``learn`` (default: all) holds and the language is known; predictions read the text alone.
    Texts that are null or hold no letter get ``und`` with score 0; so do all if there is nothing to learn from. score is the
    mean probability of the language over windows (geometric mean, renormalised). Ties go to the first language by
    name. Null and repeated ids are carried along; other columns are not read.
    """
    net = train_language_id(docs, F.lit(True) if learn is None else learn, id_col, text_col, lang_col, **training)
    rows = docs.select(F.col(id_col).alias("_id"), text_column(text_col).alias("_text"))
    if net is None:
        return rows.select(F.col("_id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        langs = shared.value.langs
        for batch in batches:
            pred, best = [], []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                lp = score(texts)
                p = np.exp(lp - lp.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for x, k, v in zip(texts, lp.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    letters = any(map(str.isalpha, x))  # Unicode letters, not other numerals or marks
                    pred.append(langs[k] if letters else "und")
                    best.append(v if letters else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(best, pa.float64())], ["_id", "lang_pred", "score"])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(predicted, schema).withColumnRenamed("_id", id_col)
