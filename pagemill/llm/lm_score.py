"""Language-model scoring with a weighted backoff automaton.

States are the histories (up to order - 1 tokens) that occur in training, with the empty history as root. A state has
an arc for every token that followed it in training, weighted with the smoothed log10 probability, and a failure arc
to the next shorter history, weighted with the mass it leaves over. A text is scored in one traversal from left to
right that carries a state: while the state has no arc for the token the failure arc is taken, then the arc, and all
weights add up. The texts of a block are read side by side, token position by token position; long ones in lanes.

Smoothing. p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and for a history h with shorter history h'
p(w | h) = (c(h w) + strength p(w | h')) / (c(h) + strength), so failure arcs weigh strength / (c(h) + strength).

Scale. Counts of all n-grams are gathered with ``exchange``: every block of documents gets the totals of its own
n-grams and builds the part of the automaton that its texts can reach, which is exact for them. The whole automaton,
which grows with the corpus, is never in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import distinct, mix64
from pagemill.llm.exchange import finished, in_blocks, texts_of, totals

SHIFT = np.uint64(0x9E3779B97F4A7C15)
#: The bits of an n-gram's key that travel, of more than one token: 56.
KEPT = np.uint64(2**64 - 256)
#: Tokens that a lane reads.
LANE = 512
#: Local ids of the marks before and after a text.
START, END = 0, 1


class Grams:
    """A block's token sequence, each text between the two marks, and its distinct n-grams."""

    def __init__(self, texts: list[bytes], learned: np.ndarray, order: int):
        lists = [x.lower().split() for x in texts]  # bytes: A-Z alone, ASCII white space alone
        self.sizes = np.array([len(x) for x in lists], np.int64)
        words = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
        # Marks hash like words that no text can have, as they hold white space.
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in (b" start", b" end", *words.dictionary.to_pylist())], np.uint64)
        lengths = self.sizes + 2
        ends = np.cumsum(lengths)
        tokens = np.full(int(lengths.sum()), -1, np.int64)
        tokens[ends - lengths], tokens[ends - 1] = START, END
        tokens[tokens < 0] = words.indices.to_numpy() + 2
        self.tokens, self.ends, self.lengths = tokens, ends, lengths
        place = np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)
        train = np.repeat(learned.astype(np.int64), lengths)
        #: Per order from 1: at each position the n-gram that ends there (-1: it would begin before the text); of each n-gram its key, history and suffix (ids one order lower), last token and training count in the block.
        self.at, self.keys, self.history, self.suffix, self.last, self.counts = [tokens], [mix64(hashes)], [None], [None], [np.arange(len(hashes))], [np.bincount(tokens, train, len(hashes)).astype(np.int64)]
        for k in range(2, order + 1):
            here = np.flatnonzero(place >= k - 1)
            code = self.at[-1][here - 1] * len(hashes) + tokens[here]
            codes, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            at = np.full(len(tokens), -1, np.int64)
            at[here] = inverse
            history, last = codes // len(hashes), codes % len(hashes)
            self.suffix.append(self.at[-1][here[first]])
            self.at.append(at)
            self.history.append(history)
            self.last.append(last)
            self.keys.append(mix64(self.keys[-1][history] * SHIFT + hashes[last] + np.uint64(k)) & KEPT)
            self.counts.append(np.bincount(inverse, train[here], len(codes)).astype(np.int64))

    def counted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted distinct keys and training counts of each order; the start mark is not a token."""
        out = []
        for k, (keys, counts) in enumerate(zip(self.keys, self.counts, strict=True)):
            keys, counts = (keys[1:], counts[1:]) if k == 0 else (keys, counts)
            distinct, inverse = np.unique(keys, return_inverse=True)
            out.append((distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)))
        return out

    def scores(self, found: list[np.ndarray], n: int, v: int, texts_learned: int, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the known tokens, the base score and the automaton's score. found: per order the totals of the sorted keys."""
        count = [np.empty(0)] * len(self.keys)
        for k, keys in enumerate(self.keys):
            own = keys[1:] if k == 0 else keys
            count[k] = found[k][np.searchsorted(distinct(own), own)]
        count[0] = np.r_[texts_learned, count[0]]  # a text's start is the history of its first token
        base = (count[0] + 0.5) / (n + 0.5 * (v + 1))
        base_log, scored = np.log10(base), self.at[0] != START
        texts = np.repeat(np.arange(len(self.lengths)), self.lengths)[scored]
        tokens = self.tokens[scored]
        known = np.bincount(texts, count[0][tokens] > 0, len(self.lengths)).astype(np.int64)
        base_score = np.bincount(texts, base_log[tokens], len(self.lengths))
        return known, base_score, Automaton(self, count, base, strength).scores()


class Automaton:
    """The states and arcs that a block's texts can reach.

    A state is an n-gram shorter than the order that was seen in training, or the root; ``arc`` has for each n-gram
    the weight of the arc by its last token from its history, ``backoff`` the weight of the failure arc of each n-gram
    as a state, and ``seen`` whether it is there at all.
    """

    def __init__(self, grams: Grams, count: list[np.ndarray], base: np.ndarray, strength: float):
        self.at, self.ends, self.lengths = grams.at, grams.ends, grams.lengths
        p, self.arc, self.backoff, self.seen = base, [np.log10(base)], [], []
        for k in range(1, len(grams.keys)):
            p = (count[k] + strength * p[grams.suffix[k]]) / (count[k - 1][grams.history[k]] + strength)
            self.arc.append(np.log10(p))
        for n in count:
            self.seen.append(np.append(n > 0, False))  # the last: n-grams that would begin before the text, -1
            self.backoff.append(np.log10(strength / (n + strength)))

    def read(self, size: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Reads the tokens at ``here``, one a lane, from states of ``size`` tokens, which it moves on; returns the weights taken."""
        top, weight = len(self.arc) - 1, np.zeros(len(here))
        for k in range(top, 0, -1):  # states of k tokens without an arc for the token, an n-gram of k + 1, fail to their suffix
            gram = self.at[k][here]
            fails = np.flatnonzero((size == k) & ~self.seen[k][gram])
            weight[fails] += self.backoff[k - 1][self.at[k - 1][here[fails] - 1]]
            size[fails] = k - 1
        for k in range(top, -1, -1):  # lanes move on to a size that is done already
            lanes = np.flatnonzero(size == k)
            gram = self.at[k][here[lanes]]
            weight[lanes] += self.arc[k][gram]
            # The root has an arc for every token; one that was never seen leads back to it.
            size[lanes] = np.minimum(k + 1, top) if k else self.seen[0][gram]
        return weight

    def scores(self) -> np.ndarray:
        """Of each text the sum of weights from its first token to its end, all lanes read side by side from left to right.

        A long text has several lanes. A lane that does not begin a text first reads, unweighted, as many tokens as a
        state can hold, after which its state is the one that a reader from the beginning would be in.
        """
        warm = len(self.arc) - 1
        counts = -(-(self.lengths - 1) // LANE)
        text = np.repeat(np.arange(len(counts)), counts)
        begins = (self.ends - self.lengths)[text]
        first = begins + 1 + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * LANE
        last = np.minimum(first + LANE, self.ends[text])
        here = np.maximum(begins, first - warm)
        size, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        lanes = np.argsort(here - last, kind="stable")  # the longest first, so that those still reading are a prefix
        here, first, last, size = here[lanes], first[lanes], last[lanes], size[lanes]
        left = last - here
        for step in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -step, side="left"))  # lanes with more than ``step`` tokens
            now, state = here[:n] + step, size[:n]
            weight = self.read(state, now)
            total[:n] += np.where(now >= first[:n], weight, 0)
        return np.bincount(text[lanes], total, len(counts))


def lm_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, strength: float = 8.0, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: (id, learned, n_tokens, n_known, train_tokens, base_score, score), scores in log10.

    Tokens: the words between ASCII white space with A-Z lowered, and one end mark. The model is learned from the rows
    where ``learn`` holds (null: not). base_score adds up the unigram weights alone. A null text is empty: one token,
    the end mark. Null and repeated ids are carried along, other columns are not read. With nothing to learn from all
    tokens are unknown and weigh log10(0.5 / 0.5) = 0. An empty table gives an empty result.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    rows, blocks = in_blocks(docs, id_col, text_col, F.coalesce(learn, F.lit(False)).alias("_learn"), block_bytes=block_bytes)
    grams = lambda t: Grams(texts_of(t), np.array(t.column("_learn").to_pylist(), bool), order)
    answers = totals(rows, blocks, lambda t: grams(t).counted())
    n, v = answers.where("_block = -1 AND _kind = 0").agg(F.coalesce(F.sum("_sum"), F.lit(0)), F.coalesce(F.sum("_distinct"), F.lit(0))).first()
    learned = docs.where(learn).count()

    def finish(table: pa.Table, found: list[np.ndarray]) -> pa.Table:
        g = grams(table)
        known, base_score, score = g.scores(found, n, v, learned, strength)
        return pa.Table.from_arrays([table.column("_id"), table.column("_learn"), pa.array(g.sizes + 1), pa.array(known), pa.array(np.full(len(known), n)), pa.array(base_score), pa.array(score)], names)

    names = ["_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return finished(rows, answers, order, finish, schema).withColumnRenamed("_id", id_col)
