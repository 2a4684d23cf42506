"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its posteriors.

Voters are lexicon terms, stems and patterns. Given terms are whole words; further ones are beginnings of words that tell
labelled toxic texts from others, found by counting. Patterns look at how texts are written: terms written with digits or signs,
terms in capitals, terms addressed to somebody, runs of exclamation marks, shouting; where nothing is found, that is told too.

The label model takes the true label as hidden. Each voter has, for each label, a probability of each vote, and voters that are
correlated are joined: a forest of the strongest conditional dependencies, each voter's votes depending on the label and on its
parent's vote. Expectation maximisation fits both from texts with and without labels, which may err. The posteriors of the sample then train a logistic regression on what the voters found, and it is this linear classifier
that scores texts: by the text alone.

Scale. Stems are found by a grouping of words, combined on the map side; they and the models are fitted on a bounded
sample (``sample`` texts of each label and of those without). Scoring is one pass over the scan, without a shuffle; the
classifier is a few kilobytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, stored, text_column

#: Mild insults that count as terms before any are learned.
INSULTS = ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "pathetic", "worthless", "trash", "scum", "clown", "disgusting", "imbecile", "jerk"]
#: Digits and signs that stand for letters.
WRITTEN_AS = str.maketrans("013457@$", "oieastas")
WORD = re.compile(r"[^\W\d_]+")
SIGNS = re.compile("[013457@$]")
TOKEN = re.compile(r"[A-Za-z013457@$]+")
SPACED = re.compile(r"\b(?:[A-Za-z][.*_-]){3,}[A-Za-z]\b")
#: Letters of a learned stem, fewest and most.
STEM = (4, 8)
ADDRESS = frozenset("you your youre ur u tu vous toi du ihr sie dich".split())
RUNS = re.compile(r"[!?]{3,}")
#: Votes.
ABSTAINS, CLEAN, TOXIC = 0, 1, 2
PATTERNS = ["swapped", "spaced", "shouted", "addressed", "crowded", "exclaimed", "capitals", "silent"]


class Lexicon:
    """Whole words and beginnings of words, each with its place among the voters."""

    def __init__(self, terms: Sequence[str], stems: Sequence[str]):
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        self.stems = {t: len(self.terms) + i for i, t in enumerate(dict.fromkeys(stems))}
        self.sizes = sorted({len(t) for t in self.stems})

    def __len__(self) -> int:
        return len(self.terms) + len(self.stems)

    def places(self, word: str) -> list[int]:
        """Of a word in lower case the term that it is and the stems that it begins with."""
        found = [self.terms[word]] if word in self.terms else []
        for n in self.sizes:
            at = self.stems.get(word[:n])
            if at is not None:
                found.append(at)
        return found


def findings(text: str, lexicon: Lexicon) -> np.ndarray:
    """How often each term, stem and pattern of PATTERNS is found in a text."""
    n = len(lexicon)
    out = np.zeros(n + len(PATTERNS), np.float32)
    words = WORD.findall(text)
    hits, shouted, capitals, bad = 0, 0, 0, set()
    for w, c in Counter(words).items():
        loud = len(w) > 2 and w.isupper()
        capitals += c * loud
        places = lexicon.places(w.lower())
        if places:
            out[places] += c
            hits += c
            shouted += c * loud
            bad.add(w)
    known = lambda w: bool(lexicon.places(w.lower()))
    swapped = sum(known(w.translate(WRITTEN_AS)) for w in TOKEN.findall(text) if SIGNS.search(w.strip("$@")) and not w.isdigit()) if SIGNS.search(text) else 0
    spaced = sum(known(re.sub(r"[.*_-]", "", w)) for w in SPACED.findall(text))
    at = [i for i, w in enumerate(words) if w in bad] if bad else []
    addressed = sum(any(w.lower() in ADDRESS for w in words[max(0, i - 4) : i + 3]) for i in at)
    out[n:] = [swapped, spaced, shouted, addressed, hits > 1, len(RUNS.findall(text)), capitals > 0.3 * max(len(words), 1), not (hits or swapped or spaced)]
    return out


def votes(found: np.ndarray) -> np.ndarray:
    """Votes of the terms and patterns: what is found says toxic, and where nothing is, ``silent`` says clean."""
    out = np.where(found > 0, TOXIC, ABSTAINS)
    out[:, -1] = np.where(found[:, -1] > 0, CLEAN, ABSTAINS)
    return out


def features(found: np.ndarray) -> np.ndarray:
    """What the classifier sees: whether something is found, and a little more the more often."""
    return np.log1p(np.minimum(found, 8)) / np.log(2)


@dataclass
class LabelModel:
    """P(y), and of each voter P(vote | y, vote of its parent); parent -1: of y alone."""

    prior: np.ndarray
    parents: list[int]
    tables: list[np.ndarray] = field(default_factory=list)  # [label, parent's vote, vote]

    def log_joint(self, v: np.ndarray) -> np.ndarray:
        total = np.repeat(np.log(self.prior)[None], len(v), 0)
        for j, (p, t) in enumerate(zip(self.parents, self.tables, strict=True)):
            up = v[:, p] if p >= 0 else np.zeros(len(v), np.int64)
            total += np.log(t[:, up, v[:, j]]).T
        return total

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(y = 1 | votes)."""
        z = self.log_joint(v)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))

    def accuracies(self, v: np.ndarray) -> np.ndarray:
        """Of each voter the share of its votes that agree with the label, expected under the model."""
        q, said = self.posterior(v), v != ABSTAINS
        right = np.where(v == TOXIC, q[:, None], 1 - q[:, None])
        return (right * said).sum(0) / np.maximum(said.sum(0), 1)


def _tables(v: np.ndarray, weights: np.ndarray, parents: list[int], base: np.ndarray) -> list[np.ndarray]:
    """Of each voter its votes by label and parent's vote; ``base`` [voters, label, vote]: counts that each begins with."""
    out = []
    for j, p in enumerate(parents):
        up = v[:, p] if p >= 0 else np.zeros(len(v), np.int64)
        t = np.repeat(base[j][:, None], 3, 1)
        for y in (0, 1):
            np.add.at(t[y], (up, v[:, j]), weights[y])
        out.append(t / t.sum(2, keepdims=True))
    return out


def dependencies(v: np.ndarray, weights: np.ndarray, least: float) -> list[int]:
    """A forest over the voters: parents by the greatest mutual information given the label, of ``least`` nats or more."""
    n, total = v.shape[1], weights.sum()
    one_hot = np.stack([(v == x).astype(np.float64) for x in range(3)], 2).reshape(len(v), -1)
    info = np.zeros((n, n))
    for y in (0, 1):
        w = weights[y]
        joint = (one_hot * w[:, None]).T @ one_hot
        joint = joint.reshape(n, 3, n, 3) / max(w.sum(), 1e-9)
        single = np.einsum("iaia->ia", joint)
        expected = single[:, :, None, None] * single[None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(joint > 0, joint * np.log(joint / np.maximum(expected, 1e-300)), 0)
        info += w.sum() / total * terms.sum((1, 3))
    parents, group = [-1] * n, list(range(n))
    edges = sorted(((-info[i, j], i, j) for i in range(n) for j in range(i + 1, n) if info[i, j] >= least))
    beside: list[list[int]] = [[] for _ in range(n)]
    for _, i, j in edges:
        if group[i] != group[j]:
            group = [group[i] if g == group[j] else g for g in group]
            beside[i].append(j)
            beside[j].append(i)
    seen: set[int] = set()
    for root in range(n):
        waiting = [(root, -1)]
        while waiting:
            at, p = waiting.pop()
            if at not in seen:
                seen.add(at)
                parents[at] = p
                waiting += [(b, at) for b in beside[at] if b not in seen]
    return parents


#: What is held of a voter before any vote is seen: how often it says nothing, clean and toxic under labels 0 and 1.
VOTER_BASE = np.array([[20.0, 2.0, 0.2], [2.0, 0.2, 0.2]])


def label_model(v: np.ndarray, y: np.ndarray, start: np.ndarray, weights: np.ndarray, trust: float = 0.98, rounds: int = 30, least: float = 0.02) -> tuple[LabelModel, np.ndarray]:
    """The model, fitted to votes [texts, voters] by expectation maximisation, and the posteriors of the texts.

    y: labels, -1 where there is none. The first model is that of the labelled texts, or without labels that of ``start``. A
    label makes up ``trust`` of a posterior, the model the rest, as labels may err. ``weights``: how many texts of the collection
    each of the sample stands for. Dependencies are found again every tenth round.
    """
    labelled = y >= 0
    q = np.where(labelled, trust * y + (1 - trust) * start, start)
    base = np.stack([VOTER_BASE] * v.shape[1])
    model = None
    for i in range(rounds):
        first = i == 0 and (y == 0).any() and (y == 1).any()
        share = np.stack([(1 - q) * weights, q * weights]) * (labelled if first else 1)
        prior = np.clip(share.sum(1) / share.sum(), 1e-6, 1)
        parents = dependencies(v, share, least) if i % 10 == 0 else model.parents
        model = LabelModel(prior, parents, _tables(v, share, parents, base))
        q = model.posterior(v)
        q = np.where(labelled, trust * y + (1 - trust) * q, q)
    return model, q


def logistic(x: np.ndarray, q: np.ndarray, weights: np.ndarray, expected: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of the columns of x and an intercept, by Newton's method on cross-entropy with posteriors q; drawn to ``expected``."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 0.01
    w = expected.copy()

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((weights * (np.logaddexp(0, z) - q * z)).sum() + (ridge * (w - expected) ** 2).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (weights * (p - q)) + ridge * (w - expected)
        step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + np.diag(ridge), g)
        now, scale = loss(w), 1.0
        while loss(w - scale * step) > now and scale > 1e-6:  # a full step may overshoot
            scale /= 2
        w = w - scale * step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray
    model: LabelModel | None = None
    accuracies: np.ndarray | None = None

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        found = np.stack([findings(t, self.lexicon) for t in texts]) if texts else np.zeros((0, len(self.weights) - 1), np.float32)
        return 1 / (1 + np.exp(-np.clip(features(found) @ self.weights[:-1] + self.weights[-1], -500, 500)))


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y): ids whose labels are 0 or 1 and agree."""
    y = F.col(f"`{label_col}`").cast("int")
    rows = labels.select(F.col(f"`{id_col}`").alias("_id"), y.alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
    return rows.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")


def run_key(text: str, words: int = 5) -> int:
    """The smallest hash of a run of words, which nearly all copies and near copies of a text share and other texts hardly do."""
    w = text.lower().split()
    return min(xxhash.xxh64_intdigest(" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))) >> 1


def _without_copies(texts: DataFrame) -> DataFrame:
    """Of the texts (_draw, _y, _text) with one label that share their ``run_key`` the one with the smallest draw."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_key", pa.array([run_key(t) for t in batch.column(2).to_pylist()], pa.int64()))

    found = texts.select("_draw", "_y", "_text").mapInArrow(keyed, "_draw double, _y int, _text string, _key long")
    return found.groupBy("_y", "_key").agg(F.min("_draw").alias("_draw"), F.min_by("_text", "_draw").alias("_text")).select("_draw", "_y", "_text")


def learned_stems(texts: DataFrame, most: int, least: int = 4, share: float = 0.01, lift: float = 20.0) -> list[str]:
    """Beginnings of words, of STEM letters, that tell toxic from other labelled texts (_y, _text); the ``most`` best.

    A stem stands in ``least`` toxic texts and a ``share`` of them, and in ``lift`` times as large a share of them as of the
    others. Stems are taken by how much they explain; of several equal ones the longest, and none that begins another's word.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}{%d,})" % STEM[0]), F.lit(1)))
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(STEM[0]), F.least(F.length(w), F.lit(STEM[1]))), lambda n: F.substring(w, F.lit(1), n)))))
    bad, good = F.sum("_y").alias("_bad"), F.sum(1 - F.col("_y")).alias("_good")
    n = texts.agg(F.coalesce(bad, F.lit(0)).alias("bad"), F.coalesce(good, F.lit(0)).alias("good")).first()
    counts = texts.select("_y", F.explode(starts).alias("_stem")).groupBy("_stem").agg(bad, good).where(F.col("_bad") >= max(least, share * n["bad"]))
    rate = ((F.col("_bad") + 0.5) / (n["bad"] + 1.0)) / ((F.col("_good") + 0.5) / (n["good"] + 1.0))
    found = counts.withColumn("_lift", rate).where(F.col("_lift") >= lift).withColumn("_worth", F.col("_bad") * F.log("_lift"))
    best = found.orderBy(F.desc("_worth"), F.desc(F.length("_stem")), "_stem").limit(50 * most).collect()
    taken: list[str] = []
    for s in (r["_stem"] for r in best):
        if len(taken) < most and not any(s.startswith(t) or t.startswith(s) for t in taken):
            taken.append(s)
    return taken


#: What a term's weight and the intercept are drawn to, which is all that is known of a term that no text of the sample has.
TERM_WEIGHT, INTERCEPT = 2.0, -3.0


def train_toxicity(docs: DataFrame, labels: DataFrame, learn: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000, terms: Sequence[str] = INSULTS, most_stems: int = 100) -> Classifier:
    """A classifier from the rows whose id ``learn`` accepts.

    Bounded sample: about ``sample`` texts with label 1, as many with label 0 and as many without one, by a hash of their
    ids, three times ``sample`` at most. ``most_stems``: how many stems are learned beside the given terms.
    """
    draw = F.shiftrightunsigned(F.xxhash64("_id", F.lit("toxicity")), 11) / F.lit(float(1 << 53))
    known = _labelled(labels.where(learn(id_col)), id_col, label_col)
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = lambda y: min(1.0, sample / max(n.get(y, 0), 1))
    picked = known.withColumn("_draw", draw).where(F.col("_draw") < F.when(F.col("_y") == 1, rate(1)).otherwise(rate(0))).orderBy("_draw").limit(3 * sample)
    rows = docs.where(learn(id_col)).select(F.col(f"`{id_col}`").alias("_id"), text_column(f"`{text_col}`").alias("_text"))
    total = rows.count()
    labelled = rows.join(F.broadcast(picked), "_id").select("_draw", "_y", "_text")
    others = rows.withColumn("_draw", draw).where(F.col("_draw") < min(1.0, sample / max(total, 1))).join(known.select("_id"), "_id", "left_anti")
    both = labelled.unionByName(others.select("_draw", F.lit(None).cast("int").alias("_y"), "_text"))
    # Copies would make words of one text look like many texts' words.
    texts = stored(_without_copies(both), "toxicity-sample")
    stems = learned_stems(texts.where("_y IS NOT NULL"), most_stems)
    place = Lexicon([t for t in terms if not any(t.startswith(x) for x in stems)], stems)
    expected = np.array([TERM_WEIGHT] * len(place) + [0.0] * len(PATTERNS) + [INTERCEPT])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [findings(t, place).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["_draw", "_y", "_found"])

    seen = texts.mapInArrow(look, "_draw double, _y int, _found binary").orderBy("_draw", "_y", "_found").limit(3 * sample).collect()
    dropped(texts)
    if not seen:
        return Classifier(place, expected)
    found = np.stack([np.frombuffer(r["_found"], np.float32) for r in seen])
    y = np.array([-1 if r["_y"] is None else r["_y"] for r in seen])
    stands_for = {1: n.get(1, 0), 0: n.get(0, 0), -1: total - n.get(0, 0) - n.get(1, 0)}
    weights = np.array([max(stands_for[k], 1) / (y == k).sum() for k in y.tolist()])
    weights *= len(weights) / weights.sum()
    v = votes(found)[:, :-1]  # that the others are silent is told by their silence
    hits = (found[:, : len(place)] > 0).any(1)
    model, q = label_model(v, y, np.where(hits, 0.8, 0.03), weights)
    return Classifier(place, logistic(features(found), q, weights, expected), model, model.accuracies(v))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, **training) -> DataFrame:
    """One row per row of ``docs``: (id, score, predicted); score is the probability of label 1 given the text, predicted 1 from ``threshold`` on.

    Null texts count as empty and are scored like any other. Null and repeated ids are carried along; labels that are null,
    neither 0 nor 1, or disagree about an id teach nothing, as do those of ids that no document has. Without labels the given terms
    alone teach; copies of a text teach once. An empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, learn, id_col, text_col, label_col, **training))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_column(f"`{text_col}`").alias("_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.scores(batch.column(1).slice(at, 256).to_pylist()) for at in range(0, batch.num_rows, 256)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], names=["_id", "score"])

    found = rows.mapInArrow(scored, f"_id {rows.schema['_id'].dataType.simpleString()}, score double")
    return found.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
