"""Registered queries without SQL against plain Python over the same whole tables."""

import math
import re

import pytest

from pagemill.plans import registry
from pagemill.sources.layout import LINE_STEP


@pytest.fixture(scope="module")
def texts(tiny):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{tiny}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


def laid_out(texts):
    """(doc, line) -> words as [word_index, text, x, y, w, h, confidence]."""
    out = {}
    for doc, text in texts.items():
        for j, line in enumerate((text or "").split("\n")):
            words = [[j * LINE_STEP + i, t, 160.0 * i, 24.0 * j, float(max(10, 8 * len(t))), 18.0, float(60 + (len(t) * 7 + i * 3) % 40)] for i, t in enumerate(line.split(" ")) if t]
            if words:
                out[doc, j] = words
    return out


def union(a, b):
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return [x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y]


def test_rect_merge(spark, tiny, texts):
    want = []
    for (doc, j), words in laid_out(texts).items():
        grown = []
        for box in sorted(w[2:6] for w in words):
            if grown and box[0] - (grown[-1][0] + grown[-1][2]) <= 0.5 * grown[-1][3]:
                grown[-1] = union(grown[-1], box)
            else:
                grown.append(box)
        want += [(doc, j, k, *box) for k, box in enumerate(grown)]
    got = [tuple(r) for r in registry.QUERIES["rect_merge"](spark, tiny).select("doc_id", "line_index", "at", *"xywh").collect()]
    assert sorted(got) == sorted(want)


def test_fragment_merge(spark, tiny, texts):
    plain, want = re.compile(r"[^\W_]+"), []
    script = lambda t: "c" if re.search("[\u0400-\u04ff]", t) else "l" if re.search("[A-Za-z\u00aa-\u024f]", t) else None
    for (doc, j), words in laid_out(texts).items():
        spread = [list(w) for w in words]
        for before, w in zip(words, spread[1:], strict=False):
            if w[0] % 4 == 1:
                w[2] += before[4] - 160
        grown = []
        if spread[0][0] % 4 == 1:
            spread[0][2] = float("nan")
        for w in spread:
            a = grown[-1] if grown else None
            if a and not math.isnan(a[2]):
                gap, reach = w[2] - (a[2] + a[4]), 0.12 * (a[5] + w[5]) / 2
                scripts = {script(a[1]), script(w[1])} - {None}
                if abs(gap) <= reach and min(len(a[1]), len(w[1])) > 1 and plain.fullmatch(a[1]) and plain.fullmatch(w[1]) and len(scripts) < 2:
                    grown[-1] = [a[0], a[1] + w[1], *union(a[2:6], w[2:6]), (a[6] + w[6]) / 2]
                    continue
            grown.append(w)
        want += [(doc, w[0], w[1], w[6]) for w in grown]
    got = [(r.doc_id, r.word_index, r.text, r.confidence) for r in registry.QUERIES["fragment_merge"](spark, tiny).collect()]
    assert sorted(got) == sorted(want) and len(got) < sum(map(len, laid_out(texts).values()))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


def test_near_token_dictionary(spark, tiny, texts):
    want = set()
    for t in {re.sub(r"\s+", " ", w[1]).strip() for ws in laid_out(texts).values() for w in ws}:
        prefix, core, suffix = re.fullmatch(r"""([(\[{"'\u00ab]*)(.*?)([,;:!?)\]}"']*)""", t, re.S).groups()
        entry = next((term for term, most in registry.DICTIONARY if core and levenshtein(core.lower(), term) <= most), None)
        if entry and prefix + entry + suffix != t:
            want.add((t, prefix + entry + suffix))
    assert {tuple(r) for r in registry.QUERIES["near_token_dictionary"](spark, tiny).select("token", "repaired").collect()} == want and want


def tones(text):
    data = (text or "").encode()
    return [[round(0.114 * p[0] + 0.587 * p[1] + 0.299 * p[2]) for p in (data[64 * i + 4 * k : 64 * i + 4 * k + 4] for k in range(16))] for i in range(len(data) // 64)]


def test_images(spark, tiny, texts):
    stats = {r.doc_id: r for r in registry.QUERIES["image_statistics"](spark, tiny).collect()}
    runs = {}
    for r in registry.QUERIES["ink_row_runs"](spark, tiny).collect():
        runs.setdefault(r.doc_id, []).append((r.top, r.bottom))
    assert set(stats) == set(texts)
    for doc, text in texts.items():
        y = tones(text)
        step = max(1, -(-max(len(y), 16) // 512))
        seen = [row[::step] for row in y[::step]]
        flat = [v for row in seen for v in row]
        mean = sum(flat) / len(flat) if flat else 0.0
        assert stats[doc].avg_luminance == pytest.approx(mean, abs=1e-5) and stats[doc].contrast_range == (max(flat) - min(flat) if flat else 0)
        steps = [abs(a - b) for row in seen for a, b in zip(row, row[1:], strict=False)] + [abs(a - b) for r, s in zip(seen, seen[1:], strict=False) for a, b in zip(r, s, strict=True)]
        assert stats[doc].edge_density == pytest.approx(sum(steps) / (255 * len(steps)) if steps else 0.0, abs=1e-5)
        every = [v for row in y for v in row]
        level = sum(every) / len(every) - 0.35 * (sum(every) / len(every) - min(every)) if every else 0.0
        want = []
        for i, row in enumerate(y):
            if sum(v < level for v in row) >= 5:
                if want and i - want[-1][1] <= 3:
                    want[-1][1] = i
                else:
                    want.append([i, i])
        assert sorted(runs.get(doc, [])) == [tuple(w) for w in want]


def test_corrected_counts_are_of_corrected_words(spark, tiny):
    changed = registry.QUERIES["corrected_words"](spark, tiny).where("changed").groupBy("doc_id").count().collect()
    counts = {r.doc_id: r.n_corrected for r in registry.QUERIES["corrected_counts"](spark, tiny).collect()}
    assert {r.doc_id: r["count"] for r in changed} == {k: n for k, n in counts.items() if n}
