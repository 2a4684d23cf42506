"""corrected_words, postprocessed_words and postprocessed_analysis against plain Python over the same whole tables."""

import re
from collections import Counter

import pytest

from pagemill.operators import repair
from pagemill.plans import registry
from test_plain import levenshtein, union

LATIN_LOOKS, CYRILLIC_LOOKS = "ABCEHKMOPTXYaceopxyk", "АВСЕНКМОРТХУасеорхук"
TO_CYRILLIC, TO_LATIN = str.maketrans(LATIN_LOOKS, CYRILLIC_LOOKS), str.maketrans(CYRILLIC_LOOKS, LATIN_LOOKS)
PROTECTED = ["://", "www.", "@", "\\", ".com", ".org", ".net", ".exe", ".dll", ".zip", ".json"]
is_latin, is_cyrillic = re.compile("[A-Za-zªºÀ-ÖØ-öø-ʸ]").match, re.compile("[Ѐ-ԯ]").match


def counts(t):
    return sum(bool(is_latin(c)) for c in t), sum(bool(is_cyrillic(c)) for c in t), sum(c in LATIN_LOOKS for c in t), sum(c in CYRILLIC_LOOKS for c in t)


def protected(t):
    return any(p.upper() in t.upper() for p in PROTECTED) or bool(len(t) <= 4 and re.fullmatch("[A-Z0-9]*[0-9][A-Z0-9]*", t))


class Entry(dict):
    """What the dictionary makes of a token, None if nothing."""

    def __missing__(self, t):
        m = re.fullmatch(r"""([(\[{"'«]*)(.*?)([,;:!?)\]}"']*)""", t, re.S)
        found = m and m[2] and next((m[1] + term + m[3] for term, most in registry.DICTIONARY if abs(len(term) - len(m[2])) <= most and levenshtein(m[2].lower(), term) <= most), None)
        self[t] = found or None
        return self[t]


entry = Entry()


def cyrillic(t):
    return re.sub("(?<=[Ѐ-ԯ])0(?=[Ѐ-ԯ])", "О", t.translate(TO_CYRILLIC))


def turned(t, line, document):
    if not t.strip():
        return t
    if entry[t] and entry[t] != t:
        return entry[t]
    a, b, x, y = counts(t)
    if protected(t):
        return t.translate(TO_LATIN) if re.search(r"[\d./\\_-]", t) and b and b == y else t
    own_latin, own_cyrillic = a - x, b - y
    mixed = a and b
    if mixed or (a >= 3 and not b and a == x) or (b >= 3 and not a and b == y):
        if own_cyrillic and not own_latin:
            return cyrillic(t)
        if own_latin and not own_cyrillic:
            return t.translate(TO_LATIN)
        if not own_latin and not own_cyrillic:
            for latin, russian in (line, document):
                if russian > 1.5 * latin:
                    return cyrillic(t)
                if latin > 1.5 * russian:
                    return t.translate(TO_LATIN)
    if mixed and own_cyrillic and not own_latin:
        return cyrillic(t)
    return t.translate(TO_LATIN) if mixed and own_latin and not own_cyrillic else t


def corrected(rows):
    """Rows as dicts, with norm_text, text and changed corrected."""
    line, document = {}, {}
    for r in rows:
        a, b, x, y = counts(r["norm_text"])
        for weights, key in ((line, (r["doc_id"], r["line_index"])), (document, r["doc_id"])):
            w = weights.setdefault(key, [0.0, 0.0])
            w[0] += a - x + 0.25 * x
            w[1] += b - y + 0.25 * y
    out = []
    for r in rows:
        t = r["norm_text"]
        new = turned(t, line[r["doc_id"], r["line_index"]], document[r["doc_id"]])
        if new != t:
            new = entry[new] or new
        out.append(r | {"norm_text": new, "text": new if new != t else r["text"], "changed": new != t})
    return out


COLUMNS = ["doc_id", "word_id", "word_index", "line_index", "text", "norm_text", "x", "y", "w", "h", "confidence"]


def key(r):
    return (r["doc_id"], r["line_index"], r["word_index"], r["word_id"])


@pytest.fixture(scope="module")
def first(spark, tiny):
    return [r.asDict() for r in registry.jittered(registry.words(spark, tiny), 1).select(*COLUMNS).collect()]


def test_corrected_words(spark, tiny, first):
    want = sorted(corrected(first), key=key)
    got = sorted((r.asDict() for r in registry.QUERIES["corrected_words"](spark, tiny).collect()), key=key)
    assert [{c: r[c] for c in (*COLUMNS, "changed")} for r in got] == [{c: r[c] for c in (*COLUMNS, "changed")} for r in want]
    assert sum(r["changed"] for r in want) > 20


def merged(rows):
    out, lines = [], {}
    for r in rows:
        lines.setdefault((r["doc_id"], r["line_index"]), []).append(r)
    script = lambda t: None if counts(t)[:2] == (0, 0) else "l" if counts(t)[0] > counts(t)[1] else "c" if counts(t)[1] > counts(t)[0] else "m"
    for line in lines.values():
        grown = []
        for r in sorted(line, key=lambda r: r["word_index"]):
            a = grown[-1] if grown else None
            if a and abs(r["x"] - (a["x"] + a["w"])) <= 0.12 * (a["h"] + r["h"]) / 2 and min(len(a["norm_text"]), len(r["norm_text"])) > 1 and all(re.fullmatch(r"[^\W_]+", w["norm_text"]) for w in (a, r)):
                scripts = {script(a["norm_text"]), script(r["norm_text"])} - {None}
                if len(scripts) < 2:
                    box = dict(zip("xywh", union([a[c] for c in "xywh"], [r[c] for c in "xywh"]), strict=True))
                    grown[-1] = a | box | {"text": a["text"] + r["text"], "norm_text": a["norm_text"] + r["norm_text"], "confidence": (a["confidence"] + r["confidence"]) / 2}
                    continue
            grown.append(dict(r))
        out += grown
    return out


def test_postprocessed_words(spark, tiny, first):
    """The chain: corrected, fragments merged, noise out, corrected again; synthetic words hold no noise but marks alone."""
    rows = merged([{c: r[c] for c in COLUMNS} for r in corrected(first)])
    textual = re.compile(r"[^\W_]|[#@._+-]")
    odd = [r for r in rows if not textual.search(r["norm_text"])]
    got = {(r.doc_id, r.word_id): r for r in registry.QUERIES["postprocessed_words"](spark, tiny).collect()}
    gone = {(r["doc_id"], r["word_id"]) for r in rows} - set(got)
    assert gone <= {(r["doc_id"], r["word_id"]) for r in odd}  # what the noise filter may drop at all
    want = corrected([r for r in rows if (r["doc_id"], r["word_id"]) not in gone])
    assert len(want) == len(got)
    for r in want:
        assert (got[r["doc_id"], r["word_id"]].norm_text, got[r["doc_id"], r["word_id"]].text) == (r["norm_text"], r["text"])


def test_postprocessed_analysis(spark, tiny):
    rows = [r.asDict() for r in repair.postprocessed(registry.words(spark, tiny), registry.DICTIONARY)[0].collect()]
    want = {}
    for r in rows:
        t = r["norm_text"]
        a, b, x, y = counts(t)
        plain = any(p.upper() in t.upper() for p in PROTECTED)
        w = want.setdefault(r["doc_id"], Counter())
        w["latin_chars"] += a
        w["cyrillic_chars"] += b
        w["digit_chars"] += sum(c.isdecimal() for c in t)
        w["latin_words"] += bool(a and not b)
        w["cyrillic_words"] += bool(b and not a)
        w["corrupted_words"] += bool(a and b and len(t) >= 4 and not plain)
        w["ambiguous_words"] += not plain and bool((a >= 3 and not b and a == x) or (b >= 3 and not a and b == y))
    for r in registry.QUERIES["postprocessed_analysis"](spark, tiny).collect():
        w = want[r.doc_id]
        assert {c: r[c] for c in w} == dict(w)
        assert r.dominance == ("none" if not w["latin_chars"] + w["cyrillic_chars"] else "cyrillic" if w["cyrillic_chars"] >= 1.6 * w["latin_chars"] else "latin" if w["latin_chars"] >= 1.6 * w["cyrillic_chars"] else "mixed")
