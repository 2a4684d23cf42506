"""Word-level tokenisation with bounded memos: white space parts what the tokenizer sees, so words encode alone."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts that normalisation only lowers: ASCII white space and printable characters up to U+00FF.
PLAIN = re.compile("[\t-\r -~\xa1-\xff]*")
#: How the tokenizer parts such texts, once lowered: contractions, letters, single digits, other characters.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\t-\r ]+")
#: The start of a special token's name, and what Python takes for white space and the tokenizer doesn't.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
MEMO = 500_000
SLICE = 512


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@cache
def word_tokens(path: str) -> Callable[[pa.Array], list[bytes]]:
    """A function from an Arrow array of texts to little-endian 32-bit ids, as Tokenizer.encode(add_special_tokens=False) gives them.

    For the public word-level BPE: it lowers, drops white space, parts words by PARTS' rules and merges inside parts.
    Plain texts are parted here and only their parts go to the BPE model; other texts go through the tokenizer word by
    word, or as a whole if they hold special-token names or rare separators. Both memos are emptied when they reach
    MEMO entries, so memory stays bounded whatever the vocabulary.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    merge, letters = tokenizer.model.tokenize, byte_letters()

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    class Parts(dict):
        def __missing__(self, p: str) -> bytes:
            written = p if p.isascii() else "".join([letters[b] for b in p.encode()])
            found = self[p] = np.array([t.id for t in merge(written)], "<u4").tobytes()
            return found

    class Words(dict):
        def __missing__(self, w: str) -> bytes:
            found = self[w] = plain(w) if PLAIN.fullmatch(w) else whole(w)
            return found

    words, parts = Words(), Parts()

    def plain(text: str) -> bytes:
        return b"".join(map(parts.__getitem__, PARTS.findall(text.lower())))

    def encoded(text: str) -> bytes:
        for memo in (words, parts):
            if len(memo) > MEMO:
                memo.clear()
        if any(odd in text for odd in ODD):
            return whole(text)
        return plain(text) if PLAIN.fullmatch(text) else b"".join(map(words.__getitem__, text.split()))

    def encode(texts: pa.Array) -> list[bytes]:
        return [encoded(x) for at in range(0, len(texts), SLICE) for x in texts.slice(at, SLICE).to_pylist()]

    return encode
