"""Phrase collocation mining by hierarchical pair naming.

A frequent word of a language has an id. A phrase of k words is an adjacent pair of frequent phrases of k - 1 words that
overlap in all but their ends: where both stand side by side, the pair is counted over the whole collection and, if
it is frequent itself, gets an id that replaces it in the next round. A name's key tells its parts, the id of its
first k - 1 words and that of its last word, so the table of names is a table of parent pointers as well: the counts
of a cut's two parts, and the longer phrases that a phrase lies in, are joins of names with names and never read texts.

Names are exact: keys are pairs of ids in 64 bits, sent through a bijection, and words are joined as strings.

Scale. Documents are dealt into blocks of bounded size. Words meet once per block and not once per occurrence; pairs travel
through ``exchange``, where a block sends its distinct pairs, packed, and is answered with their ids. A phrase below
the least count never leaves the round that counts it, as none of its extensions can be frequent. What is joined and ranked
are frequent phrases alone; ranks are found in two steps, so a language that holds all of them doesn't fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import ASCII_LOWER, dropped, mix64, rekeyed, stored
from pagemill.llm.exchange import Counted, Node, finished, in_blocks, texts_of, totals

#: Bytes of a block's texts.
BLOCK = 2 << 20
#: Bits of a word's id and of a phrase's; both together are a key.
WORD_BITS, PHRASE_BITS = 30, 34
#: Parts of the words that are numbered one by one, and of the phrases that are ranked before a language's last ranking.
WORD_PARTS, RANK_PARTS = 1 << 12, 64
#: How texts part: A-Z in lower case, these bytes end a piece, tabs are blanks.
ENDS = b".,;:!?\n\x0b\x0c\r"
BYTES = bytes(10 if b in ENDS else 32 if b == 9 else ASCII_LOWER[b] for b in range(256))
NONE = np.int64(-1)


def block_tokens(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in their order; a line feed stands where a piece ends."""
    joined = b"\n".join(texts).translate(BYTES).replace(b"\n", b" \n ")
    return list(filter(None, joined.split(b" ")))


def numbered_tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words in order of appearance, and of each token the place of its word there, -1 for a piece's end."""
    place: dict[bytes, int] = {b"\n": -1}
    at = np.array([place.setdefault(t, len(place) - 1) for t in block_tokens(texts)], np.int64)
    return list(place)[1:], at


def pair_keys(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of pairs of ids, spread over 64 bits by a bijection."""
    return mix64((prefix.astype(np.uint64) << np.uint64(WORD_BITS)) | last.astype(np.uint64))


def unmixed(keys: np.ndarray) -> np.ndarray:
    """What ``mix64`` made ``keys`` of."""
    x = keys.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x ^= x >> np.uint64(33)
    x *= np.uint64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    x ^= x >> np.uint64(33)
    return x


def _side_by_side(words: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a name of k - 1 words stands before another that begins one word on: the places, and their keys.

    names[i]: the id of the k - 1 words from i on, -1 if they are none or not frequent.
    """
    at = np.flatnonzero((names[:-1] >= 0) & (names[1:] >= 0)) if len(names) > 1 else np.zeros(0, np.int64)
    return at, pair_keys(names[at], words[at + k - 1])


def _packed(ids: np.ndarray) -> bytes:
    """Ids, -1 and up to 40 bits, by planes of bytes, compressed; their number comes first."""
    planes = (ids + 1).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T
    return len(ids).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 5 * n, asbytes=True), np.uint8).reshape(5, n)
    ids = np.zeros((n, 8), np.uint8)
    ids[:, :5] = planes.T
    return ids.view("<i8")[:, 0] - 1


def _names(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's word ids and names, from all its rows end to end; where there are no names, words are their own."""
    words = np.concatenate([_unpacked(x) for x in table.column("_words").to_pylist()])
    names = [_unpacked(x) for x in table.column("_names").to_pylist() if x is not None]
    return words, np.concatenate(names) if names else words


def _row(block: int, words: list[np.ndarray], names: np.ndarray | None = None) -> pa.Table:
    """A block's row; what arrow has set aside for the block goes back."""
    pa.default_memory_pool().release_unused()
    told = None if names is None else _packed(names)
    return pa.table({"_block": pa.array([block], pa.int64()), "_words": pa.array([_packed(np.concatenate(words))], pa.binary()), "_names": pa.array([told], pa.binary())})


def _counter(k: int):
    def count(table: pa.Table) -> Counted:
        keys, counts = np.unique(_side_by_side(*_names(table), k)[1], return_counts=True)
        return [(keys, counts)]

    return count


def _namer(least: int):
    """A range's answer: 1 + the id of each frequent key, 0 for the others; and as block -1 the keys and counts of the frequent ones.

    Ids are the rank among the range's frequent keys times the number of ranges, plus the range, so they are dense.
    """

    def answer(node: Node, ranges: int) -> pa.Table:
        _, keys, sums, _ = node.kind[0]
        often = np.flatnonzero(sums >= least)
        ids = np.zeros(len(keys), np.int64)
        ids[often] = 1 + node.at + ranges * np.arange(len(often))
        if len(often) and ids[often[-1]] >> PHRASE_BITS:
            raise OverflowError(f"more than 2^{PHRASE_BITS} phrases of one length are frequent: raise the least count")
        told = node.answers({0: ids}, last=False)
        made = pa.table({"_block": [-1], "_range": [node.at], "_kind": [0], "_totals": [keys[often].tobytes() + sums[often].tobytes()], "_sum": [ranges], "_distinct": [len(often)]}, told.schema)
        return pa.concat_tables([told, made])

    return answer


def _table_of_names(answers: DataFrame) -> DataFrame:
    """(_id, _prefix, _last, _n) of every frequent pair of ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, ranges, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, counts = unmixed(np.frombuffer(data, np.uint64, n)), np.frombuffer(data, np.int64, n, 8 * n)
                ids = at + ranges * np.arange(n, dtype=np.int64)
                last = (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
                yield pa.record_batch([ids, (keys >> np.uint64(WORD_BITS)).astype(np.int64), last, counts], names=["_id", "_prefix", "_last", "_n"])

    rows = answers.where("_block < 0 AND _distinct > 0").select("_range", "_totals", "_sum", "_distinct")
    return rows.mapInArrow(decoded, "_id long, _prefix long, _last long, _n long")


def _by_language(table: pa.Table) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, distinct words, tokens as places among them) of a block, always in the same order, however its rows come."""
    langs, texts = table.column("_lang").to_pylist(), texts_of(table)
    for lang in sorted(set(langs)):
        yield lang, *numbered_tokens(sorted(t for t, x in zip(texts, langs, strict=True) if x == lang))


def _words(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of blocks: (_block, _place, _id) of frequent words, the vocabulary (_id, _lang, _word, _n), and (_lang, _total).

    _place: which of the block's distinct words it is, those of its languages end to end.
    """

    def count(table: pa.Table) -> pa.Table:
        block, out, first = table.column("_block")[0].as_py(), [], 0
        for lang, words, at in _by_language(table):
            n, places = np.bincount(at[at >= 0], minlength=len(words)), np.arange(first, first + len(words), dtype=np.int32)
            first += len(words)
            out.append(pa.table({"_block": np.full(len(words), block), "_place": places, "_lang": pa.array([lang] * len(words), pa.string()), "_word": pa.array(words, pa.binary()), "_n": n}))
        return pa.concat_tables(out)

    found = stored(rows.groupBy("_block").applyInArrow(count, "_block long, _place int, _lang string, _word binary, _n long"), "block-words")
    all_words = stored(found.groupBy("_lang", "_word").agg(F.sum("_n").alias("_n")), "words")
    part = Window.partitionBy("_part").orderBy("_lang", "_word")
    often = all_words.where(F.col("_n") >= least).withColumn("_part", F.pmod(F.xxhash64("_lang", "_word"), F.lit(WORD_PARTS)))
    often = often.withColumn("_id", (F.row_number().over(part) - 1).cast("long") * WORD_PARTS + F.col("_part"))
    told = F.when(F.col("_id") < 1 << WORD_BITS, F.col("_id")).otherwise(F.raise_error(F.lit(f"more than 2^{WORD_BITS} words are frequent: raise the least count")).cast("long"))
    vocabulary = stored(often.select(told.alias("_id"), "_lang", "_word", "_n"), "vocabulary")
    back = found.select("_block", "_place", "_lang", "_word").join(vocabulary.select("_lang", "_word", "_id"), ["_lang", "_word"])
    return back.select("_block", "_place", F.col("_id").cast("int").alias("_id")), vocabulary, all_words.groupBy("_lang").agg(F.sum("_n").alias("_total"))


def _with_word_ids(rows: DataFrame, back: DataFrame) -> DataFrame:
    """(_block, _words, _names): tokens as ids, -1 for rare words and ends of pieces, one of which ends each language; _names null."""

    def name(table: pa.Table, given: pa.Table) -> pa.Table:
        words, first = [], 0
        places, ids = given.column("_place").to_numpy(), given.column("_id").to_numpy()
        known = np.full(int(places.max(initial=-1)) + 1, -1, np.int64)
        known[places] = ids
        for _, distinct, at in _by_language(table):
            here = np.full(len(distinct) + 1, -1, np.int64)  # the last one is the end of a piece
            some = known[first : first + len(distinct)]
            here[: len(some)] = some
            first += len(distinct)
            words.append(here[np.append(at, -1)])
        return _row(table.column("_block")[0].as_py(), words)

    return rows.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(name, "_block long, _words binary, _names binary")


def phrase_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(vocabulary, names of 2 to ``longest`` words, words of each language), all stored.

    vocabulary: (_id, _lang, _word binary, _n). names[k - 2]: (_id, _prefix, _last, _n), where _prefix is an id of the names
    of k - 1 words, of the vocabulary for k = 2, and _last one of the vocabulary.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang")
    rows, blocks = in_blocks(docs, id_col, text_col, lang, block_bytes=BLOCK)
    rows = stored(rows.select("_block", "_text", "_lang"), "blocks")
    back, vocabulary, languages = _words(rows, least)
    at = stored(_with_word_ids(rows, back), "named-blocks")
    dropped(rows)
    found = []
    for k in range(2, longest + 1):
        answers = totals(at, blocks, _counter(k), answer=_namer(least))
        found.append(stored(_table_of_names(answers), f"names-{k}"))
        if k < longest:

            def renamed(table: pa.Table, given: list[np.ndarray], k: int = k) -> pa.Table:
                words, names = _names(table)
                places, keys = _side_by_side(words, names, k)
                ids = np.full(len(words), NONE)
                if len(places):
                    _, which = np.unique(keys, return_inverse=True)
                    ids[places] = given[0][which] - 1
                return _row(table.column("_block")[0].as_py(), [words], ids)

            before, at = at, stored(finished(at, answers, 1, renamed, "_block long, _words binary, _names binary"), "named-blocks")
            dropped(before)
    return vocabulary, found, languages


#: floor(1000000 a a / (l r)) of a cut c of a phrase that occurs _n times, exact up to counts of 10^16.
CUT_SCORE = "(cast(1000000 AS decimal(7, 0)) * (cast(_n AS decimal(16, 0)) * cast(_n AS decimal(16, 0)))) div (cast(c._begins AS decimal(16, 0)) * cast(c._ends AS decimal(16, 0)))"


def _with_cuts(vocabulary: DataFrame, names: list[DataFrame]) -> list[DataFrame]:
    """Per length the phrases (_id, _lang, _phrase binary, _n, _left, _right, _begins, _ends), stored.

    _left and _right: ids of the phrase without its last and without its first word. _begins and _ends: for each cut, shortest
    first part first, the counts of both parts.
    """
    word = vocabulary.select(F.col("_id").alias("_w"), F.col("_word").alias("_last_word"), F.col("_n").alias("_last_n"), "_lang")
    shorter = vocabulary.select(F.col("_id").alias("_p"), F.col("_word").alias("_start"), F.array("_n").alias("_begins"))
    out: list[DataFrame] = []
    for k, found in enumerate(names, 2):
        met = found.select("_id", F.col("_prefix").alias("_p"), F.col("_last").alias("_w"), "_n")
        met = _joined(_joined(met, word, "_w"), shorter, "_p")
        if k == 2:
            met = met.withColumns({"_right": F.col("_w"), "_ends": F.array("_last_n")})
        else:  # the last k - 1 words are the name of the prefix without its first word, and the last word
            inner = out[-1].select(F.col("_id").alias("_p"), F.col("_right").alias("_inner"))
            known = out[-1].select(F.col("_left").alias("_inner"), F.col("_tail").alias("_w"), F.col("_id").alias("_right"), F.concat(F.array("_n"), "_ends").alias("_ends"))
            met = _joined(met, inner, "_p").join(known, ["_inner", "_w"])
        phrase = F.concat("_start", F.encode(F.lit(" "), "utf-8"), "_last_word")
        met = met.select("_id", "_lang", phrase.alias("_phrase"), "_n", F.col("_p").alias("_left"), "_right", F.col("_w").alias("_tail"), "_begins", "_ends")
        out.append(stored(met, f"phrases-{k}"))
        shorter = out[-1].select(F.col("_id").alias("_p"), F.col("_phrase").alias("_start"), F.concat("_begins", F.array("_n")).alias("_begins"))
    return out


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join on an id, rewritten so that both sides are exchanged and a frequent one can be split."""
    return left.withColumn(key, rekeyed(key)).join(right.withColumn(key, rekeyed(key)), key).withColumn(key, rekeyed(key))


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, top: int = 2000, contained: int = 50) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: (lang, rank, phrase, words, a, l, r, n, score).

    Words are what white space and the ends of pieces (``. , ; : ! ?`` and line breaks) part, with A-Z in lower case. a:
    the phrase's occurrences, ``least`` at least, overlapping ones too; l and r: those of the two parts of the cut that scores
    lowest, ties to the shortest first part; score: floor(1000000 a a / (l r)); n: all words of the language. A phrase
    goes if a longer candidate holds it and occurs ``contained`` percent as often or more. Order: score, a, both descending,
    then the phrase in the order of its UTF-8 bytes.

    A null language is ``und``. Null and empty texts have no words; an empty table gives an empty result. Repeated rows count
    as often as they come. Ids are only dealt by, null or repeated ones do no harm; other columns are not read.
    """
    vocabulary, names, languages = phrase_names(docs, id_col, text_col, lang_col, longest, least)
    phrases = _with_cuts(vocabulary, names)
    best = None
    for k, found in enumerate(phrases, 2):
        # The lowest score, then the shortest first part.
        cut = F.array_min(F.expr(f"transform(arrays_zip(_begins, _ends), (c, k) -> struct({CUT_SCORE} AS score, k, c._begins AS l, c._ends AS r))"))
        if k < longest:  # no phrase occurs more often than what it holds, so those one word longer decide
            longer = phrases[k - 1].select(F.explode(F.array("_left", "_right")).alias("_in"), "_n").groupBy("_in").agg(F.max("_n").alias("_most"))
            found = found.join(longer, F.col("_id") == F.col("_in"), "left").where(F.col("_most").isNull() | (100 * F.col("_most") < contained * F.col("_n")))
        rows = found.withColumn("_cut", cut).select("_lang", "_phrase", F.lit(k).alias("words"), F.col("_n").alias("a"), "_cut.l", "_cut.r", "_cut.score")
        best = rows if best is None else best.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("_phrase")]
    part = F.pmod(F.xxhash64("_phrase"), F.lit(RANK_PARTS)).alias("_part")
    first = best.select("*", part).withColumn("_rank", F.row_number().over(Window.partitionBy("_lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("_lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    met = ranked.join(languages, "_lang")
    return met.select(F.col("_lang").alias("lang"), "rank", F.decode("_phrase", "utf-8").alias("phrase"), "words", "a", "l", "r", F.col("_total").alias("n"), "score")

