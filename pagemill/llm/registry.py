"""The contract queries opN_* over whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from pagemill.llm.centroids import centroid_clusters
from pagemill.llm.common import crc_of_id, table
from pagemill.llm.exact_dedup import exact_dedup
from pagemill.llm.language_id import language_id
from pagemill.llm.lattice import near_vectors
from pagemill.llm.license_scan import license_scan
from pagemill.llm.lm_score import lm_score
from pagemill.llm.ngram_join import similar_texts
from pagemill.llm.packing import pack, token_pieces
from pagemill.llm.phrases import collocations
from pagemill.llm.pieces import encode_pieces
from pagemill.llm.secret_scan import secret_scan
from pagemill.llm.substring_dedup import remove_repeats
from pagemill.llm.toxicity import toxicity

QUERIES = {}
ORACLE_SQL = {}
#: One assignment of the vectors v to the centroids of c{i}, and the centroids that follow.
ROUND_SQL = """
    d{i} AS (SELECT v.vec_id, v.row_no, v.e, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i} c),
    a{i} AS (SELECT vec_id, e, c, d FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY d, c) AS near FROM d{i}) WHERE near = 1),
    s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY ALL),
    m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS e FROM s{i} GROUP BY c),
    c{next} AS (SELECT c, coalesce(m.e, b.e) AS e FROM c{i} b LEFT JOIN m{i} m USING (c))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def op1_best_fit_packing(spark, sf_dir):
    """All documents as 49k-vocabulary ids in as few sequences of 4096 tokens as can be."""
    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query()
def op2_secret_scan(spark, sf_dir):
    """Secrets in every whole text, with the weak parts that complementary parts confirm."""
    return secret_scan(table(spark, sf_dir, "documents"))


@query()
def op3_license_scan(spark, sf_dir):
    """License phrases and blocks that contain 0.8 of a template's words, in every whole text."""
    return license_scan(table(spark, sf_dir, "documents"))


@query("""
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
    n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x), c AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.y, vec_id)) AS kept
    FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
""")
def op4_embedding_near_dedup(spark, sf_dir):
    """Links at cosine 0.9 between all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op5_sentencepiece(spark, sf_dir):
    """Every whole text encoded with the 32k model and decoded again."""
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@query()
def op6_language_id(spark, sf_dir):
    """The language of every whole text, learned from documents whose crc32 of the id is not 2 modulo 4."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda: F.coalesce(crc_of_id("doc_id") % 4 == 2, F.lit(False))
    found = language_id(docs, learn=~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
         g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
    FROM t JOIN g ON t.text = g.text
""")
def op7_exact_dedup(spark, sf_dir):
    """Every document; of equal whole texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query()
def op8_lm_score(spark, sf_dir):
    """Every whole text scored by a trigram automaton learned from documents whose crc32 of the id is not 1 modulo 5."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda: F.coalesce(crc_of_id("doc_id") % 5 == 1, F.lit(False))
    return lm_score(docs, ~held_out()).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(r"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
    reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
    c AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
""".replace("\\\\", "\\"))
def op9_ngram_jaccard_join(spark, sf_dir):
    """Components of all documents under links of 0.9 between sets of three-word shingles."""
    return similar_texts(table(spark, sf_dir, "documents"))


@query()
def op10_suffix_array_dedup(spark, sf_dir):
    """All documents without the bytes that a string of 200 bytes covers which occurs again anywhere."""
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


@query(r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    g AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
        FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
    cuts AS (SELECT *, unnest(range(1, k)) AS j FROM c),
    parts AS (SELECT *, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 :], ' ') AS rest FROM cuts),
    scored AS (
        SELECT c.lang, c.k, c.phrase, c.f AS a, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score,
               row_number() OVER (PARTITION BY c.lang, c.phrase, c.k ORDER BY (1000000 * c.f * c.f) // (l.f * r.f), c.j) AS best
        FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first AND l.k = c.j JOIN f r ON r.lang = c.lang AND r.phrase = c.rest AND r.k = c.k - c.j),
    held AS (
        SELECT lang, part, max(f) AS most FROM (
            SELECT lang, f, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY ALL),
    kept AS (SELECT scored.* FROM scored LEFT JOIN held ON k = 2 AND held.lang = scored.lang AND part = phrase WHERE best = 1 AND (most IS NULL OR 100 * most < 50 * a)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang)
    SELECT lang, rank, phrase, k::INTEGER AS words, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_phrase_collocation(spark, sf_dir):
    """The 2000 strongest phrases of two and three words of each language, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


@query(
    """
    WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER () AS row_no FROM embeddings),
    v AS (
        SELECT vec_id, row_no, list_transform(x, lambda y: floor(64 * y)::BIGINT) AS e FROM t
        WHERE len(x) = 64 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS c, e FROM v QUALIFY c < 16),"""
    + ",".join(ROUND_SQL.format(i=i, next=i + 1) for i in range(4))
    + """
    SELECT vec_id, c AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(c3.e, ',')) AS centroid_sha256
    FROM a3 JOIN c3 USING (c)
"""
)
def op12_centroid_clustering(spark, sf_dir):
    """All embeddings of 64 components in 16 clusters."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


@query()
def op13_toxicity(spark, sf_dir):
    """The toxicity of every whole text, learned from labels of documents whose crc32 of the id is not 1 modulo 3."""
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(crc_of_id(c) % 3 == 1, F.lit(False))
    found = toxicity(docs, table(spark, sf_dir, "labels"), learn=lambda c: ~held_out(c))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
