"""The registered queries of this package, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import byte_bpe, collocations, exact_dedup, fixity, id_files, main_text, minhash, mixing, ngram_join, prefix_trie, token_lengths, topk_search, toxicity
from tallyline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, table: str, apply: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: apply(read_table(spark, sf_dir, table))
    if sql:
        SQL[name] = sql.strip()


QUERIES["op1_toxicity"] = lambda spark, sf_dir: toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
_register("op2_token_counts", "documents", lambda docs: token_lengths.limits(token_lengths.histogram(token_lengths.lengths(docs))))
_register("op3_byte_bpe", "documents", byte_bpe.encoded_digests)

_register("op4_fixity", "pages", fixity.audit_pages, r"""
WITH r AS (SELECT page_id, octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10))) AS n_bytes, coalesce(length(html), 0) > 0 AND html[1] <> '#' AS hit FROM pages),
l AS (SELECT page_id, page_id >> 10 AS file, sum(n_bytes)::BIGINT AS n_bytes, bool_or(hit) AS hit FROM r GROUP BY page_id),
o AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS file_offset FROM l)
SELECT page_id AS record_id, file, file_offset, n_bytes, CASE WHEN page_id % 509 = 7 THEN 'missing' WHEN page_id % 997 = 11 THEN 'extra' ELSE 'altered' END AS problem
FROM o WHERE page_id % 509 = 7 OR page_id % 997 = 11 OR page_id % 211 = 5 AND hit
""")

_register("op5_fingerprints", "documents", minhash.fingerprints)
_register("op6_id_files", "documents", lambda docs: id_files.read_documents(id_files.write_images(docs)))

_register("op7_exact_dedup", "documents", exact_dedup.groups, r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (SELECT doc_id, n, content, row_number() OVER same AS place, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY content) AS group_size
      FROM t WINDOW same AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM g
""")

_register("op8_main_text", "pages", main_text.extracted)

_register("op9_mixing", "documents", mixing.mix, r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(text) AS n FROM documents),
k AS (SELECT doc_id, source, size::BIGINT AS size,
        -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0::DOUBLE)
        / CASE WHEN size > 0 THEN greatest(0.25::DOUBLE, 1.0::DOUBLE - abs(n::DOUBLE / size::DOUBLE - 6.0::DOUBLE) / 12.0::DOUBLE) ELSE 0.25::DOUBLE END AS key FROM s),
w AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight FROM k GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap FROM w),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest, row_number() OVER up AS place
      FROM c WINDOW up AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
share AS (SELECT arg_min(rest, place) AS share FROM r WHERE rest * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN share IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, share * weight) END AS target FROM r LEFT JOIN share ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, size, source_size, target, epochs, floor(target - epochs * source_size)::BIGINT AS lim,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, lim - earlier)))::BIGINT AS taken FROM p
""")

_register("op10_ngram_join", "documents", ngram_join.joined)

_register("op11_topk_search", "embeddings", topk_search.every_twentieth, r"""
WITH v AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")

_register("op12_collocations", "documents", collocations.collocations, r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 10),
d AS (SELECT lang, size, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS cut FROM c)),
k AS (SELECT d.*, h.a AS l, t.a AS r, ((1000000::HUGEINT * d.a * d.a) // (h.a::HUGEINT * t.a))::BIGINT AS score
      FROM d JOIN f h ON h.lang = d.lang AND h.phrase = d.head JOIN f t ON t.lang = d.lang AND t.phrase = d.tail),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n.n, score
FROM b JOIN n ON b.lang = n.lang LEFT JOIN x ON b.size = 2 AND x.lang = b.lang AND x.phrase = b.phrase
WHERE x.longer IS NULL OR 100 * x.longer < 50 * b.a QUALIFY rank <= 2000
""")

_register("op13_prefix_trie", "conversations", prefix_trie.rebuilt_trie, r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, left(sha256(length(role)::VARCHAR || ':' || role || text), 32)) AS own FROM t GROUP BY conv_id),
b AS (SELECT conv_id, own, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS bits FROM u),
h AS (SELECT conv_id, own, xor(list_reduce(bits, lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1)), 4294967295::BIGINT), 4294967295) % 6 AS h FROM b),
r AS (SELECT h.conv_id, list_concat(coalesce(f.own[1:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN h f ON f.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, depth, seq[1:depth] AS prefix, len(seq) = depth AS ended FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r)),
g AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY prefix, depth),
k AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
c AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN g.depth = 0 THEN 0 ELSE (n_convs - 1) * length(g.prefix[g.depth].text) END AS own FROM g LEFT JOIN k ON g.prefix = k.prefix AND g.depth = k.depth),
s AS (SELECT a.prefix, a.depth, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.own)::BIGINT AS saved_tokens FROM c a JOIN c x ON x.depth >= a.depth AND x.prefix[1:a.depth] = a.prefix GROUP BY a.prefix, a.depth)
SELECT c.conv_id, c.depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM c JOIN s ON c.prefix = s.prefix AND c.depth = s.depth LEFT JOIN g up ON c.depth > 0 AND up.depth = c.depth - 1 AND up.prefix = c.prefix[1:c.depth - 1]
""")
