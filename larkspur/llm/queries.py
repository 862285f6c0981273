"""The corpus queries and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm import decontaminate, lexical, licenses, line_templates, merkle, mixing, ngram_join, piece_tokens, sharding, substrings, topk, toxicity, warc
from larkspur.llm.common import table


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), firsts AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > first), range(0, 50) AS t(k)
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


OP1_SQL = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t
), a AS (
  SELECT kind, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END AS a FROM w
), s AS (
  SELECT kind, id, len(a) AS n, unnest(a) AS s, unnest(range(len(a))) AS p FROM a
), items AS (
  SELECT id AS item_id, s, any_value(n) AS m, count(*) AS c FROM s WHERE kind = 1 GROUP BY ALL
), starts AS (
  SELECT DISTINCT s.id AS doc_id, item_id, m, n, greatest(least(p, n - m), 0) AS start FROM s JOIN items USING (s) WHERE kind = 0
), counted AS (
  SELECT doc_id, item_id, start, m, starts.n, s.s, count(*) AS c FROM starts JOIN s ON s.kind = 0 AND s.id = doc_id AND p >= start AND p < start + m GROUP BY ALL
), shared AS (
  SELECT doc_id, item_id, start, any_value(counted.m) AS m, any_value(n) AS n, sum(least(counted.c, items.c)) AS shared
  FROM counted JOIN items USING (item_id, s) GROUP BY ALL
)
SELECT doc_id, item_id, round(max(shared / (m + least(m, n) - shared)), 6) AS similarity
FROM shared GROUP BY ALL HAVING max(shared / (m + least(m, n) - shared)) >= 0.8
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(folder, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT b, r FROM reach JOIN links ON a = reach.doc_id
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.text_size("text").alias("size"), sharding.text_key("text", "doc_id").alias("key"), sharding.text_crc32("text").alias("text_crc32")
    )
    placed = sharding.shard(docs, shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _nibble_remainder(n: int) -> int:
    """The CRC-32 remainder of four bits."""
    for _ in range(4):
        n = n >> 1 ^ 0xEDB88320 * (n & 1)
    return n


_REMAINDERS = [_nibble_remainder(n) for n in range(16)]
# DuckDB has no CRC-32, so it is taken over the bytes of the text, four bits at a time
OP4_SQL = f"""
WITH s AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 9) || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 6) AS BIGINT) AS key
  FROM documents
), bytes AS (
  SELECT *, [CAST('0x' || b AS BIGINT) FOR b IN regexp_extract_all(hex(encode(text)), '..')] AS bytes FROM s
), crc AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten([[b & 15, b >> 4] FOR b IN bytes])),
    lambda c, half: xor(c >> 4, {_REMAINDERS}[(xor(c, half) & 15) + 1])) AS crc FROM bytes
), placed AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS DOUBLE) - size / 2 AS middle,
    CAST(sum(size) OVER () AS DOUBLE) AS total
  FROM crc
), shards AS (
  SELECT *, CAST(least(floor(middle * 24 / total), 23) AS INTEGER) AS shard FROM placed
)
SELECT doc_id, size, xor(crc, 4294967295::BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM shards
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_TEMPLATE_ROWS = ", ".join(
    f"('{t.replace(chr(39), chr(39) * 2)}', '{label}', {sorted(licenses.TELLING & set(licenses._words(t)))}, {sorted(licenses.FOREIGN.get(label, set()) - set(licenses._words(t)))}::VARCHAR[])"
    for t, label in licenses.TEMPLATES.items()
)
_PHRASE_ROWS = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
_SQL_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH w AS (
  SELECT doc_id, text, {_SQL_WORDS.format("text")} AS w FROM documents
), phrases AS (
  SELECT string_split(p, ' ') AS p, label FROM (VALUES {_PHRASE_ROWS}) AS t(p, label)
), places AS (
  SELECT doc_id, label, unnest([i - 1 FOR i IN range(1, len(w) + 1) IF w[i:i + len(p) - 1] = p]) AS place
  FROM w, phrases WHERE list_contains(w, p[1])
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), templates AS (
  SELECT list_distinct({_SQL_WORDS.format("t")}) AS t, label, told, strange FROM (VALUES {_TEMPLATE_ROWS}) AS x(t, label, told, strange)
), lines AS (
  SELECT doc_id, list_distinct({_SQL_WORDS.format("line")}) AS b FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
), met AS (
  SELECT doc_id, label, len(list_intersect(b, t)) AS n, len(t) AS of FROM lines, templates
  WHERE len(list_intersect(b, t)) >= ceil(0.8 * len(t) - 1e-9) AND list_has_all(b, told::VARCHAR[]) AND NOT list_has_any(b, strange)
), more AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(n / of) AS best FROM met GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""

#: Target weights of sources by name; the others weigh 1 each.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS, seed=17)


OP6_SQL = """
WITH s AS (
  SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes,
         CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 3.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents GROUP BY source
), r AS (
  SELECT source, CASE WHEN bytes = 0 THEN 1.0::DOUBLE ELSE
    round(weight / (SELECT sum(weight) FROM s) * (SELECT CAST(sum(bytes) AS DOUBLE) FROM s) / bytes, 9) END AS rate FROM s
), n AS (
  SELECT source, rate, greatest(1, ceil(rate / 32))::INT AS draws FROM r
), steps AS (
  SELECT source, draws, rate / draws AS mean, unnest(range(0, CAST(ceil(rate / draws + 12 * sqrt(rate / draws) + 24) AS BIGINT) + 1)) AS i FROM n
), pmf AS (
  SELECT source, draws, i, exp(-mean + i * CASE WHEN mean > 0 THEN ln(mean) ELSE 0 END - lgamma(i + 1)) AS p FROM steps
), cdf AS (
  SELECT source, draws, i, sum(p) OVER (PARTITION BY source ORDER BY i) AS c FROM pmf
), u AS (
  SELECT d.doc_id, d.text, d.source, j, CAST('0x' || substr(md5('17:' || d.doc_id || ':' || md5(coalesce(d.text, '')) || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN n ON d.source IS NOT DISTINCT FROM n.source, range(1, n.draws + 1) AS t(j)
), k AS (
  SELECT u.doc_id, u.text, u.source, u.j, count(*) FILTER (cdf.c <= u.u) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL
), c AS (
  SELECT doc_id, text, source, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL
)
SELECT doc_id, text, source, CAST(replica AS INTEGER) AS replica, md5('18:' || doc_id || ':' || replica) AS shuffle_key
FROM c, range(0, c.n) AS t(replica)
"""


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT doc_id, md5(text) AS h, line, string_split(trim(regexp_replace(body, '[ \t\r\x0b\f]+', ' ', 'g')), ' ') AS raw,
    string_split(trim(regexp_replace(regexp_replace(body, '[^ \t\r\x0b\f]*[0-9][^ \t\r\x0b\f]*', '<*>', 'g'), '[ \t\r\x0b\f]+', ' ', 'g')), ' ') AS t FROM lines
), leaves AS (
  SELECT *, [CAST(len(t) AS VARCHAR), t[1], t[2], t[3]] AS leaf FROM split WHERE t[1] <> ''
), frequent AS (
  SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT h) >= 8
), single AS (
  SELECT doc_id, h, line, leaf, len(raw) AS size, unnest(raw) AS token, unnest(range(len(raw))) AS p FROM leaves SEMI JOIN frequent USING (leaf)
), constant AS (
  SELECT leaf, p, token, NOT regexp_matches(token, '[0-9]') AND token <> '<*>' AS plain FROM single GROUP BY ALL HAVING count(DISTINCT h) >= 8
), both_ways AS (
  SELECT doc_id, h, line, leaf, size, count(*) FILTER (plain) AS n, list({'p': p, 'token': token} ORDER BY p) FILTER (plain) AS of_plain, list({'p': p, 'token': token} ORDER BY p) AS of_all
  FROM single JOIN constant USING (leaf, p, token) GROUP BY ALL HAVING 2 * count(*) >= size
), fixed AS (
  SELECT doc_id, h, line, leaf, CASE WHEN 2 * n >= size THEN of_plain ELSE of_all END AS template FROM both_ways
), again AS (
  SELECT leaf, template FROM fixed GROUP BY ALL HAVING count(DISTINCT h) >= 8
), dropped AS (
  SELECT DISTINCT doc_id, line FROM fixed SEMI JOIN again USING (leaf, template)
), kept AS (
  SELECT doc_id, string_agg(body, chr(10) ORDER BY line) AS kept FROM lines ANTI JOIN dropped USING (doc_id, line) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id
)
SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.v) = len(v.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), totals AS (
  SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), tf AS (
  SELECT doc_id, len(w)::BIGINT AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), totals
), impacts AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))) AS impact FROM tf JOIN weights USING (t), totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN impacts USING (t) GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op12_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    found = piece_tokens.decode(ids, model)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((decimal, "ids_sha256"), (F.col("decoded"), "decoded_sha256"))]
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    around = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    digest = merkle.record_digest(*around, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", digest.alias("digest"), F.when(tampered, merkle.record_digest(*around, lowered)).otherwise(digest).alias("seen"))
    return merkle.proofs(merkle.build(leaves, "source", ["doc_id"]), "seen", ["doc_id"])


# levels as recursions; DuckDB has no CRC-32, so it is taken over the digits of the id, four bits at a time
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, list_reduce(list_prepend(4294967295::BIGINT, flatten([[b & 15, b >> 4] FOR b IN [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..')]])),
    lambda c, half: xor(c >> 4, {_REMAINDERS}[(xor(c, half) & 15) + 1])) AS crc FROM documents
), fields AS (
  SELECT doc_id, source, crc, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM d
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::BIGINT) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
      ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
), own AS (
  SELECT 0 AS level, tree, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, tree, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM own WHERE n > 1 GROUP BY level, tree, i // 16
), subroots AS (
  SELECT tree, h AS subroot, level AS depth FROM own WHERE n = 1
), top AS (
  SELECT 0 AS level, tree AS i, count(*) OVER () AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 16
), root AS (
  SELECT h AS root FROM top WHERE n = 1
), runs AS (
  SELECT tree, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM own WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, i // 16, list(h ORDER BY i) FROM top WHERE n > 1 GROUP BY ALL
), folds AS (
  SELECT tree, i AS leaf_i, 0 AS step, CASE WHEN depth = 0 THEN -1 ELSE tree END AS home, 0 AS level, CASE WHEN depth = 0 THEN tree ELSE i END AS i, depth, seen AS h, '' AS proof
  FROM placed JOIN subroots USING (tree)
  UNION ALL
  SELECT f.tree, leaf_i, step + 1, CASE WHEN step + 1 = depth THEN -1 ELSE home END, CASE WHEN step + 1 = depth THEN 0 ELSE f.level + 1 END, CASE WHEN step + 1 = depth THEN f.tree ELSE f.i // 16 END, depth,
    sha256(array_to_string(hs[1:f.i % 16], '') || h || array_to_string(hs[f.i % 16 + 2:], '')), proof || array_to_string(hs[1:f.i % 16], '') || array_to_string(hs[f.i % 16 + 2:], '')
  FROM folds AS f JOIN runs ON runs.tree = f.home AND runs.level = f.level AND runs.run = f.i // 16
), ends AS (
  SELECT tree, leaf_i, arg_max(h, step) AS folded_root, sha256(arg_max(proof, step)) AS proof_sha256 FROM folds GROUP BY ALL
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN ends ON ends.tree = placed.tree AND ends.leaf_i = placed.i, root
"""


QUERIES = {"op1_decontamination": op1_decontamination, "op2_warc": op2_warc, "op3_ngram_join": op3_ngram_join, "op4_sharding": op4_sharding, "op5_licenses": op5_licenses, "op6_mixing": op6_mixing, "op7_line_templates": op7_line_templates, "op8_exact_topk": op8_exact_topk, "op9_substrings": op9_substrings, "op10_toxicity": op10_toxicity, "op11_lexical": op11_lexical, "op12_piece_tokens": op12_piece_tokens, "op13_merkle": op13_merkle}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_warc": OP2_SQL, "op3_ngram_join": OP3_SQL, "op4_sharding": OP4_SQL, "op5_licenses": OP5_SQL, "op6_mixing": OP6_SQL, "op7_line_templates": OP7_SQL, "op8_exact_topk": OP8_SQL, "op9_substrings": OP9_SQL, "op11_lexical": OP11_SQL, "op13_merkle": OP13_SQL}
