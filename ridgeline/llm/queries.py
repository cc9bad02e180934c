"""Registered queries of the training-data operators, and the SQL of those that SQL can express.

Each query reads its whole table and derives the contract's digest columns from
its operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ridgeline.llm import ann, bpe, centroids, decontaminate, fingerprint, jaccard, language_model, merkle, mixing, quality, sharding, token_counts, toxicity
from ridgeline.llm.common import learns, table

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
N_SHARDS = 8
TOKEN_LIMIT = 1024


def op1_bpe_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_shuffle_shards(spark, sf_dir):
    rows = sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    rows = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("toxicity")
    return rows.select("doc_id", (~learns("doc_id", 0)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir):
    """Score (0 to 1, higher: better) and decision of every document."""
    rows = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("quality").alias("score"), (F.col("quality") >= 0.5).alias("keep"))


def op7_language_model(spark, sf_dir):
    return language_model.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_decontaminate(spark, sf_dir):
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_merkle_manifest(spark, sf_dir):
    """Tampering deletes the line feeds of documents whose id has an even CRC (a null id: the empty text's, 0)."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    tampered = {"text": F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    rows = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("other_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_centroid_clusters(spark, sf_dir):
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_encode, op2_shuffle_shards, op3_jaccard_join, op4_fingerprints, op5_toxicity,
        op6_quality, op7_language_model, op8_nearest, op9_token_counts, op10_mix_sources,
        op11_decontaminate, op12_merkle_manifest, op13_centroid_clusters,
    )
}

def _lloyd_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    """Plain Lloyd rounds: every distance in every round."""
    v = "list_transform(embedding, lambda x: x::DOUBLE)"
    ctes = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(v, lambda x: floor(256 * x)::BIGINT) AS x FROM (SELECT vec_id, {v} AS v FROM embeddings)
          WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
          SELECT r, j, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v, c{t}) GROUP BY r)""")
        if t < rounds:
            ctes.append(f"""m{t} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
              SELECT j, i, sum(xi)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(x) AS xi, unnest(range(64)) AS i FROM a{t} JOIN v USING (r)) GROUP BY j, i) GROUP BY j)""")
            ctes.append(f"c{t + 1} AS (SELECT c{t}.j, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} ON m{t}.j = c{t}.j)")
    return f"""WITH {", ".join(ctes)}
      SELECT vec_id, a.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
             sha256(array_to_string(c, ',')) AS centroid_sha256
      FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""


ORACLE_SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r)
  JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN (SELECT a, min(doc_id) AS c FROM reach JOIN d ON d.r = b GROUP BY a) m ON m.a = d.r
""",
    "op10_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rn
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY 2 * source_size / weight, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM l),
r AS (
  SELECT doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM r
""",
    "op11_decontaminate": r"""
WITH w AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS z),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), a, z), p) AS words FROM benchmark, w),
k AS (
  SELECT DISTINCT item, least(len(words), 10) AS length, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, z), p) AS words FROM documents, w),
g AS (
  SELECT r, i, length, array_to_string(words[i:i + length - 1], ' ') AS gram
  FROM (SELECT r, words, length, unnest(range(1, len(words) - length + 2)) AS i FROM d, (SELECT DISTINCT length FROM k))),
h AS (SELECT r, i, g.length, item FROM g JOIN k ON g.gram = k.gram AND g.length = k.length),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + length)) AS at FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: unicode(x)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))) % 2 = 1 AS even,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(t) || ':' || t END) AS other
  FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS t FROM f)),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM l)),
leaves AS (
  SELECT doc_id, leaf, other, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
nodes(level, tree, place, digest, n) AS (
  SELECT 0, tree, place, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT level, tree, place, digest, count(*) OVER (PARTITION BY tree) FROM (
    SELECT level + 1 AS level, tree, place // 3 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM nodes WHERE n > 1 GROUP BY level, tree, place // 3)),
subroots AS (SELECT tree, digest AS subroot, level AS height FROM nodes WHERE n = 1),
top(level, place, digest, n) AS (
  SELECT 0, tree, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level, place, digest, count(*) OVER () FROM (
    SELECT level + 1 AS level, place // 3 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM top WHERE n > 1 GROUP BY level, place // 3)),
root AS (SELECT digest AS root FROM top WHERE n = 1),
up AS (
  SELECT row_number() OVER () AS r, leaves.*, subroot, height, (SELECT max(level) FROM top) AS rest FROM leaves JOIN subroots USING (tree)),
steps AS (SELECT r, unnest(range(0, height + rest)) AS step, tree, place, height FROM up),
spots AS (SELECT r, step, step < height AS inner_tree, tree, CASE WHEN step < height THEN place // (3 ** step)::BIGINT ELSE tree // (3 ** (step - height))::BIGINT END AS node, CASE WHEN step < height THEN step ELSE step - height END AS level FROM steps),
sides AS (
  SELECT a.r, a.step, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < a.node), '') AS lefts, coalesce(string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > a.node), '') AS rights
  FROM spots a JOIN (SELECT true AS inner_tree, level, tree, place, digest FROM nodes UNION ALL SELECT false, level, NULL, place, digest FROM top) x
    ON x.inner_tree = a.inner_tree AND x.level = a.level AND x.place // 3 = a.node // 3 AND (NOT a.inner_tree OR x.tree = a.tree)
  GROUP BY a.r, a.step),
proof AS (SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY r),
fold(r, step, digest) AS (
  SELECT r, 0, other FROM up
  UNION ALL
  SELECT f.r, f.step + 1, sha256(lefts || digest || rights) FROM fold f JOIN sides s ON s.r = f.r AND s.step = f.step)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.digest AS folded_root, fold.digest = root AS verified
FROM up JOIN fold ON fold.r = up.r AND fold.step = height + rest LEFT JOIN proof ON proof.r = up.r, root
""",
    "op13_centroid_clusters": _lloyd_sql(),
}
