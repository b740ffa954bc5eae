"""The registered queries of this subpackage and, where SQL can say them, independent SQL texts for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillspark.llm import chat, codes, decontaminate, jaccard, language, mixing, neighbours, periodic, quality, sharding, simhash, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op5_benchmark_decontamination",
    r"""
WITH lowered AS (
  SELECT doc_id AS id, 'd' AS kind,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 'b',
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), sizes AS (
  SELECT DISTINCT least(10, len(w)) AS n FROM lowered WHERE kind = 'b' AND len(w) > 0
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM lowered WHERE kind = 'b' AND len(w) > 0)
), doc_windows AS (
  SELECT id AS doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, sizes WHERE kind = 'd' AND len(w) >= n)
), hits AS (
  SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.k = b.k
), hit_words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT l.id AS doc_id, CAST(coalesce(len(l.w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit_words h ON h.doc_id = l.id LEFT JOIN hit_items i ON i.doc_id = l.id
WHERE l.kind = 'd'
""",
)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.verbatim_matches(docs, table(spark, sf_dir, "benchmark")))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


@query(
    "op9_mixing_sources",
    r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0') AS k
  FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sized GROUP BY source
), rounds AS (
  SELECT a.source, a.source_size, a.w,
         (1.5 * (SELECT sum(source_size) FROM sources)
          - coalesce(sum(2 * b.source_size) FILTER (WHERE b.source_size / b.w < a.source_size / a.w), 0))
         / sum(b.w) FILTER (WHERE b.source_size / b.w >= a.source_size / a.w) AS level,
         coalesce(max(2 * b.source_size / b.w) FILTER (WHERE b.source_size / b.w < a.source_size / a.w), 0) AS full_from
  FROM sources a CROSS JOIN sources b GROUP BY ALL
), targets AS (
  SELECT source, source_size,
         least(CAST(2 * source_size AS DOUBLE),
               w * CAST((SELECT min(level) FROM rounds WHERE w * level <= 2 * source_size AND level >= full_from)
                        AS DOUBLE)) AS target
  FROM rounds
), placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed
""",
)
def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


@query(
    "op1_ngram_jaccard_join",
    r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM lowered WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
       JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM lowered
  UNION
  SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node
)
SELECT l.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM lowered l LEFT JOIN sizes s ON s.doc_id = l.doc_id
     JOIN (SELECT root, min(node) AS component_id FROM reach GROUP BY root) c ON c.root = l.doc_id
""",
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.linked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query(
    "op10_substring_dedup",
    r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM hits
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split
), kept AS (
  SELECT a.doc_id, count(*) AS n, string_agg(a.word, ' ' ORDER BY a.p) AS words
  FROM placed a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY a.doc_id
)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(len(s.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.words, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
""",
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


@query("op3_nearest_neighbours")
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=4.0)


@query(
    "op4_chat_formatting",
    r"""
WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), prefixes AS (
  SELECT conv_id, place,
         string_agg(coalesce(length(role) || 'r' || role, '-') || ':' || coalesce(length(text) || 't' || text, '-'), '|')
           OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS said
  FROM turns
), whole AS (
  SELECT conv_id, max(place) AS n_turns, arg_max(md5(said), place) AS said FROM prefixes GROUP BY conv_id
), firsts AS (
  SELECT min(conv_id) AS conv_id, n_turns, said, count(*) AS n_copies FROM whole GROUP BY n_turns, said
), kept AS (
  SELECT * FROM firsts f WHERE NOT EXISTS (
    SELECT 1 FROM prefixes p JOIN whole w USING (conv_id) WHERE p.place < w.n_turns AND p.place = f.n_turns AND md5(p.said) = f.said)
)
SELECT k.conv_id, CAST(any_value(k.n_turns) AS INTEGER) AS n_turns, CAST(any_value(k.n_copies) AS BIGINT) AS n_copies,
       string_agg('<|im_start|>' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10), ''
                  ORDER BY t.place) AS text
FROM kept k JOIN turns t ON t.conv_id = k.conv_id GROUP BY k.conv_id
""",
)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.rated(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels"))))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.planted(table(spark, sf_dir, "documents"))
    return periodic.digest(periodic.periodic_runs(docs, least=24, times=3))


@query("op13_simhash_near_dedup")
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, size=3)
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def _lloyd_sql(rounds: int) -> str:
    """Plain Lloyd rounds, every entry looked at each time, one statement a round."""
    near = """near_{r} AS MATERIALIZED (
  SELECT vec_id, p, x, m // 16 AS d, m % 16 AS k
  FROM (SELECT a.vec_id, a.p, any_value(a.x) AS x,
               min(16 * list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.c[i]) * (a.x[i] - b.c[i]))) + b.k) AS m
        FROM parts a JOIN book_{r} b ON a.p = b.p GROUP BY a.vec_id, a.p)
)"""
    book = """book_{n} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(u.c, b.c) AS c
  FROM book_{r} b LEFT JOIN (
    SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
    FROM (SELECT p, k, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS i FROM near_{r}) GROUP BY p, k, i)
    GROUP BY p, k) u ON u.p = b.p AND u.k = b.k
)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [book.format(n=r + 1, r=r), near.format(r=r + 1)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS place,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, place, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS x
  FROM (SELECT vec_id, place, v, unnest(range(8)) AS p FROM kept)
), book_0 AS MATERIALIZED (SELECT p, place - 1 AS k, x AS c FROM parts WHERE place <= 16),
{", ".join(steps)}, coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near_{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i))
        FROM (SELECT p, k, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS i FROM book_{rounds})) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query("op12_vector_codes", _lloyd_sql(6))
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(*codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096, group="label"))
