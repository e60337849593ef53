"""The queries of this subpackage, each over its whole table, and SQL for those that DuckDB can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import graph, licenses, minhash, mixing, pieces, quality, sharding, substring, topk, toxicity

#: The SentencePiece model of op9 and of the pipeline's last stage, read on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query(
    "op7_substring_dedup",
    r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs)),
    firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
    cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (s) WHERE first < doc_id),
    placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM placed ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_read(spark, sf_dir, "documents"))


@_query(
    "op5_minhash_dedup",
    r"""
    WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM docs)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT x, b FROM reach JOIN sides ON y = a),
    least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, c = d.doc_id AS kept
    FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON x = d.doc_id
    """,
)
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), n=4)


@_query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_query(
    "op4_mix_sources",
    r"""
    WITH sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS sort_key
        FROM documents),
    sources AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source)),
    total AS (SELECT sum(n) AS t FROM sources),
    -- sources in the order in which their targets are reached; the first whose share holds for all later ones ends the capping
    filled AS (
        SELECT *, t - coalesce(sum(3 * n) OVER before, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
        FROM sources, total WINDOW before AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT left_ / weight AS l FROM filled WHERE left_ * w / weight <= 3 * n ORDER BY n / w, source NULLS LAST LIMIT 1),
    targets AS (
        SELECT source, CAST(n AS BIGINT) AS n, k, least(CAST((SELECT l FROM level) * w AS DOUBLE), CAST(3 * n AS DOUBLE)) AS target,
            greatest(1, (CAST(n AS BIGINT) + block - 1) // block) AS blocks
        FROM sources, (SELECT greatest(1, least(4096, CAST(t AS BIGINT) // 131072)) AS block FROM total)),
    -- slots of the schedule: points of the golden ratio, as multiples of 2**-31, through the cumulative weights
    shares AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target * blocks / n * 1048576 + 0.5) AS BIGINT) ELSE 0 END AS wanted FROM targets),
    widths AS (
        SELECT *, CAST(sum(wanted) OVER () AS BIGINT) AS all_wanted,
            CASE WHEN wanted > 0 THEN greatest(1, CAST(floor(CAST(wanted AS DOUBLE) / CAST(sum(wanted) OVER () AS DOUBLE) * 4294967296 + 0.5) AS BIGINT)) ELSE 0 END AS width
        FROM shares),
    bounds AS (SELECT *, CAST(sum(width) OVER (ORDER BY k) AS BIGINT) AS hi, CAST(sum(width) OVER () AS BIGINT) AS whole FROM widths),
    size_of AS (SELECT (max(all_wanted) + 524288) // 1048576 AS slots, max(whole) // 2 AS half FROM bounds),
    points AS (SELECT slot, ((slot % 2147483648 * 1327217885 % 2147483648) * half) >> 30 AS spot FROM (SELECT unnest(range(slots)) AS slot, half FROM size_of)),
    drawn AS (SELECT slot, k, blocks, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM points JOIN bounds ON hi - width <= spot AND spot < hi),
    uses AS (SELECT k, count(*) AS uses FROM drawn WHERE rank < 3 * blocks GROUP BY k),
    passes AS (  -- whole passes over a source, and words of the blocks of the last one
        SELECT source, n, target, coalesce(uses, 0) // blocks AS full_, coalesce(uses, 0) % blocks * (n // blocks) + least(coalesce(uses, 0) % blocks, n % blocks) AS rest
        FROM bounds LEFT JOIN uses USING (k)),
    laid AS (
        SELECT doc_id, size, n, target, full_, rest,
            coalesce(sum(size) OVER (PARTITION BY source ORDER BY sort_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM sized JOIN passes USING (source))
    SELECT doc_id, size, n AS source_size, target, CAST(full_ * size + greatest(0, least(start + size, rest) - start) AS BIGINT) AS taken
    FROM laid
    """,
)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op9_sentencepiece_nbest")
def op9_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"), pieces.load(PIECE_MODEL))


@_query(
    "op8_exact_topk",
    r"""
    WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
    scores AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scores)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 10
    """,
)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_nth(_read(spark, sf_dir, "embeddings"))


@_query(
    "op3_embedding_near_dedup",
    r"""
    WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
    reach AS (SELECT vec_id AS x, vec_id AS y FROM vectors UNION SELECT x, b FROM reach JOIN links ON y = a),
    least AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, c = vec_id AS kept, CAST(1 AS DOUBLE) AS audited_recall
    FROM vectors JOIN least ON x = vec_id LEFT JOIN counts ON a = vec_id
    """,
)
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_duplicates(_read(spark, sf_dir, "embeddings"))


@_query("op10_balanced_sharding")
def op10_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quote(name)}, {quote(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    term = quote(licenses.TERM)
    return rf"""
    WITH templates AS (SELECT * FROM (VALUES {templates}) AS t(template, license, text)),
    files AS (SELECT row_number() OVER () AS file, doc_id, coalesce(text, '') AS text, coalesce(source, '_') AS source, coalesce(source, '_') || '/' || coalesce(lang, '_') AS folder FROM documents),
    tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), {term})) AS term FROM templates) GROUP BY ALL),
    vocabulary AS (SELECT DISTINCT term FROM tt),
    df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT file, unnest(regexp_extract_all(lower(text), {term})) AS term FROM files) SEMI JOIN vocabulary USING (term) GROUP BY term),
    n AS (SELECT count(*) AS n FROM files),
    idf AS (SELECT term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM vocabulary LEFT JOIN df USING (term), n),
    weighted AS (SELECT template, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
    parts AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS part FROM weighted),
    units AS (
        SELECT file, 'line' AS kind, unnest(string_split(text, chr(10))) AS unit FROM files
        UNION ALL SELECT file, 'paragraph', unnest(regexp_split_to_array(text, '
[ 	
]*
')) FROM files
        UNION ALL SELECT file, 'whole', text FROM files),
    numbered AS (SELECT row_number() OVER () AS u, * FROM units),
    bags AS (SELECT u, file, kind, term, count(*) AS tf FROM (SELECT u, file, kind, unnest(regexp_extract_all(lower(unit), {term})) AS term FROM numbered) GROUP BY ALL),
    heavy AS (SELECT u, file, kind, term, tf * coalesce(idf, ln((n + 1.0) / 2.0) + 1.0) AS w FROM bags LEFT JOIN idf USING (term), n),
    size AS (SELECT u, sqrt(sum(w * w)) AS size FROM heavy GROUP BY u),
    dots AS (SELECT u, file, kind, template, license, sum(w * part) AS dot FROM heavy JOIN parts USING (term) GROUP BY ALL),
    best AS (SELECT u, file, kind, max(dot) AS dot, arg_min(license, (-round(dot, 9), license)) AS license FROM dots GROUP BY ALL),
    found AS (SELECT file, kind, license, least(dot / size, 1.0) AS cosine FROM best JOIN size USING (u) WHERE dot / size >= {licenses.THRESHOLD}),
    own AS (SELECT file, max(cosine) AS own_cosine, arg_min(license, (-round(cosine, 9), license)) AS own_license FROM found GROUP BY file),
    whole AS (SELECT file, max(cosine) AS cosine, arg_min(license, (-round(cosine, 9), license)) AS license FROM found WHERE kind = 'whole' GROUP BY file),
    stands AS (SELECT folder AS above, arg_min(license, (-round(cosine, 9), license)) AS license FROM whole JOIN files USING (file) GROUP BY folder),
    ways AS (SELECT DISTINCT folder, unnest([folder, source, '']) AS above, unnest([0, 1, 2]) AS far FROM files),
    near AS (SELECT folder, arg_min(above, far) AS above, arg_min(license, far) AS license FROM ways JOIN stands USING (above) GROUP BY folder)
    SELECT doc_id, own_license, round(own_cosine, 6) AS own_cosine, coalesce(own_license, near.license) AS license,
        CASE WHEN own_license IS NULL THEN near.above END AS inherited_from, whole.license IS NOT NULL AS license_file
    FROM files LEFT JOIN own USING (file) LEFT JOIN whole USING (file) LEFT JOIN near USING (folder)
    """


@_query("op1_license_scan", _license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_read(spark, sf_dir, "documents"))
