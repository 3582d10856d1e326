"""One query for each operator, over whole tables, and SQL where it can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import (
    bpe, covertree, exact_dedup, langid, licenses, mixing, resampling, secret_scan, sharding, simhash, spelling, toxicity, wordpiece,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str, pieces: str | None = None) -> DataFrame:
    return wordpiece.token_counts(
        table(spark, folder, "documents"), wordpiece.read_pieces(pieces or vocabulary("piece_bpe_32k.model"))
    )


@query("op2_mix_sources")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).taken()


@query(
    "op3_exact_top_k",
    """WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT q.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, d.vec_id,
      CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
    WINDOW best AS (PARTITION BY q.vec_id
      ORDER BY list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) DESC, d.vec_id)
    QUALIFY row_number() OVER best <= 5""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op4_license_scan", licenses.oracle())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query(
    "op5_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, digest AS text_sha256
    FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents)
    WINDOW g AS (PARTITION BY digest)""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.annotate(table(spark, folder, "documents"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, folder: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    read = bpe.read_ranks(spark, ranks or vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, folder, "documents"), read, public_tokenizers.PATTERN)


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=3)


def crc_left(modulus: int, rest: int):
    """Rows whose crc32 of doc_id as text leaves `rest`; false for a NULL id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.filter(~crc_left(4, 2)))
    found = langid.predict(docs, model)
    return found.select("doc_id", crc_left(4, 2).alias("held_out"), "lang_pred", "score")


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = toxicity.fit(docs, table(spark, folder, "labels"))
    found = toxicity.score(docs, net)
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def _crc_table() -> str:
    """The 256 steps of CRC-32 (reflected polynomial 0xEDB88320) as a SQL list."""
    out = []
    for step in range(256):
        for _ in range(8):
            step = (step >> 1) ^ (0xEDB88320 if step & 1 else 0)
        out.append(step)
    return f"{out}::BIGINT[]"


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes in SQL, byte by byte."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT)"


ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_spelling_variants",
    f"""WITH RECURSIVE runs AS (
      SELECT doc_id, unnest(regexp_extract_all({ASCII_LOWER.format("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
    hashed AS (SELECT run, k, {sql_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM counted),
    thinned AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
      ELSE run END AS word, k FROM hashed),
    v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
    pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT c.word, v.word FROM cut c JOIN v ON c.rest = v.word
      UNION SELECT v.word, c.word FROM cut c JOIN v ON c.rest = v.word),
    ranked AS (SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
        row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, encode(p.near)) AS place
      FROM pairs p JOIN v ON v.word = p.near),
    formed AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * v.n THEN r.near END AS form,
        CASE WHEN r.near_n >= 10 * v.n THEN r.near_n END AS form_n
      FROM v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1),
    chain(word, last) AS (SELECT word, word FROM formed
      UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.last FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NULL)
    SELECT f.word, f.form, e.last AS root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), thin=31, length=7, least=2), ratio=10)


BETWEEN_SQL = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


@query(
    "op12_importance_resampling",
    f"""WITH words AS (
      SELECT doc_id, list_filter(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '{BETWEEN_SQL}+'), lambda x: x <> '') AS w
      FROM documents),
    wanted AS (SELECT unnest(list_filter(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '{BETWEEN_SQL}+'), lambda x: x <> '')) AS w
      FROM benchmark),
    ids AS (SELECT row_number() OVER () AS row_no, doc_id, w FROM words),
    flat AS (SELECT row_no, w, count(*) AS k FROM (SELECT row_no, unnest(w) AS w FROM ids) GROUP BY ALL),
    buckets AS (SELECT w, {sql_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM flat UNION SELECT w FROM wanted)),
    s AS (SELECT bucket, sum(k) AS s FROM flat JOIN buckets USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (w) GROUP BY bucket),
    gains AS (SELECT b.bucket, floor(1000 * ln(
        (CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM s) AS DOUBLE) + 10000)
        / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) + 10000)))) AS gain
      FROM (SELECT DISTINCT bucket FROM buckets) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    weights AS (SELECT row_no, CAST(sum(k * gain) AS BIGINT) AS weight FROM flat JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY row_no),
    scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT)
          + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM ids LEFT JOIN weights USING (row_no)),
    placed AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM scored)
    SELECT doc_id, n_features, weight, score,
      CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
    FROM placed""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = (table(spark, folder, n) for n in ("documents", "benchmark"))
    return resampling.resample(docs, benchmark, longest=1, buckets=10_000, seed=2024, percent=10, least_words=20)


@query(
    "op13_sharding",
    f"""WITH d AS (
      SELECT doc_id, coalesce('=' || source, '') AS key, coalesce(text, '') AS text FROM documents),
    digests AS (SELECT doc_id, key, text,
        substr(sha256('{sharding.SEED}' || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || key || chr(10) || text), 1, 32) AS digest
      FROM d),
    copies AS (SELECT *, row_number() OVER (PARTITION BY digest) - 1 AS copy FROM digests),
    shuffled AS (SELECT *, CAST('0x' || substr(CASE WHEN copy = 0 THEN digest
        ELSE sha256(digest || chr(10) || CAST(copy AS VARCHAR)) END, 1, 15) AS BIGINT) AS axis FROM copies),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY axis, digest, copy) AS rank, count(*) OVER (PARTITION BY key) AS n,
        CAST('0x' || substr(sha256('{sharding.SEED}' || chr(10) || key), 1, 8) AS BIGINT) / 4294967296::DOUBLE AS shift
      FROM shuffled),
    placed AS (SELECT *, row_number() OVER (ORDER BY (CAST(rank - 1 AS DOUBLE) + shift) / CAST(n AS DOUBLE), rank, key) AS place,
        count(*) OVER () AS total FROM ranked),
    cut AS (SELECT *, (place * 8 + total - 1) // total - 1 AS shard FROM placed)
    SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, {sql_crc32("text")} AS text_crc32, 'rows' AS law,
      CAST(shard AS INTEGER) AS shard, CAST(place - 1 - (shard * total) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM cut""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.assign(table(spark, folder, "documents"), shards=8)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
