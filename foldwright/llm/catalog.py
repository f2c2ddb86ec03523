"""One query for each operator, over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import chat, codes, decontaminate, divergence, language, lines, minhash, mixing, quality, sharding, spans, topk, warc
from foldwright.llm.rows import table
from foldwright.session import scratch_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship_package(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op5_minhash_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its class of near duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


_CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
z AS (SELECT DISTINCT least(len(w), 5) AS z FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + z - 1], ' ') FOR i IN range(1, len(w) - z + 2)]) AS s FROM d, z WHERE len(w) >= z),
isx AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s
        FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM isx GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM isx JOIN ds USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared::INTEGER AS shared, item_shingles::INTEGER AS item_shingles, shared / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE shared / item_shingles >= 0.8
"""


@query("op10_benchmark_containment", _CONTAINED_SQL)
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item it contains."""
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "item_shingles", "containment")


@query("op2_language_codes")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.train(docs.where("not held_out"))
    return language.identify(docs, model, ["doc_id", "held_out"])


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             (('0x' || substr(md5('20' || chr(31) || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, sum(greatest(least(size, 1000)::DOUBLE, 1e-9::DOUBLE)) AS wishes FROM d GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        (3 * source_size)::DOUBLE AS most FROM t),
c AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
        coalesce(sum(most) OVER (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
        (sum(weight) OVER (ORDER BY most / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open FROM w),
l AS (SELECT total - capped AS room, open FROM c WHERE weight * (total - capped) / open <= most ORDER BY most / weight, turn LIMIT 1),
g AS (SELECT c.source, c.source_size, c.n, c.wishes, coalesce(least(most, weight * (SELECT room FROM l) / (SELECT open FROM l)), most) AS target FROM c),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM g),
k AS (SELECT *, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS part, target - floor(ratio) * source_size AS room FROM h),
p AS (SELECT d.doc_id, d.size, k.*, least(greatest(part * greatest(least(size, 1000)::DOUBLE, 1e-9::DOUBLE) * n / wishes, 1e-12::DOUBLE), 1::DOUBLE - 1e-12::DOUBLE) AS p, u
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM p),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q)
SELECT doc_id, size, source_size, target,
       (least(3, whole + CASE WHEN room > 0 AND ahead + size / 2 <= room THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""


@query("op7_pareto_mix", _MIX_SQL)
def pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mixed = mixing.mix_by_length(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_SHARD_SQL = """
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS k FROM documents),
l AS (SELECT d.*, level, k >> (32 - level)::BIGINT AS prefix FROM d, range(0, 33) r(level)),
b AS (SELECT *, sum(bytes) OVER (PARTITION BY level, prefix) AS total FROM l),
f AS (SELECT doc_id, bytes, min(struct_pack(level := level, prefix := prefix)) AS hit FROM b WHERE total <= 1048576 GROUP BY ALL)
SELECT doc_id, bytes, lpad(hit.level::VARCHAR, 2, '0') || '-' || hit.prefix::VARCHAR AS shard FROM f
"""


@query("op8_extendible_shards", _SHARD_SQL)
def extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and size of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, identity=["doc_id"]).select("doc_id", "shard", "bytes")


_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, list_reduce(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          (((('0x' || substr(hex, (1 + 10 * (i // 8))::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31) + 1)::INTEGER, 1)),
        lambda a, b: a || b) AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM m
"""


@query("op9_warc_round_trip", _WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op1_nra_top_k", _TOPK_SQL)
def nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for each hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), topk.quantized().alias("vector"))
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.exact_top_k(vectors, queries)


@query("op3_positive_unlabelled_quality")
def positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language.held_out(parts=3, part=1))
    model = quality.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, ["doc_id", "held_out"])


@query("op6_sentence_spans")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's removed sentences and what is left of its text."""
    cleaned = spans.drop_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "sentences", F.coalesce(F.size("removed"), F.lit(0)).alias("removed_sentences"), "removed", F.length(kept).alias("kept_chars"), F.md5(kept.cast("binary")).alias("kept_md5"))


@query("op4_fuzzy_lines")
def fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's removed lines and what is left of its text."""
    cleaned = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), wide=True)
    kept = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "lines", F.coalesce(F.size("removed"), F.lit(0)).alias("removed_lines"), "removed", F.length(kept).alias("kept_chars"), F.md5(kept.cast("binary")).alias("kept_md5"))


_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS k, count(DISTINCT n) AS docs FROM w GROUP BY lang, source, term),
t AS (SELECT lang, term, sum(k)::HUGEINT AS lk FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lk)::HUGEINT AS ln FROM t GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
kc AS (SELECT c.lang, c.source, c.term, c.k::HUGEINT AS k FROM c JOIN t USING (lang, term)),
s AS (SELECT g.lang, g.source, coalesce(sum(kc.k), 0)::HUGEINT AS n FROM g LEFT JOIN kc USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, t.term, coalesce(kc.k, 0) AS k, 1 + 1000000000::HUGEINT * (coalesce(kc.k, 0) + 1) // (s.n + v.v) AS p,
        1 + 1000000000::HUGEINT * (t.lk + 1) // (v.ln + v.v) AS q
      FROM s JOIN v USING (lang) JOIN t USING (lang) LEFT JOIN kc ON kc.lang = s.lang AND kc.source = s.source AND kc.term = t.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE k > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", _DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of a language differs from the others, and by which terms from its language."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def _codes_round(i: int) -> str:
    """SQL: the parts' nearest entries of codebook c<i>, and codebook c<i + 1>."""
    return f"""
a{i} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := (pp + ee - 2 * list_inner_product(p.v, c.v))::BIGINT, entry := entry)) AS m FROM
      (SELECT *, list_inner_product(v, v) AS pp FROM p) p JOIN (SELECT part, entry, v, list_inner_product(v, v) AS ee FROM c{i}) c USING (part) GROUP BY vec_id, part),
x{i} AS (SELECT part, m.entry AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i} JOIN p USING (vec_id, part)),
m{i} AS (SELECT part, entry, list(mean ORDER BY pos) AS v FROM (SELECT part, entry, pos, floor(sum(x) / count(*)) AS mean FROM x{i} GROUP BY part, entry, pos) GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, entry)),"""


_CODES_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM k, range(0, 4) r(part)),
c0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p) WHERE entry < 256),
{"".join(_codes_round(i) for i in range(4))}
a AS (SELECT vec_id, part, min(struct_pack(d := (list_inner_product(p.v, p.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(p.v, c.v))::BIGINT, entry := entry)) AS m
      FROM p JOIN c4 c USING (part) GROUP BY vec_id, part),
e AS (SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h
"""


@query("op11_vector_codes", _CODES_SQL)
def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, with its error and that of its label."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label", codes.quantized().alias("vector"))
    return codes.compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 4 + length(role) + 2 + 8 + length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
        + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op12_chat_formatting", _CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own markers, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), "role", "text")
    marked = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = rows.union(spark.range(2).select(F.lit(-7).cast("long"), "id", role, F.lit(marked)))
    events = rows.withColumns({"kind": F.lit("message"), "message": F.lit(None).cast("string")})
    return chat.digests(chat.format_conversations(events))
