"""The registered queries of this package, each over a whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    alignment, merkle, mixing, packing, perspectives, recipes, repeats, sharding, shingle_join, superminhash, syncmers, tokens,
    toxicity,
)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_closed_syncmers(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


@query()
def op2_overlap_resync(spark, sf_dir):
    """The number of tokens of every document."""
    return tokens.token_counts(documents(spark, sf_dir).select("doc_id", "text"))


@query()
def op3_pareto_mixture(spark, sf_dir):
    """How many words a mixture of the sources takes of each document."""
    mixed = mixing.pareto_mixture(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
        F.col("__copies").alias("copies"),
    )


@query()
def op4_nonnegative_pu(spark, sf_dir):
    """The toxicity of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_scores(docs, model)


@query(
    r"""
    WITH said AS (
      SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS message
      FROM conversations),
    views AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
    spread AS (
      SELECT said.*, perspective,
        CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM said JOIN views USING (conv_id)),
    headed AS (
      SELECT *, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head
      FROM spread),
    full_text AS (SELECT *, head || message || '<|end|>' || chr(10) AS rendered FROM headed),
    placed AS (
      SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(rendered)) OVER w AS BIGINT) AS end_char
      FROM full_text
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, message
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT conv_id, perspective, position, turn, speaker, role, rendered, end_char - length(rendered) AS start_char,
      end_char, speaker = perspective AS trained,
      CASE WHEN speaker = perspective THEN end_char - length(rendered) + length(head) END AS mask_start,
      CASE WHEN speaker = perspective THEN end_char - 1 END AS mask_end
    FROM placed
    """
)
def op5_perspective_rotation(spark, sf_dir):
    """Every dialogue from the view of each of its speakers."""
    return perspectives.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query(
    """
    WITH bodies AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    sized AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM bodies),
    strings AS (
      SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 200)) AS digest
      FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM sized)),
    ordered AS (
      SELECT doc_id, p, row_number() OVER (PARTITION BY digest ORDER BY doc_id, p) AS place FROM strings),
    later AS (
      SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh
      FROM ordered WHERE place > 1),
    runs AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM later),
    spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS earlier FROM spans),
    removed AS (
      SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last_b,
        string_agg(substr(h, CAST(2 * earlier + 1 AS BIGINT), CAST(2 * (a - earlier) AS BIGINT)), '' ORDER BY a) AS kept
      FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last_b, 0) + 1 AS BIGINT)))) AS kept_sha256
    FROM sized LEFT JOIN removed USING (doc_id)
    """
)
def op6_suffix_arrays(spark, sf_dir):
    """What is left of every document without the bytes that repeat earlier text."""
    kept = repeats.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op7_deficit_packing(spark, sf_dir):
    """All documents in sequences of 1024 tokens, each holding the sources in proportion."""
    return packing.pack_mixture(documents(spark, sf_dir).select("doc_id", "source", "text"))


@query(
    r"""
    WITH RECURSIVE split AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
          range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s
      FROM split),
    sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    entries AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM entries a JOIN entries b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * c >= 75 * (x.n + y.n - c)),
    reached AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
    SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id
    FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """
)
def op8_adaptive_prefixes(spark, sf_dir):
    """The group of similar documents that each document belongs to."""
    return shingle_join.similar_documents(documents(spark, sf_dir).select("doc_id", "text"))


@query()
def op9_hypergeometric_shards(spark, sf_dir):
    """All documents in 16 shards whose sizes are at most one apart."""
    rows = documents(spark, sf_dir).select("doc_id", "source", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.hypergeometric_shards(rows, ["doc_id", "text"]).select(
        "doc_id",
        F.when(F.col("text").isNull(), 1).otherwise(F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    r"""
    WITH d AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
      doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """
)
def op10_chunk_recipes(spark, sf_dir):
    """Which document stands for each text."""
    return recipes.exact_groups(documents(spark, sf_dir).select("doc_id", "text"))


@query(
    r"""
    WITH RECURSIVE split AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
          range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END AS s
      FROM split),
    sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    entries AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
    shared AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM entries a JOIN entries b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reached AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
    SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(other) AS component_id, min(other) = doc_id AS kept
    FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """
)
def op11_superminhash(spark, sf_dir):
    """The group of near copies that each document belongs to."""
    return superminhash.near_copies(documents(spark, sf_dir).select("doc_id", "text"))


@query()
def op12_lockstep_alignment(spark, sf_dir):
    """How the tokens of two tokenizers lie on each other in every document."""
    return alignment.align_tokenizers(documents(spark, sf_dir).select("doc_id", "text"))[0]


@query(
    r"""
    WITH RECURSIVE encoded AS (
      SELECT doc_id, source, text, lang, n_chars,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
          || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
          || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front,
        list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
            string_split(coalesce(CAST(doc_id AS VARCHAR), '-'), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS crc
      FROM documents),
    digests AS (
      SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed, front
      FROM encoded),
    leaves AS (
      SELECT *, sha256(front || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered_leaf,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM digests),
    nodes AS (
      SELECT 0 AS level, source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM leaves
      UNION ALL
      SELECT level, source, i, sha256(h), n FROM (
        SELECT level + 1 AS level, source, i // 3 AS i, string_agg(h, '' ORDER BY i) AS h, (n + 2) // 3 AS n
        FROM nodes WHERE n > 1 GROUP BY level + 1, source, i // 3, (n + 2) // 3)),
    subroots AS (
      SELECT source, h, level AS top, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS i
      FROM nodes WHERE n = 1),
    upper AS (
      SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroots
      UNION ALL
      SELECT level, i, sha256(h), n FROM (
        SELECT level + 1 AS level, i // 3 AS i, string_agg(h, '' ORDER BY i) AS h, (n + 2) // 3 AS n
        FROM upper WHERE n > 1 GROUP BY level + 1, i // 3, (n + 2) // 3)),
    runs AS (
      SELECT source, false AS above, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
      UNION ALL
      SELECT NULL, true, level, i // 3, list(h ORDER BY i) FROM upper WHERE n > 1 GROUP BY ALL),
    start AS (
      SELECT leaves.doc_id, leaves.source, leaves.i AS spot, leaf, tampered_leaf, subroots.h AS subroot, subroots.top,
        subroots.i AS rank, (SELECT max(level) FROM upper) AS upper_top
      FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source),
    walk AS (
      SELECT doc_id, source, spot, leaf, subroot, top, rank, upper_top, 0 AS step,
        CASE WHEN top = 0 THEN rank ELSE spot END AS i, tampered_leaf AS node, '' AS proof
      FROM start
      UNION ALL
      SELECT w.doc_id, w.source, w.spot, w.leaf, w.subroot, w.top, w.rank, w.upper_top, w.step + 1,
        CASE WHEN w.step + 1 = w.top THEN w.rank ELSE w.i // 3 END,
        sha256(array_to_string(list_transform(r.hs, lambda h, k: CASE WHEN k - 1 = w.i % 3 THEN w.node ELSE h END), '')),
        w.proof || array_to_string(list_filter(r.hs, lambda h, k: k - 1 <> w.i % 3), '')
      FROM walk w JOIN runs r
        ON r.above = (w.step >= w.top) AND (r.above OR r.source IS NOT DISTINCT FROM w.source)
          AND r.level = CASE WHEN w.step >= w.top THEN w.step - w.top ELSE w.step END AND r.run = w.i // 3)
    SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
      node AS folded_root, node = (SELECT h FROM upper WHERE n = 1) AS verified
    FROM walk WHERE step = top + upper_top
    """
)
def op13_merkle_manifest(spark, sf_dir):
    """Every document's proof in the manifest of all, checked against a text without line ends for every second one."""
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary")) % 2 == 0
    shorter = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    return merkle.verified_manifest(documents(spark, sf_dir), fields, "source", "doc_id", {"text": shorter})
