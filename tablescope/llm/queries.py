"""The registered corpus queries; each applies its operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm.auction import repaired
from tablescope.llm.common import numbered_in_place
from tablescope.llm.decontamination import contaminated
from tablescope.llm.gnat import product_codes
from tablescope.llm.katz import model_scores
from tablescope.llm.lempel_ziv import distinct_words
from tablescope.llm.mixing import mix_sources
from tablescope.llm.quality_rules import quality_rules
from tablescope.llm.sharding import shard_records
from tablescope.llm.simhash import near_duplicates
from tablescope.llm.surrogates import replace_entities
from tablescope.llm.toxicity import toxicity
from tablescope.llm.warc import BASE32, archived_pages
from tablescope.llm.weak_quality import weak_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURROGATE_KEY = "tables of the benchmark"  # callers pass a secret of their own


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_cube_mixing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


@query("op10_sampled_splitters")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return shard_records(table(spark, folder, "documents"))


@query("op9_simhash_byte_index")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op7_distribution_divergence")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


@query("op1_rare_seed_alignment")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_LETTERS = " || ".join(f"substr('{BASE32}', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))


@query("op4_content_addressed_warc", f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
                 max(page_id) OVER (PARTITION BY body) AS holder FROM p)
    SELECT page_id, payload_bytes,
           array_to_string([{_LETTERS} FOR v IN [('0x' || substr(hex, 5 * k + 1, 5))::BIGINT FOR k IN range(0, 8)]],
                           '') AS payload_digest,
           CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> holder THEN holder END AS refers_to
    FROM h""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(table(spark, folder, "pages"))


@query("op5_katz_backoff")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, row = numbered_in_place(table(spark, folder, "documents"))
    return model_scores(docs, row=row)


@query("op2_lexicon_automata")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op6_surrogates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return replace_entities(table(spark, folder, "documents"), SURROGATE_KEY)


@query("op3_weak_label_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality(table(spark, folder, "documents"))


@query("op11_lempel_ziv_dedup", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d),
    copies AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS k
               FROM starts),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM copies WHERE k > 1),
    every AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS body
             FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(body, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_words(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op13_auction_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "conversations"))


def _codebook_sql(rounds: int = 4) -> str:
    """Assignments and means of whole parts, round by round."""
    square = "list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) FOR i IN range(1, len(p.x) + 1)])"
    steps = ["""p AS MATERIALIZED (
        SELECT vec_id, label, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x
        FROM (SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        CROSS JOIN (SELECT unnest(range(0, 4)) AS part))""",
             """b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x
        FROM p QUALIFY e < 256)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
        SELECT vec_id, label, part, x, best.d AS d, best.e AS e FROM (
            SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.x) AS x, min({{'d': {square}, 'e': b.e}}) AS best
            FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.vec_id, p.part))""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
        SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
            SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
                SELECT part, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
                    SELECT part, e, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM a{r}) GROUP BY part, e, i)
            GROUP BY part, e) m ON b.part = m.part AND b.e = m.e)""")
    return f"""WITH {", ".join(steps)},
    c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code,
                 sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, i)) FROM (
               SELECT part, e, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM b{rounds})) AS codebooks_sha256
    FROM c"""


@query("op12_gnat_codes", _codebook_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return product_codes(table(spark, folder, "embeddings"))
