"""The queries of this subpackage; ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquill.llm.bpe import default_tokenizer, encode_texts
from docquill.llm.byte_bpe import decode_by_ranks, default_ranks, encode_by_ranks
from docquill.llm.centroids import centroid_clusters, centroid_sql
from docquill.llm.chroma import align_recordings, melody
from docquill.llm.common import remainder, table, text_of
from docquill.llm.exact_dedup import exact_duplicates
from docquill.llm.hard_negatives import hard_negatives
from docquill.llm.lbl_scoring import score_texts
from docquill.llm.mixing import mix_sources, words_in
from docquill.llm.simhash import near_duplicates
from docquill.llm.quality import THRESHOLD, learn_quality, quality_score
from docquill.llm.secret_scan import scan_secrets, written
from docquill.llm.substring_dedup import repeated_spans
from docquill.llm.url_filter import judge_urls
from docquill.scratch import materialize


def op6_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op1_simhash_gray(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op2_url_ngrams(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_chroma_align(spark, sf_dir):
    """No table has audio: every vector of ``embeddings`` is played as a melody, and the recordings are matched. ``n_links`` has all queries that a row is aligned with, ``n_leaders`` their leaders."""
    names = {"id": "vec_id", "n_links": "n_leaders", "n_aligned": "n_links"}
    return align_recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", melody).withColumnsRenamed(names)


def op4_lbl_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), held_out=remainder(F.col("doc_id"), 7) == 2)


def op5_quality_trees(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0
    model = learn_quality(docs, table(spark, sf_dir, "labels"), learn_from=~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(text_of("text")).alias("words"))
    mixed = mix_sources(materialize(docs, "words"), size_col="words")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"), "mix.copies")


def op8_bpe_roundtrip(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), default_tokenizer())


def bpe_digests(docs, tokenizer):
    coded = encode_texts(docs, tokenizer, decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )


def op9_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: ~s["weak"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def op10_line_dedup(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents")).drop("row")


def op11_chunked_bytes(spark, sf_dir):
    coded = decode_by_ranks(encode_by_ranks(table(spark, sf_dir, "documents"), default_ranks()), default_ranks())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_gnat_negatives(spark, sf_dir):
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=label)


def op13_hilbert_centroids(spark, sf_dir):
    return centroid_clusters(table(spark, sf_dir, "embeddings")).drop("compared")


def queries():
    return {
        "op1_simhash_gray": op1_simhash_gray,
        "op2_url_ngrams": op2_url_ngrams,
        "op3_chroma_align": op3_chroma_align,
        "op4_lbl_score": op4_lbl_score,
        "op5_quality_trees": op5_quality_trees,
        "op7_source_mix": op7_source_mix,
        "op8_bpe_roundtrip": op8_bpe_roundtrip,
        "op9_secret_scan": op9_secret_scan,
        "op10_line_dedup": op10_line_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op11_chunked_bytes": op11_chunked_bytes,
        "op12_gnat_negatives": op12_gnat_negatives,
        "op13_hilbert_centroids": op13_hilbert_centroids,
    }


ORACLES = {
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op12_gnat_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE label = anchor_label) WHERE n <= 5),
        x AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM x WHERE rank <= 3
    """,
    "op13_hilbert_centroids": centroid_sql(),
}
