"""The registered queries of this subpackage and the SQL that some of them are compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom.llm.common import table
from lossloom.llm.compare_sql import merkle_sql, near_duplicates_sql, prefix_trie_sql, secrets_sql, similar_vectors_sql
from lossloom.llm.heavy_dedup import duplicate_groups, duplicate_groups_sql, fold_ascii
from lossloom.llm.license_rules import licences, licences_sql
from lossloom.plans.workspace import scratch_table


def op1_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in all documents."""
    return licences(table(spark, sf_dir, "documents"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    from lossloom.llm.spaced_seeds import passages

    return passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("sign")


def op3_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, counted and digested."""
    from lossloom.llm.secrets import BASE_RULES, scan

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(of(k) for k in kinds), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op4_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in packed sequences of 2048 ids."""
    from lossloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_sphere_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of at least 0.95."""
    from lossloom.llm.sphere_caps import similar_vectors

    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to frame files and read back."""
    from lossloom.llm.token_frames import read_token_frames, write_token_frames

    manifest = write_token_frames(table(spark, sf_dir, "documents"), scratch_table(spark, "token-frames"))
    read = read_token_frames(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def derived_edits(docs: DataFrame) -> DataFrame:
    """Three edits for every document, at places given by a hash: an insertion, a removal and a replacement."""

    def place(k):
        return F.pmod(F.xxhash64("doc_id", F.lit(k)), F.coalesce(F.length("text"), F.lit(0)) + 1)

    kinds = [(0, " corrected note "), (12, ""), (5, "re, done. ")]
    edits = [F.struct(F.lit(k).alias("edit_no"), place(k).alias("at"), F.lit(n).alias("remove"), F.lit(t).alias("insert")) for k, (n, t) in enumerate(kinds)]
    return docs.select("doc_id", F.inline(F.array(*edits)))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after edits."""
    from lossloom.llm.edit_counts import apply_edits, count_trees

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = apply_edits(count_trees(docs), derived_edits(docs))
    return edited.select("doc_id", "n_before", "n_edits", "n_encoded", "n_tokens", F.sha2("text", 256).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from two thirds of the labels."""
    from lossloom.llm.toxicity import learn, score

    def remainder(col):
        return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3))

    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels").where(remainder("doc_id") != 1))
    held_out = F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out")
    return score(docs, lexicon).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned without labels."""
    from lossloom.llm.weak_quality import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs))


def op10_hamming_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over four-word shingles at a similarity of 0.8."""
    from lossloom.llm.hamming_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_prefix_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    from lossloom.llm.prefix_trie import prefix_trie, rebuild

    return prefix_trie(*rebuild(table(spark, sf_dir, "conversations"))).drop("turn_sha256")


def op12_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op13_merkle_multiproof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded from leaves a fifth of which were tampered with."""
    from lossloom.llm.merkle import build_manifest, leaf_of, prove

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    named = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    tampered = leaf_of([fold_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    manifest = build_manifest(table(spark, sf_dir, "documents"), columns, "source", "doc_id", {"other": F.when(named, tampered)})
    claims = manifest.leaves.withColumn("claim", F.coalesce("other", "hash"))
    return prove(manifest, claims, "claim").withColumnRenamed("number", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licence_rules": op1_licence_rules,
    "op2_spaced_seeds": op2_spaced_seeds,
    "op3_secret_automaton": op3_secret_automaton,
    "op4_shortest_pack": op4_shortest_pack,
    "op5_sphere_caps": op5_sphere_caps,
    "op6_token_frames": op6_token_frames,
    "op7_edit_counts": op7_edit_counts,
    "op8_toxicity": op8_toxicity,
    "op9_weak_quality": op9_weak_quality,
    "op10_hamming_minhash": op10_hamming_minhash,
    "op11_prefix_collapse": op11_prefix_collapse,
    "op12_heavy_hitters": op12_heavy_hitters,
    "op13_merkle_multiproof": op13_merkle_multiproof,
}
ORACLES: dict[str, str] = {
    "op1_licence_rules": licences_sql(),
    "op3_secret_automaton": secrets_sql(),
    "op5_sphere_caps": similar_vectors_sql(),
    "op10_hamming_minhash": near_duplicates_sql(),
    "op11_prefix_collapse": prefix_trie_sql(),
    "op12_heavy_hitters": duplicate_groups_sql(),
    "op13_merkle_multiproof": merkle_sql(),
}
