"""From raw documents to packed training sequences, in five stages over everything that the stage before kept.

language_id       rows whose text is null or has no letter go; null languages become the predicted ones
line_dedup        lines that spread over many sources go, but for their first occurrence
simhash_near_dedup  one document of each group of near-duplicates stays: SimHash fingerprints of five-word shingles within three bits, verified at a Jaccard
                  likeness of 0.8 or more; pairs that like whose fingerprints lie further apart are found exactly after that
mix_sources       documents that the mix of sources does not take go, those it takes twice are repeated
pack_sequences    the pieces of the documents' token ids and their places in sequences
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.batches import unused
from pathloom.functions.lineage import shared_folder
from pathloom.llm import language, likeness, lines, mixing, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are null or have no letter go. A null lang becomes the predicted one; given ones stay, and all do if none is given."""
    model = language.train(docs)
    lang, score = unused(docs.columns, "_lid_lang", "_lid_score")
    found = language.identify(docs, model, keep=tuple(docs.columns), names=(lang, score))
    said = F.col(lang) != "und" if model.langs else F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    filled = F.coalesce(F.col("lang"), F.when(F.col(lang) != "und", F.col(lang)))
    return found.where(said).select(*[filled.alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten sources or more go, but for their first occurrence. No document goes."""
    return lines.drop_boilerplate(docs, count_col=None)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of linked documents stays. Rows with a null id stay. Fingerprints link first, an exact pass what they miss."""
    return simhash.one_of_each(docs, likeness.near_copies(docs, radius=simhash.RADIUS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the schedule, as often as it takes half of their words or more. Documents without words are never taken."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot tokenise; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written as Parquet to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")

    def step(docs: DataFrame, numbered) -> DataFrame:
        k, (name, stage) = numbered
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}_{name}")
        return spark.read.parquet(path)

    return reduce(step, enumerate(STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet"))
