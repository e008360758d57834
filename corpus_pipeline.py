"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data is masked,
sources are mixed to their targets, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages, rows are written to Parquet in the folder that the cluster shares and read again, and deleted once the next stage
has been written.

Defined results: columns of documents pass as they are, whatever their names; null and empty texts pass the first three
stages and have no words, so the mix takes none of them; texts of any length are handled whole; repeated rows (one doc_id)
stay or go together and are mixed each for itself; rows without a doc_id are never near duplicates; equal inputs give equal
results, ties included (by doc_id, size, text); empty tables give empty results.
"""

from pyspark.sql import functions as F

from wicketry.llm import bpe, common, minhash, mixing, pii, toxicity


def toxicity_stage(spark, docs, sf_dir):
    """Documents that the factorization machine scores at 0.5 or more go."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("_predicted = 0").select("_row.*")


def near_dedup_stage(spark, docs, sf_dir):
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    common.ship(spark)
    return minhash.deduplicate(docs, n_words=5, percent=80)


def pii_stage(spark, docs, sf_dir):
    """Personal data is replaced by its kind; n_chars follows the text."""
    common.ship(spark)
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), F.col("n_chars")))
    return masked.select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """Each document is repeated, cut or left out as the mix takes it; a cut text keeps its first words."""
    mixed = mixing.mixed(mixing.sized(docs)).filter("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("(taken + size - 1) div size"))))
    rest = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    text = F.col("_row.text")
    words = F.array_remove(F.split(text, common.SPACE), "")
    text = F.when(rest < F.col("size"), F.array_join(F.slice(words, F.lit(1), rest), " ")).otherwise(text)
    changed = copies.withColumn("_text", text)
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return changed.select(*(new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns))


def bpe_stage(spark, docs, sf_dir):
    """Tokens of every text, and digests of ids and decoded text."""
    common.ship(spark)
    return bpe.encode_decode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: A trained score, near duplicates and token merges can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
