"""From raw documents to packed training sequences; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelane.llm import quality, toxicity
from kinelane.llm.common import read, stored, text_of
from kinelane.llm.exchange import row_key
from kinelane.llm.packing import best_fit
from kinelane.llm.passages import LAST
from kinelane.llm.queries import vocabulary
from kinelane.llm.repeats import remove_repeats
from kinelane.llm.simhash import near_duplicates


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits on their statistics and the trees fitted on this table's labelled documents.

    Null and empty texts have no words and go; null ids are judged like others; repeated rows go or stay together; an
    empty table stays empty; other columns pass through.
    """
    trees = quality.train(docs.select("doc_id", text_of().alias("text")), read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, trees)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from labelled documents that are not held out, is below the limit.

    It is learnt from the given table's documents, not from those left by earlier stages, which hold fewer toxic ones.
    Null and empty texts are scored like text without toxic words; null ids are judged like others; repeated rows go or
    stay together; an empty table stays empty; other columns pass through.
    """
    known = read(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    model = toxicity.train(known, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that steps of three bits or fewer connect.

    Rows with equal id and text are one document, of which one row stays; a null id comes after all others.
    """
    key, turn = _free("_row", docs), _free("_turn", docs)
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    ids = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col(key).alias("row"))
    groups = near_duplicates(keyed.select(ids.alias("doc_id"), "text"), shingle=3, distance=3)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias(key))
    kept = keyed.join(first, key, "left_semi")
    numbered = kept.withColumn(turn, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return numbered.filter(F.col(turn) == 1).select(*docs.columns)


def _free(name: str, df: DataFrame) -> str:
    """``name``, or the first longer one that is no column of ``df``."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of any 400-byte string that also starts elsewhere; ``n_chars`` is counted anew."""
    rest = [c for c in docs.columns if c != "text"]
    found = remove_repeats(docs.select(F.struct(*rest).alias("doc_id"), "text"), width=400, texts=True)
    text = F.col("kept").alias("text")
    columns = {"text": text, "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in rest else {"text": text}
    return found.select(*[columns.get(c, F.col("doc_id").getField(c).alias(c)) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of at most 1024 tokens.

    Null and empty texts are the end id alone; null ids and repeated rows are packed as they occur; an empty table gives
    no rows; other columns are left out.
    """
    return best_fit(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality rules", good_quality),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]

#: Fitted models, near-duplicate components and suffix arrays are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
