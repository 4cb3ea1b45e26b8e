"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token output.

It belongs to tessella.llm and goes with it. The first three stages decide by row, never by id: null ids and rows that share an id are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mixing, simhash, token_frames, toxicity
from tessella.llm.common import BROADCAST_IDS, durable, shared_folder, table
from tessella.ship import ship

TOKENIZER = "word_bpe_49k.json"
#: Fewer than the operator's own: workers serve all stages and keep what each has filled.
CACHE_WORDS, CALL_BYTES = 80_000, 2 << 20


#: Column of a row's own key while a stage decides; ids may be null or repeated.
ROW = "_pipeline_row"


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with a unique key for each row, written, so that every later reading has the same keys."""
    path = shared_folder(spark, "pipeline-rows")
    docs.withColumn(ROW, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _rows(keyed: DataFrame) -> DataFrame:
    """The text of each row under its key, as the operators take documents."""
    return keyed.select(F.col(ROW).alias("doc_id"), "text")


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but those whose row key is among `rows` (column doc_id).

    Keys are dealt without gaps within a stored part, so rows go as bits, 64 keys a word: what the
    driver broadcasts is two bits a document at most, however many rows go."""
    word, bits = f"{ROW}_word", f"{ROW}_bits"
    gone = rows.groupBy(F.expr("shiftright(doc_id, 6)").alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(doc_id & 63 as int)))").alias(bits))
    gone = durable(gone)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    among = F.expr(f"shiftright({ROW}, 6) = {word} and getbit({bits}, cast({ROW} & 63 as int)) = 1")
    return keyed.join(gone, among, "left_anti").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is under the threshold; null and empty texts have the bias alone and
    stay unless nearly all labels are 1. Without labels every row stays."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    keyed = _keyed(spark, docs)
    return _without(keyed, toxicity.score(_rows(keyed), model).where(F.col("score") >= toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays, that of least id; a null id only where its group has no other.
    Of rows of one id the first stored stays. Null and empty texts are one group."""
    keyed = _keyed(spark, docs)
    near = durable(simhash.near_duplicates(_rows(keyed)).where("doc_id <> component_id").select("doc_id", "component_id"))
    members = near.unionByName(near.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
    ids = keyed.select(F.col(ROW).alias("_row"), F.col("doc_id").alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"]
    stays = members.join(simhash.merged(ids), F.col("doc_id") == F.col("_row")).groupBy("component_id").agg(first.alias("_stays")).select("_stays")
    return _without(keyed, members.join(simhash.merged(stays), F.col("doc_id") == F.col("_stays"), "left_anti"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of the benchmark; null and empty texts hold none."""
    keyed = _keyed(spark, docs)
    return _without(keyed, decontaminate.contained_items(_rows(keyed), table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole rows, each as often as its draw says, in the order of the global shuffle; a null
    source is one of its own, rows of one id (null too) share their draw."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))
    return mixing.mix(rows).select("_row.*")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order the mix was stored in: no sort by id brings copies together again.
    A null text has the end id alone."""
    import public_tokenizers

    return token_frames.token_frames(docs, public_tokenizers.path(TOKENIZER), as_they_come=True, cache_words=CACHE_WORDS, call_bytes=CALL_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("poisson_mixing", mixed),
    ("token_frames", tokenized),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. Long texts are taken whole, extra columns are
    carried along whatever their names, an empty table gives no rows."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
