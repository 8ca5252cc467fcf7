"""Vocabularies that are added to a tokenizer: listed tokens, frequent predicates, pointers and specials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A

#: Fixed values of the reference: its marks of literals and nodes, the inverse, and the name of the graph language.
SPECIALS = ("<rel>", "</rel>", "<lit>", "</lit>", "-of")
GRAPH_LANGUAGE = "<AMR>"
POINTERS = 512
MIN_FREQ = 5


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, freq of a tab-separated list; a line without number has a null frequency."""
    return spark.read.schema("token string, freq bigint").option("sep", "\t").option("quote", "").csv(path)


def added_vocabulary(listed: DataFrame, min_freq: int = MIN_FREQ, pointers: int = POINTERS) -> DataFrame:
    """token, kind of all that is added: listed tokens without number, those frequent enough, pointers and specials; each once."""
    spark = listed.sparkSession
    own = listed.filter(F.col("freq").isNull() | (F.col("freq") >= min_freq)).select("token", F.when(F.col("freq").isNull(), "listed").otherwise("predicate").alias("kind"))
    rest = spark.createDataFrame([(f"<pointer:{i}>", "pointer") for i in range(pointers)] + [(t, "special") for t in SPECIALS], "token string, kind string")
    return own.unionByName(rest).groupBy("token").agg(F.min("kind").alias("kind"))


def to_add(added: DataFrame, known: DataFrame) -> DataFrame:
    """Added tokens that a tokenizer doesn't know yet, in order."""
    return added.join(known.select("token").distinct(), "token", "left_anti").select("token").distinct().orderBy("token")


def encode_ids(tokens: Column, ids: dict[str, int], unknown: int, most: int, begin: list[int], end: list[int], languages: tuple[int, ...] = (), graph_language: int | None = None) -> Column:
    """Ids of a token sequence: cut to what fits beside the specials, specials around it, ids of languages replaced."""
    inner = A.truncated(A.mapped(tokens, ids, unknown), most, len(begin) + len(end))
    whole = F.concat(*(F.array(*map(F.lit, x)) for x in (begin,) if x), inner, *(F.array(*map(F.lit, x)) for x in (end,) if x))
    if graph_language is None or not languages:
        return whole
    return F.transform(whole, lambda x: F.when(x.isin(*languages), graph_language).otherwise(x))


def collate(df: DataFrame, batch: str, inputs: str, labels: str, pad: int) -> DataFrame:
    """Batches padded to their longest: inputs and mask; labels of the decoder (all but the last) and of the loss (all but the first, padding ignored)."""
    longest = df.groupBy(batch).agg(F.max(F.size(inputs)).alias("_i"), F.max(F.size(labels)).alias("_l")).withColumnRenamed(batch, "_batch")
    rows = df.join(longest, df[batch].eqNullSafe(longest["_batch"]))
    padded = A.padded(F.col(labels), F.col("_l"), pad)
    rows = rows.withColumn("input_ids", A.padded(F.col(inputs), F.col("_i"), pad)).withColumn("_padded", padded)
    rows = rows.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(inputs)), F.array_repeat(F.lit(0), (F.col("_i") - F.size(inputs)).cast("int"))))
    return rows.withColumn("decoder_input_ids", A.without_last(F.col("_padded"))).withColumn("labels", A.replaced(A.without_first(F.col("_padded")), pad, A.IGNORED)).drop("_batch", "_i", "_l", "_padded")
