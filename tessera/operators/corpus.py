"""Documents to kept documents, sentences, distinct sentences, and hash splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tessera.functions import hashing, text
from tessera.operators.ordering import with_ordinal

# Names of text columns in the order of preference, and the synthetic sentences.
TEXT_COLUMNS = ("text", "content", "sentence", "body", "raw")
MIN_CHARS = 200
RING = (
    "ქართული ენა არის ქართველური ენების ჯგუფის ყველაზე გავრცელებული ენა.",
    "თბილისი საქართველოს დედაქალაქი და უდიდესი ქალაქია მდინარე მტკვრის ნაპირზე.",
    "ქართული დამწერლობა სამი ანბანისგან შედგება: ასომთავრული, ნუსხური და მხედრული.",
    "მთაწმინდა თბილისის ერთ-ერთი უბანია, სადაც მდებარეობს ტელევიზიის ანძა.",
    "ენის მოდელის წინასწარი ვარჯიში საჭიროებს დიდი რაოდენობის ტექსტურ მონაცემებს.",
)


def pick_text_column(schema: StructType) -> str:
    """A preferred name, else the first string column, else the first column."""
    names = schema.fieldNames()
    for name in TEXT_COLUMNS:
        if name in names:
            return name
    return next((f.name for f in schema.fields if isinstance(f.dataType, StringType)), names[0])


def ring_documents(numbers: DataFrame) -> DataFrame:
    """Document doc_id is four sentences of the ring from the doc_id-th on."""
    ring = F.array(*[F.lit(s) for s in RING])
    parts = [F.element_at(ring, F.pmod(F.col("doc_id") + j, F.lit(len(RING))).cast("int") + 1) for j in range(4)]
    return numbers.select("doc_id", F.concat_ws(" ", *parts).alias("text"))


def synthetic_documents(spark, n: int) -> DataFrame:
    return ring_documents(spark.range(n).withColumnRenamed("id", "doc_id"))


def long_documents(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Documents of more than `least` characters."""
    return docs.where(F.length(text.or_empty(F.col("text"))) > least)


def kept_documents(docs: DataFrame, least: int = MIN_CHARS, carry: tuple = ("text",)) -> DataFrame:
    """Long documents with doc_idx, their ordinal among themselves by doc_id. Only the columns to carry
    are sorted along: none of the text where its length or nothing is needed."""
    return with_ordinal(long_documents(docs, least).select("doc_id", *carry), "doc_idx", "doc_id")


def sentences(docs: DataFrame, least: int = 20, most: int = 300, script: str | None = None) -> DataFrame:
    """(doc_id, sent_pos, sentence) of the cleaned sentences of a length, and of a script if given."""
    found = docs.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sent_pos", "sentence"))
    found = found.where(text.length_between(F.col("sentence"), least, most))
    return found.where(text.has_script(F.col("sentence"), script)) if script else found


def distinct_sentences(found: DataFrame) -> DataFrame:
    """Each sentence once, at its first place. The aggregate combines on the map side, so a sentence
    that very many documents share is no burden to one task. The place is one number, doc_id times
    2**32 and sent_pos, which keeps the aggregate a hash one."""
    wide = F.lit(1 << 32).cast("decimal(10,0)")
    place = F.min(F.col("doc_id").cast("decimal(20,0)") * wide + F.col("sent_pos").cast("decimal(10,0)")).alias("place")
    first = found.groupBy("sentence").agg(place)
    at = F.pmod("place", wide)
    return first.select(F.call_function("div", F.col("place") - at, wide).alias("doc_id"), at.cast("int").alias("sent_pos"), "sentence")


def first_distinct(found: DataFrame, n: int) -> DataFrame:
    """(pos, doc_id, sentence): the first n distinct sentences in reading order."""
    first = distinct_sentences(found).orderBy("doc_id", "sent_pos").limit(n)
    return with_ordinal(first, "pos", "doc_id", "sent_pos").select("pos", "doc_id", "sentence")


def document_split(kept: DataFrame, share: float, seed: int) -> DataFrame:
    """kept with h in [0, 1) and is_val by the ordinal's hash."""
    return kept.withColumn("h", hashing.split_hash(F.col("doc_idx"), seed)).withColumn("is_val", F.col("h") < share)


def content_split(found: DataFrame, share: float, seed: int) -> DataFrame:
    """found with bucket and is_val by the sentence's hash: stable when the corpus grows."""
    return found.withColumn("bucket", hashing.content_bucket(F.col("sentence"), seed)).withColumn("is_val", F.col("bucket") < int(share * 1_000_000))


def metric_subset(found: DataFrame, n: int, seed: int) -> DataFrame:
    """The n sentences of the least content hash: they follow the text, not its position."""
    keyed = found.withColumn("order_key", hashing.content_order(F.col("sentence"), seed))
    return keyed.orderBy("order_key", "doc_id", "sent_pos").limit(n)
