"""What a training run counts: losses, pooled states, parameters, progress, vocabulary checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing

# The special tokens, at the ids 0 to 4.
SPECIAL_TOKENS = ("[PAD]", "[MASK]", "[UNK]", "[CLS]", "[SEP]")
# The task of an input type.
TASKS = {"passage": "RETRIEVAL_DOCUMENT", "query": "RETRIEVAL_QUERY"}


def cross_entropy(scores: Column, target: Column) -> Column:
    """log of the sum of exp(scores), less the target's score (target counts from 0)."""
    top = F.array_max(scores)
    return top + F.log(F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))) - F.element_at(scores, target + 1)


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """Sum of value times weight over the sum of weights, or over 1 if that is less; slots of no weight go first."""
    some = rows.where(F.col(weight) != 0)
    total = F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1.0))
    return some.agg((F.coalesce(F.sum(F.col(value) * F.col(weight)), F.lit(0.0)) / total).alias("loss"))


def mean_of_first(losses: DataFrame, most: int = 32) -> DataFrame:
    """Mean of the losses (batch, loss) of the first `most` batches; 0 of none."""
    return losses.orderBy("batch").limit(most).agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def pooled(ids: Column, states: Column, width: int) -> Column:
    """Mean of the states (an array of vectors) at content ids, over 1 if there are none."""
    pairs = F.filter(F.arrays_zip(ids.alias("id"), states.alias("state")), lambda p: p["id"] >= arrays.SPECIALS)
    total = F.aggregate(pairs, F.array_repeat(F.lit(0.0), width), lambda s, p: F.zip_with(s, p["state"], lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(pairs), F.lit(1)))


def loss_windows(log: DataFrame, every: int, total: int) -> DataFrame:
    """Of a log (step, seconds, loss) a row for each `every` steps: their mean loss, the steps a second
    since the row before, and the seconds left to `total` steps. Windows are joined with the one
    before, so a long log is no burden to one task."""
    window = F.floor(F.col("step") / every).alias("window")
    sums = log.groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"), F.min("seconds").alias("since"), F.max("seconds").alias("until"), F.max("step").alias("last"))
    before = sums.select((F.col("window") + 1).alias("window"), F.col("until").alias("start"))
    both = sums.join(before, "window", "left").withColumn("start", F.coalesce("start", "since"))
    rate = F.col("n") / F.greatest(F.col("until") - F.col("start"), F.lit(1e-6))
    left = (F.lit(total) - F.col("last") - 1) / F.greatest(rate, F.lit(1e-9))
    return both.select("window", "n", "loss", rate.alias("rate"), left.alias("eta"))


def snapshots(rows: DataFrame, every: int) -> DataFrame:
    """(snapshot, embedded): how many of the rows (pos) a periodic snapshot each `every` new items holds."""
    taken = rows.agg(F.floor(F.count(F.lit(1)) / every).alias("n"))
    return taken.where("n > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("snapshot")).withColumn("embedded", F.col("snapshot") * every)


def retry_plan(failures: DataFrame, batch: int, retries: int) -> DataFrame:
    """Of calls (call, limited, broken): how often the server refused one and how often it failed. Waits
    double up to a minute, and a call gives up after `retries`; failures halve the batch, and at a batch of
    one the item is skipped. (call, waited, gave_up, batch, skipped)"""
    tries = F.least(F.col("limited"), F.lit(retries))
    waits = F.aggregate(F.sequence(F.lit(1), F.lit(retries)), F.lit(0.0), lambda s, i: s + F.when(i <= tries, F.least(F.lit(60.0), F.pow(F.lit(2.0), i))).otherwise(0.0))
    halvings = max(batch, 1).bit_length() - 1  # until the batch is 1
    size = F.greatest(F.lit(1), F.floor(F.lit(batch) / F.pow(F.lit(2.0), F.least(F.col("broken"), F.lit(62)))).cast("int"))
    gave_up = F.col("limited") > retries
    return failures.select("call", waits.alias("waited"), gave_up.alias("gave_up"), size.alias("batch"), (F.col("broken") > halvings).alias("skipped"))


def parameter_counts(shapes: DataFrame) -> DataFrame:
    """total, embedding and non_embedding numbers of parameters, of arrays (path, shape)."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda s, x: s * x)
    sums = shapes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.contains("path", F.lit("embedding")), size)), F.lit(0)).alias("embedding"))
    return sums.withColumn("non_embedding", F.col("total") - F.col("embedding"))


def head_width(hidden: Column, heads: Column) -> Column:
    """hidden / heads, an error where that leaves a rest."""
    return F.when(hidden % heads == 0, (hidden / heads).cast("int")).otherwise(F.raise_error(F.format_string("%d heads do not divide a width of %d", heads, hidden)).cast("int"))


def vocabulary_checks(vocabularies: DataFrame) -> DataFrame:
    """Of vocabularies (name, token, id, requested): whether the special tokens are at 0 to 4, whether
    padding is 0, the size, and whether that is the requested one."""
    place = F.create_map(*[x for i, t in enumerate(SPECIAL_TOKENS) for x in (F.lit(t), F.lit(i))])
    right = F.count_if(F.element_at(place, F.col("token")) == F.col("id")) == len(SPECIAL_TOKENS)
    padding = F.coalesce(F.bool_or((F.col("token") == SPECIAL_TOKENS[0]) & (F.col("id") == 0)), F.lit(False))
    found = vocabularies.groupBy("name").agg(right.alias("specials"), padding.alias("padding"), F.count(F.lit(1)).alias("size"), F.max("requested").alias("requested"))
    return found.select("name", "specials", "padding", "size", (F.col("size") == F.col("requested")).alias("as_requested"))


def script_entries(vocabulary: DataFrame, letters: str) -> DataFrame:
    """How many entries (piece) there are, and how many have a character of the class, after decoding."""
    return vocabulary.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("piece").rlike(f"[{letters}]")).alias("with_script"))


def resolution(spec: Column, has_folder: Column, has_inner: Column, has_file: Column, size: Column, requested: Column, is_hub: Column, has_parent: Column) -> Column:
    """What a tokenizer's name stands for, in the order of folder, file, hub id, or one to be made."""
    folder = F.when(has_inner, "folder").otherwise("error")
    file = F.when(size <= requested, "file").otherwise("train")
    hub = is_hub & (spec.startswith("hf://") | ~has_parent)
    return F.when(has_folder, folder).when(has_file, file).when(hub, "hub").otherwise("train")


def normal(*parts) -> Column:
    """A standard normal number from the parts' hash (the cosine branch of the polar method)."""
    u = (hashing.draw_number(*parts, "u") + 1) / F.lit(4294967296.0)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * hashing.draw_number(*parts, "v") / F.lit(4294967296.0))


def projected_bags(bags: DataFrame, vocabulary: int, dim: int, seed: int, noise: float = 0.01) -> DataFrame:
    """(item_id, dim, value): token counts (item_id, token_id, n) over their norm, times a random matrix
    over the root of the vocabulary's size, plus noise. The matrix is a function of token, dim and seed."""
    norms = bags.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    cells = bags.select("token_id").distinct().withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    cells = cells.withColumn("p", normal(F.col("token_id"), F.col("dim"), seed) / math.sqrt(vocabulary))
    sums = bags.join(cells, "token_id").groupBy("item_id", "dim").agg(F.sum(F.col("n") * F.col("p")).alias("s"))
    own = noise * normal(F.col("item_id"), F.col("dim"), seed + 1)
    return sums.join(norms, "item_id").select("item_id", "dim", (F.col("s") / (F.col("norm") + 1e-8) + own).alias("value"))
