"""Queries that publish folders, sidecars, states and tables, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays, hashing, text
from tessera.operators import cache, corpus, tokens
from tessera.operators.ordering import with_ordinal
from tessera.plans.bookkeeping import DONE, KEYED, _cache, _sentences, _shards
from tessera.plans.corpus import CUT, KEPT, mixed
from tessera.plans.registry import query, table
from tessera.sources import artifacts, commits, files, matrix, readers
from tessera.sources.work import scratch_path, work_table

META = "model string, input_type string, input_total long, embedded long, coverage double, complete boolean, width int"
COVERED = "SELECT 'teacher' AS model, 'passage' AS input_type, t AS input_total, e AS embedded, round_even(e / t, 4) AS coverage, e >= t AS complete, 64 AS width"


def _published(spark: SparkSession, sf: str, sentences: DataFrame, embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    folder = scratch_path(spark, "aligned")
    artifacts.write_aligned(spark, folder, sentences, embedded, model="teacher", input_type="passage")
    return artifacts.read_aligned(spark, folder, META)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("e"))


@query(f"WITH {KEYED}, n AS (SELECT (SELECT count(*) FROM sents) AS t, (SELECT count(*) FROM sents JOIN cache USING (k) JOIN embeddings ON pos = vec_id) AS e) {COVERED} FROM n")
def aligned_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The cached sentences with their vectors, published with a sidecar: what the sidecar says."""
    sentences = _sentences(spark, sf)
    embedded = cache.aligned(sentences, _cache(spark, sf)).join(_vectors(spark, sf), "pos").select("pos", "sentence", "e")
    return _published(spark, sf, sentences, embedded)[1]


@query(f"WITH {DONE}, a AS (SELECT vec_id FROM embeddings JOIN done ON vec_id >= shard_start AND vec_id < shard_end JOIN documents ON doc_id = vec_id) SELECT count(*) AS rows, min(vec_id) AS first, max(vec_id) AS last, count(*) / (SELECT count(*) FROM documents) > 0.99 AS whole FROM a")
def aligned_shards(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the rows of finished shards: what its rows are."""
    sentences = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("sentence"))
    inside = cache.rows_in_shards(_vectors(spark, sf), _shards(spark, sf)[1], 64).select("pos", "e")
    rows, meta = _published(spark, sf, sentences, sentences.join(inside, "pos").select("pos", "sentence", "e"))
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return found.crossJoin(meta.select((F.col("coverage") > 0.99).alias("whole")))


@query(f"WITH {DONE} SELECT r.* FROM r ANTI JOIN done USING (shard_start)")
def shard_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Shards whose folder is not there yet."""
    folder = scratch_path(spark, "store")
    ranges, done = _shards(spark, sf)
    rows = cache.rows_in_shards(_vectors(spark, sf), done, 64)
    rows.select("pos", "shard_start").write.partitionBy("shard_start").parquet(folder)
    return cache.missing_shards(ranges, artifacts.finished_shards(spark, folder))


@query("WITH s AS (SELECT source AS fingerprint, max(doc_id) AS step, sum(n_chars)::BIGINT AS best FROM documents GROUP BY 1) SELECT step, fingerprint, best FROM s WHERE step = (SELECT max(step) FROM s) UNION ALL SELECT step, fingerprint, best FROM s WHERE step = (SELECT min(step) FROM s)")
def folder_states(spark: SparkSession, sf: str) -> DataFrame:
    """A state for each source, as steps of a folder: the newest one, and the one of the least step; a folder
    without a number is none."""
    folder, schema = scratch_path(spark, "states"), "fingerprint string, best long"
    made = table(spark, sf, "documents").groupBy(F.col("source").alias("fingerprint")).agg(F.max("doc_id").alias("step"), F.sum("n_chars").alias("best"))
    steps = made.collect()  # a row a source
    for r in steps:
        artifacts.write_state(spark, folder, r.step, spark.createDataFrame([(r.fingerprint, r.best)], schema))
    artifacts.write_bytes(spark, f"{folder}/best/state.json", b"{}")
    least = min(r.step for r in steps)
    return artifacts.read_state(spark, folder, schema).unionByName(artifacts.read_state(spark, folder, schema, least)).withColumn("step", F.col("step").cast("long"))


@query("SELECT lang AS model, count(*) AS n, round(avg(n_chars), 4) AS score FROM documents GROUP BY 1")
def results_json(spark: SparkSession, sf: str) -> DataFrame:
    """A results file: one JSON object with a list of a report's rows."""
    path = scratch_path(spark, "results") + "/results.json"
    rows = table(spark, sf, "documents").groupBy(F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("score"))
    artifacts.write_json(spark, path, rows.agg(F.collect_list(F.struct("*")).alias("rows")))
    return readers.read_meta(spark, path, "rows array<struct<model string, n long, score double>>").select(F.explode("rows").alias("r")).select("r.*")


@query("SELECT sum(vec_id)::BIGINT AS ids, count(*) AS rows FROM embeddings WHERE label < 5")
def published_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A table published twice, as commits: readers have the second, a third that fails its check leaves it be."""
    log, rows = commits.CommitLog(spark, scratch_path(spark, "published")), table(spark, sf, "embeddings").select("vec_id", "label")
    log.publish(rows, "vectors")
    half = rows.where("label < 5")
    log.publish(half, "vectors", lambda made: made.count() == half.count())
    try:
        log.publish(rows.limit(1), "vectors", lambda made: made.count() > 1)
    except ValueError:
        pass
    return log.read(rows.schema).agg(F.sum("vec_id").alias("ids"), F.count(F.lit(1)).alias("rows"))


@query("SELECT l.lang AS step_lang, count(*) AS docs, sum(d.doc_id)::BIGINT AS ids FROM (SELECT max(lang) AS lang FROM documents) l JOIN documents d USING (lang) GROUP BY 1 UNION ALL SELECT 'card', count(DISTINCT lang), NULL FROM documents")
def committed_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A step for each language, each commit adding its files and deleting the older steps', beside a card that
    stays: what readers have in the end, after a squash."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    log, names = commits.CommitLog(spark, scratch_path(spark, "steps")), sorted(r.lang for r in docs.select("lang").distinct().collect())
    card = docs.select("lang").distinct().select(F.lit(None).cast("long").alias("doc_id"), "lang")
    made = log.add(card, "card")
    log.commit(lambda live: live + made)
    for step, name in enumerate(names):
        log.publish_step(docs.where(F.col("lang") == name), step * 100)
    log.squash()
    live = log.read(docs.schema).withColumn("step_lang", F.when(F.col("doc_id").isNull(), "card").otherwise(F.col("lang")))
    return live.groupBy("step_lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").alias("ids"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def matrix_file(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors as one file, written by tasks and scanned by ranges of bytes."""
    path = scratch_path(spark, "matrix") + "/vectors.npy"
    matrix.write(table(spark, sf, "embeddings"), path, "embedding", "vec_id")
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return matrix.scan(spark, path, 64 << 10).select("pos", F.size("v").alias("width"), F.round(total, 4).alias("total"))


@query("WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings), w AS (SELECT doc_id, (doc_id * 7919) % 1000 AS pos FROM documents) SELECT doc_id, pos, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM w LEFT JOIN e USING (pos)")
def matrix_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a matrix file by number, in the order asked, repeated ones too; null beyond its end."""
    path = scratch_path(spark, "matrix") + "/vectors.npy"
    matrix.write(table(spark, sf, "embeddings"), path, "embedding", "vec_id")
    wanted = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 7919 % 1000).alias("pos"))
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return matrix.take_rows(wanted, path).select("doc_id", "pos", F.round(total, 4).alias("total"))


@query(f"WITH {CUT} SELECT doc_idx, win_idx, array_to_string(ids, ',') AS ids FROM windows WHERE (doc_idx * 31 + win_idx) % 5 = 0")
def record_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Token windows as records of fixed width, every fifth read back by its record number."""
    windows = tokens.byte_windows(corpus.kept_documents(table(spark, sf, "documents")))
    path = scratch_path(spark, "records") + "/windows.npy"
    matrix.write(windows, path, "ids", "doc_idx", "win_idx", dtype="<i4")
    index = with_ordinal(windows.select("doc_idx", "win_idx"), "pos", "doc_idx", "win_idx").where("(doc_idx * 31 + win_idx) % 5 = 0")
    return matrix.take_rows(index, path).select("doc_idx", "win_idx", arrays.joined(F.col("v")).alias("ids"))


@query("SELECT sha256(text) AS sha256 FROM benchmark")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of files, one an item, each read as a stream."""
    made = work_table(files.write_each(table(spark, sf, "benchmark"), scratch_path(spark, "files"), F.col("item_id"), F.col("text")), "file-list")
    return files.digests(made.select("path"), block=4096).select(F.col("digest").alias("sha256"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS size FROM documents")
def document_digests(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each document, digested as a stream."""
    docs = table(spark, sf, "documents")
    made = work_table(files.write_each(docs, scratch_path(spark, "texts"), F.col("doc_id"), F.col("text")), "file-list")
    found = files.digests(made.select("path"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "digest", "size")


@query("SELECT source, substr(sha1('m|passage|full|512|' || chr(0) || source), 1, 16) AS config_key, right(source, 1)::INT % 2 = 0 AS reused FROM (SELECT DISTINCT source FROM documents)")
def config_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A key for each corpus and its settings; shards are reused only where a folder of the key is there."""
    corpora = table(spark, sf, "documents").select("source").distinct()
    runs = corpora.select("source", hashing.config_key(F.col("source"), "m", "passage", None, 512, "").alias("config_key"))
    there = runs.where(F.right("source", F.lit(1)).cast("int") % 2 == 0).select("config_key", F.lit(True).alias("there"))
    return runs.join(there, "config_key", "left").select("source", "config_key", F.coalesce("there", F.lit(False)).alias("reused"))


@query("SELECT CASE WHEN item_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM benchmark GROUP BY 1")
def pinned_task(spark: SparkSession, sf: str) -> DataFrame:
    """A task's splits at one revision; another revision beside it is not read."""
    root, rows = scratch_path(spark, "tasks"), table(spark, sf, "benchmark")
    for revision, part in (("r1", rows), ("r2", rows.limit(0))):
        part.where("item_id % 3 <> 0").write.parquet(f"{root}/items/{revision}/train")
        part.where("item_id % 3 = 0").write.parquet(f"{root}/items/{revision}/test")
    found = artifacts.read_task(spark, root, "items", "r1", ("train", "test"))
    return found.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT 'text' AS column_name, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents")
def picked_column(spark: SparkSession, sf: str) -> DataFrame:
    """The text column of a table whose schema is not known beforehand."""
    rows = table(spark, sf, "documents")
    name = corpus.pick_text_column(rows.schema)
    return rows.agg(F.lit(name).alias("column_name"), F.count(F.lit(1)).alias("n"), F.sum(F.length(name)).alias("chars"))


@query("SELECT count(*) AS n, max(doc_id) AS last FROM (SELECT doc_id FROM documents WHERE length(text) > 200 ORDER BY doc_id LIMIT 700)")
def eager_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The first kept documents taken once, to a work table that later steps read."""
    held = work_table(corpus.long_documents(table(spark, sf, "documents")).orderBy("doc_id").limit(700), "eager")
    return held.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


@query(f"WITH {CUT}, {mixed('doc_idx', 0)}, w AS (SELECT CASE WHEN h < 0.01 THEN 'val' ELSE 'train' END AS side, doc_idx FROM windows JOIN hashed USING (doc_idx)), c AS (SELECT side, count(*) AS windows FROM w GROUP BY 1) SELECT form, side, windows FROM c, unnest(['memory', 'prebuilt']) f(form)")
def loaded_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Training and validation windows, cut in memory and read from a prebuilt folder: the same."""
    kept = corpus.document_split(corpus.kept_documents(table(spark, sf, "documents")), 0.01, 0)
    sides = kept.select("doc_idx", F.when(F.col("is_val"), "val").otherwise("train").alias("side"))
    windows = tokens.byte_windows(kept).join(sides, "doc_idx")
    path = scratch_path(spark, "prebuilt")
    readers.write_windows(windows, path)
    forms = [(F.lit("memory"), windows), (F.lit("prebuilt"), spark.read.parquet(path))]
    parts = [w.groupBy("side").agg(F.count(F.lit(1)).alias("windows")).select(name.alias("form"), "side", "windows") for name, w in forms]
    return parts[0].unionByName(parts[1])


@query(f"WITH {KEPT} SELECT t AS task, m AS model, round(avg(CASE m WHEN 'length' THEN length(text) WHEN 'bytes' THEN strlen(text) ELSE len(string_split(text, ' ')) END), 4) AS score FROM kept, unnest(['length', 'bytes', 'spaces']) a(m), unnest(['all', 'short']) b(t) WHERE t = 'all' OR length(text) < 1000 GROUP BY 1, 2")
def report(spark: SparkSession, sf: str) -> DataFrame:
    """Every baseline on every task, each task's texts made once and kept by (task, number of rows)."""
    rows = corpus.long_documents(table(spark, sf, "documents")).select("text")
    held: dict[tuple[str, int], DataFrame] = {}
    scores = {"length": F.length("text"), "bytes": F.octet_length("text"), "spaces": F.size(F.split("text", " "))}
    parts = []
    for model, score in scores.items():
        for task, part in (("all", rows), ("short", rows.where(F.length("text") < 1000))):
            key = (task, 0)
            if key not in held:
                held[key] = work_table(part, "task")
            parts.append(held[key].agg(F.lit(task).alias("task"), F.lit(model).alias("model"), F.round(F.avg(score), 4).alias("score")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
