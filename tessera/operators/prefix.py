"""The first rows of a sorted corpus without reading the rest: a prefix that grows by row groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.operators.ordering import with_ordinal
from tessera.sources import store
from tessera.sources.work import work_table


def row_groups(docs: DataFrame, key: str) -> DataFrame:
    """(least, most, rows) of every row group of the table's Parquet files, from their footers, read by
    tasks. Groups without statistics of the key have null bounds."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            out: list[tuple] = []
            for path in batch.column(0).to_pylist():
                with store.open_input(path) as file:
                    meta = pq.ParquetFile(file).metadata
                    at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == key)
                    for g in range(meta.num_row_groups):
                        found = meta.row_group(g).column(at).statistics
                        bounds = (found.min, found.max) if found is not None and found.has_min_max else (None, None)
                        out.append((*bounds, meta.row_group(g).num_rows))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["least", "most", "rows"])

    files = spark.createDataFrame([(f,) for f in sorted(docs.inputFiles())], "path string")
    return files.repartition("path").mapInArrow(run, "least long, most long, rows long")


def prefix(docs: DataFrame, key: str, enough: Callable[[DataFrame], bool], rows: int) -> DataFrame:
    """docs up to a key, so many that `enough` holds, or all; null keys, which come first, are among
    them. The first try takes the row groups that begin with the least keys, `rows` rows of them, each
    further one four times as many; the scan's filter then skips the other groups. Of a table that is
    not sorted by the key more is read, and the same comes out."""
    groups = work_table(row_groups(docs, key), "row-groups")
    if groups.where("least is null or most is null").limit(1).count():
        return docs
    while True:
        # the key at which the groups that begin before it hold the wanted number of rows
        ends = with_ordinal(groups.select("least", "most", "rows"), "at", "least", "most", "rows")
        few = ends.where("at < 10000").orderBy("at").select("most", "rows").collect()
        taken, bound = 0, None
        for r in few:
            taken, bound = taken + r["rows"], r.most if bound is None else max(bound, r.most)
            if taken >= rows:
                break
        if bound is None or taken < rows:
            return docs  # no more than what is looked at, or so much that nothing is saved
        part = docs.where(F.col(key).isNull() | (F.col(key) <= F.lit(bound)))
        if enough(part):
            return part
        rows *= 4


def first_kept(docs: DataFrame, n: int, least: int = corpus.MIN_CHARS) -> DataFrame:
    """(doc_idx, doc_id, text) of the first n long documents."""
    some = prefix(docs, "doc_id", lambda part: corpus.long_documents(part, least).limit(n).count() == n, 2 * n)
    first = corpus.long_documents(some, least).orderBy("doc_id").limit(n)
    return with_ordinal(first.select("doc_id", "text"), "doc_idx", "doc_id")


def first_sentences(docs: DataFrame, n: int) -> DataFrame:
    """(pos, doc_id, sentence): the first n distinct sentences in reading order. A sentence's first place
    is in the prefix if the sentence is, so the prefix's distinct ones are the corpus's."""

    def enough(part: DataFrame) -> bool:
        return corpus.sentences(part).select("sentence").distinct().limit(n).count() == n

    return corpus.first_distinct(corpus.sentences(prefix(docs, "doc_id", enough, max(1, n // 2))), n)
