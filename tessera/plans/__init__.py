"""All named queries over the reference tables."""

from tessera.plans import artifacts, bookkeeping, corpus, evaluation, sources, streams, training, vectors
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "artifacts", "bookkeeping", "corpus", "evaluation", "sources", "streams", "training", "vectors"]
