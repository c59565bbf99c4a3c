"""Page retrieval on Spark: ingest, pooling, exact cosine top-k, answers; and operators for training-data pipelines."""

from folioscan.engine import RetrievalEngine, create_engine

__all__ = ["RetrievalEngine", "create_engine"]
__version__ = "0.1.0"
