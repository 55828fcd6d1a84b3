"""tidewire — a Spark-native engine for news-corpus pipelines.

Every capability is a DataFrame -> DataFrame function: column expressions in
``tidewire.functions``, table operators in ``tidewire.operators``, readers and
sinks in ``tidewire.sources``, the registered query set in ``tidewire.plans``
and Structured Streaming jobs in ``tidewire.streaming``.
"""

from tidewire.session import AS_OF, ensure_checkpoint_dir, get_spark

__all__ = ["AS_OF", "ensure_checkpoint_dir", "get_spark"]
