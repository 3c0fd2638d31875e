"""The bounded heap as an aggregate."""

import pyspark
from pyspark.sql import Column

try:
    from pyspark.sql.internal import InternalFunction

    _collect = InternalFunction.collect_top_k
except (ImportError, AttributeError) as e:  # the aggregate behind it is not public in Spark 4.1
    raise ImportError(f"Spark {pyspark.__version__} has no collect_top_k; 4.0 and 4.1 have") from e


def top_values(c: Column, n: int, smallest: bool = True) -> Column:
    """Aggregate: the n smallest (or greatest) values in order. Each group holds a heap of n entries, before and behind the shuffle."""
    return _collect(c, n, smallest)
