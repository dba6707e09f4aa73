"""Size-checked broadcast.

A side is broadcast only after its row count has been measured and found
under a bound; above the bound the caller gets the plain DataFrame and
Spark plans a shuffle join (or the caller processes it in blocks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed bound on rows for broadcasting query sets (a few MB for 1k-dim vectors).
MAX_BROADCAST_ROWS = 20_000


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, int, bool]:
    """Return ``(df_or_hinted, rows, broadcast?)``.  One small action: a
    limited count that stops reading at ``max_rows + 1`` rows."""
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), n, True
    return df, n, False
