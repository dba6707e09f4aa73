"""mnemospark: message memory on Spark.

Batch and streaming jobs that take in chat messages, check them against
the store's keys, keep them in time-partitioned tables and retrieve them
by vector distance, metadata, time and keyword.
"""

__version__ = "0.1.0"
