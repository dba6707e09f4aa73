"""Secret scan: fixed patterns and character Markov models.

Two first-order character models are trained from labelled samples: strings
that the patterns found (secrets) and ordinary identifiers.  A run of
identifier characters is a secret if the log-likelihood ratio of the two
models, summed over its transitions, is high enough.  Everything here is
DataFrame operations.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_or_empty, with_spans

#: Fixed patterns.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = ASSIGN.replace("((?i)", "((?i:").replace("key)", "key))", 1)
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
#: A run is a secret from this ratio on, in all and for each transition.
LEAST_TOTAL, LEAST_MEAN = math.log(1e6), 0.5


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_base``: structs ``(start, kind, end, text)`` by start,
    then kind; ``kind`` is the place in ``KINDS``."""
    found = with_spans(docs, text, PATTERNS)
    good = F.filter("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 8)
    as_kind = lambda spans, k: F.transform(spans, lambda s: F.struct(
        s["at"].alias("start"), F.lit(k).alias("kind"), (s["at"] + F.length(s["text"])).alias("end"),
        s["text"].alias("text")))
    spans = F.concat(as_kind(good, 0), as_kind(F.col("access"), 1), as_kind(F.col("hex"), 2))
    return found.withColumn("_base", F.array_sort(spans)).drop(*PATTERNS)


def samples(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Labelled strings ``s, secret`` from all documents, each string of a
    class once: values the patterns found, and other runs of four and more
    letters, digits and underscores.  Copies of a text add nothing, so its
    id does not matter."""
    chosen = docs.select(text.alias("_t")).filter(F.length("_t") > 0)
    other = F.regexp_replace("_t", "|".join(f"(?:{p})" for p in PATTERNS.values()), " ")
    runs = F.array_distinct(F.regexp_extract_all(other, F.lit(r"[A-Za-z0-9_]{4,}"), F.lit(0)))
    # The outer form keeps Spark from computing the runs once more in a filter.
    quiet = chosen.select(F.explode_outer(runs).alias("s")).filter("s is not null").distinct()
    hits = base_spans(chosen.filter(F.col("_t").rlike("|".join(f"(?:{p})" for p in PATTERNS.values()))), F.col("_t"))
    value = F.when(F.col("x.kind") == 0, F.regexp_extract("x.text", ASSIGN, 2)).otherwise(F.col("x.text"))
    loud = hits.select(F.explode("_base").alias("x")).select(value.alias("s")).distinct()
    return quiet.withColumn("secret", F.lit(0)).unionByName(loud.withColumn("secret", F.lit(1)))


def train(samples: DataFrame, smoothing: float = 0.5, backoff: float = 5.0) -> list[float]:
    """Log-likelihood ratios (secret over ordinary) of each pair of
    characters of ``ALPHABET``, row by row.  Rare pairs lean on the second
    character's own share; no samples give zeros.  Only the counts of pairs come to the driver."""
    n = len(ALPHABET)
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = (samples.filter(F.length("s") > 1)
             .select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1),
                                                     lambda i: F.substr(F.col("s"), i, F.lit(2)))).alias("p"))
             .groupBy("secret", "p").count()
             .select("secret", place(F.substring("p", 1, 1)).alias("a"), place(F.substring("p", 2, 1)).alias("b"), "count")
             .filter("a >= 0 and b >= 0").collect())
    seen = {(r["secret"], r["a"], r["b"]): r["count"] for r in pairs}
    rows: dict[tuple[int, int], int] = {}
    single: dict[tuple[int, int], int] = {}
    for (k, a, b), c in seen.items():
        rows[k, a] = rows.get((k, a), 0) + c
        single[k, b] = single.get((k, b), 0) + c
    total = {k: sum(single.get((k, b), 0) for b in range(n)) for k in (0, 1)}

    def log_p(k: int, a: int, b: int) -> float:
        alone = (single.get((k, b), 0) + smoothing) / (total[k] + smoothing * n)
        return math.log((seen.get((k, a, b), 0) + backoff * alone) / (rows.get((k, a), 0) + backoff))
    return [log_p(1, a, b) - log_p(0, a, b) for a in range(n) for b in range(n)]


def ratio(text: Column, table: list[float]) -> Column:
    """Sum of the log-likelihood ratios over the transitions of ``text``."""
    n = len(ALPHABET)
    known = F.from_json(F.lit(json.dumps(table)), "array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substr(text, i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(text) - 1), F.lit(0.0),
                       lambda acc, i: acc + F.element_at(known, (place(i) - 1) * n + place(i + 1)))


def scan(docs: DataFrame, table: list[float], text_col: str = "text", least_total: float = LEAST_TOTAL,
         least_mean: float = LEAST_MEAN) -> DataFrame:
    """``docs`` with ``secret_spans``: structs ``(start, kind, end, text)``
    by start, then kind.  Pattern spans are always there; runs by the models
    (kind 3) are added where they touch no pattern span.  Positions count
    code points, ends are exclusive.  Null and empty texts have no spans, a
    very long text is scanned whole in time that grows with its matches;
    spans that start together go by kind; repeated rows are scanned each.
    All rows and columns stay, whatever their names, but for one named
    ``secret_spans``, which is replaced."""
    columns = [c for c in docs.columns if c != "secret_spans"]
    packed = docs.select(F.struct(*[F.col(c) for c in columns]).alias("_row"), text_or_empty(text_col).alias("_t"))
    text = F.col("_t")
    found = with_spans(base_spans(packed, text), text, {"_run": RUN})
    # A run of digits and signs is a number, which neither model describes.
    found = found.withColumn("_run", F.filter("_run", lambda s: s["text"].rlike("[A-Za-z]")))
    scored = F.transform("_run", lambda s: F.struct(
        s["at"].alias("start"), F.lit(3).alias("kind"), (s["at"] + F.length(s["text"])).alias("end"),
        s["text"].alias("text"), ratio(s["text"], table).alias("r")))
    found = found.withColumn("_scored", F.when(F.size("_run") > 0, scored))
    high = F.filter("_scored", lambda s: (s["r"] >= least_total) & (s["r"] >= least_mean * (s["end"] - s["start"] - 1))
                    & ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    plain = F.transform(high, lambda s: F.struct(s["start"], s["kind"], s["end"], s["text"]))
    spans = F.when(F.size(F.coalesce(F.col("_scored"), F.array())) > 0,
                   F.array_sort(F.concat("_base", plain))).otherwise(F.col("_base"))
    done = found.withColumn("_spans", spans)
    return done.select(*[F.col("_row")[c].alias(c) for c in columns], F.col("_spans").alias("secret_spans"))


def redact(spans: str = "secret_spans", text_col: str = "text", mark: str = "[SECRET]") -> Column:
    """The text with the spans replaced by ``mark``; spans that overlap are
    replaced together."""
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.when(s["start"] >= acc["at"], F.concat(
            acc["out"], F.substr(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        .otherwise(acc["out"]).alias("out"), s["end"].alias("at")))
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                       lambda a: F.concat(a["out"], F.substr(F.col(text_col), a["at"] + 1, F.length(text_col))))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
