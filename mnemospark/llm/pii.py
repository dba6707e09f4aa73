"""Personal data: fixed patterns and information-theoretic sanitisation.

The patterns find protected entities.  Words that share a document with an
entity, wherever they stand, are terms that may give it away.  Over the whole corpus, a term's pointwise mutual
information with an entity says how much of the entity's information the
term carries: ``PMI = ln(N n(c,t) / (n(c) n(t)))`` against
``IC = ln(N / n(c))``, counted in documents.  A term that carries at least
``GENERALISE`` of it becomes a placeholder, at least ``REMOVE`` and it goes.
Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import materialize, row_key, text_or_empty, with_spans

KINDS = ["email", "ip", "card", "phone", "term"]
#: Fixed patterns.  A run is entered at its first character or where the
#: last match ended, which finds the same matches in linear time; a repeated
#: group is possessive, so that its length needs no stack.  In a card number,
#: single separators between digits are read as JOIN.
JOIN = "\x01"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD = rf"[0-9][0-9{JOIN}]*[0-9]"
TERM = r"\p{L}{3,}"
#: Documents that must hold a term and an entity for the pair to be judged.
MIN_DOCUMENTS = 3
GENERALISE, REMOVE = 0.8, 0.95


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(
        (F.length(digits) - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _as_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["at"].alias("start"), (s["at"] + F.length(s["text"])).alias("end"),
        F.replace(s["text"], F.lit(JOIN), F.lit(" ")).alias("text")))


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_base``: structs ``(kind, start, end, text)`` by kind,
    then start; ``kind`` is the place in ``KINDS``."""
    joined = F.regexp_replace(F.translate(text, JOIN, " "), r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)
    found = with_spans(docs, text, PATTERNS)
    # Matches shorter than 13 characters never count, and cost much to list.
    has_card = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
    found = found.withColumn("_joined", F.when(has_card, joined).otherwise(""))
    found = with_spans(found, F.col("_joined"), {"card": CARD})
    part = lambda s, i: F.regexp_replace(F.split_part(s, F.lit("."), F.lit(i)), "^0+(?=[0-9])", "")
    small = lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255)
    length = lambda s, a, b: F.length(_digits(s["text"])).between(a, b)
    good = {
        "email": F.col("email"),
        "ip": F.filter("ip", lambda s: small(part(s["text"], 1)) & small(part(s["text"], 2))
                       & small(part(s["text"], 3)) & small(part(s["text"], 4))),
        "card": F.filter("card", lambda s: F.when(length(s, 13, 19), _luhn(_digits(s["text"]))).otherwise(False)),
        "phone": F.filter("phone", lambda s: length(s, 9, 15)),
    }
    spans = F.concat(*[_as_kind(good[k], i) for i, k in enumerate(KINDS[:4])])
    return found.withColumn("_base", F.array_sort(spans)).drop(*PATTERNS, "card", "_joined")


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table with a row for each document: its key ``_k1, _k2``, ``_id``,
    ``_base`` and, where there are spans, the text (``_t``)."""
    text = text_or_empty(text_col)
    rows = base_spans(docs.select(F.col(id_col).alias("_id"), text.alias("_t"), *row_key(id_col, text_col)),
                      F.col("_t"))
    return materialize(rows.withColumn("_t", F.when(F.size("_base") > 0, F.col("_t"))), "pii-entities")


def holders(found: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with an entity that ``min_documents`` documents hold:
    key, ``_t`` and ``_classes``, structs ``(n_c, c1, c2)``.  Entities of the
    same documents are one class, named by 128 bits over the documents'
    keys: each term has the same count with all of them."""
    held = (found.select("_k1", "_k2", F.explode("_base").alias("b"))
            .select("_k1", "_k2", F.concat_ws(":", "b.kind", F.lower("b.text")).alias("entity")).distinct())
    name = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "_k1", "_k2"))
    of_entity = (held.groupBy("entity").agg(F.count("*").alias("n_c"), name(1).alias("c1"), name(2).alias("c2"))
                 .filter(F.col("n_c") >= min_documents))
    classes = (held.join(of_entity, "entity").groupBy("_k1", "_k2")
               .agg(F.collect_set(F.struct("n_c", "c1", "c2")).alias("_classes")))
    texts = found.filter(F.size("_base") > 0).select("_k1", "_k2", "_t").dropDuplicates(["_k1", "_k2"])
    return materialize(texts.join(classes, ["_k1", "_k2"]), "pii-holders")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def disclosure(docs: DataFrame, found: DataFrame, held: DataFrame, text_col: str = "text",
               min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``n_c, c1, c2, term, share``: the part of the information of a class's
    entities that the term carries, for pairs that share ``min_documents``
    documents, wherever they stand in them."""
    total = found.count()
    # The outer form keeps Spark from computing the words once more in a filter.
    together = (held.select("_classes", _terms(F.col("_t")).alias("w"))
                .select(F.explode_outer("_classes").alias("c"), "w").select("c.*", F.explode_outer("w").alias("term"))
                .filter("term is not null").groupBy("n_c", "c1", "c2", "term")
                .agg(F.count("*").alias("n_ct")).filter(F.col("n_ct") >= min_documents))
    of_term = (docs.select(F.explode_outer(_terms(text_or_empty(text_col))).alias("term")).filter("term is not null")
               .groupBy("term").agg(F.count("*").alias("n_t")))
    n = F.lit(float(max(total, 1)))
    pmi = F.log(n * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    ic = F.log(n / F.col("n_c"))
    return together.join(of_term, "term").select(
        "n_c", "c1", "c2", "term", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0)).alias("share"))


def places(held: DataFrame, marks: DataFrame) -> DataFrame:
    """``_k1, _k2, start, end, share`` for every whole word of a document
    that is one of its terms in ``marks``."""
    texts = held.join(marks.select("_k1", "_k2").distinct(), ["_k1", "_k2"])
    cut = texts.select("_k1", "_k2", F.regexp_extract_all("_t", F.lit(TERM), F.lit(0)).alias("hits"),
                       F.transform(F.split("_t", TERM, -1), F.length).alias("gaps"))
    pairs = F.zip_with(F.slice("gaps", F.lit(1), F.size("hits")), F.col("hits"),
                       lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    # A window and no fold over the array, whose time grows with the square.
    before = Window.partitionBy("_k1", "_k2").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = (cut.select("_k1", "_k2", F.posexplode(pairs).alias("i", "w"))
             .select("_k1", "_k2", F.lower("w.hit").alias("term"), F.length("w.hit").alias("n"),
                     F.sum(F.col("w.gap") + F.length("w.hit")).over(before).cast("int").alias("end")))
    return words.join(marks, ["_k1", "_k2", "term"]).select(
        "_k1", "_k2", (F.col("end") - F.col("n")).alias("start"), "end", "share")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE,
         remove: float = REMOVE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row for each row of ``docs``: id, key ``_k1, _k2`` and
    ``pii_spans``, structs ``(kind, start, end, text)`` by kind, then start.

    Kinds 0 to 3 are the patterns' spans; kind 4 are disclosing terms, with
    the text put in their place, at each place of a document that holds the
    entity; words inside or touching a pattern's span are no terms.
    Positions count code points, ends are exclusive.  Null and empty texts
    have no spans.  Rows that repeat id and text count as one document and
    share the spans.  Columns other than the id are left out, so their names
    cannot clash.
    """
    found = entities(docs, id_col, text_col)
    held = holders(found, min_documents)
    shares = (disclosure(docs, found, held, text_col, min_documents).filter(F.col("share") >= generalise)
              .groupBy("n_c", "c1", "c2").agg(F.collect_list(F.struct("term", "share")).alias("x")))
    marks = (held.select("_k1", "_k2", F.explode("_classes").alias("c")).select("_k1", "_k2", "c.*")
             .join(shares, ["n_c", "c1", "c2"]).select("_k1", "_k2", F.explode("x").alias("x"))
             .groupBy("_k1", "_k2", F.col("x.term").alias("term")).agg(F.max("x.share").alias("share")))
    marks = materialize(marks, "pii-terms")
    mark = F.when(F.col("share") >= remove, F.lit("")).otherwise(F.lit("[TERM]"))
    terms = places(held, marks).groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct(
        F.lit(4).alias("kind"), "start", "end", mark.alias("text")))).alias("_terms"))
    apart = F.filter("_terms", lambda t: ~F.exists("_base", lambda b: (b["start"] <= t["end"]) & (t["start"] <= b["end"])))
    spans = F.when(F.col("_terms").isNull(), F.col("_base")).otherwise(F.concat("_base", apart))
    return found.drop("_t").join(terms, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(id_col), "_k1", "_k2", spans.alias("pii_spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``clean_text``: spans of the patterns become the kind in
    brackets, disclosing terms are generalised or removed.  Overlapping
    spans are replaced together, by the first of them."""
    found = find(docs, id_col, text_col, **options).filter(F.size("pii_spans") > 0).dropDuplicates(["_k1", "_k2"])
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("pii_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["kind"] == 4, s["text"]).otherwise(F.element_at(marks, s["kind"] + 1)).alias("mark"))))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        F.when(s["start"] >= acc["at"], F.concat(
            acc["out"], F.substr(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), s["mark"]))
        .otherwise(acc["out"]).alias("out"), s["end"].alias("at")))
    clean = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                        lambda a: F.concat(a["out"], F.substr(F.col(text_col), a["at"] + 1, F.length(text_col))))
    narrow = found.select("_k1", "_k2", ordered.alias("_spans"))
    return (docs.select("*", *row_key(id_col, text_col)).join(narrow, ["_k1", "_k2"], "left")
            .withColumn("clean_text", F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(clean))
            .drop("_k1", "_k2", "_spans"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
