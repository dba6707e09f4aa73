"""Conversation state, prompt assembly, pages, embedding."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import conversation as C
from mnemospark.operators import embed as E
from mnemospark.operators import pages as PG
from mnemospark.sources.tables import table
from tests.conftest import SF_MID, SF_SMALL


def test_upsert_replaces_in_place(spark):
    st = spark.createDataFrame([(1, 1, 1, "user", "a"), (1, 2, 2, "assistant", "b"), (1, 2, 9, "assistant", "b2"),
                                (1, 3, 3, "user", "c")], "thread_id long, msg_id long, seq long, role string, text string")
    up = C.upsert(st)
    h = C.history_text(up).first()
    assert h.history == "user: a\nassistant: b2\nuser: c"


def test_history_blocks_keep_order(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    c = C.from_turns(table(spark, SF_SMALL, "conversations"))
    got = {r.thread_id: r.history for r in C.history_text(c).collect()}
    rows = c.orderBy("thread_id", "seq").collect()
    want = {}
    for r in rows:
        want.setdefault(r.thread_id, []).append(f"{r.role}: {r.text or ''}")
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_prompt(spark):
    st = spark.createDataFrame([(1, 1, 1, "user", "a")], "thread_id long, msg_id long, seq long, role string, text string")
    assert C.prompt(st, "S").first().prompt == "system: S\nuser: a"


def test_pages_properties(spark):
    d = table(spark, SF_MID, "documents")
    pg = PG.pages(d, "doc_id", "text")
    assert pg.filter(F.length("text") > PG.PAGE_WIDTH).count() == 0
    sample = {r.doc_id: r.text for r in d.orderBy(F.length("text").desc()).limit(5).collect()}
    got = {}
    for r in pg.filter(F.col("doc_id").isin(list(sample))).orderBy("doc_id", "page").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for doc_id, text in sample.items():
        assert got[doc_id] == textwrap.TextWrapper(width=PG.PAGE_WIDTH, break_long_words=True,
                                                   break_on_hyphens=True).wrap(text)
        # no character is lost: only whitespace at page breaks goes away
        assert "".join("".join(got[doc_id]).split()) == "".join(text.split())
    short = d.filter(F.length("text") <= PG.PAGE_WIDTH).select("doc_id", "text").limit(3).collect()
    for r in short:
        assert pg.filter(F.col("doc_id") == r.doc_id).first().text == r.text


@pytest.mark.parametrize("width", [5, 7, 12])
def test_pages_equal_textwrap(spark, width):
    rng = random.Random(width)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))).lstrip()
             for letters in ("ab  -", "a b-", "ab1-. ", "abcdef\t\n -", "a-", "  aé-\r\x0b", "  a𝒳é", "a--b -!", "abcdefghijk- 12")
             for _ in range(300)] + ["", None]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select(
        "t", PG.wrapped(F.col("t"), width).alias("p")).collect()
    wrapper = textwrap.TextWrapper(width=width, break_long_words=True, break_on_hyphens=True)
    for r in got:
        assert r.p == (None if r.t is None else [r.t] if len(r.t) <= width else wrapper.wrap(r.t)), r.t


def test_pages_run_without_python(spark):
    plan = PG.pages(table(spark, SF_SMALL, "documents"), "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_hash_embed_unit_norm(spark):
    d = table(spark, SF_SMALL, "documents")
    e = E.hash_embed(d, "doc_id", "text")
    norms = e.select(F.aggregate("embedding", F.lit(0.0).cast("double"),
                                 lambda a, x: a + x.cast("double") * x.cast("double")).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0, abs=1e-5) for r in norms)
    assert len(e.first().embedding) == E.HASH_BUCKETS


def test_model_embed_runs_model_once_per_worker(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    out = E.model_embed(df, "t", load, dim=2).collect()
    assert out[0].embedding == pytest.approx([0.894427, 0.447214], abs=1e-5)


def test_pages_fixture_counts(spark):
    """FIXTURES.md section 6: sf0.01 documents give 1,795 pages, the longest
    1,900 characters, every one of the 1,000 documents present."""
    pg = PG.pages(table(spark, SF_MID, "documents"), "doc_id", "text")
    r = pg.agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"),
               F.countDistinct("doc_id").alias("docs")).first()
    assert (r.n, r.longest, r.docs) == (1795, 1900, 1000)
