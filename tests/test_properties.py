"""Property tests: Spark expressions against a plain Python statement of
the same rule, on random inputs."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mnemospark.functions import text as X

RESERVED = set(X.RESERVED_NAMES)
BAD = set('<>:"/\\\\|?*')
ALPHABET = st.sampled_from(list("aBc.x 1_-") + ["CON", "com1", "Lpt9", "NUL", "prn"] + list('<>:"/\\\\|?*'))
NAMES = st.lists(ALPHABET, min_size=0, max_size=6).map("".join)


def valid(name: str) -> bool:
    if not name or name.endswith(" ") or name.endswith("."):
        return False
    if os.path.splitext(name)[0].upper() in RESERVED:
        return False
    return not any(c in BAD for c in name)


def forced(name: str, ext: str = ".csv"):
    stem, cur = os.path.splitext(name.strip(" "))
    out = cur if cur.lower() == ext else ext
    return stem + out if valid(stem) else None


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(NAMES, min_size=300, max_size=300))
def test_file_name_rules_match_python(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", X.valid_file_name("n").alias("v"), X.force_extension("n", "csv").alias("f")).collect()
    for r in got:
        assert r.v == valid(r.n), r.n
        assert r.f == forced(r.n), r.n


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["out", "a_b", "x_1_2", "r_2024-01-02"]),
                          st.one_of(st.none(), st.integers(0, 10**6))), min_size=200, max_size=200))
def test_split_number_matches_python(spark, parts):
    import re
    names = [b if n is None else f"{b}_{n}" for b, n in parts]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    base, num = X.split_number("n")
    for r in df.select("n", base.alias("b"), num.alias("k")).collect():
        m = re.search(r"_([0-9]+)$", r.n)
        assert (r.b, r.k) == ((r.n[:m.start()], int(m.group(1))) if m else (r.n, None))


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False, width=64).map(repr),
                                   st.sampled_from(["x", "", "1e-3", "-0", "2."])),
                         max_size=6), min_size=200, max_size=200),
       st.lists(st.sampled_from([",", ", ", " ,", " , "]), min_size=1, max_size=4))
def test_parse_vector_matches_python(spark, vectors, seps):
    from mnemospark.functions import vectors as V

    def py_parse(t):
        inner = t.strip()[1:-1].strip()
        if inner == "":
            return []
        out = []
        for tok in inner.split(","):
            try:
                out.append(float(tok.strip()))
            except ValueError:
                out.append(None)
        return out

    texts = ["[" + seps[i % len(seps)].join(v) + "]" for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", V.parse_vector("t").alias("v")).collect():
        assert r.v == py_parse(r.t), r.t


def test_bm25_matches_brute_force(spark):
    """K7 on the smallest pages table against a plain Python BM25 for
    several random multi-term queries drawn from the corpus."""
    import math
    import random

    import regex

    from mnemospark.operators import keyword as KW
    from mnemospark.sources.tables import table
    from tests.conftest import SF_SMALL

    pages = table(spark, SF_SMALL, "pages")
    docs = {r.page_id: [t for t in regex.split(r"[^\p{L}\p{N}]+", regex.sub(r"<[^>]*>", " ", r.html).lower()) if t]
            for r in pages.collect()}
    n, avgdl = len(docs), sum(len(t) for t in docs.values()) / len(docs)
    vocab = sorted({t for ts in docs.values() for t in ts})
    rnd = random.Random(5)
    for _ in range(4):
        terms = sorted(set(rnd.sample(vocab, 3)))
        df = {t: sum(1 for ts in docs.values() if t in ts) for t in terms}
        scores = {}
        for d, ts in docs.items():
            s = 0.0
            for t in terms:
                tf = ts.count(t)
                if tf:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += idf * tf * (KW.BM25_K1 + 1) / (tf + KW.BM25_K1 * (1 - KW.BM25_B + KW.BM25_B * len(ts) / avgdl))
            if s:
                scores[d] = s
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3]
        got = KW.bm25_top_k(pages, "page_id", "html", " ".join(terms), k=3, html=True).collect()
        assert [r.page_id for r in got] == [d for d, _ in want], terms
        assert all(abs(r.score - s) < 1e-9 for r, (_, s) in zip(got, want))


def test_hash_embed_matches_python(spark):
    import hashlib
    import math
    import re

    from mnemospark.operators import embed as E
    from mnemospark.sources.tables import table
    from tests.conftest import SF_SMALL

    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = {}
    for r in E.hash_weights(docs, "doc_id", "text").collect():
        got.setdefault(r.doc_id, {})[r.bucket] = r.weight
    for r in docs.collect():
        counts = {}
        for tok in re.split(r"[ \t\n\r]+", r.text.lower()):
            if tok:
                b = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % E.HASH_BUCKETS
                counts[b] = counts.get(b, 0) + 1
        norm = math.sqrt(sum(c * c for c in counts.values()))
        want = {b: c / norm for b, c in counts.items()}
        assert got.get(r.doc_id, {}).keys() == want.keys()
        assert all(abs(got[r.doc_id][b] - w) < 1e-12 for b, w in want.items())
