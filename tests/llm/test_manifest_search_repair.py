"""Manifest, MaxScore search and conversation repair against brute force, on
small tables with null, empty and long values, ties, repeated rows, clashing
column names and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import manifest, maxscore, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, leaf string, _h int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, p):
    out = []
    for level in levels[:-1]:
        a = p // 3 * 3
        out.append((level[a:p], level[p + 1:a + 3]))
        p //= 3
    return out


def _brute_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded, verified)} as a Counter."""
    by = {}
    for r in rows:
        leaf = _h(*[_field(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])
        bad = dict(r)
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
            bad["text"] = r["text"].replace("\n", "")
        given = _h(*[_field(bad[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])
        by.setdefault(r["source"], []).append((r["doc_id"], leaf, given))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, leaves = {}, {}
    for s in sources:
        leaves[s] = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = _tree([x[1] for x in leaves[s]])
    top = _tree([trees[s][-1][0] for s in sources])
    root, out = top[-1][0], Counter()
    for k, s in enumerate(sources):
        for p, (i, leaf, given) in enumerate(leaves[s]):
            path = _siblings(trees[s], p) + _siblings(top, k)
            h = given
            for left, right in path:
                h = _h(*left, h, *right)
            out[i, leaf, trees[s][-1][0], root, _h(*[x for le, ri in path for x in le + ri]), h, h == root] += 1
    return out


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_manifest_equals_brute_force(spark, depth, monkeypatch):
    rng = random.Random(depth)
    rows = []
    for i in range(140):
        source = rng.choice([None, "", "web", "web", "web", "bücher", "zzz", f"s{i % 11}"])
        rows.append((i if rng.random() < 0.95 else None, rng.choice([None, "", "a\nb\n", f"text {i}\n", "x" * 20000 + "\n"]),
                     rng.choice([None, "en"]), source, rng.choice([None, i]), "r", "l", 1))
    rows += rows[:5]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(manifest.manifest, "__defaults__", (*manifest.manifest.__defaults__[:-1], depth))
    got = manifest.verify(df, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", "text").collect()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    want = _brute_manifest([dict(zip(names, r)) for r in rows])
    assert Counter(tuple(r) for r in got) == want
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1, "", "", 0)], DOCS)
    r = manifest.verify(one, ["doc_id", "text"], "source", "doc_id", "text").first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == _h()
    assert manifest.verify(one.limit(0), ["doc_id", "text"], "source", "doc_id", "text").collect() == []


def test_manifest_proof_locates_a_changed_leaf(spark):
    """A path verifies its own leaf only."""
    df = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"),
                                F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = manifest.manifest(df, depth=2)
    right = got.withColumn("f", manifest.fold(F.col("leaf"), F.col("path")))
    wrong = got.withColumn("f", manifest.fold(F.sha2(F.lit("other"), 256), F.col("path")))
    assert right.filter("f = root").count() == 30 and wrong.filter("f = root").count() == 0


def _brute_top(rows, k, scale=1024):
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    out = Counter()
    for a, (i, v) in enumerate(good):
        if i % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(good) if b != a)[:k]
            out.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(found))
    return out


@pytest.mark.parametrize("shard_rows,query_bytes", [(8192, 1 << 23), (7, 300), (64, 2000)])
def test_top_k_equals_brute_force(spark, shard_rows, query_bytes):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(700)]
    hot = rows[100][1]
    rows += [(1000 + i, hot) for i in range(300)]  # ties of a third of the rows
    rows += [(3, None), (None, hot), (5, [None] + hot[1:]), (6, [float("nan")] + hot[1:]), (8, [float("inf")] + hot[1:]),
             (200, rows[200][1]), (9000, hot[:4]), (9100, []), (9200, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("_row", F.lit(1))
    got = maxscore.top_k(df.repartition(3), lambda i: i % 100 == 0, shard_rows=shard_rows, query_bytes=query_bytes)
    assert Counter(tuple(r) for r in got.collect()) == _brute_top(rows, 10)


def test_top_k_prunes_and_stays_exact():
    """Probing must leave rows out, or nothing is saved."""
    rng = np.random.default_rng(5)
    values = np.floor(rng.normal(size=(4000, 64)) * 128).astype(np.int64)
    values[:40] += (values[0] * 3)
    shards = [maxscore.Shard(np.arange(a, a + 500), np.arange(a, a + 500), values[a:a + 500], 64) for a in range(0, 4000, 500)]
    q = maxscore.Query(-1, values[0] * 3, 10)
    seen = []
    add = q.add
    q.add = lambda s, i, r: (seen.append(len(s)), add(s, i, r))
    for s in shards:
        q.search(s, s.floats())
    want = sorted((-int(v @ (values[0] * 3)), i) for i, v in enumerate(values))[:10]
    assert [(-int(s), int(i)) for s, i in zip(q.best[0], q.best[1])] == want
    assert sum(seen[1:]) < 3500 / 2


def test_top_k_beyond_a_double(spark):
    rows = [(0, [2.0 ** 30, 1.0]), (1, [2.0 ** 20, 3.0]), (2, [2.0 ** 20, 5.0]), (3, [-1.0, 0.0]), (4, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in maxscore.top_k(df, lambda i: i == 0, scale=1).orderBy("rank").collect()]
    assert got == [(4, 2 ** 63 - 1), (2, 2 ** 50 + 5), (1, 2 ** 50 + 3), (3, -2 ** 30)]
    assert maxscore.top_k(df.limit(0), lambda i: i == 0).collect() == []


def _damage(rows):
    out = []
    for c, t, r, x in rows:
        sp = lambda v: " " if v is None else str(v)
        how = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        r, x = sp(r), sp(x)
        if how == 0:
            continue
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        out += [(c, t, "user" if how == 4 else r, x)] * (2 if how == 3 else 1)
    return out


def _faults(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault))
    return rows, out


def _by_automaton(rows):
    """Least (cost, audit, lines), over tops that the regular expression allows."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heads = {0: (0, "", ())}

    def insert(heads):
        for _ in range(3):
            for top, (c, a, x) in list(heads.items()):
                for i, role in (("u", "user"), ("a", "assistant")):
                    if (top, i) in step:
                        new, to = (c + 5, a + "I", (*x, f"{role}:")), step[top, i]
                        heads[to] = min(heads.get(to, new), new)
        return heads
    for role, text, fault in rows:
        after = {}
        for top, (c, a, x) in insert(heads).items():
            ways = [(top, (c + 2, a + "D", x))]
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                if (top, role[:1]) in step:
                    ways.append((step[top, role[:1]], (c + extra, a + "K", (*x, f"{role}:{text}"))))
                for i, new in (("u", "user"), ("a", "assistant")):
                    if (top, i) in step:
                        ways.append((step[top, i], (c + extra + 1, a + "R", (*x, f"{new}:{text}"))))
            for to, best in ways:
                after[to] = min(after.get(to, best), best)
        heads = after
    heads = insert(heads)
    return min(heads[t] for t in (0, 3) if t in heads)


def _brute_repair(rows):
    out = {}
    damaged = _damage(rows)
    for c in {r[0] for r in rows}:
        mine, faults = _faults([r for r in damaged if r[0] == c])
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, lines = _by_automaton(faults) if mine else (0, "", ())
        out[c] = ((max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0,
                  *[sum(f[2] == k for f in faults) for k in (1, 2, 3)], sum(p not in ("su", "ua", "au") for p in pairs),
                  cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(60)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]),
                         rng.choice(["Hi.", "Ok!", "done", None, "", " \t", "a\nb?  ", "é.", f"text {t}.", "x" * 5000 + "."])))
    rows += [(99, i % 400, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{i % 50}.", f"u{i}", "same."])) for i in range(500)]
    return rows


@pytest.mark.parametrize("block,fan", [(4096, 16), (7, 2), (50, 3)])
def test_repair_equals_brute_force(spark, block, fan, monkeypatch):
    """Small blocks cut conversations into segments that are parsed apart."""
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = _conversations(block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit(1))
    got = repair.repair_damaged(df.withColumn("_g", F.lit("x"))).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = _brute_repair(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[n] for n in names) == want[r["conv_id"]], r["conv_id"]


def test_parse_is_least_over_all_edits():
    """Every sequence of edits of short conversations, tried one by one."""
    good = re.compile("(s?(ua)+)?")
    for n in range(4):
        for rows in itertools.product([("u", 0), ("a", 0), ("s", 0), ("t", 0), ("u", 2), ("a", 3)], repeat=n):
            best = None
            for gaps in itertools.product(["", "u", "a", "ua"], repeat=n + 1):
                for acts in itertools.product("DKRS", repeat=n):
                    cost, audit, text = 5 * len(gaps[0]), "I" * len(gaps[0]), gaps[0]
                    for (role, fault), act, gap in zip(rows, acts, gaps[1:]):
                        if act != "D" and fault in (1, 2):
                            break
                        cost += {"D": 2, "K": 0}.get(act, 1) + (5 if fault == 3 and act != "D" else 0) + 5 * len(gap)
                        audit += {"S": "R"}.get(act, act) + "I" * len(gap)
                        text += {"D": "", "K": role, "R": "u", "S": "a"}[act] + gap
                    else:
                        if good.fullmatch(text) and (best is None or (cost, audit) < best):
                            best = cost, audit
            heads = repair.parse(list(rows))
            cost, audit = min(heads[t] for t in (0, 3) if t in heads)
            assert (cost, audit.translate(str.maketrans("JS", "IR"))) == best, rows


def test_repaired_rows_read_as_the_grammar(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (2, 0, "user", "only")]
    report, repaired = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    lines = {r["_g"]: r["x"] for r in repaired.groupBy("_g").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("_place", "_lines")))["_lines"]).alias("x")).collect()}
    assert {r["conv_id"]: lines[r["_g"]] for r in report.collect()} == {1: ["system:S.", "user:A.", "assistant:U."], 2: []}
    assert repair.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
