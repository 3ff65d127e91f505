"""Periodic runs, source divergence and learned partitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelq.llm import learned_partitions, periodic_runs, source_divergence


def brute_runs(w, least=24, periods=3):
    found = []
    for q in range(1, len(w) // periods + 1):
        t = 0
        while t < len(w) - q:
            s = t
            while t < len(w) - q and w[t] == w[t + q]:
                t += 1
            n = t - s + q
            if t > s and n >= max(least, periods * q) and not any(all(w[x] == w[x + p] for x in range(s, s + n - p)) for p in range(1, q)):
                found.append((s, n, q))
            t += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rng = random.Random(5)
    some = 0
    for _ in range(600):
        n, v = rng.randrange(200), rng.choice([1, 2, 3, 5, 40])
        w = [b"%d" % rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            a, p = rng.randrange(n), rng.randint(1, 40)
            for i in range(a, min(n, a + rng.randint(1, 140))):
                w[i] = w[a + (i - a) % p]
        got = periodic_runs.text_runs(w)
        assert got == brute_runs(w)
        some += len(got)
    assert some > 100


def planted(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_of_periodic_runs(spark, documents, some_texts):
    rows = [r[:2] for r in some_texts] + [(70_000 + i, " ".join(f"w{j % 7}" for j in range(i))) for i in range(0, 90, 3)]
    found = periodic_runs.periodic_runs(periodic_runs.with_repeats(documents(rows)))
    got = Counter()
    for r in found.withColumn("best", periodic_runs.strongest(F.col("runs"))).withColumn("lines", periodic_runs.run_lines(F.col("runs"))).collect():
        got[(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.best and tuple(r.best), r.lines, r.collapsed)] += 1
    want = Counter()
    for i, t in rows:
        w = planted(i, t)
        runs = brute_runs(w) if len(w) < 3000 else periodic_runs.text_runs([x.encode() for x in w])
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        want[(i, len(w), tuple(runs), best, "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert got == want and sum(bool(k[2]) for k in want) > 10
    assert periodic_runs.periodic_runs(documents([])).count() == 0


def test_digests_of_periodic_runs(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, ""), (3, "a " * 40), (4, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got[1].n_runs == 0 and got[1].start is None and got[1].runs_sha256 == none and got[1].collapsed_sha256 == none and got[None].n_runs == 0
    assert tuple(got[3])[1:6] == (1, 0, 40, 1, 40_000) and got[3].collapsed_sha256 == hashlib.sha256(b"a").hexdigest()
    assert got[3].runs_sha256 == hashlib.sha256(b"0,40,1\n").hexdigest()


def brute_divergence(rows, least, ranks):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in docs[lang].items() if c >= least]
        mine = sorted(g[1] for g in groups if g[0] == lang)

        def chances(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = chances(sum((n[lang, s] for s in mine), Counter()))
        p = {s: chances(n[lang, s]) for s in mine}
        for s in mine:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            terms = sorted((-(p[s][t] - whole[t]), t.encode()) for t in kept if n[lang, s][t] > 0 and p[s][t] > whole[t])
            for part, found in (("pair", pairs), ("term", terms[:ranks])):
                out |= {(lang, s, part, item.decode(), -value, r + 1) for r, (value, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("block,sources,terms", [(1 << 20, 256, 8192), (300, 2, 3)])
def test_divergence_matches_brute_force(spark, block, sources, terms):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5)] + ["The", "the,", "THE", "(the)", "Ünï", "don't", "x1y", " nb", "中文", "!?", "rare-a", "Rare_b"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None, "s4"]), rng.choice([None, ""]) if i % 9 == 0 else " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(150)]
    rows += [("fr", "alone", "! 1"), ("it", "a", None), ("it", "b", "9"), rows[1], ("en", "s1", "the " * 3000)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    got = source_divergence.divergence(df, 7, 4, block, terms, sources).collect()
    want = brute_divergence([tuple(x or "" for x in r) for r in rows], 7, 4)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ("it", "a", "pair", "b", 0, 1) in want
    assert source_divergence.divergence(df.limit(0)).count() == 0


def brute_nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        score = learned_partitions.products(np.repeat(x[ids == q], len(x), axis=0), x)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(score[i])) for i in order]
    return out


@pytest.mark.parametrize("clustered", [True, False])
def test_partitions_find_nearest_vectors(spark, clustered):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * (3 if clustered else 0)
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32).astype(float)
    x[:300] = x[0]  # copies
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)], "id long, vector array<double>, home string")
    got = learned_partitions.nearest(df, df.where("id % 20 = 0"), block_bytes=16 * 8 * 50).collect()
    want = brute_nearest(ids, x, range(0, 4000, 20), 20)
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r.rank] = (r.id, r.score)
    assert all(sorted(f) == list(range(1, 21)) for f in found.values()) and set(found) == set(want)
    for q, f in found.items():
        listed = [f[r] for r in range(1, 21)]
        assert listed == sorted(listed, key=lambda v: (-v[1], v[0])) and q not in {i for i, _ in listed}
        assert all(s == float(learned_partitions.products(x[[q]], x[[i]])[0]) for i, s in listed)
    hits = sum(s >= want[q][-1][1] for q, f in found.items() for _, s in f.values())
    assert hits / (20 * len(want)) >= 0.9


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = learned_partitions.op13_learned_partitions(spark, "/root/testdata/sf0.1").collect()
    assert sum((r.vec_id, r.score) in want[r.query_id] for r in got) / sum(map(len, want.values())) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [-1.0, 0.0]), (9, [1.0]), (None, [3.0, 0.0]), (20, [2.0, 0.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "b") for r in rows], "id long, vector array<double>, block string")
    got = learned_partitions.nearest(df, df.where("id % 20 = 0"), k=20)
    found = sorted(tuple(r) for r in got.collect())
    assert found == [(0, 1, 1, 2.0), (0, 2, 20, 2.0), (0, 3, 7, 1.0), (0, 4, 8, -1.0), (20, 1, 1, 4.0), (20, 2, 0, 2.0), (20, 3, 7, 2.0), (20, 4, 8, -2.0)]
    assert learned_partitions.nearest(df.limit(0), df.limit(0)).count() == 0 and learned_partitions.nearest(df, df.where("id = 2")).count() == 0
