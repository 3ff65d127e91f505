"""Personal data, decontamination, mixing, Hamming search and language identification."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from labelq.llm import decontaminate, hamming_search, language_id, mixing, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_personal(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                double = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return sorted(out)


def test_personal_data_matches_the_patterns(spark, documents, some_texts):
    rng = random.Random(1)
    noise = ["".join(rng.choice("0123456789 .-+@ab()%_é") for _ in range(200)) for _ in range(300)]
    known = ["mail a@b@c.de, x@y.z@q.r 4111 1111 1111 1111 +49 (30) 1234-5678 10.0.0.255 1.2.3.4.5 300.1.1.1 see https://ab.example.org/x?y, IBAN DE89 3704 0044 0532 0130 00 end"]
    rows = [r[:2] for r in some_texts] + [(100_000 + i, t) for i, t in enumerate(noise + known)]
    got = personal_data.personal_data(documents(rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        found = brute_personal(t)
        shown = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
        n = Counter(k for *_, k in found)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(shown.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    last = next(r.spans for r in got if r.doc_id == 100_300)
    assert "url:" in last and "account:" in last
    masked = {r.doc_id: r.text for r in personal_data.masked(documents(rows, clash=False)).collect()}
    assert "<email>" in masked[100_300] and "4111" not in masked[100_300] and masked[9001] is None
    assert personal_data.personal_data(documents([])).count() == 0


def test_long_digit_runs_take_linear_time():
    assert personal_data.spans("1" * 200_000 + "." + "2" * 1000, personal_data.automaton()) == []


def test_containment_matches_brute_force(spark, documents, some_texts):
    items = [(i, " ".join(t.split()[3:40])) for i, t, *_ in some_texts[:60] if t] + [(900, None), (901, ""), (902, "too short"), (900, None), (903, "Xyzzy"), (904, "these four words too"), (905, "never there")]
    edited = [(80_000 + n, "Before it " + t.upper() + " and after") for n, (_, t) in enumerate(items[:10])]
    cut = [(81_000 + n, "x " + " ".join(t.split()[:-6]) + " y") for n, (_, t) in enumerate(items[:20])]
    short = [(82_000, "it is Too Short"), (82_001, "xyzzy"), (82_002, "of these four words too many; too  short"), (82_003, "these four words")]
    rows = [r[:2] for r in some_texts] + edited + cut + short
    found = decontaminate.contained(documents(rows), spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))).collect()

    def grams(text, item):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        k = min(5, len(w)) if item else 5
        return {tuple(w[i:i + n]) for n in ([k] if item else range(1, 6)) for i in range(len(w) - n + 1) if n}

    sets = {i: grams(t, True) for i, t in items}
    want = set()
    for i, t in rows:
        own = grams(t, False)
        want |= {(i, j, len(own & s), len(s)) for j, s in sets.items() if s and 100 * len(own & s) >= 80 * len(s)}
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found} == want
    assert {(82_000, 902), (82_001, 903), (82_002, 904), (82_002, 902)} <= {(r.doc_id, r.item_id) for r in found}
    assert len(found) == len({(r.doc_id, r._text_hash, r.item_id) for r in found})
    left = decontaminate.without_leaks(documents(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, *_ in want}


def brute_mix(sizes):
    """Targets by handing out the excess again and again."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix_reaches_its_targets(spark, documents, some_texts):
    rows = [(i, t, s) for i, t, s in some_texts] + [(50_000 + i, "word " * (i % 30), "hot") for i in range(900)]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    target, taken = brute_mix(sizes), defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
        if r.size:
            assert r.taken // r.size >= target[r.source] // sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 or Counter(rows)[max(rows, key=lambda r: Counter(rows)[r])] > 1 and abs(taken[s] - target[s]) <= 2 * largest[s]
    again = mixing.mix(documents(rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(documents([])).count() == 0


def test_better_documents_come_first(spark, documents):
    rows = [(i, "a b c d e f g h", "s" if i < 600 else "t") for i in range(1200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, quality int")
    docs = documents(rows)
    got = mixing.repeated(docs, labels)
    assert got.columns == docs.columns
    times = Counter(r.doc_id for r in got.collect())
    fewer = Counter(i % 2 for i in range(600, 1200) if times[i])
    assert fewer[1] > 1.5 * fewer[0] > 0


def test_no_python_in_native_operators(spark, documents, some_texts):
    rows = documents(some_texts)
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for df in (mixing.mix(rows), decontaminate.contained(rows, items), mixing.repeated(rows), decontaminate.without_leaks(rows, items)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_hamming_search_is_exact(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(5)]
    codes = [rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) & (2**64 - 1) for _ in range(400)] + [centres[0]] * 60
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = [(i, c) for i, c in enumerate(signed)] + [(3, signed[3]), (None, 5), (700, None)]
    data = spark.createDataFrame(rows, "id long, code long").withColumn("n", F.lit("clash"))
    ask = [(10_000 + i, c) for i, c in enumerate(signed[::40])] + [(20_000, 0), (20_001, -1)]
    got = defaultdict(list)
    for r in hamming_search.nearest(data, spark.createDataFrame(ask, "id long, code long")).collect():
        got[r.query_id].append((r.rank, r.distance, r.id))
    for q, c in ask:
        best = sorted((((c ^ x) & (2**64 - 1)).bit_count(), i) for i, x in enumerate(signed))[:10]
        assert [x[1:] for x in sorted(got[q])] == best
    few = hamming_search.nearest(data.where("id < 4"), spark.createDataFrame(ask[:1], "id long, code long"))
    assert few.count() == 4
    assert hamming_search.nearest(data.limit(0), spark.createDataFrame(ask, "id long, code long")).count() == 0


def test_language_of_held_out_documents(spark, documents):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    langs, model = language_id.fit(rows.where("doc_id % 2 = 0"), 1000)
    assert langs == ["de", "en", "es", "fr"]
    held = rows.where("doc_id % 2 = 1")
    found = language_id.identify(language_id.document_rows(held), langs, model, ["doc_id"])
    both = found.join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    right, kept, n = both.agg(F.avg((F.col("lang") == F.col("truth")).cast("int")), F.avg(F.col("accepted").cast("int")), F.count("*")).first()
    assert right > 0.99 and kept > 0.99 and n == held.count()


def test_language_evidence_and_odd_rows(spark, documents, some_texts):
    docs = documents([r for r in some_texts if r[0] != 9009])
    langs, model = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    pages = spark.createDataFrame(
        [(1, "https://www.a.example.es/es/1", '<html lang="es"><p>y</p></html>'), (2, None, None), (3, "http://b.example.org", "<html><script>the of and</script><p>" + some_texts[1][1] + "</p></html>"),
         (4, "x", "<p>中文中文中文中文中文中文中文中文中文</p>")], "page_id long, url string, html string")
    rows = language_id.document_rows(docs).drop("_text_hash").unionByName(language_id.page_rows(pages), allowMissingColumns=True)
    got = language_id.identify(rows, langs, model, ["doc_id", "page_id"]).collect()
    assert len(got) == docs.count() + 4
    page = {r.page_id: r for r in got if r.page_id}
    assert not page[2].accepted and page[3].lang == "en" and page[3].accepted and not page[4].accepted
    assert not any(r.accepted for r in got if r.doc_id in (9001, 9002, 9003))
    kept = language_id.accepted_documents(docs, docs)
    assert kept.columns == docs.columns and kept.where("doc_id < 200").count() == docs.where("doc_id < 200").count()
    empty = documents([])
    assert language_id.accepted_documents(empty, empty).count() == 0


def test_rare_languages_are_fitted_at_any_size(spark):
    rare = [(100_000 + i, f"zq{i % 20} vyx wuq{i % 7} kyj", f"r{i % 20}") for i in range(40)]
    common = [(i, f"the common words of document {i} and more", "en") for i in range(8000)]
    lone = [(None, "o mesmo texto", "pt")] * 3
    labelled = spark.createDataFrame(rare + common + lone, "doc_id long, text string, lang string")
    want = sorted({f"r{i}" for i in range(20)} | {"en", "pt"})
    for sample_rows, language_rows in ((40, 5), (0, 0)):
        langs, model = language_id.fit(labelled, sample_rows, language_rows)
        assert langs == want and model.shape[0] == len(want) + 1
    drawn = Counter(r.lang for r in language_id._drawn(labelled, 40, 5).collect())
    assert drawn["en"] < 200 and all(drawn[f"r{i}"] == 2 for i in range(20))
    assert language_id.fit(labelled.where("false"))[0] == []


def test_fusion_matches_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 60")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id < 60")
    langs, model = language_id.fit(docs)
    rows = language_id.document_rows(docs).drop("_text_hash").unionByName(language_id.page_rows(pages), allowMissingColumns=True)
    rows = rows.withColumn("k0", F.col("doc_id")).withColumn("ll", F.col("page_id"))  # names used inside
    got = {(r.k0, r.ll): r for r in language_id.identify(rows, langs, model, ["k0", "ll"]).collect()}
    data = [r.asDict() for r in rows.collect()]
    n = len(langs) + 1

    def share(logs):
        raised = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(raised) for x in raised]

    sums = {"declared": {}, "suffix": {}, "domain": {}, "host": {}}
    total = [0.0] * n
    for r in data:
        idx = language_id.grams(r["text"] or "")
        r["ll"] = [float(row[idx].sum(dtype=np.float64)) * min(1.0, language_id.EVIDENCE_GRAMS / max(len(idx), 1)) for row in model]
        priors = [math.log(0.98 / (n - 1))] * (n - 1) + [math.log(0.02)]
        r["p"] = share([x + y for x, y in zip(r["ll"], priors, strict=True)])
        total = [x + y for x, y in zip(total, r["p"], strict=True)]
        for kind, held in sums.items():
            key = (r["domain"], r["host"]) if kind == "host" else r[kind]
            if r[kind] is not None:
                held[key] = [x + y for x, y in zip(held.get(key, [0.0] * n), r["p"], strict=True)]
    corpus = [(x + 1e-6) / (sum(total) + 1e-6 * n) for x in total]
    for r in data:
        domain = [x + 20 * c for x, c in zip(sums["domain"].get(r["domain"], [0.0] * n), corpus, strict=True)]
        held = sums["host"].get((r["domain"], r["host"]), [0.0] * n)
        host = [max(h - p, 0) + 5 * d / sum(domain) for h, p, d in zip(held, r["p"], domain, strict=True)]
        logs = [x + math.log(h / sum(host) + 1e-9) for x, h in zip(r["ll"], host, strict=True)]
        for kind in ("declared", "suffix"):
            table = sums[kind]
            if r[kind] is not None:
                for i in range(n):
                    logs[i] += math.log((table[r[kind]][i] + 1) / (sum(v[i] for v in table.values()) + max(len(table), 1)))
        p = share(logs)
        best = max(range(n), key=lambda i: (p[i], -i))
        found = got[(r["doc_id"], r["page_id"])]
        assert found.lang == [*langs, "und"][best] and abs(found.posterior - p[best]) < 1e-6
    assert len(got) == len(data)
