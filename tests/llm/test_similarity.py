"""Jaccard join, repeated strings and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelq.llm import decontaminate, jaccard_join, repeats, signatures, unit_dedup
from labelq.llm.components import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, r in sets[:n]:
            both = len(s & r)
            if s and r and 100 * both >= percent * (len(s) + len(r) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i, _ in sets}


def edited(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, documents, some_texts, k, percent):
    rng = random.Random(k)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    family = [(20_000 + i, edited(rng, base, rng.randrange(0, 7))) for i in range(150)]
    shared = " ".join(f"p{i}" for i in range(60))
    passages = [(30_000 + i, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for i in range(90)]
    rows = [r[:2] for r in some_texts] + family + passages
    want = brute_components(rows, k, percent)
    got = jaccard_join.near_components(documents(rows), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id), r
    sizes = Counter(r.n_shingles for r in got)
    assert sizes == Counter(len(shingles(t, k)) for _, t in rows)


def test_hot_trees_are_cut_without_losing_links(spark, documents, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rng, base[: rng.randrange(40, 60)], rng.randrange(0, 3))) for i in range(130)]
    want = brute_components(rows, 4, 85)
    monkeypatch.setattr(jaccard_join, "TREE_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "BULK", 6)
    monkeypatch.setattr(jaccard_join, "LISTED", 10)
    monkeypatch.setattr(jaccard_join, "FAMILY_ROWS", 25)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_components(documents(rows)).collect()}
    assert got == want


def test_empty_table(spark, documents):
    assert jaccard_join.near_components(documents([])).count() == 0
    assert repeats.kept_digests(documents([])).count() == 0
    assert unit_dedup.flagged(documents([])).count() == 0
    assert decontaminate.contained(documents([]), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_one_of_each_keeps_one_row_and_all_columns(spark, documents, some_texts):
    rows = [r for r in some_texts if r[0] is not None]
    docs = documents(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_components([r[:2] for r in rows], 5, 80)
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert ids == sorted(i for i in {r[0] for r in rows} if want[i] == i)
    assert {r.id for r in kept.select("id").distinct().collect()} == {"clash id"}


@pytest.mark.parametrize("seed", [1, 2])
def test_traversal_finds_every_pair_within_the_bound(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, (6, 300), dtype=np.uint64)
    sets = []
    for i in range(120):
        own = base[i % 6].copy()
        change = rng.random(300) < rng.random() * 0.3
        own[change] = rng.integers(0, 1 << 62, change.sum(), dtype=np.uint64)
        sets.append(np.unique(own[: rng.integers(200, 300)]))
    n = np.array([len(s) for s in sets])
    bits = np.stack([np.frombuffer(signatures.bitmap(s, 256), "<u8") for s in sets])
    seen = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    own = np.arange(len(sets))
    leaves = signatures.Level(bits, n - seen, np.zeros(len(n), np.int64), n, n, own, own)
    found = {(a, b) for i, j, _ in signatures.traverse(signatures.tree(leaves), None, 80, slice_=500) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (n[a] + n[b] - both):
                assert (a, b) in found


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 230)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + star + [(7, 7), (900, 901), (901, 900)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(200, 230)) and got[901] == 900
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length=50):
    first, out = {}, []
    for rank, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            first[w] = min(first.get(w, rank), rank)
    for rank, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < rank:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, documents, some_texts):
    rng = random.Random(3)
    passage = "".join(rng.choice("abc defé") for _ in range(400))
    extra = [(500 + i, "".join(rng.choice("xyz ") for _ in range(80)) + passage[rng.randrange(0, 120): rng.randrange(160, 400)] + "q" * (i % 3) * 60) for i in range(25)]
    rows = [r[:2] for r in some_texts if r[0] != 9006] + extra + [(9006, "".join(r[1] for r in some_texts[:40]))]
    ranked = [(repeats.LATE if i is None else i, t) for i, t in rows]
    want = Counter(zip([i for i, _ in rows], brute_repeats(ranked), strict=True))
    joined = repeats.with_spans(documents(rows, clash=False).select("doc_id", "text"), repeats.repeated_spans(documents(rows), block_bytes=20_000, bucket_bytes=30_000))
    got = repeats.kept_digests(documents(rows)).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    small = sum(sum(e - s for s, e in np.frombuffer(r.spans or b"", "<u4").reshape(-1, 2).tolist()) for r in joined.collect())
    assert small == sum(r.n_removed for r in got)


def test_lines_keep_their_first_occurrence(spark, documents, some_texts):
    rows = [r[:2] for r in some_texts] + [(7001, "first Line of four words\nother text here now\nshort one\n\nshort one"), (7002, "x\n first  line OF four words \r\nnew ending of this text"), (7002, "x\n first  line OF four words \r\nnew ending of this text")]
    lines = unit_dedup.flagged(documents(rows))
    got = {(r.doc_id, r.start, r.end): r.removed for r in lines.collect()}
    assert got[(7001, 0, 24)] == 0 and got[(7002, 2, 30)] == 1 and got[(7001, 45, 54)] == 0 and got[(7001, 56, 65)] == 1
    first = defaultdict(list)
    for i, t in dict.fromkeys(rows):
        at = 0
        for line in (t or "").split("\n"):
            whole = tuple(line.encode().lower().split())
            if whole:
                first[whole].append((i is None, i or 0, at))
            for m in re.finditer("[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+", line):
                w = tuple(m.group().encode().lower().split())
                if w != whole and (len(w) >= 8 or len(b" ".join(w).decode()) >= 64):
                    first[w].append((i is None, i or 0, at + m.start()))
            at += len(line) + 1
    assert sum(got.values()) == sum(len(x) - 1 for x in first.values())
    for share in (1, 10**9):  # all digests by one join, or all by the other
        same = unit_dedup.flagged(documents(rows), hot_share=share).collect()
        assert {(r.doc_id, r.start, r.end): r.removed for r in same} == got
    kept = unit_dedup.without_repeats(documents(rows))
    assert kept.count() == len(rows)
    texts = {r.doc_id: r.text for r in kept.where("doc_id > 7000 and doc_id < 8000").collect()}
    assert texts[7002] == "x\nnew ending of this text" and texts[7001].startswith("first Line")


def test_pieces_of_edited_lines_and_texts_without_spaces(spark, documents):
    shared = "a passage of more than eight words that two documents share."
    chinese = "\u4e2d" * 70
    rows = [(1, f"Some words before. {shared} And an end."), (2, f"Other words first! {shared.upper()} Another end\nnext line"), (3, f"{chinese}\u3002\u77ed\u3002"), (4, f"\u77ed\u3002{chinese}\u3002 x"), (5, chinese + "\u3002\u77ed\u3002")]
    got = {r.doc_id: r.text for r in unit_dedup.without_repeats(documents(rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "Other words first! Another end\nnext line" and got[4] == "\u77ed\u3002 x" and got[5] == ""
    out = {r.doc_id: r for r in unit_dedup.per_document(unit_dedup.flagged(documents(rows))).collect()}
    assert out[5].n_removed == 1 and out[2].n_removed == 1 and out[2].removed_chars == len(shared) + 1


@pytest.mark.parametrize("slice_", [1, 7, 64, 10_000])
def test_anchors_do_not_depend_on_slices(slice_):
    rng = random.Random(4)
    docs = [bytes(rng.choice(b"ab c") for _ in range(n)) for n in (0, 49, 50, 51, 300, 120)]
    raw, ends = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([len(d) for d in docs])
    place = {}
    for doc, start, count, at, h in zip(*repeats.anchors(raw, ends, slice_=slice_), strict=True):
        for s in range(start, start + count):
            assert s not in place and s <= at <= s + 34 and s + 50 <= ends[doc]
            place[s] = (int(at), int(h))
    whole = {s: (int(at), int(h)) for doc, start, count, at, h in zip(*repeats.anchors(raw, ends), strict=True) for s in range(start, start + count)}
    assert place == whole and len(place) == sum(max(0, len(d) - 49) for d in docs)


def hot_rows(n):
    """Documents that share a passage, each between words of its own; some are exact copies of others."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abc defg") for _ in range(150))

    def word():
        return "".join(rng.choice("mnopqrst") for _ in range(45))

    rows = [(None if i % 50 == 7 else i, word() + passage[rng.randrange(3):] + word()) for i in range(n)]
    return rows + [(n + i, rows[i][1]) for i in range(0, n, 10)] + [(rows[3][0], rows[9][1] + passage), rows[5]]


@pytest.mark.parametrize("busy_pieces", [1, 20, 10_000])
def test_repeats_around_hot_anchors_match_brute_force(spark, documents, busy_pieces):
    rows = hot_rows(300)
    want = Counter(zip([i for i, _ in rows], [x[1:3] for x in brute_repeats([(repeats.LATE if i is None else i, t) for i, t in rows])], strict=True))
    docs = documents(rows, clash=False).select("doc_id", "text").repartition(4)
    joined = repeats.with_spans(docs, repeats.repeated_spans(docs, block_bytes=5_000, bucket_bytes=20_000, busy_pieces=busy_pieces)).collect()
    spans = [(r.doc_id, np.frombuffer(r.spans or b"", "<u4").reshape(-1, 2).tolist()) for r in joined]
    assert Counter((i, (sum(e - s for s, e in x), len(x))) for i, x in spans) == want


def test_pieces_of_hot_anchors_are_spread(spark, documents):
    docs = documents(hot_rows(1000), clash=False).selectExpr("doc_id", "xxhash64(text) AS text_key", "text")
    held = Counter()
    for r in repeats._sent_pieces(docs, 8, 1 << 20, 100).select("bucket", "payload").collect():
        x = repeats._unpack(r.payload)
        if not isinstance(x[0], list):
            held[r.bucket] += len(x[0])
    assert sum(held.values()) > 1000 and max(held.values()) < 0.1 * sum(held.values())


def test_strings_with_equal_hashes_are_told_apart():
    raw = np.frombuffer(b"".join(bytes([c]) * 50 for c in b"abacb"), np.uint8)
    lead = repeats.equal_strings(raw, np.arange(5) * 50, np.array([3, 2, 1, 0, 4]), np.zeros(5, np.uint64))
    assert lead.tolist() == [2, 1, 2, 3, 1]


def test_packing_does_not_depend_on_the_order_of_arrival(spark, documents):
    docs = documents(hot_rows(400), clash=False).selectExpr("doc_id", "xxhash64(text) AS text_key", "text")
    hot = docs.selectExpr("doc_id", "text_key", "cast('x' AS binary) AS codes").distinct().hint("shuffle_hash")

    def packed(named):
        return [(r.p, r.doc_id, r.text_key) for r in repeats._met(named, hot).selectExpr("spark_partition_id() AS p", "*").collect()]

    forth, back = packed(docs.repartition(5).orderBy("text")), packed(docs.repartition(7).orderBy(docs["text"].desc()))
    assert forth == back and len(forth) == docs.count()
    assert forth == sorted(forth, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))


@pytest.mark.parametrize("family_rows", [25, 1024])
def test_links_are_all_counted(spark, documents, some_texts, monkeypatch, family_rows):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    family = [(20_000 + i, edited(rng, base[: rng.randrange(70, 90)], rng.randrange(0, 4))) for i in range(130)]
    copies = [(21_000 + i, family[i][1]) for i in range(0, 40, 2)]
    rows = [r[:2] for r in some_texts] + family + copies + [family[0], (21_000, family[50][1] + " more"), (21_000, "x")]
    sets = {(i, shingles(t, 4)) for i, t in rows if i is not None and t}
    want = {}
    for i, s in sets:
        want[(i, s)] = sum(1 for j, r in sets if i != j and s and r and 100 * len(s & r) >= 85 * (len(s) + len(r) - len(s & r)))
    monkeypatch.setattr(jaccard_join, "FAMILY_ROWS", family_rows)
    got = jaccard_join.near_components(documents(rows), count=True).collect()
    expected = Counter((i, len(shingles(t, 4)), want.get((i, shingles(t, 4)), 0)) for i, t in rows)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == expected
    assert max(r.n_links for r in got) > 5
