"""The pipeline's stages against brute force, on rows of the given tables."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from labelq.session import materialised

from .conftest import SF
from .test_filters import brute_mix
from .test_similarity import brute_components


def test_stages(spark, some_texts, documents):
    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 250")
    odd = documents([r for r in some_texts if r[0] is None or r[0] >= 9000], clash=False)
    docs = materialised(given.unionByName(odd), "docs")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialised(stage(spark, before, SF), name)
        kept[name] = (before.collect(), docs.collect())
        if name != "token_ids":
            assert docs.columns == given.columns

    before, after = kept["language_id"]
    assert {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 250} <= {r.doc_id for r in after}
    assert not {9001, 9002, 9003} & {r.doc_id for r in after}

    before, after = kept["jaccard_join"]
    comp = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert Counter(r.doc_id for r in after if r.doc_id is not None) == Counter(i for i, c in comp.items() if i == c)

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = kept["decontaminate"]
    leaks = [r for r in before if any(s and 100 * len(grams(r.text) & s) >= 80 * len(s) for s in items)]
    assert leaks and Counter(after) == Counter(before) - Counter(leaks)

    before, after = kept["mix_sources"]
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in before:
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in after:
        taken[r.source] += len((r.text or "").encode().split())
    for s, target in brute_mix(sizes).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1e-6
    assert max(Counter(r.doc_id for r in after if r.doc_id is not None).values()) <= 3

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = kept["token_ids"]
    want = Counter()
    for r in before:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == want


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialised(stage(spark, docs, SF), name)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))
