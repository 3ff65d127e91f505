"""Token counts and the token store against the tokenizers library, and round trips."""

import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from labelq.llm import bpe, token_counts, token_store
from labelq.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_match_the_library(spark, documents, some_texts, library):
    rows = [r[:2] for r in some_texts]
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    got = token_counts.token_counts(documents(rows), PATH, buckets=7, block_chars=20_000).collect()
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.token_counts(documents([]), PATH).count() == 0


def test_split_agrees_with_the_library_on_every_letter(library):
    own = bpe.ByteLevel(PATH)
    for c in range(0x180):
        for text in (f"a{chr(c)}b", f" {chr(c)}{chr(c)} 1", f"{chr(c)}  '{chr(c)}s", f"x \n{chr(c)}\t y"):
            want = [text[s:e] for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert own.pieces(text) == want, (hex(c), text)


def test_store_round_trip(spark, documents, some_texts, library):
    rows = [r[:2] for r in some_texts]
    folder = scratch_path(spark, "store")
    token_store.write_ids(documents(rows), PATH, folder, chunk_ids=700)
    got = token_store.read_documents(spark, folder).collect()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    inorder = sorted(got, key=lambda r: r.start)
    assert [r.start for r in inorder] == np.cumsum([0, *[r.n_tokens for r in inorder[:-1]]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in inorder]
    assert ids == sorted(ids)


def test_order_of_equal_ids_does_not_follow_the_partitions(spark, documents):
    rows = [(7, f"text number {i} " * (i % 5)) for i in range(40)] + [(7, None), (None, "x"), (None, None), (8, "same"), (8, "same")]
    stores = []
    for dealt in (documents(rows).repartition(5), documents(rows[::-1]).coalesce(1)):
        folder = scratch_path(spark, "store")
        token_store.write_ids(dealt, PATH, folder, chunk_ids=50)
        stores.append(Counter(tuple(r) for r in token_store.read_documents(spark, folder).collect()))
    assert stores[0] == stores[1] and sum(stores[0].values()) == len(rows)


def test_empty_store(spark, documents):
    folder = scratch_path(spark, "store")
    token_store.write_ids(documents([]), PATH, folder)
    assert token_store.read_documents(spark, folder).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano_selects(seed):
    rng = np.random.default_rng(seed)
    values = np.cumsum(rng.integers(0, [1, 2, 50, 4000, 10**6, 3][seed], 3000 if seed else 1))
    ef = token_store.EliasFano.of(values, int(values[-1]))
    again = token_store.EliasFano(ef.length, ef.low_bits, ef.low.tobytes(), ef.high.tobytes())
    assert (again.select(np.arange(len(values))) == values).all()
    some = rng.integers(0, len(values), 50)
    assert (again.select(some) == values[some]).all()
    assert 8 * (len(ef.low) + len(ef.high)) <= len(values) * (3 + max(0, np.log2(max(values[-1], 1) / len(values)))) + 16
    assert sys.byteorder == "little"
