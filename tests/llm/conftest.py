import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.01"

# Columns that operators use inside themselves; a table that has them as well must not disturb anything.
CLASHING = ["id", "n", "comp", "token", "tokens", "a", "b", "block", "bucket", "payload", "spans", "codes", "text_key", "_text_hash", "_key", "_k",
            "_row", "_source", "_size", "_bucket", "_id", "_weight", "size", "target", "epochs", "last", "times", "h", "_w", "item_id", "start", "part", "lang2"]


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text) or (doc_id, text, source) rows, with clashing columns on demand."""
    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHING])
        return df
    return make


@pytest.fixture(scope="session")
def some_texts(spark):
    """Some texts of the given table, with the cases every operator must stand."""
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 160").orderBy("doc_id").collect()]
    long = " ".join(r[1] for r in rows[:150]) * 2
    odd = [(None, "a null id with these few words here", None), (None, "a null id with these few words here", None), (9001, None, None), (9002, "", "s0"), (9003, " \t\n ", "s0"),
           (9004, "one", "s1"), (9005, "two words", "s1"), (9006, long, "s2"), (rows[3][0], rows[3][1], rows[3][2]), (9007, rows[5][1], "s3"), (9008, rows[5][1] + " more", "s3"),
           (9009, "<|endoftext|> in a text<|endoftext|>中文 مرحبا \U0001f600   x y  \n\n z\x00w\\0", "s4")]
    return rows + odd
