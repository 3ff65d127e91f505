"""Language identification by Bayesian evidence fusion.

The evidence of a row: its text, under a naive Bayes model of hashed byte 4-grams; the language its markup
declares; the suffix of its address; and its host. The text model is fitted on a bounded sample of each
language's labelled rows. All other tables are grouped sums, over every row, of the text posteriors: how often a language comes with
a declared value or a suffix, and how often a host has it. A host with few rows leans on its domain and that on
the corpus (hierarchical smoothing); a row is left out of its own host's counts. The posterior is the normalised
product. A background class with equal chances for all 4-grams takes what fits no language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelq.llm.base import batch, query, small_batches, small_join, table, texts
from labelq.session import materialised

GRAM_BITS = 16
SAMPLE_ROWS = 4000  # labelled rows the text model is fitted on, about this many and the next for each language
LANGUAGE_ROWS = 200  # rows of each language that are drawn at least, or all it has
EVIDENCE_GRAMS = 40  # overlapping 4-grams repeat each other: a text counts as this many at most
UNSEEN_SHARE = 0.2  # share of a language's 4-grams that are taken to be spread evenly, as rare words are
BACKGROUND_PRIOR = 0.02
SMOOTH_HOST, SMOOTH_DOMAIN, SMOOTH_VALUE = 5.0, 20.0, 1.0
LEAST_POSTERIOR = 0.5
UNKNOWN = "und"


#: Bytes that say something about a language: letters, and white space as one sign. Others are zero.
SPEAKING = np.zeros(256, np.uint8)
SPEAKING[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
SPEAKING[128:] = np.arange(128, 256)
SPEAKING[[9, 10, 11, 12, 13, 32]] = 32


def grams(text: str) -> np.ndarray:
    """Hashed byte 4-grams of a text; those with digits or punctuation are left out."""
    raw = SPEAKING[np.frombuffer(text.lower().encode(), np.uint8)]
    if len(raw) < 4:
        return np.zeros(0, np.uint32)
    mute = raw == 0
    keep = ~(mute[:-3] | mute[1:-2] | mute[2:-1] | mute[3:])
    raw = raw.astype(np.uint32)
    x = (raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24)[keep]
    return (x * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            total.setdefault(lang, []).append(grams(text))
        for lang, found in total.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield batch(COUNTS, {"lang": [lang] * len(gram), "gram": gram.astype(np.int32), "n": n})


def _log_chances(rows: pa.Table) -> pa.Table:
    """The log chances of all grams for one language, from at most one row per gram."""
    c = np.zeros(1 << GRAM_BITS)
    c[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    logs = np.log((1 - UNSEEN_SHARE) * c / max(c.sum(), 1) + UNSEEN_SHARE / (1 << GRAM_BITS))
    return pa.table({"lang": rows.column("lang")[:1], "logs": pa.array([logs.astype("<f4").tobytes()], pa.binary())})


def _hashed(labelled: DataFrame) -> DataFrame:
    return labelled.where("lang is not null").withColumn("_h", F.xxhash64(F.lit("fit"), F.col("doc_id"), F.col("text")))


def _cuts(labelled: DataFrame, sample_rows: int, language_rows: int) -> list[tuple[str, int]]:
    """The labelled languages in order, each with the largest hash that is drawn.

    A language's rate is the larger of that for ``sample_rows`` of all rows and that for ``language_rows`` of its
    own, and reaches its smallest hash at least, so every labelled language has rows at any size.
    """
    counts = _hashed(labelled).groupBy("lang").agg(F.count("*").alias("c"), F.min("_h").alias("least")).collect()
    n = sum(r["c"] for r in counts)
    cuts = []
    for r in counts:
        rate = min(1.0, max(sample_rows / n, language_rows / r["c"]))
        cuts.append((r["lang"], max(r["least"], min((1 << 63) - 1, int(rate * 2.0**64) - (1 << 63)))))
    return sorted(cuts)


def _drawn(labelled: DataFrame, sample_rows: int, language_rows: int, cuts: list[tuple[str, int]] | None = None) -> DataFrame:
    """The rows (lang, text) the model is fitted on; see ``_cuts``."""
    cuts = _cuts(labelled, sample_rows, language_rows) if cuts is None else cuts
    # From Arrow: rows of plain Python objects would start a second set of Python workers on the executors.
    cut = labelled.sparkSession.createDataFrame(pa.table({"lang": pa.array([x for x, _ in cuts], pa.string()), "_cut": pa.array([x for _, x in cuts], pa.int64())}))
    return _hashed(labelled).join(F.broadcast(cut), "lang").where("_h <= _cut").select("lang", "text")


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, language_rows: int = LANGUAGE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log chances of the hashed 4-grams, from rows (doc_id, text, lang).

    Languages are those of all labelled rows; each is fitted on rows drawn by a hash of doc_id and text (see
    ``_cuts``). Rows without a language are left out. Counts are summed per language and gram; one vector per language
    reaches the driver. Without any labelled row there is no language; one whose drawn texts have no grams gives all
    grams equal chances.
    """
    cuts = _cuts(labelled, sample_rows, language_rows)
    counts = _drawn(labelled, sample_rows, language_rows, cuts).mapInArrow(_counts, "lang string, gram int, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = {r["lang"]: np.frombuffer(r["logs"], "<f4") for r in counts.groupBy("lang").applyInArrow(_log_chances, "lang string, logs binary").toLocalIterator()}
    langs = [lang for lang, _ in cuts]
    table_ = np.full((len(langs) + 1, 1 << GRAM_BITS), -GRAM_BITS * np.log(2.0), np.float32)
    for i, lang in enumerate(langs):
        table_[i] = found.get(lang, table_[-1])
    return langs, table_


def _strings(codes: np.ndarray, names: list[str]) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), pa.float64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors as rows; zeros where there is none."""
    out = np.zeros((len(column), width))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _posterior(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages, and the first of the best."""
    if len(logs) == 0:
        return logs, np.zeros(0, np.int64)
    raised = np.exp(logs - logs.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True), logs.argmax(axis=1)


def _scores(model: np.ndarray, every: list[str], out: pa.Schema):
    """Log likelihoods of the last column's text, the languages' shares by the text alone, and the best of them."""
    n = len(every) - 1
    priors = np.log(np.array([(1 - BACKGROUND_PRIOR) / max(n, 1)] * n + [BACKGROUND_PRIOR]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros((b.num_rows, len(every)))
            for i, text in enumerate(texts(b.columns[-1])):
                idx = grams(text)
                found[i] = np.array([row[idx].sum(dtype=np.float64) for row in model]) * min(1.0, EVIDENCE_GRAMS / max(len(idx), 1))
            shares, best = _posterior(found + priors)
            columns = [*b.columns[:-1], _lists(found), _lists(shares), _strings(best, every)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)
    return run


def _fused(corpus: np.ndarray, every: list[str], n_keep: int, out: pa.Schema):
    """Language, posterior and decision of rows whose evidence has been joined to them."""
    n = len(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = dict(zip(b.schema.names, b.columns, strict=True))
            ll, p, declared, suffix, domain, host = (_matrix(column[c], n) for c in ("ll", "p", "c_declared", "c_suffix", "d", "h"))
            domain = domain + SMOOTH_DOMAIN * corpus
            host = np.maximum(host - p, 0) + SMOOTH_HOST * domain / domain.sum(axis=1, keepdims=True)
            shares, best = _posterior(ll + np.log(host / host.sum(axis=1, keepdims=True) + 1e-9) + declared + suffix)
            posterior = shares[np.arange(b.num_rows), best]
            letters = column["letters"].to_numpy(zero_copy_only=False).astype(bool)
            accepted = letters & (best != n - 1) & (posterior >= LEAST_POSTERIOR)
            columns = [*b.columns[:n_keep], _strings(best, every), pa.array(posterior), column["text_lang"], pa.array(accepted)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)
    return run


def _summed(rows: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    """Elementwise sums of ``p`` per key, for rows whose last key is known."""
    known = rows.where(F.col(keys[-1]).isNotNull())
    return known.groupBy(*keys).agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(n)]).alias(out))


def _chances(rows: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """Log chance of a value given each language; smoothed, and equal for all where little is known."""
    held = materialised(_summed(rows, [key], n, "_c"), "evidence")
    whole = held.agg(F.count("*").alias("v"), *[F.sum(F.get("_c", F.lit(i))).alias(f"t{i}") for i in range(n)]).first()
    totals = F.array(*[F.lit(float(whole[f"t{i}"] or 0.0)) for i in range(n)])
    log = F.zip_with("_c", totals, lambda c, t: F.log((c + SMOOTH_VALUE) / (t + SMOOTH_VALUE * max(whole["v"], 1))))
    return held.select(key, log.alias(out))


def identify(rows: DataFrame, langs: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """Add to the columns ``keep`` of ``rows``: lang, posterior, text_lang, accepted.

    ``rows`` has text, declared, suffix, domain and host, all strings; a null one is no evidence. ``lang`` is
    "und" where the background class wins. A row is accepted if a language wins with a posterior of
    ``LEAST_POSTERIOR`` or more. A null or empty text leaves the decision to the other evidence, and such a row
    is not accepted, as is none without any letter. Repeated rows get one row each; an empty table gives none. Names
    in ``keep`` clash with no inner ones.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(rows.sparkSession)
    every = [*langs, UNKNOWN]
    n = len(every)
    inner = [f"k{i}" for i in range(len(keep))]
    letters = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    named = rows.select(*[F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)], "declared", "suffix", "domain", "host", letters.alias("letters"), "text")
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*named.schema.fields[:-1], T.StructField("ll", vector), T.StructField("p", vector), T.StructField("text_lang", T.StringType())])
    thin = materialised(named.mapInArrow(_scores(model, every, to_arrow_schema(schema)), schema), "scores")

    whole = thin.agg(*[F.sum(F.get("p", F.lit(i))).alias(f"t{i}") for i in range(n)]).first()
    mass = np.array([float(x or 0.0) for x in whole])
    corpus = (mass + 1e-6) / ((mass.sum() or 1.0) + 1e-6 * n)
    domains = materialised(_summed(thin, ["domain"], n, "d"), "domains")
    hosts = materialised(_summed(thin, ["domain", "host"], n, "h"), "hosts")
    found = small_join(thin, _chances(thin, "declared", n, "c_declared"), ["declared"])
    found = small_join(found, _chances(thin, "suffix", n, "c_suffix"), ["suffix"])
    found = small_join(found, domains, ["domain"])
    found = small_join(found, hosts, ["domain", "host"])
    found = found.select(*inner, "letters", "ll", "p", "text_lang", "c_declared", "c_suffix", "d", "h")
    out = T.StructType([
        *[T.StructField(c, f.dataType) for c, f in zip(keep, named.schema.fields, strict=False)],
        T.StructField("lang", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("text_lang", T.StringType()), T.StructField("accepted", T.BooleanType())])
    return found.mapInArrow(_fused(corpus, every, len(keep), to_arrow_schema(out)), out)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows with evidence: their source stands for the host; they declare nothing."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"), none.alias("declared"), none.alias("suffix"),
                       F.when(F.col("source").isNotNull(), F.lit("-")).alias("domain"), F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Web pages as rows with evidence: text without markup, lang attribute, address suffix, domain and host."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))
    plain = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")
    plain = F.regexp_replace(plain, r"&#?[A-Za-z0-9]{1,8};", " ")
    return (
        pages.withColumn("host", host).select(
            "page_id", plain.alias("text"), declared.alias("declared"), F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"),
            F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"), "host"))


def accepted_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The documents with an accepted language; ``labelled`` (doc_id, text, lang) trains the text model."""
    langs, model = fit(labelled)
    found = identify(document_rows(docs), langs, model, ["doc_id", "_text_hash"])
    gone = materialised(found.where(~F.col("accepted")).select("doc_id", "_text_hash").distinct(), "rejected")
    # The hash of a null text is that of no input, on both sides.
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"])
    return docs.join(gone, same, "left_anti")


@query("op6_language_id")
def op6_language_id(spark, sf):
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    langs, model = fit(docs)
    rows = document_rows(docs).drop("_text_hash").unionByName(page_rows(pages), allowMissingColumns=True)
    return identify(rows, langs, model, ["doc_id", "page_id"])
