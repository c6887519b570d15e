"""Language identification by Bayesian evidence fusion.

The evidence of a text for each language:

- text: letter trigrams (hashed, ``BUCKETS``) under a multinomial model per language, the mean log-likelihood times at most
  ``TEXT_WEIGHT`` trigrams, as trigrams of one text are not independent;
- the declared language (markup or metadata) and the address suffix: how often texts of each language carry them;
- the host: the share of each language on it, smoothed by that of its site (the host's last two labels) and that by all texts (``KAPPA`` pseudo texts each).

All tables of the last two come from grouped aggregations over all texts, by the language that the text alone says; the language with the largest
posterior is the answer. Only the trigram model is fitted on a sample: about ``TRAIN`` labelled texts per language, drawn by hash of the id.

A text is rejected if it has fewer than ``LEAST`` trigrams, if no language reaches a posterior of ``SURE``, or if no language explains it: its
mean log-likelihood per trigram is below that of each language's training texts by more than ``FAR`` (plus ``NOISE`` over the root of its number of
trigrams). Mixed texts and texts with many tokens of other kinds stay well above that; random letters and unknown languages don't.

Cases: null and empty texts are rejected with a null language. A null declaration, suffix or host says nothing. Ties go to the language that sorts first. Repeated
rows are kept. Without labelled texts nothing can be told: all are rejected. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import bound_batches, uniform
from urlrisk.llm.decontaminate import clean
from urlrisk.llm.textarrays import chunks, mix
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

BUCKETS = 1 << 15
TRAIN = 2000
#: Languages of the model; more labels are an error.
LANGUAGES = 200
TEXT_WEIGHT = 40
KAPPA = 20.0
LEAST = 1
SURE = 0.5
FAR = 3.0
NOISE = 6.0


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # bucket x language
    mean: np.ndarray  # of the training texts' mean log-likelihoods


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all trigrams around a letter; digits, as in numbers and tokens, say nothing."""
    points, starts = clean(texts)
    points = np.where((points >= 48) & (points <= 57), np.uint32(32), points)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.where(points == 0, 32, points).astype(np.uint64)
    middle = np.flatnonzero((points[1:-1] != 32) & (points[1:-1] != 0))
    x = (p[middle] << np.uint64(42)) ^ (p[middle + 1] << np.uint64(21)) ^ p[middle + 2]
    return (mix(x) >> np.uint64(49)).astype(np.int64), np.searchsorted(starts, middle + 1, "right") - 1


def fit(labelled: DataFrame, train: int = TRAIN) -> Model:
    """``labelled``: doc_id, text, lang."""
    known = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(counts)
    chosen = F.lit(False)
    for lang in languages:
        chosen |= (F.col("lang") == lang) & (uniform(F.col("doc_id"), F.lit("train")) < train / counts[lang])
    sample = known.where(chosen).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            texts, which = batch["text"].tolist(), np.array([languages.index(x) for x in batch["lang"]], np.int64)
            for a, b in chunks(texts):
                bucket, of = trigrams(texts[a:b])
                total += np.bincount(which[a:b][of] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": total[lang, bucket]})

    sums = sample.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), BUCKETS))
    rows = sums.toArrow()  # at most languages x buckets
    table[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    logs = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32)
    model = Model(languages, np.ascontiguousarray(logs), np.zeros(len(languages)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, which = batch["text"].tolist(), np.array([languages.index(x) for x in batch["lang"]], np.int64)
            for a, b in chunks(texts):
                total, n = likelihoods(texts[a:b], model)
                mean = total[np.arange(b - a), which[a:b]] / np.maximum(n, 1)
                frame = pd.DataFrame({"lang": which[a:b], "mean": mean})
                yield frame[n >= LEAST]

    fitted = sample.mapInPandas(measure, "lang int, mean double").groupBy("lang").agg(F.avg("mean").alias("m"))
    for r in fitted.collect():  # one row per language
        model.mean[r["lang"]] = r["m"]
    return model


def likelihoods(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood per text and language, and the number of trigrams."""
    bucket, of = trigrams(texts)
    total = np.zeros((len(texts), len(model.languages)))
    for i in range(len(model.languages)):
        total[:, i] = np.bincount(of, model.logs[bucket, i].astype(np.float64), len(texts))
    return total, np.bincount(of, minlength=len(texts))


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``evidence`` (per language), ``odd`` (whether no language fits) and ``n`` to doc_id, declared, suffix, host."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id", "declared", "suffix", "host"]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                total, n = likelihoods(texts[a:b], m)
                mean = total / np.maximum(n, 1)[:, None]
                limit = m.mean - FAR - NOISE / np.sqrt(np.maximum(n, 1))[:, None]
                out = batch[keep].iloc[a:b].copy()
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["evidence"] = list(mean * np.minimum(n, TEXT_WEIGHT)[:, None])
                out["odd"] = (mean < limit).all(axis=1)
                out["n"] = n
                yield out

    return rows.select(*keep, "text").mapInPandas(
        weigh, "doc_id long, declared string, suffix string, host string, evidence array<double>, odd boolean, n long"
    )


def _counts(column: str, width: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.when(F.col(column) == i, 1.0)), F.lit(0.0)) for i in range(width)])


def _scaled(counts: Column, prior: Column, kappa: float = KAPPA) -> Column:
    """(count + kappa x prior) / (all + kappa), per language."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, prior, lambda c, p: (c + kappa * p) / (total + kappa))


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """(doc_id, lang, posterior, kept) from the text evidence and the grouped tables over all texts."""
    width = len(languages)
    best = F.array_position("evidence", F.array_max("evidence")).cast("int") - 1
    site = F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]*\.?[^.]*)$", 1)
    marked = cut_lineage(
        evidence.withColumn("site", F.when(F.col("host").isNotNull(), site)).withColumn("_best", F.when(F.col("n") >= LEAST, best))
    )
    # all texts, each site, each host
    everywhere = marked.agg(_counts("_best", width).alias("c")).select(_scaled(F.col("c"), F.array(*[F.lit(1.0 / width)] * width)).alias("p"))
    p_all = everywhere.first()["p"]  # one row
    prior = F.array(*map(F.lit, p_all))
    sites = marked.where("site is not null").groupBy("site").agg(_counts("_best", width).alias("c"))
    sites = sites.select("site", _scaled(F.col("c"), prior).alias("_site"))
    hosts = marked.where("host is not null").groupBy("host", "site").agg(_counts("_best", width).alias("c"))
    hosts = hosts.join(sites, "site").select("host", _scaled(F.col("c"), F.col("_site")).alias("_host"))
    out = marked.join(bounded_broadcast(cut_lineage(hosts)), "host", "left")
    # per language: how likely it carries the sign, over how likely any text does
    for sign in ("declared", "suffix"):
        counts = marked.where(F.col(sign).isNotNull()).groupBy(sign).agg(_counts("_best", width).alias("c"))
        ratio = F.zip_with(_scaled(F.col("c"), prior), prior, lambda a, b: a / b)
        out = out.join(bounded_broadcast(cut_lineage(counts.select(sign, ratio.alias(f"_{sign}")))), sign, "left")
    ones = F.array(*[F.lit(1.0)] * width)
    log = lambda c: F.transform(c, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    score = F.col("evidence")
    for part in (F.coalesce("_host", prior), F.coalesce("_declared", ones), F.coalesce("_suffix", ones)):
        score = F.zip_with(score, log(part), lambda a, b: a + b)
    scored = out.select("doc_id", "odd", "n", score.alias("_score"))
    scored = scored.withColumn("_top", F.array_max("_score"))
    scored = scored.withColumn("posterior", 1 / F.aggregate("_score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))))
    at = F.array_position("_score", F.col("_top")).cast("int")
    lang = F.when(F.col("n") > 0, F.element_at(F.array(*map(F.lit, languages)), at))
    kept = (F.col("n") >= LEAST) & (F.col("posterior") >= SURE) & ~F.col("odd")
    return scored.select("doc_id", lang.alias("lang"), "posterior", kept.alias("kept"))


def identify_languages(
    rows: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    suffix_col: str | None = None,
    host_col: str | None = "source",
    train: int = TRAIN,
) -> DataFrame:
    """(doc_id, lang, posterior, kept) of every row. ``labelled``: doc_id, text, lang."""
    column = lambda c: F.col(c) if c else F.lit(None)
    bound_batches(rows.sparkSession)
    model = fit(labelled.select("doc_id", "text", "lang"), train)
    named = rows.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.lower(column(declared_col).cast("string")).alias("declared"),
        F.lower(column(suffix_col).cast("string")).alias("suffix"),
        F.lower(column(host_col).cast("string")).alias("host"),
    )
    if not model.languages:
        return named.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    return fuse(text_evidence(named, model), model.languages)
