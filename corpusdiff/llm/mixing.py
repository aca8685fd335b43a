"""Mixing sources to target weights with soft memberships.

1. A classifier is learned from the labelled table: softmax regression on hashed words and a few shares of characters and words, fitted on a documented bounded
   sample (``examples`` labelled rows, those with the smallest hashes). It gives every document a posterior over the domains.
2. Every document i with n_i tokens and posterior p_i gets a rate r_i >= 0 so that the expected tokens of each domain, sum of r_i n_i p_i, match the targets in
   the least-squares sense. Starting from rates of 1, each round takes the residual per domain, scales it by the curvature of the documents that are not at
   zero, steps, and projects negative rates to zero; a step that does not lower the error is halved.

Token counts and posteriors are written without texts for the rounds, and computed once more where rates are asked for, so texts are neither copied nor shuffled. A round is one
pass over the narrow table with a few sums per task; only vectors of the number of domains go through the driver, and a document's rate follows from the list of steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import discard, release_memory, stored

BUCKETS, SHAPES = 1 << 18, 8
LEAST_SHARE = 0.005  # of the sample texts must have a hashed word before it gets a weight
RIDGE = 3.0
SYMBOLS = b"#*$%&|<>"
MAX_DOMAINS = 100


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature numbers and values of a text, and its words. Values: damped counts of hashed words, then shares of characters and words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = data.lower().split()
    bucket, counts = np.unique(np.fromiter((zlib.crc32(w) for w in found), np.int64, len(found)) % BUCKETS, return_counts=True)
    size, n = max(len(data), 1), max(len(found), 1)

    def without(characters: bytes) -> int:
        return len(data) - len(data.translate(None, characters))

    shares = np.array([
        1.0, min(1.0, 10 * without(SYMBOLS) / size), min(1.0, 2 * without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size), min(1.0, 10 * without(b"0123456789") / size),
        min(1.0, 10 * data.count(b"!") / size), len(bucket) / n, min(1.0, 20 * data.count(b"\n") / size), min(1.0, np.log1p(n) / 10),
    ])
    return np.concatenate((bucket, BUCKETS + np.arange(SHAPES))), np.concatenate((np.log1p(counts), shares)), len(found)


def fit_classifier(labelled: DataFrame, text_col: str, domain_col: str, examples: int = 6000, rounds: int = 150) -> tuple[list[str], np.ndarray]:
    """Domains in order of name, and weights (features x domains), from rows with a domain; no domains if there are none."""
    rows = labelled.filter(F.col(domain_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(domain_col).cast("string").alias("domain"))
    names = [r["domain"] for r in rows.select("domain").distinct().orderBy("domain").limit(MAX_DOMAINS + 1).collect()]
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not names:
        return [], np.zeros((BUCKETS + SHAPES, 0))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["domain"], pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))],
                ["domain", "i", "v"],
            )

    narrow = stored(rows.select("domain", F.xxhash64("text", "domain").alias("h"), "text").orderBy("h").limit(examples).select("domain", "text"), "labelled")
    sample = narrow.mapInArrow(describe, "domain string, i array<int>, v array<float>").toArrow()
    lengths = np.array([len(x) for x in sample["i"]])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    index, value = (np.concatenate([np.asarray(x.values) for x in sample[c]]) for c in ("i", "v"))
    truth = np.searchsorted(np.array(names), np.array(sample["domain"].to_pylist()))
    target = np.eye(len(names))[truth]
    common = np.bincount(index, minlength=BUCKETS + SHAPES) >= max(2, LEAST_SHARE * len(lengths))
    common[BUCKETS:] = True
    owner, index, value = owner[common[index]], index[common[index]], value[common[index]]
    distinct, at = np.unique(index, return_inverse=True)
    own, squares = np.zeros((len(distinct), len(names))), np.full((len(distinct), len(names)), 1e-6)
    for _ in range(rounds):  # full-batch steps, each weight with its own rate
        error = target - posteriors(np.stack([np.bincount(owner, value * own[at, d], len(lengths)) for d in range(len(names))], 1))
        slope = np.stack([np.bincount(at, value * error[owner, d], len(distinct)) for d in range(len(names))], 1) - RIDGE * own
        squares += slope * slope
        own += 0.3 * slope / np.sqrt(squares)
    weights = np.zeros((BUCKETS + SHAPES, len(names)))
    weights[distinct] = own
    return names, weights


def posteriors(logits: np.ndarray) -> np.ndarray:
    if not logits.shape[1]:
        return logits
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def domain_posteriors(df: DataFrame, names: list[str], weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` (words) and ``posterior``, an array in the order of ``names``."""

    @F.pandas_udf("n_tokens long, posterior array<double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        tokens, found = [], []
        for text in texts:
            index, value, n = features(text)
            tokens.append(n)
            found.append(value @ weights[index])
        release_memory()
        return pd.DataFrame({"n_tokens": tokens, "posterior": list(posteriors(np.stack(found)))})

    rest = [c for c in df.columns if c not in ("n_tokens", "posterior")]
    made = df.select(*rest, of(F.col(text_col)).alias("made_"))
    return made.select(*rest, "made_.n_tokens", "made_.posterior")


def _rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0, rate - p @ step)
    return rate


def _unpack(batch: pa.RecordBatch, domains: int) -> tuple[np.ndarray, np.ndarray]:
    return batch["posterior"].flatten().to_numpy().reshape(-1, domains), batch["n_tokens"].to_numpy(zero_copy_only=False).astype(np.float64)


Targets = dict[str, float] | Callable[[dict[str, float]], dict[str, float]]


def fit_rates(members: DataFrame, targets: Targets, names: list[str], total: float | None = None, rounds: int = 40, tolerance: float = 1e-6) -> list[np.ndarray]:
    """The steps from which every document's rate follows. ``members`` has ``n_tokens`` and ``posterior``; ``targets`` are weights by domain.

    A domain without target has weight 0; weights are scaled to sum to 1. ``total`` is the number of tokens wanted, by default those of the documents. ``targets`` may be a function: it gets
    the expected tokens of each domain at rates of 1 and gives the tokens wanted, which are then neither scaled nor held against ``total``.
    Targets that no rates can meet are met as closely as the rounds allow.
    """
    d = len(names)
    if not d or (not callable(targets) and sum(targets.get(n, 0.0) for n in names) <= 0):
        return []

    def passed(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected tokens by domain at these rates, curvature of the documents above zero, and all tokens."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(d + d * d + 1)
            for batch in batches:
                p, n = _unpack(batch, d)
                rate = _rates(p, steps)
                free = rate > 0
                found += np.concatenate(((rate * n) @ p, ((p[free] * n[free, None]).T @ p[free]).ravel(), [n.sum()]))
            yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.float64()))], ["s"])

        made = members.select("n_tokens", "posterior").mapInArrow(sums, "s array<double>")
        row = made.agg(*(F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(d + d * d + 1))).first()
        flat = np.array([x or 0.0 for x in row])
        return flat[:d], flat[d:-1].reshape(d, d), flat[-1]

    steps: list[np.ndarray] = []
    have, curve, tokens = passed(steps)
    chosen = targets(dict(zip(names, have.tolist()))) if callable(targets) else targets
    goal = np.array([chosen.get(n, 0.0) for n in names])
    if not callable(targets):
        goal *= (total if total is not None else tokens) / goal.sum()
    error, scale = np.linalg.norm(have - goal), max(np.linalg.norm(goal), 1e-9)
    for _ in range(rounds):
        if error <= tolerance * scale:
            break
        step = np.linalg.lstsq(curve + 1e-9 * max(np.trace(curve), 1e-9) * np.eye(d), have - goal, rcond=None)[0]
        for _ in range(6):
            new = passed([*steps, step])
            if np.linalg.norm(new[0] - goal) < error:
                break
            step = step / 2
        else:
            break
        steps.append(step)
        gain, error = error, np.linalg.norm(new[0] - goal)
        have, curve, _ = new
        if gain - error <= 1e-4 * tolerance * scale:
            break
    return steps


def rates_column(posterior: Column, steps: list[np.ndarray]) -> Column:
    """The rate of a document from its posterior, by built-in functions."""
    rate = F.lit(1.0)
    for step in steps:
        products = F.zip_with(posterior, F.array(*(F.lit(float(x)) for x in step)), lambda a, b: a * b)
        rate = F.greatest(F.lit(0.0), rate - F.aggregate(products, F.lit(0.0), lambda a, b: a + b))
    return rate


def mix(
    df: DataFrame, labelled: DataFrame, targets: Targets, text_col: str = "text", domain_col: str = "domain", total: float | None = None, examples: int = 6000
) -> DataFrame:
    """``df`` with ``n_tokens``, ``posterior``, ``rate`` and ``likely_domain``; ``labelled`` has texts and their domains.

    Columns of these names are replaced, all others stay. A null or empty text has no tokens and the posterior of the character shares alone. Equal texts
    get equal rates. Without any labelled row the posterior is empty, the likely domain null, and all rates are 1. An empty table gives no rows.
    """
    names, weights = fit_classifier(labelled, text_col, domain_col, examples)
    rest = [c for c in df.columns if c not in ("n_tokens", "posterior", "rate", "likely_domain")]
    placed = domain_posteriors(df.select(*rest), names, weights, text_col)
    members = stored(placed.select("n_tokens", "posterior"), "posteriors")
    steps = fit_rates(members, targets, names, total)
    discard(members)
    likely = F.get(F.array(*map(F.lit, names)), F.array_position("posterior", F.array_max("posterior")) - 1) if names else F.lit(None).cast("string")
    return placed.withColumn("rate", rates_column(F.col("posterior"), steps)).withColumn("likely_domain", likely)


def copies(rate: Column, *keys: str) -> Column:
    """How often to use a document: the whole part of its rate, and once more with the rest as probability, decided by a hash of ``keys``."""
    part = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + part).cast("int")
