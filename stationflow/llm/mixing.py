"""Soft-membership mixing of documents to target domain weights.

Domains come from the labelled table (toxic, else good or poor by quality). A softmax
regression over the presence of hashed words and a few coarse traits of the text gives
every document its domain posteriors. It is fitted on at most ``sample`` labelled rows
(those with the smallest hashed doc_id; a documented bound): executors count presence
by domain, the ``KEPT`` buckets that tell most are kept, and the sample's rows over
these buckets, at most ``sample * KEPT`` bits, are fitted on the driver.

Rates r >= 0 (or 1, see below) are fitted by projected gradient, accelerated with
restarts, on the squared gaps between sum_i r_i * tokens_i * p_i(domain) and the target
totals, from r = 1. Documents whose posteriors share a cell of a fine grid get one rate,
and a cell enters with its exact sums, so one pass over the documents is enough and the
iterations run on the cells. They end when all gaps, or a bound from duality on the
distance of every total from its least-squares value, are within ``CLOSE`` of the target
total; a fit that does not get there in ``STEPS`` raises. Tokens are words here
(``[^\\x20\\x09-\\x0D]+``).

The target total is set by the anchor domain, which keeps its own mass; so documents
of that domain get rates near one. A document that more likely than not belongs to the
anchor domain is not left out: its rate is at least 1, a bound inside the fit. ``copies``
rounds a rate up or down by a fixed hash of doc_id and nothing else, so the expected
copies are the rates, and the totals fitted are those emitted.

Defined results: NULL or empty texts have 0 tokens, the prior's posteriors and a rate
like any other; without labels every posterior is equal, and so is every rate; labels
that are NULL in any column or contradict each other are left out; repeated rows get
the same rate; an empty table gives no rows; other columns pass through
``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import bounded_batches, cut

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.96, "poor": 0.03, "toxic": 0.01}
ANCHOR = "good"
SAMPLE = 20_000
BITS = 15
KEPT = 512
GRID = 256
STEPS = 50_000
CLOSE = 1e-3
FIT_STEPS = 300
PENALTY = 1e-4


def traits(words: list[bytes]) -> list[bytes]:
    """Coarse marks of form, as words no text can hold (they start with a space)."""
    n = max(len(words), 1)
    text = b"".join(words)
    size = max(len(text), 1)
    symbols = sum(text.count(c) for c in b"#*$%&|<>")
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    distinct = len(set(words)) / n
    return [
        b" length %d" % min(n.bit_length(), 5),
        b" symbols %d" % min(int(20 * symbols / n), 4),
        b" capitals %d" % min(int(5 * capitals / size), 4),
        b" distinct %d" % int(4 * distinct if n > 20 else 5),
    ]


def features(text: str | None) -> tuple[int, np.ndarray]:
    """(words, distinct buckets present)."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    seen = {w.lower() for w in set(words)}
    seen.update(traits(words))
    mask = (1 << BITS) - 1
    return len(words), np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) & mask for w in seen), np.int64, len(seen)))


# Softmax base by domain, and weights by bucket and domain.
Model = tuple[np.ndarray, np.ndarray]


def posterior(model: Model, buckets: np.ndarray) -> np.ndarray:
    score = model[0] + model[1][buckets].sum(axis=0)
    score = np.exp(score - score.max())
    return score / score.sum()


def _softmax(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and weights by full-batch Adam with a small penalty; deterministic."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    base = np.log((y.sum(axis=0) + 1) / (len(y) + y.shape[1])).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, FIT_STEPS + 1):
        score = x @ w + base
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (p - y) / len(y) + PENALTY * w
        base -= 0.5 * (p - y).mean(axis=0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return base.astype(float), w.astype(float)


def domain_of_labels() -> Column:
    """Index of the domain, NULL where a label is missing."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


def _count_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(DOMAINS), 1 << BITS), np.int64)
    docs = np.zeros(len(DOMAINS), np.int64)
    for batch in batches:
        for text, domain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[domain, features(text)[1]] += 1
            docs[domain] += 1
    for d in np.flatnonzero(docs):
        at = np.flatnonzero(counts[d])
        yield pa.record_batch(
            {
                "domain": pa.array(np.full(len(at) + 1, d), pa.int32()),
                "bucket": pa.array(np.append(at, -1), pa.int32()),
                "n": pa.array(np.append(counts[d, at], docs[d]), pa.int64()),
            }
        )


def _kept_bits(kept: np.ndarray):
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(np.isin(kept, features(t)[1])).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch({"domain": batch.column(1), "bits": pa.array(rows, pa.binary())})

    return bits


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier from at most ``sample`` labelled documents."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of_labels().alias("domain"))
        .where("doc_id IS NOT NULL AND domain IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
        .where("domain = other")
        .select("doc_id", "domain")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    sample_rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("text", "domain")
    )
    rows = (
        sample_rows.mapInArrow(_count_presence, "domain int, bucket int, n long")
        .groupBy("domain", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    base, weight = np.zeros(len(DOMAINS)), np.zeros((1 << BITS, len(DOMAINS)))
    if not len(rows):
        return base, weight
    present = np.zeros((1 << BITS, len(DOMAINS)))
    totals = np.zeros(len(DOMAINS))
    for domain, bucket, n in rows.itertuples(index=False):
        if bucket < 0:
            totals[domain] = n
        else:
            present[bucket, domain] = n
    # Keep the buckets that tell most about the domain (mutual information).
    prior = (totals + 1) / (totals + 1).sum()
    p = (present + 0.5) / (totals + 1)
    both = (p @ prior)[:, None]
    gain = (prior * (p * np.log(p / both) + (1 - p) * np.log((1 - p) / (1 - both)))).sum(axis=1)
    kept = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    found = sample_rows.mapInArrow(_kept_bits(kept), "domain int, bits binary").toPandas()
    bits = np.frombuffer(b"".join(found["bits"]), np.uint8).reshape(len(found), -1)
    x = np.unpackbits(bits, axis=1)[:, : len(kept)].astype(np.float32)
    base, weight[kept] = _softmax(x, np.eye(len(DOMAINS), dtype=np.float32)[found["domain"]])
    return base, weight


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            p = np.array([posterior(model.value, b) for _, b in found]).reshape(-1, len(DOMAINS))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([n for n, _ in found], pa.int64())}
            yield pa.record_batch(columns | {f"p_{d}": pa.array(p[:, k]) for k, d in enumerate(DOMAINS)})

    return score


SCORES = "doc_id long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)


def cells(p: np.ndarray) -> np.ndarray:
    """The cell of each posterior, on a grid of ``GRID`` steps in all domains but the last."""
    places = np.minimum((p[:, :-1] * GRID).astype(np.int64), GRID)
    return places @ (GRID + 1) ** np.arange(len(DOMAINS) - 2, -1, -1)


def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell: documents, tokens, posteriors and tokens times posteriors."""
    size = (GRID + 1) ** (len(DOMAINS) - 1)
    sums = np.zeros((size, 2 + 2 * len(DOMAINS)))
    for batch in batches:
        p = np.column_stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS])
        t = batch.column("n_tokens").to_numpy().astype(float)[:, None]
        at = cells(p)
        for k, values in enumerate(np.hstack([np.ones_like(t), t, p, t * p]).T):
            sums[:, k] += np.bincount(at, values, size)
    seen = np.flatnonzero(sums[:, 0])
    columns = {"cell": pa.array(seen)} | {f"s{k}": pa.array(sums[seen, k]) for k in range(sums.shape[1])}
    yield pa.record_batch(columns)


def least_squares(
    p: np.ndarray, mass: np.ndarray, least: np.ndarray, goal: np.ndarray
) -> tuple[np.ndarray, float, bool]:
    """(rates, error, met) of rows with posteriors ``p`` and token masses ``mass`` by domain.

    ``error`` bounds how far any total can be from its least-squares value, as a share of
    the sum of ``goal``; ``met`` is whether it, or each gap itself, is within ``CLOSE``.
    """
    scale = 1 / np.maximum(mass.sum(axis=0), 1e-9 * mass.sum())
    allowed = CLOSE * goal.sum()
    curve = np.linalg.norm(np.sqrt(scale)[:, None] * (mass.T @ p) * np.sqrt(scale), 2)
    r = np.maximum(least, 1.0)
    ahead, speed = r, 1.0
    bottom = least @ mass - goal
    error = np.inf
    for step in range(STEPS + 1):
        gap = r @ mass - goal
        if np.abs(gap).max() <= allowed:
            return r, float(np.abs(gap).max() / goal.sum()), True
        if step % 20 == 0:
            # The scaled gaps, lifted until no row gains by a higher rate, bound the squares from below.
            y = scale * gap
            y = y + max(0.0, -(p @ y).min())
            above = 0.5 * (scale * gap**2).sum() - (y @ bottom - 0.5 * (y**2 / scale).sum())
            error = min(error, float(np.sqrt(2 * max(above, 0.0) / scale.min()) / goal.sum()))
            if error <= CLOSE:
                return r, error, True
        slope = p @ (scale * (ahead @ mass - goal)) / curve
        new = np.maximum(least, ahead - slope)
        # A restart where the last move went uphill.
        if (mass.sum(axis=1) * (ahead - new)) @ (new - r) > 0:
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        ahead, r, speed = new + (speed - 1) / faster * (new - r), new, faster
    return r, error, False


def fit_rates(
    scores: DataFrame, targets: dict[str, float], anchor: str = ANCHOR, at_most: bool = False
) -> np.ndarray:
    """The rate of every cell; one pass sums the cells, at most ``(GRID + 1) ** 2`` rows reach the driver.

    With ``at_most`` a domain that has less than its target keeps what it has.
    """
    n = len(DOMAINS)
    table = np.ones((GRID + 1) ** (n - 1))
    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    share = share / share.sum()
    k = DOMAINS.index(anchor)
    schema = ", ".join(["cell long", *(f"s{i} double" for i in range(2 + 2 * n))])
    each = scores.mapInArrow(_cell_sums, schema).groupBy("cell")
    found = each.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(2 + 2 * n))).orderBy("cell").toPandas()
    sums = found.drop(columns="cell").to_numpy()
    mass = sums[:, 2 + n :]
    total = mass.sum(axis=0)
    if not len(found) or total[k] <= 0 or share[k] <= 0:
        return table
    goal = share * total[k] / share[k]
    if at_most:
        goal = np.minimum(goal, total)
    # The mean posterior of a cell, by tokens where it has any.
    words = sums[:, 1] > 0
    p = np.where(words[:, None], mass, sums[:, 2 : 2 + n]) / np.where(words, sums[:, 1], sums[:, 0])[:, None]
    least = (found["cell"].to_numpy() // (GRID + 1) ** (n - 2 - k) % (GRID + 1) >= GRID // 2).astype(float)
    rate, error, met = least_squares(p, mass, least, goal)
    if not met:
        raise RuntimeError(f"rates not fitted after {STEPS} steps: totals may be off by {error:.2%} of the target total")
    table[found["cell"].to_numpy()] = rate
    return table


def _copies(rate: Column, doc_id: Column) -> Column:
    chance = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor(rate)
    return whole + F.when(chance < rate - whole, 1).otherwise(0)


def _rate_column(by_cell):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.column_stack([batch.column(f"p_{d}").to_numpy() for d in DOMAINS])
            yield batch.append_column("rate", pa.array(by_cell.value[cells(p)]))

    return add


def _rate_of_texts(model, by_cell, position: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [posterior(model.value, features(t)[1]) for t in batch.column(position).to_pylist()]
            rate = pa.array(by_cell.value[cells(np.array(p).reshape(-1, len(DOMAINS)))])
            names = [*(f"c{k}" for k in range(batch.num_columns)), "rate"]
            yield pa.record_batch([*batch.columns, rate], names=names)

    return add


def _learn(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int, at_most: bool = False):
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, sample))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scores = cut(read.mapInArrow(_scored(model), SCORES))
    return model, scores, spark.sparkContext.broadcast(fit_rates(scores, targets, at_most=at_most))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, n_tokens, the domain posteriors, rate and copies."""
    _, scores, by_cell = _learn(docs, labels, targets, sample)
    rated = scores.mapInArrow(_rate_column(by_cell), f"{SCORES}, rate double")
    return rated.withColumn("copies", _copies(F.col("rate"), F.col("doc_id")))


def mixed_documents(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    sample: int = SAMPLE,
    at_most: bool = False,
) -> DataFrame:
    """The documents themselves, each as often as ``copies`` says; all columns as they were."""
    model, _, by_cell = _learn(docs, labels, targets, sample, at_most)
    names, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema.fields]
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    schema = ", ".join(f"c{k} {kind}" for k, kind in enumerate(kinds)) + ", rate double"
    rated = plain.mapInArrow(_rate_of_texts(model, by_cell, names.index("text")), schema)
    copies = _copies(F.col("rate"), F.col(f"c{names.index('doc_id')}"))
    return (
        rated.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .drop("rate", "__copy")
        .toDF(*names)
    )
