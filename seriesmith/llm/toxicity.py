"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the presence of lower-cased words and of their first four and six bytes. A logistic model is fitted on
labelled rows with a penalty on the squared change of the score when identity terms of a text are swapped for other
terms of the same group, or left out, so that naming a group does not by itself raise the score.

Only the fit is bounded: it uses at most ``max_rows`` labelled rows (those with the smallest hash of id), and the
``max_features`` features most associated with the label, both documented parameters. All documents are scored over
their whole texts. What is sent to the tasks is bounded by these two numbers.

Defined cases: null, empty or word-less text gets the score of the intercept; null labels are not learnt from; an id
labelled twice counts as toxic if one label says so; without labels the score is 0.5 everywhere; repeated rows are
scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

PREFIXES = (4, 6)
# Terms of each group that may be swapped for one another.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"), ("old", "young"), ("blind", "deaf", "disabled"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings (different kinds never share a hash on purpose)."""
    pre = scan.prefix(data)
    out = [scan.span_hash(pre, starts, ends)]
    for k in PREFIXES:
        out.append(scan.mix(scan.span_hash(pre, starts, np.minimum(ends, starts + k)) + np.uint64(k)))
    return out


def row_features(data: np.ndarray, offs: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature, each once per row. ``keep``: sorted features to which to restrict; then their numbers are given."""
    low = scan.LOWER[data]
    starts, ends = scan.spans(scan.ALNUM[low], offs)
    doc = np.searchsorted(offs, starts, "right") - 1
    feats = word_features(low, starts, ends)
    rows, vals = [], []
    if keep is not None:
        mask = np.zeros(1 << 16, bool)
        mask[keep >> np.uint64(48)] = True
    for f in feats:
        if keep is None:
            rows.append(doc)
            vals.append(f)
        elif len(keep):
            at = np.flatnonzero(mask[f >> np.uint64(48)])
            where = np.minimum(np.searchsorted(keep, f[at]), len(keep) - 1)
            good = keep[where] == f[at]
            rows.append(doc[at[good]])
            vals.append(where[good].astype(np.uint64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, val = np.concatenate(rows), np.concatenate(vals)
    _, once = np.unique(scan.in_row(val, row), return_index=True)
    return row[once], val[once]


def identity_features(groups: Sequence[Sequence[str]]) -> dict[bytes, list[tuple[np.ndarray, np.ndarray]]]:
    """For each term: its features, and those of each other term of its group and of no term at all."""
    def of(term: str) -> np.ndarray:
        data = np.frombuffer(term.encode(), np.uint8)
        return np.array([f[0] for f in word_features(data, np.array([0]), np.array([len(data)]))])

    none = np.zeros(0, np.uint64)
    return {t.encode(): [*[(of(t), of(o)) for o in g if o != t], (of(t), none)] for g in groups for t in g}


def terms_in(text: bytes, swaps: dict[bytes, list[tuple[np.ndarray, np.ndarray]]]) -> list[str]:
    """The identity terms that a text names."""
    raw = scan.LOWER[np.frombuffer(text, np.uint8)]
    return sorted({w.decode() for w in np.where(scan.ALNUM[raw], raw, 32).astype(np.uint8).tobytes().split() if w in swaps})


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, swaps: list[tuple[np.ndarray, np.ndarray]],
        l1: float = 3e-5, fairness: float = 4.0, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights and intercept of a sparse logistic model, by accelerated proximal gradient steps.

    ``swaps``: for each counterfactual the features that come and those that go; the mean squared change that it makes
    to the score is penalised, weighted by ``fairness``.
    """
    n, m = len(y), len(swaps)
    pos = float(y.sum())
    bias = float(np.log((pos + 1) / (n - pos + 1)))
    w = np.zeros(n_features)
    if not n or not n_features or pos in (0, n):
        return w, bias
    # one row per counterfactual: +1 for what comes, -1 for what goes
    at = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(swaps)] or [np.zeros(0, np.int64)]).astype(np.int64)
    feat = np.concatenate([x for pair in swaps for x in pair] or [np.zeros(0, np.int64)]).astype(np.int64)
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in swaps] or [np.zeros(0)])

    def pull(v: np.ndarray) -> np.ndarray:
        if not m:
            return 0.0 * v
        change = np.bincount(at, sign * v[feat], minlength=m)
        return np.bincount(feat, sign * change[at], minlength=n_features) * (2 * fairness / m)

    v = np.ones(n_features)
    for _ in range(30):  # the largest curvature, by power iteration
        v /= np.linalg.norm(v)
        v = 0.25 / n * np.bincount(cols, np.bincount(rows, v[cols], minlength=n)[rows], minlength=n_features) + pull(v)
        curve = np.linalg.norm(v)
        if not curve:
            return w, bias
    step = 1 / (1.1 * curve + 0.25)
    z, zb, t = w, bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, z[cols], minlength=n) + zb, -30, 30)))
        err = (p - y) / n
        new = z - step * (np.bincount(cols, err[rows], minlength=n_features) + pull(z))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = zb - step * float(err.sum())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    return w, float(bias)


def train(labelled: DataFrame, max_features: int = 2048, groups: Sequence[Sequence[str]] = IDENTITY, fairness: float = 4.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, weights and intercept. ``labelled`` has text and y (0 or 1), as many rows as the fit may use."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, b, data, offs in scan.pieces(batch.column(0)):
                row, f = row_features(data, offs, None)
                keys, back = np.unique(f, return_inverse=True)
                n = np.bincount(back, minlength=len(keys))
                pos = np.bincount(back, y[a:b][row], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(pos)], ["f", "n", "pos"])

    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = totals["n"], totals["pos"]
    if not n or pos in (0, n):
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log((pos + 1) / (n - pos + 1)))
    # association: signed root of chi-square with half counts added
    seen, rate = F.col("n"), pos / n
    chi = (F.col("pos") - seen * rate) / F.sqrt(seen * rate * (1 - rate) + 0.5)
    counted = labelled.select("text", "y").mapInArrow(count, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).filter("n >= 3")
    best = counted.withColumn("chi", F.abs(chi)).orderBy(F.desc("chi"), "f").limit(max_features).select("f").collect()
    swaps = identity_features(groups)
    named = np.concatenate([a for pairs in swaps.values() for a, _ in pairs]) if swaps else np.zeros(0, np.uint64)
    keep = np.unique(np.concatenate([np.array([r["f"] for r in best], np.int64).view(np.uint64), named]))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in scan.pieces(batch.column(0)):
                row, f = row_features(data, offs, keep)
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(b - a + 1))
                feats = [f[order[at[i] : at[i + 1]]].astype(np.int32).tolist() for i in range(b - a)]
                terms = [terms_in(data[offs[i] : offs[i + 1]].tobytes(), swaps) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(feats, pa.list_(pa.int32())), batch.column(1).slice(a, b - a), pa.array(terms, pa.list_(pa.string()))], ["f", "y", "terms"])

    got = labelled.select("text", "y").mapInArrow(select, "f array<int>, y int, terms array<string>").toArrow()
    size = np.array([len(x) for x in got.column("f")], np.int64)
    cols = np.array(got.column("f").combine_chunks().flatten().to_numpy(), np.int64) if got.num_rows else np.zeros(0, np.int64)
    y = got.column("y").to_numpy().astype(float)
    index = lambda h: np.unique(np.searchsorted(keep, h)).astype(np.int64)
    pairs = [(index(b), index(a)) for terms in got.column("terms").to_pylist() for t in terms for a, b in swaps[t.encode()]]
    w, bias = fit(np.repeat(np.arange(len(y)), size), cols, y, len(keep), pairs, fairness=fairness)
    return keep, w, bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row."""
    keep, w, bias = model
    live = np.abs(w) > 1e-9
    keys, weights = keep[live], w[live]
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in scan.pieces(batch.column(1)):
                row, f = row_features(data, offs, keys)
                z = np.bincount(row, weights[f.astype(np.int64)], minlength=b - a)[: b - a] + bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, score double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """text and y of at most ``max_rows`` labelled ids that are not held out, one row each: of several labels of an id the
    largest counts, of several texts the smallest, so that an id that a third of all rows share is one example."""
    usable = labels.select(labels[id_col].alias("k"), labels[label_col].cast("int").alias("y")).dropna().filter(~held_out(F.col("k")))
    few = usable.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = docs.select(docs[id_col].alias("k"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    met = texts.join(F.broadcast(few), "k")  # at most max_rows rows of two numbers
    return met.groupBy("k").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")
