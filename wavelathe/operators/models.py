"""Models at inference: linear and kernel SVMs (one against one), recurrent nets, CTC labels.

A model is small and goes along with the tasks: literals in an expression, or
the closure of an Arrow function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, let
from .kernels import bidirectional, lstm, softmax


def svm_decision(features: Column, weights: list[float], bias: float) -> Column:
    return dot(features, F.array(*map(F.lit, weights))) + bias


def svm_vote(features: Column, pairs: list[tuple[str, str, list[float], float]]) -> Column:
    """The class with most votes; a pair's first class wins where the decision is below 0. Ties go to the class listed first."""
    classes = list(dict.fromkeys(c for a, b, _, _ in pairs for c in (a, b)))
    won = [F.when(svm_decision(features, w, d) < 0, a).otherwise(b) for a, b, w, d in pairs]
    votes = [sum((F.when(v == c, 1).otherwise(0) for v in won), F.lit(0)) for c in classes]
    best = F.greatest(*votes) if len(votes) > 1 else votes[0]
    out = F.lit(classes[-1])
    for c, v in list(zip(classes, votes))[-2::-1]:
        out = F.when(v == best, c).otherwise(out)
    return out


def platt(decision: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a + b * decision)))


def coupled(features: Column, pairs: list[tuple[str, str, list[float], float, float, float]], rounds: int = 30) -> dict[str, Column]:
    """Class probabilities from the pairs' calibrated decisions (class a, class b, weights, bias, platt a, platt b).

    The coupling of Hastie and Tibshirani: each round scales every class by what
    its pairs say against what the present probabilities say.
    """
    classes = list(dict.fromkeys(c for p in pairs for c in p[:2]))
    at = {c: i for i, c in enumerate(classes)}
    # platt() is the second class's probability, as a decision below 0 is the first's.
    second = F.array(*[platt(svm_decision(features, w, d), a, b) for _, _, w, d, a, b in pairs])
    spots = [(at[p[0]], at[p[1]]) for p in pairs]

    def one(p: Column, r: Column) -> Column:
        new = []
        for c in range(len(classes)):
            said = seen = F.lit(0.0)
            for k, (i, j) in enumerate(spots):
                if c in (i, j):
                    other = j if c == i else i
                    said = said + (1 - F.get(r, F.lit(k)) if c == i else F.get(r, F.lit(k)))
                    seen = seen + F.get(p, F.lit(c)) / (F.get(p, F.lit(c)) + F.get(p, F.lit(other)))
            new.append(F.get(p, F.lit(c)) * said / seen)
        return let(F.array(*new), lambda q: F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda s, y: s + y)))

    start = F.array(*[F.lit(1.0 / len(classes))] * len(classes))
    end = let(second, lambda r: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda p, _: one(p, r)))
    return {c: F.get(end, F.lit(i)) for c, i in at.items()}


def parse_pairs(text: str) -> dict:
    """A text model of linear machines, one against one: classes, names (of the features) and pairs (class a, class b, weights, bias, calibration or None).

    Lines that are not empty: a title that ends in SVM MODEL, the kernel, the
    classes (their number, then the names, by commas), the number of pairs, that
    of features, the features' names; for each pair `++BINARYSVM++: a,b`, the
    number of support vectors (1), a weight a feature and `BIAS: b`, behind which
    `##++LOGISTIC;a;b` may give a calibration (other lines with ## are notes);
    then `++END++`.
    """
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines or not lines[0].endswith("SVM MODEL") or "++END++" not in lines:
        raise ValueError("not a whole model of pairs")
    number, *classes = [c.strip() for c in lines[2].split(",")]
    pairs, features = int(lines[3]), int(lines[4])
    if int(number) != len(classes):
        raise ValueError(f"{len(classes)} classes in place of {number}")
    names, at, out = lines[5 : 5 + features], 5 + features, []
    while lines[at] != "++END++":
        if not lines[at].startswith("++BINARYSVM++:"):
            if lines[at].startswith("##++LOGISTIC;") and out:
                out[-1] = (*out[-1][:4], tuple(float(v) for v in lines[at][13:].split(";")[:2]))
            elif not lines[at].startswith("##"):
                raise ValueError(f"not expected: {lines[at]}")
            at += 1
            continue
        a, b = (c.strip() for c in lines[at].split(":", 1)[1].split(","))
        if int(lines[at + 1]) != 1:
            raise ValueError("only linear machines, of one weight a feature")
        weights = [float(v) for v in lines[at + 2 : at + 2 + features]]
        bias = lines[at + 2 + features]
        if not bias.startswith("BIAS:"):
            raise ValueError(f"not a bias: {bias}")
        out.append((a, b, weights, float(bias[5:]), None))
        at += 3 + features
    if len(out) != pairs:
        raise ValueError(f"{len(out)} pairs in place of {pairs}")
    return {"classes": classes, "names": names, "pairs": out}


def pairs_class(df: DataFrame, model: dict, probabilities: bool = False) -> DataFrame:
    """df with the class that a model of pairs gives the features of its names, and p_<class> by its calibrations."""
    from ..metadata import vector_of

    v = vector_of(df, model["names"])
    out = df.select("*", svm_vote(v, [p[:4] for p in model["pairs"]]).alias("class"))
    if probabilities:
        if any(p[4] is None for p in model["pairs"]):
            raise ValueError("the model has no calibrations")
        # A calibration gives the first class's probability.
        got = coupled(v, [(*p[:4], -p[4][0], -p[4][1]) for p in model["pairs"]])
        out = out.select("*", *[c.alias(f"p_{k}") for k, c in got.items()])
    return out


def scaled(features: Column, ranges: list[tuple[float, float]], low: float = -1.0, high: float = 1.0, chosen: list[int] | None = None) -> Column:
    """Each feature from its range (of a scale file) to low..high, a range of 0 giving 0; chosen picks places (from 0) first."""
    v = F.array(*[F.get(features, F.lit(i)) for i in chosen]) if chosen else features
    lo, span = (F.array(*map(F.lit, c)) for c in ([float(a) for a, _ in ranges], [float(b - a) for a, b in ranges]))
    return F.transform(v, lambda x, i: F.when(F.get(span, i) != 0, low + (high - low) * (x - F.get(lo, i)) / F.get(span, i)).otherwise(0.0))


def parse_scale(text: str) -> tuple[float, float, dict[int, tuple[float, float]]]:
    """A libsvm scale file: low, high, and each feature's range by its number from 1."""
    lines = [line.split() for line in text.strip().splitlines()]
    at = lines.index(["x"])
    return float(lines[at + 1][0]), float(lines[at + 1][1]), {int(i): (float(a), float(b)) for i, a, b in lines[at + 2 :]}


def parse_libsvm(text: str, size: int) -> dict:
    """A libsvm model file of `size` features: its settings, support vectors (dense) and coefficients."""
    head, _, body = text.partition("SV\n")
    model: dict = {}
    for line in head.strip().splitlines():
        name, *rest = line.split()
        model[name] = rest[0] if name in ("svm_type", "kernel_type") else [float(x) for x in rest]
    rows = [line.split() for line in body.strip().splitlines()]
    k = max(int(model.get("nr_class", [2])[0]) - 1, 1)
    vectors = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        for pair in r[k:]:
            n, v = pair.split(":")
            vectors[i, int(n) - 1] = float(v)
    return model | {"vectors": vectors, "coefficients": np.array([[float(x) for x in r[:k]] for r in rows]).reshape(len(rows), k)}


def _kernel(model: dict, x: np.ndarray) -> np.ndarray:
    """Rows of x against the support vectors."""
    one = lambda name, other: model.get(name, [other])[0]
    sv, g = model["vectors"], one("gamma", 1 / max(x.shape[1], 1))
    kind = model["kernel_type"]
    if kind == "rbf":
        return np.exp(-g * ((x * x).sum(1)[:, None] + (sv * sv).sum(1) - 2 * x @ sv.T))
    inner = x @ sv.T
    if kind == "linear":
        return inner
    return (g * inner + one("coef0", 0.0)) ** one("degree", 3) if kind == "polynomial" else np.tanh(g * inner + one("coef0", 0.0))


def svm_decisions(model: dict, x: np.ndarray) -> np.ndarray:
    """A column for each pair of classes (or one of a regression): above 0 for the pair's first class."""
    k, coef, rho = _kernel(model, x), model["coefficients"], model["rho"]
    if "nr_sv" not in model:
        return (k @ coef[:, 0] - rho[0])[:, None]
    counts = [int(n) for n in model["nr_sv"]]
    ends = np.cumsum(counts)
    part = [slice(e - n, e) for n, e in zip(counts, ends)]
    out = []
    for i in range(len(counts)):
        for j in range(i + 1, len(counts)):
            out.append(k[:, part[i]] @ coef[part[i], j - 1] + k[:, part[j]] @ coef[part[j], i] - rho[len(out)])
    return np.stack(out, 1)


def kernel_svm(features: Column, model: dict) -> Column:
    """Class number (by votes, ties to the class listed first) or a regression's value, of arrays of features."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        good = v.notna().to_numpy()
        out = np.full(len(v), np.nan)
        if good.any():
            d = svm_decisions(model, np.stack([np.asarray(a, float) for a in v[good]]))
            if "label" not in model:
                out[good] = d[:, 0]
            else:
                n = len(model["label"])
                pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
                votes = np.zeros((len(d), n), int)
                for c, (i, j) in enumerate(pairs):
                    votes[np.arange(len(d)), np.where(d[:, c] > 0, i, j)] += 1
                out[good] = np.array(model["label"])[votes.argmax(1)]
        return pd.Series(out)

    return run(features)


def recurrent(df: DataFrame, keys: list[str], order: list[str], features: str, weights: dict, out: str = "activation", backward: dict | None = None, output: tuple | None = None) -> DataFrame:
    """Activations of an LSTM layer, row by row through each series; with backward, a second layer's from the end, side by side; output (weights, bias) adds a softmax layer."""
    kind = df.select(*keys, *order).schema.simpleString()[7:-1].replace(":", " ") + f", {out} array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = list(pdf[features])
        made = bidirectional(x, weights, backward) if backward else lstm(x, weights)
        pdf[out] = list(softmax(made @ np.asarray(output[0]).T + np.asarray(output[1])) if output else made)
        return pdf[[*keys, *order, out]]

    return df.select(*dict.fromkeys([*keys, *order, features])).groupBy(*keys).applyInPandas(run, kind)


def parse_net(text: str) -> dict:
    """Layers of a net in JSON: each name's wx, wh, b, p as nested lists."""
    import json

    return {name: {k: np.array(v, float) for k, v in layer.items()} for name, layer in json.loads(text).items()}


def labelled(activation: Column, labels: list[str]) -> Column:
    """The label of the largest activation, the first of equals."""
    return F.get(F.array(*map(F.lit, labels)), (F.array_position(activation, F.array_max(activation)) - 1).cast("int"))


def ctc_labels(df: DataFrame, keys: list[str], order: list[str], label: str, blank: str = "") -> DataFrame:
    """Rows where the label changes and is not the blank."""
    was = F.lag(label).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_was", was).where((F.col("_was").isNull() | (F.col("_was") != F.col(label))) & (F.col(label) != blank)).drop("_was")
