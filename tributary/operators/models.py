"""Small models over feature vectors: an inert part for wiring, a multilayer perceptron, an autoencoder branch.

Training takes a bounded sample on the driver (NumPy); scoring is distributed, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.exprs import bucket_of
from tributary.operators.governance import Point
from tributary.operators.vectorise import FeatureSet, project

#: At most about so many rows are trained on.
MAX_TRAIN = 20_000


class Inert:
    """Pads or cuts its input to a width; as a classifier, every class alike."""

    def __init__(self, width: int) -> None:
        self.width = width

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        k = min(self.width, x.shape[1])
        out[:, :k] = x[:, :k]
        return out

    def probabilities(self, x: np.ndarray, classes: int) -> np.ndarray:
        return np.full((len(x), classes), 1.0 / classes)


#: Kinds of parts by name: whatever makes an encoder, a decoder and a head out of widths and a seed.
PARTS = Point("part")


def part(name: str):
    """A registered kind of parts, held to the contract: rows in, as many rows of the asked width out, a network's layers inside."""
    kind = PARTS.get(name)
    probe = np.zeros((2, 5))
    for role, made, width in (("encoder", kind.encoder(5, 3, 0), 3), ("decoder", kind.decoder(5, 4, 0), 4), ("head", kind.head(5, 2, 0), 2)):
        if not isinstance(made, Network):
            raise ValueError(f"part {name!r}: its {role} is no network")
        if made(probe).shape != (2, width):
            raise ValueError(f"part {name!r}: its {role} gives {made(probe).shape[1]} columns instead of {width}")
    return kind


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Network:
    """Dense layers with ReLU between them."""

    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, sizes: Sequence[int], seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        return cls([rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]])

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.weights) - 1 else z)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1]

    def step(self, x: np.ndarray, grad, state: dict, rate: float, frozen: int = 0) -> float:
        """One Adam step; grad(output) gives the loss and its gradient. The first `frozen` layers stay."""
        out = self.layers(x)
        loss, g = grad(out[-1])
        state["t"] = state.get("t", 0) + 1
        for i in range(len(self.weights) - 1, frozen - 1, -1):
            gw, gb = out[i].T @ g, g.sum(0)
            g = (g @ self.weights[i].T) * (out[i] > 0)
            for name, p, d in (("w", self.weights[i], gw), ("b", self.biases[i], gb)):
                m, s = state.get((name, i), (0.0, 0.0))
                m, s = 0.9 * m + 0.1 * d, 0.999 * s + 0.001 * d * d
                state[name, i] = (m, s)
                p -= rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(s / (1 - 0.999 ** state["t"])) + 1e-8)
        return loss


def cross_entropy(y: np.ndarray, weight: np.ndarray):
    def grad(z: np.ndarray):
        p = softmax(z)
        rows = np.arange(len(y))
        g = p.copy()
        g[rows, y] -= 1
        return float(-(weight * np.log(np.maximum(p[rows, y], 1e-12))).mean()), g * weight[:, None] / len(y)

    return grad


def squared(target: np.ndarray):
    return lambda z: (float(((z - target) ** 2).mean()), 2 * (z - target) / target.size)


def reconstruction(target: np.ndarray, fs: FeatureSet, phi: Mapping[str, float] | None = None):
    """Loss and gradient of reconstructed rows: squared error of numbers, cross entropy of flags and of each block of
    words, and, by the weight that phi gives a constraint, the square of what its target is off from its operands.

    Flags and words are reconstructed as logits. A constraint is judged in the encoded space of its target, on rows
    where its right side is not near zero.
    """
    at, of = {n: i for i, n in enumerate(fs.columns())}, {f.name: f for f in fs.numeric}
    numbers = [at[f.name] for f in fs.numeric]
    flags = [at[f"{f.name}__missing"] for f in fs.numeric if f.indicator]
    blocks = [[at[c] for c in f.columns()] for f in fs.categorical]
    n = len(target)

    def raw(z: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        f = of[name]
        v = np.clip(z[:, at[name]] * f.scale + f.centre, -15, 15)
        return (np.expm1(v), f.scale * np.exp(v)) if f.log else (v, np.full(n, f.scale))

    def grad(z: np.ndarray):
        g, loss = np.zeros_like(z), 0.0
        off = z[:, numbers] - target[:, numbers]
        loss += float((off**2).mean())
        g[:, numbers] = 2 * off / off.size
        if flags:
            y, x = target[:, flags], z[:, flags]
            loss += float((np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x)))).mean())
            g[:, flags] = (1 / (1 + np.exp(-np.clip(x, -500, 500))) - y) / x.size
        for b in blocks:
            p = softmax(z[:, b])
            loss += float(-(target[:, b] * np.log(np.maximum(p, 1e-12))).sum(1).mean())
            g[:, b] = (p * target[:, b].sum(1, keepdims=True) - target[:, b]) / n
        for c in fs.constraints:
            weight, f = (phi or {}).get(c.name, 0.0), of[c.target]
            if not weight:
                continue
            (left, dl), (right, dr) = raw(z, c.left), raw(z, c.right)
            fine = np.abs(right) > 1e-3 if c.kind == "ratio" else np.ones(n, bool)
            safe = np.where(fine, right, 1.0)
            want, by_left, by_right = (left / safe, 1 / safe, -left / safe**2) if c.kind == "ratio" else (left + right, np.ones(n), np.ones(n))
            up = want > 0 if f.log else np.ones(n, bool)
            goal = (np.log1p(np.where(up, want, 0.0)) - f.centre) / f.scale if f.log else (want - f.centre) / f.scale
            slope = up / (f.scale * (1 + np.where(up, want, 0.0))) if f.log else np.full(n, 1 / f.scale)
            e = np.where(fine, z[:, at[c.target]] - goal, 0.0)
            loss += weight * float((e**2).mean())
            step = 2 * weight * e / n
            g[:, at[c.target]] += step
            g[:, at[c.left]] -= step * slope * by_left * dl
            g[:, at[c.right]] -= step * slope * by_right * dr
        return loss, g

    return grad


def reconstruction_error(z: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((z - x) ** 2).mean(1)


def class_weights(y: np.ndarray, classes: int) -> np.ndarray:
    """Inverse frequency, 1 on average."""
    n = np.bincount(y, minlength=classes)
    return len(y) / (classes * np.maximum(n, 1))


def _epochs(net: Network, x: np.ndarray, make, epochs: int, seed: int, rate: float, frozen: int = 0, batch: int = 128) -> list[float]:
    rng, state, losses = np.random.default_rng(seed), {}, []
    for _ in range(epochs):
        order = rng.permutation(len(x))
        losses.append(float(np.mean([net.step(x[i], make(i), state, rate, frozen) for i in (order[k : k + batch] for k in range(0, len(x), batch))])))
    return losses


def train_classifier(x: np.ndarray, y: np.ndarray, classes: int, hidden: Sequence[int] = (64,), epochs: int = 15, seed: int = 0, rate: float = 2e-3, net: Network | None = None, frozen: int = 0) -> tuple[Network, list[float]]:
    net = net or Network.of([x.shape[1], *hidden, classes], seed)
    w = class_weights(y, classes)[y]
    return net, _epochs(net, x, lambda i: cross_entropy(y[i], w[i]), epochs, seed, rate, frozen)


class Dense:
    """Dense layers: an encoder and a decoder with a hidden layer each, a linear head."""

    name, hidden = "dense", 64

    def encoder(self, width: int, latent: int, seed: int) -> Network:
        return Network.of([width, self.hidden, latent], seed)

    def decoder(self, latent: int, width: int, seed: int) -> Network:
        return Network.of([latent, self.hidden, width], seed + 1)

    def head(self, latent: int, classes: int, seed: int) -> Network:
        return Network.of([latent, classes], seed)


class InertPart:
    """One linear layer that pads or cuts: what a labeller does without learning to encode."""

    name = "inert"

    @staticmethod
    def _plain(a: int, b: int) -> Network:
        return Network([np.eye(a, b)], [np.zeros(b)])

    def encoder(self, width: int, latent: int, seed: int) -> Network:
        return self._plain(width, latent)

    def decoder(self, latent: int, width: int, seed: int) -> Network:
        return self._plain(latent, width)

    def head(self, latent: int, classes: int, seed: int) -> Network:
        return Network([np.zeros((latent, classes))], [np.zeros(classes)])


for _kind in (Dense(), InertPart()):
    PARTS.register(_kind)


def joined(first: Network, second: Network) -> Network:
    return Network([w.copy() for w in (*first.weights, *second.weights)], [b.copy() for b in (*first.biases, *second.biases)])


def pretrain_autoencoder(x: np.ndarray, latent: int = 32, epochs: int = 10, seed: int = 0, rate: float = 1e-3, fs: FeatureSet | None = None, phi: Mapping[str, float] | None = None, kind: str = "dense") -> tuple[Network, list[float], int]:
    """An encoder and decoder in one network, its losses, and how many of its layers encode.

    With a feature set, numbers, flags, words and constraints are judged each in their own way.
    """
    made = part(kind)
    encoder = made.encoder(x.shape[1], latent, seed)
    net = joined(encoder, made.decoder(latent, x.shape[1], seed))
    loss = (lambda i: reconstruction(x[i], fs, phi)) if fs else (lambda i: squared(x[i]))
    return net, _epochs(net, x, loss, epochs, seed, rate), len(encoder.weights)


@dataclass
class Branch:
    """A behavioural labeller: an autoencoder's encoder with a head, tuned with the encoder frozen, then free."""

    classes: list[str]
    network: Network
    decoder: Network
    losses: list[float]


def fit_branch(x: np.ndarray, labels: Sequence[str], seed: int = 0, epochs: int = 8, fs: FeatureSet | None = None, phi: Mapping[str, float] | None = None, kind: str = "dense", latent: int = 32) -> Branch:
    classes = sorted(set(labels))
    y = np.searchsorted(classes, labels)
    auto, losses, encodes = pretrain_autoencoder(x, latent, epochs, seed, fs=fs, phi=phi, kind=kind)
    encoder = Network(auto.weights[:encodes], auto.biases[:encodes])
    net = joined(encoder, part(kind).head(latent, len(classes), seed))
    net, frozen = train_classifier(x, y, len(classes), net=net, frozen=encodes, epochs=epochs, seed=seed)
    net, free = train_classifier(x, y, len(classes), net=net, epochs=epochs, seed=seed)
    return Branch(classes, net, auto, losses + frozen + free)


def bounded_sample(vectors: DataFrame, most: int = MAX_TRAIN) -> pd.DataFrame:
    """At most about `most` rows, the same on every run, in key order."""
    total = vectors.count()
    if total > most:
        vectors = vectors.where(bucket_of("sample", F.col("uid"), 1_000_000) < int(1_000_000 * most / total))
    return vectors.toPandas().sort_values("uid").reset_index(drop=True)


def predict(vectors: DataFrame, branch: Branch) -> DataFrame:
    """uid, label_class, label_confidence, label_margin, recon_error of rows (uid, features)."""

    def over(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["features"].to_numpy())
            p = softmax(branch.network(x))
            top = np.sort(p, 1)
            margin = top[:, -1] - top[:, -2] if p.shape[1] > 1 else top[:, -1]
            yield pd.DataFrame({"uid": pdf["uid"], "label_class": np.array(branch.classes)[p.argmax(1)], "label_confidence": top[:, -1], "label_margin": margin, "recon_error": reconstruction_error(branch.decoder(x), x)})

    return vectors.select("uid", "features").mapInPandas(over, "uid string, label_class string, label_confidence double, label_margin double, recon_error double")


def class_sample(vectors: DataFrame, most: int = MAX_TRAIN) -> pd.DataFrame:
    """At most about `most` rows with as many of each class, the same on every run, in key order; no class is left out."""
    known = vectors.where("label_class is not null")
    classes = known.select("label_class").distinct().count()
    return reservoirs(known, "sample", max(1, most // max(1, classes))).toPandas().sort_values("uid").reset_index(drop=True)


def out_of_fold(vectors: DataFrame, folds: int = 5, seed: str = "fold", epochs: int = 8, most: int = MAX_TRAIN) -> DataFrame:
    """key, label (index among the classes in order), probs of every row (uid, features, label_class), by a model that did not see its fold.

    Rows without a label have none to trust and are left out.
    """
    fold = bucket_of(seed, F.col("uid"), folds)
    vectors = vectors.where("label_class is not null").withColumn("fold", fold.cast("int"))
    sample = class_sample(vectors, most)
    classes = sorted(sample["label_class"].unique())
    x, y = np.stack(sample["features"].to_numpy()), np.searchsorted(classes, sample["label_class"])
    nets = [train_classifier(x[(sample["fold"] != k).to_numpy()], y[(sample["fold"] != k).to_numpy()], len(classes), epochs=epochs, seed=k)[0] for k in range(folds)]

    def over(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            out = np.zeros((len(pdf), len(classes)))
            x = np.stack(pdf["features"].to_numpy())
            for k in range(folds):
                mine = (pdf["fold"] == k).to_numpy()
                out[mine] = softmax(nets[k](x[mine]))
            yield pd.DataFrame({"key": pdf["uid"], "label": np.searchsorted(classes, pdf["label_class"]).astype(np.int32), "probs": list(out)})

    return vectors.mapInPandas(over, "key string, label int, probs array<double>")


def reservoirs(df: DataFrame, seed: str, size: int = 4096) -> DataFrame:
    """At most `size` rows of each class, chosen by a seeded hash: what a reservoir holds, without its order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label_class").orderBy(bucket_of(seed, F.col("uid"), 1 << 40), "uid"))
    return df.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r")


def views(x: np.ndarray, donors: np.ndarray, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two views of each row: each replaces a share of columns, no column in both, by those of a donor row."""
    pick = rng.random(x.shape)
    donor = donors[rng.integers(0, len(donors), len(x))]
    return np.where(pick < rate, donor, x), np.where(pick >= 1 - rate, donor, x)


def nt_xent(a: np.ndarray, b: np.ndarray, temperature: float = 0.5) -> float:
    """Contrastive loss of paired views."""
    z = np.concatenate((a, b))
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    n = len(a)
    pair = np.concatenate((np.arange(n, 2 * n), np.arange(n)))
    top = s.max(1)
    return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(2 * n), pair]).mean())


def contrast(temperature: float = 0.5):
    """Loss and gradient of paired views whose embeddings are stacked, first views first."""

    def grad(z: np.ndarray):
        size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        u, n = z / size, len(z) // 2
        s = u @ u.T / temperature
        np.fill_diagonal(s, -np.inf)
        pair = np.concatenate((np.arange(n, 2 * n), np.arange(n)))
        p = softmax(s)
        loss = float(-np.log(np.maximum(p[np.arange(2 * n), pair], 1e-12)).mean())
        p[np.arange(2 * n), pair] -= 1
        g = (p + p.T) @ u / (temperature * 2 * n)
        return loss, (g - (g * u).sum(1, keepdims=True) * u) / size

    return grad


def fit_contrastive(x: np.ndarray, labels: Sequence[str], fs: FeatureSet | None = None, seed: int = 0, rounds: int = 3, epochs: int = 3, rate: float = 0.15, latent: int = 32, settle: float = 0.01, reserve: tuple[np.ndarray, Sequence[str]] | None = None) -> "ContrastiveBranch":
    """A labeller from contrastive views: each takes columns from a donor of the row's class and keeps constraints.

    Donors come from `reserve`, rows and labels of class reservoirs (see reservoirs()), else from the rows themselves. After
    each round classes are predicted anew, of donors too; it ends when few of them change.
    """
    rng, classes = np.random.default_rng(seed), sorted(set(labels))
    y = np.searchsorted(classes, labels)
    pool_x, held = (x, y) if reserve is None else (reserve[0], np.searchsorted(classes, reserve[1]))
    encoder, now, losses, net = Network.of([x.shape[1], 64, latent], seed), y, [], None
    fix = (lambda v: project(v, fs)) if fs else (lambda v: v)
    for _ in range(rounds):
        donors = {k: pool_x[held == k] for k in range(len(classes))}
        state: dict = {}
        for _ in range(epochs):
            order, each = rng.permutation(len(x)), []
            for i in (order[k : k + 256] for k in range(0, len(x), 256)):
                pool = np.stack([d[rng.integers(len(d))] if len(d := donors[c]) else x[r] for r, c in zip(i, now[i])])
                pick = rng.random((len(i), x.shape[1]))
                a, b = fix(np.where(pick < rate, pool, x[i])), fix(np.where(pick >= 1 - rate, pool, x[i]))
                each.append(encoder.step(np.concatenate((a, b)), contrast(), state, 1e-3))
            losses.append(float(np.mean(each)))
        head = Network.of([latent, len(classes)], seed)
        # The encoder's last layer is linear; in the classifier its output passes a ReLU before the head.
        net = Network([w.copy() for w in encoder.weights] + head.weights, [b.copy() for b in encoder.biases] + head.biases)
        net, _ = train_classifier(x, y, len(classes), net=net, frozen=2, epochs=epochs, seed=seed)
        net, _ = train_classifier(x, y, len(classes), net=net, epochs=epochs, seed=seed)
        new = net(x).argmax(1)
        changed, now, held = float((new != now).mean()), new, net(pool_x).argmax(1)
        if changed <= settle:
            break
    return ContrastiveBranch(classes, net, losses, rate, x[rng.permutation(len(x))[:512]])


@dataclass
class ContrastiveBranch:
    classes: list[str]
    network: Network
    losses: list[float]
    rate: float
    donors: np.ndarray


def predict_contrastive(vectors: DataFrame, branch: ContrastiveBranch) -> DataFrame:
    """uid, label_class, label_confidence, label_margin, view_agreement (whether a view with replaced columns gets the same class)."""

    def over(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["features"].to_numpy())
            p = softmax(branch.network(x))
            top = np.sort(p, 1)
            # A row's view depends on the row alone, so that a task run again gives the same.
            h = (np.abs(x).sum(1) * 1e6).astype(np.int64)
            rows = branch.donors[h % len(branch.donors)]
            mask = ((h[:, None] * 2654435761 + np.arange(x.shape[1]) * 40503) % 1000) < 1000 * branch.rate
            same = branch.network(np.where(mask, rows, x)).argmax(1) == p.argmax(1)
            margin = top[:, -1] - top[:, -2] if p.shape[1] > 1 else top[:, -1]
            yield pd.DataFrame({"uid": pdf["uid"], "label_class": np.array(branch.classes)[p.argmax(1)], "label_confidence": top[:, -1], "label_margin": margin, "view_agreement": same.astype(float)})

    return vectors.select("uid", "features").mapInPandas(over, "uid string, label_class string, label_confidence double, label_margin double, view_agreement double")


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """compared, changed: flows whose label differs between two rounds."""
    both = before.select("uid", F.col("label_class").alias("a")).join(after.select("uid", F.col("label_class").alias("b")), "uid")
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


class Behavioural:
    name = "behavioural"

    def label(self, vectors: DataFrame, fs: FeatureSet, **options) -> DataFrame:
        sample = class_sample(vectors, options.pop("most", MAX_TRAIN))
        return predict(vectors, fit_branch(np.stack(sample["features"].to_numpy()), sample["label_class"].tolist(), fs=fs, **options))


class Contrastive:
    name = "contrastive"

    def label(self, vectors: DataFrame, fs: FeatureSet, **options) -> DataFrame:
        sample = class_sample(vectors, options.pop("most", MAX_TRAIN))
        held = reservoirs(vectors.where("label_class is not null"), "donors", options.pop("reservoir", 4_096)).toPandas().sort_values("uid")
        reserve = (np.stack(held["features"].to_numpy()), held["label_class"].tolist())
        return predict_contrastive(vectors, fit_contrastive(np.stack(sample["features"].to_numpy()), sample["label_class"].tolist(), fs, reserve=reserve, **options))


#: Labellers by name: each labels rows (uid, features, label_class) by a model of some of them.
LABELLERS = Point("labeller")
for _labeller in (Behavioural(), Contrastive()):
    LABELLERS.register(_labeller)
