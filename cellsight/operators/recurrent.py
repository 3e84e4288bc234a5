"""A recurrent autoencoder of record windows, trained by synchronous gradient rounds.

A round is one job: every task runs the network over its windows and sums gradients, sums over tasks are grouped by parameter,
and the driver takes one Adam step over as many numbers as the network has parameters. Weights travel with the task's function;
their number follows from the layers and the columns, not from the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.operators.order import numbered, quantile
from cellsight.operators.storage import stored

#: Windows that a task runs through the network at a time.
BLOCK = 2048
#: Sums of a round that are no gradients.
LOSS, COUNT, HELD_LOSS, HELD_COUNT = -1, -2, -3, -4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Outputs of every step (windows, steps, units), and what the way back needs. Gates: input, forget, candidate, output."""
    n, steps, units = len(x), x.shape[1], wh.shape[0]
    h, c, out, trace = np.zeros((n, units)), np.zeros((n, units)), np.zeros((n, steps, units)), []
    for t in range(steps):
        z = x[:, t] @ wx + h @ wh + b
        i, f, g, o = _sigmoid(z[:, :units]), _sigmoid(z[:, units : 2 * units]), np.tanh(z[:, 2 * units : 3 * units]), _sigmoid(z[:, 3 * units :])
        before, c_before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        trace.append((i, f, g, o, tc, before, c_before))
    return out, trace


def _lstm_back(d_out: np.ndarray, x: np.ndarray, trace: list, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradients of the layer's input and of its three parameters."""
    dx, dwx, dwh, db = np.zeros_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1])
    dh, dc = np.zeros((len(x), wh.shape[0])), np.zeros((len(x), wh.shape[0]))
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, g, o, tc, before, c_before = trace[t]
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], axis=1)
        dwx += x[:, t].T @ dz
        dwh += before.T @ dz
        db += dz.sum(0)
        dx[:, t], dh, dc = dz @ wx.T, dz @ wh.T, dc * f
    return dx, [dwx, dwh, db]


class Network:
    """Layers and shapes; parameters are one flat vector."""

    def __init__(self, features: int, encoder: list[int], decoder: list[int]):
        self.features, self.encoder, self.decoder = features, list(encoder), list(decoder)
        self.shapes: list[tuple[int, ...]] = []
        width = features
        for units in [*self.encoder, *self.decoder]:
            self.shapes += [(width, 4 * units), (units, 4 * units), (4 * units,)]
            width = units
        self.shapes += [(width, features), (features,)]

    def start(self, seed: int) -> np.ndarray:
        """Uniform by fan-in and fan-out; biases 0, those of forget gates 1."""
        rng, parts = np.random.default_rng(seed), []
        for s in self.shapes:
            bound = np.sqrt(6 / sum(s))
            parts.append(rng.uniform(-bound, bound, s) if len(s) == 2 else np.zeros(s))
        for b in parts[2:-2:3]:
            b[len(b) // 4 : len(b) // 2] = 1.0
        return np.concatenate([p.ravel() for p in parts])

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return [p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), self.shapes)]

    def run(self, flat: np.ndarray, x: np.ndarray, dropout: float = 0.0, rng=None) -> tuple[np.ndarray, list]:
        """Reconstruction of windows (windows, steps, features), and the trace of every layer."""
        p, layers, steps = self.split(flat), [], x.shape[1]
        now = x
        for k in range(len(self.encoder) + len(self.decoder)):
            keep = (rng.random(now.shape) >= dropout) / (1 - dropout) if dropout and rng is not None else None
            given = now if keep is None else now * keep
            out, trace = _lstm(given, *p[3 * k : 3 * k + 3])
            layers.append((given, trace, keep))
            # the code is the last output of the encoder, given to every step of the decoder
            now = np.repeat(out[:, -1:], steps, axis=1) if k == len(self.encoder) - 1 else out
        return now @ p[-2] + p[-1], [*layers, now]

    def gradient(self, flat: np.ndarray, x: np.ndarray, dropout: float = 0.0, rng=None) -> tuple[float, np.ndarray]:
        """Sum over windows of the mean squared error, and its gradient."""
        p, (y, layers) = self.split(flat), self.run(flat, x, dropout, rng)
        size = x.shape[1] * x.shape[2]
        dy = 2 * (y - x) / size
        grads: list[np.ndarray] = [np.einsum("ntu,ntf->uf", layers[-1], dy), dy.sum((0, 1))]
        d = dy @ p[-2].T
        for k in range(len(self.encoder) + len(self.decoder) - 1, -1, -1):
            given, trace, keep = layers[k]
            if k == len(self.encoder) - 1:
                last = np.zeros_like(d)
                last[:, -1] = d.sum(1)
                d = last
            d, own = _lstm_back(d, given, trace, p[3 * k], p[3 * k + 1])
            d = d if keep is None else d * keep
            grads = own + grads
        return float(((y - x) ** 2).sum() / size), np.concatenate([g.ravel() for g in grads])


def _windows_of(pdf: pd.DataFrame, steps: int, features: int) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(float).reshape(len(pdf), steps, features)


def _round(net: Network, flat: np.ndarray, steps: int, dropout: float, seed: int):
    """Sums of a task: a row for each parameter, and losses and counts of the trained and the held windows."""

    def go(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        rng = np.random.default_rng([seed, context.partitionId() if context else 0])
        total, sums = np.zeros(len(flat)), {LOSS: 0.0, COUNT: 0.0, HELD_LOSS: 0.0, HELD_COUNT: 0.0}
        for pdf in batches:
            held = pdf["held"].to_numpy()
            x = _windows_of(pdf, steps, net.features)
            for at in range(0, len(x), BLOCK):
                block, out = x[at : at + BLOCK], held[at : at + BLOCK]
                if (~out).any():
                    loss, grad = net.gradient(flat, block[~out], dropout, rng)
                    total += grad
                    sums[LOSS] += loss
                    sums[COUNT] += int((~out).sum())
                if out.any():
                    y, _ = net.run(flat, block[out])
                    sums[HELD_LOSS] += float(((y - block[out]) ** 2).mean((1, 2)).sum())
                    sums[HELD_COUNT] += int(out.sum())
        if sums[COUNT] or sums[HELD_COUNT]:
            yield pd.DataFrame({"i": [*sums, *range(len(flat))], "s": [*sums.values(), *total]})

    return go


class RecurrentModel(Model):
    """A trained network with the scaling of its columns; ``history`` has the losses of every round, ``threshold`` cuts scores."""

    def __init__(self, columns, key, window, order, scale, net, weights, history, threshold=None):
        super().__init__()
        self.columns, self.key, self.window, self.order, self.scale = columns, key, window, order, scale
        self.net, self.weights, self.history, self.threshold = net, weights, history, threshold

    def windows(self, df: DataFrame) -> DataFrame:
        """``ids, v``: the keys of a window's records and their scaled values, one after another; a short window repeats its last record."""
        v = F.array(*[F.coalesce((F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in zip(self.columns, self.scale)])
        rows = df.select(F.col(self.key).alias("id"), v.alias("v"), *([F.col(self.order).alias("o")] if self.window > 1 else []))
        if self.window == 1:
            return rows.select(F.array("id").alias("ids"), "v")
        placed = numbered(rows, [], ["o", "id"], "n")
        own = placed.groupBy(F.floor(F.col("n") / self.window)).agg(F.array_sort(F.collect_list(F.struct("n", "id", "v"))).alias("w"))
        last = F.element_at("w", -1)["v"]
        v = F.concat(F.transform("w", lambda r: r["v"]), F.array_repeat(last, F.lit(self.window) - F.size("w")))
        return own.select(F.transform("w", lambda r: r["id"]).alias("ids"), F.flatten(v).alias("v"))

    def _transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``reconstruction``, the mean squared error of the record, and ``flag`` over the threshold."""
        net, flat, steps = self.net, self.weights, self.window

        def score(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _windows_of(pdf, steps, net.features)
                e = np.concatenate([((net.run(flat, x[i : i + BLOCK])[0] - x[i : i + BLOCK]) ** 2).mean(2) for i in range(0, len(x), BLOCK)])
                ids = pdf["ids"].tolist()
                yield pd.DataFrame({"id": [k for own in ids for k in own], "reconstruction": [s for own, row in zip(ids, e) for s in row[: len(own)]]})

        kind = dict(df.dtypes)[self.key]
        scored = self.windows(df).mapInPandas(score, f"id {kind}, reconstruction double").withColumnRenamed("id", "__id")
        flag = (F.col("reconstruction") > F.lit(self.threshold).cast("double")).cast("int")
        return df.join(scored, F.col(self.key) == F.col("__id")).drop("__id").withColumn("flag", flag)


class RecurrentAutoencoder(Estimator):
    """Two LSTM stacks around a code, fitted to rebuild windows of ``window`` records in order (1: each record by itself).

    Keys must be unique and not null; nulls take the column's mean. A fifth of the windows, by hash, is held out: the weights of
    the round with their least loss are kept, and ``patience`` rounds without a lesser one end the training. Records with an error
    over the ``percentile`` of the fitted table are flagged. An empty table gives the starting weights.
    """

    def __init__(self, columns, key, window=1, order=None, encoder=(64, 32), decoder=(32, 64), dropout=0.2, rounds=50, rate=0.01, held=0.2, patience=10, percentile=98.0, seed=42):
        super().__init__()
        self.columns, self.key, self.window, self.order = list(columns), key, window, order or key
        self.encoder, self.decoder, self.dropout, self.rounds, self.rate = list(encoder), list(decoder), dropout, rounds, rate
        self.held, self.patience, self.percentile, self.seed = held, patience, percentile, seed

    def _fit(self, df: DataFrame) -> RecurrentModel:
        r = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in self.columns], *[F.stddev_pop(F.col(f"`{c}`").cast("double")) for c in self.columns]).first()
        n = len(self.columns)
        scale = [(float(r[i] or 0.0), float(r[n + i] or 1.0)) for i in range(n)]
        net = Network(n, self.encoder, self.decoder)
        flat = best = net.start(self.seed)
        model = RecurrentModel(self.columns, self.key, self.window, self.order, scale, net, flat, [])
        h = F.pmod(F.xxhash64(F.lit(self.seed), F.col("ids")), F.lit(1_000_000))
        windows = stored(model.windows(df).withColumn("held", h < F.lit(int(self.held * 1_000_000))))
        m1, m2, least, waited = np.zeros(len(flat)), np.zeros(len(flat)), np.inf, 0
        for k in range(1, self.rounds + 1):
            sums = windows.select("v", "held").mapInPandas(_round(net, flat, self.window, self.dropout, self.seed + k), "i int, s double")
            got = sums.groupBy("i").agg(F.sum("s").alias("s")).toPandas().set_index("i")["s"].sort_index()  # a row for each parameter
            if got.empty or not got[COUNT]:
                break
            loss, held = got[LOSS] / got[COUNT], got[HELD_LOSS] / got[HELD_COUNT] if got[HELD_COUNT] else None
            judged = loss if held is None else held
            model.history.append((k, float(loss), float(judged)))
            if judged < least:
                least, best, waited = judged, flat, 0
            else:
                waited += 1
                if waited >= self.patience:
                    break
            grad = got.loc[0:].to_numpy() / got[COUNT]
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            flat = flat - self.rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-7)
        model.weights = best
        model.threshold = quantile(model.transform(df), "reconstruction", self.percentile / 100)
        return model
