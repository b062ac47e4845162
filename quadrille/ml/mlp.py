"""A small multi-layer perceptron in numpy: exclusive labels (softmax) or one binary output."""

from __future__ import annotations

import json

import numpy as np


class MLP:
    def __init__(self, inputs: int, hidden: list[int], labels: list[str], kind: str = "exclusive", seed: int = 0):
        rng = np.random.default_rng(seed)
        self.kind, self.labels = kind, list(labels)
        sizes = [inputs, *hidden, len(labels) if kind == "exclusive" else 1]
        self.weights = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.biases = [np.zeros(b) for b in sizes[1:]]
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [(x - self.mean) / self.scale]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.weights) - 1 else z)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._forward(x)[-1]
        if self.kind == "exclusive":
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, loss="cross_entropy", optimizer="adam", rate=0.01, epochs=50, batch=32, seed=0) -> float:
        """y: label numbers, or 0/1 for binary.  Gives the last mean loss."""
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
        target = np.eye(len(self.labels))[y] if self.kind == "exclusive" else y.reshape(-1, 1).astype(float)
        return self.fit_gradient(x, lambda p, rows: _loss(loss, p, target[rows]), optimizer, rate, epochs, batch, seed, logits=loss != "mse")

    def fit_gradient(self, x, losses, optimizer="adam", rate=0.01, epochs=50, batch=32, seed=0, logits=True) -> float:
        """losses(probabilities, rows) -> (mean loss, gradient by probability, or by logit)."""
        rng = np.random.default_rng(seed)
        params = self.weights + self.biases
        m, v, step, last = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0.0
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                acts = self._forward(x[rows])
                p = self.probabilities(x[rows])
                value, g = losses(p, rows)
                total += value * len(rows)
                if not logits:
                    g = p * (g - (g * p).sum(axis=1, keepdims=True)) if self.kind == "exclusive" else g * p * (1 - p)
                grads_w, grads_b = [None] * len(self.weights), [None] * len(self.weights)
                for k in range(len(self.weights) - 1, -1, -1):
                    grads_w[k], grads_b[k] = acts[k].T @ g / len(rows), g.mean(axis=0)
                    if k:
                        g = (g @ self.weights[k].T) * (acts[k] > 0)
                step += 1
                for j, (q, d) in enumerate(zip(params, grads_w + grads_b)):
                    if optimizer == "sgd":
                        q -= rate * d
                    else:
                        m[j] = 0.9 * m[j] + 0.1 * d
                        v[j] = 0.999 * v[j] + 0.001 * d * d
                        q -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
            last = total / max(len(x), 1)
        return last

    def dump(self) -> str:
        return json.dumps({"kind": self.kind, "labels": self.labels, "weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases], "mean": self.mean.tolist(), "scale": self.scale.tolist()})

    @staticmethod
    def load(text: str) -> MLP:
        d = json.loads(text)
        out = MLP(len(d["mean"]), [], d["labels"], d["kind"])
        out.weights, out.biases = [np.array(w) for w in d["weights"]], [np.array(b) for b in d["biases"]]
        out.mean, out.scale = np.array(d["mean"]), np.array(d["scale"])
        return out


def _loss(name: str, p: np.ndarray, t: np.ndarray):
    """Mean loss and its gradient: by logit for the logarithmic ones, by probability for mse."""
    if name == "mse":
        return float(((p - t) ** 2).sum(axis=1).mean()), 2 * (p - t)
    q = np.clip(p, 1e-12, 1 - 1e-12)
    if name == "bce" or p.shape[1] == 1:
        return float(-(t * np.log(q) + (1 - t) * np.log(1 - q)).sum(axis=1).mean()), p - t
    return float(-(t * np.log(q)).sum(axis=1).mean()), p - t
