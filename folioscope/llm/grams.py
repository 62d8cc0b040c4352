"""Hashed character n-grams and the linear learner that the text classifiers share."""

import numpy as np

BLOCK = 1 << 20


def gram_blocks(text, low, high, bits):
    """Bucket numbers of all n-grams, low <= n <= high, of the lower-cased text with a space at either end; in blocks, so
    that a very long text needs little memory."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + high - 1]
        hashes = part * np.uint32(0x9E3779B1)
        for n in range(1, high + 1):
            if n > 1:
                if len(part) < n:
                    break
                hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + part[n - 1 :] * np.uint32(0xC2B2AE35)
            if n >= low:
                yield ((hashes[:BLOCK] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits)).astype(np.int64)


def gram_counts(text, low, high, bits):
    """(bucket, how often) of the n-grams that occur."""
    total = np.zeros(1 << bits, dtype=np.int64)
    for block in gram_blocks(text, low, high, bits):
        total += np.bincount(block, minlength=1 << bits)
    found = np.flatnonzero(total)
    return found, total[found]


def gram_set(text, low, high, bits, wanted=None):
    """Distinct buckets, only those of the mask `wanted` if given."""
    seen = np.zeros(1 << bits, dtype=bool)
    for block in gram_blocks(text, low, high, bits):
        seen[block if wanted is None else block[wanted[block]]] = True
    return np.flatnonzero(seen)


def softmax(logits):
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression, follow-the-regularised-leader with L1 and L2 penalties per coordinate."""

    def __init__(self, features, classes, alpha=0.3, beta=1.0, l1=1e-4, l2=1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))  # the last row is the intercept

    def weights(self, rows=slice(None)):
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, rows, values, target):
        rows, values = np.append(rows, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(rows)
        error = softmax(values @ w)
        error[target] -= 1
        g = values[:, None] * error[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g

    def fit(self, examples, epochs):
        """examples: (rows, values, class), in a fixed order."""
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                self.learn(*examples[k])
        return self.weights()


def logits(weights, rows, values):
    return values @ weights[rows] + weights[-1]


def temperature(scores, targets):
    """The divisor of the logits with the least log loss on held-back examples."""
    if not len(scores):
        return 1.0
    scores, targets = np.asarray(scores), np.asarray(targets)
    grid = np.geomspace(0.05, 20, 200)
    loss = [-np.log(softmax(scores / t)[np.arange(len(targets)), targets] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
