"""URL filter: all glob rules at once as one bit-parallel wildcard automaton.

A url's canonical form is its lower-cased host after a dot, then its path (`.www.example.com/en/1`). A rule is a host and
a path; it fits the host and its subdomains if the path starts with the rule's. As globs on the canonical form: `%` stands
for any run within the host, `*` for any run, `?` for one character; every other character is literal.

Every glob of m tokens takes m + 1 neighbouring bits of a state of as many 64-bit words as all rules need. Bit i says that
the first i tokens are matched; reading a byte is one shift with carry and two masks per word (extended Shift-And). The
state of many urls advances together, one byte a step; urls are dealt by length into blocks of bounded size.

The fitting rule with the longest text wins (then the first given); a url that no rule fits gets the default verdict. A
null url, or one without `://`, has an empty host and path, which no rule fits. Repeated rows are judged alike; other
columns are passed over; an empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    glob: str

    @staticmethod
    def site(verdict, host_and_path):
        host, slash, path = host_and_path.partition("/")
        return Rule(verdict, host_and_path, f"%.{host}{slash}{path}*")


def tokens(glob):
    """(bytes it accepts or None for a run, bytes of the run) of each token."""
    everything = np.ones(256, dtype=bool)
    in_host = everything.copy()
    in_host[ord("/")] = False
    for c in glob:
        if c in "*%":
            yield None, everything if c == "*" else in_host
        elif c == "?":
            yield everything, None
        else:
            for b in c.encode():
                one = np.zeros(256, dtype=bool)
                one[b] = True
                yield one, None


class Automaton:
    def __init__(self, rules):
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        step, loop, first, last = [], [], [], []
        for rule in self.rules:
            first.append(len(step))
            step.append(np.zeros(256, dtype=bool))
            loop.append(np.zeros(256, dtype=bool))
            for accepts, run in tokens(rule.glob):
                if accepts is None:
                    loop[-1] = loop[-1] | run
                else:
                    step.append(accepts)
                    loop.append(np.zeros(256, dtype=bool))
            last.append(len(step) - 1)
        self.words = -(-max(len(step), 1) // 64)
        self.step, self.loop = self.packed(step), self.packed(loop)
        self.first, self.last = np.array(first, dtype=int), np.array(last, dtype=int)
        self.start = np.zeros(self.words, dtype=np.uint64)
        for b in first:
            self.start[b // 64] |= np.uint64(1) << np.uint64(b % 64)

    def packed(self, bits):
        """masks[byte, word]"""
        masks = np.zeros((256, self.words), dtype=np.uint64)
        for b, accepts in enumerate(bits):
            masks[accepts, b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return masks

    def run(self, subjects):
        """For byte strings: number of the first rule that fits each, or -1."""
        found = np.full(len(subjects), -1)
        if not self.rules:
            return found
        sizes = np.array([len(s) for s in subjects], dtype=int)
        order = np.argsort(sizes, kind="stable")
        while len(order):
            count = max(1, BLOCK_BYTES // max(1, int(sizes[order[-1]])))
            rows = order[max(0, len(order) - count) :]
            found[rows] = self.block([subjects[k] for k in rows], sizes[rows])
            order = order[: len(order) - len(rows)]
        return found

    def block(self, subjects, sizes):
        state = np.repeat(self.start[None, :], len(subjects), axis=0)
        text = np.zeros((len(subjects), int(sizes.max(initial=0))), dtype=np.uint8)
        for k, s in enumerate(subjects):
            text[k, : len(s)] = np.frombuffer(s, np.uint8)
        for at in range(text.shape[1]):
            live = int(np.searchsorted(sizes, at, "right"))  # sizes ascend: the rows from here on are longer than `at`
            now, byte = state[live:], text[live:, at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[live:] = (moved & self.step[byte]) | (now & self.loop[byte])
        hit = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1)
        return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


def judge(pages: DataFrame, rules, default="allow", url="url") -> DataFrame:
    """Add host, path, rule and verdict."""
    shared = pages.sparkSession.sparkContext.broadcast(list(rules))

    @F.pandas_udf("rule string, verdict string")
    def verdict(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        automaton = Automaton(shared.value)
        found = automaton.run([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
        names = [automaton.rules[k].name if k >= 0 else None for k in found]
        return pd.DataFrame({"rule": pd.Series(names, dtype=object), "verdict": [automaton.rules[k].verdict if k >= 0 else default for k in found]})

    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER)
    parted = pages.withColumn("host", host).withColumn("path", F.regexp_extract(text, PARTS, 2))
    return parted.withColumn("judged", verdict("host", "path")).select(*parted.columns, "judged.rule", "judged.verdict")
