"""Best subsets of many predictors by branch and bound.

``regress.all_subsets`` lists all 2^k models; here k may be 25 and more.  One
Gram row per key holds all that is needed.  A node of the search is a set of
predictors F with some of them, U, still free to go; its subtree holds F minus
any part of U.  Two facts bound it without visiting it:

* leaving out predictors never lowers the sum of squared errors, and
* a model without j has at least the error of F without j, which follows from
  the fit of F alone (b_j^2 / (X'X)^-1_jj).

So a model of the subtree that leaves out m predictors has at least the m-th
smallest of those errors, and the least AICc over m bounds the subtree; it is
cut if that exceeds the worst of the best models found so far (the start is
what backward elimination meets).  Going from F to F without j is one sweep,
O(k^2), of the inverse.

The subtrees that differ in the ``2**SPLIT`` choices about the strongest
predictors are rows of their own, so one key keeps many tasks busy.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.operators.regress import _pivoted, _subset_label, check_keys, gram
from wardcast.session import ship_package

SPLIT = 3


def aicc(sse: float, n: float, k: int) -> float:
    """AICc of a model with k predictors and an intercept; infinite where undefined."""
    room = n - k - 3
    if room <= 0:
        return math.inf
    if sse <= 0:
        return -math.inf
    return n * math.log(sse / n) + 2 * (k + 2) + 2 * (k + 2) * (k + 3) / room


class Search:
    """Branch and bound over the predictors of one key (a scaled system R b = r, total sum of squares 1)."""

    def __init__(self, corr: np.ndarray, r: np.ndarray, n: float, top: int):
        self.n, self.top = n, top
        self.best: list[tuple[float, tuple[int, ...]]] = []   # heap with the worst in front
        self.known: set[tuple[int, ...]] = set()
        self.nodes = 0
        p = len(r)
        self.inv = np.linalg.inv(corr) if p else np.zeros((0, 0))
        self.beta = self.inv @ r
        self.sse = max(1.0 - float(self.beta @ r), 0.0)

    def offer(self, value: float, members: tuple[int, ...]) -> None:
        if members in self.known or value == math.inf:
            return
        if len(self.best) < self.top:
            self.known.add(members)
            heapq.heappush(self.best, (-value, members))
        elif value < -self.best[0][0]:
            self.known.add(members)
            self.known.discard(heapq.heapreplace(self.best, (-value, members))[1])

    @property
    def limit(self) -> float:
        return -self.best[0][0] if len(self.best) == self.top else math.inf

    def without(self, ids, inv, beta, sse, at):
        """The fit of F without its ``at``-th member (one sweep)."""
        keep = np.delete(np.arange(len(ids)), at)
        col, pivot = inv[keep, at], inv[at, at]
        return ([ids[i] for i in keep], inv[np.ix_(keep, keep)] - np.outer(col, col) / pivot,
                beta[keep] - col * (beta[at] / pivot), sse + beta[at] ** 2 / pivot)

    def backward(self) -> None:
        """Models on and beside the path of backward elimination: a first limit."""
        ids, inv, beta, sse = list(range(len(self.beta))), self.inv, self.beta, self.sse
        self.offer(aicc(sse, self.n, len(ids)), tuple(ids))
        while ids:
            drop = beta ** 2 / np.diag(inv)
            for at, d in enumerate(drop.tolist()):
                self.offer(aicc(sse + d, self.n, len(ids) - 1), tuple(i for i in ids if i != ids[at]))
            ids, inv, beta, sse = self.without(ids, inv, beta, sse, int(drop.argmin()))

    def bound(self, size: int, sse: float, drops) -> float:
        """Least AICc of F and of F without any of the predictors with these
        (ascending) rises of the error."""
        least = aicc(sse, self.n, size)
        for m, d in enumerate(drops, 1):
            least = min(least, aicc(sse + d, self.n, size - m))
        return least

    def visit(self, ids, inv, beta, sse, free: list[int]) -> None:
        """F = ids; ``free`` are the members that may still go."""
        self.nodes += 1
        self.offer(aicc(sse, self.n, len(ids)), tuple(ids))
        if not free:
            return
        place = {j: at for at, j in enumerate(ids)}
        rise = beta ** 2 / np.diag(inv)
        order = sorted(free, key=lambda j: -rise[place[j]])
        # the child without order[i] may lose the weaker ones after it as well: the strongest has the
        # most of them and, by its own rise, is cut the soonest
        for i, j in enumerate(order):
            later = order[i + 1:]
            if self.bound(len(ids) - 1, sse + float(rise[place[j]]), [0.0] * len(later)) <= self.limit:
                self.visit(*self.without(ids, inv, beta, sse, place[j]), later)

    def run(self, out: tuple[int, ...], fixed: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
        """The best models without ``out`` and with ``fixed``."""
        self.backward()
        ids, inv, beta, sse = list(range(len(self.beta))), self.inv, self.beta, self.sse
        for j in out:
            ids, inv, beta, sse = self.without(ids, inv, beta, sse, ids.index(j))
        free = [j for j in ids if j not in fixed]
        if self.bound(len(ids), sse, np.sort((beta ** 2 / np.diag(inv))[[ids.index(j) for j in free]]).tolist()) <= self.limit:
            self.visit(ids, inv, beta, sse, free)
        mine = [(-v, m) for v, m in self.best if not set(out) & set(m) and set(fixed) <= set(m)]
        return sorted(mine)


def _systems(row, p: int):
    """Kept columns, their correlations, correlations with y, scale of y."""
    sxx, sxy = np.asarray(row.sxx, float).reshape(p, p), np.asarray(row.sxy, float)
    mid = np.asarray(row.mid, float)
    diag = np.diag(sxx).copy()
    diag[diag <= 1e-24 * (diag + row.n * mid ** 2)] = 0.0
    scale = np.sqrt(np.where(diag > 0, diag, 1.0))
    corr = np.where(np.outer(diag > 0, diag > 0), sxx / np.outer(scale, scale), 0.0)
    kept = _pivoted(corr, range(p))
    return kept, corr[np.ix_(kept, kept)], (sxy / scale)[kept] / math.sqrt(row.syy) if row.syy > 0 else None


def best_subsets(df: DataFrame, keys: list[str], y: str, xcols: list[str], top: int = 10) -> DataFrame:
    """The ``top`` models of least AICc per key: model, k, sse, aicc,
    rank_aicc.  Predictors that are constant or follow from earlier ones
    belong to no model; keys whose y is constant have none.  A key needs five
    observations more than predictors: with fewer, errors near zero bound
    nothing, and it is an error rather than a search of all 2^k models."""
    check_keys(keys, {"model", "k", "sse", "aicc", "rank_aicc"})
    ship_package(df.sparkSession)
    p, split = len(xcols), min(SPLIT, len(xcols))
    # every key's subtrees are dealt out anew: rows are few, their work is not
    g = gram(df, keys, y, xcols, True).select("*", F.explode(F.sequence(F.lit(0), F.lit(2 ** split - 1))).alias("_part"))
    g = g.repartition(*keys, "_part")
    schema = T.StructType([g.schema[k] for k in keys] + [
        T.StructField("model", T.StringType()), T.StructField("k", T.IntegerType()),
        T.StructField("sse", T.DoubleType()), T.StructField("aicc", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for at, row in enumerate(pdf.itertuples(index=False)):
                kept, corr, r = _systems(row, p)
                part = int(pdf["_part"].iloc[at])
                if r is None or part >= 2 ** min(split, len(kept)):
                    continue
                if row.n < len(kept) + 5:
                    raise ValueError(f"{row.n} observations are too few for {len(kept)} predictors")
                s = Search(corr, r, float(row.n), top)
                strong = np.argsort(-(s.beta ** 2 / np.diag(s.inv)), kind="stable")[:split].tolist() if kept else []
                out = tuple(j for i, j in enumerate(strong) if part >> i & 1)
                fixed = tuple(j for j in strong if j not in out)
                key = [None if pd.isna(v) else v for v in pdf[keys].iloc[at]] if keys else []
                for value, members in s.run(out, fixed):
                    names = sorted(kept[j] for j in members)
                    sse = row.n * math.exp((value - 2 * (len(names) + 2) - 2 * (len(names) + 2) * (len(names) + 3)
                                            / (row.n - len(names) - 3)) / row.n) if value > -math.inf else 0.0
                    rows.append((*key, _subset_label(xcols, names), len(names), sse * row.syy, value + row.n * math.log(row.syy)))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    found = g.mapInPandas(run, schema)
    # at most 2**SPLIT * top rows a key
    w = W.partitionBy(*keys).orderBy("aicc", "model")
    return found.withColumn("rank_aicc", F.row_number().over(w).cast("int")).filter(F.col("rank_aicc") <= top)
