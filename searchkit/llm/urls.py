"""URL filters: host and path rules, and gradient-boosted trees on lexical features; DataFrame functions only.

A rule (a domain with an optional path) fits its host and all subdomains if the URL's
path starts with the rule's; the longest that fits decides. Other URLs get the
verdict of boosted trees trained from labelled URLs: those that a rule blocks are the bad
examples, those that a rule allows the good ones; a URL without a rule teaches nothing.

Features: length, path depth, share of digits and of other signs, character entropy,
query parameters, length of the last path segment, and suffix statistics: the share of
all URLs that the host's last two labels have, and the share of blocked ones among the labelled
URLs of these labels, and of the first path segment. Statistics are counted over all URLs.
A labelled URL doesn't see those of its own fold (hosts are dealt to FOLDS folds), so no
feature holds its own label, or a label of its host.

The trees are fitted on the labelled URLs, binned and counted (a bounded sample of them,
TRAIN_ROWS, of which one collect brings the distinct rows with their counts). They are fitted
once for each fold left out, which gives every labelled URL a score by trees that haven't seen
its host; the threshold is the one that tells both classes best on these scores, and `auc` is
measured on them. Then all labelled URLs fit the trees that are used, which become one nested
CASE expression: scoring is a projection over the scan.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule
and is judged by its features; where rules label URLs of one verdict only, or none, nothing
can be learnt and what no rule fits is allowed; very long URLs fall into the last bins; of
splits that gain equally the first feature and lowest bin is taken; repeated rows are judged
row by row; an empty table gives an empty result; columns of the names that the operator
adds are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.llm.common import checkpoint, let, lower_ascii, sampled, table, without

#: (verdict, host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRAIN_ROWS = 50_000
TREES, DEPTH, RATE, RIDGE = 20, 3, 0.3, 1.0
BINS, FOLDS = 16, 5
ADDED = ("host", "path", "rule", "verdict", "score")
#: Each feature and the width of its bins; values beyond the last bin fall into it.
FEATURES = {
    "f_length": 8.0, "f_depth": 1.0, "f_digits": 0.04, "f_signs": 0.03, "f_entropy": 0.3,
    "f_params": 1.0, "f_last": 3.0, "f_suffix_share": 1.0, "f_suffix_blocked": 0.0625, "f_segment_blocked": 0.0625,
}


def parts(url: str | Column = "url") -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path of a URL; empty without `://`."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _lexical(url: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1))
    only = lambda pattern: F.length(F.regexp_replace(url, pattern, ""))
    query = F.regexp_extract(url, "[?]([^#]*)", 1)

    def entropy(shares: Column) -> Column:
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    # The share of each distinct character: what the URL loses without it.
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)

    return {
        "f_length": F.length(url).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "f_digits": only("[^0-9]") / n,
        "f_signs": only("[A-Za-z0-9/:.]") / n,
        "f_entropy": F.when(url == "", F.lit(0.0)).otherwise(let(F.filter(shares, lambda p: p > 0), entropy)),
        "f_params": F.when(query == "", F.lit(0.0)).otherwise(F.size(F.split(query, "&")).cast("double")),
        "f_last": F.length(F.regexp_extract(path, "([^/]*)/*$", 1)).cast("double"),
    }


def _binned(name: str) -> Column:
    return F.least(F.greatest(F.floor(F.col(name) / FEATURES[name]), F.lit(0)), F.lit(BINS - 1)).cast("int")


@dataclass
class Trees:
    """Boosted trees: per tree a dict node -> (feature, bin) or node -> leaf value; children of k are 2k+1 (bin at most) and 2k+2.

    `threshold` is taken off the logit, so that a score of 0.5 or more means block; `auc` is that of the scores out of fold.
    """

    base: float
    trees: list[dict] = field(default_factory=list)
    threshold: float = 0.0
    auc: float | None = None

    def logit(self) -> Column:
        def at(tree: dict, k: int) -> Column:
            if not isinstance(tree[k], tuple):
                return F.lit(float(tree[k]))
            feature, cut = tree[k]
            return F.when(F.col(feature) <= cut, at(tree, 2 * k + 1)).otherwise(at(tree, 2 * k + 2))

        return sum((at(tree, 0) for tree in self.trees), F.lit(self.base - self.threshold))

    def logits(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        """The same of binned features on the driver."""
        n = len(next(iter(cells.values())))
        out = np.full(n, self.base - self.threshold)
        for tree in self.trees:
            out += np.array([tree[k] for k in _nodes(tree, cells, n).tolist()])
        return out


def _nodes(tree: dict, cells: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The deepest node of a (growing) tree that each row reaches."""
    node = np.zeros(n, np.int64)
    while True:
        inner = [k for k in np.unique(node).tolist() if isinstance(tree.get(k), tuple)]
        if not inner:
            return node
        for k in inner:
            feature, cut = tree[k]
            own = node == k
            node[own] = np.where(cells[feature][own] <= cut, 2 * k + 1, 2 * k + 2)


def _best_split(cells: dict[str, np.ndarray], own: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[str, int] | None:
    """The split of some rows that gains most, of those that leave rows on both sides."""
    best, gain_of_best = None, 1e-6
    whole_g, whole_h = g[own].sum(), h[own].sum()
    for name, bins in cells.items():
        left_g, left_h = (np.cumsum(np.bincount(bins[own], x[own], BINS)) for x in (g, h))
        for cut in range(BINS - 1):
            a, b = left_g[cut], left_h[cut]
            if min(b, whole_h - b) > 1e-3:
                gain = a**2 / (b + ridge) + (whole_g - a) ** 2 / (whole_h - b + ridge) - whole_g**2 / (whole_h + ridge)
                if gain > gain_of_best * (1 + 1e-9):
                    best, gain_of_best = (name, cut), gain
    return best


def boost(cells: dict[str, np.ndarray], y: np.ndarray, n: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE) -> Trees:
    """Trees from binned features, labels (0 or 1) and how often each row occurs."""
    bad, total = float((n * y).sum()), float(n.sum())
    if not 0 < bad < total:
        return Trees(-20.0)
    model = Trees(math.log(bad / (total - bad)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-model.logits(cells)))
        g, h = n * (p - y), n * p * (1 - p)
        tree: dict = {}
        level = [0]
        for _ in range(depth + 1):
            node = _nodes(tree, cells, len(y))
            following = []
            for k in level:
                own = node == k
                split = _best_split(cells, own, g, h, ridge) if k < 2**depth - 1 else None
                if split is None:
                    tree[k] = -rate * float(g[own].sum()) / (float(h[own].sum()) + ridge)
                else:
                    tree[k] = split
                    following += [2 * k + 1, 2 * k + 2]
            level = following
        model.trees.append(tree)
    return model


def fitted(cells: dict[str, np.ndarray], y: np.ndarray, n: np.ndarray, fold: np.ndarray, **options) -> Trees:
    """Trees of all rows, with the threshold and AUC of scores out of fold."""
    model = boost(cells, y, n, **options)
    if not model.trees:
        return model
    score = np.zeros(len(y))
    for f in np.unique(fold).tolist():
        seen = fold != f
        part = boost({c: x[seen] for c, x in cells.items()}, y[seen], n[seen], **options)
        score[~seen] = part.logits({c: x[~seen] for c, x in cells.items()})
    order = np.argsort(-score, kind="stable")
    s, hits, misses = score[order], np.cumsum((n * y)[order]), np.cumsum((n * (1 - y))[order])
    last = np.append(s[1:] != s[:-1], True)  # of rows that score alike, all or none are blocked
    s, hits, misses = s[last], hits[last] / hits[-1], misses[last] / misses[-1]
    k = int(np.argmax(hits - misses))
    below = s[k + 1] if k + 1 < len(s) else s[k] - 1.0
    model.threshold = float((s[k] + below) / 2) if hits[k] > misses[k] else 0.0
    model.auc = float(np.trapezoid(np.append(0.0, hits), np.append(0.0, misses)))
    return model


def _statistics(rows: DataFrame, key: str, name: str) -> DataFrame:
    """For each value of `key`: its rows, and of each fold the labelled and the blocked ones."""
    folds = [(f, F.count_if((F.col("_fold") == f) & F.col("_ruled").isNotNull()), F.count_if((F.col("_fold") == f) & (F.col("_ruled") == "block"))) for f in range(FOLDS)]
    counts = rows.groupBy(key).agg(F.count("*").alias(f"{name}_n"), F.array(*[n for _, n, _ in folds]).alias(f"{name}_labelled"), F.array(*[b for _, _, b in folds]).alias(f"{name}_bad"))
    return checkpoint(counts)  # a row for each value: broadcast by its size, or else shuffled, as adaptive execution finds


def _blocked(name: str) -> Column:
    """The share of blocked URLs among the labelled ones of other folds (of all for a URL without a label), half where there is none."""

    def without_own(counts: str) -> Column:
        every = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
        return every - F.when(F.col("_ruled").isNotNull(), F.get(counts, F.col("_fold"))).otherwise(F.lit(0))

    return (without_own(f"{name}_bad") + 0.5) / (without_own(f"{name}_labelled") + 1.0)


def features(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule, the rule's verdict (_ruled), _fold and binned features."""
    host, path = parts(url_col)
    out = without(pages, [*ADDED, *FEATURES, "_url", "_suffix", "_segment", "_ruled", "_fold"]).withColumns({"host": host, "path": path, "_url": F.coalesce(F.col(url_col), F.lit(""))})
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_ruled": ruled, "_suffix": F.substring_index("host", ".", -2), "_segment": F.regexp_extract("path", "^/([^/]*)/", 1), "_fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")})
    suffixes, segments = _statistics(out, "_suffix", "s"), _statistics(out.where(F.col("_ruled").isNotNull()), "_segment", "g")
    total = suffixes.agg(F.sum("s_n")).first()[0] or 1
    out = out.join(suffixes, "_suffix", "left").join(segments, "_segment", "left")
    blocked = {f"f_{name}_blocked": F.coalesce(_blocked(short), F.lit(0.5)) for name, short in (("suffix", "s"), ("segment", "g"))}
    out = out.withColumns(_lexical(F.col("_url"), F.col("path")) | {"f_suffix_share": -F.log2(F.col("s_n") / total)} | blocked)
    return out.withColumns({name: _binned(name) for name in FEATURES}).drop("_suffix", "_segment", "_url", *[f"{x}_{y}" for x in "sg" for y in ("n", "labelled", "bad")])


def train(every: DataFrame, url_col: str = "url", train_rows: int = TRAIN_ROWS, **options) -> Trees:
    """Trees from the labelled rows of `features`."""
    labelled = every.where(F.col("_ruled").isNotNull())
    sample = labelled.where(sampled(url_col, train_rows / max(1, labelled.count())))
    bad = (F.col("_ruled") == "block").cast("int")
    rows = sample.groupBy(*FEATURES, bad.alias("y"), "_fold").agg(F.count("*").alias("n")).orderBy(*FEATURES, "y", "_fold").collect()  # TRAIN_ROWS at most
    cells = {name: np.array([r[name] for r in rows], np.int64) for name in FEATURES}
    return fitted(cells, *(np.array([r[c] for r in rows], float) for c in ("y", "n")), np.array([r["_fold"] for r in rows], np.int64), **options)


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """pages with host, path, rule, verdict and score (of being bad, by the trees)."""
    every = features(pages, url_col, rules)
    model = train(every, url_col, train_rows)
    out = every.withColumn("score", 1 / (1 + F.exp(-model.logit())))
    return out.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop("_ruled", "_fold", *FEATURES)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
