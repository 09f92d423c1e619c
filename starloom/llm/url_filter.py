"""URL filter: written rules first, gradient-boosted trees on lexical features for the rest.

The project keeps no addresses, so this is general: any frame with a URL column.
Only DataFrame functions are used.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: from there up to ``?``, ``#`` or the end. A null URL, or one without ``://``,
has both empty. A rule fits its host and all subdomains if the path starts with the
rule's; the longest rule wins, then the first in alphabetical order. Where no rule
fits, the trees decide, learned from the URLs that a rule labels. Without blocked
and allowed examples, the more frequent label (allow, if none) is everyone's.

Empty and very long URLs are ordinary ones, repeated URLs get equal verdicts, null
keys are carried along, other columns are kept, and columns that have the names of
the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.columns import sample_by_label
from starloom.session import materialize

ALLOW, BLOCK = "allow", "block"
ROWS_PER_LABEL = 20_000
TREES, DEPTH, BINS = 10, 3, 16
LEARNING_RATE, RIDGE = 0.3, 1.0
# Suffix statistics are kept for so many hash buckets; the table never grows.
SUFFIX_BUCKETS = 1_024
SMOOTHING = 4.0

RESULTS = ["host", "path", "rule", "verdict", "score"]
FEATURES = [
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio",
    "entropy", "parameters", "suffix_rate", "suffix_rows", "zone_rate", "zone_rows",
]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class Tree:
    """A node is (feature, threshold, low child, high child); a leaf is its value."""

    nodes: dict[int, tuple[str, float] | float] = field(default_factory=dict)

    def value(self, node: int = 1) -> Column:
        made = self.nodes[node]
        if not isinstance(made, tuple):
            return F.lit(made)
        return F.when(F.col(made[0]) > made[1], self.value(2 * node + 1)).otherwise(self.value(2 * node))

    def place(self, depth: int, node: int = 1) -> Column:
        """The number of the node of a level that a row is at; null if it ended in a leaf above."""
        if depth == 0:
            return F.lit(node)
        made = self.nodes.get(node)
        if not isinstance(made, tuple):
            return F.lit(None).cast("int")
        return F.when(F.col(made[0]) > made[1], self.place(depth - 1, 2 * node + 1)).otherwise(self.place(depth - 1, 2 * node))


@dataclass(frozen=True)
class UrlModel:
    bias: float
    trees: list[Tree]
    suffixes: list[list[tuple[float, float]]]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), capitals, capitals.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: Sequence[Rule]) -> Column:
    """The rule that wins, as its text and verdict."""
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    found = none
    for rule in reversed(ranked):
        own = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        made = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(own & F.startswith(F.col("path"), F.lit(rule.path)), made).otherwise(found)
    return found


def _bucket(part: Column) -> Column:
    return F.pmod(F.xxhash64(part), F.lit(SUFFIX_BUCKETS)).cast("int")


def _lexical(url: str) -> dict[str, Column]:
    """Features of a URL's characters; suffixes as hash buckets, not yet as statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total + F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(text).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "host_depth": F.size(F.split("host", r"\.")).cast("double"),
        "path_depth": (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double"),
        "digit_ratio": (F.length(text) - F.length(F.translate(text, "0123456789", ""))) / size,
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "suffix": _bucket(F.substring_index("host", ".", -1)),
        "zone": _bucket(F.substring_index("host", ".", -2)),
    }


def _with_lexical(df: DataFrame, url: str) -> DataFrame:
    return df.select("*", *[made.alias("_f_" + name) for name, made in _lexical(url).items()])


def _suffix_table(rows: DataFrame, bucket: str) -> list[tuple[float, float]]:
    """Share of blocked rows and log of the row count per hash bucket."""
    counted = rows.groupBy(bucket).agg(F.sum("blocked").alias("b"), F.count("*").alias("n")).collect()
    table = [(0.5, 0.0)] * SUFFIX_BUCKETS
    for row in counted:
        table[row[bucket]] = ((row["b"] + SMOOTHING / 2) / (row["n"] + SMOOTHING), math.log1p(row["n"]))
    return table


def _featured(df: DataFrame, url: str, suffixes: list[list[tuple[float, float]]]) -> DataFrame:
    rows = _with_lexical(df, url)
    kept = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.col("_f_" + f).alias(f) for f in FEATURES[:8]]
    known = []
    for name, table in zip(("suffix", "zone"), suffixes, strict=True):
        for i, what in enumerate(("rate", "rows")):
            values = F.array(*[F.lit(row[i]) for row in table])
            known.append(F.element_at(values, F.col("_f_" + name) + 1).alias(f"{name}_{what}"))
    return rows.select(*kept, *plain, *known)


def _margin(bias: float, trees: Sequence[Tree]) -> Column:
    return reduce(lambda total, tree: total + tree.value(), trees, F.lit(bias))


def _best_splits(sums: list, thresholds: dict[str, list[float]]) -> dict[int, tuple]:
    """The split of most gain of each node, with the gradient sums of its two sides."""
    nodes: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
    for node, feature, bin_, g, h in sums:
        nodes.setdefault(node, {}).setdefault(feature, {})[bin_] = (g, h)
    score = lambda g, h: g * g / (h + RIDGE)
    best: dict[int, tuple] = {}
    for node, features in nodes.items():
        total = [sum(v[i] for v in next(iter(features.values())).values()) for i in (0, 1)]
        found = (1e-6, None, None, tuple(total), None)
        for feature in sorted(features):
            low = [0.0, 0.0]
            for bin_ in range(len(thresholds[feature])):
                g, h = features[feature].get(bin_, (0.0, 0.0))
                low = [low[0] + g, low[1] + h]
                high = (total[0] - low[0], total[1] - low[1])
                gain = score(*low) + score(*high) - score(*total)
                if min(low[1], high[1]) > 1e-3 and gain > found[0]:
                    found = (gain, feature, thresholds[feature][bin_], tuple(low), high)
        best[node] = found
    return best


def _grow(cells: DataFrame, margin: Column, thresholds: dict[str, list[float]]) -> Tree:
    """One regression tree on the gradients of the logistic loss, level by level."""
    tree = Tree()
    chance = 1 / (1 + F.exp(-margin))
    graded = cells.withColumn("_g", (chance - F.col("blocked")) * F.col("rows")).withColumn("_h", chance * (1 - chance) * F.col("rows"))
    leaf = lambda g, h: -LEARNING_RATE * g / (h + RIDGE)
    for depth in range(DEPTH):
        at = graded.withColumn("_node", tree.place(depth)).where("_node is not null")
        bins = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col("_b_" + f).alias("bin")) for f in FEATURES])).alias("_at")
        sums = at.select("_node", bins, "_g", "_h").groupBy("_node", "_at.feature", "_at.bin").agg(F.sum("_g"), F.sum("_h")).collect()
        for node, (_, feature, threshold, low, high) in _best_splits(sums, thresholds).items():
            if feature is None:
                tree.nodes[node] = leaf(*low)
            else:
                tree.nodes[node] = (feature, threshold)
                tree.nodes[2 * node], tree.nodes[2 * node + 1] = leaf(*low), leaf(*high)
        if not any(isinstance(tree.nodes.get(n), tuple) for n in range(2**depth, 2 ** (depth + 1))):
            break
    tree.nodes.setdefault(1, 0.0)
    return tree


def fit(labelled: DataFrame, url: str = "url", key: str = "url", label: str = "verdict", rows_per_label: int = ROWS_PER_LABEL) -> UrlModel:
    """Learn from about ``rows_per_label`` labelled rows of each verdict, drawn by the hash of ``key``.

    The rows are reduced to binned feature vectors with their count once; every
    level of a tree is one aggregation of those, of which only gradient sums per
    node, feature and bin come back.
    """
    known = labelled.where(F.col(label).isin(ALLOW, BLOCK))
    sample, counts = sample_by_label(known, label, key, rows_per_label)
    if len(counts) < 2:
        only = next(iter(counts), ALLOW)
        return UrlModel(5.0 if only == BLOCK else -5.0, [], [[(0.5, 0.0)] * SUFFIX_BUCKETS] * 2)
    drawn = materialize(sample.select(F.col(url).alias("url"), "host", "path", (F.col(label) == BLOCK).cast("int").alias("blocked")))
    coded = drawn.select("blocked", *[_lexical("url")[n].alias(n) for n in ("suffix", "zone")])
    suffixes = [_suffix_table(coded, name) for name in ("suffix", "zone")]
    rows = materialize(_featured(drawn, "url", suffixes).select("blocked", *FEATURES))
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(f, shares).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted(set(cuts[f])) for f in FEATURES}
    bins = [reduce(lambda total, t, f=f: total + (F.col(f) > t).cast("int"), thresholds[f], F.lit(0)).alias("_b_" + f) for f in FEATURES]
    # A row is its bins from here on; a bin stands for its features through its lower threshold.
    cells = rows.select("blocked", *bins).groupBy("blocked", *["_b_" + f for f in FEATURES]).agg(F.count("*").alias("rows"))
    lower = {f: F.array(F.lit(-1e300), *[F.lit(math.nextafter(t, math.inf)) for t in thresholds[f]]) for f in FEATURES}
    # The cells are no more than the drawn rows; one partition spares every level its shuffle.
    cells = materialize(cells.select("*", *[F.element_at(lower[f], F.col("_b_" + f) + 1).alias(f) for f in FEATURES])).coalesce(1)
    blocked = sum(min(n, rows_per_label) for v, n in counts.items() if v == BLOCK)
    allowed = sum(min(n, rows_per_label) for v, n in counts.items() if v == ALLOW)
    bias, trees = math.log(blocked / allowed), []
    for _ in range(TREES):
        trees.append(_grow(cells, _margin(bias, trees), thresholds))
    return UrlModel(bias, trees, suffixes)


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "url", rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the trees' chance of block) to every row."""
    kept = [c for c in df.columns if c.lower() not in RESULTS]
    host, path = split_url(F.col(url))
    # The row itself travels as one column, so its names cannot meet those of the features.
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    parts = df.select(row, F.col(url).alias("_url"), F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("_rule", fitting_rule(rules))
    model = fit(ruled.withColumn("verdict", F.col("_rule.verdict")), "_url", "_key", "verdict", rows_per_label)
    scored = _featured(ruled, "_url", model.suffixes).withColumn("score", 1 / (1 + F.exp(-_margin(model.bias, model.trees))))
    learned = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    verdict = F.coalesce(F.col("_rule.verdict"), learned)
    return scored.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
