"""URL filters: host and path rules, else gradient-boosted trees on lexical features.

Everything on the main path is DataFrame expressions: feature extraction, the
histograms that training aggregates, and the trees, which become one nested CASE
expression. The driver sees only histogram rows: nodes x features x bins.

Labelled URLs are those that a rule decides. The trees judge the others. Suffix statistics are the suffix's
share and mean depth, and the smoothed rates at which labelled URLs of the same suffix, of the same last two
host labels and of the same first path label are blocked. Labelled URLs fall into five folds by a hash; a
labelled URL's rates come from the other folds, so that the trees never see its own label in a feature.

A group of equal URLs is counted once with its weight before anything is
shuffled, so a URL or host that holds a third of all rows costs one row a task.

Edge cases: a null URL and one without `://` have an empty host and path, fit no
rule, and are judged by the trees on their features (all zero for null). Without
labelled URLs of both verdicts the trees are constant at the labelled rate
(allow if there are no labels). Repeated rows give repeated results; an empty
table gives an empty result; columns other than the id and the url are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import ascii_lower, staged

#: (host, path start, verdict); a rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Feature -> the values at which a split may cut (x <= cut goes left).
CUTS = {
    "length": (20, 25, 30, 35, 40, 45, 50, 60, 80, 120),
    "host_length": (8, 12, 16, 20, 24, 28, 34, 45),
    "path_length": (0, 3, 5, 7, 8, 9, 10, 12, 16, 24, 40),
    "depth": (0, 1, 2, 3, 4, 6),
    "host_labels": (0, 1, 2, 3, 4, 5),
    "digit_ratio": (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.16, 0.25, 0.4),
    "path_digits": (0, 1, 2, 3, 4, 6),
    "hyphens": (0, 1, 2, 4),
    "entropy": (1.0, 2.0, 2.5, 3.0, 3.2, 3.4, 3.6, 3.8, 4.0, 4.2, 4.5),
    "params": (0, 1, 2, 3, 5),
    "fragment": (0,),
    "https": (0,),
    "suffix_share": (0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8),
    "suffix_depth": (0.5, 1.0, 1.5, 2.0, 2.5, 3.0),
    "suffix_rate": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "domain_rate": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "section_rate": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
}

#: Folds of labelled URLs, and the weight of the rate over all of them in a rate.
FOLDS, SMOOTH = 5, 10.0


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path, both empty where there is no `://`."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return (
        pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("double")


def with_lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of one URL, besides the suffix statistics."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return urls.select(
        "*",
        n.alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/").alias("depth"),
        F.when(F.col("host") == "", 0.0).otherwise(_count(F.col("host"), r"\.") + 1).alias("host_labels"),
        F.when(n > 0, _count(u, "[0-9]") / n).otherwise(0.0).alias("digit_ratio"),
        _count(F.col("path"), "[0-9]").alias("path_digits"),
        _count(F.col("host"), "-").alias("hyphens"),
        F.coalesce(-F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p)), F.lit(0.0)).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("params"),
        F.contains(u, F.lit("#")).cast("double").alias("fragment"),
        F.startswith(u, F.lit("https:")).cast("double").alias("https"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("domain"),
        F.regexp_extract("path", r"^/([^/]*)", 1).alias("section"),
    )


def _fold_sums() -> list[Column]:
    """Weights and blocked weights of labelled rows by fold, as two arrays."""
    labelled = lambda f: F.col("ruled").isNotNull() & (F.col("fold") == f)
    add = lambda of, c: F.coalesce(F.sum(F.when(of, c)), F.lit(0)).cast("double")
    return [
        F.array(*[add(labelled(f), F.col("n")) for f in range(FOLDS)]).alias("_all"),
        F.array(*[add(labelled(f) & (F.col("ruled") == "block"), F.col("n")) for f in range(FOLDS)]).alias("_blocked"),
    ]


def _outside(folds: Column) -> Column:
    """The sum over the folds but a labelled row's own."""
    own = F.when(F.col("ruled").isNotNull(), F.get(folds, F.col("fold"))).otherwise(0.0)
    return F.aggregate(folds, F.lit(0.0), lambda a, x: a + x) - own


def with_features(urls: DataFrame) -> DataFrame:
    """Lexical features plus statistics of the host's suffix over all rows (weight n) and of what `ruled` says (null: not labelled)."""
    urls = urls if "ruled" in urls.columns else urls.withColumn("ruled", F.lit(None).cast("string"))
    base = staged(with_lexical(urls).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")), "url_lexical")
    total = base.agg(F.sum("n").alias("n"), *_fold_sums()).first()
    everywhere = [F.array(*[F.lit(x) for x in total[c]]) for c in ("_all", "_blocked")]
    prior = (_outside(everywhere[1]) + 0.5) / (_outside(everywhere[0]) + 1.0)
    out = base
    for key in ("suffix", "domain", "section"):
        whole = [(F.sum("n") / F.lit(total["n"] or 1)).alias("suffix_share"), (F.sum(F.col("n") * F.col("depth")) / F.sum("n")).alias("suffix_depth")] if key == "suffix" else []
        stats = base.groupBy(key).agg(*whole, *_fold_sums())
        rate = (_outside(F.col("_blocked")) + SMOOTH * prior) / (_outside(F.col("_all")) + SMOOTH)
        out = out.join(stats, key).withColumn(f"{key}_rate", rate).drop(key, "_all", "_blocked")
    return out.drop("fold")


def _bin(feature: str) -> Column:
    out = F.lit(len(CUTS[feature]))
    for i in range(len(CUTS[feature]) - 1, -1, -1):
        out = F.when(F.col(feature) <= CUTS[feature][i], i).otherwise(out)
    return out


#: A tree is a leaf value, or (feature, cut number, left, right).
Tree = float | tuple


def tree_column(tree: Tree, binned: bool = False) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, cut, left, right = tree
    goes_left = F.col("b_" + feature) <= cut if binned else F.col(feature) <= CUTS[feature][cut]
    return F.when(goes_left, tree_column(left, binned)).otherwise(tree_column(right, binned))


def _grow(rows: DataFrame, depth: int, shrink: float, l2: float, least: float) -> Tree:
    """One regression tree on gradients g and hessians h, level by level."""
    splits: dict[int, tuple] = {}
    leaves: dict[int, float] = {}
    sums: dict[int, tuple[float, float]] = {}

    def node_column(node: int) -> Column:
        if node not in splits:
            return F.lit(node)
        feature, cut = splits[node]
        return F.when(F.col("b_" + feature) <= cut, node_column(2 * node)).otherwise(node_column(2 * node + 1))

    open_nodes = [1]
    for level in range(depth):
        if not open_nodes:
            break
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col("b_" + f).alias("bin")) for f in CUTS]))
        # The distinct bin vectors are few; Spark sums them per node, feature and bin.
        hist = (
            rows.withColumn("node", node_column(1)).where(F.col("node").isin(open_nodes))
            .select("node", "g", "h", cells.alias("cell"))
            .groupBy("node", "cell.feature", "cell.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            .collect()
        )
        by: dict[tuple[int, str], dict[int, tuple[float, float]]] = {}
        for r in hist:
            by.setdefault((r["node"], r["feature"]), {})[r["bin"]] = (r["g"], r["h"])
        next_open = []
        for node in open_nodes:
            best = (1e-9, "", -1, (0.0, 0.0), (0.0, 0.0))
            for feature in CUTS:
                bins = by.get((node, feature), {})
                g_all, h_all = sum(b[0] for b in bins.values()), sum(b[1] for b in bins.values())
                sums[node] = (g_all, h_all)
                g, h = 0.0, 0.0
                for cut in range(len(CUTS[feature])):
                    g, h = g + bins.get(cut, (0.0, 0.0))[0], h + bins.get(cut, (0.0, 0.0))[1]
                    if h < least or h_all - h < least:
                        continue
                    gain = g * g / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all * g_all / (h_all + l2)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, feature, cut, (g, h), (g_all - g, h_all - h))
            if best[1]:
                splits[node] = (best[1], best[2])
                sums[2 * node], sums[2 * node + 1] = best[3], best[4]
                next_open += [2 * node, 2 * node + 1]
        open_nodes = next_open

    def build(node: int) -> Tree:
        if node in splits:
            return (*splits[node], build(2 * node), build(2 * node + 1))
        g, h = sums.get(node, (0.0, 0.0))
        leaves[node] = -shrink * g / (h + l2)
        return leaves[node]

    return build(1)


def train(labelled: DataFrame, rounds: int = 8, depth: int = 3, shrink: float = 0.4, l2: float = 1.0, least: float = 2.0) -> tuple[float, list[Tree]]:
    """Boost on rows (features, label 0/1, n); returns the prior log-odds and the trees."""
    binned = [_bin(f).alias("b_" + f) for f in CUTS]
    keys = ["b_" + f for f in CUTS]
    vectors = staged(labelled.select("label", "n", *binned).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("ones")), "url_vectors")
    total = vectors.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).first()
    if not total["n"]:
        return -10.0, []
    rate = min(max(total["ones"] / total["n"], 1e-4), 1 - 1e-4)
    prior, trees = math.log(rate / (1 - rate)), []
    if total["ones"] in (0, total["n"]):
        return prior, trees
    for _ in range(rounds):
        margin = F.lit(prior)
        for t in trees:
            margin = margin + tree_column(t, binned=True)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        rows = vectors.select(*keys, (F.col("n") * p - F.col("ones")).alias("g"), (F.col("n") * p * (F.lit(1.0) - p)).alias("h"))
        trees.append(_grow(rows, depth, shrink, l2, least))
    return prior, trees


def url_filter(pages: DataFrame, url: str = "url", page_id: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict, and the trees' block_score."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rule, verdict = rule_columns(rules)
    # Distinct URLs with their weights: copies are counted before the shuffle.
    urls = with_parts(rows.groupBy("url").agg(F.count(F.lit(1)).alias("n")))
    # URLs are short and their features are not cheap: spread them by count, not by bytes.
    # (By a hash: a second shuffle on the group's own key would be dropped as redundant.)
    urls = urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("url"))
    urls = urls.withColumns({"rule": rule, "ruled": verdict})
    features = staged(with_features(urls), "url_features")
    prior, trees = train(features.where(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double")))
    margin = F.lit(prior)
    for t in trees:
        margin = margin + tree_column(t)
    scored = features.select("url", "host", "path", "rule", "ruled", (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("block_score"))
    judged = scored.withColumn("verdict", F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))
    return (
        rows.withColumnRenamed("url", "_url")
        .join(judged, F.col("_url").eqNullSafe(F.col("url")))
        .select("page_id", "host", "path", "rule", "verdict", "block_score")
    )
