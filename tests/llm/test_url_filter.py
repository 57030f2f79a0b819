"""The URL filter against SQL for its rules and a plain Python form of its boosted trees."""

import collections
import math

import pytest
import xxhash
from oracle import connect

from vellum.llm import queries, url_filter

SF = "/root/testdata/sf0.01"

RULES_SQL = r"""
  WITH r(host, start, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
  u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u),
  q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM p),
  f AS (SELECT q.page_id, r.host || r.start AS rule, r.says FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.start)
        QUALIFY row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.host || r.start) DESC) = 1)
  SELECT q.page_id, q.host, q.path, f.rule, f.says FROM q LEFT JOIN f USING (page_id)"""


@pytest.fixture(scope="module")
def judged(spark):
    return {r.page_id: r for r in url_filter.url_filter(spark.read.parquet(f"{SF}/pages.parquet")).collect()}


def test_hosts_paths_and_rules_match_sql(judged):
    want = connect(SF).sql(RULES_SQL).fetchall()
    assert len(want) == len(judged) and any(w[3] for w in want)
    for page_id, host, path, rule, says in want:
        got = judged[page_id]
        assert (got.host, got.path, got.rule) == (host, path, rule)
        assert rule is None or got.verdict == says
        assert rule is not None or got.verdict == ("block" if got.block_score >= 0.5 else "allow")


def test_the_query_keeps_the_contract(spark, judged):
    got = queries.op6_url_filter(spark, SF)
    assert {"page_id", "host", "path", "rule", "verdict"} <= set(got.columns)
    assert {(r.page_id, r.verdict) for r in got.collect()} == {(r.page_id, r.verdict) for r in judged.values()}


def features(url, host, path):
    u = url or ""
    query = u.split("?", 1)[1].split("#", 1)[0] if "?" in u else ""
    share = [n / len(u) for n in collections.Counter(u).values()] if u else []
    digits = sum(c in "0123456789" for c in u)
    return {
        "length": len(u), "host_length": len(host), "path_length": len(path), "depth": path.count("/"),
        "host_labels": host.count(".") + 1 if host else 0, "digit_ratio": digits / len(u) if u else 0.0,
        "path_digits": sum(c in "0123456789" for c in path), "hyphens": host.count("-"), "entropy": -sum(p * math.log2(p) for p in share),
        "params": query.count("&") + 1 if query else 0, "fragment": float("#" in u), "https": float(u.startswith("https:")),
    }


def with_rates(own, weight, one):
    """Add each URL's rates of blocked labelled URLs with its suffix, domain and section, its own fold left out."""
    fold = {u: xxhash.xxh64_intdigest((u or "").encode(), 42) for u in weight}
    fold = {u: (h - 2**64 if h >= 2**63 else h) % 5 if u is not None else 42 % 5 for u, h in fold.items()}
    known = [u for u in weight if one[u].rule is not None]
    parts = {
        "suffix_rate": {u: one[u].host.rsplit(".", 1)[-1] for u in weight},
        "domain_rate": {u: ".".join(one[u].host.split(".")[-2:]) for u in weight},
        "section_rate": {u: one[u].path[1:].split("/")[0] if one[u].path.startswith("/") else "" for u in weight},
    }
    for name, part in parts.items():
        n, ones = collections.Counter(), collections.Counter()
        for u in known:
            for key in (part[u], None):
                for f in (fold[u], "all"):
                    n[key, f] += weight[u]
                    ones[key, f] += weight[u] * (one[u].verdict == "block")
        for u in weight:
            left = lambda c, key: c[key, "all"] - (c[key, fold[u]] if one[u].rule is not None else 0)  # noqa: B023, E731
            prior = (left(ones, None) + 0.5) / (left(n, None) + 1.0)
            own[u][name] = (left(ones, part[u]) + 10.0 * prior) / (left(n, part[u]) + 10.0)


def boosted(rows, rounds, depth, shrink, l2, least):
    """rows: (features, weight, label): margin of any features, by trees grown one sample at a time."""
    total, ones = sum(n for _, n, _ in rows), sum(n * y for _, n, y in rows)
    rate = min(max(ones / total, 1e-4), 1 - 1e-4)
    trees, margins = [], [math.log(rate / (1 - rate))] * len(rows)

    def grow(of, g, h, level):
        def gain(a, b):
            return a * a / (b + l2)

        sg, sh = sum(g[i] for i in of), sum(h[i] for i in of)
        best = (1e-9, None, None)
        for name, cuts in url_filter.CUTS.items() if level < depth else ():
            for cut in cuts:
                left = [i for i in of if rows[i][0][name] <= cut]
                lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                if lh < least or sh - lh < least:
                    continue
                more = gain(lg, lh) + gain(sg - lg, sh - lh) - gain(sg, sh)
                if more > best[0] * (1 + 1e-9):
                    best = (more, name, cut)
        if best[1] is None:
            return -shrink * sg / (sh + l2)
        _, name, cut = best
        return name, cut, grow([i for i in of if rows[i][0][name] <= cut], g, h, level + 1), grow([i for i in of if rows[i][0][name] > cut], g, h, level + 1)

    def value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        g = [n * (q - y) for (_, n, y), q in zip(rows, p, strict=True)]
        h = [n * q * (1 - q) for (_, n, _), q in zip(rows, p, strict=True)]
        trees.append(grow(list(range(len(rows))), g, h, 0))
        margins = [m + value(trees[-1], x) for m, (x, _, _) in zip(margins, rows, strict=True)]
    return lambda x: math.log(rate / (1 - rate)) + sum(value(t, x) for t in trees)


def test_scores_equal_trees_grown_row_by_row(spark, judged):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    weight = collections.Counter(r.url for r in pages)
    one = {r.url: judged[r.page_id] for r in pages}
    own = {u: features(u, one[u].host, one[u].path) for u in weight}
    suffix = {u: one[u].host.rsplit(".", 1)[-1] for u in weight}
    by = collections.defaultdict(lambda: [0, 0.0])
    for u, n in weight.items():
        by[suffix[u]][0] += n
        by[suffix[u]][1] += n * own[u]["depth"]
    for u in weight:
        n, depth = by[suffix[u]]
        own[u] |= {"suffix_share": n / len(pages), "suffix_depth": depth / n}
    with_rates(own, weight, one)
    rows = [(own[u], n, float(one[u].verdict == "block")) for u, n in weight.items() if one[u].rule is not None]
    margin = boosted(rows, rounds=8, depth=3, shrink=0.4, l2=1.0, least=2.0)
    for r in pages:
        assert judged[r.page_id].block_score == pytest.approx(1 / (1 + math.exp(-margin(own[r.url]))), abs=1e-6)


def test_trees_repeat_the_rules_on_urls_they_did_not_see(spark):
    """Labels are the rules' own verdicts, so this measures how well lexical features stand in for rules.

    A fifth of the labelled URLs is held out: neither the trees nor any statistic sees its labels.
    """
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")
    rule, says = url_filter.rule_columns(url_filter.RULES)
    urls = url_filter.with_parts(pages.groupBy("url").agg(F.count(F.lit(1)).alias("n"))).withColumn("says", says)
    seen = F.expr("pmod(xxhash64(url, 7), 5) <> 0")
    rows = url_filter.with_features(urls.withColumn("ruled", F.when(seen, F.col("says")))).where("says IS NOT NULL").withColumn("label", (F.col("says") == "block").cast("double"))
    prior, trees = url_filter.train(rows.where(seen))
    margin = sum((url_filter.tree_column(t) for t in trees), F.lit(prior))
    held = [(r.m, r.label) for r in rows.where(~seen).select(margin.alias("m"), "label").collect()]
    rate = 1 / (1 + math.exp(-prior))
    loss = lambda p, y: -math.log(p if y else 1 - p)
    accuracy = sum((m > 0) == (y == 1) for m, y in held) / len(held)
    constant = sum(loss(rate, y) for _, y in held) / len(held)
    own = sum(loss(1 / (1 + math.exp(-m)), y) for m, y in held) / len(held)
    high, low = [m for m, y in held if y], [m for m, y in held if not y]
    area = sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low))
    larger = max(len(high), len(low)) / len(held)
    print(f"held-out urls {len(held)}, accuracy {accuracy:.3f} (larger class {larger:.3f}), log loss {own:.3f} (constant {constant:.3f}), area {area:.3f}")
    assert accuracy > larger and own < 0.9 * constant and area > 0.75
