"""URL filters: rules by host and path, and boosted trees on lexical features for what no rule fits, in DataFrame operations only.

The URLs that a rule judges are the labelled ones; the trees learn from them and judge the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Fixed rules of the registered query: host and path, verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Trees are fitted on at most so many different labelled URLs, chosen by a hash; suffix statistics count all of them.
LABELLED = 20_000
#: Suffixes of each kind are counted in so many hash buckets, so that their table has a bound whatever the number of hosts.
SUFFIX_BUCKETS = 1 << 12
#: Parts of the labelled URLs: a URL's suffix statistics in training leave out its own part.
FOLDS = 5
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 12, 3, 16, 0.3, 1.0, 10
#: Weight of the prior in a suffix's share of blocked URLs.
PRIOR_WEIGHT = 4.0

LEXICAL = ("length", "depth", "digit_ratio", "entropy", "params")
SUFFIXES = ("last_label", "last_two", "whole_host", "extension")
FEATURES = (*LEXICAL, *(f"{s}_share" for s in SUFFIXES))


def host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z lower-cased; empty without ://."""
    found = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(own_host: Column, own_path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. Of rules of one length that with the longer host wins."""
    split = sorted(((r, r[: r.index("/")], r[r.index("/") :], v) for r, v in rules), key=lambda x: (-len(x[0]), -len(x[1]), x[0]))
    out: Column | None = None
    for rule, rule_host, rule_path, verdict in split:
        fits = ((own_host == rule_host) | own_host.endswith(f".{rule_host}")) & own_path.startswith(rule_path)
        then = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def lexical(url: Column, own_path: Column) -> dict[str, Column]:
    """Length in characters, path segments, share of digits, entropy of characters in bits, parameters of the query."""
    own = F.coalesce(url, F.lit(""))
    n = F.char_length(own)
    digits = n - F.char_length(F.translate(own, "0123456789", ""))
    counts = F.transform(F.array_distinct(F.filter(F.split(own, ""), lambda c: c != "")), lambda c: (n - F.char_length(F.replace(own, c, F.lit("")))).cast("double"))
    parts = F.split(F.regexp_extract(own, r"^[^?#]*\?([^#]*)", 1), "&")
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(n / c)) / n
    return {
        "length": n.cast("double"),
        "depth": F.size(F.filter(F.split(own_path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "params": F.size(F.filter(parts, lambda x: x != "")).cast("double"),
    }


def suffixes(own_host: Column, own_path: Column) -> dict[str, Column]:
    """Hash buckets of the host's last label, last two labels and whole, and of the extension of the path's last segment."""
    text = {
        "last_label": F.substring_index(own_host, ".", -1),
        "last_two": F.substring_index(own_host, ".", -2),
        "whole_host": own_host,
        "extension": F.regexp_extract(own_path, r"\.([0-9A-Za-z]{1,8})/?$", 1),
    }
    return {k: (F.crc32(v.cast("binary")) % SUFFIX_BUCKETS).cast("int") for k, v in text.items()}


@dataclass
class Forest:
    """Trees as nested splits: (feature, edge, below, above) or a leaf's value; base is the log-odds to start from."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + _tree(tree)
        return out


def _tree(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, edge, below, above = node
    return F.when(F.col(feature) <= F.lit(edge), _tree(below)).otherwise(_tree(above))


def labelled_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Different URLs that a rule judges: url, blocked, suffix buckets, fold. Copies of a URL teach once."""
    rows = pages.select("url").where("url is not null").select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).where("rule is not null")
    once = judged.select("url", (F.col("rule.verdict") == "block").cast("int").alias("blocked")).distinct()
    own_host, own_path = host(F.col("url")), path(F.col("url"))
    return once.select("url", "blocked", *(c.alias(k) for k, c in suffixes(own_host, own_path).items()), (F.crc32(F.col("url").cast("binary")) % FOLDS).cast("int").alias("fold"))


def suffix_counts(urls: DataFrame) -> DataFrame:
    """kind, bucket, fold, n, blocked over all labelled URLs: as many rows as kinds, buckets and folds at most."""
    each = urls.select("blocked", "fold", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("bucket")) for k in SUFFIXES))).alias("x"))
    return each.groupBy("x.kind", "x.bucket", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))


def with_shares(rows: DataFrame, counts: DataFrame, prior: float, but_own_fold: bool) -> DataFrame:
    """rows with the share of blocked URLs at each of its suffixes, drawn to prior where few are known.

    counts has at most len(SUFFIXES) * SUFFIX_BUCKETS * FOLDS rows, so it's broadcast.
    """
    by = ["kind", "bucket"]
    every = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    if but_own_fold:
        own = counts.select(*by, "fold", F.col("n").alias("own_n"), F.col("blocked").alias("own_blocked"))
        every = every.join(own, by).select(*by, "fold", (F.col("n") - F.col("own_n")).alias("n"), (F.col("blocked") - F.col("own_blocked")).alias("blocked"))
    for kind in SUFFIXES:
        share = (F.col("blocked") + F.lit(PRIOR_WEIGHT * prior)) / (F.col("n") + F.lit(PRIOR_WEIGHT))
        mine = every.where(F.col("kind") == kind).select(F.col("bucket").alias(kind), *(["fold"] if but_own_fold else []), share.alias(f"{kind}_share"))
        rows = rows.join(F.broadcast(mine), [kind, "fold"] if but_own_fold else [kind], "left").withColumn(f"{kind}_share", F.coalesce(f"{kind}_share", F.lit(prior)))
    return rows


def fit(urls: DataFrame, counts: DataFrame, n: int, blocked: int) -> Forest:
    """Boosted trees for the log-odds of a labelled URL being blocked.

    A tree is grown level by level: gradients are summed by node, feature and bin in one job over
    the sample, at most 2**DEPTH * len(FEATURES) * BINS sums reach the driver, which takes the best
    split of each node (ties: the first feature, the lowest bin). The sample, at most LABELLED URLs,
    is one file, so sums are in one order and reruns agree.
    """
    prior = (blocked + 1) / (n + 2)
    forest = Forest(math.log(prior / (1 - prior)))
    if not blocked or blocked == n:
        return forest
    if n > LABELLED:
        urls = urls.where(F.xxhash64("url") < F.lit(int(0.85 * LABELLED / n * (1 << 64)) - (1 << 63)))
    lex = lexical(F.col("url"), path(F.col("url")))
    rows = with_shares(urls, counts, prior, True).select("url", "blocked", *(c.alias(k) for k, c in lex.items()), *(f"{s}_share" for s in SUFFIXES))
    rows = materialize(rows.coalesce(1).sortWithinPartitions("url").drop("url"), "url-sample")
    steps = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*(F.percentile(f, F.array(*map(F.lit, steps))).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(found[f] or [])) for f in FEATURES}

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, edges[f])), lambda e: e < F.col(f)))

    table = rows.select("blocked", *FEATURES, F.array(*(F.struct(F.lit(i).alias("f"), bin_of(f).alias("bin")) for i, f in enumerate(FEATURES))).alias("bins"), F.lit(forest.base).alias("margin"))
    for k in range(TREES):
        table = materialize(table.coalesce(1), f"url-tree{k}")
        tree = _grow(table, edges)
        forest.trees.append(tree)
        table = table.withColumn("margin", F.col("margin") + _tree(tree))
    return forest


def _grow(table: DataFrame, edges: dict[str, list[float]]):
    """One tree for the gradients at the table's margins."""
    chance = 1 / (1 + F.exp(-F.col("margin")))
    steps = table.select(*FEATURES, "bins", (F.col("blocked") - chance).alias("g"), (chance * (1 - chance)).alias("h"))
    splits: dict[int, tuple[str, float]] = {}
    leaves: dict[int, float] = {}
    open_nodes = [1]
    for level in range(DEPTH + 1):
        node = F.lit(1)
        for at in sorted(splits):
            feature, edge = splits[at]
            node = F.when(node == at, F.when(F.col(feature) <= F.lit(edge), 2 * at).otherwise(2 * at + 1)).otherwise(node)
        each = steps.select(node.alias("node"), "g", "h", F.explode("bins").alias("x")).where(F.col("node").isin(open_nodes))
        found = each.coalesce(1).groupBy("node", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
        sums: dict[int, dict[tuple[int, int], tuple[float, float, int]]] = {at: {} for at in open_nodes}
        for r in found:
            sums[r["node"]][r["f"], r["bin"]] = (r["g"], r["h"], r["n"])
        following = []
        for at in open_nodes:
            own = sums[at]
            g, h, n = (math.fsum(own[x][i] for x in sorted(own) if x[0] == 0) for i in range(3))
            split = _best(own, edges, g, h, n) if level < DEPTH else None
            if split is None:
                leaves[at] = RATE * g / (h + RIDGE)
            else:
                splits[at] = split
                following += [2 * at, 2 * at + 1]
        open_nodes = following
        if not open_nodes:
            break

    def built(at: int):
        return (*splits[at], built(2 * at), built(2 * at + 1)) if at in splits else leaves[at]

    return built(1)


def _best(own: dict, edges: dict[str, list[float]], g: float, h: float, n: float) -> tuple[str, float] | None:
    """The split with the largest gain that leaves LEAST_ROWS on either side."""
    best, found = 1e-9, None
    for i, f in enumerate(FEATURES):
        left = [0.0, 0.0, 0]
        for b, edge in enumerate(edges[f]):
            for j, x in enumerate(own.get((i, b), (0.0, 0.0, 0))):
                left[j] += x
            if min(left[2], n - left[2]) < LEAST_ROWS:
                continue
            gain = left[0] ** 2 / (left[1] + RIDGE) + (g - left[0]) ** 2 / (h - left[1] + RIDGE) - g**2 / (h + RIDGE)
            if gain > best:
                best, found = gain, (f, edge)
    return found


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages.

    The longest rule that fits gives rule and verdict. Where none fits, rule is null and the verdict is
    block if the trees' chance of it, score, is above one half; score is given for every row. With no labelled URL at
    all it is one half everywhere and the verdict allow; with labels of one kind only, it is their smoothed share.

    A null url, or one without ://, has an empty host and path, fits no rule and is judged by its features, a null
    one as an empty text. Very long URLs count whole. Repeated rows are judged alike, each for itself, and teach
    once; a null page_id is kept. Columns besides page_id and url play no part. An empty table gives an empty result.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = materialize(labelled_urls(slim, rules), "url-labels")
    counts = materialize(suffix_counts(urls), "url-suffixes")
    told = urls.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    forest = fit(urls, counts, told["n"], told["blocked"])
    own_host, own_path = host(F.col("url")), path(F.col("url"))
    rows = slim.select("page_id", "url", own_host.alias("host"), own_path.alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("found"), *(c.alias(k) for k, c in (lexical(F.col("url"), F.col("path")) | suffixes(F.col("host"), F.col("path"))).items()))
    rows = with_shares(rows, counts, (told["blocked"] + 1) / (told["n"] + 2), False)
    score = 1 / (1 + F.exp(-forest.margin()))
    rows = rows.withColumn("score", score)
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
