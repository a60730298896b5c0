"""URL verdicts from host and path rules, and gradient-boosted trees on lexical features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import BROADCAST_BYTES, hash_share, lower_ascii
from recollect.operators.skew import lookup_join
from recollect.operators.staging import scope, stage

# Labelled URLs that the trees may be fitted to, about.
TRAIN_ROWS = 20_000
# Weight of the overall share in the share of one suffix.
PRIOR_ROWS = 20.0
# Parts of the labelled hosts; a training URL gets the statistics of the other parts.
FOLDS = 4
FEATURES = [
    "length", "host_length", "depth", "labels", "digit_ratio", "symbol_ratio", "entropy", "parameters",
    "has_fragment", "secure", "longest_segment", "suffix_rows", "suffix_rate", "domain_rate",
]


def url_parts(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return {"host": F.coalesce(lower_ascii(host), F.lit("")), "path": F.coalesce(path, F.lit(""))}


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule ``host/path`` fits its host and all subdomains where the path starts with the rule's.
    Of rules of one length blocking comes first.
    """
    found = F
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = found.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return found if found is not F else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_keys(host: Column) -> dict[str, Column]:
    """Last label of a host, and its last two."""
    return {"suffix": F.element_at(F.split(host, r"\."), -1), "domain": F.substring_index(host, ".", -2)}


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features that depend on the URL's characters alone; null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    length = F.length(url)
    size = F.greatest(length, F.lit(1))

    def kept(characters: str) -> Column:
        return F.length(F.regexp_replace(url, f"[^{characters}]", ""))

    letters = F.array_distinct(F.split(url, ""))
    shares = F.transform(letters, lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / size)
    bits = F.aggregate(
        F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda total, p: total - p * F.log2(p)
    )
    segments = F.split(path, "/")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return {
        "length": length, "host_length": F.length(host), "depth": F.size(F.filter(segments, lambda s: s != "")),
        "labels": F.size(labels), "digit_ratio": kept("0-9") / size,
        "symbol_ratio": F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / size, "entropy": bits,
        "parameters": F.size(F.filter(F.split(query, "&"), lambda s: s != "")),
        "has_fragment": F.instr(url, "#") > 0, "secure": F.startswith(url, F.lit("https://")),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, lambda s: F.length(s))), F.lit(0)),
        # Not features themselves: the keys of the suffix statistics.
        **suffix_keys(host),
    }


def _lookup(rows: DataFrame, rates: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """Left join with a rate table; where it can't be sent out, a hot key's rows are cut over tasks."""
    if rates.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(rates), key, "left")
    return lookup_join(rows, rates, key, spread=["url"])


def _with_rates(rows: DataFrame, suffixes: DataFrame, domains: DataFrame, overall: float) -> DataFrame:
    """``rows`` with the statistics of their suffix and domain as features.

    Rows with a ``fold`` are training rows and get the statistics of the other folds: a row must not
    find its own label in its features, and leaving out only the row itself would show it as well.
    """
    joined = _lookup(_lookup(rows, suffixes, "suffix", 160), domains, "domain", 192)

    def others(name: str) -> Column:
        count = F.coalesce(F.element_at(name, FOLDS + 1), F.lit(0.0))
        own = F.coalesce(F.element_at(F.col(name), F.col("fold") + 1), F.lit(0.0)) if "fold" in rows.columns else F.lit(0.0)
        return count - own

    rates = {
        f"{key}_rate": (others(f"{key}_bad") + PRIOR_ROWS * overall) / (others(f"{key}_rows") + PRIOR_ROWS)
        for key in ("suffix", "domain")
    }
    filled = joined.withColumns({**rates, "suffix_rows": others("suffix_rows")})
    return filled.withColumns({name: F.col(name).cast("double") for name in FEATURES})


def _counts(labelled: DataFrame, key: str) -> DataFrame:
    """Labelled rows of each ``key``, and those to be blocked: one number per fold, then their sum."""

    def by_fold(name: str) -> Column:
        folds = [F.sum(F.when(F.col("fold") == k, F.col(name)).otherwise(0)).cast("double") for k in range(FOLDS)]
        return F.array(*folds, F.sum(name).cast("double"))

    return labelled.groupBy(key).agg(by_fold("rows").alias(f"{key}_rows"), by_fold("bad").alias(f"{key}_bad"))


def _class_shares(blocked: int, allowed: int, most: int) -> dict[bool, float]:
    """Share of each class in the training sample: of ``most`` URLs each class may have half.

    What a small class leaves goes to the other.
    """
    half = most / 2
    room = {True: max(half, most - allowed), False: max(half, most - blocked)}
    return {True: min(1.0, room[True] / blocked), False: min(1.0, room[False] / allowed)}


def judge(
    urls: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """``urls`` with double ``block_score`` and ``blocked`` from trees trained on ``labelled``.

    Both have ``url``, ``host``, ``path``; ``labelled`` has boolean ``block`` too. Suffix and domain
    statistics and the rows of each class are counted over all labelled rows. Only the trees are
    fitted to a sample of about ``train_rows`` distinct URLs, up to half of them (and what the other
    leaves) of each class, chosen by a hash of the URL. A URL weighs as its rows, and as the URLs of
    its class that it stands for; the statistics it is trained with are those of
    the other FOLDS - 1 folds of hosts. All work runs in the JVM. If the labels name one class or none,
    that class (else "not blocked") is the answer.
    """
    with scope() as keep:
        distinct = stage(
            labelled.groupBy("url", "host", "path", "block").agg(F.count(F.lit(1)).alias("rows"))
            .withColumns({"label": F.col("block").cast("double"), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")}),
            "labelled-urls",
        )
        counted = stage(
            distinct.select(*[c.alias(n) for n, c in suffix_keys(F.col("host")).items()], "block", "rows", "label", "fold")
            .groupBy("suffix", "domain", "fold").agg(
                F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("label")).alias("bad"),
                F.count(F.lit(1)).alias("urls"), F.count_if("block").alias("bad_urls"),
            ), "labelled-domains",
        )
        sums = {name: F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("rows", "bad", "urls", "bad_urls")}
        seen = counted.agg(*sums.values()).first()
        if seen["bad"] in (0, seen["rows"]):
            blocked = bool(seen["bad"])
            return urls.withColumns({"block_score": F.lit(float(blocked)), "blocked": F.lit(blocked)})
        overall = seen["bad"] / seen["rows"]
        suffixes = keep(_counts(counted, "suffix"), "suffixes")
        domains = keep(_counts(counted, "domain"), "domains")
        shares = _class_shares(seen["bad_urls"], seen["urls"] - seen["bad_urls"], train_rows)
        share = F.when(F.col("block"), F.lit(shares[True])).otherwise(F.lit(shares[False]))
        sample = distinct.where(hash_share(F.col("url"), share)).select(
            "url", *[c.alias(n) for n, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()],
            "label", (F.col("rows") / share).alias("_weight"), "fold",
        )
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        trees = GBTClassifier(
            featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=20, maxDepth=4, stepSize=0.2, seed=11,
            checkpointInterval=-1,
        )
        rated = assemble.transform(_with_rates(sample, suffixes, domains, overall))
        model = trees.fit(stage(rated.select("_features", "label", "_weight"), "train"))
    features = {n: c for n, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()}
    rated = _with_rates(urls.withColumns(features), suffixes, domains, overall)
    scored = model.transform(assemble.transform(rated))
    return scored.select(
        *urls.columns, vector_to_array("probability")[1].alias("block_score"), (F.col("prediction") == 1).alias("blocked")
    )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, block_score.

    The longest fitting rule decides. The URLs that rules decide are the labelled ones; trees
    trained on them decide the rest. Null URLs have empty host and path and are judged like others.
    """
    parts = url_parts(F.col("url"))
    split = pages.select("page_id", "url", *[column.alias(name) for name, column in parts.items()])
    ruled = split.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    labelled = ruled.where("hit is not null").select("url", "host", "path", (F.col("hit.verdict") == "block").alias("block"))
    return judge(ruled, labelled).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "block_score",
    )
