"""Shards, URL verdicts, vectors, Jaccard join and mixing on small inputs against brute force."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm import embedding_dedup, jaccard_join, kdtree_shards, source_mix, topk_search, url_filter
from recollect.llm.common import components
from recollect.llm.queries import URL_RULES


def roots(ids, links):
    parent = {k: k for k in ids}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(4)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    links += [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
    edges = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    expected = roots({k for e in links for k in e}, links)
    assert got == {k: v for k, v in expected.items() if any(a != b and k in (a, b) for a, b in links)}
    assert components(edges.limit(0)).count() == 0


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "word " * int(rng.integers(1, 60)) + str(k), "x") for k in range(600)]
    rows += [(k, "the same text", "y") for k in range(600, 680)] + [(700, None, "z"), (701, "", "z"), (None, "null id", "z"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = kdtree_shards.shard_documents(docs).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    sizes = got.groupby("shard")["size"].sum()
    assert list(sizes.index) == list(range(8)) and sizes.max() < 1.1 * sizes.min()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc_id >= 600].query("doc_id < 680").shard.nunique() == 1
    expected = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted(zip(got["size"], got.text_crc32)) == expected
    again = kdtree_shards.shard_documents(docs.repartition(3)).toPandas()
    assert sorted(zip(again.text_crc32, again.shard)) == sorted(zip(got.text_crc32, got.shard))
    assert kdtree_shards.shard_documents(docs.limit(0)).count() == 0
    one = kdtree_shards.shard_documents(docs.where("doc_id = 700")).collect()
    assert len(one) == 1 and one[0]["slot"] == 0 and 0 <= one[0]["shard"] < 8


def test_group_above_half_a_shard_is_cut(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a text that all share").alias("text"))
    sizes = kdtree_shards.shard_documents(docs).groupBy("shard").count().toPandas()
    assert len(sizes) == 8 and sizes["count"].max() - sizes["count"].min() <= 8


def test_equal_rows_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(kdtree_shards, "COPY_ROWS", 64)
    docs = spark.createDataFrame([(7, "same text", None)] * 800 + [(None, None, "x")] * 3, "doc_id long, text string, source string")
    got = kdtree_shards.shard_documents(docs).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 803 and len(sizes) == 8 and sizes.max() - sizes.min() <= 20
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = kdtree_shards.shard_documents(docs.repartition(5)).toPandas()
    order = ["shard", "slot"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))


def test_shards_are_those_of_a_plain_tree(spark):
    rng = np.random.default_rng(9)
    words = ["ab", "cd\n", "é", "long words "]
    rows = [(k, "".join(rng.choice(words, int(rng.integers(1, 80)))) + str(k)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = kdtree_shards.shard_documents(docs).toPandas().set_index("doc_id")
    dims = docs.select("doc_id", *[c.alias(n) for n, c in kdtree_shards.text_dimensions(F.col("text")).items()]).toPandas().set_index("doc_id")
    spans = (dims.max() - dims.min()).clip(lower=1)
    # Every level parts its rows along the widest dimension, with bytes as the halves of the leaves ask.
    for width in (8, 4, 2):
        for first in range(0, 8, width):
            node = got[(got["shard"] >= first) & (got["shard"] < first + width)]
            left, right = node[node["shard"] < first + width // 2], node[node["shard"] >= first + width // 2]
            own = dims.loc[node.index]
            axis = ((own.max() - own.min()) / spans).idxmax()
            assert dims.loc[left.index, axis].max() <= dims.loc[right.index, axis].min()
            assert abs(left["size"].sum() - right["size"].sum()) <= 2 * node["size"].max()


def test_url_rules_decide_and_trees_learn_the_rest(spark):
    urls = {
        1: ("http://A.Example.ORG/en/1x", "a.example.org", "/en/1x", "example.org/en/1", "block"),
        2: ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        3: ("http://b.org/x?y", "b.org", "/x", "org/", "allow"),
        4: ("http://x.com/fr/a#b", "x.com", "/fr/a", "com/fr/", "allow"),
        5: ("http://com/de/", "com", "/de/", "com/de/", "block"),
        6: ("http://notorg/x", "notorg", "/x", None, None), 7: (None, "", "", None, None), 8: ("", "", "", None, None),
        9: ("no scheme", "", "", None, None), 10: ("a://É.net?b", "É.net", "", None, None),
        11: ("http://z.net/" + "x" * 100_000, "z.net", "/" + "x" * 100_000, None, None),
    }
    pages = spark.createDataFrame([(k, u[0], "h") for k, u in urls.items()] + [(1, urls[1][0], "h")], "page_id long, url string, host string")
    got = url_filter.filter_urls(pages, URL_RULES).collect()
    assert len(got) == 12
    for row in got:
        _, host, path, rule, verdict = urls[row["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict or verdict is None and row["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages.where("page_id > 6"), URL_RULES).collect()} == {"allow"}
    # Labels that lexical features tell apart are learned.
    labelled = spark.range(400).select(
        F.concat(F.lit("http://h.net/"), F.when(F.col("id") % 2 == 0, (F.col("id") + 10**6).cast("string")).otherwise(F.lit("story"))).alias("url"),
        F.lit("h.net").alias("host"), F.lit("/").alias("path"), (F.col("id") % 2 == 0).alias("block"),
    )
    judged = url_filter.judge(labelled, labelled)
    assert judged.where("blocked <> block").count() == 0


def test_url_statistics_cover_all_labels_and_rare_classes_are_trained(spark):
    # 20 blocked URLs among 20,000, on domains of their own: a sample of 50 rows would miss them all.
    blocked = F.col("id") % 1000 == 7
    name = F.concat(F.when(blocked, F.lit("bad")).otherwise(F.lit("good")), (F.col("id") % 100).cast("string"))
    host = F.concat(F.lit("w."), name, F.when(blocked, F.lit(".xx")).otherwise(F.lit(".net")))
    labelled = spark.range(20_000).select(
        F.concat(F.lit("http://"), host, F.lit("/"), F.format_string("%05d", "id")).alias("url"), host.alias("host"),
        F.format_string("/%05d", "id").alias("path"), blocked.alias("block"),
    )
    fresh = labelled.where("block or path < '/00300'").select(F.concat("url", F.lit("9")).alias("url"), "host", F.concat("path", F.lit("9")).alias("path"), "block")
    judged = url_filter.judge(fresh, labelled, train_rows=50)
    assert judged.where("block").count() == 20 and judged.where("blocked <> block").count() == 0


VECTORS = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
    (7, [2.0, 0.01]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 0.0]), (10, [1e300, 1e280]), (11, [float("inf"), 0.0]),
]


def test_url_trees_generalise_to_hosts_they_have_not_seen(spark):
    rng = np.random.default_rng(3)

    def url(bad):
        host = f"{rng.choice(list('abcdefgh'))}{rng.integers(10**6)}.test"
        return f"http://{host}/{'x7' * int(rng.integers(6, 15))}?q={rng.integers(10**9)}&r=1" if bad else f"https://{host}/news/today"

    rows = [(u, u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0], bad) for k in range(800) for bad in [k % 2 == 0] for u in [url(bad)]]
    # The label of one in ten is wrong: a feature that shows a row's own label would be believed more than its letters.
    noisy = [(*r[:3], r[3] != (zlib.crc32(r[0].encode()) % 10 == 0)) for r in rows]
    every = spark.createDataFrame(noisy, "url string, host string, path string, block boolean")
    held = F.crc32(F.col("url").cast("binary")) % 4 == 2
    judged = url_filter.judge(every.where(held), every.where(~held)).select("url", "blocked").collect()
    truth = {r[0]: r[3] for r in rows}
    assert len(judged) > 150 and sum(truth[r["url"]] == r["blocked"] for r in judged) >= 0.97 * len(judged)


def test_training_rows_get_the_rates_of_other_folds(spark):
    rows = spark.createDataFrame([("u", "s", "d", 1)], "url string, suffix string, domain string, fold int")
    rows = rows.withColumns({n: F.lit(0) for n in url_filter.FEATURES if n not in ("suffix_rows", "suffix_rate", "domain_rate")})
    labelled = spark.createDataFrame([("s", "d", 1, 10, 4.0), ("s", "e", 0, 40, 0.0), ("t", "f", 2, 9, 9.0)], "suffix string, domain string, fold int, rows long, bad double")
    counts = [url_filter._counts(labelled, key) for key in ("suffix", "domain")]
    names = ("suffix_rows", "suffix_rate", "domain_rate")
    got = url_filter._with_rates(rows, *counts, 0.3).select(*names).first()
    assert tuple(got) == (40.0, 6.0 / 60, 0.3)
    got = url_filter._with_rates(rows.drop("fold"), *counts, 0.3).select(*names).first()
    assert tuple(got) == (50.0, 10.0 / 70, 10.0 / 30)


def test_vectors_link_at_the_cosine_and_odd_ones_with_nothing(spark):
    odd = spark.createDataFrame([(*v, 1) for v in VECTORS], "vec_id long, embedding array<double>, kept int")
    got = {r["id"]: r[1:] for r in embedding_dedup.near_vectors(odd, "vec_id", "embedding").collect()}
    assert {k: got[k] for k in (1, 2, 7, 10)} == {1: (3, 1, True), 2: (3, 1, False), 7: (3, 1, False), 10: (3, 1, False)}
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 8, 9, 11)) and got[None] == (0, None, True)
    assert embedding_dedup.near_vectors(odd.limit(0), "vec_id", "embedding").count() == 0


def test_vector_links_equal_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 12))
    x = np.concatenate([base[rng.integers(60, size=500)] + rng.normal(scale=0.22, size=(500, 12)), base[:3].repeat(5, axis=0)])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    expected = roots(range(len(x)), zip(*map(np.ndarray.tolist, np.nonzero(near))))
    got = embedding_dedup.near_vectors(frame, "vec_id", "embedding", cell_rows=40).toPandas().sort_values("id")
    assert got.n_links.tolist() == near.sum(axis=1).tolist() and near.sum() > 500
    assert got.component_id.tolist() == [expected[k] for k in range(len(x))]
    assert got.kept.tolist() == [expected[k] == k for k in range(len(x))]


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8)).round(1)
    x[300:] = x[rng.integers(300, size=100)]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(int)
    expected = set()
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        best = [k for k in np.lexsort((np.arange(400), -score)) if k != q][:5]
        expected |= {(q, n + 1, int(k), int(score[k])) for n, k in enumerate(best)}
    assert set(map(tuple, topk_search.top_k(frame, "vec_id", "embedding", "id % 50 = 0").collect())) == expected


def test_top_k_of_odd_vectors(spark):
    odd = spark.createDataFrame([(*v, 1) for v in VECTORS] + [(50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1)], "vec_id long, embedding array<double>, score int")
    got = topk_search.top_k(odd.where("vec_id <> 10"), "vec_id", "embedding", "id % 50 = 0").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [
        (50, 1, 7, 512 * 256 + 2 * 128), (50, 2, 1, 65536), (50, 3, 2, 65536), (50, 4, 4, 0),
    ]
    assert topk_search.top_k(odd.limit(0), "vec_id", "embedding", "id % 50 = 0").count() == 0


def grams(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}


def test_jaccard_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, passage = [], " ".join(rng.choice(vocabulary, 60))
    for family in range(14):
        words = rng.choice(vocabulary, rng.integers(3, 160))
        for _ in range(rng.integers(1, 14)):
            copy = words.copy()
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy) + (f" {passage}" if family % 3 == 0 else ""))
    rows += [None, "", " \t", "one", "ONE", "one two", "One\x0btwo", "a b c", "a b c", "É b c", "é b c", " ".join(["x"] * 40_000)]
    docs = spark.createDataFrame([(7 * k % 1009, t, "c") for k, t in enumerate(rows)] + [(None, "a b c", "c")], "doc_id long, text string, size string")
    for n, percent in ((3, 90), (5, 80)):
        sets = {7 * k % 1009: grams(t, n) for k, t in enumerate(rows)}
        links = [
            (a, b) for a in sets for b in sets
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        ]
        expected = roots(sets, links)
        got = jaccard_join.near_copies(docs, n, percent).collect()
        assert len(got) == docs.count()
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
        assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got if r["doc_id"] is not None)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(k for k, v in expected.items() if k == v)
    assert kept.where("doc_id is null").count() == 1
    assert jaccard_join.near_copies(docs.limit(0)).count() == 0


def test_a_pair_comes_out_of_one_of_its_grams():
    """Members of a family meet in many grams; each pair is made once, none is lost, and a null list leaves none out."""
    rng = np.random.default_rng(7)
    sets = [sorted({*range(40), *rng.choice(np.arange(40, 60), 10, replace=False).tolist()}) for _ in range(24)]
    bits = [jaccard_join.bitmap(np.array(grams, np.uint64)).view(np.int64).tolist() for grams in sets]

    def made(listed):
        found = []
        for gram in range(60):
            keys = [k for k, grams in enumerate(sets) if gram in grams]
            first = [[g for g in sets[k][:32] if g < gram] if listed(k) else None for k in keys]
            a, b = jaccard_join._walk(pa.table({
                "pair": [gram] * len(keys), "side": [0] * len(keys), "id": keys, "size": [len(sets[k]) for k in keys],
                "bits": pa.array([bits[k] for k in keys], pa.list_(pa.int64())), "class": keys,
                "first": pa.array(first, pa.list_(pa.int64())),
            }), 60)
            found += zip(a.tolist(), b.tolist())
        return found

    everything = sorted((a, b) for a in range(24) for b in range(a + 1, 24))
    assert sorted(made(lambda k: True)) == everything
    assert {*made(lambda k: k % 2)} == {*everything}


def test_members_without_a_partner_do_not_reach_the_trees(spark, monkeypatch):
    """Beginnings of one passage share grams, but none is within 90 % of another: no row gets a bitmap."""
    rows, stage = {}, jaccard_join.stage

    def counted(df, name):
        out = stage(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stage", counted)
    words = [f"w{k}" for k in range(700)]
    docs = spark.createDataFrame([(k, " ".join(words[:int(30 * 1.3**k)])) for k in range(12)], "doc_id long, text string")
    got = jaccard_join.near_copies(docs).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    assert rows["met"] > 0 and rows["members"] == 0


def test_first_common_grams_lose_no_pair(spark, monkeypatch):
    """Sizes and places leave out no link, in single blocks and in many; ids with several rows or texts included."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(90)]
    rows = []
    for family in range(10):
        words = rng.choice(vocabulary, rng.integers(20, 120)).tolist()
        for _ in range(9):
            start, stop = rng.integers(0, 5), len(words) - rng.integers(0, 5)
            copy = words[start:stop] + rng.choice(vocabulary, rng.integers(0, 4)).tolist()
            rows.append((len(rows), " ".join(copy)))
    rows += [rows[3], rows[3], (11, rows[40][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(k, grams(t, 3)) for k, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(x & y) >= 85 * len(x | y)]
    expected = roots(sorted({k for k, _ in sets}), links)
    for name, size in (("BLOCK_ROWS", 256), ("BLOCK_ROWS", 4), ("FIRST_GRAMS", 1)):
        monkeypatch.setattr(jaccard_join, name, size)
        got = jaccard_join.near_copies(docs, 3, 85).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == expected


def test_tree_walk_loses_no_pair():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.append(s[:-1], 7).astype(np.uint64)) for s in sets[:60]]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard_join.Tree(sizes, np.array([jaccard_join.bitmap(s) for s in sets]))
    found = set(zip(*map(np.ndarray.tolist, tree.pairs(tree, 80))))
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                assert (a, b) in found
            wide = [np.packbits(np.isin(np.arange(n), s % np.uint64(n))).view(np.uint64).tobytes() for n, s in ((256, sets[a]), (512, sets[b]))]
            assert both <= jaccard_join.most_shared(sizes[a], wide[0], sizes[b], wide[1])


def test_flight_keeps_totals_and_expectation():
    rng = np.random.default_rng(1)
    sizes, share = rng.integers(1, 500, 60), rng.uniform(0.1, 0.9, 60)
    total = np.zeros(60)
    for seed in range(400):
        after = source_mix.flight(share, sizes, np.random.default_rng(seed))
        assert ((after > 1e-9) & (after < 1 - 1e-9)).sum() <= 2
        assert np.isclose(after.sum(), share.sum()) and np.isclose((after * sizes).sum(), (share * sizes).sum())
        total += after
    assert np.abs(total / 400 - share).max() < 0.12
    assert source_mix.flight(np.full(9, 0.5), np.full(9, 3), rng).sum() == 4.5


def water_level(sizes, weights, total, most):
    targets, capped = {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        weight = sum(weights[s] for s in sizes if s not in capped)
        targets = {s: most * sizes[s] if s in capped else left * weights[s] / weight for s in sizes}
        over = {s for s in sizes if targets[s] > most * sizes[s] + 1e-9}
        if not over:
            return targets
        capped |= over


def test_mixture_meets_targets_and_is_repeatable(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "FLIGHT_UNITS", 32)
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(1, 40)), ["b", "a", "é", "Z", "big"][min(k % 9, 4)]) for k in range(900)]
    rows += [(901, None, "a"), (902, "", None), (903, "x\ty\u00a0z  v", None), (None, "n n", "b"), (904, "one two", None), (10, "again", rows[10][2])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = source_mix.mixture(docs).toPandas()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    assert sorted(got["size"]) == sorted(size(t) for _, t, _ in rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    order = sorted((s for s in sizes if s is not None)) + [None]
    expected = water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    by_source = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert sorted(np.round(by_source.target, 6)) == sorted(np.round(list(expected.values()), 6))
    assert (abs(by_source.taken - by_source.target) <= 40).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken[got["size"] > 0] % got["size"][got["size"] > 0] == 0).all()
    again = source_mix.mixture(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    taken = source_mix.mixed_rows(docs)
    assert taken.columns == docs.columns
    assert sum(size(r["text"]) for r in taken.collect()) == got.taken.sum()
    assert source_mix.mixture(docs.limit(0)).count() == 0


def test_small_sources_meet_their_target(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(60, 700))), f"s{k % 5}") for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mixture(docs).toPandas()
    got["source"] = got["doc_id"].map(lambda k: f"s{k % 5}")
    for _, part in got.groupby("source"):
        target = part["target"].iloc[0]
        assert abs(part["taken"].sum() - target) <= max(0.01 * target, part["size"].median() / 2)


def test_landing_is_exact_where_an_exchange_can_be():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(50, 900, 50).astype(float)
        share = np.full(50, rng.uniform(0.2, 0.9))
        after = source_mix._landing(source_mix._settle(source_mix.flight(share, sizes, rng), sizes, rng), sizes)
        assert set(after) <= {0.0, 1.0} and abs((after - share) @ sizes) <= 0.01 * (share @ sizes)
    assert source_mix._landing(np.array([]), np.array([])).size == 0
    assert source_mix._landing(np.array([0.0, 1.0, 0.6]), np.array([6.0, 4.0, 10.0]), np.array([True, True, False])).tolist() == [0, 1, 1]


def test_top_k_finds_k_keys_where_keys_have_many_vectors(spark):
    # Key 1 has 30 vectors that are all better than those of the other keys.
    rows = [(0, [1.0, 0.0])] + [(1, [9.0, float(k)]) for k in range(30)] + [(k, [2.0 + k / 10, 0.0]) for k in range(2, 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["rank"]: r["vec_id"] for r in topk_search.top_k(vectors, "vec_id", "embedding", "id = 0").collect()}
    assert got == {1: 1, 2: 11, 3: 10, 4: 9, 5: 8}
