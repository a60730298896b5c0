"""SQL counterparts of the registered queries, written for the same test tables."""

from __future__ import annotations

_KEY = "orderkey, linenumber, partkey, suppkey"
_FULL = f"{_KEY}, price, quantity"

_VIEWS = {
    "li": """SELECT l_orderkey AS orderkey, l_linenumber::BIGINT AS linenumber,
        l_partkey AS partkey, l_suppkey AS suppkey, l_extendedprice AS price,
        l_quantity AS quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus,
        o_custkey + 1 AS uid, l_partkey + 1 AS iid, o_orderdate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "samples": """SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::BIGINT AS label,
        row_number() OVER (ORDER BY orderkey, linenumber, partkey, suppkey, price, quantity) - 1 AS row_no
        FROM li WHERE o_orderdate >= TIMESTAMP '2000-01-01'""",
    "items": """SELECT p_partkey + 1 AS iid, dense_rank() OVER (ORDER BY p_type) AS cate,
        regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS i1, p_size::BIGINT AS i2 FROM part""",
    "hist": """SELECT uid, iid AS item, coalesce(cate, 0) AS cate,
        row_number() OVER (PARTITION BY uid ORDER BY o_orderdate, orderkey, linenumber, partkey,
            suppkey, price, l_shipdate, quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS i,
        count(*) OVER (PARTITION BY uid) AS n
        FROM li LEFT JOIN items USING (iid) WHERE o_orderdate < TIMESTAMP '2000-01-01'""",
    "customers": """SELECT c_custkey + 1 AS uid, c_nationkey::BIGINT + 1 AS u1,
        dense_rank() OVER (ORDER BY c_mktsegment) AS u2, (c_nationkey::BIGINT + 1) % 7 AS u3,
        dense_rank() OVER (ORDER BY c_mktsegment) % 3 AS u4,
        floor(c_acctbal / 1000)::BIGINT AS u5 FROM customer""",
    "lists": """SELECT uid, string_agg(item::VARCHAR, ',' ORDER BY i) AS hist_items,
        string_agg(cate::VARCHAR, ',' ORDER BY i) AS hist_cates FROM hist GROUP BY uid""",
    "padded": """SELECT c.uid, p.pos, coalesce(h.item, 0) AS item, coalesce(h.cate, 0) AS cate
        FROM customers c CROSS JOIN (SELECT unnest(range(40)) AS pos) p
        LEFT JOIN hist h ON h.uid = c.uid AND h.i = h.n - 40 + p.pos""",
    "vec": """SELECT vec_id + 1 AS iid, list_transform(embedding, lambda x:
        CAST(trunc(greatest(CAST(-1 AS FLOAT), least(CAST(1 AS FLOAT), x)) * CAST(127 AS FLOAT)) AS DOUBLE)) AS v
        FROM embeddings""",
    "freq_list": """SELECT 'hist_items' AS feature, item AS id, count(*) AS freq FROM hist GROUP BY item
        UNION ALL SELECT 'hist_cates', cate, count(*) FROM hist GROUP BY cate""",
    "freq_scalar": """SELECT feature, id, count(*) AS freq FROM (
        UNPIVOT (SELECT uid, u1, u2, u3, u4, u5 FROM customers) ON uid, u1, u2, u3, u4, u5
            INTO NAME feature VALUE id) GROUP BY feature, id
        UNION ALL
        SELECT feature, id, count(*) FROM (
        UNPIVOT (SELECT iid, cate, i1, i2 FROM items) ON iid, cate, i1, i2
            INTO NAME feature VALUE id) GROUP BY feature, id""",
    "p90": """WITH ranked AS (
            SELECT item, freq, sum(freq) OVER (ORDER BY freq DESC, item) AS c, sum(freq) OVER () AS t
            FROM (SELECT item, count(*) AS freq FROM hist GROUP BY item)),
        cut AS (SELECT max(freq) AS f FROM ranked WHERE c * 100 > 90 * t),
        ids AS (SELECT item AS id FROM ranked, cut WHERE freq >= f UNION SELECT iid FROM samples)
        SELECT 'hist_items' AS vocab, id, row_number() OVER (ORDER BY id) AS idx FROM ids WHERE id <> 0""",
    "merged": """SELECT vocab, id, row_number() OVER (PARTITION BY vocab ORDER BY id) AS idx FROM (
        SELECT 'hist_items' AS vocab, item AS id FROM hist UNION SELECT 'hist_items', iid FROM items
        UNION SELECT 'hist_cates', cate FROM hist UNION SELECT 'hist_cates', cate FROM items)
        WHERE id <> 0""",
    "pairs": """SELECT s.*, p.pos, p.item, p.cate,
        coalesce(list_dot_product(t.v, k.v), 0) AS dot, list_dot_product(t.v, t.v) AS nq,
        list_dot_product(k.v, k.v) AS nk
        FROM samples s JOIN padded p USING (uid)
        LEFT JOIN vec t ON t.iid = s.iid LEFT JOIN vec k ON k.iid = p.item""",
    "cosines": """SELECT *, CASE WHEN dot = 0 THEN 0 ELSE dot / sqrt(nq * nk) END AS cos FROM pairs""",
    "found": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_no
        ORDER BY CASE WHEN dot = 0 THEN -1.1 ELSE cos END DESC, pos DESC) AS rank FROM cosines)
        WHERE rank <= 10""",
    "scores": f"""SELECT {_KEY}, uid, label, quantity / CAST(50 AS DOUBLE) AS score,
        orderkey % 16 AS batch_id FROM samples""",
}

_NEEDS = {
    "samples": ["li"], "hist": ["li", "items"], "lists": ["hist"], "padded": ["customers", "hist"],
    "freq_list": ["hist"], "freq_scalar": ["customers", "items"], "p90": ["hist", "samples"],
    "merged": ["hist", "items"], "pairs": ["samples", "padded", "vec"], "cosines": ["pairs"],
    "found": ["cosines"], "scores": ["samples"],
}


def _with(names: str, body: str) -> str:
    """``body`` preceded by the named views and the views those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order)
    own = body.lstrip()
    joiner = ",\n" + own[len("WITH "):] if own.startswith("WITH ") else "\n" + own
    return f"WITH {ctes}{joiner}"


def _entries(source: str) -> str:
    return f"""SELECT {_KEY}, rank, pos::BIGINT AS pos, item, cate, round(cos, 6) AS cos FROM {source}"""


def _tiers(source: str) -> str:
    return f"""WITH tiers AS (SELECT row_no, ceil(cos * 10)::BIGINT + 10 AS tier, count(*) AS n
            FROM {source} GROUP BY ALL)
        SELECT {_KEY}, g.tier, coalesce(n, 0)::BIGINT AS n, round(ln(coalesce(n, 0) + 1), 6) AS log_n
        FROM samples s CROSS JOIN (SELECT unnest(range(22)) AS tier) g
        LEFT JOIN tiers t ON t.row_no = s.row_no AND t.tier = g.tier"""


_RECENT = "(SELECT * FROM cosines WHERE pos >= 30)"

# Entries with their dequantised vectors, dot products on the same scale, and attention logits.
_POOL_VIEWS = """WITH chosen AS (
        SELECT f.*, CASE WHEN k.v IS NULL THEN NULL ELSE list_transform(k.v, lambda x: x / 127) END AS w,
            f.dot / (127.0::DOUBLE * 127.0::DOUBLE) AS d
        FROM {source} f LEFT JOIN vec k ON k.iid = f.item),
    logits AS (SELECT *, {logit} AS logit FROM chosen),
    alphas AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_no)) AS e FROM logits),
    weighted AS (SELECT *, {weight} AS a FROM alphas),
    dims AS (SELECT row_no, j, sum(a * w[j]) AS x FROM (
        SELECT row_no, a, w, unnest(range(1, 65)) AS j FROM weighted WHERE w IS NOT NULL) GROUP BY row_no, j)"""
_POOL_SELECT = f"""SELECT {_KEY}, round(coalesce(sum(x), 0), 6) AS total,
        round(coalesce(sum(x * j), 0), 6) AS weighted, round(coalesce(sum(x * x), 0), 6) AS square
    FROM samples LEFT JOIN dims USING (row_no) GROUP BY row_no, {_KEY}"""
_SOFTMAX = "e / sum(e) OVER (PARTITION BY row_no) + 1e-7"


def _pool(source: str, logit: str = "0", weight: str = _SOFTMAX) -> str:
    return _POOL_VIEWS.format(source=source, logit=logit, weight=weight) + _POOL_SELECT


_ATTENTION = "d + cos / 0.1 + d * (cos / 0.1)"


def _features(ablate: bool = False, source: str = "found", views: str = "") -> str:
    """Three moments of each of the six vector features; ``source`` has ten chosen entries a sample."""

    def pooled(name: str, source: str, logit: str, weight: str) -> str:
        views = _POOL_VIEWS.format(source=source, logit=logit, weight=weight)
        return f"{name} AS ({views} SELECT row_no, sum(x) AS t, sum(x * j) AS w, sum(x * x) AS s FROM dims GROUP BY row_no)"

    def tiers(name: str, source: str) -> str:
        return f"""{name} AS (SELECT row_no, sum(ln(n + 1)) AS t, sum(ln(n + 1) * (tier + 1)) AS w, sum(ln(n + 1) * ln(n + 1)) AS s
            FROM (SELECT row_no, ceil(cos * 10) + 10 AS tier, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY row_no)"""

    names = {
        "mean_top": pooled("mean_top", source, "0", "0.1::DOUBLE"),
        "attention_top": pooled("attention_top", source, _ATTENTION, _SOFTMAX),
        "mean_recent": pooled("mean_recent", _RECENT, "0", "0.1::DOUBLE"),
        "attention_recent": pooled("attention_recent", _RECENT, "d", _SOFTMAX),
        "tiers_top": tiers("tiers_top", source), "tiers_recent": tiers("tiers_recent", _RECENT),
    }
    columns = ", ".join(
        f"0.0::DOUBLE AS {n}_{kind}" if ablate and n.endswith("_top") else f"round(coalesce({n}.{kind[0]}, 0) + 1e-6 / 3, 6) AS {n}_{kind}"
        for n in names for kind in ("total", "weighted", "square")
    )
    joins = " ".join(f"LEFT JOIN {n} ON {n}.row_no = s.row_no" for n in names)
    return f"""WITH {views}{", ".join(names.values())}
        SELECT {_KEY}, label, s.uid, u1, u2, u3, u4, u5, s.iid, cate, i1, i2, {columns}
        FROM samples s JOIN customers USING (uid) JOIN items USING (iid) {joins}"""


_SOFT_VIEWS = """parts AS (SELECT cate, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM vec JOIN items USING (iid)),
    sums AS (SELECT cate, d, sum(x) AS s FROM parts GROUP BY ALL),
    tops AS (SELECT cate, max(abs(s)) AS m FROM sums GROUP BY cate),
    cvec AS (SELECT cate, list(CASE WHEN m = 0 THEN 0.0 ELSE trunc(s * CAST(127 AS DOUBLE) / m) END ORDER BY d) AS v
        FROM sums JOIN tops USING (cate) GROUP BY cate),
    soft_pairs AS (SELECT s.*, p.pos, p.item, p.cate,
        coalesce(list_dot_product(ti.v, ki.v), 0) + coalesce(list_dot_product(tc.v, kc.v), 0) AS dot,
        coalesce(list_dot_product(ti.v, ti.v), 0) + coalesce(list_dot_product(tc.v, tc.v), 0) AS nq,
        coalesce(list_dot_product(ki.v, ki.v), 0) + coalesce(list_dot_product(kc.v, kc.v), 0) AS nk
        FROM samples s LEFT JOIN items i USING (iid) JOIN padded p ON p.uid = s.uid
        LEFT JOIN vec ti ON ti.iid = s.iid LEFT JOIN cvec tc ON tc.cate = i.cate
        LEFT JOIN vec ki ON ki.iid = p.item LEFT JOIN cvec kc ON kc.cate = p.cate),
    soft_cos AS (SELECT *, CASE WHEN dot = 0 THEN 0 ELSE dot / sqrt(nq * nk) END AS cos FROM soft_pairs),
    soft_found AS (SELECT *, row_number() OVER (PARTITION BY row_no
        ORDER BY CASE WHEN dot = 0 THEN -1.1 ELSE cos END DESC, pos DESC) AS rank FROM soft_cos)"""

# What the soft search finds, and the matches of the hard search filled up to ten, with content cosines.
_SOFT_PICKS = f"""{_SOFT_VIEWS},
    soft_picks AS (SELECT c.* FROM cosines c JOIN soft_found f ON f.row_no = c.row_no AND f.pos = c.pos WHERE f.rank <= 10), """
_HARD_PICKS = """hard_ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.row_no ORDER BY c.pos DESC) AS rank
        FROM cosines c JOIN items i USING (iid) WHERE c.cate = i.cate),
    hard_picks AS (SELECT s.row_no, r.item, coalesce(r.dot, 0) AS dot, coalesce(r.cos, 0) AS cos
        FROM samples s CROSS JOIN (SELECT unnest(range(1, 11)) AS rank) g
        LEFT JOIN hard_ranked r ON r.row_no = s.row_no AND r.rank = g.rank), """


_PAIR_COUNTS = """groups AS (SELECT {by}score, sum(label) AS pos, sum(1 - label) AS neg
        FROM {source} GROUP BY {by}score),
    below AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM groups)"""


def _pair_counts(by: str = "", source: str = "scores") -> str:
    return _PAIR_COUNTS.format(
        by=f"{by}, " if by else "", part=f"PARTITION BY {by} " if by else "", source=source
    )


_USERS = """users AS (SELECT {by}uid, sum(pos) AS p, sum(neg) AS n, sum(pos * neg_below) AS wins
        FROM below GROUP BY {by}uid HAVING sum(pos) > 0 AND sum(neg) > 0)"""
_USER_SUMS = "sum(wins / (p * n)::DOUBLE * (p + n))"

_CURVE = """grid AS (SELECT i AS no, CASE WHEN i = 0 THEN 0.0::DOUBLE - 1e-7 WHEN i = 199 THEN 1.0::DOUBLE + 1e-7
        ELSE i / 199::DOUBLE END AS t FROM (SELECT unnest(range(200)) AS i)),
    tied AS (SELECT {by}score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL),
    counts AS (SELECT {by}no, sum(CASE WHEN score > t THEN pos ELSE 0 END)::BIGINT AS tp,
        sum(CASE WHEN score > t THEN neg ELSE 0 END)::BIGINT AS fp,
        sum(CASE WHEN score > t THEN 0 ELSE neg END)::BIGINT AS tn,
        sum(CASE WHEN score > t THEN 0 ELSE pos END)::BIGINT AS fn
        FROM tied CROSS JOIN grid GROUP BY ALL)"""


def _area(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}sum((x - x2) * ((y + y2) / 2)) AS auroc FROM (SELECT {lead}x, y,
            lead(x) OVER ({part}ORDER BY no) AS x2, lead(y) OVER ({part}ORDER BY no) AS y2
        FROM (SELECT {lead}no, fp / (fp + tn + 1e-6) AS x, (tp + 1e-6) / (tp + fn + 1e-6) AS y
            FROM {source})) {f"GROUP BY {by}" if by else ""}"""


_LOSS = "-ln(least(greatest((CASE WHEN label = 1 THEN score ELSE 1 - score END) + 1e-7, 0), 1))"

_CONFUSION = f"WITH {_CURVE.format(by='')} SELECT no AS threshold_no, tp, fp, tn, fn FROM counts"


def _running(step: str) -> str:
    """Per-step and accumulated metrics with one row per value of ``step``."""
    return f"""WITH scores AS (SELECT uid, label, quantity / CAST(50 AS DOUBLE) AS score,
            {step} AS step FROM samples),
        {_pair_counts("step, uid")}, {_USERS.format(by="step, ")},
        user_sums AS (SELECT step, {_USER_SUMS} AS w, sum(p + n) AS imp FROM users GROUP BY step),
        all_groups AS (SELECT step, score, sum(label) AS pos, sum(1 - label) AS neg FROM scores GROUP BY ALL),
        all_below AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY step ORDER BY score
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM all_groups),
        steps AS (SELECT step, sum(pos * neg_below) AS wins, sum(pos) * sum(neg) AS pairs
            FROM all_below GROUP BY step),
        losses AS (SELECT step, avg({_LOSS}) AS loss FROM scores GROUP BY step),
        {_CURVE.format(by="step, ")},
        so_far AS (SELECT step, no, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(tn) OVER w AS tn,
            sum(fn) OVER w AS fn FROM counts
            WINDOW w AS (PARTITION BY no ORDER BY step ROWS UNBOUNDED PRECEDING)),
        areas AS ({_area("so_far", "step")}),
        running AS (SELECT step, wins::BIGINT AS wins, pairs::BIGINT AS pairs,
            round(wins / pairs::DOUBLE, 6) AS cur_auc, round(w / imp, 6) AS cur_gauc,
            round(sum(wins) OVER s / (sum(pairs) OVER s)::DOUBLE, 6) AS pair_auc_so_far,
            round(sum(w) OVER s / sum(imp) OVER s, 6) AS gauc_so_far, round(auroc, 6) AS auroc_so_far,
            round(loss, 6) AS loss, round(avg(loss) OVER s, 6) AS mean_loss
            FROM steps JOIN user_sums USING (step) JOIN losses USING (step) JOIN areas USING (step)
            WINDOW s AS (ORDER BY step ROWS UNBOUNDED PRECEDING))"""


_SHARDS = """WITH sharded AS (SELECT *, row_no // 100 AS shard_no, row_no % 100 AS row_in_shard FROM samples),
    shards AS (SELECT shard_no, count(*) AS n_rows FROM sharded GROUP BY shard_no),
    placed AS (SELECT *, row_number() OVER (ORDER BY shard_no) - 1 AS position FROM shards),
    marked AS (SELECT *, position < (SELECT count(*) - count(*) % 8 FROM shards) AS used FROM placed),
    plan AS (SELECT *, CASE WHEN used THEN position % 8 END AS rank,
        CASE WHEN used THEN (position // 8) % 2 END AS worker FROM marked),
    turns AS (SELECT *, CASE WHEN used THEN row_number() OVER (PARTITION BY rank, worker ORDER BY position) - 1
        END AS turn FROM plan)"""

_LINES = """WITH src AS (SELECT p_partkey + 1 AS iid, p_size AS s,
        regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS brand FROM part),
    flags AS (SELECT *, s = 7 AS blank, s % 5 = 0 AS short, s % 5 <> 0 AND s % 2 <> 0 AS bad FROM src)"""

def _split(placed: str) -> str:
    """Rows of a split by shard file and place in it, with all features."""
    return f"""WITH placed AS ({placed})
        SELECT printf('train-shard-%06d.parquet', shard::BIGINT) AS shard_file, place::BIGINT AS row_in_shard, label, p.uid,
            u1, u2, u3, u4, u5, p.iid, cate, i1, i2, coalesce(l.hist_items, '') AS hist_items
        FROM placed p JOIN customers USING (uid) JOIN items USING (iid) LEFT JOIN lists l ON l.uid = p.uid"""


ORACLE: dict[str, str] = {
    "hard_match_counts": _with("samples items padded", f"""SELECT {_KEY}, s.uid, s.iid, i.cate,
            least(count(*) FILTER (WHERE p.cate = i.cate), 10)::BIGINT AS n_match,
            count(*) FILTER (WHERE p.cate = i.cate AND p.pos >= 30) AS n_match_recent
        FROM samples s LEFT JOIN items i USING (iid) JOIN padded p ON p.uid = s.uid
        GROUP BY row_no, {_KEY}, s.uid, s.iid, i.cate"""),
    "sample_join": _with("samples items customers lists", f"""SELECT {_KEY}, label, s.uid,
            CASE WHEN l.uid IS NULL THEN 0 ELSE u1 END AS u1, CASE WHEN l.uid IS NULL THEN 0 ELSE u2 END AS u2,
            CASE WHEN l.uid IS NULL THEN 0 ELSE u3 END AS u3, CASE WHEN l.uid IS NULL THEN 0 ELSE u4 END AS u4,
            CASE WHEN l.uid IS NULL THEN 0 ELSE u5 END AS u5, s.iid, cate, i1, i2, hist_items, hist_cates
        FROM samples s LEFT JOIN customers c ON c.uid = s.uid LEFT JOIN lists l ON l.uid = s.uid
        LEFT JOIN items i ON i.iid = s.iid"""),
    "pad_truncate": _with("padded", "SELECT uid, pos, item, cate FROM padded"),
    "misaligned_lists": _with("hist", """WITH sized AS (SELECT uid, max(n) AS n, max(n) - uid % 3 AS m,
            arg_max(item, i) AS newest, arg_max(cate, i) FILTER (i < n - uid % 3) AS cate FROM hist WHERE n > 2 GROUP BY uid)
        SELECT uid, CASE WHEN n = m THEN 'fitted' ELSE 'rejected' END AS kind, CASE WHEN n = m THEN 40 ELSE n END AS n_items,
            CASE WHEN n = m THEN 40 ELSE m END AS n_cates, newest AS newest_item, cate AS newest_cate FROM sized"""),
    "short_seq": _with(
        "padded", "SELECT uid, pos - 30 AS pos, item, cate, item AS content_key FROM padded WHERE pos >= 30"
    ),
    "id_freq_scalar": _with("freq_scalar", "SELECT * FROM freq_scalar"),
    "id_freq_list": _with("freq_list", "SELECT * FROM freq_list"),
    "freq_summary": _with("freq_scalar freq_list", """WITH freq AS (
            SELECT * FROM freq_scalar WHERE feature IN ('u1', 'u2', 'u3', 'u4', 'u5')
            UNION ALL SELECT * FROM freq_list),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY freq DESC, id) AS r FROM freq)
        SELECT feature, count(*) AS unique_count, sum(freq)::BIGINT AS total_occurrences,
            max(freq) AS top1_freq, max(id) FILTER (WHERE r = 1) AS top1_value, min(freq) AS min_freq,
            round(sum(freq) FILTER (WHERE r <= 10) / sum(freq)::DOUBLE, 6) AS top10_share,
            printf('%.2f%%', 100 * (sum(freq) FILTER (WHERE r <= 10) / sum(freq)::DOUBLE)) AS top10_coverage
        FROM ranked GROUP BY feature"""),
    "coverage_quantiles": _with("freq_list", """WITH ranked AS (SELECT feature, freq,
            row_number() OVER w AS i, sum(freq) OVER w AS c, sum(freq) OVER (PARTITION BY feature) AS t
            FROM freq_list WINDOW w AS (PARTITION BY feature ORDER BY freq DESC, id ROWS UNBOUNDED PRECEDING)),
        levels AS (SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99])::BIGINT AS level)
        SELECT feature, level, arg_min(freq, i) AS min_freq, round(arg_min(c / t::DOUBLE, i), 6) AS cumulative_ratio,
            min(i) AS num_items
        FROM ranked JOIN levels ON c * 100 > level * t GROUP BY feature, level"""),
    "log_histogram": _with("freq_list", """WITH bounds AS (SELECT feature, log10(min(freq)::DOUBLE) AS lo,
            log10(max(freq)::DOUBLE) AS hi FROM freq_list GROUP BY feature),
        binned AS (SELECT feature, least(floor((log10(freq::DOUBLE) - lo) / (hi - lo) * 100), 99)::BIGINT AS bin,
            count(*) AS n FROM freq_list JOIN bounds USING (feature) GROUP BY ALL),
        edges AS (SELECT feature, bin, pow(10::DOUBLE, lo + bin * (hi - lo) / 100) AS a,
            pow(10::DOUBLE, lo + (bin + 1) * (hi - lo) / 100) AS b
            FROM bounds CROSS JOIN (SELECT unnest(range(100)) AS bin))
        SELECT feature, bin, round(a, 6) AS low_edge, round(sqrt(a * b), 6) AS center,
            coalesce(n, 0)::BIGINT AS n_ids, round(ln(coalesce(n, 0) + 1) / ln(10), 6) AS log_count
        FROM edges LEFT JOIN binned USING (feature, bin)"""),
    "vocab": _with("freq_scalar", """SELECT feature AS vocab, id,
            row_number() OVER (PARTITION BY feature ORDER BY id) AS idx
        FROM freq_scalar WHERE id <> 0 AND feature NOT IN ('iid', 'cate')"""),
    "vocab_merged": _with("merged", "SELECT * FROM merged"),
    "vocab_p90": _with("p90", "SELECT * FROM p90"),
    "remap_ids": _with("samples items customers lists hist", f"""WITH known AS (
            SELECT c.* FROM customers c JOIN lists USING (uid)),
        ids AS (SELECT 'uid' AS v, uid AS id FROM known UNION SELECT 'u1', u1 FROM known
            UNION SELECT 'u2', u2 FROM known UNION SELECT 'u3', u3 FROM known
            UNION SELECT 'u4', u4 FROM known UNION SELECT 'u5', u5 FROM known
            UNION SELECT 'item', item FROM hist UNION SELECT 'cate', cate FROM hist
            UNION SELECT 'cate', cate FROM items UNION SELECT 'i1', i1 FROM items
            UNION SELECT 'i2', i2 FROM items),
        idx AS (SELECT v, id, row_number() OVER (PARTITION BY v ORDER BY id) AS x FROM ids WHERE id <> 0)
        SELECT {_KEY}, coalesce(a.x, 0) AS uid_idx, coalesce(b1.x, 0) AS u1_idx, coalesce(b2.x, 0) AS u2_idx,
            coalesce(b3.x, 0) AS u3_idx, coalesce(b4.x, 0) AS u4_idx, coalesce(b5.x, 0) AS u5_idx,
            coalesce(c.x, 0) AS iid_idx, coalesce(d.x, 0) AS cate_idx, coalesce(e.x, 0) AS i1_idx,
            coalesce(f.x, 0) AS i2_idx
        FROM samples s LEFT JOIN items i USING (iid) LEFT JOIN known k ON k.uid = s.uid
        LEFT JOIN idx a ON a.v = 'uid' AND a.id = s.uid LEFT JOIN idx b1 ON b1.v = 'u1' AND b1.id = k.u1
        LEFT JOIN idx b2 ON b2.v = 'u2' AND b2.id = k.u2 LEFT JOIN idx b3 ON b3.v = 'u3' AND b3.id = k.u3
        LEFT JOIN idx b4 ON b4.v = 'u4' AND b4.id = k.u4 LEFT JOIN idx b5 ON b5.v = 'u5' AND b5.id = k.u5
        LEFT JOIN idx c ON c.v = 'item' AND c.id = s.iid LEFT JOIN idx d ON d.v = 'cate' AND d.id = i.cate
        LEFT JOIN idx e ON e.v = 'i1' AND e.id = i.i1 LEFT JOIN idx f ON f.v = 'i2' AND f.id = i.i2"""),
    "remap_hist": _with("hist p90 merged", """SELECT uid, i AS pos, coalesce(p.idx, 0) AS item_idx,
            coalesce(m.idx, 0) AS cate_idx
        FROM hist LEFT JOIN p90 p ON p.id = item LEFT JOIN merged m ON m.vocab = 'hist_cates' AND m.id = cate"""),
    "dense_counts": _with("hist p90", """WITH counts AS (SELECT coalesce(idx, 0) AS idx, count(*) AS n
            FROM hist LEFT JOIN p90 ON id = item GROUP BY ALL)
        SELECT idx, coalesce(n, 0) AS n FROM (SELECT idx FROM p90 UNION ALL SELECT 0) LEFT JOIN counts USING (idx)"""),
    "mask_rare": _with("customers hist freq_list", """SELECT uid, coalesce(string_agg(
            (CASE WHEN freq >= 20 THEN item WHEN freq < 20 THEN 0 END)::VARCHAR, ',' ORDER BY i), '') AS hist_items
        FROM customers LEFT JOIN hist USING (uid)
        LEFT JOIN freq_list ON feature = 'hist_items' AND id = item GROUP BY uid"""),
    "mask_random": _with("customers hist", """SELECT uid, coalesce(string_agg((CASE WHEN
            ('0x' || substr(md5(concat_ws('|', 7, uid, i)), 1, 8))::BIGINT % 1000000 < 100000 THEN 0 ELSE item END)::VARCHAR,
            ',' ORDER BY i), '') AS hist_items
        FROM customers LEFT JOIN hist USING (uid) GROUP BY uid"""),
    "quantise": _with("vec", """SELECT iid, j - 1 AS dim, v[j]::BIGINT AS q
        FROM (SELECT iid, v, unnest(range(1, 65)) AS j FROM vec)"""),
    "dequantise": _with("vec", """SELECT iid, j - 1 AS dim,
            round(CAST(v[j]::FLOAT / CAST(127 AS FLOAT) AS DOUBLE), 6) AS x
        FROM (SELECT iid, v, unnest(range(1, 65)) AS j FROM vec)"""),
    "embedding_lookup": _with("samples vec", f"""SELECT {_KEY}, s.iid, 64::BIGINT AS width,
            coalesce(list_sum(v), 0)::BIGINT AS total, coalesce(list_dot_product(v, v), 0)::BIGINT AS square
        FROM samples s LEFT JOIN vec USING (iid)"""),
    "embedding_coverage": _with("samples padded vec", """WITH ids AS (
            SELECT 'target' AS part, iid AS id FROM samples UNION ALL SELECT 'history', item FROM padded),
        marked AS (SELECT part, id, v IS NOT NULL AS has FROM ids LEFT JOIN vec ON iid = id)
        SELECT part, count(*) AS positions, count(*) FILTER (WHERE has) AS covered,
            round(count(*) FILTER (WHERE has) / count(*)::DOUBLE, 6) AS rate,
            round(count(*) FILTER (WHERE has) / (count(*) FILTER (WHERE id <> 0))::DOUBLE, 6) AS rate_without_padding
        FROM marked GROUP BY part"""),
    "search_content": _with("found", _entries("found")),
    "search_soft": _with("samples items padded vec", f"""WITH {_SOFT_VIEWS}
        {_entries("soft_found")} WHERE rank <= 10"""),
    "search_hard": _with("samples items padded", f"""WITH matches AS (SELECT s.row_no, p.item, p.cate,
            row_number() OVER (PARTITION BY s.row_no ORDER BY p.pos DESC) AS rank
            FROM samples s LEFT JOIN items i USING (iid) JOIN padded p ON p.uid = s.uid AND p.cate = i.cate),
        kept AS (SELECT * FROM matches WHERE rank <= 10),
        sizes AS (SELECT row_no, count(*) AS n FROM kept GROUP BY row_no)
        SELECT {_KEY}, coalesce(z.n, 0) AS n_match, g.rank, coalesce(k.item, 0) AS item, coalesce(k.cate, 0) AS cate
        FROM samples s CROSS JOIN (SELECT unnest(range(1, 11)) AS rank) g
        LEFT JOIN kept k ON k.row_no = s.row_no AND k.rank = g.rank LEFT JOIN sizes z ON z.row_no = s.row_no"""),
    "tiers_short": _with("cosines", _tiers(_RECENT)),
    "tiers_search": _with("found", _tiers("found")),
    "similarity_summary": _with("found", """WITH by_row AS (SELECT row_no, orderkey % 16 AS batch_id,
            avg(cos) AS m, max(cos) AS x FROM found GROUP BY ALL)
        SELECT batch_id, round(avg(m), 6) AS mean_cos, round(max(m), 6) AS max_mean_cos,
            round(max(x), 6) AS max_cos FROM by_row GROUP BY batch_id"""),
    "mean_pool": _with("found", _pool("found", weight="0.1::DOUBLE")),
    "attention_pool": _with("found", _pool("found", _ATTENTION)),
    "attention_pool_plain": _with("found", _pool(_RECENT, "d")),
    "feature_table": _with("found customers items", _features()),
    "feature_table_ablated": _with("found customers items", _features(True)),
    "feature_table_soft": _with("cosines customers items", _features(source="soft_picks", views=_SOFT_PICKS)),
    "feature_table_hard": _with("cosines customers items", _features(source="hard_picks", views=_HARD_PICKS)),
    "auc": _with("scores", f"""WITH {_pair_counts()} SELECT round(sum(pos * neg_below) / (sum(pos) * sum(neg))::DOUBLE, 6)
            AS auc, sum(pos)::BIGINT AS p, sum(neg)::BIGINT AS n, sum(pos * neg_below)::BIGINT AS wins FROM below"""),
    "gauc": _with("scores", f"""WITH {_pair_counts("uid")}, {_USERS.format(by="")}
        SELECT round({_USER_SUMS} / sum(p + n), 6) AS gauc, round({_USER_SUMS}, 6) AS weighted_auc_sum,
            sum(p + n)::BIGINT AS impressions FROM users"""),
    "gauc_batch": _with("scores", f"""WITH {_pair_counts("batch_id, uid")}, {_USERS.format(by="batch_id, ")}
        SELECT batch_id, round({_USER_SUMS} / sum(p + n), 6) AS gauc, round({_USER_SUMS}, 6) AS weighted_auc_sum,
            sum(p + n)::BIGINT AS impressions FROM users GROUP BY batch_id"""),
    "confusion": _with("scores", _CONFUSION),
    "auroc": _with("scores", f"""WITH {_CURVE.format(by="")}
        SELECT round(auroc, 6) AS auroc FROM ({_area("counts")})"""),
    "logloss": _with("scores", f"""SELECT 'rows' AS kind, round(avg({_LOSS}), 6) AS logloss FROM scores
        UNION ALL SELECT 'batches', round(avg(l), 6) FROM (SELECT avg({_LOSS}) AS l FROM scores GROUP BY batch_id)"""),
    "running_metrics": _with("samples", _running("orderkey % 16") + " SELECT * FROM running"),
    "feed_plan": _with("samples", _SHARDS + """ SELECT shard_no, n_rows, position, used::BIGINT AS used, rank, worker,
        42 + 100 + rank * 10 + worker AS seed, turn FROM turns"""),
    "feed_losses": _with("samples", _SHARDS + """ SELECT count(*) FILTER (WHERE NOT used) AS shards_unread,
        coalesce(sum(n_rows) FILTER (WHERE NOT used), 0)::BIGINT AS rows_unread,
        sum(n_rows)::BIGINT AS rows_total FROM turns"""),
    "batches": _with("samples", _SHARDS + f""", offsets AS (SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY rank, worker
            ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before,
            sum(n_rows) OVER (PARTITION BY rank, worker) AS reader_rows FROM turns WHERE used)
        SELECT {_KEY}, shard_no, rank, worker, ((rows_before + row_in_shard) // 64)::BIGINT AS batch_id,
            (rows_before + row_in_shard)::BIGINT AS place
        FROM sharded JOIN offsets USING (shard_no) WHERE (rows_before + row_in_shard) // 64 < reader_rows // 64"""),
    "epoch_shuffle": _with("samples", _SHARDS + f""", mixed AS (
            SELECT *, 42 + 300 + rank * 10 + worker AS seed FROM sharded JOIN turns USING (shard_no) WHERE used),
        dealt AS (SELECT *, count(*) OVER (PARTITION BY rank, worker) AS reader_rows, row_number() OVER (
            PARTITION BY rank, worker ORDER BY md5(concat_ws('|', seed, {_FULL})), {_FULL}) - 1 AS place FROM mixed)
        SELECT {_KEY}, shard_no, rank, worker, (place // 64)::BIGINT AS batch_id, place
        FROM dealt WHERE place // 64 < reader_rows // 64"""),
    "buffer_shuffle": _with("samples", _SHARDS + f""", seeded AS (SELECT shard_no, n_rows, rank, worker, 342 + rank * 10 + worker AS seed
            FROM plan WHERE used),
        offsets AS (SELECT *, sum(n_rows) OVER (PARTITION BY rank, worker) AS reader_rows,
            coalesce(sum(n_rows) OVER (PARTITION BY rank, worker ORDER BY md5(concat_ws('|', seed, shard_no)), shard_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before FROM seeded),
        read AS (SELECT *, (rows_before + row_in_shard)::BIGINT AS t FROM sharded JOIN offsets USING (shard_no)),
        slots AS (SELECT *, CASE WHEN t < 50 THEN t
            ELSE ('0x' || substr(md5(concat_ws('|', seed, t)), 1, 8))::BIGINT % 50 END AS slot FROM read),
        held AS (SELECT *, lead(t) OVER (PARTITION BY rank, worker, slot ORDER BY t) AS next FROM slots),
        dealt AS (SELECT *, CASE WHEN next IS NOT NULL THEN next - 50 ELSE greatest(reader_rows - 50, 0) - 1 + row_number() OVER (
            PARTITION BY rank, worker, next IS NULL ORDER BY md5(concat_ws('|', seed, slot)), slot) END AS place FROM held)
        SELECT {_KEY}, shard_no, rank, worker, (place // 64)::BIGINT AS batch_id, place::BIGINT AS place
        FROM dealt WHERE place // 64 < reader_rows // 64"""),
    "rebalance": _with("samples", f"""SELECT {_KEY}, row_no,
            24 + least(row_no // (SELECT count(*) // 8 FROM samples), 8) AS shard_no FROM samples"""),
    "ingest_text": _with("customers lists", """SELECT uid, u1, u2, u3, u4, u5, coalesce(hist_items, '0') AS hist_items,
            coalesce(hist_cates, '0') AS hist_cates FROM customers LEFT JOIN lists USING (uid)"""),
    "ingest_faulty": _LINES + """ SELECT iid, CASE WHEN s % 3 = 0 THEN 0 ELSE s END::BIGINT AS cate,
            CASE WHEN short THEN 0 ELSE brand END AS i1, CASE WHEN short THEN 0 ELSE s END::BIGINT AS i2
        FROM flags WHERE NOT blank AND NOT bad""",
    "ingest_rejected": """SELECT concat_ws(chr(9), CAST(p_partkey + 1 AS VARCHAR),
            CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, p_brand, CAST(p_size AS VARCHAR)) AS value,
            'bad field i1' AS reason
        FROM part WHERE p_size % 2 <> 0 AND p_size % 5 <> 0 AND p_size <> 7""",
    "ingest_counts": _LINES + """ SELECT count(*) AS lines_read, count(*) FILTER (WHERE blank) AS lines_blank,
            count(*) FILTER (WHERE NOT blank) AS lines_not_blank,
            count(*) FILTER (WHERE NOT blank AND short) AS lines_short,
            count(*) FILTER (WHERE NOT blank AND NOT short AND bad) AS rows_rejected,
            count(*) FILTER (WHERE NOT blank AND NOT short AND NOT bad) AS rows_written,
            count(*) FILTER (WHERE NOT blank AND NOT short) AS rows_full_length FROM flags""",
    "ingest_stored": _LINES + """, texts AS (SELECT concat_ws(chr(9), CAST(p_partkey + 1 AS VARCHAR),
            CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, p_brand, CAST(p_size AS VARCHAR)) AS value
            FROM part WHERE p_size % 2 <> 0 AND p_size % 5 <> 0 AND p_size <> 7),
        numbers AS (SELECT count(*) AS lines_read, count(*) FILTER (WHERE blank) AS lines_blank,
            count(*) FILTER (WHERE NOT blank) AS lines_not_blank, count(*) FILTER (WHERE NOT blank AND short) AS lines_short,
            count(*) FILTER (WHERE NOT blank AND bad) AS rows_rejected,
            count(*) FILTER (WHERE NOT blank AND NOT bad) AS rows_written,
            count(*) FILTER (WHERE NOT blank AND NOT short) AS rows_full_length FROM flags)
        SELECT 'good' AS kind, iid, CASE WHEN s % 3 = 0 THEN 0 ELSE s END::BIGINT AS cate, CASE WHEN short THEN 0 ELSE brand END AS i1,
            CASE WHEN short THEN 0 ELSE s END::BIGINT AS i2, NULL::VARCHAR AS value, NULL::VARCHAR AS reason
        FROM flags WHERE NOT blank AND NOT bad
        UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, value, 'bad field i1' FROM texts
        UNION ALL SELECT kind, n, NULL, NULL, NULL, NULL, NULL FROM (UNPIVOT numbers ON COLUMNS(*) INTO NAME kind VALUE n)""",
    "sharded_sink": _with("samples", """SELECT printf('train-shard-%06d.parquet', row_no // 500) AS shard_file,
            count(*) AS n_rows, min(orderkey) AS first_order, max(orderkey) AS last_order, count(*) AS positions
        FROM samples GROUP BY ALL"""),
    "split_shards": _with("samples customers items lists", _split("SELECT *, row_no // 500 AS shard, row_no % 500 AS place FROM samples")),
    "split_tail": _with("samples customers items lists", _split("""
        SELECT *, 8 + least(n // each, 8) AS shard, n - least(n // each, 8) * each AS place
        FROM (SELECT *, row_no - 4000 AS n, (count(*) OVER ()) // 8 AS each FROM samples WHERE row_no >= 4000)""")),
    "shard_metadata": _with("samples", """SELECT 'train' AS mode, count(*) AS total_rows,
            count(DISTINCT row_no // 500) AS num_shards, count(*) // (64 * 8) AS steps FROM samples"""),
    "ingest_labels": _with("samples", "SELECT uid, iid, 1 - label AS negative, label AS positive FROM samples"),
    "ingest_vectors": """SELECT vec_id + 1 AS iid, j - 1 AS dim, round(CAST(embedding[j] AS DOUBLE), 6) AS x
        FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS j FROM embeddings)""",
    "stored_columns": _with("items", """SELECT *, iid AS iid_c, 'parts' AS read FROM items
        UNION ALL SELECT *, iid, 'typed' FROM items WHERE iid % 2 = 0"""),
    "freq_roundtrip": _with("freq_list", "SELECT * FROM freq_list"),
    "vocab_roundtrip": _with("p90 merged", """SELECT * FROM p90
        UNION ALL SELECT * FROM merged WHERE vocab = 'hist_cates'"""),
    "embedding_roundtrip": _with("vec", """SELECT iid, j - 1 AS dim, v[j]::BIGINT AS q
        FROM (SELECT iid, v, unnest(range(1, 65)) AS j FROM vec)"""),
    "compact_parts": _with("samples", "SELECT count(*) AS total_rows FROM samples"),
    "compact_sized": _with("samples", f"SELECT {_KEY}, row_no AS place FROM samples"),
    "stream_confusion": _with("scores", _CONFUSION),
    "stream_steps": _with("samples", _running("orderkey % 6") + f""",
        upto AS (SELECT r.step AS seen, s.uid, s.score, sum(s.label) AS pos, sum(1 - s.label) AS neg
            FROM scores s JOIN running r ON s.step <= r.step GROUP BY ALL),
        upto_below AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY seen, uid ORDER BY score
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM upto),
        upto_users AS (SELECT seen, uid, sum(pos) AS p, sum(neg) AS n, sum(pos * neg_below) AS wins
            FROM upto_below GROUP BY seen, uid HAVING sum(pos) > 0 AND sum(neg) > 0),
        exact AS (SELECT seen AS step, round({_USER_SUMS} / sum(p + n), 6) AS user_auc_so_far FROM upto_users GROUP BY seen)
        SELECT running.*, user_auc_so_far FROM running JOIN exact USING (step)"""),
}
