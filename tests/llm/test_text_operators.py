"""Byte BPE, language identification, licence scan and page text on small inputs."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recollect.llm import byte_bpe, language_id, license_scan, page_text

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "  a", "a b", "word word word", "l'été, 12345!", "漢字 🙂🙂 \n\n\t x ", "a" * 3000, "ab " * 900,
    "\x1c\x1d x", "Don't  stop\u00a0now", "éa" * 700, " " * 2000, "the the.The",
]


@pytest.fixture(scope="module")
def library():
    merges = byte_bpe.Merges(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    return merges, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges.ranks, special_tokens={}
    )


def test_bpe_equals_the_library_and_decodes(library):
    merges, encoding = library
    rng = np.random.default_rng(3)
    letters = list("aäbcdefgé 漢\n.1'🙂 ")
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(400)]
    for text, packed in zip(texts, merges.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text or "")
        assert merges.decode(packed) == (text or "").encode()


def test_bpe_follows_ranks_below_the_merged_token():
    """A pair may rank before a token it contains; the smallest rank still goes first."""
    import base64

    tokens = [bytes([k]) for k in range(256)] + [b"abc", b"ab", b"bc", b"cab", b"aa", b"aaa", b"caba"]
    file = b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens))
    merges = byte_bpe.Merges(file, r"\w+|\W+")
    encoding = tiktoken.Encoding("t", pat_str=r"\w+|\W+", mergeable_ranks=merges.ranks, special_tokens={})
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc"), rng.integers(1, 14))) for _ in range(500)]
    for text, packed in zip(texts, merges.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text), text


def test_bpe_merges_all_words_of_a_batch_in_one_replay(library, monkeypatch):
    merges, encoding = library
    merges.forget()
    calls, replay = [], merges.replay
    monkeypatch.setattr(merges, "replay", lambda words: calls.append(len(words)) or replay(words))
    texts = ["zqxfirst zqxsecond, zqxthird!", "zqxother zqxsecond"]
    packed = merges.encode(texts)
    assert len(calls) == 1 and [np.frombuffer(x, "<u4").tolist() for x in packed] == [encoding.encode_ordinary(t) for t in texts]


def test_bpe_query_keeps_rows_and_ignores_other_columns(spark, library):
    rows = [(k, text, "x") for k, text in enumerate(TEXTS)] + [(3, "  a", "y"), (None, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for k, text, _ in rows:
        raw = np.array(library[1].encode_ordinary(text or ""), "<u4").tobytes()
        assert by_id[k]["n_tokens"] == len(raw) // 4
        assert by_id[k]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert by_id[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    ids = byte_bpe.encode(docs, "text", RANKS, public_tokenizers.PATTERN, ["doc_id"], "packed")
    back = byte_bpe.decode(ids, "packed", RANKS, ["doc_id"]).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.encode_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language_id.ByteNetwork.fresh(["a", "b", "c"], 4, rng)
    for w in net.weights():
        w += rng.normal(0, 0.1, w.shape)
    net.inputs, net.states = [w.astype(float) for w in net.inputs], [w.astype(float) for w in net.states]
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    codes, lengths = language_id.pad([b"abcab", b"c", b"bca"])
    target = np.array([0, 1, 2])
    slopes, _ = net.gradients(codes, lengths, target)
    for w, g in zip(net.weights(), slopes):
        for _ in range(4):
            at = tuple(rng.integers(n) for n in w.shape) if w.shape[0] != 256 else (97 + rng.integers(3), rng.integers(w.shape[1]))
            before = w[at]
            w[at] = before + 1e-3
            up = net.gradients(codes, lengths, target)[1]
            w[at] = before - 1e-3
            down = net.gradients(codes, lengths, target)[1]
            w[at] = before
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3


def test_language_is_learned_from_rows_not_held_out(spark):
    rng = np.random.default_rng(5)
    words = {"aa": ["kola", "mila", "tora", "nela"], "bb": ["şuyt", "grüxt", "pwçt", "zzört"]}
    rows = []
    for k in range(120):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, " ".join(rng.choice(words[lang], 12)), lang, f"s{k % 3}", lang))
    rows += [(200, None, "aa", None, "x"), (201, "", None, "s", "x"), (202, "123 !?", "bb", "s", "x"), (None, "kola mila", "aa", "s", "x"),
             (203, "kola " * 30_000, None, "s", "x"), (5, "kola mila", "aa", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    found = language_id.identify(docs).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["held_out"] == (row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] != 5}
    assert [by_id[k]["lang_pred"] for k in (200, 201, 202)] == ["und"] * 3 and by_id[203]["lang_pred"] == "aa"
    assert all(by_id[k]["lang_pred"] == lang for k, _, lang, _, _ in rows[:120] if k != 5)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert language_id.identify(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(none).collect()} == {"und"}


def test_licences_come_from_headers_and_nearest_folders(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"),
        ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/d/z", "nothing"),
        ("a/c/y.py", "Licensed under CC BY-NC 4.0.\nmore words here"), ("q/r", None), ("top", ""), (None, "x"),
        ("a/b/x.py", "code"), ("long/t", "free words of the version " * 20_000 + "\nReleased under the MIT License.\n"),
        ("none/x", "the license of version two is not here, dear reader, whatever this says"),
    ]
    files = spark.createDataFrame([(p, t, 1.0) for p, t in rows], "path string, text string, score double")
    found = license_scan.scan_licences(files).collect()
    assert len(found) == len(rows)
    got = {r["path"]: (r["licence"], r["line"], r["declared_by"]) for r in found}
    assert got == {
        "a/LICENSE": ("MIT", 1, None), "a/b/x.py": ("Apache-2.0", None, "a/b/LICENSE"), "a/b/LICENSE": ("Apache-2.0", 1, None),
        "a/b/d/z": ("Apache-2.0", None, "a/b/LICENSE"), "a/c/y.py": ("CC-BY-NC-4.0", 1, None), "q/r": (None, None, None),
        "top": (None, None, None), None: (None, None, None), "long/t": ("MIT", 2, None), "none/x": (None, None, None),
    }
    assert license_scan.scan_licences(files.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "s", None)], "doc_id long, text string, source string, lang string")
    assert license_scan.document_licences(docs).first()["licence"] == "MIT"


ARTICLE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/x'>menu</a></li></ul></nav><!-- c --><div class='ad'>buy</div>"
    "<article><header><h1>T &amp; U</h1><p>by me</p></header><p><b>One&nbsp;\n two<br><p>three &lt;x&gt;"
    "<aside>side</aside><div class='post-comments'><p>first!</p></div></article><footer>f</footer>"
)


def test_blocks_of_an_article():
    assert [t for _, t in page_text.blocks(ARTICLE)] == ["T & U", "One two", "three <x>"]
    assert page_text.blocks("") == [] and page_text.blocks("<script>x") == []
    assert page_text.blocks("a < b <p class='lead'>c</p>d") == [(1, "a < b"), (1, "c"), (1, "d")]
    assert page_text.blocks("<div id=side-bar>x</div><div class=sidebar>y</div>") == [(1, "x")]


def test_marks_are_whole_attributes_and_spare_what_holds_the_article():
    texts = lambda page: [t for _, t in page_text.blocks(page)]
    assert texts("<p>a <a href='/trails/hidden-valley'>b</a> <a href=\"/story?id=related\">c</a> <a href=/x?class=ad>d</a></p>") == ["a b c d"]
    assert texts("<p title='role=main' data-hidden=1>x</p>") == ["x"] and page_text.blocks("<p title='role=main'>x") == [(1, "x")]
    assert texts("<p hidden>x</p><p HIDDEN=''>y</p><p style='display : none'>z</p><p id='a' class=\"ad\">w</p>") == []
    assert texts("<div class='content has-sidebar'><article>x</article></div>") == ["x"]
    assert texts("<div id='main-no-ads'><p>x</p></div><div class=withComments>y</div>") == ["x", "y"]
    assert texts("<div class='widget'><section><main>x</main></section><div class=ads>y</div></div>") == ["x"]
    # Teasers and comments beside the article stay out.
    assert page_text.blocks("<article>m<div class=comments><article>c</article></div></article><div class=related><article>t</article></div>") == [(2, "m")]


def test_marks_are_whole_names_and_articles_keep_text_and_title():
    texts = lambda page: [t for _, t in page_text.blocks(page) if _ == 2]
    kept = (
        "<p class='share-price'>a</p><p class='notice-period'>b</p><section id='notification-of-death'>c</section>"
        "<div class='recipe cookie'>d</div><div class='lead related-lead'>e</div>"
    )
    assert texts(f"<article>{kept}</article>") == list("abcde")
    gone = (
        "<div class='cookie-banner sticky'>x</div><div class='col-4 sidebar'>x</div><p class='notice'>x</p><div class='box notice'>x</div>"
        "<section class='responses'>x</section><div id='post-comments'>x</div><div class='ad-300x250'>x</div><div class=shareButtons>x</div>"
    )
    assert texts(f"<article><p>a</p>{gone}</article>") == ["a"]
    assert texts("<article><header class='masthead'><h1>T</h1><p>by</p></header><div class='banner'><h1>U</h1><h2>x</h2></div><p>a</p></article>") == ["T", "U", "a"]
    assert texts("<article><div class='comments'><h1>x</h1></div><header class='ads'><h1>x</h1></header><p>a</p></article>") == ["a"]
    # Teasers beside main go; what holds the whole article isn't marked.
    assert texts("<article>teaser</article><main><p>a</p><article>b</article></main><article>teaser</article>") == ["a", "b"]
    assert texts("<main></main><article>a</article>") == ["a"]
    assert texts("<article><h1>T</h1><div class='widget'><p>one two</p></div><div class='comments'>x</div></article>") == ["T", "one two"]


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    rng = np.random.default_rng(2)

    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    assert len(page_text.shared_lines([2] * 39 + [1, 2] * 20, [1, 2] * 40)) == 60
    for k in range(400):
        monkeypatch.setattr(page_text, "TABLE_BITS", (1 << 26, 6)[k % 2])
        a, b = (rng.integers(0, 6, rng.integers(0, 12)).tolist() for _ in range(2))
        found = sorted(page_text.shared_lines(a, b))
        picked, rest = [a[k] for k in found], iter(b)
        assert len(found) == length(a, b) and all(x in rest for x in picked)


def test_pages_lose_what_they_share_with_the_nearest_url(spark):
    def page(own):
        return f"<div>Site menu here</div><div>{own}</div><div>All rights kept</div>"

    rows = [
        (1, "http://h.org/a/1", page("first story")), (2, "http://h.org/a/2", page("second story")),
        (3, "http://h.org/b", page("third story")), (4, "http://other.org/a", page("alone")), (5, None, None),
        (None, "http://h.org/a/3", page("no id")),
        (6, "http://x.org/", ""), (7, "http://art.org/", ARTICLE), (8, "http://art.org/2", ARTICLE),
        (9, "http://copy.org/1", page("same")), (10, "http://copy.org/1", page("same")), (1, "http://h.org/a/1", page("first story")),
        (11, "http://long.org/", "<p>w</p>" * 20_000),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = page_text.extract(pages).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    got = {r["page_id"]: r["text"] for r in found}
    assert [got[k] for k in (1, 2, 3)] == ["first story", "second story", "third story"]
    assert got[None] == "no id"
    assert got[4] == "Site menu here\n\nalone\n\nAll rights kept" and got[5] == got[6] == ""
    assert got[7] == got[8] == "T & U\n\nOne two\n\nthree <x>"
    assert got[9] == got[10] == "Site menu here\n\nsame\n\nAll rights kept"
    assert got[11] == "\n\n".join(["w"] * 20_000)
    assert page_text.extract(pages.limit(0)).count() == 0


def test_templates_go_and_copied_articles_stay(spark):
    menu = [f"menu {k}" for k in range(20)]

    def page(own):
        return "".join(f"<p>{line}</p>" for line in menu[:10] + own + menu[10:])

    story = lambda name, n=4: [f"{name} {k}" for k in range(n)]
    rows = [(k, f"http://short.org/{k}", page(story(f"s{k}"))) for k in range(6)]  # a template of 83 %
    # A run of equal copies, and articles that share most of their lines, among other pages.
    rows += [(10 + k, f"http://run.org/b{k}", page(story("same"))) for k in range(4)]
    rows += [(20 + k, f"http://run.org/{k}", page(story(f"r{k}", 9))) for k in range(3)]
    rows += [(30 + k, f"http://near.org/a{k}", page(story("near", 30) + [f"of day {k}"] + story(f"n{k}", 18))) for k in range(2)]
    rows += [(32 + k, f"http://near.org/b{k}", page(story(f"f{k}", 30))) for k in range(3)]
    rows += [(40 + k, f"http://two.org/{k}", page(story(f"t{k}"))) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n\n") for r in page_text.extract(pages).collect()}
    assert all(got[k] == story(f"s{k}") for k in range(6)) and all(got[10 + k] == story("same") for k in range(4))
    assert all(got[20 + k] == story(f"r{k}", 9) for k in range(3)) and all(got[32 + k] == story(f"f{k}", 30) for k in range(3))
    assert all(got[30 + k] == story("near", 30) + [f"of day {k}"] + story(f"n{k}", 18) for k in range(2))
    assert all(got[40 + k] == story(f"t{k}") for k in range(2))


def test_differencing_takes_part_where_pages_mark_their_article(spark):
    def page(own, notice="Read our letter"):
        return f"<p>open menu</p><article><h1>{own[0]}</h1>{''.join(f'<p>{x}</p>' for x in [*own[1:], notice])}</article>"

    story = lambda name, n=3: [f"{name} {k}" for k in range(n)]
    rows = [(k, f"http://site.org/{k}", page(story(f"s{k}"))) for k in range(6)]  # a notice without a mark, on every page
    # Copies with a line changed, among enough other articles, stay; so does what two pages share.
    rows += [(10 + k, f"http://copy.org/a{k}", page(story("same", 9) + [f"c{k}"], f"n{k}")) for k in range(4)]
    rows += [(20 + k, f"http://copy.org/b{k}", page(story(f"b{k}"), f"m{k}")) for k in range(6)]
    rows += [(30 + k, f"http://two.org/{k}", page(story(f"t{k}"))) for k in range(2)]
    rows += [(40, "http://site.org/9", "<p>open menu</p><p>plain page</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n\n") for r in page_text.extract(pages).collect()}
    assert all(got[k] == story(f"s{k}") for k in range(6))
    assert all(got[10 + k] == [*story("same", 9), f"c{k}", f"n{k}"] for k in range(4))
    assert all(got[20 + k] == [*story(f"b{k}"), f"m{k}"] for k in range(6))
    assert all(got[30 + k] == [*story(f"t{k}"), "Read our letter"] for k in range(2))
    assert got[40] == ["plain page"]


def test_notices_are_found_within_lines_and_named_by_their_version(spark):
    mit = [text for name, text in license_scan.TEMPLATES if name == "MIT"][-1]
    bsd = {name: text for name, text in license_scan.TEMPLATES if name.startswith("BSD")}
    prose = "many words about a walk to the old mill by the river " * 40
    rows = [
        ("a/x", "Copyright 2020 Jane Doe. Released under the MIT License. All rights reserved by the author."),
        ("b/x", prose + "Licensed under the Apache License, Version 2.0. " + prose), ("c/x", "Licensed under the Apache License, Version 1.1."),
        ("d/x", "Licensed under the Apache License, Version 7.5, or 4.0."), ("e/x", "a\n\nLicensed under\nCC BY-ND 4.0."),
        ("f/LICENSE", mit.replace("(c)", "(c) 2021 Jane Doe")), ("f/y", "code"), ("g/LICENSE", bsd["BSD-2-Clause"]), ("g/y", "code"),
        ("h/LICENSE", bsd["BSD-3-Clause"]), ("h/y", "code"), ("i/x", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ] + [(f"z/{k}", prose) for k in range(40)]
    found = license_scan.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()
    got = {r["path"]: (r["licence"], r["line"]) for r in found if r["path"][0] != "z"}
    assert got == {
        "a/x": ("MIT", 1), "b/x": ("Apache-2.0", 1), "c/x": ("Apache-1.1", 1), "d/x": (None, None), "e/x": ("CC-BY-ND-4.0", 3),
        "f/LICENSE": ("MIT", 1), "f/y": ("MIT", None), "g/LICENSE": ("BSD-2-Clause", 1), "g/y": ("BSD-2-Clause", None),
        "h/LICENSE": ("BSD-3-Clause", 1), "h/y": ("BSD-3-Clause", None), "i/x": ("LGPL-2.1", 1),
    }
    assert all(r["licence"] is None for r in found if r["path"][0] == "z")


def test_documents_with_letters_stay_where_no_language_is_labelled(spark):
    docs = spark.createDataFrame([(1, "kola", None), (2, "12 !", None), (3, None, None), (4, "漢字", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language_id.keep_identified(docs).collect()) == [1, 4]
