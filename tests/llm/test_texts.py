"""HTML extraction and byte-level BPE."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from helixframe.llm import byte_bpe, html_text


@pytest.fixture(scope="module")
def ranks(spark):
    return byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_library(spark, documents, ranks, reference):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab 1\n\t'’sé漢 \x1c!-_xyz") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "x" * 5000, "the" * 2000, "<|endoftext|> I'll", "ab" * 400 + " " * 300 + "é" * 999]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = byte_bpe.digests(documents(rows, "ids", "decoded"), ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.digests(documents([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_unknown_ids_are_an_error(ranks):
    with pytest.raises(ValueError):
        byte_bpe.Decoder(ranks).bytes_of(np.array([0, 50_300]))


def test_folded_merges_give_the_same_ids(spark, reference):
    ranks = {bytes([i]): i for i in range(256)} | {b"th": 256, b"he": 257, b"the": 258, b"in": 259, "é".encode(): 260, b"aa": 261}
    words = ["the", "thin", "hehe", "é", "aaaaa", "x", "", "other", "日"]
    enc = tiktoken.Encoding("small", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["ids"] for r in byte_bpe.encode_words(df, ranks, buckets=64).collect()}
    assert got == {w: enc.encode_ordinary(w) for w in words if w}


ARTICLE = "word " * 30
PAGES = [
    (f"<html><head><title>x</title></head><body><header><h1>Site</h1></header><div><h2>Head</h2><p>Short.</p><p>{ARTICLE}</p>"
     f"<p>End &lt;b&gt; &amp; ok</p></div><div id='sidebar'><p>{ARTICLE}</p></div><section class=\"comments\"><p>{ARTICLE}</p></section>"
     "<footer>f</footer></body></html>", f"Head\nShort.\n{ARTICLE.strip()}\nEnd <b> & ok"),
    ("<div><p>tiny</p></div>", "tiny"),
    ("", ""),
    (None, ""),
    ("<p></p><br>", ""),
    ("plain &eacute;  text\n only", "plain é text only"),
    ('<script>var t="</p><article>x</article>";</script><main><p>one<br>two</p><form>f<p>zz</p></form><pre>a\n b</pre></main>', "one\ntwo\na b"),
    ('<nav><li><a href="/a">menu</a></li></nav><article><h1>T</h1><p><b>open <p>Be.</p><p>a <i>b</i>c</p><!-- x --><div class="ad">Buy</div><p>Tail', "T\nopen\nBe.\na bc\nTail"),
    ("<" * 3000 + "a" + '<p x="' * 500, None),
]


def test_main_text(spark):
    rows = [(i, f"u{i}", page, "e") for i, (page, _) in enumerate(PAGES)]
    df = spark.createDataFrame([*rows, rows[1]], "page_id bigint, url string, html string, text string")
    got = html_text.main_texts(df).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        want = PAGES[r["page_id"]][1]
        assert want is None or r["text"] == want
        assert r["n_chars"] == len(r["text"])
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_menus_named_main_are_not_the_main_element():
    post = f'<div class="post"><p>{ARTICLE}</p></div>'
    for menu in ('<nav class="main-nav">', '<nav aria-label="Main">', '<header class="main-header">', '<div class="main-menu">', '<nav id="main">'):
        page = f"<body>{menu}<ul><li>Home</li><li>About</li></ul></{menu[1:].split()[0]}>{post}</body>"
        assert html_text.main_text(page) == ARTICLE.strip(), menu
    for main in ('<div id="main">', '<div role="main">', '<div class="articleBody">'):
        assert html_text.main_text(f"<body>{main}<p>short</p></div>{post}</body>") == "short", main


def test_sections_of_a_marked_article_stay():
    links = "".join(f'<li><a href="/{i}">Reference number {i}</a></li>' for i in range(3))
    page = (
        '<article><h2 id="search-and-rescue">Search</h2><section id="legal-status"><p>Law</p></section><p title="a hidden gem">Gem</p>'
        f'<p data-x=\'is hidden\'>Single</p><div id="related-work"><ul>{links}</ul></div><div class="box related">Ad</div>'
        '<p hidden>No</p><p HIDDEN="">No</p><div role="search">Find</div><p title="un hidden>Open</p></article>'
    )
    want = ["Search", "Law", "Gem", "Single", *(f"Reference number {i}" for i in range(3)), "Open"]
    assert html_text.main_text(page) == "\n".join(want)
    assert "Search" in html_text.main_text(f'<div><h2 id="search-and-rescue">Search</h2><p>{ARTICLE}</p></div>')


def test_wrapper_tags_do_not_cut_the_text():
    short = ["Short one.", "Head", "Short two.", "Short end."]
    texts = [ARTICLE.strip(), *short[:3], ARTICLE.strip(), short[3]]
    menu = "<div><ul><li>Home</li><li>About</li></ul></div>"
    for before, after in (("<p>", "</p>"), ("<div><p>", "</p></div>"), ("<div><div><p>", "</p></div></div>"), ("<div></div><div><p>", "</p></div>")):
        page = f"<body>{menu}<div class='post'>{''.join(before + x + after for x in texts)}</div></body>"
        assert html_text.main_text(page) == "\n".join(texts), before
    cells = [(f"Row {i}", f"value {i}", "x" * 20) for i in range(9)]
    rows = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in cells)
    want = "\n".join(x for row in cells for x in row)
    assert html_text.main_text(f"<body>{menu}<div><table>{rows}</table></div></body>") == want
    sections = "".join(f"<div><h2>Head</h2><p>{x}</p></div>" for x in (ARTICLE.strip(), "Short.", ARTICLE.strip()))
    assert html_text.main_text(f"<body>{menu}{sections}</body>").count("Short.") == 1


def test_pages_of_the_tables_give_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_text.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect()
    for r in got:
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        for part in r["text"].split("\n"):
            assert part.split(" ")[0] in html_text.html.unescape(inside)
    assert html_text.extract(pages).where(F.col("text").contains("<p>")).count() == 0


BODY = f"<h1>T</h1><p>{ARTICLE}</p><p>End.</p>"
WHOLE = f"T\n{ARTICLE.strip()}\nEnd."


@pytest.mark.parametrize(
    "page",
    [
        f'<div id="page" class="site has-sidebar">{BODY}</div>',
        f'<div class="social-layout">{BODY}</div><p class="share-bar">Share</p>',
        f"<form action='x'>{BODY}</form>",
        f'<div class="sidebar-page"><main>{BODY}</main><div class="sidebar"><p>{ARTICLE}{ARTICLE}</p></div></div>',
        f'<div class="sidebar"><article>{BODY}</article></div>',
        f'<main>{BODY}<div class="ad-slot"><p>no {ARTICLE}</p></div><div class="share-buttons">no</div><div class="cookie-banner">no</div>'
        '<div class="newsletter-signup"><p>no</p></div><div class="related-posts">no</div></main>',
        f'<main>{BODY}<div class="comments-area"><h2 class="comments-title">3 thoughts</h2><article class="comment"><p>no {ARTICLE}</p></article>'
        "<h3>Leave a Reply</h3></div></main>",
        f'<div>{BODY}</div><article class="comment"><p>no {ARTICLE}</p></article>',
        f'<div>{BODY}</div><div class="comments"><p>no {ARTICLE}</p><article><p>{ARTICLE * 20}</p></article></div>',
        f'<div>{BODY}</div><form class="search-form"><p>no {ARTICLE}</p></form>',
    ],
)
def test_names_lean_and_text_decides(page):
    assert html_text.main_text(page) == WHOLE


def test_parts_of_an_article_stay_whatever_their_ids():
    page = f'<main>{BODY}<section id="legal-status"><h2 id="search-and-rescue">Search</h2><p title="a hidden gem">kept</p></section></main>'
    assert html_text.main_text(page) == f"{WHOLE}\nSearch\nkept"


def test_deep_and_unclosed_pages_take_linear_time():
    start = time.perf_counter()
    html_text.main_text("<ul>" * 20_000 + "x" + "</li>" * 20_000 + "</ul>" * 20_000)
    assert time.perf_counter() - start < 10


def test_lines_between_surge_and_dive():
    """Against a plain restatement of the curve on pages without names."""
    rnd = random.Random(6)
    s = html_text.Settings()
    for _ in range(300):
        size = [rnd.choice([0, 0, 0, 5, 30, 90, 200]) for _ in range(rnd.randint(1, 25))]
        lines = [html_text.Line("x" * n, n if rnd.random() < 0.2 else 0) for n in size]
        blocks = [sum(size[i : i + s.window]) for i in range(len(size))]
        runs = []
        for i, b in enumerate(blocks):
            if b and (i == 0 or not blocks[i - 1]):
                runs.append([])
            if b:
                runs[-1].append(i)
        covered = [sorted({j for i in r for j in range(i, min(i + s.window, len(size))) if size[j]}) for r in runs]
        prose = [k for k, c in enumerate(covered) if sum(lines[j].linked for j in c) <= s.links * sum(size[j] for j in c)]
        high = [k for k in prose if max(blocks[i] for i in runs[k]) >= s.surge]
        if high:
            kept = [k for k in prose if high[0] <= k <= high[-1]]
        else:
            kept = sorted(prose, key=lambda k: -sum(size[i] for i in runs[k]))[:1]
        want = [lines[j].text for j in sorted({j for k in kept for j in covered[k]})]
        assert html_text.main_lines(lines, False, s) == want
