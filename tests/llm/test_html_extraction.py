import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy &gt; now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; <i>tail</i></h1><p>One&nbsp;two<br>three  four<p>Five <b>six<p>Seven</p><form><label>Mail</label><input></form><ul><li>x<li>y</ul><aside>Also</aside>
<!-- gone <p>no</p> --><table><tr><td>a</td><td>b</td></tr></table><div class="social-share">Share</div><section class="comments"><p>Nice!</p></section><p>&lt;End&gt; &amp</p></article>
<footer>&copy; me</footer></body></html>"""


def test_article_blocks():
    page = H.read_page(PAGE)
    assert page.firm
    assert page.blocks == ["Head & tail", "One two three four", "Five six", "Seven", "x", "y", "a b", "<End> &"]


def test_containers_and_none():
    assert H.read_page("<body><div class='sidebar'>s</div><main><p>m</p></main></body>").blocks == ["m"]
    assert H.read_page("<div id='content'><p>c</p></div><div>o</div>").blocks == ["c"]
    plain = H.read_page("<p>a</p><div>b</div>")
    assert plain.blocks == ["a", "b"] and not plain.firm
    assert H.read_page("").blocks == [] and H.read_page("<<>< &").blocks == ["<<>< &"]
    assert H.read_page("<article>open <b>never closed").blocks == ["open never closed"]
    assert H.read_page("<script>x").blocks == []


STORY = "<p>The story itself</p>"
#: Forms of pages, and the blocks that are their text.
FORMS = [
    (f'<main class="site-main has-sidebar">{STORY}</main>', ["The story itself"]),
    (f'<main class="sidebar-layout">{STORY}</main>', ["The story itself"]),
    (f'<main id="main" class="page-with-banner">{STORY}<div class="banner">b</div></main>', ["The story itself"]),
    (f'<div class="content no-menu">{STORY}</div><div class="menu">m</div>', ["The story itself"]),
    (f'<div class="content with-sidebar">{STORY}</div>', ["The story itself"]),
    (f'<article class="post type-post category-advertising tag-cookies">{STORY}</article><p>stray</p>', ["The story itself"]),
    (f'<article class="post is-sponsored-free has-comments">{STORY}</article>', ["The story itself"]),
    (f'<article class="widget-page">{STORY}</article>', ["The story itself"]),
    (f'<article id="post-7" class="hentry">{STORY}<footer>by me</footer></article>', ["The story itself"]),
    ('<main><p>A story of some length</p><article class="teaser">Next</article></main>', ["A story of some length", "Next"]),
    (f'<main><h2>News</h2><article>{STORY}</article></main>', ["The story itself"]),
    (f'<main><article>{STORY}</article><div class="related">r</div><aside>a</aside></main>', ["The story itself"]),
    (f'<article>{STORY}<article class="comment">Nice</article></article>', ["The story itself"]),
    (f'<article class="comment">First!</article><div class="content">{STORY}</div>', ["The story itself"]),
    (f'<article class="ad">Buy</article><main>{STORY}</main>', ["The story itself"]),
    ("<article><p>let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be</p></article>", ["let x+1 be"]),
    ('<article><p>see <object data="x">the chart</object></p><canvas>no canvas</canvas></article>', ["see the chart", "no canvas"]),
    ('<article><p class="market-share">Ten percent</p><p class="share-buttons">tweet</p></article>', ["Ten percent"]),
    ('<article><p class="job-search">Found</p><div class="search-form">s</div></article>', ["Found"]),
    (f'<article>{STORY}<div class="social-share">s</div><div class="cookie-notice">c</div><div id="disqus_thread">d</div></article>', ["The story itself"]),
    (f'<article>{STORY}<div class="newsletterSignup">n</div><div role="navigation">v</div></article>', ["The story itself"]),
    (f'<header class="masthead"><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header>{STORY}</article>', ["Title", "The story itself"]),
    (f'<div id="content"><div class="entry-content">{STORY}</div></div><div class="site-footer">f</div>', ["The story itself"]),
    (f'<body class="has-ads sidebar">{STORY}</body>', ["The story itself"]),
]


@pytest.mark.parametrize("form", range(len(FORMS)))
def test_forms_of_pages(form):
    source, blocks = FORMS[form]
    assert H.read_page(f"<html><body><nav>menu</nav>{source}<footer>foot</footer></body></html>").blocks == blocks


def notice(k):
    return f"<article><p>Story {k} has words of its own number {k} and more of them</p><p>Please support our work by becoming a member of this site today</p></article>"


def test_notice_on_every_page_goes_and_quotes_stay():
    quote = "<p>A passage that some of the pages of this host do quote at length</p>"
    pages = [H.read_page(notice(k) + "") for k in range(20)]
    texts = H.clean(pages)
    assert all("member of this site" not in t and "Story" in t for t in texts)
    some = [H.read_page(f"<article><p>Story {k} alone has its words number {k}</p>{quote if k < 8 else ''}</article>") for k in range(20)]
    assert sum("do quote at length" in t for t in H.clean(some)) == 8
    copies = [H.read_page("<article><p>The same article on all of these pages of one host</p></article>") for _ in range(20)]
    assert all(H.clean(copies))


def test_soft_blocks():
    pages = [H.read_page(f"<p>Own text number {k} of this page with many other words {k * 7}</p><div>All rights reserved by the owners of this great site forever</div>") for k in range(5)]
    assert all("reserved" not in t and "Own text" in t for t in H.clean(pages))


def longest_repeats(streams, run, pages):
    """For each token the most distinct streams that share a substring of ``run`` tokens or more over it: by a suffix
    array of all streams, compared token by token, and the intervals of its common-prefix lengths."""
    distinct = sorted({tuple(s) for s in streams})
    suffixes = sorted((s[i:], k, i) for k, s in enumerate(distinct) for i in range(len(s)))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    over = [[1] * len(s) for s in distinct]
    for low in range(len(suffixes)):  # every interval of neighbours, with the length that all of it shares
        shared, owners = len(suffixes[low][0]), {suffixes[low][1]}
        members = [low]
        for high in range(low + 1, len(suffixes)):
            shared = min(shared, common(suffixes[high - 1][0], suffixes[high][0]))
            if shared < run:
                break
            owners.add(suffixes[high][1])
            members.append(high)
            for m in members:
                _, k, i = suffixes[m]
                for t in range(i, i + shared):
                    over[k][t] = max(over[k][t], len(owners))
    return [over[distinct.index(tuple(s))] for s in streams]


def supports(streams):
    blocks = pa.array([[" ".join(s)] if s else [] for s in streams], pa.list_(pa.string()))
    own, content = H.Streams(["h"] * len(streams), blocks), H.contents(blocks)
    counts = np.zeros(len(streams), bool)
    counts[np.unique(content, return_index=True)[1]] = True
    gram, several = own.grams(content)
    return own.support(*own.held(gram[several], counts))


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_support_against_a_true_suffix_array(monkeypatch, letters):
    rng = random.Random(1)
    streams = [[rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(25)]
    for k in range(5, 12):
        at = rng.randint(0, len(streams[k]))
        streams[k][at:at] = streams[4][3:30]
    streams[7] = streams[3]
    for got, want in zip(supports(streams), longest_repeats(streams, H.RUN, 2), strict=True):
        assert got.tolist() == want


def story(k, n=40):
    rng = random.Random(k)
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


NOTICE = "All rights reserved by the owners of this great site forever and for all time"


def test_versions_of_an_article_stay_whole():
    versions = [f"{story(1)} on day {k} {story(2)}" for k in range(5)]
    soft = H.clean([H.read_page(f"<p>{v}</p><div>{NOTICE}</div>") for v in versions] + [H.read_page(f"<p>{story(k)}</p><div>{NOTICE}</div>") for k in range(10, 30)])
    assert soft[:5] == versions and soft[5:] == [story(k) for k in range(10, 30)]
    firm = H.clean([H.read_page(f"<article><p>{v}</p></article>") for v in versions + [story(8), story(9), story(10)]])
    assert firm[:5] == versions


def test_covered_runs_are_cut_and_unique_ones_stay():
    pages = [H.read_page(f"<div>{story(k, 20)} {NOTICE} {story(k + 100, 20)}</div>") for k in range(4)]
    assert H.clean(pages) == [f"{story(k, 20)} {story(k + 100, 20)}" for k in range(4)]


def test_without_marks_repeats_still_go(monkeypatch):
    monkeypatch.setattr(H, "MARKS", set())
    monkeypatch.setattr(H, "DROPPED", {"script", "style"})
    page = lambda k: f"<nav>Home News Sport Weather Culture Travel Shop Contact Help</nav><p>{story(k)}</p><footer>{NOTICE}</footer>"
    assert H.clean([H.read_page(page(k)) for k in range(6)]) == [story(k) for k in range(6)]


def test_title_in_the_header_of_an_article():
    page = H.read_page("<header><h1>Site</h1></header><article><header class='entry-header'><h1>Own <b>title</b></h1><div>By me</div></header><p>Text</p></article>")
    assert page.blocks == ["Own title", "Text"]


def test_one_huge_page_ties_and_any_order(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 3000)
    text = lambda k: story(k, 30_000 if k == 3 else 30)
    rows = [(k, "http://a.example.com/x", f"<p>{text(k % 17)}</p>" + (f"<div>{NOTICE}</div>" if k % 17 < 3 else "<div>A line that just two distinct pages of the host have got</div>" if k % 17 < 5 else "")) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: text(k % 17) + ("\n\nA line that just two distinct pages of the host have got" if 3 <= k % 17 < 5 else "") for k in range(40)}
    for frame in (pages.repartition(7), pages.orderBy(F.desc("page_id")).coalesce(1)):
        assert {r["page_id"]: r["text"] for r in H.extract_main_text(frame).collect()} == want


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 800)
    rows = [(k, f"https://h{k % 3}.example.com/p/{k}" if k % 10 else None, PAGE if k == 5 else None if k == 6 else notice(k)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = {r["page_id"]: r for r in H.extract_main_text(pages.withColumn("host", F.lit("x")).withColumn("salt", F.lit(9))).collect()}
    assert len(out) == 60 and out[6]["text"] == "" and out[6]["n_chars"] == 0
    assert out[5]["text"].startswith("Head & tail\n\nOne two") and out[5]["n_chars"] == len(out[5]["text"])
    assert "member of this site" not in out[7]["text"] and "member of this site" in out[10]["text"]
    assert H.extract_main_text(pages.limit(0)).count() == 0
    assert H.extract_main_text(pages.union(pages)).count() == 120


def test_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 1200)
    notice = "<div>All rights reserved by the owners of this great site forever</div>"
    rows = [(k, f"https://one.example.com/p/{k}", f"<p>{' '.join(f'w{k}x{j}' for j in range(20))}</p>{notice if k % 40 == 0 else ''}") for k in range(160)]
    out = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = dict(zip(range(160), H.clean([H.read_page(h) for _, _, h in rows]), strict=True))
    assert out == want and not any("reserved" in t for t in out.values()) and all(t.startswith(f"w{k}x0 ") for k, t in out.items())
