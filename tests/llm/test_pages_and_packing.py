"""HTML extraction, URL filter, packing, sharding."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docwarden.llm import html_extract, packing, sharding, url_filter

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain  words", "plain words"), ("<script>x</script><nav><a href=1>menu</a></nav>", ""),
    ("<body><nav>Menu</nav><article><h1>T</h1><p>A <b>b<br><p>c&amp;d, e.</article><footer>f</footer>", "T A b c&d, e."),
    ("<div class='sidebar'>s</div><div id=main-text><p>One two, three.</p><p>Four five.</p></div><form>f</form><div class=comments><p>nice!</p></div>", "One two, three. Four five."),
    ("<article><header><h1>Head</h1></header><p>Body&nbsp;text.</p><section class='reader-comments'>no</section><aside>no</aside></article>", "Head Body text."),
    ("<main><p>a<!-- <p>no</p> --> b</p><style>p{}</style><div class='cookie-notice'>no</div><ul><li>x<li>y</ul></main>", "a b x y"),
    ("<p>a<i>b</i>c</p><p>1 < 2 &lt; 3</p>", "abc 1 < 2 < 3"),
])
def test_page_texts(page, text):
    assert html_extract.extract_text(page or "")[0] == text


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>é, long</p></article>"), (1, "u", "<article><p>é, long</p></article>"), (2, None, None), (None, "v", "<p>" + "x " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = sorted(((r.page_id, r.n_chars) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, 7), (1, 7), (2, 0), (None, 99_999)], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_captures_see_the_list_of_their_day(spark):
    log = [("bad.example", "m", 10, True), ("bad.example", "m", 50, False), ("bad.example", "m", 50, False), ("bad.example", "m", 90, True),
           ("a.example/x", "s", 0, True), ("sub.ok.example", "s", 5, True), ("same.example", "s", 7, True), ("same.example", "s", 7, False), (None, "s", 1, True)]
    asks = [(1, "https://BAD.example/p", 9), (2, "https://www.bad.example:80/p?q", 10), (3, "http://bad.example", 49), (4, "http://bad.example", 50), (5, "http://u@bad.example/#f", 200),
            (6, "http://a.example/x/y", 3), (7, "http://a.example/xy", 3), (8, "http://ok.example/", 9), (9, None, 3), (10, "nonsense", 3), (11, "http://bad.example", None),
            (12, "http://same.example/", 8), (12, "http://same.example/", 8)]
    log = spark.createDataFrame(log, "pattern string, category string, day int, listed boolean")
    captures = spark.createDataFrame(asks, "page_id long, url string, day int").withColumn("pattern", F.lit("clash")).withColumn("since", F.lit(1))
    got = {r.page_id: (r.blocked, r.categories) for r in url_filter.judged(captures, log).collect()}
    assert got == {i: (i in (2, 3, 5, 6, 12), {2: "m", 3: "m", 5: "m", 6: "s", 12: "s"}.get(i, "")) for i in range(1, 13)}
    assert url_filter.judged(captures.limit(0), log).count() == 0 and not any(r.blocked for r in url_filter.judged(captures, log.limit(0)).collect())


def test_pieces_hold_every_id_once(frame, odd_rows):
    rows = odd_rows + [(50, "a'b don't x́y É ² <|endoftext|> q"), (51, "tab\tnew\nline\x0bv\x85w\xa0n"), (52, "İstanbul ΑΣ ﬁ 日本")]
    got = packing.pack(frame(rows), WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(held) == list(range(len(held)))
    for pieces in held.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto
            upto += length
        assert upto <= 2048
    assert packing.pack(frame([]), WORD_BPE).count() == 0


def test_patterns_cover_the_demand_with_little_padding():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        sizes, demand = np.unique(rng.integers(1, 129, n), return_counts=True)
        patterns, times = packing.solve_patterns(sizes, demand, 128)
        assert n == 0 or (times @ patterns == demand).all() and (patterns @ sizes <= 128).all() and (times > 0).all()
    assert times.sum() <= 1.03 * (sizes * demand).sum() / 128 + 1


def test_permutation_and_shards(spark, frame, odd_rows):
    for n in (1, 2, 3, 5, 16, 17, 257, 1000):
        places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()]
        assert sorted(places) == list(range(n)) and (n < 100 or places != sorted(places))
        a, b = sharding.bases(n)
        assert n <= a * b < n + a
    for rows in (odd_rows, [(i, f"t{i}") for i in range(100)]):
        got = sharding.shard(frame(rows)).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[k]) for k in range(16)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.shard(frame([])).count() == 0


PARAGRAPHS = [f"Paragraph {k} tells, at some length, what happened on that day; it has several marks, and it ends here." for k in range(8)]
LONG = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(PARAGRAPHS)
LINKS = "".join(f"<div><a href=/{k}>Topic {k}</a></div>" for k in range(9))


@pytest.mark.parametrize(("page", "text"), [
    # Containers of the same tag names, without names of their own.
    (f"<body><div><div>{LINKS}</div><div><h2>Head</h2>{LONG}</div><div><p>Archive</p><p>May</p><p>June</p></div></div></body>", "Head " + TEXT),
    # Text beside an article.
    (f"<body><article>{LONG}</article><div>{LONG}{LONG}</div></body>", " ".join([TEXT] * 3)),
    # Names that say something else, on headings, ids made of headings, and around the whole text.
    (f"<body><div class=search-page><h2 class=banner>Related work</h2>{LONG}</div></body>", "Related work " + TEXT),
    (f"<body><form id=aspnetForm><nav>{LINKS}</nav><div>{LONG}</div></form></body>", TEXT),
    (f"<article>{LONG}<section id=related-work><h2>More</h2><p>Others wrote, before us, of the same things.</p></section></article>", TEXT + " More Others wrote, before us, of the same things."),
    # Short blocks and links between the paragraphs, and a notice of some length.
    (f"<main>{LONG}<h3>So</h3><p>Yes</p><p>See <a href=x>this</a> here.</p>{LONG}<div class=cookie-notice>{PARAGRAPHS[0]}</div></main>", f"{TEXT} So Yes See this here. {TEXT}"),
    (f"<p>{TEXT}</p><span class=ad>x</span>b, c", TEXT + " b, c"),
    (f"<div>{LONG}<ul><li>one<li>two</ul><table><tr><td>1<td>2</table></div><div><div>{LINKS}</div></div>", TEXT + " one two 1 2"),
    ("<body>" + "".join(f"<div><p>{p}</p></div><div><p>Yes.</p></div>" for p in PARAGRAPHS[:2]) + f"<div><p>{PARAGRAPHS[2]}</p></div><div><p>Tags</p></div>", " Yes. ".join(PARAGRAPHS[:3])),
])
def test_paths_decide_page_texts(page, text):
    assert html_extract.extract_text(page)[0] == text


def test_names_hold_whatever_the_size():
    article = "<p>The harbour town grew over two centuries, and its markets, once small, fed the coast.</p>" * 4
    remarks = "<p>Great read, thanks for posting it, I have been there twice, and loved it very much.</p>" * 9
    want = " ".join(["Harbour", *["The harbour town grew over two centuries, and its markets, once small, fed the coast."] * 4])
    for other in (
        f"<section class='comments'>{remarks}</section></article>", f"<div id=comments class=comment-list>{remarks}</div></article>",
        f"<aside class=sidebar>{remarks}</aside></article>", f"</article><div class='post-comments'>{remarks}</div>", f"</article><footer>{remarks}</footer>",
        f"</article><div class='related-posts'>{remarks}</div>", f"<div class='ad-slot-12'>{remarks}</div></article>",
    ):
        assert html_extract.extract_text(f"<html><body><nav><a href=/>Home</a></nav><article><h1>Harbour</h1>{article}{other}</body></html>")[0] == want, other


def test_names_that_only_look_like_others():
    for name in ("post social-science", "search-and-rescue", "alert-design-essay", "shared-history"):
        assert html_extract.extract_text(f"<html><body><div class='{name}'><p>A short post, with few words.</p></div></body></html>")[0] == "A short post, with few words.", name
    # A layout named after its sidebar holds all sentences; the sidebar in it does not count.
    page = "<div class='content-sidebar-wrap'><div class=entry><p>First part, long enough.</p><p>Second part, as long.</p></div><div class=sidebar><p>Aside, too.</p></div></div>"
    assert html_extract.extract_text(page)[0] == "First part, long enough. Second part, as long."
    # Comments and footers are never the text, even where nothing else is.
    assert html_extract.extract_text("<h1></h1><div class=comments><p>Nice, thanks.</p></div><footer><p>All rights, reserved.</p></footer>")[0] == ""


def test_generated_pages_against_their_own_articles():
    """Pages are put together from parts, so the text is known: that of the parts that belong to the article."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioubcdfgklmnrst") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(9, 16))).capitalize() + ", " + word() + "."
    for _ in range(60):
        blocks = [" ".join(sentence() for _ in range(rng.randrange(2, 5))) for _ in range(rng.randrange(3, 9))]
        tagged = [f"<p>{b}</p>" for b in blocks]
        noise = [
            f"<div class='{rng.choice(['comments', 'comment-list', 'sidebar', 'newsletter-box', 'related-posts', 'share-bar', 'cookie-notice'])}'>"
            + "".join(f"<p>{sentence()}</p>" for _ in range(rng.randrange(1, 12))) + "</div>" for _ in range(3)
        ] + [f"<aside><p>{sentence()}</p></aside>", f"<!-- {sentence()} --><script>{sentence()}</script>", f"<form>{sentence()}<input></form>"]
        for part in noise:
            tagged.insert(rng.randrange(len(tagged) + 1), part)
        title = word().capitalize()
        outside = f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a></li>' for _ in range(9))}</ul></nav>"
        page = f"<html><body>{outside}<article><h1>{title}</h1>{''.join(tagged)}</article><footer><p>{sentence()}</p></footer></body></html>"
        assert html_extract.extract_text(page)[0] == " ".join([title, *blocks])


def test_hostile_pages_take_linear_time():
    start = time.process_time()
    assert html_extract.extract_text("<div>" * 100_000 + "deep, text.")[0] == "deep, text."
    html_extract.extract_text("<b>" * 100_000 + "</i>" * 100_000)
    assert time.process_time() - start < 15
