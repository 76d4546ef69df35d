import numpy as np

from doclens.llm import html as H

PAGE = "page_id long, url string, html string"


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    page = '<html><head><title>T</title></head><body><!-- x <p> --><p>a &amp; b&nbsp;c\n  <b>d</b>e<br>f<p>g</p><script>var t="</p>";</script><ul><li>h<li>i</ul><div title="a>b">j</div>k &copy 2 &am'
    assert texts(page) == ["a & b c de f", "g", "h", "i", "j", "k © 2 &am"]
    paths = [b.path for b in H.blocks('<div class="Side-bars x"><nav id=top><a href=x>l</a></nav></div><p>q')]
    assert paths == [("div", ".side", ".bar", ".x", "nav", ".top"), ("p",)]
    assert texts("") == texts("<p></p>") == [] and texts("just < text") == ["just < text"]
    assert texts("<p>" * 3000 + "deep") == ["deep"]


def test_labels_of_pages_that_it_has_not_seen():
    net, grammar = H.fit(), H._Grammar(4321)
    hit = wrong = missed = 0
    for _ in range(150):
        page, wanted = grammar.page()
        if page:
            got = H.logits(net, [H.features(page)])[0][:, 0] > 0
            hit, wrong, missed = hit + (got & wanted).sum(), wrong + (got & ~wanted).sum(), missed + (~got & wanted).sum()
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_padding_does_not_change_a_page():
    net, grammar = H.fit(), H._Grammar(77)
    pages = [p for p in (H.features(grammar.page()[0]) for _ in range(8)) if len(p)]
    together = H.logits(net, pages)[0]
    for k, p in enumerate(pages):
        assert abs(together[: len(p), k] - H.logits(net, [p])[0][:, 0]).max() < 1e-3


def test_extract_by_hand_written_page_and_odd_rows(spark):
    article = "".join(f"<p>Sentence number {i} of the story is told here, and it goes on for a while.</p>" for i in range(6))
    page = f'<html><head><title>x</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article><h1>The story of it all</h1>{article}</article><div class="comments"><p>Great article, thanks!</p></div><footer>&copy; 2024 The Site</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page, 5), (None, None, None, 6), (2, "v", "", 7), (2, "v", "", 7)], PAGE + ", text int")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert got[1].text == "The story of it all\n" + "\n".join(f"Sentence number {i} of the story is told here, and it goes on for a while." for i in range(6))
    assert got[1].n_chars == len(got[1].text) and got[None].text == "" and got[2].n_chars == 0
    assert H.extract(df).count() == 4 and H.extract(df.limit(0)).count() == 0
    assert H.extract(df).columns == ["page_id", "url", "text", "n_chars"]


def test_articles_of_the_given_pages(spark):
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    right = 0
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1].replace("<br>", " ")
        want = [" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?p>|</?h1>", inner)]
        right += "\n".join(w for w in want if w) == got[r.page_id]
    assert right >= 0.995 * len(got)


def test_articles_end_where_their_element_does():
    """What an article ends with stays, whatever it says; the same words in a footer go."""
    story = "".join(f"<p>Sentence number {i} of the story is told here, and it goes on for a while.</p>" for i in range(5))
    for end in ("This work is licensed under the General License, version 2.", "again again again again again again again", "one$$ two## three%% four$$ five## six%%", "left | middle | right |", "Is it so."):
        page = f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article><h1>The story of it all</h1>{story}<p>{end}</p></article><footer>&copy; 2024 a.site.org &middot; {end}</footer></body></html>'
        got = H.main_texts(H.fit(), [page])[0].split("\n")
        assert got[-1] == end and len(got) == 7 and not any("©" in g for g in got)


def test_blocks_know_their_neighbours():
    one, two, three = H.blocks("<article><p>a</p><p>b</p></article><footer>c</footer>")
    assert one.nest[:1] == two.nest[:1] != three.nest[:1]
    assert H._apart(one, two) == (0.5, 0.5, 1.0) and H._apart(two, three) == (1 / 3, 0.5, 0.0)
    x = H.features([one, two, three])
    assert (x[0, -6:-3] == 0).all() and (x[2, -3:] == 0).all() and x[1, -6:].tolist() == [0.5, 0.5, 1.0, x[1, -3], 0.5, 0.0]


def test_long_blocks_are_read_whole(spark):
    """A block of 10,000 words stays in the article, and what stands at its end counts."""
    story = " ".join(f"word{i % 700}" + ("." if i % 12 == 11 else "") for i in range(10_000))
    page = f'<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A long story</h1><p>{story}</p><p>The end of it comes here.</p></article><footer>&copy; 2024 The Site</footer></body></html>'
    got = H.extract(spark.createDataFrame([(1, "u", page)], PAGE)).first().text
    assert got == f"A long story\n{story}\nThe end of it comes here."
    one, other = (H.features([H.Block(("p",), story + end, 0)])[0] for end in (" apple", " zebra crossing"))
    assert (one[H.PATH : H.PATH + H.WORDS] != other[H.PATH : H.PATH + H.WORDS]).any()
    ratio = H.features([H.Block(("p",), story, 0)])[0][H.PATH + H.WORDS + 2]
    assert abs(ratio - story.count(".") / 10_000) < 1e-6


def test_gradients_by_differences():
    grammar = H._Grammar(3)
    pages = [(H.features(b), y) for b, y in (grammar.page() for _ in range(3)) if len(b)]
    x, y = [p for p, _ in pages], [t for _, t in pages]
    net = H._new(5)
    for p in net.params():
        p *= 0.3

    def loss():
        z, (_, live, *_) = H.logits(net, x)
        total = 0.0
        for k, t in enumerate(y):
            s = z[: len(t), k].astype(np.float64)
            total += (np.logaddexp(0, s) - s * t).sum()
        return total / live.sum()

    rng = np.random.default_rng(0)
    for p, g in zip(net.params(), H._gradient(net, x, y), strict=True):
        along = rng.standard_normal(p.shape).astype(np.float32) * (g != 0)
        old = p.copy()
        p[...] = old + 1e-2 * along
        up = loss()
        p[...] = old - 1e-2 * along
        down = loss()
        p[...] = old
        want = float((g.astype(np.float64) * along).sum())
        assert abs((up - down) / 2e-2 - want) < 0.02 * abs(want) + 2e-4
