from keyloom.llm import htmltree

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r.text for r in htmltree.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_only_the_tree_can_tell(spark):
    page = "<body><main><div class=x1><p>Sign up today</p></div><div class=x2><p>inside {0} {1}</p></div></main><div class=x3><p>beside {0} {2}</p></div><div class=x4><p>All rights belong to us</p></div></body>"
    rows = [(i, f"http://site/{i}", page.format(i, i * 7, i * 13)) for i in range(60)]
    assert texts(spark, rows) == {i: f"inside {i} {i * 7} beside {i} {i * 13}" for i in range(60)}


def test_a_title_before_and_a_body_beside_a_teaser_stay(spark):
    rows = [(i, f"http://site/{i}", f"<body><h1>title {i}</h1><article><p>Our best offers</p></article><div><p>body of page {i * 3}</p></div></body>") for i in range(40)]
    assert texts(spark, rows) == {i: f"title {i} body of page {i * 3}" for i in range(40)}


def test_names_that_only_qualify_remove_nothing():
    for frame in ('<body class="single has-sidebar">{}</body>', '<body class=sidebar><article class="post related-topic">{}</article></body>', '<body><div id="share-page">{}</div></body>'):
        assert htmltree.main_text(frame.format("<p>the text</p>"), set()) == "the text"
    for name in ("sidebar", "site-footer", "comment-body", "cookie-banner", "ad_slot"):
        assert htmltree.main_text(f"<body><div class='{name}'>gone</div><p>the text</p></body>", set()) == "the text"


def test_quotes_in_tags():
    assert htmltree.main_text("<p data-x=don't>It's here</p><p title=\"a>b\" x='c>d'>and</p><p \"odd>here</p><a href=\"open>lost</a>", set()) == "It's here and here lost"


def test_pages_of_great_depth(spark):
    deep = "<div>" * 50_000 + "<b>" * 1000 + "<p>deep text</p>" + "</span></b>" * 50_000 + "".join(f"<li>x{i}" for i in range(2000))
    page = htmltree.Page(deep)
    assert [t for _, t in page.blocks][:2] == ["deep text", "x0"] and len({n.key for n in page.nodes}) <= htmltree.DEPTH + 1
    assert texts(spark, [(1, "http://a/", deep)])[1].startswith("deep text x0 x1")


def entropies(pages):
    """Importance of each path by the definition, from pages as lists of (path, text) and {path: children}."""
    import math
    from collections import Counter, defaultdict

    content, shown = defaultdict(Counter), defaultdict(Counter)
    for blocks, children in pages:
        for path, text in blocks:
            content[path][text] += 1
        for path, below in children.items():
            shown[path][below] += 1
    share = lambda c: 1.0 if sum(c.values()) == 1 else -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values()) / math.log(sum(c.values()))
    own = {p: (sum(c.values()), share(c)) for p, c in content.items()}
    out = {}
    for path in shown:
        below = [v for p, v in own.items() if p[: len(path)] == path]
        if below:
            seen = sum(n for n, _ in below)
            out[path] = seen, 0.9 * sum(n * s for n, s in below) / seen + 0.1 * share(shown[path]), max(s for _, s in below)
    return out


def test_entropies_match_the_definition(spark):
    import random

    import xxhash

    rng = random.Random(3)
    rows, pages = [], []
    for i in range(40):
        blocks, children, html = [], {}, ""
        names = [n for n in ("x1", "x2", "x3", "x4") if rng.random() < 0.8]
        children[("body",)] = " ".join(f"div.{n}" for n in names)
        for n in names:
            path, k = ("body", f"div.{n}"), rng.randint(1, 3)
            children[path] = " ".join(["p"] * k)
            html += f"<div class={n}>"
            for _ in range(k):
                t = f"t{rng.randint(0, {'x1': 1, 'x2': 3, 'x3': 30, 'x4': 10**6}[n])}"
                html += f"<p>{t}</p>"
                blocks.append(((*path, "p"), t))
            html += "</div>"
        children |= {(*p, "p"): "" for p in list(children) if len(p) == 2}
        rows.append((i, "http://h/", f"<body>{html}</body><!-- {i} -->"))
        pages.append((blocks, {p: v for p, v in children.items()}))

    def key(path):
        h = 0
        for name in path:
            h = xxhash.xxh64_intdigest(name.encode(), seed=h)
        return h - (1 << 64) if h >> 63 else h

    # Each p shows itself once a block, not once a page.
    want = entropies(pages)
    low = {key(p) for p, (seen, whole, most) in want.items() if seen >= 8 and whole < 0.65 and 0.9 * most < 0.65}
    (got,) = htmltree.noise_nodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert set(got.noise) == low and 0 < len(low) < len(want)
