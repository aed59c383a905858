import random
import re
import zlib

import numpy as np

from fieldloom.llm import dom, licenses, toxicity, wrappers


def labelled(n=600, seed=2):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("lor", "dol", "sit", "amet", "con", "adi") for b in ("em", "um", "is", "or", "ex")]
    bad = ["grobnik", "snarfle", "vexolith"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = rng.choices(plain, k=rng.randint(5, 60))
        if toxic:
            for _ in range(rng.randint(1, 4)):
                word = rng.choice(bad) if i % 12 else "zuffel" + rng.choice(plain)
                words.insert(rng.randrange(len(words)), rng.choice([word, word + ",", word.title()]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark, make_docs):
    docs, labels = labelled()
    docs += [(1000, ""), (1001, None), (1001, None), (None, "grobnik snarfle"), (1002, "you idiot")]
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.toxicity(make_docs(docs, extra="score"), given).collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and held_out(r.doc_id)) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)
    judged = [r for r in rows if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in judged]) > 0.97
    assert {r.predicted for r in rows if r.doc_id in (1000, 1001)} == {0}
    assert [r.predicted for r in rows if r.doc_id is None] == [1]


def test_held_out_labels_change_nothing(spark, make_docs):
    docs, labels = labelled(300)
    flipped = [(i, 1 - y if held_out(i) else y) for i, y in labels]
    scores = [
        {r.doc_id: r.score for r in toxicity.toxicity(make_docs(docs), spark.createDataFrame(given, "doc_id long, toxic int")).collect()}
        for given in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_toxicity_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make_docs([(1, "fine words here"), (2, "what an idiot")])
    assert {r.doc_id: r.held_out for r in toxicity.toxicity(docs, none).collect()} == {1: held_out(1), 2: held_out(2)}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_label_model_separates_and_discounts():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.2
    votes = np.stack([truth & (rng.random(5000) < 0.6) | (rng.random(5000) < 0.01) for _ in range(3)], axis=1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1)
    patterns = {}
    for row in votes:
        key = sum(1 << v for v in np.flatnonzero(row).tolist())
        patterns[key] = patterns.get(key, 0) + 1
    model = toxicity.fit_label_model(patterns, 5, 0.2)
    p = model.posterior(toxicity.vote_matrix([sum(1 << v for v in np.flatnonzero(r).tolist()) for r in votes], 5))
    fired = votes.any(axis=1)
    assert ((p > 0.5) == truth)[fired].mean() > 0.85 and p[~fired].max() < 0.5
    assert model.weight[0] < model.weight[1] and model.correlation[0, 3] > 0.5


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a>Menu</a></nav>"
    "<div class='ad-box'>Buy</div><article><header><h1>Head &eacute;</h1><span>by X</span></header><p><b>One &amp;  two<br><p>Three</p>"
    "<aside>Side</aside><div class='comments'><p>Nice</p></div><ul><li>a<li>b</ul></article><footer>&copy;</footer></body></html>"
)


def test_article():
    assert wrappers.article(PAGE, "", frozenset()) == "Head é\nOne & two\nThree\na\nb"
    assert wrappers.article("", "", frozenset()) == ""
    assert wrappers.article("just text", "", frozenset()) == "just text"
    deep = "<div>" * 3000 + "deep" + "<p>more"
    assert wrappers.article(deep, "", frozenset()) == "deep\nmore"


def test_tree_match_keeps_order():
    a, b = (dom.parse(f"<div>{x}</div>") for x in ("<p>1</p><ul><li>2</ul><i>3</i>", "<ul><li>x</ul><p>y</p><i>z</i>"))
    size, pairs = wrappers.tree_match(a, b)
    assert size == 5 and [x.tag for x, _ in pairs] in (["#root", "div", "i", "ul", "li"], ["#root", "div", "i", "p"], ["#root", "div", "ul", "li", "i"])


def site(i, rng):
    def run(k):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(k))

    return (
        f"<html><body><div class='top'><a>Site {run(2)}</a></div><div class='wrap'><div class='box'>{run(4)}</div><div class='post'><h2>{run(4)}</h2>"
        f"<p>{run(40)}</p><p>{run(60)}</p><div class='x'>Read our daily letter</div></div></div><div class='bottom'>Terms</div></body></html>"
    )


def test_wrapper_of_a_host(spark):
    rng = random.Random(1)
    pages = [(i, f"http://Site.example:80/{i}", site(i, rng)) for i in range(12)]
    pages += [(50, None, None), (51, "http://other.example/", PAGE), (51, "http://other.example/", PAGE), (52, "nohost", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in wrappers.extract_articles(df).collect()]
    assert len(got) == len(pages)
    for i, _, html in pages[:12]:
        expected = re.search("<h2>(.*)</h2><p>(.*)</p><p>(.*)</p>", html)
        assert dict(got)[i] == "\n".join(expected.groups())
    assert dict(got)[50] == "" and dict(got)[52] == "" and sum(i == 51 for i, _ in got) == 2
    assert wrappers.extract_articles(df.limit(0)).count() == 0


def post(i, rng):
    def run(k):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(k))

    title, lead, *rest = run(5), run(30), run(80), run(90)
    body = "".join(f"<p>{x}</p>" for x in rest)
    page = f"<html><body><div class='post'><h1>{title}</h1><p>{lead}</p><div class='text'>{body}</div></div><div class='end'>Terms</div></body></html>"
    return page, "\n".join([title, lead, *rest])


def test_text_beside_the_largest_part_stays(spark):
    rng = random.Random(4)
    made = [post(i, rng) for i in range(10)]
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_articles(df).collect()}
    assert [got[i] for i in range(10)] == [text for _, text in made]
    page, text = made[0]
    assert wrappers.article(page, "", frozenset()) == text
    parts = "<body><article><p>One</p><article><p>In</p></article></article><article><p>Two and more</p></article></body>"
    assert wrappers.article(parts, "", frozenset()) == "One\nIn\nTwo and more"
    assert wrappers.article("<main><h1>T</h1><article><p>One</p></article></main>", "", frozenset()) == "T\nOne"


def test_layout_names_keep_the_article():
    body = "<h1>Title</h1><p>One long paragraph of the story.</p><p>Two</p>"
    whole = "Title\nOne long paragraph of the story.\nTwo"
    for name in ("container has-sidebar", "no-sidebar", "page-with-menu", "elementor-widget", "hidden-xs-none wrap"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div class='post'>{body}</div>"):
            assert wrappers.article(f"<body><nav>Menu</nav><div class='{name}'>{inner}</div></body>", "", frozenset()) == whole
    around = "<form action=x><div class='sidebar-layout comments-open'><main>%s</main></div></form><div class='sidebar'>Aside</div>"
    assert wrappers.article(around % body, "", frozenset()) == whole
    for header in ("<header class='entry-header'>%s</header>", "<div class='article-header'>%s</div>"):
        own = header % "<h1>Title</h1><p class='lead'>A lead</p><span class='date'>Today</span>"
        assert wrappers.article(f"<article>{own}<p>One</p></article>", "", frozenset()) == "Title\nA lead\nOne"
    # Names of an element itself still count, and a lesser article does not keep what is around it.
    page = f"<main>{body}<div class='share-buttons'>Share</div></main><div class='related-posts'><article>Other</article></div><div id='comments'><article class='comment'>Me</article></div>"
    assert wrappers.article(page, "", frozenset()) == whole
    assert wrappers.article(f"<article>{body}</article><div class='comment-list'><article class='comment'>{'Longer ' * 99}</article></div>", "", frozenset()) == whole


def test_columns_that_clash(spark):
    names = "host wrapper _host _of _page _wrapper _article kind".split()
    rows = [(i, f"http://a.example/{i}", f"<main><p>Text {i}</p></main>", *names) for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(["page_id long, url string, html string", *[f"`{c}` string" for c in names]]))
    got = wrappers.extract_articles(df)
    assert got.columns == [*df.columns, "text"]
    assert all(r.text == f"Text {r.page_id}" and [r[c] for c in names] == names for r in got.collect())


def test_constant_paragraphs_after_others_are_template(spark):
    rng = random.Random(5)
    closing = "<p>Subscribe to our daily letter and read more</p><p>All rights are with the house</p></div></div>"
    made = [post(i, rng) for i in range(8)]
    pages = [(i, f"http://a.example/{i}", p.replace("</div></div>", closing, 1)) for i, (p, _) in enumerate(made)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_articles(df).collect()}
    assert [got[i] for i in range(8)] == [text for _, text in made]


def test_wrappers_come_from_all_pages_and_kinds(spark):
    rng = random.Random(6)
    # Forty near copies of one article, with clocks, among pages of two kinds with a notice each.
    made = [post(i, rng) for i in range(12)]
    pages, expected = [], []
    for page, text in made[:6]:
        pages.append(page.replace("</div></div>", "<p>Posted in our town blog</p></div></div>", 1))
        expected.append(text)
    for page, text in made[6:]:
        page = page.replace("<h1>", "<div class='shop'><ul class='facts'><li>New<li>Used</ul></div><div class='price'><b>x</b></div><h1>", 1)
        pages.append(page.replace("</div></div>", "<p>Sold by our town shop</p></div></div>", 1))
        expected.append(text)
    copied, text = post(99, rng)
    for i in range(40):
        pages.append(copied.replace("</div></div>", f"<p>{i} reads</p></div></div>", 1))
        expected.append(f"{text}\n{i} reads")
    df = spark.createDataFrame([(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_articles(df).collect()}
    assert [got[i] for i in range(6)] == expected[:6]
    assert all("Sold by" not in got[i] and got[i].endswith(expected[i]) for i in range(6, 12))
    assert [got[i] for i in range(12, 52)] == expected[12:]


def test_licenses_equal_a_loop(make_docs):
    rng = random.Random(3)

    def noise(k):
        return " ".join(f"w{rng.randrange(500)}" for _ in range(k))

    rows = []
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        rows.append((3 * i, f"{noise(rng.randrange(60))} {text} {noise(30)}"))
        words = text.split()
        words[rng.randrange(len(words))] = "other"
        rows.append((3 * i + 1, f"{noise(5)} {' '.join(words)}"))
        rows.append((3 * i + 2, text.upper() + " " + rng.choice(list(licenses.TEMPLATES.values()))))
    rows += [(900, None), (901, ""), (902, "MIT"), (0, rows[0][1])]
    got = {(r.doc_id, r.license): r.share for r in licenses.scan_licenses(make_docs(rows, extra="license")).collect()}

    def sh(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    expected = {}
    for i, text in rows:
        for name, template in licenses.TEMPLATES.items():
            share = len(sh(text) & sh(template)) / len(sh(template))
            if share >= licenses.LEAST_SHARE:
                expected[i, name] = share
    assert got == expected
    assert licenses.scan_licenses(make_docs(rows).limit(0)).count() == 0
    assert licenses.scan_licenses(make_docs(rows), {}).count() == 0


def test_deciding_clauses_and_whole_texts(make_docs):
    known = licenses.all_templates()
    names = ["BSD-2-Clause", "BSD-3-Clause", "LGPL-3.0 notice", "AGPL-3.0 notice", "GPL-2.0 notice", "GPL-3.0 notice", "ISC", "Zlib", "MIT text"]
    names += ["GPL-2 license", "Apache-2.0 license"]
    rows = [(i, f"some words before {known[name]} and after") for i, name in enumerate(names)]
    rows.append((100, known["BSD notice"]))
    rows.append((101, known["BSD-3-Clause"] + " and also " * 20 + known["BSD-2-Clause"]))
    got = {}
    for r in licenses.scan_licenses(make_docs(rows), known, decide=True).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, name in enumerate(names):
        assert name in got[i] and (i > 8 or got[i] == {name}), (name, got[i])
    assert got[100] == {"BSD notice"} and got[101] >= {"BSD-3-Clause", "BSD-2-Clause"}


def test_bands_keep_their_bound():
    """Every size up to 6,000: a window with the least share of it and only others' shingles beside."""
    for size in [*range(1, 300), 1000, 1024, 1025, 6000]:
        similarity = licenses.least_similarity(size)
        held = -(-3 * size // 4)
        assert similarity <= held / (2 * licenses.size_class(size) + size - held) + 1e-12
        assert (1 - similarity) ** licenses.bands_of([size]) <= 1e-9
