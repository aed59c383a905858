from pyspark.sql import functions as F

from fieldloom.functions import html as P
from fieldloom.functions import html_tree as H
from fieldloom.operators import content as content_ops

LONG = "word " * 30


def extract(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(2)
    found = content_ops.extract_content(df).collect()
    return [(r.strategy, r.content) for r in sorted(found)]


def test_cascade(spark):
    long = LONG.strip()
    block = f"<div><p>{LONG}</p></div>"
    site = "<div class='x jobs-description'><b>short</b> text</div>"
    pages = [
        ("http://a.org", f"<body><article>{LONG}</article><div class='job-details'>{LONG}x</div>"),
        ("http://a.org", f"<body><nav>{LONG}</nav><article>short</article>{block}<p>end</p></body>"),
        ("http://www.linkedin.com/1", f"<body>{site}<i>rest</i></body>"),
        ("http://a.org/?u=linkedin.com", f"<body>{site}<i>rest</i></body>"),
        ("http://a.org", "<body><script>x='</p>'</script></body>"),
        ("http://a.org", None),
    ]
    assert extract(spark, pages) == [
        ('[class*="job-detail"]', f"{long} x"),
        ("largest_block", f"short {long} end"),
        ("site_linkedin.com", "short text"),
        ("full_body", "short text rest"),
        ("full_body", ""),
        ("full_body", ""),
    ]


def test_tree():
    root = H.parse("<p><b>one<br><p>two</p><ul><li>a<li>b</ul><!-- c --><div>x<!-- d --></div>")
    assert H.plain_text(root) == "one\ntwo\na\nb\nx"
    tags = [e.tag for e in H.elements(root)]
    assert tags == ["p", "b", "br", "p", "ul", "li", "li", "div"]
    div = H.elements(root)[-1]
    assert H.only_string(div) is None
    assert H.only_string(H.parse("<div><p><b>deep</b></p></div>")) == "deep"


def test_selectors():
    root = H.parse('<div id="jobX" class="a job-detailed"><main role="main">t</main></div>')
    found = H.elements(root)
    match = lambda s: H.first_matches(found, [H.compile_selector(s)])[0]
    assert match('[class*="job-detail"]').tag == "div"
    assert match(".job-detail") is None
    assert match(".a").tag == "div"
    assert match('div[id="jobX"]').tag == "div"
    assert match('[role="main"]').tag == "main"
    assert match("main").tag == "main"


def test_profile_and_title(spark):
    html = f"<title>A &amp; B</title><body><nav>n</nav><article>{'x' * 300}</article></body>"
    df = spark.createDataFrame([(1, html), (2, "<p>plain</p>")], "page_id int, html string")
    rows = content_ops.page_strategies(df).orderBy("page_id", "strategy").collect()
    assert [(r.page_id, r.title, r.strategy, r.length) for r in rows] == [
        (1, "A & B", "full_body", 302),
        (1, "A & B", "selector_article", 300),
        (2, "No title", "full_body", 5),
    ]
    assert rows[1].preview == "x" * 200 + "..."
    assert df.select(P.page_title(F.lit(None).cast("string")).alias("t")).first().t == "No title"
