import pytest

from figmill.llm import extraction, queries

STORY = (
    "The man of the house was in the garden and he had to go to the city for a day with his dog, "
    "and it was the best day that they had in a year of rain and of wind on the hill by the sea that is near to us."
)
PAGES = [
    ("", ""),
    ("<p>", ""),
    ("<article>a <b>bold</b>er  one\n two<p>three<br>four</article>", "a bolder one two three four"),
    ("<article><h1>T &amp; U</h1><p><b>open<p>next &eacute;&#233;&nbsp;x</article>", "T & U open next éé x"),
    ("<article><script>var t='<p>no</p>'</script><style>p{}</style><p>yes</article>", "yes"),
    ("<nav><p>menu</p></nav><article><p>body</p><aside>side</aside><form>f</form></article><footer>z", "body"),
    ("<article><p>mine</p></article><div class='comments'><article class=comment><p>theirs</p></article></div>", "mine"),
    ("<div id=sidebar>s</div><main><p>in main</p><div class='ad-slot'>buy</div></main>", "in main"),
    ("<div class='page-header'><article><p>kept</p></article></div>", "kept"),
    ("<article><!-- <p>no --><p title='a > b'>x</p><p hidden>h</p><p style='display: none'>n</p></article>", "x"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>a</p><ul><li>one<li>two</ul><p><a href=x>all of this is a link</a></p></article>", "a one two"),
    ("<article><header><h1>Head</h1></header><p>p</p></article><header>site</header>", "Head p"),
    ("<article><p class=notice>gone<p>here</article>", "here"),
    (f"<div><a href=x>Home</a> <a href=y>More</a></div><h2>Title</h2><p>{STORY}</p><p>It was so.</p><p>{STORY}</p>"
     "<div>© 2020 all of us</div>", f"{STORY} It was so. {STORY}"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert extraction.main_text(page) == want


def test_short_blocks_follow_their_nearest_decided_neighbours():
    second = extraction.second_pass
    assert second(["short", "good", "short", "good"], "bad") == ["bad", "good", "good", "good"]
    assert second(["good", "short", "short", "bad"], "bad") == ["good", "good", "bad", "bad"]
    assert second(["bad", "near", "good"], "bad") == ["bad", "good", "good"]
    assert second(["short", "near", "short"], "good") == ["good"] * 3
    assert second(["short", "near", "bad", "short"], "bad") == ["bad", "good", "bad", "bad"]
    assert second([], "bad") == []


def test_first_pass_rules():
    first = extraction.first_pass
    assert first(STORY, 0, False) == "good"
    assert first(STORY, len(STORY), False) == "bad"
    assert first("xyz " * 60, 0, False) == "bad"
    assert first("Title", 0, False) == "short"
    assert first("© somebody", 0, False) == "bad"


def test_extract_column(spark):
    rows = [(n, "u", page) for n, (page, _) in enumerate(PAGES)] + [(99, None, None), (99, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    found = extraction.extract(pages)
    assert sorted(r["page_id"] for r in found.collect()) == sorted(r[0] for r in rows)
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert all(texts[n] == want for n, (_, want) in enumerate(PAGES)) and texts[99] == ""
    assert extraction.extract(pages.filter("false")).count() == 0


def test_query_counts_code_points(spark, tmp_path):
    rows = [(1, "u", "<article>é𝄞 x</article>"), (2, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: tuple(r) for r in queries.op8_extraction(spark, str(tmp_path)).collect()}
    assert found == {1: (1, "u", "é𝄞 x", 4), 2: (2, "u", "", 0)}


def test_given_pages_give_their_articles(spark):
    import html
    import re

    path = "/root/testdata/sf0.001"
    for row in queries.op8_extraction(spark, path).join(queries.read(spark, path, "pages"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", row["html"], re.S)[1]
        assert row["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
