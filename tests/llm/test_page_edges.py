"""Main text of pages that no generator made, open markup, and time in proportion to the page's length."""

import random
import time

import pytest

from tessera.llm import html_content

MARKS = ["<!--", "<![", "<?x", "<!x", "<a ", "</", "</p", '<a href="', "<a b='", "<!-->", "&#", "<p>", "<div>", "<script", "<title>", "<b", "x <y "]


@pytest.fixture(scope="module")
def model():
    return html_content.trained()


def test_reader_comments_inside_the_post(model):
    page = '<body><div class="post"><h1>A title of words</h1><p>It is said. And so on it goes.</p><p>More words here. Yes, more.</p><div class="reader-comments"><p>Nice post. I agree.</p></div></div><footer>Legal words</footer></body>'
    assert model.extract(page) == "A title of words\n\nIt is said. And so on it goes.\n\nMore words here. Yes, more."
    nested = "<main><h2>Words</h2><p>One sentence here. Another one.</p><p>A third of them. It ends.</p><section class='comments'><ol><li><b>Ann</b><p>So good.</p></li><li><b>Bo</b><p>Not so.</p></li></ol></section></main>"
    assert model.extract(nested) == "Words\n\nOne sentence here. Another one.\n\nA third of them. It ends."


def test_bare_text_and_labels(model):
    assert model.extract("<p>One here. Two there.</p>") == "One here. Two there."
    assert model.extract("<article><p><label>Word</label> goes on. It does.</p></article>") == "Word goes on. It does."


@pytest.mark.parametrize("tail", ["<!-- open <p>more", "<![x open", "<?open", "<!open", "<a href='x", "</p", "<!-->"])
def test_open_markup_is_no_text(model, tail):
    assert model.extract("<article><p>One here. Two there.</p>" + tail) == "One here. Two there."


def test_comments_end_as_browsers_end_them(model):
    page = "<article><p>One <!-- a > b -- c -->here.<!--> Two<!---> there.<!-- x --!> Three. 1 < 2 &amp; a<b>c</b>.</p></article>"
    assert model.extract(page) == "One here. Two there. Three. 1 < 2 & ac."


@pytest.mark.parametrize("mark", MARKS)
def test_time_grows_with_the_length_only(model, mark):
    def took(n):
        begun = time.process_time()
        model.extract("<article><p>One. Two.</p></article>" + mark * n)
        return time.process_time() - begun

    assert took(16_000) < 20 * max(took(2_000), 0.05)


def test_random_markup(model):
    r = random.Random(7)
    for _ in range(300):
        begun = time.process_time()
        model.extract("".join(r.choices([*MARKS, ">", "-->", "'", '"', " word ", "</div>", "</script>"], k=r.randint(1, 60))))
        assert time.process_time() - begun < 1


def test_query_on_odd_rows(spark, tmp_path):
    page = "<article><p>One here. Two there.</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", page, "x"), (4, "l", "<article>" + "<p>Some words are here. And more.</p>" * 5000, "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    found = html_content.op5_dom_content(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in found) == [(0, "w", 20), (1, "u", 20), (1, "u", 20), (2, "", 0), (3, "v", 0), (4, "l", 5000 * 30 + 4999 * 2)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert html_content.op5_dom_content(spark, f"{tmp_path}/none").count() == 0
