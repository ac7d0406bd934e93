"""Main texts of pages that no rule of the library made: wrappers, comments, menus, and broken or very deep markup."""

import time

import pytest

from marketloom.llm import page_text

PLAIN = "<nav><a href='/'>Home</a> <a href='/n'>News</a></nav><main><h1>A quiet harbour</h1><p>The boats came back before the storm, and nobody was hurt.</p><p>By night the rain had stopped.</p></main><footer>Imprint</footer>"
LINES = ["A quiet harbour", "The boats came back before the storm, and nobody was hurt.", "By night the rain had stopped."]


def text(page):
    return page_text.main_text(page, *page_text.trained()).split("\n")


@pytest.mark.parametrize("name", ["comments-enabled", "cookie-consent-open", "ad-free", "has-sidebar no-comments", "home blog sidebar-right", "menu footer comment ad"])
def test_classes_of_the_body_say_nothing(name):
    assert text(f'<html><body class="{name}">{PLAIN}</body></html>') == LINES


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "with-ads", "site sidebar", "comments", "page-menu", "cookie"])
def test_classes_of_wrappers_say_nothing(name):
    assert text(f'<body><div class="{name}">{PLAIN}</div></body>') == LINES
    article = "".join(f"<p>{x}</p>" for x in LINES)
    page = f'<body><nav><a href="/">Home</a></nav><div class="{name}"><article>{article}</article></div><footer>Imprint</footer></body>'
    if name not in ("comments", "page-menu", "cookie", "site sidebar"):  # nothing but the class tells these from such parts
        assert text(page) == LINES


def test_comments_within_the_article():
    page = PLAIN.replace("</main>", '<section id="comments"><h3>3 replies</h3><article class="comment"><p>I was there, and it was cold.</p></article><article class="comment"><p>Glad to hear it!</p></article></section></main>').replace("<main>", "<main><article>").replace("<section", "</article><section")
    assert text(page) == LINES
    nested = '<main><article><p>One long sentence about the harbour, its boats and its people.</p><section id="comments"><h3>3 replies</h3><article class="comment"><p>I was there, and it was cold.</p></article></section></article></main>'
    assert text(nested) == ["One long sentence about the harbour, its boats and its people."]


def test_a_usual_blog():
    page = """<body class="post-template-default single single-post logged-in"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Harbour notes</a></p>
      <nav id="site-navigation"><ul><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
      <div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-7" class="post-7 post type-post hentry category-boats">
      <header class="entry-header"><h1 class="entry-title">Paint for old boats</h1></header>
      <div class="entry-content"><p>Old paint comes off with patience, warm water and a scraper.</p><p>Let the wood dry for a week before the first coat.</p><ul><li>Two coats below the water line</li><li>One above it</li></ul></div></article>
      <div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on &ldquo;Paint for old boats&rdquo;</h2><ol class="comment-list"><li class="comment even"><article class="comment-body"><footer class="comment-meta"><b class="fn">Ada</b> says:</footer>
      <div class="comment-content"><p>A week was not enough for mine, sadly.</p></div></article></li><li class="comment odd"><article class="comment-body"><footer class="comment-meta"><b class="fn">Ben</b> says:</footer><div class="comment-content"><p>Thanks, this helped a lot.</p></div></article></li></ol>
      <div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form><label>Comment</label><textarea></textarea><input type=submit value="Post"></form></div></div></main></div>
      <aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/1">Knots</a></li><li><a href="/2">Sails</a></li></ul></section></aside></div>
      <footer id="colophon" class="site-footer"><div>Proudly made by hand</div></footer></div></body>"""
    assert text(page) == ["Paint for old boats", "Old paint comes off with patience, warm water and a scraper.", "Let the wood dry for a week before the first coat.", "Two coats below the water line", "One above it"]


def test_a_page_of_tables_without_classes():
    page = """<table><tr><td><a href="/">Home</a> | <a href="/news">News</a> | <a href="/links">Links</a></td></tr>
      <tr><td><h1>Train times</h1><p>Trains leave at six, at nine and at noon, on all days of the week.</p><p>Tickets are sold on the train, not at the station.</p></td></tr></table>"""
    assert text(page) == ["Train times", "Trains leave at six, at nine and at noon, on all days of the week.", "Tickets are sold on the train, not at the station."]


#: Pages as sites of several kinds write them, and the lines of their articles.
OTHERS = [
    ("""<body id="top"><div id="hd"><a href="/"><img src="l.png"></a></div><div id="bd"><div id="lead"><h1>Bees in the city</h1><p>There are more bees on roofs than in fields, a count has shown.</p>
      <p>The counters looked at forty roofs, and at ten fields nearby.</p></div><div id="rail"><h3>Most read</h3><ol><li><a href="/1">Wasps</a></li><li><a href="/2">Ants</a></li></ol></div></div><div id="ft"><a href="/terms">Terms</a> <a href="/jobs">Jobs</a></div></body>""",
     ["Bees in the city", "There are more bees on roofs than in fields, a count has shown.", "The counters looked at forty roofs, and at ten fields nearby."]),
    ("""<body><header><a href="/">Cook well</a></header><nav><a href="/s">Soups</a><a href="/b">Bread</a></nav><main><h1>Onion soup</h1><p>It takes an hour, most of it waiting for the onions.</p><h2>You need</h2><ul><li>six onions</li><li>a litre of stock</li></ul>
      <h2>Do this</h2><ol><li>Slice the onions, and fry them slowly.</li><li>Add the stock and wait.</li></ol></main><section class="comments"><h2>Comments (2)</h2><div>Too salty for me.</div><div>Lovely, made it twice.</div></section><footer><p>&copy; Cook well</p></footer></body>""",
     ["Onion soup", "It takes an hour, most of it waiting for the onions.", "You need", "six onions", "a litre of stock", "Do this", "Slice the onions, and fry them slowly.", "Add the stock and wait."]),
    ("""<div class="container-fluid"><div class="row"><div class="col-3"><ul><li><a href="#a">Start</a></li><li><a href="#b">Stop</a></li></ul></div><div class="col-9"><h1>The pump</h1><p>The pump starts by itself when the water rises above the mark.</p>
      <pre>pump --level 3</pre><p>To stop it, turn the key to the left.</p></div></div></div>""",
     ["The pump", "The pump starts by itself when the water rises above the mark.", "pump --level 3", "To stop it, turn the key to the left."]),
    ("""<html><body><div class="gdpr cookie-banner"><p>We value your privacy, and use cookies.</p><button>Accept</button></div><article itemscope><h1>Snow in May</h1><p>Snow fell on the hills on Sunday, for the first time in May since 1979.</p>
      <aside class="newsletter-signup"><p>Get our letter every morning.</p></aside><p>It was gone by noon, but gardens suffered.</p><div class="related-articles"><h4>Read next</h4><ul><li><a href="/x">Hail in June</a></li><li><a href="/y">Dry winters</a></li></ul></div></article>
      <section><h3>5 comments</h3><ul><li>My roses are gone.</li><li>Mine too, all of them.</li></ul></section></body></html>""",
     ["Snow in May", "Snow fell on the hills on Sunday, for the first time in May since 1979.", "It was gone by noon, but gardens suffered."]),
]


def test_other_sites():
    right = total = 0
    for page, lines in OTHERS:
        got = text(page)
        right += len(set(got) & set(lines))
        total += len(set(got) | set(lines))
        assert set(lines) <= set(got)
    assert right >= 0.9 * total


@pytest.mark.parametrize("opened", ["<div>", "<b>", "<a <", "<a '>x' ", "<p ", '<div class="x y z">', "<svg><foreignobject>", "<object>", "<select><option>", "<!--", "<", '<a "', "</div>", "<li><ul>"])
def test_time_grows_with_the_page_only(opened):
    page_text.trained()
    began = time.time()
    found = page_text.blocks("<article><p>Before it broke.</p>" + opened * 200_000 + "after" + "<p>end")
    assert found[0].text == "Before it broke."
    page_text.main_text("<main>" + (opened + "word ") * 50_000, *page_text.trained())
    assert time.time() - began < 40
