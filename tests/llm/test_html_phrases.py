"""Pages written by hand: phrases, depth, length, odd markup, and layouts no generator made."""

import time

import pytest
from loomspark.llm import op1_html


def test_phrase_late_in_a_block():
    (block,) = op1_html.blocks("<p>" + "plain words here " * 40 + "all rights reserved</p>")
    assert "says:all rights" in block.features


DEEP = {
    "unended lists": "<ul><li>x" * 110_000,
    "nested blocks": "<div class=a>x" * 75_000,
    "names of their own": "".join(f"<div class='n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>x" for i in range(20_000)),
    "ends without starts": "<div>" * 2_000 + "</section>" * 90_000,
    "no bracket ends": "<a '" * 250_000,
    "skipped without an end": "<title>" * 140_000,
    "comments without an end": "x > <!-- " * 110_000,
    "half tags": "<a \"" * 250_000 + ">",
}


@pytest.mark.parametrize("kind", DEEP)
def test_time_follows_the_length(kind):
    model = op1_html.default_model()
    began = time.process_time()
    op1_html.main_text(DEEP[kind], model)
    assert time.process_time() - began < 8  # about 1 MB each


def test_text_within_formulas_and_objects_stays():
    (block,) = op1_html.blocks("<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <object>a diagram</object><svg><text>no</text></svg><select><option>no</select>.</p>")
    assert block.text == "where x=2 holds a diagram."


PAGES = {
    """<html><head><title>no</title><style>p {}</style></head><body class="home"><div id="top"><a href="/">Start</a> <a href="/a">About us</a> <a href="/c">Contact</a></div>
    <div id="content" class="post"><h2>How bread rises</h2><p>Yeast feeds on sugar and gives off gas, which the dough holds back in small bubbles.</p>
    <p>Salt slows it down; warmth speeds it up. Most bakers let the dough rest for an hour or two before they shape it.</p>
    <ul><li>Flour, water, salt and yeast are all it needs.</li><li>A longer rest gives more flavour to the crumb.</li></ul></div>
    <div id="sidebar"><h4>Popular posts</h4><ul><li><a href="/1">Ten soups</a></li><li><a href="/2">Better rice</a></li></ul></div>
    <div class="footer"><p>Copyright 2020 Example. All rights reserved. <a href="/p">Privacy</a></p></div></body></html>""": (
        ["How bread rises", "Yeast feeds on sugar", "Salt slows it down", "Flour, water, salt", "A longer rest gives"],
        ["Start", "Popular posts", "Ten soups", "All rights reserved"],
    ),
    """<body><header><nav><a href=/>Home</a> | <a href=/w>World</a> | <a href=/s>Sport</a></nav></header><div role="alert" class="cookie">We use cookies to improve this site. <button>Accept</button></div>
    <main><article><h1>River reaches its highest level in years</h1><div class="byline">By A. Writer</div><p>Heavy rain over three days has filled the river to the top of its banks, officials said on Monday.</p>
    <div class="advert"><p>Sponsored: buy new boots today!</p></div><p>Roads along the shore were closed in the morning, and schools in two towns stayed shut for the day.</p>
    <blockquote><p>We have not seen water like this since I was a child, one resident said.</p></blockquote><p>The level is expected to fall from Wednesday, when drier weather moves in from the west.</p></article></main>
    <section id="comments"><h3>3 comments</h3><div class="comment"><b>Kim says:</b><p>Stay safe everyone.</p></div></section>
    <aside><p>Subscribe to our newsletter</p><form><input name=m><label>Your mail</label></form></aside><footer>Terms of use</footer></body>""": (
        ["River reaches its highest", "Heavy rain over three days", "Roads along the shore", "We have not seen water", "The level is expected to fall"],
        ["World", "cookies", "Sponsored", "Stay safe", "newsletter", "Your mail", "Terms of use"],
    ),
}


@pytest.mark.parametrize("page", PAGES)
def test_pages_written_by_hand(page):
    text = op1_html.main_text(page, op1_html.default_model())
    wanted, unwanted = PAGES[page]
    assert [w for w in wanted if w not in text] == [] and [w for w in unwanted if w in text] == []
