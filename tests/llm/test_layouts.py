"""Main text of page layouts that the model's training pages don't have: other names, other nesting, real words."""

import random

from corpusmill.llm import html_extract

WORDS = "the a of river council said that new plan would cost about three million over next years while local residents asked for more time to read it before vote on Tuesday because many had not seen map of flood areas and did know whether their homes were inside them which engineers call low risk".split()
R = random.Random(11)


def sentence(low=8, high=24):
    return (" ".join(R.choice(WORDS) for _ in range(R.randint(low, high))) + ".").capitalize()


def paragraph():
    return " ".join(sentence() for _ in range(R.randint(1, 5)))


def links(n, item="<li><a href='/{0}'>{0}</a></li>"):
    return "".join(item.format(R.choice(WORDS)) for _ in range(n))


def news(main):
    side = "".join(f"<div class='teaser'><a href='/s'>{sentence(4, 9)}</a></div>" for _ in range(4))
    return f"""<html><body><div id=root><div class="c-top"><a href=/>Daily</a> <ul class="c-top__list">{links(6)}</ul></div>
      <div class="c-article__inner"><h1>{main[0]}</h1>{"".join(f"<p class=c-p>{p}</p>" for p in main[1:])}</div>
      <div class="rail"><p>Subscribe now</p>{side}</div><div class="c-btm"><p>All rights reserved. {sentence(3, 6)}</p><ul>{links(5)}</ul></div></div></body></html>"""


def blog(main):
    return f"""<body class="home"><div class="wrap"><div class="top-strip">{links(4, "<a href='/{0}'>{0}</a> | ")}</div><div class="col-8"><h1 class="ttl">{main[0]}</h1>
      {"".join(f"<p>{p}</p>" for p in main[1:])}</div><div class="col-4"><div class="box"><h4>Archives</h4><ul>{links(8)}</ul></div><div class="box"><h4>About</h4><p>{sentence(6, 12)}</p></div></div>
      <div class="reactions"><div class="r"><b>Ann</b><div>{sentence(3, 8)}</div></div><div class="r"><b>Bo</b><div>{sentence(3, 8)}</div></div></div></div>"""


def tables(main):
    return f"""<table width=100%><tr><td bgcolor=#ccc>{links(7, "<a href='/{0}'>{0}</a><br>")}</td><td><div><h1>{main[0]}</h1>{"".join(f"<p>{p}" for p in main[1:])}</div></td></tr>
      <tr><td colspan=2><div><font size=1>&copy; 1999 {sentence(2, 4)}</font></div></td></tr></table>"""


def shop(main):
    return f"""<div data-x=1><div class="hd"><form><input name=q> <button>Go</button></form><ul>{links(5)}</ul></div><section class="xq"><h1>{main[0]}</h1><div class="zz">{"".join(f"<p>{p}</p>" for p in main[1:])}</div></section>
      <section class="also"><h3>You may like</h3><ul>{links(6)}</ul></section><div class="ck">We use small files to make this work. <button>Fine</button></div></div>"""


def scores(n=40):
    """Shares of the kept characters that are main text, and of the main text's that are kept, over ``n`` pages of each layout."""
    model, out = html_extract.default_model(), {}
    for layout in (news, blog, tables, shop):
        right = kept = whole = 0
        for _ in range(n):
            main = [sentence(4, 9)] + [paragraph() for _ in range(R.randint(3, 9))]
            found = html_extract.main_text(layout(main), model).split("\n\n")
            kept += sum(map(len, found))
            whole += sum(map(len, main))
            right += sum(len(x) for x in found if x in main)
        out[layout.__name__] = (right / max(1, kept), right / whole)
    return out


def test_layouts_of_other_makers():
    found = scores()
    assert min(p for p, _ in found.values()) > 0.85, found
    assert min(r for _, r in found.values()) > 0.85, found


def test_text_of_elements_that_do_not_end():
    model = html_extract.default_model()
    page = "<article><h1>One</h1><p>Two <math><mi>x</mi></math> three.</p><p>Four <svg><path d=1> five.</p><object><p>Six seven.</p></article>"
    assert html_extract.main_text(page, model) == "One\n\nTwo x three.\n\nFour five.\n\nSix seven."
    assert html_extract.main_text("<article><p>Two <svg><text>no</text></svg> three.</p></article>" + "<svg>" * 20_000, model) == "Two three."


def test_deep_nesting_takes_linear_time_and_memory():
    import time
    import tracemalloc

    model = html_extract.default_model()
    took, held = [], []
    for n in (10_000, 100_000):
        page = "".join(f"<div class='a{i % 7} b{i}'>x" for i in range(n)) + "</p></li><li>y" * n
        tracemalloc.start()
        start = time.perf_counter()
        text = html_extract.main_text(page, model)
        took.append(time.perf_counter() - start)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert set(text) <= set("xy\n")
    assert took[1] < 25 * took[0] and held[1] < 20 * held[0] and held[1] < 500e6


def test_features_of_a_path_are_those_of_its_elements():
    from corpusmill.llm.html_blocks import blocks

    page = "<div class='a b'>one<article id='b c'><p class='a'>two</p></article></div><div class='a b'>three</div><noscript>four</noscript>"
    found = {text: node for node, text, _ in blocks(page)}
    assert found["one"] is found["three"]  # the same path is one node
    assert found["two"].features() == sorted(["own:p", "up:article", "in:div", "in:article", "in:p", "name:a", "name:b", "name:c"])
    assert found["one"].features() == sorted(["own:div", "up:", "in:div", "name:a", "name:b", "not in article or main"])
    assert found["two"].holder.tag == "article" and "four" in found
