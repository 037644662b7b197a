import html
import math
import random
import re

import pytest

from tallyfield.llm.html_text import Tree, densities, extract_text, main_text

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{}}</style>
<script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/a">a</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use</div>{body}
<aside>Related</aside><form>Mail <input><button>Go</button></form><div id="comments"><p>First! This is a long reader comment.</p></div>
<footer>&copy; Site</footer></body></html>"""


def test_article_alone():
    body = "<article><h1>Head &amp; line</h1><p><b>One  two\n three.<br><p>Four <a href='x'>five</a>&nbsp;six.</p></article>"
    assert main_text(PAGE.format(body=body)) == "Head & line\nOne two three.\nFour five six."


def test_densest_subtree_without_article():
    paragraphs = "".join(f"<p>Paragraph {k} has a good many words to be read by somebody who reads.</p>" for k in range(8))
    links = "".join(f'<li><a href="/{k}">link {k} with words</a></li>' for k in range(12))
    body = f"<div><div><ul>{links}</ul></div><div>{paragraphs}</div></div>"
    text = main_text(PAGE.format(body=body))
    assert text.split("\n") == [f"Paragraph {k} has a good many words to be read by somebody who reads." for k in range(8)]


def test_density_of_links_is_lower():
    tree = Tree("<div><p>plain text of some length here</p><p><a>plain text of some length here</a></p></div>")
    own, total = densities(tree)
    plain, linked = (i for i in range(len(own)) if tree.tag[i] == "p")
    assert own[plain] > own[linked]
    assert total[tree.parent[plain]] == pytest.approx(own[plain] + own[linked])


def test_test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = extract_text(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = source[r.page_id].html.partition("<article>")[2].partition("</article>")[0]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\n", article))
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in plain.split("\n")) if x)
        assert (r.text, r.n_chars, r.url) == (want, len(want), source[r.page_id].url)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>", ""),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p>a<p>b", "a\nb"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("x <a href=y>b</a", "x b"),
        ('<p title="a > b">c</p>', "c"),
        ("<p>open <b>bold</p> text", "open bold\ntext"),
        ("<script>if (a<b) {}</script><p>t</p><script>open", "t"),
        ("<!-- open", ""),
        ("&lt;p&gt; &amp;amp; &#233; &nope;", "<p> &amp; é &nope;"),
    ],
)
def test_broken_markup(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "attributes",
    [
        'style="overflow:hidden"',
        'title="hidden gems"',
        'aria-hidden="false"',
        "data-id='ad' data-role=menu",
        'class="site no-sidebar"',
        'class="post has-comments"',
        'class="entry share-price"',
        'alt="x class=ad" id=post-1',
        'class="banner"',
        'role="dialog"',
    ],
)
@pytest.mark.parametrize("tag", ["div", "article", "main"])
def test_wrappers_keep_their_text(attributes, tag):
    lines = [f"Paragraph {k} has a good many words to be read by somebody who reads." for k in range(6)]
    body = "".join(f"<p>{x}</p>" for x in lines)
    page = f"<body><nav>Menu</nav><{tag} {attributes}><div>{body}</div></{tag}><div class='cookie-notice'>We use</div></body>"
    assert main_text(page).split("\n") == lines


@pytest.mark.parametrize(
    "attributes", ["hidden", 'hidden=""', "class=x HIDDEN", 'class="box cookie-notice"', "id=comments", 'role="navigation"', "class='ad_2'"]
)
def test_parts_beside_the_article_are_left_out(attributes):
    body = "".join(f"<p>Paragraph {k} has a good many words to be read by somebody who reads.</p>" for k in range(6))
    text = main_text(f"<div><div {attributes}><p>Words of a part that nobody should read as the article's.</p></div>{body}</div>")
    assert len(text.split("\n")) == 6 and "nobody" not in text


def test_comments_longer_than_the_article():
    comments = "<p>A comment that goes on for longer than the article.</p>" * 5
    assert main_text(f"<article><p>Short text.</p></article><div id=comments>{comments}</div>") == "Short text."


def test_second_article_is_weighed():
    one, two = ([f"{word} {k} has a good many words to be read by somebody who reads." for k in range(6)] for word in ("Line", "Section"))
    bodies = ["".join(f"<p>{x}</p>" for x in lines) for lines in (one, two)]
    links = "".join(f"<article><a href=/{k}>link {k}</a></article>" for k in range(5))
    page = f"<article>{bodies[0]}</article><article>{bodies[1]}</article><div>{links}</div>"
    assert main_text(page).split("\n") == one + two


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>x</p>"), (3, "w", "<p>same</p>"), (3, "w", "<p>same</p>"), (4, "l", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract_text(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", 0), ("2", 0), ("None", 1), ("3", 4), ("3", 4), ("4", 999_999)])
    assert extract_text(pages.limit(0)).count() == 0


def test_an_article_keeps_its_header_and_formulas():
    inner = "<header><h1>Head line</h1><nav><a href=/a>menu</a></nav></header><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>no</annotation></math> here.</p>"
    page = f"<body><header><h1>Site</h1></header><article>{inner}<footer>Bio</footer></article><header>again</header></body>"
    assert main_text(page) == "Head line\nEnergy E=m here."


def grown(draw, depth=0):
    """A random element as (tag, children), a child being an element or text."""
    children = []
    for _ in range(draw.randint(1, 4)):
        if depth < 4 and draw.random() < 0.6:
            children.append(grown(draw, depth + 1))
        else:
            children.append(" ".join("w" * draw.randint(1, 8) for _ in range(draw.randint(1, 12))))
    return ("a" if depth and draw.random() < 0.2 else "div"), children


def written(node):
    tag, children = node
    return f"<{tag}>" + "".join(c if isinstance(c, str) else written(c) for c in children) + f"</{tag}>"


def measured(node, linked=False, top=True):
    """(characters, characters of links, tags, link tags) of an element, itself counted."""
    tag, children = node
    linked = linked or tag == "a"
    total = [0, 0, int(not top), int(tag == "a" and not top)]
    for c in children:
        more = [len(c), len(c) * linked, 0, 0] if isinstance(c, str) else measured(c, linked, False)
        total = [x + y for x, y in zip(total, more)]
    return total


def density(node, linked, share, top=False):
    c, lc, t, lt = measured(node, linked, top)
    if not c:
        return 0.0
    t, lc_, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc_ + share * c + math.e)
    return c / t * math.log(max(c / lc_ * t / lt, 1)) / max(math.log(base), 0.05)


def in_order(node, linked, share, out, top=True):
    """(density, sum over children) of every element in page order."""
    place = len(out)
    out.append([density(node, linked, share, top), 0.0])
    inner = linked or node[0] == "a"
    for c in node[1]:
        if not isinstance(c, str):
            at = len(out)
            in_order(c, inner, share, out, False)
            out[place][1] += out[at][0]
    return out


def test_densities_and_the_chosen_subtree_equal_a_computation_by_hand():
    draw = random.Random(12)
    for _ in range(150):
        body = ("body", [grown(draw) for _ in range(draw.randint(1, 3))])
        page = "<body>" + "".join(written(c) for c in body[1]) + "</body>"
        c, lc, _, _ = measured(body)
        want = in_order(body, False, lc / max(c, 1), [])
        own, total = densities(Tree(page))
        assert own == pytest.approx([o for o, _ in want]) and total == pytest.approx([t for _, t in want])
        best = max(range(len(want)), key=lambda i: (total[i], own[i], -i))
        nodes = []
        path_of = {}

        def walk(node, path):
            here = [*path, len(nodes)]
            nodes.append(node)
            path_of[id(node)] = here
            for child in node[1]:
                if not isinstance(child, str):
                    walk(child, here)

        walk(body, [])
        on_path = path_of[id(nodes[best])]
        least = min(own[i] for i in on_path)
        kept = set()
        for k, node in enumerate(nodes):
            path = path_of[id(node)]
            beside = any(i not in on_path and own[i] >= least > 0 and path[j - 1] in on_path for j, i in enumerate(path) if j)
            if best in path or beside:
                kept.add(k)
        texts = [t for k, node in enumerate(nodes) if k in kept for t in node[1] if isinstance(t, str)]
        assert sorted("".join(main_text(page).split())) == sorted("".join("".join(texts).split()))


def test_of_equal_subtrees_the_first_is_chosen_and_the_other_is_weighed():
    part = "<div>" + "".join(f"<p>Paragraph {k} has a good many words to be read.</p>" for k in range(4)) + "</div>"
    tree = Tree(part + part)
    own, total = densities(tree)
    tops = [i for i in range(len(own)) if tree.tag[i] == "div"]
    assert total[tops[0]] == total[tops[1]] and own[tops[0]] == own[tops[1]]
    assert len(main_text(part + part).split("\n")) == 8
