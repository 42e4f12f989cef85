"""Articles by density: pages whose wrappers bear odd names, and the selection against all subtrees of random small trees."""

import math
import random

import pytest

from fieldbiome.llm import pages

SAID = "River gene samples were read in the field {} times, at some depth of the canal. "


def prose(first, n=6):
    texts = [(SAID.format(first + k) * 8).strip() for k in range(n)]
    return "".join(f"<p>{t}</p>" for t in texts), "\n".join(texts)


HTML, TEXT = prose(0)
MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
FOOT = "<div class=footer>&copy; 2024 the field station</div>"


@pytest.mark.parametrize("name", ["modal", "social", "legal notice", "widget-area", "site-header", "main-banner", "story-promo", "single-share", "post-content-widget", "newsletter", "sidebar", "related", "comments"])
def test_wrappers_of_odd_names_keep_their_paragraphs(name):
    assert pages.extract(f"<body>{MENU}<div class='{name}'><div>{HTML}</div></div>{FOOT}</body>") == TEXT


def test_forms_hidden_wrappers_and_page_makers():
    assert pages.extract(f"<body><form id='aspnetForm'><div>{HTML}</div></form></body>") == TEXT
    assert pages.extract(f"<body><div aria-hidden='true'><div>{HTML}</div></div></body>") == TEXT
    blog = f"<div class='widget Blog'><h3>My title</h3><div class='post-body'>{HTML}</div></div><div class='widget Label'><ul><li><a href=a>first label</a><li><a href=b>second label</a></ul></div>"
    assert pages.extract(f"<body>{blog}</body>") == f"My title\n{TEXT}"
    more, more_text = prose(10)
    kit = "".join(f"<div class='elementor-element elementor-widget x{k}'>{x}</div>" for k, x in enumerate(("<h2>Title</h2>", HTML, more)))
    assert pages.extract(f"<body>{MENU}{kit}</body>") == f"Title\n{TEXT}\n{more_text}"


def test_links_stay_in_articles():
    sources = "".join(f"<li><a href=s{k}>Source number {k} of the article</a></li>" for k in range(5))
    lines = "\n".join(f"Source number {k} of the article" for k in range(5))
    assert pages.extract(f"<body>{MENU}<article><h1>T</h1>{HTML}<ul>{sources}</ul></article>{FOOT}</body>") == f"T\n{TEXT}\n{lines}"
    assert pages.extract(f"<body><div id=story>{HTML}</div><ul>{sources}</ul></body>") == TEXT


def test_comments_go_though_they_outgrow_the_article():
    short, text = prose(50, 1)
    thread = "".join(f"<div class=comment>{prose(20 * k, 2)[0]}</div>" for k in range(9))
    for name in ("comments", "disqus_thread comments", "user-replies"):
        assert pages.extract(f"<body><div class=story><h1>T</h1>{short}</div><div class='{name}'>{thread}</div></body>") == f"T\n{text}"
    assert pages.extract(f"<body>{MENU}<article><h1>T</h1>{short}</article><form><p>{SAID * 9}</p></form><div class=ad>{SAID * 3}</div></body>") == f"T\n{text}"


def random_tree(rng, depth=0):
    tag = rng.choice(["div", "section", "a", "span", "b"]) if depth else "div"
    kids = []
    for _ in range(rng.randrange(4 if depth < 4 else 1) + (not depth)):
        kids.append("x" * rng.randrange(1, 60) if rng.random() < 0.4 else random_tree(rng, depth + 1))
    return tag, kids


def markup(tree):
    tag, kids = tree
    return f"<{tag}>" + "".join(k if isinstance(k, str) else markup(k) for k in kids) + f"</{tag}>"


def tally(tree):
    """(characters, tags, characters in links, link tags) within a node."""
    c = t = lc = lt = 0
    for k in tree[1]:
        if isinstance(k, str):
            c += len(k)
        else:
            x = tally(k)
            c, t, lc, lt = c + x[0], t + x[1] + 1, lc + x[2], lt + x[3] + (k[0] == "a")
    return (c, t, c, t) if tree[0] == "a" else (c, t, lc, lt)


def density_of(tree, share):
    c, t, lc, lt = tally(tree)
    if not c:
        return 0.0
    one = lambda x: x or 1
    base = math.log(c / one(c - lc) * lc + share * c + math.e)
    if base == 1:
        return c / one(t)
    return c / one(t) * max(math.log(c / one(lc) * one(t) / one(lt), base), 1e-9 / math.log(base))


def test_selection_against_all_subtrees():
    rng = random.Random(12)
    seen = 0
    for _ in range(300):
        tree = random_tree(rng)
        if "<a>" in markup(tree).replace("<a></a>", "") and any(x in markup(tree) for x in ("<a><div", "<a><section")):
            continue  # blocks in links close no link here, but make two trees of one text
        page = ("html", [tree])
        c, _, lc, _ = tally(page)
        share = lc / c if c else 0.0
        nodes = []

        def walk(node, path):
            total = sum(len(k) if isinstance(k, str) else density_of(k, share) for k in node[1])
            nodes.append((total, path, density_of(node, share)))
            for i, k in enumerate(node[1]):
                if not isinstance(k, str):
                    walk(k, (*path, i))

        walk(page, ())
        best = max(nodes, key=lambda x: x[0])
        root = pages.parse(markup(tree))
        pages.settle(root)
        pages.measure(root)
        core, path, threshold = pages.select(root)
        assert core.total == pytest.approx(best[0], rel=1e-9), markup(tree)
        ties = [x for x in nodes if x[0] == pytest.approx(best[0], rel=1e-9)]
        along = lambda p: min(d for _, q, d in nodes if q == p[: len(q)])
        assert any(threshold == pytest.approx(along(p), rel=1e-9, abs=1e-12) for _, p, _ in ties)
        seen += 1
    assert seen > 150
