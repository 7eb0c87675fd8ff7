"""The site's tree against a plain one, and what it decides where names tell nothing."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tmloom.llm import html as h

SYLLABLES = ["ka", "lo", "mi", "ta", "ro", "shu"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_tree(sources):
    """Importance of each node of one site, by walking down from it."""
    pages = {}
    for source in sources:
        blocks, elements = h.parsed(source)
        pages.setdefault(h.page_key(blocks), []).append((blocks, elements))
    seen, styles, contents, linked = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(list)
    shares, paths = defaultdict(Counter), {}
    for copies in pages.values():
        nodes, orders, texts, parts, within = set(), set(), set(), defaultdict(float), {}
        for blocks, elements in copies:
            children = defaultdict(Counter)
            for e in elements:
                nodes.add(e.path[-1])
                paths[e.path[-1]] = e.path
                orders.add((e.path[-1], tuple(e.children)))
                children[e.path[-1]].update(e.children)
            for node, counted in children.items():
                for child, n in counted.items():
                    parts[node, child] = max(parts[node, child], n / counted.total())
            for b in blocks:
                texts.add((b.node, b.text))
                within[b.node, b.text] = (b.linked * len(b.text), len(b.text))
        seen.update(nodes)
        for node, order in orders:
            styles[node][order] += 1
        for node, text in texts:
            contents[node][text] += 1
            linked[node].append(within[node, text])
        for (node, child), share in parts.items():
            shares[node][child] += share

    def importance(node):
        m = seen[node]
        n = styles[node].total()
        own = 1.0 if m == 1 else min(1.0, -sum(c / n * math.log(c / n) for c in styles[node].values()) / math.log(m))
        passed = h.DAMPING ** len(styles[node])
        below = 0.0
        for child, share in shares[node].items():
            part = share / shares[node].total()
            if child == h.TEXT:
                texts = contents[node]
                bits = sum(c * math.log(c) for c in texts.values()) / texts.total()
                entropy = 0.0 if m == 1 else min(1.0, bits / math.log(m))
                links = sum(a for a, _ in linked[node]) / sum(b for _, b in linked[node])
                below += part * (0.0 if links > h.MAX_LINKED else 1 - entropy)
            else:
                below += part * importance(child)
        return (1 - passed) * own + passed * below

    return {node: (seen[node], importance(node)) for node in seen}


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        name = rng.choice(["div", "section", "ul", "p"])
        mark = rng.choice(["", ' class="x"', ' class="y z"'])
        inside = random_page(rng, depth + 1) if name != "p" and depth < 3 and rng.random() < 0.6 else (
            f'<a href="q">{rng.choice("abc")} link</a>' if rng.random() < 0.2 else rng.choice(["one", "two", sentence(rng, 3)]))
        out.append(f"<{name}{mark}>{inside}</{name}>")
    return "".join(out)


def test_importance_is_that_of_a_plain_tree(spark):
    rng = random.Random(8)
    sites = {f"h{k}.com": [random_page(rng) for _ in range(n)] for k, n in enumerate([1, 2, 5, 12, 30])}
    sites[None] = [random_page(rng) for _ in range(4)]
    sites["h3.com"] += sites["h3.com"][:3]
    rows = [(host, page) for host, pages in sites.items() for page in pages]
    nodes, _ = h.style_tree(spark.createDataFrame(rows, "host string, html string"), "host", "html")
    got = defaultdict(dict)
    for r in nodes.collect():
        got[r.host][r.node] = (r.pages, r.importance)
    for host, pages in sites.items():
        want = plain_tree(pages)
        assert want.keys() == got[host].keys()
        for node, (m, importance) in want.items():
            assert got[host][node] == (m, pytest.approx(importance, abs=1e-9))


def text_of(spark, pages):
    df = spark.createDataFrame([(k, "http://site.com/p", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in h.main_text(df).collect()}


def test_comments_and_adverts_inside_articles_go(spark):
    rng = random.Random(2)
    body = [[sentence(rng, 30) for _ in range(3)] for _ in range(8)]
    name = ["post-comments", "comment-list", "user-comments", "comments_area"]
    pages = [
        f'<article><p>{b[0]}</p><div class="ad-slot"><p>{sentence(rng, 9)}</p></div><p>{b[1]}</p>'
        f'<div id="{name[k % 4]}"><article class="comment"><p>{sentence(rng, 80)}</p></article><p>{sentence(rng, 70)}</p></div>'
        f"<p>{b[2]}</p></article>"
        for k, b in enumerate(body)
    ]
    got = text_of(spark, pages)
    assert all(got[k].text == "\n\n".join(b) for k, b in enumerate(body))


def test_compound_names_take_no_content(spark):
    rng = random.Random(3)
    a, b = sentence(rng, 30), sentence(rng, 30)
    pages = [
        f'<div class="comment-free has-comments"><div id="share-box"><article><p>{a}</p></article></div></div>',
        f'<div class="ad-supported"><p>{a}</p></div>',
        f'<section class="no-sidebar"><p>{a}</p><div class="sidebar-left"><p>{b}</p></div></section>',
        f'<div class="comment-list"><article class="comment"><p>{a}</p></article></div>',
    ]
    got = text_of(spark, pages)
    assert [got[k].text for k in range(4)] == [a] * 4


def test_the_tree_decides_where_names_tell_nothing(spark):
    """Menus, notices, rotating adverts and sign-up lines under names that say nothing, in and out of the article."""
    rng = random.Random(4)
    menu = "".join(f'<li><a href="/{k}">{sentence(rng, 1)}</a></li>' for k in range(6))
    notice, sign_up, credit = sentence(rng, 12), sentence(rng, 9), sentence(rng, 7)
    adverts = [sentence(rng, 10) for _ in range(3)]
    body = [[sentence(rng, rng.randint(15, 50)) for _ in range(rng.randint(2, 6))] for _ in range(40)]
    pages = [
        f'<div class="q1"><ul>{menu}</ul></div><div class="q2"><p>{notice}</p><div><p>{adverts[k % 3]}</p><p>{sign_up}</p>'
        f"</div></div><article><h1>{b[0]}</h1>" + "".join(f"<p>{x}</p>" for x in b[1:]) + f"<p>{sign_up}</p>"
        f'<div class="q3"><p>{credit}</p><p>{adverts[(k + 1) % 3]}</p></div></article><div class="q4"><p>{notice}</p></div>'
        for k, b in enumerate(body)
    ]
    got = text_of(spark, pages)
    assert all(got[k].text == "\n\n".join(b) for k, b in enumerate(body))
    by_tree, by_name = sum(r.by_tree for r in got.values()), sum(r.by_name for r in got.values())
    assert by_name == 40 * 6  # the links; all else goes by the tree
    assert by_tree == 40 * 7


def test_a_text_that_some_pages_share_stays(spark):
    rng = random.Random(5)
    shared = sentence(rng, 60)
    body = [[sentence(rng, 40) for _ in range(4)] + [shared] * (k % 3 == 0) for k in range(30)]
    pages = ["<article>" + "".join(f"<p>{x}</p>" for x in b) + "</article>" for b in body]
    got = text_of(spark, pages)
    assert all(got[k].text == "\n\n".join(b) for k, b in enumerate(body))
    assert sum(r.by_tree for r in got.values()) == 0
