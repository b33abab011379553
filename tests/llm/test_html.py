import html as entities
import math
import random

import pytest

from peakforge.llm import html

LONG = "A paragraph with enough words, commas, and full stops. It goes on for a while, as text does, to the end."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        (f"<body><article><h1>T</h1><p>{LONG}<p>a<b>b</b>c<br>d &amp; &eacute;&#8212;&#x41;</article><footer>Foot, note.</footer>", f"T {LONG} abc d & é—A"),
        (f"<div class=content><p>{LONG}</p><ul><li>x<li> y\n z</ul></div><aside><p>{LONG}</p></aside>", f"{LONG} x y z"),
        (f"<main><p>{LONG}</p><section class='reader comments'><p>{LONG} Nice.</p></section><form><p>{LONG}</p></form></main>", LONG),
        (f"<article><p>{LONG}<script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --></p><div role=alert>Warn!</div></article>", LONG),
        (f"<article><p title='a > b'>{LONG}</p><p>cut off <a hre", f"{LONG} cut off"),
        (f"<div id=cookie-notice><p>{LONG}</p></div><div><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_query_cases(spark):
    long = "<p>" + "word, " * 60000
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "x"), (None, None, None, "x"), (2, "u", long, "x"), (2, "u", long, "x"), (3, "u", "<<>>&&< p", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[:2] == [(0, 0), (1, len(LONG))]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == 5
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><article><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>x</li></ul></article><p>out</p>", f"T {LONG} {LONG} x"),
        (f"<main><h1>T</h1><div><p>{LONG}</p></div><div><p>short</p></div><section><table><tr><td>1<td>2</table></section><nav>no</nav></main>", f"T {LONG} short 1 2"),
        (f"<body><div><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><section><h2>S</h2><p>x</p></section></div><p>out</p>", f"T {LONG} {LONG} S x"),
        (f"<body><div><div><a href=x>Home</a> <a href=y>All topics</a></div><div><p>{LONG}</p><p>{LONG}</p></div></div>", f"{LONG} {LONG}"),
    ],
)
def test_nested_parts_of_the_content_stay(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><header class='entry-header'><h1><a href=x>Title</a></h1><p>By me</p></header><p>{LONG}</p></article>", f"Title {LONG}"),
        (f"<body><article class='post has-sidebar'><p>{LONG}</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul></article>", LONG),
        (f"<body><article><p>{LONG}</p><article class=comment><p>{LONG}</p></article></article>", LONG),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><span>x</span></div><table><tr><td>1</td></tr></table>", f"{LONG} {LONG}"),
    ],
)
def test_what_belongs_to_the_content(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("name", ["social-history", "notice-board", "side-effects", "skip-lists explained", "related-work", "red-alert-story", "header-files", "promotion-of-health"])
def test_content_under_names_that_sound_marked(name):
    """Full sentences stay, short lines and links under the same name go, and the plain names of parts go whatever they hold."""
    page = "<body><article><h1>T</h1><p>{0}</p><div class='{1}'>{2}</div><p>{0}</p></article></body>".format
    assert html.main_text(page(LONG, name, f"<p>{LONG}</p>")) == f"T {LONG} {LONG} {LONG}"
    assert html.main_text(page(LONG, name, "<p><a href=x>Share on this</a></p><p>Click</p>")) == f"T {LONG} {LONG}"
    for part in ("comments", "comment-list", "cookie-notice", "ad", "sidebar right"):
        assert html.main_text(page(LONG, part, f"<p>{LONG}</p>")) == f"T {LONG} {LONG}"


def test_scores_decide(monkeypatch):
    """On a page without article or main, and without any mark, other scores give another text."""
    page = f"<body><div><span>Home, sweet home.</span></div><section><h2>T</h2><p>{LONG}</p><p>{LONG}</p></section><div><table><tr><td>a<td>b</table></div>"
    assert html.main_text(page) == f"T {LONG} {LONG}"
    monkeypatch.setattr(html, "path_scores", lambda ratios: {k: float(k.endswith("td")) for k in ratios})
    assert html.main_text(page) == "a b"
    monkeypatch.setattr(html, "path_scores", lambda ratios: dict.fromkeys(ratios, 1.0))
    assert html.main_text(page) == f"Home, sweet home. T {LONG} {LONG} a b"


def _tree(rng, depth, inside):
    """A random page as nested (tag, class, children or text)."""
    if depth == 0 or rng.random() < 0.35:
        n = rng.choice([1, 3, 12, 40, 90])
        words = " ".join(rng.choice(["alpha", "beta,", "gamma.", "é&<", "x"]) for _ in range(n))
        return (rng.choice(["p", "p", "p", "h2", "pre"]), "", [(rng.random() < 0.15, words)])
    tag = rng.choice(["div", "section", "div", "nav", "aside", "article" if not inside else "div", "main" if not inside else "section"])
    mark = rng.choice(["", "", "", "", "comment", "body-text"])
    inside = inside or tag in ("article", "main")
    return (tag, mark, [_tree(rng, depth - 1, inside) for _ in range(rng.randint(1, 4))])


def _brute(tree):
    """The method in plain loops over the tree itself: no parser, no arrays."""
    blocks, ids = [], iter(range(1, 10**6))

    def walk(node, up, out):
        tag, mark, kids = node
        up = [*up, (tag, next(ids))]
        main = any(t in ("article", "main") for t, _ in up[:-1])
        out = out or tag in ("nav", "aside") or (mark == "comment" and (main or tag not in ("article", "main")))
        if tag in ("p", "h2", "pre"):
            link, words = kids[0]
            blocks.append({"path": ("!" if out else "") + "/".join(t for t, _ in up), "up": up, "text": words, "link": len(words) if link and tag != "h2" else 0, "out": out})
        else:
            for k in kids:
                walk(k, up, out)

    walk(("body", "", [tree]), [("html", 0)], False)
    paths = list(dict.fromkeys(b["path"] for b in blocks))
    of = {p: [b for b in blocks if b["path"] == p] for p in paths}
    counted = {p: 0 if p[0] == "!" else sum(len(b["text"]) - b["link"] for b in of[p]) for p in paths}
    stops = {p: 0 if p[0] == "!" else sum(b["text"].count(c) for b in of[p] for c in ".,;:!?") for p in paths}
    ratio = {p: (counted[p] / len(of[p]), stops[p] / len(of[p])) for p in paths}
    plain, score = [p for p in paths if p[0] != "!"], dict.fromkeys(paths, 0.0)
    k = math.exp(-2) / (1 + 2 * math.exp(-2))
    for i, p in enumerate(plain):
        near = plain[max(i - 1, 0)], plain[min(i + 1, len(plain) - 1)]
        a, b = ((1 - 2 * k) * ratio[p][j] + k * ratio[near[0]][j] + k * ratio[near[1]][j] for j in (0, 1))
        score[p] = a * (b + 0.1)
    some = [v for v in score.values() if v > 0]
    if not some:
        return ""
    mean = sum(some) / len(some)
    limit = min(mean, max(some) - math.sqrt(sum((v - mean) ** 2 for v in some) / len(some)))
    strong = [b for b in blocks if score[b["path"]] >= limit - 1e-9]
    total = sum(score[b["path"]] for b in strong)
    holders = None
    for tag in ("article", "main"):
        held = [b for b in strong if tag in [t for t, _ in b["up"]]]
        if held and 2 * sum(score[b["path"]] for b in held) >= total - 1e-9:
            holders = {next(n for t, n in b["up"] if t == tag) for b in held}
            break
    if holders is None:
        chain = [x for x in strong[0]["up"] if all(x in b["up"] for b in strong)]
        while len(chain) > 1 and chain[-1][0] in ("p", "h2", "pre"):
            chain.pop()
        while len(chain) > 1 and chain[-1][0] in ("div", "section") and chain[-2][0] in ("div", "section"):
            added = [b for b in blocks if chain[-2] in b["up"] and chain[-1] not in b["up"] and not b["out"]]
            if 2 * sum(b["link"] for b in added) > sum(len(b["text"]) for b in added):
                break
            chain.pop()
        holders = {chain[-1][1]}
    inside = [b for b in blocks if holders & {n for _, n in b["up"]}]
    best = max(score[b["path"]] for b in inside)
    share = {p: counted[p] / sum(len(b["text"]) for b in of[p]) for p in paths}
    return " ".join(b["text"] for b in inside if max(score[b["path"]], best * share[b["path"]]) >= limit - 1e-9)


def _source(node):
    tag, mark, kids = node
    if tag in ("p", "h2", "pre"):
        link, words = kids[0]
        words = entities.escape(words)
        return f"<{tag}>" + (f"<a href=x>{words}</a>" if link else words) + f"</{tag}>"
    return f"<{tag}" + (f" class={mark}" if mark else "") + ">" + "".join(map(_source, kids)) + f"</{tag}>"


def test_main_text_equals_brute_force():
    rng = random.Random(11)
    seen = set()
    for _ in range(400):
        tree = ("div", "", [_tree(rng, 4, False) for _ in range(rng.randint(1, 5))])
        want = _brute(tree)
        assert html.main_text(f"<html><body>{_source(tree)}</body></html>") == want
        seen.add(want)
    assert len(seen) > 300
