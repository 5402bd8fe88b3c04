import random
import time

from plumbline.llm.html_text import BAD, GOOD, UNDECIDED, blocks, first_label, html_extract, kept_blocks, main_text, nearest

STOPPY = "This is the story of a man who was in the house with all of his friends and it was for the good of them that he came to stay."


def test_article_blocks_stay_and_the_rest_goes():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies. {STOPPY}</div><!-- <p>comment</p> -->
    <article><header><h1>A &amp; B</h1></header><p>One   two<br>three</p><p>Ok.<p><b>Unclosed <i>bold</i></p>
    <aside>{STOPPY}</aside><form><p>{STOPPY}</p></form><div class="share-buttons">Share this</div><p>caf&eacute; &#x1F600; &lt;tag&gt;</p>
    <section id="comments"><p>{STOPPY}</p></section></article>
    <div id=sidebar>{STOPPY}</div><footer>&copy; {STOPPY}</footer></body></html>"""
    assert main_text(page) == "A & B\nOne two three\nOk.\nUnclosed bold\ncafé \U0001f600 <tag>"


def test_pages_without_an_article_element_use_densities():
    page = f"<body><div><a href=/a>one</a> <a href=/b>two</a> <a href=/c>three</a></div><div>{STOPPY}</div><div>Short.</div><div>{STOPPY * 2}</div><div class=footer>x</div></body>"
    assert main_text(page) == f"{STOPPY}\nShort.\n{STOPPY * 2}"


def test_plain_and_broken_input():
    assert main_text(None) == "" and main_text("") == "" and main_text("  ") == ""
    assert main_text("just  text &amp; more") == "just text & more"
    assert main_text("<p>a < b and <") .startswith("a < b")
    assert main_text("<article><p>cut off <a href='x") == "cut off"
    assert main_text("<script>never closed <p>x") == ""
    assert len(main_text("<article>" + f"<p>{STOPPY}</p>" * 5000 + "</article>")) == 5000 * (len(STOPPY) + 1) - 1


def test_second_pass_inherits_from_the_nearest():
    assert nearest([GOOD, UNDECIDED, UNDECIDED, UNDECIDED, BAD], BAD) == [GOOD, GOOD, BAD, BAD, BAD]
    assert nearest([UNDECIDED, GOOD], BAD) == [GOOD, GOOD]
    assert nearest([UNDECIDED], BAD) == [BAD] and nearest([], BAD) == []


def test_structure_rejects_by_whole_names_and_never_accepts():
    for name in ("ad", "cookie-notice", "site-footer", "share_buttons", "relatedPosts", "comment-list", "comment body", "sidebar right"):
        assert main_text(f"<p>{STOPPY}</p><div class='{name}'><p>{STOPPY}</p></div>") == STOPPY, name
    for name in ("search-results-analysis", "badge", "header-less", "shareholder", "main has-sidebar", "article-body", "adventure"):
        assert main_text(f"<p>{STOPPY}</p><div class='{name}'><p>{STOPPY}</p></div>") == f"{STOPPY}\n{STOPPY}", name
    links = "".join(f"<li><a href=/{i}>Another story number {i}</a></li>" for i in range(9))
    assert main_text(f"<article><p>{STOPPY}</p><ul>{links}</ul><p>{STOPPY}</p></article>") == f"{STOPPY}\n{STOPPY}"
    assert main_text("<article><div class='article-header'><h1>T</h1></div><p>x</p></article>") == "T\nx"


def test_inline_parts_end_by_depth_and_with_their_block():
    assert main_text('<p>Body<span class="ad"><span>buy</span> now cheap</span> More') == "Body More"
    assert main_text('<p>Body<span class="ad">buy <p>More') == "Body\nMore"
    assert main_text("<main><p>a</p><article><p>b</p></article><p>c</p></main>") == "a\nb\nc"
    began = time.process_time()
    main_text("<p>" + "<span class=ad>x " * 40_000)
    assert time.process_time() - began < 3


def test_links_that_are_headings_or_paragraphs_of_the_article_stay():
    page = f"<nav><p><a href=/>Home</a></p></nav><article><h1><a href=/x>The title</a></h1><p>{STOPPY}</p><p><a href=/y>All of it</a></p><table><tr><td>1<td>2</table><p>{STOPPY}</p><ul><li><a href=/z>Another story</a></li></ul></article>"
    assert main_text(page) == f"The title\n{STOPPY}\nAll of it\n1\n2\n{STOPPY}"


def test_stray_end_tags_are_passed_over():
    began = time.process_time()
    assert main_text("<div>" * 50_000 + "</p>" * 100_000 + STOPPY) == STOPPY
    assert main_text("<div>" * 50_000 + "</section></div>" * 50_000 + f"<p>{STOPPY}") == STOPPY
    assert time.process_time() - began < 6


def plain_kept(specs):
    """The rules in plain loops over (words, stop words, linked characters, rejected, region)."""

    def alone(text, stop, linked):
        n = len(text)
        if linked > 0.4 * n:
            return "bad"
        share = stop / len(text.split())
        if n >= 140:
            return "good" if share >= 0.08 else "bad" if linked > 0.1 * n else "?"
        return "good" if n >= 60 and share >= 0.25 else "?"

    first = [alone(t, s, linked) for t, s, linked, _, _ in specs]
    out = [x[3] for x in specs]
    if not any(f == "good" and not o for f, o in zip(first, out)):
        return [not o and linked <= 0.4 * len(t) for (t, _, linked, _, _), o in zip(specs, out)]

    def look(i, places, labels, otherwise):
        if labels[i] != "?":
            return labels[i]
        at, best = places.index(i), {}
        for k, j in enumerate(places):
            if labels[j] != "?":
                best.setdefault(abs(k - at), []).append(labels[j])
        return ("bad" if "bad" in best[min(best)] else "good") if best else otherwise

    labels = ["bad" if o else f for f, o in zip(first, out)]
    once = list(labels)
    for i, spec in enumerate(specs):
        if spec[4] and not out[i]:
            once[i] = look(i, [j for j, x in enumerate(specs) if x[4] == spec[4] and not out[j]], labels, "?")
    return [look(i, list(range(len(specs))), once, "bad") == "good" for i in range(len(specs))]


def test_passes_agree_with_plain_loops():
    rng, first_pass = random.Random(5), {GOOD: 0, BAD: 0, UNDECIDED: 0}
    for _ in range(600):
        html, specs, region, regions, wrap = [], [], 0, 0, rng.random() < 0.6
        for _ in range(rng.randint(1, 14)):
            if wrap and not region and rng.random() < 0.4:
                html.append("<article>")
                regions, region = regions + 1, regions + 1
            elif region and rng.random() < 0.2:
                html.append("</article>")
                region = 0
            n = rng.choice([2, 5, 12, 40])
            words = [rng.choice(["the", "of", "and"]) if rng.random() < p else rng.choice(["kalo", "mirate", "sostenu"]) for p in [rng.choice([0, 0.05, 0.3, 0.6])] for _ in range(n)]
            k = rng.choice([0, 0, n // 6, n // 2, n])
            linked = " ".join(words[:k])
            text = (f"<a href=/x>{linked}</a> " if k else "") + " ".join(words[k:])
            rejected = rng.random() < 0.15
            html.append(f"<div class=ad>{text}</div>" if rejected else f"<div>{text}</div>")
            specs.append((" ".join(words), sum(w in ("the", "of", "and") for w in words), len(linked), rejected, region))
        found = blocks("<body>" + "".join(html))
        assert [(b.text, b.linked, b.rejected, b.region) for b in found] == [(t, linked, out, r) for t, _, linked, out, r in specs]
        assert kept_blocks(found) == plain_kept(specs)
        for b in found:
            first_pass[first_label(b)] += not b.rejected
    assert min(first_pass.values()) > 300


def test_densities_and_neighbours_decide_the_given_pages(spark):
    kept, by = 0, {GOOD: 0, BAD: 0, UNDECIDED: 0}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        found = blocks(r.html or "")
        for b, keep in zip(found, kept_blocks(found)):
            kept += keep
            by[first_label(b)] += keep
    assert by[BAD] == 0 and by[GOOD] > 0.4 * kept and by[UNDECIDED] > 0.1 * kept


def test_frame(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "mine", None), (None, None, None, None, 2**60 + 1), (1, "u", "<article><p>x</p></article>", "mine", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Text string, big long")
    got = sorted((str(r.page_id), r.text, r.n_chars, str(r.big)) for r in html_extract(df).collect())
    assert got == [("1", "x", 1, "3"), ("1", "x", 1, "None"), ("None", "", 0, str(2**60 + 1))]
    assert html_extract(df.limit(0)).count() == 0
