import html as h
import random
import re
import time

from voucherflow.llm.tagpaths import blocks, extract_main_text, main_text, op4_html_text

ARTICLE = "<p>A first paragraph, long enough to count; it has marks, and more. It goes on &amp; on.</p><p>Short.</p><p>A third one, again long, with commas, and a full stop at its end.</p>"
WANT = "A first paragraph, long enough to count; it has marks, and more. It goes on & on.\nShort.\nA third one, again long, with commas, and a full stop at its end."
NOISE = {
    "menu": "<nav><a href=/>Home</a></nav>", "header": "<header>Site, name. And more, of it.</header>", "footer": "<footer>&copy; all, rights. Reserved, too.</footer>",
    "sidebar": "<aside><p>Other, things, to read. And so on, at length.</p></aside>", "advert": '<div class="ad banner">Buy, this, now. It is cheap, and good.</div>', "notice": '<div id="cookie-notice">We use cookies, as all do. Agree, please.</div>',
    "form": "<form><label>Name, please.</label><input></form>", "script": "<script>var a = '<p>No, text. None, at all.</p>';</script>", "style": "<style>p{margin:0}</style>",
    "comments": '<section class="comments"><p>I like it, a lot. So long, a comment, to fool you all, it is.</p></section>', "list of links": "<div><a href=a>One</a> <a href=b>Two</a></div>", "comment": "<!-- <p>hidden, text. here</p> -->",
}


def test_noise_around_and_inside_an_article():
    for name, noise in NOISE.items():
        for page in (f"<html><head><title>T</title></head><body>{noise}<article>{ARTICLE}</article></body></html>", f"<body><article>{ARTICLE}</article>{noise}</body>", f"<body><div>{noise}</div><div class=content><div>{ARTICLE}</div></div>{noise}</body>"):
            assert main_text(page) == WANT, (name, page)
        if name not in ("header",):
            assert main_text(f"<main>{noise}{ARTICLE}{noise}</main>") == WANT, name


def test_blocks_and_references():
    assert main_text("<article>one<br>two <b>bold</b>\n\n three&nbsp;four &lt;p&gt; &#65;&#x42;</article>") == "one\ntwo bold three four <p> AB"
    assert main_text("<p>unclosed <b>bold<p>next &amp") == "unclosed bold\nnext &"
    assert main_text("plain 3 < 4 text") == "plain 3 < 4 text"
    assert main_text("<ul><li>First, item.<li>Second, item.</ul>") == "First, item.\nSecond, item."
    assert main_text("<article>a<div title='x > y'>b</div></article>") == "a\nb"
    assert main_text("") == main_text("<html></html>") == main_text("<script>x") == ""


def test_cut_off_anywhere_never_fails():
    page = f"<!DOCTYPE html><body>{''.join(NOISE.values())}<article>{ARTICLE}</article></body>"
    for i in range(0, len(page), 7):
        main_text(page[:i])


def test_whole_table_equals_a_plain_reading_of_the_articles(spark):
    """These pages hold one article element without noise in it, so splitting it at its tags is brute force."""
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op4_html_text(spark, sf).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", pages[r["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|br|h1)>", inside)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, None, ""), (2, "u", "<p>" + "word, " * 200_000 + "</p>"), (3, "u", "\x00<p>\U0001f600.</p>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    out = sorted((r["page_id"] or 0, r["text"][:6], r["n_chars"]) for r in extract_main_text(df).collect())
    assert out == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "word, ", 1_199_999), (3, "\x00\n\U0001f600.", 4)]
    assert extract_main_text(df.limit(0)).count() == 0


def test_hidden_counts_as_an_attribute_only():
    for attributes in ('style="overflow: hidden"', 'title="the hidden truth"', "data-x='a hidden b'", 'title="a class=advert b"'):
        assert main_text(f"<body {attributes}><article {attributes}>{ARTICLE}</article></body>") == WANT
    assert main_text(f"<html hidden><body hidden aria-hidden=true><article>{ARTICLE}</article></body>") == WANT
    assert main_text(f"<body><div hidden><p>No, text. None, at all.</p></div><article>{ARTICLE}</article></body>") == WANT
    assert main_text(f"<body><div title=x hidden=''><p>No, text. None, at all.</p></div><article>{ARTICLE}</article></body>") == WANT


def test_only_links_with_a_target_count_as_links():
    body = ARTICLE.replace("<p>", "<p>{0}")
    for anchor in ('<a id="s1"/>', '<a name="top">', "<a name=top></a>", '<a href="#x"/>'):
        assert main_text(f"<body><div>{body.replace('{0}', anchor)}</div></body>") == WANT, anchor
    # an unclosed link ends with its block
    assert main_text(f"<body><div><p>Read this, please. <a href=x>More</p>{ARTICLE}</div></body>") == f"Read this, please. More\n{WANT}"
    # one around blocks goes on to its end tag
    shares = [s for _, _, _, s in blocks("<a href=x><p>one</p><p>two</p></a><p>three</p>")]
    assert shares == [1, 1, 0]


PARAGRAPHS = [
    "The first paragraph is long, it has commas, and full stops. More of it follows here, to be sure.", "Second one: again long, with commas, and it goes on for a while, as these do. Right.", "Short one.",
    "A third of good length, with marks; and more, and more. It ends here.", "Fifth, and last: long enough, with commas, to count as prose. The end.",
]
PLAIN = "\n".join(PARAGRAPHS)
LINKS, RIGHTS, REMARK = "<div><a href=1>Home</a> <a href=2>News</a></div>", "<div>Copyright 2024 Example Inc.</div>", "<div>Nice article, thanks!</div>"


def _page(middle):
    return f"<html><body>{LINKS}{middle}{RIGHTS}{REMARK}</body></html>"


def test_pages_without_article_main_or_class_names():
    each = lambda a, b: "".join(f"{a}{x}{b}" for x in PARAGRAPHS)
    for middle in (each("<div><p>", "</p></div>"), each("<div>", "</div>"), f"<div>{each('<p>', '</p>')}</div>", each("<p>", "</p>"), f"<div><div>{each('<p>', '</p>')}</div></div>"):
        assert main_text(_page(middle)) == PLAIN, middle
    points = "<ul><li>A point</li><li>Another</li></ul>"
    assert main_text(_page(f"<div><h1>A title</h1>{each('<p>', '</p>')}{points}</div>")) == f"A title\n{PLAIN}\nA point\nAnother"
    table = f"<table><tr><td><ul><li>Weather<li>Sport today<li>More of it</ul></td><td>{each('<p>', '</p>')}{points}</td></tr></table>"
    assert main_text(f"<body>{table}</body>") == f"{PLAIN}\nA point\nAnother"


def test_a_form_around_the_page_is_no_form():
    inner = f"{LINKS}<div>{''.join(f'<p>{x}</p>' for x in PARAGRAPHS)}</div>{RIGHTS}"
    assert main_text(f"<body><form action=x>{inner}</form></body>") == PLAIN
    assert main_text(f"<body><form><article>{ARTICLE}</article></form></body>") == WANT
    assert main_text("<body><form><label>Name, please.</label> <label>Word</label></form></body>") == ""


def test_inline_elements_do_not_part_a_paragraph():
    assert main_text("<article><p>Let <math><mi>x</mi> &lt; 3</math> be, <script>var a</script>and <button>no</button><span hidden>no</span>so <object>on</object>.</p></article>") == "Let x < 3 be, and so on."
    assert main_text("<article><p>&#99999999999999; &#x110000; &nosuch;</p></article>") == "� � &nosuch;"


def test_hostile_pages_take_linear_time():
    n = 100_000
    pages = [
        "<a " * 300_000, "<div>a" * n, '<a href="x> ' * n, "<a b='" * n, "<article>" + "<span>" * n + "</div>" * n, "<!--" * n, "<" * n, "<p " + "a=b " * n + ">x</p>", "<p>&#" + "9" * 10_000 + ";x</p>",
        "<ul><li>a" * n, "<script>" * n, "<div><article>" + "<i>" * n + "</div>" * n, "<a href=x>y " * n, "</ " * n, "<p>a<b>" * n, "<form><div>abc" * n, "<td><tr><table>a" * n,
        "<div>" + "<p>Some prose, with marks, of a fair length.</p>" * 9 + "<ul><li>a" * n + "</div>",
    ]
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 2, page[:20]


def test_random_pages_give_the_text_that_was_put_in():
    """Pages made from a known article and known surroundings, in varied markup: the article must come back whole and alone."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([", ", "; "]) + word() + "."
    for _ in range(150):
        paragraphs = [" ".join(sentence(rng.randint(6, 14)) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(4, 12))]
        paragraphs.insert(rng.randint(1, len(paragraphs) - 1), sentence(2))
        title = sentence(3)
        open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div class=post>", "</div>"), ("<section><div>", "</div></section>"), ("<table><tr><td>", "</td></tr></table>")])
        body = f"<h1>{title}</h1>" + "".join(f"<p>{x}" + rng.choice(["</p>", "\n", "</p>\n"]) for x in paragraphs)
        menu = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(rng.randint(3, 9)))
        around = [f"<nav><ul>{menu}</ul></nav>", f"<ul>{menu}</ul>", f'<div class="ad">{sentence(4)}</div>', f"<aside><p>{sentence(12)}</p></aside>", f"<script>var x = '<p>{word()}</p>';</script>", f"<!-- {word()} -->", f"<form><input name=q>{word()}</form>"]
        after = [f"<footer>&copy; {word()}</footer>", f'<div id="comments"><p>{sentence(14)}</p><p>{sentence(9)}</p></div>', f"<div>{word()} {word()}</div>"]
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(rng.sample(around, 4)) + open_ + body + close + "".join(rng.sample(after, 2)) + rng.choice(["</body></html>", ""])
        assert main_text(page) == "\n".join([title, *paragraphs]), page
