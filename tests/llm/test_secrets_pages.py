"""Secrets and main text."""

import hashlib
import math
import random
import re
import string
import time

import pytest

from curate.llm import html_text, secret_scan
from curate.llm.secret_scan import KINDS, Automaton, Format, FormatModel, all_spans, base_spans, mask

HEX = "0641917ea4e9feb9cda83477b57ac2654884f485"


def named(text):
    return [(KINDS[k], s, e) for s, k, e, _ in base_spans(text)]


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("", []),
        ('token = "%s"' % HEX, [("assign", 0, 49), ("hex", 9, 49)]),
        ("é PassWord:abcdef", [("assign", 2, 17)]),
        ("password=abcde", []),
        ("api_key = 'x.y-z_1' apikey=123456", [("assign", 0, 18), ("assign", 20, 33)]),
        ("paſſword=abcdefg", []),
        ("AKIA" + "A" * 15, []),
        ("xAKIA" + "B2" * 8, [("access", 1, 21)]),
        ("f" * 23 + "g" + "0" * 24, [("hex", 24, 48)]),
        ("secret=token=abcdef", [("assign", 0, 19)]),
    ],
)
def test_base_spans(text, spans):
    assert named(text) == spans


def test_automaton_is_a_distribution_of_its_examples():
    examples = ["ab" * n for n in range(1, 30)] * 4
    automaton = Automaton(examples)
    assert len(automaton.states) < 12
    assert automaton.score("abababab") > automaton.score("babababa") + 2
    for end, steps in automaton.states:
        assert 0.9 < 2**end + sum(2**p for p, _ in steps.values()) < 1.2


def model():
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(200)]
    automaton = Automaton(keys[:160])
    lengths = {secret_scan.length_cell(40): 0.0}
    known = Format("hex", automaton, lengths)
    return FormatModel([Format("hex", automaton, lengths, sorted(known.score(k) for k in keys[160:])[2])])


def test_candidates_of_a_known_format_are_added_and_others_left():
    known = model()
    other = "0641917EA4E9FEB9CDA83477B57AC2654884F485"
    text = f"see {HEX} and {other} and the-very-long-hyphenated-word-2 here"
    assert [(k, s) for s, k, _ in all_spans(text, known)] == [(2, 4)]
    # the same signs where the pattern doesn't reach: a run that is wider than the pattern's own match
    assert all_spans("nothing of the kind", known) == []
    assert mask(f"a {HEX} b token={HEX} c", known) == "a [SECRET] b [SECRET] c"
    assert mask(None, known) is None and mask("", known) == ""


def test_formats_are_learned_and_rows_kept(spark):
    rows = [(i, f"key {hashlib.sha1(str(i).encode()).hexdigest()} end", "x") for i in range(60)] + [(None, None, "x"), (3, "", "x"), (4, "word " * 50000 + "password=hunter22", "x"), (4, "AKIA" + "Q" * 16, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    learned = secret_scan.learn_formats(docs)
    assert sorted(f.kind for f in learned.formats) == ["access", "assign", "hex"]
    got = secret_scan.digest(docs, learned).collect()
    assert len(got) == len(rows)
    assert sum(r.n_hex for r in got) == 60 and sum(r.n_assign for r in got) == 1 and sum(r.n_access for r in got) == 1
    blank = next(r for r in got if r.doc_id is None)
    assert (blank.spans, blank.base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    span = next(r for r in got if r.doc_id == 0)
    assert span.spans == "hex:4:44" and span.base_sha256 == hashlib.sha256(b"hex:4:44").hexdigest()
    none = spark.createDataFrame([], docs.schema)
    assert secret_scan.digest(none, secret_scan.learn_formats(none)).count() == 0


def test_thresholds_and_lengths_come_from_all_credentials(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(120)]
    long = "".join(keys[:8])
    texts = [f"key {key} end" for key in keys] + [f"key {long} end"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    [known] = secret_scan.learn_formats(docs, per_kind=25).formats
    assert known.kind == "hex" and set(known.lengths) == {secret_scan.length_cell(n) for n in (40, 320)}
    assert known.lengths[secret_scan.length_cell(40)] == pytest.approx(math.log2(120 / 121))
    # by 95 percent of all hundred that it wasn't fitted on, not of five
    scores = sorted(known.score(v) for v in [*keys, long])
    assert scores[0] - 1e-4 <= known.least <= scores[12]
    assert 0.93 <= sum(s >= known.least for s in scores) / len(scores) <= 0.98
    # a candidate of more than 256 signs has the format too
    assert FormatModel([known]).matches("".join(keys[30:37]))


def test_a_kind_of_long_credentials_is_learned(spark):
    longs = ["".join(hashlib.sha1(f"{i}-{j}".encode()).hexdigest() for j in range(8)) for i in range(30)]
    docs = spark.createDataFrame([(i, f"key {v} end") for i, v in enumerate(longs)], "doc_id long, text string")
    [known] = secret_scan.learn_formats(docs).formats
    assert known.kind == "hex" and set(known.lengths) == {secret_scan.length_cell(320)} and sum(known.score(v) >= known.least for v in longs) >= 28


def credential(i, prefix="ghp_", n=36):
    draw = random.Random(i)
    return prefix + "".join(draw.choice(string.ascii_letters + string.digits) for _ in range(n))


@pytest.mark.parametrize("n_known", [8, 15, 600])
def test_planted_credentials_outside_of_the_patterns_are_found(spark, n_known):
    known = [(i, f"see token={credential(i)} here") for i in range(n_known)]
    planted = [(10_000 + i, f"a line with {credential(10_000 + i)} in it") for i in range(200)]
    decoys = ["550e8400-e29b-41d4-a716-446655440000", "how-to-install-python-3-on-a-server", "com/example/project/v2/src/main", "ABCDEFGHIJKLMNOPQRST1234", "2024-01-01-release-notes-of-all", "x" * 30 + "1", "images/photos/2024/summer/img_20240612_a"]
    clean = [(20_000 + i, f"{d} and so on") for i, d in enumerate(decoys)]
    docs = spark.createDataFrame(known + planted + clean, "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in secret_scan.digest(docs, secret_scan.learn_formats(docs)).collect()}
    hits = [i for i, text in planted if rows[i] == f"format:12:{12 + 40}"]
    assert len(hits) >= 0.9 * len(planted) * (1 if n_known > 20 else 0.5)
    assert [rows[i] for i, _ in clean] == [""] * len(clean)
    assert all(rows[i].startswith("assign:4:50") for i, _ in known)


def test_spans_of_a_text_of_keys_are_those_of_plain_loops():
    known = model()
    draw = random.Random(4)
    parts = [hashlib.sha1(b"%d" % i).hexdigest() for i in range(300)]
    shapes = ["{0}", "token={0}", "x {0}G{1}", "AKIA{2}", "{0}/{1}", "password: short", "secret='{0}' {1}-", "plain words"]
    text = "\n".join(draw.choice(shapes).format(p, draw.choice(parts), "Q" * 20) for p in parts)
    base = [(s, k, e) for s, k, e, _ in base_spans(text)]
    want = list(base)
    for m in secret_scan.CANDIDATE.finditer(text):
        apart = all(e <= m.start() or m.end() <= s for s, _, e in base)
        if apart and re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and known.matches(m.group()):
            want.append((m.start(), 3, m.end()))
    assert all_spans(text, known) == sorted(want)


def test_a_long_dump_of_keys_takes_time_in_proportion():
    known, line = model(), "token=%s and 0641917EA4E9FEB9CDA83477B57AC2654884F485\n"
    text = "".join(line % hashlib.sha1(b"%d" % i).hexdigest() for i in range(20_000))
    start = time.perf_counter()
    assert len(all_spans(text, known)) == 40_000
    assert time.perf_counter() - start < 20


ARTICLE = "<article><h1>A  title</h1><p><b>First &amp; best<br>line.<p>Second &lt;b&gt;.</p>%s</article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p></p><script>var t='<p>x</p>'</script>", ""),
        ("plain words only", "plain words only"),
        (
            "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><!-- x --><div class='ad'>Buy this now, it is good.</div>"
            + ARTICLE % ""
            + "<aside>More of it</aside><footer>&copy; x</footer></body></html>",
            "A title\n\nFirst & best line.\n\nSecond <b>.",
        ),
        (ARTICLE % "<div class='notice'>Cookies!</div><form><p>Name</p></form><section class='comments'><p>Nice one</p></section>", "A title\n\nFirst & best line.\n\nSecond <b>."),
        (ARTICLE % "<p class='notice'>Read this!<div>Unclosed.</div><div id='commentList'>I agree.</div><span style='display: none'>x</span>", "A title\n\nFirst & best line.\n\nSecond <b>.\n\nUnclosed."),
        (ARTICLE % "<h2 class='header'>More</h2><p>It <i>goes</i> on<sup>2</sup>.<ul><li>one<li>two</ul>", "A title\n\nFirst & best line.\n\nSecond <b>.\n\nMore\n\nIt goes on2.\n\none\n\ntwo"),
        (ARTICLE % "<div><p>Short.</p></div>", "A title\n\nFirst & best line.\n\nSecond <b>.\n\nShort."),
        (
            "<body><div id='top'><a href='/a'>Home</a> <a href='/b'>News</a></div><div id='content'><p>" + "Many words of content stand here. " * 9 + "</p><div><p>" + "And more of them follow. " * 9 + "</p></div><p>End.</p></div><div id='x'><a href='/c'>Other things to read</a></div></body>",
            ("Many words of content stand here. " * 9).strip() + "\n\n" + ("And more of them follow. " * 9).strip() + "\n\nEnd.",
        ),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


FIRST, SECOND = ("The first part holds its words. " * 13).strip(), ("A second has fewer. " * 11).strip()


@pytest.mark.parametrize(
    "html",
    [
        f"<main><p>{FIRST}</p><p>{SECOND}</p></main><article><h2>Teaser</h2><p><a href='/x'>Read on</a></p></article>",
        f"<body><div><p>{FIRST}</p><p>{SECOND}</p></div><article><p>Teaser</p></article></body>",
        f"<body><article><p>Teaser</p></article><div><p>{FIRST}</p><p>{SECOND}</p></div></body>",
    ],
)
def test_ratios_decide_on_pages_with_an_article(html):
    assert html_text.main_text(html) == f"{FIRST}\n\n{SECOND}"


@pytest.mark.parametrize(
    "html",
    [
        f"<main><section><p>{FIRST}</p></section><section><p>{SECOND}</p></section></main>",
        f"<body><div><a href='/a'>Home page</a> <a href='/b'>News</a></div><div><div><p>{FIRST}</p></div><div><p>{SECOND}</p></div></div></body>",
        f"<main><p>{FIRST}</p><article><p>{SECOND}</p></article></main>",
    ],
)
def test_all_content_regions_are_returned(html):
    assert 0.6 < len(FIRST) / len(FIRST + SECOND) < 0.67
    assert html_text.main_text(html) == f"{FIRST}\n\n{SECOND}"


WRAPPED = f"<article><h1>A title</h1><p>{FIRST}</p><p>{SECOND}</p></article>"
WHOLE = f"A title\n\n{FIRST}\n\n{SECOND}"
MENU = "<nav><ul><li><a href='/'>Menu</a></li></ul>"


@pytest.mark.parametrize(
    "html",
    [
        f'<div class="content has-sidebar">{WRAPPED}</div>',
        f'<div id="page" class="no-sidebar">{WRAPPED}</div>',
        f'<div class="sidebar-right menu-open">{WRAPPED}<div class="sidebar"><p>Other things.</p></div></div>',
        f'<section id="social-science">{WRAPPED}</section>',
        WRAPPED.replace("<article>", '<article class="post has-comments">'),
        WRAPPED.replace("<h1>A title</h1>", "<header><h1>A title</h1><p>By somebody</p></header>"),
        f"{MENU}<main>{WRAPPED}</main>",
        f"<form action='/post'><input name='state'>{WRAPPED}</form>",
        f"<body>{WRAPPED}<div class='post-comments'><article class='comment'><p>{FIRST}</p></article></div></body>",
    ],
)
def test_wrappers_do_not_take_the_article_with_them(html):
    assert html_text.main_text(html) == WHOLE


def test_most_of_the_text_is_no_sidebar_and_comments_are_none_of_it():
    assert html_text.main_text(f"<body><div class='main-banner'><h1>A title</h1><p>{FIRST}</p><p>{SECOND}</p></div></body>") == WHOLE
    assert html_text.main_text(f"<body><div><p>{SECOND}</p></div><div id='comments'><p>{FIRST}</p><p>{FIRST}</p></div></body>") == SECOND


def test_a_short_section_stays_beside_a_long_one():
    html = f"<main><section><p>{FIRST}</p><p>{SECOND}</p></section><section><h2>End</h2><p>Short end.</p></section></main>"
    assert html_text.main_text(html) == f"{FIRST}\n\n{SECOND}\n\nEnd\n\nShort end."


def test_clusters_tell_unmarked_boilerplate_from_content(monkeypatch):
    links = " ".join(f"<a href='/{i}'>Page {i}</a>" for i in range(9))
    html = f"<body><div>{links}</div><div><p>{FIRST}</p><p>{SECOND}</p></div>"
    html += "".join(f"<div><span>Short</span> <b>words</b> <i>{i}</i></div>" for i in range(6)) + "</body>"
    assert "words 5" not in html_text.main_text(html) and html_text.main_text(html).startswith(f"{FIRST}\n\n{SECOND}")
    monkeypatch.setattr(html_text, "threshold", lambda values: 0.0)
    assert html_text.main_text(html).endswith("Short words 5")


def plain_choice(blocks):
    """Ratios, smoothing and two clusters one by one: the blocks (text, tags, linked) above the border."""
    import math

    ratios = [math.sqrt((len(t) - linked) / max(1, tags)) for t, tags, linked in blocks]
    soft = []
    for i in range(len(ratios)):
        weights = {j: math.exp(-((i - j) ** 2) / 2) for j in range(len(ratios)) if abs(i - j) <= 3}
        soft.append(sum(w * ratios[j] for j, w in weights.items()) / sum(weights.values()))
    centre = max(soft)
    for _ in range(31):
        near = [v for v in soft if abs(v - centre) <= abs(v)]
        centre = sum(near) / len(near)
    return [t for (t, _, linked), v in zip(blocks, soft, strict=True) if abs(v - centre) <= abs(v) and 2 * linked <= len(t)]


def test_pages_of_loose_blocks_against_plain_clusters():
    import random

    draw = random.Random(6)
    for _ in range(200):
        blocks, html = [], ""
        for k in range(draw.randint(1, 12)):
            words = " ".join(f"w{draw.randint(0, 99)}" for _ in range(draw.choice([1, 2, 30, 60])))
            linked, bold = draw.random() < 0.3, draw.randint(0, 4)
            inner = f"<a href='/'>{words}</a>" if linked else words
            html += f"<div>{'<b></b>' * bold}{inner}</div>"
            # a block's own two tags, and those inside
            blocks.append((words, 2 + 2 * bold + (2 if linked else 0), len(words) if linked else 0))
        assert html_text.main_text(html).split("\n\n") == (plain_choice(blocks) or [""])


def test_smoothing_and_threshold():
    assert html_text.smooth([1.0, 1.0, 1.0]) == pytest.approx([1, 1, 1])
    assert 2 < html_text.threshold([1, 1.5, 1, 9, 10, 9.5]) < 9


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", ARTICLE % "", "x"), (None, None, None, "x"), (1, "u", ARTICLE % "", "x"), (2, "v", "<p>" + "long text " * 100000, "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(len(r.text) == r.n_chars for r in got)
    assert max(r.n_chars for r in got) == len("long text " * 100000) - 1
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
