"""Main text of web pages: parser events make lines, text-to-tag ratios tell content from the rest.

The standard library's parser streams events. Every block is a line with its text, its number of tags, the share of
its text inside links, and its region (the nearest sectioning element; an article is one region). Menus, headers, footers and
sidebars are left out by their element. What a class, an id or a form marks (sidebars, notices, adverts, comments) is left
out as well, unless it turns out to be a wrapper: it holds an article or a main part or, where there is none, most of the
page's text. The text-to-tag ratios of the remaining lines are smoothed by a Gaussian in page order and split into two
clusters, on all pages alike: an article or a main part only ends the smoothing at its borders. Content is what
the regions with a line above the threshold hold, with the regions inside them; where content regions nest, those
inside without such a line are left out if most of their text is links.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.common import whole_texts
from curate.llm.words import text_batches

# Elements by what they do.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option textarea button datalist dialog".split())
BOILERPLATE = frozenset("nav header footer aside form menu".split())
REGIONS = frozenset("article main section div body td".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = {"main": 1, "article": 2}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words that mark an element if they are the first or the last of a name such as site-footer or nav-menu.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login share disqus widget toolbar pager pagination".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
# Words that mark only alone or before one of the second kind: social-links, but not social-science.
LOOSE = frozenset("social side related recommended sharing skip".split())
BESIDE = frozenset("bar box buttons column content icons items links link list media menu nav navigation articles posts stories widget".split())
# A name that begins so, or holds "with", says what is around or missing, not what it is.
ABOUT = frozenset("has no not without with is hide show".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# A heading or the page itself is no boilerplate, whatever its class.
NEVER_MARKED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
SIGMA = 1.0


def marks(names: str) -> tuple[bool, bool]:
    """Whether the names of an element (class and id) mark it as boilerplate, and whether as comments."""
    boilerplate = comments = False
    for name in CAMEL.sub("-", names).lower().split():
        words = [w for w in re.split("[-_]+", name) if w]
        if not words or words[0] in ABOUT or "with" in words:
            continue
        ends = {words[0], words[-1]}
        comments |= bool(ends & COMMENTS)
        loose = words[0] in LOOSE and (len(words) == 1 or words[1] in BESIDE)
        boilerplate |= loose or bool(ends & MARKS)
    return boilerplate, comments


class Lines(HTMLParser):
    """Collects blocks as (text, tags, linked characters, region, content, part, marked elements).

    Content is 2 in an article, 1 in the main part. The part is the region of the outermost of these elements, or 0.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # name, left out, region, content, part, marked elements around
        self.open: list[tuple[str, bool, int, int, int, tuple[int, ...]]] = []
        self.parents = [0]
        self.kinds = ["page"]
        # of every marked element, whether an article or a main part stands in it
        self.holds: list[bool] = []
        self.has_content = False
        self.comments: list[bool] = []
        self.lines: list[tuple[str, int, int, int, int, int, tuple[int, ...]]] = []
        self.words: list[str] = []
        self.tags = 0
        self.linked = 0
        self.in_link = 0

    def _state(self) -> tuple[bool, int, int, int, tuple[int, ...]]:
        return self.open[-1][1:] if self.open else (False, 0, 0, 0, ())

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        hidden, region, content, part, marked = self._state()
        if text and not hidden:
            self.lines.append((text, self.tags, min(self.linked, len(text)), region, content, part, marked))
        self.words, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.words.append("\n")
        if tag in VOID:
            return
        if tag in BLOCKS:
            # a block ends the paragraph before it, whether that was closed or not
            self._close("p")
        if tag == "main":
            # the main part of a page stands in no menu: one that is open was not closed
            for name in ("nav", "aside", "menu"):
                if any(o[0] == name for o in self.open):
                    self._close(name)
        if tag == "a":
            self.in_link += 1
        hidden, region, content, part, marked = self._state()
        values = dict(attrs)
        left_out = (
            tag in HIDDEN
            or tag in BOILERPLATE
            or "hidden" in values
            or values.get("aria-hidden") == "true"
            or (values.get("role") or "") in ROLES
            or bool(UNSEEN.search(values.get("style") or ""))
        )
        if tag in HEADINGS and hidden and not left_out and content and self._only_own_header():
            # an article's header holds its title
            hidden = False
        boilerplate = comments = False
        if tag not in NEVER_MARKED:
            boilerplate, comments = marks(f"{values.get('class') or ''} {values.get('id') or ''}")
        if tag in CONTENT:
            boilerplate = False
            left_out |= comments
        if tag == "form":
            # many pages are one form
            left_out, boilerplate = hidden, True
        if boilerplate or comments:
            marked = (*marked, len(self.holds))
            self.holds.append(False)
            self.comments.append(comments)
        # an article is one region, whatever stands in it
        if tag in REGIONS and content < 2:
            self.parents.append(region)
            self.kinds.append(tag)
            region = len(self.parents) - 1
        if tag in CONTENT:
            part = part or region
            if not (hidden or left_out):
                self.has_content = True
                for i in marked:
                    self.holds[i] = True
        self.open.append((tag, hidden or left_out, region, max(content, CONTENT.get(tag, 0)), part, marked))

    def _only_own_header(self) -> bool:
        """Whether what is left out here is so because of the header of an article or a main part, and nothing else."""
        shown = [o for o in self.open if not o[1]]
        inner = self.open[len(shown) :]
        return bool(shown) and bool(inner) and inner[0][0] == "header" and shown[-1][3] > 0 and not any(o[0] in HIDDEN | BOILERPLATE for o in inner[1:])

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.end_line() if any(o[0] in BLOCKS for o in self.open[i:]) else None
                self.in_link = max(0, self.in_link - sum(o[0] == "a" for o in self.open[i:]))
                del self.open[i:]
                return
            # an end tag does not reach out of the section it stands in
            if self.open[i][0] in REGIONS | BOILERPLATE and tag not in REGIONS | BOILERPLATE:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        self._close(tag)

    def handle_data(self, data):
        if not self._state()[0]:
            self.words.append(data)
            if self.in_link:
                self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """A Gaussian average of each value and its neighbours."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of values: half way between zero, where lines without text lie, and the mean above.

    The lower cluster stays at zero, so that a page of content alone isn't split in two.
    """
    cut = max(values) / 2
    for _ in range(30):
        above = [v for v in values if v >= cut]
        after = sum(above) / len(above) / 2
        if after == cut:
            break
        cut = after
    return cut


def _unmarked(parser: Lines) -> list[tuple]:
    """The lines outside of marked elements. One that holds an article or a main part is a wrapper and marks nothing; on a page
    without these so is one that holds most of the text and is no place for comments."""
    total, sizes = 0, [0] * len(parser.holds)
    for line in parser.lines:
        total += len(line[0])
        for i in line[6]:
            sizes[i] += len(line[0])
    out = [not held and (comments or parser.has_content or 2 * size <= total) for held, comments, size in zip(parser.holds, parser.comments, sizes, strict=True)]
    return [line for line in parser.lines if not any(out[i] for i in line[6])]


def main_text(html: str | None) -> str:
    """The blocks of the content regions of a page in page order, joined by blank lines; empty if there are none."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    lines = _unmarked(parser)
    if not lines:
        return ""
    ratios = []
    for _, together in groupby(lines, key=lambda line: line[5]):
        ratios += smooth([math.sqrt((len(text) - linked) / max(1, tags)) for text, tags, linked, *_ in together])
    cut = threshold(ratios)
    above = [line for line, ratio in zip(lines, ratios, strict=True) if ratio >= cut and 2 * line[2] <= len(line[0])]
    if not above:
        # links only: what the page marks as its article
        return "\n\n".join(line[0] for line in lines if line[4] == 2)
    parents = parser.parents
    holds = [False] * len(parents)
    for line in above:
        holds[line[3]] = True
    text_of, linked_of = [0] * len(parents), [0] * len(parents)
    for text, _, linked, region, *_ in lines:
        text_of[region] += len(text)
        linked_of[region] += linked
    # regions are numbered as they open: those inside come after
    nests = [False] * len(parents)
    for region in range(len(parents) - 1, 0, -1):
        nests[parents[region]] |= holds[region] or nests[region]
    # whether a region is content, and whether the content region around it holds others
    inside, wide = list(holds), [own and nest for own, nest in zip(holds, nests, strict=True)]
    for region in range(1, len(parents)):
        around = parents[region]
        if not holds[region] and inside[around]:
            inside[region], wide[region] = not wide[around] or 2 * linked_of[region] <= text_of[region], wide[around]
    # a short section beside one that is content is content too
    beside = {parents[r] for r in range(1, len(parents)) if holds[r] and parser.kinds[r] == "section"}
    for region in range(1, len(parents)):
        if parser.kinds[region] == "section" and parents[region] in beside and 2 * linked_of[region] <= text_of[region]:
            inside[region] = True
    return "\n\n".join(line[0] for line in lines if inside[line[3]])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of the main text of every row's ``html``.

    One pass without a shuffle, a row per row. A null or empty page, and one without content, gives an empty
    text. Null and repeated keys are kept as they are; other columns are ignored.
    """

    def extract(batches):
        for batch in batches:
            for first, last, pages_here in text_batches(batch.column(2)):
                texts = [main_text(page) for page in pages_here]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": batch.column(0).slice(first, last - first),
                        "url": batch.column(1).slice(first, last - first),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(text) for text in texts], pa.int64()),
                    }
                )

    work = whole_texts(pages).select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html"))
    return work.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
