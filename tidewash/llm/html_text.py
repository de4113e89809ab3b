"""The main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive and tags
negative; the words of a boilerplate element (a menu, a footer, an advert, ...) are
negative too. Boilerplate inside an article is passed over, so that an advert does
not cut the article in two. One linear scan finds the contiguous region with the
highest sum, and its blocks are the text. The tags' weights come from labelled
pages: the share of a tag's occurrences that lie outside the labelled article.

Elements that HTML itself sets apart (nav, footer, hidden ones, ...) are boilerplate.
So are elements, of any size, with a class, id or role that sounds like boilerplate, and
forms, as far as labelled pages do not show the name mostly inside articles. Where a
page has no article element outside such elements, those around an article are
none; where it has no article at all and no other block of text, those with most of the
page's words are none.

A region that meets the page's article element (or main, if there is no article) grows to
its borders, so that lists, tables and links at its end stay; text beyond the borders
is left out where the article has most of the region's words.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewash.functions.scratch import write_scratch
from tidewash.llm.registry import query, table
from tidewash.llm.quality import one_per_id, rated_sample

#: Labelled pages that the weights are fitted on, at most (a hash of the id chooses).
LABELLED_PAGES = 300
#: The weights tried for a tag that never occurs inside an article.
OUTSIDE_COSTS = (1.0, 3.0, 10.0, 30.0)
#: A tag that no labelled page has outside boilerplate.
UNKNOWN_COST = 0.5
#: Words of a block that is text of its own beside an element that sounds like boilerplate.
LEAST_BLOCK = 20
#: A name's share outside articles before any page is seen: alone, or one part of several;
#: as good as so many elements.
WHOLE_SHARE, PART_SHARE, SHARE_WEIGHT = 1.0, 0.25, 4

# HTML's elements by their standing in a page.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
BOILERPLATE = frozenset(
    "head nav footer aside button select dialog menu object canvas audio video".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
ARTICLES = frozenset(("article", "main"))
CLOSES_PARAGRAPH = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie "
    "cookies consent disclaimer disqus footer masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination popup promo promoted related replies reply "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
#: Parts of names that say nothing beside a listed one ("ad-box", but not "ad-hoc").
NEUTRAL_PARTS = frozenset(
    "area bar block bottom box button buttons center col column container content footer form "
    "header inner item left link links list main outer page right section site slot text title "
    "top unit wrap wrapper".split()
)
BOILERPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"  # quotes matter after "=" only
    r"|<[a-zA-Z/!?][^>]*\Z",
    re.DOTALL,
)
_NAMED = re.compile(
    r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
    re.IGNORECASE,
)
_PARTS = re.compile(r"[a-z]+")
#: A slash that ends the element; one at the end of a value without quotes does not.
_CLOSED = re.compile(r"(?<![^\s\"'])/\Z")


def is_boilerplate(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by HTML's own rules."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if not rest or name in ("html", "body") or name in ARTICLES:
        return False
    for key, *values in _NAMED.findall(rest):
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and "".join(values).lower() == "true"):
            return True
    return False


def suspicions(name: str, rest: str) -> frozenset[str]:
    """What about an element sounds like boilerplate; "ad-" is one part of a longer name."""
    if name in ("html", "body", "main"):
        return frozenset()
    found = {"<form>"} if name == "form" else set()
    for key, *values in _NAMED.findall(rest) if rest else ():
        value = "".join(values).lower()
        if key.lower() == "role" and value in BOILERPLATE_ROLES:
            found.add(f"role={value}")
        elif key.lower() in ("class", "id"):
            for word in value.split():
                parts = set(_PARTS.findall(word))
                whole = parts <= BOILERPLATE_NAMES | NEUTRAL_PARTS
                found |= {p if whole else f"{p}-" for p in parts & BOILERPLATE_NAMES}
    return frozenset(found)


@dataclass(eq=False)
class Area:
    """An element that is or may be boilerplate, with the words in it; the first one is the page."""

    above: Area | None = None
    certain: bool = False
    names: frozenset[str] = frozenset()
    #: The place of its first event.
    place: int = 0
    words: int = 0
    holds_article: bool = False


@dataclass
class Element:
    name: str
    area: Area
    home: Home | None = None


@dataclass
class Home:
    """An article that is in no other, or a main element: its area and its events."""

    name: str
    area: Area
    begin: int
    end: int = 0


@dataclass
class Reader:
    """One pass over a page: tags, and runs of text with the block they belong to."""

    #: (kind, value, area, whether in an article, block); see :meth:`events`.
    found: list[tuple[str, str, Area, bool, int]] = field(default_factory=list)
    areas: list[Area] = field(default_factory=lambda: [Area()])
    open: list[Element] = field(default_factory=list)
    #: How many open elements have a name.
    opened: Counter[str] = field(default_factory=Counter)
    homes: list[Home] = field(default_factory=list)
    articles: int = 0
    block: int = 0

    def _area(self) -> Area:
        return self.open[-1].area if self.open else self.areas[0]

    def _text(self, raw: str) -> None:
        if raw:
            text, area = html.unescape(raw), self._area()
            area.words += len(text.split())
            self.found.append(("text", text, area, self.articles > 0, self.block))

    def _tag(self, name: str, closing: bool = False) -> None:
        if name in BLOCK:
            self.block += 1
        value = f"/{name}" if closing else name
        self.found.append(("tag", value, self._area(), self.articles > 0, self.block))

    def _start(self, name: str, rest: str) -> None:
        if name in CLOSES_PARAGRAPH and name != "p":
            self._end_open("p")
        elif name == "p":
            self._end_open("p")
        if name not in VOID and not _CLOSED.search(rest):
            area, inside = self._area(), self.articles > 0
            if name in ARTICLES:
                self.articles += 1
                above = area
                while not inside and above is not None and not above.holds_article:
                    above.holds_article, above = True, above.above
            certain, names = is_boilerplate(name, rest, inside), suspicions(name, rest)
            if certain or names:
                area = Area(area, certain, names, len(self.found))
                area.holds_article = name in ARTICLES and not inside
                self.areas.append(area)
            home = None
            if name in ARTICLES and not (name == "main" and inside) and not self.opened["article"]:
                home = Home(name, area, len(self.found))
                self.homes.append(home)
            self.open.append(Element(name, area, home))
            self.opened[name] += 1
        self._tag(name)

    def _close(self, at: int) -> None:
        """Close the open elements from a place on."""
        for element in self.open[at:]:
            self.opened[element.name] -= 1
            self.articles -= element.name in ARTICLES
            if element.home:
                element.home.end = len(self.found)
        del self.open[at:]

    def _end_open(self, name: str) -> None:
        """Close the innermost element of that name, and what is open in it."""
        if not self.opened[name]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].name == name:
                self._close(at)
                return
            if name == "p" and self.open[at].name in CLOSES_PARAGRAPH:
                return

    def read(self, page: str) -> Reader:
        at = 0
        while match := _MARKUP.search(page, at):
            self._text(page[at : match.start()])
            at = match.end()
            name = (match["name"] or "").lower()
            if name and match["close"]:
                self._tag(name, closing=True)
                self._end_open(name)
            elif name in RAW and not match["rest"].endswith("/"):
                ending = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = ending.end() if ending else len(page)
                self._tag(name)
            elif name:
                self._start(name, match["rest"])
        self._text(page[at:])
        self._close(0)
        for area in reversed(self.areas[1:]):  # those within come after those around them
            if not area.certain:
                area.above.words += area.words
        return self

    def _dropped(self, suspected: set[int]) -> dict[int, bool]:
        """For every area whether it, or one around it, is certain or suspected."""
        dropped = {id(self.areas[0]): False}
        for area in self.areas[1:]:
            dropped[id(area)] = (
                area.certain or id(area) in suspected or dropped[id(area.above)]
            )
        return dropped

    def boilerplate(self, names: dict[str, float]) -> dict[int, bool]:
        """Which areas are boilerplate; ``names``: shares of names outside articles."""
        suspected = {
            id(area)
            for area in self.areas[1:]
            if any(name_share(n, names) > 0.5 for n in area.names)
        }
        dropped = self._dropped(suspected)
        if not suspected or any(not dropped[id(home.area)] for home in self.homes):
            return dropped
        if self.homes:
            return self._dropped({id(a) for a in self.areas if not a.holds_article} & suspected)
        words = Counter()
        for kind, value, area, _, block in self.found:
            if kind == "text" and not dropped[id(area)]:
                words[block] += len(value.split())
        if max(words.values(), default=0) >= LEAST_BLOCK:
            return dropped
        total = self.areas[0].words
        return self._dropped({id(a) for a in self.areas if 2 * a.words <= total} & suspected)

    def events(self, names: dict[str, float]) -> list[tuple[str, str, float, int]]:
        """(kind, value, dropped, block): kind "tag" with a name, or "text" with decoded text.

        ``dropped`` is 1 in boilerplate and 0 elsewhere. Boilerplate within an article
        is left out, so that it does not cut the article in two.
        """
        return self.parts(names)[0]

    def parts(
        self, names: dict[str, float]
    ) -> tuple[list[tuple[str, str, float, int]], list[tuple[int, int]]]:
        """The events, and where the page's articles are among them (else its main elements)."""
        dropped = self.boilerplate(names)
        kept = [
            place
            for place, (kind, value, area, in_article, _) in enumerate(self.found)
            if not (in_article and dropped[id(area)])
            or (kind == "tag" and value.strip("/") in ARTICLES)
        ]
        events = [
            (kind, value, float(dropped[id(area)]), block)
            for kind, value, area, _, block in (self.found[place] for place in kept)
        ]
        homes = [h for h in self.homes if not dropped[id(h.area)]]
        homes = [h for h in homes if h.name == "article"] or homes
        return events, [(bisect_left(kept, h.begin), bisect_left(kept, h.end)) for h in homes]


def name_share(name: str, names: dict[str, float], inside: int = 0, outside: int = 0) -> float:
    """The share of a name outside articles, from the elements seen with it in and out of them."""
    if name in names:
        return names[name]
    share = PART_SHARE if name.endswith("-") else WHOLE_SHARE
    return (outside + SHARE_WEIGHT * share) / (outside + inside + SHARE_WEIGHT)


@dataclass(frozen=True)
class Weights:
    """What a word, a word in boilerplate and each tag add to a region's score."""

    word: float = 1.0
    dropped_word: float = -1.0
    unknown_tag: float = -1.0
    tags: dict[str, float] = field(default_factory=dict)
    #: The names' shares outside articles, where labelled pages have them.
    names: dict[str, float] = field(default_factory=dict)


def region(events: list[tuple[str, str, float, int]], weights: Weights) -> tuple[int, int]:
    """The first and one past the last event of the contiguous region with the highest score."""
    best, best_at = 0.0, (0, 0)
    total, begin = 0.0, 0
    for place, (kind, value, dropped, _) in enumerate(events):
        if total <= 0:
            total, begin = 0.0, place
        if kind == "tag":
            total += weights.tags.get(value, weights.unknown_tag)
        else:
            words = len(value.split())
            total += words * (weights.word + dropped * (weights.dropped_word - weights.word))
        if total > best:
            best, best_at = total, (begin, place + 1)
    return best_at


def blocks(events: list[tuple[str, str, float, int]]) -> Iterator[str]:
    """The texts of the blocks, white space in one made single spaces; empty ones left out."""
    current, parts = None, []
    for kind, value, dropped, block in events:
        if block != current:
            if line := " ".join("".join(parts).split()):
                yield line
            current, parts = block, []
        if kind == "text" and dropped < 1:
            parts.append(value)
        elif kind == "tag" and value in ("br", "hr", "img"):
            parts.append(" ")
    if line := " ".join("".join(parts).split()):
        yield line


def best_blocks(events: list[tuple[str, str, float, int]], weights: Weights) -> Iterator[str]:
    begin, end = region(events, weights)
    return blocks(events[begin:end])


def to_borders(
    events: list[tuple[str, str, float, int]],
    homes: list[tuple[int, int]],
    begin: int,
    end: int,
) -> tuple[int, int]:
    """The region from ``begin`` to ``end``, grown to the borders of the articles it meets.

    If it meets the page's only article and that has half of the region's words or
    more, what lies beyond the borders is left out.
    """
    met = [(a, b) for a, b in homes if a < end and begin < b]
    if not met:
        return begin, end

    def words(a: int, b: int) -> int:
        return sum(len(e[1].split()) for e in events[a:b] if e[0] == "text" and not e[2])

    first, last = met[0][0], max(b for _, b in met)
    low, high = min(begin, first), max(end, last)
    if len(homes) == 1 and 2 * words(first, last) >= words(low, high):
        return first, last
    return low, high


def extract(page: str | None, weights: Weights) -> str:
    events, homes = Reader().read(page or "").parts(weights.names)
    begin, end = to_borders(events, homes, *region(events, weights))
    return "\n".join(blocks(events[begin:end]))


def article(events: list[tuple[str, str, float, int]]) -> tuple[int, int] | None:
    """The places of the article's two tags, if the page has exactly one article element."""
    marks = [i for i, e in enumerate(events) if e[0] == "tag" and e[1] in ("article", "/article")]
    return tuple(marks) if [events[i][1] for i in marks] == ["article", "/article"] else None


def count_labelled(pages: Iterable[str | None]) -> Counter:
    """How often tags and names occur (kind, name, whether inside) in and out of the article,
    over the pages that are labelled by one article element.

    Tags in boilerplate say nothing about tags in text and count 0 times.
    """
    counts = Counter()
    for page in pages:
        reader = Reader().read(page or "")
        events = reader.events({})
        marks = article(events)
        if marks is None:
            continue
        a, b = marks
        for place, (kind, value, dropped, _) in enumerate(events):
            if kind == "tag" and place not in marks:
                counts["tag", value, a < place < b] += not dropped
        a, b = article(reader.found)
        for area in reader.areas[1:]:
            if not area.holds_article:
                counts.update(("name", name, a < area.place < b) for name in area.names)
    return counts


def candidates(counts: Counter) -> list[Weights]:
    """The weights for each of ``OUTSIDE_COSTS``.

    A tag costs a little everywhere and more by the (smoothed) share of its
    occurrences outside the article. The article's own tags are the label; their
    weights are not counted.
    """
    shares = {
        (kind, name): (counts[kind, name, True], counts[kind, name, False])
        for kind, name, _ in counts
    }
    names = {n: name_share(n, {}, *c) for (kind, n), c in shares.items() if kind == "name"}
    found = []
    for cost in OUTSIDE_COSTS:
        tags = {
            n: -0.1 - cost * outside / (outside + inside + 1) if outside + inside else -UNKNOWN_COST
            for (kind, n), (inside, outside) in shares.items()
            if kind == "tag"
        }
        tags |= {"article": -0.1, "main": -0.1, "/article": -cost, "/main": -cost}
        found.append(Weights(unknown_tag=-UNKNOWN_COST, tags=tags, names=names))
    return found


def overlaps(pages: Iterable[str | None], tried: list[Weights]) -> list[float]:
    """For each of the weights the sum of overlaps with the labelled articles' words."""
    scores = [0.0] * len(tried)
    for page in pages:
        events = Reader().read(page or "").events(tried[0].names)
        marks = article(events)
        if marks is None:
            continue
        truth = Counter(" ".join(blocks(events[marks[0] : marks[1]])).split())
        for k, weights in enumerate(tried):
            got = Counter(" ".join(best_blocks(events, weights)).split())
            scores[k] += 2 * (truth & got).total() / max(1, truth.total() + got.total())
    return scores


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    for batch in batches:
        for page in batch.column("html"):
            yield page.as_py()


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(*key, n) for key, n in count_labelled(_texts(batches)).items()]
    columns = [[r[k] for r in rows] for k in range(4)]
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
        names=["kind", "name", "inside", "n"],
    )


def _overlaps(batches: Iterator[pa.RecordBatch], tried: list[Weights]) -> Iterator[pa.RecordBatch]:
    scores = overlaps(_texts(batches), tried)
    yield pa.RecordBatch.from_arrays([pa.array([scores], pa.list_(pa.float64()))], names=["scores"])


def fit_page_weights(
    pages: DataFrame, id: str = "page_id", markup: str = "html", most: int = LABELLED_PAGES
) -> Weights:
    """The candidate weights of best overlap, from pages that hold one article element.

    At most ``most`` pages take part, one per id that is not null; tasks read them, and the driver gets sums only.
    """
    labelled = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{markup}`").alias("html")).where(
        F.lower("html").contains("<article") & F.lower("html").contains("</article")
    )
    ids = rated_sample(labelled.select("id"), "id", most).withColumnRenamed("id", "chosen")
    rows = labelled.join(F.broadcast(ids), F.col("id") == F.col("chosen")).select("id", "html")
    # Read twice, so written: a row per chosen id.
    chosen = write_scratch(one_per_id(rows, "id").select("html"), "labelled")
    counts = Counter()
    for row in chosen.mapInArrow(
        _count_labelled, "kind string, name string, inside boolean, n long"
    ).collect():
        counts[row.kind, row.name, row.inside] += row.n
    tried = candidates(counts)
    found = chosen.mapInArrow(lambda b: _overlaps(b, tried), "scores array<double>").collect()
    best, weights = -1.0, tried[0]
    for k, candidate in enumerate(tried):
        score = round(math.fsum(row.scores[k] for row in found), 6)
        if score > best:
            best, weights = score, candidate
    return weights


def _extract(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(page.as_py(), weights) for page in batch.column("html")]
        kept = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in kept), pa.array(found, pa.string())],
            names=[*kept, "text"],
        )


def main_text(
    pages: DataFrame, weights: Weights, id: str = "page_id", url: str = "url", markup: str = "html"
) -> DataFrame:
    """``id, url, text`` for every row of ``pages``, from the whole markup.

    Defined results: null or empty markup, and pages without a positive region,
    have the empty text; markup that is cut off is read as far as it goes;
    repeated rows get equal texts; an empty table gives an empty result. Other
    columns are not looked at.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id, url)]
    return (
        pages.select(
            F.col(f"`{id}`").alias("page"),
            F.col(f"`{url}`").alias("url"),
            F.col(f"`{markup}`").alias("html"),
        )
        .mapInArrow(
            lambda b: _extract(b, weights), f"page {kinds[0]}, url {kinds[1]}, text string"
        )
        .withColumnsRenamed({"page": id, "url": url})
    )


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = main_text(pages, fit_page_weights(pages))
    return found.select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )
