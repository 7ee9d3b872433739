"""Main text of web pages by maximum-scoring subsequence (operator 10).

A page is a sequence of words and tags. Words score positive and tags
negative; a linear scan finds the contiguous region of the highest total. All
weights come from labelled pages. Without labels of its own the trainer takes
pages with exactly one article element as labelled by it (at most ``SAMPLE``
pages, chosen by a hash of page_id); pages without that element are then read
with the weights learned from the others.

* Names (last words of class, id and role) have a weight: what the names of
  adverts, notices, menus or reader comments usually mean, moved by how many
  labelled pages hold elements of that name inside the article and outside. An
  element whose name scores below ``LEFT_OUT`` is no article, and its words
  count for nothing. So a name that no list knows is left out once labelled
  pages show it outside only, and a doubtful one stays once they show it inside.
* Tags and words are weighted by a structured perceptron: whenever the best
  region differs from the labelled one, the weights of what it holds too much
  of go down and of what it lacks go up, words staying positive and tags
  negative. The tags of the label itself are no features in training.

Elements that are not article by their kind (menus, page headers, footers,
asides, forms, scripts, styles) are always left out.

Where a page has exactly one article element (or else one main element), that
is the region: tags inside cost nothing, words outside count for nothing, so
link lists and tables of the article stay. Inside it an element of a name that
may be a section's title (``TITLED``) stays if it reads like text, that is, if
less than half of its words are links. The weights decide on all other pages.

Defined results: a null or empty page, or one without words outside such
elements, has empty text; repeated rows get equal results; an unclosed element
ends with its parent, or at the start tag that ends it in HTML (paragraphs,
list items, cells, rows, options); of equal regions the first and shortest is
taken; a very long page is read as a whole, in linear time; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftscan.llm.base import bounded, cut, table

SAMPLE = 300
ROUNDS = 5
#: Attributes end at the next start of a tag unless it is quoted, so that no unclosed tag is searched to the page's end.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"'=]|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "title", "head", "select", "button"}
NOT_ARTICLE = {"nav", "footer", "aside", "form", "dialog", "menu"}
#: Names of what is no article, and of what may be a section of one.
NAMES = set(
    "ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos banner cookie cookies consent gdpr popup modal "
    "newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies share sharing social sidebar sidenav menu nav subnav navbar topbar "
    "breadcrumb breadcrumbs footer colophon masthead pagination pager toolbar navbox complementary contentinfo".split()
)
DOUBTFUL = set("alert copyright disclaimer discussion navigation notice notices overlay promotion recommendations recommended related search widget widgets".split())
#: Weights of names before training, how far labelled pages move one, how many pages make half of that, and what is left out.
NAMED_OUT, DOUBTED, MOVE, HALF, LEFT_OUT = -3.0, -1.0, 1.5, 5, -0.75
#: A header with one of these names is the article's own.
OWN = {"entry", "post", "article", "story", "content", "section"}
#: Words that say how an element holds what stands before them in its name.
HOLDERS = set("area bar block body box button buttons container entries form group holder icon icons inner item items line link links list outer panel post posts row section slot stories text unit wrap wrapper zone".split())
#: What is also the title of an article's own section.
TITLES = {"advertising", "consent", "copyright", "disclaimer", "discussion", "navigation", "notice", "notices", "promotion", "recommendations", "recommended", "related", "search"}
#: Of these, names of what an article may be about: inside one, what the element holds decides.
TITLED = {"copyright", "discussion", "navigation", "recommendations", "recommended", "related", "search"}
#: Elements that are read as a whole without text, but not inside an article.
QUIET = {"noscript", "svg"}
#: What follows such a word in a name says what an element has, not what it is.
HAS = {"has", "with", "without", "no", "is", "not"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements out of which nothing is ended by the start of another element, by what would be ended.
CELLS = {"table", "caption", "td", "th"}
BARS = {"p": CELLS, "part": {"table"}, "item": BLOCKS - {"address", "div", "p", "li", "dd", "dt"}, "option": {"datalist"}, "a": BLOCKS}
#: What the start of an element ends, as end tags are optional in HTML: (what bars it, names).
ENDS = {
    "p": (("p", ("p",)),),
    "li": (("item", ("li",)), ("p", ("p",))),
    "dd": (("item", ("dd", "dt")), ("p", ("p",))),
    "dt": (("item", ("dd", "dt")), ("p", ("p",))),
    "td": (("part", ("td", "th", "caption")),),
    "th": (("part", ("td", "th", "caption")),),
    "tr": (("part", ("td", "th", "tr", "caption")),),
    "option": (("option", ("option",)),),
    "optgroup": (("option", ("option", "optgroup")),),
    "a": (("a", ("a",)),),
}
ENDS |= {n: (("part", ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")),) for n in ("tbody", "thead", "tfoot")}
#: Blocks whose start ends no paragraph.
NOT_AFTER_P = {"html", "body", "caption", "legend", "frameset"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold the whole page: their names never leave it out.
WHOLE = {"html", "body"}
#: Weights before training.
WORD, BLOCK_TAG, INLINE_TAG, LINK_TAG, WHOLE_TAG = 1.0, -0.1, -0.05, -1.0, -30.0


class Part(NamedTuple):
    kind: str  # "text", or the tag's name, closing ones with a leading slash
    text: str
    words: int
    out: bool  # inside an element that is no article


class Open:
    """The open elements of a page, which of them are left out, and how many articles are open."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each name
        self.blocks: list[int] = []
        self.bars: dict[str, list[int]] = {g: [] for g in BARS}
        self.left_out: list[int] = []
        self.articles: list[int] = []
        self.marks: list[tuple[int, list[str]]] = []  # of each open element: the first part inside, and its names
        self.closed: list[tuple[int, int, list[str]]] = []

    def last(self, names: Iterable[str]) -> int:
        return max((at[-1] for n in names if (at := self.at.get(n))), default=-1)

    def push(self, name: str, out: bool, part: int = 0, named: list[str] | None = None) -> None:
        k = len(self.names)
        self.marks.append((part, named or []))
        self.names.append(name)
        self.at[name].append(k)
        if name in BLOCKS:
            self.blocks.append(k)
        for group, bars in BARS.items():
            if name in bars:
                self.bars[group].append(k)
        if out:
            self.left_out.append(k)
        elif name in ("article", "main"):
            self.articles.append(k)

    def pop_to(self, k: int, part: int = 0) -> None:
        for name in self.names[k:]:
            self.at[name].pop()
        self.closed += [(first, part, named) for first, named in self.marks[k:] if named]
        del self.names[k:], self.marks[k:]
        for held in (self.blocks, self.left_out, self.articles, *self.bars.values()):
            while held and held[-1] >= k:
                held.pop()

    def before(self, name: str, part: int = 0) -> None:
        """Ends what the start of an element ends."""
        for group, ended in ENDS.get(name, ENDS["p"] if name in BLOCKS - NOT_AFTER_P else ()):
            bars = self.bars[group]
            while (k := self.last(ended)) > (bars[-1] if bars else -1):
                self.pop_to(k, part)
        if name in HEADINGS and self.names and self.names[-1] in HEADINGS:
            self.pop_to(len(self.names) - 1, part)

    def end(self, name: str, part: int = 0) -> None:
        """Ends an element and all that is open inside; an inline element's end tag ends no block."""
        k = self.last((name,))
        if k >= 0 and (name in BLOCKS or not self.blocks or self.blocks[-1] < k):
            self.pop_to(k, part)


def parts_of(page: str, weights: dict[str, float], elements: list[tuple[int, int, list[str]]] | None = None) -> list[Part]:
    """Text and tags of a page in order; ``elements`` gets (first part inside, end, names) of each that has names."""
    out: list[Part] = []
    open_ = Open()
    at, last, headless = 0, page.rfind(">"), False
    doubts: set[int] = set()  # first parts of elements whose name alone does not decide

    def text(piece: str) -> None:
        if piece:
            plain = entities.unescape(piece)
            out.append(Part("text", plain, len(plain.split()), bool(open_.left_out)))

    while (at <= last or page.find("<!--", at) >= 0) and (m := TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and name in RAW and not attrs.endswith("/") and not (name in QUIET and open_.articles):
            if name == "head" and headless:
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>" if name != "head" else r"</head\s*>|<body\b[^>]*>", re.I).search(page, at)
            if name == "head" and end is None:
                headless = True
                continue
            out.append(Part(name, "", 0, bool(open_.left_out)))
            at = end.end() if end else len(page)
            continue
        if closing:
            out.append(Part("/" + name, "", 0, bool(open_.left_out)))
            open_.end(name, len(out))
            continue
        open_.before(name, len(out))
        tokens = list(tokens_of(attrs)) if attrs else []
        words = {w for _, each in tokens for w in each}
        named = names_of(name, tokens)
        bad = [n for n in named if weights.get(n, 0.0) < LEFT_OUT]
        doubtful = bool(open_.articles) and bool(bad) and name not in NOT_ARTICLE and all(n[1:] in TITLED for n in bad)
        other = (bool(bad) and not doubtful) or name in NOT_ARTICLE
        other = other or (not open_.articles and (name == "header" or ("header" in words and not words & OWN)))
        if name in ("article", "main") and not other:
            open_.left_out.clear()  # an article is not part of what was left open before it
        other = other and name not in WHOLE
        out.append(Part(name, "", 0, bool(open_.left_out) or other))
        if name not in VOID and not attrs.endswith("/"):
            open_.push(name, other, len(out), named if name not in WHOLE else None)
            if doubtful and not open_.left_out:
                doubts.add(len(out))
    text(page[at:])
    open_.pop_to(0, len(out))
    if doubts:
        links = linked_words(out)
        total = list(accumulate((p.words for p in out), initial=0))
        for a, b, _ in open_.closed:
            if a in doubts and 2 * (links[b] - links[a]) >= total[b] - total[a]:
                out[a:b] = [p._replace(out=True) for p in out[a:b]]
    if elements is not None:
        elements += open_.closed
    return out


def linked_words(parts: list[Part]) -> list[int]:
    """Words inside links before each part, and in all."""
    upto, inside = [0], False
    for p in parts:
        if p.kind in ("a", "/a"):
            inside = p.kind == "a"
        upto.append(upto[-1] + (p.words if inside else 0))
    return upto


def tokens_of(attrs: str) -> Iterator[tuple[str, list[str]]]:
    """The attribute and the words of each name in an element's class, id and role, up to a word that says what it has."""
    for attr, *groups in NAMED.findall(attrs):
        for name in "".join(groups).split():
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            has = next((k for k, w in enumerate(words) if w in HAS), len(words))
            if has:
                yield attr.lower(), words[:has]


def names_of(name: str, tokens: list[tuple[str, list[str]]]) -> list[str]:
    """What an element is called: the last word of each of its names, plain holders and numbers aside, after a dot.

    An id of a heading is an anchor and says nothing; one of a section doesn't
    if articles have sections of that title.
    """
    out = []
    for attr, words in tokens:
        k = len(words)
        while k > 1 and (words[k - 1] in HOLDERS or words[k - 1][0].isdigit()):
            k -= 1
        if not (attr == "id" and (name in HEADINGS or (name == "section" and words[k - 1] in TITLES))):
            out.append("." + words[k - 1])
    return out


def start_weights() -> dict[str, float]:
    weights = {"text": WORD}
    for name in BLOCKS:
        weights[name] = weights["/" + name] = BLOCK_TAG
    weights["a"] = weights["/a"] = weights["option"] = LINK_TAG
    for name in ("article", "main"):  # what is outside them is seldom part of them
        weights[name] = weights["/" + name] = WHOLE_TAG
    return weights | {"." + n: NAMED_OUT for n in NAMES} | {"." + n: DOUBTED for n in DOUBTFUL}


def moved(weights: dict[str, float], inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Weights after labelled pages have shown names inside and outside of articles."""
    out = dict(weights)
    for n in {*inside, *outside}:
        a, b = inside.get(n, 0), outside.get(n, 0)
        out[n] = out.get(n, 0.0) + MOVE * (a - b) / (a + b + HALF)
    return out


def sides_of(page: str, weights: dict[str, float]) -> dict[str, bool]:
    """Of a labelled page: names of elements with words, and whether most of these are inside the article.

    An element that holds the article itself is on neither side.
    """
    elements: list[tuple[int, int, list[str]]] = []
    parts = parts_of(page, weights, elements)
    first = next((k for k, p in enumerate(parts) if p.kind == "article"), len(parts))
    last = next((k for k in range(first, len(parts)) if parts[k].kind == "/article"), len(parts))
    upto = [0]
    for p in parts:
        upto.append(upto[-1] + p.words)
    balance: dict[str, int] = defaultdict(int)
    for a, b, named in elements:
        words = upto[b] - upto[a]
        if words and not (a <= first and b >= last):
            for n in set(named):
                balance[n] += words if a > first and b <= last + 1 else -words
    return {n: v > 0 for n, v in balance.items()}


def best_region(parts: list[Part], weights: dict[str, float], inside: tuple[int, int] | None = None) -> tuple[int, int]:
    """Half-open range of parts with the highest total; (0, 0) if there is no word.

    With ``inside``, words outside that range count for nothing and tags in it cost nothing.
    """
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    word = weights["text"]
    first, last = inside or (0, len(parts))
    for k in range(first, last):
        part = parts[k]
        if part.kind == "text":
            if not part.words or part.out:
                continue
            if total <= 0:
                total, start = 0.0, k
            total += word * part.words
            if total > best:
                best, span = total, (start, k + 1)
        elif not part.out and inside is None:  # what is left out doesn't part what stays
            total += weights.get(part.kind, INLINE_TAG)
    return span


def own_article(parts: list[Part]) -> tuple[int, int] | None:
    """What the page's only article element holds, or its only main element; elements inside of the same kind are part of it."""
    for kind in ("article", "main"):
        depth, found = 0, []
        for k, p in enumerate(parts):
            if p.kind == kind and not p.out:
                if not depth:
                    found.append([k + 1, len(parts)])
                depth += 1
            elif p.kind == "/" + kind and depth and not p.out:
                depth -= 1
                if not depth:
                    found[-1][1] = k
        if found:
            return tuple(found[0]) if len(found) == 1 else None
    return None


def labelled_region(parts: list[Part]) -> tuple[int, int] | None:
    """What the page's only article element holds, from its first word to its last."""
    opens = [k for k, p in enumerate(parts) if p.kind == "article" and not p.out]
    if len(opens) != 1:
        return None
    first = opens[0]
    last = next((k for k in range(first, len(parts)) if parts[k].kind == "/article"), len(parts))
    held = [k for k in range(first, last) if parts[k].words and not parts[k].out]
    return (held[0], held[-1] + 1) if held else None


def learn(pages: list[str], weights: dict[str, float] | None = None, rounds: int = ROUNDS) -> dict[str, float]:
    """Averaged weights of a structured perceptron over labelled pages; the label's own tags score nothing in training."""
    weights, sums, steps = dict(weights or start_weights()), defaultdict(float), 0
    label = {k: weights[k] for name in ("article", "main") for k in (name, "/" + name)}
    seen = [(p, r) for p in (parts_of(page, weights) for page in pages) if (r := labelled_region(p)) is not None]
    weights |= dict.fromkeys(label, 0.0)
    for _ in range(rounds):
        wrong = 0
        for parts, (a, b) in seen:
            c, d = best_region(parts, weights)
            if (a, b) != (c, d):
                change: dict[str, float] = defaultdict(float)
                for lo, hi, sign in ((a, b, 1.0), (c, d, -1.0)):
                    for part in parts[lo:hi]:
                        if part.out or part.kind in label:
                            continue
                        change[part.kind] += sign * (part.words if part.kind == "text" else 1)
                longest = max(1.0, max((abs(v) for v in change.values()), default=1.0))
                for kind, v in change.items():
                    step = v / longest if kind == "text" else v
                    new = weights.get(kind, INLINE_TAG) + step
                    weights[kind] = max(0.1, new) if kind == "text" else min(-0.01, new)
                wrong += 1
            steps += 1
            for kind, v in weights.items():
                sums[kind] += v
        if not wrong:
            break
    return ({k: v / steps for k, v in sums.items()} if steps else weights) | label


def main_text(page: str | None, weights: dict[str, float]) -> str:
    parts = parts_of(page or "", weights)
    first, last = best_region(parts, weights, own_article(parts))
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(held).split()):
            blocks.append(block)
        held.clear()

    for part in parts[first:last]:
        if part.kind == "text":
            if not part.out:
                held.append(part.text)
        elif part.kind.removeprefix("/") in BLOCKS:
            flush()
        elif part.kind == "br":
            held.append(" ")
    flush()
    return "\n".join(blocks)


def train(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most about ``sample`` pages that one article element labels."""
    start = start_weights()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for h in batch.column("html").to_pylist() for x in sides_of(h, start).items()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_())], ["name", "inside"])

    share = min(1.0, sample / max(1, pages.count()))
    chosen = bounded(pages).where(F.pmod(F.xxhash64(F.lit(10), "page_id", "html"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).where(F.regexp_count("html", F.lit("(?i)<article[ >]")) == 1).select("page_id", "html")
    chosen = cut(chosen)  # about ``sample`` rows, read twice
    # Names of the sampled pages alone, counted where the pages are.
    counts = chosen.select("html").mapInArrow(sides, "name string, inside boolean").groupBy("name").agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b")).collect()
    weights = moved(start, {r["name"]: r["a"] for r in counts}, {r["name"]: r["b"] for r in counts})
    pages_ = chosen.collect()
    return learn([r["html"] for r in sorted(pages_, key=lambda r: (r["page_id"] is None, r["page_id"], r["html"]))], weights)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [main_text(h, weights) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return bounded(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(of, "page_id bigint, url string, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
