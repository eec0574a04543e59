"""Main text of web pages by consensus host paths.

Each page is read into blocks of text with the containers around them.  Its containers are scored
by the running text that they hold outside menus, adverts and the like, and the deepest one with
nearly all of it, or the article or main element around it, votes for its path of tags and classes,
numbers in class names made alike.  The
votes of a host are summed in Spark, and every page of the host is then extracted at the winning
path; a page that lacks that path falls back on its own container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches

#: Share of a page's running text that its container holds at least.
SHARE = 0.8
#: Hosts up to which their paths (about 100 bytes each) are broadcast; beyond it pages and paths
#: are shuffled by host.
BROADCAST_HOSTS = 1 << 17

#: Raw text up to their end tag, or to the page's end; what goes with its end tag and holds no other of its
#: kind; and what, besides, holds no article, so that an end tag left out takes no text along.
_RAW = "script|style"
_WHOLE = "title|textarea|noscript|template|iframe|object|canvas|video|audio|annotation|annotation-xml"
_WIDGET = "button|select|svg"
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW.split("|")}
_ENDS |= {tag: re.compile(rf"(?P<other><{tag}\b)|</{tag}\s*>", re.I) for tag in _WHOLE.split("|")}
_ENDS |= {tag: re.compile(rf"(?P<other><(?:{tag}|p|h[1-6]|article|section|main|ul|ol|table|body)\b)|</{tag}\s*>", re.I) for tag in _WIDGET.split("|")}
_RAW_TAGS = frozenset(_RAW.split("|"))
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_BLOCKS = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address nav header footer aside form fieldset legend hr details summary center".split()
)
_VOID = frozenset("br hr img input meta link wbr area base col embed source track param".split())
_DROPPED_TAGS = frozenset("head nav header footer aside dialog".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_DROPPED_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|nav\w*|menus?|"
    r"breadcrumbs?|side-?bar|footer|header|masthead|comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion|shar(?:e|ing)|social|"
    r"related|recommend\w*|newsletter|subscri\w*|sign-?up|login|search|widget|toolbar|pag(?:er|ination)|forms?)(?=$|[\s_-])",
    re.I,
)
_NEVER_DROPPED = frozenset("html body main article".split())
_COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|repl(?:y|ies)|disqus|discussion)(?=$|[\s_-])", re.I)
_NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|nav\w*|menus?|breadcrumbs?|"
    r"footer|shar(?:e|ing)|social|newsletter|subscri\w*|sign-?up|login)(?=$|[\s_-])",
    re.I,
)
_HEADING = re.compile(r"h[1-6](?:\.|$)")
_LEAF = re.compile(r"(?:p|h[1-6])(?:\.|$)")
#: What is to become of an element's text: it stays; it goes if it is mostly links (an article's own boxes); it
#: goes unless it is the page's running text, or unless nothing else is; it goes.
_STAYS, _LISTED, _DOUBTED, _COMMENTS, _GOES = range(5)
#: A start tag of the first closes an open one of the second that is nearer than its list or table.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = frozenset("ul ol dl table html body".split())


class Block(NamedTuple):
    """Text of one block, how much of it is linked, and the number of the container around it."""

    text: str
    linked: int
    within: int


class _Open(NamedTuple):
    tag: str
    number: int
    dropped: bool
    doubted: bool = False
    article: bool = False


class Containers:
    """A page's containers by number, from the outside in; the one around each, and the nearest one whose text is
    in doubt (0 if none), itself included.  Indexing gives a container's path, which is spelled out only then."""

    def __init__(self) -> None:
        self.parents, self.steps, self.doubts, self.fates = [0], [""], [0], [_STAYS]
        self.noise: set[int] = set()

    def __len__(self) -> int:
        return len(self.parents)

    def add(self, parent: int, step: str, fate: int) -> int:
        number = len(self.parents)
        self.parents.append(parent)
        self.steps.append(step)
        self.doubts.append(number if fate in (_LISTED, _DOUBTED, _COMMENTS) else self.doubts[parent])
        self.fates.append(fate)
        return number

    def around(self, number: int) -> Iterator[int]:
        """The container and those around it, from the inside out."""
        while number:
            yield number
            number = self.parents[number]

    def __getitem__(self, number: int) -> str:
        return "".join(f"/{self.steps[k]}" for k in reversed([*self.around(number)]))

    def chain(self, doubt: int) -> Iterator[int]:
        """The containers in doubt around one of them, itself included."""
        while doubt:
            yield doubt
            doubt = self.doubts[self.parents[doubt]]

    def at(self, path: str) -> list[int]:
        """The numbers of the containers at a path."""
        reached = [0] + [-1] * (len(self) - 1)
        for k in range(1, len(self)):
            so_far = reached[self.parents[k]]
            if so_far >= 0 and path.startswith(f"/{self.steps[k]}", so_far):
                end = so_far + 1 + len(self.steps[k])
                reached[k] = end if path[end : end + 1] in ("", "/") else -1
        return [k for k in range(len(self)) if reached[k] == len(path)]

    def inside(self, numbers: list[int]) -> list[bool]:
        """For each container, whether it is one of these or lies in one."""
        found = [False] * len(self)
        for k in numbers:
            found[k] = True
        for k in range(1, len(self)):
            found[k] = found[k] or found[self.parents[k]]
        return found


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def _fate(tag: str, attributes: dict[str, str], article: bool = False) -> int:
    """``article``: whether the element stands in one, where names alone mean little."""
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if tag in _NEVER_DROPPED:
        return _COMMENTS if tag == "article" and _COMMENT_WORDS.search(named) else _STAYS
    if (
        tag in _DROPPED_TAGS
        or "hidden" in attributes
        or attributes.get("role", "").lower() in _DROPPED_ROLES
        or attributes.get("aria-hidden", "").lower() == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    ):
        return _GOES
    if named.strip() and _DROPPED_WORDS.search(named):
        if _COMMENT_WORDS.search(named):
            return _COMMENTS
        return _LISTED if article and tag != "form" and not _NOISE_WORDS.search(named) else _DOUBTED
    return _DOUBTED if tag == "form" else _STAYS


def _runs(block: Block) -> bool:
    """Whether the block is running text: long, or a sentence, and not mostly linked."""
    return 2 * block.linked < len(block.text) and (len(block.text) > 80 or block.text[-1] in ".!?…")


def _settle(blocks: list[Block], paths: Containers) -> list[Block]:
    """The blocks that stay.  A container whose name or kind puts its text in doubt goes, unless it holds
    ``SHARE`` of the running text in two blocks at least, as a form around a whole page does (and, where it is
    named like an advert or notice, unless it holds all); one in an article goes if it is mostly links.  Where
    only headings and links would be left, all such containers stay but readers' comments; and those only if
    there is nothing else."""
    doubt_of = paths.doubts
    if not any(doubt_of[b.within] for b in blocks):
        return blocks
    size, linked = [0] * len(paths), [0] * len(paths)
    for b in blocks:
        size[b.within] += len(b.text)
        linked[b.within] += b.linked
    comments, noise, doubted = [False] * len(paths), [False] * len(paths), [False] * len(paths)
    for k in range(len(paths) - 1, 0, -1):
        size[paths.parents[k]] += size[k]
        linked[paths.parents[k]] += linked[k]
    for k in range(1, len(paths)):
        up, fate = paths.parents[k], paths.fates[k]
        comments[k] = comments[up] or fate == _COMMENTS
        noise[k] = noise[up] or k in paths.noise
        doubted[k] = doubted[up] or fate in (_DOUBTED, _COMMENTS) or fate == _LISTED and 2 * linked[k] >= size[k]
    weight: dict[int, float] = {}
    runs: dict[int, int] = {}
    for b in blocks:
        doubt = doubt_of[b.within] if doubted[b.within] else 0
        weight[doubt] = weight.get(doubt, 0.0) + _weight(b)
        runs[doubt] = runs.get(doubt, 0) + _runs(b)
    plain = weight.pop(0, 0.0)
    stay: set[int] = set()
    likely = [k for k in weight if not comments[k] and runs[k] > 1 and (not noise[k] or not plain)]
    most = max(likely, key=weight.__getitem__, default=0)
    if most and weight[most] >= SHARE * (weight[most] + plain):
        stay.update(paths.chain(most))
    kept = [b for b in blocks if not doubted[b.within] or doubt_of[b.within] in stay]
    for others in (comments, None):
        if not all(2 * b.linked >= len(b.text) or _HEADING.match(paths.steps[b.within]) for b in kept):
            break
        kept = [b for b in blocks if others is None or not others[b.within]]
    return kept


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """Texts and tags in page order: ``(text, tag, rest)``, the tag with a slash if it is an end, and empty for
    the page's last text.  Comments, scripts and the like are left out.  Each character is passed a bounded number
    of times: behind the last ``>`` nothing is a tag, and where a tag's quotes don't close before the page does,
    quotes mean nothing from there on."""
    at = seek = 0
    last, quotes = page.rfind(">"), True
    text: list[str] = []
    while (start := page.find("<", seek)) >= 0:
        name = _NAME.match(page, start + 1)
        if not name:
            if page[start + 1 : start + 2] not in ("!", "?", "/"):
                seek = start + 1  # a less-than sign
                continue
            text.append(page[at:start])
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            at = seek = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        text.append(page[at:start])
        if start > last:  # an unfinished tag at the very end is no text
            at = seek = len(page)
            break
        end = page.find(">", name.end())
        if quotes and ('"' in (rest := page[name.end() : end]) or "'" in rest):
            whole = _REST.match(page, name.end()).end()
            quotes = page[whole : whole + 1] == ">"
            end = whole if quotes else end
        at = seek = end + 1
        tag = name[0].lower()
        if tag in _ENDS:
            close = _ENDS[tag].search(page, at)
            if close is None and tag in _RAW_TAGS:
                at = seek = len(page)
                continue
            if close and close.lastgroup != "other":
                at = seek = close.end()
                continue
        yield "".join(text), tag, page[name.end() : end]
        text.clear()
    yield "".join([*text, page[at:]]), "", ""


def read_blocks(page: str) -> tuple[list[Block], Containers]:
    """The blocks that stand in nothing dropped, in page order, and all containers."""
    blocks: list[Block] = []
    paths = Containers()
    stack = [_Open("", 0, False)]
    places: dict[str, list[int]] = {}  # where each tag is open
    open_blocks: list[int] = []
    run: list[str] = []
    linked = in_link = 0
    plain = False  # whether the run has text outside inline elements in doubt

    def flush() -> None:
        nonlocal linked, plain
        if run:
            text = " ".join("".join(run).split())
            if text and plain:
                blocks.append(Block(text, linked, stack[-1].number))
            run.clear()
        linked, plain = 0, False

    def text(raw: str) -> None:
        nonlocal linked, plain
        if raw and not stack[-1].dropped:
            found = html.unescape(raw) if "&" in raw else raw
            run.append(found)
            plain = plain or not stack[-1].doubted and not found.isspace()
            if in_link:
                linked += len(found)

    def push(opened: _Open) -> None:
        places.setdefault(opened.tag, []).append(len(stack))
        if opened.tag in _BLOCKS:
            open_blocks.append(len(stack))
        stack.append(opened)

    def close(k: int) -> None:
        if open_blocks and open_blocks[-1] >= k:
            flush()
        while len(stack) > k:
            places[stack.pop().tag].pop()
            if open_blocks and open_blocks[-1] == len(stack):
                open_blocks.pop()

    nearest = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
    for before, tag, rest in _tags(page):
        text(before)
        if not tag:
            break
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                in_link = max(0, in_link - 1)
            if places.get(tag):
                close(places[tag][-1])
            elif tag in _BLOCKS:
                flush()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "a":
            in_link += 1
        attributes = {}
        if "=" in rest or "hidden" in rest:
            attributes = {(a[0] or a[4]).lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(rest)}
        top = stack[-1]
        fate = _fate(tag, attributes, top.article)
        if tag not in _BLOCKS:
            # An inline element whose text goes or is in doubt, and others of its tag inside, so that ends meet their starts.
            if tag not in _VOID and (fate or places.get(tag)):
                push(_Open(tag, top.number, top.dropped or fate == _GOES, top.doubted or fate != _STAYS, top.article))
            continue
        flush()
        in_link = 0 if tag != "p" else in_link
        if places.get("p") and open_blocks[-1] == places["p"][-1]:  # a block ends an open paragraph
            close(open_blocks[-1])
        if tag in _CLOSES and (k := nearest(_CLOSES[tag])) > nearest(_SCOPES):
            close(k)
        if tag == "body" and places.get("head"):  # a head that was not closed ends here
            close(places["head"][0])
        if tag in _VOID:
            continue
        top = stack[-1]
        number = paths.add(top.number, _step(tag, attributes), fate)
        if fate == _DOUBTED and _NOISE_WORDS.search(f"{attributes.get('class', '')} {attributes.get('id', '')}"):
            paths.noise.add(number)
        push(_Open(tag, number, top.dropped or fate == _GOES, top.doubted, top.article or tag in ("article", "main") and fate == _STAYS))
    flush()
    return _settle(blocks, paths), paths


def _weight(block: Block) -> float:
    """Running text counts, links count against it, and short pieces without a sentence count little."""
    plain = max(0, len(block.text) - 3 * block.linked)
    return plain if len(block.text) > 80 or block.text[-1] in ".!?…" else 0.3 * plain


def best_container(blocks: list[Block], paths: Containers) -> tuple[int, float]:
    """The deepest container with ``SHARE`` of the page's weight, or the nearest article or main element
    around it, so that headings and leads beside the text's box stay; on a page without these, the outermost
    one below the body that is reached by adding blocks that are not mostly links.  And its weight."""
    parents = paths.parents
    score, size, linked = [0.0] * len(paths), [0] * len(paths), [0] * len(paths)
    for block in blocks:
        score[block.within] += _weight(block)
        size[block.within] += len(block.text)
        linked[block.within] += block.linked
    for k in range(len(paths) - 1, 0, -1):
        score[parents[k]] += score[k]
        size[parents[k]] += size[k]
        linked[parents[k]] += linked[k]
    # Containers are numbered from the outside in; paragraphs and headings themselves contain nothing.
    full = (k for k in range(len(paths) - 1, -1, -1) if score[k] >= SHARE * score[0] and not _LEAF.match(paths.steps[k]) and (size[k] or not size[0]))
    best = next(full, 0)
    for k in paths.around(best):
        if paths.steps[k].split(".")[0] in ("article", "main"):
            return k, score[k]
    while best and parents[best] and paths.steps[parents[best]].split(".")[0] not in ("body", "html"):
        up = parents[best]
        more = size[up] - size[best]
        if more and 2 * (linked[up] - linked[best]) >= more:
            break
        best = up
    return best, score[best]


def _host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        names, weights = [], []
        for page in batch.column("html").to_pylist():
            blocks, paths = read_blocks(page or "")
            number, weight = best_container(blocks, paths)
            names.append(paths[number])
            weights.append(float(weight))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(names, pa.string()), pa.array(weights)], names=["host", "path", "weight"])


def text_at(page: str, path: str | None) -> str:
    """The blocks of all containers at ``path``, or else of the page's own best container."""
    blocks, paths = read_blocks(page)
    inside = paths.inside(paths.at(path) if path is not None else [])
    chosen = [b.text for b in blocks if inside[b.within]]
    if not chosen:
        inside = paths.inside([best_container(blocks, paths)[0]])
        chosen = [b.text for b in blocks if inside[b.within]]
    return "\n".join(chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [text_at(page or "", path) for page, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the path that most pages of a host vote for; ties go to the larger weight,
    then the later path by name.  Pages without running text have no say."""
    votes = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, weight double")
    sums = votes.where("weight > 0").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("n", F.round("weight"), "path")).alias("path"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: each page's article.

    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by line ends.  A null page or one without an article is empty; a null url is a host of its
    own; rows that repeat stay; an empty table gives an empty result; other columns are ignored.
    """
    rows = small_batches(pages).select("page_id", "url", "html")
    paths = cut(host_paths(rows))
    few = paths.count() <= BROADCAST_HOSTS
    paths = paths.withColumnRenamed("host", "path_host")
    kind = rows.schema["page_id"].dataType.simpleString()
    return (
        rows.join(F.broadcast(paths) if few else paths, _host(F.col("url")) == F.col("path_host"), "left")
        .select("page_id", "url", "html", "path")
        .mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
    )
