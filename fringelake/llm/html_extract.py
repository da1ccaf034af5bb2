"""Main text of web pages by maximum-scoring subsequence."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are fitted on at most.
SAMPLE = 400
#: Fixed values of HTML: elements whose contents are raw text, elements without end tag, elements that begin or end a block,
#: those whose start ends an open paragraph, and for others the open elements that a start tag ends, within which ancestor.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr"), ("table",)),
}
SCOPE = ("td", "th", "caption", "button", "object", "template", "html")
#: Words outside of the article that an element is taken to have been seen with before any page is: by what HTML says of it.
PRIOR = {"nav": 200, "footer": 200, "aside": 200, "form": 200, "menu": 200, "dialog": 200, "button": 200, "select": 200, "template": 200, "noscript": 200, "object": 50, "svg": 200, "canvas": 200, "header": 50, "[hidden]": 200, "@navigation": 200, "@banner": 50, "@contentinfo": 200, "@complementary": 200, "@search": 200}
LABELS = ("article", "main")
#: Elements that only group others. On pages without a LABELS element, going into or out of one costs the scan a share of
#: the words below it, of HOLD of them at most; a page's first heading counts as HEADING words at least.
GROUPS = frozenset("div section center fieldset details dd td".split())
HOLD, HEADING = 100, 40
#: Linked words to all of a block, in thirds, and words of a block: the cells of its form.
LONG = (5, 15)
#: Words that a feature is taken to have been seen with anyway, and what an element can cost the scan at most.
ALPHA, MOST = 20.0, 10.0
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
REST = re.compile(r"[\s/]*(>?)")
COMMENT = re.compile(r"--(?:>|.*?(?:--!?>|\Z))", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
DIGITS, WHITE = re.compile(r"\d+"), re.compile(r"\s+")


def _features(tag: str, attributes: dict[str, str]) -> tuple[str, ...]:
    """What tells about an element: its name, and its classes, id and role, numbers in them being alike."""
    out = [tag]
    if attributes:
        out += ["." + DIGITS.sub("0", c) for c in attributes.get("class", "").lower().split()]
        out += [mark + DIGITS.sub("0", attributes[name].strip().lower()) for name, mark in (("id", "#"), ("role", "@")) if attributes.get(name)]
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            out.append("[hidden]")
    return tuple(out)


def events(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """("text", raw text, ()), ("open", tag, features), ("close", tag, ()) and ("void", tag, features) of a page in order, in one
    pass. End tags that HTML implies come as close too, and all that is open at the end; end tags of what is not open, and
    comments, don't come; nor do the contents of scripts, styles and other raw text."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def shut(down_to: int):
        while len(stack) > down_to:
            t = stack.pop()
            places[t].pop()
            yield "close", t, ()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ()
        if lt == n:
            break
        m = TAG.match(page, lt)
        if m is None:
            following = page[lt + 1 : lt + 2]
            if following == "!" and page.startswith("<!--", lt):
                c = COMMENT.match(page, lt + 2)
                at = c.end() if c else n
            elif following in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                yield "text", "<", ()
                at = lt + 1
            continue
        tag, attributes, at, ended = m[2].lower(), {}, m.end(), False
        while True:
            r = REST.match(page, at)
            if r[1]:
                at, ended = r.end(), True
                break
            a = ATTRIBUTE.match(page, at)
            if a is None or a.end() == at:
                at = n
                break
            at = a.end()
            attributes.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if not ended:
            break  # a tag that never ends
        if m[1]:
            place = last((tag,))
            if place >= 0 and (place >= last(SCOPE) or tag in SCOPE or tag in BLOCK and tag not in ("p", "li")):
                yield from shut(place)
            continue
        if tag in ENDS_P:
            place = last(("p",))
            if place > last(SCOPE):
                yield from shut(place)
        if tag in ENDS:
            ended_by, within = ENDS[tag]
            bound = last(within)
            # the outermost of them within the ancestor
            after = [x[i] for x in (places.get(t, ()) for t in ended_by) if (i := bisect_right(x, bound)) < len(x)]
            if after:
                yield from shut(min(after))
        features = _features(tag, attributes)
        if tag in VOID:
            yield "void", tag, features
        elif tag in RAW:
            end = RAW_END[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
            yield "open", tag, features
    yield from shut(0)


def _telling(features: tuple[str, ...]) -> tuple[str, ...]:
    """What an element outside of the article is known by: its name if that says what it is for, else what names it, if any."""
    if features[0] in PRIOR:
        return features[:1]
    return features[1:] or features[:1]


class Weights:
    """Scores of the scan. What an element says is the log ratio of the words seen in such elements within and without the
    labelled regions; its words, and all below it, go by the ancestor that says most against them. Words score `word`, or
    less than zero where that is clearly negative; tags score the log ratio of their own rates, never above -0.05."""

    def __init__(self, inside: Counter | None = None, outside: Counter | None = None, tags_in: Counter | None = None, tags_out: Counter | None = None, word: float = 1.0):
        inside, outside = Counter(inside or {}), Counter(outside or {}) + Counter(PRIOR)
        self.word, self.says, self.tag, self.form, self.share = word, {}, {}, {}, 0.4
        a, b = max(inside[""], 1000.0), max(outside[""], 1000.0)
        for f in {*inside, *outside} - {""}:
            self.says[f] = math.log((inside[f] + ALPHA) / (a + ALPHA)) - math.log((outside[f] + ALPHA) / (b + ALPHA))
        tags_in, tags_out = tags_in or Counter(), tags_out or Counter()
        a, b = sum(tags_in.values()) + 1, sum(tags_out.values()) + 1
        for t in {*tags_in, *tags_out}:
            self.tag[t] = max(-8.0, min(-0.05, math.log((tags_in[t] + 0.5) / a) - math.log((tags_out[t] + 0.5) / b)))

    def of(self, features: tuple[str, ...]) -> float:
        """What an element says; nothing, if it was never seen."""
        return min(self.says.get(f, 0.0) for f in features)

    def of_word(self, says: float) -> float:
        return self.word if says > -1 else -self.word * min(3.0, -says / 2)

    def of_form(self, cell: tuple[int, int]) -> float:
        """What the form of a block says of its words, as a factor: of mostly linked ones against them, of others for them."""
        x = self.form.get(cell, -1.0 if cell[0] else 1.0)
        return min(x, 1.0) if cell[0] else max(0.25, min(x, 1.0))

    def of_tag(self, tag: str, says: float) -> float:
        return min(self.tag.get(tag, -0.1), max(says, -8.0) if says <= -1 else -0.05)


def _counts(pages: list[str]) -> tuple[Counter, Counter, Counter, Counter]:
    """Words by features, and tags, within and without the regions of pages that mark it with one article or main element.

    A word without counts only for the outermost element that does not hold the region too, so that what comes in menus and
    articles alike, such as links and lists, says nothing against itself."""
    inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        found = list(events(page))
        opened = Counter(t for kind, t, _ in found if kind == "open")
        mark = next((t for t in LABELS if opened[t] == 1), None)
        if mark is None:
            continue
        path, holders = 0, []  # the elements that hold the region
        for kind, t, _ in found:
            if kind == "open":
                if t == mark:
                    break
                holders.append(path)
            if kind == "close":
                holders.pop()
            path += kind == "open"
        holds, stack, number, within, root = set(holders), [], 0, False, None
        for kind, t, features in found:
            if kind == "open":
                if t == mark:
                    within = True
                elif within:
                    tags_in[t] += 1
                elif root is None:
                    if number not in holds:
                        root = len(stack)
                    if root is None or _telling(features)[0] == t:
                        tags_out[t] += 1
                stack.append([features, 0, t == mark])
                number += 1
            elif kind == "void":
                (tags_in if within else tags_out if root is None else Counter())[t] += 1
            elif kind == "text":
                stack_words = len(t.split())
                if stack:
                    stack[-1][1] += stack_words
                (inside if within else outside)[""] += stack_words
            else:
                features, words, marked = stack.pop()
                if stack:
                    stack[-1][1] += words
                if marked:
                    within = False
                elif within:
                    for f in features:
                        inside[f] += words
                    tags_in["/" + t] += 1
                elif root is None:
                    tags_out["/" + t] += 1
                elif root == len(stack):
                    for f in _telling(features):
                        outside[f] += words
                    if _telling(features)[0] == t:
                        tags_out["/" + t] += 1
                    root = None
    return inside, outside, tags_in, tags_out


def _forms(found: list[tuple[str, str, tuple[str, ...]]], weights: Weights) -> tuple[dict[int, tuple[int, int]], dict[int, int], list[int]]:
    """Of a page: the form of the block of each text; at the start and end of each group that is not all its holder has, the
    words below it that are not mostly linked and not in elements that speak against themselves; the texts of its first h1."""
    cells, walls, heading, block, words, linked, links = {}, {}, [], [], 0, 0, 0
    stack, groups, total = [[-1, "", 0, 0.0]], [], {}
    first = True
    for i, (kind, t, features) in enumerate([*found, ("void", "br", ())]):
        if kind == "text":
            n = len(t.split())
            block.append(i)
            words += n
            linked += n * (links > 0)
            if first and n and any(x[1] == "h1" for x in stack[-3:]):
                heading.append(i)
            continue
        if t in BLOCK and block:
            cell = (min(2, 3 * linked // max(words, 1)), bisect_right(LONG, words))
            cells.update(dict.fromkeys(block, cell))
            if cell[0] == 0 and stack[-1][3] > -1:
                stack[-1][2] += words
            block, words, linked = [], 0, 0
        if kind == "open":
            stack.append([i, t, 0, min(stack[-1][3], weights.of(features))])
            links += t == "a"
        elif kind == "close":
            at, _, n, _ = stack.pop()
            links -= t == "a"
            total[at] = n
            stack[-1][2] += n
            first = first and not (t == "h1" and heading)
            if t in GROUPS:
                groups.append((at, i, n, stack[-1][0]))
    total[-1] = stack[0][2]
    for at, end, n, holder in groups:
        if n < 0.9 * total[holder]:
            walls[at] = walls[end] = n
    return cells, walls, heading


def _masked(found: list[tuple[str, str, tuple[str, ...]]]) -> list[tuple[str, str, tuple[str, ...]]]:
    """A page without its marks and without the classes, ids and roles of its elements."""
    tag = lambda t: "div" if t in LABELS else t
    return [(kind, t, ()) if kind == "text" else (kind, tag(t), tuple(tag(f) for f in features[:1])) for kind, t, features in found]


def _fit_forms(weights: Weights, labelled: list, tried=(0.4, 0.3, 0.2, 0.1, 0.0)) -> None:
    """Learn from labelled pages, masked, what forms of blocks say, and the share of its words that a group costs."""
    inside, outside, pages = Counter({(0, i): 20.0 for i in range(3)}), Counter({(i, j): 20.0 for i in (1, 2) for j in range(3)}), []
    for found, a, b in labelled:
        masked = _masked(found)
        pages.append((masked, a, b))
        for i, cell in _forms(masked, weights)[0].items():
            (inside if a < i < b else outside)[cell] += len(masked[i][1].split())
    p, q = sum(inside.values()), sum(outside.values())
    weights.form = {c: math.log((inside[c] + ALPHA) / (p + ALPHA)) - math.log((outside[c] + ALPHA) / (q + ALPHA)) for c in {*inside, *outside}}
    top = min(1.0, max(weights.form.values()))
    if top > 0:  # words of the form that is most the region's count in full
        weights.form = {c: x / top if x > 0 else x for c, x in weights.form.items()}
    best, chosen = -1.0, weights.share
    for weights.share in tried:
        right, total = _agreement(pages, weights)
        if right / max(total, 1) > best + 1e-9:
            best, chosen = right / max(total, 1), weights.share
    weights.share = chosen


def _agreement(labelled: list, weights: Weights) -> tuple[int, int]:
    """Words that the scan puts where the labels do, of pages (events, start and end of the region), and all words."""
    right = total = 0
    for found, a, b in labelled:
        score = scores(found, weights)
        s, e = region(score)
        for i, (kind, t, _) in enumerate(found):
            if kind == "text":
                n = len(t.split())
                total += n
                right += n * ((a < i < b) == (s <= i < e and score[i] > 0))
    return right, total


def fit(pages: list[str], tried=(1.0, 0.5, 0.25, 2.0)) -> Weights:
    """Weights from labelled pages, which mark their region; other pages are passed over. The weight of a word is the one
    under which the scan finds most of the regions of up to 100 of them, word by word. What holds for pages without a mark
    is learnt from the same ones with marks and names taken away."""
    counts = _counts(pages)
    labelled = []
    for page in pages:
        if len(labelled) == 100:
            break
        found = list(events(page))
        starts = {t: [i for i, e in enumerate(found) if e[:2] == ("open", t)] for t in LABELS}
        mark = next((t for t in LABELS if len(starts[t]) == 1), None)
        if mark:
            a = starts[mark][0]
            depth, b = 0, a
            for b in range(a, len(found)):
                depth += (found[b][0] == "open") - (found[b][0] == "close")
                if not depth:
                    break
            labelled.append((found, a, b))
    best, chosen = -1.0, Weights(*counts)
    for word in tried if labelled else ():
        weights = Weights(*counts, word=word)
        right, total = _agreement(labelled, weights)
        if right / max(total, 1) > best + 1e-9:
            best, chosen = right / max(total, 1), weights
    _fit_forms(chosen, labelled)
    return chosen


def scores(found: list[tuple[str, str, tuple[str, ...]]], weights: Weights) -> list[float]:
    """The score of each event; a text's is the sum of its words'. An element that speaks against itself, such as an advert
    between paragraphs, costs MOST in all, so that the scan can pass it where enough words follow. On a page without article
    and main elements words also go by the form of their block, and groups cost a share of their words to enter or leave."""
    out, stack, root, spent = [], [0.0], None, 0.0
    marked = any(kind == "open" and t in LABELS for kind, t, _ in found)
    cells, walls, heading = ({}, {}, []) if marked else _forms(found, weights)
    titles, title = set(heading), sum(len(found[i][1].split()) for i in heading)
    for i, (kind, t, features) in enumerate(found):
        if kind == "text":
            x = weights.of_word(stack[-1]) * len(t.split())
            if x > 0 and i in cells:
                x *= max(1.0, HEADING / title) if i in titles and cells[i][0] == 0 else weights.of_form(cells[i])
        elif kind == "open":
            own = weights.of(features)
            stack.append(min(stack[-1], own))
            x = weights.of_tag(t, own)
            if root is None and own <= -1:
                root, spent = len(stack), 0.0
        elif kind == "void":
            x = weights.of_tag(t, 0.0)
        else:
            if root == len(stack):
                root = None
            stack.pop()
            x = weights.of_tag("/" + t, 0.0)
        if i in walls:
            x -= weights.share * weights.word * min(walls[i], HOLD)
        if root is not None and x < 0:
            x = min(max(x, spent - MOST), -1e-3)
            spent = min(MOST, spent - x)
        out.append(x)
    return out


def region(score: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, in one pass; of equal ones the first, empty if no sum is positive."""
    best, here, start, span = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(score):
        if here <= 0:
            here, start = 0.0, i
        here += x
        if here > best:
            best, span = here, (start, i + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region, without texts in it whose own score is negative, such as adverts between paragraphs."""
    found = list(events(page or ""))
    score = scores(found, weights)
    a, b = region(score)
    blocks, now = [], []
    for i in range(a, b + 1):
        kind, t, _ = found[i] if i < b else ("void", "p", ())
        if kind == "text":
            if score[i] >= 0:
                now.append(t)
        elif t in BLOCK:
            if now:
                text = WHITE.sub(" ", entities.unescape("".join(now))).strip()
                if text:
                    blocks.append(text)
            now = []
    return "\n".join(blocks)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Weights come from `sample` pages at most, taken by a hash of page_id from those that mark their article. Null and empty
    pages, and pages without words, have empty text. Whole pages are read, however long, in one pass each. Repeated rows
    come as often as they are there; an empty table gives an empty result; other columns are ignored.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("page_id", F.xxhash64("page_id").alias("h"), "html")
    # the hashes first, so that tasks send the driver hashes and only the sample's pages
    least = marked.select("h").orderBy("h").limit(sample).collect()
    chosen = marked.where(F.col("h") <= least[-1].h).orderBy("h", "page_id", "html").limit(sample).collect() if least else []
    weights = fit([r.html for r in chosen])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                text = [main_text(x, weights) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
