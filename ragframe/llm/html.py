"""Main text of web pages by wrappers inferred for each host.

A page is read into a tree of block elements whose leaves are texts. Its sibling lists
are folded: repeated runs of siblings become repeated groups. Pages of one host are
aligned one after the other with the host's wrapper, a union-free regular expression
over such trees: siblings that match are merged level by level, those that only one
side has become optional groups, and texts become slots with what is known of them
(whether different pages have it, whether the text never changes).

Every page is aligned with its host's wrapper once more. The article is in all its article
(else main, else content) elements, or without one in slots whose text changes from page
to page, outside menus, headers, footers, sidebars, notices, adverts, forms and comments.
Within it the wrapper says what is the template's, the readers' or a teaser (:func:`decide`).

A task folds its pages of a host into one wrapper before anything is shuffled, so only
wrappers move, and a host with a third of all pages is no hot group. Partial wrappers
are merged in two steps, first those of a share of the tasks."""

from __future__ import annotations

import json
import re
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragframe.llm.common import grouped, shared_table, text_batches
from ragframe.llm.urlfilter import host_and_path

#: Hosts whose wrappers a task holds before it hands them on.
HELD_HOSTS = 512
#: Bytes of all wrappers up to which they are broadcast; beyond it pages and wrappers are joined by host.
BROADCAST_BYTES = 16 << 20
#: Elements nested deeper are read as part of their ancestor at this depth.
MAX_DEPTH = 60
#: Most cells (bits) of one alignment table; longer sibling lists are halved (Hirschberg), so memory stays linear.
MAX_CELLS = 1 << 24
#: Longest group of siblings that is looked for as a repeated group.
MAX_PERIOD = 4

# ---- fixed values: elements and words that mark what is not the article ----------------
INLINE = set("""a abbr acronym b basefont bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta
    nobr output picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr""".split())
RAW = set("script style noscript template textarea iframe svg math xmp noembed noframes object select head title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = set("nav footer aside form button menu dialog fieldset legend header datalist dir".split())
STRONG = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar
    navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr comment comments reply replies respond
    discussion disqus newsletter subscribe signup login search form pagination pager popup modal related recommended
    copyright advertisment adsbygoogle contentinfo complementary""".split())
WEAK = set("header masthead side sidebar banner share sharing social widget notice notices notification alert toolbar skip overlay".split())
GOOD = set("article content main post entry story body text".split())
MARKING = STRONG | WEAK | GOOD
CLOSES_P = set("""address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table td th tr ul""".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
REPEATS = set("# p li dt dd tr td th option".split())
BLOCKS = {"div", "section", "td", "th", "tr", "tbody", "table", "center", "figure", "blockquote", "dl", "ul", "ol", "li", "dd"}
CONTENT = {"article", "content", "entry", "story", "post"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPES = {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "div", "article", "section", "body"}
# ------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_BODY_START = re.compile(r"<body[\s>]", re.I)


def _signature(tag: str, attrs: str) -> str:
    """Tag and the words of its class, role and itemprop; digits do not count. Of an
    element that can hold the article only the words that say so count, of an id those
    that mark an element, and none of a heading's, which is the name of a place."""
    if not attrs or "=" not in attrs:
        return tag
    words = set()
    for name, v in _ATTR.findall(attrs):
        new = {w.lower() for w in _NAME.findall(v)}
        words |= new if name.lower() != "id" else set() if tag in HEADINGS else new & MARKING
    sig = ".".join([tag, *sorted(words)])
    if tag == "header" or tag in ASIDE_TAGS or _marked(sig):
        return sig
    return {3: tag if tag == "article" else f"{tag}.article.body", 2: tag if tag == "main" else f"{tag}.main", 1: f"{tag}.content", 0: sig}[_kind(sig)]


def _kind(sig: str) -> int:
    """What an element's own words name it: 3 article, 2 main, 1 content, else 0."""
    tag, *words = sig.split(".")
    if tag == "article":
        return 3
    if tag == "main":
        return 2
    if tag not in BLOCKS:
        return 0
    return 3 if "articlebody" in "".join(words) else 2 if "main" in words else 1 if tag in ("div", "section", "td") and CONTENT & set(words) else 0


def _marked(sig: str) -> bool:
    """Whether an element's own words name it as something beside the article."""
    tag, *words = sig.split(".")
    if tag in ("html", "body", "main", "article"):
        return False
    words = set(words)
    return bool(words & STRONG) or bool(words & WEAK) and not words & GOOD


def read_page(html: str | None) -> tuple[list, list[str]]:
    """(tree, texts). A node is [signature, children, repeated, optional, info]; a text
    leaf's signature is ``#`` and its info the list of its places in ``texts``."""
    html = html or ""
    texts: list[str] = []
    root: list = ["", [], False, False, None]
    # elements deeper than MAX_DEPTH are open like the others, but stand for their ancestor
    stack, names, parts, pos = [root], [""], [], 0
    is_open: dict[str, int] = {}

    def close_from(at):
        for n in names[at:]:
            is_open[n] -= 1
        del stack[at:], names[at:]

    def text_ends():
        if parts:
            t = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if t:
                kids = stack[-1][1]
                kids.append(["#", [], False, False, [len(texts)]])
                texts.append(t)

    while pos < len(html):
        m = _TOKEN.search(html, pos)
        if m is None:
            parts.append(html[pos:])
            break
        if m.start() > pos:
            parts.append(html[pos:m.start()])
        pos = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if close:
                continue
            if attrs.rstrip().endswith("/"):
                continue
            if tag != "select" and tag != "object":
                text_ends() if tag in ("head", "title") else None
            end = _END[tag].search(html, pos)
            if tag == "head":
                body = _BODY_START.search(html, pos)
                if end is None or body is not None and body.start() < end.start():
                    pos = body.start() if body is not None else pos
                    continue
            pos = end.end() if end else len(html)
            continue
        sig = tag if close else _signature(tag, attrs)
        if tag in INLINE and not (close and is_open.get(tag)) and (close or not _marked(sig)):
            if tag == "br":
                parts.append(" ")
            continue
        text_ends()
        if close:
            if is_open.get(tag):
                close_from(next(at for at in range(len(names) - 1, 0, -1) if names[at] == tag))
            continue
        if tag in ("html", "body"):
            continue
        for ends in ({"p"} if tag in CLOSES_P else (), SELF_CLOSING.get(tag, ())):
            if not any(is_open.get(e) for e in ends):
                continue
            for at in range(len(names) - 1, 0, -1):
                if names[at] in ends:
                    close_from(at)
                    break
                if names[at] in SCOPES:
                    break
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in CLOSES_P:
            continue
        if len(stack) > MAX_DEPTH:
            stack.append(stack[-1])
        else:
            node = [sig, [], False, False, 1]
            stack[-1][1].append(node)
            stack.append(node)
        names.append(tag)
        is_open[tag] = is_open.get(tag, 0) + 1
    text_ends()
    return _fold(root[1]), texts


def _same(a: list, b: list) -> bool:
    return a[0] == b[0]


def _alike(a: list, b: list) -> bool:
    """Whether siblings can be one repeated group: equal signatures, and where these
    say little (no class, no item of a list or table) equal children too."""
    return a[0] == b[0] and (a[0] in REPEATS or "." in a[0] or [k[0] for k in a[1]] == [k[0] for k in b[1]])


def _fold(kids: list) -> list:
    """Siblings with repeated runs merged into repeated groups; empty elements left out."""
    out: list = []
    for k in kids:
        if k[0] != "#":
            k[1] = _fold(k[1])
            if not k[1]:
                continue
        if out and _alike(out[-1], k):
            out[-1] = _merged(out[-1], k)
            out[-1][2] = True
        else:
            out.append(k)
    for size in range(2, MAX_PERIOD + 1):
        i = 0
        while i + 2 * size <= len(out):
            first = out[i:i + size]
            times = 1
            while i + (times + 1) * size <= len(out) and all(map(_alike, first, out[i + times * size:i + (times + 1) * size])):
                times += 1
            if times > 1:
                for t in range(1, times):
                    first = [_merged(a, b) for a, b in zip(first, out[i + t * size:i + (t + 1) * size])]
                out[i:i + times * size] = [["(" + " ".join(x[0] for x in first) + ")", first, True, False, times]]
            i += 1
    return out


def _rows(x: list[str], y: list[str]):
    """For each prefix of x (none first) the places of y, as zero bits, at which a longest
    common subsequence with the prefixes of y grows (Hyyro's bit-parallel form)."""
    places: dict[str, int] = {}
    for j, k in enumerate(y):
        places[k] = places.get(k, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    yield row
    for k in x:
        hit = row & places.get(k, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(x: list[str], y: list[str]) -> list[int]:
    """Length of a longest common subsequence of x and each prefix of y."""
    for row in _rows(x, y):
        pass
    return [0, *accumulate(c == "0" for c in reversed(f"{row:0{len(y)}b}"))] if y else [0]


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, exact at any length."""
    if not x or not y:
        return []
    if len(x) * len(y) > MAX_CELLS and len(x) > 1:
        half = len(x) // 2
        left, right = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
        cut = max(range(len(y) + 1), key=lambda j: left[j] + right[len(y) - j])
        return _common(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in _common(x[half:], y[cut:])]
    rows, i, j, out = list(_rows(x, y)), len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of siblings of both lists that are aligned: a longest common subsequence."""
    n, m = len(a), len(b)
    low = 0
    while low < min(n, m) and _same(a[low], b[low]):
        low += 1
    end = 0
    while end < min(n, m) - low and _same(a[n - 1 - end], b[m - 1 - end]):
        end += 1
    out = [(i, i) for i in range(low)]
    x, y = a[low:n - end], b[low:m - end]
    out += [(low + i, low + j) for i, j in _common([k[0] for k in x], [k[0] for k in y])]
    return out + [(n - e, m - e) for e in range(end, 0, -1)]


def _info(a, b):
    """Of leaves: places of a page's texts, or (hash of the only page that has it or None,
    hash of the whole text or None if it changes, characters in all). Copies of a page are
    one page. Of elements: how often they occur."""
    if isinstance(a, (list, int)):
        return a + b
    return (*(x if x == y else None for x, y in zip(a[:2], b[:2])), a[2] + b[2])


def _merged(a: list, b: list) -> list:
    return [a[0], align(a[1], b[1]), a[2] or b[2], a[3] or b[3], _info(a[4], b[4])]


def align(a: list, b: list) -> list:
    """The wrapper of two sibling lists: matches merged, the rest optional."""
    if not a and not b:
        return []
    out, i, j = [], 0, 0
    for x, y in [*_pairs(a, b), (len(a), len(b))]:
        for k in a[i:x] + b[j:y]:
            out.append([k[0], k[1], k[2], True, k[4]])
        if x < len(a):
            out.append(_merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _hash(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "replace"))


def to_wrapper(tree: list, texts: list[str], page: str | None = None) -> list:
    """One page's wrapper: leaves know their page and their unchanging text by hashes."""
    page = _hash("\0".join(texts)) if page is None else page

    def leaf(places):
        return page, _hash("\0".join(texts[p] for p in places)), sum(len(texts[p]) for p in places)
    return [[k[0], to_wrapper(k[1], texts, page), k[2], k[3], leaf(k[4]) if k[0] == "#" else k[4]] for k in tree]


def _from_json(kids: list) -> list:
    return [[s, _from_json(c), p, o, tuple(i) if isinstance(i, list) else i] for s, c, p, o, i in kids]


def load_wrapper(text: str) -> list:
    return _from_json(json.loads(text))


def _has(node: list, tags: tuple[str, ...]) -> bool:
    return any(k[0].split(".")[0] in tags or _has(k, tags) for k in node[1])


def _beside(node: list, inside: bool) -> bool:
    """Whether an element is no part of the article; ``inside``: it lies in the article."""
    sig = node[0]
    tag = sig.split(".")[0]
    if sig[:1] in "#(":
        return False
    if tag == "header":
        return not (inside and _has(node, ("h1", "h2")))
    return tag in ASIDE_TAGS or _marked(sig)


def _slots(node: list) -> list:
    return ([node] if node[0] == "#" else []) + [s for k in node[1] for s in _slots(k)]


def _tag(node: list) -> str:
    return node[0].split(".")[0]


def _template(node: list) -> bool:
    """Whether a container holds the same texts on all its pages, two different ones at least."""
    slots = _slots(node)
    return _tag(node) in ("div", "section") and all(s[4][0] is None and s[4][1] is not None for s in slots)


def _items(node: list):
    """The repeated containers right below an element (or below a group of them)."""
    for k in node[1]:
        if k[0][:1] == "(":
            yield from _items(k)
        elif k[2] and _tag(k) in ("div", "section", "article", "li"):
            yield k


def _by_readers(node: list) -> bool:
    """Whether an optional element inside the article holds what readers wrote: a list of
    containers, each with a name or time beside its text, and no heading or table."""
    return (node[3] and _tag(node) in ("div", "section", "ol", "ul") and any(len(_slots(i)) > 1 for i in _items(node))
            and not _has(node, (*sorted(HEADINGS), "table", "dl", "pre", "figure", "blockquote")))


def _chars(node: list) -> float:
    """Characters in one occurrence of an element, on average."""
    return sum(s[4][2] for s in _slots(node)) / max(node[4], 1)


def decide(wrapper: list) -> list:
    """The wrapper with a truth value in place of each node's info: whether an element is
    no part of the article, and whether a slot's text is the same on all its pages.

    Slots and groups decide first: a container inside the article whose texts are the same
    on different pages is the template's, an optional list of containers behind the
    article's own paragraphs is its readers', and repeated articles with less than half of
    the text of the host's single one are teasers. What an element's words say comes second."""
    every = [s for k in wrapper for s in _slots(k)]
    changing = any(s[4][:2] == (None, None) for s in every)

    def articles(kids, repeated, inside):
        for k in kids:
            if k[0] != "#" and not _beside(k, inside):
                if _kind(k[0]) == 3:
                    yield k, repeated or k[2]
                else:
                    yield from articles(k[1], repeated or k[2], inside or _kind(k[0]) > 0)

    found = list(articles(wrapper, False, False))
    single = max((_chars(k) for k, repeated in found if not repeated), default=0)
    teasers = {id(k) for k, repeated in found if repeated and 2 * _chars(k) < single}

    def go(kids, inside):
        out, own = [], False
        for k in kids:
            if k[0] == "#":
                value = changing and k[4][0] is None and k[4][1] is not None
            else:
                value = _beside(k, inside) or id(k) in teasers or inside and (_template(k) or own and _by_readers(k))
                own = own or _tag(k) == "p" or "p" in k[0].strip("()").split(" ")
            out.append([k[0], go(k[1], inside or _kind(k[0]) > 0), k[2], k[3], value])
        return out
    return go(wrapper, False)


def extract(html: str | None, decided: list) -> str:
    """The kept texts of one page, joined by an empty line."""
    tree, texts = read_page(html)
    found: list[tuple[list[int], set[int], bool]] = []  # places, kinds of elements around them, unchanging

    def go(wrapper, kids, kinds):
        """What the wrapper does not match is judged by its own and its ancestors' words."""
        match = {y: wrapper[x] for x, y in _pairs(wrapper, kids)}
        for y, k in enumerate(kids):
            w = match.get(y)
            if k[0] == "#":
                found.append((k[4], kinds, w is not None and w[4]))
            elif not (_beside(k, len(kinds) > 1) if w is None else w[4]):
                go(w[1] if w else [], k[1], kinds | {_kind(k[0])})
    go(decided, tree, {0})
    kind = max((k for _, kinds, _ in found for k in kinds), default=0)
    kept = {p for places, kinds, fixed in found if (kind in kinds if kind else not fixed) for p in places}
    return "\n\n".join(t for i, t in enumerate(texts) if i in kept)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, decided) from (host, html): one row per host."""
    def fold(batches):
        held: dict[str, list] = {}
        share = TaskContext.get().partitionId() % 32

        def out():
            rows = [(h, share, json.dumps(w)) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))], ["host", "share", "wrapper"])

        for batch in text_batches(batches, 1):
            for host, html in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda x: (x[0], _hash(x[1]))):
                one = to_wrapper(*read_page(html))
                held[host] = align(held[host], one) if host in held else one
            if len(held) > HELD_HOSTS:
                yield out()
        if held:
            yield out()

    def merge(last):
        def run(key, group):
            whole = None
            for w in group.column("wrapper").to_pylist():
                one = load_wrapper(w)
                whole = one if whole is None else align(whole, one)
            result = json.dumps(decide(whole) if last else whole)
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([result])], ["host", "decided" if last else "wrapper"])
        return run

    parts = pages.select("host", "html").mapInArrow(fold, "host string, share int, wrapper string")
    # in an order of their own, so that a task that is run again gives the same wrapper
    some = grouped(parts, ["host", "share"], merge(False), "host string, wrapper string", order=["wrapper"])
    return grouped(some, ["host"], merge(True), "host string, decided string", order=["wrapper"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text and n_chars (its code points).

    Null and empty html give an empty text. Pages with a null url or one without a host
    share the empty host's wrapper. Repeated pages are returned as often as given; an
    empty table gives no rows. Character references are decoded, white space inside a
    block is one space, blocks are joined by two newlines."""
    host, _ = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"))
    wrappers = shared_table(infer_wrappers(rows), "wrappers")
    size = wrappers.agg(F.sum(F.octet_length("decided") + F.octet_length("host"))).first()[0] or 0
    known = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "decided")
    schema = T.StructType([*joined.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        loaded: dict[str, list] = {}
        for batch in text_batches(batches, 2):
            texts = []
            for html, decided in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if decided not in loaded:
                    if len(loaded) >= HELD_HOSTS:
                        loaded.clear()
                    loaded[decided] = json.loads(decided)
                texts.append(extract(html, loaded[decided]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, schema)
