"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of block tags and ``#`` for text, which carries the elements open around it. Tandem repeats fold
into groups ``( ... )+``; the streams of a host are then aligned one after another, and what only some of them hold
becomes an optional group ``( ... )?``. A text is only aligned with a text in the same elements. Hosts of many streams
are aligned in rounds of bounded groups. Walking the pages of a host along its wrapper fills the wrapper's text slots: a
text that nearly all of the host's pages have in the same slot belongs to the template and goes, what varies is content.
Text in a menu, a header, a form or the like goes whatever it says, as such parts vary between pages as well; that is
told by the elements of the page itself, so no other page can take its text away but by having the same. A page that
doesn't fit its wrapper, or has no siblings to be compared with, is read by its elements alone.

Cases: null or empty html gives an empty text; pages without host aren't compared, as they aren't of one site; unclosed
tags, scripts and comments end where the page ends; repeated rows each get their text and count as one page for the
template; on a host whose pages are mostly the same text (copies of one article) template and content can't be told
apart, so the elements decide alone; an empty table gives no rows; pages of any length are read whole and aligned with
the others of their host; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import itertools
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidy

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_IMPLIED_END = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
#: Opening tags and the open elements that they end.
_ENDS = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}),
    **dict.fromkeys(("dt", "dd"), frozenset({"dt", "dd", "p"})),
    **dict.fromkeys(("td", "th"), frozenset({"td", "th"})),
    "tr": frozenset({"td", "th", "tr"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), frozenset({"td", "th", "tr", "thead", "tbody", "tfoot"})),
    "option": frozenset({"option"}),
}
#: Open elements that such a tag looks past.
_PASSED = _INLINE | _IMPLIED_END | {"div", "address"}
_MAIN = ("article", "main")
_NOISE_TAGS = frozenset("nav header footer aside form menu dialog button select textarea fieldset head title".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored banner promo cookie cookies consent notice notices alert sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs "
    "comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe signup popup modal footer header masthead widget toolbar pagination".split()
)
#: Compounds that name no part of their first or last word: states, layouts of a page, parts of an article.
_NO_PART_BEFORE = frozenset("has no not with without is hide show".split())
_NO_PART_AFTER = frozenset("open closed enabled disabled on off work works".split())
_ARTICLE_WORDS = frozenset("article entry post content story section".split())
#: Streams whose lengths multiply to more than this are cut into smaller pairs before they are aligned.
ALIGN_WHOLE = 1 << 20
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

Item = str | tuple


def _names_noise(word: str) -> bool:
    """Whether a class word is a noise word, or a compound that begins or ends with one: ``ad-box``, ``site-footer``."""
    if word in _NOISE_WORDS:
        return True
    parts = [p for p in re.split("[-_]+", word) if p]
    if len(parts) < 2 or parts[0] in _NO_PART_BEFORE or parts[-1] in _NO_PART_AFTER:
        return False
    if parts[-1] == "header" and parts[0] in _ARTICLE_WORDS:
        return False
    return parts[0] in _NOISE_WORDS or parts[-1] in _NOISE_WORDS


def _is_noise(name: str, attrs: str) -> bool:
    if name in ("html", "body"):
        return False
    return any(_names_noise(w) for g in _ATTR.findall(attrs) for w in "".join(g).lower().split()) or bool(_HIDDEN.search(attrs))


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(token, text): block tags such as ``<p>``, ``</div>``, and ``#`` with its text.

    An element that is noise by its class is the one token ``<div!>`` with all it holds, of whatever kind it is: open
    elements are followed, so that it also ends where its end is only implied, at a sibling or at its parent's end. A
    possible main region goes on to ``</article!>``, as only the page as a whole says whether it is one.
    """
    pending: list[str] = []
    stack: list[str] = []  # open elements; inline ones only within noise
    count: dict[str, int] = {}
    noise = -1  # where in the stack the outermost noisy element is

    def close(k: int) -> Iterator[tuple[str, str]]:
        """Ends the open elements from place ``k`` on."""
        nonlocal noise
        if 0 <= noise and k <= noise:
            if stack[noise] in _MAIN:
                yield f"</{stack[noise]}!>", ""
            noise = -1
        for e in stack[k:]:
            count[e] -= 1
        del stack[k:]

    def left_out() -> bool:
        return noise >= 0 and stack[noise] not in _MAIN

    for m in _TOKEN.finditer(page):
        if (t := m["text"]) is not None:
            pending.append(t)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        inline = name in _INLINE
        noisy = False
        if not closing and attrs and noise < 0:
            noisy = _is_noise(name, attrs)
        if inline and (name in _VOID or noise < 0 and not noisy):
            continue
        at = -1
        if closing and count.get(name):
            at = len(stack) - 1 - stack[::-1].index(name)
        if inline and closing and at != noise:
            # an inline element within noise, or one that was opened before it
            if at > noise:
                yield from close(at)
            continue
        if inline and not noisy and not closing:
            stack.append(name)
            count[name] = count.get(name, 0) + 1
            continue
        if pending and not left_out() and (text := "".join(pending)).strip():
            yield "#", text
        pending = []
        if closing:
            ends_noise = 0 <= at == noise
            if at >= 0:
                yield from close(at)
            if not ends_noise and not left_out() and name not in _IMPLIED_END and name not in _VOID:
                yield f"</{name}>", ""
            continue
        ended = _ENDS.get(name, ())
        if any(count.get(e) for e in ended):
            k = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in ended:
                    k = i
                elif stack[i] not in _PASSED:
                    break
            yield from close(k)
            if attrs and not noisy and noise < 0:
                noisy = _is_noise(name, attrs)
        if name not in _VOID:
            if not left_out():
                yield f"<{name}{'!' * noisy}>", ""
            if noisy:
                noise = len(stack)
            stack.append(name)
            count[name] = count.get(name, 0) + 1
    if pending and not left_out() and (text := "".join(pending)).strip():
        yield "#", text


def fold(stream: list[Item], longest: int = 24) -> list[Item]:
    """Tandem repeats, short ones first, become ``("+", items)``."""
    for size in range(1, longest + 1):
        out: list[Item] = []
        i = 0
        while i < len(stream):
            block = stream[i : i + size]
            j = i + size
            while len(block) == size and stream[j : j + size] == block:
                j += size
            if j > i + size and "#" != block[0][0]:
                out.append(("+", tuple(block)))
                i = j
            else:
                out.append(stream[i])
                i += 1
        stream = out
    return stream


def _grouped(side: list[tuple[Item, bool]], groups: list[tuple]) -> list[tuple[Item, bool]]:
    """One occurrence of a block that the other side repeats counts as a repeat."""

    def places() -> dict[Item, list[int]]:
        found: dict[Item, list[int]] = {}
        for i, (it, _) in enumerate(side):
            found.setdefault(it, []).append(i)
        return found

    where = places()
    for g in dict.fromkeys(groups):
        body, hits = list(g[1]), []  # hits: start and length
        for i in sorted(where.get(g, []) + where.get(body[0], [])):
            if hits and i < hits[-1][0] + hits[-1][1]:
                continue
            one = [it for it, _ in side[i : i + len(body)]] == body
            if one or side[i][0] == g:
                hits.append((i, len(body) if one else 1))
        if all(side[i][0] == g for i, _ in hits) and all(i + n != k for (i, n), (k, _) in itertools.pairwise(hits)):
            continue  # nothing to change
        out: list[tuple[Item, bool]] = []
        at = 0
        for i, n in hits:
            out += side[at:i]
            optional = all(o for _, o in side[i : i + n])
            if out and out[-1][0] == g:
                out[-1] = (g, out[-1][1] and optional)
            else:
                out.append((g, optional))
            at = i + n
        side = out + side[at:]
        where = places()
    return side


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places, rising in both, where something begins that each of the two holds once: an item, else 2, 4 ... 64 of them."""
    size = 1
    while size <= 64 and size <= min(len(a), len(b)):
        once_a, once_b = Counter(a), Counter(b)
        at = {x: k for k, x in enumerate(b) if once_b[x] == 1}
        both = [(i, at[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in at]
        if both:
            # the longest rising sequence
            ends: list[int] = []
            last: list[int] = []
            before: list[int] = []
            for n, (_, j) in enumerate(both):
                k = bisect_left(ends, j)
                before.append(last[k - 1] if k else -1)
                ends[k : k + 1] = [j]
                last[k : k + 1] = [n]
            n, out = last[-1], []
            while n >= 0:
                out.append(both[n])
                n = before[n]
            return out[::-1]
        names: dict[tuple[int, int], int] = {}
        a, b = ([names.setdefault(x, len(names)) for x in zip(s, s[size:], strict=False)] for s in (a, b))
        size *= 2
    return []


def equal_blocks(one: list[Item], two: list[Item], whole: int = ALIGN_WHOLE) -> list[tuple[int, int, int]]:
    """Start in ``one``, start in ``two`` and length of what is aligned, in order. A pair of long streams is cut at places that
    surely belong together, or in halves where there are none, until its pieces can be compared whole; nothing is left out."""
    names: dict[Item, int] = {}
    a, b = ([names.setdefault(x, len(names)) for x in s] for s in (one, two))
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if (j - i) * (m - k) > whole:
            n = next((n for n, (x, y) in enumerate(zip(a[i:j], b[k:m], strict=False)) if x != y), min(j - i, m - k))
            if n:
                out.append((i, k, n))
                i, k = i + n, k + n
            n = next((n for n, (x, y) in enumerate(zip(reversed(a[i:j]), reversed(b[k:m]), strict=False)) if x != y), min(j - i, m - k))
            if n:
                out.append((j - n, m - n, n))
                j, m = j - n, m - n
        if (j - i) * (m - k) <= whole or j - i < 2 or m - k < 2:
            out += [(i + x, k + y, n) for x, y, n in difflib.SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks() if n]
            continue
        size, x, y = (j - i) * (m - k), i, k
        for p, q in [*((i + p, k + q) for p, q in _anchors(a[i:j], b[k:m])), (j, m)]:
            if p < j:
                out.append((p, q, 1))
            if (p - x) * (q - y) > max(whole, size * 7 // 8):
                half, other = (x + p) // 2, (y + q) // 2
                todo += [(x, half, y, other), (half, p, other, q)]
            elif x < p and y < q:
                todo.append((x, p, y, q))
            x, y = p + 1, q + 1
    return sorted(out)


def align(wrapper: list[tuple[Item, bool]], stream: list[Item], optional: list[bool] | None = None) -> list[tuple[Item, bool]]:
    """The wrapper, (item, optional) in order, generalised so that it also reads ``stream``, itself a wrapper if ``optional`` is given."""
    other = list(zip(stream, optional or [False] * len(stream), strict=True))
    mine = {i for i, _ in wrapper}
    wrapper = _grouped(wrapper, [s for s in stream if isinstance(s, tuple) and s not in mine])
    other = _grouped(other, [i for i, _ in wrapper if isinstance(i, tuple)])
    out: list[tuple[Item, bool]] = []
    i = k = 0
    for j, m, n in [*equal_blocks([w[0] for w in wrapper], [o[0] for o in other]), (len(wrapper), len(other), 0)]:
        out += [(it, True) for it, _ in wrapper[i:j] + other[k:m]]
        out += [(w[0], w[1] or o[1]) for w, o in zip(wrapper[j : j + n], other[m : m + n], strict=True)]
        i, k = j + n, m + n
    return out


def show(wrapper: list[tuple[Item, bool]]) -> str:
    """The wrapper as a regular expression over tags."""
    one = lambda it: (it if it[0] == "<" else "#") if isinstance(it, str) else "(" + "".join(map(one, it[1])) + ")+"
    return "".join(f"({one(i)})?" if o else one(i) for i, o in wrapper)


class Region:
    """Follows open elements and says whether text at this point is main text."""

    def __init__(self, main: str | None):
        self.main, self.inside, self.noise = main, 0, []

    def step(self, token: str) -> None:
        if token[1] != "/":
            # noise by class keeps its mark in the name; but for main regions it has no inside here
            name = token[1:-1]
            if name.endswith("!") and name[:-1] not in _MAIN:
                return
            if self.noise:
                if name == self.noise[0]:
                    self.noise.append(name)
            elif name == self.main and not self.inside:
                self.inside = 1
            elif name.endswith("!") or name in _NOISE_TAGS:
                if name.rstrip("!") != self.main or self.inside:
                    self.noise = [name]
            elif name == self.main:
                self.inside += 1
        else:
            name = token[2:-1]
            if self.noise:
                if name == self.noise[0]:
                    self.noise.pop()
                elif name in ("body", "html") or name == self.main:
                    self.noise = []
                    self.step(token)
            elif name == self.main and self.inside:
                self.inside -= 1

    def here(self) -> bool:
        return not self.noise and (self.main is None or self.inside > 0)


def _main_tag(stream: list[tuple[str, str]]) -> str | None:
    """The element whose text is main text: an article or main element, else the one such element that is marked as noise by
    its class, if it holds most of the page's text."""
    names = {t for t, _ in stream}
    if plain := next((m for m in _MAIN if f"<{m}>" in names), None):
        return plain
    for m in _MAIN:
        if sum(t == f"<{m}!>" for t, _ in stream) == 1:
            at = next(k for k, (t, _) in enumerate(stream) if t == f"<{m}!>")
            end = next((k for k, (t, _) in enumerate(stream) if k > at and t == f"</{m}!>"), len(stream))
            region, rest = Region(None), 0
            for k, (t, text) in enumerate(stream):
                if t != "#":
                    region.step(t)
                elif not at < k < end and region.here():
                    rest += len(text)
            if sum(len(text) for t, text in stream[at:end] if t == "#") > rest:
                return f"{m}!"
    return None


def placed(page: str) -> list[tuple[str, str, bool]]:
    """(item, text, whether it is main text) of a page: tags, and ``#`` with the names of the elements open around a text."""
    stream = list(tokens(page))
    region, around, out = Region(_main_tag(stream)), [], []
    for t, text in stream:
        if t == "#":
            out.append(("#" + ">".join(around), text, region.here()))
            continue
        region.step(t)
        name = t.strip("</>")
        if t[1] != "/":
            if name.rstrip("!") not in _IMPLIED_END and (not name.endswith("!") or name[:-1] in _MAIN):
                around.append(name)
        elif name in around:
            del around[len(around) - 1 - around[::-1].index(name) :]
        out.append((t, "", False))
    return out


def numbered(wrapper: list[tuple[Item, bool]]) -> list:
    """Wrapper items as lists; a text slot becomes ``#``, its number, a blank and the elements around it."""
    slots = itertools.count()

    def mark(it: Item) -> list | str:
        if isinstance(it, tuple):
            return ["+", [mark(x) for x in it[1]]]
        return f"#{next(slots)} {it[1:]}" if it[0] == "#" else it

    return [[mark(i), o] for i, o in wrapper]


class Walk:
    """A numbered wrapper, made ready for being read along: where each first token stands, and the next item that must come."""

    def __init__(self, items: list):
        self.items = [it for it, _ in items]
        self.where: dict[str, list[int]] = {}
        self.must = [len(items)] * (len(items) + 1)
        for n in range(len(items) - 1, -1, -1):
            self.must[n] = self.must[n + 1] if items[n][1] else n
        for n, it in enumerate(self.items):
            self.where.setdefault(self._first(it), []).append(n)

    def _first(self, it: list | str) -> str:
        while not isinstance(it, str):
            it = it[1][0]
        return it if it[0] == "<" else "#" + it.split(" ", 1)[1]

    def slots(self, stream: list[tuple[str, str, bool]]) -> list[int] | None:
        """The slot of each text if the stream fits the wrapper, reading left to right without going back, else None."""
        at, slots = 0, []

        def read(it: list | str) -> bool:
            nonlocal at
            if at == len(stream) or stream[at][0] != self._first(it):
                return False
            if isinstance(it, str):
                if it[0] == "#":
                    slots.append(int(it[1:].split(" ", 1)[0]))
                at += 1
                return True
            while at < len(stream) and stream[at][0] == self._first(it):
                for x in it[1]:
                    if not read(x):
                        return False
            return True

        n = 0
        while at < len(stream):
            places = self.where.get(stream[at][0], [])
            k = bisect_left(places, n)
            if k == len(places) or self.must[n] < places[k] or not read(self.items[places[k]]):
                return None
            n = places[k] + 1
        return slots if self.must[n] == len(self.items) else None


def _alone(stream: list[tuple[str, str]]) -> list[str]:
    region, kept = Region(_main_tag(stream)), []
    for t, text in stream:
        if t == "#":
            if region.here():
                kept.append(text)
        else:
            region.step(t)
    return kept


def _clean(block: str) -> str:
    return " ".join(html.unescape(block).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def _tuples(x: list) -> list[Item]:
    return [i if isinstance(i, str) else (i[0], tuple(_tuples(i[1]))) for i in x]


def infer_wrappers(pages: DataFrame, group: int = 64) -> DataFrame:
    """host, expression (readable), wrapper (json). Equal streams are counted once; of a host's streams about ``group`` at a
    time are aligned to one, and those again, until each host has one."""

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[bytes] = set()
        for b in batches:
            folded = {(h, tuple(fold([t for t, _, _ in placed(p)]))) for h, p in zip(b["host"], b["html"], strict=True) if p}
            out = {(h, json.dumps([[i, False] for i in stream])) for h, stream in folded}
            named = {hashlib.blake2b("\n".join(x).encode("utf-8", "surrogatepass"), digest_size=16).digest(): x for x in out}
            fresh = [x for k, x in named.items() if k not in met]
            met = (met if len(met) < 10_000 else set()) | set(named)
            yield pd.DataFrame(sorted(fresh), columns=["host", "part"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [json.loads(p) for p in sorted(set(pdf["part"]), key=lambda s: (-len(s), s))]
        wrapper = [(_tuples([i])[0], o) for i, o in rows[0]]
        for other in rows[1:]:
            wrapper = align(wrapper, _tuples([i for i, _ in other]), [o for _, o in other])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [json.dumps(wrapper)]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [[(_tuples([i])[0], o) for i, o in json.loads(p)] for p in b["part"]]
            yield pd.DataFrame({"host": b["host"], "expression": [show(r) for r in rows], "wrapper": [json.dumps(numbered(r)) for r in rows]})

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").where("host != ''").mapInPandas(tidy(streams), "host string, part string")
    while True:
        parts = materialize(parts.distinct(), "html-parts")
        per_host = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        if (per_host.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        salt = F.pmod(F.xxhash64("part"), F.ceil(F.col("n") / group)).alias("salt")
        parts = parts.join(per_host, "host").select("host", "part", salt).groupBy("host", "salt").applyInPandas(merge, "host string, part string")
    return parts.mapInPandas(tidy(finish), "host string, expression string, wrapper string")


def read_blocks(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, host, blocks: array<struct<slot, text>> of what isn't noise by its tags; slot -1: read without wrapper."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Walk] = {}
        held = 0
        for b in batches:
            blocks = []
            for page, wrapper in zip(b["html"], b["wrapper"], strict=True):
                stream = placed(page) if page else []
                slots = None
                if wrapper is not None:
                    if wrapper not in known:
                        held += len(wrapper)
                        if held > 4 << 20:
                            known.clear()
                            held = len(wrapper)
                        known[wrapper] = Walk(json.loads(wrapper))
                    slots = known[wrapper].slots(stream)
                texts = [(text, main) for t, text, main in stream if t[0] == "#"]
                blocks.append([{"slot": k, "text": c} for k, (t, main) in zip(slots or [-1] * len(texts), texts, strict=True) if main and (c := _clean(t))])
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "host": b["host"], "blocks": blocks})

    # the wrappers meet the pages by a join on the host, which Spark broadcasts only where small
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(wrappers.select("host", "wrapper"), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "host", "wrapper").mapInPandas(tidy(run), f"page_id {kind}, url string, host string, blocks array<struct<slot:int,text:string>>")


def template_texts(read: DataFrame, share: float = 0.9, least: int = 5) -> DataFrame:
    """host, template: array<struct<slot, key>>, the hashes of texts that belong to the template of their slot.

    A text does if it fills its slot on ``share`` of the different pages that have the slot, and on ``least`` of them. A
    host whose template would make up more than half of its text has none.
    """
    page = read.where("host != ''").select("host", F.xxhash64("blocks").alias("page"), F.explode("blocks").alias("b"))
    seen = page.where("b.slot >= 0").select("host", "page", "b.slot", F.xxhash64("b.text").alias("key"), F.length("b.text").alias("n")).distinct()
    per_text = seen.groupBy("host", "slot", "key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("chars"))
    per_slot = seen.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages"))
    whole = per_text.groupBy("host").agg(F.sum("chars").alias("whole"))
    same = per_text.where(F.col("c") >= least).join(per_slot, ["host", "slot"]).where(F.col("c") >= share * F.col("pages"))
    by_host = same.groupBy("host").agg(F.sum("chars").alias("chars"), F.collect_list(F.struct("slot", "key")).alias("template"))
    return by_host.join(whole, "host").where("2 * chars <= whole").select("host", "template")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text."""
    read = materialize(read_blocks(pages, wrappers), "html-blocks")
    joined = read.join(materialize(template_texts(read), "html-templates"), "host", "left")
    content = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("template", F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("key"))), F.lit(False)))
    return joined.select("page_id", "url", F.array_join(F.transform(content, lambda b: b["text"]), " ").alias("text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wrappers = materialize(infer_wrappers(pages), "html-wrappers")
    return extract(pages, wrappers).withColumn("n_chars", F.length("text").cast("long"))
