"""HTML extraction by union-free regular expressions (wrappers) inferred for each host.

A page's token stream of tags and texts is read into nested elements. Runs of like siblings, and
of like groups of siblings, fold into repeated groups. The wrapper of a host starts as one folded
page and is aligned with the next pages in turn: elements that only one side has become
optional, a run against a single element becomes repeated, and texts that differ become
slots; elements whose class or id words differ (a post's slug, a body's category) become one of the words in common. So a wrapper is an expression of tags, `()+`, `()?` and slots, without unions. Its slots are then
marked: main text or chrome, by element names, by the share of the page's varying text, and last by class words: these count only where they are a whole class or id (`sidebar`, `site-footer`; not `has-sidebar`,
`related-work`), never for html, body, main and article, and not for a part that holds most of a host's varying text, unless it is one of comments. To extract, a page is matched with its host's wrapper in page order, and the text of main
slots is taken; an element that the wrapper does not know is judged by its own name and class. A page in which
its host's wrapper finds no main part is read with the wrapper of that page alone.

A host's wrapper comes from all of its pages: each task folds its pages into one partial wrapper for each structure;
partial wrappers are then folded as a tree, about `FAN` of a host at a time, in the order of the structures, so that it
does not matter how pages are dealt out. A task folds its sorted rows one after the other, so that it holds one wrapper however many a host has. No html is shuffled. More than `CHILDREN` different parts of one element become one
repeated group without an order. Elements deeper than `DEPTH` become siblings at that depth, as in browsers (which stop at 512), so that no
page is too deep to be read; their texts stay where they are. All pages are extracted, whole. Wrappers are broadcast while
their number and size stay below `MAX_HOSTS` and `MAX_BYTES`; beyond that they are joined by host with a salt, so that a host
of a third of all pages is shared out.

Defined cases: null or empty html gives an empty text; a null URL or one without `://` belongs
to the host ``; repeated rows weigh as often as they occur and give equal texts, but are no further pages; texts outside any
block, comments, broken tags and missing end tags are read as browsers would. Extra columns
pass through, those named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, written
from .url_filters import host_of

#: Parts of one element, beyond which their order is given up.
CHILDREN = 64
#: Levels of a page's tree; what is deeper stands side by side at the last one.
DEPTH = 150
#: Parts of the wrappers that a task keeps before it passes them on.
PARTS = 200_000
MAX_HOSTS = 20_000
MAX_BYTES = 64 << 20
SALTS = 32
#: Partial wrappers of a host that a task folds into one, about.
FAN = 64
ROWS = 300

# Fixed values of HTML: elements without content, of raw content, in the line of text, and those that an open one ends at.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
WALLS = set("table ul ol dl article section div main body html td th nav aside footer header form".split())
# Elements and class words of what is not the article.
CHROME = set("nav footer aside form script style noscript template iframe svg button select textarea head title menu dialog object canvas".split())
CHROME_WORDS = set("ad ads advert adverts advertisement banner cookie cookies consent notice notices popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies disqus share sharing social related recommended promo promotion sponsor sponsored newsletter subscribe subscription login signup search widget toolbar".split())
#: Words that may stand beside one of these in a class or id.
BESIDE = set("site area list box block section wrap wrapper container bar button buttons link links posts items item slot left right top bottom inner outer primary secondary global".split())
#: Of chrome words those of readers' comments, which no share of the text overrules, and those that inside an article name a part of it.
COMMENTS = {"comment", "comments", "reply", "replies", "disqus"}
HEADS = {"header", "masthead", "banner"}
MAIN = {"article", "main"}
#: Elements of which a place has one kind: they are the same part whatever their words.
SINGLE = MAIN | {"html", "body"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Element:
    __slots__ = ("tag", "sign", "kids")

    def __init__(self, tag: str, sign: str):
        self.tag, self.sign, self.kids = tag, sign, []


def signature(tag: str, attributes: str) -> str:
    """The tag with the words of its class and id, without digits; `~word` stands for a class or id that names chrome."""
    words: set[str] = set()
    if attributes:
        for _, value in _ATTRIBUTE.findall(attributes):
            for name in entities.unescape(value).lower().strip("\"'").split():
                own = [w for w in re.split(r"[^a-z]+", name) if w]
                words |= set(own)
                if not CHROME_WORDS.isdisjoint(own) and all(w in CHROME_WORDS or w in BESIDE for w in own):
                    words |= {f"~{w}" for w in own if w in CHROME_WORDS}
    return ".".join([tag, *sorted(words)])


def parse(html: str) -> Element:
    """The nested elements of a page, to `DEPTH` levels; texts are str, with references decoded."""
    root = Element("", "")
    open_: list[tuple[str, Element]] = [("", root)]
    how_many: Counter = Counter()
    at, end = 0, len(html)

    def close(k: int) -> None:
        """The k-th open element ends, and those inside it."""
        how_many.subtract(tag for tag, _ in open_[k:])
        del open_[k:]

    def under() -> Element:
        """Where the next text belongs: the innermost open element, or beyond DEPTH a part of it that follows what came last."""
        tag, top = open_[-1]
        if len(open_) > DEPTH + 1:
            level = open_[DEPTH][1].kids
            if not level or level[-1] is not top:
                top = Element(top.tag, top.sign)
                open_[-1] = tag, top
                level.append(top)
        return top

    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text:
            under().kids.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if closing:
            for k in range(len(open_) - 1, 0, -1) if how_many[tag] else ():
                if open_[k][0] == tag:
                    close(k)
                    break
                if open_[k][0] in WALLS and tag not in WALLS:
                    break
            continue
        ended = ENDS.get(tag, set()) | (set() if tag in INLINE or tag in VOID else {"p"})
        if any(how_many[t] for t in ended):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in ended:
                    close(k)
                elif open_[k][0] in WALLS:
                    break
        element = Element(tag, signature(tag, attributes))
        around = open_[-1][1]
        if len(open_) > DEPTH + 1 and (is_chrome(around.sign, True) or around.tag in MAIN) and not is_chrome(element.sign, True):
            element = Element(around.tag, around.sign)  # what it would have inherited
        open_[min(len(open_) - 1, DEPTH)][1].kids.append(element)
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
        elif tag not in VOID:
            open_.append((tag, element))
            how_many[tag] += 1
    return root


# A wrapper is {"s": signature, "k": children, "o": optional, "r": repeated, "t": text, "v": slot, "m": text mass, "l": linked part of it}.
# Signature "()" is a group without an element of its own.


def folded(e: Element, in_link: bool = False) -> dict:
    """An element as a wrapper that fits it alone, with runs folded."""
    in_link = in_link or e.tag == "a"
    out = {"s": e.sign, "k": [], "o": False, "r": False, "t": "", "v": False, "m": 0, "l": 0}
    text = " ".join(" ".join(x for x in e.kids if isinstance(x, str)).split())
    out["t"] = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest() if text else ""
    out["m"], out["l"] = len(text), len(text) if in_link else 0
    out["k"] = bounded(runs([folded(x, in_link) for x in e.kids if not isinstance(x, str)]))
    return out


def flat(kids: list[dict]) -> list[dict]:
    """The parts, with those of groups in their place."""
    return [x for k in kids for x in (flat(k["k"]) if k["s"] == "()" else [k])]


def bounded(kids: list[dict]) -> list[dict]:
    """Too many parts become one repeated group of optional ones: by signature, by name and chrome words if these are too many, then by whether they are chrome."""
    if len(kids) <= CHILDREN:
        return kids
    for key in (lambda s: s, lambda s: (s.split(".")[0], tuple(w for w in s.split(".")[1:] if w[0] == "~")), lambda s: is_chrome(s, False)):
        found: dict = {}
        for k in flat(kids):
            at = key(k["s"])
            found[at] = merged(found[at], k, grow=True) if at in found else k
        if len(found) <= CHILDREN:
            break
    parts = [x | {"o": True, "r": True} for x in found.values()]
    return [{"s": "()", "k": sorted(parts, key=lambda x: x["s"]), "o": False, "r": True, "t": "", "v": False, "m": 0, "l": 0}]


@lru_cache(1 << 16)
def common(a: str, b: str) -> tuple[str, int]:
    """(the signature that fits both, how alike they are); 0 if they are not one part."""
    if a == b:
        return a, 4
    (one, *words), (two, *others) = a.split("."), b.split(".")
    shared = [w for w in words if w in others]
    out = ".".join([one, *shared])
    if one != two or not (shared or one in SINGLE) or not is_chrome(a, False) == is_chrome(b, False) == is_chrome(out, False):
        return "", 0
    return out, 2 if shared else 1


def runs(kids: list[dict]) -> list[dict]:
    """Equal neighbours, and equal neighbouring groups of up to four, become one repeated part."""
    for size in (1, 2, 3, 4):
        out: list[dict] = []
        i = 0
        while i < len(kids):
            group, signs = kids[i : i + size], [x["s"] for x in kids[i : i + size]]
            j = i + size
            times = 1
            while len(group) == size and [x["s"] for x in kids[j : j + size]] == signs:
                group = [merged(a, b, grow=True) for a, b in zip(group, kids[j : j + size])]
                j += size
                times += 1
            if times == 1:
                out.append(kids[i])
                i += 1
            else:
                if size == 1:
                    out.append(group[0] | {"r": True})
                else:
                    out.append({"s": "()", "k": group, "o": False, "r": True, "t": "", "v": False, "m": 0, "l": 0})
                i = j
        kids = out
    return kids


def merged(a: dict, b: dict, grow: bool = False) -> dict:
    """The wrapper that fits what either fits. grow: two repeats in one page, whose texts always differ."""
    out = dict(a)
    if a["s"] != b["s"]:
        out["s"] = common(a["s"], b["s"])[0] or ".".join([a["s"].split(".")[0], *(w for w in a["s"].split(".")[1:] if w in b["s"].split(".")[1:])])
    out["o"], out["r"] = a["o"] or b["o"], a["r"] or b["r"]
    out["v"] = a["v"] or b["v"] or a["t"] != b["t"] or grow
    out["m"], out["l"] = a["m"] + b["m"], a["l"] + b["l"]
    out["k"] = aligned(a["k"], b["k"])
    return out


def aligned(a: list[dict], b: list[dict]) -> list[dict]:
    """Children in order: those in common are merged, the others become optional."""
    n, m = len(a), len(b)
    alike = [[common(x["s"], y["s"])[1] for y in b] for x in a]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            both = best[i + 1][j + 1] + alike[i][j] if alike[i][j] else 0
            best[i][j] = max(best[i + 1][j], best[i][j + 1], both)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if alike[i][j] and best[i][j] == best[i + 1][j + 1] + alike[i][j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i] | {"o": True})
            i += 1
        else:
            out.append(b[j] | {"o": True})
            j += 1
    return bounded(runs([*out, *(x | {"o": True} for x in [*a[i:], *b[j:]])]))


@lru_cache(1 << 16)
def is_chrome(sign: str, inside: bool) -> bool:
    """Whether an element by its name or class is no part of an article; inside: it stands in one."""
    tag, *words = sign.split(".")
    return tag in CHROME or (tag == "header" and not inside) or (tag not in SINGLE and any(w[0] == "~" and not (inside and w[1:] in HEADS) for w in words))


def by_name(sign: str) -> bool:
    """Whether the element's own name, or a class of comments, makes it chrome: no share of the text overrules that."""
    tag, *words = sign.split(".")
    return tag in CHROME or tag == "header" or (tag not in SINGLE and any(w[0] == "~" and w[1:] in COMMENTS for w in words))


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages of a host, its parts marked: keep true, false or (like their parent) none."""
    wrapper = None
    for page in pages:
        one = folded(parse(page))
        wrapper = one if wrapper is None else merged(wrapper, one)
    return {"s": "", "k": [], "keep": False} if wrapper is None else marks(wrapper, len(pages) > 2)


def marks(wrapper: dict, several: bool) -> dict:
    """The wrapper with its parts marked; several: what does not vary is of more than two pages."""

    held: dict[int, float] = {}

    def weigh(w: dict) -> float:
        """Varying text that is no link, of a part and those in it but for chrome by name; what all pages share counts nothing."""
        own = w["m"] - w["l"] if w["v"] or w["r"] or not several else 0
        below = sum([weigh(k) for k in w["k"]])
        held[id(w)] = 0 if by_name(w["s"]) else own + below
        return held[id(w)]

    all_text = weigh(wrapper)

    def chrome(w: dict, inside: bool) -> bool:
        """Words of a class do not bar a part that holds most of the text."""
        return is_chrome(w["s"], inside) and (by_name(w["s"]) and not (inside and w["s"].split(".")[0] == "header") or 2 * held[id(w)] <= all_text)

    def mains(w: dict) -> list[dict]:
        if chrome(w, False):
            return []
        return [w] if w["s"].split(".")[0] in MAIN else [x for k in w["k"] for x in mains(k)]

    def mass(w: dict) -> float:
        """What weigh counts, without all chrome."""
        if chrome(w, False):
            return 0
        own = w["m"] - w["l"] if w["v"] or w["r"] or not several else 0
        return own + sum(map(mass, w["k"]))

    found = [w for w in mains(wrapper) if mass(w)]
    if not found:
        # The innermost part that holds most of the varying text.
        at, all_ = wrapper, mass(wrapper)
        while (best := max(at["k"], key=mass, default=None)) is not None and mass(best) > 0.6 * all_ and best["k"]:
            at = best
        found = [at]

    def marked(w: dict, inside: bool, group: bool = False) -> dict:
        chosen = group or any(w is x for x in found)
        inside = inside or chosen
        keep = False if chrome(w, inside) else True if chosen else None
        return {"s": w["s"], "k": [marked(k, inside, chosen and w["s"] == "()") for k in w["k"]], "o": w["o"], "r": w["r"], "keep": keep}

    return marked(wrapper, False)


def extract(page: str | None, wrapper: dict, own: bool = False) -> str:
    """The text of the page's main slots, blocks joined by one space. own: the wrapper is of this page alone."""
    out: list[str] = []
    main = bool(wrapper.get("keep"))

    def walk(e: Element, w: dict | None, keep: bool, inside: bool, barred: bool) -> None:
        nonlocal main
        parts = [] if w is None else flat(w["k"])
        at = 0
        for kid in e.kids:
            if isinstance(kid, str):
                if keep:
                    out.append(kid)
                continue
            # In page order: the next part of that signature, else (in a repeated group) one before, else the most alike.
            places = [*range(at, len(parts)), *range(at)]
            found = next((i for i in places if parts[i]["s"] == kid.sign), None)
            if found is None:
                found = max(places, key=lambda i: common(parts[i]["s"], kid.sign)[1], default=None)
                found = None if found is None or not common(parts[found]["s"], kid.sign)[1] else found
            known = None if found is None else parts[found]
            at = at if found is None else found
            if known:
                mark = known["keep"]
            elif is_chrome(kid.sign, inside):
                mark = False
            else:
                mark = True if kid.tag in MAIN and not barred else None
            main = main or bool(mark)
            now = keep if mark is None else mark
            block = kid.tag not in INLINE
            if block:
                out.append(" ")
            walk(kid, known, now, inside or bool(mark), barred or mark is False)
            if block:
                out.append(" ")

    if isinstance(page, str) and page:
        walk(parse(page), wrapper, main, main, False)
        if not main and not own:
            return extract(page, infer([page]), own=True)
    return " ".join("".join(out).split())


def shape(w: dict) -> str:
    """The same for wrappers that differ in their texts only."""
    return f"{w['s']}{'?' * w['o']}{'+' * w['r']}({','.join(map(shape, w['k']))})"


def size_of(w: dict) -> int:
    return 1 + sum(map(size_of, w["k"]))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(host, wrapper as JSON), written to the shared folder."""
    spark = pages.sparkSession
    bounded_batches(spark, ROWS)
    # Of a partial wrapper, three different pages are enough to know that it is of several.
    schema = "host string, shape string, seen array<long>, partial string"

    def rows(found: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, sorted(seen), json.dumps(w)) for k, (seen, w) in found.items()], columns=["host", "shape", "seen", "partial"])

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        total = 0
        for pdf in batches:
            for host, page_hash, page in zip(pdf["host"], pdf["hash"], pdf["html"]):
                one = folded(parse(page))
                key = host, hashlib.blake2b(shape(one).encode("utf-8", "replace"), digest_size=16).hexdigest()
                if key in found:
                    seen, before = found[key]
                    found[key] = set(sorted({*seen, page_hash})[:3]), merged(before, one)
                else:
                    found[key] = {page_hash}, one
                    total += size_of(one)
            if total >= PARTS:
                yield rows(found)
                found, total = {}, 0
        yield rows(found)

    def merged_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each (host, _part) of rows that are sorted by these and their structure."""
        now, out = None, None
        for pdf in batches:
            for host, part, form, some, partial in zip(pdf["host"], pdf["_part"], pdf["shape"], pdf["seen"], pdf["partial"]):
                one = json.loads(partial)
                if now == (host, part):
                    first, seen, wrapper = out
                    out = first, set(sorted({*seen, *map(int, some)})[:3]), merged(wrapper, one)
                    continue
                if now is not None:
                    yield rows({(now[0], out[0]): out[1:]})
                now, out = (host, part), (form, set(map(int, some)), one)
        if now is not None:
            yield rows({(now[0], out[0]): out[1:]})

    all_ = pages.select(
        host_of(url_col).alias("host"), F.xxhash64(F.col(id_col), F.col(url_col)).alias("hash"), F.col(html_col).alias("html")
    ).where(F.length("html") > 0)
    partial = all_.mapInPandas(folds, schema)
    partial = written(partial, "html-wrappers")
    while True:
        most = partial.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= 1:
            break
        part = F.pmod(F.xxhash64("shape"), F.lit(-(-most // FAN)))
        dealt = partial.withColumn("_part", part).repartition("host", "_part").sortWithinPartitions("host", "_part", "shape", "partial")
        partial = written(dealt.mapInPandas(merged_rows, schema), "html-wrappers")

    @F.pandas_udf("string")
    def marked(seen: pd.Series, partial: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(marks(json.loads(p), len(s) > 2)) for s, p in zip(seen, partial)], dtype=object)

    return written(partial.select("host", marked("seen", "partial").alias("wrapper")), "html-wrappers")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """pages with text and n_chars."""
    spark = pages.sparkSession
    found = wrappers(pages, url_col, html_col, id_col)
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0)).alias("bytes")).first()
    out = pages.drop("text", "n_chars").withColumn("_host", host_of(url_col))
    if size["n"] <= MAX_HOSTS and size["bytes"] <= MAX_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in found.toLocalIterator()})
        out = out.withColumn("_text", _by_broadcast(shared)(F.col("_host"), F.col(html_col)))
    else:
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        out = out.join(salted.withColumnRenamed("host", "_host"), ["_host", "_salt"], "left")
        out = out.withColumn("_text", _by_column()(F.col("wrapper"), F.col(html_col))).drop("_salt", "wrapper")
    out = out.withColumn("text", F.col("_text")).drop("_text", "_host")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _by_broadcast(shared):
    @F.pandas_udf("string")
    def texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, dict] = {}
        for hosts, pages in parts:
            out = []
            for host, page in zip(hosts, pages):
                if host not in known:
                    known[host] = json.loads(shared.value.get(host) or "{}") or infer([])
                out.append(extract(page, known[host]))
            yield pd.Series(out, dtype=object)

    return texts


def _by_column():
    @F.pandas_udf("string")
    def texts(found: pd.Series, pages: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        out = []
        for w, page in zip(found, pages):
            if w not in known:
                known[w] = json.loads(w) if isinstance(w, str) else infer([])
            out.append(extract(page, known[w]))
        return pd.Series(out, dtype=object)

    return texts


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
