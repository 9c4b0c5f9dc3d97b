"""Main text of web pages, with a style tree per host.

The pages of a host are merged by the paths of their elements. A path's content importance is high if its texts differ from page to page, and its
presentation importance if its child sequences do (entropies over the pages, to the base of their number). Their mean weighs a
branch, together with one imagined occurrence that differs from all: the fewer a host has shown, the less is known. Low branches are the host's template and are cut from each page.

Elements whose name or role says what they are (menus, footers, forms), or that are hidden, are cut without counting. A whole word of a class or id
that says so (adverts, comments) is evidence: its branch is cut unless that holds the page's article or most of its text, and parts of words only raise
the importance below which the tree cuts. Where articles or main elements have a good part of a page's text, the text comes from inside them. The tree cuts
there too, unless what it would cut is most of that text: pages with copied articles would else lose them. Elsewhere a branch that carries most of a page stays for the same reason.

Rows: a null or empty html gives the empty text; pages without a host share one tree. Broken markup is read as browsers do in the
main: unclosed and crossed elements close with the ones around them, a cut-off tag is dropped. Pages of any length are read whole. Rows repeat as given, and count each in the tree. A branch of
an importance just at the bound stays. An empty table gives an empty result. Only the three named columns are read, so others may have any names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import named
from loomgraph.runtime import discard, written

#: Branches of an importance below this are cut.
LOW = 0.3
#: The same where a part of a class or id of the element or its parent tells of noise.
SUSPECT = 0.6
#: Articles with a smaller part of a page's text are not its main text.
MAIN_SHARE = 1 / 3
#: A marked branch that has most of a page's text stays beside an article if it has so many characters.
LEAST_TEXT = 500
#: A low branch outside articles that has a larger part of a page's text stays.
CARRIES = 2 / 3
#: Low paths of a host that are handed to its pages as one list; hosts with more have each page's own paths looked up.
MOST_PATHS = 5_000
#: The weight of presentation in the importance.
PRESENTATION = 0.25

# HTML element names and words that class names use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CUT = frozenset("aside button datalist dialog footer form head header iframe input menu nav noembed noframes noscript object optgroup option script select style svg template textarea title xmp".split())
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notification notifications pagination pager popup promo promoted related "
    "recommended reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN = frozenset({"article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Parts of an article's class that make it a reader's comment, or a card that leads to another page.
COMMENT = frozenset("comment comments disqus replies reply respond".split())
ASIDE = COMMENT | {"teaser", "card", "promo", "promoted", "related", "recommended", "sponsored"}
#: An element that starts closes these open ones.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag does not reach beyond these.
SCOPES = {"li": {"ul", "ol"}, "p": {"td", "th", "table", "button"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/]|$)")
PART = re.compile(r"[a-z]+")
SUSPICIOUS = rf"(?i)>[^>]*[^a-z>]({'|'.join(sorted(CUT_WORDS))})([^a-z>][^>]*)?(>[^>]*)?$"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"


def _marks(attributes: str) -> tuple[str, frozenset[str], frozenset[str], bool]:
    """The class and id as part of a path, the words of the class and of the id, and whether the element is noise by role or hidden."""
    if "=" not in attributes and "hidden" not in attributes:
        return "", frozenset(), frozenset(), False
    found = {m[5] or m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    kind, own = found.get("class", ""), found.get("id", "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return f"{kind} {own}".strip(), frozenset(kind.lower().split()), frozenset(own.lower().split()), hidden or found.get("role", "").lower() in CUT_ROLES


class Walk:
    """One pass over a page. Tells each text block with the path of its element, whether it lies in noise, and in a main element."""

    def __init__(self, page: str):
        self.page = page
        #: path, noise, main, numbers of the marked branches around it, text
        self.found: list[tuple[str, bool, bool, tuple[int, ...], str]] = []
        self.styles: list[tuple[str, str]] = []
        self.stack: list[list] = [["", "", False, False, [], ()]]  # name, path, noise, main, names of children, marked branches
        self.text: list[str] = []
        #: per marked branch, whether it is of comments, and the branches that hold an article; whether an article lies in none
        self.comments: list[bool] = []
        self.holding: set[int] = set()
        self.free = False
        self._run()

    @property
    def blocks(self) -> list[tuple[str, bool, bool, str]]:
        """path, noise, main, text. A marked branch is noise unless it holds the only articles, or most of the page's text."""
        size = [0] * len(self.comments)
        total = 0
        for _, noise, _, marks, text in self.found:
            if not noise:
                total += len(text)
                for k in marks:
                    size[k] += len(text)
        most = lambda k: 2 * size[k] > total and (not self.free or (size[k] >= LEAST_TEXT and not self.comments[k]))
        cut = {k for k in range(len(size)) if not most(k) and (self.free or k not in self.holding)}
        return [(path, noise or any(k in cut for k in marks), main, text) for path, noise, main, marks, text in self.found]

    def _flush(self) -> None:
        if self.text:
            _, path, noise, main, _, marks = next(x for x in reversed(self.stack) if x[0] not in INLINE)
            raw = "".join(self.text)
            self.text = []
            clean = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if clean:
                self.found.append((path, noise, main, marks, clean))

    def _close(self, depth: int) -> None:
        """Takes elements off the stack down to ``depth``."""
        while len(self.stack) > depth:
            if self.stack[-1][0] not in INLINE:
                self._flush()
            _, path, _, _, children, _ = self.stack.pop()
            if children:
                self.styles.append((path, " ".join(children)))

    def _open(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self._flush()
            closing = CLOSES.get(name, set()) | {"p"}
            for k in range(len(self.stack) - 1, 0, -1):
                own = self.stack[k][0]
                if own in closing:
                    self._flush()
                    self._close(k)
                    break
                if own not in INLINE and not (name == "tr" and own in ("td", "th")):
                    break
        mark, kinds, ids, noise = _marks(attributes) if attributes else ("", frozenset(), frozenset(), False)
        top = self.stack[-1]
        top[4].append(name)
        if name in VOID:
            if name in ("br", "hr"):
                self.text.append(" ")
            return
        path = f"{top[1]}>{name}.{mark}" if mark else f"{top[1]}>{name}"
        # a header inside an article holds its title
        cut = name in CUT and not (name == "header" and top[3])
        whole = name in MAIN and not top[3]
        # a region that only names its role on the main element itself is not noise
        bad = top[2] or cut or (noise and not whole and name != "body")
        if whole:
            words = {p for w in kinds for p in PART.findall(w)} & ASIDE
        elif top[3]:
            words = kinds & CUT_WORDS - {"header"}  # ids are anchors of sections there
        else:
            words = (kinds | ids) & CUT_WORDS
        marks, inside = top[5], top[3]
        if words and not bad and name != "body" and name not in HEADINGS:
            marks = (*marks, len(self.comments))
            self.comments.append(bool(words & COMMENT))
        elif whole and not bad:
            inside = True
            self.holding.update(marks)
            self.free |= not marks
        self.stack.append([name, path, bad, inside, [], marks])

    def _end(self, name: str) -> None:
        limit = SCOPES.get(name, set())
        for k in range(len(self.stack) - 1, 0, -1):
            own = self.stack[k][0]
            if own == name:
                if name not in INLINE:
                    self._flush()
                self._close(k)
                return
            if own in limit or (name in INLINE and own not in INLINE):
                return

    def _run(self) -> None:
        page, at = self.page, 0
        while m := TAG.search(page, at):
            if m.start() > at:
                self.text.append(page[at : m.start()])
            at = m.end()
            if not (name := m[2]):
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            self._open(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                self._close(len(self.stack) - 1)
        rest = page[at:]
        self.text.append(re.sub(r"<[/a-zA-Z!][^<>]*\Z", "", rest) if "<" in rest else rest)
        self._flush()
        self._close(1)


def branch(path: str) -> str:
    """The element below the body that a path leads through."""
    parts = path.split(">")
    k = parts.index("body") if "body" in parts else 0
    return ">".join(parts[: k + 2])


def main_text(page: str | None, low: frozenset[str] = frozenset()) -> list[str]:
    """The blocks of the main text, in page order. ``low``: paths that the host's tree rates low."""
    if not page:
        return []
    chars = lambda found: sum(len(x[3]) for x in found)
    blocks = [x for x in Walk(page).blocks if not x[1]]
    main, rest = [x for x in blocks if x[2]], [x for x in blocks if not x[2]]
    if low:
        own = [x for x in main if x[0] not in low or x[0].rpartition(">")[2].partition(".")[0] == "h1"]
        # what carries most of an article is a copied one
        if 2 * chars(own) > chars(main):
            main = own
        size, most = Counter(), CARRIES * chars(blocks)
        for x in rest:
            for p in {x[0], branch(x[0])} & low:
                size[p] += len(x[3])
        rest = [x for x in rest if all(size[p] > most for p in {x[0], branch(x[0])} & low)]
    if main and chars(main) >= MAIN_SHARE * (chars(main) + chars(rest)):
        return [x[3] for x in main]
    kept = {id(x) for x in main + rest}
    return [x[3] for x in blocks if id(x) in kept]


def own_paths(page: str | None) -> set[str]:
    """The paths that ``main_text`` looks up for a page."""
    return {p for path, _, main, _, _ in Walk(page or "").found for p in ({path} if main else {path, branch(path)})}


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    h = lambda t: xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63)
    for f in frames:
        seen: Counter = Counter()
        for host, page in zip(f["host"], f["html"], strict=True):
            walk = Walk(page or "")
            for path, _, main, _, text in walk.found:
                for p in {path} if main else {path, branch(path)}:
                    seen[host, p, "text", h(text)] += 1
            for path, children in walk.styles:
                seen[host, path, "style", h(children)] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["host", "path", "kind", "feature", "n"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, seen, importance over ``pages(host, html)``.

    Per host and path: how evenly its texts and child sequences are shared by its occurrences. Counts are added up before they
    move, then by feature, then by path, so a host with most pages is many small groups.
    """
    counted = pages.mapInPandas(_features, "host string, path string, kind string, feature long, n long")
    counted = counted.groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    n, total = F.col("n"), F.col("total")
    spread = counted.groupBy("host", "path", "kind").agg(F.sum("n").alias("total"), F.sum(n * F.log(n)).alias("within"))
    # entropy of the features to the base of the number of occurrences: 1 if all differ, 0 if all are equal
    spread = spread.withColumn("entropy", F.when(total > 1, 1 - F.col("within") / (total * F.log(total))).otherwise(1.0))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    joined = spread.groupBy("host", "path").agg(of("text", "total").alias("seen"), of("text", "entropy").alias("text"), of("style", "entropy").alias("style"))
    weighed = (1 - PRESENTATION) * F.col("text") + PRESENTATION * F.coalesce("style", "text")
    seen = F.col("seen")
    return joined.where("seen IS NOT NULL").select("host", "path", "seen", ((seen * weighed + 1) / (seen + 1)).alias("importance"))


def _extracted(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = ["\n\n".join(main_text(p, frozenset(() if low is None else low))) for p, low in zip(f["html"], f["low"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows


def _own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = {(h, k, p) for h, k, page in zip(f["host"], f["page"], f["html"], strict=True) for p in own_paths(page)}
        yield pd.DataFrame(sorted(rows), columns=["host", "page", "path"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_paths: int = MOST_PATHS) -> DataFrame:
    """id, url, text, n_chars per row.

    The low paths of a host are handed to its pages as a list, if there are ``most_paths`` at most; that table is written first, so that its size decides whether it is
    sent to all executors or joined by host. The pages of hosts with more look up just their own paths. The result is the same.
    """
    rows = named(pages, id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    bound = F.when(F.col("path").rlike(SUSPICIOUS), SUSPECT).otherwise(LOW)
    low = written(style_tree(rows.select("host", "html")).where(F.col("importance") < bound).select("host", "path"), "low-paths")
    large = written(low.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > most_paths).select("host"), "large-hosts")
    lists = written(low.join(large, "host", "left_anti").groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "low-lists")
    joined = rows.join(lists, "host", "left").select("id", "url", "html", "low")
    if not large.isEmpty():
        keyed = rows.withColumn("page", F.sha2(F.coalesce("html", F.lit("")), 256))
        few, many = keyed.join(large, "host", "left_anti"), keyed.join(large, "host", "left_semi")
        own = many.select("host", "page", "html").mapInPandas(_own, "host string, page string, path string").distinct()
        own = written(own.join(low, ["host", "path"]).groupBy("host", "page").agg(F.sort_array(F.collect_set("path")).alias("low")), "page-paths")
        joined = few.join(lists, "host", "left").select("id", "url", "html", "low").unionByName(many.join(own, ["host", "page"], "left").select("id", "url", "html", "low"))
    discard(low)
    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInPandas(_extracted(kind), f"id {kind}, url string, text string, n_chars long")
