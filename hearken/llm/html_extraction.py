"""HTML extraction: the main text of a page, without what its site repeats.

Every element's subtree has a hash. Spark counts, for each host, the different pages that hold it,
where pages of equal bodies are one; a subtree on ``MANY`` different pages is template and goes, and
on small hosts one on ``SHARE`` of the pages, and on ``LEAST_PAGES`` at least. Inside the main
element only containers go that way: a plain paragraph, heading or list item of an article that
other articles repeat is still its text. Elements that are never main text by their name, role,
class or id (menus, adverts, forms, comments and so on) go in any case, as a site's adverts and
reader comments need not repeat. The main element is the articles, else main, else the body.

Counting is by (host, hash) with sums before the shuffle, so a host with a third of all pages is
no single task; the templates come back as one row a host, broadcast up to ``MOST_BROADCAST`` hosts
and a bound of bytes, and joined with skew handling beyond. Null or empty html gives an empty text, a
null url the empty host, whose pages count together. Repeated rows give a result each, an empty table
none; other columns are not looked at, whatever their names. Unclosed and misnested tags are closed
as browsers do for paragraphs, list items and cells. Trees are walked without recursion, and open
elements are counted, so neither depth nor stray tags cost more than linearly.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.shared import small, stored
from hearken.llm.url_filters import host_of

SHARE = 0.2
LEAST_PAGES = 5
MANY = 50
MOST_BROADCAST = 50_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("html body article main div section table ul ol dl td th".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote b i em strong a span code br".split())
NEVER = frozenset("script style textarea title noscript iframe head nav footer aside form button select template svg canvas object embed menu dialog search noembed noframes xmp".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices newsletter subscribe signup sidebar sidebars nav navbar navigation menu breadcrumb breadcrumbs masthead footer comment comments reply replies disqus respond share sharing social related recommended popup modal overlay paywall login toolbar skip".split())
#: What may stand beside a telling word in a compound name: where and in what form, not about what.
GENERIC_NAMES = frozenset("area bar block bottom box btn button buttons container count form global group header inner inline item items left link links list main message outer page panel post posts primary right row secondary section site slot strip text thread title top unit widget wrap wrapper".split())
#: Elements that names may speak for. Headings, paragraphs and the like are never dropped by name.
NAMED = frozenset("div section ul ol dl table ins figure center details fieldset span p a".split())
NAMED_INSIDE = frozenset("article div section ul ol dl table ins figure center details fieldset".split())
KEPT_NAMES = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "inside")

    def __init__(self, tag: str, attributes: str, inside: int):
        self.tag, self.attributes, self.children, self.inside = tag, attributes, [], inside


class _Open:
    """The open elements, counted by name: all of them, and those since the last one that is a scope."""

    def __init__(self, root: Node):
        self.stack, self.counts = [root], Counter()
        self.scopes: list[tuple[int, Counter]] = [(0, Counter())]

    def push(self, node: Node) -> None:
        self.counts[node.tag] += 1
        if node.tag in SCOPES:
            self.scopes.append((len(self.stack), Counter()))
        else:
            self.scopes[-1][1][node.tag] += 1
        self.stack.append(node)

    def pop(self) -> Node:
        node = self.stack.pop()
        self.counts[node.tag] -= 1
        if self.scopes[-1][0] == len(self.stack):
            self.scopes.pop()
        else:
            self.scopes[-1][1][node.tag] -= 1
        return node

    def close(self, tag: str) -> None:
        """The end tag of the innermost element of the name, if one is open."""
        while self.counts[tag] and self.pop().tag != tag:
            pass

    def make_room(self, names: tuple[str, ...]) -> None:
        """Close what may not hold the next element: all of these names within the scope."""
        while True:
            place, inside = self.scopes[-1]
            if any(inside[n] for n in names):
                while self.pop().tag not in names:
                    pass
            elif place and self.stack[place].tag in names:
                while len(self.stack) > place:
                    self.pop()
            else:
                return


def parse(page: str) -> list[Node]:
    """The elements in page order, the first a root without a name. Children follow their parents."""
    root = Node("", "", 0)
    nodes, open_, at = [root], _Open(root), 0
    stack = open_.stack
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.close(tag)
            continue
        if tag in BLOCK:
            open_.make_room(("p",))
        if tag in CLOSES:
            open_.make_room(CLOSES[tag])
        above = stack[-1]
        node = Node(tag, m[3].rstrip("/").strip(), above.inside + (tag in ("article", "main")))
        above.children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(node)
    return nodes


def hashes(nodes: list[Node]) -> dict[int, int]:
    """The subtree hash of each element by its id: name, attributes, texts and children's hashes."""
    found: dict[int, int] = {}
    for node in reversed(nodes):
        h = xxhash.xxh3_64(f"{node.tag} {node.attributes}")
        for child in node.children:
            h.update(child.encode("utf-8", "surrogatepass") if isinstance(child, str) else found[id(child)].to_bytes(8))
        found[id(node)] = h.intdigest()
    return found


def _attributes(node: Node) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")).lower() for k, v in ATTRIBUTE.findall(node.attributes)} if node.attributes else {}


def never_main(node: Node) -> bool:
    if node.tag in NEVER or (node.tag == "header" and not node.inside):
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    a = _attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if a.get("role") in NEVER_ROLES:
        return True
    # An article is dropped by name only inside another, as a comment on it may be.
    return node.tag in (NAMED_INSIDE if node.inside > (node.tag == "article") else NAMED) and any(map(_telling, f"{a.get('class', '')} {a.get('id', '')}".split()))


def _telling(name: str) -> bool:
    """Whether a name says that its element is not main text: a telling word, with generic ones at most.
    ``comment-list`` says so, ``related-work`` does not."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in NEVER_NAMES for w in words) and all(w in NEVER_NAMES or w in GENERIC_NAMES for w in words)


def _blocks(top: Node, drop) -> Iterator[str]:
    """The texts between the borders of block elements below ``top``, without dropped subtrees."""
    text: list[str] = []

    def flush() -> Iterator[str]:
        block = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if block:
            yield block

    walk: list[Node | str | None] = [*reversed(top.children)]
    while walk:
        item = walk.pop()
        if item is None:
            yield from flush()
        elif isinstance(item, str):
            text.append(item)
        else:
            border = item.tag in BLOCK
            if border:
                yield from flush()
            if item.tag == "br":
                text.append(" ")
            if not drop(item):
                if border:
                    walk.append(None)
                walk.extend(reversed(item.children))
    yield from flush()


def main_text(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page, given the hashes of its host's template subtrees."""
    nodes = parse(page or "")
    digest = hashes(nodes) if templates else {}

    def drop(node: Node) -> bool:
        if never_main(node):
            return True
        if not templates or node.tag in KEPT_NAMES or (node.inside and node.tag in PLAIN):
            return False
        return digest[id(node)] in templates

    tops = [n for n in nodes if n.tag == "article" and not never_main(n)]
    outer = _outermost(tops or [n for n in nodes if n.tag == "main" or 'role="main"' in n.attributes])
    return "\n".join(block for t in outer or [nodes[0]] for block in _blocks(t, drop))


def _outermost(tops: list[Node]) -> list[Node]:
    """Those of ``tops``, in page order, that lie in none of the others: each subtree is walked once."""
    below: set[int] = set()
    out = []
    for top in tops:
        if id(top) in below:
            continue
        out.append(top)
        walk = [top]
        while walk:
            inner = [c for c in walk.pop().children if isinstance(c, Node)]
            below.update(map(id, inner))
            walk.extend(inner)
    return out


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")


def templates(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES, many: int = MANY) -> DataFrame:
    """(host, hashes): the subtrees that many different pages of the host hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, bodies = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                nodes = parse(page or "")
                digest = hashes(nodes)
                kept = {digest[id(n)] - (1 << 63) for n in nodes[1:] if n.tag not in KEPT_NAMES and not (n.inside and n.tag in PLAIN)}
                body = next((digest[id(n)] for n in nodes if n.tag == "body"), digest[id(nodes[0])]) - (1 << 63)
                hosts += [host] * (len(kept) + 1)
                found += [None, *kept]
                bodies += [body] * (len(kept) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(bodies, pa.int64())], names=["host", "hash", "body"])

    held = _hosted(pages).select("host", "html").mapInArrow(run, "host string, hash long, body long").distinct()
    counts = stored(held.groupBy("host", "hash").agg(F.count("*").alias("pages")).filter((F.col("pages") >= least_pages) | F.col("hash").isNull()), "subtrees")
    of_host = counts.filter("hash IS NULL").select("host", F.col("pages").alias("all"))
    often = counts.filter("hash IS NOT NULL").join(of_host, "host").filter((F.col("pages") >= least_pages) & ((F.col("pages") >= many) | (F.col("pages") >= share * F.col("all"))))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


def extract(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES, many: int = MANY) -> DataFrame:
    """One row a page row: page_id, url, text, n_chars."""
    found = small(stored(templates(pages, share, least_pages, many), "templates"), MOST_BROADCAST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, set[int]] = {}
        for batch in batches:
            texts = []
            for host, page, known in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "hashes")), strict=True):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = {h + (1 << 63) for h in known or ()}
                texts.append(main_text(page, sets[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return _hosted(pages).join(found, "host", "left").select("page_id", "url", "host", "html", "hashes").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
