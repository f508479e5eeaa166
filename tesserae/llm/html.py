"""Main text of web pages by site template removal.

The subtrees of all elements that enclose text are hashed, menus and what stands beside an
article included. Spark counts on how many distinct pages of a host each subtree stands;
those that recur are the site's template and are deleted. Copies of one text count as one
page, so they never make it a template, and inside an explicit article prose is exempt.

Adverts and footers that change from page to page don't recur, and single pages have
nothing to recur on. So fixed rules (menus, forms and the like, by tag, class, id or
role; what stands outside of an explicit article) leave out text besides.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialise, narrowed

#: A subtree is template if it stands on this many distinct pages of its host, however many the host has.
PAGES = 5

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form noscript template svg math button select dialog menu object video audio canvas map".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption b i em strong span a q cite code".split())
#: An open element on the left ends when one on the right begins.
ENDS = {
    "p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"},
}
#: Words of class, id and role that mark what isn't article text, and words that may stand beside these in one name.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent
cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination
paywall popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor
sponsored subscribe subscription toolbar topbar widget complementary contentinfo search""".split())
BESIDE = frozenset("""area bar block body bottom box btn button buttons center col column container content entry feed form global group header holder icon icons
inner item items label left link links list main message middle panel page post posts primary right row secondary section site slot small large
story stories tags text title top unit wrap wrapper article articles news h v s m l xs""".split())
#: Elements that hold others. Only of these an id is evidence.
HOLDS = frozenset("div section aside ul ol dl table form span header footer nav details figure iframe p".split()) - {"p"}
#: An explicit article is the page's if it has this share of the text outside of it at least.
EXPLICIT = 0.5
#: Templates up to which their keys (8 bytes each) are sent to all tasks; with more the pages are shuffled.
SENT = 4_000_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LAX = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[a-z0-9]+")


class _Element:
    __slots__ = ("tag", "drop", "parts", "hash", "root", "prose")

    def __init__(self, tag, drop, root, prose, head):
        self.tag, self.drop, self.root, self.prose, self.parts, self.hash = tag, drop, root, prose, [head], 0


def _dropped(tag: str, attributes: str, in_root: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_root:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif name != "id" or tag in HOLDS:
            for token in value.split():
                words = _WORD.findall(token)
                # A name marks its element by all of its words: share-buttons does, share-prices doesn't.
                if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE or w.isdigit() for w in words) or "header" in words and not in_root:
                    return True
    return False


def parse(page: str) -> list[tuple[str, list[int], bool]]:
    """Blocks of a whole page: (text, subtree hashes around it that may be template, whether the rules leave it out).

    Tags may be unclosed or misnested, as in real pages. The work is linear in the page's
    length, but for the depth of the elements that enclose a block.
    """
    blocks, buffer, lost = [], [], []
    stack: list[_Element] = []
    dropping = roots = 0
    tag_at, at, n = _TAG, 0, len(page)

    def flush():
        nonlocal buffer
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((text, [e for e in stack if e.tag not in ("html", "body")], roots > 0, False))
            buffer = []
        flush_lost()

    def flush_lost():
        nonlocal lost
        if lost:
            text = " ".join("".join(lost).split())
            if text:
                first = next(i for i, e in enumerate(stack) if e.drop)
                blocks.append((text, stack[first:], roots > 0, True))
            lost = []

    def close():
        nonlocal dropping, roots
        if stack[-1].drop:
            flush_lost()
        e = stack.pop()
        dropping -= e.drop
        roots -= e.root
        e.hash = xxhash.xxh3_64_intdigest("\x00".join(e.parts)) >> 1
        if stack:
            # What is left out doesn't make the subtrees around it differ.
            stack[-1].parts.append(e.tag if e.drop else str(e.hash))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = entities.unescape(page[at:lt])
            (lost if dropping else buffer).append(text)
            if stack:
                stack[-1].parts.append(" ".join(text.split()))
        at = lt
        if at >= n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = tag_at.match(page, at)
        if m is None and tag_at is _TAG and page[at + 1 : at + 2].strip("/").isalpha():
            tag_at = _LAX  # a quote isn't closed: from here on quotes don't hide a >
            m = tag_at.match(page, at)
        if m is None:
            (lost if dropping else buffer).append("<")
            at += 1
            continue
        at = m.end()
        ending, tag, attributes = m[1], m[2].lower(), m[3]
        if ending:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("html", "body", "article", "main"):
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = n if end is None else (page.find(">", end.start()) + 1 or n)
            continue
        if tag == "br":
            (lost if dropping else buffer).append(" ")
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                open_ = stack[i].tag
                if tag in ENDS.get(open_, ()):
                    while len(stack) > i:
                        close()
                    break
                if open_ in BLOCK and open_ != "p":
                    break
        if tag in VOID:
            continue
        if attributes.endswith("/") and (tag in DROPPED or tag == "path"):
            continue
        root = tag in ("article", "main") or 'role="main"' in attributes
        drop = not dropping and _dropped(tag, attributes, roots > 0)
        e = _Element(tag, drop, root and not drop and not dropping, tag in PROSE, tag)
        dropping += e.drop
        roots += e.root
        stack.append(e)
    flush()
    while stack:
        close()
    size = lambda within: sum(len(text) for text, _, inside, out in blocks if inside == within and not out)
    # A teaser isn't the page's article: what stands beside it is more.
    explicit = size(True) > 0 and size(True) >= EXPLICIT * size(False)
    return [
        (text, [e.hash for e in around if out or not (inside and (e.prose or e.root))], out or explicit and not inside)
        for text, around, inside, out in blocks]


def _key(host: str, subtree: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{host} {subtree}".encode("utf-8", "surrogatepass")) >> 1


def _keyed(host: str, page: str) -> list[tuple[str, list[int], bool]]:
    return [(text, [_key(host, h) for h in around], out) for text, around, out in parse(page)]


def _subtrees(batches):
    """A row for every subtree of every page: (key, page, mark); page tells distinct texts apart."""
    for batch in batches:
        keys, pages, marks = [], [], []
        for mark, host, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            blocks = _keyed(host, value or "")
            own = list(dict.fromkeys(k for _, around, _ in blocks for k in around))
            body = "\n".join(text for text, _, out in blocks if not out)
            keys += own
            pages += [xxhash.xxh3_64_intdigest(body.encode("utf-8", "surrogatepass")) >> 1] * len(own)
            marks += [mark] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, pages, marks)], names=["key", "page", "mark"])


def extract(pages: DataFrame, recur: int = PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html: page_id, url, text, n_chars, n_blocks, n_template.

    Blocks are joined by one line feed, white space inside a block is one space. Null or
    empty html gives ''. A null url is a host of its own. n_blocks counts the text's blocks,
    n_template all that recurring subtrees hold, menus included. Repeated rows get equal
    results and count once for a template; an empty table gives no rows. Other columns are
    ignored.
    """
    spark = pages.sparkSession
    rows = narrowed(pages, page_id=id_col, url=url_col, html=html_col)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/?#]*)", 1))
    rows = rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.xxhash64("url", "html").alias("mark"), host.alias("host"), F.col("html").cast("string"))

    # Pages are parsed again for their text: cheaper than storing all blocks.
    seen = rows.select("mark", "host", "html").mapInArrow(_subtrees, "key long, page long, mark long")
    template = seen.groupBy("key", "page").agg(F.count(F.lit(1))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    template = materialise(template.where(F.col("n") >= recur).select("key"), "template")
    held = None
    # Counted first: at most 32 MB go to the driver and all tasks.
    if template.count() <= SENT:
        held = spark.sparkContext.broadcast(np.sort(template.toArrow().column(0).to_numpy()))
        rows = rows.withColumn("delete", F.lit(None).cast("array<long>"))
    else:
        delete = seen.select("mark", "key").join(template, "key").groupBy(F.col("mark").alias("m")).agg(F.collect_set("key").alias("delete"))
        rows = rows.join(delete, F.col("mark") == F.col("m"), "left").drop("m")

    def texts(batches):
        for batch in batches:
            out, stay, gone = [], [], []
            for host, value, delete in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                found = _keyed(host, value or "")
                if held:
                    own = np.array(sorted({k for _, around, _ in found for k in around}), np.int64)
                    known = held.value
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    delete = own[known[at] == own].tolist() if len(known) else ()
                delete = frozenset(delete or ())
                blocks = [(text, left_out, not delete.isdisjoint(around)) for text, around, left_out in found]
                kept = [text for text, left_out, recurs in blocks if not left_out and not recurs]
                out.append("\n".join(kept))
                stay.append(len(kept))
                gone.append(sum(recurs for _, _, recurs in blocks))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(stay, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_blocks", "n_template"])

    found = rows.select("page_id", "url", "host", "html", "delete").mapInArrow(texts, "page_id long, url string, text string, n_blocks long, n_template long")
    return found.withColumn("n_chars", F.length("text").cast("long"))
