"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into text blocks at block-level tags.  A block is described by its number of words,
its link density (share of its words inside links), the same of the block before and after, and by
where it stands: inside page furniture (``nav``, ``footer``, ``form``, ...), inside a container
whose class, id or role names furniture, inside ``article`` or ``main``.  A decision tree, trained
on the small labelled table below, says which blocks belong to the main text.

The tree is trained by MLlib on a table of fixed size and sent to the tasks as nested tuples.  Pages
are read where they lie, in one narrow pass, each in time proportional to its length; nothing is
shuffled and pages do not depend on each other.

Defined results: null and empty pages have an empty text; a head without an end tag ends at the
first tag that cannot be in it; a skipped element without one ends where a container around it is closed,
else with the page; other markup that is never closed ends with the page; pages of any length are read
whole; character references are decoded, unknown ones stay as written; white space, no-break spaces
included, becomes one blank; a page without a block that is kept has an empty text; repeated pages
are each extracted; other columns stay; the result takes the place of a column that has its name, and
one that differs from that name in case only is refused.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrortab.llm.common import query, table, without_clash

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
#: Elements whose content is no text of the page.
SKIPPED = frozenset(
    "title script style noscript template textarea select svg iframe object canvas audio video math".split()
)
#: Elements of the head; any other tag ends it, for its own end tag may be left out.
OF_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Elements whose content is no markup.
RAW = frozenset("title script style textarea iframe".split())
#: Elements that hold furniture.
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset(("article", "main"))
#: Elements that are tracked as containers; their marks hold for all inside.  A paragraph's mark holds for its own text.
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form menu ul ol dl table tr figure details dialog button"
    " fieldset blockquote li dt dd td th h1 h2 h3 h4 h5 h6 center address hgroup pre summary caption figcaption".split()
)
#: Elements that end others which are still open, up to the innermost of the third kind.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))), "tr": (frozenset(("tr",)), frozenset(("table",))),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words that on a heading say what it is, not that it is furniture.
OF_HEADING = re.compile(r"(?<![a-z])(?:header|masthead|banner)(?![a-z])")
#: Elements inside a line of text: they do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
#: Words in classes, ids and roles that name furniture.
HINT = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|consent|cookies?|copyright|dialog|disqus|footer|"
    r"gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|overlay|pager|pagination|popup|promo|related|"
    r"recommend(?:ed|ations)?|replies|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|tags|toolbar|widget|alert|"
    r"complementary|contentinfo|search|hidden)(?:$|[^a-z])"
)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "hinted", "main")


def _end_of(page: str, name: str, start: int, open_: dict[str, int], unclosed: set[str]) -> int:
    """Where a skipped element ends: behind its end tag, else where a container around it is closed.

    ``unclosed`` keeps the names that have no end tag in the rest of the page.
    """
    if name in RAW and name not in unclosed:
        close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, start)
        if close:
            return close.end()
        unclosed.add(name)
    inside: dict[str, int] = {}
    for tag in TAG.finditer(page, start):
        found = (tag[2] or "").lower()
        if not found:
            continue
        if tag[1]:
            if found == name and not inside.get(name):
                return tag.end()
            if inside.get(found):
                inside[found] -= 1
            elif found in CONTAINERS and open_.get(found):
                return tag.start()
        elif (found in CONTAINERS or found == name) and not tag[3].endswith("/"):
            inside[found] = inside.get(found, 0) + 1
    return len(page)


def _marked(name: str, attributes: str) -> bool:
    """Whether class, id, role or a hidden mark names furniture."""
    if not attributes or name in ("html", "body"):
        return False
    says = " ".join(" ".join(filter(None, m[1:])) for m in MARKS.findall(attributes)).lower().replace("_", "-")
    if name in HEADINGS:
        says = OF_HEADING.sub(" ", says)
    return bool(HINT.search(says)) or bool(HIDDEN.search(attributes))


def blocks(page: str | None) -> list[tuple[str, tuple]]:
    """Text blocks of a page in order, each with its features in the order of ``FEATURES``."""
    found: list[list] = []
    if not page:
        return []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, furniture, hinted, main
    open_: dict[str, int] = {}
    furniture = hinted = main = 0
    link = own = in_head = False  # own: a mark of the paragraph

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", references.unescape("".join(p for p, _ in parts))).strip()
            if text:
                linked = sum(len(references.unescape(p).split()) for p, inside in parts if inside)
                words = text.count(" ") + 1
                marked = float(hinted > 0 or own)
                found.append([text, words, min(1.0, linked / words), float(furniture > 0), marked, float(main > 0)])
            parts.clear()

    def leave(name: str) -> None:
        """Close the innermost container of that name and all inside it."""
        nonlocal furniture, hinted, main
        while True:
            gone, f, h, m = stack.pop()
            open_[gone] -= 1
            furniture, hinted, main = furniture - f, hinted - h, main - m
            if gone == name:
                break

    at, unclosed = 0, set()
    while True:
        tag = TAG.search(page, at)
        text = page[at : tag.start()] if tag else page[at:]
        if text and not in_head:
            parts.append((text, link))
        if tag is None:
            break
        at = tag.end()
        name = tag[2]
        if not name:
            continue
        name, closing = name.lower(), bool(tag[1])
        in_head = not closing if name == "head" else in_head and name in OF_HEAD
        if name == "a":
            link = not closing
        if name in INLINE:
            continue
        if name == "br":
            parts.append((" ", link))
            continue
        flush()
        link = own = False
        if name in SKIPPED:
            if not closing and not tag[3].endswith("/"):
                at = _end_of(page, name, at, open_, unclosed)
            continue
        if name not in CONTAINERS:
            own = not closing and _marked(name, tag[3])
            continue
        if closing:
            if open_.get(name):
                leave(name)
            continue
        ended, within = ENDS.get(name, ((), ()))
        for other, *_ in reversed(stack) if any(open_.get(e) for e in ended) else ():
            if other in ended:
                leave(other)
                break
            if other in within:
                break
        f = name in FURNITURE or name == "header" and not main
        h = _marked(name, tag[3])
        m = name in MAIN
        stack.append((name, f, h, m))
        open_[name] = open_.get(name, 0) + 1
        furniture, hinted, main = furniture + f, hinted + h, main + m
    flush()
    out = []
    for i, (text, words, links, f, h, m) in enumerate(found):
        before = found[i - 1] if i else (None, 0, 0.0)
        after = found[i + 1] if i + 1 < len(found) else (None, 0, 0.0)
        out.append((text, (float(words), links, float(before[1]), before[2], float(after[1]), after[2], f, h, m)))
    return out


#: The labelled table: ``(FEATURES..., 1 if main text)``, written by hand for typical blocks.
LABELLED = (
    # words links before links after links furniture hinted main | label
    (1, 1, 1, 1, 1, 1, 1, 0, 0, 0),  # entries of a menu
    (2, 1, 1, 1, 2, 1, 1, 0, 0, 0),
    (3, 1, 0, 0, 2, 1, 1, 0, 0, 0),
    (1, 1, 2, 1, 9, 0, 1, 0, 0, 0),
    (12, 0, 1, 1, 9, 0, 0, 1, 0, 0),  # adverts and notices beside the text
    (35, 0, 3, 1, 12, 0, 0, 1, 0, 0),
    (60, 0, 2, 1, 40, 0, 0, 1, 0, 0),
    (8, 0.5, 1, 1, 60, 0, 0, 1, 0, 0),
    (4, 0, 2, 1, 11, 0, 0, 1, 0, 0),
    (25, 0.1, 80, 0, 12, 0, 0, 1, 0, 0),
    (9, 0, 90, 0, 0, 0, 1, 0, 0, 0),  # footers
    (25, 0.2, 120, 0, 0, 0, 1, 0, 0, 0),
    (60, 0, 70, 0, 0, 0, 1, 0, 0, 0),
    (5, 0, 0, 0, 3, 1, 1, 0, 0, 0),  # mastheads
    (14, 0, 0, 0, 4, 1, 1, 0, 0, 0),
    (6, 0, 80, 0, 5, 1, 1, 0, 0, 0),  # sidebars and forms
    (45, 0, 80, 0, 5, 0.5, 1, 0, 0, 0),
    (90, 0, 100, 0, 40, 0, 1, 0, 0, 0),
    (30, 0, 70, 0, 20, 0, 1, 1, 0, 0),  # reader comments
    (55, 0, 40, 0, 30, 0, 0, 1, 0, 0),
    (18, 0, 55, 0, 9, 0, 0, 1, 0, 0),
    (20, 0, 90, 0, 35, 0, 0, 1, 1, 0),  # the same inside the article
    (70, 0, 60, 0, 25, 0, 0, 1, 1, 0),
    (4, 0, 60, 0, 30, 0, 0, 1, 1, 0),
    (3, 1, 80, 0, 3, 1, 0, 1, 1, 0),
    (40, 0, 90, 0, 60, 0, 1, 0, 1, 0),
    (6, 0, 70, 0, 80, 0, 1, 0, 1, 0),
    (2, 1, 75, 0, 2, 1, 1, 0, 1, 0),
    (9, 0, 1, 1, 80, 0, 0, 0, 1, 1),  # headings of the article
    (3, 0, 12, 0, 60, 0, 0, 0, 1, 1),
    (12, 0, 30, 0, 45, 0, 0, 0, 1, 1),
    (1, 0, 90, 0, 2, 0, 0, 0, 1, 1),
    (80, 0, 9, 0, 60, 0, 0, 0, 1, 1),  # its paragraphs, long and short, with and without links
    (120, 0.05, 80, 0, 30, 0, 0, 0, 1, 1),
    (45, 0.2, 60, 0, 70, 0.1, 0, 0, 1, 1),
    (7, 0, 120, 0, 9, 0, 0, 0, 1, 1),
    (15, 0, 45, 0, 9, 0, 0, 0, 1, 1),
    (4, 1, 50, 0, 60, 0, 0, 0, 1, 1),
    (20, 0.6, 70, 0, 25, 0.2, 0, 0, 1, 1),
    (2, 0, 30, 0, 0, 0, 0, 0, 1, 1),
    (60, 0, 70, 0, 9, 0, 0, 0, 1, 1),
    (60, 0, 9, 0, 45, 0, 0, 0, 0, 1),  # pages without article or main
    (35, 0.1, 60, 0, 50, 0, 0, 0, 0, 1),
    (90, 0, 3, 1, 70, 0, 0, 0, 0, 1),
    (25, 0, 45, 0, 60, 0, 0, 0, 0, 1),
    (7, 0, 3, 1, 60, 0, 0, 0, 0, 1),  # a heading before text
    (5, 0, 60, 0, 45, 0, 0, 0, 0, 1),
    (3, 0, 8, 0, 70, 0, 0, 0, 0, 1),
    (3, 0, 2, 1, 60, 0, 0, 0, 0, 1),
    (2, 0, 60, 0, 30, 0, 0, 0, 0, 1),
    (3, 0, 0, 0, 60, 0, 0, 0, 0, 1),
    (2, 0, 70, 0, 0, 0, 0, 0, 0, 1),
    (1, 0, 45, 0, 45, 0, 0, 0, 0, 1),
    (11, 0, 55, 0, 25, 0, 0, 0, 0, 1),  # a short paragraph between others
    (40, 0, 50, 0, 6, 0, 0, 0, 0, 1),
    (18, 0.1, 35, 0, 9, 0, 0, 0, 0, 1),
    (3, 1, 3, 1, 3, 1, 0, 0, 0, 0),  # link lists without a mark
    (2, 1, 60, 0, 2, 1, 0, 0, 0, 0),
    (8, 0.9, 9, 1, 8, 0.9, 0, 0, 0, 0),
    (15, 0.8, 12, 0.8, 14, 0.9, 0, 0, 0, 0),
    (30, 0.7, 20, 0.9, 25, 0.8, 0, 0, 0, 0),
    (12, 0.5, 3, 1, 4, 1, 0, 0, 0, 0),
    (3, 1, 3, 1, 60, 0, 0, 0, 0, 0),  # the last links before text or the end
    (2, 1, 2, 1, 0, 0, 0, 0, 0, 0),
    (9, 0.9, 9, 1, 45, 0, 0, 0, 0, 0),
    (2, 1, 70, 0, 0, 0, 0, 0, 0, 0),
    (60, 0, 50, 0, 3, 1, 0, 0, 0, 1),  # text before links
    (35, 0.05, 45, 0, 2, 1, 0, 0, 0, 1),
    (80, 0, 2, 1, 3, 1, 0, 0, 0, 1),
    (22, 0.1, 60, 0, 9, 0.9, 0, 0, 0, 1),
    (3, 0, 2, 1, 2, 1, 0, 0, 0, 0),  # a caption of a link list
    (2, 0, 0, 0, 3, 1, 0, 0, 0, 0),
)


def labelled_rows() -> list[tuple]:
    """The table, each block with a mark also beside other neighbours.

    Whether a marked block is main text does not depend on its neighbours, so every one stands
    beside each pair of typical ones; blocks without a mark are repeated as often as they are.
    """
    beside = ((0, 0), (2, 1), (20, 0), (90, 0))
    rows = []
    for r in LABELLED:
        for before in beside:
            for after in beside:
                rows.append((*r[:2], *before, *after, *r[6:]) if r[6] or r[7] or r[8] else r)
    return [tuple(map(float, r)) for r in rows]


def train_tree(spark: SparkSession):
    """The tree as nested tuples ``(feature, threshold, left, right)``, leaves being the label."""
    rows = labelled_rows()
    data = spark.createDataFrame(rows, [*FEATURES, "label"]).coalesce(1)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data)
    model = DecisionTreeClassifier(maxDepth=6, maxBins=64, minInstancesPerNode=1, seed=7).fit(data)

    def nested(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), nested(node.leftChild()), nested(node.rightChild())

    return nested(model._call_java("rootNode"))


def judged(tree, features: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str | None, tree) -> str:
    return " ".join(text for text, features in blocks(page) if judged(tree, features))


def extracted(pages: DataFrame, html: str = "html", to: str = "text", tree=None) -> DataFrame:
    """``pages`` with ``html``, and a column ``to`` if there is one, replaced by a column ``to``: the main text."""
    kept = without_clash(pages, to, html)
    tree = train_tree(pages.sparkSession) if tree is None else tree
    where = kept.columns.index(html)
    columns = [c for c in kept.columns if c != html]
    schema = T.StructType(
        [T.StructField(str(i), f.dataType) for i, f in enumerate(kept.schema.fields) if f.name != html]
    ).add("text", "string")

    def run(frames):
        for batch in frames:
            found = pa.array([main_text(p.as_py(), tree) for p in batch.column(where)], pa.string())
            rest = [c for i, c in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*rest, found], schema.names)

    return kept.mapInArrow(run, schema).toDF(*columns, to)


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
