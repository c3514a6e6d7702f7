"""Main text of web pages by site style trees.

The DOMs of one host are merged into a tree: a page's elements fall onto the
element node of the same path of presentations (tag, class and id, digits
aside), which keeps the distribution of its child sequences (style nodes) and of
the texts found there (content nodes). Importance is measured by entropy: a
content node that occurs on most pages of its element node is template, and so
is an element node whose own texts and styles mostly repeat. Such branches are
removed from each page.

Copies of an article would look like template, so pages that share the least
hash of three words of their text count as one. Branches whose presentation
says what they are (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments) never enter the tree, and where a page marks its article, only
that is looked at.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.5  # branches of at most this importance are removed
MIN_PAGES = 8  # below this number of pages repetition is no evidence
DECAY = 0.9  # weight of what lies below an element against its own styles
NOISE_KEYS = 1_000_000  # template nodes that are broadcast at most

# Names of HTML elements and roles.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
             "tfoot": ("tr", "td", "th", "tbody", "thead")}
NOISE_TAGS = frozenset("nav footer aside form dialog menu button select datalist svg canvas template object audio video".split())
NOISE_ROLES = frozenset(
    "navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Names that pages give to what is no article.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies respond".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar masthead banner footer colophon copyright "
    "sidebar rail widget widgets ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription "
    "signup login search searchform share sharing social related recommended pagination pager skip toast".split())
HEADER_NAMES = frozenset(("header", "banner"))
OWN_NAMES = frozenset("article entry post hentry story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
TOLD = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

NEVER, SOFT, HEADER = 2, 1, 3  # how an element's presentation counts against it


def _judge(tag: str, attributes: str) -> tuple[str, int]:
    """(presentation, what it says) of a start tag."""
    if not attributes or not TOLD.search(attributes):
        kind = NEVER if tag in NOISE_TAGS else HEADER if tag == "header" else 0
        return tag, kind
    found = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), _html.unescape(value.strip("\"'")))
    shown = " ".join(sorted(found.get("class", "").split()) + [f"#{found['id']}" if found.get("id") else ""])
    presentation = re.sub(r"\d+", "0", f"{tag}.{shown.strip()}")
    names = {n.lower() for n in NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if tag in ("html", "body"):
        return presentation, 0
    if hidden or tag in NOISE_TAGS or role in NOISE_ROLES or (names & COMMENT_NAMES and not names & OWN_NAMES):
        return presentation, NEVER
    if tag in ("article", "main") or role in ("main", "article"):
        return presentation, 0
    if names & NOISE_NAMES - HEADER_NAMES:
        return presentation, SOFT
    if (names & HEADER_NAMES and not names & OWN_NAMES) or tag == "header" or role == "banner":
        return presentation, HEADER
    return presentation, 0


class Page:
    """Blocks of text of one page with their element nodes.

    ``blocks`` holds (element node, text) in page order, without the branches
    that are no article by their presentation, and only from marked articles
    (else from the marked main part) where there are any; ``styles`` holds
    (element node, child sequence) of the elements that hold them."""

    def __init__(self, source: str | None, judged: dict | None = None):
        import xxhash

        hashed = xxhash.xxh64_intdigest
        judged = {} if judged is None else judged
        # stack of [tag, node, style, hard, soft, region, is block, list]
        root = ["", 0, 0, False, -1, 0, True, -1]
        stack, opened, block_at = [root], {}, [0]
        soft_parent, soft_open, lists = [], [], []
        rows, styles, text, links = [], set(), [], 0
        self.blocks, self.styles = [], []
        open_links = 0

        def flush():
            nonlocal links
            if text:
                words = "".join(text).split()
                if words:
                    top = stack[block_at[-1]]
                    line = " ".join(words)
                    rows.append((top[1], line, top[3], top[4], top[5], top[7]))
                    if top[7] >= 0:
                        lists[top[7]][0] += len(line)
                        lists[top[7]][1] += min(links, len(line))
                text.clear()
            links = 0

        def pop_to(at):
            nonlocal open_links
            while len(stack) > at:
                done = stack.pop()
                opened[done[0]] -= 1
                if done[6]:
                    block_at.pop()
                    styles.add((done[1], done[2], done[3], done[4], done[5]))
                elif done[0] == "a":
                    open_links -= 1

        def say(part):
            nonlocal links
            if "&" in part:
                part = _html.unescape(part)
            text.append(part)
            if open_links:
                links += len(part)

        source = source or ""
        at, end = 0, len(source)
        while at < end:
            token = TOKEN.search(source, at)
            if token is None:
                say(source[at:])
                break
            if token.start() > at:
                say(source[at:token.start()])
            at = token.end()
            tag = token[2] or token[5]
            if tag is None:
                if token[0].startswith("<![CDATA["):
                    text.append(token[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if token[1] or token[4]:  # an end tag
                if tag in BLOCK:
                    flush()
                if opened.get(tag):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            if stack[k][6]:
                                flush()
                            pop_to(k)
                            break
                        if tag not in BLOCK and stack[k][0] in BLOCK:  # an inline element ends inside its block
                            break
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if tag == "br" or tag == "hr":
                flush()
                continue
            if tag in VOID or tag == "plaintext":
                continue
            is_block = tag in BLOCK
            if is_block:
                flush()
                top = stack[block_at[-1]]
                if top[0] == "p":
                    pop_to(block_at[-1])
                elif tag in CLOSED_BY:
                    while stack[block_at[-1]][0] in CLOSED_BY[tag]:
                        last = stack[block_at[-1]][0]
                        pop_to(block_at[-1])
                        if last == tag:
                            break
                if tag == "body":
                    while stack[-1][0] == "head":
                        pop_to(len(stack) - 1)
            told = (tag, token[3] or "")
            if (seen := judged.get(told)) is None:
                seen = _judge(*told)
                if len(judged) < 10_000 and len(told[1]) < 256:
                    judged[told] = seen
            presentation, kind = seen
            above = stack[-1]
            holder = stack[block_at[-1]]
            hard, soft, region = above[3], above[4], above[5]
            if kind == NEVER:
                hard = True
            elif kind == SOFT or (kind == HEADER and not region):
                soft_parent.append(soft)
                soft_open.append(False)
                soft = len(soft_parent) - 1
            elif tag in ("article", "main") and not hard:
                region = max(region, 2 if tag == "article" else 1)
                up = soft  # what holds an article is no noise
                while up >= 0 and not soft_open[up]:
                    soft_open[up] = True
                    up = soft_parent[up]
            if not is_block and kind:  # an inline element that is noise stands for itself
                flush()
                is_block = True
            node = above[1]
            if is_block:
                node = hashed(presentation, holder[1] & ((1 << 64) - 1))
                holder[2] = hashed(presentation, holder[2])
            in_list = above[7]
            if tag in ("ul", "ol") and in_list < 0:
                lists.append([0, 0])
                in_list = len(lists) - 1
            stack.append([tag, node, 0, hard, soft, region, is_block, in_list])
            opened[tag] = opened.get(tag, 0) + 1
            if is_block:
                block_at.append(len(stack) - 1)
            elif tag == "a":
                open_links += 1
        flush()
        pop_to(1)
        noisy = []
        for parent, held in zip(soft_parent, soft_open):
            noisy.append(not held or (parent >= 0 and noisy[parent]))
        able = [r for r in rows if not r[2] and not (r[3] >= 0 and noisy[r[3]])]
        best = max((r[4] for r in able), default=0)
        menus = {i for i, (chars, linked) in enumerate(lists) if best == 0 and chars and linked >= 0.9 * chars}
        self.blocks = [(r[0], r[1]) for r in able if r[4] == best and r[5] not in menus]
        self.styles = {(s[0], s[1]) for s in styles if not s[2] and not (s[3] >= 0 and noisy[s[3]]) and s[4] == best}


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _site(url: Column) -> Column:
    """Hash of the host of a URL (the empty text if there is none)."""
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")),
                            r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.xxhash64(F.lower(host))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The style trees of all hosts: (site, node, kind, feature, page, n, size),
    one row for each content node (kind 0) and style node (kind 1) of a node and
    each page, or group of pages with the same text, that has it; n is the most
    occurrences on a page, size the length of the text."""

    def run(batches):
        from collections import Counter

        import xxhash

        hashed, judged = xxhash.xxh64_intdigest, {}
        for batch in batches:
            rows = []
            for site, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(source.as_py(), judged)
                words = " ".join(t for _, t in page.blocks).split(" ")
                least = min(hashed(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2)))
                same = _signed(least)
                for (node, text), n in Counter(page.blocks).items():
                    rows.append((site, _signed(node), 0, _signed(hashed(text)), same, n, len(text)))
                for node, style in page.styles:
                    rows.append((site, _signed(node), 1, _signed(style), same, 1, 0))
                if len(rows) >= 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    names = ["site", "node", "kind", "feature", "page", "n", "size"]

    def out(rows):
        import pyarrow as pa

        return pa.record_batch([pa.array(c, pa.int32() if n == "kind" else pa.int64()) for n, c in zip(names, zip(*rows))],
                               names=names)

    rows = pages.select(_site(F.col(url_col)).alias("site"), F.col(html_col).cast("string").alias("html"))
    made = rows.mapInArrow(run, "site bigint, node bigint, kind int, feature bigint, page bigint, n bigint, size bigint")
    return made.groupBy(*names[:5]).agg(F.max("n").alias("n"), F.max("size").alias("size"))


def template_nodes(tree: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES,
                   decay: float = DECAY) -> DataFrame:
    """(site, node, feature): the nodes of low importance; feature is null where
    all texts of an element node go, else the hash of a text.

    A content node's importance is one less the share of its element node's
    pages that it covers: exp(H) / m, with H the entropy of its occurrences over
    the m pages. An element node's composite importance is
    (1 - ``decay``^l) S + ``decay``^l C: S is the entropy of its l styles in
    units of ln m, C the mean importance of its texts by length. Element nodes
    of fewer than ``min_pages`` pages are kept. The others are broadcast up to
    ``NOISE_KEYS`` of them (counted) and joined by shuffle beyond."""
    from .common import cut

    n = F.col("n").cast("double")
    each = tree.groupBy("site", "node", "kind", "feature").agg(
        F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("spread"), F.max("size").alias("size"))
    each = cut(each.select("site", "node", "kind", "feature", "total", "size",
                           F.exp(F.log("total") - F.col("spread") / F.col("total")).alias("covered")))
    # all three are sums over a node's features or pages, so a node that most rows share is added up in every task
    m = tree.where("kind = 1").groupBy("site", "node").agg(F.countDistinct("page").alias("m"))
    mass = F.col("total") * F.col("size")
    texts = each.where("kind = 0").groupBy("site", "node").agg(
        (F.sum(F.col("covered") * mass) / F.sum(mass)).alias("covered_mean"))
    styles = each.where("kind = 1").groupBy("site", "node").agg(
        F.count("*").alias("l"), (F.log(F.sum("total")) - F.sum(F.col("total") * F.log("total")) / F.sum("total")).alias("h"))
    weight = F.pow(F.lit(decay), F.col("l"))
    composite = ((1 - weight) * F.least(F.col("h") / F.log("m"), F.lit(1.0))
                 + weight * (1 - F.least(F.col("covered_mean") / F.col("m"), F.lit(1.0))))
    nodes = cut(m.where(F.col("m") >= min_pages).join(texts, ["site", "node"]).join(styles, ["site", "node"])
                .select("site", "node", "m", composite.alias("composite")))
    known = F.broadcast(nodes) if nodes.count() <= NOISE_KEYS else nodes
    content = (each.where((F.col("kind") == 0) & (F.col("covered") >= (1 - threshold) * min_pages * (1 - 1e-9)))
               .join(known, ["site", "node"])
               .where(1 - F.least(F.col("covered") / F.col("m"), F.lit(1.0)) <= threshold)
               .select("site", "node", "feature"))
    return content.unionByName(nodes.where(F.col("composite") <= threshold)
                               .select("site", "node", F.lit(None).cast("bigint").alias("feature")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, decay: float = DECAY) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    The text is the blocks left, white space inside a block (after character
    references are decoded) as one space, trimmed, joined in page order by one
    space. A null or empty page gives an empty text; pages without a host are
    one site; repeated rows count once in the tree and get equal texts; broken
    markup is read leniently, unclosed elements end with what holds them; other
    columns are ignored; an empty table gives no rows.

    A site's template nodes cover at least about half of its pages each, so
    their number is a small multiple of the blocks of one page. They travel with
    the page: by broadcast up to ``NOISE_KEYS`` of them (counted), by a join on
    the site beyond."""
    from .common import cut

    found = template_nodes(cut(style_tree(pages, url_col, html_col)), threshold, min_pages, decay)
    noise = cut(found.groupBy(F.col("site").alias("_site")).agg(F.collect_list(F.struct("node", "feature")).alias("_noise")))
    size = noise.agg(F.sum(F.size("_noise"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    rows = rows.join(F.broadcast(noise) if size <= NOISE_KEYS else noise, _site(F.col("url")) == F.col("_site"), "left")

    def run(batches):
        import pyarrow as pa
        import xxhash

        hashed, judged, last, skipped = xxhash.xxh64_intdigest, {}, None, (set(), set())
        for batch in batches:
            texts = []
            for source, site, keys in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                if site != last:
                    pairs = [(k["node"], k["feature"]) for k in keys.as_py() or []]
                    skipped = {n for n, f in pairs if f is None}, {p for p in pairs if p[1] is not None}
                    last = site
                nodes, contents = skipped
                page = Page(source.as_py(), judged)
                texts.append(" ".join(
                    t for node, t in page.blocks
                    if not skipped or (_signed(node) not in nodes
                                       and (not contents or (_signed(node), _signed(hashed(t))) not in contents))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return (rows.select("page_id", "url", "html", "_site", "_noise")
            .mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"))
