"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. A node is a path of tags with their classes and ids; pages differ in how
a node's children look (presentation) and in what it says itself (content, as fragments between full stops and other
marks). Over the m uses of a node the entropy of its looks, and that of its fragments weighted by their words, both
divided by log m, are the importance of its presentation and of its content: what looks and reads alike everywhere is
noise. A node's importance is OWN of its parent's look and the rest its content's, as a share of that of the tree's own
main content (the largest of nodes with a tenth of all words), so a host of copies isn't noise as a whole. The tree
merged from all hosts judges each path of MIN_HOSTS hosts or more as well, and the smaller importance counts; a tree with
fewer than MIN_USES uses of a node says nothing about it.

Names weigh in: a tag, class, id or role that marks noise (whole tokens only) multiplies the importance of what is below
by NAMED, being outside of the main element of a page that has one by OUTSIDE. What is inside a main element counts as
important, for copies of articles must stay, but for branches that are named as noise. A branch is cut out of a page if no
node in it reaches THRESHOLD; what is left is the text. html and body are never cut as such.

Defined results: null, empty or tagless html gives its plain text (null: empty); broken markup is read as far
as it goes; scripts, styles and comments never count as text; what is nested deeper than MAX_DEPTH blocks is judged with
its ancestor there; repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import lean, text_slices
from .url_filter import host_of

THRESHOLD, MIN_USES, MIN_HOSTS, OUTSIDE, NAMED, OWN, MAIN_SHARE = 0.45, 20, 5, 0.5, 0.35, 0.1, 0.1
MAX_DEPTH = 64
#: Up to so many paths they are broadcast (of all hosts, or of all hosts' cut branches); beyond, they are joined by key.
BROADCAST_PATHS = 100_000

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BLANK = frozenset("br hr img input wbr".split())
NO_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video title select textarea button".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
# Names that say what a branch is.
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
NOISE = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement banner promo sponsor sponsored notice cookie cookies consent popup modal overlay comment comments reply replies respond disqus form search share sharing social related recommended breadcrumb breadcrumbs subscribe newsletter widget toolbar login signup copyright legal pagination pager skip".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_FRAGMENT = re.compile(r"[^\w\s,'’-]+")


@functools.lru_cache(4096)
def _element(tag: str, attributes: str) -> tuple[str, bool]:
    """Signature (with ">" for a main part, "!" for what is named as noise, "~" for no text), and whether it is a main part."""
    names, tokens, main, hidden = [], set(), tag in ("article", "main"), False
    if tag in NO_TEXT:
        return f"{tag}~", False
    if attributes:
        for k, a, b, c in _MARK.findall(attributes):
            k, v = k.lower(), a or b or c
            if k == "role":
                main |= v.lower() in ("main", "article")
                hidden |= v.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
            elif k == "hidden":
                hidden |= attributes[: attributes.lower().find("hidden")].count('"') % 2 == 0
            else:
                names += _NAME.findall(v.lower())
                tokens.update(v.lower().split())
    noise = hidden or tag in NOISE_TAGS or not (main or tag in ("html", "body") or NOISE.isdisjoint(tokens))
    named = "".join("." + n for n in dict.fromkeys(names))
    return tag + (named if len(named) <= 60 else f".{xxhash.xxh64_hexdigest(named)}") + ("!" if noise else ">" if main else ""), main and not noise


def _walk(text: str) -> Iterator[tuple[str, object]]:
    """Events of a page: ("open", (tag, signature, main)), ("close", how many), ("text", str), ("blank", None)."""
    stack: list[str] = []
    last = 0
    for m in _TOKEN.finditer(text):
        if m.start() > last:
            yield "text", text[last : m.start()]
        last = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:  # an end tag closes down to its start, if that is open
            if tag in stack:
                k = len(stack) - 1 - stack[::-1].index(tag)
                yield "close", len(stack) - k
                del stack[k:]
            continue
        if tag in BLANK:
            yield "blank", None
        if tag in VOID:
            continue
        for over in (("p",) if tag in CLOSES_P else ()) + ((tag,) if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else ()):
            if over in stack:
                k = len(stack) - 1 - stack[::-1].index(over)
                if not {"ul", "ol", "table", "dl", "article", "section", "div"} & set(stack[k + 1 :]):
                    yield "close", len(stack) - k
                    del stack[k:]
        stack.append(tag)
        yield "open", (tag, *_element(tag, m[4]))
    if last < len(text):
        yield "text", text[last:]


def _below(path: str, tag: str, signature: str, inside: bool) -> str:
    """The path of an element; a page's header is noise outside of its main part only."""
    if path.count("/") >= MAX_DEPTH:
        return path
    return f"{path}/{signature}" + ("!" if tag == "header" and not inside and signature[-1] not in "!>~" else "")


def page_nodes(page: str) -> Iterator[tuple[str, str, str, list[str]]]:
    """(path, parent's path, look of the children, fragments of its own words) of a page's nodes."""
    stack: list[list] = [["", "", [], [], False]]  # tag, path, children, words, inside the main part

    def done(node):
        tag, path, children, words, _ = node
        if path != stack[-1][1] and "~" not in path:
            yield path, stack[-1][1], " ".join(children), [" ".join(x) for f in _FRAGMENT.split("".join(words)) if (x := f.split())]

    def closed():
        node = stack.pop()
        if node[0] in INLINE:
            stack[-1][3] += node[3]  # words of inline elements are their block's
        else:
            stack[-1][3].append(" ")
            yield from done(node)

    for kind, x in _walk(page):
        if kind == "text":
            stack[-1][3].append(x)
        elif kind == "blank":
            stack[-1][3].append(" ")
        elif kind == "close":
            for _ in range(x):
                yield from closed()
        else:
            tag, signature, main = x
            above = stack[-1]
            if tag in INLINE:
                stack.append([tag, above[1], above[2], [], above[4]])
            else:
                path = _below(above[1], tag, signature, above[4])
                if not above[2] or above[2][-1] != signature:  # a run of like children looks like one
                    above[2].append(signature)
                stack.append([tag, path, [] if path != above[1] else above[2], [] if path != above[1] else above[3], above[4] or main])
    while len(stack) > 1:
        yield from closed()


def page_text(page: str | None, cut: dict[str, int]) -> str:
    """The page without the branches ``cut``: those of level 2, and on pages with a main part those of level 1."""
    events = list(_walk(page or ""))
    least = 1 if any(kind == "open" and x[2] for kind, x in events) else 2
    out: list[str] = []
    stack: list[tuple[bool, str, bool, bool]] = [(True, "", False, False)]  # counts, path, inline, inside the main part
    for kind, x in events:
        if kind == "text":
            if stack[-1][0]:
                out.append(html.unescape(x) if "&" in x else x)
        elif kind == "blank":
            out.append(" ")
        elif kind == "close":
            for _ in range(x):
                if not stack.pop()[2]:
                    out.append(" ")
        else:
            tag, signature, main = x
            counts, path, _, inside = stack[-1]
            if tag in INLINE:
                stack.append((counts and signature[-1] not in "!~", path, True, inside))
            else:
                out.append(" ")
                path = _below(path, tag, signature, inside)
                stack.append((counts and signature[-1] != "~" and cut.get(path, 0) < least, path, False, inside or main))
    return " ".join("".join(out).split())


def style_tree(pages: DataFrame, host: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """The merged trees: (host, path, parent, uses, words, look, content) of each host, and (path, ...) of all hosts together."""

    def run(batches):
        for b in batches:
            for part in text_slices(b, 1):
                seen: Counter = Counter()
                for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for path, parent, look, fragments in page_nodes(page or ""):
                        node = xxhash.xxh64_intdigest(path)
                        seen[h, node, xxhash.xxh64_intdigest(look), 0, path, parent] += 1
                        for f in fragments:
                            seen[h, node, xxhash.xxh64_intdigest(f), f.count(" ") + 1, None, None] += 1
                hosts, nodes, digests, words, paths, parents = zip(*seen, strict=True) if seen else ((),) * 6
                signed = lambda v: pa.array([x - (1 << 64) if x >> 63 else x for x in v], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), signed(nodes), signed(digests), pa.array(words, pa.int32()), pa.array(paths, pa.string()), pa.array(parents, pa.string()), pa.array(list(seen.values()), pa.int64())], ["host", "node", "digest", "words", "path", "parent", "n"])

    found = pages.select(F.xxhash64(host).alias("host"), html_col).mapInArrow(lean(run), "host long, node long, digest long, words int, path string, parent string, n long")
    # words 0: a look, which names the node; else a fragment of so many words
    counted = [F.sum("n").alias("n"), F.max("path").alias("path"), F.max("parent").alias("parent")]
    seen = materialize(found.groupBy("host", "node", "words", "digest").agg(*counted), "style-nodes")

    def nodes(of: DataFrame, by: list[str]) -> DataFrame:
        n, w, looks = F.col("n").cast("double"), F.col("words"), F.col("words") == 0
        each = of.groupBy(*by, "node").agg(
            F.max("path").alias("path"), F.max("parent").alias("parent"), F.sum(F.when(looks, n)).alias("uses"), F.sum(F.when(looks, n * F.log(n))).alias("same"),
            F.sum(w * n).alias("words"), F.sum(w * n * F.log(n)).alias("repeated"),
        )
        most = F.log(F.greatest("uses", F.lit(2.0)))
        entropy = lambda sums, of: F.greatest(F.lit(0.0), 1 - F.col(sums) / (F.col(of) * most))
        return each.select(*by, "path", "parent", "uses", "words", entropy("same", "uses").alias("look"), F.when(F.col("words") > 0, entropy("repeated", "words")).alias("content"))

    everywhere = seen.groupBy("node", "words", "digest").agg(*counted)
    return materialize(nodes(seen, ["host"]), "style-host"), materialize(nodes(everywhere, []), "style-all")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_PATHS else df


def _scored(tree: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by..., path, name): importance of the nodes with words as a share of the tree's main content's; null if too rarely seen."""
    looks = tree.select(*by, F.col("path").alias("parent"), F.col("look").alias("above"))
    own = tree.where("content is not null").join(looks, [*by, "parent"], "left")
    own = own.withColumn("imp", OWN * F.coalesce("above", F.lit(1.0)) + (1 - OWN) * F.col("content"))
    whole = own.groupBy(*by).agg(F.sum("words").alias("all"))
    tops = (own.join(whole, by) if by else own.crossJoin(F.broadcast(whole))).where(F.col("words") >= MAIN_SHARE * F.col("all")).groupBy(*by).agg(F.max("imp").alias("top"))
    near = own.join(tops, by, "left") if by else own.crossJoin(F.broadcast(tops.agg(F.max("top").alias("top"))))
    share = F.least(F.lit(1.0), F.when(F.col("top") > 0, F.col("imp") / F.col("top")).otherwise(1.0))
    return near.select(*by, "path", F.when(F.col("uses") >= MIN_USES, share).alias(name))


def cut_branches(tree: DataFrame, everywhere: DataFrame) -> DataFrame:
    """(host, path, level) of the topmost branches to cut: 2 on every page, 1 on pages with a main part."""
    of_host, of_all = _scored(tree, ["host"], "here"), _scored(everywhere, [], "there")
    of_all = of_all.join(tree.groupBy("path").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= MIN_HOSTS).drop("hosts"), "path", "left_semi")
    score = of_host.join(_small(materialize(of_all, "style-scores")), "path", "left")
    inside, named = F.contains(F.col("path"), F.lit(">")), F.contains(F.col("path"), F.lit("!"))
    importance = F.when(inside, 1.0).otherwise(F.least(F.coalesce("here", F.lit(1.0)), F.coalesce("there", F.lit(1.0)))) * F.when(named, NAMED).otherwise(1.0)
    kept = score.select("host", "path", (importance >= THRESHOLD).alias("a"), (F.when(inside, importance).otherwise(importance * OUTSIDE) >= THRESHOLD).alias("b")).where("a")
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    level = F.when(F.max("b"), 0).otherwise(1)
    levels = materialize(kept.select("host", "b", F.explode(up).alias("path")).groupBy("host", "path").agg(level.alias("level")), "style-kept")
    above = levels.select("host", F.col("path").alias("parent"), F.col("level").alias("over"))
    judged = tree.select("host", "path", "parent").join(levels, ["host", "path"], "left").join(above, ["host", "parent"], "left").fillna(2, ["level", "over"])
    root = lambda c: F.col(c).rlike(r"^(/html[^/]*)?(/body[^/]*)?$")
    return judged.where((F.col("level") > F.when(root("parent"), 0).otherwise(F.col("over"))) & ~root("path")).select("host", "path", "level")


@functools.lru_cache(1024)
def _levels(cut: str) -> dict[str, int]:
    return {x[1:]: int(x[0]) for x in cut.split("\n")}


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars of every page."""
    rows = pages.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    branches = cut_branches(*style_tree(rows, "host", "html"))
    lists = branches.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("level").cast("string"), "path"))), "\n").alias("cut"), F.count("*").alias("paths"))
    lists = materialize(lists, "style-cut")
    few = (lists.agg(F.sum("paths")).first()[0] or 0) <= BROADCAST_PATHS
    joined = rows.withColumn("host", F.xxhash64("host")).join(F.broadcast(lists) if few else lists, "host", "left")

    def run(batches):
        for b in batches:
            for part in text_slices(b, 2):
                texts = [page_text(page, _levels(own) if own else {}) for page, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return joined.select(id_col, url_col, "html", "cut").mapInArrow(lean(run), f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
