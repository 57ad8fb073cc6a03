"""Main text of web pages by equivalence-class template deduction.

Each page of a host (copies, pages of the same text, once) becomes a sequence of tokens: its structural elements by their
path, and its text nodes by path and text, but for those that can't be the template's: directly in an article, or in parts
that names hide.  A token's occurrence vector says on which pages it occurs and how often; vectors are never gathered, two
sums of hashes of (page, count) stand for each.  Tokens of one vector form an equivalence class.  A class is valid when on
every page its tokens occur in one order, round by round, and all lie in one gap of the skeleton, the class of all pages;
both are tested on every page.  Skeleton and the valid classes nested in its gaps are the template, and what is left
between them are the slots.

The template decides what of a page is text at all: a text node that has the vector of its own element is part of it
(inside an article only where that element stands below the article's own, so that no paragraph goes, and where articles
have more text of their own), as are text nodes
outside of articles that half of the pages repeat.  Slots of a host whose text is mostly links are menus.  Names of
elements and classes then tell which of the slots hold the article, unless the slots' text over the whole host speaks
against them: articles with next to no text of their own, or a class name that would hide most of the text.

Hosts of fewer than ``LEAST_PAGES`` distinct pages show no template; there the names decide alone.

Defined results: a null or empty html, or a page without a main text, gives the empty text; pages without a proper url
count as one host; repeated rows give a row each; an unclosed element ends with its parent; where the template would
leave nothing of a page, its text is kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_scratch, materialise

# HTML's element kinds, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("head nav footer aside form button select option label fieldset dialog menu".split())
SILENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MAIN_WORDS = frozenset("articlebody mainbody".split())
SILENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup popup modal overlay paywall menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar "
    "widget widgets related recommended recommendations share sharing social comment comments disqus respond replies footer masthead topbar toolbar "
    "login search skip aside rail toc copyright disclaimer tagcloud byline".split()
)
MAIN_HEADS, MAIN_TAILS = frozenset("article post entry story main page".split()), frozenset("body content text".split())
#: Elements that name themselves.
STRUCTURE = BLOCK - frozenset("p li dd dt h1 h2 h3 h4 h5 h6 td th tr option caption blockquote pre hr".split())
CLOSED_BY = {
    "p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"}), "head": frozenset({"body"}),
}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

NEUTRAL, MAIN, SKIP = range(3)
LEAST_PAGES = 4


class Node:
    """An open element: its path of structural elements, what its names say, whether it is in a link, and the article's own path."""

    __slots__ = ("tag", "path", "state", "why", "link", "root")

    def __init__(self, tag: str, path: str, state: int, why: str = "", link: bool = False, root: str = ""):
        self.tag, self.path, self.state, self.why, self.link, self.root = tag, path, state, why, link, root


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)} if raw else {}


def _names(attributes: dict[str, str]) -> list[str]:
    return [w.lower() for a in ("class", "id") for w in WORD.findall(attributes.get(a, ""))]


def _kind(tag: str, attributes: dict[str, str], inside: Node) -> tuple[int, str]:
    """State of an element below ``inside``, and for a skipped one what it is."""
    names, role = _names(attributes), attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    named = next((w for w in names if w in SILENT_WORDS), "")
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return SKIP, "hidden"
    if tag in ("html", "body"):
        return inside.state, inside.why
    if tag in SILENT or role in SILENT_ROLES:
        return SKIP, named or tag
    if named and tag in STRUCTURE | {"p", "li", "span", "a"} and tag != "main":
        return SKIP, named
    if inside.state == SKIP:
        return SKIP, inside.why
    if (tag == "header" or ("header" in names and tag in STRUCTURE and not MAIN_HEADS & set(names))) and inside.state != MAIN:
        return SKIP, "header"
    if tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() in MAIN_WORDS or MAIN_WORDS & set(names):
        return MAIN, ""
    if tag in STRUCTURE and MAIN_HEADS & set(names) and MAIN_TAILS & set(names):
        return MAIN, ""
    return inside.state, ""


def events(html: str) -> Iterator[tuple[str, str, Node]]:
    """("open", path, node), ("break", "", node) and ("text", raw text, node) in page order."""
    stack = [Node("", "", NEUTRAL)]
    at, size, found_main = 0, len(html), False
    last = html.rfind(">") + 1  # no tag ends beyond; without this, many open "<" would be tried in vain
    while at < size:
        m = TOKEN.search(html, at, last)
        until = m.start() if m else size
        if until > at:
            yield "text", html[at:until], stack[-1]
        if m is None:
            return
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                return  # an unclosed comment
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and (tag in BLOCK or all(n.tag not in BLOCK for n in stack[depth + 1 :])):
                del stack[depth:]
            if tag in BLOCK:
                yield "break", "", stack[-1]
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(html, at, last)
            if not m[3].endswith("/"):
                at = end.end() if end else size
            continue
        for i in range(len(stack) - 1, 0, -1):  # what the new element ends
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                del stack[i:]
                break
            if stack[i].tag in STRUCTURE:
                break
        if tag in VOID:
            if tag in ("br", "hr"):
                yield "break", "", stack[-1]
            continue
        if tag not in BLOCK and not m[3]:
            up = stack[-1]
            stack.append(Node(tag, up.path, up.state, up.why, up.link, up.root))
            continue
        attributes = _attributes(m[3])
        state, why = _kind(tag, attributes, stack[-1])
        if state == SKIP and tag in ("article", "main") and not found_main and stack[-1].why not in ("comment", "comments", "related", "aside"):
            state = _kind(tag, attributes, stack[0])[0]  # an unclosed element before the article doesn't hold it
        found_main |= state == MAIN
        path = stack[-1].path
        if tag in STRUCTURE:
            path = f"{path}/{tag}" + "".join(f".{n}" for n in _names(attributes) if not n.isdigit())
        root = path if state == MAIN and (stack[-1].state != MAIN or tag in ("article", "main")) else stack[-1].root
        node = Node(tag, path, state, why, stack[-1].link or tag == "a", root)
        stack.append(node)
        if tag in BLOCK:
            yield "break", "", node
        if tag in STRUCTURE:
            yield "open", path, node


#: Kinds of tokens: elements, text outside of articles, directly in an article, in an element of an article, in a part that names hide.
ELEMENT, LOOSE, DIRECT, NESTED, HIDDEN = range(5)
FIXED = 10  # added to the kind of letters that are the template's


def _hash(*parts: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def page_tokens(html: str) -> tuple[int, list[int], list[tuple], list[tuple]]:
    """(hash of the page's text, tokens in order, tokens that differ, slots).

    A token that differs: (token, its path, kind, count, letters, first place); a slot: (path, kind, letters, letters in links).
    """
    import xxhash

    order: list[int] = []
    found: dict[int, list] = {}
    slots: dict[tuple[int, int], list[int]] = {}
    paths: dict[str, int] = {}
    content = xxhash.xxh64()
    for event, value, node in events(html):
        if event == "break":
            continue
        of = paths.get(node.path)
        if of is None:
            of = paths[node.path] = _hash(node.path)
        if event == "open":
            token, kind, size = of, ELEMENT, 0
        elif text := value.strip():
            kind = HIDDEN if node.state == SKIP else LOOSE if node.state == NEUTRAL else DIRECT if node.path == node.root else NESTED
            size = len(text)
            slot = slots.setdefault((of, kind), [0, 0])
            slot[0] += size
            slot[1] += size if node.link else 0
            if kind != HIDDEN:
                content.update(text)
                content.update("\0")
            if kind in (DIRECT, HIDDEN):
                continue
            token = _hash(node.path, text)
        else:
            continue
        row = found.setdefault(token, [of, kind, 0, 0, len(order)])
        order.append(token)
        row[2] += 1
        row[3] += size
    n = max(1, len(order))
    tokens = [(t, of, kind, count, size, first / n) for t, (of, kind, count, size, first) in found.items()]
    return content.intdigest() - (1 << 63), order, tokens, [(of, kind, *x) for (of, kind), x in slots.items()]


def class_faults(order: list[int], classes: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """For each class on this page (number, faults of order, first and last gap of the skeleton, class 0, that hold it)."""
    places: dict[int, list[int]] = {}
    wanted = {t for c in classes for t in c}
    for at, t in enumerate(order):
        if t in wanted:
            places.setdefault(t, []).append(at)
    skeleton = np.sort(np.array([at for t in classes[0] for at in places.get(t, ())], np.int64))
    out = []
    for number, c in enumerate(classes):
        rounds = [places.get(t, []) for t in c]
        if not any(rounds):
            continue
        even = len({len(r) for r in rounds}) == 1
        seen = np.array(rounds).T.ravel() if even else np.array([0, 0])
        faults = int((np.diff(seen) <= 0).sum()) + (not even)
        gaps = np.searchsorted(skeleton, np.concatenate([np.array(r, np.int64) for r in rounds])) if number else np.zeros(1, np.int64)
        out.append((number, faults, int(gaps.min()), int(gaps.max())))
    return out


class Template:
    """What the deduction says of one host's pages: template texts, slots that are menus, whether names mislead."""

    def __init__(self, raw: str | None):
        made = json.loads(raw) if raw else {}
        self.texts = frozenset(made.get("texts", ()))
        self.menus = frozenset(made.get("menus", ()))
        self.shown = frozenset(made.get("shown", ()))
        self.misleading = made.get("misleading", False)
        self.empty = not (self.texts or self.menus or self.shown or self.misleading)


def extract(html: str, template: Template | None = None) -> str:
    """The text of the slots that hold the article."""
    parts: list[tuple[int, str]] = []  # a text with its state, or a break
    spared: list[tuple[int, str]] = []  # the same without the template's work
    paths: dict[str, int] = {}
    for event, value, node in events(html):
        if event == "break":
            parts.append((-1, " "))
            spared.append((-1, " "))
        elif event == "text":
            state = node.state
            if state != SKIP:
                spared.append((state, value))
            if template is None or template.empty or not (text := value.strip()):
                if state != SKIP:
                    parts.append((state, value))
                continue
            if node.path not in paths:
                paths[node.path] = _hash(node.path)
            of = paths[node.path]
            if state == SKIP and of in template.shown:
                state = NEUTRAL
            if state == SKIP or of in template.menus and state == NEUTRAL or _hash(node.path, text) in template.texts:
                continue
            parts.append((NEUTRAL if template.misleading else state, value))
    return _joined(parts) or _joined(spared)


def _joined(parts: list[tuple[int, str]]) -> str:
    """Article slots where there are any, else all slots; one space for white space and between blocks."""
    only = any(state == MAIN for state, _ in parts)
    kept = (entities.unescape(value) for state, value in parts if state in (-1, MAIN) or not only)
    return " ".join("".join(kept).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _sequences(pages: DataFrame) -> DataFrame:
    """Rows (host, page, seq, toks, slots) of pages that differ: copies repeat their article as well as the template and count once."""
    token = pa.struct([("t", pa.int64()), ("p", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("size", pa.int64()), ("place", pa.float64())])
    slot = pa.struct([("p", pa.int64()), ("kind", pa.int32()), ("size", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [page_tokens(html) for html in part.column(1).to_pylist()]
                toks, slots = ([[dict(zip((f.name for f in kind), x)) for x in m[i]] for m in made] for i, kind in ((2, token), (3, slot)))
                arrays = [part.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array(toks, pa.list_(token)), pa.array(slots, pa.list_(slot))]
                yield pa.RecordBatch.from_arrays(arrays, ["host", "page", "seq", "toks", "slots"])

    schema = (
        "host string, page long, seq array<long>, toks array<struct<t:long,p:long,kind:int,n:int,size:long,place:double>>, "
        "slots array<struct<p:long,kind:int,size:long,linked:long>>"
    )
    parsed = pages.select("host", "html").mapInArrow(run, schema)
    return parsed.groupBy("host", "page").agg(F.first(F.struct("seq", "toks", "slots")).alias("x")).select("host", "page", "x.*")


def templates(pages: DataFrame, least_share: float = 0.3, repeated: float = 0.5, broadcast_hosts: int = 20_000) -> DataFrame:
    """Rows (host, template): deduced from all pages of (host, html), as JSON.

    Tokens count from ``least_share`` of a host's distinct pages on; text nodes outside of articles are template text by
    themselves from ``repeated`` of the pages on.
    """
    made = materialise(_sequences(pages), "html-sequences")
    each = made.select("host", "page", F.explode("toks").alias("k")).select("host", "page", "k.*")
    vector = F.xxhash64("page", "n")
    half = F.lit((1 << 31) - 1).cast("long")  # sums of 31 bits each stay exact for as many pages as a host may have
    tokens = materialise(
        each.groupBy("host", "t").agg(
            F.min("p").alias("p"),
            F.min("kind").alias("kind"),
            F.count("*").alias("pages"),
            F.struct(F.sum(vector.bitwiseAND(half)).alias("a"), F.sum(F.shiftrightunsigned(vector, 33)).alias("b")).alias("vector"),
            F.avg("place").alias("place"),
        ),
        "html-vectors",
    )
    total = made.groupBy("host").agg(F.count("*").alias("all_pages")).where(F.col("all_pages") >= LEAST_PAGES)
    kept = tokens.join(total, "host").where(F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), F.lit(least_share) * F.col("all_pages")))
    classes = kept.groupBy("host", "vector", "pages", "all_pages").agg(F.sort_array(F.collect_list(F.struct("place", "t", "p", "kind"))).alias("tokens"))
    # the class of all pages with the most tokens comes first: the skeleton
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("order"), (-F.size("tokens")).alias("many"), "vector", "all_pages", "tokens")))
    known = materialise(classes.groupBy("host").agg(F.to_json(ordered).alias("template")), "html-classes")

    def check(raw: str | None, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Faults of classes, and letters by slot, over pages of one host."""
        if not raw:
            return
        read = json.loads(raw)
        lists = [[t["t"] for t in c["tokens"]] for c in read]
        constant = template_texts(read, range(len(read)), repeated, (LOOSE, NESTED))
        faults: dict[int, list[int]] = {}
        slots: dict[tuple[int, int], list[int]] = {}
        for _, seq, toks, found in rows:
            for number, bad, low, high in class_faults(seq, lists):
                f = faults.setdefault(number, [0, low, high])
                f[0], f[1], f[2] = f[0] + bad, min(f[1], low), max(f[2], high)
            for k in found:
                x = slots.setdefault((k["p"], k["kind"]), [0, 0])
                x[0] += k["size"]
                x[1] += k["linked"]
            for k in toks:
                if k["t"] in constant:
                    slots[k["p"], k["kind"]][0] -= k["size"]
                    slots.setdefault((k["p"], FIXED + k["kind"]), [0, 0])[0] += k["size"]
        for number, (bad, low, high) in faults.items():
            yield True, number, 0, bad, low, high
        for (path, kind), (size, linked) in slots.items():
            yield False, path, kind, size, linked, 0

    rows = made.select("host", "page", "seq", "toks", "slots")
    schema = "host string, of_class boolean, id long, kind int, x long, y long, z long"
    checked = by_host(rows, known, check, schema, broadcast_hosts).groupBy("host", "of_class", "id", "kind").agg(
        F.sum("x").alias("x"), F.min("y").alias("low"), F.sum("y").alias("y"), F.max("z").alias("z")
    )
    facts = checked.groupBy("host").agg(F.to_json(F.collect_list(F.struct("of_class", "id", "kind", "x", "low", "y", "z"))).alias("facts"))

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, raws, found = (batch.column(i).to_pylist() for i in range(3))
            made_of = [json.dumps(deduce(json.loads(r), json.loads(f or "[]"), repeated)) for r, f in zip(raws, found)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(made_of)], ["host", "template"])

    out = materialise(known.join(facts, "host", "left").mapInArrow(nest, "host string, template string"), "html-templates")
    for scratch in (made, tokens, known):
        drop_scratch(scratch)
    return out


def template_texts(classes: list[dict], valid, repeated: float, kinds: tuple[int, ...]) -> set[int]:
    """Text nodes of ``kinds`` in the classes ``valid`` that are part of the template."""
    texts = set()
    for number in valid:
        c = classes[number]
        elements = {t["t"] for t in c["tokens"] if t["kind"] == ELEMENT}
        often = -c["order"] >= repeated * c["all_pages"]
        texts |= {t["t"] for t in c["tokens"] if t["kind"] in kinds and (t["p"] in elements or t["kind"] == LOOSE and often)}
    return texts


def deduce(classes: list[dict], facts: list[dict], repeated: float = 0.5) -> dict:
    """The template of one host: valid classes nested into the skeleton's gaps, and what the slots' text says of names."""
    valid = [f["id"] for f in facts if f["of_class"] and not f["x"] and f["low"] == f["z"]]
    slots = [f for f in facts if not f["of_class"]]
    mass: Counter = Counter()
    for f in slots:
        mass[f["kind"]] += f["x"]
    kinds = (LOOSE, NESTED) if mass[DIRECT] + mass[NESTED] > mass[FIXED + NESTED] else (LOOSE,)
    menus = [f["id"] for f in slots if f["kind"] == LOOSE and f["y"] > 0.6 * f["x"]]
    main, hidden = mass[DIRECT] + mass[NESTED], mass[HIDDEN]
    loose = mass[LOOSE] - sum(f["x"] for f in slots if f["kind"] == LOOSE and f["id"] in set(menus))
    shown = []
    if hidden > 4 * (main + loose):  # names hide nearly all: show the slot that holds most of it, if it's text
        best = max((f for f in slots if f["kind"] == HIDDEN), key=lambda f: f["x"])
        shown = [best["id"]] if best["x"] > 0.6 * hidden and best["y"] < 0.3 * best["x"] else []
    return {"texts": sorted(template_texts(classes, valid, repeated, kinds)), "menus": menus, "shown": shown, "misleading": bool(loose and main < 0.1 * loose)}


def by_host(rows: DataFrame, known: DataFrame, work: Callable, schema: str, broadcast_hosts: int) -> DataFrame:
    """``work(template, rows of one host)`` over all rows, whose first column is the host; its results follow the host.

    Templates are broadcast up to ``broadcast_hosts`` hosts and 64 MB.  Beyond, rows are brought to their template by a
    shuffle in which a template is sent once for each thousandth of the table that its host fills, not once a row.
    """
    names, types = [f.split()[0] for f in schema.split(", ")], pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(", ")])
    bound = known.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.length("template") + F.length("host")), F.lit(0)).alias("chars")).first()
    small = bound["hosts"] <= broadcast_hosts and bound["chars"] <= 64_000_000

    def emit(groups: Iterator[tuple[str, str | None, list[tuple]]]) -> Iterator[pa.RecordBatch]:
        for host, raw, found in groups:
            made = [(host, *r) for r in work(raw, found)]
            for at in range(0, len(made), 1000):
                part = made[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], types.field(i).type) for i in range(len(names))], names)

    def rows_of(batch: pa.RecordBatch, skip: int = 0) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, 128):
            yield list(zip(*(c.to_pylist() for c in batch.slice(at, 128).columns[skip:])))

    if small:
        shipped = rows.sparkSession.sparkContext.broadcast({r.host: r.template for r in known.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in rows_of(batch):
                    grouped: dict[str, list] = {}
                    for r in part:
                        grouped.setdefault(r[0], []).append(r[1:])
                    yield from emit((h, shipped.value.get(h), found) for h, found in grouped.items())

        return rows.mapInArrow(run, schema)
    total = max(1, rows.count() // 1000)
    hot = F.broadcast(rows.groupBy("host").agg(F.ceil(F.count("*") / total).cast("int").alias("salts")).where("salts > 1"))  # a thousand at most
    salts = F.coalesce("salts", F.lit(1))
    columns = [c for c in rows.columns if c != "host"]
    left = rows.join(hot, "host", "left").select("host", F.pmod(F.xxhash64(*columns), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("template"), *columns)
    right = known.join(hot, "host", "left").select(
        "host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "template", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = raw = None
        for batch in batches:
            for part in rows_of(batch):
                groups: list[tuple] = []
                for h, _, kind, template, *values in part:
                    if kind == 0:
                        host, raw = h, template
                        continue
                    if not groups or groups[-1][0] != h:
                        groups.append((h, raw if h == host else None, []))
                    groups[-1][2].append(tuple(values))
                yield from emit(iter(groups))

    return left.unionByName(right).repartition("host", "salt").sortWithinPartitions("host", "salt", "kind").mapInArrow(stream, schema)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 20_000) -> DataFrame:
    """Rows (host, id, url, text)."""
    rows = pages.select(
        host_of(F.col(f"`{url_col}`").cast("string")).alias("host"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    known = templates(rows, broadcast_hosts=broadcast_hosts)

    read: dict[str | None, Template] = {}

    def work(raw: str | None, found: list[tuple]) -> Iterator[tuple]:
        if len(read) > 1000:
            read.clear()
        template = read.get(raw) or read.setdefault(raw, Template(raw))
        for i, url, html in found:
            yield i, url, extract(html, template)

    return by_host(rows, known, work, "host string, id long, url string, text string", broadcast_hosts)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
