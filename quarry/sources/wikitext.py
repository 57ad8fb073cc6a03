"""Lines of wikitext law pages, each parsed by itself; what depends on other lines is left to ``operators.law_pages``.

A line is read once, mark by mark, with a stack of open templates, links and tags.  Marks that are never closed turn into
plain text when what holds them closes, so the work is linear in the line however it is nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template names of law pages, and namespaces of links.
HEADINGS = {"ח:קטע1": 1, "ח:קטע2": 2, "ח:קטע3": 3, "ח:קטע4": 4}
ITEMS = {"ח:תת": 1, "ח:תתת": 2, "ח:תתתת": 3, "ח:תתתתת": 4}
KINDS = {
    "ח:כותרת": "title", "ח:פתיח-התחלה": "box_start", "ח:סוגר": "box_end", "ח:מבוא": "preamble", "ח:סעיף": "section", "ח:חתימות": "signatures",
    "ח:התחלה": "plain", "ח:סוף": "plain", "ח:מפריד": "plain", "ח:ת": "plain",
}
FIRST_ARGUMENT = {"ח:הערה", "ח:מוקטן", "ח:מודגש", "ח:נטוי", "ח:גדול", "ח:קטן"}
LINKS = {"ח:פנימי", "ח:חיצוני"}
REGISTRY, CITATION = "ח:מאגר", "ח:תיבה"
TEMPLATE_SPACE, CATEGORY_SPACES, FILE_SPACES = "תבנית:", ("קטגוריה:", "Category:"), ("קובץ:", "File:", "תמונה:")
SECTION_WORD = "סעיף"

MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\[(?=[a-z]++://)|\]|\||=|''++|<!--|</?[A-Za-z]++[^<>]*+>|&#?\w{1,30};")
DIV = re.compile(r"</?div\b[^<>]*+>")
#: Lines and characters of a batch that goes back to Spark.
BATCH_LINES, BATCH_CHARS = 8192, 4_000_000
OPEN = {"{{": "}}", "[[": "]]", "[": "]"}
SCHEMA = (
    "line int, kind string, level int, label string, title string, note string, text string, in_div boolean, registry long,"
    " citations array<struct<ref:string, name:string, url:string>>, categories array<string>, unknown array<string>"
)


class _Frame:
    """An open mark: its arguments so far, and which of them are named."""

    __slots__ = ("kind", "mark", "args", "named")

    def __init__(self, kind: str, mark: str):
        self.kind, self.mark, self.args, self.named = kind, mark, [[]], [False]

    def add(self, text: str) -> None:
        self.args[-1].append(text)

    def literal(self) -> list[str]:
        """What was read, as the text it would be without its opening mark's meaning."""
        out = [self.mark]
        for k, arg in enumerate(self.args):
            out += ["|"] * bool(k) + arg
        return out


class Line:
    """The nodes of one line: texts, and templates as (name, positional arguments)."""

    def __init__(self, raw: str):
        self.registry: int | None = None
        self.citations: list[tuple[str, str, str]] = []
        self.categories: list[str] = []
        self.unknown: list[str] = []
        self.nodes: list[str | tuple[str, list[str]]] = []
        self._read(raw)

    def _read(self, raw: str) -> None:
        stack = [_Frame("", "")]
        opened: dict[str, int] = {}
        at, comments = 0, True
        for found in MARK.finditer(raw):
            if found.start() < at:  # inside a comment
                continue
            stack[-1].add(raw[at : found.start()])
            mark, at = found.group(), found.end()
            if mark == "<!--":
                end = raw.find("-->", at) if comments else -1
                comments = end >= 0
                if comments:
                    at = end + 3
                else:
                    stack[-1].add(mark)
            elif mark in OPEN:
                stack.append(_Frame(OPEN[mark], mark))
                opened[OPEN[mark]] = opened.get(OPEN[mark], 0) + 1
            elif mark in ("}}", "]]", "]"):
                if mark == "]]" and not opened.get("]]") and opened.get("]"):
                    mark, at = "]", at - 1
                if opened.get(mark):
                    self._close(stack, opened, mark)
                else:
                    stack[-1].add(mark)
            elif mark == "|" and stack[-1].kind in ("}}", "]]"):
                stack[-1].args.append([])
                stack[-1].named.append(False)
            elif mark == "=" and stack[-1].kind == "}}":
                stack[-1].named[-1] = True
                stack[-1].add(mark)
            elif mark[0] == "<":
                self._tag(stack, opened, mark)
            elif mark[0] == "&":
                stack[-1].add(html.unescape(mark))
            elif mark[0] != "'":  # quotation marks of bold and italic text go
                stack[-1].add(mark)
        stack[-1].add(raw[at:])
        self._flatten(stack, opened, 1)
        text: list[str] = []
        for node in stack[0].args[0]:
            if isinstance(node, str):
                text.append(node)
            else:
                self.nodes += ["".join(text), node]
                text = []
        self.nodes.append("".join(text))

    def _flatten(self, stack: list[_Frame], opened: dict[str, int], above: int) -> None:
        """Open marks from position ``above`` on were never closed: their texts, one after the other, belong to the mark below."""
        for frame in stack[above:]:
            opened[frame.kind] -= 1
            stack[above - 1].args[-1] += frame.literal() if frame.kind[0] != "<" else frame.args[0]
        del stack[above:]

    def _close(self, stack: list[_Frame], opened: dict[str, int], kind: str) -> None:
        at = len(stack) - 1
        while stack[at].kind != kind:
            at -= 1
        self._flatten(stack, opened, at + 1)
        frame = stack.pop()
        opened[kind] -= 1
        args = ["".join(a) for a in frame.args]
        if kind == "}}":
            name = args[0].strip().replace("_", " ")
            name = name[len(TEMPLATE_SPACE) :].strip() if name.startswith(TEMPLATE_SPACE) else name
            node = (name, [a.strip() for a, named in zip(args[1:], frame.named[1:]) if not named])
            stack[-1].add(node if len(stack) == 1 else self.template(*node))
        elif kind == "]]":
            target = args[0].strip()
            if target.startswith(CATEGORY_SPACES):
                self.categories.append(target.split(":", 1)[1])
            elif not target.startswith(FILE_SPACES):
                stack[-1].add("|".join(args[1:]) if len(args) > 1 and args[1] else target.split("#")[0])
        elif kind == "]":
            url, _, title = args[0].partition(" ")
            stack[-1].add(title or url)
        elif kind not in ("</ref>", "</references>"):
            stack[-1].add(args[0])

    def _tag(self, stack: list[_Frame], opened: dict[str, int], mark: str) -> None:
        name = re.match(r"</?([A-Za-z]+)", mark)[1].lower()
        kind = f"</{name}>"
        if name == "br":
            stack[-1].add("\n")
        elif mark.startswith("</"):
            if opened.get(kind):
                self._close(stack, opened, kind)
        elif not mark.endswith("/>"):
            stack.append(_Frame(kind, mark))
            opened[kind] = opened.get(kind, 0) + 1

    def template(self, name: str, args: list[str]) -> str:
        """The text of a template inside a line."""
        arg = lambda i: args[i] if i < len(args) else ""
        if name in LINKS:
            return arg(1) or arg(0)
        if name == REGISTRY:
            digits = re.search(r"\d+", arg(0))
            if digits and self.registry is None:
                self.registry = int(digits.group())
            return ""
        if name == CITATION:
            self.citations.append((arg(0), arg(1), arg(2)))
            return arg(0)
        if name not in FIRST_ARGUMENT:
            self.unknown.append(name)
            return arg(0) if len(args) == 1 else " ".join(filter(None, args))
        return arg(0)

    def rendered(self, first: int = 0) -> str:
        return "".join([n if isinstance(n, str) else self.template(*n) for n in self.nodes[first:]]).strip()


def parse_line(raw: str) -> dict | None:
    """The fields of one logical line; None for lines without content."""
    raw = raw.strip()
    in_div = bool(re.match(r"</?div\b", raw))
    if in_div:
        raw = "" if "law-toc" in raw else DIV.sub("", raw).strip()
    if not raw or raw.startswith("__"):
        return None
    heading = re.fullmatch(r"(=+)([^=].*?)\1", raw)
    line = Line(heading[2] if heading else raw)
    first = next((i for i, n in enumerate(line.nodes) if not isinstance(n, str) or n.strip()), None)
    out = dict.fromkeys(("level", "label", "title", "note"))
    if first is None:
        out |= {"kind": "plain", "text": ""}
    else:
        name, args = line.nodes[first] if isinstance(line.nodes[first], tuple) else ("", [])
        arg = lambda i: args[i] if i < len(args) else ""
        if name in HEADINGS:
            out |= {"kind": "heading", "level": HEADINGS[name], "label": arg(0), "title": arg(1) or arg(0), "text": ""}
        elif name in ITEMS:
            body = line.rendered(first + 1)
            out |= {"kind": "item", "level": ITEMS[name], "label": clean_label(arg(0)), "text": f"{arg(0)} {body}".strip()}
        elif name in KINDS:
            kind = KINDS[name]
            out |= {"kind": kind, "text": "" if kind in ("title", "signatures") else line.rendered(first + 1)}
            if kind == "signatures":  # nothing of the line counts
                line = Line("")
            elif kind == "title":
                out["title"] = arg(0)
            elif kind == "section":
                out |= {"label": clean_number(arg(0)), "title": arg(1) or None, "note": " ".join(filter(None, args[2:])) or None}
        else:
            out |= {"kind": "text", "text": line.rendered(first)}
    return out | {"in_div": in_div, "registry": line.registry, "citations": line.citations, "categories": line.categories, "unknown": line.unknown}


def clean_number(value: str) -> str:
    """A section's number without the word before it, the point after it and spaces; typographic quotation marks as plain ones."""
    words = value.split()
    joined = "".join(words[1:] if len(words) > 1 and words[0] == SECTION_WORD else words)
    return joined.rstrip(".").replace("״", '"').replace("׳", "'")


def clean_label(value: str) -> str:
    return value.strip().strip("().").strip() or value.strip()


def table_rows(block: list[str]) -> Iterator[str]:
    """The rows of a table, cells divided by bars."""
    cells: list[str] = []
    for raw in [*block, "|-"]:
        line = raw.strip()
        if line.startswith("|-"):
            if cells:
                yield " | ".join(cells)
            cells = []
        elif line.startswith(("|", "!")) and not line.startswith(("|}", "|+")):
            for cell in re.split(r"\|\||!!", line[1:]):
                style, bar, value = cell.partition("|")
                cells.append(Line(value if bar and "=" in style else cell).rendered())
        elif cells and line and not line.startswith(("{|", "|}", "|+")):
            cells[-1] += " " + Line(line).rendered()


def logical_lines(text: str) -> Iterator[tuple[str, list[str]]]:
    """("line", lines with the templates they open) or ("table", lines of the table)."""
    held: list[str] = []
    depth, table = 0, False
    for line in text.splitlines():
        if not held and line.lstrip().startswith("{|"):
            table = True
        held.append(line)
        depth += line.count("{{") - line.count("}}")
        if table and not line.lstrip().startswith("|}") or not table and depth > 0:
            continue
        yield ("table" if table else "line"), held
        held, depth, table = [], 0, False
    if held:
        yield ("table" if table else "line"), held


def parsed_lines(text: str) -> Iterator[dict]:
    for kind, held in logical_lines(text):
        if kind == "table":
            for row in table_rows(held):
                if row.strip():
                    yield dict.fromkeys(("level", "label", "title", "note", "registry")) | {"kind": "row", "text": row.strip(), "in_div": False, "citations": [], "categories": [], "unknown": []}
        elif (fields := parse_line("\n".join(held))) is not None:
            yield fields


def law_lines(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(page, line, kind, ...): the parsed lines of each page; a null text has none.  Page ids are taken to be unique."""
    schema = f"page long, {SCHEMA}"
    names = [f.split()[0] for f in SCHEMA.split(", ")]  # the first word of each field; fields inside structs have colons
    names = [n for n in names if ":" not in n]
    citation = pa.struct([("ref", pa.string()), ("name", pa.string()), ("url", pa.string())])
    kinds = dict(zip(names, [pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.int64(), pa.list_(citation), pa.list_(pa.string()), pa.list_(pa.string())]))

    def laid(rows: list[tuple[int, dict]]) -> pa.RecordBatch:
        columns = [pa.array([r[n] for _, r in rows], t) for n, t in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array([page for page, _ in rows], pa.int64()), *columns], ["page", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, dict]] = []
        size = 0
        for batch in batches:
            for page, text in zip(batch.column(0), batch.column(1)):
                number = page.as_py()
                for i, r in enumerate(parsed_lines(text.as_py() or "")):
                    r["line"] = i
                    r["citations"] = [dict(zip(("ref", "name", "url"), x)) for x in r["citations"]]
                    rows.append((number, r))
                    size += len(r["text"])
                    if len(rows) >= BATCH_LINES or size >= BATCH_CHARS:  # many small pages, or parts of a large one
                        yield laid(rows)
                        rows, size = [], 0
        if rows:
            yield laid(rows)

    return pages.select(F.col(id_col).cast("long").alias("page"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
