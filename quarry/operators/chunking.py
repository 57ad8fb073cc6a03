"""Table-generating operators: units of a text and their packing into token-budgeted chunks.

Each document is cut by itself within an Arrow batch; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
PARAGRAPH_END = re.compile(r"\n\s*\n")
#: A sentence of a page, of a paragraph, and of a judgment (which lone enumerators before it belong to).
PAGE_SENTENCE = re.compile(r"\S.*?(?:[.!?](?=\s)|\Z)", re.S)
CLAUSE = re.compile(r"\S.*?(?:[.!?;](?=\s)|\Z)", re.S)
JUDGMENT_SENTENCE = re.compile(r"(?:\(?(?:\d{1,3}|[A-Za-zא-ת])\)?[.:]\s+)*\S.*?(?:[.!?:](?=\s)|\Z)", re.S)
ITEM = re.compile(r"\s*(?:\(?\d{1,3}[.)]|\([A-Za-zא-ת]{1,2}\)|[א-ת]{1,2}\.)\s")


def tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def heuristic_tokens(text: str) -> int:
    return max(1, int(len(text) / (2.5 if any(ch > "֐" for ch in text) else 4)))


def _sums(sizes: list[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def windows(sizes: list[int], budget: int, overlap: int = 0) -> list[tuple[int, int]]:
    """[(first, end)] of consecutive units, each as long as the budget allows, found by a search in the sums of sizes.

    A window reaches back over units of the one before, up to ``overlap``, where its first new unit still fits with them.
    """
    sums, out, new = _sums(sizes), [], 0
    while new < len(sizes):
        back = max(0, min(overlap, budget - sizes[new])) if out else 0
        first = max(out[-1][0] if out else 0, bisect_left(sums, sums[new] - back))
        end = max(new + 1, bisect_right(sums, sums[first] + budget) - 1)
        out.append((first, end))
        new = end
    return out


def cut_sentences(text: str, budget: int, count: Callable[[str], int] = tokens) -> list[str]:
    """A paragraph in pieces of whole sentences within the budget; a sentence beyond it is cut by length."""
    step, out = max(2 * budget, 200), []
    sized = [(m[0], count(m[0])) for m in CLAUSE.finditer(text)]
    for beyond, run in groupby(sized, lambda x: x[1] > budget):
        found, sizes = zip(*run)
        if beyond:
            out += [x[i : i + step] for x in found for i in range(0, len(x), step)]
        else:
            out += [" ".join(found[a:b]) for a, b in windows(sizes, budget)]
    return out


def pack_paragraphs(text: str, budget: int, overlap: int, count: Callable[[str], int] = tokens) -> list[str]:
    """Lines packed up to the budget; a group begins with the last lines of the one before, up to ``overlap`` tokens."""
    units, sizes = [], []
    for line in filter(None, map(str.strip, text.split("\n"))):
        size = count(line)
        pieces = [line] if size <= budget else cut_sentences(line, budget, count)
        units += pieces
        sizes += [size] if size <= budget else map(count, pieces)
    return ["\n".join(units[a:b]) for a, b in windows(sizes, budget, overlap)]


def page_chunks(pages: list[tuple[str, str]], most: int, count: Callable[[str], int] = heuristic_tokens) -> list[tuple[str, str]]:
    """(language, text): sentences of the paragraphs of pages, packed; a chunk has one language.

    A chunk ends where the language changes, where the next sentence would exceed ``most``, and at the first end of a
    paragraph at which it is more than 85 % full.  A sentence beyond ``most`` stays whole.
    """
    out = []
    for lang, run in groupby(pages, lambda p: p[1]):
        found, ends = [], []
        for paragraph in (p for text, _ in run for p in PARAGRAPH_END.split(text) if p.strip()):
            found += [m[0].rstrip() for m in PAGE_SENTENCE.finditer(paragraph)]
            ends.append(len(found))
        sums, at = _sums([count(x) for x in found]), 0
        while at < len(found):
            fits = max(at + 1, bisect_right(sums, sums[at] + most) - 1)
            full = bisect_right(sums, sums[at] + 0.85 * most)
            paragraph_end = bisect_left(ends, full)
            end = min(fits, ends[paragraph_end]) if paragraph_end < len(ends) else fits
            out.append((lang, " ".join(found[at:end])))
            at = end
    return out


class Unit(NamedTuple):
    """A sentence with its place; ``opens``: the first of its paragraph, item or heading; ``holding``: of the operative part."""

    start: int
    end: int
    tokens: int
    opens: bool
    heading: bool
    holding: bool


def _bare(line: str) -> str:
    """A heading line without its number and colon."""
    return ITEM.sub("", line + " ", count=1).strip().rstrip(":").rstrip()


def operative_start(text: str, start: int, headings: frozenset[str]) -> int:
    """Where the operative part begins: the last line that is one of ``headings``, else the last that opens with one; else the end."""
    whole = opening = len(text) + 1
    begins = tuple(headings)
    for m in re.compile(r"^.*\S.*$", re.M).finditer(text, start) if begins else ():
        bare = _bare(m[0])
        if bare in headings:
            whole = m.start()
        elif bare.startswith(begins):
            opening = m.start()
    return whole if whole <= len(text) else opening


class Counted:
    """A text whose tokens are found once; spans that cut no token are counted by a search in their starts."""

    def __init__(self, text: str, start: int = 0):
        self.starts = [m.start() for m in TOKEN.finditer(text, start)]

    def __call__(self, a: int, b: int) -> int:
        return bisect_left(self.starts, b) - bisect_left(self.starts, a)


def body_units(text: str, start: int, most: int, headings: frozenset[str], holding: frozenset[str], count: Counted | None = None) -> list[Unit]:
    """Sentences of the paragraphs, numbered items and headings from ``start`` on, with their places; long ones cut at words."""
    count = count or Counted(text, start)
    operative = operative_start(text, start, holding)
    lines = [(m.start(), m.end()) for m in re.compile(r"^.*\S.*$", re.M).finditer(text, start)]
    titled = [b - a <= 60 and len(bare := _bare(text[a:b])) <= 40 and bare in headings | holding for a, b in lines]
    # a paragraph opens after a blank line, at an item or a heading, after a heading, and where the operative part begins
    opens = [
        i == 0 or text.count("\n", lines[i - 1][1], lines[i][0]) > 1 or titled[i] or titled[i - 1] or ITEM.match(text, lines[i][0]) is not None or lines[i][0] == operative
        for i in range(len(lines))
    ]
    firsts = [i for i, o in enumerate(opens) if o]
    out = []
    for i, after in zip(firsts, [*firsts[1:], len(lines)]):
        a, b = lines[i][0], lines[after - 1][1]
        spans = [s for m in JUDGMENT_SENTENCE.finditer(text, a, b) for s in _word_groups(text, m.start(), m.start() + len(m[0].rstrip()), most, count)]
        for n, (c, d) in enumerate(spans):
            out.append(Unit(c, d, count(c, d), n == 0, titled[i] or a == operative and n == 0, a >= operative))
    return out


def _word_groups(text: str, a: int, b: int, most: int, count: Counted) -> list[tuple[int, int]]:
    """Spans of equal numbers of words that all fit, a word being the least; group sizes come from sums of the words' tokens."""
    if count(a, b) <= most:
        return [(a, b)]
    words = [m.span() for m in re.compile(r"\S+").finditer(text, a, b)]
    sums = _sums([count(c, d) for c, d in words])

    def parts(lo: int, hi: int) -> Iterator[tuple[int, int]]:
        size = sums[hi] - sums[lo]
        if size <= most or hi - lo == 1:
            yield words[lo][0], words[hi - 1][1]
            return
        step = -(-(hi - lo) // math.ceil(size / (0.9 * most)))
        for at in range(lo, hi, step):
            yield from parts(at, min(at + step, hi))

    return list(parts(0, len(words))) if words else []


def pack_units(units: list[Unit], least: int, most: int, overlap: int, heading_least: int = 100) -> list[list[Unit]]:
    """Chunks of whole units: one ends at a paragraph once ``least`` is reached, or before ``most`` is exceeded.

    Its last units, but never all, open the next up to ``overlap`` tokens if the next unit fits with them.  The operative
    part, and a heading after ``heading_least`` new tokens, begin a chunk without overlap.  Each end is the least of the
    places that a search in the sums of sizes gives.
    """
    n, sums = len(units), _sums([u.tokens for u in units])
    paragraphs = [i for i, u in enumerate(units) if u.opens]
    headings = [i for i, u in enumerate(units) if u.opens and u.heading]
    parts = [i for i, u in enumerate(units) if u.holding and (i == 0 or not units[i - 1].holding)]
    following = lambda places, at: places[k] if (k := bisect_left(places, at)) < len(places) else n
    out, first, new = [], 0, 0
    while new < n:
        section = min(following(parts, new + 1), following(headings, max(new + 1, bisect_left(sums, sums[new] + heading_least))))
        fits = max(new + 1, bisect_right(sums, sums[first] + most) - 1)
        enough = following(paragraphs, max(new + 1, bisect_left(sums, sums[first] + least)))
        end = min(section, fits, enough)
        out.append(units[first:end])
        back = max(first + 1, bisect_left(sums, sums[end] - overlap))
        keeps = end < n and end != section and sums[end + 1] - sums[back] <= most
        first, new = (min(back, end) if keeps else end), end
    return out


def chunk_judgment(text: str, least: int = 400, most: int = 600, overlap: int = 80, headings: frozenset[str] = frozenset(), holding: frozenset[str] = frozenset(), start: int = 0) -> list[tuple[int, int, int, bool, str]]:
    """(char_start, char_end, tokens, is_holding, text) of each chunk of a document's body."""
    out, count = [], Counted(text, start)
    for chunk in pack_units(body_units(text, start, most, headings, holding, count), least, most, overlap):
        a, b = chunk[0].start, chunk[-1].end
        out.append((a, b, count(a, b), chunk[-1].holding, text[a:b]))
    return out


def section_rows(text: str, first_most: int = 10, jump: int = 30) -> list[tuple[str | None, str, str]]:
    """(number, title, body): numbered sections that advance, each with the heading before it; what comes first has no number."""
    out: list[tuple[str | None, str, list[str]]] = [(None, "", [])]
    now, title = 0, ""
    for line in text.split("\n"):
        m = re.match(r"\s*(?:Section\s+|סעיף\s+)?(\d{1,4})([a-zא-ת]{0,2})\.\s*(.*)", line)
        n = int(m[1]) if m else 0
        if m and ((not now and n <= first_most) or (now and now <= n <= now + jump and (n > now or m[2]))):
            out.append((m[1] + m[2], title, [m[3]]))
            now, title = n, ""
            continue
        short = line.strip()
        if short and len(short.split()) <= 5 and not re.search(r"[.;:,!?]$", short) and not re.match(r"[(\"'\d]", short):
            title = short
        out[-1][2].append(line)
    return [(n, t, "\n".join(b).strip()) for n, t, b in out if n is not None or "\n".join(b).strip()]


def subsections(body: str) -> list[tuple[str, str]]:
    """(label, text): top-level markers only where they follow the one before; the intro has no label."""
    out: list[tuple[str, str]] = []
    last = 0
    label, expected = "", 1
    for m in re.finditer(r"(?:^|\s)\((\d{1,2}|[a-z])\)\s", body):
        value = int(m[1]) if m[1].isdigit() else ord(m[1]) - 96
        if value == expected and (not label or m[1].isdigit() == label.isdigit()):
            out.append((label, body[last : m.start()].strip()))
            label, expected, last = m[1], expected + 1, m.end()
    out.append((label, body[last:].strip()))
    return [(x, t) for x, t in out if t]


def per_document(df: DataFrame, id_col: str, text_col: str, cut: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """``id`` and a row for each that ``cut`` makes of the text, with ``index`` from 0 and ``total``; null texts make none."""
    out_schema = f"id long, index int, total int, {schema}"
    names = [f.strip().split()[0] for f in out_schema.split(",")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.strip().split()[1]] for f in out_schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for i, text in zip(*(batch.column(c).slice(at, 256).to_pylist() for c in (0, 1))):
                    made = cut(text) if text is not None else []
                    rows += [(i, n, len(made), *r) for n, r in enumerate(made)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out_schema)


# ---- transcripts and threads, with windows ----


def sessions(df: DataFrame, by: str, order: str, opens, name: str = "session") -> DataFrame:
    """A running number that grows where ``opens`` holds: messages of a thread, question and answer pairs."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.when(opens, 1).otherwise(0)).over(w))


def line_offsets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, start, line): where each line begins, in code points; one fold over a text's lines."""
    from ..functions.text import lines

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    fold = F.aggregate(lines(F.col(text_col)), start, lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")))
    each = df.select(F.col(id_col).alias("id"), F.arrays_zip(lines(F.col(text_col)).alias("line"), fold["starts"].alias("start")).alias("z"))
    return each.select("id", F.posexplode("z").alias("line_no", "x")).select("id", "line_no", F.col("x.start").alias("start"), F.col("x.line").alias("line"))
