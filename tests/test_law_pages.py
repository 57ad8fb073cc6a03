import random
import re
import time
from collections import Counter

from quarry.operators import law_pages
from quarry.sources import wikitext
from quarry.sources.wikitext import ITEMS, Line, clean_label, clean_number, law_lines, parse_line


def test_inline_marks():
    line = Line("a {{ח:פנימי|x|in {{ח:מוקטן|small}}}} [[page#x|shown]] [[other#y]] [[קטגוריה:k]] [http://a.b?c=1 text] <b>bold</b><ref>note</ref>&quot;''it''<br/>{{odd|1|k=v|2}}<!-- no -->")
    assert line.rendered() == 'a in small shown other  text bold"it\n1 2'
    assert (line.categories, line.unknown) == (["k"], ["odd"])
    line = Line("{{ח:מאגר|nr 2000292}}{{ח:תיבה|ref|name|http://x/y.pdf}} t")
    assert line.rendered() == "ref t" and (line.registry, line.citations) == (2000292, [("ref", "name", "http://x/y.pdf")])
    assert Line("{{a|{{b|c}} [[d|e <i>f").rendered() == "{{a|c [[d|e f" and Line("x}} ]] | = <!-- y").rendered() == "x}} ]] | = <!-- y"
    assert clean_number("סעיף 3 א״1.") == '3א"1' and clean_label("(א)") == "א" and clean_label("()") == "()"


def test_marks_that_never_close_take_linear_time():
    for piece in ("{{", "[[", "<a", "<b>", "<!--", "{{a|", "[http://", "{{{{}}", "]]", "&#", "''"):
        began = time.time()
        assert Line(piece * 60_000).rendered() is not None and parse_line("{{ח:סעיף|1" + piece * 30_000)
        assert time.time() - began < 5, piece


def recursive(text, at=0, close=None):
    """A plain recursive parser of balanced templates: (nodes, end)."""
    nodes, buffer = [], ""
    while at < len(text):
        if text.startswith("{{", at):
            args, at = [], at + 2
            while True:
                inner, at = recursive(text, at, ("|", "}}"))
                args.append(inner)
                if text.startswith("}}", at):
                    at += 2
                    break
                at += 1
            nodes += [buffer, ("t", args)]
            buffer = ""
        elif close and any(text.startswith(x, at) for x in close):
            break
        else:
            buffer += text[at]
            at += 1
    return [*nodes, buffer], at


def shown(nodes, unknown):
    out = ""
    for n in nodes:
        if isinstance(n, str):
            out += n
            continue
        name, args = shown(n[1][0], unknown).strip(), [shown(a, unknown).strip() for a in n[1][1:]]
        if name in wikitext.FIRST_ARGUMENT:
            out += args[0] if args else ""
        elif name in wikitext.LINKS:
            out += (args[1] if len(args) > 1 and args[1] else args[0]) if args else ""
        else:
            unknown[name] += 1
            out += args[0] if len(args) == 1 else " ".join(a for a in args if a)
    return out


class Plain:
    """One line after the other, with the state in variables."""

    def __init__(self, text):
        self.blocks, self.heads, self.box, self.toc, self.box_text, self.unknown, self.order = [], {}, False, False, [], Counter(), []
        self.fresh, self.under = False, None
        for raw in text.split("\n"):
            if raw.strip():
                self.line(raw.strip())

    def open(self, kind, number, title):
        h = self.heads
        self.blocks.append({"kind": kind, "number": number, "title": title, "chapter": h.get(2), "division": h.get(1), "sub": " > ".join(h[k] for k in (3, 4) if k in h) or None, "intro": [], "subs": []})
        self.fresh = False
        self.order.append(self.blocks[-1])

    def target(self):
        if self.fresh:
            self.open("schedule", self.under[0] or self.under[1], self.under[1])
        elif not self.blocks:
            self.open("preamble", "preamble", None)
        return self.blocks[-1]

    def write(self, text):
        if not text:
            return
        if self.box:
            self.box_text.append(text)
            return
        b = self.target()
        if b["subs"]:
            b["subs"][-1][1] += "\n" + text
        else:
            b["intro"].append(text)

    def line(self, raw):
        nodes, _ = recursive(raw)
        first = next(i for i, n in enumerate(nodes) if n)
        head = nodes[first] if not isinstance(nodes[first], str) else None
        mine = Counter()
        name = shown(head[1][0], mine).strip() if head else ""
        args = [shown(a, mine).strip() for a in head[1][1:]] if name in wikitext.KINDS or name in wikitext.HEADINGS or name in ITEMS else []
        arg = lambda i: args[i] if i < len(args) else ""
        if self.toc and name not in wikitext.HEADINGS and name != "ח:סעיף":
            return
        if name in wikitext.HEADINGS:
            level, heading = wikitext.HEADINGS[name], arg(1) or arg(0)
            self.toc = law_pages.CONTENTS in heading
            if self.toc:
                return
            self.unknown += mine
            self.heads = {k: v for k, v in self.heads.items() if k < level} | {level: heading}
            self.under, self.fresh = (arg(0), heading), True
            self.order.append(heading)
            return
        kind = wikitext.KINDS.get(name)
        rest = "" if kind in ("signatures", "title") else shown(nodes[first + 1 :] if kind or name in ITEMS else nodes[first:], mine).strip()
        self.unknown += mine
        self.box = {"box_start": True, "box_end": False}.get(kind, self.box)
        if kind == "section":
            self.toc = False
            self.open("section", clean_number(arg(0)), arg(1) or None)
        if kind == "preamble":
            self.open("preamble", "preamble", None)
        if name in ITEMS and not self.box:
            text = f"{arg(0)} {rest}".strip()
            b = self.target()
            if ITEMS[name] == 1:
                b["subs"].append([clean_label(arg(0)), text])
            elif text:
                b["subs"][-1:] or b["intro"].append(text)
                if b["subs"]:
                    b["subs"][-1][1] += "\n" + text
        elif name in ITEMS:
            self.write(f"{arg(0)} {rest}".strip())
        elif kind not in ("title", "signatures"):
            self.write(rest)


def generated(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "א", "ב"]

    def inline(depth=0):
        out = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        if depth < 3 and rng.random() < 0.5:
            name = rng.choice(["ח:פנימי", "ח:מוקטן", "ח:הערה", "odd", "other_one"])
            out.insert(rng.randrange(len(out) + 1), "{{" + name.replace("_", " ") + "|" + "|".join(inline(depth + 1) for _ in range(rng.randint(1, 3))) + "}}")
        return " ".join(out)

    lines = []
    for i in range(rng.randint(1, 40)):
        kind = rng.choice(["ח:קטע1", "ח:קטע2", "ח:קטע3", "ח:קטע4", "ח:סעיף", "ח:סעיף", "ח:תת", "ח:תת", "ח:תתת", "ח:ת", "ח:ת", "", "", "ח:מבוא", "ח:פתיח-התחלה", "ח:סוגר", "ח:חתימות", "toc"])
        if kind == "toc":
            lines.append("{{ח:קטע2|x|" + law_pages.CONTENTS + "}}")
        elif kind in wikitext.HEADINGS:
            lines.append("{{" + kind + "|" + rng.choice(["", f"a{i}"]) + "|" + inline() + "}}")
        elif kind == "ח:סעיף":
            lines.append("{{ח:סעיף|" + f"{i}|{rng.choice(['', inline()])}" + "}} " + rng.choice(["", inline()]))
        elif kind:
            lines.append("{{" + kind + (f"|({i})" if kind in ITEMS else "") + "}} " + rng.choice(["", inline()]))
        else:
            lines.append(inline())
    return "\n".join(lines)


def test_pages_equal_the_plain_version(spark):
    texts = {i: generated(i) for i in range(120)}
    texts[500], texts[501] = "", None
    pages = spark.createDataFrame([(i, f"page {i}", t) for i, t in texts.items()], "page_id long, title string, text string")
    lines = law_lines(pages)
    got = {r.page: r for r in law_pages.law_records(pages, lines).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = Plain(text or "")
        blocks = [(b["kind"], b["number"], b["title"], b["division"], b["chapter"], b["sub"], "\n".join(b["intro"]), [tuple(s) for s in b["subs"]]) for b in want.blocks]
        found = [(s.kind, s.number, s.title, s.division, s.chapter, s.subchapter, s.intro, [(x.label, x.text) for x in s.subsections]) for s in got[i].sections or []]
        assert found == blocks, text
        assert {x.name: x.n for x in got[i].unknown or []} == dict(want.unknown)
        whole = [f"page {i}", ""]
        for part in want.order:
            if isinstance(part, str):
                whole += ["", part]
            else:
                whole += [f"{part['number']}. {part['title']}" if part["title"] else f"{part['number']}."] * (part["kind"] == "section")
                whole.append("\n".join([*filter(None, ["\n".join(part["intro"])]), *(s[1] for s in part["subs"])]).strip())
        assert got[i].text == re.sub(r"\n{3,}", "\n\n", "\n".join(whole)).strip()


PAGE = """{{ח:התחלה}}
{{ח:כותרת|חוק הדוגמה, תשל״ג–1973}}
{{ח:פתיח-התחלה}} {{ח:מאגר|2000292}}
{{ח:תיבה|ס״ח תשל״ג, 118|חוק|https://x.y/a.pdf}} (בוטל בשנת 1980)
{{ח:סוגר}}
<div class="law-toc">
{{ח:קטע2||תוכן עניינים}}
{{ח:ת}} listed
</div>
{{ח:קטע2|פרק א|פרק א׳: כריתה}}
{{ח:סעיף|3א.|חזרה
מן ההצעה|(תיקון: 1)}} פתיח
{{ח:תת|(א)}} ראשון
{{ח:תתת|(1)}} עמוק
{| class="t"
! a !! b
|-
| style="x" | 1 || 2
|}
{{ח:קטע1||תוספת}}
free text
{{ח:חתימות}} names
"""


def test_a_page_with_everything(spark):
    pages = spark.createDataFrame([(7, "חוק הדוגמה", PAGE)], "page_id long, title string, text string")
    r = law_pages.law_records(pages, law_lines(pages)).first()
    assert (r.title, r.registry_id, r.repealed, r.parsed, r.unknown, r.notes) == ("חוק הדוגמה, תשל״ג–1973", 2000292, True, True, None, [])
    assert [tuple(x) for x in r.citations] == [("ס״ח תשל״ג, 118", "חוק", "https://x.y/a.pdf")]
    a, b = r.sections
    assert (a.kind, a.number, a.title, a.note, a.chapter, a.intro) == ("section", "3א", "חזרה\nמן ההצעה", "(תיקון: 1)", "פרק א׳: כריתה", "פתיח")
    assert [tuple(x) for x in a.subsections] == [("א", "(א) ראשון\n(1) עמוק\na | b\n1 | 2")]
    assert (b.kind, b.number, b.title, b.chapter, b.text) == ("schedule", "תוספת", "תוספת", None, "free text")
    registry = spark.createDataFrame([(2000292, "other", "1973-05-01"), (5, "x", None)], "law_id long, name string, effective_date string")
    done = law_pages.corpus_records(law_pages.law_records(pages, law_lines(pages)), registry).first()
    assert (done.id, done.law_id, done.law_id_source, done.status, done.effective_date) == ("wikisource:7", 2000292, "id", "repealed", "1973-05-01")
    done = law_pages.corpus_records(law_pages.law_records(pages, law_lines(pages)), registry.where("law_id = 5")).first()
    assert (done.law_id, done.effective_date, done.notes) == (None, "1973-01-01", ["effective_date is the year in the title"])


def test_pages_are_parsed_once_and_small_pages_share_batches(spark, sf_dir):
    from quarry.plans import laws
    from quarry.sources import wikitext

    for name in ("law_page_sections", "law_page_records", "law_chunks"):
        plan = laws.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan  # the lines were written before
    pages = spark.createDataFrame([(i, f"{{{{ח:סעיף|{i}.|t}}}} one\ntwo\n\nthree") for i in range(500)] + [(500, None), (501, "")], "page_id long, text string").coalesce(1)
    lines = wikitext.law_lines(pages)
    sizes = lines.mapInArrow(lambda batches: (b.select(["line"]).slice(0, 1) for b in batches), "line int").count()
    got = {}
    for r in lines.collect():
        got.setdefault(r.page, []).append((r.line, r.kind, r.text))
    assert got == {i: [(0, "section", "one"), (1, "text", "two"), (2, "text", "three")] for i in range(500)} and sizes < 500
