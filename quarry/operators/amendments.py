"""What an amending clause does to a law: the law, its sections, and the text that it inserts or replaces.

The rules work on one clause at a time; ``amendment_rows`` applies them to a table by Arrow batches.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from .chunking import per_document

# The words that mark sections, insertions, replacements and temporary laws.
SECTION = r"(?:[Ss]ections?|[Ss]ec\.|סעיפים|בסעיף|לסעיף|סעיף)"
NUMBER = r"\d{1,4}[A-Za-zא-ת]{0,2}(?:\(\w{1,3}\))*"
INSERT = re.compile(r"(?:after\s+(?:section|subsection)\s+(?P<after>[\w()]+)[^:]{0,60}(?:insert|add)|(?:אחרי|לאחר)\s+(?:סעיף|סעיף קטן)\s+(?P<after_he>[\w()]+)[^:]{0,40}יבוא)[^:\n]*:", re.I)
REPLACE = re.compile(r"(?:in place of|instead of|for)\s+(?:section|subsection)\s+(?P<of>[\w()]+)[^:]{0,60}(?:substitute|replace|shall (?:come|read))[^:\n]*:|במקום\s+(?:סעיף|סעיף קטן)\s+(?P<of_he>[\w()]+)[^:]{0,40}יבוא[^:\n]*:", re.I)
AMENDED = re.compile(r"^(?P<name>.{3,120}?)\s*\((?:Amendment|תיקון)\s*(?:No\.|מס['׳])?\s*(?P<number>\d{1,4})?\s*(?P<temporary>[-–,]?\s*(?:Temporary Provision|הוראת שעה))?\s*\)", re.I)
TEMPORARY = re.compile(r"Temporary Provision|הוראת שעה", re.I)
READS_AS = re.compile(r"(?:shall|will)\s+(?:be read|apply)\s+(?:as if|with)|(?:ייקרא|יקראו|יחול)\s+(?:כאילו|בשינויים)", re.I)
OTHER_LAW = re.compile(rf"{SECTION}\s+{NUMBER}\s+(?:of|to)\s+the\s+[A-Z]|{SECTION}\s+{NUMBER}\s+לחוק\s+ה")
ITEM = re.compile(r'^\s*["“]?(?P<open>\(?)(?P<label>\d{1,4}[A-Za-zא-ת]{0,2}|[A-Za-zא-ת]{1,2})[.)]\s+')


class Inserted(NamedTuple):
    after: str
    provisions: list[tuple[str, str]]
    rest: str


def amended_laws(preamble: str) -> list[tuple[str, int | None, bool]]:
    """(law, number of the amendment, temporary) of each line that names an amended law."""
    found = (AMENDED.match(line.strip(" .-–•\t")) for line in preamble.split("\n"))
    return [(m["name"].strip(), int(m["number"]) if m["number"] else None, bool(m["temporary"])) for m in found if m]


def target_sections(clause: str) -> list[str]:
    """Section numbers that the clause works on: after section words and those it inserts; sections of a third law are not."""
    own = OTHER_LAW.sub(" ", clause.partition(":")[0] + ":")
    named = re.findall(rf"{SECTION}\s+({NUMBER}(?:(?:\s*,\s*|\s+and\s+|\s+ו-?){NUMBER})*)", own)
    numbers = [n for group in named for n in re.findall(NUMBER, group)]
    inserted = find_insertion(clause)
    numbers += [label for label, _ in inserted.provisions if label[:1].isdigit()] if inserted else []
    return list(dict.fromkeys(numbers))


def _after(number: str) -> str:
    """The label that follows a section's: 5 gives 5A, 5A gives 5B, (2) gives 3."""
    m = re.fullmatch(r"\(?(\d+)([A-Za-zא-ת]?)\)?", number)
    if m is None:
        return ""
    if number.startswith("("):
        return str(int(m[1]) + 1)
    return m[1] + (chr(ord(m[2]) + 1) if m[2] else "A")


def find_insertion(clause: str) -> Inserted | None:
    """The provisions that the clause inserts, by their labels; a lost label follows from the one before.

    A line that opens no item belongs to the item above; lines after a closing quotation mark are instructions.
    """
    m = INSERT.search(clause)
    if m is None:
        return None
    after = m["after"] or m["after_he"]
    made: list[tuple[str, list[str]]] = []
    kind = None  # whether labels stand in brackets, and whether they are numbers: those of another kind are parts of an item
    rest: list[str] = []
    closed = False
    for line in filter(str.strip, clause[m.end() :].split("\n")):
        if closed:
            rest.append(line.strip())
            continue
        item = ITEM.match(line)
        own = None if item is None else (item["open"], item["label"][:1].isdigit())
        if own is not None and (not made or own == kind):
            kind = own
            made.append((item["label"], [line[item.end() :].strip()]))
        elif made:
            made[-1][1].append(line.strip())
        else:
            made.append((_after(after), [line.strip().lstrip("\"“")]))
        closed = line.rstrip().endswith(('"', "”", '".', "”.", '";', "”;"))
    return Inserted(after, [(label, "\n".join(x).rstrip("\"”.; ") + ("." if x[-1].rstrip("\"”; ").endswith(".") else "")) for label, x in made], "\n".join(rest))


def replaced_subsection(clause: str) -> tuple[str, str] | None:
    """(section, its new text) of a clause that replaces one."""
    m = REPLACE.search(clause)
    return None if m is None else (m["of"] or m["of_he"], clause[m.end() :].strip().strip("\"“”").strip())


def applied_with_changes(clause: str) -> str | None:
    """The law that a clause applies with modifications."""
    m = re.search(r"provisions of (?:the )?(?P<law>[A-Z][\w ,'-]{3,80}?)\s+(?:shall|will) apply,? (?:mutatis mutandis|with the (?:necessary )?(?:changes|modifications))|הוראות\s+(?P<he>חוק\s+[^,.]{3,80}?)\s*,?\s*יחולו[^.]{0,40}בשינויים", clause)
    return None if m is None else m["law"] or m["he"]


def extract_amendment(title: str | None, clause: str, toc: list[tuple[str, int | None, bool]]) -> dict | None:
    """What a clause amends: by its title, else the only law of the table of amended laws."""
    m = re.search(r"(?:Amendment of|תיקון)\s+(?:the\s+)?(?P<law>(?!No\b|מס)[^,(\n]{3,120})", title or "")
    law = m["law"].strip() if m else toc[0][0] if len(toc) == 1 else None
    if law is None:
        return None
    entry = next((e for e in toc if e[0].startswith(law) or law.startswith(e[0])), (law, None, False))
    return {
        "target": entry[0],
        "number": entry[1],
        "sections": target_sections(clause),
        "temporary": entry[2] or bool(TEMPORARY.search(f"{title or ''} {clause}")),
        "relation": "reads_as" if READS_AS.search(clause) else "amends",
    }


def reduce_preamble(text: str) -> str:
    """The enactment note and the list of amended laws."""
    kept = [line for line in text.split("\n") if re.search(r"passed by|adopted by|התקבל", line, re.I) or AMENDED.match(line.strip(" .-–•\t"))]
    return "\n".join(kept)


def strip_signatures(text: str) -> str:
    """The text without the short lines at its end that are no sentences, where one of them names a signatory."""
    lines = text.rstrip().split("\n")
    end = len(lines)
    while end and len(lines[end - 1].split()) <= 6 and not re.search(r"[.;:]\s*$", lines[end - 1]):
        end -= 1
    signed = any(re.search(r"Minister|President|Speaker|Prime|ראש הממשלה|שר|נשיא|יושב ראש", x) for x in lines[end:])
    return "\n".join(lines[:end]).rstrip() if signed else text.rstrip()


def amendment_rows(clauses: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per clause and inserted provision (id, index, total, sections, after, label, provision)."""

    def cut(text: str) -> list[tuple]:
        sections = ",".join(target_sections(text))
        found = find_insertion(text)
        if found is None:
            return [(sections, None, None, None)] if sections else []
        return [(sections, found.after, label, body) for label, body in found.provisions]

    return per_document(clauses, id_col, text_col, cut, "sections string, after string, label string, provision string")
