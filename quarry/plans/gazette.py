"""Amending laws laid around the words of the documents, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal
from ..operators import gazette
from ._base import Plans, table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col


def _laws(spark, sf_dir):
    """A source for each document of three words: a list of two amended laws and a section that amends one of them and inserts three provisions."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") >= 3)
    w = [F.get("w", k) for k in range(3)]
    n, k = c("doc_id") % 90 + 1, c("doc_id") % 50 + 1
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    preamble = say("תיקונים עקיפים:\nחוק ", w[0], " ", w[1], " ", w[2], ', התש"ט-1959 - מס\' ', n, "\nחוק ", w[2], " ", w[1], ', התש"ט-1960 - הוראת שעה - מס\' ', n + 1)
    kind = c("doc_id") % 3
    title = F.when(kind == 0, say("תיקון חוק ", w[0], " ", w[1], " - מס' ", n)).when(kind == 2, "מטרה")
    opening = F.when(kind == 1, say("בחוק ", w[2], " ", w[1], ', התש"ט-1960, ')).otherwise("")
    clause = say("סעיף 999\n\n", opening, "בסעיפים ", k, "(ג), ", k, "א1 ו־", k + 100, ", אחרי סעיף ", k, "כ1 יבוא:\n", w[0], " ", w[1], "\n", w[1], " ", w[2], " ", k, " כ 3. ", w[0], "\n", k, "כ4. ", w[1], ".\";\nסוף")
    text = F.when(kind == 2, say("סעיף 999\n\nמטרתו של חוק זה ", w[0])).otherwise(clause)
    return d.select(c("doc_id").alias("source"), F.lit(1).alias("section"), title.alias("title"), legal.join_spaced_numbers(text).alias("text"), preamble.alias("preamble"))


@P.add(
    r"""WITH d AS (SELECT doc_id, w[1] AS a, w[2] AS b, w[3] AS c, doc_id % 3 AS kind, doc_id % 90 + 1 AS n, doc_id % 50 + 1 AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents) WHERE len(w) >= 3)
    SELECT doc_id AS source, CASE kind WHEN 0 THEN 'חוק ' || a || ' ' || b || ' ' || c || ', התש"ט-1959' ELSE 'חוק ' || c || ' ' || b || ', התש"ט-1960' END AS target,
      CASE kind WHEN 0 THEN 'חוק ' || a || ' ' || b || ' ' || c ELSE 'חוק ' || c || ' ' || b END AS target_key, CAST(n + kind AS VARCHAR) AS number,
      k || ',' || k || 'א1,' || (k + 100) || ',' || k || 'כ1,' || k || 'כ4' AS sections, kind = 1 AS temporary,
      k || 'כ2||' || a || ' ' || b || '|true;' || k || 'כ3|' || b || ' ' || c || ' ' || a || '||false;' || k || 'כ4||' || b || '.";|false' AS provisions FROM d WHERE kind < 2"""
)
def gazette_amendments(spark, sf_dir):
    laws = _laws(spark, sf_dir)
    found = gazette.amendment_rows(laws, laws, "source", "section", "title", "text", "preamble")
    provision = lambda p: F.concat_ws("|", p["number"], F.coalesce(p["title"], F.lit("")), p["text"], p["inferred"].cast("string"))
    return found.select("source", "target", "target_key", "number", F.array_join("sections", ",").alias("sections"), "temporary", F.array_join(F.transform("provisions", provision), ";").alias("provisions"))
