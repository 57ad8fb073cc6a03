"""Search and evaluation over the document, benchmark, embedding and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation, graph_index, joins, keyword_index, ranking
from ._base import Plans, table

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle
c = F.col

TERMS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
BM25 = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark), d AS (SELECT doc_id AS id, {TERMS} AS ts FROM documents),
    s AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM d), p AS (SELECT id, len(ts) AS length, unnest(ts) AS term FROM d),
    tf AS (SELECT term, id, count(*) AS tf, any_value(length) AS length FROM p WHERE term IN (SELECT term FROM q) GROUP BY term, id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT tf.term, id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) AS w FROM tf JOIN df ON tf.term = df.term, s),
    sc AS (SELECT query_id, id, sum(w) AS score FROM w JOIN q ON w.term = q.term GROUP BY query_id, id),
    bm AS (SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 50)"""

DENSE = """u AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
    dense AS (SELECT query_id, rank, id, score, label, own FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM
    (SELECT a.id AS query_id, b.id, a.label AS own, b.label, array_cosine_similarity(a.v, b.v) AS score FROM u a, u b WHERE a.id % 50 = 0)) WHERE rank <= 20)"""


def _bm25(spark, sf_dir, k=50):
    return ranking.bm25_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k)


def _dense(spark, sf_dir, k=20):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "embedding")
    return ranking.dense_search(e, asked, k)


@P.add(f"WITH {BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


def _stored_search(spark, sf_dir, terms, groups):
    """The documents as two segments of a stored index, asked by the benchmark."""
    from ..streaming.incremental import work_dir

    index = keyword_index.KeywordIndex(spark, work_dir(spark, "keywords"), terms, groups)
    docs = table(spark, sf_dir, "documents")
    index.add(docs.where("doc_id % 3 > 0"), "doc_id", "text")
    index.add(docs, "doc_id", "text")
    return index.search(table(spark, sf_dir, "benchmark"), "item_id", "text", 10).withColumn("score", F.round("score", 6))


@P.add(f"WITH {BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM bm WHERE rank <= 10")
def stored_keyword_topk(spark, sf_dir):
    from ..functions import text as T

    return _stored_search(spark, sf_dir, T.index_terms, keyword_index.one_form_groups)


#: Word groups with some prefixes and stop words of the given languages.
PREFIXES, STOP = ("re", "th", "de", "an", "ver", "ción"), ("the", "of", "and", "les")
FORMS = f"""list_filter(list_distinct([w, {', '.join(f"CASE WHEN starts_with(w, '{p}') AND length(w) - {len(p)} >= 3 THEN substr(w, {len(p) + 1}) END" for p in PREFIXES)}]), lambda x: x IS NOT NULL AND x NOT IN {STOP})"""
WORDS = rf"""list_filter(regexp_extract_all(lower(translate(text, '"''׳״‘’“”', '')), '\d+(?:[.,]\d+)*|\p{{L}}+'), lambda w: w NOT IN {STOP})"""


@P.add(
    rf"""WITH dw AS (SELECT doc_id AS id, unnest({WORDS}) AS w FROM documents), dt AS (SELECT id, unnest(CASE WHEN regexp_matches(w, '^\d') THEN [w] ELSE {FORMS} END) AS term FROM dw),
    l AS (SELECT id, count(*) AS length FROM dt GROUP BY id), s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM dt) / (SELECT count(*) FROM documents) AS average),
    qw AS (SELECT DISTINCT item_id AS query_id, w FROM (SELECT item_id, unnest({WORDS}) AS w FROM benchmark)), qt AS (SELECT query_id, w, unnest(CASE WHEN regexp_matches(w, '^\d') THEN [w] ELSE {FORMS} END) AS term FROM qw),
    tf AS (SELECT term, id, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY term, id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    wt AS (SELECT tf.term, tf.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)) AS v FROM tf JOIN df ON tf.term = df.term JOIN l ON l.id = tf.id, s),
    g AS (SELECT query_id, qt.w, id, max(v) AS v FROM wt JOIN qt ON wt.term = qt.term GROUP BY query_id, qt.w, id), sc AS (SELECT query_id, id, sum(v) AS score FROM g GROUP BY query_id, id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 10"""
)
def bm25_groups(spark, sf_dir):
    options = {"prefixes": PREFIXES, "stop": STOP}
    return _stored_search(spark, sf_dir, lambda t: keyword_index.index_terms(t, **options), lambda t: keyword_index.query_groups(t, **options))


@P.add(f"WITH t AS (SELECT doc_id AS id, unnest({TERMS}) AS term FROM documents) SELECT term, count(DISTINCT id) AS df, count(*) AS occurrences FROM t GROUP BY term")
def posting_statistics(spark, sf_dir):
    from ..functions import text as T

    p = ranking.postings(table(spark, sf_dir, "documents"), "doc_id", T.index_terms(c("text")))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@P.add(f"WITH {DENSE} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).withColumn("score", F.round("score", 6))


@P.add()
def graph_topk(spark, sf_dir):
    """The graph index over all embeddings; tests/test_graph_index.py measures its recall against the exact search."""
    from ..streaming.incremental import work_dir

    e = table(spark, sf_dir, "embeddings")
    index = graph_index.GraphIndex(spark, work_dir(spark, "graph"), 64)
    index.add(e)
    asked = e.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "embedding")
    return index.search(asked, 10, beam=300).select("query_id", "rank", "id", "score")


@P.add(
    f"""WITH {BM25}, kw AS (SELECT query_id, id, rank FROM bm), sh AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM bm),
    f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM sh) GROUP BY query_id, id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM f) WHERE rank <= 5"""
)
def rank_fusion(spark, sf_dir):
    bm = _bm25(spark, sf_dir)
    by_id = bm.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return ranking.fuse([bm, by_id], 5).withColumn("score", F.round("score", 8))


@P.add(
    f"""WITH RECURSIVE {BM25}, h AS (SELECT query_id, rank, id, n_chars FROM bm JOIN documents ON id = doc_id WHERE rank <= 20),
    g AS (SELECT query_id, 1 AS rank, n_chars AS spent, true AS kept FROM h WHERE rank = 1
    UNION ALL SELECT h.query_id, h.rank, CASE WHEN g.spent + h.n_chars <= 20000 THEN g.spent + h.n_chars ELSE g.spent END, g.spent + h.n_chars <= 20000 FROM g JOIN h ON h.query_id = g.query_id AND h.rank = g.rank + 1)
    SELECT query_id, CAST(rank AS INTEGER) AS rank FROM g WHERE kept"""
)
def budgeted_evidence(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "n_chars")
    ranked = _bm25(spark, sf_dir, 20).join(sizes, "id")
    return ranking.greedy_budget(ranked, "query_id", "rank", "n_chars", 20_000).select("query_id", "rank")


@P.add(
    f"""WITH {BM25} SELECT query_id, source, CAST(min(rank) AS INTEGER) AS rank, round(min(-score), 6) AS distance, array_to_string(list_sort(list(DISTINCT lang)), ',') AS sources FROM bm JOIN documents ON id = doc_id GROUP BY query_id, source"""
)
def collapsed_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "source", F.array("lang").alias("sources"))
    ranked = _bm25(spark, sf_dir).join(d, "id").withColumn("distance", F.round(-c("score"), 6))
    return ranking.collapse(ranked, ["query_id", "source"], "rank", "distance", "sources").withColumn("sources", F.array_join("sources", ","))


@P.add(
    f"""WITH {BM25}, sl AS (SELECT query_id, rank, id, row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) = 1 AS slot FROM bm JOIN documents ON id = doc_id)
    SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY slot DESC, rank) AS rn FROM sl) WHERE rn <= 6"""
)
def slots_then_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "lang")
    return ranking.pick_with_slots(_bm25(spark, sf_dir).join(d, "id"), "query_id", "rank", "lang", 6).select("query_id", "id")


@P.add(f"""WITH {DENSE} SELECT query_id, CAST(min(rank) FILTER (label = own AND id <> query_id) AS INTEGER) AS first_rank, count(*) FILTER (label = own) AS found FROM dense GROUP BY query_id""")
def retrieval_by_label(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), "label")
    own = labels.select(c("id").alias("query_id"), c("label").alias("own"))
    hits = _dense(spark, sf_dir).join(labels, "id").join(own, "query_id").withColumn("same", c("label") == c("own"))
    return hits.groupBy("query_id").agg(F.min(F.when(c("same") & (c("id") != c("query_id")), c("rank"))).alias("first_rank"), F.count_if("same").alias("found"))


@P.add(
    """WITH s AS (SELECT d.lang, d.source, l.quality, CASE WHEN l.toxic = 1 THEN 0.5 * l.quality ELSE CAST(l.quality AS DOUBLE) END AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
    SELECT 'lang' AS dimension, lang AS value, count(score) AS n, round(100 * avg(score), 1) AS score FROM s GROUP BY lang UNION ALL SELECT 'source', source, count(score), round(100 * avg(score), 1) FROM s GROUP BY source
    UNION ALL SELECT 'overall', 'all', count(score), round(100 * avg(score), 1) FROM s"""
)
def score_report(spark, sf_dir):
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    s = s.withColumn("score", F.when(c("toxic") == 1, 0.5 * c("quality")).otherwise(c("quality").cast("double")))
    return evaluation.score_report(s, "score", ["lang", "source"])


@P.add(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(quality = 1 AS INTEGER)::DOUBLE WHEN doc_id % 3 = 1 THEN coalesce(0.5 * CAST(toxic = 0 AS INTEGER) + 0.25 * CASE WHEN doc_id % 5 > 0 THEN quality * 2 END, CAST(toxic = 0 AS INTEGER)) ELSE CASE WHEN doc_id % 5 > 0 THEN quality * 2 END / 2.0 END AS score FROM labels"""
)
def item_scores(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    kind = F.when(c("doc_id") % 3 == 0, "exact_letter").when(c("doc_id") % 3 == 1, "label_then_judge").otherwise("judge")
    judged = F.when(c("doc_id") % 5 > 0, c("quality") * 2)
    return lab.select("doc_id", evaluation.item_score(kind, c("quality") == 1, c("toxic") == 0, judged).alias("score"))


@P.add(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN toxic = 1 OR quality = 0 THEN 'hallucination' ELSE 'abstained' END WHEN quality = 1 THEN 'correct_without_context' WHEN toxic = 1 THEN 'hallucination' ELSE 'partial_without_context' END AS class FROM labels"""
)
def baseline_classes(spark, sf_dir):
    group = F.when(c("doc_id") % 4 == 0, "C").otherwise("A")
    verdict = F.when(c("quality") == 1, "correct").when(c("toxic") == 1, "incorrect").otherwise("partially_correct")
    return table(spark, sf_dir, "labels").select("doc_id", evaluation.baseline_class(group, verdict, c("toxic") == 1, F.lit(False)).alias("class"))


@P.add(
    """WITH s AS (SELECT conv_id, CASE WHEN turn > 0 THEN turn END AS variant, CAST(length(text) % 3 AS DOUBLE) AS score FROM conversations)
    SELECT v.conv_id, count(*) AS variants, bool_and(v.score = o.score) AS consistent, round(avg(v.score - o.score), 6) AS delta FROM s v JOIN s o ON v.conv_id = o.conv_id AND o.variant IS NULL WHERE v.variant IS NOT NULL GROUP BY v.conv_id"""
)
def paraphrase_consistency(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", F.when(c("turn") > 0, c("turn")).alias("variant"), (F.length("text") % 3).cast("double").alias("score"))
    return evaluation.consistency(s, "conv_id", "variant", "score").withColumn("delta", F.round("delta", 6))


@P.add(
    """SELECT a.vec_id // 50 AS version, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id // 50 = b.vec_id // 50 AND a.vec_id < b.vec_id
    WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) BETWEEN 0.3 AND 0.99"""
)
def similar_chunk_pairs(spark, sf_dir):
    # fifty vectors stand for the chunks of one law version
    e = table(spark, sf_dir, "embeddings").withColumn("version", F.expr("vec_id div 50"))
    return joins.similar_pairs(e, ["version"], "vec_id", "embedding", 0.3, 0.99).withColumn("similarity", F.round("similarity", 6))


@P.add()
def marginal_relevance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vector"))
    pool = _dense(spark, sf_dir).join(e, "id")
    return ranking.maximal_marginal_relevance(pool, "query_id", "id", "vector", "score", 8, 0.7)


@P.add()
def hashed_vectors(spark, sf_dir):
    return ranking.hashing_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
