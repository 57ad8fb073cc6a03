"""Keyword search on a stored index: word groups, impact-ordered blocks of postings, early termination, appended segments.

A word of a text counts with its forms (without the prefixes that its language glues to words); a word of a query counts
once for a document, by the form that scores best.

A segment holds, for each term, its postings in blocks of ``BLOCK``, largest impact first; frequent terms are dealt over several shards, so that
no task sorts all of one.  A block says its largest count and its shortest document, which bound its weights whatever the
average length becomes as segments are added.  A search reads the first block of each list, takes the k-th best score
found as a threshold, and then reads only the blocks whose bound, with the best that the query's other words can give,
reaches it for one of the queries; each block is read once for all of them, and its postings are dealt by documents, so that a task adds up whole scores.  A document with a posting in a block left out is below the threshold, so the result is that of a full scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.legal import join_spaced_numbers
from ..sources.store import _path
from .ranking import B, K1

c = F.col
BLOCK = 128
SHARD = 65_536  # postings of a term that one task sorts
POSTINGS = "term string, df long, shard long, block int, most long, shortest int, n long, postings array<struct<id:long, tf:long, length:int>>, bucket int"
COUNTS = "term string, postings array<struct<id:long, tf:long, length:int>>"
TOKENS = 2_000_000  # words that are counted at a time
DEALT = "part int, codes array<int>, ids array<long>, tfs array<int>, lengths array<int>"
NO_ID = -(2**63)  # stands for a null id
PACK = 4096  # queries that are searched for at a time
PART = 4_000_000  # words of the documents that one task scores
SLOTS = 8  # tasks that may write one bucket

# Words that don't count, marks that are left out of words, and what is a word.
STOP_WORDS = (
    "של", "על", "את", "או", "לא", "אם", "כי", "זה", "זו", "הוא", "היא", "לפי", "בו", "בה", "מה", "מי", "כל", "גם",
    "אשר", "עם", "יש", "אין", "אל", "כך", "הם", "הן", "אחר", "אחרי", "לרבות", "חוק", "סעיף", "סעיפים", "קטן",
)
POINTS, QUOTES, MAQAF = r"[֑-ׇ]", "\"'׳״‘’“”", "־"
# a number with letters after it, a number with points or commas inside, or letters
COMPOUND, NUMBER, LETTERS = r"\d+[א-ת]{1,3}\d*", r"\d+(?:[.,]\d+)*", r"\p{L}+"


def words(text: Column) -> Column:
    """Words and numbers in order, lower-case, without points and quotation marks; a maqaf divides words."""
    plain = F.regexp_replace(join_spaced_numbers(text), POINTS, "")
    plain = F.lower(F.replace(F.translate(plain, QUOTES, ""), F.lit(MAQAF), F.lit(" ")))
    return F.regexp_extract_all(plain, F.lit(f"{COMPOUND}|{NUMBER}|{LETTERS}"), F.lit(0))


def word_groups(text: Column, prefixes=tuple(T.PREFIXES), stop=STOP_WORDS) -> Column:
    """One array for each word that counts: the word and its forms without a prefix, of three letters or more."""

    def forms(w: Column) -> Column:
        cut = [F.when(w.startswith(p) & (F.length(w) - len(p) >= 3) & ~w.rlike(r"^\d"), F.substr(w, F.lit(len(p) + 1))) for p in prefixes]
        several = F.array_distinct(F.filter(F.array(w, *cut), lambda f: f.isNotNull() & ~f.isin(*stop)))
        # most words have no prefix, and are their only form
        return F.when(reduce(lambda a, b: a | b, map(w.startswith, prefixes)), several).otherwise(F.array(w)) if prefixes else F.array(w)

    return F.transform(F.filter(words(text), lambda w: ~w.isin(*stop)), forms)


def index_terms(text: Column, **options) -> Column:
    return F.flatten(word_groups(text, **options))


def query_groups(text: Column, **options) -> Column:
    """The different words of a query, each as its sorted forms."""
    return F.array_distinct(F.transform(word_groups(text, **options), lambda g: F.sort_array(g)))


def one_form_groups(text: Column) -> Column:
    """Groups for plain words that have no other forms."""
    return F.transform(F.array_distinct(T.index_terms(text)), lambda w: F.array(w))


def _weight(tf: Column, length: Column, idf: Column, average: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average or 1.0)))


def _count_terms():
    """(id, length, terms) -> postings by term of some documents at a time; those of the term null are the documents with their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                many = max(1, int(np.searchsorted(ends, before + TOKENS, "right")) - start)
                part, start = batch.slice(start, many), start + many
                words = part.column(2).flatten().dictionary_encode()
                row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy())
                cell, tf = np.unique(words.indices.to_numpy().astype(np.int64) * part.num_rows + row, return_counts=True)
                code, row = np.divmod(cell, part.num_rows)
                row, tf = np.concatenate([np.arange(part.num_rows), row]), np.concatenate([np.zeros(part.num_rows, np.int64), tf])
                offsets = np.concatenate([[0], part.num_rows + np.searchsorted(code, np.arange(len(words.dictionary) + 1))]).astype(np.int32)
                each = pa.StructArray.from_arrays([part.column(0).take(pa.array(row)), pa.array(tf), part.column(1).take(pa.array(row))], ["id", "tf", "length"])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.cast(pa.string())]), pa.ListArray.from_arrays(pa.array(offsets), each)], ["term", "postings"])

    return run


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The sorted rows with all of a term and shard together: the last ones of a batch wait for the next."""
    held: list[pa.RecordBatch] = []
    for batch in filter(lambda b: b.num_rows, batches):
        term, shard = batch.column(0), batch.column(2)
        last = batch.num_rows - pc.sum(pc.and_(pc.equal(term, term[-1]), pc.equal(shard, shard[-1]))).as_py()
        if last:
            yield [*held, batch.slice(0, last)]
            held = []
        held.append(batch.slice(last))
    if held:
        yield held


def _cut(average: float, block: int):
    """(term, df, shard, bucket, postings), sorted by bucket, term and shard -> blocks of the lists, largest impact first; ``df`` is null where it is the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_lists(batches):
            term, df, shard, bucket, lists = (pa.concat_arrays([b.column(i) for b in whole]) for i in range(5))
            code, part = term.dictionary_encode().indices.to_numpy(), shard.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
            sizes = lists.value_lengths().to_numpy()
            many = np.add.reduceat(sizes, first).astype(np.int64)
            of = np.repeat(np.arange(len(first)), many)
            ids, tf, length = lists.flatten().flatten()
            counts, lengths = tf.to_numpy(), length.to_numpy()
            impact = counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths / average))
            order = np.lexsort((pc.fill_null(ids, NO_ID).to_numpy(), -impact, of))
            place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            starts = np.flatnonzero(place % block == 0)
            if not len(starts):
                continue
            at, where = pa.array(order), pa.array(first[of[starts]])
            df = pc.coalesce(df.take(where), pa.array(many[of[starts]]))
            postings = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)).astype(np.int32)), pa.StructArray.from_arrays([x.take(at) for x in (ids, tf, length)], ["id", "tf", "length"]))
            most, shortest = np.maximum.reduceat(counts[order], starts), np.minimum.reduceat(lengths[order], starts)
            columns = [term.take(where), df, shard.take(where), pa.array((place[starts] // block).astype(np.int32)), pa.array(most), pa.array(shortest)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(np.append(starts, len(of)))), postings, bucket.take(where)], ["term", "df", "shard", "block", "most", "shortest", "n", "postings", "bucket"])

    return run


def _deal(vocabulary: pa.Array, parts: int):
    """(term, postings) -> the postings by parts of the documents: terms as their numbers, a row for each part of some lists at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ids, *numbers = lists.flatten().flatten()
            ids, numbers = pc.fill_null(ids, NO_ID).to_numpy(), [x.to_numpy(zero_copy_only=False) for x in numbers]
            code = np.repeat(pc.index_in(batch.column(0), value_set=vocabulary).to_numpy(), lists.value_lengths().to_numpy())
            part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
            order, many = np.argsort(part, kind="stable"), np.bincount(part.astype(np.int64), minlength=parts)
            some = np.flatnonzero(many)
            offsets = pa.array(np.concatenate([[0], np.cumsum(many[some])]).astype(np.int32))
            columns = [code.astype(np.int32), ids, *(x.astype(np.int32) for x in numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in columns)], ["part", "codes", "ids", "tfs", "lengths"])

    return run


def _best_of_part(names: pa.Array, of: np.ndarray, forms: list[np.ndarray], idf: np.ndarray, average: float, k: int):
    """(query_id, id, score): the best ``k`` of the task's documents for each query, by all postings of these.

    ``of`` is the query of each word, in order, ``forms`` its terms.  Of equal scores the ``k`` smallest ids are enough; scores too near the
    last one for their rounding to be told are all kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[batch.column(i).flatten().to_numpy() for i in range(1, 5)] for batch in batches if batch.num_rows]
        if not found:
            return
        code, ids, tf, length = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.argsort(code, kind="stable")
        code, tf, length = code[order], tf[order], length[order]
        docs, row = np.unique(ids[order], return_inverse=True)
        weight = idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
        starts = np.searchsorted(code, np.arange(len(idf) + 1))
        of_term = [slice(a, b) for a, b in zip(starts, starts[1:])]
        merged: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def best_form(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if len(terms) == 1:
                return row[of_term[terms[0]]], weight[of_term[terms[0]]]
            if (known := merged.get(terms.tobytes())) is None:
                rows, weights = (np.concatenate([x[of_term[t]] for t in terms]) for x in (row, weight))
                by = np.lexsort((-weights, rows))
                first = np.concatenate([[True], rows[by][1:] != rows[by][:-1]]) if len(by) else np.zeros(0, bool)
                known = merged[terms.tobytes()] = rows[by][first], weights[by][first]
            return known

        ends = np.searchsorted(of, np.arange(len(names) + 1))
        for query in range(len(names)):
            words = [best_form(forms[g]) for g in range(ends[query], ends[query + 1])]
            score = np.bincount(np.concatenate([r for r, _ in words]), np.concatenate([w for _, w in words]), len(docs))
            hit = np.flatnonzero(score)
            if not len(hit):
                continue
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k] - 2e-9]
                hit = hit[np.argsort(-score[hit], kind="stable")]
                change = np.concatenate([[True], score[hit][1:] != score[hit][:-1]])
                place = np.arange(len(hit))
                hit = hit[place - np.maximum.accumulate(np.where(change, place, 0)) < k]
            at = pa.array(docs[hit], mask=docs[hit] == NO_ID)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(hit), query))), at, pa.array(score[hit])], ["query_id", "id", "score"])

    return run


class KeywordIndex:
    """An index below ``root``.  ``terms`` gives the index terms of a text column, ``groups`` the word groups of a query's."""

    def __init__(self, spark: SparkSession, root: str, terms=index_terms, groups=query_groups, buckets: int = 16):
        self.spark, self.root, self.terms, self.groups, self.buckets = spark, root.rstrip("/"), terms, groups, buckets

    def segments(self) -> list[dict]:
        """What is known of each complete segment: its number of documents and the sum of their lengths."""
        fs, p = _path(self.spark, f"{self.root}/segments")
        names = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = sorted(n for n in names if fs.exists(_path(self.spark, f"{n}/about/_SUCCESS")[1]))
        return [json.loads(self.spark.read.text(f"{n}/about").first()[0]) | {"path": n} for n in done]

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> dict:
        """Append the documents as a segment: ids that the index holds already are left out, so adding again adds nothing."""
        known = self.segments()
        rows = docs.select(c(id_col).cast("long").alias("id"), c(text_col).alias("text"))
        if known:
            old = self.spark.read.parquet(*[f"{s['path']}/documents" for s in known]).select("id")
            rows = rows.join(old, "id", "left_anti")
        path = f"{self.root}/segments/s{len(known):06d}"
        sized = rows.select("id", self.terms(c("text")).alias("terms")).select("id", F.size("terms").alias("length"), "terms")
        repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(c("id").alias("__id"))
        if not repeated.isEmpty():  # rows of one id are one document
            again = c("id").eqNullSafe(c("__id"))
            merged = sized.join(repeated, again, "left_semi").groupBy("id").agg(F.first("length").alias("length"), F.flatten(F.collect_list("terms")).alias("terms"))
            sized = sized.join(repeated, again, "left_anti").unionByName(merged)
        # texts are read and cut into words once, and counted where they stand
        sized.mapInArrow(_count_terms(), COUNTS).write.mode("overwrite").parquet(f"{path}/counts")
        counted = self.spark.read.schema(COUNTS).parquet(f"{path}/counts")
        counted.where("term IS NULL").select(F.explode("postings").alias("p")).select("p.id", "p.length").write.mode("overwrite").parquet(f"{path}/documents")
        about = self.spark.read.parquet(f"{path}/documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        average = about.total / about.n if about.n else 0.0
        lists = counted.where("term IS NOT NULL")
        # only the few terms that are dealt over shards need their count before their postings meet
        hot = lists.groupBy("term").agg(F.sum(F.size("postings")).alias("__df")).where(c("__df") > SHARD)
        lists = lists.join(F.broadcast(hot), "term", "left").withColumn("shards", F.coalesce(F.ceil(c("__df") / SHARD), F.lit(1)))
        lists = lists.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), c("shards") - 1)))
        mine = F.filter("postings", lambda p: F.pmod(F.xxhash64(p["id"]), c("shards")) == c("shard"))
        lists = lists.withColumn("postings", F.when(c("shards") > 1, mine).otherwise(c("postings")))
        lists = lists.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).withColumn("slot", F.pmod(F.xxhash64("term", F.lit(SLOTS)), F.lit(SLOTS)))
        # one shuffle: the lists of a term and shard meet in the task that writes them
        whole = lists.repartition("bucket", "slot", "shard").sortWithinPartitions("bucket", "term", "shard").select("term", c("__df").alias("df"), "shard", "bucket", "postings")
        blocks = whole.mapInArrow(_cut(average or 1.0, BLOCK), POSTINGS)
        blocks.sortWithinPartitions("bucket", "term", "shard", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        what = {"n": about.n, "total": about.total}
        self.spark.createDataFrame([(json.dumps(what),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return what

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int, full: bool = False) -> DataFrame:
        """(query_id, rank, id, score): the best ``k`` documents of each query; ``full`` reads all blocks instead."""
        found, _ = self._search(queries, query_id, query_text, k, full)
        return found

    def _search(self, queries: DataFrame, query_id: str, query_text: str, k: int, full: bool = False) -> tuple[DataFrame, DataFrame]:
        """The hits, and the blocks that each query by itself would meet."""
        known = self.segments()
        n, total = sum(s["n"] for s in known), sum(s["total"] for s in known)
        average = total / n if n else 0.0
        asked = queries.select(c(query_id).alias("query_id"), F.posexplode(self.groups(c(query_text))).alias("word", "forms"))
        asked = asked.select("query_id", "word", F.explode("forms").alias("term"))
        blocks = None
        for number, s in enumerate(known):
            part = self.spark.read.schema(POSTINGS).parquet(f"{s['path']}/postings").withColumn("segment", F.lit(number))
            blocks = part if blocks is None else blocks.unionByName(part)
        if blocks is None:
            raise ValueError("the index has no segment")
        packs = max(1, -(-queries.count() // PACK))
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
        hits, met = [], []
        for number in range(packs):
            pack = asked if packs == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(packs)) == number)
            for out, df in zip((hits, met), self._search_pack(blocks, pack, n, average, parts, k, full)):
                out.append(df)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
        ranked = reduce(DataFrame.unionByName, hits).withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)
        return ranked.select("query_id", "rank", "id", "score"), reduce(DataFrame.unionByName, met)

    def _search_pack(self, blocks: DataFrame, asked: DataFrame, n: int, average: float, parts: int, k: int, full: bool) -> tuple[DataFrame, DataFrame]:
        kind = asked.schema["query_id"]
        words = asked.toArrow().combine_chunks()
        column = lambda name: pa.concat_arrays(words[name].chunks) if words[name].num_chunks else pa.array([], words.schema.field(name).type)
        names, vocabulary = pc.unique(column("query_id")), pc.unique(column("term"))
        query, term = (pc.index_in(column(x), value_set=of).to_numpy() for x, of in (("query_id", names), ("term", vocabulary)))
        # a group is a word of a query with its forms
        groups, group = np.unique(np.stack([query, column("word").to_numpy()]).astype(np.int64), axis=1, return_inverse=True)
        of, group = groups[0], group.reshape(-1)
        hashed = lambda t: t.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        table = lambda **x: self.spark.createDataFrame(pa.table({"term": vocabulary.cast(pa.string())} | x))
        mine = blocks.join(F.broadcast(hashed(table())), ["term", "bucket"])
        # df over all segments: from the first block of each shard, one a segment; and the largest weight of a list but for its idf
        factor = _weight(c("most"), c("shortest"), F.lit(1.0), average)
        heads = mine.groupBy("term", "segment").agg(F.max("df").alias("df"), F.max(factor).alias("factor")).groupBy("term").agg(F.sum("df").alias("df"), F.max("factor").alias("factor")).toArrow()
        df, most = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
        at = pc.index_in(heads["term"], value_set=vocabulary).to_numpy()
        df[at], most[at] = heads["df"].to_numpy(), heads["factor"].to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        forms = np.split(term[np.argsort(group, kind="stable")], np.cumsum(np.bincount(group, minlength=len(of)))[:-1]) if len(of) else []
        schema = StructType([kind, StructField("id", LongType(), True), StructField("score", DoubleType(), False)])

        def scores(some: DataFrame) -> DataFrame:
            dealt = some.select("term", "postings").mapInArrow(_deal(vocabulary, parts), DEALT).repartitionById(parts, c("part"))
            return dealt.mapInArrow(_best_of_part(names, of, [np.unique(f) for f in forms], idf, average or 1.0, k), schema)

        floor = np.full(len(of), -np.inf)
        if not full and len(of):
            nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
            first = scores(mine.where("block = 0")).withColumn("nth", nth).where(c("nth") == k).select("query_id", "score").toArrow()
            least = np.full(len(names), -np.inf)
            least[pc.index_in(first["query_id"], value_set=names).to_numpy()] = first["score"].to_numpy()
            best = np.zeros(len(of))
            np.maximum.at(best, group, idf[term] * most[term])
            every = np.bincount(of, best, len(names))
            floor = least[of] - 1e-9 * every[of] - (every[of] - best)
        lowest = np.full(len(vocabulary), np.inf)
        np.minimum.at(lowest, term, floor[group])
        bound = _weight(c("most"), c("shortest"), c("idf"), average)
        # a list is read once for all queries: what one of them needs can only complete the scores of another
        needed = mine.join(F.broadcast(table(idf=idf, floor=lowest)), "term").where(bound >= c("floor"))
        each = self.spark.createDataFrame(pa.table({"term": column("term").cast(pa.string()), "idf": idf[term], "floor": floor[group]}))
        return scores(needed), mine.join(F.broadcast(each), "term").where(bound >= c("floor")).select("term", "segment", "shard", "block", "n")

    def postings_read(self, queries: DataFrame, query_id: str, query_text: str, k: int, full: bool = False) -> int:
        """How many postings the queries meet, each by itself."""
        return self._search(queries, query_id, query_text, k, full)[1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
