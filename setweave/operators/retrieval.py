"""Inverted index and conjunctive keyword search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from setweave.functions.text import token_hashes, tokens
from setweave.operators.order import global_index
from setweave.operators.skew import sift
from setweave.session import materialize

#: Documents of a block, a multiple of 64, and queries of a step: a term's bitmap takes 1 KB, those of a step 4 MB.
BLOCK, STEP = 8192, 4096


def token_rows(docs: DataFrame) -> DataFrame:
    """docs (doc, text) -> (doc, term), repeats kept."""
    return docs.select("doc", F.explode(tokens(F.col("text"))).alias("term"))


def postings(docs: DataFrame) -> DataFrame:
    """Distinct (term, doc)."""
    return token_rows(docs).select("term", "doc").distinct()


def vocabulary(p: DataFrame) -> DataFrame:
    """(term, df, term_id), ids dense in code-point order."""
    return global_index(p.groupBy("term").agg(F.count("*").alias("df")), [F.asc("term")], "term_id")


def drop_most_frequent(vocab: DataFrame, k: int) -> DataFrame:
    """Without the k terms of highest document frequency, ties by term id."""
    gone = vocab.orderBy(F.desc("df"), "term_id").limit(k).select("term")
    return vocab.join(gone, "term", "left_anti")


def drop_common(vocab: DataFrame, docs: int, share: float = 0.7) -> DataFrame:
    """Without terms in more than `share` of the documents."""
    return vocab.where(F.col("df") / F.lit(docs) <= share)


def drop_low_idf(vocab: DataFrame, terms: int, ratio: float = 0.0001) -> DataFrame:
    """Without the int(terms * ratio) terms of lowest ln((N + 1) / (1 + df)), which is highest df first."""
    return drop_most_frequent(vocab, int(terms * ratio))


def drop_stop_words(vocab: DataFrame, words: list[str]) -> DataFrame:
    return vocab.where(~F.col("term").isin(words)) if words else vocab


def query_terms(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """queries (query, text) -> (query, term, df, term_id, pos): known distinct terms, rarest first."""
    t = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(vocab, "term")
    return t.withColumn("pos", (F.row_number().over(W.partitionBy("query").orderBy("df", "term_id")) - 1).cast("long")).select("query", "term", "df", "term_id", "pos")


def term_sets(docs: DataFrame) -> DataFrame:
    """docs (doc, text), one row a document -> (doc, terms): 64-bit hashes of its distinct terms."""
    return docs.select("doc", F.array_distinct(token_hashes(F.col("text"))).alias("terms"))


def known_sets(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """queries (query, text) -> (query, terms): hashes of the distinct terms that some document holds; none, no row."""
    asked = queries.select("query", F.explode(F.array_distinct(token_hashes(F.col("text")))).alias("term"))
    held = sets.select(F.explode("terms").alias("term")).distinct()
    return asked.join(held.hint("merge"), "term", "left_semi").groupBy("query").agg(F.collect_list("term").alias("terms"))


def _asked(files: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(queries, terms one after another, where each query's begin), a step at a time."""
    from setweave.sources.files import opened

    for name in files:
        with opened(name) as f:
            for b in pq.ParquetFile(f).iter_batches(STEP, columns=["query", "terms"]):
                if b.num_rows:
                    t = b.column(1)
                    begin = t.offsets.to_numpy()
                    yield b.column(0), t.values.to_numpy()[begin[0] : begin[-1]], (begin[:-1] - begin[0]).astype(np.int64)


def _bitmaps(terms: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct terms in order, a bitmap of documents for each)."""
    by = np.argsort(terms, kind="stable")
    terms, doc = terms[by], doc[by]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(terms)]))
    at = row * (BLOCK // 64) + (doc >> 6)
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    bits = np.zeros((len(first), BLOCK // 64), np.uint64)
    bits.reshape(-1)[at[begin]] = np.bitwise_or.reduceat(np.uint64(1) << (doc & 63).astype(np.uint64), begin)
    return terms[first], bits


def _matches(names: np.ndarray, bits: np.ndarray, asked: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of queries, their bitmaps of documents that hold all terms), by the number of terms; none without a document."""
    row = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    whole = np.logical_and.reduceat(names[row] == asked, begin)
    size = np.diff(np.r_[begin, len(asked)])
    for n in np.unique(size[whole]):
        q = np.flatnonzero(whole & (size == n))
        found = bits[row[begin[q]]]
        for k in range(1, n):
            found &= bits[row[begin[q] + k]]
            some = found.any(axis=1)
            if not some.all():
                q, found = q[some], found[some]
        if len(q):
            yield q, found


def _evaluated(asked: DataFrame, sets: DataFrame, listed: bool) -> DataFrame:
    """asked and sets (query or doc, terms): listed, (query, doc) of every match, else (query, hits), a row a task and query.

    A task takes its documents in blocks, makes a bitmap of each asked term over the block, and intersects those of
    each query. The queries are a table in the shared folder that every task reads step by step, so nothing but the
    result is sent.
    """
    files = sorted(asked.inputFiles())

    def run(batches):
        wanted = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(t) for _, t, _ in _asked(files))]))
        hits: list[np.ndarray] = []

        def block(held: list[pa.RecordBatch]):
            table = pa.Table.from_batches(held).combine_chunks()
            docs, sets = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            ends = sets.offsets.to_numpy()
            terms, doc = sets.values.to_numpy()[ends[0] : ends[-1]], np.repeat(np.arange(len(docs)), np.diff(ends))
            kept = wanted[np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)] == terms
            if not kept.any():
                return
            names, bits = _bitmaps(terms[kept], doc[kept])
            for step, (queries, its, begin) in enumerate(_asked(files)):
                if step == len(hits):
                    hits.append(np.zeros(len(queries), np.int64))
                for q, found in _matches(names, bits, its, begin):
                    if not listed:
                        hits[step][q] += np.bitwise_count(found).sum(axis=1, dtype=np.int64)
                        continue
                    at, word = np.nonzero(found)
                    for i in range(0, len(at), 1 << 14):
                        w, b = np.nonzero(np.unpackbits(found[at[i : i + (1 << 14)], word[i : i + (1 << 14)]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                        yield pa.RecordBatch.from_arrays([queries.take(pa.array(q[at[i + w]])), docs.take(pa.array(word[i + w] * 64 + b))], names=["query", "doc"])

        held, n = [], 0
        for b in batches if len(wanted) else ():
            while n + b.num_rows >= BLOCK:
                yield from block([*held, b.slice(0, BLOCK - n)])
                b, held, n = b.slice(BLOCK - n), [], 0
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if held:
            yield from block(held)
        for (queries, _, _), h in zip(_asked(files), hits, strict=False):
            if not listed and h.any():
                q = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), pa.array(h[q])], names=["query", "hits"])

    out = T.StructField("doc", sets.schema["doc"].dataType) if listed else T.StructField("hits", T.LongType())
    return sets.select("doc", "terms").mapInArrow(run, T.StructType([T.StructField("query", asked.schema["query"].dataType), out]))


def matches(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(query, doc) of documents holding every known term of a query; asked: a written table."""
    return _evaluated(asked, sets, True)


def match_counts(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(query, hits) of queries with a hit; asked: a written table."""
    return _evaluated(asked, sets, False).groupBy("query").agg(F.sum("hits").alias("hits"))


def match_counts_partitioned(asked: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(query, part, hits): every partition of the documents is evaluated by itself; hits add up over partitions."""
    out = None
    for k in range(parts):
        counts = match_counts(asked, sets.where(F.pmod(F.xxhash64("doc"), F.lit(parts)) == k)).select("query", F.lit(k).alias("part"), "hits")
        out = counts if out is None else out.unionByName(counts)
    return out


def judged_matches(asked: DataFrame, sets: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of judged (query, doc, ...) whose document holds every known term of the query."""
    near = sift(sets, "doc", judged.select("doc").where("doc is not null"))
    pairs = judged.join(asked.withColumnRenamed("terms", "_asked").hint("merge"), "query").join(near.hint("merge"), "doc")
    return pairs.where(F.size(F.array_except("_asked", "terms")) == 0).select(*judged.columns)


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.collect_set(F.xxhash64("term")).alias("terms"))


def conjunctive(terms: DataFrame, p: DataFrame) -> DataFrame:
    """(query, doc) of documents holding every known term of a query, from query terms and postings."""
    return matches(materialize(_hashed(terms, "query"), "asked"), _hashed(p, "doc"))


def conjunctive_partitioned(terms: DataFrame, p: DataFrame, parts: int) -> DataFrame:
    """(query, part, hits) from query terms and postings."""
    return match_counts_partitioned(materialize(_hashed(terms, "query"), "asked"), _hashed(p, "doc"), parts)


def hit_counts(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query, hits), 0 for queries without a known term or a hit."""
    return every_query(queries, found.groupBy("query").agg(F.count("*").alias("hits")))


def every_query(queries: DataFrame, c: DataFrame) -> DataFrame:
    """c (query, hits) and 0 for the queries it lacks."""
    return queries.select("query").distinct().join(c, "query", "left").select("query", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def hit_total(counts: DataFrame) -> DataFrame:
    """One row: queries and hits over all of them."""
    return counts.agg(F.count("*").alias("queries"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"))


def vocabulary_size(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct terms and postings (approximation-free)."""
    p = postings(docs)
    per = p.groupBy("term").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("postings"))
