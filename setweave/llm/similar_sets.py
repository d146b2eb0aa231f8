"""All similar pairs between set-valued records: multi-index binary sketches.

Each set gets a code of 256 one-bit minhashes. Codes meet where one of their segments agrees, those within a Hamming
radius calibrated for recall are candidates (segments.py), and the original sets decide. Equal sets are one class
throughout, so copies never meet each other. `exact_candidates` finds the candidates without codes, by the
prefixes that two similar sets must share, for whoever wants recall 1 at the price of hot members.

Classes are named by a 64-bit digest of the set. Sets come whole, or as chunks (key, n, part, elems): `n` is the
set's size, `elems` the members whose hash falls to `part` of parts(n) parts. A hub's set is thus never in one row.
Nulls: a null set has no members; sets below `min_size` are in no pair. Ties at the threshold are pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from setweave.llm import sketch, words
from setweave.llm.segments import WORDS, code_pairs
from setweave.operators.skew import sift, skew_join
from setweave.session import discard, materialize

PART_SIZE = 8192
#: Members of a class of equal sets whose pairs one task lists.
BLOCK = 1024
CODE = [f"w{i}" for i in range(sketch.CODE_WORDS)]


def parts(n: Column) -> Column:
    """Parts of a set of n members: a power of two, 1 up to PART_SIZE, so that the parts of two sets nest."""
    return F.when(n <= PART_SIZE, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2), F.ceil(F.log2(n / PART_SIZE))).cast("long"))


def part_of(member_hash: Column, n: Column) -> Column:
    return F.pmod(member_hash, parts(n))


def _code_columns(mins: np.ndarray) -> list[pa.Array]:
    w = sketch.pack(sketch.bits(mins))
    return [pa.array(np.ascontiguousarray(w[:, i])) for i in range(w.shape[1])]


def _text_codes(batches):
    for b in batches:
        values, off = words.distinct(*words.hashed(b.column("text").to_pylist()))
        cols = [b.column("id"), b.column("at"), pa.array(words.digest(values, off)), pa.array(np.diff(off))]
        yield pa.RecordBatch.from_arrays([*cols, *_code_columns(sketch.minima(values, off, sketch.CODE_BITS))], names=["id", "at", "key", "n", *CODE])


def _text_sets(batches):
    for b in batches:
        values, off = words.distinct(*words.hashed(b.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(words.digest(values, off)), words.lists(values, off)], names=["key", "elems"])


def newest_coded(coded: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Delivered rows (id, at, key, n, codes..) -> (members (id, key, n), classes (key, n, copies, rep, side, codes..)).

    Of an id delivered in several versions the newest counts, a too small one included: that id is then in no class.
    """
    payload = [c for c in coded.columns if c not in ("id", "at")]
    newest = coded.groupBy("id").agg(F.max(F.struct("at", *payload)).alias("r")).select("id", *(f"r.{c}" for c in payload)).where(F.col("n") >= min_size)
    newest = materialize(newest, "newest")
    rest = [F.first(c).alias(c) for c in payload if c not in ("key", "n")]
    classes = newest.groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("id").alias("rep"), F.lit(3).alias("side"), *rest)
    return newest.select("id", "key", "n"), materialize(classes, "classes")


def of_wanted(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Delivered rows (id, ..) of the classes' representatives that occur in pairs (a, b), found by id before any text is read."""
    wanted = classes.join(ends(pairs).distinct().hint("merge"), "key", "left_semi").select(F.xxhash64("rep").alias("_h"))
    return sift(texts.withColumn("_h", F.xxhash64("id")), "_h", wanted).drop("_h")


def similar_texts(corpus: DataFrame, threshold: float, min_size: int) -> tuple[DataFrame, DataFrame]:
    """corpus (id, at, text) -> (class pairs (a, b, na, nb, shared), members (id, key, n)) of the texts' token sets."""
    coded = materialize(corpus.select("id", "at", "text").mapInArrow(_text_codes, f"id string, at timestamp, key long, n long, {WORDS}"), "coded")
    members, classes = newest_coded(coded, min_size)
    discard(coded)
    near = code_pairs(classes, threshold, classes.count())
    sets = of_wanted(corpus, classes, near).select("text").mapInArrow(_text_sets, "key long, elems array<long>")
    return similar_whole(near, sets, threshold), members


def _set_codes(batches):
    for b in batches:
        values, off = sketch.flat(b.column("elems"))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), *_code_columns(sketch.minima(values, off, sketch.CODE_BITS))], names=["key", "n", *CODE])


def _minima(batches):
    for b in batches:
        m = sketch.minima(*sketch.flat(b.column("elems")), sketch.CODE_BITS)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array([r.tobytes() for r in m], pa.binary())], names=["key", "n", "m"])


def _least(pdf):
    m = np.minimum.reduce([np.frombuffer(x, np.uint32) for x in pdf.m])
    w = sketch.pack(sketch.bits(m[None, :]))[0]
    return pdf.iloc[:1][["key", "n"]].assign(**{f"w{i}": w[i] for i in range(len(w))})


def codes(rows: DataFrame) -> DataFrame:
    """Whole sets (key, n, elems) -> (key, n, w0..)."""
    return rows.select("key", "n", "elems").mapInArrow(_set_codes, f"key long, n long, {WORDS}")


def chunk_codes(chunks: DataFrame) -> DataFrame:
    """Codes of sets in several parts: minima per part, then their minimum (1 KB a part)."""
    single = codes(chunks.where(F.col("n") <= PART_SIZE)).dropDuplicates(["key"])
    many = chunks.where(F.col("n") > PART_SIZE).select("key", "n", "elems").mapInArrow(_minima, "key long, n long, m binary")
    return single.unionByName(many.groupBy("key").applyInPandas(_least, f"key long, n long, {WORDS}"))


def ends(pairs: DataFrame) -> DataFrame:
    """The classes in pairs (a, b), as `key`."""
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def similar_whole(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, ..) with shared / union >= threshold and their `shared`; sets: rows (key, elems), repeats allowed."""
    one = sets.groupBy("key").agg(F.first("elems").alias("elems"))
    a, b = one.select(F.col("key").alias("a"), F.col("elems").alias("ea")), one.select(F.col("key").alias("b"), F.col("elems").alias("eb"))
    j = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").withColumn("shared", F.size(F.array_intersect("ea", "eb")).cast("long"))
    return j.where(F.col("shared") / (F.size("ea") + F.size("eb") - F.col("shared")) >= threshold).select(*pairs.columns, "shared")


def similar_parts(pairs: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """The same for sets in parts: pairs (a, b, na, nb), na <= nb; chunks: rows (key, part, elems)."""
    one = sift(chunks, "key", ends(pairs)).groupBy("key", "part").agg(F.first("elems").alias("elems"))
    b = one.select(F.col("key").alias("b"), F.col("part").alias("part"), F.col("elems").alias("eb"))
    a = one.select(F.col("key").alias("a"), F.col("part").alias("pa"), F.col("elems").alias("ea"))
    j = pairs.join(b.hint("merge"), "b").withColumn("pa", F.pmod("part", parts(F.col("na")))).join(a.hint("merge"), ["a", "pa"])
    s = j.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("ea", "eb"))).cast("long").alias("shared"))
    return s.where(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) >= threshold)


def exact_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """sets (key, n, elems), each key once -> pairs (a, b, na, nb) that share a member of both prefixes: recall 1.

    A set's prefix are its n - ceil(threshold n) + 1 rarest members; two sets over the threshold share one of them.
    """
    e = sets.select("key", "n", F.explode("elems").alias("e"))
    df = e.groupBy("e").agg(F.count("*").alias("df"))
    ranked = e.join(df.hint("merge"), "e").withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("df", "e")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("e", "key", "n")
    a, b = prefix.toDF("e", "a", "na"), prefix.toDF("e", "b", "nb")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = a.hint("merge").join(b, "e").where(ordered & (F.col("na") >= F.col("nb") * threshold - 1e-9))
    return met.select("a", "b", "na", "nb").distinct()


def node_pairs(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs (u, v): both non-null, u <> v."""
    return edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()


def node_sets(edges: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(members (id, key, n), chunks (key, n, part, elems)) of neighbour sets of at least min_size."""
    pairs = node_pairs(edges)
    h = F.xxhash64("v")
    per = pairs.groupBy("u").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"))
    per = materialize(per.where(F.col("n") >= min_size).select("u", "n", F.xxhash64("n", "x", "y").alias("key")), "nodes")
    rows = skew_join(pairs, per, "u", per).withColumn("h", F.xxhash64("v"))
    chunks = rows.groupBy("u", "key", "n", part_of(F.col("h"), F.col("n")).alias("part")).agg(F.collect_list("h").alias("elems"))
    return per.select(F.col("u").cast("string").alias("id"), "key", "n"), chunks.select("key", "n", "part", "elems")


def similar_nodes(edges: DataFrame, threshold: float, min_size: int) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) -> (class pairs, members) of the neighbour sets."""
    members, chunks = node_sets(edges, min_size)
    chunks = materialize(chunks, "chunks")
    classes = materialize(chunk_codes(chunks).withColumn("side", F.lit(3)), "classes")
    return similar_parts(code_pairs(classes, threshold, classes.count()), chunks, threshold), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Class pairs -> record pairs (id_a < id_b), pairs within a class included.

    A class of many members is cut into blocks of about BLOCK; every two blocks are a key of their own.
    """
    m = members.select("key", "id")
    a, b = m.toDF("a", "x"), m.toDF("b", "y")
    across = pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("x", "y")
    copies = m.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    twice = m.join(copies.hint("merge"), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    twice = twice.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id")
    left, right = twice.toDF("key", "i", "j", "o", "x"), twice.toDF("key", "i", "j", "p", "y")
    inside = left.hint("merge").join(right, ["key", "i", "j"]).where("x < y and (i = j or o <> p)").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row a record: (id, class_id, links); class_id is the smallest id of its equal sets, links its partners."""
    size = members.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("other")))
    across = both.join(size.select(F.col("key").alias("other"), "copies").hint("merge"), "other").groupBy("key").agg(F.sum("copies").alias("across"))
    per = size.join(across.hint("merge"), "key", "left").select("key", "class_id", (F.coalesce("across", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"))
    counts = size.select("key", F.col("copies").alias("n"))
    return skew_join(members.select("id", "key"), per, "key", counts).select("id", "class_id", "links")
