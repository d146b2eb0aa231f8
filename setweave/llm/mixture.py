"""Mixing sources to target weights along a time-varying curriculum.

Each source has a demand in tokens, its target share of the whole, at most max_repeats times its size. Its weight
schedule, a piecewise linear curve over the training time 0..1, is integrated and scaled to the demand; a
document's position is the time at which that integral reaches the document's place in the source's own token
order. Sorting by position (a range sort) interleaves the sources.

A source's order is that of a seeded hash; running token sums are taken per range of the hash, so no task holds a
source. Repeats follow one another as passes over the whole source.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators.skew import running_sum
from setweave.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Relative weights over the training time; a source not named keeps weight 1 throughout.
SCHEDULE = {"crawl": [(0.0, 1.5), (1.0, 0.5)], "papers": [(0.0, 0.5), (1.0, 1.5)], "manuals": [(0.0, 0.2), (0.5, 1.0), (1.0, 2.0)]}
_encoders: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file that came with the job, loaded once a process."""
    if vocabulary not in _encoders:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with a text column -> the other columns and n_tokens (0 for null texts).

    The vocabulary file is read where the driver runs, and goes to the executors with the job.
    """
    rest = [c for c in documents.columns if c != "text"]
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches):
        enc = encoder(name)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], names=[*rest, "n_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes if c != "text")
    return documents.select(*rest, "text").mapInArrow(run, f"{schema}, n_tokens long")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets: (source, target_share, max_repeats, size, total, demand, capped).

    total counts the tokens of all documents, those of other or null sources too. A source without documents has
    size 0; a null share counts as 0 and a null cap as 1; repeated rows of targets count once.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    size = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    total = size.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    p = t.join(size, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).join(F.broadcast(total))
    want, can = F.col("target_share") * F.col("total"), F.col("max_repeats") * F.col("size")
    return p.withColumn("demand", F.least(want, can.cast("double"))).withColumn("capped", want > can)


def _segments(schedule: Mapping[str, Sequence[tuple[float, float]]]) -> list[tuple]:
    """Pieces (source, t0, h, w0, slope, c0, c1, whole) of the integrated, normalised weight curves."""
    out = []
    for source, given in schedule.items():
        knots = [(float(t), float(w)) for t, w in given]
        if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
            raise ValueError(f"schedule of {source}: weights of 0 or more at increasing times from 0 to 1")
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, c = sum(areas), 0.0
        if whole <= 0:
            raise ValueError(f"schedule of {source}: all weights are 0")
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            if area > 0:
                out.append((source, t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), c / whole, (c + area) / whole, whole))
            c += area
    return out


def mix(sized: DataFrame, targets: DataFrame, schedule: Mapping[str, Sequence[tuple[float, float]]] = SCHEDULE, seed: int = 1, per_range: int = 50_000, id_col: str = "doc_id") -> DataFrame:
    """sized (id, source, n_tokens) -> (position, id, source, pass, n_tokens), one row per use of a document.

    A use belongs to the mix if its middle lies within the source's demand, so shares differ from their targets
    by at most a document. Documents without tokens or with a source not in targets are in no mix.
    """
    spark = sized.sparkSession
    p = plan(sized, targets).where("demand > 0")
    docs = sized.where("n_tokens > 0 and source is not null").withColumn("h", F.xxhash64(id_col, F.lit(seed)))
    ranges = max(1, math.ceil(docs.count() / per_range))
    placed = running_sum(docs, ["source"], "h", "n_tokens", "before", ranges)
    # The plan has a row per source of targets, a table that people write.
    uses = placed.join(F.broadcast(p.select("source", "size", "demand")), "source")
    uses = uses.withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(F.col("demand") / F.col("size")).cast("int") - 1)))
    middle = F.col("pass") * F.col("size") + F.col("before") + F.col("n_tokens") / 2
    uses = uses.withColumn("c", middle / F.col("demand")).where("c < 1")
    cols = "source string, t0 double, h double, w0 double, slope double, c0 double, c1 double, whole double"
    segments = spark.createDataFrame(_segments(schedule), cols).withColumnsRenamed({"source": "_source", "h": "_length"})
    s = uses.join(F.broadcast(segments), (F.col("source") == F.col("_source")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1")), "left")
    need = (F.col("c") - F.col("c0")) * F.col("whole")
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * F.col("slope") * need))
    # need = w0 x + slope x^2 / 2, solved in the form that also holds for slope 0
    x = F.col("t0") + F.least(F.col("_length"), 2 * need / (F.col("w0") + root))
    return s.select(F.coalesce(x, F.col("c")).alias("position"), id_col, "source", "pass", "n_tokens")


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: (source, target_share, actual_share of the mix, tokens, uses, repeats used, capped).

    A source is capped if the mix uses all it has as often as it may, and that is less than its share of all tokens.
    """
    p = materialize(plan(sized, targets).drop("capped"), "plan")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("pass") + 1).alias("repeats"))
    zero = {"tokens": 0, "uses": 0, "repeats": 0}
    j = p.join(F.broadcast(got), "source", "left").fillna(zero)
    whole = j.agg(F.sum("tokens").alias("whole"))
    capped = (F.col("tokens") >= F.col("max_repeats") * F.col("size")) & (F.col("tokens") < F.col("target_share") * F.col("total"))
    return j.join(F.broadcast(whole)).select("source", "target_share", (F.col("tokens") / F.col("whole")).alias("actual_share"), "tokens", "uses", "repeats", capped.alias("capped"))
