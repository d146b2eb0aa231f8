"""Training-data operators: edge cases, brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.functions.text import tokens
from setweave.llm import distinctive, leaks, mixture, near_duplicates, overlap, queries, segments, similar_sets, sketch, spam_pages, words
from setweave.llm.term_counts import TermCounts, changes, newest, term_deltas

CORPUS = "_id string, text string, title string, dataset string, fetched_at timestamp, elems int, key string"
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder with nulls, blanks, copies, repeated rows, a very long text and columns with clashing names."""
    import datetime as dt

    d, rnd = str(tmp_path_factory.mktemp("data")), random.Random(3)
    t = [dt.datetime(2024, 7, 1 + i) for i in range(9)]
    base = [[rnd.choice(WORDS) for _ in range(30)] for _ in range(40)]
    docs = [(f"r{i:03}", " ".join(b), "a title", None, t[i % 9], 1, "k") for i, b in enumerate(base)]
    docs += [(f"s{i:03}", " ".join([*b[:27], "x", *b[28:]]), "a title", None, None, 1, "k") for i, b in enumerate(base[:10])]
    docs += [(f"c{i}", docs[0][1], "a title", "d", t[0], 1, "k") for i in range(3)]
    docs += [docs[5], ("n1", None, None, None, None, None, None), ("n2", "  ", "", None, t[1], 1, "k"), (None, "x y z", None, None, t[1], 1, "k"), ("big", "lorem ipsum " * 100_000, None, None, t[2], 1, "k"), ("old", base[3][0], None, None, t[0], 1, "k"), ("old", " ".join(base[39]), None, None, t[5], 1, "k")]
    spark.createDataFrame(docs, CORPUS).write.parquet(f"{d}/corpus.parquet")
    spark.createDataFrame([("q1", "w1 w2 zzz", None), ("q1", "w1 w2 zzz", None), ("q2", None, None), ("q3", " ", None), ("q4", "zzz", None), (None, "w1", None)], "_id string, text string, dataset string").write.parquet(f"{d}/queries.parquet")
    sets = {u: rnd.sample(range(3000), 30) for u in range(20)} | {50: list(range(9000)), 51: list(range(300, 9000))}
    sets |= {60 + i: sets[i][:27] + [7000 + i] for i in range(5)} | {70: sets[0]}
    e = [(u, v, "s", None, None) for u, vs in sets.items() for v in vs] + [(1, 1, None, None, None), (None, 3, "s", None, None), (4, None, "s", None, None)]
    spark.createDataFrame(e + e[:50], "u long, v long, shard string, seen_at timestamp, loaded_at timestamp").write.parquet(f"{d}/edge_pairs.parquet")
    return d, sets


def jaccard(a, b):
    return len(a & b) / len(a | b)


def newest_texts(spark, d):
    return {r.id: r.text for r in newest(spark.read.parquet(f"{d}/corpus.parquet"), "_id", "text", "fetched_at").collect()}


def test_p1_against_brute_force(spark, folder):
    d, sets = folder
    got = {tuple(r) for r in queries.p1_found(spark, d).collect()}
    texts = {k: set((v or "").split()) for k, v in newest_texts(spark, d).items()}
    want = {("corpus", a, b) for a, b in itertools.combinations(sorted(k for k, v in texts.items() if len(v) >= 8), 2) if jaccard(texts[a], texts[b]) >= 0.6}
    nodes = {str(u): set(v) - {u} for u, v in sets.items()}
    want |= {("node", a, b) for a, b in itertools.combinations(sorted(nodes), 2) if jaccard(nodes[a], nodes[b]) >= 0.6}
    assert got == want and ("node", "50", "51") in got and ("corpus", "c0", "r000") in got
    n = {r.id: r.links for r in queries.p1_links(spark, d).where("kind = 'node'").collect()}
    assert n["70"] == sum("70" in p for p in want)


def test_tokens_in_batches_are_those_of_the_plans(spark):
    texts = ["Ére le, x_y — don't", None, "", "    ", "a\tb\r\nc\x85d　e", "éx Straße ÅB ١٢ 顶点，x", "\u200bzero\u00a0width"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokens(F.col("text")).alias("t")).collect()
    assert all(list(r.t) == words.tokens(r.text) for r in rows)
    values, off = words.hashed(texts)
    assert off[-1] == len(values) and len(set(words.digest(values, off).tolist())) == 5  # null, blank and empty agree
    assert words.runs(values, off, 3)[1][-1] == sum(max(0, len(words.tokens(t)) - 2) for t in texts)


def whole_sets(spark, sets):
    df = spark.createDataFrame(list(sets.items()), "key long, elems array<long>").select("key", F.size("elems").cast("long").alias("n"), "elems")
    return df, similar_sets.codes(df)


def test_p1_between_two_tables(spark):
    _, coded = whole_sets(spark, {1: list(range(20)), 2: [*range(18), 99], 3: list(range(19))})
    sided = coded.withColumn("side", F.when(F.col("key") == 2, 2).otherwise(1))
    assert {frozenset((r.a, r.b)) for r in segments.code_pairs(sided, 0.6, 3, between=True).collect()} == {frozenset((1, 2)), frozenset((2, 3))}


def near_sets(n):
    rnd, out = random.Random(8), {}
    core = rnd.sample(range(10**6), 40)
    for i in range(n):
        base = core if i % 3 == 0 else rnd.sample(range(10**6), 40)
        out[i] = [*rnd.sample(base, 37), *(10**7 + 3 * i + j for j in range(3))]
    return out


def test_p1_hot_units_and_exact_way(spark):
    """A third of all sets are near copies; split units, ordinary units and the exact way give the same pairs."""
    sets = near_sets(150)
    df, coded = whole_sets(spark, sets)
    sided = coded.withColumn("side", F.lit(3))
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(set(sets[a]), set(sets[b])) >= 0.6}
    layout = segments.Layout(2, 3, 12, 6)
    of = lambda pairs: [(min(r.a, r.b), max(r.a, r.b)) for r in similar_sets.similar_whole(pairs, df, 0.6).collect()]
    split = segments.hot_cells(sided, layout, len(sets), 20)
    assert split and all(n >= 2 for v in split.values() for n in v.values())
    for hot in (20, 10**6):
        got = of(segments.code_pairs(sided, 0.6, len(sets), hot=hot, layout=layout))
        assert len(got) == len(set(got)) and set(got) == want
    assert set(of(similar_sets.exact_candidates(df, 0.6))) == want and len(want) > 1000
    assert segments.code_pairs(sided.limit(0), 0.6, 0).count() == 0


def test_p1_large_classes_are_listed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "BLOCK", 4)
    members = spark.createDataFrame([(7, f"m{i:02}") for i in range(23)] + [(8, "x")], "key long, id string")
    got = [tuple(r) for r in similar_sets.expand(spark.createDataFrame([(7, 8)], "a long, b long"), members).collect()]
    ids = [f"m{i:02}" for i in range(23)]
    assert len(got) == len(set(got)) and set(got) == set(itertools.combinations(ids, 2)) | {(i, "x") for i in ids}


@pytest.mark.parametrize("records", [1_000, 20_400, 204_000, 2_040_000, 20_400_000])
def test_p1_recall_at_the_threshold(records):
    r = np.random.default_rng(9)
    x = r.integers(0, 2, (3000, sketch.CODE_BITS), dtype=np.uint8)
    y = x ^ (r.random(x.shape) < 0.2)  # similarity 0.6
    layout = segments.layout_for(records, 0.6)
    wx, wy = (sketch.pack(c).view(np.uint64) for c in (x, y))
    met = np.zeros(len(x), bool)
    for first, inner in segments.divisions(layout):
        same = segments.cells(wx, first) == segments.cells(wy, first)
        met |= same & np.any([segments.cells(wx, s) == segments.cells(wy, s) for s in inner], axis=0)
    apart = (x != y)[:, :128].sum(1), (x != y).sum(1)
    kept = met & (apart[0] <= sketch.radius(128, 0.6, segments.KEEP)) & (apart[1] <= sketch.radius(256, 0.6, segments.KEEP))
    assert kept.mean() > 0.975


def test_p1_p5_no_data_sized_broadcast(spark, folder):
    """Only the bitmap of `sift` may be broadcast, whatever the planner thinks of the sizes."""
    d, _ = folder
    seen, real = [], similar_sets.materialize

    def looking(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    import setweave.llm.segments as seg

    for module in (similar_sets, seg, near_duplicates, queries):
        module.materialize = looking
    try:
        queries.p1_found(spark, d)
        queries.p5_found(spark, d)
    finally:
        for module in (similar_sets, seg, near_duplicates, queries):
            module.materialize = real
    for name, plan in seen:
        if name != "chunks":  # there skew_join broadcasts at most 100 heavy keys
            assert all("_word" in block for block in plan.split("BroadcastExchange")[1:]), (name, plan)
    assert {"near", "newest", "classes", "shared", "stars"} <= {name for name, _ in seen}


def test_p2_deltas(spark, folder):
    d, _ = folder
    counts = queries._term_counts(spark, d)
    texts = newest_texts(spark, d)
    got = {r.term: (r.occurrences, r.records) for r in counts.counts().collect()}
    want = {}
    for t in texts.values():
        for w in (t or "").split():
            o, r = want.get(w, (0, 0))
            want[w] = (o + 1, r)
        for w in set((t or "").split()):
            want[w] = (want[w][0], want[w][1] + 1)
    assert got == want and counts.total().first().n_records == len(texts)
    # delete, change and add again
    before = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("c", None)], "id string, text string")
    c = TermCounts(spark, buckets=4).merge(term_deltas(before.withColumn("sign", F.lit(1)), 4))
    after = spark.createDataFrame([("b", "y z"), ("d", "x"), ("c", None)], "id string, text string")
    c.merge(term_deltas(changes(before, after, spark.createDataFrame([("a",)], "id string")), 4))
    assert {tuple(r) for r in c.counts().collect()} == {("x", 1, 1), ("y", 1, 1), ("z", 1, 1)} and c.total().first().n_records == 3
    assert TermCounts(spark).counts().count() == 0
    # open the table again, in a later session as it were; untouched buckets stay where they are
    again = TermCounts(spark, c.path, buckets=9)
    assert (again.version, again.buckets, again.counts().count()) == (2, 4, 3)
    before_places = dict(again.places)
    again.merge(term_deltas(spark.createDataFrame([("e", "x", 1)], "id string, text string, sign int"), again.buckets))
    changed = {b for b, v in again.places.items() if before_places.get(b) != v}
    assert 0 < len(changed) <= 2 < len(again.places) + 1 and again.version == 3
    again.clean()
    last = TermCounts(spark, c.path)
    assert {tuple(r) for r in last.counts().collect()} == {("x", 2, 2), ("y", 1, 1), ("z", 1, 1)} and last.total().first().n_records == 4


def test_p4(spark, folder):
    d, _ = folder
    texts = {k: (v or "").split() for k, v in newest_texts(spark, d).items()}
    df = {}
    for t in texts.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    score = lambda t, w: round(t.count(w) * np.log((len(texts) + 1) / (1 + df[w])), 9)
    want = set()
    for origin, records in (("corpus", texts), ("queries", {"q1": "w1 w2 zzz".split(), "q4": ["zzz"]})):
        for k, t in records.items():
            s = {w: score(t, w) for w in set(t) if w in df}
            want |= {(origin, k, w) for w, v in s.items() if v == max(s.values())}
    assert {tuple(r) for r in queries.p4_found(spark, d).collect()} == want
    empty = spark.createDataFrame([], "origin string, record_id string, text string")
    assert distinctive.weigh(empty).count() == 0


def test_p5_against_brute_force(spark, folder):
    d, _ = folder
    runs = {}
    for r in spark.read.parquet(f"{d}/corpus.parquet").where("_id is not null").collect():
        t = f"{r.title or ''} {r.text or ''}".split()
        at = (r.fetched_at is not None, r.fetched_at)
        if r._id not in runs or at > runs[r._id][0]:
            runs[r._id] = (at, {tuple(t[i : i + 3]) for i in range(len(t) - 2)} if len(t) >= 8 else set())
    runs = {k: v for k, (_, v) in runs.items() if v}
    root = {k: k for k in runs}
    for a, b in itertools.combinations(sorted(runs), 2):
        if jaccard(runs[a], runs[b]) >= 0.5:
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    sizes = {}
    for v in root.values():
        sizes[v] = sizes.get(v, 0) + 1
    assert {tuple(r) for r in queries.p5_found(spark, d).collect()} == {(v, k) for k, v in root.items() if sizes[v] > 1}


def test_parity_code_covers():
    """Words that differ in one symbol share an anchor, those that differ in two don't (but by chance)."""
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 32, (500, 3), dtype=np.uint32)
    for k in range(3):
        y = x.copy()
        y[:, k] = r.integers(0, 1 << 32, 500, dtype=np.uint32)
        assert (near_duplicates.anchors_of(x) == near_duplicates.anchors_of(y)).sum() >= 500
        y[:, (k + 1) % 3] += np.uint32(1)
        assert not (near_duplicates.anchors_of(x)[:, :, None] == near_duplicates.anchors_of(y)[:, None, :]).any()


def found_share(pairs):
    """Share of the text pairs that meet at an anchor and lie within the radius."""
    tables = near_duplicates.tables_for(0.5)
    a, b = (next(near_duplicates._fingerprints(3, tables)([_batch(side)])) for side in zip(*pairs))
    at = [near_duplicates.anchors_of(np.frombuffer(b"".join(z.column("symbols").to_pylist()), np.uint32).reshape(len(pairs), -1)) for z in (a, b)]
    meet = (at[0] == at[1]).any(1)
    apart = sum(np.bitwise_count((a.column(w).to_numpy() ^ b.column(w).to_numpy()).view(np.uint64)).astype(int) for w in ("w0", "w1"))
    return (meet & (apart <= sketch.radius(128, 0.5, near_duplicates.KEEP))).mean()


def _batch(texts):
    import pyarrow as pa

    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array([None] * n, pa.timestamp("us")), pa.array(texts)], names=["id", "at", "text"])


def test_p5_recall_at_the_threshold():
    """Texts with an appended passage of equal length (similarity just above a half), and texts with scattered edits."""
    rnd = random.Random(4)
    new = lambda n: [f"t{rnd.randrange(10**9)}" for _ in range(n)]
    appended, edited = [], []
    for _ in range(1500):
        x = new(80)
        appended.append((" ".join(x), " ".join(x + new(77))))
        y = list(x)
        for i in rnd.sample(range(80), 7):
            y[i] = new(1)[0]
        edited.append((" ".join(x), " ".join(y)))
    assert found_share(appended) > 0.975 and found_share(edited) > 0.975


def test_p5_crowded_anchors_and_second_round(spark, monkeypatch):
    """A third of all records are near copies of one text; chains hang on members other than the least."""
    monkeypatch.setattr(near_duplicates, "CROWD", 4)
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = [(f"c{i:03}", " ".join([*base[:i % 50], f"x{i}", *base[i % 50 + 1 :]])) for i in range(60)]
    chain = [[f"k{j}" for j in range(60)]]
    for _ in range(5):
        chain.append(chain[-1][12:] + [f"n{rnd.randrange(10**9)}" for _ in range(12)])
    rows += [(f"k{i}", " ".join(t)) for i, t in enumerate(chain)] + [(f"o{i:03}", " ".join(f"w{rnd.randrange(10**9)}" for _ in range(40))) for i in range(100)]
    df = spark.createDataFrame([(i, None, t) for i, t in rows], "id string, at timestamp, text string")
    components, members = near_duplicates.near_groups(df, 0.5, 3, 8)
    root = {r.node: r.root for r in components.collect()}
    group = {}
    for r in members.collect():
        group.setdefault(root.get(r.key, r.key), set()).add(r.id)
    got = {frozenset(g) for g in group.values() if len(g) > 1}
    assert got == {frozenset(f"c{i:03}" for i in range(60)), frozenset(f"k{i}" for i in range(6))}


def test_p6(spark, folder):
    d, _ = folder
    assert {tuple(r) for r in queries.p6_found(spark, d).collect()} == {(50, 51)}
    sizes, rows = overlap.large_sets(spark.read.parquet(f"{d}/edge_pairs.parquet"), 100)
    e = overlap.estimates(sizes, rows).first()
    assert abs(e.intersection - 8698) < 900 and abs(e.union - 8999) < 900
    assert overlap.strong(sizes.limit(0), rows.limit(0), 0.2).count() == 0


def test_p6_estimates_lie_within_their_error(spark, monkeypatch):
    """Sets of 300 to 40 000 members, small in large ones too; members in very many sets go in blocks."""
    monkeypatch.setattr(overlap, "BLOCK", 3)
    rnd = random.Random(5)
    sets = {u: set(range(30)) | set(rnd.sample(range(60_000), rnd.choice([300, 3000, 20_000, 40_000]))) for u in range(1, 13)}
    sets[20] = set(rnd.sample(sorted(sets[1]), 200)) | set(range(10**6, 10**6 + 400))
    edges = spark.createDataFrame([(u, 10**8 + v) for u, vs in sets.items() for v in vs], "u long, v long")
    sizes, rows = overlap.large_sets(edges, 100)
    e = {(r.a, r.b): r for r in overlap.estimates(sizes, rows).collect()}
    for a, b in itertools.combinations(sets, 2):
        r, exact = e.get((a, b)) or e.get((b, a)), len(sets[a] & sets[b])
        if r is None:  # no shared member among the sketches: few shared ones in all
            assert exact < 600
            continue
        assert abs(r.intersection - exact) <= 5 * exact / max(r.shared, 1) ** 0.5 + 1e-6
        if min(len(sets[a]), len(sets[b])) < 4 * overlap.K:
            assert abs(r.intersection - exact) < 1e-6
    strong = {frozenset((r.a, r.b)) for r in overlap.strong(sizes, rows, 0.2).collect()}
    assert strong == {frozenset((a, b)) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.2 * min(len(sets[a]), len(sets[b]))}


def test_p7_against_brute_force(spark):
    rnd = random.Random(4)
    words = WORDS[:30]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([8, 10, 25])))) for i in range(20)] + [(98, None), (99, " ")]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(20)]
    docs += [(100 + i, f"{t} start {items[i][1].upper()}! end") for i, (_, t) in enumerate(docs[:15])] + [(200, None), (201, ""), (202, (items[2][1] or "") + " w " * 50_000)]
    docs += docs[-5:]
    grams = lambda t: {tuple(x[i : i + 10]) for x in [(t or "").lower().replace("!", "").split()] for i in range(len(x) - 9)}
    want = {(a, b, len(grams(t) & grams(u))) for a, t in docs for b, u in items if grams(t) & grams(u)}
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")  # noqa: E741
    assert {tuple(r) for r in leaks.leaks(D, I).collect()} == want and want
    assert leaks.leaks(D, I.limit(0)).count() == 0 and leaks.leaks(D.limit(0), I).count() == 0


def test_p8(spark):
    sized = spark.createDataFrame([(i, "crawl" if i % 3 else "wiki", 10 + i % 7) for i in range(600)] + [(900, None, 50), (901, "other", 70), (902, "wiki", 0)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("crawl", 0.3, 1), ("wiki", 0.69, 2), ("gone", 0.01, 9), ("gone", 0.01, 9)], "source string, target_share double, max_repeats int")
    p = {r.source: r for r in mixture.plan(sized, targets).collect()}
    assert {k for k, r in p.items() if r.capped} == {"wiki", "gone"}
    m = mixture.mix(sized, targets, {"crawl": [(0, 2.0), (1, 0.0)]}, per_range=50)
    for r in m.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("position").alias("p")).collect():
        assert abs(r.n - p[r.source].demand) <= 20 and 0.9 < r.p <= 1
    # weight falling from 2 to 0: three quarters of the demand in the first half
    c = m.where("source = 'crawl'")
    assert abs(c.where("position < 0.5").agg(F.sum("n_tokens")).first()[0] / p["crawl"].demand - 0.75) < 0.05
    s = {r.source: r for r in mixture.shares(m, sized, targets).collect()}
    assert s["wiki"].repeats == 2 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    with pytest.raises(ValueError):
        mixture._segments({"x": [(0, 1.0)]})


def test_p9(spark, monkeypatch):
    rnd = random.Random(6)
    prose = lambda n=12: " ".join(f"the {rnd.choice(WORDS)} of a {rnd.choice(WORDS)} is in this {rnd.choice(WORDS)}." for _ in range(n))
    chinese = lambda: "".join(f"我们的{chr(rnd.randrange(0x5000, 0x5400))}在{chr(rnd.randrange(0x5000, 0x5400))}和{chr(rnd.randrange(0x5000, 0x5400))}是这。" for _ in range(20))
    spam = ["best shoe | " * 40, "\n".join(f"https://a{i}.example/x/{i}" for i in range(40)), "buy cheap shoe online price " * 20, "#鞋 便宜 鞋 买 | " * 40]
    rows = [(i, prose() if i % 4 else chinese()) for i in range(400)] + [(500 + i, t) for i, t in enumerate(spam)]
    rows += [(600, None), (601, ""), (602, "short page"), (603, prose() + "\nTags: a, b, c"), (604, "def f(x):\n return x=1;\n" * 3 + prose()), (605, "best shoe | " * 10 + prose(30)), (606, "\n".join(f"run={i} ms={i % 7} state=OK" for i in range(60))), (None, spam[0]), (607, prose(20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("language", F.lit("x"))
    assert {r.doc_id for r in spam_pages.spam_pages(docs).collect()} == {500, 501, 502, 503}
    assert spam_pages.scores(docs.limit(0)).count() == 0
    # the distance decides: beyond any distance nothing is spam
    monkeypatch.setattr(spam_pages, "CUT", 1e9)
    assert spam_pages.spam_pages(docs).count() == 0


SCHEMAS = {
    "corpus": "_id string, text string, title string, dataset string, fetched_at timestamp",
    "queries": "_id string, text string, dataset string",
    "edge_pairs": "u long, v long, shard string, seen_at timestamp, loaded_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, project string, crawled_at timestamp",
    "eval_items": "item_id long, suite string, text string",
    "source_targets": "source string, target_share double, max_repeats int",
}


@pytest.mark.parametrize("rows", ["none", "nulls"])
def test_empty_tables_and_rows_of_nulls(spark, tmp_path, rows):
    """No rows, and rows of nulls alone (with columns whose names the operators use inside), give no results."""
    for table, schema in SCHEMAS.items():
        clash = schema + ", key long, id long, n long, root long, part string, term int, position int"
        spark.createDataFrame([] if rows == "none" else [(None,) * len(clash.split(",")) for _ in range(3)], clash).write.parquet(f"{tmp_path}/{table}.parquet")
    counts = {q: f(spark, str(tmp_path)).count() for q, f in queries.QUERIES.items()}
    assert set(counts.values()) == {0}, counts
