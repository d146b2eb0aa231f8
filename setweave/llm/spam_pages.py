"""Keyword-stuffed and link-list pages: robust Mahalanobis distance per language.

A page is cut into passages of about PASSAGE words; characters of scripts written without spaces are words. Features
of a passage: density of marks that separate items (links, hash tags, prices, bare symbols), entropy (how surprising
its words are among the page's), repetition (words in pairs that the page repeats), share of function words, and
share of code (words with operators, brackets or joined by underscores), in which logs and code differ from spam.

Per language the centre is the median over all passages, the scale the median absolute deviation, and the scatter
the correlation of the passages within the bulk. A passage is an outlier if its squared Mahalanobis distance exceeds
CUT; it lies in the spam direction if its deviation, in the metric of the scatter, forms an angle with DIRECTION
whose cosine is ANGLE or more. A page more than half of whose words stand in such passages is spam.

The language of a page is the one whose function words are most frequent in it, the script deciding for Chinese;
the lists are the closed word classes of each language. Null and blank texts have no passage and are no spam; the
deviation of a passage of n words, fewer than PASSAGE, counts by n / PASSAGE. Repeated rows are judged each.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.session import materialize

#: Articles, pronouns, prepositions, conjunctions, auxiliary verbs and particles by language.
FUNCTION_WORDS = {
    "en": "a an the this that these those each every any some all both another other no one i you he she it we they me him her us them my your his its our their who whom whose which what nobody nothing anybody somebody everybody of in on at by for with from to into onto over under after before behind between through during without within across against about above below near upon inside outside as than if when whenever while because although though since until unless whether so but and or nor yet not is are was were be been being am do does did has have had will would can could shall should may might must there here then also only why how where",
    "de": "der die das den dem des ein eine einen einem einer eines jede jeder jedes jeden dieser diese dieses diesen diesem kein keine mein dein sein ihr unser ich du er sie es wir man wer was welche welcher sich in im an am auf aus bei mit nach von vom vor zu zum zur über unter neben zwischen durch für gegen ohne um seit während und oder aber sondern denn weil obwohl wenn sobald als ob dass nicht auch nur noch schon ist sind war waren wird werden hat haben kann können muss soll",
    "fr": "le la les l un une des du de d ce cet cette ces chaque aucun mon ton son notre votre leur je tu il elle nous vous ils elles on se qui que quoi dont où au aux à dans sur sous avec sans pour par en vers chez entre depuis pendant avant après et ou mais donc car ni si quand lorsque comme parce bien dès ne pas plus est sont était a ont sera peut doit y",
    "es": "el la los las lo un una unos unas este esta estos estas ese esa cada ningún mi tu su nuestro nuestra yo tú él ella nosotros ellos se que quien cual cuyo donde a al de del en con sin por para sobre bajo tras ante entre desde hasta hacia durante antes después y e o u pero sino porque aunque cuando si como no ni es son era fue ha han será puede debe",
    "zh": "的 了 着 在 是 和 与 或 不 没 也 都 就 而 但 因 为 此 如 果 若 时 后 前 随 有 这 那 各 每 从 到 对 被 把 将 于 之 其 所 以 及 并 再 又 还 只 很 更 最 上 下 内 第 同 们 它 他 我 你",
}
FEATURES = ["density", "entropy", "repetition", "function", "code"]
#: Where spam lies from the centre of ordinary passages, by feature.
DIRECTION = np.array([1.0, -1.0, 1.0, -1.0, -1.0])
FLOOR = np.full(len(FEATURES), 0.05)
CUT = 11.07  # chi-square with 5 degrees of freedom, 95 %
ANGLE = 0.3
BULK = 3.5
PASSAGE, REPEATS = 24, 3
SPAM_SHARE = 0.5
_LANGUAGES = list(FUNCTION_WORDS)
_SETS = [frozenset(v.split()) for v in FUNCTION_WORDS.values()]
_UNSPACED = re.compile(r"([぀-ヿ㐀-鿿가-힯豈-﫿])")
_STRIP = re.compile(r"[^\w]+")
_MARK = re.compile(r"://|^www\.|^#\w|[$€£¥|•·★»]|^\W+$|\]\(")
_CODE = re.compile(r"[={}<>\\@]|\w\(|\)\W*;|^\+\+|^--|\w_\w|^\[\d+\]")
#: Bits of a word's number: languages whose function word it is, then mark, code, wide, no word; the hash above them.
_MARKED, _CODED, _WIDE, _BARE, _BITS = 8, 9, 10, 11, 12


class _Words(dict):
    """Raw token -> its hash and flags in one number; emptied when it holds 2**18, some 40 MB."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        word = _STRIP.sub("", raw).lower()
        flags = sum((word in s) << i for i, s in enumerate(_SETS))
        flags |= bool(_MARK.search(raw)) << _MARKED | (bool(_CODE.search(raw)) and "://" not in raw) << _CODED | bool(_UNSPACED.match(word)) << _WIDE | (not word) << _BARE
        n = self[raw] = (xxhash.xxh64_intdigest(word) >> _BITS << _BITS | flags) & 0x7FFFFFFFFFFFFFFF
        return n


_words = _Words()


def _split(text: str | None) -> list[str]:
    return _UNSPACED.sub(r" \1 ", text).split() if text else []


def _counted(page: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row how many rows of its page have its key."""
    order = np.lexsort((key, page))
    p, k = page[order], key[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
    begins = np.flatnonzero(new)
    out = np.empty(len(p), np.int64)
    out[order] = np.repeat(np.diff(np.append(begins, len(p))), np.diff(np.append(begins, len(p))))
    return out


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, language number, words, features) of every passage, one after another."""
    lists = [_split(t) for t in texts]
    raw = np.fromiter(map(_words.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
    page = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flag = lambda x, bit: (x >> bit) & 1
    # Symbols alone count as marks of the word before.
    bare = flag(raw, _BARE).astype(bool)
    at = np.flatnonzero(~bare)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
    word, page_of = raw[at], page[at]
    owner = np.maximum(np.searchsorted(at, np.flatnonzero(bare), "right") - 1, 0)
    marks = flag(word, _MARKED).astype(float)
    np.add.at(marks, owner[page_of[owner] == page[bare]], 1.0)
    marks = np.minimum(marks, 1.0)
    n = np.bincount(page_of, minlength=len(lists))
    hits = np.stack([np.bincount(page_of, flag(word, i), len(lists)) for i in range(len(_LANGUAGES))], 1)
    wide = np.bincount(page_of, flag(word, _WIDE), len(lists)) > 0.3 * n
    hits[:, _LANGUAGES.index("zh")] = np.where(wide, np.inf, -1)
    language = hits.argmax(1)
    function = flag(word, language[page_of]).astype(float)
    key = word >> _BITS
    surprise = np.where(n[page_of] > 1, -np.log2(_counted(page_of, key) / n[page_of]) / np.log2(np.maximum(n[page_of], 2)), 1.0)
    pair = np.zeros(len(word), bool)
    pair[:-1] = (page_of[1:] == page_of[:-1]) & ~((function[1:] > 0) | (function[:-1] > 0))
    first = np.flatnonzero(pair)
    often = first[_counted(page_of[first], key[first] * 31 + key[first + 1]) >= REPEATS]
    repeated = np.zeros(len(word))
    repeated[often], repeated[often + 1] = 1.0, 1.0
    # The last passage of a page takes what is left, half a passage or more over.
    begin = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(word)) - begin[page_of]
    number = np.minimum(place // PASSAGE, np.maximum((n[page_of] + PASSAGE // 2) // PASSAGE - 1, 0))
    edges = np.flatnonzero((np.diff(page_of, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    size = np.diff(np.append(edges, len(word)))
    mean = lambda x: np.add.reduceat(x, edges) / size
    features = np.stack([mean(marks), mean(surprise), mean(repeated), mean(function), mean(flag(word, _CODED).astype(float))], 1)
    return page_of[edges], language[page_of[edges]], size, features


SCHEMA = "doc_id long, part int, language string, n_words long, density double, entropy double, repetition double, `function` double, code double"


def _passages(batches):
    names = np.array(_LANGUAGES)
    for b in batches:
        at, language, size, x = passages(b.column("text").to_pylist())
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1]) if len(at) else np.zeros(0, np.int64)
        part = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        cols = [b.column("doc_id").take(pa.array(at)), pa.array(part.astype(np.int32)), pa.array(names[language], pa.string()), pa.array(size.astype(np.int64)), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(FEATURES)))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "language", "n_words", *FEATURES])


def features(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> their passages: (doc_id, part, language, n_words, features)."""
    return documents.select("doc_id", "text").mapInArrow(_passages, SCHEMA)


def fit(parts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """language -> (median, scale, inverse correlation), from all passages."""
    used = parts.where(F.col("n_words") >= PASSAGE // 2)
    middle = lambda df: {r[0]: np.array(r[1:], float) for r in df.groupBy("language").agg(*(F.percentile_approx(f, 0.5, 1000) for f in FEATURES)).collect()}  # noqa: E731 - a row a language
    med = middle(used)
    if not med:
        return {}
    constants = lambda t: F.create_map(*(x for k, v in t.items() for x in (F.lit(k), F.array(*(F.lit(float(y)) for y in v)))))[F.col("language")]
    centred = used.withColumn("_m", constants(med)).select("language", *((F.col(f) - F.col("_m")[i]).alias(f) for i, f in enumerate(FEATURES)))
    scale = {k: np.maximum(1.4826 * v, FLOOR) for k, v in middle(centred.select("language", *(F.abs(f).alias(f) for f in FEATURES))).items()}
    z = centred.withColumn("_s", constants(scale)).select("language", *((F.col(f) / F.col("_s")[i]).alias(f) for i, f in enumerate(FEATURES)))
    bulk = z.where(F.greatest(*(F.abs(f) for f in FEATURES)) <= BULK)
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    sums = {r[0]: r[1:] for r in bulk.groupBy("language").agg(*(F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs)).collect()}
    out = {}
    for k in med:
        cov = np.eye(len(FEATURES))
        for (i, j), v in zip(pairs, sums.get(k, ())):
            cov[i, j] = cov[j, i] = v
        d = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        out[k] = (med[k], scale[k], np.linalg.inv(0.8 * cov / np.outer(d, d) + 0.2 * np.eye(len(d))))
    return out


def judge(model: dict, language: np.ndarray, size: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, cosine of the angle with the spam direction) of passages."""
    distance, cosine = np.zeros(len(x)), np.zeros(len(x))
    for k, (med, scale, inverse) in model.items():
        own = language == k
        z = (x[own] - med) / scale * np.minimum(1.0, size[own] / PASSAGE)[:, None]
        d2 = np.einsum("ij,jk,ik->i", z, inverse, z)
        distance[own] = d2
        cosine[own] = z @ inverse @ DIRECTION / np.sqrt(np.maximum(d2, 1e-12) * (DIRECTION @ inverse @ DIRECTION))
    return distance, cosine


def scores(documents: DataFrame) -> DataFrame:
    """One row a document with words: (doc_id, language, n_words, distance, cosine, spam_share), the two means weighted by words.

    Rows that repeat a doc_id are judged together.
    """
    parts = materialize(features(documents.where("doc_id is not null")), "passages")
    model = fit(parts)

    def run(batches):
        for b in batches:
            x = np.stack([b.column(f).to_numpy() for f in FEATURES], 1)
            language, size = np.array(b.column("language").to_pylist(), dtype=object), b.column("n_words").to_numpy()
            distance, cosine = judge(model, language, size, x)
            spam = (distance > CUT) & (cosine >= ANGLE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("language"), b.column("n_words"), pa.array(distance * size), pa.array(cosine * size), pa.array(np.where(spam, size, 0))], names=["doc_id", "language", "n_words", "distance", "cosine", "spam"])

    judged = parts.mapInArrow(run, "doc_id long, language string, n_words long, distance double, cosine double, spam long")
    whole = F.sum("n_words")
    return judged.groupBy("doc_id").agg(F.min("language").alias("language"), whole.alias("n_words"), (F.sum("distance") / whole).alias("distance"), (F.sum("cosine") / whole).alias("cosine"), (F.sum("spam") / whole).alias("spam_share"))


def spam_pages(documents: DataFrame) -> DataFrame:
    """Documents more than half of whose words stand in outlying passages of the spam direction."""
    return scores(documents).where(F.col("spam_share") > SPAM_SHARE)
