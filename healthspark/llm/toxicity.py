"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a seed lexicon and of a lexicon learned from labels (words and
word beginnings that toxic documents use far more often), the share of lexicon words near a second-person
pronoun, capitals, punctuation, and obfuscation (digits or marks inside words, words that match the
lexicon only after undoing such marks). Labels, language, source and ids are no features.

Labelled training rows are dealt by crc32(doc_id) into three disjoint parts: one learns the lexicon,
one the trees, one the calibration, so no model sees evidence it helped to choose. Each part is a bounded
sample, `max_rows` rows at most in expectation, taken by a hash of doc_id; the lexicon holds at most
`max_terms` terms. Scoring covers every row and is map-only: features, then the JVM-side tree model.

Input rules: null and empty texts have all-zero features and still get a score; a null doc_id is
scored and counts as not held out; repeated rows are scored alike; labels that are null or repeated for a
document are dropped or reduced to the largest; without both classes to learn from, the score is
the share of toxic training rows (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store

#: General English insults and threats; the learned lexicon adds what the labels show.
SEED = frozenset("idiot idiots moron morons stupid dumb dumbass fool loser losers trash garbage scum clown pathetic worthless "
                 "disgusting ugly freak creep jerk bastard bitch whore slut crap shit fuck fucking fucker asshole ass hate "
                 "kill die pig filth vermin".split())
#: Second person in English, German, French, Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tus "
                   "vosotros".split())
#: What a mark or digit inside a word stands for.
PLAIN = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "*": None})

FEATURES = ("seed", "seed_log", "learned", "learned_log", "learned_top", "learned_kinds", "begin", "begin_top", "second",
            "near_second", "capitals", "shouted", "exclaim", "punctuation", "digits_inside", "undone", "words_log")
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"(?<![\w@$!*])[^\W\d_][\w@$!*]*[\d@$!*_][\w@$!*]*[^\W_](?![\w@$!*])")
_UPPER = bytes(range(65, 91))
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lengths of word beginnings that may become terms.
BEGIN = (4, 5, 7)


def bucket(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(1)).cast("int")


def terms(text: str) -> set[str]:
    """Distinct words, and beginnings of longer words (marked by a leading ^)."""
    words = set(_WORD.findall(text.lower()))
    return words | {"^" + w[:n] for n in BEGIN for w in words if len(w) > n}


def learn_lexicon(train: DataFrame, max_terms: int, least: int = 3) -> dict[str, float]:
    """term -> log odds of document frequencies, the strongest `max_terms` positive ones.

    Each task counts its own documents and sends one row per term; the counts meet by term.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "clean", "toxic"])

        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in terms(text or ""):
                    counts.setdefault(term, [0, 0])[toxic] += 1
                if len(counts) > 300_000:  # bounded memory: send what is there and go on
                    yield rows(counts)
                    counts = {}
        if counts:
            yield rows(counts)

    total = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total[1] + 1)) - F.log((F.col("clean") + 0.5) / (total[0] + 1))
    found = train.select("text", "toxic").mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least) \
        .withColumn("odds", odds).where("odds > 1").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(max_terms)
    return {r["term"]: r["odds"] for r in found.collect()}


def featurize(text: str, lexicon: dict[str, float]) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    counts = Counter(low)
    n = max(1, len(words))
    seed = sum(counts[w] for w in SEED if w in counts)
    learned = begin = learned_top = begin_top = 0.0
    kinds = 0
    hits = set(SEED)
    for w, c in counts.items():
        if (odds := lexicon.get(w)) is not None:
            learned += odds * c
            learned_top = max(learned_top, odds)
            kinds += 1
            if odds > 2.5:
                hits.add(w)
        best = 0.0
        for k in BEGIN:
            if len(w) > k and (odds := lexicon.get("^" + w[:k])) is not None:
                best = max(best, odds)
        if best:
            begin += best * c
            begin_top = max(begin_top, best)
    second = sum(counts[w] for w in SECOND if w in counts)
    near = found = 0
    if any(w in counts for w in hits):
        last, waiting = -10, []
        for i, w in enumerate(low):
            if w in SECOND:
                near += sum(i - j <= 5 for j in waiting)
                last, waiting = i, []
            elif w in hits:
                found += 1
                if i - last <= 5:
                    near += 1
                else:
                    waiting.append(i)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    odd = _ODD.findall(text)
    undone = sum(w.lower() not in hits and w.lower().translate(PLAIN) in hits for w in odd)
    return [seed / n, math.log1p(seed), learned / n, math.log1p(learned), learned_top, math.log1p(kinds), begin / n, begin_top,
            second / n, near / max(1, found), (size - len(raw.translate(None, _UPPER))) / size,
            sum(len(w) > 2 and w.isupper() for w in words) / n, (text.count("!") + text.count("?")) / n,
            (size - len(raw.translate(None, _MARKS))) / size, len(odd) / n, undone / n, math.log1p(len(words))]


def with_features(docs: DataFrame, lexicon: dict[str, float], names: list[str]) -> DataFrame:
    """The columns `names` of `docs` and `features` of its text."""
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [featurize(t or "", lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i + 1) for i in range(len(names))],
                                              pa.array(made, pa.list_(pa.float64()))], [*names, "features"])

    return docs.select("text", *names).mapInArrow(run, schema)


def _sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """All rows, or a share by hash of doc_id that holds max_rows in expectation."""
    n = rows.count()
    return rows if n <= max_rows else rows.where(
        F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))


class ToxicityModel:
    """Lexicon, trees and calibration; `score` adds `score` to (doc_id, text) rows."""

    def __init__(self, lexicon: dict, trees, steps: tuple | None, base: float):
        self.lexicon, self.trees, self.steps, self.base = lexicon, trees, steps, base

    def _calibrated(self, p: Column) -> Column:
        """Linear interpolation between the bounds of the isotonic steps, flat outside."""
        xs, ys = self.steps
        def tree(low: int, high: int) -> Column:
            if low == high:
                if low == 0 or low == len(xs):
                    return F.lit(float(ys[0 if low == 0 else -1]))
                x0, x1, y0, y1 = xs[low - 1], xs[low], ys[low - 1], ys[low]
                return F.lit(float(y0)) + (p - float(x0)) * (float(y1 - y0) / float(x1 - x0) if x1 > x0 else 0.0)
            mid = (low + high) // 2
            return F.when(p >= float(xs[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))
        return tree(0, len(xs))

    def score(self, docs: DataFrame, kept: str = "doc_id") -> DataFrame:
        if self.trees is None:
            return docs.select(kept, F.lit(self.base).alias("score"))
        made = with_features(docs, self.lexicon, [kept]).withColumn("features", array_to_vector("features"))
        out = self.trees.transform(made).withColumn("_p", vector_to_array("probability")[1])
        score = self._calibrated(F.col("_p")) if self.steps else F.col("_p")
        return out.select(kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, max_terms: int = 4_000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", trees: int = 20, depth: int = 4, seed: int = 3) -> ToxicityModel:
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).cast("int").alias("toxic")).withColumn("part", bucket(F.col("_id"))).where("part <> 0")
    marked = store(marked.withColumnRenamed("_id", "doc_id"), "toxic-labels")
    parts = [_sample(marked.where(F.col("part").isin(*p)), max_rows) for p in ((1, 2), (3,), (4,))]
    wanted = store(parts[0].unionAll(parts[1]).unionAll(parts[2]), "toxic-sample")
    # three samples of max_rows ids in expectation, whatever the corpus: small enough to travel, so no text does
    few = wanted.count() <= 6 * max_rows
    rows = store(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        F.broadcast(wanted) if few else wanted, "doc_id"), "toxic-train")
    shares = {r["part"]: (r["n"], r["toxic"]) for r in rows.groupBy("part").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    n, positive = sum(v[0] for v in shares.values()), sum(v[1] for v in shares.values())
    base = positive / n if n else 0.0
    if not 0 < shares.get(3, (0, 0))[1] < shares.get(3, (0, 0))[0]:
        return ToxicityModel({}, None, None, base)
    lexicon = learn_lexicon(rows.where("part in (1, 2)"), max_terms)
    # the first two parts' texts chose the lexicon; trees and calibration use the other two
    made = store(with_features(rows.where("part in (3, 4)"), lexicon, ["part", "toxic"]), "toxic-features")
    made = made.withColumn("features", array_to_vector("features")).withColumn("label", F.col("toxic").cast("double"))
    forest = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, subsamplingRate=0.8,
                           maxBins=64, seed=seed).fit(made.where("part = 3"))
    steps = None
    if 0 < shares.get(4, (0, 0))[1] < shares.get(4, (0, 0))[0]:
        held = forest.transform(made.where("part = 4")).select("label", vector_to_array("probability")[1].alias("p"))
        fit = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
        steps = (fit.boundaries.toArray().tolist(), fit.predictions.toArray().tolist())
    return ToxicityModel(lexicon, forest, steps, base)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = model.score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return scored.select("doc_id", (bucket(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """`docs` without the rows whose score reaches the threshold."""
    model = train(docs, labels, **options)
    text_col = options.get("text_col", "text")
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("text"))
    return model.score(carried, "_row").where(F.col("score") < threshold).select("_row.*")
