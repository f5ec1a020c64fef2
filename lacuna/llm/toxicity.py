"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. A category's logistic model sees which telling
words and word beginnings occur in the text, and the probabilities of the categories
before it. In training these probabilities are out-of-fold: each row's come from a model
whose terms and weights were chosen without the row, so a later model learns from
values as uncertain as those it will meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.lineage import cut

#: Labelled rows that a model is fitted on, about; a larger table is thinned by a hash of the id.
TRAINING_ROWS = 20_000
#: Most terms of a model, by chi-square; each occurs in at least LEAST_ROWS training rows.
TERMS = 1000
LEAST_ROWS = 3
LEAST_CHI = 10.83  # chance passes it once in a thousand terms
BEGINNINGS = (4, 5, 6)
FOLDS = 3
ITERATIONS = 50
REGULARISATION = 1e-4
THRESHOLD = 0.5

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Model(NamedTuple):
    terms: CountVectorizerModel
    weights: LogisticRegressionModel


class Chain(NamedTuple):
    """One model per category, in order; a number where labels don't vary or no term occurs often."""
    categories: tuple[str, ...]
    models: tuple[Model | float, ...]


def _beginnings(chars: int) -> Column:
    """The first ``chars`` characters of all words that have as many, marked."""
    long = F.filter("words", lambda w: F.char_length(w) >= chars)
    return F.transform(long, lambda w: F.concat(F.lit("^"), F.substring(w, 1, chars)))


def _terms(docs: DataFrame) -> DataFrame:
    """``docs`` with ``terms``: the lower-cased words of ``text`` and, marked, their beginnings."""
    words = F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER), _SPACE)
    words = F.array_distinct(F.filter(words, lambda w: w != ""))
    # an array column of its own, so that the words are split once
    rows = docs.withColumn("words", F.explode(F.array(words)))
    return rows.withColumn("terms", F.concat("words", *map(_beginnings, BEGINNINGS))).drop("words")


def _term_counts(train: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per term and fold: rows that have it, and of these the positive ones of each label."""
    sums = [F.count(F.when(F.col("fold") == f, 1)).alias(f"rows_{f}") for f in range(FOLDS)]
    sums += [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0.0)).alias(f"{c}_{f}")
             for c in labels for f in range(FOLDS)]
    rows = train.select("fold", *labels, F.explode(F.array_distinct("terms")).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("rows"), *sums).filter(F.col("rows") >= LEAST_ROWS)


def _vocabulary(counts: DataFrame, train: DataFrame, label: str, most: int, without: int | None) -> list[str]:
    """The ``most`` terms that tell most about ``label`` in the rows outside fold ``without``."""
    folds = [f for f in range(FOLDS) if f != without]
    total = train.filter(F.col("fold").isin(folds)).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0.0)).alias("yes")).first()
    n, yes = float(total["n"]), float(total["yes"])
    has = sum((F.col(f"rows_{f}") for f in folds), F.lit(0)).cast("double")
    both = sum((F.col(f"{label}_{f}") for f in folds), F.lit(0.0))
    # chi-square of the two-by-two table of having the term and the label
    odd = both * n - has * yes
    spread = has * (n - has) * yes * (n - yes)
    chi = F.when(spread > 0, odd * odd * n / spread)
    best = counts.filter(has >= LEAST_ROWS).select("term", chi.alias("chi")).filter(F.col("chi") >= LEAST_CHI)
    return [r["term"] for r in best.orderBy(F.desc("chi"), "term").limit(most).collect()]


def _featured(rows: DataFrame, terms: CountVectorizerModel, before: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=["occurs", *before], outputCol="features").transform(terms.transform(rows))


def _fit(train: DataFrame, counts: DataFrame, label: str, before: Sequence[str], most: int,
         without: int | None = None) -> Model | float:
    rows = train if without is None else train.filter(F.col("fold") != without)
    seen = rows.agg(F.avg(label).alias("mean")).first()["mean"]
    if seen in (None, 0.0, 1.0):
        return float(seen or 0.0)
    vocabulary = _vocabulary(counts, train, label, most, without)
    if not vocabulary:
        return float(seen)
    terms = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="occurs", binary=True)
    return Model(terms, LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=ITERATIONS, regParam=REGULARISATION,
        standardization=False, probabilityCol="probability_", rawPredictionCol="raw_",
        predictionCol="prediction_").fit(_featured(rows, terms, before)))


def _predict(rows: DataFrame, model: Model | float, before: Sequence[str], name: str) -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(model))
    scored = model.weights.transform(_featured(rows, model.terms, before))
    return (scored.withColumn(name, vector_to_array("probability_")[1])
            .drop("occurs", "features", "probability_", "raw_", "prediction_"))


def probability(category: str) -> str:
    return f"p_{category}"


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column],
              rows: int = TRAINING_ROWS, terms: int = TERMS) -> Chain:
    """Fit the chain on about ``rows`` labelled documents, with at most ``terms`` terms a model.

    ``categories`` gives, in order, a 0/1 expression on ``labels`` for each name. Rows with
    a null label or id, or without a document, are left out. Of an id's rows in ``labels`` that with the greatest
    labels counts, and of its documents that with the least text. The sampled ids are broadcast:
    their number is bounded by ``rows`` (in the mean) whatever the size of the tables.
    """
    usable = labels.select("doc_id", *(c.cast("double").alias(n) for n, c in categories.items()))
    usable = usable.na.drop().groupBy("doc_id").agg(F.max(F.struct(*categories)).alias("of")).select("doc_id", "of.*")
    share = min(1.0, rows / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", *categories).agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    train = cut(_terms(texts).withColumn("fold", fold).drop("text"))
    counts = cut(_term_counts(train, list(categories)))
    before: list[str] = []
    models: list[Model | float] = []
    for i, label in enumerate(categories):
        models.append(_fit(train, counts, label, before, terms))
        if i + 1 < len(categories):
            folds = [_predict(train.filter(F.col("fold") == f), _fit(train, counts, label, before, terms, f),
                              before, probability(label)) for f in range(FOLDS)]
            joined = folds[0]
            for part in folds[1:]:
                joined = joined.unionByName(part)
            train = cut(joined)
        before.append(probability(label))
    return Chain(tuple(categories), tuple(models))


def _scored(docs: DataFrame, chain: Chain, keep: Sequence[str]) -> DataFrame:
    """(kept, text, p_<category>…): the columns ``keep`` stay a struct, so their names clash with nothing."""
    rows = _terms(docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), "text"))
    before: list[str] = []
    for category, model in zip(chain.categories, chain.models):
        rows = _predict(rows, model, before, probability(category))
        before.append(probability(category))
    return rows


def _named(keep: Sequence[str], results: dict[str, Column]) -> list[Column]:
    """The kept columns, then the results; a result gets '_' after a name that is taken."""
    taken, out = set(keep), [F.col(f"kept.`{c}`") for c in keep]
    for name, column in results.items():
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(column.alias(name))
    return out


def score(docs: DataFrame, chain: Chain, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every document with a probability ``p_<category>`` each.

    The whole text counts; a null or empty text has no words, and its probabilities are those of the
    models' intercepts. Repeated rows stay; columns not kept may have any name, and a kept column
    of a result's name stays, while the result gets '_' after its name.
    """
    names = [probability(c) for c in chain.categories]
    return _scored(docs, chain, keep).select(*_named(keep, {n: F.col(n) for n in names}))


def _toxic(chain: Chain, threshold: float) -> Column:
    worded = F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))
    return (F.col(probability(chain.categories[-1])) >= threshold) & F.coalesce(worded, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], threshold: float = THRESHOLD,
          keep: Sequence[str] = ("doc_id",), rows: int = TRAINING_ROWS, terms: int = TERMS) -> DataFrame:
    """``score`` of the chain fitted on the labels, and ``toxic``: the last category's
    probability is at least ``threshold`` and the text has words.

    Without usable labels nothing is toxic.
    """
    chain = fit_chain(docs, labels, categories, rows, terms)
    names = [probability(c) for c in chain.categories]
    return _scored(docs, chain, keep).select(
        *_named(keep, {n: F.col(n) for n in names} | {"toxic": _toxic(chain, threshold)}))


def without_toxic(docs: DataFrame, labels: DataFrame, categories: dict[str, Column],
                  threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all their columns whatever their names, that ``judge`` does not call toxic."""
    chain = fit_chain(docs, labels, categories)
    clean = _scored(docs, chain, docs.columns).filter(~_toxic(chain, threshold))
    return clean.select(*_named(docs.columns, {}))
