"""Session scores from fitted models: n-gram language model, PCA residual, weak-label classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schema import SESSION_KEYS, keys_of
from ..staging import materialize
from .models import score_in_chunks
from .scan import neighbours
from .sequence import exact_sum

HELD = 64                      # groups whose second moments a task holds at once
WEIGHTS = (0.6, 0.3, 0.1)      # trigram, bigram, unigram share of the mixture


def context_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token rows with the two tokens before: t1 (two back), t2 (one back), t3 (the token itself)."""
    r = rows.select(*keys, "pos", "seq_len", F.col("token").alias("t3"))
    return neighbours(r, keys, "pos", behind={"t2": ("t3", 1), "t1": ("t3", 2)}).where(F.col("pos") >= 1)


def mixture_log_probs(train: DataFrame, wanted: DataFrame, by: Sequence[str], weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """ln P(t3 | t1, t2) of the wanted grams under the mixture fitted on the training grams.

    Both inputs are gram counts per `by`: t1, t2, t3, c. Where a context was not seen, or a session begins, its weight is
    shared among the parts that are known, so the probabilities of a context always sum to one.
    """
    by = list(by)
    g3 = train
    g2 = g3.groupBy(*by, "t2", "t3").agg(F.sum("c").alias("n23"))
    g1 = g2.groupBy(*by, "t3").agg(F.sum("n23").alias("n3"))
    ctx2 = g3.groupBy(*by, "t1", "t2").agg(F.sum("c").alias("n12"))
    ctx1 = g2.groupBy(*by, "t2").agg(F.sum("n23").alias("n2"))
    total = g1.groupBy(*by).agg((F.sum("n3") + F.count("*") + 1).alias("n0"))
    w = (wanted.join(g3.withColumnRenamed("c", "n123"), [*by, "t1", "t2", "t3"], "left").join(ctx2, [*by, "t1", "t2"], "left")
         .join(g2, [*by, "t2", "t3"], "left").join(ctx1, [*by, "t2"], "left").join(g1, [*by, "t3"], "left").join(total, by, "left"))

    def share(num: str, den: str) -> Column:
        return F.coalesce(F.col(num) / F.col(den), F.lit(0.0))

    def known(den: str, weight: float) -> Column:
        return F.when(F.col(den).isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))

    p = (weights[0] * share("n123", "n12") + weights[1] * share("n23", "n2")
         + weights[2] * (F.coalesce("n3", F.lit(0)) + 1) / F.coalesce("n0", F.lit(1))) \
        / (known("n12", weights[0]) + known("n2", weights[1]) + weights[2])
    return w.select(*by, "t1", "t2", "t3", F.ln(p).alias("lp"))


def lm_scores(rows: DataFrame, keys: Sequence[str] = SESSION_KEYS, by: Sequence[str] = ("client_name",), split: str = "test",
              tail_k: int = 128, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Mean, tail and largest surprise of the sessions of a split; the model is fitted on the train split.

    `rows` are token rows with `split`. Each session is reduced to counts per gram before any join.
    """
    keys = keys_of(keys, rows)
    grams = materialize(
        context_rows(rows.where(F.col("split").isin("train", split)), [*keys, "split"])
        .groupBy(*keys, "split", "t1", "t2", "t3")
        .agg(F.count("*").alias("c"), F.count_if(F.col("seq_len") - F.col("pos") <= tail_k).alias("c_tail")), "grams")
    train = grams.where(F.col("split") == "train").groupBy(*by, "t1", "t2", "t3").agg(F.sum("c").alias("c"))
    here = grams.where(F.col("split") == split)
    wanted = here.select(*by, "t1", "t2", "t3").distinct()
    key = F.to_json(F.array("t1", "t2", "t3"))      # the first gram of a session has no t1
    probs = mixture_log_probs(train, wanted, by, weights).select(*by, key.alias("g"), "lp")
    scored = here.withColumn("g", key).join(probs, [*by, "g"])
    nll = -F.col("lp")
    return scored.groupBy(*keys, "split").agg(
        (exact_sum(F.col("c") * nll) / F.sum("c")).alias("score_mean_nll"),
        F.coalesce(exact_sum(F.col("c_tail") * nll) / F.nullif(F.sum("c_tail"), F.lit(0)), F.lit(0.0)).alias("score_tail_nll"),
        F.max(nll).alias("score_max_nll"))


def reduce_losses(rows: DataFrame, keys: Sequence[str], tail_k: int = 128, padded_to: int | None = None) -> DataFrame:
    """Mean, tail mean and maximum of (pos, seq_len, loss) rows per session.

    The tail is the last `tail_k` real places. With `padded_to` it is the last `tail_k` places of rows padded to
    that length instead, so that sessions ending before it score 0.
    """
    end = F.lit(padded_to) if padded_to else F.col("seq_len")
    tail = F.when(F.col("pos") >= end - tail_k, F.col("loss"))
    return rows.groupBy(*keys).agg(F.avg("loss").alias("mean"), F.coalesce(F.avg(tail), F.lit(0.0)).alias("tail"), F.max("loss").alias("max"))


def reduce_loss_array(losses: Column, tail_k: int = 128) -> Column:
    """The same for an array of losses: struct(mean, tail, max)."""
    def mean(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)).otherwise(0.0)

    k = F.least(F.size(losses), F.lit(tail_k))
    tail = F.when(k > 0, F.slice(losses, -k, k)).otherwise(losses)
    return F.struct(mean(losses).alias("mean"), mean(tail).alias("tail"), F.coalesce(F.array_max(losses), F.lit(0.0)).alias("max"))


def term_vectors(events: DataFrame, keys: Sequence[str], token: str = "token", dims: int = 128) -> DataFrame:
    """Hashed term frequencies per session as a sparse list of (i, v) with at most `dims` entries."""
    slot = F.pmod(F.xxhash64(token), F.lit(dims)).cast("int")
    counts = events.groupBy(*keys, slot.alias("i")).agg(F.count("*").alias("c"))
    n = F.sum("c").cast("double")
    return counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("_ic"), n.alias("_n")).select(
        *keys, F.transform("_ic", lambda s: s.i).alias("slots"), F.transform("_ic", lambda s: s.c / F.col("_n")).alias("weights"))


def _dense(table, dims: int) -> np.ndarray:
    slots, weights = table.column("slots").combine_chunks(), table.column("weights").combine_chunks()
    lengths = np.diff(slots.offsets.to_numpy())
    x = np.zeros((len(lengths), dims))
    x[np.repeat(np.arange(len(lengths)), lengths), slots.flatten().to_numpy()] = weights.flatten().to_numpy()
    return x


def pca_models(vectors: DataFrame, by: str, dims: int = 128, components: int = 8) -> DataFrame:
    """Mean and leading directions per group, from second moments summed per task and then per group.

    A task keeps the moments of `HELD` groups at most and hands them on when it meets more: sums of sums stay sums.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def cells(name, m):
            i, j = np.nonzero(m)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], names=["g", "i", "j", "v"])
        for batch in batches:
            group = batch.column(by).dictionary_encode()
            names, codes = group.dictionary.to_pylist(), group.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = _dense(pa.Table.from_batches([batch]), dims)
            x = np.column_stack([np.ones(len(x)), x])
            order = np.argsort(codes, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                if not len(rows):
                    continue
                name = names[codes[rows[0]]] if codes[rows[0]] >= 0 else None
                sums[name] = sums.get(name, 0.0) + x[rows].T @ x[rows]
                if len(sums) > HELD:
                    yield from (cells(*item) for item in sums.items())
                    sums.clear()
        yield from (cells(*item) for item in sums.items())

    cells = (vectors.select(by, "slots", "weights").mapInArrow(moments, "g string, i int, j int, v double")
             .groupBy("g", "i", "j").agg(F.sum("v").alias("v")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((dims + 1, dims + 1))
        m[pdf["i"], pdf["j"]] = pdf["v"]
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        _, vec = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "mean": [mean], "axes": [vec[:, ::-1][:, :components].T.ravel()]})

    return cells.groupBy("g").applyInPandas(fit, "g string, mean array<double>, axes array<double>").withColumnRenamed("g", by)


def reconstruction_scores(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, by: str = "client_name", token: str = "token",
                          dims: int = 128, components: int = 8, train: Column | None = None) -> DataFrame:
    """Distance of each session's term vector from the leading subspace of its group.

    `train` picks the sessions the subspace is fitted on; by default all.
    """
    keys = keys_of(keys, events)
    vectors = materialize(term_vectors(events, keys, token, dims), "vectors")
    model = pca_models(vectors.where(train) if train is not None else vectors, by, dims, components)

    def score(rows: pa.Table, fitted: pa.Table) -> dict[str, pa.Array]:
        x = _dense(rows, dims)
        if not fitted.num_rows:
            return {"score_reconstruction": pa.nulls(len(x), pa.float64())}
        x = x - np.array(fitted.column("mean")[0].as_py())
        axes = np.array(fitted.column("axes")[0].as_py()).reshape(-1, dims)
        rest = (x * x).sum(1) - ((x @ axes.T) ** 2).sum(1)
        return {"score_reconstruction": pa.array(np.sqrt(np.maximum(rest, 0.0)))}

    added = T.StructType([T.StructField("score_reconstruction", T.DoubleType())])
    return score_in_chunks(vectors, model, [by], keys, score, added).drop("slots", "weights")


def weak_label_scores(events: DataFrame, labels: DataFrame, keys: Sequence[str] = SESSION_KEYS, by: str = "client_name",
                      token: str = "token", dims: int = 1 << 14, reg: float = 0.01, iterations: int = 20) -> DataFrame:
    """Probability of the weak label from tokens and token pairs.

    Terms carry their group's name, so one fit keeps the groups apart. `labels` are (keys, label, split); the
    model is fitted on the train split and scores every session. Terms become one of `dims` slots before they
    are listed, which bounds a session's list; scores are sums of the slots' weights, a table of `dims` rows.
    """
    keys = keys_of(keys, events, labels)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    pairs = neighbours(events.select(*keys, "seq_no", F.col(token).alias("a")), keys, "seq_no", ahead={"b": ("a", 1)})
    words = F.array_compact(F.array(F.concat(by, F.lit("\u0001"), "a"), F.concat(by, F.lit("\u0001"), "a", F.lit("\u0002"), "b")))
    slots = materialize(pairs.select(*keys, F.explode(words).alias("term")).select(
        *keys, F.pmod(F.xxhash64("term"), F.lit(dims)).cast("int").alias("slot")).distinct(), "slots")
    train = (slots.join(labels.where(F.col("split") == "train"), list(keys)).groupBy(*keys)
             .agg(F.max(F.col("label").cast("double")).alias("label"), F.collect_list(F.col("slot").cast("string")).alias("slots")))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], "slots", "x").transform(train)
    fitted = LogisticRegression(featuresCol="x", labelCol="label", maxIter=iterations, regParam=reg).fit(
        materialize(vectors.select("label", "x"), "terms"))
    weights = events.sparkSession.createDataFrame(
        [(i, float(w)) for i, w in enumerate(fitted.coefficients.toArray()) if w], "slot int, w double")
    z = slots.join(F.broadcast(weights), "slot", "left").groupBy(*keys).agg(exact_sum(F.coalesce("w", F.lit(0.0))).alias("z"))
    score = 1.0 / (1.0 + F.exp(-(F.col("z") + F.lit(float(fitted.intercept)))))
    return z.join(labels, list(keys)).select(*keys, "split", F.col("label").cast("double").alias("label"), score.alias("score_weak_label"))


def pseudo_training_set(scores: DataFrame, positives: Sequence[DataFrame], keys: Sequence[str] = SESSION_KEYS, by: str = "client_name",
                        ratio: float = 3.0) -> DataFrame:
    """Labelled sessions: the top lists as positives, and per group about `ratio` times as many others by hash."""
    keys = keys_of(keys, scores)
    pos = positives[0].select(*keys)
    for p in positives[1:]:
        pos = pos.unionByName(p.select(*keys))
    pos = pos.distinct()
    sizes = scores.groupBy(by).agg(F.count("*").alias("_all")).join(pos.groupBy(by).agg(F.count("*").alias("_pos")), by)
    space = 1_000_000
    ticket = C.stable_bucket(F.concat_ws("|", *keys), space)
    rate = F.col("_pos") * ratio / F.nullif(F.col("_all") - F.col("_pos"), F.lit(0))
    neg = scores.select(*keys).join(pos, list(keys), "left_anti").join(sizes, by).where(ticket < rate * space)
    return pos.withColumn("label", F.lit(1)).unionByName(neg.select(*keys, F.lit(0).alias("label")))
