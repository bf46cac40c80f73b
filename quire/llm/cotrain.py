"""Quality classifier by co-training (operator 3).

Two classifiers see a document through separate views: its text (words of a
fitted vocabulary and counts of style) and its metadata (language, source,
size). In each round each labels the unlabelled documents that it is surest
of, and the other learns from these. Both views are then calibrated on
labelled documents held out of the training, combined by a logistic
combination of their calibrated scores, and all documents are scored.

Good means quality 1 and not toxic. Fitting uses max_labelled labelled
documents, chosen by the hash of doc_id, and max_words words of at least
min_docs of these whose share of good ones lies min_z standard deviations from
the usual. Every unlabelled document takes part: in each round both views
score all of them on the executors, and the per_round surest of each view come
to the driver by a distributed top-k. Means and deviations of the style
figures are those of all documents. Scoring reads every document whole.

Defined cases: null text has no words; null metadata are values of their
own; labels that contradict each other count as bad; without labels of both
kinds every score is the share of good labels (1 without labels); repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick, shuffle_partitions, stored, table
from quire.llm.decontaminate import words_of

MAX_LABELLED, MAX_WORDS, MIN_DOCS, MIN_Z, ROUNDS, PER_ROUND = 6000, 2000, 8, 4.0, 3, 400
STYLE = ("log_words", "word_length", "upper_share", "digit_share", "symbols_per_word", "exclaims_per_word", "pipes_per_word", "distinct_share", "distinct_lines", "line_words")
META = 64 + 16 + 16
FEATURES = "doc_id long, style array<double>, words array<int>, meta array<int>"
_NOT_UPPER = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_NOT_DIGIT = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&<>")


def style_of(text: str | None) -> tuple[list[float], set[bytes]]:
    """STYLE figures and the set of folded words of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(text)
    kinds = set(words)
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(words))),
        sum(map(len, kinds)) / max(1, len(kinds)),
        len(raw.translate(None, _NOT_UPPER)) / size,
        len(raw.translate(None, _NOT_DIGIT)) / size,
        len(raw.translate(None, _NOT_SYMBOL)) / n,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        len(kinds) / n**0.8,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(words) / max(1, len(lines)))),
    ], kinds


def meta_of(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Active columns of the metadata view: source and language by hash, size by power of two."""
    size = 15 if n_chars is None or n_chars < 0 else min(14, int(n_chars).bit_length())
    return [zlib.crc32(repr(source).encode()) % 64, 64 + zlib.crc32(repr(lang).encode()) % 16, 80 + size]


class Logistic:
    """Logistic regression on sparse 0/1 columns plus dense ones, by full-batch Adam; no randomness."""

    def __init__(self, n_sparse: int, n_dense: int, decay: float):
        self.w, self.v, self.b, self.decay = np.zeros(n_sparse), np.zeros(n_dense), 0.0, decay

    def margin(self, rows, cols, n: int, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.w[cols], n) + dense @ self.v + self.b

    def fit(self, rows, cols, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1) -> Logistic:
        params = [self.w, self.v, np.array([self.b])]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = weight.sum()
        for t in range(1, steps + 1):
            z = np.bincount(rows, params[0][cols], len(y)) + dense @ params[1] + params[2][0]
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
            grads = [np.bincount(cols, g[rows], len(params[0])) + self.decay * params[0], dense.T @ g + self.decay * params[1], np.array([g.sum()])]
            for p, d, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        self.w, self.v, self.b = params[0], params[1], float(params[2][0])
        return self


def _flat(index_lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = [len(x) for x in index_lists]
    return np.repeat(np.arange(len(size)), size), (np.concatenate(index_lists).astype(np.int64) if index_lists else np.zeros(0, np.int64))


def co_train(text, dense, meta, y: np.ndarray, n_words: int, n_pool: int, surest: Callable, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> dict:
    """The combined model. text and meta: active columns of each labelled document; y: 1 or 0.

    surest(models, taken, counts): for each view the (doc_id, label, style,
    words, meta) of the unlabelled documents that it is surest of, at most
    counts[view] = (bad, good) of them and none of taken[view].
    """
    text, meta, dense, y = list(text), list(meta), list(dense), np.asarray(y)
    n = len(y)
    held = np.arange(n)[2::3]  # the input is in hash order
    train = np.setdiff1d(np.arange(n), held)
    own = [dict(zip(train.tolist(), y[train].tolist(), strict=True)) for _ in range(2)]  # each view's training labels
    share = float(np.mean(y[train] == 1)) if len(train) else 1.0
    at: dict[int, int] = {}  # doc_id → row of a pseudo-labelled document
    views = ((n_words, 1e-4), (META, 1e-3))

    def columns(i: int, rows: list[int]) -> tuple:
        extra = np.array([dense[k] for k in rows]).reshape(len(rows), -1) if i == 0 else np.zeros((len(rows), 0))
        return *_flat([np.asarray((text, meta)[i][k], np.int64) for k in rows]), extra

    def learn(i: int) -> Logistic:
        rows = sorted(own[i])
        r, c, extra = columns(i, rows)
        given = np.where(np.array(rows) < n, 1.0, 0.3)  # pseudo-labels weigh less
        return Logistic(views[i][0], extra.shape[1], views[i][1]).fit(r, c, extra, np.array([own[i][k] for k in rows], float), given)

    models = [learn(i) for i in range(2)]
    for _ in range(rounds):
        taken = [{d for d, k in at.items() if k in own[1 - i]} for i in range(2)]
        counts = []
        for i in range(2):
            free = n_pool - len(taken[i])
            n_bad = min(int(per_round * (1 - share)), free // 2)
            counts.append((n_bad, min(per_round - n_bad, free - n_bad)))
        for i, found in enumerate(surest(models, taken, counts)):
            for doc, label, style, words, kinds in found:
                if doc not in at:
                    at[doc] = len(text)
                    text.append(words)
                    meta.append(kinds)
                    dense.append(style)
                own[1 - i][at[doc]] = label
        models = [learn(i) for i in range(2)]

    def margins(i: int) -> np.ndarray:
        r, c, extra = columns(i, fold.tolist())
        return models[i].margin(r, c, len(fold), extra)

    calib, fold = [], held if len(held) else train
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    z_of = [margins(i) for i in range(2)]
    for i in range(2):  # Platt's scaling on documents that no view has trained on
        z = z_of[i][:, None] / 5
        c = Logistic(0, 1, 1e-4).fit(*none, z, (y[fold] == 1).astype(float), np.ones(len(fold)))
        calib.append((float(c.v[0]) / 5, c.b))
    both = np.stack([z_of[i] * calib[i][0] + calib[i][1] for i in range(2)], 1)
    top = Logistic(0, 2, 1e-4).fit(*none, both / 5, (y[fold] == 1).astype(float), np.ones(len(fold)))
    return {
        "text": models[0],
        "meta": models[1],
        "calib": calib,
        "top": (float(top.v[0]) / 5, float(top.v[1]) / 5, top.b),
    }


def _standard(style: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.clip((style - mean) / sd, -5, 5)


def _surest(pool: DataFrame, mean: np.ndarray, sd: np.ndarray) -> Callable:
    """surest() of co_train() over all rows of pool(FEATURES): both views score each, tasks keep their surest, the driver those of all."""
    spark = pool.sparkSession
    # `side` is view * 2 + label; z falls for label 0 and rises for 1.
    schema = f"side int, z double, {FEATURES}"
    types = (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def best(rows: list[tuple], counts) -> list[tuple]:
        out = []
        for side in range(4):
            mine = [r for r in rows if r[0] == side]
            # Ties go to the lesser doc_id for bad ones, to the greater for good ones.
            out += sorted(mine, key=lambda r: r[1:3], reverse=side % 2 == 1)[: counts[side // 2][side % 2]]
        return out

    def table_of(rows: list[tuple]):
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["side", "z", "doc_id", "style", "words", "meta"])

    def ask(models, taken, counts):
        sent = spark.sparkContext.broadcast((models, [np.array(sorted(t), np.int64) for t in taken], counts))

        def scored(batches):
            models, taken, counts = sent.value
            held: list[tuple] = []
            for b in batches:
                n, ids = b.num_rows, b.column(0).to_numpy()
                if not n:
                    continue
                dense = _standard(b.column(1).flatten().to_numpy().reshape(n, -1), mean, sd)
                picks = []
                for i in range(2):
                    cells = b.column(2 + i)
                    rows = np.repeat(np.arange(n), np.asarray(cells.value_lengths()))
                    z = np.bincount(rows, models[i].w[cells.flatten().to_numpy()], n) + models[i].b
                    z = np.round(z + (dense * models[i].v).sum(1) if i == 0 else z, 9)
                    free = ~np.isin(ids, taken[i])
                    # Only those beyond the doubt of both sides of the margin are handed over.
                    for label, on, k in ((0, free & (z < -1), counts[i][0]), (1, free & (z > 1), counts[i][1])):
                        on = np.flatnonzero(on)
                        order = on[np.lexsort((ids[on], z[on]))]
                        picks += [(2 * i + label, float(z[j]), int(j)) for j in (order[:k] if label == 0 else order[len(order) - min(k, len(order)) :])]
                style, words, meta = b.column(1), b.column(2), b.column(3)
                held = best(held + [(side, z, int(ids[j]), style[j].as_py(), words[j].as_py(), meta[j].as_py()) for side, z, j in picks], counts)
            yield table_of(held)

        def merged(batches):
            held: list[tuple] = []
            for b in batches:
                held = best(held + list(zip(*(c.to_pylist() for c in b.columns), strict=True)), sent.value[2])
            yield table_of(held)

        few = pool.mapInArrow(scored, schema).repartition(min(8, shuffle_partitions(spark)), "doc_id").mapInArrow(merged, schema)
        found = best([tuple(r) for r in few.collect()], counts)
        return [[(r[2], r[0] % 2, _standard(np.array(r[3]), mean, sd), r[4], r[5]) for r in found if r[0] // 2 == i] for i in range(2)]

    return ask


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> dict:
    """The model of docs(doc_id, text, lang, source, n_chars) and labels(doc_id, quality, toxic)."""
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    lab = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
    lab = lab.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("y"))
    order = F.xxhash64("doc_id")
    chosen = lab.join(d.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(max_labelled)
    sample = {r[0]: r[1] for r in chosen.collect()}
    if len(set(sample.values())) < 2:
        return {"constant": float(next(iter(sample.values()), 1))}
    ids = docs.sparkSession.createDataFrame(list(sample.items()), "doc_id long, y int")
    rows = d.join(F.broadcast(ids), "doc_id")  # max_labelled ids

    def run_words(batches):
        for b in batches:
            found = [(w.decode("utf-8", "replace"), y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in style_of(t)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int32()))], names=["w", "y"])

    # Words whose share of good documents lies far from the usual: the others only invite overfitting.
    share = sum(sample.values()) / len(sample)
    counted = rows.select("text", "y").mapInArrow(run_words, "w string, y int").groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("good")).where(F.col("n") >= min_docs)
    z = F.abs(F.col("good") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    vocab = {r[0].encode(): i for i, r in enumerate(counted.withColumn("z", z).where(F.col("z") >= min_z).orderBy(F.desc("z"), "w").limit(max_words).collect())}
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run_features(batches):
        known = sent.value
        for b in batches:
            style, words, meta = [], [], []
            for text, lang, source, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                s, kinds = style_of(text)
                style.append(s)
                words.append(sorted(known[w] for w in kinds if w in known))
                meta.append(meta_of(lang, source, n))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(style, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.int32()))], names=["doc_id", "style", "words", "meta"])

    # One row a doc_id; the texts themselves don't move.
    feats = d.mapInArrow(run_features, FEATURES).groupBy("doc_id").agg(F.min(F.struct("style", "words", "meta")).alias("f")).select("doc_id", "f.*")
    feats = stored(feats.join(lab.select("doc_id", F.lit(True).alias("given")).hint("shuffle_hash"), "doc_id", "left"), "cotrain-features")
    # Sums of decimals don't hang on the order of tasks.
    sums = [F.sum(x.cast("decimal(28,9)")) for i in range(len(STYLE)) for c in [F.col("style")[i]] for x in (c, c * c)]
    total, in_pool, *moments = feats.agg(F.count("*"), F.count_if(F.col("given").isNull()), *sums).first()
    mean, square = (np.array([float(x) / total for x in moments[k::2]]) for k in range(2))
    sd = np.sqrt(np.maximum(square - mean**2, 0)) + 1e-6
    names = ["doc_id", "style", "words", "meta"]
    got = sorted(feats.join(F.broadcast(ids), "doc_id").select(*names, "y").collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    dense = _standard(np.array([r[1] for r in got]), mean, sd)
    surest = _surest(feats.where("given is null").select(*names), mean, sd)
    model = co_train([r[2] for r in got], dense, [r[3] for r in got], np.array([r[4] for r in got]), len(vocab), in_pool, surest, rounds, per_round)
    return model | {"vocab": vocab, "mean": mean, "sd": sd}


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """docs → doc_id, p_text, p_meta (calibrated views), p_good (combined), good."""
    d = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, p_text double, p_meta double, p_good double, good boolean"
    if "constant" in model:
        p = F.lit(model["constant"])
        return d.select("doc_id", p.alias("p_text"), p.alias("p_meta"), p.alias("p_good"), (p >= threshold).alias("good"))
    flat = {w: float(model["text"].w[i]) for w, i in model["vocab"].items()}
    sent = docs.sparkSession.sparkContext.broadcast((flat, model["text"].v, model["text"].b, model["meta"].w, model["meta"].b, model["calib"], model["top"], model["mean"], model["sd"]))

    def run(batches):
        weights, v, b0, mw, mb, calib, top, mean, sd = sent.value
        for b in batches:
            zt, zm = [], []
            for text, lang, source, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                s, kinds = style_of(text)
                # Sorted: sums of floats must not hang on a set's order.
                zt.append(sum(sorted(weights[w] for w in kinds if w in weights)) + float(np.clip((np.array(s) - mean) / sd, -5, 5) @ v) + b0)
                zm.append(float(mw[meta_of(lang, source, n)].sum()) + mb)
            a = np.array(zt) * calib[0][0] + calib[0][1]
            c = np.array(zm) * calib[1][0] + calib[1][1]
            z = top[0] * a + top[1] * c + top[2]
            p = [np.round(1 / (1 + np.exp(-np.clip(x, -30, 30))), 6) for x in (a, c, z)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= threshold)], names=["doc_id", "p_text", "p_meta", "p_good", "good"])

    return d.mapInArrow(run, schema)


def op3_cotrain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
