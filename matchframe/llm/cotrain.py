"""Quality classifier by co-training of two views.

The text view is a logistic regression over hashed words of the content; the page view one over the page's metadata
(language, source, length) and layout (lines, capitals, digits, signs, repeated words). Both are fitted on a bounded
sample of labelled documents. The text view uses the features whose frequency differs between the classes of that sample,
which Spark counts before anything is gathered. In each of a few rounds both views then score all documents without a
label. Those that one view is sure of, and the other does not deny, are pseudo-labelled for the other view: the gradient
and the curvature of their loss at the other view's present weights are summed feature by feature in Spark, both classes
weighing alike, and the other view is fitted again on its labelled documents and this expansion. So the exchange covers
every document, and the driver holds the labelled sample and a few numbers per feature.

On labelled documents set aside, each view's logit is calibrated.
The score is the product of the two probabilities, calibrated together, as one bad view is enough to make a document bad: bad words
show in the text view alone, junk mostly in the page view. All documents are scored in one pass.

A document counts as good if its label says quality 1 and toxic 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchframe.llm.store import stored
from matchframe.llm.text import bytes_of, mix, pieces, release, words

#: Most labelled documents that are fitted on (smallest hashes of doc_id), and hashed features of the text view.
LABELLED, BUCKETS = 12000, 1 << 17
#: Rounds of exchange, the least sureness to hand a document over, the least chance the other view must give the label,
#: and the weight of all pseudo-labelled documents against the labelled ones.
ROUNDS, SURE, ALLOWED, SHARE = 3, 0.95, 0.1, 0.5
#: Standard errors by which a hashed feature's frequency must differ between the classes to have a weight.
SIGNIFICANT = 4.0
#: Share of the labelled sample that is set aside for calibration.
ASIDE = 0.25
#: Bytes of the beginnings of words that the text view counts besides whole words.
STEMS = (4, 5)
#: A document is kept from this score on.
KEEP = 0.5
PAGE_BUCKETS = 1 << 10
_LAYOUT = 12


@dataclass
class Rows:
    """Sparse rows: feature i of row r for each pair; ``dense`` has further columns."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    dense: np.ndarray

    def take(self, keep: np.ndarray) -> Rows:
        place = np.full(len(self.dense), -1)
        place[keep] = np.arange(len(keep))
        own = place[self.row] >= 0
        return Rows(place[self.row[own]], self.feature[own], self.value[own], self.dense[keep])


@dataclass
class Linear:
    weights: np.ndarray
    dense: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: Rows) -> np.ndarray:
        return np.bincount(x.row, self.weights[x.feature] * x.value, minlength=len(x.dense)) + x.dense @ self.dense + self.bias

    def calibrated(self, x: Rows) -> np.ndarray:
        return self.slope * self.logit(x) + self.shift


@dataclass
class Pull:
    """Expansion of the pseudo-labelled documents' loss about the weights ``at`` (features, dense columns, bias)."""

    at: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray


@dataclass
class Model:
    text: Linear
    page: Linear

    def scores(self, text: Rows, page: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.calibrated(text), self.page.calibrated(page)
        return _sigmoid(a) * _sigmoid(b), _sigmoid(a), _sigmoid(b)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def text_rows(column: pa.Array, known: np.ndarray | None = None) -> Rows:
    """Distinct words, and beginnings of longer words, of every text, weighted 1 + ln(count); with ``known`` those features only."""
    rows, h, start, end = words(column)
    data, _ = bytes_of(column)
    begins = []
    for size in STEMS:
        at = np.flatnonzero(end - start > size)
        code = np.full(len(at), size, np.uint64)
        for k in range(size):
            byte = data[start[at] + k]
            byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
            code = code << np.uint64(8) | byte.astype(np.uint64)
        begins.append((rows[at], mix(code)))
    rows, h = (np.concatenate([own, *(b[i] for b in begins)]) for i, own in enumerate((rows, h)))
    feature = (h % np.uint64(BUCKETS)).astype(np.int64)
    if known is not None:
        own = known[feature]
        rows, feature = rows[own], feature[own]
    pairs, count = np.unique(rows * BUCKETS + feature, return_counts=True)
    return Rows(pairs // BUCKETS, pairs % BUCKETS, 1 + np.log(count), np.zeros((len(column), 0)))


def page_rows(column: pa.Array, lang: list, source: list) -> Rows:
    """One feature for the language, one for the source, and the layout's measures in the dense columns."""
    n = len(column)
    data, offsets = bytes_of(column)
    rows, h, start, end = words(column)
    size = np.maximum(np.diff(offsets), 1)
    kinds = np.zeros(256, np.int8)
    kinds[65:91], kinds[48:58], kinds[10] = 1, 2, 3
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
    kind = kinds[data]
    share = lambda k: np.diff(np.concatenate([[0], np.cumsum(kind == k)])[offsets]) / size
    count = np.bincount(rows, minlength=n)
    many = np.maximum(count, 1)
    _, first = np.unique(mix(h + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    distinct = np.bincount(rows[first], minlength=n)
    again = np.zeros(n)
    if len(rows):
        same = (rows[1:] == rows[:-1]) & (h[1:] == h[:-1])
        again = np.bincount(rows[1:][same], minlength=n) / many
    ends = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    sign_end = np.bincount(rows, np.isin(ends, np.frombuffer(b"*#$%&!|", np.uint8)), minlength=n) / many
    alone = np.bincount(rows, (end - start == 1) & (ends == ord("|")), minlength=n) / many
    length = np.bincount(rows, end - start, minlength=n) / many
    dense = np.stack([
        np.log1p(size) / 10, np.log1p(count) / 8, share(1) * 3, share(2) * 3, share(3) * 10, share(4) * 3, distinct / many, again * 2,
        sign_end * 2, alone * 4, length / 10, (count == 0).astype(float),
    ], axis=1)
    code = lambda kind, values: [int(mix(np.array([abs(hash_of(f"{kind}:{v}"))], np.uint64))[0] % np.uint64(PAGE_BUCKETS)) for v in values]
    feature = np.array(code("lang", lang) + code("source", source), np.int64)
    return Rows(np.tile(np.arange(n), 2), feature, np.ones(2 * n), dense)


def hash_of(s: str) -> int:
    """A hash that is the same in all processes."""
    out = 1469598103934665603
    for c in s.encode():
        out = ((out ^ c) * 1099511628211) & 0x7FFFFFFFFFFFFFFF
    return out


def fit(x: Rows, y: np.ndarray, buckets: int, against: bool = False, steps: int = 120, penalty: float = 1e-4, pull: Pull | None = None) -> Linear:
    """Logistic regression with both classes weighted alike, by Adam over all rows; ``pull`` adds the loss of others.

    Only features whose frequency differs between the classes by more than chance count; with ``against`` only those that
    are more frequent in class 0, so that plain words cannot outweigh bad ones.
    """
    n, dense = len(y), x.dense.shape[1]
    if not n or y.min() == y.max():
        return Linear(np.zeros(buckets), np.zeros(dense), 6.0 if not n or y[0] else -6.0)
    of = [np.bincount(x.feature[y[x.row] == c], minlength=buckets) for c in (0, 1)]
    total = [max(1, int((y == c).sum())) for c in (0, 1)]
    rate = (of[0] + of[1] + 1) / (n + 2)
    z = (of[1] / total[1] - of[0] / total[0]) / np.sqrt(rate * (1 - rate) * (1 / total[0] + 1 / total[1]))
    own = (-z if against else np.abs(z)) >= SIGNIFICANT
    free = np.concatenate([own, np.ones(dense + 1, bool)])
    kept = own[x.feature]
    x = Rows(x.row[kept], x.feature[kept], x.value[kept], x.dense)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    model = np.zeros(buckets + dense + 1)
    first, second = np.zeros_like(model), np.zeros_like(model)
    for t in range(1, steps + 1):
        z = np.bincount(x.row, model[x.feature] * x.value, minlength=n) + x.dense @ model[buckets:-1] + model[-1]
        g = (_sigmoid(z) - y) * weight
        grad = np.concatenate([np.bincount(x.feature, g[x.row] * x.value, minlength=buckets), x.dense.T @ g, [g.sum()]])
        grad[:-1] += penalty * model[:-1]
        if pull is not None:
            grad[free] += SHARE * (pull.gradient + pull.curvature * (model - pull.at))[free]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        model -= 0.3 / np.sqrt(t / 10 + 1) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Linear(model[:buckets], model[buckets:-1], float(model[-1]))


def _calibration(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one logit, by Newton steps; 1 and 0 where ``y`` has one class only."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    x = np.column_stack([logit, np.ones(len(y))])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x = x / scale
    w = np.zeros(2)
    for _ in range(25):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 1e-2 * w)
    slope, shift = w / scale
    return float(slope), float(shift)


def _calibrated_together(logits: list[np.ndarray], y: np.ndarray, steps: int = 500) -> list[tuple[float, float]]:
    """Slope and shift of each view, under which the product of the views' probabilities fits ``y`` best.

    Each view alone is calibrated first; Adam steps on the product's log-loss follow, so that a view is not charged for
    documents that only the other view can tell. Both classes weigh alike.
    """
    alone = [_calibration(z, y) for z in logits]
    if not len(y) or y.min() == y.max():
        return alone
    scale = [max(float(np.abs(z).max()), 1e-9) for z in logits]
    x = [z / c for z, c in zip(logits, scale, strict=True)]
    w = np.array([v for (slope, shift), c in zip(alone, scale, strict=True) for v in (slope * c, shift)])
    first, second = np.zeros(4), np.zeros(4)
    for t in range(1, steps + 1):
        p = [_sigmoid(w[2 * i] * x[i] + w[2 * i + 1]) for i in (0, 1)]
        both = np.minimum(p[0] * p[1], 1 - 1e-9)
        g = np.where(y == 1, -0.5 / y.mean(), 0.5 / (1 - y.mean()) * both / (1 - both)) / len(y)
        grad = np.array([v for i in (0, 1) for v in ((g * (1 - p[i])) @ x[i], (g * (1 - p[i])).sum())]) + 1e-4 * w
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return [(float(w[2 * i] / scale[i]), float(w[2 * i + 1])) for i in (0, 1)]


def weights_of(m: Linear) -> np.ndarray:
    return np.concatenate([m.weights, m.dense, [m.bias]])


def handed_over(models: list[Linear], views: tuple[Rows, Rows]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view the documents that the other one labels for it, and these labels."""
    chance = [_sigmoid(m.logit(v)) for m, v in zip(models, views, strict=True)]
    out = []
    for own, other in ((0, 1), (1, 0)):
        good = chance[other] > 0.5
        sure = np.maximum(chance[other], 1 - chance[other]) >= SURE
        fits = np.where(good, chance[own], 1 - chance[own]) > ALLOWED  # not where this view is sure of the opposite
        rows = np.flatnonzero(sure & fits)
        out.append((rows, good[rows].astype(float)))
    return out


def loss_sums(model: Linear, x: Rows, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(class, places, gradient, curvature) of the loss of the rows of each class; the last place counts them.

    Curvature is the greatest a logistic loss can have, a quarter of the squared value.
    """
    buckets = len(model.weights)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        if not len(own):
            continue
        part = x.take(own)
        g = _sigmoid(part.dense @ model.dense + np.bincount(part.row, model.weights[part.feature] * part.value, minlength=len(own)) + model.bias) - c
        used, place = np.unique(part.feature, return_inverse=True)
        first = [np.bincount(place, g[part.row] * part.value, minlength=len(used)), part.dense.T @ g, [g.sum()], [len(own)]]
        second = [np.bincount(place, part.value**2, minlength=len(used)) / 4, (part.dense**2).sum(axis=0) / 4, [len(own) / 4], [len(own)]]
        yield c, np.concatenate([used, buckets + np.arange(part.dense.shape[1] + 2)]), np.concatenate(first), np.concatenate(second)


def pull_of(model: Linear, sums: list[tuple[int, int, float, float]]) -> Pull | None:
    """From (class, place, gradient, curvature) summed over all documents; each class has half the weight."""
    at = weights_of(model)
    total = np.zeros((2, 2, len(at) + 1))
    for c, place, g, d in sums:
        total[c, :, place] = g, d
    if not total[:, 0, -1].any():
        return None
    total = sum(t[:, :-1] * (0.5 / t[0, -1]) for t in total if t[0, -1])
    return Pull(at, total[0], total[1])


def _calibrate(models: list[Linear], views: tuple[Rows, Rows], label: np.ndarray, aside: np.ndarray) -> Model:
    check = np.flatnonzero(aside & (label >= 0))
    y = label[check].astype(float)
    logits = [m.logit(v.take(check)) for m, v in zip(models, views, strict=True)]
    for m, (slope, shift) in zip(models, _calibrated_together(logits, y), strict=True):
        m.slope, m.shift = slope, shift
    return Model(*models)


def co_train(views: tuple[Rows, Rows], label: np.ndarray, aside: np.ndarray, exchange: Callable[[list[Linear]], list[Pull | None]], rounds: int = ROUNDS) -> Model:
    """Both views fitted in rounds; ``aside`` marks labelled rows that only calibrate. ``exchange`` gives each view what
    the other one hands over at the present models."""
    known = np.flatnonzero((label >= 0) & ~aside)
    y = label[known].astype(float)
    sizes, against = (BUCKETS, PAGE_BUCKETS), (True, False)
    pulls: list[Pull | None] = [None, None]
    for k in range(rounds + 1):
        models = [fit(v.take(known), y, size, against=a, pull=p) for v, size, a, p in zip(views, sizes, against, pulls, strict=True)]
        if k == rounds or not len(known) or y.min() == y.max():
            break
        pulls = exchange(models)
        if pulls == [None, None]:
            break
    return _calibrate(models, views, label, aside)


_COMPACT = "doc_id long, label int, n int, feature binary, value binary, page binary, dense binary"


def _is_aside(doc_id: int) -> bool:
    return hash_of(f"aside:{doc_id}") % 1000 < ASIDE * 1000


def telling(marked: DataFrame) -> np.ndarray:
    """Text features that are more frequent in class 0 than chance allows, counted over the labelled documents not set aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for b in pieces(batches):
            y = np.array([-1 if _is_aside(i) else y for i, y in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)], np.int64)
            x = text_rows(b.column(1))
            for c in (0, 1):
                count[c] += np.bincount(x.feature[y[x.row] == c], minlength=BUCKETS)
                total[c] += int((y == c).sum())
        used = np.flatnonzero(count.any(axis=0))
        cols = [np.append(used, -1), *(np.append(count[c][used], total[c]) for c in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["feature", "n0", "n1"])

    counts = stored(marked.mapInArrow(run, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = counts.where("feature = -1").first()
    if total is None or not total["n0"] or not total["n1"]:
        return np.zeros(0, np.int64)
    n = total["n0"] + total["n1"]
    rate = (F.col("n0") + F.col("n1") + 1) / F.lit(n + 2)
    off = (F.col("n0") / F.lit(total["n0"]) - F.col("n1") / F.lit(total["n1"])) / F.sqrt(rate * (1 - rate) * (1 / total["n0"] + 1 / total["n1"]))
    return np.array(sorted(r[0] for r in counts.where(F.col("feature") >= 0).where(off >= SIGNIFICANT).select("feature").collect()), np.int64)


def _opened(rows: list[dict] | pa.RecordBatch) -> tuple[Rows, Rows]:
    """Both views of compact rows."""
    columns = rows.to_pydict() if isinstance(rows, pa.RecordBatch) else {k: [r[k] for r in rows] for k in ("n", "feature", "value", "page", "dense")}
    size = np.array(columns["n"], np.int64)
    glue = lambda name, dtype: np.frombuffer(b"".join(columns[name]), dtype)
    text = Rows(np.repeat(np.arange(len(size)), size), glue("feature", np.int32).astype(np.int64), glue("value", np.float32).astype(float), np.zeros((len(size), 0)))
    page = Rows(np.repeat(np.arange(len(size)), 2), glue("page", np.int32).astype(np.int64), np.ones(2 * len(size)), glue("dense", np.float64).reshape(len(size), _LAYOUT))
    return text, page


def _exchange(compact: DataFrame, models: list[Linear]) -> list[Pull | None]:
    """What each view gets from the other, from all documents without a label."""
    sent = compact.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views = _opened(b)
            for v, (rows, y) in enumerate(handed_over(sent.value, views)):
                for c, place, g, d in loss_sums(sent.value[v], views[v].take(rows), y):
                    cols = [pa.array(np.full(len(place), x), pa.int32()) for x in (v, c)] + [pa.array(place, pa.int32()), pa.array(g, pa.float64()), pa.array(d, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["view", "label", "place", "g", "d"])

    others = compact.where("label = -1").select("n", "feature", "value", "page", "dense")
    sums = others.mapInArrow(run, "view int, label int, place int, g double, d double").groupBy("view", "label", "place").agg(F.sum("g").alias("g"), F.sum("d").alias("d")).collect()
    return [pull_of(m, [(r["label"], r["place"], r["g"], r["d"]) for r in sums if r["view"] == v]) for v, m in enumerate(models)]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """The model fitted on at most ``labelled`` documents with a label, and what the views hand over of all the others.

    Documents whose label is not in the sample are others too.

    A document with several labels is good if they all say so; labels that are null are no labels. Without labels of both
    kinds all documents get the same side; without any label, or any document that has one, all are good. Of several
    rows with one labelled id one is fitted on.
    """
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).cast("int")
    by = F.xxhash64("doc_id", F.lit(6))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("label"))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]]
    base = docs.select(*columns)
    # the sample is of bounded size, so it goes to the documents and no text is shuffled
    chosen = stored(marks.orderBy(by, "doc_id").limit(labelled))
    used = telling(base.join(F.broadcast(chosen), "doc_id"))
    all_ = base.join(F.broadcast(chosen).withColumnRenamed("doc_id", "own_id"), F.col("doc_id") == F.col("own_id"), "left").drop("own_id")
    compact = stored(all_.withColumn("label", F.coalesce("label", F.lit(-1))).mapInArrow(_features(used), _COMPACT))
    parts = F.struct("label", "n", "feature", "value", "page", "dense")
    found = compact.where("label >= 0").groupBy("doc_id").agg(F.min(parts).alias("r")).orderBy("doc_id").collect()
    views = _opened([r["r"].asDict() for r in found])
    label = np.array([r["r"]["label"] for r in found], int)
    aside = np.array([_is_aside(r["doc_id"]) for r in found], bool)
    return co_train(views, label, aside, lambda models: _exchange(compact, models), rounds)


def _features(used: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Both views of every document, the text view with the features ``used`` only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(BUCKETS, bool)
        known[used] = True
        for b in pieces(batches):
            n = b.num_rows
            text = text_rows(b.column(1), known)
            page = page_rows(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist())
            lens = np.bincount(text.row, minlength=n)
            edge = np.concatenate([[0], np.cumsum(lens)])
            cut = lambda a: [a[edge[i] : edge[i + 1]].tobytes() for i in range(n)]
            pages = page.feature.reshape(2, n).T.astype(np.int32)
            cols = [b.column(0), b.column(4), pa.array(lens, pa.int32()), *(pa.array(c, pa.binary()) for c in (cut(text.feature.astype(np.int32)), cut(text.value.astype(np.float32)), [p.tobytes() for p in pages], [d.tobytes() for d in page.dense]))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "n", "feature", "value", "page", "dense"])
        release()

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, text_score, page_score (columns of these names are replaced); one row per input row.

    Null and empty texts are scored as texts without words; a null or missing language or source is a value of its own.
    """
    new = ["score", "text_score", "page_score"]
    docs = docs.select(*[c for c in docs.columns if c not in new])
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields])
    for c in new:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            column = b.column(names.index(text))
            meta = [b.column(names.index(c)).cast(pa.string()).to_pylist() if c in names else [None] * b.num_rows for c in ("lang", "source")]
            found = sent.value.scores(text_rows(column, sent.value.text.weights != 0), page_rows(column, *meta))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in found)], names=schema.names)
        release()

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, text_score, page_score, kept) for every document row; ``kept`` from a score of ``keep`` on."""
    model = train(docs, labels, labelled)
    columns = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    scored = score(docs.select(*columns), model)
    return scored.select("doc_id", "score", "text_score", "page_score", (F.col("score") >= keep).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    scored = score(docs, train(docs, labels, labelled))
    return scored.where(F.col("score") >= keep).select(*docs.columns)
