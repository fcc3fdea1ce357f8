"""Classification of funds by allocation: clustering or a rule, names, confidence, stability.

The model is small (at most 16 centroids of at most 54 features), so it lives on the driver
as JSON and is applied to funds as an expression; only fitting and the silhouette read data.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terazi.config import ClassificationConfig
from terazi.metadata import ROWS
from terazi.operators.allocation import axes, drift, last_days, mean_codes, mean_vectors, quality_days, slices, support_weights
from terazi.session import shuffle_partitions

# Family of each broad group.
FAMILIES = {
    "Equity": "Equity", "Foreign Equity": "Equity", "Fixed Income": "Fixed Income", "Lease Certificates": "Fixed Income", "Money Market": "Money Market", "Money Market / Collateral": "Money Market",
    "Deposit": "Money Market", "Participation Account": "Money Market", "Precious Metals": "Precious Metals", "Fund": "Fund of Funds", "ETF": "Fund of Funds", "Foreign ETF": "Fund of Funds",
    "Real Estate / Alternative": "Alternative", "Venture Capital / Alternative": "Alternative", "Foreign Securities": "Alternative", "Derivatives": "Alternative", "Other": "Other",
}
VERSION = 1
#: Funds that the silhouette compares with all others at once; funds that a task treats at once.
BLOCK, CHUNK = 2048, 512
#: Steps of K-means at most; a start ends when no centre moves by more.
STEPS, TOLERANCE = 300, 1e-4


def family(group: str) -> str:
    """Family of a broad group, asset group or code."""
    if group in FAMILIES:
        return FAMILIES[group]
    return next((FAMILIES[r[3]] for r in ROWS if group in (r[0], r[2])), "Other")


def ranked(centroid: list[float], features: list[str]) -> list[tuple[str, float]]:
    """Features with a positive weight, heaviest first; equals in feature order."""
    return sorted(((f, w) for f, w in zip(features, centroid, strict=True) if w > 0), key=lambda x: -x[1])


def name_of(centroid: list[float], features: list[str], config: ClassificationConfig) -> tuple[str, str]:
    """Name and family: Weighted from the dominant threshold, Tilted from the primary one, else Multi-Asset."""
    r = ranked(centroid, features)
    if not r:
        return "Unclassified", "Other"
    (top, w), second = r[0], r[1][0] if len(r) > 1 else r[0][0]
    if w >= config.dominant_threshold:
        return f"{top} Weighted", family(top)
    if w >= config.primary_threshold:
        return f"{top} Tilted", family(top)
    return f"Multi-Asset ({top} / {second})", "Multi-Asset"


def unique_names(names: list[str], centroids: list[list[float]], features: list[str]) -> list[str]:
    """Repeated names get the group that tells them apart, then a number."""
    often, used, out = Counter(names), set(), []
    for name, c in zip(names, centroids, strict=True):
        new = name
        if often[name] > 1:
            tries = [f"{name} / {g}" for g, _ in ranked(c, features)[1:3]] or [name]
            new = next((t for t in tries if t not in used), tries[-1])
            stem, k = new, 2
            while new in used:
                new, k = f"{stem} #{k}", k + 1
        used.add(new)
        out.append(new)
    return out


def describe(centroid: list[float], features: list[str], top: int = 3) -> str:
    return ", ".join(f"{f} {w:.1f}%" for f, w in ranked(centroid, features)[:top] if w >= 0.5)


@dataclass(frozen=True)
class Model:
    """Centroids with their names; ``method`` is kmeans or rule."""

    features: list[str]
    centroids: list[list[float]]
    names: list[str]
    families: list[str]
    method: str
    silhouette: float | None = None

    def to_json(self) -> str:
        return json.dumps({"version": VERSION} | asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        if d.pop("version", None) != VERSION:
            raise ValueError("unknown model version")
        return Model(**d)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @staticmethod
    def load(path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            return Model.from_json(f.read())

    def predict(self, vectors: DataFrame) -> DataFrame:
        """class_id, class_name, family, distance, confidence of each row with a ``vector`` in feature order."""
        n = len(self.centroids)

        def distance(c: list[float]) -> Column:
            centre = F.array(*(F.lit(float(x)) for x in c))
            return F.sqrt(F.aggregate(F.zip_with("vector", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

        near = F.array_sort(F.array(*(F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centroids))))
        out = vectors.withColumn("near", near).withColumns({"class_id": F.col("near")[0]["i"], "distance": F.col("near")[0]["d"], "next": F.col("near")[1]["d"] if n > 1 else F.lit(None).cast("double")})
        lookup = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), F.col("class_id") + 1)
        sure = F.lit(1.0) if n == 1 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("next") > 0, 1 - F.col("distance") / F.col("next")).otherwise(0.0)))
        return out.withColumns({"confidence": sure, "class_name": lookup(self.names), "family": lookup(self.families)}).drop("near", "next")


def wide(long: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys and ``vector``, an array in feature order, 0 where a feature is missing."""
    v = long.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("feature") == f, F.col("value"))), F.lit(0.0)).alias(f"v{i}") for i, f in enumerate(features)))
    return v.select(*keys, F.array(*(F.col(f"v{i}") for i in range(len(features)))).alias("vector"))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``y``, by differences: 0 for equal rows."""
    out = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        d = x[:, f, None] - y[None, :, f]
        out += d * d
    return out


def _members(label: np.ndarray, n: int) -> np.ndarray:
    return (label[:, None] == np.arange(n)[None, :]).astype(np.float64)


def _reduced(data: DataFrame, f: Callable, given: object, merge: Callable = np.add) -> np.ndarray:
    """``f(vectors, other columns, given)`` of all rows by ``CHUNK``, an array of doubles, merged in each task and then in a tree."""
    sent = data.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                rest = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
                for k in range(0, len(x), CHUNK):
                    part = f(x[k : k + CHUNK], [c[k : k + CHUNK] for c in rest], sent.value)
                    total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    try:
        return data.mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r["part"])).treeReduce(merge)
    finally:
        sent.unpersist()


def _sums(x: np.ndarray, rest: list, given: tuple) -> np.ndarray:
    """Per fund of the block: sums of the distances to ``x`` by class, per column of classes; then the classes' sizes."""
    block, sizes = given
    d = np.sqrt(_squares(x, block))
    where = np.concatenate([_members(label, n) for label, n in zip(rest, sizes, strict=True)], axis=1)
    return np.concatenate([(d.T @ where).ravel(), where.sum(axis=0)])


def silhouettes(labelled: DataFrame, classes: list[str]) -> list[float]:
    """Mean Euclidean silhouette over all rows with fund_code and vector, for each column of ``classes`` (0, 1, ...); exact.

    Blocks of about ``BLOCK`` funds come to the driver, one at a time, and meet all funds in the tasks,
    which return sums of distances per class. A fund alone in its class scores 0, as does a single class.
    """
    rows = labelled.select("vector", *(F.col(c).cast("long").alias(c) for c in classes), "fund_code").cache()
    try:
        top = rows.agg(F.count("*").alias("rows"), *(F.max(c).alias(f"c{i}") for i, c in enumerate(classes))).first()
        if not top["rows"]:
            return [0.0] * len(classes)
        sizes = [top[f"c{i}"] + 1 for i in range(len(classes))]
        blocks, totals = -(-top["rows"] // BLOCK), np.zeros(len(classes))
        for k in range(blocks):
            own = rows.filter(F.pmod(F.xxhash64("fund_code"), F.lit(blocks)) == k).drop("fund_code").collect()
            if not own:
                continue
            out = _reduced(rows.drop("fund_code"), _sums, (np.array([r["vector"] for r in own]), sizes))
            sums, count = out[: -sum(sizes)].reshape(len(own), -1), out[-sum(sizes) :]
            at = 0
            for c, n in enumerate(sizes):
                mine, size, total = np.array([r[classes[c]] for r in own]), count[at : at + n], sums[:, at : at + n]
                at += n
                if (size > 0).sum() < 2:
                    continue
                i = np.arange(len(own))
                a = total[i, mine] / np.maximum(size[mine] - 1, 1)
                means = np.where(size > 0, total / np.maximum(size, 1), np.inf)
                means[i, mine] = np.inf
                b = means.min(axis=1)
                totals[c] += np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()
        return [float(t) / top["rows"] for t in totals]
    finally:
        rows.unpersist()


def silhouette(labelled: DataFrame) -> float:
    """Mean Euclidean silhouette of rows with fund_code, vector, class_id; exact, over all funds."""
    return silhouettes(labelled, ["class_id"])[0]


def _keys(ids: np.ndarray, start: int, step: int) -> np.ndarray:
    """Exponential variates of fund hashes, the same wherever a fund is read."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64) + np.uint64(start) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) * np.uint64(0xC2B2AE3D27D4EB4F)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return -np.log(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54)


def _draw(x: np.ndarray, rest: list, given: tuple) -> np.ndarray:
    """Per start: the least key over squared distance to the centres so far, and that fund's vector (k-means++)."""
    starts, step, centres = given
    out = np.full((len(starts), 1 + x.shape[1]), np.inf)
    for i, (start, c) in enumerate(zip(starts, centres, strict=True)):
        d = _squares(x, c).min(axis=1) if step else np.ones(len(x))
        key = np.where(d > 0, _keys(rest[0], start, step) / np.where(d > 0, d, 1.0), np.inf)
        at = int(key.argmin())
        if np.isfinite(key[at]):
            out[i] = key[at], *x[at]
    return out.ravel()


def _lesser(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    a, b = a.reshape(-1, width), b.reshape(-1, width)
    return np.where(a[:, :1] <= b[:, :1], a, b).ravel()


def _moved(x: np.ndarray, rest: list, centres: list[np.ndarray]) -> np.ndarray:
    """Per set of centres: sums and counts of the nearest funds, then the sum of squared distances."""
    near = 2 * x @ np.concatenate(centres).T
    square, ones, out, at = (x * x).sum(axis=1), np.concatenate([x, np.ones((len(x), 1))], axis=1), [], 0
    for c in centres:
        d = (c * c).sum(axis=1)[None, :] - near[:, at : at + len(c)]
        label = d.argmin(axis=1)
        out += [(_members(label, len(c)).T @ ones).ravel(), [np.maximum(square + d[np.arange(len(x)), label], 0).sum()]]
        at += len(c)
    return np.concatenate(out)


def clusterings(data: DataFrame, ks: list[int], config: ClassificationConfig) -> dict[int, tuple[float, np.ndarray]]:
    """Training cost and centres of the best of ``n_init`` starts, for each k; data: vector, id (a hash of the fund).

    All starts of all k advance together, one pass over the data a step. A start is a k-means++ draw; the draw
    of a smaller k is the beginning of that of a larger one. Lloyd's steps follow until no centre moves by
    more than ``TOLERANCE``, at most ``STEPS``; a centre without funds stays where it is.
    """
    width = len(data.first()["vector"])
    starts = [config.random_state + s for s in range(config.n_init)]
    drawn = [np.zeros((0, width)) for _ in starts]
    for step in range(max(ks)):
        new = _reduced(data, _draw, (starts, step, drawn), partial(_lesser, width=width + 1)).reshape(len(starts), -1)
        drawn = [np.concatenate([c, n[None, 1:]]) if np.isfinite(n[0]) else c for c, n in zip(drawn, new, strict=True)]
    live = {(k, s): c[:k] for k in ks for s, c in enumerate(drawn)}
    done: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
    for step in range(STEPS):
        out, at = _reduced(data, _moved, list(live.values())), 0
        for key, c in list(live.items()):
            n = len(c) * (width + 1)
            sums, cost = out[at : at + n].reshape(len(c), -1), float(out[at + n])
            at += n + 1
            count = sums[:, width:]
            live[key] = np.where(count > 0, sums[:, :width] / np.maximum(count, 1), c)
            if ((live[key] - c) ** 2).sum(axis=1).max() <= TOLERANCE**2 or step == STEPS - 1:
                done[key] = cost, live.pop(key)
        if not live:
            break
    return {k: min((done[k, s] for s in range(len(starts))), key=lambda x: x[0]) for k in ks}


def _labelled(data: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """vector, fund_code and the nearest of the centres, a column for each set of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                labels = [pa.array(_squares(x, c).argmin(axis=1), pa.int64()) for c in centres.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *labels], ["vector", "fund_code", *centres])

    return data.mapInArrow(run, "vector array<double>, fund_code string, " + ", ".join(f"{c} long" for c in centres))


def candidates(kept: DataFrame, n: int, config: ClassificationConfig) -> list[tuple[int, float, list]]:
    """k, silhouette and centres of the given k, or of each k of the range that is less than the funds."""
    ks = [config.k] if config.k else list(range(config.k_range[0], min(config.k_range[1], n - 1) + 1))
    if not ks:
        return []
    parts = min(-(-n // CHUNK) + 3, shuffle_partitions(kept.sparkSession))
    data = kept.select("vector", F.xxhash64("fund_code").alias("id"), "fund_code").repartition(parts).cache()
    try:
        best = clusterings(data.select("vector", "id"), ks, config)
        centres = [[list(map(float, c)) for c in best[k][1]] for k in ks]
        labelled = _labelled(data.select("vector", "fund_code"), {f"k{k}": best[k][1] for k in ks})
        scores = silhouettes(labelled, [f"k{k}" for k in ks])
        return [(k, score, c) for k, score, c in zip(ks, scores, centres, strict=True) if len(c) > 1]
    finally:
        data.unpersist()


def classifiable(vectors: DataFrame) -> DataFrame:
    """Funds with a weight."""
    return vectors.filter(F.aggregate(F.transform("vector", lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x) > 0)


def fit(vectors: DataFrame, features: list[str], config: ClassificationConfig = ClassificationConfig()) -> Model:
    """KMeans with the number of classes of the best silhouette; a rule on each fund's own weights for small universes."""
    kept = classifiable(vectors).cache()
    try:
        n = kept.count()
        tried = candidates(kept, n, config) if n >= config.min_funds_for_model else []
        if not tried:
            return rule_model(kept, features, config)
        _, score, centres = max(tried, key=lambda x: x[1])  # the first of equals
        return named(features, centres, "kmeans", config, score)
    finally:
        kept.unpersist()


def named(features: list[str], centroids: list[list[float]], method: str, config: ClassificationConfig, score: float | None = None) -> Model:
    shown = centroids
    if config.transform == "hellinger":  # back to weights before the thresholds
        shown = [[x * x * 100 / max(sum(y * y for y in c), 1e-12) for x in c] for c in centroids]
    names = [name_of(c, features, config) for c in shown]
    return Model(features, centroids, unique_names([a for a, _ in names], shown, features), [b for _, b in names], method, score)


def rule_label(features: list[str], config: ClassificationConfig = ClassificationConfig()) -> Column:
    """The name a fund's own vector gets."""
    r = F.array_sort(F.transform(F.filter(F.arrays_zip("vector", F.array(*(F.lit(i) for i in range(len(features)))).alias("i")), lambda x: x["vector"] > 0), lambda x: F.struct((-x["vector"]).alias("w"), x["i"].alias("i"))))
    names = F.array(*(F.lit(f) for f in features))
    one, two = F.try_element_at(r, F.lit(1)), F.coalesce(F.try_element_at(r, F.lit(2)), F.try_element_at(r, F.lit(1)))
    at = lambda s: F.element_at(names, s["i"] + 1)
    return (
        F.when(F.size(r) == 0, "Unclassified").when(-one["w"] >= config.dominant_threshold, F.concat(at(one), F.lit(" Weighted"))).when(-one["w"] >= config.primary_threshold, F.concat(at(one), F.lit(" Tilted")))
        .otherwise(F.concat(F.lit("Multi-Asset ("), at(one), F.lit(" / "), at(two), F.lit(")")))
    )


def rule_model(vectors: DataFrame, features: list[str], config: ClassificationConfig = ClassificationConfig()) -> Model:
    """One class per rule label, its centroid the mean vector."""
    means = vectors.withColumn("label", rule_label(features, config)).groupBy("label").agg(*(F.avg(F.col("vector")[i]).alias(f"v{i}") for i in range(len(features)))).orderBy("label").collect()
    if not means:
        return Model(features, [[0.0] * len(features)], ["Unclassified"], ["Other"], "rule")
    centroids = [[float(r[f"v{i}"]) for i in range(len(features))] for r in means]
    return Model(features, centroids, [r["label"] for r in means], [name_of(c, features, config)[1] for c in centroids], "rule")


def modal_share(classes: DataFrame) -> DataFrame:
    """fund_code, class_stability: share of a fund's slices that fall in its most frequent class."""
    n = classes.groupBy("fund_code", "class_id").agg(F.count("*").alias("n"))
    return n.groupBy("fund_code").agg((F.max("n") / F.sum("n")).alias("class_stability"))


def features_of(config: ClassificationConfig) -> list[str]:
    at = {"broad": 3, "detailed": 2, "raw": 0}[config.feature_space]
    return sorted({r[at] for r in ROWS})


def classify(allocation: DataFrame, n: int | None = None, config: ClassificationConfig = ClassificationConfig(), model: Model | None = None) -> tuple[Model, DataFrame]:
    """Model and one row per fund: class, family, confidence (less what can't be seen through), stability, drift, axes."""
    rows = last_days(quality_days(allocation, config), n)
    features = features_of(config)
    vectors = wide(mean_vectors(rows, ["fund_code"], config), features, ["fund_code"])
    model = model or fit(vectors, features, config)
    support = axes(support_weights(mean_codes(rows), config), config)
    out = model.predict(vectors).drop("vector").join(support, "fund_code", "left")
    if config.lookthrough_penalty:
        out = out.withColumn("confidence", F.col("confidence") * (100 - F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("lookthrough_weight", F.lit(0.0))))) / 100)
    part = mean_vectors(slices(rows, config.sub_window_count), ["fund_code", "slice"], config)
    stable = modal_share(model.predict(wide(part, features, ["fund_code", "slice"])))
    latest = model.predict(wide(mean_vectors(last_days(quality_days(allocation, config), 1), ["fund_code"], config), features, ["fund_code"])).select("fund_code", F.col("class_id").alias("latest_class"))
    out = out.join(stable, "fund_code", "left").join(drift(part), "fund_code", "left").join(latest, "fund_code", "left")
    return model, out.withColumn("drift_flag", F.coalesce(F.col("latest_class") != F.col("class_id"), F.lit(False))).drop("latest_class")


def class_summary(classified: DataFrame, weight: str | None = None) -> DataFrame:
    """Funds, share, mean confidence and stability per class; unclassified funds are left out before shares are taken."""
    g = classified.filter("class_name is not null").groupBy("class_name").agg(F.count("*").alias("funds"), F.avg("confidence").alias("avg_confidence"), F.avg("class_stability").alias("avg_stability"), *([F.sum(weight).alias("weight")] if weight else []))
    out = g.withColumn("fund_share", F.col("funds") / F.sum("funds").over(Window.partitionBy()))
    return out.orderBy(F.desc("funds"), "class_name")


def class_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Funds in both whose class differs."""
    return before.select("fund_code", F.col("class_name").alias("before")).join(after.select("fund_code", F.col("class_name").alias("after")), "fund_code").filter("before <> after")
