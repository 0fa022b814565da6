"""Support-vector machines for any number of classes, one for each pair of classes, fitted together on Spark.

``PolynomialMap`` turns the kernel (gamma x.y + coef0)^degree into an inner product: a tensor sketch, count sketches of the
factors multiplied in the Fourier domain. ``PairwiseMachines`` fits, for all pairs of classes at once, linear machines
(squared hinge loss, C as usual) on given features. Rows become blocks of numbers once; each step of L-BFGS and of the sigmoid
fits is one sum over the blocks, added up along a tree, so the driver holds a few matrices (pairs x features) and no row. Every
pair has steps of its own, in coordinates in which the rows' second moments are about the same in all directions, so there are
few of them. ``MappedMachines`` keeps the blocks as they are before a map such as the sketch and maps them at each step.
Classes are told by votes, the least class of equals; probabilities by coupling the pairs' probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that are mapped at once.
MAPPED = 256

Map = Callable[[np.ndarray], np.ndarray]


def scale_of(rows: DataFrame, gamma: float) -> tuple[float, int]:
    """(gamma, dimensions) for ``features``: gamma 0 means 1 / (dimensions x variance), a negative one 1 / dimensions."""
    x = vector_to_array("features")
    parts = rows.select(F.size(x).alias("d"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v).alias("q"))
    got = parts.agg(F.max("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("d").alias("n")).first()
    if not got["n"]:
        raise ValueError("nothing to fit on")
    variance = got["q"] / got["n"] - (got["s"] / got["n"]) ** 2
    return (gamma if gamma > 0 else 1 / got["d"] if gamma < 0 else 1 / (got["d"] * variance if variance > 0 else 1.0)), got["d"]


def _mapped(rows: DataFrame, name: str, fn: Map) -> DataFrame:
    """Add a vector column: fn of a matrix of ``features``, a part of an Arrow batch at a time."""
    plain = rows.select(F.struct("*").alias("row"), vector_to_array("features").alias("xs"))
    # vectors don't travel through Arrow batches by themselves, so they go as arrays
    vectors = [f.name for f in rows.schema.fields if f.dataType.typeName() == "vectorudt" or f.dataType.simpleString() == "vector"]
    kept = [vector_to_array(F.col(f"row.{c}")).alias(c) if c in vectors else F.col(f"row.`{c}`").alias(c) for c in rows.columns]
    flat = plain.select(F.struct(*kept).alias("row"), "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MAPPED):
                batch = whole.slice(at, MAPPED)
                z = fn(batch.column("xs").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["row", "xs"])

    out = flat.mapInArrow(run, flat.schema)
    back = [array_to_vector(F.col(f"row.{c}")).alias(c) if c in vectors else F.col(f"row.`{c}`").alias(c) for c in rows.columns if c != name]
    return out.select(*back, array_to_vector("xs").alias(name))


class _Polynomial(Params):
    gamma = Param(Params._dummy(), "gamma", "factor of the inner product", TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "number added to it", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "power", TypeConverters.toInt)
    n = Param(Params._dummy(), "n", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)


class PolynomialMap(Estimator, _Polynomial, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, gamma: float = 0.0, coef0: float = 0.0, degree: int = 3, n: int = 1024, seed: int = 42):
        super().__init__()
        self._set(gamma=gamma, coef0=coef0, degree=degree, n=n, seed=seed)

    def _fit(self, rows: DataFrame) -> PolynomialMapModel:
        gamma, dim = scale_of(rows, self.getOrDefault("gamma"))
        return PolynomialMapModel(gamma, *(self.getOrDefault(p) for p in ("coef0", "degree", "n", "seed")), dim)


class PolynomialMapModel(Model, _Polynomial, DefaultParamsReadable, DefaultParamsWritable):
    dim = Param(Params._dummy(), "dim", "dimensions", TypeConverters.toInt)

    def __init__(self, gamma: float = 1.0, coef0: float = 0.0, degree: int = 3, n: int = 1024, seed: int = 42, dim: int = 1):
        super().__init__()
        self._set(gamma=gamma, coef0=coef0, degree=degree, n=n, seed=seed, dim=dim)

    def sketch(self) -> Map:
        gamma, coef0, degree, n, seed, dim = (self.getOrDefault(p) for p in ("gamma", "coef0", "degree", "n", "seed", "dim"))
        r = np.random.default_rng(seed)
        waves = np.arange(n // 2 + 1) / n
        factors = [r.choice([-1.0, 1.0], dim + 1)[:, None] * np.exp(-2j * np.pi * np.outer(r.integers(0, n, dim + 1), waves)) for _ in range(degree)]
        factors = [f.view("f8") for f in factors]  # real and imaginary parts side by side, as x is real

        def run(x: np.ndarray) -> np.ndarray:
            x = np.concatenate([np.sqrt(gamma) * x, np.full((len(x), 1), np.sqrt(coef0))], axis=1)
            product = (x @ factors[0]).view("c16")
            for f in factors[1:]:
                product *= (x @ f).view("c16")
            return np.fft.irfft(product, n, axis=1)

        return run

    def _transform(self, rows: DataFrame) -> DataFrame:
        return _mapped(rows, "sketch", self.sketch())


# ---- machines ------------------------------------------------------------------------------------------------------------


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k) for b in range(a + 1, k)]


def _sides(k: int) -> np.ndarray:
    """For each class and pair 1 where the class is the pair's first, -1 where it is its second, else 0."""
    out = np.zeros((k, len(_pairs(k))))
    for p, (a, b) in enumerate(_pairs(k)):
        out[a, p], out[b, p] = 1, -1
    return out


def minimise_each(fn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, max_iter: int, tol: float = 1e-3, memory: int = 10, scaled: bool = False) -> np.ndarray:
    """L-BFGS with a backtracking line search for each row of x by itself, all rows moving at once.

    fn(rows, which) gives the values and gradients of those functions whose numbers are ``which``; a row that has come to rest
    isn't asked for again. ``scaled`` says that a whole gradient is a good first step.
    """
    every = np.arange(len(x))
    value, grad = (np.array(v) for v in fn(x, every))
    x, first = x.copy(), np.maximum(1.0, np.abs(grad).max(axis=1))
    d, slope, size = np.zeros_like(x), np.zeros(len(x)), np.ones(len(x))
    halved, taken = np.zeros(len(x), int), np.zeros(len(x), int)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in x]

    def moving(i: int) -> bool:
        """Whether row i goes on; if so, with a new direction."""
        if taken[i] >= max_iter or np.abs(grad[i]).max() <= tol * first[i]:
            return False
        steps, back, way = past[i], [], grad[i].copy()
        for s, y in reversed(steps):
            a = s @ way / (s @ y)
            back.append(a)
            way -= a * y
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1.0 if scaled else 1 / max(1.0, np.linalg.norm(way))
        for (s, y), a in zip(steps, reversed(back)):
            way += (a - y @ way / (s @ y)) * s
        d[i], slope[i], size[i], halved[i] = way, -(grad[i] @ way), 1.0, 0
        return True

    on = np.array([i for i in every if moving(i)], int)
    while len(on):
        tried = x[on] - size[on, None] * d[on]
        values, grads = fn(tried, on)
        left = []
        for i, at, v, g in zip(on, tried, values, grads):
            if v <= value[i] + 1e-4 * size[i] * slope[i]:
                s, y = at - x[i], g - grad[i]
                x[i], value[i], grad[i] = at, v, g
                taken[i] += 1
                if s @ y > 1e-12 * (y @ y):
                    past[i] = [*past[i][-(memory - 1) :], (s, y)]
                left += [i] if moving(i) else []
            elif halved[i] < 29:
                size[i] /= 2
                halved[i] += 1
                left.append(i)
        on = np.array(left, int)
    return x


def minimise(fn: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float = 1e-3, memory: int = 10) -> np.ndarray:
    """L-BFGS for one function; fn gives a value and a gradient."""

    def one(rows: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, grad = fn(rows[0])
        return np.array([value]), np.asarray(grad)[None]

    return minimise_each(one, np.asarray(x, float)[None], max_iter, tol, memory)[0]


#: Numbers (rows times features) that one partition holds at least, if there are so many.
PARTITION = 1 << 19
#: Features of which the second moments are summed and held by the driver, at most.
MOMENTS = 2048


class _Summed:
    """Rows as blocks (class numbers, features); sums of a function over them. ``size`` is how many numbers the rows have: few
    rows in many partitions are put together, as each step of a fit is a task for each partition. ``mapping`` makes a map of
    features, which then is what functions get; what it gives isn't kept, as it may be many times as large as the rows."""

    def __init__(self, rows: DataFrame, features: str, classes: list[float], size: int, mapping: Callable[[], Map] | None = None):
        number = {c: k for k, c in enumerate(classes)}

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("xs")
                    z = x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() :].astype("f8")
                    y = np.array([number[v] for v in batch.column("label").to_pylist()], "i4")
                    order = np.argsort(y, kind="stable")  # the rows of a class are neighbours
                    y, z = y[order], z.reshape(len(y), -1)[order]
                    yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()), pa.array([z.tobytes()], pa.binary())], names=["y", "z"])

        flat = rows.select(F.col("label").cast("double").alias("label"), vector_to_array(features).alias("xs"))
        self.frame = flat.coalesce(max(1, -(-size // PARTITION))).mapInArrow(blocks, "y binary, z binary").persist()
        self.rdd, self.mapping = self.frame.rdd, mapping

    def over(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], among: np.ndarray | None = None) -> np.ndarray:
        """The sum of fn over all rows, or over those of the classes ``among``."""
        mapping = self.mapping

        def part(rows: Iterator) -> Iterator[np.ndarray]:
            total, run = None, mapping and mapping()
            for y, z in rows:
                y, z = _block(y, z)
                if among is not None:
                    some = np.isin(y, among)
                    y, z = y[some], z[some]
                for some, v in _mapped_parts(y, z, run):
                    v = fn(some, v)
                    total = v if total is None else total + v
            if total is not None:
                yield total

        return self.rdd.mapPartitions(part).treeReduce(lambda a, b: a + b)

    def mapped(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> _Summed:
        """The same rows with other numbers in the place of their features, kept until they are closed."""
        out, mapping = copy(self), self.mapping

        def part(rows: Iterator) -> Iterator[tuple[bytes, bytes]]:
            run = mapping and mapping()
            for y, z in rows:
                yield y, b"".join(fn(*some).tobytes() for some in _mapped_parts(*_block(y, z), run))

        out.rdd, out.mapping = self.rdd.mapPartitions(part).persist(StorageLevel.MEMORY_AND_DISK), None
        return out

    def close(self) -> None:
        self.frame.unpersist()


def _block(y: bytes, z: bytes) -> tuple[np.ndarray, np.ndarray]:
    y = np.frombuffer(y, "i4")
    return y, np.frombuffer(z).reshape(len(y), -1)


def _mapped_parts(y: np.ndarray, z: np.ndarray, run: Map | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block as it is, or mapped in parts, so that a task holds few mapped rows."""
    if run is None:
        yield from [(y, z)] if len(y) else []
        return
    for at in range(0, len(y), MAPPED):
        yield y[at : at + MAPPED], run(z[at : at + MAPPED])


class PairwiseMachines(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on ``featuresCol`` and ``label``; null labels are left out."""

    C = Param(Params._dummy(), "C", "weight of the losses", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps at most", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)

    def __init__(self, C: float = 1.0, maxIter: int = 100, featuresCol: str = "features"):  # noqa: N803
        super().__init__()
        self._set(C=C, maxIter=maxIter, featuresCol=featuresCol)

    def _fit(self, rows: DataFrame) -> PairwiseMachinesModel:
        return self.fitted(rows, self.getOrDefault("featuresCol"))

    def fitted(self, rows: DataFrame, column: str, mapping: Callable[[], Map] | None = None) -> PairwiseMachinesModel:
        """The machines on the vectors of a column, or on what a map that ``mapping`` makes gives for them."""
        rows = rows.where("label is not null")
        sizes = {float(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        classes = sorted(sizes)
        if len(classes) < 2:
            raise ValueError("a machine needs two classes at least")
        c = self.getOrDefault("C")
        sides, counts = _sides(len(classes)), np.array([sizes[k] for k in classes], float)
        pairs = sides.shape[1]
        one = rows.select(vector_to_array(column).alias("x")).first()["x"]
        dim = len(one) if mapping is None else mapping()(np.array([one])).shape[1]
        summed = _Summed(rows, column, classes, int(counts.sum()) * dim, mapping)
        try:
            # in these coordinates (rows of v) a machine has about the same curvature in all directions
            turn, widths = np.eye(0), np.ones((pairs, dim + 1))
            if scaled := dim <= min(MOMENTS, counts.sum()):
                spread, turn = np.linalg.eigh(summed.over(lambda y, z: _moments(z)))
                widths = 1 / np.sqrt(1 + 2 * c * np.outer(counts @ np.abs(sides) / counts.sum(), np.maximum(0, spread)))

            def machine(v: np.ndarray, which: np.ndarray) -> np.ndarray:
                return (v * widths[which]) @ turn.T if scaled else v

            def objective(v: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                wb, own_sides = machine(v, which), sides[:, which]
                w, b = wb[:, :-1], wb[:, -1]

                def part(y: np.ndarray, z: np.ndarray) -> np.ndarray:
                    out = np.zeros((len(w), dim + 2))  # loss and gradient
                    for k in np.unique(y):  # only the pairs of a row's own class
                        own, p = z[slice(*np.searchsorted(y, (k, k + 1)))], np.flatnonzero(own_sides[k])
                        short = np.maximum(0, 1 - own_sides[k, p] * (own @ w[p].T + b[p]))
                        d = -2 * c * short * own_sides[k, p]
                        out[p, 0] += c * (short * short).sum(axis=0)
                        out[p, 1:-1] += d.T @ own
                        out[p, -1] += d.sum(axis=0)
                    return out

                got = summed.over(part, np.flatnonzero(own_sides.any(axis=1)))
                grad = got[:, 1:] + np.concatenate([w, np.zeros((len(w), 1))], axis=1)
                return got[:, 0] + 0.5 * (w * w).sum(axis=1), (grad @ turn) * widths[which] if scaled else grad

            every = np.arange(pairs)
            wb = machine(minimise_each(objective, np.zeros((pairs, dim + 1)), self.getOrDefault("maxIter"), 1e-4, scaled=scaled), every)
            w, b = wb[:, :-1], wb[:, -1]
            margins = summed.mapped(lambda y, z: z @ w.T + b)
            try:
                slope, shift = _sigmoids(margins, sides, counts)
            finally:
                margins.rdd.unpersist()
        finally:
            summed.close()
        return PairwiseMachinesModel(classes, w.ravel().tolist(), b.tolist(), slope.tolist(), shift.tolist(), self.getOrDefault("featuresCol"))


class MappedMachines(Estimator):
    """A map of ``features`` and the machines on what it gives, as a pipeline's model."""

    def __init__(self, first: Estimator, machines: PairwiseMachines):
        super().__init__()
        self.first, self.machines = first, machines

    def _fit(self, rows: DataFrame) -> PipelineModel:
        first = self.first.fit(rows)
        return PipelineModel([first, self.machines.fitted(rows, "features", first.sketch)])


def _moments(z: np.ndarray) -> np.ndarray:
    """Sums of products of all features and a one."""
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    return z.T @ z


def _sigmoids(margins: _Summed, sides: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the sigmoid 1 / (1 + exp(slope f + shift)) of its margin f that fits its smoothed targets best."""
    first, second = (counts @ (sides == s) for s in (1, -1))
    high, low = (first + 1) / (first + 2), 1 / (second + 2)
    slope, shift = np.zeros(sides.shape[1]), np.log((second + 1) / (first + 1))
    for _ in range(30):

        def part(y: np.ndarray, f: np.ndarray, slope=slope, shift=shift) -> np.ndarray:
            side = sides[y]
            p = 1 / (1 + np.exp(np.clip(slope * f + shift, -500, 500)))
            on = side != 0
            g = np.where(on, np.where(side == 1, high, low) - p, 0)
            h = np.where(on, p * (1 - p), 0)
            return np.stack([(g * f).sum(0), g.sum(0), (h * f * f).sum(0), (h * f).sum(0), h.sum(0)])

        ga, gb, haa, hab, hbb = margins.over(part)
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab * hab + 1e-300
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        most = np.maximum(1.0, np.maximum(np.abs(da), np.abs(db)) / 5)
        slope, shift = slope - da / most, shift - db / most
        if max(np.abs(da).max(), np.abs(db).max()) < 1e-6:
            break
    return slope, shift


def coupled(r: np.ndarray, k: int) -> np.ndarray:
    """Probabilities of k classes (rows x k) from those of the first class of each pair (rows x pairs): the distribution for
    which the squared differences r_ba p_a - r_ab p_b over all pairs are least."""
    full = np.full((len(r), k, k), 0.5)
    for p, (a, b) in enumerate(_pairs(k)):
        full[:, a, b] = np.clip(r[:, p], 1e-7, 1 - 1e-7)
        full[:, b, a] = 1 - full[:, a, b]
    q = -full * full.transpose(0, 2, 1)
    for a in range(k):
        q[:, a, a] = (full[:, :, a] ** 2).sum(axis=1) - full[:, a, a] ** 2
    system = np.zeros((len(r), k + 1, k + 1))
    system[:, :k, :k], system[:, :k, k], system[:, k, :k] = q, 1, 1
    right = np.zeros((len(r), k + 1, 1))
    right[:, k] = 1
    p = np.maximum(0, np.linalg.solve(system, right)[:, :k, 0])
    return p / p.sum(axis=1, keepdims=True)


class PairwiseMachinesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    classes = Param(Params._dummy(), "classes", "labels in order", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "pairs x features", TypeConverters.toListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "of the pairs", TypeConverters.toListFloat)
    slopes = Param(Params._dummy(), "slopes", "of the pairs' sigmoids", TypeConverters.toListFloat)
    shifts = Param(Params._dummy(), "shifts", "of the pairs' sigmoids", TypeConverters.toListFloat)
    featuresCol = PairwiseMachines.featuresCol

    def __init__(self, classes: list[float] = (), weights: list[float] = (), intercepts: list[float] = (), slopes: list[float] = (), shifts: list[float] = (), featuresCol: str = "features"):  # noqa: N803
        super().__init__()
        self._set(classes=list(classes), weights=list(weights), intercepts=list(intercepts), slopes=list(slopes), shifts=list(shifts), featuresCol=featuresCol)

    def scorer(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """features -> class numbers, probabilities."""
        classes, weights, b, slope, shift = (np.array(self.getOrDefault(p)) for p in ("classes", "weights", "intercepts", "slopes", "shifts"))
        w, k, sides = weights.reshape(len(b), -1), len(classes), _sides(len(classes))

        def run(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            f = z @ w.T + b
            votes = (f >= 0) @ (sides == 1).T.astype(float) + (f < 0) @ (sides == -1).T.astype(float)
            return votes.argmax(axis=1), coupled(1 / (1 + np.exp(np.clip(slope * f + shift, -500, 500))), k)

        return run

    def _transform(self, rows: DataFrame) -> DataFrame:
        """Adds prediction, and probability: a vector with a place for each label from 0 to the greatest."""
        classes = [int(c) for c in self.getOrDefault("classes")]
        score, features = self.scorer(), self.getOrDefault("featuresCol")
        size = max(classes) + 1

        def run(z: np.ndarray) -> np.ndarray:
            guess, p = score(z)
            out = np.zeros((len(z), size + 1))
            out[:, 0] = np.array(classes)[guess]
            out[:, np.array(classes) + 1] = p
            return out

        rows = rows.drop("prediction", "probability")
        had = "features" in rows.columns and features != "features"
        given = rows.withColumnRenamed("features", "_given").withColumn("features", F.col(features)) if had else rows
        scored = _mapped(given, "scored", run).withColumn("scored", vector_to_array("scored"))
        scored = scored.drop("features").withColumnRenamed("_given", "features") if had else scored
        return scored.withColumn("prediction", F.get("scored", F.lit(0))).withColumn("probability", array_to_vector(F.slice("scored", 2, size))).drop("scored")
