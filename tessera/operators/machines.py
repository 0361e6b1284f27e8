"""Factorization machines over any feature columns, with a slot for every value and a cold-start rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import FMRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slots import SlotMachine


@dataclass
class Machine:
    """w0 + sum w x + sum of pairwise products of latent vectors; numbers are taken as they are.

    Every value of a categorical column has weights of its own, which stay on the executors (slots.py); one not seen in fit
    adds nothing. With features set, values are hashed to so many slots instead, and share them; those are on the driver.
    """

    categorical: list[str]
    numeric: list[str]
    label: str = "rating"
    features: int | None = None
    size: int = 4
    steps: int = 20
    regularization: float = 0.01
    cold_start: str = "none"  # none: predict anyway; global: the mean where a key is new; item: the item's mean where the user is new
    user: str = "user"
    item: str = "item"

    @property
    def _slots(self) -> bool:
        return self.features is None and bool(self.categorical)

    def _encoded(self, rows: DataFrame) -> DataFrame:
        """rows with _features, a vector with a place for every value."""
        if self._slots:
            wide, size, places = len(self.categorical), self.model.linear.size, self.model.places()
            out = self.model.keyed(rows)
            for i in range(wide):
                null, key = F.col(f"_k{i}").isNull(), F.coalesce(f"_k{i}", F.lit(0).cast("long"))
                out = out.withColumns({"code": F.when(null, i + wide).otherwise(i).cast("long"), "key": key}).join(places, ["code", "key"], "left").withColumnRenamed("place", f"_p{i}").drop("code", "key")
            x = [f"_x{i}" for i in range(len(self.numeric))]
            cells = F.udf(lambda at, x: Vectors.sparse(size, [(a, 1.0) for a in at if a is not None] + [(size - len(x) + i, v) for i, v in enumerate(x)]), VectorUDT())
            made = cells(F.array(*(f"_p{i}" for i in range(wide))), F.array(*x).cast("array<double>"))
            return out.withColumn("_features", made).select(*rows.columns, "_features")
        text = {f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.categorical}
        number = {f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.numeric}
        names = {"inputCols": [*text, *number], "outputCol": "_features"}
        encoder = VectorAssembler(**names) if self.features is None else FeatureHasher(numFeatures=self.features, **names)
        return encoder.transform(rows.withColumns(text | number)).drop(*text, *number)

    def fit(self, rows: DataFrame) -> "Machine":
        label = F.col(self.label).cast("double")
        self.mean, self.deviation = rows.agg(F.avg(label), F.coalesce(F.nullif(F.stddev(label), F.lit(0.0)), F.lit(1.0))).first()
        scaled = (rows if self._slots else self._encoded(rows)).withColumn("_label", (label - self.mean) / self.deviation)
        if self._slots:
            self.model = SlotMachine(self.categorical, self.numeric, self.size, self.steps, self.regularization).fit(scaled, "_label")
        else:
            learner = FMRegressor(featuresCol="_features", labelCol="_label", predictionCol="_p", factorSize=self.size, maxIter=self.steps, stepSize=0.05, regParam=self.regularization, seed=5)
            self.model = learner.fit(scaled)
        self.known_users = rows.select(self.user).distinct() if self.user in rows.columns else None
        self.item_means = rows.groupBy(self.item).agg(F.avg(label).alias("_mean")) if self.item in rows.columns else None
        return self

    def predict(self, rows: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
        p = F.col("_p") * self.deviation + self.mean
        p = F.greatest(p, F.lit(low)) if low is not None else p
        p = F.least(p, F.lit(high)) if high is not None else p
        if self._slots and {self.user, self.item} <= {*self.categorical}:
            out = self.model.predicted(rows, *((self.user, self.item) if self.cold_start != "none" else ())).withColumn("prediction", p)
            if self.cold_start != "none":
                mean = F.coalesce(F.col("_mean") * self.deviation + self.mean, F.lit(self.mean)) if self.cold_start == "item" else F.lit(self.mean)
                out = out.withColumn("prediction", F.when(F.col("_known"), F.col("prediction")).otherwise(mean))
            return out.drop("_p", "_known", "_mean")
        out = (self.model.predicted(rows) if self._slots else self.model.transform(self._encoded(rows))).withColumn("prediction", p).drop("_features", "_p")
        if self.cold_start == "none":
            return out
        out = out.join(self.known_users.withColumn("_known", F.lit(True)), self.user, "left")
        instead = F.lit(self.mean)
        if self.cold_start == "item":
            out = out.join(self.item_means, self.item, "left")
            instead = F.coalesce("_mean", F.lit(self.mean))
        return out.withColumn("prediction", F.when(F.col("_known"), F.col("prediction")).otherwise(instead)).drop("_known", "_mean")


def with_last_item(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows with last_item: the item that the user rated last (by time, then the larger item) in known, or in rows."""
    known = rows if known is None else known
    last = known.groupBy("user").agg(F.max(F.struct("time", "item"))["item"].alias("last_item"))
    return rows.join(last, "user", "left")


def sparse_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """label, features (map from id to value) of lines `label id:value id:value`, split at colons, spaces and commas."""
    x = F.split(F.trim(F.col(column)), r"[ ,]+")
    pairs = F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda t: F.split(t, ":"))
    cells = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].cast("long"), p[1].cast("double"))))
    return lines.select(x[0].cast("double").alias("label"), cells.alias("features"))


def with_features(rows: DataFrame, user_features: DataFrame | None = None, item_features: DataFrame | None = None) -> DataFrame:
    """rows with the feature columns of their user and item, from feature files keyed by `user` and `item`; absent ones are null."""
    if user_features is not None:
        rows = rows.join(user_features, "user", "left")
    return rows if item_features is None else rows.join(item_features, "item", "left")


def with_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with links (how many users their user is linked to, by src and dst) and linked_mean (those users' mean rating)."""
    own = rows.groupBy("user").agg(F.avg("rating").alias("_m"), F.count(F.lit(1)).alias("_n"))
    met = links.select("src", "dst").distinct().join(own.withColumnRenamed("user", "dst"), "dst", "left")
    sums = met.groupBy(F.col("src").alias("user")).agg(F.count(F.lit(1)).alias("links"), (F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("linked_mean"))
    return rows.join(sums, "user", "left").na.fill(0, ["links"])


def cut_off(rows: DataFrame, least: float) -> DataFrame:
    """rows with rating 1 where it was at least so much, else 0."""
    return rows.withColumn("rating", (F.col("rating") >= least).cast("double"))


def sparse_vectors(rows: DataFrame, folder: str) -> DataFrame:
    """label, features (a sparse vector) of sparse_rows, by way of a text table in the folder, which all executors share.

    The vectors are made by Spark's own reader; ids count from 0.
    """
    cells = F.transform(F.array_sort(F.map_entries("features")), lambda c: F.concat_ws(":", (c["key"] + 1).cast("string"), c["value"].cast("string")))
    rows.select(F.concat(F.col("label").cast("string"), F.lit(" "), F.concat_ws(" ", cells))).write.mode("overwrite").text(folder)
    most = rows.agg(F.max(F.array_max(F.map_keys("features")))).first()[0]
    return rows.sparkSession.read.format("libsvm").option("numFeatures", str((most or 0) + 1)).load(folder)


def fit_sparse(vectors: DataFrame, size: int = 4, steps: int = 20, regularization: float = 0.01):
    """A factorization machine on sparse vectors (label, features); transform() of the result predicts."""
    learner = FMRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", factorSize=size, maxIter=steps, stepSize=0.05, regParam=regularization, seed=5)
    return learner.fit(vectors)
