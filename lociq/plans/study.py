"""A study: a labelled table, its split into training and test rows, and the models trained on it.

Everything lies below one path of the shared folder, so reports of other jobs read the same
vectors and models instead of making their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from lociq.operators import model, sampling
from lociq.plans import evaluate
from lociq.session import delete, exists, kept, kept_path

#: The model that scores live files: the features that those have, too.
LIVE = "live"


@dataclass
class Study:
    """Tables and models kept under the shared folder as ``name``."""

    spark: SparkSession
    name: str
    kind: str

    @classmethod
    def of(cls, spark: SparkSession, name: str, kind: str, table: Callable[[], DataFrame]) -> Study:
        """The study ``name``; its labelled table is built, split by patient and written if it isn't there."""

        def build(path: str) -> None:
            table().write.parquet(f"{path}/table")
            train, test = sampling.group_split(spark.read.parquet(f"{path}/table"), "patient_id")
            train.write.parquet(f"{path}/train")
            train = spark.read.parquet(f"{path}/train")
            assembly = evaluate.fit_assembly(train, kind)
            assembly.save(f"{path}/assembly")
            evaluate.with_vectors(test, assembly).write.parquet(f"{path}/test")
            # All of its rows are in the two parts.
            delete(spark, f"{path}/table")

        kept(spark, f"{name}/data", build)
        return cls(spark, name, kind)

    def _part(self, part: str) -> str:
        return f"{kept_path(self.spark, self.name)}/data/{part}"

    @property
    def train(self) -> DataFrame:
        return self.spark.read.parquet(self._part("train"))

    @property
    def test(self) -> DataFrame:
        """Test rows with their vectors."""
        return self.spark.read.parquet(self._part("test"))

    def features(self, name: str) -> list[str]:
        """Features of a configuration: one of the ablations, or ``LIVE``."""
        every = evaluate.training_features(self.train, self.kind)
        if name == LIVE:
            live = {"snv": model.SNV_FEATURES, "cnv": model.CNV_FEATURES}[self.kind]
            return [c for c in live if c in every]
        return evaluate.keep_lists(every, evaluate.ABLATIONS[self.kind])[name]

    def models(self, names: Sequence[str] | None = None, **settings) -> dict[str, model.RankingModel]:
        """Models of the named configurations, all ablations by default.

        Those not yet there are trained side by side on one table of vectors and saved, apart
        for each choice of ``settings``.
        """
        names = list(names or evaluate.ABLATIONS[self.kind])
        places = {n: f"{self.name}/{_file_name('model', n, *[f'{k}={v}' for k, v in sorted(settings.items())])}" for n in names}
        lacking = [n for n in names if not exists(self.spark, kept_path(self.spark, places[n]))]
        if lacking:
            assembly = PipelineModel.load(self._part("assembly"))
            vectors = evaluate.stage_vectors(self.train, assembly)
            fitted = evaluate.fit_configurations(vectors, assembly, {n: self.features(n) for n in lacking}, **settings)
            for name, one in fitted.items():
                kept(self.spark, places[name], one.save)
        return {n: model.RankingModel.load(kept_path(self.spark, places[n])) for n in names}

    def full(self) -> model.RankingModel:
        return self.models([evaluate.FULL])[evaluate.FULL]

    def live(self) -> model.RankingModel:
        return self.models([LIVE])[LIVE]


def _file_name(*parts: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in "-".join(parts)).lower()
