"""Composed preparation of annotated variants (FEA-03, FEA-04).

A ``Preparation`` is fitted on one frame (fill means, and the vocabulary of the
three term encoders with their equal names merged), saved, loaded and applied
to others.  The encoded terms of a variant are one sparse row, ``terms``
(places in the sorted vocabulary) and ``values`` (how many encoders gave the
term): the 0/1 columns of an open vocabulary never become columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.functions.exprs import materialize
from varlens.functions.prefix import prefix_sum, text_lead
from varlens.operators import keys as K
from varlens.operators.features import multi_hot_long, sum_same_name

# Fixed values that must equal the reference's: the term columns and their
# separators, columns that are always dropped, the columns kept without basic
# features, and the columns filled with their mean.
TERM_COLUMNS = (("HPOTerms", ","), ("HPOTermParents", ","), ("GOTerms", ";"))
DROPPED = ("substituted_aa", "original_aa", "position", "MIM")
BARE = ("VarID", "netChange", "gene", "sequence", "train")
FILLED = ("AM", "esm_llr")


def encoded_terms(text: Column, sep: str) -> Column:
    """The terms of a quoted list; the quotes at its ends go."""
    bare = F.regexp_replace(text, '^"+|"+$', "")
    return F.filter(F.split(bare, f"[{sep}]"), lambda t: t != "")


@dataclass
class Preparation:
    basic_features: bool = True
    expression_levels: bool = False
    include_hpo: bool = True
    include_go: bool = True
    keep_only_hpo: bool = False
    means: dict = field(default_factory=dict)
    vocabulary: DataFrame | None = None

    # -- FEA-03 ------------------------------------------------------------
    def _encoders(self) -> list[tuple[str, str]]:
        hpo, go = [c for c in TERM_COLUMNS if c[0] != "GOTerms"], [c for c in TERM_COLUMNS if c[0] == "GOTerms"]
        return (hpo if self.include_hpo else []) + (go if self.include_go else [])

    def _long(self, df: DataFrame) -> DataFrame | None:
        """(VarID, term, value): equal names of different encoders are added."""
        frames = [multi_hot_long(df, "VarID", encoded_terms(F.col(c), sep)) for c, sep in self._encoders()]
        return sum_same_name(frames, "VarID") if frames else None

    def _kept(self, df: DataFrame) -> DataFrame:
        out = K.drop_existing(df, [*DROPPED, *[c for c, _ in TERM_COLUMNS]])
        if not self.expression_levels:
            out = K.drop_by_name(out, ("rel_", "abs_"), ())
        return out if self.basic_features else K.select_existing(out, BARE)

    def fit_annotations(self, df: DataFrame) -> Preparation:
        """Learns the vocabulary: the distinct terms, numbered in their order."""
        long = self._long(df)
        if long is None:
            self.vocabulary = df.sparkSession.createDataFrame([], "term string, place long")
        else:
            distinct = long.select("term").distinct().withColumn("one", F.lit(1).cast("long"))
            ranked = prefix_sum(distinct, [], ["term"], ["one"], inclusive=False, suffix="_r", bucket_on=text_lead(F.col("term")))
            self.vocabulary = materialize(ranked.select("term", F.col("one_r").cast("long").alias("place")))
        return self

    def annotations(self, df: DataFrame) -> DataFrame:
        """The kept columns with ``terms`` and ``values`` (FEA-03); terms that
        were not there when fitting have no place.  A variant has one row."""
        long = self._long(df)
        kept = self._kept(df)
        none = F.array().cast("array<long>")
        if long is None:
            return kept.withColumn("terms", none).withColumn("values", none)
        rows = long.join(self.vocabulary, "term").groupBy("VarID").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("__t"))
        joined = kept.join(rows, "VarID", "left").withColumn("__t", F.coalesce("__t", F.array().cast(rows.schema["__t"].dataType)))
        return joined.withColumn("terms", F.transform("__t", lambda t: t["place"])).withColumn("values", F.transform("__t", lambda t: t["value"])).drop("__t")

    # -- FEA-04 ------------------------------------------------------------
    def _merged(self, variants: DataFrame, annotations: DataFrame) -> DataFrame:
        """Non-neutral variants with their annotations; of columns that both
        have, the variants' stay."""
        base = variants.where(K.not_label(F.col("netChange"))).select("VarID", "gene", "netChange", "sequence")
        extra = annotations.drop(*[c for c in base.columns if c != "VarID"])
        merged = base.join(extra, "VarID")
        return merged.where(K.not_sentinel(F.col("HPOTerms"))) if self.keep_only_hpo else merged

    def fit(self, variants: DataFrame, annotations: DataFrame) -> Preparation:
        """Learns means and vocabulary from the merged rows.  The means count the
        rows before those without terms go."""
        whole = Preparation()._merged(variants, annotations)
        row = whole.agg(*[F.avg(c).alias(c) for c in FILLED if c in whole.columns]).first()
        self.means = {k: v for k, v in row.asDict().items() if v is not None}
        return self.fit_annotations(self._merged(variants, annotations))

    def dataset(self, variants: DataFrame, annotations: DataFrame) -> DataFrame:
        """The prepared rows (FEA-04): label 0 or 1 (others raise), fitted means
        for missing values, sparse terms."""
        merged = self._merged(variants, annotations)
        for c, mean in self.means.items():
            merged = merged.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(mean)))
        return self.annotations(merged.withColumn("netChange", K.encode_label_strict(F.col("netChange"))))

    # -- saved form --------------------------------------------------------
    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        settings = {k: v for k, v in vars(self).items() if k != "vocabulary"}
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        return cls(**settings, vocabulary=spark.read.parquet(f"{path}/vocabulary"))
