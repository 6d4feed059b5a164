"""From raw tables to a cohort with expression and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort as coh
from ..operators import compare
from ..sources import tables


def build_cohort(slides: DataFrame, expr: DataFrame, sets: DataFrame, order: str, purity: DataFrame | None = None, ancestry: DataFrame | None = None, types: Sequence[str] | None = None, groups: Sequence[str] | None = None, how: str = "mean", prefix: str = "SIG_", min_genes: int = 1) -> tuple[DataFrame, DataFrame]:
    """A cohort with one row for each patient and a score column for each set, and its expression ``sample, gene, value``.

    slides: ``patient_id, cancer_type, vector`` and others, one row for each slide; expr: ``sample, patient_id, gene,
    value`` of samples; ancestry and purity by patient. types and groups keep patients of some cancer types and
    ancestries. A patient's samples are averaged, or the first by name is taken. Patients without expression drop out.
    Sets are cut to the genes that are there, and scored over the patients that stay.
    """
    if types is not None:
        slides = slides.filter(F.col("cancer_type").isin(*types))
    patients = coh.collapse_to_patient(slides, order)
    beside = {n: t for n, t in (("ancestry", ancestry), ("purity", purity)) if t is not None}
    patients = coh.assemble_cohort(patients, beside)
    if groups is not None:
        patients = patients.filter(F.col("ancestry").isin(*groups))
    if how == "first":
        first = expr.groupBy("patient_id").agg(F.min("sample").alias("sample"))
        own = expr.join(first, ["patient_id", "sample"]).select(F.col("patient_id").alias("sample"), "gene", "value")
    else:
        own = coh.mean_by_patient(expr, F.col("patient_id"))
    patients = patients.join(own.select(F.col("sample").alias("patient_id")).distinct(), "patient_id", "left_semi")
    own = own.join(patients.select(F.col("patient_id").alias("sample")), "sample", "left_semi")
    kept, _ = tables.filter_sets(sets, own.select("gene").distinct(), min_genes)
    names = sorted(r[0] for r in kept.select("set_name").distinct().collect())  # one for each set
    named = kept.select(F.concat(F.lit(prefix), "set_name").alias("set_name"), "gene")
    return compare.rescore(patients, own, named, "mean_z", [f"{prefix}{n}" for n in names]), own


