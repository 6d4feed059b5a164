"""Sample barcodes as columns: patient, site, sample type and plate from one structured code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields of a code and the sample types of tumour and normal samples. Trailing text is accepted.
PATTERN = "^TCGA-([0-9A-Z]{2})-([0-9A-Z]{4})(?:-([0-9]{2})([A-Z])?)?(?:-([0-9]{2})([A-Z])?)?(?:-([0-9A-Z]{4}))?(?:-([0-9]{2}))?"
FIELDS = ("tss", "participant", "sample", "vial", "portion", "analyte", "plate", "centre")
PRIMARY = ("01",)
NORMAL = ("10", "11", "12", "13", "14")


def normalised(code: Column) -> Column:
    return F.upper(F.trim(code))


def parse(code: Column, strict: bool = False) -> Column:
    """A struct of all fields with patient_id and two flags; null for a malformed code, or an error if strict."""
    full = normalised(code)
    fields = {f: F.nullif(F.regexp_extract(full, PATTERN, k + 1), F.lit("")) for k, f in enumerate(FIELDS)}
    whole = F.struct(
        full.alias("full"),
        *(c.alias(f) for f, c in fields.items()),
        F.concat_ws("-", F.lit("TCGA"), fields["tss"], fields["participant"]).alias("patient_id"),
        F.coalesce(fields["sample"].isin(*PRIMARY), F.lit(False)).alias("is_primary_tumour"),
        F.coalesce(fields["sample"].isin(*NORMAL), F.lit(False)).alias("is_normal"),
    )
    out = F.when(full.rlike(PATTERN), whole)
    return F.when(full.rlike(PATTERN), whole).otherwise(F.raise_error(F.concat(F.lit("malformed barcode: "), code))) if strict else out


def annotate(frame: DataFrame, column: str = "barcode", drop_unparseable: bool = True) -> DataFrame:
    """frame with patient_id, tss, sample_type, is_primary_tumour and plate; malformed rows go, or raise."""
    parsed = frame.withColumn("_code", parse(F.col(column), strict=not drop_unparseable))
    if drop_unparseable:
        parsed = parsed.filter(F.col("_code").isNotNull())
    pick = {"patient_id": "patient_id", "tss": "tss", "sample_type": "sample", "is_primary_tumour": "is_primary_tumour", "plate": "plate"}
    return parsed.select(*(c for c in frame.columns if c not in pick), *(F.col(f"_code.{f}").alias(name) for name, f in pick.items()))


def site_summary(frame: DataFrame, site: str = "tss", patient: str = "patient_id") -> DataFrame:
    """Distinct patients of each site, largest first (ties by site), with share and running share.

    The running share needs an order over all sites; there are as many rows as sites by then.
    """
    n = frame.groupBy(site).agg(F.countDistinct(patient).alias("n_patients"))
    order = Window.orderBy(F.desc("n_patients"), F.col(site))
    total = F.sum("n_patients").over(Window.partitionBy())
    return n.select(site, "n_patients", (F.col("n_patients") / total).alias("frac"), (F.sum("n_patients").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cum_frac"))
