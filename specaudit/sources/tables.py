"""Typed loading of ragged source tables, and sinks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import number
from . import barcodes
from .manifest import stage_hash

#: Names that are tried, in order, for columns whose names vary.
BARCODE_NAMES = ("barcode", "sample", "sample_id", "submitter_id", "slide_barcode", "bcr_patient_barcode", "patient", "filename")
EMBEDDING_NAMES = ("embedding", "embeddings", "features", "vector")
PATIENT_NAMES = ("patient_id", "patient", "bcr_patient_barcode", "case_id", "sample", "array")
ANCESTRY_NAMES = ("pam.ancestry.cluster", "consensus_ancestry", "ancestry", "race")
PURITY_NAMES = ("ABSOLUTE", "purity", "CPE", "ESTIMATE", "LUMP", "IHC")
CIRCULAR_PURITY = ("estimate", "cpe")


@dataclass
class Provenance:
    """Where a loaded artefact comes from."""

    name: str
    source: str
    licence: str = ""
    accessed: str = ""
    n_rows: int | None = None
    notes: list[str] = field(default_factory=list)


def write_provenance(records: Sequence[Provenance], path: str) -> None:
    with open(path, "w") as f:
        json.dump([asdict(r) for r in records], f, indent=2)


def guess_column(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """The first candidate that is a column's name, whatever the case; else one that is part of a name."""
    lower = {c.lower(): c for c in reversed(columns)}
    for x in candidates:
        if x.lower() in lower:
            return lower[x.lower()]
    for x in candidates:
        for c in columns:
            if x.lower() in c.lower():
                return c
    raise ValueError(f"none of {list(candidates)} among {list(columns)}")


def guess_barcode_column(frame: DataFrame) -> str:
    """A known name, else the first string column of whose first 20 values over 80 % look like codes."""
    for c in BARCODE_NAMES:
        if c in frame.columns:
            return c
    for f in frame.schema.fields:
        if isinstance(f.dataType, T.StringType):
            seen = [r[0] for r in frame.select(F.col(f"`{f.name}`")).filter(F.col(f"`{f.name}`").isNotNull()).limit(20).collect()]
            if seen and sum(s.upper().startswith("TCGA-") for s in seen) > 0.8 * len(seen):
                return f.name
    raise ValueError("no barcode column")


def guess_embedding_column(frame: DataFrame) -> str | None:
    """A known name, else the first array column; None if features stand in columns of their own."""
    for c in EMBEDDING_NAMES:
        if c in frame.columns:
            return c
    return next((f.name for f in frame.schema.fields if isinstance(f.dataType, T.ArrayType)), None)


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Columns that look like one feature each: feat_1, emb_2, f_3, dim_4, x5."""
    return [c for c in columns if re.fullmatch(r"(?:feat_|emb_|f_|dim_|x)\d+", c)]


def layer_of(embedding: Column, data_type: T.DataType, layer: int = -1) -> Column:
    """A flat vector as doubles; of layers x dimensions, one layer (negative: from the end; out of range: an error)."""
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.ArrayType):
        embedding = F.element_at(embedding, layer if layer < 0 else layer + 1)
    return embedding.cast("array<double>")


def load_embeddings(frame: DataFrame, barcode: str | None = None, embedding: str | None = None, fallback: str = "filename", layer: int = -1, primary_only: bool = True) -> DataFrame:
    """Rows with a barcode's fields and a vector.

    A missing or short code is recovered from the fallback column's first dotted part where that parses; other
    malformed codes drop out. With primary_only, only primary tumour samples stay.
    """
    barcode = barcode or guess_barcode_column(frame)
    embedding = embedding or guess_embedding_column(frame)
    code = F.col(f"`{barcode}`")
    if fallback in frame.columns:
        other = F.split_part(F.col(f"`{fallback}`"), F.lit("."), F.lit(1))
        code = F.when((code.isNull() | (F.length(code) < 12)) & barcodes.parse(other).isNotNull(), other).otherwise(code)
    vector = layer_of(F.col(f"`{embedding}`"), frame.schema[embedding].dataType, layer) if embedding else F.array(*(F.col(f"`{c}`").cast("double") for c in feature_columns(frame.columns)))
    keep = [c for c in frame.columns if c not in (embedding, *feature_columns(frame.columns))]
    out = barcodes.annotate(frame.select(*(F.col(f"`{c}`") for c in keep), code.alias("_barcode"), vector.alias("vector")), "_barcode").drop("_barcode")
    return out.filter("is_primary_tumour") if primary_only else out


def patient_key(c: Column) -> Column:
    return F.substring(F.upper(F.trim(c)), 1, 12)


def broad_ancestry(label: Column) -> Column:
    """Continental group of a label; ADMIXED for other labels, UNKNOWN for none."""
    x = F.upper(F.trim(label.cast("string")))
    return (
        F.when(x.isNull() | x.isin("", "NA", "NAN", "NONE", "UNKNOWN"), "UNKNOWN")
        .when(x.isin("EAS", "SAS", "ASIAN"), "ASIAN")
        .when(x.isin("EUR", "AFR", "AMR"), x)
        .otherwise("ADMIXED")
    )


def keep_first(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def load_ancestry(frame: DataFrame, order: Sequence[Column | str], patient: str | None = None, ancestry: str | None = None) -> DataFrame:
    """``patient_id, ancestry_raw, ancestry``: one row for each patient, the first in the given order."""
    patient = patient or guess_column(frame.columns, PATIENT_NAMES)
    ancestry = ancestry or guess_column(frame.columns, ANCESTRY_NAMES)
    rows = frame.withColumn("patient_id", patient_key(F.col(f"`{patient}`"))).withColumn("ancestry_raw", F.col(f"`{ancestry}`"))
    return keep_first(rows, ["patient_id"], order).select("patient_id", "ancestry_raw", broad_ancestry(F.col("ancestry_raw")).alias("ancestry"))


def load_purity(frame: DataFrame, patient: str | None = None, value: str | None = None) -> tuple[DataFrame, bool]:
    """Mean purity of each patient, and whether the measure is circular (made from expression)."""
    patient = patient or guess_column(frame.columns, PATIENT_NAMES)
    value = value or guess_column(frame.columns, PURITY_NAMES)
    rows = frame.select(patient_key(F.col(f"`{patient}`")).alias("patient_id"), number(F.col(f"`{value}`")).alias("purity")).filter("purity IS NOT NULL")
    return rows.groupBy("patient_id").agg(F.avg("purity").alias("purity")), value.lower() in CIRCULAR_PURITY


def load_expression(wide: DataFrame, sample: str, gene_map: DataFrame | None = None, sample_level: bool = True, sample_codes: Sequence[str] = ("01",)) -> DataFrame:
    """Long ``sample, gene, ordinal, value`` of a wide samples x genes table.

    gene_map (``gene_id, symbol``) renames genes by id without version; the first gene of a symbol wins and
    unmapped genes drop out. Samples are kept by their type code; keys are cut to sample or patient.
    """
    genes = [c for c in wide.columns if c != sample]
    one = F.array(*(F.struct(F.lit(c).alias("gene"), F.lit(k).alias("ordinal"), number(F.col(f"`{c}`")).alias("value")) for k, c in enumerate(genes)))
    key = F.upper(F.trim(F.col(f"`{sample}`")))
    rows = wide.select(key.alias("key"), F.explode(one).alias("g")).select("key", "g.*")
    if sample_codes:
        rows = rows.filter(F.substring("key", 14, 2).isin(*sample_codes))
    rows = rows.withColumn("sample", F.substring("key", 1, 15 if sample_level else 12)).drop("key")
    if gene_map is None:
        return rows.select("sample", "gene", "ordinal", "value")
    named = wide.sparkSession.createDataFrame([(c, c.split(".")[0], k) for k, c in enumerate(genes)], "gene string, gene_id string, ordinal int")
    named = keep_first(named.join(gene_map.dropDuplicates(["gene_id"]), "gene_id"), ["symbol"], ["ordinal"])
    return rows.join(F.broadcast(named.select("gene", "symbol")), "gene").select("sample", F.col("symbol").alias("gene"), "ordinal", "value")


def derive_gene_map(names: DataFrame, gene_id: str = "ensembl_gene_id", symbol: str = "symbol") -> DataFrame:
    """``gene_id, symbol`` of a table of gene names, without rows that have no id."""
    return names.filter(F.col(gene_id).isNotNull()).select(F.col(gene_id).cast("string").alias("gene_id"), F.col(symbol).cast("string").alias("symbol"))


def to_symbols(genes: DataFrame, gene: str, order: str, gene_map: DataFrame, samples: Sequence[str] | None = None) -> DataFrame:
    """Long ``sample, gene, ordinal, value`` of a wide genes x samples table, transposed and renamed.

    Ids are looked up without their version; the first gene (by ``order``) of a name wins; ids of the map's kind that
    it doesn't hold (ENSG...) drop out. samples names the columns to read; the others aren't.
    """
    columns = list(samples) if samples is not None else [c for c in genes.columns if c not in (gene, order)]
    bare = F.split_part(F.col(f"`{gene}`").cast("string"), F.lit("."), F.lit(1))
    names = genes.select(F.col(f"`{gene}`").alias("_id"), F.col(f"`{order}`").alias("ordinal"), bare.alias("gene_id")).join(gene_map.dropDuplicates(["gene_id"]), "gene_id", "left")
    names = names.withColumn("gene", F.coalesce("symbol", F.col("_id").cast("string"))).filter(~F.col("gene").startswith("ENSG"))
    names = keep_first(names, ["gene"], ["ordinal"]).select("_id", "gene", "ordinal")
    long = genes.select(F.col(f"`{gene}`").alias("_id"), *(number(F.col(f"`{c}`")).alias(c) for c in columns)).unpivot(["_id"], columns, "sample", "value")
    return long.join(names, "_id").select("sample", "gene", "ordinal", "value")


def read_gene_sets_gmt(spark: SparkSession, path: str) -> DataFrame:
    """``set_name, ordinal, gene`` of a GMT file: name, description and genes between tabs."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") > 2)
    return parts.select(F.element_at("p", 1).alias("set_name"), F.posexplode(F.slice("p", 3, F.size("p")))).select("set_name", F.col("pos").alias("ordinal"), F.col("col").alias("gene")).filter("gene <> ''")


def read_gene_sets_json(spark: SparkSession, path: str) -> DataFrame:
    """``set_name, ordinal, gene`` of a JSON object from names to lists."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m")).select(F.col("key").alias("set_name"), F.posexplode("value")).select("set_name", F.col("pos").alias("ordinal"), F.col("col").alias("gene"))


def write_gene_sets_json(sets: DataFrame, path: str) -> None:
    """Sets as one JSON object from names to ordered lists; sets are small, so the driver writes them."""
    rows = sets.groupBy("set_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "gene"))).alias("g")).orderBy("set_name").collect()
    with open(path, "w") as f:
        json.dump({r["set_name"]: [x["gene"] for x in r["g"]] for r in rows}, f, indent=2)


def gene_sets(spark: SparkSession, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(name, k, g) for name, genes in sets.items() for k, g in enumerate(genes)]
    return spark.createDataFrame(rows, "set_name string, ordinal int, gene string")


def example_gene_sets(spark: SparkSession) -> DataFrame:
    """A two-gene set for smoke tests."""
    return gene_sets(spark, {"CYTOLYTIC": ["GZMA", "PRF1"]})


def filter_sets(sets: DataFrame, genes: DataFrame, min_genes: int = 5) -> tuple[DataFrame, DataFrame]:
    """Sets cut to available genes, those below min_genes dropped; and a report ``set_name, n, kept, dropped``."""
    here = sets.join(genes.select("gene").distinct().withColumn("_here", F.lit(1)), "gene", "left")
    report = here.groupBy("set_name").agg(F.count("*").alias("n"), F.count("_here").alias("n_present")).withColumn("kept", F.col("n_present") >= min_genes)
    kept = here.filter("_here IS NOT NULL").drop("_here").join(report.filter("kept").select("set_name"), "set_name", "left_semi")
    return kept, report


def sniff_delimiter(spark: SparkSession, path: str, candidates: str = "\t,;|") -> str:
    first = spark.read.text(path).limit(1).collect()
    return max(candidates, key=first[0][0].count) if first else ","


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV or TSV file, gzipped or not, as strings; only the columns named are parsed."""
    frame = spark.read.csv(path, sep=sniff_delimiter(spark, path), header=True, inferSchema=False)
    return frame.select(*(F.col(f"`{c}`") for c in columns)) if columns else frame


def fingerprint(frame: DataFrame, key: str) -> DataFrame:
    """One row ``fingerprint, n``: a hash of the distinct keys, as strings, in any order, by a tree of hashes; null keys are left out."""
    keys = frame.select(F.col(key).cast("string").alias("k")).filter("k IS NOT NULL").distinct()
    return stage_hash(keys).select(F.col("sha256").alias("fingerprint"), "n")


def recorded_fingerprint(frame: DataFrame, key: str) -> DataFrame:
    """One row: sha256 of the sorted distinct keys joined by newlines, and their number, as older records have it.

    Only to compare with such a record: a hash of one text goes through the keys in order, so they are sorted on executors and
    pass the driver partition by partition. :func:`fingerprint` serves any other purpose.
    """
    digest, n = hashlib.sha256(), 0
    for r in frame.select(F.col(key).cast("string").alias("k")).filter("k IS NOT NULL").distinct().orderBy("k").toLocalIterator():
        digest.update(("\n" if n else "").encode() + r["k"].encode())
        n += 1
    return frame.sparkSession.createDataFrame([(digest.hexdigest(), n)], "fingerprint string, n long")


def save(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Write named tables below a folder: parquet, csv (gzipped) or json."""
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        if kind == "csv":
            out.csv(f"{folder}/{name}", header=True, compression="gzip")
        else:
            getattr(out, kind)(f"{folder}/{name}")
