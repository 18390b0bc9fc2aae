"""Genome regions: chromosomes, coding sequences of genes, names and paths, sub-regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The coordinate systems that count as chromosomes.
COORDINATES = ("chromosome", "scaffold")


def chromosomes(regions: DataFrame) -> DataFrame:
    """(name, length) of the top-level regions that are chromosomes or scaffolds."""
    return regions.filter(F.col("coord_system").isin(*COORDINATES)).select("name", "length")


def coding_sequences(cds: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of ``cds`` whose gene_id is among those of ``genes``."""
    return cds.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")


def region_id() -> Column:
    """The gene's id, or the protein's id up to its first underscore."""
    return F.coalesce(F.nullif(F.col("gene_id"), F.lit("")), F.split("protein_id", "_")[0])


def region_name() -> Column:
    return F.format_string("%s:%d..%d:%d", F.col("seq_region_name"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("strand").cast("int"))


def region_path(base: str) -> Column:
    """Where a region's sequence is stored below ``base``."""
    name = F.format_string("%s_%d_%d_%d.fa", region_id(), F.col("strand").cast("int"), F.col("start").cast("long"), F.col("end").cast("long"))
    return F.concat_ws("/", F.lit(base), "species", "seq_region_name", name)


def sub_region(regions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Copies with new bounds; all other columns stay."""
    return regions.withColumn("start", start).withColumn("end", end)
