"""Genes with their exons and coding regions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import region_text
from .regions import flatten
from .sequences import lengths, window_regions, windows


def attribute(name: str):
    """Value of ``name "value"`` in a GTF group column."""
    return F.regexp_extract("grp", f'{name} "([^"]*)"', 1)


def genes(annotation: DataFrame) -> DataFrame:
    """(name, synonyms, seq, r_start, r_end, strand, exons, cds) from GTF rows as regions, by gene name."""
    rows = annotation.withColumns({"name": attribute("gene_name"), "gene_id": attribute("gene_id")}).where("name <> ''")
    spot = F.struct("seq", "r_start", "r_end", "strand")
    own = rows.where("feature = 'gene'").groupBy("name").agg(F.max_by(F.struct("gene_id", "seq", "r_start", "r_end", "strand"), F.struct("seq", "r_start", "r_end")).alias("g"))
    parts = rows.where("feature IN ('exon', 'CDS')").groupBy("name").agg(
        F.array_sort(F.collect_list(F.when(F.col("feature") == "exon", spot))).alias("exons"), F.array_sort(F.collect_list(F.when(F.col("feature") == "CDS", spot))).alias("cds")
    )
    return own.join(parts, "name", "left").select("name", F.array("name", "g.gene_id").alias("synonyms"), "g.seq", "g.r_start", "g.r_end", "g.strand", "exons", "cds")


def gene(all_genes: DataFrame, name: str) -> DataFrame:
    """The gene of this name or synonym."""
    return all_genes.where(F.array_contains("synonyms", name))


def coding(all_genes: DataFrame) -> DataFrame:
    return all_genes.select(F.explode("cds").alias("c")).select("c.*")


def gene_table(all_genes: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return all_genes.select("name", F.array_join("synonyms", "; ").alias("synonyms"), (F.col("r_end") - F.col("r_start") + 1).alias("length"), size("exons").alias("n_exons"), size("cds").alias("n_cds"))


def viewport(regions: DataFrame, seq: str, start: int, end: int) -> DataFrame:
    """Regions that overlap one interval, with their text."""
    return regions.where((F.col("seq") == seq) & (F.col("r_start") <= end) & (F.col("r_end") >= start)).withColumn("text", region_text())


@dataclass(frozen=True)
class Genome:
    """Frames of genes, sequences and annotation; every ``with_`` method returns a new genome."""

    genes: DataFrame | None = None
    sequences: DataFrame | None = None
    annotation: DataFrame | None = None

    def with_annotation(self, annotation: DataFrame) -> Genome:
        return replace(self, annotation=annotation, genes=genes(annotation))

    def with_sequences(self, sequences: DataFrame) -> Genome:
        return replace(self, sequences=sequences)

    def gene(self, name: str) -> DataFrame:
        return gene(self.genes, name)

    def cds(self) -> DataFrame:
        return flatten(coding(self.genes))

    def lengths(self) -> DataFrame:
        return lengths(self.sequences)

    def windows(self, size: int, step: int) -> DataFrame:
        return windows(self.sequences, size, step)

    def window_regions(self, size: int, step: int) -> DataFrame:
        return window_regions(self.lengths(), size, step)
