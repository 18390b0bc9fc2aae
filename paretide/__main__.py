"""Command line: designs, hits and reductions from files to files. ``python -m paretide design --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import designer
from .operators import machines, motif
from .sources import files

#: Columns of a file of letter counts.
COUNTS = "matrix_id string, pos int, base string, count long"


def _numbers(kind: type):
    return lambda text: tuple(kind(x) for x in text.split(","))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="paretide", description="Two-objective sequence design on Spark.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about, description=about)
        c.add_argument("--counts", required=True, help="CSV of letter counts: matrix_id, pos from 0, base, count")
        c.add_argument("--motif", required=True, help="the matrix_id to use")
        c.add_argument("--out", required=True, help="folder of the results")
        return c

    c = command("design", "Sequences near the targets with few binding sites, for each budget and exponent.")
    c.add_argument("--targets", required=True, help="FASTA or plain files, a * before the start codon of a coding region")
    c.add_argument("--usage", help="codon frequencies; without them costs are those of exact match")
    c.add_argument("--budgets", type=_numbers(int), default=(50, 150, 250), help="points a state keeps, 0 for all")
    c.add_argument("--alphas", type=_numbers(float), default=(1.0, 0.7, 0.5), help="exponents of the sampler")
    c.add_argument("--costs", type=_numbers(float), default=(0.5, 1.0, 500.0), help="transition, transversion, change of the amino acid")
    c.add_argument("--reduce-by", type=float, help="least share of states that reducing the machine must save")
    c.add_argument("--p-value", type=float, default=2e-3, help="chance below which a window is a hit")
    c.add_argument("--max-ties", type=int, default=0, help="sequences of one solution, 0 for all")
    c = command("scan", "Hits of a motif on both strands of sequences, as tab-separated values.")
    c.add_argument("--targets", required=True, help="FASTA or plain files")
    c.add_argument("--p-value", type=float, default=2e-3)
    c = command("reduce", "The trace of merging a motif's machine without colours, as CSV.")
    c.add_argument("--strand", choices=("forward", "backward", "double"), default="double")
    c.add_argument("--suffix", type=int, default=2, help="last letters that merged states share")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("paretide").getOrCreate()
    counts: DataFrame = spark.read.csv(a.counts, header=True, schema=COUNTS)
    if a.command == "design":
        designer.design_files(spark, a.targets, counts, a.motif, a.out, a.usage, budgets=a.budgets, alphas=a.alphas, reduce_by=a.reduce_by, p_value=a.p_value, max_ties=a.max_ties, costs=a.costs)
    elif a.command == "scan":
        sequences = files.sequences(spark, a.targets).withColumn("seq", F.upper(F.translate("seq", "*", "")))
        found = motif.scan_hits(sequences, "seq", motif.weights(motif.pssm(counts), a.motif), a.p_value)
        rows = found.select(F.lit(a.motif).alias("motif_id"), F.col("name").alias("sequence_name"), "start", "stop", "strand", "score", "p_value", "matched_sequence")
        rows.write.csv(a.out, sep="\t", header=True)
    else:
        m, _, states = machines.motif_machine(counts, a.motif, (a.strand,))
        traces = machines.reduction_traces(states.select(F.lit(a.motif).alias("fsm_id"), "v", F.col(a.strand).alias("score")), m, a.suffix)
        files.write_csv(traces.select("step", "n_states", (F.col("mse") * 4**m).alias("sse")), a.out)


if __name__ == "__main__":
    main()
