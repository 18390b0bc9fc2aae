"""File sources and sinks. All go through Spark's readers and writers, so any store that Spark reads works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "step int, n_states int, sse double"
HITS = "motif_id string, sequence_name string, start long, stop long, strand string, score double, p_value double, matched_sequence string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def sequences(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(name, seq) of FASTA or plain files: header lines and white space go, records of a file are joined."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return df.select(F.col("_metadata.file_name").alias("name"), F.regexp_replace(F.regexp_replace("value", "(?m)^>.*$", ""), "\\s+", "").alias("seq"))


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(name, header, seq) of every record of FASTA files. A record is a row of the reader, so large files are split."""
    df = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^>", "").alias("r")).filter(F.trim("r") != "")
    return df.select("name", F.trim(F.regexp_extract("r", "^([^\\n]*)", 1)).alias("header"), F.regexp_replace(F.regexp_replace("r", "^[^\\n]*", ""), "\\s+", "").alias("seq"))


def codon_usage(spark: SparkSession, path: str) -> DataFrame:
    """(codon, freq); U is read as T; of lines with one codon the last counts; a bad line is an error that shows it."""
    line = F.split(F.trim("value"), "\\s+")
    codon = F.translate(F.upper(F.get(line, F.lit(0))), "U", "T")
    freq = F.get(line, F.lit(1)).try_cast("double")
    rows = spark.read.text(path).select("value", codon.alias("codon"), freq.alias("freq"), F.size(line).alias("n"), F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("at")).filter(F.trim("value") != "")
    ok = (F.col("n") == 2) & F.col("codon").rlike("^[ACGT]{3}$") & F.col("freq").isNotNull()
    checked = rows.select(F.when(ok, F.col("codon")).otherwise(F.raise_error(F.concat(F.lit("bad codon line: "), "value")).cast("string")).alias("codon"), "freq", "at")
    return checked.groupBy("codon").agg(F.max_by("freq", "at").alias("freq"))


def trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=TRACE)


def hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated hits with comment lines; an empty file has no rows."""
    return spark.read.csv(path, sep="\t", comment="#", header=True, schema=HITS)


RESULTS = "metadata struct<runtime: string, n_solutions: long, target_id: string>, results array<struct<id: string, cost: double, binding_score: double, sequence: string, costs: array<double>, n_substitutions: int, motif_hits: array<array<long>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads exists."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def results(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, metadata, one result a row) of result files; paths that don't exist have no rows."""
    found = [p for p in paths if exists(spark, p)]
    df = spark.read.json(found, schema=RESULTS, multiLine=True) if found else spark.createDataFrame([], RESULTS)
    return df.select((F.input_file_name() if found else F.lit("")).alias("file"), "metadata", F.explode("results").alias("r")).select("file", "metadata", "r.*")


def patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("pattern")).filter("pattern <> ''")


def solutions(spark: SparkSession, path: str) -> DataFrame:
    """(rank, seq) of the files ``<rank>_sequence.txt`` of a folder."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*_sequence.txt")
    return df.select(F.split(F.col("_metadata.file_name"), "_")[0].alias("rank"), F.trim("value").alias("seq"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """Records of (header, seq), wrapped."""
    df.select(F.concat(F.lit(">"), "header", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")).alias("value")).write.text(path)


def write_bed(df: DataFrame, path: str, track: str) -> None:
    """A track line and six tab-separated columns, in order; one file, as browsers read it."""
    rows = df.select(F.lit(1).alias("o"), "chrom", "start", F.concat_ws("\t", "chrom", "start", "end", "name", "score", "strand").alias("value"))
    head = df.sparkSession.createDataFrame([(0, "", 0, f'track name="{track}"')], "o int, chrom string, start long, value string")
    head.union(rows).repartitionByRange(1, "o").sortWithinPartitions("o", "chrom", "start").select("value").write.text(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def write_codon_costs(df: DataFrame, path: str) -> None:
    df.select(F.col("codon").alias("Codon"), F.bround("cost", 3).alias("Cost")).write.csv(path, header=True)


def marked(seq, before: int):
    """The sequence with the coding mark after ``before`` bases."""
    return F.concat(F.substring(seq, 1, before), F.lit("*"), F.substring(seq, before + 1, 1 << 30))


def meme(matrix: DataFrame, n_sequences: DataFrame) -> DataFrame:
    """(matrix_id, text): motifs in MEME's minimal format, from (matrix_id, pos, base, p) and (matrix_id, n)."""
    p = {b: F.max(F.when(F.col("base") == b, F.col("p"))) for b in "ACGT"}
    line = matrix.groupBy("matrix_id", "pos").agg(F.format_string(" %.6f  %.6f  %.6f  %.6f", *p.values()).alias("line"))
    body = line.groupBy("matrix_id").agg(F.count("*").alias("w"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.format_string("MEME version 5\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n\nMOTIF %s\nletter-probability matrix: alength= 4 w= %d nsites= %d E= 0\n%s\n", "matrix_id", "w", "n", "body")
    return body.join(n_sequences, "matrix_id").select("matrix_id", head.alias("text"))


#: Results of one written document, about.
RESULTS_TOGETHER = 50_000


def write_results(df: DataFrame, path: str, together: int = RESULTS_TOGETHER) -> None:
    """JSON documents, each a file, with the metadata of a target and its results in order of their ids.

    A target with more than ``together`` results has several documents with the same metadata, among which its results are
    dealt by a hash, so that no document is as large as a target. ``results`` reads them together.
    """
    rest = ["id", "cost", "binding_score", "sequence", "costs", "n_substitutions", "motif_hits"]
    n = df.groupBy(F.col("metadata").alias("_of")).agg(F.count("*").alias("_n"))  # a row for each target
    n = F.broadcast(n) if n.count() <= 100_000 else n
    parts = df.join(n, F.col("metadata").eqNullSafe(F.col("_of")))
    parts = parts.withColumn("_part", F.pmod(F.xxhash64(*rest), F.ceil(F.col("_n") / together)))
    dealt = parts.select("metadata", "_part", *rest).repartition("metadata", "_part")  # rows are collected where they are dealt to
    documents = dealt.groupBy("metadata", "_part").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("results"))
    documents.select("metadata", "results").write.option("maxRecordsPerFile", 1).json(path)


def write_solutions(df: DataFrame, path: str) -> None:
    """A file ``<id>_sequence.txt`` for each row (id, sequence) of a report; row by row, through Spark's file system."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    for row in df.select("id", "sequence").toLocalIterator():
        at = fs.Path(f"{path}/{row['id']}_sequence.txt")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(row["sequence"].encode()))
        out.close()


def write_state_map(classes: DataFrame, path: str) -> None:
    classes.groupBy("rep").agg(F.sort_array(F.collect_list("v")).alias("members")).write.json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row: differences of reductions and the like."""
    df.write.json(path)


def write_partition_report(matrix: DataFrame, mismatch: DataFrame, path: str) -> None:
    """Text report of two labellings: differing assignments, then the overlap of each pair of labels, in order."""
    a, b = matrix.columns[:2]
    head = mismatch.select(F.lit(0).alias("o"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.format_string("differing assignments: %d / %d", "n_mismatch", "n").alias("value"))
    rows = matrix.select(F.lit(1).alias("o"), F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"), F.concat_ws("\t", F.col(a), F.col(b), F.col("n")).alias("value"))
    head.union(rows).coalesce(1).sortWithinPartitions("o", "x", "y").select("value").write.text(path)


def write_layer_sizes(sizes: DataFrame, path: str) -> None:
    """(position, further numbers with three digits) in one file by position."""
    numbers = [c for c in sizes.columns if c != "position"]
    sizes.select("position", *[F.format_string("%.3f", F.col(c).cast("double")).alias(c) for c in numbers]).coalesce(1).sortWithinPartitions("position").write.csv(path, header=True)


def write_marked(df: DataFrame, seq: str, before: int, path: str) -> None:
    """One sequence a line, with the coding mark after ``before`` bases."""
    df.select(marked(F.col(seq), before).alias("value")).write.text(path)
