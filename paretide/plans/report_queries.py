"""Queries of motif hits with p-values, regions, report tables, experiment analytics and whole design runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import designer
from ..operators import analytics, kmer, motif, regions, sampling, shaping
from ..operators.staging import folder
from ..sources import files
from . import derived
from .queries import _DNA_SQL, _FRONT_SQL, _MOTIF_SQL, _VALUES, _candidates, _dna, _lattice_sql, _score_sql, _weights, _windows_sql
from .registry import query, table

# --- hits with p-values

_P = 0.05
#: Both strands of each window; a k-mer's chance is the share of the 64 with its score or more.
_SCAN_SQL = f"""WITH {_MOTIF_SQL}, {_lattice_sql(3)}, s AS (SELECT kmer, {_score_sql('kmer')} AS score FROM lattice),
    tail AS (SELECT a.kmer, a.score, count(*) / 64.0 AS p FROM s a JOIN s b ON round(b.score, 6) >= round(a.score, 6) GROUP BY a.kmer, a.score),
    good AS (SELECT * FROM tail WHERE p <= {_P}), {_DNA_SQL}, {_windows_sql(3)},
    both_ways AS (SELECT doc_id, pos, '+' AS strand, kmer FROM win UNION ALL SELECT doc_id, pos, '-', reverse(translate(kmer, 'ACGT', 'TGCA')) FROM win),
    scan AS (SELECT doc_id, pos AS start, pos + 2 AS stop, strand, score, p AS p_value, kmer AS matched_sequence FROM both_ways JOIN good USING (kmer))"""


@query("scan_hits", f"{_SCAN_SQL} SELECT doc_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, strand, round(score, 4) AS score, round(p_value, 6) AS p_value, matched_sequence FROM scan")
def scan_hits(spark: SparkSession, d: str) -> DataFrame:
    return motif.scan_hits(_dna(spark, d), "seq", _weights(spark), _P).withColumn("score", F.round("score", 4)).withColumn("p_value", F.round("p_value", 6))


@query("gene_hit_counts", f"{_SCAN_SQL} SELECT doc_id, '{_P}' AS motif_hit_pvalue, count(*) AS number_of_motif_hits FROM scan GROUP BY doc_id")
def gene_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    """A row for each sequence with a hit."""
    return motif.scan_hits(_dna(spark, d), "seq", _weights(spark), _P).groupBy("doc_id").agg(F.lit(str(_P)).alias("motif_hit_pvalue"), F.count("*").alias("number_of_motif_hits"))


@query("hits_in_orfs", f"{_SCAN_SQL}, orf AS (SELECT doc_id, 'first' AS region, 10 AS first, 60 AS last FROM dna UNION ALL SELECT doc_id, 'second', 50, 120 FROM dna) SELECT doc_id, region, count(*) AS n FROM scan JOIN orf USING (doc_id) WHERE start >= first AND stop <= last GROUP BY 1, 2")
def hits_in_orfs(spark: SparkSession, d: str) -> DataFrame:
    rows = _dna(spark, d)
    orfs = rows.select("doc_id", F.explode(F.array(F.struct(F.lit("first").alias("region"), F.lit(10).alias("first"), F.lit(60).alias("last")), F.struct(F.lit("second").alias("region"), F.lit(50).alias("first"), F.lit(120).alias("last")))).alias("o")).select("doc_id", "o.*")
    return analytics.hits_in_regions(motif.scan_hits(rows, "seq", _weights(spark), _P), orfs, "doc_id").groupBy("doc_id", "region").agg(F.count("*").alias("n"))


#: Patterns of mixed lengths; the strand comes from a file's name.
_PATTERNS = ["ACGT", "AAA", "TATATA", "GCGC", "CA"]


@query("pattern_log", f"WITH {_DNA_SQL}, p AS (SELECT unnest([{', '.join(repr(x) for x in _PATTERNS)}]) AS pattern), w AS (SELECT doc_id, seq, pattern, unnest(range(1, length(seq) - length(pattern) + 2)) AS start FROM dna CROSS JOIN p WHERE length(seq) >= length(pattern)) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '+' WHEN doc_id % 3 = 1 THEN '-' ELSE 'Unknown' END AS strand, pattern, CAST(start AS INT) AS start, CAST(start + length(pattern) - 1 AS INT) AS stop FROM w WHERE substr(seq, start, length(pattern)) = pattern")
def pattern_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _dna(spark, d).withColumn("name", F.when(F.col("doc_id") % 3 == 0, "x_1_y.txt").when(F.col("doc_id") % 3 == 1, "x_-1_y.txt").otherwise("x.txt"))
    found = kmer.pattern_hits(rows.select("doc_id", kmer.strand_of(F.col("name")).alias("strand"), "seq"), "seq", _PATTERNS)
    return found.select("doc_id", "strand", "pattern", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


@query("common_prefix_length", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(list_max(list_filter(range(0, least(length(a.n_name), length(b.n_name)) + 1), lambda k: left(a.n_name, k) = left(b.n_name, k))) AS INT) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def common_prefix_length(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(x), F.col("n_name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b", kmer.longest_common_prefix(F.col("name_a"), F.col("name_b")).alias("n"))


# --- regions


@query("chromosome_list", "SELECT n_name AS name, CAST(n_nationkey * 1000 AS BIGINT) AS length FROM nation WHERE n_regionkey IN (1, 2)")
def chromosome_list(spark: SparkSession, d: str) -> DataFrame:
    system = F.when(F.col("n_regionkey") == 1, "chromosome").when(F.col("n_regionkey") == 2, "scaffold").otherwise("contig")
    return regions.chromosomes(table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 1000).cast("long").alias("length"), system.alias("coord_system")))


@query("coding_sequences", "SELECT l_orderkey AS gene_id, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def coding_sequences(spark: SparkSession, d: str) -> DataFrame:
    genes = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("gene_id"))
    return regions.coding_sequences(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gene_id"), "l_linenumber"), genes)


@query("region_names", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN split_part(n_name, '_', 1) ELSE 'G' || n_nationkey END AS id, 'chr' || n_regionkey || ':' || (n_nationkey + 10) || '..' || (n_nationkey + 20) || ':-1' AS name, 'base/fly/chr' || n_regionkey || '/' || CASE WHEN n_regionkey = 0 THEN split_part(n_name, '_', 1) ELSE 'G' || n_nationkey END || '_-1_' || (n_nationkey + 10) || '_' || (n_nationkey + 20) || '.fa' AS path FROM nation")
def region_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    key = F.col("n_nationkey").cast("string")
    rows = n.select("n_nationkey", F.lit("fly").alias("species"), F.concat(F.lit("chr"), F.col("n_regionkey").cast("string")).alias("seq_region_name"), F.when(F.col("n_regionkey") == 0, "").otherwise(F.concat(F.lit("G"), key)).alias("gene_id"), F.concat("n_name", F.lit("_P1")).alias("protein_id"), F.lit(1).alias("start"), F.lit(9).alias("end"), F.lit(-1).alias("strand"))
    rows = regions.sub_region(rows, F.col("n_nationkey") + 10, F.col("n_nationkey") + 20)
    return rows.select("n_nationkey", regions.region_id().alias("id"), regions.region_name().alias("name"), regions.region_path("base").alias("path"))


@query("position_contexts", "SELECT p_partkey, p_partkey % 100 BETWEEN 7 AND 30 OR p_partkey % 100 BETWEEN 40 AND 60 AS is_coding, CAST(CASE WHEN p_partkey % 100 BETWEEN 7 AND 30 THEN 7 + (p_partkey % 100 - 7) // 3 * 3 - 1 WHEN p_partkey % 100 BETWEEN 40 AND 60 THEN 40 + (p_partkey % 100 - 40) // 3 * 3 - 1 END AS BIGINT) AS codon_start FROM part")
def position_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 100).alias("pos"))
    return analytics.positions_in_regions(rows, [(7, 30), (40, 60)], "pos").select("p_partkey", "is_coding", F.col("codon_start").cast("long").alias("codon_start"))


# --- report tables


@query("printed_motifs", "SELECT 'MA' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '.rc' ELSE '.1' END AS matrix_id, p_size FROM part WHERE p_size % 5 <> 0 AND p_partkey <> 210")
def printed_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Reverse complements and motifs that aren't printed go; the dots are plain dots."""
    name = F.when(F.col("p_partkey") == 210, "MA0210.1").otherwise(F.concat(F.lit("MA"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, ".rc").otherwise(".1")))
    return shaping.printed_motifs(table(spark, d, "part").select(name.alias("matrix_id"), "p_size"))


@query("report_headings", """SELECT p_partkey AS "Matrix ID", p_size AS "\\# States in DB FSM", p_retailprice AS "Binding Score MSE" FROM part""")
def report_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("matrix_id"), F.col("p_size").alias("n_states_db_fsm"), F.col("p_retailprice").alias("binding_mse"), F.lit(1).alias("other"))
    return shaping.with_headings(shaping.selected(rows, ["matrix_id", "n_states_db_fsm", "binding_mse"]))


@query("correlation_table", "SELECT 'l_tax' AS y, count(*) AS n, round(corr(l_quantity, l_tax), 6) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*), round(corr(l_quantity, l_extendedprice), 6) FROM lineitem UNION ALL SELECT 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem")
def correlation_table(spark: SparkSession, d: str) -> DataFrame:
    """Columns by a pattern, each against one column; the p-value is tested against known values."""
    rows = table(spark, d, "lineitem").select("l_quantity", "l_tax", "l_extendedprice", "l_discount", F.lit("x").alias("note"))
    found = analytics.correlations(rows, "l_quantity", shaping.matching(rows, "l_[ted]*"))
    return spark.createDataFrame([(y, n, round(r, 6)) for y, n, r, _ in found], "y string, n long, r double")


_COLORED_SQL = "SELECT p_brand AS matrix_id, CAST(p_size % 4 AS INT) AS number_of_colors, p_partkey AS n_states_irreducible_fsm, CAST(p_retailprice AS DOUBLE) AS binding_mse, CAST(p_retailprice + p_size - 25 AS DOUBLE) AS colorless_mse FROM part WHERE p_brand <> 'Brand#11'"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    colored = part.select(F.col("p_brand").alias("matrix_id"), (F.col("p_size") % 4).cast("int").alias("number_of_colors"), F.col("p_partkey").alias("n_states_irreducible_fsm"), F.col("p_retailprice").cast("double").alias("binding_mse"))
    colorless = part.select(F.col("p_brand").alias("matrix_id"), F.col("p_partkey").alias("n_states"), (F.col("p_retailprice") + F.col("p_size") - 25).cast("double").alias("binding_mse"))
    names = [r["matrix_id"] for r in colored.select("matrix_id").distinct().collect() if r["matrix_id"] != "Brand#11"]  # a row for each motif
    return analytics.delta_mse(colored, colorless, names)


@query("delta_mse", f"SELECT matrix_id, number_of_colors, n_states_irreducible_fsm, round(binding_mse - colorless_mse, 4) AS delta_mse, binding_mse < colorless_mse AS outlier FROM ({_COLORED_SQL})")
def delta_mse(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).select("matrix_id", "number_of_colors", "n_states_irreducible_fsm", F.round("delta_mse", 4).alias("delta_mse"), F.col("binding_mse").__lt__(F.col("colorless_mse")).alias("outlier"))


@query("mse_by_colors", f"SELECT number_of_colors, round(avg(binding_mse), 4) AS mse_mean, round(stddev_pop(binding_mse), 4) AS mse_std, round(avg(binding_mse - colorless_mse), 4) AS delta_mean, round(stddev_pop(binding_mse - colorless_mse), 4) AS delta_std, count(*) AS n FROM ({_COLORED_SQL}) GROUP BY number_of_colors")
def mse_by_colors(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.mse_by_colors(_deltas(spark, d))
    return out.select("number_of_colors", *[F.round(c, 4).alias(c) for c in ("mse_mean", "mse_std", "delta_mean", "delta_std")], "n")


@query("strand_efficiencies", "SELECT n_nationkey AS motif, CAST(n_nationkey AS DOUBLE) AS double, (n_nationkey * 2 + n_regionkey) / 2.0 AS avg, CAST(greatest(n_nationkey * 2, n_regionkey) AS DOUBLE) AS max FROM nation")
def strand_efficiencies(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("strand"), v.cast("double").alias("efficiency")) for s, v in (("forward", F.col("n_nationkey") * 2), ("backward", F.col("n_regionkey")), ("double", F.col("n_nationkey")))]))
    return analytics.strand_efficiencies(n.select(F.col("n_nationkey").alias("motif"), each.alias("e")).select("motif", "e.*"))


@query("durations", "SELECT p_partkey, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS took FROM (SELECT p_partkey, CAST(floor(p_retailprice * 37) AS BIGINT) AS s FROM part)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", analytics.format_duration(F.col("p_retailprice") * 37).alias("took"))


# --- samplers by phase


_PHASES = {"none": (-1, -1, 5), "upstream": (20, 60, 5), "codon 1 or 2": (20, 60, 21), "codon 3": (20, 60, 22), "downstream": (20, 60, 70)}


def _phase_sql() -> str:
    picks = []
    for name, (alphas, ratios) in sampling.PHASES.items():
        for a, r in zip(alphas, ratios, strict=True):
            part = max(1, round(24 * r))
            picks += [f"('{name}', {(i / (part - 1)) ** a if part > 1 else 0.0!r})" for i in range(part)]
    return f"""WITH c AS ({_FRONT_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY f DESC, b, id) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM c),
        p AS (SELECT DISTINCT phase, key, CAST(round_even(x * (n - 1), 0) AS BIGINT) AS r FROM (SELECT DISTINCT key, n FROM r) CROSS JOIN (VALUES {', '.join(picks)}) t(phase, x))
        SELECT phase, key, id, f, b FROM (SELECT p.phase, r.*, row_number() OVER (PARTITION BY p.phase, key ORDER BY r.r) AS k FROM r JOIN p USING (key, r)) WHERE k <= 24"""


@query("phase_samples", _phase_sql())
def phase_samples(spark: SparkSession, d: str) -> DataFrame:
    """The sampler of every phase, which a position and a coding region name."""
    rows, order = _candidates(spark, d), [F.desc("f"), F.asc("b"), F.asc("id")]
    out = []
    for name, (first, last, position) in _PHASES.items():
        bound = lambda x: F.lit(None).cast("int") if x < 0 else F.lit(x)
        named = sampling.sample(rows, ["key"], "f", order, 24, method="phase", phase=name)
        out.append(named.select(sampling.phase(F.lit(position), bound(first), bound(last)).alias("phase"), "key", "id", "f", "b"))
    whole = out[0]
    for one in out[1:]:
        whole = whole.union(one)
    return whole


@query("no_sample", _FRONT_SQL)
def no_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(_candidates(spark, d), ["key"], "f", [], 0, method="none").select("key", "id", "f", "b")


# --- a whole design run

#: Counts whose scores are whole numbers, so that sums and ties are exact in any order of addition.
_EXACT = [("toy", i, b, n) for i, row in enumerate(((7, 3, 1, 1), (1, 1, 7, 3), (3, 1, 1, 7))) for b, n in zip("ACGT", row, strict=True)]


def _design_run_sql() -> str:
    """All sequences of the target's length: mismatches against double-strand scores of their windows; the front, numbered."""
    motif_sql = _MOTIF_SQL.replace(_VALUES, ", ".join(str(x) for x in _EXACT))
    return f"""WITH RECURSIVE {derived.targets_sql("'t'", (1, 1))}, {motif_sql}, {_lattice_sql(3)}, sc AS (SELECT kmer, {_score_sql('kmer')} AS f, {_score_sql("reverse(translate(kmer, 'ACGT', 'TGCA'))")} AS r FROM lattice),
        tail AS (SELECT a.kmer, count(*) / 64.0 AS p FROM sc a JOIN sc b ON round(b.f, 6) >= round(a.f, 6) GROUP BY a.kmer),
        grow AS (SELECT 0 AS i, '' AS seq, CAST(0 AS DOUBLE) AS f UNION ALL SELECT i + 1, g.seq || x, g.f - CASE WHEN substr(t.seq, i + 1, 1) = x THEN 0 ELSE 1 END FROM grow g JOIN tgt t ON i < t.n CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) l(x)),
        each AS (SELECT g.seq, f, unnest(range(1, t.n - 1)) AS pos FROM grow g JOIN tgt t ON i = t.n), s AS (SELECT e.seq, e.f, sum(greatest(sc.f, sc.r)) AS b FROM each e JOIN sc ON kmer = substr(e.seq, pos, 3) GROUP BY 1, 2),
        front AS (SELECT * FROM s p WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.f >= p.f AND o.b <= p.b AND (o.f > p.f OR o.b < p.b))),
        win AS (SELECT seq, unnest(range(1, length(seq) - 1)) AS pos FROM front),
        hit AS (SELECT seq, pos FROM win JOIN tail ON kmer = substr(seq, pos, 3) WHERE p <= {_P} UNION ALL SELECT seq, pos FROM win JOIN tail ON kmer = reverse(translate(substr(seq, pos, 3), 'ACGT', 'TGCA')) WHERE p <= {_P})
        SELECT 't' AS target, printf('%03d', row_number() OVER (ORDER BY f DESC, b, seq)) AS id, -f AS cost, round(b, 6) AS binding_score, seq AS sequence, CAST(-f AS INT) AS n_substitutions, CAST((SELECT count(*) FROM hit WHERE hit.seq = front.seq) AS INT) AS n_hits FROM front"""


@query("design_run", _design_run_sql())
def design_run(spark: SparkSession, d: str) -> DataFrame:
    """From a FASTA file with the consensus of all coding regions, where every region reaches, to numbered results in JSON,
    read back."""
    path = folder(spark, "design")
    regions_found = derived.coding_regions(spark, d).select(F.lit("t").alias("job"), "seq")
    files.write_fasta(kmer.consensus(regions_found, "job", "seq", (1, 1)).select(F.col("job").alias("header"), "seq"), f"{path}/in/raw")
    targets = files.fasta_records(spark, f"{path}/in/raw").select(F.col("header").alias("job"), "seq")
    counts = spark.createDataFrame(_EXACT, "matrix_id string, pos int, base string, count long")
    rows = designer.run(spark, targets, counts, "toy", budgets=(0,), alphas=(1.0,), reduce_by=None, p_value=_P)
    meta = F.struct(F.lit("00:00:00").alias("runtime"), F.lit(0).cast("long").alias("n_solutions"), F.col("target").alias("target_id"))
    files.write_results(rows.withColumn("metadata", meta), f"{path}/out")
    back = files.results(spark, f"{path}/out")
    return back.select(F.col("metadata.target_id").alias("target"), "id", F.col("cost"), F.round("binding_score", 6).alias("binding_score"), "sequence", "n_substitutions", F.size("motif_hits").alias("n_hits"))
