"""What several queries draw from the test tables: motifs, scored and coloured states, and targets, each with its SQL.

Every text's letters A, C, G, T make a sequence. Motifs are the letter counts of anchored windows by language or source,
states are k-mers with their frequencies over all texts, targets are the consensus of a source's or language's coding
regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coding, cost, kmer, motif, motifs
from ..operators.staging import staged
from .registry import table

DNA_SQL = "dna AS MATERIALIZED (SELECT doc_id, lang, source, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "text")


def dna(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", kmer.dna(F.col("text")).alias("seq"))


def windows_sql(m: int, name: str = "win", keys: str = "doc_id, lang, source") -> str:
    return f"{name} AS MATERIALIZED (SELECT {keys}, pos, substr(seq, pos, {m}) AS kmer FROM (SELECT {keys}, seq, unnest(range(1, length(seq) - {m} + 2)) AS pos FROM dna WHERE length(seq) >= {m}))"


def lattice_sql(m: int) -> str:
    """All k-mers with their codes, letter by letter."""
    return f"""lattice AS MATERIALIZED (WITH RECURSIVE g(i, v, kmer) AS (SELECT 0, CAST(0 AS BIGINT), '' UNION ALL SELECT i + 1, v * 4 + s, kmer || substr('ACGT', s + 1, 1) FROM g CROSS JOIN (VALUES (0), (1), (2), (3)) l(s) WHERE i < {m})
        SELECT v, kmer FROM g WHERE i = {m})"""


# --- motifs


def motif_counts(spark: SparkSession, d: str, key: str, m: int, anchor: str) -> DataFrame:
    """(matrix_id, pos, base, count) of the windows that begin with ``anchor``, by ``key``."""
    rows = kmer.counts(texts(spark, d), "text", m, key, text=True).filter(F.col("kmer").startswith(anchor))
    return motifs.count_matrices(rows, key, m, "n")


def counts_sql(key: str, m: int, anchor: str) -> str:
    """CTEs that end in counts(matrix_id, pos, base, n)."""
    return f"""{DNA_SQL}, {windows_sql(m, 'anchored')}, held AS (SELECT {key} AS matrix_id, kmer FROM anchored WHERE starts_with(kmer, '{anchor}')),
        letters AS (SELECT matrix_id, CAST(i AS INT) AS pos, substr(kmer, i + 1, 1) AS base, count(*) AS n FROM (SELECT matrix_id, kmer, unnest(range(0, {m})) AS i FROM held) GROUP BY ALL),
        counts AS MATERIALIZED (SELECT k.matrix_id, k.pos, b.base, coalesce(n, 0) AS n FROM (SELECT DISTINCT matrix_id, pos FROM letters) k CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(base) LEFT JOIN letters USING (matrix_id, pos, base))"""


PSSM_SQL = "pssm AS MATERIALIZED (SELECT matrix_id, pos, base, (n + 1.0) / sum(n + 1.0) OVER (PARTITION BY matrix_id, pos) AS p, log2(((n + 1.0) / sum(n + 1.0) OVER (PARTITION BY matrix_id, pos)) / 0.25) AS score FROM counts)"


def pssm(spark: SparkSession, d: str, key: str, m: int, anchor: str) -> DataFrame:
    return motif.pssm(motif_counts(spark, d, key, m, anchor))


def scores_sql(m: int, value: str = "score") -> str:
    """CTE each(matrix_id, v, kmer, f, b): every k-mer of the lattice against every motif, on both strands."""
    sums = lambda word: " + ".join(f"w[4 * {i} + position(substr({word}, {i + 1}, 1) IN 'ACGT')]" for i in range(m))
    return f"""w AS MATERIALIZED (SELECT matrix_id, list({value} ORDER BY pos, base) AS w FROM pssm GROUP BY matrix_id),
        each AS (SELECT matrix_id, v, kmer, {sums('kmer')} AS f, {sums("reverse(translate(kmer, 'ACGT', 'TGCA'))")} AS b FROM lattice CROSS JOIN w)"""


# --- states


def states(spark: SparkSession, d: str, m: int) -> DataFrame:
    """(v, kmer, n, r, color, score) of all k-mers: r is twice the number of occurrences over the mean number, rounded
    down; the colour is r up to 3, the score r up to 11, less 5 (whole numbers, so sums are exact)."""
    return states_of(staged(kmer.counts(texts(spark, d), "text", m, text=True), "kmers"), m)


def states_of(n: DataFrame, m: int) -> DataFrame:
    """The same from (kmer, n), which is read twice."""
    spark = n.sparkSession
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_t"))
    rows = kmer.lattice(spark, m).join(n, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0))).crossJoin(F.broadcast(total))
    r = F.when(F.col("_t") == 0, 0).otherwise(F.expr(f"n * {2 * 4**m} div _t"))
    rows = rows.withColumn("r", r.cast("long"))
    return rows.select("v", "kmer", "n", "r", F.least("r", F.lit(3)).cast("int").alias("color"), (F.least("r", F.lit(11)) - 5).cast("double").alias("score"))


def states_sql(m: int) -> str:
    """CTEs that end in st(v, kmer, n, r, color, score)."""
    return f"""{DNA_SQL}, {windows_sql(m)}, {lattice_sql(m)}, kc AS (SELECT kmer, count(*) AS n FROM win GROUP BY kmer), tot AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS t FROM kc),
        st AS MATERIALIZED (SELECT v, kmer, n, r, CAST(least(r, 3) AS INT) AS color, CAST(least(r, 11) - 5 AS DOUBLE) AS score FROM
            (SELECT v, lattice.kmer, coalesce(n, 0) AS n, CASE WHEN t = 0 THEN 0 ELSE CAST(coalesce(n, 0) * {2 * 4**m} // t AS BIGINT) END AS r FROM lattice LEFT JOIN kc USING (kmer) CROSS JOIN tot))"""


def classes_sql(m: int, suffix: int) -> str:
    """CTEs after ``st`` that end in cls(v, rep)."""
    n = 4**m
    parts = [f"c0 AS MATERIALIZED (SELECT v, min(v) OVER (PARTITION BY color, v % {4**suffix}) AS rep FROM st)"]
    for r in range(m):
        joins = " ".join(f"JOIN c{r} t{x} ON t{x}.v = (c.v * 4 + {x}) % {n}" for x in range(4))
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.v, min(c.v) OVER (PARTITION BY c.rep, t0.rep, t1.rep, t2.rep, t3.rep) AS rep FROM c{r} c {joins})")
    return f"{', '.join(parts)}, cls AS (SELECT v, rep FROM c{m})"


# --- targets


def coding_regions(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, source, seq) of every sequence with a start codon and a stop codon in its frame: from one to the other."""
    return coding.regions(texts(spark, d), "text")


CODING_SQL = f"""{DNA_SQL}, mk AS (SELECT doc_id, lang, source, seq, position('ATG' IN seq) AS first FROM dna WHERE position('ATG' IN seq) > 0),
        cd AS (SELECT doc_id, first, seq, unnest(range(1, CAST(floor((length(seq) - first - 2) / 3) AS BIGINT) + 1)) AS i FROM mk),
        sp AS (SELECT doc_id, min(i) AS i FROM cd WHERE substr(seq, first + 3 * i, 3) IN ('TAA', 'TAG', 'TGA') GROUP BY doc_id),
        cds AS MATERIALIZED (SELECT doc_id, lang, source, substr(seq, first, 3 * sp.i + 3) AS seq FROM mk JOIN sp USING (doc_id))"""


def targets(spark: SparkSession, d: str, key: str, reached: tuple[int, int]) -> DataFrame:
    """(job, seq, first, last): the consensus of each key's coding regions; whole codons of it are its coding region."""
    return targets_of(drawn(spark, d, key), reached)


def drawn(spark: SparkSession, d: str, key: str) -> DataFrame:
    """What targets, states and usage are drawn from, by one pass over the texts (``coding.drawn``)."""
    return staged(coding.drawn(texts(spark, d), "text", key), "drawn")


def targets_of(found: DataFrame, reached: tuple[int, int]) -> DataFrame:
    rows = coding.consensus(found, "job", "seq", reached)
    n = F.length("seq")
    return rows.filter("job is not null").select("job", "seq", F.when(n >= 3, 1).cast("int").alias("first"), F.when(n >= 3, n - n % 3).cast("int").alias("last"))


def targets_sql(key: str, reached: tuple[int, int]) -> str:
    """CTEs that end in tgt(job, seq, n)."""
    return f"""{CODING_SQL}, le AS (SELECT {key} AS job, pos, substr(seq, pos, 1) AS base, count(*) AS n FROM (SELECT {key}, seq, unnest(range(1, length(seq) + 1)) AS pos FROM cds WHERE {key} IS NOT NULL) GROUP BY ALL),
        al AS (SELECT {key} AS job, count(*) AS n FROM cds GROUP BY 1), co AS (SELECT job, pos, arg_min(base, (-n, base)) AS base, sum(n) AS reach FROM le GROUP BY job, pos),
        tgt AS MATERIALIZED (SELECT job, string_agg(base, '' ORDER BY pos) AS seq, count(*) AS n FROM co JOIN al USING (job) WHERE reach * {reached[1]} >= al.n * {reached[0]} GROUP BY job)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    """(codon, cost) from the frequencies of all three-letter windows, to two digits."""
    return usage_of(staged(kmer.counts(texts(spark, d), "text", 3, text=True), "codons"))


def usage_of(n: DataFrame) -> DataFrame:
    """The same from (kmer, n), which is read twice."""
    n = n.withColumnRenamed("kmer", "codon")
    total = n.agg(F.sum("n").alias("total"))
    freq = n.crossJoin(F.broadcast(total)).select("codon", (F.col("n") / F.col("total")).alias("freq"))
    return cost.usage_costs(freq).select("codon", F.round("cost", 2).alias("cost"))


USAGE_SQL = f"{windows_sql(3, 'win3')}, n3 AS (SELECT kmer AS codon, count(*) AS n FROM win3 GROUP BY kmer), u3 AS (SELECT codon, n / (SELECT sum(n) FROM n3) AS freq FROM n3), usage AS MATERIALIZED (SELECT codon, round(ln(freq) / ln((SELECT min(freq) FROM u3)), 2) AS cost FROM u3)"
_AMINO = ", ".join(f"('{c}', '{a}')" for c, a in sorted(cost.AMINO_ACIDS.items()))


def costs_sql(name: str) -> str:
    """CTEs after ``tgt`` that end in ct(job, i, cx, s, ctx, sigma, c), for every position, context and letter."""
    grid = """grid AS (SELECT job, seq, n, i, cx, s, substr('ACGT', CAST(cx // 4 + 1 AS BIGINT), 1) || substr('ACGT', CAST(cx % 4 + 1 AS BIGINT), 1) AS ctx, substr('ACGT', CAST(s + 1 AS BIGINT), 1) AS sigma, substr('AA' || seq, i, 3) AS old, CASE WHEN n >= 3 AND i <= n - n % 3 THEN CASE WHEN i = 3 THEN -3 ELSE (i - 1) % 3 + 1 END ELSE 0 END AS p
            FROM (SELECT job, seq, n, unnest(range(1, n + 1)) AS i FROM tgt) CROSS JOIN (SELECT unnest(range(0, 16)) AS cx) CROSS JOIN (SELECT unnest(range(0, 4)) AS s))"""
    if name == "exact":
        return f"{grid}, ct AS MATERIALIZED (SELECT job, i, cx, s, ctx, sigma, CAST(CASE WHEN substr(seq, i, 1) = sigma THEN 0 ELSE 1 END AS DOUBLE) AS c FROM grid)"
    return f"""{USAGE_SQL}, aa AS (SELECT * FROM (VALUES {_AMINO}) t(codon, amino)), {grid},
        ct AS MATERIALIZED (SELECT job, i, cx, s, ctx, sigma, CAST(CASE WHEN p = 0 THEN CASE WHEN substr(seq, i, 1) = sigma THEN 0 WHEN substr(seq, i, 1) || sigma IN ('AG', 'GA', 'CT', 'TC') THEN 0.5 ELSE 1 END WHEN p IN (1, 2) THEN 0 WHEN old = ctx || sigma THEN 0
            WHEN a.amino = b.amino THEN u.cost WHEN p = -3 OR a.amino = '*' OR b.amino = '*' THEN CAST('Infinity' AS DOUBLE) ELSE 500.0 + hamming(old, ctx || sigma) END AS DOUBLE) AS c
            FROM grid LEFT JOIN aa a ON a.codon = old LEFT JOIN aa b ON b.codon = ctx || sigma LEFT JOIN usage u ON u.codon = ctx || sigma)"""


def layers_sql(key: str, reached: tuple[int, int], name: str) -> str:
    """CTEs (after WITH RECURSIVE) that end in lay(job, i, v, f, b): the points of every layer of every target, by the same
    recursion layer by layer; m = 3."""
    return f"""{targets_sql(key, reached)}, {windows_sql(3)}, {lattice_sql(3)}, kc AS (SELECT kmer, count(*) AS n FROM win GROUP BY kmer), tot AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS t FROM kc),
        sc AS MATERIALIZED (SELECT v, CAST(least(CASE WHEN t = 0 THEN 0 ELSE CAST(coalesce(n, 0) * 128 // t AS BIGINT) END, 11) - 5 AS DOUBLE) AS score FROM lattice LEFT JOIN kc USING (kmer) CROSS JOIN tot), {costs_sql(name)},
        lay AS (SELECT job, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS v, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS b FROM tgt
            UNION ALL (WITH c AS (SELECT DISTINCT l.job, l.i + 1 AS i, (l.v * 4 + ct.s) % 64 AS v, l.f - ct.c AS f, l.b + CASE WHEN l.i + 1 >= 3 THEN sc.score ELSE 0 END AS b
                FROM lay l JOIN ct ON ct.job = l.job AND ct.i = l.i + 1 AND ct.cx = l.v % 16 JOIN sc ON sc.v = (l.v * 4 + ct.s) % 64 WHERE ct.c < CAST('Infinity' AS DOUBLE))
            SELECT job, i, v, f, b FROM (SELECT *, min(b) OVER (PARTITION BY job, v ORDER BY f DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM c) WHERE least IS NULL OR b < least))"""


#: CTE after ``lay``: each job's front over all states.
FRONT_SQL = "fr AS MATERIALIZED (SELECT job, f, b FROM (SELECT *, min(b) OVER (PARTITION BY job ORDER BY f DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM (SELECT DISTINCT job, f, b FROM lay JOIN tgt USING (job) WHERE i = n)) WHERE least IS NULL OR b < least)"
