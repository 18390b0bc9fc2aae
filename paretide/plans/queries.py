"""The queries: each operator over whole test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics, clustering, cost, kmer, machines, motif, sampling
from ..operators.skyline import skyline
from .registry import query, table

# --- skylines


def _not_dominated(src: str, x: str, y: str, keys: str = "", extra: str = "count(*) AS n") -> str:
    same = " AND ".join(f"o.{k} = p.{k}" for k in keys.split(", ") if k) or "true"
    cols = f"{keys}, {x}, {y}" if keys else f"{x}, {y}"
    points = f"(SELECT DISTINCT {cols} FROM {src})"
    return f"""SELECT {', '.join('p.' + c for c in cols.split(', '))}, {extra} FROM {src} p WHERE NOT EXISTS (
        SELECT 1 FROM {points} o WHERE {same} AND o.{x} >= p.{x} AND o.{y} <= p.{y} AND (o.{x} > p.{x} OR o.{y} < p.{y})) GROUP BY {', '.join('p.' + c for c in cols.split(', '))}"""


@query("pareto_front", _not_dominated("part", "p_retailprice", "p_size"))
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return skyline(table(spark, d, "part"), ["p_retailprice"], ["p_size"])


@query("pareto_front_by_group", _not_dominated("part", "p_retailprice", "p_size", "p_brand"))
def pareto_front_by_group(spark: SparkSession, d: str) -> DataFrame:
    return skyline(table(spark, d, "part"), ["p_retailprice"], ["p_size"], ["p_brand"], salts=4)


@query("pareto_payload_ties", _not_dominated("(SELECT CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS disc, l_linestatus, l_orderkey * 10 + l_linenumber AS line FROM lineitem)", "q", "disc", "l_linestatus", "count(*) AS n, min(line) AS first_line, max(line) AS last_line"))
def pareto_payload_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("disc"), "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    out = skyline(rows, ["q"], ["disc"], ["l_linestatus"], payload="line")
    return out.select("l_linestatus", "q", "disc", "n", F.array_min("payloads").alias("first_line"), F.array_max("payloads").alias("last_line"))


@query("skyline_two_phase", """WITH b AS (SELECT l_quantity AS q, max(l_extendedprice) AS x FROM lineitem GROUP BY 1),
    f AS (SELECT q, x, max(x) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
    SELECT l_extendedprice, l_quantity, count(*) AS n FROM lineitem JOIN f ON q = l_quantity AND x = l_extendedprice WHERE before IS NULL OR x > before GROUP BY 1, 2""")
def skyline_two_phase(spark: SparkSession, d: str) -> DataFrame:
    return skyline(table(spark, d, "lineitem"), ["l_extendedprice"], ["l_quantity"], salts=64)


# --- k-mers and motifs

#: A toy motif: counts of A, C, G, T by position.
MOTIF = {"A": (8, 1, 2), "C": (1, 7, 2), "G": (1, 1, 7), "T": (2, 3, 1)}
_COUNTS = [("toy", i, b, MOTIF[b][i]) for b in "ACGT" for i in range(3)]
_VALUES = ", ".join(f"('{m}', {i}, '{b}', {n})" for m, i, b, n in _COUNTS)
_MOTIF_SQL = f"""counts AS (SELECT * FROM (VALUES {_VALUES}) t(matrix_id, pos, base, n)),
    pssm AS (SELECT matrix_id, pos, base, (n + 1.0) / sum(n + 1.0) OVER (PARTITION BY matrix_id, pos) AS p, log2(((n + 1.0) / sum(n + 1.0) OVER (PARTITION BY matrix_id, pos)) / 0.25) AS score FROM counts)"""
_DNA_SQL = "dna AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def _windows_sql(m: int) -> str:
    return f"win AS (SELECT doc_id, pos, substr(seq, pos, {m}) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - {m} + 2)) AS pos FROM dna WHERE length(seq) >= {m}))"


def _lattice_sql(m: int) -> str:
    letters = " CROSS JOIN ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) l{i}(b{i})" for i in range(m))
    word = " || ".join(f"b{i}" for i in range(m))
    number = " + ".join(f"(position(b{i} IN 'ACGT') - 1) * {4 ** (m - 1 - i)}" for i in range(m))
    return f"lattice AS (SELECT CAST({number} AS BIGINT) AS v, {word} AS kmer FROM {letters})"


def _score_sql(word: str) -> str:
    return " + ".join(f"(SELECT score FROM pssm WHERE pos = {i} AND base = substr({word}, {i + 1}, 1))" for i in range(3))


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", kmer.dna(F.col("text")).alias("seq"))


def _weights(spark: SparkSession) -> list[dict[str, float]]:
    counts = spark.createDataFrame(_COUNTS, "matrix_id string, pos int, base string, count long")
    return motif.weights(motif.pssm(counts), "toy")


@query("kmer_window_count", f"WITH {_DNA_SQL}, {_windows_sql(4)} SELECT kmer, count(*) AS n FROM win GROUP BY kmer")
def kmer_window_count(spark: SparkSession, d: str) -> DataFrame:
    return kmer.windows(_dna(spark, d), "seq", 4).groupBy("kmer").agg(F.count("*").alias("n"))


@query("base_frequencies", f"WITH {_DNA_SQL}, e AS (SELECT CAST(pos AS INT) AS pos, kmer AS base FROM (SELECT pos, substr(seq, pos, 1) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS pos FROM dna))) SELECT pos, base, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pos), 6) AS freq FROM e GROUP BY pos, base")
def base_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return kmer.base_frequencies(_dna(spark, d), "seq").withColumn("freq", F.round("freq", 6))


_HITS_SQL = f"WITH {_MOTIF_SQL}, {_lattice_sql(3)}, s AS (SELECT kmer, greatest({_score_sql('kmer')}, {_score_sql("reverse(translate(kmer, 'ACGT', 'TGCA'))")}) AS score FROM lattice), {_DNA_SQL}, {_windows_sql(3)}, hits AS (SELECT doc_id, pos AS start, pos + 2 AS stop, kmer, score FROM win JOIN s USING (kmer) WHERE score > 2.5)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return motif.hits(_dna(spark, d), "seq", _weights(spark), 2.5)


@query("motif_hits", f"{_HITS_SQL} SELECT doc_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, kmer AS matched_sequence, round(score, 6) AS score FROM hits")
def motif_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).withColumn("score", F.round("score", 6))


@query("hits_per_doc", f"{_HITS_SQL} SELECT doc_id, count(*) AS n_hits FROM hits GROUP BY doc_id")
def hits_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_hits"))


@query("bucket_hits", f"{_HITS_SQL}, c AS (SELECT dna.doc_id, count(start) AS n FROM dna LEFT JOIN hits USING (doc_id) GROUP BY dna.doc_id) SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN (SELECT min(n) FROM c) <= 3 THEN '6+' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS n_docs FROM c GROUP BY 1")
def bucket_hits(spark: SparkSession, d: str) -> DataFrame:
    n = _dna(spark, d).select("doc_id").join(hits_per_doc(spark, d), "doc_id", "left").select(F.coalesce("n_hits", F.lit(0)).alias("n"))
    least = n.agg(F.min("n").alias("least"))
    return n.crossJoin(F.broadcast(least)).select(analytics.hit_bucket(F.col("n"), F.col("least")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n_docs"))


@query("overlapping_hits", f"{_HITS_SQL} SELECT doc_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, CAST(nxt AS INT) AS next_start FROM (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start, stop) AS nxt FROM hits) WHERE stop >= nxt")
def overlapping_hits(spark: SparkSession, d: str) -> DataFrame:
    return analytics.overlapping_neighbours(_hits(spark, d), "doc_id")


@query("pattern_occurrences", f"WITH {_DNA_SQL}, {_windows_sql(4)} SELECT kmer AS pattern, doc_id, CAST(pos AS INT) AS pos FROM win WHERE kmer IN ('ACGT', 'AAAA', 'TATA')")
def pattern_occurrences(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame([("ACGT",), ("AAAA",), ("TATA",)], "kmer string")
    return kmer.windows(_dna(spark, d), "seq", 4).join(F.broadcast(patterns), "kmer").select(F.col("kmer").alias("pattern"), "doc_id", F.col("pos").cast("int").alias("pos"))


@query("sequence_diff", f"WITH {_DNA_SQL}, p AS (SELECT doc_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, unnest(range(1, length(seq) + 1)) AS pos FROM dna) SELECT doc_id, CAST(pos AS INT) AS pos, substr(seq, pos, 1) AS from_base, substr(rc, pos, 1) AS to_base FROM p WHERE substr(seq, pos, 1) <> substr(rc, pos, 1)")
def sequence_diff(spark: SparkSession, d: str) -> DataFrame:
    return kmer.sequence_diff(_dna(spark, d).withColumn("rc", kmer.reverse_complement(F.col("seq"))).select("doc_id", "seq", "rc"), "seq", "rc")


# --- costs and coding regions

_AMINO = ", ".join(f"('{c}', '{a}')" for c, a in sorted(cost.AMINO_ACIDS.items()))
_USAGE_SQL = f"WITH {_DNA_SQL}, {_windows_sql(3)}, n AS (SELECT kmer AS codon, count(*) AS n FROM win GROUP BY kmer), u AS (SELECT codon, n / (SELECT sum(n) FROM n) AS freq FROM n), usage AS (SELECT codon, ln(freq) / ln((SELECT min(freq) FROM u)) AS cost FROM u)"


def _usage(spark: SparkSession, d: str) -> DataFrame:
    n = kmer.windows(_dna(spark, d), "seq", 3).groupBy(F.col("kmer").alias("codon")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return cost.usage_costs(n.crossJoin(F.broadcast(total)).select("codon", (F.col("n") / F.col("total")).alias("freq")))


@query("codon_usage_cost", f"{_USAGE_SQL} SELECT codon, round(cost, 6) AS cost FROM usage")
def codon_usage_cost(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("codon", F.round("cost", 6).alias("cost"))


@query("coding_cost", f"{_USAGE_SQL}, aa AS (SELECT * FROM (VALUES {_AMINO}) t(codon, amino)) SELECT a.codon AS target, b.codon AS proposed, s AS is_start, round(CASE WHEN a.codon = b.codon THEN 0.0 WHEN a.amino = b.amino THEN u.cost WHEN s OR a.amino = '*' OR b.amino = '*' THEN 999999 ELSE 500.0 + hamming(a.codon, b.codon) END, 6)::DOUBLE AS cost FROM aa a CROSS JOIN aa b CROSS JOIN (VALUES (true), (false)) t(s) LEFT JOIN usage u ON u.codon = b.codon")
def coding_cost(spark: SparkSession, d: str) -> DataFrame:
    pairs = kmer.lattice(spark, 6).select(F.substring("kmer", 1, 3).alias("target"), F.substring("kmer", 4, 3).alias("proposed"))
    pairs = pairs.join(_usage(spark, d).withColumnRenamed("codon", "proposed").withColumnRenamed("cost", "u"), "proposed", "left").withColumn("is_start", F.explode(F.array(F.lit(True), F.lit(False))))
    c = cost.coding_cost(F.col("proposed"), F.col("target"), F.col("is_start"), F.col("u"), 500.0)
    return pairs.select("target", "proposed", "is_start", F.round(F.when(c == float("inf"), 999999.0).otherwise(c), 6).alias("cost"))


@query("coding_positions", f"""WITH {_DNA_SQL}, m AS (SELECT doc_id, seq, position('ATG' IN seq) AS first FROM dna WHERE position('ATG' IN seq) > 0),
    c AS (SELECT doc_id, first, unnest(range(1, CAST(floor((length(seq) - first - 2) / 3) AS BIGINT) + 1)) AS i, seq FROM m),
    s AS (SELECT doc_id, min(i) AS i FROM c WHERE substr(seq, first + 3 * i, 3) IN ('TAA', 'TAG', 'TGA') GROUP BY doc_id)
    SELECT m.doc_id, CAST(CASE WHEN s.i IS NOT NULL THEN first END AS INT) AS first, CAST(first + 3 * s.i + 2 AS INT) AS last, CASE WHEN s.i IS NULL THEN 'no stop codon' END AS error FROM m LEFT JOIN s USING (doc_id)""")
def coding_positions(spark: SparkSession, d: str) -> DataFrame:
    marked = _dna(spark, d).filter(F.instr("seq", "ATG") > 0).select("doc_id", F.regexp_replace("seq", "^(.*?)ATG", "$1*ATG").alias("seq"))
    return marked.select("doc_id", cost.coding_positions(F.col("seq")).alias("c")).select("doc_id", F.col("c.first").cast("int").alias("first"), F.col("c.last").cast("int").alias("last"), F.col("c.error").alias("error"))


# --- samplers

_FRONT_SQL = "SELECT l_returnflag AS key, CAST(l_partkey AS BIGINT) AS id, -CAST(sum(l_quantity) AS DOUBLE) AS f, CAST(min(l_suppkey) AS DOUBLE) AS b FROM lineitem GROUP BY 1, 2"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("id")).agg((-F.sum("l_quantity")).alias("f"), F.min("l_suppkey").cast("double").alias("b"))


@query("sus_sample", f"""WITH c AS ({_FRONT_SQL}), w AS (SELECT *, power(-f / 10.0 + 1, -1.0) AS w, count(*) OVER (PARTITION BY key) AS n FROM c),
    s AS (SELECT *, sum(w) OVER (PARTITION BY key ORDER BY f DESC, b, id ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY key) / 50 AS step FROM w),
    h AS (SELECT *, floor(cum / step - 0.37) AS x, coalesce(lag(floor(cum / step - 0.37)) OVER (PARTITION BY key ORDER BY f DESC, b, id), -1) AS y FROM s)
    SELECT key, id, f, b FROM h WHERE n <= 50 OR x > y""")
def sus_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.universal(_candidates(spark, d), ["key"], "f", [F.desc("f"), F.asc("b"), F.asc("id")], 50, 1.0, 10, 0.37)


@query("ranked_sample", f"""WITH c AS ({_FRONT_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY f DESC, b, id) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM c),
    picks AS (SELECT DISTINCT key, CAST(round_even(power(j / 19.0, a) * (n - 1), 0) AS BIGINT) AS r FROM (SELECT DISTINCT key, n FROM r) CROSS JOIN (SELECT unnest(range(0, 20)) AS j) CROSS JOIN (VALUES (1.0), (2.0)) t(a))
    SELECT key, id, f, b FROM (SELECT r.*, row_number() OVER (PARTITION BY key ORDER BY r.r) AS k FROM r JOIN picks USING (key, r)) WHERE k <= 40""")
def ranked_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.ranked(_candidates(spark, d), ["key"], [F.desc("f"), F.asc("b"), F.asc("id")], 40, [1.0, 2.0], [0.5, 0.5])


# --- machines and colours


#: Traces from a table: for each brand the error grows as states go.
_STEPS_SQL = "SELECT p_brand AS fsm_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS step, CAST(101 - row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS n_states, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) / 100.0 AS mse FROM part"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("p_brand").orderBy("p_partkey")
    at = F.row_number().over(own)
    return table(spark, d, "part").select(F.col("p_brand").alias("fsm_id"), at.alias("step"), (101 - at).alias("n_states"), (F.sum("p_size").over(own) / 100.0).alias("mse"))


@query("reduction_efficiency", f"SELECT fsm_id, round(1 - max(CASE WHEN n_states = 80 THEN mse END) / arg_min(mse, n_states), 9) AS efficiency FROM ({_STEPS_SQL}) GROUP BY fsm_id")
def reduction_efficiency(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.reduction_efficiency(_steps(spark, d), "fsm_id", 6400)
    return out.select("fsm_id", F.round("efficiency", 9).alias("efficiency"))


@query("picked_reductions", f"""WITH RECURSIVE t AS ({_STEPS_SQL}),
    scan AS (SELECT fsm_id, step, n_states, mse, 100 AS last_n, CAST(0 AS DOUBLE) AS last_mse, CAST(NULL AS INT) AS pick FROM t WHERE step = 1
        UNION ALL SELECT t.fsm_id, t.step, t.n_states, t.mse, CASE WHEN t.mse - s.last_mse >= 2.0 AND 1 - t.n_states / s.last_n >= 0.1 THEN s.n_states ELSE s.last_n END,
            CASE WHEN t.mse - s.last_mse >= 2.0 AND 1 - t.n_states / s.last_n >= 0.1 THEN s.mse ELSE s.last_mse END, CASE WHEN t.mse - s.last_mse >= 2.0 AND 1 - t.n_states / s.last_n >= 0.1 THEN s.step END
        FROM scan s JOIN t ON t.fsm_id = s.fsm_id AND t.step = s.step + 1)
    SELECT t.fsm_id, t.step, t.n_states, round(t.mse, 6) AS mse FROM scan s JOIN t ON t.fsm_id = s.fsm_id AND t.step = s.pick""")
def picked_reductions(spark: SparkSession, d: str) -> DataFrame:
    return machines.pick_reductions(_steps(spark, d), 100, 2.0, 0.1).withColumn("mse", F.round("mse", 6))


_MAPS_SQL = "SELECT CAST(p_partkey AS BIGINT) AS v, CAST(min(p_partkey) OVER (PARTITION BY p_brand) AS BIGINT) AS x, CAST(min(p_partkey) OVER (PARTITION BY p_size) AS BIGINT) AS y FROM part"


def _maps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    rep = lambda c: part.select(F.col("p_partkey").cast("long").alias("v"), F.min("p_partkey").over(Window.partitionBy(c)).cast("long").alias("rep"))
    return rep("p_brand"), rep("p_size")


@query("reduction_comparison", f"SELECT x AS first, y AS second, count(*) AS n, array_to_string(list_sort(list(v)), ',') AS members FROM ({_MAPS_SQL}) GROUP BY x, y")
def reduction_comparison(spark: SparkSession, d: str) -> DataFrame:
    return clustering.compare_reductions(*_maps(spark, d)).withColumn("members", F.array_join("members", ","))


@query("reduction_diff", f"""WITH m AS ({_MAPS_SQL}), p AS (SELECT x, y, count(*) AS n, list_sort(list(v)) AS vs FROM m GROUP BY x, y),
    a AS (SELECT m.v, string_agg(p.y || ':' || array_to_string(p.vs, ','), ';' ORDER BY p.y) AS t FROM m JOIN p ON p.x = m.x AND p.y <> m.y GROUP BY m.v),
    b AS (SELECT m.v, string_agg(p.x || ':' || array_to_string(p.vs, ','), ';' ORDER BY p.x) AS t FROM m JOIN p ON p.y = m.y AND p.x <> m.x GROUP BY m.v)
    SELECT m.v, m.x AS first, m.y AS second, array_to_string(p.vs, ',') AS shared, coalesce(a.t, '') AS only_first, coalesce(b.t, '') AS only_second FROM m JOIN p ON p.x = m.x AND p.y = m.y LEFT JOIN a ON a.v = m.v LEFT JOIN b ON b.v = m.v""")
def reduction_diff(spark: SparkSession, d: str) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["other"].cast("string"), F.lit(":"), F.array_join(x["members"], ","))), ";")
    return clustering.reduction_diff(*_maps(spark, d), [F.array_join("shared", ",").alias("shared"), line("only_first").alias("only_first"), line("only_second").alias("only_second")])


def _optimal_sql(points: str, k: int) -> str:
    """CTEs that end in cut(key, bin, first, last): ranks of the best split of points(key, x, w) into k runs."""
    parts = [f"pts AS ({points})", "num AS (SELECT key, x, w, row_number() OVER (PARTITION BY key ORDER BY x) AS r, count(*) OVER (PARTITION BY key) AS n FROM pts)",
        "cum AS (SELECT key, r, n, sum(w) OVER q AS w, sum(w * x) OVER q AS wx, sum(w * x * x) OVER q AS wxx FROM num WINDOW q AS (PARTITION BY key ORDER BY r) UNION ALL SELECT DISTINCT key, 0, n, 0, 0, 0 FROM num)",
        "run AS (SELECT a.key, a.r AS i, b.r AS j, a.n, greatest(b.wxx - a.wxx - (b.wx - a.wx) * (b.wx - a.wx) / (b.w - a.w), 0) AS sse FROM cum a JOIN cum b ON a.key = b.key AND b.r > a.r)",
        "d1 AS (SELECT key, j, n, sse AS cost, 0 AS cut FROM run WHERE i = 0)"]
    for c in range(2, k + 1):
        parts.append(f"d{c} AS (SELECT r.key, r.j, r.n, min(p.cost + r.sse) AS cost, arg_min(r.i, (p.cost + r.sse, r.i)) AS cut FROM d{c - 1} p JOIN run r ON r.key = p.key AND r.i = p.j GROUP BY r.key, r.j, r.n)")
    parts.append(f"e{k} AS (SELECT key, cut AS first, j AS last FROM d{k} WHERE j = n)")
    parts += [f"e{c} AS (SELECT d.key, d.cut AS first, d.j AS last FROM d{c} d JOIN e{c + 1} e ON d.key = e.key AND d.j = e.first)" for c in range(k - 1, 0, -1)]
    parts.append("cut AS (" + " UNION ALL ".join(f"SELECT key, {c - 1} AS bin, first, last FROM e{c}" for c in range(1, k + 1)) + ")")
    return ", ".join(parts)


@query("kmeans_1d", f"WITH {_optimal_sql('SELECT p_brand AS key, round(p_retailprice / 10) AS x, count(*) AS w FROM part GROUP BY 1, 2', 4)} SELECT p.key AS p_brand, CAST(bin AS INT) AS color, CAST(sum(w) AS BIGINT) AS n, min(x) AS least, max(x) AS most FROM num p JOIN cut c ON p.key = c.key AND p.r > c.first AND p.r <= c.last GROUP BY 1, 2")
def kmeans_1d(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.round(F.col("p_retailprice") / 10).alias("x"))
    return clustering.kmeans_1d(rows, "p_brand", "x", 4).groupBy("p_brand", "color").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))


_SIGNED_SQL = "SELECT {key} AS key, CAST(p_size - 20 AS DOUBLE) AS x, count(*) AS w FROM part WHERE p_size - 20 {sign} 0 GROUP BY 1, 2"


def _polar_sql(k: int) -> str:
    report = "SELECT CAST(bin + {add} AS INT) AS color, CAST(sum(w) AS BIGINT) AS n, min(x) AS least, max(x) AS most FROM num p JOIN cut c ON p.key = c.key AND p.r > c.first AND p.r <= c.last GROUP BY 1"
    low, high = (f"(WITH {_optimal_sql(_SIGNED_SQL.format(key=0, sign=sign), n)} {report.format(add=add)})" for sign, n, add in (("<", k // 3, 0), (">=", k - k // 3, k // 3)))
    return f"SELECT * FROM {low} UNION ALL SELECT * FROM {high}"


@query("kmeans_polar", _polar_sql(6))
def kmeans_polar(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.lit(0).alias("k"), (F.col("p_size") - 20).cast("double").alias("x"))
    return clustering.bin_report(clustering.kmeans_polar(rows, "k", "x", 6), "x", "color")


@query("kmeans_lloyd")
def kmeans_lloyd(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.lit(0).alias("k"), F.col("p_size").cast("double").alias("x"))
    return clustering.bin_report(clustering.partition(rows, "k", "x", 3, "kmeans"), "x", "color")


@query("split_and_join_partitions")
def split_and_join_partitions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.lit(0).alias("k"), F.col("p_size").cast("double").alias("x"))
    split, _ = clustering.partition_to_colors(rows, "k", "x", 5, origin=3)
    return clustering.bin_report(clustering.join_partitions(split, "x", "color", 2), "x", "color")


@query("partition_baseline", f"WITH {_optimal_sql('SELECT 0 AS key, CAST(p_size AS DOUBLE) AS x, count(*) AS w FROM part GROUP BY 1, 2', 4)} SELECT CAST(bin AS INT) AS color, CAST(sum(w) AS BIGINT) AS n, min(x) AS least, max(x) AS most FROM num p JOIN cut c ON p.r > c.first AND p.r <= c.last GROUP BY 1 UNION ALL SELECT 4, 0, NULL, NULL")
def partition_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.lit(0).alias("k"), F.col("p_size").cast("double").alias("x"))
    _, baseline = clustering.partition_to_colors(rows, "k", "x", 4, origin=6)
    return clustering.full_bin_report(baseline, "x", "color", 5)


_COLORS_SQL = "SELECT l_linenumber AS k, floor(l_quantity / 10) AS color, floor(l_quantity / 7) AS other, l_quantity AS x FROM lineitem"


def _colors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), F.floor(F.col("l_quantity") / 10).alias("color"), F.floor(F.col("l_quantity") / 7).alias("other"), F.col("l_quantity").alias("x"))


@query("coloring_sse", f"SELECT round(sum(s), 3) AS sse FROM (SELECT count(*) * var_pop(x) AS s FROM ({_COLORS_SQL}) GROUP BY color)")
def coloring_sse(spark: SparkSession, d: str) -> DataFrame:
    return clustering.partition_sse(_colors(spark, d), "x", "color").select(F.round("sse", 3).alias("sse"))


@query("bin_report", f"SELECT CAST(color AS BIGINT) AS color, count(*) AS n, min(x) AS least, max(x) AS most FROM ({_COLORS_SQL}) GROUP BY color")
def bin_report(spark: SparkSession, d: str) -> DataFrame:
    return clustering.bin_report(_colors(spark, d), "x", "color")


@query("contingency_matrix", f"SELECT CAST(color AS BIGINT) AS color, CAST(other AS BIGINT) AS other, count(*) AS n FROM ({_COLORS_SQL}) GROUP BY color, other")
def contingency_matrix(spark: SparkSession, d: str) -> DataFrame:
    return clustering.contingency(_colors(spark, d), "color", "other")


@query("partition_mismatch", f"SELECT CAST(count(*) FILTER (WHERE color <> other) AS BIGINT) AS n_mismatch, count(*) AS n FROM ({_COLORS_SQL})")
def partition_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return clustering.mismatches(_colors(spark, d), "color", "other")


@query("adjacent_eps_pairs", "WITH s AS (SELECT CAST(p_partkey AS BIGINT) AS v, p_brand, p_retailprice AS x, p_size % 3 AS c FROM part), l AS (SELECT *, lead(v) OVER w AS b, lead(x) OVER w AS nx, lead(c) OVER w AS nc FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY x, v)) SELECT p_brand, v AS a, b FROM l WHERE nx - x <= 2.0 AND nc <> c")
def adjacent_eps_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("v"), "p_brand", F.col("p_retailprice").alias("x"), (F.col("p_size") % 3).alias("c"))
    return analytics.close_pairs(rows, "p_brand", "x", "c", 2.0)


@query("eps_runs", """WITH RECURSIVE s AS (SELECT CAST(p_partkey AS BIGINT) AS v, p_brand, p_retailprice AS x, CAST(p_size % 10 AS INT) AS rep, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part),
    scan AS (SELECT p_brand, r, v, rep, x, 0 AS run, [rep] AS reps FROM s WHERE r = 1
        UNION ALL SELECT s.p_brand, s.r, s.v, s.rep, s.x, c.run + CASE WHEN s.x - c.x > 2.0 OR list_contains(c.reps, s.rep) THEN 1 ELSE 0 END, CASE WHEN s.x - c.x > 2.0 OR list_contains(c.reps, s.rep) THEN [s.rep] ELSE list_append(c.reps, s.rep) END
        FROM scan c JOIN s ON s.p_brand = c.p_brand AND s.r = c.r + 1)
    SELECT p_brand, CAST(run AS INT) AS run, v, rep FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, run) AS n FROM scan) WHERE n > 1""")
def eps_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("v"), "p_brand", F.col("p_retailprice").alias("x"), (F.col("p_size") % 10).cast("int").alias("rep"))
    return analytics.close_runs(rows, "p_brand", "x", "rep", 2.0)


# --- analytics


@query("five_number_summary", "SELECT event_type, quantile_cont(value, 0) AS least, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 1) AS most FROM (SELECT event_type, round(value, 6) AS value FROM events) GROUP BY event_type".replace("quantile_cont(value, ", "round(quantile_cont(value, ").replace(") AS", "), 6) AS").replace("round(value, 6), 6)", "round(value, 6)"))
def five_number_summary(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.five_numbers(table(spark, d, "events").withColumn("value", F.round("value", 6)), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 6).alias("r"), "n")


@query("histogram", "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CAST(least(floor((l_quantity - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) AS n FROM lineitem CROSS JOIN e GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return analytics.histogram(table(spark, d, "lineitem"), "l_quantity", 20)


@query("bucket_counts", "SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 1 ELSE 2 END AS bucket, count(*) AS n FROM lineitem WHERE l_quantity < 50 GROUP BY 1")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.bucket_counts(table(spark, d, "lineitem"), "l_quantity", [0, 10, 30, 50])


@query("mean_std_by_group", "SELECT p_size, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS std, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_size")
def mean_std_by_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.stddev_pop("p_retailprice"), 4).alias("std"), F.countDistinct("p_brand").alias("n_brands"))


_TRACE_SQL = "SELECT p_brand AS k, p_size AS step, 100 - p_size AS n_states, CAST(min(p_retailprice) AS DOUBLE) AS mse FROM part GROUP BY 1, 2"


@query("nearest_mse_lookup", f"WITH t AS ({_TRACE_SQL}), i AS (SELECT p_partkey, p_brand AS k, p_retailprice AS x FROM part), r AS (SELECT p_partkey, x, step, mse, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(mse - x), step) AS r FROM i JOIN t USING (k)) SELECT p_partkey, x, step AS near_step, mse AS near_mse FROM r WHERE r = 1")
def nearest_mse_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    trace = part.groupBy(F.col("p_brand").alias("k"), F.col("p_size").alias("step")).agg(F.min("p_retailprice").alias("mse"))
    items = part.select("p_partkey", F.col("p_brand").alias("k"), F.col("p_retailprice").alias("x"))
    return analytics.nearest(items, "x", trace, ["k"], "mse", "step").select("p_partkey", "x", "near_step", "near_mse")


@query("trace_lookup", f"WITH t AS ({_TRACE_SQL}) SELECT a.k, a.step, a.mse, b.mse AS other_mse, round(100 * (1 - CAST(a.step AS DOUBLE) / a.n_states), 3) AS gain FROM t a JOIN t b ON a.k = b.k AND a.step = b.n_states")
def trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").groupBy(F.col("p_brand").alias("k"), F.col("p_size").alias("step")).agg(F.min("p_retailprice").alias("mse")).withColumn("n_states", 100 - F.col("step"))
    other = t.select("k", F.col("n_states").alias("step"), F.col("mse").alias("other_mse"))
    both = analytics.matched_exactly(t.join(other.select("k", "step"), ["k", "step"], "left_semi"), other, ["k", "step"])
    return both.select("k", "step", "mse", "other_mse", analytics.efficiency_gain(F.col("n_states"), F.col("step")).alias("gain"))


@query("bed_projection", "WITH h AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, l_orderkey * 1000 AS rs, l_orderkey * 1000 + 900 AS re, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS st, l_linenumber * 10 AS start, l_linenumber * 10 + 7 AS stop, l_quantity AS score, l_orderkey FROM lineitem) SELECT chrom, CASE WHEN st = 1 THEN rs + start - 1 ELSE re - stop + 1 END - 1 AS start, CASE WHEN st = 1 THEN rs + stop - 1 ELSE re - start + 1 END AS end, 'x' AS name, CAST(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1000 ELSE trunc((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) * 1000) END AS INT) AS score, '+' AS strand FROM h WINDOW w AS (PARTITION BY l_orderkey)")
def bed_projection(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    hits = li.select("l_orderkey", F.col("l_suppkey").cast("string").alias("chrom"), (F.col("l_orderkey") * 1000).alias("region_start"), (F.col("l_orderkey") * 1000 + 900).alias("region_end"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("region_strand"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 7).alias("stop"), F.col("l_quantity").alias("score"), F.lit("x").alias("matched_sequence"), F.lit("+").alias("strand"))
    return analytics.bed(hits, ["l_orderkey"])


_GENES_SQL = "SELECT CAST(n_nationkey % 5 AS VARCHAR) AS chrom, o_orderkey AS gene_id, 1 + (o_orderkey * 7919) % 9000000 AS start, 1 + (o_orderkey * 7919) % 9000000 + o_custkey * 50 AS \"end\" FROM orders JOIN nation ON n_nationkey = o_orderkey % 25"
_CHROMS_SQL = "SELECT CAST(r_regionkey AS VARCHAR) AS chrom, CAST(2500000 + r_regionkey * 1750000 AS BIGINT) AS length FROM region"


def _chromosomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("chrom"), (F.col("r_regionkey") * 1750000 + 2500000).cast("long").alias("length"))


@query("region_chunks", f"WITH c AS ({_CHROMS_SQL}) SELECT chrom, s AS chunk_start, least(s + 999999, length) AS chunk_end FROM (SELECT chrom, length, unnest(range(1, length + 1, 1000000)) AS s FROM c)")
def region_chunks(spark: SparkSession, d: str) -> DataFrame:
    return analytics.region_chunks(_chromosomes(spark, d))


@query("gene_chunk_overlap", f"WITH c AS ({_CHROMS_SQL}), k AS (SELECT chrom, s, least(s + 999999, length) AS e FROM (SELECT chrom, length, unnest(range(1, length + 1, 1000000)) AS s FROM c)), g AS ({_GENES_SQL}) SELECT DISTINCT g.chrom, g.gene_id, g.start, g.\"end\" FROM g JOIN k ON g.chrom = k.chrom AND g.start <= k.e AND g.\"end\" >= k.s")
def gene_chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    start = F.lit(1) + (F.col("o_orderkey") * 7919) % 9000000
    genes = table(spark, d, "orders").select((F.col("o_orderkey") % 25 % 5).cast("string").alias("chrom"), F.col("o_orderkey").alias("gene_id"), start.alias("start"), (start + F.col("o_custkey") * 50).alias("end"))
    chunks = region_chunks(spark, d)
    ends = chunks.groupBy("chrom").agg(F.max("chunk_end").alias("_e"))
    return analytics.genes_in_chunks(chunks, genes.join(F.broadcast(ends), "chrom").filter("start <= _e").drop("_e")).select("chrom", "gene_id", "start", "end")


@query("region_flanks", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN greatest(1, p_partkey - 100) ELSE greatest(1, p_partkey - 50) END AS start, p_partkey + 30 + CASE WHEN p_size % 2 = 0 THEN 50 ELSE 100 END AS \"end\" FROM part")
def region_flanks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("start"), (F.col("p_partkey") + 30).alias("end"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("strand"))
    return analytics.extended(rows, 100, 50).select("p_partkey", "start", "end")


@query("rank_cooccurrence", "WITH d AS (SELECT p_brand AS c, p_size % 7 AS r FROM part) SELECT a.r AS a, b.r AS b, count(*) AS n FROM d a JOIN d b USING (c) GROUP BY 1, 2")
def rank_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return clustering.rank_cooccurrence(table(spark, d, "part").select("p_brand", (F.col("p_size") % 7).alias("r")), "p_brand", "r")


@query("prefix_cluster", """WITH RECURSIVE s AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY encode(p_name), p_partkey) AS r FROM part),
    l AS (SELECT *, lead(p_name) OVER (PARTITION BY p_brand ORDER BY r) AS nxt FROM s),
    c AS (SELECT p_brand, p_name, r, CASE WHEN size > 0 AND size >= 0.6 * least(length(p_name), length(nxt)) THEN left(p_name, size) ELSE '' END AS own FROM
        (SELECT *, coalesce(list_max(list_filter(range(0, least(length(p_name), length(nxt)) + 1), lambda k: left(p_name, k) = left(nxt, k))), 0) AS size FROM l)),
    scan AS (SELECT p_brand, r, p_name, own AS common, CASE WHEN own = '' THEN -1 ELSE 0 END AS cluster, CASE WHEN own = '' THEN 0 ELSE 1 END AS used FROM c WHERE r = 1
        UNION ALL SELECT c.p_brand, c.r, c.p_name, CASE WHEN w.common <> '' AND starts_with(c.p_name, w.common) THEN w.common ELSE c.own END,
            CASE WHEN w.common <> '' AND starts_with(c.p_name, w.common) THEN w.cluster WHEN c.own = '' THEN -1 ELSE w.used END, CASE WHEN (w.common <> '' AND starts_with(c.p_name, w.common)) OR c.own = '' THEN w.used ELSE w.used + 1 END
        FROM scan w JOIN c ON c.p_brand = w.p_brand AND c.r = w.r + 1)
    SELECT p_brand, p_name, CAST(cluster AS INT) AS cluster FROM scan""")
def prefix_cluster(spark: SparkSession, d: str) -> DataFrame:
    return clustering.prefix_clusters(table(spark, d, "part"), "p_brand", "p_name", 0.6)


_NUMBERED_SQL = f"WITH c AS ({_FRONT_SQL}), r AS (SELECT key, CAST(id AS VARCHAR) AS seq, f, b, CAST(abs(b) AS BIGINT) % 9 AS hits FROM c), n AS (SELECT *, printf('%03d', row_number() OVER (PARTITION BY key ORDER BY f DESC, b, seq)) AS id FROM r)"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).select("key", F.col("id").cast("string").alias("seq"), "f", "b", (F.abs("b").cast("long") % 9).alias("hits"))
    return analytics.numbered(rows, ["key"], "f")


@query("numbered_solutions", f"{_NUMBERED_SQL} SELECT key, id, seq, f, b, hits, greatest(0.0, -f) AS cost FROM n")
def numbered_solutions(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("key", "id", "seq", "f", "b", "hits", "cost")


@query("fewest_hits", f"{_NUMBERED_SQL} SELECT key, arg_min(id, hits * 1000000 + CAST(id AS BIGINT)) AS id, min(hits) AS n_hits FROM n GROUP BY key")
def fewest_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _numbered(spark, d).withColumn("place", F.col("id").cast("long"))
    return analytics.fewest_hits(rows, ["key"], "hits", "place")


@query("substitution_listing", "WITH c AS (SELECT o_orderkey AS id, list(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END ORDER BY l_linenumber, l_partkey, l_quantity) AS costs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT id, CAST(p AS INT) AS pos, costs[p] AS cost FROM (SELECT id, costs, unnest(range(1, len(costs) + 1)) AS p FROM c) WHERE costs[p] > 0")
def substitution_listing(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.lit(0.0))
    costs = both.groupBy(F.col("o_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", value.alias("c")))).alias("s"))
    return analytics.substitutions(costs.select("id", F.transform("s", lambda x: x["c"]).alias("costs")), "costs")


@query("codon_contexts", "SELECT p_partkey, CAST(floor((p_partkey % 100 - 7) / 3.0) * 3 + 7 AS BIGINT) AS context, CASE WHEN p_partkey % 100 BETWEEN 7 AND 60 THEN CASE WHEN p_partkey % 100 = 9 THEN -3 ELSE (p_partkey % 100 - 7) % 3 + 1 END ELSE 0 END AS codon_pos FROM part")
def codon_contexts(spark: SparkSession, d: str) -> DataFrame:
    pos = F.col("p_partkey") % 100
    return table(spark, d, "part").select("p_partkey", analytics.codon_context(pos, F.lit(7)).cast("long").alias("context"), cost.codon_position(pos, F.lit(7), F.lit(60)).alias("codon_pos"))


@query("plot_bounds", "SELECT round_even(max(l_quantity) * 1.05, -1) AS x_max, round_even(min(l_extendedprice) - 0.05 * (max(l_extendedprice) - min(l_extendedprice)), -1) AS y_min, round_even(max(l_extendedprice) + 0.05 * (max(l_extendedprice) - min(l_extendedprice)), -1) AS y_max FROM lineitem")
def plot_bounds(spark: SparkSession, d: str) -> DataFrame:
    return analytics.plot_bounds(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("run_spans", "WITH s AS (SELECT p_partkey, p_size % 2 AS x FROM part), l AS (SELECT *, CASE WHEN x = lag(x) OVER (ORDER BY p_partkey) THEN 0 ELSE 1 END AS n FROM s), g AS (SELECT *, sum(n) OVER (ORDER BY p_partkey) AS g FROM l) SELECT x, min(p_partkey) AS first, count(*) AS rows FROM g GROUP BY g, x")
def run_spans(spark: SparkSession, d: str) -> DataFrame:
    return analytics.run_spans(table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2).alias("x")), "p_partkey", "x")
