"""The registered queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, hard_negatives, hash_forest, html_extract, jaccard_join, merkle, mixing, quality, secrets, sharding, substring_dedup, suffix_dedup, toxicity
from .shared import table


def tokenizer() -> tuple[str, str]:
    """The rank file and the splitting pattern that the queries use; both are parameters of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": lambda s, d: toxicity.op1(table(s, d, "documents"), table(s, d, "labels")),
        "op2_html_extraction": lambda s, d: html_extract.op2(table(s, d, "pages")),
        "op3_suffix_array_dedup": lambda s, d: suffix_dedup.op3(table(s, d, "documents")),
        "op4_nearest_neighbours": lambda s, d: hash_forest.op4(table(s, d, "embeddings")),
        "op5_substring_dedup": lambda s, d: substring_dedup.op5(table(s, d, "documents")),
        "op6_byte_level_bpe": lambda s, d: bpe.op6(table(s, d, "documents"), *tokenizer()),
        "op7_quality_rules": lambda s, d: quality.op7(table(s, d, "documents")),
        "op8_ngram_jaccard_join": lambda s, d: jaccard_join.op8(table(s, d, "documents")),
        "op9_mixing": lambda s, d: mixing.op9(table(s, d, "documents"), table(s, d, "labels")),
        "op10_sharding": lambda s, d: sharding.op10(table(s, d, "documents")),
        "op11_merkle_manifest": lambda s, d: merkle.op11(table(s, d, "documents")),
        "op12_hard_negatives": lambda s, d: hard_negatives.op12(table(s, d, "embeddings")),
        "op13_secret_scan": lambda s, d: secrets.op13(table(s, d, "documents")),
        "pipeline": pipeline,
    }


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _field_sql(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _climb_sql(name: str, rows: str, levels: int) -> str:
    """CTEs {name}0, ... of nodes (g, pos, h, n) from ``rows``, and {name}r0, ... of runs; a tree that is done stays."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT g, pos, h, n FROM {rows})"]
    for i in range(levels):
        parts.append(f"{name}r{i} AS MATERIALIZED (SELECT g, pos // 3 AS run, list(h ORDER BY pos) AS hs, any_value(n) AS n FROM {name}{i} GROUP BY g, pos // 3)")
        parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT g, run AS pos, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, CASE WHEN n = 1 THEN 1 ELSE (n + 2) // 3 END AS n FROM {name}r{i})")
    return ", ".join(parts)


def _walk_sql(name: str, tree: str, rows: str, levels: int) -> str:
    """CTEs {name}0, ...: rows (doc_id, g, pos, fold, proof) carried up the tree level by level."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT doc_id, g, pos, fold, proof FROM {rows})"]
    for i in range(levels):
        before, after = "hs[1:w.pos % 3]", "hs[w.pos % 3 + 2:]"
        parts.append(f"""{name}{i + 1} AS MATERIALIZED (SELECT doc_id, w.g, w.pos // 3 AS pos, CASE WHEN n = 1 THEN fold ELSE sha256(array_to_string({before} || [fold] || {after}, '')) END AS fold,
                CASE WHEN n = 1 THEN proof ELSE proof || array_to_string({before} || {after}, '') END AS proof FROM {name}{i} w JOIN {tree}r{i} r ON r.g = w.g AND r.run = w.pos // 3)""")
    return ", ".join(parts)


#: The CRC-32 of the decimal doc_id is even: its bits one by one, before the last complement.
_EVEN_SQL = """(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                lambda x, e: xor(xor(x, e) >> 1, (xor(x, e) & 1) * CAST(3988292384 AS BIGINT))) & 1) = 1"""


def _manifest_sql(levels: int = 12, tops: int = 7) -> str:
    """The manifest of up to 3 ** ``levels`` documents a source and 3 ** ``tops`` sources."""
    cut = "replace(text, chr(10), '')"
    return f"""
            WITH l AS MATERIALIZED (SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf_sql('text')} AS h, CASE WHEN {_EVEN_SQL} THEN {_leaf_sql(cut)} END AS other FROM documents),
            p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
            {_climb_sql('t', 'p', levels)},
            {_walk_sql('w', 't', "(SELECT doc_id, g, pos, coalesce(other, h) AS fold, '' AS proof FROM p)", levels)},
            s AS MATERIALIZED (SELECT g AS source, 0 AS g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t{levels}),
            {_climb_sql('u', 's', tops)},
            {_walk_sql('v', 'u', f"(SELECT doc_id, 0 AS g, s.pos, fold, proof FROM w{levels} w JOIN s ON s.source = w.g)", tops)}
            SELECT l.doc_id, l.h AS leaf, s.h AS subroot, u.h AS root, sha256(v.proof) AS proof_sha256, v.fold AS folded_root, v.fold = u.h AS verified
            FROM l JOIN s ON s.source = l.g JOIN v{tops} v ON v.doc_id = l.doc_id CROSS JOIN u{tops} u"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle_manifest": _manifest_sql(),
        "op12_hard_negatives": """
            WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
            p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
            SELECT p.anchor_id, positive_id, CAST(row_number() OVER near AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
            WINDOW near AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5""",
        "op5_substring_dedup": f"""
            WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
            win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
            first AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
            gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT win.doc_id, win.i FROM win JOIN first USING (t) WHERE win.doc_id > first.d) CROSS JOIN (SELECT unnest(range(0, 13)) AS j)),
            each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
            kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.p) AS t, count(*) AS n FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p WHERE gone.p IS NULL GROUP BY each.doc_id)
            SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
            FROM w LEFT JOIN kept USING (doc_id)""",
        "op8_ngram_jaccard_join": f"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
            link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
            sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
            reach AS (SELECT DISTINCT a AS x, a AS y FROM sym UNION SELECT reach.x, sym.b FROM reach JOIN sym ON reach.y = sym.a)
            SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.c, w.doc_id) AS component_id
            FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) r USING (doc_id)""",
        "op10_sharding": f"""
            WITH h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:15] AS BIGINT) AS h FROM documents),
            each AS (SELECT *, h >> (60 - depth) AS prefix FROM h CROSS JOIN (SELECT unnest(range(0, 13)) AS depth)),
            sums AS (SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM each GROUP BY depth, prefix),
            leaf AS (SELECT doc_id, min(depth) AS depth FROM each JOIN sums USING (depth, prefix) WHERE b <= {sharding.QUERY_BYTES} GROUP BY doc_id)
            SELECT each.doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth, CAST(b AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_docs, false AS oversized
            FROM each JOIN leaf USING (doc_id, depth) JOIN sums USING (depth, prefix)""",
    }
