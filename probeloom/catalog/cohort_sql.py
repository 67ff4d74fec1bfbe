"""SQL counterparts of the cohort queries, for the driver's tables."""

from __future__ import annotations

from probeloom.sources.digests import sql_checksum

# Shared table expressions.
ENTITIES = """
ents AS (
  SELECT CAST(doc_id AS VARCHAR) AS entity_id, {label} AS label, CAST(doc_id % 4 AS VARCHAR) AS grp
  FROM documents
)"""
LANG = ENTITIES.format(label="lang")
LANG_SOURCE = ENTITIES.format(label="lang || '_' || source")
NONE_LISTED = "ids AS (SELECT CAST(NULL AS VARCHAR) AS entity_id WHERE false)"
TOXIC_LISTED = "ids AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS entity_id FROM labels WHERE toxic = 1)"
SPLIT = """
flagged AS (SELECT e.*, i.entity_id IS NOT NULL AS listed FROM ents e LEFT JOIN ids i USING (entity_id)),
stage AS (
  SELECT label, count(*) AS original, count(*) FILTER (WHERE NOT listed) AS after_listed FROM flagged GROUP BY label
),
ranked AS (
  SELECT f.entity_id, f.label, f.grp, s.after_listed AS n,
         row_number() OVER (PARTITION BY f.label ORDER BY md5('42:' || f.entity_id), f.entity_id) AS rn
  FROM flagged f JOIN stage s USING (label) WHERE NOT f.listed AND s.after_listed >= 30
),
sized AS (
  SELECT *, n * 70 // 100 AS f1, n * 15 // 100 AS f2, n - n * 70 // 100 - 2 * (n * 15 // 100) AS spare,
         n * 70 % 100 >= n * 15 % 100 AS train_first
  FROM ranked
),
cut AS (
  SELECT *, f1 + CASE WHEN train_first AND spare >= 1 THEN 1 ELSE 0 END AS n_train,
         f2 + CASE WHEN (train_first AND spare >= 2) OR (NOT train_first AND spare >= 1) THEN 1 ELSE 0 END AS n_val
  FROM sized
),
manifest AS (
  SELECT entity_id, label, grp,
         CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'validation' ELSE 'test' END AS split
  FROM cut
)"""
TEXT_SPLIT = f"{LANG_SOURCE}, {TOXIC_LISTED}, {SPLIT}"
LANG_SPLIT = f"{LANG}, {NONE_LISTED}, {SPLIT}"
TOKENS = """
occ AS (
  SELECT CAST(doc_id AS VARCHAR) AS entity_id, CAST(doc_id % 4 AS VARCHAR) AS grp,
         unnest(string_split(text, ' ')) AS feature_id
  FROM documents
),
counts AS (SELECT entity_id, grp, feature_id, count(*) AS cnt FROM occ WHERE feature_id <> '' GROUP BY ALL),
totals AS (SELECT entity_id, sum(cnt) AS total FROM counts GROUP BY entity_id),
logs AS (
  SELECT c.entity_id, c.grp, c.feature_id, ln(1 + c.cnt * 10000.0::DOUBLE / t.total) AS x
  FROM counts c JOIN totals t USING (entity_id)
)"""
RETAIL = """
retail AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, CAST(l_partkey AS VARCHAR) AS feature_id,
         CAST(sum(l_quantity) AS BIGINT) AS cnt
  FROM lineitem GROUP BY l_orderkey, l_partkey
)"""
RETAIL_ENTITIES = """
ents AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, c_mktsegment AS label, r_name AS grp
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
# Order-independent sum: whole numbers of 2^-20 and of 2^-44 below them.
EXACT = "(sum(CAST(floor({x} * 1048576) AS BIGINT)){w}::DOUBLE / 1048576 + sum(CAST(floor(({x} * 1048576 - floor({x} * 1048576)) * 16777216 + 0.5) AS BIGINT)){w}::DOUBLE / 17592186044416)"


def exact(x: str, where: str = "") -> str:
    return EXACT.format(x=x, w=f" FILTER (WHERE {where})" if where else "")


FITTED = """
train_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM manifest WHERE split = 'train'),
stats AS (
  SELECT feature_id, s1 / n AS mean, greatest(s2 / n - (s1 / n) * (s1 / n), 0) AS variance FROM (
    SELECT feature_id, n, """ + exact("x") + " AS s1, " + exact("(x * x)") + """ AS s2
    FROM logs JOIN manifest USING (entity_id), train_n WHERE split = 'train' GROUP BY feature_id, n)
),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY variance DESC, feature_id) AS place
    FROM stats WHERE variance > 1e-12
  ) WHERE place <= {n}
),
fitted AS (
  SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS out_pos, mean, sqrt(variance) AS scale, variance
  FROM top
)"""
FOLD_STATS = """
n AS (SELECT grp, count(*) AS n FROM ents GROUP BY grp),
folds AS (SELECT a.grp AS outer_grp, CAST(sum(b.n) AS DOUBLE) AS n FROM n a JOIN n b ON a.grp <> b.grp GROUP BY a.grp),
t AS (
  SELECT outer_grp, feature_id, n, coalesce(""" + exact("x", "grp <> outer_grp") + """, 0) AS s1,
         coalesce(""" + exact("(x * x)", "grp <> outer_grp") + """, 0) AS s2
  FROM logs CROSS JOIN folds GROUP BY ALL),
fold_stats AS (
  SELECT outer_grp, feature_id, s1 / n AS mean, greatest(s2 / n - (s1 / n) * (s1 / n), 0) AS variance FROM t
)"""
VOCABULARY = """
{name} AS (
  SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS pos FROM (
    SELECT DISTINCT unnest(string_split(text, ' ')) AS feature_id FROM {table}
  ) WHERE feature_id <> ''
)"""
PANEL = (
    VOCABULARY.format(name="vocab", table="documents") + "," + VOCABULARY.format(name="panel", table="benchmark") + """,
mapping AS (
  SELECT p.pos AS panel_pos, md5(p.feature_id) AS panel_id, p.feature_id AS feature_name,
         v.pos IS NOT NULL AS present, coalesce(v.pos, -1) AS feature_index, 'benchmark' AS mapping_source
  FROM panel p LEFT JOIN vocab v USING (feature_id)
)"""
)
MEMBERSHIP = """
SELECT '{pair}' AS pair, count(*) FILTER (WHERE e.id IS NOT NULL AND a.id IS NOT NULL) AS n_matched,
       count(*) FILTER (WHERE a.id IS NULL) AS n_missing, count(*) FILTER (WHERE e.id IS NULL) AS n_extra
FROM (SELECT doc_id AS id FROM documents) e FULL JOIN (SELECT {key} AS id FROM {table}) a ON e.id = a.id"""

SQL = {
    "token_counts": f"WITH {TOKENS} SELECT entity_id, feature_id, cnt FROM counts",
    "library_size": f"""WITH {RETAIL}
        SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total,
               count(cnt) AS n_features
        FROM orders LEFT JOIN retail ON CAST(o_orderkey AS VARCHAR) = entity_id GROUP BY o_orderkey""",
    "log_normalized": f"WITH {TOKENS} SELECT entity_id, feature_id, round(x, 6) AS x FROM logs",
    "log_normalized_retail": f"""WITH {RETAIL}, totals AS (SELECT entity_id, sum(cnt) AS total FROM retail GROUP BY 1)
        SELECT entity_id, feature_id, round(ln(1 + cnt * 10000.0::DOUBLE / total), 6) AS x
        FROM retail JOIN totals USING (entity_id)""",
    "summed_duplicates": f"WITH {RETAIL} SELECT * FROM retail",
    "stratified_split": f"WITH {TEXT_SPLIT} SELECT * FROM manifest",
    "stratified_split_retail": f"WITH {RETAIL_ENTITIES}, {NONE_LISTED}, {SPLIT} SELECT * FROM manifest",
    "split_exclusions": f"""WITH {TEXT_SPLIT}
        SELECT f.entity_id, f.label, f.grp,
               CASE WHEN listed THEN 'listed' ELSE 'label_below_minimum' END AS reason
        FROM flagged f JOIN stage s USING (label) WHERE listed OR after_listed < 30""",
    "split_contingency": f"""WITH {TEXT_SPLIT}
        SELECT label, count(*) FILTER (WHERE split = 'train') AS train,
               count(*) FILTER (WHERE split = 'validation') AS validation,
               count(*) FILTER (WHERE split = 'test') AS test, count(*) AS total
        FROM manifest GROUP BY label""",
    "class_stage_counts": f"""WITH {TEXT_SPLIT}
        SELECT label, original, after_listed,
               CASE WHEN after_listed >= 30 THEN after_listed ELSE 0 END AS retained FROM stage""",
    "nested_samples": f"""WITH {LANG},
        r AS (SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) AS rn FROM ents)
        SELECT entity_id, CAST(CASE WHEN rn <= 50 THEN 50 WHEN rn <= 100 THEN 100 ELSE 200 END AS BIGINT) AS smallest
        FROM r WHERE rn <= 200""",
    "label_by_group": f"""WITH {RETAIL_ENTITIES}
        SELECT coalesce(label, 'Total') AS label,
               count(*) FILTER (WHERE grp = 'AFRICA') AS "AFRICA", count(*) FILTER (WHERE grp = 'AMERICA') AS "AMERICA",
               count(*) FILTER (WHERE grp = 'ASIA') AS "ASIA", count(*) FILTER (WHERE grp = 'EUROPE') AS "EUROPE",
               count(*) FILTER (WHERE grp = 'MIDDLE EAST') AS "MIDDLE EAST", count(*) AS "Total"
        FROM ents GROUP BY ROLLUP (label)""",
    "coverage_gaps": """WITH seen AS (
          SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
        SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM seen) s, (SELECT DISTINCT lang FROM seen) l
        EXCEPT SELECT source, lang FROM seen""",
    "partition_violations": f"""WITH {TEXT_SPLIT}
        SELECT entity_id, CAST(1 AS BIGINT) AS in_all, CAST(0 AS BIGINT) AS in_kept, CAST(0 AS BIGINT) AS in_removed
        FROM ents WHERE entity_id NOT IN (SELECT entity_id FROM manifest)
          AND entity_id NOT IN (SELECT entity_id FROM ids)""",
    "membership_diff": """SELECT CAST(coalesce(d.doc_id, l.doc_id) AS VARCHAR) AS entity_id,
               CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side
        FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "overlap_audit": MEMBERSHIP.format(pair="documents/labels", key="doc_id", table="labels") + " UNION ALL "
        + MEMBERSHIP.format(pair="documents/embeddings", key="vec_id", table="embeddings"),
    "overlap_keys": """WITH m AS (SELECT toxic, unnest([
            {'key': 'doc_id', 'value': CAST(d.doc_id AS VARCHAR)}, {'key': 'source', 'value': source},
            {'key': 'lang', 'value': lang}, {'key': 'grp', 'value': CAST(d.doc_id % 4 AS VARCHAR)}], recursive := true)
          FROM documents d JOIN labels l USING (doc_id) WHERE toxic IN (0, 1)),
        c AS (SELECT key, value, count(*) FILTER (WHERE toxic = 1) AS a, count(*) FILTER (WHERE toxic = 0) AS b FROM m GROUP BY ALL)
        SELECT key, count(*) FILTER (WHERE a > 0 AND b > 0) AS n_shared, count(*) FILTER (WHERE b = 0) AS n_expected_only,
               count(*) FILTER (WHERE a = 0) AS n_actual_only, CAST(coalesce(sum(a) FILTER (WHERE a > 0 AND b > 0), 0) AS BIGINT) AS expected_rows_shared,
               CAST(coalesce(sum(b) FILTER (WHERE a > 0 AND b > 0), 0) AS BIGINT) AS actual_rows_shared FROM c GROUP BY key""",
    "report_merge": """SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled,
               '{"lang":"' || lang || '"' || CASE WHEN l.doc_id IS NULL THEN '' ELSE ',"marks":{"quality":' || quality || ',"toxic":' || toxic || '}' END
               || ',"n":' || n_chars || ',"status":"' || CASE WHEN l.doc_id IS NULL THEN 'draft' ELSE 'final' END || '"}' AS report
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "entity_checks": """WITH g AS (
          SELECT CAST(conv_id AS VARCHAR) AS key, count(*) AS n_rows,
                 count(*) FILTER (WHERE conv_id IS NULL OR coalesce(trim(role), '') = '' OR coalesce(trim(text), '') = '') AS b
          FROM conversations GROUP BY conv_id)
        SELECT CASE WHEN b > 0 THEN 'blank_field' ELSE 'duplicate_id' END AS "check", key, n_rows
        FROM g WHERE n_rows > 1 OR b > 0""",
    "exclusion_checks": """SELECT CASE WHEN l.doc_id IS NULL THEN 'unknown_id' ELSE 'duplicate_id' END AS "check",
               CAST(b.item_id AS VARCHAR) AS key, b.n_rows
        FROM (SELECT item_id, count(*) AS n_rows FROM benchmark GROUP BY item_id) b
        LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON b.item_id = l.doc_id
        WHERE l.doc_id IS NULL OR b.n_rows > 1""",
    "id_quality": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (
            WHERE {c} IS NULL OR isnan({c}) OR {c} < 0 OR abs({c} - round({c})) > 1e-6) AS n_invalid FROM lineitem"""
        for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    ),
    "domain_violations": """SELECT coalesce(s.lang, w.lang) AS value,
               CASE WHEN s.lang IS NULL THEN 'absent' ELSE 'unexpected' END AS problem
        FROM (SELECT DISTINCT lang FROM documents) s
        FULL JOIN (VALUES ('de'), ('en'), ('fr'), ('it')) w(lang) ON s.lang = w.lang
        WHERE s.lang IS NULL OR w.lang IS NULL""",
    "recorded_totals": f"""WITH {LANG_SPLIT},
        actual AS (SELECT split, count(*) AS actual FROM manifest GROUP BY split),
        n AS (SELECT count(*) AS n FROM documents),
        whole AS (
          SELECT n * 70 // 100 AS f1, n * 15 // 100 AS f2, n - n * 70 // 100 - 2 * (n * 15 // 100) AS spare,
                 n * 70 % 100 >= n * 15 % 100 AS tf, n FROM n),
        sizes AS (
          SELECT f1 + CASE WHEN tf AND spare >= 1 THEN 1 ELSE 0 END AS tr,
                 f2 + CASE WHEN (tf AND spare >= 2) OR (NOT tf AND spare >= 1) THEN 1 ELSE 0 END AS va, n FROM whole),
        recorded AS (
          SELECT 'train' AS split, tr AS recorded FROM sizes UNION ALL SELECT 'validation', va FROM sizes
          UNION ALL SELECT 'test', n - tr - va FROM sizes)
        SELECT split, actual, recorded FROM actual FULL JOIN recorded USING (split)
        WHERE actual IS DISTINCT FROM recorded""",
    "order_mismatch": """WITH k AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name FROM part),
        p AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos, p_name FROM part)
        SELECT pos, k.p_name AS left_item, p.p_name AS right_item FROM k JOIN p USING (pos) WHERE k.p_name <> p.p_name""",
    "empty_entities": f"""WITH {RETAIL_ENTITIES}, {RETAIL}
        SELECT * FROM ents WHERE entity_id NOT IN (SELECT entity_id FROM retail GROUP BY 1 HAVING sum(cnt) > 0)""",
    "table_fingerprints": f"""SELECT source AS part, count(*) AS n_rows,
        {sql_checksum(["CAST(doc_id AS VARCHAR)", "lang", "text"])} AS checksum
        FROM documents GROUP BY source""",
    "selected_features": f"""WITH {LANG_SPLIT}, {TOKENS}, {FITTED.format(n=2000)}
        SELECT feature_id, out_pos, round(mean, 9) AS mean, round(scale, 9) AS scale, round(variance, 9) AS variance
        FROM fitted""",
    "transformed_long": f"""WITH {LANG_SPLIT}, {TOKENS}, {FITTED.format(n=2000)}
        SELECT m.entity_id, m.split, f.out_pos,
               round(CAST(CAST((coalesce(l.x, 0) - f.mean) / f.scale AS FLOAT) AS DOUBLE), 4) AS value
        FROM manifest m CROSS JOIN fitted f
        LEFT JOIN logs l ON l.entity_id = m.entity_id AND l.feature_id = f.feature_id""",
    "group_feature_stats": f"""WITH {LANG}, {TOKENS}, {FOLD_STATS}
        SELECT outer_grp, feature_id, round(mean, 9) AS mean, round(variance, 9) AS variance FROM fold_stats""",
    "fold_selected_features": f"""WITH {LANG}, {TOKENS}, {FOLD_STATS},
        top AS (
          SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY outer_grp ORDER BY variance DESC, feature_id) AS place
            FROM fold_stats WHERE variance > 1e-12)
          WHERE place <= 2000)
        SELECT outer_grp, feature_id, row_number() OVER (PARTITION BY outer_grp ORDER BY feature_id) - 1 AS out_pos,
               round(mean, 9) AS mean, round(sqrt(variance), 9) AS scale FROM top""",
    "panel_empty_entities": f"""WITH {LANG}, {TOKENS}, {PANEL}
        SELECT * FROM ents WHERE entity_id NOT IN (
          SELECT entity_id FROM counts WHERE feature_id IN (SELECT feature_id FROM panel))""",
    "text_table_round_trip": """SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS grp,
               CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS label FROM customer""",
    "feature_positions": f"WITH {VOCABULARY.format(name='vocab', table='documents')} SELECT feature_id, pos AS feature_pos FROM vocab",
    "panel_mapping": f"WITH {PANEL} SELECT * FROM mapping",
    "panel_coverage": f"""WITH {PANEL}
        SELECT count(*) AS n_panel, count(*) FILTER (WHERE present) AS n_matched,
               count(*) FILTER (WHERE NOT present) AS n_missing,
               round(100.0::DOUBLE * count(*) FILTER (WHERE present) / count(*), 6) AS coverage_percent FROM mapping""",
    "panel_ordered": f"""WITH {PANEL}
        SELECT panel_pos, feature_name, feature_index, row_number() OVER (ORDER BY panel_pos) - 1 AS out_pos
        FROM mapping WHERE present""",
    "converted_counts": """SELECT 'o' || o_orderkey AS entity_id, o_orderpriority AS label, o_orderstatus AS grp, p_name || ':' || p_partkey AS feature_id,
               pos AS feature_pos, CAST(sum(l_quantity) AS BIGINT) AS cnt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN (SELECT *, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos FROM part) ON l_partkey = p_partkey GROUP BY ALL""",
    "coordinate_matrix": """SELECT l_partkey AS feature_pos, l_orderkey AS entity_pos, CAST(sum(l_quantity) AS BIGINT) AS cnt
        FROM lineitem GROUP BY l_partkey, l_orderkey""",
}
