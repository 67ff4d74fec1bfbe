"""SQL counterparts of the vector queries, for the driver's tables."""

from __future__ import annotations

from probeloom.catalog.cohort_sql import NONE_LISTED, SPLIT

VECTORS = """
vecs AS (
  SELECT CAST(vec_id AS VARCHAR) AS entity_id, vec_id, CAST(label AS VARCHAR) AS label,
         CAST(vec_id % 4 AS VARCHAR) AS grp, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
)"""
ENTS = "ents AS (SELECT entity_id, label, grp FROM vecs)"
VECTOR_SPLIT = f"{VECTORS}, {ENTS}, {NONE_LISTED}, {SPLIT}, split_vecs AS (SELECT m.*, v.vec FROM manifest m JOIN vecs v USING (entity_id))"
LONG = """
long AS (
  SELECT entity_id, label, grp, split, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM split_vecs
)"""
SCALED = """
center AS (
  SELECT dim, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-12 THEN 1 ELSE stddev_pop(x) END AS sd
  FROM long WHERE split = 'train' GROUP BY dim
),
scaled AS (SELECT entity_id, label, grp, split, dim, (x - mu) / sd AS x FROM long JOIN center USING (dim))"""

# Training class means and the scores they give to rows of another split.
CLASS_SCORES = """
means AS (SELECT label AS c, dim, avg(x) AS m FROM {src} WHERE split = 'train' GROUP BY ALL),
prior AS (
  SELECT label AS c, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS lp FROM manifest WHERE split = 'train' GROUP BY label
),
dist AS (
  SELECT s.entity_id, s.label, s.split, m.c, sum((s.x - m.m) * (s.x - m.m)) AS d2
  FROM {src} s JOIN means m USING (dim) WHERE s.split <> 'train' GROUP BY ALL
),
score AS (SELECT d.*, p.lp - 0.5 * d2 AS s FROM dist d JOIN prior p USING (c)),
prob AS (
  SELECT entity_id, label, split, c, exp(s - max(s) OVER w) / sum(exp(s - mx)) OVER w AS p
  FROM (SELECT *, max(s) OVER (PARTITION BY entity_id) AS mx FROM score) WINDOW w AS (PARTITION BY entity_id)
),
pred AS (
  SELECT entity_id, label, split, c AS prediction, p AS p_top FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, c) AS rn FROM prob) WHERE rn = 1
)"""
PREDICTED = f"{VECTOR_SPLIT}, {LONG}, {CLASS_SCORES.format(src='long')}"
PREDICTED_SCALED = f"{VECTOR_SPLIT}, {LONG}, {SCALED}, {CLASS_SCORES.format(src='scaled')}"


def class_table(pred: str, keys: str = "") -> str:
    """tp, predicted, support and rates by class from a prediction table."""
    k = f"{keys}, " if keys else ""
    return f"""
classes AS (
  SELECT {k}label, sum(tp) AS tp, sum(pr) AS predicted, sum(su) AS support FROM (
    SELECT {k}label, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp, 0 AS pr, 1 AS su FROM {pred}
    UNION ALL SELECT {k}prediction, 0, 1, 0 FROM {pred}) GROUP BY ALL
),
rates AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp::DOUBLE / predicted END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall, 2.0::DOUBLE * tp / (predicted + support) AS f1_score
  FROM classes
)"""


def metric_columns(decimals: int | None = 6) -> str:
    def e(x):
        return x if decimals is None else f"round({x}, {decimals})"
    return (f"CAST(sum(support) AS BIGINT) AS n_rows, {e('avg(f1_score)')} AS macro_f1, "
            f"{e('sum(tp)::DOUBLE / sum(support)')} AS accuracy, "
            f"{e('avg(recall) FILTER (WHERE support > 0)')} AS balanced_accuracy")


LOSS = "avg(-ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))"

# name: label modulus, alpha, groups
SETTINGS = {
    "k10_a0.1_low": (10, 0.1, "01"), "k10_a0.1_high": (10, 0.1, "23"),
    "k5_a0.1_all": (5, 0.1, "0123"), "k5_a0.3_all": (5, 0.3, "0123"),
}
FIRST, NEXT = "k10_a0.1_low", "k10_a0.1_high"


def soft(u: str, a: str) -> str:
    return f"sign({u}) * greatest(abs({u}) - {a}, 0.0::DOUBLE)"


# From atoms (name, k, alpha, atom, w) to what the codes need.
GRAMS = """
dicts AS (SELECT name, k, alpha, list(w ORDER BY atom) AS d FROM atoms GROUP BY ALL),
grams AS (SELECT *, list_transform(d, lambda a: list_transform(d, lambda b: list_inner_product(a, b))) AS g FROM dicts),
bounds AS (SELECT *, list_max(list_transform(g, lambda q: list_sum(list_transform(q, lambda v: abs(v))))) AS lip FROM grams)"""


def dictionaries(*names: str) -> str:
    values = ", ".join(f"('{n}', {SETTINGS[n][0]}, {SETTINGS[n][1]}::DOUBLE, '{SETTINGS[n][2]}')" for n in names)
    return f"""
settings(name, k, alpha, grps) AS (VALUES {values}),
places AS (SELECT grp, CAST(label AS INT) AS c, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM vecs),
class_means AS (
  SELECT s.name, s.k, s.alpha, p.c % s.k + 1 AS atom, dim, avg(x) AS m
  FROM settings s JOIN places p ON contains(s.grps, p.grp) GROUP BY ALL
),
atoms AS (
  SELECT name, k, alpha, atom, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS w FROM (
    SELECT name, k, alpha, atom, list(m ORDER BY dim) AS w FROM class_means GROUP BY ALL)
),{GRAMS}"""


def codes(source: str = "vecs", steps: int = 300) -> str:
    """Codes of every row of ``source`` by a fixed number of proximal steps."""
    return f"""
targets AS (
  SELECT v.*, b.name, b.k, b.alpha, b.d, b.g, b.lip, list_transform(b.d, lambda w: list_inner_product(w, v.vec)) AS t
  FROM {source} v CROSS JOIN bounds b
),
coded AS (
  SELECT * EXCLUDE (t), t, list_reduce(
    list_transform(range({steps}), lambda i: t),
    lambda z, b: list_transform(
      list_transform(range(1, k + 1), lambda j: z[j] - (list_inner_product(g[j], z) - b[j]) / lip),
      lambda u: {soft('u', 'alpha / lip')}),
    list_transform(range(k), lambda i: 0.0::DOUBLE)) AS z
  FROM targets
)"""


CODED = f"{VECTOR_SPLIT}, {dictionaries(FIRST)}, {codes('split_vecs')}"
CODE_LONG = """
zl AS (SELECT entity_id, label, split, unnest(range(1, k + 1)) AS atom, unnest(z) AS z FROM coded),
zc AS (
  SELECT atom, avg(z) AS mu, CASE WHEN stddev_pop(z) > 1e-12 THEN stddev_pop(z) ELSE 1 END AS sd
  FROM zl WHERE split = 'train' GROUP BY atom
),
activity AS (
  SELECT atom, split, label, count(*) AS n_rows, avg(z) AS mean_activity, avg(abs(z)) AS mean_absolute_activity,
         avg(CASE WHEN abs(z) > 1e-6 THEN 1.0 ELSE 0.0 END) AS active_fraction, (avg(z) - any_value(mu)) / any_value(sd) AS standardized_mean
  FROM zl JOIN zc USING (atom) GROUP BY atom, split, label
)"""

# Leave-one-group-out metrics of class means for three representations.
GROUP_STUDY = f"""
{VECTORS}, {dictionaries(FIRST, NEXT)}, {codes('vecs')},
rep AS (
  SELECT 'embedding' AS method, -1 AS seed, entity_id, label, grp, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM vecs
  UNION ALL
  SELECT 'codes', CASE WHEN name = '{FIRST}' THEN 0 ELSE 1 END, entity_id, label, grp, unnest(range(k)), unnest(z) FROM coded
),
g AS (SELECT DISTINCT grp AS fold FROM vecs),
fold_center AS (
  SELECT fold, method, seed, dim, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-12 THEN 1 ELSE stddev_pop(x) END AS sd
  FROM rep JOIN g ON grp <> fold GROUP BY ALL
),
fold_rows AS (
  SELECT fold, method, seed, scaling, entity_id, label, grp, dim,
         CASE WHEN scaling = 'standard' THEN (x - mu) / sd ELSE x END AS x
  FROM rep JOIN fold_center USING (method, seed, dim), (VALUES ('none'), ('standard')) s(scaling)
),
fold_means AS (SELECT fold, method, seed, scaling, label AS c, dim, avg(x) AS m FROM fold_rows WHERE grp <> fold GROUP BY ALL),
fold_prior AS (
  SELECT fold, label AS c, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY fold)) AS lp
  FROM vecs JOIN g ON grp <> fold GROUP BY fold, label
),
fold_dist AS (
  SELECT r.fold, r.method, r.seed, r.scaling, r.entity_id, r.label, m.c, sum((r.x - m.m) * (r.x - m.m)) AS d2
  FROM fold_rows r JOIN fold_means m USING (fold, method, seed, scaling, dim) WHERE r.grp = r.fold GROUP BY ALL
),
fold_score AS (
  SELECT *, max(s) OVER (PARTITION BY fold, method, seed, scaling, entity_id) AS mx FROM (
    SELECT d.*, lp - 0.5 * d2 AS s FROM fold_dist d JOIN fold_prior USING (fold, c))
),
fold_prob AS (
  SELECT *, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY fold, method, seed, scaling, entity_id) AS p FROM fold_score
),
fold_pred AS (
  SELECT * EXCLUDE (rn), c AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY fold, method, seed, scaling, entity_id ORDER BY p DESC, c) AS rn FROM fold_prob)
  WHERE rn = 1
),
{class_table('fold_pred', 'fold, method, seed, scaling')},
fold_loss AS (SELECT fold, method, seed, scaling, {LOSS} AS log_loss FROM fold_prob WHERE label = c GROUP BY ALL),
by_group AS (
  SELECT method, seed, scaling, fold AS grp, n_rows, macro_f1, accuracy, balanced_accuracy, log_loss FROM (
    SELECT fold, method, seed, scaling, {metric_columns(None)} FROM rates GROUP BY fold, method, seed, scaling
  ) JOIN fold_loss USING (fold, method, seed, scaling)
),
group_mean AS (
  SELECT method, scaling, grp, avg(macro_f1) AS macro_f1, avg(accuracy) AS accuracy,
         avg(balanced_accuracy) AS balanced_accuracy, avg(log_loss) AS log_loss
  FROM by_group GROUP BY ALL
),
variation AS (
  SELECT method, scaling, grp, avg(macro_f1) AS mean, stddev_samp(macro_f1) AS std, min(macro_f1) AS min, max(macro_f1) AS max
  FROM by_group GROUP BY method, scaling, grp
)"""


def search(*names: str) -> str:
    """Validation metrics of class means for every feature set and coarse C."""
    return f"""
{VECTOR_SPLIT}, {dictionaries(*names)}, {codes('split_vecs')},
rep AS (
  SELECT 'embedding' AS fs, entity_id, label, split, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM split_vecs
  UNION ALL SELECT name, entity_id, label, split, unnest(range(k)), unnest(z) FROM coded
),
means AS (SELECT fs, label AS c, dim, avg(x) AS m FROM rep WHERE split = 'train' GROUP BY ALL),
prior AS (SELECT label AS c, ln(count(*)::DOUBLE / sum(count(*)) OVER ()) AS lp FROM manifest WHERE split = 'train' GROUP BY label),
dist AS (
  SELECT r.fs, r.entity_id, r.label, m.c, sum((r.x - m.m) * (r.x - m.m)) AS d2
  FROM rep r JOIN means m USING (fs, dim) WHERE split = 'validation' GROUP BY ALL
),
score AS (
  SELECT *, max(s) OVER (PARTITION BY fs, cc, entity_id) AS mx FROM (
    SELECT d.*, cc, lp - cc * d2 AS s
    FROM dist d JOIN prior USING (c), (VALUES (0.01::DOUBLE), (0.1), (1), (10), (100), (1000)) q(cc))
),
prob AS (SELECT *, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY fs, cc, entity_id) AS p FROM score),
pred AS (
  SELECT * EXCLUDE (rn), c AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY fs, cc, entity_id ORDER BY p DESC, c) AS rn FROM prob) WHERE rn = 1
),
{class_table('pred', 'fs, cc')},
loss AS (SELECT fs, cc, {LOSS} AS log_loss FROM prob WHERE label = c GROUP BY ALL),
rows_ AS (
  SELECT fs AS feature_set, cc AS "C", round(macro_f1, 9) AS val_macro_f1, round(log_loss, 9) AS val_log_loss, log_loss < 5 AS converged
  FROM (SELECT fs, cc, {metric_columns(None)} FROM rates GROUP BY fs, cc) JOIN loss USING (fs, cc)
),
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY val_macro_f1 DESC, "C") AS rn FROM rows_ WHERE converged)
  WHERE rn = 1
)"""


INNER = f"""
{VECTORS},
g AS (SELECT a.grp AS o, b.grp AS i FROM (SELECT DISTINCT grp FROM vecs) a JOIN (SELECT DISTINCT grp FROM vecs) b ON a.grp <> b.grp),
long AS (SELECT entity_id, label, grp, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM vecs),
means AS (SELECT o, i, label AS c, dim, avg(x) AS m FROM long JOIN g ON grp <> o AND grp <> i GROUP BY ALL),
prior AS (
  SELECT o, i, label AS c, ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o, i)) AS lp,
         sum(count(*)) OVER (PARTITION BY o, i) AS n
  FROM vecs JOIN g ON grp <> o AND grp <> i GROUP BY o, i, label
),
dist AS (
  SELECT o, i, l.entity_id, l.label, m.c, sum((l.x - m.m) * (l.x - m.m)) AS d2
  FROM long l JOIN means m ON l.grp = m.i AND l.dim = m.dim GROUP BY ALL
),
score AS (
  SELECT *, max(s) OVER (PARTITION BY o, i, lam, entity_id) AS mx FROM (
    SELECT d.*, lam, lp - d2 / (n * lam) AS s
    FROM dist d JOIN prior USING (o, i, c), (VALUES (1e-5::DOUBLE), (1e-4), (1e-3), (1e-2), (1e-1)) q(lam))
),
prob AS (SELECT *, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY o, i, lam, entity_id) AS p FROM score),
pred AS (
  SELECT * EXCLUDE (rn), c AS prediction FROM (
    SELECT *, row_number() OVER (PARTITION BY o, i, lam, entity_id ORDER BY p DESC, c) AS rn FROM prob) WHERE rn = 1
),
{class_table('pred', 'o, i, lam')},
loss AS (SELECT o, i, lam, {LOSS} AS log_loss FROM prob WHERE label = c GROUP BY ALL),
inner_rows AS (
  SELECT o AS outer_grp, lam AS "lambda", round(macro_f1, 9) AS macro_f1, log_loss < 5 AS converged
  FROM (SELECT o, i, lam, {metric_columns(None)} FROM rates GROUP BY o, i, lam) JOIN loss USING (o, i, lam)
),
means_ AS (
  SELECT outer_grp, "lambda", avg(macro_f1) AS mean_macro_f1 FROM inner_rows GROUP BY ALL HAVING bool_and(converged)
)"""

FOLDS = f"""
{VECTORS},
folds AS (
  SELECT g.grp AS outer_grp, e.entity_id, e.label, e.grp, CASE WHEN e.grp = g.grp THEN 'hold' ELSE 'train' END AS role
  FROM vecs e CROSS JOIN (SELECT DISTINCT grp FROM vecs) g
)"""

WEIGHTS = f"""
{VECTORS}, {dictionaries(FIRST, NEXT)},
wl AS (SELECT name, atom, unnest(range(len(w))) AS pos, unnest(w) AS weight FROM atoms),
tops AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY name, atom ORDER BY abs(weight) DESC, pos DESC) AS rank FROM wl) WHERE rank <= 20
)"""

PAIRS = f"""
{WEIGHTS}, {codes('vecs')},
zl AS (SELECT name, entity_id, unnest(range(1, k + 1)) AS atom, unnest(z) AS z FROM coded),
sets AS (SELECT name, atom, list(pos) AS top FROM tops GROUP BY ALL),
cor AS (
  SELECT a.atom AS atom_a, b.atom AS atom_b,
         CASE WHEN stddev_pop(a.z) > 1e-12 AND stddev_pop(b.z) > 1e-12 THEN corr(a.z, b.z) END AS correlation
  FROM zl a JOIN zl b USING (entity_id) WHERE a.name = '{FIRST}' AND b.name = '{NEXT}' GROUP BY ALL
),
pairs AS (
  SELECT a.atom AS atom_a, b.atom AS atom_b,
         list_inner_product(a.w, b.w) / sqrt(list_inner_product(a.w, a.w) * list_inner_product(b.w, b.w)) AS cosine,
         len(list_intersect(sa.top, sb.top))::DOUBLE / len(list_distinct(list_concat(sa.top, sb.top))) AS jaccard,
         correlation
  FROM atoms a JOIN atoms b ON a.name = '{FIRST}' AND b.name = '{NEXT}'
  JOIN sets sa ON sa.name = a.name AND sa.atom = a.atom JOIN sets sb ON sb.name = b.name AND sb.atom = b.atom
  JOIN cor ON cor.atom_a = a.atom AND cor.atom_b = b.atom
)"""

def deflated(n: int, gram: str, steps: int = 45) -> str:
    """Largest eigenvalue of a Gram matrix by repeated squaring, and the matrix without it.

    2^45 products with itself leave the projector on the leading directions however close the next
    eigenvalue is: what remains of directions that differ shifts the eigenvalue by less than 1e-13 of it.
    """
    return f"""
walk{n} AS (
  SELECT 0 AS step, m FROM {gram}
  UNION ALL
  SELECT step + 1, list_transform(u, lambda r: list_transform(r, lambda x: CASE WHEN t > 0 THEN x / t ELSE 0 END)) FROM (
    SELECT step, u, list_sum(list_transform(u, lambda r, i: r[i])) AS t FROM (
      SELECT step, list_transform(m, lambda r: list_transform(m, lambda c: list_inner_product(r, c))) AS u FROM walk{n} WHERE step < {steps}))
),
lead{n} AS (
  SELECT list_transform(w, lambda x: CASE WHEN list_inner_product(w, w) > 0 THEN x / sqrt(list_inner_product(w, w)) ELSE 0 END) AS v FROM (
    SELECT m[list_position(list_transform(m, lambda r, i: r[i]), list_max(list_transform(m, lambda r, i: r[i])))] AS w FROM walk{n} WHERE step = {steps})
),
root{n} AS (
  SELECT v, greatest(list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))), 0) AS root FROM lead{n}, {gram}
),
gram{n} AS (
  SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - root * v[i] * v[j])) AS m FROM root{n}, {gram}
)"""


# Dictionaries by held-out group and seed. Means of the same class agree far better than
# those of different classes, so the best match is the class itself.
SEED_STABILITY = f"""
{VECTORS},
runs AS (SELECT fold, seed, fold || '#' || seed AS name FROM (SELECT DISTINCT grp AS fold FROM vecs), (VALUES (0), (1), (2)) s(seed)),
places AS (SELECT vec_id, grp, CAST(label AS INT) + 1 AS atom, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM vecs),
seed_means AS (
  SELECT name, atom, dim, avg(x) AS m FROM runs JOIN places ON grp <> fold AND vec_id % 3 <> seed GROUP BY ALL
),
atoms AS (
  SELECT name, 10 AS k, 0.1::DOUBLE AS alpha, atom, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS w FROM (
    SELECT name, atom, list(m ORDER BY dim) AS w FROM seed_means GROUP BY ALL)
),{GRAMS}, {codes('vecs')},
zl AS (
  SELECT c.name, fold, seed, entity_id, unnest(range(1, k + 1)) AS atom, unnest(z) AS z FROM coded c JOIN runs r ON r.name = c.name AND grp <> fold
),
wl AS (SELECT name, atom, unnest(range(len(w))) AS pos, unnest(w) AS weight FROM atoms),
sets AS (
  SELECT name, atom, list(pos) AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY name, atom ORDER BY abs(weight) DESC, pos DESC) AS rank FROM wl) WHERE rank <= 20 GROUP BY ALL
),
cor AS (
  SELECT a.fold, a.seed AS seed_a, b.seed AS seed_b, a.atom,
         CASE WHEN stddev_pop(a.z) > 1e-12 AND stddev_pop(b.z) > 1e-12 THEN corr(a.z, b.z) END AS correlation
  FROM zl a JOIN zl b ON a.fold = b.fold AND a.seed < b.seed AND a.entity_id = b.entity_id AND a.atom = b.atom GROUP BY ALL
),
matched AS (
  SELECT c.fold AS grp, c.seed_a, c.seed_b, list_inner_product(a.w, b.w) AS cosine, correlation,
         len(list_intersect(sa.top, sb.top))::DOUBLE / len(list_distinct(list_concat(sa.top, sb.top))) AS jaccard
  FROM cor c
  JOIN atoms a ON a.name = c.fold || '#' || c.seed_a AND a.atom = c.atom JOIN atoms b ON b.name = c.fold || '#' || c.seed_b AND b.atom = c.atom
  JOIN sets sa ON sa.name = a.name AND sa.atom = a.atom JOIN sets sb ON sb.name = b.name AND sb.atom = b.atom
)"""

# Best one-to-one assignment by dynamic programming over sets of used columns.
MATCHING = f"""
{PAIRS},
steps AS (
  SELECT 0 AS a, 0 AS used, 0.0::DOUBLE AS total, []::BIGINT[] AS picked
  UNION ALL
  SELECT a, used, total, picked FROM (
    SELECT s.a + 1 AS a, s.used | (1 << (p.atom_b - 1)::INT) AS used, s.total + abs(p.cosine) AS total,
           list_append(s.picked, p.atom_b) AS picked,
           row_number() OVER (PARTITION BY s.used | (1 << (p.atom_b - 1)::INT) ORDER BY s.total + abs(p.cosine) DESC) AS rn
    FROM steps s JOIN pairs p ON p.atom_a = s.a + 1 AND (s.used & (1 << (p.atom_b - 1)::INT)) = 0)
  WHERE rn = 1
),
solved AS (SELECT unnest(range(1, 11)) AS atom_a, unnest(picked) AS atom_b FROM (SELECT picked FROM steps WHERE a = 10 ORDER BY total DESC LIMIT 1))"""


def report_row(name: str, precision: str, recall: str, f1: str) -> str:
    return (f"SELECT '{name}' AS label, round({precision}, 6) AS precision, round({recall}, 6) AS recall, "
            f"round({f1}, 6) AS f1_score, CAST(sum(support) AS BIGINT) AS support FROM rates")


ACCURACY = "sum(tp)::DOUBLE / sum(support)"
CLASS_TABLE = class_table("pred")

SQL = {
    "vector_quality": f"""WITH {VECTORS}
        SELECT len(vec) AS dim, count(*) AS n_rows,
               count(*) FILTER (WHERE len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) > 0) AS n_not_finite,
               round(min(sqrt(list_inner_product(vec, vec))), 6) AS min_norm,
               round(max(sqrt(list_inner_product(vec, vec))), 6) AS max_norm FROM vecs GROUP BY len(vec)""",
    "aligned_vectors": f"""WITH {VECTOR_SPLIT}, {LONG}
        SELECT entity_id, label, grp, dim, round(x, 6) AS value FROM long WHERE split = 'train'""",
    "scaled_vectors": f"WITH {VECTOR_SPLIT}, {LONG}, {SCALED} SELECT entity_id, split, dim, round(x, 6) AS value FROM scaled",
    "unit_vectors": f"""WITH {VECTOR_SPLIT}, {LONG}, {SCALED}
        SELECT entity_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY entity_id)), 6) AS value FROM scaled""",
    "group_folds": f"WITH {FOLDS} SELECT * FROM folds",
    "fold_audit": f"""WITH {FOLDS},
        careless AS (
          SELECT outer_grp, grp, count(*) FILTER (WHERE label >= '3') AS nt, count(*) FILTER (WHERE label < '3') AS nh
          FROM folds GROUP BY ALL)
        SELECT outer_grp, n_train, n_hold, CAST(0 AS BIGINT) AS n_leaks, n_leaks_by_label FROM (
          SELECT outer_grp, count(*) FILTER (WHERE role = 'train') AS n_train,
                 count(*) FILTER (WHERE role = 'hold') AS n_hold FROM folds GROUP BY outer_grp)
        JOIN (SELECT outer_grp, count(*) FILTER (WHERE (nt > 0 AND nh > 0) OR (outer_grp = grp AND nt > 0)
                OR (outer_grp <> grp AND nh > 0)) AS n_leaks_by_label FROM careless GROUP BY outer_grp) USING (outer_grp)""",
    "centroid_predictions": f"""WITH {PREDICTED}
        SELECT entity_id, label, split, prediction, round(p_top, 6) AS p_top FROM pred""",
    "confusion_matrix": f"""WITH {PREDICTED} SELECT label, """ + ", ".join(
        f"""count(*) FILTER (WHERE prediction = '{c}') AS "{c}" """ for c in range(10)) + " FROM pred GROUP BY label",
    "absent_class_report": f"""WITH {PREDICTED}, kept AS (SELECT * FROM pred WHERE label <> '3'),
        c AS (SELECT CAST(range AS VARCHAR) AS label FROM range(10)),
        counts AS (
          SELECT c.label, (SELECT count(*) FROM kept k WHERE k.label = c.label AND k.prediction = c.label) AS tp,
                 (SELECT count(*) FROM kept k WHERE k.prediction = c.label) AS predicted,
                 (SELECT count(*) FROM kept k WHERE k.label = c.label) AS support FROM c),
        rates AS (
          SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
                 CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
                 CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0 END AS f1_score FROM counts)
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
               CAST(support AS BIGINT) AS support FROM rates
        UNION ALL {report_row('accuracy', ACCURACY, ACCURACY, ACCURACY)}
        UNION ALL {report_row('macro avg', 'avg(precision)', 'avg(recall)', 'avg(f1_score)')}
        UNION ALL {report_row('weighted avg', *[f'sum({m} * support) / sum(support)' for m in ('precision', 'recall', 'f1_score')])}""",
    "per_class_metrics": f"""WITH {PREDICTED}, {CLASS_TABLE}
        SELECT label, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted, CAST(support AS BIGINT) AS support,
               round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM rates""",
    "classification_report": f"""WITH {PREDICTED}, {CLASS_TABLE}
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
               CAST(support AS BIGINT) AS support FROM rates
        UNION ALL {report_row('accuracy', ACCURACY, ACCURACY, ACCURACY)}
        UNION ALL {report_row('macro avg', 'avg(precision)', 'avg(recall)', 'avg(f1_score)')}
        UNION ALL {report_row('weighted avg', *[f'sum({m} * support) / sum(support)' for m in ('precision', 'recall', 'f1_score')])}""",
    "scalar_metrics": f"""WITH {PREDICTED}, {class_table('pred', 'split')}
        SELECT split, n_rows, macro_f1, accuracy, balanced_accuracy, log_loss
        FROM (SELECT split, {metric_columns()} FROM rates GROUP BY split)
        JOIN (SELECT split, round({LOSS}, 6) AS log_loss FROM prob WHERE label = c GROUP BY split) USING (split)""",
    "attribute_mismatch": f"""WITH {PREDICTED}
        SELECT entity_id, 'label' AS attribute, label AS expected, prediction AS actual FROM pred WHERE label <> prediction""",
    "probability_audit": """SELECT * FROM (VALUES ('bad_mass', 0::BIGINT), ('cohort', 0), ('recomputed', 0)) t("check", n)
        UNION ALL SELECT 'scaling_changes', count(*) FROM (""" + " UNION ALL ".join(
            f"SELECT split, a.{m} AS x, b.{m} AS y FROM a JOIN b USING (split)"
            for m in ("macro_f1", "accuracy", "balanced_accuracy", "log_loss")) + ") WHERE abs(x - y) > 1e-9",
    "metrics_by_group": f"""WITH RECURSIVE {GROUP_STUDY}
        SELECT method, CAST(seed AS BIGINT) AS seed, scaling, grp, n_rows, round(macro_f1, 6) AS macro_f1,
               round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(log_loss, 6) AS log_loss
        FROM by_group""",
    "two_level_summary": f"WITH {GROUP_STUDY} SELECT method, scaling, " + ", ".join(
        f"round({f}({m}), 6) AS {m}_{n}" for m in ("macro_f1", "accuracy", "balanced_accuracy", "log_loss")
        for n, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM group_mean GROUP BY method, scaling",
    "seed_variation": f"""WITH {GROUP_STUDY}
        SELECT method, scaling, grp, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max
        FROM variation""",
    "paired_group_differences": f"""WITH {GROUP_STUDY},
        wide AS (
          SELECT grp, max(macro_f1) FILTER (WHERE method = 'embedding' AND scaling = 'standard') AS es,
                 max(macro_f1) FILTER (WHERE method = 'embedding' AND scaling = 'none') AS en,
                 max(macro_f1) FILTER (WHERE method = 'codes' AND scaling = 'standard') AS cs,
                 max(macro_f1) FILTER (WHERE method = 'codes' AND scaling = 'none') AS cn FROM group_mean GROUP BY grp)
        SELECT grp, round(es - en, 6) AS embedding_standard_minus_none, round(cs - cn, 6) AS codes_standard_minus_none,
               round(cs - es, 6) AS codes_minus_embedding_standard FROM wide""",
    "report_f1_by_group": f"""WITH {GROUP_STUDY}
        SELECT grp, printf('%.6f', max(mean) FILTER (WHERE method = 'embedding')) AS embedding,
               printf('%.6f', max(mean) FILTER (WHERE method = 'codes')) AS codes,
               printf('%.6f', max(std) FILTER (WHERE method = 'codes')) AS seed_sd
        FROM variation WHERE scaling = 'standard' GROUP BY grp""",
    "report_f1_by_class": f"""WITH a AS (WITH {PREDICTED}, {CLASS_TABLE} SELECT label, support, f1_score FROM rates),
        b AS (WITH {PREDICTED_SCALED}, {CLASS_TABLE} SELECT label, f1_score FROM rates)
        SELECT label, CAST(support AS BIGINT) AS support, printf('%.4f', a.f1_score) AS plain,
               printf('%.4f', b.f1_score) AS standardized FROM a JOIN b USING (label)""",
    "report_atom_activity": f"""WITH {CODED}, {CODE_LONG},
        wl AS (SELECT atom, unnest(range(len(w))) AS pos, unnest(w) AS weight FROM atoms),
        top AS (
          SELECT atom, string_agg('dim' || pos, ', ' ORDER BY rank) AS features FROM (
            SELECT *, row_number() OVER (PARTITION BY atom ORDER BY weight DESC, pos) AS rank FROM wl WHERE weight > 0)
          WHERE rank <= 3 GROUP BY atom)
        SELECT atom, features, label, printf('%.3f', max(standardized_mean) FILTER (WHERE split = 'train')) AS train,
               printf('%.3f', max(standardized_mean) FILTER (WHERE split = 'validation')) AS validation
        FROM activity JOIN top USING (atom) GROUP BY atom, features, label""",
    "best_by_method": f"""WITH {search(FIRST, NEXT)}
        SELECT feature_set, round("C", 6) AS "C", round(val_macro_f1, 6) AS val_macro_f1,
               round(val_log_loss, 6) AS val_log_loss, converged FROM best""",
    "refined_grid": f"""WITH {search(FIRST, NEXT)},
        fine AS (SELECT feature_set, i, "C" / 10 * pow(100, i / 20.0::DOUBLE) AS c FROM best, range(21) t(i)),
        fresh AS (
          SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY i) - 1 AS step FROM fine
          WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0.01::DOUBLE), (0.1), (1), (10), (100), (1000)) q(t) WHERE abs(ln(c) - ln(t)) <= 1e-10))
        SELECT feature_set, step, round(c, 6) AS "C" FROM fresh""",
    "dictionary_ranking": f"""WITH {search(*SETTINGS)},
        size_ AS (
          SELECT name, any_value(k) AS atoms, avg(len(list_filter(z, lambda v: abs(v) > 1e-6))) AS active,
                 sum(list_sum(list_transform(range(1, len(vec) + 1), lambda i: pow(vec[i] - list_sum(list_transform(range(1, k + 1), lambda j: z[j] * d[j][i])), 2))))
                   / sum(list_inner_product(vec, vec)) AS rel
          FROM coded WHERE split = 'validation' GROUP BY name)
        SELECT row_number() OVER (ORDER BY val_macro_f1 DESC, atoms, active, feature_set) AS rank, feature_set AS candidate,
               round("C", 6) AS "C", round(val_macro_f1, 6) AS val_macro_f1, CAST(atoms AS BIGINT) AS atoms,
               round(active, 6) AS validation_mean_active_atoms, round(rel, 6) AS validation_relative_mse
        FROM best JOIN size_ ON feature_set = name""",
    "best_lambda": f"""WITH {INNER}
        SELECT outer_grp, round("lambda", 6) AS "lambda", round(mean_macro_f1, 6) AS mean_macro_f1 FROM (
          SELECT *, row_number() OVER (PARTITION BY outer_grp ORDER BY mean_macro_f1 DESC, "lambda" DESC) AS rn FROM means_)
        WHERE rn = 1""",
    "parameter_grid": f"""WITH {FOLDS},
        n AS (SELECT outer_grp, count(*) FILTER (WHERE role = 'train') AS n_train FROM folds GROUP BY outer_grp)
        SELECT outer_grp, 'k' || k || '_a' || a || '_s' || s || '_e10' AS candidate, round(l, 6) AS "lambda", n_train,
               round(1 / (n_train * l), 6) AS "C"
        FROM n, (VALUES (32), (64)) x(k), (VALUES ('0.5'), ('1.0'), ('2.0')) y(a), (VALUES (0), (1), (2)) z(s),
             (VALUES (1e-5::DOUBLE), (1e-4), (1e-3), (1e-2), (1e-1)) w(l)""",
    "sparse_codes_native": f"""WITH {VECTORS}, {dictionaries(FIRST)}, {codes('vecs')}
        SELECT entity_id, unnest(range(1, k + 1)) AS atom, round(unnest(z), 6) AS value FROM coded""",
    "sparse_codes_batch": f"""WITH {VECTORS}, {dictionaries(FIRST)}, {codes('vecs')}
        SELECT entity_id, unnest(range(1, k + 1)) AS atom, round(unnest(z), 6) AS value FROM coded""",
    "kkt_residuals": "SELECT entity_id, atom, round(residual, 6) AS value FROM kkt",
    "kkt_summary": """SELECT round(max(residual), 6) AS max_residual, round(quantile_cont(residual, 0.95), 6) AS p95,
               round(max(residual), 6) AS relative_max FROM kkt""",
    "code_activity": f"""WITH {CODED}, {CODE_LONG}
        SELECT atom, split, label, n_rows, round(mean_activity, 6) AS mean_activity,
               round(mean_absolute_activity, 6) AS mean_absolute_activity, round(active_fraction, 6) AS active_fraction,
               round(standardized_mean, 6) AS standardized_mean FROM activity""",
    "code_usage": f"""WITH {CODED}, {CODE_LONG}
        SELECT split, atom, round(avg(CASE WHEN abs(z) > 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS active_fraction,
               NOT bool_or(abs(z) > 1e-6) AS unused FROM zl GROUP BY split, atom""",
    "reconstruction_error": f"""WITH {CODED},
        e AS (
          SELECT split, list_sum(list_transform(range(1, len(vec) + 1), lambda i: pow(vec[i] - list_sum(list_transform(range(1, k + 1), lambda j: z[j] * d[j][i])), 2))) AS rss,
                 list_inner_product(vec, vec) AS xss, len(list_filter(z, lambda v: abs(v) > 1e-6)) AS act FROM coded)
        SELECT split, round(avg(rss) / 64, 6) AS mse, round(avg(xss) / 64, 6) AS zero_reconstruction_mse,
               round(avg(act) / 10, 6) AS active_fraction, round(avg(act), 6) AS mean_active_atoms,
               round(avg(rss) / avg(xss), 6) AS relative_mse FROM e GROUP BY split""",
    "atom_norms": f"""WITH {VECTORS}, l AS (SELECT label, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM vecs),
        m AS (SELECT label, dim, avg(x) AS m FROM l GROUP BY ALL)
        SELECT label AS atom, round(sqrt(sum(m * m)), 6) AS norm FROM m GROUP BY label HAVING sqrt(sum(m * m)) > 0.14""",
    "top_features_per_atom": f"""WITH {WEIGHTS}
        SELECT atom, sign, rank, pos, round(weight, 6) AS weight FROM (
          SELECT *, CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS sign,
                 row_number() OVER (PARTITION BY atom, weight > 0 ORDER BY abs(weight) DESC, pos) AS rank
          FROM wl WHERE name = '{FIRST}' AND weight <> 0) WHERE rank <= 10""",
    "top_absolute_per_atom": f"""WITH {WEIGHTS}
        SELECT atom, rank, pos, round(weight, 6) AS weight FROM tops WHERE name = '{FIRST}'""",
    "atom_similarity": f"""WITH {WEIGHTS}
        SELECT a.atom AS atom_a, b.atom AS atom_b, round(list_inner_product(a.w, b.w), 6) AS cosine
        FROM atoms a JOIN atoms b ON a.name = '{FIRST}' AND b.name = '{FIRST}' AND a.atom <> b.atom""",
    "atom_order": f"""WITH {CODED}, {CODE_LONG},
        m AS (SELECT atom, max(abs(standardized_mean)) AS c FROM activity WHERE split = 'train' GROUP BY atom)
        SELECT atom, round(c, 6) AS max_contrast, row_number() OVER (ORDER BY round(c, 9) DESC, atom) AS rank FROM m""",
    "atom_diagnostics": f"""WITH {CODED}, {CODE_LONG},
        m AS (SELECT atom, max(abs(standardized_mean)) AS c FROM activity WHERE split = 'train' GROUP BY atom),
        u AS (SELECT atom, avg(CASE WHEN abs(z) > 1e-6 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'train') AS t,
                     avg(CASE WHEN abs(z) > 1e-6 THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'validation') AS v FROM zl GROUP BY atom)
        SELECT atom, round(sqrt(list_inner_product(w, w)), 6) AS norm, round(t, 6) AS train_active_fraction,
               round(v, 6) AS validation_active_fraction, round(c, 6) AS max_contrast
        FROM atoms JOIN u USING (atom) JOIN m USING (atom)""",
    "atom_pairs": f"""WITH {PAIRS}
        SELECT atom_a, atom_b, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, round(correlation, 6) AS correlation FROM pairs""",
    "singular_values": f"""WITH RECURSIVE {VECTORS},
        px AS (SELECT vec_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM vecs),
        cells AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS g FROM px a JOIN px b USING (vec_id) GROUP BY ALL),
        gram0 AS (SELECT list(row_ ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS row_ FROM cells GROUP BY i)),
        total AS (SELECT sum(g) AS t FROM cells WHERE i = j),
        {deflated(1, 'gram0')}, {deflated(2, 'gram1')}, {deflated(3, 'gram2')}
        SELECT rank, round(sqrt(root), 5) AS singular_value, round(root / t, 5) AS share
        FROM (SELECT 1 AS rank, root FROM root1 UNION ALL SELECT 2, root FROM root2 UNION ALL SELECT 3, root FROM root3), total""",
    "seed_stability": f"""WITH {SEED_STABILITY}
        SELECT grp, seed_a, seed_b, round(avg(abs(cosine)), 6) AS mean_abs_cosine, round(median(abs(cosine)), 6) AS median_abs_cosine,
               round(avg(jaccard), 6) AS mean_top_feature_jaccard,
               round(avg(correlation * CASE WHEN cosine >= 0 THEN 1 ELSE -1 END), 6) AS mean_code_correlation
        FROM matched GROUP BY grp, seed_a, seed_b""",
    "atom_matching": f"""WITH RECURSIVE {MATCHING}
        SELECT atom_a, atom_b, CASE WHEN cosine >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, round(abs(cosine), 6) AS abs_cosine,
               round(jaccard, 6) AS top_feature_jaccard,
               round(correlation * CASE WHEN cosine >= 0 THEN 1 ELSE -1 END, 6) AS code_correlation
        FROM pairs JOIN solved USING (atom_a, atom_b)""",
}


def _metrics_cte(name: str, body: str) -> str:
    return f"""{name} AS (WITH {body}, {class_table('pred', 'split')}
        SELECT split, macro_f1, accuracy, balanced_accuracy, log_loss
        FROM (SELECT split, {metric_columns(None)} FROM rates GROUP BY split)
        JOIN (SELECT split, {LOSS} AS log_loss FROM prob WHERE label = c GROUP BY split) USING (split))"""


SQL["probability_audit"] = (
    f"WITH {_metrics_cte('a', PREDICTED)}, {_metrics_cte('b', PREDICTED_SCALED)} " + SQL["probability_audit"]
)
_KKT = f"""WITH {VECTORS}, {dictionaries(FIRST)}, {codes('vecs')},
    both_ AS (
      SELECT 'converged:' || entity_id AS entity_id, alpha, k, g, t, z FROM coded
      UNION ALL SELECT 'zero:' || entity_id, alpha, k, g, t, list_transform(range(k), lambda i: 0.0::DOUBLE) FROM coded),
    slopes AS (
      SELECT entity_id, alpha, unnest(range(1, k + 1)) AS atom, unnest(z) AS z,
             unnest(list_transform(range(1, k + 1), lambda j: list_inner_product(g[j], z) - t[j])) AS s FROM both_),
    kkt AS (
      SELECT entity_id, atom, CASE WHEN z <> 0 THEN abs(s + alpha * sign(z)) ELSE greatest(abs(s) - alpha, 0) END AS residual FROM slopes) """
for _name in ("kkt_residuals", "kkt_summary"):
    SQL[_name] = _KKT + SQL[_name]
