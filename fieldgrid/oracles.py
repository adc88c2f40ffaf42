"""The raster engine's queries as DuckDB SQL."""

from __future__ import annotations

from fieldgrid.functions import projection as pj
from fieldgrid.functions.bands import INDICES
from fieldgrid.plans import fixtures as fx

REQ = fx.REQUIRED


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) >= 1e-6 THEN ({a}) / ({b}) END"


def _indices(have: list[str], alias: bool = True) -> list[str]:
    out = []
    for name, kind, a, b in INDICES:
        if a in have and b in have:
            e = _ratio(f"{a} - {b}", f"({a} + {b})") if kind == "nd" else _ratio(a, b)
            out.append(f"{e} AS {name}" if alias else e)
    return out


F1 = f"f1 AS ({fx.PIXELS})"
F2 = f"f2 AS ({fx.POINTS})"
F3 = f"f3 AS ({fx.SHAPES})"
F4 = f"f4 AS ({fx.SCENES})"
F5 = f"f5 AS ({fx.SCORED})"
FC = f"fc AS ({fx.CLASSES})"
F6 = "r6 AS (SELECT vec_id, list_transform(embedding[1:10], lambda v: greatest(abs(v::DOUBLE), 1e-12)) AS r FROM embeddings), f6 AS (SELECT vec_id, list_transform(r, lambda v: v / list_sum(r)) AS p FROM r6)"
GRID = "g AS (SELECT count(*) / 15.0 AS y0, (count(*) // 150)::INT AS height FROM orders)"
SIX = f"six AS (SELECT prow, pcol, {', '.join(REQ)}, {', '.join(_indices(REQ))} FROM f1)"
NAMES = [n for n, _, a, b in INDICES if a in REQ and b in REQ]
ALL_OK = " AND ".join(f"{c} IS NOT NULL" for c in REQ + NAMES)
MASKED = "mk AS (SELECT scene_id, scene_ord, prow, pcol, CASE WHEN NOT ({}) THEN value END AS value FROM f4)"
NONZERO = MASKED.format("prow % 2 = 0 AND mask <> 0")
INSIDE = """ins AS (SELECT f3.feature_id, f1.prow, f1.pcol FROM f1, f3, g
 WHERE CASE WHEN kind = 'rect' THEN (pcol + 0.5) * 10 BETWEEN f3.x0 AND f3.x0 + w AND g.y0 - (prow + 0.5) * 10 BETWEEN f3.y0 AND f3.y0 + hgt
  ELSE (pcol + 0.5) * 10 > f3.x0 AND g.y0 - (prow + 0.5) * 10 > f3.y0 AND ((pcol + 0.5) * 10 - f3.x0) / w + (g.y0 - (prow + 0.5) * 10 - f3.y0) / hgt < 1 END)"""
PLACED = "pl AS (SELECT f2.*, floor((g.y0 - y) / 10)::INT AS prow, floor(x / 10)::INT AS pcol, g.height FROM f2, g)"
BLOCKS = """bl AS (SELECT feature_id AS sample_id, x, y, label_num::INT AS label, dense_rank() OVER (ORDER BY floor((x - ox) / 100), floor((y - oy) / 100)) - 1 AS block_id
 FROM f2, (SELECT floor(min(x) / 100) * 100 AS ox, floor(min(y) / 100) * 100 AS oy FROM f2))"""
HELD = """hb AS (SELECT block_id FROM (SELECT DISTINCT block_id FROM bl) ORDER BY md5('42:' || block_id), block_id
 LIMIT (SELECT greatest(1, least(count(DISTINCT block_id) - 1, round_even(count(DISTINCT block_id) * 0.2, 0)::BIGINT)) FROM bl))"""
SPLIT = "sp AS (SELECT bl.*, CASE WHEN block_id IN (SELECT block_id FROM hb) THEN 'test' ELSE 'development' END AS split FROM bl)"
GAP = """gp AS (SELECT a.* EXCLUDE (split), CASE WHEN split = 'development' AND EXISTS (SELECT 1 FROM sp b WHERE b.split = 'test' AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 900) THEN 'gap_excluded' ELSE split END AS split FROM sp a)"""
SPLITS = ", ".join([F2, BLOCKS, HELD, SPLIT])
CODES = "cd AS (SELECT f2.*, dense_rank() OVER (ORDER BY label_text) AS code FROM f2)"
POLYGON = f"""ok AS (SELECT f1.* FROM f1 WHERE {' AND '.join(f'{b} IS NOT NULL' for b in REQ)}),
 pr AS (SELECT feature_id, prow, pcol, row_number() OVER (PARTITION BY feature_id ORDER BY md5('42:' || feature_id || ':' || prow || ':' || pcol), prow, pcol) AS rk FROM ins JOIN ok USING (prow, pcol))"""
CONFUSION = "cm AS (SELECT a.l AS label, b.l AS prediction, count(f5.id) AS n FROM (SELECT unnest(range(1, 7))::INT AS l) a CROSS JOIN (SELECT unnest(range(1, 7))::INT AS l) b LEFT JOIN f5 ON f5.label = a.l AND f5.prediction = b.l GROUP BY a.l, b.l)"
PER_CLASS = """pc AS (SELECT l AS label, (SELECT count(*) FROM f5 WHERE label = l) AS support, (SELECT count(*) FROM f5 WHERE prediction = l) AS pred, (SELECT count(*) FROM f5 WHERE prediction = l AND label = l) AS tp
 FROM (SELECT unnest(range(1, 7))::INT AS l)),
 pm AS (SELECT label, CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN pred + support > 0 THEN 2 * tp / (pred + support) ELSE 0.0 END AS f1_score, support FROM pc)"""
FOLDS = """fk AS (SELECT fold, k, count(*) FILTER (label = k) AS t, count(*) FILTER (prediction = k) AS p, count(*) FILTER (label = k AND prediction = k) AS tp FROM f5, (SELECT unnest(range(1, 7)) AS k) GROUP BY fold, k),
 fs AS (SELECT fold, sum(tp) / sum(t) AS accuracy, avg(CASE WHEN t > 0 THEN tp / t END) AS balanced_accuracy, avg(2 * tp / (t + p)) AS macro_f1 FROM fk WHERE t + p > 0 GROUP BY fold)"""


def _fold_scores(rows: str) -> str:
    """Mean scores over the folds of rows(candidate, label, prediction, fold)."""
    return f"""rw AS ({rows}), fk AS (SELECT candidate, fold, k, count(*) FILTER (label = k) AS t, count(*) FILTER (prediction = k) AS p, count(*) FILTER (label = k AND prediction = k) AS tp FROM rw, (SELECT unnest(range(1, 7)) AS k) GROUP BY ALL),
 fs AS (SELECT candidate, fold, sum(tp) / sum(t) AS accuracy, avg(CASE WHEN t > 0 THEN tp / t END) AS balanced_accuracy, avg(2 * tp / (t + p)) AS macro_f1 FROM fk WHERE t + p > 0 GROUP BY ALL),
 ms AS (SELECT candidate, round(avg(accuracy), 9) AS accuracy, round(avg(balanced_accuracy), 9) AS balanced_accuracy, round(avg(macro_f1), 9) AS macro_f1 FROM fs GROUP BY candidate)"""


def _krueger(terms: list[float], sign: str) -> str:
    east = " ".join(f"{sign} {c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(terms, 1))
    return f"xi {east.replace('cos', '#').replace('sinh', 'cosh').replace('#', 'sin')} AS n, eta {east} AS e"


def _to_utm(source: str, lon0: int, keys: str) -> str:
    """tu(keys, x, y): rows(keys, lon, lat) in metres of the southern zone around lon0."""
    return f"""t1 AS (SELECT {keys}, sinh(atanh(sin(radians(lat))) - {pj._E!r} * atanh({pj._E!r} * sin(radians(lat)))) AS t, radians(lon - {lon0}) AS l FROM {source}),
 t2 AS (SELECT {keys}, atan2(t, cos(l)) AS xi, atanh(sin(l) / sqrt(t * t + 1)) AS eta FROM t1), t3 AS (SELECT {keys}, {_krueger(pj.ALPHA, '+')} FROM t2),
 tu AS (SELECT {keys}, 500000 + {pj.K0 * pj.RADIUS!r} * e AS x, 10000000 + {pj.K0 * pj.RADIUS!r} * n AS y FROM t3)"""


def _from_utm(source: str, lon0: int, keys: str) -> str:
    """ll(keys, lon, lat): rows(keys, x, y) of the southern zone around lon0 in degrees."""
    phi = "chi"
    for _ in range(6):
        phi = f"asin(tanh(atanh(sin(chi)) + {pj._E!r} * atanh({pj._E!r} * sin({phi}))))"
    return f"""l1 AS (SELECT {keys}, (y - 10000000) / {pj.K0 * pj.RADIUS!r} AS xi, (x - 500000) / {pj.K0 * pj.RADIUS!r} AS eta FROM {source}), l2 AS (SELECT {keys}, {_krueger(pj.BETA, '-')} FROM l1),
 l3 AS (SELECT {keys}, {lon0} + degrees(atan2(sinh(e), cos(n))) AS lon, asin(sin(n) / cosh(e)) AS chi FROM l2), ll AS (SELECT {keys}, lon, degrees({phi}) AS lat FROM l3)"""


def _majority(k: int) -> str:
    return f"""{FC}, {GRID}, ov AS (SELECT unnest(range(-{k}, {k} + 1)) AS o),
 vt AS (SELECT c.prow, c.pcol, c.label AS own, n.label AS v, count(*) AS n FROM fc c CROSS JOIN ov a CROSS JOIN ov b CROSS JOIN g
  JOIN fc n ON n.prow = greatest(0, least(g.height - 1, c.prow + a.o)) AND n.pcol = greatest(0, least(149, c.pcol + b.o)) WHERE c.label IS NOT NULL AND n.label IS NOT NULL GROUP BY ALL),
 mj AS (SELECT prow, pcol, v AS label FROM vt QUALIFY row_number() OVER (PARTITION BY prow, pcol ORDER BY n DESC, (v = own) DESC, v) = 1)"""


_rest = ", ".join(REQ)
_tried = "SELECT 'constant' AS candidate, label, 1 AS prediction, fold FROM f5 UNION ALL SELECT unnest(['given', 'again']), label, prediction, fold FROM f5"
_baseline = """SELECT 'baseline' AS candidate, label, m.k AS prediction, f5.fold FROM f5 JOIN (SELECT g.fold, l.label AS k FROM (SELECT DISTINCT fold FROM f5) g JOIN f5 l ON l.fold <> g.fold
 GROUP BY g.fold, l.label QUALIFY row_number() OVER (PARTITION BY g.fold ORDER BY count(*) DESC, l.label) = 1) m ON m.fold = f5.fold"""
ORACLES = {
    "spectral_indices": f"WITH {F1}, {SIX} SELECT * FROM six",
    "red_edge_indices": f"WITH {F1} SELECT prow, pcol, {', '.join(_indices(REQ + fx.OPTIONAL)[8:])} FROM f1",
    "valid_pixels": f"WITH {F1}, {SIX} SELECT prow, pcol, {ALL_OK} AS valid FROM six",
    "common_valid": f"WITH {F1}, k AS (SELECT *, coalesce({' AND '.join(f'{b} <> 0' for b in REQ)}, false) AS k FROM f1) SELECT prow, pcol, {', '.join(f'CASE WHEN k THEN {b} END AS {b}' for b in REQ)} FROM k",
    "land_cover_summary": f"WITH {F1}, {SIX} SELECT CASE WHEN NDVI > 0.99 THEN 1 WHEN NDVI > 0.97 THEN 2 ELSE 3 END AS code, count(*) AS n, sum(floor(NDVI * 1000000)::BIGINT)::BIGINT AS ndvi_micro FROM six WHERE {ALL_OK} GROUP BY 1",
    "cloud_mask_nonzero": f"WITH {F1}, {F4}, {NONZERO} SELECT scene_id, prow, pcol, value FROM mk",
    "cloud_mask_values": f"WITH {F1}, {F4}, {MASKED.format('prow % 2 = 0 AND mask = 3')} SELECT scene_id, prow, pcol, value FROM mk",
    "complete_scenes": "SELECT scene_id, (row_number() OVER (ORDER BY scene_id) - 1)::INT AS scene_ord FROM (VALUES ('S1'), ('S2'), ('S4')) v(scene_id)",
    "optional_band_completeness": "SELECT band FROM (VALUES ('B06'), ('B07'), ('B8A')) v(band)",
    "band_candidate_pick": """SELECT * FROM (VALUES ('A', 'B02', 'A/T_B02_10m.jp2', 10.0::DOUBLE, false), ('A', 'B03', 'A/X_FRE_B3.tif', NULL, false), ('A', 'B8A', 'A/T_B8A_20m.jp2', 20.0, false), ('A', 'B11', 'A/T_B11_60m.jp2', 60.0, false),
 ('B', 'B02', 'B/R20m/T_B02.jp2', 20.0, false), ('B', 'B12', 'B/one_B12.tif', NULL, true)) v(scene_id, band, path, resolution, ambiguous)""",
    "scene_bounds_union": f"""WITH {F1}, {F4}, {GRID}, e AS (SELECT scene_id, min(pcol * 10.0)::DOUBLE AS xmin, min(y0 - prow * 10 - 10)::DOUBLE AS ymin, max(pcol * 10.0 + 10)::DOUBLE AS xmax, max(y0 - prow * 10)::DOUBLE AS ymax FROM f4, g GROUP BY scene_id),
 u AS (SELECT * FROM e UNION ALL SELECT 'all', min(xmin), min(ymin), max(xmax), max(ymax) FROM e),
 c AS (SELECT scene_id, greatest(xmin, 100.0) AS xmin, greatest(ymin, 20.0) AS ymin, least(xmax, 700.0) AS xmax, least(ymax, 60.0) AS ymax FROM u) SELECT *, xmin < xmax AND ymin < ymax AS overlaps FROM c""",
    "mosaic_first_valid": f"WITH {F1}, {F4}, {NONZERO} SELECT prow, pcol, arg_min(value, scene_ord) AS value FROM mk WHERE value IS NOT NULL GROUP BY prow, pcol",
    "feature_stack_pivot": f"WITH {F1} SELECT prow, pcol, {', '.join(f'CASE WHEN pcol % 3 <> 0 THEN {b} ELSE {b} + 1000 END AS {b}' for b in REQ)} FROM f1 WHERE B02 IS NOT NULL",
    "resample_nearest": f"""WITH {F1}, {GRID}, t AS (SELECT unnest(range(0, ceil(height * 10 / 25.0)::INT))::INT AS r FROM g), c AS (SELECT unnest(range(0, 60))::INT AS c)
 SELECT r AS prow, c AS pcol, B08 FROM t CROSS JOIN c JOIN f1 ON f1.prow = floor((r + 0.5) * 2.5) AND f1.pcol = floor((c + 0.5) * 2.5)""",
    "resample_bilinear": f"""WITH {F1}, {GRID}, t AS (SELECT unnest(range(0, ceil(height * 10 / 4.0)::INT))::INT AS r FROM g), c AS (SELECT unnest(range(0, 375))::INT AS c), o AS (SELECT unnest([0, 1]) AS o),
 u AS (SELECT r, c, floor((r + 0.5) * 0.4 - 0.5) + a.o AS sr, floor((c + 0.5) * 0.4 - 0.5) + b.o AS sc FROM t CROSS JOIN c CROSS JOIN o a CROSS JOIN o b),
 w AS (SELECT r, c, (1 - abs((r + 0.5) * 0.4 - 0.5 - sr)) * (1 - abs((c + 0.5) * 0.4 - 0.5 - sc)) AS w, B08 FROM u JOIN f1 ON f1.prow = sr AND f1.pcol = sc WHERE B08 IS NOT NULL)
 SELECT r AS prow, c AS pcol, round(sum(w * B08) / sum(w), 6) AS B08 FROM w WHERE w > 1e-12 GROUP BY r, c""",
    "xy_to_rowcol": f"WITH {F2}, {GRID}, {PLACED} SELECT feature_id, prow, pcol, prow BETWEEN 0 AND height - 1 AND pcol BETWEEN 0 AND 149 AS inside FROM pl",
    "pixel_centers": f"WITH {F1}, {GRID} SELECT prow, pcol, ((pcol + 0.5) * 10)::DOUBLE AS x, (y0 - (prow + 0.5) * 10)::DOUBLE AS y FROM f1, g",
    "point_sample": f"WITH {F1}, {F2}, {GRID}, {PLACED} SELECT feature_id, x, y, prow, pcol, {_rest} FROM pl JOIN f1 USING (prow, pcol) WHERE {' AND '.join(f'{b} IS NOT NULL' for b in REQ)}",
    "polygon_sample_capped": f"WITH {F1}, {F3}, {GRID}, {INSIDE}, {POLYGON} SELECT feature_id, prow, pcol, {_rest}, ((pcol + 0.5) * 10)::DOUBLE AS x, (g.y0 - (prow + 0.5) * 10)::DOUBLE AS y FROM pr JOIN ok USING (prow, pcol), g WHERE rk <= 20",
    "aoi_mask": f"WITH {F1}, {F3}, {GRID}, {INSIDE} SELECT prow, pcol, B08 FROM f1 WHERE (prow, pcol) IN (SELECT (prow, pcol) FROM ins)",
    "label_coercion_numeric": f"WITH {F2} SELECT feature_id, label_num::INT AS code FROM f2",
    "label_coercion_text": f"WITH {F2}, {CODES} SELECT feature_id, code::INT AS code FROM cd",
    "class_names": f"WITH {F2}, {CODES} SELECT code::INT AS label, arg_min('class ' || lower(label_text) || ' ' || feature_id, feature_id) AS class_name FROM cd GROUP BY code",
    "extraction_report": f"""WITH {F1}, {F2}, {F3}, {GRID}, {PLACED}, {INSIDE}, {POLYGON},
 ps AS (SELECT feature_id, count(*) AS n FROM pl JOIN ok USING (prow, pcol) WHERE feature_id % 40 <> 7 GROUP BY feature_id UNION ALL SELECT feature_id + 1000000, count(*) FROM pr WHERE rk <= 20 AND (feature_id + 1000000) % 10 <> 9 GROUP BY feature_id),
 ft AS (SELECT feature_id, CASE WHEN feature_id % 40 = 7 THEN 'L' ELSE 'P' END AS k FROM f2 UNION ALL SELECT feature_id + 1000000, CASE WHEN (feature_id + 1000000) % 10 = 9 THEN 'E' ELSE 'G' END FROM f3)
 SELECT count(*) AS source_objects, sum(coalesce(n, 0))::BIGINT AS sampled_pixels, count(*) FILTER (n IS NULL) AS skipped_objects, count(*) FILTER (k = 'P') AS point_objects, count(*) FILTER (k = 'G') AS polygon_objects, count(*) FILTER (k = 'L') AS unsupported_objects FROM ft LEFT JOIN ps USING (feature_id)""",
    "spatial_blocks": f"WITH {F2}, {BLOCKS} SELECT sample_id, block_id FROM bl",
    "class_block_report": f"WITH {F2}, {BLOCKS} SELECT label, count(*) AS samples, count(DISTINCT block_id) AS blocks FROM bl GROUP BY label",
    "holdout_blocks": f"WITH {F2}, {BLOCKS}, {HELD} SELECT block_id FROM hb",
    "holdout_split": f"WITH {SPLITS} SELECT sample_id, block_id, split FROM sp",
    "gap_exclusion": f"WITH {SPLITS}, {GAP} SELECT sample_id, split FROM gp",
    "class_coverage": f"WITH {SPLITS} SELECT label FROM (SELECT label FROM sp UNION SELECT 99) WHERE label NOT IN (SELECT label FROM sp WHERE split = 'test')",
    "dev_class_support": f"WITH {SPLITS}, {GAP} SELECT label, count(*) AS samples, count(DISTINCT block_id) AS blocks FROM gp WHERE split = 'development' GROUP BY label",
    "group_leakage": f"WITH {SPLITS} SELECT count(*) AS n_shared FROM (SELECT block_id FROM sp WHERE split = 'test' INTERSECT SELECT block_id FROM sp WHERE split = 'development')",
    "cv_split_count": f"WITH {SPLITS}, c AS (SELECT label, count(DISTINCT block_id) AS b FROM sp WHERE split = 'development' GROUP BY label) SELECT least(5, (SELECT count(DISTINCT block_id) FROM sp WHERE split = 'development'), min(b))::INT AS n_splits, min(b) >= 2 AS feasible FROM c",
    "confusion_matrix": f"WITH {F5}, {CONFUSION} SELECT * FROM cm",
    "confusion_matrix_normalized": f"WITH {F5}, {CONFUSION}, s AS (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM cm) SELECT label, prediction, n, CASE WHEN t > 0 THEN n / t ELSE 0.0 END AS share FROM s",
    "per_class_metrics": f"WITH {F5}, {PER_CLASS} SELECT pm.*, coalesce(class_name, label::VARCHAR) AS class_name FROM pm LEFT JOIN (VALUES (1, 'forest'), (2, 'water'), (3, 'crop')) v(label, class_name) USING (label)",
    "overall_metrics": f"""WITH {F5}, {PER_CLASS} SELECT (SELECT count(*) FROM f5) AS n_samples, round((SELECT avg((label = prediction)::INT) FROM f5), 9) AS accuracy, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy,
 round(avg(f1_score), 9) AS macro_f1, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(sum(f1_score * support) / sum(support), 9) AS weighted_f1 FROM pm""",
    "fold_summary": f"WITH {F5}, {FOLDS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 9) AS mean, round(stddev_samp({m}), 9) AS std, count(*)::INT AS n_folds FROM fs" for m in ("accuracy", "balanced_accuracy", "macro_f1")),
    "class_weights": f"WITH {F5} SELECT label, (SELECT count(*) FROM f5) / ((SELECT count(DISTINCT label) FROM f5) * count(*)) AS weight FROM f5 GROUP BY label",
    "dummy_prior": f"WITH {F5}, c AS (SELECT label, count(*) AS c FROM f5 GROUP BY label) SELECT label, c / sum(c) OVER () AS prior, row_number() OVER (ORDER BY c DESC, label) = 1 AS is_majority FROM c",
    "standard_scale": f"WITH {F1} SELECT prow, pcol, round((B03 - (SELECT avg(B03) FROM f1)) / (SELECT stddev_pop(B03) FROM f1), 6) AS B03, round((B08 - (SELECT avg(B08) FROM f1)) / (SELECT stddev_pop(B08) FROM f1), 6) AS B08 FROM f1 WHERE B08 IS NOT NULL",
    "normalized_entropy": f"WITH {F6} SELECT vec_id, round((-list_sum(list_transform(p, lambda v: v * ln(v))) / ln(10))::FLOAT::DOUBLE, 5) AS entropy FROM f6",
    "confidence_uncertainty": f"WITH {F6} SELECT vec_id, list_position(p, list_max(p))::INT AS class, round(list_max(p)::FLOAT::DOUBLE, 5) AS confidence, round((1::FLOAT - list_max(p)::FLOAT)::DOUBLE, 5) AS uncertainty FROM f6",
    "probability_scores_long": f"WITH {F6} SELECT vec_id, 'class_' || k || '_score' AS band, round(p[k], 6) AS score FROM f6, (SELECT unnest(range(1, 11)) AS k)",
    "majority_filter_3": f"WITH {_majority(1)} SELECT prow, pcol, label FROM mj",
    "majority_filter_5": f"WITH {_majority(2)} SELECT prow, pcol, label FROM mj",
    "filtered_holdout_lookup": f"WITH {F2}, {_majority(1)}, {PLACED} SELECT feature_id, prow, pcol, label AS found FROM pl JOIN mj USING (prow, pcol)",
    "class_legend": f"""WITH {F2}, {CODES}, n AS (SELECT code::INT AS label, arg_min(label_text, feature_id) AS name FROM cd GROUP BY code),
 i AS (SELECT *, (row_number() OVER (ORDER BY label) - 1) / count(*) OVER () AS h FROM n),
 k AS (SELECT *, floor(h * 6)::INT % 6 AS s, h * 6 - floor(h * 6) AS f, 0.9 AS v, 0.9::DOUBLE * (1 - 0.65::DOUBLE) AS p, 0.9::DOUBLE * (1 - 0.65::DOUBLE * (h * 6 - floor(h * 6))) AS q, 0.9::DOUBLE * (1 - 0.65::DOUBLE * (1 - (h * 6 - floor(h * 6)))) AS t FROM i)
 SELECT label, name, floor(255 * [v, q, p, p, t, v][s + 1])::INT AS red, floor(255 * [t, v, v, q, p, p][s + 1])::INT AS green, floor(255 * [p, p, t, v, v, q][s + 1])::INT AS blue FROM k""",
    "index_stack_schema": "SELECT ord::INT AS ord, name, is_raw FROM (VALUES " + ", ".join(f"({i}, '{n}', {str(n in fx.REQUIRED + fx.OPTIONAL).lower()})" for i, n in enumerate(["B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12", *[x[0] for x in INDICES]])) + ") v(ord, name, is_raw)",
    "discovered_files": """SELECT * FROM (VALUES ('X.SAFE/GRANULE/G1', 0, 'B02', 'X.SAFE/GRANULE/G1/IMG_DATA/R10m/T_B02_10m.jp2'), ('X.SAFE/GRANULE/G1', 0, 'B11', 'X.SAFE/GRANULE/G1/IMG_DATA/R20m/T_B11_20m.jp2'),
 ('Y', 1, 'B02', 'Y/a_B02_10m.tif'), ('Y', 1, 'B11', 'Y/a_B11_20m.tif')) v(scene_id, scene_ord, band, path)""",
    "cloud_mask_files": "SELECT * FROM (VALUES ('X.SAFE/GRANULE/G1', 'X.SAFE/GRANULE/G1/QI_DATA/MSK_CLOUDS_B00.jp2'), ('Y', NULL), ('Z', 'Z/MSK_CLOUDS_Z.tif')) v(scene_id, mask_path)",
    "product_systems": "SELECT * FROM (VALUES ('epsg', 32735), ('number', 4326), ('empty', NULL), ('other', NULL), ('absent', NULL)) v(product, srid)",
    "safe_scene_names": "SELECT s_suppkey, regexp_replace(s_name || ' / é.' || s_nationkey, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM supplier",
    "geotiff_window": f"WITH {F1} SELECT prow, pcol, B08::DOUBLE AS value FROM f1 WHERE B08 IS NOT NULL AND prow >= 2 AND prow < 75 AND prow < (SELECT count(*) // 150 FROM orders) AND pcol >= 20 AND pcol < 90",
    "resample_between_zones": f"""WITH {F1}, px AS (SELECT r::INT AS r, c::INT AS c, {fx.OVER.x0} + (c + 0.5) * 10 AS x, {fx.OVER.y0} - (r + 0.5) * 10 AS y FROM (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 200)) AS c)),
 {_from_utm('px', 33, 'r, c')}, {_to_utm('ll', 27, 'r, c')} SELECT r AS prow, c AS pcol, B08 FROM tu JOIN f1 ON f1.prow = floor(({fx.EAST[1]} - y) / 10) AND f1.pcol = floor((x - {fx.EAST[0]}) / 10)""",
    "utm_coordinates": f"WITH {F2}, ps AS (SELECT feature_id, 25 + x / 500 AS lon, y / 500 - 30 AS lat FROM f2), {_to_utm('ps', 27, 'feature_id')} SELECT feature_id, round(x, 4) AS x, round(y, 4) AS y, true AS same FROM tu",
    "fold_invariants": f"""WITH {SPLITS}, dv AS (SELECT * FROM sp WHERE split = 'development')
 SELECT count(*) AS samples, true AS folds_allowed, count(DISTINCT block_id) AS blocks, 0::BIGINT AS split_blocks, 0::BIGINT AS without_validation, 0::BIGINT AS without_training FROM dv""",
    "best_candidate": f"WITH {F5}, {_fold_scores(_tried)} SELECT candidate, macro_f1, candidate = 'given' AS chosen FROM ms",
    "baseline_scores": f"WITH {F5}, {_fold_scores(_baseline)} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS mean FROM ms" for m in ("balanced_accuracy", "macro_f1", "accuracy")),
    "kept_features": "SELECT * FROM (VALUES ('median', 0), ('median', 1), ('median', 2), ('mean', 1), ('mean', 2), ('0.6', 1)) v(keep, feature)",
    "drawn_trials": "SELECT * FROM (VALUES ('forest', 18, 18), ('machine', 15, 15), ('small', 2, 2)) v(space, n, n_distinct)",
    "rf_map_consistency": f"WITH {F1}, {SIX} SELECT prow, pcol, {ALL_OK} AS classified, {ALL_OK} AS consistent FROM six",
}
