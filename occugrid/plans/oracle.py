"""DuckDB SQL that states independently what the queries of the catalog must return."""

from __future__ import annotations

# Tables of the fixture and the steps that several queries share, as (name, body).
_CTES: dict[str, str] = {
    "obs": """
        SELECT event_id AS row_id,
               CAST(user_id % 24 - 11 AS DOUBLE) + (event_id % 4) / 4.0 AS lat,
               CAST((user_id * 7 + event_id % 3) % 40 - 20
                    + CASE WHEN event_id % 40 = 0 THEN 40 + (event_id // 40) % 90 ELSE 0 END
                    AS DOUBLE) + (k % 4) / 4.0 AS lon,
               1000 + (user_id % 24) * 4 + (k * k) // 160 AS taxon_id,
               event_type
        FROM (SELECT event_id, user_id, event_type,
                     CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "taxa": """
        SELECT DISTINCT taxon_id,
               CASE WHEN taxon_id % 10 <> 0 THEN 'taxon_' || taxon_id END AS taxon_name
        FROM obs""",
    "unique_obs": """
        SELECT lat, lon, taxon_id, min(row_id) AS row_id FROM (
            SELECT row_id, lat, lon, taxon_id FROM obs WHERE event_type <> 'error'
            UNION ALL
            SELECT row_id + 4611686018427387904, lat, lon, taxon_id FROM obs
            WHERE event_type IN ('error', 'signup'))
        GROUP BY lat, lon, taxon_id""",
    "feats": """
        SELECT u.row_id, u.lat, u.lon, u.taxon_id, t.taxon_name,
               CAST(floor(u.lat) AS BIGINT) AS grid_lat,
               CAST(floor(u.lon) AS BIGINT) AS grid_lon,
               CAST(floor(u.lat) AS BIGINT) || '°' || CAST(floor(u.lon) AS BIGINT) || '°' AS region,
               CASE WHEN u.lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere,
               sin(radians(u.lon)) AS sin_lon, cos(radians(u.lon)) AS cos_lon
        FROM unique_obs u LEFT JOIN taxa t USING (taxon_id)""",
    "rt": "SELECT DISTINCT region, taxon_id FROM feats",
    "supp": """
        SELECT taxon_id, count(*) AS n_regions, min(region) AS first_region
        FROM rt GROUP BY taxon_id""",
    "ranked": """
        SELECT *, CAST(row_number() OVER (
                   ORDER BY n_regions DESC, first_region, taxon_id) - 1 AS INTEGER) AS label_rank
        FROM supp""",
    "names": """
        SELECT taxon_id, arg_max_null(taxon_name, seen) AS taxon_name FROM (
            SELECT taxon_id, taxon_name, min(row_id) AS seen FROM feats GROUP BY ALL)
        GROUP BY taxon_id""",
    "regs": """
        SELECT region, min(grid_lat) AS grid_lat, min(grid_lon) AS grid_lon,
               arg_min(sin_lon, row_id) AS sin_lon, arg_min(cos_lon, row_id) AS cos_lon,
               min(hemisphere) AS hemisphere,
               min(grid_lat) * 1000 + min(grid_lon) AS group_key
        FROM feats GROUP BY region""",
    "matrix": """
        SELECT r.region, r.group_key, t.taxon_id, t.label_rank,
               CAST(EXISTS (SELECT 1 FROM rt WHERE rt.region = r.region
                            AND rt.taxon_id = t.taxon_id) AS INTEGER) AS y
        FROM regs r CROSS JOIN (SELECT * FROM ranked WHERE label_rank < 50) t""",
    "folds_all": """
        SELECT region, group_key,
               CAST((row_number() OVER (ORDER BY group_key DESC) - 1) % 5 + 1 AS INTEGER) AS fold
        FROM regs""",
    "folds_labelled": """
        SELECT region, group_key,
               CAST((row_number() OVER (ORDER BY group_key DESC) - 1) % 5 + 1 AS INTEGER) AS fold
        FROM regs WHERE region IN (SELECT region FROM matrix WHERE y = 1)""",
    "scored": """
        SELECT f.fold, m.region, m.taxon_id, m.label_rank, m.y,
               ((abs(r.grid_lat) * 7 + abs(r.grid_lon) * 3 + m.taxon_id) % 33) / 64.0
               + CASE WHEN m.y = 1 THEN 0.25 ELSE 0 END AS p
        FROM matrix m JOIN regs r USING (region) JOIN folds_all f USING (region)
        WHERE m.label_rank < 50""",
    "f1_label": """
        SELECT *, CASE WHEN tp + fp + fn = 0 THEN 0.0
                       ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1
        FROM (SELECT fold, taxon_id,
                     CAST(sum(CASE WHEN y = 1 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                     CAST(sum(CASE WHEN y = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                     CAST(sum(CASE WHEN y = 1 AND p <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
                     CAST(sum(y) AS BIGINT) AS n_pos, count(*) - CAST(sum(y) AS BIGINT) AS n_neg
              FROM scored GROUP BY fold, taxon_id)""",
    "f1_fold": """
        SELECT fold, CAST(2 * sum(tp) AS DOUBLE) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1,
               avg(f1) AS macro_f1
        FROM f1_label GROUP BY fold""",
    "curve_label": """
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT fold, taxon_id, p, CAST(sum(y) AS DOUBLE) AS pos,
                     CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY fold, taxon_id, p)
        WINDOW w AS (PARTITION BY fold, taxon_id ORDER BY p DESC)""",
    "curve_fold": """
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
        FROM (SELECT fold, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
              FROM scored GROUP BY fold, p)
        WINDOW w AS (PARTITION BY fold ORDER BY p DESC)""",
    "rank_label": """
        SELECT fold, taxon_id,
               CASE WHEN sum(pos) * sum(neg) > 0
                    THEN sum(neg * (tp - pos) + 0.5 * neg * pos) / (sum(pos) * sum(neg)) END AS roc_auc,
               CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS pr_auc
        FROM curve_label GROUP BY fold, taxon_id""",
    "rank_fold": """
        SELECT fold,
               CASE WHEN sum(pos) * sum(neg) > 0
                    THEN sum(neg * (tp - pos) + 0.5 * neg * pos) / (sum(pos) * sum(neg)) END AS roc_auc,
               CASE WHEN sum(pos) > 0 THEN sum(pos * tp / (tp + fp)) / sum(pos) END AS pr_auc
        FROM curve_fold GROUP BY fold""",
    "six": """
        SELECT m.fold, m.roc_auc AS roc_auc_micro, coalesce(m.pr_auc, 0.0) AS pr_auc_micro,
               f.micro_f1 AS f1_micro, a.roc_auc_macro, a.pr_auc_macro, f.macro_f1 AS f1_macro
        FROM rank_fold m JOIN f1_fold f USING (fold) JOIN (
            SELECT fold, CASE WHEN count(roc_auc) = count(*) THEN avg(roc_auc) END AS roc_auc_macro,
                   avg(coalesce(pr_auc, 0.0)) AS pr_auc_macro
            FROM rank_label GROUP BY fold) a USING (fold)""",
    "chosen": "SELECT taxon_id FROM taxa ORDER BY md5('42:' || taxon_id), taxon_id LIMIT 1",
}


def _with(select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in _CTES.items()) + select


def _recursive(select: str) -> str:
    return _with(select).replace("WITH", "WITH RECURSIVE", 1)


def _with_gaps(select: str) -> str:
    """Every fifth species has one class only in fold 1."""
    every = "WHERE m.label_rank < 50"
    lost = "CASE WHEN m.label_rank % 2 = 0 THEN m.y = 1 ELSE m.y = 0 END"
    return _with(select).replace(every, f"{every} AND NOT (f.fold = 1 AND m.label_rank % 5 = 0 AND {lost})", 1)


_GAP_METRICS = """,
gaps AS (
    SELECT r.fold, r.taxon_id, r.roc_auc, r.pr_auc,
           CASE WHEN f.n_pos > 0 AND f.n_neg > 0 THEN f.f1 END AS f1
    FROM rank_label r JOIN f1_label f USING (fold, taxon_id))
"""


_PYRAMID = """,
cells AS (
    SELECT l.level,
           CAST(least(floor((lon - -180.0) / 360.0 * 1024), 1023) AS BIGINT) >> (10 - l.level) AS x,
           CAST(least(floor((lat - -90.0) / 180.0 * 1024), 1023) AS BIGINT) >> (10 - l.level) AS y,
           count(*) AS n
    FROM feats, (SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS level) l GROUP BY ALL),
pyramid AS (
    SELECT c.level, c.x, c.y, c.n, p.n AS parent_n,
           array_to_string(list_transform(range(c.level - 1, -1, -1), lambda b:
               CAST(((c.x >> b) & 1) + 2 * ((c.y >> b) & 1) AS VARCHAR)), '') AS quadkey,
           coalesce(p.n > 40, true) AND (c.n <= 40 OR c.level = 10) AS shown
    FROM cells c LEFT JOIN cells p ON p.level = c.level - 1 AND p.x = c.x >> 1 AND p.y = c.y >> 1)
"""


def _pairs(min_species_support: int, min_pair_count: int) -> str:
    return _with(f""",
freq AS (SELECT * FROM ranked JOIN names USING (taxon_id) WHERE n_regions >= {min_species_support}),
total AS (SELECT count(*) AS n FROM regs),
shared AS (
    SELECT a.taxon_id AS a, b.taxon_id AS b, count(*) AS n_ab
    FROM rt a JOIN rt b ON a.region = b.region AND a.taxon_id <> b.taxon_id GROUP BY ALL),
pairs AS (
    SELECT a.taxon_id AS species_a, b.taxon_id AS species_b, a.taxon_name AS species_a_name,
           b.taxon_name AS species_b_name, a.n_regions AS n_a, b.n_regions AS n_b,
           coalesce(s.n_ab, 0) AS n_ab
    FROM freq a JOIN freq b ON a.label_rank < b.label_rank
    LEFT JOIN shared s ON s.a = a.taxon_id AND s.b = b.taxon_id),
measured AS (
    SELECT pairs.*, n_a / CAST(n AS DOUBLE) AS sa, n_b / CAST(n AS DOUBLE) AS sb,
           n_ab / CAST(n AS DOUBLE) AS sab
    FROM pairs CROSS JOIN total WHERE n_ab >= {min_pair_count})
SELECT species_a, species_b, species_a_name, species_b_name, n_a, n_b, n_ab,
       round(sa, 9) AS support_a, round(sb, 9) AS support_b, round(sab, 9) AS support_ab,
       round(CAST(n_ab AS DOUBLE) / (n_a + n_b - n_ab), 9) AS jaccard,
       round(CAST(n_ab AS DOUBLE) / n_b, 9) AS p_a_given_b,
       round(sab / (sa * sb), 9) AS lift
FROM measured""")


def _histogram(column: str) -> str:
    return _with(f""",
span AS (SELECT CASE WHEN min({column}) = max({column}) THEN min({column}) - 0.5 ELSE min({column}) END AS lo,
                CASE WHEN min({column}) = max({column}) THEN max({column}) + 0.5 ELSE max({column}) END AS hi
         FROM feats),
guessed AS (SELECT {column} AS x, lo, (hi - lo) / 60 AS step,
                   least(CAST(floor(({column} - lo) / (hi - lo) * 60) AS BIGINT), 59) AS g
            FROM feats CROSS JOIN span),
counts AS (SELECT CASE WHEN x < g * step + lo THEN g - 1
                       WHEN g < 59 AND x >= (g + 1) * step + lo THEN g + 1 ELSE g END AS bin,
                  count(*) AS n FROM guessed GROUP BY 1)
SELECT r.bin, round(r.bin * ((hi - lo) / 60) + lo, 9) AS bin_start, coalesce(c.n, 0) AS n
FROM (SELECT unnest(range(60)) AS bin) r CROSS JOIN span LEFT JOIN counts c USING (bin)""")


def _dataset(folds: str) -> str:
    return _with(f"""
SELECT r.region, r.grid_lat, r.grid_lon, round(r.sin_lon, 9) AS sin_lon,
       round(r.cos_lon, 9) AS cos_lon,
       CAST(r.hemisphere = 'S' AS INTEGER) AS "hemisphere_S", r.group_key, f.fold, m.labels
FROM regs r JOIN {folds} f USING (region) JOIN (
    SELECT region, string_agg(CAST(y AS VARCHAR), '' ORDER BY label_rank) AS labels
    FROM matrix GROUP BY region) m USING (region)""")


ORACLE: dict[str, str] = {
    "observation_features": _with("""
SELECT lat, lon, taxon_id, taxon_name, grid_lat, grid_lon, region, hemisphere,
       round(sin_lon, 9) AS sin_lon, round(cos_lon, 9) AS cos_lon FROM feats"""),
    "test_location_features": _with("""
SELECT row_id AS loc_id, lat, lon, CAST(floor(lat) AS BIGINT) AS grid_lat,
       CAST(floor(lon) AS BIGINT) AS grid_lon,
       CAST(floor(lat) AS BIGINT) || '°' || CAST(floor(lon) AS BIGINT) || '°' AS region,
       CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS hemisphere,
       round(sin(radians(lon)), 9) AS sin_lon, round(cos(radians(lon)), 9) AS cos_lon
FROM obs"""),
    "region_baskets": _with("""
SELECT region, string_agg(CAST(taxon_id AS VARCHAR), ',' ORDER BY taxon_id) AS species_list
FROM rt GROUP BY region"""),
    "top_species_lists": _with("""
SELECT region, string_agg(CAST(taxon_id AS VARCHAR), ',' ORDER BY taxon_id) AS species_topk
FROM matrix WHERE y = 1 GROUP BY region"""),
    "species_support": _with("""
SELECT taxon_id, n_regions, first_region FROM supp WHERE n_regions >= 10"""),
    "species_name_map": _with(" SELECT taxon_id, taxon_name FROM names"),
    "cooccurrence_pairs": _pairs(10, 20),
    "cooccurrence_pairs_low_threshold": _pairs(3, 3),
    "top_k_species": _with("""
SELECT taxon_id, n_regions, first_region, label_rank FROM ranked WHERE label_rank < 50"""),
    "top_10_species": _with("""
SELECT label_rank, taxon_id, n_regions FROM ranked WHERE label_rank < 10"""),
    "region_features": _with("""
SELECT region, grid_lat, grid_lon, round(sin_lon, 9) AS sin_lon, round(cos_lon, 9) AS cos_lon,
       hemisphere FROM regs"""),
    "hemisphere_counts": _with(" SELECT hemisphere, count(*) AS n FROM feats GROUP BY 1"),
    "lat_histogram": _histogram("lat"),
    "lon_histogram": _histogram("lon"),
    "hexbin_density": _with(""",
span AS (SELECT min(lon) - (max(lon) - min(lon)) * 1e-9 AS x0,
                (max(lon) + (max(lon) - min(lon)) * 1e-9
                 - (min(lon) - (max(lon) - min(lon)) * 1e-9)) / 80 AS sx,
                min(lat) AS y0, (max(lat) - min(lat)) / 46 AS sy FROM feats),
scaled AS (SELECT (lon - x0) / sx AS x, (lat - y0) / sy AS y FROM feats CROSS JOIN span),
candidates AS (
    SELECT CAST(round_even(x, 0) AS BIGINT) AS i1, CAST(round_even(y, 0) AS BIGINT) AS j1,
           CAST(floor(x) AS BIGINT) AS i2, CAST(floor(y) AS BIGINT) AS j2,
           (x - round_even(x, 0)) * (x - round_even(x, 0))
             + 3.0 * (y - round_even(y, 0)) * (y - round_even(y, 0)) AS d1,
           (x - floor(x) - 0.5) * (x - floor(x) - 0.5)
             + 3.0 * (y - floor(y) - 0.5) * (y - floor(y) - 0.5) AS d2
    FROM scaled),
cells AS (
    SELECT CASE WHEN d1 < d2 THEN 1 ELSE 2 END AS lattice,
           CASE WHEN d1 < d2 THEN i1 ELSE i2 END AS i,
           CASE WHEN d1 < d2 THEN j1 ELSE j2 END AS j, count(*) AS n
    FROM candidates GROUP BY ALL)
SELECT lattice, i, j, round(x0 + (i + CASE WHEN lattice = 2 THEN 0.5 ELSE 0 END) * sx, 9) AS lon,
       round(y0 + (j + CASE WHEN lattice = 2 THEN 0.5 ELSE 0 END) * sy, 9) AS lat, n
FROM cells CROSS JOIN span"""),
    "point_density": _with(" SELECT lon, lat, count(*) AS n FROM feats GROUP BY lon, lat"),
    "observations_per_species": _with("""
SELECT taxon_id, count(*) AS n FROM obs GROUP BY taxon_id"""),
    "observation_stats": _with("""
SELECT (SELECT count(*) FROM taxa) AS n_species, CAST(sum(n) AS BIGINT) AS n_observations,
       round(avg(n), 9) AS mean_per_species, min(n) AS min_per_species, max(n) AS max_per_species
FROM (SELECT count(*) AS n FROM obs GROUP BY taxon_id)"""),
    "dataset_counts": _with("""
SELECT count(*) AS n_observations, count(DISTINCT region) AS n_regions,
       count(DISTINCT taxon_id) AS n_species FROM feats"""),
    "species_presence": _with("""
SELECT row_id AS loc_id, taxon_id, lat, lon FROM obs"""),
    "species_presence_by_position": _with("""
SELECT row_id AS loc_id, taxon_id, lat, lon FROM obs"""),
    "species_absence_counts": _with("""
SELECT taxon_id, count(*) AS n_present, (SELECT count(*) FROM obs) - count(*) AS n_absent
FROM obs GROUP BY taxon_id"""),
    "random_species": _with(" SELECT taxon_id FROM chosen"),
    "random_species_locations": _with("""
SELECT row_id AS loc_id, lat, lon,
       CASE WHEN taxon_id = (SELECT taxon_id FROM chosen) THEN 'present' ELSE 'absent' END AS kind
FROM obs"""),
    "one_species_observations": _with("""
SELECT row_id, lat, lon, taxon_id FROM obs WHERE taxon_id = (SELECT taxon_id FROM chosen)"""),
    "loc2spec_dataset": _dataset("folds_labelled"),
    "spec2loc_dataset": _dataset("folds_all"),
    "multilabel_matrix_long": _with(" SELECT region, taxon_id, label_rank, y FROM matrix"),
    "category_dataset": _with(""",
cells AS (SELECT *, CAST(floor(lat) AS BIGINT) AS la, CAST(floor(lon) AS BIGINT) AS lo FROM obs),
firsts AS (SELECT la, lo, arg_min(event_type, row_id) AS event_type FROM cells GROUP BY la, lo)
SELECT la || '°' || lo || '°' AS region, event_type, CAST(la < 0 AS INTEGER) AS "hemisphere_S",
       CAST(event_type = 'error' AS INTEGER) AS event_type_error,
       CAST(event_type = 'purchase' AS INTEGER) AS event_type_purchase,
       CAST(event_type = 'signup' AS INTEGER) AS event_type_signup,
       CAST(event_type = 'view' AS INTEGER) AS event_type_view
FROM firsts"""),
    "hot_species_names": _with(""",
hot AS (SELECT row_id, CASE WHEN row_id % 10 = 0 THEN taxon_id ELSE 1001 END AS taxon_id FROM obs)
SELECT row_id, taxon_id, taxon_name FROM hot LEFT JOIN taxa USING (taxon_id)"""),
    "group_folds": _with("""
SELECT 'all' AS population, region, group_key, fold FROM folds_all
UNION ALL SELECT 'labelled', region, group_key, fold FROM folds_labelled"""),
    "f1_micro_macro": _with("""
SELECT fold, round(micro_f1, 9) AS micro_f1, round(macro_f1, 9) AS macro_f1 FROM f1_fold"""),
    "f1_per_species": _with("""
SELECT fold, taxon_id, tp, fp, fn, round(f1, 9) AS f1 FROM f1_label"""),
    "ranking_micro_macro": _with("""
SELECT fold, round(roc_auc_micro, 9) AS roc_auc_micro, round(pr_auc_micro, 9) AS pr_auc_micro,
       round(roc_auc_macro, 9) AS roc_auc_macro, round(pr_auc_macro, 9) AS pr_auc_macro FROM six"""),
    "roc_auc": _with(" SELECT fold, taxon_id, round(roc_auc, 9) AS roc_auc FROM rank_label"),
    "average_precision": _with(" SELECT fold, taxon_id, round(pr_auc, 9) AS pr_auc FROM rank_label"),
    "ranking_of_close_scores": _with("""
SELECT fold, taxon_id, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM rank_label"""),
    "fold_metric_table": _with("""
SELECT CAST(fold AS VARCHAR) AS fold, round(micro_f1, 9) AS micro_f1, round(macro_f1, 9) AS macro_f1
FROM f1_fold
UNION ALL SELECT 'mean', round(avg(micro_f1), 9), round(avg(macro_f1), 9) FROM f1_fold"""),
    "species_metric_table": _with("""
SELECT CAST(r.taxon_id AS VARCHAR) AS taxon_id, round(avg(r.roc_auc), 9) AS roc_auc,
       round(avg(r.pr_auc), 9) AS pr_auc,
       round(avg(CASE WHEN f.n_pos > 0 AND f.n_neg > 0 THEN f.f1 END), 9) AS f1
FROM rank_label r JOIN f1_label f USING (fold, taxon_id) GROUP BY r.taxon_id
UNION ALL SELECT 'micro', round(avg(roc_auc_micro), 9), round(avg(pr_auc_micro), 9),
                 round(avg(f1_micro), 9) FROM six
UNION ALL SELECT 'macro', round(avg(roc_auc_macro), 9), round(avg(pr_auc_macro), 9),
                 round(avg(f1_macro), 9) FROM six"""),
    "cv_log_folds": _with("""
SELECT 50 AS topk, 5 AS cv_splits, 'lr' AS model, 42 AS seed, fold,
       round(roc_auc_micro, 9) AS roc_auc_micro, round(pr_auc_micro, 9) AS pr_auc_micro,
       round(f1_micro, 9) AS f1_micro, round(roc_auc_macro, 9) AS roc_auc_macro,
       round(pr_auc_macro, 9) AS pr_auc_macro, round(f1_macro, 9) AS f1_macro FROM six"""),
    "out_of_fold_labels": _with("""
SELECT f.fold, m.region, m.taxon_id, m.y FROM matrix m JOIN folds_all f USING (region)"""),
    "forest_out_of_fold": _with(""",
every AS (
    SELECT r.region, t.taxon_id, f.fold,
           CAST(EXISTS (SELECT 1 FROM rt WHERE rt.region = r.region
                        AND rt.taxon_id = t.taxon_id) AS INTEGER) AS y
    FROM regs r CROSS JOIN ranked t JOIN folds_all f USING (region)),
one_class AS (
    SELECT h.fold, e.taxon_id, CAST(min(e.y) AS DOUBLE) AS constant
    FROM every e JOIN (SELECT DISTINCT fold FROM folds_all) h ON h.fold <> e.fold
    GROUP BY ALL HAVING min(e.y) = max(e.y))
SELECT e.fold, e.region, e.taxon_id, e.y, o.constant
FROM every e LEFT JOIN one_class o USING (fold, taxon_id)"""),
    "species_metrics_with_gaps": _with_gaps(_GAP_METRICS + """
SELECT fold, taxon_id, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc, round(f1, 9) AS f1
FROM gaps"""),
    "species_means_with_gaps": _with_gaps(_GAP_METRICS + """
SELECT taxon_id, round(avg(roc_auc), 9) AS roc_auc, round(avg(pr_auc), 9) AS pr_auc,
       round(avg(f1), 9) AS f1
FROM gaps GROUP BY taxon_id"""),
    "saved_model_differences": _with("""
SELECT model, (SELECT count(*) FROM matrix) AS n, CAST(0 AS BIGINT) AS n_different
FROM (SELECT unnest(['lr', 'rf']) AS model)"""),
    "incremental_features": _with("""
SELECT lat, lon, taxon_id, taxon_name, grid_lat, grid_lon, region, hemisphere,
       round(sin_lon, 9) AS sin_lon, round(cos_lon, 9) AS cos_lon
FROM feats"""),
    "incremental_support": _with("""
SELECT taxon_id, n_regions, first_region FROM supp"""),
    "one_species_features": _with("""
SELECT lat, lon, taxon_id, taxon_name, grid_lat, grid_lon, region, hemisphere,
       round(sin_lon, 9) AS sin_lon, round(cos_lon, 9) AS cos_lon
FROM feats WHERE taxon_id = (SELECT taxon_id FROM chosen)"""),
    "one_tile_features": _with("""
SELECT lat, lon, taxon_id, taxon_name, grid_lat, grid_lon, region, hemisphere,
       round(sin_lon, 9) AS sin_lon, round(cos_lon, 9) AS cos_lon
FROM feats WHERE grid_lat BETWEEN 0 AND 7 AND grid_lon BETWEEN 0 AND 7"""),
    "density_pyramid": _with(_PYRAMID + """
SELECT level, x, y, quadkey, n, parent_n, shown FROM pyramid"""),
    "density_cells": _with(_PYRAMID + """
SELECT quadkey, level, n, x * (360.0 / pow(2.0, level)) - 180.0 AS west,
       y * (180.0 / pow(2.0, level)) - 90.0 AS south,
       360.0 / pow(2.0, level) AS width, 180.0 / pow(2.0, level) AS height
FROM pyramid WHERE shown"""),
    "group_folds_5deg": _recursive(""",
blocks AS (
    SELECT 'all' AS population, region,
           CAST(floor(grid_lat / 5) * 1000 + floor(grid_lon / 5) AS BIGINT) AS group_key
    FROM regs
    UNION ALL
    SELECT 'labelled', region, CAST(floor(grid_lat / 5) * 1000 + floor(grid_lon / 5) AS BIGINT)
    FROM regs WHERE region IN (SELECT region FROM matrix WHERE y = 1)),
sizes AS (
    SELECT *, row_number() OVER (PARTITION BY population ORDER BY n DESC, group_key DESC) AS i
    FROM (SELECT population, group_key, count(*) AS n FROM blocks GROUP BY ALL)),
dealt(population, i, group_key, loads, fold) AS (
    SELECT population, CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
           CAST([0, 0, 0, 0, 0] AS BIGINT[]), CAST(0 AS INTEGER)
    FROM (SELECT DISTINCT population FROM sizes)
    UNION ALL
    SELECT d.population, s.i, s.group_key,
           list_transform(range(1, 6), lambda k: d.loads[k]
               + CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN s.n ELSE 0 END),
           CAST(list_position(d.loads, list_min(d.loads)) AS INTEGER)
    FROM dealt d JOIN sizes s ON s.population = d.population AND s.i = d.i + 1)
SELECT b.population, b.region, b.group_key, d.fold
FROM blocks b JOIN dealt d USING (population, group_key)"""),
    "logistic_optimality": _with("""
SELECT h.fold AS held_out, m.label_rank, count(*) AS n, CAST(sum(m.y) AS BIGINT) AS n_pos,
       CASE WHEN sum(m.y) BETWEEN 1 AND count(*) - 1 THEN true END AS flat
FROM matrix m JOIN folds_all f USING (region)
JOIN (SELECT DISTINCT fold FROM folds_all) h ON h.fold <> f.fold
GROUP BY h.fold, m.label_rank"""),
}
