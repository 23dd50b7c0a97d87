"""Column layouts of the tables the jobs read and write (DDL strings)."""

OBSERVATIONS = "row_id BIGINT, lat DOUBLE, lon DOUBLE, taxon_id BIGINT"
OBSERVATION_ARRAYS = "row_id BIGINT, locs ARRAY<DOUBLE>, taxon_id BIGINT"
TAXA = "taxon_id BIGINT, taxon_name STRING"
TEST_LOCATIONS = "loc_id BIGINT, lat DOUBLE, lon DOUBLE"
TEST_PRESENCE = "taxon_id BIGINT, loc_ids ARRAY<BIGINT>"

_CELL = (
    "grid_lat BIGINT, grid_lon BIGINT, region STRING, hemisphere STRING, "
    "sin_lon DOUBLE, cos_lon DOUBLE"
)
TRAIN_FEATURES = f"row_id BIGINT, lat DOUBLE, lon DOUBLE, taxon_id BIGINT, taxon_name STRING, {_CELL}"
TEST_FEATURES = f"loc_id BIGINT, lat DOUBLE, lon DOUBLE, {_CELL}"

PAIRS = (
    "species_a BIGINT, species_b BIGINT, species_a_name STRING, species_b_name STRING, "
    "n_a BIGINT, n_b BIGINT, n_ab BIGINT, support_a DOUBLE, support_b DOUBLE, "
    "support_ab DOUBLE, jaccard DOUBLE, p_a_given_b DOUBLE, lift DOUBLE"
)
SCORES = "fold INT, region STRING, taxon_id BIGINT, label_rank INT, y INT, p DOUBLE, yhat INT"
