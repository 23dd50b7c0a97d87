import pytest

from occugrid import schemas
from occugrid.operators import presence


@pytest.fixture
def survey(spark):
    locations = spark.createDataFrame(
        [(i, float(i), 10.0 + i) for i in range(5)], schemas.TEST_LOCATIONS
    )
    lists = spark.createDataFrame([(1, [0, 2]), (1, [2, 4]), (2, [3]), (3, [])], schemas.TEST_PRESENCE)
    return lists, locations


def test_presence_and_absence_partition_the_locations(spark, survey):
    lists, locations = survey
    rows = presence.species_presence(lists, locations).collect()
    assert {(r.taxon_id, r.loc_id, r.lat) for r in rows} == {(1, 0, 0.0), (1, 2, 2.0), (1, 4, 4.0), (2, 3, 3.0)}
    counts = {r.taxon_id: (r.n_present, r.n_absent) for r in presence.absence_counts(lists, locations).collect()}
    assert counts == {1: (3, 2), 2: (1, 4), 3: (0, 5)}
    one = spark.createDataFrame([(1,)], "taxon_id BIGINT")
    nowhere = spark.createDataFrame([(3,)], "taxon_id BIGINT")
    assert {r.kind for r in presence.locations_of(lists, locations, nowhere).collect()} == {"absent"}
    kinds = {r.loc_id: r.kind for r in presence.locations_of(lists, locations, one).collect()}
    assert kinds == {0: "present", 1: "absent", 2: "present", 3: "absent", 4: "present"}


def test_random_species_depends_on_the_seed_only(spark):
    taxa = spark.range(200).withColumnRenamed("id", "taxon_id")
    draws = {presence.random_species(taxa.repartition(n), 7).first()[0] for n in (1, 3, 8)}
    assert len(draws) == 1
    assert len({presence.random_species(taxa, seed).first()[0] for seed in range(6)}) > 1


def test_observations_of_one_species(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 5), (1, 1.0, 1.0, 6)], schemas.OBSERVATIONS)
    one = spark.createDataFrame([(6,)], "taxon_id BIGINT")
    assert [r.row_id for r in presence.observations_of(rows, one).collect()] == [1]
