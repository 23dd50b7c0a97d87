from occugrid.llm import mixture

WORDS, N_SLOTS = 2_000_000, 1000


def test_words_just_before_a_seam_stay_in_their_slot(spark):
    """Quotients just below a whole number, as sources of millions of words give."""
    firsts = [0, 1999, 2000, 1_003_999, 1_004_000, WORDS - 1]
    sizes = [1999, 1, 1_001_999, 1, 995_999, 1]
    documents = spark.createDataFrame(
        [(i, "a", s, i, f, 0) for i, (f, s) in enumerate(zip(firsts, sizes, strict=True))],
        "id long, source string, size long, hash long, first long, chunk int",
    )
    sources = spark.createDataFrame(
        [("a", WORDS, float(WORDS), WORDS, N_SLOTS)],
        "source string, source_size long, target double, words long, n_slots long",
    )
    slots = spark.createDataFrame(
        [(i, "a", i) for i in range(N_SLOTS)], "slot long, source string, rank long"
    )
    pieces = mixture._pieces(documents, sources, slots).collect()
    got = {}
    for p in pieces:
        got[p["id"]] = got.get(p["id"], 0) + p["length"]
    assert got == dict(enumerate(sizes))
    one = {p["id"]: (p["slot"], p["start"], p["length"]) for p in pieces if p["size"] == 1}
    assert one == {1: (0, 0, 1), 3: (501, 0, 1), 5: (999, 0, 1)}
