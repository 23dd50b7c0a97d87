"""Quality rules as weak supervision: rules vote or abstain, EM learns how far to trust each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occugrid.llm.shared import BLANK, index_mask, let, text_of, word_grams, words_of

GRAM = 5
ROUNDS = 30
#: Pseudo-counts of a rule's accuracy; they keep every accuracy inside (0, 1).
SMOOTHING = 2.0

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = (
    "the of and to in is that a "
    "der die das und ist ein eine zu von "
    "le la les de des et un une est que "
    "el los las en y del por con"
).split()

MODEL = "struct<prior:double,good:array<double>,bad:array<double>>"


@dataclass(frozen=True)
class Rule:
    """Votes 1 where ``good`` holds, -1 where ``bad`` holds, and abstains (0) elsewhere."""

    name: str
    bad: Callable[[dict[str, Column]], Column]
    good: Callable[[dict[str, Column]], Column]

    def vote(self, f: dict[str, Column]) -> Column:
        return (
            F.when(F.coalesce(self.bad(f), F.lit(False)), -1)
            .when(F.coalesce(self.good(f), F.lit(False)), 1)
            .otherwise(0)
        )


RULES = (
    Rule(
        "symbols",
        lambda f: f["n_symbols"] * 10 > f["n_words"],
        lambda f: (f["n_symbols"] * 100 <= f["n_words"]) & (f["n_words"] >= 20),
    ),
    Rule(
        "repeated_lines",
        lambda f: f["n_dup_lines"] * 10 > f["n_lines"] * 3,
        lambda f: (f["n_dup_lines"] == 0) & (f["n_lines"] >= 3),
    ),
    Rule(
        "repeated_words",
        lambda f: f["n_repeat_words"] * 5 > f["n_words"],
        lambda f: (f["n_repeat_words"] * 50 <= f["n_words"]) & (f["n_words"] >= 20),
    ),
    Rule(
        "word_length",
        lambda f: ~(f["word_chars"] * 2).between(f["n_words"] * 5, f["n_words"] * 28),
        lambda f: (f["word_chars"] * 2).between(f["n_words"] * 7, f["n_words"] * 20)
        & (f["n_words"] > 0),
    ),
    Rule(
        "length",
        lambda f: f["n_words"] < 10,
        lambda f: f["n_words"] >= 40,
    ),
    Rule(
        "function_words",
        lambda f: (f["n_function"] == 0) & (f["n_words"] >= 20),
        lambda f: f["n_function"] * 20 >= f["n_words"],
    ),
    Rule(
        "sentence_ends",
        lambda f: (f["n_ends"] == 0) & (f["n_words"] >= 30),
        lambda f: f["n_ends"] * 40 >= f["n_words"],
    ),
    Rule(
        "letters",
        lambda f: f["n_letters"] * 10 < f["word_chars"] * 7,
        lambda f: f["n_letters"] * 10 >= f["word_chars"] * 9,
    ),
)
NO_VOTE = sum(3**k for k in range(len(RULES)))


def _size(values: Column) -> Column:
    return F.size(values).cast("long")


def _removed(text: Column, pattern: str) -> Column:
    """Code points of ``text`` that ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(grams: Column, mask: Column) -> Column:
    """Words inside grams found twice or more; most texts have none, which is cheap to see.

    Else a gram is its hash with its position in the low bits, so that sorting puts equal
    hashes side by side. The covered words are the union of the runs that start there.
    """
    placed = F.transform(
        grams,
        lambda gram, i: gram.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")),
    )

    def starts(in_order: Column) -> Column:
        def twice(gram: Column, i: Column) -> Column:
            def same(other: Column) -> Column:
                return F.coalesce(gram.bitwiseXOR(other).between(F.lit(0), mask), F.lit(False))

            return same(F.get(in_order, i - 1)) | same(F.get(in_order, i + 1))

        return F.sort_array(
            F.transform(F.filter(in_order, twice), lambda gram: gram.bitwiseAND(mask))
        )

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(
                at,
                lambda start, i: F.least(
                    F.lit(GRAM).cast("long"), F.coalesce(F.get(at, i + 1) - start, F.lit(GRAM))
                ),
            ),
            F.lit(0).cast("long"),
            lambda total, more: total + more,
        )

    none_twice = F.size(F.array_distinct(grams)) == F.size(grams)
    return F.when(none_twice, F.lit(0).cast("long")).otherwise(
        let(let(F.sort_array(placed), starts), covered)
    )


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, and the counts that rules look at."""
    text = F.col("__text")
    rows = docs.select(F.struct("*").alias("row"), text_of(text_col).alias("__text"))
    split = rows.select(
        "row",
        "__text",
        words_of(text).alias("__words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(
            "__lines"
        ),
    ).withColumn("n_words", _size(F.col("__words")))
    grams = split.withColumn("__mask", index_mask(F.col("n_words"))).withColumn(
        "__grams", word_grams(F.col("__words"), F.col("n_words").cast("int"), GRAM)
    )
    words, lines = F.col("__words"), F.col("__lines")
    counts = F.struct(
        F.col("n_words").alias("n_words"),
        F.length(F.regexp_replace(text, f"{BLANK}+", "")).cast("long").alias("word_chars"),
        _removed(text, r"[#*$%&|<>]").alias("n_symbols"),
        (_size(lines) - _size(F.array_distinct(lines))).alias("n_dup_lines"),
        _repeat_words(F.col("__grams"), F.col("__mask")).alias("n_repeat_words"),
        _size(lines).alias("n_lines"),
        _size(F.filter(words, lambda word: word.isin(*FUNCTION_WORDS))).alias("n_function"),
        _size(
            F.filter(words, lambda word: word.endswith(".") | word.endswith("!") | word.endswith("?"))
        ).alias("n_ends"),
        _removed(text, r"\p{L}+").alias("n_letters"),
    )
    # A generator keeps later filters on the counts above their computation; pushed below it,
    # a filter would split the text again for every word.
    return grams.select("row", F.inline(F.array(counts)))


FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_function", "n_ends", "n_letters",
)


def with_votes(features: DataFrame) -> DataFrame:
    """``pattern``: the votes of all rules as one number in base 3 (digit = vote + 1)."""
    columns = {name: F.col(name) for name in FEATURES}
    code = F.lit(0)
    for place, rule in enumerate(RULES):
        code = code + (rule.vote(columns) + 1) * 3**place
    return features.withColumn("pattern", code)


def _log_odds(votes: Column, model: Column) -> Column:
    """Log odds of a good text; an abstention says nothing."""
    odds = F.log(model["prior"] / (1 - model["prior"]))
    for r in range(len(RULES)):
        good, bad = model["good"][r], model["bad"][r]
        odds = odds + F.when(votes[r] == 1, F.log(good / bad)).when(
            votes[r] == -1, F.log((1 - good) / (1 - bad))
        ).otherwise(0.0)
    return odds


def _maximise(weighted: Column) -> Column:
    """Prior and accuracies from patterns with their weights: ``(votes, n, p)``."""

    def total(value: Callable[[Column], Column]) -> Column:
        return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + value(x))

    def rate(r: int, weight: Callable[[Column], Column]) -> Column:
        for_it = total(lambda x: F.when(x["votes"][r] == 1, weight(x)).otherwise(0.0))
        voted = total(lambda x: F.when(x["votes"][r] != 0, weight(x)).otherwise(0.0))
        return (for_it + SMOOTHING) / (voted + 2 * SMOOTHING)

    good = lambda x: x["n"] * x["p"]
    bad = lambda x: x["n"] * (1 - x["p"])
    return F.struct(
        (
            (total(good) + SMOOTHING)
            / (total(lambda x: x["n"].cast("double")) + 2 * SMOOTHING)
        ).alias("prior"),
        F.array(*[rate(r, good) for r in range(len(RULES))]).alias("good"),
        F.array(*[rate(r, bad) for r in range(len(RULES))]).alias("bad"),
    )


def posteriors(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, posterior)``: probability of a good text for every pattern of votes.

    Expectation-maximisation over the counted patterns, of which there are at most 3 to the
    number of rules (6,561) however many rows voted. It starts from the share of good votes.
    The prior and, for each rule and class, the chance that a vote is "good" are estimated;
    the prior is the share of good texts. An empty table has no patterns.
    """
    n = len(RULES)
    counted = votes.groupBy("pattern").agg(F.count("*").alias("n"))
    gathered = counted.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("counts"))
    patterns = F.transform(
        F.col("counts"),
        lambda x: F.struct(
            x["pattern"].alias("pattern"),
            x["n"].alias("n"),
            F.array(
                *[(F.floor(x["pattern"] / 3**r) % 3 - 1).cast("int") for r in range(n)]
            ).alias("votes"),
        ),
    )

    def first_guess(x: Column) -> Column:
        for_it = sum((F.when(x["votes"][r] == 1, 1.0).otherwise(0.0) for r in range(n)), F.lit(0.0))
        against = sum(
            (F.when(x["votes"][r] == -1, 1.0).otherwise(0.0) for r in range(n)), F.lit(0.0)
        )
        return (for_it + 1) / (for_it + 2 * against + 2)

    def weigh(p: Callable[[Column], Column]) -> Column:
        return F.transform(
            F.col("patterns"),
            lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), p(x).alias("p")),
        )

    model = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        let(weigh(first_guess), _maximise).cast(MODEL),
        lambda state, _: let(
            weigh(lambda x: 1 / (1 + F.exp(-_log_odds(x["votes"], state)))), _maximise
        ).cast(MODEL),
    )
    return (
        gathered.select(patterns.alias("patterns"))
        .select("patterns", model.alias("model"))
        .select("model", F.explode("patterns").alias("x"))
        .select(
            F.col("x.pattern").alias("pattern"),
            (1 / (1 + F.exp(-_log_odds(F.col("x.votes"), F.col("model"))))).alias("posterior"),
        )
    )


def judge(
    docs: DataFrame, text_col: str = "text", threshold: float = 0.5, rounds: int = ROUNDS
) -> DataFrame:
    """The rows of ``docs`` in a struct ``row``, with counts, ``base_failed``, ``posterior``, ``kept``.

    Every row gets a verdict: ``base_failed`` where the text has fewer than 10 words or over
    20 % of its words lie in repeated 5-word runs; ``kept`` where it did not fail and the
    posterior reaches ``threshold``. A null text counts as empty: it has no words and fails.
    Repeated rows vote each. Keeping the input in a struct avoids clashes of names. Repeated
    runs are compared by 64-bit hashes (low bits hold the position).

    The counts are computed twice, for the vote patterns and for the result: both passes only
    read the input, so that nothing but the patterns is shuffled and no text is ever moved.
    """
    voted = with_votes(with_features(docs, text_col))
    # Proven bound: at most 3 ** len(RULES) rows.
    learned = F.broadcast(posteriors(voted.select("pattern"), rounds))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return voted.join(learned, "pattern").select(
        "row",
        *FEATURES,
        failed.alias("base_failed"),
        F.col("posterior"),
        (~failed & (F.col("posterior") >= threshold)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, unchanged."""
    return judge(docs, text_col, threshold).where("kept").select("row.*")
