import random

import pytest

#: Columns whose names the operators use themselves.
CLASHING = "size long, taken long, target double, place long, shard int, slot long, cell int, held_out boolean, score double, fp long, component_id long, media binary, ids array<int>, host string, rule string, own_digest_a long, found_language string, quality_score double, mix_size long, mix_key long, label int, l_id long, p_id long, d_id long, id long, nth int, rep long, spot long, digest_a long, digest long, k_id long, found string, words string, s_id long, bits array<long>, token long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
WIDE = len(CLASHING.split(","))


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long one, ties, copies, repeated rows, odd characters."""
    rng = random.Random(3)
    base = words(rng, 60)
    rows = [(1, base, "en", "b", 5), (2, base, "en", "b", 5), (3, None, None, None, None), (4, "", "de", "a", 0), (5, " \t\n ", "de", None, 4)]
    rows += [(6, words(rng, 30_000), "fr", "a", 1), (7, base.replace("a", "A"), "en", "b", 5), (8, "ß 漢字 🙂 é\x0b\x1cx", None, "", 3), (9, "one", "en", "ß", 3), (10, "12 34 !!", "en", "a", 3)]
    rows += [(1, base, "en", "b", 5), (None, "no id", "en", "b", 5), (None, None, None, None, None)]
    rows += [(k, words(rng, rng.randint(0, 40)), rng.choice(["en", "de"]), rng.choice("abc"), 1) for k in range(11, 60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, *[None] * WIDE) for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
