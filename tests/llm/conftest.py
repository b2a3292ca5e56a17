import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, long and degenerate ones."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(40)]
    passage = prose(rng, 90)
    texts = list(base)
    texts += [base[0]] * 6 + [base[1], base[2]]
    for i in (3, 3, 3, 4, 5):
        w = base[i].split()
        for _ in range(max(1, len(w) // 120)):
            w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(5)]
    texts += ["an. " * 300, "an. " * 300, "x" * 1500, "é" * 700 + "z", "", None, "one", "One", "two words", " \n\t ", prose(rng, 4000)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def full_docs(spark, corpus):
    """All columns of documents and some whose names an operator uses itself."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 2}", None if t is None else len(t), "q", 1, [1]) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, h1 int, words array<int>")
