import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "se") for b in ("n", "r", "st", "l") for c in ("a", "e", "os", "in", "ur")]


def prose(seed, n):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        w = rnd.choice(WORDS)
        out.append(w.capitalize() if k % 9 == 0 else w)
        if k % 9 == 8:
            out[-1] += rnd.choice([".", ".", ".\n"])
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def documents(spark):
    """Every case that operators must bear: nulls, empty and long texts, copies, repeated rows, columns that clash."""
    passage = prose(77, 60)
    texts = [prose(k, 40 + 7 * k) for k in range(12)]
    texts += [texts[0], texts[3] + " tail", "", None, " \n\t ", "one", "two words", prose(5, 30) + "\n" + passage + "\n" + prose(6, 30), prose(8, 20) + " " + passage + " " + prose(9, 25)]
    texts += [prose(50, 5000), "é" * 500, "a" * 3000, "🙂 ünï " * 40, "x@y.co or +1 (555) 555-1234, host 10.0.0.1, card 4111 1111 1111 1111"]
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[2], (None, prose(60, 50), "en", "src1", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "kept", 7, 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, n long, hash double")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 != 0), int(k % 4 == 0)) for k in range(20)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
