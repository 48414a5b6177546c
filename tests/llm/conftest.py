import hashlib
import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    r = random.Random(11)
    return ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(300)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0):
        rows = [(None if t == "NOID" else first + k, None if t in (None, "NOID") else t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture(scope="session")
def corpus(words):
    """Texts with copies, near copies, shared passages, odd characters, empty and null ones."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = prose(120)
    out = [prose(r.randint(1, 200)) for _ in range(60)]
    out += [out[0]] * 4 + [prose(20) + " " + passage + " " + prose(20) for _ in range(6)]
    long = prose(300)
    out += [long, *(long.replace(" ", "  ", k).replace(words[k], "changed") for k in range(1, 6))]
    out += ["", None, " ", "a", "a b", "Ünï 🙂\nx\ty", "du " * 400, "x" * 3000, passage + passage]
    return out


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
