import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """Rows ``(doc_id, text)`` of the small table plus awkward ones: null and
    empty texts, null and repeated ids, copies, near copies, shared passages,
    separators only, a long text, a periodic text."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(7)
    base = rows[3][1]
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(120))
    near = [rng.choice(words) for _ in range(150)]
    extra = [None, "", " \t\n", "one", "one two three", "ONE two  three", base, base, passage, "x " + passage + " y", passage + " " + passage,
             "ab" * 600, "é" * 700, "naïve café " * 60, " ".join(rng.choice(words) for _ in range(30000)), base + " tail", passage]
    for k in range(12):
        w = list(near)
        w[rng.randrange(len(w))] = f"edit{k}"
        extra.append(" ".join(w))
    rows += [(1000 + i, t) for i, t in enumerate(extra)]
    rows += [(None, base), (None, "only here with no id"), (3, base), (1000, "")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in texts], "doc_id bigint, text string, id string, n bigint, fp bigint, key string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
