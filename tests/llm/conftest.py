import pytest

pytest.importorskip("cubelark.llm")
P = pytest.importorskip("public_tokenizers")

SMALL, MEDIUM, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and blank texts, copies, repeated rows, a long text, and columns whose names could clash."""
    rows = [(1, "a b  c"), (2, "a b c"), (3, None), (4, ""), (5, "x\ny"), (6, "x y"), (6, "x y"), (7, "word " * 30_000), (8, "Ünï côde 你好 😀"), (9, " \t\n"), (None, "a b c"), (None, "alone")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "h", 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, key int, _h string, row double")


@pytest.fixture(scope="session")
def named(docs):
    """The same rows without null ids, for operators that need one."""
    return docs.where("doc_id is not null")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def least_reachable(nodes, pairs):
    """Of each node the smallest one that it is linked to over any number of pairs: brute force."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
