import numpy as np

from faultline.llm import jaccard, substrings
from faultline.llm.components import connected_components
from faultline.llm.jaccard import JaccardJoin
from faultline.llm.substrings import remove_repeats

from .fixtures import documents, empty, link_components, removed_words, shingles, words


def removal(spark, docs):
    rows = docs.collect()
    flags = removed_words([r["text"] for r in rows])
    want = sorted((repr(r["doc_id"]), len(g), sum(g), " ".join(w for w, x in zip(words(r["text"]), g, strict=True) if not x)) for r, g in zip(rows, flags, strict=True))
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(docs).collect())
    assert got == want


def test_repeats_match_brute_force(spark):
    removal(spark, documents(spark))


def test_repeats_under_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 1)
    removal(spark, documents(spark))


def test_the_bitmap_of_few_anchors_is_small(spark, monkeypatch):
    sizes, bitmap = [], substrings.bitmap
    monkeypatch.setattr(substrings, "bitmap", lambda *a: (sizes.append(len((made := bitmap(*a)).value)), made)[1])
    removal(spark, documents(spark))
    assert len(sizes) == 2 and max(sizes) <= 1 << 20


def test_repeats_of_an_empty_table_and_extra_columns(spark):
    assert remove_repeats(empty(spark)).count() == 0
    docs = documents(spark).withColumnRenamed("source", "_starts").withColumnRenamed("lang", "_doc")
    out = remove_repeats(docs)
    assert out.columns == [*docs.columns, "kept_text", "n_words", "n_removed"]
    assert out.count() == docs.count()
    clash = documents(spark).withColumnRenamed("source", "n_words").withColumnRenamed("lang", "kept_text")
    assert remove_repeats(clash).columns == ["doc_id", "text", "n_chars", "kept_text", "n_words", "n_removed"]


def membership(spark, docs):
    rows = docs.collect()
    least, sizes = link_components([r["doc_id"] for r in rows], [r["text"] for r in rows])
    want = sorted((repr(r["doc_id"]), n, repr(c)) for r, n, c in zip(rows, sizes, least, strict=True))
    got = JaccardJoin(docs).membership().collect()
    assert sorted((repr(r["id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == want


def test_groups_match_brute_force(spark):
    membership(spark, documents(spark))


def test_groups_whatever_counts_as_common(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_global_order", lambda described: jaccard.Order(np.arange(jaccard.WORD_COUNTERS) % 977, np.where(np.arange(jaccard.COUNTERS) % 3, 0, 10**6)))
    membership(spark, documents(spark))


def test_links_match_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    sets = [shingles(r["text"]) for r in rows]
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    want = sorted((repr(r["doc_id"]), sum(k != j and near(x, y) for j, y in enumerate(sets))) for k, (r, x) in enumerate(zip(rows, sets, strict=True)))
    assert sorted((repr(r["id"]), r["n_links"]) for r in JaccardJoin(docs).n_links().collect()) == want
    assert max(n for _, n in want) > 1


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    rows = docs.collect()
    least, sizes = link_components([r["doc_id"] for r in rows], [r["text"] for r in rows])
    kept = JaccardJoin(docs).one_of_each(docs)
    assert kept.columns == docs.columns
    want = len({c for c, n in zip(least, sizes, strict=True) if n}) + sum(n == 0 for n in sizes)
    assert kept.count() == want
    assert JaccardJoin(empty(spark)).membership().count() == 0


def test_components_of_paths_and_circles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (300, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}


def edited_copies(spark, groups=6, copies=12, length=120):
    """Groups of near copies of one text, and for each text words of its own."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(groups):
        base = [f"w{k}" for k in rng.integers(0, 300, length)]
        for _ in range(copies):
            text = list(base)
            for at in rng.choice(length, rng.integers(1, 5), replace=False):
                text[at] = f"own{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_groups_where_the_bitmap_lets_every_token_pass(spark, monkeypatch):
    full = spark.sparkContext.broadcast(b"\xff" * (1 << 17))
    monkeypatch.setattr(jaccard, "repeated_bitmap", lambda spread, n_hashes: full)
    membership(spark, edited_copies(spark))
