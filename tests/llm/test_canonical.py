import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pressmill.llm import canonical

LIST = "category_id int, category_name string, known_as array<string>"
ENTRIES = [(1, "Foreign Affairs", ["diplomacy"]), (2, "Arts & Culture", ["sining at kultura"]), (3, "Sports", ["palakasan"]), (4, "Food", None), (5, "Religion", ["faith"]), (6, None, ["x"])]


def osa(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8), st.text("abc", max_size=7), st.integers(0, 3))
def test_automaton_equals_brute_force(names, value, k):
    trie = canonical.Trie([(n, i) for i, n in enumerate(names)])
    got = {(entry, d) for d, entry, _ in trie.within(value, k)}
    assert got == {(i, osa(n, value)) for i, n in enumerate(names) if osa(n, value) <= k}


def test_article_sections(spark):
    ref = spark.createDataFrame(ENTRIES, LIST)
    cases = [
        ("Home » foreignn affaers »", 1), ("ＤＩＰＬＯＭＡＣＹ", 1), ("S P O R T S", 3), ("Latest Spotrs", 3), ("arts_+_culture", 2), ("Arts and Culture", 2), ("News / Faith", 5), ("Fod", 4), ("Region", 0), ("Horoscope", 0),
        ("-", 0), ("sports" * 4000, 0), ("Réligíon News", 5), ("cat=food", 4), ("Arts_&amp;_Cultrue", 2), ("arts&amp;amp;culture |", 2),
    ]
    rows = [(i, v, "Sports", "clash", 0) for i, (v, _) in enumerate(cases)] + [(100, None, "palakasan", None, 1), (101, " ​", None, None, 2), (102, "Sports", None, None, 3), (102, "Sports", None, None, 3), (103, "", "  ", None, 4)]
    a = spark.createDataFrame(rows, "id long, raw_category string, category string, typed string, category_id int")
    got = {r.article_id: (r.typed, r.category_id) for r in canonical.article_sections(a, ref).collect()}
    assert [got[i][1] for i in range(len(cases))] == [c for _, c in cases]
    assert got[100] == ("palakasan", 3) and got[101] == (None, 0) and got[103] == (None, 0)
    found = [tuple(r) for r in canonical.found(a, ref).collect()]
    assert len(found) == len(cases) + 1 and 102 not in {i for i, _ in found}
    assert canonical.found(a.limit(0), ref).count() == 0
    assert {r.category_id for r in canonical.article_sections(a, ref.limit(0)).collect()} == {0}


def test_long_lists_are_searched_in_shards(spark, monkeypatch):
    random.seed(3)
    names = [("".join(random.choices("abcdefgh", k=8)), i) for i in range(1, 60)]
    ref = spark.createDataFrame([(i, n, None) for n, i in names], LIST)
    a = spark.createDataFrame([(i, n[:-1], None) for n, i in names], "id long, raw_category string, category string")
    whole = sorted(map(tuple, canonical.found(a, ref).collect()))
    monkeypatch.setattr(canonical, "SHARD", 20)
    assert sorted((r.article_id, r.category_id) for r in canonical.article_sections(a, ref).collect()) == whole


def test_candidates_equal_brute_force(spark, monkeypatch):
    random.seed(8)
    names = sorted({"".join(random.choices("abc", k=random.randint(3, 6))) for _ in range(60)})
    ref = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], LIST)
    typed = ["".join(random.choices("abc", k=random.randint(2, 6))) for _ in range(30)] + [None, "", "abc", "abc"]
    values = spark.createDataFrame([(t,) for t in typed], "typed string")
    k = lambda a, b: canonical.allowed(min(len(a), len(b)))
    want = sorted((t, i, osa(t, n)) for t in set(typed) if t for i, n in enumerate(names) if osa(t, n) <= k(t, n))
    get = lambda: sorted(map(tuple, canonical.candidates(values, "typed", ref, "category_id", "category_name", "known_as").collect()))
    assert get() == want and len(want) > 30
    monkeypatch.setattr(canonical, "SHARD", 20)
    assert get() == want


def test_held_out_typos(spark, data):
    """Typed values made from the real list by one slip come back to their entry."""
    ref = spark.read.parquet(f"{data}/category_list.parquet")
    random.seed(5)
    rows, truth = [], {}
    for r in ref.collect():
        for name in [r.category_name, *r.known_as]:
            if len(name) < 6:
                continue
            k = random.randrange(1, len(name) - 1)
            slips = [name[:k] + name[k + 1 :], name[:k] + name[k] + name[k:], name[: k - 1] + name[k] + name[k - 1] + name[k + 1 :]]
            for s in slips:
                truth[len(rows)] = r.category_id
                rows.append((len(rows), s.upper(), None))
    got = {r.article_id: r.category_id for r in canonical.article_sections(spark.createDataFrame(rows, "id long, raw_category string, category string"), ref).collect()}
    assert sum(got[i] == c for i, c in truth.items()) / len(truth) > 0.98
