import random
import re
from collections import Counter, defaultdict

from pressmill.llm import repeated_lines

SCHEMA = "id long, source string, content string, line string, support int"


def brute(rows, least=6, share=0.02):
    fold = lambda s: re.sub(r"[\W\d_]+", "", (s or "").lower())
    docs, n = Counter(fold(s) for _, s, *_ in rows), defaultdict(set)
    for i, s, c, *_ in rows:
        for x in (c or "").split("\n"):
            if fold(x):
                n[fold(s), fold(x)].add(i)
    keep = {k for k, v in n.items() if len(v) >= least and len(v) >= share * docs[k[0]]}
    return sorted((i, j) for i, s, c, *_ in rows for j, x in enumerate((c or "").split("\n"), 1) if c is not None and (fold(s), fold(x)) in keep)


def corpus():
    random.seed(1)
    rows = []
    for i in range(400):
        s = random.choice(["Alpha", "alpha ", "ALPHA", "Beta", None])
        lines = [f"Story {'abcdefghij'[i % 10]} {random.choice('klmno')} of the day", random.choice(["Share this!", "SHARE THIS", "", "12 34"]), "Be first"] + random.sample(["Ñandú — uno", "tail", f"x{'y' * (i % 90)}"], 2)
        rows.append((i, s, "\n".join(lines) if i % 50 else None, "clash", 1))
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, repeated_lines.found(df).collect())) == brute(rows)
    assert sorted(map(tuple, repeated_lines.found(df, min_docs=3, min_share=0.3).collect())) == brute(rows, 3, 0.3)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, repeated_lines.found(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_clean_and_blocks(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    gone = set(brute(rows))
    want = {i: None if c is None else "\n".join(x for j, x in enumerate(c.split("\n"), 1) if (i, j) not in gone) for i, _, c, *_ in rows}
    assert {r.doc_id: r.content for r in repeated_lines.without_blocks(df).collect()} == want
    r = repeated_lines.report(df)
    assert r.where("lines > 1").count() > 0 and r.count() > 0


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated_lines.found(empty).count() == 0 and repeated_lines.without_blocks(empty).count() == 0
    same = [(i, "a", "one\ntwo\none", None, None) for i in range(6)]  # a line twice in a document counts once, and both occurrences come out
    assert sorted(map(tuple, repeated_lines.found(spark.createDataFrame(same, SCHEMA)).collect())) == [(i, j) for i in range(6) for j in (1, 2, 3)]
    assert repeated_lines.found(spark.createDataFrame(same[:5], SCHEMA)).count() == 0
    long = spark.createDataFrame([(i, "a", "word " * 200_000, None, None) for i in range(6)], SCHEMA)
    assert repeated_lines.found(long).count() == 6
