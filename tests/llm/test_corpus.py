import random
import re
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pressmill.llm import leaks, packing, spam

DOCS = "doc_id long, text string, lang string, share double, tokens int"


# packing


def least_bins(sizes, capacity):
    """The fewest containers, by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            rest = list(bins)
            rest.remove(room)
            go(i + 1, rest + [room - sizes[i]])
        go(i + 1, bins + [capacity - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(12, 14))
def test_pack_is_near_the_optimum(sizes, capacity):
    place, fixed = packing.pack(sizes, capacity)
    load = Counter()
    for s, b in zip(sizes, place):
        load[b] += s
    assert all(v <= capacity for v in load.values()) and set(place) == set(range(len(load)))
    assert least_bins(sizes, capacity) <= len(load) <= least_bins(sizes, capacity) + 1
    assert fixed <= len(load)


def test_reduction_fixes_what_dominates():
    assert packing.pack([10, 10, 10], 10) == ([2, 1, 0], 3)
    assert packing.pack([7, 3, 7, 3], 10)[1] == 2
    assert packing.pack([], 10) == ([], 0)
    # no pair fills the room beside 20 better than 8, three others do
    assert len(set(packing.pack([20, 11, 11, 8, 3, 3, 3], 30)[0])) == 2


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 14), max_size=9), st.integers(14, 20))
def test_reduction_loses_nothing(sizes, capacity):
    place, fixed, rest = packing.reduction(sizes, capacity)
    left = [s for s, items in rest.items() for _ in items]
    assert sorted(left) == sorted(s for s, b in zip(sizes, place) if b < 0) and {b for b in place if b >= 0} == set(range(fixed))
    assert fixed + least_bins(left, capacity) == least_bins(sizes, capacity)


def test_more_capacities_than_one_pass_takes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "word " * 9, None, None, None), (2, "one", None, None, None)], DOCS)
    caps = spark.createDataFrame([(f"c{k}", 3 + k) for k in range(7)], "pack_name string, capacity_tokens int")
    whole = sorted(map(tuple, packing.pieces(packing.token_counts(docs), caps).collect()))
    monkeypatch.setattr(packing, "CAPACITIES", 3)
    assert sorted(map(tuple, packing.pieces(packing.token_counts(docs), caps).collect())) == whole and len({r[0] for r in whole}) == 7
    assert sorted(map(tuple, packing.invariants(docs, caps).collect())) == [(f"c{k}", 2, True, 0, 0, 0) for k in range(7)]


def test_packs(spark):
    e = packing.encoding()
    texts = ["", None, "word " * 30, "short one", "word " * 3, "ñandú 東京 😀 " * 40]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    caps = spark.createDataFrame([("a", 16), ("b", 64), ("none", None), ("zero", 0)], "pack_name string, capacity_tokens int")
    got = packing.packs(docs, caps).collect()
    n = {i: len(e.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    for name, cap in (("a", 16), ("b", 64)):
        mine = [r for r in got if r.pack_name == name]
        tokens, load = Counter(), Counter()
        for r in mine:
            tokens[r.doc_id] += r.tokens
            if r.pack_id is not None:
                load[r.pack_id] += r.tokens
        assert dict(tokens) == n and all(v <= cap for v in load.values())
        assert all(len([r for r in mine if r.doc_id == i]) == max(1, -(-n[i] // cap)) for i in n)
        assert all((r.pack_id is None) == (r.tokens == 0) for r in mine)
    assert {r.pack_name for r in got} == {"a", "b"}
    assert packing.packs(docs.limit(0), caps).count() == 0
    small = packing.report(docs, caps, shard=2)
    assert all(r.packs >= r.least for r in small.collect())


def test_counts_are_those_of_the_tokenizer(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    e = packing.encoding()
    assert isinstance(e, tiktoken.Encoding)
    want = {r.doc_id: len(e.encode_ordinary(r.text or "")) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.tokens for r in packing.token_counts(docs).collect()} == want


def test_little_is_left_unused(spark, data):
    docs, caps = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{data}/pack_sizes.parquet")
    assert all(r.packs <= r.least * 1.02 + 1 for r in packing.report(docs, caps).collect())


# leaks


def brute(docs, items, width=12):
    grams = {}
    for i, t in items:
        w = leaks.words_of(t or "")
        for j in range(len(w) - width + 1):
            grams.setdefault(tuple(w[j : j + width]), set()).add(i)
    out = set()
    for k, t in docs:
        w = leaks.words_of(t or "")
        for j in range(len(w) - width + 1):
            own = grams.get(tuple(w[j : j + width]), set())
            if len(own) == 1:
                out.add((k, *own))
    return out


def vocabulary():
    random.seed(2)
    return ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(300)]


def test_leaks_equal_brute_force(spark):
    v = vocabulary()
    say = lambda n: " ".join(random.choices(v, k=n))
    common = say(15)
    items = [(i, common + " " + say(random.randint(5, 60))) for i in range(30)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for k in range(120):
        t = say(random.randint(0, 80))
        if k % 3 == 0:
            w = random.choice(items[:30])[1].split()
            n = random.randint(8, 16)
            a = random.randrange(max(1, len(w) - n))
            piece = w[a : a + n]
            piece[len(piece) // 2] = piece[len(piece) // 2].upper() + ","
            t = t + ".\n" + "  ".join(piece) + "! " + say(5)
        if k % 10 == 1:
            t += " " + common
        docs.append((k, t))
    docs += [(500, None), (501, ""), (502, items[3][1]), (502, items[3][1]), (503, say(60_000) + " " + items[4][1])]
    got = set(map(tuple, leaks.found(spark.createDataFrame([(*d, None, None, None) for d in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == brute(docs, items) and {(502, 3), (503, 4)} <= got
    assert leaks.found(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leaks.found(spark.createDataFrame([(1, "x", None, None, None)], DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_words_divided_at_line_ends():
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    ix = leaks.ItemIndex([(1, " ".join(words))])
    text = "start one two three four five six sev-\n   en eight NINE, ten\neleven twelve end"
    assert ix.search([text, "one two three four five six seven eight nine ten eleven", None]) == [(0, 1)]


def test_blocks_find_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    ix = leaks.ItemIndex([(1, " ".join(vocabulary()[:200]))])
    base = ix.prints[rng.integers(0, len(ix.prints), 300)]
    near = base.copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    places, windows = ix.candidates(near)
    got = set(zip(places.tolist(), windows.tolist()))
    want = {(i, j) for i in range(len(near)) for j in range(len(ix.prints)) if bin(int(near[i] ^ ix.prints[j])).count("1") <= leaks.RADIUS}
    assert got == want


def test_fingerprints_equal_plain():
    import numpy as np

    pairs = leaks.pair_hashes(np.array([leaks._hash(w) for w in vocabulary()[:40]], np.uint64))
    got = leaks.fingerprints(pairs, 12)
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
    want = [np.packbits(bits[i : i + 11].sum(axis=0) >= 6).view(np.uint64)[0] for i in range(len(pairs) - 10)]
    assert got.tolist() == want


def test_a_long_text_is_searched_in_pieces(monkeypatch):
    v = vocabulary()
    items = [(i, " ".join(v[i * 12 : i * 12 + 12])) for i in range(20)]
    text = " ".join(v)
    whole = leaks.ItemIndex(items).search([text, text])
    monkeypatch.setattr(leaks, "CHUNK", 7)
    assert leaks.ItemIndex(items).search([text, text]) == whole and len(whole) == 40


def test_several_passes_agree(spark, monkeypatch):
    v = vocabulary()
    items = [(i, " ".join(v[i * 20 : i * 20 + 30])) for i in range(10)] + [(50, " ".join(v[:30])), (51, None)]
    text = " ".join(v)
    whole = leaks.ItemIndex(items[:-1]).search([text])
    docs, it = spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    want = sorted((7, i) for _, i in whole)
    assert sorted(map(tuple, leaks.found(docs, it).collect())) == want and len(want) == 9
    monkeypatch.setattr(leaks, "MAX_WINDOWS", 60)
    assert sorted(map(tuple, leaks.found(docs, it).collect())) == want


# spam


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=9), min_size=1, max_size=4), st.integers(2, 4), st.integers(1, 3))
def test_automaton_equals_brute_force(strings, least, phrase):
    n = Counter(s[i:j] for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    for floor in (None, 2, 3):
        want = []
        for s in strings:
            m = [False] * len(s)
            for i in range(len(s)):
                for j in range(i + phrase, len(s) + 1):
                    if n[s[i:j]] >= (least if floor is None else max(floor, least * phrase / (j - i))):
                        m[i:j] = [True] * (j - i)
            want.append(m)
        assert spam.covered([list(s) for s in strings], least, phrase, floor) == want


def test_longer_phrases_need_fewer_occurrences():
    """What counts of neighbouring words alone can't tell: the same pairs, as often, in one long phrase or in many short ones."""
    long = ["abcdefgh"] * 3
    short = [x for k in range(7) for x in ["abcdefgh"[k : k + 2]] * 3]
    assert all(all(m) for m in spam.covered([list(s) for s in long], 8, 2, 3)) and not any(any(m) for m in spam.covered([list(s) for s in short], 8, 2, 3))


def test_words_around_links_and_long_pages():
    stuffed = "cheap phone case best rice cooker " * 40 + "see https://x.example/a for more"
    assert spam.spam_share(stuffed) > 0.9 and spam.spam_share(PROSE * 8 + "See https://x.example/a for more.") < 0.05
    random.seed(4)
    phrases = [" ".join(random.choices(vocabulary(), k=3)) for _ in range(60)]
    page = ". ".join(f"ask about {p} and buy {p}, compare {p} near you" for _ in range(40) for p in random.sample(phrases, 60))
    assert len(page.split()) > 25_000 and spam.spam_share(page) > 0.9


PROSE = "The board said that the bridge was not ready, and the vendors who had waited for it since the flood went on to ask for a new date. "
SPAM = [
    "cheap phone case cheap phone case best rice cooker " * 12,
    "Ask about best lechon delivery, compare best lechon delivery, and buy best lechon delivery near Dalampas. " * 12,
    "\n".join(f"https://x{i}.example/phone-case" for i in range(12)),
    "\n".join(f"Court asks mayor about funds - <a href='http://a{i}.test/b'>rice cooker</a>" for i in range(12)),
    "#ricecooker #phonecase2025 #vanrental " * 20,
    "\n".join(f"ROOF PAINT fast P{i}15 SKU-358{i} tags: rice cooker, load promo, van rental" for i in range(10, 20)),
    PROSE + "\n" + "legit load promo free printer ink original condo " * 30,
]
HAM = [
    PROSE * 5, PROSE + "\n#bridge #vendors #flood", PROSE * 3 + "\nhttps://x.example/a",
    PROSE + "\n" + "\n".join(f"Malaya Bay: Ana Cruz {i}36 votes, Ben Reyes {i}7 votes" for i in range(10, 30)),
    PROSE + "\n" + "\n".join(f"{i} cups coconut milk" for i in range(3, 12)) + "\n" + PROSE,
    "\n".join(["And we will sing of the river and of those who went before us", f"verse {'abcdefgh'[k]} that nobody here has heard of in all the years of the town"][j] for k in range(8) for j in (0, 1)),
    "A short headline only", "", " \n ", None,
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert spam.spam_share(text) > 0.5


@pytest.mark.parametrize("text", HAM)
def test_no_spam(text):
    assert spam.spam_share(text) <= 0.5


def test_spam_found(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(SPAM + HAM)] + [(0, SPAM[0], None, None, None), (900, PROSE * 3000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(r[0] for r in spam.found(df).collect()) == [0, *range(len(SPAM))]
    assert spam.shares(df).count() == len(rows) and spam.found(df.limit(0)).count() == 0
    assert re.match("doc_id", spam.shares(df).columns[0])


def test_shares_below_one_half_are_counted(spark):
    stuffed = "cheap phone case best rice cooker " * 12
    prose = "".join(f"The {w} of the town said that it had not been ready before the flood. " for w in "board clerk mayor judge nurse guard pilot coach baker miner".split())[: len(stuffed.strip()) * 3 // 2]
    page = prose.strip() + "\n" + stuffed
    share = spam.spam_share(page)
    assert 0.35 < share < 0.45 and spam.spam_share(page, 0.5) <= 0.5 < spam.spam_share(stuffed, 0.5)
    df = spark.createDataFrame([(1, page, None, None, None), (2, prose, None, None, None)], DOCS)
    assert {r.doc_id: r.share for r in spam.shares(df).collect()} == {1: share, 2: 0.0}
    assert [r[0] for r in spam.found(df, 0.3).collect()] == [1] and spam.found(df).count() == 0
