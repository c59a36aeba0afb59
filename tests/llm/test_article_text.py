import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import article_pass, languages, page_lines, queries, residue, truncation

SCHEMA = "id long, source string, title string, content string, lang string, score double, article_id long"
PROSE = [
    "The Office of Rural Roads denied that the plan was drawn up without asking vendors, who had waited for the new bridge since the flood of last year.",
    "A survey of 40 residents found that most of them were in favor of the move to repair the town plaza before the start of the planting season.",
]
TL = "Sinabi ng mga residente na hindi pa malinaw kung sino ang magbabayad ng utang sa mga supplier, subalit hindi kumbinsido ang mga mangingisda sa bayan."


def marks(*lines, title=None):
    return page_lines.label(list(lines), title)


def test_labels():
    p, r, f = PROSE, page_lines.REPORT, page_lines.FURNITURE
    assert marks("Home | News | Sports | Login", "By Juan dela Cruz", p[0], "ADVERTISEMENT", p[1], "", "Share this story with your friends", "© 2025 The Outlet. All rights reserved.") == [f, f, r, f, r, 0, f, f]
    assert marks(p[0], "How the money was spent", p[1]) == [r, r, r]
    assert marks(p[0], "Related stories", "Rain cuts off two towns", "2. Court asks mayor about funds", "Why vendors wait") == [r, f, f, f, f]
    assert marks(p[0], "* Malaya Bay: 34 teachers", "- Salinaw: 9 nurses", p[1]) == [r] * 4
    assert marks(p[0], "We use cookies to measure visits. Accept all or manage choices.", p[1], "READ: Another story", "Tags: one, two, three") == [r, f, r, f, f]
    assert marks(p[0], "A team of engineers will stu") == [r, r]
    assert marks("Home | News | Login", "By Juan dela Cruz", "A team of engineers will stu") == [f, f, r] and marks("Home", "Rain fell", title="Rain fell") == [f, r]
    assert marks() == [] and marks("") == [0] and marks("12:30", "—") == [0, 0]
    assert marks("word " * 50_000 + "end.") == [r]


def test_html_body():
    html = f"<html><nav><a>Home</a><a>News</a></nav><article><h1>Head</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p></article><footer><p>© 2025 Outlet</p></footer><script>var x=1</script>"
    assert page_lines.html_body(html).split("\n") == ["Head", *PROSE] or page_lines.html_body(html).split("\n") == PROSE
    assert page_lines.html_body(html[: html.index(PROSE[1]) + 60]).split("\n")[-1] == PROSE[1][:60]
    assert page_lines.html_body(None) == "" == page_lines.html_body("") == page_lines.html_body("<nav>Home</nav>")


def test_endings():
    ends = frozenset(["teachers"])
    whole = ["It ended well.", 'He said "yes."', "It ended. -30-", "It ended. — Malaya Bay", "It ended. (Reyes)", "It ended. /abc", "* Salinaw: 9 teachers", "«Seguimos esperando...»", "Is it so?"]
    assert [truncation.ending(x, ends) for x in whole] == [truncation.WHOLE] * len(whole)
    broken = ["It was the...", "It was the…", "He sa&am", "He sai&#82", "as told <stro", "caf\\u00", "naï�", "and so on (more)", "it was, sub... Read more", "Rain [...]"]
    assert [truncation.ending(x, ends) for x in broken] == [truncation.BROKEN] * len(broken)
    missing = ["It was on the way to", "- Sta. Verben", "* Salinaw: 9 teach", '"we were told']
    assert [truncation.ending(x, ends) for x in missing] == [truncation.MISSING] * len(missing)
    assert truncation.unclosed('("a" [b') == [")", "]"]


def test_weak_labels_and_model():
    assert residue.weak_label(["Error 404", "Page not found"]) == 1 and residue.weak_label(["{{ article.body }}"]) == 1
    assert residue.weak_label([PROSE[0], 'The portal showed a "404 Not Found" page.']) == 0
    assert residue.weak_label(["Velumo nubelo quiesto dolarem corundo regendi primoris placeda quiesto."]) == 1
    bodies = [residue.body([x], None) for x in PROSE * 5] + [residue.Body(["Error 404"]), residue.Body(["{{ body }}"]), residue.Body(["Access denied"])] * 5
    m = residue.ResidueModel.fit(bodies, [None] * len(bodies), [0] * 10 + [1] * 15)
    assert (m.scores(bodies, [None] * len(bodies)) > 0.5).tolist() == [False] * 10 + [True] * 15
    assert m.scores([], []).size == 0 and 0 <= m.scores([residue.Body()], [None])[0] <= 1
    assert residue.ResidueModel.fit([], [], []).scores([residue.Body(["x"])], [None])[0] < 0.5


def viterbi_plain(scores, penalty):
    n, k = scores.shape
    v, back = scores[0].astype(float), []
    for t in range(1, n):
        step = [[v[j] - (penalty if i != j else 0) for j in range(k)] for i in range(k)]
        back.append([int(np.argmax(s)) for s in step])
        v = np.array([max(s) for s in step]) + scores[t]
    path = [int(np.argmax(v))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], float(v.max())


def test_viterbi_equals_plain():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 5, 12, 3, 30])
    scores = rng.normal(size=(lengths.sum(), 5)).astype(np.float32)
    path, at = languages.viterbi(scores, lengths, 1.5), 0
    for n in lengths:
        s, p = scores[at : at + n], path[at : at + n]
        got = sum(s[i, p[i]] for i in range(n)) - 1.5 * sum(p[i] != p[i - 1] for i in range(1, n))
        assert abs(got - viterbi_plain(s, 1.5)[1]) < 1e-3
        at += n
    assert len(languages.viterbi(np.zeros((0, 5), np.float32), np.zeros(0, np.int64), 1.0)) == 0


def test_codes():
    assert [languages.normal_code(x) for x in ("fil", "en-PH", " TGL ", "es_ES", "und", "", None, "CEB")] == ["tl", "en", "tl", "es", None, None, None, "ceb"]
    assert languages.script_of("привет") == "ru" and languages.script_of("word") is None


@pytest.fixture(scope="module")
def small(spark, data):
    return spark.read.parquet(f"{data}/articles.parquet").withColumns({"lang": F.lit("clash"), "score": F.lit(1.0), "article_id": F.lit(7)})


def odd(spark):
    rows = [(1, None, None, None), (2, "s", "", ""), (3, "s", "t", "  \n "), (4, "s", None, "x" * 300_000), (5, "s", "t", "Error 404\n\nNot found"), (6, "s", PROSE[0], PROSE[0] + "\n" + TL), (6, "s", PROSE[0], PROSE[0] + "\n" + TL)]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def test_operators_on_odd_rows(spark, small):
    df = small.select("id", "source", "title", "content", "lang", "score", F.col("article_id").cast("long").alias("article_id")).unionByName(odd(spark).withColumn("id", F.col("id") - 100))
    model = residue.train(df)
    cases = {r[0] for r in article_pass.residue_found(df, model).collect()}
    assert -95 in cases and not cases & {-99, -98, -97, -94}
    out = article_pass.lines_outside(df, model)
    assert out.where(F.col("article_id").isin(list(cases))).count() == 0
    assert {r.article_id for r in out.collect()} <= {r.id for r in df.select("id").collect()}
    text = {r.article_id: r.report for r in article_pass.report_text(df).collect()}
    assert text[-99] is None and text[-98] == ""
    cut = {r[0] for r in truncation.found(df).collect()}
    assert not cut & {-99, -98, -97, -95, -94}
    s = truncation.shares(df).collect()
    assert all(0 <= r.share <= 1 for r in s)
    labels = spark.createDataFrame([(-94, "en-PH", None), (-98, None, None)], "article_id long, lang string, label_origin string")
    found = languages.found(df, labels)
    assert sorted(r.lang for r in found.where("article_id = -94").collect()) == ["en", "tl"]
    assert found.where("article_id in (-99, -98, -97, -95)").count() == 0


def test_languages_of_held_out_sentences(spark, small):
    scores = languages.fit([tuple(r) for r in small.select("id", "source", "title", "content").where("content is not null").collect()])
    cases = {PROSE[0]: ["en"], TL: ["tl"], PROSE[0] + " " + TL: ["en", "tl"], "": [], "1234 567": [], "Привет мир, как дела сегодня": ["ru"], "Las obras siguen cerradas porque faltaban documentos para el hospital del distrito.": ["es"]}
    assert [sorted({x for x, _, _ in s}) for s in languages.segments(list(cases), scores)] == list(cases.values())
    long = languages.segments([(PROSE[0] + " ") * 2000 + TL, "", TL], scores)
    assert {x for x, _, _ in long[0]} == {"en", "tl"} and long[1] == [] and {x for x, _, _ in long[2]} == {"tl"}


def test_passages(spark, small):
    scores = languages.fit([tuple(r) for r in small.select("id", "source", "title", "content").where("content is not null").collect()])
    # a short line that could be of either language goes with its neighbours; its own words come out by place
    text = TL + "\nTinig ng mga taga-Bayan\n" + PROSE[0] + " " + PROSE[1]
    got = languages.segments([text], scores)[0]
    assert [x for x, _, _ in got] == ["tl", "tl", "en"] and all(0.5 < c <= 1 for _, _, c in got)
    n = lambda x: len(residue.pages._WORD.findall(x))
    assert [k for _, k, _ in got][0] == n(TL)
    # no path is cut: the second language begins after thousands of words of one line
    long = languages.segments([(PROSE[0] + " ") * 400 + TL], scores)[0]
    assert [x for x, _, _ in long] == ["en", "tl"] and sum(k for _, k, _ in long) == 400 * n(PROSE[0]) + n(TL)
    # another script leaves one candidate, within a text as well
    assert [x for x, _, _ in languages.segments(["Привет мир, как дела сегодня. " + PROSE[0]], scores)[0]] == ["ru", "en"]
    # of two documents the paths are apart
    assert [[x for x, _, _ in s] for s in languages.segments([TL, PROSE[0], ""], scores)] == [["tl"], ["en"], []]
    rows = [(1, "s", PROSE[0][:60], PROSE[0] + "\n" + TL), (2, None, None, None), (3, "s", "t", "")]
    out = languages.segments_of(small.select("id", "source", "title", "content").unionByName(spark.createDataFrame(rows, "id long, source string, title string, content string").withColumn("id", F.col("id") - 100)))
    mine = [tuple(r)[1:5] for r in out.where("article_id = -99").orderBy("line_no").collect()]
    assert mine == [(0, 1, n(PROSE[0][:60]), "en"), (1, 1, n(PROSE[0]), "en"), (2, 1, n(TL), "tl")] and out.where("article_id in (-98, -97)").count() == 0


def test_lines_are_compared_alike_here_and_in_the_engine(spark):
    from pressmill.functions.keys import letters_only
    from pressmill.llm import repeated_lines

    lines = ["Share this!", "SHARE  this 12", "Ñandú — uno", "Ⅷ ² ok", "straße", "é combining", "abc", "a", "x" * 5000, "日本語 text", "12 34", ""]
    row = spark.createDataFrame([("\n".join(lines),)], "c string").select(repeated_lines.line_ids(F.col("c")).alias("i"), F.transform(F.split("c", "\n"), letters_only).alias("k")).first()
    assert [page_lines.letters(x) for x in lines] == row.k
    assert [page_lines.Recurring({i: True}).of(x) if i is not None else None for x, i in zip(lines, row.i)] == [True] * 10 + [None] * 2
    assert page_lines.Recurring({row.i[0]: False}).of("share this") is False and page_lines.Recurring({row.i[0]: False}).of("share thus") is None


def test_recurrence_has_no_limit_of_length_and_copies_count_once(spark):
    notice = "Zubro fenta mirlo " * 40 + "end of it."  # 720 characters, a sentence, no wording that a list knows
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    rows = [(i, "Alpha", "t", f"{PROSE[0]} {word(i)}.\n{notice}\n{PROSE[1]} {word(i)}.") for i in range(60)]
    rows += [(1000 + i, "Alpha", "t", PROSE[1] + "\n" + TL) for i in range(60)]  # one story, taken in sixty times
    df = spark.createDataFrame(rows, "id long, source string, title string, content string")
    got = {(r.article_id, r.line_no) for r in article_pass.lines_outside(df, residue.ResidueModel.fit([], [], [])).collect()}
    assert got == {(i, 2) for i in range(60)}


def test_endings_have_no_window():
    none, far = frozenset(), "x" * 900
    assert truncation.ending(f'As told <a href="https://a.test/{far}', none) == truncation.BROKEN
    listed = "Salinaw: 9 teachers, " + ", ".join(f"{i} nurses" for i in range(2, 90)) + ", 7 teachers"
    assert truncation.ending(listed, frozenset(["teachers"])) == truncation.WHOLE and len(listed) > 800
    assert truncation.ending("It was 5 < 6 that day.", none) == truncation.WHOLE
    assert not page_lines.labelled("a: " + "1 2 " * 100_000) and page_lines.labelled("Rain: 3 teachers, 4 nurses")


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    model = residue.train(e)
    assert article_pass.residue_found(e, model).count() == 0 and article_pass.lines_outside(e, model).count() == 0
    assert truncation.found(e).count() == 0
    assert languages.found(e, spark.createDataFrame([], "article_id long, lang string")).count() == 0
    assert residue.validation(e).first().pages == 0
    assert article_pass.page_bodies(spark.createDataFrame([(1, None), (2, "<p>" + PROSE[0])], "id long, raw_html string")).where("body = ''").count() == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns) and not df.isEmpty()


def test_validation_on_unseen_hosts(spark):
    r = residue.validation(spark.read.parquet("/root/testdata/sf0.01/articles.parquet")).first()
    assert r.pages > 300 and r.accuracy > 0.97


def test_recurring_lines_are_furniture(spark, monkeypatch):
    from pressmill.llm import repeated_lines

    strange = "Zubro fenta mirlo"  # no list knows it
    rows = [(i, "Alpha", "t", "\n".join([PROSE[0], strange if i % 2 else strange.upper() + "!", PROSE[1], f"Story number {'abcdefghij'[i % 10]}{'klmnop'[i % 6]}"]), None, None, None) for i in range(40)]
    df = spark.createDataFrame(rows + [(100, None, None, None, None, None, None)], SCHEMA)
    model = residue.ResidueModel.fit([], [], [])
    got = {(r.article_id, r.line_no) for r in article_pass.lines_outside(df, model).collect()}
    assert {(i, 2) for i in range(40)} <= got and not {(i, n) for i in range(40) for n in (1, 3)} & got
    assert article_pass.recurring(df)["alpha"].of(strange.upper() + " 7") is True and article_pass.recurring(df)["alpha"].of("Zubro fenta") is None
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", 0)  # as with too many sources to hold
    assert {(r.article_id, r.line_no) for r in article_pass.lines_outside(df, model).collect()} == got


def test_what_is_left_open_breaks_a_report(spark):
    none, long = frozenset(), "x" * 300
    whole = ['"We wait.\n"We go on."', "“We wait.\n“We go on.”", 'A pipe of 5" was laid.', "He left :( and came back.", "a) The first.", '<p>Read <a href="/a(b">this</a>.', "<b>Bold</b> (and <i>more</i>).", "<br>It ended.", "([a) It ended.", "<!-- x ( -->It ended.", '“Mixed," they said.']
    assert [truncation.report_ending(x.split("\n"), none) for x in whole] == [truncation.WHOLE] * len(whole)
    broken = ['"We wait.\nWe go on.', "They said (as told.\nIt went on.", '"we were told', "It was [as\nthey said", "It <strong>was so.", f'As told <a href="https://a.test/{long}', "<div>It ended.", "He said «no.\nThey left."]
    assert [truncation.report_ending(x.split("\n"), none) for x in broken] == [truncation.BROKEN] * len(broken)
    assert truncation.unclosed("") == [] and truncation.unclosed("x" * 500_000 + "(" * 2000 + ")" * 1999) == [")"]
    # an outlet that sets no terminators: an open quote is reported all the same
    bare = "The board said that the plan for the bridge was ready and that the work would go on for the year"
    rows = [(i, "Alpha", "t", PROSE[i % 2] + f"\n{bare} {'abcdefghij'[i]}" + (', "as we told' if i == 3 else ""), None, None, None) for i in range(10)]
    assert [r[0] for r in truncation.found(spark.createDataFrame(rows, SCHEMA)).collect()] == [3]


def test_entry_ends_are_counted_over_all_articles(spark, monkeypatch):
    monkeypatch.setattr(residue, "SAMPLE_CHARS", 100)  # the sample holds none of the lists
    lists = PROSE[0] + "\n* Salinaw: 9 teachers\n* Verona: 7 nurses"
    rows = [(i, "Alpha", "t", lists if i < 8 else PROSE[i % 2], None, None, None) for i in range(60)]
    rows += [(100, "Alpha", "t", PROSE[0] + "\n* Salinaw: 9 teach", None, None, None), (101, "Alpha", None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert truncation.entry_ends(df) == {"teachers", "nurses"} and truncation.entry_ends(df.limit(0)) == frozenset()
    assert [r[0] for r in truncation.found(df).collect()] == [100]
    # relative: words that few of many entries end in are none, however many rows there are
    many = spark.createDataFrame([(i, "Alpha", "t", "\n".join(["* Salinaw: 9 teachers"] * 400 + ["* Verona: 9 teach"] * (i < 6)), None, None, None) for i in range(20)], SCHEMA)
    assert truncation.entry_ends(many) == {"teachers"}
