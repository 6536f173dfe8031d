import random

import pytest

import corpus_pipeline
from sedimenta.llm import linededup, registry
from tests import oracle


def brute(docs, percent=75):
    seen, out = [], {}
    for i, t in sorted(docs):
        gone = []
        for no, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if len(w) < 5 and len(line.strip()) < 20:
                continue
            s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
            if any(w == v or s & r and 100 * len(s & r) >= percent * len(s | r) for v, r in seen):
                gone.append(no)
            seen.append((w, s))
        out[i] = gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    pool = [[word() for _ in range(rng.randint(3, 60))] for _ in range(12)]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(pool)) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 30))]
            for _ in range(rng.randint(0, 3) if rng.random() < 0.7 else 0):
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice([" ", "  ", ", "]).join(w))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.removed_lines, r.text) for r in linededup.dedup_lines(df).collect()}
    want = brute(docs)
    for i, t in docs:
        assert got[i][0] == want[i], i
        assert got[i][1] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])


def test_near_copies_go_and_lines_sharing_a_phrase_stay(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words])), (3, "three common words. une ecole."), (4, "three common words. elle a dit."), (5, "extraordinarily longer"), (6, " Extraordinarily  LONGER")]
    got = {r.doc_id: r.removed_lines for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [], 5: [], 6: [0]}


def test_odd_rows_and_columns(spark):
    line = "one two three four five six"
    rows = [(1, line, 0), (2, f"{line}\nshort line\n\n{line.upper()}", 0), (2, f"{line}\nshort line\n\n{line.upper()}", 0), (3, None, 0), (4, "", 0), (None, line, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines int")
    got = sorted(((str(r.doc_id), r.text, tuple(r.removed_lines), r.n_lines) for r in linededup.dedup_lines(df).collect()), key=str)
    cut = ("2", "short line\n", (0, 3), 4)
    assert got == sorted([("1", line, (), 1), cut, cut, ("3", None, (), 0), ("4", "", (), 1), ("None", "", (0,), 1)], key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    oracle.agree(spark, oracle.connect(), registry.op6_line_dedup, linededup.ORACLE)


def test_pipeline_keeps_lines_that_share_one_phrase(spark):
    rows = [(1, "three common words. une ecole.", 30), (2, "three common words. elle a dit.", 31), (3, "Three  common words. une ecole.", 31)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {1, 2}


def test_lines_that_share_a_frequent_passage_only_stay(spark):
    passage = [f"p{k}" for k in range(20)]
    rows = [(i, " ".join([*passage, *[f"d{i}x{k}" for k in range(20)]])) for i in range(30)] + [(100, " ".join([*passage, *[f"d3x{k}" for k in range(19)], "last"]))]
    got = {r.doc_id: r.removed_lines for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [0] if i == 100 else [] for i, _ in rows}


def test_clashing_names_and_a_very_long_text(spark):
    lines = [" ".join(f"w{i}x{k}" for k in range(6)) for i in range(20000)]
    rows = [(1, "\n".join(lines), 1, 2, 3), (2, "\n".join(reversed(lines)), 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int, h1 int, pos int")
    got = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
    assert got[1].removed_lines == [] and got[2].removed_lines == list(range(20000)) and got[2].text == ""
    assert (got[2].line, got[2].h1, got[2].pos) == (1, 2, 3)


def test_a_text_is_cut_once_not_once_a_line(spark):
    line = "one two three four five six"
    rows = [(1, line), (2, f"first line\n{line}\nlast line")]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r.doc_id: (r.text, r.removed_lines, r.n_lines) for r in out.collect()} == {1: (line, [], 1), 2: ("first line\nlast line", [1], 3)}


def test_lines_that_share_one_phrase_are_not_tokenized_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(linededup, "materialize", lambda df, real=linededup.materialize: written.append((df.columns, (out := real(df)).count())) or out)
    rows = [(i, " ".join([*[f"a{i}x{k}" for k in range(30)], *[f"p{i // 2}x{k}" for k in range(5)], *[f"b{i}x{k}" for k in range(30)]])) for i in range(60)]
    rows += [(100, rows[0][1] + " last")]
    got = {r.doc_id: r.removed_lines for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [0] if i == 100 else [] for i, _ in rows}
    assert [n for columns, n in written if {"pos", "toks", "n"} <= set(columns)][0] == 2


def test_long_lines_at_the_border_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 150))] for _ in range(15)]
    docs = []
    for i in range(150):
        w = list(rng.choice(pool))
        for _ in range(rng.randint(0, len(w) // 16)):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 400)}"
        docs.append((i, " ".join(w)))
    want = brute(docs)
    got = {r.doc_id: r.removed_lines for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and 20 < sum(map(len, want.values())) < 140
