import pytest

from sedimenta.llm import licenses


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_templates_and_edited_notices_are_confirmed(spark, scanner):
    for family, ps in licenses.TEMPLATES.items():
        for p in ps:
            assert [h[1] for h in scanner.scan(p, 0.6) if h[4]] == [family], p
    edited = "You should have received a copy of the GNU General Public License along with this code; if not, see https://www.gnu.org/licenses/"
    assert [h[1] for h in scanner.scan(edited, 0.6) if h[4]] == ["gpl"]


def test_held_out_lines_of_the_corpus(spark, scanner):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hits = licenses.scan(docs, scanner).collect()
    got = {(r.id, r.line_no): r.family for r in hits if r.confirmed}
    marks = {"GNU General Public License": "gpl", "CC BY-NC": "cc-by-nc", "MIT License": "mit", "Apache License": "apache-2.0"}
    want = {(r.doc_id, i): f for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) for m, f in marks.items() if m in x}
    assert got == want


def test_odd_texts(spark, scanner):
    rows = [(1, None, 0), (2, "", 0), (3, "the of and in", 0), (4, "a\n\nReleased under the MIT License.", 0), (4, "a\n\nReleased under the MIT License.", 0), (5, "***", 0), (6, "permission to use the work", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family int")
    got = [(r.id, r.line_no, r.family) for r in licenses.scan(df, scanner).collect() if r.confirmed]
    assert got == [(4, 2, "mit")] * 2
    assert licenses.scan(df.limit(0), licenses.train(df.limit(0))).count() == 0


def test_probabilities_are_calibrated_on_held_out_paragraphs_and_documents(scanner):
    said, right = scanner.reliability
    assert right > 0.5 and abs(said - right) < 0.15


def test_a_very_long_text_and_a_brute_force_overlap(spark, scanner):
    notice = licenses.TEMPLATES["mit"][0]
    df = spark.createDataFrame([(1, ("plain words of no licence at all\n" * 20_000) + notice)], "doc_id long, text string")
    got = [(r.line_no, r.family, r.overlap) for r in licenses.scan(df, scanner).collect() if r.confirmed]
    assert got == [(20_000, "mit", 1.0)]
    # the overlap of a line with a template, counted without the scanner's tables
    line = "the software is provided under the terms of the mit license as released here"
    words = licenses._words(line)
    pairs = list(zip(words, words[1:]))
    best = {f: max(sum(p in set(zip(w, w[1:])) for p in pairs) / len(pairs) for w in map(licenses._words, ps)) for f, ps in licenses.TEMPLATES.items()}
    assert all(abs(o - best[f]) < 1e-12 for _, f, _, o, _ in scanner.scan(line, 0.6))
