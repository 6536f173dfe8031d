from pyspark.sql import functions as F

from sedimenta.functions import messages, paths, style


def test_style_features_of_a_block(spark):
    code = 'def f(x):  # note that x is a list.\n\t# TODO: Step\n    s = "a # b"\n\n    return some_long_identifier + otherName;\n'
    df = spark.createDataFrame([(1, code, "Python"), (2, None, "Go"), (3, "", None), (4, "// ... existing code\nif err != nil {\n}\n/* x */", "Go")], "id int, t string, lang string")
    got = {r.id: r for r in style.source_features(df, text="t", language="lang").collect()}
    a = got[1]
    assert len([c for c in a.asDict() if c not in ("id", "t", "lang")]) == 46
    assert (a.is_python, a.is_go, a.comment_line_rate, a.inline_comment_rate) == (1.0, 0.0, 1 / 6, 1 / 3)
    assert (a.todo_rate, a.explanatory_rate, a.comment_period_rate, a.comment_words_mean) == (0.5, 0.5, 0.5, 4.0)
    assert (a.string_rate, a.string_len_mean, a.semicolon_rate, a.tab_rate, a.kwarg_rate) == (1 / 3, 5.0, 1 / 3, 0.25, 1 / 3)
    assert a.snake_rate > 0 and a.camel_rate > 0 and a.blank_rate == 2 / 6
    assert all(v == 0.0 for k, v in got[2].asDict().items() if k not in ("id", "t", "lang", "is_go"))
    assert got[4].elision_present == 1.0 and got[4].guard_rate == 0.5 and got[4].brace_only_rate == 0.5 and got[4].comment_line_rate == 0.5


def test_paths_and_tasks(spark):
    rows = [("src/App.TSX", "fix crash"), ("docs/a.md", "write"), ("tests/test_a.py", "x"), ("a.go", "refactor it"), ("b.rs", "add b"), ("c.c", "bump deps"), ("Makefile", "hm")]
    df = spark.createDataFrame(rows, "p string, s string").select("p", paths.language(F.col("p")).alias("l"), paths.path_class(F.col("p")).alias("c"), paths.task_class(F.col("s"), F.col("p")).alias("t"))
    assert [(r.l, r.c, r.t) for r in df.collect()] == [
        ("TypeScript", "source", "bug_fix"), (None, "documentation", "documentation"), ("Python", "test", "test"), ("Go", "source", "refactor"),
        ("Rust", "source", "feature"), ("C", "source", "maintenance"), (None, "source", "other"),
    ]
    assert df.sparkSession.range(1).select(paths.is_skipped(F.lit("a/vendor/x.go")).alias("x")).first().x


def test_messages(spark):
    text = "Subject\r\n\r\nRan all tests. See #12 and a@b.org.\n- one\n- two\n- three\n\n\n\nEnd.\nSigned-off-by: A <a@b.org>\n"
    df = spark.createDataFrame([("r", text), ("r", "One line")], "repo string, m string")
    assert df.select(messages.normalized(F.col("m")).alias("n")).first().n == "Subject\n\nRan all tests. See  and .\n- one\n- two\n- three\n\nEnd."
    out = messages.with_style(df, "m")
    out = messages.classified(out.join(messages.baselines(out, by="repo", least=1), "repo"))
    a, b = out.orderBy(F.desc("body_words")).collect()
    assert a.signals == ["structured_body", "enumerated_detail", "explicit_validation"] and a.at_3 and not a.at_4
    assert b.score == 0


def test_texts_without_the_needed_parts_are_as_the_patterns_say(spark):
    import random

    from pyspark.sql import functions as F

    from sedimenta.functions import messages as M
    from sedimenta.functions import style as Y
    from sedimenta.functions import text as T

    rng = random.Random(8)
    marks = [*" \t\x0b\x0c\r;={}#?:`@", "\u0085", " ", " ", "ſ", "K", "if ", "else", "is None", "print(", "raise ", "x: Int", "teſt", "ran tests", "Cʟ", "claude", "OPENAI", "devın", "https://a", "a@b.co", "deadbeef1", "AbcdefghijklmnopQ", "snake_case", "9abc"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    x = F.col("t")
    wrong = {
        "left": T.left_stripped(x) != F.regexp_replace(x, r"^\s+", ""),
        "right": T.right_stripped(x) != F.regexp_replace(x, r"\s+$", ""),
        "blank": T.blank(x) != (F.regexp_replace(x, r"\s+", "") == ""),
        **{n: x.rlike(p) & ~T.has(x, *Y.NEEDED[n]) for n, p in Y.CODE.items()},
        **{f"removed {i}": x.rlike(p) & ~(T.has_anycase if p.startswith("(?i") else T.has)(x, *M.NEEDED[i]) for i, p in enumerate(M.REMOVED) if M.NEEDED[i]},
        "validation": x.rlike(M.VALIDATION) & ~T.has_anycase(x, *M.VALIDATED),
    }
    found = df.agg(*[F.count_if(c).alias(n) for n, c in wrong.items()]).first().asDict()
    assert not any(found.values()), found
    names = F.regexp_extract_all(x, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    new = Y.line_features(x)
    off = df.select(
        (new["ident_len_mean"] * F.greatest(F.size(names), F.lit(1)) - F.aggregate(names, F.lit(0), lambda a, n: a + F.length(n))).alias("mean"),
        (new["ident_long_rate"] * F.greatest(F.size(names), F.lit(1)) - F.size(F.filter(names, lambda n: F.length(n) >= 14))).alias("long"),
    )
    assert off.filter("abs(mean) > 1e-9 or abs(long) > 1e-9").isEmpty()
