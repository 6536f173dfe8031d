"""What a path or a change is: language, test or source, task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, skipped fragments and task words.
LANGUAGES = {
    ".go": "Go", ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".java": "Java", ".c": "C",
    ".cc": "C++", ".cpp": "C++", ".h": "C", ".hpp": "C++", ".rs": "Rust", ".rb": "Ruby", ".cs": "C#", ".kt": "Kotlin", ".swift": "Swift",
    ".scala": "Scala", ".php": "PHP", ".m": "Objective-C", ".mm": "Objective-C",
}
SKIPPED = ["vendor/", "node_modules/", "third_party/", "testdata/", "fixture/", "fixtures/", "generated", ".pb.go", ".min.js", "dist/", "build/"]
BUG = r"(^|\W)(fix|bug|defect|crash|regression|hotfix)(\W|$)"
TEST_PATH = r"(^|[/_.-])(test|tests|spec)([/_.-]|$)"
REFACTOR = r"(^|\W)(refactor|restructure|cleanup|simplif)(\W|$)"
FEATURE = r"(^|\W)(add|implement|introduce|feature|support)(\W|$)"
MAINTENANCE = r"(^|\W)(bump|deps?|dependency|chore|build|ci|release)(\W|$)"


def extension(path: Column) -> Column:
    """From the last dot on, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Language by extension; null if unknown."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def is_skipped(path: Column) -> Column:
    """True for vendored, generated and bundled files."""
    out = F.lit(False)
    for fragment in SKIPPED:
        out = out | path.contains(fragment)
    return out


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def code_kind(path: Column) -> Column:
    """``test`` or ``production``."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    rooted, name = F.concat(F.lit("/"), low), _name(low)
    test = rooted.contains("/test/") | rooted.contains("/tests/") | name.startswith("test_") | name.endswith("_test.go") | name.endswith("_test.py")
    return F.when(test, "test").otherwise("production")


def path_class(path: Column) -> Column:
    """``documentation``, ``test`` or ``source``."""
    low = F.lower(path)
    rooted, name = F.concat(F.lit("/"), low), _name(low)
    docs = low.endswith(".md") | low.endswith(".rst") | name.startswith("readme") | name.startswith("changelog")
    test = rooted.contains("/test") | F.concat(rooted, F.lit("/")).contains("/tests/") | name.startswith("test_") | name.endswith("_test.py") | name.endswith("_test.go")
    return F.when(docs, "documentation").when(test, "test").otherwise("source")


def task_class(subject: Column, path: Column) -> Column:
    """The first of bug_fix, documentation, test, refactor, feature, maintenance that fits, else other."""
    both, low = F.lower(F.concat_ws(" ", subject, path)), F.lower(path)
    docs = low.endswith(".md") | low.endswith(".rst") | F.concat(F.lit("/"), low).contains("/docs/")
    return (
        F.when(both.rlike(BUG), "bug_fix")
        .when(docs, "documentation")
        .when(low.rlike(TEST_PATH), "test")
        .when(both.rlike(REFACTOR), "refactor")
        .when(F.lower(subject).rlike(FEATURE), "feature")
        .when(both.rlike(MAINTENANCE), "maintenance")
        .otherwise("other")
    )
