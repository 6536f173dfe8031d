import pandas as pd
import difflib
import random

import pytest

from sedimenta.operators import lineage
from sedimenta.sources import readers


def states(spark, patch, lines):
    patches = spark.createDataFrame([("r", 1, "c1", patch)], "repository string, position int, commit string, patch string")
    changes = readers.patch_lines(patches, keys=["repository", "position", "commit"], text="patch")
    intro = spark.createDataFrame([("r", f"{p}:{n}", p, n, t, 0) for p, n, t in lines], "repository string, line_id string, path string, line int, text string, position int")
    return {r.line_id: (r.path, r.line, r.state) for r in lineage.replay(intro, changes).collect()}


def diff(path, *hunks):
    return f"--- a/{path}\n+++ b/{path}\n" + "".join(h + "\n" for h in hunks)


def test_own_hunk_comes_first(spark):
    # the text stands twice in the commit, once in the hunk; and a changed line in a commit of many additions
    many = diff("big.py", "@@ -0,0 +1,2500 @@", *[f"+row {k}" for k in range(2500)])
    patch = diff("x.py", "@@ -1,2 +1,2 @@", "-}", "-b = compute(1)", "+b = compute(2)", "+}") + diff("y.py", "@@ -5,0 +6,1 @@", "+}") + many
    got = states(spark, patch, [("x.py", 1, "}"), ("x.py", 2, "b = compute(1)")])
    assert got == {"x.py:1": ("x.py", 2, "unchanged"), "x.py:2": ("x.py", 1, "modified")}


def test_other_hunks_only_if_own_adds_nothing(spark):
    text = "total = first + second"
    gone = diff("x.py", "@@ -1,2 +0,0 @@", f"-{text}", "-import os")
    there = diff("y.py", "@@ -3,0 +4,3 @@", f"+{text}", "+import os", "+import os")
    assert states(spark, gone + there, [("x.py", 1, text), ("x.py", 2, "import os")]) == {"x.py:1": ("y.py", 4, "unchanged"), "x.py:2": ("x.py", 2, "unobservable")}
    many = diff("big.py", "@@ -0,0 +1,2500 @@", *[f"+row {k}" for k in range(2500)])
    assert states(spark, gone + many, [("x.py", 1, text)]) == {"x.py:1": ("x.py", 1, "unobservable")}
    assert states(spark, gone, [("x.py", 1, text)]) == {"x.py:1": ("x.py", 1, "deleted")}
    replaced = diff("x.py", "@@ -1,1 +1,1 @@", f"-{text}", "+pass")
    assert difflib.SequenceMatcher(None, text, "pass").ratio() < lineage.LEAST
    assert states(spark, replaced + there, [("x.py", 1, text)]) == {"x.py:1": ("x.py", 1, "unobservable")}
    file_gone = f"--- a/x.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-{text}\n"
    assert states(spark, file_gone + there, [("x.py", 1, text)])["x.py:1"][2] == "deleted"


def plain(lines, changes):
    """The same rules line by line, commit after commit."""
    live = {k: [p, n, t, "unchanged", since] for k, p, n, t, since in lines}
    out = []
    for position in sorted({c[1] for c in changes}):
        rows = [c for c in changes if c[1] == position]
        new_path = {c[3]: c[4] for c in rows}
        added = [(c[4], c[8], c[9], (c[3], c[5])) for c in rows if c[6] == "added"]
        removed = {(c[3], c[7]): (c[3], c[5]) for c in rows if c[6] == "removed"}
        for key, s in list(live.items()):
            path, n, text, state, since = s
            if since >= position or path not in new_path:
                continue
            hunk, to, fate = removed.get((path, n)), None, None
            if hunk is None:
                n -= sum(1 for p, m in removed if p == path and m < n)
                for m in sorted(a[1] for a in added if a[0] == new_path[path]):
                    n += m <= n
                s[:2] = new_path[path], n
            elif new_path[path] == "/dev/null":
                fate = "deleted"
            else:
                near = [a for a in added if a[3] == hunk] or added
                same = [a for a in near if a[2] == text]
                ratios = sorted(((difflib.SequenceMatcher(None, text.strip(), a[2].strip()).ratio(), a) for a in near), reverse=True)
                if len(same) == 1:
                    to = same[0]
                elif not near:
                    fate = "deleted"
                elif ratios[0][0] >= 0.8 and (len(ratios) == 1 or ratios[0][0] - ratios[1][0] >= 0.1):
                    to, fate = ratios[0][1], "modified"
                else:
                    fate = "unobservable"
            if to:
                s[:3] = to[:3]
            s[3] = fate or state
            out.append((key, position, s[0], s[1], s[3]))
            if fate in ("deleted", "unobservable"):
                del live[key]
    return out


def history(seed, commits=25):
    """Random edits of real files: replaced, removed, inserted and moved runs of lines, renames, files that go."""
    rng = random.Random(seed)
    words = ["total", "count", "value", "index", "first", "second", "return", "import"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 6))) + f" = {rng.randint(0, 400)}"
    files = {f"f{i}.py": [make() if rng.random() < 0.9 else "}" for _ in range(rng.randint(5, 30))] for i in range(4)}
    start = [(f"{p}:{i}", p, i + 1, t, 0) for p, ls in files.items() for i, t in enumerate(ls)]
    changes, loose = [], []
    for position in range(1, commits):
        for path in rng.sample(sorted(files), k=min(len(files), rng.randint(1, 3))):
            old, new, hunk, o = files.pop(path), [], 0, 0
            to = "/dev/null" if rng.random() < 0.03 else f"r{position}_{len(changes)}.py" if rng.random() < 0.15 else path
            rows = []
            if to == "/dev/null":
                rows = [("removed", 1, i + 1, None, t) for i, t in enumerate(old)]
                o = len(old)
            while o < len(old) or (o == len(old) and rng.random() < 0.2):
                if rng.random() < 0.75 and o < len(old):
                    new.append(old[o])
                    o += 1
                    continue
                hunk += 1
                gone = old[o : o + rng.randint(0, 3)]
                kind = rng.random()
                if kind < 0.35:
                    made = [t.replace("=", "= 1 +") if rng.random() < 0.7 else make() for t in gone]
                elif kind < 0.55:
                    made = gone[::-1] + ([gone[0]] if gone and rng.random() < 0.4 else [])
                elif kind < 0.8:
                    made, loose = [], loose + gone
                else:
                    made = [make()] + loose[:2]
                    loose = loose[2:]
                rows += [("removed", hunk, o + i + 1, None, t) for i, t in enumerate(gone)]
                rows += [("added", hunk, None, len(new) + i + 1, t) for i, t in enumerate(made)]
                new, o = new + made, o + len(gone)
                if not gone and o == len(old):
                    break
            if rows:
                changes += [("r", position, f"c{position}", path, to, h, kind, a, b, t) for kind, h, a, b, t in rows]
                if to != "/dev/null":
                    files[to] = new
            else:
                files[path] = new
        if not files:
            break
    return start, changes


@pytest.mark.parametrize("many", [False, True])
def test_random_histories_equal_the_plain_fold(spark, monkeypatch, many):
    if many:  # every file and every scope in several tasks
        monkeypatch.setattr(lineage, "FILE_LINES", 3)
        monkeypatch.setattr(lineage, "PAIRS", 4)
    intro, diffs, want = [], [], set()
    for seed in range(6):
        lines, changes = history(seed)
        intro += [(f"r{seed}", *x) for x in lines]
        diffs += [(f"r{seed}", *x[1:]) for x in changes]
        want |= {(f"r{seed}", *x) for x in plain(lines, changes)}
    lines = spark.createDataFrame(intro, "repository string, line_id string, path string, line int, text string, position int")
    changes = spark.createDataFrame(diffs, "repository string, position int, commit string, old_path string, path string, hunk int, kind string, old_line int, new_line int, text string")
    got = lineage.replay(lines, changes)
    rows = {(r.repository, r.line_id, r.position, r.path, r.line, r.state) for r in got.collect()}
    assert rows == want
    assert {"unchanged", "modified", "unobservable", "deleted"} == {r[5] for r in rows} and got.count() == len(want)
    assert len({(r[0], r[1]) for r in rows if not r[3].startswith(r[1].split(":")[0])}) > 20
    assert lineage.replay(lines.limit(0), changes).count() == 0 and lineage.replay(lines, changes.limit(0)).count() == 0


def test_many_files_travel_together():
    files = [{"repository": f"r{i}", "path": "a", "lines": [{"line_id": "l", "line": 2, "since": 0, "state": "unchanged"}], "changes": [{"position": 1, "commit": "c", "path": "a", "removed": None, "added": [1]}]} for i in range(3)]
    (out,) = lineage._advanced(iter([pd.DataFrame(files)]))
    assert out[["repository", "line", "moved"]].values.tolist() == [[f"r{i}", 3, False] for i in range(3)]
