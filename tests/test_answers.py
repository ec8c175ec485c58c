"""Questions meet all units of their package; what the first units score leaves few rows from the others."""

import random
import re

import pytest

from factloom.operators import answers


@pytest.mark.parametrize("flagged", [1, 256])
def test_only_units_that_can_be_best_leave_a_cell(spark, monkeypatch, flagged):
    """Against brute force, with unequal weights, ties, short questions and words of all frequencies; before, each cell gave a row for each question."""
    source = random.Random(3)
    words = [f"w{i:03d}" for i in range(300)]
    text = lambda most: " ".join(words[int(len(words) * source.random() ** 2)] for _ in range(source.randint(1, most)))
    units = [(p, i, source.choice([1.1, 1.2, 1.4, 1.5]), text(source.choice([4, 30, 120]))) for p in "ab" for i in range(400 if p == "a" else 12)]
    units += [("a", 1000 - i, 1.5, units[i][3]) for i in range(40)] + [("a", 2000, 9.0, None), ("c", 1, 1.2, "w001 w002")]
    questions = [(p, i, text(30)) for p in "ab" for i in range(120)] + [("a", 500, "w299"), ("a", 501, "unheard of"), ("a", 502, ""), ("a", 503, None), ("d", 1, "w001")]
    for name, value in (("CELL_UNITS", 64), ("LEAST_UNITS", 16), ("CELL_QUESTIONS", 50), ("FIRST_QUESTIONS", 30), ("SLICE", 20), ("PAIRS", 300), ("FLAGGED", flagged)):
        monkeypatch.setattr(answers, name, value)
    frames = spark.createDataFrame(questions, "package_id string, question_id long, question string"), spark.createDataFrame(units, "package_id string, ord long, weight double, text string")
    found = {(r["package_id"], r["question_id"]): (r["ord"], r["overlap"], r["score"]) for r in answers.best_units(*frames).collect()}
    said = lambda t: set(re.findall("[a-z0-9]{3,}", t or ""))
    wanted = {}
    for p, i, question in questions:
        shared = [(len(said(question) & said(t)), w, o) for package, o, w, t in units if package == p]
        best = max(((n * w, -o, n) for n, w, o in shared if n), default=None)
        if best:
            wanted[p, i] = (-best[1], best[2], best[0])
    assert found == wanted
    first, better = answers.best_parts(*frames)
    n_blocks = 440 // 24
    assert first.count() == sum(bool(said(q)) for _, _, q in questions)
    assert 0 < better.count() < 120 * n_blocks / 4
