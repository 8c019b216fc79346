import random
import re

from keyloom.llm import licenses

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != d)))
    return row[-1]


def labels(text):
    """Labels of the templates that some run of about as many words resembles, by words."""
    w, found = words(text), set()
    for label, template in licenses.TEMPLATES:
        t = words(template)
        n = len(t)
        best = min((edits(w[i : i + n], t) for i in range(max(1, len(w) - n + 1))), default=n)
        if best <= 0.1 * n:
            found.add(label)
    return found


def test_whole_texts_with_changes_are_found(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choices("bcdfgklmnpqrstvw", k=rng.randint(3, 8))) for _ in range(n))
    rows, want = [], {}
    for k, (label, template) in enumerate(licenses.TEMPLATES):
        w = template.split()
        for i in rng.sample(range(len(w)), max(1, len(w) // 25)):  # a word put in shifts the diagonal, one changed breaks the runs
            w[i] = rng.choice([f"{w[i]} indeed", "other"]) if len(w) > 12 else w[i]
        text = f"{filler(rng.randint(0, 40))} {' '.join(w)} {filler(rng.randint(0, 40))}"
        rows.append((k, text))
        want[k] = label
    rows += [(100 + k, filler(200)) for k in range(5)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, label in want.items():
        assert label in got[k].labels.split(",") and got[k].score >= 0.8, (k, label)
        assert labels(rows[k][1]) <= set(got[k].labels.split(","))
    assert all(got[100 + k].labels == "" and got[100 + k].score == 0 for k in range(5))


def test_a_template_twice_in_a_text(spark):
    text = licenses.TEMPLATES[1][1]
    rows = [(1, f"{text} then some words between the two of them {text}"), (2, " ".join(text.split()[:9]))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].labels == "mit" and got[1].score > 0.99 and got[2].labels == ""
