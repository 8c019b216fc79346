import random

import numpy as np

from keyloom.llm import toxicity


def test_every_word_of_the_lexicon_has_its_tolerance():
    rng = random.Random(5)
    plain = ["lorem", "ipsum", "dolor", "amet", "consectetur", "elit", "sed", "tempor"]
    bad = ["".join(rng.choices("bcdfghjkvwxz", k=10)) for _ in range(100)]
    texts = [" ".join(rng.choices(plain, k=30)) for _ in range(200)] + [" ".join([*rng.choices(plain, k=20), *(bad[(8 * i + j) % 100] for j in range(8))]) for i in range(150)]
    model = toxicity.learn(texts, [0] * 200 + [1] * 150)
    b = toxicity.cut([x[:4] + "q" + x[5:] for x in bad])
    assert len(model.lexicon.hits(b)[0]) == len(bad)


def quoted(text):
    b = toxicity.cut([text.lower(), text.lower()])
    at = [int(a) for a, z in zip(b.starts, b.ends) if b.points[a:z].tobytes().decode("utf-32-le") == "vile"]
    one, two = toxicity.in_quotes(b, np.array(at)).tolist()
    assert one == two
    return one


def test_quotation_marks_are_paired_on_their_line():
    for text in ('he said "vile things" today', 'a 5" disk, he said "vile" now', "he said 'vile' now", "« vile » oui", "»vile« ja", "„vile“ ja", "“vile” yes", "‘vile’ yes", 'said ("vile").'):
        assert quoted(text), text
    for text in ("vile", 'a 5" disk, vile, and 7" more', "don't be vile, it's bad", '"vile', 'x" vile "y', '"line\nvile"', '"a" vile "b"', "the dogs' vile cats' "):
        assert not quoted(text), text


def test_an_inch_mark_changes_no_score():
    rng = random.Random(6)
    plain = ["lorem", "ipsum", "dolor", "amet", "consectetur", "elit", "sed", "tempor"]
    texts = [" ".join(rng.choices(plain, k=30)) for _ in range(200)] + [" ".join([*rng.choices(plain, k=20), "disgusting", "repulsive"]) for _ in range(150)]
    model = toxicity.learn(texts, [0] * 200 + [1] * 150)
    score = lambda t: float(model.score([t])[0])
    assert score('a 5" disk lorem "disgusting" ipsum') == score('a 5x disk lorem "disgusting" ipsum') < score("a 5x disk lorem disgusting ipsum")


def slow(lexicon, text, most=8):
    """The features of a text, word by word."""
    b = toxicity.cut([text])
    words = [b.points[a:z].tobytes().decode("utf-32-le") for a, z in zip(b.starts, b.ends)]
    at, weight, state = (x.tolist() for x in lexicon.hits(b))
    marks = toxicity.in_quotes(b, b.starts[at]).tolist() if at else []
    seen, values, cited = set(), [], 0
    for i, w, s, q in zip(at, weight, state, marks):
        q = q and not set(words[max(0, i - most) : i + most + 1]) & toxicity.ADDRESS
        values.append(w * (0.25 if s in seen else 1.0) * (0.25 if q else 1.0))
        seen.add(s)
        cited += q
    dense = max((sum(v for j, v in zip(at, values) if i <= j <= i + 2 * most) for i in at), default=0.0)
    total = sum(values)
    return [np.log1p(total), 10 * total / (len(words) + 20), np.log1p(dense), np.log1p(cited), max(values, default=0.0)]


def test_features_match_a_slow_version():
    rng = random.Random(7)
    lexicon = toxicity.build([("disgusting", False, 2.0, 2), ("vile", False, 1.5, 1), ("scum", True, 1.0, 0), ("idiot", False, 1.2, 1)])
    vocabulary = ["disgusting", "disgustin", "vile", "vlie", "vil", "scumbag", "idiot", "idiots", "you", "the", "cat", "sat", "on", '"', '"vile', 'vile"', "\n", "a", "5\""]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(300)]
    assert np.allclose(toxicity.features(lexicon, texts), [slow(lexicon, t) for t in texts])
