import itertools
import random

import pyarrow.parquet as pq
import sentencepiece

from keyloom.llm import pieces


def paths(lattice, at):
    """All paths to a position, as lists of labels."""
    if at == 0:
        yield []
        return
    for begin, label in lattice[at - 1]:
        for path in paths(lattice, begin):
            yield [*path, label]


def test_shortest_path_is_the_lightest_of_all():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 6)
        lattice = [[(rng.randrange(at), rng.randrange(5)) for _ in range(rng.randint(0, 4))] for at in range(1, n + 1)]
        table = {(a, b): rng.choice([0.0, 1.0, 2.5, float("inf")]) for a in [None, *range(5)] for b in range(5)}
        weight, path = pieces.shortest_path(lattice, lambda a, b: table[a, b])
        total = lambda p: sum(table[a, b] for a, b in zip([None, *p], p))  # noqa: B023, E731
        assert weight == min(map(total, paths(lattice, n)), default=float("inf"))
        assert weight == float("inf") or (path in list(paths(lattice, n)) and total(path) == weight)


def test_composition_has_an_arc_for_every_piece():
    machine = pieces.load()
    for unit in (" the", "▁▁ é\n", "日本語😀 x", "<s>"):
        want = [[(a, machine.pieces[p][0]) for a in range(b) if (p := unit[a:b].replace(" ", "▁")) in machine.pieces] for b in range(1, len(unit) + 1)]
        want = [arcs + ([(i, -1 - ord(unit[i]))] if unit[i].replace(" ", "▁") not in machine.pieces else []) for i, arcs in enumerate(want)]
        assert [sorted(x) for x in machine.compose(unit)] == [sorted(x) for x in want]


def merged(machine, text):
    """Merging by rank, the leftmost of equal ranks first."""
    parts = list(text)
    while True:
        ranked = [(machine.pieces[a + b][1], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in machine.pieces]
        if not ranked:
            return parts
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_one_path_of_finite_weight_and_it_is_what_merging_gives():
    machine = pieces.load()
    for word in ("▁tokenization", "▁aaaa", "▁▁▁▁▁", "ababab", "▁Zürich"):
        lattice = machine.compose(word)
        finite = [p for p in paths(lattice, len(word)) if sum(machine.weigh(a, b) for a, b in zip([None, *p], p)) < float("inf")]
        assert [[machine.names[i] for i in p] for p in finite] == [merged(machine, word)]
        assert pieces.shortest_path(lattice, machine.weigh) == (0.0, finite[0]) and machine.only_path(word) == finite[0]


def test_only_path_is_the_shortest():
    rng, machine = random.Random(4), pieces.load()
    for _ in range(2000):
        unit = "".join(rng.choices(" thenaigzé日\n😀", k=rng.randint(1, 14)))
        weight, path = pieces.shortest_path(machine.compose(unit), machine.weigh)
        assert machine.only_path(unit) == path and weight < float("inf")


def test_weights_of_pieces():
    rng = random.Random(2)
    names = [chr(b) for b in range(97, 101)] + ["".join(rng.choices("abcd", k=rng.randint(2, 4))) for _ in range(20)] + ["▁", "▁a"]
    names = list(dict.fromkeys(names))
    machine = pieces.Transducer({p: (i, 0) for i, p in enumerate(names)}, list(range(1000, 1256)), [], "toy", {i: rng.random() * len(p) ** 0.5 for i, p in enumerate(names)})
    for _ in range(30):
        text = "".join(rng.choices("abcd x", k=8))
        lattice = machine.compose(" " + text)
        cost = lambda p: sum(pieces.FALLBACK if i < 0 else machine.weights[i] for i in p)
        best = min(paths(lattice, len(text) + 1), key=cost)
        assert machine.encode(text).tolist() == [i if i >= 0 else 1000 + ord("x") for i in best]


def test_whole_table_like_the_library(sf):
    library, machine = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load()
    for text in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        assert machine.encode(text).tolist() == library.encode(text)
