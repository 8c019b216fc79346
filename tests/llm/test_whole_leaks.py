import random

import numpy as np

from keyloom.llm import decontaminate


def edited(rng, text, rate, alphabet):
    chars = list(text)
    for i in sorted(rng.sample(range(len(text)), int(rate * len(text))), reverse=True):
        chars[i : i + 1] = rng.choice([[], [rng.choice(alphabet)], [chars[i], rng.choice(alphabet)]])
    return "".join(chars)


def test_copies_in_text_without_spaces():
    rng = random.Random(1)
    for alphabet in ("abcdefghijklmnop(){};=", "".join(map(chr, range(0x4E00, 0x4E80)))):
        items = ["".join(rng.choices(alphabet, k=100)) for _ in range(40)]
        around = lambda: "".join(rng.choices(alphabet, k=90))
        for rate, least in ((0, 40), (0.1, 38)):
            docs = [around() + edited(rng, x, rate, alphabet) + around() for x in items]
            data = [x.encode() for x in docs]
            got = decontaminate.find(decontaminate.build(list(enumerate(items))), np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
            assert len({f[:2] for f in got if f[0] == f[1]}) >= least


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))


def test_recall_by_length():
    rng = random.Random(2)
    for size in (8, 20, 34, 45, 60, 70, 90, 120, 150):
        items = [prose(rng, 60)[:size].strip().ljust(size, "x") for _ in range(60)]
        index = decontaminate.build(list(enumerate(items)))
        for rate in (0.1, 0.19):
            docs = [f"{prose(rng, 20)} {edited(rng, x, rate, 'abcdef ')} {prose(rng, 20)}" for x in items]
            close = [decontaminate.best_alignment(index.texts[k], decontaminate.normal(x).decode())[0] <= 0.2 * size for k, x in enumerate(docs)]
            data = np.frombuffer("".join(docs).encode(), np.uint8)
            got = {f[:2] for f in decontaminate.find(index, data, np.cumsum([0, *map(len, docs)]))}
            hit, total = sum((k, k) in got for k in range(len(docs)) if close[k]), sum(close)
            print(size, rate, hit, total)
            assert total > 30 and hit >= 0.9 * total


def test_short_items_everywhere():
    rng = random.Random(3)
    doc = prose(rng, 160)
    points = np.frombuffer(doc.encode("utf-32-le"), np.uint32)
    for m in (1, 9, 31, 64):
        item = edited(rng, doc[505 : 505 + m], 0.15, "abc")[:64] or "e"
        most = int(0.2 * len(item))
        want = [e for e in range(1, len(doc) + 1) if min(_prefix(item, doc[max(0, e - m - most - 2) : e])) <= most]
        assert decontaminate.near_ends(np.frombuffer(item.encode("utf-32-le"), np.uint32), points, most).tolist() == want


def _prefix(item, text):
    """Edit distances of item to the suffixes of text."""
    row = list(range(len(text) + 1))
    for i, c in enumerate(item[::-1], 1):
        last, row = row, [i]
        for j, t in enumerate(text[::-1], 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (c != t)))
    return row
