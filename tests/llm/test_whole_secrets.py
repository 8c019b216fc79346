import time

import numpy as np

from keyloom.llm import automata, secrets
from tests.llm.test_operators import brute_secrets


def spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return secrets.scan_block(data, np.array([0, len(data)])).get(0, [])


def test_many_spans_take_linear_time():
    text = "é " + " ".join(f"{i * 2**90 + 7:032x}" for i in range(31_000))
    began = time.process_time()
    found = spans(text)
    assert len(found) == 31_000 and found[-1][2] == len(text) and time.process_time() - began < 5


def test_a_long_segment_without_a_reset():
    run = "aB3/" * 100_000
    began = time.process_time()
    assert spans(run) == [] and time.process_time() - began < 3
    ((start, kind, end),) = spans(run + "é AKIA" + "Z" * 16)
    assert (start, secrets.RULES[kind].kind, end) == (len(run) + 2, "access", len(run) + 22)


def test_lanes_and_steps_agree(monkeypatch):
    machine, _ = secrets.automaton()
    texts = [("token=abcdefgh12 " * k + "x" * k + "AKIA" + "B" * k) for k in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    seen = []
    for lanes in (0, 7, 1000):
        monkeypatch.setattr(automata, "LANES", lanes)
        seen.append(machine.scan(data, starts, ends).tolist())
    assert seen[0] == seen[1] == seen[2] and any(seen[0])
    assert all(brute_secrets(t) is not None for t in texts[:3])
