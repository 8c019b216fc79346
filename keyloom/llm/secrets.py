"""Secret scans: all rules in one byte pass of a combined deterministic automaton.

Texts are cut at the bytes that lead the automaton back to its start from every state, so no match
crosses a cut; the segments of a block of texts advance together through the transition array. Only
segments in which a rule's tag was seen are looked at again, to settle the exact spans of that rule.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, compile_rules
from .shared import blocks, text_bytes


@dataclass(frozen=True)
class Rule:
    """search: what the automaton finds; span: the exact match; valid: which matches count; base: of the fixed set."""

    kind: str
    search: str
    span: str
    valid: Callable[[re.Match], bool] = lambda m: True
    fold: bool = False
    base: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_SEARCH = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
RULES = (
    Rule("assign", _ASSIGN_SEARCH, _ASSIGN, lambda m: len(m[2]) >= 8, fold=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16, base=True),
    Rule("hex", r"[0-9a-f]{32}", r"[0-9a-f]+", lambda m: len(m[0]) >= 32, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]+", lambda m: len(m[0]) >= 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]", r"xox[abprs]-[A-Za-z0-9-]+", lambda m: len(m[0]) >= 15),
    Rule("google", r"AIza[A-Za-z0-9_-]", r"AIza[A-Za-z0-9_-]+", lambda m: len(m[0]) == 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: len(m[0]) >= 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
_compiled: dict[tuple, tuple[Automaton, list[re.Pattern]]] = {}


def automaton(rules: tuple[Rule, ...] = RULES) -> tuple[Automaton, list[re.Pattern]]:
    key = tuple((r.search, r.span, r.fold) for r in rules)
    if key not in _compiled:
        _compiled[key] = compile_rules([(r.search, r.fold) for r in rules]), [re.compile(r.span.encode(), re.I if r.fold else 0) for r in rules]
    return _compiled[key]


def scan_block(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (start, rule, end) in code points, sorted, of texts that lie back to back in data."""
    machine, exact = automaton(rules)
    # The automaton is at its start after a reset byte, and at the start of a text.
    cuts = np.unique(np.concatenate((np.flatnonzero(machine.resets[data]) + 1, offsets)))
    starts, ends = cuts[:-1], cuts[1:]
    seen = machine.scan(data, starts, ends)
    found: dict[int, list[tuple[int, int, int]]] = {}
    inner = np.flatnonzero(data & 0xC0 == 0x80)  # bytes that begin no code point
    chars = lambda top, end: end - top - int(np.searchsorted(inner, end) - np.searchsorted(inner, top))
    for i in np.flatnonzero(seen).tolist():
        a, b = int(starts[i]), int(ends[i])
        row = int(np.searchsorted(offsets, a, "right")) - 1
        segment = data[a:b].tobytes()
        for k, rule in enumerate(rules):
            if seen[i] >> k & 1:
                for m in exact[k].finditer(segment):
                    if rule.valid(m):
                        top = int(offsets[row])
                        found.setdefault(row, []).append((chars(top, a + m.start()), k, chars(top, a + m.end())))
    return {row: sorted(spans) for row, spans in found.items()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    join = lambda spans: ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans)
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        counts = np.zeros((3, batch.num_rows), np.int64)
        digests, spans_of = [nothing] * batch.num_rows, [""] * batch.num_rows
        for first, last in blocks(offsets):
            low = offsets[first]
            for row, spans in scan_block(data[low : offsets[last]], offsets[first : last + 1] - low).items():
                base = [s for s in spans if RULES[s[1]].base]
                for _, k, _ in base:
                    counts[k, first + row] += 1
                digests[first + row] = hashlib.sha256(join(base).encode()).hexdigest()
                spans_of[first + row] = join(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests), pa.array(spans_of)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row of docs.

    spans lists kind:start:end (code points, end exclusive) by start, then kind in the order of RULES;
    base_sha256 digests the base kinds' list. Null text is empty text: no spans, the digest of nothing.
    Repeated rows and null ids keep their rows; other columns are ignored; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Whole documents table."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
