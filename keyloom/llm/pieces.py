"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model compiles to a transducer from characters to pieces. Its states are those of a trie over the
pieces, with the normaliser composed in (an arc reads a space where a piece has U+2581); a state that
completes a piece has an arc back to the start that puts the piece out, and characters without a piece
have one that puts out byte pieces. Composed with an input this is a lattice whose arcs are the pieces
that stand at its positions, and the encoding is the shortest path in the tropical semiring (weights
add along a path, the least counts).

An arc's weight depends on the arc before, so lattice states are a position and the last arc. A model
of the unigram kind has a weight for each piece. One of the BPE kind merges in the order of ranks, and
its result is not the path of best scores; a path is that result exactly where each two neighbouring
pieces are the result for their joined text. Arcs weigh 0 after a piece that they fit to and infinity
after others, which leaves one path of finite weight. Whether two pieces fit is read off their
derivations.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model file where the setting spark.keyloom.pieces.model names none.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Pieces of text that a worker remembers, and the longest that it does; both bound its memory only.
REMEMBERED, LONGEST = 400_000, 40
#: The same for beginnings of HEAD characters, and for pairs of pieces.
HEAD, HEADS, FITS = 8, 150_000, 500_000
#: Weight of a character in byte pieces.
FALLBACK = 1e3
_NEVER, _INFINITE = 1 << 60, float("inf")


def shortest_path(lattice: list[list[tuple[int, int]]], weigh: Callable[[int | None, int], float]) -> tuple[float, list[int]]:
    """Weight and labels of the lightest path through a lattice (of equals the first found; none: infinity).

    lattice: by position from 1 on, the arcs (position where it begins, label) that end there; weigh: the
    weight of an arc, by the label before (None at the start) and its own."""
    best: list[dict[int | None, tuple[float, int, int | None]]] = [{None: (0.0, 0, None)}]
    for arcs in lattice:
        states: dict[int | None, tuple[float, int, int | None]] = {}
        for begin, label in arcs:
            for before, (cost, _, _) in best[begin].items():
                total = cost + weigh(before, label)
                if total < _INFINITE and (label not in states or total < states[label][0]):
                    states[label] = (total, begin, before)
        best.append(states)
    at, path = len(lattice), []
    if not best[at]:
        return _INFINITE, []
    label = min(best[at], key=lambda k: best[at][k][0])
    weight = best[at][label][0]
    while at:
        path.append(label)
        _, at, label = best[at][label]
    return weight, path[::-1]


@dataclass
class Transducer:
    """pieces: text to (id, rank), the lowest rank merged first; fallback: ids of the 256 byte pieces; texts: bytes by id;
    digest: of the model file; weights: by id, for a model of the unigram kind."""

    pieces: dict[str, tuple[int, int]]
    fallback: list[int]
    texts: list[bytes]
    digest: str = ""
    weights: dict[int, float] | None = None
    _fits: dict[int, float] = field(default_factory=dict)
    _spines: dict[str, tuple[list, list]] = field(default_factory=dict)
    _known: dict[str, bytes] = field(default_factory=dict)
    _older: dict[str, bytes] = field(default_factory=dict)
    _heads: dict[str, tuple[list[int], list[int]]] = field(default_factory=dict)

    def __getstate__(self) -> tuple:
        return self.pieces, self.fallback, self.texts, self.digest, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @cached_property
    def units(self) -> re.Pattern:
        """Cuts where no piece reaches across: before a word's spaces, and around line ends without a piece."""
        if self.weights is not None or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces):
            return re.compile(r"(?s).+")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.pieces))
        return re.compile((f"[{alone}]|" if alone else "") + f"[ {SPACE}]*[^ {SPACE}{alone}]+|[ {SPACE}]+")

    def spines(self, piece: str) -> tuple[list, list]:
        """The derivation of a piece: (part, time made) along its right edge and along its left edge, from the last or first character up."""
        if piece not in self._spines:
            parts = [(c, -1, None, None) for c in piece]
            while len(parts) > 1:
                rank, at = min((self.pieces.get(a[0] + b[0], (0, _NEVER))[1], i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == _NEVER:
                    break
                a, b = parts[at], parts[at + 1]
                parts[at : at + 2] = [(a[0] + b[0], max(rank, a[1], b[1]), a, b)]
            edges = []
            for side in (3, 2):
                node, edge = parts[-1 if side == 3 else 0], []
                while node is not None:
                    edge.append((node[0], node[1]))
                    node = node[side]
                edges.append(edge[::-1])
            self._spines[piece] = (edges[0], edges[1]) if len(parts) == 1 else ([], [])
        return self._spines[piece]

    def fits(self, left: str, right: str) -> bool:
        """If merging left + right gives the two pieces: no part of the one merges with a part of the other before either grows."""
        x, y = self.spines(left)[0], self.spines(right)[1]
        if not (x and y):
            return False
        i = j = 0
        while True:
            grow_x = x[i + 1][1] if i + 1 < len(x) else _NEVER
            grow_y = y[j + 1][1] if j + 1 < len(y) else _NEVER
            met = self.pieces.get(x[i][0] + y[j][0])
            if met and met[1] < grow_x and met[1] <= grow_y:  # of equal ranks the leftmost goes first
                return False
            if grow_x == _NEVER and grow_y == _NEVER:
                return True
            if grow_x <= grow_y:
                i += 1
            else:
                j += 1

    @cached_property
    def states(self) -> list[tuple[dict[str, int], int]]:
        """By state: its arcs (character to state), and the piece that it completes or -1. State 0 is the start. Pieces
        are read from their last character to the first: a lattice is made position by position, as the text goes on."""
        states: list[tuple[dict[str, int], int]] = [({}, -1)]
        for piece, (number, _) in self.pieces.items():
            at = 0
            for c in reversed(piece):
                if c not in states[at][0]:
                    states[at][0][c] = len(states)
                    states.append(({}, -1))
                at = states[at][0][c]
            states[at] = (states[at][0], number)
        for arcs, _ in states:  # the normaliser: a space reads as U+2581
            if SPACE in arcs:
                arcs[" "] = arcs[SPACE]
        return states

    @cached_property
    def names(self) -> dict[int, str]:
        return {number: piece for piece, (number, _) in self.pieces.items()}

    def arcs(self, unit: str, end: int) -> list[tuple[int, int]]:
        """The lattice's arcs (begin, label) that end at a position of unit, the shortest first. A label is a piece's id,
        or for a character in byte pieces - 1 - its code point."""
        states, begin, found = self.states, end - 1, []
        here = states[0][0].get(unit[begin])
        if here is None or states[here][1] < 0:
            found.append((begin, -1 - ord(unit[begin])))
        while here is not None:
            arcs, piece = states[here]
            if piece >= 0:
                found.append((begin, piece))
            if not begin:
                break
            begin -= 1
            here = arcs.get(unit[begin])
        return found

    def compose(self, unit: str) -> list[list[tuple[int, int]]]:
        """The lattice of unit: the arcs by the position where they end, from 1 on."""
        return [self.arcs(unit, end) for end in range(1, len(unit) + 1)]

    def weigh(self, before: int | None, label: int) -> float:
        """Weight of an arc after the arc before."""
        if label < 0:
            return FALLBACK
        if self.weights is not None:
            return self.weights[label]
        if before is None or before < 0:
            return 0.0
        weight = self._fits.get(before << 32 | label)
        if weight is None:
            if len(self._fits) >= FITS:
                self._fits.clear()
            weight = self._fits[before << 32 | label] = 0.0 if self.fits(self.names[before], self.names[label]) else _INFINITE
        return weight

    def only_path(self, unit: str) -> list[int]:
        """What shortest_path gives where weights are 0 and infinity and each beginning of unit has one path of finite weight:
        its last arc is the first that fits. Units that begin alike share the paths of their first HEAD characters."""
        head = unit[:HEAD]
        known = self._heads.get(head)
        last, begin = (known[0][:], known[1][:]) if known else ([-1], [0])
        weights, arcs_of = self._fits, self.arcs
        for end in range(len(last), len(unit) + 1):
            if end == HEAD + 1 and not known:
                if len(self._heads) >= HEADS:
                    self._heads.clear()
                self._heads[head] = last[:], begin[:]
            arcs = arcs_of(unit, end)
            while True:
                at, label = arcs.pop()
                before = last[at]
                if label < 0 or before < 0:
                    break
                weight = weights.get(before << 32 | label)
                if weight is None:
                    weight = self.weigh(before, label)
                if not weight:
                    break
            last.append(label)
            begin.append(at)
        path, at = [], len(unit)
        while at:
            path.append(last[at])
            at = begin[at]
        return path[::-1]

    def shortest(self, unit: str) -> bytes:
        """Ids (4 bytes each, little-endian) of the shortest path through the lattice of unit."""
        path = self.only_path(unit) if self.weights is None else shortest_path(self.compose(unit), self.weigh)[1]
        if min(path) < 0:
            path = [i for label in path for i in ([label] if label >= 0 else [self.fallback[b] for b in chr(-1 - label).encode()])]
        return array("i", path).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        out, known, older = [], self._known, self._older
        for unit in self.units.findall(" " + text):  # the normaliser puts a space before
            ids = known.get(unit)
            if ids is None:
                ids = older.get(unit)
                if ids is None:
                    ids = self.shortest(unit)
                if len(unit) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known, older = self._known, self._older = {}, known
                    known[unit] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids) -> str:
        """Text of ids: byte pieces joined (bytes that are no UTF-8 give U+FFFD), without the leading space."""
        texts = self.texts
        return b"".join([texts[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_resident: dict[str, Transducer] = {}


def resident(machine: Transducer) -> Transducer:
    """The worker's own copy, which remembers what earlier tasks have met."""
    if machine.digest not in _resident:
        _resident.clear()
        _resident[machine.digest] = machine
    return _resident[machine.digest]


def load(path: str = MODEL) -> Transducer:
    """Compiles a SentencePiece BPE model file with the identity normaliser."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {i: model.get_score(i) for i in normal}
    ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
    name = [model.id_to_piece(i) for i in range(n)]
    fallback = {int(name[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
    texts = [bytes([int(name[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else name[i].replace(SPACE, " ").encode() for i in range(n)]
    if model.encode("  a ﬁ", out_type=str) != model.encode("  a", out_type=str) + model.encode(" ﬁ", out_type=str)[1:]:
        raise ValueError("the model's normaliser is not the identity")
    return Transducer({name[i]: (i, ranks[score[i]]) for i in normal}, [fallback.get(b, model.unk_id()) for b in range(256)], texts, hashlib.sha256(model.serialized_model_proto()).hexdigest())


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte pieces), ids_sha256 (of the ids as 4 bytes each, little-endian) and
    round_trip (decoding gives the text back, U+2581 read as a space), with ids on demand.

    Null and empty texts have no tokens, and round_trip is true. Repeated rows and null ids keep their
    rows; other columns are ignored; an empty table gives an empty result.
    """
    compiled = load(path or docs.sparkSession.conf.get("spark.keyloom.pieces.model", MODEL))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keyloom.llm.pieces import resident as kept  # by import: the function itself is sent by value

        machine = kept(compiled)
        bytes_ids = np.zeros(len(machine.texts), bool)
        bytes_ids[machine.fallback] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                count, fallen, digest, same, ids = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    found = machine.encode(text)
                    count.append(len(found))
                    fallen.append(int(bytes_ids[found].sum()))
                    digest.append(hashlib.sha256(found.tobytes()).hexdigest())
                    same.append(machine.decode(found.tolist()) == text.replace(SPACE, " "))
                    if with_ids:
                        ids.append(found)
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(fallen, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())]
                names = ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "round_trip"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    out = "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(coded, out)


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    """Whole documents table."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
