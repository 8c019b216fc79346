"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon (words, and word beginnings) and the weights are learned from a bounded sample of labelled
rows. The trie's states and the error counts of a Levenshtein automaton form one product automaton,
made deterministic and laid out as an array; the words of many texts run through it side by side. A
hit within a quotation that addresses nobody counts less; hits that stand together count more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

#: Labelled rows, and bytes of their texts, that the lexicon and the weights are learned from, at most.
TRAIN_ROWS, TRAIN_BYTES = 8_000, 96 << 20
FOLDS, HELD_OUT = 5, 0
LEXICON, LEAST_DOCS, LEAST_LIFT = 400, 4, 8.0
PREFIX = range(5, 9)
N_FEATURES = 5
#: Weight of a hit in a quotation, of each misspelling, and of a word seen before in its text.
CONTEXT, QUOTED, MISSPELLED, REPEATED = 8, 0.25, 0.8, 0.25
#: Who a remark is addressed to.
ADDRESS = frozenset("you your yours you're du dich dein deine tu toi vous ton ta usted tú te".split())
_WORD = np.ones(0x110000, bool)
_WORD[:0x3000] = [chr(i).isalnum() for i in range(0x3000)]
_WORD[0x3000:0x3040] = False
#: Marks of quotation by family.
_QUOTES = [[ord(c) for c in "\"“”„"], [ord(c) for c in "«»"], [ord(c) for c in "'‘’‚"]]
_OPENS, _CLOSES = [ord(c) for c in "„‚‘"], [ord("”")]


@dataclass
class Block:
    """Words of some texts: code points, start and end of each word, its text, number of words by text, first code point of each text."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    count: np.ndarray
    tops: np.ndarray


def cut(texts: list[str]) -> Block:
    """Lower-cased texts cut into words of letters and digits."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    tops = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    word = _WORD[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[tops] = True
    cuts = np.flatnonzero(edge)
    kind = word[cuts[:-1]] if len(points) else np.zeros(0, bool)
    starts, ends = cuts[:-1][kind], cuts[1:][kind]
    row = np.searchsorted(tops, starts, "right") - 1
    return Block(points, starts, ends, row, np.bincount(row, minlength=len(texts)), tops)


@dataclass
class Lexicon:
    """The product automaton: classes of code points, transitions, and per state the weight of what it accepts and if that is misspelled; tail: reached by word beginnings, whatever follows."""

    classes: np.ndarray
    table: np.ndarray
    weight: np.ndarray
    errors: np.ndarray
    tail: np.ndarray
    dead: int

    def hits(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, weight, state) of the words that it accepts, in order; misspelled ones have errors[state] > 0."""
        live = np.arange(len(b.starts))
        length, state = b.ends - b.starts, np.full(len(live), 0, np.int32)
        symbols = self.classes[b.points]
        done_w, done_s, j = [], [], 0
        while live.size:
            over = (length[live] == j) | self.tail[state]
            if over.any():
                done_w.append(live[over])
                done_s.append(state[over])
                live, state = live[~over], state[~over]
            state = self.table[state, symbols[b.starts[live] + j]]
            keep = state != self.dead
            live, state = live[keep], state[keep]
            j += 1
        if not done_w:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)
        w, s = np.concatenate(done_w), np.concatenate(done_s)
        ok = self.weight[s] > 0
        w, s = w[ok], s[ok]
        order = np.argsort(w, kind="stable")
        return w[order], self.weight[s[order]], s[order]


def build(entries: list[tuple[str, bool, float, int]]) -> Lexicon:
    """entries: (text, is a beginning, weight, errors allowed)."""
    child, end, allowed = [{}], [[]], [0]
    for k, (text, _, _, most) in enumerate(entries):
        node = 0
        allowed[0] = max(allowed[0], most)
        for c in text:
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
                end.append([])
                allowed.append(0)
            node = child[node][c]
            allowed[node] = max(allowed[node], most)
        end[node].append(k)
    alphabet = {c: i + 1 for i, c in enumerate(sorted({c for e in entries for c in e[0]}))}
    classes = np.zeros(0x110000, np.int32)
    for c, i in alphabet.items():
        classes[ord(c)] = i

    def close(states: dict[int, int]) -> tuple:
        """Left-out letters: a child with one more error. Keeps the least errors of each node."""
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            for c in child[node].values():
                if e + 1 <= allowed[c] and states.get(c, 99) > e + 1:
                    states[c] = e + 1
                    todo.append((c, e + 1))
        return tuple(sorted(states.items()))

    first = close({0: 0})
    number, queue, rows = {first: 0, (): 1}, [first, ()], []
    for current in queue:  # grows while it runs
        loose: dict[int, int] = {}  # what any symbol leads to: an added letter, or another letter instead
        for node, e in current:
            for c in [node, *child[node].values()]:
                if e + 1 <= allowed[c]:
                    loose[c] = min(loose.get(c, 99), e + 1)
        base = close(dict(loose))
        number.setdefault(base, len(number)) == len(queue) and queue.append(base)
        row = [number[base]] * (len(alphabet) + 1)
        for c in {c for node, _ in current for c in child[node]}:
            after = dict(loose)
            for node, e in current:
                if c in child[node]:
                    after[child[node][c]] = min(after.get(child[node][c], 99), e)
            made = close(after)
            number.setdefault(made, len(number)) == len(queue) and queue.append(made)
            row[alphabet[c]] = number[made]
        rows.append(row)
    weight, errors, tail = np.zeros(len(queue)), np.zeros(len(queue), np.int32), np.zeros(len(queue), bool)
    for s, current in enumerate(queue):
        best = [(e, -entries[k][2], k) for node, e in current for k in end[node] if e <= entries[k][3]]
        if best:
            e, w, _ = min(best)
            weight[s], errors[s] = -w * MISSPELLED**e, e
            tail[s] = any(entries[k][1] and e == 0 for e, _, k in best)
    return Lexicon(classes, np.array(rows, np.int32), weight, errors, tail, 1)


def in_quotes(b: Block, at: np.ndarray) -> np.ndarray:
    """Which places stand between an opening and a closing mark of one line.

    A mark opens after white space or an opening bracket and closes before it or punctuation, where its form
    doesn't say; an apostrophe or an inch mark does neither. Of a family's marks two neighbours make a pair."""
    points, n = b.points, len(b.points)
    inside = np.zeros(len(at), bool)
    breaks = np.unique(np.concatenate((np.flatnonzero(points == 10), b.tops)))
    for family in _QUOTES:
        marks = np.flatnonzero(np.isin(points, family))
        if not len(marks):
            continue
        before = np.where(marks > 0, points[np.maximum(marks - 1, 0)], 32)
        after = np.where(marks + 1 < n, points[np.minimum(marks + 1, n - 1)], 32)
        top, end = np.isin(marks, b.tops), np.isin(marks + 1, b.tops)
        free_before, free_after = top | (before <= 32) | np.isin(before, (40, 91, 123)), end | (after <= 32) | ~_WORD[after]
        kind = np.where(free_before & ~(end | (after <= 32)), 1, np.where(~free_before & free_after, -1, 0))
        own = points[marks]
        kind = np.where(np.isin(own, _OPENS) & ~(~free_before & free_after), 1, np.where(np.isin(own, _CLOSES), -1, kind))
        if family is _QUOTES[1]:  # « mot », and »Wort«
            kind = np.where(kind == 0, np.where(own == 171, 1, -1), kind)
        else:
            kind[(own == 34) & (kind == -1) & (before >= 48) & (before <= 57) & (np.concatenate(([0], kind[:-1])) != 1)] = 0
        marks, kind = marks[kind != 0], kind[kind != 0]
        line = np.searchsorted(breaks, marks, "right")
        pair = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == -1) & (line[:-1] == line[1:]))
        if len(pair):
            first, stop = marks[pair], marks[pair + 1]
            k = np.searchsorted(first, at, "right") - 1
            inside |= (k >= 0) & (stop[np.maximum(k, 0)] > at)
    return inside


def features(lexicon: Lexicon, texts: list[str]) -> np.ndarray:
    """Per text: weight of the hits in context, the same by length, densest context window, quoted hits, heaviest hit."""
    b = cut(texts)
    n = len(texts)
    word, weight, state = lexicon.hits(b)
    row = b.row[word]
    factor = np.full(len(word), REPEATED)
    factor[np.unique(row * len(lexicon.weight) + state, return_index=True)[1]] = 1.0
    quoted = np.zeros(len(word), bool)
    if len(word):
        last = len(b.starts) - 1
        inside = in_quotes(b, b.starts[word])
        for i in np.flatnonzero(inside).tolist():
            around = range(max(0, int(word[i]) - CONTEXT), min(last, int(word[i]) + CONTEXT) + 1)
            said = {b.points[b.starts[k] : b.ends[k]].tobytes().decode("utf-32-le") for k in around if b.row[k] == row[i]}
            quoted[i] = not said & ADDRESS
    factor[quoted] *= QUOTED
    total = np.bincount(row, weight * factor, n)
    upto = np.concatenate(([0.0], np.cumsum(weight * factor)))
    ahead = np.minimum(np.searchsorted(word, word + 2 * CONTEXT, "right"), np.searchsorted(row, row, "right"))
    dense = np.zeros(n)
    np.maximum.at(dense, row, upto[ahead] - upto[:-1] if len(word) else np.zeros(0))
    quoted = np.bincount(row, quoted, n)
    heaviest = np.zeros(n)
    np.maximum.at(heaviest, row, weight * factor)
    return np.column_stack((np.log1p(total), 10 * total / (b.count + 20), np.log1p(dense), np.log1p(quoted), heaviest))


@dataclass
class Model:
    lexicon: Lexicon
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = (features(self.lexicon, texts) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(x)), x)) @ self.weights, -30, 30)))


def _forms(texts: list[str]) -> list[set[tuple[str, bool]]]:
    b = cut(texts)
    whole = b.points.tobytes().decode("utf-32-le", "surrogatepass")
    out: list[set[tuple[str, bool]]] = [set() for _ in texts]
    for r, x, y in zip(b.row.tolist(), b.starts.tolist(), b.ends.tolist()):
        out[r].add((whole[x:y], False))
        for k in PREFIX:
            if y - x > k:
                out[r].add((whole[x : x + k], True))
    return out


def learn(texts: list[str], toxic: list[int]) -> Model:
    """Model of labelled texts. Without a text of each label every score is the smoothed share of label 1."""
    texts, y = [t.lower() for t in texts], np.array(toxic, float)
    positive, negative = [t for t, x in zip(texts, toxic) if x], [t for t, x in zip(texts, toxic) if not x]
    seen: Counter = Counter()
    for at in range(0, len(positive), 200):
        for s in _forms(positive[at : at + 200]):
            seen.update(s)
    seen = Counter({k: v for k, v in seen.items() if v >= max(LEAST_DOCS, 0.01 * len(positive))})
    clean: Counter = Counter()
    for at in range(0, len(negative), 200):
        for s in _forms(negative[at : at + 200]):
            clean.update(s & seen.keys())
    lift = {e: (p / max(1, len(positive))) / ((clean[e] + 1) / (len(negative) + 1)) for e, p in seen.items()}
    ranked = sorted((e for e in seen if lift[e] >= LEAST_LIFT), key=lambda e: (-seen[e] * math.log(lift[e]), e))
    # A beginning adds nothing where one longer form has as many texts.
    chosen: list[tuple[str, bool]] = []
    for e in ranked[: 4 * LEXICON]:
        if e[1] and any(f[0].startswith(e[0]) and f != e and seen[f] * 1.25 >= seen[e] for f in seen):
            continue
        chosen.append(e)
        if len(chosen) == LEXICON:
            break
    weight = {e: math.log(lift[e]) for e in chosen}
    most = lambda e: 0 if e[1] or len(e[0]) < 4 else 1 if len(e[0]) < 9 else 2
    fuzzy = {e: most(e) for e in chosen if most(e)}
    for e in list(fuzzy):  # words that clean texts often come near to are matched exactly
        probe = build([(e[0], False, 1.0, fuzzy[e])])
        near = 0
        for at in range(0, min(len(negative), 1000), 200):
            b = cut(negative[at : at + 200])
            near += len(np.unique(b.row[probe.hits(b)[0]]))
        while fuzzy[e] and near > 0.002 * min(len(negative), 1000):
            fuzzy[e], near = 0, 0
    lexicon = build([(e[0], e[1], weight[e], fuzzy.get(e, 0)) for e in chosen] or [("\x00", False, 1.0, 0)])
    x = np.vstack([features(lexicon, texts[at : at + 200]) for at in range(0, len(texts), 200)]) if texts else np.zeros((0, N_FEATURES))
    center, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z = np.column_stack((np.ones(len(x)), (x - center) / scale))
    w = np.zeros(N_FEATURES + 1)
    w[0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if 0 < y.sum() < len(y):
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            ridge = np.diag([1e-6, *[0.1] * N_FEATURES])
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
    return Model(lexicon, center, scale, w)


def _bucket():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Model:
    """Learns from at most `rows` labelled rows of `most` bytes outside the held-out fold, the first by a hash of doc_id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.where(_bucket() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = stash(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample")
    # `rows` numbers in one task, without the texts.
    upto = got.select("doc_id", F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto")).where(F.col("upto") <= most)
    got = got.join(F.broadcast(upto.select("doc_id")), "doc_id", "left_semi").orderBy("doc_id").toArrow()
    return learn(got.column("text").to_pylist(), got.column("toxic").to_pylist())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs.

    Null text is empty text and gets the score of a text without hits. A null doc_id keeps its row and
    is not held out. Repeated rows get equal rows; an empty table gives an empty result.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower() if t else "" for t in batch.column(2).to_pylist()]
            parts, size, block = [], 0, []
            for t in texts:
                block.append(t)
                size += len(t)
                if size >= 1 << 20:
                    parts.append(model.score(block))
                    size, block = 0, []
            if block:
                parts.append(model.score(block))
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_bucket() == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Whole documents table, learned from labels.toxic outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
