"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

A window of a text is embedded by walking over it: at step j the current character is put out and the
walk moves on if a random bit of (j, character) says so. Few edits change few outputs, as two walks
fall into step again after an edit. Each of REPEATS tables has its own random bits and samples SAMPLED
of the outputs as a key. Windows begin at every word of a text and of an item; a text's window that
agrees with an item's in some table proposes the item-sized window around it, which is verified by
exact edit distance (the best alignment of the whole item within it). In runs of more than RUN bytes
without a space windows begin at every character. Shorter items use more tables (TABLES), and those of
up to EVERYWHERE characters are held against every place of the texts, bit-parallel, without windows.

A key is checked as it grows, against bit maps of the items' keys after a few samples, so most windows
are given up early; that loses no window whose whole key agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, stash, text_bytes

SIMILARITY = 0.8
REPEATS, STEPS, SAMPLED, STAGES = 3, 28, 14, (5, 9, 14)
#: Tables of items below so many bytes, for a recall of 0.9 at the similarity; longer items have REPEATS.
TABLES = ((75, 7), (100, 6), (140, 4))
#: Items of up to so many characters are held against every place. Items, and bytes of items, that one pass over the texts looks for.
EVERYWHERE, BLOCK_ITEMS, BLOCK_BYTES = 64, 4_000, 4 << 20
#: Bytes that a window of an item has at least.
SHORT = 32
#: Characters of a text that one lane of the search for short items reads.
LANE = 512
#: A proposed window goes on to the full comparison if this many bytes at the agreeing place are within so many edits of the item's.
HEAD, HEAD_EDITS = 48, 15
#: Longest run without a space (in bytes) that has its windows at its beginning only.
RUN = 16
_BITS = 20
_NORMAL = np.array([32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


@cache
def _tables(repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random bits by step and byte, the sampled steps in order, and random numbers by step and byte whose XOR is a key."""
    rng = np.random.default_rng(1000 + repeat)
    moves, sampled = rng.integers(0, 2, (STEPS, 256), dtype=np.int64), np.sort(rng.choice(STEPS, SAMPLED, replace=False))
    return moves, sampled, rng.integers(0, 1 << 63, (STEPS, 256), dtype=np.uint64) << np.uint64(1)


def word_starts(data: np.ndarray, tops: np.ndarray | None = None) -> np.ndarray:
    """Where words begin, and every character of runs of more than RUN bytes without a space; tops: where texts do."""
    space = data == 32
    start = ~space
    start[1:] &= space[:-1]
    if tops is not None:
        start[tops] = ~space[tops]
    at = np.flatnonzero(start)
    edges = np.flatnonzero(start | space)  # a run ends at the next of them
    after = np.append(edges, len(data))[np.searchsorted(edges, at, "right")]
    for a, b in zip(at[after - at > RUN].tolist(), after[after - at > RUN].tolist()):
        start[a:b] |= (data[a:b] & 0xC0) != 0x80
    return np.flatnonzero(start)


def _short_hash(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).view(np.int64)


def walk(data: np.ndarray, at: np.ndarray, repeat: int, maps: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of the windows that begin at `at` (data padded by STEPS bytes); with maps, only of those that pass them.

    Returns the indexes into `at` that are left and the keys after each of STAGES (of the ones left, for the last)."""
    moves, sampled, marks = _tables(repeat)
    wanted = set(sampled.tolist())
    left, where, h, taken, keys = np.arange(len(at)), at.astype(np.int64), np.zeros(len(at), np.uint64), 0, []
    for j in range(int(sampled[-1]) + 1):
        c = data.take(where)
        if j in wanted:
            h ^= marks[j].take(c)
            taken += 1
            if taken in STAGES:
                keys.append(h.copy())
                if maps is not None:
                    keep = np.flatnonzero(maps[len(keys) - 1].take(_short_hash(h)))
                    left, where, h, c = left[keep], where[keep], h[keep], c[keep]
                    keys[-1] = h
        where += moves[j].take(c)
    return left, keys


@dataclass
class Index:
    """Items of one pass: texts (normalised), ids, and per table the bit maps and the sorted keys with item and offset."""

    ids: list
    texts: list[str]
    raw: list[bytes]
    tables: list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]
    short: list[int]

    def near_head(self, body: np.ndarray, items: np.ndarray, begin: np.ndarray, offset: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which proposals have, about the agreeing place, HEAD bytes within HEAD_EDITS of the item's (bit-parallel, side by side)."""
        if not len(items):
            return np.zeros(0, bool)
        size = np.array([len(r) for r in self.raw], np.int64)
        head = np.maximum(0, np.minimum(offset, size[items] - HEAD))
        places, which = np.unique(np.stack((items, head)), axis=1, return_inverse=True)
        length = np.minimum(HEAD, size[places[0]])
        masks = np.zeros((places.shape[1], 256), np.uint64)
        for i, (k, at) in enumerate(places.T.tolist()):
            for j, c in enumerate(self.raw[k][at : at + HEAD]):
                masks[i, c] |= np.uint64(1 << j)
        masks, which = masks.reshape(-1), which.reshape(-1)
        out = np.zeros(len(items), bool)
        for a in range(0, len(items), 1 << 13):
            part = slice(a, a + (1 << 13))
            mine, one = which[part] * 256, np.uint64(1)
            top = (length[which[part]] - 1).astype(np.uint64)
            start, stop = np.maximum(low[part], (begin + head)[part] - HEAD // 4), np.minimum(high[part], (begin + head)[part] + HEAD * 3 // 2)
            where = start + np.arange(HEAD * 7 // 4 + 1)[:, None]
            text = np.where(where < stop, body.take(where, mode="clip"), 255)  # no byte of UTF-8
            up, down, score = np.full(len(mine), 2**64 - 1, np.uint64), np.zeros(len(mine), np.uint64), length[which[part]]
            best = score.copy()
            for c in text:
                eq = masks.take(mine + c)
                d0 = (((eq & up) + up) ^ up) | eq | down
                hp, hn = down | ~(d0 | up), up & d0
                score += ((hp >> top) & one).view(np.int64)
                score -= ((hn >> top) & one).view(np.int64)
                hp, hn = hp << one, hn << one
                up, down = hn | ~(d0 | hp), hp & d0
                np.minimum(best, score, out=best)
            out[part] = best <= HEAD_EDITS
        return out


def normal(text: str) -> bytes:
    return _NORMAL[np.frombuffer(text.encode(), np.uint8)].tobytes().strip(b" ")


def build(items: list[tuple[int, str]]) -> Index:
    raw = [normal(t) for _, t in items]
    short = [k for k, r in enumerate(raw) if 0 < len(r.decode("utf-8", "replace")) <= EVERYWHERE]
    joined = np.frombuffer(b" ".join([*raw, b" " * STEPS]), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    at = word_starts(joined)
    item = np.searchsorted(begins, at, "right") - 1
    fits = (item < len(raw)) & (begins[np.minimum(item + 1, len(begins) - 1)] - 1 - at >= SHORT * 3 // 4) & np.isin(item, short, invert=True)
    at, item = at[fits], item[fits]
    tables = []
    wanted = np.array([next((n for size, n in TABLES if len(r) < size), REPEATS) for r in raw], np.int64)
    every, owner = at, item
    for r in range(max([REPEATS, *wanted.tolist()])):
        at, item = every[wanted[owner] > r], owner[wanted[owner] > r]
        left, keys = walk(joined, at, r)
        maps = []
        for k in keys:
            m = np.zeros(1 << _BITS, bool)
            m[_short_hash(k)] = True
            maps.append(m)
        order = np.argsort(keys[-1], kind="stable")
        tables.append((maps, keys[-1][order], item[left][order], (at - begins[item])[left][order]))
    return Index([i for i, _ in items], [r.decode("utf-8", "replace") for r in raw], raw, tables, short)


def best_alignment(item: str, text: str, most: float = float("inf")) -> tuple[int, int, int]:
    """(distance, start, end) of the part of text nearest to the whole item by edit distance; first end, then latest start.

    Beyond `most` the start isn't sought and is the end."""
    d, end = _ends(item, text)
    if d > most:
        return d, end, end
    _, back = _ends(item[::-1], text[:end][::-1], d)
    return d, end - back, end


def _ends(item: str, text: str, wanted: int | None = None) -> tuple[int, int]:
    """Least distance of item to a part of text, and the first position where such a part ends (bit-parallel)."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    up, down, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up = hn | (full & ~(d0 | hp))
        down = hp & d0
        if score < best:
            best, at = score, j
            if wanted is not None and best <= wanted:
                break
    return best, at


def near_ends(item: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Where parts of points end that are within `most` edits of item (1 to 64 code points): lanes of the text side by side."""
    m, one = len(item), np.uint64(1)
    chars, where = np.unique(item, return_inverse=True)
    masks = np.zeros(len(chars) + 1, np.uint64)
    for i, c in enumerate(where.tolist()):
        masks[c] |= one << np.uint64(i)
    symbols = np.minimum(np.searchsorted(chars, points), len(chars) - 1)
    symbols[chars[symbols] != points] = len(chars)
    lead, lanes = m + most, -(-len(points) // LANE)
    symbols = np.concatenate((np.full(lead, len(chars)), symbols, np.full(lanes * LANE - len(points), len(chars))))
    base, top = np.arange(lanes) * LANE, np.uint64(m - 1)
    up, down, score = np.full(lanes, 2**64 - 1, np.uint64), np.zeros(lanes, np.uint64), np.full(lanes, m, np.int64)
    found = []
    for j in range(lead + LANE):
        eq = masks[symbols[base + j]]
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | ~(d0 | up), up & d0
        score += ((hp >> top) & one).astype(np.int64) - ((hn >> top) & one).astype(np.int64)
        hp, hn = hp << one, hn << one
        up, down = hn | ~(d0 | hp), hp & d0
        if j >= lead:
            found.append(base[score <= most] + (j - lead + 1))
    ends = np.sort(np.concatenate(found))
    return ends[ends <= len(points)]


def _near(index: Index, body: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """What find gives for the short items."""
    found = []
    points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upto = np.concatenate(([0], np.cumsum(body & 0xC0 != 0x80)))
    tops = upto[offsets - offsets[0]]
    for k in index.short:
        want = index.texts[k]
        m = len(want)
        most = int((1 - SIMILARITY) * m + 1e-9)
        ends = near_ends(np.frombuffer(want.encode("utf-32-le"), np.uint32), points, most)
        group = np.cumsum(np.diff(ends, prepend=ends[:1]) > 1) if len(ends) else ends
        cuts = {(int(np.searchsorted(tops, e - 1, "right")) - 1, int(g), int(e) // max(1, m // 2)): int(e) for e, g in zip(ends, group)}
        for (r, _, _), e in cuts.items():
            low, high = max(int(tops[r]), e - 2 * m - most), e
            text = points[low:high].tobytes().decode("utf-32-le")
            d, a, b = best_alignment(want, text, most)
            if d > most:
                continue
            before, after = low + a == tops[r] or points[low + a - 1] == 32, low + b == tops[r + 1] or points[low + b] == 32
            if most or (before and after):  # without room for an edit the item has to be whole words
                found.append((r, k, d, low + a - int(tops[r]), low + b - int(tops[r])))
    return found


def find(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, distance, start, end) of verified leaks in texts that lie back to back; start and end in code points."""
    body = np.concatenate((_NORMAL[data], np.full(STEPS + 4, 32, np.uint8)))
    starts = word_starts(body[: len(data)], offsets[:-1][offsets[:-1] < len(data)])
    proposed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r, (maps, keys, item, offset) in enumerate(index.tables):
        if not len(keys):
            continue
        left, got = walk(body, starts, r, maps)
        if not left.size:
            continue
        lo, hi = np.searchsorted(keys, got[-1], "left"), np.searchsorted(keys, got[-1], "right")
        n = hi - lo
        which = np.repeat(np.arange(len(left)), n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        proposed.append((item[entry], starts[left[which]] - offset[entry], offset[entry]))
    found = []
    if proposed:
        items, begin, offset = (np.concatenate([p[i] for p in proposed]) for i in range(3))
        row = np.clip(np.searchsorted(offsets, begin + offset, "right") - 1, 0, len(offsets) - 2)
        row, items, begin, offset = np.unique(np.stack((row, items, begin, offset)), axis=1)
        near = index.near_head(body, items, begin, offset, offsets[row], offsets[row + 1])
        row, items, begin = row[near].tolist(), items[near].tolist(), begin[near].tolist()
        last = 0
        for first in range(len(row)):
            if first < last:
                continue
            # Proposals of one item that lie close together are verified at once.
            r, k, size = row[first], items[first], len(index.raw[items[first]])
            slack = size // 4 + 8
            last = first + 1
            while last < len(row) and (row[last], items[last]) == (r, k) and begin[last] - begin[first] <= slack:
                last += 1
            low, high = max(int(offsets[r]), begin[first] - slack), min(int(offsets[r + 1]), begin[last - 1] + size + slack)
            text = body[low:high].tobytes().decode("utf-8", "ignore")
            want = index.texts[k]
            most = (1 - SIMILARITY) * len(want) + 1e-9
            distance, s, e = best_alignment(want, text, most)
            if distance <= most:
                before = int(np.count_nonzero(data[int(offsets[r]) : low] & 0xC0 != 0x80))
                found.append((r, k, distance, before + s, before + e))
    if index.short and len(data):
        found += _near(index, body[: len(data)], offsets)
    best: dict[tuple[int, int], list] = {}
    for f in sorted(found, key=lambda f: (f[0], f[1], f[2], f[3], f[4])):  # overlapping finds of an item: the nearest
        kept = best.setdefault((f[0], f[1]), [])
        if not any(f[3] < y[4] and y[3] < f[4] for y in kept):
            kept.append(f)
    return [f for kept in best.values() for f in kept]


def _leaks_of(docs: DataFrame, index: Index) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            for first, last in blocks(offsets, 1 << 20):
                low = offsets[first]
                for r, k, d, s, e in find(index, data[low : offsets[last]], offsets[first : last + 1] - low):
                    for column, v in zip(out, (batch.column(0)[first + r].as_py(), index.ids[k], d, s, e)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "distance", "start", "stop"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, item_id long, distance long, start long, stop long")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start, stop (code points) of each place of docs that is within an edit
    similarity of SIMILARITY of a whole item (case and kind of white space aside).

    Null or empty texts on either side match nothing. Items that repeat are each reported; repeated
    rows of docs repeat their rows, null ids stay null. Without items, or without texts, empty. Other
    columns of either table are ignored. The items are taken in blocks of BLOCK_ITEMS and BLOCK_BYTES (a
    longer item makes a block of its own), each a pass over docs whose result is written before the next
    begins: the driver holds one block at a time.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id", "text")
    out, block, held = None, [], 0

    def joined(part: DataFrame) -> DataFrame:
        return part if out is None else out.unionByName(part)

    for row in items.toLocalIterator():
        if not normal(row[1]):
            continue
        if block and (len(block) == BLOCK_ITEMS or held + len(row[1]) > BLOCK_BYTES):
            out, block, held = joined(stash(_leaks_of(docs, build(block)), "leaks-block")), [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    return joined(_leaks_of(docs, build(block))) if block or out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text have no leak, with all their columns, whatever their names.

    Null and empty texts and null ids stay; of repeated rows all go or stay; an empty table stays empty."""
    marked = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    bad = stash(find_leaks(marked, benchmark).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("_leak"))
    return rows.join(bad, "_leak", "left_anti").select("row.*")


def op5_leaks(spark, sf_dir: str) -> DataFrame:
    """Whole documents table against the whole benchmark table."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
