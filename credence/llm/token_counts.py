"""Edit-aware token counts: segment trees over the documents' pre-tokens, kept in a table.

``trees`` cuts each text into pieces at places no token crosses (see ``pieces``), gathers about ``leaf_bytes`` of pieces in a
leaf and stores the leaves' ends and token counts with the sums above them, in heap order, beside the text. ``edit`` takes
such a table with edits and gives the table after them, to be stored and edited again: around an edit, the text is encoded
again from the last unharmed safe place before it to the first one after it, old and new; the touched leaves take the
difference, only the sums above them change, and all else stays as it was stored. A leaf that edits have made too
long is cut anew.

Edits are (start, end, text) in code points of the stored text, and must not overlap; they may come in any order, and of
two insertions at one place the earlier in the list comes first. Defined cases: null text is empty, and edits on it must
be insertions at 0; null edits are none; overlapping edits or edits beyond the text raise an error; repeated rows each
count; a text without white space is one leaf; an empty table gives an empty result; of other columns, those named in
``keep`` pass through, but for those with the names of results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces


class SumTree:
    """Sums over leaves, with point updates."""

    def __init__(self, counts: np.ndarray):
        self.size = 1 << max(0, int(len(counts) - 1).bit_length()) if len(counts) else 1
        self.node = np.zeros(2 * self.size, np.int64)
        self.node[self.size : self.size + len(counts)] = counts
        self._add_up()

    @classmethod
    def stored(cls, node: np.ndarray) -> "SumTree":
        out = cls.__new__(cls)
        out.size, out.node = len(node) // 2, np.array(node, np.int64)
        return out

    def _add_up(self) -> None:
        level = self.size
        while level > 1:
            self.node[level // 2 : level] = self.node[level : 2 * level : 2] + self.node[level + 1 : 2 * level : 2]
            level //= 2

    def set(self, leaf: int, count: int) -> None:
        k = self.size + leaf
        change = count - int(self.node[k])
        while change and k:
            self.node[k] += change
            k >>= 1

    def total(self) -> int:
        return int(self.node[1])

    def before(self, leaf: int) -> int:
        k, out = self.size + leaf, 0
        while k > 1:
            if k & 1:
                out += int(self.node[k - 1])
            k >>= 1
        return out


def byte_edits(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, bytes]]:
    """Edits with byte offsets, in order."""
    edits = sorted(edits, key=lambda e: (e[0], e[1]))
    out, at, byte = [], 0, 0
    for start, end, new in edits:
        if start < at or end < start or end > len(text):
            raise ValueError("edits overlap or lie beyond the text")
        byte += len(text[at:start].encode())
        stop = byte + len(text[start:end].encode())
        out.append((byte, stop, new.encode()))
        at, byte = end, stop
    return out


def apply(data: bytes, start: int, edits: list[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    for a, b, new in edits:
        out += [data[at : a - start], new]
        at = b - start
    return b"".join([*out, data[at:]])


def regions(data: bytes, edits: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """What must be encoded again: (start, end, new bytes) between safe places of the old text that the edits leave safe."""
    raw = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero(pieces.safe_cuts(raw, np.array([0, len(raw)], np.int64)))
    out: list[list] = []
    for k, (a, b, _) in enumerate(edits):
        lo = int(np.searchsorted(cuts, a)) - 1  # a cut is safe by the byte behind it and the three before it
        hi = int(np.searchsorted(cuts, b + 3))
        start, end = int(cuts[lo]) if lo >= 0 else 0, int(cuts[hi]) if hi < len(cuts) else len(data)
        if out and start < out[-1][1]:
            out[-1][1], out[-1][3] = max(end, out[-1][1]), k + 1
        else:
            out.append([start, end, k, k + 1])
    return [(a, b, apply(data[a:b], a, edits[i:j])) for a, b, i, j in out]


def leaves(data: np.ndarray, offsets: np.ndarray, coder: pieces.Encoder, leaf_bytes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's leaf ends and their token counts."""
    if not len(data):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in offsets[1:]]
    cuts = np.flatnonzero(pieces.safe_cuts(data, offsets))
    before = coder.encode(data, np.append(cuts, len(data)))[1]
    row = np.searchsorted(offsets, cuts, side="right") - 1
    group = (cuts - offsets[row]) // leaf_bytes
    head = np.ones(len(cuts), bool)
    head[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
    start, at = np.append(cuts[head], len(data)), np.append(before[:-1][head], before[-1])
    edge = np.searchsorted(start, offsets)
    return [(start[x + 1 : y + 1] - start[x], np.diff(at[x : y + 1])) if y > x else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for x, y in zip(edge[:-1], edge[1:])]


def counts_of(texts: list[bytes], coder: pieces.Encoder) -> list[int]:
    """The number of tokens of each of these texts, encoded together."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    cuts = np.append(np.flatnonzero(pieces.safe_cuts(data, offsets)), len(data)) if len(data) else np.zeros(1, np.int64)
    before = coder.encode(data, cuts)[1]
    return np.diff(before[np.searchsorted(cuts, offsets)]).tolist()


def rule_edits(text: str, rules: list[tuple]) -> list[tuple[int, int, str]]:
    """Edits that replace the matches of patterns, the first pattern first; later matches that overlap earlier ones are left.

    A rule is (pattern, replacement) or (pattern, replacement, needs): texts without the string ``needs`` are not searched."""
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for pattern, new, *needs in rules:
        if needs and needs[0] not in text:
            continue
        for m in re.finditer(pattern, text):
            a, b = m.span()
            if 1 not in taken[a:b]:
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, m.expand(new)))
    return out


_EDIT = "array<struct<start:int,end:int,text:string>>"
_TREE = ("text", "leaf_ends", "tree")
_INTS = pa.list_(pa.int32())


def _kept(df: DataFrame, keep: tuple[str, ...], results: tuple[str, ...]) -> tuple[list[str], str]:
    names = [c for c in keep if c not in results]
    return names, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields)


def trees(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), leaf_bytes: int = 256) -> DataFrame:
    """Columns of ``keep`` with text (null as empty), leaf_ends (bytes) and tree (token counts of the leaves and the sums
    above them, in heap order: tree[1] is the document's)."""
    common.small_batches(docs.sparkSession)
    names, kept = _kept(docs, keep, _TREE)

    def run(batches):
        coder = pieces.encoder(tokenizer)
        for batch in batches:
            data, offsets = common.buffers(batch.column(batch.num_columns - 1))
            for a, b in common.slices(offsets):
                found = leaves(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], coder, leaf_bytes)
                columns = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns)]
                columns += [pa.array([x.astype(np.int32) for x, _ in found], _INTS), pa.array([SumTree(c).node.astype(np.int32) for _, c in found], _INTS)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *_TREE])

    return docs.select(*names, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"{kept}text string, leaf_ends array<int>, tree array<int>")


def edited(raw: bytes, ends: np.ndarray, todo: list[tuple[int, int, bytes]]):
    """The strings to count again, and how the leaves change: (first leaf, last leaf, new length, numbers of the strings: new, old ones)."""
    strings, changes = [], []
    starts = np.append(0, ends[:-1])
    for a, b, new in todo:
        i = max(0, int(np.searchsorted(starts, a, side="right")) - 1)
        j = max(i, int(np.searchsorted(starts, b, side="left")) - 1)
        if i == j or not len(ends):
            old = [raw[a:b]]
        else:
            old = [raw[a : int(ends[i])], raw[int(starts[j]) : b]]
        changes.append((i, j, a, b, len(new), len(strings)))
        strings += [new, *old]
    return strings, changes


def _changed(ends: np.ndarray, tree: SumTree, changes: list, counts: list[int]) -> np.ndarray:
    """The leaf ends after the changes; the tree takes them too."""
    size = np.diff(ends, prepend=0) if len(ends) else np.zeros(1, np.int64)
    for i, j, a, b, n, k in changes:
        if i == j:
            tree.set(i, int(tree.node[tree.size + i]) + counts[k] - counts[k + 1])
            size[i] += n - (b - a)
            continue
        tree.set(i, int(tree.node[tree.size + i]) + counts[k] - counts[k + 1])
        for leaf in range(i + 1, j):
            tree.set(leaf, 0)
            size[leaf] = 0
        tree.set(j, int(tree.node[tree.size + j]) - counts[k + 2])
        size[i] += n - (int(ends[i]) - a)
        size[j] -= b - int(ends[j - 1])
    return np.cumsum(size)


def edit(table: DataFrame, tokenizer: str, edits: str | None = None, rules: list[tuple] | None = None, keep: tuple[str, ...] = ("doc_id",), leaf_bytes: int = 256) -> DataFrame:
    """A table of ``trees`` after edits, with n_tokens (before), n_edits, n_tokens_after and n_bytes_again (encoded again).

    Edits come from a column of arrays of (start, end, text), or from rules, see ``rule_edits``."""
    results = (*_TREE, "n_tokens", "n_edits", "n_tokens_after", "n_bytes_again")
    common.small_batches(table.sparkSession)
    names, kept = _kept(table, keep, results)

    def run(batches):
        coder = pieces.encoder(tokenizer)
        for batch in batches:
            m = len(names)
            texts, given = batch.column(m), batch.column(m + 3).to_pylist() if edits else None
            data, offsets = common.buffers(texts)
            for a, b in common.slices(offsets):
                out, jobs, strings = [], [], []
                for i in range(a, b):
                    text = texts[i].as_py()
                    todo = [(e["start"], e["end"], e["text"] or "") for e in given[i] or []] if edits else rule_edits(text, rules or [])
                    ends, tree = (np.asarray(batch.column(m + k)[i].values) for k in (1, 2))
                    total = int(tree[1])
                    out.append([text, ends, tree, total, len(todo), total, 0])
                    if todo:
                        raw = text.encode()
                        again = regions(raw, byte_edits(text, todo))
                        more, changes = edited(raw, ends.astype(np.int64), again)
                        jobs.append((len(out) - 1, raw, again, changes, len(strings)))
                        strings += more
                counts = counts_of(strings, coder) if strings else []
                for at, raw, again, changes, first in jobs:
                    row = out[at]
                    tree = SumTree.stored(row[2])
                    ends = _changed(row[1].astype(np.int64), tree, changes, counts[first:])
                    new = apply(raw, 0, again)
                    row[0], row[1], row[2], row[5], row[6] = new.decode(), ends, tree.node, tree.total(), sum(len(x) for _, _, x in again)
                    size = np.diff(ends, prepend=0)
                    if len(size) and size.max() > 8 * leaf_bytes:
                        row[1], row[2] = _cut_anew(new, ends, tree, coder, leaf_bytes)
                columns = [batch.column(k).slice(a, b - a) for k in range(m)]
                columns += [pa.array([x[0] for x in out], pa.string()), *(pa.array([np.asarray(x[k], np.int32) for x in out], _INTS) for k in (1, 2)), *(pa.array([x[k] for x in out], pa.int64()) for k in (3, 4, 5, 6))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *results])

    rows = table.select(*names, *_TREE, *([F.col(edits).cast(_EDIT).alias("__edits")] if edits else []))
    return rows.mapInArrow(run, f"{kept}text string, leaf_ends array<int>, tree array<int>, n_tokens long, n_edits long, n_tokens_after long, n_bytes_again long")


def _cut_anew(data: bytes, ends: np.ndarray, tree: SumTree, coder: pieces.Encoder, leaf_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf ends and tree with the too long leaves cut anew; the counts of all others stay."""
    new_ends, new_counts, at = [], [], 0
    for k, end in enumerate(ends.tolist()):
        if end - at > 8 * leaf_bytes:
            part = np.frombuffer(data[at:end], np.uint8)
            ((e, c),) = leaves(part, np.array([0, len(part)], np.int64), coder, leaf_bytes)
            new_ends += (e + at).tolist()
            new_counts += c.tolist()
        elif end > at:
            new_ends.append(end)
            new_counts.append(int(tree.node[tree.size + k]))
        at = end
    return np.array(new_ends, np.int64), SumTree(np.array(new_counts, np.int64)).node


def count(docs: DataFrame, tokenizer: str, edits: str | None = None, rules: list[tuple] | None = None, keep: tuple[str, ...] = ("doc_id",), store: str | None = None) -> DataFrame:
    """Columns of ``keep`` with n_tokens of the text, n_edits, n_tokens_after them and n_bytes_again (encoded again).

    The trees are written to ``store`` (a new folder in the shared one where none is given), and the edits are made on what
    is read from there."""
    names, _ = _kept(docs, keep, ("n_tokens", "n_edits", "n_tokens_after", "n_bytes_again"))
    inner = [f"__{k}" for k in range(len(names))]
    renamed = docs.select("text", *(F.col(c).alias(x) for c, x in zip(names, inner)), *([F.col(edits).alias("__edits")] if edits else []))
    store = store or common.shared_folder(docs.sparkSession, "token-trees")
    trees(renamed, tokenizer, (*inner, *(("__edits",) if edits else ()))).write.parquet(store)
    after = edit(docs.sparkSession.read.parquet(store), tokenizer, "__edits" if edits else None, rules, tuple(inner))
    return after.select(*(F.col(x).alias(c) for c, x in zip(names, inner)), "n_tokens", "n_edits", "n_tokens_after", "n_bytes_again")
