"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last sixteen bytes cuts texts into chunks of some hundred bytes, so a passage is cut alike in every
document, wherever it stands. A chunk is encoded by itself, once per worker while its cache (bounded in bytes) holds it,
and its ids are shared by all documents with that chunk. Alone, a chunk's first and last pieces may have other ids than in
the text, so each join of two chunks is repaired: the last two pieces of the left chunk and the first two of the right
one are encoded again as one string. If its ids begin with those of the outer piece on the left and end with those of the
outer piece on the right, both sides agree and the join is exact, as a piece edge is a place that no token crosses (see
``pieces``). If they do not agree, or a chunk has too few pieces, the two chunks become one and are encoded again, until
all joins of the text agree; at worst the whole text is one chunk.

Defined cases: null text is an empty text, which has no ids and decodes to the empty text; repeated rows and ties
need no order; an empty table gives an empty result; a very long text is cut like any other, and without white space it
is one chunk; of other columns, those named in ``keep`` are passed through, but for those with the names of results.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

WINDOW = 16
#: Bytes of chunks and ids that one Python worker remembers.
CACHE_BYTES = 24 << 20


def chunk_ends(data: np.ndarray, offsets: np.ndarray, mean: int) -> np.ndarray:
    """Ends of the chunks of all rows (row ends included), where the hash of the last bytes says so, before a character."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    if n > WINDOW:
        cut[WINDOW:] = common.gram_hash(data, WINDOW) % np.uint64(mean) == 0
        cut[:n] &= (data & 0xC0) != 0x80
    cut[offsets] = True
    cut[0] = False
    return np.flatnonzero(cut)


class Chunk:
    """A chunk's ids and pieces: cuts are piece edges (bytes), before is the number of ids before each edge."""

    __slots__ = ("raw", "ids", "cuts", "before")

    def __init__(self, raw: bytes, ids: np.ndarray, cuts: np.ndarray, before: np.ndarray):
        self.raw, self.ids, self.cuts, self.before = raw, ids, cuts, before

    def part(self, a: int, b: int) -> np.ndarray:
        """The ids between two piece edges, given in bytes."""
        return self.ids[self.before[bisect_left(self.cuts, a)] : self.before[bisect_left(self.cuts, b)]]


class ChunkEncoder:
    """Encodes texts by chunks; ``encoded`` and ``used`` count chunks for tests."""

    def __init__(self, coder: pieces.Encoder, mean: int):
        self.coder, self.mean, self.known, self.held = coder, mean, {}, 0
        self.encoded = self.used = self.merged = 0

    def lone(self, raws: list[bytes]) -> list[Chunk]:
        """These chunks, encoded each by itself."""
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws]))).astype(np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        if not len(data):
            return []
        cuts = np.append(np.flatnonzero(pieces.safe_cuts(data, offsets)), len(data))
        ids, before = self.coder.encode(data, cuts)
        edge = np.searchsorted(cuts, offsets)
        self.encoded += len(raws)
        out = []
        for i, raw in enumerate(raws):
            x, y = edge[i], edge[i + 1]
            out.append(Chunk(raw, ids[before[x] : before[y]].copy(), (cuts[x : y + 1] - offsets[i]).tolist(), (before[x : y + 1] - before[x]).tolist()))
        return out

    def chunks(self, raws: list[bytes]) -> dict[bytes, Chunk]:
        """All these chunks, those not known yet encoded together."""
        distinct = dict.fromkeys(raws)
        new = [r for r in distinct if r not in self.known]
        if self.held > CACHE_BYTES:
            self.known, self.held = {r: self.known[r] for r in distinct if r in self.known}, 0
        for c in self.lone(new):
            self.known[c.raw] = c
            self.held += 5 * len(c.raw) + 500
        self.used += len(raws)
        return self.known

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        ends = chunk_ends(data, offsets, self.mean).tolist()
        raw, at, raws = data.tobytes(), 0, []
        for end in ends:
            raws.append(raw[at:end])
            at = end
        known, rows, at, k = self.chunks(raws), [], 0, 0
        for end in offsets[1:].tolist():
            row = []
            while at < end:
                row.append(known[raws[k]])
                at += len(raws[k])
                k += 1
            rows.append(row)
        rows, windows = [joinable(row, self) for row in rows], []
        for row in rows:
            windows += map(join_window, row, row[1:])
        found = self.windows(windows)
        return [self.stitch(row, found) for row in rows]

    def windows(self, strings: list[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of join strings, by the library as they stand."""
        distinct = list(dict.fromkeys(strings))
        found = self.coder.tokenizer.encode_batch_fast([w.decode() for w in distinct], add_special_tokens=False)
        return {w: np.array(e.ids, np.uint32) for w, e in zip(distinct, found)}

    def stitch(self, row: list[Chunk], found: dict[bytes, np.ndarray]) -> np.ndarray:
        """The row's ids: chunk cores and repaired joins; chunks whose join does not agree become one."""
        while True:
            out, at = [], 0  # at: the edge in the present chunk up to which ids are out
            for k, c in enumerate(row):
                if k + 1 == len(row):
                    out.append(c.part(at, len(c.raw)))
                    return np.concatenate(out)
                d = row[k + 1]
                left, right = c.part(c.cuts[-3], c.cuts[-2]), d.part(d.cuts[1], d.cuts[2])
                w = join_window(c, d)
                ids = found[w] if w in found else self.windows([w])[w]
                if len(ids) < len(left) + len(right) or (ids[: len(left)] != left).any() or (ids[len(ids) - len(right) :] != right).any():
                    self.merged += 1
                    row = joinable([*row[:k], *self.lone([c.raw + d.raw]), *row[k + 2 :]], self)
                    break
                out += [c.part(at, c.cuts[-3]), ids]
                at = d.cuts[2]
            else:
                return np.zeros(0, np.uint32)


def join_window(c: Chunk, d: Chunk) -> bytes:
    return c.raw[c.cuts[-3] :] + d.raw[: d.cuts[2]]


def joinable(row: list[Chunk], coder: ChunkEncoder) -> list[Chunk]:
    """The row's chunks, of which those with fewer than the four pieces that two joins need are put to a neighbour."""
    while len(row) > 1 and any(len(c.cuts) < 5 for c in row):
        groups: list[list[Chunk]] = []
        for c in row:
            if groups and (len(c.cuts) < 5 or len(groups[-1][-1].cuts) < 5):
                groups[-1].append(c)
            else:
                groups.append([c])
        row = [g[0] if len(g) == 1 else coder.lone([b"".join(c.raw for c in g)])[0] for g in groups]
    return row


def token_bytes(path: str) -> list[bytes]:
    """Each id's token as the decoder without a step of its own prints it."""
    tk = pieces.encoder(path).tokenizer
    return [(tk.id_to_token(i) or "").encode() for i in range(tk.get_vocab_size(with_added_tokens=True))]


_tokens: dict[str, list[bytes]] = {}


def decode(ids: np.ndarray, path: str) -> bytes:
    """The text of ids, as the library joins the tokens of a vocabulary whose file names no decoder."""
    if path not in _tokens:
        _tokens[path] = token_bytes(path)
    return b" ".join(map(_tokens[path].__getitem__, ids.tolist()))


def is_plain(path: str) -> bool:
    import json

    with open(path) as f:
        file = json.load(f)
    return file.get("decoder") is None and any(x["type"] == "Lowercase" for x in (file.get("normalizer") or {}).get("normalizers", []))


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, as the vocabulary's own normalizer has it, so that more chunks are equal; not where the string of
    a special token might arise."""
    return data if b"<|" in data.tobytes() else common.lower_ascii(data)


_coders: dict[tuple[str, int], ChunkEncoder] = {}


def encode(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), mean_chunk: int = 256, output: str = "ids") -> DataFrame:
    """Columns of ``keep`` and, with output "ids", ids (binary, little-endian uint32) and decoded (string);
    with output "digest", n_tokens and the sha256 of both."""
    if not is_plain(tokenizer):
        raise ValueError("this is for vocabularies that fold case and have no decoder step")
    common.small_batches(docs.sparkSession)
    digest = output == "digest"

    def run(batches):
        if (tokenizer, mean_chunk) not in _coders:
            _coders[tokenizer, mean_chunk] = ChunkEncoder(pieces.encoder(tokenizer), mean_chunk)
        coder = _coders[tokenizer, mean_chunk]
        for batch in batches:
            data, offsets = common.buffers(batch.column(batch.num_columns - 1))
            for a, b in common.slices(offsets):
                part, local = folded(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                rows = coder.texts(part, local)
                raw = [r.astype("<u4").tobytes() for r in rows]
                text = [decode(r, tokenizer) for r in rows]
                out = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
                out.append(pa.array([len(r) for r in rows], pa.int64()))
                if digest:
                    out += [pa.array([hashlib.sha256(x).hexdigest() for x in col]) for col in (raw, text)]
                else:
                    out += [pa.array(raw, pa.binary()), pa.array([x.decode() for x in text])]
                yield pa.RecordBatch.from_arrays(out, names=names)

    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids binary, decoded string"
    results = [x.split()[0] for x in more.split(", ")]
    keep = tuple(c for c in keep if c not in results)
    inner = [f"__{k}" for k in range(len(keep))]
    names = [*inner, *results]
    rows = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, inner)), common.binary().alias("__text"))
    kept = ", ".join(f"{x} {f.dataType.simpleString()}" for x, f in zip(inner, rows.schema.fields[:-1]))
    return rows.mapInArrow(run, f"{kept}, {more}" if kept else more).select(*(F.col(x).alias(c) for c, x in zip(keep, inner)), *results)


def digest_columns(encoded: DataFrame) -> DataFrame:
    """The digests of ``encode``'s rows by Spark functions."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
