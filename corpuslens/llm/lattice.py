"""Operator 8: SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is written with a mark for each space and one before its start, and cut
into units, a run of marks with the characters up to the next; no piece of the
vocabulary reaches across.  A unit's lattice has a node between any two
characters and an edge for each piece; a character without a piece of its own
has an edge of byte pieces.  Forward filtering sums the weight of all paths to
each node; backward sampling walks from the end and takes each edge by its
share of that sum, so a segmentation comes up by exactly its share.  Random
numbers are hashes of the row's key, the unit's place in its text and the
node, so every layout of the table gives the same segmentations.

A chunk's distinct units are filtered once, together, node by node, and all
units of the chunk are sampled together, edge by edge.  A unit is parted where
no piece reaches over a node, which changes no share, as all paths meet there;
so a long run without spaces takes few steps too.  A run that has no such node
is filtered a step a character.

Decoding joins the pieces' bytes and turns marks into spaces; a mark that
stands in the text itself is written in byte pieces, so every text comes back.

Defined results: a null or empty text has no pieces and decodes to the empty
text; a null key counts as a key of its own; rows that repeat a key and text
get equal segmentations; paths of equal weight come up equally often; columns
besides the key and the text are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import bounded, chunks, mix64

MARK = 0x2581
#: Stands for a mark in the text itself.
OWN_MARK = 0x110000
#: Weight of a piece of rank r is -ALPHA * ln(r + RANK_SHIFT): Zipf's law over the order of merges, flattened.
ALPHA, RANK_SHIFT = 0.5, 2.0
SEED = 42
#: Text bytes sampled together; a node takes some 200 bytes of working memory.
CHUNK = 2 << 20
#: Characters of distinct units that one lattice holds, about.
BLOCK = 1 << 20
#: Characters of a unit beyond which it is parted.
LONG_UNIT = 256

_M = np.uint64(0x9E3779B97F4A7C15)


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (n, 4) of code points, and how many each has."""
    c = np.where(codes == OWN_MARK, MARK, codes).astype(np.int64)
    n = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    out = np.zeros((len(c), 4), np.int64)
    for k in range(1, 5):
        own = c[n == k]
        lead = (0, 0, 0xC0, 0xE0, 0xF0)[k]
        for i in range(k):
            part = own >> (6 * (k - 1 - i))
            out[n == k, i] = part | lead if i == 0 else 0x80 | (part & 0x3F)
    return out, n


class Lattice:
    def __init__(self, model_path: str, alpha: float = ALPHA, seed: int = SEED):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = [b""] * size
        keys, ids, weights = [], [], []
        self.longest = 1
        for i in range(size):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
                continue
            self.bytes_of[i] = piece.replace("▁", " ").encode()
            if "▁" in piece.lstrip("▁"):
                continue  # it would reach across units
            keys.append(piece)
            ids.append(i)
            weights.append(-alpha * np.log(max(-model.get_score(i), 0.0) + RANK_SHIFT))
            self.longest = max(self.longest, len(piece))
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so not every text could be encoded")
        self.byte_weight = -alpha * (np.log(size) + 1)
        self.weights = dict(zip(keys, weights))
        self.piece_bytes = pa.array(self.bytes_of, pa.large_binary())
        #: Hashes of all code points; ``OWN_MARK`` is the last.
        self.mixed = mix64(np.arange(OWN_MARK + 1, dtype=np.uint64) + np.uint64(1))
        self.seed = np.uint64(seed)
        self.power = self.undo = np.ones(1, np.uint64)
        self._index(keys, np.array(ids), np.array(weights))

    def _index(self, keys: list[str], ids: np.ndarray, weights: np.ndarray) -> None:
        """Two tables by bits of a piece's hash; pieces that clash in the first stand in the second."""
        h = self._hashes(keys)
        order = np.argsort(h)
        # After the pieces: byte edges of one to four bytes, and no edge.
        n = self.pieces = len(order)
        self.hashes, self.ids = h[order], ids[order]
        self.w = np.concatenate([weights[order], self.byte_weight * np.arange(1, 5), [-np.inf]]).astype(np.float32)
        self.small = np.int16 if n + 5 < 1 << 15 else np.int32
        self.first = np.full(1 << 21, -1, np.int32)
        self.second = np.full(1 << 21, -1, np.int32)
        at = (self.hashes >> np.uint64(43)).astype(np.int64)
        _, lead = np.unique(at, return_index=True)
        self.first[at[lead]] = lead
        rest = np.setdiff1d(np.arange(len(order)), lead)
        slot = (self.hashes[rest] & np.uint64((1 << 21) - 1)).astype(np.int64)
        if len(np.unique(slot)) < len(slot) or len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("pieces clash in both tables")
        self.second[slot] = rest
        # Bits of what pieces, and starts of pieces, hash to: most substrings are neither and go no further.
        starts = {k[:i] for k in keys for i in range(1, len(k) + 1)}
        self.starts = np.zeros(1 << 21, bool)
        self.starts[(self._hashes(list(starts)) >> np.uint64(43)).astype(np.int64)] = True
        self.whole = np.zeros(1 << 21, bool)
        self.whole[at] = True

    def _hashes(self, keys: list[str]) -> np.ndarray:
        """Hashes of strings, those of one length at once."""
        out = np.zeros(len(keys), np.uint64)
        sizes = np.array([len(k) for k in keys])
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            codes = np.frombuffer("".join(keys[i] for i in own).encode("utf-32-le"), "<u4").reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for column in codes.T:
                h = h * _M + self.mixed[column]
            out[own] = mix64(h)
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        some = np.flatnonzero(self.whole[(h >> np.uint64(43)).astype(np.int64)])
        out[some] = self._lookup(h[some])
        return out

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        i = self.first[(h >> np.uint64(43)).astype(np.int64)]
        miss = (i < 0) | (self.hashes[i] != h)
        j = self.second[(h[miss] & np.uint64((1 << 21) - 1)).astype(np.int64)]
        i[miss] = np.where((j >= 0) & (self.hashes[j] == h[miss]), j, -1)
        return i

    def filter(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of units whose characters follow one another in ``codes``: each unit's first node, the log
        sum of all paths to each node, the cumulative shares of the edges into it by length, their pieces, and
        each segment's first node and length."""
        top_length = int(lengths.max(initial=1))
        top = min(self.longest, top_length)
        starts = np.cumsum(lengths) - lengths
        base = starts + np.arange(len(lengths))
        unit = np.repeat(np.arange(len(lengths)), lengths)
        ends = (starts + lengths)[unit]
        place = np.arange(len(codes))
        nodes = len(codes) + len(lengths)
        mixed = self.mixed[codes]
        h = np.zeros(len(codes), np.uint64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, top + 1):
            keep = place + size <= ends[place]
            place, h = place[keep], h[keep]
            if not len(place):
                break
            h = h * _M + mixed[place + size - 1]
            own = mix64(h)
            found = self._find(own)
            hit = found >= 0
            edges.append((place[hit] + unit[place[hit]] + size, found[hit]))
            if size == 1:
                bare = place[~hit]
                bare_nodes, bare_edges = bare + unit[bare] + 1, self.pieces - 1 + _utf8(codes[bare])[1]
            more = self.starts[(own >> np.uint64(43)).astype(np.int64)]
            place, h = place[more], h[more]
        # As wide as the longest piece that occurs here.
        top = max((i for i, (node, _) in enumerate(edges, 1) if len(node)), default=1)
        piece = np.full((nodes, top), self.pieces + 4, self.small)
        for i, (node, found) in enumerate(edges[:top]):
            piece[node, i] = found
        if edges:
            piece[bare_nodes, 0] = bare_edges
        share = np.full((nodes, top), 2.0, np.float32)
        # Nodes of long units that no edge reaches over part them into segments: all paths meet there, so each segment is
        # filtered by itself.  Short units are one segment each.
        last_nodes = base + lengths
        first, size_of = base, lengths
        if top_length > LONG_UNIT:
            long_ = np.repeat(lengths > LONG_UNIT, lengths + 1)
            over = np.zeros(nodes + 1, np.int64)
            for i, (node, _) in enumerate(edges[1:], 2):
                own = node[long_[node]]
                over += np.bincount(own - i + 1, minlength=nodes + 1)
                over -= np.bincount(own, minlength=nodes + 1)
            parts = (np.cumsum(over)[:nodes] == 0) & long_
            parts[last_nodes] = False
            parts[base] = True
            first = np.flatnonzero(parts)
            stop = np.minimum(np.append(first[1:], nodes), last_nodes[np.searchsorted(base, first, "right") - 1])
            size_of = stop - first
        total = np.zeros(nodes)
        ends = np.zeros(len(first))
        order = np.argsort(-size_of, kind="stable")
        sorted_ = size_of[order]
        before_ = {k: np.lib.stride_tricks.sliding_window_view(total, k) for k in range(1, top + 1) if k <= nodes}
        for j in range(1, int(sorted_[0]) + 1 if len(sorted_) else 1):
            own = order[: np.searchsorted(-sorted_, -j, "right")]
            at = first[own] + j
            sizes = np.arange(1, min(j, top) + 1)
            # Whole rows are taken: the totals of the nodes before each one, nearest first, and its edges.
            path = before_[len(sizes)][at - len(sizes)][:, ::-1] + self.w[piece.take(at, 0)[:, : len(sizes)]]
            best = path.max(1)
            part = np.exp((path - best[:, None]).astype(np.float32))
            cumulative = np.cumsum(part, 1)
            whole = cumulative[:, -1:].copy()
            sums = best + np.log(whole[:, 0])
            if first is base:
                total[at] = sums
            else:
                # A segment's end is the next one's start, which counts from zero again.
                done = size_of[own] == j
                total[at[~done]] = sums[~done]
                ends[own[done]] = sums[done]
            # Whatever rounding leaves goes to the last edge that counts.
            last = cumulative >= whole
            cumulative /= whole
            np.copyto(cumulative, 2.0, where=last)
            share[at, : len(sizes)] = cumulative
        if first is not base:
            # Each segment's nodes on top of all segments of its unit before.
            before = np.cumsum(ends) - ends
            offset = before - before[np.searchsorted(first, base)[np.searchsorted(base, first, "right") - 1]]
            segment = np.searchsorted(first, np.arange(nodes), "right") - 1
            total += offset[segment]
            total[last_nodes] = offset[segment[last_nodes]] + ends[segment[last_nodes]]
        return base, total, share, piece, first, size_of

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the multiplier and of its inverse up to the n-th, kept from chunk to chunk."""
        if n >= len(self.power):
            self.power, self.undo = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)]), dtype=np.uint64) for x in (int(_M), pow(int(_M), -1, 1 << 64)))
        return self.power[: n + 1], self.undo[: n + 1]

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' pieces in order, and each text's first index (n + 1 values); ``keys`` are 64-bit hashes of the rows."""
        firsts = np.zeros(len(texts) + 1, np.int64)
        some = [i for i, t in enumerate(texts) if t]
        if not some:
            return np.zeros(0, np.int64), firsts
        codes = np.frombuffer("".join("▁" + texts[i].replace("▁", "\0▁").replace(" ", "▁") if "▁" not in texts[i] else "▁" + texts[i] for i in some).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(texts[i]) + 1 for i in some])
        begin = np.cumsum(sizes) - sizes
        head = np.zeros(len(codes), bool)
        head[begin] = True
        for k, i in enumerate(some):
            if "▁" in texts[i]:
                own = codes[begin[k] + 1 : begin[k] + sizes[k]]
                own[own == MARK] = OWN_MARK
                own[own == 32] = MARK
        mark = codes == MARK
        opens = np.flatnonzero(head | (mark & ~np.concatenate([[False], mark[:-1]])))
        length = np.diff(np.concatenate([opens, [len(codes)]]))
        # Distinct units, by a fingerprint of their characters.
        power, undo = self._powers(len(codes))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.mixed[codes] * power[: len(codes)], dtype=np.uint64)])
        print_ = mix64((prefix[opens + length] - prefix[opens]) * undo[opens] + mix64(length.astype(np.uint64)))
        unit = pa.array(print_).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sample = np.empty(int(unit.max()) + 1, np.int64)
        sample[unit[::-1]] = np.arange(len(unit))[::-1]
        n = length[sample]
        row = np.searchsorted(begin, opens, "right") - 1
        first_of_row = np.searchsorted(opens, begin)
        own_keys = keys[np.array(some)][row]
        stream = mix64(own_keys ^ mix64((np.arange(len(opens)) - first_of_row[row]).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + self.seed))
        steps: list[tuple[np.ndarray, ...]] = []
        # Of every segment of every unit in the texts: where it starts, and how many pieces it has.
        starts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        known = 0
        # Units are filtered and sampled by blocks of about BLOCK characters, which bounds the lattice's memory.
        block_of = (np.cumsum(n) - n) // BLOCK
        for block in range(int(block_of[-1]) + 1):
            low, high = np.searchsorted(block_of, [block, block + 1])
            if low == high:
                continue
            m = n[low:high]
            chars = np.repeat(opens[sample[low:high]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            base, _, share, piece, first, size_of = self.filter(codes[chars], m)
            occurs = np.flatnonzero((unit >= low) & (unit < high))
            own = unit[occurs] - low
            if first is base:
                who, origin, least, left = occurs, base[own], np.zeros(len(occurs), np.int64), m[own]
            else:
                # Segments are sampled side by side; draws are keyed by the place in the unit, so parting changes none.
                lead = np.searchsorted(first, base)
                many = np.diff(np.append(lead, len(first)))[own]
                who = np.repeat(occurs, many)
                segment = np.repeat(lead[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                origin = np.repeat(base[own], many)
                least = first[segment] - origin
                left = least + size_of[segment]
            taken = np.zeros(len(who), np.int64)
            starts.append(opens[who] + least)
            counts.append(taken)
            node, active = origin + left, np.arange(len(who))
            while len(active):
                u = (mix64(stream[who[active]] + left.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
                size = (share.take(node, 0) > u[:, None]).argmax(1) + 1
                got = piece[node, size - 1].astype(np.int32)
                where = opens[who[active]] + left - 1  # the character that ends here
                count = np.where(got >= self.pieces, got - self.pieces + 1, 1)
                steps.append((active + known, taken[active], got, count.astype(np.int8), where))
                taken[active] += count
                node, left = node - size, left - size
                go = left > least[active]
                active, node, left = active[go], node[go], left[go]
            known += len(who)
        # Pieces come in the order of the text.
        starts_, taken = np.concatenate(starts), np.concatenate(counts)
        if len(starts) == 1 and first is base:
            stop = np.cumsum(taken)
        else:
            order = np.argsort(starts_)
            stop = np.empty(len(order), np.int64)
            stop[order] = np.cumsum(taken[order])
        out = np.zeros(int(taken.sum()), np.int64)
        for who, behind, got, count, where in steps:
            last = stop[who] - 1 - behind
            raw = got >= self.pieces
            out[last[~raw]] = self.ids[got[~raw]]
            if raw.any():
                bytes_, k = _utf8(codes[where[raw]])
                for i in range(4):
                    has = k > i
                    out[(last[raw] - k + 1 + i)[has]] = self.byte_ids[bytes_[has, i]]
        per = np.zeros(len(texts), np.int64)
        np.add.at(per, np.array(some)[row if len(starts) == 1 and first is base else np.searchsorted(begin, starts_, "right") - 1], taken)
        np.cumsum(per, out=firsts[1:])
        return out, firsts

    def decode(self, ids) -> str:
        # The mark before the text's start.
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:] if len(ids) else ""

    def decode_all(self, ids: np.ndarray, firsts: np.ndarray) -> list[bytes]:
        """Each text's bytes: ``decode`` of all texts' pieces at once, as Arrow lays taken values end to end."""
        taken = self.piece_bytes.take(pa.array(ids))
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(taken), pa.int64())).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], ends])[firsts].tolist()
        joined = taken.buffers()[2].to_pybytes() if len(ids) else b""
        return [joined[a + 1 : b] for a, b in zip(at, at[1:])]


@functools.lru_cache(2)
def _known(model_path: str, alpha: float = ALPHA, seed: int = SEED) -> Lattice:
    """A worker's lattice: its tables are built once, not in each of its tasks."""
    return Lattice(model_path, alpha, seed)


def sampled(docs: DataFrame, model_path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``(doc_id, ids)``: a sampled segmentation of every whole text, as an array of piece ids."""

    def run(batches):
        lattice = _known(model_path, alpha, seed)
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                ids, firsts = lattice.encode(pc.fill_null(part.column(1), "").to_pylist(), part.column(2).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull()).alias("key")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(pieces: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of ``pieces(doc_id, ids)``."""

    def run(batches):
        lattice = _known(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lattice.decode(x.values.to_numpy().tolist()) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def lattice_report(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless)``: each text encoded, and decoded again, in one pass."""

    def run(batches):
        lattice = _known(model_path)
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                texts = pc.fill_null(part.column(1), "").to_pylist()
                ids, firsts = lattice.encode(texts, part.column(2).to_numpy().view(np.uint64))
                raw = ids.astype("<u4").tobytes()
                back = lattice.decode_all(ids, firsts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(firsts)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(firsts.tolist(), firsts[1:].tolist())], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()), pa.array([a == b.encode() for a, b in zip(back, texts)], pa.bool_())],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = bounded(docs).select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull()).alias("key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
