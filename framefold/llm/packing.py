"""Packing by the dot-product heuristic of vector bin packing.

Every example has a size in three dimensions: tokens, segments and
loss-bearing tokens. Sequences are filled one at a time: of the examples that
fit what is left in all three, the one whose size has the largest dot product
with the remaining capacity goes in. If none fits whole, the best one is cut so that its head fills the
sequence. A text of more than one sequence gives whole sequences first, and
only its rest is an example. What remains open at the end of a group is cut
into sequences of power-of-two lengths, which need no padding.

Groups are runs of rows within one task, bounded in tokens, so that packing
needs no shuffle and no task holds more than a group, however large the input
or any one key. A text is handled whole; its ids are kept for one group only.

Defined cases: null text counts as empty and has the end id alone; repeated
rows and repeated ids are packed each on their own; null ids stay null; extra
columns are ignored; an empty table gives no rows. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import LOWER, mix, release, slices, span_hashes

LENGTH, SEGMENTS, END_ID = 2048, 256, 1
#: Tokens, and examples, of a group.
GROUP_TOKENS, GROUP_EXAMPLES = 1 << 20, 1024
#: Bytes of text encoded at once.
SLICE = 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Distinct pieces that a worker remembers.
MEMORY = 1 << 19


class Ids:
    """Ids of texts by way of their pieces, which the pre-tokenizer makes: runs of letters, single digits, runs of other signs.

    A piece's ids do not depend on its neighbours, so each distinct piece is
    encoded once in a worker and remembered by its 64-bit hash. Pieces are cut
    in numpy where a text has ASCII and Latin-1 letters alone; any other text
    is cut at spaces, where the pre-tokenizer always cuts, and its words are
    remembered.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ends[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self.is_end = ends
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 20, "<u4"), 1
        self.flat[0] = END_ID
        self.begin, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.count[0] = 1  # slot 0 is the end id
        self.slots = 1

    def slots_of(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each known hash, or -1."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.slot_of[at], -1) if len(self.keys) else np.full(len(hashes), -1, np.int32)

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(hashes)
        while self.slots + n > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[self.slots : self.slots + n] = self.used + np.cumsum(counts) - counts
        self.count[self.slots : self.slots + n] = counts
        # Both runs are sorted, which a stable sort merges.
        keys, slots = np.concatenate([self.keys, hashes]), np.concatenate([self.slot_of, np.arange(self.slots, self.slots + n, dtype=np.int32)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot_of = keys[order], slots[order]
        self.slots, self.used = self.slots + n, self.used + len(ids)

    def ids_of(self, parts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after another, and how many each has; joined ones are encoded as one text first."""
        ids, counts = [], []
        for at in range(0, len(parts), 512):
            part = parts[at : at + 512]
            if joined:
                own = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
                many = np.diff(np.flatnonzero(self.is_end[own]), prepend=-1)
            if not joined or len(many) != len(part) or many.sum() != len(own):
                each = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                own, many = np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each])
            ids.append(own)
            counts.append(many)
        return np.concatenate(ids), np.concatenate(counts)

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: bool) -> np.ndarray:
        """The slots of spans of bytes, words or pieces; those not known yet are encoded."""
        hashes = span_hashes(data, starts, ends)
        distinct, first, which = np.unique(mix(hashes) if words else hashes, return_index=True, return_inverse=True)
        slots = self.slots_of(distinct)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            self.add(distinct[fresh], *self.ids_of([data[starts[k] : ends[k]].tobytes().decode() for k in first[fresh].tolist()], not words))
            slots = self.slots_of(distinct)
        return slots[which]

    def gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, count = self.begin[slots].astype(np.int64), self.count[slots].astype(np.int64)
        ends = np.cumsum(count)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - begin, count)], ends

    def of_words(self, data: np.ndarray) -> np.ndarray:
        ink = np.concatenate([[False], (data != 32) & (data != 10) & (data != 9), [False]])
        edges = np.flatnonzero(ink[1:] != ink[:-1])
        return self.gathered(np.append(self.found(data, edges[::2], edges[1::2], True), 0) if len(edges) else np.zeros(1, np.int64))[0]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids, END_ID last, of each text of a slice."""
        if self.slots > MEMORY:
            self.forget()
        n = len(offsets) - 1
        original = data
        data, kind, odd = classes(data)
        upto = np.concatenate([[0], np.cumsum(odd)])[offsets]
        plain = upto[1:] == upto[:-1]
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        inner = offsets[1:-1]
        new[inner[inner < len(data)]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        text = np.searchsorted(offsets, starts, "right") - 1
        use = (kind[starts] != SPACE) & plain[text]
        starts, ends, text = starts[use], ends[use], text[use]
        slots = self.found(data, starts, ends, False) if len(starts) else np.zeros(0, np.int64)
        # Each text's pieces, then the slot of END_ID.
        per = np.bincount(text, minlength=n)
        last = np.cumsum(per) + np.arange(n)
        order = np.zeros(len(text) + n, np.int64)
        is_piece = np.ones(len(order), bool)
        is_piece[last] = False
        order[is_piece] = slots
        ids, ends_at = self.gathered(order)
        bounds = np.concatenate([[0], ends_at[last]])
        return [ids[bounds[k] : bounds[k + 1]] if plain[k] else self.of_words(original[offsets[k] : offsets[k + 1]]) for k in range(n)]


SPACE, LETTER, DIGIT, SIGN, ODD_BYTE = range(5)
KIND = np.full(256, ODD_BYTE, np.uint8)
KIND[33:127], KIND[48:58], KIND[65:91], KIND[97:123], KIND[[9, 10, 13, 32]] = SIGN, DIGIT, LETTER, LETTER, SPACE
KIND[39] = ODD_BYTE  # an apostrophe may begin a piece with letters in it


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, the kind of each, and which ones numpy does not cut by."""
    kind, low = KIND[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    letter = (after != 0x97) & (after != 0xB7)  # not the signs for times and divided by
    lead, after = lead[letter], after[letter]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead + 1] = np.where(after <= 0x9E, after + 32, after)
    odd = kind == ODD_BYTE
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # may begin a special token
    return low, kind, odd


_IDS: dict[str, Ids] = {}


def ids_at(path: str) -> Ids:
    """This worker's Ids, kept from task to task."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def place(start: np.ndarray, upto: list[np.ndarray], limits: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length) that hold each token of each example once, from its start on.

    upto: of each example, the loss-bearing tokens before each token (one more at the end); limits: tokens, segments,
    loss-bearing tokens of a sequence.
    """
    start = start.astype(np.int64)
    need = np.stack([[len(u) - 1 - a for u, a in zip(upto, start)], np.ones(len(upto)), [u[-1] - u[a] for u, a in zip(upto, start)]], axis=1).astype(float)
    order = np.argsort(-need[:, 0], kind="stable")
    live = order[need[order, 0] > 0]
    room, inside = limits.astype(float), []
    while len(live):
        own = need[live]
        fits = (own <= room).all(axis=1)
        score = (own / limits) @ (room / limits)
        if fits.any():
            k = int(np.argmax(np.where(fits, score, -1)))
            j = int(live[k])
            inside.append((j, int(start[j]), int(need[j, 0])))
            room = room - need[j]
            live = np.delete(live, k)
            if room[0] > 0 and room[1] >= 1:
                continue
        elif room[1] >= 1:
            # None fits whole: the head of the best one, as long as the loss-bearing tokens in it fit.
            j = int(live[int(np.argmax(score))])
            most = int(np.searchsorted(upto[j], upto[j][start[j]] + room[2], "right")) - 1 - int(start[j])
            cut = min(int(room[0]), most)
            if cut > 0:
                inside.append((j, int(start[j]), cut))
                need[j, 0] -= cut
                need[j, 2] -= upto[j][start[j] + cut] - upto[j][start[j]]
                start[j] += cut
        if inside:
            yield inside
        room, inside = limits.astype(float), []
    if inside:
        yield inside


def tidy(sequence: list[tuple[int, int, int]], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """The sequence, or if it would be padded, sequences of power-of-two lengths with the same pieces in order."""
    total = sum(x[2] for x in sequence)
    if total == length:
        yield sequence
        return
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        part = []
        while want:
            example, start, n = sequence[0]
            take = min(n, want)
            part.append((example, start, take))
            sequence = sequence[1:] if take == n else [(example, start + take, n - take), *sequence[1:]]
            want -= take
        yield part


def pack_group(examples: list[tuple[int | None, np.ndarray, np.ndarray]], length: int = LENGTH, segments: int = SEGMENTS, most_loss: int | None = None) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(sequence, pieces) of a group of examples (doc_id, ids, loss-bearing tokens before each); pieces are (example, start, length)."""
    limits = np.array([length, segments, most_loss or length])
    k = 0
    rests = np.zeros(len(examples), np.int64)
    for x, (_, ids, upto) in enumerate(examples):
        while rests[x] + length <= len(ids) and upto[rests[x] + length] - upto[rests[x]] <= limits[2]:
            yield k, [(x, int(rests[x]), length)]
            k, rests[x] = k + 1, rests[x] + length
    for sequence in place(rests, [upto for _, _, upto in examples], limits):
        for part in tidy(sequence, length):
            yield k, part
            k += 1


def bearing(runs: list[dict], offsets: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (first and last character) begin in a run that bears loss; what lies beyond the runs bears none."""
    ends = np.cumsum([r["length"] for r in runs] or [0])
    on = np.array([bool(r["loss"]) for r in runs] + [False])
    return on[np.minimum(np.searchsorted(ends, [a for a, _ in offsets], "right"), len(runs))] if offsets else np.zeros(0, bool)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, segments: int = SEGMENTS, with_ids: bool = False, loss: str | None = None, most_loss: int | None = None) -> DataFrame:
    """One row of SCHEMA for each piece; with_ids adds its ids.

    loss names a column of runs of characters (array of structs of length and loss, as chat.formatted gives); without
    it all of a text bears loss. The end id bears none. A sequence has most_loss loss-bearing tokens at most, or
    as many as it has tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, made = ids_at(tokenizer_path), TaskContext.get().partitionId(), 0
        group: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows: list[tuple] = []
            taken: list[np.ndarray] = []
            sequences = 0
            for k, pieces in pack_group(group, length, segments, most_loss):
                offset, sequences = 0, k + 1
                for x, start, n in pieces:
                    doc_id, ids, _ = group[x]
                    piece = ids[start : start + n]
                    rows.append((doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), (part << 40) + made + k, offset))
                    taken += [piece] * with_ids
                    offset += n
            made += sequences
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in taken])]), pa.int32()), pa.array(np.concatenate(taken).astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            doc_ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for at, to, data, offsets in slices(batch.column("text"), SLICE):
                runs = batch.column(loss).slice(at, to - at).to_pylist() if loss else None
                for k, (doc_id, encoded) in enumerate(zip(doc_ids[at:to], encoder.of(data, offsets) if not loss else [None] * (to - at))):
                    upto = np.arange(len(encoded) + 1, dtype=np.int32) if not loss else None
                    if loss:
                        own = encoder.tokenizer.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False)
                        encoded = np.array([*own.ids, END_ID], "<u4")
                        upto = np.concatenate([[0], np.cumsum(bearing(runs[k] or [], own.offsets)), [0]]).astype(np.int32)
                    upto[-1] = upto[-2]
                    group.append((doc_id, encoded, upto))
                    held += len(encoded)
                    if held >= GROUP_TOKENS or len(group) >= GROUP_EXAMPLES:
                        yield flush()
                        group, held = [], 0
        if group:
            yield flush()
        release()

    return docs.select("doc_id", "text", *([loss] if loss else [])).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
