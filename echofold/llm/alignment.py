"""Aligning the tokens of two vocabularies, with corpus-wide counts of linked id pairs.

Both vocabularies tokenize a blank and the text. Where a token of A and a token of B end at the same
byte, the text is cut into groups; inside a group, tokens whose bytes overlap are linked. A link's count
is the number of documents that link its two ids somewhere.

The first pass aligns all documents and counts each task's id pairs, once per document. The distinct
pairs get a minimal perfect hash: they are dealt into segments by a hash, and inside a segment
(``minimal_perfect_hash``) every pair has its own place, without gaps. A task's counts of a segment are
then a dense vector by place, and vectors are summed in a tree until one is left per segment. Pairs lie
beside the counts in the same order, so a looked-up pair is verified. The second pass aligns the
documents again and looks the pairs up.

Tasks of the second pass get the table in parts of at most ``PART_SEGMENTS`` segments (some 80 MB); if
there are more parts, there are more passes, whose sums are added up. Nothing but these parts and one
number per id of A goes through the driver.

Neither vocabulary has a token that spans a blank or a line end between two other characters, so a text
is aligned unit by unit between these, and a worker keeps the units that it met last. Other white space
stays inside a unit, and a unit is encoded by the libraries as a whole. Texts that are null, empty, or
whose tokens do not give back the text have no tokens: zeros and an empty digest. Rows that repeat a
``doc_id`` are documents of their own, in the counts too; ids may be null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.tables import stage

# Pairs of a segment, about, and segments that a task holds at once.
SEGMENT_PAIRS = 8_192
PART_SEGMENTS = 512
# Pairs of a bucket of the perfect hash, about.
BUCKET_PAIRS = 4
# Vectors summed by one task, and counted pairs made into one vector.
FAN_IN = 128
VECTOR_PAIRS = 1 << 18
# Units a worker keeps, and pairs a task holds before it passes their counts on.
KEPT_UNITS = 400_000
HELD_PAIRS = 1 << 21
# Units encoded by one call.
_RUN = 1_000
# Longer texts are aligned in slices of about so many characters.
SLICE_CHARS = 1 << 20

# A pair is one number: the id of A above the bits of the id of B.
_B_BITS = 17
_A_IDS = 1 << 17
_PAIR_BITS = 34

# White space to either library, or to Python.
_SPACE = "\\s\u180e\u200b"
# Units border on a blank or a line end that stands alone between other characters.
_BORDER = re.compile(
    rf"(?<=[^{_SPACE}])(?= [^{_SPACE}])|(?<=[^{_SPACE}])(?=\n[^{_SPACE}])|(?<=[^{_SPACE}]\n)(?=[^{_SPACE}])"
)
# Units that can be encoded as a line of a text.
_PLAIN = re.compile(rf" ?[^{_SPACE}](?:[^\n]*[^{_SPACE}])?")
# Texts in which one does not stand alone; the white space written out, as Arrow knows only that of ASCII.
_WIDE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
_ODD = rf"{_WIDE}[ \n]|[ \n]{_WIDE}|^{_WIDE}|{_WIDE}$"

ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
    "count_sum bigint, groups_sha256 string"
)


def mix(keys: np.ndarray) -> np.ndarray:
    """A well-spread 63-bit number for each key; different keys get different 64-bit numbers before the cut."""
    x = np.atleast_1d(keys).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


# --- a minimal perfect hash ---


def _bucket(hashes: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    # Mixed once more: the hash itself has dealt the keys into segments.
    return (mix(hashes) % np.asarray(n, dtype=np.uint64)).astype(np.int64)


def _places(hashes: np.ndarray, pilot: int | np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes ^ mix(np.asarray(pilot, dtype=np.uint64) + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def minimal_perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the buckets, and the distinct keys in the order of their places.

    Keys are hashed into buckets. From the largest bucket down, pilots are tried until one sends all
    keys of the bucket to free places. A bucket of a single key takes any free place, written as
    ``-1 - place``.
    """
    n = len(keys)
    hashes = mix(keys)
    n_buckets = max(1, n // BUCKET_PAIRS)
    bucket = _bucket(hashes, n_buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    pilots, taken = np.zeros(n_buckets, dtype=np.int64), np.zeros(n, dtype=bool)
    placed = np.zeros(n, dtype=np.int64)
    singles = []
    for b in np.argsort(-sizes, kind="stable").tolist():
        members = order[ends[b] - sizes[b] : ends[b]]
        if len(members) == 1:
            singles.append((b, members[0]))
        if len(members) < 2:
            continue
        first, tries = 0, 64
        while True:
            every = np.arange(first, first + tries)
            found = np.sort(_places(hashes[members][None, :], every[:, None], n), axis=1)
            free = ~taken[found].any(axis=1) & (np.diff(found, axis=1) > 0).all(axis=1)
            if free.any():
                pilots[b] = first + int(free.argmax())
                break
            first, tries = first + tries, 2 * tries
        placed[members] = _places(hashes[members], pilots[b], n)
        taken[placed[members]] = True
    for (b, member), place in zip(singles, np.flatnonzero(~taken).tolist(), strict=True):
        pilots[b], placed[member] = -1 - place, place
    at = np.empty(n, dtype=keys.dtype)
    at[placed] = keys
    return pilots, at


def places(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """The place of each key among the ``n`` that the hash was made for; any place for other keys."""
    hashes = mix(keys)
    pilot = pilots[_bucket(hashes, len(pilots))]
    return np.where(pilot < 0, -1 - pilot, _places(hashes, np.maximum(pilot, 0), n))


# --- units ---


# Fixed values of byte-level vocabularies: how texts are split before any merge, and the bytes that stand
# for themselves; the others are written as the characters from 256 on, in order.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_level(path: str):
    """An encoder of a byte-level vocabulary file, and the bytes of every id.

    Merges are numbered in their order of use, so the ids serve as ranks. Special tokens are no entries:
    their strings are plain text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    others = sorted(set(range(256)).difference(_PRINTABLE))
    alphabet = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ranks = [model["vocab"][m] for m in merges]
    if any(x >= y for x, y in zip(ranks, ranks[1:], strict=False)):
        raise ValueError(f"the ids of {path} are not in the order of its merges")
    by_id = {i: bytes(alphabet[c] for c in entry) for entry, i in model["vocab"].items() if set(entry) <= set(alphabet)}
    used = set(ranks)
    entries = {b: i for i, b in by_id.items() if len(b) == 1 or i in used}
    encoder = tiktoken.Encoding("byte-level", pat_str=_SPLIT, mergeable_ranks=entries, special_tokens={})
    return encoder, [by_id.get(i, b"") for i in range(max(by_id) + 1)]


class _Tokens:
    """The ids of several units in a row, how many each has, and where they end."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts, self.ends = ids, counts, np.cumsum(counts)

    @classmethod
    def of_lists(cls, lists: list[list[int]]) -> _Tokens:
        return cls(np.array([i for own in lists for i in own], dtype=np.int64), np.array(list(map(len, lists)), dtype=np.int64))

    @classmethod
    def of_lines(cls, ids: np.ndarray, line: int) -> _Tokens:
        """Units that have a line end before each."""
        begins = ids == line
        counts = np.diff(np.append(np.flatnonzero(begins), len(ids))) - 1
        return cls(ids[~begins], counts)

    def and_then(self, other: _Tokens) -> _Tokens:
        return _Tokens(np.concatenate([self.ids, other.ids]), np.concatenate([self.counts, other.counts]))

    def of(self, units: np.ndarray) -> _Tokens:
        """Some of the units, in the given order."""
        counts = self.counts[units]
        first = self.ends[units] - counts
        return _Tokens(self.ids[np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)], counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.ends], prepend=0)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Aligner:
    """Units of texts with their tokens in both vocabularies; those met last are kept.

    Per unit: whether both vocabularies give it back, its numbers of tokens, groups and links, its
    groups as text, and its distinct pairs with the links of each.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.a_bytes = _byte_level(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # Ids of a line end, and every id as text with what may follow it.
        self.a_line, self.b_line = self.a.encode_ordinary("\n")[0], self.b.encode("\n")[1]
        ids = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.widths = np.array([len(i) + 1 for i in ids])
        inner, a_last, b_last = ([i + mark for i in ids] for mark in ",|;")
        self.a_written, self.b_written = np.array([inner, a_last], dtype=object), np.array([inner, b_last], dtype=object)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((0, 5), dtype=np.int64)  # valid, tokens of A, of B, groups, links
        self.pairs, self.links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ends = np.zeros(1, dtype=np.int64)

    def _encode(self, units: list[str]) -> tuple[_Tokens, _Tokens]:
        """The ids of units: many with one call, as lines of a text, where white space allows it."""
        plain = [i for i, unit in enumerate(units) if _PLAIN.fullmatch(unit)]
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for start in range(0, len(plain), _RUN):
            # B puts a blank before the first line end.
            text = "\n".join(["", *(units[i] for i in plain[start : start + _RUN])])
            a.append(self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64))
            b.append(np.array(self.b.encode(text)[1:], dtype=np.int64))
        a, b = _Tokens.of_lines(np.concatenate(a), self.a_line), _Tokens.of_lines(np.concatenate(b), self.b_line)
        if len(plain) == len(units):
            return a, b
        alone = sorted(set(range(len(units))).difference(plain))
        own = _Tokens.of_lists([self.a.encode_ordinary(units[i]) for i in alone])
        order = np.argsort(np.array(plain + alone))
        # A unit that begins with a blank goes to B without it; for another one, the blank and a line
        # end, which join nothing, are taken off again.
        found = [self.b.encode(units[i][1:]) if units[i][0] == " " else self.b.encode("\n" + units[i])[2:] for i in alone]
        return a.and_then(own).of(order), b.and_then(_Tokens.of_lists(found)).of(order)

    def _valid(self, units: list[str], a: _Tokens, b: _Tokens) -> np.ndarray:
        """Whether the tokens of either vocabulary give back each unit."""
        data = [u.encode() for u in units]
        sizes = np.array(list(map(len, data)))
        found = np.ones(len(units), dtype=bool)
        for tokens, table, lengths in ((a, self.a_bytes, self.a_sizes), (b, self.b_bytes, self.b_sizes)):
            if (tokens.sums(lengths[tokens.ids]) == sizes).all():
                if b"".join(map(table.__getitem__, tokens.ids.tolist())) == b"".join(data):
                    continue
            lists = np.split(tokens.ids, tokens.ends[:-1])
            found &= [b"".join(map(table.__getitem__, t.tolist())) == d for t, d in zip(lists, data, strict=True)]
        return found

    def _add(self, units: list[str]) -> None:
        a, b = self._encode(units)
        valid = self._valid(units, a, b)
        sound = np.flatnonzero(valid)
        facts = np.zeros((len(units), 5), dtype=np.int64)
        facts[:, 0] = valid
        facts[:, 1], facts[:, 2] = np.where(valid, a.counts, 0), np.where(valid, b.counts, 0)
        texts = [""] * len(units)
        pair = links = np.zeros(0, dtype=np.int64)
        per_unit = np.zeros(len(units), dtype=np.int64)
        if len(sound):
            if len(sound) < len(units):
                a, b = a.of(sound), b.of(sound)
            a_end, b_end = np.cumsum(self.a_sizes[a.ids]), np.cumsum(self.b_sizes[b.ids])
            # Groups end where a token of A and one of B do.
            common = np.intersect1d(a_end, b_end, assume_unique=True)
            a_cut, b_cut = np.searchsorted(a_end, common) + 1, np.searchsorted(b_end, common) + 1
            facts[sound, 3] = np.diff(np.searchsorted(a_cut, a.ends, side="right"), prepend=0)
            for unit, text in zip(sound.tolist(), self._group_texts(a, b, a_cut, b_cut), strict=True):
                texts[unit] = text
            # Tokens of B that overlap a token of A: from the first to end behind its start to the
            # first to end at or behind its end.
            low = np.searchsorted(b_end, np.concatenate([[0], a_end[:-1]]), side="right")
            each = np.searchsorted(b_end, a_end, side="left") + 1 - low
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - low, each)
            pair = (np.repeat(a.ids, each) << _B_BITS) | b.ids[at]
            unit = np.repeat(np.repeat(sound, a.counts), each)
            facts[:, 4] = np.bincount(unit, minlength=len(units))
            order = np.lexsort((pair, unit))
            pair, unit = pair[order], unit[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(unit) != 0)]))
            pair, links = pair[new], np.diff(np.append(new, len(pair)))
            per_unit = np.bincount(unit[new], minlength=len(units))
        self.numbers.update(zip(units, range(len(self.numbers), len(self.numbers) + len(units)), strict=True))
        self.groups += texts
        self.facts = np.concatenate([self.facts, facts])
        self.pairs, self.links = np.concatenate([self.pairs, pair]), np.concatenate([self.links, links])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(per_unit)])

    def _group_texts(self, a: _Tokens, b: _Tokens, a_cut: np.ndarray, b_cut: np.ndarray) -> Iterator[str]:
        """The groups of each unit as text, each group with a semicolon behind it.

        A group is its tokens of A and then those of B, so a token's place in the whole text follows
        from the groups before it, and what comes behind it from whether it is the last of its kind.
        """
        a_at, b_at = np.arange(len(a.ids)), np.arange(len(b.ids))
        a_place = a_at + np.concatenate([[0], b_cut])[np.searchsorted(a_cut, a_at, side="right")]
        b_place = b_at + a_cut[np.searchsorted(b_cut, b_at, side="right")]
        a_last, b_last = np.zeros(len(a.ids), dtype=np.int64), np.zeros(len(b.ids), dtype=np.int64)
        a_last[a_cut - 1], b_last[b_cut - 1] = 1, 1
        written = np.empty(len(a.ids) + len(b.ids), dtype=object)
        written[a_place], written[b_place] = self.a_written[a_last, a.ids], self.b_written[b_last, b.ids]
        text = "".join(written.tolist())
        lengths = np.zeros(len(written), dtype=np.int64)
        lengths[a_place], lengths[b_place] = self.widths[a.ids], self.widths[b.ids]
        ends = np.cumsum(lengths)[a.ends + b.ends - 1].tolist()
        return map(text.__getitem__, map(slice, [0, *ends[:-1]], ends))

    def number(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units in a row, and where each list's begin. Numbers hold until the next call."""
        if len(self.numbers) > KEPT_UNITS:
            self.forget()
        numbers = self.numbers
        missing = [u for u in dict.fromkeys(chain.from_iterable(lists)) if u not in numbers]
        if missing:
            self._add(missing)
        starts = np.cumsum([0, *map(len, lists)])
        flat = map(numbers.__getitem__, chain.from_iterable(lists))
        return np.fromiter(flat, dtype=np.int64, count=starts[-1]), starts[:-1]

    def valid(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether both vocabularies give back all units of each list."""
        return np.minimum.reduceat(self.facts[numbers, 0], starts) > 0

    def pairs_of(self, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of each list, and which list each belongs to."""
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(numbers))))
        seen = _distinct((owner << 32) | numbers)
        owner, numbers = seen >> 32, seen & 0xFFFFFFFF
        first, counts = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        at = np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)
        seen = _distinct((np.repeat(owner, counts) << _PAIR_BITS) | self.pairs[at])
        return seen & ((1 << _PAIR_BITS) - 1), seen >> _PAIR_BITS


def units_of(text: str, odd: bool) -> list[str]:
    """The units of a blank and a text, in order. ``odd`` texts have blanks or line ends beside white space."""
    if odd:
        return _BORDER.split(" " + text)
    units = []
    for line in text.split("\n"):
        if units:
            units.append("\n")
        words = line.split(" ")
        units.append(words[0] if units else " " + words[0])
        units += map(" ".__add__, words[1:])
    return units


def _slices(text: str) -> Iterator[list[str]]:
    """The units of a long text, in runs that belong to about ``SLICE_CHARS`` characters."""
    start, text = 0, " " + text
    while start < len(text):
        border = _BORDER.search(text, start + SLICE_CHARS)
        end = border.start() if border else len(text)
        yield _BORDER.split(text[start:end])
        start = end


def _steps(texts: pa.Array) -> Iterator[tuple[list[int], list[list[str]], bool]]:
    """Units of the texts that have any, about ``SLICE_CHARS`` characters at a time.

    Yields places of texts, the units of each, and whether the text goes on in the next step; a text of
    several steps has these to itself.
    """
    rows, lists, size = [], [], 0
    odd = pc.match_substring_regex(texts, _ODD).to_pylist()
    for row, (value, is_odd) in enumerate(zip(texts, odd, strict=True)):
        text = value.as_py()
        if not text:
            continue
        if len(text) > SLICE_CHARS:
            before = None
            for units in _slices(text):
                if before:
                    yield [row], [before], True
                before = units
            yield [row], [before], False
            continue
        if size + len(text) > SLICE_CHARS:
            yield rows, lists, False
            rows, lists, size = [], [], 0
        rows.append(row)
        lists.append(units_of(text, is_odd))
        size += len(text)
    if rows:
        yield rows, lists, False


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker."""
    return Aligner(a_path, b_path)


class _Counts:
    """A task's documents by pair; parts are merged as soon as they hold twice as much as after the last time."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.merged = 0

    def add(self, pairs: np.ndarray) -> None:
        self.parts.append(np.unique(pairs, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > max(2 * self.merged, HELD_PAIRS // 2):
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            pairs, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            distinct, at = np.unique(pairs, return_inverse=True)
            self.parts = [(distinct, np.bincount(at, weights=n).astype(np.int64))]
            self.held = self.merged = len(distinct)


def _count_pairs(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """The first pass: documents by pair, once per task or whenever a task holds many pairs."""
    align, counts, flushed = aligner(a_path, b_path), _Counts(), 0
    part = TaskContext.get().partitionId() << 24

    def flush() -> pa.RecordBatch:
        counts.merge()
        pairs, n = counts.parts[0] if counts.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        spread = mix(pairs).astype(np.int64)
        columns = [pa.array(np.full(len(pairs), part + flushed)), pa.array(spread), pa.array(pairs), pa.array(n)]
        return pa.record_batch(columns, names=["part", "spread", "pair", "n"])

    for batch in batches:
        # The distinct pairs of a text of several steps, as far as they are known.
        begun: np.ndarray | None = None
        whole = True
        for _, lists, goes_on in _steps(batch.column("text")):
            numbers, starts = align.number(lists)
            valid = align.valid(numbers, starts)
            pairs, owner = align.pairs_of(numbers, starts)
            if goes_on or begun is not None:
                begun = pairs if begun is None else np.union1d(begun, pairs)
                whole &= bool(valid[0])
                if goes_on:
                    continue
                pairs, owner, valid = begun, np.zeros(len(begun), dtype=np.int64), np.array([whole])
                begun, whole = None, True
            counts.add(pairs[valid[owner]])
            if counts.held > HELD_PAIRS:
                yield flush()
                counts, flushed = _Counts(), flushed + 1
    yield flush()


def _hash_segment(key: tuple, group: pa.Table) -> pa.Table:
    pilots, keys = minimal_perfect_hash(group.column("pair").to_numpy())
    return pa.table({"segment": [key[0].as_py()], "pilots": [pilots.astype("<i4").tobytes()], "pairs": [keys.astype("<i8").tobytes()]})


HASHED = "segment bigint, pilots binary, pairs binary"


def _count_vector(key: tuple, counted: pa.Table, hashed: pa.Table) -> pa.Table:
    """The counts of some tasks for one segment, by place."""
    (pilots,), (pairs,) = hashed.column("pilots").to_pylist(), hashed.column("pairs").to_pylist()
    found = counted.column("pair").to_numpy()
    n = len(pairs) // 8
    at = places(found, np.frombuffer(pilots, dtype="<i4").astype(np.int64), n)
    vector = np.bincount(at, weights=counted.column("n").to_numpy(), minlength=n).astype("<i8")
    return pa.table({"segment": [key[0].as_py()], "branch": [key[1].as_py()], "counts": [vector.tobytes()]})


def _sum_vectors(key: tuple, group: pa.Table) -> pa.Table:
    vectors = [np.frombuffer(v, dtype="<i8") for v in group.column("counts").to_pylist()]
    return pa.table({"segment": [key[0].as_py()], "branch": [key[1].as_py()], "counts": [sum(vectors).astype("<i8").tobytes()]})


VECTORS = "segment bigint, branch bigint, counts binary"


def pair_table(partial_counts: DataFrame) -> DataFrame:
    """All pairs with their counts, as one row per segment: segment, pilots, pairs, counts.

    ``partial_counts`` has (part, spread, pair, n), each pair at most once per part.
    """
    distinct = stage(partial_counts.select("pair", "spread").distinct(), "pairs")
    n_segments = max(1, -(-distinct.count() // SEGMENT_PAIRS))
    segment = (F.col("spread") % n_segments).alias("segment")
    hashed = stage(distinct.select(segment, "pair").groupBy("segment").applyInArrow(_hash_segment, HASHED), "pair-hash")
    # As many branches as make groups of about VECTOR_PAIRS rows.
    n_branches = max(1, -(-partial_counts.count() // (n_segments * VECTOR_PAIRS)))
    branch = F.pmod(F.xxhash64("part"), F.lit(n_branches)).alias("branch")
    counted = partial_counts.select(segment, branch, "pair", "n")
    used = counted.select(F.col("segment").alias("of"), F.col("branch").alias("by")).distinct()
    used = used.join(hashed, F.col("of") == F.col("segment")).select("of", "by", "pilots", "pairs")
    vectors = counted.groupBy("segment", "branch").cogroup(used.groupBy("of", "by"))
    vectors = stage(vectors.applyInArrow(_count_vector, VECTORS), "pair-vectors")
    while n_branches > 1:
        n_branches = -(-n_branches // FAN_IN)
        upper = vectors.withColumn("branch", F.floor(F.col("branch") / FAN_IN)).groupBy("segment", "branch")
        vectors = stage(upper.applyInArrow(_sum_vectors, VECTORS), "pair-vectors")
    return stage(hashed.join(vectors.drop("branch"), "segment"), "pair-table")


def _segment_best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = np.zeros(_A_IDS, dtype=np.int64)
        for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            np.maximum.at(best, np.frombuffer(pairs, "<i8") >> _B_BITS, np.frombuffer(counts, "<i8"))
        a = np.flatnonzero(best)
        yield pa.record_batch([pa.array(a), pa.array(best[a])], names=["a", "best"])


def best_counts(table: DataFrame) -> np.ndarray:
    """The highest count of a pair by its id of A: one number per id of the vocabulary."""
    found = table.select("pairs", "counts").mapInArrow(_segment_best, "a bigint, best bigint")
    best = np.zeros(_A_IDS, dtype=np.int64)
    for row in found.groupBy("a").agg(F.max("best").alias("best")).collect():
        best[row["a"]] = row["best"]
    return best


class _Part:
    """Some segments of the pair table, for looking pairs up."""

    def __init__(self, n_segments: int, rows: list[tuple[int, bytes, bytes, bytes]], best: np.ndarray):
        self.n_segments, self.best = n_segments, best
        self.first = np.full(n_segments, -1, dtype=np.int64)
        self.size, self.first_pilot, self.n_pilots = (np.ones(n_segments, dtype=np.int64) for _ in range(3))
        pairs = pilots = 0
        for segment, own_pilots, own_pairs, _ in rows:
            self.first[segment], self.size[segment] = pairs, len(own_pairs) // 8
            self.first_pilot[segment], self.n_pilots[segment] = pilots, len(own_pilots) // 4
            pairs, pilots = pairs + len(own_pairs) // 8, pilots + len(own_pilots) // 4
        self.pilots = np.frombuffer(b"".join(r[1] for r in rows) or bytes(4), dtype="<i4")
        self.pairs = np.frombuffer(b"".join(r[2] for r in rows) or bytes(8), dtype="<i8")
        self.counts = np.frombuffer(b"".join(r[3] for r in rows) or bytes(8), dtype="<i8")

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, and whether it is the highest of its id of A; 0 for pairs of other parts."""
        hashes = mix(pairs)
        segment = (hashes % np.uint64(self.n_segments)).astype(np.int64)
        here = self.first[segment] >= 0
        bucket = _bucket(hashes, self.n_pilots[segment])
        pilot = self.pilots[np.where(here, self.first_pilot[segment] + bucket, 0)].astype(np.int64)
        hashed = mix(hashes ^ mix(np.maximum(pilot, 0).astype(np.uint64) + np.uint64(1)))
        inside = np.where(pilot < 0, -1 - pilot, (hashed % self.size[segment].astype(np.uint64)).astype(np.int64))
        at = np.where(here, self.first[segment] + inside, 0)
        known = here & (self.pairs[at] == pairs)
        counts = np.where(known, self.counts[at], 0)
        return counts, known & (counts == self.best[pairs >> _B_BITS])


class _UnitSums:
    """Sums over the links of each unit that an aligner keeps: links of the highest counts, and counts."""

    def __init__(self, part: _Part):
        self.part = part
        self.sums, self.of_numbers = np.zeros((0, 2), dtype=np.int64), None

    def of(self, align: Aligner) -> np.ndarray:
        if self.of_numbers is not align.numbers:
            self.sums, self.of_numbers = np.zeros((0, 2), dtype=np.int64), align.numbers
        known = len(self.sums)
        if known < len(align.ends) - 1:
            start, ends = align.ends[known], align.ends[known:] - align.ends[known]
            counts, best = self.part.look_up(align.pairs[start:])
            links = align.links[start:]
            run = np.zeros((len(links) + 1, 2), dtype=np.int64)
            np.cumsum(np.stack([links * best, links * counts], axis=1), axis=0, out=run[1:])
            self.sums = np.concatenate([self.sums, np.diff(run[ends], axis=0)])
        return self.sums


def _align(batches: Iterable[pa.RecordBatch], a_path: str, b_path: str, part: Broadcast) -> Iterator[pa.RecordBatch]:
    """The second pass: every document's alignment and its looked-up counts."""
    align, unit_sums = aligner(a_path, b_path), _UnitSums(part.value)
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    for batch in batches:
        sums = np.zeros((batch.num_rows, 6), dtype=np.int64)
        valid = np.zeros(batch.num_rows, dtype=bool)
        digests = [""] * batch.num_rows
        digest = None
        for rows, lists, goes_on in _steps(batch.column("text")):
            numbers, starts = align.number(lists)
            found = np.concatenate([align.facts[numbers, 1:], unit_sums.of(align)[numbers]], axis=1)
            sums[rows] += np.add.reduceat(found, starts, axis=0)
            own = align.valid(numbers, starts)
            valid[rows] = own if digest is None else own & valid[rows]
            for row, listed in zip(rows, np.split(numbers, starts[1:]), strict=True):
                text = "".join(map(align.groups.__getitem__, listed.tolist())).encode()
                if digest is None:
                    digest = hashlib.sha256()
                # The last group has no semicolon behind it.
                digest.update(text if goes_on else text[:-1])
                if not goes_on:
                    digests[row], digest = digest.hexdigest(), None
        sums[~valid] = 0
        digests = [d if own else "" for d, own in zip(digests, valid.tolist(), strict=True)]
        columns = [pa.array(sums[:, i]) for i in range(6)]
        yield pa.record_batch([batch.column("row"), batch.column("doc_id"), *columns, pa.array(digests, pa.string())], names=["row", *names])


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: numbers of tokens, groups and links, links of the highest counts, sum of counts, digest."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = partial(_count_pairs, a_path=a_path, b_path=b_path)
    counted = stage(texts.select("text").mapInArrow(count, "part bigint, spread bigint, pair bigint, n bigint"), "pair-counts")
    table = pair_table(counted)
    n_segments, best = max(1, table.count()), best_counts(table)
    if (n_parts := -(-n_segments // PART_SEGMENTS)) == 1:
        texts = texts.withColumn("row", F.lit(0).cast("bigint"))
    else:
        # Each pass must know a row again.
        texts = stage(texts.withColumn("row", F.monotonically_increasing_id()), "aligned-texts")
    passes = []
    for first in range(0, n_segments, PART_SEGMENTS):
        in_part = F.col("segment").between(first, first + PART_SEGMENTS - 1)
        rows = [tuple(map(bytes_or_number, r)) for r in table.filter(in_part).select("segment", "pilots", "pairs", "counts").collect()]
        part = spark.sparkContext.broadcast(_Part(n_segments, rows, best))
        look_up = partial(_align, a_path=a_path, b_path=b_path, part=part)
        passes.append(texts.mapInArrow(look_up, f"row bigint, {ALIGNED}"))
    if n_parts == 1:
        return passes[0].drop("row")
    found = stage(passes[0], "aligned")
    for other in passes[1:]:
        found = found.unionAll(stage(other, "aligned"))
    first = [c for c in found.columns if c not in ("row", "n_best", "count_sum")]
    summed = found.groupBy("row").agg(
        *[F.first(c).alias(c) for c in first], *[F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    )
    return summed.select(*[c.split()[0] for c in ALIGNED.split(", ")])


def bytes_or_number(value):
    return bytes(value) if isinstance(value, bytearray) else value


def op11_cross_tokenizer_alignment(spark: SparkSession, docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``documents`` aligned between the byte-level and the piece vocabulary."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(docs, a_path, b_path)
