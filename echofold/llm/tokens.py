"""Token ids of whole texts with the ``tokenizers`` library, inside Arrow batches.

Both vocabularies split a text into pieces before any merge, and a piece never reaches across the
borders used here, so a text's ids are the ids of its pieces in order. Pieces repeat: every distinct
one is encoded once by the library and kept in a bounded cache; the rest is array work. Texts to
which that reasoning does not apply are encoded whole.
"""

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Pieces kept between batches, in one Python worker.
CACHED_PIECES = 400_000
# Longer pieces are rare and not kept.
_LONGEST_CACHED = 64
# Pieces encoded by one call.
_RUN = 500
_PUNCTUATION = ",.;:!?"
# Texts per step of a batch, in bytes.
STEP_BYTES = 4 << 20

# Where the split on single blanks and line ends would not meet the vocabulary's own: white space
# beside a blank or a line end, and the marks of special tokens.
_UNICODE_SPACE = r"\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ANY_SPACE = r"[\s\x0B" + _UNICODE_SPACE + "]"
_BLANK_PIECES_FAIL = rf"{_ANY_SPACE}[ \n]|\n{_ANY_SPACE}|^{_ANY_SPACE}|{_ANY_SPACE}$|<\|"
_WORD_PIECES_FAIL = r"[\x1C-\x1F]|<\|"


class Encoder:
    """Ids of many texts at once.

    ``blanks``: the vocabulary keeps a blank as part of the word behind it (byte-level BPE);
    otherwise white space is dropped (BPE with word ends).

    Known pieces are numbered; the ids of all of them lie in one array, so the ids of a text are
    gathered by its pieces' numbers without touching them one by one.
    """

    def __init__(self, path: str, blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks = blanks
        # A mark is a piece of its own to the vocabulary wherever it stands between two others.
        self.mark, self.between = ("\n", "\n") if blanks else ("~", " ~ ")
        (self.mark_id,) = self._whole([self.mark])[0].tolist()
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype="<u4")
        self.starts = np.zeros(1, dtype=np.int64)
        self._add(list(_PUNCTUATION), *self._many(list(_PUNCTUATION)))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Number new pieces, whose ids follow each other."""
        first, end = len(self.starts) - 1, int(self.starts[-1])
        if end + len(ids) > len(self.flat):
            grown = np.zeros(2 * (end + len(ids)), dtype="<u4")
            grown[:end] = self.flat[:end]
            self.flat = grown
        self.flat[end : end + len(ids)] = ids
        self.starts = np.concatenate([self.starts, end + np.cumsum(lengths)])
        self.numbers.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and where each one's begin and end."""
        starts = self.starts[numbers]
        ends = np.concatenate([[0], np.cumsum(self.starts[numbers + 1] - starts)])
        source = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], np.diff(ends))
        return self.flat[source], ends

    def _many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces, many with one call; an empty piece or one with the mark is encoded alone."""
        alone = [i for i, p in enumerate(pieces) if not p or self.mark in p]
        texts = [pieces[i] for i in alone]
        rest = [p for p in pieces if p and self.mark not in p] if alone else pieces
        runs = [self.between.join(rest[a : a + _RUN]) for a in range(0, len(rest), _RUN)]
        joined = [np.append(ids, self.mark_id) for ids in self._whole(runs)]
        ids = np.concatenate([*joined, np.zeros(0)]).astype("<u4")
        marks = ids == self.mark_id
        lengths = np.diff(np.flatnonzero(marks), prepend=-1) - 1
        ids = ids[~marks]
        if alone:
            own = self._whole(texts)
            other = np.setdiff1d(np.arange(len(pieces)), alone)
            parts = np.split(ids, np.cumsum(lengths)[:-1]) if len(other) else []
            placed = dict(zip([*other.tolist(), *alone], [*parts, *own], strict=True))
            found = [placed[i] for i in range(len(pieces))]
            ids, lengths = np.concatenate(found), np.array([len(f) for f in found])
        return ids, lengths

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece; new ones are encoded. ``pieces`` are distinct."""
        if len(self.numbers) > CACHED_PIECES or len(self.flat) > 8 * CACHED_PIECES:
            self._forget()
        numbers = self.numbers
        missing = [p for p in pieces if p not in numbers]
        if missing:
            # A last punctuation mark behind a letter or digit is a piece of its own.
            marked = [p for p in missing if len(p) > 1 and p[-1] in _PUNCTUATION and p[-2].isalnum()]
            plain = set(missing).difference(marked)
            stems = [p[:-1] for p in marked]
            unknown = [p for p in dict.fromkeys([*plain, *stems]) if p not in numbers]
            if unknown:
                self._add(unknown, *self._many(unknown))
            if marked:
                both = np.array([n for p in marked for n in (numbers[p[:-1]], numbers[p[-1]])])
                ids, ends = self._gather(both)
                self._add(marked, ids, np.diff(ends[::2]))
        return np.fromiter(map(numbers.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _BLANK_PIECES_FAIL if self.blanks else _WORD_PIECES_FAIL)
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist()) if odd.any() else []
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        ids, counts = self._split(plain)
        if not whole:
            return ids, counts
        # Texts encoded whole have no ids yet: put theirs in between.
        at = np.flatnonzero(odd)
        ends = np.cumsum(counts)[at]
        parts, begin = [], 0
        for end, own in zip(ends.tolist(), whole, strict=True):
            parts += [ids[begin:end], own]
            begin = end
        counts[at] = [len(own) for own in whole]
        return np.concatenate([*parts, ids[begin:]]), counts

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.blanks:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        borders = np.asarray(lists.offsets)
        flat = lists.values.slice(borders[0], borders[-1] - borders[0])
        borders = borders - borders[0]
        if not len(flat):
            return np.zeros(0, dtype="<u4"), np.diff(borders)
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if self.blanks:
            # Behind a blank, unless first in the text or in its line; a line end stands for itself.
            first = np.zeros(len(codes), dtype=bool)
            first[borders[:-1][borders[:-1] < len(codes)]] = True
            line_end = codes == (words.index("\n") if "\n" in words else -1)
            first[1:] |= line_end[:-1]
            codes = codes * 2 + (first | line_end)
            used = np.flatnonzero(np.bincount(codes, minlength=2 * len(words)))
            place = np.zeros(2 * len(words), dtype=np.int64)
            place[used] = np.arange(len(used))
            codes = place[codes]
            words = [words[u >> 1] if u & 1 else " " + words[u >> 1] for u in used.tolist()]
        ids, ends = self._gather(self._numbers(words)[codes])
        return ids, np.diff(ends[borders])


@lru_cache(maxsize=2)
def encoder(path: str, blanks: bool) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path, blanks)
