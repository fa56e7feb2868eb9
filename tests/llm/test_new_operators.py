"""Alignment, resampling and SimHash groups against brute force: nulls, ties, repeats, long texts, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from echofold.llm import alignment, resampling, simhash

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
DRAW = random.Random(11)
SYLLABLES = ["ab", "the", "'s", " ", "  ", "\n", "\n\n", "\t", ".", ",", "1", "é", "　", "日", "😀", " of", " "]
TEXTS = [
    None, "", " ", "a", "a b", "a b", "a b", "  a", "a  b \n c", "x\n\ny", "▁x y", "<|endoftext|> hi\n<s>", "\u0085 z",
    "word " * 300, "A single Word\nAND more", "0123456789" * 30, "mixed é日本 \x00 text",
    *["".join(DRAW.choices(SYLLABLES, k=DRAW.randint(1, 30))) for _ in range(60)],
    *[" ".join(DRAW.choices(["alpha", "bravo", "charlie", "delta", "echo's"], k=DRAW.randint(15, 60))) for _ in range(40)],
]


def rows_of(spark, texts):
    """Rows with ids from 0, one null and one repeated id, and columns whose names the operators use inside."""
    ids = [None if i == 4 else 5 if i == 6 else i for i in range(len(texts))]
    rows = [(d, t, "en", "s", 1, "p", 2, "q", 3) for d, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, code string, row bigint, pair string, weight int"
    )


# --- alignment ---


def brute_alignment(texts):
    a_tok, b_tok = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_tok.encode_special_tokens = True
    alphabet, extra = {}, 256
    for byte in range(256):
        if 33 <= byte < 127 or 161 <= byte < 173 or byte >= 174:
            alphabet[chr(byte)] = byte
        else:
            alphabet[chr(extra)], extra = byte, extra + 1
    a_bytes = {i: bytes(alphabet[c] for c in entry) for entry, i in a_tok.get_vocab(True).items()}

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    def placed(ids, of):
        out, end = [], 0
        for i in ids:
            out.append((end, end + len(of(i)), i))
            end = out[-1][1]
        return out

    aligned, counts = [], collections.Counter()
    for text in texts:
        whole = f" {text}"
        a = placed(a_tok.encode(whole, add_special_tokens=False).ids, a_bytes.__getitem__) if text else []
        b = placed(b_tok.encode(text), b_bytes) if text else []
        same = b"".join(a_bytes[i] for *_, i in a) == b"".join(b_bytes(i) for *_, i in b) == whole.encode()
        if not text or not same:
            aligned.append(None)
            continue
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        cuts, groups = sorted({x[1] for x in a} & {y[1] for y in b}), []
        for low, high in zip([0, *cuts], cuts, strict=False):
            sides = [",".join(str(i) for s, e, i in side if low <= s and e <= high) for side in (a, b)]
            groups.append("|".join(sides))
        aligned.append((len(a), len(b), groups, links))
        counts.update(set(links))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for found in aligned:
        if found is None:
            yield (0,) * 6 + ("",)
            continue
        n_a, n_b, groups, links = found
        n_best = sum(counts[p] == best[p[0]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        yield n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), digest


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    if small:
        # Many segments, several passes, several levels of vectors, texts cut into slices, units forgotten.
        for name, value in {"SEGMENT_PAIRS": 60, "PART_SEGMENTS": 3, "FAN_IN": 2, "VECTOR_PAIRS": 4, "SLICE_CHARS": 50, "KEPT_UNITS": 10}.items():
            monkeypatch.setattr(alignment, name, value)
    docs = rows_of(spark, TEXTS)
    found = alignment.op11_cross_tokenizer_alignment(spark, docs.repartition(3))
    ids = [r.doc_id for r in docs.collect()]
    want = [(d, *w) for d, w in zip(ids, brute_alignment(TEXTS), strict=True)]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)


def test_alignment_of_long_and_missing_texts(spark, monkeypatch):
    long = "\n".join(f"line {i} of a long text, é日 {i * i}" for i in range(30_000))
    assert len(long) > alignment.SLICE_CHARS // 2
    monkeypatch.setattr(alignment, "SLICE_CHARS", 1 << 16)
    found = {r.doc_id: tuple(r)[1:5] for r in alignment.op11_cross_tokenizer_alignment(spark, rows_of(spark, [long, "x"])).collect()}
    monkeypatch.setattr(alignment, "SLICE_CHARS", 1 << 30)
    whole = {r.doc_id: tuple(r)[1:5] for r in alignment.op11_cross_tokenizer_alignment(spark, rows_of(spark, [long, "x"])).collect()}
    assert found == whole and found[0][0] > 100_000
    for texts in ([], [None, ""]):
        got = alignment.op11_cross_tokenizer_alignment(spark, rows_of(spark, texts)).collect()
        assert [tuple(r)[1:] for r in got] == [(0,) * 6 + ("",)] * len(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 8192])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 34, n))
    pilots, at = alignment.minimal_perfect_hash(keys)
    found = alignment.places(keys, pilots, len(keys))
    assert sorted(found.tolist()) == list(range(len(keys)))
    assert (at[found] == keys).all()


# --- resampling ---


def brute_resampling(ids, texts, target):
    def buckets(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        features = words + [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]
        return len(words), collections.Counter(zlib.crc32(f.encode()) % 10_000 for f in features)

    own, wanted = [buckets(t) for t in texts], [buckets(t) for t in target]
    s, t = (sum((c for _, c in side), collections.Counter()) for side in (own, wanted))
    s_all, t_all = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[j] + 1) * s_all / ((s[j] + 1) * t_all))) for j in range(10_000)]
    rows = []
    for doc_id, (n_words, counts) in zip(ids, own, strict=True):
        n = counts.total()
        weight = sum(gain[j] * c for j, c in counts.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, n, weight, score, None, n_words >= 20])
    eligible = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, row in enumerate(eligible[: 25 * len(eligible) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize("target", [["alpha bravo charlie", None, "delta 日本"], []])
def test_resampling(spark, monkeypatch, target):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 40)
    monkeypatch.setattr(resampling, "STEP_PLANES", 5)
    docs = rows_of(spark, TEXTS)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    ids = [r.doc_id for r in docs.collect()]
    found = resampling.resample(docs, wanted)
    want = brute_resampling(ids, TEXTS, target)
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(want)


def test_resampling_of_hot_buckets_and_nothing(spark):
    texts = ["same " * 100_000, "same word", None]
    want = brute_resampling([0, 1, 2], texts, ["same"])
    target = spark.createDataFrame([(0, "same")], "item_id bigint, text string")
    assert sorted(map(tuple, resampling.resample(rows_of(spark, texts), target).collect())) == want
    assert resampling.resample(rows_of(spark, []), target).collect() == []


def test_bit_sliced_sums_are_exact():
    draw = np.random.default_rng(5)
    counts, gain = draw.integers(0, 1000, resampling.BUCKETS), draw.integers(-9000, 9000, resampling.BUCKETS)
    planes = resampling.to_planes(counts, 10)
    sums = resampling.bit_sliced_sums(planes, resampling.to_planes(gain, 15))
    assert int((sums << np.arange(10)).sum()) == int((counts * gain).sum())


# --- SimHash ---


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(n, links):
    """The first member of each member's group."""
    first = list(range(n))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for i, j in links:
        x, y = find(i), find(j)
        first[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def brute_components(codes, most=3):
    near = np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= most, 1)
    return groups_of(len(codes), np.argwhere(near).tolist())


def clumped_codes(seed, n):
    """Random codes, and chains and balls of codes a few bits apart."""
    draw = np.random.default_rng(seed)
    centers = draw.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 12, dtype=np.uint64)
    codes = [draw.integers(0, 1 << 64, n, dtype=np.uint64)]
    for center, size in zip(centers, [400, 200, *[30] * 10], strict=True):
        flips = [np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, 3).astype(np.uint64)) for _ in range(size)]
        codes.append(center ^ np.array(flips, dtype=np.uint64))
    chain = [centers[0]]
    for _ in range(60):
        chain.append(chain[-1] ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, 3).astype(np.uint64)))
    return np.unique(np.concatenate([*codes, np.array(chain, dtype=np.uint64)]))


@pytest.mark.parametrize(("block", "leaf", "children"), [(4096, 32, 16), (64, 8, 4), (16, 4, 2)])
def test_gray_index_finds_every_group(spark, monkeypatch, block, leaf, children):
    for name, value in {"BLOCK": block, "LEAF": leaf, "CHILDREN": children}.items():
        monkeypatch.setattr(simhash, name, value)
    codes = clumped_codes(block, 1500)
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code bigint")
    links = np.array([tuple(r) for r in simhash.gray_index_links(table).collect()], dtype=np.int64).view(np.uint64)
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 3).all()
    first = list(range(len(codes)))
    assert groups_of(len(codes), np.searchsorted(codes, links).tolist()) == brute_components(codes)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE_BYTES", 30)
    base = [f"w{i}" for i in range(400)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (5, 100, 399)]
    texts = [*TEXTS, " ".join(base).upper(), *near, "two words", "Two\tWORDS", " ".join(base)]
    docs = rows_of(spark, texts)
    ids = [r.doc_id for r in docs.collect()]
    codes = np.array([brute_fingerprint(t) for t in texts], dtype=np.uint64)
    component = brute_components(codes)
    smallest = {}
    for doc_id, c in zip(ids, component, strict=True):
        known = [x for x in (smallest.get(c), doc_id) if x is not None]
        smallest[c] = min(known, default=None)
    want = [(d, f"{int(code):016x}", smallest[c]) for d, code, c in zip(ids, codes, component, strict=True)]
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == collections.Counter(want)
    assert len({w[2] for w in want[-7:-3]}) == 1


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert simhash.near_duplicates(rows_of(spark, [])).collect() == []
    only = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id bigint, text string")
    found = simhash.near_duplicates(only).collect()
    assert [r.component_id for r in found] == [None, None]
    assert sorted(r.fingerprint for r in found)[0] == "0" * 16


def test_long_texts_have_the_fingerprint_of_the_whole():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    assert len(text) > simhash.SLICE_BYTES
    words = text.split()
    ones, n = simhash._bit_counts(" ".join(words[i : i + 3]).encode() for i in range(len(words) - 2))
    assert simhash.fingerprint(text.encode()) == int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
