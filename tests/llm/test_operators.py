"""Each operator against a brute-force version on small tables with nulls, empty and repeated rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echofold.llm import (
    fingerprints, jaccard, language, lines, mixing, neighbors, packing, perspectives, substrings, token_files, tokens,
)

WORDS = ["alpha", "bravo,", "charlie", "delta.", "echo", "fox", "golf", "hotel"]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


TEXTS = [prose(1, 80), None, "", prose(2, 3), prose(1, 80), prose(3, 400), prose(4, 60) + "\n" + prose(5, 60),
         prose(5, 60), "  \n", "one", prose(1, 78) + " new words", prose(3, 300)]


@pytest.mark.parametrize(("file", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(file, blanks):
    path = public_tokenizers.path(file)
    plain, ours = Tokenizer.from_file(path), tokens.Encoder(path, blanks)
    texts = [*TEXTS, " a", "a ", "a  b", "a\n\nb", "x\t y", "<|endoftext|> hi", "it's 'tis", "~ ~~", "tail\n", "　x y", "é\x1cb"]
    ids, counts = ours.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs_of):
    found = sorted(token_files.op5_token_files(spark, docs_of(TEXTS)).collect())
    plain, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for row, text in zip(found, TEXTS, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_read_selectively(spark, docs_of, tmp_path):
    target = str(tmp_path / "tokens")
    token_files.write(docs_of(TEXTS), target, public_tokenizers.path("word_bpe_49k.json"), False, 2)
    assert [r.doc_id for r in token_files.read_tokens(spark, target, 3, 4).orderBy("doc_id").collect()] == [3, 4]
    read = token_files.read_metadata(spark, target)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert not re.search(r"\bids:", read) and "ids_crc32:" in read


@pytest.mark.parametrize("lengths", [[], [5], [2048] * 3, [1] * 5000, [1000, 1048, 700, 700, 648, 2000, 49]])
def test_packing_plan_places_all(lengths):
    histogram = np.bincount(np.array(lengths, dtype=int), minlength=2049)
    held, placed = collections.defaultdict(list), collections.Counter()
    for length, first, count, sequence, offset, per in packing.plan(histogram):
        for i in range(count):
            held[sequence + i // per].append((offset + i % per * length, length))
        assert placed[length] == first
        placed[length] += count
    assert placed == collections.Counter(lengths)
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(held) <= math.ceil(sum(lengths) / 2048) + 1


def test_packing_query(spark, docs_of):
    texts = [*TEXTS, prose(9, 1500)]
    found = packing.op9_best_fit_packing(spark, docs_of(texts)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids, at = [*plain.encode(text or "", add_special_tokens=False).ids, 0], 0
        for n, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == crc(ids[at : at + r.length])
            assert n == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)


def test_language_code_lengths_are_exact():
    texts = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"xyzzy xyzzy plugh"]}
    model = language.Model(texts)

    def bits(lang: str, text: bytes) -> float:
        counts: dict = {}
        for t in texts[lang]:
            for i in range(len(t)):
                for o in range(min(i, language.ORDER) + 1):
                    counts.setdefault(t[i - o : i], collections.Counter())[t[i]] += 1
        total = 0.0
        for i, c in enumerate(text):
            p, refused, found = 1.0, set(), False
            for o in range(min(i, language.ORDER), -1, -1):
                own = {k: v for k, v in counts.get(text[i - o : i], {}).items() if k not in refused}
                n, d = sum(own.values()), len(own)
                if n and c in own:
                    p, found = p * own[c] / (n + d), True
                    break
                if n:
                    p, refused = p * d / (n + d), refused | set(own)
            total -= math.log2(p if found else p / (256 - len(refused)))
        return total

    for text in (b"abra", b"zebra!", b"xyz"):
        got = model.score(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert got == pytest.approx([bits("a", text), bits("b", text)], rel=1e-5)


def test_language_query(spark, docs_of):
    texts = ["the cat and the dog", "le chat et le chien"] * 20 + [None, "", "123", "the dog", "le chien"]
    langs = {i: ("en", "fr")[i % 2] for i in range(40)}
    found = {r.doc_id: r for r in language.op2_language_id(spark, docs_of(texts, langs)).collect()}
    assert [found[i].lang_pred for i in range(40, 45)] == ["und", "und", "und", "en", "fr"]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(45))
    assert all(0 <= r.score <= 1 for r in found.values())
    none = language.op2_language_id(spark, docs_of(["a b", None])).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_lines(spark, docs_of):
    line, near = prose(1, 60), prose(1, 59) + " other"
    texts = [f"{line}\n{prose(2, 9)}", f"{line.upper()}\nkeep\n\nKeep ", None, "", f"x y z q\n{prose(2, 9)}", f"{prose(2, 9)} ",
             f"\t{near}\n{line} two"]
    found = {r.doc_id: r for r in lines.dedup_lines(docs_of(texts)).collect()}
    # Lines too short to be like another one still meet their equals; blank ones stay.
    assert found[0].text == texts[0] and found[1].text == "keep\n" and found[4].text == "x y z q"
    assert (found[2].text, found[3].text, found[5].text, found[6].text) == (None, "", "", "")
    assert (found[6].n_lines, found[6].n_removed) == (2, 2)
    assert {r.doc_id for r in lines.keep_first_lines(docs_of(texts)).collect()} == {0, 1, 2, 3, 4}
    assert lines.dedup_lines(docs_of([])).count() == 0


def test_line_keys_meet_within_seven_bits(spark):
    draw = random.Random(0)
    pairs = []
    for _ in range(50):
        a = draw.getrandbits(64) - (1 << 63)
        b = a
        for bit in draw.sample(range(63), 7):
            b ^= 1 << bit
        pairs.append((a, b))
    keyed = spark.createDataFrame(pairs, "a bigint, b bigint").select(lines.block_keys("a"), lines.block_keys("b"))
    assert all(set(a) & set(b) for a, b in keyed.collect())


def test_terms_draw_once_for_all_rows_of_a_list(spark):
    texts = [("a b b c", "a b d"), ("b b x", "x"), ("a b b c", ""), ("", "d d d")]
    rows = [(0, n, *pair) for n, pair in enumerate(texts)] + [(1, 1 + fingerprints.LISTED, *texts[0])]
    made = spark.createDataFrame(rows, "range int, place int, text string, edited string")
    found = fingerprints.fingerprints(made, ["range", "place"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Rows are told apart again only above the draws.
    assert plan.index("explode(held") < plan.index("log_weight") < plan.rindex("collect_list")
    together = {tuple(r) for r in found.collect()}
    alone = fingerprints.fingerprints(made.filter("place = 0"), ["range", "place"]).collect()
    assert len(together) == len(rows) and {tuple(r) for r in alone} <= together
    by_place = {r[1]: r for r in together}
    assert by_place[0][2:] == by_place[1 + fingerprints.LISTED][2:] and by_place[2][3] is None
    assert by_place[0][2] == by_place[2][2]


def test_hashes_are_moved_once_per_first_block(spark):
    draw = random.Random(1)
    hashes = [(draw.getrandbits(64) - (1 << 63), 9) for _ in range(200)]
    rows = spark.createDataFrame(hashes, "simhash bigint, words int")
    keyed = lines.by_two_blocks(rows)
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    # Nothing is dealt by both blocks: the second comes above the only exchange.
    assert plan.count("Repartition") == 1 and plan.index("explode(slice") < plan.index("Repartition")
    found = keyed.select("simhash", lines.key_of(F.col("one"), F.col("two")).alias("key"))
    every = rows.select("simhash", F.explode(lines.block_keys("simhash")).alias("key"))
    assert found.count() == 36 * 200 and found.exceptAll(every).isEmpty()
    lines.near_cells(rows.withColumn("node", F.col("simhash")))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_texts_that_lose_no_line_are_not_moved(spark, docs_of):
    texts = [f"{prose(3, 9)}\n{prose(4, 9)}", prose(5, 9), None, "", prose(3, 9)]
    found = lines.dedup_lines(docs_of(texts).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id"))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    moved, kept = plan.split("Filter NOT ")
    assert plan.startswith("Union") and "doc_id" in moved and "<=>" in moved and "<=>" not in kept
    assert {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()} == {
        (0, texts[0], 2, 0), (None, texts[1], 1, 0), (2, None, 0, 0), (3, "", 1, 0), (4, "", 1, 1)
    }


def test_linked_lines_share_a_word_to_meet(spark, docs_of):
    """A quarter of the words edited, or dropped, or added: one of the chosen words is left."""
    draw = random.Random(2)
    pairs = []
    for n in range(120):
        one = [f"w{draw.randrange(40)}" * draw.randint(1, 3) for _ in range(draw.randint(3, 30))]
        two = list(one)
        for _ in range(len(one) // 4):
            spot = draw.randrange(len(two))
            two[spot : spot + draw.randint(0, 1)] = [f"new{n}" * 9] * draw.randint(0, 1)
        pairs.append((" ".join(one), " ".join(two)))
    lined = [(2 * n + i, norm) for n, pair in enumerate(pairs) for i, norm in enumerate(pair)]
    held = {r.node: set(r.held) for r in lines.words_to_meet(spark.createDataFrame(lined, "node bigint, norm string")).collect()}
    linked = 0
    for n, (one, two) in enumerate(pairs):
        one, two = one.split(" "), two.split(" ")
        if word_edits(one, two) <= max(len(one), len(two)) // 4:
            linked += 1
            assert held[2 * n] & held[2 * n + 1]
    assert linked > 100 and held[0] and max(map(len, held.values())) <= 9


@pytest.mark.parametrize("common", [(1, 1), (1, 1 << 14), (1 << 9, 1 << 14)])
def test_near_hashes_meet_only_beneath_a_shared_word(spark, monkeypatch, common):
    monkeypatch.setattr(lines, "COMMON_WORD", common[0])
    monkeypatch.setattr(lines, "VERY_COMMON_WORD", common[1])
    draw = random.Random(3)
    rows = []
    for n in range(60):
        simhash = draw.getrandbits(64)
        for i in range(4):
            changed = simhash
            for bit in draw.sample(range(64), draw.choice([3, 5, 7, 12])):
                changed ^= 1 << bit
            rows.append((4 * n + i, changed - (1 << 63), 8, [draw.randrange(4), 4 + draw.randrange(4)]))
    nodes = spark.createDataFrame(rows, "node bigint, simhash bigint, words int, held array<int>")
    by_cell = {}
    for r in lines.near_cells(nodes.drop("held"), nodes.select("node", "held")).collect():
        by_cell.setdefault(r.cell, set()).add(r.node)
    together = {(a, b) for cell in by_cell.values() for a in cell for b in cell if a < b}
    starts = [sum(lines.BLOCKS[:b]) for b in range(len(lines.BLOCKS))]
    wanted, apart = set(), 0
    for a, x, _, held in rows:
        for b, y, _, other in rows[a + 1 :]:
            differ = x ^ y
            equal = sum(differ >> s & (1 << w) - 1 == 0 for s, w in zip(starts, lines.BLOCKS, strict=True))
            if bin(differ % (1 << 64)).count("1") <= lines.MOST_BITS and equal >= 2:
                if set(held) & set(other):
                    wanted.add((a, b))
                else:
                    # By blocks alone, they met.
                    apart += 1
                    assert (a, b) not in together
    assert wanted <= together and apart > 20


def test_line_hash_is_the_majority_of_distinct_words(spark, docs_of):
    norms = ["a b c", "a b c d e d e d", " ".join(f"w{i % 300}" for i in range(400)), "x" * 300]
    words = F.array_distinct(F.split("norm", " "))
    every = lines.lines_of(docs_of(norms))
    hashed = every.select("node", F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    rows = lines.simhashes(every).filter("words > 2").select("node", F.col("simhash").alias("s")).join(hashed, "node")
    assert rows.count() == 3
    for row in rows.collect():
        bits = [b for b in range(64) if sum(h >> b & 1 for h in row.h) * 2 > len(row.h)]
        assert row.s % (1 << 64) == sum(1 << b for b in bits)


def word_edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_near_lines_against_brute_force(spark, sf_dir):
    """Of the pairs of different lines with an edit similarity of 0.75, nine in ten are found, and no others."""
    draw = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for n in range(150):
        words = prose(1000 + n, draw.randint(8, 40)).split(" ")
        texts.append(" ".join(words))
        for _ in range(draw.randint(1, len(words) // 8)):
            words[draw.randrange(len(words))] = f"other{draw.randrange(1000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    every = lines.lines_of(docs)
    nodes = lines.simhashes(every).filter("words >= 3").select("node", "simhash", "words").distinct()
    group = {r.node: r.component for r in lines.groups_of(every, nodes).collect()}
    norms = [(r.node, r.norm.split(" ")) for r in every.select("node", "norm").distinct().collect()]
    linked, close = 0, {}
    for i, (a, one) in enumerate(norms):
        kinds = set(one)
        for b, two in norms[:i]:
            most = max(len(one), len(two)) // 4
            if abs(len(one) - len(two)) <= most and len(kinds & set(two)) >= len(kinds) - most:
                if word_edits(one, two) <= most:
                    linked += 1
                    close.setdefault(a, set()).add(b)
                    close.setdefault(b, set()).add(a)
    found = sum(group.get(a, 0) == group.get(b, 1) for a in close for b in close[a]) // 2
    assert linked >= 150 and found >= 0.9 * linked
    # Whatever is in a group is linked with something in it.
    assert all(any(group.get(b) == c for b in close.get(a, ())) for a, c in group.items())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_jaccard_families_meet_in_one_region(spark, docs_of, monkeypatch):
    """Two families of near copies: the rounds compare few of their pairs, the groups are those of all links."""
    random.seed(5)
    words = [f"w{i}" for i in range(5_000)]
    texts = []
    for _ in range(2):
        base = random.choices(words, k=120)
        for i in range(40):
            text = list(base)
            for at in random.sample(range(120), i % 10):
                text[at] = random.choice(words)
            texts.append(" ".join(text))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    listed = []
    connect = jaccard.connect

    def counted(cells, keep, measure, **more):
        def measured(pairs):
            listed.append(pairs.count())
            return measure(pairs)
        return connect(cells, keep, measured, **more)

    monkeypatch.setattr(jaccard, "connect", counted)
    found = {r.doc_id: r.component_id for r in jaccard.join_groups(docs_of(texts)).collect()}
    assert found == dict(enumerate(group))
    assert len(set(group)) > 2
    assert sum(listed) < 2 * 40 * 39 / 2 / 4


def test_parities_never_exceed_the_difference():
    random.seed(6)
    base = [f"w{random.randrange(400)}" for _ in range(300)]
    texts = [base, base[30:], base[:150] + base[170:], [f"v{i}" for i in range(5_000)], ["a"], []]
    values, borders = jaccard.shingle_sets(pa.array([" ".join(t) for t in texts]))
    sets = [set(values[a:b].tolist()) for a, b in itertools.pairwise(borders)]
    bits = jaccard.parities(values, borders)
    assert bits.shape == (len(texts), jaccard.PARITIES // 64)
    for a, b in itertools.combinations(range(len(texts)), 2):
        apart = sum(int(w).bit_count() for w in (bits[a] ^ bits[b]).view("<u8"))
        assert apart <= len(sets[a] ^ sets[b]) and (len(sets[a] ^ sets[b]) - apart) % 2 == 0


def test_jaccard_groups(spark, docs_of):
    draw = random.Random(3)
    texts = list(TEXTS)
    for base in range(4):
        words = prose(20 + base, 90).split()
        for _ in range(40):
            edited = list(words)
            for _ in range(draw.randrange(5)):
                edited[draw.randrange(len(edited))] = "edit"
            texts.append(" ".join(edited))
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    found = sorted(jaccard.op8_ngram_jaccard_join(spark, docs_of(texts)).collect())
    assert [(r.n_shingles, r.component_id) for r in found] == [(len(s), root(i)) for i, s in enumerate(sets)]


def test_mixing(spark, docs_of):
    sources = {i: ("a", "b", None)[i % 3] for i in range(30)}
    texts = [prose(i, 40 + i) if i % 7 else None for i in range(30)]
    found = {r.doc_id: r for r in mixing.op10_source_mixing(spark, docs_of(texts, sources=sources)).collect()}
    size = [len((t or "").split()) for t in texts]
    own = [sum(size[i] for i in range(30) if i % 3 == s) for s in range(3)]
    rate = 1.5 * sum(own)
    aims, open_ = [0.0] * 3, {0, 1, 2}
    while True:
        share = {s: rate * (5, 2, 1)[s] / sum((5, 2, 1)[k] for k in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * own[s]]
        if not over:
            break
        for s in over:
            aims[s] = 2.0 * own[s]
            rate -= aims[s]
            open_.discard(s)
    aims = [share.get(s, aims[s]) for s in range(3)]
    for i, r in found.items():
        assert r.size == size[i] and r.source_size == own[i % 3] and r.target == pytest.approx(aims[i % 3])
        assert 0 <= r.taken <= 2 * r.size
    for s in range(3):
        assert abs(sum(found[i].taken for i in range(30) if i % 3 == s) - aims[s]) <= 3 * mixing.BLOCK_WORDS
    again = {r.doc_id: r for r in mixing.op10_source_mixing(spark, docs_of(texts, sources=sources).repartition(5)).collect()}
    assert again == found
    rows = mixing.mixed_documents(docs_of(texts, sources=sources)).collect()
    words = collections.Counter()
    for r in rows:
        words[r.doc_id] += len(r.text.split())
    assert all(words[i] == r.taken for i, r in found.items())


def test_apportionment_equals_highest_quotients(spark):
    draw = random.Random(1)
    votes = [draw.randrange(1, 500) for _ in range(12)]
    seats = 57
    quotients = sorted(((v / (2 * s + 1), -i) for i, v in enumerate(votes) for s in range(seats)), reverse=True)[:seats]
    wanted = collections.Counter(-i for _, i in quotients)
    rows = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, p int, v bigint, s bigint")
    found = mixing.apportion(rows, ["g"], "p", "v", "s", None).collect()
    assert {r.p: r.quota for r in found} == {i: wanted[i] for i in range(12)}


def test_fingerprints(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    texts = [*TEXTS, "é" * 7]
    found = {r.doc_id: r for r in fingerprints.op4_document_fingerprints(spark, docs_of(texts)).collect()}
    order = list(reversed(range(len(texts))))
    for n, i in enumerate(order):
        text, other = texts[i] or "", texts[order[(n + 1) % len(order)]] or ""
        third = len(text) // 3
        edit = text[: len(text) - third] + other[:third]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()

        def weights(t):
            return collections.Counter(t.lower().split())

        a, b = weights(text), weights(edit)
        alike = sum((a & b).values()) / sum((a | b).values()) if a | b else 1
        assert abs(found[i].near_edited - alike) < 0.3
    assert found[0].fingerprint == found[4].fingerprint != found[5].fingerprint


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", None, 9), (1, 3, "ann", "bye", 9),
            (2, 0, None, "alone", 9), (None, 0, "cy", "x", 9)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, chunk int")
    found = {(r.conv_id, r.participant): r for r in perspectives.render(table).collect()}
    assert set(found) == {(1, "ann"), (1, "bob"), (None, "cy")}
    ann = found[1, "ann"]
    assert ann.text == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    )
    assert [ann.text[m["begin"] : m["end"]] for m in ann.masks] == ["hi<|im_end|>\n", "bye<|im_end|>\n"]


def test_neighbors(spark):
    draw = np.random.default_rng(0)
    vectors = draw.normal(size=(400, 8))
    vectors[50:200] = vectors[50]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(400, None, 1), (450, [0.0] * 8, 1), (500, [float("nan")] * 8, 1), (550, [1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, one int")
    found = collections.defaultdict(list)
    for r in sorted(neighbors.op7_nearest_neighbors(spark, table).collect()):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 400, 50))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in found:
        score = unit @ unit[q]
        score[q] = -9
        best = sorted(range(400), key=lambda i: (-round(score[i], 12), i))[:5]
        assert [i for i, _ in found[q]] == best
        assert [s for _, s in found[q]] == pytest.approx([score[i] for i in best])


def test_substrings(spark, docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_ROWS", 20)
    shared = prose(50, 40)
    texts = [*TEXTS, prose(51, 30) + shared + prose(52, 30), shared[5:] + prose(53, 40), "ab" * 300, shared + " x " + shared]
    found = {r.doc_id: r for r in substrings.op1_suffix_array_dedup(spark, docs_of(texts)).collect()}
    data = [(t or "").encode() for t in texts]
    starts = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    for n, t in enumerate(data):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if starts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        r = found[n]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), sum(gone), runs)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("query", [
    substrings.op1_suffix_array_dedup, language.op2_language_id, lines.op3_line_dedup,
    fingerprints.op4_document_fingerprints, token_files.op5_token_files, jaccard.op8_ngram_jaccard_join,
    packing.op9_best_fit_packing, mixing.op10_source_mixing,
])
def test_empty_table(spark, docs_of, query):
    assert query(spark, docs_of([])).count() == 0


def test_repeated_rows(spark, docs_of):
    docs = docs_of(TEXTS[:3])
    twice = docs.union(docs)
    assert substrings.op1_suffix_array_dedup(spark, twice).count() == 6
    assert mixing.op10_source_mixing(spark, twice).count() == 6
    assert packing.op9_best_fit_packing(spark, twice).count() == 6
    assert fingerprints.op4_document_fingerprints(spark, twice).count() == 6


def test_odd_texts_leave_the_others_in_one_piece(monkeypatch):
    """Texts that are encoded whole, at either end and side by side; the others are not cut apart for them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd, plain = "two  blanks ", "one word more"
    texts = [odd, plain, None, odd, odd, plain, "", odd]
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = tokens.Encoder(path, blanks=True)
    encoder.encode(pa.array([plain]))
    monkeypatch.setattr(tokens.np, "split", None)
    ids, counts = encoder.encode(pa.array(texts))
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
