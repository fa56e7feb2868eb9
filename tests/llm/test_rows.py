"""Rows that share an id or have none, and input columns with the names that stages use inside."""

import collections
import re

import pytest

from echofold.llm import jaccard, language, lines, mixing

BASE = [f"w{i}" for i in range(60)]


def text(*changes, words=BASE):
    return " ".join(f"x{i}" if i in changes else w for i, w in enumerate(words))


OTHER = text(words=[f"v{i}" for i in range(60)])
ROWS = [
    (1, text()), (1, OTHER), (2, text(0)), (3, OTHER + " more"), (None, text(59)), (4, None), (4, ""), (5, "lone words here"),
    (5, "lone words here"), (None, "nobody's own text of some words"), (None, "nobody's own text of some words"), (2, text()),
]


def shingles(value):
    words = re.findall(r"[^\x20\x09-\x0D]+", (value or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components():
    sets = [shingles(t) for _, t in ROWS]
    first = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= 75 * len(a | b):
                    first[i] = first[j] = min(first[i], first[j])
    return sets, first


def test_links_are_between_texts_whatever_their_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    sets, first = brute_components()
    want = collections.Counter()
    for i, (doc_id, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if first[j] == first[i] and ROWS[j][0] is not None]
        want[doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id] += 1
    found = jaccard.op8_ngram_jaccard_join(spark, docs).collect()
    assert collections.Counter(map(tuple, found)) == want


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(d, t, 7) for d, t in ROWS], "doc_id bigint, text string, component int")
    sets, first = brute_components()
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.keep_one_of_each_group(docs).collect())
    for place in set(first):
        group = [ROWS[i] for i in range(len(ROWS)) if first[i] == place]
        if sets[place]:
            smallest = min(d is None and 99 or d for d, _ in group)
            left = [(d, t) for d, t in set(group) for _ in range(kept[d, t])]
            assert len(left) == 1 and (left[0][0] or 99) == smallest, group
        else:
            assert all(kept[row] for row in group)


@pytest.mark.parametrize("stage", [language.keep_known_languages, lines.keep_first_lines, jaccard.keep_one_of_each_group, mixing.mixed_documents])
def test_stages_keep_columns_whatever_their_names(spark, stage):
    names = [
        "score", "lang_pred", "bits_per_byte", "n_lines", "n_removed", "at", "every", "extra", "begin", "step", "n_blocks",
        "node", "component", "cell", "one", "two", "text_hash", "size", "target", "taken", "shard", "draw", "held_out",
    ]
    rows = [
        (i, f"a line of words number {i} for all of them\nand a second line {i * 7} here", "en" if i % 2 else "de", f"s{i % 2}", 50, *["kept"] * len(names))
        for i in range(24)
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    found = stage(docs)
    assert found.columns == docs.columns
    got = found.collect()
    assert got and all(r[n] == "kept" for r in got for n in names)
    assert stage(docs.filter("false")).collect() == []
