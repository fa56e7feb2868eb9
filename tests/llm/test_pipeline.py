"""The pipeline on the given documents: each stage against what it has to guarantee, by brute force."""

import collections
import re

import pytest

import corpus_pipeline
from echofold.llm.tables import stage, table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows after each stage, ``documents`` first, and the last stage's frame."""
    docs = table(spark, sf_dir, "documents")
    found = {"documents": docs.collect()}
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
        found[name] = docs.collect()
    return found


def test_every_stage_but_the_last_returns_documents(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)[1:]
    columns = {tuple(rows[0].asDict()) for name, rows in stages.items() if name != "best_fit_packing"}
    assert len(columns) == 1 and all(rows for rows in stages.values())


def test_language_stage_keeps_texts_with_letters(stages):
    kept = {r.doc_id: r for r in stages["language_id"]}
    given = {r.doc_id: r for r in stages["documents"]}
    assert all(kept[d].text == given[d].text for d in kept)
    assert all(not re.search(r"[^\W\d_]", given[d].text or "") for d in given.keys() - kept.keys() if len(given[d].text or "") < 40)
    assert len(kept) > 0.9 * len(given)
    right = sum(kept[d].lang == given[d].lang for d in kept)
    assert right > 0.95 * len(kept)


def test_line_stage_leaves_each_line_once(stages):
    def lines(rows):
        cleaned = (re.sub(r"\s{2,}|[\t\x0B\f\r]", " ", x.lower()).strip() for r in rows for x in r.text.split("\n"))
        return collections.Counter(x for x in cleaned if x.count(" ") >= 2)

    before, after = lines(stages["language_id"]), lines(stages["line_dedup"])
    assert after and max(after.values()) == 1
    assert set(after) <= set(before)
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"])


def test_join_stage_keeps_one_of_each_group(stages):
    before, after = stages["line_dedup"], {r.doc_id for r in stages["ngram_jaccard_join"]}
    sets = [shingles(r.text) for r in before]
    first = list(range(len(before)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                first[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i, row in enumerate(before):
        groups[find(i)].append(row.doc_id)
    assert after == {min(ids) for ids in groups.values()}


def test_mix_stage_takes_words_of_its_input_only(stages):
    given = {r.doc_id: collections.Counter(r.text.split()) for r in stages["ngram_jaccard_join"]}
    taken = collections.defaultdict(collections.Counter)
    for row in stages["source_mixing"]:
        taken[row.doc_id].update(row.text.split())
    for doc_id, words in taken.items():
        assert all(n <= 2 * given[doc_id][word] for word, n in words.items())
    total = sum(w.total() for w in taken.values())
    assert abs(total - 1.5 * sum(w.total() for w in given.values())) < 0.05 * total


def test_packing_stage_fills_sequences_without_gaps(stages):
    held = collections.defaultdict(list)
    for row in stages["best_fit_packing"]:
        held[row.sequence_id].append((row.offset, row.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
    documents = collections.Counter(r.doc_id for r in stages["source_mixing"])
    assert collections.Counter(r.doc_id for r in stages["best_fit_packing"] if r.piece == 0) == documents
    assert len(held) <= 1.02 * sum(r.length for r in stages["best_fit_packing"]) / 2048 + 2


def test_pipeline_of_no_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
