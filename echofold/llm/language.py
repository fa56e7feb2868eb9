"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, grown from a bounded sample of its
labelled documents and then frozen. A byte's probability comes from the longest context of it that
the tree knows: seen symbols share the context's counts, the escape has as many counts as the context
has distinct symbols, and after an escape the next shorter context is asked with the symbols already
refused left out; beyond the empty context all 256 bytes are equal. The code length of a text is the
sum of these logarithms, and the language with the shortest code wins.

As the statistics are frozen, a byte's code length depends on it and the ``ORDER`` bytes before it
alone. The model therefore tabulates all code lengths once, per known context and byte, for all
languages side by side, and scoring a text is two table look-ups per byte. The tables are exact.

The sample: documents of each language in the order of a seeded hash of their ids, at most
``SAMPLE_DOCS`` of them, each giving at most ``SAMPLE_BYTES`` of text. Everything else sees all texts whole.

Texts that are null or hold no letter are ``und`` with score 0; so are all where nothing was
learned. Rows that repeat a ``doc_id`` are predicted each on its own; a null id counts as not held
out. Other columns are ignored, and an empty table gives no rows.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = 3
SAMPLE_DOCS = 400
SAMPLE_BYTES = 4_000
UNKNOWN = "und"
# Bytes scored at a time.
_STEP = 1 << 20
# Working columns, named unlike a table's own.
_TEXT, _LETTER = "_language_text", "_language_letter"
# A text of at least so many bytes whose code is longer than this is none of the languages.
LEAST_BYTES = 200
MOST_BITS_PER_BYTE = 6.0


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept out of learning: a quarter, by checksum of their id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Bounded training texts per language.

    Hash order is drawn from ids first, so that only the texts chosen are moved.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    draw = F.xxhash64("doc_id", F.lit("language sample"))
    keyed = labelled.select("lang", draw.alias("draw"), F.substring("text", 1, most_bytes).alias("text"))
    # Each task keeps its own first rows of a language before anything is dealt out.
    order = Window.partitionBy("lang").orderBy("draw", "text")
    chosen = keyed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most_docs)
    found: dict[str, list[bytes]] = {}
    for r in chosen.select("lang", "text").toLocalIterator():
        found.setdefault(r["lang"], []).append(r["text"].encode()[:most_bytes])
    return {lang: sorted(found[lang]) for lang in sorted(found)}


class Model:
    """Frozen statistics of all languages as code length tables."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = list(texts)
        seen = np.zeros(256, dtype=bool)
        for own in texts.values():
            for text in own:
                seen[np.frombuffer(text, dtype=np.uint8)] = True
        # Bytes no sample holds are alike: symbol 0 stands for each of them.
        self.symbols = np.zeros(256, dtype=np.int64)
        self.symbols[seen] = np.arange(1, seen.sum() + 1)
        self.size = int(seen.sum()) + 1
        grams = {lang: self._grams(own) for lang, own in texts.items()}
        contexts = np.unique(np.concatenate([g // self.size for by in grams.values() for g, _ in [by[ORDER]]]))
        self.contexts = contexts
        rows = [self._code_lengths(grams[lang], contexts) for lang in self.languages]
        # Row 0: contexts of full order that nobody knows, one per shorter context of ORDER - 1.
        self.known = np.stack([r[0] for r in rows], axis=-1).astype(np.float32)
        self.shorter = np.stack([r[1] for r in rows], axis=-1).astype(np.float32)
        self.place = np.full(self.size**ORDER, -1, dtype=np.int32)
        self.place[contexts] = np.arange(len(contexts))

    def _grams(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order: context and symbol as one number, and how often they occur."""
        found: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
        for text in texts:
            s = self.symbols[np.frombuffer(text, dtype=np.uint8)]
            key = s
            found[0].append(s)
            for order in range(1, ORDER + 1):
                # The byte ``order`` places back becomes the leading digit.
                key = key[1:] + s[: len(s) - order] * self.size**order
                found[order].append(key)
        return [np.unique(np.concatenate(f), return_counts=True) for f in found]

    def _counts(self, gram: tuple[np.ndarray, np.ndarray], contexts: np.ndarray) -> np.ndarray:
        """Symbol counts of each context; contexts never seen have none."""
        keys, n = gram
        table = np.zeros((len(contexts), self.size))
        at = np.searchsorted(contexts, keys // self.size)
        at[at == len(contexts)] = 0
        hit = contexts[at] == keys // self.size if len(contexts) else np.zeros(len(keys), dtype=bool)
        table[at[hit], keys[hit] % self.size] = n[hit]
        return table

    def _code_lengths(self, grams: list, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per (context, symbol): after the known full contexts, and after all of one byte less."""
        full = np.arange(self.size ** (ORDER - 1))
        return self._bits(grams, contexts, ORDER), self._bits(grams, full, ORDER - 1)

    def _bits(self, grams: list, contexts: np.ndarray, order: int) -> np.ndarray:
        bits = np.empty((len(contexts), self.size), dtype=np.float32)
        for lo in range(0, len(contexts), 2_000):
            part = contexts[lo : lo + 2_000]
            left = np.ones(len(part))  # probability of all escapes so far
            refused = np.zeros((len(part), self.size), dtype=bool)
            chance = np.zeros((len(part), self.size))
            for o in range(order, -1, -1):
                suffix = part % self.size**o
                wanted, back = np.unique(suffix, return_inverse=True)
                counts = np.where(refused, 0, self._counts(grams[o], wanted)[back])
                total, distinct = counts.sum(axis=1), (counts > 0).sum(axis=1)
                some = total > 0
                share = np.where(some, left / np.maximum(total + distinct, 1), 0)
                chance += counts * share[:, None]
                left = np.where(some, left * distinct / np.maximum(total + distinct, 1), left)
                refused |= counts > 0
            # Symbols of the alphabet refused so far take no part in the last, equal share.
            rest = 256 - refused.sum(axis=1)
            chance = np.where(refused, chance, (left / np.maximum(rest, 1))[:, None])
            bits[lo : lo + 2_000] = -np.log2(np.maximum(chance, 1e-300))
        return bits

    def score(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Code length in bits of each text between ``borders`` under each language."""
        s = self.symbols[data]
        # Contexts reach back to the text's first byte only; the missing places count as symbol 0.
        since = np.arange(len(data)) - np.repeat(borders[:-1], np.diff(borders))
        context = np.zeros(len(data), dtype=np.int64)
        for back in range(1, ORDER + 1):
            before = np.zeros(len(data), dtype=np.int64)
            before[back:] = s[:-back]
            context += np.where(since >= back, before, 0) * self.size ** (back - 1)
        place = self.place[context]
        bits = self.known[place, s]
        unknown = np.flatnonzero(place < 0)
        bits[unknown] = self.shorter[context[unknown] % self.size ** (ORDER - 1), s[unknown]]
        sums = np.zeros((len(borders) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(borders))
        if len(full):
            sums[full] = np.add.reduceat(bits.astype(np.float64), borders[:-1][full], axis=0)
        return sums


_MODELS: dict[str, Model] = {}


def _model(key: str, texts: dict[str, list[bytes]]) -> Model:
    """One model per Python worker, tabulated from the sample when the first task needs it."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(texts)
    return _MODELS[key]


_ADDED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def _predict(batches: Iterator[pa.RecordBatch], sample_of, key: str) -> Iterator[pa.RecordBatch]:
    model = None
    for batch in batches:
        if model is None:
            model = _model(key, sample_of.value)
        texts = pc.fill_null(batch.column(_TEXT).cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lengths = np.diff(offsets)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        borders = np.concatenate([[0], np.cumsum(lengths)])
        totals = np.zeros((len(texts), len(model.languages)))
        row = 0
        while row < len(texts):
            # Whole texts up to the step's size, at least one.
            end = max(row + 1, int(np.searchsorted(borders, borders[row] + _STEP, side="right")) - 1)
            piece = borders[row : end + 1]
            totals[row:end] = _pieces(model, data[piece[0] : piece[-1]], piece - piece[0])
            row = end
        best = totals.argmin(axis=1)
        lowest = totals.min(axis=1)
        sure = 1 / np.exp2(np.maximum(lowest[:, None] - totals, -1000)).sum(axis=1)
        letters = batch.column(_LETTER).to_numpy(zero_copy_only=False).astype(bool)
        names = np.array(model.languages, dtype=object)[best]
        columns = [batch.column(n) for n in batch.schema.names if n not in (_TEXT, _LETTER)]
        schema = pa.schema([f for f in batch.schema if f.name not in (_TEXT, _LETTER)] + list(_ADDED))
        yield pa.RecordBatch.from_arrays([
            *columns, pa.array(np.where(letters, names, UNKNOWN), pa.string()),
            pa.array(np.where(letters, sure, 0.0)), pa.array(lowest / np.maximum(lengths, 1)),
        ], schema=schema)


def _pieces(model: Model, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Scores of whole texts; one above the step's size is scored in runs that overlap by the order."""
    if len(borders) > 2 or len(data) <= _STEP:
        return model.score(data, borders)
    total = model.score(data[:_STEP], np.array([0, _STEP]))
    for at in range(_STEP, len(data), _STEP):
        run = data[at - ORDER : at + _STEP]
        lead = model.score(run[:ORDER], np.array([0, ORDER]))
        total = total + model.score(run, np.array([0, len(run)])) - lead
    return total


def identify(docs: DataFrame, keys: list[str], texts: dict[str, list[bytes]]) -> DataFrame:
    """Predict the language of every text; ``keys`` are the columns carried along.

    Adds ``lang_pred``, ``score`` (the winner's share of the probability) and ``bits_per_byte``.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = docs.select(*keys)
    if not texts:
        return kept.withColumns({
            "lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0),
        })
    # At most SAMPLE_DOCS x SAMPLE_BYTES per language.
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    schema = kept.schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double")):
        schema = schema.add(name, kind)
    rows = docs.select(*keys, F.col("text").alias(_TEXT), has_letter.alias(_LETTER))
    return rows.mapInArrow(partial(_predict, sample_of=shared, key=f"model-{shared._jbroadcast.id()}"), schema)


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """Documents in one of the learned languages, with ``lang`` as predicted.

    Rejected are texts that are null or have no letter, and longer ones that no language's statistics
    can code in ``MOST_BITS_PER_BYTE`` bits a byte.
    """
    texts = sample(docs)
    if not texts:
        return docs
    # Under names of their own, so that no column of the input is taken for one of the prediction.
    own = {c: f"_own_{c}" for c in docs.columns}
    rows = docs.select(*[F.col(c).alias(name) for c, name in own.items()], "text")
    found = identify(rows, list(own.values()), texts)
    foreign = (F.octet_length(own["text"]) >= LEAST_BYTES) & (F.col("bits_per_byte") > MOST_BITS_PER_BYTE)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & ~foreign)
    return kept.select(*[F.col("lang_pred" if c == "lang" else name).alias(c) for c, name in own.items()])


def op2_language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Predict every document's language from what the documents not held out teach."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, ["doc_id", "held_out"], sample(docs))
