"""Language identification by a linear-chain conditional random field over words.

A word's score for a language adds up the weights of its features: the word itself (the learned lexicon), its first and
last letters, and its n-grams with the word's ends marked, hashed to a table of fixed size. Transitions between the
languages of neighbouring words are learned with them, on excerpts that are joined so that they switch language.
Forward-backward gives each word's probabilities; a text's language is the one with the largest mean, its score that
mean. Chains run over up to ``CHAIN`` words, then start anew, so all chains of a block step together in arrays and
texts of any length are read whole.

The field is fitted on the driver, on a bounded sample: ``per_label`` documents a language (those with the smallest
hashes of id), of each ``EXCERPTS`` excerpts of ``EXCERPT`` characters spread over the text. Weights are broadcast;
their size is the feature table times the number of languages in the sample.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when no labelled
document can be learned from; documents without a label are never learned from; a null id counts as the empty id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import packed, unpacked
from marquee.llm.shingles import mixed

BITS = 17  # of the feature table
CHAIN = 64
BLOCK = 1 << 19  # bytes worked on at once
PER_LABEL, EXCERPTS, EXCERPT = 250, 4, 700
UNKNOWN = "und"

_INSIDE = np.zeros(256, bool)  # letters, and all bytes of letters outside of ASCII
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_UP = mixed(np.arange(7, 7 + CHAIN, dtype=np.uint64))  # what a letter's place in its word multiplies it by


def _slot(*parts: np.ndarray, salt: int) -> np.ndarray:
    """Places of features in the table."""
    out = np.uint32(salt * 2654435761 % 2**32)
    for part in parts:
        out = (out ^ part) * np.uint32(2246822519)
        out = out ^ (out >> np.uint32(13))
    return (out * np.uint32(3266489917)) >> np.uint32(32 - BITS)


@dataclass
class Words:
    """Words of a block: n-gram slots of all their letters, where each word's begin, and slots of the words."""

    grams: np.ndarray
    starts: np.ndarray
    slots: np.ndarray
    counts: np.ndarray  # words of each text

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros((0, weights.shape[1]), np.float32)
        return np.add.reduceat(weights[self.grams], self.starts) + weights[self.slots].sum(1)


def featurise(data: np.ndarray, ends: np.ndarray) -> Words:
    inside = _INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = ends[ends < len(data)]
    first[bounds] |= inside[bounds]
    at = np.flatnonzero(inside)
    starts_at = np.flatnonzero(first)
    letters = _LOWER[data[at]]
    starts = np.searchsorted(at, starts_at)
    lengths = np.diff(starts, append=len(at))
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    if len(at):
        before[1:], after[:-1] = letters[:-1], letters[1:]
        before[starts] = 0
        after[starts + lengths - 1] = 0
    grams = _slot(before, letters, after, salt=1)
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    whole = np.add.reduceat(_UP[place % CHAIN] * (letters + np.uint32(1)).astype(np.uint64), starts) if len(at) else np.zeros(0, np.uint64)

    def letter(offset: np.ndarray) -> np.ndarray:
        """The letter at an offset from the word's start; 0 outside of the word."""
        ok = (offset >= 0) & (offset < lengths)
        return np.where(ok, letters[np.minimum(starts + np.maximum(offset, 0), len(letters) - 1)] if len(at) else 0, 0).astype(np.uint32)

    zero = np.zeros(len(starts), np.int64)
    head = [letter(zero + i) for i in range(4)]
    tail = [letter(lengths - 1 - i) for i in range(4)]
    slots = np.stack(
        [
            _slot((whole >> np.uint64(32)).astype(np.uint32), whole.astype(np.uint32), salt=2),
            _slot(*head[:3], salt=3),
            _slot(*head, salt=4),
            _slot(*tail[:2], salt=5),
            _slot(*tail[:3], salt=6),
            _slot(*tail, salt=7),
        ],
        axis=1,
    ).astype(np.int64)
    return Words(grams.astype(np.int64), starts, slots, np.diff(np.searchsorted(starts_at, ends), prepend=0))


def chains_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of texts in a row: the chain and place of each word, and the text of each chain."""
    per_text = -(-counts // CHAIN)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = np.repeat(np.cumsum(per_text) - per_text, counts) + within // CHAIN
    return chain, within % CHAIN, np.repeat(np.arange(len(counts)), per_text)


def marginals(scores: np.ndarray, used: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains: ``scores`` [chain, place, label], ``used`` [chain, place], ``moves`` [label, label].

    Returns the probability of each label at each place, and the expected moves summed over all chains.
    """
    chains, places, labels = scores.shape
    step = np.exp(moves - moves.max())
    own = np.exp(scores - scores.max(2, keepdims=True))
    forward = np.empty_like(own)
    state = np.ones((chains, labels), own.dtype)
    for t in range(places):
        here = (state @ step if t else state) * own[:, t]
        here = here / here.sum(1, keepdims=True)
        state = np.where(used[:, t, None], here, state)
        forward[:, t] = state
    out, expected = np.empty_like(own), np.zeros_like(moves)
    back = np.ones((chains, labels), own.dtype)
    for t in range(places - 1, -1, -1):
        both = forward[:, t] * back
        out[:, t] = both / both.sum(1, keepdims=True)
        if t:
            reach = own[:, t] * back
            pair = forward[:, t - 1, :, None] * step[None] * reach[:, None, :]
            weight = used[:, t] / np.maximum(pair.sum((1, 2)), 1e-30)
            expected += np.einsum("cij,c->ij", pair, weight)
            behind = reach @ step.T
            back = np.where(used[:, t, None], behind / behind.sum(1, keepdims=True), back)
    return out, expected


@dataclass
class Field:
    """A fitted field: labels, feature weights [slot, label] and moves [label, label]."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def probabilities(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[word, label] of the words of texts ending at ``ends``, and the number of words of each."""
        words = featurise(data, ends)
        chain, place, _ = chains_of(words.counts)
        n = int(chain[-1]) + 1 if len(chain) else 0
        scores = np.zeros((n, CHAIN, len(self.labels)), np.float32)
        used = np.zeros((n, CHAIN), bool)
        scores[chain, place], used[chain, place] = words.scores(self.weights), True
        return marginals(scores, used, self.moves)[0][chain, place], words.counts

    def sums(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the sums of its words' probabilities by label, then of their largest ones, and the number of words."""
        each, counts = self.probabilities(data, ends)
        texts = np.repeat(np.arange(len(counts)), counts)
        return np.stack([np.bincount(texts, p, len(counts)) for p in (*each.T, each.max(1))], 1), counts


def fit(samples: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-6, seed: int = 0) -> Field | None:
    """A field from (label, excerpt) pairs, by stochastic gradient steps on chains that switch label."""
    labels = sorted({label for label, _ in samples})
    if not labels:
        return None
    rnd = np.random.default_rng(seed)
    raw = [text.encode() for _, text in samples]
    ends = np.cumsum([len(r) for r in raw])
    words = featurise(np.frombuffer(b"".join(raw), np.uint8), ends)
    truth = np.repeat([labels.index(label) for label, _ in samples], words.counts)
    begin = np.cumsum(words.counts) - words.counts
    pieces = []  # runs of words of one text
    for text, n in enumerate(words.counts):
        at = 0
        while at < n:
            size = int(rnd.choice([CHAIN, CHAIN // 2, CHAIN // 4, CHAIN // 8]))
            pieces.append(np.arange(begin[text] + at, begin[text] + min(at + size, n)))
            at += size
    weights, moves = np.zeros((1 << BITS, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32)
    weight_squares, move_squares = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3)
    stops = np.append(words.starts[1:], len(words.grams))
    for _ in range(epochs):
        stream = np.concatenate([pieces[i] for i in rnd.permutation(len(pieces))]) if pieces else np.zeros(0, np.int64)
        for at in range(0, len(stream), 128 * CHAIN):
            batch = stream[at : at + 128 * CHAIN]
            sizes = stops[batch] - words.starts[batch]
            begins = np.cumsum(sizes) - sizes
            grams = words.grams[np.arange(sizes.sum()) - np.repeat(begins, sizes) + np.repeat(words.starts[batch], sizes)]
            own = np.add.reduceat(weights[grams], begins) + weights[words.slots[batch]].sum(1)
            chain, place, _ = chains_of(np.array([len(batch)]))
            scores = np.zeros((int(chain[-1]) + 1, CHAIN, len(labels)), np.float32)
            used, right = np.zeros(scores.shape[:2], bool), np.zeros(scores.shape[:2], np.int64)
            scores[chain, place], used[chain, place], right[chain, place] = own, True, truth[batch]
            found, expected = marginals(scores, used, moves)
            slope = found[chain, place]
            slope[np.arange(len(batch)), truth[batch]] -= 1
            seen = np.zeros_like(moves)
            both = used[:, 1:]
            np.add.at(seen, (right[:, :-1][both], right[:, 1:][both]), 1)
            slots = np.concatenate([grams, words.slots[batch].ravel()])
            slopes = np.concatenate([np.repeat(slope, sizes, 0), np.repeat(slope, words.slots.shape[1], 0)])
            touched, which = np.unique(slots, return_inverse=True)
            total = np.stack([np.bincount(which, slopes[:, k], len(touched)) for k in range(len(labels))], 1)
            total = total + decay * len(stream) * weights[touched]
            weight_squares[touched] += total * total
            weights[touched] -= rate * total / np.sqrt(weight_squares[touched])
            move_slope = expected - seen
            move_squares += move_slope * move_slope
            moves -= rate * move_slope / np.sqrt(move_squares)
    return Field(labels, weights, moves)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for measuring."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, per_label: int = PER_LABEL) -> Field | None:
    """Fit on documents that are not held out, at most ``per_label`` of a language."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_label)
    chosen = F.broadcast(chosen.select("doc_id", "lang").distinct())  # per_label rows a language
    size = F.length("text")
    cuts = [F.substring("text", (size * i / EXCERPTS).cast("int") + 1, F.lit(EXCERPT)) for i in range(EXCERPTS)]
    parts = known.join(chosen, ["doc_id", "lang"]).select("doc_id", "lang", F.array_join(F.array_distinct(F.array(*cuts)), "\n").alias("part"))
    rows = parts.groupBy("doc_id", "lang").agg(F.min("part").alias("part")).collect()  # bounded in rows and length
    return fit([(r.lang, r.part) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id))])


def _summed(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``Field.sums`` of texts of any length."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    block, at = max(1 << 12, BLOCK * 4 // max(4, len(field.labels))), 0
    sums, counts = np.zeros((len(texts), len(field.labels) + 1)), np.zeros(len(texts), np.int64)
    while at < len(texts):
        end = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1))
        start = int(offsets[at])
        while end == at + 1 and offsets[end] - start > block:  # a long text goes through in parts
            cut = start + block
            while cut < offsets[end] and _INSIDE[data[cut]]:
                cut += 1
            part, n = field.sums(data[start:cut], np.array([cut - start]))
            sums[at], counts[at], start = sums[at] + part[0], counts[at] + n[0], cut
        part, n = field.sums(data[start : offsets[end]], np.maximum(offsets[at + 1 : end + 1] - start, 0))
        sums[at:end] += part
        counts[at:end] += n
        at = end
    return sums, counts


def _predicted(field: Field, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    sums, counts = _summed(field, texts)
    best = sums[:, :-1].argmax(1)
    score = np.where(counts > 0, sums[np.arange(len(best)), best] / np.maximum(counts, 1), 0.0)
    return [field.labels[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)], np.clip(score, 0.0, 1.0)


def _lettered() -> Column:
    """The text, empty where it has no letter."""
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return F.when(has_letter, F.col("text")).otherwise(F.lit(""))


def label(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    if field is None:
        rows = packed(docs, lang_pred=F.lit(UNKNOWN), score=F.lit(0.0))
        return unpacked(rows, docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(field)  # the feature table times the labels

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, score = _predicted(shared.value, batch)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    rows = packed(docs, found=F.arrow_udf(predict, "struct<lang:string,score:double>")(_lettered()))
    return unpacked(rows.select("row", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")), docs, "lang_pred", "score")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with ``runs``: the languages of the text's words, as runs of ``lang`` and ``words`` (code-switched text)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                data = np.frombuffer((value.as_py() or "").encode(), np.uint8)
                each, _ = shared.value.probabilities(data, np.array([len(data)]))
                best = each.argmax(1)
                edges = np.flatnonzero(np.diff(best, prepend=-1))
                sizes = np.diff(edges, append=len(best))
                out.append([{"lang": shared.value.labels[best[e]], "words": int(n)} for e, n in zip(edges, sizes, strict=True)])
            yield pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())])))

    rows = packed(docs, runs=F.arrow_udf(predict, "array<struct<lang:string,words:int>>")(F.col("text")))
    return unpacked(rows, docs, "runs")


def keep_known(docs: DataFrame, field: Field | None, least: float = 0.5) -> DataFrame:
    """``docs`` without those that have no language, or whose words are uncertain; all stay when nothing was learned.

    A word's certainty is its largest probability; their mean must be ``least``. How many languages a text has is no matter.
    """
    if field is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def certainty(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sums, counts = _summed(shared.value, batch)
            yield pa.array(sums[:, -1] / np.maximum(counts, 1), pa.float64(), mask=counts == 0)

    found = packed(docs, certain=F.arrow_udf(certainty, "double")(_lettered()))
    return found.where(F.col("certain") >= least).select("row.*")
