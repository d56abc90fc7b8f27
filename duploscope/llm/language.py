"""Language identification by unigram models summed over all segmentations.

Method: each language has its own probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words
(runs of letters, lowered, with the space before them). The probabilities are learned from labelled texts by
expectation maximisation, so that no segmentation is ever chosen.

Training takes about SAMPLE documents of each language, picked by a hash of their id, and only the words'
counts of that bounded sample reach the driver. Scoring runs where documents stand: each distinct word of a slice is summed
once, all words of a length together, and a bounded memory of words is kept between slices. No word is cut: sums over long ones are
brought back into range on the way, their scale kept as a logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.llm import words
from duploscope.llm.columns import bounded_batches, text_or_empty

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SAMPLE = 400  # documents of a language to learn from
LANGUAGES = 500  # of the most frequent ones are told apart
WORDS = 1_000_000  # at most, the most frequent ones of the sample, are learned from
LEARNED = 1024  # bytes of a word that is learned from; longer ones are scored, not learned
ROUNDS = 4  # of expectation maximisation
SMOOTHING = 0.1  # count of a single byte that was never seen
SHORT = 32  # bytes; sums over longer words are scaled anew on the way
REMEMBERED = 300_000  # words
_SCALE = 20.0  # for each byte, which keeps products of short words in range
_RESCALED = 16  # bytes after which the sums over a longer word are
_CELLS = 1 << 21  # numbers of the sums of one group of words
UNDETERMINED = "und"
_LETTERS = "__letters"


def letters_of(text: str) -> Column:
    """The text's words: lowered runs of letters, each after one space; empty without a letter."""
    kept = F.regexp_replace(F.lower(text_or_empty(text)), "[^\\p{L}\\p{M}]+", " ")
    return F.when(kept.rlike("\\p{L}"), F.concat(F.lit(" "), F.btrim(kept))).otherwise("")


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """Byte strings of the vocabulary's pieces: 256 single bytes first, then longer ones in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [
        model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    longer = [text for text in dict.fromkeys(texts) if len(text) > 1 and b" " not in text[1:]]
    return [bytes([b]) for b in range(256)] + longer


class Trie(NamedTuple):
    step: np.ndarray  # node, byte's column -> node; 0 is none, 1 the root
    column: np.ndarray  # of each byte
    piece: np.ndarray  # number of the piece that ends at a node, counted from 1
    longest: int  # bytes of a piece


def trie(vocabulary: list[bytes]) -> Trie:
    used = sorted({b for piece in vocabulary if len(piece) > 1 for b in piece})
    column = np.zeros(256, np.int64)
    column[used] = np.arange(1, len(used) + 1)
    rows: list[dict[int, int]] = [{}, {}]
    ends = {}
    for number, piece in enumerate(vocabulary[256:], start=257):
        node = 1
        for b in piece:
            following = rows[node].get(b)
            if following is None:
                following = rows[node][b] = len(rows)
                rows.append({})
            node = following
        ends[node] = number
    step = np.zeros((len(rows), len(used) + 1), np.int32)
    for node, row in enumerate(rows):
        for b, following in row.items():
            step[node, column[b]] = following
    piece = np.zeros(len(rows), np.int32)
    piece[list(ends)] = list(ends.values())
    return Trie(step, column, piece, max(map(len, vocabulary)))


def _matches(own: np.ndarray, tree: Trie) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, piece numbers or 0) for all rows of `own`, words of one length; single bytes are pieces 1 to 256."""
    found = []
    count, length = own.shape
    columns = tree.column[own]
    for start in range(length):
        found.append((start, start + 1, own[:, start].astype(np.int32) + 1))
        node = np.ones(count, np.int32)
        for at in range(start, min(length, start + tree.longest)):
            node = tree.step[node, columns[:, at]]
            if not node.any():
                break
            if at > start:
                numbers = tree.piece[node]
                if numbers.any():
                    found.append((start, at + 1, numbers))
    return sorted(found, key=lambda m: (m[1], m[0]))


def _forward(matches: list[tuple[int, int, np.ndarray]], length: int, chances: np.ndarray) -> np.ndarray:
    """Sums over segmentations up to each byte: (length + 1, words, languages), each byte scaled by _SCALE."""
    count = len(matches[0][2])
    sums = np.zeros((length + 1, count, chances.shape[1]))
    sums[0] = 1
    for start, end, numbers in matches:
        sums[end] += sums[start] * chances[numbers]
    return sums


def _rescaled(
    matches: list[tuple[int, int, np.ndarray]], length: int, chances: np.ndarray, longest: int
) -> tuple[np.ndarray, np.ndarray]:
    """The sums of `_forward` for words of any length: numbers in range, and the logarithm of what each is to be multiplied by."""
    count = len(matches[0][2])
    sums, logs = np.zeros((length + 1, count, chances.shape[1])), np.zeros((length + 1, count, chances.shape[1]))
    sums[0] = 1
    done = 0  # end of the last match, so that sums up to it are complete
    for start, end, numbers in matches:
        if end > done:
            logs[end] = logs[done]
            if done and done % _RESCALED == 0:
                window = slice(max(0, done + 1 - longest), done + 1)  # what later sums are made of
                top = sums[window].max(axis=0)
                sums[window] /= top
                logs[window] = logs[done] + np.log(top)
                logs[end] = logs[done]
            done = end
        sums[end] += sums[start] * chances[numbers]
    return sums, logs


def _log_sums(own: np.ndarray, tree: Trie, chances: np.ndarray) -> np.ndarray:
    """(words, languages) logarithms of the sums over whole words of one length, _SCALE included, in memory that does not grow with it."""
    (count, length), window = own.shape, tree.longest
    sums, logs = np.zeros((window, count, chances.shape[1])), np.zeros((count, chances.shape[1]))
    sums[0] = 1  # of place p in row p modulo the window
    nodes = np.zeros((window, count), np.int32)  # where the piece that begins at a place has come to
    for end in range(1, length + 1):
        letter = own[:, end - 1]
        nodes[(end - 1) % window] = 1
        nodes = tree.step[nodes, tree.column[letter]]
        numbers = tree.piece[nodes]
        total = sums[(end - 1) % window] * chances[letter.astype(np.int32) + 1]
        for row in np.flatnonzero(numbers.any(axis=1)):
            total += sums[row] * chances[numbers[row]]
        sums[end % window] = total
        if end % _RESCALED == 0:
            top = sums.max(axis=0)
            sums /= top
            logs += np.log(top)
    return logs + np.log(sums[length % window])


class Model(NamedTuple):
    languages: list[str]
    vocabulary: list[bytes]
    chances: np.ndarray  # piece number (0: none), language: probability times _SCALE for each byte


def _scaled(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    chances = counts / counts.sum(axis=0)
    return np.concatenate((np.zeros((1, counts.shape[1])), chances * _SCALE ** lengths[:, None]))


def fit(counted: dict[bytes, np.ndarray], languages: list[str], vocabulary: list[bytes], rounds: int = ROUNDS) -> Model:
    """Piece probabilities from counts of words (with their space) in each language. Pieces that no segmentation of a counted word
    uses have no probability and are left out; single bytes always have one."""
    tree = trie(vocabulary)
    lengths = np.array([len(piece) for piece in vocabulary])
    by_length: dict[int, list[bytes]] = {}
    for word in counted:
        if len(word) <= LEARNED:
            by_length.setdefault(len(word), []).append(word)
    parts = []
    for length, own in sorted(by_length.items()):
        size = max(1, min(20_000, _CELLS * 4 // (length * len(languages))))
        for at in range(0, len(own), size):
            some = own[at : at + size]
            rows = np.frombuffer(b"".join(some), np.uint8).reshape(-1, length)
            parts.append((length, rows, np.array([counted[word] for word in some], float)))
    counts = np.where(lengths[:, None] == 1, SMOOTHING, 1.0) * np.ones((1, len(languages)))
    for _ in range(rounds):
        chances = _scaled(counts, lengths)
        counts = np.where(lengths[:, None] == 1, SMOOTHING, 0.0) * np.ones((1, len(languages)))
        for length, rows, weights in parts:
            matches = _matches(rows, tree)
            ahead, ahead_log = _rescaled(matches, length, chances, tree.longest)
            mirrored = sorted(((length - end, length - start, numbers) for start, end, numbers in matches), key=lambda m: (m[1], m[0]))
            behind, behind_log = (part[::-1] for part in _rescaled(mirrored, length, chances, tree.longest))
            share, total = weights / ahead[length], ahead_log[length]
            for start, end, numbers in matches:
                hit = np.flatnonzero(numbers)
                scale = np.exp(ahead_log[start][hit] + behind_log[end][hit] - total[hit])
                expected = ahead[start][hit] * chances[numbers[hit]] * behind[end][hit] * scale * share[hit]
                for column in range(len(languages)):
                    counts[:, column] += np.bincount(numbers[hit] - 1, expected[:, column], len(counts))
    kept = np.flatnonzero((lengths == 1) | (counts.max(axis=1) > 1e-3))
    return Model(languages, [vocabulary[i] for i in kept], _scaled(counts[kept] + 1e-6, lengths[kept]))


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.tree = model, trie(model.vocabulary)
        self.known = np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(model.languages)))

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probabilities of words at [start, end) of the data."""
        chances = self.model.chances
        lengths = ends - starts
        logs = np.zeros((len(starts), chances.shape[1]))
        for length in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == length)
            size = max(1, _CELLS // (min(length + 1, self.tree.longest) * chances.shape[1]))
            for own in (every[at : at + size] for at in range(0, len(every), size)):
                rows = data[starts[own][:, None] + np.arange(length)]
                if length <= SHORT:
                    logs[own] = np.log(np.maximum(_forward(_matches(rows, self.tree), length, chances)[length], 1e-300))
                else:
                    logs[own] = _log_sums(rows, self.tree, chances)
                logs[own] -= length * np.log(_SCALE)
        return logs

    def __call__(self, part: words.Slice) -> np.ndarray:
        """(texts, languages) log probabilities."""
        found = words.words(part, keep_case=True)
        if not len(found.hashes):
            return np.zeros((len(part.bounds) - 1, len(self.model.languages)))
        unique, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        places = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        old = self.known[places] == unique if len(self.known) else np.zeros(len(unique), bool)
        values = np.empty((len(unique), len(self.model.languages)))
        values[old] = self.values[places[old]]
        fresh = first[~old]
        values[~old] = self._new(part.data, found.starts[fresh] - 1, found.ends[fresh])
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.values = unique, values
        else:
            both = np.concatenate((self.known, unique[~old]))
            order = np.argsort(both)
            self.known, self.values = both[order], np.concatenate((self.values, values[~old]))[order]
        total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values[inverse], axis=0)))
        return total[found.bounds[1:]] - total[found.bounds[:-1]]


def _predicted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = _Scorer(model)
    for batch in batches:
        predictions, scores = [], []
        for part in words.slices(batch.column(_LETTERS)):
            empty = part.bounds[1:] == part.bounds[:-1]
            if not model.languages:
                predictions += [UNDETERMINED] * len(empty)
                scores += [0.0] * len(empty)
                continue
            logs = scorer(part)
            best = logs.argmax(axis=1)
            chance = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            predictions += [UNDETERMINED if e else model.languages[b] for e, b in zip(empty, best)]
            scores += np.where(empty, 0.0, chance).tolist()
        names = [name for name in batch.schema.names if name != _LETTERS]
        others = [batch.column(name) for name in names]
        yield pa.RecordBatch.from_arrays(
            [*others, pa.array(predictions, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"]
        )


def train(docs: DataFrame, tokenizer: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    """Learns from (doc_id, text, lang). Rows without a lang do not count; of each of the LANGUAGES most frequent ones, of equally frequent
    ones the first by name, about `sample` documents are taken, by a hash of their id; other languages are not learned. Rows that repeat an
    id are one document, of different texts the first in order. Without any language the model predicts none."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "text"), F.lit(""))
    labelled = docs.filter("lang IS NOT NULL").select(key.alias("key"), "text", "lang")
    ranked = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("documents"))
    frequent = ranked.orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    amounts = {row["lang"]: row["documents"] for row in frequent.collect()}
    languages = sorted(amounts)
    vocabulary = pieces(tokenizer)
    if not languages:
        return Model([], vocabulary[:256], np.ones((257, 0)))
    bucket = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    # at least one and a half documents are expected, so that a language of few is not missed
    limits = F.create_map(*[F.lit(x) for name in languages for x in (name, int((1 << 20) * sample / amounts[name]) + 1)])
    chosen = labelled.filter(F.col("lang").isin(languages)).filter(bucket < F.try_element_at(limits, F.col("lang")))
    chosen = chosen.groupBy("lang", "key").agg(F.min("text").alias("text"))
    counted = (
        chosen.select("lang", F.explode(F.split(F.btrim(letters_of("text")), " ")).alias("word"))
        .filter("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "word", "lang")
        .limit(WORDS)
        .toArrow()
    )
    column = {name: i for i, name in enumerate(languages)}
    totals: dict[bytes, np.ndarray] = {}
    for name, word, n in zip(*(counted[c].to_pylist() for c in ("lang", "word", "n"))):
        totals.setdefault(b" " + word.encode(), np.zeros(len(languages)))[column[name]] += n
    return fit(totals, languages, vocabulary)


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred and score to the columns `carry` of every row, from its text alone.

    The score is the probability of the predicted language among the model's, all equally likely beforehand. Null texts and texts without a
    letter are `und` with score 0; among equal languages the first by name is taken. Rows may repeat; an empty table gives no rows.
    Carried columns named lang_pred or score are replaced by the result.
    """
    carry = tuple(name for name in carry if name not in ("lang_pred", "score"))
    given = docs.select(*carry, letters_of("text").alias(_LETTERS))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{name}` {given.schema[name].dataType.simpleString()}" for name in carry)
    return given.mapInArrow(lambda batches: _predicted(batches, shared.value), f"{schema}, lang_pred string, score double")
