"""Language of words and documents by a linear-chain conditional random field.

A word's features are its n-grams of two to four letters (those at its ends are
its affixes) and the word itself, as far as the training sample's lexicon knows
it; all are hashed into one table of weights per language. Transitions between the
languages of neighbouring words are learned with them: half of the training
sequences are spliced from two documents, so that the chain has seen switches.
Forward-backward gives each word's language, and the mean over a document's words
gives the document's.

Training runs on a sample of labelled documents of a bounded size (`per_lang`
documents of each language, whole texts; at most `max_langs` languages).
Prediction maps over all documents with no shuffle: a task holds a few texts and
the model (2**17 rows). Long chains are run in blocks whose transfer matrices are
chained, so a task's steps don't grow with the longest text.

Edge cases: null text or text without letters gives `und` with score 0; a null
language isn't learned; if nothing can be learned every document is `und`; very
long texts are labelled whole; repeated rows are labelled alike; equal shares go
to the language that sorts first; columns other than doc_id, text and lang are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BITS = 17
BLOCK = 64
CHARS = 100_000
PER_LANG = 150
MAX_LANGS = 200
RESULT = "doc_id long, lang_pred string, score double, words long, switches long"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: its lower case if it is a letter, else 0."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low[0])
        _tables.append(table)
    return _tables[0]


@dataclass
class Words:
    """Words of several texts in order. sequence: each word's letters after a 0, and a 0 at the end."""

    sequence: np.ndarray
    begins: np.ndarray
    owner: np.ndarray
    hashes: list[np.ndarray] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.begins)


def words_of(texts: list[str]) -> Words:
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower = _letters()[codes]
    is_letter = lower > 0
    first = is_letter & ~np.r_[False, is_letter[:-1]]
    # One boundary before each word.
    at = np.flatnonzero(is_letter)
    number = np.cumsum(first)[at]
    sequence = np.zeros(len(at) + int(first.sum()) + 1, np.uint64)
    sequence[np.arange(len(at)) + number] = lower[at]
    begins = np.flatnonzero(sequence[:-1] == 0)[: int(first.sum())]
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, np.flatnonzero(first), "right")
    return Words(sequence, begins, owner)


def features(words: Words, bits: int = BITS) -> list[np.ndarray]:
    """Buckets of the features that begin at each place (-1 for none), n-gram by n-gram; then each word's own."""
    mask, out = np.uint64((1 << bits) - 1), []
    m = len(words.sequence) - 1
    s = np.r_[words.sequence, np.zeros(4, np.uint64)]
    inner = s != 0
    for n in (2, 3, 4):
        h, good = np.full(m, n, np.uint64) * _ODD[4], np.ones(m, bool)
        for k in range(n):
            h += s[k : k + m] * _ODD[k]
            if 0 < k < n - 1:
                good &= inner[k : k + m]
        h = (h ^ (h >> np.uint64(29))) * _ODD[1]
        bucket = ((h ^ (h >> np.uint64(32))) & mask).astype(np.int32)
        bucket[~good] = -1
        out.append(bucket)
    if len(words):
        lengths = np.diff(np.r_[words.begins, m])
        place = np.arange(m) - np.repeat(words.begins, lengths)
        powers = np.cumprod(np.full(64, _ODD[2]))
        h = np.add.reduceat(s[:m] * powers[np.minimum(place, 63)], words.begins)
        h = (h ^ (h >> np.uint64(31))) * _ODD[3]
        out.append(((h ^ (h >> np.uint64(32))) & mask).astype(np.int32))
    else:
        out.append(np.zeros(0, np.int32))
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (buckets + 1, languages); the last row stays 0
    moves: np.ndarray  # transition scores

    def emissions(self, words: Words) -> np.ndarray:
        *grams, own = features(words)
        if not len(words):
            return np.zeros((0, len(self.langs)))
        each = self.weights[grams[0]]
        for g in grams[1:]:
            each = each + self.weights[g]
        return np.add.reduceat(each, words.begins, axis=0) + self.weights[own]

    def posteriors(self, words: Words) -> np.ndarray:
        return forward_backward(self.emissions(words), words.owner, self.moves)


def forward_backward(scores: np.ndarray, owner: np.ndarray, moves: np.ndarray, block: int = BLOCK, pairs: bool = False):
    """Posterior of each word's label; chains are runs of equal owners, starting from equal odds.

    pairs: also the expected number of moves from each label to each, over all chains.
    """
    n, k = scores.shape
    if not n:
        return (np.zeros((0, k)), np.zeros((k, k))) if pairs else np.zeros((0, k))
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    a = np.exp(moves - moves.max())
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    lengths = np.diff(np.r_[starts, n])
    per = -(-lengths // block)  # blocks of each chain
    begin = np.repeat(starts, per) + block * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    size = np.minimum(block, np.repeat(starts + lengths, per) - begin)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    home = np.empty(len(order), np.int64)
    home[order] = np.arange(len(order))
    active = [int((size > t).sum()) for t in range(block)]

    def unit(x):
        return x / x.sum(axis=-1, keepdims=True)

    head = np.full((len(begin), k), 1.0 / k)  # forward message before each block
    tail = np.ones((len(begin), k)) / k  # backward message after each block
    chained = np.flatnonzero(per > 1)
    if len(chained):
        through = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()  # what a block makes of each label before it
        grown = np.zeros(len(begin))
        for t in range(block):
            m = active[t]
            if not m:
                break
            step = (through[:m] @ a) * e[begin[:m] + t][:, None, :]
            scale = step.max(axis=(1, 2), keepdims=True)
            through[:m] = step / scale
            grown[:m] += np.log(scale[:, 0, 0])
        first_block = np.cumsum(per) - per
        for c in chained:  # one small step for each block of a longer text
            ids = home[first_block[c] : first_block[c] + per[c]]
            x = np.full(k, 1.0 / k)
            for i, following in zip(ids, ids[1:], strict=False):
                x = unit(x @ through[i])
                head[following] = x
            y = np.ones(k) / k
            for p in range(len(ids) - 1, 0, -1):
                y = unit(through[ids[p]] @ y)
                tail[ids[p - 1]] = y
    fwd, x = np.empty((n, k)), head.copy()
    for t in range(block):
        m = active[t]
        if not m:
            break
        x[:m] = unit((x[:m] @ a) * e[begin[:m] + t])
        fwd[begin[:m] + t] = x[:m]
    out, y = np.empty((n, k)), tail.copy()
    ahead = np.empty((n, k)) if pairs else None  # what a word and those after it make of its label
    for t in range(block - 1, -1, -1):
        m = active[t]
        if m:
            at = begin[:m] + t
            out[at] = fwd[at] * y[:m]
            if pairs:
                ahead[at] = e[at] * y[:m]
            y[:m] = unit((e[at] * y[:m]) @ a.T)
    if not pairs:
        return unit(out)
    left = np.flatnonzero(owner[1:] == owner[:-1])
    both = fwd[left][:, :, None] * a[None] * ahead[left + 1][:, None, :]
    return unit(out), (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def train(texts: list[str], labels: list[str], epochs: int = 3, length: int = 32, seed: int = 5, rate: float = 0.3) -> Model:
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(seed)
    weights = np.zeros(((1 << BITS) + 1, k), np.float32)
    squares = np.full((1 << BITS) + 1, 1e-6, np.float32)
    moves, moves_sq = np.zeros((k, k)), np.full((k, k), 1e-6)
    if not texts:
        return Model([], weights, moves)
    words = words_of(texts)
    *grams, own = features(words)
    truth = np.array([langs.index(x) for x in labels])[words.owner]
    ends = np.r_[words.begins[1:], len(words.sequence) - 1]
    # Windows of `length` words, cut at document ends.
    starts = np.flatnonzero(np.r_[True, words.owner[1:] != words.owner[:-1]]) if len(words) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(words)])
    windows = [np.arange(s + at, s + min(at + length, size)) for s, size in zip(starts, sizes, strict=True) for at in range(0, int(size), length)]
    model = Model(langs, weights, moves)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        spliced = []
        for x, y in zip(order[::2], order[1::2], strict=False):
            cut = int(rng.integers(1, length))
            spliced.append(np.r_[windows[x][:cut], windows[y][:cut]] if rng.random() < 0.5 else np.r_[windows[y]])
            spliced.append(windows[x])
        for at in range(0, len(spliced), 200):
            some = spliced[at : at + 200]
            rows, chain = np.concatenate(some), np.repeat(np.arange(len(some)), [len(s) for s in some])
            counts = ends[rows] - words.begins[rows]
            places = np.repeat(words.begins[rows] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            of = np.repeat(np.arange(len(rows)), counts)
            index = np.concatenate([g[places] for g in grams] + [own[rows]])
            whose = np.concatenate([of] * len(grams) + [np.arange(len(rows))])
            live = index >= 0
            index, whose = index[live], whose[live]
            scores = np.zeros((len(rows), k))
            for c in range(k):
                scores[:, c] = np.bincount(whose, weights[index, c], len(rows))
            odds, expected = forward_backward(scores, chain, moves, pairs=True)
            error = -odds
            error[np.arange(len(rows)), truth[rows]] += 1
            touched, back = np.unique(index, return_inverse=True)
            gradient = np.stack([np.bincount(back, error[whose, c], len(touched)) for c in range(k)], axis=1) - 1e-3 * weights[touched]
            squares[touched] += (gradient**2).mean(axis=1)
            weights[touched] += rate * gradient / np.sqrt(squares[touched])[:, None]
            # Transitions: observed moves between neighbours less those expected.
            same = chain[1:] == chain[:-1]
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[rows][:-1][same], truth[rows][1:][same]), 1)
            step = (seen - expected) / max(same.sum(), 1) - 1e-4 * moves
            moves_sq += step**2
            moves += 0.2 * step / np.sqrt(moves_sq)
    return model


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> pd.DataFrame:
    """About `per_lang` labelled documents of each language, chosen by a hash of doc_id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not counts:
        return pd.DataFrame({"text": [], "lang": []})
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.where(key < share[F.col("lang")]).limit(2 * per_lang * len(counts))
    return picked.select("doc_id", "text", "lang").toPandas().sort_values(["lang", "doc_id", "text"], ignore_index=True)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    sample = training_sample(docs, per_lang)
    return train(list(sample["text"]), list(sample["lang"]))


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """Each word (in lower case) with its language and that language's probability."""
    words = words_of([text])
    odds = model.posteriors(words)
    ends = np.r_[words.begins[1:], len(words.sequence) - 1]
    return [
        ("".join(map(chr, words.sequence[b + 1 : e].tolist())), model.langs[int(o.argmax())], float(o.max()))
        for b, e, o in zip(words.begins, ends, odds, strict=True)
    ]


def label_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text: language, its mean probability over the words, words, switches between words."""
    n, k = len(texts), len(model.langs)
    words = words_of(texts)
    count = np.bincount(words.owner, minlength=n)
    if not k:
        return [UNKNOWN] * n, np.zeros(n), count, np.zeros(n, np.int64)
    odds = model.posteriors(words)
    share = np.stack([np.bincount(words.owner, odds[:, c], n) for c in range(k)], axis=1) / np.maximum(count, 1)[:, None]
    best = share.argmax(axis=1)
    said = odds.argmax(axis=1)
    turn = (said[1:] != said[:-1]) & (words.owner[1:] == words.owner[:-1])
    switches = np.bincount(words.owner[1:][turn], minlength=n) if len(words) else np.zeros(n, np.int64)
    names = [model.langs[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)]
    return names, np.clip(share[np.arange(n), best], 0, 1), count, switches


def _pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows of about CHARS characters: what a task holds in arrays at a time."""
    number = batch["text"].str.len().fillna(0).to_numpy().cumsum() // CHARS
    for k in np.unique(number):
        yield batch[number == k]


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, words, switches of every document; `keep` names columns to carry along."""
    schema = RESULT + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [label_texts(model, list(part["text"].fillna(""))) for part in _pieces(batch)]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
            for k, name in enumerate(("lang_pred", "score", "words", "switches")):
                out[name] = [x for m in made for x in m[k]]
            for c in keep:
                out[c] = batch[c]
            yield out

    return docs.select("doc_id", "text", *[c for c in keep if c != "text"]).mapInPandas(run, schema)


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a score of at least `least`, all columns; a null lang is filled in.

    Rejected are texts that are null or have no letters, and texts of which no one
    language covers as much as that share.
    """
    columns = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _pieces(batch):
                names, score, _, _ = label_texts(model, list(rows["text"].fillna("")))
                names = pd.Series(names, index=rows.index, dtype=object)
                rows = rows.assign(lang=rows["lang"].where(rows["lang"].notna(), names))
                yield rows[(names != UNKNOWN).to_numpy() & (score >= least)][columns]

    return docs.mapInPandas(run, docs.schema)
