"""Language identification: script ranges, then Viterbi over words with a switching penalty.

Fitting counts hashed character n-grams (1 to 4 characters, word ends marked) of all texts with a
known language, per language, by partial sums in each task; only languages x ``2 ** BITS`` counts
meet. It also keeps which scripts make up at least a hundredth of a language's letters.

A word's script (by code point ranges) narrows its candidates to the languages written in it. A
word's score in a language is the sum of log likelihoods of its n-grams, and the best path over
the words of a text, paying ``penalty`` for each change of language, labels spans. The text's
language is that of most letters; its score is the share of letters that the path gives to it,
times the chance of that language against the others over those words.

Text that is null or has no letter is ``und`` with score 0. Words without letters take the label
around them. Letters only in scripts that no language was learned in leave all languages as
candidates. With nothing to learn from, every text is ``und``. Rows with equal ids each give a row;
other columns are ignored; ties go to the first language in order of name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.batches import byte_texts, slices
from palisade.llm.caches import only

BITS = 17
LONGEST = 4
SMOOTH = 0.1
PENALTY = 12.0
MIN_SHARE = 0.01
OUTSIDE = 1_000.0
CACHE_SIZE = 100_000
GROUP = 10_000
STRIP_WORDS = 250_000
UNKNOWN = "und"
#: (first code point, script); a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"),
    (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
STARTS = [s for s, _ in SCRIPTS]
NAMES = [n for _, n in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    """The script of the word's first letter."""
    return NAMES[bisect_right(STARTS, ord(word[0])) - 1]


def gram_slots(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, owners) for each n-gram length: hashed n-grams of lower-case words with marked ends.

    The words stand in one array with a blank before and after each; an n-gram counts when no
    blank is inside it, and belongs to the word it begins in (a leading blank: the word after it).
    """
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    blank = points == 32
    owner = np.cumsum(blank) - 1
    valid = ~blank
    value = np.zeros(len(points), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            size = len(points) - n + 1
            if size < 1:
                return
            value = (value[:size] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
            mixed = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            if n == 2:
                valid = np.ones(size, dtype=bool)
            elif n > 2:
                valid = valid[:size] & ~blank[n - 2 : n - 2 + size]
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)[valid], owner[:size][valid]


def letter_words(text: str) -> list[str]:
    """Runs of letters, as written. (The word pattern also takes a few numerals; they go.)"""
    words = WORD.findall(text)
    if words and not "".join(words).isalpha():
        words = [w for w in words if any(map(str.isalpha, w))]
    return words


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, script, slot, n): counts of n-gram slots (script null) and of letters by script."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}
        slots: dict[str, np.ndarray] = {}
        letters: dict[tuple[str, str], int] = {}

        def spill(lang: str) -> None:
            table = slots.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            seen = words.pop(lang)
            keys, times = list(seen), np.array(list(seen.values()), dtype=np.int64)
            for at in range(0, len(keys), GROUP):
                part, n = [k.lower() for k in keys[at : at + GROUP]], times[at : at + GROUP]
                for found, owner in gram_slots(part):
                    table += np.bincount(found, n[owner], 1 << BITS).astype(np.int64)
            for word, n in seen.items():
                key = (lang, script_of(word))
                letters[key] = letters.get(key, 0) + n * len(word)

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                seen = words.setdefault(lang, Counter())
                seen.update(letter_words(text.decode("utf-8")))
                if len(seen) > CACHE_SIZE:
                    spill(lang)
        for lang in list(words):
            spill(lang)
        for lang, table in slots.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.nulls(len(used), pa.string()), pa.array(used), pa.array(table[used])],
                ["lang", "script", "slot", "n"],
            )
        if letters:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in letters], pa.string()),
                    pa.array([k[1] for k in letters], pa.string()),
                    pa.array([-1] * len(letters), pa.int64()),
                    pa.array(list(letters.values()), pa.int64()),
                ],
                ["lang", "script", "slot", "n"],
            )

    rows = labelled.where("lang IS NOT NULL").select("lang", "text")
    found = rows.mapInArrow(count, "lang string, script string, slot long, n long")
    return found.groupBy("lang", "script", "slot").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods per slot and language, and the languages of each script."""

    def __init__(self, counts: list[tuple[str, str | None, int, int]]):
        self.langs = sorted({c[0] for c in counts})
        row = {lang: i for i, lang in enumerate(self.langs)}
        table = np.full((1 << BITS, len(self.langs)), SMOOTH)
        letters: dict[str, np.ndarray] = {}
        for lang, script, slot, n in counts:
            if script is None:
                table[slot, row[lang]] += n
            else:
                letters.setdefault(script, np.zeros(len(self.langs)))[row[lang]] += n
        self.scores = np.log(table / table.sum(axis=0)).astype(np.float32)
        total = sum(letters.values(), np.zeros(len(self.langs)))
        self.scripts = {s: n >= MIN_SHARE * np.maximum(total, 1) for s, n in letters.items()}

    def of(self, words: list[str]) -> np.ndarray:
        """Scores (words x languages), the best of each word at 0."""
        n_langs = len(self.langs)
        score = np.zeros((len(words), n_langs))
        for slots, owner in gram_slots([w.lower() for w in words]):
            for i in range(n_langs):
                score[:, i] += np.bincount(owner, self.scores[slots, i], len(words))
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        script = np.array(NAMES)[np.searchsorted(STARTS, first, side="right") - 1]
        for name, allowed in self.scripts.items():
            if allowed.any() and not allowed.all():
                own = np.flatnonzero(script == name)
                part = score[own]
                score[own] = np.where(allowed, part, part.min(axis=1, keepdims=True) - OUTSIDE)
        return (score - score.max(axis=1, keepdims=True)).astype(np.float32)


def best_paths(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels for many texts at once: ``scores`` (words x languages), texts end to end.

    Texts are taken longest first, so that at each step those with a word left are a prefix.
    """
    n_langs = scores.shape[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), side="right")
    back = np.zeros(scores.shape, dtype=np.int8 if n_langs < 128 else np.int16)
    value = np.zeros((len(sizes), n_langs), dtype=np.float32)
    stay = np.arange(n_langs, dtype=back.dtype)
    for step, n in enumerate(active):
        rows = starts[:n] + step
        now = value[:n]
        if step:
            best = now.argmax(axis=1)
            top = now[np.arange(n), best][:, None] - penalty
            change = top > now
            back[rows] = np.where(change, best[:, None], stay)
            now = np.where(change, top, now)
        now = now + scores[rows]
        value[:n] = now - now.max(axis=1, keepdims=True)
    labels = np.zeros(len(scores), dtype=np.int64)
    label = value.argmax(axis=1)
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        rows = starts[:n] + step
        labels[rows] = label[:n]
        label[:n] = back[rows, label[:n]]
    return labels


def constant_paths(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """For each text the language of its best path where that path never changes, else -1.

    Let k be the best single language and g the most that any run of words gains in another single
    language over k. A path leaving k for m runs gains at most m g and changes at least m times, or
    m - 1 times if it never visits k and m > 1. With g below half the penalty none is better.
    """
    out = np.full(len(sizes), -1, dtype=np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return np.zeros(len(sizes), dtype=np.int64)
    starts = (np.cumsum(sizes) - sizes)[some]
    owner = np.repeat(np.arange(len(some)), sizes[some])
    best = np.add.reduceat(scores, starts, axis=0, dtype=np.float64).argmax(axis=1)
    base = scores[np.arange(len(scores)), best[owner]].astype(np.float64)
    # each text is let down below the one before, so that a running minimum begins anew
    fall = owner * (2.0 * (np.abs(scores).sum(dtype=np.float64) + 1))
    gain = np.zeros(len(scores))
    for k in range(scores.shape[1]):
        over = scores[:, k] - base
        ends = np.cumsum(over)
        np.maximum(gain, ends - fall - np.minimum.accumulate(ends - over - fall), out=gain)
    sure = np.maximum.reduceat(gain, starts) < penalty / 2
    out[some[sure]] = best[sure]
    out[sizes == 0] = 0
    return out


def texts_in_strips(texts: list[list[str]]) -> Iterator[slice]:
    """Runs of texts of about ``STRIP_WORDS`` words."""
    at = words = 0
    for i, text in enumerate(texts):
        words += len(text)
        if words >= STRIP_WORDS:
            yield slice(at, i + 1)
            at, words = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


class Labeller:
    """Scores of the words a worker has seen, in a table of bounded size."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.rows: dict[str, int] = {}
        self.table = np.zeros((CACHE_SIZE, len(model.langs)), dtype=np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.model.langs)), dtype=np.float32)
        for at in range(0, len(words), CACHE_SIZE // 2):
            part = words[at : at + CACHE_SIZE // 2]
            found = list(map(self.rows.get, part))
            if None in found:
                new = {w for w, i in zip(part, found) if i is None}
                if len(self.rows) + len(new) > CACHE_SIZE:
                    self.rows.clear()
                    new = set(part)
                fresh = sorted(new)
                for i in range(0, len(fresh), GROUP):
                    group = fresh[i : i + GROUP]
                    at_row = len(self.rows)
                    self.table[at_row : at_row + len(group)] = self.model.of(group)
                    self.rows.update(zip(group, range(at_row, at_row + len(group))))
                found = list(map(self.rows.__getitem__, part))
            out[at : at + len(part)] = self.table[found]
        return out

    def label(self, texts: list[list[str]]):
        """(labels, scores, lengths) of all words, texts end to end."""
        words = [w for t in texts for w in t]
        scores = self.scores(words)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        constant = constant_paths(scores, sizes, self.penalty)
        labels = np.repeat(constant, sizes)
        mixed = constant < 0
        if mixed.any():
            labels[np.repeat(mixed, sizes)] = best_paths(
                scores[np.repeat(mixed, sizes)], sizes[mixed], self.penalty
            )
        return labels, scores, np.fromiter(map(len, words), np.int64, len(words))


    def verdicts(self, texts: list[str]) -> Iterator[tuple[str, float, np.ndarray]]:
        """(language, score, labels of words) of each text."""
        langs = self.model.langs
        if not langs:
            yield from ((UNKNOWN, 0.0, np.zeros(0, dtype=np.int64)) for _ in texts)
            return
        words = [letter_words(t) for t in texts]
        for strip in texts_in_strips(words):
            labels, table, lengths = self.label(words[strip])
            at = 0
            for own in words[strip]:
                part = slice(at, at + len(own))
                at += len(own)
                if own:
                    best, score = verdict(labels[part], table[part], lengths[part])
                    yield langs[best], score, labels[part]
                else:
                    yield UNKNOWN, 0.0, labels[part]


def verdict(labels: np.ndarray, scores: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    letters = np.bincount(labels, lengths, scores.shape[1])
    best = int(letters.argmax())
    total = scores[labels == best].sum(axis=0, dtype=np.float64)
    chance = 1 / np.exp(np.minimum(total - total[best], 50)).sum()
    return best, float(letters[best] / letters.sum() * chance)


def fit(labelled: DataFrame) -> Model:
    """Fit on all rows of ``labelled`` (lang, text); languages x slots counts reach the driver."""
    return Model([tuple(r) for r in gram_counts(labelled).collect()])


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text).

    With ``spans``, also the labelled spans: array of (lang, start, end) in code points.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double"
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid")
        labeller = Labeller(shared.value, penalty)
        langs = shared.value.langs
        for batch in slices(batches):
            texts = [t.decode("utf-8") for t in byte_texts(batch.column(1))]
            found = list(labeller.verdicts(texts))
            columns = [
                batch.column(0),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array([merged(t, f[2], langs) for t, f in zip(texts, found)], span_type))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if spans:
        schema += ", spans array<struct<lang:string,start:int,end:int>>"
    return rows.mapInArrow(label, schema)


def merged(text: str, labels: np.ndarray, langs: list[str]) -> list[dict]:
    out: list[dict] = []
    matches = (m for m in WORD.finditer(text) if any(map(str.isalpha, m[0])))
    for match, label in zip(matches, labels):
        if out and out[-1]["lang"] == langs[label]:
            out[-1]["end"] = match.end()
        else:
            out.append({"lang": langs[label], "start": match.start(), "end": match.end()})
    return out


def kept(docs: DataFrame, model: Model, least: float, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid")
        labeller = Labeller(shared.value, penalty)
        for batch in slices(batches):
            texts = byte_texts(batch.column(batch.schema.get_field_index("text")))
            scores = [score for _, score, _ in labeller.verdicts([t.decode("utf-8") for t in texts])]
            yield batch.filter(pa.array([score >= least for score in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
