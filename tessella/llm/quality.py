"""Quality rules: distribution divergence.

Every document has two histograms, of character classes and of the common
words of its language. Both are held against the language's reference, which
is counted over all documents of that language, by the Jensen-Shannon distance
(base 2, so 0 to 1). A document goes when a distance is over its limit. Noise
adds about 1 / n to the square of the distance of n words, so the square of the
word limit grows by `short` (1 / n - 1 / 100) below 100 words; the rule speaks
from 50 words on, below which the base rules reject.

Two passes read the table, and nothing but counts is shuffled: (1) classes and
all words are counted exactly, by language, (2) every whole text is judged where
it lies. What the second pass gets is the `common` most frequent words and 11
counts for each of `languages` languages, the largest by words, and for all
documents together (the pooled reference); documents of further languages are
held against the pooled one. Ties in frequency go by the word, so the result
does not depend on how rows are dealt out.

Defined results: a null or empty text has no words and fails the base rules; a
null lang is a language of its own; a repeated row is judged each time; a
language whose reference has under `least_reference` words is held against the
pooled reference, under `pooled_limit`, as clean text of one language is further
from a mixture; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut_table, keep_rows, rows_of, texts

#: Class of each UTF-8 byte; 0: continuation bytes, which count for nothing.
CLASSES = 11
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    kind = np.full(256, 7, np.int64)
    kind[0x80:0xC0] = 0
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[[0x20, 0x09]] = 4
    kind[0x0A:0x0E] = 5
    kind[list(b".,;:!?'\"()-")] = 6
    kind[0xC0:0xC4] = 8
    kind[0xC4:0xD0] = 9
    kind[0xD0:] = 10
    return kind


KIND = _classes()
POOLED = "\x00all"


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def class_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(KIND, weights=counts, minlength=CLASSES)[1:]


def common_form(text: bytes) -> list[bytes]:
    """Words without case and end punctuation."""
    return text.lower().translate(None, b".,;:!?").split()


def base(text: bytes, counts: np.ndarray, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    chars = len(text) - int(counts[0x80:0xC0].sum()) - int(counts[list(SPACE)].sum())
    symbols = int(counts[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    found = Counter(windows)
    if len(found) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return chars, symbols, len(lines) - len(set(lines)), repeated


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def references(docs: DataFrame, common: int = 64, languages: int = 256) -> dict:
    """lang -> (class counts, {word: place}, word counts with the rest last)."""
    counted = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        """Counts of all words, of classes (" 0" and so on) and of words in all
        (" all"); what a task holds is handed on when it gets large."""
        seen, size = defaultdict(Counter), 0

        def flush():
            rows = [(lang, w, int(n)) for lang, c in seen.items() for w, n in c.items()]
            seen.clear()
            return rows_of({"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": [r[2] for r in rows]}, counted)

        for b in batches:
            for text, lang in zip(texts(b.column(0)), b.column(1).to_pylist()):
                if text:
                    own, words = seen[lang], common_form(text)
                    before = len(own)
                    own.update(words)
                    own[b" all"] += len(words)
                    for i, n in enumerate(class_counts(byte_counts(text))):
                        own[b" %d" % i] += n
                    size += len(own) - before
                    if size > 400_000:
                        yield flush()
                        size = 0
        yield flush()

    def total(rows, *by):
        return rows.groupBy(*by).agg(F.sum("n").alias("n"))

    every = cut_table(total(docs.select("text", "lang").mapInArrow(count, "lang string, word binary, n long"), "lang", "word"))
    largest = every.filter(F.col("word") == b" all").orderBy(F.desc("n"), "lang").limit(languages).select(F.col("lang").alias("own"))
    of_languages = every.join(largest, F.col("lang").eqNullSafe(F.col("own")), "left_semi")
    said, kinds = F.substring("word", 1, 1) != b" ", F.substring("word", 1, 1) == b" "
    ranked = of_languages.filter(said).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= common)
    rows = [(r.lang, bytes(r.word), r.n) for r in ranked.select("lang", "word", "n").unionByName(of_languages.filter(kinds)).toLocalIterator()]
    pool = total(every, "word")
    rows += [(POOLED, bytes(r.word), r.n) for r in (*pool.filter(said).orderBy(F.desc("n"), "word").limit(common).collect(), *pool.filter(kinds).collect())]

    counts: dict = {POOLED: {}}
    for lang, word, n in rows:
        counts.setdefault(lang, {})[word] = n
    out = {}
    for lang, c in counts.items():
        own = sorted((w for w in c if not w.startswith(b" ")), key=lambda w: (-c[w], w))
        rest = c.get(b" all", 0) - sum(c[w] for w in own)
        out[lang] = (np.array([c.get(b" %d" % i, 0) for i in range(CLASSES - 1)], float), {w: i for i, w in enumerate(own)}, np.array([c[w] for w in own] + [rest], float))
    return out


def verdict(reference: dict, class_limit: float, word_limit: float, least_chars: int, least_words: int, least_reference: int, short: float, pooled_limit: float):
    """A function from a text and its language to the columns of JUDGED."""

    def of(text: bytes, lang: str | None) -> tuple:
        counts, words = byte_counts(text), text.split()
        chars, symbols, lines, repeated = base(text, counts, words)
        n = len(words)
        failed = n < 50 or 100 * repeated > 50 * n
        own = reference.get(lang)
        pooled = own is None or own[2].sum() < least_reference
        classes, place, usual = reference[POOLED] if pooled else own
        by_class = by_word = None
        most = pooled_limit if pooled else word_limit
        if chars >= least_chars:
            by_class = distance(class_counts(counts), classes)
        if n >= least_words:
            said = np.zeros(len(usual))
            for w, k in Counter(filter(place.__contains__, common_form(text))).items():
                said[place[w]] = k
            said[-1] = max(0.0, n - said.sum())
            by_word = distance(said, usual)
            most = (most**2 + short * max(0.0, 1 / n - 1 / 100)) ** 0.5
        kept = not failed and not (by_class is not None and by_class > class_limit) and not (by_word is not None and by_word > most)
        return n, chars, symbols, lines, repeated, failed, by_class, by_word, kept

    return of


JUDGED = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())])
#: Limits lie between prose and list-like, shouted or symbol-ridden text.
LIMITS = {"class_limit": 0.3, "word_limit": 0.4, "least_chars": 200, "least_words": 50, "least_reference": 5000, "short": 3.0, "pooled_limit": 0.5}


def judge(docs: DataFrame, common: int = 64, languages: int = 256, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance
    (null below `least_chars` and `least_words`) and kept."""
    reference = references(docs, common, languages=languages)
    limits = LIMITS | limits

    def run(batches):
        of = verdict(reference, **limits)
        for b in batches:
            rows = [of(text or b"", lang) for text, lang in zip(texts(b.column(1)), b.column(2).to_pylist())]
            columns = list(zip(*rows)) or [()] * len(JUDGED)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, JUDGED))], names=["doc_id", *JUDGED.names])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean")


def keep(docs: DataFrame, common: int = 64, languages: int = 256, **limits) -> DataFrame:
    """The documents that judge() keeps, with all their columns."""
    reference = references(docs, common, languages=languages)
    limits = LIMITS | limits

    def make():
        of = verdict(reference, **limits)
        return lambda b: [of(text or b"", lang)[-1] for text, lang in zip(texts(b.column("text")), b.column("lang").to_pylist())]

    return keep_rows(docs, make)
