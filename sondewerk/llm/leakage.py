"""Evaluation texts inside training texts: one Aho-Corasick automaton over normalised passages."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondewerk.util import materialize, worker_cache

#: Consecutive words that make a leak, and words of a pattern: any run of WORDS holds an aligned block of half its length.
WORDS, BLOCK = 16, 8
#: Characters of a bank whose patterns go into one automaton; a larger bank is searched in several passes.
BANK_CHARS = 16_000_000
PARTS = ("text", "answer")

_WORD = re.compile(r"[^\W_]+")
_DROP = dict.fromkeys((0x00AD, 0x200B))


def normalise(text: str) -> str:
    """NFKC, lower case, without soft hyphens and zero-width spaces."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).lower().translate(_DROP)


def words(text: str) -> list[str]:
    return _WORD.findall(normalise(text))


def original_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in the original text of every word of ``words(text)``.

    Each stretch of a base character with its marks is normalised by itself; should that differ from
    the whole (sequences that compose across stretches), stretches are widened to whole white-space parts.
    """
    for pattern in (r".[̀-ͯ­​]*", r"\s+|\S+"):
        out, at = [], []
        for m in re.finditer(pattern, text, re.S):
            piece = normalise(m.group())
            out.append(piece)
            at += [(m.start(), m.end())] * len(piece)
        joined = "".join(out)
        if joined == normalise(text):
            break
    found = [(at[m.start()][0], at[m.end() - 1][1]) for m in _WORD.finditer(joined)]
    return found


class Bank:
    """One automaton over the aligned blocks of all texts and answers, and over the answers as they stand.

    items: (item, text, answer). A text or an answer of at least ``length`` words is a passage; any
    answer is also looked up as a whole, to tell whether it stands in a document that holds a passage.
    """

    def __init__(self, items: list[tuple[int, str | None, str | None]], length: int, block: int):
        import ahocorasick

        self.length, self.block = length, block
        self.words = {(i, part): words(t) for i, *both in items for part, t in zip(PARTS, both) if t}
        places: dict[str, list[tuple[tuple[int, str], int]]] = defaultdict(list)
        for key, w in self.words.items():
            if len(w) >= length:
                for p in range(0, len(w) - block + 1, block):
                    places[" " + " ".join(w[p : p + block]) + " "].append((key, p))
        self.empty = not places
        self.answers = {i: f" {' '.join(w)} " for (i, part), w in self.words.items() if part == "answer" and w}
        self.automaton = ahocorasick.Automaton()
        for k in {*places, *self.answers.values()}:
            self.automaton.add_word(k, (k, places.get(k, ())))
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[tuple[int, str], tuple[int, int, bool]]:
        """(item, part) -> (first word, number of words) of its longest run in the text, of at least ``length`` words, and whether the item's answer stands in the text."""
        if self.empty:
            return {}
        doc = words(text)
        if len(doc) < self.length:
            return {}
        hay = " " + " ".join(doc) + " "
        starts: list[int] | None = None
        found: dict[tuple[int, str], tuple[int, int]] = {}
        done: dict[tuple[tuple[int, str], int], int] = {}
        seen = set()
        for end, (pattern, places) in self.automaton.iter(hay):
            seen.add(pattern)
            if places and starts is None:
                starts, at = [], 1
                for w in doc:
                    starts.append(at)
                    at += len(w) + 1
            d = bisect_right(starts, end - len(pattern) + 2) - 1 if places else 0
            for key, p in places:
                # a run goes along one diagonal; once walked, its other blocks add nothing
                if done.get((key, d - p), -1) >= d:
                    continue
                w = self.words[key]
                a, b = 0, self.block
                while d - a > 0 and p - a > 0 and doc[d - a - 1] == w[p - a - 1]:
                    a += 1
                while d + b < len(doc) and p + b < len(w) and doc[d + b] == w[p + b]:
                    b += 1
                done[key, d - p] = d + b - 1
                if a + b >= self.length and a + b > found.get(key, (0, 0))[1]:
                    found[key] = (d - a, a + b)
        return {k: (*run, self.answers.get(k[0]) in seen) for k, run in found.items()}


_HIT = "doc_id bigint, item_id bigint, part string, words int, start int, end int, answer boolean"


def _scan(items: list[tuple[int, str | None, str | None]], key: str, length: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("leak key") != key:
            cache["leak key"], cache["leak bank"] = key, Bank(items, length, block)
        bank = cache["leak bank"]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if hits := bank.find(text):
                    spans = original_spans(text)
                    rows += [(doc, item, part, n, spans[first][0], spans[first + n - 1][1], answer) for (item, part), (first, n, answer) in hits.items()]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "item_id", "part", "words", "start", "end", "answer"])

    return run


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", item_answer: str | None = None, length: int = WORDS, block: int = BLOCK, bank_chars: int = BANK_CHARS) -> DataFrame:
    """(doc_id, item_id, part, words, start, end, answer): documents that hold at least ``length`` consecutive words of an item.

    part: 'text' or, if item_answer names the answers, 'answer', for an answer long enough to be a passage.
    words is the longest such run, start and end its place in characters of the original text; answer tells whether
    the item's whole answer, however short, stands in the document, too. Null ids and texts give nothing, nor do
    passages of fewer than ``length`` words; an item counts even if others hold the passage, too. Texts
    are scanned whole and never shuffled, once for every bank_chars characters of the bank, which is what an
    automaton of some 2 GB holds. Repeated rows give repeated results.
    """
    if length < 2 * block - 1:
        raise ValueError("a run must hold an aligned block: length >= 2 * block - 1")
    answer = F.col(item_answer) if item_answer else F.lit(None).cast("string")
    bank = materialize(items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"), answer.alias("a")).filter("t is not null or a is not null").distinct())
    size = bank.agg(F.sum(F.coalesce(F.length("t"), F.lit(0)) + F.coalesce(F.length("a"), F.lit(0)))).first()[0] or 0
    passes = max(1, -(-size // bank_chars))
    rows = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(passes):
        part = [(r["i"], r["t"], r["a"]) for r in bank.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).collect()]
        hits = rows.mapInArrow(_scan(part, f"{bank._sondewerk_path}/{k}/{length}/{block}", length, block), _HIT)
        out = hits if out is None else out.unionByName(hits)
    return out


def leak_report(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(item_id, documents, with_answer): per leaked item, in how many documents a passage of it stands, and in how many its answer does, too."""
    hits = leaks(documents, items, **how).groupBy("item_id", "doc_id").agg(F.max("answer").alias("answer"))
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if("answer").alias("with_answer"))
