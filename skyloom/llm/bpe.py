"""Byte-level BPE with a lexicon of frequent words in a minimal acyclic transducer.

All words of the corpus of up to LONGEST bytes are counted; the LEXICON_WORDS most frequent ones (a parameter that bounds the lexicon's size,
not what is encoded) are merged once and compiled into a minimal acyclic automaton: words that end alike share their
suffixes. Each arc carries the number of lexicon words that precede those below it, so the outputs along a word's path
add up to its rank, which is its place in an array of token ids. States, arcs, outputs and ids lie in one flat file
that Spark sends to every executor and that workers map into memory. A word that the transducer doesn't accept is merged
exactly, by rank and then from the left, in O(n log n).

Texts are split as the vocabulary's own library does it: special tokens first, then the byte-level pattern. Decoding
concatenates the tokens' bytes. Null text counts as empty (no tokens); repeated rows each get their row; an empty table
gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, slices, spread, table
from .quality_rules import edge

#: Words in the lexicon at most, and the longest that enter it, in bytes.
LEXICON_WORDS, LONGEST = 1 << 17, 64
_NO_RANK = 1 << 62
#: White space as the library's regular expressions have it: Unicode's White_Space, without U+001C to U+001F.
_S = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD = regex.compile(_PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{S}", _S))
#: The same for texts of characters below U+0100, with their letters and numbers listed.
WORD_LATIN = re.compile(_PATTERN.replace("{L}", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff").replace("{N}", "0-9\xb2\xb3\xb9\xbc-\xbe").replace("{S}", r"\x09-\x0d\x20\x85\xa0"))
_ABOVE_LATIN = re.compile("[^\x00-\xff]")


def split_words(text: str) -> list[str]:
    return (WORD if _ABOVE_LATIN.search(text) else WORD_LATIN).findall(text)


def vocabulary_path() -> str:
    """The installed file of the public 50k byte-level vocabulary; it is on every executor as a part of its Python."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Vocabulary:
    """Token bytes and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        unletter = lambda s: bytes(letters[c] for c in s)
        ids = {unletter(t): i for t, i in data["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content in self.special:
            ids.pop(content.encode(), None)
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        #: left id << 20 | right id -> rank << 20 | id
        self.rank_of: dict[int, int] = {}
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = unletter(a), unletter(b)
            self.rank_of[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        self.token = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, and special tokens with their ids, in order."""
        at = 0
        for m in self.cut.finditer(text) if self.cut and any(x in text for x in self.special) else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of least rank, the leftmost of equals; for long words with a heap over a linked list."""
        ids: list = list(map(self.byte_id.__getitem__, word))
        n, get = len(ids), self.rank_of.get
        if n <= LONGEST:
            ranks = [get(a << 20 | b, _NO_RANK) for a, b in zip(ids, ids[1:])]
            while ranks and (least := min(ranks)) != _NO_RANK:
                k, new = ranks.index(least), least & 0xFFFFF
                ids[k : k + 2] = [new]
                del ranks[k]
                if k:
                    ranks[k - 1] = get(ids[k - 1] << 20 | new, _NO_RANK)
                if k < len(ranks):
                    ranks[k] = get(new << 20 | ids[k + 1], _NO_RANK)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, k) for k in range(n - 1) if (m := get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            if ids[k] is None or (j := after[k]) >= n or get(ids[k] << 20 | ids[j]) != m:
                continue
            new = m & 0xFFFFF
            ids[k], ids[j] = new, None
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (m := get(new << 20 | ids[j])) is not None:
                    heapq.heappush(heap, (m, k))
            if (i := before[k]) >= 0 and (m := get(ids[i] << 20 | new)) is not None:
                heapq.heappush(heap, (m, i))
        return [x for x in ids if x is not None]


@lru_cache(4)
def vocabulary(path: str | None) -> Vocabulary:
    """The vocabulary of a path, or else the installed one, found where this runs: on the driver or a worker."""
    return Vocabulary(path or vocabulary_path())


def build_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer as bytes. Words are added in order; states are made unique from the end of each word as soon as it can't change any more."""
    words = sorted(entries)
    register: dict = {}
    arcs: list[list[tuple[int, int]]] = []  # of unique states: (label, state), in order of labels
    final: list[bool] = []

    def unique(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(node[1])
            final.append(node[0])
        return register[key]

    path: list[list] = [[False, []]]  # unfinished states along the last word: [final, arcs], the last arc of each still open
    last = b""
    for word in [*words, None]:
        common = 0
        while word is not None and common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], unique(node)))
        if word is not None:
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
    return _packed(unique(path[0]), arcs, final, words, entries)


def _packed(root: int, arcs: list, final: list[bool], words: list[bytes], entries: dict[bytes, list[int]]) -> bytes:
    """States in a shared table of slots: the arc of state s with label b is slot base[s] + b, if owner is s there."""
    below = [0] * len(arcs)  # words accepted from each state; targets have lower numbers
    used, low, high = bytearray(1), 0, 0
    base, slots = np.zeros(len(arcs), np.int32), []
    for s, out in enumerate(arcs):
        n = int(final[s])
        labels, outputs = [a[0] for a in out], []
        for _, target in out:
            outputs.append(n)
            n += below[target]
        below[s] = n
        if not out:
            continue
        used += bytes(max(0, low + 4096 - len(used)))
        low = slot = used.find(0, low)
        for tries in count():
            at = slot - labels[0] if tries < 64 else high
            used += bytes(max(0, at + 257 - len(used)))
            if at >= 0 and not any(used[at + b] for b in labels):
                break
            slot = used.find(0, slot + 1)
            if slot < 0:
                slot = len(used)
        base[s] = at
        for (b, target), first in zip(out, outputs):
            used[at + b] = 1
            high = max(high, at + b + 1)
            slots.append((at + b, s, target, first))
    size = int(base.max(initial=0)) + 257
    table = np.full((3, size), -1, np.int32)
    if slots:
        got = np.array(slots, np.int32).T
        table[:, got[0]] = got[1:]
    starts = np.cumsum([0, *(len(entries[w]) for w in words)], dtype=np.int32)
    ids = np.array([x for w in words for x in entries[w]], np.int32)
    parts = [base, np.array(final, np.int32), *table, starts, ids]
    return struct.pack("<8i", root, *map(len, parts)) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A mapped transducer file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = struct.unpack("<8i", self.map[:32])
        at, parts = 32, []
        for n in sizes:
            parts.append(np.frombuffer(self.map, np.int32, n, at))
            at += 4 * n
        self.base, self.final, self.owner, self.target, self.output, self.starts, self.ids = parts

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of the outputs along its path, or -1 if the path isn't there; all words step together."""
        text = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        state, rank = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(size <= LONGEST)
        done = np.full(len(words), -1, np.int64)
        step = 0
        while len(alive):
            ends = size[alive] == step
            e = alive[ends]
            done[e] = np.where(self.final[state[e]] == 1, rank[e], -1)
            alive = alive[~ends]
            slot = self.base[state[alive]] + text[start[alive] + step]
            there = self.owner[slot] == state[alive]
            alive, slot = alive[there], slot[there]
            rank[alive] += self.output[slot]
            state[alive] = self.target[slot]
            step += 1
        return done

    def get_many(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Each word's ids; None for words that aren't accepted."""
        ranks = self.ranks(words)
        first, last = self.starts[ranks].tolist(), self.starts[ranks + 1].tolist()
        return [None if k < 0 else tuple(self.ids[a:b].tolist()) for k, a, b in zip(ranks.tolist(), first, last)]


@lru_cache(4)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def count_words(docs: DataFrame, path: str | None) -> DataFrame:
    """(word, n) over all texts; each task adds up a batch's words before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        total: Counter = Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                for piece, special in voc.pieces(text or ""):
                    if special is None:
                        total.update(split_words(piece))
            if len(total) > 250_000:
                yield _counted(total)
                total = Counter()
        yield _counted(total)

    return spread(docs.select("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    kept = [w for w in total if len(w.encode()) <= LONGEST]
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([total[w] for w in kept], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, path: str | None, n_words: int) -> list[str]:
    """About n_words of the words with the highest counts: all above a bucket of counts, and of that bucket a share picked by hash. No task sorts or merges words."""
    counts = materialise(count_words(docs, path).withColumn("bucket", F.expr(edge("n"))), "bpe-counts")
    room, last, share = n_words, None, 0.0
    for r in sorted(counts.groupBy("bucket").agg(F.count("*").alias("words")).collect(), reverse=True):
        last, share = r["bucket"], min(1.0, room / r["words"])
        room -= r["words"]
        if room <= 0:
            break
    if last is None:
        return []
    picked = (F.col("bucket") > last) | (F.col("bucket") == last) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return sorted(counts.filter(picked).select("word").toArrow()["word"].to_pylist())


def make_lexicon(docs: DataFrame, path: str | None, n_words: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words and sends the file to the executors; returns its name there. The driver gets about n_words rows."""
    top = frequent_words(docs, path, n_words)
    voc = vocabulary(path)
    data = build_lexicon({w.encode(): voc.merge(w.encode()) for w in top})
    name = f"lexicon_{uuid.uuid4().hex}.bin"
    sc, local = docs.sparkSession.sparkContext, os.path.join(tempfile.mkdtemp(), name)
    with open(local, "wb") as f:
        f.write(data)
    sc.addFile(local)
    return name


class Encoder:
    """Encodes and decodes texts; of the words of recent texts, about MOST_KNOWN, the ids are kept."""

    MOST_KNOWN = 500_000

    def __init__(self, voc: Vocabulary, lex: Lexicon):
        self.voc, self.lex, self.known = voc, lex, {}
        self.one = list(range(max(voc.token) + 1))  # one object for each id, however many words have it

    def learn(self, words: set[str]) -> None:
        """Looks up all words that aren't known at once, and merges those that the lexicon doesn't have."""
        if len(self.known) > self.MOST_KNOWN:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        for w, r, ids in zip(new, raw, self.lex.get_many(raw)):
            self.known[w] = tuple(map(self.one.__getitem__, self.voc.merge(r) if ids is None else ids))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [[(p, special) if special is not None else (split_words(p), None) for p, special in self.voc.pieces(t or "")] for t in texts]
        self.learn(set(chain.from_iterable(p for pieces in cut for p, special in pieces if special is None)))
        ids_of = self.known.__getitem__
        return [[i for p, special in pieces for i in ((special,) if special is not None else chain.from_iterable(map(ids_of, p)))] if len(pieces) != 1 or pieces[0][1] is not None else list(chain.from_iterable(map(ids_of, pieces[0][0]))) for pieces in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.voc.token.__getitem__, ids)).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str | None = None, n_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (array of int) for every row of docs."""
    return _run(docs, path, n_words, False)


def encode_digests(docs: DataFrame, path: str | None = None, n_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""
    return _run(docs, path, n_words, True)


def _run(docs: DataFrame, path: str | None, n_words: int, digests: bool) -> DataFrame:
    ship(docs.sparkSession)
    name = make_lexicon(docs, path, n_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocabulary(path), lexicon(SparkFiles.get(name)))
        voc = coder.voc
        text_of = [str(i) for i in range(max(voc.token) + 1)]
        for b in slices(batches):
            rows = []
            for ids in coder.encode(b.column(1).to_pylist()):
                if digests:
                    listed = ",".join(map(text_of.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()))
                else:
                    rows.append(ids)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.string(), pa.string()))] if digests else [pa.array(rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return spread(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")).mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
