"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are compiled, with their token ids as outputs,
into a minimal acyclic automaton whose arcs carry increments: the sum along a word's
path is the word's number, which addresses its ids. The file is memory-mapped by the
workers. Words outside it are merged exactly, pair of least rank first.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import heapq
import json
import math
import mmap
import os
import re
import struct
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import cut, lean, scratch_path, write_bytes

#: Words in the lexicon: the most frequent ones of the corpus, ties to the smaller word.
LEXICON_WORDS = 40_000
#: Chunks (what white space separates) that a worker remembers, and that it counts before it passes the counts on.
REMEMBERED = 300_000
#: Longest word or chunk in characters that is counted or remembered; longer ones are merged each time.
LONGEST = 256
#: Bytes of a word up to which the least pair is sought anew for each merge; pairs of longer words wait in a heap.
SHORT = 64
_NEVER = 1 << 60
#: Bits of an id within a number that holds more.
_SHIFT = 20
_LOW = (1 << _SHIFT) - 1


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: printable Latin-1 stands for itself, others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


#: Below U+0180 all is assigned, composed, and folded one to one, but for U+0130.
_BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")
_SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.cache
def unassigned() -> re.Pattern:
    """A class of all code points without a category here."""
    runs, last = [], None
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if last is not None and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
            last = c
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class WordBpe:
    """The rules of a word-end BPE file: NFC, white space to spaces, lower case, split, merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"]
        self.symbols = byte_symbols()
        #: ids of each byte, within a word and as its end
        self.inner, self.last = ([self.vocab[c + end] for c in self.symbols] for end in ("", suffix))
        #: pair of ids (the first one shifted) -> rank (shifted) and id of the merged symbol
        self.merges: dict[int, int] = {}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault(self.vocab[a] << _SHIFT | self.vocab[b], n << _SHIFT | self.vocab[a + b])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        rule = split["pattern"]["Regex"]
        self.pattern = regex.compile(rule)
        letters, digits = ("".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN")
        self.ascii, self.latin = (
            re.compile(
                rule.replace(r"\s", r" \t\n\r\x0b\x0c\x85\xa0").replace(r"\p{L}", "".join(c for c in letters if ord(c) < top)).replace(r"\p{N}", "".join(c for c in digits if ord(c) < top))
            ).findall
            for top in (0x80, 0x180)
        )
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.digits = {i: str(i) for i in self.names}
        self.path, self.library = path, None

    def chunks(self, text: str) -> list[str]:
        """The folded text without special tokens, cut where no word goes on: at white space."""
        if not text.isascii() and _BEYOND_LATIN.search(text):
            if unassigned().search(text):
                return self._library_words(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character is folded by itself, without the final form of sigma
                text = text.replace("Σ", "σ")
        if _SEPARATORS.search(text):  # str.split takes these for white space, the rules don't
            return self.words(text.lower())
        return text.lower().split()

    def words(self, chunk: str) -> list[str]:
        """Words of a folded chunk: by a pattern for ASCII, one for Latin letters, or in full. A word is its own only word."""
        if chunk.isascii():
            return self.ascii(chunk)
        if not _BEYOND_LATIN.search(chunk):
            return self.latin(chunk)
        return [chunk] if unassigned().search(chunk) else self.pattern.findall(chunk)  # the library's own words are whole

    def _library_words(self, text: str) -> list[str]:
        """Words of a text with code points that only some Unicode versions know, as the library splits it."""
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path), {c: n for n, c in enumerate(self.symbols)}
        tok, back = self.library
        pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in pieces]

    def parts(self, text: str):
        """Chunks and special tokens in order, as (is special, chunks)."""
        if "<" not in text:
            yield False, self.chunks(text)
            return
        for part in self.special_split.split(text):
            if part in self.specials:
                yield True, [part]
            elif part:
                yield False, self.chunks(part)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of least rank, leftmost first, until none is left."""
        data = word.encode("utf-8", "surrogatepass")
        seq = [self.inner[b] for b in data]
        seq[-1] = self.last[data[-1]]
        if len(seq) > SHORT:
            return self._merge_long(seq)
        find = self.merges.get
        pairs = [find(a << _SHIFT | b, _NEVER) for a, b in zip(seq, seq[1:])]
        while pairs and (least := min(pairs)) < _NEVER:
            n = pairs.index(least)
            own = least & _LOW
            seq[n : n + 2] = [own]
            del pairs[n]
            if n < len(pairs):
                pairs[n] = find(own << _SHIFT | seq[n + 1], _NEVER)
            if n:
                pairs[n - 1] = find(seq[n - 1] << _SHIFT | own, _NEVER)
        return seq

    def _merge_long(self, seq: list[int]) -> list[int]:
        """The same in n log n steps: symbols are a linked list, pairs wait in a heap."""
        size, find, push = len(seq), self.merges.get, heapq.heappush
        # rank, place and id of the merged symbol in one number
        heap = [(m >> _SHIFT) * size + n << _SHIFT | m & _LOW for n in range(size - 1) if (m := find(seq[n] << _SHIFT | seq[n + 1])) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            top = heapq.heappop(heap)
            r, n = divmod(top >> _SHIFT, size)
            m = after[n]
            # a pair whose symbols have changed since has another rank, or none
            if m >= size or seq[n] < 0 or (now := find(seq[n] << _SHIFT | seq[m])) is None or now >> _SHIFT != r:
                continue
            own = seq[n] = top & _LOW
            seq[m] = -1
            m = after[n] = after[m]
            if m < size:
                before[m] = n
                if (now := find(own << _SHIFT | seq[m])) is not None:
                    push(heap, (now >> _SHIFT) * size + n << _SHIFT | now & _LOW)
            if (m := before[n]) >= 0 and (now := find(seq[m] << _SHIFT | own)) is not None:
                push(heap, (now >> _SHIFT) * size + m << _SHIFT | now & _LOW)
        return [i for i in seq if i >= 0]

    def spell(self, ids: list[int]) -> tuple[str, str]:
        """Ids in decimal and tokens, each joined by spaces: the file names no decoder."""
        return " ".join([self.digits[i] for i in ids]), " ".join([self.names[i] for i in ids])


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words (in byte order, states shared by their futures),
    with arcs that carry the number of words they skip, and the ids of each word by number.

    Layout, little-endian int32: counts (states, cells, words, ids) behind the root; per state: base, then
    final; per cell: owner, then target, then increment; per word: first id; then the ids.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    sizes: list[int] = []

    def freeze(node: list) -> int:
        final, arcs = node
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            sizes.append(int(final) + sum(sizes[t] for _, t in arcs))
        return register[key]

    words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items())
    path: list[list] = [[False, []]]
    before = b""
    for word, _ in words:
        shared = len(os.path.commonprefix([before, word]))
        for n in range(len(before), shared, -1):
            target = freeze(path.pop())
            path[-1][1].append((before[n - 1], target))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        before = word
    for n in range(len(before), 0, -1):
        target = freeze(path.pop())
        path[-1][1].append((before[n - 1], target))
    root = freeze(path[0])
    base, owner, target, skip = _arrays(states, sizes)
    first, flat = [0], []
    for _, ids in words:
        flat += ids
        first.append(len(flat))
    head = [root, len(states), len(owner), len(words), len(flat)]
    ends = [int(final) for final, _ in states]
    return b"".join(struct.pack(f"<{len(x)}i", *x) for x in (head, base, ends, owner, target, skip, first, flat))


def _arrays(states: list[tuple[bool, tuple]], sizes: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The arcs as a double array: that of state s over byte b lies at base[s] + b, where its owner is s.
    States of many arcs are placed first, each at the first base where all its arcs find free cells."""
    base, taken = [0] * len(states), np.zeros(1 << 16, dtype=bool)
    start = 0
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        bytes_ = np.array([b for b, _ in states[s][1]], dtype=np.int64)
        if not len(bytes_):
            break  # states without arcs come last and own no cell
        while taken[start]:
            start += 1
        at = max(0, start - int(bytes_[0]))
        while True:
            if len(taken) < at + 4096 + 256:
                taken = np.concatenate([taken, np.zeros(len(taken), dtype=bool)])
            free = ~taken[at : at + 4096 + 256]
            fits = np.logical_and.reduce([free[b : b + 4096] for b in bytes_])
            if fits.any():
                base[s] = at + int(np.argmax(fits))
                break
            at += 4096
        taken[base[s] + bytes_] = True
    n = int(np.flatnonzero(taken)[-1]) + 257 if taken.any() else 257
    owner, target, skip = [-1] * n, [0] * n, [0] * n
    for s, (final, arcs) in enumerate(states):
        before = int(final)
        for b, t in arcs:
            owner[base[s] + b], target[base[s] + b], skip[base[s] + b] = s, t, before
            before += sizes[t]
    return base, owner, target, skip


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        data = memoryview(self.map).cast("i")
        self.root, states, cells, words, ids = data[:5]
        at, parts = 5, []
        for n in (states, states, cells, cells, cells, words + 1, ids):
            parts.append(data[at : at + n])
            at += n
        self.base, self.ends, self.owner, self.target, self.skip, self.first, self.ids = parts

    def get(self, word: bytes) -> list[int] | None:
        state, number = self.root, 0
        base, owner, target, skip = self.base, self.owner, self.target, self.skip
        for byte in word:
            at = base[state] + byte
            if owner[at] != state:
                return None
            state, number = target[at], number + skip[at]
        return self.ids[self.first[number] : self.first[number + 1]].tolist() if self.ends[state] else None


class _Encoder(dict):
    """chunk -> (ids as text, tokens as text)."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None):
        super().__init__()
        self.bpe, self.lexicon = bpe, lexicon

    def __missing__(self, chunk: str) -> tuple[str, str]:
        words = self.bpe.words(chunk)
        if len(words) == 1:
            ids = self.lexicon.get(words[0].encode("utf-8", "surrogatepass")) if self.lexicon else None
            if ids is None:
                ids = self.bpe.merge(words[0])
            found = self.bpe.spell(ids)
        else:
            both = [self[w] for w in words]
            found = (" ".join([f[0] for f in both]), " ".join([f[1] for f in both]))
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found

    def text(self, text: str) -> tuple[int, str, str]:
        found = []
        for special, chunks in self.bpe.parts(text):
            if special:
                found.append((str(self.bpe.specials[chunks[0]]), chunks[0]))
            else:
                found += map(self.__getitem__, chunks)
        if not found:
            return 0, "", ""
        ids, tokens = zip(*found)
        ids = " ".join(ids)
        return ids.count(" ") + 1, ids, " ".join(tokens)


@contextlib.contextmanager
def _uncollected():
    """Nothing within makes reference cycles, and millions of small objects slow the collector."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@functools.lru_cache(maxsize=2)
def _rules(path: str) -> WordBpe:
    """Kept by a Python worker from task to task."""
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str, name: str) -> _Encoder:
    """Kept by a Python worker from task to task."""
    return _Encoder(_rules(path), Lexicon(SparkFiles.get(name)))


def default_path() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def word_counts(df: DataFrame, text_col: str, path: str) -> DataFrame:
    """Rows (word, n) over all texts; counts are combined in each task before the shuffle."""

    def run(batches):
        bpe, counts = _rules(path), Counter()
        with _uncollected():
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    for special, chunks in bpe.parts(text or ""):
                        if not special:
                            counts.update(chunks)
                    if len(counts) > REMEMBERED:
                        yield _rows(bpe, counts)
                        counts = Counter()
            yield _rows(bpe, counts)

    def _rows(bpe, counts):
        kept: dict[str, int] = defaultdict(int)
        for chunk, n in counts.items():
            for w in bpe.words(chunk):
                kept[w] += n
        for w in [w for w in kept if len(w) > LONGEST]:
            del kept[w]
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, text_col: str, path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the `size` most frequent words, ship the file to the executors, return its name."""
    counts = cut(word_counts(df, text_col, path).where("n > 1"), "words")
    # the count that the last word of the lexicon has, to a sixteenth of a power of two, from a few hundred sums
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).count().orderBy(F.desc("step")).collect()
    seen, least = 0, 0
    for step, n in steps:
        seen, least = seen + n, step
        if seen >= size:
            break
    top = counts.where(F.col("n") >= math.floor(2 ** (least / 16))).orderBy(F.desc("n"), "word").limit(size).collect()  # at most `size` rows
    bpe = WordBpe(path)
    path = scratch_path(df.sparkSession, "lexicon") + ".bin"
    write_bytes(df.sparkSession, path, compile_lexicon({r[0]: bpe.merge(r[0]) for r in top}))
    df.sparkSession.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Rows (id, n_tokens, ids, decoded), one for each row: ids in decimal, joined by one space.

    Defined cases: null and empty texts, and texts of white space only, have no tokens
    and decode to the empty text; a null id stays null; repeated rows are each encoded;
    the strings of special tokens in a text are those tokens; texts and unbroken words of
    any length are encoded whole, in n log n steps; an empty table gives no rows; further
    columns are not read.
    """
    path = path or default_path()
    name = build_lexicon(df, text_col, path, lexicon_words)

    def run(batches):
        encoder = _encoder(path, name)
        with _uncollected():
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    batch = whole.slice(lo, 500)
                    rows = [encoder.text(t or "") for t in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), *[pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string()))]],
                        ["id", "n_tokens", "ids", "decoded"],
                    )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, n_tokens long, ids string, decoded string")

