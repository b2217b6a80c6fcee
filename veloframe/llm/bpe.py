"""Byte-pair encoding of whole corpora by speculation and verification.

A word is first cut greedily into the longest tokens. A sequence of tokens is the encoding of its bytes exactly if every adjacent pair of it
is: so pairs are checked, all of a batch at once and each distinct pair once, and only words with a pair that fails are merged exactly.
Splitting texts into words, finding distinct words and putting ids together are array operations on the bytes of a batch."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies by default; the driver reads it and sends it to the executors (1.6 MB).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text that are split at a time.
CHUNK = 1 << 20
#: Distinct words, and pairs of tokens, a worker remembers before it starts afresh; this bounds memory and changes no result.
REMEMBERED = 400_000

LETTER, NUMBER, SPACE = 1, 2, 3
#: Code points that count as white space besides the ASCII ones.
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: Letters and numbers of Unicode 16, by which the public tokenizer libraries split, that version 15 hasn't got.
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _classes() -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    table = np.array([of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[[*range(9, 14), 32, *WIDE_SPACES]] = SPACE
    return table


def _byte_names() -> dict[str, int]:
    """The character by which the vocabulary file writes each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of the public byte-level vocabulary; strings that look like special tokens are ordinary text."""

    def __init__(self, vocabulary: bytes):
        model, names = json.loads(vocabulary)["model"], _byte_names()
        raw = lambda t: bytes(names[c] for c in t)
        self.id = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes = {i: t for t, i in self.id.items()}
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = raw(a), raw(b)
            self.merge[self.id[a] << 32 | self.id[b]] = (rank, self.id[a + b])
        self.longest: dict[bytes, int] = {}
        for t in self.id:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))
        self.classes = _classes()
        self.pairs: dict[int, bool] = {}
        self.known: dict[bytes, tuple[int, ...]] = {}
        rng = np.random.default_rng(7)
        self.byte_hash = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(1 << 61, 1 << 62)) | 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    # words

    def exact(self, word: bytes) -> list[int]:
        """The definition: of all mergeable adjacent pairs the one of least rank, leftmost first, until none is left. n log n."""
        ids = [self.id[word[i : i + 1]] for i in range(len(word))]
        n, merge = len(ids), self.merge
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merge[a << 32 | b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get(ids[i] << 32 | ids[k]):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merge.get(ids[h] << 32 | ids[i])):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, get, longest = [], 0, len(word), self.id.get, self.longest
        while i < n:
            end = min(n, i + longest.get(word[i : i + 2], 1))
            while (t := get(word[i:end])) is None:
                end -= 1
            out.append(t)
            i = end
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Of distinct pairs a << 32 | b, whether the encoding of a's and b's bytes is a, b."""
        if len(self.pairs) + len(pairs) > REMEMBERED:
            self.pairs.clear()
        known, bytes_ = self.pairs, self.bytes
        ok = []
        for p in pairs.tolist():
            if (x := known.get(p)) is None:
                a, b = p >> 32, p & 0xFFFFFFFF
                x = known[p] = self.exact(bytes_[a] + bytes_[b]) == [a, b]
            ok.append(x)
        return np.array(ok, bool)

    def learn(self, words: list[bytes]) -> None:
        """Puts the encodings of new words into ``known``."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        proposed = [self.propose(w) for w in words]
        size = np.array([len(p) for p in proposed])
        ids = np.array([t for p in proposed for t in p], np.int64)
        start = np.cumsum(size) - size
        inner = np.ones(len(ids), bool)
        inner[start + size - 1] = False  # the last token of a word has no partner in it
        at = np.flatnonzero(inner)
        pairs, which = np.unique(ids[at] << 32 | ids[at + 1], return_inverse=True)
        bad = np.zeros(len(words), bool)
        if len(at):
            failed = at[~self.compatible(pairs)[which]]
            bad[np.searchsorted(start, failed, "right") - 1] = True
        for w, p, b in zip(words, proposed, bad.tolist(), strict=True):
            if b or len(p) == 1:  # a single token has no pair that could vouch for it
                p = self.exact(w)
            self.known[w] = tuple(p)

    # texts

    def split(self, buf: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Byte offsets at which the words of the texts begin; ``texts``: offsets at which non-empty texts begin.

        The public pattern: contractions, runs of letters, of numbers or of others, each with a space before it if there is one, and white
        space, of which the last character goes to the run after it if it is a space and else stands alone."""
        first = np.flatnonzero((buf & 0xC0) != 0x80)
        code = buf[first].astype(np.int32)
        if len(first) < len(buf):
            pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
            two, three, four = (code >= 0xC0) & (code < 0xE0), (code >= 0xE0) & (code < 0xF0), code >= 0xF0
            f = first[two]
            code[two] = (code[two] & 0x1F) << 6 | pad[f + 1]
            f = first[three]
            code[three] = (code[three] & 0x0F) << 12 | pad[f + 1] << 6 | pad[f + 2]
            f = first[four]
            code[four] = (code[four] & 0x07) << 18 | pad[f + 1] << 12 | pad[f + 2] << 6 | pad[f + 3]
        n = len(first)
        kind = self.classes[code]
        fresh = np.zeros(n + 1, bool)
        fresh[np.searchsorted(first, texts)] = True
        fresh[n] = True
        new = fresh[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(new)
        end = np.append(run[1:], n)
        space = kind[run] == SPACE
        mark = new
        # the last white space before something goes apart, and a space joins what follows
        inner = space & ~fresh[end]
        mark[end[inner] - 1] = True
        joined = np.zeros(n + 1, bool)
        joined[end[inner & (code[end - 1] == 32)]] = True
        mark &= ~joined[:n]
        # contractions: a lone apostrophe that begins a word, and the letters after it
        quote = (end - run == 1) & (code[run] == 39) & ~joined[run] & ~fresh[end]
        q = np.flatnonzero(quote)
        q = q[kind[run[q] + 1] == LETTER]
        if len(q):
            at = run[q] + 1
            limit = end[q + 1]
            c1 = code[at]
            c2 = np.where(at + 1 < limit, code[np.minimum(at + 1, n - 1)], 0)
            one = np.isin(c1, [ord(c) for c in "stmd"])
            both = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            length = np.where(one, 1, np.where(both, 2, 0))
            hit = length > 0
            mark[at[hit]] = False
            rest = (at + length)[hit]
            mark[rest[rest < limit[hit]]] = True
        return first[mark]

    def _hashes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of all words from one running sum over the batch."""
        n = len(buf)
        if len(self.powers) <= n:
            with np.errstate(over="ignore"):
                back = pow(self.base, -1, 1 << 64)
                self.powers = np.cumprod(np.concatenate([[1], np.full(n, self.base)]).astype(np.uint64))
                self.inverse = np.cumprod(np.concatenate([[1], np.full(n, back)]).astype(np.uint64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte_hash[buf] * self.powers[:n], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        return h ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def distinct(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each distinct one, and which of those every word is. Hashes only propose: the bytes of every word are compared with
        those of the word that stands for it, and words that differ (hashes collide for repetitive words) are told apart by their bytes."""
        _, rep, which = np.unique(self._hashes(buf, start, end), return_index=True, return_inverse=True)
        size = end - start
        other = size[rep][which] != size
        shift = np.where(other, 0, start[rep][which] - start)
        same = buf[np.arange(len(buf)) + np.repeat(shift, size)] == buf
        if other.any() or not same.all():
            other[np.repeat(np.arange(len(start)), size)[~same]] = True
            number: dict[bytes, int] = {}
            more = []
            for w in np.flatnonzero(other).tolist():
                at = number.setdefault(buf[start[w] : end[w]].tobytes(), len(rep) + len(number))
                if at == len(rep) + len(more):
                    more.append(w)
                which[w] = at
            rep = np.concatenate([rep, np.array(more, rep.dtype)])
        return rep, which

    def encode(self, buf: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of non-empty texts, and the number of ids of each text."""
        start = self.split(buf, texts)
        end = np.append(start[1:], len(buf))
        rep, which = self.distinct(buf, start, end)
        raw = buf.tobytes()
        words = [raw[a:b] for a, b in zip(start[rep].tolist(), end[rep].tolist(), strict=True)]
        known = self.known
        if missing := [w for w in words if w not in known]:
            if len(known) + len(missing) > REMEMBERED:
                missing = words
            self.learn(missing)
        tokens = [known[w] for w in words]
        size = np.array([len(t) for t in tokens])
        flat = np.array([i for t in tokens for i in t], np.int32)
        begin = (np.cumsum(size) - size)[which]
        lengths = size[which]
        upto = np.cumsum(lengths)
        ids = flat[np.repeat(begin - (upto - lengths), lengths) + np.arange(upto[-1])]
        word_text = np.searchsorted(texts, start, "right") - 1
        return ids, np.bincount(word_text, weights=lengths, minlength=len(texts)).astype(np.int64)

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, beginnings and row numbers of pieces of texts, about CHUNK bytes at a time. A long text is cut where white space follows
        something else, where a word ends in any case; a text without such a place stays whole."""
        at: list[int] = []
        rows: list[int] = []
        base = None
        for r in np.flatnonzero(np.diff(offsets)).tolist():
            a, z = int(offsets[r]), int(offsets[r + 1])
            while a < z:
                cut = z
                if z - a > CHUNK:
                    part = data[a : min(z, a + CHUNK)]
                    blank = (part == 32) | ((part >= 9) & (part <= 13))
                    places = np.flatnonzero(blank[1:] & ~blank[:-1] & (part[:-1] < 0x80))
                    if not len(places):
                        part = data[a:z]
                        blank = (part == 32) | ((part >= 9) & (part <= 13))
                        places = np.flatnonzero(blank[1:] & ~blank[:-1] & (part[:-1] < 0x80))[:1]
                    cut = a + int(places[-1]) + 1 if len(places) else z
                if base is None:
                    base = a
                at.append(a - base)
                rows.append(r)
                a = cut
                if a - base >= CHUNK:
                    yield data[base:a], np.array(at), np.array(rows)
                    at, rows, base = [], [], None
        if rows:
            yield data[base:a], np.array(at), np.array(rows)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, one after another, and the number of ids of each; null and empty texts have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        counts, ids = np.zeros(len(texts), np.int64), []
        for buf, at, rows in self.chunks(data, offsets):
            found, n = self.encode(buf, at)
            ids.append(found)
            np.add.at(counts, rows, n)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if shared.id not in _ENCODERS:
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """A broadcast vocabulary with a number by which a worker recognises it."""

    def __init__(self, broadcast, id: int):
        self.broadcast, self.id = broadcast, id

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _share(df: DataFrame, vocabulary: str) -> _Shared:
    with open(vocabulary, "rb") as f:
        raw = f.read()
    return _Shared(df.sparkSession.sparkContext.broadcast(raw), hash(raw))


def encode(df: DataFrame, id: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, ids``: the token ids of each row's text, without special tokens.

    Null and empty texts give an empty array; a null id stays; repeated rows give repeated rows; an empty table gives an empty result; other
    columns are dropped. Texts of any length are encoded whole."""
    shared, kind = _share(df, vocabulary), df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b in batches:
            ids, n = encoder.column(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "ids"])

    return df.select(df[id].alias("id"), df[text].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def token_counts(df: DataFrame, columns: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``columns..., n_tokens``; null and empty texts have 0 tokens."""
    shared = _share(df, vocabulary)
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for b in batches:
            n = encoder.column(b.column(len(columns)))[1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    return df.select(*columns, df[text].cast("string").alias("_text")).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n_tokens long")


def decode(df: DataFrame, id: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, bytes``: the bytes that the ids stand for; a null array gives no bytes."""
    shared, kind = _share(df, vocabulary), df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _encoder(shared).bytes
        for b in batches:
            out = [b"".join(of[i] for i in x) if x is not None else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    return df.select(df[id].alias("id"), df[ids].alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id)
