"""English prose in source files, and what its distributions say about how demanding it is.

Lines are found, words split and statistics taken over whole batches: array operations on the words of all texts, no loop over words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Three words in a row, which a line of prose has; the same in both engines of regular expressions.
_RUN = "[a-z][,;:]? [a-z]+(?:-[a-z]+)*[,;:]? [a-z]"
_RUNS = re.compile(_RUN)
_HEAD = re.compile(r"(?:(?://[/!]?|#+!?|--+|/\*+!?|\*+/?|\"\"\"|'''|<!--|<p>|;+|%+|>+|[-+*]|\d+[.)])[ \t]*)?")
_TAILS = ("*/", "-->", "</p>", '"""', "'''")
_CALL = re.compile(r"\w\(|[{;]$|^(?:static|const|public|import|return|for|if|while|with|assert|let|var|def|func|fn) ")
_QUOTED = re.compile(r"(?:\\n)?[\"'`]\s*[+\\,;)]*$")
_CODE = {ord(c): None for c in "[]{}()=<>_|&^$@\\/+*\"`#0123456789"}
_WORD = re.compile(r"(?<!\w)[A-Z]?[a-z]+(?:[-'][a-z]+)*(?!\w)")
_TOKEN = re.compile(r"(?<!\w)[A-Z]?[a-z]+(?:[-'][a-z]+)*(?!\w)|[.!?]+(?=\s|$)|[,;:(]")
_VOWELS = re.compile(r"[aeiouy]+")
#: Words a worker remembers before it starts afresh; this bounds memory and changes no result.
REMEMBERED = 300_000


def _code(s: str) -> int:
    return len(s) - len(s.translate(_CODE))


def _body(line: str) -> str | None:
    """What a line says without its comment marks and quotes, if it is running prose."""
    body = line.strip()
    body = body[_HEAD.match(body).end() :]
    for t in _TAILS:
        if body.endswith(t):
            body = body[: -len(t)].rstrip()
            break
    quote = max(body.rfind('"', 0, 60), body.rfind("'", 0, 60))
    if quote > 0 and _RUNS.search(body[quote:]) and not _RUNS.search(body[:quote]):
        body = body[quote + 1 :]
    body = _QUOTED.sub("", body).strip("\"'` ")
    if _code(body) > 0.08 * len(body) + 1 or (_code(line) > 1 and _CALL.search(body)):
        return None
    return body


def _after(line: str) -> str:
    """What the line after a line of prose adds: the last words of a paragraph, or its end."""
    found = _WORD.findall(line)
    return line.strip(" \t/*#-;") if found and len(found) <= 3 and not _code(line) else "."


def proses(texts: pa.Array) -> list[str]:
    """Of each text the lines of running prose, without comment marks; blocks of them end with a full stop. Null texts have none."""
    lines = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    flat, upto = lines.flatten(), lines.offsets.to_numpy().astype(np.int64)
    upto = upto - upto[0]
    at = np.flatnonzero(pc.match_substring_regex(flat, _RUN).to_numpy(zero_copy_only=False))
    out: list[list[str]] = [[] for _ in range(len(texts))]
    if not len(at):
        return [""] * len(texts)
    text = np.searchsorted(upto, at, "right") - 1
    follows = at + 1 < upto[text + 1]
    own = flat.take(pa.array(at)).to_pylist()
    next_ = flat.take(pa.array(np.where(follows, at + 1, at))).to_pylist()
    hits = at.tolist()
    last = -1
    for i, (n, t, line) in enumerate(zip(hits, text.tolist(), own, strict=True)):
        body = _body(line)
        if body is None:
            if last == n - 1 and n > upto[t]:
                out[t].append(_after(line))
            continue
        out[t].append(body)
        last = n
        if follows[i] and not (i + 1 < len(hits) and hits[i + 1] == n + 1):
            out[t].append(_after(next_[i]))
    return [" ".join(x) for x in out]


def prose(text: str | None) -> str:
    return proses(pa.array([text], pa.string()))[0]


def distinct_words(text: str) -> list[str]:
    return sorted({w.lower() for w in _WORD.findall(text)})


def ending(word: str) -> str:
    """The last four letters of a word of six or more; empty for others. The grades of endings and beginnings are learned like those of words."""
    return word[-4:] if len(word) >= 6 else ""


def beginning(word: str) -> str:
    return word[:4] if len(word) >= 7 else ""


@dataclass
class Grades:
    """What was learned: words, endings and beginnings with the mean level of the texts that have them, and the commonest words, which count
    as function words."""

    words: dict[str, float] = field(default_factory=dict)
    endings: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    common: frozenset[str] = frozenset()


class Lexicon:
    """Numbers of words, and per number length, syllables, whether it is common, and the grades of word, ending and beginning (NaN: none).

    Numbers up to 4 are marks: the end of a sentence and , ; : (."""

    MARKS = 5

    def __init__(self, grades: Grades):
        self.grades = grades
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {",": 1, ";": 2, ":": 3, "(": 4}
        self.word = [""] * self.MARKS
        self.rows = [(0.0, 0.0, 1.0, np.nan, np.nan, np.nan)] * self.MARKS
        self.table = np.array(self.rows)

    def _add(self, token: str) -> int:
        w = token.lower()
        if not w[0].isalpha():
            n = 0
        elif w != token and w in self.number:
            n = self.number[w]
        else:
            n, g = len(self.rows), self.grades
            self.word.append(w)
            self.rows.append((len(w), len(_VOWELS.findall(w)), w in g.common, g.words.get(w, np.nan), g.endings.get(ending(w), np.nan), g.beginnings.get(beginning(w), np.nan)))
            self.number[w] = n
        self.number[token] = n
        return n

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words and marks of all texts, and the text of each."""
        if len(self.rows) > REMEMBERED:
            self.clear()
        get, add, found = self.number.get, self._add, []
        size = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                tokens = _TOKEN.findall(t)
                size[i] = len(tokens)
                found += [n if (n := get(x)) is not None else add(x) for x in tokens]
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows)
        return np.array(found, np.int64), np.repeat(np.arange(len(texts)), size)


def _each(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """v / n, 0 where n is 0."""
    return v / np.maximum(n, 1)


def _spread(v: np.ndarray, of: np.ndarray, k: int, points: tuple[float, ...]) -> list[np.ndarray]:
    """Per text mean, standard deviation and the values at these fractions of its sorted values; 0 where it has none."""
    n = np.bincount(of, minlength=k)
    mean = _each(np.bincount(of, v, k), n)
    sd = np.sqrt(np.maximum(_each(np.bincount(of, v * v, k), n) - mean * mean, 0.0))
    s = np.append(v[np.lexsort((v, of))], 0.0)
    first = np.cumsum(n) - n
    at = [np.where(n > 0, first + (p * (n - 1) + 0.5).astype(np.int64), len(v)) for p in points]
    return [mean, sd, *(s[i] for i in at)]


def _beyond(v: np.ndarray, of: np.ndarray, k: int, limits: tuple[float, ...]) -> list[np.ndarray]:
    """Per text the shares of its values above each limit."""
    n = np.bincount(of, minlength=k)
    return [_each(np.bincount(of[v > t], minlength=k), n) for t in limits]


def distributions(tokens: np.ndarray, of: np.ndarray, k: int, table: np.ndarray, n_prose: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, syntax and cohesion of k prose texts, one row each, and the words of their sentences with the text of each. n_prose, n_chars: characters
    of the prose and of the whole file. Sentences are those of two words or more."""
    breaks = tokens == 0
    breaks[1:] |= of[1:] != of[:-1]
    sentence = np.cumsum(breaks)
    is_word = tokens >= Lexicon.MARKS
    w, s, d = tokens[is_word], sentence[is_word], of[is_word]
    keep = np.bincount(s)[s] >= 2 if len(s) else np.zeros(0, bool)
    w, s, d = w[keep], s[keep], d[keep]
    start = np.ones(len(s), bool)
    start[1:] = s[1:] != s[:-1]
    s = np.cumsum(start) - 1
    owner = d[start]
    n, m = np.bincount(d, minlength=k), np.bincount(owner, minlength=k)
    content = table[w, 2] == 0
    cw, cs, cd = w[content], s[content], d[content]
    nc = np.bincount(cd, minlength=k)
    size = np.bincount(s, minlength=len(owner)).astype(float)
    width = len(table)
    kinds, times = np.unique(d * width + w, return_counts=True)
    kind_of = kinds // width
    pairs = np.unique(cs * width + cw)
    at = pairs // width
    in_sentence = np.bincount(at, minlength=len(owner) + 1)
    shared = np.bincount(at[np.isin(pairs + width, pairs, assume_unique=True)], minlength=len(owner) + 1)[: max(len(owner) - 1, 0)]
    union = in_sentence[:-2] + in_sentence[1:-1] - shared if len(owner) > 1 else shared
    near = (owner[1:] == owner[:-1]) & (union > 0)
    overlap = _each(np.bincount(owner[:-1][near], _each(shared, union)[near], k), np.bincount(owner[:-1][near], minlength=k))
    out = [np.log1p(n), np.log1p(m), n_prose / np.maximum(n_chars, 1)]
    out += _spread(table[cw, 0], cd, k, (0.25, 0.5, 0.75, 0.9)) + _beyond(table[cw, 0], cd, k, (6, 8, 10, 12, 14))
    out += _spread(table[cw, 1], cd, k, (0.5, 0.75, 0.9)) + _beyond(table[cw, 1], cd, k, (2, 3, 4, 5))
    out += _spread(size, owner, k, (0.1, 0.5, 0.9)) + [_each(np.bincount(of[tokens == i], minlength=k), m) for i in range(1, Lexicon.MARKS)]
    out += [_each(n - nc, n), _each(np.bincount(kind_of, minlength=k), n), _each(np.bincount(kind_of[times == 1], minlength=k), n)]
    out += [overlap, _each(np.bincount(np.unique(cd * width + cw) // width, minlength=k), nc)]
    rows = np.stack(out, 1)
    rows[n == 0] = 0.0
    return rows, w, d


def vocabulary(words: np.ndarray, of: np.ndarray, k: int, table: np.ndarray) -> np.ndarray:
    """How the grades of the words of k texts, of their endings and of their beginnings are distributed, one row each."""
    common = table[words, 2] > 0
    out = []
    for column, which, points, limits in (
        (3, ~common, (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95), (1.5, 2.5, 3.0, 3.5, 4.0, 4.5)),
        (3, common, (0.1, 0.25, 0.5, 0.75, 0.9), (2.0, 3.0, 3.5, 4.0)),
        (4, ~common, (0.1, 0.5, 0.9), (3.0, 4.0)),
        (5, ~common, (0.1, 0.5, 0.9), (3.0, 4.0)),
    ):
        g, d = table[words[which], column], of[which]
        has = ~np.isnan(g)
        out += _spread(g[has], d[has], k, points) + _beyond(g[has], d[has], k, limits)
        out.append(_each(np.bincount(d[~has], minlength=k), np.bincount(d, minlength=k)))
    return np.stack(out, 1)


N_DISTRIBUTIONS = 3 + 6 + 5 + 5 + 4 + 5 + 4 + 3 + 2
N_FEATURES = N_DISTRIBUTIONS + (9 + 6 + 1) + (7 + 4 + 1) + 2 * (5 + 2 + 1)


def features(found: list[str], n_chars: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of features per prose text."""
    k = len(found)
    tokens, of = lexicon.tokens(found)
    rows, w, d = distributions(tokens, of, k, lexicon.table, np.array([len(x) for x in found]), n_chars)
    return np.concatenate([rows, vocabulary(w, d, k, lexicon.table)], 1)
