"""Character-level hidden Markov model of code and natural languages.

States are code, one per language, and one for letters of scripts that no seed has. A state emits a character given the two before it, from smoothed
trigram counts of seed text; all text is lower-cased, and Latin seeds are counted with and without
diacritics. Leaving a state costs the same everywhere, so a Viterbi step needs one maximum over the states.

``Words`` is the same kind of model with four characters of context and further languages, for decoding sentences word by word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from weftwork.llm.seed_texts import CODE, FURTHER, PROSE

STATES = ("code", *PROSE, "other")
CODE_STATE = 0
OTHER_STATE = len(STATES) - 1
_BITS = 17
_SWITCH = np.float32(9.0)  # nats for a change of state: about the evidence of a word or two


def fold(text: str) -> str:
    """Without diacritics, as some sources write (ae, oe and ue for umlauts are covered by seeds of their own)."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss")


def _umlauts(text: str) -> str:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = text.replace(a, b)
    return text


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of white space counts as blanks, digits as one character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    up = (c >= 65) & (c <= 90)
    c[up] += 32
    high = c >= 0xC0
    if high.any():
        low = "".join(x if len(y := x.lower()) != 1 else y for x in c[high].tobytes().decode("utf-32-le", "surrogatepass"))
        c[high] = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    c[(c == 9) | (c == 10) | (c == 13)] = 32
    c[(c >= 48) & (c <= 57)] = 48
    return c


def _hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ c.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - _BITS)).astype(np.int64)


def _kind(c: np.ndarray) -> np.ndarray:
    """Scripts, for characters no seed holds: 0 other, 1 Latin letter, 2 Cyrillic, 3 kana, 4 Han, 5 blank, 6 digit, 7 punctuation of code, 8 letters of further scripts."""
    k = np.zeros(len(c), np.int64)
    k[((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c < 0x250))] = 1
    k[(c >= 0x400) & (c < 0x530)] = 2
    k[(c >= 0x3040) & (c < 0x3100) | (c == 0x30FC)] = 3
    k[(c >= 0x4E00) & (c < 0xA000)] = 4
    k[c == 32] = 5
    k[c == 48] = 6
    k[np.isin(c, [ord(x) for x in "{}[]();=<>_/\\|#@$&*+\"^~"])] = 7
    k[(c >= 0x370) & (c < 0x400) | (c >= 0x530) & (c < 0x1400) | (c >= 0xAC00) & (c < 0xD7B0)] = 8
    return k


class Model:
    """Log probabilities of characters by state: log_p[slot of the trigram, state]."""

    def __init__(self) -> None:
        n = len(STATES)
        size = 1 << _BITS
        t3, t2, t1 = (np.zeros((size, n), np.float32) for _ in range(3))
        scripts = np.zeros((9, n))
        for s, name in enumerate(STATES):
            if name == "other":
                scripts[[8, 5, 0], s] = 600, 120, 30
                continue
            texts = [CODE] if name == "code" else [PROSE[name]]
            if name not in ("code", "ru", "ja", "zh", "en"):
                texts.append(fold(PROSE[name]))
            if name == "de":
                texts.append(_umlauts(PROSE[name]))
            for t in texts:
                c = codes(t)
                c = c[~((c == 32) & (np.concatenate([[0], c[:-1]]) == 32))]
                z = np.zeros(2, np.uint32)
                a, b = np.concatenate([z + 32, c])[:-2], np.concatenate([z[:1] + 32, c])[:-1]
                np.add.at(t3, (_hash(a, b, c), s), 1)
                np.add.at(t2, (_hash(np.zeros_like(c), b, c), s), 1)
                np.add.at(t1, (_hash(np.zeros_like(c), np.zeros_like(c), c), s), 1)
                np.add.at(scripts, (_kind(c), s), 1)
        self.counts = t3, t2, t1
        self.total = t1.sum(0)
        self.script = (scripts + 0.02) / (scripts + 0.02).sum(0)
        self._cache: np.ndarray | None = None

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """[len(c), states] log probability of each character given the two before it (interpolated)."""
        if not len(c):
            return np.zeros((0, len(STATES)), np.float32)
        t3, t2, t1 = self.counts
        zero = np.zeros_like(c)
        b = np.concatenate([[np.uint32(32)], c[:-1]])
        a = np.concatenate([[np.uint32(32)], b[:-1]])
        h3, h2, h1 = _hash(a, b, c), _hash(zero, b, c), _hash(zero, zero, c)
        c2, c1 = t2[_hash(zero, a, b)], t1[_hash(zero, zero, b)]
        # a script's share, spread over its characters, stands in for unseen characters
        spread = np.array([60, 60, 40, 80, 2500, 1, 1, 20, 60], np.float32)
        k = _kind(c)
        p0 = (self.script[k] / spread[k][:, None]).astype(np.float32)
        p1 = (t1[h1] + 2.0 * p0) / (self.total + 2.0)
        p2 = (t2[h2] + 3.0 * p1) / (c1 + 3.0)
        p3 = (t3[h3] + 3.0 * p2) / (c2 + 3.0)
        return np.log(p3)


    def table(self) -> np.ndarray:
        """[slots, states] log probabilities of the seeds' trigrams; unseen slots hold a floor. For whole sentences, where one lookup a character is enough."""
        if self._cache is None:
            t3, t2, t1 = self.counts
            out = np.full(t3.shape, np.log(2e-4), np.float32)
            for name in STATES[:-1]:
                for t in ([CODE] if name == "code" else [PROSE[name], fold(PROSE[name])]):
                    c = codes(t)
                    b = np.concatenate([[np.uint32(32)], c[:-1]])
                    a = np.concatenate([[np.uint32(32)], b[:-1]])
                    out[_hash(a, b, c)] = self.emissions(c)
            self._cache = out
        return self._cache

    def sentence_scores(self, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """[sentences, states] summed log probabilities of the sentences that begin at ``starts`` in one array of codes."""
        b = np.concatenate([[np.uint32(32)], c[:-1]])
        a = np.concatenate([[np.uint32(32)], b[:-1]])
        han = _kind(c)
        e = self.table()[_hash(a, b, c)]
        odd = (han >= 2) & (han <= 4) | (han == 8)
        if odd.any():  # other scripts: the script decides
            e[odd] = np.log(self.script[han[odd]]).astype(np.float32)
        return np.add.reduceat(e, starts, axis=0)


@lru_cache(1)
def model() -> Model:
    return Model()


class Words:
    """Log probabilities of characters given the four before them, by language, the further ones included."""

    names = (*PROSE, *FURTHER)
    _bits, _order, _pull = 18, 5, (2.0, 3.0, 3.0, 2.5, 2.0)

    def __init__(self) -> None:
        n = len(self.names)
        self.counts = [np.zeros((1 << self._bits, n), np.float32) for _ in range(self._order)]
        scripts = np.zeros((9, n))
        for s, name in enumerate(self.names):
            seed = PROSE.get(name) or FURTHER[name]
            texts = [seed] if name in ("ru", "uk", "ja", "zh", "en") else [seed, fold(seed), *([_umlauts(seed)] if name == "de" else [])]
            for t in texts:
                c = codes(t)
                c = c[~((c == 32) & (np.concatenate([[0], c[:-1]]) == 32))]
                for table, h in zip(self.counts, self._slots(c), strict=True):
                    np.add.at(table, (h, s), 1)
                np.add.at(scripts, (_kind(c), s), 1)
        self.total = self.counts[0].sum(0)
        self.script = (scripts + 0.02) / (scripts + 0.02).sum(0)

    def _slots(self, c: np.ndarray) -> Iterator[np.ndarray]:
        """For every order the slot of the n-gram that ends at each character."""
        padded = np.concatenate([np.full(self._order, 32, np.uint64), c.astype(np.uint64)])
        x = np.zeros(len(c), np.uint64)
        for k in range(self._order):
            x = x * np.uint64(0x9E3779B97F4A7C15) + padded[self._order - k:len(padded) - k] + np.uint64(k + 1)
            y = x ^ (x >> np.uint64(29))
            y = y * np.uint64(0xBF58476D1CE4E5B9)
            yield (y >> np.uint64(64 - self._bits)).astype(np.int64)

    def scores(self, c: np.ndarray) -> np.ndarray:
        """[len(c), languages]."""
        k = _kind(c)
        spread = np.array([60, 60, 40, 80, 2500, 1, 1, 20, 60], np.float32)
        p = (self.script[k] / spread[k][:, None]).astype(np.float32)
        before = self.total
        for table, h, a in zip(self.counts, self._slots(c), self._pull, strict=True):
            t = table[h]
            p = (t + np.float32(a) * p) / (before + np.float32(a))
            before = np.concatenate([np.zeros_like(t[:1]), t[:-1]])
        return np.log(p)


@lru_cache(1)
def words_model() -> Words:
    return Words()


#: Cells (characters by texts by states) whose emissions are held at once.
_BLOCK_CELLS = 6_000_000


def _decode(c: list[np.ndarray]) -> list[np.ndarray]:
    """Viterbi paths of several texts' codes at once, longest first. Emissions are made block by block, so a long text costs three bytes a character."""
    m, n, states = model(), len(c), len(STATES)
    order = sorted(range(n), key=lambda i: -len(c[i]))
    size = np.array([len(c[i]) for i in order])
    longest = int(size[0]) if n else 0
    v = np.zeros((n, states), np.float32)
    v[:, CODE_STATE] = 3.0
    jump = np.zeros((longest, n), np.int8)  # best state before, if one changes
    stay = np.zeros((longest, n), np.uint16)  # bit per state: it was kept
    bits = (1 << np.arange(states)).astype(np.uint16)
    alive, final, rows = n, np.zeros((n, states), np.float32), np.arange(n)
    step = max(256, _BLOCK_CELLS // max(1, n * states))
    for t0 in range(0, longest, step):
        t1 = min(longest, t0 + step)
        pad = np.zeros((t1 - t0, n, states), np.float32)
        for k, i in enumerate(order):
            if len(c[i]) <= t0:
                break
            back = min(2, t0)
            e = m.emissions(c[i][t0 - back:t1])[back:]
            pad[: len(e), k] = e
        for t in range(t0, t1):
            while alive and size[alive - 1] <= t:
                alive -= 1
                final[alive] = v[alive]
            x = v[:alive]
            best = x.argmax(1)
            top = x[rows[:alive], best][:, None] - _SWITCH
            jump[t, :alive] = best
            stay[t, :alive] = (x >= top) @ bits
            np.maximum(x, top, out=x)
            x += pad[t - t0, :alive]
            x -= x.max(1, keepdims=True)
    final[:alive] = v[:alive]
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * n
    state = np.zeros(n, np.int64)
    path = np.zeros((longest, n), np.int8)
    end = final.argmax(1)
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))  # texts longer than t
        first = size[:live] - 1 == t
        state[:live] = np.where(first, end[:live], state[:live])
        path[t, :live] = state[:live]
        kept = (stay[t, :live].astype(np.int64) >> state[:live]) & 1
        state[:live] = np.where(kept == 1, state[:live], jump[t, :live])
    for k, i in enumerate(order):
        out[i] = path[: size[k], k].copy()
    return out


def viterbi(texts: list[str], cells: int = 1_500_000) -> list[np.ndarray]:
    """The state of every character of every text; texts of like length are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
    group: list[int] = []

    def flush() -> None:
        for i, p in zip(group, _decode([codes(texts[i]) for i in group]), strict=True):
            out[i] = p
        group.clear()

    for i in sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i])):
        if group and (len(group) + 1) * len(texts[i]) * len(STATES) > cells * 4:
            flush()
        group.append(i)
    if group:
        flush()
    return out
