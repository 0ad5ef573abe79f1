"""Personal data in whole texts: fixed patterns, and a linear-chain CRF over word shapes that adds to them.

The patterns are found around their rare characters only, on bytes. The CRF reads
every unit; it is trained from a small labelled table by gradient ascent. A unit is
what stands between blanks, cut again where the kind of writing changes (``units``),
so glued text hides nothing. A bound on what tags can gain over ``O`` shows where the
best path has to be ``O``; Viterbi decodes the runs of units between, each whole and
many at once, so the tags are those of whole texts.
Where each span of the labelled table holds a mark (a digit, ``@``, ``+`` or a
bracket), a span without one has no form that was taught, and is none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm import words as W

KINDS = ["email", "ip", "card", "phone"]
#: Digits of a number that is a unit of its own where it is glued to other text.
LONG_NUMBER = 7


def _bytes(*parts: str) -> np.ndarray:
    kind = np.zeros(256, bool)
    kind[list("".join(parts).encode())] = True
    return kind


_DIGIT = _bytes("0123456789")
_LETTER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARK = _DIGIT | _bytes("@+()[]")
_NUMBER = _DIGIT | _bytes("+()./-")
_JOINS_WIDE = _DIGIT | _LETTER | _bytes("+()[]@")
#: First bytes of characters from U+3000 on: scripts that are written without blanks.
_WIDE = 0xE3
_IN_EMAIL = _DIGIT | _LETTER | _bytes("._%+-@")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")


def _run(kind: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of ``kind`` bytes around the places ``at``, each once."""
    breaks = np.flatnonzero(~kind[doc])
    nth = np.unique(np.searchsorted(breaks, at))
    breaks = np.concatenate([[-1], breaks, [len(doc)]])
    return [(int(breaks[n]) + 1, int(breaks[n + 1])) for n in nth]


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(doc: np.ndarray) -> list[tuple[int, int]]:
    found = []
    for low, high in _run(_IN_EMAIL, doc, np.flatnonzero(doc == 64)):
        run = doc[low:high].tobytes()
        begin, at = 0, run.find(b"@")
        while at >= 0:
            match = _DOMAIN.match(run, at + 1) if at > begin else None
            if match:
                found.append((low + begin, low + match.end()))
            # the next local part starts behind this match, or else behind the at-sign
            begin = match.end() if match else at + 1
            at = run.find(b"@", at + 1)
    return found


def ips(doc: np.ndarray) -> list[tuple[int, int]]:
    found = []
    for m in _DOTTED.finditer(doc.tobytes()):
        parts = m.group().split(b".")
        place = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            stop = place + sum(map(len, four)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                found.append((place, stop))
            place = stop + 1
    return found


def cards(doc: np.ndarray) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(doc.tobytes()):
        digits = m.group().translate(None, b" -")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(doc: np.ndarray) -> list[tuple[int, int]]:
    text = doc.tobytes()
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(m.group().translate(None, b"+ ().-")) <= 15]


def base_spans(doc: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by bytes of all fixed patterns, leftmost and non-overlapping per kind."""
    digits = int(_DIGIT[doc].sum())
    found = [(a, 0, z) for a, z in emails(doc)] if (doc == 64).any() else []
    if digits >= 4:
        found += [(a, 1, z) for a, z in ips(doc)]
    if digits >= 14:
        found += [(a, 2, z) for a, z in cards(doc)]
    if digits >= 10 and (doc == 43).any():
        found += [(a, 3, z) for a, z in phones(doc)]
    return sorted(found)


# --- the CRF ---------------------------------------------------------------

TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_BUCKETS = 4096
_RUNS = re.compile(r"(.)\1+")


#: Longer shapes are not kept; with their number this bounds the bytes that are.
_KEPT_SHAPE = 64


def _features(word: str) -> tuple[int, ...]:
    """Hashed features of one unit, all of it: its shape, the shape without runs, its ends and its count of digits."""
    return _kept_features(word) if len(word) <= _KEPT_SHAPE else _shape_features(word)


@lru_cache(maxsize=50_000)
def _kept_features(word: str) -> tuple[int, ...]:
    return _shape_features(word)


def _shape_features(word: str) -> tuple[int, ...]:
    shape = "".join("d" if c.isascii() and c.isdigit() else "x" if c.isalpha() or not c.isascii() else c for c in word)
    digits = sum(c == "d" for c in shape)
    names = (
        f"s{shape}",
        f"c{_RUNS.sub(lambda m: m[1], shape)}",
        f"d{min(digits, 20)}",
        f"a{word[0] if not word[0].isalnum() else shape[0]}",
        f"z{word[-1] if not word[-1].isalnum() else shape[-1]}",
        f"@{'@' in word}.{'.' in word[1:-1]}",
        f"p{min(len(word), 24)}{digits == len(word)}",
    )
    return tuple(int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest()) % _BUCKETS for n in names)


WIDTH = 7
#: Features that a word has in common with the words next to it.
NEAR = 3
#: Units whose scores are held at a time.
CHUNK = 1 << 16
#: Sequences that are decoded together, and steps of all of them whose scores are held at a time.
TOGETHER, CELLS = 2048, 1 << 14


def sequence_features(words: list[str]) -> np.ndarray:
    """Features of each word, then those of the words before and after it in tables of their own."""
    own = np.array([_features(w) for w in words])
    none = np.full((1, WIDTH), -1)
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    return np.hstack(
        [own, np.where(before < 0, 3 * _BUCKETS, before + _BUCKETS)[:, :NEAR], np.where(after < 0, 3 * _BUCKETS, after + 2 * _BUCKETS)[:, :NEAR]]
    )


def labelled_table(seed: int = 7, rows: int = 400) -> list[tuple[list[str], list[str]]]:
    """Words and tags of short invented lines, made by rule from a seed."""
    rng = np.random.default_rng(seed)

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def letters(low: int = 2, high: int = 9) -> str:
        return "".join(rng.choice(list("aeinorstlhd"), rng.integers(low, high)))

    def email() -> list[str]:
        name, host = letters(), letters()
        return [
            [f"{name}.{digits(2)}@{host}.com"],
            [f"{name}@{host}.{letters(2, 4)}.org"],
            [name, "(at)", f"{host}.com"],
            [f"{name}_{digits(1)}", "[at]", f"{host}.net"],
            [f"{name}@{host}"],
        ][rng.integers(5)]

    def ip() -> list[str]:
        return [".".join(str(rng.integers(1, 256)) for _ in range(4))]

    def card() -> list[str]:
        form = rng.integers(3)
        four = [digits(4) for _ in range(4)]
        return four if form == 0 else ["-".join(four)] if form == 1 else ["".join(four)]

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return [
            ["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{digits(2)}", a, b, c],
            [f"{a}.{b}.{c}"], [f"+1-{a}-{b}-{c}"],
        ][rng.integers(6)]

    def other() -> list[str]:
        return [
            [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"], [digits(int(rng.integers(1, 6)))], [f"{digits(1)}.{digits(1)}."],
            [f"v{digits(1)}.{digits(1)}.{digits(2)}"], [f"{digits(2)}:{digits(2)}"], [f"${digits(3)}.{digits(2)}"],
            [f"{digits(3)}%"], ["".join(rng.choice(list("0123456789abcdef"), 32))], [f"{letters()}{digits(3)}"],
            [f"key={digits(12)}{letters()}"], [f"{digits(1)},{digits(3)},{digits(3)}"], [f"#{digits(4)}"],
            [f"http://{letters()}.com/{digits(3)}?page={digits(1)}"], [f"@{letters()}"], [digits(8)],
        ][rng.integers(15)]

    table = []
    for _ in range(rows):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(rng.integers(1, 4)):
            for _ in range(rng.integers(0, 4)):
                words.append(letters(1, 12) + ("," if rng.random() < 0.1 else ""))
                tags.append("O")
            kind = rng.choice([*KINDS, "", "", ""])
            made = {"email": email, "ip": ip, "card": card, "phone": phone, "": other}[kind]()
            if kind and rng.random() < 0.2:
                made[-1] += rng.choice([".", ",", ")"])
            words += made
            tags += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(made))]
        table.append((words, tags))
    return table


class Crf:
    """Weights of word features by tag and of neighbouring tags."""

    def __init__(self) -> None:
        self.emit = np.zeros((3 * _BUCKETS + 1, len(TAGS)))
        self.step = np.zeros((len(TAGS), len(TAGS)))
        for k in range(len(KINDS)):  # an inside tag follows its own kind only
            inside = 2 + 2 * k
            self.step[[t for t in range(len(TAGS)) if t not in (inside - 1, inside)], inside] = -30

    def fit(self, table: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
        """Maximise the conditional likelihood by Adam over all sequences at once."""
        table = [(w, t) for w, t in table if w]
        if not table:
            return self
        n, t = len(table), max(len(w) for w, _ in table)
        x = np.full((n, t, WIDTH + 6), 3 * _BUCKETS)
        y, mask = np.zeros((n, t), int), np.zeros((n, t))
        for i, (words, tags) in enumerate(table):
            x[i, : len(words)] = sequence_features(words)
            y[i, : len(words)] = [TAGS.index(g) for g in tags]
            mask[i, : len(words)] = 1
        k, frozen = len(TAGS), self.step < -20
        rows = np.arange(n)
        true_emit = np.eye(k)[y] * mask[..., None]
        true_step = np.zeros((k, k))
        np.add.at(true_step, (y[:, :-1][mask[:, 1:] > 0], y[:, 1:][mask[:, 1:] > 0]), 1)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.emit, self.step)]

        def total(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        for turn in range(1, steps + 1):
            score = self.emit[x].sum(axis=2)
            ahead, back = np.zeros((n, t, k)), np.zeros((n, t, k))
            ahead[:, 0] = score[:, 0]
            for s in range(1, t):
                new = total(ahead[:, s - 1, :, None] + self.step, 1) + score[:, s]
                ahead[:, s] = np.where(mask[:, s, None] > 0, new, ahead[:, s - 1])
            for s in range(t - 2, -1, -1):
                new = total(self.step + (score[:, s + 1] + back[:, s + 1])[:, None, :], 2)
                back[:, s] = np.where(mask[:, s + 1, None] > 0, new, 0)
            whole = total(ahead[:, -1], 1)
            node = np.exp(ahead + back - whole[:, None, None]) * mask[..., None]
            pair = np.zeros((k, k))
            for s in range(1, t):
                p = np.exp(
                    ahead[:, s - 1, :, None] + self.step + (score[:, s] + back[:, s])[:, None, :] - whole[:, None, None]
                )
                pair += (p * mask[rows, s][:, None, None]).sum(axis=0)
            grad_emit = np.zeros_like(self.emit)
            np.add.at(grad_emit, x.reshape(-1), np.repeat((true_emit - node).reshape(-1, k), WIDTH + 6, axis=0))
            grads = [grad_emit / n - ridge * self.emit, np.where(frozen, 0, (true_step - pair) / n - ridge * self.step)]
            for w, g, (m, v) in zip((self.emit, self.step), grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        return self

    def gains(self, words: W.Words) -> np.ndarray:
        """For each word of a block, what its best tag scores more than ``O``; mostly negative."""
        words = plain_shapes(words)
        hashes, total = words.hashes()[0], len(words.starts)
        first = np.zeros(total + 1, bool)
        first[words.bounds] = True
        none = NEAR * self.emit[3 * _BUCKETS]
        gain = np.empty(total)
        for low in range(0, total, CHUNK):
            high = min(low + CHUNK, total)
            a, z = max(low - 1, 0), min(high + 1, total)
            _, at, which = np.unique(hashes[a:z], return_index=True, return_inverse=True)
            x = np.array([_features(w) for w in word_texts(words, a + at)]).reshape(-1, WIDTH)
            own = self.emit[x].sum(axis=1)
            before, after = (self.emit[x[:, :NEAR] + k * _BUCKETS].sum(axis=1) for k in (1, 2))
            near = np.pad(which, 1)
            score = own[which[low - a : high - a]]
            score += np.where(first[low:high, None], none, before[near[low - a : high - a]])
            score += np.where(first[low + 1 : high + 1, None], none, after[near[low - a + 2 : high - a + 2]])
            gain[low:high] = score[:, 1:].max(axis=1) - score[:, 0]
        return gain

    def runs(self, gain: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words of one text outside which every best path has the tag ``O``.

        Tags other than ``O`` on words i..j change the score of a path by at most the
        gains of these words and the best steps into, within and out of the tags. A
        word that is in no i..j for which this is positive has the tag ``O``.
        """
        if not len(gain):
            return []
        step = self.step - self.step[0, 0]
        within, ends = step[1:, 1:].max(), max(step[0, 1:].max(), 0) + max(step[1:, 0].max(), 0)
        total = np.concatenate([[0], np.cumsum(gain + within)])
        most = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        some = np.concatenate([[False], most + ends - within > -1e-6, [False]])
        edges = np.flatnonzero(some[1:] != some[:-1])
        return [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2])]

    def decode(
        self, sequences: list[np.ndarray | Run], held: list[tuple[bool, bool]] | None = None, cells: int = CELLS
    ) -> list[np.ndarray]:
        """Best tags of each sequence (rows of features, or a run of units), sequences step by step together.

        ``held`` says whether the first and the last unit of a sequence have to be
        ``O``. A sequence is decoded whole, whatever its length: scores are held for
        about ``cells`` steps at a time, back pointers for all.
        """
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        out: list[np.ndarray] = [np.empty(0, int)] * len(sequences)
        low, k = 0, len(TAGS)
        while low < len(order) and (t := len(sequences[order[low]])):
            part = order[low : low + min(TOGETHER, max(1, cells // t))]
            low += len(part)
            n, lengths = len(part), np.array([len(sequences[i]) for i in part])
            origin = np.zeros((t, n, k), np.int8)
            for begin in range(0, t, max(1, cells // n)):
                end = min(t, begin + max(1, cells // n))
                score = np.zeros((n, end - begin, k))
                for r, i in enumerate(part):
                    stop = min(lengths[r], end)
                    if stop <= begin:
                        break  # sorted by length
                    score[r, : stop - begin] = self.emit[sequences[i][begin:stop]].sum(axis=1)
                    for word, fixed in zip((0, lengths[r] - 1), held[i] if held else ()):
                        if fixed and begin <= word < stop:
                            score[r, word - begin, 1:] -= 1e6
                if not begin:
                    best = score[:, 0].copy()
                for s in range(max(begin, 1), end):
                    live = int(np.searchsorted(-lengths, -s, "left"))  # sorted by length: the first ones go on
                    reach = best[:live, :, None] + self.step
                    origin[s, :live] = reach.argmax(axis=1)
                    best[:live] = reach.max(axis=1) + score[:live, s - begin]
            tag = best.argmax(axis=1)
            path = np.zeros((t, n), np.int8)
            for s in range(t - 1, -1, -1):
                live = lengths > s
                path[s, live] = tag[live]
                tag = np.where(live, origin[s, np.arange(n), tag], tag)
            for r, i in enumerate(part):
                out[i] = path[: lengths[r], r].astype(int)
        return out


class Run:
    """Units ``first`` to ``stop`` of a block as a sequence whose features are made when they are asked for."""

    def __init__(self, shapes: W.Words, first: int, stop: int) -> None:
        self.shapes, self.first, self.stop = shapes, first, stop

    def __len__(self) -> int:
        return self.stop - self.first

    def __getitem__(self, part: slice) -> np.ndarray:
        low, high = self.first + part.start, min(self.first + part.stop, self.stop)
        a, z = max(low - 1, self.first), min(high + 1, self.stop)
        return sequence_features(word_texts(self.shapes, np.arange(a, z)))[low - a : high - a]


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Each code point, or ``0`` for the ASCII digits and ``x`` for other digits and all letters."""
    code = np.arange(0x110000, dtype=np.uint32)
    code[[c for c in range(0x110000) if chr(c).isalnum()]] = ord("x")
    code[ord("0") : ord("9") + 1] = ord("0")
    return code


def plain_shapes(words: W.Words) -> W.Words:
    """The words in code points, with what their features cannot tell apart made equal: few distinct ones."""
    if words.data.dtype != np.uint8:
        return words
    try:
        codes = np.frombuffer(words.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return words
    lead = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    return W.Words(_plain()[codes], lead[words.offsets], lead[words.starts], lead[words.ends], words.bounds)


def word_texts(words: W.Words, at: np.ndarray) -> list[str]:
    coding = "utf-8" if words.data.dtype == np.uint8 else "utf-32-le"
    return [words.data[a:z].tobytes().decode(coding, "replace") for a, z in zip(words.starts[at], words.ends[at])]


def spans_hold_marks(table: list[tuple[list[str], list[str]]]) -> bool:
    """Whether each span of a labelled table has a word with a mark."""
    for words, tags in table:
        marked = True
        for word, tag in zip([*words, ""], [*tags, "O"]):
            if tag[0] != "I":
                if not marked:
                    return False
                marked = tag == "O"
            marked = marked or any(_MARK[c] for c in word.encode())
    return True


def units(words: W.Words) -> W.Words:
    """Words cut where the kind of writing changes.

    That is between a script without blanks and letters, digits or marks beside it;
    and at the ends of a number that is glued to other text, if it has
    ``LONG_NUMBER`` digits or begins with a plus sign or a bracket. Words with an
    at-sign keep their numbers, and plain digits stay with the ASCII letters next to
    them, as in keys and checksums.
    """
    data = words.data
    if not len(words.starts):
        return words
    cuts = []
    inside = np.zeros(len(data) + 1, bool)  # whether a place is between two bytes of one word
    breaks = np.zeros(len(data) + 2, np.int64)
    np.add.at(breaks, words.starts + 1, 1)
    np.add.at(breaks, words.ends, -1)
    inside[:] = np.cumsum(breaks)[: len(data) + 1] > 0
    if (data >= _WIDE).any():
        lead = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
        wide = data[lead] >= _WIDE
        joins = np.where(wide[1:], _JOINS_WIDE[data[:-1]], _JOINS_WIDE[data[1:]])
        cuts.append(np.flatnonzero((wide[1:] != wide[:-1]) & joins & inside[1:-1]) + 1)
    number = np.concatenate([[False], _NUMBER[data], [False]])
    begin = np.flatnonzero(number[1:-1] & ~(number[:-2] & inside[:-1]))
    end = np.flatnonzero(number[1:-1] & ~(number[2:] & inside[1:])) + 1
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    at = np.searchsorted(words.starts, begin, "right") - 1
    known = at >= 0
    begin, end, at = begin[known], end[known], at[known]
    first, last = words.starts[at], words.ends[at]
    glued = ((begin > first) | (end < last)) & (digits[end] - digits[begin] >= 3)
    for a, z, low, high in zip(begin[glued], end[glued], first[glued], last[glued]):
        word, run = data[low:high].tobytes(), data[a:z].tobytes()
        a, z = a + len(run) - len(run.lstrip(b"./-)")), z - (len(run) - len(run.rstrip(b"./-+(")))
        if b"@" in word or a >= z or (digits[z] - digits[a] < LONG_NUMBER and data[a] not in b"+("):
            continue
        if digits[z] - digits[a] == z - a and any(chr(c).isalnum() and c < 128 for c in data[[max(a - 1, low), min(z, high - 1)]][[a > low, z < high]]):
            continue
        for cut, rest in ((a, word[: a - low]), (z, word[z - low :])):
            if any(c >= 128 or chr(c).isalnum() for c in rest):
                cuts.append(np.array([cut]))
    cuts = np.unique(np.concatenate(cuts)) if cuts else np.empty(0, np.int64)
    cuts = cuts[inside[cuts]]
    starts, ends = np.union1d(words.starts, cuts), np.union1d(words.ends, cuts)
    return W.Words(data, words.offsets, starts, ends, np.searchsorted(starts, words.offsets))


def split_units(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    return units(W.split(data, offsets, W.NON_SPACE))


def table_of_units(table: list[tuple[list[str], list[str]]]) -> list[tuple[list[str], list[str]]]:
    """A labelled table with its words cut into units as texts are."""
    out = []
    for words, tags in table:
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        whole = W.split(data, np.array([0, len(data)]), W.NON_SPACE)
        if len(whole.starts) != len(words):
            raise ValueError("words of a labelled table are not empty and hold no blanks")
        cut = units(whole)
        of = np.searchsorted(whole.starts, cut.starts, "right") - 1
        new = np.isin(cut.starts, whole.starts)
        text = [data[a:z].tobytes().decode() for a, z in zip(cut.starts, cut.ends)]
        out.append((text, [tags[i] if n or tags[i] == "O" else f"I{tags[i][1:]}" for i, n in zip(of, new)]))
    return out


def windows(runs: list[tuple[int, int]], words: int) -> list[tuple[int, int, tuple[bool, bool]]]:
    """``runs`` with the units next to them, which are ``O``; last, which ends are such units."""
    return [(max(a - 1, 0), min(z + 1, words), (a > 0, z < words)) for a, z in runs]


def _find(model: Crf, text: str, marked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in W.text_blocks(batch.column(text)):
                n = stop - first
                words = split_units(data, offsets)
                shapes = plain_shapes(words)
                marks = np.concatenate([[0], np.cumsum(_MARK[data], dtype=np.int64)])
                gain = model.gains(shapes)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])  # code points before a byte
                base: list[list[tuple[int, int, int]]] = []
                sequences, places, held = [], [], []
                for d in range(n):
                    low, high = offsets[d], offsets[d + 1]
                    base.append(base_spans(data[low:high]) if marks[high] > marks[low] else [])
                    a, z = words.bounds[d], words.bounds[d + 1]
                    runs = model.runs(gain[a:z])
                    if marked:
                        runs = [(b, e) for b, e in runs if marks[words.ends[a + e - 1]] > marks[words.starts[a + b]]]
                    for b, e, ends in windows(runs, z - a):
                        sequences.append(Run(shapes, a + b, a + e))
                        places.append((d, a + b))
                        held.append(ends)
                added: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
                for (d, word), tags in zip(places, model.decode(sequences, held)):
                    i = 0
                    while i < len(tags):
                        if tags[i] == 0:
                            i += 1
                            continue
                        kind, j = (tags[i] - 1) // 2, i + 1
                        while j < len(tags) and tags[j] == 2 + 2 * kind:
                            j += 1
                        begin, end = int(words.starts[word + i]), int(words.ends[word + j - 1])
                        i = j
                        if marked and marks[end] == marks[begin]:
                            continue
                        while end > begin + 1 and data[end - 1] in b".,;:!?)%$&#*\"'":
                            end -= 1
                        added[d].append((begin - int(offsets[d]), kind, end - int(offsets[d])))
                rows = []
                for d in range(n):
                    spans = [(a, k, z, True) for a, k, z in base[d]]
                    taken = [(a, z) for a, _, z in base[d]]
                    for a, k, z in added[d]:
                        if all(z <= b or a >= e for b, e in taken):
                            spans.append((a, k, z, False))
                            taken.append((a, z))
                    at = int(offsets[d])
                    start = int(lead[at])
                    rows.append(
                        [
                            {"kind": KINDS[k], "first": int(lead[at + a]) - start, "stop": int(lead[at + z]) - start, "base": b}
                            for a, k, z, b in sorted(spans)
                        ]
                    )
                kept = [c for c in batch.schema.names if c not in (text, "pii")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in kept), pa.array(rows, _SPANS_ARROW)], [*kept, "pii"]
                )

    return run


_SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])
)
_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("first", T.LongType()),
            T.StructField("stop", T.LongType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)


def find_pii(
    docs: DataFrame, text: str = "text", labelled: list[tuple[list[str], list[str]]] | None = None
) -> DataFrame:
    """``docs`` without its text, with ``pii``: an array of ``(kind, first, stop, base)`` in code points, by place and kind.

    ``base`` spans match a fixed pattern and always stay; patterns of different
    kinds may overlap. The others are tagged by the CRF, trained on ``labelled`` (a
    few hundred lines of words and tags, ``TAGS``), over all units; they overlap no
    other span, and hold a digit, ``@``, ``+`` or bracket if all labelled ones do.
    A span begins and ends with a unit, so it may be part of a word. Null, empty and
    clean texts have an empty array. Repeated rows are searched
    each. A column named ``pii`` is replaced. Texts are read whole.
    """
    table = labelled if labelled is not None else labelled_table()
    model = Crf().fit(table_of_units(table))
    kept = docs.drop("pii")
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != text), T.StructField("pii", _SPANS)])
    return kept.mapInArrow(_find(model, text, spans_hold_marks(table)), schema)


def span_text(spans: Column) -> Column:
    """``kind:first:stop``, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["stop"].cast("string"))
        ),
        ",",
    )
