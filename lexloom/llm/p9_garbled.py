"""Problem 9: text that was read in the wrong encoding, by noisy-channel decoding.

A passage is a line, or a sentence of it. The channels are: UTF-8 bytes read in one of READ_AS (once or twice), bytes of one of
LEGACY read as Latin-1 or Windows-1252, and single-byte text read as UTF-8, whose bytes were lost to U+FFFD. A channel is
inverted by writing the passage's bytes again. Bytes that were lost (U+FFFD, a no-break space that became a space) stay open in
the lattice of bytes, and a run of open bytes may hold one or more characters. The likeliest reading is searched by Viterbi. Between sound
separators a path is either one known word, scored by its frequency over all documents, or an unknown word, whose states are
(byte position, last character) and whose transitions are the pairs of letters of all words; separators are sound, so the words' best paths make up the passage's. A place
of which no byte is left, or more than one is lost, is filled by known words only. A passage is garbled if
the decoded reading explains it as a whole: a text that only quotes such characters also holds sound characters beyond
ASCII, which do not decode, or nothing that decodes to words.

Null, empty and plain ASCII texts are sound. All words of all documents are counted, but those that are garbled themselves. The WORDS most frequent ones, of at least LEAST occurrences, are known words; the pairs
of letters, by which all others are read, are counted over all words.
"""

from __future__ import annotations

import codecs
import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, spread

#: Code pages in which UTF-8 is often read, and those that are often read as Latin-1.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "cp1256", "koi8_r", "gb18030")
LEGACY = ("cp1256", "gb18030", "cp1251", "koi8_r", "cp1253", "big5", "shift_jis", "euc_kr")
#: Bounds of what is broadcast: the most frequent words and pairs of letters.
WORDS, PAIRS = 20_000, 200_000
#: Occurrences from which a form counts as a known word, at any size of the table: rarer ones are as often accidents.
LEAST = 3
LOST = "�"
#: Log odds of a place that stays open, of a lost byte that the page can hold, and of each further byte that a lost one stands for; signs beside letters that a lost byte often is of.
OPEN, HELD, FURTHER, SIGNS = -40.0, -2.0, -3.0, "“”‘’–—…«»¿¡\u00a0。，、！？；：（）「」《》،؛؟।"

#: Log odds that a passage is garbled, and of a sign beyond ASCII in a text.
GARBLED, SIGN = -4.6, -7.0

_units = regex.compile(r"[^\r\n]+")
_sentences = regex.compile(r"(?<=[.!?।؟。！？]) +|(?<=[。！？])")
_quoted = regex.compile(r"[\"'“”‘’«»„`][^\x00-\x7f]{1,3}[\"'“”‘’«»„`]")
_scripts = {k: regex.compile(rf"[{v}]") for k, v in {"latin": r"\p{Latin}", "arabic": r"\p{Arabic}", "deva": r"\p{Devanagari}", "han": r"\p{Han}\p{Hiragana}\p{Katakana}", "cyrillic": r"\p{Cyrillic}", "greek": r"\p{Greek}", "hangul": r"\p{Hangul}", "hebrew": r"\p{Hebrew}"}.items()}
_high = re.compile(r"[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{3,}")
_wide = re.compile(r"[^\x00-\x7f]{2,} ?|[^\x00-\x7f] [^\x00-\x7f]?")
_han = re.compile(r"[㐀-鿿\ue000-\uf8ff]")
_word = regex.compile(r"[\p{L}\p{M}�]+")
_letter = regex.compile(r"[\p{L}\p{M}]")
_letters = regex.compile(r"[\p{L}\p{M}]+")
_plausible = regex.compile(r"[\p{Latin}\p{Arabic}\p{Devanagari}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Cyrillic}\p{Greek}\p{Hebrew} -¿×÷‐-›₠-₿™←-⇿∀-⋿─-╿■-➿　-〿＀-￯\U0001f300-\U0001faff।॥،؛؟]")
_odd = regex.compile(r"[\u0080-\u009fƀ-ɏɐ-ʯ￰-￿]")


def _char_of(page: str) -> dict[int, str]:
    """The characters of a single-byte page; bytes that it leaves free are read as Latin-1."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@functools.lru_cache(maxsize=None)
def _table(page: str) -> tuple[dict[str, int], re.Pattern, dict[int, int]]:
    """Byte of each character beyond ASCII, and what a UTF-8 sequence that was read in the page looks like."""
    chars = _char_of(page)
    back = {c: b for b, c in chars.items()}
    if page == "cp1252":  # Latin-1 as well
        back |= {chr(b): b for b in range(128, 160)}
        chars = {b: c + (chr(b) if b < 160 else "") for b, c in chars.items()}
    cls = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi)) + LOST + "]"
    tail = cls(0x80, 0xC0)
    encode = {ord(c): b for c, b in back.items()} | {b: b for b in range(128)}
    return back, re.compile(f"{cls(0xC2, 0xE0)}(?:{tail}| )|{cls(0xE0, 0xF0)}{tail}{tail}|{cls(0xF0, 0xF5)}{tail}{tail}{tail}"), encode


def _written(text: str, page: str) -> bytes | None:
    """The bytes that were read as text in the page, a lost byte left out; None if a character is not of the page."""
    if page == "gb18030":
        try:
            return text.replace(LOST, "").encode("gbk")
        except UnicodeEncodeError:
            try:
                return text.replace(LOST, "").encode("gb18030")
            except UnicodeEncodeError:
                return None
    try:
        return codecs.charmap_encode(text.replace(LOST, ""), "strict", _table(page)[2])[0]
    except UnicodeEncodeError:
        return None


def _bytes(text: str, page: str) -> list[int] | None:
    """The bytes of the text; -1 for a lost one."""
    out: list[int] = []
    for k, part in enumerate(text.split(LOST)):
        raw = _written(part, page)
        if raw is None:
            return None
        if k:
            out.append(-1)
        out += raw
    return out


def _lattice(data: list[int]) -> list[str | tuple[int, ...]] | None:
    """Characters of UTF-8 bytes; a run of open places is the tuple of its bytes, -1 for a lost one. None if they are no UTF-8."""
    out: list = []

    def leave_open(run: list[int]) -> None:
        if out and not isinstance(out[-1], str):
            run = [*out.pop(), *run]
        out.append(tuple(run))

    i, n = 0, len(data)
    while i < n:
        b = data[i]
        if 0 <= b < 0x80:
            j = i
            while j < n and 0 <= data[j] < 0x80:
                j += 1
            out += map(chr, data[i:j])
            i = j
            continue
        if b == -1:
            # a lost byte, perhaps of a sequence whose rest follows
            j = i + 1
            while j < n and (data[j] == -1 or 0x80 <= data[j] < 0xC0):
                j += 1
            leave_open(data[i:j])
            i = j
            continue
        width = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if not width:
            return None
        seq = data[i : i + width]
        if len(seq) == width and all(0x80 <= x < 0xC0 for x in seq[1:]):
            try:
                out.append(bytes(seq).decode())
            except UnicodeDecodeError:
                return None
            i += width
            continue
        # a no-break space that became a space, or lost bytes
        open_ = [k for k in range(1, width) if k < len(seq) and (seq[k] == -1 or seq[k] == 0x20)]
        if len(seq) == width and open_ and all(0x80 <= seq[k] < 0xC0 or k in open_ for k in range(1, width)):
            options = ""
            if len(open_) == 1:
                for x in [0xA0] if seq[open_[0]] == 0x20 else range(0x80, 0xC0):
                    try:
                        options += bytes(x if k in open_ else v for k, v in enumerate(seq)).decode()
                    except UnicodeDecodeError:
                        pass
            if 0x20 in seq and not (options and _plausible.match(options)):
                return None
            leave_open(seq)
            i += width
            continue
        # the sequence broke off where bytes were lost
        k = 1
        while k < len(seq) and 0x80 <= seq[k] < 0xC0:
            k += 1
        if i + k < n and data[i + k] == -1:
            while i + k < n and data[i + k] == -1:
                k += 1
            leave_open(data[i : i + k])
            i += k
            continue
        return None
    return out


@functools.lru_cache(maxsize=None)
def _free(page: str) -> frozenset[int]:
    """Bytes that the page leaves free: those that reading in it loses."""
    out = set()
    for b in range(128, 256):
        try:
            bytes([b]).decode(page)
        except UnicodeDecodeError:
            out.add(b)
    return frozenset(out)


#: A damaged word as a string: bytes of open places are code points from BYTE on; LOST_BYTE is a lost one, LOST_CHAR a lost character of a single-byte page.
BYTE, LOST_BYTE, LOST_CHAR = 0xF0000, 0xF0100, 0xF0101
_open = re.compile(f"[{chr(BYTE)}-{chr(LOST_CHAR)}]+")


def damaged(word: list) -> str:
    """The lattice of a word as a string."""
    return "".join(x if isinstance(x, str) else "".join(chr({-1: LOST_BYTE, -2: LOST_CHAR}.get(b, BYTE + b)) for b in x) for x in word)


def _byte_pattern(b: int) -> bytes:
    """A lost byte stands for one to three."""
    return rb"[\x80-\xff]{1,3}" if b == -1 else rb"[\xc2-\xf4][\x80-\xbf]+" if b == -2 else re.escape(bytes([0xA0 if b == 0x20 else b]))


@functools.lru_cache(maxsize=4096)
def _fitting(pattern: str) -> tuple[re.Pattern, list[int], bool]:
    """What the UTF-8 of words looks like that a damaged word may be, with a group for each run of open bytes; the runs' lengths; whether the rest is in capitals."""
    out, at, runs = b"", 0, []
    sound = lambda t: b"".join(b"(?:" + b"|".join(re.escape(v.encode()) for v in {c, c.lower(), c.upper()}) + b")" for c in t)
    for m in _open.finditer(pattern):
        run = [{LOST_BYTE: -1, LOST_CHAR: -2}.get(ord(c), ord(c) - BYTE) for c in m[0]]
        out += sound(pattern[at : m.start()]) + b"(" + b"".join(map(_byte_pattern, run)) + b")"
        runs.append(len(run))
        at = m.end()
    rest = _open.sub("", pattern)
    return re.compile(out + sound(pattern[at:]), re.S), runs, len(rest) > 1 and rest.isupper()


def fit(pattern: str, word: str) -> tuple[str, float] | None:
    """The damaged word filled from a known one in lower case, and the log odds of its bytes; None if it doesn't fit. A run of n open bytes holds one to n characters; they take the case that their bytes have."""
    p, runs, capitals = _fitting(pattern)
    cases = [word, word[:1].upper() + word[1:], word.upper()]
    for w in cases[::-1] if capitals else cases:
        m = p.fullmatch(w.encode())
        if m is None:
            continue
        try:
            groups = [g.decode() for g in m.groups()]
        except UnicodeDecodeError:
            continue
        if all(len(g) <= n for g, n in zip(groups, runs)):
            further = 0 if chr(LOST_CHAR) in pattern else sum(len(g) - n for g, n in zip(m.groups(), runs))
            rest = iter(groups)
            if (further > 0 or pattern.count(chr(LOST_BYTE)) > 1) and not _open.sub("", pattern):  # nothing sound beside it tells the word
                continue
            return _open.sub(lambda _: next(rest), pattern), FURTHER * max(0, further)
    return None


def shape(word: str) -> str:
    """What a word and its damaged forms share: their letters within ASCII, and where others or open places are."""
    return regex.sub(r"[^\x00-\x7f]+", LOST, word.lower())


def _places(parts: list) -> int:
    """The least number of characters that the open places hold: lost bytes after a first byte that is kept are one with it."""
    n = 0
    for p in parts:
        inside = 0  # bytes that still belong to the last first byte
        for b in () if isinstance(p, str) else p:
            if b >= 0xC2 or not inside:
                n, inside = n + 1, 1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3
            else:
                inside -= 1
    return n


class Channel:
    """words: frequency of words (lower case) beyond ASCII, single Han characters too. letters: how often a letter follows another in all words of the corpus (with a space before and behind each), and total: their number; by default those of words."""

    def __init__(self, words: dict[str, int], letters: dict[tuple[str, str], int] | None = None, total: int | None = None):
        self.words = words
        self.total = (sum(words.values()) if total is None else total) + 1
        self.shapes: dict[tuple, list[tuple[int, str]]] = {}
        for n, w in sorted(((n, w) for w, n in words.items()), reverse=True):
            k = shape(w)
            for key in ((k, "", ""), (k, w[0], ""), (k, "", w[-1]), (k, w[0], w[-1])):
                self.shapes.setdefault(key, []).append((n, w))
        if letters is None:
            letters = {}
            for w, n in words.items():
                for p, c in zip(" " + w, w + " "):
                    letters[p, c] = letters.get((p, c), 0) + n
        chars: dict[str, int] = {}
        pairs: dict[str, dict[str, int]] = {}
        after: dict[str, int] = {}
        for (p, c), n in letters.items():
            if c > "\x7f":
                chars[c] = chars.get(c, 0) + n
            if not _han.match(c) and not _han.match(p):
                before = pairs.setdefault(c, {})
                before[p] = before.get(p, 0) + n
                after[p] = after.get(p, 0) + n
        self.chars, self.pairs, self.after = chars, pairs, after
        self.all_chars = sum(chars.values()) + 1
        self.each = {c: n for c, n in chars.items() if _han.match(c)} | {c: sum(v.values()) for c, v in pairs.items()}
        self.all_each = sum(self.each.values()) + 1
        self.alphabet = [(c, c.encode()) for c in dict.fromkeys([x for c in chars for x in (c, c.upper()) if len(x) == 1] + list(SIGNS))]
        self.options: dict[tuple, list[tuple[str, float]]] = {}

    def score(self, text: str) -> float:
        """Log frequency of the words beyond ASCII."""
        s = 0.0
        for w in _letters.findall(text.lower()):
            if w.isascii():
                continue
            n = self.words.get(w)
            if n:
                s += math.log(n / self.total)
            else:
                s += sum(math.log((self.chars.get(c, 0) + 0.01) / self.all_chars) for c in w if c > "\x7f")
        return s

    def known(self, text: str) -> tuple[int, int]:
        """How many words beyond ASCII are known, of how many; Han characters count singly."""
        a = b = 0
        for w in _letters.findall(text.lower()):
            if w.isascii():
                continue
            if "㐀" <= w[0] <= "鿿":
                a += sum(self.words.get(c, 0) > 0 for c in w)
                b += len(w)
            else:
                a += w in self.words
                b += 1
        return a, b

    def explains(self, got: str, wide: list[str]) -> bool:
        """Whether a decoded reading is more than an accident or a quotation: single signs between quotes do not count; letters without a known word must be of one script, and more than a few if it isn't Latin."""
        if wide and not any(c > "\x7f" and c != LOST and c not in "“”‘’«»„" for c in _quoted.sub("", got)) and _quoted.search(got):
            return bool(_table("cp1252")[1].search(got))  # a text that quotes such signs, garbled as a whole, quotes them again once decoded
        scripts = {k for c in wide for k, p in _scripts.items() if p.match(c)}
        if not scripts or self.known(got)[0]:
            return True
        return len(scripts) == 1 and (scripts == {"latin"} or len(wide) >= 6)

    def best(self, parts: list, page: str = "") -> tuple[str, int]:
        """The likeliest reading of a lattice by Viterbi, and how many places stay open. Separators are sound, so each word's best path is part of the passage's."""
        out, unfilled, i = [], 0, 0
        while i < len(parts):
            p = parts[i]
            if isinstance(p, str) and not _word.match(p):
                out.append(p)
                i += 1
                continue
            j = i
            while j < len(parts) and (not isinstance(parts[j], str) or _word.match(parts[j])):
                j += 1
            word = parts[i:j]
            if all(isinstance(x, str) for x in word):
                out += word
            else:
                text, bad = self._word(word, page)
                out.append(text)
                unfilled += bad
            i = j
        return "".join(out), unfilled

    def known_word(self, word: list) -> tuple[str, float] | None:
        """The likeliest known word that fits a damaged one."""
        pattern, top = damaged(word), None
        # words with the same sound ends
        low = pattern.lower()
        ends = ["" if _open.match(c) or not c.islower() and not c.isalpha() else c for c in (low[0], low[-1])]
        for n, w in self.shapes.get((shape(pattern), *ends), ()):
            s = math.log(n / self.total)
            if top and s <= top[1]:
                break
            got = fit(pattern, w)
            if got and (top is None or s + got[1] > top[1]):
                top = (got[0], s + got[1])
        return top

    def _chars(self, seg: tuple[int, ...], page: str) -> list[tuple[str, float]]:
        """The characters that the bytes of an open place may be, with the log odds of their loss. None where no byte is left, or more than one is lost: a known word alone may fill that."""
        if all(b < 0 for b in seg) or seg.count(-1) > 1:
            return []
        if (seg, page) not in self.options:
            p = re.compile(b"".join(rb"[\x80-\xff]" if b == -1 else _byte_pattern(b) for b in seg), re.S)
            free = _free(page) if page and page != "gb18030" else ()
            fits = {c: u for c, u in self.alphabet if len(u) == len(seg) and p.fullmatch(u)}
            for b in range(0x80, 0x100):  # those that no word has as well
                u = bytes(b if x == -1 else 0xA0 if x == 0x20 else x for x in seg)
                try:
                    if len(c := u.decode()) == 1:
                        fits.setdefault(c, u)
                except UnicodeDecodeError:
                    pass
            self.options[seg, page] = [(c, HELD * sum(b == -1 and x not in free for b, x in zip(seg, u)) if free else 0.0) for c, u in fits.items()]
        return self.options[seg, page]

    def _step(self, states: dict, c: str, cost: float, add: str, out: dict, open_: int = 0) -> None:
        """The best way from the states to a character; states: last character -> (score, text, open places)."""
        key = c.lower()
        share = (self.each.get(key, 0) + (1 if c in SIGNS else 0.01)) / self.all_each
        before = self.pairs.get(key, {})
        # how often the character follows the last one; beside an open place and for Han characters, which are words by themselves, only how often it occurs
        value = lambda p: states[p][0] + (0.0 if c == LOST else math.log(share) if p == LOST or not before else math.log((before.get(p, 0) + share) / (self.after.get(p, 0) + 1)))
        last = max(states, key=value)
        s = value(last) + cost
        if key not in out or s > out[key][0]:
            out[key] = (s, states[last][1] + add, states[last][2] + open_)

    def _unknown(self, word: list, page: str) -> tuple[str, float, int]:
        """The best path of an unknown word: text, score and places that stay open."""
        states: dict = {" ": (-math.log(self.total), "", 0)}
        for x in word:
            if isinstance(x, str):
                for c in x:
                    out: dict = {}
                    self._step(states, c, 0.0, c, out)
                    states = out
                continue
            at: list[dict] = [states] + [{} for _ in x]
            for i in range(len(x)):
                for w in range(1, min(4, len(x) - i) + 1) if at[i] else ():
                    seg = x[i : i + w]
                    if any(b >= 0xC0 or b == -2 for b in seg[1:]):
                        break
                    options = self._chars(seg, page)
                    for c, cost in options:
                        self._step(at[i], c, cost, c, at[i + w], int(len(options) > 1 and c.lower() not in self.each and c not in SIGNS))
                    self._step(at[i], LOST, OPEN, LOST, at[i + w], 1)
            states = at[-1]
        out = {}
        self._step(states, " ", 0.0, "", out)
        s, text, open_ = out[" "]
        return text, s, open_

    def _word(self, word: list, page: str) -> tuple[str, int]:
        if all(not isinstance(x, str) and all(b < 0 for b in x) for x in word):
            n = sum(map(len, word))
            return LOST * n, n
        known, unknown = self.known_word(word), self._unknown(word, page)
        return (known[0], 0) if known and known[1] > unknown[1] else (unknown[0], unknown[2])

    def _utf8(self, text: str, pages: list[str]) -> tuple[str, int] | None:
        """UTF-8 that was read in another page."""
        tried = None
        for page in pages:
            raw = _written(text, page)
            if not raw:
                continue
            parts: list | None = None
            try:
                whole = raw.decode()
                if LOST not in text:
                    parts = [whole]
            except UnicodeDecodeError as e:
                if LOST not in text and 0x20 not in raw[e.start : e.end + 2]:
                    continue
            if parts is None:
                data = _bytes(text, page)
                parts = data and _lattice(data)
            if not parts:
                continue
            open_ = _places(parts)
            got, unfilled = self.best(parts, page) if open_ else ("".join(parts), 0)
            wide = [c for c in got if c > "\x7f" and c != LOST]
            if not wide and not open_:
                continue
            if sum(bool(_plausible.match(c)) for c in wide) < 0.9 * len(wide) or len(wide) + open_ >= sum(c > "\x7f" for c in text) and page != "gb18030":
                continue
            if page == "gb18030" and (open_ > 0.5 * max(1, len(wide)) or len(wide) < 3):
                continue
            if not self.explains(got, wide):
                continue
            s = self.score(got) - 12 * unfilled - 3 * sum(bool(_odd.match(c)) for c in wide)
            if tried is None or s > tried[2]:
                tried = (got, unfilled, s)
        # the channels' odds: a passage is sound unless a decoded reading is so much likelier than the passage as it stands
        return tried[:2] if tried and tried[2] + GARBLED > self.score(text) + self.signs(text, tried[0]) else None

    def signs(self, text: str, got: str) -> float:
        """Log frequency of the passage's characters beyond ASCII that are no letters, less that of the decoded reading's: misread bytes leave many signs that texts rarely hold."""
        n = lambda t: sum(c > "\x7f" and c != LOST and not _letter.match(c) for c in t)
        return SIGN * (n(text) - n(got))

    def _legacy(self, text: str) -> tuple[str, int] | None:
        """Text of a legacy page that was read as Latin-1: whole words are of letters that a sound text rarely has beside each other."""
        high = _high.findall(text)
        if sum(map(len, high)) < 6 or regex.search(r"[؀-ۿऀ-ॿ㐀-鿿]", text):
            return None
        data = _bytes(text, "cp1252")
        if not data or -1 in data:
            return None
        tried = None
        for page in LEGACY:
            try:
                got = bytes(data).decode(page)
            except UnicodeDecodeError:
                continue
            a, b = self.known(got)
            if b and a >= 0.4 * b and a >= 2 and (tried is None or a / b > tried[1]):
                tried = (got, a / b)
        return tried and (tried[0], 0)

    def _lost(self, text: str) -> tuple[str, int] | None:
        """Single-byte text that was read as UTF-8: each lost byte is one character."""
        n = text.count(LOST)
        inside = regex.findall(rf"(?<=\p{{L}}){LOST}|{LOST}(?=\p{{L}})", text)
        if not inside or (n == 1 and len(text) > 3 and not regex.search(rf"\p{{L}}{LOST}|{LOST}\p{{L}}", text)):
            return None
        got, unfilled = self.best([c if c != LOST else (-2,) for c in text])
        return got, unfilled

    def passage(self, text: str, pages: list[str], legacy: bool) -> tuple[str, int] | None:
        """The restored passage and its open places that could not be filled; None if it is sound."""
        if text.isascii():
            return None
        got = self._utf8(text, pages) if pages else None
        if got:
            again = self._utf8(got[0], self.pages(got[0])) if not got[0].isascii() else None
            return (again[0], again[1] + got[1]) if again else got
        return (self._legacy(text) if legacy else None) or (self._lost(text) if LOST in text else None)

    @staticmethod
    def pages(text: str) -> list[str]:
        """The pages in which UTF-8 looks like something in the text."""
        wide = "\n".join(set(_wide.findall(text)))
        out = [p for p in READ_AS[:-1] if _table(p)[1].search(wide)]
        return out + ["gb18030"] if _han.search(wide) else out

    def text(self, text: str) -> tuple[str, int, int]:
        """The restored text, how many passages were garbled, and how many places stay open."""
        pages, legacy = self.pages(text), bool(_high.search(text))
        if not pages and not legacy and LOST not in text:
            return text, 0, 0
        out, at, n, bad = [], 0, 0, 0
        for m in _units.finditer(text):
            line = m[0]
            if line.isascii():
                continue
            lost, high = LOST in line, legacy and bool(_high.search(line))
            here = pages if lost else [p for p in pages if (_han if p == "gb18030" else _table(p)[1]).search(line)]
            if not here and not high and not lost:
                continue
            got = self.passage(line, here, high)
            if got is None:
                parts = _sentences.split(line)
                if len(parts) > 1:
                    new, cursor = [], 0
                    for p in parts:
                        start = line.index(p, cursor)
                        r = self.passage(p, here, high)
                        new.append(line[cursor:start] + (r[0] if r else p))
                        cursor = start + len(p)
                        if r:
                            n += 1
                            bad += r[1]
                            got = ("", 0)
                    fixed = "".join(new) + line[cursor:]
            else:
                fixed = got[0]
                n += 1
                bad += got[1]
            if got is not None:
                out += [text[at : m.start()], fixed]
                at = m.end()
        return "".join(out) + text[at:], n, bad


_garbled = regex.compile("|".join(_table(p)[1].pattern for p in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")))
_unlikely = regex.compile(r"[À-ÿ]{3}|[ʰ-˿]")


def _sound(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that aren't themselves garbled."""
    for b in it:
        yield b.filter(pa.array([not _garbled.search(w) and not _odd.search(w) and not _unlikely.search(w) for w in b.column(0).to_pylist()], pa.bool_()))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): all words beyond ASCII that aren't garbled, over all documents; Han characters singly."""
    words = docs.where(F.col(text_col).rlike(r"[^\x00-\x7f]")).select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{IsHan}|(?<![a-z])[a-z]*+[\p{L}\p{M}&&[^\x00-\x7f]&&[^\p{IsHan}]][\p{L}\p{M}&&[^\p{IsHan}]]*+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).mapInArrow(_sound, "word string, n bigint")


def _channel(docs: DataFrame) -> tuple[dict[str, int], dict[tuple[str, str], int], int]:
    """The WORDS most frequent words, the pairs of letters of all words, and how many words were counted. Words beyond WORDS are read by their pairs of letters."""
    n = cut(word_counts(docs))
    top = {r["word"]: r["n"] for r in n.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(WORDS).collect()}  # bounded by WORDS
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    each = n.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(marked, i, F.lit(2)))).alias("pair"))
    pairs = each.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(PAIRS).collect()  # bounded by PAIRS
    return top, {(r["pair"][0], r["pair"][1]): r["n"] for r in pairs if len(r["pair"]) == 2}, n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def restored(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_passages, n_open): each garbled document with the restored text; n_open places could not be filled and hold U+FFFD."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_channel(docs))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Channel(*shared.value)
        for batch in it:
            found = [(i, *c.text(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = [x for x in found if x[2]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.int32())], ["doc_id", "text", "n_passages", "n_open"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, text string, n_passages int, n_open int")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id): the documents with at least one garbled passage."""
    return restored(docs).select("doc_id")
