"""Token counts of a byte-level merge tokenizer, by finite-state transducers.

Two deterministic machines are compiled from the tokenizer's file. The *splitter* reads
character classes and says where words start; it has nine states. The text is cut into
chunks, every chunk is run from all nine states at once, and the resulting state maps are
composed by a parallel prefix scan, so that each chunk learns the state it begins in. The
*merger* reads the bytes of a word; its transitions carry the number of tokens that become
certain with that byte. It is compiled while it reads: a state is what the next bytes can
still depend on, the starts from which a vocabulary entry may still be completed, each with
the token that ends before it. Nothing is ever merged, and a word of any length is read
once, in pieces if need be."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Symbols of the splitter. ``TURN``, ``PULL``, ``ELL`` and ``E`` are the letters that may
#: follow an apostrophe (s t m d, r v, l, e); ``END`` ends a text, ``SPECIAL`` stands for a
#: special token inside it.
LETTER, TURN, PULL, ELL, E, NUMBER, OTHER, QUOTE, BLANK, SPACE, END, SPECIAL = range(12)
#: States: at a break; in a run of letters, numbers, others; after an apostrophe that began a
#: word, and one letter later; after a blank or another space.
BREAK, LETTERS, NUMBERS, OTHERS, QUOTED, PULLED, ELLED, BLANKS, SPACES = range(9)
STATES, SYMBOLS = 9, 12
#: Output of a transition: a word starts at this symbol, or at the one before.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """``next, output`` for state * SYMBOLS + symbol."""
    step = np.zeros((STATES, SYMBOLS), np.uint8)
    out = np.zeros((STATES, SYMBOLS), np.uint8)
    opened = [LETTERS] * 5 + [NUMBERS, OTHERS, QUOTED, BLANKS, SPACES, BREAK, BREAK]
    for state in range(STATES):
        step[state], out[state] = opened, HERE
    for state in (LETTERS, PULLED, ELLED):  # a run of letters goes on
        out[state, LETTER : E + 1] = 0
    out[NUMBERS, NUMBER] = 0
    for state in (OTHERS, QUOTED):
        step[state, [OTHER, QUOTE]], out[state, [OTHER, QUOTE]] = OTHERS, 0
    step[QUOTED, [TURN, PULL, ELL]], out[QUOTED, [TURN, PULL, ELL]] = [BREAK, PULLED, ELLED], 0
    for state, last in ((PULLED, E), (ELLED, ELL)):
        out[state] |= BEFORE  # no short form: its letter began a word
        step[state, last], out[state, last] = BREAK, 0
    for state in (BLANKS, SPACES):  # the last of several spaces stands alone or with what follows
        out[state, : QUOTE + 1] |= BEFORE
        out[state, [BLANK, SPACE]] = 0
    out[BLANKS, : QUOTE + 1] = BEFORE
    step[BLANKS, QUOTE] = OTHERS
    return step.ravel(), out.ravel()


def character_classes(tokenizer) -> np.ndarray:
    """The symbol of every code point. Where the Unicode versions at hand differ on a code
    point, the tokenizer itself is asked."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    whole = "".join(map(chr, points))
    of = np.full(0x110000, OTHER, np.uint8)
    place = np.array(points)
    for pattern, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, whole):
            of[place[m.start() : m.end()]] = symbol
    kinds = {"L": LETTER, "N": NUMBER}
    ask = tokenizer.pre_tokenizer.pre_tokenize_str
    for c in points:
        if of[c] != SPACE and of[c] != kinds.get(unicodedata.category(chr(c))[0], OTHER):
            of[c] = next((s for x, s in (("a", LETTER), ("1", NUMBER)) if len(ask(x + chr(c) + x)) == 1), OTHER)
    for letters, symbol in (("stmd", TURN), ("rv", PULL), ("l", ELL), ("e", E), ("'", QUOTE), (" ", BLANK)):
        of[[ord(x) for x in letters]] = symbol
    return of


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones
    for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """What the tasks need of a byte-level tokenizer file: merges as pairs of token numbers
    (bytes are 0 to 255, merge ``i`` makes token ``256 + i``), special strings, classes."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
        raise ValueError("a byte-level merge tokenizer without normalizer and prefix blank is needed")
    number: dict[str, int] = dict(byte_letters())
    merges = []
    for pair in spec["model"]["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((number[a], number[b]))
        number[a + b] = 255 + len(merges)
    return {"merges": merges, "special": [t["content"] for t in spec["added_tokens"]], "classes": character_classes(Tokenizer.from_file(path))}


#: Token counts within a state are small and may be negative; they are kept with this added.
ZERO = 2048


def pack(node: int, before: int, tokens: int) -> int:
    """A start from which an entry may be completed: where it stands in the vocabulary's
    tree, the token before it (-1: none), tokens so far relative to the state's first start."""
    return node << 32 | (before + 1) << 12 | (tokens + ZERO)


class Merger:
    """The transducer over the bytes of one word.

    A split of a word into tokens is the merges' result exactly if each token is the result
    for its own bytes and so is each two neighbours' for theirs. So the token that ends at a
    place is known from those that end before it, and there is one for every place."""

    def __init__(self, merges: Sequence[tuple[int, int]]):
        self.parts = merges
        self.made = {pair: 256 + i for i, pair in enumerate(merges)}
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        spelled = [bytes([b]) for b in range(256)]
        for a, b in merges:
            spelled.append(spelled[a] + spelled[b])
        for t, spelling in enumerate(spelled):
            node = 0
            for byte in spelling:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][byte]
            self.token[node] = t
        self._reached: dict[int, bool] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], list] = {}
        self.known: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the first state alone: nothing read, nothing before, no token."""
        first = (pack(0, -1, 0),)
        self.number, self.states = {first: 0}, [first]
        self.steps: dict[int, int] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one side (0 left, 1 right) while ``token`` is made, each
        with the merge that takes it up."""
        found = self._edges.get((token, side))
        if found is None:
            found, t, taken = [], token, float("inf")
            while True:
                found.append((t, taken))
                if t < 256:
                    break
                t, taken = self.parts[t - 256][side], t
            self._edges[token, side] = found
        return found

    def apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge joins ``a``'s end with ``b``'s begin, of those prior to ``before``.
        Of equal merges the left one comes first."""
        for x, x_taken in self.edge(a, 1):
            for y, y_taken in self.edge(b, 0):
                m = self.made.get((x, y))
                if m is not None and m < before and m < x_taken and m <= y_taken:
                    return False
        return True

    def reached(self, token: int) -> bool:
        """Whether the token's own bytes give that token."""
        if token < 256:
            return True
        found = self._reached.get(token)
        if found is None:
            a, b = self.parts[token - 256]
            found = self._reached[token] = self.reached(a) and self.reached(b) and self.apart(a, b, token)
        return found

    def stable(self, a: int, b: int) -> bool:
        found = self._stable.get((a, b))
        if found is None:
            found = self._stable[a, b] = self.apart(a, b)
        return found

    def compile(self, state: int, byte: int) -> int:
        """The next state, and the tokens that are certain by then in the low bits."""
        live, last, count = [], -1, 0
        for start in self.states[state]:
            node, before, tokens = start >> 32, (start >> 12 & 0xFFFFF) - 1, (start & 0xFFF) - ZERO
            node = self.child[node].get(byte)
            if node is None:
                continue
            t = self.token[node]
            if last < 0 and t >= 0 and self.reached(t) and (before < 0 or self.stable(before, t)):
                last, count = t, tokens + 1
            if self.child[node]:
                live.append((node, before, tokens))
        live.append((0, last, count))
        sure = live[0][2]
        key = tuple([pack(node, before, tokens - sure) for node, before, tokens in live])
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        found = self.steps[state << 8 | byte] = to << 12 | (sure + ZERO)
        return found

    def run(self, state: int, word: bytes) -> tuple[int, int]:
        """The state after ``word`` and the tokens that its transitions carry."""
        step, total = self.steps.get, 0
        for byte in word:
            to = step(state << 8 | byte) or self.compile(state, byte)
            state = to >> 12
            total += to & 0xFFF
        return state, total - ZERO * len(word)

    def rest(self, state: int) -> int:
        """Tokens that the end of the word adds."""
        return (self.states[state][-1] & 0xFFF) - ZERO

    def count(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            state, total = self.run(0, word)
            found = total + self.rest(state)
            if len(word) <= 32:
                self.known[word] = found
        return found

    def shrink(self) -> None:
        """Forget what was compiled if it has grown large; it is compiled again at need."""
        if len(self.known) > MOST_WORDS:
            self.known = {}
        if len(self._stable) > MOST_WORDS:
            self._stable = {}
        if len(self.states) > MOST_STATES:
            self.forget()


#: Memory bounds of a worker: words whose count is remembered, and compiled states.
MOST_WORDS, MOST_STATES = 400_000, 500_000
#: Symbols of a chunk, and of a stretch of text that is worked on at once.
CHUNK, STRETCH = 256, 1 << 20


def entry_states(symbols: np.ndarray, step: np.ndarray, state: int) -> np.ndarray:
    """The state in which each whole chunk of ``symbols`` (chunks x CHUNK) begins, and the
    one after the last: maps of all chunks from all states, composed by a prefix scan."""
    n = len(symbols)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (n, STATES)).copy()
    for j in range(symbols.shape[1]):
        maps = step[maps.astype(np.int16) * SYMBOLS + symbols[:, j, None]]
    reach = 1
    while reach < n:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return np.concatenate([[state], maps[:, state]]).astype(np.uint8)


def word_starts(symbols: np.ndarray, step: np.ndarray, out: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Whether a word starts at each symbol, as far as the symbols tell, and the state after them."""
    n = len(symbols)
    whole = n // CHUNK
    marks = np.zeros(n + 1, np.uint8)  # one place later, so that BEFORE has a place
    if whole:
        rows = symbols[: whole * CHUNK].reshape(whole, CHUNK)
        states = entry_states(rows, step, state)
        now, state = states[:-1].astype(np.int16), int(states[-1])
        found = np.empty((CHUNK, whole), np.uint8)
        for j in range(CHUNK):
            at = now * SYMBOLS + rows[:, j]
            found[j] = out[at]
            now = step[at].astype(np.int16)
        marks[1 : whole * CHUNK + 1] = found.T.ravel()
    for i in range(whole * CHUNK, n):
        at = state * SYMBOLS + int(symbols[i])
        marks[i + 1], state = out[at], int(step[at])
    starts = (marks[1:] & HERE).astype(bool)
    starts[:-1] |= (marks[2:] & BEFORE).astype(bool)
    return starts, state


class Counter:
    """Counts tokens of many texts, as one stream of symbols in stretches of bounded size."""

    def __init__(self, spec: dict):
        self.merger = Merger(spec["merges"])
        self.classes = spec["classes"]
        self.step, self.out = splitter()
        self.special = regex.compile("|".join(regex.escape(s) for s in spec["special"])) if spec["special"] else None

    def count(self, texts: list) -> list[int]:
        """Tokens of each text; none for null and empty ones."""
        counts, some, held = [0] * len(texts), [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if len(t) > STRETCH:
                counts[i] = self._long(t)
                continue
            if held + len(t) > STRETCH:
                self._stretch(some, texts, counts)
                some, held = [], 0
            some.append(i)
            held += len(t) + 1
        if some:
            self._stretch(some, texts, counts)
        return counts

    def _segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and their number."""
        if self.special is None:
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def _stretch(self, some: list[int], texts: list, counts: list[int]) -> None:
        parts: list[str] = []
        owners: list[int] = []
        for i in some:
            found, specials = self._segments(texts[i])
            counts[i] += specials
            parts += found
            owners += [i] * len(found)
        starts, raw, edges, ends = self._split(parts)
        words = np.flatnonzero(starts)
        begin, close = edges[words], np.append(edges[words[1:]], len(raw))
        real = ~np.isin(words, ends - 1)  # all but the ends of the parts
        known = self.merger.known.get
        found = [known(raw[a:b]) for a, b in zip(begin[real].tolist(), close[real].tolist(), strict=True)]
        if None in found:
            count, at = self.merger.count, zip(begin[real].tolist(), close[real].tolist(), strict=True)
            found = [count(raw[a:b]) if n is None else n for n, (a, b) in zip(found, at, strict=True)]
        of = np.searchsorted(ends, words[real], side="right")
        for i, n in zip(owners, np.bincount(of, np.array(found, np.float64), len(parts)).astype(np.int64).tolist(), strict=True):
            counts[i] += n
        self.merger.shrink()

    def _split(self, parts: list[str]):
        """Word starts over the parts with an end after each, their bytes, the byte at which
        each symbol begins, and where each part's symbols end."""
        whole = "\0".join(parts) + "\0"
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.classes[points]
        ends = np.cumsum([len(p) + 1 for p in parts])
        symbols[ends - 1] = END
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        width[ends - 1] = 0
        starts, _ = word_starts(symbols, self.step, self.out, BREAK)
        return starts, "".join(parts).encode("utf-8", "surrogatepass"), np.concatenate([[0], np.cumsum(width)]), ends

    def _long(self, text: str) -> int:
        """A text beyond a stretch: the machines' states go from one stretch to the next."""
        parts, total = self._segments(text)
        for part in parts:
            state, inside, at = BREAK, 0, 0
            while at < len(part):
                to = min(len(part), at + STRETCH)
                ahead = min(len(part), to + 2)  # what may still move a start
                points = np.frombuffer(part[at:ahead].encode("utf-32-le", "surrogatepass"), np.uint32)
                symbols = self.classes[points]
                if ahead == len(part):
                    symbols = np.append(symbols, np.uint8(END))
                starts, _ = word_starts(symbols, self.step, self.out, state)
                _, state = word_starts(symbols[: to - at], self.step, self.out, state)
                cuts = [*np.flatnonzero(starts[: to - at]).tolist(), to - at]
                chunk = part[at:to]
                inside, made = self.merger.run(inside, chunk[: cuts[0]].encode("utf-8", "surrogatepass"))
                total += made
                if len(cuts) > 1:  # the word that was open ends here
                    total += self.merger.rest(inside)
                    for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
                        total += self.merger.count(chunk[a:b].encode("utf-8", "surrogatepass"))
                    inside, made = self.merger.run(0, chunk[cuts[-2] :].encode("utf-8", "surrogatepass"))
                    total += made
                at = to
            total += self.merger.rest(inside)
        return total


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", carry: Sequence[str] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """For each document ``n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens);
    ``carry`` under their names.

    ``path``: the tokenizer's file, read by the driver and sent to the tasks (some 2 MB).
    One pass without shuffle. Null and empty texts have no bytes and no tokens; special
    strings inside a text count as their token; repeated rows are counted each."""
    sent = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def make():
        spec = sent.value
        if "counter" not in spec:  # the worker keeps what it has compiled for its next tasks
            spec["counter"] = Counter(spec)
        counter = spec["counter"]
        return lambda texts: {"n_tokens": pa.array(counter.count(texts), pa.int64())}

    given = docs.select(*carry, F.col(text_col).alias("__text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("__bytes"))
    counted = map_texts(given, "__text", [*carry, "__bytes"], "n_tokens long", make)
    return counted.select(*[F.col(f"__{c}").alias(c) for c in carry], F.col("____bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
