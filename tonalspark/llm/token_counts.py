"""Token counts by a tokenizer compiled into a finite-state transducer.

The byte-pair merges of a vocabulary are compiled, state by state as texts need them, into a deterministic
transducer over the symbols of a word: each transition carries the change of the number of tokens that have been
emitted so far. For a prefix of a word the last token of its encoding is unique, and it is the one token that
may stand behind the last token of the remaining prefix; so a state has to know the last tokens at as many
positions as the longest token is long, and no more.

Between words the transducer is back in its start state. A chunk of a text therefore has a short state map:
what stands before its first white space (read from whatever state comes in), a count, and what stands behind
its last white space. State maps compose associatively; a tree of compositions gives the count of a whole text.
"""

from __future__ import annotations

import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import ASCII_SPACE, arrow_map, utf8

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Compiled states (then it starts anew) and remembered words (then further ones are counted each time) of a worker.
MAX_STATES, MAX_WORDS = 150_000, 600_000


class _State:
    """What has been read of a word: the last symbol, the last token of its encoding, and the state before that symbol."""

    __slots__ = ("back", "count", "next", "symbol", "token")

    def __init__(self, back: _State | None, symbol: str, token: str | None, count: int):
        self.back, self.symbol, self.token, self.count = back, symbol, token, count
        self.next: dict | None = None


class WordTransducer:
    """Counts the tokens of one word, given as symbols of the vocabulary."""

    #: States behind so many symbols are compiled, used and dropped; nearer the start they are kept.
    KEPT_DEPTH = 7

    def __init__(self, merges: list, vocab: dict, word_end: str):
        self.rank, self.split, self.made = {}, {}, {}
        for i, m in enumerate(merges):
            pair = tuple(m if isinstance(m, list) else m.split(" "))
            self.rank.setdefault(pair, i)
            if (token := "".join(pair)) not in self.made:
                self.made[token], self.split[token] = i, pair
        self.vocab, self.end = vocab, word_end
        self.longest = max((len(t.removesuffix(word_end)) for t in vocab), default=1)
        self.firsts: dict = {}
        self.clear()

    def clear(self) -> None:
        self.start, self.states = _State(None, "", None, 0), 1

    def apart(self, a: str, b: str, before: float = float("inf")) -> bool:
        """Would the merges of a rank under ``before`` leave tokens ``a`` and ``b`` side by side?

        The merges that made the two are undone, latest first; at each step the tokens at the seam must not have
        merged with each other earlier than one of them was used up. Of equal merges the left one comes first.
        """
        rank, made = self.rank, self.made
        while rank.get((a, b), before) >= before:
            of_a, of_b = made.get(a, -1), made.get(b, -1)
            if of_a > of_b:
                before, a = of_a, self.split[a][1]
            elif of_b >= 0:
                before, b = of_b + 1, self.split[b][0]
            else:
                return True
        return False

    def first(self, token: str) -> bool:
        """Is the token its own encoding?"""
        if (known := self.firsts.get(token)) is None:
            a, b = self.split.get(token, (None, None))
            known = a is None or self.first(a) and self.first(b) and self.apart(a, b, self.made[token])
            self.firsts[token] = known
        return known

    def step(self, state: _State, symbol: str) -> _State:
        """Compiles the transition from ``state`` by ``symbol``."""
        token, at = symbol, state
        for _ in range(self.longest):
            if token in self.vocab and (self.first(token) and self.apart(at.token, token) if at.token is not None else self.first(token)):
                return _State(state, symbol, token, at.count + 1)
            if at.back is None:
                break
            token, at = at.symbol + token, at.back
        raise ValueError(f"no token ends with {symbol!r}")

    def count(self, word: str) -> int:
        """Tokens of a word; each transition's output is the difference of the two states' counts."""
        if not word:
            return 0
        if self.states > MAX_STATES:
            self.clear()
        state, depth, held = self.start, 0, deque()
        for symbol in word[:-1]:
            new = state.next.get(symbol) if state.next else None
            if new is None:
                new = self.step(state, symbol)
                if depth < self.KEPT_DEPTH:
                    state.next = state.next or {}
                    state.next[symbol] = new
                    self.states += 1
            state, depth = new, depth + 1
            if depth > self.KEPT_DEPTH:  # of a word's own states, those that the longest token can't reach back to go
                held.append(state)
                if len(held) > self.longest:
                    held.popleft().back = None
        return self.step(state, word[-1] + self.end).count


def _steps(normalizer: dict | None) -> list[str]:
    """The kinds of a normaliser's steps, in their order."""
    if not normalizer:
        return []
    if normalizer["type"] == "Replace" and normalizer["pattern"].get("Regex") == r"\s+" and not normalizer["content"].strip():
        return ["Space"]
    if normalizer["type"] == "Sequence":
        return [k for n in normalizer["normalizers"] for k in _steps(n)]
    return [normalizer["type"]]


class Counter(dict):
    """Tokens of a piece of text without ASCII white space, remembered for pieces met before."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only byte-pair vocabularies over words can be compiled")
        steps = _steps(spec.get("normalizer"))
        if not set(steps) <= {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Space"}:
            raise ValueError(f"a normaliser of {steps} may change ASCII words in ways that aren't compiled")
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.words = WordTransducer(model["merges"], model["vocab"], model.get("end_of_word_suffix") or "")
        marks = [t["content"] for t in spec["added_tokens"]]
        self.lower = "Lowercase" in steps
        self.special = re.compile("|".join(map(re.escape, marks))) if marks else re.compile(r"(?!)")
        self.marked = re.compile(b"|".join(re.escape(m.encode()) for m in marks), re.IGNORECASE) if marks else re.compile(rb"(?!)")

    def __missing__(self, piece: bytes) -> int:
        if piece.isalpha():  # ASCII letters are one word as they stand
            return self.kept(piece, self.words.count((piece.lower() if self.lower else piece).decode()))
        if piece[-1] in b".,;:!?" and piece[:-1].isalpha():
            return self.kept(piece, self[piece[:-1]] + self.words.count(chr(piece[-1])))
        text, n = piece.decode("utf-8", "replace"), 0
        parts = self.special.split(text)
        n += len(parts) - 1
        for part in parts:
            if part:
                plain = self.normalizer.normalize_str(part) if self.normalizer else part
                n += sum(self.words.count(w) for w, _ in self.pre.pre_tokenize_str(plain))
        return self.kept(piece, n)

    def kept(self, piece: bytes, n: int) -> int:
        if len(piece) <= 64 and len(self) < MAX_WORDS:
            self[piece] = n
        return n

    def state_map(self, chunk: bytes) -> tuple:
        """(head, count, tail): head is None where the chunk begins with white space; without white space all is head
        and count is None."""
        if not chunk:
            return (None, 0, b"")
        pieces = chunk.split()
        if not pieces:
            return (b"", 0, b"")
        opens, closes = chunk[0] not in ASCII_SPACE, chunk[-1] not in ASCII_SPACE
        if len(pieces) == 1 and opens and closes:
            return (chunk, None, b"")
        head = pieces.pop(0) if opens else b""
        tail = pieces.pop() if closes and pieces else b""
        return (head, sum(map(self.__getitem__, pieces)), tail)

    def composed(self, a: tuple, b: tuple) -> tuple:
        """The state map of two adjacent chunks."""
        if a[0] is None:
            return b
        if b[0] is None:
            return a
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        middle = a[2] + b[0]
        return (a[0], a[1] + (self[middle] if middle else 0) + b[1], b[2])

    def tokens(self, text: bytes | None) -> int:
        if not text:
            return 0
        if self.lower and not self.marked.search(text):
            text = text.lower()  # as the vocabulary's normaliser will; special strings are matched before it, so none may come of it
        maps = [self.state_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # a level of the scan's tree: adjacent maps compose independently
            maps = [self.composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return (n or 0) + (self[head] if head else 0) + (self[tail] if tail else 0)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker and vocabulary."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text as the vocabulary file at ``path`` gives them, without added special tokens.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Texts of any length are cut into chunks
    whose state maps are composed. Special strings inside texts count as one token each, as in the library. A null
    id stays null; repeated rows are counted one by one; other columns are ignored.
    Returns (id, n_bytes long, n_tokens long, over_limit boolean). No shuffle.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, n_bytes, n_tokens = counter(path), [], []
        for text in utf8(batch.column(1)):
            n_bytes.append(len(text or b""))
            n_tokens.append(own.tokens(text))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(rows, count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
