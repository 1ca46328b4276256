"""Token ids of whole texts by a public tokenizer.

The tokenizer's pre-tokens never hold white space, so a text's ids are those of
its pieces between blanks and line ends, one after the other.  Each distinct
piece is encoded once and kept in a bounded store that lives as long as its
worker; a document's ids are then gathered with numpy.  Two things
keep distinct pieces few: the tokenizer lower-cases, which str.lower() equals
for Latin-1 texts, and a run of dots and commas after a letter at the end of a
piece is a pre-token of its own.  Strings of special tokens in a text are
ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

END_ID = 1
#: Characters of distinct pieces a task keeps before it starts anew.
STORE_CHARS = 96 << 20
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normaliser, pre-tokenizer and model of the default tokenizer, without vocabulary and merges.
MAKE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
)
TAIL = re.compile(r"(?<=[a-zà-öø-ÿ])([.,]+)(?=[ \n]|\Z)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Places(dict):
    """piece -> number; a new piece gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        at = self[piece] = len(self)
        return at


def _grown(have: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    if used + len(more) > len(have):
        bigger = np.empty(max(2 * len(have), used + len(more)), dtype=have.dtype)
        bigger[:used] = have[:used]
        have = bigger
    have[used : used + len(more)] = more
    return have


def _one_thread() -> None:
    """A task has one core: tokenizers start no threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


@lru_cache(maxsize=4)
def whole(path: str | None = None):
    """The tokenizer itself, one thread, special tokens' strings as ordinary text; kept from task to task."""
    _one_thread()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or default_tokenizer())
    tokenizer.encode_special_tokens = True
    return tokenizer


def _offsets(found) -> np.ndarray:
    return np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + k) for k in range(256))
    return [chr(b) if b in shown else next(others) for b in range(256)]


class _Joined:
    """A byte-level BPE tokenizer that needs no pre-tokens, for Latin-1 texts in lower case.

    The vocabulary marks the ends of words.  Here a word's last byte is a symbol
    of its own instead, and as no merge goes on from the end of a word, merges
    stay within words even where nothing separates them.  So a whole document,
    less its white space, is one run of symbols, merged in one go.
    """

    SPACE, LETTER, NUMBER, OTHER = range(4)
    #: Where the symbols of last bytes begin: characters for private use.
    LAST = 0xE000

    def __init__(self, model: dict):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        letters, end = _byte_letters(), model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        form = {c: c for c in letters} | {c + end: chr(self.LAST + b) for b, c in enumerate(letters)}
        for a, b in merges:
            form[a + b] = form[a] + form[b]
        ids = {symbols: model["vocab"][token] for token, symbols in form.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=ids, merges=[(form[a], form[b]) for a, b in merges]))
        self.length = np.zeros(max(ids.values()) + 1, np.int64)
        self.length[list(ids.values())] = [len(symbols) for symbols in ids]
        self.symbol = np.array([*map(ord, letters), *range(self.LAST, self.LAST + 256)], "<u2")
        cut = pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True).pre_tokenize_str
        kinds = {0: self.SPACE, 2: self.NUMBER}
        self.kind = np.array([kinds.get(len(cut(2 * chr(c))), self.LETTER if len(cut("a" + chr(c))) == 1 else self.OTHER) for c in range(256)], np.uint8)

    def _last(self, chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether a character ends a pre-token of SPLIT."""
        last = np.ones(len(chars), bool)
        last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == self.NUMBER)
        at = np.flatnonzero(chars == ord("'"))
        if len(at):
            at = at[(at == 0) | (kind[at - 1] != self.OTHER)]
            after = np.concatenate([chars, np.zeros(2, np.uint8)])
            one, two = after[at + 1], after[at + 2]
            short = np.isin(one, list(b"stmd"))
            long = np.logical_or.reduce([(one == a) & (two == b) for a, b in (b"re", b"ve", b"ll")])
            last[at[short | long]] = False
            last[at[short] + 1] = last[at[long] + 2] = True
        return last

    def spans(self, text: str) -> np.ndarray:
        """First and last (exclusive) character of each token."""
        chars = np.frombuffer(text.encode("latin-1"), np.uint8)
        kind = self.kind[chars]
        last = self._last(chars, kind)
        at = np.flatnonzero(kind)
        if text.isascii():
            symbols = chars[at] + np.uint16(256) * last[at]
        else:
            at = np.repeat(at, 1 + (chars[at] >= 128))  # two bytes of UTF-8
            ended = last[at]
            ended[:-1] &= at[1:] != at[:-1]
            symbols = np.frombuffer(text.encode(), np.uint8)[np.repeat(kind > 0, 1 + (chars >= 128))] + np.uint16(256) * ended
        (found,) = self.tokenizer.encode_batch_fast([self.symbol[symbols].tobytes().decode("utf-16-le")], add_special_tokens=False)
        length = self.length[np.array(found.ids, np.int64)]
        end = np.cumsum(length)
        return np.stack([at[end - length], at[end - 1] + 1], axis=1)


@lru_cache(maxsize=4)
def _joined(path: str | None = None) -> _Joined | None:
    """None for a tokenizer of another make, whose texts it has to cut itself."""
    _one_thread()
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        made = json.load(f)
    model = made["model"]
    rules = {k: v for k, v in model.items() if k not in ("vocab", "merges")}
    return _Joined(model) if (made["normalizer"], made["pre_tokenizer"], rules) == MAKE else None


def spans(text: str, path: str | None = None) -> np.ndarray:
    """First and last (exclusive) character of each token of a whole text, encoded at once.

    Latin-1 texts are composed and lower-case character for character, so they
    skip the normaliser.  Their tokens hold every byte but white space, in
    order, so where a token lies follows from the bytes of those before it.
    """
    joined = _joined(path)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        joined = None
    if joined is None:
        return _offsets(whole(path).encode(text, add_special_tokens=False))
    return joined.spans(text.lower())


class Pieces:
    """Ids of texts by way of their blank-separated pieces."""

    def __init__(self, path: str | None = None):
        self.tokenizer = whole(path)
        self._clear()

    def _clear(self) -> None:
        self.places, self.chars = _Places(), 0
        self.n, self.used = 0, 0
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int64)

    def _encode_fresh(self) -> None:
        fresh, self.places.fresh = self.places.fresh, []
        if not fresh:
            return
        length = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.chars += int(length.sum()) + 60 * len(fresh)
        # One call for all: joined by blanks they stay apart.
        found = self.tokenizer.encode(" ".join(fresh), add_special_tokens=False)
        start = np.cumsum(length + 1) - length - 1
        at = np.fromiter((lo for lo, _ in found.offsets), np.int64, len(found.ids))
        count = np.bincount(np.searchsorted(start, at, side="right") - 1, minlength=len(fresh))
        self.first = _grown(self.first, self.n, self.used + np.cumsum(count) - count)
        self.count = _grown(self.count, self.n, count)
        self.ids = _grown(self.ids, self.used, np.array(found.ids, np.int64))
        self.n, self.used = self.n + len(fresh), self.used + len(at)

    def encode(self, text: str) -> np.ndarray:
        """The text's ids."""
        if self.chars > STORE_CHARS:
            self._clear()
        try:
            text.encode("latin-1")
            text = TAIL.sub(r" \1", text.lower())
        except UnicodeEncodeError:
            pass
        parts = text.replace("\n", " ").split(" ")
        at = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
        self._encode_fresh()
        n = self.count[at]
        return self.ids[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


@lru_cache(maxsize=4)
def held(path: str) -> Pieces:
    """The store of this worker, kept from task to task."""
    return Pieces(path)


def per_task(make: Callable[[], object]) -> Callable[[], object]:
    """make() once in each Python worker."""
    held: list[object] = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get
