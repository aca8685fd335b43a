"""SentencePiece BPE encoding in vectorised merge rounds, and decoding.

The texts of a batch become one flat array of symbols, cut into words. A round finds the best (smallest) rank of an adjacent pair in every
word by one segmented minimum, merges its occurrences from the left all at once, and compacts the arrays; words without a pair leave. This gives what the
sequential rule gives, which merges the best pair of a text, the leftmost of equals, one at a time:

* Merging a pair can only change what comes next through the new pairs at its sides. Pieces that can form a pair with a rank as good as their own, and
  pieces that share their rank, are known from the vocabulary alone; of those only the leftmost occurrence in a word is merged in a round.
* A word ends before a space that follows something else, where no piece of the vocabulary reaches over that border, and, inside, between
  two characters that stand side by side in no piece.

Words repeat, so a worker remembers the ids of short words it has seen; that memory is bounded and holds no result back.
"""

from __future__ import annotations

import functools
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.session import pin

DEFAULT_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: The sign that stands for a space inside pieces, and what stands for bytes that are no character.
SPACE, NO_CHARACTER = "▁", "�"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
CODES = 0x110000
NONE = np.iinfo(np.int32).max
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MEMORY_WORDS, MEMORY_IDS, MEMORY_LENGTH = 250_000, 2_500_000, 1000


class Pieces:
    """What a model file says, as arrays. A symbol is a piece id, or the number of pieces plus the code of a character that is no piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            model = proto.ModelProto.FromString(file.read())
        rules, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without text normalisation is needed")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = rules.add_dummy_prefix
        self.count = len(model.pieces)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = np.array([i for i, p in enumerate(model.pieces) if p.type == BYTE], np.int32)  # of 0 to 255
        self.byte_of = {int(i): k for k, i in enumerate(self.bytes)}
        self.surface = [self._surface(p, trainer.unk_surface) for p in model.pieces]
        self.ordinary = np.array([p.type == NORMAL for p in model.pieces])
        self.starts_with_space = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])

        known = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.symbol = np.arange(self.count, self.count + CODES, dtype=np.int64)
        for piece, i in known.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        number = lambda part: known.get(part, self.count + ord(part) if len(part) == 1 else None)
        scores = np.array([p.score for p in model.pieces], np.float32)
        kept = np.array(sorted(known.values()))
        levels, place, often = np.unique(-scores[kept], return_inverse=True, return_counts=True)
        self.rank = np.full(self.count + 1, NONE, np.int32)  # the last one is that of no pair
        self.rank[kept] = place
        shared = np.zeros(self.count + 1, bool)
        shared[kept] = often[place] > 1

        keys, merged, inner = [], [], set()
        self.one_at_a_time = shared
        for piece, i in known.items():
            inner.update(zip(piece, piece[1:]))
            for at in range(1, len(piece)):
                left, right = number(piece[:at]), number(piece[at:])
                for side in (left, right):  # a part that is itself a piece and not better than the whole
                    if side is not None and side < self.count and self.rank[i] <= self.rank[side]:
                        self.one_at_a_time[side] = True
                if left is not None and right is not None:
                    keys.append(left * (self.count + CODES) + right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.merged = np.append(np.array(merged, np.int32)[order], np.int32(self.count))
        self._place(np.array(keys, np.int64)[order])
        self.inner = np.sort(np.array([ord(a) * CODES + ord(b) for a, b in inner], np.int64))
        apart = not any(a != SPACE and b == SPACE for a, b in inner)
        self.lead = SPACE if apart and self.prefix else ""
        self.spaced_words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else r"(?s).+").findall
        self.forget()

    def forget(self) -> None:
        """Empty the memory: the number of each known word, and for each number where its ids lie in the pool."""
        self.memory: dict[str, int] = {}
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _surface(piece, unknown: str) -> str:
        return {NORMAL: piece.piece.replace(SPACE, " "), UNKNOWN: unknown}.get(piece.type, "")

    def words(self, text: str) -> list[str]:
        """The words of a text, without ``lead``, which then starts all of them."""
        if self.lead and "  " not in text and text[0] != " " and SPACE not in text:
            return text.split(" ")
        words = self.spaced_words((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        return [w[1:] for w in words] if self.lead else words

    def _place(self, keys: np.ndarray) -> None:
        """A table of twice as many places as keys or more: a key stands at its hashed place or, where that is taken, at the next free one."""
        bits = max(len(keys), 1).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.slot, self.key = np.full(1 << bits, len(keys), np.int64), np.full(1 << bits, -1, np.int64)
        rest, at = np.arange(len(keys)), self._hashed(keys)
        while len(rest):
            free = self.key[at] < 0
            taken, first = np.unique(at[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            self.key[taken], self.slot[taken] = keys[rest[mine]], rest[mine]
            left = np.ones(len(rest), bool)
            left[mine] = False
            rest, at = rest[left], (at[left] + 1) % len(self.key)

    def _hashed(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULTIPLIER) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes; ``count`` for none."""
        key = left * (self.count + CODES) + right
        at = self._hashed(key)
        found = self.key[at]
        out = np.where(found == key, self.merged[self.slot[at]], np.int32(self.count))
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            place = (at[rest] + 1) % len(self.key)
            at[rest] = place
            found = self.key[place]
            hit = found == key[rest]
            out[rest[hit]] = self.merged[self.slot[place[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


def merge_rounds(model: Pieces, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The final symbol at the place of its first character, -1 elsewhere. ``first`` marks the first symbol of every word."""
    out = np.full(len(symbols), -1, np.int64)
    at, word = np.arange(len(symbols)), np.cumsum(first) - 1
    made = np.full(len(symbols), model.count, np.int64)
    inside = np.flatnonzero(~first[1:])
    made[inside] = model.pairs(symbols[inside], symbols[inside + 1])
    rank = model.rank[made]
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(word)))
        least = np.minimum.reduceat(rank, starts)
        best = np.repeat(least, sizes)
        ended = best == NONE
        out[at[ended]] = symbols[ended]

        hits = np.flatnonzero((rank == best) & ~ended)
        one = model.one_at_a_time[made[hits]]
        run = np.append(True, np.diff(hits) != 1)[: len(hits)]  # hits side by side share a symbol: every second one counts
        place = np.arange(len(hits))
        odd = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 1
        again = np.append(False, word[hits][1:] == word[hits][:-1])[: len(hits)]
        hits = hits[np.where(one, ~again, ~odd)]

        symbols[hits] = made[hits]
        keep = ~ended
        keep[hits + 1] = False
        new = np.cumsum(keep)[hits] - 1
        symbols, at, word, made = symbols[keep], at[keep], word[keep], made[keep]
        for left in (new - 1, new):  # the pairs at both sides of what was made
            left = left[left >= 0]
            right = left + 1
            joined = (right < len(word)) & (word[left] == word[np.minimum(right, len(word) - 1)])
            made[left] = model.count
            made[left[joined]] = model.pairs(symbols[left[joined]], symbols[right[joined]])
        rank = model.rank[made]
    return out


def encode_words(model: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after the other, and how many each word has."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    key = codes[:-1] * CODES + codes[1:]
    near = np.minimum(np.searchsorted(model.inner, key), len(model.inner) - 1)
    first = np.append(True, model.inner[near] != key)[: len(codes)]
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    out = merge_rounds(model, model.symbol[codes], first)
    final = np.flatnonzero(out >= 0)
    symbols = out[final]
    strange = symbols >= model.count
    if strange.any():
        parts = {c: model.bytes[list(chr(c - model.count).encode())] if len(model.bytes) else [model.unknown] for c in np.unique(symbols[strange]).tolist()}
        width = np.ones(len(symbols), np.int64)
        width[strange] = [len(parts[c]) for c in symbols[strange].tolist()]
        flat = np.repeat(symbols, width)
        flat[flat >= model.count] = np.concatenate([parts[c] for c in symbols[strange].tolist()])
        symbols, final = flat, np.repeat(final, width)
    ends = np.searchsorted(final, np.cumsum(sizes))
    return symbols.astype(np.int32), np.diff(ends, prepend=0)


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of the pool one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encode_texts(model: Pieces, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, without begin or end ids, and how many each text has."""
    if len(model.memory) > MEMORY_WORDS:
        model.forget()
    split = [model.words(text) if text else [] for text in texts]
    known, block, size = model.memory, [], 0
    words = list(chain.from_iterable(split))
    number = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
    missing = np.flatnonzero(number < 0).tolist()
    new = list(dict.fromkeys(words[i] for i in missing))
    starts, sizes, pools, taken = [model.start], [model.size], [model.pool], len(model.pool)
    for i, word in enumerate(new):  # blocks of about a million symbols bound the arrays
        known[word] = len(known)
        block.append(model.lead + word)
        size += len(word)
        if size > 1 << 20 or i == len(new) - 1:
            ids, count = encode_words(model, block)
            starts.append(taken + np.cumsum(count) - count)
            sizes.append(count)
            pools.append(ids)
            taken += len(ids)
            block, size = [], 0
    if new:
        model.start, model.size, model.pool = map(np.concatenate, (starts, sizes, pools))
        number[missing] = [known[words[i]] for i in missing]
    per_text = np.fromiter(map(len, split), np.int64, len(split))
    ids = gather(model.pool, model.start[number], model.size[number])
    ends = np.append(0, np.cumsum(model.size[number]))[np.cumsum(per_text)]
    if taken > MEMORY_IDS or any(len(w) > MEMORY_LENGTH for w in new):
        model.forget()
    return ids, np.diff(ends, prepend=0)


def decode_ids(model: Pieces, ids: list[int]) -> str:
    """The text of ids: spaces for their sign, without the added first one; runs of byte pieces as characters."""
    out, run = [], bytearray()
    for i in ids:
        if i in model.byte_of:
            run.append(model.byte_of[i])
            continue
        out.append(_characters(bytes(run)))
        run.clear()
        out.append(model.surface[i])
    out.append(_characters(bytes(run)))
    head = next((i for i in ids if i in model.byte_of or model.surface[i]), None)
    return "".join(out)[1 if model.prefix and head is not None and model.starts_with_space[head] else 0 :]


def _characters(run: bytes) -> str:
    """Bytes as text; every byte that belongs to no character is shown as such, one by one."""
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[: e.start].decode() + NO_CHARACTER + _characters(run[e.start + 1 :])


def decode_lists(model: Pieces, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The texts of lists of ids that lie one after the other. Lists of ordinary pieces are joined, those with other ids decoded one by one."""
    odd = np.flatnonzero(~model.ordinary[ids])
    ends = np.cumsum(sizes)
    odd = np.searchsorted(odd, ends) > np.searchsorted(odd, ends - sizes)
    flat, surface, out = ids.tolist(), model.surface, []
    for end, size, slow in zip(ends.tolist(), sizes.tolist(), odd.tolist()):
        own = flat[end - size : end]
        if slow:
            out.append(decode_ids(model, own))
        else:
            out.append("".join(map(surface.__getitem__, own))[1 if own and model.prefix and model.starts_with_space[own[0]] else 0 :])
    return out


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One model per path and Python worker."""
    return Pieces(path)


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", path: str = DEFAULT_PATH) -> DataFrame:
    """``df`` with the ids of each text as ``array<int>`` in column ``out``, which replaces one of that name.

    A null or empty text has no ids. Whole texts are encoded, each for itself, whatever their length; repeated rows get equal ids. Other columns are kept, an empty table stays empty.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        found, sizes = encode_texts(pieces(path), texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(found))

    return pin(df.withColumn(out, ids(F.col(text_col))))


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str = DEFAULT_PATH) -> DataFrame:
    """``df`` with the text of each list of ids in column ``out``, which replaces one of that name.

    A null or empty list gives the empty text, null elements are passed over, and an id outside the vocabulary is an error of the caller that ends the job.
    """

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        if flat.null_count:
            lists = pa.array([[i for i in ids or () if i is not None] for ids in lists.to_pylist()], pa.list_(pa.int32()))
            flat = lists.flatten()
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
        return pa.array(decode_lists(pieces(path), flat.to_numpy(), sizes), pa.string())

    return pin(df.withColumn(out, text(F.col(ids_col))))


def ids_text(ids: Column) -> Column:
    """Ids as decimal numbers joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
