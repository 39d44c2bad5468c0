"""Operator 5: BPE encoding and decoding, exact to the tokenizers library.

A text is encoded by tree concatenation. It is cut in leaves of ``LEAF`` characters, wherever these end.
The words of all leaves at hand are encoded in one call of the library, which takes as many threads as
the task has cores; a worker keeps each distinct word's ids. Then halves are joined, two by two, up to the
whole text: the words around the join are encoded anew, in windows that grow until they begin with the
left half's ids of the window's first word and end with the right half's of its last. Tokens don't cross
white space, so what lies before and after can't change and the result is exact.

A run of over ``LONG_PIECE`` characters without a space has no place inside to agree on. There the tree
works on tokens: its leaves are encoded in parallel by the merges alone, and windows of tokens grow around
each join. Merges make every token in just one way, so a sequence is the encoding of its text if all its
adjacent pairs are; agreement at both ends is exact there too.

Byte-level vocabularies, whose tokens hold the space before a word, and operators that encode and go on
(3 and 8) use ``encode_many``: it cuts at spaces and encodes each distinct piece once a worker.

Nulls count as empty texts; empty texts have no ids; an empty table gives an empty one. A null id stays
null. Columns of the input other than the id and the text are not read. Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blocks, claim, tune

#: Characters of a leaf of a text; words on either side that the first window at a join takes.
LEAF, FIRST_WINDOW = 1024, 4
#: Pieces without a space of more characters have trees of tokens, from leaves of this length.
LONG_PIECE, TOKEN_LEAF = 2048, 512
#: New words that stand in one text for the library.
WORDS_AT_ONCE = 4096
#: A worker forgets its pieces beyond this number; this bounds memory and changes no result.
MOST_PIECES = 500_000
#: Characters of a text that are split at once.
SEGMENT = 1 << 20

#: Marks that may follow a word; a run of them is one pre-token, as no letter comes after.
_ENDS = ".,;:!?)]}|%$&*#-"

_SPACE_THEN_WORD = re.compile(r" (?=\S)")


def _bytes_of_names() -> dict[str, int]:
    """The byte alphabet of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Fixed: the characters that Unicode calls white space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run that has a tree of its own, with the white space before it: a word may begin with that.
_UNSPLIT = re.compile(rf"[{_WHITE}]?[^{_WHITE}]{{{LONG_PIECE + 1},}}")


def _cores() -> int:
    """Cores of this task, for the library's threads."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.cpus() if task else 1


class _Leaf:
    """Words ``low`` to ``high`` of a part's characters from ``begin`` to ``end``. Its first and last word may go on in other leaves."""

    def __init__(self, part: str, begin: int, end: int, codes_of):
        self.begin, self.end, self.starts, self.ends = begin, end, begin == 0, end == len(part)
        self.words = part[begin:end].replace("\n", " ").split(" ")
        self.codes = list(map(codes_of, self.words))
        self.low, self.high = 0, len(self.words)

    def last_word(self, k: int) -> tuple[int, int] | None:
        """Number and first character of a whole word at least k words before the last; None if there is none."""
        i = len(self.words) - 1 - k
        while i >= 0 and not self.words[i]:
            i -= 1
        if i < self.low or i >= self.high or i == 0 and not self.starts:
            return None
        return i, self.end - sum(map(len, self.words[i:])) - (len(self.words) - 1 - i)

    def first_word(self, k: int) -> tuple[int, int] | None:
        """Number of a whole word at least k words after the first, and the place after it."""
        i, n = k, len(self.words)
        while i < n and not self.words[i]:
            i += 1
        if i < self.low or i >= self.high or i == n - 1 and not self.ends:
            return None
        return i, self.begin + sum(map(len, self.words[: i + 1])) + i


class _Half(NamedTuple):
    """The ids of a part's characters from ``begin`` to ``end``: leaves, and ids between them."""

    begin: int
    end: int
    items: list[_Leaf | list[int]]


class _Codes(dict):
    """Numbers pieces as they are first seen. A piece that may not stand alone gets -1."""

    def __init__(self, lead: str, pieces: list[str], strict: bool):
        super().__init__()
        self.lead, self.pieces, self.strict = lead, pieces, strict

    def __missing__(self, word: str) -> int:
        if self.strict and (not word or word[0].isspace()):
            self[word] = -1
            return -1
        self[word] = code = len(self.pieces)
        self.pieces.append(self.lead + word)
        return code


class Encoder:
    """Encodes texts as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if _cores() > 1 else "false")
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Joins made by windows, windows that had to grow, and joins that took both halves whole.
        self.joins = self.grown = self.whole = 0
        spec = json.loads(self.tokenizer.to_str())
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        #: With a word suffix, white space is dropped before the merges; else a space belongs to the word that follows.
        self.drops_space = bool(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.size = self.tokenizer.get_vocab_size()
        self._models: tuple | None = None
        self._quick = None
        self._names: list[str] | None = None
        self.forget()

    def forget(self) -> None:
        self.pieces: list[str] = []
        self.bare = _Codes("", self.pieces, False)
        self.spaced = _Codes("", self.pieces, False) if self.drops_space else _Codes(" ", self.pieces, True)
        self.flat, self.starts, self.known = array("I"), array("q", [0]), 0

    # -- cutting a text where no token crosses

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT:
            found = _SPACE_THEN_WORD.search(text, at + SEGMENT)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _codes(self, text: str) -> list[int]:
        if self.drops_space:
            return list(map(self.bare.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = text.split(" ")
        codes = [self.bare[first]]
        codes.extend(map(self.spaced.__getitem__, rest))
        if -1 in codes:  # spaces in a row or at the end: cut only before a word
            first, *rest = _SPACE_THEN_WORD.split(text)
            codes = [self.bare[first]]
            codes.extend(map(self.spaced.__getitem__, rest))
        return codes

    # -- encoding new pieces

    def _plain(self, piece: str) -> tuple[str, str] | None:
        """A word of Latin letters and the punctuation after it, which are a pre-token each; None for other pieces."""
        word = piece.rstrip(_ENDS)
        letters = word[1:] if word[:1] == " " else word
        if len(piece) > LONG_PIECE or not letters.isalpha() or max(letters) > "\xff":
            return None
        return (word.lower() if self.drops_space else word), piece[len(word) :]

    def _learn(self, by_words: bool = False) -> None:
        """Encode the new pieces; ``by_words``: by the library alone."""
        new = self.pieces[self.known :]
        if not new:
            return
        if by_words:
            return self._learn_words(new)
        merger, encoded = self._merger(), {}
        plain = {i: x for i, x in enumerate(map(self._plain, new)) if x} if merger else {}
        if plain:
            end, ids_of = "\x01" if self.suffix else "", self._ids_of_rank
            text = "".join([f"{w}{end}\n" + (f"{t}{end}\n\n" if t else "\n") for w, t in plain.values()])
            ids = merger.encode_to_numpy(text, disallowed_special=())
            line = ids == self._line
            keep = ~line
            ends = np.flatnonzero(line[1:] & line[:-1]) + 1  # two line ends close a piece
            closed = np.cumsum(keep)[ends]
            encoded_flat, lengths = ids_of[ids[keep]], np.diff(closed, prepend=0)
        other = [i for i in range(len(new)) if i not in plain]
        for i, e in zip(rest := [i for i in other if len(new[i]) <= LONG_PIECE], self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False), strict=True):
            encoded[i] = e.ids
        for i in other:
            if i not in encoded:
                encoded[i] = self._long(new[i])
        flat = np.concatenate([encoded_flat if plain else np.zeros(0, np.uint32), *(np.array(encoded[i], np.uint32) for i in other)])
        size = np.zeros(len(new), np.int64)
        at = np.zeros(len(new), np.int64)
        order = np.array([*plain, *other], np.int64)
        size[order] = np.concatenate([lengths if plain else np.zeros(0, np.int64), np.array([len(encoded[i]) for i in other], np.int64)])
        at[order] = np.cumsum(size[order]) - size[order]
        ends = np.cumsum(size)
        base = len(self.flat)
        self.flat.frombytes(flat[np.repeat(at - (ends - size), size) + np.arange(len(flat))].astype(np.uint32).tobytes())
        self.starts.frombytes((base + ends).astype(np.int64).tobytes())
        self.known = len(self.pieces)

    def _learn_words(self, new: list[str]) -> None:
        """Encode new pieces as the words of long texts, by the library; tokens belong to the piece in which they begin."""
        long = [i for i, x in enumerate(new) if len(x) > LONG_PIECE]
        texts, places = [], []
        for k in range(0, len(new), WORDS_AT_ONCE):
            some = ["" if len(x) > LONG_PIECE else x for x in new[k : k + WORDS_AT_ONCE]]
            texts.append(" ".join(some))
            places.append(np.cumsum([0, *(len(x) + 1 for x in some)])[:-1])
        ids, owner = [], []
        for k, (e, starts) in enumerate(zip(self.tokenizer.encode_batch(texts, add_special_tokens=False), places, strict=True)):
            begin = np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            ids.append(np.array(e.ids, np.uint32))
            owner.append(k * WORDS_AT_ONCE + np.searchsorted(starts, begin, side="right") - 1)
        for i in long:
            own = self._long(new[i])
            ids.append(np.array(own, np.uint32))
            owner.append(np.full(len(own), i, np.int64))
        flat, at = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(at, kind="stable")
        ends = len(self.flat) + np.cumsum(np.bincount(at, minlength=len(new)))
        self.flat.frombytes(flat[order].astype(np.uint32).tobytes())
        self.starts.frombytes(ends.astype(np.int64).tobytes())
        self.known = len(self.pieces)

    def _merger(self):
        """A quicker engine for single pre-tokens: it merges whatever makes a token, by the tokens' order.

        That equals the library's merges where each token is made by one merge and encodes to itself; tokens
        that don't encode to themselves can't come out of either. Else there is none, and the library does it all.
        """
        if self._quick is None:
            import tiktoken

            inner, last = self._raw()
            model = self._spec
            made = {a + b: i for i, (a, b) in enumerate(self._merges)}
            self._quick = False
            if len(made) == len(self._merges):
                to_byte = _bytes_of_names()
                names = list(model["vocab"])
                cut = len(self.suffix)
                ends = [bool(cut and n.endswith(self.suffix)) for n in names]
                bare = [n[:-cut] if e else n for n, e in zip(names, ends, strict=True)]
                for kind, of in ((False, inner), (True, last)):
                    some = [i for i, e in enumerate(ends) if e == kind]
                    for i, x in zip(some, of.encode_batch_fast([bare[i] for i in some], add_special_tokens=False), strict=True):
                        if x.ids != [model["vocab"][names[i]]]:
                            made.pop(names[i], None)
                ranks = {bytes([b]): 10_000_000 + b for b in range(256)}
                real = {}
                for name, x, e in zip(names, bare, ends, strict=True):
                    if not all(c in to_byte for c in x):
                        continue
                    raw = bytes(to_byte[c] for c in x)
                    if name in made:
                        rank = 1000 + made[name]
                    elif len(raw) == 1:
                        rank = raw[0] if e else 10_000_000 + raw[0]
                    else:
                        continue
                    if (b"\x01" in raw or b"\n" in raw) and len(raw) > 1:
                        continue
                    ranks[raw + b"\x01" if e else raw], real[rank] = rank, model["vocab"][name]
                dense = {r: i for i, r in enumerate(sorted(ranks.values()))}
                self._ids_of_rank = np.array([real.get(r, 0) for r in sorted(dense)], np.uint32)
                self._line = dense[10_000_010]
                self._quick = tiktoken.Encoding("pieces", pat_str=r"[^\n]+|\n", mergeable_ranks={k: dense[r] for k, r in ranks.items()}, special_tokens={})
            self._models = self._spec = self._merges = None  # made again when a long piece comes
        return self._quick

    def normalised(self, text: str) -> str:
        return text if self.tokenizer.normalizer is None else self.tokenizer.normalizer.normalize_str(text)

    def _long(self, piece: str) -> list[int]:
        return self._unsplit(self.normalised(piece))

    def _unsplit(self, run: str) -> list[int]:
        ids: list[int] = []
        for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(run):
            ids += self.tree(part)
        return ids

    def _raw(self):
        """The merges alone, for parts of a word and for its last part; the names of all ids."""
        if self._models is None:
            from tokenizers import Tokenizer
            from tokenizers.models import BPE

            self._spec = model = json.loads(open(self.path, encoding="utf-8").read())["model"]
            self._merges = merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            inner = Tokenizer(BPE(vocab=model["vocab"], merges=merges))
            last = Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)) if self.suffix else inner
            self._models = inner, last
        return self._models

    def tree(self, part: str, leaf: int = TOKEN_LEAF) -> list[int]:
        """Ids of one pre-token (in the tokenizer's byte alphabet), by tree concatenation."""
        inner, last = self._raw()
        names, cut = self.names, len(self.suffix)
        if not part:
            return []

        def spelled(ids: list[int]) -> str:
            return "".join([n[:-cut] if cut and n.endswith(self.suffix) else n for n in map(names.__getitem__, ids)])

        def encode(text: str, ends: bool) -> list[int]:
            return (last if ends else inner).encode(text, add_special_tokens=False).ids

        def join(a: list[int], b: list[int], ends: bool) -> list[int]:
            k = 4
            while True:
                left, right = a[-k:], b[:k]
                whole_a, whole_b = len(left) == len(a), len(right) == len(b)
                out = encode(spelled(left + right), ends and whole_b)
                if (whole_a or out[:2] == left[:2]) and (whole_b or out[-2:] == right[-2:]):
                    return (a if whole_a else a[:-k])[: 0 if whole_a else None] + out + (b[k:] if not whole_b else [])
                k *= 2

        texts = [part[i : i + leaf] for i in range(0, len(part), leaf)]
        level = [e.ids for e in inner.encode_batch(texts[:-1], add_special_tokens=False)] + [encode(texts[-1], True)]
        while len(level) > 1:
            level = [join(level[i], level[i + 1], i + 2 >= len(level)) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    # -- whole texts by trees of their halves

    def _ids(self, code: int) -> list[int]:
        return self.flat[self.starts[code] : self.starts[code + 1]].tolist()

    def _join(self, part: str, left: _Half, right: _Half) -> _Half:
        """Two halves that stand next to each other in ``part`` as one."""
        self.joins += 1
        a, b, words = left.items[-1], right.items[0], FIRST_WINDOW
        while (first := a.last_word(words)) and (last := b.first_word(words)):
            window = self.tokenizer.encode(part[first[1] : last[1]], add_special_tokens=False).ids
            head, tail = self._ids(a.codes[first[0]]), self._ids(b.codes[last[0]])
            cut = len(window) - len(tail)
            if window[: len(head)] == head and window[cut:] == tail:
                a.high, b.low = first[0], last[0]
                return _Half(left.begin, right.end, [*left.items, window[:cut], *right.items])
            self.grown += 1
            words *= 2
        self.whole += 1  # the windows have grown to the halves' ends
        both = _Leaf(part, left.begin, right.end, self.bare.__getitem__)
        self._learn(by_words=True)
        return _Half(left.begin, right.end, [both])

    def encode_trees(self, texts: list[str | None], leaf: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's, by tree concatenation."""
        if not self.drops_space:
            return self.encode_many(texts)
        if len(self.pieces) > MOST_PIECES:
            self.forget()
        leaf = leaf or LEAF
        plans: list[list] = []  # for each text: codes, or a part and its leaves

        def grow(plan: list, part: str) -> None:
            if part:
                plan.append((part, [_Half(k, min(k + leaf, len(part)), [_Leaf(part, k, min(k + leaf, len(part)), self.bare.__getitem__)]) for k in range(0, len(part), leaf)]))

        for text in texts:
            plan: list = []
            plans.append(plan)
            for own in (self.special_re.split(text) if self.special_re is not None and "<|" in text else [text]) if text else []:
                if own in self.special:
                    plan.append([-2 - self.special[own]])
                    continue
                at = 0
                for run in _UNSPLIT.finditer(own):
                    grow(plan, own[at : run.start()])
                    plan.append([self.bare[run[0].strip(_WHITE_SPACE)]])
                    at = run.end()
                grow(plan, own[at:])
        self._learn(by_words=True)
        held: list[int] = []
        sizes: list[tuple[int, int]] = []
        for i, plan in enumerate(plans):
            before = len(held)
            for step in plan:
                if isinstance(step, list):
                    held += step
                    continue
                part, level = step
                while len(level) > 1:
                    level = [self._join(part, level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
                for item in level[0].items:
                    held += [-2 - t for t in item] if isinstance(item, list) else item.codes[item.low : item.high]
            sizes.append((i, len(held) - before))
        counts = np.zeros(len(texts), np.int64)
        return self._gather(held, sizes, counts), counts

    def _gather(self, held: list[int], sizes: list[tuple[int, int]], counts: np.ndarray) -> np.ndarray:
        """The ids of codes (-2 - id stands for an id); ``sizes`` says how many codes each text has, and its ids are counted."""
        codes = np.array(held, np.int64)
        flat, starts = np.frombuffer(self.flat, np.uint32).copy() if len(self.flat) else np.zeros(0, np.uint32), np.array(self.starts, np.int64)
        extra = np.flatnonzero(codes < -1)
        if len(extra):  # these stand behind the known pieces
            flat = np.concatenate([flat, (-2 - codes[extra]).astype(np.uint32)])
            starts = np.concatenate([starts, starts[-1] + 1 + np.arange(len(extra))])
            codes[extra] = self.known + np.arange(len(extra))
        n = starts[codes + 1] - starts[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        at = 0
        for i, size in sizes:
            counts[i] += ends[at + size] - ends[at]
            at += size
        return ids

    # -- whole texts by their pieces

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        if len(self.pieces) > MOST_PIECES:
            self.forget()
        out, counts = [], np.zeros(len(texts), np.int64)
        held: list[int] = []  # codes; -2 - id stands for a special token's id
        sizes: list[int] = []

        def flush() -> None:
            self._learn()
            out.append(self._gather(held, sizes, counts))
            held.clear()
            sizes.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.special_re is not None and "<|" in text:
                parts = self.special_re.split(text)
            else:
                parts = [text]
            for part in parts:
                if part in self.special:
                    held.append(-2 - self.special[part])
                    sizes.append((i, 1))
                elif part:
                    for segment in self._segments(part):
                        codes = self._codes(segment)
                        held.extend(codes)
                        sizes.append((i, len(codes)))
                        if len(held) > SEGMENT:
                            flush()
        flush()
        return np.concatenate(out), counts

    @property
    def names(self) -> list[str]:
        if self._names is None:
            self._names = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        return self._names

    def decode(self, ids: list[int]) -> str:
        """As ``decode(ids, skip_special_tokens=False)``: without a decoder, the tokens' names joined by spaces."""
        if self.tokenizer.decoder is None:
            return " ".join(map(self.names.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    claim("bpe", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: its id, n_tokens, digests of the ids and of the decoded text; with ``with_ids`` also both themselves."""
    tune(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for block in blocks(batches, "text"):
            ids, counts = enc.encode_trees(block.column(1).to_pylist())
            rows: dict[str, list] = {"ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            ends = np.cumsum(counts)
            for a, b in zip(ends - counts, ends, strict=True):
                own = ids[a:b]
                text = enc.decode(own.tolist())
                rows["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    rows["ids"].append(own.astype(np.int32))
                    rows["decoded"].append(text)
            columns = [block.column(0), pa.array(counts, pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
            if with_ids:
                columns += [pa.array(rows["ids"], pa.list_(pa.int32())), pa.array(rows["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in schema.split(", ")])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
