"""Byte-pair encoding by longest matches and backtracking, and decoding by an offset table."""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHE_BYTES = 96 << 20
_LAST = float("inf")

#: Fixed values of byte-level vocabularies: how texts are cut into words, and the same for plain ASCII.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+", re.ASCII)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in itertools.count())
    return [chr(b) if b in own else next(rest) for b in range(256)]


class Vocabulary:
    """A byte-level vocabulary: token bytes by id, and merges ``(left, right) -> (rank, token)``.

    A boundary between two tokens holds if no merge reaches across it: seen from the boundary, each token is a
    chain of ever larger pieces, from its outermost byte to itself, each piece lasting until the rank of the merge that takes
    it in. Two pieces that stand at the boundary at the same time must not merge with a rank below the end of the left
    one, nor above the end of the right one (of equal pairs, the leftmost goes first).
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, before = data["model"], data.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not data.get("normalizer")
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or not plain or odd:
            raise ValueError("a byte-level BPE vocabulary without normalizer, prefix space or affixes is needed")
        value = {c: b for b, c in enumerate(byte_letters())}
        names = {i: bytes(value[c] for c in t) for t, i in model["vocab"].items()}
        self.ids = {b: i for i, b in names.items()}
        self.special = {}
        for t in data.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that reach beyond their own text are not supported")
            self.special[t["content"]] = t["id"]
            names[t["id"]] = t["content"].encode()
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        self.sizes = [len(b) for b in self.bytes]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = (bytes(value[c] for c in t) for t in (m.split(" ") if isinstance(m, str) else m))
            pair, token = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.merges.setdefault(pair, (rank, token))
            self.parts.setdefault(token, (rank, *pair))
        self.chains: tuple[dict, dict] = {}, {}
        self.table: dict[tuple[int, int], bool] = {}
        self.prefixes: list[int | None] = [None] * len(self.bytes)
        self.valid: set[int] = set()
        for token in sorted(self.ids.values(), key=lambda t: self.parts.get(t, (-1,))[0]):
            if len(self.bytes[token]) == 1 or self._made_whole(token):
                self.valid.add(token)
        self.machine = ahocorasick.Automaton()
        for token in self.valid:
            b = self.bytes[token]
            self.machine.add_word(b.decode("latin-1"), (len(b), token))
        self.machine.make_automaton()
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _made_whole(self, token: int) -> bool:
        """Merging the token's own bytes gives the token: its halves do, and meet in no other way."""
        if token not in self.parts:
            return False
        rank, left, right = self.parts[token]
        return left in self.valid and right in self.valid and self._holds(left, right, rank)

    def _chain(self, token: int, side: int) -> list[tuple[int, float]]:
        """Pieces of ``token`` at its right (0: it stands left of the boundary) or left end (1), and the rank that ends each."""
        found = self.chains[side].get(token)
        if found is None:
            found, end = [], _LAST
            while True:
                found.append((token, end))
                if token not in self.parts:
                    break
                end, *halves = self.parts[token]
                token = halves[1 - side]
            found.reverse()
            self.chains[side][found[-1][0]] = found
        return found

    def _holds(self, left: int, right: int, below: float = _LAST) -> bool:
        a, b = self._chain(left, 0), self._chain(right, 1)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            rank = self.merges.get((x, y), (_LAST, 0))[0]
            if rank < below and rank < x_end and rank <= y_end:
                return False
            if x_end <= y_end:
                i += 1
            else:
                j += 1
            if i == len(a) or j == len(b):
                return True

    def compatible(self, left: int, right: int) -> bool:
        """The pair table's entry, worked out when it is first asked for."""
        pair = (left, right)
        found = self.table.get(pair)
        if found is None:
            if len(self.table) >= 1 << 20:
                self.table.clear()
            found = self.table[pair] = self._holds(left, right)
        return found

    def _shorter(self, token: int) -> int:
        """The longest token that begins this one; -1 if none does."""
        found = self.prefixes[token]
        if found is None:
            b = self.bytes[token]
            begins = (self.ids.get(b[:n]) for n in range(len(b) - 1, 0, -1))
            found = self.prefixes[token] = next((t for t in begins if t in self.valid), -1)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, as merging by rank gives them.

        The longest token at a place is tried first, then its shorter beginnings. A place from which nothing fits is never
        tried again, so the work is linear in the word.
        """
        found = self.ids.get(word)
        if found in self.valid:
            return [found]
        longest, sizes, table = [0] * len(word), self.sizes, self.table
        for end, (size, token) in self.machine.iter(word.decode("latin-1")):
            longest[end + 1 - size] = token  # of those that begin at a place, the longest ends last
        dead, out, at, last = set(), [], 0, -1
        token = longest[0] if word else -1
        while at < len(word):
            end = at + sizes[token]
            if end not in dead:
                holds = last < 0 or table.get((last, token))
                if holds is None:
                    holds = self.compatible(last, token)
                if holds:
                    out.append(token)
                    at, last = end, token
                    token = longest[at] if at < len(word) else -1
                    continue
            token = self._shorter(token)
            if token < 0:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids, cut from all tokens' bytes by offsets; unknown ids give nothing, broken characters U+FFFD."""
        ids = ids[(ids >= 0) & (ids < len(self.bytes))]
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The file as read, one a worker process."""
    return Vocabulary(path)


class _Known(dict):
    """Ids by word; a word not seen yet is encoded when it is asked for."""

    def __init__(self, own: Vocabulary):
        super().__init__()
        self.own, self.held = own, 0

    def __missing__(self, word: str) -> list[int]:
        found = self.own.encode_word(word.encode())
        if len(word) <= 256:
            self[word] = found
            self.held += 8 * len(found) + 2 * len(word) + 250
        return found


class Encoder:
    """Ids of whole texts. Words seen are kept up to ``_CACHE_BYTES``, then all are forgotten."""

    def __init__(self, path: str):
        import regex

        self.own, self.words, self.seen = vocabulary(path), regex.compile(_WORDS), set()
        self.known = _Known(self.own)

    def split(self, text: str) -> list[str]:
        """The words of a text. Characters newer than this interpreter's tables, on which libraries differ, are left to the tokenizer's own."""
        if text.isascii():
            return _ASCII_WORDS.findall(text)
        new = set(text) - self.seen
        if any(unicodedata.category(c) == "Cn" for c in new):
            from tokenizers import pre_tokenizers

            cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in cut]
        self.seen |= new
        return self.words.findall(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.known.held > _CACHE_BYTES:
            self.known = _Known(self.own)
        if not self.own.cut or not self.own.cut.search(text):
            return list(itertools.chain.from_iterable(map(self.known.__getitem__, self.split(text))))
        out, at = [], 0
        for m in self.own.cut.finditer(text):
            out += itertools.chain.from_iterable(map(self.known.__getitem__, self.split(text[at : m.start()])))
            out.append(self.own.special[m.group()])
            at = m.end()
        return out + list(itertools.chain.from_iterable(map(self.known.__getitem__, self.split(text[at:]))))


#: Texts of a batch are encoded in parts of about so many characters, so what a task holds is a part and the longest text.
_PART = 4 << 20


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts, at, flat, ends = batch.column(1), 0, array("i"), [0]
            for i, text in enumerate(texts):
                flat.extend(encoder.encode((text.as_py() or b"").decode("utf-8", "replace")))
                ends.append(len(flat))
                if len(flat) >= _PART or i + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lists)), lists], names=["id", "ids"])
                    at, flat, ends = i + 1, array("i"), [0]

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            at, out, held = 0, [], 0
            for i, ids in enumerate(batch.column(1)):
                found = None if not ids.is_valid else own.decode(ids.values.drop_null().to_numpy(zero_copy_only=False))
                out.append(found)
                held += len(found or "")
                if held >= _PART or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(out)) for c in batch.columns[:2]], pa.array(out, pa.string())], names=["id", "ids", "decoded"])
                    at, out, held = i + 1, [], 0

    return run


def encode_texts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every whole text, null ones as empty: the ids that the vocabulary file ``tokenizer`` gives.

    Each row stands for itself, so repeated rows, equal and null ids stay. Special tokens written out in a text are
    found as the file says; none are added. Invalid UTF-8 counts as U+FFFD.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(tokenizer or default_tokenizer()), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids_col, decoded``: the text of each list of ids, special tokens included; null for null. Ids that are null or unknown give nothing."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_decoded(tokenizer or default_tokenizer()), f"id {kind}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")
