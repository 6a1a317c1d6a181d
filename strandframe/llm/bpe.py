"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is one token that ends its encoding. An Aho-Corasick
automaton over the vocabulary lists the tokens that end at a position, longest first; the
one whose pair with the last token of the shorter prefix could never have been merged across
is stored, and back-pointers from the end of the word give the ids. No merge loop runs.

Null text counts as empty and gives no ids. A text of any length is encoded whole; the work
is linear in it, as the tokens that end at a position are bounded by the longest token.
"""

from __future__ import annotations

import json
from array import array
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import small

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_OUTSIDE = regex.compile(r"[\u0300-\U0010ffff]")
_END = "\x00"
CACHE_WORDS = 150_000  # entries of the younger generation; the older one holds as many


class _Memo(dict):
    """Entries by their text, made when first asked for; the older generation goes when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, text: str):
        made = self.old.get(text)
        if made is None:
            made = self.make(text)
        if len(text) < 256:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[text] = made
        return made


def _plain(text: str) -> bool:
    """Below U+0300 texts are composed, lower() goes by characters, and split() by white space."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return False
    return text.isascii() or _OUTSIDE.search(text) is None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class PrefixBpe:
    """Encoder and decoder of one `tokenizers` file with a BPE model and a word-end suffix."""

    def __init__(self, path: str, own: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # its normaliser and splitter, for rare scripts
        if not own:  # the library's merge loop for the words not met before
            tokenize = self.library.model.tokenize
            self.encode_piece = lambda piece: [t.id for t in tokenize(piece)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.rank: dict[int, int] = {}  # left id and right id in one key
        self.parts: dict[int, tuple[int, int, int]] = {}  # id: when made, left, right
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.rank[a << 32 | b] = n
            self.parts.setdefault(made, (n, a, b))
        self.letters = dict(enumerate(_byte_letters()))
        missing = [c for c in self.letters.values() if c not in vocab or c + self.suffix not in vocab]
        if missing:
            raise ValueError(f"the vocabulary lacks bytes: {missing}")
        self.pairs: dict[int, bool] = {}
        self.chunks, self.pieces, self.flat = _Memo(self._chunk), _Memo(self._piece), _Memo(self._flat)
        self.vocab = vocab

    @cached_property
    def automaton(self):
        """Lists, at each place, the tokens that are suffixes of what was read; longest first."""
        out = ahocorasick.Automaton()
        for text, i in sorted(self.vocab.items(), key=lambda x: x[1]):
            if not self._reachable(i):
                continue
            ends = bool(self.suffix) and text.endswith(self.suffix)
            body = text[: -len(self.suffix)] if ends else text
            if ends or not self.suffix:
                out.add_word(body + _END, (i, len(body) + 1))
            if not ends:
                out.add_word(body, (i, len(body)))
        out.make_automaton()
        return out

    def _apart(self, left: int, right: int, made: int = 1 << 62) -> bool:
        """No merge crosses the border of `left` and `right` before time `made`.

        Undoes both tokens along the border, latest merge first. Where the two border tokens
        of a moment have a merge of their own that comes before either of them grows, they
        would have been joined. On equal ranks the leftmost pair goes first.
        """
        rank, parts = self.rank, self.parts
        until_left = until_right = made
        while True:
            own = rank.get(left << 32 | right)
            if own is not None and own < until_left and own <= until_right and own != made:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                until_left, left = a[0], a[2]
            else:
                until_right, right = b[0], b[1]

    def _reachable(self, i: int) -> bool:
        """The token's own text encodes to it alone."""
        if (p := self.parts.get(i)) is None:
            return True
        return self._apart(p[1], p[2], p[0])

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece in byte letters: the program over its prefixes.

        The end mark is one more prefix; tokens with the word-end suffix are those that hold it.
        """
        if not piece:
            return []
        n = len(piece) + 1
        last, back, pairs, done = [0] * (n + 1), [0] * (n + 1), self.pairs, -1
        for end, (i, size) in self.automaton.iter(piece + _END):
            if end == done:
                continue
            end += 1
            start = end - size
            if start:
                key = last[start] << 32 | i
                fits = pairs.get(key)
                if fits is None:
                    fits = self.fits(last[start], i)
                if not fits:
                    continue
            last[end], back[end], done = i, start, end - 1
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        ids.reverse()
        return ids

    def _ids(self, word: str) -> list[int]:
        return self.encode_piece(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters))

    def _entry(self, ids: list[int]) -> tuple[int, bytes, str]:
        return len(ids), array("I", ids).tobytes(), " ".join([self.token[i] for i in ids])

    def _piece(self, piece: str) -> tuple[int, bytes, str]:
        return self._entry(self.encode_piece(piece))

    def _chunk(self, chunk: str) -> tuple[int, bytes, str]:
        """The entry of what stands between white space: one word or several."""
        words = [chunk] if chunk.isalpha() else _WORDS.findall(chunk)
        if words == [chunk]:
            return self._entry(self._ids(chunk))
        found = [self.chunks[w] for w in words]
        return sum([e[0] for e in found]), b"".join([e[1] for e in found]), " ".join([e[2] for e in found])

    def _flat(self, chunk: str) -> bytes:
        """Its ids alone."""
        words = [chunk] if chunk.isalpha() else _WORDS.findall(chunk)
        if words == [chunk]:
            return array("I", self._ids(chunk)).tobytes()
        return b"".join([self.flat[w] for w in words])

    def _parts_of(self, text: str):
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                yield self.special[part]
            elif part:
                yield part

    def entries(self, text: str) -> list[tuple[int, bytes, str]]:
        """(count, ids as little-endian bytes, decoded text) of each stretch of the text, in order."""
        out = []
        for part in [text] if "<|" not in text else self._parts_of(text):
            if isinstance(part, int):
                out.append(self._entry([part]))
            elif _plain(part):
                out += map(self.chunks.__getitem__, part.lower().split())
            else:
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [self.pieces[piece] for piece, _ in pieces]
        return out

    def id_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and _plain(text):
            return b"".join(map(self.flat.__getitem__, text.lower().split()))
        return b"".join([e[1] for e in self.entries(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.id_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens joined by a space, special ones kept: the file names no decoder."""
        return " ".join([self.token[int(i)] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, own: bool = True) -> PrefixBpe:
    """The codec of a worker, with its caches; `own` False takes the library for single words."""
    return PrefixBpe(path, own)


def encode_decode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """Columns key, ids array<int>, decoded string: every text encoded, and its ids decoded again.

    Rows stay one to one, repeated ones too; other columns of `df` are not read. The path
    of the vocabulary is a parameter, read by each worker.
    """
    path = path or default_path()

    def run(batches):
        bpe = codec(path)
        for batch in small(batches):
            ids, decoded, ends = [], [], [0]
            for t in batch.column(1).to_pylist():
                got = bpe.entries(t) if t else []
                ids.append(b"".join([e[1] for e in got]))
                decoded.append(" ".join([e[2] for e in got]))
                ends.append(ends[-1] + len(ids[-1]) // 4)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["key", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def sha_of_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
