"""BPE encoding by dynamic programming over prefixes, and decoding.

Of all token sequences that spell a prefix of a word, byte-pair merging yields one, so its last token is unique. For each
prefix the automaton of the vocabulary names all tokens that end there; the one whose predecessor (the last token of the
prefix before it) stays apart from it under the merges is the last token. Following these back-pointers from the end
gives the ids. The work is linear in the word's length times the tokens that end at a place; no queue of merges is kept.

Words are independent, so each worker remembers the ids of words it has met (bounded by CACHE_WORDS), and which pairs of tokens
stay apart (bounded by CACHE_PAIRS, whatever the words are).

Cases. Null or empty text: no ids, the digests of empty strings. Texts of any length are encoded whole. Strings of special tokens in a text
become those tokens, as the tokenizers library does. Equal rows are returned each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import arrow_rows, no_null_text

CACHE_WORDS, CACHE_PAIRS = 400_000, 500_000
_NEVER = 1 << 60

_RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Encoder(dict):
    """Encodes as a tokenizers file of kind BPE with word ends. As a dict: word to its ids in little-endian bytes."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        end = model["end_of_word_suffix"]
        self.strings = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.assigned: set[str] = set()
        self.spec, self.library = spec, None
        # a symbol is a byte, or a byte that ends its word (plus 256)
        code = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]

        def symbols(s: str) -> str:
            body, last = (s[: -len(end)], 256) if s.endswith(end) and len(s) > len(end) else (s, 0)
            return "".join(chr(code[c]) for c in body[:-1]) + chr(code[body[-1]] + last)

        self.length, self.halves, self.rank, self.merge = {}, {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = r
            if i not in self.halves:
                self.halves[i], self.rank[i] = (vocab[a], vocab[b]), r
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            text = symbols(s)
            self.length[i] = len(text)
            if len(text) == 1 or i in self.halves and self._reached(i):
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}

    def _stays_apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge before rank until joins a's right end with b's left end, when a and b are made side by side.

        Undoes the later of the two tokens' last merges again and again; at each step a merge of the pieces that face each
        other would take place if it came before the merges that use up either piece. Merges of one rank go from left to right.
        """
        a_gone = b_gone = until
        while True:
            r = self.merge.get((a, b), _NEVER)
            if r < a_gone and (r < b_gone or r == b_gone < until):
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb or ra == rb:
                a, a_gone = self.halves[a][1], ra
                if ra == rb:
                    b, b_gone = self.halves[b][0], rb
            else:
                b, b_gone = self.halves[b][0], rb

    def _reached(self, i: int) -> bool:
        """Whether merging the token's own letters yields the token."""
        a, b = self.halves[i]
        r = self.rank[i]
        return self.rank.get(a, -1) < r and self.rank.get(b, -1) < r and (a not in self.halves or self._reached(a)) and (b not in self.halves or self._reached(b)) and self._stays_apart(a, b, r)

    def ids_of_word(self, data: bytes) -> list[int]:
        """Ids of one word's bytes."""
        n = len(data)
        last = [-1] * (n + 1)
        text = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        length, apart = self.length, self.apart
        for place, token in self.automaton.iter(text):
            stop = place + 1
            if last[stop] >= 0:
                continue
            start = stop - length[token]
            if start == 0:
                last[stop] = token
                continue
            before = last[start]
            ok = apart.get((before, token))
            if ok is None:
                if len(apart) >= CACHE_PAIRS:
                    apart.clear()
                ok = apart[before, token] = self._stays_apart(before, token)
            if ok:
                last[stop] = token
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.ids_of_word(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            return b"".join(map(self.__getitem__, self.words.findall(text.lower())))
        for c in set(text) - self.assigned:
            if unicodedata.category(c) == "Cn":
                return self._unassigned(text)
            self.assigned.add(c)
        return b"".join(map(self.__getitem__, self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())))

    def _unassigned(self, text: str) -> bytes:
        """With characters newer than Python's Unicode tables the library's own tables normalise the text and part its words."""
        if self.library is None:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_str(json.dumps(self.spec))
        text = self.library.normalizer.normalize_str(text)
        return b"".join(self[text[a:b]] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(self.special[x] if x in self.special else self._plain(x) for x in self.at_special.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """Without a decoder the library joins the tokens' strings with spaces."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a process."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(json.loads(spec))
    return _encoders[key]


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver: its size (about 2 MB) doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text)."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def rows(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        e = encoder(spec.value)
        for doc_ids, texts in batches:
            out = []
            for i, text in zip(doc_ids, texts):
                ids = e.encode(text)
                out.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
            yield out

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null_text("text")), _RESULT, rows)
