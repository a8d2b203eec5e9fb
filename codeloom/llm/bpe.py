"""BPE encoding by backtracking over longest matches; decoding from an offset table.

A word's encoding is found left to right. An Aho-Corasick automaton over all
tokens gives the longest token at every position of the word. A token may
follow another if the two, merged in rank order, would not have been merged
across their border; that is decided from the merge table alone and
remembered per pair. If a token does not fit, the next shorter prefix token
is tried; if none fits, the encoder steps back and marks the position as a
dead end. Each position dies at most once, so the work is linear in the word,
and the result is the sequence that merging by rank gives.

Decoding copies slices of one buffer that holds all tokens' text, at offsets looked up by id.

The tokenizer file gives the vocabulary, the merges and the special tokens; it is read, never trained
or copied. The normaliser (NFC, white space, lower case per code point), the word pattern and the byte
alphabet are those the file names; other kinds raise an error. A file without a decoder joins
the tokens' text by single spaces.

Defined results
* null or empty text: no ids, an empty decoded text (its hash is that of the empty string).
* special tokens' strings inside a text become their ids, as the file's added tokens ask for.
* null doc_id and repeated rows: each row gets its own result. Empty table: empty result.
* extra columns are ignored by the query; ``encode_documents`` keeps only doc_id and its own columns.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries a worker keeps of each of its two memos (chunks, words); a full memo is emptied.
MEMO = 250_000


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the rest counts up from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(own))
    return out


class WordBpe:
    """A tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("only BPE files without prefix, unknown token and byte fallback are read")
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError("only NFC, white space, lower case and a word pattern are read")
        if level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"] or spec.get("decoder"):
            raise ValueError("only plain byte level files without a decoder are read")
        self.end = model.get("end_of_word_suffix") or ""
        #: White space of the pattern dialect is the Unicode property; the module's own \s also takes U+001C to U+001F.
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(pattern)
        self.blank = regex.compile(r"\p{White_Space}+")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        alphabet = byte_alphabet()
        self.alphabet = [alphabet[b] for b in range(256)]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._tables(vocab, merges)
        self._offsets(vocab)
        self.matcher = ahocorasick.Automaton()
        for rank, s in enumerate(self.symbols_of):
            self.matcher.add_word(s, (rank, len(s)))
        self.matcher.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def _tables(self, vocab: dict[str, int], merges: list) -> None:
        """Tokens in merge order (ranks). A word is matched as a string of symbols: bytes, and last bytes shifted by U+1000."""
        bytes_of = {c: chr(i) for i, c in enumerate(self.alphabet)}
        ends_of = {c + self.end: chr(0x1000 + i) for i, c in enumerate(self.alphabet)}
        base = {**bytes_of, **ends_of} if self.end else bytes_of
        self.symbols_of, self.id_of, self.left, self.right = [], [], [], []
        rank: dict[str, int] = {}
        for token, symbol in base.items():
            rank[token] = len(self.id_of)
            self.symbols_of.append(symbol)
            self.id_of.append(vocab[token])
            self.left.append(rank[token])
            self.right.append(rank[token])
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            token = a + b
            if token in rank or token not in vocab:
                raise ValueError(f"the merge of {a!r} and {b!r} is not a new token")
            rank[token] = len(self.id_of)
            self.merged[rank[a], rank[b]] = rank[token]
            self.symbols_of.append(self.symbols_of[rank[a]] + self.symbols_of[rank[b]])
            self.id_of.append(vocab[token])
            self.left.append(rank[a])
            self.right.append(rank[b])
        by_symbols = {s: i for i, s in enumerate(self.symbols_of)}
        if len(by_symbols) != len(self.symbols_of):
            raise ValueError("two tokens have the same symbols")
        self.shorter = [-1] * len(self.symbols_of)
        for i, s in enumerate(self.symbols_of):
            for n in range(len(s) - 1, 0, -1):
                if (p := by_symbols.get(s[:n])) is not None:
                    self.shorter[i] = p
                    break

    def _offsets(self, vocab: dict[str, int]) -> None:
        """All tokens' text end to end, and where each id begins; ids without a token are empty."""
        text = dict(vocab) | self.special
        by_id = {i: t for t, i in text.items()}
        parts, at, self.offsets = [], 0, [0]
        for i in range(max(by_id) + 1):
            parts.append(by_id.get(i, ""))
            at += len(parts[-1])
            self.offsets.append(at)
        self.buffer = "".join(parts)

    def token(self, i: int) -> str:
        return self.buffer[self.offsets[i] : self.offsets[i + 1]]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.buffer[self.offsets[i] : self.offsets[i + 1]] for i in ids])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a border between tokens a and b.

        Undo merges from the latest back. At each moment the two tokens that touch the border must not merge
        earlier than the moment at which either of them is used up.
        """
        key = (a, b)
        if (known := self.fits.get(key)) is not None:
            return known
        last, ok = len(self.id_of), True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < last:
                ok = False
                break
            # undo the later of the two; on equal ranks the right one, as pairs merge from the left
            if a > b:
                if self.right[a] == a:
                    break
                last, a = a, self.right[a]
            else:
                if self.left[b] == b:
                    break
                last, b = b + 1, self.left[b]
        if len(self.fits) > 4 * MEMO:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        raw = word.encode("utf-8")
        if self.end:
            symbols = "".join(map(chr, raw[:-1])) + chr(0x1000 + raw[-1])
        else:
            symbols = "".join(map(chr, raw))
        n = len(symbols)
        longest = [-1] * n
        size = [0] * n
        for stop, (rank, length) in self.matcher.iter(symbols):
            begin = stop - length + 1
            if length > size[begin]:
                longest[begin], size[begin] = rank, length
        alive = [True] * (n + 1)
        path: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            stop = at + len(self.symbols_of[token])
            if alive[stop] and (not path or self.compatible(path[-1], token)):
                path.append(token)
                at = stop
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                alive[at] = False
                token = path.pop()
                at -= len(self.symbols_of[token])
        return [self.id_of[t] for t in path]

    def _piece(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text) of a run without white space."""
        found = []
        for word in self.pattern.findall(chunk):
            piece = self.words.get(word)
            if piece is None:
                piece = self._piece(self.encode_word(word))
                if len(word) <= 64:
                    if len(self.words) >= MEMO:
                        self.words.clear()
                    self.words[word] = piece
            found.append(piece)
        piece = (sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])) if len(found) != 1 else found[0]
        if len(chunk) <= 64:
            if len(self.chunks) >= MEMO:
                self.chunks.clear()
            self.chunks[chunk] = piece
        return piece

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes by single code points: no final sigma
                text = text.replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """The pieces of a whole text, in order."""
        if self.special_at is not None and "<" in text and (parts := self._split_special(text)):
            return [p for part in parts for p in ([self._piece([part])] if isinstance(part, int) else self._plain(part))]
        return self._plain(text)

    def _split_special(self, text: str) -> list:
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [text[at : m.start()], self.special[m.group()]]
            at = m.end()
        return [*out, text[at:]] if out else []

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        text = self.normalize(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = [c for c in self.blank.split(text) if c]
        else:
            chunks = text.split()
        get, make = self.chunks.get, self._chunk
        return [p for c in chunks if (p := get(c) or make(c))[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.pieces(text or "") for i in p[1].split(" ")]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _each(docs: DataFrame, path: str, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1)
            rows = [row(bpe, texts[i].as_py() or "") for i in range(len(texts))]
            cols = [pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the encoding itself and its round trip."""

    def row(bpe: WordBpe, text: str) -> tuple:
        ids = bpe.encode(text)
        return ids, bpe.decode(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = [row(bpe, x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, without shipping the ids."""

    def row(bpe: WordBpe, text: str) -> tuple:
        pieces = bpe.pieces(text)
        ids = " ".join([p[1] for p in pieces])
        decoded = " ".join([p[2] for p in pieces])
        return (
            sum([p[0] for p in pieces]),
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )

    return _each(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def default_path() -> str:
    """Where the installed vocabulary file lies; other files are given by path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

