"""Byte-level BPE with states of shared prefixes kept in a trie."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.workers import lean

#: Splits text before the merges (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Nodes of the trie, after which a worker starts it anew.
NODES = 200_000
#: Bytes of the cache of words, about, after which a worker starts it anew; larger batches are encoded in pieces.
CACHED = 48 << 20
#: Characters of a batch that are encoded at once.
LARGE = 1 << 20
#: Bytes of a word that may enter the trie; longer ones are encoded on a trie of their own.
LONGEST = 48


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    return out | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}


class ByteBpe:
    """Encoder and decoder of a byte-level BPE vocabulary (the JSON of the tokenizers library)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        split = data["pre_tokenizer"] or {}
        if data["normalizer"] or data["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer and prefix space is known")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]) or data["model"].get("dropout"):
            raise ValueError("only added tokens that take no text beside them, and no dropout, are known")
        letters = _byte_letters()
        model = data["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank of a merge by its two tokens; and the two parts of a merged token.
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(pairs):
            x, y = self.ids[raw(a)], self.ids[raw(b)]
            self.rank[x, y] = r
            self.parts[self.ids[raw(a) + raw(b)]] = (x, y, r)
        self.longest = max(map(len, self.ids))
        self.sizes = {i: len(b) for i, b in self.bytes.items()}
        self.digits = {i: str(i) for i in self.bytes}
        self.split = regex.compile(PATTERN).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.release()

    def release(self) -> None:
        """Empty the caches, so that a worker that is kept for other tasks holds the vocabulary only."""
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached = 0
        self.fits.clear()
        self.clear()

    def clear(self) -> None:
        """Empty the trie: the child of a node and a byte; the last token of each node's encoding."""
        self.child: dict[int, int] = {}
        self.last = [-1]

    def merges_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just (a, b): no merge across the border comes first.

        Both tokens are taken apart in the reverse order of their merges; at each step the two tokens at the border
        must not have a merge that precedes the merges undone so far.
        """
        limit = len(self.rank)
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            x, y = self.parts.get(a), self.parts.get(b)
            if x is None and y is None:
                return True
            # of equal merges the left one comes first: before one in b that is a merge of the same rank at the border,
            # before one at the border that is one in a
            if y is None or (x is not None and x[2] > y[2]):
                limit, a = x[2], x[1]
            else:
                limit, b = y[2] + 1, y[0]

    def _last_token(self, word: bytes, lasts: list[int], depth: int) -> int:
        """The last token of the encoding of word[:depth]; lasts[d] is that of word[:d].

        It is the one suffix that is a token and can follow the last token of what stands before it. Only one fits, so any
        order finds it: first the last token made longer, then shorter suffixes, then longer ones.
        """
        ids, fits = self.ids, self.fits
        start = grown = depth - 1 - self.sizes[lasts[depth - 1]] if depth > 1 else 0
        token = ids.get(word[start:depth])
        if token is not None and (fits.get((lasts[start], token)) or self._fits(word, lasts, start, depth, token)):
            return token
        for start in range(depth - 1, grown, -1):
            token = ids.get(word[start:depth])
            if token is not None and self._fits(word, lasts, start, depth, token):
                return token
        for start in range(grown - 1, max(0, depth - self.longest) - 1, -1):
            token = ids.get(word[start:depth])
            if token is not None and self._fits(word, lasts, start, depth, token):
                return token
        raise ValueError("a byte has no token")

    def _fits(self, word: bytes, lasts: list[int], start: int, depth: int, token: int) -> bool:
        """Whether the token word[start:depth] can follow the last token before it."""
        fits, before = self.fits, lasts[start]
        ok = fits.get((before, token))
        if ok is None:
            if len(fits) > NODES:
                fits.clear()
            ok = fits[before, token] = self.merges_apart(before, token) if start else self.merges(word[:depth]) == [token]
        return ok

    def merges(self, text: bytes) -> list[int]:
        """The encoding by the definition: the merge of lowest rank, leftmost first, again and again. For short texts."""
        out = [self.ids[bytes([b])] for b in text]
        while len(out) > 1:
            r, k = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(out, out[1:], strict=False)))
            if r == len(self.rank):
                break
            out[k : k + 2] = [self.ids[self.bytes[out[k]] + self.bytes[out[k + 1]]]]
        return out

    def insert(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Insert sorted words into the trie and yield their encodings.

        In sorted order the words come as a depth-first walk meets them; a prefix that they share, now or with words of
        earlier batches, is a node whose last token is known. ``lasts`` holds the last tokens along the walk's path.
        """
        child, last, get = self.child, self.last, self.child.get
        for word in words:
            node, lasts, new = 0, [-1], False
            for depth, b in enumerate(word, 1):
                key = node << 8 | b
                node = None if new else get(key)
                if node is None:  # so are all nodes below
                    new = True
                    node = child[key] = len(last)
                    last.append(self._last_token(word, lasts, depth))
                lasts.append(last[node])
            yield self._read(lasts)

    def _read(self, lasts: list[int]) -> tuple[int, ...]:
        """The encoding: the last token, then that of the prefix before it, and so on."""
        out, d, sizes = [], len(lasts) - 1, self.sizes
        while d:
            out.append(lasts[d])
            d -= sizes[lasts[d]]
        return tuple(out[::-1])

    def learn(self, words: set[str]) -> None:
        """Put the encodings of words into the cache. Long words do not enter the trie."""
        if len(self.last) > NODES:
            self.clear()
        raw = {w.encode(): w for w in words}
        short = sorted(b for b in raw if len(b) <= LONGEST)
        for b, ids in zip(short, self.insert(short), strict=True):
            self._keep(raw[b], ids)
        for b, w in raw.items():
            if len(b) > LONGEST:
                lasts = [-1]
                for d in range(1, len(b) + 1):
                    lasts.append(self._last_token(b, lasts, d))
                self._keep(w, self._read(lasts))

    def _keep(self, word: str, ids: tuple[int, ...]) -> None:
        self.cache[word] = ids
        self.cached += 200 + 3 * len(word) + 8 * len(ids)

    def words_of(self, text: str) -> list[str]:
        """The text as the pattern cuts it, and around special tokens."""
        if self.around is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.around(text):
            out += [part] if part in self.special else self.split(part)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        if sum(map(len, texts)) > LARGE:  # text by text, so that what is learned at once stays small
            for text in texts:
                words, ids = self.words_of(text), []
                for lo in range(0, len(words), LARGE // 8):
                    ids += self._known([words[lo : lo + LARGE // 8]])[0]
                yield ids
        else:
            yield from self._known(list(map(self.words_of, texts)))

    def _known(self, split: list[list[str]]) -> list[list[int]]:
        if self.cached > CACHED:
            self.cache.clear()
            self.cached = 0
        new = set().union(*split).difference(self.cache)
        for s in new & self.special.keys():
            self.cache[s] = (self.special[s],)
        self.learn(new - self.special.keys())
        return [list(chain.from_iterable(map(self.cache.__getitem__, words))) for words in split]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def _encoder(digest: str, spec: str) -> ByteBpe:
    """The encoder of a vocabulary; a worker keeps the last one that it used."""
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = ByteBpe(spec)
    return _loaded[digest]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256), and ids on request.

    vocabulary: path of the tokenizer's JSON on the driver; Spark sends its text to the executors. Special tokens are
    matched in the text, none are added. Null texts are empty. Rows are independent, so repeated rows and ids, and
    extra columns, do not matter. A worker's trie and caches are bounded and start anew when full.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    ByteBpe(spec)  # errors in the file show here
    digest, shared = hashlib.sha256(spec.encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(digest, shared.value)
        try:
            yield from encoded(bpe, batches)
        finally:
            bpe.release()

    def encoded(bpe: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                texts = [t or "" for t in batch.column(1).slice(lo, 64).to_pylist()]
                n, ids_sha, text_sha, all_ids = [], [], [], []
                for ids in bpe.encode_batch(texts):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                cols = [batch.column(0).slice(lo, 64), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), ddl)
