"""Language identification by unigram pieces, with the segmentation of each word summed out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.bytesets import powers
from scholion.llm.workers import lean

LETTER = regex.compile(r"\p{L}").search
#: Characters of a word that are segmented together; longer words are cut into blocks of so many.
BLOCK = 64
#: Bytes of the scores, and characters of the words, that a worker keeps before it starts anew.
SCORES = 8 << 20
LETTERS = 4 << 20
#: Log-probability of a byte without a piece.
LEAST = math.log(1e-9)
SPREAD, SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(44)


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model, control pieces left out; byte pieces are ``<0xNN>``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]


@dataclass
class PieceModel:
    """Piece probabilities of each language over a fixed vocabulary."""

    pieces: list[str]
    languages: list[str]
    chances: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # by piece, then language

    def __post_init__(self) -> None:
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)
        self.bytes = [self.index.get(f"<0x{b:02X}>") for b in range(256)]
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}

    def edges(self, word: str) -> list[tuple[int, int, int | tuple]]:
        """(start, stop, piece) of all pieces in a word; a character without a piece is the tuple of its bytes' pieces."""
        out: list = []
        index, prefixes, n = self.index, self.prefixes, len(word)
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = word[i:j]
                if part not in prefixes:
                    break
                k = index.get(part)
                if k is not None:
                    out.append((i, j, k))
                    single = single or j == i + 1
            if not single:
                out.append((i, i + 1, tuple(self.bytes[b] for b in word[i].encode("utf-8", "replace"))))
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each of the sorted words in each language: forward sums over all its segmentations.

        The words are taken letter by letter, all at once; the sums of a prefix that words share are computed once.
        Words longer than BLOCK are the product of their blocks.
        """
        out = np.zeros((len(words), len(self.languages)))
        blocks = [(k, ("▁" + w)[at : at + BLOCK]) for k, w in enumerate(words) for at in range(0, len(w) + 1, BLOCK)]
        for lo in range(0, len(blocks), 16384):
            part = blocks[lo : lo + 16384]
            np.add.at(out, [k for k, _ in part], self._blocks([b for _, b in part]))
        return out

    def _blocks(self, blocks: list[str]) -> np.ndarray:
        hashes, chances, seen = self.table
        length = np.array([len(b) for b in blocks])
        n, deep = len(blocks), int(length.max())
        letters = np.zeros((n, deep), np.uint64)
        letters[np.arange(deep) < length[:, None]] = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint64(1)
        up, down = powers(deep + 1)
        sums = np.zeros((deep + 1, n), np.uint64)
        np.cumsum((letters * up[:deep]).T, axis=0, out=sums[1:])
        new = np.ones((deep + 1, n), bool)  # the prefix of so many letters is not one of the block before
        new[1:, 1:] = ~np.logical_and.accumulate((letters[1:] == letters[:-1]).T, axis=0)
        new[0, 1:] = False
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)
        # logarithms of the forward sums; they are added up relative to those one letter before, so that none underflows
        ahead = np.zeros((deep + 1, n, len(self.languages)))
        for d in range(1, deep + 1):
            rows = np.flatnonzero(new[d] & (length >= d))
            now, base = np.zeros((len(rows), len(self.languages))), ahead[d - 1][first[d - 1][rows]]
            whole = sums[d][rows]
            for start in range(max(0, d - self.longest), d):
                h = (whole - sums[start][rows]) * down[start]
                maybe = np.flatnonzero(seen[(h * SPREAD) >> SHIFT])
                at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                right = hashes[at] == h[maybe]
                hit = maybe[right]
                if start == d - 1:
                    now[hit] += chances[at[right]]
                    if len(hit) < len(rows):  # letters without a piece: their bytes' pieces
                        miss = np.setdiff1d(np.arange(len(rows)), hit)
                        now[miss] += np.array([self.chance(tuple(self.bytes[b] for b in blocks[rows[m]][start].encode("utf-8", "replace"))) for m in miss])
                elif len(hit):
                    now[hit] += np.exp(np.minimum(ahead[start][first[start][rows[hit]]] - base[hit], 600.0)) * chances[at[right]]
            ahead[d, rows] = base + np.log(now)
        return ahead[length, first[length, np.arange(n)]]

    def chance(self, pieces: tuple) -> np.ndarray:
        return np.prod([self.chances[k] if k is not None else np.full(len(self.languages), 1e-9) for k in pieces], axis=0)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the pieces in order, their chances, and a bitmap that rules out most other hashes."""
        up, _ = powers(self.longest + 1)
        hashes = np.array([int(((np.frombuffer(p.encode("utf-32-le"), np.uint32) + np.uint64(1)) * up[: len(p)]).sum()) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        seen = np.zeros(1 << 20, bool)
        seen[(hashes * SPREAD) >> SHIFT] = True
        return hashes[order], self.chances[order], seen


def fit_pieces(pieces: list[str], counts: dict[str, dict[str, int]], rounds: int = 3, prior: float = 0.05, inner: dict[str, dict[str, int]] | None = None) -> PieceModel:
    """Estimate piece probabilities from word counts by language: EM, each word's segmentations weighed by probability.

    ``inner`` counts blocks of words that do not stand at a word's start. Forward and backward sums are scaled at each
    letter, so that no block underflows.
    """
    model = PieceModel(pieces, sorted(counts))
    size = len(pieces)
    columns = []
    for language in model.languages:
        words = []
        for word, n in counts[language].items():
            word = "▁" + word
            words += [(n, len(word[at : at + BLOCK]), model.edges(word[at : at + BLOCK])) for at in range(0, len(word), BLOCK)]
        for block, n in (inner or {}).get(language, {}).items():
            words.append((n, len(block), model.edges(block)))
        p = [1.0 / size] * size
        for _ in range(rounds):
            found = [prior] * size
            for n, length, edges in words:
                logs = [math.log(p[k]) if isinstance(k, int) else sum(math.log(p[b]) if b is not None else LEAST for b in k) for _, _, k in edges]
                # the best way to each letter is the scale of the sums there: all of them are 1 or a little more
                top = [0.0] + [-math.inf] * length
                for (i, j, _), c in zip(edges, logs, strict=True):
                    top[j] = max(top[j], top[i] + c)
                chances = [math.exp(top[i] + c - top[j]) for (i, j, _), c in zip(edges, logs, strict=True)]
                ahead, back = [0.0] * (length + 1), [0.0] * (length + 1)
                ahead[0] = back[length] = 1.0
                for (i, j, _), c in zip(edges, chances, strict=True):
                    ahead[j] += ahead[i] * c
                for (i, j, _), c in zip(reversed(edges), reversed(chances), strict=True):
                    back[i] += back[j] * c
                for (i, j, k), c in zip(edges, chances, strict=True):
                    share = n * ahead[i] * c * back[j] / ahead[length]
                    for b in (k,) if isinstance(k, int) else k:
                        if b is not None:
                            found[b] += share
            total = sum(found)
            p = [x / total for x in found]
        columns.append(p)
    return PieceModel(pieces, model.languages, np.array(columns).reshape(len(columns), size).T.copy())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text (null: empty) is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_language_model(docs: DataFrame, vocabulary: str, per_language: int = 120, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PieceModel:
    """Fit on a bounded sample of labelled documents that are not held out.

    The sample has about ``per_language`` documents of each label, those with the smallest hashes of id and text; of them
    only word counts reach the driver. All labels are learned; they are classes, so their number does not grow with the
    table.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()
    if not sizes:
        return fit_pieces(read_pieces(vocabulary), {})
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, min(1.0, per_language / r["count"]))))
    rank = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    words = known.where(rank < F.coalesce(share[F.col(lang_col)], F.lit(0.0)))
    words = words.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(text_col), "\\s+")).alias("word")).where("length(word) > 0")
    # runs without spaces, as whole clauses in some scripts: the blocks that ``fit_pieces`` cuts, counted by themselves
    size = F.length("word")
    cuts = F.transform(F.sequence(F.lit(0), F.floor(size / BLOCK).cast("int")), lambda k: F.struct((k > 0).alias("inner"), F.substring(F.col("word"), F.greatest(k * BLOCK, F.lit(1)), F.when(k == 0, BLOCK - 1).otherwise(BLOCK)).alias("word")))
    words = words.select("lang", F.explode(cuts).alias("c")).select("lang", "c.inner", "c.word").where("word <> ''")
    counts: dict[str, dict[str, int]] = {r.lang: {} for r in sizes}
    inner: dict[str, dict[str, int]] = {r.lang: {} for r in sizes}
    for r in words.groupBy("lang", "inner", "word").count().orderBy("lang", "inner", "word").toLocalIterator():
        (inner if r.inner else counts)[r.lang][r.word] = r["count"]
    return fit_pieces(read_pieces(vocabulary), counts, inner=inner)


def predict_language(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text, and the columns in ``keep``; ``names`` are those of the last two.

    score is the posterior of the predicted language, all languages being equally likely before. Null texts, texts
    without a letter, and all texts if no language was learned, are ``und`` with score 0. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.chances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(*shared.value)
        room = max(1024, SCORES // (8 * max(1, len(own.languages))))
        table, known, letters = np.zeros((room, len(own.languages))), {}, 0

        def learn(words: list[str]) -> None:
            nonlocal letters
            for k, (w, row) in enumerate(zip(words, own.score(words), strict=True), len(known)):
                table[k] = row
                known[w] = k
                letters += len(w)

        def total(words: list[str]) -> np.ndarray:
            """The sum of the words' scores; what is learned at once fits the table, whatever the text's length."""
            nonlocal letters
            out = np.zeros(len(own.languages))
            lo = 0
            while lo < len(words):
                hi, size = lo, 0
                while hi < len(words) and hi - lo < room and size < LETTERS:
                    size += len(words[hi])
                    hi += 1
                new = sorted(set(words[lo:hi]).difference(known))
                if len(known) + len(new) > room or letters > LETTERS:
                    known.clear()
                    letters = 0
                    new = sorted(set(words[lo:hi]))
                if new:
                    learn(new)
                out += table[list(map(known.__getitem__, words[lo:hi]))].sum(axis=0)
                lo = hi
            return out

        for batch in batches:
            for lo in range(0, len(batch), 512):
                lang, score = [], []
                texts = batch.column(0).slice(lo, 512).to_pylist()
                usable = [t is not None and bool(own.languages) and LETTER(t) is not None for t in texts]
                split = [t.lower().split() if u else [] for t, u in zip(texts, usable, strict=True)]
                every = set().union(*split).difference(known)
                if len(known) + len(every) <= room and sum(map(len, every)) + letters <= LETTERS:
                    learn(sorted(every))  # all at once
                for words, u in zip(split, usable, strict=True):
                    sums = total(words)
                    best = int(sums.argmax()) if u else 0
                    lang.append(own.languages[best] if u else "und")
                    score.append(float(1.0 / np.exp(np.maximum(sums - sums[best], -700.0)).sum()) if u else 0.0)
                rest = [c.slice(lo, 512) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*others, *names])

    others = ["doc_id", *(keep or [])]
    rows = docs.select(F.col(text_col), F.col(id_col).alias("doc_id"), *(keep or []))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + f", {names[0]} string, {names[1]} double"
    return rows.mapInArrow(lean(run), ddl)
