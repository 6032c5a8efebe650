"""Personal data: fixed kinds by pattern, and terms that reveal them by corpus co-occurrence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.workers import lean
from scholion.session import BROADCAST_ROWS, discard, hinted, materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match cannot start inside a run of digits: one from the run's start would have matched or failed alike
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'()[]{}<>.,;:!?*#$%&|"
#: Entries, and characters of their terms, that a worker counts before it hands them on.
ENTRIES = 100_000
LETTERS = 8 << 20


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in code points: leftmost and non-overlapping, failing matches dropped without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out["email"].append((start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out["phone"].append(m.span())
    return out


def _entity(kind: str, value: str) -> int:
    """64-bit name of an entity: its kind and value without case or punctuation between digits."""
    value = value.lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - 2**63


def _term(word: str) -> str:
    term = word.strip(EDGES).lower()
    return term if len(term) > 1 else ""


def _terms(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, term) of the terms of a whole text, outside its base spans."""
    taken = sorted(x for spans in base_spans(text).values() for x in spans)
    k, reach = 0, 0  # reach: where the spans that start before the word's end stop
    for m in WORD.finditer(text):
        term = _term(m[0])
        if term:
            a = m.start() + (len(m[0]) - len(m[0].lstrip(EDGES)))
            b = a + len(m[0].strip(EDGES))
            while k < len(taken) and taken[k][0] < b:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= a:
                yield a, b, term


def _entities(text: str) -> list[int]:
    return sorted({_entity(kind, text[a:b]) for kind, spans in base_spans(text).items() for a, b in spans})


def _parts(table: DataFrame, key: str) -> Iterator[list]:
    """The rows of a table in parts of about BROADCAST_ROWS, so that each can be sent to the workers."""
    n = -(-table.count() // BROADCAST_ROWS)
    for k in range(n):
        yield table.where(F.pmod(F.xxhash64(key), F.lit(n)) == k).collect()


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x, y, n_email, n_ip, n_card, n_phone, base, entities) of each whole text.

    x, y: 128-bit key of the row's id and text. base: ``kind:start:end`` by kind, then start, joined by commas.
    """
    names = ["doc_id", "x", "y", "n_email", "n_ip", "n_card", "n_phone", "base", "entities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3):
                text = text.as_py() or ""
                spans = base_spans(text)
                flat = [(kind, a, b) for kind in KINDS for a, b in spans[kind]]
                names_of = [_entity(kind, text[a:b]) for kind, a, b in flat]
                rows.append((*(len(spans[k]) for k in KINDS), ",".join(f"{k}:{a}:{b}" for k, a, b in flat), sorted(set(names_of))))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("x"), F.xxhash64(F.lit(1), id_col, text_col).alias("y"), F.col(text_col).alias("text"))
    ddl = f"doc_id {kind}, x long, y long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>"
    return rows.mapInArrow(lean(run), ddl)


def _pair_counts(docs: DataFrame, text_col: str, entities: DataFrame) -> DataFrame:
    """(e, t, n_et): in how many documents each of the entities and each term occur, anywhere in the text."""

    def counts(only: frozenset[int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            letters = 0

            def flush() -> pa.RecordBatch:
                nonlocal letters
                out = [[e for e, _ in found], [t for _, t in found], list(found.values())]
                found.clear()
                letters = 0
                return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["e", "t", "n"])

            for batch in batches:
                for text in batch.column(0):
                    text = text.as_py() or ""
                    own = only.intersection(_entities(text))
                    terms = {t for _, _, t in _terms(text)} if own else ()
                    for e in own:
                        found.update((e, t) for t in terms)
                        letters += sum(map(len, terms))
                        if len(found) > ENTRIES or letters > LETTERS:
                            yield flush()
            yield flush()

        return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "e long, t string, n long")

    out = docs.sparkSession.createDataFrame([], "e long, t string, n long")
    for part in _parts(entities.select("e"), "e"):
        out = out.union(counts(frozenset(r.e for r in part)))
    return out.groupBy("e", "t").agg(F.sum("n").alias("n_et"))


def _term_counts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(t, n_t): in how many documents, of all, each wanted term occurs."""
    only = frozenset(r.t for r in wanted.collect()) if wanted.count() <= BROADCAST_ROWS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        letters = 0

        def flush() -> pa.RecordBatch:
            nonlocal letters
            found.pop("", None)
            out = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
            found.clear()
            letters = 0
            return pa.RecordBatch.from_arrays(out, ["t", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = {_term(w) for w in set(WORD.findall(text.as_py() or ""))}
                words = words if only is None else words & only
                letters += sum(len(w) for w in words if w not in found)
                found.update(words)
                if len(found) > ENTRIES or letters > LETTERS:
                    yield flush()
        yield flush()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "t string, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    return counts if only is not None else counts.join(wanted, "t", "left_semi")


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text", disclosure: float = 0.8, support: int = 3) -> DataFrame:
    """(e, t, ratio): terms that reveal an entity, over all documents.

    A term t tells PMI(e, t) = log p(e | t) / p(e) of an entity's information IC(e) = -log p(e). Pairs that occur in
    ``support`` or more documents together, anywhere in them, and whose ratio PMI / IC reaches ``disclosure`` are returned.
    """
    total = found.count()
    entities = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    # n_et <= n_e, so rarer entities have no pair with the support
    entities = materialize(entities.where((F.col("n_e") >= support) & (F.col("n_e") < total)), "frequent")
    pairs = materialize(_pair_counts(docs, text_col, entities).where(F.col("n_et") >= support), "pairs")
    wanted = materialize(pairs.select("t").distinct(), "wanted")
    terms = materialize(_term_counts(docs, text_col, wanted), "terms")
    joined = pairs.join(hinted(terms), "t").join(hinted(entities), "e")
    # a term's places in documents with an entity are found with the same rules as its occurrences, so n_et <= n_t
    ratio = 1 - F.log(F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))) / F.log(F.col("n_e") / F.lit(float(max(total, 1))))
    out = materialize(joined.select("e", "t", ratio.alias("ratio")).where(F.col("ratio") >= disclosure), "disclosing")
    discard(entities, pairs, wanted, terms)
    return out


def _marks(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, everywhere: bool) -> DataFrame:
    """(x, y, a, b, ratio) of every occurrence of the terms, in all documents or in those with an entity they reveal."""

    def marks(known: dict[str, dict[int | None, float]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for x, y, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    text = text.as_py() or ""
                    here = known.keys() & {_term(w) for w in set(WORD.findall(text))}
                    if not here:
                        continue
                    own = {None, *(() if everywhere else _entities(text))}
                    ratios = {t: max((r for e, r in known[t].items() if e in own), default=None) for t in here}
                    out += [(x.as_py(), y.as_py(), a, b, ratios[t]) for a, b, t in _terms(text) if ratios.get(t) is not None]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["x", "y", "a", "b", "ratio"])

        rows = docs.select(F.xxhash64(id_col, text_col).alias("x"), F.xxhash64(F.lit(1), id_col, text_col).alias("y"), F.col(text_col).alias("text"))
        return rows.mapInArrow(lean(run), "x long, y long, a long, b long, ratio double")

    if everywhere:
        terms = terms.groupBy("t").agg(F.max("ratio").alias("ratio")).withColumn("e", F.lit(None).cast("long"))
    out = docs.sparkSession.createDataFrame([], "x long, y long, a long, b long, ratio double")
    for part in _parts(terms, "t"):
        known: dict[str, dict[int | None, float]] = {}
        for r in part:
            known.setdefault(r.t, {})[r.e] = r.ratio
        out = out.union(marks(known))
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.8, remove: float = 0.95, support: int = 3, everywhere: bool = False) -> DataFrame:
    """(doc_id, x, y, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each whole text.

    spans: all spans ``kind:start:end`` joined by commas: the base ones, then ``term`` (to be generalised) and ``gone``
    (to be removed, disclosure of ``remove`` or more) by start. Every occurrence of a disclosing term is marked, with
    ``everywhere`` in all documents, else in those with an entity that it reveals. Counts are of all documents, repeated
    rows included; rows with equal id and text get the same result; null texts are empty. Offsets count code points. A
    common entity or term is a partial aggregate.
    """
    found = materialize(find_entities(docs, id_col, text_col), "entities")
    terms = disclosing_terms(docs, found, text_col, disclosure, support)
    spans = _marks(docs, id_col, text_col, terms, everywhere).groupBy("x", "y", "a", "b").agg(F.max("ratio").alias("ratio"))
    spans = spans.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("a", "b", "ratio"))).alias("terms"))
    text = F.transform("terms", lambda s: F.concat_ws(":", F.when(s["ratio"] >= remove, "gone").otherwise("term"), s["a"], s["b"]))
    out = found.drop("entities").join(spans, ["x", "y"], "left")
    joined = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.concat_ws(",", text))
    joined = F.when(F.col("terms").isNull(), F.col("base")).otherwise(joined)
    return out.select("doc_id", "x", "y", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), joined.alias("spans"))


def sanitise_text(text: str | None, spans: str | None) -> str | None:
    """The text with its spans replaced: base ones and generalised terms by their kinds, removed ones by nothing."""
    if text is None or not spans:
        return text
    parts = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",")))
    out, at = [], 0
    for a, b, kind in parts:
        b = -b
        if b <= at:
            continue
        out.append(text[at : max(at, a)])
        if a >= at:
            word = text[a:b]
            out.append("" if kind == "gone" else f"[{('number' if word.isdigit() else 'term') if kind == 'term' else kind}]".upper())
        at = b
    out.append(text[at:])
    return "".join(out)


def sanitised_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The documents with personal data and disclosing terms replaced; their other columns are unchanged."""
    spans = find_personal_data(docs, id_col, text_col, **options).where("spans <> ''").select(F.col("x").alias("pii_x_"), F.col("y").alias("pii_y_"), F.col("spans").alias("pii_spans_")).distinct()
    keyed = docs.withColumn("pii_own_x_", F.xxhash64(id_col, text_col)).withColumn("pii_own_y_", F.xxhash64(F.lit(1), id_col, text_col))
    rows = keyed.join(hinted(materialize(spans, "spans")), F.expr("pii_own_x_ = pii_x_ and pii_own_y_ = pii_y_"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [sanitise_text(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist(), strict=True)]
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return rows.select(*docs.columns, "pii_spans_").mapInArrow(lean(run), docs.schema)
