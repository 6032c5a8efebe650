"""Each operator against a brute-force version on small tables, and on nulls, empty and long texts, ties and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("scholion.llm")

from pyspark.sql import functions as F

from scholion.llm import bpe, embedding_join, language_id, licenses, mixing, ngram_join, pii, quality_rules, substring_dedup, toxicity
from scholion.llm.components import connected_components
from scholion.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, node string, x string, y string, key string, size string, tag string, h string, score string"
BASE = "the quick brown fox jumps over the lazy dog while seven other animals watch from a quiet hill near the old mill and think about dinner".split()


def rows():
    rng = random.Random(4)
    long = " ".join(rng.choice(BASE) + str(rng.randrange(50)) for _ in range(6000))
    near = [*BASE[:-1], "supper"]
    texts = [" ".join(BASE), " ".join(BASE), " ".join(near), "", None, "   \n\t ", "one two", "one two", "ONE TWO", long, long[:-20] + " changed at the end", "a😀b c\x0bd\x0ce 漢字 é",
             "x" * 250, "Call +1 (988) 555-2485 or mail a.b@mail.example.com, ip 10.0.0.1.", " ".join(BASE) + "\n" + " ".join(BASE), "a b c a b c a b c"]
    out = [(k, t, "en" if k % 3 else None, f"s{k % 3}" if k % 4 else None, None) for k, t in enumerate(texts)]
    out += [out[0], (None, " ".join(BASE), "en", "s1", 3), (None, None, None, None, None)]
    return [(*r, *[None if k % 2 else "z"] * 0, k, *["z"] * 8) for k, r in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 11), (5, 5), (None, 1), (30, 31), (31, 32), (32, 33), (33, 34), (34, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {**dict.fromkeys([1, 2, 3, 30, 31, 32, 33, 34], 1), **dict.fromkeys([9, 10, 11], 9)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute_components(texts, linked):
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(texts))]


def test_ngram_join(spark, docs, none):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t, 4) for _, t in data]
    groups = brute_components(data, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    low = collections.defaultdict(list)
    for k, g in enumerate(groups):
        low[g].append(data[k][0])
    want = [(i, len(sets[k]), min((x for x in low[groups[k]] if x is not None), default=None)) for k, (i, _) in enumerate(data)]
    assert ordered(ngram_join.ngram_jaccard_components(docs)) == sorted(want, key=repr)
    assert ngram_join.ngram_jaccard_components(none).count() == 0


def test_ngram_join_groups(spark):
    """Chains, a hub with many near copies, and a passage in many documents."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(4000)]
    hub = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = [" ".join(hub)]
    for _ in range(60):
        copy = hub.copy()
        copy[rng.randrange(118) + 1] = rng.choice(words)
        texts.append(" ".join(copy))
    for _ in range(60):
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randrange(5, 40))] + passage + [rng.choice(words) for _ in range(rng.randrange(5, 40))]))
    chain = hub[:60] + [rng.choice(words) for _ in range(60)]
    for k in range(20):
        chain = [*chain[4:], *(rng.choice(words) for _ in range(4))]
        texts.append(" ".join(chain))
    sets = [shingles(t, 4) for t in texts]
    groups = brute_components(texts, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    low = {g: min(k for k in range(len(texts)) if groups[k] == g) for g in set(groups)}
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert ordered(got) == sorted(((k, len(sets[k]), low[groups[k]]) for k in range(len(texts))), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_vectors(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(embedding_join, "CELL", 12)
        monkeypatch.setattr(embedding_join, "BLOCK", 10)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6))
    data = []
    for k in range(140):
        v = centres[k % 9] + rng.normal(size=6) * 0.12
        data.append((k, [float(np.float32(x)) for x in v], int(k % 4 == 0)))
    data += [(200, data[3][1], data[3][2]), (201, [2 * x for x in data[3][1]], data[3][2]), (202, None, 0), (203, [0.0] * 6, 0), (204, [float("nan")] * 6, 0), (205, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0),
             (206, data[3][1], None), (207, [], 0), (208, [1.0, 2.0], 0), (209, [float("inf")] * 6, 0), (None, data[3][1], data[3][2]), data[5], (210, [1e-30 * x for x in data[3][1]], data[3][2])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("z")).repartition(3)

    def usable(k):
        v, label = data[k][1], data[k][2]
        return label is not None and v and None not in v and np.isfinite(v).all() and any(v)

    unit = [np.array(v[1], float) / np.linalg.norm(np.array(v[1], float)) if usable(k) else None for k, v in enumerate(data)]

    def linked(a, b):
        return unit[a] is not None and unit[b] is not None and data[a][2] == data[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98

    groups = brute_components(data, linked)
    want = []
    for k, (i, _, _) in enumerate(data):
        links = sum(linked(k, j) for j in range(len(data)) if j != k)
        low = min((data[j][0] for j in range(len(data)) if groups[j] == groups[k] and data[j][0] is not None), default=None)
        want.append((i, links, low, i == low))
    assert ordered(embedding_join.vector_components(df)) == sorted(want, key=repr)
    assert embedding_join.vector_components(df.limit(0)).count() == 0


def test_quality(docs, none):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.host_quality(docs).documents.collect()}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        g = got[r.doc_id, len(w)]
        assert (g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (sum(map(len, w)), sum((r.text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not g.base_failed or not g.kept)
    assert quality_rules.host_quality(none).documents.count() == 0


def test_host_rates(spark):
    """A host with few documents is drawn to the mean of all hosts, one with many keeps its rate."""
    data = [(f"h{k}", 1000, 100 + k) for k in range(20)] + [("small", 2, 2), ("bad", 1000, 900)]
    got = {r.host: r.rate_r for r in quality_rules.shrunken_rates(spark.createDataFrame(data, "host string, n long, fails_r long"), ["r"]).collect()}
    assert got["small"] < 0.8 and got["bad"] > 0.85 and abs(got["h0"] - 0.1) < 0.01


def test_substrings(spark, docs, none, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SORTED", 3000)
    base = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    extra = [(100 + k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300))) + passage[rng.randrange(30) :] + "".join(rng.choice("abc") for _ in range(rng.randrange(200)))) for k in range(12)]
    data = sorted({(r.doc_id, r.text) for r in base} | set(extra), key=lambda r: r[0])
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("d", F.lit("z")).repartition(3)
    seen, want = set(), []
    for i, text in data:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        want.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.dedup_substrings(df)
    assert ordered(got.drop("removed")) == sorted(want, key=repr)
    for r in got.join(df, "doc_id").collect():
        assert hashlib.sha256(substring_dedup.apply_removed(r.text, r.removed)).hexdigest() == r.kept_sha256
    assert substring_dedup.dedup_substrings(docs).count() == docs.count()
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_longest_previous_factors():
    rng = random.Random(1)
    for _ in range(60):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randrange(25)))
        want = [max([n for q in range(p) for n in range(len(s) - p + 1) if s[q : q + n] == s[p : p + n]], default=0) for p in range(len(s))]
        assert substring_dedup.longest_previous_factors(s) == want


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    got = bpe.encode_documents(docs.unionByName(docs.limit(1).withColumn("text", F.lit("x<|endoftext|> y"))), vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    texts = {(r.doc_id): r.text for r in docs.collect()}
    assert len(got) == docs.count() + 1
    for r in got:
        text = t.decode(r.ids, skip_special_tokens=False)
        assert hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
        assert t.encode(text, add_special_tokens=False).ids == r.ids and len(r.ids) == r.n_tokens
        assert hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256
        assert r.doc_id is None or text in (texts[r.doc_id] or "", "x<|endoftext|> y")
    assert bpe.encode_documents(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_bpe_words():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t, own = Tokenizer.from_file(path), bpe.ByteBpe(open(path, encoding="utf-8").read())
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz ABC'\t\n éß漢😀0123.,!_<|>̀‍"
    for k in range(600):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + "aa" * (k % 60)
        assert own.encode(s) == t.encode(s, add_special_tokens=False).ids
        assert own.decode(own.encode(s)) == s


def targets(sizes):
    total, names = sum(sizes.values()), sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: [1, 2, 3][k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), total
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixing(spark, docs, none):
    data = docs.collect()
    sizes = collections.Counter()
    for r in data:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    got = mixing.mix_sources(docs).collect()
    want = targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(data) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(got, key=repr) == sorted(mixing.mix_sources(docs.repartition(5)).collect(), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    assert abs(words - sum(taken.values())) <= 2
    assert mixing.mix_sources(none).count() == mixing.mixed_documents(none).count() == 0


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(s))) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15],
    }


def test_personal_data_patterns():
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice("a@.1+2 5-%(d0A9@.") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("4785380592391139 x")["card"] == brute_spans("4785380592391139 x")["card"] != []


def test_personal_data(spark, docs, none):
    filler = ["sun", "moon", "tree", "river", "stone", "cloud", "grass", "wind"]
    rng = random.Random(8)
    data = [(k, f"{' '.join(rng.choice(filler) for _ in range(9))} zorblatt writes jo@ex.org {' '.join(rng.choice(filler) for _ in range(9))}") for k in range(5)]
    data += [(k, " ".join(rng.choice(filler) for _ in range(20))) for k in range(5, 200)] + [(200, "zorblatt alone"), (201, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("x", F.lit(1)).repartition(4)
    texts = dict(data)
    for r in pii.find_personal_data(df).collect():
        found = brute_spans(texts[r.doc_id] or "")
        base = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        words = [texts[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",")) if k in ("term", "gone")] if r.spans else []
        assert words == (["zorblatt", "writes"] if r.doc_id < 5 else []), words
    clean = {r.doc_id: r.text for r in pii.sanitised_documents(df).collect()}
    assert all("zorblatt" not in clean[k] and "jo@ex.org" not in clean[k] and "[EMAIL]" in clean[k] for k in range(5)) and clean[200] == "zorblatt alone" and clean[201] is None
    assert pii.sanitised_documents(docs).columns == docs.columns and pii.sanitised_documents(docs).count() == docs.count()
    assert pii.find_personal_data(none).count() == pii.sanitised_documents(none).count() == 0


def test_language(spark, none, docs):
    rng = random.Random(9)
    parts = {"aa": ["tion", "the", "ing", "wh"], "bb": ["sch", "ung", "keit", "ü"]}
    data = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(12)), lang) for k in range(200) for lang in [["aa", "bb"][k % 2]]]
    data += [(1000, None, "aa"), (1001, "12 34", "aa"), (1002, "tionthe", None), (1003, "the" * 300, None), (None, "schung", "bb")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("z"))
    model = language_id.fit_language_model(df, vocabulary("piece_bpe_32k.model"), per_language=40)
    got = language_id.predict_language(df, model, keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 200) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id and r.doc_id >= 1000} == {1000: "und", 1001: "und", 1002: "aa", 1003: "aa"}
    words = sorted({"tion", "tionthe", "ungü", "漢x", "q" * 70})
    scores = model.score(words)
    for w, s in zip(words, scores):
        total = 0.0
        for at in range(0, len(w) + 1, language_id.BLOCK):
            part = ("▁" + w)[at : at + language_id.BLOCK]
            ahead = [1.0] + [0.0] * len(part)
            for i, j, p in model.edges(part):
                ahead[j] += ahead[i] * (model.chances[p][0] if isinstance(p, int) else model.chance(p)[0])
            total += np.log(ahead[-1])
        assert abs(total - s[0]) < 1e-9
    empty = language_id.fit_language_model(none, vocabulary("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.predict_language(docs, empty).collect()} == {"und"}
    assert language_id.predict_language(none, model).count() == 0


def test_toxicity(spark, docs, none):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(60)]
    data, labels = [], []
    for k in range(400):
        grade = [0, 0, 0, 1, 2][k % 5]
        data.append((k, " ".join(rng.choice(words) for _ in range(20)) + " vile," * grade + " awful" * (grade == 2)))
        labels.append((k, grade))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("grade", F.lit("z"))
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, grade int")
    model = toxicity.fit_toxicity(df, lab, F.col("grade"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in toxicity.predict_severity(df, model).collect()}
    assert all(got[k].toxic == (g > 0) for k, g in labels) and all(got[k].severity == g for k, g in labels)
    means = [np.mean([got[k].expected_severity for k, g in labels if g == x]) for x in range(3)]
    assert means == sorted(means)
    assert not any(r.toxic for r in toxicity.predict_severity(docs, model).collect())
    assert toxicity.fit_toxicity(none, lab.limit(0), F.col("grade")) is None
    assert not any(r.toxic for r in toxicity.predict_severity(docs, None).collect()) and toxicity.predict_severity(none, model).count() == 0


def test_licenses(spark, docs, none):
    model = licenses.fit_licenses(docs)
    texts = {0: "Some prose.\nReleased under the MIT License.", 1: "Licensed under CC BY-NC 4.0.", 2: "the license plate of a public version", 3: None, 4: "", 5: "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."}
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("licenses", F.lit(1)), model).collect()}
    assert [got[k].licenses for k in range(6)] == ["MIT", "CC-BY-NC-4.0", "", "", "", "Apache-2.0,MIT"]
    assert got[0].spans == "MIT:12:43" and got[5].n_notices == 2
    assert licenses.scan_licenses(docs, model).where("n_notices > 0").count() == 0 and licenses.scan_licenses(none, model).count() == 0
