"""Formats: golden documents, round trips, framing, tar and streams."""

import base64
import io
import os

import pytest

from scholion.functions.types import FieldType
from scholion.sources import blocked, documents, msgpack, tarred
from scholion.sources.documents import Document, Layer
from scholion.streaming.documents import run_batches, stream_documents

# Fixed value: an encoded document with nine tokens and two entities.
GOLDEN = (
    "RE1fMQGAkqxuYW1lZF9lbnRpdHmldG9rZW4Co2Nsc8Kjc3RypHRleHTDpHNwYW6Bp2NvbnRleHSkbWFpbgGkdGV4dMOkc3BhboGnY29udGV4dKRtYWluPIGkbWFpbp+kVGhpc6EgpGNvZGWhIKN3YXOhIKd3"
    "cml0dGVuoSCiaW6hIKRMdW5koSyhIKZTd2VkZW6hLhECwpKjR1BFo0dQRcKUCgsNDhcJwtwAEgABAgMEBQYHCAkKCwsMDQ4ODw=="
)


def sample():
    fields = {"id": FieldType("i32"), "text": FieldType("span", "main"), "head": FieldType("noderef", "token"), "more": FieldType("noderef_array", "token"), "run": FieldType("nodespan", "token"), "raw": FieldType("bin"), "score": FieldType("f64"), "ok": FieldType("i1")}
    nodes = [{"id": 1, "text": (0, 1), "head": 1}, {"text": (1, 2), "more": [0, 1], "run": (0, 1), "raw": b"\x00\xff", "score": 1.5, "ok": False}, {}]
    return Document({"uri": "doc:1"}, {"main": "a😀b", "empty": ""}, {"token": Layer(fields, nodes)})


def test_golden():
    data = base64.standard_b64decode(GOLDEN)
    doc = documents.decode(data)
    words = {k: [doc.texts["main"][slice(*n["text"])] for n in v.nodes] for k, v in doc.layers.items()}
    assert " ".join(words["token"]) == "This code was written in Lund , Sweden ." and words["named_entity"] == ["Lund", "Sweden"]
    assert documents.encode(doc) == data


def test_round_trips():
    doc = sample()
    assert documents.decode(documents.encode(doc)) == doc and documents.decode_json(documents.encode_json(doc)) == doc
    parts = documents.Parts(documents.encode(doc))
    assert parts.props() == doc.props and parts.texts("empty") == {"empty": ""} and parts.layer("token", "id").nodes == [{"id": 1}, {}, {}]
    xml = documents.encode_xml(doc, verbose=True, document_id="d")
    assert 'ref="d.token.1"' in xml and documents.xml_text("a\x00b\x1f") == "a b "


def test_undeclared_fields():
    doc = sample()
    doc.layers["token"].nodes[0]["other"] = 1
    for write in (documents.encode, documents.encode_json):
        with pytest.raises(ValueError):
            write(doc)
    doc.layers["token"].nodes[0].pop("other")
    doc.layers["token"].fields["x"] = FieldType("noderef", "absent")
    with pytest.raises(ValueError):
        documents.encode(doc)


def test_msgpack():
    values = [None, True, False, 0, 127, 128, 65535, 2**32, 2**63, -1, -32, -33, -129, -(2**31) - 1, 1.5, "", "x" * 31, "é" * 40, "y" * 70000, b"", b"z" * 300, [], list(range(20)), {"a": [1, {"b": None}]}, {str(k): k for k in range(20)}]
    u = msgpack.Unpacker(b"".join(map(msgpack.pack, values)))
    assert list(u) == values
    assert msgpack.Unpacker(msgpack.pack(msgpack.Ext(5, b"abc"))).one() == msgpack.Ext(5, b"abc")
    with pytest.raises(EOFError):
        msgpack.Unpacker(msgpack.pack("abc")[:-1]).one()


@pytest.mark.parametrize("codec", ["none", "zip", "bzip2", "zipsq", "lzma", "zstd"])
@pytest.mark.parametrize("boundary", [None, 12])
def test_blocks(codec, boundary):
    docs = [os.urandom(700) + bytes([k]) for k in range(40)]
    data = blocked.file_bytes(docs, per_block=16, codec_name=codec, boundary=boundary)
    found = [(b.position, at, d) for b in blocked.blocks(data) for at, d in b.documents()]
    assert [d for _, _, d in found] == docs and len({p for p, _, _ in found}) == 3
    plain = blocked.unframed(data) if boundary else data
    assert all(blocked.document_at(plain, p, at) == d for p, at, d in found)


def test_framing():
    out = io.BytesIO()
    w = blocked.Framing(out, 12)
    for k in range(8192 // 64):
        w.write(bytes((64 * k + i) % 256 for i in range(64)))
    data = out.getvalue()
    assert len(data) == 8192 + 1 + 8 and blocked.unframed(data) == bytes(k % 256 for k in range(8192))
    assert int.from_bytes(data[4096:4100], "big", signed=True) == 1 - 4096


def test_codecs():
    with pytest.raises(ValueError):
        blocked.register_codec("zip", bytes, bytes)
    blocked.register_codec("own", bytes, bytes)
    blocked.unregister_codec("own")
    with pytest.raises(ValueError):
        blocked.codec("own")
    assert blocked.inflate(blocked.deflate(b"AB" * 1000)) == b"AB" * 1000


def test_data_source(spark, tmp_path):
    blocked.register(spark)
    folder = str(tmp_path / "out")
    rows = [(documents.encode(Document({"k": k}, {"main": f"text {k}"}, {})),) for k in range(50)]
    df = spark.createDataFrame(rows, "data binary").repartition(3)
    df.write.format("blocked-documents").option("path", folder).option("docsPerBlock", "8").option("codec", "zstd").option("boundary", "12").mode("append").save()
    with pytest.raises(Exception):
        df.write.format("blocked-documents").option("path", folder).mode("append").save()
    back = spark.read.format("blocked-documents").option("path", folder).option("blocksPerTask", "1").load()
    assert back.rdd.getNumPartitions() > 3
    assert sorted(documents.Parts(bytes(r.data)).props()["k"] for r in back.collect()) == list(range(50))
    plain = blocked.read_blocked(spark, folder)
    assert plain.count() == 50 and blocked.read_blocked(spark, folder, count_only=True).groupBy().sum("n").first()[0] == 50


def test_tar(spark, tmp_path):
    df = spark.createDataFrame([(k, f"doc {k}".encode()) for k in range(7)], "doc_id long, data binary").repartition(2)
    tarred.write_tar(df, str(tmp_path / "tar"), root="r", gzip=True)
    got = {(r.member, bytes(r.data)) for r in tarred.read_tar(spark, str(tmp_path / "tar")).collect()}
    assert got == {(f"r/{k}.bin", f"doc {k}".encode()) for k in range(7)}


def test_stream(spark, tmp_path):
    from scholion.plans.derived import tokens

    docs = spark.createDataFrame([(k, f"one two {k}", "en", "s", 9) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    query = run_batches(stream_documents(spark, str(tmp_path / "in")), tokens, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == tokens(docs).count() == 18
