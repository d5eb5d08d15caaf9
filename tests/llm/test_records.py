import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordfold.llm import records
from tests_llm_texts import odd_texts

P = pytest.importorskip("public_tokenizers")


def test_frames_round_trip_and_detect_damage():
    for doc_id, ids in ((5, [1, 2, 65535]), (None, []), (-3, [70000, 0]), (2**62, [10, 13] * 400)):
        raw = records.frame(doc_id, np.array(ids, np.int64))
        got = records.read_frame(memoryview(raw), 0)
        assert (got[0], got[1].tolist(), got[2]) == (doc_id, ids, len(raw))
        for k in range(len(raw)):
            bad = bytearray(raw)
            bad[k] ^= 4
            with pytest.raises((ValueError, struct.error)):
                records.read_frame(memoryview(bytes(bad)), 0)


def test_files_hold_what_the_library_gives(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    texts = odd_texts(600) + [None, "same", "same"]
    pairs = [(10_000 - 3 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "twice"), (7, "twice"), (7, "other")]
    docs = make_docs(pairs).repartition(4).withColumn("start", F.lit("x")).withColumn("tie", F.lit("x"))
    old = records.SHARD_BYTES
    records.SHARD_BYTES = 20_000
    try:
        records.write_records(docs, path, str(tmp_path / "f"), 2)
    finally:
        records.SHARD_BYTES = old
    records.write_index(spark, str(tmp_path / "f"), str(tmp_path / "i"))
    rows = records.read_index(spark, str(tmp_path / "i")).orderBy("shard", "seq").collect()
    assert len(rows) == len(pairs) and len({r.shard for r in rows}) > 3
    ids_of = lambda t: tk.encode(t or "", add_special_tokens=False).ids + [2]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda i: (i is not None, i or 0)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in pairs), key=key)
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted(
        (key(i), len(ids_of(t)), crc(ids_of(t))) for i, t in pairs)
    assert [r.start for r in rows] == np.append(0, np.cumsum([r.n_tokens for r in rows]))[:-1].tolist()
    wanted = records.read_index(spark, str(tmp_path / "i")).where("seq % 3 = 0").select("shard", "offset")
    got = records.fetch(spark, str(tmp_path / "f"), wanted).collect()
    by = {(r.shard, r.offset): r for r in rows}
    assert len(got) == wanted.count() and all(crc(g.ids) == by[g.shard, g.offset].ids_crc32 for g in got)


def test_empty_table(spark, make_docs, tmp_path):
    records.write_records(make_docs(["x"]).limit(0), P.path("byte_bpe_50k.json"), str(tmp_path / "f"), 2)
    records.write_index(spark, str(tmp_path / "f"), str(tmp_path / "i"))
    assert records.read_index(spark, str(tmp_path / "i")).count() == 0
