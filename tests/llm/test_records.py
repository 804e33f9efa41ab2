import io
import os
import zlib

import numpy as np
import pytest
from helpers import odd_texts, rng, table

from burstline.llm import records, tokens
from burstline.llm.common import clear, kept, new_folder, qualified, scratch, written

PATH = tokens.default_path()


def test_round_trip(spark):
    texts = odd_texts(rng())
    folder = new_folder(spark, "test")
    shards = records.write_records(table(spark, texts), folder, PATH)
    assert records.files(spark, folder) == shards
    got = records.read_records(spark, folder).orderBy("shard", "place").collect()
    tokenizer = tokens.encoder(PATH).tokenizer
    order = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    last = shards[-1]
    places = [last.records - 1, 0]
    by_index = records.read_at(qualified(spark, folder), last.name, places)
    own = {r.place: r for r in got if r.shard == last.shard}
    assert [(d, len(x)) for d, x in by_index] == [(own[p].doc_id, own[p].n_tokens) for p in places]


def test_empty_table(spark):
    assert records.round_trip(table(spark, []), PATH).count() == 0


def test_frames():
    data = records.frame(b"abc") + records.frame(b"")
    file = io.BytesIO(data)
    assert [records.read_frame(file) for _ in range(3)] == [b"abc", b"", None]
    for i in range(len(data) - 16):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            file = io.BytesIO(bytes(broken))
            while records.read_frame(file) is not None:
                pass
    for ids in ([], [5, 65_535], [70_000]):
        doc_id, back = records.unpack_ids(records.pack_ids(None, np.asarray(ids, np.uint32)))
        assert doc_id is None and back.tolist() == ids


def test_tasks_may_run_twice(spark):
    """Files of another attempt lie beside those that count, and are not read."""
    from pyarrow import fs

    folder = new_folder(spark, "twice")
    texts = odd_texts(rng(1))
    first = records.write_records(table(spark, texts), folder + "/a", PATH)
    again = records.write_records(table(spark, texts), folder + "/a2", PATH)
    disk, path = records.filesystem(qualified(spark, folder + "/a"))
    fs.copy_files(path + "2", path, source_filesystem=disk, destination_filesystem=disk)
    disk.delete_dir(path + "/files")
    spark.createDataFrame(first, records._FILES).write.parquet(folder + "/a/files")
    assert len([f for f in disk.get_file_info(fs.FileSelector(path)) if f.path.endswith(".rec")]) == len(first) + len(again)
    assert records.read_records(spark, folder + "/a").count() == len(texts)


def test_folders(spark, tmp_path):
    with scratch(spark):
        inner = written(spark.range(3), "inner")
        out = kept(inner.selectExpr("id + 1 AS id"), "outer")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]
    there = lambda df: [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    assert not there(inner) and there(out)
    assert qualified(spark, str(tmp_path / "x")).startswith("file:")
    clear(spark)
    assert not there(out)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from burstline.llm import common

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_dir(Session())
