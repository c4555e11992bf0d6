import zlib

from tests.llm.helpers import awkward

from molscreen.llm import kd_shards as q


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = q.query(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(folder + "/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    total, where = [0] * 16, {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        total[r["shard"]] += r["size"]
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert max(total) < 1.05 * sum(total) / 16 and min(total) > 0.95 * sum(total) / 16
    assert all(len(s) == 1 for s in where.values())
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_hot_group_is_divided(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text number ', id)) AS text", "'en' AS lang", "'s' AS source")
    total = [0] * 8
    for r in q.shard(docs, 8).collect():
        total[r["shard"]] += r["size"]
    assert max(total) < 1.15 * sum(total) / 8 and min(total) > 0.85 * sum(total) / 8


def test_awkward_rows(spark):
    docs = awkward(spark)
    for n in (1, 3, 16):
        rows = q.shard(docs, n).collect()
        assert len(rows) == docs.count() and {r["shard"] for r in rows} <= set(range(n))
        assert sum(r["size"] for r in rows if r["doc_id"] in (4, 5)) == 2
    assert q.shard(docs.drop("lang", "source"), 4).count() == docs.count()
    assert q.shard(docs.limit(0)).count() == 0
    assert q.shards_for(1000, 300) == 4
