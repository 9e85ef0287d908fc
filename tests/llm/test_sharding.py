import zlib

from tablescope.llm.sharding import shard_records

from .helpers import no_docs, odd_docs, odd_rows, prose


def check(rows, shards):
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(0 <= r.shard < shards for r in rows)


def test_near_equal_bytes_and_groups_together(spark):
    docs = [(i, prose(i, 20 + i % 90)) for i in range(3000)] + [(5000 + i, "copied " + prose(i % 7, 50)) for i in range(140)]
    got = shard_records(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    text = dict(docs)
    check(got, 24)
    assert len(got) == len(docs) and all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
                                         and r.law == "bytes" and r.grown_shard is None for r in got)
    sums = [sum(r.size for r in got if r.shard == k) for k in range(24)]
    assert max(sums) < 1.05 * sum(sums) / 24 and min(sums) > 0.95 * sum(sums) / 24
    split = sum(len({r.shard for r in got if text[r.doc_id] == t}) > 1 for t in {t for i, t in docs if i >= 5000})
    assert split <= 2


def test_hot_group_is_subdivided(spark):
    docs = [(i, prose(i, 40)) for i in range(1000)] + [(2000 + i, prose(1, 40)) for i in range(1000)]
    got = shard_records(spark.createDataFrame(docs, "doc_id int, text string"), 8).collect()
    check(got, 8)
    sums = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sums) < 1.06 * sum(sums) / 8


def test_odd_rows(spark):
    got = shard_records(odd_docs(spark), 4).collect()
    check(got, 4)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows())
    assert shard_records(no_docs(spark)).collect() == []
    kept = shard_records(odd_docs(spark), 4, carry=True)
    assert kept.columns[:9] == odd_docs(spark).columns and kept.columns[9:] == ["_shard", "slot"] and kept.count() == len(odd_rows())


def test_repeated_rows_spread_over_shards(spark):
    """A third of all rows equal in id and text, or null ids: law bytes holds all the same; ids may be texts."""
    docs = [(str(i), prose(i, 40)) for i in range(2000)] + [(None, prose(1, 40))] * 4000
    got = shard_records(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    check(got, 24)
    sums = [sum(r.size for r in got if r.shard == k) for k in range(24)]
    assert len(got) == 6000 and max(sums) < 1.1 * sum(sums) / 24 and min(sums) > 0.9 * sum(sums) / 24
    carried = shard_records(spark.createDataFrame(docs, "doc_id string, text string"), carry=True)
    assert carried.columns == ["doc_id", "text", "shard", "slot"]
    got = carried.collect()
    check(got, 24)
    sums = [sum(r.shard == k for r in got) for k in range(24)]
    assert len(got) == 6000 and max(sums) < 300
