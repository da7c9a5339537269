"""The index of live contents: untouched buckets are not read, and buckets that outgrow a task are split."""

import os
import shutil

from ledgerline.llm import exact_dedup


def contents(make, *texts):
    return make(list(texts)).select("doc_id", exact_dedup.content_key().alias("digest"))


def live(index):
    return {r.keep_id: r.group_size for r in index.live().collect()}


def test_untouched_buckets_are_not_read(spark, make):
    index = exact_dedup.DigestIndex.empty(spark, 6 * exact_dedup.BUCKET_ROWS).change(insert=contents(make, *(f"t{i}" for i in range(60))))
    (table, buckets), = index.parts
    assert buckets == frozenset(range(6))
    one = contents(make, (100, "t7")).select(index._bucket().alias("b")).first().b
    folder = os.path.dirname(os.path.dirname(table.inputFiles()[0].removeprefix("file://")))
    for b in buckets - {one}:  # were another bucket's files read, the change would fail
        shutil.move(f"{folder}/bucket={b}", f"{folder}/_away{b}")
    changed = index.change(insert=contents(make, (100, "t7")), delete=contents(make, (0, "never")).select("digest").limit(0))
    assert [b for _, b in changed.parts] == [buckets - {one}, frozenset({one})]
    for b in buckets - {one}:
        shutil.move(f"{folder}/_away{b}", f"{folder}/bucket={b}")
    assert live(changed) == {i: 1 for i in range(60)} | {7: 2}


def test_buckets_split(spark, make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 20)
    index = exact_dedup.DigestIndex.empty(spark, 20)
    sizes = {}
    for k in range(3):
        index = index.change(insert=contents(make, *((100 * k + i, f"t{k}-{i // 2}") for i in range(80))))
        sizes |= {100 * k + i: 2 for i in range(0, 80, 2)}
    assert index.buckets >= 4 and live(index) == sizes
    most = index.rows.groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert most <= 2 * 20 + 1 and index.rows.filter("filter is not null").count() == index.buckets
    index = index.change(delete=contents(make, (0, "t0-0"), (1, "t2-39")).select("digest"))
    del sizes[0], sizes[278]
    assert live(index) == sizes


def test_no_changes(spark, make):
    index = exact_dedup.DigestIndex.empty(spark, 0)
    assert index.change() is index and live(index) == {} and live(index.change(insert=contents(make))) == {}
