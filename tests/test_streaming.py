from resonance.sources.tables import TEXT_SCHEMA
from resonance.streaming.collect import _stored_elsewhere, collect_texts, collected, run_id
from resonance.streaming.keystore import KeyStore


def test_collection_resumes_and_survives_replay(spark, tmp_path):
    source, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), TEXT_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint=check):
        stream = spark.readStream.schema(TEXT_SCHEMA).parquet(source)
        collect_texts(stream, store, checkpoint).awaitTermination()
        return sorted((r["post_url"], r["post_text"]) for r in collected(spark, store).collect())

    arrive(("a", "one "), (None, "x"), ("b", "  "))
    assert run() == [("a", "one")]
    arrive(("a", "other"), ("c", "two"), ("c", "three"))
    want = [("a", "one"), ("c", "three"), ("c", "two")]
    assert run() == want
    assert run() == want  # nothing new
    first = run_id(spark, check)
    assert _stored_elsewhere(spark, store, first, 1).count() == 1
    # Another checkpoint, which sees all files anew, adds to the store and loses nothing.
    arrive(("d", "four"))
    assert run(str(tmp_path / "other")) == sorted([*want, ("d", "four")])
    assert run_id(spark, str(tmp_path / "other")) != first
    assert run() == sorted([*want, ("d", "four")])


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), TEXT_SCHEMA)


def stored(store):
    return sorted((r["post_url"], r["post_text"]) for r in store.texts().collect())


def test_key_store_adds_each_url_once(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), buckets=8)
    assert stored(store) == []
    assert store.add(rows_of(spark, ("a", " one"), (None, "x"), ("b", "  "), ("c", "two"), ("c", "three")), "r/0")
    assert not store.add(rows_of(spark, ("z", "replayed")), "r/0")
    assert store.add(rows_of(spark, ("a", "other"), ("d", "four")), "r/1")
    assert store.add(rows_of(spark), "r/2")
    assert stored(store) == [("a", "one"), ("c", "three"), ("c", "two"), ("d", "four")]
    assert [c.number for c in store.commits()] == [1, 2, 3]


def test_batch_reads_only_its_buckets(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), buckets=8)
    store.add(rows_of(spark, *[(f"u{i}", "t") for i in range(50)]))
    plan = store.keys(store.commits(), [2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "IN (2,5)" in plan and "post_text" not in plan


def test_two_runs_at_once_do_not_both_add_a_url(spark, tmp_path, monkeypatch):
    store, commit = KeyStore(spark, str(tmp_path / "s")), KeyStore._commit
    other, calls = KeyStore(spark, str(tmp_path / "s")), []

    def late(self, mine):
        if self is store and not calls:
            calls.append(mine)
            assert other.add(rows_of(spark, ("a", "theirs"), ("b", "theirs")), "other/0")
        return commit(self, mine)

    monkeypatch.setattr(KeyStore, "_commit", late)
    assert store.add(rows_of(spark, ("a", "mine"), ("c", "mine")), "first/0")
    assert stored(store) == [("a", "theirs"), ("b", "theirs"), ("c", "mine")]
    assert [c.owner for c in store.commits()] == ["other/0", "first/0"]


def test_document_stream_reads_a_file_or_a_folder(spark, tmp_path):
    from resonance.catalog import streams

    rows = spark.createDataFrame([(1, " one "), (2, "two"), (3, " "), (4, None)], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    rows.toPandas().to_parquet((tmp_path / "documents.parquet").as_posix())
    for at in (str(tmp_path), f"{tmp_path}/folder"):
        for query in (streams.s6_streaming_collection, streams.s6_collection_of_two_runs, streams.s6_collection_by_key_index):
            assert sorted(r["post_text"] for r in query(spark, at).collect()) == ["one", "two"]
