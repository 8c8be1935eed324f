import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from figmill import constants as C
from figmill.functions import templates as G
from figmill.functions import text as X
from figmill.operators.report import ablation_deltas
from figmill.plans import corpus as P
from figmill.sources import scan, sink
from figmill.sources.staging import stage
from figmill.streaming import curation as ST

FIGURE = "\\begin{tikzpicture}\n\\draw (0,0);\n\\end{tikzpicture}"


def test_markup_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.tex").write_text(f"x {FIGURE} y {FIGURE}")
    (tmp_path / "deep" / "b.tex").write_bytes(b"\xff\xfe" + FIGURE.replace("0,0", "1,1").encode())
    (tmp_path / "c.txt").write_text(FIGURE)
    documents = scan.read_documents(spark, [str(tmp_path)])
    assert documents.count() == 2 and documents.filter(F.col("raw_text").contains("\ufffd")).count() == 1
    assert scan.document_blocks(documents).count() == 3
    kept = scan.external_candidates(spark, [str(tmp_path)], 10)
    assert kept.count() == 2 and scan.external_candidates(spark, [str(tmp_path)], 1).count() == 1
    assert scan.read_split_corpus(spark, str(tmp_path)).count() == 2
    os.mkdir(tmp_path / "empty")
    with pytest.raises(ValueError):
        scan.read_split_corpus(spark, str(tmp_path / "empty"))


def test_shard_scan(spark, tmp_path):
    for i in (0, 2):
        spark.range(i * 10, i * 10 + 5).coalesce(1).write.parquet(f"{tmp_path}/part-{i}")
    (tmp_path / "part-3").mkdir()
    (tmp_path / "part-3" / "x.parquet").write_bytes(b"not parquet")
    schema = spark.range(1).schema
    rows = scan.read_shards(spark, f"{tmp_path}/part-{{index}}", 0, 3, schema).orderBy("scan_pos").collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4, 20, 21, 22, 23, 24]
    capped = scan.read_shards(spark, f"{tmp_path}/part-{{index}}", 0, 4, schema, max_rows=7)
    assert sorted(r["id"] for r in capped.collect()) == [0, 1, 2, 3, 4, 20, 21]
    with pytest.raises(ValueError):
        scan.read_shards(spark, f"{tmp_path}/part-{{index}}", 5, 5, schema)


def test_limited_scan_opens_only_the_files_it_needs(spark, tmp_path):
    for i in range(6):
        spark.range(i * 10, i * 10 + 4).coalesce(1).write.parquet(f"{tmp_path}/a b-{i}")
    (tmp_path / "a b-0" / "broken.parquet").write_bytes(b"not parquet")
    schema = spark.range(1).schema
    template = f"{tmp_path}/a b-{{index}}"
    first = scan.read_shards(spark, template, 0, 6, schema, max_rows=6)
    assert sorted(r["id"] for r in first.collect()) == [0, 1, 2, 3, 10, 11]
    assert {f.split("/")[-2].replace("%20", " ") for f in first.inputFiles() if "a%20b" in f or "a b" in f} == {"a b-0", "a b-1"}
    assert scan.read_shards(spark, template, 2, 6, schema, max_rows=0).count() == 0
    assert scan.read_shards(spark, template, 2, 6, schema, max_rows=99).count() == 16
    with pytest.raises(ValueError):
        scan.read_shards(spark, template, 0, 6, schema, max_rows=-1)


def test_pairing(spark):
    left = spark.createDataFrame([("t", 1), ("t", 2)], "split string, sample_id int")
    right = spark.createDataFrame([("t", 2), ("t", 3)], "split string, sample_id int")
    report = scan.pair_report(left, right).first()
    assert (report["matched"], report["markup_only"], report["image_only"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        scan.paired_samples(left, right)
    assert scan.paired_samples(left, left.withColumn("image", F.lit("x"))).count() == 2


def test_evaluation_records(spark, tmp_path):
    for policy, extra in (("greedy", {}), ("beam", {"coordinate_points_compared": 2, "emitted_primitives": ["draw"]})):
        folder = tmp_path / "circle_arc" / "sample_07"
        folder.mkdir(parents=True, exist_ok=True)
        record = {"policy": policy, "ssim": 0.5, "raw_indices": [1, 2], "unbalanced_delimiters_raw": {"()": 1},
                  "predicted_coordinates": [[1.0, 2.0]], **extra}
        (folder / f"{policy}_meta.json").write_text(json.dumps(record, indent=2))
    rows = {r["path_policy"]: r for r in scan.read_evaluations(spark, str(tmp_path)).collect()}
    assert rows["greedy"]["family"] == "circle_arc" and rows["greedy"]["sample_index"] == 7
    assert rows["greedy"]["record_version"] == 1 and rows["greedy"]["emitted_primitives"] is None
    assert rows["beam"]["record_version"] == 2 and rows["beam"]["predicted_coordinates"] == [[1.0, 2.0]]


def test_shards_and_manifest(spark, tmp_path):
    samples = spark.range(25).select(
        F.col("id").alias("sample_id"), F.lit("train").alias("split"),
        F.when(F.col("id") < 20, "node_arrow").otherwise("polygon").alias("family"),
    )
    path = str(tmp_path / "shards")
    sink.write_shards(samples, path, 10)
    counts = {r["shard_id"]: r["count"] for r in sink.read_written_shards(spark, path).groupBy("shard_id").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 5}
    documents = sink.manifest_json(sink.shard_manifest(sink.sharded(samples, 10)), 256, 512)
    lines = [json.loads(r["manifest"]) for r in documents.filter("split = 'train'").collect()]
    assert [x["total_samples"] for x in lines if "version" in x] == [25]
    assert {x["shard_id"]: x["family_counts"]["node_arrow"] for x in lines if "shard_id" in x}[1] == 10
    back = sink.manifest_shards(documents).filter("split = 'train'").orderBy("shard_id").collect()
    assert back[2]["family_counts"]["polygon"] == 5 and back[2]["family_counts"]["grid_axes"] == 0


def test_many_shards_are_named_as_the_manifest_says(spark, tmp_path):
    """A thousand shards in one job, one file each, in two folders."""
    samples = spark.range(2997).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"),
        F.lit("polygon").alias("family"),
    )
    path = str(tmp_path / "shards")
    sink.write_shards(samples, path, 3)
    sink.write_shards(samples, path, 3)  # a second run replaces the first
    files = sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    shards = sink.read_written_shards(spark, path)
    manifest = sink.shard_manifest(shards).collect()
    assert len(files) == 999 and files == sorted(f"{r['file_name']}.parquet" for r in manifest)
    assert {r["num_samples"] for r in manifest} == {3} and shards.count() == 2997
    one = spark.read.parquet(f"{path}/val/val_shard_0007.parquet").orderBy("position")
    assert [tuple(r) for r in one.select("sample_id", "shard_id", "position").collect()] == [(63, 7, 21), (66, 7, 22), (69, 7, 23)]


def test_random_access_returns_samples(spark, tmp_path):
    samples = spark.range(25).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") < 4, "val").otherwise("train").alias("split"),
        F.lit("polygon").alias("family"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("markup"),
    )
    sink.write_shards(samples, str(tmp_path / "s"), 5)
    shards = sink.read_written_shards(spark, str(tmp_path / "s"))
    asked = spark.createDataFrame([(0,), (20,), (20,), (24,), (25,), (-1,)], "index bigint")
    found = sink.fetched_samples(shards, sink.shard_lookup(sink.shard_manifest(shards), asked), 5)
    got = sorted((r["index"], r["markup"], r["out_of_range"]) for r in found.collect())
    assert got == [(-1, None, True), (0, "m4", False), (20, "m24", False), (20, "m24", False), (24, "m3", False), (25, None, True)]


def test_documents_are_single_files_of_ordered_fragments(spark, tmp_path):
    rows = [(f"{n} +%.txt", k, f"{n}-{k}") for n in "ab" for k in range(300)]
    sink.write_documents(spark.createDataFrame(rows, "name string, part bigint, text string").repartition(7), str(tmp_path))
    assert sorted(f for f in os.listdir(tmp_path) if f.endswith(".txt")) == ["a +%.txt", "b +%.txt"]
    assert (tmp_path / "b +%.txt").read_text().split() == [f"b-{k}" for k in range(300)]


def test_manifest_files(spark, tmp_path):
    rows = [("train", n, "polygon") for n in (0, 0, 1, 2)] + [("val", 0, "composed")]
    shards = spark.createDataFrame(rows, "split string, shard_id bigint, family string")
    sink.write_manifests(sink.shard_manifest(shards), str(tmp_path), 256, 512)
    whole = {n: json.loads((tmp_path / f"manifest_{n}.json").read_text()) for n in ("train", "val", "v4")}
    assert [s["file_name"] for s in whole["v4"]["shards"]] == [f"train/train_shard_000{n}" for n in range(3)] + ["val/val_shard_0000"]
    assert whole["v4"]["total_samples"] == 5 and whole["train"]["total_samples"] == 4
    assert whole["val"]["shards"][0]["family_counts"]["composed"] == 1 and whole["val"]["version"] == "v4"
    back = {r["file"]: len(r["shards"]) for r in sink.read_manifests(spark, str(tmp_path)).collect()}
    assert back == {"manifest_train.json": 3, "manifest_val.json": 1, "manifest_v4.json": 4}


def test_dataset_manifest(spark, tmp_path):
    rows = [(n, "train" if n % 4 else "val", "polygon" if n % 2 else "external", f"m{n}") for n in range(20)]
    samples = spark.createDataFrame(rows, "sample_id bigint, split string, stratum string, markup string")
    document = sink.dataset_manifest(samples, {"procedural": 30, "external": 5}, 7, 0.25, False)
    sink.write_documents(document, str(tmp_path))
    found = json.loads((tmp_path / "manifest.json").read_text())
    prints = [hashlib.sha256(f"m{n}".encode()).hexdigest() for n in range(8)]
    assert found == {
        "seed": 7, "val_ratio": 0.25, "requested": {"procedural": 30, "external": 5},
        "rendered": {"total": 20, "train": 15, "val": 5},
        "strata": {"external": {"train": 5, "val": 5}, "polygon": {"train": 10, "val": 0}},
        "showcase_rendered": False, "fingerprints_sample": prints,
    }
    assert sink.read_dataset_manifest(spark, str(tmp_path)).first()["requested"]["external"] == 5


def test_vocabulary_object_round_trip(spark, tmp_path):
    """More tokens than any block held, with quotes and control signs, in one JSON object."""
    names = [*C.RESERVED_TOKENS, *C.FAMILY_TOKENS, '"', "\\", "\t", "é", "}"] + [f"t{n:05d}" for n in range(9000)]
    vocabulary = spark.createDataFrame([(t, n) for n, t in enumerate(names)], "token string, idx int")
    sink.write_vocabulary_object(vocabulary, str(tmp_path))
    assert list(json.loads((tmp_path / "vocabulary.json").read_text()).items()) == [(t, n) for n, t in enumerate(names)]
    back = sink.read_vocabulary_object(spark, str(tmp_path / "vocabulary.json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vocabulary.collect()))


def test_vocabulary_files(spark, tmp_path):
    rows = [(t, i) for i, t in enumerate(C.RESERVED_TOKENS)] + [("\\draw", 4), ("é", 5)]
    vocabulary = spark.createDataFrame(rows, "token string, idx int")
    sink.write_vocabulary(vocabulary, str(tmp_path / "v"))
    assert sorted(map(tuple, sink.read_vocabulary(spark, str(tmp_path / "v")).collect())) == sorted(rows)
    assert sorted(map(tuple, sink.vocabulary_entries(sink.vocabulary_documents(vocabulary, 2)).collect())) == sorted(rows)
    sink.write_vocabulary(vocabulary.filter("idx > 0"), str(tmp_path / "w"))
    with pytest.raises(ValueError):
        sink.read_vocabulary(spark, str(tmp_path / "w"))


def test_report_files(spark, tmp_path):
    variants = spark.createDataFrame([("B", 0.5, 0.5, 0.5, 0.5), ("Full", 0.6, 0.4, 0.9, 0.7)],
                                     "variant string, corpus_bleu double, mean_graph_edit_distance double, compilation_rate double, mean_ssim double")
    sink.write_ablation_table(ablation_deltas(variants), str(tmp_path / "t"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert text[0] == "\\begin{table}[h]" and text[-1] == "\\end{table}"
    body = [line for line in text if line.startswith("\\textbf")]
    assert body[0].startswith("\\textbf{Full}") and body[1].startswith("\\textbf{B}")


def test_generation_is_seeded(spark):
    keys = spark.range(400).select(F.col("id").alias("sample_id"))

    def build(n, seed):
        frame = keys.repartition(n)
        rows = frame.select("sample_id", *[G.family_markup(f, seed, F.col("sample_id")).alias(f) for f in C.FAMILIES]).collect()
        return sorted(map(tuple, rows))

    assert build(1, 3) == build(5, 3) != build(5, 4)
    import re

    for row in build(2, 3):
        for markup in row[1:]:
            assert markup.startswith(C.BEGIN_PICTURE) and markup.endswith(C.END_PICTURE) and len(markup) <= 4000
        x = re.findall(r"\((-?\d+\.\d\d), (-?\d+\.\d\d)\)", row[1])
        assert len(x) == 2 and all(abs(float(a[i]) - float(b[i])) > 0.099 for a, b in [x] for i in (0, 1))
    with pytest.raises(ValueError):
        G.family_markup("unknown", 1, F.col("sample_id"))
    assert G.wrap_picture(F.lit("x")) is not None
    figures = keys.select(G.compositional_markup(1, F.col("sample_id"), (5, 20)).alias("m")).collect()
    scopes = [len(r["m"].split("\n")) - 2 for r in figures]
    assert min(scopes) == 5 and max(scopes) == 20
    text = "\n".join(r["m"] for r in figures)
    for part in ("\\path[draw", "|-", "-|", "++(", "<->", "-stealth", "pattern=crosshatch", "diamond", "arc (", "plot (", "rounded corners"):
        assert part in text
    with pytest.raises(ValueError):
        G.compositional_markup(1, F.col("sample_id"), (0, 3))


def test_staged_rows_and_funnel(spark):
    documents = spark.createDataFrame([(1, FIGURE), (2, "x"), (3, FIGURE)], "sample_id int, code string")
    outcomes = spark.createDataFrame([(1, True), (3, False)], "sample_id int, is_successful boolean")
    funnel = P.ingestion_funnel(documents, outcomes).first()
    assert (funnel["documents"], funnel["valid"], funnel["built"]) == (3, 2, 1)
    assert stage(documents, "docs").count() == 3
    kept = P.ingested_pairs(documents, outcomes).collect()
    assert [(r["sample_id"], r["sample_name"]) for r in kept] == [(1, "sample_00000")]
    assert documents.select(X.tags_present(F.col("code")).alias("t")).filter("t").count() == 2


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, "doc_id int, code string, family string").coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = ST.shard_stream(spark, source, schema)
        curated = ST.curated_stream(rows, "code").select("doc_id", "fingerprint")
        ST.append_stream(curated, str(tmp_path / "out"), str(tmp_path / "s1"), True).awaitTermination()
        ST.family_progress_stream(rows, 3, str(tmp_path / "progress"), str(tmp_path / "s2"), True).awaitTermination()

    add([(1, FIGURE, "polygon"), (2, FIGURE, "polygon"), (3, "no", "polyline")])
    schema = spark.read.parquet(source).schema
    run()
    add([(4, FIGURE, "polygon"), (5, FIGURE.replace("0,0", "2,2"), "polygon")])
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    progress = {r["family"]: (r["collected"], r["done"]) for r in ST.latest_progress(spark, str(tmp_path / "progress")).collect()}
    assert progress == {"polygon": (4, True), "polyline": (1, False)}


def test_managed_state_equals_exact_deduplication(spark, tmp_path):
    """Three appended batches and a restart between them; state grows by new blocks only."""
    source = str(tmp_path / "in")
    figures = [FIGURE.replace("0,0", f"{n},{n}") for n in range(8)]
    for key, value in ST.STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        sizes = []
        for batch in ((0, 1, 1, 2), (2, 3, 0), (3, 3, 4, 5, 6)):
            rows = [(n, figures[n]) for n in batch] + [(99, "no")]
            spark.createDataFrame(rows, "doc_id int, code string").coalesce(1).write.mode("append").parquet(source)
            stream = ST.shard_stream(spark, source, spark.read.parquet(source).schema)
            seen = ST.first_seen_stream(stream, "code", prefix=1)
            query = ST.append_stream(seen.select("doc_id", "fingerprint"), str(tmp_path / "out"), str(tmp_path / "state"), True)
            query.awaitTermination()
            sizes.append(ST.state_sizes(query)[-1]["rows"])
        found = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert sorted(found) == [0, 1, 2, 3, 4, 5, 6] and sizes == [3, 4, 7]
        exact = ST.curated_stream(ST.shard_stream(spark, source, spark.read.parquet(source).schema), "code")
        ST.append_stream(exact.select("doc_id"), str(tmp_path / "exact"), str(tmp_path / "e"), True).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "exact")).count() == len(found)
    finally:
        for key in ST.STATE_SETTINGS:
            spark.conf.unset(key)
    for wrong in ({"prefix": 0}, {"ttl_hours": 0}):
        with pytest.raises(ValueError):
            ST.first_seen_stream(stream, "code", **wrong)


def test_names_never_collide(spark):
    numbers = spark.range(99_998, 100_003).withColumnRenamed("id", "position")
    names = [r[0] for r in numbers.select(F.format_string("sample_%05d", "position")).collect()]
    assert names == ["sample_99998", "sample_99999", "sample_100000", "sample_100001", "sample_100002"]
    rows = [("train", n, "node_arrow") for n in (7, 10_000, 10_001)]
    shards = spark.createDataFrame(rows, "split string, shard_id bigint, family string")
    files = sorted(r["file_name"] for r in sink.shard_manifest(shards).collect())
    assert files == ["train/train_shard_0007", "train/train_shard_10000", "train/train_shard_10001"]


def test_shards_are_scanned_by_number(spark, tmp_path):
    for i in (0, 1, 2, 10, 11):
        spark.range(i * 10, i * 10 + 2).coalesce(1).write.parquet(f"{tmp_path}/part-{i}.parquet")
    rows = scan.read_shards(spark, f"{tmp_path}/part-{{index}}.parquet", 0, 12, spark.range(1).schema)
    found = [r["id"] for r in rows.orderBy("scan_pos").collect()]
    assert found == [0, 1, 10, 11, 20, 21, 100, 101, 110, 111]


def test_manifest_lines_and_lookup_keep_every_request(spark):
    rows = [("train", n // 3, "polygon") for n in range(7)] + [("val", 0, "polygon")]
    shards = spark.createDataFrame(rows, "split string, shard_id bigint, family string")
    manifest = sink.shard_manifest(shards)
    documents = sink.manifest_json(manifest, 256, 512)
    heads = {r["split"]: (r["total_samples"], r["total_shards"]) for r in sink.manifest_heads(documents).collect()}
    assert heads == {"train": (7, 3), "val": (1, 1), sink.MASTER: (8, 4)}
    assert sink.manifest_shards(documents).filter(F.col("split") == sink.MASTER).count() == 4
    asked = [(i, c) for i in (-1, 0, 6, 6, 7, 8) for c in ("a",)]
    found = sink.shard_lookup(manifest, spark.createDataFrame(asked, "index bigint, client string"))
    got = sorted((r["index"], r["client"], r["split"], r["shard_id"], r["offset"]) for r in found.collect() if not r["out_of_range"])
    assert got == [(0, "a", "train", 0, 0), (6, "a", "train", 2, 0), (6, "a", "train", 2, 0), (7, "a", "val", 0, 0)]
    assert found.filter("out_of_range").count() == 2


def test_vocabulary_object(spark, tmp_path):
    whole = {"<PAD>": 0, "<BOS>": 1, "<EOS>": 2, "<UNK>": 3, "a": 4}
    (tmp_path / "v.json").write_text(json.dumps(whole, indent=1))
    found = sink.read_vocabulary_object(spark, str(tmp_path / "v.json"))
    assert {r["token"]: r["idx"] for r in found.collect()} == whole
    (tmp_path / "w.json").write_text(json.dumps(whole | {"b": 4}))
    with pytest.raises(ValueError):
        sink.read_vocabulary_object(spark, str(tmp_path / "w.json"))


def test_progress_keeps_one_version_of_every_family(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "sample_id bigint, family string"
    for batch in ([(1, "a"), (2, "b")], [(3, "a")], [(4, "c")], [(5, "a")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = ST.shard_stream(spark, folder, spark.createDataFrame([], schema).schema)
        ST.family_progress_stream(stream, 2, out, state, available_now=True).awaitTermination()
    found = {r["family"]: (r["collected"], r["done"]) for r in ST.latest_progress(spark, out).collect()}
    assert found == {"a": (3, True), "b": (1, False), "c": (1, False)}
    assert len([n for n in os.listdir(out) if n.startswith("version=")]) <= 2


def test_renaming_looks_the_file_system_up_once(spark, tmp_path, monkeypatch):
    """The driver names every shard file, so a file must cost no more than its rename."""
    from figmill.sources import staging

    asked, files_of = [], staging._files
    monkeypatch.setattr(staging, "_files", lambda *a: asked.append(a) or files_of(*a))
    old = [tmp_path / f"part {n}.txt" for n in range(5)]
    for n, path in enumerate(old):
        path.write_text(str(n))
    staging.moved(spark, [(p.as_uri(), f"{tmp_path}/new{n % 2}/a {n}.txt") for n, p in enumerate(old)])
    assert [(tmp_path / f"new{n % 2}" / f"a {n}.txt").read_text() for n in range(5)] == list("01234")
    assert len(asked) == 1
    staging.moved(spark, [])
