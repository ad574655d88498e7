"""Sources, sinks, bundles and evidence on files in a temporary folder."""

import hashlib
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text, tokens
from corpusloom.operators import admission, evidence, metrics
from corpusloom.plans.scratch import cutter
from corpusloom.sources import bundles, readers, sinks


def test_lines_have_numbers_across_blocks(spark, tmp_path):
    lines = [json.dumps({"text": f"line {i} " + "x" * (i % 50), "k": i}) if i % 7 else "" for i in range(500)] + ["{bad"]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('"one"\n\n"three"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = readers.json_lines(spark, str(tmp_path), numbered=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = {r.input_line: r for r in got if r.input_file.endswith("a.jsonl")}
    assert set(a) == {i + 1 for i, x in enumerate(lines) if x} and all(a[i].meta["k"] == str(i - 1) for i in a if i <= 500)
    assert a[501].problem.startswith("bad_json") and sorted((r.input_line, r.text) for r in got if r.input_file.endswith("b.jsonl")) == [(1, "one"), (3, "three")]
    with pytest.raises(Exception, match=r"a\.jsonl:501:bad_json"):
        readers.demand_valid(readers.json_lines(spark, str(tmp_path), numbered=True)).collect()
    use = evidence.usability(readers.json_lines(spark, str(tmp_path)), ["x"]).collect()
    assert {r.input_file.rsplit("/", 1)[1]: (r.rows, r.usable) for r in use} == {"a.jsonl": (sum(map(bool, lines)), sum(map(bool, lines)) - 1), "b.jsonl": (2, 2)}


def test_conversation_lines(spark, tmp_path):
    good = [[{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}], {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "b"}]}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, good)) + "\n")
    got = readers.conversations(spark, str(tmp_path)).collect()
    assert sorted((r.input_line, r.turn, r.role, r.text) for r in got) == [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "user", "u"), (2, 1, "assistant", "b")]
    (tmp_path / "c.jsonl").write_text(json.dumps(good[0]) + "\n" + json.dumps([{"role": "user", "content": "u"}]))
    with pytest.raises(Exception, match=r"c\.jsonl:2: roles out of order"):
        readers.conversations(spark, str(tmp_path)).collect()


def test_strict_readers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1\tone\nno number")
    with pytest.raises(Exception, match="no numbered sentence"):
        readers.numbered_sentences(spark, str(tmp_path / "s.txt")).collect()
    spark.createDataFrame([("a",), (" ",)], "text string").write.parquet(str(tmp_path / "p"))
    with pytest.raises(Exception, match="empty text"):
        readers.parquet(spark, str(tmp_path / "p"), refuse_empty=True).collect()
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("x.conllu", "# text = A b.\n1\tA\n# text = C.\n")
        z.writestr("readme", "# text = no")
    assert sorted(r.text for r in bundles.zip_sentences(spark, str(tmp_path / "t.zip")).collect()) == ["A b.", "C."]
    table = pa.table({"b": [2, 1], "a": ["x", "é"]})
    with pa.OSFile(str(tmp_path / "r.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert [r.line for r in bundles.arrow_stream(spark, str(tmp_path / "r.arrow")).collect()] == ['{"a": "x", "b": 2}', '{"a": "é", "b": 1}']
    with pytest.raises(ValueError, match="pinned"):
        bundles.arrow_stream(spark, str(tmp_path / "r.arrow"), "0")
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "f.txt").write_text("a")
    read = lambda s, p: s.read.text(p)
    assert bundles.unchanged(spark, str(tmp_path / "u"), read, lambda df: df.count()) == 1
    with pytest.raises(ValueError, match="changed"):
        bundles.unchanged(spark, str(tmp_path / "u"), read, lambda df: (tmp_path / "u" / "f.txt").write_text("b"))


def test_shards_of_a_split(spark, tmp_path):
    for n in (0, 1):
        spark.createDataFrame([(f"t{n}",)], "text string").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        next((tmp_path / f"w{n}").glob("part*")).rename(tmp_path / f"train_0000{n}.parquet")
    (tmp_path / "train_x.parquet").write_text("no")
    assert sorted(r.text for r in bundles.read_split(spark, str(tmp_path), "train").collect()) == ["t0", "t1"]
    with pytest.raises(ValueError, match="no val_"):
        bundles.split_shards(str(tmp_path), "val")


def test_bundle_round_trip(tmp_path):
    root = tmp_path / "corpus"
    (root / "d").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"x" * 5000)
    (root / "d" / "b.bin").write_bytes(bytes(range(256)) * 40)
    one = bundles.export_bundle(str(root), str(tmp_path / "out"), part_bytes=100, extra={"rows": 3})
    two = bundles.export_bundle(str(root), str(tmp_path / "out2"), part_bytes=100, extra={"rows": 3})
    assert one == two and len(one["parts"]) > 1 and all(p["bytes"] <= 100 for p in one["parts"])
    bundles.restore_bundle(str(tmp_path / "out"), str(tmp_path / "back"), rows=lambda _: 3)
    assert bundles.inventory(tmp_path / "back") == bundles.inventory(root)
    with pytest.raises(ValueError, match="rows"):
        bundles.restore_bundle(str(tmp_path / "out"), str(tmp_path / "back2"), rows=lambda _: 4)
    part = tmp_path / "out" / one["parts"][0]["path"]
    part.write_bytes(b"0" + part.read_bytes()[1:])
    with pytest.raises(ValueError, match="listed"):
        bundles.restore_bundle(str(tmp_path / "out"), str(tmp_path / "back3"))
    assert not (tmp_path / "back2").exists() and not (tmp_path / "back3").exists() and not list(tmp_path.glob(".back*"))


def test_small_files_are_replaced_whole(tmp_path):
    target = tmp_path / "r.json"
    bundles.atomic_json(target, {"a": 1})
    with pytest.raises(ValueError), bundles.atomic_writer(target) as f:
        f.write("half")
        raise ValueError
    assert json.loads(target.read_text()) == {"a": 1} and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(RuntimeError), bundles.failure_report(target, stage="x") as known:
        known["rows"] = 5
        raise RuntimeError("stop")
    assert json.loads((tmp_path / "r.failed.json").read_text()) == {"stage": "x", "rows": 5, "status": "FAIL", "error": "RuntimeError: stop"} and json.loads(target.read_text()) == {"a": 1}


def test_generations_have_one_writer(spark, tmp_path):
    root, df = str(tmp_path / "g"), spark.range(3)
    first = sinks.publish({"t": df}, root)
    second = sinks.publish({"t": df}, root)
    assert sinks.current(spark, root).endswith(second) and first != second and (tmp_path / "g" / first).exists()
    (tmp_path / "g" / "WRITER.lock").write_text("")
    with pytest.raises(OSError, match="another writer"):
        sinks.publish({"t": df}, root)
    assert sinks.current(spark, root).endswith(second)


def test_ledgers_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(f"text {i}", "ab"[i % 2], f"s{i % 3}") for i in range(30)], "text string, reason string, source string")
    sinks.write_shards(df.withColumn("h", F.sha2("text", 256)), str(tmp_path / "s"), "h", 10)
    ledger = sinks.shard_ledger(spark, str(tmp_path / "s")).collect()
    files = {p.name: p for p in (tmp_path / "s").glob("*.parquet")}
    assert sum(r.rows for r in ledger) == 30 and all(hashlib.sha256(files[r.path].read_bytes()).hexdigest() == r.sha256 for r in ledger)
    md = sinks.report(df, "Title", examples=2)
    assert "| a | 15 |" in md and md.count("* ") == 2
    assert sinks.evidence_sheets({"x": df}, str(tmp_path / "e"), {"x": ["reason"]}) == {"x": 30}
    with pytest.raises(ValueError, match="lacks"):
        sinks.evidence_sheets({"x": df}, str(tmp_path / "e2"), {"x": ["none"]})
    with pytest.raises(Exception, match="unknown source"):
        sinks.write_labelled(df, str(tmp_path / "l"), "source", ["s0", "s1"])
    sinks.write_decisions(df, str(tmp_path / "d"), "reason")
    assert {p.name for p in (tmp_path / "d").iterdir() if p.is_dir()} == {"reason=a", "reason=b"}


def test_evidence(spark):
    files = [{"path": "train_0.parquet", "sha256": "a" * 64}, {"path": "val_0.parquet", "sha256": "b" * 64}]
    digest = hashlib.sha256("".join(sorted(f"{f['path']}\0{f['sha256']}\n" for f in files)).encode()).hexdigest()
    part = lambda rows, chars: {"rows": rows, "chars": chars, "sources": {"s": {"rows": rows, "chars": chars}}}
    parent = {"splits": {"train": part(8, 80), "val": part(2, 20)}, "files": files, "fingerprint": digest, "required": ["spans"], "checks": {"spans": {"status": "PASS", "rows": 10, "remaining": 0}}, "mixture": {"synthetic": {"chars": 10, "cap": 0.15}}, "accounting": {"seen": 15, "quarantined": 5, "final": 10}}
    assert evidence.full_scan_faults(parent) == []
    assert evidence.full_scan_faults(parent | {"checks": {}}) == ["check didn't pass: spans"]
    assert evidence.full_scan_faults(parent | {"mixture": {"synthetic": {"chars": 50, "cap": 0.15}}, "fingerprint": "x"}) == ["cap exceeded: synthetic", "the inventory isn't the fingerprinted one"]
    child = parent | {"splits": {"train": part(7, 70), "val": part(2, 20)}, "removed": {"train": 1}, "accounting": {"seen": 15, "quarantined": 6, "final": 9}, "mixture": {}}
    assert evidence.subset_faults(parent, child) == []
    assert "removed rows don't add up: train" in evidence.subset_faults(parent, child | {"removed": {}})
    assert any("enlarged" in f for f in evidence.subset_faults(parent, child | {"splits": {"train": part(9, 90), "val": part(2, 20)}}))
    entry = lambda p: {"path": p, "bytes": 1, "sha256": "c"}
    run = evidence.run_manifest("run-1", "sft", {"lr": 1.0}, {"train": [entry("t")], "val": [entry("v")]}, entry("k"))
    found = {p: {"bytes": 1, "sha256": "c"} for p in "tvk"}
    assert evidence.manifest_faults(run, found) == [] and evidence.manifest_faults(run, found | {"v": {"bytes": 2, "sha256": "c"}}) == ["changed or missing: v"]
    assert evidence.manifest_faults(run, checkpoint=True) == ["no checkpoint is bound to the run"]
    with pytest.raises(ValueError, match="both splits"):
        evidence.run_manifest("r", "base", {"a": 1}, {"train": [entry("t")], "val": []}, entry("k"))
    assert evidence.path_faults(["/a/b", "/c"], ["/a/b/out", "/d"]) == ["/a/b/out overlaps /a/b"] and evidence.path_faults(["/a"], ["/ab"]) == []
    df = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    assert sorted(map(tuple, evidence.unbound(df("ab"), df("bc")).collect())) == [("a", "missing"), ("c", "unbound")]
    inventory = spark.createDataFrame(files)
    assert evidence.fingerprint(inventory) == evidence.fingerprint(inventory.orderBy(F.desc("path"))) != evidence.fingerprint(inventory.limit(1))
    with pytest.raises(ValueError, match="empty"):
        evidence.leak_audit({"train": spark.createDataFrame([], "doc_id long, text string")}, spark.createDataFrame([(1, "a")], "item_id long, text string"))


def test_containment_and_files(spark):
    child, parent = (spark.createDataFrame(rows, "split string, source string, chars long, key string") for rows in ([("train", "a", 5, "x"), ("train", "b", 1, "y")], [("train", "a", 5, "x"), ("train", "a", 5, "z")]))
    assert [r.key for r in evidence.not_contained(child, parent, "key").collect()] == ["y"]
    assert [(r.split, r.source) for r in evidence.enlarged(parent, child).collect()] == [("train", "b")]
    a, b = (spark.createDataFrame(rows, "path string, sha256 string") for rows in ([("p", "1"), ("q", "2")], [("p", "1"), ("q", "3"), ("r", "4")]))
    assert {r.path for r in evidence.inventory_faults(a, b).collect()} == {"q", "r"}
    rows = spark.createDataFrame([("f1", True), ("f1", False), ("f2", False)], "input_file string, hit boolean")
    files = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file string")
    assert sorted(map(tuple, metrics.counts_by_file(rows, files, F.col("hit")).collect())) == [("f1", 2, 1, "hits"), ("f2", 1, 0, None), ("f3", 0, 0, "missing_or_empty")]


def test_admission_gates(spark):
    policy = admission.AdmissionPolicy(
        url_sources=("web",), blocked_hosts=("bad.org",), clone_routes=(("cn", "be"),), language_labels=("fr",), local_domains=("by",), exempt_hosts=("good.com",), excluded_sources=("old",), reviewed=(("d1", "web"),), archive_segments=("news",),
        teaser=("read more",), teasers=3, dated_tag="tags:", dated_entries=2, menu=("choose a category",), menu_share=0.5, menu_counts=3, game=admission.Marks(("play", "score", "level"), 3, 0.3, 200), store=admission.Marks(("install", "rating"), 2, 0.3, 200),
        wiki_tail=("views",), wiki_controls=admission.Marks(("edit", "history"), 2, 0.3), share_tail=("share this",), share_share=0.4, share_lines=3, share_words=4,
    )
    prose = "a long enough piece of running prose "
    rows = [
        ("old", None, "x", "d", "excluded_source"), ("web", "https://e.com/a", "x", "d1", "reviewed_material_content_defect"), ("web", None, "x", "d", "missing_source_url_for_admission"), ("web", "ftp://e.com", "x", "d", "invalid_source_url_for_admission"),
        ("web", "https://user:pw@e.com/", "x", "d", "invalid_source_url_for_admission"), ("web", "https://www.bad.org/a", "x", "d", "reviewed_problem_source_family"), ("web", "https://n.cn/be/x", "x", "d", "unreviewed_translated_route"),
        ("web", "https://fr.e.com/", "x", "d", "unreviewed_multilingual_route"), ("web", "https://e.com/?lang=FR", "x", "d", "unreviewed_multilingual_route"), ("web", "https://e.com/%66r/x", "x", "d", "unreviewed_multilingual_route"), ("web", "https://e.com/?q=fr", "x", "d", None), ("web", "https://fr.e.by/", "x", "d", None), ("web", "https://fr.good.com/", "x", "d", None),
        ("web", "https://e.com/news/page/12", "x", "d", "paginated_article_archive"), ("a", "https://e.com/news/page/12", "x", "d", None), ("a", None, "{{box|a|b|c}} tail", "d", "dominant_unexpanded_template"), ("a", None, "{{box}} tail", "d", None),
        ("web", "https://e.com/news/1", "Read more. read more! READ MORE", "d", "article_teaser_archive"), ("web", "https://e.com/x", "Read more. read more! READ MORE", "d", None),
        ("a", None, "1.2.2020 x\ntags: a\n3.4.2021 y\ntags: b", "d", "dated_tagged_news_index"), ("a", None, "Choose a category a (1) b (22) c (3)", "d", "dominant_category_selection_menu"), ("a", None, "Play! play score score level level", "d", "dominant_game_navigation_controls"),
        ("a", None, prose * 20 + "play score level", "d", None), ("a", None, "install rating install rating", "d", "dominant_store_navigation_controls"), ("a", None, "of to a in it " * 40, "d", "extreme_short_token_fragmentation"), ("a", None, "text views edit history more words", "d", "substantial_wiki_navigation_tail"),
        ("a", None, prose + "share this\none two\nthree\nfour five\n" + "y " * 3, "d", "dominant_related_links_tail"), ("a", None, prose * 9 + "share this\none\ntwo\nthree", "d", None), ("a", None, None, "d", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, source string, url string, text string, digest string, want string")
    got = df.withColumn("reason", admission.admission_reason(policy)).orderBy("i").collect()
    assert [(r.i, r.reason) for r in got] == [(r.i, r.want) for r in got]
    with pytest.raises(Exception, match="another source"):
        spark.createDataFrame([("a", None, "x", "d1")], "source string, url string, text string, digest string").select(admission.admission_reason(policy)).collect()


def test_tokens(spark):
    model = tokens.model_bytes("/opt/tokenizers/piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["Hello world", "", None, "größe 漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", tokens.ids(spark, F.col("text"), model).alias("ids"), tokens.count(spark, F.col("text"), model).alias("n")).orderBy("i").collect()
    assert [(r.ids, r.n) for r in got] == [(sp.encode(t or ""), len(sp.encode(t or ""))) for t in texts]
    census = {r.source: r for r in metrics.token_census(df.withColumn("source", F.lit("s")), tokens.count(spark, F.col("text"), model)).collect()}
    n = sum(len(sp.encode(t or "")) for t in texts)
    assert census[None].tokens == n + 4 and census["s"].token_share == 1.0 and len(tokens.byte_lengths(model)) == sp.get_piece_size() and tokens.fingerprint(model) == tokens.fingerprint(model)
    described = spark.createDataFrame([("s", 4, 24), ("t", 1, 1)], "source string, rows long, chars long")
    assert {r.source for r in metrics.census_faults(metrics.token_census(df.withColumn("source", F.lit("s")), F.lit(1)), described).collect()} <= {"s", "t"}


def test_text_pickup(spark):
    df = spark.createDataFrame([("p", " ", 5, "n")], "prompt string, text string, input int, note string")
    assert df.select(text.present_texts(df.columns)).first()[0] == ["p", "5"] and df.select(text.record_text(df.columns, ("note", "prompt", "none"))).first()[0] == "n\np"
    assert df.select(text.preview(F.lit("abcdef"), 3), text.preview(F.lit(None).cast("string"))).first()[:] == ("abc", "")
    esc = spark.createDataFrame([("&lt;ref&gt;x&lt;/ref&gt;A &amp; [[b|c]]",)], "t string")
    assert esc.select(text.strip_wikitext_escaped(F.col("t"))).first()[0] == "A & c"
    assert spark.createDataFrame([("'''A''' [[b|c]] {{x}} == H ==",)], "t string").select(text.strip_marks(F.col("t"))).first()[0] == "A c H"
    assert cutter(spark)(df).count() == 1
