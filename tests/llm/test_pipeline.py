"""The pipeline's stages, each against brute force on what it was given."""

import re

import corpus_pipeline
from palisade.llm import bpe, components, paragraphs
from palisade.llm.store import saved

SF = "/root/testdata/sf0.001"


def shingles_of(text):
    words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    items = [shingles_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # columns that the stages might use themselves
    for n, name in enumerate(("node", "first_id", "first_row", "cut_id", "cut_row", "cut_spans", "hit", "hit_row", "root", "row", "shingle", "doc", "hash")):
        docs = docs.withColumn(name, docs.doc_id + n)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns and all(r.node == r.doc_id and r.hash == r.doc_id + 12 for r in kept[name])
    assert len(kept["language_id"]) >= 0.98 * spark.read.parquet(f"{SF}/documents.parquet").count()
    sets = [shingles_of(r.text) for r in kept["ngram_jaccard"]]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            common = len(a & b)
            assert 100 * common < 75 * (len(a) + len(b) - common)
    hit = {
        r.doc_id
        for r in kept["substring_dedup"]
        for item in items
        if 100 * len(item & shingles_of(r.text)) >= 75 * len(item)
    }
    assert {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in kept["substring_dedup"]} - hit
    assert {r.doc_id for r in kept["bpe"]} == {r.doc_id for r in kept["decontamination"]}


def test_rows_of_one_id_or_none_are_told_apart(spark, tmp_path):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    item, passage = words("item", 20), words("p", 60)
    rows = [
        (1, words("a", 90)),
        (1, f"{words('b', 30)} {item}"),  # contaminated
        (2, passage),
        (3, f"{passage} {words('c', 90)}"),  # cut
        (3, f"{words('d', 150)} end"),  # whole
        (4, words("e", 80)),
        (5, words("f", 80)),
        (5, words("e", 80)),  # in the class of 4
        (None, words("g", 80)),
        (None, f"{words('g', 80)} more"),  # near copy
        (None, f"{words('h', 30)} {item}"),  # contaminated
        (None, f"{words('i', 40)} {passage} {words('j', 40)}"),  # cut
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.distinct, corpus_pipeline.trimmed, corpus_pipeline.decontaminated):
        docs = saved(stage(spark, docs, str(tmp_path)))
    got = {(r.doc_id, " ".join(r.text.split())) for r in docs.collect()}
    one_g = got & {(None, words("g", 80)), (None, f"{words('g', 80)} more")}
    assert len(one_g) == 1  # the one of the lesser hash
    assert got - one_g == {
        (1, words("a", 90)), (2, passage), (3, words("c", 90)), (3, f"{words('d', 150)} end"), (4, words("e", 80)),
        (5, words("f", 80)), (None, f"{words('i', 40)} {words('j', 40)}"),
    }


def test_run_against_the_library_on_what_should_be_left(spark, tmp_path):
    """All stages by ``run``: kept rows by hand, their tokens by the tokenizer library."""
    import hashlib
    import struct
    from collections import Counter

    from palisade.llm.vocabulary import default_path, loaded, tokenizer_text

    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    item, passage = words("item", 20), words("p", 60)
    rows = [
        (1, words("a", 90), "en"), (2, f"{words('b', 30)} {item}", "en"), (3, passage, "en"),
        (4, f"{passage}\n\n\n{words('c', 90)}", "en"), (5, words("a", 90) + " more", "en"), (6, None, "en"), (7, "123 !", None),
        (8, f"Title\n\n\n{words('d', 30)}\n{words('e', 30)}", None), (9, f"{words('f', 40)}\n{words('e', 30)}\n\nend", None),
        (None, words("g", 80), "en"), (None, f"{words('h', 30)} {item}", "en"),
    ]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, first_id long, hit long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [
        (1, words("a", 90)), (3, passage), (4, f"\n\n{words('c', 90)}"), (8, rows[7][1]), (9, f"{words('f', 40)}\n\nend"),
        (None, words("g", 80)),
    ]
    library = loaded(tokenizer_text(default_path()))
    want = Counter()
    for doc, text in left:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[doc, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_only_whole_lines_take_a_line_end_along():
    from palisade.llm.paragraphs import cut_text

    def cut(text, *spans):
        return cut_text(text, [{"start": a, "end": b} for a, b in spans])

    text = "Title\n\n\nVerse one\n\nVerse two\n\nend\n"
    at = text.index("Verse two")
    assert cut(text, (at, at + 9)) == "Title\n\n\nVerse one\n\n\nend\n"
    assert cut(text, (at, at + 5)) == "Title\n\n\nVerse one\n\n two\n\nend\n"
    assert cut(text, (at, at + 5), (at + 3, at + 9)) == "Title\n\n\nVerse one\n\n\nend\n"
    assert cut("a\nb\nc", (0, 1), (2, 3)) == "c" and cut("a\nb\nc", (2, 3), (4, 5)) == "a"
    assert cut("a\nb", (2, 3)) == "a" and cut("a b", (2, 3)) == "a " and cut("a", (0, 1)) == ""
    assert cut("a\n", (0, 1)) == "" and cut(None) is None and cut("x") == "x"


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
        assert docs.count() == 0


def python_passes(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return len(re.findall(r"\b(?:MapInArrow|ArrowEvalPython)\b", plan))


def test_no_stage_takes_two_workers_for_a_task(spark):
    docs = saved(spark.createDataFrame([(1, "ein Wort\nzwei", 13), (2, "ein Wort", 8), (3, None, 0)], "doc_id long, text string, n_chars int"))
    assert python_passes(corpus_pipeline.encoded(spark, docs, SF)) == 1
    spans = docs.where("doc_id = 2").selectExpr("doc_id", "true AS removed", "0 AS start", "8 AS end", "xxhash64(text) AS row")
    left = paragraphs.without_repeats(docs, spans)
    assert python_passes(left) == 1
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
    both = bpe.decode_documents(bpe.encode_documents(docs)).select("doc_id", "n_tokens", "ids_sha256", "text")
    assert sorted(bpe.round_trip(docs).collect()) == sorted(both.collect())


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    files = []

    def counted(frame):
        table = saved(frame)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "saved", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
        assert {r.root for r in components.components(edges).collect()} == {0}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism
